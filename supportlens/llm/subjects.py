"""Subject areas of documents by label propagation over a graph of sentences and the terms they share.

Nodes are the distinct sentences of the corpus and of the labelled examples; two sentences are similar as far as they share
terms (words, and pairs of words), so the graph is kept as its sentence-term edges. Labels start at the
examples' sentences, which are trusted and stay clamped, and spread by joins:

    terms     <- share of each subject among the labelled sentences with the term (examples weigh more)
    sentences <- sum of the shares of its terms; labelled where one subject leads clearly

for a fixed number of rounds, the first of them over whole documents (documents of like terms get like labels). Terms found in all subjects alike carry nothing, so templates, names and places fall out
by themselves. An edge is verified by its purity: a term below ``purity`` passes nothing on.

Stock sentences are about no area: figures of speech and passing phrases recur as they stand in documents of all subjects. How
often a sentence recurs says nothing; it is stock where the documents it stands in surely share no subject (see ``_stock``).
Documents of the same sentences count once there, so copies of a document add nothing.

A document has every subject that holds at least a quarter of its labelled sentences. Whole texts are read.

Defined results: null, empty and blank texts, and texts without a labelled sentence, have no subject; repeated doc_ids are
read as one document; rows without a doc_id are left out; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlens.sources.tables import ship, stage, unstage

_LINK = re.compile(r"https?://\S+")
_CLEAN = re.compile(r"\x1b\[[0-9;]*m|<[^<>]{1,80}>|[­​-‏ -‮⁠-⁤﻿︀-️]|[\x00-\x08\x0b-\x1f]")
#: Ends of sentences; the sign itself goes with the break, as only words are read. A leading class keeps the search fast.
_SPLIT = re.compile(r"[.!?…。;\n](?:(?<=\n)\n*|(?<=;)\s+|(?<=[.!?…。])[\"'”»)*_]*\s+|(?<=[!?])(?=[A-ZÀ-Þ¿¡]))")
_TAG = re.compile(r"^\W*\[\w+\]\s*")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_DIGITS = re.compile(r"\d+")
_REMEMBERED = 200_000  # pieces of text a worker keeps, for speed alone


def _h(x: str) -> int:
    h = xxhash.xxh64_intdigest(x)
    return h - (1 << 64) if h >> 63 else h


def _sentence(part: str) -> str | None:
    """The words of a piece of text, joined by blanks, lower case and with digits masked; null where there are none."""
    low = (_TAG.sub("", part) if "[" in part else part).lower()
    words = _WORD.findall(_DIGITS.sub("9", low))
    return " ".join(words) if any(len(w) > 1 and not w.isdigit() for w in words) else None


def sentences(text: str) -> Iterator[list[str]]:
    """Word lists of the sentences, lower case, with digits masked and links left out."""
    for part in _SPLIT.split(_CLEAN.sub("", _LINK.sub(" 9 ", text) if "http" in text else text)):
        if part and (s := _sentence(part)):
            yield s.split(" ")


def _read(always: bool):
    """(key, form, n, text): the sentences of each text with their counts; the text of a form comes with its first row only, or always."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, str] | None] = {}  # a piece of text -> form and words
        told: set[int] = set()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                at, forms, counts, texts = [], [], [], []
                for i, text in enumerate(piece.column(1).to_pylist()):
                    c: Counter[tuple[int, str]] = Counter()
                    for part in _SPLIT.split(_CLEAN.sub("", _LINK.sub(" 9 ", text) if "http" in text else text)):
                        if part not in known:
                            if len(known) >= _REMEMBERED:
                                known.clear()
                            s = _sentence(part)
                            known[part] = (_h(s), s) if s else None
                        if got := known[part]:
                            c[got] += 1
                    for (f, s), n in c.items():
                        at.append(i)
                        forms.append(f)
                        counts.append(n)
                        texts.append(s if always or f not in told else None)
                        told.add(f)
                if len(told) >= _REMEMBERED:
                    told.clear()
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column(0).take(take), pa.array(forms, pa.int64()), pa.array(counts, pa.int64()), pa.array(texts, pa.string())], names=["key", "form", "n", "text"])

    return run


def terms(text: Column) -> Column:
    """Hashes of the words of three letters or more and of the pairs of neighbouring words, without masked digits."""
    words = F.split(text, " ")
    plain = F.transform(F.filter(words, lambda w: (F.length(w) > 2) & ~w.contains("9")), lambda w: F.xxhash64(w))
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.when(~a.contains("9") & ~b.contains("9"), F.xxhash64(a, b)))
    return F.array_distinct(F.array_compact(F.concat(plain, pairs)))


def _edges(forms: DataFrame) -> DataFrame:
    return forms.select("form", F.explode("terms").alias("term"))


def _small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Marked for broadcast if a count finds it within ``rows`` narrow rows (some 20 MB); beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _floors(counts: DataFrame, names: list[str], purity: float) -> list[float]:
    """The share each subject must reach among the uses of a term or sentence.

    Where a subject is so common that its share is near ``purity`` anyway, it must stand out by 30 % of the rest.
    """
    totals = counts.agg(*[F.sum(c) for c in names], F.sum("uses")).first()
    base = [(x or 0.0) / (totals[-1] or 1.0) for x in totals[:-1]]
    return [max(purity, b + 0.3 * (1 - b)) for b in base]


def _lexicon(counts: DataFrame, names: list[str], purity: float) -> DataFrame:
    """term, label, share of a subject in all uses of the term: the verified edges; all others pass nothing on."""
    floors = _floors(counts, names, purity)
    shares = [F.struct(F.lit(k).alias("label"), (F.col(c) / (F.col("uses") + 1)).alias("share")) for k, c in enumerate(names)]
    kept = F.filter(F.array(*[F.when(x["share"] >= q, x) for x, q in zip(shares, floors)]), lambda x: x.isNotNull())
    return counts.select("term", F.explode(kept).alias("x")).select("term", "x.label", "x.share")


def _may_reach(names: list[str], floors: list[float]) -> Column:
    """Whether a subject reaches its floor among the uses, or falls short of it by no more than chance in one case of 20.

    1.65 standard errors, so that few uses prove nothing; the rule is the same at every size.
    """
    whole = sum((F.col(c) for c in names), F.lit(0.0))
    return (whole == 0) | reduce(or_, [F.col(c) / F.greatest(whole, F.lit(1.0)) + 1.65 * (q * (1 - q)) ** 0.5 / F.sqrt(F.greatest(whole, F.lit(1.0))) >= q for c, q in zip(names, floors)])


def _scores(edges: DataFrame, lexicon: DataFrame) -> DataFrame:
    """form, label, score. The edges of a form lie together, so they are summed before anything is shuffled."""
    return edges.join(_small(lexicon), "term").groupBy("form", "label").agg(F.sum("share").alias("score"))


def _lead(scores: DataFrame, key: str, least: float, share: float) -> DataFrame:
    """key, label: the leading subject, where it has at least ``least`` and that share of all."""
    best = scores.groupBy(key).agg(F.max(F.struct("score", (-F.col("label")).alias("label"))).alias("best"), F.sum("score").alias("whole"))
    return best.filter((F.col("best.score") >= least) & (F.col("best.score") >= share * F.col("whole"))).select(key, (-F.col("best.label")).alias("label"))


def _per_label(rows: DataFrame, key: str, names: list[str], *more: Column) -> DataFrame:
    return rows.groupBy(key).agg(*[F.count_if(F.col("label") == k).cast("double").alias(c) for k, c in enumerate(names)], *more)


def _spread(forms: DataFrame, seeds: DataFrame, read: DataFrame, n: int, rounds: int, purity: float, clamp: float) -> DataFrame:
    """form -> label (index of the subject), for the sentences that get one. seeds: form, text, label, n."""
    names = [f"s{k}" for k in range(n)]
    every = sum((F.col(c) for c in names), F.lit(0.0))
    seeded = stage(seeds.select("label", "n", F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(*[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).cast("double").alias(c) for k, c in enumerate(names)], F.sum("n").cast("double").alias("uses")), "subject-seeds")
    clamped = seeds.groupBy("form").agg(F.min("label").alias("seed"), F.max("label").alias("other")).filter("seed = other").select("form", "seed")
    # first over documents: the examples are few, so a turn of phrase may stand beside one subject by chance; over a whole
    # document this averages out, and a term met in documents of many subjects passes nothing on
    scores = _scores(_edges(forms), _lexicon(seeded, names, 0.3))
    documents = _lead(read.join(scores, "form").groupBy("doc_id", "label").agg(F.sum("score").alias("score")), "doc_id", 1.0, 0.4)
    bags = read.groupBy("doc_id").agg(F.struct(F.bit_xor("form"), F.count(F.lit(1)), F.min("form"), F.max("form")).alias("bag"))
    documents = bags.join(documents, "doc_id").groupBy("bag").agg(F.min(F.struct("doc_id", "label")).alias("of")).select("of.*")
    per = read.select("doc_id", "form").join(documents, "doc_id").groupBy("form", "label").agg(F.count(F.lit(1)).alias("docs"))
    among = stage(per.groupBy("form").agg(*[F.sum(F.when(F.col("label") == k, F.col("docs")).otherwise(0)).cast("double").alias(c) for k, c in enumerate(names)]), "subject-among")
    stock = stage(among.filter(~_may_reach(names, _floors(among.withColumn("uses", every), names, purity))).select("form"), "subject-stock")
    plain = forms.join(stock, "form", "left_anti")
    met = plain.join(among, "form", "left").select(F.explode("terms").alias("term"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    counts = stage(met.groupBy("term").agg(F.count(F.lit(1)).alias("forms"), *[F.sum(c).alias(c) for c in names]).withColumn("uses", every), "subject-terms")
    unstage(among)
    # only edges that can pass a label on are kept: the term links two sentences, or one and an example, and is not surely impure
    passing = counts.join(seeded.select("term", F.lit(True).alias("seed")), "term", "left").filter((F.col("forms") > 1) | F.col("seed")).filter(_may_reach(names, _floors(counts, names, purity))).select("term")
    linked = stage(_edges(plain).join(_small(passing), "term").groupBy("form").agg(F.collect_list("term").alias("terms")), "subject-edges")  # as long as a sentence
    edges = _edges(linked)
    anchored = seeded.select("term", *[(F.col(c) * clamp).alias(c) for c in [*names, "uses"]])
    labels = None
    for r in range(rounds):
        found = _lead(_scores(edges, _lexicon(counts, names, purity)), "form", purity, 0.6)
        # sentences of the examples keep their label in every round
        new = stage(found.join(clamped, "form", "full").select("form", F.coalesce("seed", "label").alias("label")), "subject-labels")
        unstage(labels, counts)
        labels = new
        if r + 1 < rounds:
            # uses in unlabelled sentences count against a term, so that passing phrases do not take on a subject by and by
            grown = _per_label(linked.join(labels, "form", "left").select("label", F.explode("terms").alias("term")), "term", names, F.count(F.lit(1)).cast("double").alias("uses"))
            counts = stage(grown.unionByName(anchored).groupBy("term").agg(*[F.sum(c).alias(c) for c in [*names, "uses"]]), "subject-terms")
    unstage(linked, seeded, stock)
    return labels


def labelled_sentences(documents: DataFrame, examples: DataFrame, areas: DataFrame, *, rounds: int = 3, purity: float = 0.5, clamp: float = 1.0) -> tuple[DataFrame, list[str]]:
    """(doc_id, label, n) for the labelled sentences of every document, and the names the labels index."""
    ship(documents.sparkSession)
    subjects = sorted(r["subject"] for r in areas.select("subject").filter("subject is not null").distinct().collect())  # the list of areas: a handful
    index = F.coalesce(*[F.when(F.col("subject") == s, F.lit(k)) for k, s in enumerate(subjects)]) if subjects else F.lit(None).cast("int")
    kind = dict(documents.dtypes)["doc_id"]
    read = documents.select("doc_id", "text").filter("doc_id is not null and text is not null").mapInArrow(_read(False), f"key {kind}, form long, n long, text string")
    read = stage(read.withColumnRenamed("key", "doc_id"), "sentences")
    if not subjects:
        return read.select("doc_id", F.lit(0).alias("label"), "n").limit(0), subjects
    seeds = examples.select(index.cast("int").alias("subject"), "text").filter("subject is not null and text is not null").mapInArrow(_read(True), "key int, form long, n long, text string").withColumnRenamed("key", "label")
    forms = stage(read.filter("text is not null").groupBy("form").agg(F.any_value("text").alias("text")).select("form", terms(F.col("text")).alias("terms")), "forms")
    labels = _spread(forms, seeds, read, len(subjects), rounds, purity, clamp)
    unstage(forms)
    return read.select("doc_id", "form", "n").join(labels, "form").groupBy("doc_id", "label").agg(F.sum("n").alias("n")), subjects


def subjects_of(documents: DataFrame, examples: DataFrame, areas: DataFrame, *, share: float = 0.25, **options) -> DataFrame:
    """doc_id, subject, share: every subject with at least that share of a document's labelled sentences."""
    rows, names = labelled_sentences(documents, examples, areas, **options)
    rows = stage(rows, "subject-counts")
    whole = rows.groupBy("doc_id").agg(F.sum("n").alias("whole"))
    named = F.element_at(F.array(*[F.lit(x) for x in names] or [F.lit(None).cast("string")]), (F.col("label") + 1).cast("int"))
    return rows.join(whole, "doc_id").filter(F.col("n") >= share * F.col("whole")).select("doc_id", named.alias("subject"), (F.col("n") / F.col("whole")).alias("share"))


def make_up(documents: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Documents per subject and the given columns; a document with several subjects counts in each, one without in null."""
    rows = documents.filter("doc_id is not null").select("doc_id", *by).distinct()
    return rows.join(found.select("doc_id", "subject"), "doc_id", "left").groupBy(*by, "subject").agg(F.count_distinct("doc_id").alias("documents"))
