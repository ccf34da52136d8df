"""Same or near-same records across splits: an edit-distance segment join over canonical word sequences.

Two texts overlap if they share at least four fifths of their words (counted with repeats, by the longer text),
in any order. Written as sequences in one canonical order (rare words first; a repeated word is numbered, so
all entries differ), the words in common are the longest common subsequence of the two sequences, and the share is a
bound on insertions and deletions. So the segment join applies:

1. An evaluation sequence of n words may lose at most k = n - ceil(0.8 n) of them; it is cut into k + 1 segments,
   each of the k first words and the word after them, of which at least one must be met in the training sequence.
   Rare words come first, so that one word is a selective segment.
2. Training sequences offer their substrings at the allowed positions: the first m - ceil(0.8 m) + 1. A meeting counts
   if the lengths agree and what lies behind both positions can still hold the words needed.
3. Every meeting is tested inside the join against a lower bound of the edit distance: each entry flips one of
   128 parity bits, so sequences differ in at least as many entries as bits.
4. The few pairs left are verified by banded dynamic programming over whole sequences, for a batch of pairs at once.

Steps 2 to 4 see each distinct bag of words once; rows with the same words are expanded at the end. The canonical
order needs the words that more than 1/2000 of the texts use, at most 2000 times the mean length of a text
however many texts there are; these are broadcast, all other words are ordered by their hash.

Defined results: null texts and texts without words overlap with nothing by words; rows with a null id are left out;
conversation ids are compared without case and padding, null ones match nothing; repeated rows count once; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlens.sources.tables import ship, stage

SHARE = (4, 5)
_LINK = re.compile(r"(?:https?://|www\.)\S+")
_HANDLE = re.compile(r"@\w+")
_APOSTROPHES = re.compile("['’‘ʼ`´′]")
_WORD = re.compile(r"[^\W_]+")
_M64 = (1 << 64) - 1


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case; links, handles and apostrophes are ignored."""
    t = _APOSTROPHES.sub("", _HANDLE.sub(" ", _LINK.sub(" ", text.lower())))
    return _WORD.findall(t)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class _Bag:
    """Words to 64-bit entries, remembered per worker."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def entries(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        seen: dict[str, int] = {}
        known = self.known
        for w in words(text):
            k = seen.get(w, 0)
            seen[w] = k + 1
            name = w if not k else f"{w}\0{k}"
            h = known.get(name)
            if h is None:
                if len(known) > 500_000:
                    known.clear()
                h = known[name] = _signed(xxhash.xxh64_intdigest(name))
            out.append(h)
        return out


def _entry_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bag = _Bag()
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([bag.entries(t) for t in b.column(0).to_pylist()], pa.list_(pa.int64()))], names=["entries"])


def _frequent(texts: DataFrame, n: int) -> dict[int, int]:
    """Rank, the most frequent last, of the words that more than n / 2000 texts use."""
    counts = texts.select("text").mapInArrow(_entry_lists, "entries array<long>").select(F.explode("entries").alias("e")).groupBy("e").count()
    rows = counts.filter(F.col("count") > max(1, n // 2000)).orderBy("count", "e").collect()  # at most 2000 x words per text
    return {r["e"]: k for k, r in enumerate(rows)}


def _sequences(rows: DataFrame, order) -> DataFrame:
    """id, conversation, bag (128-bit name of the word bag), n, seq (canonical), bits0, bits1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag, rank = _Bag(), order.value
        for b in batches:
            names, n, seqs, b0, b1 = [], [], [], [], []
            for t in b.column(1).to_pylist():
                e = sorted(bag.entries(t), key=lambda x: (rank.get(x, -1), x))
                bits = 0
                for x in e:
                    bits ^= 1 << (((x * 0x9E3779B97F4A7C15) & _M64) >> 57)
                seqs.append(e)
                n.append(len(e))
                names.append(xxhash.xxh3_128_digest(np.array(e, np.int64).tobytes()))
                b0.append(_signed(bits & _M64))
                b1.append(_signed(bits >> 64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.binary()), pa.array(n, pa.int32()), pa.array(seqs, pa.list_(pa.int64())), pa.array(b0, pa.int64()), pa.array(b1, pa.int64())], names=["id", "bag", "n", "seq", "bits0", "bits1"])

    return rows.select("id", "text").filter("text is not null").mapInArrow(run, "id string, bag binary, n int, seq array<long>, bits0 long, bits1 long").filter("n > 0")


def _needed(n: Column, m: Column) -> Column:
    return F.ceil(F.greatest(n, m) * SHARE[0] / SHARE[1])


def _segments(classes: DataFrame, side: str) -> DataFrame:
    """One row per segment (word) at an allowed position, counted from 1."""
    keep = F.col("n") - F.expr(f"(n * {SHARE[0]} + {SHARE[1] - 1}) div {SHARE[1]}") + 1
    return classes.select("bag", "n", "bits0", "bits1", F.posexplode(F.slice("seq", F.lit(1), keep.cast("int"))).alias("pos", "word")).select(
        "word", F.col("bag").alias(f"{side}_bag"), F.col("n").alias(f"{side}_n"), (F.col("pos") + 1).alias(f"{side}_pos"), F.col("bits0").alias(f"{side}_b0"), F.col("bits1").alias(f"{side}_b1"))


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Words in common of canonical sequences, pair by pair, by dynamic programming in a band.

    The band is as wide as the pairs' own bounds allow: a cell off the diagonal by more than the entries that either
    side may lose cannot lie on a sufficient path, so leaving it out can only turn an insufficient count lower.
    """
    if not a:
        return np.zeros(0, np.int64)
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    need = -(-np.maximum(n, m) * SHARE[0] // SHARE[1])
    width = int(max((n - need).max(), (m - need).max(), 0))
    A = np.zeros((len(a), int(n.max())), np.int64)
    B = np.zeros((len(b), int(n.max()) + 2 * width + 1), np.int64)
    for i, (x, y) in enumerate(zip(a, b)):
        A[i, : len(x)] = x
        y = y[: B.shape[1] - width]
        B[i, width : width + len(y)] = y
    okA = np.arange(A.shape[1])[None, :] < n[:, None]
    okB = (np.arange(B.shape[1])[None, :] >= width) & (np.arange(B.shape[1])[None, :] - width < m[:, None])
    row = np.zeros((len(a), 2 * width + 2), np.int64)  # row[d]: best up to column i + d - width; the last is a border
    for i in range(A.shape[1]):
        hit = (B[:, i : i + 2 * width + 1] == A[:, i : i + 1]) & okB[:, i : i + 2 * width + 1] & okA[:, i : i + 1]
        # the diagonal step keeps d, the step from above comes from d + 1, the step from the left from d - 1
        new = np.maximum(row[:, :-1] + hit, row[:, 1:])
        new = np.maximum.accumulate(new, axis=1)
        row[:, :-1] = new
        row[:, -1] = 0
    return row[:, :-1].max(axis=1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            p = batch.slice(k, 2048)
            a, b = ([np.array(x, np.int64) for x in p.column(i).to_pylist()] for i in (2, 3))
            got = common(a, b)
            longest = np.array([max(len(x), len(y)) for x, y in zip(a, b)])
            ok = pa.array(got * SHARE[1] >= longest * SHARE[0])
            yield pa.RecordBatch.from_arrays([p.column(0).filter(ok), p.column(1).filter(ok)], names=["e_bag", "t_bag"])


def similar_bags(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """(e_bag, t_bag) of all pairs of distinct word bags that share enough words. In: bag, n, seq, bits0, bits1."""
    e = _segments(evaluation, "e")
    t = _segments(training, "t")
    need = _needed(F.col("e_n"), F.col("t_n"))
    fits = (
        (F.least("e_n", "t_n") >= need)
        & (F.least(F.col("e_n") - F.col("e_pos"), F.col("t_n") - F.col("t_pos")) + 1 >= need)
        & (F.bit_count(F.col("e_b0").bitwiseXOR(F.col("t_b0"))) + F.bit_count(F.col("e_b1").bitwiseXOR(F.col("t_b1"))) <= F.col("e_n") + F.col("t_n") - 2 * need)
    )
    pairs = e.join(t, (e["word"] == t["word"]) & fits).select("e_bag", "t_bag").distinct()
    whole = pairs.join(evaluation.select(F.col("bag").alias("e_bag"), F.col("seq").alias("e_seq")), "e_bag").join(training.select(F.col("bag").alias("t_bag"), F.col("seq").alias("t_seq")), "t_bag")
    return whole.select("e_bag", "t_bag", "e_seq", "t_seq").mapInArrow(_verify, "e_bag binary, t_bag binary")


def _conversation(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def overlaps(evaluation: DataFrame, training: DataFrame, manifest: DataFrame) -> DataFrame:
    """(example_id, resolution_id, same_conversation, same_words) of every overlap of an evaluation record with a training row.

    evaluation: example_id, conversation_id, customer_message; training: resolution_id, conversation_id, customer_text,
    of which the rows of conversations in split train count; manifest: conversation_id, split.
    """
    spark = evaluation.sparkSession
    ship(spark)
    trained = manifest.filter(_conversation(F.col("split")) == "train").select(_conversation(F.col("conversation_id")).alias("conversation")).distinct()
    e = evaluation.select(F.col("example_id").alias("id"), _conversation(F.col("conversation_id")).alias("conversation"), F.col("customer_message").alias("text")).filter("id is not null")
    t = training.select(F.col("resolution_id").alias("id"), _conversation(F.col("conversation_id")).alias("conversation"), F.col("customer_text").alias("text")).filter("id is not null").join(trained, "conversation", "left_semi")
    e, t = stage(e, "evaluation"), stage(t, "training")
    order = spark.sparkContext.broadcast(_frequent(e.unionByName(t), e.count() + t.count()))
    es, ts = stage(_sequences(e, order), "evaluation-words"), stage(_sequences(t, order), "training-words")
    cols = ("bag", "n", "seq", "bits0", "bits1")
    bags = similar_bags(es.select(*cols).dropDuplicates(["bag"]), ts.select(*cols).dropDuplicates(["bag"]))
    by_words = bags.join(es.select(F.col("bag").alias("e_bag"), F.col("id").alias("example_id")), "e_bag").join(ts.select(F.col("bag").alias("t_bag"), F.col("id").alias("resolution_id")), "t_bag").select("example_id", "resolution_id")
    by_conversation = e.filter("conversation is not null").select(F.col("id").alias("example_id"), "conversation").join(t.select(F.col("id").alias("resolution_id"), "conversation"), "conversation").select("example_id", "resolution_id")
    both = by_words.withColumns({"same_conversation": F.lit(False), "same_words": F.lit(True)}).unionByName(by_conversation.withColumns({"same_conversation": F.lit(True), "same_words": F.lit(False)}))
    return both.groupBy("example_id", "resolution_id").agg(F.bool_or("same_conversation").alias("same_conversation"), F.bool_or("same_words").alias("same_words"))


def report(found: DataFrame, evaluation: DataFrame, manifest: DataFrame) -> DataFrame:
    """split, source, examples, overlaps: of the evaluation records' conversations, each record counted once per split and source."""
    where = manifest.select(_conversation(F.col("conversation_id")).alias("conversation"), _conversation(F.col("split")).alias("split"), "source").filter("conversation is not null").groupBy("conversation").agg(F.min("split").alias("split"), F.min("source").alias("source"))
    rows = evaluation.filter("example_id is not null").select("example_id", _conversation(F.col("conversation_id")).alias("conversation")).distinct().join(where, "conversation", "left").select("example_id", "split", "source")
    per = found.groupBy("example_id").agg(F.count(F.lit(1)).alias("overlaps"))
    return rows.join(per, "example_id", "left").groupBy("split", "source").agg(F.count_distinct("example_id").alias("examples"), F.count_distinct(F.when(F.col("overlaps") > 0, F.col("example_id"))).alias("overlapping"), F.sum(F.coalesce("overlaps", F.lit(0))).alias("overlaps"))
