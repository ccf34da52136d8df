"""Duplicates hidden by formatting differences, collapsed and counted.

A record is hashed from the leaves up, like a Merkle tree:

* a leaf (a text, or one labelled field of it) is normalised to its letters and digits in lower case and
  hashed;
* a text made up wholly of labelled fields is an unordered node: the digests of its fields are sorted and
  hashed together; any other text is one leaf;
* the record is an unordered node over its two texts, as they may have changed places.

Records are grouped by the root digest, in two narrow aggregations combined on the map side, so a group of any
size costs one row a map task. Only records of groups with two or more members are compared in full: the whole canonical
texts behind one digest (letters in their order; or the sorted list of fields, each with its letters in their order) must be equal,
and where they are not, the texts take the digest's place and the groups are formed again.

A text may occur both as labelled fields and with its colons lost. So a record has two digests, ``plain`` (texts
as single leaves) and ``nested`` (fields unordered); records are copies if they share either, and the closure
of both is taken over the few records that have labelled fields.

Defined results: null and empty texts, and texts without letters or digits, are the same empty leaf, so two
records whose texts are both empty are copies; rows whose id is null are left out; repeated rows
with the same id count once; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlens.sources.tables import stage, unstage

_LABEL = r"[^\p{L}\p{N}]*\p{L}[\p{L} ]{0,24}\s*[:=](?!//)"
_FIELD_BREAK = rf"[\n;|]+(?={_LABEL})"


def letters(c: Column) -> Column:
    """The letters and digits of a text in their order, lower case (with ß as ss)."""
    low = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(low, r"[^\p{L}\p{N}]+", "")


def fields(c: Column) -> Column:
    """The normalised labelled fields of a text in sorted order; null unless it starts with a label and has two."""
    parts = F.split(c, _FIELD_BREAK)
    labelled = c.rlike(rf"^{_LABEL}") & (F.size(parts) > 1)
    return F.when(labelled, F.array_sort(F.filter(F.transform(parts, letters), lambda x: x != "")))


def _root(a: Column, b: Column) -> Column:
    x, y = F.md5(a), F.md5(b)
    return F.md5(F.concat(F.least(x, y), F.greatest(x, y)))


def _closure(pairs: DataFrame) -> DataFrame:
    """plain -> label: the smallest nested digest reachable over shared digests. Converges in the links' depth."""
    state = stage(pairs.groupBy("plain").agg(F.min("nested").alias("label")), "copies-closure")
    pairs = stage(pairs.distinct(), "copies-pairs")
    while True:
        up = pairs.join(state, "plain").groupBy("nested").agg(F.min("label").alias("label"))
        nxt = stage(pairs.join(up, "nested").groupBy("plain").agg(F.min("label").alias("label")), "copies-closure")
        changed = nxt.join(state.withColumnRenamed("label", "old"), "plain").filter("label <> old").limit(1).count()
        unstage(state)
        state = nxt
        if not changed:
            return state


def _canonical(a: Column, b: Column) -> Column:
    """Both texts in an order of their own, as they may have changed places."""
    return F.concat_ws("\x02", F.least(a, b), F.greatest(a, b))


def _digests(texts: DataFrame) -> DataFrame:
    """Adds the letters of both texts (pa, pb), or their sorted fields where they have some (na, nb), and both root digests."""
    parts = texts.withColumns({"pa": letters(F.col("a")), "pb": letters(F.col("b")), "fa": fields(F.col("a")), "fb": fields(F.col("b"))})
    parts = parts.withColumns({"na": F.coalesce(F.array_join("fa", "\n"), "pa"), "nb": F.coalesce(F.array_join("fb", "\n"), "pb")})
    return parts.withColumns({"plain": _root(F.col("pa"), F.col("pb")), "nested": F.when(F.col("fa").isNotNull() | F.col("fb").isNotNull(), _root(F.col("na"), F.col("nb")))})


def _grouped(keyed: DataFrame) -> DataFrame:
    """id, plain, nested, key of the records in groups of two or more."""
    label = _closure(keyed.filter("nested is not null").select("plain", "nested"))
    named = keyed.join(label, "plain", "left").select("id", "plain", "nested", F.coalesce("label", "plain").alias("key"))
    several = named.groupBy("key").agg(F.count_distinct("id").alias("n")).filter("n > 1").select("key")
    return stage(named.join(several, "key").distinct(), "copies-suspects")


def _told_apart(suspects: DataFrame, texts: DataFrame) -> DataFrame | None:
    """The suspects with digests that stand for one text each; null where they do already, as the full comparison shows."""
    parts = _digests(texts).select(F.col("id").alias("own"), F.col("plain").alias("p"), F.col("nested").alias("n"), _canonical(F.col("pa"), F.col("pb")).alias("plain_full"), F.when(F.col("nested").isNotNull(), _canonical(F.col("na"), F.col("nb"))).alias("nested_full"))
    # an id may stand for several rows: each is held against its own digests
    full = suspects.join(parts, (F.col("id") == F.col("own")) & (F.col("plain") == F.col("p")) & F.col("nested").eqNullSafe(F.col("n")))
    full = stage(full.select("id", "plain", "nested", "plain_full", "nested_full").distinct(), "copies-full")
    out, same = full, True
    for c in ("plain", "nested"):
        mixed = stage(full.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min(f"{c}_full").alias("low"), F.max(f"{c}_full").alias("high")).filter("low <> high").select(c, F.lit(True).alias(f"{c}_mixed")), "copies-mixed")
        if mixed.limit(1).count():
            same = False
            out = out.join(mixed, c, "left").withColumn(c, F.when(F.col(f"{c}_mixed"), F.concat(c, F.lit(":"), f"{c}_full")).otherwise(F.col(c)))
    if same:
        unstage(full)
        return None
    return out.select("id", "plain", "nested")


def copy_groups(rows: DataFrame, id_col: str, text_a: str, text_b: str) -> DataFrame:
    """id, kept_id and copies (of the whole group) for every record of a group of two or more."""
    texts = rows.select(F.col(id_col).alias("id"), F.col(text_a).alias("a"), F.col(text_b).alias("b")).filter("id is not null")
    keyed = stage(_digests(texts).select("id", "plain", "nested"), "copies-keys")
    suspects = _grouped(keyed)
    unstage(keyed)
    if (apart := _told_apart(suspects, texts)) is not None:
        suspects = _grouped(stage(apart, "copies-apart"))
    members = suspects.select("id", "key").distinct()
    kept = members.groupBy("key").agg(F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("copies"))
    return members.join(kept, "key").select("id", "kept_id", "copies")


def collapsed(rows: DataFrame, id_col: str, text_a: str, text_b: str) -> DataFrame:
    """kept_id and copies: every record once, with the number of records it stands for."""
    groups = copy_groups(rows, id_col, text_a, text_b)
    grouped = groups.filter("id = kept_id").select("kept_id", "copies")
    lone = rows.select(F.col(id_col).alias("kept_id")).filter("kept_id is not null").distinct().join(groups.select(F.col("id").alias("kept_id")), "kept_id", "left_anti")
    return grouped.unionByName(lone.withColumn("copies", F.lit(1).cast("long")))
