"""Reply edges, components, gap segments and conversations from messages.

Messages: tweet_id, author, inbound, ts, text, parent_id. Null keys join to nothing; ties of time are settled by the
id as a string.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supportlens.operators.packed import unpack
from supportlens.sources.tables import stage, unstage

_PAIR = ("brand", "customer")


def links(rows: DataFrame, id_col: str, parents: str, children: str) -> DataFrame:
    """parent_id, child_id, distinct: the links that messages name towards their parents and towards their replies.

    Both fields may pack several ids in any dress; both are parsed in one pass.
    """
    fields = F.explode(F.array(F.struct(F.lit("p").alias("way"), F.col(parents).alias("field")), F.struct(F.lit("c").alias("way"), F.col(children).alias("field")))).alias("x")
    packed = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), fields).select(F.concat("x.way", "id").alias("key"), "x.field")
    found = unpack(packed, "key", "field").filter("error is null or error = 'malformed'")
    own, up = F.substring("key", 2, 1 << 20), F.substring("key", 1, 1) == "p"
    return found.select(F.when(up, F.col("value")).otherwise(own).alias("parent_id"), F.when(up, own).otherwise(F.col("value")).alias("child_id")).distinct()


def reply_edges(messages: DataFrame, max_days: int = 7, named: DataFrame | None = None) -> DataFrame:
    """Links between a customer's and a brand's message, 0 to max_days apart, with both ends and authors known.

    named: the links (parent_id, child_id); by default each message's own parent_id.
    """
    if named is None:
        named = messages.filter("parent_id is not null").select("parent_id", F.col("tweet_id").alias("child_id")).distinct()
    end = lambda k: messages.select(F.col("tweet_id").alias(f"{k}_id"), F.col("author").alias(f"{k}_author"), F.col("inbound").alias(f"{k}_in"), F.col("ts").alias(f"{k}_ts"))
    gap = F.unix_micros("child_ts") - F.unix_micros("parent_ts")
    edges = named.join(end("child"), "child_id").join(end("parent"), "parent_id").filter((F.col("child_in") != F.col("parent_in")) & gap.between(0, max_days * 86_400_000_000))
    of = lambda asked: F.when(F.col("child_in") == F.lit(asked), F.col("child_author")).otherwise(F.col("parent_author"))
    return edges.select("parent_id", "child_id", of(True).alias("customer"), of(False).alias("brand")).filter("customer is not null and brand is not null")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the edges of one customer and brand after another, by union-find; the rows come sorted by both."""
    boss: dict[str, str] = {}
    now: tuple[str, str] | None = None
    out: list[tuple[str, str, str, str]] = []

    def top(x: str) -> str:
        while boss[x] != x:
            boss[x] = boss[boss[x]]
            x = boss[x]
        return x

    def flush() -> None:
        out.extend((*now, top(x), x) for x in boss)
        boss.clear()

    def batch_of() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], names=[*_PAIR, "component", "id"])
        out.clear()
        return b

    for batch in batches:
        for brand, customer, a, b in zip(*(batch.column(k).to_pylist() for k in (*_PAIR, "parent_id", "child_id"))):
            if (brand, customer) != now:
                if now:
                    flush()
                now = (brand, customer)
            for x in (a, b):
                boss.setdefault(x, x)
            a, b = sorted((top(a), top(b)))
            boss[b] = a  # the smallest id stays on top
        if len(out) >= 20_000:
            yield batch_of()
    if now:
        flush()
    yield batch_of()


def _spread(edges: DataFrame) -> DataFrame:
    """The same for groups of any size: the smallest id spreads along the edges and from label to label, until nothing changes."""
    both = stage(edges.select(*_PAIR, F.col("parent_id").alias("id"), F.col("child_id").alias("other")).unionByName(edges.select(*_PAIR, F.col("child_id").alias("id"), F.col("parent_id").alias("other"))).distinct(), "both-ways")
    state = stage(both.groupBy(*_PAIR, "id").agg(F.least(F.min("other"), F.col("id")).alias("label")), "labels")
    while True:
        label = state.select(*_PAIR, F.col("id").alias("other"), F.col("label").alias("seen"))
        near = both.join(label, [*_PAIR, "other"]).groupBy(*_PAIR, "id").agg(F.min("seen").alias("near"))
        jump = state.select(*_PAIR, F.col("id").alias("label"), F.col("label").alias("far"))
        new = state.join(near, [*_PAIR, "id"]).join(jump, [*_PAIR, "label"]).select(*_PAIR, "id", "label", F.least("label", "near", "far").alias("next"))
        new = stage(new, "labels")
        changed = new.filter("next <> label").limit(1).count()
        unstage(state)
        state = new.select(*_PAIR, "id", F.col("next").alias("label"))
        if not changed:
            unstage(both)
            return state.select(*_PAIR, F.col("label").alias("component"), "id")


def edge_components(edges: DataFrame, max_local: int = 100_000) -> DataFrame:
    """(brand, customer, component, id): what hangs together among the edges of one customer with one brand, named by its smallest id.

    A reply to two customers is in a component of each. edges are read twice, so best a staged table. Groups of more than max_local
    edges are not gathered in one task but spread their labels by joins, with the same result.
    """
    sizes = edges.groupBy(*_PAIR).count().filter(F.col("count") > max_local).select(*_PAIR)
    large = stage(sizes, "large-pairs")  # at most (edges / max_local) rows
    has_large = bool(large.limit(1).count())
    small = edges.join(large, list(_PAIR), "left_anti") if has_large else edges
    out = small.select(*_PAIR, "parent_id", "child_id").repartition(*_PAIR).sortWithinPartitions(*_PAIR).mapInArrow(_joined, "brand string, customer string, component string, id string")
    return out.unionByName(_spread(edges.join(large, list(_PAIR), "left_semi"))) if has_large else out


def gap_segments(messages: DataFrame, keys: list[str], gap_days: float) -> DataFrame:
    """Adds segment (from 1): a new one where more than gap_days lie between neighbours, or a time is missing."""
    w = Window.partitionBy(*keys).orderBy(F.col("ts").asc_nulls_last(), "tweet_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    cut = F.when(F.row_number().over(w) == 1, 0).when(gap.isNull() | (gap > int(gap_days * 86_400_000_000)), 1).otherwise(0)
    return messages.withColumn("_cut", cut).withColumn("segment", F.sum("_cut").over(w) + 1).drop("_cut")


def conversations(messages: DataFrame, gap_days: float = 7, named: DataFrame | None = None) -> DataFrame:
    """conversation_id, position, tweet_id, inbound, ts, brand, customer: components of a customer with a brand, cut at long gaps, with both sides in them.

    A reply to two customers is in a conversation of each. Conversations are numbered by their first message; the numbers come from
    counts per hour, not from one task. messages are read several times, so best a staged table; named as in ``reply_edges``.
    """
    edges = stage(reply_edges(messages, named=named), "edges")
    members = edge_components(edges).withColumnRenamed("id", "tweet_id")
    keys = [*_PAIR, "component"]
    rows = stage(gap_segments(members.join(messages.select("tweet_id", "inbound", "ts"), "tweet_id"), keys, gap_days).select(*keys, "segment", "tweet_id", "inbound", "ts"), "segments")
    unstage(edges)
    key = [*keys, "segment"]
    first = F.min(F.struct(F.col("ts").isNull().alias("late"), "ts", "tweet_id")).alias("first")
    kept = stage(rows.groupBy(*key).agg(first, F.bool_or("inbound").alias("asked"), F.bool_or(~F.col("inbound")).alias("answered")).filter("asked and answered").select(*key, "first", F.date_trunc("hour", "first.ts").alias("hour")), "kept")
    hours = kept.groupBy("hour").count()
    before = hours.withColumn("offset", F.coalesce(F.sum("count").over(Window.orderBy(F.col("hour").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("hour", "offset")  # one row per hour
    numbered = kept.withColumn("n", F.row_number().over(Window.partitionBy("hour").orderBy("first", *_PAIR))).join(before, kept["hour"].eqNullSafe(before["hour"])).select(*key, F.format_string("conv_%06d", F.col("n") + F.col("offset")).alias("conversation_id"))
    w = Window.partitionBy(*key).orderBy(F.col("ts").asc_nulls_last(), "tweet_id")
    placed = rows.withColumn("position", F.row_number().over(w).cast("long"))
    return placed.join(numbered, key).select("conversation_id", "position", "tweet_id", "inbound", "ts", *_PAIR)


def reply_pairs(messages: DataFrame) -> DataFrame:
    """resolution_id, customer_tweet_id, brand_tweet_id, created_at: each brand message that answers a customer's."""
    child = messages.filter("not inbound").select(F.col("tweet_id").alias("brand_tweet_id"), "parent_id", F.col("ts").alias("brand_ts"))
    parent = messages.filter("inbound").select(F.col("tweet_id").alias("parent_id"), F.col("ts").alias("customer_ts"))
    return child.join(parent, "parent_id").select(F.format_string("res_%s_%s", "parent_id", "brand_tweet_id").alias("resolution_id"), F.col("parent_id").alias("customer_tweet_id"), "brand_tweet_id", F.coalesce("brand_ts", "customer_ts").alias("created_at"))
