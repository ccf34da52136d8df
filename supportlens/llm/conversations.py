"""Rebuilding ordered conversations from message rows, as keyed streaming state with event-time watermarks.

``assemble`` is a streaming operator. Messages that know their root are buffered in state by a bucket of roots (many
conversations share a bucket, so that the cost of a state access is spread over thousands of rows). The event time
is the arrival time of a message. A conversation is closed once the watermark has passed its last
arrival by ``idle``; on closing it is validated, put in order and emitted, and its state is dropped. Until then late
and out-of-order messages simply join the buffer.

``rebuild`` replays a whole table through it: reply trees are resolved by the core's hierarchy operator, the messages
are staged with their roots and streamed; a last marker row moves the watermark past every conversation, so
all are closed. With ``slices`` above 1 the table is replayed in that many micro-batches by arrival, as a stream would bring it;
by default it is one, within which nothing can be late and no gap of arrivals splits a conversation. Messages that the watermark drops are
never lost in silence: the replay counts them and raises. A conversation above
``max_local`` messages is not buffered in one task's state: its order comes from two-level ranking joins,
with the same rules.

Rules: messages without a visible character are left out; the rest is ordered by time, then by id as a string, and
numbered from 1; the conversation is dropped if it has a cycle, a parent that is not in the table or an unreadable
time, or unless a message of the brand follows one of the customer.

Defined results: rows with a null id give nothing; of repeated ids the row with the highest line_no holds; a null arrival
time counts as the earliest; a role that the inbound flag does not tell comes from the account list; empty tables
give an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from supportlens.functions.ids import bare_id, flag, handle_key, instant, latest, visible
from supportlens.operators.hierarchy import CYCLE, hierarchy, missing_parents
from supportlens.sources.tables import keep_until_exit, new_path, remove, ship, stage, unstage

MESSAGE = "bucket long, root_id string, tweet_id string, at long, brand boolean, visible boolean, broken boolean, arrived timestamp"
RESULT = "root_id string, position long, tweet_id string, role string"
_MARKER, _MARKED = -1, 7258118400


def _closed(held: pd.DataFrame) -> pd.DataFrame:
    """Validates and orders whole conversations."""
    held = held.drop_duplicates(["root_id", "tweet_id"], keep="last")
    bad = held["broken"].to_numpy() | held["at"].isna().to_numpy()
    dropped = set(held["root_id"][bad])
    kept = held[held["visible"].to_numpy() & ~held["root_id"].isin(dropped).to_numpy()].sort_values(["root_id", "at", "tweet_id"], kind="stable")
    brand = kept["brand"].astype(bool)
    asked = (~brand).groupby(kept["root_id"]).cummax()
    answered = set(kept["root_id"][brand & asked])
    kept = kept[kept["root_id"].isin(answered)]
    return pd.DataFrame({"root_id": kept["root_id"], "position": kept.groupby("root_id").cumcount() + 1, "tweet_id": kept["tweet_id"], "role": kept["brand"].map({True: "brand", False: "customer"})})


def _update(idle_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pickle.loads(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            held += [f[["root_id", "tweet_id", "at", "brand", "visible", "broken", "arrived"]] for f in frames]
        if key[0] == _MARKER or not held:
            return
        rows = pd.concat(held, ignore_index=True)
        arrived = rows["arrived"].astype("int64") if rows["arrived"].dtype.kind in "iu" else rows["arrived"].astype("datetime64[ms]").astype("int64")
        ends = arrived.groupby(rows["root_id"]).transform("max") + idle_ms
        over = (ends <= state.getCurrentWatermarkMs()).to_numpy()
        if over.all():
            state.remove() if state.exists else None
        else:
            rest = rows[~over]
            state.update((pickle.dumps(rest, protocol=5),))
            state.setTimeoutTimestamp(max(int(ends[~over].min()), state.getCurrentWatermarkMs() + 1))
        if over.any():
            yield _closed(rows[over])

    return run


def assemble(messages: DataFrame, idle: str = "14 days", lateness: str = "7 days") -> DataFrame:
    """The streaming operator: columns of MESSAGE in, of RESULT out (append mode).

    idle: how long after its last arrival a conversation is closed; lateness: how far behind the newest arrival a message
    may come and still be taken in. Messages later than that are dropped by the watermark, as in any such stream.
    """
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return messages.withWatermark("arrived", lateness).groupBy("bucket").applyInPandasWithState(_update(ms), RESULT, "blob binary", "append", GroupStateTimeout.EventTimeTimeout)


def messages_of(twcs: DataFrame, accounts: DataFrame, rows_per_bucket: int = 4_000) -> DataFrame:
    """Staged messages with root, role, time and the size of their conversation."""
    links = stage(
        latest(twcs.withColumn("_visible", visible(F.col("text"))), "in_response_to_tweet_id", "author_id", "inbound", "created_at", "loaded_at", "_visible").select(
            "tweet_id", bare_id(F.col("in_response_to_tweet_id")).alias("parent_id"), handle_key(F.col("author_id")).alias("author"), (~flag(F.col("inbound"))).alias("brand"),
            F.unix_micros(instant(F.col("created_at"))).alias("at"), F.col("_visible").alias("visible"), F.col("loaded_at").alias("arrived")),
        "messages",
    )
    brands = accounts.select(handle_key(F.col("author_id")).alias("author")).filter("author is not null").distinct().withColumn("listed", F.lit(True))
    tree = hierarchy(links, "tweet_id", "parent_id").select(F.col("id").alias("tweet_id"), F.col("root").alias("root_id"), "descendants")
    roots = stage(tree, "roots")
    orphans = missing_parents(links, "tweet_id", "parent_id").withColumn("orphan", F.lit(True))
    # per root: is it an orphan, and how many messages are below it
    heads = roots.filter("root_id = tweet_id").join(orphans.withColumnRenamed("id", "tweet_id"), "tweet_id", "left").select("root_id", (F.col("descendants") + 1).alias("size"), F.coalesce("orphan", F.lit(False)).alias("broken"))
    buckets = max(1, links.count() // rows_per_bucket)
    keyed = links.join(roots.select("tweet_id", "root_id"), "tweet_id").filter(F.col("root_id") != CYCLE).join(heads, "root_id").join(brands, "author", "left")
    out = keyed.select(F.pmod(F.xxhash64("root_id"), F.lit(buckets)).alias("bucket"), "root_id", "tweet_id", "at", F.coalesce("brand", "listed", F.lit(False)).alias("brand"), "visible", "broken",
                       F.least(F.greatest("arrived", F.timestamp_seconds(F.lit(1))), F.timestamp_seconds(F.lit(_MARKED - 366 * 86400))).alias("arrived"), "size")  # above the first watermark, which is 0, and closed by the marker
    return out


class LateMessages(RuntimeError):
    """Messages came behind the watermark and were dropped."""


def dropped_late(query: StreamingQuery) -> int:
    """How many messages the watermark has dropped, by the progress of a stream."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def _replayed(messages: DataFrame, idle: str, lateness: str, slices: int) -> DataFrame:
    spark = messages.sparkSession
    at, out, progress = (new_path(spark, x) for x in ("replay", "conversations", "progress"))
    columns = [x.split()[0] for x in MESSAGE.split(", ")]
    marker = spark.range(1).select(F.lit(_MARKER).cast("long").alias("bucket"), *[F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in MESSAGE.split(", ")[1:-1])], F.timestamp_seconds(F.lit(_MARKED)).alias("arrived"))
    rows = messages.select(*columns)
    query, late = None, 0
    first, last = rows.agg(F.min("arrived"), F.max("arrived")).first() if slices > 1 else (None, None)
    width = (last - first) / slices if first else None
    for k in range(slices if first else 1):
        part = rows if not first else rows.filter((F.col("arrived") >= F.lit(first + k * width)) & ((F.col("arrived") < F.lit(first + (k + 1) * width)) if k + 1 < slices else F.lit(True)))
        whole = part.unionByName(marker) if not first or k + 1 == slices else part
        whole.write.mode("append").parquet(at)
        # a query that stops when all is read and goes on from its checkpoint with the next slice
        query = assemble(spark.readStream.schema(MESSAGE).parquet(at), idle, lateness).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        late += dropped_late(query)
    remove(spark, at, progress)
    if late:
        raise LateMessages(f"{late} messages came more than {lateness} behind")
    keep_until_exit(spark, out)
    return spark.read.schema(RESULT).parquet(out)


def _ranked(messages: DataFrame) -> DataFrame:
    """The rules for conversations of any size: positions from counts per hour, and ranks within an hour."""
    root = Window.partitionBy("root_id")
    whole = messages.groupBy("root_id").agg(F.bool_or(F.col("broken") | F.col("at").isNull()).alias("bad"), F.min(F.when(~F.col("brand") & F.col("visible"), F.struct("at", "tweet_id"))).alias("asked"), F.max(F.when(F.col("brand") & F.col("visible"), F.struct("at", "tweet_id"))).alias("answered"))
    good = whole.filter("not bad and answered > asked").select("root_id")
    rows = messages.filter("visible").join(good, "root_id").withColumn("hour", F.expr("at div 3600000000"))
    counts = rows.groupBy("root_id", "hour").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(root.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("root_id", "hour").orderBy("at", "tweet_id")))
    return ranked.join(offsets.drop("n"), ["root_id", "hour"]).select("root_id", (F.col("rank") + F.col("offset")).cast("long").alias("position"), "tweet_id", F.when(F.col("brand"), "brand").otherwise("customer").alias("role"))


def rebuild(twcs: DataFrame, accounts: DataFrame, *, idle: str = "14 days", lateness: str = "7 days", max_local: int = 100_000, slices: int = 1) -> DataFrame:
    """root_id, position, tweet_id, role of every message of a kept conversation."""
    ship(twcs.sparkSession)
    messages = stage(messages_of(twcs, accounts), "keyed")
    large = messages.filter(F.col("size") > max_local)
    out = _replayed(messages.filter(F.col("size") <= max_local), idle, lateness, slices)
    if not large.limit(1).count():
        unstage(messages)
    else:  # at most rows / max_local conversations
        out = out.unionByName(_ranked(large))
    return out
