"""Streaming twins: stateless scoring of messages, and gap sessions with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlens.functions import text as T
from supportlens.operators import rules
from supportlens.sources.tables import keep_until_exit, new_path, remove


#: The time of a marker row that closes all sessions of a stream that ends (seconds since 1970; the year 2200).
CLOSING = 7_258_118_400


def score(messages: DataFrame) -> DataFrame:
    """topic, risk level, signals and links of each message; the same expressions in batch and in a stream."""
    t = F.coalesce("text", F.lit(""))
    return messages.withColumns({"topic": rules.first_label(t), "risk": rules.level(t), "signals": F.array_join(rules.signals(t), ","), "links": F.size(T.urls(t)).cast("long")})


def sessions(messages: DataFrame, key: str, gap: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """Sessions per key in append mode: closed once the watermark has passed their end. Rows without a time are in no session.

    Over a stream that ends, sessions still open come out with ``CLOSING``: rows of that time, which move the watermark past all others.
    """
    s = F.session_window("ts", gap)
    return messages.filter("ts is not null").withWatermark("ts", lateness).groupBy(key, s.alias("s")).agg(F.count(F.lit(1)).alias("messages")).select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "messages")


def replay(stream: DataFrame, label: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote."""
    spark = stream.sparkSession
    out, progress = new_path(spark, label), new_path(spark, f"{label}-progress")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    remove(spark, progress)
    keep_until_exit(spark, out)
    return spark.read.schema(stream.schema).parquet(out)
