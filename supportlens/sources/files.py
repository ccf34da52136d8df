"""File sources and sinks with declared schemas: raw CSV exports, JSON lines, manifests and reports."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportlens.operators import splits

RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id")])
TWEET = T.StructType([*RAW.fields])
CONVERSATION = T.StructType([T.StructField("conversation_id", T.StringType()), T.StructField("brand", T.StringType()), T.StructField("tweets", T.ArrayType(TWEET))])


def require(columns: Iterable[str], wanted: Iterable[str]) -> None:
    missing = sorted(set(wanted) - set(columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, quoted line breaks kept. The header is read first and must have every column."""
    header = spark.read.option("header", True).csv(path).columns
    require(header, RAW.fieldNames())
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path).select(*RAW.fieldNames())


def read_conversations(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON lines of conversations; blank lines are left out. Broken lines are left out too, or raise when read if ``strict``."""
    rows = spark.read.schema(CONVERSATION).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return rows if strict else rows.filter("conversation_id is not null")


def distinct_ids(rows: DataFrame, col: str, order: str) -> DataFrame:
    """The ids in the order first seen; raises on a row without one."""
    if rows.filter(F.col(col).isNull()).limit(1).count():
        raise ValueError(f"a row has no {col}")
    return rows.groupBy(col).agg(F.min(order).alias(order)).orderBy(order)


def conversation_messages(conversations: DataFrame) -> DataFrame:
    return conversations.select("conversation_id", "brand", F.posexplode("tweets").alias("position", "t")).select("conversation_id", "brand", F.col("position").cast("long"), "t.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Flat rows; arrays are joined by semicolons."""
    flat = df.select(*[F.concat_ws(";", F.col(c)).alias(c) if t.startswith("array<") else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_new(done: DataFrame, rows: DataFrame, key: str, status: str = "status") -> DataFrame:
    """The rows that no earlier run has finished: only SUCCESS counts as done, so failed ones come again."""
    return rows.join(done.filter(F.col(status) == "SUCCESS").select(key), key, "left_anti")


def forbid(df: DataFrame, names: set[str]) -> None:
    """Raises if a column of any of these names is found at any depth of the schema."""

    def walk(t: T.DataType, at: str) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                if f.name in names:
                    raise ValueError(f"forbidden column {at}{f.name}")
                walk(f.dataType, f"{at}{f.name}.")
        elif isinstance(t, T.ArrayType):
            walk(t.elementType, at)
        elif isinstance(t, T.MapType):
            walk(t.valueType, at)

    walk(df.schema, "")


def write_manifest(splits_: DataFrame, col: str, path: str, seed: int = 42) -> None:
    """A split manifest as JSON lines of (id, split, seed), after its rules were checked."""
    splits.check(splits_, col)
    splits_.select(col, "split", F.lit(seed).alias("seed")).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, col: str, path: str, eligible: DataFrame | None = None, golden: DataFrame | None = None) -> DataFrame:
    """The manifest's id and split; its rules are checked again, so a file changed by hand raises."""
    m = spark.read.schema(f"`{col}` string, split string, seed long").json(path).select(col, "split")
    splits.check(m, col, eligible, golden)
    return m


def load_golden(spark: SparkSession, path: str, wanted: int | None = None, key: str = "example_id") -> DataFrame:
    """Labelled rows of a CSV with a header; raises on a missing column, a repeated or missing key, or another count than wanted."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    require(rows.columns, [key, "conversation_id", "gold_intent"])
    n, keys = rows.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    if n != keys or (wanted is not None and n != wanted):
        raise ValueError(f"{n} rows with {keys} distinct keys" + (f", {wanted} wanted" if wanted is not None else ""))
    return rows


def annotation_sheet(rows: DataFrame, columns: tuple[str, ...] = ("gold_intent", "gold_risk", "gold_action", "annotation_notes")) -> DataFrame:
    """The rows with empty columns to fill in; raises if one of them is there already."""
    if there := sorted(set(columns) & set(rows.columns)):
        raise ValueError(f"columns there already: {', '.join(there)}")
    return rows.withColumns({c: F.lit("") for c in columns})


@dataclass(frozen=True)
class Settings:
    """Thresholds of retrieval and routing. An explicit value goes before the file, the file before the default."""

    enough: float = 0.35
    borderline: float = 0.25
    abstain_below: float = 0.25
    confident: float = 0.5
    attempts: int = 2
    top_k: int = 3

    @classmethod
    def load(cls, path: str | None = None, **explicit) -> Settings:
        """From a JSON object on the driver's disk; a missing file gives the defaults, an unknown name raises."""
        given: dict = {}
        if path and Path(path).exists():
            given = json.loads(Path(path).read_text())
        return cls(**{**given, **{k: v for k, v in explicit.items() if v is not None}})


def report(row: dict, title: str) -> str:
    """A metrics row as markdown."""
    return "\n".join([f"# {title}", "", "| metric | value |", "|-|-|", *[f"| {k} | {v} |" for k, v in row.items()]]) + "\n"
