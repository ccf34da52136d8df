"""Deterministic splits, their validation, and hash-ordered sampling. Rank orders come from md5, equal on any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int | str, c: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


class SplitError(ValueError):
    """A manifest breaks a rule of the splits, or training data meets held-out data."""


def assign(ids: DataFrame, col: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42, golden: DataFrame | None = None) -> DataFrame:
    """col, split: train, dev and test by hash rank, cut at half-even rounded shares. golden: ids that are in no split.

    Only a rank near the two cuts matters, so ids are counted by the first three digits of their hash (4096 buckets) and
    ranked within a bucket: no task holds more than its bucket.
    """
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must sum to 1")
    rows = ids.select(col).filter(F.col(col).isNotNull()).distinct()
    if golden is not None:
        rows = rows.join(golden.select(col).distinct(), col, "left_anti")
    rows = rows.withColumn("_k", order_key(seed, F.col(col))).withColumn("_b", F.substring("_k", 1, 3))
    counts = rows.groupBy("_b").count()
    offsets = counts.select("_b", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("count").over(Window.partitionBy()).alias("_n"))  # 4096 rows
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_k", col))).join(F.broadcast(offsets), "_b").withColumn("_r", F.col("_r") + F.col("_o"))
    train, dev = F.bround(F.col("_n") * ratios[0]), F.bround(F.col("_n") * ratios[1])
    return ranked.select(col, F.when(F.col("_r") <= train, "train").when(F.col("_r") <= train + dev, "dev").otherwise("test").alias("split"))


def violations(manifest: DataFrame, eligible: DataFrame, col: str) -> DataFrame:
    """kind, id: ids in several splits, ids without a split, and ids that should have none."""
    names = manifest.select(F.lower(F.trim("split")).alias("split"), F.lower(F.trim(F.col(col))).alias("id")).distinct()
    own = eligible.select(F.lower(F.trim(F.col(col))).alias("id")).filter("id is not null").distinct()
    several = names.groupBy("id").count().filter("count > 1").select(F.lit("several splits").alias("kind"), "id")
    missing = own.join(names, "id", "left_anti").select(F.lit("no split").alias("kind"), "id")
    extra = names.select("id").distinct().join(own, "id", "left_anti").select(F.lit("unknown").alias("kind"), "id")
    return several.unionByName(missing).unionByName(extra)


def check(manifest: DataFrame, col: str, eligible: DataFrame | None = None, golden: DataFrame | None = None) -> None:
    """Raises SplitError with the first rule broken: no id twice, in two splits, among the golden ones, left out or unknown.

    manifest: id and split (train, dev, test). Ids are compared as they stand.
    """
    m = manifest.select(F.col(col).alias("id"), "split")
    own = m.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("splits"))
    rules = [("repeated", own.filter("splits = 1 and n > 1")), ("in several splits", own.filter("splits > 1"))]
    if golden is not None:
        rules.append(("golden", own.join(golden.select(F.col(col).alias("id")), "id", "left_semi")))
    if eligible is not None:
        want = eligible.select(F.col(col).alias("id")).filter("id is not null").distinct()
        if golden is not None:
            want = want.join(golden.select(F.col(col).alias("id")), "id", "left_anti")
        rules += [("without a split", want.join(own, "id", "left_anti")), ("unknown", own.join(want, "id", "left_anti"))]
    for name, bad in rules:
        if n := bad.count():
            raise SplitError(f"{n} ids are {name}")


def no_leak(train: DataFrame, held_out: DataFrame, col: str) -> None:
    """Raises SplitError if an id of the training data is among the held-out ones."""
    if n := train.select(col).distinct().join(held_out.select(col).distinct(), col, "left_semi").count():
        raise SplitError(f"{n} training ids are held out")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by ``order``; rows without a key give none. Combined on the map side, so a key of any size is cheap."""
    rest = [c for c in rows.columns if c not in (key, order)]
    best = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_r"))
    return best.select(key, "_r.*").select(*rows.columns)


def blend(rows: DataFrame, label: str, key: str, other: str = "other_unclear", percent: int = 10, seed: int | str = 42) -> DataFrame:
    """All rows with a specific label and, of the others, the share ``percent`` (rounded down) in hash order."""
    specific = rows.filter(F.col(label) != other)
    rest = rows.filter(F.col(label) == other)
    n = rest.count() * percent // 100
    drawn = rest.withColumn("_k", order_key(seed, F.col(key))).orderBy("_k", key).limit(n).drop("_k")
    return specific.unionByName(drawn)


def first_n(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(order).limit(n)


def round_robin(rows: DataFrame, strata: list[str], key: str, n: int, seed: int | str = 42) -> DataFrame:
    """n rows, one of each stratum in turn, in hash order within a stratum.

    A stratum can give at most n rows, so each is cut to its n first before the strata are merged; the final order is
    over strata x n rows.
    """
    w = Window.partitionBy(*strata).orderBy("_k", key)
    turn = rows.withColumn("_k", order_key(seed, F.col(key))).withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n)
    return turn.orderBy("turn", *strata, key).limit(n).drop("_k")
