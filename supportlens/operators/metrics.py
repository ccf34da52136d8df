"""Classification, routing and retrieval metrics as aggregations. A zero denominator gives 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.when(F.coalesce(b, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(a / b, digits))


def confusion(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """class, support, precision, recall, f1 over the classes of gold and predictions; rows without gold or prediction are left out."""
    both = confusion(rows.filter(F.col(gold).isNotNull() & F.col(pred).isNotNull()), gold, pred)
    sides = both.select(F.explode(F.array(F.struct(F.col("gold").alias("class"), F.lit(1).alias("g"), (F.col("gold") == F.col("pred")).cast("int").alias("t")), F.struct(F.col("pred").alias("class"), F.lit(0).alias("g"), F.lit(0).alias("t")))).alias("x"), "n").select("x.*", "n")
    per = sides.groupBy("class").agg(F.sum(F.col("g") * F.col("n")).alias("support"), F.sum((1 - F.col("g")) * F.col("n")).alias("predicted"), F.sum(F.col("t") * F.col("n")).alias("tp"))
    p, r = F.col("tp") / F.greatest("predicted", F.lit(1)), F.col("tp") / F.greatest("support", F.lit(1))
    f = F.when(F.col("tp") == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return per.select("class", "support", "predicted", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"), f.alias("_f1"))


def averages(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    c = per_class(rows, gold, pred)
    return c.agg(F.count(F.lit(1)).alias("classes"), F.round(F.avg("_f1"), 4).alias("macro_f1"), F.round(F.sum(F.col("_f1") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"))


def buckets(rows: DataFrame, confidence: str, right: Column, edges: list[float]) -> DataFrame:
    """low, n, accuracy of each half-open bucket; empty ones too."""
    spark = rows.sparkSession
    c = F.col(confidence)
    at = F.coalesce(*[F.when((c >= a) & (c < b), F.lit(a)) for a, b in zip(edges, [*edges[1:], float("inf")])])
    per = rows.select(at.alias("low"), right.cast("int").alias("right")).groupBy("low").agg(F.count(F.lit(1)).alias("n"), F.sum("right").alias("k"))
    return spark.createDataFrame([(float(x),) for x in edges], "low double").join(per, "low", "left").select("low", F.coalesce("n", F.lit(0)).alias("n"), ratio(F.col("k"), F.col("n")).alias("accuracy"))


def sweep(rows: DataFrame, thresholds: list[float], gold: str, pred: str, confidence: str, other: str) -> DataFrame:
    """Per threshold: accuracy, coverage and covered accuracy when predictions below it (strictly) become ``other``.

    Each row is read once and counts for every threshold in one aggregation.
    """
    row = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.when(F.col(confidence) < t, F.lit(other)).otherwise(F.col(pred)).alias("p")) for t in thresholds])).alias("x")
    right, covered = F.col("p") == F.col(gold), F.col("p") != other
    per = rows.select(row, gold).select("x.*", gold).groupBy("threshold")
    return per.agg(F.count(F.lit(1)).alias("n"), ratio(F.count_if(right), F.count(F.lit(1))).alias("accuracy"), ratio(F.count_if(covered), F.count(F.lit(1))).alias("coverage"), ratio(F.count_if(covered & right), F.count_if(covered)).alias("covered_accuracy"))
