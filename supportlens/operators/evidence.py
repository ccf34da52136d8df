"""Evidence for replies: sufficiency, a bounded second retrieval, conversion, and the guard that keeps replies to their evidence.

Evidence travels with its reply as bounded arrays (the k best results of one query), so every check is an expression on one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlens.functions import text as T

OTHER = "other_unclear"


def sufficiency(score: Column, has_items: Column, enough: float = 0.35, borderline: float = 0.25) -> Column:
    """empty without items, else sufficient, borderline or insufficient by the best score; a null score counts as 0."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(~F.coalesce(has_items, F.lit(False)), "empty").when(s >= enough, "sufficient").when(s >= borderline, "borderline").otherwise("insufficient")


def may_retry(state: Column, confidence: Column, intent: Column, least: float = 0.5) -> Column:
    """A second search is made for borderline evidence under a confident, specific intent; nulls never retry."""
    return F.coalesce((state == "borderline") & (confidence >= least) & (intent != OTHER) & (intent != ""), F.lit(False))


def augmented(message: Column, intent: Column) -> Column:
    return F.concat(message, F.lit(" "), F.replace(intent, F.lit("_"), F.lit(" ")))


def adopt(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Adds adopted and final_similarity: the second result holds only if its score is strictly higher."""
    better = F.coalesce(F.col(second) > F.coalesce(first, F.lit(0.0)), F.lit(False))
    return rows.withColumn("adopted", better).withColumn("final_similarity", F.when(better, F.col(second)).otherwise(F.coalesce(first, F.lit(0.0))))


def items(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id and its evidence, best first: array of (evidence_id, similarity, problem, resolution, urls, intent).

    results: query_id, id, score, rank (at most k a query); corpus: id, customer_text, brand_text, intent. Links come from the
    brand's text alone.
    """
    item = F.struct("rank", F.col("id").alias("evidence_id"), F.round("score", 4).alias("similarity"), F.col("customer_text").alias("problem"), F.col("brand_text").alias("resolution"), F.coalesce(T.urls(F.col("brand_text")), F.array().cast("array<string>")).alias("urls"), "intent")
    return results.join(corpus, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))


def guard(rows: DataFrame, reply: str, used: str, known: str, allowed: str, grounded: str, action: str) -> DataFrame:
    """Adds verified_text, verified_ids, verified_urls, stripped_urls, verified_action, verified_grounded.

    Ids that are no evidence are dropped, order kept. Links that no evidence holds are taken out of the text. Where links were taken out and
    no id is left, the reply is demoted to a question. It is grounded if it was and has an id or is a question. Nulls: no ids,
    no links, an ungrounded empty text.
    """
    none = F.array().cast("array<string>")
    ids, whitelist = F.coalesce(F.col(known), none), F.coalesce(F.col(allowed), none)
    text = F.coalesce(F.col(reply), F.lit(""))
    fake = F.filter(T.urls(text), lambda u: ~F.array_contains(whitelist, u))
    out = rows.withColumn("verified_ids", F.filter(F.coalesce(F.col(used), none), lambda i: F.array_contains(ids, i))).withColumn("stripped_urls", fake)
    out = out.withColumn("verified_text", F.when(F.size("stripped_urls") > 0, T.without(text, F.col("stripped_urls"))).otherwise(text))
    demoted = (F.size("stripped_urls") > 0) & (F.size("verified_ids") == 0)
    out = out.withColumn("verified_urls", F.filter(T.urls(F.col("verified_text")), lambda u: F.array_contains(whitelist, u)))
    out = out.withColumn("verified_action", F.when(demoted, "ASK_CLARIFICATION").otherwise(F.col(action)))
    kept = F.coalesce(F.col(grounded), F.lit(False)) & ~demoted
    return out.withColumn("verified_grounded", kept & ((F.size("verified_ids") > 0) | (F.col("verified_action") == "ASK_CLARIFICATION")))


def passed(grounded: Column, stripped: Column) -> Column:
    """Whether a reply passes as it stands: grounded, and no link had to be taken out."""
    return F.coalesce(grounded & (F.size(stripped) == 0), F.lit(False))


def understood(intent: Column, confidence: Column, least: float = 0.25) -> tuple[Column, Column, Column]:
    """intent, confidence and abstained with the defaults of a failed or missing prediction."""
    c = F.coalesce(F.when(~F.isnan(confidence), confidence), F.lit(0.0))
    low = intent.isNull() | (c < least)
    return F.when(low, OTHER).otherwise(intent), c, low


def trace(steps: list[tuple[Column, Column]]) -> Column:
    """An ordered array of (step, action) of the steps whose condition holds; a step's action may depend on the row."""
    made = [F.when(when, what) for when, what in steps]
    return F.array_compact(F.array(*made))


def step(name: str, action: Column | str) -> Column:
    return F.struct(F.lit(name).alias("step"), (F.lit(action) if isinstance(action, str) else action).alias("action"))


def serialized(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Adds response (JSON of exactly these fields, nulls kept) and error; values that are not finite give no response but an error."""
    bad = F.lit(False)
    schema = rows.select(*[c.alias(k) for k, c in fields.items()]).dtypes
    for (name, kind), c in zip(schema, fields.values()):
        if kind in ("double", "float"):
            bad = bad | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    body = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})
    return rows.withColumn("error", F.when(bad, "not finite")).withColumn("response", F.when(~bad, body))
