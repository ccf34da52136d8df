"""Checks of requests, judge responses and contexts: validation with reasons, JSON answers in fences, turn positions."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlens.functions import text as T
from supportlens.operators import rules


def request_error(message: Column, most: int = 4000) -> Column:
    """Null for a valid request; else missing, blank or too long (after trimming)."""
    s = T.strip(message)
    return F.when(message.isNull(), "missing").when(s == "", "blank").when(F.length(s) > most, "too long")


def parsed_score(answer: Column) -> Column:
    """The integer score of a JSON object that may stand in code fences; null where it is none, or not 1 to 5."""
    body = T.strip(F.regexp_replace(answer, "```(json)?", ""))
    raw = F.get_json_object(F.when(body.startswith("{"), body), "$.score")
    return F.when(raw.rlike("^[1-5]$"), raw.cast("int"))


def difficulty(text: Column) -> Column:
    """low_context for a few words or characters, multi_intent, ambiguous without a label, else specific."""
    n = F.size(rules.labels(text))
    few = (F.size(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), F.lit(1))) <= 4) | (F.length(text) <= 25)
    return F.when(few, "low_context").when(n >= 2, "multi_intent").when(n == 0, "ambiguous").otherwise("specific")


def turn_position(rows: DataFrame, context: str, message: str, fuzzy: bool = True) -> DataFrame:
    """Adds turn: the first turn (from 0) of ``a | b | c`` that holds the first 60 cleaned characters of the message.

    With ``fuzzy``, else the turn most like its first 80, by edit-based similarity; -1 where there is no context. A
    context is one bounded string, so each row is settled where it lies.
    """
    start = F.substring(T.clean(F.col(message)), 1, 60)
    turns = F.transform(F.split(F.col(context), " \\| "), T.clean)
    hits = F.transform(turns, lambda t: t.contains(start))
    exact = F.coalesce(F.array_position(hits, True).cast("int") - 1, F.lit(-1))
    if not fuzzy:
        return rows.withColumn("turn", exact)

    @F.pandas_udf("int")
    def closest(contexts: pd.Series, messages: pd.Series) -> pd.Series:
        def one(c, m) -> int:
            parts = (c or "").split(" | ") if c else []
            ratio = [SequenceMatcher(None, p.lower()[:80], (m or "").lower()[:80]).ratio() for p in parts]
            return max(range(len(parts)), key=lambda i: (ratio[i], -i)) if parts else -1

        return pd.Series([one(c, m) for c, m in zip(contexts, messages)])

    out = rows.withColumn("_t", exact)
    far = out.filter("_t < 0").withColumn("turn", closest(F.col(context), F.col(message))).drop("_t")
    return out.filter("_t >= 0").withColumnRenamed("_t", "turn").unionByName(far)


def batched(frames: Iterator[pd.DataFrame], call) -> Iterator[pd.DataFrame]:
    """The hook for a remote generator or judge: ``call`` gets and gives whole frames; off by default."""
    for frame in frames:
        yield call(frame)
