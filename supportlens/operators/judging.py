"""Judging replies: units, prompts without gold labels, validation of answers and ratings, aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlens.functions import text as T
from supportlens.sources.files import forbid

DIMENSIONS = ("groundedness", "correctness", "relevance", "helpfulness", "tone")
#: Columns that tell the gold label; none of them may reach a judge.
GOLD = {"gold_intent", "gold_risk", "gold_action", "annotation_notes"}


def units(records: DataFrame) -> DataFrame:
    """Records with a reply of visible words, without any gold column."""
    kept = records.filter(F.coalesce(T.strip(F.col("raw_reply_text")) != "", F.lit(False))).drop(*GOLD)
    forbid(kept, GOLD)
    return kept


def prompt(message: Column, intent: Column, confidence: Column, evidence: Column, reply: Column) -> Column:
    """One text of the parts a judge may see. evidence: array of (evidence_id, similarity, problem, resolution); empty or null is said so."""
    lines = F.transform(evidence, lambda e: F.format_string("[%s %.4f] %s => %s", e["evidence_id"], e["similarity"], F.coalesce(e["problem"], F.lit("-")), F.coalesce(e["resolution"], F.lit("-"))))
    shown = F.when(F.coalesce(F.size(evidence), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise("none")
    sure = F.when(confidence.isNull(), "unknown").otherwise(F.format_string("%.4f", confidence))
    return F.concat_ws("\n", F.concat(F.lit("message: "), F.coalesce(message, F.lit(""))), F.concat(F.lit("intent: "), F.coalesce(intent, F.lit("-")), F.lit(" ("), sure, F.lit(")")), F.lit("evidence:"), shown, F.concat(F.lit("reply: "), F.coalesce(reply, F.lit(""))))


def validated(answers: DataFrame, answer: str) -> DataFrame:
    """Adds the five marks, mean (four digits), overall and error.

    The answer is a JSON object, perhaps in code fences, with an integer from 1 to 5 for each dimension; true, 4.0 and "4" are no integers.
    overall may be given as a number from 1 to 5, else it is the mean. An answer with an error has no marks.
    """
    body = T.strip(F.regexp_replace(F.col(answer), "```(json)?", ""))
    body = F.when(body.startswith("{") & F.get_json_object(body, "$").isNotNull(), body)
    raw = {d: F.regexp_extract(body, f'"{d}"\\s*:\\s*([^,}}\\s]+)', 1) for d in DIMENSIONS}
    # only a bare integer matches: strings keep their quotes, booleans and fractions their letters and dots
    marks = {d: F.when(raw[d].rlike("^[1-5]$"), raw[d].cast("int")) for d in DIMENSIONS}
    lacking = reduce(lambda a, b: a | b, [F.coalesce(raw[d], F.lit("")) == "" for d in DIMENSIONS])
    wrong = reduce(lambda a, b: a | b, [marks[d].isNull() for d in DIMENSIONS])
    given = F.regexp_extract(body, '"overall"\\s*:\\s*([^,}\\s]+)', 1)
    number = F.when(given.rlike("^[0-9]+(\\.[0-9]+)?$"), given.cast("double"))
    bad = (given != "") & ~F.coalesce(number.between(1, 5), F.lit(False))
    error = F.when(F.col(answer).isNull() | (T.strip(F.col(answer)) == ""), "empty").when(body.isNull(), "no object").when(lacking, "missing dimension").when(wrong, "not an integer from 1 to 5").when(bad, "overall out of range")
    mean = sum((marks[d] for d in DIMENSIONS), F.lit(0)) / 5
    out = answers.withColumn("error", error)
    for d in DIMENSIONS:
        out = out.withColumn(d, F.when(F.col("error").isNull(), marks[d]))
    return out.withColumn("mean", F.when(F.col("error").isNull(), F.round(mean, 4))).withColumn("overall", F.when(F.col("error").isNull(), F.coalesce(number, F.round(mean, 4))))


def rating_error(rating: Column, known: Column, extra: Column) -> Column:
    """Why a human rating (a map of dimension to text as typed) is refused; null where it is fine."""
    whole = reduce(lambda a, b: a & b, [F.coalesce(rating[d].rlike("^[1-5]$"), F.lit(False)) for d in DIMENSIONS])
    return F.when(~known, "unknown example").when(extra, "extra field").when(~whole, "not an integer from 1 to 5")


def mock(reply: Column) -> dict[str, Column]:
    """The marks of the deterministic stand-in for a judge."""
    return {"groundedness": F.when(reply.contains("http"), 5).otherwise(4), "correctness": F.lit(5), "relevance": F.lit(5), "helpfulness": F.lit(4), "tone": F.lit(5)}


def judged(units_: DataFrame, call, schema: str, tries: int = 3) -> DataFrame:
    """A remote judge over batches: ``call`` gets and gives pandas frames; a batch that fails ``tries`` times comes out with status FAILED.

    The rows keep their columns; schema describes what call adds. Nothing is called until the result is read.
    """
    from pyspark.sql import types as S

    import pandas as pd

    added = S.StructType.fromDDL(schema)
    whole = S.StructType([*units_.schema.fields, *added.fields, S.StructField("status", S.StringType())])

    def run(frames):
        for frame in frames:
            for _ in range(tries):
                try:
                    yield call(frame.copy()).assign(status="SUCCESS")[whole.fieldNames()]
                    break
                except Exception:  # noqa: BLE001 - whatever a remote call raises, the batch stays a row
                    continue
            else:
                yield pd.concat([frame, pd.DataFrame({f.name: None for f in added.fields}, index=frame.index)], axis=1).assign(status="FAILED")[whole.fieldNames()]

    return units_.mapInPandas(run, whole)
