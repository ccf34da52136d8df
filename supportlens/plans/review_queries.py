"""Queries over validation, contexts and reply templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from supportlens.functions import text as T
from supportlens.operators import review, rules
from supportlens.plans.base import MSG, messages, sql_anaphoric, sql_normalize, sql_strip
from supportlens.plans.text_queries import _BUILT, _conversations
from supportlens.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, msg: bool = False, recursive: bool = False):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = ("WITH RECURSIVE " if recursive else "WITH ") + MSG + sql if msg else sql
        return f

    return wrap


@query(f" SELECT coalesce(CASE WHEN text IS NULL THEN 'missing' WHEN {sql_strip('text')} = '' THEN 'blank' WHEN length({sql_strip('text')}) > 400 THEN 'too long' END, 'valid') AS verdict, count(*) AS n FROM msg GROUP BY 1", msg=True)
def request_validation(spark, sf):
    return messages(spark, sf).groupBy(F.coalesce(review.request_error(F.col("text"), 400), F.lit("valid")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT example_id, try_cast(CASE WHEN regexp_matches(s, '^[1-5]$') THEN s END AS INTEGER) AS score FROM (SELECT example_id, json_extract_string(CASE WHEN b LIKE '{%' THEN b END, '$.score') AS s
FROM (SELECT example_id, trim(regexp_replace(a, '```(json)?', '', 'g'), chr(10) || ' ') AS b FROM (SELECT example_id, CASE length(customer_message) % 3 WHEN 0 THEN '```json' || chr(10) || '{"score": ' || length(customer_message) % 7 || '}' || chr(10) || '```' WHEN 1 THEN '{"score": ' || length(customer_message) % 7 || '}' ELSE 'score ' || length(customer_message) % 7 END AS a FROM agent_evaluation WHERE customer_message IS NOT NULL)))""")
def judge_response_parsing(spark, sf):
    """Scores from answers in three dresses: fenced JSON, bare JSON and prose; only integers from 1 to 5 count."""
    n = F.length("customer_message")
    obj = F.concat(F.lit('{"score": '), (n % 7).cast("string"), F.lit("}"))
    answer = F.when(n % 3 == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(n % 3 == 1, obj).otherwise(F.concat(F.lit("score "), (n % 7).cast("string")))
    return table(spark, sf, "agent_evaluation").filter("customer_message is not null").select("example_id", review.parsed_score(answer).alias("score"))


_HARD = f"CASE WHEN len(regexp_extract_all(text, '([A-Za-z]+)', 1)) <= 4 OR length(text) <= 25 THEN 'low_context' WHEN len({rules.sql_labels('text')}) >= 2 THEN 'multi_intent' WHEN len({rules.sql_labels('text')}) = 0 THEN 'ambiguous' ELSE 'specific' END"


@query(f" SELECT {_HARD} AS difficulty, {rules.sql_level('text')} AS risk, count(*) AS n FROM msg WHERE inbound AND text IS NOT NULL GROUP BY 1, 2", msg=True)
def difficulty_hints(spark, sf):
    t = F.col("text")
    return messages(spark, sf).filter("inbound and text is not null").groupBy(review.difficulty(t).alias("difficulty"), rules.level(t).alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT example_id, printf('%s (%.4f < %.2f) %s', pred_intent, intent_confidence, 0.5, coalesce(array_to_string(risk_categories, ';'), '')) AS evidence FROM agent_evaluation WHERE intent_confidence IS NOT NULL AND pred_intent IS NOT NULL")
def evidence_strings(spark, sf):
    e = table(spark, sf, "agent_evaluation").filter("intent_confidence is not null and pred_intent is not null")
    return e.select("example_id", F.format_string("%s (%.4f < %.2f) %s", "pred_intent", "intent_confidence", F.lit(0.5), F.coalesce(F.array_join("risk_categories", ";"), F.lit(""))).alias("evidence"))


_TEMPLATE = "regexp_replace(" + sql_normalize("raw_reply_text") + ", '[0-9]+', '9', 'g')"


@query(f"SELECT template, count(*) AS n FROM (SELECT {_TEMPLATE} AS template FROM agent_evaluation WHERE raw_reply_text IS NOT NULL) GROUP BY 1 ORDER BY n DESC, template LIMIT 20")
def reply_templates(spark, sf):
    t = F.regexp_replace(T.normalize(F.col("raw_reply_text")), "[0-9]+", "9")
    return table(spark, sf, "agent_evaluation").filter("raw_reply_text is not null").groupBy(t.alias("template")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "template").limit(20)


_ANA = sql_anaphoric("text")


@query(_BUILT + f" SELECT b.inbound, b.position > 1 AS has_prior, count(*) AS turns, count(*) FILTER ({_ANA}) AS anaphoric FROM built b JOIN msg USING (tweet_id) WHERE text IS NOT NULL GROUP BY 1, 2", msg=True, recursive=True)
def context_audit(spark, sf):
    m, built = _conversations(spark, sf)
    rows = built.join(m.select("tweet_id", "text"), "tweet_id").filter("text is not null")
    return rows.groupBy("inbound", (F.col("position") > 1).alias("has_prior")).agg(F.count(F.lit(1)).alias("turns"), F.count_if(T.anaphoric(F.col("text"))).alias("anaphoric"))


@query("""SELECT resolution_id, CASE WHEN contains(a, s) THEN 0 WHEN contains(b, s) THEN 1 ELSE -1 END AS turn FROM (SELECT resolution_id, lower(regexp_replace('[customer] ' || c, '[^\\p{L}\\p{N}_ ]', '', 'g')) AS a, lower(regexp_replace('[brand] ' || r, '[^\\p{L}\\p{N}_ ]', '', 'g')) AS b, lower(regexp_replace(c, '[^\\p{L}\\p{N}_ ]', '', 'g'))[1:60] AS s
FROM (SELECT resolution_id, trim(regexp_replace(customer_text, '[^A-Za-z0-9]+', ' ', 'g')) AS c, trim(regexp_replace(brand_text, '[^A-Za-z0-9]+', ' ', 'g')) AS r FROM historical_resolution WHERE customer_text IS NOT NULL AND brand_text IS NOT NULL))""")
def turn_positions(spark, sf):
    plain = lambda c: F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", " "))
    rows = table(spark, sf, "historical_resolution").filter("customer_text is not null and brand_text is not null").select("resolution_id", plain("customer_text").alias("message"), F.concat(F.lit("[customer] "), plain("customer_text"), F.lit(" | [brand] "), plain("brand_text")).alias("context"))
    return review.turn_position(rows, "context", "message", fuzzy=False).select("resolution_id", "turn")
