"""Queries over evidence, guards, evaluation diagnostics, judging, splits and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from supportlens.functions import text as T
from supportlens.operators import evidence as E
from supportlens.operators import judging, metrics, splits
from supportlens.plans.base import sql_strip
from supportlens.plans.text_queries import _URLS
from supportlens.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def _eval(spark, sf):
    return table(spark, sf, "agent_evaluation")


# ---- evidence and its guard
def _evidence(spark, sf):
    """Per conversation: the ids and links of its resolutions. A conversation holds a handful of pairs."""
    h = table(spark, sf, "historical_resolution").filter("conversation_id is not null")
    per = h.groupBy(F.lower(F.trim("conversation_id")).alias("conv"))
    return per.agg(F.array_sort(F.collect_set("resolution_id")).alias("known"), F.array_distinct(F.flatten(F.collect_list(F.coalesce(T.urls(F.col("brand_text")), F.array().cast("array<string>"))))).alias("allowed"))


_GUARD = f"""WITH ev AS (SELECT lower(trim(conversation_id)) AS conv, list_sort(list(DISTINCT resolution_id)) AS known, list_distinct(flatten(list(coalesce({_URLS.format(c='brand_text')}, [])))) AS allowed FROM historical_resolution WHERE conversation_id IS NOT NULL GROUP BY 1),
r AS (SELECT example_id, coalesce(raw_reply_text, '') AS t, coalesce(known, []) AS known, coalesce(allowed, []) AS allowed, final_action, [coalesce(known[1], 'none'), 'res_unknown'] AS used FROM agent_evaluation a LEFT JOIN ev ON lower(trim(a.conversation_id)) = conv),
f AS (SELECT *, list_filter({_URLS.format(c='t')}, lambda u: NOT list_contains(allowed, u)) AS fake, list_filter(used, lambda i: list_contains(known, i)) AS ids FROM r),
c AS (SELECT *, CASE WHEN len(fake) > 0 THEN list_reduce(list_prepend(t, fake), lambda s, u: {sql_strip("replace(s, u, '')")}) ELSE t END AS clean FROM f),
v AS (SELECT *, list_filter({_URLS.format(c='clean')}, lambda u: list_contains(allowed, u)) AS urls, CASE WHEN len(fake) > 0 AND len(ids) = 0 THEN 'ASK_CLARIFICATION' ELSE final_action END AS act FROM c)"""


def _guarded(spark, sf):
    rows = _eval(spark, sf).withColumn("conv", F.lower(F.trim("conversation_id"))).join(_evidence(spark, sf), "conv", "left")
    rows = rows.withColumn("used", F.array(F.coalesce(F.get("known", F.lit(0)), F.lit("none")), F.lit("res_unknown"))).withColumn("claimed", F.lit(True))
    return E.guard(rows, "raw_reply_text", "used", "known", "allowed", "claimed", "final_action")


@query(_GUARD + " SELECT example_id, clean AS reply, array_to_string(ids, ',') AS ids, array_to_string(urls, ' ') AS urls, len(fake)::BIGINT AS stripped, act AS action, NOT (len(fake) > 0 AND len(ids) = 0) AND (len(ids) > 0 OR act = 'ASK_CLARIFICATION') AS grounded FROM v")
def grounding_guard(spark, sf):
    """Replies held against the evidence of their conversation; one of the ids they claim is none."""
    return _guarded(spark, sf).select("example_id", F.col("verified_text").alias("reply"), F.array_join("verified_ids", ",").alias("ids"), F.array_join("verified_urls", " ").alias("urls"), F.size("stripped_urls").cast("long").alias("stripped"), F.col("verified_action").alias("action"), F.col("verified_grounded").alias("grounded"))


@query(_GUARD + " SELECT example_id, clean AS reply, len(fake)::BIGINT AS removed FROM v WHERE t <> ''")
def ungrounded_url_removal(spark, sf):
    """Links that no evidence of the conversation holds are taken out; the others stay."""
    return _guarded(spark, sf).filter("coalesce(raw_reply_text, '') <> ''").select("example_id", F.col("verified_text").alias("reply"), F.size("stripped_urls").cast("long").alias("removed"))


@query(_GUARD + ", p AS (SELECT NOT (len(fake) > 0 AND len(ids) = 0) AND (len(ids) > 0 OR act = 'ASK_CLARIFICATION') AS grounded, len(fake) AS n FROM v) SELECT count(*) AS replies, count(*) FILTER (grounded) AS grounded, count(*) FILTER (grounded AND n = 0) AS passed, sum(n)::BIGINT AS stripped FROM p")
def verification_counts(spark, sf):
    g = _guarded(spark, sf)
    return g.agg(F.count(F.lit(1)).alias("replies"), F.count_if("verified_grounded").alias("grounded"), F.count_if(E.passed(F.col("verified_grounded"), F.col("stripped_urls"))).alias("passed"), F.sum(F.size("stripped_urls")).alias("stripped"))


_STATE = "CASE WHEN {s} IS NULL THEN 'empty' WHEN {s} >= 0.35 THEN 'sufficient' WHEN {s} >= 0.25 THEN 'borderline' ELSE 'insufficient' END"


@query(f"""WITH s AS (SELECT example_id, initial_top_similarity AS a, final_top_similarity AS b, {_STATE.format(s='initial_top_similarity')} AS state, intent_confidence AS c, pred_intent AS i FROM agent_evaluation)
SELECT example_id, state, coalesce(state = 'borderline' AND c >= 0.5 AND i <> 'other_unclear' AND i <> '', false) AS retried, coalesce(b > coalesce(a, 0.0), false) AS adopted, CASE WHEN coalesce(b > coalesce(a, 0.0), false) THEN b ELSE coalesce(a, 0.0) END AS similarity FROM s""")
def retry_decisions(spark, sf):
    """Sufficiency of the first search, whether a second is due, and what holds after it."""
    state = E.sufficiency(F.col("initial_top_similarity"), F.col("initial_top_similarity").isNotNull())
    rows = E.adopt(_eval(spark, sf).withColumn("state", state), "initial_top_similarity", "final_top_similarity")
    return rows.select("example_id", "state", E.may_retry(F.col("state"), F.col("intent_confidence"), F.col("pred_intent")).alias("retried"), "adopted", F.col("final_similarity").alias("similarity"))


@query("SELECT example_id, CASE WHEN pred_intent IS NULL OR coalesce(intent_confidence, 0.0) < 0.25 THEN 'other_unclear' ELSE pred_intent END AS intent, coalesce(intent_confidence, 0.0) AS confidence, pred_intent IS NULL OR coalesce(intent_confidence, 0.0) < 0.25 AS abstained FROM agent_evaluation")
def understood_messages(spark, sf):
    i, c, a = E.understood(F.col("pred_intent"), F.col("intent_confidence"))
    return _eval(spark, sf).select("example_id", i.alias("intent"), c.alias("confidence"), a.alias("abstained"))


_STEPS = [("UNDERSTAND", "true", "'CLASSIFY'"), ("RETRIEVE_ATTEMPT_1", "retrieval_attempts >= 1", "coalesce(initial_sufficiency, 'unknown')"), ("RETRIEVE_ATTEMPT_2", "retrieval_attempts >= 2", "CASE WHEN retrieval_retry_adopted THEN 'ADOPTED' ELSE 'RETAINED' END"), ("GENERATE", "generation_attempts > 0", "'REPLY'"), ("VERIFY", "generation_attempts > 0", "CASE WHEN evidence_url_verification_passed THEN 'PASSED' ELSE 'FAILED' END"), ("FINAL", "true", "coalesce(final_action, '-')")]


@query("SELECT example_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {w} THEN '{n}=' || {a} END" for n, w, a in _STEPS) + "], lambda x: x IS NOT NULL), ' > ') AS trace FROM agent_evaluation")
def trace_stages(spark, sf):
    """The steps a record went through, in order, with what each did."""
    steps = E.trace([(F.expr(w), E.step(n, F.expr(a))) for n, w, a in _STEPS])
    return _eval(spark, sf).select("example_id", F.array_join(F.transform(steps, lambda s: F.concat(s["step"], F.lit("="), s["action"])), " > ").alias("trace"))


_RESPONSE = {"example_id": "example_id", "intent": "pred_intent", "action": "final_action", "attempts": "retrieval_attempts", "sufficiency": "CASE WHEN retrieval_attempts > 0 THEN final_sufficiency END", "verified": "CASE WHEN verified_reply_text IS NOT NULL THEN evidence_url_verification_passed END"}


@query("SELECT example_id, to_json({" + ", ".join(f"'{k}': {e}" for k, e in _RESPONSE.items()) + "})::VARCHAR AS response FROM agent_evaluation WHERE isfinite(coalesce(final_top_similarity, 0)) AND isfinite(coalesce(latency_ms, 0))")
def serialized_responses(spark, sf):
    """One closed JSON object a record: nulls are written out, similarity and verification are null where nothing was done, and what is not finite is refused."""
    rows = E.serialized(_eval(spark, sf), {**{k: F.expr(e) for k, e in _RESPONSE.items()}, "similarity": F.col("final_top_similarity"), "latency": F.col("latency_ms")})
    rows = rows.filter("error is null")
    return E.serialized(rows.drop("response", "error"), {k: F.expr(e) for k, e in _RESPONSE.items()}).select("example_id", "response")


# ---- evaluation diagnostics
_ROUTES = """WITH c AS (SELECT count(*) AS n, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM (SELECT gold_action <> 'AUTO_HANDLE' AS g, final_action <> 'AUTO_HANDLE' AS p FROM agent_evaluation WHERE gold_action IS NOT NULL AND final_action IS NOT NULL)),
r AS (SELECT *, tp / greatest(tp + fp, 1) AS ep, tp / greatest(tp + fn, 1) AS er, tn / greatest(tn + fn, 1) AS ap, tn / greatest(tn + fp, 1) AS ar FROM c),
f AS (SELECT *, CASE WHEN ep + er > 0 THEN 2 * ep * er / (ep + er) ELSE 0.0 END AS ef, CASE WHEN ap + ar > 0 THEN 2 * ap * ar / (ap + ar) ELSE 0.0 END AS af FROM r),
m AS (SELECT round((tp + tn) / greatest(n, 1), 4) AS accuracy, round(ep, 4) AS escalate_precision, round(er, 4) AS escalate_recall, round(ef, 4) AS escalate_f1, round(ap, 4) AS auto_precision, round(ar, 4) AS auto_recall, round(af, 4) AS auto_f1, round((ef + af) / 2, 4) AS macro_f1, round(fn / greatest(tp + fn, 1), 4) AS under_escalation, round(fp / greatest(fp + tn, 1), 4) AS false_escalation, round((tp + fp) / greatest(n, 1), 4) AS escalation_rate FROM f)"""


def _routes(spark, sf):
    """Both sides of the binary route. Everything but AUTO_HANDLE counts as escalated, in gold and prediction alike."""
    rows = _eval(spark, sf).filter("gold_action is not null and final_action is not null")
    g, p = F.col("gold_action") != "AUTO_HANDLE", F.col("final_action") != "AUTO_HANDLE"
    c = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    share = lambda a, b: F.expr(f"({a}) / greatest({b}, 1)")
    r = c.withColumns({"ep": share("tp", "tp + fp"), "er": share("tp", "tp + fn"), "ap": share("tn", "tn + fn"), "ar": share("tn", "fp + tn")})
    f1 = lambda a, b: F.when(F.col(a) + F.col(b) > 0, 2 * F.col(a) * F.col(b) / (F.col(a) + F.col(b))).otherwise(0.0)
    r = r.withColumns({"ef": f1("ep", "er"), "af": f1("ap", "ar")})
    out = {"accuracy": share("tp + tn", "n"), "escalate_precision": F.col("ep"), "escalate_recall": F.col("er"), "escalate_f1": F.col("ef"), "auto_precision": F.col("ap"), "auto_recall": F.col("ar"), "auto_f1": F.col("af"), "macro_f1": (F.col("ef") + F.col("af")) / 2, "under_escalation": share("fn", "tp + fn"), "false_escalation": share("fp", "fp + tn"), "escalation_rate": share("tp + fp", "n")}
    return r.select(*[F.round(x, 4).alias(k) for k, x in out.items()])


@query(_ROUTES + " SELECT * FROM m")
def routing_both_classes(spark, sf):
    return _routes(spark, sf)


_BASE = {"accuracy": 0.70, "macro_f1": 0.45, "under_escalation": 0.05, "false_escalation": 0.9}


@query(_ROUTES + " " + " UNION ALL ".join(f"SELECT '{k}' AS metric, round({k} - {v}, 4) AS delta FROM m" for k, v in _BASE.items()))
def baseline_deltas(spark, sf):
    """What the routes gain over given figures of a baseline."""
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.round(F.col(k) - F.lit(v), 4).alias("delta")) for k, v in _BASE.items()])
    return _routes(spark, sf).select(F.explode(rows).alias("x")).select("x.*")


@query("SELECT example_id, final_action, effective_binary_action, early_exit_step FROM agent_evaluation WHERE gold_risk = 'critical' AND effective_binary_action IS DISTINCT FROM 'ESCALATE'")
def missed_critical(spark, sf):
    return _eval(spark, sf).filter("gold_risk = 'critical' and not (effective_binary_action <=> 'ESCALATE')").select("example_id", "final_action", "effective_binary_action", "early_exit_step")


@query("SELECT gold_risk, pred_risk_level, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY gold_risk), 4) AS share FROM agent_evaluation GROUP BY 1, 2")
def risk_confusion(spark, sf):
    per = _eval(spark, sf).groupBy("gold_risk", "pred_risk_level").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("gold_risk")), 4))  # a row per pair of levels


_SLICES = {"all": "true", "specific": "gold_intent <> 'other_unclear'", "confident": "coalesce(intent_confidence, 0) >= 0.5", "unclear": "gold_intent = 'other_unclear'"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS slice, count(*) AS n, coalesce(round(count(*) FILTER (pred_intent = gold_intent) / nullif(count(*), 0), 4), 0.0) AS accuracy, coalesce(round(count(*) FILTER (pred_intent <> 'other_unclear') / nullif(count(*), 0), 4), 0.0) AS coverage FROM agent_evaluation WHERE {w}" for k, w in _SLICES.items()))
def intent_diagnostics(spark, sf):
    """Accuracy and coverage of all records, those of a specific intent, the confident and the unclear ones; one pass."""
    e, parts = _eval(spark, sf), []
    for k, w in _SLICES.items():
        hit = F.coalesce(F.expr(w), F.lit(False))
        parts.append((k, hit))
    counts = e.agg(*[x for k, hit in parts for x in (F.count_if(hit).alias(f"{k}_n"), F.count_if(hit & (F.col("pred_intent") == F.col("gold_intent"))).alias(f"{k}_r"), F.count_if(hit & (F.col("pred_intent") != "other_unclear")).alias(f"{k}_c"))])
    rows = F.array(*[F.struct(F.lit(k).alias("slice"), F.col(f"{k}_n").alias("n"), metrics.ratio(F.col(f"{k}_r"), F.col(f"{k}_n")).alias("accuracy"), metrics.ratio(F.col(f"{k}_c"), F.col(f"{k}_n")).alias("coverage")) for k, _ in parts])
    return counts.select(F.explode(rows).alias("x")).select("x.*")


_K = """u AS (SELECT gold_intent AS g, pred_intent AS p FROM agent_evaluation WHERE gold_intent IS NOT NULL AND pred_intent IS NOT NULL),
k AS (SELECT class, count(*) FILTER (side = 'g') AS support, count(*) FILTER (side = 'p') AS predicted, count(*) FILTER (side = 'g' AND hit) AS tp FROM (SELECT g AS class, 'g' AS side, g = p AS hit FROM u UNION ALL SELECT p, 'p', g = p FROM u) GROUP BY 1),
f AS (SELECT *, CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (predicted + support) END AS f1 FROM k)"""
_SETS = {"gold or predicted": "true", "gold": "support > 0", "predicted": "predicted > 0", "specific gold": "support > 0 AND class <> 'other_unclear'"}


@query(f"WITH {_K} " + " UNION ALL ".join(f"SELECT '{k}' AS class_set, count(*) AS classes, coalesce(round(avg(f1), 4), 0.0) AS macro_f1, coalesce(round(sum(f1 * support) / nullif(sum(support), 0), 4), 0.0) AS weighted_f1 FROM f WHERE {w}" for k, w in _SETS.items()))
def macro_by_class_set(spark, sf):
    """Averages over four sets of classes: those met on either side, in gold, in predictions, and the specific ones of gold."""
    c = metrics.per_class(_eval(spark, sf), "gold_intent", "pred_intent")
    out = None
    for k, w in _SETS.items():
        part = c.filter(w).agg(F.lit(k).alias("class_set"), F.count(F.lit(1)).alias("classes"), F.coalesce(F.round(F.avg("_f1"), 4), F.lit(0.0)).alias("macro_f1"), F.coalesce(F.round(F.sum(F.col("_f1") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0)), 4), F.lit(0.0)).alias("weighted_f1"))
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH c AS (SELECT gold_intent AS class FROM agent_evaluation WHERE gold_intent IS NOT NULL UNION SELECT pred_intent FROM agent_evaluation WHERE pred_intent IS NOT NULL) SELECT a.class AS gold, b.class AS pred, count(e.example_id) AS n FROM c a CROSS JOIN c b LEFT JOIN agent_evaluation e ON e.gold_intent = a.class AND e.pred_intent = b.class GROUP BY 1, 2")
def confusion_dense(spark, sf):
    """Every pair of classes, also those never met: the classes of each row are spread from one array, without a cross join."""
    e = _eval(spark, sf)
    met = metrics.confusion(e.filter("gold_intent is not null and pred_intent is not null"), "gold_intent", "pred_intent")
    names = e.select(F.explode(F.array("gold_intent", "pred_intent")).alias("c")).filter("c is not null").agg(F.array_sort(F.collect_set("c")).alias("classes"))  # the classes, a handful
    grid = names.select("classes", F.explode("classes").alias("gold")).select("gold", F.explode("classes").alias("pred"))
    return grid.join(met, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


_THRESHOLDS = [-1.0, 0.2, 0.25, 0.3, 0.4, 0.5]


@query(f"""WITH t AS (SELECT unnest({_THRESHOLDS})::DOUBLE AS t), u AS (SELECT t, gold_intent AS g, CASE WHEN intent_confidence < t THEN 'other_unclear' ELSE pred_intent END AS p FROM agent_evaluation, t WHERE gold_intent IS NOT NULL AND pred_intent IS NOT NULL),
k AS (SELECT t, class, count(*) FILTER (side = 'g') AS s, count(*) FILTER (side = 'p') AS d, count(*) FILTER (side = 'g' AND hit) AS tp FROM (SELECT t, g AS class, 'g' AS side, g = p AS hit FROM u UNION ALL SELECT t, p, 'p', g = p FROM u) GROUP BY 1, 2),
f AS (SELECT *, tp / greatest(d, 1) AS pr, tp / greatest(s, 1) AS re, CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (s + d) END AS f1 FROM k)
SELECT t AS threshold, round(avg(pr), 4) AS macro_precision, round(avg(re), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1, coalesce(round(max(pr) FILTER (class = 'other_unclear'), 4), 0.0) AS unclear_precision, coalesce(round(max(re) FILTER (class = 'other_unclear'), 4), 0.0) AS unclear_recall, coalesce(round(max(f1) FILTER (class = 'other_unclear'), 4), 0.0) AS unclear_f1, (SELECT count(*) FROM u WHERE u.t = f.t AND u.p = 'other_unclear') AS abstained FROM f GROUP BY 1""")
def abstention_sweep_classes(spark, sf):
    """Macro figures and those of the unclear class at each threshold; -1 is no threshold at all."""
    rows = _eval(spark, sf).filter("gold_intent is not null and pred_intent is not null")
    each = F.explode(F.array(*[F.lit(t) for t in _THRESHOLDS])).alias("threshold")
    u = rows.select(each, F.col("gold_intent").alias("g"), "pred_intent", "intent_confidence").withColumn("p", F.when(F.col("intent_confidence") < F.col("threshold"), "other_unclear").otherwise(F.col("pred_intent")))
    pairs = u.groupBy("threshold", "g", "p").agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select("threshold", "n", (F.col("g") == F.col("p")).alias("hit"), F.explode(F.array(F.struct(F.col("g").alias("class"), F.lit(1).alias("gold")), F.struct(F.col("p").alias("class"), F.lit(0).alias("gold")))).alias("x"))
    k = sides.groupBy("threshold", "x.class").agg(F.sum(F.col("x.gold") * F.col("n")).alias("s"), F.sum((1 - F.col("x.gold")) * F.col("n")).alias("d"), F.sum(F.when(F.col("hit"), F.col("x.gold") * F.col("n")).otherwise(0)).alias("tp"))
    f = k.withColumns({"pr": F.col("tp") / F.greatest("d", F.lit(1)), "re": F.col("tp") / F.greatest("s", F.lit(1)), "f1": F.when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (F.col("s") + F.col("d")))})
    of = lambda c: F.coalesce(F.round(F.max(F.when(F.col("class") == "other_unclear", F.col(c))), 4), F.lit(0.0))
    return f.groupBy("threshold").agg(F.round(F.avg("pr"), 4).alias("macro_precision"), F.round(F.avg("re"), 4).alias("macro_recall"), F.round(F.avg("f1"), 4).alias("macro_f1"), of("pr").alias("unclear_precision"), of("re").alias("unclear_recall"), of("f1").alias("unclear_f1"), F.coalesce(F.max(F.when(F.col("class") == "other_unclear", F.col("d"))), F.lit(0)).alias("abstained"))


_ACTIONS = ["AUTO_HANDLE", "ASK_CLARIFICATION", "ESCALATE"]


@query(f"SELECT a AS action, count(e.example_id) AS n, coalesce(round(count(e.example_id) / nullif((SELECT count(*) FROM agent_evaluation), 0), 4), 0.0) AS share FROM (SELECT unnest({_ACTIONS}) AS a) LEFT JOIN agent_evaluation e ON e.final_action = a GROUP BY 1")
def action_shares(spark, sf):
    """All three actions, those never taken with 0."""
    c = _eval(spark, sf).agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("final_action") == a).alias(a) for a in _ACTIONS])
    return c.select(F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.col(a).alias("n"), metrics.ratio(F.col(a), F.col("all")).alias("share")) for a in _ACTIONS])).alias("x")).select("x.*")


_BINARY = "CASE WHEN final_action = 'AUTO_HANDLE' THEN 'AUTO_HANDLE' ELSE 'ESCALATE' END"


@query(f"SELECT example_id, {_BINARY} AS binary_action, {_BINARY} = effective_binary_action AS as_stored, CASE WHEN gold_action <> 'AUTO_HANDLE' AND {_BINARY} = 'AUTO_HANDLE' THEN 'under' WHEN gold_action = 'AUTO_HANDLE' AND {_BINARY} = 'ESCALATE' THEN 'false' END AS error FROM agent_evaluation WHERE final_action IS NOT NULL")
def routing_errors(spark, sf):
    """The binary route derived from the action, and which records are escalated too little or for nothing."""
    b = F.when(F.col("final_action") == "AUTO_HANDLE", "AUTO_HANDLE").otherwise("ESCALATE")
    rows = _eval(spark, sf).filter("final_action is not null").withColumn("b", b)
    auto = F.col("gold_action") == "AUTO_HANDLE"
    return rows.select("example_id", F.col("b").alias("binary_action"), (F.col("b") == F.col("effective_binary_action")).alias("as_stored"), F.when(~auto & (F.col("b") == "AUTO_HANDLE"), "under").when(auto & (F.col("b") == "ESCALATE"), "false").alias("error"))


@query(" UNION ALL ".join(f"SELECT '{s}' AS stage, coalesce({s}_sufficiency, 'unknown') AS state, count(*) AS n, round(count(*) / (SELECT count(*) FROM agent_evaluation), 4) AS share FROM agent_evaluation GROUP BY 2" for s in ("initial", "final")))
def sufficiency_distribution(spark, sf):
    e = _eval(spark, sf)
    long = e.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.coalesce(f"{s}_sufficiency", F.lit("unknown")).alias("state")) for s in ("initial", "final")])).alias("x")).select("x.*")
    from pyspark.sql import Window

    return long.groupBy("stage", "state").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("stage")), 4))  # a row per state


@query("SELECT pred_intent, count(*) AS n, round(avg(intent_confidence), 4) AS mean_confidence, count(*) FILTER (intent_confidence < 0.5) AS below_half, count(*) FILTER (intent_confidence < 0.7) AS below_07, count(*) FILTER (intent_confidence >= 0.7) AS from_07 FROM agent_evaluation WHERE gold_intent = 'other_unclear' GROUP BY GROUPING SETS ((pred_intent), ())")
def unclear_diagnostics(spark, sf):
    """What is predicted for unclear messages, and how surely; the row without an intent is all of them."""
    c = F.col("intent_confidence")
    rows = _eval(spark, sf).filter("gold_intent = 'other_unclear'").withColumn("pred_intent", F.col("pred_intent"))
    agg = [F.count(F.lit(1)).alias("n"), F.round(F.avg(c), 4).alias("mean_confidence"), F.count_if(c < 0.5).alias("below_half"), F.count_if(c < 0.7).alias("below_07"), F.count_if(c >= 0.7).alias("from_07")]
    return rows.groupBy("pred_intent").agg(*agg).unionByName(rows.agg(F.lit(None).cast("string").alias("pred_intent"), *agg))


@query("WITH m AS (SELECT gold_intent AS c FROM agent_evaluation WHERE gold_intent IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), s AS (SELECT count(*) AS n, count(*) FILTER (gold_intent = c) AS hit, count(DISTINCT gold_intent) AS classes FROM agent_evaluation, m WHERE gold_intent IS NOT NULL) SELECT round(hit / n, 4) AS accuracy, round(2 * hit / (n + hit) / classes, 4) AS macro_f1, round(2 * hit / (n + hit) * hit / n, 4) AS weighted_f1 FROM s")
def majority_figures(spark, sf):
    """What predicting the most frequent intent for all records would reach."""
    per = _eval(spark, sf).filter("gold_intent is not null").groupBy("gold_intent").agg(F.count(F.lit(1)).alias("c"))
    s = per.agg(F.sum("c").alias("n"), F.max("c").alias("hit"), F.count(F.lit(1)).alias("classes"))
    f = 2 * F.col("hit") / (F.col("n") + F.col("hit"))
    return s.select(F.round(F.col("hit") / F.col("n"), 4).alias("accuracy"), F.round(f / F.col("classes"), 4).alias("macro_f1"), F.round(f * F.col("hit") / F.col("n"), 4).alias("weighted_f1"))


@query("SELECT t AS threshold, count(*) AS messages, count(*) FILTER (pred_intent <> 'other_unclear' AND intent_confidence >= t) AS retained, count(*) FILTER (pred_intent = 'other_unclear') AS unclear, count(*) FILTER (pred_intent <> 'other_unclear' AND intent_confidence < t) AS unsure, round(count(*) FILTER (pred_intent <> 'other_unclear' AND intent_confidence >= t) / count(*) * 100, 2) AS retained_pct FROM agent_evaluation, (SELECT unnest([0.7, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS t) GROUP BY 1")
def silver_build_stats(spark, sf):
    """What a training set keeps at each confidence, and why the rest is left out; each row is read once."""
    c, clear = F.col("intent_confidence"), F.col("pred_intent") != "other_unclear"
    rows = _eval(spark, sf).select("pred_intent", "intent_confidence", F.explode(F.array(*[F.lit(t) for t in (0.7, 0.8, 0.85, 0.9, 0.95)])).alias("threshold"))
    t = F.col("threshold")
    return rows.groupBy("threshold").agg(F.count(F.lit(1)).alias("messages"), F.count_if(clear & (c >= t)).alias("retained"), F.count_if(~clear).alias("unclear"), F.count_if(clear & (c < t)).alias("unsure"), F.round(F.count_if(clear & (c >= t)) / F.count(F.lit(1)) * 100, 2).alias("retained_pct"))


@query("SELECT CASE WHEN gold_intent = 'other_unclear' THEN 'unclear' ELSE 'specific' END AS part, count(*) AS n, count(DISTINCT gold_intent) AS intents FROM agent_evaluation WHERE gold_intent IS NOT NULL GROUP BY 1")
def golden_partition(spark, sf):
    return _eval(spark, sf).filter("gold_intent is not null").groupBy(F.when(F.col("gold_intent") == "other_unclear", "unclear").otherwise("specific").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gold_intent").alias("intents"))


@query("SELECT e.example_id, length(e.customer_message) % 7 AS score, e.gold_intent, e.gold_action FROM agent_evaluation e WHERE e.customer_message IS NOT NULL")
def gold_attached(spark, sf):
    """Gold labels meet the results after scoring, by the example's id; the scoring input is checked to hold none."""
    from supportlens.sources.files import forbid

    asked = _eval(spark, sf).select("example_id", "customer_message").filter("customer_message is not null")
    forbid(asked, judging.GOLD)
    scored = asked.select("example_id", (F.length("customer_message") % 7).cast("long").alias("score"))
    return scored.join(_eval(spark, sf).select("example_id", "gold_intent", "gold_action"), "example_id").select("example_id", "score", "gold_intent", "gold_action")


# ---- judging
@query(f"SELECT example_id, customer_message, raw_reply_text AS reply FROM agent_evaluation WHERE {sql_strip('raw_reply_text')} <> ''")
def judge_units(spark, sf):
    return judging.units(_eval(spark, sf)).select("example_id", "customer_message", F.col("raw_reply_text").alias("reply"))


@query(f"SELECT example_id, concat_ws(chr(10), 'message: ' || coalesce(customer_message, ''), 'intent: ' || coalesce(pred_intent, '-') || ' (' || CASE WHEN intent_confidence IS NULL THEN 'unknown' ELSE printf('%.4f', intent_confidence) END || ')', 'evidence:', 'none', 'reply: ' || coalesce(raw_reply_text, '')) AS prompt FROM agent_evaluation WHERE {sql_strip('raw_reply_text')} <> ''")
def judge_prompts(spark, sf):
    none = F.array().cast("array<struct<evidence_id: string, similarity: double, problem: string, resolution: string>>")
    u = judging.units(_eval(spark, sf))
    return u.select("example_id", judging.prompt(F.col("customer_message"), F.col("pred_intent"), F.col("intent_confidence"), none, F.col("raw_reply_text")).alias("prompt"))


_MOCK = {"groundedness": "CASE WHEN contains(raw_reply_text, 'http') THEN 5 ELSE 4 END", "correctness": "5", "relevance": "5", "helpfulness": "4", "tone": "5"}
_REPLIES = f"FROM agent_evaluation WHERE {sql_strip('raw_reply_text')} <> ''"


@query(f"WITH g AS (SELECT example_id, {', '.join(f'{e} AS {d}' for d, e in _MOCK.items())} {_REPLIES}) SELECT example_id, {', '.join(_MOCK)}, round(({' + '.join(_MOCK)}) / 5, 4) AS mean FROM g")
def mock_judge(spark, sf):
    """The stand-in's answers as JSON in fences, read back by the validator."""
    marks = judging.mock(F.col("raw_reply_text"))
    said = F.concat(F.lit("```json\n"), F.to_json(F.struct(*[m.alias(d) for d, m in marks.items()])), F.lit("\n```"))
    return judging.validated(judging.units(_eval(spark, sf)).withColumn("answer", said), "answer").filter("error is null").select("example_id", *judging.DIMENSIONS, "mean")


@query(f"WITH g AS (SELECT {', '.join(f'{e} AS {d}' for d, e in _MOCK.items())} {_REPLIES}) " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, count(*) AS n, round(avg({d}), 4) AS mean, count(*) FILTER ({d} = 5) AS fives, round(count(*) FILTER ({d} = 5) / greatest(count(*), 1), 4) AS share FROM g" for d in _MOCK))
def judge_dimensions(spark, sf):
    """All five dimensions in one pass."""
    marks = judging.mock(F.col("raw_reply_text"))
    long = judging.units(_eval(spark, sf)).select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), m.alias("s")) for d, m in marks.items()])).alias("x")).select("x.*")
    five = F.count_if(F.col("s") == 5)
    return long.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 4).alias("mean"), five.alias("fives"), F.round(five / F.count(F.lit(1)), 4).alias("share"))


_TYPED = "CASE length(customer_message) % 4 WHEN 0 THEN '3' WHEN 1 THEN 'true' WHEN 2 THEN '6' ELSE '5' END"


@query(f"SELECT example_id, CASE WHEN tweet_id IS NULL THEN 'unknown example' WHEN length(customer_message) % 11 = 0 THEN 'extra field' WHEN {_TYPED} NOT IN ('1', '2', '3', '4', '5') THEN 'not an integer from 1 to 5' END AS error FROM agent_evaluation WHERE customer_message IS NOT NULL")
def rating_validation(spark, sf):
    """Ratings as typed: booleans and 6 are refused, and so are unknown examples and extra fields."""
    n = F.length("customer_message")
    typed = F.when(n % 4 == 0, "3").when(n % 4 == 1, "true").when(n % 4 == 2, "6").otherwise("5")
    rating = F.create_map(*[x for d in judging.DIMENSIONS for x in (F.lit(d), typed if d == "tone" else F.lit("4"))])
    return _eval(spark, sf).filter("customer_message is not null").select("example_id", judging.rating_error(rating, F.col("tweet_id").isNotNull(), n % 11 == 0).alias("error"))


@query("WITH j AS (SELECT example_id, 1 + length(raw_reply_text) % 5 AS s FROM agent_evaluation WHERE raw_reply_text IS NOT NULL), h AS (SELECT example_id, 1 + length(customer_message) % 5 AS s FROM agent_evaluation WHERE tweet_id IS NOT NULL AND customer_message IS NOT NULL), b AS (SELECT j.s AS a, h.s AS b FROM j JOIN h USING (example_id)), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM b) SELECT count(*) AS n, round(corr(ra, rb), 4) AS spearman FROM r")
def judge_human_overlap(spark, sf):
    """Examples that both a judge and a human marked, with the rank correlation; ranks of the five marks come from their counts."""
    e = _eval(spark, sf)
    j = e.filter("raw_reply_text is not null").select("example_id", (1 + F.length("raw_reply_text") % 5).alias("a"))
    h = e.filter("tweet_id is not null and customer_message is not null").select("example_id", (1 + F.length("customer_message") % 5).alias("b"))
    from pyspark.sql import Window

    both = j.join(h, "example_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))  # at most 25 rows from here on
    rank = lambda c: F.sum("n").over(Window.orderBy(c).rangeBetween(Window.unboundedPreceding, -1))
    same = lambda c: F.sum("n").over(Window.partitionBy(c))
    r = both.select("n", *[(F.coalesce(rank(c), F.lit(0)) + (same(c) + 1) / 2).alias(f"r{c}") for c in "ab"])
    s = r.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(x)).alias(k) for k, x in (("x", "ra"), ("y", "rb"))], F.sum(F.col("n") * F.col("ra") * F.col("rb")).alias("xy"), F.sum(F.col("n") * F.col("ra") ** 2).alias("xx"), F.sum(F.col("n") * F.col("rb") ** 2).alias("yy"))
    n = F.col("n")
    value = (n * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt((n * F.col("xx") - F.col("x") ** 2) * (n * F.col("yy") - F.col("y") ** 2))
    return s.select("n", F.round(value, 4).alias("spearman"))


# ---- samples and splits
@query("SELECT tweet_id, line_no, author_id FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY line_no) AS r FROM twcs WHERE tweet_id IS NOT NULL) WHERE r = 1")
def first_seen_messages(spark, sf):
    return splits.first_seen(table(spark, sf, "twcs").select("tweet_id", "line_no", "author_id"), "tweet_id", "line_no")


_BLEND = "SELECT example_id, gold_intent FROM agent_evaluation WHERE gold_intent <> 'other_unclear' UNION ALL (SELECT example_id, gold_intent FROM agent_evaluation WHERE gold_intent = 'other_unclear' ORDER BY md5('42:' || example_id), example_id LIMIT (SELECT (count(*) * 10 // 100)::BIGINT FROM agent_evaluation WHERE gold_intent = 'other_unclear'))"


@query(_BLEND)
def dev_blend(spark, sf):
    return splits.blend(_eval(spark, sf).select("example_id", "gold_intent"), "gold_intent", "example_id")


@query("SELECT e.example_id FROM agent_evaluation e WHERE e.intent_confidence >= 0.8 AND e.pred_intent <> 'other_unclear' AND lower(trim(e.conversation_id)) IN (SELECT lower(trim(conversation_id)) FROM split_manifest WHERE lower(trim(split)) IN ('dev', 'golden')) ORDER BY 1 LIMIT 1000")
def dev_queries(spark, sf):
    """The first 1,000 confident messages of held-out conversations, in order of id: the queries of a retrieval test."""
    m = table(spark, sf, "split_manifest").filter(F.lower(F.trim("split")).isin("dev", "golden")).select(F.lower(F.trim("conversation_id")).alias("k"))
    rows = _eval(spark, sf).filter("intent_confidence >= 0.8 and pred_intent <> 'other_unclear'").withColumn("k", F.lower(F.trim("conversation_id")))
    return splits.first_n(rows.join(m, "k", "left_semi").select("example_id"), "example_id", 1000)


@query("WITH g AS (SELECT DISTINCT lower(trim(conversation_id)) AS id FROM split_manifest WHERE lower(trim(split)) = 'golden'), i AS (SELECT DISTINCT lower(trim(conversation_id)) AS id FROM split_manifest WHERE conversation_id IS NOT NULL), x AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) AS r, count(*) OVER () AS n FROM i WHERE id NOT IN (SELECT id FROM g)) SELECT id, CASE WHEN r <= round_even(n * 0.7, 0) THEN 'train' WHEN r <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'dev' ELSE 'test' END AS split FROM x")
def split_without_golden(spark, sf):
    """All conversations but the golden ones in three splits; the rules are checked before the result is given out."""
    m = table(spark, sf, "split_manifest").filter("conversation_id is not null").select(F.lower(F.trim("conversation_id")).alias("id"), F.lower(F.trim("split")).alias("s"))
    golden, ids = m.filter("s = 'golden'").select("id"), m.select("id")
    return splits.assign(ids, "id", golden=golden)
