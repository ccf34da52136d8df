"""Queries over rules, TF-IDF retrieval, evaluation records, judging and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlens.functions import text as T
from supportlens.operators import classify, evidence, metrics, retrieval, rules, splits
from supportlens.plans.base import MSG, messages
from supportlens.sources.files import append_new
from supportlens.sources.tables import keep_until_exit, new_path, stage, table
from supportlens.streaming import scorer

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, msg: bool = False):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH " + MSG + sql if msg else sql
        return f

    return wrap


# ---- rules
@query(f" SELECT tweet_id, {rules.sql_first('text')} AS topic, array_to_string({rules.sql_labels('text')}, ',') AS labels FROM msg WHERE inbound AND text IS NOT NULL", msg=True)
def topic_labels(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return messages(spark, sf).filter("inbound and text is not null").select("tweet_id", rules.first_label(t).alias("topic"), F.array_join(rules.labels(t), ",").alias("labels"))


@query(f"""SELECT label, n, examples FROM (SELECT label, count(*) AS n, string_agg(tweet_id, ',' ORDER BY tweet_id) FILTER (r <= 5) AS examples FROM (SELECT label, tweet_id, row_number() OVER (PARTITION BY label ORDER BY tweet_id) AS r FROM (SELECT tweet_id, unnest({rules.sql_labels('t')}) AS label FROM (SELECT tweet_id, max(struct_pack(line_no := line_no, t := text)).t AS t FROM twcs WHERE tweet_id IS NOT NULL GROUP BY 1) WHERE t IS NOT NULL)) GROUP BY 1)""")
def topic_coverage(spark, sf):
    """Messages per label, with the five smallest ids: a limited window, which keeps five a label on the map side, twice."""
    rows = messages(spark, sf).filter("text is not null").select("tweet_id", F.explode(rules.labels(F.col("text"))).alias("label"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    best = lambda *by: F.row_number().over(retrieval.Window.partitionBy(*by).orderBy("tweet_id"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("tweet_id"), F.lit(64))).withColumn("r", best("label", "salt")).filter("r <= 5")
    few = salted.withColumn("r", best("label")).filter("r <= 5").groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tweet_id"))), lambda x: x["tweet_id"]), ",").alias("examples"))
    return counts.join(few, "label")


@query(f" SELECT tweet_id, {rules.sql_level('text')} AS level, array_to_string({rules.sql_signals('text')}, ',') AS signals FROM msg WHERE inbound AND text IS NOT NULL", msg=True)
def risk_assessment(spark, sf):
    t = F.col("text")
    return messages(spark, sf).filter("inbound and text is not null").select("tweet_id", rules.level(t).alias("level"), F.array_join(rules.signals(t), ",").alias("signals"))


@query(f" SELECT {rules.sql_first('text')} AS topic, {rules.sql_level('text')} AS level, count(*) AS n FROM msg WHERE inbound AND text IS NOT NULL GROUP BY 1, 2", msg=True)
def risk_levels(spark, sf):
    scored = scorer.score(messages(spark, sf).filter("inbound and text is not null"))
    return scored.groupBy("topic", F.col("risk").alias("level")).agg(F.count(F.lit(1)).alias("n"))


# ---- retrieval
_GRAMS = "unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT {id} AS id, regexp_extract_all(lower({text}), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1) AS w FROM {source})"


def _sql_index(id_: str, text: str, source: str) -> str:
    """c: counts of words and pairs of words; idf: the 50,000 most frequent terms of two rows or more; w: weights of length one."""
    return f"""c AS MATERIALIZED (SELECT id, term, count(*) AS n FROM (SELECT id, {_GRAMS.format(id=id_, text=text, source=source)}) GROUP BY 1, 2),
idf AS MATERIALIZED (SELECT term, ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + count(*))) + 1 AS idf, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(n) DESC, term LIMIT 50000),
r AS (SELECT id, term, (1 + ln(n)) * idf AS w FROM c JOIN idf USING (term)),
w AS MATERIALIZED (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM r)"""


_DOCS = _sql_index("doc_id", "text", "(SELECT doc_id, max(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)")


def _four(c):
    """Four digits by plain arithmetic on doubles, alike on any engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 10000 + 0.5) / 10000


def _index(spark, sf):
    docs = table(spark, sf, "documents").filter("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    return retrieval.Index.fit(docs, "doc_id", "text")


@query(f"WITH {_DOCS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def tfidf_vocabulary(spark, sf):
    """Words and pairs of words with their idf."""
    index = _index(spark, sf)
    n = float(index.settings["documents"])
    df = F.round((n + 1) / F.exp(F.col("idf") - 1) - 1).cast("long")
    return index.inverse.select("term", df.alias("df"), F.round("idf", 6).alias("idf"))


@query(f"WITH {_DOCS} SELECT id, count(*) AS terms, round(sum(weight), 4) AS total, round(max(weight), 4) AS largest FROM w GROUP BY 1")
def tfidf_weights(spark, sf):
    return _index(spark, sf).weights.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 4).alias("total"), F.round(F.max("weight"), 4).alias("largest"))


def _sql_top(only: str = "") -> str:
    """k: the documents ranked for each query. only: a condition on the id of the documents that are queries; without it all are."""
    return f""", s AS (SELECT q.id AS query_id, w.id, round(sum(q.weight * w.weight), 6) AS score FROM w q JOIN w USING (term) WHERE {f"q.{only} AND " if only else ""}q.id <> w.id GROUP BY 1, 2),
z AS (SELECT query_id, id, score FROM s UNION ALL SELECT q.id, d.doc_id, 0.0 FROM (SELECT DISTINCT id FROM w{f" WHERE {only}" if only else ""}) q, (SELECT DISTINCT doc_id FROM documents) d WHERE q.id <> d.doc_id AND NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = q.id AND s.id = d.doc_id)),
k AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM z)"""


_TOP = _sql_top("id % 20 = 0")


def _top(spark, sf, k: int, min_score: float = 0.0):
    return _index(spark, sf).search_own(F.col("id") % 20 == 0, k, min_score)


@query(f"WITH {_DOCS}{_TOP} SELECT query_id, id, floor(score * 10000 + 0.5) / 10000 AS score, rank FROM k WHERE rank <= 3")
def retrieve_topk(spark, sf):
    """The documents whose id is divisible by 20 as queries against all, without themselves."""
    return _top(spark, sf, 3).select("query_id", "id", _four("score").alias("score"), "rank")


@query(f"WITH {_DOCS}{_TOP} SELECT query_id, id, floor(score * 10000 + 0.5) / 10000 AS score, rank FROM k WHERE rank <= 5 AND score >= 0.35")
def retrieve_min_score(spark, sf):
    return _top(spark, sf, 5, 0.35).select("query_id", "id", _four("score").alias("score"), "rank")


@query(f"""WITH {_DOCS}{_sql_top()}, h AS (SELECT k.query_id, k.rank, k.score, (a.doc_kind = b.doc_kind)::INT AS hit FROM k JOIN documents a ON a.doc_id = k.query_id JOIN documents b ON b.doc_id = k.id WHERE rank <= 5),
p AS (SELECT query_id, avg(hit) FILTER (rank <= 1) AS p1, avg(hit) FILTER (rank <= 3) AS p3, avg(hit) AS p5, coalesce(max(hit / rank), 0) AS rr, max(score) AS top FROM h GROUP BY 1)
SELECT count(*) AS queries, round(avg(p1), 4) AS p_at_1, round(avg(p3), 4) AS p_at_3, round(avg(p5), 4) AS p_at_5, round(avg(rr), 4) AS mrr_at_5, round(avg(top), 4) AS mean_top FROM p""")
def retrieval_quality(spark, sf):
    """Precision at 1, 3 and 5 and reciprocal rank of every document as a query, a document of the same kind being a hit."""
    kind = table(spark, sf, "documents").filter("doc_id is not null").groupBy("doc_id").agg(F.max("doc_kind").alias("kind"))
    rows = _index(spark, sf).search_own(F.lit(True), 5).join(kind.select(F.col("doc_id").alias("query_id"), F.col("kind").alias("a")), "query_id").join(kind.select(F.col("doc_id").alias("id"), F.col("kind").alias("b")), "id").withColumn("hit", (F.col("a") == F.col("b")).cast("int"))
    per = rows.groupBy("query_id").agg(*[F.avg(F.when(F.col("rank") <= n, F.col("hit"))).alias(f"p{n}") for n in (1, 3, 5)], F.coalesce(F.max(F.col("hit") / F.col("rank")), F.lit(0.0)).alias("rr"), F.max("score").alias("top"))
    return per.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(f"p{n}"), 4).alias(f"p_at_{n}") for n in (1, 3, 5)], F.round(F.avg("rr"), 4).alias("mrr_at_5"), F.round(F.avg("top"), 4).alias("mean_top"))


_PAIRS = _sql_index("resolution_id", "customer_text", "historical_resolution")
_ASKED = "customer_message IS NOT NULL"
_SOME = f"number % 20 = 0 AND {_ASKED}"
_EV = "(SELECT example_id, customer_message, pred_intent, intent_confidence, lower(trim(conversation_id)) AS conv, regexp_extract(example_id, '([0-9]+)$', 1)::BIGINT AS number FROM agent_evaluation)"


def _sql_search(name: str, text: str, where: str, extra: str = "", asked: str = _ASKED) -> str:
    """name: the three best resolutions of other conversations for each query. asked: which messages are queries."""
    return f"""{name}_c AS (SELECT id, term, count(*) AS n FROM (SELECT id, {_GRAMS.format(id='example_id', text=text, source=f"(SELECT * FROM {_EV} WHERE {asked} AND {where})")}) GROUP BY 1, 2),
{name}_w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM (SELECT id, term, (1 + ln(n)) * idf AS w FROM {name}_c JOIN idf USING (term))),
{name}_s AS (SELECT q.id AS query_id, w.id, round(sum(q.weight * w.weight), 6) AS score FROM {name}_w q JOIN w USING (term) JOIN {_EV} e ON e.example_id = q.id JOIN historical_resolution h ON h.resolution_id = w.id WHERE lower(trim(h.conversation_id)) IS DISTINCT FROM e.conv{extra} GROUP BY 1, 2),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_s WHERE score >= 0.000001 QUALIFY rank <= 3)"""


def _searching(spark, sf, which: str = "true"):
    """The index over resolutions, the resolutions, the evaluation messages that are queries, and the pairs of one conversation."""
    h = table(spark, sf, "historical_resolution").filter("resolution_id is not null")
    conv = F.lower(F.trim("conversation_id"))
    asked = _eval(spark, sf).filter("customer_message is not null").filter(which)
    same = asked.select(F.col("example_id").alias("query_id"), conv.alias("c")).join(h.select(F.col("resolution_id").alias("id"), conv.alias("c")), "c").select("query_id", "id")
    return retrieval.Index.fit(h, "resolution_id", "customer_text", kind_col="intent"), h, asked, same


@query(f"WITH {_PAIRS}, {_sql_search('a', 'customer_message', 'true', ' AND (e.pred_intent IS NULL OR e.pred_intent = h.intent)', _SOME)} SELECT query_id, id, floor(score * 10000 + 0.5) / 10000 AS score, rank FROM a")
def retrieve_by_intent(spark, sf):
    """The three best resolutions of the predicted intent from other conversations, for the messages whose number is divisible by 20."""
    index, _, asked, same = _searching(spark, sf, "cast(regexp_extract(example_id, '([0-9]+)$', 1) as long) % 20 = 0")
    got = index.search(asked, "example_id", "customer_message", 3, 1e-6, same, "pred_intent")
    return got.select("query_id", "id", _four("score").alias("score"), "rank")


_RETRY = "score >= 0.25 AND score < 0.35 AND intent_confidence >= 0.5 AND pred_intent <> 'other_unclear'"


@query(f"""WITH {_PAIRS}, {_sql_search('a', 'customer_message', 'true')}, {_sql_search('b', "customer_message || ' ' || replace(pred_intent, '_', ' ')", f"example_id IN (SELECT query_id FROM a JOIN agent_evaluation e ON e.example_id = query_id WHERE rank = 1 AND {_RETRY})")},
e AS (SELECT example_id, coalesce(x.score, 0.0) AS s1, y.score AS s2, x.score >= 0.25 AND x.score < 0.35 AND intent_confidence >= 0.5 AND pred_intent <> 'other_unclear' AS again FROM {_EV} LEFT JOIN a x ON x.query_id = example_id AND x.rank = 1 LEFT JOIN b y ON y.query_id = example_id AND y.rank = 1 WHERE {_ASKED}),
f AS (SELECT *, coalesce(s2 > s1, false) AS adopted FROM e), i AS (SELECT query_id, 'a' AS side, string_agg(id, ',' ORDER BY rank) AS ids FROM a GROUP BY 1 UNION ALL SELECT query_id, 'b', string_agg(id, ',' ORDER BY rank) FROM b GROUP BY 1)
SELECT example_id, floor(s1 * 10000 + 0.5) / 10000 AS first_similarity, CASE WHEN s1 = 0 THEN 'empty' WHEN s1 >= 0.35 THEN 'sufficient' WHEN s1 >= 0.25 THEN 'borderline' ELSE 'insufficient' END AS state, coalesce(again, false) AS retried, adopted, floor(CASE WHEN adopted THEN s2 ELSE s1 END * 10000 + 0.5) / 10000 AS similarity, coalesce(i.ids, '') AS evidence FROM f LEFT JOIN i ON i.query_id = example_id AND i.side = CASE WHEN adopted THEN 'b' ELSE 'a' END""")
def retrieval_retry(spark, sf):
    """Evidence for every message with a bounded second search: only queries with borderline evidence and a sure, specific intent are asked again, with the intent's words."""
    index, h, asked, same = _searching(spark, sf)
    corpus = h.select(F.col("resolution_id").alias("id"), "customer_text", "brand_text", "intent")

    def search(rows, text):
        found = stage(index.search(rows, "example_id", text, 3, 1e-6, same), "found", tidy=True)
        best = found.groupBy(F.col("query_id").alias("example_id")).agg(F.max("score").alias("top"))
        shown = evidence.items(found, corpus).select(F.col("query_id").alias("example_id"), F.array_join(F.transform("evidence", lambda e: e["evidence_id"]), ",").alias("ids"))
        return best.join(shown, "example_id")

    one = asked.select("example_id", "customer_message", "pred_intent", "intent_confidence").join(search(asked, "customer_message"), "example_id", "left")
    one = stage(one.withColumn("state", evidence.sufficiency(F.col("top"), F.col("top").isNotNull())).withColumn("retried", evidence.may_retry(F.col("state"), F.col("intent_confidence"), F.col("pred_intent"))), "first-search", tidy=True)
    two = search(one.filter("retried").withColumn("more", evidence.augmented(F.col("customer_message"), F.col("pred_intent"))), "more").select("example_id", F.col("top").alias("top2"), F.col("ids").alias("ids2"))
    both = evidence.adopt(one.join(two, "example_id", "left"), "top", "top2")
    return both.select("example_id", _four(F.coalesce("top", F.lit(0.0))).alias("first_similarity"), "state", "retried", "adopted", _four("final_similarity").alias("similarity"), F.coalesce(F.when(F.col("adopted"), F.col("ids2")).otherwise(F.col("ids")), F.lit("")).alias("evidence"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT a.vec_id, a.label, b.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT count(DISTINCT vec_id) AS queries, round(avg((label = other)::INT), 4) AS p_at_5 FROM s WHERE rank <= 5""")
def embedding_neighbours(spark, sf):
    """Exact cosine neighbours of the vectors whose id is divisible by 20, in blocks of queries against all rows."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    e = e.withColumn("norm", norm(F.col("v")))
    blocks = max(8, e.count() // 20_000)  # queries per block stay the same as the table grows
    q = e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("q_id"), F.col("label").alias("q_label"), F.col("v").alias("qv"), F.col("norm").alias("qn"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    spread = e.withColumn("block", F.explode(F.array(*[F.lit(b).cast("long") for b in range(blocks)])))
    dot = F.aggregate(F.zip_with("qv", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = q.join(spread, "block").filter(F.col("q_id") != F.col("vec_id")).select("q_id", "q_label", "label", "vec_id", F.round(dot / (F.col("qn") * F.col("norm")), 6).alias("score"))
    best = rows.withColumn("rank", F.row_number().over(retrieval.Window.partitionBy("q_id").orderBy(F.desc("score"), "vec_id"))).filter("rank <= 5")
    return best.agg(F.count_distinct("q_id").alias("queries"), F.round(F.avg((F.col("label") == F.col("q_label")).cast("int")), 4).alias("p_at_5"))


# ---- evaluation records
def _eval(spark, sf):
    return table(spark, sf, "agent_evaluation")


@query("SELECT gold_intent AS gold, pred_intent AS pred, count(*) AS n FROM agent_evaluation GROUP BY 1, 2")
def confusion(spark, sf):
    return metrics.confusion(_eval(spark, sf), "gold_intent", "pred_intent")


_PRF = """u AS (SELECT gold_intent AS g, pred_intent AS p FROM agent_evaluation WHERE gold_intent IS NOT NULL AND pred_intent IS NOT NULL),
k AS (SELECT class, count(*) FILTER (side = 'g') AS support, count(*) FILTER (side = 'p') AS predicted, count(*) FILTER (side = 'g' AND hit) AS tp FROM (SELECT g AS class, 'g' AS side, g = p AS hit FROM u UNION ALL SELECT p, 'p', g = p FROM u) GROUP BY 1),
f AS (SELECT *, tp / greatest(predicted, 1) AS pr, tp / greatest(support, 1) AS re FROM k), x AS (SELECT *, CASE WHEN tp = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM f)"""


@query(f"WITH {_PRF} SELECT class, support, predicted, round(pr, 4) AS precision, round(re, 4) AS recall, round(f1, 4) AS f1 FROM x")
def per_class_prf(spark, sf):
    return metrics.per_class(_eval(spark, sf), "gold_intent", "pred_intent").drop("_f1")


@query(f"WITH {_PRF} SELECT count(*) AS classes, round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1 FROM x")
def macro_weighted(spark, sf):
    return metrics.averages(_eval(spark, sf), "gold_intent", "pred_intent")


@query("""SELECT count(*) AS n, round(avg((pred_intent = gold_intent)::INT), 4) AS accuracy, round(avg((pred_intent <> 'other_unclear')::INT), 4) AS coverage, round(count(*) FILTER (pred_intent <> 'other_unclear' AND pred_intent = gold_intent) / greatest(count(*) FILTER (pred_intent <> 'other_unclear'), 1), 4) AS covered_accuracy,
(SELECT gold_intent FROM agent_evaluation GROUP BY 1 ORDER BY count(*) DESC, gold_intent LIMIT 1) AS majority, round((SELECT max(c) FROM (SELECT count(*) AS c FROM agent_evaluation GROUP BY gold_intent)) / count(*), 4) AS majority_accuracy FROM agent_evaluation""")
def accuracy_coverage(spark, sf):
    e = _eval(spark, sf)
    right, covered = F.col("pred_intent") == F.col("gold_intent"), F.col("pred_intent") != classify.OTHER
    base = e.groupBy("gold_intent").agg(F.count(F.lit(1)).alias("c")).agg(F.min_by("gold_intent", F.struct(-F.col("c"), "gold_intent")).alias("majority"), F.max("c").alias("top"))
    one = e.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right.cast("int")), 4).alias("accuracy"), F.round(F.avg(covered.cast("int")), 4).alias("coverage"), metrics.ratio(F.count_if(right & covered), F.count_if(covered)).alias("covered_accuracy"))
    return one.withColumn("j", F.lit(1)).join(base.withColumn("j", F.lit(1)), "j").select("n", "accuracy", "coverage", "covered_accuracy", "majority", F.round(F.col("top") / F.col("n"), 4).alias("majority_accuracy"))  # one row each


@query("SELECT low, count(c) AS n, coalesce(round(avg((pred_intent = gold_intent)::INT), 4), 0.0) AS accuracy FROM (SELECT unnest([0.0, 0.25, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS low) b LEFT JOIN (SELECT *, intent_confidence AS c FROM agent_evaluation) e ON c >= low AND c < CASE low WHEN 0.0 THEN 0.25 WHEN 0.25 THEN 0.5 WHEN 0.9 THEN 1e9 ELSE round(low + 0.1, 1) END GROUP BY 1")
def confidence_buckets(spark, sf):
    return metrics.buckets(_eval(spark, sf), "intent_confidence", F.col("pred_intent") == F.col("gold_intent"), [0.0, 0.25, 0.5, 0.6, 0.7, 0.8, 0.9])


@query("""SELECT threshold, count(*) AS n, round(avg(coalesce(p = gold_intent, false)::INT), 4) AS accuracy, round(avg((p <> 'other_unclear')::INT), 4) AS coverage, coalesce(round(count(*) FILTER (p <> 'other_unclear' AND p = gold_intent) / nullif(count(*) FILTER (p <> 'other_unclear'), 0), 4), 0.0) AS covered_accuracy
FROM (SELECT t AS threshold, gold_intent, CASE WHEN intent_confidence < t THEN 'other_unclear' ELSE pred_intent END AS p FROM agent_evaluation, (SELECT unnest([0.2, 0.25, 0.3, 0.4, 0.5])::DOUBLE AS t)) GROUP BY 1""")
def abstention_sweep(spark, sf):
    return metrics.sweep(_eval(spark, sf), [0.2, 0.25, 0.3, 0.4, 0.5], "gold_intent", "pred_intent", "intent_confidence", classify.OTHER)


@query("""WITH c AS (SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM (SELECT gold_action = 'ESCALATE' AS g, effective_binary_action = 'ESCALATE' AS p FROM agent_evaluation))
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, round(tp / greatest(tp + fp, 1), 4) AS precision, round(tp / greatest(tp + fn, 1), 4) AS recall, round(fn / greatest(tp + fn, 1), 4) AS missed, round(fp / greatest(fp + tn, 1), 4) AS false_alarm FROM c""")
def binary_routing(spark, sf):
    g, p = F.col("gold_action") == "ESCALATE", F.col("effective_binary_action") == "ESCALATE"
    c = _eval(spark, sf).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", metrics.ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), metrics.ratio(tp, tp + fp).alias("precision"), metrics.ratio(tp, tp + fn).alias("recall"), metrics.ratio(fn, tp + fn).alias("missed"), metrics.ratio(fp, fp + tn).alias("false_alarm"))


@query("SELECT final_action, coalesce(target_queue, '(none)') AS queue, count(*) AS n, round(count(*) / (SELECT count(*) FROM agent_evaluation), 6) AS share FROM agent_evaluation GROUP BY 1, 2")
def action_distribution(spark, sf):
    e = _eval(spark, sf)
    return e.groupBy("final_action", F.coalesce("target_queue", F.lit("(none)")).alias("queue")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / F.lit(e.count()), 6))


@query("SELECT count(*) FILTER (gold_risk = 'critical') AS critical, count(*) FILTER (gold_risk = 'critical' AND final_action = 'ESCALATE') AS caught, coalesce(round(count(*) FILTER (gold_risk = 'critical' AND final_action = 'ESCALATE') / nullif(count(*) FILTER (gold_risk = 'critical'), 0), 4), 1.0) AS recall, count(early_exit_step) AS early_exits, count(*) FILTER (list_contains(risk_categories, 'SAFETY')) AS safety FROM agent_evaluation")
def critical_audit(spark, sf):
    c, caught = F.col("gold_risk") == "critical", F.col("final_action") == "ESCALATE"
    return _eval(spark, sf).agg(F.count_if(c).alias("critical"), F.count_if(c & caught).alias("caught"), F.when(F.count_if(c) == 0, 1.0).otherwise(F.round(F.count_if(c & caught) / F.count_if(c), 4)).alias("recall"), F.count("early_exit_step").alias("early_exits"), F.count_if(F.array_contains("risk_categories", "SAFETY")).alias("safety"))


@query("SELECT round(avg(coalesce(initial_top_similarity, 0)), 4) AS mean_first, median(coalesce(initial_top_similarity, 0)) AS median_first, round(avg(coalesce(final_top_similarity, 0)), 4) AS mean_final, count(*) FILTER (retrieval_retry_triggered) AS triggered, count(*) FILTER (retrieval_retry_adopted) AS adopted, count(*) FILTER (initial_sufficiency = 'borderline' AND final_sufficiency = 'sufficient') AS upgraded, coalesce(round(count(*) FILTER (generation_attempts > 0 AND evidence_url_verification_passed) / nullif(count(*) FILTER (generation_attempts > 0), 0), 4), 1.0) AS cited FROM agent_evaluation")
def retrieval_dynamics(spark, sf):
    a, b, made = F.coalesce("initial_top_similarity", F.lit(0.0)), F.coalesce("final_top_similarity", F.lit(0.0)), F.col("generation_attempts") > 0
    return _eval(spark, sf).agg(F.round(F.avg(a), 4).alias("mean_first"), F.median(a).alias("median_first"), F.round(F.avg(b), 4).alias("mean_final"), F.count_if("retrieval_retry_triggered").alias("triggered"), F.count_if("retrieval_retry_adopted").alias("adopted"), F.count_if((F.col("initial_sufficiency") == "borderline") & (F.col("final_sufficiency") == "sufficient")).alias("upgraded"), F.when(F.count_if(made) == 0, 1.0).otherwise(F.round(F.count_if(made & F.col("evidence_url_verification_passed")) / F.count_if(made), 4)).alias("cited"))


_GRADE = {"groundedness": "CASE WHEN raw_reply_text LIKE '%http%' THEN 5 ELSE 4 END", "relevance": "1 + length(raw_reply_text) % 5", "tone": "1 + (length(raw_reply_text) * 7) % 5"}


@query(" UNION ALL ".join(f"SELECT '{d}' AS dimension, count(*) AS n, round(avg(s), 4) AS mean, list_sort(list(s))[count(*) // 2 + 1]::BIGINT AS upper_median, count(*) FILTER (s = 5) AS fives FROM (SELECT {e} AS s FROM agent_evaluation WHERE raw_reply_text IS NOT NULL)" for d, e in _GRADE.items()))
def judge_aggregates(spark, sf):
    """Mean, upper median and share of top marks per dimension of a deterministic mock judge. The median comes from the five counts."""
    n = F.length("raw_reply_text")
    marks = {"groundedness": F.when(F.col("raw_reply_text").contains("http"), 5).otherwise(4), "relevance": 1 + n % 5, "tone": 1 + (n * 7) % 5}
    long = _eval(spark, sf).filter("raw_reply_text is not null").select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), m.alias("s")) for d, m in marks.items()])).alias("x")).select("x.*")
    per = long.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 4).alias("mean"), *[F.count_if(F.col("s") == k).alias(f"c{k}") for k in range(1, 6)])
    upto = [sum((F.col(f"c{j}") for j in range(1, k + 1)), F.lit(0)) for k in range(1, 6)]
    median = F.coalesce(*[F.when(u > F.expr("n div 2"), F.lit(k)) for k, u in enumerate(upto, 1)])
    return per.select("dimension", "n", "mean", median.cast("long").alias("upper_median"), F.col("c5").alias("fives"))


@query("""WITH r AS (SELECT CASE WHEN final_top_similarity >= 0.35 THEN 3 WHEN final_top_similarity >= 0.25 THEN 2 ELSE 1 END AS a, CASE WHEN intent_confidence >= 0.7 THEN 3 WHEN intent_confidence >= 0.4 THEN 2 ELSE 1 END AS b FROM agent_evaluation WHERE final_top_similarity IS NOT NULL AND intent_confidence IS NOT NULL),
o AS (SELECT sum((a - b) * (a - b)) AS d, count(*) AS n, avg(abs(a - b)) AS mae, corr(a, b) AS r FROM r), e AS (SELECT sum((x.a - y.b) * (x.a - y.b) * x.n * y.n) AS d FROM (SELECT a, count(*) AS n FROM r GROUP BY 1) x, (SELECT b, count(*) AS n FROM r GROUP BY 1) y)
SELECT o.n, round(1 - o.d * o.n / e.d, 4) AS weighted_kappa, round(o.mae, 4) AS mae, round(o.r, 4) AS pearson FROM o, e""")
def agreement_kappa(spark, sf):
    """Quadratically weighted kappa, mean absolute error and correlation of two deterministic raters."""
    rate = lambda c, hi, lo: F.when(F.col(c) >= hi, 3).when(F.col(c) >= lo, 2).otherwise(1)
    r = _eval(spark, sf).filter("final_top_similarity is not null and intent_confidence is not null").select(rate("final_top_similarity", 0.35, 0.25).alias("a"), rate("intent_confidence", 0.7, 0.4).alias("b"))
    counts = r.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("a") - F.col("b")) ** 2).alias("d"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"), F.corr("a", "b").alias("r"), *[F.count_if(F.col(s) == k).alias(f"{s}{k}") for s in "ab" for k in (1, 2, 3)])
    expected = sum((F.lit((i - j) ** 2) * F.col(f"a{i}") * F.col(f"b{j}") for i in (1, 2, 3) for j in (1, 2, 3)), F.lit(0))
    return counts.select("n", F.round(1 - F.col("d") * F.col("n") / expected, 4).alias("weighted_kappa"), F.round("mae", 4).alias("mae"), F.round("r", 4).alias("pearson"))


@query("SELECT example_id FROM agent_evaluation WHERE raw_reply_text IS NOT NULL AND NOT (final_top_similarity >= 0.3 AND evidence_url_verification_passed)")
def judge_resume(spark, sf):
    """What a second run of a judge has still to do: only finished units are skipped."""
    units = _eval(spark, sf).filter("raw_reply_text is not null")
    done = units.withColumn("status", F.when((F.col("final_top_similarity") >= 0.3) & F.col("evidence_url_verification_passed"), "SUCCESS").otherwise("FAILED"))
    return append_new(done.select("example_id", "status"), units.select("example_id"), "example_id")


@query("SELECT example_id, gold_intent, pred_intent FROM agent_evaluation WHERE gold_intent <> pred_intent OR (gold_risk = 'critical' AND final_action <> 'ESCALATE')")
def error_records(spark, sf):
    return _eval(spark, sf).filter("gold_intent <> pred_intent or (gold_risk = 'critical' and final_action <> 'ESCALATE')").select("example_id", "gold_intent", "pred_intent")


@query("SELECT example_id, final_top_similarity FROM agent_evaluation WHERE final_top_similarity IS NOT NULL ORDER BY final_top_similarity, example_id LIMIT 10")
def lowest_similarity(spark, sf):
    return _eval(spark, sf).filter("final_top_similarity is not null").orderBy("final_top_similarity", "example_id").limit(10).select("example_id", "final_top_similarity")


@query("SELECT t AS threshold, coalesce(pred_intent, '(all)') AS intent, count(*) AS retained FROM agent_evaluation, (SELECT unnest([0.7, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS t) WHERE pred_intent <> 'other_unclear' AND intent_confidence >= t GROUP BY GROUPING SETS ((t), (t, pred_intent))")
def silver_threshold_profile(spark, sf):
    """What is retained at each confidence, in all and by intent, by grouping sets."""
    rows = _eval(spark, sf).filter(F.col("pred_intent") != classify.OTHER)
    every = F.explode(F.filter(F.array(*[F.lit(t) for t in (0.7, 0.8, 0.85, 0.9, 0.95)]), lambda t: t <= F.col("intent_confidence")))
    return rows.select("pred_intent", every.alias("t")).rollup("t", "pred_intent").agg(F.count(F.lit(1)).alias("retained")).filter("t is not null").select(F.col("t").alias("threshold"), F.coalesce("pred_intent", F.lit("(all)")).alias("intent"), "retained")


# ---- models and streams
@query()
def classifier_predictions(spark, sf):
    """A classifier fitted on labelled pairs, applied to every evaluation message, abstaining under 0.25."""
    train = table(spark, sf, "historical_resolution").filter(F.col("intent").isNotNull() & (F.col("intent") != classify.OTHER))
    model = classify.fit(train, "customer_text", "intent")
    return classify.predict(model, _eval(spark, sf).select("example_id", "gold_intent", "customer_message"), "customer_message", 0.25).drop("customer_message")


def _replayed(spark, sf, closing: bool = False):
    at = new_path(spark, "messages")
    rows = messages(spark, sf)
    if closing:
        blank = {"inbound": F.lit(True), "ts": F.timestamp_seconds(F.lit(scorer.CLOSING))}
        rows = rows.unionByName(spark.range(1).select(*[blank.get(c, F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes]))
    rows.write.parquet(at)
    keep_until_exit(spark, at)
    return spark.readStream.schema(rows.schema).parquet(at)


@query(f" SELECT tweet_id, {rules.sql_first('coalesce(text, chr(32))')} AS topic, {rules.sql_level('coalesce(text, chr(32))')} AS risk FROM msg", msg=True)
def stream_scores(spark, sf):
    return scorer.replay(scorer.score(_replayed(spark, sf)).select("tweet_id", "topic", "risk"), "scores")


@query(""" , x AS (SELECT author, ts, tweet_id FROM msg WHERE inbound AND ts IS NOT NULL),
s AS (SELECT author, ts, sum(new) OVER (PARTITION BY author ORDER BY ts, tweet_id) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY author ORDER BY ts, tweet_id)) <= 86400000000 THEN 0 ELSE 1 END AS new FROM x))
SELECT author, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) + 86400000000 AS ended_us, count(*) AS messages FROM s GROUP BY author, s""", msg=True)
def stream_sessions(spark, sf):
    """Gap sessions of customers in append mode. A marker row behind all others closes what is open at the end."""
    got = scorer.replay(scorer.sessions(_replayed(spark, sf, closing=True).filter("inbound"), "author"), "sessions")
    return got.filter(F.col("started") < F.timestamp_seconds(F.lit(scorer.CLOSING))).select("author", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "messages")
