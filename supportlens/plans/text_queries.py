"""Queries over texts, profiles, links, threads, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supportlens.functions import text as T
from supportlens.operators import splits, threads
from supportlens.plans.base import MSG, B, messages, sql_anaphoric, sql_normalize, sql_strip, sql_words, threaded
from supportlens.sources.tables import stage, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def query(sql: str | None = None, msg: bool = False, recursive: bool = False):
    """Registers a query under its function's name; msg: the SQL reads the message view."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = ("WITH RECURSIVE " if recursive else "WITH ") + MSG + sql if msg else sql
        return f

    return wrap


# ---- scalar functions
@query(f"SELECT tweet_id, {sql_normalize('text')} AS normalized, {sql_words('text')} AS words FROM msg WHERE text IS NOT NULL".join((" ", "")), msg=True)
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).filter("text is not null").select("tweet_id", T.normalize(F.col("text")).alias("normalized"), T.word_count(F.col("text")).cast("long").alias("words"))


_TOK = f"list_filter(regexp_extract_all({sql_normalize('text')}, '([a-z0-9]+(?:''[a-z0-9]+)?)', 1), lambda x: x NOT IN ({_STOP}))"


@query(f" SELECT tweet_id, array_to_string({_TOK}, ' ') AS tokens FROM msg WHERE text IS NOT NULL", msg=True)
def meaningful_tokens(spark, sf):
    return messages(spark, sf).filter("text is not null").select("tweet_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


_URLS = "list_transform(regexp_extract_all({c}, '(https?://[^ \\t\\n\\r]+)', 1), lambda u: regexp_replace(u, '[.,;!?:)\"''>]+$', ''))"


@query(f"SELECT resolution_id, array_to_string({_URLS.format(c='brand_text')}, ' ') AS urls, len({_URLS.format(c='brand_text')})::BIGINT AS n FROM historical_resolution WHERE regexp_matches(brand_text, '(?i)https?://')")
def extract_urls(spark, sf):
    u = T.urls(F.col("brand_text"))
    return table(spark, sf, "historical_resolution").filter(T.has_url(F.col("brand_text"))).select("resolution_id", F.array_join(u, " ").alias("urls"), F.size(u).cast("long").alias("n"))


@query("SELECT resolution_id, regexp_replace(brand_text, '^@[A-Za-z0-9_]+[ \\t\\n\\r]*', '') AS reply, CASE WHEN length(customer_text) > 140 THEN customer_text[1:140] || '...' ELSE customer_text END AS preview FROM historical_resolution WHERE brand_text IS NOT NULL")
def strip_handles_and_previews(spark, sf):
    return table(spark, sf, "historical_resolution").filter("brand_text is not null").select("resolution_id", T.strip_handle(F.col("brand_text")).alias("reply"), T.preview(F.col("customer_text"), 140).alias("preview"))


@query(f"SELECT resolution_id, {sql_strip(chr(40) + 'lower(regexp_replace(customer_text, ' + chr(39) + r'[^\p{L}\p{N}_ \t\n\r]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')))')} AS cleaned, {sql_anaphoric('customer_text')} AS anaphoric FROM historical_resolution WHERE customer_text IS NOT NULL")
def clean_and_anaphora(spark, sf):
    c = F.col("customer_text")
    return table(spark, sf, "historical_resolution").filter("customer_text is not null").select("resolution_id", T.clean(c).alias("cleaned"), T.anaphoric(c).alias("anaphoric"))


@query("SELECT resolution_id, replace(replace(replace(replace(replace(brand_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped, concat_ws(' ', customer_text, brand_text) AS both_sides, concat_ws(' ', customer_text, replace(intent, '_', ' ')) AS augmented FROM historical_resolution")
def index_and_escape(spark, sf):
    return table(spark, sf, "historical_resolution").select("resolution_id", T.html_escape(F.col("brand_text")).alias("escaped"), F.concat_ws(" ", "customer_text", "brand_text").alias("both_sides"), F.concat_ws(" ", "customer_text", F.replace("intent", F.lit("_"), F.lit(" "))).alias("augmented"))



# ---- profiles
_TWCS = ["tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id", "loaded_at"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) AS values FROM twcs" for c in _TWCS))
def inspect_missing_values(spark, sf):
    df = table(spark, sf, "twcs")
    wide = df.select(*[F.col(c).cast("string").alias(c) for c in _TWCS])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in _TWCS])).alias("x")).select("x.*")
    return long.groupBy("column_name").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("v").isNull()).alias("missing"), F.count_distinct("v").alias("values"))


@query("SELECT inbound, count(*) AS n FROM twcs GROUP BY 1")
def inbound_values(spark, sf):
    return table(spark, sf, "twcs").groupBy("inbound").agg(F.count(F.lit(1)).alias("n"))


@query(" SELECT count(*) AS messages, count(*) FILTER (inbound) AS inbound, count(DISTINCT author) AS authors, count(DISTINCT CASE WHEN inbound THEN author END) AS customers, count(parent_id) AS replies, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, min(length(text)) AS shortest, max(length(text)) AS longest, round(avg(length(text)), 4) AS mean_length, round(count(*) FILTER (inbound) / count(*) * 100, 4) AS inbound_pct FROM msg", msg=True)
def profile_messages(spark, sf):
    n = F.length("text")
    return messages(spark, sf).agg(F.count(F.lit(1)).alias("messages"), F.count_if("inbound").alias("inbound"), F.count_distinct("author").alias("authors"), F.count_distinct(F.when(F.col("inbound"), F.col("author"))).alias("customers"), F.count("parent_id").alias("replies"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 4).alias("mean_length"), T.percentage(F.count_if("inbound"), F.count(F.lit(1))).alias("inbound_pct"))


@query(" SELECT author, count(*) AS n FROM msg WHERE NOT inbound GROUP BY 1 ORDER BY n DESC, author LIMIT 20", msg=True)
def top_authors(spark, sf):
    return messages(spark, sf).filter("not inbound").groupBy("author").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "author").limit(20)


@query(""" SELECT b.author AS brand, count(DISTINCT b.tweet_id) AS outbound, count(DISTINCT c.tweet_id) AS answered, count(DISTINCT c.author) AS customers
FROM msg b LEFT JOIN msg c ON b.parent_id = c.tweet_id AND c.inbound WHERE NOT b.inbound GROUP BY 1""", msg=True)
def brand_comparison(spark, sf):
    m = messages(spark, sf)
    c = m.filter("inbound").select(F.col("tweet_id").alias("parent_id"), F.col("author").alias("customer"), F.col("tweet_id").alias("asked"))
    return m.filter("not inbound").join(c, "parent_id", "left").groupBy(F.col("author").alias("brand")).agg(F.count_distinct("tweet_id").alias("outbound"), F.count_distinct("asked").alias("answered"), F.count_distinct("customer").alias("customers"))


@query(f"SELECT lang, count(*) AS documents, min(length(text)) AS shortest, max(length(text)) AS longest, round(avg(length(text)), 4) AS mean_length, round(avg({sql_words('text')}), 4) AS mean_words FROM documents WHERE text IS NOT NULL GROUP BY 1")
def text_length_profile(spark, sf):
    n = F.length("text")
    return table(spark, sf, "documents").filter("text is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 4).alias("mean_length"), F.round(F.avg(T.word_count(F.col("text"))), 4).alias("mean_words"))


def _ngram_query(n: int):
    gram = "w" if n == 1 else f"list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"

    @query(f" SELECT gram, count(*) AS n FROM (SELECT unnest({gram}) AS gram FROM (SELECT {_TOK} AS w FROM msg WHERE inbound AND text IS NOT NULL)) GROUP BY 1 ORDER BY n DESC, gram LIMIT 50", msg=True)
    def f(spark, sf):
        grams = messages(spark, sf).filter("inbound and text is not null").select(T.tokens(F.col("text")).alias("w")).select(F.explode(T.ngrams(F.col("w"), n)).alias("gram"))
        return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(50)

    QUERIES[f"ngram_top_{n}"], SQL[f"ngram_top_{n}"] = QUERIES.pop("f"), SQL.pop("f")


for _n in (1, 2, 3):
    _ngram_query(_n)


# ---- predicates and joins
@query(" SELECT tweet_id, inbound, epoch_us(ts) AS at_us, parent_id FROM msg", msg=True)
def parsed_messages(spark, sf):
    return messages(spark, sf).select("tweet_id", "inbound", F.unix_micros("ts").alias("at_us"), "parent_id")


@query(f" SELECT tweet_id, author, text FROM msg WHERE inbound AND {sql_strip('text')} <> '' AND tweet_id NOT IN (SELECT tweet_id FROM agent_evaluation WHERE tweet_id IS NOT NULL) AND tweet_id IN (SELECT customer_tweet_id FROM historical_resolution)", msg=True)
def eligible_inbound(spark, sf):
    """Customer messages with text, used in a pair, and in no evaluation record: a semi join and an anti join."""
    m = messages(spark, sf).filter(F.col("inbound") & (T.strip(F.col("text")) != ""))
    gold = table(spark, sf, "agent_evaluation").select("tweet_id").filter("tweet_id is not null")
    used = table(spark, sf, "historical_resolution").select(F.col("customer_tweet_id").alias("tweet_id"))
    return m.join(used, "tweet_id", "left_semi").join(gold, "tweet_id", "left_anti").select("tweet_id", "author", "text")


_IDS = r"""regexp_extract_all(regexp_replace(regexp_replace(regexp_replace({c}, '(["''])([0-9]{{1,3}}),([0-9]{{3}}),([0-9]{{3}})["'']', '\1\2\3\4\1', 'g'), '(["''])([0-9]{{1,3}}),([0-9]{{3}})["'']', '\1\2\3\1', 'g'), '\.0+', '', 'g'), '[0-9]+')"""
_EDGES = f""",
lraw AS (SELECT tweet_id, max(struct_pack(line_no := line_no, up := in_response_to_tweet_id, down := response_tweet_id)) AS r FROM twcs WHERE tweet_id IS NOT NULL GROUP BY 1),
named AS (SELECT unnest({_IDS.format(c='r.up')}) AS parent_id, tweet_id AS child_id FROM lraw UNION SELECT tweet_id, unnest({_IDS.format(c='r.down')}) FROM lraw),
edges AS (SELECT n.parent_id, n.child_id, CASE WHEN c.inbound THEN c.author ELSE p.author END AS customer, CASE WHEN c.inbound THEN p.author ELSE c.author END AS brand
  FROM named n JOIN msg c ON n.child_id = c.tweet_id JOIN msg p ON n.parent_id = p.tweet_id WHERE c.inbound <> p.inbound AND c.author IS NOT NULL AND p.author IS NOT NULL AND epoch_us(c.ts) - epoch_us(p.ts) BETWEEN 0 AND 7 * 86400000000::BIGINT)"""


@query(_EDGES + " SELECT * FROM edges", msg=True)
def reply_edges(spark, sf):
    m, named = threaded(spark, sf)
    return threads.reply_edges(m, named=named)


_COMPONENTS = _EDGES + """,
both_ways AS (SELECT brand, customer, parent_id AS a, child_id AS b FROM edges UNION SELECT brand, customer, child_id, parent_id FROM edges),
reach AS (SELECT brand, customer, a AS id, a AS seen FROM both_ways UNION SELECT r.brand, r.customer, r.id, w.b FROM reach r JOIN both_ways w ON w.brand = r.brand AND w.customer = r.customer AND w.a = r.seen),
walk AS (SELECT brand, customer, id, min(seen) AS component FROM reach GROUP BY 1, 2, 3)"""


def _components(spark, sf):
    m, named = threaded(spark, sf)
    return threads.edge_components(stage(threads.reply_edges(m, named=named), "edges"))


@query(_COMPONENTS + " SELECT brand, customer, component, count(*) AS messages FROM walk GROUP BY 1, 2, 3", msg=True, recursive=True)
def edge_component_sizes(spark, sf):
    """Components of a customer with a brand, named by their smallest id."""
    return _components(spark, sf).groupBy("brand", "customer", "component").agg(F.count(F.lit(1)).alias("messages"))


@query(_COMPONENTS + " SELECT brand, count(DISTINCT id) AS nodes, count(DISTINCT customer) AS customers, count(DISTINCT customer || chr(31) || component) AS components FROM walk GROUP BY 1", msg=True, recursive=True)
def brand_components(spark, sf):
    return _components(spark, sf).groupBy("brand").agg(F.count_distinct("id").alias("nodes"), F.count_distinct("customer").alias("customers"), F.count_distinct(F.concat_ws("\x1f", "customer", "component")).alias("components"))


_SEGMENTS = """ SELECT author, tweet_id, 1 + sum(cut) OVER w AS segment FROM (SELECT author, tweet_id, ts, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN lag(ts) OVER w IS NULL OR ts IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 THEN 1 ELSE 0 END AS cut
FROM msg WHERE inbound WINDOW w AS (PARTITION BY author ORDER BY ts NULLS LAST, tweet_id)) WINDOW w AS (PARTITION BY author ORDER BY ts NULLS LAST, tweet_id)"""


@query(" SELECT author, tweet_id, segment::BIGINT AS segment FROM (" + _SEGMENTS + ")", msg=True)
def gap_segments(spark, sf):
    return threads.gap_segments(messages(spark, sf).filter("inbound"), ["author"], 1).select("author", "tweet_id", F.col("segment").cast("long").alias("segment"))


_BUILT = _COMPONENTS + """,
seg AS (SELECT brand, customer, component, tweet_id, inbound, ts, 1 + sum(cut) OVER w AS segment FROM (SELECT brand, customer, component, tweet_id, inbound, ts, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN lag(ts) OVER w IS NULL OR ts IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7 * 86400000000::BIGINT THEN 1 ELSE 0 END AS cut
  FROM walk JOIN msg ON walk.id = msg.tweet_id WINDOW w AS (PARTITION BY brand, customer, component ORDER BY ts NULLS LAST, tweet_id)) WINDOW w AS (PARTITION BY brand, customer, component ORDER BY ts NULLS LAST, tweet_id)),
good AS (SELECT brand, customer, component, segment, min(struct_pack(late := ts IS NULL, ts := ts, tweet_id := tweet_id)) AS first FROM seg GROUP BY 1, 2, 3, 4 HAVING bool_or(inbound) AND bool_or(NOT inbound)),
conv AS (SELECT brand, customer, component, segment, format('conv_{:06d}', row_number() OVER (ORDER BY first, brand, customer)) AS conversation_id FROM good),
built AS (SELECT conversation_id, customer, row_number() OVER (PARTITION BY conversation_id ORDER BY ts NULLS LAST, tweet_id) AS position, tweet_id, inbound, ts FROM seg JOIN conv USING (brand, customer, component, segment))"""


def _conversations(spark, sf):
    """The message view and its conversations, by the links of both fields."""
    m, named = threaded(spark, sf)
    return m, threads.conversations(m, named=named)


@query(_BUILT + " SELECT conversation_id, position, tweet_id, inbound FROM built", msg=True, recursive=True)
def conversations_built(spark, sf):
    return _conversations(spark, sf)[1].select("conversation_id", "position", "tweet_id", "inbound")


@query(_BUILT + """, per AS (SELECT conversation_id, min(customer) AS customer, count(*) AS n, count(*) FILTER (inbound) AS i, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM built GROUP BY 1)
SELECT count(*) AS conversations, sum(n)::BIGINT AS messages, count(*) FILTER (n >= 2) AS two_or_more, count(*) FILTER (n >= 3) AS three_or_more, round(avg(n), 4) AS mean_length, median(n)::DOUBLE AS median_length, min(n) AS shortest, max(n) AS longest, sum(i)::BIGINT AS inbound, sum(n - i)::BIGINT AS outbound, count(DISTINCT customer) AS customers,
count(*) FILTER (span > 86400000000) AS over_a_day, count(*) FILTER (span > 7 * 86400000000::BIGINT) AS over_a_week, count(*) FILTER (span > 30 * 86400000000::BIGINT) AS over_a_month, max(span) AS longest_span_us FROM per""", msg=True, recursive=True)
def conversation_stats(spark, sf):
    day = 86_400_000_000
    per = _conversations(spark, sf)[1].groupBy("conversation_id").agg(F.min("customer").alias("customer"), F.count(F.lit(1)).alias("n"), F.count_if("inbound").alias("i"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("span"))
    return per.agg(F.count(F.lit(1)).alias("conversations"), F.sum("n").alias("messages"), F.count_if(F.col("n") >= 2).alias("two_or_more"), F.count_if(F.col("n") >= 3).alias("three_or_more"), F.round(F.avg("n"), 4).alias("mean_length"), F.median("n").alias("median_length"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.sum("i").alias("inbound"), F.sum(F.col("n") - F.col("i")).alias("outbound"), F.count_distinct("customer").alias("customers"), F.count_if(F.col("span") > day).alias("over_a_day"), F.count_if(F.col("span") > 7 * day).alias("over_a_week"), F.count_if(F.col("span") > 30 * day).alias("over_a_month"), F.max("span").alias("longest_span_us"))


@query(_BUILT + """, txt AS (SELECT conversation_id, position, '[' || CASE WHEN b.inbound THEN 'customer' ELSE 'brand' END || '] ' || """ + sql_strip(f"regexp_replace(coalesce(text, ''), '{B}+', ' ', 'g')") + """ AS line FROM built b JOIN msg USING (tweet_id))
SELECT conversation_id, CASE WHEN count(*) <= 2 THEN 'short' WHEN count(*) <= 4 THEN 'medium' ELSE 'long' END AS length_bucket, string_agg(line, ' | ' ORDER BY position)[1:2000] AS context FROM txt GROUP BY 1""", msg=True, recursive=True)
def context_strings(spark, sf):
    """Turns with roles in one string, cut at 2000 characters (the context's defined length), and the length bucket."""
    m, built = _conversations(spark, sf)
    line = F.concat(F.lit("["), F.when(F.col("inbound"), "customer").otherwise("brand"), F.lit("] "), T.collapse(F.coalesce("text", F.lit(""))))
    rows = built.join(m.select("tweet_id", "text"), "tweet_id").select("conversation_id", "position", line.alias("line"))
    # lines that begin behind the cut are left out before any are gathered, so what is gathered is as long as the context
    upto = Window.partitionBy("conversation_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("line") + 3).over(upto), F.lit(0)))
    shown = F.when(F.col("before") < 2000, F.struct("position", F.substring("line", 1, 2000).alias("line")))
    per = rows.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(shown)).alias("t"))
    return per.select("conversation_id", F.when(F.col("n") <= 2, "short").when(F.col("n") <= 4, "medium").otherwise("long").alias("length_bucket"), F.substring(F.array_join(F.col("t.line"), " | "), 1, 2000).alias("context"))


@query(_BUILT + " SELECT tweet_id, position - 1 AS prior_turns, lag(tweet_id) OVER (PARTITION BY conversation_id ORDER BY position) AS prior_id FROM built", msg=True, recursive=True)
def prior_turns(spark, sf):
    w = Window.partitionBy("conversation_id").orderBy("position")
    return _conversations(spark, sf)[1].select("tweet_id", (F.col("position") - 1).alias("prior_turns"), F.lag("tweet_id").over(w).alias("prior_id"))


@query(" SELECT 'res_' || p.tweet_id || '_' || c.tweet_id AS resolution_id, p.tweet_id AS customer_tweet_id, c.tweet_id AS brand_tweet_id, epoch_us(coalesce(c.ts, p.ts)) AS at_us FROM msg c JOIN msg p ON c.parent_id = p.tweet_id WHERE NOT c.inbound AND p.inbound", msg=True)
def reply_pairs(spark, sf):
    return threads.reply_pairs(messages(spark, sf)).select("resolution_id", "customer_tweet_id", "brand_tweet_id", F.unix_micros("created_at").alias("at_us"))


@query(", i AS (SELECT customer_tweet_id, max(intent) AS intent FROM historical_resolution GROUP BY 1) SELECT coalesce(i.intent, '(none)') AS intent, count(*) AS pairs FROM msg c JOIN msg p ON c.parent_id = p.tweet_id LEFT JOIN i ON i.customer_tweet_id = p.tweet_id WHERE NOT c.inbound AND p.inbound GROUP BY 1", msg=True)
def reply_pair_intents(spark, sf):
    """Pairs by intent, through a left lookup; the largest intent of a message holds."""
    intents = table(spark, sf, "historical_resolution").groupBy("customer_tweet_id").agg(F.max("intent").alias("intent"))
    return threads.reply_pairs(messages(spark, sf)).join(intents, "customer_tweet_id", "left").groupBy(F.coalesce("intent", F.lit("(none)")).alias("intent")).agg(F.count(F.lit(1)).alias("pairs"))


@query(f"""WITH t AS (SELECT *, lower({sql_strip("coalesce(customer_text, '')")}) || chr(31) || lower({sql_strip("coalesce(brand_text, '')")}) AS k, {sql_words("coalesce(brand_text, '')")} AS w FROM historical_resolution)
SELECT count(*) AS pairs, count(DISTINCT customer_tweet_id) AS customers, count(DISTINCT brand_tweet_id) AS brands, count(intent) AS tagged, count(*) - count(DISTINCT k) AS duplicates, count(*) FILTER (regexp_matches(brand_text, '(?i)https?://')) AS with_url, round(avg(length(customer_text)), 4) AS mean_customer, median(length(customer_text))::DOUBLE AS median_customer, round(avg(w), 4) AS mean_words, max(length(brand_text)) AS longest_brand FROM t""")
def corpus_stats(spark, sf):
    key = F.concat(F.lower(T.strip(F.coalesce("customer_text", F.lit("")))), F.lit("\x1f"), F.lower(T.strip(F.coalesce("brand_text", F.lit("")))))
    return table(spark, sf, "historical_resolution").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("customer_tweet_id").alias("customers"), F.count_distinct("brand_tweet_id").alias("brands"), F.count("intent").alias("tagged"), (F.count(F.lit(1)) - F.count_distinct(F.md5(key))).alias("duplicates"), F.count_if(T.has_url(F.col("brand_text"))).alias("with_url"), F.round(F.avg(F.length("customer_text")), 4).alias("mean_customer"), F.median(F.length("customer_text")).alias("median_customer"), F.round(F.avg(T.word_count(F.coalesce("brand_text", F.lit("")))), 4).alias("mean_words"), F.max(F.length("brand_text")).alias("longest_brand"))


# ---- sets, splits and samples
_ASSIGN = "SELECT doc_id, CASE WHEN r <= round_even(n * 0.7, 0) THEN 'train' WHEN r <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL))"


@query(_ASSIGN)
def split_assign(spark, sf):
    return splits.assign(table(spark, sf, "documents"), "doc_id")


@query(f"SELECT split, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({_ASSIGN}) GROUP BY 1")
def split_counts(spark, sf):
    per = splits.assign(table(spark, sf, "documents"), "doc_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return per.select("split", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))  # three rows


_NAMES = "n AS (SELECT DISTINCT lower(trim(split)) AS split, lower(trim(conversation_id)) AS id FROM split_manifest), own AS (SELECT lower(trim(conversation_id)) AS id FROM historical_resolution WHERE conversation_id IS NOT NULL)"


@query(f"WITH {_NAMES} SELECT 'several splits' AS kind, id FROM n GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'no split', id FROM own WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT DISTINCT 'unknown', id FROM n WHERE id NOT IN (SELECT id FROM own)")
def split_violations(spark, sf):
    return splits.violations(table(spark, sf, "split_manifest"), table(spark, sf, "historical_resolution"), "conversation_id")


@query("SELECT lower(trim(m.split)) AS split, count(DISTINCT lower(trim(e.conversation_id))) AS conversations FROM agent_evaluation e JOIN split_manifest m ON lower(trim(e.conversation_id)) = lower(trim(m.conversation_id)) GROUP BY 1")
def leakage_check(spark, sf):
    """Evaluation conversations by the split that holds them: any in train is a leak."""
    key = lambda df: df.withColumn("k", F.lower(F.trim("conversation_id")))
    m = key(table(spark, sf, "split_manifest")).select("k", F.lower(F.trim("split")).alias("split"))
    return key(table(spark, sf, "agent_evaluation")).select("k").join(m, "k").groupBy("split").agg(F.count_distinct("k").alias("conversations"))


@query("SELECT side, count(*) AS ids FROM ((SELECT 'only evaluation' AS side, tweet_id FROM (SELECT DISTINCT tweet_id FROM agent_evaluation WHERE tweet_id IS NOT NULL EXCEPT SELECT tweet_id FROM twcs)) UNION ALL (SELECT 'only pairs', x FROM (SELECT DISTINCT customer_tweet_id AS x FROM historical_resolution EXCEPT SELECT tweet_id FROM agent_evaluation)) UNION ALL (SELECT 'both', x FROM (SELECT DISTINCT customer_tweet_id AS x FROM historical_resolution INTERSECT SELECT tweet_id FROM agent_evaluation))) GROUP BY 1")
def id_set_difference(spark, sf):
    gold = table(spark, sf, "agent_evaluation").select("tweet_id").filter("tweet_id is not null").distinct()
    raw = table(spark, sf, "twcs").select("tweet_id").distinct()
    used = table(spark, sf, "historical_resolution").select(F.col("customer_tweet_id").alias("tweet_id")).distinct()
    parts = [("only evaluation", gold.subtract(raw)), ("only pairs", used.subtract(gold)), ("both", used.intersect(gold))]
    out = [df.select(F.lit(side).alias("side")) for side, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).groupBy("side").agg(F.count(F.lit(1)).alias("ids"))


def _stratified(sf_table: str, strata: str, key: str, n: int, seed: str = "42", where: str = "true") -> str:
    cols = ", ".join(s.strip() for s in strata.split(","))
    return f"SELECT {key}, {cols}, turn FROM (SELECT {key}, {cols}, row_number() OVER (PARTITION BY {cols} ORDER BY md5('{seed}:' || {key}), {key}) AS turn FROM {sf_table} WHERE {where}) ORDER BY turn, {cols} NULLS FIRST, {key} LIMIT {n}".replace(", turn FROM (", ", turn FROM (", 1)


@query(_stratified("documents", "doc_kind", "doc_id", 250))
def sample_stratified(spark, sf):
    return splits.round_robin(table(spark, sf, "documents").select("doc_id", "doc_kind"), ["doc_kind"], "doc_id", 250)


@query("SELECT example_id, bucket, turn FROM (SELECT example_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5('7:' || example_id), example_id) AS turn FROM (SELECT example_id, CASE WHEN intent_confidence >= 0.8 THEN 'high' WHEN intent_confidence >= 0.5 THEN 'mid' ELSE 'low' END || ':' || coalesce(final_action, '-') AS bucket FROM agent_evaluation)) ORDER BY turn, bucket, example_id LIMIT 50")
def sample_audit(spark, sf):
    conf = F.col("intent_confidence")
    b = F.concat(F.when(conf >= 0.8, "high").when(conf >= 0.5, "mid").otherwise("low"), F.lit(":"), F.coalesce("final_action", F.lit("-")))
    return splits.round_robin(table(spark, sf, "agent_evaluation").select("example_id", b.alias("bucket")), ["bucket"], "example_id", 50, 7)


@query("SELECT intent, count(*) AS n FROM historical_resolution WHERE intent IS NOT NULL GROUP BY 1 ORDER BY n, intent LIMIT 5")
def rarest_groups(spark, sf):
    return table(spark, sf, "historical_resolution").filter("intent is not null").groupBy("intent").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "intent").limit(5)


@query("""WITH pool AS (SELECT tweet_id, text, md5('q:' || tweet_id) AS k FROM (SELECT tweet_id, max(struct_pack(line_no := line_no, t := text)).t AS text FROM twcs WHERE tweet_id IS NOT NULL GROUP BY 1) WHERE text IS NOT NULL),
a AS (SELECT tweet_id, 'question' AS stratum FROM pool WHERE text LIKE '%?%' ORDER BY k, tweet_id LIMIT 45),
b AS (SELECT tweet_id, 'link' FROM pool WHERE text LIKE '%http%' AND tweet_id NOT IN (SELECT tweet_id FROM a) ORDER BY k, tweet_id LIMIT 55),
c AS (SELECT tweet_id, 'short' FROM pool WHERE length(text) <= 40 AND tweet_id NOT IN (SELECT tweet_id FROM a UNION ALL SELECT tweet_id FROM b) ORDER BY k, tweet_id LIMIT 35),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
d AS (SELECT tweet_id, 'fill' FROM pool WHERE tweet_id NOT IN (SELECT tweet_id FROM u) ORDER BY k, tweet_id LIMIT (SELECT 250 - count(*) FROM u))
SELECT * FROM u UNION ALL SELECT * FROM d""")
def sample_quota_cascade(spark, sf):
    """Overlapping strata drawn in turn, each without what was taken before, and filled up to 250."""
    pool = messages(spark, sf).filter("text is not null").select("tweet_id", "text", splits.order_key("q", F.col("tweet_id")).alias("k"))
    quotas = [("question", F.col("text").contains("?"), 45), ("link", F.col("text").contains("http"), 55), ("short", F.length("text") <= 40, 35), ("fill", F.lit(True), 250)]
    taken = None
    for name, rule, n in quotas:
        rest = pool.filter(rule) if taken is None else pool.filter(rule).join(F.broadcast(taken), "tweet_id", "left_anti")  # taken: 250 rows at most
        n = n if name != "fill" else n - taken.count()
        part = rest.orderBy("k", "tweet_id").limit(n).select("tweet_id", F.lit(name).alias("stratum"))
        taken = part if taken is None else taken.unionByName(part)
    return taken
