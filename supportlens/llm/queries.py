"""Queries of the language-model operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlens.llm import conversations, copies, overlap, packing, pairs, pii, subjects, tokens
from supportlens.functions.ids import latest
from supportlens.sources.tables import stage, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, sf_dir, "historical_resolution"), "resolution_id", "customer_text", "brand_text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap.overlaps(table(spark, sf_dir, "agent_evaluation"), table(spark, sf_dir, "historical_resolution"), table(spark, sf_dir, "split_manifest"))
    return found.select("example_id", "resolution_id")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.report(p2_found(spark, sf_dir), table(spark, sf_dir, "agent_evaluation"), table(spark, sf_dir, "split_manifest"))


def _personal(spark: SparkSession, sf_dir: str):
    tweets = latest(table(spark, sf_dir, "twcs"), "text").select("tweet_id", "text")
    pairs_ = table(spark, sf_dir, "historical_resolution").select("resolution_id", "customer_text")
    tweets = stage(tweets, "tweets")
    return tweets, pairs_, pii.learn(pii.texts_of((tweets, "text"), (pairs_, "customer_text")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tweets, pairs_, learned = _personal(spark, sf_dir)
    a = pii.find(tweets, learned, ("tweet_id",), "text").select(F.lit("twcs").alias("table_name"), F.col("tweet_id").alias("record_id"), "pii_type")
    b = pii.find(pairs_.filter("resolution_id is not null"), learned, ("resolution_id",), "customer_text").select(F.lit("historical_resolution").alias("table_name"), F.col("resolution_id").alias("record_id"), "pii_type")
    return a.unionByName(b.distinct())


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    tweets, pairs_, learned = _personal(spark, sf_dir)
    a = pii.masked(tweets, learned, "tweet_id", "text").select(F.lit("twcs").alias("table_name"), F.col("tweet_id").alias("record_id"), "masked")
    b = pii.masked(pairs_, learned, "resolution_id", "customer_text").select(F.lit("historical_resolution").alias("table_name"), F.col("resolution_id").alias("record_id"), "masked")
    return a.unionByName(b)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rebuild(table(spark, sf_dir, "twcs"), table(spark, sf_dir, "brand_accounts"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = copies.copy_groups(table(spark, sf_dir, "historical_resolution"), "resolution_id", "customer_text", "brand_text")
    return groups.filter("id <> kept_id").select("kept_id", F.col("id").alias("copy_id"))


def p7_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.collapsed(table(spark, sf_dir, "historical_resolution"), "resolution_id", "customer_text", "brand_text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(tokens.count_column(table(spark, sf_dir, "documents"), "doc_id", "text"), "sizes")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir), table(spark, sf_dir, "context_windows"))


def p9_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each window, and the fewest that could do (the sum of all lengths by the capacity)."""
    packed = packing.pack(_sizes(spark, sf_dir), table(spark, sf_dir, "context_windows"))
    per = packed.groupBy("window_id", "container").agg(F.sum("tokens").alias("tokens")).groupBy("window_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    caps = table(spark, sf_dir, "context_windows").select("window_id", "capacity_tokens").distinct()
    return per.join(caps, "window_id").select("window_id", "capacity_tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("lower_bound"), "fullest")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects_of(*(table(spark, sf_dir, t) for t in ("documents", "subject_examples", "subject_areas"))).select("doc_id", "subject")


def p10_make_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.make_up(table(spark, sf_dir, "documents"), p10_found(spark, sf_dir), ["lang", "source"])


QUERIES = {"p10_found": p10_found, "p10_make_up": p10_make_up, "p1_found": p1_found, "p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_masked": p3_masked, "p5_found": p5_found, "p7_found": p7_found, "p7_collapsed": p7_collapsed, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_usage": p9_usage}

_LINKS = r"""
m AS (SELECT tweet_id, max(struct_pack(line_no := line_no, up := in_response_to_tweet_id, author_id := author_id, inbound := inbound, created_at := created_at, txt := text)) AS m FROM twcs WHERE tweet_id IS NOT NULL GROUP BY 1),
s AS (SELECT tweet_id, m, regexp_replace(m.up, '[\s"''\[\]]', '', 'g') AS s, trim(m.created_at) AS c FROM m),
l AS (SELECT tweet_id AS id, m, c, nullif(regexp_extract(CASE WHEN regexp_full_match(s, '[0-9]{1,3}(,[0-9]{3})+') THEN replace(s, ',', '') ELSE s END, '^([0-9]+)(\.0+)?$', 1), '') AS up FROM s),
e AS (SELECT a.*, b.id AS parent FROM l a LEFT JOIN l b ON a.up = b.id),
t AS (SELECT id, id AS root, up IS NOT NULL AS orphan FROM e WHERE parent IS NULL UNION ALL SELECT e.id, t.root, t.orphan FROM t JOIN e ON e.parent = t.id)"""

_COPIES = r"""WITH x AS (SELECT resolution_id AS id, unnest([customer_text, brand_text]) AS t, unnest([1, 2]) AS side FROM historical_resolution WHERE resolution_id IS NOT NULL),
y AS (SELECT id, side, regexp_replace(replace(lower(coalesce(t, '')), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g') AS plain,
  CASE WHEN regexp_matches(t, '^[^\p{L}\p{N}]*\p{L}[\p{L} ]{0,24}\s*[:=]') THEN string_split(regexp_replace(t, '[\n;|]+([^\p{L}\p{N}]*\p{L}[\p{L} ]{0,24}\s*[:=])', chr(1) || '\1', 'g'), chr(1)) END AS parts FROM x),
z AS (SELECT id, side, plain, CASE WHEN len(parts) > 1 THEN array_to_string(list_sort(list_filter(list_transform(parts, lambda p: regexp_replace(replace(lower(p), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g')), lambda p: p <> '')), chr(10)) END AS nested FROM y),
r AS (SELECT id, list_sort(list(plain)) AS k, CASE WHEN bool_or(nested IS NOT NULL) THEN list_sort(list(coalesce(nested, plain))) END AS f FROM z GROUP BY 1),
g AS (SELECT id, coalesce(array_to_string(min(f) OVER (PARTITION BY k), chr(2)), array_to_string(k, chr(2))) AS key FROM r)
"""

SQL: dict[str, str] = {
    "p5_found": "WITH RECURSIVE" + _LINKS + r""",
f AS (SELECT id AS tweet_id, root, orphan, regexp_replace(m.txt, '[\s\p{Z}\p{C}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{2800}\x{3164}\x{FE00}-\x{FE0F}]', '', 'g') <> '' AS visible,
  CASE lower(regexp_replace(m.inbound, '\s', '', 'g')) WHEN 'true' THEN false WHEN '1' THEN false WHEN 'false' THEN true WHEN '0' THEN true ELSE lower(regexp_replace(m.author_id, '^[\s@]+|\s+$', '', 'g')) IN (SELECT lower(author_id) FROM brand_accounts) END AS brand,
  CASE WHEN regexp_matches(c, '^[0-9]{10}$') THEN to_timestamp(c::DOUBLE) WHEN regexp_matches(c, '^[0-9]{13}$') THEN to_timestamp(c::DOUBLE / 1000)
    WHEN regexp_matches(c, '^[A-Z][a-z]{2} ') THEN try_strptime(c, '%a %b %d %H:%M:%S %z %Y')::TIMESTAMPTZ
    WHEN regexp_matches(c, '^[0-9]{1,2} [A-Z]') THEN try_strptime(replace(c, ' UTC', ''), '%d %b %Y %H:%M:%S')::TIMESTAMPTZ
    WHEN c LIKE '0000%' THEN NULL ELSE try_cast(c AS TIMESTAMPTZ) END AS ts FROM t JOIN e USING (id)),
g AS (SELECT root FROM f GROUP BY 1 HAVING NOT bool_or(orphan OR ts IS NULL) AND min(CASE WHEN visible AND NOT brand THEN struct_pack(ts := ts, tweet_id := tweet_id) END) < max(CASE WHEN visible AND brand THEN struct_pack(ts := ts, tweet_id := tweet_id) END))
SELECT root AS root_id, row_number() OVER (PARTITION BY root ORDER BY ts, tweet_id) AS position, tweet_id, CASE WHEN brand THEN 'brand' ELSE 'customer' END AS role FROM f JOIN g USING (root) WHERE visible""",
    "p2_found": r"""WITH src AS (SELECT 'e' AS side, example_id AS id, lower(trim(conversation_id)) AS conv, customer_message AS t FROM agent_evaluation WHERE example_id IS NOT NULL
  UNION ALL SELECT 't', resolution_id, lower(trim(conversation_id)), customer_text FROM historical_resolution WHERE resolution_id IS NOT NULL AND lower(trim(conversation_id)) IN (SELECT lower(trim(conversation_id)) FROM split_manifest WHERE lower(trim(split)) = 'train')),
w AS (SELECT side, id, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(lower(t), '(https?://|www\.)[^\s]+', ' ', 'g'), '@[\p{L}\p{N}_]+', ' ', 'g'), '[''’‘ʼ`´′]', '', 'g'), '[\p{L}\p{N}]+')) AS w FROM src),
c AS (SELECT side, id, w, count(*) AS c FROM w GROUP BY 1, 2, 3), n AS (SELECT side, id, sum(c) AS n FROM c GROUP BY 1, 2),
s AS (SELECT a.id AS e, b.id AS t, sum(least(a.c, b.c)) AS k FROM c a JOIN c b ON a.w = b.w AND a.side = 'e' AND b.side = 't' GROUP BY 1, 2)
SELECT e AS example_id, t AS resolution_id FROM s JOIN n x ON x.side = 'e' AND x.id = e JOIN n y ON y.side = 't' AND y.id = t WHERE 5 * k >= 4 * greatest(x.n, y.n)
UNION SELECT a.id, b.id FROM src a JOIN src b ON a.conv = b.conv AND a.side = 'e' AND b.side = 't'""",
    "p7_found": _COPIES + "SELECT kept_id, id AS copy_id FROM (SELECT id, min(id) OVER (PARTITION BY key) AS kept_id FROM g) WHERE id <> kept_id",
    "p7_collapsed": _COPIES + "SELECT min(id) AS kept_id, count(*) AS copies FROM g GROUP BY key",
}
