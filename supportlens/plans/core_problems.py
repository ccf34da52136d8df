"""Queries of the two general training-data problems: hierarchies (4) and packed values (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlens.functions.ids import bare_id, latest
from supportlens.operators.hierarchy import descendant_pairs, hierarchy
from supportlens.operators.packed import unpack
from supportlens.sources.tables import table


def tweet_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "twcs"), "in_response_to_tweet_id").select("tweet_id", bare_id(F.col("in_response_to_tweet_id")).alias("parent_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy(tweet_links(spark, sf_dir), "tweet_id", "parent_id")
    return tree.select(F.col("id").alias("tweet_id"), F.col("root").alias("root_id"), "depth", "descendants")


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy(tweet_links(spark, sf_dir), "tweet_id", "parent_id", with_path=True)
    return tree.select(F.col("id").alias("tweet_id"), F.array_join("path", "/").alias("path"), "back_edge")


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tweet below every tweet, with the distance; tweets on or below a cycle have none."""
    tree = hierarchy(tweet_links(spark, sf_dir), "tweet_id", "parent_id", with_path=True)
    return descendant_pairs(tree)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(table(spark, sf_dir, "twcs"), "response_tweet_id")
    return unpack(rows, "tweet_id", "response_tweet_id").filter("error is null or error = 'malformed'").select("tweet_id", "position", "value")


QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants, "p6_found": p6_found}

_TREE = r"""
WITH RECURSIVE l AS (SELECT tweet_id AS id, nullif(regexp_extract(CASE WHEN regexp_full_match(s, '[0-9]{1,3}(,[0-9]{3})+') THEN replace(s, ',', '') ELSE s END, '^([0-9]+)(\.0+)?$', 1), '') AS up
  FROM (SELECT tweet_id, regexp_replace(c, '[\s"''\[\]]', '', 'g') AS s FROM (SELECT tweet_id, max(struct_pack(line_no := line_no, c := in_response_to_tweet_id)).c AS c FROM twcs WHERE tweet_id IS NOT NULL GROUP BY 1))),
e AS (SELECT a.id, b.id AS parent FROM l a LEFT JOIN l b ON a.up = b.id),
t AS (SELECT id, id AS root, 0::BIGINT AS depth, [id] AS path FROM e WHERE parent IS NULL
  UNION ALL SELECT e.id, t.root, t.depth + 1, list_append(t.path, e.id) FROM t JOIN e ON e.parent = t.id)"""

SQL = {
    "p4_descendants": _TREE + " SELECT path[i] AS ancestor, id AS descendant, depth - i + 1 AS distance FROM (SELECT id, depth, path, unnest(range(1, len(path))) AS i FROM t)",
    "p4_paths": _TREE + """,
up AS (SELECT id AS start, parent AS node FROM e WHERE id NOT IN (SELECT id FROM t) UNION SELECT u.start, e.parent FROM up u JOIN e ON e.id = u.node),
ring AS (SELECT start FROM up GROUP BY 1 HAVING bool_or(start = node) AND min(node) = start)
SELECT e.id AS tweet_id, array_to_string(t.path, '/') AS path, e.id IN (SELECT start FROM ring) AS back_edge FROM e LEFT JOIN t ON e.id = t.id""",
    "p4_found": _TREE + r""",
d AS (SELECT a AS id, count(*) - 1 AS descendants FROM (SELECT unnest(path) AS a FROM t) GROUP BY 1)
SELECT e.id AS tweet_id, coalesce(t.root, 'cycle') AS root_id, coalesce(t.depth, -1)::BIGINT AS depth, coalesce(d.descendants, -1)::BIGINT AS descendants
FROM e LEFT JOIN t ON e.id = t.id LEFT JOIN d ON e.id = d.id""",
    "p6_found": r"""
WITH l AS (SELECT tweet_id, max(struct_pack(line_no := line_no, c := response_tweet_id)).c AS c FROM twcs WHERE tweet_id IS NOT NULL GROUP BY 1),
g AS (SELECT tweet_id, regexp_replace(regexp_replace(c, '(["''])([0-9]{1,3}),([0-9]{3}),([0-9]{3})["'']', '\1\2\3\4\1', 'g'), '(["''])([0-9]{1,3}),([0-9]{3})["'']', '\1\2\3\1', 'g') AS c FROM l),
v AS (SELECT tweet_id, regexp_extract_all(regexp_replace(c, '\.0+', '', 'g'), '[0-9]+') AS v FROM g)
SELECT tweet_id, unnest(range(1, len(v) + 1)) AS position, unnest(v) AS value FROM v""",
}
