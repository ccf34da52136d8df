"""The message view that most queries read, in Spark and as the SQL that the checks use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlens.functions.text import ANAPHORA, ANAPHORIC_PHRASES
from supportlens.functions.ids import bare_id, flag, handle_key, instant, latest
from supportlens.operators.threads import links
from supportlens.sources.tables import stage, table


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tweet_id, author, inbound, ts, text, parent_id: one row per tweet_id, as the highest line_no has it."""
    rows = latest(table(spark, sf_dir, "twcs"), "author_id", "inbound", "created_at", "text", "in_response_to_tweet_id")
    brands = F.broadcast(table(spark, sf_dir, "brand_accounts").select(handle_key(F.col("author_id")).alias("author"), F.lit(True).alias("listed")))  # 16 rows, fixed
    rows = rows.withColumn("author", handle_key(F.col("author_id"))).join(brands, "author", "left")
    return rows.select(
        "tweet_id", "author", F.coalesce(flag(F.col("inbound")), F.col("listed").isNull()).alias("inbound"), instant(F.col("created_at")).alias("ts"),
        "text", bare_id(F.col("in_response_to_tweet_id")).alias("parent_id"))


def threaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The message view, staged as threads read it several times, and the links that both link fields name."""
    rows = stage(messages(spark, sf_dir), "message-view")
    raw = latest(table(spark, sf_dir, "twcs"), "in_response_to_tweet_id", "response_tweet_id")
    return rows, links(raw, "tweet_id", "in_response_to_tweet_id", "response_tweet_id")


#: The same view in SQL; queries append their own parts.
MSG = r"""raw AS (SELECT tweet_id, max(struct_pack(line_no := line_no, author_id := author_id, inbound := inbound, created_at := created_at, txt := text, up := in_response_to_tweet_id)) AS r FROM twcs WHERE tweet_id IS NOT NULL GROUP BY 1),
flat AS (SELECT tweet_id, lower(regexp_replace(r.author_id, '^[\s@]+|\s+$', '', 'g')) AS author, lower(regexp_replace(r.inbound, '\s', '', 'g')) AS i, trim(r.created_at) AS c, r.txt AS text, regexp_replace(r.up, '[\s"''\[\]]', '', 'g') AS s FROM raw),
msg AS (SELECT tweet_id, author, CASE WHEN i IN ('true', '1') THEN true WHEN i IN ('false', '0') THEN false ELSE author NOT IN (SELECT lower(author_id) FROM brand_accounts) END AS inbound,
  CASE WHEN regexp_matches(c, '^[0-9]{10}$') THEN to_timestamp(c::DOUBLE) WHEN regexp_matches(c, '^[0-9]{13}$') THEN to_timestamp(c::DOUBLE / 1000)
    WHEN regexp_matches(c, '^[A-Z][a-z]{2} ') THEN try_strptime(c, '%a %b %d %H:%M:%S %z %Y')::TIMESTAMPTZ
    WHEN regexp_matches(c, '^[0-9]{1,2} [A-Z]') THEN try_strptime(replace(c, ' UTC', ''), '%d %b %Y %H:%M:%S')::TIMESTAMPTZ
    WHEN c LIKE '0000%' THEN NULL ELSE try_cast(c AS TIMESTAMPTZ) END AS ts, text,
  nullif(regexp_extract(CASE WHEN regexp_full_match(s, '[0-9]{1,3}(,[0-9]{3})+') THEN replace(s, ',', '') ELSE s END, '^([0-9]+)(\.0+)?$', 1), '') AS parent_id FROM flat)"""

B = r"[ \t\n\x0b\f\r\x{00a0}\x{2003}\x{3000}]"


def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^{B}+|{B}+$', '', 'g')"


def sql_normalize(e: str) -> str:
    inner = f"regexp_replace(regexp_replace(lower({e}), 'https?://[^ \\t\\n\\r]+', ' ', 'g'), '@[a-z0-9_]+', ' ', 'g')"
    return sql_strip(f"regexp_replace({inner}, '{B}+', ' ', 'g')")


def sql_words(e: str) -> str:
    return f"len(list_filter(regexp_split_to_array({e}, '{B}+'), lambda x: x <> ''))"


def sql_anaphoric(e: str) -> str:
    words = ", ".join(f"'{w}'" for w in ANAPHORA)
    phrases = "".join(" OR contains(lower({}), '{}')".format(e, p.replace("'", "''")) for p in ANAPHORIC_PHRASES)
    return f"(list_has_any(regexp_extract_all(lower({e}), '([\\p{{L}}\\p{{N}}_]+)', 1), [{words}]){phrases})"
