"""Scalar functions on the raw message dump: link ids, flags, instants. All JVM side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bare_id(c: Column) -> Column:
    """The one id in a link field: quotes, blanks, brackets, a trailing ``.0`` and thousands commas are dressing.

    Null for null, blank, words (``nan``) and fields that hold anything else.
    """
    s = F.regexp_replace(c, r"[\s\"'\[\]\u00A0]", "")
    s = F.when(s.rlike(r"^[0-9]{1,3}(,[0-9]{3})+$"), F.replace(s, F.lit(","), F.lit(""))).otherwise(s)
    got = F.regexp_extract(s, r"^([0-9]+)(\.0+)?$", 1)
    return F.when(got != "", got)


def handle_key(c: Column) -> Column:
    """Account ids as compared: no padding, no leading @, lower case."""
    return F.lower(F.regexp_replace(c, r"^[\s@]+|\s+$", ""))


def flag(c: Column) -> Column:
    """true / false / 1 / 0 in any case and padding; null for everything else."""
    s = F.lower(F.regexp_replace(c, r"\s+", ""))
    return F.when(s.isin("true", "1"), F.lit(True)).when(s.isin("false", "0"), F.lit(False))


def instant(c: Column) -> Column:
    """The notations of created_at as a timestamp (session time zone UTC); null where unreadable.

    Understood: ``Tue Oct 31 22:10:47 +0000 2017``, ISO with T or blank, with or without zone, seconds and
    milliseconds since 1970, ``31 Oct 2017 22:10:47 UTC``.
    """
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    epoch = F.when(s.rlike(r"^[0-9]{10}$"), s.cast("long")).when(s.rlike(r"^[0-9]{13}$"), (s.cast("long") / 1000))
    return (
        F.when(s.rlike(r"^[A-Za-z]{3} [A-Za-z]{3} [0-9]{1,2} "), F.try_to_timestamp(F.substring(s, 5, 60), F.lit("MMM d HH:mm:ss Z yyyy")))
        .when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.when(~s.startswith("0000"), F.try_to_timestamp(s)))
        .when(epoch.isNotNull(), F.timestamp_seconds(epoch))
        .when(s.rlike(r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4} "), F.try_to_timestamp(F.regexp_replace(s, r" (UTC|GMT|Z)$", ""), F.lit("d MMM yyyy HH:mm:ss")))
    )


def visible(c: Column) -> Column:
    """Whether a text has a character one can see: not white space, control, format or other invisible ones."""
    return F.coalesce(F.regexp_replace(c, r"[\s\p{Z}\p{C}\u00AD\u034F\u115F\u1160\u17B4\u17B5\u180B-\u180F\u2800\u3164\uFE00-\uFE0F\uFFA0]", "") != "", F.lit(False))


def latest(twcs: DataFrame, *columns: str) -> DataFrame:
    """One row per tweet_id, that with the highest line_no; rows without a tweet_id give none.

    Ties of line_no are settled by the largest row, so that the result is defined.
    """
    rest = [c for c in columns if c not in ("tweet_id", "line_no")]
    kept = F.max(F.struct(F.coalesce("line_no", F.lit(-1)).alias("line_no"), *rest))
    return twcs.filter("tweet_id is not null").groupBy("tweet_id").agg(kept.alias("_r")).select("tweet_id", "_r.*")
