"""Rule engines over texts: multi-label tagging, first match, and matched signals, from tables of patterns.

Rules are data: (label, pattern) pairs that both Java and RE2 read alike. All rules of a table are evaluated in one
projection, without a join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own catalogue of topics, in order of precedence.
TOPICS = (
    ("security", "hacked|stolen|stranger|phishing|someone in|took my login|security questions"),
    ("orders", "tracking|delivery|courier|pickup|order has|shipped|parcel"),
    ("repair", "repair|mend|replacement|mail in box"),
    ("billing", "refund|charged|charge of|billed|invoice|receipt|gift code|card is declined|debit|purchase"),
    ("battery", "battery|charging|charge |power on|plugged in|akku|batterie|bater"),
    ("connectivity", "wifi|wi-fi|bluetooth|network|no service|mobile data|hotspot|airplane mode"),
    ("update", "update|install|version|beta of|going back from"),
    ("hardware", "screen|camera|speaker|microphone|button|keys on|touch area|keyboard"),
    ("account", "locked|disabled|password|passcode|sign in|orchard id|account"),
    ("cloud", "skybox|backup|photos|contacts"),
    ("media", "music|podcast|playlist|audiobook|lyrics|downloads in"),
    ("how_to", "how do i|is there a way|where is the setting|can i use|what is the difference"),
)
#: Our own signals of risk.
RISKS = (
    ("SAFETY", "scorching|smoke|fire|burn|swollen|sparks|melt"),
    ("SECURITY", "hacked|stolen|phishing|took my login|stranger"),
    ("DAMAGE", "cracked|bent|dent|in the rain|broken"),
    ("FINANCIAL", "not mine|billed .{0,12}twice|disputes|unauthori"),
    ("LEGAL", "lawyer|lawsuit|police|ombudsman"),
)
DISTRESS = "furious|unacceptable|fed up|hate|[!?]{2,}"
LEVELS = {"SAFETY": "critical", "SECURITY": "critical", "DAMAGE": "high", "FINANCIAL": "high", "LEGAL": "high"}


def labels(text: Column, rules=TOPICS) -> Column:
    """All labels whose pattern is met, in the table's order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in rules]))


def first_label(text: Column, rules=TOPICS, other: str = "other") -> Column:
    low = F.lower(text)
    out = None
    for k, p in rules:
        out = F.when(low.rlike(p), F.lit(k)) if out is None else out.when(low.rlike(p), F.lit(k))
    return out.otherwise(F.lit(other))


def signals(text: Column, rules=RISKS) -> Column:
    """``LABEL:first match`` of every pattern that is met."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.concat(F.lit(k + ":"), F.regexp_extract(low, f"({p})", 1))) for k, p in rules]))


def level(text: Column) -> Column:
    low = F.lower(text)
    met = {k: low.rlike(p) for k, p in RISKS}
    return F.when(met["SAFETY"] | met["SECURITY"], "critical").when(met["DAMAGE"] | met["FINANCIAL"] | met["LEGAL"], "high").when(low.rlike(DISTRESS), "medium").otherwise("low")


def sql_labels(e: str, rules=TOPICS) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({e}), '{p}') THEN '{k}' END" for k, p in rules) + "], lambda x: x IS NOT NULL)"


def sql_first(e: str, rules=TOPICS, other: str = "other") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({e}), '{p}') THEN '{k}'" for k, p in rules) + f" ELSE '{other}' END"


def sql_signals(e: str, rules=RISKS) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({e}), '{p}') THEN '{k}:' || regexp_extract(lower({e}), '({p})', 1) END" for k, p in rules) + "], lambda x: x IS NOT NULL)"


def sql_level(e: str) -> str:
    m = lambda *ks: " OR ".join(f"regexp_matches(lower({e}), '{p}')" for k, p in RISKS if k in ks)
    return f"CASE WHEN {m('SAFETY', 'SECURITY')} THEN 'critical' WHEN {m('DAMAGE', 'FINANCIAL', 'LEGAL')} THEN 'high' WHEN regexp_matches(lower({e}), '{DISTRESS}') THEN 'medium' ELSE 'low' END"
