"""Personal information in free text: found by bootstrapped contextual extraction, replaced by typed placeholders.

1. Seeds. Entities whose form alone, or a cue word beside them, gives them away: email addresses, phone numbers with a country
   or area prefix, identity numbers behind words such as *passport*, titles with a capitalised name, house numbers with a kind of street.
2. Candidates. Every text yields number-like runs and pairs of capitalised words, each with its lexical pattern: the two
   words before it. They are counted, per (kind, pattern, instance), into one narrow table.
3. The graph of patterns and instances is scored in turns by joins of that table: a pattern scores by the share of known instances
   among its distinct ones, an instance becomes known by the patterns that score high. For names the instances are taken apart
   into tokens, for numbers into shapes, so that a pattern found with some persons finds others.
4. High-confidence patterns and tokens, with the seeds' own forms, are applied to every text.

Support is absolute and the same at every size: a number pattern needs three known instances, a name pattern or token two. A pair
of capitalised words is no person where the contexts it is met in surely are none (see ``_impure``), however often it is met; a pair
of two name tokens known from others is a person all the same. What is learned is a table. Up to ``most`` rows (a size checked by a count) it
is broadcast; beyond that it is joined to the words, pairs and patterns of each text, with the same findings.

Defined results: null and empty texts have no entities and stay as they are; rows with a null id are left out of the findings;
overlapping entities are settled by order (email, identity number, phone, address, name); repeated rows give one
finding per type; empty tables give empty results; the text outside of placeholders is not changed.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlens.sources.tables import ship, stage, unstage

TYPES = ("email", "id_number", "phone", "address", "name")
_L, _U = "[^\\W\\d_]", "A-ZÀ-ÖØ-Þ"

# ---- seed forms --------------------------------------------------------------------------------------------------
EMAIL = re.compile(r"(?<![\w.@])(?:mailto:)?[a-z0-9][\w.+-]*@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}", re.I)
_AT, _DOT = r"(?:\s*[(\[{]\s*(?:at|ät|arroba|arobase|a)\s*[)\]}]\s*|\s+(?:at|arroba|arobase)\s+|\s+@\s+|＠)", r"(?:\s*[(\[{]\s*(?:dot|punkt|punto|point|\.)\s*[)\]}]\s*|\s+(?:dot|punkt|punto|point)\s+|\.)"
SPELLED_EMAIL = re.compile(rf"(?<![\w.@])(?!(?:is|am|are|was|me|up|here|home|work|look|stuck|only|runs?)\s+at\s)[a-z0-9][\w.+-]*(?P<at>{_AT})(?!\d+\b)[a-z0-9-]*[a-z][a-z0-9-]*(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}\b", re.I)
STRONG_PHONE = re.compile(r"(?<![\w+.])(?:\+\d{1,3}(?:[ .\-/]?\(?\d{1,5}\)?){2,6}|00\d{2}(?:[ .\-/]\d{1,5}){2,5}|\(\d{3,5}\) ?\d{3,4}[ .-]?\d{3,4}|555[ .-]?01\d\d)(?:\s*(?:ext|x|extension)\.?\s*\d{1,5})?(?![\w])")
WEAK_PHONE = re.compile(r"(?<![\w+./-])(?:\d{3}[ .-]\d{3}[ .-]\d{4}|\d{2}(?:[. ]\d{2}){4}|0\d{2,4}[/ -]\d{5,8}|0\d{9,10}|\d{3}[ -]\d{4})(?:\s*(?:ext|x|extension)\.?\s*\d{1,5})?(?![\w/-]|\.\d)")
_DIGIT_WORDS = "one|two|three|four|five|six|seven|eight|nine|zero|oh|double|triple|null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|zéro|un|deux|trois|quatre|cinq|sept|huit|neuf|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve"
SPOKEN_PHONE = re.compile(rf"\b(?:{_DIGIT_WORDS})(?:[ ,-]+(?:{_DIGIT_WORDS})){{5,}}\b", re.I)
_STREETS = "street|st|road|rd|lane|ln|avenue|ave|drive|dr|court|ct|close|terrace|crescent|boulevard|blvd|way|mews|place|pl|square|sq|hill|grove|gardens|row|walk|parade|highway|hwy|parkway|pkwy|rise|view|quay|wharf"
_UNIT = r"(?:(?:flat|unit|apt|apartment|suite|room)\.? ?\w{1,4}(?:\s*[,/]\s*|\s+))?"
EN_ADDRESS = re.compile(rf"(?<![\w.,$£€/-]){_UNIT}\d{{1,5}}[a-z]?,? (?:St\. )?(?:{_L}[\w'’-]* ){{1,3}}(?:{_STREETS})\b\.?(?:,? (?:apt|flat|unit|suite|#)\.? ?\w{{1,4}})?", re.I)
FR_ADDRESS = re.compile(rf"(?<![\w.,€-])\d{{1,4}}(?: ?(?:bis|ter|[a-d]))?,? (?:rue|avenue|boulevard|bd|place|chemin|impasse|quai|allée|cours|route|square|passage)\b(?: (?:de|du|des|la|le|les|l['’]|d['’])){{0,3}}[ '’]?{_L}[\w'’-]*(?: {_L}[\w'’-]*)?", re.I)
ES_ADDRESS = re.compile(rf"\b(?:calle|c/|avenida|avda\.?|av\.|plaza|paseo|camino|carretera|ronda|travesía|glorieta)(?: (?:de|del|la|los|las|el)){{0,2}} {_L}[\w'’-]*(?: {_L}[\w'’-]*){{0,2}},? (?:n[.º°]+ ?)?\d{{1,4}}(?:,? ?\d{{1,2}}[.º°ª]+ ?[A-Za-z]?)?", re.I)
DE_ADDRESS = re.compile(rf"\b{_L}[\w-]*(?:straße|strasse|str\.|platz|weg|gasse|allee|ufer|damm|ring|steig|graben)(?: (?:nr\.? )?)\d{{1,4}} ?[a-z]?\b", re.I)
_ADDRESSES = (EN_ADDRESS, FR_ADDRESS, ES_ADDRESS, DE_ADDRESS)
#: Cue words of numbers that an authority gives a person, and of numbers that are something else.
ID_CUES = re.compile(r"\b(?:ssn|my social|social security|passport|passeport|pasaporte|reisepass|(?:personal)?ausweis\w*|identity|identité|identidad|national (?:id|insurance)|nino|dni|nie|nif|cni|tax(?:payer)? ?(?:id|number|ref\w*)?|tin|steuer\w*|fiscal\w*|(?:driv\w+(?:['’]s)?|driver) licen[cs]e|licen[cs]e number|führerschein\w*|permis|permiso|carnet de conducir|sozialversicherung\w*|sécurité sociale|sécu|seguridad social|nhs|medicare|insurance number)\b")
NOT_ID_CUES = re.compile(r"\b(?:order|case|receipt|ref|reference|tracking|imei|serial|invoice|ticket|model|build|version|error|fall|caso|cas|pedido|commande|bestellung|rechnung|facture|factura|paid|sku|part|batch|code|system|step)\b")
PHONE_CUES = re.compile(r"\b(?:call|phone|tel|tél|téléphone|teléfono|telefon|mobile|cell|móvil|handy|number|numéro|número|nummer|ring|text|whatsapp|appelez|llámenme|ruft|reach me|get me)\b")
#: The shapes such numbers come in: digits and letters with single separators.
NUMBER = re.compile(r"(?<![\w@/#.+$£€-])(?:(?!(?:id|no|nr|ssn|dni|nie|nif|tin|is|es|ist|est|at|on)\b)[A-Z]{1,5}[ -]?)?\d(?:[ ./-]?\d|[A-Z]{1,2}(?=\d)){3,22}(?:(?-i:[ -]?[A-Z]{1,2})|-?[a-z]{1,2})?(?![\w@/]|-\d)", re.I)
TITLES = "mr|mrs|ms|mx|miss|dr|prof|sir|herr|frau|mme|mlle|madame|monsieur|m\\.|sr|sra|srta|señor|señora|don|doña"
_NAME_WORD = rf"[{_U}][\w’'-]*"
TITLED = re.compile(rf"\b(?:{TITLES})\b\.?\s+(?:{_NAME_WORD}\s+)?{_NAME_WORD}", re.I)
PAIR = re.compile(rf"(?<![\w@#/.-])([{_U}][\w’'-]+)(,? | [{_U}]\.? )([{_U}][\w’'-]+)(?![\w@])")
NAME_SEEDS = {"my name is", "je m'appelle", "me llamo", "ich heiße", "mein name ist", "mi nombre es", "mon nom est", "name is", "je m’appelle", "m'appelle", "name ist", "nombre es", "nom est", "signed"}

_WORDS = re.compile(r"[\w'’]+")
_SPACE = re.compile(r"\s+")


def pattern(text: str, start: int) -> str:
    """The lexical pattern of a place: up to two words before it on its line, lower case, digits masked."""
    line = re.split(r"[\n/;]| - |[.!?] ", text[max(0, start - 48) : start].lower())[-1]
    return " ".join(re.sub(r"\d+", "9", w) for w in _WORDS.findall(line)[-2:])


def _cue(text: str, start: int) -> str:
    """What stands before a number, as far as its cue can reach: the same clause, at most 40 characters."""
    return re.split(r"[\n;!?]| - | / |, |(?<!no)(?<!nr)(?<!tel)(?<!tél)\. ", text[max(0, start - 40) : start].lower())[-1]


def shape(value: str) -> str:
    return re.sub(r"[a-z]", "A", re.sub(r"\d", "9", value.lower()))


def _numbers(text: str) -> Iterator[re.Match]:
    for m in NUMBER.finditer(text):
        if sum(map(str.isdigit, m[0])) >= 5:
            yield m


def _common(low: str) -> bool:
    return any(ch.isdigit() for ch in low)


# ---- candidates --------------------------------------------------------------------------------------------------


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, pattern, instance, known): counts per batch."""
    for batch in batches:
        c: Counter[tuple[str, str, str, str]] = Counter()
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            if _common(text):
                strong = [m.span() for m in STRONG_PHONE.finditer(text)]
                for m in STRONG_PHONE.finditer(text):
                    c["number", pattern(text, m.start()), shape(m[0]), "phone"] += 1
                for m in _numbers(text):
                    if any(a < m.end() and m.start() < b for a, b in strong):
                        continue
                    cue = _cue(text, m.start())
                    known = "id_number" if ID_CUES.search(cue) and not NOT_ID_CUES.search(cue) else "other" if NOT_ID_CUES.search(cue) else ""
                    c["number", pattern(text, m.start()), shape(m[0]), known] += 1
            if text.isupper():
                continue
            for m in PAIR.finditer(text):
                left = pattern(text, m.start())
                if left:
                    a, b = m[1].lower(), m[3].lower()
                    c["name", left, f"{a} {b}", "name" if left in NAME_SEEDS or a in _TITLE_SET else ""] += 1
        rows = list(c.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k, _ in rows], pa.string()) for i in range(4)] + [pa.array([n for _, n in rows], pa.int64())], names=["kind", "pattern", "instance", "known", "n"])


Knowledge = tuple[dict[str, str], set[str], set[str]]  # patterns with their type, name tokens, pairs that are no persons
_TITLE_SET = set(TITLES.replace("\\.", "").split("|"))
_LEAST_NUMBER, _LEAST_NAME, _CUED = 3, 2, 0.25


class Learned:
    """What was learned, as a staged table of (kind, key, value), and its size."""

    def __init__(self, rows: DataFrame, most: int):
        self.rows, self.most = rows, most
        self.size = rows.count()

    def local(self) -> Knowledge | None:
        """All of it for a broadcast, or null where it is too large for one."""
        return knowledge((r["kind"], r["key"], r["value"]) for r in self.rows.collect()) if self.size <= self.most else None


def knowledge(rows) -> Knowledge:
    patterns, tokens, common = {f"name:{p}": "name" for p in NAME_SEEDS}, set(), set()
    for kind, key, value in rows:
        if kind == "number":
            patterns[key] = value
        elif kind == "cue":
            patterns[f"name:{key}"] = "name"
        else:
            (tokens if kind == "token" else common).add(key)
    return patterns, tokens, common


def _impure(met: str, cued: str):
    """Whether cues of names are surely fewer than a quarter of the distinct patterns a pair is met behind.

    1.65 standard errors below, so few contexts prove nothing; the rule is the same at every size.
    """
    n = F.col(met)
    return F.col(cued) / n + 1.65 * (_CUED * (1 - _CUED)) ** 0.5 / F.sqrt(n) < _CUED


def learn(texts: DataFrame, rounds: int = 3, most: int = 200_000) -> Learned:
    """Patterns with their type, name tokens, and pairs that are no persons, from a column ``text``."""
    cand = texts.mapInArrow(_candidates, "kind string, pattern string, instance string, known string, n long")
    cand = stage(cand.groupBy("kind", "pattern", "instance", "known").agg(F.sum("n").alias("n")), "pii-candidates")

    # numbers: patterns score by the known types of their instances, unknown instances by those of their shapes
    numbers = cand.filter("kind = 'number'")
    typed = numbers.filter("known <> ''")
    found = None
    for _ in range(rounds):
        shapes = typed.groupBy("instance").agg(*[(F.sum(F.when(F.col("known") == k, F.col("n")).otherwise(0)) / F.sum("n")).alias(k) for k in ("phone", "id_number", "other")])
        scored = numbers.join(shapes, "instance", "left").select("pattern", "n", *[F.when(F.col("known") != "", (F.col("known") == k).cast("double")).otherwise(F.coalesce(k, F.lit(0.0))).alias(k) for k in ("phone", "id_number", "other")])
        by = scored.groupBy("pattern").agg(F.sum("n").alias("support"), *[(F.sum(F.col(k) * F.col("n")) / F.sum("n")).alias(k) for k in ("phone", "id_number", "other")])
        good = by.filter(F.col("support") >= _LEAST_NUMBER).select("pattern", F.when((F.col("phone") >= 0.35) & (F.col("other") < 0.1), "phone").when((F.col("id_number") >= 0.8) & (F.col("other") < 0.05), "id_number").when(F.col("other") >= 0.8, "other").alias("type")).filter("type is not null")
        new = stage(good, "pii-number-patterns")
        unstage(found)
        found = new
        typed = numbers.join(found, "pattern", "left").withColumn("known", F.when(F.col("known") == "", F.coalesce("type", F.lit(""))).otherwise(F.col("known"))).drop("type").filter("known <> ''")

    # names: tokens known from seeds, patterns by the share of distinct pairs with known tokens, and so on
    names = cand.filter("kind = 'name'")
    counted = stage(names.groupBy("instance").agg(F.count_distinct("pattern").alias("met"), F.count_distinct(F.when(F.col("known") == "name", F.col("pattern"))).alias("cued")), "pii-pairs")
    parts = F.filter(F.split("instance", " "), lambda t: (F.length(t) > 1) & ~t.isin(*_TITLE_SET))
    rare = stage(names.join(counted.filter(~_impure("met", "cued")).select("instance"), "instance").withColumn("tokens", parts), "pii-names")
    trusted = stage(rare.filter("known = 'name'").select("instance", "tokens").distinct(), "pii-trusted")
    spread = stage(rare.select("instance", "tokens").distinct().select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("pairs")), "pii-spread")
    known = good = None
    for k in range(rounds + 1):
        # a token must be met in trusted pairs, and not mostly in others: a word of the language is in pairs of all kinds
        support = trusted.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("support"))
        new = stage(support.join(spread, "token").filter((F.col("support") >= _LEAST_NAME) & (F.col("support") >= 0.25 * F.col("pairs"))).select("token"), "pii-tokens")
        unstage(known, trusted)
        known = new
        if k == rounds:
            break
        pairs = rare.select("pattern", "instance", F.explode("tokens").alias("token")).distinct().join(known.withColumn("hit", F.lit(1)), "token", "left").groupBy("pattern", "instance").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
        scored = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("support"), F.sum("hit").alias("hits"))
        new = stage(scored.filter((F.col("support") >= 3) & (F.col("hits") >= _LEAST_NAME) & (F.col("hits") >= 0.6 * F.col("support"))).select("pattern"), "pii-name-patterns")
        unstage(good)
        good = new
        trusted = stage(rare.join(good, "pattern", "left_semi").select("instance", "tokens").distinct(), "pii-trusted")
    # the patterns learned may show that a pair ruled out is a person after all
    cues = good.withColumn("cue", F.lit(True))
    shares = names.join(counted.filter(_impure("met", "cued")).select("instance"), "instance").join(cues, "pattern", "left").groupBy("instance").agg(F.count_distinct("pattern").alias("met"), F.count_distinct(F.when((F.col("known") == "name") | F.col("cue"), F.col("pattern"))).alias("cued"))
    shares = stage(shares, "pii-shares")
    person = F.col("cued") >= _CUED * F.col("met")
    more = shares.filter(person).withColumn("tokens", parts).select(F.explode("tokens").alias("token"))
    row = lambda df, kind, key, value: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), value.alias("value"))
    one = F.lit("name")
    rows = row(found, "number", "pattern", F.col("type")).unionByName(row(good, "cue", "pattern", one)).unionByName(row(known.unionByName(more).distinct(), "token", "token", one)).unionByName(row(shares.filter(~person), "common", "instance", F.lit("no person")))
    out = Learned(stage(rows, "pii-learned"), most)
    unstage(cand, found, counted, rare, spread, known, good, shares)
    return out


_AT_HOST = re.compile(r"\s(?:at|arroba|arobase)\s+[a-z0-9-]*[a-z][a-z0-9-]*\.[a-z]")
_SPELLED_DOT = re.compile(r"\b(?:dot|punkt|punto|point)\b", re.I)

# ---- application -------------------------------------------------------------------------------------------------


_TOKEN = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
_STREET_SET = set(_STREETS.split("|"))
_ROAD_SET = set("rue avenue boulevard bd place chemin impasse quai allée cours route square passage calle c avenida avda av plaza paseo camino carretera ronda travesía glorieta".split())
_DE_ROADS = ("straße", "strasse", "str.", "platz", "weg ", "gasse ", "allee ", "ufer ", "damm ", "ring ", "steig ", "graben ")
_SPOKEN_SET = set("three four five six seven eight nine zero cinq sept huit neuf fünf sechs sieben acht neun cinco seis siete ocho nueve".split())
_AT_SET = {"at", "arroba", "arobase", "ät", "a"}
_DOT_SET = {"dot", "punkt", "punto", "point"}
_ID_SET = set("ssn social passport passeport pasaporte reisepass ausweis personalausweis identity identité identidad national nino dni nie nif cni tax taxpayer tin steuer fiscal licence license driver führerschein permis permiso carnet sozialversicherung sécurité sécu seguridad nhs medicare insurance".split())
_ID_STEMS = ("ausweis", "personalausweis", "steuer", "sozialversicherung", "führerschein", "driv")
_PHONE_SET = set("call phone tel tél téléphone teléfono telefon mobile cell móvil handy number numéro número nummer ring text whatsapp appelez llámenme ruft reach get my mein mon mi".split())


class Finder:
    """Applies what was learned to one text after another. Tokens of the text choose which forms can apply at all."""

    def __init__(self, patterns: dict[str, str], tokens: set[str], common: set[str]):
        self.patterns, self.tokens, self.common = patterns, tokens, common
        cues = sorted((p[5:] for p in patterns if p.startswith("name:")), key=len, reverse=True)
        self.name_cues = set(cues)
        self.cue_list = [c.replace("’", "'") for c in cues]
        self.loose_name = re.compile(r"\b(" + "|".join(r"\W{1,3}".join(re.escape(w) for w in p.split()) for p in cues) + r")\b[\s,:]+((?:(?:" + TITLES + rf")\.?\s+)?{_L}[\w’'-]*,? (?:{_L}\.? )?{_L}[\w’'-]*)", re.I) if cues else None
        last = lambda kind: {p.split()[-1] for p, k in patterns.items() if k == kind and p}
        self.id_words = _ID_SET | {t for w in last("id_number") for t in _TOKEN.findall(w)}
        self.phone_words = _PHONE_SET | {t for w in last("phone") for t in _TOKEN.findall(w)}
        self.cue_words = {_TOKEN.findall(c)[-1] for c in self.cue_list}

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []

        def add(a: int, b: int, kind: str) -> None:
            if all(b <= x or y <= a for x, y, _ in out):
                out.append((a, b, kind))

        low = text.lower()
        toks = set(_TOKEN.findall(low))
        if "@" in text or "＠" in text:
            for m in EMAIL.finditer(text):
                add(*m.span(), "email")
        if (toks & _AT_SET and (toks & _DOT_SET or "(" in text or "[" in text or "{" in text or _AT_HOST.search(low))) or " @ " in text or "＠" in text:
            for m in SPELLED_EMAIL.finditer(text):
                if not m["at"].strip().isalpha() or _SPELLED_DOT.search(m[0]) or "." in text[m.end("at") : m.end()]:
                    add(*m.span(), "email")
        digits = len(_DIGIT.findall(text))
        if digits:
            if digits >= 5 and (toks & self.id_words or any(t.startswith(_ID_STEMS) for t in toks)):
                for m in _numbers(text):
                    cue = _cue(text, m.start())
                    if not NOT_ID_CUES.search(cue) and (ID_CUES.search(cue) or (self.patterns.get(pattern(text, m.start())) == "id_number" and not PHONE_CUES.search(cue))):
                        add(*m.span(), "id_number")
            forms = [STRONG_PHONE] * ("+" in text or "00" in text or "(" in text or "555" in text) + [WEAK_PHONE] * bool(toks & self.phone_words) if digits >= 7 else []
            for rx in forms:
                for m in rx.finditer(text):
                    if sum(map(str.isdigit, m[0])) < 7:
                        continue
                    cue = _cue(text, m.start())
                    if NOT_ID_CUES.search(cue) or ID_CUES.search(cue):
                        continue
                    if rx is STRONG_PHONE or PHONE_CUES.search(cue) or self.patterns.get(pattern(text, m.start())) == "phone" or re.match(r"\s*(?:is my|ist mein|est mon|es mi)\b", low[m.end() : m.end() + 12]):
                        add(*m.span(), "phone")
            forms = [EN_ADDRESS] * bool(toks & _STREET_SET) + [FR_ADDRESS, ES_ADDRESS] * bool(toks & _ROAD_SET) + [DE_ADDRESS] * any(w in low for w in _DE_ROADS)
            for rx in forms:
                for m in rx.finditer(text):
                    if self._address(text, m, rx):
                        add(*m.span(), "address")
        if len(toks & _SPOKEN_SET) >= 1:
            for m in SPOKEN_PHONE.finditer(text):
                add(*m.span(), "phone")
        self._names(text, low, toks, add)
        return sorted(out)

    @staticmethod
    def _address(text: str, m: re.Match, rx: re.Pattern) -> bool:
        if rx is not EN_ADDRESS:
            return True
        body = re.sub(rf"^{_UNIT}\d+[a-z]?,? ", "", m[0], flags=re.I).split()
        words = [w for w in body if w.lower().rstrip(".,") not in ("apt", "flat", "unit", "suite")]
        if any(w.lower().strip(".,") in _NO_STREET_NAME for w in words[:-1]):
            return False
        if all(w[:1].isupper() for w in words if w[:1].isalpha() and len(w) > 2):
            return True
        before = text[max(0, m.start() - 24) : m.start()].lower()
        return bool(re.search(r"\b(?:apt|flat|unit|suite)\b", m[0], re.I) or re.search(r"(?:live at|home is|deliver to:?|send it to|goes to|go to|up from|address:?|ship to)\s*$", before))

    def _names(self, text: str, low: str, toks: set[str], add) -> None:
        for m in TITLED.finditer(text) if toks & _TITLE_SET else ():
            parts = m[0].split()
            title = parts[0].rstrip(".").lower()
            family = parts[-1]
            if not family[:1].isupper() or family.lower() in _NO_NAME or (parts[0].islower() and title in ("m", "don", "sir", "miss", "frau", "madame", "monsieur")):
                continue
            if not parts[0][:1].isupper() and not parts[0].isupper() and title not in ("herr", "frau", "señor", "señora"):
                continue
            if text.isupper() and family.lower() not in self.tokens:
                continue
            if family.lower() in self.tokens or len(parts) == 3 and parts[1].lower() in self.tokens or (title in ("mr", "mrs", "ms", "mx", "dr", "prof", "herr", "sr", "sra", "mme", "mlle")):
                add(*m.span(), "name")
        if not toks & self.tokens and not toks & self.cue_words:
            return
        shouted = text.isupper()
        # in texts set in capitals or title case a capital says nothing
        parts = text.split()
        styled = shouted or sum(w[:1].isupper() for w in parts) > 0.6 * len(parts)
        for m in PAIR.finditer(text) if toks & self.tokens else ():
            a, b = m[1].lower(), m[3].lower()
            if a in _TITLE_SET:
                continue
            hits = self._known(a) + self._known(b)
            if not hits or a in _NO_NAME or b in _NO_NAME or (not styled and (m[3].isupper() and len(b) < 4)):
                continue
            ahead, behind = _TOKEN.match(low, m.end() + 1), _TOKEN.findall(low[max(0, m.start() - 20) : m.start()])
            if hits < 2 and {f"{a} {b}", f"{b} {ahead[0] if ahead else ''}", f"{behind[-1] if behind else ''} {a}"} & self.common:
                continue
            if hits == 2 and not (shouted and m[2] == ", ") or not styled:
                add(*m.span(), "name")
        if not self.loose_name or not toks & self.cue_words:
            return
        plain = low.replace("’", "'")
        if any(c in plain for c in self.cue_list):
            for m in self.loose_name.finditer(text):
                parts = re.findall(r"[\w’'-]+", m[2])
                if any(p.lower() in _NO_NAME for p in parts):
                    continue
                known = sum(self._known(p.lower()) for p in parts)
                proper = all(p[:1].isupper() for p in parts)
                if known >= (1 if proper and not shouted else 2) or (proper and not shouted and not known and m[1].lower().replace("’", "'") in NAME_SEEDS):
                    add(*m.span(2), "name")

    def _known(self, word: str) -> int:
        return int(word in self.tokens or ("-" in word and any(p in self.tokens for p in word.split("-"))))


#: Words that stand between a number and a word like street without being a street's name.
_NO_STREET_NAME = set("the a an of on in at to for from with and or my your our his her this that is was are were been days weeks hours minutes seconds years months times percent dollars euros people cases photos files evenings gigabytes megabytes pm am".split())
_NO_NAME = set("the a an my your our i we you he she it they is was are and or of in on at to for from team support customer service sir madam everyone anybody nobody please thanks".split())


def _keys(text: str) -> set[tuple[str, str]]:
    """All that a Finder may look up for a text: its words, neighbouring words, and the patterns of its numbers."""
    low = text.lower()
    words = _WORDS.findall(low.replace("’", "'")) + _WORDS.findall(low)
    out = {("token", t) for t in {*words, *re.findall(r"[\w’'-]+", low), *_TOKEN.findall(low), *(p for w in re.findall(r"[\w’'-]+", low) for p in w.split("-"))}}
    for seq in (_WORDS.findall(low), _WORDS.findall(low.replace("’", "'"))):
        out |= {("cue", w) for w in seq} | {("cue", f"{a} {b}") for a, b in zip(seq, seq[1:])}
    plain = re.findall(r"[\w’'-]+", low)
    toks = _TOKEN.findall(low)
    out |= {("common", f"{a} {b}") for seq in (plain, toks) for a, b in zip(seq, seq[1:])}
    out |= {("common", f"{m[1].lower()} {m[3].lower()}") for m in PAIR.finditer(text)}
    out |= {("common", f"{m[3].lower()} {t}") for m in PAIR.finditer(text) for t in toks} | {("common", f"{t} {m[1].lower()}") for m in PAIR.finditer(text) for t in toks}
    for rx in (NUMBER, STRONG_PHONE, WEAK_PHONE):
        out |= {("number", pattern(text, m.start())) for m in rx.finditer(text)}
    return out


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, kinds, keys = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            for kind, key in _keys(text):
                at.append(i)
                kinds.append(kind)
                keys.append(key)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(keys, pa.string())], names=["at", "kind", "key"])


def _with_knowledge(part: DataFrame, learned: Learned):
    """The rows, with a column ``known`` of what their text may look up where that is not broadcast, and a maker of finders."""
    local = learned.local()
    if local is not None:
        shared = part.sparkSession.sparkContext.broadcast(local)
        return part.withColumn("known", F.lit(None).cast("string")), lambda: (lambda _, finder=Finder(*shared.value): finder)
    texts = part.select("text").filter("text is not null").distinct().select(F.md5("text").alias("at"), "text")
    hits = texts.mapInArrow(_asked, "at string, kind string, key string").join(learned.rows, ["kind", "key"]).groupBy("at").agg(F.to_json(F.collect_list(F.array("kind", "key", "value"))).alias("known"))  # as long as the text
    own = part.withColumn("at", F.md5("text")).join(hits, "at", "left").drop("at")
    return own, lambda: (lambda known: Finder(*knowledge(json.loads(known) if known else ())))


def find(rows: DataFrame, learned: Learned, id_cols: tuple[str, ...], text_col: str) -> DataFrame:
    """The id columns, pii_type: distinct findings of each row."""
    names, n = [f"id{i}" for i in range(len(id_cols))], len(id_cols)
    part = rows.select(*[F.col(c).cast("string").alias(k) for c, k in zip(id_cols, names)], F.col(text_col).alias("text")).filter("text is not null")
    part, maker = _with_knowledge(part, learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = maker()
        for batch in batches:
            at, kinds = [], []
            for k, (text, known) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())):
                for kind in {s[2] for s in finder(known).spans(text)}:
                    at.append(k)
                    kinds.append(kind)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(take) for i in range(n)] + [pa.array(kinds, pa.string())], names=[*names, "pii_type"])

    found = part.select(*names, "text", "known").mapInArrow(run, ", ".join(f"{k} string" for k in names) + ", pii_type string")
    return found.select(*[F.col(k).alias(c) for k, c in zip(names, id_cols)], "pii_type")


def masked(rows: DataFrame, learned: Learned, id_col: str, text_col: str) -> DataFrame:
    """id, masked: every text with its entities replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS], [NAME]; null stays null."""
    part, maker = _with_knowledge(rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")), learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = maker()
        for batch in batches:
            out = []
            for text, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for a, b, kind in reversed(finder(known).spans(text) if text else []):
                    text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "masked"])

    return part.select("id", "text", "known").mapInArrow(run, "id string, masked string").withColumnRenamed("id", id_col)


def texts_of(*columns: tuple[DataFrame, str]) -> DataFrame:
    out = None
    for df, c in columns:
        part = df.select(F.col(c).alias("text")).filter("text is not null")
        out = part if out is None else out.unionByName(part)
    ship(out.sparkSession)
    return out
