"""Broken prompt and response pairs: clauses of a response are tagged by a conditional random field.

Tags: answer, courtesy, refusal, echo, foreign, unfinished. The coverage of the tags makes the defect of the pair:
``empty`` (no clause with words of its own), ``copy`` (echo covers it, nothing answers), ``truncated`` (the last
clause is unfinished), ``refusal`` (a refusal and no answer beside it), ``other_language`` (foreign clauses cover it).

The field is a linear chain over clauses. Its features are words and pairs of words, and measured ones: the share of a clause's word
pairs found in the prompt, its language against the prompt's, whose words they are, whether sentences of the corpus end or go on where it
ends, links, length and place. It is fitted on the driver to at most ``sample`` rows (a parameter; the rows with the smallest
hashes of their id), of which sequences with a rare tag are all taken, up to ``per_tag`` each (a parameter too). Their clauses are
labelled by the vote of several weak sources: the measured ones, a few seed wordings of refusals and courtesies, links, and
a word model of what stands beside a refusal. Clauses that no source settles stay open, and the field is fitted to
all their readings. So it tags by the words and the company of a clause what no seed names. The sample also fits word
models of language and of role (who writes such words), which find pairs whose texts changed places: these have no defect.

How sentences end is counted over all responses: for groups of one to eight words, how often a sentence ends or goes
on behind them. A task counts a clause it meets again with its number. The counts stay in a table and are joined to the responses that end without a stop. Ends without a stop count once
for responses of the same letters and digits, so copies of a response say nothing about it.

Defined results: a null or blank response is empty; a null prompt has no echo and no language, so only empty,
truncated and refusal apply; rows with a null id are left out; every row of a repeated id is judged, and one row comes
out per id and defect; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlens.sources.tables import ship, stage, unstage

TAGS = ("answer", "courtesy", "refusal", "echo", "foreign", "unfinished")
ANSWER, COURTESY, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(6)
DEFECTS = ("empty", "copy", "truncated", "refusal", "other_language")

#: Seeds for the language models: words that only one of the languages uses much.
SEED_WORDS = {
    "en": "the and is are was with you your this that it of to in we for have on my not can what when before from",
    "fr": "le les des est et vous nous votre pour dans une depuis avec sur pas mon je que qui cela bonjour merci du au",
    "de": "der die das und ist nicht mit sie wir ihr für auf ein eine mein dem den ich zu seit vom kann wie bitte danke",
    "es": "el los las es y con para una mi tu su en por que se está desde pero como gracias hola del al cuando",
}
#: Seeds of refusals: ways to decline, by language.
REFUSAL_SEEDS = re.compile(
    r"\b(?:(?:can ?not|can['’]?t|could not|unable to|not able to|not (?:be )?(?:permitted|allowed|authori[sz]ed)(?: to)?|will not(?: be able to)?|won['’]?t|do(?:es)? not|must not|may not) (?:\w+ ){0,3}?(?:help|assist|answer|respond|comment|discuss|advise|provide|give|handled?|look into|talk|share|continue|offer|support)"
    r"|(?:must|have to|need to) (?:refuse|decline)|(?:refuse|decline) (?:to|this)|rather not|choose not to|outside what|no answer can|leave this (?:one )?unanswered|no way for us to|cannot be (?:handled|answered)|not something (?:i|we) (?:can|may)"
    r"|nicht (?:beantworten|helfen|weiterhelfen)|ablehnen|nichts sagen|keine (?:auskunft|antwort|hilfe)|darf ich nicht|dürfen wir (?:hier )?nicht"
    r"|refuser|pas (?:répondre|autorisé|en mesure|vous aider)|impossible de (?:vous )?(?:aider|répondre)|aucune réponse"
    r"|no podemos (?:responder|ayudar|contestar)|rechazar|no estamos autorizados|no puedo (?:responder|ayudar|contestar)|imposible (?:ayudar|responder))\b"
)
#: Words by which a clause that declines something goes on to offer, or only puts it off.
LIMIT_SEEDS = re.compile(r"\b(?:but|instead|before|until|yet|aber|sondern|vor|bis|mais|avant|plutôt|pero|antes|sino|hasta)\b")
#: Seeds of courtesies: openings, sympathy and closings that offer nothing.
COURTESY_SEEDS = re.compile(
    r"^\W*(?:(?:thank|thanks|hello|hi|hey|sorry|apologies|glad|happy|best|regards|cheers|enjoy|have a|let us know|good (?:question|morning|afternoon|evening|day)|we (?:are glad|appreciate|understand|hear you))\b"
    r"|(?:merci|bonjour|bonsoir|bonne|cordialement|désolé|à bientôt)\b|(?:danke|hallo|guten|gute|viele grüße|tschüss|es tut)\b|(?:gracias|hola|buen\w*|saludos|hasta luego|lo sentimos)\b)"
)
PLACEHOLDERS = {"none", "null", "nan", "na", "no text", "empty", "nil", "undefined", "blank", "no reply", "no message", "n a", "notext"}

_LINK = re.compile(r"https?://\S*|www\.\S+", re.I)
_HANDLE = re.compile(r"@\w+")
_SIGNATURE = re.compile(r"\^\s?[^\W\d_]{1,3}\b")
_CLAUSE = re.compile(r"(?<=[.!?…])\s+|\n+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_ENDED = re.compile(r"(?:[.!?][)\]\"'”»*]*|[)\]\"”»*])$")
_CUT = re.compile(r"\s*[\[(]?\s*(?:\.\.+|…)\s*[\])]?$")
_AFTER = re.compile(r"[^\w.!?…)\]\"'”»*:,;/&=-]+$")
_DIGITS = re.compile(r"\d+")
_DIGIT = re.compile(r"\d")
_ORDERS = (1, 2, 3, 5, 8)
_HELD = 100_000  # distinct clauses a worker holds before it passes counts on, or remembers


def _h(x: str) -> int:
    h = xxhash.xxh64_intdigest(x)
    return h - (1 << 64) if h >> 63 else h


def _tokens(text: str) -> list[str]:
    """Words and whole links in lower case, digits masked; a link is one token."""
    low = _DIGITS.sub("9", text.lower())
    if "http" not in low and "www." not in low:
        return _WORD.findall(low)
    low, out, at = text.lower(), [], 0
    for m in _LINK.finditer(low):
        out += _WORD.findall(_DIGITS.sub("9", low[at : m.start()]))
        out.append(_DIGIT.sub("9", m[0].rstrip(".,;:!?…)\"'”*[(")))
        at = m.end()
    return out + _WORD.findall(_DIGITS.sub("9", low[at:]))


def own_text(text: str | None) -> str:
    """What a response says itself: without handles and signature initials."""
    text = text or ""
    if "@" in text:
        text = _HANDLE.sub(" ", text)
    return (_SIGNATURE.sub(" ", text) if "^" in text else text).strip()


def is_empty(text: str | None) -> bool:
    words = [w.lower() for w in _WORD.findall(own_text(text))]
    return not words or " ".join(words) in PLACEHOLDERS


def clauses(text: str) -> list[str]:
    return [c for c in (x.strip() for x in _CLAUSE.split(own_text(text))) if _WORD.search(c)]


def _stops(text: str) -> bool:
    """Whether a text ends with a full stop, whatever signs follow it."""
    t = _AFTER.sub("", text)
    return bool(_ENDED.search(t)) and not _CUT.search(t)


def _marked(text: str) -> bool:
    """Whether the end carries dots or a bracket with dots, as a cut does."""
    return bool(_CUT.search(_AFTER.sub("", own_text(text))))


def _own_key(text: str) -> int:
    """Equal for copies of a response: its letters and digits, in any dress and order of its fields."""
    return _h("".join(sorted(c for c in own_text(text).casefold() if c.isalnum())))


def open_end(text: str) -> list[str] | None:
    """The last clause's tokens, where a response ends without a full stop; null where it has one or no words.

    A leading ``^`` stands for the start of the clause.
    """
    t = own_text(text)
    if not _AFTER.sub("", t) or _stops(t):
        return None
    parts = clauses(text)
    return ["^", *_tokens(parts[-1])][-_ORDERS[-1] :] if parts else None


def end_keys(last: list[str]) -> dict[int, str]:
    """The groups of last tokens, by order; a short clause is its own longest group."""
    words = len(last) - (last[0] == "^")
    return {n: " ".join(last[-n:]) for n in _ORDERS if n <= words} | ({_ORDERS[-1]: " ".join(last)} if last[0] == "^" else {})


def _count_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[tuple[str, bool]] = Counter()  # (clause, whether it ends with a stop)

    def counted() -> pa.RecordBatch:
        ends: Counter[str] = Counter()
        on: Counter[str] = Counter()
        for (part, stopped), many in seen.items():
            toks = ["^", *_tokens(part)]
            for i in range(1, len(toks) if stopped else len(toks) - 1):
                into = on if i + 1 < len(toks) else ends
                for n in _ORDERS:
                    if n <= i:
                        into[" ".join(toks[i - n + 1 : i + 1])] += many
                if i < _ORDERS[-1]:
                    into[" ".join(toks[: i + 1])] += many
        seen.clear()
        keys = list(ends.keys() | on.keys())
        return pa.RecordBatch.from_arrays([pa.array([_h(k) for k in keys], pa.int64()), pa.array([ends[k] for k in keys], pa.int64()), pa.array([on[k] for k in keys], pa.int64())], names=["gram", "ends", "on"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            parts = clauses(text) if text else []
            for k, part in enumerate(parts):
                seen[part, k + 1 < len(parts) or _stops(part)] += 1
        if len(seen) >= _HELD:
            yield counted()
    yield counted()


def _open_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, orders, grams, owns = [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            last = open_end(text) if text else None
            own = _own_key(text) if last else 0
            for n, key in (end_keys(last) if last else {}).items():
                ids.append(i)
                orders.append(n)
                grams.append(_h(key))
                owns.append(own)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(orders, pa.int32()), pa.array(grams, pa.int64()), pa.array(owns, pa.int64())], names=["id", "order", "gram", "own"])


def breaks_off(last: list[str] | None, seen: list[tuple[int, int, int, int]], marked: bool = False) -> bool:
    """Whether a response without a stop ends inside a sentence.

    seen: (order, ends, goes on, loose) of its groups of last words: how often a sentence of the corpus ends behind
    the group with a stop, goes on, or ends a distinct response without a stop (this one among them). A last word or link that occurs nowhere
    inside or at the stop of a sentence is a broken one. Else the longest group that is known decides: broken if sentences go on
    behind it twenty times as often as they end. At an end marked with dots, a last pair of words that no sentence has is a broken
    word, even if the piece is a word of its own elsewhere. Where a group is only known from loose ends, its last word must be one that ends
    sentences.
    """
    if not last:
        return False
    by = {n: (e, o, max(0, x - 1)) for n, e, o, x in seen}
    ends, on, _ = by.get(1, (0, 0, 0))
    if not ends + on:
        return True
    if last[-1].startswith(("http", "www.")):
        return False
    alone = ends
    if marked and 2 in by and not sum(by[2][:2]):
        return True
    for n in sorted(by, reverse=True):
        ends, on, loose = by[n]
        if n > 1 and ends + on + loose >= 3:
            return not alone if not ends + on else (ends + loose) * 20 < on
    return alone == 0


# ---- word models -------------------------------------------------------------------------------------------------


class WordModel:
    """Naive Bayes over words."""

    def __init__(self, counts: dict[str, Counter]):
        self.classes = sorted(counts)
        vocabulary = set().union(*counts.values()) if counts else set()
        total = {c: sum(counts[c].values()) + len(vocabulary) * 0.1 + 1 for c in self.classes}
        self.logs = {w: [math.log((counts[c][w] + 0.1) / total[c]) for c in self.classes] for w in vocabulary if sum(counts[c][w] for c in self.classes) > 1}

    def scores(self, words: list[str]) -> list[float]:
        known = [x for x in map(self.logs.get, words) if x]
        return [sum(c) for c in zip(*known)] if known else [0.0] * len(self.classes)


def _plain_words(text: str) -> list[str]:
    low = text.lower()
    if "@" in low:
        low = _HANDLE.sub(" @ ", low)
    if "http" in low or "www." in low:
        low = _LINK.sub(" ", low)
    return _WORD.findall(_DIGITS.sub("9", low))


def fit_words(rows: list[tuple[str | None, str | None]]) -> tuple[WordModel, WordModel]:
    seeds = {lang: set(ws.split()) for lang, ws in SEED_WORDS.items()}
    languages: dict[str, Counter] = {c: Counter() for c in seeds}
    roles: dict[str, Counter] = {"brand": Counter(), "customer": Counter()}
    for prompt, response in rows:
        for role, text in (("customer", prompt), ("brand", response)):
            ws = _plain_words(text or "")
            roles[role].update(set(ws))
            hits = sorted(((sum(w in s for w in ws), lang) for lang, s in seeds.items()), reverse=True)
            if hits[0][0] >= 2 and hits[0][0] >= 2 * hits[1][0]:
                languages[hits[0][1]].update(ws)
    return WordModel(languages), WordModel(roles)


class Reader:
    """Texts to measured clauses, with the fitted word models. What is told by a clause alone is remembered."""

    def __init__(self, languages: WordModel, roles: WordModel):
        self.languages, self.roles = languages, roles
        self._known: dict[str, tuple] = {}

    def __getstate__(self):
        return {"languages": self.languages, "roles": self.roles, "_known": {}}

    def language(self, words: list[str]) -> tuple[int, float]:
        """The likeliest language and its lead in nats over the next."""
        s = self.languages.scores(words)
        order = sorted(range(len(s)), key=lambda k: -s[k])
        return (order[0], s[order[0]] - s[order[1]]) if len(order) > 1 and any(s) else (-1, 0.0)

    def customer_like(self, text: str) -> float:
        b, c = self.roles.scores(list(set(_plain_words(text))))
        return c - b

    def swapped(self, prompt: str | None, response: str | None) -> bool:
        return bool(prompt and response) and self.customer_like(response) > 2 and self.customer_like(prompt) < -2

    def _clause(self, part: str) -> tuple[list[str], list[tuple[str, str]], int, float, bool, int]:
        got = self._known.get(part)
        if got is None:
            if len(self._known) >= _HELD:
                self._known.clear()
            ws = _plain_words(part)
            b, c = self.roles.scores(list(set(ws)))
            got = self._known[part] = (ws, list(zip(ws, ws[1:])), *self.language(ws), bool(_LINK.search(part)), (c - b > 2) - (b - c > 2))
        return got

    def measure(self, prompt: str | None, response: str, broken: bool) -> list[dict]:
        asked = _plain_words(own_text(prompt))
        pairs = set(zip(asked, asked[1:]))
        own_language, lead = self.language(asked)
        out = []
        parts = clauses(response)
        for k, part in enumerate(parts):
            ws, grams, lang, sure, link, role = self._clause(part)
            echo = sum(g in pairs for g in grams) / len(grams) if grams else float(bool(ws) and ws[0] in asked and len(asked) < 4)
            foreign = own_language >= 0 and lang >= 0 and lang != own_language and lead > 3 and sure > 3
            out.append({"words": ws, "echo": echo, "foreign": foreign, "broken": broken and k == len(parts) - 1, "link": link, "role": role, "first": k == 0, "last": k == len(parts) - 1, "part": part})
        return out


# ---- weak sources ------------------------------------------------------------------------------------------------


def refusal_source(m: dict) -> bool:
    text = m["part"].lower()
    declined = REFUSAL_SEEDS.search(text)
    return not m["link"] and bool(declined) and not LIMIT_SEEDS.search(text, declined.end())


def courtesy_source(m: dict) -> bool:
    return not m["link"] and bool(COURTESY_SEEDS.search(m["part"].lower()))


def seed_tags(measured: list[dict]) -> list[int]:
    """What the sources say one by one, answers where they are silent: the yardstick that the field is held against."""
    return [ECHO if m["echo"] >= 0.6 and len(m["words"]) >= 3 else UNFINISHED if m["broken"] else REFUSAL if refusal_source(m) else COURTESY if courtesy_source(m) else FOREIGN if m["foreign"] else ANSWER for m in measured]


class Company:
    """Which words stand beside a refusal and which in responses without one: a source for courtesies and answers."""

    def __init__(self, sequences: list[list[dict]]):
        counts: dict[str, Counter] = {"beside": Counter(), "else": Counter()}
        for measured in sequences:
            refused = [refusal_source(m) for m in measured]
            for m, r in zip(measured, refused):
                if not r and not m["link"] and m["echo"] < 0.6:
                    counts["beside" if any(refused) else "else"].update(set(m["words"]))
        self.model = WordModel(counts) if counts["beside"] else None

    def lead(self, m: dict) -> float:
        """Nats in favour of a refusal's company, per word."""
        if self.model is None or not m["words"]:
            return 0.0
        beside, other = self.model.scores(list(set(m["words"])))
        return (beside - other) / len(set(m["words"]))


def vote(measured: list[dict], company: Company) -> list[int]:
    """The tag with the most votes of the sources for each clause; -1 where none has a say or two have the same."""
    refused = any(map(refusal_source, measured))
    out = []
    for m in measured:
        votes = [0.0] * len(TAGS)
        if m["echo"] >= 0.6 and len(m["words"]) >= 3:
            votes[ECHO] += 4
        if m["broken"]:
            votes[UNFINISHED] += 3
        if refusal_source(m):
            votes[REFUSAL] += 3
        elif m["foreign"]:
            votes[FOREIGN] += 3
        else:
            if courtesy_source(m):
                votes[COURTESY] += 1.5
            if m["link"]:
                votes[ANSWER] += 2
            if abs(lead := company.lead(m)) > 0.25:
                votes[COURTESY if lead > 0 else ANSWER] += 1
            if not refused and len(m["words"]) > 4:
                votes[ANSWER] += 0.5
        best = max(votes)
        out.append(votes.index(best) if best and votes.count(best) == 1 else -1)
    return out


def measured_features(m: dict) -> list[str]:
    return ["bias", f"echo{int(m['echo'] * 5)}", f"foreign{m['foreign']}", f"broken{m['broken']}", f"link{m['link']}", f"long{min(len(m['words']), 12) // 3}", f"place{m['first']}{m['last']}", f"role{m['role']}"]


def word_features(ws: list[str]) -> list[str]:
    return [f"first {ws[0]}", *set(ws), *{f"{a} {b}" for a, b in zip(ws, ws[1:])}] if ws else []


def features(m: dict) -> list[str]:
    """Names of the features of a clause: what was measured, words, pairs of words. The words of an echo are the prompt's and say nothing."""
    return measured_features(m) + (word_features(m["words"]) if m["echo"] < 0.6 else [])


class Field:
    """Linear-chain conditional random field. ``index`` gives the row of a feature's weights."""

    def __init__(self, index: dict[str, int] | None = None, unary: np.ndarray | None = None, step: np.ndarray | None = None):
        n = len(TAGS)
        self.index = index or {}
        self.unary = np.zeros((len(self.index), n), np.float32) if unary is None else unary
        self.step = np.zeros((n, n)) if step is None else step
        self._known: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {**self.__dict__, "_known": {}}

    def rows(self, names: list[str]) -> list[int]:
        get = self.index.get
        return [k for k in map(get, names) if k is not None]

    def potentials(self, seq: list[list[int]]) -> np.ndarray:
        return np.array([self.unary[f].sum(0) for f in seq], np.float64)

    def _marginals(self, p: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of single tags, and of neighbours."""
        length, n = p.shape
        fwd, bwd = np.zeros((length, n)), np.zeros((length, n))
        fwd[0] = p[0]
        for i in range(1, length):
            x = fwd[i - 1][:, None] + self.step
            top = x.max(0)
            fwd[i] = p[i] + top + np.log(np.exp(x - top).sum(0))
        for i in range(length - 2, -1, -1):
            x = self.step + (p[i + 1] + bwd[i + 1])[None, :]
            top = x.max(1)
            bwd[i] = top + np.log(np.exp(x - top[:, None]).sum(1))
        top = fwd[-1].max()
        z = top + math.log(np.exp(fwd[-1] - top).sum())
        return np.exp(fwd + bwd - z), [np.exp(fwd[i - 1][:, None] + self.step + (p[i] + bwd[i])[None, :] - z) for i in range(1, length)]

    def fit(self, data: list[tuple[list[list[int]], list[int]]], epochs: int = 4, rate: float = 0.25, decay: float = 1e-5, seed: int = 1) -> Field:
        """Stochastic gradient ascent of the conditional likelihood, with adaptive steps. A tag of -1 is open: all its readings count."""
        rng, g_unary, g_step = np.random.default_rng(seed), np.full(len(self.unary), 1e-2, np.float32), np.full(self.step.shape, 1e-2)
        for _ in range(epochs):
            for at in rng.permutation(len(data)):
                seq, tags = data[at]
                p = self.potentials(seq)
                single, double = self._marginals(p)
                held = p.copy()
                for i, t in enumerate(tags):
                    if t >= 0:
                        held[i] = -1e4
                        held[i, t] = p[i, t]
                want, want_pairs = self._marginals(held)
                for i, f in enumerate(seq):
                    g = want[i] - single[i]
                    g_unary[f] += float((g * g).sum())
                    self.unary[f] += (rate * g / np.sqrt(g_unary[f])[:, None] - decay * self.unary[f]).astype(np.float32)
                for a, b in zip(want_pairs, double):
                    g_step += (a - b) ** 2
                    self.step += rate * (a - b) / np.sqrt(g_step)
        return self

    def decode(self, seq: list[list[int]]) -> list[int]:
        return self._best(self.potentials(seq))

    def _sum(self, key: str, names, m: dict) -> np.ndarray:
        """The weights of a clause's features, remembered by what they are told from."""
        got = self._known.get(key)
        if got is None:
            if len(self._known) >= _HELD:
                self._known.clear()
            got = self._known[key] = self.unary[self.rows(names(m))].sum(0)
        return got

    def _best(self, p: np.ndarray) -> list[int]:
        best, back = p[0], []
        for i in range(1, len(p)):
            x = best[:, None] + self.step
            back.append(x.argmax(0))
            best = x.max(0) + p[i]
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def tags(self, measured: list[dict]) -> list[int]:
        """A clause of the prompt's language is never foreign, one that shares little with it no echo, and only the last can be unfinished."""
        p = np.empty((len(measured), len(TAGS)))
        for i, m in enumerate(measured):
            p[i] = self._sum("\0" + " ".join(measured_features(m)), measured_features, m)
            if m["echo"] < 0.6:
                p[i] += self._sum(m["part"], lambda m: word_features(m["words"]), m)
            if not m["foreign"]:
                p[i, FOREIGN] -= 1e4
            if m["echo"] < 0.2:
                p[i, ECHO] -= 1e4
            if not m["last"]:
                p[i, UNFINISHED] -= 1e4
        return self._best(p)


def defect(measured: list[dict], tags: list[int]) -> str | None:
    """Coverage of the tags, by words, to the defect of the pair."""
    cover = [0] * len(TAGS)
    for m, t in zip(measured, tags):
        cover[t] += len(m["words"])
    total = sum(cover) or 1
    if cover[ECHO] and cover[ECHO] >= 0.7 * (total - cover[COURTESY]) and cover[ANSWER] <= 0.15 * total:
        return "copy"
    if tags and tags[-1] == UNFINISHED:
        return "truncated"
    offers = any(t == ANSWER and (m["link"] or len(m["words"]) > 4) for m, t in zip(measured, tags))  # shorter ones are farewells
    if cover[REFUSAL] and not offers and cover[FOREIGN] <= cover[REFUSAL]:
        return "refusal"
    if cover[FOREIGN] and cover[FOREIGN] > cover[ANSWER] + cover[REFUSAL]:
        return "other_language"
    return None


def fit(rows: list[tuple[str | None, str | None, list]], per_tag: int = 700) -> tuple[Reader, Field]:
    """The models from (prompt, response, seen ends) rows. Sequences with a rare tag are all taken, up to per_tag each."""
    reader = Reader(*fit_words([(p, r) for p, r, _ in rows]))
    sequences = []
    for prompt, response, seen in rows:
        if not is_empty(response) and not reader.swapped(prompt, response):
            sequences.append(reader.measure(prompt, response, breaks_off(open_end(response), seen or [], _marked(response))))
    sequences = [m for m in sequences if m]
    company = Company(sequences)
    by: dict[int, list] = defaultdict(list)
    rarity = (UNFINISHED, ECHO, REFUSAL, FOREIGN, COURTESY, ANSWER, -1)
    for measured in sequences:
        tags = vote(measured, company)
        rare = min(set(tags), key=rarity.index)
        if len(by[rare]) < per_tag:
            by[rare].append(([features(m) for m in measured], tags))
    data = [x for t in sorted(by) for x in by[t]]
    field = Field({n: k for k, n in enumerate(sorted({n for seq, _ in data for names in seq for n in names}))})
    return reader, field.fit([([field.rows(names) for names in seq], tags) for seq, tags in data]) if data else field


def broken_pairs(rows: DataFrame, id_col: str, prompt_col: str, response_col: str, *, sample: int = 16_000) -> DataFrame:
    """id, defect: one row per defective pair."""
    spark = rows.sparkSession
    ship(spark)
    base = rows.select(F.col(id_col).cast("string").alias("id"), F.col(prompt_col).alias("prompt"), F.col(response_col).alias("response")).filter("id is not null")
    last = stage(base.select("id", "response").mapInArrow(_open_ends, "id string, order int, gram long, own long").distinct(), "open-ends")
    # only the groups that some response ends with are looked up, so the others are left out before they are summed
    met = last.select("gram").distinct()
    ends = base.select("response").mapInArrow(_count_ends, "gram long, ends long, on long").join(met, "gram", "left_semi").groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("ends", "on")])
    loose = last.select("gram", "own").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("loose"))
    seen = last.select("id", "order", "gram").distinct().join(loose, "gram").join(ends, "gram", "left").groupBy("id").agg(F.collect_list(F.struct("order", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ends", "on", "loose")])).alias("seen"))  # at most five a row
    seen = stage(seen, "open-ends-seen")
    unstage(last)
    full = base.join(seen, "id", "left")
    # the smallest hashes lie below a cut that leaves about twice the sample, so that no task sends rows in vain
    order = F.xxhash64("id", "prompt", "response")
    cut = min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 2 * sample // max(1, base.count()))
    taken = full.filter(order <= F.lit(cut)).orderBy(order).limit(sample).collect()  # bounded by the parameter
    reader, field = fit([(r["prompt"], r["response"], [tuple(x) for x in r["seen"] or ()]) for r in taken])
    shared = spark.sparkContext.broadcast((reader, field))  # bounded by the sample

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, field = shared.value
        for batch in batches:
            ids, found = [], []
            for i, prompt, response, seen in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if is_empty(response):
                    kind = "empty"
                elif reader.swapped(prompt, response):
                    continue
                else:
                    broken = breaks_off(open_end(response), [(x["order"], x["ends"], x["on"], x["loose"]) for x in seen or ()], _marked(response))
                    measured = reader.measure(prompt, response, broken)
                    kind = defect(measured, field.tags(measured)) if measured else None
                if kind:
                    ids.append(i)
                    found.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.string())], names=["id", "defect"])

    return full.select("id", "prompt", "response", "seen").mapInArrow(tag, "id string, defect string").distinct().select(F.col("id").alias(id_col), "defect")
