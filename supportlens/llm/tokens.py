"""Encoding of a corpus with the merge list of a public byte-level tokenizer, as a streaming transducer.

Text goes in by chunks of any size and token ids come out as soon as no later text can change them; what is
held back is bounded by the lookahead, so memory stays constant however long a text is.

* Words. The tokenizer cuts text into words by a fixed pattern. A word is settled once two more
  characters have been read behind it: every alternative of the pattern ends by the class of the next character,
  but for the contractions, which read up to two.
* Inside a word, an automaton runs over the byte positions: the last token of each prefix is the one that fits behind the
  last token of what precedes it, where two tokens fit if encoding their bytes together gives the two again. No token is
  longer than the longest entry of the merge list, the sufficient lookahead L; all later paths
  therefore pass through one of the last L positions, and the tokens these have in common are settled. What the automaton
  gave for a whole word is remembered, so a word met again costs a look-up.
* Decoding feeds the tokens' bytes into an incremental UTF-8 state machine.

Every text takes this one way, whatever its length.

Defined results: null and empty texts have an empty list; special tokens are never used, their spelling in a text is
ordinary text; every row of the input gives one row, repeated ids too; empty tables give empty results; other columns are
not read.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that the rank file's tokenizer cuts text by.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The same alternatives that can run on without end, for a word that goes on in the next chunk.
_RUNS = {k: regex.compile(p) for k, p in {"letters": r"\p{L}*+", "digits": r"\p{N}*+", "signs": r"[^\s\p{L}\p{N}]*+", "blanks": r"\s*+"}.items()}
_READ_ON = 2
_LONG_WORD = 2048  # characters of an unsettled word, from which on its bytes go into the automaton
_REMEMBERED = 400_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class MergeList:
    """The ranks, with what follows from them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.lookahead = max(map(len, ranks))
        self.words: dict[str, tuple[int, ...]] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids by plain merging in order of rank: what the automaton asks of two tokens."""
        ranks = self.ranks
        if (one := ranks.get(word)) is not None:
            return (one,)
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def word(self, text: str) -> tuple[int, ...]:
        ids = self.words.get(text)
        if ids is None:
            raw = text.encode("utf-8", "surrogatepass")
            if (one := self.ranks.get(raw)) is not None:
                ids = (one,)
            else:
                stream = WordStream(self)
                ids = (*stream.feed(raw), *stream.finish())
            if len(self.words) >= _REMEMBERED:
                self.words.clear()
            if len(text) <= 64:
                self.words[text] = ids
        return ids

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can stand right behind token a."""
        key = (a, b)
        got = self._fits.get(key)
        if got is None:
            if len(self._fits) >= _REMEMBERED:
                self._fits.clear()
            got = self._fits[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == key
        return got


class WordStream:
    """The automaton over one long word, fed by bytes."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.tail = b""  # the bytes behind the settled place
        self.last: list[int] = [-1]  # for each place behind it, the last token; -1 at the settled place
        self.before = -1  # the token that ends at the settled place

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for k in range(len(data)):
            self.tail += data[k : k + 1]
            self._step()
            if len(self.last) > 4 * self.m.lookahead:
                out += self._settle()
        return out

    def _step(self) -> None:
        m, end = self.m, len(self.tail)
        for n in range(min(m.lookahead, end), 0, -1):
            token = m.ranks.get(self.tail[end - n : end])
            if token is None:
                continue
            start = end - n
            prior = self.last[start] if start else self.before
            if prior < 0 and start:
                continue
            if prior < 0 or m.fits(prior, token):
                self.last.append(token)
                return
        raise AssertionError("a byte without a token")

    def _path(self, place: int) -> list[int]:
        out = []
        while place:
            out.append(place)
            place -= len(self.m.bytes_of[self.last[place]])
        return out[::-1]

    def _settle(self) -> list[int]:
        end = len(self.tail)
        common = self._path(end)
        for place in range(max(1, end - self.m.lookahead + 1), end):
            path = self._path(place)
            n = 0
            while n < len(common) and n < len(path) and common[n] == path[n]:
                n += 1
            del common[n:]
            if not common:
                return []
        ids = [self.last[p] for p in common]
        cut = common[-1]
        self.before = ids[-1]
        self.tail = self.tail[cut:]
        self.last = [-1, *self.last[cut + 1 :]]
        return ids

    def finish(self) -> list[int]:
        return [self.last[p] for p in self._path(len(self.tail))]


class Encoder:
    """The transducer over one text: feed() chunks, then finish()."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.held = ""
        self.run: tuple[str, WordStream] | None = None

    def feed(self, chunk: str) -> list[int]:
        self.held += chunk
        return self._read(final=False)

    def finish(self) -> list[int]:
        return self._read(final=True)

    def _read(self, final: bool) -> list[int]:
        out: list[int] = []
        if self.run:
            kind, stream = self.run
            stop = _RUNS[kind].match(self.held).end()
            over = stop < len(self.held) or final
            if kind == "blanks" and not (final and stop == len(self.held)):
                # the last blank of a run belongs to what follows it, so it stays until that is known
                stop = max(0, stop - 1)
            out += stream.feed(self.held[:stop].encode("utf-8", "surrogatepass"))
            self.held = self.held[stop:]
            if not over:
                return out
            out += stream.finish()
            self.run = None
        # the pattern leaves no character out, so the words end where the next ones begin
        words, done = WORDS.findall(self.held), len(self.held)
        while words and done > len(self.held) - (0 if final else _READ_ON):
            done -= len(words.pop())
        known, word = self.m.words.get, self.m.word
        for w in words:
            out += known(w) or word(w)
        self.held = self.held[done:]
        if not final and len(self.held) > _LONG_WORD and (m := WORDS.match(self.held)):
            body = m[0].lstrip(" ")[:1]
            kind = "blanks" if not body or body.isspace() else next(k for k in ("letters", "digits", "signs") if _RUNS[k].match(body).end())
            stop = m.end() - (1 if kind == "blanks" else 0)
            if m.end() >= len(self.held) - _READ_ON and stop:
                self.run = (kind, WordStream(self.m))
                out += self.run[1].feed(self.held[:stop].encode("utf-8", "surrogatepass"))
                self.held = self.held[stop:]
        return out


def encode(merges: MergeList, text: str | None, chunk: int = 65_536) -> list[int]:
    if not text:
        return []
    encoder, out = Encoder(merges), []
    for i in range(0, len(text), chunk):
        out += encoder.feed(text[i : i + chunk])
    return out + encoder.finish()


def decode(merges: MergeList, ids: Iterable[int]) -> str:
    """The text of the ids, by an incremental byte-to-text state machine; broken bytes come out as U+FFFD."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    return "".join(machine.decode(merges.bytes_of[i]) for i in ids) + machine.decode(b"", True)


_LOADED: dict[int, MergeList] = {}


def loaded(data: bytes) -> MergeList:
    """The merge list of a rank file's bytes, parsed once per worker process."""
    key = hash(data)
    if key not in _LOADED:
        _LOADED[key] = MergeList(read_ranks(data))
    return _LOADED[key]


def _vocabulary(df: DataFrame, path: str):
    """The rank file (under 1 MB, fixed) as a broadcast, so that only the driver needs the file."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_column(rows: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """id and ids (array of ints). No shuffle."""
    part = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    data = _vocabulary(part, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = loaded(data.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                piece = batch.slice(k, 512)
                ids = [encode(merges, t) for t in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = dict(part.dtypes)["id"]
    return part.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def count_column(rows: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """id and tokens (long): the length of what encode_column gives, without shipping the ids."""
    part = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    data = _vocabulary(part, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = loaded(data.value)
        for batch in batches:
            n = [len(encode(merges, t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["id", "tokens"])

    kind = dict(part.dtypes)["id"]
    return part.mapInArrow(run, f"id {kind}, tokens long").withColumnRenamed("id", id_col)
