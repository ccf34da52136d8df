"""Several values packed in one field: one row per value, with its position and an error flag.

A parsing expression grammar, ordered choices tried from left to right with backtracking:

    field    <- blank* (list / items) blank* end
    list     <- '[' items ']'
    items    <- sep* (item (sep+ item)*)? sep*
    item     <- grouped / quoted / bare
    grouped  <- q digit{1,3} (',' digit{3})+ q          one number with thousands commas
    quoted   <- q items q                               a quotation may hold a list of its own
    bare     <- any character but separators and quotes, one or more
    sep      <- ',' / ';' / '|' / '/' / white space

``q`` is a double or single quotation mark and closes with the same mark. Where a quotation does not close
before the end, the choice fails, the parser goes back to its start and reads the mark as dressing; every value
after it carries ``malformed``. Brackets likewise.

Defined results: null, blank, placeholders (null, nan, none, n/a, []) and fields of separators only give no row;
repeated values stay; a value that is not an id keeps its text with ``not_an_id``; texts of any length are
parsed whole, in linear time, nested to any depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLANKS = "\u00a0\u200b\ufeff"
_SEP = re.compile(rf"[,;|/\s{_BLANKS}]+")
_GROUPED = {q: re.compile(rf"{q}\s*(\d{{1,3}}(?:,\d{{3}})+)\s*{q}") for q in "\"'"}
_CLOSING = {'"': '"', "'": "'", "[": "]"}
_BARE = re.compile(rf"[^,;|/\s{_BLANKS}\"'\[\]]+")
_NOTHING = {"null", "nan", "none", "n/a", "na", "nil", "undefined"}
_FLOAT = re.compile(r"(\d+)\.0+")


class _Parser:
    """The grammar over an explicit stack of open marks, so nesting is bounded by the field alone.

    An enclosing rule fails with the first thing inside it that fails. So a failure closes all open rules at once: they are
    remembered as failed, and the parser goes back to the outermost one and reads its mark as dressing. No mark is
    tried again after that, hence linear time for malformed fields too.
    """

    def __init__(self, text: str):
        self.text, self.end, self.malformed = text, len(text), False
        self.values: list[tuple[str, bool]] = []

    def _sep(self, i: int) -> int:
        m = _SEP.match(self.text, i)
        return m.end() if m else i

    def parse(self) -> list[tuple[str, bool]]:
        text, values = self.text, self.values
        open_: list[tuple[int, str]] = []  # (place of the mark, its closing mark)
        failed: set[int] = set()
        before = 0  # values found before the outermost open mark
        i = self._sep(0)
        while i < self.end or open_:
            c = text[i] if i < self.end else ""
            if open_ and c == open_[-1][1]:
                open_.pop()
                i = self._sep(i + 1)
                continue
            if c in _CLOSING and c:
                m = _GROUPED[c].match(text, i) if c != "[" else None
                if m:
                    values.append((m[1].replace(",", ""), self.malformed))
                    i = self._sep(m.end())
                    continue
                if i not in failed:
                    if not open_:
                        before = len(values)
                    open_.append((i, _CLOSING[c]))
                    i = self._sep(i + 1)
                    continue
            elif m := _BARE.match(text, i):
                values.append((m[0], self.malformed))
                i = self._sep(m.end())
                continue
            if open_:
                failed.update(at for at, _ in open_)
                i = open_[0][0]
                del values[before:]
                open_.clear()
            self.malformed = True
            i = self._sep(i + 1)
        return values


def parse_field(text: str | None) -> list[tuple[str, str | None]]:
    """The values of one field in order, each with its error flag (null, malformed or not_an_id)."""
    if text is None:
        return []
    if text.isdigit() and text.isascii():
        return [(text, None)]  # the grammar's bare alternative, with nothing around it
    out = []
    for value, malformed in _Parser(text).parse():
        if value.lower() in _NOTHING:
            continue
        m = _FLOAT.fullmatch(value)
        value = m[1] if m else value
        out.append((value, "malformed" if malformed else None if value.isascii() and value.isdigit() else "not_an_id"))
    return out


def _parse_batches(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, pos, values, errors = [], [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, (value, error) in enumerate(parse_field(text), 1):
                    keys.append(k)
                    pos.append(n)
                    values.append(value)
                    errors.append(error)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(pos, pa.int64()), pa.array(values, pa.string()), pa.array(errors, pa.string())], names=[key, "position", "value", "error"])

    return run


def unpack(rows: DataFrame, key_col: str, field_col: str) -> DataFrame:
    """key, position (long, from 1), value, error. No shuffle: each field is parsed where it lies."""
    part = rows.select(F.col(key_col).alias("key"), F.col(field_col).cast("string").alias("field")).filter("field is not null and field <> ''")
    kind = dict(part.dtypes)["key"]
    return part.mapInArrow(_parse_batches("key"), f"key {kind}, position long, value string, error string").withColumnRenamed("key", key_col)
