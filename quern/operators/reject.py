"""CSV records that do not parse, told apart by structural indexing.

All records of a batch are one byte buffer. A mask of the double quotes and its
prefix parity say which commas are separators; counts and masks over the buffer
then classify every record, without a loop over characters or records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.session import ship_package

QUOTE, COMMA, CR = 0x22, 0x2C, 0x0D
#: Bytes of records that are indexed at once; bounds the memory of a task, but for a single longer record.
SLICE_BYTES = 4 << 20


class Indexed:
    """Structural index of records: field bounds and a verdict on the quotes."""

    def __init__(self, lines: pa.Array):
        texts = pc.fill_null(pc.cast(lines, pa.large_utf8()), "")
        raw = texts.buffers()[2]
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        begin, end = bounds[:-1], bounds[1:].copy()
        last = data[np.maximum(end - 1, 0)] if len(data) else np.zeros(len(end), np.uint8)
        end -= (end > begin) & (last == CR)
        self.data, self.begin, self.end = data, begin, end
        n = len(begin)
        quotes = data == QUOTE
        quotes[bounds[1:][end < bounds[1:]] - 1] = False
        before = np.concatenate([[0], np.cumsum(quotes)])
        base = before[begin]
        record = np.repeat(np.arange(n), bounds[1:] - bounds[:-1])
        inside = ((before[:-1] - base[record]) & 1).astype(bool)
        commas = np.flatnonzero((data == COMMA) & ~inside & (np.arange(len(data)) < end[record]))
        owner = record[commas]
        self.columns = np.bincount(owner, minlength=n) + 1
        # fields in order of records: a record's first begins with it, the others follow a comma
        total = len(commas) + n
        first = np.cumsum(self.columns) - self.columns
        self.first = first
        self.field_begin = np.empty(total, np.int64)
        self.field_end = np.empty(total, np.int64)
        is_first = np.zeros(total, bool)
        is_first[first] = True
        self.field_begin[is_first], self.field_begin[~is_first] = begin, commas + 1
        is_last = np.zeros(total, bool)
        is_last[first + self.columns - 1] = True
        self.field_end[is_last], self.field_end[~is_last] = end, commas
        fb, fe = self.field_begin, self.field_end
        count = before[fe] - before[fb]
        safe = lambda at: data[np.clip(at, 0, max(len(data) - 1, 0))] if len(data) else np.zeros(len(at), np.uint8)
        framed = (fe - fb >= 2) & (safe(fb) == QUOTE) & (safe(fe - 1) == QUOTE)
        good = (count == 0) | (framed & (count % 2 == 0))
        # inside a framed field, runs of quotes must be of even length
        inner = np.concatenate([[0], np.cumsum(self._odd_runs(quotes, fb[framed], fe[framed]))])
        odd = np.zeros(total, bool)
        odd[framed] = inner[fe[framed] - 1] - inner[np.minimum(fb[framed] + 1, fe[framed] - 1)] > 0
        good &= ~odd
        self.quoted = framed & (count > 0)
        field_record = np.repeat(np.arange(n), self.columns)
        self.quotes_ok = np.bincount(field_record[~good], minlength=n) == 0

    @staticmethod
    def _odd_runs(quotes: np.ndarray, fb: np.ndarray, fe: np.ndarray) -> np.ndarray:
        """1 at the first quote of each run of odd length, the framing quotes left out."""
        inner = quotes.copy()
        inner[fb] = False
        inner[fe - 1] = False
        edge = np.diff(np.concatenate([[0], inner.astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out = np.zeros(len(quotes), np.int8)
        out[starts[(ends - starts) % 2 == 1]] = 1
        return out

    def field(self, k: int, rows: np.ndarray) -> pa.Array:
        """Field ``k`` of the records ``rows``, unquoted."""
        at = self.first[rows] + k
        b = self.field_begin[at] + self.quoted[at]
        e = self.field_end[at] - self.quoted[at]
        size = np.maximum(e - b, 0)
        out = np.concatenate([[0], np.cumsum(size)])
        source = np.arange(out[-1]) - np.repeat(out[:-1] - b, size)
        body = self.data[source] if len(source) else np.zeros(0, np.uint8)
        text = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(out.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes()))
        return pc.replace_substring(text, '""', '"')


def _clean(text: pa.Array) -> pa.Array:
    """Without surrounding blanks; null where empty or the word NULL."""
    text = pc.utf8_trim_whitespace(text)
    return pc.if_else(pc.or_(pc.equal(text, ""), pc.equal(text, "NULL")), pa.scalar(None, pa.large_utf8()), text)


def whole_number(low: int, high: int) -> Callable[[pa.Array], pa.Array]:
    """Check for unsigned whole numbers in the digits 0-9 within a range."""

    def check(text: pa.Array) -> pa.Array:
        digits = pc.match_substring_regex(text, r"^[0-9]+$")
        short = pc.if_else(digits, pc.utf8_ltrim(text, "0"), "")
        fits = pc.less_equal(pc.utf8_length(short), 18)
        value = pc.cast(pc.if_else(pc.and_(digits, fits), pc.if_else(pc.equal(short, ""), "0", short), "-1"), pa.int64())
        return pc.and_(pc.and_(digits, fits), pc.and_(pc.greater_equal(value, low), pc.less_equal(value, high)))

    return check


def unsigned_decimal(text: pa.Array) -> pa.Array:
    """Check for digits 0-9 with at most one decimal point."""
    return pc.match_substring_regex(text, r"^([0-9]+(\.[0-9]*)?|\.[0-9]+)$")


def _long(text: pa.Array) -> pa.Array:
    """All whole numbers of 64 bits, leading zeros and a sign included; null for others."""
    ok = pc.fill_null(pc.match_substring_regex(text, r"^[+-]?[0-9]+$"), False)
    minus = pc.fill_null(pc.starts_with(text, "-"), False)
    digits = pc.utf8_ltrim(pc.utf8_ltrim(pc.if_else(ok, text, "0"), "+-"), "0")
    digits = pc.if_else(pc.equal(digits, ""), "0", digits)
    size = pc.utf8_length(digits)
    # of 19 digits, the order of the texts is that of the numbers
    limit = pc.if_else(minus, str(2**63), str(2**63 - 1))
    fits = pc.and_(ok, pc.or_(pc.less(size, 19), pc.and_(pc.equal(size, 19), pc.less_equal(digits, limit))))
    large = pa.large_utf8()
    signed = pc.binary_join_element_wise(pc.if_else(minus, pa.scalar("-", large), pa.scalar("", large)), digits, pa.scalar("", large))
    return pc.cast(pc.if_else(fits, signed, pa.scalar(None, large)), pa.int64())


def _double(text: pa.Array) -> pa.Array:
    ok = pc.fill_null(pc.match_substring_regex(text, r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), False)
    return pc.cast(pc.if_else(ok, pc.utf8_ltrim(text, "+"), pa.scalar(None, pa.large_utf8())), pa.float64())


def _date(text: pa.Array) -> pa.Array:
    ok = pc.fill_null(pc.match_substring_regex(text, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), False)
    return pa.array(pd.to_datetime(pd.Series(pc.if_else(ok, text, pa.scalar(None, pa.large_utf8())).to_pandas()), format="%Y-%m-%d", errors="coerce").dt.date, pa.date32())


def _timestamp(text: pa.Array) -> pa.Array:
    """The first moment of a day."""
    return pc.cast(_date(text), pa.timestamp("us"))


KINDS = {"timestamp": (pa.timestamp("us"), _timestamp), "string": (pa.string(), lambda t: pc.cast(t, pa.string())), "long": (pa.int64(), _long), "double": (pa.float64(), _double), "date": (pa.date32(), _date)}
SPARK = {"timestamp": T.TimestampNTZType(), "string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "date": T.DateType()}

#: One column of the record: name, kind of ``KINDS``, check or None.
Column = tuple[str, str, Callable[[pa.Array], pa.Array] | None]


def _slices(lines: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of records with about SLICE_BYTES bytes each."""
    sizes = pc.fill_null(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(sizes) // SLICE_BYTES
    bounds = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(sizes)]
    return ((a, b) for a, b in zip(bounds, bounds[1:]) if b > a)


def parse_records(df: DataFrame, key: str, line: str, columns: Sequence[Column]) -> DataFrame:
    """Every record of ``df`` as a typed row or a reasoned reject.

    Columns: ``key``, ``reject_reason``, ``unfit_columns`` and, prefixed by ``v_``,
    the columns of the record. The reason is null for a valid record, else the first that holds
    of ``quoting`` (a double quote other than around a whole field or doubled in
    one, or a field left open), ``columns`` (not as many fields as columns) and
    ``value`` (a column's check fails). Checks see values without surrounding
    blanks; empty values and ``NULL`` are missing and valid. One carriage return at
    the very end isn't part of a record. A null record counts as an empty one,
    which has one field. Values of rejects are null. A value that no check refuses
    but that isn't of its column's kind (a word or more than 64 bits for a whole number, a day that
    doesn't exist) is null in the valid row, and ``unfit_columns`` names such columns, joined by
    commas; it is null for rows without any. Records are whole values: line breaks within
    are data. The schema is that of the result for an empty table, too.
    """
    ship_package(df.sparkSession)
    fields = list(columns)
    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType), T.StructField("reject_reason", T.StringType()), T.StructField("unfit_columns", T.StringType())]
        + [T.StructField(f"v_{name}", SPARK[kind]) for name, kind, _ in fields]
    )

    def parse_slice(keys: pa.Array, lines: pa.Array) -> pa.RecordBatch:
        index = Indexed(lines)
        n = len(lines)
        reason = np.full(n, None, object)
        right = index.columns == len(fields)
        reason[~right] = "columns"
        reason[~index.quotes_ok] = "quoting"
        rows = np.flatnonzero(right & index.quotes_ok)
        values = [_clean(index.field(k, rows)) for k in range(len(fields))]
        fails = np.zeros(len(rows), bool)
        for (_, _, check), value in zip(fields, values):
            if check is not None:
                fails |= ~pc.fill_null(check(value), True).to_numpy(zero_copy_only=False)
        reason[rows[fails]] = "value"
        place = np.full(n, -1, np.int64)
        place[rows[~fails]] = np.flatnonzero(~fails)
        take = pa.array(np.where(place < 0, 0, place), mask=place < 0)
        typed, unfit = [], np.full(len(rows), "", object)
        for (name, kind, _), value in zip(fields, values):
            to, cast = KINDS[kind]
            got = cast(value)
            lost = pc.and_(pc.is_null(got), pc.is_valid(value)).to_numpy(zero_copy_only=False)
            if lost.any():
                unfit[lost] += f",{name}"
            typed.append(got.take(take) if len(rows) else pa.nulls(n, to))
        named = pa.array([x[1:] or None for x in unfit], pa.string())
        out = [keys, pa.array(reason, pa.string()), named.take(take) if len(rows) else pa.nulls(n, pa.string()), *typed]
        return pa.RecordBatch.from_arrays([pc.cast(c, pa.int64()) if k == 0 and pa.types.is_integer(c.type) else c for k, c in enumerate(out)], names=schema.names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lines = batch.column(0), batch.column(1)
            for a, b in _slices(lines):
                yield parse_slice(keys.slice(a, b - a), lines.slice(a, b - a))

    return df.select(key, line).mapInArrow(parse, schema)


def rejects(parsed: DataFrame, key: str) -> DataFrame:
    """``key``, ``reject_reason`` of the records that fail."""
    return parsed.where(parsed["reject_reason"].isNotNull()).select(key, "reject_reason")


def valid_rows(parsed: DataFrame) -> DataFrame:
    """The typed rows of the valid records, under the names of their columns, with ``unfit_columns`` last."""
    names = [c for c in parsed.columns if c.startswith("v_")]
    key = parsed.columns[0]
    kept = parsed.where(parsed["reject_reason"].isNull())
    return kept.select(kept[key], *[kept[c].alias(c[2:]) for c in names], kept["unfit_columns"])
