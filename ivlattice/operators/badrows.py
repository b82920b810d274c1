"""Rows that fail to parse, set apart with their reason while the rest is loaded.

Each task reads its lines in Arrow blocks. A block is parsed at once by the
columnar CSV reader and checked column by column; the checks give a mask of the
lines that may be broken. A block with such a line is cut in two, and each half
again, by slices of that mask, so that all good lines stay on the fast path and bad
ones are isolated in log-many steps. Lines that are left alone are diagnosed by a
strict reader, which alone decides.

Reasons, the first that applies: ``quoting``, ``columns``, ``value``.
Defined results: a null line counts as an empty one (one field, so ``columns``);
one trailing carriage return is not part of a line; a header (line 1 of a file)
is neither loaded nor broken.
"""

from __future__ import annotations

import datetime as dt
import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ivlattice.session import spread

# The columns of the quote-chain file in order, and month names.
COLUMNS = (
    "exchange symbol timestamp local_timestamp type strike_price expiration open_interest last_price bid_price bid_amount bid_iv "
    "ask_price ask_amount ask_iv mark_price mark_iv underlying_index underlying_price delta gamma vega theta rho"
).split()
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()

TEXT = {"exchange", "symbol", "type", "underlying_index"}
WHOLE = {"timestamp", "local_timestamp", "expiration"}
NUMERIC = [c for c in COLUMNS if c not in TEXT and c not in WHOLE and c != "strike_price"]
BLANKS = " \t"

WELL_QUOTED = r'\A(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*\z'
SYMBOL = r"\A([A-Z]{3})-([0-9]{1,2})(" + "|".join(MONTHS) + r")([0-9]{2})-([0-9]+(?:\.[0-9]+)?)-(C|P)\z"
DIGITS = r"\A[0-9]{1,18}\z"
NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
# Numbers that the columnar reader takes and that are finite; others are left to the strict one.
SURE = r"\A-?[0-9]{1,40}(?:\.[0-9]{1,40})?(?:[eE][+-]?[0-9]{1,2})?\z"
QUOTED = r'"(?:[^"]|"")*"'

# The strict reader is written for Python's re, where \z is spelt \Z.
_WELL_QUOTED = re.compile(WELL_QUOTED.replace(r"\z", r"\Z"))
_FIELD = re.compile(r'("(?:[^"]|"")*"|[^",]*),')
_SYMBOL = re.compile(SYMBOL.replace(r"\z", r"\Z"))
_NUMBER = re.compile(NUMBER.replace(r"\z", r"\Z"))
_WHOLE = re.compile(r"\A[0-9]+\Z")


def split_line(line: str) -> list[str] | None:
    """Fields of one well-quoted line; None if its quoting is broken."""
    if '"' not in line:
        return line.split(",")
    if not _WELL_QUOTED.match(line):
        return None
    return [f[1:-1].replace('""', '"') if f[:1] == '"' else f for f in _FIELD.findall(line + ",")]


@functools.lru_cache(maxsize=50_000)
def symbol_parts(symbol: str) -> tuple[dt.date, float, str] | None:
    m = _SYMBOL.match(symbol)
    if not m:
        return None
    try:
        day = dt.date(2000 + int(m[4]), MONTHS.index(m[3]) + 1, int(m[2]))
    except ValueError:
        return None
    return day, float(m[5]), "call" if m[6] == "C" else "put"


def _finite(text: str) -> float | None:
    if not _NUMBER.match(text):
        return None
    x = float(text)
    return x if math.isfinite(x) else None


def diagnose(line: str | None) -> tuple[str | None, dict | None]:
    """(reason, None) of a broken line, (None, record) of a valid one."""
    line = line or ""
    fields = split_line(line[:-1] if line.endswith("\r") else line)
    if fields is None:
        return "quoting", None
    if len(fields) != len(COLUMNS):
        return "columns", None
    row = {c: f.strip(BLANKS) for c, f in zip(COLUMNS, fields)}
    parts = symbol_parts(row["symbol"])
    if parts is None or row["type"] != parts[2]:
        return "value", None
    for c in WHOLE:
        if not _WHOLE.match(row[c]) or not 0 < int(row[c]) < 2**63:
            return "value", None
        row[c] = int(row[c])
    strike = _finite(row["strike_price"])
    if strike is None or strike <= 0 or strike != parts[1]:
        return "value", None
    row["strike_price"] = strike
    at8 = dt.datetime(parts[0].year, parts[0].month, parts[0].day, 8, tzinfo=dt.timezone.utc)
    if row["expiration"] != int(at8.timestamp()) * 1000:
        return "value", None
    for c in NUMERIC:
        if row[c] == "":
            row[c] = None
            continue
        row[c] = _finite(row[c])
        if row[c] is None:
            return "value", None
    return None, row


def record_type() -> T.StructType:
    kind = lambda c: T.StringType() if c in TEXT else T.LongType() if c in WHOLE else T.DoubleType()
    return T.StructType([T.StructField(c, kind(c)) for c in COLUMNS])


def _arrow_type(c: str) -> pa.DataType:
    return pa.string() if c in TEXT else pa.int64() if c in WHOLE else pa.float64()


ARROW_RECORD = pa.struct([pa.field(c, _arrow_type(c)) for c in COLUMNS])
_READ = csv.ReadOptions(column_names=COLUMNS, use_threads=False)
_PARSE = csv.ParseOptions(newlines_in_values=False, ignore_empty_lines=False)
_CONVERT = csv.ConvertOptions(column_types={c: pa.string() for c in COLUMNS}, strings_can_be_null=False, quoted_strings_can_be_null=False)


def _bits(mask: pa.Array) -> np.ndarray:
    return pc.fill_null(mask, False).to_numpy(zero_copy_only=False)


def _splittable(lines: pa.Array) -> np.ndarray:
    """Which lines certainly are well quoted and have all fields."""
    quotes = _bits(pc.match_substring(lines, '"'))
    commas = pc.count_substring(lines, ",").to_numpy(zero_copy_only=False)
    ok = ~_bits(pc.match_substring_regex(lines, "[\r\n]|\\A\ufeff")) & (quotes | (commas == len(COLUMNS) - 1))
    at = np.flatnonzero(ok & quotes)
    if len(at):
        quoted = lines.take(pa.array(at))
        outside = pc.replace_substring_regex(quoted, QUOTED, "")
        whole = pc.equal(pc.count_substring(outside, ","), len(COLUMNS) - 1)
        ok[at] = _bits(pc.and_(pc.match_substring_regex(quoted, WELL_QUOTED), whole))
    return ok


def _by_symbol(symbols: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strike (NaN if the name isn't one), whether it is a call, and the due time in ms, worked out once a name."""
    names = symbols.dictionary_encode()
    parts = [symbol_parts(x) for x in names.dictionary.to_pylist()]
    strike = np.array([np.nan if p is None else p[1] for p in parts])
    call = np.array([p is not None and p[2] == "call" for p in parts], bool)
    due = np.array([0 if p is None else (p[0] - dt.date(1970, 1, 1)).days * 86_400_000 + 28_800_000 for p in parts], np.int64)
    at = names.indices.to_numpy()
    return strike[at], call[at], due[at]


def _typed(lines: pa.Array) -> tuple[dict[str, pa.Array], np.ndarray]:
    """Typed columns of splittable lines, and which rows certainly hold valid values (the rest are null)."""
    text = "\n".join(lines.to_pylist()) + "\n"
    got = csv.read_csv(pa.BufferReader(text.encode()), _READ, _PARSE, _CONVERT)
    if got.num_rows != len(lines):
        raise pa.ArrowInvalid("lines were joined or split")
    out = {c: pc.utf8_trim(got[c].combine_chunks(), BLANKS) for c in COLUMNS}
    strike, call, due = _by_symbol(out["symbol"])
    ok = _bits(pc.equal(out["type"], pa.array(np.where(call, "call", "put")))) & ~np.isnan(strike)
    for c in WHOLE:
        good = pc.match_substring_regex(out[c], DIGITS)
        out[c] = pc.cast(pc.if_else(good, out[c], None), pa.int64())
        ok &= _bits(pc.greater(out[c], 0))
    for c in ["strike_price", *NUMERIC]:
        sure = pc.match_substring_regex(out[c], SURE)
        ok &= _bits(sure if c == "strike_price" else pc.or_(sure, pc.equal(out[c], "")))
        out[c] = pc.cast(pc.if_else(sure, out[c], None), pa.float64())
    price = out["strike_price"].to_numpy(zero_copy_only=False)
    ok &= (price > 0) & (price == strike) & _bits(pc.equal(out["expiration"], pa.array(due)))
    return out, ok


def bulk_parse(lines: pa.Array) -> tuple[pa.StructArray, np.ndarray]:
    """All lines of a block as records, and a mask of those that may be broken (their records mean nothing).

    It accepts only what the strict reader accepts; whatever it isn't sure of it masks.
    """
    none = pa.nulls(len(lines), ARROW_RECORD)
    body = pc.replace_substring_regex(lines, "\r\\z", "") if _bits(pc.ends_with(lines, "\r")).any() else lines
    good = _splittable(body)
    at = np.flatnonzero(good)
    if not len(at):
        return none, ~good
    try:
        columns, ok = _typed(body.take(pa.array(at)))
    except pa.ArrowInvalid:
        # the reader stumbles somewhere: the halves are read each by itself
        if len(lines) == 1:
            return none, np.ones(1, bool)
        halves = [bulk_parse(lines[: len(lines) // 2]), bulk_parse(lines[len(lines) // 2 :])]
        return pa.concat_arrays([r for r, _ in halves]), np.concatenate([m for _, m in halves])
    row = np.cumsum(good) - 1
    records = pa.StructArray.from_arrays([columns[c] for c in COLUMNS], fields=list(ARROW_RECORD))
    good[at] = ok
    return records.take(pa.array(np.maximum(row, 0))), ~good


def parse_block(lines: pa.Array) -> Iterator[tuple[int, int, pa.StructArray, list[str | None]]]:
    """(start, length, records, reasons) of consecutive parts of a block: runs of good lines and single doubtful ones."""
    records, doubt = bulk_parse(lines)
    before = np.r_[0, np.cumsum(doubt)].tolist()
    todo = [(0, len(lines))]
    while todo:
        start, n = todo.pop()
        if n == 0:
            continue
        if before[start + n] == before[start]:
            yield start, n, records.slice(start, n), [None] * n
        elif n > 1:
            todo += [(start + n // 2, n - n // 2), (start, n // 2)]
        else:
            reason, record = diagnose(lines[start].as_py())
            yield start, 1, pa.array([record], type=ARROW_RECORD), [reason]


def parse_lines(lines: DataFrame) -> DataFrame:
    """``lines``: line_id long, line_no int, raw_line string, any others ignored.

    Returns line_id, reason (null for loaded lines) and the record (null for
    broken ones); headers are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            parts = list(parse_block(text))
            if parts:
                reasons = pa.array([x for *_, told in parts for x in told], pa.string())
                yield pa.RecordBatch.from_arrays([ids, reasons, pa.concat_arrays([r for _, _, r, _ in parts])], names=["line_id", "reason", "record"])

    schema = T.StructType([T.StructField("line_id", T.LongType()), T.StructField("reason", T.StringType()), T.StructField("record", record_type())])
    body = lines.filter(F.col("line_no").isNull() | (F.col("line_no") > 1)).select("line_id", F.col("raw_line").cast("string"))
    return spread(body).mapInArrow(run, schema)


def broken_lines(lines: DataFrame) -> DataFrame:
    return parse_lines(lines).filter(F.col("reason").isNotNull()).select("line_id", "reason")


def loaded_lines(lines: DataFrame) -> DataFrame:
    return parse_lines(lines).filter(F.col("reason").isNull()).select("line_id", "record.*")
