"""Problem 6: delimited records that fail to parse, apart from the good ones and with the reason.

Each record is assembled quote-aware and read by Python's strict csv reader; what the reader raises is a structural
fault (quoting), the number of fields is checked next (columns), and only then the typed fields are built (value).
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import spread

FIELDS = ("id", "sample", "text", "n_actions", "invalid")
DELIMITERS = {"comma": ",", "semicolon": ";", "tab": "\t"}
NATURAL = re.compile(r"0|[1-9][0-9]*")
_LONGEST = 2**63 - 1


class Fault(ValueError):
    """A record that can't be read; its argument is the reason."""


def without_last_line_end(record: str) -> str:
    """One line end left at the end of a record isn't part of its last field."""
    for end in ("\r\n", "\n", "\r"):
        if record.endswith(end):
            return record[: -len(end)]
    return record


def assemble(record: str, delim: str) -> tuple[str, dict[str, str]]:
    """The record as one line for the csv reader, and which characters stand for line ends in it.

    The reader takes a line end outside quotes for the end of a row; here it is part of an unquoted field, so there
    it's replaced by a character that the record doesn't have, to be turned back in the fields.
    """
    if "\n" not in record and "\r" not in record:
        return record, {}
    unused = (c for c in map(chr, range(0xE000, 0xF8FF)) if c not in record)
    stand = {"\n": next(unused), "\r": next(unused)}
    out, quoted, fresh, closed = [], False, True, False
    for ch in record:
        if quoted:
            closed = ch == '"'
            quoted = not closed
        elif ch == '"' and (fresh or closed):
            quoted, closed = True, False  # a field's first quote, or a doubled one
        else:
            closed = False
        fresh = not quoted and not closed and ch == delim
        out.append(ch if quoted else stand.get(ch, ch))
    return "".join(out), {v: k for k, v in stand.items()}


def fields(record: str, delim: str) -> list[str]:
    """The fields of a record; Fault('quoting') if its quotes are broken. An empty record is one empty field."""
    line, back = assemble(without_last_line_end(record), delim)
    if len(line) > csv.field_size_limit():
        csv.field_size_limit(len(line))  # no field is too long
    try:
        row = next(csv.reader([line], delimiter=delim, quotechar='"', doublequote=True, strict=True), [""]) or [""]
    except csv.Error as e:
        raise Fault("quoting") from e
    # the reader lets quotes inside unquoted fields pass
    if '"' in line and _stray_quote(line, delim):
        raise Fault("quoting")
    for stand, end in back.items():
        row = [x.replace(stand, end) for x in row]
    return row


def _stray_quote(line: str, delim: str) -> bool:
    at, n = 0, len(line)
    while True:
        if at < n and line[at] == '"':
            at += 1
            while True:
                at = line.find('"', at)
                if at < 0:
                    return True
                if at + 1 < n and line[at + 1] == '"':
                    at += 2
                    continue
                at += 1
                break
            if at < n and line[at] != delim:
                return True
        else:
            end = line.find(delim, at)
            end = n if end < 0 else end
            if '"' in line[at:end]:
                return True
            at = end
        if at >= n:
            return False
        at += 1


def _natural(text: str, least: int) -> int:
    if not NATURAL.fullmatch(text) or int(text) < least:
        raise Fault("value")
    return int(text)


def typed(row: list[str]) -> tuple[str, int, str, int, int | None]:
    """The typed fields; Fault('columns') or Fault('value') otherwise.

    Integers that are right but beyond 64 bits are values that can't be held, and so faults of value.
    """
    if len(row) != len(FIELDS):
        raise Fault("columns")
    id_, sample, text, n_actions, invalid = row
    if not id_.strip() or not text.strip():
        raise Fault("value")
    n = _natural(n_actions, 1)
    out = id_, _natural(sample, 0), text, n, _natural(invalid, 0) if invalid else None
    if out[4] is not None and out[4] > n or max(out[1], n) > _LONGEST:
        raise Fault("value")
    return out


def parse(record: str | None, delim: str | None) -> tuple:
    """(id, sample, text, n_actions, invalid, reason): reason is null for a good record."""
    try:
        if record is None:
            raise Fault("columns")
        return (*typed(fields(record, DELIMITERS.get(delim, ","))), None)
    except Fault as e:
        return None, None, None, None, None, e.args[0]


def parsed_records(df: DataFrame, key: str, record: str, delim: str) -> DataFrame:
    """key and the typed fields of each record, with reason null, or null fields with the reason.

    A null record has no fields (columns); a null or unknown delimiter name is taken as a comma; rows with a null key
    are kept. Records are read whole, whatever their length. Each row is parsed on its own, repeated or not.
    """
    rows = spread(df.select(F.col(key).alias("key"), F.col(record).alias("record"), F.col(delim).alias("delim")))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(zip(*(parse(r, d) for r, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist())))) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(got, kinds))], names=["key", *FIELDS, "reason"])

    return rows.mapInArrow(run, f"key {kind}, id string, sample bigint, text string, n_actions bigint, invalid bigint, reason string")


def good_records(df: DataFrame, key: str, record: str, delim: str) -> DataFrame:
    return parsed_records(df, key, record, delim).where("reason is null").drop("reason")


def bad_records(df: DataFrame, key: str, record: str, delim: str) -> DataFrame:
    return parsed_records(df, key, record, delim).where("reason is not null").select("key", "reason")
