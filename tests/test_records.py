import random

import pytest

from studflow.operators import records


def machine(record, d):
    """Fields by a state machine, None for broken quotes: an independent reading of the rules."""
    for end in ("\r\n", "\n", "\r"):
        if record.endswith(end):
            record = record[: -len(end)]
            break
    out, at = [], 0
    while True:
        if record[at : at + 1] == '"':
            at, text = at + 1, ""
            while True:
                if at >= len(record):
                    return None
                if record[at] == '"':
                    if record[at + 1 : at + 2] == '"':
                        text, at = text + '"', at + 2
                        continue
                    at += 1
                    break
                text, at = text + record[at], at + 1
            out.append(text)
            if at < len(record) and record[at] != d:
                return None
        else:
            end = record.find(d, at)
            end = len(record) if end < 0 else end
            if '"' in record[at:end]:
                return None
            out.append(record[at:end])
            at = end
        if at >= len(record):
            return out
        at += 1


def test_fields_like_a_state_machine():
    r = random.Random(1)
    for _ in range(20_000):
        s = "".join(r.choice('ab,,""\n\r;\\ ') for _ in range(r.randrange(12)))
        want = machine(s, ",")
        try:
            got = records.fields(s, ",")
        except records.Fault:
            got = None
        assert got == want, (s, got, want)


CASES = [
    ('m-1,0,"a\nb",3,2\n', None), ('"m-1","0","a ""b""","3",""', None), ("m-1,0,a\nb,3,0\r\n", None),
    ('m-1,0,"a,3,2', "quoting"), ('m-1,0,"a"b,3,2', "quoting"), ('m-1,0,a"b,3,2', "quoting"),
    ("m-1,0,a,3", "columns"), ("", "columns"), ("m-1,0,a,3,2,9", "columns"), (None, "columns"),
    (" ,0,a,3,2", "value"), ("m-1,0, ,3,2", "value"), ("m-1,-1,a,3,2", "value"), ("m-1,01,a,3,2", "value"), ("m-1,0,a,0,0", "value"),
    ("m-1,0,a,3,4", "value"), ("m-1,0,a,3,null", "value"), ("m-1,0,a, 3,2", "value"), ("m-1,0,a,3,٣", "value"), ("m-1,0,a,3,0", None), ("m-1,0," + "x" * 300_000 + ",3,", None),
]


@pytest.mark.parametrize("record,reason", CASES)
def test_reasons(record, reason):
    assert records.parse(record, "comma")[-1] == reason


def test_tables(spark):
    rows = [(k, "comma", c) for k, (c, _) in enumerate(CASES)] + [(100, "tab", 'm\t0\t"a\tb"\t3\t'), (101, None, "m,0,a,3,"), (None, "semicolon", "m;0;a;3;1"), (100, "tab", 'm\t0\t"a\tb"\t3\t')]
    df = spark.createDataFrame(rows, "raw_id bigint, delim string, record string").selectExpr("*", "1 as id", "2 as reason", "3 as key")
    bad = {(r["key"], r["reason"]) for r in records.bad_records(df, "raw_id", "record", "delim").collect()}
    assert bad == {(k, w) for k, (_, w) in enumerate(CASES) if w}
    good = records.good_records(df, "raw_id", "record", "delim").collect()
    assert len(good) + len(bad) == len(rows)
    assert [r["text"] for r in good if r["key"] == 0] == ["a\nb"] and [r["text"] for r in good if r["key"] == 100] == ["a\tb"] * 2
    assert records.parsed_records(df.limit(0), "raw_id", "record", "delim").count() == 0
