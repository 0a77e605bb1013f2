"""Near duplicates, shared spans, splitting and leaks against brute force, and their degenerate inputs."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("studflow.llm")
from studflow.llm import leakage, near_duplicates, shared_spans, splitting  # noqa: E402

WORDS = [f"w{k}" for k in range(400)]


def texts(seed, n=60, size=120):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out).split(" ")
            for _ in range(r.choice([0, 1, 3, 8, 20])):
                k = r.randrange(len(w))
                w[k : k + r.choice([0, 1, 2])] = [r.choice(WORDS)] * r.choice([0, 1])
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = w[k:] + w[:k]
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choice(WORDS) for _ in range(r.randrange(40, size))))
    return out


def frame(spark, rows):
    # a column that clashes with the operators' own names
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "id bigint, body string, key string, text int")


def similar(rows, t=0.7, n=5, least=60):
    sets = []
    for k, s in rows:
        if k is None or s is None:
            continue
        w = [x for x in re.split(r"[ \t\r\n]+", s.lower()) if x]
        if len(w) >= least:
            sets.append((k, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}))
    out = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            c = len(x & y)
            if a != b and c >= t * (len(x) + len(y) - c) - 1e-9:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_pairs(spark, seed):
    rows = list(enumerate(texts(seed, 120))) + [(1000, None), (None, "a b"), (1001, ""), (1002, "x " * 5000), (1003, "X\n" * 5000)]
    got = [tuple(r) for r in near_duplicates.similar_pairs(frame(spark, rows), "id", "body", buckets=3).collect()]
    assert len(got) == len(set(got))
    assert set(got) == similar(rows)


def test_hot_runs_meet_in_blocks(spark, monkeypatch):
    rows = list(enumerate(texts(5, 80)))
    counts = near_duplicates.sketch(frame(spark, rows).select("body"), 5)
    monkeypatch.setattr(near_duplicates, "HOT", 3)
    blobs = {}
    for b, blob in near_duplicates._postings(np.array([k for k, _ in rows]), [t for _, t in rows], 5, 0.7, 60, counts, 2):
        blobs.setdefault(b, []).append(blob)
    links, members = set(), {}
    for x in blobs.values():
        pairs, copies = near_duplicates._meet(x, 0.7)
        links |= {tuple(p) for p in pairs.tolist()}
        members |= {b: a for a, b in copies.tolist()}
    links = {tuple(sorted(p)) for p in links}
    for a, b in similar(rows):
        a, b = members.get(a, a), members.get(b, b)
        assert a == b or (min(a, b), max(a, b)) in links


def met(batches, counts, buckets=2, bits=32):
    """The links and the members (copy: representative) of records posted batch by batch."""
    blobs, links, members = {}, set(), {}
    for rows in batches:
        for b, blob in near_duplicates._postings(np.array([k for k, _ in rows]), [t for _, t in rows], 5, 0.7, 60, counts, buckets, bits):
            blobs.setdefault(b, []).append(blob)
    for x in blobs.values():
        pairs, copies = near_duplicates._meet(x, 0.7, bits)
        links |= {tuple(sorted(p)) for p in pairs.tolist()}
        members |= {b: a for a, b in copies.tolist()}
    return links, members


@pytest.mark.parametrize("bits", [33, 43])
def test_wider_hashes_find_the_same(spark, bits):
    rows = list(enumerate(texts(6, 80)))
    counts = near_duplicates.sketch(frame(spark, rows).select("body"), 5, 21)
    links, members = met([rows], counts, 3, bits)
    for a, b in similar(rows):
        a, b = members.get(a, a), members.get(b, b)
        assert a == b or (min(a, b), max(a, b)) in links


def test_a_batch_of_any_size(spark):
    # two true pairs among more records than a sort key once had room for, in one batch
    r = random.Random(8)
    body = [" ".join(f"{k}x{r.randrange(10**6)}" for _ in range(62)) for k in range(20_000)]
    rows = list(enumerate([*body, body[3] + " more", body[19_990] + " more"]))
    df = spark.createDataFrame(rows, "id bigint, body string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        got = {tuple(x) for x in near_duplicates.similar_pairs(df, "id", "body").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(3, 20_000), (19_990, 20_001)}


def test_a_run_ten_times_as_hot(monkeypatch):
    # one run in all of 300 records: cut into ten blocks, of which each pair meets; no bucket gets all of it
    monkeypatch.setattr(near_duplicates, "HOT", 30)
    r = random.Random(9)
    hot = "h1 h2 h3 h4 h5"
    rows = []
    for k in range(0, 300, 2):
        t = hot + " " + " ".join(f"{k}y{r.randrange(10**6)}" for _ in range(70))
        rows += [(k, t), (k + 1, t + " end")]
    counts = np.full(1 << 20, near_duplicates.codes(np.array([300]))[0], dtype=np.uint8)
    assert abs(int(near_duplicates.counts_of(counts[:1])[0]) - 300) < 40
    links, _ = met([rows[:150], rows[150:]], counts, 4)
    assert {(k, k + 1) for k in range(0, 300, 2)} <= links
    # 10 million records: 50 blocks
    monkeypatch.setattr(near_duplicates, "HOT", 200_000)
    counts[:] = near_duplicates.codes(np.array([10_000_000]))[0]
    blobs = dict(near_duplicates._postings(np.array([1]), [rows[0][1]], 5, 0.7, 60, counts, 1))
    postings = len(near_duplicates.unpack(blobs[0], "u8", "i8", "u4", "u8", "u1", "u4")[5])
    prefix = int(near_duplicates.prefix_lengths(np.array([71]), 0.7)[0][0])
    assert 45 * prefix <= postings <= 55 * prefix


def test_large_classes_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    t = texts(11, 3, 90)
    base = [x for x in t if len(x.split(" ")) >= 60] or [" ".join(WORDS[:80])]
    rows = [(k, base[0] + " tail" * (k % 2)) for k in range(60)]
    got = [tuple(x) for x in near_duplicates.similar_pairs(frame(spark, rows), "id", "body", buckets=3).collect()]
    assert len(got) == len(set(got)) and set(got) == similar(rows)


def test_rounds_over_the_texts(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "ROUND", 2)
    rows = list(enumerate(texts(12, 60)))
    got = [tuple(x) for x in near_duplicates.similar_pairs(frame(spark, rows), "id", "body", buckets=5).collect()]
    assert len(got) == len(set(got)) and set(got) == similar(rows)


def test_groups(spark):
    rows = list(enumerate(texts(3, 80)))
    got = {r["key"]: r["class_id"] for r in near_duplicates.groups(frame(spark, rows), "id", "body").collect()}
    low = {}

    def find(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in similar(rows):
        a, b = sorted((find(a), find(b)))
        low[b] = a
    assert got == {k: find(k) for k in low}


def covered(rows, span):
    seen = {}
    for k, t in rows:
        for i in range(len(t or "") - span + 1):
            seen.setdefault(t[i : i + span], set()).add(k)
    out = {}
    for k, t in rows:
        hit = set()
        for i in range(len(t or "") - span + 1):
            if len(seen[t[i : i + span]]) > 1:
                hit |= set(range(i, i + span))
        if hit:
            out[k] = len(hit)
    return out


def test_automata_locate_every_phrase():
    text = "xabcabcy" * 3
    got = shared_spans.located(shared_spans.automaton(["abc", "bca", "γ😀z"]), text + "γ😀z")
    assert sorted(got) == sorted([i for i in range(24) if text[i : i + 3] in ("abc", "bca")] + [24])


@pytest.mark.parametrize("phrases,records,parts", [(5000, 20_000, 16_000), (7, 5, 2)])
def test_shared_spans(spark, monkeypatch, phrases, records, parts):
    # many small shards, each spread over tasks and several in a partition, find the same
    monkeypatch.setattr(shared_spans, "PHRASES", phrases)
    monkeypatch.setattr(shared_spans, "RECORDS", records)
    monkeypatch.setattr(shared_spans, "PARTS", parts)
    r = random.Random(7)
    alphabet = "abcdef \nγ😀"
    pool = ["".join(r.choice(alphabet) for _ in range(n)) for n in (299, 300, 301, 420, 700, 1500)]
    rows = []
    for k in range(60):
        noise = lambda n: "".join(r.choice(alphabet) for _ in range(r.randrange(n)))
        s = r.choice(pool)
        i = r.randrange(0, max(1, len(s) - 310))
        rows.append((k, noise(400) + s[i:] + noise(400)))
    rows += [(100, None), (101, ""), (102, "z" * 3000), (103, "z" * 400), (104, "q" * 5000)]
    df = frame(spark, [*rows, (None, pool[4])])
    want = covered(rows, shared_spans.SPAN)
    assert {x["record_key"] for x in shared_spans.sharing_records(df, "id", "body").collect()} == set(want)
    got = {x["record_key"]: x["n_shared"] for x in shared_spans.shared_amounts(df, "id", "body").collect()}
    assert {k: v for k, v in got.items() if v} == want and set(got) == {k for k, _ in rows}


LINES = "".join(f"{chr(97 + k % 26)} Block {k} x 2 | deep red\nb stud hole a stud b {k % 360}\n" for k in range(400))


@pytest.mark.parametrize("text", [LINES, LINES.replace("\n", "\r\n"), LINES.replace("\n", "\\n"), LINES.replace("\n", "; "), LINES.replace("\n", " "), "x" * 20_000, "y" * 3001, LINES[:2900] + "k" * 9000 + LINES[:4000], "\n" * 7000])
def test_pieces(spark, text):
    df = frame(spark, [(1, text), (2, "short"), (3, None), (4, ""), (5, "z" * 3000)])
    rows = splitting.split_items(df, "id", "body").orderBy("key", "piece").collect()
    assert {r["key"] for r in rows} == {1, 2, 4, 5}
    mine = [r for r in rows if r["key"] == 1]
    assert len(mine) > 1 and {r["key"] for r in splitting.oversized(df, "id", "body").collect()} == {1}
    whole = ""
    for i, r in enumerate(mine):
        assert len(r["text"]) <= splitting.LIMIT and r["n_pieces"] == len(mine) and r["text"] == text[r["start"] : r["end"]]
        if i:
            assert splitting.LEAST <= r["overlap"] <= splitting.MOST and r["start"] == mine[i - 1]["end"] - r["overlap"]
        whole += r["text"][r["overlap"] :]
    assert whole == text
    if text is LINES:
        # all cuts end actions
        assert all(re.search(r"\d\n$", r["text"]) for r in mine)


def test_greedy_cuts_by_loop():
    # the doubled table gives what a step by step walk gives
    text = LINES + "t" * 5000 + LINES
    no, start, end = splitting.cut([text, LINES])
    assert list(np.bincount(no)) == [(no == 0).sum(), (no == 1).sum()]
    for t, s in ((0, text), (1, LINES)):
        a, b = start[no == t], end[no == t]
        assert a[0] == 0 and b[-1] == len(s) and (a[1:] < b[:-1]).all() and (np.diff(b) > 0).all()


def leaked(docs, items, run=13):
    words = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t)]
    grams = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    return {(i, d) for d, t in docs for w in [words(t or "")] for k in range(len(w) - run + 1) for i in grams.get(tuple(w[k : k + run]), ()) if d is not None and i is not None}


def test_leaks(spark):
    r = random.Random(3)
    vocabulary = [f"v{k}" for k in range(30)] + ["Été", "42", "straße"]
    item = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(item(r.randrange(5, 40)))) for k in range(25)] + [(90, None), (91, ""), (None, "a b"), (92, "one " * 13)]
    docs = []
    for k in range(60):
        w = items[r.randrange(25)][1].split(" ")
        i, n = r.randrange(len(w)), r.choice([11, 12, 13, 14, 30])
        docs.append((k, (" " + r.choice([" ", "\n", " - ", "... "])).join(item(9) + [x.upper() for x in w[i : i + n]] + item(9))))
    docs += [(200, None), (201, ""), (None, "x"), (202, "one " * 40)]
    left = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item", "2 as f")
    right = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as doc")
    want = leaked(docs, items)
    for held in (leakage.HELD_WORDS, 0):
        got = [(x["item_id"], x["doc_id"]) for x in leakage.leaks(left, right, held_words=held).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert (92, 202) in want


def test_empty_tables(spark):
    df = frame(spark, [(1, "a")]).limit(0)
    assert near_duplicates.similar_pairs(df, "id", "body").count() == 0
    assert near_duplicates.groups(df, "id", "body").count() == 0
    assert shared_spans.sharing_records(df, "id", "body").count() == 0
    assert shared_spans.shared_amounts(df, "id", "body").count() == 0
    assert splitting.split_items(df, "id", "body").count() == 0
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert leakage.leaks(docs, spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).count() == 0
    assert leakage.leaks(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_postings_of_one_round_at_a_time(spark, monkeypatch):
    """Many buckets: the disk holds one round's postings, and the pairs are the same."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(r.choices(words, k=r.randrange(70, 200)))) for k in range(60)]
    rows += [(100 + k, t + " and one word") for k, t in rows[:20]] + [(200 + k, t) for k, t in rows[:5]]
    df = spark.createDataFrame(rows, "key bigint, text string")
    want = {tuple(x) for x in near_duplicates.candidates(df, "key", "text", buckets=2).collect()}
    monkeypatch.setattr(near_duplicates, "FEWEST", 4)
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().endswith(".data")}
    run, seen = near_duplicates.checkpointed, []
    monkeypatch.setattr(near_duplicates, "checkpointed", lambda x: (seen.append(files()), run(x))[1])
    got = near_duplicates.candidates(df, "key", "text", buckets=60)
    left = files()
    assert {tuple(x) for x in got.collect()} == want and len(want) >= 25
    # the prefixes once, then 15 rounds of which none leaves its shuffle files
    assert len(seen) == 16 and left <= seen[1]
