"""Hard negatives, periodic runs and exact duplicates against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescope.llm import exact_dedup, hard_negatives, periodic_runs, queries

from . import brute
from .conftest import prose
from .test_operators import SF, clashing, rows

# --- periodic runs ---------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 9), st.integers(1, 4), st.sampled_from([2, 3, 12]))
def test_runs_of_words(word, times, spoil, least):
    data = word * times
    data = [9 if k and k % 31 == 0 and spoil == 1 else w for k, w in enumerate(data)][:160]
    assert periodic_runs.runs_of(np.array(data, np.int64), least) == brute.periodic_runs(data, least)


def test_runs_of_fibonacci_words_and_long_runs():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert periodic_runs.runs_of(np.array(b), 2) == brute.periodic_runs(b, 2)
    long = np.arange(60_000) % 1000
    assert periodic_runs.runs_of(long) == [(0, 60_000, 1000)]
    assert periodic_runs.runs_of(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]


def test_stretches_hold_all_runs():
    rng = random.Random(3)
    for _ in range(60):
        data = [rng.randrange(50) for _ in range(rng.randint(0, 300))]
        for _ in range(3):
            at, p, n = rng.randint(0, 250), rng.randint(1, 20), rng.randint(12, 60)
            data[at:at] = [100 + k % p for k in range(n)]
        parts = periodic_runs.stretches(np.array(data, np.int64))
        for start, length, _ in brute.periodic_runs(data):
            assert any(a <= start and start + length <= b for a, b in parts)


@pytest.fixture(scope="module")
def looped(corpus):
    rng = random.Random(17)
    line = prose(rng, 9)
    extra = [f"{prose(rng, 40)} {(line + ' ') * 5}{prose(rng, 20)} {(line + ' ') * 2}", "x " * 11, "x " * 12, "a b " * 6, "tail " + "a b c d e f g " * 2 + "a", (prose(rng, 300) + " ") * 2]
    extra += [f"{a} {b}" for a, b in zip(extra, reversed(extra))]
    ids = [d for d in range(1000, 4000) if __import__("zlib").crc32(str(d).encode()) % 10 == 0]
    return [*corpus, *((100_000 + i, t) for i, t in enumerate(extra)), *((d, prose(rng, rng.randint(1, 200))) for d in ids[:40]), (None, extra[0]), (ids[40], None), (ids[41], ""), (ids[41], "one"), (ids[0], extra[1]), (ids[0], extra[1])]


def test_periodic_runs(spark, looped):
    docs = spark.createDataFrame(looped, "doc_id long, text string").repartition(5)
    want = Counter(brute.runs(looped))
    assert sum(r[1] > 0 for r in want) > 20
    assert rows(periodic_runs.runs_report(docs)) == want
    assert rows(periodic_runs.runs_report(clashing(docs).withColumns({n: F.lit(1) for n in ("runs", "best", "collapsed")}))) == want
    assert periodic_runs.runs_report(docs.limit(0)).collect() == []


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "see  a b c a b c a b c\ta b c end"), (2, "no repeats")], "doc_id long, text string")
    got = {r["doc_id"]: (r["collapsed"], r["n_words"], [tuple(x) for x in r["runs"]]) for r in periodic_runs.with_runs(docs).collect()}
    assert got == {1: ("see a b c end", 14, [(1, 12, 3)]), 2: ("no repeats", 2, [])}


# --- exact duplicates ------------------------------------------------------------------


def test_exact_dedup(docs, corpus, no_docs):
    got = exact_dedup.exact_report(docs)
    assert rows(got.drop("kept")) == Counter(brute.exact_copies(corpus))
    assert rows(exact_dedup.exact_report(clashing(docs).withColumns({n: F.lit(1) for n in ("sha", "size", "block", "keep_id", "keep_row")}))) == rows(got)
    assert exact_dedup.exact_report(no_docs).collect() == []


@pytest.mark.parametrize("bits,node_bytes", [(1, 500), (2, 2000), (3, 100)])
def test_exact_dedup_in_many_rounds(spark, monkeypatch, bits, node_bytes):
    rng = random.Random(bits)
    texts = ["hot  text", "hot\ttext", *(prose(rng, 5) for _ in range(40)), None, "", " ", "\n\n"]
    data = [(rng.choice([None, *range(200)]), rng.choice(texts[:2]) if rng.random() < 0.4 else rng.choice(texts)) for _ in range(700)]
    monkeypatch.setattr(exact_dedup.tree_merge, "__defaults__", (bits, node_bytes, 7, 20))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(9)
    got = exact_dedup.exact_report(docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == Counter(brute.exact_copies(data))
    kept = Counter(r["text_sha256"] for r in got if r["kept"])  # one row of each group, with its smallest id
    assert kept == Counter({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_merge_verifies_whole_digests():
    x = np.zeros(6, exact_dedup.ENTRY)
    x["a"], x["d"], x["size"] = [5, 5, 5, 5, 9, 9], [1, 2, 1, 1, 0, 0], [3, 3, 3, 4, 1, 1]
    x["id"], x["none"], x["count"], x["row"] = [8, 1, 2, 7, 0, 6], [0, 0, 0, 0, 1, 0], 1, range(6)
    got = [(int(r["a"]), int(r["d"]), int(r["size"]), int(r["id"]), int(r["none"]), int(r["row"]), int(r["count"])) for r in exact_dedup.merged(x)]
    assert sorted(got) == [(5, 1, 3, 2, 0, 2, 2), (5, 1, 4, 7, 0, 3, 1), (5, 2, 3, 1, 0, 1, 1), (9, 0, 1, 6, 0, 5, 2)]


def test_rows_that_stay(docs, corpus):
    again = clashing(docs.unionByName(docs))
    left = exact_dedup.without_copies(again)
    assert left.columns == again.columns
    want = {(k, s) for _, k, _, s in brute.exact_copies(corpus)}
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(k for k, _ in want)


def test_exact_dedup_oracle(spark):
    from tests.oracle import compare

    ok, why = compare(spark, "op13", queries.op13_exact_dedup, exact_dedup.ORACLE, SF)
    assert ok, why


# --- hard negatives --------------------------------------------------------------------


def vectors(rng, n, dims=6, labels=10):
    out = []
    for i in range(n):
        v = [rng.uniform(-1, 1) for _ in range(dims)]
        if i % 3 == 0:
            v = [0.5] * dims  # a third of all rows are one vector
        out.append((i, v, rng.randrange(labels)))
    return out


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("block,group,depth", [(8192, 512, 32), (17, 2, 1), (64, 1, 3)])
def test_hard_negatives(spark, monkeypatch, block, group, depth):
    rng = random.Random(block)
    inf, nan = float("inf"), float("nan")
    data = vectors(rng, 420, labels=3)
    data += [(500, [0.1] * 6, None), (600, None, 1), (700, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (800, [nan] * 6, 1), (900, [inf, 0.0, 0.0, 0.0, 0.0, 0.0], 1)]
    data += [(None, [0.4] * 6, 1), (None, [0.6] * 6, 2), (1000, [0.5, 0.5], 0), (1100, [], 1), (1200, [0.0] * 6, 2), (100, [0.3] * 6, 1), (-700, [1.0] * 6, 2), (1300, [-0.5] * 6, 0)]
    monkeypatch.setattr(hard_negatives.hard_negatives, "__defaults__", (None, 5, 5, 80, block, group, depth))
    frame = spark.createDataFrame(data, SCHEMA).coalesce(1)
    got = hard_negatives.mining_report(frame)
    want = brute.hard_negatives(data)
    assert sum(want.values()) > 50
    assert Counter(tuple(r) for r in got.collect()) == want
    more = frame.withColumns({n: F.lit(1) for n in ("_row", "x", "block", "group", "rank", "score", "positive", "anchor_row", "bounds")})
    assert Counter(tuple(r) for r in hard_negatives.mining_report(more).collect()) == want


def test_hard_negatives_of_large_numbers_and_nothing(spark):
    rng = random.Random(4)
    for scale in (1e8, 1e11):  # scores in 64 bits, and beyond
        data = [(i, [round(x * scale) / 256 for x in v], label) for i, v, label in vectors(rng, 120, 4, 2)]
        got = hard_negatives.mining_report(spark.createDataFrame(data, SCHEMA).coalesce(1)).collect()
        cut = lambda v: max(-(1 << 63), min((1 << 63) - 1, v))
        want = Counter()
        for (*key, ps, ns), n in brute.hard_negatives(data).items():
            want[(*key, cut(ps), cut(ns))] += n
        assert Counter(tuple(r) for r in got) == want
    assert hard_negatives.mining_report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hard_negatives.mining_report(spark.createDataFrame([(100, [0.1], 3), (1, [0.2], 4)], SCHEMA)).collect() == []


def test_search_stops_early():
    """Where one dimension rules, the threshold falls below the k-th score long before the end."""
    rng = np.random.default_rng(1)
    x = np.zeros((5000, 3))
    x[:, 0] = np.arange(5000)
    x[:, 1:] = rng.integers(-3, 3, (5000, 2))
    block = hard_negatives.Block(x, np.zeros(5000, np.int64), list(range(5000)), np.arange(5000))
    seen = []

    class Counted(hard_negatives.Top):
        def add(self, score, at, place):
            seen.append(len(at))
            super().add(score, at, place)

    top = Counted(5)
    hard_negatives.search(block, x, np.array([1.0, 0.0, 0.0]), np.ones(5000, bool), [top])
    assert top.at.tolist() == [4999, 4998, 4997, 4996, 4995] and sum(seen) < 100


def test_hard_negatives_oracle(spark):
    from tests.oracle import compare

    ok, why = compare(spark, "op11", queries.op11_hard_negatives, hard_negatives.ORACLE, "/root/testdata/sf0.01")
    assert ok, why
