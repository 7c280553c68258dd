"""Hard negatives, the Jaccard join and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridwarden.llm import jaccard, negatives, periodic, queries
from tests.compare import database, difference
from tests.llm import brute

SF = "/root/testdata/sf0.001"


# --- hard negatives ---


def mined(df, **more):
    return sorted(tuple(r) for r in negatives.mine_hard_negatives(df, F.col("vec_id") % 5 == 0, **more).collect())


def test_negatives_equal_sql(spark):
    got = queries.op11_negatives(spark, SF).toPandas()
    assert len(got) and difference(got, database(SF).execute(queries.ORACLES["op11_negatives"]).df()) is None


@pytest.mark.parametrize("seed", range(3))
def test_negatives_with_ties_and_a_hot_vector(spark, seed):
    r = random.Random(seed)
    rows = [(i, [r.randint(-3, 9) for _ in range(4)] if r.random() < 0.6 else [2, 1, 0, 3], r.choice([0, 0, 0, 1, 2])) for i in range(-40, 160)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>, label int")
    want = brute.hard_negatives(rows, lambda i: i % 5 == 0)
    assert len(want) > 30
    assert mined(df) == want
    assert mined(df, shard_rows=17, block_anchors=3) == want
    assert mined(df, positives=2, negatives=7, low=10, high=100, shard_rows=30) == brute.hard_negatives(rows, lambda i: i % 5 == 0, 2, 7, 10, 100)


def test_negatives_of_odd_rows(spark):
    rows = [(0, [5, 5], 1, "a"), (1, [5, 4], 1, "b"), (2, [3, 4], 2, "c"), (2, [9, 9], 3, "c"), (3, None, 1, "d"), (4, [1, None], 1, "d"), (5, [1], None, "e"), (None, [5, 5], 1, "f"), (6, [4], 2, "g"), (7, [], 2, "h"), (8, [2, 1, 7], 2, "i")]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>, label int, rank string")
    assert mined(df) == brute.hard_negatives([(0, [5, 5, 0], 1), (1, [5, 4, 0], 1), (2, [3, 4, 0], 2), (6, [4, 0, 0], 2), (7, [0, 0, 0], 2), (8, [2, 1, 7], 2)], lambda i: i % 5 == 0)
    assert mined(df.limit(0)) == []


def test_keys_sort_as_their_parts():
    r = random.Random(1)
    rows = [(r.randint(-3, 3), r.choice([-(1 << 60), -1, 0, 5, 1 << 60]), r.randint(0, 1), r.randint(-9, 9)) for _ in range(500)]
    columns = [list(c) for c in zip(*rows)]
    import numpy as np

    keys = negatives.pack(np.array(columns[0]), np.array(columns[1]), np.array(columns[2], np.uint8), np.array(columns[3]))
    assert [x for _, x in sorted(zip(keys, rows))] == sorted(rows, key=lambda x: (x[0], -x[1], x[2], x[3]))
    assert list(zip(*(c.tolist() for c in negatives.unpack(keys)))) == rows


# --- the Jaccard join ---


def near_texts(seed, groups, copies, words, edits):
    """Texts of which many are near copies, one group of them large, and a passage that many share."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    out = []
    for g in range(groups):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice(words))]
        for _ in range(copies if g else 6 * copies):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            if r.random() < 0.4:
                w = w[: r.randint(3 * len(w) // 4, len(w))]
            if r.random() < 0.15:
                w[len(w) // 2 : len(w) // 2] = passage
            out.append(" ".join(w))
    return out


def joined(df, **more):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, **more).collect()}


@pytest.mark.parametrize("more", [{"pair_up_to": 2, "boundary": 0}, {"boundary": 60}])
def test_join_equals_brute_force(spark, more):
    texts = near_texts(3, 8, 9, [60, 150, 300], 4) + near_texts(9, 6, 4, [8, 14, 20], 1) + [None, "", "one two", "One  TWO", "one two three"]
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.components(rows, 4, 85)
    assert len({c for _, c in want.values()}) < len(rows) - 30
    assert joined(df, **more) == want


def test_join_with_other_words_and_shares(spark):
    rows = list(enumerate(near_texts(8, 10, 5, [6, 25, 60], 3)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df, size=2, percent=70, pair_up_to=3) == brute.components(rows, 2, 70)


def test_join_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op12_jaccard(spark, SF).collect()}
    assert got == brute.components(rows, 4, 85)


def test_join_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, "b c d e f g"), (5, long), (3, long + " z"), (None, long), (None, None), (9, "b c d e f g"), (4, " \t ")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(*r, "x", 1) for r in order], "doc_id long, text string, _set string, label int")
        got = sorted((tuple(r) for r in jaccard.jaccard_components(df).collect()), key=str)
        assert got == sorted([(5, 3, 3), (5, 37, 3), (3, 38, 3), (None, 37, None), (None, 0, None), (9, 3, 3), (4, 0, 4)], key=str)
    assert jaccard.jaccard_components(df.limit(0)).collect() == []


def test_boundary_has_the_least_cost():
    r = random.Random(2)
    for _ in range(200):
        costs = [(k, r.randint(0, 50), r.randint(0, 50)) for k in sorted(r.sample(range(30), 8))]
        total = lambda at: sum(s if k < at else m for k, s, m in costs)
        assert total(jaccard.choose_boundary(costs)) == min(map(total, range(32)))


# --- periodic runs ---


@pytest.mark.parametrize("least", [2, 5, 12, 20])
def test_runs_equal_brute_force(least):
    r = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(r.randint(1, 6)):
            w = [b"%d" % r.randrange(r.choice([1, 2, 3, 20])) for _ in range(r.randint(0, 60))]
            if w and r.random() < 0.6:
                a = r.randrange(len(w))
                w = w[:a] + (w[a : a + r.randint(1, 30)] * r.randint(1, 9))[:150] + w[a:]
            texts.append(w)
        assert periodic.runs_of_texts(texts, least) == [brute.runs(w, least) for w in texts]


def test_runs_of_long_texts():
    assert periodic.runs_of_texts([[b"a"] * 50_000, [b"a", b"b"] * 20_000 + [b"c"]]) == [[(0, 50_000, 1)], [(0, 40_000, 2)]]
    assert periodic.runs_of_texts([[b"%d" % (i % 7001) for i in range(20_000)]]) == [[(0, 20_000, 7001)]]


def test_runs_of_the_table(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_runs(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts) and any(r["n_runs"] for r in got)
    for r in got:
        w = re.findall(rb"[^\x20\x09-\x0D]+", texts[r["doc_id"]].encode())
        h = zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute.runs(w)
        dropped = {i for s, n, q in found for i in range(s + q, s + n)}
        start, length, period = min(((-n, s, q) for s, n, q in found), default=(None, None, None))[1::-1] + (min(((-n, s, q) for s, n, q in found), default=(0, 0, None))[2],)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), start, length and -length, period)
        assert r["exponent_milli"] == (None if not found else 1000 * r["length"] // r["period"])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in dropped)).hexdigest()


def test_runs_of_odd_rows(spark):
    rows = [(1, "é b " * 8, "x"), (1, None, "y"), (None, "  \t", "z"), (2, "a " * 11, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic.find_runs(df, with_runs=True, with_text=True).collect()
    assert [(r["doc_id"], r["n_runs"], r["collapsed"], [tuple(x) for x in r["runs"]]) for r in got] == [(1, 1, "é b", [(0, 16, 2)]), (1, 0, "", []), (None, 0, "", []), (2, 0, " ".join("a" * 11), [])]
    assert periodic.find_runs(df, keep=["doc_id", "runs"]).columns[:2] == ["doc_id", "runs"]
    with pytest.raises(ValueError):
        periodic.find_runs(df, keep=["doc_id", "runs"], with_runs=True)
    assert periodic.find_runs(df.limit(0)).collect() == []
