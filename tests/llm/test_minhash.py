from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pitchline.llm import minhash, wordhash
from pitchline.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None, k: int = 5) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows: list[tuple], percent: int) -> dict:
    """doc_id -> smallest reachable doc_id, every pair compared."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in rows}


def edited(words: list[str], edits: int, rng: random.Random) -> str:
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def family(spark):
    """Groups of copies and near copies, one of them large and with many that just miss the threshold."""
    rng = random.Random(5)
    rows = []
    for g in range(6):
        words = [f"w{rng.randrange(3000)}" for _ in range(160)]
        for _ in range(420 if g == 0 else 12):
            rows.append((len(rows) * 3 % 5003, edited(words, rng.choice([0, 1, 1, 2, 3, 4, 6]), rng)))
    for n in (1, 2, 4, 5, 6, 9):
        words = " ".join(f"s{n}x{i}" for i in range(n))
        rows += [(6000 + 3 * n, words), (6001 + 3 * n, words.upper())]
    return rows


@pytest.mark.parametrize("percent", [85, 80])
def test_components_equal_brute_force(spark, family, percent):
    df = spark.createDataFrame(family, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, percent=percent).collect()}
    want = brute(family, percent)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (want[i] == i) and r["n_shingles"] == len(shingle_set(dict(family)[i])) for i, r in got.items())


def test_large_buckets_are_compared_part_by_part(spark, family, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "PART", 16)
    df = spark.createDataFrame(family, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == brute(family, 85)


def test_keys_are_shared_by_all_signatures_within_the_distance():
    rng = np.random.default_rng(0)
    for percent in (80, 85, 90):
        chunks = minhash.chunks_for(percent)
        for _ in range(200):
            a = rng.integers(0, 2**16, minhash.POSITIONS).astype(np.uint16)
            b = a.copy()
            at = rng.choice(minhash.POSITIONS, 2 * chunks - 1, replace=False)
            b[at] ^= np.uint16(1) + rng.integers(0, 2**15, len(at)).astype(np.uint16)
            ka, kb = minhash.keys(np.stack([a, b]), chunks)
            assert (ka == kb).any()


def test_odd_rows(spark, odd_docs, no_docs):
    out = minhash.near_duplicates(odd_docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[0][0]["component_id"] == by[1][0]["component_id"] == by[2][0]["component_id"] == by[14][0]["component_id"] == 0
    assert len(by[0]) == 3 and all(r["kept"] for r in by[0])
    assert all(by[i][0]["n_shingles"] == 0 and by[i][0]["kept"] for i in (5, 6, 7))
    assert by[None][0]["component_id"] == 0 and not by[None][0]["kept"]
    assert by[9][0]["n_shingles"] == 1
    assert minhash.near_duplicates(no_docs).count() == 0
    kept = minhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {5, 6, 7, 0, 4, 8, 9} <= set(ids) and not {1, 2, 14} & set(ids)
    assert minhash.drop_near_duplicates(no_docs).count() == 0


def test_word_hashes_follow_words_and_case():
    texts = pa.array(["The quick", "the QUICK\x0bfox", None, "", "É é"])
    (_, _, data, off), *rest = wordhash.chunks(texts)
    h, first = wordhash.words(data, off)
    assert not rest and first.tolist() == [0, 2, 5, 5, 5, 7]
    assert (h[:2] == h[2:4]).all() and h[5] != h[6]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (300, None)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys((100, 150, 200), 100)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_without_a_key_are_documents_of_their_own(spark):
    rng = random.Random(77)
    t, u, v = (" ".join(f"{c}{rng.randrange(900)}" for _ in range(80)) for c in "tuv")
    near = u.rsplit(" ", 1)[0] + " other"
    rows = [(1, t, "a"), (None, t, "a"), (None, "", "a"), (None, "", "a"), (None, None, "b"), (None, u, "a"), (None, near, "a"), (None, u, "a"), (5, v, "b"), (5, v, "a"), (None, "one two", "a"), (None, "one two", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept = sorted(minhash.drop_near_duplicates(df).collect(), key=str)
    by = {}
    for r in kept:
        by.setdefault(r["text"], []).append((r["doc_id"], r["source"]))
    assert by[t] == [(1, "a")] and len(by[""]) == 2 and by[None] == [(None, "b")]
    assert len(by.get(u, []) + by.get(near, [])) == 1 and len(by["one two"]) == 1 and len(by[v]) == 1 and by[v][0][0] == 5
    again = sorted(minhash.drop_near_duplicates(df.repartition(7)).collect(), key=str)
    assert again == kept
    found = minhash.near_duplicates(df, percent=80).collect()
    assert len(found) == len(rows)
    assert sorted((r["component_id"] is None, r["kept"]) for r in found if r["doc_id"] is None and r["n_shingles"] > 0) == [(False, False)] + [(True, True)] * 5


def test_intersections_equal_set_operations():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = []
    for _ in range(90):
        own = rng.integers(0, 2**63, rng.integers(1, 30), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([common[rng.random(60) < 0.7], own, sets[rng.integers(len(sets))][:5] if sets else own])))
    for left, right in ((np.arange(90), np.arange(90)), (np.arange(30), np.arange(30, 90))):
        got = minhash.overlaps(sets, left, right)
        assert all(got[i, j] == len(np.intersect1d(sets[p], sets[q])) for i, p in enumerate(left) for j, q in enumerate(right) if p != q)
