from __future__ import annotations

import numpy as np
import pytest

from pitchline.llm import vectors


def brute(ids, x, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v) for v in x]
    n = len(x)
    links, label = [0] * n, list(range(n))
    adj = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and len(x[i]) == len(x[j]):
                a, b = np.array(x[i], float), np.array(x[j], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    adj[i].append(j)
                    adj[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in adj[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        out.append((ids[i], links[i], min(ids[k] for k in seen)))
    return sorted(out)


@pytest.mark.parametrize("small_tiles", [False, True])
def test_equal_to_brute_force(spark, monkeypatch, small_tiles):
    if small_tiles:
        monkeypatch.setattr(vectors, "TILE", 24)
        monkeypatch.setattr(vectors, "BLOCK", 16)
        monkeypatch.setattr(vectors, "DENSE", 0.5)
    rng = np.random.default_rng(1)
    x = []
    for size, noise in ((60, 0.15), (40, 0.26), (20, 0.02)):
        c = rng.normal(size=24)
        c /= np.linalg.norm(c)
        x += [(c + noise * rng.normal(size=24) / np.sqrt(24) * 2).astype(np.float32).tolist() for _ in range(size)]
    x += rng.normal(size=(80, 24)).astype(np.float32).tolist()
    x += [x[0]] * 9 + [[2 * v for v in x[0]]]
    ids = [(i * 37) % 1009 for i in range(len(x))]
    df = spark.createDataFrame(list(zip(ids, x, strict=True)), "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect())
    assert got == brute(ids, x)
    assert max(g[1] for g in got) > 20


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 3), (2, [1.0, 0.0], 4), (3, None, None), (4, [], 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (None, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (2, [0.0, 1.0], 1), (10, [0.01, 1.0], 1), (11, [1e-300, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int").withColumnsRenamed({"n": "rep"})
    got = {}
    for r in vectors.near_vectors(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert got[1] == [(3, 1, True)] and got[None] == [(3, 1, False)]
    assert sorted(got[2]) == [(1, 1, False), (3, 1, False)]  # one id, two vectors: one node
    assert got[10] == [(1, 1, False)] and got[11] == [(3, 1, False)]
    assert all(got[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 9))
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
