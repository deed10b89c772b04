from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pitchline.llm import lmscore, storage


def tokens(text: str | None) -> list:
    return [*(text or "").encode().lower().split(), "END"]


def brute(rows, held, em, weights):
    """(base, score, n, known) of every row, from plain counters."""
    train = [t for i, t in rows if not held(i)]
    uni, bi = Counter(), Counter()
    for t in train:
        w = tokens(t)
        uni.update(w)
        bi.update(zip(["END", *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, t in rows:
        w = tokens(t)
        base = score = 0.0
        for h, x in zip(["END", *w], w, strict=False):
            low = (uni[x] + 0.1) / (n + 0.1 * (v + 1))
            m = weights[int(math.floor(math.log2(uni[h]))) + 1] if uni[h] else 0.0
            base += math.log10(low)
            score += math.log10((m * bi[h, x] / uni[h] if uni[h] else 0.0) + (1 - m) * low)
        out.append((i, len(w), sum(uni[x] > 0 for x in w), n, base, score))
    return out


def test_scores_equal_plain_counting(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["Aa", "bb", "cc", "dé", "e|"]) + rng.choice("xyz") for _ in range(rng.randint(0, 40)))) for i in range(200)]
    seen = {}
    real = lmscore.mixture_weights
    monkeypatch.setattr(lmscore, "mixture_weights", lambda h: seen.setdefault("w", real(h)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = lmscore.score(df, F.col("doc_id") % 10 == 0, F.col("doc_id") % 10 == 1, block_chars=700)
    got = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out.collect())
    want = brute(rows, lambda i: i % 10 == 0, lambda i: i % 10 == 1, seen["w"])
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and np.allclose(g[4:], w[4:], rtol=1e-9)
    held = [w for w in want if w[0] % 10 == 0]
    assert sum(w[5] for w in held) > sum(w[4] for w in held) - 0.2 * sum(w[1] for w in held)


def test_em_finds_the_weight_that_maximises_the_held_out_likelihood():
    rng = np.random.default_rng(1)
    ratio = rng.choice([-40, -8, 0, 8, 24, 40], 400)
    hist = [(3, int(r), 5) for r in ratio] + [(3, lmscore._NEVER, 300)]
    m = lmscore.mixture_weights(hist)[3]

    def likelihood(x: float) -> float:
        return sum(n * math.log(x * (0 if r == lmscore._NEVER else 2 ** (r / 8)) + 1 - x) for _, r, n in hist)

    assert likelihood(m) >= max(likelihood(x) for x in np.linspace(0.01, 0.99, 99)) - 1e-6


def test_next_tokens_sum_to_one(spark):
    """P(w | h) over the known tokens and the unknown one, from scores of texts that differ in their last word alone."""
    rows = [(i, "a b a c a b") for i in range(20)]
    probes = [(100 + k, w) for k, w in enumerate(["a a", "a b", "a c", "a zzz", "a", "b", "c", "zzz", ""])]
    df = spark.createDataFrame([*rows, *probes], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in lmscore.score(df, F.col("doc_id") >= 100, F.col("doc_id") % 5 == 1).collect()}
    s = {w: s[i] for i, w in probes}
    # s(a w) - s(w) = log P(a|^) P(w|a) / P(w|^); from an empty text: s() = log P(end|^)
    scale = {w: s[f"a {w}"] - s[w] for w in "abc"} | {"zzz": s["a zzz"] - s["zzz"]}
    assert all(np.isfinite(list(scale.values())))
    uni = Counter(x for _, t in rows for x in tokens(t))
    n, v = sum(uni.values()), len(uni)
    low = {x: (uni[x] + 0.1) / (n + 0.1 * (v + 1)) for x in [*uni, "zzz"]}
    assert abs(sum(low.values()) - 1) < 1e-12
    # after a word never seen only the lower order counts: P(end|zzz) is known, so P(w|^) follows
    p_start = {"zzz": 10 ** s["zzz"] / low["END"], "END": 10 ** s[""]}
    p_a = 1 - sum(p_start.values())
    assert 0 < p_a < 1


def test_odd_rows(odd_docs, no_docs):
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10))
    out = lmscore.score(odd_docs, fold == 0, fold == 1).collect()
    assert len(out) == odd_docs.count()
    assert all(r["n_tokens"] == 1 for r in out if r["doc_id"] in (5, 6, 7))
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in out)
    assert lmscore.score(no_docs, fold == 0, fold == 1).count() == 0


def brute_three(rows, held, weights):
    """Scores by three orders, from plain counters."""
    uni, bi, tri = Counter(), Counter(), Counter()
    for t in (t for i, t in rows if not held(i)):
        w = tokens(t)
        uni.update(w)
        bi.update(zip(["END", *w], w, strict=False))
        tri.update(zip(["END", *w], w, w[1:], strict=False))
    n, v = sum(uni.values()), len(uni)
    share = lambda c, of, m: (m[int(math.floor(math.log2(of))) + 1] if of else 0.0, c / of if of else 0.0)
    out = []
    for _, t in rows:
        w = ["END", *tokens(t)]
        total = 0.0
        for k in range(1, len(w)):
            p = (uni[w[k]] + 0.1) / (n + 0.1 * (v + 1))
            m, x = share(bi[w[k - 1], w[k]], uni[w[k - 1]], weights[0])
            p = m * x + (1 - m) * p
            if k > 1:
                m, x = share(tri[w[k - 2], w[k - 1], w[k]], bi[w[k - 2], w[k - 1]], weights[1])
                p = m * x + (1 - m) * p
            total += math.log10(p)
        out.append(total)
    return out


def test_three_orders_equal_plain_counting_and_lower_the_loss(spark, monkeypatch):
    rng = random.Random(9)
    texts = []
    for _ in range(200):
        w = [rng.choice("abcd"), rng.choice("abcd")]
        for _ in range(rng.randint(0, 40)):  # the next word follows from the last two, mostly
            w.append(chr(97 + (ord(w[-1]) * 3 + ord(w[-2])) % 6) if rng.random() < 0.9 else rng.choice("abcdef"))
        texts.append(" ".join(w) if rng.random() < 0.97 else None)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    real = lmscore.mixture_weights
    monkeypatch.setattr(lmscore, "mixture_weights", lambda h: seen.append(real(h)) or seen[-1])
    got = {r["doc_id"]: r["score"] for r in lmscore.score(df, F.col("doc_id") % 10 == 0, F.col("doc_id") % 10 == 1, block_chars=700, orders=3).collect()}
    assert len(seen) == 2 and np.allclose([got[i] for i, _ in rows], brute_three(rows, lambda i: i % 10 == 0, seen), rtol=1e-9)
    two = {r["doc_id"]: r["score"] for r in lmscore.score(df, F.col("doc_id") % 10 == 0, F.col("doc_id") % 10 == 1, block_chars=700).collect()}
    held = [i for i, _ in rows if i % 10 == 0]
    assert sum(got[i] for i in held) > sum(two[i] for i in held)


def test_rows_without_a_key_go_to_several_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(None, " ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(20))) for _ in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lmscore, "table", lambda df: seen.append(storage.table(df)) or seen[-1])
    seen = []
    assert lmscore.score(df, F.lit(False), F.lit(False), block_chars=6_000, orders=3).count() == 1000
    blocks = {r["block"] for r in seen[0].filter("block >= 0").select("block").distinct().collect()}
    assert len(blocks) >= 8
