from __future__ import annotations

import hashlib
import random

import numpy as np

from pyspark.sql import functions as F

from pitchline.llm import fingerprint


def test_next_and_edited_texts(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 300)
    rows = [(i, None if n % 50 == 7 else "".join(rng.choice("abc dé😀") for _ in range(rng.choice([0, 1, 2, 9, 80, 700])))) for n, i in enumerate(ids)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + (after[1] or "")[:half]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, changed = fingerprint.walk([text, edited])
        assert r["fingerprint"] == "".join("0123456789abcdef"[x] for x in own) and r["edited_fingerprint"] == "".join("0123456789abcdef"[x] for x in changed)
        assert 0 <= r["near_edited"] <= 1 and abs(r["near_next"] - _like(r["fingerprint"], got[after[0]]["fingerprint"], len(text), len(after[1] or ""))) < 1e-12


def _like(a: str, b: str, na: int, nb: int) -> float:
    return float(np.mean([x == y for x, y in zip(a, b, strict=True)])) if na and nb else float(na == nb)


def walk_brute(text: str) -> np.ndarray:
    """One character after the other."""
    from pitchline.llm import wordhash as W

    codes = np.array([ord(c) for c in text], np.uint32)
    h = W.mix(codes.astype(W.U) + W.U(0x2545F4914F6CDD1D))
    cls, sym = (h >> W.U(58)).astype(int), (h & W.U(15)).astype(int)
    out, p, takes = np.zeros(fingerprint.SLOTS, np.uint8), 0, dict[int, list[int]]()
    for j, slot in fingerprint._records(2 * len(text)):
        takes.setdefault(j, []).append(slot)
    for j in range(2 * len(text)):
        for slot in takes.get(j, []):
            out[slot] = sym[p] if p < len(text) else 0
        if p < len(text):
            p += int(fingerprint._bits(j // 4096)[j % 4096, cls[p]])
    return out


def test_walks_equal_a_walk_by_hand_and_follow_edit_distance():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (1, 5, 300, 2000)]
    got = fingerprint.walk([*texts, ""])
    for t, g in zip(texts, got, strict=False):
        assert (g == walk_brute(t)).all()
    assert not got[-1].any()
    t = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3000))
    near = t[:700] + "X" + t[700:1500] + t[1504:]
    other = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3000))
    a, b, c = fingerprint.walk([t, near, other])
    assert (a == b).mean() > 0.75 > 0.4 > (a == c).mean()


def test_odd_rows_and_near_groups(spark, odd_docs, no_docs):
    rows = fingerprint.fingerprint_with_next(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["fingerprint"] == by[1]["fingerprint"] == by[14]["fingerprint"] and by[5]["n_chars"] == 0
    assert fingerprint.fingerprint_with_next(no_docs).count() == 0
    one = fingerprint.fingerprint_with_next(odd_docs.filter("doc_id = 8")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    comp = {r["doc_id"]: r["component_id"] for r in fingerprint.near_by_edits(odd_docs).collect()}
    assert comp[0] == comp[1] == comp[3] == comp[14] == 0 and comp[10] == 10 and comp[5] == 5
    assert fingerprint.near_by_edits(no_docs).count() == 0


def test_near_groups_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for _ in range(40):  # few symbols: strangers share buckets
        base = "".join(rng.choice("aaaab") for _ in range(rng.choice([30, 200])))
        texts.append(base)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(base))
            base = base[:i] + rng.choice("bc") + base[i + rng.randrange(3) :]
            texts.append(base)
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = fingerprint.walk(texts)
    for least in (0.8, 0.9):
        want = list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                if (prints[i] == prints[j]).sum() >= least * fingerprint.SLOTS and want[i] != want[j]:
                    lo, hi = sorted((want[i], want[j]))
                    want = [lo if w == hi else w for w in want]
        assert 10 < len(set(want)) < len(texts)
        for small, part in ((24, 1000), (1, 7)):
            monkeypatch.setattr(fingerprint, "SMALL", small)
            monkeypatch.setattr(fingerprint, "PART", part)
            got = {r["doc_id"]: r["component_id"] for r in fingerprint.near_by_edits(df, least=least).collect()}
            assert [got[i] for i in range(len(texts))] == want


def test_equal_and_missing_keys_are_split_and_stay_in_order(spark):
    rng = random.Random(6)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    work = df.withColumns({"place": F.coalesce("doc_id", F.lit(-(2**63))), "tie": F.xxhash64("text")}).cache()
    sizes = {}
    ranked = work.withColumn("bucket", fingerprint._ranges(work, 12)).collect()
    for r in ranked:
        sizes.setdefault(r["bucket"], []).append(r)
    assert len(sizes) >= 12 and max(map(len, sizes.values())) < 200
    order = sorted(ranked, key=lambda r: (-r["place"], r["tie"]))
    assert [r["bucket"] for r in order] == sorted((r["bucket"] for r in ranked), reverse=True)
    want = {}
    for k, r in enumerate(order):
        t, after = r["text"], order[(k + 1) % len(order)]["text"]
        want.setdefault((r["doc_id"], hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()), []).append(k)
    got = fingerprint.fingerprint_with_next(df).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["edited_sha256"]) for r in got} == set(want)


def test_query_groups_equal_near_by_edits_and_recall_of_near_copies(spark):
    rng = random.Random(12)
    rows = []
    for g in range(60):
        base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.choice([200, 2000])))
        for _ in range(3):
            at = rng.randrange(len(base) // 2, len(base))
            rows.append((len(rows), base[:at] + "#" + base[at + 1 :]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in fingerprint.fingerprints_with_groups(df).collect()}
    assert got == {r["doc_id"]: r["component_id"] for r in fingerprint.near_by_edits(df, least=fingerprint.NEAR).collect()}
    prints = fingerprint.walk([t for _, t in rows])
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] == prints[j]).mean() >= fingerprint.NEAR]
    assert len(near) >= 100 and all(got[i] == got[j] for i, j in near)
