from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from pitchline.llm import phrases, registry
from pitchline.llm import sql as S

DATA = "/root/testdata/sf0.001"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, longest=4, least=30, percent=80, top=2000):
    """The contract by loops."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= percent * c[p[i:j]]}
        best = [(*min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p))), p, a) for p, a in often.items() if p not in gone]
        best.sort(key=lambda x: (-x[0], -x[3], " ".join(x[2]).encode()))
        out += [(lang, i + 1, " ".join(p), a, c[p[:k]], c[p[k:]], n[lang], score) for i, (score, k, p, a) in enumerate(best[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(11)
    words = ["New", "York", "city", "of", "the", "naïve", "a b", "x\x00y", "é", "-"]
    seps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "!?"]
    rows = [("".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "und"])) for _ in range(300)]
    return rows + [(None, "en"), ("", None), (" \t. ;", "empty"), ("one", "fr"), ("New York " * 3000, "en"), rows[0], rows[0]]


@pytest.mark.parametrize("settings", [{"least": 5}, {"least": 40, "percent": 50}, {"least": 3, "top": 7}, {"least": 2, "longest": 2}, {"least": 4, "longest": 5}])
def test_equals_plain_loops_even_in_tiny_sketches(spark, some, settings):
    df = spark.createDataFrame([(*r, "k", 1) for r in some], "text string, lang string, phrase string, n int").repartition(3)
    want = plain(some, **settings)
    assert want and rows_of(phrases.collocations(df, **settings)) == want
    assert rows_of(phrases.collocations(df, bits=4, **settings)) == want  # full of collisions: nothing is lost, nothing is added


def test_sketches_add_up_and_rule_out(spark, some):
    df = spark.createDataFrame([(r[0], r[1] or "und") for r in some], "text string, lang string").repartition(4)
    reached = phrases.add_sketches(df, phrases.Reached(14, 30), (1, 2))
    words = phrases.Words(*_chunk([r[0] or "" for r in some]), [r[1] or "und" for r in some])
    count = Counter()
    for n, h in enumerate(words.hashes(2), 1):
        count.update((n, x) for x in h[: len(words.runs(n))][words.runs(n)].tolist())
    often = {k for k, v in count.items() if v >= 30}
    import numpy as np

    seen = {(n, x) for n in (1, 2) for xs in [np.array([x for m, x in count if m == n], np.uint64)] for x, ok in zip(xs.tolist(), reached(n, xs).tolist(), strict=True) if ok}
    assert often <= seen and len(seen - often) < 0.05 * len(count)


def _chunk(texts):
    import numpy as np

    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def test_blocks_of_cells_are_packed_whole():
    import numpy as np

    rng = np.random.default_rng(1)
    for share in (0.0, 0.01, 0.2, 0.9):
        counts = np.where(rng.random(1 << 14) < share, rng.integers(1, 30, 1 << 14), 0).astype(np.uint8)
        assert (phrases._unpacked(phrases._packed(counts), 1 << 14) == counts).all()


def test_large_counts_stay_exact(spark):
    big = 3_000_000_000_000_000
    counts = spark.createDataFrame([("en", 1, "a", big + 1), ("en", 1, "b", big + 3), ("en", 2, "a b", big)], "lang string, words int, phrase string, n long")
    assert phrases.cohesion(counts).first()["score"] == 2_000_000 * big // (2 * big + 4)


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert rows_of(registry.op12_phrase_collocations(spark, DATA)) == sorted(duck.sql(f"select {', '.join(COLUMNS)} from ({S.PHRASES})").fetchall())


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["text"], r["lang"]) for r in odd_docs.collect()]
    assert rows_of(phrases.collocations(odd_docs)) == plain(rows)
    assert phrases.collocations(no_docs).count() == 0 and phrases.frequent(no_docs).count() == 0
