from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from pitchline.llm import langid

WORDS = {"en": "the of and ing tion her with that from this".split(), "de": "der die und ung keit schaft nicht auf ein zu".split(), "es": "que los las ción mente ado para una con del".split()}


def sentence(lang: str, n: int, rng: random.Random) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(n))


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    k, sizes = 3, [70, 0, 1, 79, 33]
    first = np.concatenate([[0], np.cumsum(sizes)])
    score, start, move = rng.normal(size=(first[-1], k)) * 2, rng.normal(size=k), rng.normal(size=(k, k))
    post, pair = langid.posteriors(score, first, start, move)
    want, pairs = np.zeros_like(post), np.zeros((k, k))
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            continue
        f, r = [np.exp(start + score[a])], [np.ones(k)]
        for t in range(a + 1, b):
            f.append((f[-1] @ np.exp(move)) * np.exp(score[t]))
        for t in range(b - 1, a, -1):
            r.append(np.exp(move) @ (np.exp(score[t]) * r[-1]))
        r, z = r[::-1], f[-1].sum()
        for t in range(a, b):
            want[t] = f[t - a] * r[t - a] / z
        for t in range(a + 1, b):
            pairs += np.outer(f[t - 1 - a], np.exp(score[t]) * r[t - a]) * np.exp(move) / z
    assert np.abs(post - want).max() < 1e-12 and np.abs(pair - pairs).max() < 1e-9


def test_held_out_accuracy_and_code_switching(spark):
    rng = random.Random(2)
    rows = [(i, sentence(lang, rng.randint(5, 60), rng), lang) for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(240))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.col("doc_id") % 3 != 1)
    assert model.labels == ["de", "en", "es"] and (np.diag(model.move) > model.move.mean(axis=1)).all()
    got = {r["doc_id"]: r for r in langid.predict(df.filter("doc_id % 3 = 1"), model).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if i % 3 == 1]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    switched = spark.createDataFrame([(1, sentence("en", 12, rng) + " " + sentence("es", 12, rng))], "doc_id long, text string")
    tags = langid.tag_words(switched, model).first()["langs"]
    assert len(tags) == 24 and np.mean([t == "en" for t in tags[:12]]) > 0.8 and np.mean([t == "es" for t in tags[12:]]) > 0.8


def test_odd_rows(odd_docs, no_docs):
    model = langid.fit(odd_docs, F.lit(True))
    rows = langid.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0.0 for i in (5, 6, 7, 13))
    assert by[11]["lang_pred"] in ("de", "en")
    assert langid.predict(no_docs, model).count() == 0
    nothing = langid.fit(no_docs, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(odd_docs, nothing).collect()} == {"und"}


def test_signs_of_any_number_are_undetermined(spark):
    rng = random.Random(4)
    rows = [(i, sentence(lang, 20, rng), lang) for i, lang in enumerate(list(WORDS) * 20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    texts = ["— — — —", "• 😀 € 12 ─── ║ ║", "…", "— — — — être", "— — — é", "中 文 — —", "the — — — and", ""]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i]["lang_pred"] == "und" for i in range(len(texts))] == [True, True, True, False, False, False, False, True]
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) for r in got.values())
