"""Operator 5: language identification by a linear-chain conditional random field.

Words are labelled with languages in their context: each word's scores come from its affixes, its
inner n-grams and, as the lexicon, the word itself; transitions between the languages of
neighbouring words are learned with them.  Forward-backward gives every word's distribution,
so code-switched text gets a language word by word; a document's language is the one with
the largest sum over its words.

Training fits weights and transitions together by gradient steps on the conditional
likelihood.  Its sequences switch language on purpose: stretches of labelled documents follow
one another.  The fit uses a bounded sample of labelled rows (see ``MAX_DOCS``).

Features are hashed byte ranges, so all of a chunk's distinct words are scored in array
operations; forward and backward steps run over all documents of a chunk at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as W

#: Bound of the training sample: documents per language and characters per document.
MAX_DOCS, MAX_CHARS = 250, 8_000
TABLE_BITS, GRAMS, AFFIXES = 17, (2, 3, 4), (1, 2, 3, 4)
SEQUENCE, STRETCH, MAX_SEQUENCES, ROUNDS, RATE, RIDGE = 48, 12, 1500, 30, 0.2, 1e-3
#: Words that step together as a block of a sequence.
BLOCK = 32
CHUNK_BYTES = 4 << 20
UNDETERMINED = "und"
_rng = np.random.default_rng(505)
_SALT = _rng.integers(0, 2**63, 32, dtype=W.U) * W.U(2) + W.U(1)
_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = _LETTER[0x80:] = True


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs: the word itself, its affixes and inner n-grams, hashed to TABLE_BITS bits."""
    of = W.range_hashes(data)
    size = end - start
    word, feat = [np.arange(len(start))], [of(start, end) * _SALT[0]]
    for n in AFFIXES:
        long = np.flatnonzero(size >= n)
        word += [long, long]
        feat += [of(start[long], start[long] + n) * _SALT[n], of(end[long] - n, end[long]) * _SALT[8 + n]]
    for n in GRAMS:
        many = np.maximum(size - n + 1, 0)
        at = W.ranges(start, many)
        word.append(np.repeat(np.arange(len(start)), many))
        feat.append(of(at, at + n) * _SALT[16 + n])
    return np.concatenate(word), (np.concatenate(feat) >> W.U(64 - TABLE_BITS)).astype(np.int64)


@dataclass
class Model:
    """Languages, feature weights, and log-potentials of starts and transitions."""

    labels: list[str]
    weight: np.ndarray
    start: np.ndarray
    move: np.ndarray

    def scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        word, feat = features(data, start, end)
        rows = self.weight[feat]
        return np.stack([np.bincount(word, rows[:, k], len(start)) for k in range(rows.shape[1])], axis=1)


def posteriors(score: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's distribution and the expected transition counts, by forward-backward.

    ``first``: for every sequence the index of its first word, with an end.  Sequences are cut into
    blocks of ``BLOCK`` words.  All blocks first work out how they carry any state on, a product of
    transition matrices; chaining these gives each block what enters it from either side, exactly;
    then all blocks step together.  So a very long text takes no more steps than a short one.
    """
    k = score.shape[1]
    local = np.exp(score - score.max(axis=1, keepdims=True))
    step, begin = np.exp(move - move.max()), np.exp(start - start.max())
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    size = np.diff(first)
    many = -(-size // BLOCK)
    base = np.concatenate([[0], np.cumsum(many)])
    seq = np.repeat(np.arange(len(size)), many)
    place = np.arange(base[-1]) - base[seq]
    at = first[seq] + place * BLOCK
    length = np.minimum(BLOCK, first[seq + 1] - at)
    order = np.argsort(-length, kind="stable")
    at, head, length = at[order], (place == 0)[order], length[order]
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(BLOCK + 1)]  # blocks with more than t words
    carry = np.where(head[:, None, None], begin[None, None, :], step[None]) * local[at][:, None, :]
    for t in range(1, BLOCK):
        m = live[t]
        if not m:
            break
        carry[:m] = (carry[:m].reshape(-1, k) @ step).reshape(m, k, k) * local[at[:m] + t][:, None, :]
    block = np.empty_like(carry)
    block[order] = carry / carry.max(axis=(1, 2), keepdims=True)
    enter, leave = np.full((len(at), k), 1.0 / k), np.ones((len(at), k))
    by_many = np.argsort(-many, kind="stable")
    for s in range(1, int(many.max(initial=0))):
        b = base[by_many[: np.searchsorted(-many[by_many], -s, "left")]] + s
        enter[b] = norm(np.einsum("nj,njk->nk", enter[b - 1], block[b - 1]))
    for s in range(int(many.max(initial=0)) - 1, 0, -1):
        b = base[by_many[: np.searchsorted(-many[by_many], -s, "left")]] + s
        leave[b - 1] = norm(np.einsum("njk,nk->nj", block[b], leave[b]))
    forward, backward = np.empty_like(local), np.empty_like(local)
    f, r = enter[order], leave[order]
    for t in range(BLOCK):
        m = live[t]
        if not m:
            break
        came = np.where(head[:, None], begin, f @ step) if t == 0 else f[:m] @ step
        f[:m] = norm(came * local[at[:m] + t])
        forward[at[:m] + t] = f[:m]
    for t in range(BLOCK - 1, -1, -1):
        m = live[t + 1]
        r[:m] = norm((local[at[:m] + t + 1] * r[:m]) @ step.T)
        backward[at[: live[t]] + t] = r[: live[t]]
    inner = np.ones(len(local), bool)
    inner[first[:-1][size > 0]] = False
    b = np.flatnonzero(inner)
    right = local[b] * backward[b]
    right /= ((forward[b - 1] @ step) * right).sum(axis=1, keepdims=True)
    return norm(forward * backward), step * (forward[b - 1].T @ right)


def train(texts: list[str], langs: list[str], seed: int = 5) -> Model:
    """Fits a model to labelled texts; ``langs`` are the learned values, by code point."""
    labels = sorted(set(langs))
    k = len(labels)
    data, off = W.buffers(pa.array(texts, pa.large_string()))
    starts, ends, first = W.word_bounds(data, off)
    h = W.range_hashes(data)(starts, ends)
    truth = np.array([labels.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    docs = np.flatnonzero(np.diff(first) > 0)
    by_lang = [docs[truth[docs] == j] for j in range(k)]
    by_lang = [d for d in by_lang if len(d)]
    model = Model(labels, np.zeros((1 << TABLE_BITS, k), np.float32), np.zeros(k), np.zeros((k, k)))
    if not by_lang or k < 2:
        return model
    used = len(first) and int(first[-1])
    many = int(min(MAX_SEQUENCES, max(200, used // SEQUENCE)))
    pieces, gold = [], []
    for _ in range(many):
        left = SEQUENCE
        while left > 0:
            d = rng.choice(by_lang[rng.integers(len(by_lang))])
            n = min(left, int(rng.geometric(1 / STRETCH)) if rng.random() < 0.5 else SEQUENCE, int(first[d + 1] - first[d]))
            a = rng.integers(first[d], first[d + 1] - n + 1)
            pieces.append(np.arange(a, a + n))
            gold.append(np.full(n, truth[d]))
            left -= n
    at, y = np.concatenate(pieces), np.concatenate(gold)
    _, pick, w = np.unique(h[at], return_index=True, return_inverse=True)
    pick = at[pick]
    word, feat = features(data, starts[pick], ends[pick])
    bounds = np.arange(0, len(at) + 1, SEQUENCE)
    inner = np.arange(len(at)) % SEQUENCE > 0
    b = np.flatnonzero(inner)
    seen = np.zeros((k, k))
    np.add.at(seen, (y[b - 1], y[b]), 1.0)
    y_word = np.stack([np.bincount(w, y == j, len(pick)) for j in range(k)], axis=1)
    weight = np.zeros((1 << TABLE_BITS, k))
    parts = [weight, model.start, model.move]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    begin = np.bincount(y[::SEQUENCE], minlength=k).astype(float)
    for r in range(1, ROUNDS + 1):
        rows = weight[feat]
        score = np.stack([np.bincount(word, rows[:, j], len(pick)) for j in range(k)], axis=1)
        post, pair = posteriors(score[w], bounds, model.start, model.move)
        error = (y_word - np.stack([np.bincount(w, post[:, j], len(pick)) for j in range(k)], axis=1))[word]
        grads = [np.stack([np.bincount(feat, error[:, j], len(weight)) for j in range(k)], axis=1) / many - RIDGE * weight, (begin - post[::SEQUENCE].sum(axis=0)) / many, (seen - pair) / many]
        for p, g, a, q in zip(parts, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            q += 0.01 * (g * g - q)
            p += RATE * (a / (1 - 0.9**r)) / (np.sqrt(q / (1 - 0.99**r)) + 1e-8)
    model.weight = weight.astype(np.float32)
    return model


def _label(model: Model, arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, posteriors, first word of each row, whether a word has a letter, rows without an ASCII letter) of each chunk."""
    for a, b, data, off in W.chunks(arr, CHUNK_BYTES):
        starts, ends, first = W.word_bounds(data, off)
        unsure = np.flatnonzero(np.diff(np.searchsorted(np.flatnonzero(_LETTER[data] & (data < 128)), off)) == 0)
        if not len(starts):
            yield a, b, np.zeros((0, len(model.labels))), first, np.zeros(0, bool), unsure
            continue
        h = W.range_hashes(data)(starts, ends)
        _, pick, which = np.unique(h, return_index=True, return_inverse=True)
        letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int32)])
        wordy = letters[ends] > letters[starts]
        score = model.scores(data, starts[pick], ends[pick])[which]
        score[~wordy] = 0.0  # figures and signs take the language of their neighbours
        post, _ = posteriors(score, first, model.start, model.move)
        yield a, b, post, first, wordy, unsure


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b, post, first, wordy, unsure in _label(model, texts):
                row = np.repeat(np.arange(b - a), np.diff(first))[wordy]
                sums = np.stack([np.bincount(row, post[wordy, j], b - a) for j in range(len(model.labels))], axis=1)
                total = sums.sum(axis=1)
                best = sums.argmax(axis=1)
                lang, score = [model.labels[j] for j in best], sums.max(axis=1) / np.maximum(total, 1e-300)
                for i in unsure:  # bytes above 0x7F may all be signs
                    if not any(c.isalpha() for c in texts[a + int(i)].as_py() or ""):
                        lang[i], score[i] = UNDETERMINED, 0.0
                same = [batch.column(c).slice(a, b - a) for c in range(batch.num_columns) if c != 1]
                yield pa.RecordBatch.from_arrays([*same, pa.array(lang, pa.string()), pa.array(np.clip(score, 0.0, 1.0))], names=[n for i, n in enumerate(batch.schema.names) if i != 1] + ["lang_pred", "score"])

    return run


def _tag(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, post, first, _, _ in _label(model, batch.column(1)):
                names = pa.array(model.labels, pa.string()).take(pa.array(post.argmax(axis=1) if len(post) else [], pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(first, pa.int32()), names)], names=["key", "langs"])

    return run


def fit(df: DataFrame, where: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Model:
    """A model from rows that meet ``where`` and have a language.

    The sample: per language about ``max_docs`` rows of at most ``max_chars`` characters, those with the
    smallest key hashes.  Only these texts reach the driver.  Rows without a language or text teach nothing, nor do
    those for which ``where`` is null; an empty text holds no word; rows that repeat a key are drawn together.  Without
    a row the model knows no language.
    """
    rows = df.filter(where & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) <= max_chars))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)).alias("u"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros(0), np.zeros((0, 0)))
    share = F.lit(1.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 1.3 * max_docs / n))).otherwise(share)
    got = sorted(rows.filter(F.col("u") < share).collect(), key=lambda r: (r["lang"], r["u"], r["text"]))
    taken, kept = dict.fromkeys(counts, 0), []
    for r in got:
        if taken[r["lang"]] < max_docs:
            taken[r["lang"]] += 1
            kept.append(r)
    return train([r["text"] for r in kept], [r["lang"] for r in kept])


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(key, kept columns, lang_pred, score): the language with the largest summed word posterior, and its share.

    ``und`` with score 0 for a text that is null or has no letter, or if no language was learned.  Ties go to
    the first language by code point.  Repeated rows stay; an empty table gives an empty result.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *[F.col(c) for c in keep or []])
    if not model.labels:
        return rows.drop("text").withColumnsRenamed({"key": key}).withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "text")
    return rows.mapInArrow(_predict(model), f"{kinds}, lang_pred string, score double").withColumnRenamed("key", key)


def tag_words(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, langs): the most probable language of every word in turn.

    Figures and signs take the language of their neighbours, ties go to the first language by code point.  A null
    text and one without words have no entries; repeated rows stay; an empty table gives an empty result.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_tag(model), f"key {dict(rows.dtypes)['key']}, langs array<string>").withColumnRenamed("key", key)
