"""Operator 6: language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of two or three orders,

    P1(w)        = (c(w) + 0.1) / (N + 0.1 * (V + 1))
    P2(w | h)    = m2(h) * c(h w) / c(h) + (1 - m2(h)) * P1(w)
    P3(w | g h)  = m3(g h) * c(g h w) / c(g h) + (1 - m3(g h)) * P2(w | h),

where a weight m depends on the frequency bucket (a power of two) of its context.  The weights
are learned on counts held out from the training documents: one fold is left out of the counts,
and expectation-maximisation over what it holds finds each bucket's weight, those of the second
order first.  Final counts then cover all training documents.

Counts never meet in one place.  Documents are packed into blocks by a hash of key and text; each block
sends its distinct words, pairs and triples, once each with their counts, to the buckets of a hash
range; a bucket adds up the counts of its range and answers every block.  A frequent word or pair
is one entry of a block, so hot keys weigh no more than others.  With the answers a block scores its
texts alone.  Only N, V and the held-out histograms (bounded by frequency buckets times ratio bins)
reach the driver.  Hashes have as many bits as keep a clash with any other key below one in two million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import wordhash as W
from .storage import table

#: Characters of text in a block, the unit that is counted and scored together.
BLOCK_CHARS = 5_000_000
ADD = 0.1
#: Bins of the held-out histogram: eighths of an octave of the ratio of the two estimates.
BINS_PER_OCTAVE, MOST_OCTAVES, ROUNDS = 8, 60, 60
_END = W.U(0x1F83D9ABFB41BD6B)
_FIRST, _SECOND, _THIRD = W.U(0x9FB21C651E98DF25), W.U(0xD6E8FEB86659FD93), W.U(0xA24BAED4963EE407)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's rows of a block as one compressed Arrow stream."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        for b in np.unique(block):
            part = batch.filter(pa.array(block == b)).drop_columns(["block"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "packed"])


def _unpack(group: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in group.column("packed")])


def _tokens(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text's words and one end, and each text's first token (with an end)."""
    parts, counts = [], []
    for arr in text.chunks:
        for _, _, data, off in W.chunks(arr):
            h, first = W.words(data, off)
            parts.append(np.insert(h, first[1:], _END))
            counts.append(np.diff(first) + 1)
    if not parts:
        return np.zeros(0, W.U), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def key_bits(chars: int) -> int:
    """Bits of a key for a corpus of so many characters, of which at most half are tokens."""
    return min(64, chars.bit_length() + 21)


def _keys(tok: np.ndarray, first: np.ndarray, bits: int, orders: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of every token's word and the pair it ends, of the triple it ends unless it is a text's first; and which tokens those are.

    The last two bits of a key tell its order.  A text's first word follows an end.
    """
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[first[:-1]] = _END
    later = np.ones(len(tok), bool)
    later[first[:-1]] = False
    hashes = [tok, W.mix(before * _FIRST + tok * _SECOND)]
    if orders > 2:
        at = np.flatnonzero(later)
        hashes.append(W.mix(before[at - 1] * _THIRD + before[at] * _FIRST + tok[at] * _SECOND))
    return [(h >> W.U(64 - bits)) & ~W.U(3) | W.U(k) for k, h in enumerate(hashes)], later


def _squeeze(keys: np.ndarray) -> tuple[int, bytes]:
    """Sorted keys as differences, byte plane by byte plane: the upper planes are mostly zeros."""
    gap = np.diff(keys, prepend=W.U(0))
    width = max(1, (int(gap.max()).bit_length() + 7) // 8) if len(gap) else 1
    return width, pa.compress(np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8)[:, :width].T), codec="zstd", asbytes=True)


def _stretch(n: int, width: int, raw: bytes) -> np.ndarray:
    gap = np.zeros((n, 8), np.uint8)
    gap[:, :width] = np.frombuffer(pa.decompress(raw, n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return np.cumsum(gap.view(W.U).ravel(), dtype=W.U)


def _zip(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x, np.uint32), codec="zstd", asbytes=True)


def _unzip(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * 4, codec="zstd"), np.uint32) if n else np.zeros(0, np.uint32)


_REQUEST = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _buckets_of(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """The bucket of each key, in the order of the keys; the same wherever it is asked."""
    return np.minimum((keys.astype(np.float64) * (buckets / 2.0**bits)).astype(np.int64), buckets - 1)


def _request(buckets: int, bits: int, orders: int):
    def run(group: pa.Table) -> pa.Table:
        rows = _unpack(group)
        tok, first = _tokens(rows.column("text"))
        parts, later = _keys(tok, first, bits, orders)
        counted = np.repeat(rows.column("train").to_numpy(), np.diff(first)).astype(np.float64)
        counted = np.concatenate([counted, counted, counted[later]][:orders])
        keys, which = np.unique(np.concatenate(parts), return_inverse=True)
        del parts
        counts = np.bincount(which, counted, len(keys)).astype(np.uint32)
        bucket = _buckets_of(keys, buckets, bits)
        at = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(keys))
        block, out = group.column("block")[0].as_py(), []
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):  # buckets that hold a key of the block
            out.append((int(bucket[x]), block, y - x, *_squeeze(keys[x:y]), _zip(counts[x:y])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _REQUEST, strict=True)], schema=_REQUEST)

    return run


_ANSWER = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("every", pa.binary()), ("main", pa.binary()), ("totals", pa.list_(pa.int64()))])


def _serve(held_from: int):
    """Adds up a bucket's counts and answers each block; ``main`` leaves out the held-out blocks' own counts."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = [_stretch(r["n"], r["width"], r["keys"]) for r in rows]
        known, which = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([_unzip(r["counts"], r["n"]) for r in rows]).astype(np.float64)
        held = np.repeat([r["block"] >= held_from for r in rows], [r["n"] for r in rows])
        every = np.bincount(which, n, len(known)).astype(np.uint32)
        main = np.bincount(which, n * ~held, len(known)).astype(np.uint32)
        words = known & W.U(3) == 0
        totals = [int(every[words].sum(dtype=np.int64)), int((every[words] > 0).sum()), int(main[words].sum(dtype=np.int64)), int((main[words] > 0).sum())]
        out, a = [(-1, rows[0]["bucket"], 0, b"", b"", totals)], 0
        for r in rows:
            w = which[a : a + r["n"]]
            a += r["n"]
            out.append((r["block"], r["bucket"], r["n"], _zip(every[w]), _zip(main[w]) if r["block"] >= held_from else b"", None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ANSWER, strict=True)], schema=_ANSWER)

    return run


def _counts(texts: pa.Table, answers: pa.Table, which: str, bits: int, orders: int):
    """Per token: c(w), and of each higher order the context's count and that of context and word; and each text's first token (with an end)."""
    tok, first = _tokens(texts.column("text"))
    parts, later = _keys(tok, first, bits, orders)
    _, at = np.unique(np.concatenate(parts), return_inverse=True)
    del parts
    got = np.concatenate([_unzip(r[which], r["n"]) for r in answers.sort_by("bucket").to_pylist()])
    c = got[at].astype(np.float64)
    n = len(tok)
    cw, pair = c[:n], c[n : 2 * n]
    ch = np.empty_like(cw)
    ch[1:] = cw[:-1]
    ch[first[:-1]] = cw[first[1:] - 1]  # every text ends with the end
    higher = [(ch, pair)]
    if orders > 2:
        context, triple = np.zeros(n), np.zeros(n)
        context[later], triple[later] = pair[np.flatnonzero(later) - 1], c[2 * n :]
        higher.append((context, triple))
    return cw, higher, first


def frequency_bucket(c: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the power of two below the count."""
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0).astype(np.int64)


_NEVER = -BINS_PER_OCTAVE * (MOST_OCTAVES + 1)


def _mixed(low: np.ndarray, higher: list[tuple[np.ndarray, np.ndarray]], weights: list[np.ndarray]) -> np.ndarray:
    """The estimate of the orders that have weights, on top of the lowest."""
    for (context, both), weight in zip(higher, weights, strict=False):
        m = weight[frequency_bucket(context)]
        low = m * both / np.maximum(context, 1) + (1 - m) * low
    return low


def _histogram(n: int, v: int, weights: list[np.ndarray], bits: int, orders: int):
    """Held-out tokens by frequency bucket of the next order's context and ratio of its estimate to that of the orders below."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("f", pa.int64()), ("r", pa.int64()), ("n", pa.int64())])
        if not texts.num_rows or not answers.num_rows:
            return schema.empty_table()
        cw, higher, _ = _counts(_unpack(texts), answers, "main", bits, orders)
        low = _mixed((cw + ADD) / (n + ADD * (v + 1)), higher, weights)
        context, both = higher[len(weights)]
        ratio = np.where(both > 0, np.log2(np.maximum(both, 1) / np.maximum(context, 1) / low), 0)
        bin_ = np.where(both > 0, np.clip(np.rint(ratio * BINS_PER_OCTAVE), _NEVER + 1, -_NEVER), _NEVER).astype(np.int64)
        cell, count = np.unique(frequency_bucket(context) * (1 << 20) + (bin_ - _NEVER), return_counts=True)
        return pa.Table.from_arrays([pa.array(cell >> 20), pa.array((cell & ((1 << 20) - 1)) + _NEVER), pa.array(count)], schema=schema)

    return run


def mixture_weights(histogram: list[tuple[int, int, int]]) -> np.ndarray:
    """Each frequency bucket's weight by expectation-maximisation on (bucket, ratio bin, tokens).

    Bucket 0 has no higher-order estimate and weight 0; buckets without held-out tokens take the weight of the
    bucket below.
    """
    most = 64
    out = np.zeros(most)
    last = 0.5
    for f in range(1, most):
        got = [(r, n) for g, r, n in histogram if g == f]
        if got:
            ratio = np.array([0.0 if r == _NEVER else 2.0 ** (r / BINS_PER_OCTAVE) for r, _ in got])
            n = np.array([n for _, n in got], float)
            m = 0.5
            for _ in range(ROUNDS):
                m = float((n * m * ratio / (m * ratio + 1 - m)).sum() / n.sum())
                m = min(max(m, 1e-6), 1 - 1e-6)
            last = m
        out[f] = last
    return out


_SCORE = "key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(n: int, v: int, weights: list[np.ndarray], bits: int, orders: int, schema: pa.Schema):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        rows = _unpack(texts)
        cw, higher, first = _counts(rows, answers, "every", bits, orders)
        low = (cw + ADD) / (n + ADD * (v + 1))
        sums = lambda x: np.add.reduceat(x, first[:-1])
        return pa.Table.from_arrays([rows.column("key"), rows.column("held_out"), pa.array(np.diff(first)), pa.array(sums((cw > 0).astype(np.int64))), pa.array(sums(np.log10(low))), pa.array(sums(np.log10(_mixed(low, higher, weights))))], schema=schema)

    return run


def score(df: DataFrame, held_out: Column, em_fold: Column, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, orders: int = 2) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, log10, by a model of two or three orders.

    Rows with ``held_out`` aren't learned from; of the others, those with ``em_fold`` teach the mixture weights.  A
    null text is empty: one token, its end.  Repeated rows count as often as they stand; a null key is
    a key like any other.  Words: runs of bytes other than space and \\t\\n\\v\\f\\r, A-Z lower-cased.  An
    empty table gives an empty result; other columns are ignored.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(em_fold, F.lit(False)).alias("em"))
    rows = rows.withColumn("em", F.col("em") & ~F.col("held_out"))
    size = rows.groupBy("em").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).alias("s")).collect()
    chars = {r["em"]: r["s"] for r in size}
    bits = key_bits(sum(chars.values()))
    blocks = {em: max(1, -(-chars.get(em, 0) // block_chars)) for em in (False, True)}
    spread = F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("null")), "text", F.lit(6))
    block = F.when(F.col("em"), F.pmod(spread, F.lit(blocks[True])) + blocks[False]).otherwise(F.pmod(spread, F.lit(blocks[False]))).cast("int")
    dealt = rows.select("key", "text", "held_out", (~F.col("held_out")).alias("train"), "em", block.alias("block"))
    pack = lambda part: part.drop("em").mapInArrow(_pack, "block int, packed binary")
    packed = pack(dealt)
    buckets = blocks[False] + blocks[True]
    requests = packed.groupBy("block").applyInArrow(_request(buckets, bits, orders), "bucket int, block int, n int, width int, keys binary, counts binary")
    answers = table(requests.groupBy("bucket").applyInArrow(_serve(blocks[False]), "block int, bucket int, n int, every binary, main binary, totals array<long>"))
    t = answers.filter("block = -1").agg(*[F.sum(F.col("totals")[i]) for i in range(4)]).first()
    n, v, n_main, v_main = (int(x or 0) for x in t)
    own = answers.filter("block >= 0").select("block", "bucket", "n", "every", "main")
    weights: list[np.ndarray] = []
    while len(weights) < orders - 1:
        told = pack(dealt.filter("em")).groupBy("block").cogroup(own.filter(F.col("block") >= blocks[False]).groupBy("block"))
        cells = told.applyInArrow(_histogram(n_main, v_main, weights, bits, orders), "f long, r long, n long").groupBy("f", "r").agg(F.sum("n").alias("n"))
        weights = [*weights, mixture_weights([tuple(r) for r in cells.collect()] if chars.get(True) else [])]
    kind = dict(rows.dtypes)["key"]
    shape = to_arrow_schema(StructType.fromDDL(_SCORE.format(kind=kind)))
    out = packed.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_score(n, v, weights, bits, orders, shape), _SCORE.format(kind=kind))
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
