"""Operator 3: sampled SentencePiece segmentations and lossless decoding.

Sampling is forward filtering, backward sampling over the lattice of vocabulary pieces: the
forward pass sums the weights of all segmentations up to every character, the backward pass
draws, from the end, each next piece in proportion to what passes through it.  The draws come
from a counter-based generator keyed by the row's key, so a row has the same segmentation on
every run, whatever the partitioning.

The vocabulary file ranks its pieces by merge order and bears no probabilities; a piece of rank r
gets the weight (r + RANK_SHIFT) ** -alpha of a Zipf law.  Characters outside the vocabulary are
one edge that stands for their UTF-8 bytes.  Spaces become the meta symbol and each text gets one
in front, as the library does; a meta symbol in the text itself is spelt in bytes, so decoding is
lossless for every text.

No piece holds a meta symbol after another character, and none holds a line feed, so the
lattice falls apart at those places.  Equal units share one lattice within a chunk of texts, and
all lattices of a chunk are built, filtered and sampled together in array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META, SPACE, NEWLINE = 0x2581, 0x20, 0x0A
ALPHA, RANK_SHIFT, SEED = 1.0, 10.0, 17
#: Characters of whole texts that are worked on together; a longer text makes a chunk of its own.
CHUNK_CHARS = 1_500_000
_rng = np.random.default_rng(333)
_STEP = int(_rng.integers(0, 2**62)) * 2 + 1
_UNSTEP = pow(_STEP, -1, 2**64)


class Vocabulary:
    """Pieces by hash, byte pieces, and every id's bytes for decoding."""

    def __init__(self, model: str, alpha: float) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.longest, spelt, rows = 1, [], []
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                spelt.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                spelt.append(b"")
            else:
                spelt.append(piece.replace("▁", " ").encode())
                body = piece.lstrip("▁")
                if "▁" in body or "\n" in piece:
                    raise ValueError(f"piece {i} crosses a unit border")
                rows.append((np.array([ord(c) for c in piece.replace("▁", " ")], W.U), i, -float(sp.get_score(i))))
                self.longest = max(self.longest, len(piece))
        power = np.ones(self.longest + 1, W.U)
        power[:] = [W.U(pow(_STEP, k, 2**64)) for k in range(len(power))]
        hashes = np.array([int((W.mix(c + W.U(1)) * power[: len(c)]).sum(dtype=W.U)) for c, _, _ in rows], W.U)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array([r[1] for r in rows], np.int32)[order]
        self.weights = (-alpha * np.log(np.minimum([r[2] for r in rows], n) + RANK_SHIFT))[order]
        self.unknown = -alpha * float(np.log(n + RANK_SHIFT))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> W.U(44)).astype(np.int64)] = True
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_at = np.concatenate([[0], np.cumsum([len(x) for x in spelt])])


@cache
def vocabulary(model: str, alpha: float) -> Vocabulary:
    return Vocabulary(model, alpha)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenation of start[i] .. start[i] + size[i] - 1."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Lattice:
    """Lattices of distinct units (concatenated codes; ``at``: bounds), filtered forward."""

    def __init__(self, v: Vocabulary, codes: np.ndarray, at: np.ndarray) -> None:
        size = np.diff(at)
        n = len(codes)
        node0 = at[:-1] + np.arange(len(size))  # a unit of L characters has L + 1 nodes
        unit = np.repeat(np.arange(len(size)), size)
        rel = np.arange(n) - at[unit]  # place within the unit
        power, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, W.U)
        np.cumsum(W.mix(codes.astype(W.U) + W.U(1)) * power[:n], out=sums[1:])
        valid = np.zeros((n, v.longest), bool)  # [last character, length - 1]
        for k in range(1, v.longest + 1):
            if k > n:
                break
            h = (sums[k:] - sums[:-k]) * inverse[: n + 1 - k]
            valid[k - 1 :, k - 1] = v.maybe[(h >> W.U(44)).view(np.int64)]
        last, k = np.nonzero(valid)
        k += 1
        inside = rel[last] >= k - 1
        last, k = last[inside], k[inside]
        h = (sums[last + 1] - sums[last + 1 - k]) * inverse[last + 1 - k]
        found = np.minimum(np.searchsorted(v.hashes, h), len(v.hashes) - 1)
        true = v.hashes[found] == h
        last, k, found = last[true], k[true], found[true]
        known = np.zeros(n, bool)
        known[last[k == 1]] = True
        other = np.flatnonzero(~known)  # these characters are spelt in bytes
        where = np.searchsorted(last, other)
        last = np.insert(last, where, other)
        k = np.insert(k, where, 1)
        self.piece = np.insert(v.ids[found], where, -1)
        weight = np.insert(v.weights[found], where, np.array([v.unknown * len(chr(c).encode("utf-8", "surrogatepass")) for c in codes[other]]) if len(other) else [])
        end = node0[unit[last]] + rel[last] + 1
        self.start = end - k
        self.char = last
        forward = np.full(n + len(size), -np.inf)
        forward[node0] = 0.0
        step = rel[last] * v.longest + (k - 1)  # by end and length: within one step every node is met once
        step = step.astype(np.uint16) if len(step) == 0 or step.max() < 65536 else step
        order = np.argsort(step, kind="stable")
        border = np.flatnonzero(np.diff(step[order].astype(np.int64))) + 1
        s, e, w = self.start[order], end[order], weight[order]
        for a, b in zip(np.concatenate([[0], border]), np.concatenate([border, [len(order)]]), strict=True):
            forward[e[a:b]] = np.logaddexp(forward[e[a:b]], forward[s[a:b]] + w[a:b])
        share = np.exp(forward[self.start] + weight - forward[end])
        self.upto = np.cumsum(share)
        many = np.bincount(end, minlength=len(forward))
        self.first = np.concatenate([[0], np.cumsum(many)])
        self.node0, self.size = node0, size


_power_cache = [np.ones(1, W.U), np.ones(1, W.U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power_cache[0]) < n:
        for k, base in enumerate((_STEP, _UNSTEP)):
            p = np.ones(n + n // 4, W.U)
            done = 1
            while done < len(p):
                m = min(done, len(p) - done)
                p[done : done + m] = p[:m] * W.U(pow(base, done, 2**64))
                done += m
            _power_cache[k] = p
    return _power_cache[0][:n], _power_cache[1][:n]


def encode_texts(v: Vocabulary, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after the other, and their bounds."""
    size = np.array([len(t) + 1 if t else 0 for t in texts])
    off = np.concatenate([[0], np.cumsum(size)])
    n = int(off[-1])
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    codes = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32)
    space = codes == SPACE
    start = np.zeros(n, bool)
    start[1:] = space[1:] & ~space[:-1]
    line = codes == NEWLINE
    start |= line
    start[1:] |= line[:-1]
    start[off[:-1][size > 0]] = True
    at = np.flatnonzero(start)
    length = np.diff(np.append(at, n))
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, W.U)
    np.cumsum(W.mix(codes.astype(W.U) + W.U(1)) * power[:n], out=sums[1:])
    h = W.mix((sums[at + length] - sums[at]) * inverse[at] + length.astype(W.U) * W.U(0x9E3779B97F4A7C15))
    _, pick, which = np.unique(h, return_index=True, return_inverse=True)
    by_size = np.argsort(length[pick], kind="stable")
    back = np.empty(len(pick), np.int64)
    back[by_size] = np.arange(len(pick))
    pick, which = pick[by_size], back[which]
    bounds = np.concatenate([[0], np.cumsum(length[pick])])
    own = codes[_ranges(at[pick], length[pick])]
    lattice = _Lattice(v, own, bounds)
    doc = np.searchsorted(off, at, "right") - 1
    place = np.arange(len(at)) - np.searchsorted(at, off)[doc]
    rng = W.mix(seeds[doc] + place.astype(W.U) * W.U(0xD1342543DE82EF95))
    node, goal = lattice.node0[which] + lattice.size[which], lattice.node0[which]
    live = np.argsort(which.astype(np.int32), kind="stable")  # equal units together: their edges stay in cache
    steps, emitted = [], np.zeros(len(at), np.int64)
    wide = np.ones(len(own), np.int64)
    wide += (own > 0x7F).astype(np.int64) + (own > 0x7FF) + (own > 0xFFFF)
    k = 0
    while len(live):
        u = (W.mix(rng[live] + W.U(k * 0xA0761D6478BD642F % 2**64)) >> W.U(11)).astype(np.float64) * 2.0**-53
        first, end = lattice.first[node[live]], lattice.first[node[live] + 1]
        base = np.where(first > 0, lattice.upto[first - 1], 0.0)
        edge = np.clip(np.searchsorted(lattice.upto, base + u * (lattice.upto[end - 1] - base), "right"), first, end - 1)
        emitted[live] += np.where(lattice.piece[edge] < 0, wide[lattice.char[edge]], 1)
        steps.append((live, edge, emitted[live]))
        node[live] = lattice.start[edge]
        live = live[node[live] != goal[live]]
        k += 1
    ends = np.cumsum(emitted)
    out = np.zeros(int(ends[-1]), np.int32)
    for live, edge, upto in steps:
        place, piece = ends[live] - upto, lattice.piece[edge]
        known = piece >= 0
        out[place[known]] = piece[known]
        for c in np.unique(own[lattice.char[edge[~known]]]):
            spelt = chr(c).encode("utf-8", "surrogatepass")
            here = place[~known][own[lattice.char[edge[~known]]] == c]
            for b, x in enumerate(spelt):
                out[here + b] = v.byte_id[x]
    return out, np.concatenate([[0], ends])[np.searchsorted(at, off)]


def decode_ids(v: Vocabulary, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, one after the other, and their bounds; the space in front is dropped."""
    size = (v.spelt_at[ids + 1] - v.spelt_at[ids]).astype(np.int64)
    data = v.spelt[_ranges(v.spelt_at[ids].astype(np.int64), size)] if len(ids) else np.zeros(0, np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])[off]
    front = at[:-1][np.diff(at) > 0]
    keep = np.ones(len(data), bool)
    keep[front[data[front] == SPACE]] = False
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def _chunks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    a, upto = 0, np.cumsum(lengths + 1)
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CHUNK_CHARS, "right")))
        yield a, b
        a = b


def _encode(model: str, alpha: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, alpha)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(W.U)
            for a, b in _chunks(np.array([len(t) for t in texts], np.int64)):
                ids, off = encode_texts(v, texts[a:b], W.mix(keys[a:b] + W.U(seed)))
                data, at = decode_ids(v, ids, off)
                raw, bound = W.buffers(pa.array(texts[a:b], pa.large_string()))
                whole = len(data) == len(raw) and (at == bound).all() and (data == raw).all()
                same = [True] * (b - a) if whole else [bytes(data[at[i] : at[i + 1]]) == texts[a + i].encode() for i in range(b - a)]
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(same, pa.bool_())], names=["key", "ids", "lossless"])

    return run


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(key, ids, n_pieces, lossless) of every row: a sampled segmentation of its whole text.

    The draw depends on the key, the seed and the text alone; rows that repeat a key and text repeat
    the segmentation, and a null key is a key like any other.  A null or empty text has no ids.
    A smaller ``alpha`` flattens the choice among segmentations.  ``lossless``: decoding the ids gave the
    text again.  An empty table gives an empty result; other columns are ignored.
    """
    rows = df.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("seed"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["key"]
    out = rows.mapInArrow(_encode(model, alpha, seed), f"key {kind}, ids array<int>, lossless boolean")
    return out.select(F.col("key").alias(key), "ids", F.size("ids").cast("long").alias("n_pieces"), "lossless")


def _decode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, ALPHA)
        for batch in batches:
            lists = batch.column(1)
            size = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            data, at = decode_ids(v, ids, np.concatenate([[0], np.cumsum(size)]))
            texts = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return run


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(key, text): the text that the ids of each row spell; null or empty ids give the empty text."""
    rows = df.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(model), f"key {dict(rows.dtypes)['key']}, text string").withColumnRenamed("key", key)
