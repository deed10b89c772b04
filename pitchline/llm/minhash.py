"""Operator 10: MinHash near-duplicates by a multi-index Hamming join.

A document's set of five-word shingles gets a signature of ``POSITIONS`` minimum hashes of
``BITS`` bits.  Signatures that differ in at most ``2 * chunks - 1`` positions agree, by the
pigeonhole, up to one error in one of their chunks.  Every allowed error is
enumerated as a key: the chunk with one position left out, which stands for all values of
that position.  Two signatures under the threshold so share a key with certainty.  One rule
decides everywhere: a pair links if its signatures are within the distance and its full shingle
sets reach the similarity.

The number of chunks follows from the similarity: the fewest for which a pair at that similarity
lies beyond the distance with a probability below ``MISS``.  At 0.85 that is 12 chunks and a
distance of 23 (such a pair differs in 9.6 positions on average), at 0.8 it is 14 and 27.

Equal sets form one class from the start (``cid``, a 64-bit hash of the set), so copies cost one
row.  Which classes of a bucket are compared is ``meetings``' affair.  A meeting first sees signatures
alone and hands on the rows, never the pairs, that have a partner within the distance in another
component; only those rows' full sets are then dealt and compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .components import connected_components, lower_labels, smallest_ids
from .meetings import linked, sides, within
from .storage import apart, inner, table

POSITIONS, BITS, MISS = 64, 16, 2e-5
#: Rows and shingles of a part, on average; a comparison holds two parts.
PART, SHINGLES = 2048, 1_000_000
#: Rows of a part that small groups share.
PACK = 512
#: Shingles held by at most so many sets of a comparison are counted pair by pair, others by matrix products.
SMALL = 32
_rng = np.random.default_rng(1010)
_PERM = _rng.integers(0, 2**63, POSITIONS, dtype=W.U) * W.U(2) + W.U(1)
_ROLE = _rng.integers(0, 2**63, POSITIONS, dtype=W.U) * W.U(2) + W.U(1)
_SALT = _rng.integers(0, 2**63, POSITIONS, dtype=W.U)


def chunks_for(percent: int) -> int:
    """The fewest chunks whose distance of 2 * chunks - 1 a pair at the similarity exceeds with a probability below MISS."""
    p = 1 - percent / 100
    tail = [sum(comb(POSITIONS, k) * p**k * (1 - p) ** (POSITIONS - k) for k in range(d + 1, POSITIONS + 1)) for d in range(POSITIONS + 1)]
    return next(c for c in range(1, POSITIONS // 2 + 1) if 2 * c > POSITIONS or tail[2 * c - 1] < MISS)


def signatures(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of POSITIONS minimum hashes (low BITS bits) for each non-empty set."""
    out = np.empty((len(off) - 1, POSITIONS), np.uint16)
    for j, a in enumerate(_PERM):
        out[:, j] = W.mix(np.minimum.reduceat(sets * a, off[:-1])).astype(np.uint16)
    return out


def keys(sig: np.ndarray, chunks: int) -> np.ndarray:
    """For each signature its 64-bit keys: every chunk with each of its positions left out in turn."""
    part = sig.astype(W.U) * _ROLE
    out = np.empty(sig.shape, W.U)
    bounds = np.linspace(0, POSITIONS, chunks + 1).round().astype(int)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        whole = part[:, a:b].sum(axis=1, dtype=W.U)
        out[:, a:b] = W.mix(whole[:, None] - part[:, a:b] + _SALT[a:b])
    return out


def _sketch(words: int):
    """(id, row, text) -> (id, row, n, h1, h2, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, first in W.chunks(batch.column(2)):
                s, off = W.shingles(*W.words(data, first), words)
                n = np.diff(off)
                rows = np.flatnonzero(n)
                hashes = np.zeros((2, b - a), W.U)
                sig: list[bytes | None] = [None] * (b - a)
                if len(rows):
                    at = np.append(off[:-1][rows], off[-1])
                    hashes[0, rows] = W.mix(np.add.reduceat(s, at[:-1]))
                    hashes[1, rows] = W.mix(np.bitwise_xor.reduceat(W.mix(s + W.U(77)), at[:-1]))
                    for row, x in zip(rows, signatures(s, at), strict=True):
                        sig[row] = x.tobytes()
                kept = [batch.column(c).slice(a, b - a) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), *(pa.array(h.view(np.int64)) for h in hashes), pa.array(sig, pa.binary())], names=["id", "row", "n", "h1", "h2", "sig"])

    return run


def _signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, POSITIONS)


def _keys(chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k = keys(_signatures(batch.column("sig")), chunks).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, POSITIONS), pa.int32()), pa.array(k.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("cid"), lists], names=["cid", "keys"])

    return run


def _sets(words: int):
    """(cid, sig, text) -> (cid, n, sig, full)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, first in W.chunks(batch.column(2)):
                s, off = W.shingles(*W.words(data, first), words)
                full = [s[x:y].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)]
                kept = [batch.column(c).slice(a, b - a) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([kept[0], pa.array(np.diff(off), pa.int64()), kept[1], pa.array(full, pa.binary())], names=["cid", "n", "sig", "full"])

    return run


def _near(group: pa.Table, left: np.ndarray, right: np.ndarray, distance: int) -> np.ndarray:
    """Pairs within the distance whose components differ."""
    sig, comp = _signatures(group.column("sig")), group.column("comp").to_numpy()
    return within(sig[left], sig[right], distance) & (comp[left][:, None] != comp[right])


def _scout(distance: int):
    """Rows of a meeting that have a partner within the distance in another component."""

    def run(group: pa.Table) -> pa.Table:
        left, right = sides(group)
        near = _near(group, left, right, distance)
        hit = np.zeros(group.num_rows, bool)
        hit[left] |= near.any(axis=1)
        hit[right] |= near.any(axis=0)
        return group.select(["m", "cid", "comp", "side"]).filter(pa.array(hit))

    return run


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``left`` with the sets ``right`` (distinct elements each)."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = np.zeros((len(left), len(right)), np.float32)
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    column = np.cumsum(count > SMALL) - 1
    common = count[code] > SMALL
    r, c = row[common], column[code[common]]
    order = np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    for at in range(0, int(c[-1]) + 1 if len(c) else 0, 1024):
        a, b = np.searchsorted(c, [at, at + 1024])
        held = np.zeros((len(sets), 1024), np.float32)
        held[r[a:b], c[a:b] - at] = 1
        both += held[left] @ held[right].T
    rare = (count[code] > 1) & ~common
    r, c = row[rare], code[rare]
    order = np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    for step in range(1, SMALL):
        same = np.flatnonzero(c[step:] == c[:-step]) if step < len(c) else []
        if not len(same):
            break
        for p, q in ((r[same], r[same + step]), (r[same + step], r[same])):
            ok = (place[0, p] >= 0) & (place[1, q] >= 0)
            np.add.at(both, (place[0, p[ok]], place[1, q[ok]]), 1)
    return both


def _forest(percent: int, distance: int):
    """(cid, root): each linked row with the smallest class that the links of its comparison join it to."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("cid", "ascending")])
        left, right = sides(group)
        label = np.arange(group.num_rows)
        near = _near(group, left, right, distance)
        if near.any():
            sets = [np.frombuffer(x.as_buffer(), W.U) for x in group.column("full")]
            size = np.array([len(x) for x in sets])
            both = overlaps(sets, left, right).astype(np.int64)
            p, q = np.nonzero(near & (100 * both >= percent * (size[left][:, None] + size[right] - both)))
            lower_labels(label, left[p], right[q])
        cid = group.column("cid")
        return pa.table({"cid": cid, "root": cid.take(pa.array(label))}).filter(pa.array(label != np.arange(len(label))))

    return run


def _components(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, row, n, cid) of ``docs`` (id, row, text), and (cid, smallest id, component) of all classes; ``row`` is a hash of the row."""
    rows = table(docs.select("id", "row", "text").mapInArrow(_sketch(words), "id long, row long, n long, h1 long, h2 long, sig binary").withColumn("cid", F.xxhash64("h1", "h2", "n")))
    classes = table(rows.filter("n > 0").groupBy("cid").agg(F.min("id").alias("id"), F.min("row").alias("row"), F.min("sig").alias("sig")))
    bucket = classes.select("cid", "sig").mapInArrow(_keys(chunks_for(percent)), "cid long, keys array<long>").select("cid", F.explode("keys").alias("key"))
    shared = bucket.groupBy("key").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).filter("low < high").drop("high")
    members = table(bucket.withColumn("k", apart("key")).join(shared.select(apart("key").alias("k"), "low"), "k").select("key", "cid", "low"))
    wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi")
    texts = docs.select("row", "text").join(wanted, "row").dropDuplicates(["row"])
    sets = table(texts.select("cid", "sig", "text").mapInArrow(_sets(words), "cid long, n long, sig binary, full binary"))
    distance = 2 * chunks_for(percent) - 1
    links = linked(members, sets, ["sig", "full"], _forest(percent, distance), _scout(distance), ["sig"], PART, SHINGLES, PACK)
    found = connected_components(links.unionAll(_same_key(rows)), "cid", "root")
    found = classes.select("cid", "id").join(found.select(F.col("node").alias("cid"), "component"), "cid", "left")
    return rows.drop("h1", "h2", "sig"), found.select("cid", "id", F.coalesce("component", "cid").alias("component"))


def _same_key(rows: DataFrame) -> DataFrame:
    """Links between the classes of rows that repeat a key with different texts."""
    several = rows.filter("n > 0 and id is not null").groupBy("id").agg(F.min("cid").alias("root"), F.max("cid").alias("high")).filter("root < high").select("id", "root")
    return rows.filter("n > 0").select("id", "cid").join(several, "id").filter("cid <> root").select("cid", "root").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row; other columns are ignored.

    Links are pairs of documents whose sets of ``words``-word shingles reach ``percent`` % Jaccard
    similarity; component_id is the smallest key reachable over links, itself included, and kept
    marks the document that bears it.  A null, empty or blank text has the empty set, links with
    nothing and is kept.  Rows that repeat a key count as one document.  A row without a key
    links like any other; it gets its component's smallest key and is kept only if there is none
    (component_id is then null).  An empty table gives an empty result.  Sets are told apart by
    64-bit hashes.
    """
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows, found = _components(docs.withColumn("row", F.xxhash64("id", "text")), words, percent)
    out = rows.join(smallest_ids(found), "cid", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` without near-duplicates: one row of each component stays, the one with the smallest key.

    Of rows that repeat that key, and of rows without a key in a component that has none, the one
    with the smallest hash of all its columns stays, so reruns agree; of equal rows one stays.  Rows
    without shingles (null, empty or blank text) all stay.  An empty table gives an empty result.
    """
    id_, row, body = inner(df, "id", "row", "body")
    hashed = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind not in ("variant", "void")]
    named = df.withColumns({id_: F.col(f"`{key}`").cast("long"), row: F.xxhash64(*hashed), body: F.col(f"`{text}`").cast("string")})
    rows, found = _components(named.select(F.col(id_).alias("id"), F.col(row).alias("row"), F.col(body).alias("text")), words, percent)
    first = F.struct(F.col("id").isNull().alias("no"), "id", "row")
    best = rows.filter("n > 0").groupBy("cid").agg(F.min(first).alias("best"))
    best = best.join(found, "cid").groupBy("component").agg(F.min("best").alias("best"))
    blank = ~F.coalesce(F.col(body), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = named.filter(~blank).join(best.select(F.col("best.row").alias(row)), row, "left_semi").dropDuplicates([row])
    return kept.unionByName(named.filter(blank)).select(*[f"`{c}`" for c in df.columns])
