"""Operator 9: document fingerprints by randomised edit embedding.

A text is embedded by a random walk shared by all texts: at step j the walk emits the character
under its pointer, and the pointer moves on if the j-th random bit of that character's class is
set.  After an insertion or deletion two walks soon meet again, so texts at a small edit distance
have embeddings at a small Hamming distance.  A walk of 2n steps crosses n characters.

The fingerprint samples ``SLOTS`` places of the embedding, four bits of the character at each.
The places of a slot are the record times of one random sequence: a text of n characters takes the
last of them below 2n.  That is uniform over the walk, and texts of similar lengths mostly share
their places.  Likeness of two fingerprints is the share of slots that agree.

All walks of a chunk of texts run together, one array step for all texts, longest first.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .components import connected_components, lower_labels, smallest_ids
from .meetings import linked, sides, within
from .storage import apart, table

SLOTS, CLASSES = 128, 64
#: Large groups are compared in parts of about PART rows that meet two by two, groups of up to SMALL rows share parts.
SMALL, PART = 512, 2048
#: Share of slots from which the query joins documents.
NEAR = 0.92
#: Characters whose walks run together; a longer text makes a chunk of its own.
CHUNK_CHARS = 12_000_000
_BLOCK = 4096


def _records(limit: int) -> list[tuple[int, int]]:
    """(step, slot) at which a slot takes a new place, by step: next record time = ceil(time / uniform)."""
    out = []
    for slot in range(SLOTS):
        rng, t = np.random.default_rng([909, slot]), 1
        while t <= limit:
            out.append((t - 1, slot))
            t = max(t + 1, int(np.ceil(t / (1.0 - rng.random()))))
    return sorted(out)


_ALL = _records(1 << 34)


def _bits(block: int) -> np.ndarray:
    """Random bits of the steps of one block for every class; the last class, the end of a text, never moves on."""
    words = W.mix(np.arange(block * _BLOCK, (block + 1) * _BLOCK, dtype=W.U) + W.U(0x51ED270B7A2F3C11))
    out = np.zeros((_BLOCK, CLASSES + 1), np.int64)
    out[:, :CLASSES] = (words[:, None] >> np.arange(CLASSES, dtype=W.U)) & W.U(1)
    return out


def walk(texts: list[str]) -> np.ndarray:
    """Fingerprints of the texts, a row of SLOTS four-bit values each; an empty text has zeros."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), SLOTS), np.uint8)
    if not size.sum():
        return out
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = W.mix(codes.astype(W.U) + W.U(0x2545F4914F6CDD1D))
    cls, sym = (h >> W.U(58)).astype(np.uint8), (h & W.U(15)).astype(np.uint8)
    del h
    ends = np.cumsum(size + 1) - 1
    cls[ends], sym[ends] = CLASSES, 0
    order = np.argsort(-size, kind="stable")
    steps = 2 * size[order]
    at = (ends - size)[order]
    got = np.zeros((SLOTS, len(texts)), np.uint8)
    alive = np.searchsorted(-steps, -np.arange(int(steps[0]) + 1), "left")  # texts with more steps than j
    takes, t = _ALL, 0
    bits = None
    for j in range(int(steps[0])):
        m = alive[j]
        p = at[:m]
        while takes[t][0] == j:
            got[takes[t][1], :m] = sym[p]
            t += 1
        if j % _BLOCK == 0:
            bits = _bits(j // _BLOCK)
        p += bits[j % _BLOCK].take(cls.take(p))
    out[order] = got.T
    return out


def likeness(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Share of agreeing slots; an empty text is like empty texts only."""
    return np.where((na > 0) & (nb > 0), (a == b).mean(axis=1), ((na == 0) & (nb == 0)).astype(float))


def _packed(rows: np.ndarray) -> pa.Array:
    """Two slots a byte."""
    flat = (rows[:, ::2] << 4 | rows[:, 1::2]).tobytes()
    n = SLOTS // 2
    return pa.array([flat[i : i + n] for i in range(0, len(flat), n)], pa.binary())


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str, str]]]:
    """Chunks of (id, text, next text): rows come by falling id; a ghost row only lends its text to the row before."""
    held, chunk, chars = None, [], 0
    for batch in batches:
        for key, text, bucket, ghost in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "bucket", "ghost")), strict=True):
            text = text or ""
            if held is not None and held[2] == bucket:
                chunk.append((held[0], held[1], text))
                chars += 2 * len(held[1])
                if chars >= CHUNK_CHARS:
                    yield chunk
                    chunk, chars = [], 0
            held = None if ghost else (key, text, bucket)
    if chunk:
        yield chunk


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _with_next(batches):
        keys, texts, following = (list(x) for x in zip(*rows, strict=True))
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]
        # a row's next is most often the row after it
        apart = [i for i in range(len(texts)) if i + 1 == len(texts) or texts[i + 1] is not following[i]]
        prints = walk(texts + edited + [following[i] for i in apart])
        n = len(texts)
        own, changed = prints[:n], prints[n : 2 * n]
        after = np.concatenate([own[1:], own[:1]])
        after[apart] = prints[2 * n :]
        size, size_e, size_n = (np.array([len(t) for t in x]) for x in (texts, edited, following))
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in edited]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.binary()), _packed(own), _packed(changed), pa.array(likeness(own, changed, size, size_e)), pa.array(likeness(own, after, size, size_n))], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _ranges(rows: DataFrame, ranges: int) -> Column:
    """The range of a row (place, tie), ranges of about equal counts that rise with place and fall with tie.

    A place that fills several ranges has ranges of its own, by tie.  Only bounds reach the driver.
    """
    bounds = rows.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 20 * ranges))).first()[0] or []
    often = Counter(bounds)
    known = sorted(often)
    if not known:
        return F.lit(0)
    m, table_ = F.lit(len(known)), F.array(*[F.lit(b).cast("long") for b in known])
    step = lambda at, s: F.when((at + s <= m) & (F.element_at(table_, F.least(at + s, m)) < F.col("place")), at + s).otherwise(at)
    below = F.aggregate(F.array(*[F.lit(1 << k) for k in range(len(known).bit_length() - 1, -1, -1)]), F.lit(0), step)
    # range i holds the places above bound i - 1 up to bound i; if that bound is frequent, its own rows come after
    own = [often[b] if often[b] > 1 else 0 for b in known] + [0]
    start = np.concatenate([[0], np.cumsum(1 + np.array(own))[:-1]])
    at = lambda values: F.get(F.array(*[F.lit(int(x)) for x in values]), below)
    high = F.get(table_, below) == F.col("place")
    part = at(own) - F.least(F.floor((F.col("tie") / 2.0**64 + 0.5) * at(own)).cast("int"), at(own) - 1)
    return (at(start) + F.when(high & (at(own) > 0), part).otherwise(0)).cast("int")


def _dealt(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row, prints and hashes as bytes."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    rows = rows.withColumns({"place": F.coalesce("id", F.lit(-(2**63))), "tie": F.xxhash64("text")})
    rows = rows.withColumn("bucket", _ranges(rows, ranges))
    last = F.max(F.struct("place", F.bitwise_not("tie").alias("t")))
    heads = sorted((r["bucket"], r["h"]["place"], ~r["h"]["t"]) for r in rows.groupBy("bucket").agg(last.alias("h")).collect())
    if not heads:
        return rows.select("id", "text", "bucket", F.lit(0).alias("ghost")).mapInArrow(_digests, _SCHEMA)
    lent = [(at, *heads[i - 1][1:]) for i, (at, _, _) in enumerate(heads)]
    lend = F.broadcast(spark.createDataFrame(lent, "to int, p long, t long"))  # one row a range
    ghosts = rows.join(lend, (F.col("place") == F.col("p")) & (F.col("tie") == F.col("t")))
    ghosts = ghosts.select("id", "text", "place", "tie", F.col("to").alias("bucket"), F.lit(1).alias("ghost")).dropDuplicates(["bucket"])
    dealt = rows.select("id", "text", "place", "tie", "bucket", F.lit(0).alias("ghost")).unionAll(ghosts)
    dealt = dealt.repartitionById(heads[-1][0] + 1, F.col("bucket")).sortWithinPartitions("bucket", "ghost", F.col("place").desc(), "tie")
    return dealt.select("id", "text", "bucket", "ghost").mapInArrow(_digests, _SCHEMA)


def _hex(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}).withColumnRenamed("id", key)


def fingerprint_with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and its likeness to that and to the next row's.

    The next row is the one with the next smaller key (equal keys: by a hash of the text; no key
    comes last); the last row's next is the first, and a single row's is itself.  The edited text has the
    second half, floor(n / 2) code points, replaced by as many of the next row's first.  A null
    text counts as empty.  Other columns are ignored; an empty table gives an empty result.

    Rows are dealt into ranges of keys of equal counts, one shuffle of the texts; a key that fills several
    ranges is split by the text's hash.  The first row of each range is lent to the range above it.
    """
    return _hex(_dealt(df, key, text), key)


def fingerprints_with_groups(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = NEAR) -> DataFrame:
    """``fingerprint_with_next`` and ``component_id``, the smallest key of the documents joined as by ``near_by_edits``.

    Null texts are empty, and an empty one is joined with nothing; rows that repeat a key or text have a row each, equal
    texts are joined; an empty table gives no rows.
    """
    prints = table(_dealt(df, key, text))
    rows = prints.withColumn("cid", F.xxhash64("fingerprint"))
    out = rows.join(_groups(rows.select("id", "n_chars", "fingerprint", "cid"), least), "cid", "left")
    component = F.when(F.col("n_chars") > 0, F.col("component_id")).otherwise(F.col("id"))
    return _hex(out.select(*prints.columns, component.alias("component_id")), key)


_SCHEMA = "id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        if texts:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), _packed(walk(texts))], names=["id", "n_chars", "fingerprint"])


def _slots(prints: pa.ChunkedArray | pa.Array) -> np.ndarray:
    both = np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(-1, SLOTS // 2)
    return np.stack([both >> 4, both & 15], axis=2).reshape(-1, SLOTS)


def _alike(need: int):
    """(cid, root) of the rows of a meeting that fingerprints agreeing in ``need`` slots join to smaller ones."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("cid", "ascending")])
        left, right = sides(group)
        slots, comp = _slots(group.column("fingerprint")), group.column("comp").to_numpy()
        p, q = np.nonzero(within(slots[left], slots[right], SLOTS - need) & (comp[left][:, None] != comp[right]))
        label = np.arange(group.num_rows)
        lower_labels(label, left[p], right[q])
        cid = group.column("cid")
        return pa.table({"cid": cid, "root": cid.take(pa.array(label))}).filter(pa.array(label != np.arange(len(label))))

    return run


def _bands(need: int):
    """(cid, bands): a hash of the slots of each band, so many that fingerprints with ``need`` equal slots agree in one."""
    at = np.array_split(np.arange(SLOTS), SLOTS - need + 1)
    key = W.mix(np.arange(SLOTS, dtype=W.U) + W.U(909)) | W.U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                slots = _slots(batch.column("fingerprint")).astype(W.U) + W.U(1)
                keys = np.stack([W.mix((slots[:, i] * key[i]).sum(axis=1, dtype=W.U) + W.U(b)) for b, i in enumerate(at)], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, len(at)), pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("cid"), lists], names=["cid", "bands"])

    return run


def _groups(rows: DataFrame, least: float) -> DataFrame:
    """(cid, component_id) of the fingerprints of rows (id, n_chars, fingerprint, cid)."""
    need = min(SLOTS, max(1, int(np.ceil(least * SLOTS - 1e-9))))
    classes = table(rows.filter("n_chars > 0").groupBy("cid").agg(F.min("id").alias("id"), F.min("fingerprint").alias("fingerprint")))
    bucket = classes.select("cid", "fingerprint").mapInArrow(_bands(need), "cid long, bands array<long>").select("cid", F.explode("bands").alias("key"))
    shared = bucket.groupBy("key").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).filter("low < high").drop("high")
    members = table(bucket.join(shared.withColumn("k", apart("key")).drop("key"), apart("key") == F.col("k")).select("key", "cid", "low"))
    items = classes.join(members.select("cid").distinct(), "cid", "left_semi")
    items = table(items.select("cid", F.lit(1).cast("long").alias("n"), "fingerprint"))
    links = linked(members, items, ["fingerprint"], _alike(need), rows=PART, units=PART * SLOTS, shared=SMALL)
    found = connected_components(links, "cid", "root").select(F.col("node").alias("cid"), "component")
    return smallest_ids(classes.join(found, "cid", "left").select("cid", "id", F.coalesce("component", "cid").alias("component")))


def near_by_edits(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """(key, component_id): documents joined over fingerprints that agree in ``least`` of their slots or more.

    Equal fingerprints are one class (told apart by 64-bit hashes).  Fingerprints that differ in at most d slots
    agree in one of d + 1 bands that share out the slots, so every pair meets in a bucket; what a bucket holds is
    compared in parts.  Rows without a key join like others and get the smallest key, null if there is none; an
    empty text joins nothing.  Repeated rows stay; an empty table gives an empty result.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_prints, "id long, n_chars long, fingerprint binary")
    rows = table(rows.withColumn("cid", F.xxhash64("fingerprint")))
    out = rows.join(_groups(rows, least), "cid", "left")
    component = F.when(F.col("n_chars") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), component.alias("component_id"))
