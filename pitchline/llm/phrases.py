"""Operator 12: phrase collocations.  Merged count-min sketches tell which word n-grams can be frequent; only those are counted exactly.

A task counts n-grams in a sketch of its own: rows of cells, a cell for each n-gram in each row, counts held at the
threshold (more needn't be told apart).  Sketches are merged by adding cells, blocks of cells side by side.  A merged cell
counts at least what any of its n-grams occurs, so an n-gram below the threshold in one cell isn't frequent,
and nothing frequent is lost.  Words and pairs are sketched first; longer n-grams only where all their pairs survive.
What then survives is counted exactly, by the words themselves, never by hashes.

Scores and subsumption are joins of the counted phrases.  Everything is by language.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as W
from .slices import distinct, slice_hashes
from .storage import Tables

LONGEST, LEAST, SUBSUMED, TOP, SCALE = 4, 30, 80, 2000, 2_000_000
#: Rows of a sketch, and the powers of two between which their cells are chosen: about one for BYTES_A_CELL of text.
#: Beyond the upper one a corpus is still counted exactly, but fewer n-grams are ruled out beforehand.
DEPTH, FEWEST_BITS, MOST_BITS, BYTES_A_CELL = 3, 14, 24, 256
#: Cells that are merged as one row.
BLOCK_BITS = 14
#: UTF-8 bytes of whole texts that are sketched, and that are counted, together.
CHUNK_BYTES, COUNTED_BYTES = 1 << 20, 1 << 21
#: Shares in which a language's phrases are ranked before its best ones meet.
SHARES = 64
UNKNOWN = "und"
_SALT = [W.U(x) for x in np.random.default_rng(12).integers(0, 2**63, DEPTH)]
#: Bytes that end a piece, and those that end a word within one.
_PIECE, _WORD = b".,;:!?\n\x0b\x0c\r", b" \t"
_ENDS_PIECE, _ENDS_WORD = (np.isin(np.arange(256), list(x)) for x in (_PIECE, _PIECE + _WORD))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """Words of a chunk's texts with their pieces and languages, and the hashes of the n-grams that start at each word."""

    def __init__(self, data: np.ndarray, at: np.ndarray, langs: list[str]) -> None:
        self.data = data = _LOWER[data]
        n = len(data)
        blank = _ENDS_WORD[data]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        before, behind = np.ones(n, bool), np.ones(n, bool)
        before[1:], behind[:-1] = blank[:-1], blank[1:]
        self.start = np.flatnonzero(~blank & (before | edge[:-1]))
        self.size = np.flatnonzero(~blank & (behind | edge[1:])) + 1 - self.start
        doc = np.searchsorted(at, self.start, "right") - 1
        self.piece = np.cumsum(_ENDS_PIECE[data])[self.start] + doc if n else doc  # grows by the pieces' ends and from text to text
        self.langs = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        self.lang = np.array([number[x] for x in langs], np.int64)[doc] if n else doc
        self.seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs] or [0], W.U)

    def runs(self, n: int) -> np.ndarray:
        """Whether n words from each word on stand in one piece; as long as there are places for n words."""
        last = max(0, len(self.start) - n + 1)
        return self.piece[:last] == self.piece[n - 1 :]

    def hashes(self, longest: int) -> list[np.ndarray]:
        """For n from 1 on, hashes of the n-grams that start at each word, their language included."""
        word = slice_hashes(self.data, self.start, self.size)
        out = [W.mix(word ^ self.seeds[self.lang])]
        for n in range(2, longest + 1):
            last = max(0, len(word) - n + 1)
            out.append(W.mix(out[-1][:last] * W.U(0x9E3779B97F4A7C15) + word[n - 1 :]))
        return out


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (W.mix(h + _SALT[row]) >> W.U(64 - bits)).astype(np.int32)


class Reached:
    """Merged sketches as bits: which cells reach the threshold, by length of n-grams and row."""

    def __init__(self, bits: int, least: int) -> None:
        self.bits, self.least, self.of = bits, least, {}

    def __call__(self, n: int, h: np.ndarray) -> np.ndarray:
        """Whether each n-gram may be frequent."""
        ok = np.ones(len(h), bool)
        for row in range(DEPTH):
            c = cells(h, row, self.bits)
            ok &= (self.of[n][row][c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
        return ok


def survivors(w: Words, reached: Reached, lengths: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, (hashes, whether it may be frequent) of the n-grams that start at each word, as far as sketches of ``reached`` tell.

    Without a sketch of a length its n-grams survive by their pairs alone.
    """
    h, out, pairs = w.hashes(max(lengths)), {}, None
    for n in range(1, max(lengths) + 1):
        ok = w.runs(n)
        if n > 2 and pairs is not None:
            for k in range(n - 1):
                ok = ok & pairs[k : k + len(ok)]
        if n in reached.of:
            at = np.flatnonzero(ok)
            ok = np.zeros(len(ok), bool)
            ok[at] = reached(n, h[n - 1][at])
        if n == 2:
            pairs = ok
        if n in lengths:
            out[n] = h[n - 1], ok
    return out


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Words]:
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for a, b, data, at in W.chunks(batch.column(0), size):
            yield Words(data, at, langs[a:b])


def _sketch(lengths: tuple[int, ...], reached: Reached):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, most = reached.bits, reached.least
        counts = {(n, row): np.zeros(1 << bits, np.uint8) for n in lengths for row in range(DEPTH)}
        for w in _chunks(batches, CHUNK_BYTES):
            for n, (h, ok) in survivors(w, reached, lengths).items():
                h = h[: len(ok)][ok]
                for row in range(DEPTH):
                    c = np.sort(cells(h, row, bits))
                    first = np.flatnonzero(np.diff(c, prepend=-1))
                    many = np.minimum(np.diff(np.append(first, len(c))), most)
                    held = counts[n, row]
                    held[c[first]] = np.minimum(held[c[first]] + many, most)
        wide = min(bits, BLOCK_BITS)
        for (n, row), held in counts.items():
            blocks = held.reshape(-1, 1 << wide)
            used = np.flatnonzero(blocks.any(axis=1))
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array((n * DEPTH + row) * (1 << bits - wide) + used), pa.array([_packed(blocks[b]) for b in used], pa.binary())], names=["block", "counts"])

    return run


def _packed(counts: np.ndarray) -> bytes:
    """Counts of a block: all of them, or where few cells are used their places and counts; compressed, as most are small."""
    at = np.flatnonzero(counts)
    if len(at) * 4 > len(counts):
        return b"\0" + pa.compress(counts.tobytes(), codec="zstd", asbytes=True)
    return b"\1" + at.astype("<u2").tobytes() + counts[at].tobytes()


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    if raw[0] == 0:
        return np.frombuffer(pa.decompress(raw[1:], size, codec="zstd"), np.uint8)
    out, n = np.zeros(size, np.uint8), (len(raw) - 1) // 3
    out[np.frombuffer(raw, "<u2", n, 1)] = np.frombuffer(raw, np.uint8, n, 1 + 2 * n)
    return out


def _merge(size: int, least: int):
    """Adds the counts of equal blocks, which stand together, and keeps which cells reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "reached"])
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != now:
                    if now is not None:
                        yield done()
                    now, total = block, np.zeros(size, np.int16)
                total = np.minimum(total + _unpacked(raw, size), least).astype(np.int16)
        if now is not None:
            yield done()

    return run


def add_sketches(rows: DataFrame, reached: Reached, lengths: tuple[int, ...]) -> Reached:
    """``reached`` with the sketches of n-grams of these lengths over all texts; its size is fixed by the number of cells."""
    wide = min(reached.bits, BLOCK_BITS)
    per_row = 1 << reached.bits - wide
    parts = rows.mapInArrow(_sketch(lengths, reached), "block long, counts binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_merge(1 << wide, reached.least), "block long, reached binary")
    out = Reached(reached.bits, reached.least)
    out.of = reached.of | {n: [np.zeros((1 << reached.bits) // 8, np.uint8) for _ in range(DEPTH)] for n in lengths}
    for block, raw in merged.collect():  # a bit for each cell: at most 2 ** MOST_BITS / 8 bytes a row
        row, place = divmod(block, per_row)
        held = np.frombuffer(raw, np.uint8)
        out.of[row // DEPTH][row % DEPTH][place * len(held) : (place + 1) * len(held)] = held
    return out


def _count(longest: int, reached: Reached):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _chunks(batches, COUNTED_BYTES):
            words = np.bincount(w.lang, minlength=len(w.langs))
            yield _counted([w.langs[i] for i in np.flatnonzero(words)], 0, [""] * int((words > 0).sum()), words[words > 0])
            if not len(w.start):
                continue
            pick, kind = distinct(w.data, w.start, w.size)
            raw = w.data.tobytes()
            spelt = [raw[a : a + n].decode() for a, n in zip(w.start[pick].tolist(), w.size[pick].tolist(), strict=True)]
            ids = w.lang  # of what stands before the n-gram's last word; grown by one word at a time, so equal ids are equal words
            for n, (_, ok) in survivors(w, reached, tuple(range(1, longest + 1))).items():
                ok = ok & (ids[: len(ok)] >= 0)
                if n > 2:
                    ok &= ids[1 : len(ok) + 1] >= 0  # the n-gram without its first word survives too
                at = np.flatnonzero(ok)
                _, first, which, many = np.unique(ids[at] * len(pick) + kind[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
                ids = np.full(len(w.start), -1, np.int64)
                ids[at] = which
                place = at[first]
                columns = [[spelt[k] for k in kind[place + k].tolist()] for k in range(n)]
                phrase = columns[0] if n == 1 else list(map(" ".join, zip(*columns, strict=True)))
                yield _counted([w.langs[i] for i in w.lang[place].tolist()], n, phrase, many)

    return run


def _counted(langs: list[str], n: int, phrases: list[str], many: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.full(len(langs), n, np.int32)), pa.array(phrases, pa.string()), pa.array(many.astype(np.int64))], names=["lang", "words", "phrase", "n"])


def frequent(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, bits: int | None = None) -> DataFrame:
    """(lang, words, phrase, n): exact counts of all phrases of up to ``longest`` words that occur ``least`` times or more in a language.

    A row with 0 words and an empty phrase has the language's number of words.  Null languages are ``und``; null, empty and
    blank texts have no words; rows that repeat a text count each; an empty table gives no rows.  ``bits``: 2 to this
    power cells a row of a sketch, chosen by the size of the texts if not given.
    """
    if not 2 <= longest or not 1 <= least <= 250:
        raise ValueError("phrases have 2 words at least; thresholds go from 1 to 250")
    rows = df.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    if bits is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(FEWEST_BITS, round(math.log2(max(1, size / BYTES_A_CELL)))))
    reached = add_sketches(rows, Reached(bits, least), (1, 2))
    if longest > 2:
        reached = add_sketches(rows, reached, tuple(range(3, longest + 1)))
    counted = rows.mapInArrow(_count(longest, reached), "lang string, words int, phrase string, n long")
    return counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter((F.col("words") == 0) | (F.col("n") >= least))


def _part(first: str, many: str):
    return F.expr(f"array_join(slice(split(phrase, ' '), {first}, {many}), ' ')")


def cohesion(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the phrases of 2 words and more: their lowest-scoring cut, the earliest of equal ones.

    Products are decimals: they pass 64 bits on very large corpora.
    """
    parts = counts.filter("words > 0").select(F.col("lang"), F.col("phrase").alias("part"), F.col("n").alias("m"))
    cuts = counts.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumns({"left": _part("1", "k"), "right": _part("k + 1", "words - k")})
    cuts = cuts.join(parts.withColumnsRenamed({"part": "left", "m": "l"}), ["lang", "left"]).join(parts.withColumnsRenamed({"part": "right", "m": "r"}), ["lang", "right"])
    score = F.expr(f"(cast(a as decimal(20, 0)) * cast({SCALE} as decimal(7, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "words", "a")).alias("x"))
    return best.select("lang", "phrase", "x.words", "x.a", "x.l", "x.r", "x.score")


def subsumed(counts: DataFrame, percent: int = SUBSUMED) -> DataFrame:
    """(lang, phrase) of phrases within a longer one that occurs at least ``percent`` in a hundred as often."""
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> array_join(slice(split(phrase, ' '), s, m), ' '))))")
    longer = counts.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    near = F.expr(f"cast(100 as decimal(3, 0)) * cast(most as decimal(20, 0)) >= cast({percent} as decimal(3, 0)) * cast(n as decimal(20, 0))")
    return counts.filter("words > 1").select("lang", "phrase", "n").join(longer, ["lang", "phrase"]).filter(near).select("lang", "phrase")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, percent: int = SUBSUMED, top: int = TOP, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases, by score, occurrences and spelling.

    See ``frequent`` for odd rows.  A language without a frequent phrase has no rows.
    """
    counts = Tables(df.sparkSession).table(frequent(df, text, lang, longest, least, bits))
    left = cohesion(counts).join(subsumed(counts, percent), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    few = left.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top).drop("share", "rank")
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    total = counts.filter("words = 0").select("lang", F.col("n").alias("all"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("all").alias("n"), "score")
