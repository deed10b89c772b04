"""Operator 11: alignment of two tokenizers' tokens by byte-owner arrays.

Both tokenizers spell the same bytes, a space and the text.  ``np.repeat`` of token indices over those bytes gives
each byte its owner in A and in B.  Where the pair of owners changes, two tokens overlap anew; where both change at
once, both tokenizers cut, and the tokens between two cuts are a group.  The tokens of a group are linked, each
of A with each of B.

How many documents hold a pair of ids linked is counted over the corpus.  Documents are packed in bundles of whole
texts, a bundle holds each of its pairs once with the number of its documents, and what is shuffled by pair are
those: rows grow with the text, and a pair that every document holds is one row a bundle.  Counts come back to
the bundles, where each document's links are summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import wordhash as W
from .slices import Lookup
from .storage import Tables, apart

#: Vocabulary files of A (byte-level BPE) and B (pieces); they stand at these places on every worker.
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: UTF-8 bytes of whole texts that are aligned together, and that one bundle holds.
CHUNK_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 23
#: Links of a group up to which they are listed one by one; larger groups go by distinct ids.
LISTED = 4096
_SPACE, _NEWLINE = 0x20, 0x0A
#: Pairs of ids are one number: A's id times this, plus B's.
B_IDS = 1 << 20
#: Stands for the ids of a unit whose pieces spell other bytes than it has.
UNFAITHFUL = (-1,)


class Pieces:
    """The piece tokenizer, asked once for each unit of text.

    Spaces become meta symbols; no piece holds one after another character, and none holds a line feed but its byte
    piece, so what the library does with a text falls apart before spaces and around line feeds.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spelt = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                spelt.append(b"")
            elif sp.is_byte(i):
                spelt.append(bytes([int(piece[3:5], 16)]))
            else:
                if "▁" in piece.lstrip("▁") or "\n" in piece:
                    raise ValueError(f"piece {i} crosses a unit border")
                spelt.append(piece.replace("▁", " ").encode())
        self.spelt, self.length = spelt, np.array([len(x) for x in spelt], np.int64)
        self.lookup = Lookup(self.encode_units)

    def encode_units(self, units: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each unit; a line feed before or behind it parts it from the library's own space."""
        if not units:
            return []
        inner = [u.startswith(b" ") for u in units]
        ids = self.sp.encode([u[1:].decode() + "\n" if lead else "\n" + u.decode() for u, lead in zip(units, inner, strict=True)], num_threads=1)
        out = [tuple(x[:-1] if lead else x[2:]) for x, lead in zip(ids, inner, strict=True)]
        return [x if b"".join([self.spelt[i] for i in x]) == u else UNFAITHFUL for x, u in zip(out, units, strict=True)]

    def encode_bytes(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that start with the library's space (byte bounds ``at``), and the bounds of each text's ids; -1 where pieces spell other bytes."""
        space, line = data == _SPACE, data == _NEWLINE
        start = space.copy()
        start[1:] &= ~space[:-1]
        start |= line
        start[1:] |= line[:-1]
        start[at[:-1][np.diff(at) > 0]] = True
        start = np.flatnonzero(start)
        ids, many = self.lookup.ids(data, start, np.diff(np.append(start, len(data))))
        return ids, np.concatenate([[0], np.cumsum(many)])[np.searchsorted(start, at)]


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Aligned:
    """Tokens and groups of a chunk's texts.  ``doc_``: bounds by text; ``group_``: bounds by group of A's and B's tokens."""

    def __init__(self, data: np.ndarray, at: np.ndarray, a_path: str, b_path: str) -> None:
        a_side, b_side = bpe.vocabulary(a_path), pieces(b_path)
        full = np.flatnonzero(np.diff(at) > 0)
        data = np.insert(data, at[:-1][full], _SPACE)
        at = at + np.searchsorted(full, np.arange(len(at)))  # one byte more for each full text before
        a, a_at = bpe.encode_bytes(a_side, data, at)
        b, b_at = b_side.encode_bytes(data, at) if len(data) else (a, a_at)
        texts = len(at) - 1
        b_doc = np.repeat(np.arange(texts), np.diff(b_at))
        odd = np.zeros(texts, bool)
        odd[b_doc[b < 0]] = True
        if odd.any():
            a, b = a[~np.repeat(odd, np.diff(a_at))], b[~odd[b_doc]]
            a_at, b_at = (np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(x)))]) for x in (a_at, b_at))
        self.a, self.b, self.doc_a, self.doc_b = a, b, a_at, b_at
        own_a = np.repeat(np.arange(len(a), dtype=np.int32), a_side.length[a])
        own_b = np.repeat(np.arange(len(b), dtype=np.int32), b_side.length[b])
        if len(own_a) != len(own_b):
            raise ValueError("the tokenizers spell different bytes")
        new_a, new_b = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
        first = np.arange(1) if len(own_a) else np.zeros(0, np.int64)
        self.overlaps = np.concatenate([first, 1 + np.flatnonzero(new_a | new_b)])
        cuts = np.concatenate([first, 1 + np.flatnonzero(new_a & new_b)])
        self.overlap_a, self.overlap_b = own_a[self.overlaps], own_b[self.overlaps]
        self.group_a, self.group_b = np.append(own_a[cuts], len(a)).astype(np.int64), np.append(own_b[cuts], len(b)).astype(np.int64)
        self.doc_group = np.searchsorted(self.group_a[:-1], a_at)
        self.n_a, self.n_b = np.diff(self.group_a), np.diff(self.group_b)

    def links(self) -> np.ndarray:
        """Links of each text."""
        upto = np.concatenate([[0], np.cumsum(self.n_a * self.n_b)])[self.doc_group]
        return np.diff(upto)

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair of ids, links) of every text's distinct pairs, by text and pair."""
        doc = np.repeat(np.arange(len(self.doc_group) - 1), np.diff(self.doc_group))
        small = np.flatnonzero(self.n_a * self.n_b <= LISTED)
        size = (self.n_a * self.n_b)[small]
        g = np.repeat(small, size)
        k = W.ranges(np.zeros(len(small), np.int64), size)
        wide = self.n_b[g]
        i = self.group_a[g] + k // wide
        j = self.group_b[g] + k - k // wide * wide
        docs, pairs, many = [doc[g]], [self.a[i].astype(np.int64) * B_IDS + self.b[j]], [np.ones(len(g), np.int64)]
        for g in np.flatnonzero(self.n_a * self.n_b > LISTED).tolist():
            x, cx = np.unique(self.a[self.group_a[g] : self.group_a[g + 1]], return_counts=True)
            y, cy = np.unique(self.b[self.group_b[g] : self.group_b[g + 1]], return_counts=True)
            pairs.append((x.astype(np.int64)[:, None] * B_IDS + y).ravel())
            many.append((cx[:, None] * cy).ravel())
            docs.append(np.full(len(pairs[-1]), doc[g]))
        return merged(*(np.concatenate(x) for x in (docs, pairs, many)))

    def group_digests(self) -> list[str]:
        """For each text the digest of its groups written out, '' without tokens."""
        ndig, digits = _decimals()
        groups = np.arange(len(self.n_a))
        of_a, of_b = np.repeat(groups, self.n_a), np.repeat(groups, self.n_b)
        at_a = np.arange(len(self.a)) + self.group_b[of_a]
        at_b = np.arange(len(self.b)) + self.group_a[of_b + 1]
        total = len(self.a) + len(self.b)
        ids, sep = np.empty(total, np.int32), np.full(total, ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        sep[at_a[self.group_a[1:] - 1]], sep[at_b[self.group_b[1:] - 1]] = ord("|"), ord(";")
        size = ndig[ids] + 1
        end = np.cumsum(size)
        text = np.empty(int(end[-1]) if total else 0, np.uint8)
        text[end - 1] = sep
        for d in range(digits.shape[1]):
            has = np.flatnonzero(size > d + 1)
            text[end[has] - 2 - d] = digits[ids[has], d]
        upto = np.concatenate([[0], end])[self.doc_a + self.doc_b]
        raw = text.tobytes()
        return [hashlib.sha256(raw[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


@cache
def _decimals() -> tuple[np.ndarray, np.ndarray]:
    """(number of decimal digits, digits from the last on) of every id."""
    n = np.arange(B_IDS)
    digits = np.stack([48 + n // 10**d % 10 for d in range(7)], axis=1).astype(np.uint8)
    return np.maximum(1, sum((n >= 10**d).astype(np.int64) for d in range(7))), digits


def merged(docs: np.ndarray, pairs: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``many`` by (doc, pair), in their order."""
    order = np.lexsort((pairs, docs)) if len(docs) and (docs[-1] >= 1 << 22 or pairs.max() >= 1 << 41) else np.argsort((docs << 41) + pairs, kind="stable")
    docs, pairs, many = docs[order], pairs[order], many[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (pairs[1:] != pairs[:-1])
    at = np.flatnonzero(new)
    return docs[at], pairs[at], np.add.reduceat(many, at) if len(at) else many


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, data, at in W.chunks(batch.column(1), CHUNK_BYTES):
                t = Aligned(data, at, a_path, b_path)
                own = lambda bounds: np.diff(bounds)
                by_a = np.searchsorted(t.overlap_a, t.doc_a)
                lists = [(t.a, t.doc_a), (t.b, t.doc_b), (t.n_a, t.doc_group), (t.n_b, t.doc_group), (t.overlap_a - np.repeat(t.doc_a[:-1], own(by_a)), by_a), (t.overlap_b - np.repeat(t.doc_b[:-1], own(by_a)), by_a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(v.astype(np.int32))) for v, off in lists)], names=["key", *COLUMNS])

    return run


COLUMNS = ("a_ids", "b_ids", "group_a", "group_b", "overlap_a", "overlap_b")


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))


def align(df: DataFrame, key: str = "doc_id", text: str = "text", a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """(key, a_ids, b_ids, group_a, group_b, overlap_a, overlap_b) of every row's whole text.

    ``group_a`` and ``group_b``: how many tokens of A and B each group holds, in order.  ``overlap_a[i]`` and ``overlap_b[i]``
    (places of tokens): two tokens that share bytes.  A null or empty text, and one whose tokens spell other bytes than a
    space and it (those with a meta symbol), has none.  Rows that repeat or lack a key are aligned each by itself;
    other columns are ignored; an empty table gives no rows.
    """
    rows = _rows(df, key, text)
    return rows.mapInArrow(_align(a_path, b_path), f"key {dict(rows.dtypes)['key']}, " + ", ".join(f"{c} array<int>" for c in COLUMNS)).withColumnRenamed("key", key)


class _Bundle:
    """Texts of one bundle as they come: their figures, and their pairs."""

    def __init__(self) -> None:
        self.bytes, self.docs, self.keys, self.parts, self.figures, self.digests = 0, 0, [], [], [], []

    def add(self, keys: pa.Array, size: int, t: Aligned) -> None:
        doc, pair, many = t.pair_counts()
        self.parts.append((doc + self.docs, pair, many))
        self.keys.append(keys)
        self.figures.append(np.stack([np.diff(t.doc_a), np.diff(t.doc_b), np.diff(t.doc_group), t.links()]))
        self.digests += t.group_digests()
        self.bytes, self.docs = self.bytes + size, self.docs + len(keys)

    def row(self, number: int) -> pa.RecordBatch:
        doc, pair, many = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        pairs, code, docs = np.unique(pair, return_inverse=True, return_counts=True)  # a text holds a pair once
        many = many.astype(np.int32) if not len(many) or many.max() < 1 << 31 else many
        keys, figures = pa.concat_arrays(self.keys), np.concatenate(self.figures, axis=1)
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        held = np.bincount(doc, minlength=self.docs)
        binary = lambda v: pa.array([v.tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(keys), *(one(pa.array(x)) for x in figures), one(pa.array(self.digests, pa.string())), one(pa.array(held)), binary(code.astype(np.int32)), binary(many), one(pa.array(pairs)), one(pa.array(docs))], names=["bundle", "keys", *FIGURES, "digests", "held", "code", "many", "pairs", "docs"])


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def _bundles(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = TaskContext.get().partitionId() << 32, _Bundle()
        for batch in batches:
            for x, y, data, at in W.chunks(batch.column(1), CHUNK_BYTES):
                now.add(batch.column(0).slice(x, y - x), len(data), Aligned(data, at, a_path, b_path))
                if now.bytes >= BUNDLE_BYTES:
                    yield now.row(number)
                    number, now = number + 1, _Bundle()
        if now.docs:
            yield now.row(number)

    return run


def _totals(key_type: pa.DataType):
    schema = pa.schema([("key", key_type), *((c, pa.int64()) for c in (*FIGURES, "n_best", "count_sum")), ("groups_sha256", pa.string())])

    def run(bundles: pa.Table, answers: pa.Table) -> pa.Table:
        if not bundles.num_rows:
            return schema.empty_table()
        row = {c: bundles.column(c)[0] for c in bundles.column_names}
        held, code = row["held"].values.to_numpy().astype(np.int64), np.frombuffer(row["code"].as_py(), np.int32)
        raw = row["many"].as_py()
        many = np.frombuffer(raw, np.int32 if len(raw) == 4 * len(code) else np.int64).astype(np.int64)
        count, best = np.zeros(answers.num_rows, np.int64), np.zeros(answers.num_rows, np.int64)
        place = answers.column("place").to_numpy()
        count[place], best[place] = answers.column("n").to_numpy(), answers.column("best").to_numpy()
        at = np.concatenate([[0], np.cumsum(held)])
        sums = [np.diff(np.concatenate([[0], np.cumsum(many * v[code])])[at]) for v in (best, count)]
        return pa.Table.from_arrays([row["keys"].values, *(row[c].values.cast(pa.int64()) for c in FIGURES), *(pa.array(s) for s in sums), row["digests"].values.cast(pa.string())], schema=schema)

    return run


def report(df: DataFrame, key: str = "doc_id", text: str = "text", a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A pair's count is the number of rows that hold it linked (rows that repeat a key or text count each); ``n_best``: the
    row's links whose pair has the highest count of its A id, ties included; ``count_sum``: counts summed over the row's
    links.  ``groups_sha256``: digest of the groups written ``a1,a2|b1;a3|b2,b3``.  Rows without tokens (see ``align``) have
    zeros and ''.  Null keys are keys like any other; other columns are ignored; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    tables, rows = Tables(df.sparkSession), _rows(df, key, text)
    kind = rows.schema["key"].dataType
    fields = f"bundle long, keys array<{kind.simpleString()}>, " + ", ".join(f"{c} array<long>" for c in FIGURES)
    bundles = tables.table(rows.mapInArrow(_bundles(a_path, b_path), f"{fields}, digests array<string>, held array<long>, code binary, many binary, pairs array<long>, docs array<long>"))
    asked = bundles.select(F.col("bundle").alias("b"), F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x")).select("b", "place", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = tables.table(asked.groupBy("pair").agg(F.sum("docs").alias("n")))
    top = counts.groupBy(F.expr(f"pair div {B_IDS}").alias("a")).agg(F.max("n").alias("top"))
    counts = counts.withColumn("a", F.expr(f"pair div {B_IDS}")).join(top, "a").select(apart("pair").alias("k"), "n", (F.col("n") == F.col("top")).cast("int").alias("best"))
    answers = asked.select("b", "place", apart("pair").alias("k")).join(counts, "k").select("b", "place", "n", "best")
    out = bundles.drop("pairs", "docs").groupBy("bundle").cogroup(answers.groupBy("b")).applyInArrow(_totals(to_arrow_type(kind)), f"key {kind.simpleString()}, " + ", ".join(f"{c} long" for c in (*FIGURES, "n_best", "count_sum")) + ", groups_sha256 string")
    return out.withColumnRenamed("key", key)
