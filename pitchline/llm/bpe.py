"""Operator 13: byte-level BPE encoding and decoding.

Pre-tokens are located without a regular expression.  Every character becomes a symbol (letter, number, other, the
kinds of white space and of contractions that the next two characters decide), every symbol a transition function
over eight states of the running pre-token, and since composition of functions is associative, all functions of a
chunk are composed as a scan: blocks side by side, one table look-up a character.  The states that result say
where pre-tokens start.

Equal pre-tokens of a chunk are merged once, and a worker remembers what it has merged.  Each token's byte offset
is kept: it cuts the decoded bytes into tokens, and shows what text a token covers.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .slices import Lookup

#: Vocabulary file: ranks (``.tiktoken``) or vocabulary and merges (``.json``); it stands at this place on every worker.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: UTF-8 bytes of whole texts that are worked on together; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Characters of one block of the scan.
BLOCK = 512
#: Bytes of the pre-tokens that are merged side by side; a longer one's merges wait in a heap.
WIDTHS = (8, 16, 32, 64)
NONE = np.int64(1) << 40

LETTER, NUMBER, OTHER, SHORT, PAIR, JOINS, ALONE, WIDE = range(8)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINED, IN_SPACE, ONE_LEFT, TWO_LEFT = range(8)
_SPACE, _BLANK = 3, 4  # classes of characters: white space but for the blank, and the blank
_APOSTROPHE = ord("'")
#: The contractions of the pre-tokenizer's pattern.
_SHORT, _PAIRS = "stmd", ("re", "ve", "ll")


@cache
def classes() -> np.ndarray:
    """Class of every code point: 0 letter, 1 number, 2 other, 3 white space, 4 the blank; read off what the library itself matches."""
    import tiktoken

    every = "".join(map(chr, chain_of_points()))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        matched = tiktoken.Encoding(kind, pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}).encode_ordinary(every)
        out[np.frombuffer(bytes(matched).decode().encode("utf-32-le"), np.uint32)] = kind
    out[0x20] = _BLANK
    return out


def chain_of_points() -> list[int]:
    """All code points that UTF-8 can spell."""
    return [*range(0xD800), *range(0xE000, 0x110000)]


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(state after the symbol, whether a pre-token starts at it)."""
    if symbol == LETTER:
        if state >= ONE_LEFT:
            return (FRESH if state == ONE_LEFT else ONE_LEFT), False
        return IN_LETTERS, state not in (IN_LETTERS, JOINED)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINED)
    if symbol in (OTHER, SHORT, PAIR):
        if state in (IN_OTHERS, JOINED):
            return IN_OTHERS, False  # also an apostrophe: no contraction starts within a pre-token
        return (IN_OTHERS, ONE_LEFT, TWO_LEFT)[symbol - OTHER], True
    if symbol == WIDE:
        return IN_SPACE, state != IN_SPACE
    return (JOINED if symbol == JOINS else FRESH), True


@cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, function after one more symbol, state that a function makes of a state, starts by state and symbol).

    Symbols 8 to 15 are 0 to 7 at the start of a text: constant functions, so texts don't see each other.
    """
    to = np.array([[_step(FRESH if x >= 8 else s, x % 8)[0] for s in range(8)] for x in range(16)], np.uint8)
    starts = np.array([[_step(FRESH if x >= 8 else s, x % 8)[1] for x in range(16)] for s in range(8)])
    functions = [tuple(range(8))]
    number = {functions[0]: 0}
    after = []
    for f in functions:  # grows until it is closed under composition
        row = []
        for x in range(16):
            g = tuple(int(to[x, s]) for s in f)
            if g not in number:
                number[g] = len(functions)
                functions.append(g)
            row.append(number[g])
        after.append(row)
    return np.array(after[0], np.uint16), np.array(after, np.uint16).ravel(), np.array(functions, np.uint8), starts


def symbols(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Symbol of every character of concatenated texts (bounds ``at``), from its class and what follows it in its text."""
    n = len(codes)
    kind = classes()[codes]
    white = kind >= _SPACE
    last = np.zeros(n, bool)  # of a text
    last[at[1:][np.diff(at) > 0] - 1] = True
    inked = np.zeros(n, bool)  # something else than white space follows
    inked[:-1] = ~white[1:]
    inked &= ~last
    out = kind.copy()
    out[white] = np.where(inked[white], np.where(kind[white] == _BLANK, JOINS, ALONE), WIDE)
    quote = np.flatnonzero((codes == _APOSTROPHE) & ~last)
    next1 = codes[quote + 1]
    out[quote[np.isin(next1, [ord(c) for c in _SHORT])]] = SHORT
    quote, next1 = quote[(two := ~last[quote + 1])], next1[two]
    next2 = codes[quote + 2]
    for a, b in _PAIRS:
        out[quote[(next1 == ord(a)) & (next2 == ord(b))]] = PAIR
    out[at[:-1][np.diff(at) > 0]] += 8
    return out


def pretoken_starts(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the characters at which a pre-token starts."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    _, after, states, starts = _automaton()
    sym = symbols(codes, at)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, WIDE, np.uint8)
    padded[:n] = sym
    across = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T).astype(np.uint16)
    before = np.empty((BLOCK, blocks), np.uint16)  # composition of the block's functions before each character
    f = np.zeros(blocks, np.uint16)
    for k in range(BLOCK):
        before[k] = f
        f = after[f.astype(np.int64) * 16 + across[k]]
    enters, state = np.empty(blocks, np.uint8), FRESH
    for b, g in enumerate(f.tolist()):
        enters[b] = state
        state = states[g, state]
    held = states[before.T.ravel()[:n], np.repeat(enters, BLOCK)[:n]]
    return np.flatnonzero(starts[held, sym])


class Vocabulary:
    """Ranks of token bytes, and every id's bytes for decoding."""

    def __init__(self, path: str) -> None:
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            spelt = {c: b for b, c in enumerate(byte_letters())}
            self.ranks = {bytes(spelt[c] for c in token): i for token, i in model["vocab"].items() if all(c in spelt for c in token)}
            merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
            if merged != list(range(256, 256 + len(merged))):
                raise ValueError(f"{path}: ids don't follow the order of merges")
            self.ranks = {t: i for t, i in self.ranks.items() if i < 256 + len(merged)}  # special tokens aren't reached by merging
        else:
            with open(path, "rb") as f:
                self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        size = 1 + max(self.ranks.values())
        by_id = [b""] * size
        for token, i in self.ranks.items():
            by_id[i] = token
        self.length = np.array([len(t) for t in by_id], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        self.spelt = np.frombuffer(b"".join(by_id), np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted((self.ranks[t[:k]] * (1 << 32) + self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks)
        self.pairs, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.lookup = Lookup(self.merge)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of pre-tokens: a pair of lowest rank merges first, of equal ones the leftmost; pieces of like length side by side."""
        out = [(self.ranks[p],) if p in self.ranks else () for p in pieces]
        open_ = [i for i, p in enumerate(pieces) if not out[i]]
        for low, high in zip((0, *WIDTHS), WIDTHS, strict=False):
            rows = [i for i in open_ if low < len(pieces[i]) <= high]
            for i, ids in zip(rows, self._merge_block([pieces[i] for i in rows], high), strict=True):
                out[i] = ids
        for i in (i for i in open_ if len(pieces[i]) > WIDTHS[-1]):
            out[i] = self._merge_long([pieces[i][k : k + 1] for k in range(len(pieces[i]))])
        return out

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of what two tokens spell together; NONE where that is no token or there is no second one."""
        key = a.astype(np.int64) * (1 << 32) + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NONE)

    def _merge_block(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """One merge of every piece a round; a row is a piece's tokens, then -1."""
        if not pieces:
            return []
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < size[:, None], self.byte_ids[raw], -1)
        ids = np.concatenate([ids, np.full((len(ids), 1), -1, ids.dtype)], axis=1)
        ranks, live, done = self._pair_ranks(ids[:, :-1], ids[:, 1:]), np.arange(len(ids)), ids.copy()
        columns = np.arange(width + 1)
        while len(live):
            j = ranks.argmin(axis=1)
            best = ranks[np.arange(len(ranks)), j]
            over = best == NONE
            if over.any():
                done[live[over]] = ids[over]
                ids, ranks, live, j, best = ids[~over], ranks[~over], live[~over], j[~over], best[~over]
                if not len(live):
                    break
            row = np.arange(len(live))
            shifted = np.minimum(columns + (columns > j[:, None]), width)
            ids = np.take_along_axis(ids, shifted, 1)
            ids[:, -1] = -1
            ids[row, j] = best  # a rank is the id
            ranks = np.take_along_axis(ranks, np.minimum(shifted[:, :-1], width - 1), 1)
            ranks[:, -1] = NONE
            ranks[row, j] = self._pair_ranks(best, ids[row, j + 1])
            left = np.flatnonzero(j > 0)
            ranks[left, j[left] - 1] = self._pair_ranks(ids[left, j[left] - 1], best[left])
        many = (done >= 0).sum(axis=1)
        return [tuple(r[:n]) for r, n in zip(done.tolist(), many.tolist(), strict=True)]

    def _merge_long(self, parts: list[bytes | None]) -> tuple[int, ...]:
        ranks, n = self.ranks, len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has merged meanwhile
            parts[i], parts[j] = parts[i] + parts[j], None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
            if (h := left[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, len(parts[h]) + len(parts[i])))
        return tuple(ranks[p] for p in parts if p is not None)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in ``.json`` vocabularies: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + shifted.index(b)) for b in range(256)]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_bytes(v: Vocabulary, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of concatenated UTF-8 texts (byte bounds ``at``), and the bounds of each text's ids."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    start = heads[pretoken_starts(codes, np.searchsorted(heads, at))]
    ids, many = v.lookup.ids(data, start, np.diff(np.append(start, len(data))))
    return ids, np.concatenate([[0], np.cumsum(many)])[np.searchsorted(start, at)]


def decode_ids(v: Vocabulary, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the ids spell, and the bounds of each text's bytes."""
    size = v.length[ids]
    data = v.spelt[W.ranges(v.at[ids], size)] if len(ids) else np.zeros(0, np.uint8)
    return data, np.concatenate([[0], np.cumsum(size)])[off]


def _lists(off: np.ndarray, values: np.ndarray, packed: bool) -> pa.Array:
    if not packed:
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.astype(np.int32)))
    return _binary(off * 4, values.astype("<u4").view(np.uint8))


def _binary(at: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _encode(path: str, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for a, b, data, at in W.chunks(batch.column(1), CHUNK_BYTES):
                ids, off = encode_bytes(v, data, at)
                size = v.length[ids]
                places = np.cumsum(size) - size - np.repeat(at[:-1], np.diff(off))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(off)), _lists(off, ids, packed), _lists(off, places, packed)], names=["key", "n_tokens", "ids", "starts"])

    return run


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, packed: bool = False) -> DataFrame:
    """(key, n_tokens, ids, starts) of every row: its whole text's tokens and the byte at which each one starts.

    ``ids`` and ``starts`` are arrays of int, or with ``packed`` binaries of little-endian unsigned 32-bit integers, as
    token files hold them.  Special tokens aren't known: their strings are text.  A null or empty text has no tokens.
    Rows that repeat or lack a key are encoded each by itself; other columns are ignored; an empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = "binary" if packed else "array<int>"
    out = rows.mapInArrow(_encode(path, packed), f"key {dict(rows.dtypes)['key']}, n_tokens long, ids {kind}, starts {kind}")
    return out.withColumnRenamed("key", key)


def _decode(path: str, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for a, b in _row_runs(batch.column(place), v):
                part = batch.slice(a, b - a)
                ids, off = _ids(part.column(place))
                data, at = decode_ids(v, ids, off)
                yield pa.RecordBatch.from_arrays([*part.columns, _binary(at, data)], names=[*batch.schema.names, "decoded"])

    return run


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a column of arrays or packed binaries, and their bounds; null counts as empty."""
    if pa.types.is_binary(column.type):
        data, off = W.buffers(column.fill_null(b"").cast(pa.large_binary()).view(pa.large_string()))
        return np.frombuffer(data.tobytes(), "<u4").astype(np.int64), off // 4
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(size)])


def _row_runs(column: pa.Array, v: Vocabulary) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about as many ids as a chunk's bytes hold at most."""
    packed = pa.types.is_binary(column.type)
    size = (pc.binary_length(column) if packed else pc.list_value_length(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, a = np.cumsum(size // (4 if packed else 1)), 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CHUNK_BYTES // 2, "right")))
        yield a, b
        a = b


def decode(df: DataFrame, ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """All columns of ``df`` and ``decoded``, the bytes that the row's ids (an array, or packed) spell.

    Null or empty ids give no bytes; bytes needn't be whole characters.  A column named ``decoded`` already is replaced.
    An id outside the vocabulary is an error.
    """
    rows = df.drop("decoded")
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_decode(path, rows.columns.index(ids)), f"{schema}, decoded binary")


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded again, both as lowercase hex digests."""
    back = decode(encode(df, key, text, path, packed=True).drop("starts"), path=path)
    return back.select(key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
