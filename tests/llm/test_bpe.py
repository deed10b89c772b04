from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from pitchline.llm import bpe, registry, slices, wordhash

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")
DATA = "/root/testdata/sf0.001"
BITS = ["'", "'s", "'re", "'ll", "'S", "t", "d", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x00", "a", "B", "é", "é", "1", "²", "!", "...", "😀", "漢字", "<|endoftext|>", "x" * 70]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(bpe.VOCABULARY).ranks, special_tokens={})


def encoded(texts: list[str], path: str = bpe.VOCABULARY) -> list[list[int]]:
    v, out = bpe.vocabulary(path), []
    for _, _, data, at in wordhash.chunks(pa.array(texts), bpe.CHUNK_BYTES):
        ids, off = bpe.encode_bytes(v, data, at)
        back, back_at = bpe.decode_ids(v, ids, off)
        assert (back == data).all() and (back_at == at).all()
        out += [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]
    return out


def test_every_code_point_and_odd_strings(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["".join(map(chr, bpe.chain_of_points())), "x" * 20_000, "ab" * 3000, " " * 5000, "'s" * 999, ""]
    assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


def test_both_vocabulary_files_agree_with_their_libraries(spark, library):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    other.encode_special_tokens = True
    rng = random.Random(6)
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + ["".join(rng.choice(BITS) for _ in range(30)) for _ in range(2000)]
    want = [library.encode_ordinary(t) for t in texts]
    assert encoded(texts) == want
    assert encoded(texts, path) == [x.ids for x in other.encode_batch(texts, add_special_tokens=False)]


def test_long_and_short_merges_are_the_same():
    v, rng = bpe.vocabulary(bpe.VOCABULARY), random.Random(7)
    parts = [bytes(rng.choice(b"abcdeerstt \xc3\xa9\x00") for _ in range(rng.randint(2, 64))) for _ in range(2000)]
    assert v.merge(parts) == [(v.ranks[p],) if p in v.ranks else v._merge_long([p[i : i + 1] for i in range(len(p))]) for p in parts]


def test_slices_of_one_hash_stay_apart(monkeypatch):
    data, start, size = np.frombuffer(b"abcabdab", np.uint8), np.array([0, 3, 6]), np.array([3, 3, 2])
    monkeypatch.setattr(slices, "slice_hashes", lambda data, start, size: np.zeros(len(start), np.uint64))
    pick, kind = slices.distinct(data, start, size)
    assert len(set(kind.tolist())) == 3 and pick[kind].tolist() == [0, 1, 2]


def test_query_equals_the_library(spark, library):
    rows = {r["doc_id"]: r for r in registry.op13_byte_bpe(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d["text"] or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())
        assert tuple(rows[d["doc_id"]])[1:] == want


def test_odd_rows(odd_docs, no_docs, library):
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, tuple(r["ids"]))
    out = bpe.encode(odd_docs)
    rows, texts = sorted(out.collect(), key=key), odd_docs.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0, tuple(library.encode_ordinary(r["text"] or ""))) for r in texts))
    assert [key(r) for r in rows] == want
    for r in bpe.decode(out).collect():
        v, at = bpe.vocabulary(bpe.VOCABULARY), [*r["starts"], len(r["decoded"])]
        assert [bytes(r["decoded"][a:b]) for a, b in zip(at, at[1:], strict=False)] == [bytes(v.spelt[v.at[i] : v.at[i + 1]]) for i in r["ids"]]
    assert {bytes(r["decoded"]) for r in bpe.decode(bpe.encode(odd_docs, packed=True)).collect()} == {(r["text"] or "").encode() for r in texts}
    assert bpe.encode(no_docs).count() == 0 and bpe.decode(bpe.encode(no_docs)).count() == 0 and bpe.digests(no_docs).count() == 0
    assert bpe.decode(odd_docs.selectExpr("id", "cast(null as array<int>) as ids", "`rep`")).select("decoded").distinct().collect()[0][0] == b""
