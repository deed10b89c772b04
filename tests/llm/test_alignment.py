from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict

import pytest

from pitchline.llm import alignment, registry

pytestmark = pytest.mark.skipif(not os.path.exists(alignment.B_PATH), reason="no vocabulary file")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.B_PATH)


def tokens(sides, text):
    """The libraries' ids and token bytes of one text; None if bytes differ."""
    from pitchline.llm.bpe import byte_letters

    a, sp = sides
    letters = {c: i for i, c in enumerate(byte_letters())}
    ia = a.encode(" " + text, add_special_tokens=False).ids
    ba = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
    ib = sp.encode(text)
    bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    whole = (" " + text).encode()
    return (ia, ba, ib, bb) if text and b"".join(ba) == whole and b"".join(bb) == whole else None


def plain(sides, texts):
    """The contract's columns by loops over the libraries' tokens."""
    groups = []
    for text in texts:
        got, mine = tokens(sides, text or ""), []
        if got:
            ia, ba, ib, bb = got
            ends_a, ends_b, n = {}, {}, 0
            for k, x in enumerate(ba):
                n += len(x)
                ends_a[n] = k + 1
            n = 0
            for k, x in enumerate(bb):
                n += len(x)
                ends_b[n] = k + 1
            i = j = 0
            for cut in sorted(set(ends_a) & set(ends_b)):
                mine.append((ia[i : ends_a[cut]], ib[j : ends_b[cut]]))
                i, j = ends_a[cut], ends_b[cut]
        groups.append(mine)
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for c in links for p in c)
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for g, c in zip(groups, links, strict=True):
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in c.items()), hashlib.sha256(told.encode()).hexdigest() if told else ""))
    return out


def test_query_equals_plain_loops(spark, sides):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.op11_cross_alignment(spark, DATA).collect()}
    want = plain(sides, [d["text"] for d in docs])
    assert got == {d["doc_id"]: w for d, w in zip(docs, want, strict=True)}


def test_odd_rows(spark, sides, odd_docs, no_docs, monkeypatch):
    rng = random.Random(3)
    bits = ["a", "word", " ", "  ", "\n", "\t", "é", "漢", "😀", "▁", "<s>", "<0x41>", "<|endoftext|>", "'s", "ab" * 40, "\x00", "1234"]
    texts = [r["text"] for r in odd_docs.collect()] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i % 200, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
    order = lambda rows: sorted(rows)
    want = order([(i % 200, *w) for i, w in enumerate(plain(sides, texts))])
    assert order([tuple(r) for r in alignment.report(df).collect()]) == want
    assert alignment.report(no_docs).count() == 0 and alignment.align(no_docs).count() == 0
    assert alignment.report(odd_docs).count() == odd_docs.count()


def test_small_bundles_and_wide_groups_change_nothing(sides):
    import numpy as np

    texts = ["x" * 300, "naïve  text\n\nwith lines", "ab" * 500 + " end"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    t = alignment.Aligned(data, at, alignment.A_PATH, alignment.B_PATH)
    want = [x.tolist() for x in t.pair_counts()]
    alignment.LISTED, old = 0, alignment.LISTED
    try:
        assert [x.tolist() for x in t.pair_counts()] == want
    finally:
        alignment.LISTED = old


def test_alignment_itself(spark, sides):
    texts = ["Hello world's naïve tokenizers", "  two  spaces\n\nline", "ok ▁ not", None]
    rows = {r["doc_id"]: r for r in alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        got, r = tokens(sides, text or ""), rows[i]
        if got is None:
            assert all(r[c] == [] for c in alignment.COLUMNS)
            continue
        ia, ba, ib, bb = got
        assert (list(r["a_ids"]), list(r["b_ids"])) == (ia, ib)
        assert sum(r["group_a"]) == len(ia) and sum(r["group_b"]) == len(ib)
        span = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(len(parts))]
        meet = {(k, m) for k, (p, q) in enumerate(span(ba)) for m, (s, t) in enumerate(span(bb)) if p < t and s < q}
        assert set(zip(r["overlap_a"], r["overlap_b"], strict=True)) == meet and len(r["overlap_a"]) == len(meet)
