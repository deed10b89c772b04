"""Operator 4: secret scans with a random forest that removes false positives.

Candidates are words that could be credentials: long enough and with a figure in them, the value
of an assignment to a telling name, or with the start of a known kind of key; private-key blocks are found by their borders.  Each
candidate gets features (its length, how usual its character transitions are, how much of it the
dictionary covers, its make-up, its path, the words beside it), and a random forest trained on
labelled findings decides.  Dictionary and transitions are counted over all whole texts of the corpus.

Words are cut out by array operations over whole chunks; Python only sees the few candidates.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .storage import cut, inner

#: The dictionary holds the words that occur COMMON times or more and are at least this share of all words: however
#: large the corpus, no more than 1 / SHARE words can be.
COMMON, SHARE = 3, 2e-6
#: Characters cut into words at a time, and distinct words that are counted before they are handed on.
SLICE, HELD = 1_000_000, 100_000
LEAST, NAME_BYTES, MASK = 10, 42, "[SECRET]"
TREES, DEPTH, LEAF = 24, 8, 3
TELLING = ("password", "passphrase", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "authorization", "bearer", "credential", "private_key", "client_secret", "key")
HARMLESS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "rev", "revision", "id", "uuid", "guid", "phone", "tel", "card", "iban", "isbn", "version", "order", "build", "hash", "etag")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "rk_live_", "AIza", "ya29.", "eyJ", "SG.", "npm_", "pypi-", "hf_", "dop_v1_")
SAMPLE_PATHS = ("test", "example", "sample", "doc", "fixture", "mock")
_EDGE = "\"'`()[]{}<>,;.!?"
_ASSIGN = re.compile(r"^([\"']?[A-Za-z][\w.\-]{1,40}[\"']?)(?:=|:=|:)(?!//)(.+)$")
_NAME_ONLY = re.compile(r"^[\"']?[A-Za-z][\w.\-]*[\"']?(?::=|=|:)$")
_PEM = re.compile(rb"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----.*?(?:-----END [A-Z ]{0,40}PRIVATE KEY-----|\Z)", re.S)
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_GAP = re.compile(r"\s")
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_QUOTES = np.zeros(256, bool)
_QUOTES[list(_EDGE.encode())] = True
_HEADS = tuple(p.encode() for p in PREFIXES)
_TWO = np.zeros(1 << 16, bool)  # whether a prefix starts with these two bytes
_TWO[[h[0] << 8 | h[1] for h in _HEADS]] = True


def tells(names: Iterable[str], word: str) -> bool:
    """Whether a word is one of the names, or holds one of four letters or more."""
    return any(word == x or (len(x) > 3 and x in word) for x in names)


def _telling(raw: bytes) -> bool:
    return tells(TELLING, raw.decode("utf-8", "replace").lower().strip("\"'"))


@dataclass
class Candidate:
    row: int
    start: int  # bytes, in the chunk
    end: int
    value: str
    name: str
    before: str
    further: str
    after: str


def candidates(data: np.ndarray, off: np.ndarray) -> list[Candidate]:
    """Candidates of a chunk in order; start and end bound the value without quotes and punctuation."""
    starts, ends, first = W.word_bounds(data, off)
    if not len(starts):
        return []
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int32)])
    equals = np.concatenate([[0], np.cumsum((data == 61) | (data == 58), dtype=np.int32)])
    size = ends - starts
    hit = (size >= LEAST) & ((digits[ends] > digits[starts]) | (equals[ends] > equals[starts]))
    row = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    named = np.zeros(len(starts), bool)
    text_of = lambda i: bytes(data[starts[i] : ends[i]])
    # a word after "name =", "name:", "name is" or "bearer" is a candidate without figures, too
    signs = (size <= 2) & (equals[ends] > equals[starts])
    signs |= (size == 2) & (data[starts] == ord("i")) & (data[ends - 1] == ord("s"))
    for i in np.flatnonzero(signs):
        if i and row[i - 1] == row[i] and _telling(text_of(i - 1)):
            named[i + 1 : i + 2] = True
    for i in np.flatnonzero((data[ends - 1] == 58) & (size <= NAME_BYTES)):
        if _telling(text_of(i)[:-1]):
            named[i + 1 : i + 2] = True
    for i in np.flatnonzero((size == 6) & ((data[starts] | 32) == ord("b")) & ((data[ends - 1] | 32) == ord("r"))):
        if text_of(i).lower() == b"bearer":
            named[i + 1 : i + 2] = True
    named &= size >= 8
    named[1:] &= row[1:] == row[:-1]
    raw = data.tobytes()
    # so is one that starts like a key, quotes and brackets aside
    rest = np.flatnonzero((size >= LEAST) & ~hit)
    body = np.append(np.flatnonzero(~_QUOTES[data]), len(data))
    lead = np.minimum(body[np.searchsorted(body, starts[rest])], ends[rest] - 1)
    two = data[lead].astype(np.uint16) << 8 | data[np.minimum(lead + 1, len(data) - 1)]
    for i, a in zip(rest[_TWO[two]], lead[_TWO[two]], strict=True):
        hit[i] = raw.startswith(_HEADS, a, ends[i])
    word = lambda i, r: raw[starts[i] : ends[i]].decode("utf-8", "replace") if 0 <= i < len(starts) and row[i] == r else ""
    out = []
    for i in np.flatnonzero(hit | named):
        r = int(row[i])
        text, a, name = word(i, r), int(starts[i]), ""
        if _NAME_ONLY.match(text):
            continue  # the value stands in the next word
        if m := _ASSIGN.match(text):
            name, value = m[1].strip("\"'"), m[2]
            a += len(text[: m.start(2)].encode())
        else:
            value = text.lstrip("=:")  # the name stands in the word before
            a += len(text) - len(value)
        lead = value[: len(value) - len(value.lstrip(_EDGE))]
        a += len(lead.encode())
        value = value.strip(_EDGE)
        if len(value) >= (8 if name or named[i] else LEAST):
            out.append(Candidate(r, a, a + len(value.encode()), value, name, word(i - 1, r), word(i - 2, r), word(i + 1, r)))
    return out


@dataclass
class Knowledge:
    """A dictionary and the log-probabilities of character transitions of ordinary words; ``rare`` is the least of them."""

    words: frozenset[str]
    moves: dict[str, float]
    rare: float


_RARE = math.log(0.5 / 200.0)


def count_words(texts: Iterable[str]) -> Iterator[tuple[Counter, Counter]]:
    """Parts of the counts of ordinary words and of their character pairs, over whole texts."""
    counts: Counter[str] = Counter()
    for t in texts:
        at = 0
        while at < len(t):  # a slice ends at a space
            gap = _GAP.search(t, at + SLICE)
            to = gap.start() if gap else len(t)
            counts.update(t[at:to].split())
            at = to
            if len(counts) >= HELD:
                yield _plain(counts)
                counts = Counter()
    if counts:
        yield _plain(counts)


def _plain(counts: Counter) -> tuple[Counter, Counter]:
    words, pairs = Counter(), Counter()
    for w, n in counts.items():
        w = w.lower().strip(_EDGE)
        if len(w) <= 24 and w.isalpha():
            words[w] += n
            for a, b in zip("^" + w, w + "$", strict=True):
                pairs[a + b] += n
    return words, pairs


def _move(n: int, first: int) -> float:
    return math.log((n + 0.5) / (first + 20.0))


def learn_words(texts: list[str]) -> Knowledge:
    words, pairs, firsts = Counter(), Counter(), Counter()
    for w, p in count_words(texts):
        words.update(w)
        pairs.update(p)
    for p, n in pairs.items():
        firsts[p[0]] += n
    moves = {p: m for p, n in pairs.items() if (m := _move(n, firsts[p[0]])) > _RARE}
    least = max(COMMON, SHARE * sum(words.values()))
    return Knowledge(frozenset(w for w, n in words.items() if n >= least and len(w) >= 3), moves, _RARE)


def _coverage(k: Knowledge, value: str) -> float:
    """Share of the letters that dictionary words of three letters or more cover, longest first from the left."""
    low, i, got = value.lower(), 0, 0
    while i < len(low):
        n = next((n for n in range(min(14, len(low) - i), 2, -1) if low[i : i + n] in k.words), 0)
        got += n
        i += n or 1
    return got / max(len(low), 1)


def _luhn(value: str) -> bool:
    d = [int(c) for c in value if c.isdigit()]
    if not 12 <= len(d) <= 19 or len(d) + sum(c in " -" for c in value) != len(value):
        return False
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def describe(k: Knowledge, c: Candidate, path: str) -> list[float]:
    v = c.value
    n = len(v)
    low = v.lower()
    kinds = ["9" if x.isdigit() else "a" if x.islower() else "A" if x.isupper() else "-" for x in v]
    freq = Counter(v)
    moves = sum(k.moves.get(a + b, k.rare) for a, b in zip("^" + low, low + "$", strict=True)) / (n + 1)
    near = [c.name.lower(), c.before.lower().strip("=:\"' "), c.further.lower().strip("=:\"' ")]
    told = lambda names, w: float(tells(names, w))
    return [
        min(len(c.value), 400), moves, _coverage(k, v), -sum(f / n * math.log2(f / n) for f in freq.values()),
        kinds.count("9") / n, kinds.count("a") / n, kinds.count("A") / n, kinds.count("-") / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, float(all(x in "0123456789abcdefABCDEF" for x in v)),
        float(v.replace("-", "").isdigit()), float(_luhn(v)), float(bool(re.fullmatch(r"[\d.:/]+", v))), float("@" in v), float("/" in v), float("." in v),
        float(bool(_UUID.match(v))), float(v.startswith(PREFIXES)), float(len(c.value) in (32, 40, 64)),
        told(TELLING, near[0]), max(told(TELLING, near[1]), told(TELLING, near[2])), max(told(HARMLESS, w) for w in near),
        float(c.before in ("=", ":", ":=", "=>") or c.before.endswith((":", "="))), float(c.after[:1] in ("", "#", "/")), float(any(x in path.lower() for x in SAMPLE_PATHS)),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, left child, right child, share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := np.flatnonzero(feature[at] >= 0)).size:
                here = at[inner]
                at[inner] = np.where(x[inner, feature[here]] <= threshold[here], left[here], right[here])
            total += value[at]
        return total / max(len(self.trees), 1)


def grow_forest(x: np.ndarray, y: np.ndarray, seed: int = 4) -> Forest:
    """Bootstrap trees with random feature subsets at each split, by Gini impurity."""
    rng = np.random.default_rng(seed)
    tries = max(1, round(math.sqrt(x.shape[1])) + 1)
    trees = []
    for _ in range(TREES):
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, depth: int, nodes: list[list[float]] = nodes) -> int:
            me, share = len(nodes), float(y[rows].mean())
            nodes.append([-1, 0.0, 0, 0, share])
            if depth == DEPTH or len(rows) < 2 * LEAF or share in (0.0, 1.0):
                return me
            best = (2 * share * (1 - share) - 1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], tries, replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(rows))
                p, q = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(rows) - n)
                gini = (n * 2 * p * (1 - p) + (len(rows) - n) * 2 * q * (1 - q)) / len(rows)
                gini[(v[1:] == v[:-1]) | (n < LEAF) | (len(rows) - n < LEAF)] = 9
                i = int(gini.argmin()) if len(gini) else 0
                if len(gini) and gini[i] < best[0]:
                    middle = float((v[i] + v[i + 1]) / 2)
                    best = (float(gini[i]), int(f), middle if middle < v[i + 1] else float(v[i]))  # neighbouring floats have no middle
            if best[1] >= 0:
                go = x[rows, best[1]] <= best[2]
                nodes[me][:2] = best[1:]
                nodes[me][2], nodes[me][3] = grow(rows[go], depth + 1), grow(rows[~go], depth + 1)
            return me

        grow(rng.integers(0, len(y), len(y)), 0)
        f, t, a, b, s = zip(*nodes, strict=True)
        trees.append((np.array(f, np.int64), np.array(t), np.array(a, np.int64), np.array(b, np.int64), np.array(s)))
    return Forest(trees)


Finding = tuple[str, str, tuple[tuple[int, int], ...]]


def labelled_findings(known: Knowledge, n: int = 2800, seed: int = 44) -> list[Finding]:
    """(text, path, where its secrets start and end) of made-up findings: credentials of many forms, and look-alikes without a secret, among ordinary words."""
    rng = np.random.default_rng(seed)
    words = sorted(known.words) or ["lorem", "ipsum", "dolor"]
    pick = lambda s, n: "".join(rng.choice(list(s), n))
    up, low, dig, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    b62 = up + low + dig
    word = lambda: words[rng.integers(len(words))]
    some = lambda *x: x[rng.integers(len(x))]
    mixed = lambda a, b: pick(b62, int(rng.integers(a, b))) + pick(dig, 1)
    bare = lambda a, b: pick(some(up + low, up + low, low), int(rng.integers(a, b)))
    long_words = [w for w in words if len(w) >= 8] or [w * 8 for w in words]
    longer = lambda: long_words[rng.integers(len(long_words))]
    phrase = lambda: "".join(word().title() for _ in range(rng.integers(3, 5)))

    def card() -> str:
        d = "4" + pick(dig, 14)
        return next(d + c for c in dig if _luhn(d + c)) if rng.random() < 0.5 else "4" + pick(dig, 15)

    mark = lambda v: f"\x01{v}\x02"  # noqa: E731  the borders of a secret, until the text is whole
    names = lambda: some("DB_PASSWORD", "db_password", "user_token", "passphrase", "smtp_secret", "AUTH_TOKEN", "client-secret", "password")
    secret = [
        lambda: mark(some("AKIA", "ASIA") + pick(up + "234567" + dig, 16)), lambda: mark(some("ghp_", "gho_", "ghs_") + pick(b62, 36)), lambda: mark(some("sk_live_", "rk_live_") + pick(b62, 24)),
        lambda: mark("xoxb-" + pick(dig, 12) + "-" + pick(b62, 24)), lambda: mark("AIza" + pick(b62 + "-_", 35)), lambda: mark("hf_" + pick(b62, 34)), lambda: mark("glpat-" + pick(b62, 20)), lambda: mark("eyJ" + pick(b62, 30) + "." + pick(b62, 60) + "." + pick(b62, 40)),
        lambda: some("password", "passwd", "pwd", "secret", "api_key", "token", "client_secret") + some("=", ":", " =") + mark(some(pick(hexa, 18), pick(hexa, 32), mixed(12, 30), pick(b62 + "#%+/", 16) + "9")),
        lambda: some("token", "secret", "api_key", "password", "auth") + some(" = ", ": ") + '"' + mark(some(pick(hexa, 40), pick(hexa, 32), pick(hexa, 64), mixed(20, 44))) + '"',
        lambda: some("password", "passwd", "secret", "token", "api_key") + some(" = ", ": ", "=", " := ", " =") + some('"{}"', "{}").format(mark(some(bare(8, 30), phrase()))), lambda: mark(some(*PREFIXES[:10]) + bare(16, 37)),
        lambda: some("Authorization: Bearer ", "bearer ", "Authorization: bearer ") + mark(some(mixed(24, 60), bare(20, 44))), lambda: "export " + some("AWS_SECRET_ACCESS_KEY", "API_KEY", "DB_PASSWORD", "AUTH_TOKEN") + "=" + mark(mixed(16, 40)),
        lambda: names() + some(": ", " = ", "=", " =", " := ") + mark(some(phrase(), bare(10, 24), mixed(12, 30))), lambda: some("my ", "the ", "") + some("password", "token", "passphrase") + some(" is ", " is: ") + mark(some(bare(10, 24), phrase(), mixed(10, 24))),
    ]
    plain = [
        card, lambda: ".".join(str(rng.integers(1, 255)) for _ in range(4)), lambda: word() + "." + pick(dig, 2) + "@mail" + pick(dig, 1) + ".example.com", lambda: word() + "@" + word() + ".org", lambda: some("+1 (547) ", "+49 30 ") + "555-" + pick(dig, 4),
        lambda: some("commit ", "sha1: ", "rev ", "", "md5 ") + pick(hexa, int(some(32, 40))), lambda: some("id: ", "uuid=", "") + "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: "sha256:" + pick(hexa, 64), lambda: "https://www." + word() + ".com/" + word() + "/" + pick(dig, 5),
        lambda: f"20{pick(dig, 2)}-0{pick('123456789', 1)}-1{pick(dig, 1)}T1{pick(dig, 1)}:{pick('12345', 1)}0:00Z", lambda: word() + "_" + word() + pick(dig, 2), lambda: word() + word().title() + word().title() + pick(dig, 1), lambda: "version=" + pick(dig, 1) + "." + pick(dig, 2) + "." + pick(dig, 4), lambda: word() + "/" + word() + "/" + word() + pick(dig, 3) + ".html",
        lambda: some("password", "token", "secret", "api_key") + "=" + some("changeme123", "your_token_here1", "<your-key-1>", "example123456", "xxxxxxxxxxxx1", "${DB_PASSWORD1}", "0000000000"), lambda: "ISBN 978-" + pick(dig, 1) + "-" + pick(dig, 2) + "-" + pick(dig, 6) + "-" + pick(dig, 1), lambda: "order=" + pick(dig, 12), lambda: word() + "=" + word() + pick(dig, 1) + word(), lambda: word().upper() + pick(dig, 3) + word().upper(), lambda: word() + "***" + pick(dig, 2) + word(), lambda: word() * 3 + pick(dig, 2),
        lambda: some("password", "secret", "token", "auth", "key", "api_key") + some(": ", " = ", ":") + some(longer(), longer().title(), longer() + "_" + word(), "changeme", "<your-key>", "undefined", "xxxxxxxxxx"), lambda: some("sk-", "npm_", "pypi-", "hf_", "SG.", "eyJ") + longer() + some("-", "_", "") + word(),
        lambda: some("password", "token", "secret", "bearer", "passphrase") + some(" is ", " ") + longer(), lambda: names() + some(": ", " = ") + some(longer(), longer() + "_" + word(), longer().title()), lambda: some("author: ", "tokens: ", "keywords: ") + some(longer(), longer().title()),
    ]
    out = []
    for i in range(n):
        made = some(*(secret if i % 2 else plain))()
        text = " ".join([word() for _ in range(rng.integers(0, 4))] + [made] + [word() for _ in range(rng.integers(0, 4))])
        start, end = text.find("\x01"), text.find("\x02") - 1
        out.append((text.replace("\x01", "").replace("\x02", ""), some("src" + pick(dig, 1), "web", "app/config", "docs/example", "test/data"), ((start, end),) if i % 2 else ()))
    return out


@dataclass
class Model:
    known: Knowledge
    forest: Forest


def train(texts: list[str], findings: list[Finding] | None = None) -> Model:
    """A model with the dictionary of ``texts``, trained on labelled findings: (text, path, where its secrets start and end)."""
    return teach(learn_words(texts), findings)


def teach(known: Knowledge, findings: list[Finding] | None = None) -> Model:
    """A model with this dictionary, trained on labelled findings (places count code points).

    A candidate is a secret if it overlaps one; names and other words beside it aren't.
    """
    x, y = [], []
    for text, path, spans in findings if findings is not None else labelled_findings(known):
        raw = np.frombuffer(text.encode(), np.uint8)
        places = [(len(text[:a].encode()), len(text[:b].encode())) for a, b in spans]
        for c in candidates(raw, np.array([0, len(raw)])):
            x.append(describe(known, c, path))
            y.append(any(c.start < b and a < c.end for a, b in places))
    return Model(known, grow_forest(np.array(x), np.array(y, float)) if x else Forest([]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = (t for batch in batches for t in batch.column(0).to_pylist() if t)
    for parts in count_words(texts):
        for pair, part in enumerate(parts):
            yield pa.RecordBatch.from_arrays([pa.array([bool(pair)] * len(part), pa.bool_()), pa.array(list(part), pa.string()), pa.array(list(part.values()), pa.int64())], names=["pair", "item", "n"])


def know(df: DataFrame, text: str = "text") -> Knowledge:
    """What ``learn_words`` learns, over all whole texts of ``df``: words and pairs are counted where the texts lie.

    The driver gets the dictionary, of at most 1 / SHARE words, and the pairs above the least log-probability,
    of which a character begins no more than 400.  Null and empty texts have no words, rows that repeat a text count each;
    an empty table gives an empty dictionary.
    """
    parts = df.select(F.col(text).cast("string").alias("text")).mapInArrow(_counts, "pair boolean, item string, n long")
    counts = cut(parts.groupBy("pair", "item").agg(F.sum("n").alias("n")))
    words = counts.filter(~F.col("pair"))
    least = max(COMMON, SHARE * (words.agg(F.sum("n")).first()[0] or 0))
    words = words.filter(F.length("item") >= 3)
    pairs = counts.filter("pair").withColumn("first", F.substring("item", 1, 1))
    firsts = pairs.groupBy("first").agg(F.sum("n").alias("all"))
    usual = pairs.join(firsts, "first").filter((F.col("n") + 0.5) / (F.col("all") + 20.0) > 0.5 / 200.0)
    moves = {r["item"]: m for r in usual.collect() if (m := _move(r["n"], r["all"])) > _RARE}
    return Knowledge(frozenset(r["item"] for r in words.filter(F.col("n") >= least).select("item").collect()), moves, _RARE)


def fit(df: DataFrame, text: str = "text") -> Model:
    """A model whose dictionary and transitions come from all whole texts; see ``know`` for odd ones."""
    return teach(know(df, text))


def scan_chunk(model: Model, data: np.ndarray, off: np.ndarray, paths: list[str]) -> list[tuple[int, int, int, str, float]]:
    """(row, start byte, end byte, kind, score) of every candidate of a chunk, in order."""
    found = candidates(data, off)
    scores = model.forest.predict(np.array([describe(model.known, c, paths[c.row]) for c in found])) if found else []
    out = [(c.row, c.start, c.end, "assigned" if c.name else "prefixed" if c.value.startswith(PREFIXES) else "token", float(s)) for c, s in zip(found, scores, strict=True)]
    raw = data.tobytes()
    blocks = []
    if b"PRIVATE KEY-----" in raw:
        for r, (a, b) in enumerate(zip(off.tolist(), off[1:].tolist(), strict=False)):
            blocks += [(r, m.start(), m.end(), "private key", 1.0) for m in _PEM.finditer(raw, a, b)]
    if blocks:  # they are apart and in order; candidates within go
        starts, ends = (np.array([k[i] for k in blocks]) for i in (1, 2))
        at = np.searchsorted(starts, [o[1] for o in out], "right") - 1
        out = [o for o, i in zip(out, at, strict=True) if i < 0 or o[1] >= ends[i]]
    return sorted(out + blocks)


def _scan(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, texts, paths = batch.column(0), batch.column(1), [p or "" for p in batch.column(2).to_pylist()]
            for a, b, data, off in W.chunks(texts):
                found = scan_chunk(model, data, off, paths[a:b])
                if not found:
                    continue
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
                row, x, y = (np.array([f[i] for f in found], np.int64) for i in range(3))
                base = chars[off[row]]
                yield pa.RecordBatch.from_arrays([key.take(pa.array(row + a)), pa.array(chars[x] - base), pa.array(chars[y] - base), pa.array([f[3] for f in found]), pa.array([f[4] for f in found])], names=["key", "start", "end", "kind", "score"])

    return run


def scan(df: DataFrame, model: Model, path: Column, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, start, end, kind, score, is_secret): every candidate of every whole text, with the forest's verdict.

    ``start`` and ``end`` count code points; the value itself is not returned.  A null or empty
    text has no candidates, a null path is an empty one; repeated rows repeat theirs.  An empty table gives none.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), path.cast("string").alias("path"))
    out = rows.mapInArrow(_scan(model), f"key {dict(rows.dtypes)['key']}, start long, end long, kind string, score double")
    return out.select(F.col("key").alias(key), "start", "end", "kind", "score", (F.col("score") >= threshold).alias("is_secret"))


def _redact(model: Model, threshold: float, mask: str, names: list[str]):
    body, path, clean = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, paths = batch.column(body), [p or "" for p in batch.column(path).to_pylist()]
            out = texts.to_pylist()
            for a, b, data, off in W.chunks(texts):
                edits: dict[int, list[tuple[int, int]]] = {}
                for r, x, y, _, s in scan_chunk(model, data, off, paths[a:b]):
                    if s >= threshold:
                        edits.setdefault(r, []).append((x, y))
                for r, spans in edits.items():
                    at, parts = int(off[r]), []
                    for x, y in spans:
                        parts += [data[at:x].tobytes(), mask.encode()]
                        at = y
                    out[a + r] = (b"".join(parts) + data[at : off[r + 1]].tobytes()).decode("utf-8", "replace")
            same = [c for c in batch.schema.names if c not in (body, path)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), pa.array(out, pa.string())], names=[*same, clean])

    return run


def redact(df: DataFrame, model: Model, path: Column, text: str = "text", threshold: float = 0.5, mask: str = MASK) -> DataFrame:
    """``df`` with every secret of its texts replaced by ``mask``; rows and other columns stay as they are.

    A null or empty text stays null or empty, a null path is an empty one, repeated rows are treated alike; of findings
    that overlap a private key's block the block alone is replaced.  An empty table gives an empty result.
    """
    names = inner(df, "body", "path", "clean")
    rows = df.withColumns({names[0]: F.col(text).cast("string"), names[1]: path.cast("string")}).drop(text)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name not in names)
    done = rows.mapInArrow(_redact(model, threshold, mask, names), f"{kinds}`{names[2]}` string")
    return done.select(*[F.col(names[2]).alias(text) if c == text else F.col(f"`{c}`") for c in df.columns])
