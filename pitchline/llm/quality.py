"""Operator 7: quality by hierarchical empirical Bayes.

A document classifier (logistic regression on surface features of the whole text) gives each
document's evidence, the log-odds of good over poor beyond the training share.  Sites add to it:
a host's share of good documents is shrunk toward the global prior, a path's share toward its
host's, each by a strength that is estimated from how much the shares of hosts (of paths within a
host) really vary.  A document's own evidence is left out of its path's share.  The posterior is
the path's prior log-odds plus the document's evidence.

Site sums are grouped aggregations over a narrow table (key, host, path, probability); rows are
combined before they are shuffled, so a hot host costs no more than its share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .storage import inner, table

#: Bound of the labelled rows that the classifier is fitted to.
MAX_LABELLED = 20_000
RIDGE, STEPS = 1e-2, 30
#: Rows up to which the table of paths (about 100 bytes a row) is broadcast.
BROADCAST_PATHS = 50_000
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b".,;:'\"-()", b"|", b"#$%&*@^~<>{}[]=+_/\\", b"\n"]
_LOOK = np.full(256, len(_CLASSES), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _LOOK[list(_c)] = _i
WIDTH = 2 * 14 + 1


def features(texts: pa.Array) -> np.ndarray:
    """A row of WIDTH figures for every text; texts without words have zeros but for the last, which is 1."""
    out = []
    for a, b, data, off in W.chunks(texts):
        h, first = W.words(data, off)
        n = np.diff(first)
        row = np.repeat(np.arange(b - a), n)
        kind = _LOOK[data]
        share = []
        for k in range(len(_CLASSES) + 1):
            upto = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
            share.append((upto[off[1:]] - upto[off[:-1]]) / np.maximum(np.diff(off), 1))
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        again = np.bincount(row, same, b - a) / np.maximum(n, 1)
        distinct, top = np.zeros(b - a), np.zeros(b - a)
        for i in np.flatnonzero(n):
            _, c = np.unique(h[first[i] : first[i + 1]], return_counts=True)
            distinct[i], top[i] = len(c) / n[i], c.max() / n[i]
        length = np.diff(off) / np.maximum(n, 1)
        x = np.stack([*share, again, distinct, top, np.log1p(n), np.log1p(length)], axis=1)
        x = np.concatenate([x, np.log(x + 1e-3), np.zeros((b - a, 1))], axis=1)
        x[n == 0] = 0.0
        x[n == 0, -1] = 1.0
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, WIDTH))


@dataclass
class Model:
    """Standardised logistic regression, and the share of good rows that it was fitted to."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    share: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good over poor beyond the training share; 0 for texts without words."""
        z = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1) @ self.weight
        return np.where(x[:, -1] > 0, 0.0, np.clip(z - np.log(self.share / (1 - self.share)), -30, 30))


def train(x: np.ndarray, good: np.ndarray) -> Model:
    """Ridge-penalised logistic regression by Newton steps."""
    n = len(x)
    share = float(np.clip((good.sum() + 1) / (n + 2), 0.01, 0.99))
    if n == 0 or good.min() == good.max():
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.append(np.zeros(WIDTH), np.log(share / (1 - share))), share)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.concatenate([(x - mean) / scale, np.ones((n, 1))], axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), RIDGE * n / 100)
    penalty[-1] = 1e-9
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (good - p) - penalty * w)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w, share)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float64()))], names=["key", "x"])


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_LABELLED) -> Model:
    """Fits the classifier to labelled rows: if there are more than ``max_rows``, to those with the smallest key hashes.

    Only the sample's features reach the driver.  Texts meet their labels by a hash join of the sample's keys.
    Labels without a key or value don't count, and of repeated keys one does; null and empty texts are texts without
    features; documents that repeat a key count each.  Without a labelled row the classifier is even.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), (F.col(label) > 0).cast("int").alias("good")).dropDuplicates(["key"])
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    near = F.broadcast(known) if n <= 10 * max_rows else known  # at most max_rows of 12 bytes stay in the sample
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(near, "key", "left_semi")
    kind = dict(rows.dtypes)["key"]
    got = rows.mapInArrow(_featured, f"key {kind}, x array<double>").join(near, "key").select("x", "good").toArrow()
    if not got.num_rows:
        return train(np.zeros((0, WIDTH)), np.zeros(0))
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
    order = np.lexsort(x.T[::-1])  # the same fit whatever the order of the rows
    return train(x[order], got.column("good").to_numpy().astype(float)[order])


def _evidence(model: Model, body: str, out: str, drop: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = model.evidence(features(batch.column(body)))
                keep = [c for c in batch.schema.names if not (drop and c == body)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(z)], names=[*keep, out])

    return run


def with_evidence(df: DataFrame, model: Model, body: str, out: str, drop: bool) -> DataFrame:
    """``df`` with ``out``, the evidence of each text of the string column ``body``; ``drop`` leaves that column out."""
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if not (drop and f.name == body))
    return df.mapInArrow(_evidence(model, body, out, drop), f"{kinds}`{out}` double")


def site_priors(narrow: DataFrame, share: float) -> DataFrame:
    """(host, path, prior sum a, prior weight n): a path's pseudo-count of good documents and of all, and its own sums.

    ``narrow``: (host, path, p).  A host's share is shrunk toward the global one, a path's toward its host's.  The
    strength is that of a beta distribution with the variance found between shares beyond chance.
    """
    path = narrow.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n"))
    host = path.groupBy(F.col("host").alias("hk")).agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    t = host.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n"), F.sum(F.col("hs") ** 2 / F.col("hn")).alias("q"), F.sum(F.col("hn") ** 2).alias("nn"), F.count("*").alias("k")).first()
    mean = (t["s"] or 0) / t["n"] if t["n"] else share
    mean = min(max(mean, 1e-3), 1 - 1e-3)

    def strength(q: float, centre: float, n: float, groups: int, nn: float) -> float:
        # between-group variance by moments: q is the sum of n_i * share_i ** 2, centre what chance leaves of it
        spread = (q - centre - (groups - 1) * mean * (1 - mean)) / max(n - nn / max(n, 1), 1e-9)
        return float(min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 1.0), 1e4))

    k_host = strength(t["q"] or 0, mean * (t["s"] or 0), t["n"] or 0, t["k"] or 1, t["nn"] or 0) if t["n"] else 1e4
    both = path.join(host, F.col("host").eqNullSafe(F.col("hk"))).select("host", "path", "s", "n", "hs", "hn")
    both = both.withColumn("h", (F.col("hs") + k_host * mean) / (F.col("hn") + k_host))
    u = both.agg(F.sum((F.col("s") / F.col("n") - F.col("hs") / F.col("hn")) ** 2 * F.col("n")).alias("q"), F.sum("n").alias("n"), F.count("*").alias("k"), F.countDistinct(F.coalesce(F.concat(F.lit("h"), "host"), F.lit("n"))).alias("hosts"), F.sum(F.col("n") ** 2 / F.col("hn")).alias("nn")).first()
    spare = (u["k"] or 0) - (u["hosts"] or 0)
    k_path = strength(u["q"] or 0, 0.0, u["n"] or 0, spare + 1, 0.0) if u["n"] and spare > 0 else 1e4
    return both.select("host", "path", F.col("s"), F.col("n"), (F.col("h") * k_path).alias("prior_good"), F.lit(k_path).alias("prior_n"), F.col("h").alias("host_share"))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def score(df: DataFrame, model: Model, host: Column, path: Column, text: str = "text", threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``df`` with ``evidence``, ``host_share``, ``path_share``, ``quality`` (the posterior, 0 to 1) and ``keep``.

    Texts that are null or have no words have no evidence: their quality is their path's share.  Null hosts and
    paths are sites of their own.  Every row is scored, repeated ones too; an empty table gives none.
    Columns of ``df`` with the added names are replaced.  The evidence is computed once, for a table of all
    columns; without ``keep_text`` that table, and the result, leave the text out.
    """
    added = ["evidence", "host_share", "path_share", "quality", "keep"]
    base = df.drop(*added)
    prior = float(np.log(model.share / (1 - model.share)))
    ev, hc, pc, bc, *site = inner(base, "evidence", "host", "path", "body", "sh", "sp", "ss", "sn", "sg", "sw", "hs", "share", "quality")
    sh, sp, ss, sn, sg, sw, hs, sc, qc = site
    to_p = 1 / (1 + F.exp(-(F.col(ev) + prior)))
    names = {hc: host.cast("string"), pc: path.cast("string")}
    rows, body = base.withColumns(names), text
    if dict(base.dtypes)[text] != "string":
        rows, body = rows.withColumn(bc, F.col(text).cast("string")), bc
    rows = rows if keep_text or body == text else rows.drop(text)
    rows = table(with_evidence(rows, model, body, ev, body == bc or not keep_text))
    base = base if keep_text else base.drop(text)
    narrow = rows.select(F.col(hc).alias("host"), F.col(pc).alias("path"), to_p.alias("p"))
    sites = table(site_priors(narrow, model.share))
    small = sites.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS
    sites = sites.select(*[F.col(c).alias(n) for c, n in (("host", sh), ("path", sp), ("s", ss), ("n", sn), ("prior_good", sg), ("prior_n", sw), ("host_share", hs))])
    rows = rows.join(F.broadcast(sites) if small else sites, F.col(hc).eqNullSafe(F.col(sh)) & F.col(pc).eqNullSafe(F.col(sp)), "left")
    share = (F.col(sg) + F.col(ss) - to_p) / (F.col(sw) + F.col(sn) - 1)
    quality = 1 / (1 + F.exp(-(_logit(share) + F.col(ev))))
    rows = rows.withColumns({sc: share, qc: quality})
    return rows.select(*[F.col(f"`{c}`") for c in base.columns], F.col(ev).alias("evidence"), F.col(hs).alias("host_share"), F.col(sc).alias("path_share"), F.col(qc).alias("quality"), (F.col(qc) >= threshold).alias("keep"))
