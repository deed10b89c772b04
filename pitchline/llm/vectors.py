"""Operator 8: near-duplicate embeddings by PCA-ordered tiled comparison.

Unit vectors are rotated to the principal axes of their second moments, so that the leading
coordinates carry most of every product.  Tiles of vectors are compared by the product of the
leading coordinates first; what the rest can add is bounded by the product of the suffix
norms, and a pair is dropped as soon as its bound can't reach the threshold.  Only survivors
are finished, in double precision; those within rounding of the threshold are computed again
from the vectors as given.

Which tiles meet: a cosine of at least t means a distance of at most sqrt(2 - 2t), so on the two
axes of largest variance linked vectors lie in the same or adjacent cells of that width.  Cells
are split by hash into tiles of about ``TILE`` rows and only tiles of adjacent cells are paired.  A tile
goes to each of its pairs, so what is shuffled is the input times the tiles of neighbouring cells: few
where the leading axes tell vectors apart, all where vectors point everywhere alike.
A tile pair gives one row a vector (its number of links and the smallest vector connected in the
pair), never the pairs themselves, so groups of copies don't grow with their square.  Equal
vectors are one row with a count from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components
from .storage import cut

#: Rows of a tile, fewer if vectors have more than WIDE components; rows compared at once; leading components.
TILE, WIDE, BLOCK, LEAD = 16_384, 64, 1024, 16
#: Cosines this close to the threshold are computed again from the given vectors.
ROUNDING = 1e-7
#: Share of surviving pairs beyond which a block is finished by one matrix product.
DENSE = 0.02


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(batches):
    total = mean = None
    for batch in batches:
        if batch.num_rows:
            x = _unit(_matrix(pa.chunked_array([batch.column(0)])))
            total, mean = (x.T @ x, x.sum(axis=0)) if total is None else (total + x.T @ x, mean + x.sum(axis=0))
    if total is not None:
        flat = np.concatenate([total.ravel(), mean])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], names=["at", "s"])


def principal_axes(unit: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes as columns, by falling second moment, and each axis' variance; dim * (dim + 1) sums reach the driver."""
    sums = unit.select("v").mapInArrow(_moments, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    flat = np.zeros(dim * (dim + 1))
    for r in sums:
        flat[r["at"]] = r["s"]
    second, mean = flat[: dim * dim].reshape(dim, dim), flat[dim * dim :]
    value, axes = np.linalg.eigh(second)
    order = np.argsort(-value, kind="stable")
    axes = axes[:, order]
    n = max(np.trace(second), 1.0)
    return axes, value[order] / n - (mean @ axes / n) ** 2


def _cells(axes: np.ndarray, wide: np.ndarray, width: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(pa.chunked_array([batch.column("v")])))
                cell = np.floor(x @ axes[:, wide] / width).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "rep", "n", "v")), pa.array(cell[:, 0]), pa.array(cell[:, -1])], names=["h1", "h2", "rep", "n", "v", "c1", "c2"])

    return run


def _compare(axes: np.ndarray, threshold: float, lead: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("rep", "ascending")])
        raw = _matrix(group.column("v"))
        unit = _unit(raw)
        x = unit @ axes
        rest = np.sqrt(np.maximum((x[:, lead:] ** 2).sum(axis=1), 0)) + 1e-12
        n, side = group.column("n").to_numpy(), group.column("side").to_numpy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: a tile with itself
        own = bool((side == 2).any())
        links, label = np.zeros(len(n), np.int64), np.arange(len(n))
        for a in range(0, len(left), BLOCK):
            i = left[a : a + BLOCK]
            for b in range(a if own else 0, len(right), BLOCK):
                j = right[b : b + BLOCK]
                part = x[i, :lead] @ x[j, :lead].T
                alive = part + np.outer(rest[i], rest[j]) >= threshold - ROUNDING
                if own and a == b:
                    alive = np.triu(alive, 1)
                p, q = np.nonzero(alive)
                if not len(p):
                    continue
                if len(p) > DENSE * alive.size:
                    part += x[i, lead:] @ x[j, lead:].T
                    cos = part[p, q]
                else:
                    cos = part[p, q] + np.einsum("ij,ij->i", x[i[p], lead:], x[j[q], lead:])
                near = cos >= threshold - ROUNDING
                p, q, cos = i[p[near]], j[q[near]], cos[near]
                edge = np.flatnonzero(cos < threshold + ROUNDING)
                cos[edge] = np.einsum("ij,ij->i", unit[p[edge]], unit[q[edge]])
                p, q = p[cos >= threshold], q[cos >= threshold]
                links += np.bincount(p, n[q], len(n)).astype(np.int64) + np.bincount(q, n[p], len(n)).astype(np.int64)
                components.lower_labels(label, p, q)
        got = pa.array(links > 0)
        out = group.select(["h1", "h2", "rep"]).append_column("links", pa.array(links)).append_column("root", group.column("rep").take(pa.array(label)))
        return out.filter(got)

    return run


def _links(classes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(h1, h2, rep, links, root) of each class and tile pair, for the classes of one dimension."""
    axes, spread = principal_axes(classes, dim)
    width = float(np.sqrt(2 - 2 * threshold)) * (1 + 1e-9) + 1e-9
    kind = dict(classes.dtypes)["v"]
    rows = classes.mapInArrow(_cells(axes, np.argsort(-spread)[:2], width), f"h1 long, h2 long, rep long, n long, v {kind}, c1 int, c2 int")
    rows = cut(rows)
    tiles = rows.groupBy("c1", "c2").agg(F.ceil(F.count("*") / max(1, TILE * WIDE // max(dim, WIDE))).cast("int").alias("tiles"))
    rows = rows.join(tiles, ["c1", "c2"]).withColumn("k", F.pmod(F.xxhash64("h1", "h2"), F.col("tiles")).cast("int")).drop("tiles")
    each = tiles.select("c1", "c2", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("k"))
    around = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    first = each.select("c1", "c2", "k", F.explode(around).alias("d")).select(F.struct("c1", "c2", "k").alias("a"), (F.col("c1") + F.col("d.x")).alias("c1"), (F.col("c2") + F.col("d.y")).alias("c2"))
    pairs = first.join(each, ["c1", "c2"]).select("a", F.struct("c1", "c2", "k").alias("b")).filter("a <= b")
    same = F.col("a") == F.col("b")
    sides = pairs.select("a", "b", F.explode(F.when(same, F.array(F.struct(F.col("a").alias("t"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("t"), F.lit(0).alias("side")), F.struct(F.col("b").alias("t"), F.lit(1).alias("side"))))).alias("s"))
    sides = sides.select(F.xxhash64("a", "b").alias("p1"), F.col("s.t.c1").alias("c1"), F.col("s.t.c2").alias("c2"), F.col("s.t.k").alias("k"), F.col("s.side").alias("side"))
    lead = min(LEAD, dim)
    return rows.join(sides, ["c1", "c2", "k"]).select("p1", "side", "h1", "h2", "rep", "n", "v").groupBy("p1").applyInArrow(_compare(axes, threshold, lead), "h1 long, h2 long, rep long, links long, root long")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(key, n_links, component_id, kept) for every row; other columns are ignored.

    Two rows link if their cosine, in double precision, reaches ``threshold``.  A vector that is
    null, empty, zero or holds null or non-finite components links with nothing, as do vectors of
    different lengths.  n_links counts other rows, equal ones included; component_id is the
    smallest key reachable, itself included.  Rows that repeat a key stay rows of their own but are
    one node of the components.  A vector none of whose equals has a key isn't compared.
    An empty table gives an empty result.
    """
    elem = dict(df.dtypes)[vector]
    elem = elem if elem in ("array<float>", "array<double>") else "array<double>"
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(elem).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = cut(rows.withColumn("v", F.when(good, F.col("v"))).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(8), "v")}))
    classes = rows.filter("v is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = cut(classes)
    known = classes.filter("rep is not null")
    found = None
    for (dim,) in sorted(known.select(F.size("v")).distinct().collect()):
        one = _links(known.filter(F.size("v") == dim), dim, threshold)
        found = one if found is None else found.unionAll(one)
    plain = rows.select("id", "h1", "h2", F.col("v").isNotNull().alias("good"))
    of = classes.select("h1", "h2", "rep", "n")
    if found is not None:
        found = cut(found)
        comp = components.connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionAll(_same_key(rows, classes)))
        per = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
        of = of.join(per, ["h1", "h2"], "left").join(comp, F.col("rep") == F.col("node"), "left").drop("node")
    else:
        of = of.withColumns({"links": F.lit(0).cast("long"), "component": F.col("rep")})
    out = plain.join(of, ["h1", "h2"], "left")
    links = F.when(F.col("good"), F.coalesce("links", F.lit(0)) + F.col("n") - 1).otherwise(F.lit(0)).cast("long")
    component = F.when(F.col("good"), F.coalesce("component", "rep")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def _same_key(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes that rows with one key, but different vectors, fall into."""
    many = rows.filter("v is not null and id is not null").select("id", "h1", "h2").distinct()
    twice = many.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id")
    return many.join(twice, "id").join(classes, ["h1", "h2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
