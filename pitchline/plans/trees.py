"""Trees grown from histograms: a bagged forest and one-versus-rest boosting of all classes at once.

Rows are coded once, a feature's value as the number of its edges below it, and held in blocks of bytes.  A level of the trees
is one Spark job: tasks sum the histograms of their blocks, and splits are chosen from the sums.  The rules are those of
Spark ML's classifiers (gini and variance gains, log loss, weights of trees, random features a node, bags a tree); a
level costs one pass for all trees and classes, where Spark ML's boosting makes one for each class and descends every tree a row at a time.
Draws go by seed, tree and block.  Targets of boosting are rounded to 2 ** -18, so that sums are whole numbers and don't depend on their order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut

#: Rows of a block and, about, of a task at most; trees of a forest grown side by side; rounds of boosting between two cuts of the lineage.
BLOCK, TASK, TOGETHER, CUT_EVERY = 32_768, 2_000_000, 100, 10
#: A row's weight in boosting: 2 ** SHIFT for its count plus its target in units of 2 ** -DIGITS.  BLOCK rows fit a double's 53 bits.
SHIFT, DIGITS = 37, 18
_DRAWS = 65_536
#: How often a bag holds a row, by a draw of 16 bits: Poisson with mean 1.
_POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(_DRAWS) + 0.5) / _DRAWS).astype(np.uint8)


def _draws(n: int, *key: int) -> np.ndarray:
    return np.random.default_rng(key).integers(0, _DRAWS, n, dtype=np.uint16)


def _few(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[pa.RecordBatch]:
    """(feature, value): the distinct values of features that have ``most`` at most; others have one row without a value."""
    seen: list[np.ndarray | None] = [np.empty(0)] * width
    for b in batches:
        x = _matrix(b, width)
        for i, s in enumerate(seen):
            if s is not None:
                both = np.union1d(s, x[:, i])
                seen[i] = both if len(both) <= most else None
    rows = [(i, v) for i, s in enumerate(seen) for v in ([None] if s is None else s.tolist())]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64())], names=["feature", "value"])


def _matrix(b: pa.RecordBatch, width: int) -> np.ndarray:
    return b.column(b.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Each value's number of edges below it, a row a feature."""
    return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)]).astype(np.uint8)


def edges_of(df: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Each feature's edges, from all rows: between all values where there are few, else its approximate quantiles."""
    few = df.select("x").mapInArrow(partial(_few, width=width, most=bins), "feature int, value double").distinct().collect()
    values = [[r["value"] for r in few if r["feature"] == i] for i in range(width)]
    many = [i for i, v in enumerate(values) if None in v or len(v) > bins]
    cols = df.select(*[F.col("x")[i].alias(f"f{i}") for i in many])
    quantiles = dict(zip(many, cols.approxQuantile(cols.columns, [k / bins for k in range(1, bins)], 0.05 / bins), strict=True)) if many else {}
    return [np.unique(quantiles[i]) if i in quantiles else (v := np.sort(values[i]))[:-1] + np.diff(v) / 2 for i in range(width)]


_BLOCKS = "block long, n int, codes binary, y binary, score binary"


def _blocks(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray], classes: int) -> Iterator[pa.RecordBatch]:
    part, number, held, ys, n = TaskContext.get().partitionId(), 0, [], [], 0

    def block() -> pa.RecordBatch:
        codes, y = np.concatenate(held, axis=1), np.concatenate(ys).astype(np.uint8)
        return _table([(part * 2**20 + number, len(y), codes.tobytes(), y.tobytes(), bytes(8 * classes * len(y)))])

    for b in batches:
        x, y = _matrix(b, len(edges)), b.column(b.schema.get_field_index("label")).to_numpy()
        for at in range(0, len(y), BLOCK):
            if n + len(y[at : at + BLOCK]) > BLOCK:
                yield block()
                number, held, ys, n = number + 1, [], [], 0
            held.append(_codes(x[at : at + BLOCK], edges))
            ys.append(y[at : at + BLOCK])
            n += len(ys[-1])
    if n:
        yield block()


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["block", "n", "codes", "y", "score"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, n, codes, y, score) of each block, without copying them."""
    for b in batches:
        ids, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
        for i, (block, n) in enumerate(zip(ids, sizes, strict=True)):
            raw = [np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in ((2, np.uint8), (3, np.uint8), (4, np.float64))]
            yield block, n, *raw


class Coded:
    """Training rows in blocks, dealt evenly over tasks; estimators with the same ``bins`` may share them."""

    def __init__(self, df: DataFrame, bins: int) -> None:
        first = df.agg(F.count("*").alias("n"), F.max("label").alias("top")).first()
        self.n, self.classes = first["n"], int(first["top"]) + 1
        self.width = len(df.select("features").first()[0])
        rows = df.select("label", vector_to_array("features").alias("x"))
        self.edges = edges_of(rows, self.width, bins)
        made = rows.mapInArrow(partial(_blocks, edges=self.edges, classes=self.classes), _BLOCKS)
        tasks = max(1, min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(self.n / BLOCK)), math.ceil(self.n / TASK))
        self.blocks = made.repartition(tasks).persist()


class Tree:
    """Nodes as in a heap: feature (-1: a leaf), the highest code that goes left, and what a row of the node gets."""

    def __init__(self, depth: int, outputs: int) -> None:
        n = 2 ** (depth + 1) - 1
        self.depth, self.feature, self.code, self.value, self.gain = depth, np.full(n, -1, np.intp), np.full(n, 255, np.uint8), np.zeros((n, outputs)), np.zeros(n)

    def split(self, node: int, feature: int, code: int, gain: float, left, right) -> None:
        self.feature[node], self.code[node], self.gain[node] = feature, code, gain
        self.value[2 * node + 1], self.value[2 * node + 2] = left, right

    def settle(self) -> Tree:
        """Rows of a leaf go on to the left; its children get what it gets."""
        for node in range(2**self.depth - 1):
            if self.feature[node] < 0:
                self.value[2 * node + 1] = self.value[2 * node + 2] = self.value[node]
        return self

    def descend(self, codes: np.ndarray, start: np.ndarray, step: int, levels: int) -> np.ndarray:
        """The node of each row that many levels down; a row's code of feature f is at ``start + f * step``."""
        node, feature = np.zeros(len(start), np.intp), np.maximum(self.feature, 0)
        for _ in range(levels):
            right = codes.take(start + feature.take(node) * step) > self.code.take(node)
            node = 2 * node + 1 + right
        return node


def _boosting_sums(batches: Iterator[pa.RecordBatch], trees: list[Tree], level: int, slots: list[np.ndarray], first: bool, width: int, bins: int, share: float, key: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(k, sums): counts and sums of targets of each class' asked nodes by feature and bin; ``slots``: a node's place in them or -1."""
    total = [np.zeros((width, int(s.max()) + 1, bins, 2), np.int64) for s in slots]
    for block, n, codes, y, score in _each(batches):
        by_feature, start = codes.reshape(width, n), np.arange(n)
        bag = _draws(n, *key, block) < share * _DRAWS
        jobs = []
        for k, (tree, slot, sums) in enumerate(zip(trees, slots, total, strict=True)):
            if not sums.size:
                continue
            sign = np.where(y == k, 1.0, -1.0)
            target = sign if first else 4 * sign / (1 + np.exp(2 * sign * score[k * n : k * n + n]))
            weight = 2.0**SHIFT + np.rint(target * 2**DIGITS)
            if level:
                place = slot.take(tree.descend(codes, start, n, level))
                chosen = np.flatnonzero(bag & (place >= 0))
                jobs.append((sums, chosen, place[chosen] * bins, weight[chosen]))
            else:
                jobs.append((sums, None, 0, np.where(bag, weight, 0.0)))
        for f in range(width):
            whole = None if level else by_feature[f].astype(np.intp)
            for sums, chosen, base, weight in jobs:
                at = whole if chosen is None else by_feature[f].take(chosen) + base
                both = np.bincount(at, weight, sums.shape[1] * bins)
                count = np.rint(both / 2.0**SHIFT)
                sums[f, :, :, 0] += count.astype(np.int64).reshape(-1, bins)
                sums[f, :, :, 1] += (both - count * 2.0**SHIFT).astype(np.int64).reshape(-1, bins)
    rows = [(k, s.tobytes()) for k, s in enumerate(total) if s.size]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["k", "sums"])


def _rescored(batches: Iterator[pa.RecordBatch], trees: list[Tree], weight: float) -> Iterator[pa.RecordBatch]:
    for block, n, codes, y, score in _each(batches):
        start = np.arange(n)
        new = np.concatenate([score[k * n : k * n + n] + weight * t.value[t.descend(codes, start, n, t.depth), 0] for k, t in enumerate(trees)])
        yield _table([(block, n, codes.tobytes(), y.tobytes(), new.tobytes())])


@dataclass
class Boosting:
    """One-versus-rest boosting with log loss, as Spark ML's GBTClassifier within OneVsRest; all classes share a pass."""

    rounds: int
    depth: int
    bins: int
    step: float = 0.05
    share: float = 0.8
    seed: int = 42

    def fit(self, df: DataFrame, data: Coded | None = None) -> TreesModel:
        data = data or Coded(df, self.bins)
        blocks, old, grown = data.blocks, [], []
        for m in range(self.rounds):
            trees = self._round(blocks, data, m)
            for b in old:
                b.unpersist()
            grown.append(trees)
            if m + 1 < self.rounds:
                new = blocks.mapInArrow(partial(_rescored, trees=trees, weight=self.step if m else 1.0), _BLOCKS)
                old, blocks = [blocks] if m else [], (cut(new) if (m + 1) % CUT_EVERY == 0 else new).persist()
        if blocks is not data.blocks:
            blocks.unpersist()
        weights = [1.0] + [self.step] * (self.rounds - 1)
        return TreesModel("boosting", data.edges, [t for trees in grown for t in trees], data.classes, weights)

    def _round(self, blocks: DataFrame, data: Coded, m: int) -> list[Tree]:
        trees = [Tree(self.depth, 1) for _ in range(data.classes)]
        known: list[dict[int, np.ndarray]] = [{} for _ in trees]  # histograms of a level's nodes
        asked: list[list[int]] = [[0] for _ in trees]
        other: list[dict[int, tuple[int, int]]] = [{} for _ in trees]  # what a sibling's histogram follows from: (parent, sibling)
        for level in range(self.depth):
            slots = [np.full(2 ** (level + 1) - 1, -1, np.intp) for _ in trees]
            for slot, nodes in zip(slots, asked, strict=True):
                slot[nodes] = range(len(nodes))
            if not any(asked):
                break
            f = partial(_boosting_sums, trees=trees, level=level, slots=slots, first=m == 0, width=data.width, bins=self.bins, share=self.share, key=(self.seed, m))
            got = [0] * len(trees)
            for k, sums in blocks.mapInArrow(f, "k int, sums binary").collect():  # a row a task and class
                got[k] = got[k] + np.frombuffer(sums, np.int64).reshape(data.width, len(asked[k]), self.bins, 2)
            for k, tree in enumerate(trees):
                now = {node: got[k][:, i] for i, node in enumerate(asked[k])}
                now |= {node: known[k][parent] - now[sibling] for node, (parent, sibling) in other[k].items()}
                known[k], asked[k], other[k] = now, [], {}
                for node in sorted(now):
                    if level == 0:
                        n, s = now[0][0].sum(0)
                        tree.value[0] = s / max(n, 1) / 2**DIGITS
                    halves = self._split(tree, node, now[node])
                    if halves and level + 1 < self.depth:
                        left, right = 2 * node + 1, 2 * node + 2
                        less, more = (left, right) if halves[0] <= halves[1] else (right, left)
                        asked[k].append(less)
                        other[k][more] = node, less
        return [t.settle() for t in trees]

    @staticmethod
    def _split(tree: Tree, node: int, sums: np.ndarray) -> tuple[int, int] | None:
        """Splits the node where the squared deviation falls most; (rows left, right), or None."""
        below, whole = np.cumsum(sums, axis=1)[:, :-1].astype(float), sums[0].sum(0).astype(float)
        n, s = below[..., 0], below[..., 1] / 2**DIGITS
        rest_n, rest_s = whole[0] - n, whole[1] / 2**DIGITS - s
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((n >= 1) & (rest_n >= 1), s * s / n + rest_s * rest_s / rest_n, -np.inf)
        f, c = np.unravel_index(np.argmax(gain), gain.shape)
        won = gain[f, c] - (whole[1] / 2**DIGITS) ** 2 / max(whole[0], 1)
        if not won > 1e-9 * max(whole[0], 1):
            return None
        tree.split(node, int(f), int(c), float(won), s[f, c] / n[f, c], rest_s[f, c] / rest_n[f, c])
        return int(n[f, c]), int(rest_n[f, c])


@dataclass
class _Level:
    """What a task needs of a tree's level: the tree, each node's place among those still open, and the open ones' features."""

    tree: Tree
    slot: np.ndarray
    features: np.ndarray


def _forest_sums(batches: Iterator[pa.RecordBatch], levels: dict[int, _Level], level: int, width: int, bins: int, classes: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(tree, sums): bagged counts of each open node by its features, bins and classes."""
    cells = bins * classes
    total = {t: np.zeros((v.features.shape[1], len(v.features) * cells), np.int64) for t, v in levels.items()}
    for block, n, codes, y, _ in _each(batches):
        codes = np.ascontiguousarray(codes.reshape(width, n).T).ravel()  # all of a row's codes side by side
        for t, v in levels.items():
            times = _POISSON.take(_draws(n, seed, t, block))
            rows = np.flatnonzero(times)
            start = rows * width
            place = v.slot.take(v.tree.descend(codes, start, 1, level))
            if level:
                held = np.flatnonzero(place >= 0)
                rows, start, place = rows.take(held), start.take(held), place.take(held)
            at, weight = place * cells + y.take(rows), times.take(rows).astype(float)
            for sums, features in zip(total[t], v.features.T, strict=True):
                code = codes.take(start + np.ascontiguousarray(features).take(place)).astype(np.intp)
                sums += np.bincount(at + code * classes, weight, len(sums)).astype(np.int64)
    for t, sums in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([sums.astype(np.int32).tobytes()], pa.binary())], names=["tree", "sums"])  # a task's rows fit 32 bits


def _splitter(*told) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _forest_splits(table, *told)


def _forest_splits(table: pa.Table, levels: dict[int, _Level], bins: int, classes: int, least: int) -> pa.Table:
    """(tree, place, feature, code, gain, whole, left): each open node's best split by gini; without one the feature is -1."""
    t = table.column("tree")[0].as_py()
    v = levels[t]
    sums = sum(np.frombuffer(x.as_buffer(), np.int32).astype(np.int64) for x in table.column("sums")).reshape(v.features.shape[1], -1, bins, classes).swapaxes(0, 1)
    out = []
    for place in range(len(sums)):
        below, whole = np.cumsum(sums[place], axis=1)[:, :-1].astype(float), sums[place, 0].sum(0).astype(float)
        n, rest = below.sum(-1), (whole - below).sum(-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            pure = np.where((n >= least) & (rest >= least), (below**2).sum(-1) / n + ((whole - below) ** 2).sum(-1) / rest, -np.inf)
        f, c = np.unravel_index(np.argmax(pure), pure.shape)
        won = pure[f, c] - (whole**2).sum() / max(whole.sum(), 1)
        found = won > 1e-9 * max(whole.sum(), 1)
        out.append((t, place, int(v.features[place, f]) if found else -1, int(c), float(won) if found else 0.0, whole.tolist(), below[f, c].tolist()))
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=["tree", "place", "feature", "code", "gain", "whole", "left"])


@dataclass
class Forest:
    """A bagged forest by gini with random features a node, as Spark ML's RandomForestClassifier."""

    trees: int
    depth: int = 8
    least: int = 5
    bins: int = 32
    seed: int = 42

    def getNumTrees(self) -> int:  # noqa: N802  as Spark ML names it
        return self.trees

    def fit(self, df: DataFrame, data: Coded | None = None) -> TreesModel:
        data = data or Coded(df, self.bins)
        some = math.ceil(math.sqrt(data.width))
        grown: list[Tree] = []
        for first in range(0, self.trees, TOGETHER):
            trees = {t: Tree(self.depth, data.classes) for t in range(first, min(first + TOGETHER, self.trees))}
            open_ = {t: [0] for t in trees}
            for level in range(self.depth):
                levels = {}
                for t, nodes in open_.items():
                    slot = np.full(2 ** (level + 1) - 1, -1, np.intp)
                    slot[nodes] = range(len(nodes))
                    draw = [np.random.default_rng((self.seed, t, node, 1)).choice(data.width, some, replace=False) for node in nodes]
                    levels[t] = _Level(trees[t], slot, np.sort(np.array(draw, np.intp)))
                if not levels:
                    break
                sums = data.blocks.mapInArrow(partial(_forest_sums, levels=levels, level=level, width=data.width, bins=self.bins, classes=data.classes, seed=self.seed), "tree int, sums binary")
                best = sums.groupBy("tree").applyInArrow(_splitter(levels, self.bins, data.classes, self.least), "tree int, place int, feature int, code int, gain double, whole array<double>, left array<double>")
                after: dict[int, list[int]] = {}
                for t, place, feature, code, gain, whole, left in best.collect():  # a row an open node
                    node, whole, left = open_[t][place], np.array(whole), np.array(left)
                    if level == 0:
                        trees[t].value[0] = whole / max(whole.sum(), 1)
                    if feature >= 0:
                        right = whole - left
                        trees[t].split(node, feature, code, gain, left / left.sum(), right / right.sum())
                        mixed = [c for c, h in ((2 * node + 1, left), (2 * node + 2, right)) if (h > 0).sum() > 1]
                        after.setdefault(t, []).extend(mixed)
                open_ = {t: sorted(nodes) for t, nodes in after.items() if nodes}
            grown += [t.settle() for t in trees.values()]
        return TreesModel("forest", data.edges, grown, data.classes, [1.0])


def _scores(x: np.ndarray, kind: str, edges: list[np.ndarray], trees: list[Tree], classes: int, weights: list[float]) -> np.ndarray:
    """A row's probability of each class."""
    codes, n = _codes(x, edges).ravel(), len(x)
    start, out = np.arange(n), np.zeros((n, classes))
    for i, t in enumerate(trees):
        value = t.value[t.descend(codes, start, n, t.depth)]
        if kind == "forest":
            out += value
        else:
            out[:, i % classes] += weights[i // classes] * value[:, 0]
    out = out if kind == "forest" else 1 / (1 + np.exp(-2 * out))
    return out / out.sum(axis=1, keepdims=True)


def _predicted(batches: Iterator[pa.RecordBatch], **model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p = _scores(_matrix(b, len(model["edges"])), **model)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[b.schema.names[0], "p"])


@dataclass
class TreesModel:
    """Grown trees: of a forest one after the other, of boosting by round and class."""

    kind: str
    edges: list[np.ndarray]
    trees: list[Tree]
    classes: int
    weights: list[float]

    def probabilities(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, p): an array of each class' probability; ``rows`` has the key and features."""
        told = {"kind": self.kind, "edges": self.edges, "trees": self.trees, "classes": self.classes, "weights": self.weights}
        return rows.select(key, vector_to_array("features").alias("x")).mapInArrow(partial(_predicted, **told), f"`{key}` {dict(rows.dtypes)[key]}, p array<double>")

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  as Spark ML names it
        """Gains by feature, each tree's as shares, over all trees as shares."""
        if self.kind != "forest":
            raise AttributeError("featureImportances")
        total = np.zeros(len(self.edges))
        for t in self.trees:
            own = np.bincount(t.feature[t.feature >= 0], t.gain[t.feature >= 0], len(total))
            total += own / (own.sum() or 1.0)
        return Vectors.dense((total / (total.sum() or 1.0)).tolist())

    def write(self) -> TreesModel:
        return self

    def save(self, path: str) -> None:
        """A row a tree, and one of what holds for all."""
        spark = SparkSession.getActiveSession()
        rows = [(i, t.depth, t.feature.tolist(), t.code.tolist(), t.value.tolist(), t.gain.tolist()) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "i int, depth int, feature array<int>, code array<int>, value array<array<double>>, gain array<double>").coalesce(1).write.parquet(f"{path}/trees")
        spark.createDataFrame([(self.kind, [e.tolist() for e in self.edges], self.classes, self.weights)], "kind string, edges array<array<double>>, classes int, weights array<double>").coalesce(1).write.parquet(f"{path}/model")

    @classmethod
    def load(cls, path: str) -> TreesModel:
        spark = SparkSession.getActiveSession()
        trees = []
        for r in spark.read.parquet(f"{path}/trees").orderBy("i").collect():  # as many as were grown
            t = Tree(r["depth"], len(r["value"][0]))
            t.feature[:], t.code[:], t.value[:], t.gain[:] = r["feature"], r["code"], r["value"], r["gain"]
            trees.append(t)
        m = spark.read.parquet(f"{path}/model").first()
        return cls(m["kind"], [np.array(e) for e in m["edges"]], trees, m["classes"], m["weights"])
