"""Detectors as estimator and model pairs: fit on the healthy slice, score in one projection or one Arrow pass."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsewright.cluster import discard, materialise, ship
from pulsewright.operators.alerts import smooth
from pulsewright.operators.order_stats import medians, quantiles

#: Rows of a node that a task grows a tree from at most; larger nodes are split over the cluster first.
HELD_ROWS = 500_000
#: A row is in a tree's sample if a hash of its key and the tree is below the tree's share of this.
SHARES = 1 << 20


class Detector(Protocol):
    threshold: float

    def fit(self, healthy: DataFrame) -> Detector: ...

    def score(self, df: DataFrame, name: str = "score") -> DataFrame: ...


@dataclass
class ControlLimits:
    """Largest |z| over the features; nulls count as the mean. Pure SQL."""

    features: Sequence[str]
    sigma: float = 3.0
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def threshold(self) -> float:
        return self.sigma

    def limits_of(self, healthy: DataFrame) -> DataFrame:
        """One row with mu_<f> and sd_<f>; a vanishing deviation becomes 1e-3."""
        aggs = []
        for f in self.features:
            sd = F.stddev_samp(f)
            aggs += [F.avg(f).alias(f"mu_{f}"), F.when(sd < 1e-6, 1e-3).otherwise(sd).alias(f"sd_{f}")]
        return healthy.agg(*aggs)

    def fit(self, healthy: DataFrame) -> ControlLimits:
        if not self.features:
            self.limits = {}
            return self
        row = self.limits_of(healthy).first()
        self.limits = {f: (row[f"mu_{f}"], row[f"sd_{f}"]) for f in self.features if row[f"mu_{f}"] is not None}
        return self

    @staticmethod
    def excursion(features: Sequence[str], mu, sd) -> Column:
        z = [F.abs((F.coalesce(F.col(f), mu(f)) - mu(f)) / sd(f)) for f in features]
        return F.greatest(*z) if len(z) > 1 else z[0] if z else F.lit(0.0)

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        known = [f for f in self.features if f in self.limits]
        return df.withColumn(name, self.excursion(known, lambda f: F.lit(self.limits[f][0]), lambda f: F.lit(self.limits[f][1])))

    def to_json(self) -> str:
        return json.dumps({"kind": "control_limits", **asdict(self)})


def moments(healthy: DataFrame, features: Sequence[str]) -> tuple[list[float], list[float], list[float]]:
    """Medians, and means and deviations once they stand for nulls, over all rows; 0 for no median, 1 for a vanishing deviation."""
    rows = healthy.select(*[F.col(f).cast("double").alias(f) for f in features])
    found = medians(rows, features)
    fill = [found[f] if found[f] is not None else 0.0 for f in features]
    filled = rows.fillna(dict(zip(features, fill, strict=True)))
    row = filled.agg(*[F.avg(f).alias(f"a_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    return fill, [row[f"a_{f}"] or 0.0 for f in features], [row[f"s_{f}"] or 1.0 for f in features]


def _c(n: float) -> float:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


#: The arrays of a tree: feature (-1: a leaf), limit, left and right child, depth.
_KINDS = {"f": np.int16, "v": np.float64, "l": np.int32, "r": np.int32, "d": np.float64}
_GROWN = pa.schema([("tree", pa.int32()), ("node", pa.int64()), *[(k, pa.binary()) for k in _KINDS]])


@dataclass
class IsolationForest:
    """Trees of random splits on medians-imputed, standardised features; the score is 2**(-mean depth / c), less 0.5.

    Ranks anomalies as such forests do; not bit-equal to any other one's random numbers. Trees are
    arrays and score whole batches at once. Each tree sees the share max_samples of all
    training rows, drawn by a hash of the row's key and the tree, and is grown in a task of its own.
    A node of more than HELD_ROWS rows is split first by its extremes, which are an aggregate,
    so a task never holds more than a node; equal rows are a leaf at once.
    """

    features: Sequence[str]
    contamination: float = 0.01
    n_trees: int = 200
    max_samples: float = 0.8
    seed: int = 42
    threshold: float = 0.0
    fill: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    trees: list[dict] = field(default_factory=list)
    sample: int = 0

    def fit(self, healthy: DataFrame, keys: Sequence[str] = ("asset", "t"), held: int = HELD_ROWS) -> IsolationForest:
        columns = dict.fromkeys([*keys, *self.features])
        rows = materialise(healthy.select(*[F.col(c).cast("double").alias(c) if c in self.features else F.col(c) for c in columns]), "healthy")
        self.fill, self.mean, self.scale = moments(rows, self.features)
        self.grow(rows, keys, held)
        scored = quantiles(self.score(rows, "_score"), [], "_score", {"q": 1 - self.contamination}).first()
        self.threshold = float("nan") if scored.q is None else float(scored.q)
        discard(rows)
        return self

    def _random(self, tree: int, node: int) -> np.random.Generator:
        return np.random.default_rng([self.seed, tree, node])

    def grow(self, rows: DataFrame, keys: Sequence[str], held: int = HELD_ROWS) -> None:
        """Grow all trees from rows with keys and features. Nodes are numbered from 1, the children of k are 2 k and 2 k + 1."""
        ship(rows.sparkSession)
        n = rows.count()
        self.sample = max(1, int(n * self.max_samples))
        depth = int(np.ceil(np.log2(max(2, self.sample))))
        z = F.array(*[(F.coalesce(F.col(f), F.lit(m)) - mu) / sd for f, m, mu, sd in zip(self.features, self.fill, self.mean, self.scale, strict=True)])
        drawn = F.pmod(F.xxhash64(*keys, F.col("tree"), F.lit(self.seed)), F.lit(SHARES)) < int(self.max_samples * SHARES)
        each = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(self.n_trees - 1)))).filter(drawn).select("tree", z.alias("z"))
        splits: dict[tuple[int, int], tuple[int, float]] = {}
        leaves: dict[tuple[int, int], float] = {}
        while n > held:  # no node can be larger otherwise
            placed = self._placed(each, splits)
            ends = [x for i in range(len(self.features)) for x in (F.min(F.col("z")[i]).alias(f"lo{i}"), F.max(F.col("z")[i]).alias(f"hi{i}"))]
            large = [r for r in placed.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), *ends).filter(F.col("n") > held).collect() if (r.tree, r.node) not in leaves]
            if not large:
                break
            for r in large:
                level, rng = int(r.node).bit_length() - 1, self._random(r.tree, r.node)
                spread = [i for i in range(len(self.features)) if r[f"hi{i}"] > r[f"lo{i}"]]
                if level >= depth or not spread:
                    leaves[r.tree, r.node] = level + _c(r.n)
                else:
                    i = int(rng.choice(spread))
                    splits[r.tree, r.node] = i, float(rng.uniform(r[f"lo{i}"], r[f"hi{i}"]))
        placed = self._placed(each, splits)
        if leaves:
            done = rows.sparkSession.createDataFrame(list(leaves), "tree int, node long")
            placed = placed.join(F.broadcast(done), ["tree", "node"], "left_anti")

        def subtree(key: tuple, table: pa.Table) -> pa.Table:
            tree, node = key[0].as_py(), key[1].as_py()
            x = table.column("z").combine_chunks()
            x = x.flatten().to_numpy().reshape(len(x), -1)
            x = x[np.lexsort(x.T[::-1])]  # whatever order the rows came in
            own = self._grow(x, int(node).bit_length() - 1, depth, self._random(tree, node))
            return pa.table({"tree": [tree], "node": [node], **{k: [v.tobytes()] for k, v in own.items()}}, schema=_GROWN)

        grown = {(r.tree, r.node): {k: np.frombuffer(r[k], t) for k, t in _KINDS.items()} for r in placed.groupBy("tree", "node").applyInArrow(subtree, "tree int, node long, f binary, v binary, l binary, r binary, d binary").collect()}
        self.__dict__.pop("_whole", None)
        self.trees = [self._joined(t, splits, leaves, grown) for t in range(self.n_trees)]

    def _placed(self, each: DataFrame, splits: dict) -> DataFrame:
        """tree, z and the node that the row has come to, by the splits so far (a small table: a node has over HELD_ROWS rows)."""
        if not splits:
            return each.withColumn("node", F.lit(1).cast("long"))
        by_tree: dict[int, list] = {}
        for (t, node), (i, v) in splits.items():
            by_tree.setdefault(t, []).append((node, i, v))
        table = each.sparkSession.createDataFrame(list(by_tree.items()), "tree int, s array<struct<node:long,i:int,v:double>>")
        known = table.select("tree", F.map_from_entries(F.transform("s", lambda x: F.struct(x["node"], F.struct(x["i"], x["v"])))).alias("_s"))
        levels = max(int(node).bit_length() for _, node in splits)

        def down(node: Column, _: Column) -> Column:
            s = F.try_element_at("_s", node)
            return F.when(s.isNull(), node).otherwise(2 * node + (F.get("z", s["i"]) >= s["v"]).cast("long"))

        placed = each.join(F.broadcast(known), "tree", "left")
        return placed.withColumn("node", F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(1).cast("long"), down)).drop("_s")

    def _joined(self, tree: int, splits: dict, leaves: dict, grown: dict) -> dict:
        """One tree's arrays from the nodes that were split over the cluster and the subtrees below them."""
        out: dict[str, list] = {k: [] for k in _KINDS}

        def add(node: int) -> int:
            at = len(out["f"])
            if (tree, node) in splits:
                f, v = splits[tree, node]
                for k, x in zip(_KINDS, (f, v, at, at, 0.0), strict=True):
                    out[k].append(x)
                out["l"][at], out["r"][at] = add(2 * node), add(2 * node + 1)
            elif (tree, node) in grown:
                own = grown[tree, node]
                for k in _KINDS:
                    out[k].extend((own[k] + at if k in "lr" else own[k]).tolist())
            else:  # equal rows, or none
                for k, x in zip(_KINDS, (-1, 0.0, at, at, leaves.get((tree, node), float(node.bit_length() - 1))), strict=True):
                    out[k].append(x)
            return at

        add(1)
        return {k: np.array(v, _KINDS[k]) for k, v in out.items()}

    @staticmethod
    def _grow(z: np.ndarray, first: int, depth: int, rng: np.random.Generator) -> dict:
        """The tree of rows z that begins at level `first`: all nodes of a level at once, rows in the order of their nodes."""
        parts: list[dict] = []
        rows, starts, level, n_nodes = z, np.zeros(1, np.int64), first, 0
        while len(starts):
            counts = np.diff(np.append(starts, len(rows)))
            lo, hi = (f.reduceat(rows, starts, axis=0) for f in (np.minimum, np.maximum))
            inner = (counts > 1) & (hi > lo).any(1) & (level < depth)
            f = np.where(hi > lo, rng.random(lo.shape), -1.0).argmax(1)
            at = np.arange(len(starts))
            low, high = lo[at, f], hi[at, f]
            v = np.maximum(low + rng.random(len(at)) * (high - low), np.nextafter(low, np.inf))  # so that neither side is empty
            own = n_nodes + at
            child = n_nodes + len(at) + 2 * (np.cumsum(inner) - 1)
            leaf_depth = level + np.array([_c(k) for k in counts])
            parts.append({"f": np.where(inner, f, -1), "v": np.where(inner, v, 0.0), "l": np.where(inner, child, own), "r": np.where(inner, child + 1, own), "d": leaf_depth})
            node = np.repeat(at, counts)
            keep = inner[node]
            rows, node = rows[keep], node[keep]
            right = rows[np.arange(len(rows)), f[node]] >= v[node]
            side = 2 * (np.cumsum(inner) - 1)[node] + right
            order = np.argsort(side, kind="stable")
            rows = rows[order]
            starts = np.searchsorted(side[order], np.arange(2 * int(inner.sum())))
            n_nodes += len(at)
            level += 1
        return {k: np.concatenate([p[k] for p in parts]).astype(t) for k, t in _KINDS.items()}

    def score_array(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), self.fill, x)
        z = (x - self.mean) / self.scale
        forest = self._forest()
        out = np.empty(len(z))
        for s in range(0, len(z), 256):  # rows x trees at once
            part = z[s : s + 256]
            at = np.broadcast_to(forest["root"], (len(part), len(self.trees))).copy()
            row = np.arange(len(part))[:, None]
            while (inner := (f := forest["f"][at]) >= 0).any():
                left = part[row, np.maximum(f, 0)] < forest["v"][at]
                at = np.where(inner, np.where(left, forest["l"][at], forest["r"][at]), at)
            out[s : s + 256] = forest["d"][at].mean(1)
        return 2 ** (-out / max(_c(self.sample), 1e-9)) - 0.5

    def _forest(self) -> dict:
        """All trees' arrays as one, with the trees' roots; built once in each process."""
        if "_whole" not in self.__dict__:
            size = np.array([len(t["f"]) for t in self.trees])
            root = np.cumsum(size) - size
            whole = {k: np.concatenate([t[k] for t in self.trees]) for k in "fvd"} | {k: np.concatenate([t[k] + r for t, r in zip(self.trees, root, strict=True)]) for k in "lr"}
            self.__dict__["_whole"] = whole | {"root": root}
        return self.__dict__["_whole"]

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        return _score_arrays(self, df, name)


def _score_arrays(model, df: DataFrame, name: str) -> DataFrame:
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(shared.value.score_array(b.to_numpy(float)))

    return df.withColumn(name, run(F.struct(*[F.col(f).cast("double").alias(f) for f in model.features])))


def calibrate(healthy_scored: DataFrame, keys: Sequence[str], t: str, score: str, window: int = 30, q: float = 0.995, smooth_first: DataFrame | None = None, chunk: int | None = None) -> DataFrame:
    """One row, threshold: the exact quantile (linear between ranks) of the smoothed scores of the healthy slice.

    Smoothing sees the healthy slice alone; pass the whole smoothed series as
    `smooth_first`, already sliced, to smooth before slicing instead.
    """
    rows = smooth_first if smooth_first is not None else smooth(healthy_scored, keys, t, score, window, chunk=chunk)
    return quantiles(rows, [], "smoothed_score", {"threshold": q})
