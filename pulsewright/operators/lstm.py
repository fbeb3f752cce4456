"""LSTM autoencoder in NumPy: encoder, latent layer, decoder; back-propagation through time and Adam.

The score of a row is the mean squared reconstruction error of the window that
ends with it. Training windows must be without gaps; scored windows may span
gaps. Rows before the first full window take the first score of their series.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewright.cluster import discard, materialise, ship
from pulsewright.operators.chunked import chunk_of, numbered
from pulsewright.operators.detectors import moments
from pulsewright.operators.order_stats import quantiles
from pulsewright.operators.windows import in_chunks, ordered, sequences

#: Windows that a task shuffles among each other.
POOL = 8192


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Lstm:
    """One layer; parameters are [input, hidden, 1] x 4 gates (input, forget, cell, output)."""

    def __init__(self, n_in: int, n_hidden: int, rng: np.random.Generator):
        k = 1 / np.sqrt(n_hidden)
        self.w = rng.uniform(-k, k, (n_in + n_hidden + 1, 4 * n_hidden))
        self.n = n_hidden

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        b, steps, _ = x.shape
        h, c, out, kept = np.zeros((b, self.n)), np.zeros((b, self.n)), [], []
        for t in range(steps):
            z = np.concatenate([x[:, t], h, np.ones((b, 1))], 1)
            i, f, g, o = np.split(z @ self.w, 4, 1)
            i, f, g, o = _sigmoid(i), _sigmoid(f), np.tanh(g), _sigmoid(o)
            old = c
            c = f * c + i * g
            h = o * np.tanh(c)
            kept.append((z, i, f, g, o, old, c))
            out.append(h)
        return np.stack(out, 1), kept

    def backward(self, dout: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        """(gradient of the inputs, gradient of the weights)."""
        b, steps, _ = dout.shape
        dw, dx = np.zeros_like(self.w), []
        dh, dc = np.zeros((b, self.n)), np.zeros((b, self.n))
        for t in reversed(range(steps)):
            z, i, f, g, o, old, c = kept[t]
            dh = dh + dout[:, t]
            tc = np.tanh(c)
            dc = dc + dh * o * (1 - tc**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dc * i * (1 - g**2), dh * tc * o * (1 - o)], 1)
            dw += z.T @ dz
            back = dz @ self.w.T
            n_in = z.shape[1] - self.n - 1
            dx.append(back[:, :n_in])
            dh, dc = back[:, n_in:-1], dc * f
        return np.stack(dx[::-1], 1), dw


@dataclass
class LstmAutoencoder:
    features: Sequence[str]
    seq_len: int = 30
    hidden: int = 32
    latent: int = 16
    batch: int = 256
    epochs: int = 10
    rate: float = 0.002
    seed: int = 42
    contamination: float = 0.01
    workers: int = 8  # groups of windows that train at the same time
    chunk: int = 1440  # units of time, or rows, of one task
    threshold: float = 0.0
    fill: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    parts: dict = field(default_factory=dict)
    losses: list[float] = field(default_factory=list)
    windows: int = 0  # that each round trained on

    def _build(self, rng: np.random.Generator) -> None:
        n, h, k = len(self.features), self.hidden, self.latent

        def linear(a: int, b: int) -> np.ndarray:
            return rng.uniform(-1 / np.sqrt(a), 1 / np.sqrt(a), (a + 1, b))

        self.parts = {"enc": Lstm(n, h, rng), "to_latent": linear(h, k), "from_latent": linear(k, h), "dec": Lstm(h, h, rng), "out": linear(h, n)}

    @staticmethod
    def _ones(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.ones((*x.shape[:-1], 1))], -1)

    def _forward(self, x: np.ndarray):
        p = self.parts
        he, ke = p["enc"].forward(x)
        last = he[:, -1]
        z = self._ones(last) @ p["to_latent"]
        d = self._ones(z) @ p["from_latent"]
        hd, kd = p["dec"].forward(np.repeat(d[:, None], x.shape[1], 1))
        return self._ones(hd) @ p["out"], (he, ke, last, z, d, hd, kd)

    def _gradients(self, x: np.ndarray) -> tuple[float, dict]:
        p = self.parts
        y, (he, ke, last, z, _, hd, kd) = self._forward(x)
        diff = y - x
        dy = 2 * diff / diff.size
        g = {"out": np.einsum("bti,btj->ij", self._ones(hd), dy)}
        dhd = dy @ p["out"][:-1].T
        dd, g["dec"] = p["dec"].backward(dhd, kd)
        dd = dd.sum(1)
        g["from_latent"] = self._ones(z).T @ dd
        dz = dd @ p["from_latent"][:-1].T
        g["to_latent"] = self._ones(last).T @ dz
        dhe = np.zeros_like(he)
        dhe[:, -1] = dz @ p["to_latent"][:-1].T
        _, g["enc"] = p["enc"].backward(dhe, ke)
        return float((diff**2).mean()), g

    def _weights(self, k: str) -> np.ndarray:
        return self.parts[k].w if isinstance(self.parts[k], Lstm) else self.parts[k]

    def _start(self) -> None:
        self._build(np.random.default_rng(self.seed))
        self._step = 0
        self._moments = {k: (np.zeros_like(self._weights(k)), np.zeros_like(self._weights(k))) for k in self.parts}

    def _learn(self, x: np.ndarray) -> float:
        """One step of Adam on a batch of scaled windows; returns its loss before."""
        loss, g = self._gradients(x)
        self._step += 1
        for k, d in g.items():
            a, b = self._moments[k]
            a += 0.1 * (d - a)
            b += 0.001 * (d**2 - b)
            w = self._weights(k)
            w -= self.rate * (a / (1 - 0.9**self._step)) / (np.sqrt(b / (1 - 0.999**self._step)) + 1e-8)
        return loss

    def _flat(self) -> np.ndarray:
        """All weights and both moments of each, as one row."""
        return np.concatenate([x.ravel() for k in self.parts for x in (self._weights(k), *self._moments[k])])

    def _set(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.parts:
            for x in (self._weights(k), *self._moments[k]):
                x[...] = flat[at : at + x.size].reshape(x.shape)
                at += x.size

    def errors(self, x: np.ndarray) -> np.ndarray:
        out = [((self._forward(part)[0] - part) ** 2).mean((1, 2)) for part in np.array_split(x, max(1, -(-len(x) // 4096)))]
        return np.concatenate(out) if out else np.zeros(0)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isnan(x), self.fill, x) - self.mean) / self.scale

    def fit(self, healthy: DataFrame, keys: Sequence[str] = ("asset",), t: str = "t") -> LstmAutoencoder:
        """Train on all gap-free windows of the healthy slice; the threshold is an exact quantile of their errors.

        The slice is dealt to `workers` groups by a hash of series and day. In a round each group, in a task of
        its own, goes on from the weights of the round before through its windows, batch by batch from
        a shuffled pool; the driver gets one row of weights a group and averages them by their numbers of
        windows. A task holds a pool of windows, whatever the group's size.
        """
        keys = list(keys)
        rows = healthy.select(*keys, t, *[F.col(f).cast("double").alias(f) for f in self.features])
        self.fill, self.mean, self.scale = moments(rows, self.features)
        table = in_chunks(rows, t, self.chunk, self.seq_len - 1)
        table = materialise(table.withColumn("_group", F.pmod(F.xxhash64(*keys, "_chunk"), F.lit(self.workers)).cast("int")), "windows")
        self._start()
        for epoch in range(self.epochs):
            self._round(table, keys, t, epoch)
        windows = sequences(rows, keys, t, list(self.features), self.seq_len).filter("contiguous")
        steps = F.transform("sequence", lambda r: F.struct(*[r[f].alias(f) for f in self.features]))
        q = quantiles(windows.select(self._errors_of(rows.sparkSession)(steps).alias("e")), [], "e", {"q": 1 - self.contamination}).first().q
        self.threshold = float("nan") if q is None else float(q)
        discard(table)
        return self

    def _round(self, table: DataFrame, keys: list[str], t: str, epoch: int) -> None:
        ship(table.sparkSession)
        shared = table.sparkSession.sparkContext.broadcast(self)
        n, columns = self.seq_len, list(self.features)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = group = rng = None
            pool: list[np.ndarray] = []
            seen, loss = 0, 0.0

            def learn(least: int) -> None:
                nonlocal pool, seen, loss
                x = np.concatenate(pool) if pool else np.zeros((0, n, len(columns)))
                x = x[rng.permutation(len(x))]
                while len(x) > least:
                    loss += model._learn(x[: model.batch]) * len(x[: model.batch])
                    seen += len(x[: model.batch])
                    x = x[model.batch :]
                pool = [x]

            def done() -> pd.DataFrame:
                learn(0)
                return pd.DataFrame({"grp": [group], "n": [seen], "loss": [loss], "flat": [model._flat()], "steps": [model._step]})

            tail: pd.DataFrame | None = None
            for b in batches:
                b = b if tail is None else pd.concat([tail, b], ignore_index=True)
                for g, own in b.groupby("_group", sort=True):
                    if g != group:
                        if model is not None:
                            yield done()
                        model, group, rng, pool, seen, loss = copy.deepcopy(shared.value), g, np.random.default_rng([shared.value.seed, epoch, int(g)]), [], 0, 0.0
                    at, time = own.groupby([*keys, "_chunk"], dropna=False, sort=False).ngroup().to_numpy(), own[t].to_numpy()
                    if len(own) >= n:
                        first, last = slice(0, len(own) - n + 1), slice(n - 1, None)
                        whole = (at[first] == at[last]) & (time[last] - time[first] == n - 1) & own["_own"].to_numpy()[last]
                        x = np.lib.stride_tricks.sliding_window_view(model.scaled(own[columns].to_numpy(float)), n, 0)[whole].transpose(0, 2, 1)
                        pool.append(x)
                        if sum(map(len, pool)) >= POOL:
                            learn(POOL // 2)
                tail = b[b["_group"] == group].iloc[-(n - 1) :] if n > 1 else None  # of windows that end in the next batch
            if model is not None:
                yield done()

        dealt = table.repartition(self.workers, "_group").sortWithinPartitions("_group", *keys, "_chunk", t)
        rows = dealt.mapInPandas(run, "grp int, n long, loss double, flat array<double>, steps long").collect()
        self.windows = total = sum(r.n for r in rows)
        if total:
            self._set(sum(np.array(r.flat) * (r.n / total) for r in sorted(rows, key=lambda r: r.grp)))
            self._step = max(r.steps for r in rows)
            self.losses.append(sum(r.loss for r in rows) / total)
        shared.destroy()

    def _errors_of(self, spark: SparkSession):
        """A function of windows of rows: the error of each full one."""
        ship(spark)
        shared = spark.sparkContext.broadcast(self)
        n = self.seq_len

        @F.pandas_udf("double")
        def run(windows: pd.Series) -> pd.Series:
            model = shared.value
            full = np.array([len(w) == n for w in windows], bool)
            out = np.full(len(windows), np.nan)
            if full.any():
                x = np.array([[[np.nan if v is None else v for v in step.values()] for step in w] for w in windows[full]], float)
                out[full] = model.errors(model.scaled(x))
            return pd.Series(out)

        return run

    def score(self, df: DataFrame, name: str = "score", keys: Sequence[str] = ("asset",), t: str = "t") -> DataFrame:
        """Windows are rows of any distance, so a series is cut by row numbers, with the rows of one window before each piece."""
        n, keys = self.seq_len, list(keys)
        run = self._errors_of(df.sparkSession)
        size = max(self.chunk, n)
        rows = in_chunks(numbered(df, keys, [t], chunk_of(t, self.chunk), "_i"), "_i", size, n - 1)
        w = ordered([*keys, "_chunk"], ["_i"])
        rows = rows.withColumn("_seq", F.collect_list(F.struct(*[F.col(f).cast("double").alias(f) for f in self.features])).over(w.rowsBetween(-(n - 1), 0)))
        rows = rows.withColumn(name, F.when(F.col("_own") & (F.size("_seq") == n), run("_seq"))).drop("_seq")
        rows = rows.withColumn(name, F.when(F.col("_i") < n - 1, F.first(name, True).over(w.rowsBetween(0, n - 1))).otherwise(F.col(name)))
        return rows.filter("_own").drop("_i", "_chunk", "_own")
