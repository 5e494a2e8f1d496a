"""A small neural network for regression: dense layers of rectified units, squared error.

Rows are dealt to minibatches by a hash of their key and written in a folder
each, so a step reads its own minibatch alone. A step's gradient is added up
inside each task, then in a second round of tasks where there are many, and a
few sums come to the driver, which holds the weights (some thousand numbers,
whatever the rows) and moves them by Adam. Order and start are fixed: the same
weights at every run on the same files.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.validate import scratch

#: Tasks whose sums the driver adds itself.
FEW = 64


@dataclass
class Network:
    """Standardising numbers, and weights (layer by layer: matrix, bias)."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    target: tuple[float, float]
    weights: list[np.ndarray]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        net, names = self, self.features

        def run(batches):
            for pdf in batches:
                x = net.standard(pdf[names].to_numpy(float))
                yield pdf.assign(**{out: forward(net.weights, x)[-1][:, 0] * net.target[1] + net.target[0]})

        return df.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` double")

    def standard(self, x: np.ndarray) -> np.ndarray:
        """A missing value counts as the mean."""
        return np.nan_to_num((x - self.mean) / self.scale)


def start(sizes: list[int], seed: int) -> list[np.ndarray]:
    draw, out = np.random.default_rng(seed), []
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        out += [draw.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)]
    return out


def forward(weights: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Every layer's values, inputs first."""
    out, last = [x], len(weights) // 2 - 1
    for i in range(last + 1):
        z = out[-1] @ weights[2 * i] + weights[2 * i + 1]
        out.append(np.maximum(z, 0) if i < last else z)
    return out


def gradient(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Summed half squared error over rows, and its gradient."""
    values = forward(weights, x)
    delta = values[-1] - y[:, None]
    loss, out = float((delta**2).sum() / 2), [None] * len(weights)
    for i in range(len(weights) // 2 - 1, -1, -1):
        out[2 * i], out[2 * i + 1] = values[i].T @ delta, delta.sum(0)
        delta = (delta @ weights[2 * i].T) * (values[i] > 0)
    return loss, out


def _summed(rows: DataFrame, net: Network, label: str) -> tuple[float, int, np.ndarray]:
    """Loss, rows and flat gradient of a minibatch."""
    names = net.features

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        loss, n, total = 0.0, 0, None
        for pdf in batches:
            y = (pdf[label].to_numpy(float) - net.target[0]) / net.target[1]
            more, g = gradient(net.weights, net.standard(pdf[names].to_numpy(float)), y)
            flat = np.concatenate([x.ravel() for x in g])
            loss, n, total = loss + more, n + len(pdf), flat if total is None else total + flat
        if n:
            yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "loss": [loss], "n": [n], "g": [total.tobytes()]})

    def add(batches):
        import pandas as pd

        loss, n, total, task = 0.0, 0, None, None
        for pdf in batches:
            for r in pdf.itertuples():
                g = np.frombuffer(r.g)
                task = r.task if task is None else task
                loss, n, total = loss + r.loss, n + r.n, g if total is None else total + g
        if n:
            yield pd.DataFrame({"task": [task], "loss": [loss], "n": [n], "g": [total.tobytes()]})

    schema = "task int, loss double, n long, g binary"
    sums = rows.select(*names, label).mapInPandas(run, schema)
    tasks = rows.rdd.getNumPartitions()
    if tasks > FEW:
        sums = sums.repartition(int(tasks**0.5) + 1, "task").sortWithinPartitions("task").mapInPandas(add, schema)
    got = sorted(sums.collect(), key=lambda r: r.task)  # FEW rows or the square root of the tasks
    return sum(r.loss for r in got), sum(r.n for r in got), sum(np.frombuffer(r.g) for r in got)


def fit(df: DataFrame, key: str, features: list[str], label: str, hidden: tuple[int, ...] = (64, 32), epochs: int = 20, batch_rows: int = 4096, rate: float = 0.005, decay: float = 1e-4, seed: int = 42) -> Network:
    """Rows without label are left out; at least one minibatch, of about batch_rows rows each."""
    rows = df.where(F.col(label).isNotNull()).select(key, *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias(label))
    stat = rows.agg(F.count("*").alias("n"), *[x for i, c in enumerate([*features, label]) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
    if not stat.n:
        raise ValueError("no rows with a label")
    mean, sd = (np.array([stat[f"{k}{i}"] or 0.0 for i in range(len(features) + 1)]) for k in "ms")
    sd[sd == 0] = 1.0
    net = Network(list(features), mean[:-1], sd[:-1], (float(mean[-1]), float(sd[-1])), start([len(features), *hidden, 1], seed))
    batches = max(1, round(stat.n / batch_rows))
    path = scratch(df.sparkSession, "minibatches")
    dealt = rows.withColumn("__batch", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(batches)).cast("int"))
    dealt.repartition(min(batches, 1000), "__batch").sortWithinPartitions("__batch", F.xxhash64(key), key, *features, label).write.partitionBy("__batch").parquet(path)
    held = df.sparkSession.read.parquet(path)
    sizes, shapes = [w.size for w in net.weights], [w.shape for w in net.weights]
    first = second = np.zeros(sum(sizes))
    step = 0
    for epoch in range(epochs):
        order = np.random.default_rng([seed, epoch]).permutation(batches)
        for b in order:
            step += 1
            _, n, g = _summed(held.where(F.col("__batch") == int(b)), net, label)
            if not n:
                continue
            flat = np.concatenate([w.ravel() for w in net.weights])
            g = g / n + decay * flat
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            flat = flat - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            net.weights = [x.reshape(s) for x, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes, strict=True)]
    return net
