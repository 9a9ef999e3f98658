"""A small learned regressor of points: layer norm, one hidden layer, sigmoid, trained by gradient descent on the smooth L1 loss.

Fitting takes a bounded sample of labelled rows (`most`, a parameter); prediction runs over
all rows in Arrow batches, the weights travel with the function.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BETA = 0.01


@dataclass
class Regressor:
    gain: np.ndarray
    shift: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, width: int, units: int, outputs: int, seed: int = 0) -> Regressor:
        r = np.random.default_rng(seed)
        return cls(np.ones(width), np.zeros(width), r.normal(0, (2 / width) ** 0.5, (width, units)), np.zeros(units), r.normal(0, (1 / units) ** 0.5, (units, outputs)), np.zeros(outputs))

    def normed(self, x: np.ndarray) -> np.ndarray:
        return (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(0, (self.normed(x) * self.gain + self.shift) @ self.hidden + self.hidden_bias)
        return 1 / (1 + np.exp(-(h @ self.out + self.out_bias)))

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        n = self.normed(x)
        z = n * self.gain + self.shift
        h = z @ self.hidden + self.hidden_bias
        a = np.maximum(0, h)
        p = 1 / (1 + np.exp(-(a @ self.out + self.out_bias)))
        error = p - y
        d = np.clip(error / BETA, -1, 1) * p * (1 - p) / error.size
        dh = (d @ self.out.T) * (h > 0)
        dz = dh @ self.hidden.T
        self.out -= rate * a.T @ d
        self.out_bias -= rate * d.sum(0)
        self.hidden -= rate * z.T @ dh
        self.hidden_bias -= rate * dh.sum(0)
        self.gain -= rate * (dz * n).sum(0)
        self.shift -= rate * dz.sum(0)


def loss(p: np.ndarray, y: np.ndarray) -> float:
    """Smooth L1."""
    e = np.abs(p - y)
    return float(np.where(e < BETA, 0.5 * e * e / BETA, e - 0.5 * BETA).mean())


def train(x: np.ndarray, y: np.ndarray, units: int = 256, epochs: int = 200, patience: int = 20, rate: float = 0.5, batch: int = 256, seed: int = 0) -> tuple[Regressor, list[float]]:
    """The regressor of the epoch with the smallest loss on a fifth of the rows, and the losses; stops after `patience` epochs without a smaller one. Rows with a target outside 0 to 1 are left out."""
    inside = ((y >= 0) & (y <= 1)).all(1)
    x, y = x[inside], y[inside]
    r = np.random.default_rng(seed)
    order = r.permutation(len(x))
    held, kept = order[: len(x) // 5], order[len(x) // 5 :]
    model = Regressor.new(x.shape[1], units, y.shape[1], seed)
    best, best_loss, losses = model, float("inf"), []
    for _ in range(epochs):
        for i in range(0, len(kept), batch):
            rows = kept[i : i + batch]
            model.step(x[rows], y[rows], rate)
        losses.append(loss(model(x[held]), y[held]) if len(held) else loss(model(x), y))
        if losses[-1] < best_loss:
            best, best_loss = Regressor(*(w.copy() for w in (model.gain, model.shift, model.hidden, model.hidden_bias, model.out, model.out_bias))), losses[-1]
        elif len(losses) - 1 - int(np.argmin(losses)) >= patience:
            break
    return best, losses


def fit(rows: DataFrame, features: str, target: str, key: str, most: int = 50_000, **options) -> Regressor:
    """Trained on at most `most` rows, those with the smallest hashed key."""
    sample = rows.where(F.col(features).isNotNull() & F.col(target).isNotNull()).orderBy(F.xxhash64(key), key).limit(most).select(features, target).collect()
    return train(np.array([r[0] for r in sample], float), np.array([r[1] for r in sample], float), **options)[0]


def predict(rows: DataFrame, model: Regressor, features: str, key: str) -> DataFrame:
    """key and prediction (array<double>) of every row with features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({key: b[key], "prediction": list(model(np.stack([np.asarray(v, float) for v in b[features]])))})

    return rows.where(F.col(features).isNotNull()).select(key, features).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, prediction array<double>")


def vector_of(rows: DataFrame, point: str) -> str:
    """The column that holds the vectors of an extraction point; ValueError if there is none."""
    name = f"h_{point}"
    if name not in rows.columns:
        raise ValueError(f"no vectors of {point}; columns: {', '.join(rows.columns)}")
    return name


def metadata_of(rows: DataFrame, kind: str = "array<string>"):
    """The column metadata, else meta, else an empty list."""
    return F.coalesce(*[F.col(c) for c in ("metadata", "meta") if c in rows.columns], F.array().cast(kind))


def checked_vectors(rows: DataFrame, features: str, n_metadata: int | None = None) -> None:
    """ValueError if vectors differ in length, if some are null beside others, or if their number isn't that of the metadata."""
    r = rows.agg(F.count("*").alias("n"), F.count(features).alias("given"), F.min(F.size(features)).alias("least"), F.max(F.size(features)).alias("most")).first()
    if r.given and r.given != r.n:
        raise ValueError(f"{r.n - r.given} of {r.n} rows have no {features}")
    if r.least != r.most:
        raise ValueError(f"{features} of {r.least} to {r.most} numbers")
    if n_metadata is not None and n_metadata != r.n:
        raise ValueError(f"{r.n} vectors, {n_metadata} metadata")


def same_columns(rows: DataFrame, a: str, b: str) -> None:
    """ValueError if two columns differ in any row."""
    if n := rows.where(~F.col(a).eqNullSafe(F.col(b))).count():
        raise ValueError(f"{a} and {b} differ in {n} rows")


def save_vectors(rows: DataFrame, features: str, path: str) -> None:
    """Vectors with their metadata as Parquet, if they are all of one kind."""
    checked_vectors(rows, features)
    rows.write.mode("overwrite").parquet(path)


def save(model: Regressor, spark, path: str, **info) -> None:
    """Weights and what is told of them as one JSON text."""
    value = {"info": info, "weights": {k: v.tolist() for k, v in vars(model).items()}}
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark, path: str) -> tuple[Regressor, dict]:
    value = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return Regressor(**{k: np.array(v) for k, v in value["weights"].items()}), value["info"]


def best_epochs(losses: DataFrame) -> DataFrame:
    """One JSON object per variant of losses (variant, epoch, loss): the epoch with the lowest loss (the first of equal ones) and that loss."""
    best = losses.groupBy("variant").agg(F.min_by(F.struct("epoch", "loss"), F.struct("loss", "epoch")).alias("best"), F.count("*").alias("epochs"))
    return best.select("variant", F.to_json(F.struct(F.col("best.epoch").alias("best_epoch"), F.col("best.loss").alias("best_loss"), "epochs")).alias("summary"))
