"""Percentiles from mergeable rank-interval summaries.

A summary is a list of tuples (value, g, delta): g the ranks since the tuple before, delta
the extent of the value's possible ranks. Each partition sorts its values once and keeps
tuples so that no value's rank is uncertain by more than eps * n; summaries merge by
interleaving their tuples, each gaining the uncertainty of its neighbours in the other
list; a merged summary is compressed again by the permitted uncertainty. Merging goes in
rounds: the states of FAN_IN neighbouring partitions are one task's share of a group, then
those of FAN_IN such shares, as many rounds as the number of partitions asks for. The
error that is reported is the one accumulated in the tuples, not the one permitted.

Defined results: null, NaN, infinite and negative values are no measurements and are only
counted; zeros, ties and huge values count; a group without measurements gives no row. Rank
r of quantile q is ceil(q * n), at least 1; rank_error bounds |rank of the answer - r| / n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.cluster import cut

#: Permitted uncertainty in all; half of it is used up in the partitions, the rest by merging.
EPS = 0.002
FAN_IN = 16
#: Rows that a partition sorts at a time.
SORTED_ROWS = 500_000
STATE = "n bigint, v array<double>, g array<bigint>, d array<bigint>"
PROBABILITIES = (0.5, 0.9, 0.99)


def summarize(values: np.ndarray, eps: float) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Summary of sorted values: every value if few, else one for each floor(eps * n) + 1 ranks, first and last included."""
    n = len(values)
    step = max(1, int(eps * n))
    at = np.unique(np.concatenate([np.arange(0, n, step), [n - 1]])) if n else np.arange(0)
    return n, values[at], np.diff(at, prepend=-1).astype(np.int64), np.zeros(len(at), np.int64)


def merge(a: tuple, b: tuple) -> tuple:
    """The summary of both inputs' values."""
    if not a[0] or not b[0]:
        return a if a[0] else b

    def widened(x: tuple, y: tuple, side: str) -> np.ndarray:
        # a tuple's rank in the other list lies below that of the tuple there that follows it
        nxt = np.searchsorted(y[1], x[1], side=side)
        inside = nxt < len(y[1])
        gain = np.zeros(len(x[1]), np.int64)
        gain[inside] = (y[2] + y[3])[nxt[inside]] - 1
        return x[3] + gain

    v = np.concatenate([a[1], b[1]])
    g, d = np.concatenate([a[2], b[2]]), np.concatenate([widened(a, b, "left"), widened(b, a, "right")])
    # of equal values those of a come first
    order = np.argsort(v, kind="stable")
    return a[0] + b[0], v[order], g[order], d[order]


def compress(s: tuple, eps: float) -> tuple:
    """Fewer tuples: neighbours join while the joint uncertainty stays within 2 * eps * n."""
    n, v, g, d = s
    most = int(2 * eps * n)
    if len(v) < 3 or most < 2:
        return s
    keep_v, keep_g, keep_d = [v[-1]], [int(g[-1])], [int(d[-1])]
    for i in range(len(v) - 2, 0, -1):
        if int(g[i]) + keep_g[-1] + keep_d[-1] <= most and len(keep_v) > 1:
            keep_g[-1] += int(g[i])
        else:
            keep_v.append(v[i]), keep_g.append(int(g[i])), keep_d.append(int(d[i]))
    keep_v.append(v[0]), keep_g.append(int(g[0])), keep_d.append(int(d[0]))
    return n, np.array(keep_v[::-1]), np.array(keep_g[::-1], np.int64), np.array(keep_d[::-1], np.int64)


def answers(s: tuple, probabilities: tuple[float, ...] = PROBABILITIES) -> list[tuple[float, float]]:
    """(value, bound of its rank error as a share of n) of each probability."""
    n, v, g, d = s
    low = np.cumsum(g)
    high = low + d
    out = []
    for q in probabilities:
        rank = min(n, max(1, int(np.ceil(q * n - 1e-9))))
        off = np.maximum(rank - low, high - rank)
        i = int(np.argmin(off))
        out.append((float(v[i]), max(0, int(off[i])) / n))
    return out


def partial_states(rows: DataFrame, keys: list[str], value: str, eps: float = EPS) -> DataFrame:
    """One state per partition of rows and group: keys, n, v, g, d, at (the partition). No shuffle."""
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + f", {STATE}, at int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId()
        held: dict[tuple, tuple] = {}
        kept: list[pd.DataFrame] = []

        def settle() -> None:
            if not kept:
                return
            whole = pd.concat(kept, ignore_index=True)
            kept.clear()
            codes, unique = pd.factorize(pd.MultiIndex.from_frame(whole[keys].astype(object).where(whole[keys].notna(), None)), use_na_sentinel=False)
            values = whole[value].to_numpy(float)
            order = np.lexsort((values, codes))
            codes, values = codes[order], values[order]
            starts = np.flatnonzero(np.diff(codes, prepend=-1))
            for start, end in zip(starts, [*starts[1:], len(codes)]):
                key = tuple(None if pd.isna(k) else k for k in unique[codes[start]])
                s = summarize(values[start:end], eps / 4)
                held[key] = compress(merge(held[key], s), eps / 4) if key in held else s

        for batch in batches:
            kept.append(batch)
            if sum(map(len, kept)) >= SORTED_ROWS:
                settle()
        settle()
        out = [(*key, int(s[0]), s[1].tolist(), s[2].tolist(), s[3].tolist(), at) for key, s in held.items()]
        for i in range(0, len(out), 2000):
            yield pd.DataFrame(out[i : i + 2000], columns=[*keys, "n", "v", "g", "d", "at"])

    return rows.select(*keys, value).mapInPandas(run, schema)


def merged(states: DataFrame, keys: list[str], eps: float = EPS) -> DataFrame:
    """One state per group from any number of states: of partitions, files or days."""
    schema = ", ".join(f"{k} {states.schema[k].dataType.simpleString()}" for k in keys) + f", {STATE}"

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(int(n), np.asarray(v, float), np.asarray(g, np.int64), np.asarray(d, np.int64)) for n, v, g, d in zip(pdf.n, pdf.v, pdf.g, pdf.d)]
        parts.sort(key=lambda s: (s[0], s[1].tolist()))
        while len(parts) > 1:
            parts = [merge(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        s = compress(parts[0], eps)
        first = pdf.iloc[0]
        return pd.DataFrame([[*(None if pd.isna(first[k]) else first[k] for k in keys), int(s[0]), s[1].tolist(), s[2].tolist(), s[3].tolist()]], columns=[*keys, "n", "v", "g", "d"])

    return states.groupBy(*keys).applyInPandas(join, schema)


def summaries(rows: DataFrame, keys: list[str], value: str, eps: float = EPS, fan_in: int = FAN_IN) -> DataFrame:
    """Group summaries of a column: partial states, then rounds of merging fan_in states a task."""
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")) & (F.col(value) >= 0)).withColumn(value, F.col(value).cast("double"))
    states = cut(partial_states(good, keys, value, eps))
    parts = (states.agg(F.max("at")).first()[0] or 0) + 1
    while parts > fan_in:
        parts = -(-parts // fan_in)
        states = merged(states.withColumn("at", (F.col("at") / fan_in).cast("int")), [*keys, "at"], eps * 0.75)
    return merged(states.drop("at"), keys, eps)


def percentiles(states: DataFrame, keys: list[str], probabilities: tuple[float, ...] = PROBABILITIES) -> DataFrame:
    """keys, n, p50, p90, p99 and rank_error (the largest of the three bounds) of each state."""
    names = [f"p{q * 100:g}".replace(".", "_") for q in probabilities]
    schema = ", ".join(f"{k} {states.schema[k].dataType.simpleString()}" for k in keys) + ", n bigint, " + ", ".join(f"{x} double" for x in names) + ", rank_error double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, n, v, g, d in zip(b[keys].itertuples(index=False, name=None), b.n, b.v, b.g, b.d):
                found = answers((int(n), np.asarray(v, float), np.asarray(g, np.int64), np.asarray(d, np.int64)), probabilities)
                rows.append((*(None if pd.isna(k) else k for k in key), int(n), *(x for x, _ in found), max(e for _, e in found)))
            yield pd.DataFrame(rows, columns=[*keys, "n", *names, "rank_error"])

    return states.mapInPandas(run, schema)


def measurements(timings: DataFrame, results: DataFrame, examples: DataFrame, label: Column) -> DataFrame:
    """partition_name, method, day, metric, value: latency_ms of results by the day they finished, model_generate_ms of calls by the day they began.

    A result without example, or an example with a null label, has a null partition_name,
    which is a group of its own; so has a call without result.
    """
    named = examples.select("example_id", label.alias("partition_name"))
    by_result = results.select("result_id", "example_id", "method", "latency_ms", "finished_at").join(named, "example_id", "left").drop("example_id")
    calls = timings.select("result_id", "started_at", "model_generate_ms").join(by_result.select("result_id", "partition_name", "method"), "result_id", "left")
    day = lambda c: F.to_date(c).cast("string")
    return by_result.select("partition_name", "method", day("finished_at").alias("day"), F.lit("latency_ms").alias("metric"), F.col("latency_ms").alias("value")).unionByName(
        calls.select("partition_name", "method", day("started_at").alias("day"), F.lit("model_generate_ms").alias("metric"), F.col("model_generate_ms").alias("value"))
    )


def checked(rows: DataFrame, answers: DataFrame, keys: list[str], probabilities: tuple[float, ...] = PROBABILITIES) -> DataFrame:
    """keys, n, and for each percentile whether its true ranks among the rows lie within the stated bound of the wanted one: a count, nothing is sorted."""
    names = [f"p{q * 100:g}".replace(".", "_") for q in probabilities]
    good = rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")) & (F.col("value") >= 0))
    mine = answers.select(*[F.col(k).alias(f"k_{k}") for k in keys], "n", "rank_error", *names)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    counts = good.join(mine, same).groupBy(*keys, "n", "rank_error").agg(*[F.count_if(F.col("value") < F.col(x)).alias(f"{x}_below") for x in names], *[F.count_if(F.col("value") <= F.col(x)).alias(f"{x}_to") for x in names])

    def inside(x: str, q: float) -> Column:
        rank = F.greatest(F.lit(1), F.ceil(F.col("n") * q - 1e-9))
        off = F.greatest(F.lit(0), F.col(f"{x}_below") + 1 - rank, rank - F.col(f"{x}_to"))
        return (off <= F.col("rank_error") * F.col("n") + 1e-6).alias(f"{x}_inside")

    return counts.select(*keys, "n", (F.col("rank_error") <= EPS + 1 / F.col("n")).alias("bounded"), *[inside(x, q) for x, q in zip(names, probabilities)])
