"""The models of ends and token counts, from all texts of a run.

One pass over the texts gives each its measures (how it ends, features for its tokens, its
last segment) and counts segments. The token model is then fitted over the measures: each
task reduces its rows to a triangular factor, and the factors together give the least
squares of all rows. What segments are counted as is added up by groups, and joined with
what the open ends ask; no model grows with the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.cluster import cut, small
from stepweave.llm.completeness import LEAST_TEXTS, LENGTH, N_FEATURES, TerminalContexts, TokenModel, ending, segments, token_features, token_share, words

#: Entries and characters that a task adds up before it passes them on.
HELD, HELD_CHARS = 200_000, 50_000_000
FEATURES = [f"n{i}" for i in range(N_FEATURES)]
_MEASURES = ", ".join(["how string", "tokens double", "counts boolean", *(f"{n} double" for n in FEATURES), "last string"])


def measured(rows: DataFrame, kept: str, more: Callable[[pd.DataFrame, list], dict] | None = None) -> DataFrame:
    """Written once: the columns `kept` (a schema) of the rows, and measures of their text; and, in rows of their own, segments and how often they occur.

    rows have text, tokens and counts (whether the models count them). more(batch, hows)
    gives those columns of kept that the rows do not have.
    """
    names = [c.split()[0] for c in kept.split(", ")]
    nothing = [np.nan] * N_FEATURES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        held = 0
        for b in batches:
            hows, lasts, features = [], [], []
            for text, tokens, counts in zip(b.text, b.tokens, b.counts):
                blank = text is None or not text.strip()
                how = None if blank else ending(text)
                parts = [] if blank or how == "broken" else segments(text)
                hows.append(how)
                lasts.append(parts[-1] if parts and how == "open" else None)
                features.append(token_features(text) if tokens > 0 and not blank else nothing)
                if counts:
                    found.update(parts)
                    held += sum(map(len, parts))
            out = b.assign(**more(b, hows)) if more else b
            out = out[[*names, "tokens", "counts"]].assign(how=pd.Series(hows, dtype=object, index=b.index), last=pd.Series(lasts, dtype=object, index=b.index), segment=None, times=None)
            out[FEATURES] = np.array(features, float).reshape(-1, N_FEATURES)
            yield out
            if len(found) > HELD or held > HELD_CHARS:
                yield alone(found)
                found, held = Counter(), 0
        yield alone(found)

    def alone(found: Counter) -> pd.DataFrame:
        return pd.DataFrame({**{c.split()[0]: None for c in schema.split(", ")}, **{c: np.nan for c in ("tokens", *FEATURES)}, "segment": pd.Series(list(found), dtype=object), "times": list(found.values())})

    schema = f"{kept}, {_MEASURES}, segment string, times bigint"
    return cut(rows.withColumn("tokens", F.col("tokens").cast("double")).mapInPandas(run, schema))


def token_model(texts: DataFrame) -> TokenModel:
    """The model from all measured texts that count, are complete and have a count of tokens."""
    done = texts.where("segment is null and counts and how = 'closed' and tokens > 0").select(*FEATURES, "tokens")
    length = F.greatest(F.lit(8.0), F.col("tokens"), sum(F.col(FEATURES[i]) for i in LENGTH))
    n, model = done.count(), TokenModel([], [])
    if n < LEAST_TEXTS:
        return model

    def error(weights: np.ndarray) -> F.Column:
        expected = sum(F.col(c) * float(w) for c, w in zip(FEATURES, weights))
        return F.abs(F.col("tokens") - expected) / F.greatest(F.lit(8.0), expected)

    def triangle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, N_FEATURES + 1))
        for b in batches:
            r = np.linalg.qr(np.vstack([r, b.to_numpy(float)]), mode="r")
        yield pd.DataFrame(r, columns=[*FEATURES, "tokens"])

    def factor(weights: np.ndarray | None, most: float | None) -> np.ndarray:
        rows = done if weights is None else done.where(error(weights) < most)
        scaled = rows.select(*((F.col(c) / length).alias(c) for c in (*FEATURES, "tokens")))
        return np.array(scaled.mapInPandas(triangle, ", ".join(f"{c} double" for c in (*FEATURES, "tokens"))).collect(), float)

    def median(weights: np.ndarray) -> float:
        errors = done.select(error(weights).alias("e"))
        # summaries of all rows bracket the middle; within the bracket errors are counted
        low, high = errors.agg(F.percentile_approx("e", [0.4999, 0.5001], 100_000)).first()[0]
        counted = errors.where(F.col("e") <= high).groupBy(F.when(F.col("e") < low, -1.0).otherwise(F.col("e")).alias("e")).agg(F.count("*").alias("n")).orderBy("e").collect()
        upto = np.cumsum([r.n for r in counted])
        at = [counted[min(int(np.searchsorted(upto, rank, side="right")), len(counted) - 1)].e for rank in ((n - 1) // 2, n // 2)]
        return (at[0] + at[1]) / 2

    return model.fit(n, factor, median)


def shares(b: pd.DataFrame, weights: np.ndarray | None) -> list[float | None]:
    """Of measured rows, the share of tokens that each lacks; None where its tokens are unknown or there is no model."""
    if weights is None:
        return [None] * len(b)
    expected = b[FEATURES].to_numpy(float) @ weights
    return [token_share(e, n) if n > 0 and how is not None else None for e, n, how in zip(expected, b.tokens, b.how)]


def complete_ends(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """last, complete: whether a text may end with the last segment, of those asked, by all segments of the measured texts."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        held = 0
        for b in batches:
            for segment, n in zip(b.segment, b.times):
                held += len(segment)
                for x in TerminalContexts.counted(words(segment)):
                    found[x] += n
                if len(found) > HELD or held > HELD_CHARS:
                    yield pd.DataFrame({"item": list(found), "n": list(found.values())})
                    found, held = Counter(), 0
        yield pd.DataFrame({"item": pd.Series(list(found), dtype=object), "n": pd.Series(list(found.values()), dtype="int64")})

    def questions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, x) for s in b["last"] for x in TerminalContexts.asked(words(s)) or [""]]
            yield pd.DataFrame(rows, columns=["last", "item"])

    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"last": b["last"], "complete": [TerminalContexts.ended(words(s), {x["item"]: x["n"] for x in of}, scale) for s, of in zip(b["last"], b.found)]})

    scale = TerminalContexts.scaled(texts.where("segment is null and counts and how is not null").count())
    each = texts.where("segment is not null").groupBy("segment").agg(F.sum("times").alias("times"))
    counts = each.mapInPandas(sums, "item string, n bigint").groupBy("item").agg(F.sum("n").alias("n"))
    wanted = asked.where("last is not null").distinct().mapInPandas(questions, "last string, item string")
    found = wanted.join(counts, "item", "left").groupBy("last").agg(F.collect_list(F.struct("item", F.coalesce("n", F.lit(0)).alias("n"))).alias("found"))
    return found.mapInPandas(answers, "last string, complete boolean")


def settled(texts: DataFrame, judged: DataFrame, name: str, incomplete: str | None) -> DataFrame:
    """judged, its column `name` settled where it is unsure: an incomplete end has the value `incomplete`, a complete one its own; without `incomplete` a complete one has none, an incomplete one its own."""
    judged = cut(judged)
    ends = complete_ends(texts, judged.where("unsure").select("last"))
    ended = judged.where("unsure").join(small(ends), "last", "left")
    complete = F.coalesce("complete", F.lit(True))
    value = F.when(complete, F.col(name) if incomplete else F.lit(None)).otherwise(F.lit(incomplete) if incomplete else F.col(name))
    rest = [c for c in judged.columns if c not in (name, "unsure", "last")]
    return judged.where("not unsure").select(*rest, name).unionByName(ended.select(*rest, value.alias(name)))
