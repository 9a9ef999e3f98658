"""A model as a function of batches of rows: requests in, one response each out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame


def answer(requests: DataFrame, model: Callable[[pd.DataFrame], list], key: str, response: str = "response", kind: str = "string") -> DataFrame:
    """requests' key and the model's response of each row.

    The key travels with its row, so that nothing is joined by position; a batch that comes
    back with another number of responses raises ValueError. An empty batch is not sent.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            found = list(model(batch))
            if len(found) != len(batch):
                raise ValueError(f"{len(batch)} requests, {len(found)} responses")
            yield pd.DataFrame({key: batch[key], response: pd.Series(found, index=batch.index, dtype=object)})

    return requests.mapInPandas(run, f"{key} {requests.schema[key].dataType.simpleString()}, {response} {kind}")


def retried(call: Callable[[dict], str], attempts: int = 3, wait: float = 0.5, workers: int = 8, transient: tuple[type[Exception], ...] = (TimeoutError, ConnectionError)) -> Callable[[pd.DataFrame], list]:
    """A batch model from a call of one row: in threads, in order, again after a growing wait on transient errors."""

    def one(row: dict) -> str:
        for attempt in range(1, attempts + 1):
            try:
                return call(row)
            except transient:
                if attempt == attempts:
                    raise
                time.sleep(wait * attempt)
        raise AssertionError

    def batch(df: pd.DataFrame) -> list:
        with ThreadPoolExecutor(workers) as pool:
            return list(pool.map(one, df.to_dict("records")))

    return batch
