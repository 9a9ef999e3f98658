"""Requests to models as rows: prompts, decoding parameters with their defaults, cache keys, dispatch."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from stepweave.functions.text import chosen_label, version_numbers
from stepweave.operators.inference import answer

# Decoding parameters where a configuration gives none.
DEFAULTS = {"temperature": 0.0, "top_p": 1.0, "max_new_tokens": 32, "repetition_penalty": 1.0, "image_max_pixels": 1_000_000}


def history_line(act: Column) -> Column:
    """An action done before: its type and its argument, direction or app."""
    said = lambda k: F.nullif(act[k], F.lit(""))
    return F.concat(F.lower(act["action_type"]), F.lit(": "), F.coalesce(said("argument"), said("direction"), said("app"), F.lit("(done)")))


def step_prompt(goal: Column, instruction: Column, history: Column) -> Column:
    """The prompt of a step: goal, instruction if there is one, actions done before (an array of actions)."""
    lines = F.array_join(F.transform(history, history_line), "\n")
    return F.concat_ws("\n", F.concat(F.lit("Task goal: "), F.coalesce(goal, F.lit(""))), F.when(F.coalesce(instruction, F.lit("")) != "", F.concat(F.lit("Instruction for the current step: "), instruction)), F.when(F.coalesce(F.size(history), F.lit(0)) > 0, F.concat(F.lit("Actions already performed:\n"), lines)))


def summary_prompt(goal: Column, metadata: Column, history: Column, support: Column) -> Column:
    """The other benchmark's prompt: goal, metadata and support (maps, by key), history as type:argument."""
    pairs = lambda m: F.coalesce(F.nullif(F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), "; "), F.lit("")), F.lit("none"))
    done = F.coalesce(F.nullif(F.array_join(F.transform(history, lambda a: F.concat(a["action_type"], F.lit(":"), F.coalesce(a["argument"], F.lit("")))), " | "), F.lit("")), F.lit("none"))
    return F.concat_ws("\n", F.concat(F.lit("goal: "), goal), F.concat(F.lit("metadata: "), pairs(metadata)), F.concat(F.lit("history: "), done), F.concat(F.lit("support: "), pairs(support)))


def with_parameters(requests: DataFrame, configs: DataFrame) -> DataFrame:
    """requests (config_id) with the decoding parameters of their configuration; defaults for unknown and null ones."""
    c = configs.groupBy("config_id").agg(*[F.max(k).alias(k) for k in DEFAULTS if k in configs.columns])
    joined = requests.drop(*DEFAULTS).join(c, "config_id", "left")
    return joined.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in c.columns else F.lit(v) for k, v in DEFAULTS.items()})


def screen_id(path: Column, raw: Column, width: Column, height: Column) -> Column:
    """What tells one screen from another: its path, the hash and length of its bytes, or its size."""
    return F.coalesce(F.concat(F.lit("path:"), path), F.concat(F.lit("bytes:"), F.sha2(raw, 256), F.lit(":"), F.octet_length(raw)), F.concat(F.lit("blank:"), F.coalesce(width.cast("string"), F.lit("?")), F.lit("x"), F.coalesce(height.cast("string"), F.lit("?"))))


def cache_key(*parts: Column) -> Column:
    """A hash of everything that an answer depends on; null parts count."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts])), 256)


def answered_once(requests: DataFrame, cached: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(requests with an answer in the cache, with it; one request of each key without)."""
    known = cached.groupBy(key).agg(F.max("response").alias("response"))
    return requests.join(known, key), requests.join(known, key, "left_anti").dropDuplicates([key])


@F.pandas_udf(LongType())
def shard_of(keys: pd.Series, shards: pd.Series) -> pd.Series:
    """The shard of each key: its BLAKE2b hash of eight bytes, the first the highest, by the number of shards; null for null."""
    return pd.Series([None if k is None else int.from_bytes(blake2b(str(k).encode(), digest_size=8).digest(), "big") % int(n) for k, n in zip(keys, shards)], dtype="Int64")


def in_rounds(rows: DataFrame, n: int, order: str) -> DataFrame:
    """rows with the worker (0 to n - 1) that each goes to in turn, in the order of a unique column; numbered by ranges, not in one task."""
    from stepweave.operators.metrics import number

    return number(rows, order).withColumn("worker", (F.col("no") % n).cast("int")).drop("no")


def in_order(responses: DataFrame, requests: DataFrame, key: str, order: str) -> DataFrame:
    """The responses of sharded work in the order of their requests; a request without one keeps a null."""
    return requests.select(key, order).join(responses, key, "left").orderBy(order)


def alike(requests: DataFrame, parameters: list[str]) -> DataFrame:
    """requests with a batch id: rows of one batch have the same decoding parameters."""
    return requests.withColumn("batch", F.sha2(F.to_json(F.struct(*parameters)), 256))


def choose(requests: DataFrame, model: Callable[[pd.DataFrame], list], key: str, labels: str = "labels") -> DataFrame:
    """key and the valid label (of the row's array) that a model's answer names; null for an answer that names none."""
    said = answer(requests, model, key)
    return said.join(requests.select(key, labels), key).select(key, chosen_label(F.col("response"), F.col(labels)).alias("label"))


_BACKENDS: dict[str, Callable[..., Callable[[pd.DataFrame], list]]] = {}


def register(kind: str, make: Callable[..., Callable[[pd.DataFrame], list]]) -> None:
    """A backend by name: make gives a model, a function of a batch."""
    _BACKENDS[kind] = make


def backend(kind: str, **options) -> Callable[[pd.DataFrame], list]:
    if kind not in _BACKENDS:
        raise ValueError(f"no backend {kind}; known: {', '.join(sorted(_BACKENDS))}")
    return _BACKENDS[kind](**options)


def timed(model: Callable[[pd.DataFrame], list]) -> Callable[[pd.DataFrame], list]:
    """The model with the milliseconds of its batch, shared evenly, in each response: dicts of response and ms."""
    import time

    def run(batch: pd.DataFrame) -> list:
        began = time.perf_counter()
        found = model(batch)
        each = (time.perf_counter() - began) * 1000 / max(1, len(batch))
        return [{"response": r, "ms": each} for r in found]

    return run


def support_tasks(tasks: DataFrame, episodes: DataFrame) -> DataFrame:
    """Few-shot tasks (task_id, split, k_shot, query, support: array of ids) with the goals and lengths of query and support episodes, in the order of support; unknown episodes are left out."""
    e = episodes.select("episode_id", "goal", "n_steps")
    q = e.select(F.col("episode_id").alias("query"), F.col("goal").alias("query_goal"), F.col("n_steps").alias("query_steps"))
    each = tasks.select("task_id", F.posexplode("support").alias("place", "episode_id")).join(e, "episode_id")
    # a task's support is a list of a few episodes
    listed = each.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("place", "episode_id", "goal", "n_steps"))).alias("s"))
    joined = tasks.join(q, "query").join(listed, "task_id", "left")
    return joined.select("task_id", "split", "k_shot", "query", "query_goal", "query_steps", F.coalesce(F.col("s.episode_id"), F.array().cast("array<string>")).alias("support"), F.col("s.goal").alias("support_goals"), F.col("s.n_steps").alias("support_steps"))


def tasks_of(tasks: DataFrame, split: str | None = None, k_shot: int | None = None) -> DataFrame:
    """Tasks of a split and number of shots; None takes all."""
    kept = tasks if split is None else tasks.where(F.col("split") == split)
    return kept if k_shot is None else kept.where(F.col("k_shot") == k_shot)


def group_members(groups: DataFrame, shards: DataFrame) -> DataFrame:
    """Per group of ids (group_id, ids) its shards in order, each once, and the ids that no shard (shard, id) holds: one pass over the shards for all groups."""
    each = groups.select("group_id", F.explode(F.array_distinct("ids")).alias("id")).join(shards.dropDuplicates(["id"]), "id", "left")
    return each.groupBy("group_id").agg(F.sort_array(F.collect_set("shard")).alias("shards"), F.sort_array(F.collect_set(F.when(F.col("shard").isNull(), F.col("id")))).alias("missing"))


def names_of(named: DataFrame) -> DataFrame:
    """id and its names in the order of the input: named has place, name, ids (array); many to many."""
    each = named.select("place", "name", F.explode("ids").alias("id")).groupBy("id", "name").agg(F.min("place").alias("place"))
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))


def screen_elements(annotated: DataFrame, key: str = "step_id") -> DataFrame:
    """key, place, group_name, box, label, functionality of a map from group to elements; elements without four numbers are left out."""
    e = annotated.select(key, F.explode("screen").alias("group_name", "elements")).select(key, "group_name", F.posexplode("elements").alias("at", "e"))
    n = F.col("e.bbox")
    good = e.where(F.size(n) == 4)
    label = F.array_join("e.xml_desc", " ")
    w = Window.partitionBy(key).orderBy("group_name", "at")  # the elements of one screen
    return good.select(key, (F.row_number().over(w) - 1).alias("place"), "group_name", F.struct(*[n[i].cast("int").alias(x) for i, x in enumerate("ltrb")]).alias("box"), label.alias("label"), F.col("e.functionality").alias("functionality"))


def latest(rows: DataFrame, version: str, *keys: str) -> DataFrame:
    """Of each group the row of the highest version, by its numbers."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(version_numbers(F.col(version)), version)).alias("best"))
    return best.select("best.*")
