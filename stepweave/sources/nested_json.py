"""Readers of nested JSON: manifests, split files, and a tree of episodes with side files per episode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPISODES = "map<string, struct<instruction: string, app: string, domain: string, split: string, steps: array<struct<step_id: int, image_path: string, action: string, action_description: string>>>>"
ANNOTATION = "struct<steps: array<struct<step_id: int, action: string, package_name: string, type_text: string, touch_coord: array<int>, lift_coord: array<int>, device_dim: array<int>>>>"
ID = r"([0-9a-f]{32})"


def manifest_path(spark: SparkSession, manifest: str) -> str:
    """prepared_path of a JSON manifest; ValueError without one."""
    row = spark.read.schema("prepared_path string").json(manifest, multiLine=True).first()
    if row is None or not row.prepared_path:
        raise ValueError(f"{manifest} names no prepared_path")
    return row.prepared_path


def splits(spark: SparkSession, path: str) -> DataFrame:
    """episode_id, split of a file {split: [ids]}; of an id in several splits the last holds."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<bigint>>").alias("m"))
    each = whole.select(F.posexplode(F.map_entries("m")).alias("place", "e")).select("place", F.col("e.key").alias("split"), F.explode("e.value").alias("episode_id"))
    return each.groupBy("episode_id").agg(F.max_by("split", "place").alias("split"))


def episodes(spark: SparkSession, path: str) -> DataFrame:
    """episode_id and step rows of a file {id: episode}, with the features of the next step."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", EPISODES).alias("m"))
    e = whole.select(F.explode("m").alias("episode_id", "e"))
    s = e.select("episode_id", F.col("e.instruction").alias("goal"), "e.app", "e.domain", "e.split", F.posexplode_outer("e.steps").alias("step_index", "step"), F.col("e.steps").alias("steps"))
    return s.select("episode_id", "goal", "app", "domain", "split", "step_index", "step.*", F.get("steps", F.col("step_index") + 1)["image_path"].alias("next_image_path"))


def annotations(spark: SparkSession, glob: str) -> DataFrame:
    """Steps of side files whose names hold an episode's id; of a step given twice the last holds."""
    files = spark.read.text(glob, wholetext=True).select(F.nullif(F.regexp_extract(F.input_file_name(), ID, 1), F.lit("")).alias("episode_id"), F.from_json("value", ANNOTATION).alias("a"))
    each = files.where("episode_id is not null").select("episode_id", F.posexplode("a.steps").alias("place", "s"))
    return each.groupBy("episode_id", F.col("s.step_id").alias("step_id")).agg(F.max_by("s", "place").alias("annotation"))


def annotated(spark: SparkSession, episode_file: str, annotation_glob: str) -> DataFrame:
    return episodes(spark, episode_file).join(annotations(spark, annotation_glob), ["episode_id", "step_id"], "left")


ELEMENTS = "array<struct<bbox: array<int>, xml_desc: array<string>, functionality: string>>"
TASKS = "array<struct<app: string, split: string, k_shot: int, query: struct<episode_id: string>, support: array<struct<episode: struct<episode_id: string>>>>>"


def screens(spark: SparkSession, glob: str) -> DataFrame:
    """stem, page_caption and groups of elements of annotation files, one a picture, by the file's name without its ending."""
    files = spark.read.text(glob, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1).alias("stem"), "value")
    groups = F.map_filter(F.from_json("value", "map<string, string>"), lambda k, v: F.coalesce(v.startswith("["), F.lit(False)))
    return files.select("stem", F.get_json_object("value", "$.page_caption").alias("page_caption"), F.transform_values(groups, lambda k, v: F.from_json(v, ELEMENTS)).alias("screen"))


def with_screens(steps: DataFrame, annotated: DataFrame, path: str = "image_path") -> DataFrame:
    """steps with the annotation of their picture by its stem; null without one."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return steps.withColumn("stem", stem).join(annotated, "stem", "left").drop("stem")


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """task_id (place in the file), app, split, k_shot, query and support (array of ids) of a file of few-shot tasks."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", TASKS)).alias("task_id", "t"))
    return whole.select("task_id", "t.app", "t.split", "t.k_shot", F.col("t.query.episode_id").alias("query"), F.transform("t.support", lambda s: s["episode"]["episode_id"]).alias("support"))


def chosen_episodes(rows: DataFrame, split: str | None = None, app: str | None = None, most: int | None = None) -> DataFrame:
    """Rows of the first `most` episodes by id of a split and an app; None takes all."""
    for name, value in (("split", split), ("app", app)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    if most is None:
        return rows
    return rows.join(rows.select("episode_id").distinct().orderBy("episode_id").limit(most), "episode_id", "left_semi")
