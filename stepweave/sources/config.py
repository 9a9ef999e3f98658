"""Settings: .env files, JSON configurations in layers, file listings held against what should be there."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = re.compile(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$")
_NAME = re.compile(r"\$(?:\{(\w+)\}|(\w+))")


def env_values(text: str, known: Mapping[str, str] | None = None) -> dict[str, str]:
    """Names and values of a .env file: export, quotes, $NAME and ${NAME} from what is known or stands before (not in single quotes); the first value of a name holds."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        m = _LINE.match(line)
        if not m or line.lstrip().startswith("#"):
            continue
        name, value = m.groups()
        quote = value[:1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else ""
        value = value[1:-1] if quote else re.split(r"\s+#", value)[0]
        if quote != "'":
            value = _NAME.sub(lambda x: (known or {}).get(x[1] or x[2]) or out.get(x[1] or x[2], ""), value)
        out.setdefault(name, value)
    return out


def path_of(key: str, names: Mapping[str, str], env: Mapping[str, str]) -> str:
    """The path that the environment gives for a key (names: key to variable); ValueError without one."""
    found = env.get(names.get(key, ""))
    if not found:
        raise ValueError(f"no path for {key}: set {names.get(key, 'a variable for it')}")
    return found


def read_config(spark: SparkSession, path: str, benchmark: str | None = None) -> dict[str, Any]:
    """A JSON object from any file system; ValueError for another root or another benchmark than the one asked for."""
    text = spark.read.text(path, wholetext=True).first()
    value = json.loads(text[0]) if text else None
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no JSON object")
    if benchmark is not None and value.get("benchmark") != benchmark:
        raise ValueError(f"{path} is for {value.get('benchmark')}, not {benchmark}")
    return value


def layered(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Settings of several layers, the later over the earlier; null overrides nothing, objects are merged key by key."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in layer.items():
            if isinstance(v, Mapping) and isinstance(out.get(k), Mapping):
                out[k] = layered(out[k], v)
            elif v is not None:
                out[k] = v
    return out


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name and size of the files of a folder that match, in order; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size")).orderBy("name")


def reconciled(expected: DataFrame, present: DataFrame) -> DataFrame:
    """name, expected, present, state of every file of either listing: verified, mismatched, missing or unexpected."""
    e, p = expected.select("name", F.col("size").alias("expected")), present.select("name", F.col("size").alias("present"))
    state = F.when(F.col("expected").isNull(), "unexpected").when(F.col("present").isNull(), "missing").when(F.col("expected") == F.col("present"), "verified").otherwise("mismatched")
    return e.join(p, "name", "full").withColumn("state", state)


def required(present: DataFrame, names: list[str]) -> None:
    """ValueError that names what a listing lacks of some required files."""
    found = {r.name for r in present.where(F.col("name").isin(names)).select("name").distinct().collect()}  # at most as many as names
    if lacking := [n for n in names if n not in found]:
        raise ValueError("missing: " + ", ".join(lacking))


def complete_images(n: Column, present: Column) -> Column:
    """Whether the pictures 0 to n - 1 are all in an array of numbers."""
    return (n <= 0) | F.forall(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1)), lambda i: F.array_contains(present, i))


def fallback_metadata(fragments: Column, status: Column, error: Column, most: int = 32) -> Column:
    """struct of what is known of a screen whose tree could not be read: text fragments only, and why."""
    # What is said of a status.
    warning = F.when(status == "proto_unavailable", "AndroidControl accessibility proto support is unavailable; continuing with text-only fallback.").when(status == "parse_failed", "AndroidControl accessibility parsing failed; continuing with text-only fallback.")
    degraded = status != "parsed"
    return F.struct(F.slice(fragments, 1, most).alias("fragments"), F.lit(0).alias("nodes"), F.lit(0).alias("actionable"), status.alias("status"), error.alias("error"), degraded.alias("degraded"), degraded.alias("fallback_used"), warning.alias("warning"))


def manifest(spark: SparkSession, path: str, shards: int, **entries: str) -> None:
    """A JSON manifest with the number of shards, written as a folder of one file."""
    write_json(spark, path, {**entries, "shards": shards})


def write_json(spark: SparkSession, path: str, value: Mapping[str, Any]) -> None:
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def valid_cache(entry: Mapping[str, Any], benchmark: str, manifest_path: str, version: int) -> bool:
    """Whether a stored result belongs to this benchmark, manifest and version."""
    return (entry.get("benchmark"), entry.get("manifest"), entry.get("version")) == (benchmark, manifest_path, version)


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end: what a stage that may be skipped asks for."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def once(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at a path; made and written if it is not there whole."""
    if not is_done(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
