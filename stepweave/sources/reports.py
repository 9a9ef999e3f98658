"""Reports of runs: partial reports of workers and their merge, sections of Markdown, lines and summaries.

Partial reports are JSON lines, a folder per worker; counters add up and ratios are made
anew, never averaged. Summaries are a handful of rows, made on the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.operators.scoring import reduction

# Counters of a report that add up, by method.
TOKENS = ("tokens_total", "tokens_input_text", "tokens_visual", "tokens_output")
LATENCY = "end_to_end_latency_ms_total"
COUNTERS = tuple(f"{m}_{k}" for k in (*TOKENS, LATENCY) for m in ("baseline", "hybrid"))
RATIOS = {"total_token_reduction": "tokens_total", "input_text_token_reduction": "tokens_input_text", "visual_token_reduction": "tokens_visual", "output_token_reduction": "tokens_output", "latency_reduction": LATENCY}


def counters(results: DataFrame, *keys: str) -> DataFrame:
    """The ten counters of step_results by keys: tokens (input text, visual, output, total) and latency per method. The table has no visual tokens; they count 0."""
    def of(method: str, value: Column) -> Column:
        return F.sum(F.when(F.col("method") == method, value).otherwise(F.lit(0)))

    prompt, output = F.coalesce(F.col("prompt_tokens"), F.lit(0)).cast("bigint"), F.coalesce(F.col("generated_tokens"), F.lit(0)).cast("bigint")
    ms = F.when((F.col("latency_ms") >= 0) & (F.col("latency_ms") < 1e12) & ~F.isnan("latency_ms"), F.col("latency_ms")).otherwise(F.lit(0.0)).cast("decimal(30,4)")
    parts = {"tokens_total": prompt + output, "tokens_input_text": prompt, "tokens_visual": F.lit(0).cast("bigint"), "tokens_output": output, LATENCY: ms}
    return results.groupBy(*keys).agg(*[of(m, v).alias(f"{m}_{k}") for k, v in parts.items() for m in ("baseline", "hybrid")])


def merged_counters(partials: DataFrame, *keys: str) -> DataFrame:
    """Partial counters added up (null as 0), with the five reductions made of the sums."""
    whole = partials.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])
    ratio = lambda k: F.round(reduction(F.col(f"hybrid_{k}").cast("double"), F.col(f"baseline_{k}").cast("double")), 6)
    return whole.select(*keys, *[F.col(c).cast("double").alias(c) if LATENCY in c else F.col(c).cast("bigint").alias(c) for c in COUNTERS], *[ratio(k).alias(name) for name, k in RATIOS.items()])


def write_partial(rows: DataFrame, folder: str, worker: int) -> None:
    """A worker's detail rows."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{folder.rstrip('/')}/worker={worker}")


def read_partials(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(detail rows of all workers with `worker`; worker, n of unreadable lines)."""
    lines = spark.read.text(folder)
    if "worker" not in lines.columns:
        raise ValueError(f"{folder} has no folders of workers")
    parsed = lines.select("worker", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = parsed.where("r is not null and r._bad is null").select("worker", "r.*").drop("_bad")
    bad = parsed.where("r is null or r._bad is not null").groupBy("worker").agg(F.count("*").alias("n"))
    return good, bad


def in_rank_order(rows: DataFrame, *order: str) -> DataFrame:
    """Rows of all workers as one list: by worker, then by their own order."""
    return rows.orderBy("worker", *order)


def step_report(rows: DataFrame, path: str, version: int = 1) -> None:
    """{format_version, step_count, steps} as one JSON text a task: the rows of a task are a list, their count and the version stand beside it."""
    steps = rows.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("step_index", *[c for c in rows.columns if c not in ("episode_id", "step_index")]))).alias("steps"))
    steps.select(F.to_json(F.struct(F.lit(version).alias("format_version"), F.size("steps").alias("step_count"), "episode_id", "steps")).alias("value")).write.mode("overwrite").text(path)


def with_section(text: str, name: str, body: str) -> str:
    """A Markdown text whose section of a name, between its markers, is replaced, or added at the end; the same call again changes nothing."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    section = f"{begin}\n{body.strip()}\n{end}"
    if begin in text and end in text:
        return re.sub(re.escape(begin) + ".*?" + re.escape(end), lambda _: section, text, count=1, flags=re.S)
    return f"{text.rstrip()}\n\n{section}\n" if text.strip() else f"{section}\n"


def with_field(text: str, name: str, value: str) -> str:
    """A Markdown list whose line `- name: ...` has a new value; added at the end if there is none."""
    line = f"- {name}: {value}"
    pattern = re.compile(rf"^- {re.escape(name)}:.*$", re.M)
    return pattern.sub(lambda _: line, text, count=1) if pattern.search(text) else f"{text.rstrip()}\n{line}\n".lstrip()


def upserted(pointers: Mapping[str, Any], **entries: Any) -> dict[str, Any]:
    """Pointers with some entries new."""
    return {**pointers, **entries}


def nested_field(report: Mapping[str, Any], path: str, default: Any = None) -> Any:
    """A value of nested objects by its dotted path; the default where it is missing or null."""
    here: Any = report
    for key in path.split("."):
        here = here.get(key) if isinstance(here, Mapping) else None
    return default if here is None else here


def summary(report: Mapping[str, Any]) -> dict[str, Any]:
    """The flat summary of a report: number of steps, accuracies by subset, tokens per step, reductions, speed-up; null where nothing is told."""
    n = nested_field(report, "result_count", 0)
    of = lambda k: nested_field(report, f"controller_metrics.{k}")
    per_step = lambda k: None if of(k) is None else of(k) / max(1, n)
    hybrid, baseline = of(f"hybrid_{LATENCY}"), of(f"baseline_{LATENCY}")
    return {
        "benchmark": nested_field(report, "benchmark"), "steps": n, "accuracy": {k: v for k, v in (nested_field(report, "official_metrics", {}) or {}).items()},
        "baseline_tokens_per_step": per_step("baseline_tokens_total"), "hybrid_tokens_per_step": per_step("hybrid_tokens_total"), "speed_up": baseline / hybrid if baseline is not None and hybrid else None,
        **{k: of(k) for k in RATIOS},
    }


def share(value: float | None) -> str:
    return "N/A" if value is None else f"{value * 100:.2f}%"


def summary_lines(s: Mapping[str, Any], most: int = 80) -> list[str]:
    """A summary as lines, at most so many."""
    lines = [f"benchmark: {s.get('benchmark') or 'N/A'}", f"steps: {s.get('steps', 0)}"]
    for subset, metrics in sorted((s.get("accuracy") or {}).items()):
        for method in ("baseline", "hybrid"):
            lines += [f"{subset} {method} {name}: {share(v)}" for name, v in sorted((metrics.get(method) or {}).items())]
    for k in ("baseline_tokens_per_step", "hybrid_tokens_per_step"):
        lines.append(f"{k}: " + ("N/A" if s.get(k) is None else f"{s[k]:.1f}"))
    lines += [f"{k}: {share(s.get(k))}" for k in RATIOS]
    lines.append("speed_up: " + ("N/A" if s.get("speed_up") is None else f"{s['speed_up']:.2f}x"))
    return lines[:most]


def by_order(names: list[str], first: list[str]) -> list[str]:
    """Names in a given order, then the others by the alphabet."""
    return [n for n in first if n in names] + sorted(n for n in names if n not in first)


def dump(value: Mapping[str, Any]) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True)


def write_summaries(spark: SparkSession, folder: str, report: Mapping[str, Any]) -> dict[str, str]:
    """The report, its summary and its lines in a folder of a run, and where they are."""
    from stepweave.sources.config import write_json

    s = summary(report)
    paths = {k: f"{folder.rstrip('/')}/{k}" for k in ("report", "summary", "lines")}
    write_json(spark, paths["report"], report)
    write_json(spark, paths["summary"], s)
    spark.createDataFrame([("\n".join(summary_lines(s)),)], "value string").coalesce(1).write.mode("overwrite").text(paths["lines"])
    return paths


def read_runs(spark: SparkSession, glob: str, *status: str) -> DataFrame:
    """path, status and text of the pointer files of runs, of some states if any are named."""
    runs = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("path"), F.get_json_object("value", "$.status").alias("status"), "value")
    return runs.where(F.col("status").isin(*status)) if status else runs


def json_state(spark: SparkSession, path: str) -> str:
    """missing, unreadable, no object or object: what a report's path holds."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return "missing"
    text = spark.read.text(path, wholetext=True).first()
    try:
        value = json.loads(text[0]) if text else None
    except ValueError:
        return "unreadable"
    return "object" if isinstance(value, dict) else "no object"
