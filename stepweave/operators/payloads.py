"""Calls within model outputs, repair of JSON that was cut off, and scans of nested keys."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stepweave.operators.actions import canonical_type
from stepweave.operators.shred import content


def tool_call(output: Column) -> Column:
    """The body of the first tool call of an output; null without a closed one."""
    return F.nullif(F.regexp_extract(output, r"(?is)<tool_call>\s*(.*?)\s*</tool_call>", 1), F.lit(""))


def from_tool_call(body: Column) -> Column:
    """struct<action_type, x, y, argument> of a call's JSON body."""
    v = F.try_parse_json(body)
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    argument = F.coalesce(*(get(f"$.arguments.{k}") for k in ("text", "direction", "app_name", "goal_status")))
    return F.struct(canonical_type(get("$.arguments.action")).alias("action_type"), get("$.arguments.coordinate[0]", "double").alias("x"), get("$.arguments.coordinate[1]", "double").alias("y"), argument.alias("argument"))


_STEP = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]|"(?:[^"\\]|\\.)*\\?$', re.S)


def repair(text: str | None) -> str | None:
    """A JSON object closed after its last complete member; null if nothing of one is there.

    An open string is closed where its end is all that is missing of a value; a key without
    a value, a dangling comma and a half-written number or word are dropped.
    """
    if not text or "{" not in text:
        return None
    text = text[text.index("{") :]
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    stack: list[str] = []
    for m in _STEP.finditer(text):
        s = m.group()
        if s in "{[":
            stack.append("}" if s == "{" else "]")
        elif s in "}]" and stack:
            stack.pop()
            if not stack:
                return _valid(text[: m.end()])
    tail = text.rstrip()
    if re.search(r'(?<!\\)"(?:[^"\\]|\\.)*\\?$', tail) and tail.count('"') - len(re.findall(r'\\"', tail)) & 1:
        tail = tail.rstrip("\\") + '"'
    closing = "".join(reversed(stack))
    for _ in range(4):
        if found := _valid(tail + closing):
            return found
        # drop what can't stand at an end: a comma, a colon with its key, a lone key, half a word
        shorter = re.sub(r'(?:,\s*"(?:[^"\\]|\\.)*"\s*:?\s*|(?<=[{\[])\s*"(?:[^"\\]|\\.)*"\s*:?\s*|,\s*|"(?:[^"\\]|\\.)*"\s*:\s*|[-\w.+]+)$', "", tail)
        if shorter == tail:
            return None
        tail = shorter
    return None


def _valid(text: str) -> str | None:
    try:
        json.loads(text)
        return text
    except ValueError:
        return None


@F.pandas_udf(StringType())
def repaired(text: pd.Series) -> pd.Series:
    return text.map(lambda t: repair(t) if isinstance(t, str) else None)


def key_paths(df: DataFrame, key: str, payload: str) -> DataFrame:
    """record_id, path, kind of every key of every payload: paths with [] for array elements, each path and kind once a record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, p in zip(b.k, b.p):
                found: set[tuple[str, str]] = set()
                stack: list[tuple[str, Any]] = [("", content(p))]
                while stack:
                    path, value = stack.pop()
                    if isinstance(value, dict):
                        for name, inner in value.items():
                            at = f"{path}.{name}" if path else name
                            found.add((at, type(inner).__name__))
                            stack.append((at, inner))
                    elif isinstance(value, list):
                        stack += [(f"{path}[]", x) for x in value]
                rows += [(k, path, kind) for path, kind in sorted(found)]
            out = pd.DataFrame(rows, columns=["record_id", "path", "kind"])
            out["record_id"] = out["record_id"].astype("Int64")
            yield out

    return df.select(F.col(key).cast("bigint").alias("k"), F.col(payload).alias("p")).where("p is not null").mapInPandas(run, "record_id bigint, path string, kind string")


# Keys that a step's input must not have, as they tell what comes after it.
FORBIDDEN = ("future_annotation", "future_annotations", "future_trajectory", "next_step", "next_step_sketch", "teacher", "teacher_annotation", "teacher_annotations", "teacher_only")
FORBIDDEN_PREFIXES = ("future_", "next_step_", "teacher_")


def leaking_paths(paths: DataFrame) -> DataFrame:
    """Paths whose last key tells of the future."""
    last = F.regexp_extract("path", r"([^.\[\]]+)(?:\[\])*$", 1)
    return paths.where(last.isin(*FORBIDDEN) | last.rlike("^(" + "|".join(FORBIDDEN_PREFIXES) + ")"))


def is_forbidden(key: str) -> bool:
    """Whether a key of a step's input tells of the future."""
    return key in FORBIDDEN or key.startswith(FORBIDDEN_PREFIXES)


def violations(value: Any, path: str = "") -> list[str]:
    """Paths of such keys in a nested value, with positions, in the order of the value; no recursion."""
    out: list[str] = []
    stack: list[tuple[str, Any]] = [(path, value)]
    while stack:
        at, here = stack.pop()
        if isinstance(here, dict):
            inner = [(f"{at}.{k}" if at else str(k), str(k), v) for k, v in here.items()]
        elif isinstance(here, (list, tuple)):
            inner = [(f"{at}[{i}]", "", v) for i, v in enumerate(here)]
        else:
            continue
        out += [p for p, k, _ in inner if k and is_forbidden(k)]
        stack += [(p, v) for p, _, v in reversed(inner)]
    return out


def assert_clean(df: DataFrame, key: str, payload: str) -> None:
    """ValueError with some of the paths if any payload has a key that tells of the future."""
    found = leaking_paths(key_paths(df, key, payload)).limit(5).collect()
    if found:
        raise ValueError("keys of the future: " + ", ".join(f"{r.record_id}: {r.path}" for r in found))


def assert_artifact_clean(artifact: dict[str, Any]) -> None:
    """The same for a compound object of features: its objects, and the lists of feature names in it."""
    names = [f"{part}.feature_names[{n}]" for part, v in artifact.items() if isinstance(v, dict) for n in v.get("feature_names") or () if is_forbidden(str(n))]
    if found := violations(artifact) + names:
        raise ValueError("keys of the future: " + ", ".join(found))
