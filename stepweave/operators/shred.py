"""Columnar shredding of nested JSON with repetition and definition levels.

A shape names the repeated groups of a document. Its outermost group may nest in itself
(`children` of nodes, `actions` of actions). Shredding walks a document once and writes,
for each leaf path of the recursive group, a column of entries (repetition level,
definition level, value): the definition level says how many repeated ancestors of the
entry exist, the repetition level at which of them the path begins anew. The flat tables
come from the level sequences alone: an entry whose repetition level is that of an outer
group opens a new row of that group, and the parent of an entry of definition level d is
the latest entry of level d - 1.

Defined results: null, blank or unreadable text, text that holds no object, and null or
scalar elements give no row (positions of array elements still count them); JSON within a
string is read as its content, also repeatedly; a single object stands for an array of
one; child ids that name no node, name their own node or one that has a parent already are
ignored. Columns of the input that clash with output names are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.cluster import spread


@dataclass(frozen=True)
class Shape:
    """Keys of the outer repeated group, of its content, of the recursive group, and its leaves.

    outer: key of the repeated outer group, or None if the document is the group's content.
    through: keys that hold the content of an outer element, in any order.
    entries: keys of the recursive group within that content; with none, the content is the entry.
    nested: key of the recursive group within an entry.
    ids: keys of an entry's own id and of its list of child ids, or None.
    marker: a key that an object must have to be an entry, or None.
    leaves: keys whose values become columns (as JSON text for arrays and objects).
    """

    outer: str | None
    through: tuple[str, ...]
    entries: tuple[str, ...]
    nested: str
    ids: tuple[str, str] | None
    marker: str | None
    leaves: tuple[str, ...]


UI_TREE = Shape("windows", ("tree",), ("nodes", "root"), "children", ("unique_id", "child_ids"), None, ("class_name", "text", "content_description", "view_id_resource_name", "clickable", "editable", "scrollable", "checkable", "checked", "visible", "enabled", "focusable", "depth", "bbox"))
ACTION = Shape(None, (), (), "actions", None, "action_type", ("action_type", "x", "y", "direction", "text", "app_name", "goal_status", "seconds", "times"))

_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\]:,])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity))', re.S)


def _loads_deep(text: str) -> Any:
    """json.loads without recursion, for documents nested deeper than the C parser allows."""
    stack: list[tuple[Any, Any]] = []
    root: list = []
    here: Any = root
    key: Any = None
    expect, at, end = "value", 0, len(text.rstrip(" \t\r\n"))
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("not JSON")
        at = m.end()
        sign, string, other = m.groups()
        if expect == "done":
            raise ValueError("text after the document")
        if isinstance(here, dict) and here is not root and expect in ("key", "key_or_end"):
            if string:
                key, expect = json.loads(string), "colon"
                continue
            if sign != "}" or expect == "key":
                raise ValueError("key expected")
        elif expect == "colon":
            if sign != ":":
                raise ValueError("colon expected")
            expect = "value"
            continue
        elif expect == "next":
            if sign == ",":
                expect = "key" if isinstance(here, dict) else "value"
                continue
            if sign != ("}" if isinstance(here, dict) else "]"):
                raise ValueError("comma expected")
        if sign in ("}", "]") and expect in ("key_or_end", "next", "value_or_end"):
            if isinstance(here, dict) != (sign == "}"):
                raise ValueError("wrong bracket")
            here, key = stack.pop()
            expect = "done" if here is root else "next"
            continue
        if expect not in ("value", "value_or_end") or sign in ("}", "]", ":", ","):
            raise ValueError("value expected")
        value = {} if sign == "{" else [] if sign == "[" else json.loads(string or other)
        if isinstance(here, dict):
            here[key] = value
        else:
            here.append(value)
        if sign:
            stack.append((here, key))
            here, expect = value, "key_or_end" if sign == "{" else "value_or_end"
        else:
            expect = "done" if here is root else "next"
    if expect != "done":
        raise ValueError("it ends early")
    return root[0]


def content(value: Any) -> Any:
    """The value that a text stands for, read again while it is a string; None if it can't be read."""
    while isinstance(value, (str, bytes)):
        try:
            text = (value.decode("utf-8") if isinstance(value, bytes) else value).lstrip("﻿")
            try:
                value = json.loads(text)
            except RecursionError:
                value = _loads_deep(text)
        except ValueError:
            return None
    return value


def _members(value: Any) -> list:
    value = content(value)
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def shred(document: Any, shape: Shape, groups: bool = False) -> list[tuple[int, int, int, dict]]:
    """(repetition level, definition level, position in the outer group, entry) in the order of the text.

    The entry is the object that the leaf columns of the group are taken from (`columns`).
    Levels: 0 the document, 1 the outer group, 2 an entry, 3 one nested in it, and so on.
    With groups the objects of the outer group are entries of level 1, before their own.
    """
    document = content(document)
    out: list[tuple[int, int, int, dict]] = []
    if shape.outer is None:
        outers = [document]
    elif isinstance(document, dict) and shape.outer not in document and any(k in document for k in shape.through + shape.entries):
        outers = [document]
    else:
        outers = _members(document.get(shape.outer)) if isinstance(document, dict) else _members(document)
    for no, outer in enumerate(outers):
        outer = content(outer)
        tops: list = []
        if shape.outer is None:
            tops = _members(outer)
        elif isinstance(outer, dict):
            for key, inner in outer.items():
                if key in shape.entries:
                    tops += _members(inner)
                elif key in shape.through:
                    inner = content(inner)
                    if isinstance(inner, list):
                        tops += inner
                    elif isinstance(inner, dict):
                        for k, v in inner.items():
                            if k in shape.entries:
                                tops += _members(v)
        first = True
        if groups and isinstance(outer, dict):
            out.append((1 if out else 0, 1, no, outer))
            first = False
        # entries that begin later lie deeper in the stack, so that they come out in text order
        stack = [(2, x) for x in reversed(tops)]
        while stack:
            level, entry = stack.pop()
            entry = content(entry)
            if isinstance(entry, list):
                stack += [(level, x) for x in reversed(entry)]
                continue
            if not isinstance(entry, dict):
                continue
            counts = shape.marker is None or shape.marker in entry
            if counts:
                out.append(((0 if no == 0 or not out else 1) if first else level, level, no, entry))
                first = False
            if shape.nested in entry:
                stack += [(level + counts, x) for x in reversed(_members(entry[shape.nested]))]
    return out


def columns(entries: list[tuple[int, int, int, dict]], leaves: tuple[str, ...]) -> dict[str, list[tuple[int, int, Any]]]:
    """(repetition level, definition level, value) of every entry, leaf by leaf.

    A leaf is optional and may be null: its definition level is that of its entry if it is
    absent, one more if it is null, two more if it has a value. All leaves of a group have
    the same repetition levels.
    """
    out: dict[str, list[tuple[int, int, Any]]] = {}
    for leaf in leaves:
        out[leaf] = [(r, d + (0 if leaf not in e else 1 if e[leaf] is None else 2), e.get(leaf)) for r, d, _, e in entries]
    return out


def assemble(entries: list[tuple[int, int, int, dict]], shape: Shape) -> Iterator[tuple[int, int, int, dict]]:
    """(outer position, number within it, parent's number or -1, entry), from the level sequence."""
    at = 0
    while at < len(entries):
        no, start, latest = entries[at][2], at, {}
        parents: list[int] = []
        while at < len(entries) and (at == start or entries[at][0] > 1):
            level = entries[at][1]
            parents.append(latest.get(level - 1, -1))
            latest[level] = at - start
            for deeper in [k for k in latest if k > level]:
                del latest[deeper]
            at += 1
        if shape.ids:
            own, kids = shape.ids
            number: dict[str, int] = {}
            for i in range(at - start):
                value = entries[start + i][3].get(own)
                if value is not None and not isinstance(value, (dict, list)):
                    number.setdefault(str(value), i)
            if number:
                for i in range(at - start):
                    listed = entries[start + i][3].get(kids)
                    for value in listed if isinstance(listed, list) else [listed]:
                        child = number.get(str(value)) if value is not None and not isinstance(value, dict) else None
                        if child is not None and child != i and parents[child] == -1:
                            parents[child] = i
        for i in range(at - start):
            yield no, i, parents[i], entries[start + i][3]


def _text(value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return json.dumps(value, ensure_ascii=False)


def flatten(df: DataFrame, key: str, step: str, payload: str, shape: Shape, leaves: bool | tuple[str, ...] = False) -> DataFrame:
    """One row per entry of each payload: record_id, step_index, window_no, node_no, parent_no, and its leaves as text.

    df holds one document per row; key, step and payload name its columns; leaves: all of the
    shape's, none, or the named ones.
    """
    names = leaves if isinstance(leaves, tuple) else shape.leaves if leaves else ()
    schema = "record_id bigint, step_index int, window_no int, node_no int, parent_no int" + "".join(f", {n} string" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] + [pa.int32()] * 4 + [pa.string()] * len(names)
        labels = ["record_id", "step_index", "window_no", "node_no", "parent_no", *names]
        for batch in batches:
            rows: list[list] = [[] for _ in labels]
            for k, s, p in zip(*(c.to_pylist() for c in batch.columns)):
                if p is None:
                    continue
                entries = shred(p, shape)
                for no, i, parent, _ in assemble(entries, shape):
                    for column, value in zip(rows, (k, s, no, i, parent)):
                        column.append(value)
                # rows of the group and entries of its leaves stand in one order
                for column, leaf in zip(rows[5:], columns(entries, names).values()):
                    column.extend(_text(value) for _, _, value in leaf)
                if len(rows[0]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=labels)
                    rows = [[] for _ in labels]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=labels)

    return df.select(F.col(key).cast("bigint").alias("k"), F.col(step).cast("int").alias("s"), F.col(payload).alias("p")).where("p is not null").mapInArrow(run, schema)


def tree_rows(records: DataFrame) -> DataFrame:
    """One row per step's tree: record_id, step_index (position from 0, nulls counted), tree."""
    return spread(records.select("record_id", "accessibility_trees")).select("record_id", F.posexplode("accessibility_trees").alias("step_index", "tree"))


def ui_nodes(records: DataFrame, leaves: bool | tuple[str, ...] = False) -> DataFrame:
    """Flat UI nodes of android_records."""
    return flatten(tree_rows(records), "record_id", "step_index", "tree", UI_TREE, leaves)


def action_objects(steps: DataFrame, leaves: bool | tuple[str, ...] = False) -> DataFrame:
    """Flat action objects of the raw_action payloads of steps."""
    return flatten(spread(steps.select("step_id", "step_index", "raw_action")), "step_id", "step_index", "raw_action", ACTION, leaves)


def action_paths(steps: DataFrame, most: int = 1 << 24) -> DataFrame:
    """Of every action object of raw_action: record_id, node_no, depth from its payload's root, and path of numbers from there.

    A parent stands before what it holds, so that one pass over a payload does for any depth
    and any number of rows. A batch ends after `most` characters of paths.
    """
    names, types = ["record_id", "node_no", "depth", "path"], [pa.int64(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, types)], names=names)
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for k, p in zip(*(c.to_pylist() for c in batch.columns)):
                above: list[tuple[int, str]] = []  # from the root to the latest object
                for _, i, parent, _ in assemble(shred(p, ACTION), ACTION):
                    while above and above[-1][0] != parent:
                        above.pop()
                    path = f"{above[-1][1]}/{i}" if above else str(i)
                    rows.append((k, i, len(above), path))
                    above.append((i, path))
                    size += len(path)
                    if size >= most or len(rows) >= 50_000:
                        yield pack(rows)
                        rows, size = [], 0
            yield pack(rows)

    payloads = spread(steps.select("step_id", "raw_action")).where("raw_action is not null")
    return payloads.select(F.col("step_id").cast("bigint").alias("k"), F.col("raw_action").alias("p")).mapInArrow(run, "record_id bigint, node_no int, depth int, path string")


def ui_windows(records: DataFrame) -> DataFrame:
    """Flat windows: record_id, step_index, window_no, title, type, n_nodes (readable ones), from the levels: a window is an entry of level 1, its nodes those before the next one."""
    shape, names = UI_TREE, ["record_id", "step_index", "window_no", "title", "type", "n_nodes"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = []
            for k, s, p in zip(*(c.to_pylist() for c in batch.columns)):
                entries = shred(p, shape, groups=True)
                leaves = columns(entries, ("title", "type"))
                for i, (_, level, no, _) in enumerate(entries):
                    if level == 1:
                        rows.append([k, s, no, *(_text(c[i][2]) for c in leaves.values()), 0])
                    elif rows:
                        rows[-1][5] += 1
            out = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return tree_rows(records).where("tree is not null").mapInArrow(run, "record_id bigint, step_index int, window_no int, title string, type string, n_nodes int")
