"""Shredding against a recursive walk, and its edge cases."""

import json
import random

import pytest
from pyspark.sql import types as T

from stepweave.operators.shred import ACTION, UI_TREE, _loads_deep, action_objects, action_paths, assemble, columns, content, shred, ui_nodes, ui_windows


def walk(document):
    """Straightforward recursion, for nested trees only."""
    out = []
    for w, window in enumerate(document["windows"]):
        count = 0

        def visit(node, parent):
            nonlocal count
            mine = count
            count += 1
            out.append((w, mine, parent))
            for child in node.get("children", []):
                visit(child, mine)

        for node in window["tree"]["nodes"]:
            visit(node, -1)
    return out


def grow(rng, depth=0):
    node = {"text": "x"}
    if depth < 4 and rng.random() < 0.7:
        node["children"] = [grow(rng, depth + 1) for _ in range(rng.randrange(4))]
    return node


def rows(document, shape=UI_TREE):
    return [r[:3] for r in assemble(shred(document, shape), shape)]


@pytest.mark.parametrize("seed", range(20))
def test_like_recursion(seed):
    rng = random.Random(seed)
    document = {"windows": [{"tree": {"nodes": [grow(rng) for _ in range(rng.randrange(4))]}} for _ in range(3)]}
    assert rows(json.dumps(document)) == walk(document)
    assert rows(json.dumps(json.dumps(document))) == walk(document)


def test_levels():
    document = {"windows": [{"tree": {"root": {"children": [{}, {"children": {}}]}}}, {"tree": {"nodes": {}}}]}
    assert [(r, d) for r, d, _, _ in shred(document, UI_TREE)] == [(0, 2), (3, 3), (3, 3), (4, 4), (1, 2)]
    assert rows(document) == [(0, 0, -1), (0, 1, 0), (0, 2, 0), (0, 3, 2), (1, 0, -1)]


def test_ids_strings_and_single_objects():
    nodes = [{"unique_id": 5, "child_ids": []}, {"unique_id": 1, "child_ids": [5, "7", 99, 1]}, None, {"unique_id": 7}]
    document = {"windows": [None, {"tree": json.dumps({"nodes": nodes})}]}
    assert rows(document) == [(1, 0, 1), (1, 1, -1), (1, 2, 1)]


@pytest.mark.parametrize("text", [None, "", "  ", "null", "3", "{", b"\xff\xfe", '{"windows": null}', '{"windows": [{}]}', '{"windows": [{"tree": "{"}]}'])
def test_unreadable(text):
    assert rows(text) == []


def test_actions():
    text = '{"action_type":"macro","meta":{"points":[{"action_type":"no"}]},"actions":[{"action_type":"click"},{"actions":{"action_type":"wait"}}]}'
    assert rows(text, ACTION) == [(0, 0, -1), (0, 1, 0), (0, 2, 0)]


def test_deep():
    deep = '{"action_type":"a","actions":[' * 30_000 + "]}" * 30_000
    assert len(rows(deep, ACTION)) == 30_000
    for text in ('{"a": [1, "x\\n", {}, []], "b": -2.5e3}', "[]", '"s"', "true"):
        assert _loads_deep(text) == json.loads(text)
    for text in ('{"a"}', "[1,]", "{} {}", "[", '{"a":1,}'):
        with pytest.raises(ValueError):
            _loads_deep(text)
    assert content('"3"') == 3


def test_tables(spark):
    schema = T.StructType.fromDDL("record_id bigint, accessibility_trees array<binary>, step_index int, tree string, node_no int")
    tree = b'{"windows":{"title":"A","tree":{"nodes":[{"text":"t","children":[{}]}]}}}'
    df = spark.createDataFrame([(1, [None, tree, b"{"], 9, "clash", 4), (2, None, 9, "clash", 4), (None, [tree], 9, "c", 4), (1, [tree], 9, "c", 4)], schema)
    got = sorted(map(tuple, ui_nodes(df).collect()), key=str)
    assert got == sorted([(1, 1, 0, 0, -1), (1, 1, 0, 1, 0), (None, 0, 0, 0, -1), (None, 0, 0, 1, 0), (1, 0, 0, 0, -1), (1, 0, 0, 1, 0)], key=str)
    assert ui_windows(df).count() == 3
    assert ui_nodes(df.limit(0)).collect() == []
    steps = spark.createDataFrame([(7, None, '"{\\"action_type\\": \\"wait\\"}"'), (8, 2, None)], "step_id bigint, step_index int, raw_action string")
    assert [tuple(r) for r in action_objects(steps).collect()] == [(7, None, 0, 0, -1)]


def test_action_paths(spark):
    """Deeper than a recursive query goes by default, siblings at several levels, and batches cut within a payload."""
    deep = '{"action_type": "a", "actions": [' * 300 + '{"action_type": "a"}' + "]}" * 300
    wide = '{"actions": [{"action_type": "a", "actions": [{"action_type": "b", "actions": [{"action_type": "c"}]}, {"action_type": "d"}]}, {"x": 1, "actions": {"action_type": "e"}}]}'
    steps = spark.createDataFrame([(1, deep), (2, wide), (3, None), (4, "no")], "step_id bigint, raw_action string")
    for most in (1 << 24, 5):
        got = sorted(tuple(r) for r in action_paths(steps, most).collect())
        assert [r for r in got if r[0] == 1] == [(1, i, i, "/".join(map(str, range(i + 1)))) for i in range(301)]
        assert [r[1:] for r in got if r[0] > 1] == [(0, 0, "0"), (1, 1, "0/1"), (2, 2, "0/1/2"), (3, 1, "0/3"), (4, 0, "4")]


def test_leaf_levels():
    """Absent, null and given leaves differ in their definition level; windows are entries of level 1."""
    tree = {"windows": [{"title": "a", "tree": {"nodes": [{"text": "x", "children": [{"text": None}]}, {}]}}, {"title": None}, None, {"tree": {"nodes": [{"text": 1}]}}]}
    entries = shred(tree, UI_TREE)
    assert columns(entries, ("text",))["text"] == [(0, 4, "x"), (3, 4, None), (2, 2, None), (1, 4, 1)]
    grouped = shred(tree, UI_TREE, groups=True)
    assert [(r, d, no) for r, d, no, _ in grouped] == [(0, 1, 0), (2, 2, 0), (3, 3, 0), (2, 2, 0), (1, 1, 1), (1, 1, 3), (2, 2, 3)]
    assert [d for _, d, _ in columns(grouped, ("title",))["title"] if d < 4][:1] == [3]
