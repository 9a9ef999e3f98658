"""Canonical records, targets, truth and prediction, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from stepweave.operators import records as R
from stepweave.operators import scoring as C

FIRST = [
    ({"action_type": "click", "x": 5.9, "y": 7}, ("CLICK", None, (4, 6, 6, 8), None, None)), ({"action_type": "click", "x": "5", "y": 7}, ("CLICK", None, None, None, None)), ({"action_type": "LONG_PRESS", "x": 5, "y": 7}, ("LONG_PRESS", None, (4, 6, 6, 8), None, None)),
    ({"action_type": "scroll", "direction": " UP "}, ("SCROLL", None, None, None, "up")), ({"action_type": "open_app", "app_name": "My  App"}, ("NAV", "my app", None, "my app", None)), ({"action_type": "input_text", "text": "A"}, ("TYPE", "a", None, None, None)),
    ({"action_type": "navigate_home"}, ("NAV", "home", None, None, None)), ({"action_type": "navigate_back"}, ("NAV", "back", None, None, None)), ({"action_type": "wait"}, ("WAIT", "wait", None, None, None)), ({"action_type": "wait", "seconds": 0, "duration": 2}, ("WAIT", "2", None, None, None)),
    ({"action_type": "status"}, ("TERMINATE", "successful", None, None, None)), ({"action_type": "terminate", "status": "Failed"}, ("TERMINATE", "failed", None, None, None)), ({"action_type": "macro"}, ("MACRO", None, None, None, None)), ({}, ("", None, None, None, None)),
]


def plain(a):
    return None if a is None else (a.action_type, a.argument, a.box and tuple(a.box), a.app, a.direction)


def payloads(spark, dicts):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(dicts)], "i int, t string").withColumn("v", F.try_parse_json("t"))
    return R.with_fields(df, F.col("v"))


def test_first_actions(spark):
    got = {r.i: plain(r.a) for r in payloads(spark, [p for p, _ in FIRST]).select("i", R.first_action().alias("a")).collect()}
    assert [got[i] for i in range(len(FIRST))] == [w for _, w in FIRST]


SECOND = [
    (("CLICK", None, [5, 6], None, None, None), ("CLICK", None, (4, 5, 6, 7), None, None)), (("FOO", "tap", None, None, None, None), ("CLICK", None, None, None, None)), (("TYPE[ab]", None, None, None, None, None), ("TYPE", "ab", None, None, None)), (("TYPE[ab]", None, None, None, "Z", None), ("TYPE", "z", None, None, None)),
    (("SWIPE[Up]", None, [0, 0], [9, 9], None, [[1, 2], [3, 4]]), ("SCROLL", None, (1, 2, 3, 4), None, "up")), (("SWIPE", None, [0, 0], [5, -5], None, [[0, 0], [0, 0]]), ("SCROLL", None, None, None, "up")), (("x", "SWIPE", [9, 0], [0, 1], None, None), ("SCROLL", None, None, None, "left")),
    (("PRESS_ENTER", None, None, None, None, None), ("NAV", "enter", None, None, None)), (("press_back", None, None, None, None, None), ("NAV", "back", None, None, None)), (("HOME", None, None, None, None, None), ("NAV", "home", None, None, None)), (("TASK_COMPLETE[x]", None, None, None, None, None), ("TERMINATE", "success", None, None, None)),
    (("OTHER[A b]", None, [1, 1], None, None, None), ("OTHER", "a b", (0, 0, 2, 2), None, None)), ((None, None, None, None, None, None), ("", None, None, None, None)),
]


def test_second_actions(spark):
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(SECOND)], "i int, w string, a string, t array<int>, l array<int>, s string, r array<array<int>>")
    got = {r.i: plain(r.x) for r in df.select("i", R.second_action(*(F.col(c) for c in "watlsr")).alias("x")).collect()}
    assert [got[i] for i in range(len(SECOND))] == [w for _, w in SECOND]


def found(label=None, box=None):
    edges = F.lit(None).cast(R.BOX) if box is None else F.struct(*[F.lit(v).alias(k) for k, v in zip("ltrb", box)])
    return F.struct(F.lit(label).cast("string").alias("label"), edges.alias("box"))


def test_targets_and_truth(spark):
    df = payloads(spark, [{"action_type": "click", "x": 5, "y": 6}, {"action_type": "input_text", "text": "T", "bbox": [1, 1, 9, 9], "target_label": "Field"}, {"action_type": "scroll", "direction": "up"}]).withColumn("a", R.first_action())
    rows = df.select("i", R.first_target(F.col("a"), found()).alias("free"), R.first_target(F.col("a"), found("Save", (0, 0, 10, 10))).alias("node"), R.bound(F.col("a"), R.first_target(F.col("a"), found("Save", (0, 0, 10, 10)))).alias("b"), R.first_truth(found("Save", (0, 0, 10, 10))).alias("t")).orderBy("i").collect()
    assert [(r.free.source, r.free.label) for r in rows] == [("action_point", None), ("input_text_target", "field"), ("scroll_action", "up")]
    assert (rows[0].node.label, tuple(rows[0].node.box), tuple(rows[0].b.box)) == ("save", (0, 0, 10, 10), (0, 0, 10, 10))
    assert tuple(rows[0].t.box) == (0, 0, 10, 10) and tuple(rows[1].t.box) == (1, 1, 9, 9) and rows[1].t.text == "t"
    # what the truth's own action predicts matches, except for home and back
    same = df.select(C.first_benchmark(R.first_truth(found()), R.first_prediction(R.bound(F.col("a"), R.first_target(F.col("a"), found())), found())).alias("m")).collect()
    assert all(r.m for r in same)


def test_second_targets(spark):
    elements = "array<struct<box struct<l int, t int, r int, b int>, label string>>"
    df = spark.createDataFrame([("CLICK", [5, 5], [((0, 0, 4, 4), "near"), ((0, 0, 90, 90), "holds"), ((5, 5, 6, 6), "best")]), ("CLICK", [50, 5], [((0, 0, 4, 4), "far"), ((40, 0, 44, 4), "near")]), ("TYPE", [5, 5], []), ("SCROLL", None, []), ("NAV", None, []), ("WAIT", None, [])], f"k string, t array<int>, e {elements}")
    got = [r.x and (r.x.source, r.x.label, r.x.box and tuple(r.x.box)) for r in df.select(R.second_target(R.action(F.col("k"), F.lit("arg")), F.col("t"), F.col("e"), F.lit(100), F.lit(200)).alias("x")).collect()]
    assert got == [("element_annotation", "best", (5, 5, 6, 6)), ("element_annotation", "near", (40, 0, 44, 4)), ("touch_coordinate", None, (4, 4, 6, 6)), ("full_screen", "scroll_region", (0, 0, 100, 200)), ("navigation", "arg", None), None]


def test_step_rows(spark):
    b = lambda *x: [None if s is None else bytearray(s.encode()) for s in x]
    df = spark.createDataFrame([(1, [7], b("go"), b("a1", "a2", "a3"), b("x", "x"), [10, 11, 12, 13], [20], b(None), b("d")), (2, [], [], [], None, None, None, None, None)], "record_id bigint, episode_id array<bigint>, goal array<binary>, actions array<binary>, step_instructions array<binary>, screenshot_widths array<bigint>, screenshot_heights array<bigint>, accessibility_trees array<binary>, screen_descriptions array<binary>")
    got = [(r.step_index, r.instruction, r.raw_action, r.width, r.height, r.next_width, r.high_level_index, r.n_screens) for r in R.step_rows(df).orderBy("step_index").collect()]
    assert got == [(0, "x", "a1", 10, 20, 11, 0, 4), (1, "x", "a2", 11, None, 12, 0, 4), (2, None, "a3", 12, None, 13, 1, 4)]


def test_prefixes(spark):
    df = spark.createDataFrame([("Tap it", "click", "thought"), (None, "long_press", " "), ("x", "scroll", "t")], "i string, k string, t string")
    i, k, t = (F.col(c) for c in "ikt")
    end, act, point = (df.select(R.forced_prefix(i, k, "template", p)).collect()[0][0] for p in R.POINTS)
    assert point.startswith(act) and act.startswith(end) and end.endswith("</thinking>\n") and point.endswith('"coordinate": [')
    assert df.select(R.forced_prefix(i, k, "none", "action")).collect()[1][0].startswith("<tool_call>") and df.select(R.forced_prefix(i, k)).collect()[2][0] is None
    assert df.select(R.forced_prefix(i, k, "ar_cache", "thinking_end", t)).collect()[0][0] == "<thinking>\nthought\n</thinking>\n"
    for args in (("none", "thinking_end"), ("odd", "action"), ("none", "odd"), ("ar_cache", "action")):
        with pytest.raises(ValueError):
            R.forced_prefix(i, k, *args)


def test_official_and_effects(spark):
    df = spark.createDataFrame([("NAV", "back"), ("NAV", "x"), ("SCROLL", None), ("TERMINATE", "a"), ("WAIT", None)], "k string, a string")
    assert [r[0].type for r in df.select(R.official(R.action(F.col("k"), F.col("a")))).collect()] == ["PRESS_BACK", "NAV", "SWIPE", "TASK_COMPLETE", "WAIT"]
    r = df.limit(1).select(R.app_effect(F.lit("p"), F.lit(None), F.lit("c"), F.lit("c"), F.lit("NAV"), F.lit(True)).alias("e"), R.observed_effect(F.lit("click"), F.lit(1)).alias("o"), R.observed_effect(F.lit("nav"), F.lit(1)).alias("q"), R.wait_value(F.lit("Wait")).alias("w"), R.effect(F.lit("NAV"), F.lit("a"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)).alias("f")).first()
    assert tuple(r.e) == (False, True, False, True) and (r.o, r.q, r.w) == (None, 1, None) and tuple(r.f) == (True, True, False, "NAV", False)
