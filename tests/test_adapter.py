"""Actions of payloads and outputs, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from stepweave.functions import geometry as G
from stepweave.operators import adapter as A


def act(kind, argument=None, box=None, app=None, direction=None):
    return (kind, argument, box, app, direction)


PAYLOADS = [
    ({"action_type": "click", "x": 204, "y": 2304}, act("CLICK", box=(203, 2303, 205, 2305))),
    ({"action": "tap", "bbox": [10, 20, 30, 40]}, act("CLICK", box=(10, 20, 30, 40))),
    ({"action": "tap", "bbox": [30.4, 40.5, 10.5, 20]}, act("CLICK", box=(10, 20, 30, 40))),
    ({"action": "click", "bbox": [10, 20, None, 40]}, act("CLICK")),
    ({"action": "click", "argument": {"bounds": [1, 2, 3, 4]}}, act("CLICK", box=(1, 2, 3, 4))),
    ({"action": "hold", "point": [5, 6]}, act("LONG_PRESS", box=(4, 5, 6, 7))),
    ({"name": "mobile_use", "arguments": {"action": "click", "coordinate": [999, 0]}}, act("CLICK", box=(1078, 0, 1079, 1))),
    ({"name": "mobile_use", "arguments": "{\"action\": \"click\", \"coordinate\": [0, 999]}"}, act("CLICK", box=(0, 2398, 1, 2399))),
    ({"action": "click", "argument": {"x": 999, "y": 999}}, act("CLICK", box=(1078, 2398, 1079, 2399))),
    ({"argument": {"action": "type", "text": " a "}}, act("TYPE", "a")),
    ({"action": "input text", "value": 7}, act("TYPE", "7")),
    ({"action": "type", "argument": "hello", "app": "x"}, act("TYPE", "hello", app="x")),
    ({"action": "swipe", "direction": "Up"}, act("SCROLL", direction="up")),
    ({"action": "drag", "start_x": 0, "start_y": 5, "end_x": 1, "end_y": 0}, act("SCROLL", direction="up")),
    ({"action": "drag", "from_x": 0, "from_y": 0, "to_x": 9, "to_y": 1}, act("SCROLL", direction="right")),
    ({"action": "drag", "start": {"x": 9, "y": 0}, "end": {"point": [0, 1]}}, act("SCROLL", direction="left")),
    ({"action": "drag", "from": {"x": 0, "y": 0}, "to": {"x": 1, "y": 1}}, act("SCROLL", direction="down")),
    ({"action": "navigate_back"}, act("NAV", "back")),
    ({"action": "go-home"}, act("NAV", "home")),
    ({"action": "system_button", "button": "Enter"}, act("NAV", "enter")),
    ({"action": "open_app", "app_name": "Maps"}, act("NAV", "Maps", app="Maps")),
    ({"action": "open", "argument": "Maps"}, act("NAV", "Maps", app="Maps")),
    ({"action": "navigate_recent"}, act("NAV", "recent", app="recent")),
    ({"action": "wait", "seconds": 3}, act("WAIT", "3")),
    ({"action": "wait", "argument": {"duration": 2}}, act("WAIT", "2")),
    ({"action": "terminate", "goal_status": "successful"}, act("TERMINATE", "successful")),
    ({"action": "answer", "text": "42"}, act("TERMINATE", "42")),
    ({"action": "wiggle"}, None), ({"x": 1}, None), ({"action": 5}, None), ({}, None),
]


@pytest.fixture(scope="module")
def adapted(spark):
    df = spark.createDataFrame([(i, json.dumps(p)) for i, (p, _) in enumerate(PAYLOADS)], "i int, p string")
    return {r.i: r.a for r in df.select("i", A.payload_action(F.col("p"), F.lit(1080), F.lit(2400)).alias("a")).collect()}


def plain(a):
    return None if a is None or a.action_type is None else (a.action_type, a.argument, a.box and tuple(a.box), a.app, a.direction)


@pytest.mark.parametrize("i", range(len(PAYLOADS)))
def test_payload(adapted, i):
    assert plain(adapted[i]) == PAYLOADS[i][1]


CALL = '<tool_call>\n{"name": "mobile_use", "arguments": {"action": "%s"%s}}\n</tool_call>'
OUTPUTS = [
    ("I tap. " + CALL % ("click", ', "coordinate": [500, 500]'), act("CLICK", box=(539, 1200, 541, 1202))),
    (CALL % ("click", "") + CALL % ("scroll", ', "direction": "down"'), act("SCROLL", direction="down")),
    ("TYPE[two words]", act("TYPE", "two words")), ("click[10, 20, 30, 40]", act("CLICK", box=(10, 20, 30, 40))), ("SCROLL[Down]", act("SCROLL", direction="down")), ("WAIT", act("WAIT")), ("NAV[back]", act("NAV", "back")), ("CLICK[a]", None),
    ('so {"action": "click", "x": 5, 7}', act("CLICK", box=(4, 6, 6, 8))),
    ('{"action": "type", "text": "lost en', None), ('{"action": "type", "text": "kept", "more": "lo', act("TYPE", "kept")), ('{"action": "click", "coordinate": [5, 9], "note": [1, {"a": ', act("CLICK", box=(4, 8, 6, 10))),
    ('"action": "click", "bbox": [0, 0, 999, 999', None), ('broken "action": "click" "bbox": [0, 0, 999, 999]', act("CLICK", box=(0, 0, 1079, 2399))), ('"action_type": "swipe", "direction": "LEFT"', act("SCROLL", direction="left")),
    ("prose only", None), ("", None), (None, None), ("<tool_call>\n{}\n</tool_call>", None), ('{"action": "terminate", "x": [{"deep": 1}]}', act("TERMINATE")),
]


def test_outputs(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(OUTPUTS)], "i int, t string")
    got = {r.i: plain(r.a) for r in df.select("i", A.output_action(F.col("t"), F.lit(1080), F.lit(2400)).alias("a")).collect()}
    assert [got[i] for i in range(len(OUTPUTS))] == [w for _, w in OUTPUTS]


def test_first_nested(spark):
    df = spark.createDataFrame([('{"a": {"b": [{"status": " ok "}]}, "c": {"goal_status": "x"}}',), ('{"status": null, "d": {"result": 3}}',), ("[]",), ("{",), (None,)], "t string")
    assert [r[0] for r in df.select(A.first_nested(F.col("t"), F.lit("goal_status,status,result"))).collect()] == ["ok", "3", None, None, None]


def test_frames(spark):
    df = spark.createDataFrame([(10, 20, 110, 220)], "l int, t int, r int, b int").select(F.struct("*").alias("roi"))
    none = F.lit(None).cast("int")
    r = df.select(
        G.scaled(F.lit(999.0), F.lit(0.0), G.frame(none, none, F.col("roi")), F.lit(True)).alias("a"), G.scaled(F.lit(999.0), F.lit(0.5), G.frame(none, none), F.lit(True)).alias("b"), G.around_in_frame(F.struct(F.lit(10).alias("x"), F.lit(219).alias("y")), G.frame(none, none, F.col("roi"))).alias("c"),
        G.grid_place(F.lit(11), 3, 4).alias("d"), G.grid_place(F.lit(3), 2, 2, 10).alias("e"), G.region_box(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))).alias("f"), G.region_box(F.array(F.array(F.lit(0), F.lit(0)), F.array(F.lit(0), F.lit(0)))).alias("g"),
        G.screen_box(none, F.lit(1)).alias("h"), G.mean_offset(F.struct(F.lit(1).alias("x"), F.lit(5).alias("y")), F.struct(F.lit(4).alias("x"), F.lit(4).alias("y"))).alias("i"),
    ).first()
    assert [x if not isinstance(x, tuple) else tuple(x) for x in r] == [(109, 20), (999, 0), (10, 218, 11, 219), (0, 2, 3), (10, 11, 11), (1, 2, 3, 4), None, None, 2.0]
