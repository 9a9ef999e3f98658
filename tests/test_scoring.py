import pytest
from pyspark.sql import functions as F

from stepweave.operators import scoring as S

ACTION = "struct<type string, x double, y double, box struct<l int, t int, r int, b int>, text string, direction string, app string, status string, seconds double, label string>"


def action(kind, x=None, y=None, box=None, text=None, direction=None, app=None, status=None, seconds=None, label=None):
    return (kind, x, y, box, text, direction, app, status, seconds, label)


BOX = (0, 0, 10, 10)
CASES = [
    (action("click", box=BOX), action("click", 10.0, 10.0), True), (action("click", box=BOX), action("click", 11.0, 1.0), False), (action("click"), action("click", 1.0, 1.0), False), (action("click", box=(5, 5, 5, 9)), action("click", 5.0, 6.0), False),
    (action("input_text"), action("input_text"), True), (action("input_text", text="A b"), action("input_text", text=" a  B"), True), (action("input_text", text="a", box=BOX), action("input_text", 50.0, 5.0, text="a"), False),
    (action("wait"), action("wait", seconds=3.0), True), (action("wait", seconds=0.0), action("wait", seconds=3.0), True), (action("wait", seconds=2.0), action("wait"), False), (action("scroll", direction="Up"), action("scroll", direction="up"), True),
    (action("navigate_back"), action("navigate_back"), False), (action("navigate_back"), action("click", label="Navigate up"), True), (action("click", text="Bankery"), action("open_app", app="bankery"), True), (action("open_app", app="x"), action("status"), False),
    (action(None), action(None), False), (action("status", status="ok"), action("status", status="ok"), True), (action("odd"), action("odd"), False),
]


def test_first(spark):
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(CASES)], f"i int, t {ACTION}, p {ACTION}")
    got = {r.i: r.m for r in df.select("i", S.first_benchmark(F.col("t"), F.col("p")).alias("m")).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, _, want in CASES]
    assert df.where("i = 11").select(S.first_benchmark(F.col("t"), F.col("p"), strict_nav=False)).first()[0]


def test_second(spark):
    cases = [
        (action("CLICK", 0.0, 0.0), action("CLICK", 139.0, 0.0), True), (action("CLICK", 0.0, 0.0), action("CLICK", 140.5, 0.0), False), (action("CLICK"), action("CLICK", 1.0, 1.0), False), (action("TYPE", text="a b c"), action("TYPE", text="a b"), True), (action("TYPE", text="a"), action("TYPE"), False),
        (action("SWIPE"), action("SWIPE", direction="up"), True), (action("SWIPE", direction="up"), action("SWIPE"), False), (action("NAV"), action("NAV"), True), (action("TAP"), action("CLICK"), False), (action(None), action(None), False),
    ]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cases)], f"i int, t {ACTION}, p {ACTION}")
    got = {r.i: r.m for r in df.select("i", S.second_benchmark(F.col("t"), F.col("p"), F.lit(1004)).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]


def test_nodes(spark):
    node = "struct<box struct<l int, t int, r int, b int>, visible boolean, clickable boolean, editable boolean, scrollable boolean, checkable boolean, text string, description string, view_id string, widget string>"
    base = dict(box=BOX, visible=None, clickable=None, editable=None, scrollable=None, checkable=None, text="t", description=None, view_id=None, widget="TextView")
    cases = [({}, True), ({"box": None}, False), ({"visible": False}, False), ({"text": None}, False), ({"text": None, "clickable": True}, True), ({"text": "x" * 97}, False), ({"widget": "FrameLayout"}, True), ({"widget": "View"}, False), ({"widget": "frame_layout"}, False), ({"text": None, "view_id": "v", "widget": "Button"}, True), ({"text": None, "view_id": "v"}, True), ({"text": None, "view_id": "v", "widget": "Space"}, False), ({"box": (0, 0, 40, 20)}, False), ({"box": (0, 0, 40, 24), "clickable": True}, False)]
    df = spark.createDataFrame([(i, tuple((base | c).values())) for i, (c, _) in enumerate(cases)], f"i int, n {node}")
    got = {r.i: r.k for r in df.select("i", S.keeps_node(F.col("n"), F.lit(1000)).alias("k")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


@pytest.mark.parametrize("args,want", [((" a b ", 280, 280, 78400, 9), (2, 100, 2)), ((None, 1000, 1000, 250000, 1), (0, 324, 1)), (("x", None, 5, 10, 400), (1, 0, 100))])
def test_cost(spark, args, want):
    df = spark.createDataFrame([args], "t string, w int, h int, b int, m int")
    assert tuple(df.select(S.request_cost(*(F.col(c) for c in "twhbm")).alias("c")).first().c) == want


def test_small_ones(spark):
    df = spark.createDataFrame([(0.0, 0.0, 5.0, -5.0), (0.0, 0.0, 6.0, 1.0), (1.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 2.0)], "a double, b double, c double, d double")
    assert [r[0] for r in df.select(S.swipe_direction(*(F.col(c) for c in "abcd"))).collect()] == ["up", "right", None, "down"]
    r = df.limit(1).select(S.smooth_l1(F.lit(0.005)), S.smooth_l1(F.lit(-1.0)), S.reduction(F.lit(1), F.lit(4)), S.reduction(F.lit(1), F.lit(0)), S.speed_up(F.lit(2), F.lit(4)), S.speed_up(F.lit(0), F.lit(4))).first()
    assert [None if x is None else round(x, 6) for x in r] == [0.00125, 0.995, 0.75, 0.0, 2.0, None]
