import pytest
from pyspark.sql import functions as F

from stepweave.functions import geometry as G
from stepweave.functions import text as T
from stepweave.operators.spatial import farthest_points
from stepweave.sources.sinks import write_json_lines
from stepweave.sources.tfrecord import TFRecordSource, example, encode, frames, write_file


def test_round_trip(spark, tmp_path):
    spark.dataSource.register(TFRecordSource)
    records = [{"id": [7], "goal": ["où"], "nums": [-1, 0, 1 << 40], "scores": [0.5, 2.0], "raw": [b"\x00\xff"]}, {"id": [8]}]
    write_file(str(tmp_path / "a-0"), records)
    write_file(str(tmp_path / "a-1"), records[:1], zipped=True)
    (tmp_path / "a-2").write_bytes(b"")
    df = spark.read.format("tfrecord").schema("id bigint, goal string, nums array<bigint>, scores array<float>, raw array<binary>").load(str(tmp_path))
    rows = sorted(map(tuple, df.collect()), key=str)
    assert rows == sorted([(7, "où", [-1, 0, 1 << 40], [0.5, 2.0], [bytearray(b"\x00\xff")])] * 2 + [(8, None, None, None, None)], key=str)


def test_broken_files(tmp_path):
    path = str(tmp_path / "x")
    write_file(path, [{"id": [1]}])
    whole = open(path, "rb").read()
    for cut in (5, len(whole) - 5):
        open(path, "wb").write(whole[:cut])
        with pytest.raises(EOFError):
            list(frames(path))
    # the last checksum may be short
    open(path, "wb").write(whole[:-2])
    assert len(list(frames(path))) == 1 and len(list(frames(whole))) == 1
    assert example(memoryview(b"")) == {}
    assert example(memoryview(encode({"a": [1], "b": ["x"]})), {"b"}) == {"b": [b"x"]}


def test_functions(spark):
    png = b"\x89PNG\r\n\x1a\n" + bytes(8) + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    df = spark.createDataFrame([(png, " A  b\n", "a.b.C$D", "app:id/x", b"ab\x00abc1\x00123", "one thing | x | http://a.b | 12 | one  thing")], "png binary, t string, c string, v string, raw binary, d string")
    r = df.select(
        G.png_size(F.col("png")).alias("size"), T.normalize(F.col("t")).alias("n"), T.widget_leaf(F.col("c")).alias("w"), T.view_id_leaf(F.col("v")).alias("l"), T.printable_runs(F.col("raw")).alias("p"), T.bounded_fragments(F.col("d")).alias("f"),
        T.duration(F.lit(3723)).alias("s"), T.percent(F.lit(0.5)).alias("pc"), T.sorted_pairs(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("m"), G.to_pixel(F.lit(999), F.lit(100)).alias("px"),
    ).first()
    assert (r["size"].width, r["size"].height, r.n, r.w, r.l, r.p, r.f, r.s, r.pc, r.m, r.px) == (640, 480, "a b", "c_d", "x", ["abc1"], "one thing", "1h02m03s", "50.00%", "a=1; b=2", 99)


@pytest.mark.parametrize("seconds,text", [(45, "45s"), (125, "2m05s"), (19953, "5h32m33s"), (0.5, "0s"), (59.6, "1m00s"), (None, "n/a"), (-1, "n/a")])
def test_duration(spark, seconds, text):
    assert spark.createDataFrame([(None if seconds is None else float(seconds),)], "s double").select(T.duration(F.col("s"))).first()[0] == text


def test_noise(spark):
    cases = [("ab", True), ("123", True), ("abc", False), ("see www.x.y", True), ("utm_source here", True), ("a" * 65 + "%20%20%20%20", True), ("a%20%20%20%20", False), ("a=1&b=2&c=3" + "x" * 120, True), ("gbs", False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(T.is_noise(F.col("t"))).collect()] == [w for _, w in cases]
    assert df.select(T.view_id_leaf(F.lit("app:id/gbs.list"))).first()[0] == "list"


def test_farthest_points():
    assert farthest_points([], 0.5) == []
    assert farthest_points([[1, 0]], 0.1) == [0]
    assert farthest_points([[1, 0], [1, 0.01], [0, 1], [-1, 0]], 0.5) == [0, 3] or len(farthest_points([[1, 0], [1, 0.01], [0, 1], [-1, 0]], 0.5)) == 2


def test_sink(spark, tmp_path):
    write_json_lines(spark.range(2), str(tmp_path / "o"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "o")).collect()) == ['{"id":0}', '{"id":1}']
