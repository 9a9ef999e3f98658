"""Exact ranks, bootstrap, spatial binding and streaming against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from stepweave.operators import metrics as M
from stepweave.operators.sequence import leading_true
from stepweave.operators.spatial import bind_points, candidates, draft_tree, nearest, smallest_containing, with_boxes
from stepweave.plans.trajectories import QUERIES
from stepweave.streaming.metrics import stream_files


def test_exact_ranks(spark):
    rng = random.Random(1)
    data = [(k, rng.choice([0.0, -3.5, rng.random() * 10 ** rng.randrange(6), 7.25])) for k in ("a", "b", None) for _ in range(rng.randrange(1, 300))]
    df = spark.createDataFrame(data + [("c", None)], "k string, v double")
    for q in (0.0, 0.1, 0.5, 0.99, 1.0):
        got = {r.k: (r.n, r.value) for r in M.exact_ranks(df, ["k"], "v", {"it": M.nearest_index(q), "first": F.lit(0)}).where("rank = 'it'").collect()}
        for k in ("a", "b", None):
            own = sorted(v for x, v in data if x == k)
            assert got[k] == (len(own), own[round((len(own) - 1) * q)])
        assert "c" not in got


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("c", None), (None, True)], "g string, ok boolean")
    r = M.bootstrap(df, "g", "ok", draws=40).first()
    assert 0 <= r.low <= r["mean"] <= r.high <= 1


def test_leading_true(spark):
    df = spark.createDataFrame([([True, True, False, True],), ([],), ([None, True],), ([True],)], "f array<boolean>")
    assert [r[0] for r in df.select(leading_true(F.col("f"))).collect()] == [2, 0, 0, 1]


NODES = "record_id bigint, step_index int, window_no int, node_no int, bbox string, text string, content_description string, view_id_resource_name string, class_name string, visible string, clickable string, scrollable string, editable string, depth string"


def node(no, box, text=None, depth="0", clickable=None, visible=None):
    return (1, 0, 0, no, box and '{"l":%d,"t":%d,"r":%d,"b":%d}' % box, text, None, None, "a.B", visible, clickable, None, None, depth)


def test_binding_and_candidates(spark):
    rows = [node(0, (0, 0, 100, 100)), node(1, (10, 10, 20, 20), "s", "1"), node(2, (10, 10, 20, 20), "d", "2"), node(3, None), node(4, (30, 30, 40, 40), "t", clickable="true"), node(5, (30, 30, 40, 40), "t"), node(6, (50, 50, 60, 60), "h", visible="false")]
    nodes = spark.createDataFrame(rows, NODES)
    points = spark.createDataFrame([(1, 1, 0, 20.0, 20.0), (2, 1, 0, 99.0, 99.0), (3, 1, 0, 500.0, 1.0), (4, 9, 0, 1.0, 1.0)], "point_id bigint, record_id bigint, step_index int, x double, y double")
    got = {r.point_id: (r.node_no, r.label) for r in bind_points(points, with_boxes(nodes), ["record_id", "step_index"]).collect()}
    assert got == {1: (2, "d"), 2: (0, None), 3: (None, None), 4: (None, None)}
    assert [(r.node_no, r["rank"]) for r in candidates(nodes).orderBy("rank").collect()] == [(4, 1), (2, 2), (1, 3)]
    assert candidates(nodes, 1).count() == 1
    held = with_boxes(nodes).where("box is not null").agg(F.sort_array(F.collect_list(F.struct(F.col("node_no").alias("pos"), "box", F.col("depth").cast("int").alias("depth"), "label"))).alias("all"))
    r = held.select(smallest_containing(F.col("all"), F.lit(15), F.lit(15)).alias("s"), nearest(F.col("all"), F.lit(200), F.lit(200)).alias("n")).first()
    assert (r.s.label, r.n.pos) == ("d", 6)


def test_draft_tree(spark):
    scores = spark.createDataFrame([("t", 0, 1, -0.1), ("t", 0, 2, -0.5), ("t", 0, 3, -2.0), ("t", 1, 4, -0.2), ("t", 1, 5, -3.0), ("t", 2, 6, -0.1), ("t", 4, 7, -0.1), ("u", 0, 1, -1.0)], "tree_id string, parent bigint, node bigint, score double")
    roots = spark.createDataFrame([("t", 0), ("u", 0)], "tree_id string, node bigint")
    got = sorted((r.tree_id, r.node, r.parent, r.depth, round(r.score, 3)) for r in draft_tree(scores, roots, 3, 2, 4).collect())
    assert got == [("t", 1, 0, 1, -0.1), ("t", 2, 0, 1, -0.5), ("t", 4, 1, 2, -0.3), ("t", 7, 4, 3, -0.4), ("u", 1, 0, 1, -1.0)]
    assert draft_tree(scores.limit(0), roots, 2, 2, 2).collect() == []


def test_benchmark_bootstrap(spark):
    """Against resamples of the rows themselves, with the same draws."""
    import hashlib

    rng = random.Random(3)
    data, example = [], 0
    for b, groups in (("AndroidControl", ["a", "b", "c", None, "d"]), ("LearnGUI", ["a", "x", "y"])):
        for g in groups:
            for _ in range(rng.randrange(2, 9)):
                example += 1
                mode, shot = rng.choice(["high_level", "low_level", None]), rng.choice([None, 2, 10]) if g != "x" else 1
                for m in ("baseline", "hybrid", "hybrid")[: rng.choice([2, 2, 3])]:
                    data.append((example, b, g, mode, shot if b == "LearnGUI" else None, m, rng.choice([0, 1, None]), rng.randrange(50), rng.choice([None, 7]), rng.choice([True, False, None]), rng.choice([None, -1.0, 12.5, float("nan")])))
    names = "example_id bigint, benchmark string, group_id string, mode string, shot_count int, method string, full_model_calls int, prompt_tokens bigint, generated_tokens bigint, primary_correct boolean, latency_ms double"
    got = {(r.benchmark, r.metric): tuple(r)[2:] for r in M.benchmark_bootstrap(spark.createDataFrame(data, names)).collect()}

    def acc(rows, m):
        own = [bool(r[9]) for r in rows if r[5] == m]
        return sum(own) / len(own) if own else 0.0

    def less(rows, value):
        base, hybrid = (sum(value(r) for r in rows if r[5] == m) for m in ("baseline", "hybrid"))
        return 1 - hybrid / base if base > 0 else 0.0

    want = {}
    for b in ("AndroidControl", "LearnGUI"):
        keys = sorted({r[2] for r in data if r[1] == b}, key=lambda g: (g is not None, g))
        size, samples = len(keys), []
        for d in range(1000):
            rows = [r for p in range(size) for r in data if r[1] == b and r[2] == keys[int(hashlib.md5(f"0-{d * size + p}".encode()).hexdigest()[:12], 16) % size]]
            shots = sorted({f"{r[4]}_shot" for r in rows if r[4] is not None})
            first = [r for r in rows if (r[3] == "low_level" if b == "AndroidControl" else shots and f"{r[4]}_shot" == shots[0])]
            local = {r[0] for r in rows if r[5] == "hybrid" and r[6] == 0}
            taken = [r for r in rows if r[0] in local]
            samples.append((acc(first, "hybrid") - acc(first, "baseline"), less(rows, lambda r: r[6] or 0), less(rows, lambda r: r[7] + (r[8] or 0)), less(rows, lambda r: r[10] if r[10] == 12.5 else 0), acc(taken, "hybrid") - acc(taken, "baseline")))
        for i, metric in enumerate(("primary_accuracy_delta", "full_model_call_reduction", "total_token_reduction", "latency_reduction", "accepted_step_accuracy_delta")):
            own = sorted(s[i] for s in samples)
            want[b, metric] = (sum(own) / 1000, own[25], own[974], own[50])
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=2e-6), k


def test_stored_nodes(spark):
    """Filter, both dedupes and both cuts, against the reference's steps in plain Python."""
    names = NODES + ", checkable string"
    big, box = (0, 0, 80, 80), lambda i: (10, 10, 20 + i, 20)
    of = lambda no, where, text=None, **more: tuple({**dict(zip("record_id step_index window_no node_no bbox text content_description view_id_resource_name class_name visible clickable scrollable editable depth checkable".split(), node(no, where, text) + (None,))), **more}.values())
    rows = [
        of(0, box(0)), of(1, box(1), "x" * 97), of(2, big, "passive"), of(3, big, "active", clickable="true"), of(4, box(2), "v", class_name="android.view.View"), of(5, box(3), view_id_resource_name="a:id/b"),
        of(6, box(4), view_id_resource_name="a:id/b", class_name="android.widget.ImageView"), of(7, box(5), "same", clickable="true"), of(8, box(5), "same"), of(9, box(5), "same", content_description="other", clickable="true"),
        of(10, box(6), checkable="true"), of(11, box(0), "named"), of(12, box(7), "hidden", visible="false"),
    ]
    screens = spark.createDataFrame([(1, 0, 100, 100)], "record_id bigint, step_index int, width bigint, height bigint")
    got = [r.node_no for r in candidates(spark.createDataFrame(rows, names), screens=screens).orderBy("rank").collect()]
    assert got == [7, 9, 3, 10, 11, 6]
    many = spark.createDataFrame([of(i, box(i), "t", clickable=None) for i in range(300)], names)
    twins = spark.createDataFrame([of(1000 + i, box(i % 100), "u", view_id_resource_name=f"p{i // 100}:id/{'ab'[i // 100]}", content_description="d", clickable="true") for i in range(200)], names)
    assert [r.node_no for r in candidates(many, screens=screens).orderBy("rank").collect()] == list(range(128))
    # 200 differ by view id; 192 are stored, pairs of equal names in a row
    assert candidates(twins, screens=screens).count() == 96
    assert candidates(many.unionByName(twins), screens=screens).count() == 96


def test_error_audit(spark, tmp_path):
    data = [(i, m, 2 * i + j, ok, j ^ 1, "e", i) for i in range(70) for j, (m, ok) in enumerate((("baseline", i % 2 == 0), ("hybrid", i % 7 == 0)))]
    df = spark.createDataFrame(data, "example_id bigint, method string, result_id bigint, primary_correct boolean, full_model_calls int, episode_id string, step_index int")
    for name, rows in (("all", df), ("none", df.where("primary_correct"))):
        rows.write.parquet(f"{tmp_path}/{name}/step_results.parquet")
    got = sorted(tuple(r) for r in QUERIES["error_audit"](spark, f"{tmp_path}/all").collect())
    assert got == [(i, "e", i, 2 * i + 1, i % 2 == 0, 60) for i in range(70) if i % 7][:50]
    assert [tuple(r) for r in QUERIES["error_audit"](spark, f"{tmp_path}/none").collect()] == [(None, None, None, None, None, 0)]


def test_memberships(spark):
    df = spark.createDataFrame([(["IDD", "app_unseen", "idd"], None), ([], "task_unseen"), (None, None), ([None], "odd")], "a array<string>, b string")
    assert [r[0] for r in df.select(M.memberships(F.col("a"), F.array("b"))).collect()] == [["in_distribution", "app_unseen"], ["task_unseen"], ["in_distribution"], ["odd"]]


def test_stream_goes_on(spark, tmp_path):
    """A query started again on its state reads only what came since."""
    rows = lambda n: spark.createDataFrame([("baseline", True, 1.0)] * n, "method string, primary_correct boolean, latency_ms double").coalesce(1)
    rows(3).write.parquet(f"{tmp_path}/in")
    assert stream_files(spark, f"{tmp_path}/in", state=f"{tmp_path}/state").first().n == 3
    rows(2).write.mode("append").parquet(f"{tmp_path}/in")
    again = stream_files(spark, f"{tmp_path}/in", state=f"{tmp_path}/state").first()
    assert (again.n, again.total_ms) == (5, 5.0)
    assert stream_files(spark, f"{tmp_path}/in", state=f"{tmp_path}/state").first().n == 5
