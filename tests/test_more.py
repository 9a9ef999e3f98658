"""Labels, sizes, requests, readers, settings and reports, case by case."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepweave.functions import geometry as G
from stepweave.functions import text as T
from stepweave.operators import payloads as L
from stepweave.operators import records as R
from stepweave.operators import regressor as N
from stepweave.operators import requests as Q
from stepweave.operators import scoring as C
from stepweave.operators.spatial import farthest_by_group, farthest_points
from stepweave.sources import config, nested_json, reports
from stepweave.sources.tfrecord import lookup, read_shards, scan, with_late, write_file


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_text(spark):
    lit = F.lit
    assert one(spark, *[T.human_bytes(lit(n)) for n in (0, 1023, 1024, 1536, 1 << 20, 3 << 30, 5 << 50)]) == ["0 B", "1023 B", "1.00 KiB", "1.50 KiB", "1.00 MiB", "3.00 GiB", "5120.00 TiB"]
    assert one(spark, *[T.version_numbers(lit(v)) for v in ("4.10.2-dev", "v2.0rc1", "1.x.3", "x")]) == [[4, 10, 2], [2, 1], [1], []]
    assert one(spark, T.speed_text(lit(3.0), lit(2.0)), T.speed_text(lit(3.0), lit(0.0)), T.speed_text(lit(None).cast("double"), lit(1.0))) == ["1.50x", "—", "—"]
    assert one(spark, *[T.bare_label(lit(x)) for x in (" `a` ", "- b", "* 'c'", '"d"', None, "'e\"")]) == ["a", "b", "c", "d", "", "'e\""]
    valid = F.array(lit("tap"), lit("wait now"))
    assert one(spark, *[T.chosen_label(lit(x), valid) for x in ('{"choice": "`tap`"}', "tap", "- wait now\nbecause", '{"label": "odd"}', "odd", None)]) == ["tap", "tap", "wait now", None, None, None]
    assert one(spark, T.node_name(lit("a"), lit("a"), lit("x:id/b")), T.node_name(lit(None).cast("string"), lit(" "), lit(None).cast("string"))) == ["a | b", None]
    assert one(spark, T.node_role(lit("android.widget.Button"), {"editable": lit(None).cast("boolean"), "clickable": lit(True)}), T.node_role(lit(None).cast("string"), {"checked": lit(False)})) == ["button clickable", None]
    got = one(spark, T.aligned_descriptions(F.array(lit("a"), lit("")), F.array(lit("h0"), lit("h1")), lit(3)), T.aligned_descriptions(F.array(lit("a")), F.array(lit("h")), lit(1)), T.aligned_descriptions(lit(None).cast("array<string>"), F.array(lit("h")), lit(1)))
    assert [(x.texts, x.source) for x in got] == [(["a", "h1", ""], "provided_with_heuristic_backfill"), (["a"], "provided"), (["h"], "heuristic_accessibility_serialization")]
    assert one(spark, T.progress_line(lit("gpu0"), lit(3), lit(4), lit(0.5), lit(None).cast("double"))) == ["[gpu0] 3/4 (75.00%) accuracy=50.00% step_ms=n/a"]


def box(*v):
    return F.struct(*[F.lit(x).alias(k) for k, x in zip("ltrb", v)])


def test_crops(spark):
    w, h = F.lit(100), F.lit(1000)
    got = one(spark, G.clamped_crop(box(120, -5, 90, 2000), w, h), G.safe_crop(box(10, 0, 11, 999), w, h), G.safe_crop(box(10, 0, 30, 999), w, h), G.safe_crop(box(99, 0, 100, 999), w, h))
    assert [tuple(x) for x in got] == [(90, 0, 100, 1000), (8, 0, 14, 999), (10, 0, 30, 999), (94, 0, 100, 999)]
    for start, stop, total, target in [(5, 6, 10, 4), (0, 1, 10, 5), (9, 10, 10, 5), (2, 8, 10, 3), (3, 4, 5, 50)]:
        s = one(spark, G.grown_span(F.lit(start), F.lit(stop), F.lit(total), F.lit(target)))[0]
        assert 0 <= s.start <= start and stop <= s.stop <= total and s.stop - s.start == min(total, max(stop - start, target))
    p, q = one(spark, G.padded_size(F.lit(1), F.lit(999)), G.padded_size(F.lit(10), F.lit(20)))
    assert tuple(p) == (6, 999, 2, 0) and tuple(q) == (10, 20, 0, 0)
    assert tuple(one(spark, G.budget_size(box(0, 0, 200, 100), w, h, F.lit(5000)))[0]) == (100, 50)


def usage(p, v, g):
    return F.struct(F.lit(p).cast("bigint").alias("prompt"), F.lit(v).cast("bigint").alias("visual"), F.lit(g).cast("bigint").alias("generated"))


def test_usage_and_labels(spark):
    e = usage(1, 2, 3)
    got = one(spark, C.final_usage(usage(0, 0, 0), e), C.final_usage(usage(5, 0, 0), e), C.reported_usage(F.lit(100), F.lit(0), F.lit(56), F.lit(28), e), C.reported_usage(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(56), F.lit(28), e))
    assert [tuple(x) for x in got] == [(1, 2, 3), (5, 0, 0), (98, 2, 3), (1, 2, 3)]
    ids = F.array(*[F.lit(i) for i in (7, 8, 9)])
    assert one(spark, C.loss_labels(ids, F.lit(2)), C.loss_labels(ids, F.lit(9)), C.loss_labels(ids, F.lit(0)), C.tokens_before(F.array(F.lit(0), F.lit(4), F.lit(9)), F.lit(9))) == [[-100, -100, 9], [-100] * 3, [7, 8, 9], 2]


def test_requests(spark, tmp_path):
    act = lambda k, a=None, d=None: F.struct(F.lit(k).alias("action_type"), F.lit(a).cast("string").alias("argument"), F.lit(d).cast("string").alias("direction"), F.lit(None).cast("string").alias("app"))
    none = F.lit(None).cast("string")
    got = one(spark, Q.step_prompt(F.lit("g"), none, F.array(act("CLICK"), act("TYPE", "x"), act("SCROLL", None, "up"))), Q.step_prompt(F.lit("g"), F.lit("i"), F.array().cast("array<struct<action_type string, argument string, direction string, app string>>")), Q.summary_prompt(F.lit("g"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")), F.array(act("TYPE", "x")), F.create_map().cast("map<string,string>")))
    assert got == ["Task goal: g\nActions already performed:\nclick: (done)\ntype: x\nscroll: up", "Task goal: g\nInstruction for the current step: i", "goal: g\nmetadata: a=1; b=2\nhistory: TYPE:x\nsupport: none"]
    keys = one(spark, Q.cache_key(F.lit("a"), F.lit(1), none), Q.cache_key(F.lit("a"), F.lit(1), F.lit("")), Q.screen_id(none, F.lit(b"x"), F.lit(1), F.lit(2)), Q.screen_id(none, F.lit(None).cast("binary"), F.lit(1), F.lit(None).cast("int")))
    assert keys[0] != keys[1] and keys[2].startswith("bytes:") and keys[2].endswith(":1") and keys[3] == "blank:1x?"
    df = spark.createDataFrame([(1, 9), (2, None), (3, 1)], "id bigint, config_id int")
    p = {r.id: (r.temperature, r.max_new_tokens) for r in Q.with_parameters(df, spark.createDataFrame([(1, 0.7, None), (1, 0.7, 64)], "config_id int, temperature double, max_new_tokens int")).collect()}
    assert p == {1: (0.0, Q.DEFAULTS["max_new_tokens"]), 2: (0.0, Q.DEFAULTS["max_new_tokens"]), 3: (0.7, 64)}
    assert [r.worker for r in Q.in_rounds(spark.range(7), 3, "id").orderBy("id").collect()] == [0, 1, 2, 0, 1, 2, 0]
    ask = spark.createDataFrame([(1, "k"), (2, "k"), (3, "l")], "id bigint, key string")
    hit, miss = Q.answered_once(ask, spark.createDataFrame([("l", "yes")], "key string, response string"))
    assert [r.id for r in hit.collect()] == [3] and miss.count() == 1
    assert [r.response for r in Q.in_order(spark.createDataFrame([(2, "b"), (1, "a")], "id bigint, response string"), ask, "id", "key").collect()] == ["a", "b", None]
    labels = spark.createDataFrame([(1, ["tap", "wait"]), (2, ["tap"])], "id bigint, labels array<string>")
    assert {r.id: r.label for r in Q.choose(labels, lambda b: ["wait"] * len(b), "id").collect()} == {1: "wait", 2: None}
    Q.register("echo", lambda prefix="": lambda b: [prefix + str(x) for x in b.id])
    assert Q.backend("echo", prefix="r")(pd.DataFrame({"id": [1]})) == ["r1"] and set(Q.timed(Q.backend("echo"))(pd.DataFrame({"id": [1, 2]}))[0]) == {"response", "ms"}
    with pytest.raises(ValueError):
        Q.backend("none")
    assert Q.alike(spark.createDataFrame([(1, 0.1), (2, 0.1), (3, None)], "id bigint, t double"), ["t"]).select("batch").distinct().count() == 2


def test_tasks_and_groups(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"app": "a", "split": "train", "k_shot": 2, "query": {"episode_id": "q"}, "support": [{"episode": {"episode_id": "y"}}, {"episode": {"episode_id": "x"}}, {"episode": {"episode_id": "gone"}}]}, {"app": "b", "split": "test", "k_shot": 0, "query": {"episode_id": "x"}, "support": []}]))
    tasks = nested_json.tasks(spark, str(tmp_path / "t.json"))
    assert Q.tasks_of(tasks, "train", 2).count() == 1 and Q.tasks_of(tasks, k_shot=0).count() == 1
    e = spark.createDataFrame([("q", "Q", 3), ("x", "X", 1), ("y", "Y", 2)], "episode_id string, goal string, n_steps int")
    got = {r.task_id: (r.query_goal, r.support, r.support_goals, r.support_steps) for r in Q.support_tasks(tasks, e).collect()}
    assert got == {0: ("Q", ["y", "x"], ["Y", "X"], [2, 1]), 1: ("X", [], None, None)}
    groups = spark.createDataFrame([("g", [1, 2, 2, 9]), ("h", [3])], "group_id string, ids array<bigint>")
    shards = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a")], "id bigint, shard string")
    assert {r.group_id: (r.shards, r.missing) for r in Q.group_members(groups, shards).collect()} == {"g": (["a", "b"], [9]), "h": (["a"], [])}
    named = spark.createDataFrame([(0, "z", [1, 2]), (1, "a", [1, 1])], "place int, name string, ids array<bigint>")
    assert {r.id: r.names for r in Q.names_of(named).collect()} == {1: ["z", "a"], 2: ["z"]}
    (tmp_path / "p1.json").write_text(json.dumps({"page_caption": "home", "g": [{"bbox": [1, 2, 3, 4], "xml_desc": ["a", "b"], "functionality": "f"}, {"bbox": [1]}]}))
    ann = nested_json.screens(spark, str(tmp_path / "p1.json"))
    steps = nested_json.with_screens(spark.createDataFrame([(1, "dir/p1.png"), (2, "p2.png")], "step_id bigint, image_path string"), ann)
    assert {r.step_id: r.page_caption for r in steps.collect()} == {1: "home", 2: None}
    el = Q.screen_elements(steps).collect()
    assert [(r.group_name, tuple(r.box), r.label) for r in el] == [("g", (1, 2, 3, 4), "a b")]
    rows = spark.createDataFrame([("b", "train"), ("a", "train"), ("c", "test"), ("a", "train")], "episode_id string, split string")
    assert nested_json.chosen_episodes(rows, "train", most=1).count() == 2


def test_shards(spark, tmp_path):
    write_file(str(tmp_path / "s-0"), [{"episode_id": [1], "goal": ["a"], "shot": [b"x"]}, {"goal": ["no id"]}])
    write_file(str(tmp_path / "s-1"), [{"episode_id": [2], "goal": ["b"], "shot": [b"y"]}], zipped=True)
    schema, path = "episode_id bigint, goal string", str(tmp_path)
    assert sorted((r.shard, r.place, r.goal) for r in read_shards(spark, path, schema).collect()) == [("s-0", 0, "a"), ("s-0", 1, "no id"), ("s-1", 0, "b")]
    splits = spark.createDataFrame([(1, "train"), (2, "test")], "episode_id bigint, split string")
    kept = scan(spark, path, schema, splits, "test")
    assert [r.goal for r in kept.collect()] == ["b"] and scan(spark, path, schema, ids=splits.where("split = 'train'")).count() == 1
    assert [bytes(r.shot) for r in with_late(kept, spark, path, "episode_id", "shot binary").collect()] == [b"y"]
    assert lookup(spark, path, schema, 2).first().goal == "b"
    with pytest.raises(KeyError):
        lookup(spark, path, schema, 3)
    assert read_shards(spark, path, schema, glob_filter="s-1", compression="gzip").count() == 1


def test_settings(spark, tmp_path):
    text = "# c\nexport A=1\nA=2\nB=\"x $A\" \nC='$A'\nD=${A}y # note\nbad line\n"
    assert config.env_values(text) == {"A": "1", "B": "x 1", "C": "$A", "D": "1y"}
    assert config.path_of("data", {"data": "D"}, {"D": "/d"}) == "/d"
    with pytest.raises(ValueError):
        config.path_of("data", {"data": "D"}, {})
    assert config.layered({"a": 1, "o": {"x": 1, "y": 2}}, {"a": None, "o": {"y": 3}, "b": 0}) == {"a": 1, "o": {"x": 1, "y": 3}, "b": 0}
    (tmp_path / "c.json").write_text('{"benchmark": "b"}')
    (tmp_path / "l.json").write_text("[1]")
    assert config.read_config(spark, str(tmp_path / "c.json"), "b") == {"benchmark": "b"}
    for args in ((str(tmp_path / "c.json"), "other"), (str(tmp_path / "l.json"),)):
        with pytest.raises(ValueError):
            config.read_config(spark, *args)
    there = config.listing(spark, str(tmp_path), "*.json")
    assert [r.name for r in there.collect()] == ["c.json", "l.json"]
    states = {r.name: r.state for r in config.reconciled(spark.createDataFrame([("c.json", 18), ("l.json", 9), ("x", 1)], "name string, size bigint"), there).collect()}
    assert states == {"c.json": "verified", "l.json": "mismatched", "x": "missing"}
    config.required(there, ["c.json"])
    with pytest.raises(ValueError, match="y"):
        config.required(there, ["c.json", "y"])
    assert one(spark, config.complete_images(F.lit(2), F.array(F.lit(1), F.lit(0))), config.complete_images(F.lit(2), F.array(F.lit(0))), config.complete_images(F.lit(0), F.array(F.lit(5)))) == [True, False, True]
    meta = one(spark, config.fallback_metadata(F.array(*[F.lit(str(i)) for i in range(40)]), F.lit("parse_failed"), F.lit("e")))[0]
    assert len(meta.fragments) == 32 and meta.degraded and meta.warning.startswith("AndroidControl accessibility parsing")
    path = str(tmp_path / "stage")
    assert not config.is_done(spark, path)
    made = []
    for _ in range(2):
        assert config.once(spark, path, lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1] and config.is_done(spark, path) and config.valid_cache({"benchmark": "b", "manifest": "m", "version": 1}, "b", "m", 1)
    config.manifest(spark, str(tmp_path / "m"), 2, source="s")
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"shards": 2, "source": "s"}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", m, p, g, ms, w) for m, p, g, ms, w in [("baseline", 100, 10, 200.0, 1), ("hybrid", 50, 5, 100.0, 1), ("baseline", 60, None, 100.0, 2), ("hybrid", None, 5, float("nan"), 2)]], "benchmark string, method string, prompt_tokens bigint, generated_tokens bigint, latency_ms double, worker int")
    whole = reports.merged_counters(reports.counters(df, "benchmark"), "benchmark").first()
    assert whole == reports.merged_counters(reports.counters(df, "benchmark", "worker"), "benchmark").first()
    assert (whole.baseline_tokens_total, whole.hybrid_tokens_total, whole.latency_reduction, whole.visual_token_reduction) == (170, 60, round(1 - 100 / 300, 6), 0.0)
    folder = str(tmp_path / "w")
    for w in (0, 1):
        reports.write_partial(df.where(F.col("worker") == w + 1).select("method", "prompt_tokens"), folder, w)
    (tmp_path / "w" / "worker=1" / "part-x.txt").write_text("{broken\n")
    good, bad = reports.read_partials(spark, folder, "method string, prompt_tokens bigint")
    assert [r.worker for r in reports.in_rank_order(good, "method").collect()] == [0, 0, 1, 1] and {r.worker: r.n for r in bad.collect()} == {1: 1}
    text = reports.with_section("# T\n", "s", "one")
    assert reports.with_section(text, "s", "two\\1").count("begin") == 1 and "two\\1" in reports.with_section(text, "s", "two\\1") and reports.with_section(text, "s", "one") == text
    assert reports.with_field("- a: 1\n- b: 2\n", "b", "3") == "- a: 1\n- b: 3\n" and reports.with_field("", "b", "3") == "- b: 3\n"
    assert reports.nested_field({"a": {"b": None}}, "a.b", 7) == 7 and reports.upserted({"a": 1}, b=2) == {"a": 1, "b": 2}
    s = reports.summary({"benchmark": "x", "result_count": 4, "controller_metrics": {"baseline_tokens_total": 1000, "hybrid_tokens_total": 400, "baseline_end_to_end_latency_ms_total": 4000.0, "hybrid_end_to_end_latency_ms_total": 2000.0}, "official_metrics": {"s": {"baseline": {"acc": 0.5}}}})
    assert (s["hybrid_tokens_per_step"], s["speed_up"]) == (100.0, 2.0) and "speed_up: 2.00x" in reports.summary_lines(s) and "s baseline acc: 50.00%" in reports.summary_lines(s)
    empty = reports.summary({})
    assert empty["speed_up"] is None and "speed_up: N/A" in reports.summary_lines(empty) and len(reports.summary_lines(empty, 3)) == 3
    assert reports.by_order(["c", "a", "b"], ["b"]) == ["b", "a", "c"]
    reports.step_report(spark.createDataFrame([("e", 1, "x"), ("e", 0, "y")], "episode_id string, step_index int, goal string"), str(tmp_path / "r"))
    r = json.loads(spark.read.text(str(tmp_path / "r")).first()[0])
    assert (r["format_version"], r["step_count"], [x["goal"] for x in r["steps"]]) == (1, 2, ["y", "x"])


def test_regressor(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8))
    y = 1 / (1 + np.exp(-(x[:, :2] * 1.5)))
    model, losses = N.train(x, y, units=32, epochs=60, rate=2.0, batch=64)
    assert min(losses) < 0.7 * losses[0] and losses.index(min(losses)) >= len(losses) - 1 - 20
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(300)] + [(999, x[0].tolist(), [2.0, 0.5]), (1000, None, None)], "id bigint, h_action array<double>, y array<double>")
    fitted = N.fit(df, N.vector_of(df, "action"), "y", "id", units=16, epochs=30, rate=2.0, batch=64)
    got = {r.id: r.prediction for r in N.predict(df, fitted, "h_action", "id").collect()}
    assert len(got) == 301 and np.allclose(got[5], fitted(x[5:6])[0])
    with pytest.raises(ValueError):
        N.vector_of(df, "thinking_end")
    assert df.select(N.metadata_of(df)).first()[0] == [] and N.predict(df.limit(0), fitted, "h_action", "id").collect() == []


def test_guards(spark):
    assert L.violations({"a": [{"next_step": 1, "ok": {"teacher_x": 2}}], "future_b": {"future_trajectory": 0}}) == ["future_b", "a[0].next_step", "a[0].ok.teacher_x", "future_b.future_trajectory"]
    df = spark.createDataFrame([(1, '{"a": {"goal_status": 1}}'), (2, None)], "id bigint, p string")
    L.assert_clean(df, "id", "p")
    with pytest.raises(ValueError, match="teacher"):
        L.assert_clean(df.unionByName(spark.createDataFrame([(3, '{"a": [{"teacher": 1}]}')], "id bigint, p string")), "id", "p")
    L.assert_artifact_clean({"stats": {"n": 1}, "model": {"feature_names": ["a"]}})
    for bad in ({"stats": {"next_step_x": 1}}, {"model": {"feature_names": ["future_a"]}}):
        with pytest.raises(ValueError):
            L.assert_artifact_clean(bad)


def test_runtime(spark):
    df = spark.createDataFrame([("Go home", "Tap it", "home screen")], "goal string, instruction string, description string").select("*", R.action(F.lit("CLICK")).alias("action"), F.lit(1).alias("target"))
    got = {r["mode"]: (r.instruction, r.action.action_type, r.words.goal_screen, "target" in r) for r in R.runtime_view(df).collect()}
    assert got == {"high_level": (None, "UNOBSERVED", ["home"], False), "low_level": ("Tap it", "UNOBSERVED", ["home"], False)}
    assert R.runtime_view(df, ("low_level",), preserve_action=True).first().action.action_type == "CLICK"
    assert one(spark, R.is_truth_of_screen(F.lit("bound_target.label")), R.is_truth_of_history(F.lit("bound_target.functionality")), R.roi_change(F.lit("type"), F.lit(True)), R.roi_change(F.lit("NAV"), F.lit(True))) == [True, False, None, True]


def test_pictures_and_shards(spark):
    png = b"\x89PNG\r\n\x1a\n" + bytes(8) + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    none = F.lit(None).cast("string")
    got = one(spark, G.picture(none, F.lit(png), F.lit(7), F.lit(None).cast("int")), G.picture(F.lit("p"), F.lit(None).cast("binary"), F.lit(None).cast("int"), F.lit(None).cast("int")))
    assert [tuple(x) for x in got] == [(None, 7, 480, "bytes"), ("p", None, None, "path")]
    from hashlib import blake2b

    assert one(spark, Q.shard_of(F.lit("k"), F.lit(7)), Q.shard_of(none, F.lit(7))) == [int.from_bytes(blake2b(b"k", digest_size=8).digest(), "big") % 7, None]
    df = spark.createDataFrame([("a", "4.9.0"), ("a", "4.10.0"), ("b", "1")], "k string, v string")
    assert {r.k: r.v for r in Q.latest(df, "v", "k").collect()} == {"a": "4.10.0", "b": "1"}


def naive_farthest(vectors, share):
    x = np.asarray(vectors, float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    chosen = [int(np.argmax(np.sort(d, axis=1)[:, 1]))]
    while len(chosen) < max(1, round(share * len(x))):
        rest = d[:, chosen].min(1)
        rest[chosen] = -9
        chosen.append(int(np.argmax(rest)))
    return sorted(chosen)


@pytest.mark.parametrize("n,k,share", [(5, 4, 0.4), (8, 4, 1.0), (10, 4, 1e-9), (15, 6, 0.5), (20, 8, 0.3)])
def test_farthest(spark, n, k, share):
    x = np.random.default_rng(n).normal(size=(n, k))
    assert farthest_points(list(x), share, block=3) == naive_farthest(x, share)


def test_farthest_by_group(spark):
    x = np.random.default_rng(1).normal(size=(12, 3))
    df = spark.createDataFrame([(i % 2, i, x[i].tolist()) for i in range(12)] + [(0, 99, None)], "g int, id bigint, v array<double>")
    got = sorted((r.g, r.id) for r in farthest_by_group(df, "g", "id", "v", 0.5).collect())
    assert got == sorted((g, 2 * i + g) for g in (0, 1) for i in naive_farthest(x[g::2], 0.5))


def test_vectors_and_summaries(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id bigint, v array<double>")
    N.checked_vectors(df, "v", 2)
    N.save_vectors(df, "v", str(tmp_path / "v"))
    for bad, n in ((df.unionByName(spark.createDataFrame([(3, [1.0])], df.schema)), None), (df.unionByName(spark.createDataFrame([(3, None)], df.schema)), None), (df, 3)):
        with pytest.raises(ValueError):
            N.checked_vectors(bad, "v", n)
    with pytest.raises(ValueError):
        N.same_columns(df.withColumn("w", F.lit(1)), "id", "w")
    model = N.Regressor.new(3, 4, 2)
    N.save(model, spark, str(tmp_path / "m"), epoch=3)
    again, info = N.load(spark, str(tmp_path / "m"))
    assert info == {"epoch": 3} and np.allclose(again(np.ones((1, 3))), model(np.ones((1, 3))))
    losses = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.2), ("a", 2, 0.2)], "variant string, epoch int, loss double")
    assert json.loads(N.best_epochs(losses).first().summary) == {"best_epoch": 1, "best_loss": 0.2, "epochs": 3}
    paths = reports.write_summaries(spark, str(tmp_path / "run"), {"benchmark": "b", "status": "promoted"})
    assert "benchmark: b" in "\n".join(r.value for r in spark.read.text(paths["lines"]).collect())
    assert reports.read_runs(spark, paths["report"], "promoted").count() == 1 and reports.read_runs(spark, paths["report"], "aborted").count() == 0
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "list.json").write_text("[]")
    assert [reports.json_state(spark, str(tmp_path / x)) for x in ("none", "bad.json", "list.json", "run/report")] == ["missing", "unreadable", "no object", "object"]
