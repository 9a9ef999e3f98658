"""Queries over steps, results and timings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepweave.cluster import table
from stepweave.functions import geometry as G
from stepweave.functions import text as T
from stepweave.operators import actions as A
from stepweave.operators import adapter as D
from stepweave.operators import metrics as M
from stepweave.operators import payloads as L
from stepweave.operators import records as R
from stepweave.operators import requests as Q
from stepweave.operators import scoring as C
from stepweave.operators import sequence as S
from stepweave.operators import spatial as P
from stepweave.operators.shred import action_paths as object_paths
from stepweave.operators.shred import ui_nodes
from stepweave.sources import reports
from stepweave.sources.sinks import chat_rows
from stepweave.streaming.metrics import running, stream_files

ORDER = ("step_index", "step_id")


def _judged(spark: SparkSession, root: str) -> DataFrame:
    return M.judged(table(spark, root, "step_results"), table(spark, root, "eval_examples"))


def accuracy_by_partition(spark: SparkSession, root: str) -> DataFrame:
    return M.accuracy_by_partition(_judged(spark, root))


def accuracy_delta(spark: SparkSession, root: str) -> DataFrame:
    return M.accuracy_delta(accuracy_by_partition(spark, root))


def mode_metrics(spark: SparkSession, root: str) -> DataFrame:
    return M.mode_metrics(_judged(spark, root))


def shot_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Of LearnGUI per shot count: shares of right types (a call of the type of the example's first sound baseline call) and of right steps, by method, and their differences."""
    r = _judged(spark, root).where("benchmark = 'LearnGUI' and shot_count is not null").withColumn("kind", A.from_call(F.col("raw_output"))["action_type"])
    truth = r.where("method = 'baseline' and primary_correct and kind is not null").groupBy("example_id").agg(F.min_by("kind", "result_id").alias("true_kind"))
    r = r.join(truth, "example_id", "left").withColumn("type_ok", F.col("primary_correct") | (F.col("kind") == F.col("true_kind")))
    of = lambda m, c: M.share_if(F.col("method") == m, F.col(c))
    names = {"type": "type_ok", "match": "primary_correct"}
    g = r.groupBy("shot_count").agg(*[F.round(of(m, c), 6).alias(f"{m}_{n}") for m in ("baseline", "hybrid") for n, c in names.items()])
    return g.select("*", *[F.round(F.col(f"hybrid_{n}") - F.col(f"baseline_{n}"), 6).alias(f"delta_{n}") for n in names])


def phase_summary(spark: SparkSession, root: str) -> DataFrame:
    methods = table(spark, root, "step_results").select("result_id", "method")
    rows = M.phase_rows(table(spark, root, "step_timings").join(methods, "result_id"), "method")
    return M.merge_phases(M.phase_partials(rows, "method"), "method")


def phase_merge(spark: SparkSession, root: str) -> DataFrame:
    """Partial states by worker, then their final merge: equal to the summary of all rows."""
    partials = M.phase_partials(M.phase_rows(table(spark, root, "step_timings"), "worker_id"), "worker_id")
    return M.merge_phases(partials.drop("worker_id"))


def phase_comparison(spark: SparkSession, root: str) -> DataFrame:
    s = phase_summary(spark, root)
    side = lambda m: s.where(F.col("method") == m).select("phase", F.col("mean").alias(f"{m}_mean"))
    order = spark.createDataFrame([(i, p) for i, p in enumerate(M.PHASES)], "place int, phase string")
    both = F.broadcast(order).join(side("baseline"), "phase", "left").join(side("hybrid"), "phase", "left")
    return both.select("place", "phase", "baseline_mean", "hybrid_mean", F.round(F.try_divide("baseline_mean", "hybrid_mean"), 3).alias("speed_up"))


def token_totals(spark: SparkSession, root: str) -> DataFrame:
    n = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("bigint")
    r = table(spark, root, "step_results").groupBy("benchmark", "method").agg(F.count("*").alias("n_steps"), n("prompt_tokens").alias("prompt_tokens"), n("generated_tokens").alias("generated_tokens"), n("full_model_calls").alias("full_calls"), n("local_model_calls").alias("local_calls"))
    return r.withColumn("tokens_per_step", F.round((F.col("prompt_tokens") + F.col("generated_tokens")) / F.greatest(F.lit(1), F.col("n_steps")), 4))


def call_reduction(spark: SparkSession, root: str) -> DataFrame:
    t = token_totals(spark, root)
    side = lambda m: t.where(F.col("method") == m).select("benchmark", F.col("full_calls").alias(f"{m}_calls"), (F.col("prompt_tokens") + F.col("generated_tokens")).alias(f"{m}_tokens"))
    both = side("baseline").join(side("hybrid"), "benchmark")
    less = lambda h, b: F.round(F.coalesce(F.when(F.col(b) > 0, 1 - F.col(h) / F.col(b)), F.lit(0.0)), 6)
    return both.select("benchmark", less("hybrid_calls", "baseline_calls").alias("call_reduction"), less("hybrid_tokens", "baseline_tokens").alias("token_reduction"))


def latency_quantiles(spark: SparkSession, root: str) -> DataFrame:
    rows = _judged(spark, root).select("part", "method", M.sane(F.col("latency_ms")).alias("ms")).where("ms is not null")
    ranks = {name: M.nearest_index(q) for name, q in (("q025", 0.025), ("q500", 0.5), ("q975", 0.975))}
    return M.exact_ranks(rows, ["part", "method"], "ms", ranks).select("part", "method", "n", F.col("rank").alias("quantile"), F.col("value").alias("ms"))


def upper_median(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "step_timings").select("worker_id", M.sane(F.col("prefill_ms")).alias("ms")).where("ms is not null")
    return M.exact_ranks(rows, ["worker_id"], "ms", {"median": F.floor(F.col("n") / 2).cast("bigint")}).select("worker_id", "n", F.col("value").alias("median"))


def decode_bands(spark: SparkSession, root: str) -> DataFrame:
    ms = M.sane(F.col("decode_ms"))
    return table(spark, root, "step_timings").where(ms.isNotNull()).groupBy("worker_id").agg(F.count("*").alias("n"), F.round(F.avg((ms <= 20).cast("int")), 6).alias("within_20"), F.round(F.avg((ms <= 50).cast("int")), 6).alias("within_50"))


def group_spread(spark: SparkSession, root: str) -> DataFrame:
    """Mean and sample deviation, 0 for a single value."""
    t = table(spark, root, "step_results").select("group_id", F.col("prompt_tokens").cast("double").alias("v")).where("v is not null")
    return t.groupBy("group_id").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 3).alias("deviation"))


def task_export(spark: SparkSession, root: str) -> DataFrame:
    """A task is an episode in one mode by one method: its steps in order and its own averages."""
    r = _judged(spark, root).withColumn("ok", F.coalesce("primary_correct", F.lit(False)))
    g = r.groupBy("benchmark", "episode_id", "mode", "method").agg(F.count("*").alias("n_steps"), F.min("ok").alias("all_correct"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("accuracy"), F.sort_array(F.collect_list(F.struct("step_index", "result_id"))).alias("steps"))
    return g.select("benchmark", "episode_id", "mode", "method", "n_steps", "all_correct", "accuracy", F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["step_index"].cast("string"), s["result_id"].cast("string"))), ",").alias("steps"))


def micro_macro(spark: SparkSession, root: str) -> DataFrame:
    """Step average and task average per method, and whether they differ by more than 0.002."""
    r = _judged(spark, root).withColumn("ok", F.coalesce("primary_correct", F.lit(False)).cast("int"))
    tasks = r.groupBy("benchmark", "episode_id", "mode", "method").agg(F.count("*").alias("n"), F.sum("ok").alias("right"))
    g = tasks.groupBy("method").agg(F.round(F.sum("right") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("right") / F.col("n")), 6).alias("macro"))
    return g.withColumn("differs", F.abs(F.col("micro") - F.col("macro")) > 0.002)


def error_audit(spark: SparkSession, root: str) -> DataFrame:
    """Accepted errors: examples that hybrid answered without a full model call, and wrongly; the first 50 in order (the report's limit), each with the count of all."""
    r = table(spark, root, "step_results").select("example_id", "method", "result_id", "primary_correct", "full_model_calls", "episode_id", "step_index")
    hybrid = r.where("method = 'hybrid'").groupBy("example_id").agg(F.min_by(F.struct("result_id", "episode_id", "step_index", "primary_correct", "full_model_calls"), "result_id").alias("h"))
    baseline = r.where("method = 'baseline'").groupBy("example_id").agg(F.min_by("primary_correct", "result_id").alias("baseline_correct"))
    wrong = hybrid.where("h.full_model_calls = 0 and not coalesce(h.primary_correct, false)").select("example_id", "h.episode_id", "h.step_index", "h.result_id")
    first = wrong.orderBy("example_id").limit(50).join(baseline, "example_id", "left").withColumn("baseline_correct", F.coalesce("baseline_correct", F.lit(False)))
    # one row beside the 50; with no error it stands alone
    return wrong.agg(F.count("*").alias("n_all")).join(first, how="left").select("example_id", "episode_id", "step_index", "result_id", "baseline_correct", "n_all")


def instruction_index(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "steps")
    return S.with_change_index(s, "step_instruction", S.by_episode(*ORDER), "high_level_index").select("step_id", "high_level_index")


def _typed(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "steps")
    return s.withColumn("action", A.from_payload(A.payload(F.col("raw_action"))))


def action_history(spark: SparkSession, root: str) -> DataFrame:
    w = S.by_episode(*ORDER)
    return _typed(spark, root).select("step_id", F.array_join(S.history(F.col("action.action_type"), w), ">").alias("history"))


def next_features(spark: SparkSession, root: str) -> DataFrame:
    w = S.by_episode(*ORDER)
    return _typed(spark, root).select("step_id", F.lead("screenshot.path").over(w).alias("next_path"), S.effect(F.col("screenshot.path"), w).alias("screen_changes"), S.effect(F.col("step_instruction"), w).alias("instruction_changes"), S.is_last(w).alias("terminal"))


def typed_into(spark: SparkSession, root: str) -> DataFrame:
    """For a text entry right after a click, where that click was."""
    w = S.by_episode(*ORDER)
    s = _typed(spark, root).select("step_id", F.col("action.action_type").alias("kind"), F.lag("action").over(w).alias("before"))
    return s.where("kind = 'TYPE' and before.action_type = 'CLICK'").select("step_id", "before.x", "before.y")


def accepted_prefix(spark: SparkSession, root: str) -> DataFrame:
    """Steps of an episode that are right before the first wrong one, per method: first wrong position by an aggregate, no list."""
    r = table(spark, root, "step_results").withColumn("ok", F.coalesce("primary_correct", F.lit(False)))
    w = Window.partitionBy("benchmark", "episode_id", "method").orderBy("step_index", "result_id")
    ranked = r.withColumn("at", F.row_number().over(w) - 1)
    g = ranked.groupBy("benchmark", "episode_id", "method").agg(F.count("*").alias("n"), F.min(F.when(~F.col("ok"), F.col("at"))).alias("first_wrong"))
    return g.select("benchmark", "episode_id", "method", F.coalesce("first_wrong", "n").cast("bigint").alias("accepted"))


def canonical_actions(spark: SparkSession, root: str) -> DataFrame:
    return _typed(spark, root).select("step_id", "action.action_type", "action.x", "action.y", "action.argument")


def action_mix(spark: SparkSession, root: str) -> DataFrame:
    return canonical_actions(spark, root).groupBy("action_type").agg(F.count("*").alias("n"))


def output_calls(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "step_results").select("result_id", A.from_call(F.col("raw_output")).alias("call"))
    return r.where("call.action_type is not null").select("result_id", "call.action_type", "call.x", "call.y", "call.argument")


def method_agreement(spark: SparkSession, root: str) -> DataFrame:
    """How often the two methods' calls for an example match, per type of the baseline's."""
    r = table(spark, root, "step_results").select("example_id", "method", "result_id", A.from_call(F.col("raw_output")).alias("call")).where("call.action_type is not null")
    side = lambda m: r.where(F.col("method") == m).groupBy("example_id").agg(F.min_by("call", "result_id").alias(m))
    both = side("baseline").join(side("hybrid"), "example_id")
    return both.groupBy(F.col("baseline.action_type").alias("action_type")).agg(F.count("*").alias("n"), F.sum(A.matches(F.col("baseline"), F.col("hybrid")).cast("int")).alias("n_match"))


def click_scales(spark: SparkSession, root: str) -> DataFrame:
    s = _typed(spark, root).where("action.x is not null and screenshot.width > 0 and screenshot.height > 0")
    x, y, w, h = F.col("action.x"), F.col("action.y"), F.col("screenshot.width"), F.col("screenshot.height")
    return s.select("step_id", G.to_thousand(x, w).alias("x_999"), G.to_thousand_clamped(y, h).alias("y_999"), G.to_pixel(G.to_thousand(x, w), w).alias("x_back"), G.visual_tokens(w, h).alias("visual_tokens"))


def goal_text(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "episodes")
    return e.select("row_id", T.normalize(F.col("goal")).alias("goal"), T.underscored(F.col("app")).alias("app"), T.canonical(F.col("split"), T.SPLITS).alias("split"))


def instruction_overlap(spark: SparkSession, root: str) -> DataFrame:
    """F1 of the tokens of each step's instruction and its episode's goal."""
    goals = table(spark, root, "episodes").groupBy("dataset", "episode_id").agg(F.max_by("goal", "row_id").alias("goal"))
    s = table(spark, root, "steps").join(goals, ["dataset", "episode_id"])
    return s.select("step_id", F.round(T.overlap_f1(T.tokens(F.col("step_instruction")), T.tokens(F.col("goal"))), 6).alias("f1"))


def split_lookup(spark: SparkSession, root: str) -> DataFrame:
    """Steps per split: each episode's split is that of its last delivery; steps of unknown episodes apart."""
    e = table(spark, root, "episodes").groupBy("dataset", "episode_id").agg(F.max_by(F.coalesce(T.canonical(F.col("split"), T.SPLITS), F.lit("none")), "row_id").alias("split"))
    s = table(spark, root, "steps").join(e, ["dataset", "episode_id"], "left")
    return s.groupBy(F.coalesce("split", F.lit("missing")).alias("split")).agg(F.count("*").alias("n_steps"), F.countDistinct("dataset", "episode_id").alias("n_episodes"))


def missing_episodes(spark: SparkSession, root: str) -> DataFrame:
    """Episodes of AndroidControl without a record of their screens: requested minus found."""
    have = table(spark, root, "android_records").select(F.explode(F.col("episode_id").cast("array<string>")).alias("episode_id")).distinct()
    return table(spark, root, "episodes").where("dataset = 'AndroidControl'").select("episode_id").distinct().join(have, "episode_id", "left_anti")


def group_sources(spark: SparkSession, root: str) -> DataFrame:
    """The sources of each group in order, each once; distinct before they are gathered."""
    d = table(spark, root, "step_results").select("group_id", "source").where("source is not null").distinct()
    return d.groupBy("group_id").agg(F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"))


def call_reconciliation(spark: SparkSession, root: str) -> DataFrame:
    """Expected calls of results against timed ones: verified, mismatched, missing, unexpected."""
    want = table(spark, root, "step_results").select("result_id", (F.coalesce("full_model_calls", F.lit(0)) + F.coalesce("local_model_calls", F.lit(0))).alias("calls"))
    have = table(spark, root, "step_timings").groupBy("result_id").agg(F.count("*").alias("timed"))
    kind = F.when(F.col("calls").isNull(), "unexpected").when(F.col("timed").isNull(), F.when(F.col("calls") > 0, "missing").otherwise("verified")).when(F.col("calls") == F.col("timed"), "verified").otherwise("mismatched")
    return want.join(have, "result_id", "full").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def prompts(spark: SparkSession, root: str) -> DataFrame:
    """A prompt for each step from goal, instruction and the types done before."""
    goals = table(spark, root, "episodes").groupBy("dataset", "episode_id").agg(F.max_by("goal", "row_id").alias("goal"))
    w = S.by_episode(*ORDER)
    s = _typed(spark, root).withColumn("done", S.history(F.lower("action.action_type"), w)).join(goals, ["dataset", "episode_id"])
    lines = F.concat_ws("\n", F.concat(F.lit("Goal: "), "goal"), F.concat(F.lit("Step: "), "step_instruction"), F.when(F.size("done") > 0, F.concat(F.lit("Done: "), F.array_join("done", ", "))))
    return s.select("step_id", lines.alias("prompt"))


def chat_lines(spark: SparkSession, root: str) -> DataFrame:
    return chat_rows(table(spark, root, "training_examples"))


def bound_clicks(spark: SparkSession, root: str) -> DataFrame:
    """Clicks of steps bound to the smallest node of their record's tree at that step."""
    records = table(spark, root, "android_records")
    keys = records.select("record_id", F.explode("episode_id").alias("episode")).distinct()
    clicks = _typed(spark, root).where("action.x is not null and dataset = 'AndroidControl'").select(F.col("step_id").alias("point_id"), "step_index", F.expr("try_cast(episode_id as bigint)").alias("episode"), F.col("action.x").alias("x"), F.col("action.y").alias("y"))
    points = clicks.join(keys, "episode").groupBy("point_id", "step_index", "x", "y").agg(F.min("record_id").alias("record_id"))
    # trees are shredded where they lie; what is shuffled are the boxes and what a label needs
    nodes = ui_nodes(records, leaves=("bbox", "text", "content_description", "view_id_resource_name", "depth"))
    return P.bind_points(points, nodes, ["record_id", "step_index"])


def node_candidates(spark: SparkSession, root: str) -> DataFrame:
    records = table(spark, root, "android_records")
    sizes = records.select("record_id", F.posexplode(F.arrays_zip("screenshot_widths", "screenshot_heights")).alias("step_index", "size"))
    screens = sizes.select("record_id", "step_index", F.col("size.screenshot_widths").alias("width"), F.col("size.screenshot_heights").alias("height"))
    return P.candidates(ui_nodes(records, leaves=True), screens=screens)


def accuracy_interval(spark: SparkSession, root: str) -> DataFrame:
    return M.bootstrap(table(spark, root, "step_results"), "group_id", "primary_correct")


def benchmark_intervals(spark: SparkSession, root: str) -> DataFrame:
    """The reference's evaluation statistics: five metrics per benchmark over 1,000 resamples."""
    shots = table(spark, root, "eval_examples").groupBy("example_id").agg(F.min("shot_count").alias("shot_count"))
    r = table(spark, root, "step_results").withColumn("mode", T.canonical(F.col("instruction_mode"), T.MODES))
    return M.benchmark_bootstrap(r.join(shots, "example_id", "left"))


def running_metrics(spark: SparkSession, root: str) -> DataFrame:
    return running(table(spark, root, "step_results"))


def stream_metrics(spark: SparkSession, root: str) -> DataFrame:
    return stream_files(spark, f"{root}/step_results.parquet")


def pending_results(spark: SparkSession, root: str) -> DataFrame:
    """Examples that no method has answered yet: what a resumed run would do."""
    return table(spark, root, "eval_examples").join(table(spark, root, "step_results").select("example_id"), "example_id", "left_anti").select("example_id")


def screen_text(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "android_records").select("record_id", F.posexplode("screen_descriptions").alias("step_index", "raw"))
    return d.where("raw is not null").select("record_id", "step_index", T.bounded_fragments(F.decode("raw", "UTF-8")).alias("text"))


def tool_calls(spark: SparkSession, root: str) -> DataFrame:
    body = L.tool_call(F.col("raw_output"))
    r = table(spark, root, "step_results").select("result_id", L.from_tool_call(body).alias("call"))
    return r.where("call.action_type is not null").select("result_id", "call.*")


def repaired_calls(spark: SparkSession, root: str) -> DataFrame:
    """What can be read of calls whose end is lost."""
    r = table(spark, root, "step_results").where("raw_output like '%<tool_call>%' and raw_output not like '%</tool_call>%'")
    fixed = r.select("result_id", L.repaired(F.regexp_extract("raw_output", r"(?is)<tool_call>\s*(.*)$", 1)).alias("body"))
    return fixed.where("body is not null").select("result_id", "body", L.from_tool_call(F.col("body")).alias("call")).select("result_id", "body", "call.*")


def payload_paths(spark: SparkSession, root: str) -> DataFrame:
    return L.key_paths(table(spark, root, "steps"), "step_id", "raw_action").groupBy("path", "kind").agg(F.count("*").alias("n"))


def leaking_steps(spark: SparkSession, root: str) -> DataFrame:
    return L.leaking_paths(L.key_paths(table(spark, root, "steps"), "step_id", "raw_action"))


def runtime_views(spark: SparkSession, root: str) -> DataFrame:
    """Each step as a model sees it in either mode: without its instruction and action in the high-level one."""
    s = _typed(spark, root).select("step_id", "step_instruction", "action.action_type", F.explode(F.array(F.lit("high_level"), F.lit("low_level"))).alias("mode"))
    low = F.col("mode") == "low_level"
    return s.select("step_id", "mode", F.when(low, F.col("step_instruction")).alias("instruction"), F.when(low, F.col("action_type")).otherwise("UNOBSERVED").alias("action_type"))


def accuracy_pivot(spark: SparkSession, root: str) -> DataFrame:
    """Partitions by modes: shares of right steps."""
    return _judged(spark, root).groupBy("part").pivot("mode", ["high_level", "low_level"]).agg(F.round(M.share(F.col("primary_correct")), 6))


def best_configs(spark: SparkSession, root: str) -> DataFrame:
    """Per method the config with the highest share of right steps (the smallest id of equal ones), and its tokens."""
    c = table(spark, root, "step_results").where("config_id is not null").groupBy("method", "config_id").agg(F.round(M.share(F.col("primary_correct")), 6).alias("accuracy"), F.round(F.avg("generated_tokens"), 4).alias("tokens"))
    return c.groupBy("method").agg(F.min_by(F.struct("config_id", "accuracy", "tokens"), F.struct(-F.col("accuracy"), "config_id")).alias("best")).select("method", "best.*")


def phase_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Share of calls whose parts add up to their total within 30 %."""
    total = M.sane(F.col("total_e2e_step_ms"))
    parts = sum((F.coalesce(M.sane(F.col(c)), F.lit(0.0)) for c in ("image_prep_ms", "message_build_ms", "total_generation_ms", "output_parse_ms")), F.lit(0.0))
    t = table(spark, root, "step_timings").where(total > 0)
    return t.groupBy("worker_id").agg(F.count("*").alias("n"), F.round(F.avg((F.abs(parts - total) / total < 0.3).cast("int")), 6).alias("covered"))


def prompt_cost(spark: SparkSession, root: str) -> DataFrame:
    """Words and estimated tokens of prompts, and visual tokens of their screenshots."""
    t = table(spark, root, "training_examples")
    return t.select("example_id", F.greatest(F.lit(1), F.floor(F.length("prompt_text") / 4)).cast("bigint").alias("text_tokens"), G.visual_tokens(F.col("screenshot.width"), F.col("screenshot.height")).alias("visual_tokens"))


def shard_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Groups over 16 shards by a hash that any system has."""
    shard = F.pmod(F.conv(F.substring(F.md5("group_id"), 1, 8), 16, 10).cast("bigint"), F.lit(16))
    return table(spark, root, "step_results").where("group_id is not null").groupBy(shard.alias("shard")).agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("n_groups"))


def latency_text(spark: SparkSession, root: str) -> DataFrame:
    """Total latency per method as text, and the share of calls it saves."""
    m = table(spark, root, "step_results").groupBy("method").agg(F.sum(M.sane(F.col("latency_ms")).cast(M.EXACT)).cast("double").alias("ms"), F.round(M.share(F.col("full_model_calls") == 0), 6).alias("saved"))
    return m.select("method", T.duration(F.col("ms") / 1000).alias("total"), T.percent(F.col("saved")).alias("saved"))


def action_paths(spark: SparkSession, root: str) -> DataFrame:
    """Depth and path of every action object from its payload's root, from its levels."""
    return object_paths(table(spark, root, "steps"))


def record_steps(spark: SparkSession, root: str) -> DataFrame:
    """One row per action of each record, its parallel arrays zipped, with the types done before."""
    steps = R.with_fields(R.step_rows(table(spark, root, "android_records")).withColumn("v", A.payload(F.col("raw_action"))), F.col("v"))
    return steps.select("record_id", "step_index", "episode_id", "goal", "instruction", "width", "height", "next_instruction", "high_level_index", "n_screens", R.first_action()["action_type"].alias("action_type"), F.col("next_width").isNull().alias("terminal"))


def canonical_records(spark: SparkSession, root: str) -> DataFrame:
    """Steps of both datasets as canonical records: action, target, effect and overlaps of words. Nodes are bound by `bound_clicks`; here a click's target is its point."""
    w = S.by_episode(*ORDER)
    goals = table(spark, root, "episodes").groupBy("dataset", "episode_id").agg(F.max_by("goal", "row_id").alias("goal"))
    s = table(spark, root, "steps").join(goals, ["dataset", "episode_id"], "left").withColumn("v", A.payload(F.col("raw_action"))).withColumn("next", F.lead(F.struct("step_instruction")).over(w)).withColumn("n", F.lead(F.lit(1)).over(w))
    s = R.with_fields(s, F.col("v"))
    p = R.point_of()
    get = lambda k: F.col(f"j_{k}")
    said = F.coalesce(get("text"), get("direction"), get("app_name"))
    written = F.concat(F.upper(get("action_type")), F.when(said.isNotNull(), F.concat(F.lit("["), said, F.lit("]"))).otherwise(F.lit("")))
    none = F.lit(None).cast("array<array<int>>")
    second = R.second_action(written, F.lit(None).cast("string"), F.when(p.isNotNull(), F.array(p["x"], p["y"])), F.lit(None).cast("array<int>"), get("text"), none)
    s = s.withColumn("own", F.when(F.col("dataset") == "AndroidControl", R.first_action()).when(F.col("dataset") == "LearnGUI", second))
    found = F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast(R.BOX).alias("box"))
    s = s.withColumn("target", R.first_target(F.col("own"), found)).withColumn("action", R.bound(F.col("own"), F.col("target")))
    s = s.withColumn("words", R.lexical_alignment(F.col("goal"), F.lit(None).cast("string"), F.col("action.argument"), F.col("step_instruction"), F.col("target.label")))
    changes = ~F.col("step_instruction").eqNullSafe(F.col("next.step_instruction"))
    joined = lambda c: F.array_join(f"words.{c}", " ")
    return s.select("step_id", "dataset", "action.action_type", "action.argument", F.col("action.box.l").alias("l"), F.col("action.box.b").alias("b"), "action.app", "action.direction", F.col("target.source").alias("source"), F.col("n").isNull().alias("terminal"), changes.alias("instruction_changed"), R.effect_kind(F.col("action.action_type")).alias("effect_kind"), joined("goal_argument").alias("goal_argument"), joined("action_screen").alias("action_screen"))


def step_matches(spark: SparkSession, root: str) -> DataFrame:
    """Outputs against the steps they answer, by the benchmarks' rules: per benchmark, method and true type the outputs with an action and the matching ones."""
    first = table(spark, root, "steps").groupBy(F.col("dataset").alias("benchmark"), "episode_id", "step_index").agg(F.min_by(F.struct("raw_action", "screenshot"), "step_id").alias("s"))
    body = F.try_parse_json(L.tool_call(F.col("raw_output")))
    called = F.struct(F.try_variant_get(body, "$.arguments.action", "string").alias("kind"), *[F.try_variant_get(body, f"$.arguments.coordinate[{i}]", "double").alias(x) for i, x in enumerate("xy")], F.coalesce(*[F.try_variant_get(body, f"$.arguments.{k}", "string") for k in ("text", "direction", "app_name", "goal_status", "seconds")]).alias("argument"))
    r = table(spark, root, "step_results").where("raw_output is not null").withColumn("c", called).where("c.kind is not null")
    names = F.create_map(*[F.lit(x) for x in ("type", "input_text", "tap", "click", "swipe", "scroll", "terminate", "status")])
    kind = F.coalesce(names[F.lower("c.kind")], F.lower("c.kind"))
    r = r.select("benchmark", "method", "episode_id", "step_index", kind.alias("kind"), "c.x", "c.y", "c.argument")
    j = r.join(first, ["benchmark", "episode_id", "step_index"]).withColumn("v", A.payload(F.col("s.raw_action"))).where("v is not null")
    j = R.with_fields(j, F.col("v"))
    found = F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast(R.BOX).alias("box"))
    j = j.withColumn("truth", R.first_truth(found)).where("truth.type is not null")
    value = F.col("argument")
    predicted = R._comparable(type=F.col("kind"), x=F.col("x"), y=F.col("y"), text=T.normalize(value), direction=T.normalize(value), app=T.normalize(value), status=T.normalize(value), seconds=value.try_cast("double"))
    return j.groupBy("benchmark", "method", F.col("truth.type").alias("true_type")).agg(F.count("*").alias("n"), F.sum(C.first_benchmark(F.col("truth"), predicted).cast("int")).alias("n_match"))


def adapted_outputs(spark: SparkSession, root: str) -> DataFrame:
    """The action that each output means, whatever its form: calls, JSON with its end lost, bracket calls, fragments."""
    none = F.lit(None).cast("int")
    r = table(spark, root, "step_results").where("raw_output is not null").select("result_id", D.output_action("raw_output", none, none).alias("a"))
    return r.where("a.action_type is not null").select("result_id", "a.action_type", "a.argument", "a.box", "a.app", "a.direction")


def adapted_actions(spark: SparkSession, root: str) -> DataFrame:
    """The adapter's reading of every payload, coordinates as recorded."""
    none = F.lit(None).cast("int")
    s = table(spark, root, "steps").select("step_id", D.payload_action("raw_action", none, none).alias("a"))
    return s.where("a.action_type is not null").select("step_id", "a.action_type", "a.argument", F.col("a.box.l").alias("l"), F.col("a.box.b").alias("b"), "a.app", "a.direction")


def answer_texts(spark: SparkSession, root: str) -> DataFrame:
    """The training response and the forced prefix of every step's action."""
    s = R.with_fields(table(spark, root, "steps").withColumn("v", A.payload(F.col("raw_action"))), F.col("v")).withColumn("a", R.first_action())
    return s.select("step_id", R.response_text(F.col("a"), F.coalesce("screenshot.width", F.lit(1080)), F.coalesce("screenshot.height", F.lit(1920))).alias("response"), R.forced_prefix(F.col("step_instruction"), F.col("a.action_type"), "template", "coord_bracket").alias("prefix"))


def worker_reports(spark: SparkSession, root: str) -> DataFrame:
    """Ten counters by worker (the one that timed most of a result's calls), merged, with their reductions: equal to those of all rows."""
    calls = table(spark, root, "step_timings").where("worker_id is not null").groupBy("result_id", "worker_id").agg(F.count("*").alias("n"))
    worker = calls.groupBy("result_id").agg(F.min_by("worker_id", F.struct(-F.col("n"), "worker_id")).alias("worker_id"))
    rows = table(spark, root, "step_results").join(worker, "result_id", "left").withColumn("worker_id", F.coalesce("worker_id", F.lit("none")))
    partials = reports.counters(rows, "benchmark", "worker_id")
    return reports.merged_counters(partials, "benchmark")


def shared_keys(spark: SparkSession, root: str) -> DataFrame:
    """Requests of examples that would be answered once: their cache key and how many ask it."""
    e = table(spark, root, "eval_examples")
    return e.groupBy(Q.cache_key(F.col("benchmark"), F.col("prompt_text"), F.col("shot_count")).alias("key")).agg(F.count("*").alias("n")).where("n > 1").groupBy("n").agg(F.count("*").alias("n_keys"))


def request_rows(spark: SparkSession, root: str) -> DataFrame:
    """Every result's request parameters: those of its configuration, defaults for unknown ones."""
    r = table(spark, root, "step_results").select("result_id", "config_id")
    return Q.with_parameters(r, table(spark, root, "fallback_configs")).select("result_id", *Q.DEFAULTS)


def safe_crops(spark: SparkSession, root: str) -> DataFrame:
    """The strip of each screen at a click's height, grown to a permitted ratio, and the size it is scaled to."""
    s = _typed(spark, root).where("action.y is not null and screenshot.width > 0 and screenshot.height > 0")
    w, h, y = F.col("screenshot.width"), F.col("screenshot.height"), F.col("action.y").cast("int")
    strip = F.struct(F.lit(0).alias("l"), y.alias("t"), w.alias("r"), (y + 2).alias("b"))
    s = s.select("step_id", G.safe_crop(strip, w, h).alias("c"), w.alias("w"), h.alias("h"))
    return s.select("step_id", "c.l", "c.t", "c.r", "c.b", G.budget_size(F.col("c"), F.col("w"), F.col("h"), F.lit(10_000)).alias("z")).select("step_id", "l", "t", "r", "b", F.col("z.width").alias("z_width"), F.col("z.height").alias("z_height"))


QUERIES = {f.__name__: f for f in (
    accuracy_by_partition, accuracy_delta, mode_metrics, shot_metrics, phase_summary, phase_merge, phase_comparison, token_totals, call_reduction, latency_quantiles, upper_median, decode_bands, group_spread,
    task_export, micro_macro, error_audit, instruction_index, action_history, next_features, typed_into, accepted_prefix, canonical_actions, action_mix, output_calls, method_agreement, click_scales, goal_text,
    instruction_overlap, split_lookup, missing_episodes, group_sources, call_reconciliation, prompts, chat_lines, bound_clicks, node_candidates, accuracy_interval, benchmark_intervals, running_metrics, stream_metrics, pending_results, screen_text,
    tool_calls, repaired_calls, payload_paths, leaking_steps, runtime_views, accuracy_pivot, best_configs, phase_coverage, prompt_cost, shard_sizes, latency_text, action_paths,
    record_steps, canonical_records, step_matches, adapted_outputs, adapted_actions, answer_texts, worker_reports, shared_keys, request_rows, safe_crops,
)}
