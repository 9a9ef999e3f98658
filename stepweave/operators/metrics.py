"""Aggregates of judged steps: accuracies, tokens, timings, exact ranks, bootstrap intervals.

All reduce before they shuffle; groups of any size are never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.cluster import cut
from stepweave.functions.text import MODES, PARTITIONS, canonical
from stepweave.operators.scoring import reduction

PHASES = (
    "image_prep_ms", "message_build_ms", "total_generation_ms", "output_parse_ms", "total_e2e_step_ms", "tokenization_ms", "gpu_transfer_ms", "model_generate_ms", "output_decode_ms",
    "vision_encoder_ms", "attn_scoring_prune_ms", "llm_forward_ms", "prefill_ms", "decode_ms", "decode_steps",
)
#: Exact sums of doubles: as decimals they don't depend on the order of rows.
EXACT = "decimal(30,4)"


def memberships(*sources: Column) -> Column:
    """The canonical partitions of the first source that names any (arrays of labels, or a label); in_distribution without one. Unknown labels stay as they are."""

    def named(label: Column) -> Column:
        return F.coalesce(canonical(label, PARTITIONS), F.nullif(label, F.lit("")))

    lists = [F.nullif(F.array_distinct(F.array_compact(F.transform(s, named))), F.array().cast("array<string>")) for s in sources]
    return F.coalesce(*lists, F.array(F.lit("in_distribution")))


def judged(results: DataFrame, examples: DataFrame) -> DataFrame:
    """step_results with the partitions and mode of their examples; a null partition, or an unknown example, counts as in_distribution."""
    labels = examples.select("example_id", memberships(F.array("partition_name")).alias("parts"), "shot_count")
    known = results.join(labels, "example_id", "left").withColumn("parts", F.coalesce("parts", F.array(F.lit("in_distribution"))))
    return known.withColumn("part", F.col("parts")[0]).withColumn("mode", canonical(F.col("instruction_mode"), MODES))


def share(flag: Column) -> Column:
    """Mean of a boolean, null as false, 0 for no rows."""
    return F.coalesce(F.avg(F.coalesce(flag, F.lit(False)).cast("int")), F.lit(0.0))


def share_if(rows: Column, flag: Column) -> Column:
    """Mean of a boolean over the rows that a condition takes, null as false, 0 for none."""
    return F.coalesce(F.avg(F.when(rows, F.coalesce(flag, F.lit(False)).cast("int"))), F.lit(0.0))


def sane(value: Column) -> Column:
    """A measurement, or null where it is NaN, negative or absurd."""
    return F.when((value >= 0) & (value < 1e12) & ~F.isnan(value), value)


def accuracy_by_partition(rows: DataFrame) -> DataFrame:
    """Of AndroidControl per partition and overall, mode and method: steps, episodes, step and episode accuracy.

    A row counts in each of its partitions; an episode is right if all its steps are.
    """
    both = rows.where("benchmark = 'AndroidControl' and mode is not null").select(F.explode(F.array_union("parts", F.array(F.lit("overall")))).alias("part"), "mode", "method", "episode_id", "primary_correct")
    episodes = both.groupBy("part", "mode", "method", "episode_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("primary_correct", F.lit(False)).cast("int")).alias("right"))
    return episodes.groupBy("part", "mode", "method").agg(
        F.sum("n").alias("n_steps"), F.count("*").alias("n_episodes"), F.round(F.sum("right") / F.sum("n"), 6).alias("step_accuracy"), F.round(F.avg((F.col("right") == F.col("n")).cast("int")), 6).alias("episode_accuracy")
    )


def accuracy_delta(by_partition: DataFrame) -> DataFrame:
    """hybrid minus baseline per partition and mode, absolute and relative (null for a baseline of 0)."""
    side = lambda m: by_partition.where(F.col("method") == m).select("part", "mode", F.col("step_accuracy").alias(m))
    both = side("baseline").join(side("hybrid"), ["part", "mode"], "full")
    return both.select("part", "mode", "baseline", "hybrid", F.round(F.col("hybrid") - F.col("baseline"), 6).alias("delta"), F.round(F.try_divide(F.col("hybrid") - F.col("baseline"), F.col("baseline")), 6).alias("relative"))


def mode_metrics(rows: DataFrame) -> DataFrame:
    """Per mode and method: step accuracy, input and output tokens and latency of an episode, latency of a step (an unknown one counts as 0)."""
    r = rows.where("mode is not null").withColumn("ms", sane(F.col("latency_ms")).cast(EXACT))
    episodes = r.groupBy("mode", "method", "benchmark", "episode_id").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("primary_correct", F.lit(False)).cast("int")).alias("right"), F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("input"), F.sum(F.coalesce("generated_tokens", F.lit(0))).alias("output"), F.sum(F.coalesce("ms", F.lit(0).cast(EXACT))).alias("ms")
    )
    return episodes.groupBy("mode", "method").agg(
        F.sum("n").alias("n_steps"), F.round(F.sum("right") / F.sum("n"), 6).alias("step_accuracy"), F.round(F.sum("input") / F.count("*"), 4).alias("input_tokens_per_episode"), F.round(F.sum("output") / F.count("*"), 4).alias("output_tokens_per_episode"),
        F.round(F.sum("ms").cast("double") / F.sum("n") / 1000, 4).alias("step_seconds"), F.round(F.sum("ms").cast("double") / F.count("*") / 1000, 4).alias("episode_seconds"),
    )


def phase_rows(timings: DataFrame, *keys: str) -> DataFrame:
    """keys, phase, ms: one row per phase of a call, measurements only."""
    return timings.select(*keys, F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), sane(F.col(p)).cast(EXACT).alias("ms")) for p in PHASES])).alias("e")).select(*keys, "e.*").where("ms is not null")


def phase_partials(rows: DataFrame, *keys: str) -> DataFrame:
    """The mergeable state of a group: count, sum, least, most."""
    return rows.groupBy(*keys, "phase").agg(F.count("*").alias("n"), F.sum("ms").cast("decimal(38,4)").alias("total"), F.min("ms").alias("least"), F.max("ms").alias("most"))


def merge_phases(partials: DataFrame, *keys: str) -> DataFrame:
    """Final merge of partial states, empty ones ignored."""
    m = partials.where("n > 0").groupBy(*keys, "phase").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    return m.select(*keys, "phase", "n", F.round(F.col("total").cast("double"), 3).alias("total"), F.round(F.col("total").cast("double") / F.col("n"), 3).alias("mean"), F.round(F.col("least").cast("double"), 3).alias("least"), F.round(F.col("most").cast("double"), 3).alias("most"))


def exact_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """keys, n, rank (its name), value: the values of ranks (from 0, functions of the group's n) in each group, exactly.

    Equal values are counted first, so that ties, however many, are one row; a histogram of
    the different values' magnitudes (some thousand buckets a group) tells in which bucket a
    rank lies, and only the different values of such buckets are sorted. All ranks share one
    pass over the rows.
    """
    r = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    r = r.withColumn("bucket", F.floor(F.log1p(F.abs("v")) * 256).cast("int") * F.when(F.col("v") < 0, -1).otherwise(1))
    counts = r.groupBy(*keys, "bucket").agg(F.sum("c").alias("c"))
    in_group = Window.partitionBy(*keys)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("rank"), rank.alias("wanted")) for name, rank in ranks.items()]))
    placed = counts.withColumn("n", F.sum("c").over(in_group)).withColumn("below", F.sum("c").over(in_group.orderBy("bucket")) - F.col("c"))
    hit = placed.withColumn("r", wanted).where("r.wanted >= below and r.wanted < below + c").select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col("bucket").alias("k_bucket"), "n", "r.rank", "r.wanted", "below")
    same = F.col("bucket") == F.col("k_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    to = F.sum("c").over(Window.partitionBy(*keys, "bucket", "rank").orderBy("v"))
    ordered = r.join(hit, same).withColumn("to", to + F.col("below"))
    return ordered.where("wanted < to and wanted >= to - c").select(*keys, "n", "rank", F.col("v").alias("value"))


def nearest_index(q: float) -> Column:
    """Rank of a quantile by the nearest index: (n - 1) * q, half to even."""
    return F.bround((F.col("n") - 1) * q).cast("bigint")


def number(df: DataFrame, key: str) -> DataFrame:
    """df with no: each row's place from 0 in the order of a unique key. Ranges of the key are numbered apart and shifted by what lies before them."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    ranked = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1)
    return ranked.join(F.broadcast(before), "_part").withColumn("no", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def bootstrap(rows: DataFrame, group: str, flag: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Cluster bootstrap of an accuracy: mean and nearest-index 2.5 and 97.5 % of `draws` resamples of the groups.

    A draw of a group is a hash of the seed, the resample and its place, so that it can be
    repeated anywhere; a resample has as many draws as there are groups.
    """
    sums = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("int")).alias("right"))
    spark = rows.sparkSession
    numbered = number(sums, group)
    size = numbered.count()
    spin = spark.range(draws * size).select(F.floor(F.col("id") / size).cast("bigint").alias("draw"), F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col("id"))), 1, 12), 16, 10).cast("bigint"), F.lit(size)).alias("no"))
    weights = spin.groupBy("draw", "no").agg(F.count("*").alias("w"))
    each = weights.join(numbered, "no").groupBy("draw").agg((F.sum(F.col("w") * F.col("right")) / F.sum(F.col("w") * F.col("n"))).alias("accuracy"))
    low, high = int(round((draws - 1) * 0.025)), int(round((draws - 1) * 0.975))
    ranked = each.withColumn("at", F.row_number().over(Window.orderBy("accuracy", "draw")) - 1)  # as many rows as draws
    return ranked.agg(F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.max(F.when(F.col("at") == low, F.col("accuracy"))), 6).alias("low"), F.round(F.max(F.when(F.col("at") == high, F.col("accuracy"))), 6).alias("high"))


def benchmark_bootstrap(rows: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Cluster bootstrap per benchmark: of five metrics mean, nearest-index 2.5 and 97.5 % and the one-sided 5 % bound of `draws` resamples of the groups.

    rows: step_results with mode and shot_count. The primary accuracy is that of low-level
    steps for AndroidControl, of the first shot count (as text) of the resample for LearnGUI.
    Accepted steps are the examples that hybrid answered without a full model call: the
    reference's own formula isn't in its sources. A metric without rows is 0. Draws are
    those of `bootstrap`, and join sums per group; a null group is a group.
    """
    of = lambda m, v: F.sum(F.when(F.col("method") == m, v).otherwise(F.lit(0)))
    ok, calls = F.coalesce(F.col("primary_correct"), F.lit(False)).cast("bigint"), F.coalesce(F.col("full_model_calls"), F.lit(0)).cast("bigint")
    tokens = (F.coalesce(F.col("prompt_tokens"), F.lit(0)) + F.coalesce(F.col("generated_tokens"), F.lit(0))).cast("bigint")
    ms = F.coalesce(sane(F.col("latency_ms")), F.lit(0.0)).cast(EXACT)
    parts = {"n": F.lit(1), "right": ok, "calls": calls, "tokens": tokens, "ms": ms}
    primary = F.when(F.col("benchmark") == "AndroidControl", F.when(F.col("mode") == "low_level", F.col("mode"))).when(F.col("benchmark") == "LearnGUI", F.concat(F.col("shot_count").cast("string"), F.lit("_shot")))
    examples = rows.where("benchmark is not null").withColumn("part", primary).groupBy("benchmark", "group_id", "part", "example_id").agg(
        *[of(m, v).alias(f"{m}_{k}") for m in ("baseline", "hybrid") for k, v in parts.items()], F.max((F.col("method") == "hybrid") & (F.col("full_model_calls") == 0)).alias("local")
    )
    kept = [f"{m}_{k}" for m in ("baseline", "hybrid") for k in parts]
    accepted = [f"{m}_{k}" for m in ("baseline", "hybrid") for k in ("n", "right")]
    by_part = cut(examples.groupBy("benchmark", "group_id", "part").agg(*[F.sum(k).alias(k) for k in kept], *[F.sum(F.when(F.col("local"), F.col(k)).otherwise(F.lit(0))).alias(f"local_{k}") for k in accepted]))
    names = [*kept, *[f"local_{k}" for k in accepted]]
    groups = number(by_part.select(F.struct("benchmark", "group_id").alias("key")).distinct(), "key").select("key.*", "no")
    sizes = groups.groupBy("benchmark").agg(F.min("no").alias("first"), F.count("*").alias("size")).collect()  # a row a benchmark
    spark = rows.sparkSession
    spin = spark.createDataFrame([], "benchmark string, draw bigint, no bigint")
    for benchmark, first, size in sizes:
        place = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col("id"))), 1, 12), 16, 10).cast("bigint"), F.lit(size))
        spin = spin.unionByName(spark.range(draws * size).select(F.lit(benchmark).alias("benchmark"), F.floor(F.col("id") / size).cast("bigint").alias("draw"), (F.lit(first) + place).alias("no")))
    weights = spin.groupBy("benchmark", "draw", "no").agg(F.count("*").alias("w")).join(groups.select("no", "group_id"), "no")
    sums = by_part.withColumnRenamed("benchmark", "b").withColumnRenamed("group_id", "g")
    drawn = weights.join(sums, (F.col("benchmark") == F.col("b")) & F.col("group_id").eqNullSafe(F.col("g"))).groupBy("benchmark", "draw", "part").agg(*[F.sum(F.col("w") * F.col(k)).alias(k) for k in names])
    mean = lambda m, p="": F.coalesce(F.try_divide(F.col(f"{p}{m}_right"), F.col(f"{p}{m}_n")), F.lit(0.0))
    total = drawn.withColumn("delta", mean("hybrid") - mean("baseline")).groupBy("benchmark", "draw").agg(F.coalesce(F.min_by("delta", "part"), F.lit(0.0)).alias("primary_accuracy_delta"), *[F.sum(k).cast("double").alias(k) for k in names])
    less = lambda k: reduction(F.col(f"hybrid_{k}"), F.col(f"baseline_{k}"))
    metrics = {"primary_accuracy_delta": F.col("primary_accuracy_delta"), "full_model_call_reduction": less("calls"), "total_token_reduction": less("tokens"), "latency_reduction": less("ms"), "accepted_step_accuracy_delta": mean("hybrid", "local_") - mean("baseline", "local_")}
    each = total.select("benchmark", "draw", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics.items()])).alias("e")).select("benchmark", "draw", "e.*")
    ranked = each.withColumn("at", F.row_number().over(Window.partitionBy("benchmark", "metric").orderBy("value", "draw")) - 1)  # as many rows as draws
    bound = lambda q: F.round(F.max(F.when(F.col("at") == round((draws - 1) * q), F.col("value"))), 6)
    return ranked.groupBy("benchmark", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), bound(0.025).alias("lower"), bound(0.975).alias("upper"), bound(0.05).alias("lower_one_sided_95"))
