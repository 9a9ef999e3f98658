"""Samples whose category shares follow targets.

Each distinct example gets a uniform priority, a seeded hash of its id. The reservoir of a
category is the set of its examples in the order of their priorities: two reservoirs merge
by taking the smallest of both, so partitions need not be seen in order or together. One
pass fills the reservoirs, a table in the shared folder; as a quota may be half of all rows,
none is gathered anywhere. What is known of a reservoir is its outline, the number of
examples per priority bucket, at most BUCKETS rows per category. From the final counts come
feasible quotas, to which the reservoirs are trimmed: every example below the bucket in
which the quota is reached, of that bucket those below the sub-bucket in which what is left
is reached, and the smallest of that one, about one in BUCKETS * BUCKETS of the category,
ranked exactly. The trim is uniform, as priorities are.

Quotas: a category's target is its share of the sample size, its minimum min_count; where a
category has fewer examples, all are taken, and what is missing is spread over the others in
proportion to their shares. Such categories are reported from what the trimmed reservoirs
hold, and so are minimums that exceed the sample size together, which are kept.

Defined results: labels are made canonical (case, spaces, signs, aliases); a null or unknown
label belongs to no category; an example delivered more than once counts once, by its
smallest labels; null ids are no examples; shares of null count as 0; of targets given twice
the larger share and minimum hold.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.cluster import cut
from stepweave.functions.text import MODES, PARTITIONS, canonical

#: Priority buckets of a category's outline, and sub-buckets of a bucket: powers of two, of 52 bits in all.
BUCKETS = 4096

CELL = ["partition_name", "instruction_mode"]


def distinct_examples(examples: DataFrame, seed: int = 7) -> DataFrame:
    """One row per observation_id: canonical labels, priority, its bucket and sub-bucket. Aggregated before the shuffle."""
    labelled = examples.where("observation_id is not null").select("observation_id", canonical(F.col("partition_name"), PARTITIONS).alias("partition_name"), canonical(F.col("instruction_mode"), MODES).alias("instruction_mode"))
    each = labelled.groupBy("observation_id").agg(F.min("partition_name").alias("partition_name"), F.min("instruction_mode").alias("instruction_mode"))
    # 52 bits of a hash that any system has
    priority = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "observation_id")), 1, 13), 16, 10).cast("bigint")
    bits = BUCKETS.bit_length() - 1
    placed = each.withColumn("priority", priority)
    return placed.withColumn("bucket", F.shiftright("priority", 52 - bits).cast("int")).withColumn("sub", F.shiftright("priority", 52 - 2 * bits).bitwiseAND(BUCKETS - 1).cast("int"))


def outline(examples: DataFrame) -> DataFrame:
    """Examples per category and bucket: the mergeable state (merge: add up)."""
    return examples.groupBy("partition_name", "instruction_mode", "bucket").agg(F.count("*").alias("n"))


def feasible(targets: dict[tuple, tuple[float, int]], there: dict[tuple, int], size: int) -> dict[tuple, int]:
    """Quota per category: size in all where the examples allow it."""
    quota = {c: min(there.get(c, 0), least) for c, (_, least) in targets.items()}
    free = {c for c in targets if quota[c] < there.get(c, 0)}
    while free and sum(quota.values()) < size:
        # the level at which shares, floors and what is there add up to size
        fixed = sum(quota[c] for c in targets if c not in free)
        shares = sum(targets[c][0] for c in free)
        if shares <= 0:
            break
        wanted = {c: (size - fixed) * targets[c][0] / shares for c in free}
        short = {c for c in free if wanted[c] >= there[c]}
        low = {c for c in free if wanted[c] <= quota[c]}
        if not short and not low:
            whole = {c: math.floor(x) for c, x in wanted.items()}
            rest = size - fixed - sum(whole.values())
            for c in sorted(free, key=lambda c: (whole[c] - wanted[c], c))[:rest]:
                whole[c] += 1
            return quota | whole
        over = sum(wanted[c] - there[c] for c in short)
        under = sum(quota[c] - wanted[c] for c in low)
        for c in short if over >= under else low:
            quota[c] = there[c] if c in short else quota[c]
            free.discard(c)
    return quota


def reached(counts: dict[int, int], quota: int) -> tuple[int, int]:
    """(bucket in which the quota is reached, how many to take of it); (-1, 0) without a bucket."""
    left = quota
    for bucket in sorted(counts):
        if left <= counts[bucket]:
            return bucket, left
        left -= counts[bucket]
    return -1, 0


def plan(spark, states: DataFrame, targets: DataFrame, size: int | None = None) -> DataFrame:
    """Per target category: what is there, wanted, its quota, the bucket in which the quota is reached and how many to take of it; whether the minimums exceed the size."""
    rows = targets.groupBy(*CELL).agg(F.max("target_share").alias("share"), F.max("min_count").alias("least")).collect()
    want = {(r.partition_name, r.instruction_mode): (max(0.0, r.share or 0.0), max(0, r.least or 0)) for r in rows}
    # at most BUCKETS counts for each of the few canonical categories
    counts: dict[tuple, dict[int, int]] = {}
    total = 0
    for r in states.collect():
        counts.setdefault((r.partition_name, r.instruction_mode), {})[r.bucket] = r.n
        total += r.n
    size = total // 2 if size is None else size
    there = {c: sum(b.values()) for c, b in counts.items()}
    quotas = feasible(want, there, size)
    over = sum(min(there.get(c, 0), least) for c, (_, least) in want.items()) > size
    out = []
    for c, (share, least) in sorted(want.items(), key=str):
        at, of_at = reached(counts.get(c, {}), quotas[c])
        out.append((*c, share, least, size, there.get(c, 0), max(float(least), share * size), quotas[c], over, at, of_at))
    return spark.createDataFrame(out, "partition_name string, instruction_mode string, target_share double, min_count int, sample_size bigint, available bigint, wanted double, quota bigint, minimums_exceed boolean, cut int, of_cut bigint")


def trimmed(reservoirs: DataFrame, quotas: DataFrame) -> DataFrame:
    """The examples of the reservoirs that the plan takes: observation_id and its category."""
    spark = reservoirs.sparkSession
    # one row per category, at most as many as canonical labels
    marked = reservoirs.join(F.broadcast(quotas.where("quota > 0").select(*CELL, "cut", "of_cut")), CELL)
    below = marked.where("bucket < cut").select("observation_id", *CELL)
    at = marked.where("bucket = cut")
    subs: dict[tuple, dict[int, int]] = {}
    for r in at.groupBy(*CELL, "of_cut", "sub").agg(F.count("*").alias("n")).collect():  # at most BUCKETS a category
        subs.setdefault((r.partition_name, r.instruction_mode, r.of_cut), {})[r.sub] = r.n
    finer = spark.createDataFrame([(*c, *reached(counts, c[2])) for c, counts in subs.items()], "partition_name string, instruction_mode string, of_cut bigint, sub_cut int, of_sub bigint").drop("of_cut")
    of_bucket = at.join(F.broadcast(finer), CELL)
    of_below = of_bucket.where("sub < sub_cut").select("observation_id", *CELL)
    rank = F.row_number().over(Window.partitionBy(*CELL).orderBy("priority", "observation_id"))
    last = of_bucket.where("sub = sub_cut").withColumn("rank", rank).where("rank <= of_sub").select("observation_id", *CELL)
    return below.unionByName(of_below).unionByName(last)


def sample(examples: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(the sampled examples, the report by category: the plan, what was taken, and whether the category was exhausted by it)."""
    reservoirs = cut(distinct_examples(examples, seed))
    quotas = plan(examples.sparkSession, outline(reservoirs), targets)
    taken = trimmed(reservoirs, quotas)
    report = quotas.drop("cut", "of_cut").join(taken.groupBy(*CELL).agg(F.count("*").alias("taken")), CELL, "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint")))
    return taken, report.withColumn("exhausted", (F.col("taken") == F.col("available")) & (F.col("available") < F.col("wanted")))
