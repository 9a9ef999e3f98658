import random

import numpy as np
import pytest

from stepweave.llm.quantiles import answers, checked, compress, merge, merged, partial_states, percentiles, summaries, summarize
from stepweave.llm.sampling import distinct_examples, feasible, outline, plan, sample

TARGETS = [("in_distribution", "high_level", 0.5, 1), ("app_unseen", "low_level", 0.3, 2), ("task_unseen", "low_level", 0.2, 3), ("task_unseen", "low_level", 0.1, 0)]


def frames(spark, rows):
    return spark.createDataFrame(rows, "observation_id string, partition_name string, instruction_mode string, bucket string, priority string"), spark.createDataFrame(TARGETS, "partition_name string, instruction_mode string, target_share double, min_count int")


def test_sample(spark):
    rows = [(f"a{i}", "IDD", " HL", "x", "x") for i in range(200)] + [(f"b{i}", "app-unseen", "LL", "x", "x") for i in range(90)] + [(f"c{i}", "Task Unseen", "low_level", "x", "x") for i in range(4)]
    rows += [("a1", "IDD", "HL", "x", "x")] * 50 + [("n1", None, "HL", "x", "x"), ("n2", "odd", None, "x", "x"), (None, "IDD", "HL", "x", "x")]
    examples, targets = frames(spark, rows)
    taken, report = sample(examples, targets)
    got = taken.collect()
    assert len(got) == len({r.observation_id for r in got}) == (200 + 90 + 4 + 2) // 2
    cells = {r.partition_name: r for r in report.collect()}
    assert cells["task_unseen"].exhausted and cells["task_unseen"].quota == 4 and not cells["in_distribution"].exhausted
    assert sum(r.quota for r in cells.values()) == len(got)
    for cell, r in cells.items():
        assert sum(x.partition_name == cell for x in got) == r.quota
    again = {r.observation_id for r in sample(examples.repartition(7), targets)[0].collect()}
    assert again == {r.observation_id for r in got}  # the order of rows is irrelevant


def test_uniform(spark):
    examples, targets = frames(spark, [(f"a{i}", "IDD", "HL", None, None) for i in range(4000)])
    first = [int(r.observation_id[1:]) < 2000 for r in sample(examples, targets)[0].collect()]
    assert len(first) == 2000 and 850 < sum(first) < 1150


def test_merge_of_outlines(spark):
    examples, targets = frames(spark, [(f"a{i}", "IDD", "HL", None, None) for i in range(500)])
    each = distinct_examples(examples).cache()
    parts = outline(each.where("bucket < 2000")).unionByName(outline(each.where("bucket >= 2000")))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(plan(spark, parts.groupBy("partition_name", "instruction_mode", "bucket").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n"), targets)) == key(plan(spark, outline(each), targets))


def test_empty(spark):
    examples, targets = frames(spark, [("a", "IDD", "HL", None, None)])
    taken, report = sample(examples.limit(0), targets)
    assert taken.collect() == [] and {r.quota for r in report.collect()} == {0}
    assert sample(examples, targets.limit(0))[0].collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_quotas(seed):
    rng = random.Random(seed)
    shares = [rng.random() for _ in range(6)]
    targets = {(str(i),): (s / sum(shares), rng.randrange(6)) for i, s in enumerate(shares)}
    there = {c: rng.choice([0, 1, 5, 50, 500]) for c in targets}
    size = rng.randrange(0, 400)
    quota = feasible(targets, there, size)
    least = sum(min(there[c], targets[c][1]) for c in targets)
    assert all(min(there[c], targets[c][1]) <= quota[c] <= there[c] for c in targets)
    assert sum(quota.values()) == min(max(size, least), sum(there.values()))


@pytest.mark.parametrize("seed", range(15))
def test_rank_error(seed):
    rng = np.random.default_rng(seed)
    eps = 0.02
    values = np.round(rng.lognormal(3, 2, rng.integers(1, 20_000)), seed % 3)
    parts = [compress(summarize(np.sort(p), eps / 4), eps / 4) for p in np.array_split(values, rng.integers(1, 9)) if len(p)]
    whole = parts[0]
    for p in parts[1:]:
        whole = compress(merge(whole, p), eps)
    ordered = np.sort(values)
    assert whole[0] == len(values)
    for q, (v, bound) in zip((0.5, 0.9, 0.99), answers(whole)):
        rank = max(1, int(np.ceil(q * len(values) - 1e-9)))
        low, high = np.searchsorted(ordered, v) + 1, np.searchsorted(ordered, v, side="right")
        off = max(0, low - rank, rank - high)
        assert off <= bound * len(values) + 1e-6 and bound <= eps + 1 / len(values)
    # every tuple's interval holds the value's true ranks
    low_rank = np.cumsum(whole[2])
    for v, low, d in zip(whole[1], low_rank, whole[3]):
        assert np.searchsorted(ordered, v) + 1 <= low + d and low <= np.searchsorted(ordered, v, side="right")
    if len(values) > 5000:
        assert len(whole[1]) < len(values) / 4


def test_states(spark):
    rows = [("a", float(i)) for i in range(1, 101)] + [("a", None), ("a", float("nan")), ("a", -1.0), ("b", 7.0), (None, 3.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r.n, r.p50, r.p90, r.p99, r.rank_error) for r in percentiles(summaries(df, ["k"], "v"), ["k"]).collect()}
    assert got == {"a": (100, 50.0, 90.0, 99.0, 0.0), "b": (1, 7.0, 7.0, 7.0, 0.0), None: (1, 3.0, 3.0, 3.0, 0.0)}
    days = partial_states(df.where("k = 'a' and v between 1 and 50"), ["k"], "v").unionByName(partial_states(df.where("k = 'a' and v > 50 and v < 101"), ["k"], "v"))
    assert percentiles(merged(days, ["k"]), ["k"]).first().p50 == 50.0
    assert summaries(df.limit(0), ["k"], "v").collect() == []


def test_rounds_by_the_number_of_states(spark):
    """Many more partitions than shuffle partitions: every round joins at most fan_in states, and the bound holds."""
    rng = np.random.default_rng(3)
    values = np.round(rng.lognormal(3, 2, 6000), 1).tolist()
    df = spark.createDataFrame([("a" if i % 3 else "b", v) for i, v in enumerate(values)], "k string, value double").repartition(50)
    states = summaries(df, ["k"], "value", eps=0.02, fan_in=3)
    found = {r.k: r for r in percentiles(states, ["k"]).collect()}
    for k in "ab":
        mine = sorted(v for i, v in enumerate(values) if ("a" if i % 3 else "b") == k)
        for q, x in ((0.5, found[k].p50), (0.9, found[k].p90), (0.99, found[k].p99)):
            rank = int(np.ceil(q * len(mine) - 1e-9))
            low, high = np.searchsorted(mine, x) + 1, np.searchsorted(mine, x, side="right")
            assert max(0, low - rank, rank - high) <= found[k].rank_error * len(mine) + 1e-6
        assert 0 < found[k].rank_error <= 0.02 + 1 / len(mine) and found[k].n == len(mine)
    assert all(r.p50_inside and r.p90_inside and r.p99_inside for r in checked(df, percentiles(states, ["k"]), ["k"]).collect())


def test_minimums_beyond_the_size(spark):
    examples, _ = frames(spark, [(f"a{i}", "IDD", "HL", None, None) for i in range(6)] + [(f"b{i}", "app_unseen", "LL", None, None) for i in range(4)])
    targets = spark.createDataFrame([("in_distribution", "high_level", 0.5, 4), ("app_unseen", "low_level", 0.5, 4)], "partition_name string, instruction_mode string, target_share double, min_count int")
    taken, report = sample(examples, targets)
    assert taken.count() == 8 and all(r.minimums_exceed and r.taken == 4 and not r.exhausted for r in report.collect())


def test_sub_buckets(spark):
    """More examples than buckets: the trim goes on within a bucket, down to single examples."""
    examples, targets = frames(spark, [(f"a{i}", "IDD", "HL", None, None) for i in range(20_001)])
    each = distinct_examples(examples)
    want = {r.observation_id for r in each.orderBy("priority", "observation_id").limit(10_000).collect()}
    assert {r.observation_id for r in sample(examples, targets)[0].collect()} == want
