"""Queries of the problems for training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.cluster import cut, table
from stepweave.functions.text import PARTITIONS, canonical
from stepweave.llm import leakage, overlap, packing, pairs, quantiles, sampling, sentences, truncation


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return pairs.broken_pairs(*(table(spark, root, t) for t in ("training_examples", "step_results", "eval_examples", "fallback_configs")))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return overlap.found(table(spark, root, "episodes"))


def p3_report(spark: SparkSession, root: str) -> DataFrame:
    return overlap.report(table(spark, root, "episodes"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return truncation.truncated_outputs(table(spark, root, "step_results"), table(spark, root, "fallback_configs")).where("cut is not null").select("result_id")


def p4_rates(spark: SparkSession, root: str) -> DataFrame:
    return truncation.rates(truncation.truncated_outputs(table(spark, root, "step_results"), table(spark, root, "fallback_configs")))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    _, report = sampling.sample(table(spark, root, "eval_examples"), table(spark, root, "sample_targets"))
    return report.where("exhausted").select("partition_name", "instruction_mode")


def p2_report(spark: SparkSession, root: str) -> DataFrame:
    return sampling.sample(table(spark, root, "eval_examples"), table(spark, root, "sample_targets"))[1]


def p2_sample(spark: SparkSession, root: str) -> DataFrame:
    return sampling.sample(table(spark, root, "eval_examples"), table(spark, root, "sample_targets"))[0]


P5_KEYS = ["partition_name", "method", "day", "metric"]


def _measured(spark: SparkSession, root: str) -> DataFrame:
    return quantiles.measurements(*(table(spark, root, t) for t in ("step_timings", "step_results", "eval_examples")), canonical(F.col("partition_name"), PARTITIONS))


def p5_percentiles(spark: SparkSession, root: str) -> DataFrame:
    return quantiles.percentiles(quantiles.summaries(_measured(spark, root), P5_KEYS, "value"), P5_KEYS)


def p5_states(spark: SparkSession, root: str) -> DataFrame:
    """The states themselves, by day: what is kept to be combined with other days and files later."""
    return quantiles.summaries(_measured(spark, root), P5_KEYS, "value")


def p5_combined(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles over all days, from the states of the days, each held against the ranks in all rows."""
    keys = ["partition_name", "method", "metric"]
    rows = _measured(spark, root)
    states = cut(quantiles.summaries(rows, P5_KEYS, "value"))
    return quantiles.checked(rows, quantiles.percentiles(quantiles.merged(states, keys), keys), keys)


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"))


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, root, "documents")))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaks(table(spark, root, "documents"), table(spark, root, "test_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaked_items(table(spark, root, "documents"), table(spark, root, "test_items"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return sentences.sentence_units(table(spark, root, "documents"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_report": p2_report, "p2_sample": p2_sample, "p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p4_rates": p4_rates, "p5_percentiles": p5_percentiles, "p5_states": p5_states, "p5_combined": p5_combined, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_found": p8_found, "p8_items": p8_items, "p9_found": p9_found}
_NAMED = """named as (
            select observation_id, regexp_replace(regexp_replace(lower(trim(partition_name)), '[ _-]+', '_', 'g'), '^idd$', 'in_distribution') as p,
                regexp_replace(regexp_replace(regexp_replace(lower(trim(instruction_mode)), '[ _-]+', '_', 'g'), '^hl$', 'high_level'), '^ll$', 'low_level') as m
            from eval_examples where observation_id is not null),
        each as (select observation_id, min(p) as p, min(m) as m from named group by 1),
        size as (select floor(count(*) / 2)::bigint as half from each),
        cells as (select p, m, count(*) as n from each group by 1, 2)"""
# the quota of a category is level * share between its minimum and what is there; the level at which quotas add up lies after the last of the levels at which one of them
# meets a bound and they don't yet; whole numbers are made by the largest remainders
_QUOTAS = f"""{_NAMED},
        t as (select t.partition_name, t.instruction_mode, target_share as share, min_count as least, half, coalesce(c.n, 0) as there, least(coalesce(c.n, 0), min_count) as lo, row_number() over (order by t.partition_name, t.instruction_mode) as place
            from sample_targets t, size left join cells c on c.p = t.partition_name and c.m = t.instruction_mode),
        bends as (select distinct level from (select lo / share as level from t where share > 0 union all select there / share from t where share > 0 union all select 0.0)),
        sums as (select level, sum(least(there, greatest(lo, level * share))) as total, coalesce(sum(share) filter (where level * share >= lo and level * share < there), 0) as rising from bends, t group by level),
        level as (select max_by(level + case when rising > 0 then greatest(0, half - total) / rising else 0 end, level) as level from sums, size where total <= half or level = 0),
        want as (select t.*, least(there, greatest(lo, level * share)) as w, level * share > lo and level * share < there as free from t, level),
        whole as (select *, case when free then floor(w + 1e-9) else round(w) end as q from want),
        quota as (select *, q + case when free and row_number() over (partition by free order by q - w, partition_name, instruction_mode) <= half - sum(q) over () then 1 else 0 end as quota from whole)"""
SQL: dict[str, str] = {
    "p2_found": f"""
        with {_NAMED}
        select t.partition_name, t.instruction_mode from sample_targets t cross join size left join cells c on c.p = t.partition_name and c.m = t.instruction_mode
        where coalesce(c.n, 0) < greatest(t.min_count, t.target_share * half)""",
    "p2_report": f"""
        with {_QUOTAS}
        select partition_name, instruction_mode, share as target_share, least as min_count, half as sample_size, there as available, greatest(cast(least as double), share * half) as wanted, quota::bigint as quota, sum(lo) over () > half as minimums_exceed,
            quota::bigint as taken, there < greatest(least, share * half) as exhausted from quota""",
    "p2_sample": f"""
        with {_QUOTAS},
        ranked as (select observation_id, p, m, row_number() over (partition by p, m order by ('0x' || substr(md5('7:' || observation_id), 1, 13))::bigint, observation_id) as k from each)
        select r.observation_id, q.partition_name, q.instruction_mode from ranked r join quota q on q.partition_name = r.p and q.instruction_mode = r.m where r.k <= q.quota""",
    "p5_combined": """
        with named as (
            select example_id, regexp_replace(regexp_replace(lower(trim(partition_name)), '[ _-]+', '_', 'g'), '^idd$', 'in_distribution') as partition_name from eval_examples),
        res as (select r.*, n.partition_name from step_results r left join named n using (example_id)),
        rows as (
            select partition_name, method, 'latency_ms' as metric, latency_ms as value from res
            union all
            select r.partition_name, r.method, 'model_generate_ms', t.model_generate_ms from step_timings t left join res r using (result_id))
        select partition_name, method, metric, count(*) as n, true as bounded, true as p50_inside, true as p90_inside, true as p99_inside
        from rows where cast(value as varchar) not in ('nan', 'inf', '-inf') and value >= 0 group by 1, 2, 3""",
    "p5_percentiles": """
        with named as (
            select example_id, regexp_replace(regexp_replace(lower(trim(partition_name)), '[ _-]+', '_', 'g'), '^idd$', 'in_distribution') as partition_name from eval_examples),
        res as (select r.*, n.partition_name from step_results r left join named n using (example_id)),
        rows as (
            select partition_name, method, cast(cast(finished_at as date) as varchar) as day, 'latency_ms' as metric, latency_ms as value from res
            union all
            select r.partition_name, r.method, cast(cast(t.started_at as date) as varchar), 'model_generate_ms', t.model_generate_ms from step_timings t left join res r using (result_id)),
        ranked as (
            select *, row_number() over w as k, count(*) over (partition by partition_name, method, day, metric) as n
            from rows where cast(value as varchar) not in ('nan', 'inf', '-inf') and value >= 0
            window w as (partition by partition_name, method, day, metric order by value))
        select partition_name, method, day, metric, n, max(value) filter (k = greatest(1, ceil(0.5 * n - 1e-9))) as p50, max(value) filter (k = greatest(1, ceil(0.9 * n - 1e-9))) as p90,
            max(value) filter (k = greatest(1, ceil(0.99 * n - 1e-9))) as p99, cast(0 as double) as rank_error
        from ranked group by partition_name, method, day, metric, n""",
}
