"""ANSI SQL of the queries that SQL can express, for DuckDB over the same tables."""

_CANON = "regexp_replace(lower(trim({c})), '[\\s_-]+', '_', 'g')"
_PART = "case " + _CANON.format(c="partition_name") + " when 'idd' then 'in_distribution' when 'in_distribution' then 'in_distribution' when 'app_unseen' then 'app_unseen' when 'task_unseen' then 'task_unseen' when 'category_unseen' then 'category_unseen' end"
_MODE = "case " + _CANON.format(c="r.instruction_mode") + " when 'hl' then 'high_level' when 'high_level' then 'high_level' when 'll' then 'low_level' when 'low_level' then 'low_level' end"
_SPLIT = "case " + _CANON.format(c="split") + " when 'train' then 'train' when 'training' then 'train' when 'val' then 'validation' when 'valid' then 'validation' when 'validation' then 'validation' when 'dev' then 'validation' when 'test' then 'test' when 'testing' then 'test' end"
# NaN is told by its text: a filter by isnan() is answered from the file's statistics, which leave NaN out
_SANE = "case when cast({c} as varchar) <> 'nan' and {c} >= 0 and {c} < 1e12 then {c} end"
_JUDGED = f"""labels as (select example_id, coalesce({_PART}, 'in_distribution') as part, shot_count from eval_examples),
judged as (select r.* exclude (instruction_mode), coalesce(l.part, 'in_distribution') as part, l.shot_count, {_MODE} as mode, coalesce(primary_correct, false) as ok, {_SANE.format(c="latency_ms")} as ms from step_results r left join labels l using (example_id))"""
_BY_PART = """android as (select * from judged where benchmark = 'AndroidControl' and mode is not null),
both_ as (select part, mode, method, episode_id, ok from android union all select 'overall', mode, method, episode_id, ok from android),
eps as (select part, mode, method, episode_id, count(*) as n, sum(ok::int) as good from both_ group by all),
acc as (select part, mode, method, sum(n)::bigint as n_steps, count(*) as n_episodes, round(sum(good) / sum(n), 6) as step_accuracy, round(avg((good = n)::int), 6) as episode_accuracy from eps group by all)"""
_PHASES = "image_prep_ms, message_build_ms, total_generation_ms, output_parse_ms, total_e2e_step_ms, tokenization_ms, gpu_transfer_ms, model_generate_ms, output_decode_ms, vision_encoder_ms, attn_scoring_prune_ms, llm_forward_ms, prefill_ms, decode_ms, decode_steps"
_PHASE_ROWS = f"""long as (select {{keys}}phase, cast(v as decimal(30,4)) as ms from (unpivot ({{source}}) on {_PHASES} into name phase value v) where cast(v as varchar) <> 'nan' and v >= 0 and v < 1e12)"""
_PHASE_AGG = "count(*) as n, round(cast(sum(ms) as double), 3) as total, round(cast(sum(ms) as double) / count(*), 3) as mean, round(cast(min(ms) as double), 3) as least, round(cast(max(ms) as double), 3) as most"
_BY_METHOD = _PHASE_ROWS.format(keys="method, ", source=f"select method, {_PHASES} from step_timings join step_results using (result_id)")
_TOKENS = """select benchmark, method, count(*) as n_steps, coalesce(sum(prompt_tokens), 0)::bigint as prompt_tokens, coalesce(sum(generated_tokens), 0)::bigint as generated_tokens, coalesce(sum(full_model_calls), 0)::bigint as full_calls, coalesce(sum(local_model_calls), 0)::bigint as local_calls from step_results group by all"""
_TYPES = "{'click': 'CLICK', 'tap': 'CLICK', 'long_press': 'LONG_PRESS', 'longpress': 'LONG_PRESS', 'scroll': 'SCROLL', 'swipe': 'SCROLL', 'input_text': 'TYPE', 'type': 'TYPE', 'open_app': 'OPEN_APP', 'navigate_back': 'NAV', 'navigate_home': 'NAV', 'system_button': 'NAV', 'wait': 'WAIT', 'status': 'TERMINATE', 'terminate': 'TERMINATE'}"
_TYPE = "coalesce(map {t}[lower(trim({c}))], upper(trim({c})))"
_ACTION = f"""valid as (select *, case when json_valid(raw_action) then raw_action::json end as j0 from steps),
parsed as (select * exclude (j0), case when json_type(j0) = 'VARCHAR' then case when json_valid(j0 ->> '$') then (j0 ->> '$')::json end else j0 end as j from valid),
typed as (select * exclude (j), {_TYPE.format(t=_TYPES, c="j ->> '$.action_type'")} as action_type,
    coalesce(try_cast(j ->> '$.x' as double), try_cast(j ->> '$.arguments.coordinate[0]' as double)) as x, coalesce(try_cast(j ->> '$.y' as double), try_cast(j ->> '$.arguments.coordinate[1]' as double)) as y,
    coalesce(j ->> '$.text', j ->> '$.arguments.text', j ->> '$.direction', j ->> '$.arguments.direction', j ->> '$.app_name', j ->> '$.arguments.app_name', j ->> '$.goal_status', j ->> '$.arguments.goal_status') as argument from parsed)"""
_STEPS = "(partition by dataset, episode_id order by step_index nulls first, step_id)"
_CALL = f"""named as (select *, nullif(regexp_extract(raw_output, '(?:^|\\n)([A-Z][A-Z_]+)\\(([^()\\n]*)\\)\\s*$', 1), '') as name, regexp_extract(raw_output, '(?:^|\\n)([A-Z][A-Z_]+)\\(([^()\\n]*)\\)\\s*$', 2) as arg from step_results),
called as (select *, {_TYPE.format(t=_TYPES, c="name")} as action_type, cast(nullif(regexp_extract(arg, '^\\s*(\\d+)\\s*,\\s*(\\d+)\\s*$', 1), '') as double) as x, cast(nullif(regexp_extract(arg, '^\\s*(\\d+)\\s*,\\s*(\\d+)\\s*$', 2), '') as double) as y from named where name is not null),
calls as (select * , case when x is null then trim(arg) end as argument from called)"""
_RUNNING = f"select method, count(*) as n, sum(coalesce(primary_correct, false)::int)::bigint as n_right, count({_SANE.format(c='latency_ms')}) as n_ms, cast(sum(cast({_SANE.format(c='latency_ms')} as decimal(30,4))) as double) as total_ms from step_results group by all"
_GOALS = "goals as (select dataset, episode_id, max_by(goal, row_id) as goal from episodes where goal is not null group by all)"


# rules of canonical records, written from their statement: names by type, first value that says something, words in lower case
_NORM = "nullif(lower(trim(regexp_replace({c}, '[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))), '')"
_KIND = "case coalesce(lower({c}), '') when 'open_app' then 'NAV' when 'navigate_home' then 'NAV' when 'navigate_back' then 'NAV' when 'input_text' then 'TYPE' when 'type' then 'TYPE' when 'status' then 'TERMINATE' when 'terminate' then 'TERMINATE' else upper(coalesce({c}, '')) end"
_PARSE = "case when json_type({j}) = 'VARCHAR' then case when json_valid({j} ->> '$') then ({j} ->> '$')::json end else {j} end"
_NUM = "case when json_type(j, '$.{k}') in ('BIGINT', 'UBIGINT', 'DOUBLE') then try_cast(j ->> '$.{k}' as double) end"
_FIELDS = f"""valid as (select *, case when json_valid(raw_action) then raw_action::json end as j0 from SOURCE),
parsed as (select * exclude (j0), {_PARSE.format(j="j0")} as j from valid),
fields as (select *, j ->> '$.action_type' as a, {_NUM.format(k="x")} as x, {_NUM.format(k="y")} as y, {_NORM.format(c="j ->> '$.text'")} as txt, {_NORM.format(c="j ->> '$.direction'")} as dir, {_NORM.format(c="j ->> '$.app_name'")} as app_name,
    coalesce(case when coalesce({_NUM.format(k="seconds")}, 1) <> 0 then nullif(j ->> '$.seconds', '') end, case when coalesce({_NUM.format(k="duration")}, 1) <> 0 then nullif(j ->> '$.duration', '') end, 'wait') as secs,
    coalesce(nullif(j ->> '$.goal_status', ''), nullif(j ->> '$.status', ''), 'successful') as st from parsed)"""
_FIRST = f"""named as (select *, coalesce(lower(a), '') as kind, x is not null and y is not null as pointed from fields),
firsts as (select *, {_KIND.format(c="a")} as action_type, case when kind = 'open_app' then app_name when kind in ('input_text', 'type') then txt when kind = 'navigate_home' then 'home' when kind = 'navigate_back' then 'back' when kind = 'wait' then {_NORM.format(c="secs")} when kind in ('status', 'terminate') then {_NORM.format(c="st")} end as argument,
    case when kind in ('click', 'long_press') and pointed then trunc(x)::int - 1 end as l, case when kind in ('click', 'long_press') and pointed then trunc(y)::int + 1 end as b, case when kind = 'open_app' then app_name end as app, case when kind = 'scroll' then dir end as direction from named)"""
_WORDS = "list_distinct(coalesce(regexp_extract_all(lower({c}), '([a-z0-9]+)', 1), []))"


_ROOTS = f"roots as (select step_id, step_index, {_PARSE.format(j='j0')} as j from (select step_id, step_index, case when json_valid(raw_action) then raw_action::json end as j0 from steps))"
_PATHS = f"""with {_ROOTS}, k as (select r.step_id as record_id, regexp_replace(regexp_replace(t.fullkey, '\\[\\d+\\]', '[]', 'g'), '^\\$\\.?', '') as path, t.type, t.key from roots r, json_tree(r.j) t where r.j is not null)
        select distinct record_id, path, case type when 'OBJECT' then 'dict' when 'ARRAY' then 'list' when 'VARCHAR' then 'str' when 'BOOLEAN' then 'bool' when 'NULL' then 'NoneType' when 'DOUBLE' then 'float' else 'int' end as kind from k where path <> '' and not ends_with(path, '[]')"""
# objects with an action_type that lie below others through `actions` alone, numbered as they begin
_OBJECTS = f"""{_ROOTS}, found as (select r.step_id as record_id, r.step_index, t.fullkey as at, t.id, t.value as v from roots r, json_tree(r.j) t where r.j is not null and t.type = 'OBJECT' and regexp_full_match(t.fullkey, '\\$(\\[\\d+\\])?(\\.actions(\\[\\d+\\])?)*') and json_exists(t.value, '$.action_type')),
        nodes as (select *, (row_number() over (partition by record_id order by id) - 1)::int as node_no from found)"""


def _quantiles() -> str:
    parts = [f"select part, method, n, '{name}' as quantile, ms from ranked where k = cast(round_even((n - 1) * {q}, 0) as bigint)" for name, q in (("q025", 0.025), ("q500", 0.5), ("q975", 0.975))]
    return f"with {_JUDGED}, ranked as (select part, method, ms, count(*) over (partition by part, method) as n, row_number() over (partition by part, method order by ms) - 1 as k from judged where ms is not null) " + " union all ".join(parts)


SQL: dict[str, str] = {
    "accuracy_by_partition": f"with {_JUDGED}, {_BY_PART} select * from acc",
    "accuracy_delta": f"""with {_JUDGED}, {_BY_PART} select part, mode, b.step_accuracy as baseline, h.step_accuracy as hybrid, round(h.step_accuracy - b.step_accuracy, 6) as delta, round((h.step_accuracy - b.step_accuracy) / nullif(b.step_accuracy, 0), 6) as relative
        from (select * from acc where method = 'baseline') b full join (select * from acc where method = 'hybrid') h using (part, mode)""",
    "mode_metrics": f"""with {_JUDGED}, eps as (select mode, method, benchmark, episode_id, count(*) as n, sum(ok::int) as good, sum(coalesce(prompt_tokens, 0)) as i, sum(coalesce(generated_tokens, 0)) as o, sum(cast(coalesce(ms, 0) as decimal(30,4))) as ms from judged where mode is not null group by all)
        select mode, method, sum(n)::bigint as n_steps, round(sum(good) / sum(n), 6) as step_accuracy, round(sum(i) / count(*), 4) as input_tokens_per_episode, round(sum(o) / count(*), 4) as output_tokens_per_episode, round(cast(sum(ms) as double) / sum(n) / 1000, 4) as step_seconds, round(cast(sum(ms) as double) / count(*) / 1000, 4) as episode_seconds from eps group by all""",
    "shot_metrics": f"""with {_JUDGED}, {_CALL}, k as (select j.*, c.action_type as kind from judged j left join calls c using (result_id) where j.benchmark = 'LearnGUI' and shot_count is not null),
        truth as (select example_id, arg_min(kind, result_id) as true_kind from k where method = 'baseline' and ok and kind is not null group by 1),
        t as (select k.*, (ok or coalesce(kind = true_kind, false))::int as type_ok from k left join truth using (example_id)),
        g as (select shot_count, coalesce(avg(type_ok) filter (where method = 'baseline'), 0) as bt, coalesce(avg(ok::int) filter (where method = 'baseline'), 0) as bm, coalesce(avg(type_ok) filter (where method = 'hybrid'), 0) as ht, coalesce(avg(ok::int) filter (where method = 'hybrid'), 0) as hm from t group by 1),
        r as (select shot_count, round(bt, 6) as baseline_type, round(bm, 6) as baseline_match, round(ht, 6) as hybrid_type, round(hm, 6) as hybrid_match from g)
        select *, round(hybrid_type - baseline_type, 6) as delta_type, round(hybrid_match - baseline_match, 6) as delta_match from r""",
    "phase_summary": f"with {_BY_METHOD} select method, phase, {_PHASE_AGG} from long group by all",
    "phase_merge": f"with {_PHASE_ROWS.format(keys='', source=f'select {_PHASES} from step_timings')} select phase, {_PHASE_AGG} from long group by all",
    "phase_comparison": f"""with {_BY_METHOD}, s as (select method, phase, {_PHASE_AGG} from long group by all), p as (select unnest(range(15))::int as place, unnest(string_split('{_PHASES}', ', ')) as phase)
        select place, phase, b.mean as baseline_mean, h.mean as hybrid_mean, round(b.mean / nullif(h.mean, 0), 3) as speed_up from p left join (select * from s where method = 'baseline') b using (phase) left join (select * from s where method = 'hybrid') h using (phase)""",
    "token_totals": f"select *, round((prompt_tokens + generated_tokens) / greatest(1, n_steps), 4) as tokens_per_step from ({_TOKENS})",
    "call_reduction": f"""with t as ({_TOKENS}) select b.benchmark, round(case when b.full_calls > 0 then 1 - h.full_calls / b.full_calls else 0.0 end, 6) as call_reduction,
        round(case when b.prompt_tokens + b.generated_tokens > 0 then 1 - (h.prompt_tokens + h.generated_tokens) / (b.prompt_tokens + b.generated_tokens) else 0.0 end, 6) as token_reduction
        from t b join t h on b.benchmark = h.benchmark and b.method = 'baseline' and h.method = 'hybrid'""",
    "latency_quantiles": _quantiles(),
    "upper_median": f"""with v as (select worker_id, {_SANE.format(c="prefill_ms")} as ms from step_timings), k as (select worker_id, ms, count(*) over (partition by worker_id) as n, row_number() over (partition by worker_id order by ms) - 1 as k from v where ms is not null)
        select worker_id, n, ms as median from k where k = n // 2""",
    "decode_bands": f"with v as (select worker_id, {_SANE.format(c='decode_ms')} as ms from step_timings) select worker_id, count(*) as n, round(avg((ms <= 20)::int), 6) as within_20, round(avg((ms <= 50)::int), 6) as within_50 from v where ms is not null group by all",
    "group_spread": "select group_id, count(*) as n, round(avg(prompt_tokens), 4) as mean, round(coalesce(stddev_samp(prompt_tokens), 0), 3) as deviation from step_results where prompt_tokens is not null group by all",
    "task_export": f"""with {_JUDGED} select benchmark, episode_id, mode, method, count(*) as n_steps, bool_and(ok) as all_correct, round(avg(ok::int), 6) as accuracy, string_agg(step_index || ':' || result_id, ',' order by step_index nulls first, result_id) as steps from judged group by benchmark, episode_id, mode, method""",
    "micro_macro": f"""with {_JUDGED}, t as (select benchmark, episode_id, mode, method, count(*) as n, sum(ok::int) as good from judged group by all), g as (select method, round(sum(good) / sum(n), 6) as micro, round(avg(good / n), 6) as macro from t group by all)
        select *, abs(micro - macro) > 0.002 as differs from g""",
    "error_audit": """with h as (select * from step_results where method = 'hybrid' qualify row_number() over (partition by example_id order by result_id) = 1), b as (select * from step_results where method = 'baseline' qualify row_number() over (partition by example_id order by result_id) = 1),
        w as (select example_id, episode_id, step_index, result_id from h where full_model_calls = 0 and not coalesce(primary_correct, false)), f as (select * from w order by example_id limit 50)
        select f.*, coalesce(b.primary_correct, false) as baseline_correct, (select count(*) from w) as n_all from f left join b using (example_id)""",
    "instruction_index": f"""with c as (select *, (step_instruction is distinct from lag(step_instruction) over {_STEPS})::int as changed from steps)
        select step_id, (sum(changed) over (partition by dataset, episode_id order by step_index nulls first, step_id rows unbounded preceding))::bigint - 1 as high_level_index from c""",
    "action_history": f"with {_ACTION} select step_id, coalesce(string_agg(coalesce(action_type, 'unknown'), '>') over (partition by dataset, episode_id order by step_index nulls first, step_id rows between unbounded preceding and 1 preceding), '') as history from typed",
    "next_features": f"""select step_id, lead(screenshot.path) over {_STEPS} as next_path, screenshot.path is distinct from lead(screenshot.path) over {_STEPS} as screen_changes, step_instruction is distinct from lead(step_instruction) over {_STEPS} as instruction_changes, lead(1) over {_STEPS} is null as terminal from steps""",
    "typed_into": f"with {_ACTION}, w as (select step_id, action_type, lag(action_type) over {_STEPS} as before, lag(x) over {_STEPS} as x, lag(y) over {_STEPS} as y from typed) select step_id, x, y from w where action_type = 'TYPE' and before = 'CLICK'",
    "accepted_prefix": """with k as (select benchmark, episode_id, method, coalesce(primary_correct, false) as ok, row_number() over (partition by benchmark, episode_id, method order by step_index nulls first, result_id) - 1 as place from step_results)
        select benchmark, episode_id, method, coalesce(min(place) filter (where not ok), count(*))::bigint as accepted from k group by all""",
    "canonical_actions": f"with {_ACTION} select step_id, action_type, x, y, argument from typed",
    "action_mix": f"with {_ACTION} select action_type, count(*) as n from typed group by all",
    "output_calls": f"with {_CALL} select result_id, action_type, x, y, argument from calls",
    "method_agreement": f"""with {_CALL}, f as (select * from calls qualify row_number() over (partition by example_id, method order by result_id) = 1)
        select b.action_type, count(*) as n, sum((b.action_type = h.action_type and case when b.action_type in ('CLICK', 'LONG_PRESS') then coalesce(sqrt(pow(b.x - h.x, 2) + pow(b.y - h.y, 2)) <= 140, false) when b.action_type = 'WAIT' then true else lower(b.argument) is not distinct from lower(h.argument) end)::int)::bigint as n_match
        from f b join f h on b.example_id = h.example_id and b.method = 'baseline' and h.method = 'hybrid' group by all""",
    "click_scales": f"""with {_ACTION}, s as (select step_id, x, y, screenshot.width as w, screenshot.height as h from typed where x is not null and screenshot.width > 0 and screenshot.height > 0), t as (select *, round_even(x * 999 / w, 0)::bigint as x_999, round_even(y * 999 / h, 0)::bigint as y_raw from s)
        select step_id, x_999, least(999, greatest(0, y_raw))::bigint as y_999, round_even(least(w - 1, greatest(0.0, x_999 * (w - 1) / 999)), 0)::bigint as x_back, (ceil(w / 28) * ceil(h / 28))::bigint as visual_tokens from t""",
    "goal_text": f"select row_id, nullif(lower(trim(regexp_replace(goal, '[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))), '') as goal, translate(lower(trim(coalesce(app, ''))), '- ', '__') as app, {_SPLIT} as split from episodes",
    "instruction_overlap": f"""with {_GOALS}, s as (select step_id, list_distinct(coalesce(regexp_extract_all(lower(step_instruction), '([a-z0-9]+)', 1), [])) as a, list_distinct(coalesce(regexp_extract_all(lower(goal), '([a-z0-9]+)', 1), [])) as b from steps left join goals using (dataset, episode_id) where exists (select 1 from episodes e where e.dataset = steps.dataset and e.episode_id = steps.episode_id))
        select step_id, round(case when len(a) = 0 and len(b) = 0 then 1.0 when len(a) = 0 or len(b) = 0 then 0.0 else 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) end, 6) as f1 from s""",
    "split_lookup": f"""with e as (select dataset, episode_id, max_by(coalesce({_SPLIT}, 'none'), row_id) as split from episodes group by all)
        select coalesce(e.split, 'missing') as split, count(*) as n_steps, count(distinct (s.dataset, s.episode_id)) as n_episodes from steps s left join e using (dataset, episode_id) group by 1""",
    "missing_episodes": "select distinct episode_id from episodes where dataset = 'AndroidControl' and episode_id not in (select unnest(episode_id)::varchar from android_records)",
    "group_sources": "select group_id, string_agg(source, ',' order by source) as sources from (select distinct group_id, source from step_results where source is not null) group by all",
    "call_reconciliation": """with w as (select result_id, coalesce(full_model_calls, 0) + coalesce(local_model_calls, 0) as calls from step_results), h as (select result_id, count(*) as timed from step_timings group by all)
        select case when calls is null then 'unexpected' when timed is null then case when calls > 0 then 'missing' else 'verified' end when calls = timed then 'verified' else 'mismatched' end as kind, count(*) as n from w full join h using (result_id) group by 1""",
    "prompts": f"""with {_ACTION}, {_GOALS}, known as (select distinct dataset, episode_id from episodes), d as (select *, string_agg(coalesce(lower(action_type), 'unknown'), ', ') over (partition by dataset, episode_id order by step_index nulls first, step_id rows between unbounded preceding and 1 preceding) as done from typed)
        select step_id, concat_ws(chr(10), 'Goal: ' || goal, 'Step: ' || step_instruction, 'Done: ' || done) as prompt from d join known using (dataset, episode_id) left join goals using (dataset, episode_id)""",
    "chat_lines": "select example_id, cast(to_json({'messages': [{'role': 'user', 'content': prompt_text}, {'role': 'assistant', 'content': response_text}]}) as varchar) as line from training_examples where prompt_text is not null and response_text is not null",
    "accuracy_interval": """with g as (select group_id, count(*) as n, sum(coalesce(primary_correct, false)::int) as good from step_results where group_id is not null group by all), k as (select *, row_number() over (order by group_id) - 1 as no, count(*) over () as size from g),
        spin as (select id // size as draw, ('0x' || substr(md5('0-' || id), 1, 12))::bigint % size as no from (select max(size) as size from k), lateral (select unnest(range(1000 * size)) as id)),
        a as (select draw, sum(good) / sum(n) as accuracy from spin join k using (no) group by all), o as (select *, row_number() over (order by accuracy, draw) - 1 as place from a)
        select round(avg(accuracy), 6) as mean, round(max(accuracy) filter (where place = 25), 6) as low, round(max(accuracy) filter (where place = 974), 6) as high from o""",
    "running_metrics": _RUNNING,
    "stream_metrics": _RUNNING,
    "pending_results": "select example_id from eval_examples e where not exists (select 1 from step_results r where r.example_id = e.example_id)",
    "tool_calls": f"""with b as (select result_id, nullif(regexp_extract(raw_output, '(?is)<tool_call>\\s*(.*?)\\s*</tool_call>', 1), '') as body from step_results), j as (select result_id, case when json_valid(body) then body::json end as j from b)
        select result_id, {_TYPE.format(t=_TYPES, c="j ->> '$.arguments.action'")} as action_type, try_cast(j ->> '$.arguments.coordinate[0]' as double) as x, try_cast(j ->> '$.arguments.coordinate[1]' as double) as y,
        coalesce(j ->> '$.arguments.text', j ->> '$.arguments.direction', j ->> '$.arguments.app_name', j ->> '$.arguments.goal_status') as argument from j where j ->> '$.arguments.action' is not null""",
    "runtime_views": f"with {_ACTION} select step_id, mode, case when mode = 'low_level' then step_instruction end as instruction, case when mode = 'low_level' then action_type else 'UNOBSERVED' end as action_type from typed cross join (values ('high_level'), ('low_level')) m(mode)",
    "accuracy_pivot": f"with {_JUDGED} select part, round(avg(ok::int) filter (where mode = 'high_level'), 6) as high_level, round(avg(ok::int) filter (where mode = 'low_level'), 6) as low_level from judged group by all",
    "best_configs": """with c as (select method, config_id, round(avg(coalesce(primary_correct, false)::int), 6) as accuracy, round(avg(generated_tokens), 4) as tokens from step_results where config_id is not null group by all)
        select method, config_id, accuracy, tokens from c qualify row_number() over (partition by method order by accuracy desc, config_id) = 1""",
    "phase_coverage": f"""with v as (select worker_id, {_SANE.format(c="total_e2e_step_ms")} as total, {" + ".join(f"coalesce({_SANE.format(c=c)}, 0.0)" for c in ("image_prep_ms", "message_build_ms", "total_generation_ms", "output_parse_ms"))} as parts from step_timings)
        select worker_id, count(*) as n, round(avg((abs(parts - total) / total < 0.3)::int), 6) as covered from v where total > 0 group by all""",
    "prompt_cost": "select example_id, greatest(1, length(prompt_text) // 4)::bigint as text_tokens, (ceil(screenshot.width / 28) * ceil(screenshot.height / 28))::bigint as visual_tokens from training_examples",
    "shard_sizes": "select ('0x' || substr(md5(group_id), 1, 8))::bigint % 16 as shard, count(*) as n, count(distinct group_id) as n_groups from step_results where group_id is not null group by all",
    "latency_text": f"""with m as (select method, cast(sum(cast({_SANE.format(c="latency_ms")} as decimal(30,4))) as double) / 1000 as s, round(avg(coalesce(full_model_calls = 0, false)::int), 6) as saved from step_results group by all), t as (select method, round_even(s, 0)::bigint as s, saved from m)
        select method, case when s >= 3600 then printf('%dh%02dm%02ds', s // 3600, s % 3600 // 60, s % 60) when s >= 60 then printf('%dm%02ds', s // 60, s % 60) else printf('%ds', s) end as total, printf('%.2f%%', saved * 100) as saved from t""",
    "record_steps": f"""with r as (select record_id, episode_id[1] as episode_id, decode(goal[1]) as goal, actions, step_instructions as si, screenshot_widths as w, screenshot_heights as h,
            greatest(coalesce(len(step_instructions), 0), coalesce(len(screenshot_widths), 0), coalesce(len(screenshot_heights), 0), coalesce(len(accessibility_trees), 0), coalesce(len(screen_descriptions), 0), case when len(actions) > 0 then len(actions) + 1 else 0 end) as n from android_records),
        s as (select *, unnest(range(len(actions))) as i from r), t as (select *, decode(actions[i + 1]) as raw_action from s), {_FIELDS.replace("SOURCE", "t")}, {_FIRST}
        select record_id, i::int as step_index, episode_id, goal, decode(si[i + 1]) as instruction, w[i + 1] as width, h[i + 1] as height, decode(si[i + 2]) as next_instruction, coalesce(list_sum(list_transform(range(1, i + 1), lambda k: (si[k + 1] is distinct from si[k])::int)), 0)::bigint as high_level_index, n::int as n_screens, action_type, w[i + 2] is null as terminal from firsts""",
    "canonical_records": f"""with {_GOALS}, src as (select s.*, g.goal, lead(1) over {_STEPS} is null as terminal, step_instruction is distinct from lead(step_instruction) over {_STEPS} as instruction_changed from steps s left join goals g using (dataset, episode_id)), {_FIELDS.replace("SOURCE", "src")}, {_FIRST},
        seconds_ as (select *, coalesce(upper(a) || case when coalesce(j ->> '$.text', j ->> '$.direction', j ->> '$.app_name') is not null then '[' || coalesce(j ->> '$.text', j ->> '$.direction', j ->> '$.app_name') || ']' else '' end, '') as written from firsts where dataset = 'LearnGUI'),
        split as (select * exclude (action_type, argument, l, b, app, direction), upper(split_part(written, '[', 1)) as name, case when contains(written, '[') and ends_with(written, ']') then nullif(substr(written, instr(written, '[') + 1, length(written) - instr(written, '[') - 1), '') end as given from seconds_),
        second as (select *, case when name in ('CLICK', 'TAP') then 'CLICK' when name in ('SWIPE', 'SCROLL') then 'SCROLL' else name end as action_type,
            case when name in ('CLICK', 'TAP', 'SWIPE', 'SCROLL') then null when name = 'TYPE' then {_NORM.format(c="coalesce(nullif(j ->> '$.text', ''), given)")} else {_NORM.format(c="given")} end as argument,
            case when name not in ('SWIPE', 'SCROLL') and pointed then trunc(x)::int - 1 end as l, case when name not in ('SWIPE', 'SCROLL') and pointed then trunc(y)::int + 1 end as b, null::varchar as app, case when name in ('SWIPE', 'SCROLL') then {_NORM.format(c="given")} end as direction from split),
        both_ as (select step_id, dataset, action_type, argument, l, b, app, direction, pointed, goal, step_instruction, terminal, instruction_changed, {_NORM.format(c="j ->> '$.target_label'")} as tl from firsts where dataset = 'AndroidControl'
            union all select step_id, dataset, action_type, argument, l, b, app, direction, pointed, goal, step_instruction, terminal, instruction_changed, {_NORM.format(c="j ->> '$.target_label'")} from second),
        aimed as (select *, case when action_type in ('CLICK', 'LONG_PRESS') then case when pointed then 'action_point' end when action_type = 'TYPE' then 'input_text_action' when action_type = 'SCROLL' then 'scroll_action' when action_type = 'NAV' then 'navigation_action' when action_type = 'WAIT' then 'wait_action' end as source,
            case when action_type = 'TYPE' then coalesce(tl, argument) when action_type = 'SCROLL' then direction when action_type = 'NAV' then coalesce(argument, app) when action_type = 'WAIT' then argument end as label from both_)
        select step_id, dataset, action_type, argument, l, b, app, direction, source, terminal, instruction_changed, case when action_type in ('CLICK', 'LONG_PRESS', 'TYPE') then 'none_localized_action' else 'ground_truth_transition_proxy' end as effect_kind,
            coalesce(array_to_string(list_sort(list_intersect({_WORDS.format(c="goal")}, {_WORDS.format(c="argument")})), ' '), '') as goal_argument, coalesce(array_to_string(list_sort(list_intersect({_WORDS.format(c="step_instruction")}, {_WORDS.format(c="label")})), ' '), '') as action_screen from aimed""",
    "step_matches": f"""with src as (select * from steps qualify row_number() over (partition by dataset, episode_id, step_index order by step_id) = 1), {_FIELDS.replace("SOURCE", "src")},
        body as (select *, nullif(regexp_extract(raw_output, '(?is)<tool_call>\\s*(.*?)\\s*</tool_call>', 1), '') as t from step_results), call as (select benchmark, method, episode_id, step_index, case when json_valid(t) then t::json end as c from body),
        said as (select *, lower(c ->> '$.arguments.action') as k0, try_cast(c ->> '$.arguments.coordinate[0]' as double) as px, try_cast(c ->> '$.arguments.coordinate[1]' as double) as py, coalesce(c ->> '$.arguments.text', c ->> '$.arguments.direction', c ->> '$.arguments.app_name', c ->> '$.arguments.goal_status', c ->> '$.arguments.seconds') as v from call where c ->> '$.arguments.action' is not null),
        j as (select said.benchmark, said.method, {_NORM.format(c="a")} as tt, case k0 when 'type' then 'input_text' when 'tap' then 'click' when 'swipe' then 'scroll' when 'terminate' then 'status' else k0 end as pk, px, py, {_NORM.format(c="v")} as pv, v, x, y, txt, dir, app_name, {_NORM.format(c="f.j ->> '$.goal_status'")} as gs,
            coalesce(nullif({_NUM.format(k="seconds").replace("j,", "f.j,").replace("j ->>", "f.j ->>")}, 0), nullif({_NUM.format(k="duration").replace("j,", "f.j,").replace("j ->>", "f.j ->>")}, 0)) as sec
            from said join fields f on f.dataset = said.benchmark and f.episode_id = said.episode_id and f.step_index = said.step_index where f.j is not null)
        select benchmark, method, tt as true_type, count(*) as n, sum((tt = pk and case
            when tt in ('click', 'long_press') then coalesce(x is not null and y is not null and px between trunc(x) - 1 and trunc(x) + 1 and py between trunc(y) - 1 and trunc(y) + 1, false)
            when tt = 'input_text' then txt is not distinct from pv and coalesce(px between trunc(x) - 1 and trunc(x) + 1 and py between trunc(y) - 1 and trunc(y) + 1, true)
            when tt = 'scroll' then dir is not distinct from pv when tt = 'open_app' then app_name is not distinct from pv when tt in ('status', 'terminate') then gs is not distinct from pv
            when tt = 'wait' then sec is null or coalesce(sec = try_cast(v as double), false) else false end)::int)::bigint as n_match
        from j where tt is not null group by all""",
    "adapted_actions": f"""with {_FIELDS.replace("SOURCE", "steps")}, o as (select step_id, j, case when json_type(j, '$.arguments') = 'OBJECT' and nullif(trim(j ->> '$.arguments.action_type'), '') is not null then j -> '$.arguments' else j end as p, a from fields where json_type(j) = 'OBJECT'),
        u as (select step_id, translate(lower(trim(p ->> '$.action_type')), '- ', '__') as k, p from o where json_type(p, '$.action_type') = 'VARCHAR'),
        m as (select *, case when k in ('click', 'tap', 'press') then 'CLICK' when k in ('long_press', 'longpress', 'hold') then 'LONG_PRESS' when k in ('type', 'input_text', 'input', 'text') then 'TYPE' when k in ('scroll', 'swipe', 'drag') then 'SCROLL'
            when k in ('open', 'open_app', 'launch', 'nav', 'system_button', 'navigate_back', 'navigate_home', 'navigate_recent', 'go_back', 'go_home', 'back', 'home') then 'NAV' when k = 'wait' then 'WAIT' when k in ('terminate', 'answer', 'status', 'finish_episode', 'finish', 'complete', 'done', 'stop') then 'TERMINATE' end as action_type,
            case when json_type(p, '$.x') in ('BIGINT', 'UBIGINT', 'DOUBLE') and json_type(p, '$.y') in ('BIGINT', 'UBIGINT', 'DOUBLE') then round_even((p ->> '$.x')::double, 0)::int end as px, case when json_type(p, '$.x') in ('BIGINT', 'UBIGINT', 'DOUBLE') and json_type(p, '$.y') in ('BIGINT', 'UBIGINT', 'DOUBLE') then round_even((p ->> '$.y')::double, 0)::int end as py,
            nullif(trim(p ->> '$.app_name'), '') as an from u)
        select step_id, action_type, case action_type when 'TYPE' then nullif(trim(p ->> '$.text'), '') when 'NAV' then case when k in ('navigate_back', 'go_back', 'back') then 'back' when k in ('navigate_home', 'go_home', 'home') then 'home' else an end when 'WAIT' then nullif(trim(p ->> '$.seconds'), '')
            when 'TERMINATE' then nullif(trim(coalesce(p ->> '$.goal_status', p ->> '$.arguments.goal_status', p ->> '$.target.labels[0].text')), '') end as argument,
            case when action_type in ('CLICK', 'LONG_PRESS', 'TYPE') then px - 1 end as l, case when action_type in ('CLICK', 'LONG_PRESS', 'TYPE') then py + 1 end as b, case when action_type = 'NAV' then case when k not in ('navigate_back', 'go_back', 'back', 'navigate_home', 'go_home', 'home') then an end else an end as app,
            case when action_type = 'SCROLL' then nullif(translate(lower(trim(p ->> '$.direction')), '- ', '__'), '') end as direction from m where action_type is not null""",
    "answer_texts": f"""with {_FIELDS.replace("SOURCE", "steps")}, {_FIRST},
        w as (select *, coalesce(screenshot.width, 1080) as sw, coalesce(screenshot.height, 1920) as sh from firsts),
        c as (select *, least(999, greatest(0, round_even(coalesce(trunc(x) , sw / 2) * 999 / sw, 0)))::int as cx, least(999, greatest(0, round_even(coalesce(trunc(y), sh / 2) * 999 / sh, 0)))::int as cy, least(999, greatest(0, round_even(sw / 2 * 999 / sw, 0)))::int as mx, least(999, greatest(0, round_even(sh / 2 * 999 / sh, 0)))::int as my from w),
        d as (select *, case when action_type in ('CLICK', 'LONG_PRESS') and pointed then cx else mx end as ax, case when action_type in ('CLICK', 'LONG_PRESS') and pointed then cy else my end as ay from c)
        select step_id, '<thinking>Based on the screen and the instruction, I will perform this action.</thinking><tool_call>{{"name":"mobile_use","arguments":{{"action":' || case action_type when 'CLICK' then '"tap","coordinate":[' || ax || ',' || ay || ']' when 'LONG_PRESS' then '"long_press","coordinate":[' || ax || ',' || ay || ']' when 'TYPE' then '"type","text":' || to_json(coalesce(argument, ''))::varchar
            when 'SCROLL' then '"scroll","coordinate":[' || ax || ',' || ay || '],"direction":"' || coalesce(direction, 'down') || '"' when 'NAV' then case argument when 'home' then '"navigate_home"' when 'recent' then '"navigate_recent"' else '"navigate_back"' end when 'TERMINATE' then '"finish_episode"' when 'WAIT' then '"wait"' else '"tap","coordinate":[499,499]' end || '}}}}</tool_call>' as response,
            case when action_type in ('CLICK', 'LONG_PRESS') then '<thinking>' || chr(10) || case when nullif(trim(step_instruction), '') is not null then 'The current step instruction is: ' || trim(step_instruction) || chr(10) || 'I will perform a ' || replace(lower(action_type), '_', ' ') || ' on the target UI element described by that instruction.' else 'I will perform a ' || replace(lower(action_type), '_', ' ') || ' on the appropriate UI element for this step.' end
                || chr(10) || '</thinking>' || chr(10) || '<tool_call>' || chr(10) || '{{"name": "mobile_use", "arguments": {{"action": "' || lower(action_type) || '", "coordinate": [' end as prefix from d""",
    "worker_reports": f"""with v as (select benchmark, method, coalesce(prompt_tokens, 0) as i, coalesce(generated_tokens, 0) as o, cast(coalesce({_SANE.format(c="latency_ms")}, 0) as decimal(30,4)) as ms from step_results),
        t as (select benchmark, {", ".join(f"coalesce(sum({e}) filter (where method = '{m}'), 0)::{k} as {m}_{n}" for n, e, k in (("tokens_total", "i + o", "bigint"), ("tokens_input_text", "i", "bigint"), ("tokens_visual", "0", "bigint"), ("tokens_output", "o", "bigint"), ("end_to_end_latency_ms_total", "ms", "double")) for m in ("baseline", "hybrid"))} from v group by benchmark)
        select *, {", ".join(f"round(case when baseline_{n} > 0 then 1 - hybrid_{n} / baseline_{n} else 0.0 end, 6) as {r}" for r, n in (("total_token_reduction", "tokens_total"), ("input_text_token_reduction", "tokens_input_text"), ("visual_token_reduction", "tokens_visual"), ("output_token_reduction", "tokens_output"), ("latency_reduction", "end_to_end_latency_ms_total")))} from t""",
    "shared_keys": "select n, count(*) as n_keys from (select count(*) as n from eval_examples group by benchmark, prompt_text, shot_count having count(*) > 1) group by n",
    "request_rows": "select result_id, coalesce(temperature, 0.0) as temperature, coalesce(top_p, 1.0) as top_p, coalesce(max_new_tokens, 32) as max_new_tokens, coalesce(repetition_penalty, 1.0) as repetition_penalty, coalesce(image_max_pixels, 1000000) as image_max_pixels from step_results left join fallback_configs using (config_id)",
    "safe_crops": f"""with {_ACTION}, s as (select step_id, screenshot.width as w, screenshot.height as h, trunc(y)::int as y from typed where y is not null and screenshot.width > 0 and screenshot.height > 0),
        c as (select step_id, w, h, least(greatest(0, y), h - 1) as t, y from s), d as (select *, least(greatest(t + 1, y + 2), h) as b from c), e as (select *, b - t as n, least(h, greatest(b - t + 1, ceil(w / 180)))::int as m from d),
        f as (select *, case when greatest(w, n) / least(w, n) < 180 then t when w < n then t else least(greatest(0, t - (greatest(n, m) - n) // 2), h - greatest(n, m)) end as top, case when greatest(w, n) / least(w, n) < 180 then n when w < n then n else greatest(n, m) end as high from e),
        g as (select *, case when w * high > 10000 then sqrt(10000 / (w * high)) else 1.0 end as k from f)
        select step_id, 0 as l, top::int as t, w::int as r, (top + high)::int as b, greatest(1, round_even(w * k, 0))::int as z_width, greatest(1, round_even(high * k, 0))::int as z_height from g""",
    "payload_paths": f"select path, kind, count(*) as n from ({_PATHS}) group by all",
    "leaking_steps": f"""select * from ({_PATHS}) where regexp_replace(regexp_extract(path, '([^.]+)$', 1), '(\\[\\])+$', '') in ('future_annotation', 'future_annotations', 'future_trajectory', 'next_step', 'next_step_sketch', 'teacher', 'teacher_annotation', 'teacher_annotations', 'teacher_only')
        or regexp_matches(regexp_extract(path, '([^.]+)$', 1), '^(future_|next_step_|teacher_)')""",
    "action_paths": f"""with {_OBJECTS} select n.record_id, n.node_no, (count(*) - 1)::int as depth, string_agg(a.node_no, '/' order by length(a.at)) as path from nodes n join nodes a on a.record_id = n.record_id and (n.at = a.at or starts_with(n.at, a.at || '.actions')) group by n.record_id, n.node_no""",
    "screen_text": """with d as (select record_id, unnest(range(len(screen_descriptions)))::int as step_index, unnest(screen_descriptions) as raw from android_records), f as (select *, decode(raw) as t from d where raw is not null),
        p as (select record_id, step_index, unnest(range(len(string_split(t, '|')))) as k, trim(regexp_replace(unnest(string_split(t, '|')), '[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) as x from f),
        g as (select *, rtrim(x[:160]) as y from p where length(x) >= 3 and regexp_matches(x, '\\p{L}') and not regexp_matches(x, '(?i)https?://|www\\.|googleadservices\\.com|doubleclick\\.net|utm_|gclid(?:=|%3d)|adurl(?:=|%3d)|client=ca-app-pub')
            and not (length(x) > 64 and regexp_matches(x, '(?:%[0-9A-Fa-f]{2}){4,}')) and not (length(x) > 120 and length(x) - length(replace(x, '=', '')) >= 2 and length(x) - length(replace(x, '&', '')) >= 2)),
        s as (select *, row_number() over w as no, sum(length(y) + 3) over w - 3 as size from g window w as (partition by record_id, step_index order by k)),
        u as (select record_id, step_index, y, min(no) as no from s where no <= 64 and size <= 4096 group by all), j as (select record_id, step_index, string_agg(y, ' | ' order by no) as text from u group by all)
        select f.record_id, f.step_index, coalesce(j.text, '') as text from f left join j using (record_id, step_index)""",
    "p6_actions": f"""with {_OBJECTS}, up as (select n.record_id, n.node_no, arg_max(a.node_no, length(a.at)) as parent from nodes n join nodes a on a.record_id = n.record_id and starts_with(n.at, a.at || '.actions') group by all)
        select n.record_id, n.step_index, 0 as window_no, n.node_no, coalesce(parent, -1) as parent_no, {", ".join(f"v ->> '$.{k}' as {k}" for k in ("action_type", "x", "y", "direction", "text", "app_name", "goal_status", "seconds", "times"))} from nodes n left join up using (record_id, node_no)""",
}
