"""Steps from records of parallel arrays, canonical records of both benchmarks, and what is compared of truth and prediction.

Everything is an expression over one row; arrays of a record give history and next step
without a window. An action is struct<action_type, argument, box, app, direction>, a target
struct<type, source, label, box>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.geometry import around, centre, region_box, screen_box
from stepweave.functions.text import normalize, tokens
from stepweave.operators.scoring import swipe_direction

BOX = "struct<l:int,t:int,r:int,b:int>"
# Actions that depend on a place on the screen.
LOCALIZED = ("CLICK", "LONG_PRESS", "TYPE")


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def action(kind: Column, argument: Column | None = None, box: Column | None = None, app: Column | None = None, direction: Column | None = None) -> Column:
    given = lambda c, of="string": _none(of) if c is None else c
    return F.struct(kind.alias("action_type"), given(argument).alias("argument"), given(box, BOX).alias("box"), given(app).alias("app"), given(direction).alias("direction"))


def expected_screens(*arrays: str, actions: str = "actions") -> Column:
    """Screens a record should have: as many as its longest array, or one more than its actions."""
    sizes = [F.greatest(F.lit(0), F.coalesce(F.size(a), F.lit(0))) for a in arrays]
    n = F.greatest(F.lit(0), F.coalesce(F.size(actions), F.lit(0)))
    return F.greatest(*sizes, F.when(n > 0, n + 1).otherwise(0))


def step_rows(records: DataFrame) -> DataFrame:
    """One row per action of each record: record_id, step_index, episode_id, goal, instruction, raw_action, width, height, description, next_instruction, next_width, high_level_index, n_screens.

    Arrays may differ in length: what an array lacks is null. high_level_index counts the
    changes of the instruction so far.
    """
    arrays = ("step_instructions", "screenshot_widths", "screenshot_heights", "accessibility_trees", "screen_descriptions")
    text = lambda a: F.transform(a, lambda x: F.decode(x, "UTF-8"))
    r = records.select(
        "record_id", F.get("episode_id", F.lit(0)).alias("episode_id"), F.get(text("goal"), F.lit(0)).alias("goal"), text("actions").alias("acts"), text("step_instructions").alias("said"), text("screen_descriptions").alias("seen"),
        F.col("screenshot_widths").alias("widths"), F.col("screenshot_heights").alias("heights"), expected_screens(*arrays).alias("n_screens"),
    )
    # changes of the instruction before each place, computed once a record
    steps = r.select("*", F.posexplode("acts").alias("step_index", "raw_action"))
    at = F.col("step_index")
    said = lambda i: F.get("said", i)
    before = F.when(at > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), at))).otherwise(F.array().cast("array<int>"))
    changes = F.size(F.filter(before, lambda i: ~F.get(F.col("said"), i).eqNullSafe(F.get(F.col("said"), i - 1))))
    return steps.select(
        "record_id", "step_index", "episode_id", "goal", said(at).alias("instruction"), "raw_action", F.get("widths", at).alias("width"), F.get("heights", at).alias("height"), F.get("seen", at).alias("description"),
        said(at + 1).alias("next_instruction"), F.get("widths", at + 1).alias("next_width"), changes.cast("bigint").alias("high_level_index"), "n_screens",
    )


# The keys of a payload that are read, as text, number and box.
TEXTS = ("action_type", "text", "app_name", "direction", "goal_status", "status", "seconds", "duration", "target_label")
NUMBERS = ("x", "y", "seconds", "duration")
BOXES = ("target_bbox", "bbox")


def with_fields(rows: DataFrame, payload: Column, v: str = "j_") -> DataFrame:
    """rows with the keys of a payload (a variant) as columns of prefix v: each is read once, whatever is made of it."""

    def as_number(key: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(payload, f"$.{key}", "variant"))
        return F.when(~(kind.isin("STRING", "BOOLEAN") | kind.startswith("OBJECT") | kind.startswith("ARRAY")), F.try_variant_get(payload, f"$.{key}", "double"))

    read = rows.withColumns({f"{v}{k}": F.try_variant_get(payload, f"$.{k}", "string") for k in TEXTS} | {f"{v}{k}_n": as_number(k) for k in NUMBERS} | {f"{v}{k}_four": F.try_variant_get(payload, f"$.{k}", "array<double>") for k in BOXES})

    def strict(n: Column) -> Column:
        """Box of four numbers, truncated; null for an empty one."""
        box = F.struct(*[F.get(n, F.lit(i)).cast("int").alias(x) for i, x in enumerate("ltrb")])
        return F.when((F.size(n) == 4) & F.forall(n, lambda x: x.isNotNull()) & (box["r"] > box["l"]) & (box["b"] > box["t"]), box)

    return read.withColumns({f"{v}{k}_box": strict(F.col(f"{v}{k}_four")) for k in BOXES})


def _text(v: str, key: str) -> Column:
    return normalize(F.col(f"{v}{key}"))


def _number(v: str, key: str) -> Column:
    return F.col(f"{v}{key}_n")


def _strict(v: str, key: str) -> Column:
    return F.col(f"{v}{key}_box")


def point_of(v: str = "j_") -> Column:
    """struct<x, y> of a payload's point, truncated; null without numbers."""
    x, y = _number(v, "x"), _number(v, "y")
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")))


def first_action(v: str = "j_") -> Column:
    """Canonical action of a payload of the first benchmark; an unknown name passes in upper case."""
    kind = F.lower(F.coalesce(F.col(f"{v}action_type"), F.lit("")))
    p = point_of(v)
    seconds = F.coalesce(*[F.when(_number(v, k).isNull() | (_number(v, k) != 0), F.nullif(F.col(f"{v}{k}"), F.lit(""))) for k in ("seconds", "duration")], F.lit("wait"))
    status = F.coalesce(*[F.nullif(F.col(f"{v}{k}"), F.lit("")) for k in ("goal_status", "status")], F.lit("successful"))
    return (
        F.when(kind.isin("click", "long_press"), action(F.upper(kind), box=F.when(p.isNotNull(), around(p["x"], p["y"]))))
        .when(kind == "scroll", action(F.lit("SCROLL"), direction=_text(v, "direction"))).when(kind == "open_app", action(F.lit("NAV"), _text(v, "app_name"), app=_text(v, "app_name")))
        .when(kind.isin("input_text", "type"), action(F.lit("TYPE"), _text(v, "text"))).when(kind.isin("navigate_home", "navigate_back"), action(F.lit("NAV"), F.substring(kind, 10, 4)))
        .when(kind == "wait", action(F.lit("WAIT"), normalize(seconds))).when(kind.isin("status", "terminate"), action(F.lit("TERMINATE"), normalize(status))).otherwise(action(F.upper(kind)))
    )


def second_action(written: Column, annotated: Column, touch: Column, lift: Column, typed: Column, region: Column) -> Column:
    """Canonical action of the second benchmark.

    written: NAME or NAME[argument]; annotated: the annotation's name, which overrides it for
    tap, type and swipe; touch, lift: arrays of x and y; typed: the annotation's text;
    region: array of two corners.
    """
    written = F.coalesce(written, F.lit(""))
    bracketed = written.contains("[") & written.endswith("]")
    name = F.upper(F.when(bracketed, F.substring_index(written, "[", 1)).otherwise(written))
    argument = F.when(bracketed, F.regexp_extract(written, r"(?s)^[^\[]*\[(.*)\]$", 1))
    named = lambda *names: name.isin(*names) | F.coalesce(F.upper(annotated) == names[-1], F.lit(False))
    whole = lambda a: F.coalesce(F.size(a) == 2, F.lit(False))
    box = F.when(whole(touch), around(touch[0].cast("int"), touch[1].cast("int")))
    # a motion that goes nowhere counts as one down
    moved = F.when(whole(touch) & whole(lift), F.coalesce(swipe_direction(touch[0], touch[1], lift[0], lift[1]), F.lit("down")))
    given = F.nullif(argument, F.lit(""))
    return (
        F.when(named("CLICK", "TAP"), action(F.lit("CLICK"), box=box)).when(named("TYPE"), action(F.lit("TYPE"), normalize(F.coalesce(F.nullif(typed, F.lit("")), given)), box))
        .when(named("SCROLL", "SWIPE"), action(F.lit("SCROLL"), box=region_box(region), direction=F.when(given.isNotNull(), normalize(given)).otherwise(moved)))
        .when(name == "PRESS_ENTER", action(F.lit("NAV"), F.lit("enter"))).when(name.isin("PRESS_BACK", "BACK"), action(F.lit("NAV"), F.lit("back"))).when(name.isin("PRESS_HOME", "HOME"), action(F.lit("NAV"), F.lit("home")))
        .when(name.startswith("TASK_COMPLETE"), action(F.lit("TERMINATE"), F.lit("success"))).otherwise(action(name, normalize(given), box))
    )


def target(kind: str | Column, source: str | Column, label: Column | None, box: Column | None = None) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(kind).alias("type"), as_column(source).alias("source"), (_none() if label is None else label).alias("label"), (_none(BOX) if box is None else box).alias("box"))


def first_target(act: Column, found: Column, v: str = "j_") -> Column:
    """What an action of the first benchmark is bound to; found: struct<label, box> of the smallest node that holds its point, null without one."""
    kind, p = act["action_type"], point_of(v)
    typed = F.coalesce(_strict(v, "target_bbox"), _strict(v, "bbox"))
    at_point = F.when(found["box"].isNotNull(), target("element", "accessibility_node", normalize(found["label"]), found["box"])).otherwise(target("pseudo_element", "action_point", None, F.when(p.isNotNull(), around(p["x"], p["y"]))))
    return (
        F.when(kind.isin("CLICK", "LONG_PRESS"), F.when(p.isNotNull(), at_point))
        .when(kind == "TYPE", target(F.when(typed.isNotNull(), "element").otherwise("pseudo_element"), F.when(typed.isNotNull(), "input_text_target").otherwise("input_text_action"), F.coalesce(_text(v, "target_label"), act["argument"]), typed))
        .when(kind == "SCROLL", target("pseudo_element", "scroll_action", act["direction"])).when(kind == "NAV", target("pseudo_element", "navigation_action", F.coalesce(act["argument"], act["app"])))
        .when(kind == "WAIT", target("pseudo_element", "wait_action", act["argument"]))
    )


def second_target(act: Column, touch: Column, elements: Column, width: Column, height: Column) -> Column:
    """What an action of the second benchmark is bound to: of the elements (box, label; array) that hold the touch, else of all, the nearest."""
    kind = act["action_type"]
    x, y = touch[0].cast("int"), touch[1].cast("int")
    inside = F.filter(elements, lambda e: x.between(e["box"]["l"], e["box"]["r"]) & y.between(e["box"]["t"], e["box"]["b"]))
    pool = F.when(F.size(inside) > 0, inside).otherwise(elements)
    gap = lambda e: F.hypot((e["box"]["l"] + e["box"]["r"]) / 2 - x, (e["box"]["t"] + e["box"]["b"]) / 2 - y)
    best = F.array_min(F.transform(pool, lambda e, i: F.struct(gap(e).alias("gap"), i.alias("place"), e["label"].alias("label"), e["box"].alias("box"))))
    touched = F.when(best.isNotNull(), target("element", "element_annotation", normalize(best["label"]), best["box"])).otherwise(target("pseudo_element", "touch_coordinate", None, around(x, y)))
    region = F.coalesce(act["box"], screen_box(width, height))
    return (
        F.when(kind.isin("CLICK", "TYPE") & F.coalesce(F.size(touch) == 2, F.lit(False)), touched)
        .when(kind == "SCROLL", target("pseudo_element", F.when(act["box"].isNotNull(), "interest_region").otherwise("full_screen"), F.lit("scroll_region"), region))
        .when(kind == "NAV", target("pseudo_element", "navigation", F.coalesce(act["argument"], act["app"]))).when(kind == "TERMINATE", target("pseudo_element", "task_status", act["argument"]))
    )


def bound(act: Column, to: Column) -> Column:
    """The action with its target's box, if it has none of its own or is a click."""
    take = to["box"].isNotNull() & (act["box"].isNull() | act["action_type"].isin("CLICK", "LONG_PRESS"))
    return action(act["action_type"], act["argument"], F.when(take, to["box"]).otherwise(act["box"]), act["app"], act["direction"])


def effect(kind: Column, description: Column, next_description: Column, instruction: Column, next_instruction: Column, has_next: Column) -> Column:
    """struct of what changed after a step; a missing next step counts as null."""
    return F.struct((~has_next).alias("terminal"), (~description.eqNullSafe(next_description)).alias("description_changed"), (~instruction.eqNullSafe(next_instruction)).alias("instruction_changed"), kind.alias("action_type"), has_next.alias("next_available"))


def app_effect(package: Column, next_package: Column, caption: Column, next_caption: Column, kind: Column, has_next: Column) -> Column:
    """The same for the second benchmark: a change of app needs a known current one."""
    changed = (F.coalesce(package, F.lit("")) != "") & ~package.eqNullSafe(next_package)
    return F.struct(((kind == "TERMINATE") | ~has_next).alias("terminal"), changed.alias("app_changed"), (~caption.eqNullSafe(next_caption)).alias("caption_changed"), has_next.alias("next_available"))


# Fields of a screen and of the history that only the truth knows.
TRUTH_OF_SCREEN = ("bound_target.bbox", "bound_target.functionality", "bound_target.label")
TRUTH_OF_HISTORY = ("bound_target.bbox", "bound_target.label")


def is_truth_of_screen(field: Column) -> Column:
    return field.isin(*TRUTH_OF_SCREEN)


def is_truth_of_history(field: Column) -> Column:
    return field.isin(*TRUTH_OF_HISTORY)


def runtime_view(records: DataFrame, modes: tuple[str, ...] = ("high_level", "low_level"), preserve_action: bool = False) -> DataFrame:
    """Canonical records (goal, instruction, description, action, ...) as a model sees them in each mode: no target and effect, the instruction in low level only, the action only if preserved, overlaps of words without them."""
    seen = records.drop("target", "effect", "words").withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    seen = seen.withColumn("instruction", F.when(F.col("mode") != "high_level", F.col("instruction"))).withColumn("policy", F.lit("runtime_observable_only"))
    if not preserve_action:
        seen = seen.withColumn("action", action(F.lit("UNOBSERVED")))
    return seen.withColumn("words", lexical_alignment(F.col("goal"), F.col("description"), _none(), F.col("instruction"), _none()))


def roi_change(kind: Column, next_available: Column) -> Column:
    """Whether the screen changed where an action that depends on no place was done; null where that can't be told."""
    return F.when(~is_localized(kind), next_available)


def is_localized(kind: Column) -> Column:
    return F.coalesce(F.upper(kind).isin(*LOCALIZED), F.lit(False))


def observed_effect(kind: Column, delta: Column) -> Column:
    """The effect a runtime may use: that of actions that depend on no place."""
    return F.when(~is_localized(kind), delta)


def effect_kind(kind: Column) -> Column:
    return F.when(is_localized(kind), "none_localized_action").otherwise("ground_truth_transition_proxy")


def lexical_alignment(goal: Column, screen: Column, argument: Column, said: Column, label: Column) -> Column:
    """struct of the distinct tokens of goal, screen with label, argument and action text, and four overlaps, sorted."""
    g, a, t = tokens(goal), tokens(argument), tokens(said)
    s = F.array_distinct(F.concat(tokens(screen), tokens(label)))
    both = lambda x, y: F.array_sort(F.array_intersect(x, y))
    return F.struct(
        g.alias("goal_tokens"), s.alias("screen_tokens"), a.alias("argument_tokens"), t.alias("action_tokens"),
        both(g, s).alias("goal_screen"), both(g, a).alias("goal_argument"), both(s, a).alias("screen_argument"), both(t, s).alias("action_screen"),
    )


def wait_value(value: Column) -> Column:
    return F.nullif(normalize(value), F.lit("wait"))


def _comparable(**parts: Column) -> Column:
    kinds = {"type": "string", "x": "double", "y": "double", "box": BOX, "text": "string", "direction": "string", "app": "string", "status": "string", "seconds": "double", "label": "string"}
    return F.struct(*[(parts[k].cast(t) if k in parts else _none(t)).alias(k) for k, t in kinds.items()])


def first_truth(found: Column, v: str = "j_") -> Column:
    """The comparable record of a payload: its target is the box it names, else the node that holds its point, else the point's surroundings."""
    p = point_of(v)
    named = F.coalesce(_strict(v, "target_bbox"), _strict(v, "bbox"))
    box = F.coalesce(named, found["box"], F.when(p.isNotNull(), around(p["x"], p["y"])))
    seconds = F.coalesce(F.nullif(_number(v, "seconds"), F.lit(0.0)), F.nullif(_number(v, "duration"), F.lit(0.0)))
    return _comparable(type=_text(v, "action_type"), x=_number(v, "x"), y=_number(v, "y"), box=box, text=_text(v, "text"), direction=_text(v, "direction"), app=_text(v, "app_name"), status=_text(v, "goal_status"), seconds=seconds, label=normalize(found["label"]))


def first_prediction(act: Column, found: Column) -> Column:
    """The comparable record of a canonical action; found: struct<label, box> of the node that holds its centre."""
    kind, argument = act["action_type"], normalize(act["argument"])
    c = centre(act["box"])
    names = F.create_map(*[F.lit(x) for x in ("CLICK", "click", "LONG_PRESS", "long_press", "TYPE", "input_text")])
    return (
        F.when(kind.isin("CLICK", "LONG_PRESS", "TYPE"), _comparable(type=names[kind], x=c["x"], y=c["y"], box=F.coalesce(act["box"], found["box"]), text=argument, label=F.coalesce(normalize(found["label"]), argument)))
        .when(kind == "SCROLL", _comparable(type=F.lit("scroll"), direction=normalize(act["direction"])))
        .when(kind == "NAV", F.when(argument.isin("home", "back"), _comparable(type=F.concat(F.lit("navigate_"), argument))).otherwise(_comparable(type=F.lit("open_app"), app=normalize(F.coalesce(act["app"], act["argument"])))))
        .when(kind == "WAIT", _comparable(type=F.lit("wait"), seconds=wait_value(act["argument"]).try_cast("double"))).when(kind == "TERMINATE", _comparable(type=F.lit("status"), status=F.coalesce(argument, F.lit("successful"))))
        .when(kind.isNotNull(), _comparable(type=normalize(kind))).otherwise(_comparable())
    )


def official(act: Column) -> Column:
    """struct<type, x, y, text, direction> of a canonical action in the second benchmark's names."""
    kind, c = act["action_type"], centre(act["box"])
    keys = F.create_map(*[F.lit(x) for x in ("back", "PRESS_BACK", "home", "PRESS_HOME", "enter", "PRESS_ENTER")])
    name = F.when(kind == "SCROLL", "SWIPE").when(kind == "NAV", F.coalesce(keys[normalize(act["argument"])], F.lit("NAV"))).when(kind == "TERMINATE", "TASK_COMPLETE").otherwise(kind)
    return F.struct(name.alias("type"), F.when(kind == "CLICK", c["x"]).alias("x"), F.when(kind == "CLICK", c["y"]).alias("y"), F.when(kind == "TYPE", normalize(act["argument"])).alias("text"), F.when(kind == "SCROLL", normalize(act["direction"])).alias("direction"))


def response_text(act: Column, width: Column, height: Column) -> Column:
    """The training response of an action: a thought and a tool call, coordinates from 0 to 999 and clamped."""
    kind = act["action_type"]
    middle = lambda a, b, size: F.coalesce((act["box"][a] + act["box"][b]) / 2, size / 2)
    small = lambda v, size: F.least(F.lit(999), F.greatest(F.lit(0), F.coalesce(F.bround(F.try_divide(v * 999, size)).cast("int"), F.lit(0))))
    where = F.array(small(middle("l", "r", width), width), small(middle("t", "b", height), height))
    moves = F.create_map(*[F.lit(x) for x in ("back", "navigate_back", "home", "navigate_home", "recent", "navigate_recent")])
    call = lambda name, **more: F.to_json(F.struct(F.lit("mobile_use").alias("name"), F.struct(name.alias("action"), *[c.alias(k) for k, c in more.items()]).alias("arguments")))
    body = (
        F.when(kind.isin("CLICK", "LONG_PRESS"), call(F.when(kind == "CLICK", "tap").otherwise("long_press"), coordinate=where)).when(kind == "TYPE", call(F.lit("type"), text=F.coalesce(act["argument"], F.lit(""))))
        .when(kind == "SCROLL", call(F.lit("scroll"), coordinate=where, direction=F.lower(F.coalesce(act["direction"], F.lit("down"))))).when(kind == "NAV", call(F.coalesce(moves[F.lower(F.coalesce(act["argument"], F.lit("back")))], F.lit("navigate_back"))))
        .when(kind == "TERMINATE", call(F.lit("finish_episode"))).when(kind == "WAIT", call(F.lit("wait"))).otherwise(call(F.lit("tap"), coordinate=F.array(F.lit(499), F.lit(499))))
    )
    return F.concat(F.lit("<thinking>Based on the screen and the instruction, I will perform this action.</thinking><tool_call>"), body, F.lit("</tool_call>"))


# How the prefixes of forced answers begin.
CALL_UP_TO = {"click": '<tool_call>\n{"name": "mobile_use", "arguments": {"action": "click"', "long_press": '<tool_call>\n{"name": "mobile_use", "arguments": {"action": "long_press"'}
UP_TO_POINT = ', "coordinate": ['
MODES, POINTS = ("none", "template", "ar_cache"), ("thinking_end", "action", "coord_bracket")


def template_thinking(instruction: Column, kind: Column) -> Column:
    said, name = F.nullif(F.trim(instruction), F.lit("")), F.replace(kind, F.lit("_"), F.lit(" "))
    body = F.when(said.isNotNull(), F.concat(F.lit("The current step instruction is: "), said, F.lit("\nI will perform a "), name, F.lit(" on the target UI element described by that instruction."))).otherwise(
        F.concat(F.lit("I will perform a "), name, F.lit(" on the appropriate UI element for this step."))
    )
    return F.concat(F.lit("<thinking>\n"), body, F.lit("\n</thinking>\n"))


def forced_prefix(instruction: Column, kind: Column, mode: str = "template", point: str = "action", thought: Column | None = None) -> Column:
    """The beginning of an answer up to the end of its thinking, its action, or the bracket of its point; null for actions without a point.

    mode: no thinking, a template, or a given thought. ValueError for an unknown mode or
    point, for the end of thinking without any, and for a given thought that is not given.
    """
    if mode not in MODES or point not in POINTS:
        raise ValueError(f"mode {mode}, point {point}")
    if mode == "none" and point == "thinking_end":
        raise ValueError("no thinking has no end")
    if mode == "ar_cache" and thought is None:
        raise ValueError("a thought is needed")
    kind = F.lower(F.trim(kind))
    given = F.nullif(F.trim(thought), F.lit("")) if thought is not None else None
    thinking = F.lit("") if mode == "none" else template_thinking(instruction, kind) if mode == "template" else F.concat(F.when(given.contains("<thinking>"), given).otherwise(F.concat(F.lit("<thinking>\n"), given, F.lit("\n</thinking>"))), F.lit("\n"))
    call = F.create_map(*[F.lit(x) for pair in CALL_UP_TO.items() for x in pair])[kind]
    if point == "thinking_end":
        return F.when(call.isNotNull(), F.nullif(F.regexp_extract(thinking, r"(?s)^(.*</thinking>\n?)", 1), F.lit("")))
    return F.concat(thinking, call, F.lit(UP_TO_POINT if point == "coord_bracket" else ""))
