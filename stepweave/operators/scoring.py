"""Benchmark rules: truth and prediction of a step compared, nodes kept or dropped, cost of a request.

Structs: an action has type, x, y, box (l, t, r, b), text, direction, app, status, seconds,
label; missing parts are null. Every rule gives a boolean, never null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepweave.functions.geometry import area, contains, strict_box, visual_tokens
from stepweave.functions.text import clean, normalize, overlap_f1, tokens

# Widgets that only hold others (as they are compared, of which only `view` has no underscore), and widgets that tell something without a text.
CONTAINERS = ("frame_layout", "linear_layout", "relative_layout", "view", "view_group")
INFORMATIVE = ("button", "checkbox", "checkedtextview", "edittext", "imagebutton", "imageview", "radiobutton", "recyclerview", "scrollview", "seekbar", "spinner", "switch", "tabwidget", "textview", "webview")


def _yes(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def first_benchmark(truth: Column, predicted: Column, strict_nav: bool = True) -> Column:
    """Whether a predicted action does what the truth does.

    Same type: a click lies in the truth's box; texts are equal and, where both are known,
    the point lies in the box; scroll, app and status are equal, null to null; a wait
    matches if the truth names no time. Home and back match nothing with strict_nav, each
    other's equal without. Across types: back is a click on a back button, opening an app a
    click on its label.
    """
    inside = contains(strict_box(truth["box"]), predicted["x"], predicted["y"])
    same_text = lambda key: normalize(truth[key]).eqNullSafe(normalize(predicted[key]))
    kind = truth["type"]
    equal = (
        F.when(kind.isin("click", "long_press"), _yes(inside)).when(kind == "input_text", same_text("text") & F.coalesce(inside, F.lit(True)))
        .when(kind == "scroll", same_text("direction")).when(kind == "open_app", same_text("app")).when(kind.isin("status", "terminate"), same_text("status"))
        .when(kind == "wait", F.nullif(truth["seconds"], F.lit(0.0)).isNull() | _yes(truth["seconds"] == predicted["seconds"]))
        .when(kind.isin("navigate_home", "navigate_back"), F.lit(not strict_nav)).otherwise(False)
    )

    def is_back(a: Column) -> Column:
        words = tokens(F.coalesce(a["label"], a["text"]))
        return F.array_contains(words, "back") | (F.array_contains(words, "navigate") & F.array_contains(words, "up"))

    def across(a: Column, b: Column) -> Column:
        back = (a["type"] == "navigate_back") & (b["type"] == "click") & is_back(b)
        app = (a["type"] == "open_app") & (b["type"] == "click") & (normalize(a["app"]) == normalize(F.coalesce(b["label"], b["text"])))
        return _yes(back) | _yes(app)

    return F.when(kind == predicted["type"], equal).otherwise(across(truth, predicted) | across(predicted, truth))


def second_benchmark(truth: Column, predicted: Column, width: Column) -> Column:
    """Equal types, and for CLICK at most int(0.14 * width) apart, for TYPE token F1 of 0.5, for SWIPE the direction, if the truth has one."""
    apart = F.sqrt(F.pow(truth["x"] - predicted["x"], 2) + F.pow(truth["y"] - predicted["y"], 2))
    rule = (
        F.when(truth["type"] == "CLICK", _yes(apart <= F.floor(width * 0.14))).when(truth["type"] == "TYPE", overlap_f1(tokens(truth["text"]), tokens(predicted["text"])) >= 0.5)
        .when(truth["type"] == "SWIPE", normalize(truth["direction"]).isNull() | _yes(normalize(truth["direction"]) == normalize(predicted["direction"]))).otherwise(True)
    )
    return _yes(truth["type"] == predicted["type"]) & rule


def keeps_node(node: Column, screen_area: Column, containers: tuple[str, ...] = CONTAINERS, informative: tuple[str, ...] = INFORMATIVE) -> Column:
    """Whether a UI node may be a candidate.

    node: box, visible, clickable, editable, scrollable, checkable (booleans), text,
    description, view_id, widget. Dropped: no valid box, invisible, 0.95 of the screen or
    more; and of those that can't be acted on: unnamed ones, over 0.60 of the screen,
    containers, texts over 96 characters, silent ones whose widget says nothing.
    """
    ratio = F.coalesce(F.try_divide(area(node["box"]), screen_area), F.lit(0.0))
    active = F.coalesce(node["clickable"], F.lit(False)) | F.coalesce(node["editable"], F.lit(False)) | F.coalesce(node["scrollable"], F.lit(False)) | F.coalesce(node["checkable"], F.lit(False))
    text, description, widget = clean(node["text"]), clean(node["description"]), F.lower(F.coalesce(node["widget"], F.lit("")))
    silent = text.isNull() & description.isNull()
    passive_ok = ~((silent & node["view_id"].isNull()) | (ratio > 0.60) | widget.isin(*containers) | _yes(F.length(text) > 96) | (silent & ~widget.isin(*informative)))
    return strict_box(node["box"]).isNotNull() & F.coalesce(node["visible"], F.lit(True)) & (ratio < 0.95) & (active | passive_ok)


def request_cost(text: Column, width: Column, height: Column, budget: Column, max_new: Column) -> Column:
    """struct<words, visual, output>: white-space words, visual tokens of the image scaled to a pixel budget, a quarter of the permitted output."""
    scale = F.when(width * height > budget, F.sqrt(budget / (width * height))).otherwise(1.0)
    side = lambda v: F.when(v.isNotNull(), F.greatest(F.lit(1), F.bround(v * scale)))
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")).cast("bigint")
    visual = F.coalesce((F.ceil(side(width) / 28) * F.ceil(side(height) / 28)).cast("bigint"), F.lit(0).cast("bigint"))
    return F.struct(words.alias("words"), visual.alias("visual"), F.greatest(F.lit(1), F.floor(max_new / 4)).cast("bigint").alias("output"))


def swipe_direction(start_x: Column, start_y: Column, end_x: Column, end_y: Column) -> Column:
    """Direction of a motion; the vertical wins ties, no motion is null."""
    dx, dy = end_x - start_x, end_y - start_y
    return F.when((dx == 0) & (dy == 0), None).when(F.abs(dy) >= F.abs(dx), F.when(dy < 0, "up").otherwise("down")).otherwise(F.when(dx < 0, "left").otherwise("right"))


def smooth_l1(error: Column, beta: float = 0.01) -> Column:
    return F.when(F.abs(error) < beta, 0.5 * error * error / beta).otherwise(F.abs(error) - 0.5 * beta)


def reduction(hybrid: Column, baseline: Column) -> Column:
    """1 - hybrid / baseline, 0 for a baseline of 0 or less."""
    return F.coalesce(F.when(baseline > 0, 1 - hybrid / baseline), F.lit(0.0))


def speed_up(hybrid: Column, baseline: Column) -> Column:
    return F.when(hybrid > 0, baseline / hybrid)


def final_usage(measured: Column, estimated: Column) -> Column:
    """struct<prompt, visual, generated> as measured, or as estimated where nothing was."""
    total = sum((F.coalesce(measured[k], F.lit(0)) for k in ("prompt", "visual", "generated")), F.lit(0))
    return F.when(total > 0, measured).otherwise(estimated)


def reported_usage(prompt_total: Column, generated: Column, width: Column, height: Column, estimated: Column) -> Column:
    """The usage of a service's report: its prompt tokens less those of the image; what it does not tell is taken from the estimate."""
    visual = visual_tokens(width, height)
    text = F.when(prompt_total > 0, F.greatest(F.lit(0), prompt_total - visual)).otherwise(estimated["prompt"])
    told = F.struct(text.cast("bigint").alias("prompt"), visual.alias("visual"), F.coalesce(F.nullif(generated, F.lit(0)), estimated["generated"]).cast("bigint").alias("generated"))
    return F.when(prompt_total.isNull() & generated.isNull(), estimated).otherwise(told)


def loss_labels(ids: Column, prompt_length: Column, ignored: int = -100) -> Column:
    """Token ids with those of the prompt replaced by the value that a loss leaves out."""
    p = F.least(F.greatest(F.lit(0), prompt_length), F.size(ids)).cast("int")
    return F.concat(F.array_repeat(F.lit(ignored).cast("bigint"), p), F.transform(F.slice(ids, p + 1, F.greatest(F.lit(0), F.size(ids) - p)), lambda x: x.cast("bigint")))


def tokens_before(offsets: Column, place: Column) -> Column:
    """Tokens that begin before a character: offsets is the array of the tokens' first characters, in order."""
    return F.size(F.filter(offsets, lambda x: x < place)).cast("bigint")
