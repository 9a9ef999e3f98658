"""Canonical actions from payloads and calls, and rules that compare two of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of actions with their canonical types.
TYPES = {
    "click": "CLICK", "tap": "CLICK", "long_press": "LONG_PRESS", "longpress": "LONG_PRESS", "scroll": "SCROLL", "swipe": "SCROLL", "input_text": "TYPE", "type": "TYPE",
    "open_app": "OPEN_APP", "navigate_back": "NAV", "navigate_home": "NAV", "system_button": "NAV", "wait": "WAIT", "status": "TERMINATE", "terminate": "TERMINATE",
}


def canonical_type(name: Column) -> Column:
    """Canonical type of an action's name; an unknown name in upper case."""
    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.coalesce(known[F.lower(F.trim(name))], F.upper(F.trim(name)))


def payload(text: Column) -> Column:
    """A payload as variant: JSON, or JSON within a JSON string; null if it can't be read."""
    value = F.try_parse_json(text)
    inner = F.try_parse_json(F.try_variant_get(value, "$", "string"))
    return F.when(F.schema_of_variant(value) == "STRING", inner).otherwise(value)


def from_payload(value: Column) -> Column:
    """struct<action_type, x, y, argument> of a payload."""
    get = lambda path, kind="string": F.try_variant_get(value, path, kind)
    point = lambda i, key: F.coalesce(get(f"$.{key}", "double"), get(f"$.arguments.coordinate[{i}]", "double"))
    argument = F.coalesce(*(get(p) for p in ("$.text", "$.arguments.text", "$.direction", "$.arguments.direction", "$.app_name", "$.arguments.app_name", "$.goal_status", "$.arguments.goal_status")))
    return F.struct(canonical_type(get("$.action_type")).alias("action_type"), point(0, "x").alias("x"), point(1, "y").alias("y"), argument.alias("argument"))


def from_call(text: Column) -> Column:
    """struct<action_type, x, y, argument> of the NAME(argument) call that ends a text; fields null without one."""
    pattern = r"(?:^|\n)([A-Z][A-Z_]+)\(([^()\n]*)\)\s*$"
    name, argument = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.regexp_extract(text, pattern, 2)
    number = lambda i: F.nullif(F.regexp_extract(argument, r"^\s*(\d+)\s*,\s*(\d+)\s*$", i), F.lit("")).cast("double")
    return F.struct(canonical_type(name).alias("action_type"), number(1).alias("x"), number(2).alias("y"), F.when(name.isNotNull() & number(1).isNull(), F.trim(argument)).alias("argument"))


def matches(a: Column, b: Column, width: int = 1000) -> Column:
    """Same type, and a click or long press within int(0.14 * width) of the other's, any wait, or the same argument."""
    reach = int(0.14 * width)
    near = F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2)) <= reach
    same = F.when(a["action_type"].isin("CLICK", "LONG_PRESS"), F.coalesce(near, F.lit(False))).when(a["action_type"] == "WAIT", True).otherwise(F.lower(a["argument"]).eqNullSafe(F.lower(b["argument"])))
    return F.coalesce((a["action_type"] == b["action_type"]) & same, F.lit(False))
