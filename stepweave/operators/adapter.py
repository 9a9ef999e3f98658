"""Canonical actions from what models write and recorders store.

An action is struct<action_type, argument, box, app, direction>. Payloads differ in where
they keep a part, so a payload is read through tables of places: each part is the first of
its places that holds one. As a candidate may need repair and its parts are asked for in
several objects, an expression over variants grows beyond what the planner takes; this runs
in Arrow batches. Plain recorder payloads have an expression of their own
(`actions.from_payload`).

Defined results: text without an action gives null; an unknown name gives null; a payload
that lacks what its type needs (a click its box, a text entry its text, a scroll its
direction, navigation its target) is passed over for the next candidate.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

BOX = StructType([StructField(x, IntegerType()) for x in "ltrb"])
ACTION = StructType([StructField(x, BOX if x == "box" else StringType()) for x in ("action_type", "argument", "box", "app", "direction")])

# Names of actions with their canonical types.
NAMES = {
    "click": "CLICK", "tap": "CLICK", "press": "CLICK", "long_press": "LONG_PRESS", "longpress": "LONG_PRESS", "hold": "LONG_PRESS", "type": "TYPE", "input_text": "TYPE", "input": "TYPE", "text": "TYPE",
    "scroll": "SCROLL", "swipe": "SCROLL", "drag": "SCROLL", "open": "NAV", "open_app": "NAV", "launch": "NAV", "nav": "NAV", "system_button": "NAV", "navigate_back": "NAV", "navigate_home": "NAV", "navigate_recent": "NAV",
    "go_back": "NAV", "go_home": "NAV", "back": "NAV", "home": "NAV", "wait": "WAIT", "terminate": "TERMINATE", "answer": "TERMINATE", "status": "TERMINATE", "finish_episode": "TERMINATE", "finish": "TERMINATE",
    "complete": "TERMINATE", "done": "TERMINATE", "stop": "TERMINATE",
}
# Names that carry the target of navigation.
NAV_TARGETS = {"navigate_back": "back", "go_back": "back", "back": "back", "navigate_home": "home", "go_home": "home", "home": "home", "navigate_recent": "recent", "press_enter": "enter", "keyboard_enter": "enter"}
# Where a part of an action may stand, in the order in which the places are asked.
NAME_KEYS = ("action", "action_type", "operation", "name")
POINT_KEYS = ("coordinate", "point", "position", "center")
TEXT_KEYS = ("text", "value", "content", "answer")
APP_KEYS = ("app", "app_name", "package_name")
WAIT_KEYS = ("seconds", "duration", "value")
STATUS_KEYS = ("goal_status", "task_status", "final_status", "status", "text", "content", "answer", "result", "outcome")
MOTION_KEYS = (("start_x", "start_y", "end_x", "end_y"), ("from_x", "from_y", "to_x", "to_y"))
MOTION_OBJECTS = (("start", "end"), ("from", "to"))
#: The name under which the whole call, not the action, may stand.
WRAPPER = "mobile_use"
#: Signs that may be cut off a broken object's end.
TRIM = 64

_BODY = re.compile(r"<tool_call>\s*(.*?)\s*</tool_call>", re.S | re.I)
_LONE_Y = re.compile(r'("x"\s*:\s*-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)(\s*[},])', re.I)


def mended(text: str) -> str | None:
    """The text of the first JSON object that a text holds, whole or closed after at most TRIM signs were cut off its end; None without one."""
    text = _LONE_Y.sub(r'\1, "y": \2\3', text.strip().strip("`").strip())
    first, last = text.find("{"), text.rfind("}")
    if first < 0:
        return None
    if found := next((x for x in (text, text[first : last + 1]) if _is_object(x)), None):
        return found
    rest = text[first:]
    for cut in range(min(TRIM, len(rest) - 1) + 1):
        part = rest[: len(rest) - cut].rstrip().rstrip(",:{[").rstrip()
        if part.count('"') % 2:
            part = part[: part.rfind('"')].rstrip().rstrip(",:{[").rstrip()
        squares, curls = part.count("[") - part.count("]"), part.count("{") - part.count("}")
        if squares < 0 or curls < 0 or "{" not in part:
            continue
        closed = _LONE_Y.sub(r'\1, "y": \2\3', part + "]" * squares + "}" * curls)
        if _is_object(closed):
            return closed
    return None


def _is_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False



def plain(text: Any) -> str:
    """A label in lower case with underscores for dashes and spaces."""
    return re.sub("[- ]", "_", str(text or "").strip().lower())


def said(value: Any) -> str | None:
    """A value as trimmed text, null if that is empty."""
    return None if value is None else str(value).strip() or None


def number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def as_object(value: Any) -> dict | None:
    """An object, or the one that a text holds."""
    if isinstance(value, str):
        try:
            value = json.loads(_LONE_Y.sub(r'\1, "y": \2\3', value))
        except ValueError:
            return None
    return value if isinstance(value, dict) else None


def first(places: Iterable[dict | None], keys: Iterable[str]) -> str | None:
    """Text of the first value that is no object, place by place."""
    return said(next((p[k] for p in places if p for k in keys if p.get(k) is not None and not isinstance(p[k], dict)), None))


def deep(root: Any, keys: list[str]) -> str | None:
    """Text of the first such value of an object, or of those in it, depth first."""
    stack = [root]
    while stack:
        here = stack.pop()
        if isinstance(here, list):
            stack += [x for x in reversed(here) if isinstance(x, dict)]
        elif isinstance(here, dict):
            if any(here.get(k) is not None and not isinstance(here[k], dict) for k in keys):
                return first([here], keys)
            stack += [x for x in reversed(here.values()) if isinstance(x, (dict, list))]
    return None


Box = tuple[int, int, int, int]


@dataclass(frozen=True)
class Frame:
    """The screen, or the part of it, that coordinates from 0 to 999 refer to; sizes may be unknown."""

    width: int | None
    height: int | None
    left: int = 0
    top: int = 0

    @classmethod
    def of(cls, width: Any, height: Any, roi: Any = None) -> Frame:
        if roi is not None:
            return cls(max(1, roi[2] - roi[0]), max(1, roi[3] - roi[1]), roi[0], roi[1])
        return cls(*(None if pd.isna(x) else max(1, int(x)) for x in (width, height)))

    @property
    def known(self) -> bool:
        return self.width is not None and self.height is not None

    def pixels(self, values: list[float], scale: bool) -> list[int]:
        """x, y, x, y, ...: moved into the frame if all lie within 0 and 999, else rounded half to even."""
        if not (scale and self.known and all(0 <= v <= 999 for v in values)):
            return [round(v) for v in values]
        sizes, starts = (self.width, self.height), (self.left, self.top)
        return [starts[i % 2] + round(min(sizes[i % 2] - 1.0, max(0.0, v * (sizes[i % 2] - 1) / 999))) for i, v in enumerate(values)]

    def around(self, x: int, y: int, pad: int = 1) -> Box:
        if not self.known:
            return x - pad, y - pad, x + pad, y + pad
        return max(self.left, x - pad), max(self.top, y - pad), min(self.left + self.width - 1, x + pad), min(self.top + self.height - 1, y + pad)


def ordered(values: list[int]) -> Box:
    (l, r), (t, b) = sorted(values[::2]), sorted(values[1::2])
    return l, t, r, b


def point_in(place: dict | None) -> list[float] | None:
    if not place:
        return None
    pairs = [[place.get("x"), place.get("y")], *(place.get(k) for k in POINT_KEYS)]
    return next(([float(v) for v in p] for p in pairs if isinstance(p, list) and len(p) == 2 and all(map(number, p))), None)


def box_in(places: Iterable[dict | None]) -> list[int] | None:
    """The first four numbers under bbox in any of the places, then under bounds."""
    found = (p.get(k) for k in ("bbox", "bounds") for p in places if p)
    return next(([round(float(v)) for v in b] for b in found if isinstance(b, list) and len(b) == 4 and all(map(number, b))), None)


def motion_in(payload: dict) -> str | None:
    """Direction from the ends of a motion; the vertical wins ties."""
    ends = [[payload.get(k) for k in keys] for keys in MOTION_KEYS]
    start, stop = (next((o for pair in MOTION_OBJECTS if (o := as_object(payload.get(pair[i])))), None) for i in (0, 1))
    if (a := point_in(start)) and (b := point_in(stop)):
        ends.append([*a, *b])
    known = next((e for e in ends if all(map(number, e))), None)
    if known is None:
        return None
    dx, dy = known[2] - known[0], known[3] - known[1]
    return ("down" if dy > 0 else "up") if abs(dy) >= abs(dx) else "right" if dx > 0 else "left"


def name_in(place: dict | None) -> str | None:
    names = (said(place.get(k)) for k in NAME_KEYS if isinstance(place.get(k), str)) if place else ()
    return next((n for n in names if n and n.lower() != WRAPPER), None)


def unwrapped(payload: dict) -> tuple[dict, bool]:
    """What holds the action, and whether its coordinates run from 0 to 999: within `arguments`, within `argument`, or with coordinates in `argument`."""
    arguments, argument = as_object(payload.get("arguments")), as_object(payload.get("argument"))
    if arguments is not None and (plain(payload.get("name")) == WRAPPER or name_in(arguments)):
        return arguments, True
    if not name_in(payload):
        return (argument, True) if name_in(argument) else (payload, False)
    return payload, bool(argument) and (isinstance(argument.get("bbox"), list) and box_in([{"bbox": argument["bbox"]}]) is not None or point_in(argument) is not None)


def action_of(payload: dict, frame: Frame, scale: bool = False) -> tuple | None:
    """(type, argument, box, app, direction) of a payload; None without a known name."""
    payload, inner = unwrapped(payload)
    name = name_in(payload)
    kind = NAMES.get(plain(name))
    if kind is None:
        return None
    scale = scale or inner
    nested = as_object(payload.get("argument"))
    word = said(payload["argument"]) if isinstance(payload.get("argument"), str) else None
    app = first([payload], APP_KEYS)
    box = ordered(frame.pixels(b, scale)) if (b := box_in([payload, nested])) else None
    if box is None and kind != "SCROLL" and (p := point_in(payload) or point_in(nested)):
        box = frame.around(*frame.pixels(p, scale))
    if kind in ("CLICK", "LONG_PRESS"):
        return kind, None, box, app, None
    if kind == "TYPE":
        return kind, first([payload], TEXT_KEYS) or word or first([nested], TEXT_KEYS), box, app, None
    if kind == "SCROLL":
        return kind, None, box, app, next((plain(d) for p in (payload, nested) if (d := first([p], ["direction"]))), None) or motion_in(payload)
    if kind == "WAIT":
        return kind, first([payload], WAIT_KEYS) or word or first([nested], WAIT_KEYS), None, app, None
    if kind == "TERMINATE":
        return kind, deep(payload, list(STATUS_KEYS)) or word, None, app, None
    if plain(name) == "system_button":
        target = plain(first([payload], ("button", "argument", "target", "name"))) or None
    else:
        target = NAV_TARGETS.get(plain(name)) or first([payload], (*APP_KEYS, "target")) or word
    opens = plain(name) in ("open", "open_app", "launch")
    return kind, target, None, target if opens or target not in ("back", "home", "enter") else None, None


def is_complete(action: tuple | None) -> bool:
    """Whether an action has what its type needs."""
    if action is None:
        return False
    kind, argument, box, app, direction = action
    needs = {"CLICK": box, "LONG_PRESS": box, "TYPE": argument, "SCROLL": direction, "NAV": argument or app, "WAIT": True, "TERMINATE": True}
    return bool(needs.get(kind))


_BRACKET = re.compile(r"(CLICK|TYPE|SCROLL|NAV|TERMINATE|WAIT|LONG_PRESS)(?:\[(.*)\])?$", re.I)
_NUMBER = r"(-?\d+(?:\.\d+)?)"
_ACTION_AT = re.compile(r'"(?:action|action_type)"\s*:\s*"([A-Za-z_]+)"', re.I)
_BOX_AT = re.compile(r'"bbox"\s*:\s*\[\s*' + r"\s*,\s*".join([_NUMBER] * 4) + r"\s*\]", re.I)
_POINT_AT = re.compile(r'"x"\s*:\s*' + _NUMBER + r'\s*,\s*(?:"y"\s*:\s*)?' + _NUMBER, re.I)
_DIRECTION_AT = re.compile(r'"direction"\s*:\s*"([A-Za-z_]+)"', re.I)


def from_bracket_call(text: str) -> tuple | None:
    """The action of NAME or NAME[payload]: four numbers are a box, the payload of SCROLL a direction, any other without a comma the argument."""
    m = _BRACKET.match(text.strip())
    if not m:
        return None
    kind, payload = m[1].upper(), (m[2] or "").strip()
    parts = [x.strip() for x in payload.split(",")]
    if len(parts) == 4 and all(re.fullmatch(_NUMBER, x) for x in parts):
        return kind, None, ordered([int(float(x)) for x in parts]), None, None
    single = payload if payload and len(parts) == 1 else None
    return (kind, None, None, None, single and single.lower()) if kind == "SCROLL" else (kind, single, None, None, None)


def from_fragments(text: str, frame: Frame) -> tuple | None:
    """The click, long press or scroll that the pieces of an unreadable object still tell, coordinates from 0 to 999."""
    m = _ACTION_AT.search(text)
    kind = NAMES.get(plain(m[1])) if m else None
    if kind == "SCROLL":
        d = _DIRECTION_AT.search(text)
        return (kind, None, None, None, plain(d[1])) if d else None
    if kind not in ("CLICK", "LONG_PRESS"):
        return None
    if b := _BOX_AT.search(text):
        return kind, None, ordered(frame.pixels([round(float(x)) for x in b.groups()], True)), None, None
    p = _POINT_AT.search(text)
    return (kind, None, frame.around(*frame.pixels([float(x) for x in p.groups()], True)), None, None) if p else None


def candidates(text: str, frame: Frame, scale: bool) -> Iterator[tuple | None]:
    """The actions that an output may mean, in the order in which they are tried: its calls, each once, the whole text, a call in brackets, fragments."""
    seen: set[str] = set()
    for found, scaled in [*((mended(m[1]), True) for m in _BODY.finditer(text)), (mended(text), scale)]:
        payload = json.loads(found) if found else None
        if payload and (key := json.dumps(payload, sort_keys=True)) not in seen:
            seen.add(key)
            yield action_of(payload, frame, scaled)
    yield from_bracket_call(text)
    yield from_fragments(text, frame)


def from_output(text: str, frame: Frame, scale: bool = False) -> tuple | None:
    """The first complete action of an output."""
    return next((a for a in candidates(text, frame, scale) if is_complete(a)), None)


def _struct(action: tuple | None) -> dict | None:
    if action is None:
        return None
    kind, argument, box, app, direction = action
    return {"action_type": kind, "argument": argument, "box": box and dict(zip("ltrb", box)), "app": app, "direction": direction}


def _frames(widths: pd.Series, heights: pd.Series) -> Iterator[Frame]:
    return (Frame.of(w, h) for w, h in zip(widths, heights))


@F.pandas_udf(ACTION)
def output_action(outputs: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.DataFrame:
    """The action of each output, its coordinates in a screen of the given size."""
    return _frame_of([_struct(from_output(t, f)) if isinstance(t, str) else None for t, f in zip(outputs, _frames(widths, heights))])


@F.pandas_udf(ACTION)
def payload_action(payloads: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.DataFrame:
    """The action of each payload, JSON or JSON within a JSON string, whether complete or not."""

    def of(text: Any, frame: Frame) -> dict | None:
        try:
            payload = as_object(json.loads(text)) if isinstance(text, str) else None
        except ValueError:
            return None
        return None if payload is None else _struct(action_of(payload, frame))

    return _frame_of([of(t, f) for t, f in zip(payloads, _frames(widths, heights))])


def _frame_of(actions: list[dict | None]) -> pd.DataFrame:
    """A struct column of an Arrow batch; without an action all its fields are null."""
    names = ("action_type", "argument", "box", "app", "direction")
    return pd.DataFrame({n: pd.Series([None if a is None else a[n] for a in actions], dtype=object) for n in names})


@F.pandas_udf(StringType())
def first_nested(payloads: pd.Series, keys: pd.Series) -> pd.Series:
    """The first plain value of the keys (joined by commas) in a JSON object: its own first, then those of the objects in it, depth first."""

    def of(text: str | None, keys: str) -> str | None:
        try:
            return deep(json.loads(text), keys.split(",")) if isinstance(text, str) else None
        except ValueError:
            return None

    return pd.Series([of(t, k) for t, k in zip(payloads, keys)], dtype=object)
