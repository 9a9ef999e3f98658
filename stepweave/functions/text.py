"""Column functions on text and labels; no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical partitions and modes, with their aliases.
PARTITIONS = {"in_distribution": "in_distribution", "idd": "in_distribution", "app_unseen": "app_unseen", "task_unseen": "task_unseen", "category_unseen": "category_unseen"}
MODES = {"high_level": "high_level", "hl": "high_level", "low_level": "low_level", "ll": "low_level"}
SPLITS = {"train": "train", "training": "train", "val": "validation", "valid": "validation", "validation": "validation", "dev": "validation", "test": "test", "testing": "test"}


def canonical(label: Column, names: dict[str, str]) -> Column:
    """Canonical form of a label by case, spaces, signs and aliases; null for an unknown one."""
    key = F.regexp_replace(F.lower(F.regexp_replace(label, r"^[\s\p{Cf}]+|[\s\p{Cf}]+$", "")), r"[\s_\-]+", "_")
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key]


def normalize(text: Column) -> Column:
    """White space of any kind collapsed, trimmed, lower case; null for empty."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))), F.lit(""))


def clean(text: Column, most: int = 160) -> Column:
    """White space collapsed, cut to `most` characters, without a trailing space; null for empty."""
    return F.nullif(F.rtrim(F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, most)), F.lit(""))


def underscored(text: Column) -> Column:
    """Lower case with underscores for dashes and spaces; empty for null."""
    return F.translate(F.lower(F.trim(F.coalesce(text, F.lit("")))), "- ", "__")


def tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 in order; an empty array for null."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), F.array().cast("array<string>")))


def overlap_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets: 1 if both are empty, 0 if one is."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * common / (F.size(a) + F.size(b)))


def view_id_leaf(view_id: Column, most: int = 64) -> Column:
    """The part after the last slash, then after the last colon, without the prefix gbs., cut; null for empty."""
    leaf = F.regexp_replace(F.regexp_extract(view_id, r"([^/:]*)$", 1), r"^gbs\.", "")
    return F.nullif(F.rtrim(F.substring(leaf, 1, most)), F.lit(""))


def widget_leaf(class_name: Column) -> Column:
    """Last dotted part of a class name in lower case, $ as underscore."""
    return F.translate(F.regexp_extract(F.lower(class_name), r"([^.]*)$", 1), "$", "_")


def printable_runs(raw: Column) -> Column:
    """Distinct runs of at least three printable ASCII signs with a letter, of binary data."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.decode(raw, "ISO-8859-1"), F.lit("([ -~]{3,})"), 1), lambda x: x.rlike("[A-Za-z]")))


# What marks a fragment as an address.
_URL = r"(?i)https?://|www\.|googleadservices\.com|doubleclick\.net|utm_|gclid(?:=|%3d)|adurl(?:=|%3d)|client=ca-app-pub"


def is_noise(fragment: Column) -> Column:
    """Whether a fragment says nothing: under three signs, no letter, an address, over 64 signs with four percent escapes in a row, over 120 with a query string."""
    x = F.trim(F.regexp_replace(fragment, r"(?U)\s+", " "))
    count = lambda sign: F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))
    return (F.length(x) < 3) | ~x.rlike(r"\p{L}") | x.rlike(_URL) | ((F.length(x) > 64) & x.rlike("(?:%[0-9A-Fa-f]{2}){4,}")) | ((F.length(x) > 120) & (count("=") >= 2) & (count("&") >= 2))


def bounded_fragments(text: Column, most: int = 64, budget: int = 4096, each: int = 160) -> Column:
    """Fragments between bars, noise dropped, cut to `each`; stops at `most` fragments or at the first beyond the budget, then distinct."""
    empty = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("size"), F.lit(False).alias("full"))

    def add(state: Column, part: Column) -> Column:
        size = state["size"] + F.length(part) + F.when(F.size(state["kept"]) > 0, 3).otherwise(0)
        full = state["full"] | (F.size(state["kept"]) >= most) | (size > budget)
        return F.struct(F.when(full, state["kept"]).otherwise(F.concat(state["kept"], F.array(part))).alias("kept"), F.when(full, state["size"]).otherwise(size).alias("size"), full.alias("full"))

    parts = F.filter(F.split(text, r"\|"), lambda x: ~is_noise(x))
    good = F.transform(parts, lambda x: F.rtrim(F.substring(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), 1, each)))
    return F.array_join(F.array_distinct(F.aggregate(good, empty, add, lambda s: s["kept"])), " | ")


def percent(share: Column) -> Column:
    return F.when(share.isNull(), "N/A").otherwise(F.format_string("%.2f%%", share * 100))


def duration(seconds: Column) -> Column:
    """Seconds, rounded half to even, as 45s, 2m05s or 5h32m33s; n/a for null and negative ones."""
    s = F.bround(seconds).cast("bigint")
    hours, minutes = F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint")
    text = F.when(hours > 0, F.format_string("%dh%02dm%02ds", hours, minutes, s % 60)).when(minutes > 0, F.format_string("%dm%02ds", minutes, s % 60)).otherwise(F.format_string("%ds", s))
    return F.when(seconds.isNull() | (seconds < 0), "n/a").otherwise(text)


def sorted_pairs(entries: Column) -> Column:
    """k=v of a map, by key, joined by '; '."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")


def speed_text(baseline: Column, other: Column) -> Column:
    """How many times as fast as 1.23x; a dash where that can't be told."""
    return F.when(baseline.isNull() | other.isNull() | (other == 0), "—").otherwise(F.format_string("%.2fx", baseline / other))


def human_bytes(n: Column) -> Column:
    """A number of bytes as 512 B, 1.50 KiB, ... up to TiB."""
    out = F.format_string("%.2f TiB", n / float(1 << 40))
    for unit, power in (("GiB", 30), ("MiB", 20), ("KiB", 10)):
        out = F.when(n < float(1 << (power + 10)), F.format_string(f"%.2f {unit}", n / float(1 << power))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("bigint"))).otherwise(out)


def version_numbers(version: Column) -> Column:
    """The numbers of a version's parts up to the first part without a digit, for an order by them: 4.10.2-dev gives [4, 10, 2]."""
    digits = F.transform(F.split(version, r"[.-]"), lambda x: F.regexp_replace(x, r"\D", ""))
    stop = F.array_position(digits, "")
    return F.transform(F.when(stop > 0, F.slice(digits, 1, F.greatest(F.lit(0), stop - 1).cast("int"))).otherwise(digits), lambda x: x.cast("bigint"))


def bare_label(text: Column) -> Column:
    """A label without back-ticks, list sign and a pair of quotes around it; empty for null."""
    x = F.trim(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "^`+|`+$", ""))
    x = F.trim(F.regexp_replace(x, r"^[-*] ", ""))
    return F.trim(F.regexp_replace(x, r"(?s)^([\"'])(.*)\1$", "$2"))


def chosen_label(text: Column, valid: Column) -> Column:
    """The valid label (of an array) that an answer names: under a key of its JSON object, as the whole text, or in its first line; null without one."""
    stripped = bare_label(text)
    v = F.try_parse_json(F.nullif(F.regexp_extract(stripped, r"(?s)(\{.*\})", 1), F.lit("")))
    named = [bare_label(F.try_variant_get(v, f"$.{k}", "string")) for k in ("label", "selected_label", "action_label", "choice")]
    line = bare_label(F.regexp_extract(stripped, r"^([^\r\n]*)", 1))
    return F.coalesce(*[F.when(F.array_contains(valid, x), x) for x in (*named, stripped, line)])


def node_name(text: Column, description: Column, view_id: Column) -> Column:
    """The first two different ones of a node's text, description and id, joined by a bar; null without any."""
    parts = F.array_distinct(F.array_compact(F.array(clean(text), clean(description), view_id_leaf(view_id))))
    return F.nullif(F.rtrim(F.substring(F.array_join(F.slice(parts, 1, 2), " | "), 1, 160)), F.lit(""))


def node_role(class_name: Column, flags: dict[str, Column]) -> Column:
    """A node's widget and the names of its set flags; null without any."""
    return F.nullif(F.concat_ws(" ", F.nullif(widget_leaf(clean(class_name)), F.lit("")), *[F.when(F.coalesce(c, F.lit(False)), name) for name, c in flags.items()]), F.lit(""))


def aligned_descriptions(given: Column, heuristic: Column, n: Column) -> Column:
    """struct<texts, source>: for each of n screens the given text, or where that is empty the heuristic one, or an empty one, and where they come from."""
    at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1))).otherwise(F.array().cast("array<int>"))
    own = lambda i: F.nullif(F.get(given, i), F.lit(""))
    texts = F.transform(at, lambda i: F.coalesce(own(i), F.get(heuristic, i), F.lit("")))
    filled = F.exists(at, lambda i: own(i).isNull())
    none = F.coalesce(F.size(given), F.lit(0)) <= 0
    source = F.when(none, "heuristic_accessibility_serialization").when(filled, "provided_with_heuristic_backfill").otherwise("provided")
    return F.struct(texts.alias("texts"), source.alias("source"))


def progress_line(label: Column, done: Column, total: Column, accuracy: Column, milliseconds: Column) -> Column:
    """One line on the state of a run: label, count, share, accuracy, latency of a step."""
    return F.concat_ws(" ", F.concat(F.lit("["), F.coalesce(label, F.lit("all")), F.lit("]")), F.format_string("%d/%d", done.cast("bigint"), total.cast("bigint")), F.concat(F.lit("("), percent(F.try_divide(done, total)), F.lit(")")), F.concat(F.lit("accuracy="), percent(accuracy)), F.concat(F.lit("step_ms="), F.when(milliseconds.isNull(), "n/a").otherwise(F.format_string("%.1f", milliseconds))))
