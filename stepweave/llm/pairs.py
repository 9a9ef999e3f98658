"""Defective prompt and response pairs.

Each pair gets at most one of: 'empty', 'truncated', 'echo', 'refusal', 'other_language',
tried in this order ('echo' before openly ended text, which a copied prompt often is).
Copies are found by compressing the response with its prompt as a zstandard dictionary: a
copy adds next to nothing to its prompt. An exact check of the covered words follows.

Defined results: a null or blank response, or one without a letter or digit within quotes,
tags or braces, is 'empty'; with a null prompt no echo or other language can be found;
goals of undetermined language give no 'other_language'. Rows count by their own ids.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.cluster import small, spread
from stepweave.llm.completeness import TerminalContexts, TokenModel, ending, words
from stepweave.llm.evidence import measured, settled, shares, token_model
from stepweave.llm.language import language
from stepweave.llm.refusals import declines
from stepweave.llm.truncation import lost, suspect

#: A response is taken for a copy if, compressed with its prompt, it keeps no more than this share of its bytes and FRAME bytes.
COPY_SHARE, FRAME = 0.6, 24
#: Share of the response that must come from the prompt, and of the goal or instruction that must be in it;
#: or, of a goal that is in it as a whole, its share of the response (the rest is an instruction that the prompt withheld).
COVERED, CONTAINED, MOSTLY = 0.9, 0.85, 0.55

_TAGS = re.compile(r"</?[A-Za-z_][\w.-]*(?:\s[^<>]*)?>")
_TOOL = re.compile(r"<tool_call>.*?(?:</tool_call>|$)", re.S)
_CALL = re.compile(r"(?m)^\s*(?:[A-Z][A-Z_]{2,}\([^()\n]*\)|Action:\s*\S.*)\s*$")
_OBJECT = re.compile(r"[{\[][^{}\[\]]*[:,][^{}\[\]]*[}\]]")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|「[^」\n]*」|『[^』\n]*』|‘[^’\n]*’")
_LABELLED = re.compile(r"(?im)^\s*(?:task goal|goal)\s*[:=]\s*(.*(?:\n(?!\s*(?:instruction|actions? already|metadata|history|support)\b).*)*)")
_INSTRUCTION = re.compile(r"(?im)^\s*instruction for the current step\s*:\s*(.*)$|\bstep=(.*)$")
_NAMES = re.compile(r"\b[A-ZÀ-Þ][a-zß-ÿ]+(?:[ -][A-ZÀ-Þ][a-zß-ÿ]+)+\b")


_SPOKEN = re.compile(r"[^\W_]")
_INVISIBLE = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x20000) if unicodedata.category(chr(c)) == "Cf") + "]")


def _has_action(text: str) -> bool:
    return bool(_TOOL.search(text) and re.search(r'"\w+"\s*:', text)) or bool(_CALL.search(text))


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    return not _SPOKEN.search(_TAGS.sub("", text))


def _plain(text: str) -> list[str]:
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return [w for w in words(text.casefold()) if w[0].isalnum()]


def copied_share(response: str, prompt: str) -> float:
    """Share of the response's bytes that remain when the prompt is the compressor's dictionary."""
    raw = response.encode("utf-8", "replace")
    book = zstandard.ZstdCompressionDict(prompt.encode("utf-8", "replace").ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = len(zstandard.ZstdCompressor(level=3, dict_data=book, write_checksum=False, write_content_size=False).compress(raw))
    return max(0, size - FRAME) / max(1, len(raw))


def _covered(part: list[str], whole: list[str], run: int) -> int:
    """Words of part that stand in runs of at least run words in whole too."""
    run = max(1, min(run, len(part)))
    grams = {tuple(whole[i : i + run]) for i in range(len(whole) - run + 1)}
    hit = [False] * len(part)
    for i in range(len(part) - run + 1):
        if tuple(part[i : i + run]) in grams:
            hit[i : i + run] = [True] * run
    return sum(hit)


def prompt_parts(prompt: str, goal: str | None) -> list[tuple[list[str], bool]]:
    """Words of the goals and instructions of a prompt, each with whether it is a goal."""
    parts = [(goal, True)] + [(m.group(1), True) for m in _LABELLED.finditer(prompt)]
    parts += [(m.group(1) or m.group(2), False) for m in _INSTRUCTION.finditer(prompt)]
    return [(p, is_goal) for text, is_goal in parts if text and len(p := _plain(text)) > 1]


def is_echo(response: str, prompt: str, goal: str | None) -> bool:
    said, asked = _plain(_TAGS.sub(" ", response)), _plain(prompt + "\n" + (goal or ""))
    if not said or not asked or _has_action(response):
        return False
    # less than MOSTLY of its words from the prompt is no copy, whatever the compressor says
    there = set(asked)
    if sum(w in there for w in said) < MOSTLY * len(said) - 1 or copied_share(" ".join(said), " ".join(asked)) > COPY_SHARE:
        return False
    copied = _covered(said, asked, 3) >= COVERED * len(said) - 1
    for part, is_goal in prompt_parts(prompt, goal):
        there = _covered(part, said, 3)
        if copied and there >= CONTAINED * len(part) or is_goal and there == len(part) >= MOSTLY * len(said):
            return True
    return False


def prose(text: str) -> str:
    """The running text of a response: no calls, objects, tags, quoted text."""
    return _QUOTED.sub(" ", _TAGS.sub(" ", _OBJECT.sub(" ", _CALL.sub(" ", _TOOL.sub(" ", text)))))


def is_refusal(text: str) -> bool:
    return not _has_action(text) and declines(prose(text))


def is_other_language(response: str, prompt: str, goal: str | None) -> bool:
    goals = [goal] if goal else [m.group(1) for m in _LABELLED.finditer(prompt)][:1] or [prompt]
    asked = language(_NAMES.sub(" ", goals[0]))
    said = language(_NAMES.sub(" ", prose(response)))
    return asked is not None and said is not None and asked != said


def other_defect(prompt: str | None, goal: str | None, response: str | None, how: str | None) -> str | None:
    """The defect that no model is asked for, of a response with this ending: 'empty', 'echo', 'refusal', 'other_language' or None."""
    if is_empty(response):
        return "empty"
    if prompt and is_echo(response, prompt, goal):
        return "echo"
    if how == "broken":
        return None
    if is_refusal(response):
        return "refusal"
    return "other_language" if prompt and is_other_language(response, prompt, goal) else None


def judged(other: str | None, how: str | None, share: float | None, tokens: float, limit: float | None) -> tuple[str | None, bool]:
    """(the defect, whether it is 'truncated' instead unless the end is a complete one); share: of tokens that the response lacks, None if unknown."""
    if other == "empty":
        return other, False
    if share is not None and lost(share, tokens, how):
        return "truncated", False
    if other == "echo":
        return other, False
    if how == "broken":
        return "truncated", False
    return other, how == "open" and (suspect(share, tokens, limit) if share is not None else other != "refusal")


def defect(prompt: str | None, goal: str | None, response: str | None, tokens: float | None, limit: float | None, tokens_model: TokenModel, contexts: TerminalContexts) -> str | None:
    """The defect of one pair, or None."""
    how = None if is_empty(response) else ending(response)
    known = tokens is not None and tokens > 0 and tokens_model.weights is not None and how is not None
    found, unsure = judged(other_defect(prompt, goal, response, how), how, tokens_model.excess(response, tokens) if known else None, tokens, limit)
    return "truncated" if unsure and not contexts.complete(response) else found


def broken_pairs(training: DataFrame, results: DataFrame, examples: DataFrame, configs: DataFrame) -> DataFrame:
    """record_table, record_id, defect of every defective pair of training_examples and step_results."""
    limits = configs.groupBy("config_id").agg(F.max("max_new_tokens").alias("max_new_tokens"))
    # the models count an answer once, with however many examples it is joined
    asked = examples.where("example_id is not null").select("example_id", "prompt_text", "goal", (F.row_number().over(Window.partitionBy("example_id").orderBy("example_id")) == 1).alias("first"))
    # no model was asked where full_model_calls is 0
    answers = results.where("full_model_calls is null or full_model_calls <> 0").select("result_id", "example_id", "config_id", "raw_output", "generated_tokens")
    mine = training.select(F.lit("training_examples").alias("record_table"), F.col("example_id").alias("record_id"), "prompt_text", F.lit(None).cast("string").alias("goal"), F.col("response_text").alias("text"), F.lit(None).cast("bigint").alias("tokens"), F.lit(None).cast("double").alias("most"), F.lit(True).alias("counts"))
    theirs = (
        answers.join(asked, "example_id", "left").join(small(limits), "config_id", "left")
        .select(F.lit("step_results").alias("record_table"), F.col("result_id").alias("record_id"), "prompt_text", "goal", F.col("raw_output").alias("text"), F.col("generated_tokens").cast("bigint").alias("tokens"), F.col("max_new_tokens").cast("double").alias("most"), F.coalesce("first", F.lit(True)).alias("counts"))
    )

    def others(b: pd.DataFrame, hows: list) -> dict:
        none = lambda column: [None if pd.isna(x) else x for x in column]
        return {"other": pd.Series([other_defect(*x) for x in zip(none(b.prompt_text), none(b.goal), none(b.text), hows)], dtype=object, index=b.index)}

    kept = "record_table string, record_id bigint, most double, other string"
    parts = [measured(spread(mine), kept, others), measured(theirs, kept, others)]
    texts = parts[0].unionByName(parts[1])
    weights = token_model(texts).weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            most = [None if pd.isna(x) else x for x in b.most]
            found = [judged(*x) for x in zip(b.other, b.how, shares(b, weights), b.tokens, most)]
            yield b[["record_table", "record_id", "last"]].assign(defect=pd.Series([x for x, _ in found], dtype=object, index=b.index), unsure=[x for _, x in found])

    rows = texts.where("segment is null").mapInPandas(run, "record_table string, record_id bigint, last string, defect string, unsure boolean").where("unsure or defect is not null")
    return settled(texts, rows, "defect", "truncated").where("defect is not null")
