"""Texts that lost their end: cut by a limit of tokens or characters, or on their way to the table.

Evidence, in this order: something is still open for the stack automaton; the count of
generated tokens exceeds what the text can hold, by a model of token counts fitted on
all complete rows; the text ends openly (no terminator) at the permitted number of tokens, or,
where tokens are unknown, at the longest length of its source, or in a context in which
texts of the table do not end. Each source has a baseline, the share of its texts that end
with a terminator or closing sign: where nearly all do, a missing one is judged by its
context even if the tokens tell nothing.

Defined results: null and blank texts are no cases (nothing was begun); null, zero or
negative token counts count as unknown; a null or unknown config has no token limit; null
sources form a source of their own. Repeated rows are judged each by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.cluster import small, spread
from stepweave.llm.completeness import CLOSERS, TERMINATORS
from stepweave.llm.evidence import measured, settled, shares, token_model

#: Share of tokens, and tokens, that a text may lack: with a closed ending, and with an open one, which is evidence itself.
#: From this share and number of lacking tokens on the context of an open ending decides, as it does at the permitted number of tokens.
SUSPECT = (0.06, 4)
#: Baseline of a source, over at least so many texts, from which on a missing terminator is evidence.
STEADY, STEADY_ROWS = 0.98, 100
LACK = {"closed": (0.3, 8), "open": (0.12, 3), "broken": (0.3, 8)}


_ENDED = "[" + re.escape(TERMINATORS + CLOSERS + ">}])") + "]$"


def lost(share: float, tokens: float, how: str, at_length: bool = False) -> bool:
    """Whether the model wrote more tokens than the text holds; an open text of the longest length needs half the excess."""
    most, least = LACK[how]
    return share > (most / 2 if at_length and how == "open" else most) and share * tokens / (1 + share) >= least


def suspect(share: float, tokens: float, limit: float | None) -> bool:
    """Whether an open ending needs its context to be called complete."""
    return limit is not None and tokens >= limit or share > SUSPECT[0] and share * tokens / (1 + share) >= SUSPECT[1]


def cut_reason(how: str | None, share: float | None, tokens: float, limit: float | None, at_length: bool, steady: bool = False) -> tuple[str | None, bool]:
    """('structure', 'tokens', 'limit' or 'context' for a truncated text, None for a complete one; whether it is complete too if its context is that of an end). share: of tokens that it lacks, None if unknown."""
    if how is None:
        return None, False
    if how == "broken":
        return "structure", False
    if share is not None and lost(share, tokens, how, at_length):
        return "tokens", False
    if how == "closed":
        return None, False
    if share is not None:
        doubt = "limit" if suspect(share, tokens, limit) else "context" if steady else None
        return doubt, doubt is not None
    return ("limit", False) if at_length else ("context", True)


def truncated_outputs(results: DataFrame, configs: DataFrame) -> DataFrame:
    """Rows of step_results with result_id, source, cut (the reason, or null) for every row with a text."""
    texts = spread(results.where("raw_output is not null").select("result_id", "source", "raw_output", "generated_tokens", "config_id"))
    limits = configs.groupBy("config_id").agg(F.max("max_new_tokens").alias("max_new_tokens"))
    lengths = texts.groupBy("source", F.length("raw_output").alias("chars"), F.octet_length("raw_output").alias("bytes")).agg(F.count("*").alias("n"), F.count_if(F.rtrim("raw_output").rlike(_ENDED)).alias("ended"))
    # the longest length of a source, in characters or in bytes (a character may be lost with the last ones), if at least three rows have it
    longest = small(
        lengths.groupBy("source").agg(F.max("chars").alias("most_chars"), F.max_by("n", F.struct("chars", "n")).alias("n_chars"), F.max("bytes").alias("most_bytes"), F.max_by("n", F.struct("bytes", "n")).alias("n_bytes"), (F.sum("ended") / F.sum("n")).alias("ended"), F.sum("n").alias("n"))
        .select(F.col("source").alias("of"), F.when(F.col("n_chars") >= 3, F.col("most_chars")).alias("most_chars"), F.when(F.col("n_bytes") >= 3, F.col("most_bytes")).alias("most_bytes"), ((F.col("ended") >= STEADY) & (F.col("n") >= STEADY_ROWS)).alias("steady"))
    )
    rows = texts.join(small(limits), "config_id", "left").join(longest, F.col("source").eqNullSafe(F.col("of")), "left")
    at_length = F.coalesce(F.length("raw_output") == F.col("most_chars"), F.lit(False)) | F.coalesce(F.octet_length("raw_output") > F.col("most_bytes") - 4, F.lit(False))
    rows = rows.select("result_id", "source", F.col("raw_output").alias("text"), F.col("generated_tokens").alias("tokens"), F.col("max_new_tokens").cast("double").alias("most"), at_length.alias("at_length"), F.coalesce("steady", F.lit(False)).alias("steady"), F.lit(True).alias("counts"))
    read = measured(rows, "result_id bigint, source string, most double, at_length boolean, steady boolean")
    weights = token_model(read).weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            most = [None if pd.isna(x) else x for x in b.most]
            found = [cut_reason(*x) for x in zip(b.how, shares(b, weights), b.tokens, most, b.at_length, b.steady)]
            yield b[["result_id", "source", "last"]].assign(cut=pd.Series([x for x, _ in found], dtype=object, index=b.index), unsure=[x for _, x in found])

    judged = read.where("segment is null").mapInPandas(run, "result_id bigint, source string, last string, cut string, unsure boolean")
    return settled(read, judged, "cut", None)


def rates(judged: DataFrame) -> DataFrame:
    """Per source: rows with a text, truncated ones, and their share."""
    return judged.groupBy("source").agg(F.count("*").alias("n_outputs"), F.count("cut").alias("n_truncated"), (F.count("cut") / F.count("*")).alias("truncated_share"))
