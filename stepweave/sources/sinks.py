"""Sinks: JSON lines of one struct a row, and reports with a version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Each row as one JSON object a line; Spark's committer makes the folder appear whole or not at all."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def chat_rows(training: DataFrame) -> DataFrame:
    """example_id and the chat message list of each prompt and response as JSON; null responses give no row."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))
    return training.where("prompt_text is not null and response_text is not null").select("example_id", F.to_json(F.struct(F.array(message("user", "prompt_text"), message("assistant", "response_text")).alias("messages"))).alias("line"))
