"""Queries of problem 6."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.cluster import table
from stepweave.operators.shred import action_objects, ui_nodes, ui_windows


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    trees = ui_nodes(table(spark, root, "android_records")).select(F.lit("android_records").alias("record_table"), "*")
    return trees.unionByName(action_objects(table(spark, root, "steps")).select(F.lit("steps").alias("record_table"), "*"))


def p6_nodes(spark: SparkSession, root: str) -> DataFrame:
    return ui_nodes(table(spark, root, "android_records"), leaves=True)


def p6_actions(spark: SparkSession, root: str) -> DataFrame:
    return action_objects(table(spark, root, "steps"), leaves=True)


def p6_windows(spark: SparkSession, root: str) -> DataFrame:
    return ui_windows(table(spark, root, "android_records"))


QUERIES = {"p6_found": p6_found, "p6_nodes": p6_nodes, "p6_actions": p6_actions, "p6_windows": p6_windows}
