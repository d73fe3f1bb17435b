"""Vaults: which value got which placeholder in a scope (a request, a conversation, a document).

A scope may be any size: numbering never sorts one (scope, type) group in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from velaria.operators.policy import hides

BLOCK_TEXTS = 1024  # texts of a scope numbered by one task


def vault(values: DataFrame, scope="scope_id", policy=None, reserved: DataFrame | None = None):
    """vault(scope, type, value, n, token) from a value table (scope, text_ord, start, type, value).

    The same exact value of a type has one token; n follows first appearance.  Values are reduced
    to their first appearance before any ordering (partial aggregation absorbs repeats), then
    numbered inside blocks of texts, and each block starts after the values of the blocks before
    it, so a scope that holds most of the table is still numbered by many tasks.
    `reserved(scope, token)` tokens are skipped.
    """
    first = (
        values.filter(hides(F.col("type"), policy))
        .groupBy(scope, "type", "value")
        .agg(F.min(F.struct("text_ord", "start")).alias("first"))
        .withColumn("_block", F.floor(F.col("first.text_ord") / BLOCK_TEXTS).cast("bigint"))
    )
    in_block = Window.partitionBy(scope, "type", "_block").orderBy("first")
    blocks = first.groupBy(scope, "type", "_block").agg(F.count("*").alias("_size"))
    before = (
        Window.partitionBy(scope, "type")
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = blocks.select(
        scope, "type", "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_from")
    )
    numbered = first.withColumn("_rank", F.row_number().over(in_block)).join(
        starts, [scope, "type", "_block"]
    )
    numbered = numbered.withColumn("n", (F.col("_from") + F.col("_rank")).cast("bigint"))
    if reserved is not None:
        numbered = _skip_reserved(numbered, reserved, scope)
    return numbered.select(
        scope, "type", "value", "n", F.concat_ws("_", "type", F.col("n").cast("string")).alias("token")
    )


def _skip_reserved(numbered: DataFrame, reserved: DataFrame, scope: str) -> DataFrame:
    """n becomes the n-th number that is not reserved for its type in its scope.

    The reserved numbers of one (scope, type) are those written in a scope's reasoning texts;
    with r of them the n-th free number is n + k for the least k with k reserved numbers <= n + k.
    Sorted, the j-th reserved number R is passed exactly when R - j < n, so k is a count.
    """
    taken = (
        reserved.select(
            scope,
            F.regexp_extract("token", r"\A(.+)_[0-9]+\z", 1).alias("type"),
            F.regexp_extract("token", r"_([0-9]{1,18})\z", 1).try_cast("bigint").alias("r"),
            "token",
        )
        # A token is reserved as it is written: TYPE_07 is not TYPE_7.
        .filter(F.col("token") == F.concat_ws("_", "type", F.col("r").cast("string")))
        .filter("r > 0")
        .select(scope, "type", "r")
        .distinct()
    )
    in_order = Window.partitionBy(scope, "type").orderBy("r")
    passed = taken.withColumn("bar", F.col("r") - F.row_number().over(in_order))
    # Merge both lists by place and count the bars before each number: one sort, no pairs.
    marks = numbered.select(scope, "type", F.col("n").alias("at"), F.lit(0).alias("bar"), F.lit(1).alias("is_n")).unionByName(
        passed.select(scope, "type", (F.col("bar") + 1).alias("at"), F.lit(1).alias("bar"), F.lit(0).alias("is_n"))
    )
    upto = (
        Window.partitionBy(scope, "type")
        .orderBy("at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    shifts = (
        marks.withColumn("skip", F.sum("bar").over(upto))
        .filter("is_n = 1")
        .select(scope, "type", F.col("at").alias("n"), "skip")
    )
    return numbered.join(shifts, [scope, "type", "n"]).withColumn("n", F.col("n") + F.col("skip"))


def type_counts(vault_table: DataFrame, scope="scope_id") -> DataFrame:
    """Distinct hidden values per scope and type: counts only."""
    return vault_table.groupBy(scope, "type").agg(F.count("*").alias("values"))


def hidden_types(values: DataFrame, scope="scope_id", policy=None) -> DataFrame:
    """Hidden types of each scope, in order of first hiding (at most one entry per type)."""
    first = (
        values.filter(hides(F.col("type"), policy))
        .groupBy(scope, "type")
        .agg(F.min(F.struct("text_ord", "start")).alias("first"))
    )
    return first.groupBy(scope).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("first", "type"))), lambda x: x["type"]
        ).alias("hidden")
    )
