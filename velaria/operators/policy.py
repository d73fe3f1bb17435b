"""Which types are hidden.  A type a policy does not name is hidden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from velaria.functions import tables

HIDE, ALLOW = "mask", "allow"
DEFAULT_POLICY = {entity: ALLOW for entity in tables.ALLOWED_BY_DEFAULT}


def hides(entity: Column, policy: dict[str, str] | None = None) -> Column:
    """True where the policy hides the type: a literal map lookup, no join."""
    actions = DEFAULT_POLICY if policy is None else policy
    allowed = [name for name, action in actions.items() if action == ALLOW]
    return ~entity.isin(allowed) if allowed else F.lit(True)


def policy_table(spark: SparkSession, version: str, policy: dict[str, str]) -> DataFrame:
    """policy(version, type, action): at most one row per entity type."""
    rows = [(version, entity, action) for entity, action in policy.items()]
    return spark.createDataFrame(rows, "version string, type string, action string")


def apply_policy(spans: DataFrame, policy: DataFrame) -> DataFrame:
    """`spans` plus `action`.  A policy has one row per type (21); Spark broadcasts it by its size."""
    actions = policy.select("type", "action")
    return spans.join(actions, "type", "left").withColumn(
        "action", F.coalesce("action", F.lit(HIDE))
    )


def type_dimension(spark: SparkSession) -> DataFrame:
    """entity_types(type, ord), in tie-breaking order."""
    return spark.createDataFrame(
        [(name, i) for i, name in enumerate(tables.ENTITY_TYPES, 1)], "type string, ord int"
    )
