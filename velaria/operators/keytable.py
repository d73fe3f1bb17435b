"""Key tables: verdicts of presented keys, scope checks, record rules and the change audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from velaria.functions import keyfmt

# --- Fixed values: scopes, the routes they open, and limits of a record -----------------------
SCOPES = ("openai_chat", "anthropic_messages", "models", "scan")
ROUTE_SCOPES = {
    "/v1/chat/completions": "openai_chat",
    "/v1/messages": "anthropic_messages",
    "/v1/messages/count_tokens": "anthropic_messages",
    "/v1/models": "models",
    "/scan": "scan",
}
MAX_NAME_CHARS = 64
HASH_BYTES = 32
MAX_PEPPER_VERSION = 32_767
# Default-ignorable code points of Unicode 15 (first to last), and the braille blank.
IGNORABLE = (
    r"\x{00AD}\x{034F}\x{061C}\x{115F}-\x{1160}\x{17B4}-\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}"
    r"\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFF8}"
    r"\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}\x{2800}"
)
INVISIBLE = rf"[{IGNORABLE}\p{{Cc}}\p{{Cf}}\p{{Zl}}\p{{Zp}}\p{{Cs}}\p{{Co}}\p{{Cn}}]"


def verdicts(calls: DataFrame, keys: DataFrame, peppers: dict[int, bytes]) -> DataFrame:
    """`calls` (presented, at...) plus verdict and, when verified, key_id and scopes.

    Checked in order: malformed, unknown, revoked, expired at the time of the call.  The join is
    an equi-join on the hash; a call tries each pepper version of the ring (a few), and a key has
    one hash in the table, so no call matches twice.
    """
    shaped = calls.withColumn("_call", F.monotonically_increasing_id()).withColumn(
        "_formed", keyfmt.is_well_formed(F.col("presented"))
    )
    digests = F.array(
        *[
            F.struct(F.lit(v).cast("smallint").alias("version"), keyfmt.digest(F.col("presented"), p).alias("hash"))
            for v, p in sorted(peppers.items())
        ]
    )
    tried = shaped.withColumn("_d", F.explode_outer(F.when(F.col("_formed"), digests)))
    known = keys.select(
        F.col("id").alias("key_id"), "scopes", "expires_at", "revoked_at", "key_hash", "pepper_version"
    )
    matched = tried.join(
        known,
        (F.col("_d.hash") == F.col("key_hash")) & (F.col("_d.version") == F.col("pepper_version")),
        "left",
    )
    best = (
        matched.withColumn(
            "_rank", F.when(F.col("key_id").isNotNull(), F.col("_d.version").cast("int")).otherwise(99_999)
        )
        .groupBy(*calls.columns, "_call", "_formed")
        .agg(F.min_by(F.struct("key_id", "scopes", "expires_at", "revoked_at"), "_rank").alias("k"))
    )
    verdict = (
        F.when(~F.col("_formed"), "malformed")
        .when(F.col("k.key_id").isNull(), "unknown")
        .when(F.col("k.revoked_at").isNotNull(), "revoked")
        .when(F.col("at") >= F.col("k.expires_at"), "expired")
        .otherwise("verified")
    )
    good = F.col("verdict") == "verified"
    return best.withColumn("verdict", verdict).select(
        *calls.columns,
        "verdict",
        F.when(good, F.col("k.key_id")).alias("key_id"),
        F.when(good, F.col("k.scopes")).alias("scopes"),
    )


def route_allowed(path: Column, scopes: Column) -> Column:
    """The route's scope is among the caller's; a route no scope opens is refused."""
    routes = F.create_map(*[F.lit(x) for pair in ROUTE_SCOPES.items() for x in pair])
    return F.coalesce(F.array_contains(scopes, F.try_element_at(routes, path)), F.lit(False))


def broken_rules(keys: DataFrame) -> DataFrame:
    """One row per record and rule it breaks: id, rule."""
    name = F.col("name")
    blank_edge = r"\A[\s\p{Z}\x1C-\x1F\x85]|[\s\p{Z}\x1C-\x1F\x85]\z"
    count = F.size("scopes")
    rules = {
        "id": F.col("id") >= 1,
        "name_length": F.length(name).between(1, MAX_NAME_CHARS),
        "name_invisible": ~F.rlike(name, F.lit(INVISIBLE)),
        # Only a plain space may separate words, as in a printable text.
        "name_blank": ~F.rlike(name, F.lit(blank_edge)) & ~F.rlike(name, F.lit(r"[\p{Zs}&&[^ ]]")),
        "scopes": (count >= 1)
        & (F.size(F.array_distinct("scopes")) == count)
        & F.forall("scopes", lambda s: s.isin(list(SCOPES))),
        "created_at": F.col("created_at").isNotNull(),
        "expires_at": F.col("expires_at").isNull() | (F.col("expires_at") > F.col("created_at")),
        "revoked_at": F.col("revoked_at").isNull() | (F.col("revoked_at") >= F.col("created_at")),
        "key_hash": F.octet_length("key_hash") == HASH_BYTES,
        "pepper_version": F.col("pepper_version").between(1, MAX_PEPPER_VERSION),
        "per_minute_limit": F.col("per_minute_limit").isNull() | (F.col("per_minute_limit") >= 1),
        "per_day_limit": F.col("per_day_limit").isNull() | (F.col("per_day_limit") >= 1),
    }
    broken = F.array(
        *[F.when(~F.coalesce(test, F.lit(False)), rule) for rule, test in rules.items()]
    )
    return keys.select("id", F.explode(F.array_compact(broken)).alias("rule"))


def change_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of two snapshots that break the table's rules: id, change."""
    frozen = ("key_hash", "pepper_version", "created_at")
    a = before.select("id", F.struct(*frozen, "revoked_at").alias("a"))
    b = after.select("id", F.struct(*frozen, "revoked_at").alias("b"))
    changed = ~(
        F.col("a.key_hash").eqNullSafe(F.col("b.key_hash"))
        & F.col("a.pepper_version").eqNullSafe(F.col("b.pepper_version"))
        & F.col("a.created_at").eqNullSafe(F.col("b.created_at"))
    )
    revived = F.col("a.revoked_at").isNotNull() & ~F.col("a.revoked_at").eqNullSafe(F.col("b.revoked_at"))
    change = F.array_compact(
        F.array(
            F.when(F.col("b").isNull(), "deleted"),
            F.when(F.col("b").isNotNull() & changed, "frozen_column"),
            F.when(F.col("b").isNotNull() & revived, "revocation"),
        )
    )
    joined = a.join(b, "id", "left")
    return joined.select("id", F.explode(change).alias("change"))


def revoke(keys: DataFrame, revocations: DataFrame) -> DataFrame:
    """`keys` with `revocations(id, at)` applied: the first time wins, never before creation."""
    first = revocations.groupBy("id").agg(F.min("at").alias("_at"))
    new = F.greatest("_at", "created_at")
    return keys.join(first, "id", "left").withColumn(
        "revoked_at", F.coalesce("revoked_at", F.when(F.col("_at").isNotNull(), new))
    ).drop("_at")
