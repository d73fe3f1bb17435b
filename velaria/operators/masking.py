"""Masking: hidden values become `[[TYPE_N]]`, clear text is escaped, and the report of what was
found never holds a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from velaria.functions.spans import SPANS_TYPE, no_spans, piece
from velaria.functions.views import escape
from velaria.operators import needles as search
from velaria.operators.detect import value_table
from velaria.operators.policy import hides
from velaria.operators.propagate import propagate
from velaria.operators.resolve import ill_formed, resolve
from velaria.operators.vault import vault
from velaria.session import stored

FOUND_TYPE = "array<struct<start:int,end:int,type:string,hidden:boolean,token:string>>"


def mask_text(text: Column, found: Column) -> Column:
    """`text` with every hidden span of `found` replaced; allowed spans stay in the clear runs."""
    hidden = F.filter(found, lambda s: s["hidden"])
    starts = F.concat(F.array(F.lit(0)), F.transform(hidden, lambda s: s["end"]))
    ends = F.concat(F.transform(hidden, lambda s: s["start"]), F.array(F.length(text)))
    clear = F.zip_with(starts, ends, lambda a, b: escape(piece(text, a, b)))
    marks = F.concat(
        F.transform(hidden, lambda s: F.concat(F.lit("[["), s["token"], F.lit("]]"))),
        F.array(F.lit("")),
    )
    joined = F.array_join(F.zip_with(clear, marks, lambda c, m: F.concat(c, m)), "")
    return F.when(F.size(hidden) == 0, escape(text)).otherwise(joined)


def mask_rows(scanned: DataFrame, text: str = "text", policy=None) -> DataFrame:
    """Each row its own scope: numbering, masking and the vault are computed inside the row.

    Adds `found`, `masked_text` and `vault` (array of type, value, token).  No shuffle.
    """
    valued = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["type"].alias("type"),
            hides(s["type"], policy).alias("hidden"),
            piece(F.col(text), s["start"], s["end"]).alias("value"),
        ),
    )
    keys = F.array_distinct(
        F.transform(
            F.filter("_valued", lambda s: s["hidden"]),
            lambda s: F.struct(s["type"].alias("type"), s["value"].alias("value")),
        )
    )

    def token(s):
        same = F.filter("_keys", lambda k: k["type"] == s["type"])
        key = F.struct(s["type"].alias("type"), s["value"].alias("value"))
        return F.concat(s["type"], F.lit("_"), F.array_position(same, key).cast("string"))

    found = F.transform(
        "_valued",
        lambda s: F.struct(
            *[s[f].alias(f) for f in ("start", "end", "type", "hidden")],
            F.when(s["hidden"], token(s)).alias("token"),
        ),
    ).cast(FOUND_TYPE)
    entries = F.transform(
        "_keys",
        lambda k: F.struct(k["type"].alias("type"), k["value"].alias("value"), token(k).alias("token")),
    )
    return (
        scanned.withColumn("_valued", valued)
        .withColumn("_keys", keys)
        .withColumn("found", found)
        .withColumn("vault", entries)
        .withColumn("masked_text", mask_text(F.col(text), F.col("found")))
        .drop("_valued", "_keys")
    )


def mask_scopes(
    scanned: DataFrame,
    scope: str = "scope_id",
    text: str = "text",
    policy=None,
    reserved: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(masked texts, vault) with one numbering over all the texts of a scope.

    Pass a materialized scan (`velaria.session.materialize`): it is read three times.
    `scanned` has scope, text_ord, text and spans.  Only span rows are shuffled for numbering;
    texts without hidden spans are escaped where they are and never moved.
    """
    values = value_table(scanned, [scope, "text_ord"], text)
    numbers = vault(values, scope, policy, reserved)
    tokens = (
        values.withColumn("hidden", hides(F.col("type"), policy))
        .join(numbers.select(scope, "type", "value", "token"), [scope, "type", "value"], "left")
        .withColumn("token", F.when(F.col("hidden"), F.col("token")))
    )
    # One list per text: its own spans only.
    found = tokens.groupBy(scope, "text_ord").agg(
        F.array_sort(
            F.collect_list(F.struct("start", "end", "type", "hidden", "token"))
        ).alias("found")
    )
    plain = scanned.filter(F.size("spans") == 0).select(
        scope, "text_ord", text, F.array().cast(FOUND_TYPE).alias("found")
    )
    moved = (
        scanned.filter(F.size("spans") > 0)
        .select(scope, "text_ord", text)
        .join(found, [scope, "text_ord"])
        .withColumn("found", F.col("found").cast(FOUND_TYPE))
    )
    masked = plain.unionByName(moved).select(
        scope, "text_ord", mask_text(F.col(text), F.col("found")).alias("masked_text"), "found"
    )
    return masked, numbers


def with_names(
    scanned: DataFrame, scored: DataFrame, scope: str = "scope_id", text: str = "text", policy=None, max_names: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(scanned with a model's names, and every other appearance of them in the scope, blocked scopes).

    `scored` has scope, text_ord, start, end, type.  A scope in which the model's ranges of some text are not
    sorted, disjoint and inside it, or name a text that isn't there, is blocked whole: its detector failed.
    """
    keys = [scope, "text_ord"]
    names = stored(scored.select(*keys, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "type"), "scored")
    lengths = search.only_maybe(scanned.select(*keys, text), names, keys).select(*keys, F.length(text).alias("n_chars"))
    bad = ill_formed(names.select(*keys, "start", "end"), lengths, keys).select(scope)
    failed = stored(bad.distinct().withColumn("reason", F.lit("detector_failed")), "failed")
    ranges = F.struct("start", "end", "type", F.lit("NER").alias("layer"), F.lit("MEDIUM").alias("confidence"))
    more = names.join(failed, scope, "left_anti").groupBy(*keys).agg(F.collect_list(ranges).cast(SPANS_TYPE).alias("_names"))
    rest = scanned.join(failed, scope, "left_anti")
    some, none = search.split_maybe(rest, names, keys)
    joined = some.join(more, keys, "left").withColumn("spans", resolve(F.concat("spans", F.coalesce("_names", no_spans())), F.col(text)))
    named = joined.select(*scanned.columns).unionByName(none.select(*scanned.columns))
    out, many = propagate(named, scope, text, policy, max_names)
    return out, failed.unionByName(many.select(scope, "reason"))


def found_table(masked: DataFrame, keys) -> DataFrame:
    """One row per found span: start, end, type, hidden, token; no value."""
    return (
        masked.select(*keys, F.explode_outer("found").alias("f"))
        .filter("f is not null")
        .select(*keys, "f.*")
    )


def counts_by_type(found: DataFrame, keys=()) -> DataFrame:
    """Found and hidden spans per type; order it by `type_order` to list types in their order."""
    return found.groupBy(*keys, "type").agg(
        F.count("*").alias("found"), F.count_if("hidden").alias("hidden")
    )
