"""Restoring: escapes undone and this scope's placeholders replaced by their values, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from velaria.functions.views import rewrite

# --- Fixed value: an escape, or a placeholder as a model may write it back --------------------
MARK = r"\[\[+!|\[\[[ \t]*[A-Za-z]+(?:_[A-Za-z]+)*_[0-9]+[ \t]*\]\]"


def _is_escape(mark: Column) -> Column:
    return mark.endswith("!")


def _token(mark: Column) -> Column:
    return F.upper(F.translate(mark, "[] \t", ""))


def restore_text(text: Column, entries: Column, encode=None) -> Column:
    """`entries` is a map token -> value (null or empty: only escapes are undone).

    What is put back is never read again, so a value that looks like a placeholder stays.
    """

    def change(mark):
        value = F.try_element_at(entries, _token(mark)) if entries is not None else F.lit(None)
        shown = value if encode is None else encode(value)
        return F.when(_is_escape(mark), F.substring(mark, F.lit(1), F.length(mark) - 1)).otherwise(
            F.coalesce(shown, mark)
        )

    return rewrite(text, MARK, change)


def vault_map(entries: Column) -> Column:
    """An array of vault entries (token, value) as a map."""
    return F.map_from_entries(
        F.transform(entries, lambda e: F.struct(e["token"].alias("key"), e["value"].alias("value")))
    )


def restore_scopes(
    answers: DataFrame, vault: DataFrame, scope: str = "scope_id", text: str = "text"
) -> DataFrame:
    """`answers` (scope, text_ord, text) plus `restored`.

    Only tokens an answer names are joined: a scope with a huge vault is never gathered, and an
    answer without placeholders never moves.
    """
    named = answers.withColumn("_tokens", tokens_in(F.col(text)))
    still = named.filter(F.size("_tokens") == 0)
    asked = (
        named.filter(F.size("_tokens") > 0)
        .select(scope, "text_ord", F.explode("_tokens").alias("token"))
        .join(vault.select(scope, "token", "value"), [scope, "token"])
        .groupBy(scope, "text_ord")
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_entries"))
    )
    moving = named.filter(F.size("_tokens") > 0).join(asked, [scope, "text_ord"], "left")
    nothing = F.lit(None).cast("map<string,string>")
    return (
        still.withColumn("_entries", nothing)
        .unionByName(moving)
        .withColumn("restored", restore_text(F.col(text), F.col("_entries")))
        .drop("_tokens", "_entries")
    )


def tokens_in(text: Column) -> Column:
    """Upper-case tokens of the placeholders written in `text`, once each."""
    marks = F.regexp_extract_all(text, F.lit(MARK), F.lit(0))
    return F.array_distinct(F.transform(F.filter(marks, lambda m: ~_is_escape(m)), _token))


def parts_of(text: Column, own: Column | None = None) -> Column:
    """array<struct<piece,token>>: the text cut at its placeholders; joined, it is the text.

    Escapes stay inside the text around them, and no piece is empty.  With `own` (an array of
    tokens) any other placeholder is text too.
    """

    def cuts(mark):
        placeholder = ~_is_escape(mark) & (mark != "")
        return placeholder if own is None else placeholder & F.array_contains(own, _token(mark))

    marks = F.regexp_extract_all(text, F.lit(MARK), F.lit(0))
    gaps = F.split(text, MARK, -1)
    flat = F.flatten(
        F.zip_with(
            gaps,
            F.concat(marks, F.array(F.lit(""))),
            lambda g, m: F.array(
                F.struct(g.alias("piece"), F.lit(None).cast("string").alias("token")),
                F.struct(
                    m.alias("piece"),
                    F.when(cuts(m), _token(m)).alias("token"),
                ),
            ),
        )
    )
    nothing = F.array().cast("array<struct<piece:string,token:string>>")

    def step(acc, p):
        last = F.try_element_at(acc, F.lit(-1))
        joins = p["token"].isNull() & (F.size(acc) > 0) & last["token"].isNull()
        joined = F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(
                F.struct(
                    F.concat(last["piece"], p["piece"]).alias("piece"),
                    F.lit(None).cast("string").alias("token"),
                )
            ),
        )
        return F.when(p["piece"] == "", acc).when(joins, joined).otherwise(
            F.concat(acc, F.array(p))
        )

    return F.when(F.length(text) == 0, nothing).otherwise(F.aggregate(flat, nothing, step))


def round_trip_failures(masked: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose restored masked text is not the text: must be empty."""
    restored = restore_text(F.col("masked_text"), vault_map(F.col("vault")))
    return masked.filter(~restored.eqNullSafe(F.col(text)))
