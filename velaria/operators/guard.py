"""Egress guard: no hidden value of a scope may appear in what the scope sends out.

A value of six or more letters and digits is looked for with everything else removed; a shorter
one as a whole word.  Both searches start from the first piece of a value under its scope, hashed in the task that
has the text (`operators.needles`), so only places that may hold a value leave it, and texts are compared only with
values they may hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from velaria.functions.spans import stands_in
from velaria.functions.views import compact, guard_view
from velaria.operators import needles as search
from velaria.session import stored

MIN_COMPACT = 6


def contains_word(normal: Column, needle: Column) -> Column:
    """`needle` stands in `normal` with no letter or digit touching it."""
    return stands_in(normal, needle, r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])")


GRAM, WORD, SIGN = range(3)


def needles(vault: DataFrame, scope: str) -> DataFrame:
    """scope, needle, whole (word search), h: the hash, under the scope, of what its texts must also hold."""
    folded = (
        vault.select(scope, guard_view(F.col("value")).alias("_n"))
        .distinct()
        .select(scope, "_n", compact(F.col("_n")).alias("_c"))
    )
    long = F.length("_c") >= MIN_COMPACT
    # The first run of letters and digits, or the first character of a value without any.
    word = F.regexp_extract("_n", r"[\p{L}\p{N}]+", 0)
    key = F.when(long, F.substring("_c", 1, MIN_COMPACT)).when(word != "", word).otherwise(F.substring("_n", 1, 1))
    kind = F.when(long, F.lit(GRAM)).when(word != "", F.lit(WORD)).otherwise(F.lit(SIGN))
    rows = folded.select(scope, F.when(long, F.col("_c")).otherwise(F.col("_n")).alias("needle"), (~long).alias("whole"), key.alias("key"), kind.alias("kind"))
    hashed = search.under_salt(search.needle_hash("key", "kind"), F.xxhash64(scope))
    return rows.filter("needle <> ''").distinct().select(scope, "needle", "whole", hashed.alias("h"))


def _places(codes: list[search.Codes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every span of a folded and of a squeezed text that could be a needle's key."""
    normal, squeezed = codes
    yield squeezed.grams(MIN_COMPACT, GRAM)
    inside = search.alnum(normal.codes)
    rows, start, end = normal.runs(inside)
    yield rows, normal.hashes(start, end, WORD)
    signs = np.flatnonzero(~inside)
    yield normal.rows()[signs], normal.hashes(signs, signs + 1, SIGN)


def _is_hit(normal, squeezed, needle, whole) -> Column:
    return (whole & contains_word(normal, needle)) | (~whole & F.contains(squeezed, needle))


def leaking_scopes(
    outgoing: DataFrame,
    vault: DataFrame,
    scope: str = "scope_id",
    ordinal: str = "text_ord",
    text: str = "text",
) -> DataFrame:
    """Scopes whose outgoing texts hold a hidden value, once each: they are blocked whole.

    `outgoing` has one row per text or decoded JSON leaf, and is read twice.  Texts of scopes without a
    vault aren't folded, and texts don't move: what is shuffled are hits of a value's first piece.
    """
    wanted = stored(needles(vault, scope), "needles")
    watched = search.only_maybe(outgoing.select(scope, ordinal, text), wanted.select(scope).distinct(), [scope])
    normal = guard_view(F.col(text))
    folded = watched.select(scope, ordinal, normal.alias("_normal")).withColumn("_compact", compact(F.col("_normal")))
    columns = [F.col("_normal"), F.col("_compact")]
    found = search.candidates(folded, [scope, ordinal], columns, _places, wanted, F.xxhash64(scope))
    pairs = stored(found.join(wanted, [scope, "h"]).drop("h").distinct(), "met")
    hit = _is_hit(F.col("_normal"), F.col("_compact"), F.col("needle"), F.col("whole"))
    texts = search.only_maybe(outgoing.select(scope, ordinal, text), pairs, [scope, ordinal])
    refolded = texts.select(scope, ordinal, normal.alias("_normal")).withColumn("_compact", compact(F.col("_normal")))
    return pairs.join(refolded, [scope, ordinal]).filter(hit).select(scope).distinct()


def row_leaks(df: DataFrame, text: str, values: str, out: str = "leaks") -> DataFrame:
    """The same test where each row is its own scope: `values` is its array of hidden values.

    The values are folded together, separated by a character no folding touches; a value that
    held it would be searched in pieces, which can only block more.
    """
    mark = chr(1)
    folded = F.filter(
        F.transform(F.split("_values", mark), lambda v: F.trim(v)), lambda v: v != ""
    )

    def held(v):
        squeezed = compact(v)
        return _is_hit(
            F.col("_normal"),
            F.col("_compact"),
            F.when(F.length(squeezed) >= MIN_COMPACT, squeezed).otherwise(v),
            F.length(squeezed) < MIN_COMPACT,
        )

    return (
        df.withColumn("_values", guard_view(F.array_join(values, mark)))
        .withColumn("_normal", guard_view(F.when(F.size(values) > 0, F.col(text))))
        .withColumn("_compact", compact(F.col("_normal")))
        .withColumn(out, F.coalesce(F.exists(folded, held), F.lit(False)))
        .drop("_values", "_normal", "_compact")
    )


def released(texts: DataFrame, blocked: DataFrame, scope: str = "scope_id") -> DataFrame:
    return texts.join(blocked.select(scope).distinct(), scope, "left_anti")
