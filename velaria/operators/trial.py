"""The round-trip trial of a text, as a table: mask, check, a reply made of tokens only, restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from velaria.functions.views import utf16_length, utf16_offset
from velaria.operators.guard import row_leaks
from velaria.operators.restoring import parts_of, restore_text, vault_map

MAX_NAMED = 10
# Phrases of the simulated reply: no value can be in them.
PHRASES = {
    "en": ("Simulated reply. Your text had nothing to hide.", "Simulated reply. Only markers were seen: ", " more", " and "),
    "es": ("Respuesta simulada. Tu texto no tenía nada que ocultar.", "Respuesta simulada. Solo se vieron marcadores: ", " más", " y "),
}


def simulated_reply(tokens: Column, lang: Column) -> Column:
    """Names each token once, in order, at most ten; the rest is a count."""

    def phrase(i):
        return F.when(lang == "es", PHRASES["es"][i]).otherwise(PHRASES["en"][i])

    marks = F.transform(
        F.slice(tokens, F.lit(1), F.lit(MAX_NAMED)), lambda t: F.concat(F.lit("[["), t, F.lit("]]"))
    )
    rest = F.size(tokens) - MAX_NAMED
    items = F.when(
        rest > 0, F.concat(marks, F.array(F.concat(rest.cast("string"), phrase(2))))
    ).otherwise(marks)
    head = F.array_join(F.slice(items, F.lit(1), F.size(items) - 1), ", ")
    listed = F.when(F.size(items) == 1, F.element_at(items, 1)).otherwise(
        F.concat(head, phrase(3), F.element_at(items, -1))
    )
    return F.when(F.size(tokens) == 0, phrase(0)).otherwise(F.concat(phrase(1), listed, F.lit(".")))


def trial(masked: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """`masked` (from `mask_rows`) plus outcome, blocked_reason, entities in UTF-16 offsets, sent
    pieces and the restored reply.  A blocked row sends and shows nothing."""
    checked = row_leaks(
        masked.withColumn("_values", F.transform("vault", lambda v: v["value"])).withColumn(
            "_hidden", F.col("_values")
        ),
        "masked_text",
        "_hidden",
        "_blocked",
    )
    tokens = F.array_distinct(
        F.transform(F.filter("found", lambda f: f["hidden"]), lambda f: f["token"])
    )
    own = F.transform("vault", lambda v: v["token"])
    reply = restore_text(F.col("_reply"), vault_map(F.col("vault")))
    return (
        checked.withColumn("_reply", simulated_reply(tokens, F.col(lang)))
        .withColumn("outcome", F.when(F.col("_blocked"), "blocked").otherwise("masked"))
        .withColumn("blocked_reason", F.when(F.col("_blocked"), "egress_guard"))
        .withColumn("length_utf16", utf16_length(F.col(text)))
        .withColumn(
            "entities",
            F.transform(
                "found",
                lambda f: F.struct(
                    f["type"].alias("type"),
                    utf16_offset(F.col(text), f["start"]).alias("start"),
                    utf16_offset(F.col(text), f["end"]).alias("end"),
                    f["hidden"].alias("hidden"),
                ),
            ),
        )
        .withColumn("sent", F.when(~F.col("_blocked"), parts_of(F.col("masked_text"), own)))
        .withColumn("reply", F.when(~F.col("_blocked"), reply))
        .drop("_blocked", "_reply", "_hidden", "_values")
    )
