"""Matches of a pattern as arrays of positions, computed inside the row that holds the text.

Positions are code points, half-open.  A pattern's matches come from two native calls (the
matches and the gaps between them); their lengths give the offsets, so no character of the text
is reserved as a marker and a text without matches costs one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN_TYPE = "struct<start:int,end:int,type:string,layer:string,confidence:string>"
SPANS_TYPE = f"array<{SPAN_TYPE}>"
HIT_TYPE = "struct<start:int,end:int,hit:string>"
HITS_TYPE = f"array<{HIT_TYPE}>"
BLOCK = 64  # matches placed by one inner fold; keeps a text with many matches near linear


def let(value: Column, use) -> Column:
    """`use(value)` with `value` computed once, for expressions that read it many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def no_hits() -> Column:
    return F.array().cast(HITS_TYPE)


def no_spans() -> Column:
    return F.array().cast(SPANS_TYPE)


def _hit(start, end, hit) -> Column:
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), hit.alias("hit")
    )


def _place(steps: Column, origin: Column) -> Column:
    """Hits of one block of (gap, width, hit) steps that starts at offset `origin`."""
    start = F.struct(origin.cast("int").alias("at"), no_hits().alias("hits"))

    def step(acc, s):
        first = acc["at"] + s["gap"]
        last = first + s["width"]
        return F.struct(
            last.alias("at"),
            F.concat(acc["hits"], F.array(_hit(first, last, s["hit"]))).alias("hits"),
        )

    return F.aggregate(steps, start, step, lambda acc: acc["hits"])


def hits(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end,hit>>: every match of `pattern`, left to right, non-overlapping.

    `hit` is `group` of the match; `start` and `end` always are those of the whole match.
    """
    rx = F.lit(pattern)

    def steps(whole):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
        widths = F.transform(whole, lambda w: F.length(w))
        shown = whole if group == 0 else F.regexp_extract_all(text, rx, F.lit(group))
        return F.transform(
            F.arrays_zip(gaps.alias("gap"), widths.alias("width"), shown.alias("hit")),
            lambda z: F.struct(
                F.length(z["gap"]).alias("gap"), z["width"].alias("width"), z["hit"].alias("hit")
            ),
        )

    def found(whole):
        return F.when(F.size(whole) == 0, no_hits()).otherwise(let(steps(whole), _placed))

    return let(F.regexp_extract_all(text, rx, F.lit(0)), found)


def _placed(steps: Column) -> Column:
    """Steps cut in blocks: each block is placed on its own, then the blocks' origins are added."""
    count = F.ceil(F.size(steps) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda b: F.slice(steps, (b * BLOCK + 1).cast("int"), F.lit(BLOCK)),
    )
    return F.when(F.size(steps) <= BLOCK, _place(steps, F.lit(0))).otherwise(
        F.flatten(
            F.aggregate(
                blocks,
                F.struct(
                    F.lit(0).alias("at"), F.array().cast(f"array<{HITS_TYPE}>").alias("done")
                ),
                lambda acc, block: F.struct(
                    (
                        acc["at"]
                        + F.aggregate(block, F.lit(0), lambda n, s: n + s["gap"] + s["width"])
                    ).alias("at"),
                    F.concat(acc["done"], F.array(_place(block, acc["at"]))).alias("done"),
                ),
                lambda acc: acc["done"],
            )
        )
    )


def span(hit: Column, entity: str, layer: str, confidence) -> Column:
    """The span of a hit; `confidence` is a literal or a Column."""
    level = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(
        hit["start"].alias("start"),
        hit["end"].alias("end"),
        F.lit(entity).alias("type"),
        F.lit(layer).alias("layer"),
        level.alias("confidence"),
    )


def as_spans(found: Column, entity: str, layer: str, confidence) -> Column:
    """`confidence` may also be a function of the hit."""
    return F.transform(
        found,
        lambda h: span(h, entity, layer, confidence(h) if callable(confidence) else confidence),
    )


def piece(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with code-point offsets."""
    return F.substring(text, start + 1, end - start)


def char_at(text: Column, index: Column) -> Column:
    """The character at `index`, or '' outside the text."""
    return F.when(index < 0, F.lit("")).otherwise(F.substring(text, index + 1, F.lit(1)))


def keep_leftmost(found: Column) -> Column:
    """Greedy left to right: a hit that starts before the end of the last kept one is left out."""
    start = F.struct(F.lit(-1).alias("at"), no_hits().alias("hits"))

    def step(acc, h):
        taken = F.struct(
            h["end"].alias("at"), F.concat(acc["hits"], F.array(h)).alias("hits")
        )
        return F.when(h["start"] >= acc["at"], taken).otherwise(acc)

    return let(
        found,
        lambda all_hits: F.when(F.size(all_hits) <= 1, all_hits).otherwise(
            F.aggregate(all_hits, start, step, lambda acc: acc["hits"])
        ),
    )


def quoted(text: Column) -> Column:
    """`text` as a pattern that matches just itself."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}])", r"\\$1")


def stands_in(text: Column, needle: Column, before: str, after: str) -> Column:
    """`needle` is somewhere in `text` between what two look-around patterns ask for."""
    pattern = F.concat(F.lit(before), quoted(needle), F.lit(after))
    return F.contains(text, needle) & F.rlike(text, pattern)
