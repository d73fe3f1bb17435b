"""Overlap resolution inside a row, and interval operators over span tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from velaria.functions import tables
from velaria.functions.spans import SPANS_TYPE, no_spans, piece

_FIELDS = ("start", "end", "type", "layer", "confidence")


def order_of(values, names) -> Column:
    """Position of a value in a fixed list of names."""
    return F.array_position(F.array(*map(F.lit, names)), values).cast("int")


def layer_order(layer: Column) -> Column:
    return order_of(layer, tables.LAYERS)


def type_order(entity: Column) -> Column:
    return order_of(entity, tables.ENTITY_TYPES)


def _is_name(span: Column) -> Column:
    return span["layer"] == "NER"


def _span(s: Column, start: Column, end: Column) -> Column:
    return F.struct(
        start.alias("start"),
        end.alias("end"),
        *[s[f].alias(f) for f in ("type", "layer", "confidence")],
    )


def _clusters(ordered: Column) -> Column:
    """Spans sorted by start, cut where no span reaches over: each cluster resolves on its own."""
    none = F.struct(
        F.lit(-1).alias("reach"),
        no_spans().alias("open"),
        F.array().cast(f"array<{SPANS_TYPE}>").alias("closed"),
    )

    def step(acc, s):
        joined = F.struct(
            F.greatest(acc["reach"], s["end"]).alias("reach"),
            F.concat(acc["open"], F.array(s)).alias("open"),
            acc["closed"].alias("closed"),
        )
        cut = F.struct(
            s["end"].alias("reach"),
            F.array(s).alias("open"),
            F.concat(acc["closed"], F.array(acc["open"])).alias("closed"),
        )
        return F.when(s["start"] < acc["reach"], joined).otherwise(cut)

    return F.aggregate(
        ordered, none, step, lambda acc: F.concat(acc["closed"], F.array(acc["open"]))
    )


def _placing_order(cluster: Column) -> Column:
    """Who is placed first: names last, contained spans after the rest, then layer, length, place."""

    def ranked(s):
        inside = F.exists(
            cluster,
            lambda o: (_is_name(o) == _is_name(s))
            & (o["start"] <= s["start"])
            & (s["end"] <= o["end"])
            & ((o["start"] != s["start"]) | (o["end"] != s["end"])),
        )
        return F.struct(
            _is_name(s).alias("name"),
            inside.alias("inside"),
            layer_order(s["layer"]).alias("layer_ord"),
            (s["start"] - s["end"]).alias("longest"),
            s["start"].alias("first"),
            type_order(s["type"]).alias("type_ord"),
            s["confidence"].alias("level"),
            s.alias("span"),
        )

    return F.transform(F.array_sort(F.transform(cluster, ranked)), lambda r: r["span"])


def _free(candidate: Column, kept: Column, view: Column) -> Column:
    """The parts of `candidate` no kept span covers; cut parts without a letter or digit go."""
    over = F.array_sort(
        F.filter(
            kept, lambda k: (k["start"] < candidate["end"]) & (candidate["start"] < k["end"])
        )
    )
    starts = F.concat(F.array(candidate["start"]), F.transform(over, lambda k: k["end"]))
    ends = F.concat(F.transform(over, lambda k: k["start"]), F.array(candidate["end"]))
    parts = F.zip_with(starts, ends, lambda a, b: _span(candidate, a, b))
    seen = F.filter(
        parts,
        lambda p: (p["start"] < p["end"])
        & F.rlike(piece(view, p["start"], p["end"]), F.lit(r"[\p{L}\p{N}]")),
    )
    return F.when(F.size(over) == 0, F.array(candidate)).otherwise(seen)


def _settle(cluster: Column, view: Column) -> Column:
    return F.aggregate(
        _placing_order(cluster),
        no_spans(),
        lambda kept, s: F.concat(kept, _free(s, kept, view)),
    )


def resolve(spans: Column, view: Column) -> Column:
    """Disjoint spans, sorted, that cover every letter and digit the input covered.

    Validators and patterns are placed before names; on each side a container beats what it
    contains; a loser is trimmed, not dropped.  Only spans that overlap another are folded.
    """
    ordered = F.array_sort(F.array_distinct(spans))
    settled = F.flatten(
        F.transform(
            _clusters(ordered), lambda c: F.when(F.size(c) <= 1, c).otherwise(_settle(c, view))
        )
    )
    return F.when(F.size(spans) <= 1, spans).otherwise(F.array_sort(settled))


# --- Interval operators over span tables ------------------------------------------------------


def contained(spans: DataFrame, keys) -> DataFrame:
    """Spans strictly inside another span of the same text and side, by a running furthest end."""
    side = F.col("layer") == "NER"
    up_to = (
        Window.partitionBy(*keys, side)
        .orderBy("start", F.desc("end"))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # The longest of the spans that reach furthest so far; itself is not inside itself.
    furthest = F.max(F.struct("end", (-F.col("start")).alias("from"))).over(up_to)
    return (
        spans.withColumn("_far", furthest)
        .filter(
            (F.col("end") <= F.col("_far.end"))
            & ((F.col("end") != F.col("_far.end")) | (F.col("start") != -F.col("_far.from")))
        )
        .drop("_far")
    )


def free_pieces(spans: DataFrame, cover: DataFrame, keys) -> DataFrame:
    """Parts of each span that no covering interval of the same text covers.

    Boundaries of both tables are swept in order (one sort per text): no pair is ever built.
    """
    edges = spans.select(
        *keys, F.lit(0).alias("_cover"), F.lit(1).alias("_span"), "start", "end"
    ).unionByName(
        cover.select(*keys, F.lit(1).alias("_cover"), F.lit(0).alias("_span"), "start", "end")
    )
    points = edges.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("start").alias("at"), F.col("_cover").alias("c"), F.col("_span").alias("s")),
                F.struct(F.col("end").alias("at"), (-F.col("_cover")).alias("c"), (-F.col("_span")).alias("s")),
            )
        ).alias("p"),
    ).select(*keys, "p.*")
    steps = points.groupBy(*keys, "at").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    by_place = Window.partitionBy(*keys).orderBy("at")
    depth = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        steps.select(
            *keys,
            F.col("at").alias("start"),
            F.lead("at").over(by_place).alias("end"),
            F.sum("c").over(depth).alias("_c"),
            F.sum("s").over(depth).alias("_s"),
        )
        .filter((F.col("_s") > 0) & (F.col("_c") == 0))
        .drop("_c", "_s")
    )


def ill_formed(spans: DataFrame, lengths: DataFrame, keys) -> DataFrame:
    """Texts whose spans are not sorted, disjoint and inside the text; they are blocked whole.

    `lengths` holds the keys and `n_chars`.
    """
    in_order = Window.partitionBy(*keys).orderBy("start", "end")
    checked = spans.withColumn("_before", F.coalesce(F.lag("end").over(in_order), F.lit(0))).join(
        lengths, keys, "left"
    )
    bad = ~F.coalesce(
        (F.col("_before") <= F.col("start"))
        & (F.col("start") < F.col("end"))
        & (F.col("end") <= F.col("n_chars")),
        F.lit(False),
    )
    return checked.filter(bad).select(*keys).distinct()


def overlapping(left: DataFrame, right: DataFrame, keys, bin_chars: int = 256) -> DataFrame:
    """Pairs of spans of one text that share a character: l_start, l_end, r_start, r_end.

    Both sides are cut into bins of `bin_chars`; the join is an equi-join on text and bin, and a
    pair met in several bins is kept in the first of them.  A text with very many spans is spread
    over its bins instead of pairing everything with everything.
    """

    def binned(df, side):
        first = (F.col("start") / bin_chars).cast("int")
        last = ((F.col("end") - 1) / bin_chars).cast("int")
        others = [c for c in df.columns if c not in keys]
        return df.filter(F.col("start") < F.col("end")).select(
            *keys,
            *[F.col(c).alias(f"{side}_{c}") for c in others],
            F.explode(F.sequence(first, last)).alias("_bin"),
        )

    joined = binned(left, "l").join(binned(right, "r"), [*keys, "_bin"])
    shared = F.greatest("l_start", "r_start")
    return joined.filter(
        (F.col("l_start") < F.col("r_end"))
        & (F.col("r_start") < F.col("l_end"))
        & (F.col("_bin") == (shared / bin_chars).cast("int"))
    ).drop("_bin")


def touching(left: DataFrame, right: DataFrame, keys, bin_chars: int = 256) -> DataFrame:
    """Spans of `left` that share a character with some span of `right`, once each."""
    pairs = overlapping(left, right.select(*keys, "start", "end").distinct(), keys, bin_chars)
    names = [c for c in left.columns if c not in keys]
    return pairs.select(*keys, *[F.col(f"l_{c}").alias(c) for c in names]).distinct()
