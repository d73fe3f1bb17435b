"""Exposure metrics: predictions against annotations, leaks, reports and threshold choice.

Tables: gold(keys, start, end, label), pred(keys, start, end, label); `keys` name a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from velaria.functions.spans import piece
from velaria.session import stored

FLOOR_TYPES = ("PERSON", "ADDRESS")
PRECISION_FLOOR = 0.85
THRESHOLDS = (0.3, 0.4, 0.5, 0.6)


def _both(gold: DataFrame, pred: DataFrame, columns) -> DataFrame:
    return gold.select(*columns, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
        pred.select(*columns, F.lit(0).alias("g"), F.lit(1).alias("p"))
    )


def overlap_counts(gold: DataFrame, pred: DataFrame, keys) -> DataFrame:
    """tp, fp, fn per text and label: each prediction, in order of place, takes the first free
    annotation of its label that it overlaps.

    Only ranges that reach each other can match, so they are grouped in islands first: a fold
    sees one island, never all of a text.
    """
    ranges = _both(gold, pred, [*keys, "label", "start", "end"])
    in_order = Window.partitionBy(*keys, "label").orderBy("start", "end", "g")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int")
    islands = ranges.withColumn("_new", new).withColumn("_island", F.sum("_new").over(upto))
    pair = F.struct("start", "end")
    grouped = islands.groupBy(*keys, "label", "_island").agg(
        F.array_sort(F.collect_list(F.when(F.col("g") == 1, pair))).alias("gold"),
        F.array_sort(F.collect_list(F.when(F.col("p") == 1, pair))).alias("pred"),
    )
    indexed = F.transform(
        "gold", lambda x, i: F.struct(i.alias("i"), x["start"].alias("start"), x["end"].alias("end"))
    )
    kind = "array<struct<i:int,start:int,end:int>>"

    def step(acc, p):
        over = F.filter(
            acc["free"], lambda x: (x["start"] < p["end"]) & (p["start"] < x["end"])
        )
        taken = F.try_element_at(over, F.lit(1))["i"]
        matched = F.struct(
            F.filter(acc["free"], lambda x: x["i"] != taken).alias("free"),
            (acc["tp"] + 1).alias("tp"),
        )
        return F.when(F.size(over) > 0, matched).otherwise(acc)

    start = F.struct(indexed.cast(kind).alias("free"), F.lit(0).alias("tp"))
    counted = grouped.withColumn(
        "tp", F.aggregate("pred", start, step, lambda acc: acc["tp"])
    ).select(
        *keys,
        "label",
        "tp",
        (F.size("pred") - F.col("tp")).alias("fp"),
        (F.size("gold") - F.col("tp")).alias("fn"),
    )
    return counted.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def by_label(counts: DataFrame) -> DataFrame:
    return counts.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def strict_counts(gold: DataFrame, pred: DataFrame, keys) -> DataFrame:
    """The same with equal start and end: a multiset intersection, in one aggregation."""
    same = _both(gold, pred, [*keys, "label", "start", "end"]).groupBy(
        *keys, "label", "start", "end"
    ).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    both = F.least("g", "p")
    return same.groupBy(*keys, "label").agg(
        F.sum(both).alias("tp"), F.sum(F.col("p") - both).alias("fp"), F.sum(F.col("g") - both).alias("fn")
    )


def touches(pred: DataFrame, gold: DataFrame, keys) -> DataFrame:
    """Every prediction, with `touches`: it shares a character with an annotation of any label.

    One ordered pass per text: at the end of a prediction, the furthest end among annotations
    that started before it says whether one reaches in.  No pair is built.
    """
    kept = [c for c in pred.columns if c not in (*keys, "start", "end")]
    nulls = [F.lit(None).cast(pred.schema[c].dataType).alias(c) for c in kept]
    marks = pred.select(
        *keys, "start", "end", *kept, F.col("end").alias("_at"), F.lit(0).alias("_gold")
    ).unionByName(
        gold.filter(F.col("start") < F.col("end")).select(
            *keys, "start", "end", *nulls, F.col("start").alias("_at"), F.lit(1).alias("_gold")
        )
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy("_at", "_gold")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    reach = F.max(F.when(F.col("_gold") == 1, F.col("end"))).over(before)
    return (
        marks.withColumn("touches", F.coalesce(reach > F.col("start"), F.lit(False)))
        .filter("_gold = 0")
        .drop("_at", "_gold")
    )


def any_gold_counts(gold: DataFrame, pred: DataFrame, keys) -> DataFrame:
    """Per predicted label: predictions over any annotated data (tp) and over none (fp)."""
    return touches(pred, gold, keys).groupBy("label").agg(
        F.count_if("touches").alias("tp"),
        F.count_if(~F.col("touches")).alias("fp"),
        F.lit(0).cast("bigint").alias("fn"),
    )


def blanked(text: Column, spans: Column) -> Column:
    """`text` with every span (they may overlap) written as spaces of the same length."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        first, last = F.greatest(s["start"], acc["at"]), F.greatest(s["end"], acc["at"])
        out = F.concat(
            acc["out"], piece(text, acc["at"], first), F.repeat(F.lit(" "), last - first)
        )
        return F.struct(last.alias("at"), out.alias("out"))

    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    )
    return F.aggregate(
        ordered, start, step, lambda acc: F.concat(acc["out"], piece(text, acc["at"], F.length(text)))
    )


def leaked_annotations(documents: DataFrame, keys, text="text", gold="gold", pred="pred") -> DataFrame:
    """One row per annotation: label and `leaked`, a letter or digit of it under no prediction.

    `documents` holds both as arrays, so the text never moves.
    """
    covered = documents.withColumn("_clear", blanked(F.col(text), F.col(pred)))
    rows = covered.select(*keys, "_clear", F.explode_outer(gold).alias("g")).filter("g is not null")
    return rows.select(
        *keys,
        F.col("g.label").alias("label"),
        F.rlike(piece(F.col("_clear"), F.col("g.start"), F.col("g.end")), F.lit(r"[\p{L}\p{N}]")).alias("leaked"),
    )


def leaks(documents: DataFrame, keys, **names) -> DataFrame:
    return leaked_annotations(documents, keys, **names).groupBy("label").agg(
        F.count_if("leaked").alias("leaked"), F.count("*").alias("total")
    )


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def leaks_per_100(leaked: Column, total: Column) -> Column:
    return ratio(100 * leaked, total)


def precision(tp="tp", fp="fp") -> Column:
    return ratio(F.col(tp), F.col(tp) + F.col(fp))


def recall(tp="tp", fn="fn") -> Column:
    return ratio(F.col(tp), F.col(tp) + F.col(fn))


def f1(tp="tp", fp="fp", fn="fn") -> Column:
    p, r = precision(tp, fp), recall(tp, fn)
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def with_scores(counts: DataFrame) -> DataFrame:
    return counts.withColumns({"precision": precision(), "recall": recall(), "f1": f1()})


def latency(samples: DataFrame, value: str, groups=(), points=(("p50", 0.5), ("p95", 0.95))) -> DataFrame:
    """Quantiles by linear interpolation, exact.

    Values are counted, dealt out by range of (group, value), and numbered by running counts within a range and the
    counts of the ranges before; a quantile lies on one or two ranks.  So no task has all values of a group.  Null
    values are left out; a group without any has nulls.
    """
    groups, x = list(groups), F.col(value)
    counts = samples.filter(x.isNotNull()).groupBy(*groups, x.alias("_x")).agg(F.count("*").alias("_n"))
    ranged = stored(counts.repartitionByRange(*groups, "_x").withColumn("_part", F.spark_partition_id()), "ranges")
    # One row for each range and group in it.
    parts = ranged.groupBy(*groups, "_part").agg(F.sum("_n").alias("_held"))
    before = F.sum("_held").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_all", F.sum("_held").over(Window.partitionBy(*groups)))
    same = F.lit(True)
    for g in groups:
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"p.{g}"))
    placed = ranged.alias("r").join(parts.alias("p"), same & (F.col("r._part") == F.col("p._part")))
    placed = placed.select(*[F.col(f"r.{g}").alias(g) for g in groups], "r._part", "_x", "_n", "_before", "_all")
    running = Window.partitionBy(*groups, "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("_last", F.col("_before") + F.sum("_n").over(running)).withColumn("_first", F.col("_last") - F.col("_n"))
    out = []
    for name, q in points:
        at = (F.col("_all") - 1) * F.lit(float(q))
        held = lambda rank: F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_last")), F.col("_x")))
        low, high, part, rest = held(F.floor(at)), held(F.ceil(at)), F.max(at - F.floor(at)), F.max(F.ceil(at) - at)
        out.append(F.when(low == high, low.cast("double")).otherwise(rest * low + part * high).alias(name))
    found = ranked.groupBy(*groups).agg(*out)
    if not groups:
        return found
    every = samples.select(*groups).distinct()
    return every.alias("e").join(found.alias("f"), [F.col(f"e.{g}").eqNullSafe(F.col(f"f.{g}")) for g in groups], "left").select(
        *[F.col(f"e.{g}").alias(g) for g in groups], *[F.col(f"f.{n}").alias(n) for n, _ in points]
    )


def unknown_labels(gold: DataFrame, mapping: DataFrame) -> DataFrame:
    """Annotation labels the mapping does not hold: an evaluation must refuse them."""
    return gold.select("label").distinct().join(mapping, "label", "left_anti")


def mapped(gold: DataFrame, mapping: DataFrame) -> DataFrame:
    """Annotations relabelled with their type; those of no type are left out.

    A mapping has one row per label of an annotation scheme (tens); Spark broadcasts it by its size.
    """
    return (
        gold.join(mapping.filter("type is not null"), "label")
        .drop("label")
        .withColumnRenamed("type", "label")
    )


def report_by_type(gold: DataFrame, pred: DataFrame, mapping: DataFrame, keys) -> DataFrame:
    """One row per mapped type: overlap, strict and any-data scores."""
    typed = mapped(gold, mapping)
    types = mapping.filter("type is not null").select(F.col("type").alias("label")).distinct()
    overlap = with_scores(by_label(overlap_counts(typed, pred, keys)))
    strict = with_scores(by_label(strict_counts(typed, pred, keys))).select(
        "label", *[F.col(c).alias(f"strict_{c}") for c in ("precision", "recall", "f1")]
    )
    touched = any_gold_counts(gold, pred, keys).select(
        "label", precision().alias("any_pii_precision"), F.col("fp").alias("non_pii_fp")
    )
    return (
        overlap.join(types, "label", "left_semi")
        .join(strict, "label", "left")
        .join(touched, "label", "left")
        .na.fill(0, ["non_pii_fp"])
        .na.fill(0.0, ["any_pii_precision"])
    )


def report_by_source(documents: DataFrame, gold, pred, mapping: DataFrame, keys) -> DataFrame:
    """One row per source label, and one for all (label null): n, leaks, recall of its own gold.

    `covered` tells whether the label has a type.  Labels and the total come from one pass.
    """
    # The recall of a label only sees its own annotations: the label is part of the match.
    own = gold.join(mapping.filter("type is not null"), "label").select(
        *keys, "start", "end", F.concat_ws("|", "label", "type").alias("label")
    )
    labels = mapping.filter("type is not null").select("type", F.concat_ws("|", "label", "type").alias("_l"))
    asked = pred.join(labels, F.col("label") == F.col("type")).select(
        *keys, "start", "end", F.col("_l").alias("label")
    )
    found = by_label(overlap_counts(own, asked, keys)).select(
        F.split_part(F.col("label"), F.lit("|"), F.lit(1)).alias("label"), recall().alias("recall")
    )
    leaked = leaked_annotations(documents, keys).join(mapping, "label", "left")
    sets = leaked.groupBy("label", "type").agg(
        F.count("*").alias("n"), F.count_if("leaked").alias("leaks")
    )
    return sets.join(found, "label", "left").withColumn(
        "leaks_per_100", leaks_per_100(F.col("leaks"), F.col("n"))
    )


def overall(by_source: DataFrame) -> DataFrame:
    """Totals of a report by source label: all labels, and those with a type."""
    covered = F.col("type").isNotNull()
    out = by_source.agg(
        F.sum("n").alias("total"),
        F.sum("leaks").alias("leaked"),
        F.coalesce(F.sum(F.when(covered, F.col("n"))), F.lit(0)).alias("covered_total"),
        F.coalesce(F.sum(F.when(covered, F.col("leaks"))), F.lit(0)).alias("covered_leaked"),
    )
    return out.withColumns(
        {
            "leaks_per_100": leaks_per_100(F.col("leaked"), F.col("total")),
            "covered_leaks_per_100": leaks_per_100(F.col("covered_leaked"), F.col("covered_total")),
        }
    )


def unmatched_types(gold: DataFrame, pred: DataFrame, mapping: DataFrame, keys) -> DataFrame:
    """Predicted types no label maps to: detections, and how many touch annotated data."""
    types = mapping.filter("type is not null").select(F.col("type").alias("label")).distinct()
    other = pred.join(types, "label", "left_anti")
    return touches(other, gold, keys).groupBy("label").agg(
        F.count("*").alias("detections"), F.count_if("touches").alias("overlapping_gold")
    )


def at_thresholds(entities: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Entities scored once, repeated for each threshold their score is above (at most four)."""
    levels = F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("score") > t)
    return entities.withColumn("threshold", F.explode_outer(levels)).filter("threshold is not null")


def merged_at_thresholds(entities: DataFrame, keys, thresholds=THRESHOLDS) -> DataFrame:
    """keys, threshold, label, start, end, score: islands of overlapping entities, for every threshold at once.

    Entities come from overlapping windows of a text and are scored once; at a threshold those scored above it count,
    and what overlaps under one label becomes one span (touching ones stay apart).  All thresholds share one shuffle
    and one sort: each has its own running end.  Entities without a score count at none.
    """
    in_order = Window.partitionBy(*keys, "label").orderBy("start", "end", "score")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = [F.col("score") > t for t in thresholds]
    opens = {}
    for i, kept in enumerate(over):
        free = F.coalesce(F.col("start") >= F.max(F.when(kept, F.col("end"))).over(before), F.lit(True))
        opens[f"_new{i}"] = F.when(kept & free, 1).otherwise(0)
    islands = {f"_island{i}": F.sum(f"_new{i}").over(upto) for i in range(len(over))}
    levels = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.when(kept, F.col(f"_island{i}")).alias("island"))
            for i, (t, kept) in enumerate(zip(thresholds, over))
        ]
    )
    placed = entities.select(*keys, "label", "start", "end", "score").withColumns(opens).withColumns(islands)
    rows = placed.select(*keys, "label", "start", "end", "score", F.explode(levels).alias("_at")).filter("_at.island is not null")
    return (
        rows.groupBy(*keys, "label", F.col("_at.threshold").alias("threshold"), F.col("_at.island").alias("_island"))
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"))
        .select(*keys, "threshold", "label", "start", "end", "score")
    )


def types_by(by: str, values, gold: DataFrame, pred: DataFrame, mapping: DataFrame, keys) -> DataFrame:
    """A report by type for each value of the column `by` of the predictions (a threshold, a tool).

    by, label, tp, fp, fn, precision, recall, f1, the strict ones, any_pii_precision and non_pii_fp.  Types without
    annotation and prediction have no row; a value without predictions still has its missed annotations.
    """
    levels = F.explode(F.array(*map(F.lit, values))).alias(by)
    typed, at = mapped(gold, mapping).select("*", levels), [by, *keys]

    def summed(counts: DataFrame) -> DataFrame:
        return with_scores(counts.groupBy(by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))

    overlap = summed(overlap_counts(typed, pred, at))
    strict = summed(strict_counts(typed, pred, at)).select(
        by, "label", *[F.col(c).alias(f"strict_{c}") for c in ("precision", "recall", "f1")]
    )
    touched = touches(pred.select(*keys, by, "label", "start", "end"), gold, keys).groupBy(by, "label").agg(
        ratio(F.count_if("touches"), F.count("*")).alias("any_pii_precision"), F.count_if(~F.col("touches")).alias("non_pii_fp")
    )
    types = mapping.filter("type is not null").select(F.col("type").alias("label")).distinct()
    joined = overlap.join(types, "label", "left_semi").join(strict, [by, "label"]).join(touched, [by, "label"], "left")
    return joined.na.fill(0, ["non_pii_fp"]).na.fill(0.0, ["any_pii_precision"])


def leaks_by(by: str, values, documents: DataFrame, gold: DataFrame, pred: DataFrame, mapping: DataFrame, keys, text: str = "text") -> DataFrame:
    """Leaks for each value of `by`: a row per source label, and one for all of them, in one pass (grouping sets).

    by, label, whole, documents, total, leaked, covered_total, covered_leaked.  The row for all has `whole` true and a
    null label; it alone counts documents, those without annotations included.  Texts are joined to their spans once.
    """
    place = ["start", "end"]
    marked = gold.groupBy(*keys).agg(F.collect_list(F.struct("label", *place)).alias("_gold"))
    found = pred.groupBy(*keys).agg(F.collect_list(F.struct(by, *place)).alias("_pred"))
    rows = documents.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.join(marked, keys, "left").join(found, keys, "left")
    some = F.coalesce("_pred", F.array().cast(found.schema["_pred"].dataType))

    def cleared(value):
        own = F.filter(some, lambda p: p[by] == F.lit(value))
        return F.struct(F.lit(value).alias(by), blanked(F.col("_text"), own).alias("clear"))

    clear = F.array(*map(cleared, values))
    # Generators keep the blanked text as a value: it is made once for a document and value.
    rows = rows.select("_gold", F.explode(clear).alias("_c")).select("_c.*", F.posexplode_outer("_gold").alias("_n", "_g"))
    open_ = F.rlike(piece(F.col("clear"), F.col("_g.start"), F.col("_g.end")), F.lit(r"[\p{L}\p{N}]"))
    judged = rows.select(by, F.col("_g.label").alias("label"), (F.coalesce("_n", F.lit(0)) == 0).alias("_first"), open_.alias("_leaked"))
    judged = judged.join(mapping.select("label", "type"), "label", "left")
    covered = F.col("type").isNotNull()
    sets = judged.groupingSets([[by, "label"], [by]], by, "label").agg(
        (F.grouping("label") == 1).alias("whole"),
        F.count_if("_first").alias("documents"),
        F.count("_leaked").alias("total"),
        F.count_if("_leaked").alias("leaked"),
        F.count(F.when(covered, F.col("_leaked"))).alias("covered_total"),
        F.count_if(covered & F.col("_leaked")).alias("covered_leaked"),
    )
    return sets.filter("whole or label is not null")


def threshold_rows(by_type: DataFrame, leaked: DataFrame, floor: float = PRECISION_FLOOR) -> DataFrame:
    """One row per threshold from `types_by` and `leaks_by`: leaks, and all figures of the floor types with their flags.

    A floor type without a row has zeros.
    """
    figures = [
        *[F.max(c).alias(c) for c in ("precision", "recall", "strict_precision", "strict_recall", "tp", "fp", "fn")],
        F.max(F.col("tp") + F.col("fn")).alias("gold"),
        *[F.max(c).alias(c) for c in ("any_pii_precision", "non_pii_fp")],
    ]
    figured = by_type.groupBy("threshold").pivot("label", list(FLOOR_TYPES)).agg(*figures).na.fill(0)
    flags = {}
    for entity in FLOOR_TYPES:
        flags[f"{entity}_meets_floor"] = F.col(f"{entity}_any_pii_precision") >= floor
        flags[f"{entity}_meets_floor_by_type"] = F.col(f"{entity}_precision") >= floor
    totals = leaked.filter("whole").select(
        "threshold",
        "documents",
        leaks_per_100(F.col("leaked"), F.col("total")).alias("leaks_per_100"),
        leaks_per_100(F.col("covered_leaked"), F.col("covered_total")).alias("covered_leaks_per_100"),
    )
    return totals.join(figured.withColumns(flags), "threshold")


def floor_flags(by_type: DataFrame, floor: float = PRECISION_FLOOR) -> DataFrame:
    """One row per threshold from `by_type(threshold, label, precision, any_pii_precision...)`."""
    named = by_type.groupBy("threshold").pivot("label", list(FLOOR_TYPES)).agg(
        F.max("precision").alias("precision"), F.max("any_pii_precision").alias("any_pii_precision")
    )
    filled = named.na.fill(0.0)
    flags = {}
    for entity in FLOOR_TYPES:
        flags[f"{entity}_meets_floor"] = F.col(f"{entity}_any_pii_precision") >= floor
        flags[f"{entity}_meets_floor_by_type"] = F.col(f"{entity}_precision") >= floor
    return filled.withColumns(flags)


def choose_threshold(rows: DataFrame) -> DataFrame:
    """threshold, floor_met: fewest covered leaks among those over the floor, a tie to the higher;
    with none over it, the most precise weakest type.

    `rows` has one row per candidate threshold: a handful.
    """
    good = F.col("PERSON_meets_floor") & F.col("ADDRESS_meets_floor")
    weakest = F.least("PERSON_any_pii_precision", "ADDRESS_any_pii_precision")
    best = F.struct(
        good.cast("int").alias("good"),
        F.when(good, -F.col("covered_leaks_per_100")).otherwise(weakest).alias("by"),
        F.col("threshold").alias("threshold"),
    )
    return rows.agg(F.max(best).alias("b")).select(
        F.col("b.threshold").alias("threshold"), (F.col("b.good") == 1).alias("floor_met")
    )


def shared_types(gold: DataFrame, mapping: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Types both tools cover and the data annotates: type."""
    annotated = mapped(gold, mapping).select(F.col("label").alias("type")).distinct()
    return annotated.intersect(ours.select("type")).intersect(theirs.select("type"))


def tool_labels(pred: DataFrame, mapping: DataFrame) -> DataFrame:
    """Another tool's predictions under our types; a type without one keeps the tool's name.

    The mapping holds every type the tool can return: see `unknown_labels`.
    """
    types = mapping.select("label", F.col("type").alias("_type"))
    return pred.join(types, "label", "left").withColumn(
        "label", F.coalesce("_type", "label")
    ).drop("_type")


def leak_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Leaks of two runs side by side, by label."""
    a = before.select("label", F.col("leaked").alias("leaked_before"), F.col("total").alias("total_before"))
    b = after.select("label", F.col("leaked").alias("leaked_after"), F.col("total").alias("total_after"))
    joined = a.join(b, "label", "full").na.fill(0)
    return joined.withColumn("delta", F.col("leaked_after") - F.col("leaked_before"))
