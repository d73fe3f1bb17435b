"""Names: a dictionary's, or those a model scored.  Both give spans of the name layer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import gcd
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StructType

from velaria.functions.spans import char_at, let, piece
from velaria.functions.views import detector_view, model_view
from velaria.operators import needles
from velaria.session import stored

# --- Fixed values: windows a model reads ------------------------------------------------------
WINDOW_TOKENS = 200
OVERLAP_TOKENS = 50
MAX_TOKEN_CHARS = 40
MAX_WINDOWS = 1024  # of one scope: beyond it the scope is blocked, as a whole
TOKEN = rf"[\p{{L}}\p{{N}}_]{{1,{MAX_TOKEN_CHARS}}}|[^\p{{L}}\p{{N}}_\s\p{{Z}}\x1C-\x1F\x85]"
RUN = r"[\p{L}\p{N}]+"


def _edge(text: Column, at: Column) -> Column:
    return ~F.rlike(char_at(text, at), F.lit(r"[\p{L}\p{N}]"))


def find_names(texts: DataFrame, names: DataFrame, keys, text: str = "text") -> DataFrame:
    """Dictionary names in the texts: keys, start, end, label, name, in offsets of `text`.

    `names(name, label)`.  A name is found where it stands with no letter or digit at its edges,
    so its first word is a whole word of the text.  Words are hashed where the text is, and only
    those that may be a name's first one meet the names, in an equi-join on that word.  A name
    that is one word is found by that; for longer ones the texts that met one are read again.
    """
    keys = list(keys)
    word = F.regexp_extract("name", RUN, 0)
    keyed = names.filter(F.col("name") != "").select(
        "name",
        "label",
        word.alias("word"),
        F.length(F.regexp_extract("name", rf"\A([^\p{{L}}\p{{N}}]*)", 1)).alias("_shift"),
        (word == F.col("name")).alias("_alone"),
    )
    keyed = stored(keyed.filter("word <> ''").distinct(), "names")
    hashes = keyed.select(needles.needle_hash("word", F.lit(needles.WORD)).alias("h")).distinct()
    met = needles.placed_words(texts, keys, F.col(text), hashes).join(keyed, "word")
    start = F.col("at") - F.col("_shift")
    end = start + F.length("name")
    placed = [*keys, start.cast("int").alias("start"), end.cast("int").alias("end"), "label", "name"]
    found = met.filter("_alone").select(*placed)
    if not keyed.filter("not _alone").isEmpty():
        longer = stored(met.filter("not _alone").select(*placed), "longer")
        read = needles.only_maybe(texts, longer, keys).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).alias("_text"))
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        said = piece(F.col("_text"), F.col("start"), F.col("end"))
        longer = (
            longer.join(read, same)
            .filter((F.col("start") >= 0) & (said == F.col("name")))
            .filter(_edge(F.col("_text"), F.col("start") - 1) & _edge(F.col("_text"), F.col("end")))
        )
        found = found.unionByName(longer.select(*keys, "start", "end", "label", "name"))
    return found.distinct()


def windows_of(view: Column, window: int = WINDOW_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """array<struct<start,end>>: overlapping windows over every token of the text.

    Windows start and end with blocks of tokens, so only the places of blocks are summed up, not those of tokens.
    """
    step = window - overlap
    unit = gcd(window, step)

    def block(c, b):
        return F.length(F.array_join(F.slice(c, (b * unit + 1).cast("int"), F.lit(unit)), ""))

    def cut(c):
        size = F.size(c["tokens"])
        count = F.when(size <= window, 1).otherwise(F.ceil((size - window) / step) + 1).cast("int")
        # A gap stands before each token; the one behind the last is no token's.
        gaps = F.slice(c["gaps"], F.lit(1), size)
        sizes = F.transform(F.sequence(F.lit(0), F.ceil(size / unit).cast("int") - 1), lambda b: block(gaps, b) + block(c["tokens"], b))
        ends = F.aggregate(sizes, F.array(F.lit(0)), lambda p, n: F.concat(p, F.array(F.element_at(p, -1) + n)))

        def placed(p):
            return F.transform(
                F.sequence(F.lit(0), count - 1),
                lambda i: F.struct(
                    (F.element_at(p, (i * (step // unit) + 1).cast("int")) + F.length(F.element_at(c["gaps"], i * step + 1))).alias("start"),
                    F.element_at(p, F.least(i * (step // unit) + window // unit + 1, F.size(p)).cast("int")).alias("end"),
                ),
            )

        return F.when(size > 0, let(ends, placed)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    tokens = F.regexp_extract_all(view, F.lit(TOKEN), F.lit(0))
    return let(F.struct(tokens.alias("tokens"), F.split(view, TOKEN, -1).alias("gaps")), cut)


def windows(texts: DataFrame, keys, text: str = "text") -> DataFrame:
    """One row per window: keys, window, start, window_text, for a scorer to read.

    Equal texts are windowed once: score the distinct texts and join back (`distinct_texts`).
    """
    viewed = texts.withColumn("_view", model_view(detector_view(F.col(text))))
    cut = viewed.select(*keys, "_view", F.posexplode_outer(windows_of(F.col("_view"))).alias("window", "w"))
    return cut.filter("w is not null").select(
        *keys,
        "window",
        F.col("w.start").alias("start"),
        piece(F.col("_view"), F.col("w.start"), F.col("w.end")).alias("window_text"),
    )


@pandas_udf(ArrayType(StructType().add("first", IntegerType()).add("last", IntegerType())))
def pieces_under_budget(counts: pd.Series, budget: pd.Series, overlap: pd.Series) -> pd.Series:
    """Word ranges of at most `budget` model tokens; null when a word alone is over it.

    Each range starts up to `overlap` words before the end of the one before, sharing at most
    half the budget.
    """

    def ranges(sizes, limit, shared_words):
        if sizes is None or limit < 1 or max(sizes, default=0) > limit:
            return None
        # Tokens before each word: a range's ends are searches in sorted numbers.
        before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        out, first, words = [], 0, len(sizes)
        while first < words:
            last = int(np.searchsorted(before, before[first] + limit, "right")) - 1
            out.append({"first": first, "last": last})
            half = int(np.searchsorted(before, before[last] - limit // 2))
            first = words if last == words else max(first + 1, last - shared_words, half)
        return out

    return pd.Series([ranges(*row) for row in zip(counts, budget, overlap)])


def distinct_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Each different text once, by its hash: what a scorer or a scan has to read."""
    return texts.select(F.sha2(F.col(text), 256).alias("text_hash"), text).dropDuplicates(["text_hash"])


def new_texts(texts: DataFrame, store: DataFrame, text: str = "text") -> DataFrame:
    """Distinct texts whose spans are not in a span store yet (keyed by `text_hash`)."""
    return distinct_texts(texts, text).join(store.select("text_hash").distinct(), "text_hash", "left_anti")


Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
ENTITY_FIELDS = "start int, end int, label string, score double"


def score_windows(window_table: DataFrame, scorer: Scorer, keys) -> DataFrame:
    """A model plugged in: `scorer` maps batches of windows to batches of scored entities.

    It must keep the key columns and `window`, and return start, end, label, score in offsets of
    the window text.
    """
    kept = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}"
        for f in window_table.schema.fields
        if f.name in (*keys, "window")
    )
    return window_table.mapInPandas(scorer, f"{kept}, {ENTITY_FIELDS}")


def malformed(entities: DataFrame, window_table: DataFrame, keys, labels) -> DataFrame:
    """Keys with an entity outside its window, of an unknown label or with a bad score."""
    sizes = window_table.select(*keys, "window", F.length("window_text").alias("_size"))
    bad = ~F.coalesce(
        (F.col("start") >= 0)
        & (F.col("start") < F.col("end"))
        & (F.col("end") <= F.col("_size"))
        & F.col("label").isin(list(labels))
        & ~F.isnan("score")
        & F.col("score").between(0, 1),
        F.lit(False),
    )
    return entities.join(sizes, [*keys, "window"], "left").filter(bad).select(*keys).distinct()


def merge_windows(entities: DataFrame, window_table: DataFrame, keys) -> DataFrame:
    """Entities in text offsets; those of one label that overlap are joined, with the best score."""
    starts = window_table.select(*keys, "window", F.col("start").alias("_from"))
    placed = entities.join(starts, [*keys, "window"]).select(
        *keys,
        (F.col("start") + F.col("_from")).cast("int").alias("start"),
        (F.col("end") + F.col("_from")).cast("int").alias("end"),
        "label",
        "score",
    )
    return merge_overlapping(placed, keys)


def merge_overlapping(placed: DataFrame, keys) -> DataFrame:
    """Islands of overlapping entities of one label in one text (touching ones stay apart)."""
    in_order = Window.partitionBy(*keys, "label").orderBy("start", "end", "score")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int")
    return (
        placed.withColumn("_new", new)
        .withColumn("_island", F.sum("_new").over(upto))
        .groupBy(*keys, "label", "_island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"))
        .drop("_island")
    )


def as_name_spans(entities: DataFrame, keys, label_types: dict[str, str], threshold: float = 0.0):
    """One row per text with `names`: its entities at or over the threshold as name spans."""
    kind = F.create_map(*[F.lit(x) for pair in label_types.items() for x in pair])
    spans = F.struct(
        "start",
        "end",
        F.element_at(kind, F.col("label")).alias("type"),
        F.lit("NER").alias("layer"),
        F.lit("MEDIUM").alias("confidence"),
    )
    return (
        entities.filter((F.col("score") >= threshold) & F.col("label").isin(list(label_types)))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(spans)).alias("names"))
    )
