"""Benchmark passages in documents, by a prefix-filtered set join in DataFrame operations only.

A window is 13 consecutive words of an item (an item of fewer words is one window); it is the set of its
three-word shingles.  A document contains the window only if it has all of them, so the necessary prefix
is one shingle: the window's rarest in the corpus.  Documents' shingles are joined with these prefixes;
the place of a match bounds where the window would begin and end, and the words there are compared.

Windows and their shingles are broadcast in blocks of at most `block` rows; more windows take more blocks.
Null texts and texts without words have no hits; rows with a null id are told apart by their text, and
repeated rows get equal results.  An empty benchmark leaves every document clean.  Other columns of the
inputs are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from velaria.llm import common

WINDOW = 13
SHINGLE = 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ROW = ["doc_id", "text_key"]


def words(text: Column) -> Column:
    """Lower-cased words; null has none."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), SEPARATORS), "")


def windows_of(items: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window_id, size, words) and which items have them (window_id, item_id)."""
    cut = items.select(F.col(f"`{key}`").alias("item_id"), words(F.col(f"`{text}`")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    at = cut.select("item_id", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    found = at.select("item_id", "size", F.slice("w", F.col("at"), F.col("size")).alias("words")).distinct()
    found = common.written(found, "item-windows")
    distinct = common.written(
        found.select("size", "words").distinct().select(F.monotonically_increasing_id().alias("window_id"), "size", "words"), "windows"
    )
    return distinct, common.written(found.join(distinct, ["size", "words"]).select("window_id", "item_id"), "window-items")


def _shingle(array: str, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(F.col(array), at + k) for k in range(width)])


def _documents(df: DataFrame, text: str, key: str) -> DataFrame:
    body = F.col(f"`{text}`")
    return df.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(body).alias("text_key"), words(body).alias("w"))


def _matches(df: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """(row, window_id, start, size) of every occurrence of these windows, all of shingles of `width` words."""
    own = windows.select(
        "window_id", "size", "words", F.explode(F.sequence(F.lit(0), F.col("size") - width)).alias("place")
    ).withColumn("shingle", _shingle("words", F.col("place"), width))
    own = common.written(own.select("window_id", "size", "place", "shingle", "words"), "window-shingles")
    placed = df.select(*ROW, "w", F.posexplode("w").alias("at", "word")).withColumn(
        "shingle", _shingle("w", F.col("at"), width)
    )
    counts = placed.join(F.broadcast(own.select("shingle").distinct()), "shingle").groupBy("shingle").agg(F.count("*").alias("n"))
    rarest = (
        own.join(counts, "shingle", "left")
        .withColumn("nth", F.row_number().over(Window.partitionBy("window_id").orderBy(F.coalesce("n", F.lit(0)), "shingle", "place")))
        # A shingle that no document has rules the window out.
        .where("nth = 1 and n > 0")
    )
    prefix = common.written(rarest.select("shingle", "window_id", "size", "place", "words"), "prefixes")
    start = F.col("at") - F.col("place")
    return (
        placed.join(F.broadcast(prefix), "shingle")
        .where(
            (start >= 0)
            & (start + F.col("size") <= F.size("w"))
            & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("words"))
        )
        .select(*ROW, "window_id", start.alias("start"), "size")
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
    share: tuple[int, int] = (1, 20),
    block: int = 100_000,
) -> DataFrame:
    """Per row of `docs`: doc_id, text_key, n_words, n_hit, n_items, items_sha256 and contaminated."""
    windows, having = windows_of(items, item_text, item_key)
    rows = _documents(docs, text, key)
    sizes = {min(r["size"], SHINGLE): r["n"] for r in windows.groupBy(F.least("size", F.lit(SHINGLE)).alias("size")).agg(F.count("*").alias("n")).collect()}
    found = None
    for width, n in sorted(sizes.items()):
        own = windows.where(F.least("size", F.lit(SHINGLE)) == width)
        blocks = -(-n // block)
        for b in range(blocks):
            some = own.where(F.pmod(F.xxhash64("window_id"), F.lit(blocks)) == b) if blocks > 1 else own
            part = _matches(rows, some, width)
            found = part if found is None else found.unionByName(part)
    counted = rows.select(*ROW, F.size("w").cast("long").alias("n_words"))
    if found is None:
        nothing = counted.limit(0)
        hits = nothing.select(*ROW, F.lit(0).cast("long").alias("n_hit"))
        kinds = nothing.select(*ROW, F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items_sha256"))
    else:
        found = common.written(found, "matches").distinct()
        before = Window.partitionBy(*ROW).orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
        end = F.col("start") + F.col("size")
        reached = F.coalesce(F.max(end).over(before), F.lit(0))
        hits = (
            found.select(*ROW, "start", "size").distinct()
            .withColumn("new", F.greatest(end - F.greatest(F.col("start"), reached), F.lit(0)))
            .groupBy(*ROW).agg(F.sum("new").cast("long").alias("n_hit"))
        )
        kinds = (
            found.select(*ROW, "window_id").distinct().join(having, "window_id").select(*ROW, F.col("item_id").cast("string").alias("item"))
            .groupBy(*ROW).agg(F.sort_array(F.collect_set("item")).alias("items"))
            .select(*ROW, F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
        )
    both = hits.join(kinds, hits["doc_id"].eqNullSafe(kinds["doc_id"]) & (hits["text_key"] == kinds["text_key"])).select(
        hits["doc_id"].alias("d"), hits["text_key"].alias("t"), "n_hit", "n_items", "items_sha256"
    )
    out = counted.join(both, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        *ROW,
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (share[1] * n_hit >= share[0] * F.col("n_words"))).alias("contaminated"),
    )
