"""Near duplicates by b-bit MinHash, with every link confirmed on whole shingle sets.

1. One pass gives each text the size of its shingle set, a 128-bit key of the set, band keys, and the low
   bits of its minima packed in a few longs.  Texts with equal sets form a class; its smallest id stands
   for it, so any number of copies is one row from here on.
2. Representatives that share a band are compared with two hubs of the bucket (its smallest id, and one by
   hash); the estimate from the packed bits (bit counts, corrected for chance collisions) spares most
   sets.  What passes is confirmed on full sets, and links are merged to components.
3. Then every pair that shares a band and lies in two components is compared too, once, so that no link
   that could join components is left out.  Pairs are pairs of ids until they are distinct; signatures and
   sets come after.  They aren't paired by bucket: the shingles of such texts are ordered by rarity, and texts meet
   on the few rarest, of which similar sets must share one early enough (an exact prefix and position filter).

Bands follow from the threshold, so that a pair at it shares no band with probability below 3e-7: 48 of 8 rows
for 0.85, 64 of 7 for 0.80.
Shingles are 64-bit hashes of five words; a text of fewer words is one shingle, one without words has
none and is linked with nothing.  Null text has no words.  Rows with a null id take part as copies only
(their component is their class's); repeated rows get equal results; classes with the same smallest id
count as linked.  An empty table gives an empty result; input columns named like results give way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from velaria.llm import common

WORDS = 5
BITS = 2
PER_LONG = 64 // BITS
MISSED, MOST_HASHES = 3e-7, 448
SET_KEY = ["n_shingles", "key_a", "key_b"]
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Bands(NamedTuple):
    """How signatures are made and read for a threshold."""

    count: int
    rows: int
    hashes: int
    least_estimate: float

    @classmethod
    def of(cls, threshold: tuple[int, int]) -> Bands:
        """The longest bands that need `MOST_HASHES` at most; estimates from five standard errors under the threshold on count."""
        s = threshold[0] / threshold[1]
        if not 0 < s < 1:
            raise ValueError("a threshold lies between 0 and 1")
        needed = lambda rows: math.ceil(math.log(MISSED) / math.log1p(-(s**rows)))
        rows = 1
        while needed(rows + 1) * (rows + 1) <= MOST_HASHES:
            rows += 1
        hashes = -(-needed(rows) * rows // PER_LONG) * PER_LONG
        chance = 1 / (1 << BITS)
        agree = s + (1 - s) * chance
        error = math.sqrt(agree * (1 - agree) / hashes) / (1 - chance)
        return cls(needed(rows), rows, hashes, math.floor(100 * (s - 5 * error)) / 100)


def shingle_sets(words: common.Words, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, ascending within it; where each row's begin."""
    h, of, count = words.hashes(), words.of, words.counts()
    per_row = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros(begin[-1], np.uint64)
    row = np.repeat(np.arange(len(count)), per_row)
    long = (count >= size)[row]
    first = of[row] + np.arange(len(row)) - begin[row]
    step, total = np.uint64(1), np.zeros(int(long.sum()), np.uint64)
    at = first[long]
    for k in range(size):
        total += h[at + k] * step
        step = np.uint64((int(step) * int(_GOLDEN)) & 0xFFFFFFFFFFFFFFFF)
    out[long] = common.splitmix(total)
    for r in np.flatnonzero((count > 0) & (count < size)).tolist():
        value, step = int(count[r]), 1
        for x in h[of[r] : of[r + 1]].tolist():
            step = (step * int(_GOLDEN)) & 0xFFFFFFFFFFFFFFFF
            value = (value + x * step) & 0xFFFFFFFFFFFFFFFF
        out[begin[r]] = common.splitmix(np.array([value], np.uint64))[0]
    order = np.argsort(out)
    order = order[np.argsort(row[order].astype(np.uint32), kind="stable")]
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[new], row[new]
    return out, np.searchsorted(row, np.arange(len(count) + 1))


def _set_keys(sets: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(
        common.sum_rows(common.splitmix(sets ^ np.uint64(seed)), of).view(np.int64) for seed in (0x5BD1E995, 0xC2B2AE3D27D4EB4F)
    )


def _odd(n: int) -> np.ndarray:
    return (common.splitmix(np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minima(sets: np.ndarray, of: np.ndarray, hashes: int) -> np.ndarray:
    """The least of each hash function over each row's set; rows without shingles get zeros."""
    low, high = sets.astype(np.uint32), (sets >> np.uint64(32)).astype(np.uint32)
    some = np.flatnonzero(np.diff(of))
    out = np.zeros((len(of) - 1, hashes), np.uint32)
    if len(some):
        begin, mixed = of[:-1][some], np.empty_like(low)
        for i, odd in enumerate(_odd(hashes)):
            np.multiply(low, odd, out=mixed)
            mixed += high
            out[some, i] = np.minimum.reduceat(mixed, begin)
    return out


def band_keys(least: np.ndarray, bands: Bands) -> np.ndarray:
    keys = np.repeat(np.arange(1, bands.count + 1, dtype=np.uint64)[None, :] * _GOLDEN, len(least), 0)
    for r in range(bands.rows):
        keys = common.splitmix(keys ^ least[:, r : bands.count * bands.rows : bands.rows].astype(np.uint64)) + _GOLDEN
    return keys.view(np.int64)


def low_bits(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, each mixed by a bijection first, packed in longs."""
    bits = common.splitmix(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    shift = np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(bits.reshape(len(least), -1, PER_LONG) << shift, axis=2).view(np.int64)


def signatures(df: DataFrame, bands: Bands, text: str = "text", key: str = "doc_id") -> DataFrame:
    def make():
        def chunk(texts: pa.Array, extras: dict) -> list[pa.Array]:
            sets, of = shingle_sets(common.words_of(texts, lower=True))
            a, b = _set_keys(sets, of)
            least = minima(sets, of, bands.hashes)
            rows = len(texts)
            return [
                extras[key].cast(pa.int64()),
                pa.array(np.diff(of)),
                pa.array(a),
                pa.array(b),
                common.listed(band_keys(least, bands).reshape(-1), np.arange(rows + 1) * bands.count),
                common.listed(low_bits(least).reshape(-1), np.arange(rows + 1) * (bands.hashes // PER_LONG)),
            ]

        return chunk

    new = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>, packed array<long>"
    # Short texts have many minima for each byte: chunks are small.
    return common.map_text(df, text, new, make, keep=[], extra=(key,), chunk_bytes=1 << 20)


def estimate(a: Column, b: Column, hashes: int) -> Column:
    """Similarity from packed bits: agreeing fields, less those that agree by chance."""
    field = F.lit(sum(1 << (BITS * i) for i in range(PER_LONG)) - (1 << 64 if BITS == 1 else 0))
    differ = F.lit(0)
    for k in range(hashes // PER_LONG):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        spread = x
        for i in range(1, BITS):
            spread = spread.bitwiseOR(F.shiftrightunsigned(x, i))
        differ = differ + F.bit_count(spread.bitwiseAND(field))
    chance = 1 / (1 << BITS)
    return ((F.lit(1.0) - differ / hashes) - chance) / (1 - chance)


# ------------------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, by alternating large-star and small-star steps.

    `edges` has two columns, the ends; only nodes that some edge joins with a smaller one are listed.
    """
    both = edges.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    step = common.written(both, "edges")
    while True:
        ways = step.select("u", "v").union(step.select(F.col("v"), F.col("u")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = least.select("u", F.col("m").alias("v")).union(moved).distinct()
        after = common.written(small, "edges")
        # Done when every node hangs on a root that hangs on none.
        chained = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        twice = after.groupBy("u").count().where("count > 1")
        step = after
        if chained.isEmpty() and twice.isEmpty():
            return step.select(F.col("u").alias("node"), F.col("v").alias("component"))


# ------------------------------------------------------------------------- the operator


def bitmap_of(ids: DataFrame, most_bits: int = 1 << 27) -> np.ndarray:
    """A bitmap of hashed ids, at most `most_bits` long; rows it lets through wrongly go in a later join."""
    bits = 1 << 20
    n = ids.count()
    while bits < 16 * n and bits < most_bits:
        bits <<= 1
    slots = ids.select(F.pmod(F.xxhash64("id"), F.lit(bits)).alias("slot"))
    rows = slots.selectExpr("cast(slot div 32 as int) word", "shiftleft(1L, cast(slot % 32 as int)) bit")
    words = np.zeros(bits // 32, np.uint32)
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return words


def _whole_sets(df: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """rep and its full set, for the wanted representatives (rep, n_shingles, key_a, key_b)."""
    words = bitmap_of(wanted.select(F.col("rep").alias("id")).distinct())
    shared = df.sparkSession.sparkContext.broadcast(words)
    bits = len(words) * 32

    def make():
        bitmap = shared.value

        def chunk(texts: pa.Array, extras: dict) -> list[pa.Array]:
            slot = extras["__slot"].to_numpy()
            keep = (bitmap[slot // 32] >> (slot % 32).astype(np.uint32)) & np.uint32(1)
            chosen = pa.array(np.where(keep, np.arange(len(texts)), -1), mask=keep == 0)
            sets, of = shingle_sets(common.words_of(texts.take(chosen).fill_null(""), lower=True))
            a, b = _set_keys(sets, of)
            return [extras["__id"], pa.array(np.diff(of)), pa.array(a), pa.array(b), common.listed(sets.view(np.int64), of)]

        return chunk

    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("__id"), F.col(f"`{text}`").alias("__body")
    ).withColumn("__slot", F.pmod(F.xxhash64("__id"), F.lit(bits))).where("__id is not null")
    new = "rep long, n_shingles long, key_a long, key_b long, shingles array<long>"
    sets = common.map_text(rows, "__body", new, make, keep=[], extra=("__id", "__slot")).where("n_shingles > 0")
    return sets.join(wanted, ["rep", *SET_KEY], "left_semi").dropDuplicates(["rep", *SET_KEY]).select("rep", "shingles")


def _sets_for(df: DataFrame, ends: DataFrame, classes: DataFrame, text: str, key: str) -> DataFrame:
    wanted = common.written(classes.join(ends.distinct(), "rep").select("rep", *SET_KEY), "wanted")
    return common.written(_whole_sets(df, wanted, text, key), "sets")


def _similar(a: Column, b: Column, threshold: tuple[int, int]) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return threshold[1] * shared >= threshold[0] * (F.size(a) + F.size(b) - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Those of `pairs` (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(right, "b").join(left, "a")
    return both.where(_similar(F.col("set_a"), F.col("set_b"), threshold)).select("a", "b").distinct()


def _merge(links: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Components of links beside those already known."""
    return components(links if comp is None else links.union(comp.select(F.col("node"), F.col("component"))))


def _shared_buckets(named: DataFrame) -> DataFrame:
    """rep, band and bucket, of buckets with more than one text.

    Buckets are counted before anything is sent (most hold one text); a bitmap then lets through what may be shared.
    """
    shared = common.written(
        named.select(F.explode("bands").alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "shared"
    )
    bitmap = bitmap_of(shared)
    slots, words = F.pmod(F.xxhash64("bucket"), F.lit(len(bitmap) * 32)), named.sparkSession.sparkContext.broadcast(bitmap)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy()
            hit = (words.value[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1) == 1
            yield batch.select(["rep", "band", "bucket"]).filter(pa.array(hit))

    rows = named.select("rep", F.posexplode("bands").alias("band", "bucket")).select("*", slots.alias("slot"))
    rows = rows.mapInArrow(maybe, "rep long, band int, bucket long")
    return common.written(rows.join(shared.withColumnRenamed("id", "bucket"), "bucket", "left_semi").select("rep", "band", "bucket"), "buckets")


def _pairs_in(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different components that meet in a bucket."""
    one = rows.select("bucket", F.col("rep").alias("a"), F.col("component").alias("component_a"))
    two = rows.select("bucket", F.col("rep").alias("b"), F.col("component").alias("component_b"))
    met = one.join(two, "bucket").where((F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")))
    return met.select("a", "b").distinct()


def _similar_pairs(pairs: DataFrame, bits: DataFrame, bands: Bands) -> DataFrame:
    """Those of `pairs` that are estimated similar."""
    found = pairs.join(bits.withColumnsRenamed({"rep": "a", "packed": "p"}), "a").join(bits.withColumnsRenamed({"rep": "b", "packed": "q"}), "b")
    return found.where(estimate(F.col("p"), F.col("q"), bands.hashes) >= bands.least_estimate).select("a", "b")


def _meeting_on_rare(sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Distinct pairs (a, b) of different components that share one of the rarest shingles of each.

    Sets of sizes x <= y that are similar enough share at least t * y shingles.  With all shingles in one order, two such
    sets share one among the first x - ceil(t * x) + 1 of each, whatever the order; by rarity, few others do.  What
    follows the first one they share must be enough for t / (1 + t) of both sizes: pairs that meet later are left out,
    since similar ones have met before.
    """
    n = F.size("shingles")
    tokens = sets.select("rep", F.explode("shingles").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("texts"))
    ordered = tokens.join(counts, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("texts", "token"))).alias("by_rarity"))
    first = n - F.ceil(n * threshold[0] / F.lit(threshold[1])).cast("int") + 1
    rows = sets.join(ordered, "rep").select("rep", "component", n.alias("n"), F.posexplode(F.slice("by_rarity", 1, first)).alias("at", "t"))
    rows = rows.select("rep", "component", "n", (F.col("n") - F.col("at")).alias("left"), "t.texts", "t.token")
    rows = common.written(rows.where("texts > 1").drop("texts"), "rare")
    names = ("rep", "component", "n", "left")
    one = rows.select("token", *[F.col(c).alias(f"{c}_a") for c in names])
    two = rows.select("token", *[F.col(c).alias(f"{c}_b") for c in names])
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    enough = (threshold[0] + threshold[1]) * F.least("left_a", "left_b") >= threshold[0] * (F.col("n_a") + F.col("n_b"))
    met = one.join(two, "token").where(
        (F.col("rep_a") < F.col("rep_b")) & (F.col("component_a") != F.col("component_b")) & (threshold[1] * least >= threshold[0] * most) & enough
    )
    return met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def near_duplicates(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    threshold: tuple[int, int] = (85, 100),
    least_estimate: float | None = None,
    many_pairs: int = 0,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept.

    Pairs estimated below `least_estimate` (by default five standard errors under the threshold) are not read whole.
    Texts of buckets with up to `many_pairs` pairs left are paired by bucket, the others by their rarest shingles.
    """
    bands = Bands.of(threshold)
    if least_estimate is not None:
        bands = bands._replace(least_estimate=least_estimate)
    signed = common.written(signatures(df, bands, text, key), "signatures")
    classes = common.written(
        signed.where("n_shingles > 0")
        .groupBy(*SET_KEY)
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("packed").alias("packed")),
        "classes",
    )
    named = classes.where("rep is not null")
    bits = named.select("rep", "packed")
    buckets = _shared_buckets(named)

    order = F.struct(F.xxhash64("rep"), "rep")
    hubs = buckets.groupBy("bucket").agg(F.array(F.min("rep"), F.min(order)["rep"]).alias("hubs"))
    hubs = common.written(hubs.select("bucket", F.explode(F.array_distinct("hubs")).alias("a")), "hubs")
    pairs = buckets.join(hubs, "bucket").where("a <> rep").select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
    near = common.written(_similar_pairs(pairs, bits, bands).distinct(), "pairs")
    sets = _sets_for(df, near.select(F.col("a").alias("rep")).union(near.select("b")), named, text, key)
    comp = _merge(_confirmed(near, sets, threshold), None)

    # Buckets that still hold several components, and how many pairs of them.
    now = buckets.join(comp, buckets["rep"] == comp["node"], "left").select(
        "bucket", "band", "rep", F.coalesce("component", "rep").alias("component")
    )
    sizes = now.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(
        ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs")
    )
    left = common.written(now.join(sizes.where("pairs > 0"), "bucket"), "open")
    few = _similar_pairs(_pairs_in(left.where(F.col("pairs") <= many_pairs)), bits, bands) if many_pairs else near.limit(0)
    few = common.written(few, "pairs")
    many = common.written(left.where(F.col("pairs") > many_pairs).select("rep", "component").distinct(), "dense")
    sets = _sets_for(df, few.select(F.col("a").alias("rep")).union(few.select("b")).union(many.select("rep")), named, text, key)
    dense = _similar_pairs(_meeting_on_rare(sets.join(many, "rep"), threshold), bits, bands)
    links = common.written(_confirmed(few.union(dense).distinct(), sets, threshold), "links")
    comp = _merge(links, comp)

    home = common.written(
        classes.join(comp, classes["rep"] == comp["node"], "left").select(*SET_KEY, F.coalesce("component", "rep").alias("component_id")),
        "homes",
    )
    out = signed.select("doc_id", *SET_KEY).join(home, SET_KEY, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
