"""Interval operators over span tables made from line items: one text per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from velaria.functions.spans import SPANS_TYPE
from velaria.operators import names, resolve
from velaria.operators.exposure import touches
from velaria.plans.registry import query, table

SPANS_SQL = """
spans as (select l_orderkey as text_id, (l_partkey % 200)::int as start,
  (l_partkey % 200 + 1 + l_suppkey % 40)::int as "end",
  ['EMAIL','PHONE','IP','PERSON'][cast(l_linenumber % 4 as int) + 1] as type,
  case when l_linenumber % 4 = 3 then 'NER' when l_linenumber % 2 = 0 then 'PATTERN' else 'VALIDATOR' end as layer,
  'HIGH' as confidence, l_linenumber as ln from lineitem),
others as (select l_orderkey as text_id, (l_suppkey * 3 % 200)::int as start,
  (l_suppkey * 3 % 200 + 1 + l_partkey % 25)::int as "end", 'EMAIL' as type, l_linenumber as ln from lineitem)
"""


def _pick(options, index):
    return F.element_at(F.array(*map(F.lit, options)), (index + 1).cast("int"))


def spans(spark, sf):
    items = table(spark, sf, "lineitem")
    start = (F.col("l_partkey") % 200).cast("int")
    line = F.col("l_linenumber")
    return items.select(
        F.col("l_orderkey").alias("text_id"),
        start.alias("start"),
        (start + 1 + F.col("l_suppkey") % 40).cast("int").alias("end"),
        _pick(("EMAIL", "PHONE", "IP", "PERSON"), line % 4).alias("type"),
        F.when(line % 4 == 3, "NER").when(line % 2 == 0, "PATTERN").otherwise("VALIDATOR").alias("layer"),
        F.lit("HIGH").alias("confidence"),
    )


def others(spark, sf):
    start = (F.col("l_suppkey") * 3 % 200).cast("int")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("text_id"),
        start.alias("start"),
        (start + 1 + F.col("l_partkey") % 25).cast("int").alias("end"),
        F.lit("EMAIL").alias("type"),
    )


@query(
    "r02_contained",
    f"with {SPANS_SQL}, d as (select distinct text_id, start, \"end\", type, layer, confidence from spans) "
    'select text_id, start, "end", type, layer from d a where exists (select 1 from d b where b.text_id = a.text_id and '
    "(a.layer = 'NER') = (b.layer = 'NER') and b.start <= a.start and a.\"end\" <= b.\"end\" and (b.start, b.\"end\") <> (a.start, a.\"end\"))",
)
def r02_contained(spark, sf):
    distinct = spans(spark, sf).distinct()
    return resolve.contained(distinct, ["text_id"]).select("text_id", "start", "end", "type", "layer")


@query(
    "r03_free_chars",
    f"with {SPANS_SQL}, c as (select distinct text_id, unnest(range(start, \"end\")) as at from spans), "
    'o as (select distinct text_id, unnest(range(start, "end")) as at from others) '
    "select text_id, count(*) as free_chars from (select * from c except select * from o) group by all",
)
def r03_free_chars(spark, sf):
    free = resolve.free_pieces(spans(spark, sf), others(spark, sf), ["text_id"])
    return free.groupBy("text_id").agg(
        F.sum(F.col("end") - F.col("start")).cast("bigint").alias("free_chars")
    )


@query(
    "r04_overlap_join",
    f"with {SPANS_SQL} select a.text_id, a.start as l_start, a.\"end\" as l_end, b.start as r_start, b.\"end\" as r_end, count(*) as n "
    'from spans a join others b on a.text_id = b.text_id and a.start < b."end" and b.start < a."end" group by all',
)
def r04_overlap_join(spark, sf):
    pairs = resolve.overlapping(
        spans(spark, sf).select("text_id", "start", "end"),
        others(spark, sf).select("text_id", "start", "end"),
        ["text_id"],
    )
    return pairs.groupBy("text_id", "l_start", "l_end", "r_start", "r_end").agg(F.count("*").alias("n"))


@query(
    "r05_touching",
    f"with {SPANS_SQL} select text_id, start, \"end\", type, count(*) as n from spans a where exists (select 1 from others b "
    'where a.text_id = b.text_id and a.start < b."end" and b.start < a."end") group by all',
)
def r05_touching(spark, sf):
    mine = spans(spark, sf).select("text_id", "start", "end", "type")
    touched = touches(mine, others(spark, sf), ["text_id"]).filter("touches")
    return touched.groupBy("text_id", "start", "end", "type").agg(F.count("*").alias("n"))


@query(
    "r06_ill_formed",
    f"with {SPANS_SQL}, o as (select *, coalesce(lag(\"end\") over (partition by text_id order by start, \"end\"), 0) as before from spans) "
    'select distinct text_id from o where before > start or start >= "end" or "end" > 60 + text_id % 120',
)
def r06_ill_formed(spark, sf):
    table_ = spans(spark, sf)
    lengths = table_.select("text_id").distinct().withColumn("n_chars", 60 + F.col("text_id") % 120)
    return resolve.ill_formed(table_, lengths, ["text_id"])


@query(
    "d23_merge_windows",
    f"with {SPANS_SQL}, m as (select *, coalesce(start >= max(\"end\") over (partition by text_id, type order by start, \"end\", ln rows between unbounded preceding and 1 preceding), true) as fresh from spans), "
    "i as (select *, sum(fresh::int) over (partition by text_id, type order by start, \"end\", ln rows unbounded preceding) as island from m) "
    'select text_id, type as label, min(start)::int as start, max("end")::int as "end", max((start % 10) / 10.0::double) as score from i group by text_id, type, island',
)
def d23_merge_windows(spark, sf):
    scored = spans(spark, sf).select(
        "text_id", "start", "end", F.col("type").alias("label"), (F.col("start") % 10 / 10.0).alias("score")
    )
    return names.merge_overlapping(scored, ["text_id"])


# Three overlaps whose outcome is known, moved along the text by the key: a partial one, a
# container, and a name around two identifiers.
CASES = (
    (5, 14, "ES_DNI", "VALIDATOR"), (10, 30, "PHONE", "PATTERN"),
    (100, 126, "ADDRESS", "PATTERN"), (105, 114, "ES_DNI", "VALIDATOR"),
    (200, 230, "PERSON", "NER"), (210, 219, "ES_NIE", "VALIDATOR"), (220, 228, "EMAIL", "PATTERN"),
)
PIECES = (
    (5, 14, "ES_DNI"), (14, 30, "PHONE"), (100, 126, "ADDRESS"), (200, 210, "PERSON"),
    (210, 219, "ES_NIE"), (219, 220, "PERSON"), (220, 228, "EMAIL"), (228, 230, "PERSON"),
)


@query(
    "r01_resolve",
    "with p(s, e, type) as (values "
    + ", ".join(str(p) for p in PIECES)
    + ') select o_orderkey as text_id, (s + o_orderkey % 50)::int as start, (e + o_orderkey % 50)::int as "end", type from orders, p',
)
def r01_resolve(spark, sf):
    shift = (F.col("o_orderkey") % 50).cast("int")
    found = F.array(
        *[
            F.struct(
                (F.lit(s) + shift).alias("start"), (F.lit(e) + shift).alias("end"), F.lit(t).alias("type"),
                F.lit(layer).alias("layer"), F.lit("HIGH").alias("confidence"),
            )
            for s, e, t, layer in CASES
        ]
    ).cast(SPANS_TYPE)
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("text_id"), found.alias("spans"), F.repeat(F.lit("a"), F.lit(300)).alias("text")
    )
    settled = rows.select("text_id", resolve.resolve(F.col("spans"), F.col("text")).alias("r"))
    return settled.select("text_id", F.explode_outer("r").alias("s")).select(
        "text_id", "s.start", "s.end", "s.type"
    )


@query(
    "r01_resolved_cover",
    f"with {SPANS_SQL}, c as (select distinct text_id, unnest(range(start, \"end\")) as at from spans) "
    "select text_id, count(*) as chars, count(*) as covered from c group by all",
)
def r01_resolved_cover(spark, sf):
    # Whatever overlaps, the resolved spans are disjoint and cover every letter once.
    gathered = spans(spark, sf).groupBy("text_id").agg(
        F.collect_list(F.struct("start", "end", "type", "layer", "confidence")).alias("spans")
    )
    settled = gathered.select(
        "text_id",
        resolve.resolve(F.col("spans").cast(SPANS_TYPE), F.repeat(F.lit("a"), F.lit(300))).alias("r"),
    )
    chars = F.flatten(F.transform("r", lambda s: F.sequence(s["start"], s["end"] - 1)))
    return settled.select(
        "text_id",
        F.size(chars).cast("bigint").alias("chars"),
        F.size(F.array_distinct(chars)).cast("bigint").alias("covered"),
    )
