"""Trailing windows in bins and exact quantiles over ranges, against plain versions, with one hot group."""

from __future__ import annotations

import random
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import functions as F

from velaria.operators import exposure, feed


def test_bursts_with_one_address_that_has_most_rows(spark):
    rng = random.Random(1)
    start, rows = 1_700_000_000_000_000, []
    for i in range(3000):
        rows.append((i, "hot" if i % 10 else f"b{i % 7}", start + rng.randrange(1_200) * 1_000_000 + rng.choice([0, 0, 1, 999_999]), "x"))
    rows += [(4000, "hot", None, "x"), (4001, None, start, "x"), (4002, None, start + 59_999_999, "x"), (4003, None, start + 119_999_999, "x")]
    df = spark.createDataFrame(rows, "event_id int, bucket string, t long, _b string").withColumnRenamed("_b", "bin")
    df = df.withColumn("at", F.timestamp_micros("t")).drop("t").repartition(4)
    got = {r.event_id: (r.failures, r.wait_seconds) for r in feed.failure_bursts(df).collect()}
    assert len(got) == len(rows) and got[4000] == (None, None)
    for i, b, t, _ in rows:
        if t is None:
            continue
        near = sorted((u, j) for j, c, u, _ in rows if c == b and u is not None)
        failures = sum(t - 60_000_000 < u <= t for u, _ in near)
        at = near.index((t, i))
        fifth = near[at - 4][0] if at >= 4 else None
        wait = max(1, -((t - fifth - 60_000_000) // 1_000_000)) if fifth is not None and fifth > t - 60_000_000 else 0
        assert got[i] == (failures, wait), (i, b)


def test_a_hot_address_is_in_many_bins(spark):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp()
    df = spark.range(20_000).select(F.lit("one").alias("bucket"), F.timestamp_seconds(F.lit(start) + F.col("id") * 7).alias("at"))
    out = feed.failure_bursts(df)
    assert out.agg(F.max("failures")).first()[0] == 9 and out.count() == 20_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = feed.failure_bursts(df).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) >= 4 and max(r["count"] for r in rows) < 10_000


def test_quantiles_equal_numpy_with_one_group_of_most_rows(spark):
    rng = random.Random(2)
    values = {"hot": [rng.gauss(0, 9) for _ in range(4000)], "one": [3.5], "two": [1.0, 2.0], "ties": [1.0] * 50 + [9.0] * 3, None: [4.0, 8.0, 9.0]}
    rows = [(g, x) for g, xs in values.items() for x in xs] + [("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.p50, r.p95) for r in exposure.latency(df, "v", ["g"]).collect()}
    assert got.pop("none") == (None, None)
    assert got.keys() == values.keys()
    for g, (p50, p95) in got.items():
        assert np.allclose((p50, p95), np.quantile(values[g], [0.5, 0.95]), rtol=1e-12, atol=0)
    whole = exposure.latency(df, "v").first()
    assert np.allclose(tuple(whole), np.quantile([x for xs in values.values() for x in xs], [0.5, 0.95]))
    assert exposure.latency(df.limit(0), "v", ["g"]).count() == 0


def test_windows_equal_a_plain_cut_and_place_blocks_not_tokens(spark):
    import re

    from velaria.operators import names

    texts = ["", "  ", "a", " é🙂 b!!c ", "w " * 200, "w " * 201, " w" * 350, " w" * 351, "x" * 90, "ab, " * 130]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    plain = re.compile(r"\w{1,40}|[^\w\s]")
    for size, shared in ((200, 50), (7, 3)):
        cut = df.select("id", names.windows_of(F.col("text"), size, shared).alias("w"))
        for r in cut.collect():
            at = [m.span() for m in plain.finditer(texts[r.id])]
            count = 1 if len(at) <= size else -(-(len(at) - size) // (size - shared)) + 1
            want = [(at[i * (size - shared)][0], at[min(i * (size - shared) + size, len(at)) - 1][1]) for i in range(count)] if at else []
            assert [(w.start, w.end) for w in r.w] == want
        # Only blocks are folded over; a fold over tokens would add up gaps and widths.
        assert "width" not in cut._jdf.queryExecution().analyzed().toString()
