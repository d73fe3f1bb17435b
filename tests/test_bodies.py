"""Bodies flattened in small pieces: odd bodies give one row each, order and paths stay."""

from __future__ import annotations

import json

import pyarrow as pa

from velaria.operators import bodies, needles


def test_leaves_of_odd_bodies(spark):
    deep = "[" * 101 + "]" * 101
    said = [
        (1, '{"a":[1,{"type":"x","b":"\\u00e9\\"q"}],"arguments":"{\\"k\\": null}"}'), (2, '{"a":"\\ud800"}'), (3, None), (4, "[]"), (5, "{}"),
        (6, f'{{"a":{deep}}}'), (7, '{"a":1,"a":2}'), (8, "{"), (9, json.dumps({"a": "x" * 300_000})), (10, '{"a":"\\ud83d\\ude42"}'),
    ]
    rows = bodies.leaves(spark.createDataFrame(said, "scope_id long, body string").coalesce(1)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.scope_id, r.ord)):
        got.setdefault(r.scope_id, []).append((r.ord, r.kind, r.path, r.owners, r.value, r.nested))
    invalid, top = [(0, "invalid", [], [], None, False)], (0, "object", [], [], None, False)
    assert got[1] == [
        top, (1, "key", ["a"], [None], "a", False), (2, "number", ["a", "#0"], [None, None], "1", False),
        (3, "object", ["a", "#1"], [None, None], "x", False), (4, "key", ["a", "#1", "type"], [None, None, "x"], "type", False),
        (5, "text", ["a", "#1", "type"], [None, None, "x"], "x", False), (6, "key", ["a", "#1", "b"], [None, None, "x"], "b", False),
        (7, "text", ["a", "#1", "b"], [None, None, "x"], 'é"q', False), (8, "key", ["arguments"], [None], "arguments", False),
        (9, "object", ["arguments"], [None], None, True), (10, "key", ["arguments", "k"], [None, None], "k", True),
        (11, "constant", ["arguments", "k"], [None, None], "null", True),
    ]
    assert got[2] == got[3] == got[4] == got[7] == got[8] == invalid and got[5] == [top]
    assert got[6] == [(0, "too_deep", [], [], None, False)]
    assert got[9][2][4] == "x" * 300_000 and got[10][2][4] == "🙂"


def test_pieces_of_a_batch_are_as_small_as_asked():
    batch = pa.record_batch({"k": list(range(9)), "t": ["x" * 60] * 8 + ["y" * 500]})
    pieces = list(needles.text_pieces(batch, 1, 100))
    assert [r for p in pieces for r in p.column(0).to_pylist()] == list(range(9))
    assert max(p.num_rows for p in pieces) == 2


def test_small_tables_are_walked_on_all_cores(spark, tmp_path):
    from velaria.plans import bodies as plans

    spark.range(50).selectExpr("id as page_id", "'u' || id as url").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    made = plans._page_bodies(spark, str(tmp_path), plans.OPENAI_VARIANTS)
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
