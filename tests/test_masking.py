"""Round trips, numbering, placeholders and the guard."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from velaria.operators import detect, guard, masking, restoring, vault
from velaria.session import materialize

PIECES = ["12345678Z", "ana@example.com", "[[ES_DNI_1]]", "[[ es_dni_2 ]]", "[[EMAIL_1]]", "[[!", "[[[", "]]", " ", "!", "hola", "[", "B64717838"]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), min_size=20, max_size=40))
def test_restoring_a_masked_text_gives_the_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    masked = masking.mask_rows(detect.scan(df, types=("ES_DNI", "EMAIL", "ES_CIF")))
    assert restoring.round_trip_failures(masked).count() == 0


def _restore(spark, text, entries):
    df = spark.createDataFrame([(text, entries)], "t string, v map<string,string>")
    return df.select(restoring.restore_text(F.col("t"), F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text, out",
    [
        ("[[ES_DNI_1]]", "V"), ("[[ es_dni_1 ]]", "V"), ("[[ES_DNI_2]]", "[[ES_DNI_2]]"),
        ("[[!x", "[[x"), ("[[[!", "[[["), ("[[[ES_DNI_1]]", "[V"), ("[[ES_DNI_1]", "[[ES_DNI_1]"),
        ("[[!ES_DNI_1]]", "[[ES_DNI_1]]"),
    ],
)
def test_restore_reads_placeholders_as_a_model_writes_them(spark, text, out):
    assert _restore(spark, text, {"ES_DNI_1": "V"}) == out


def test_what_is_restored_is_not_read_again(spark):
    assert _restore(spark, "[[A_1]][[B_1]]", {"A_1": "[[B_1]]", "B_1": "x"}) == "[[B_1]]x"


def test_parts_join_to_the_text(spark):
    text = "a [[!x [[ES_DNI_1]][[ es_nie_2 ]] [[y"
    row = spark.createDataFrame([(text,)], "t string").select(restoring.parts_of(F.col("t")).alias("p")).first()
    assert "".join(p.piece for p in row.p) == text
    assert [p.token for p in row.p] == [None, "ES_DNI_1", "ES_NIE_2", None]


def test_numbering_is_the_same_over_blocks_and_reserved_tokens(spark):
    rows = [("s", i, 0, "EMAIL", f"v{i % 1500}") for i in range(4000)]
    df = spark.createDataFrame(rows, "scope_id string, text_ord long, start int, type string, value string")
    got = {r.value: r.n for r in vault.vault(df).collect()}
    assert got == {f"v{i}": i + 1 for i in range(1500)}
    taken = spark.createDataFrame([("s", "EMAIL_1"), ("s", "EMAIL_3"), ("s", "EMAIL_4"), ("s", "EMAIL_07"), ("t", "EMAIL_2")], "scope_id string, token string")
    got = {r.value: r.n for r in vault.vault(df, reserved=taken).collect()}
    free = [n for n in range(1, 1600) if n not in (1, 3, 4)]
    assert got == {f"v{i}": free[i] for i in range(1500)}


def test_guard_finds_values_in_any_spacing_and_short_ones_as_words(spark):
    vault_rows = [("a", "12345678Z"), ("b", "Ana"), ("c", "Ana"), ("d", "García"), ("e", "x@y"), ("f", "12345678Z")]
    texts = [
        ("a", 0, "id 12·34·56·78-z"), ("b", 0, "la semana"), ("c", 0, "hola ANA!"), ("d", 0, "GARCIA"),
        ("e", 0, "di x@y"), ("f", 0, "[[ES_DNI_1]]"),
    ]
    v = spark.createDataFrame(vault_rows, "scope_id string, value string")
    t = spark.createDataFrame(texts, "scope_id string, text_ord int, text string")
    assert {r.scope_id for r in guard.leaking_scopes(t, v).collect()} == {"a", "c", "d", "e"}
    rows = t.join(v.groupBy("scope_id").agg(F.collect_list("value").alias("vals")), "scope_id")
    assert {r.scope_id for r in guard.row_leaks(rows, "text", "vals").filter("leaks").collect()} == {"a", "c", "d", "e"}


def test_one_giant_scope_keeps_every_row(spark):
    base = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit("big")).otherwise(F.col("id").cast("string")).alias("scope_id"),
        F.col("id").alias("text_ord"),
        F.concat(F.lit("de u"), F.col("id").cast("string"), F.lit("@example.com")).alias("text"),
    )
    masked, numbers = masking.mask_scopes(materialize(detect.scan(base, types=("EMAIL",))))
    assert masked.count() == 3000
    assert numbers.filter("scope_id = 'big'").agg(F.max("n"), F.count_distinct("n")).first()[:] == (2000, 2000)
