"""Names: dictionary, windows, scored entities, propagation; and the views a model reads."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from velaria.functions import views
from velaria.functions.folded import folded_views
from velaria.functions.spans import SPANS_TYPE
from velaria.operators import names, propagate
from velaria.plans.registry import query, spread, table
from velaria.session import materialize


@query(
    "n01_detector_view",
    "select page_id, url || ' 12345678 AB' as view from pages",
)
def n01_detector_view(spark, sf):
    odd = F.concat(F.col("url"), F.lit("​ １２３­４５６78　ΑВ̂"))
    return table(spark, sf, "pages").select("page_id", views.detector_view(odd).alias("view"))


@query(
    "n02_offset_map",
    "select page_id, length(url)::int as start, (length(url) + 4)::int as \"end\" from pages",
)
def n02_offset_map(spark, sf):
    # Two dropped characters inside the last two view characters' range.
    text = F.concat(F.col("url"), F.lit("a​​b"))
    rows = table(spark, sf, "pages").select("page_id", text.alias("t"), views.detector_view(text).alias("v"))
    shift = views.offset_map(F.col("t"), F.col("v"))
    return rows.select(
        "page_id",
        views.original_start(F.length("v") - 2, shift).alias("start"),
        views.original_end(F.length("v"), shift).alias("end"),
    )


@query(
    "n06_folded_views",
    "with c as (select doc_id, unnest(string_split(text, '')) as ch, generate_subscripts(string_split(text, ''), 1) - 1 as i from documents where text <> ''), "
    "f as (select *, case when regexp_matches(ch, '\\s') then ' ' else replace(lower(strip_accents(ch)), 'ß', 'ss') end as f from c), "
    "k as (select *, f <> ' ' or coalesce(lag(f) over (partition by doc_id order by i), ' ') <> ' ' as kept, regexp_matches(f, '[\\p{L}\\p{N}]') as letter from f) "
    "select doc_id, string_agg(f, '' order by i) filter (kept) as normal, sha256(string_agg(f, '' order by i) filter (kept and letter)) as compact_sha256, "
    "cast(sum(i * length(f)) filter (kept) as bigint) as places, cast(sum(i * length(f)) filter (kept and letter) as bigint) as compact_places from k group by doc_id",
)
def n06_folded_views(spark, sf):
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    rows = folded_views(spread(table(spark, sf, "documents").filter("text <> ''")), ["doc_id"])
    return rows.select(
        "doc_id", "normal", F.sha2("compact", 256).alias("compact_sha256"), total("normal_from").alias("places"), total("compact_from").alias("compact_places")
    )


@query(
    "n07_model_view",
    "select page_id, case when length(url) >= 32 then repeat(' ', length(url)) else url end || ' ok ' || repeat(' ', 8) || 'Ana' as view from pages",
)
def n07_model_view(spark, sf):
    text = F.concat(F.col("url"), F.lit(" ok 12345678Ana"))
    return table(spark, sf, "pages").select("page_id", views.model_view(text).alias("view"))


_WORD = "[\\p{L}\\p{N}_]{1,40}|[^\\p{L}\\p{N}_\\s\\p{Z}]"


@query(
    "n08_windows",
    f"with t as (select doc_id, len(regexp_extract_all(text, '{_WORD}')) as n from documents) "
    "select doc_id, unnest(range(case when n <= 200 then 1 else cast(ceil((n - 200) / 150.0) as int) + 1 end))::int as window from t where n > 0",
)
def n08_windows(spark, sf):
    rows = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.posexplode_outer(names.windows_of(F.col("text"))).alias("window", "w"))
    return rows.filter("w is not null").select("doc_id", "window")


@query("n09_token_pieces", None)
def n09_token_pieces(spark, sf):
    # Sequential cutting: tested against a brute-force version on a fixture.
    sizes = F.transform(F.split("text", " "), lambda w: (F.length(w) / 4).cast("int") + 1)
    rows = table(spark, sf, "documents").select("doc_id", sizes.alias("counts"))
    cut = names.pieces_under_budget(F.col("counts"), F.lit(96), F.lit(32))
    return rows.select("doc_id", F.size(cut).alias("pieces"))


@query("n11_folded_names", "select distinct lower(event_type) as folded from events")
def n11_folded_names(spark, sf):
    wide = F.concat(F.upper(F.substring("event_type", 1, 2)), F.substr("event_type", F.lit(3)))
    distinct = table(spark, sf, "events").select(wide.alias("name")).distinct()
    return distinct.select(views.fold_key(F.col("name")).alias("folded"))


@query(
    "d21_dictionary_names",
    "with d as (select doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') as w from documents), u as (select doc_id, unnest(w) as word from d), "
    "n(name) as (values ('The'), ('and'), ('Le'), ('les'), ('Une')) select doc_id, word as name, count(*) as n from u join n on word = name group by all",
)
def d21_dictionary_names(spark, sf):
    listed = spark.createDataFrame([(n, "PERSON") for n in ("The", "and", "Le", "les", "Une")], "name string, label string")
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return names.find_names(docs, listed, ["doc_id"]).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


def _entities(spark, sf):
    """Entities as a model could give them over windows: some documents have a bad one."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cut = materialize(names.windows(spread(docs), ["doc_id"]))
    bad = (F.col("doc_id") % 10 == 0) & (F.col("window") == 0)
    size = F.length("window_text")
    made = cut.select(
        "doc_id", "window", F.lit(0).alias("start"),
        F.when(bad, size + 1).otherwise(F.least(F.lit(3), size)).alias("end"),
        F.lit("person").alias("label"), (F.col("doc_id") % 7 / 7.0).alias("score"),
    )
    return made, cut


@query(
    "d22_malformed_scopes",
    f"select doc_id from documents where doc_id % 10 = 0 and len(regexp_extract_all(text, '{_WORD}')) > 0",
)
def d22_malformed_scopes(spark, sf):
    made, cut = _entities(spark, sf)
    return names.malformed(made, cut, ["doc_id"], ["person"])


@query("d22_scored_spans", None)
def d22_scored_spans(spark, sf):
    # Window places depend on the model view; the merge and the threshold are tested on fixtures.
    made, cut = _entities(spark, sf)
    good = made.join(names.malformed(made, cut, ["doc_id"], ["person"]), "doc_id", "left_anti")
    merged = names.merge_windows(good, cut, ["doc_id"])
    return names.as_name_spans(merged, ["doc_id"], {"person": "PERSON"}, 0.5)


@query(
    "r08_propagate_names",
    "with t as (select conv_id, turn, length(text)::int as n, min(turn) over (partition by conv_id) as first from conversations) "
    "select conv_id as scope_id, turn as text_ord, n + 1 as start, n + 13 as \"end\" from t union all "
    "select conv_id, turn, n + 14, n + 17 from t",
)
def r08_propagate_names(spark, sf):
    # The model finds both names in the first turn only; every other turn writes them in another
    # way.  The short one is a word of its own, never the middle of another ("semana").
    turns = table(spark, sf, "conversations")
    first = F.col("turn") == F.min("turn").over(Window.partitionBy("conv_id"))
    tagged = turns.withColumn("_first", first)
    tail = F.when(F.col("_first"), " Zoé Quirante Xio axiom").otherwise(" ZOE-QUIRANTE xIO axiom")
    n = F.length(F.col("text"))

    def name(a, b):
        return F.struct(
            (n + a).cast("int").alias("start"), (n + b).cast("int").alias("end"), F.lit("PERSON").alias("type"),
            F.lit("NER").alias("layer"), F.lit("MEDIUM").alias("confidence"),
        )

    seen = F.when(F.col("_first"), F.array(name(1, 13), name(14, 17))).otherwise(F.array()).cast(SPANS_TYPE)
    scanned = tagged.select(
        F.col("conv_id").alias("scope_id"), F.col("turn").alias("text_ord"),
        F.concat("text", tail).alias("text"), seen.alias("spans"),
    )
    out, _ = propagate.propagate(scanned)
    return out.select("scope_id", "text_ord", F.explode_outer("spans").alias("s")).filter("s is not null").select(
        "scope_id", "text_ord", "s.start", "s.end"
    )


@query(
    "r09_whole_words",
    "select doc_id, n % 2 = 0 as whole from (select doc_id, doc_id as n from documents)",
)
def r09_whole_words(spark, sf):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("(Ana) "), F.col("text"))).otherwise(F.concat(F.lit("(Anab "), F.col("text")))
    docs = table(spark, sf, "documents").select("doc_id", text.alias("t"))
    return docs.select("doc_id", propagate.is_whole(F.col("t"), F.lit(1), F.lit(4)).alias("whole"))


@query(
    "u02_new_texts",
    "select count(distinct text) as new_texts from documents where lang <> 'en' and text not in (select text from documents where lang = 'en')",
)
def u02_new_texts(spark, sf):
    docs = table(spark, sf, "documents")
    store = names.distinct_texts(docs.filter("lang = 'en'")).select("text_hash")
    return names.new_texts(docs, store).agg(F.count("*").alias("new_texts"))
