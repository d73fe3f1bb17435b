"""Exposure metrics over documents with annotations and predictions placed by arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from velaria.operators import exposure
from velaria.plans.registry import query, table

LABELS = ("CORREO", "TELEFONO", "CALLE", "NOMBRE", "PAIS")
TYPES = ("EMAIL", "PHONE", "ADDRESS", "PERSON", "ES_DNI")
MAPPING = {"CORREO": "EMAIL", "TELEFONO": "PHONE", "CALLE": "ADDRESS", "NOMBRE": "PERSON", "PAIS": None}
KEYS = ["doc_id"]

BASE = """
gold as (select * from (select doc_id, text, (i * 30 + (doc_id * 7 + i * 11) % 15)::int as start,
    (i * 30 + (doc_id * 7 + i * 11) % 15 + 4 + (doc_id + i * 3) % 10)::int as "end",
    ['CORREO','TELEFONO','CALLE','NOMBRE','PAIS'][cast((doc_id + i) % 5 as int) + 1] as label
  from documents, range(5) r(i)) where "end" <= length(text)),
pred as (select * from (select doc_id, (i * 26 + (doc_id * 5 + i * 7) % 20)::int as start,
    (i * 26 + (doc_id * 5 + i * 7) % 20 + 3 + (doc_id * 3 + i) % 12)::int as "end",
    ['EMAIL','PHONE','ADDRESS','PERSON','ES_DNI'][cast((doc_id + i + doc_id % 3) % 5 as int) + 1] as label,
    ((doc_id * 31 + i * 17) % 100) / 100.0::double as score, length(text) as n
  from documents, range(6) r(i)) where "end" <= n),
mapping(label, type) as (values ('CORREO','EMAIL'), ('TELEFONO','PHONE'), ('CALLE','ADDRESS'), ('NOMBRE','PERSON'), ('PAIS', null)),
typed as (select doc_id, start, "end", m.type as label from gold join mapping m using (label) where m.type is not null),
labels_ as (select label from typed union select label from pred),
-- each text has at most one annotation of a label, so it is matched by its first overlapping prediction
hit as (select distinct t.doc_id, t.label from typed t join pred p on t.doc_id = p.doc_id and t.label = p.label and t.start < p."end" and p.start < t."end"),
ov as (select label, (select count(*) from hit h where h.label = l.label) as tp,
  (select count(*) from pred p where p.label = l.label) as np, (select count(*) from typed t where t.label = l.label) as ng from labels_ l),
overlap as (select label, tp, np - tp as fp, ng - tp as fn from ov),
sh as (select distinct t.doc_id, t.label from typed t join pred p using (doc_id, label, start, "end")),
st as (select label, (select count(*) from sh h where h.label = l.label) as tp, np, ng from ov l),
strict as (select label, tp, np - tp as fp, ng - tp as fn from st),
touch as (select p.*, exists (select 1 from gold g where g.doc_id = p.doc_id and g.start < p."end" and p.start < g."end") as touches from pred p),
anyg as (select label, count(*) filter (touches) as tp, count(*) filter (not touches) as fp, 0::bigint as fn from touch group by label),
gold_chars as (select doc_id, label, text, unnest(range(start, "end")) as pos from gold),
alnum_chars as (select doc_id, label, pos from gold_chars where regexp_matches(substr(text, cast(pos as int) + 1, 1), '[\\p{L}\\p{N}]')),
open_ as (select distinct doc_id, label from alnum_chars c where not exists (select 1 from pred p where p.doc_id = c.doc_id and p.start <= c.pos and c.pos < p."end")),
leak as (select g.doc_id, g.label, o.doc_id is not null as leaked from gold g left join open_ o on o.doc_id = g.doc_id and o.label = g.label),
leaks as (select label, count(*) filter (leaked) as leaked, count(*) as total from leak group by label)
"""


def gold(spark, sf):
    i = F.explode(F.sequence(F.lit(0), F.lit(4)))
    placed = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"), i.alias("i"))
    start = F.col("i") * 30 + (F.col("doc_id") * 7 + F.col("i") * 11) % 15
    label = F.element_at(F.array(*map(F.lit, LABELS)), ((F.col("doc_id") + F.col("i")) % 5 + 1).cast("int"))
    return placed.select(
        "doc_id",
        start.cast("int").alias("start"),
        (start + 4 + (F.col("doc_id") + F.col("i") * 3) % 10).cast("int").alias("end"),
        label.alias("label"),
        "n",
    ).filter(F.col("end") <= F.col("n")).drop("n")


def pred(spark, sf, scored: bool = False):
    i = F.explode(F.sequence(F.lit(0), F.lit(5)))
    placed = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"), i.alias("i"))
    start = F.col("i") * 26 + (F.col("doc_id") * 5 + F.col("i") * 7) % 20
    turn = (F.col("doc_id") + F.col("i") + F.col("doc_id") % 3) % 5
    out = placed.select(
        "doc_id",
        start.cast("int").alias("start"),
        (start + 3 + (F.col("doc_id") * 3 + F.col("i")) % 12).cast("int").alias("end"),
        F.element_at(F.array(*map(F.lit, TYPES)), (turn + 1).cast("int")).alias("label"),
        (((F.col("doc_id") * 31 + F.col("i") * 17) % 100) / 100.0).alias("score"),
        "n",
    ).filter(F.col("end") <= F.col("n")).drop("n")
    return out if scored else out.drop("score")


def mapping(spark):
    return spark.createDataFrame(list(MAPPING.items()), "label string, type string")


def annotated(spark, sf, predictions=None):
    """Documents with both span lists as arrays."""
    def listed(spans, name):
        return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label")).alias(name))

    docs = table(spark, sf, "documents").select("doc_id", "text")
    both = docs.join(listed(gold(spark, sf), "gold"), "doc_id", "left").join(
        listed(pred(spark, sf) if predictions is None else predictions, "pred"), "doc_id", "left"
    )
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    return both.withColumns({c: F.coalesce(c, none) for c in ("gold", "pred")})


@query("e01_overlap_counts", f"with {BASE} select label, tp, fp, fn from overlap")
def e01_overlap_counts(spark, sf):
    typed = exposure.mapped(gold(spark, sf), mapping(spark))
    return exposure.by_label(exposure.overlap_counts(typed, pred(spark, sf), KEYS))


@query("e02_strict_counts", f"with {BASE} select label, tp, fp, fn from strict")
def e02_strict_counts(spark, sf):
    typed = exposure.mapped(gold(spark, sf), mapping(spark))
    return exposure.by_label(exposure.strict_counts(typed, pred(spark, sf), KEYS))


@query("e03_any_gold_counts", f"with {BASE} select label, tp, fp, fn from anyg")
def e03_any_gold_counts(spark, sf):
    return exposure.any_gold_counts(gold(spark, sf), pred(spark, sf), KEYS)


@query("e04_leaks", f"with {BASE} select label, leaked, total from leaks")
def e04_leaks(spark, sf):
    return exposure.leaks(annotated(spark, sf), KEYS)


_SCORES = (
    "case when tp + fp = 0 then 0.0 else tp / (tp + fp) end::double as precision, "
    "case when tp + fn = 0 then 0.0 else tp / (tp + fn) end::double as recall, "
    "case when tp = 0 then 0.0 else 2 * tp / (2 * tp + fp + fn) end::double as f1"
)


@query("e05_scores", f"with {BASE} select label, tp, fp, fn, {_SCORES} from overlap")
def e05_scores(spark, sf):
    typed = exposure.mapped(gold(spark, sf), mapping(spark))
    counts = exposure.by_label(exposure.overlap_counts(typed, pred(spark, sf), KEYS))
    return exposure.with_scores(counts)


@query(
    "e06_latency",
    "select event_type, quantile_cont(value, 0.5)::double as p50, quantile_cont(value, 0.95)::double as p95 from events group by event_type",
)
def e06_latency(spark, sf):
    return exposure.latency(table(spark, sf, "events"), "value", ["event_type"])


@query(
    "e07_label_mapping",
    f"with {BASE} select m.label, m.type, (select count(*) from gold g where g.label = m.label) as n, false as refused from mapping m",
)
def e07_label_mapping(spark, sf):
    # A label of the annotations that the mapping does not hold would show up as refused.
    known = mapping(spark).withColumn("_known", F.lit(True))
    counted = gold(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(known), "label", "full").select(
        "label",
        "type",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.col("_known").isNull().alias("refused"),
    )


@query(
    "e08_by_source_label",
    f"with {BASE} select l.label, m.type, l.total as n, l.leaked as leaks, 100.0 * l.leaked / l.total as leaks_per_100, "
    "case when m.type is not null then (select count(*) from hit h where h.label = m.type) / l.total end::double as recall from leaks l join mapping m using (label)",
)
def e08_by_source_label(spark, sf):
    return exposure.report_by_source(
        annotated(spark, sf), gold(spark, sf), pred(spark, sf), mapping(spark), KEYS
    ).select("label", "type", "n", "leaks", "leaks_per_100", "recall")


_STRICT = _SCORES.replace("as precision", "as strict_precision").replace("as recall", "as strict_recall").replace("as f1", "as strict_f1")


@query(
    "e09_by_type",
    f"with {BASE}, s as (select label, {_STRICT} from strict) select o.label, o.tp, o.fp, o.fn, o.precision, o.recall, o.f1, s.strict_precision, s.strict_recall, s.strict_f1, "
    f"a.tp / (a.tp + a.fp)::double as any_pii_precision, a.fp as non_pii_fp from (select *, {_SCORES} from overlap) o join s using (label) join anyg a using (label) where label <> 'ES_DNI'",
)
def e09_by_type(spark, sf):
    return exposure.report_by_type(gold(spark, sf), pred(spark, sf), mapping(spark), KEYS)


@query(
    "e10_overall",
    f"with {BASE} select sum(total)::bigint as total, sum(leaked)::bigint as leaked, sum(total) filter (label <> 'PAIS')::bigint as covered_total, "
    "sum(leaked) filter (label <> 'PAIS')::bigint as covered_leaked, (100.0 * sum(leaked) / sum(total))::double as leaks_per_100, "
    "(100.0 * sum(leaked) filter (label <> 'PAIS') / sum(total) filter (label <> 'PAIS'))::double as covered_leaks_per_100 from leaks",
)
def e10_overall(spark, sf):
    return exposure.overall(
        exposure.report_by_source(
            annotated(spark, sf), gold(spark, sf), pred(spark, sf), mapping(spark), KEYS
        )
    )


@query(
    "e11_unmatched_types",
    f"with {BASE} select label, count(*) as detections, count(*) filter (touches) as overlapping_gold from touch where label = 'ES_DNI' group by label",
)
def e11_unmatched_types(spark, sf):
    return exposure.unmatched_types(gold(spark, sf), pred(spark, sf), mapping(spark), KEYS)


_THRESHOLDS = "t(threshold) as (values (0.3::double), (0.4::double), (0.5::double), (0.6::double))"


@query(
    "e12_thresholds",
    f"with {BASE}, {_THRESHOLDS} select threshold, label, count(*) filter (touches) as tp, count(*) filter (not touches) as fp from touch, t where score > threshold group by all",
)
def e12_thresholds(spark, sf):
    scored = exposure.at_thresholds(pred(spark, sf, True))
    touched = exposure.touches(scored, gold(spark, sf), KEYS)
    return touched.groupBy("threshold", "label").agg(
        F.count_if("touches").alias("tp"), F.count_if(~F.col("touches")).alias("fp")
    )


_ROWS_SQL = f"""{_THRESHOLDS},
by_t as (select threshold, label, count(*) filter (touches) / count(*)::double as any_pii_precision,
  (select count(distinct (ty.doc_id)) from typed ty join pred p on ty.doc_id = p.doc_id and ty.label = p.label and ty.start < p."end" and p.start < ty."end"
     where p.label = touch.label and p.score > t.threshold) / count(*)::double as precision
  from touch, t where score > threshold group by threshold, label)"""


@query(
    "e13_threshold_rows",
    f"with {BASE}, {_ROWS_SQL} select threshold, "
    + ", ".join(
        f"max(precision) filter (label = '{e}') as {e}_precision, max(any_pii_precision) filter (label = '{e}') as {e}_any_pii_precision, "
        f"max(any_pii_precision) filter (label = '{e}') >= 0.85 as {e}_meets_floor, max(precision) filter (label = '{e}') >= 0.85 as {e}_meets_floor_by_type"
        for e in exposure.FLOOR_TYPES
    )
    + " from by_t group by threshold",
)
def e13_threshold_rows(spark, sf):
    return threshold_rows(spark, sf)


def threshold_rows(spark, sf):
    scored = exposure.at_thresholds(pred(spark, sf, True)).drop("score")
    annotations = gold(spark, sf)
    levels = F.explode(F.array(*map(F.lit, exposure.THRESHOLDS))).alias("threshold")
    typed = exposure.mapped(annotations, mapping(spark)).select("*", levels)
    keys = ["threshold", *KEYS]
    overlap = exposure.overlap_counts(typed, scored, keys).groupBy("threshold", "label").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    )
    touched = exposure.touches(scored, annotations, KEYS).groupBy("threshold", "label").agg(
        exposure.ratio(F.count_if("touches"), F.count("*")).alias("any_pii_precision")
    )
    by_type = overlap.withColumn("precision", exposure.precision()).join(
        touched, ["threshold", "label"], "left"
    )
    return exposure.floor_flags(by_type)


# What two overlapping windows of a text say: each entity again, a little further and less sure.
_MERGED = f"""{_THRESHOLDS},
ent as (select doc_id, start, "end", label, score from pred union all select doc_id, start + 2, "end" + 3, label, score * 0.7 from pred),
mg as (select doc_id, threshold, label, min(start) as start, max("end") as "end" from (
    select *, sum(opens) over (partition by doc_id, label, threshold order by start, "end", score rows unbounded preceding) as island from (
      select *, case when start < max("end") over (partition by doc_id, label, threshold order by start, "end", score rows between unbounded preceding and 1 preceding)
        then 0 else 1 end as opens from ent, t where score > threshold)) group by doc_id, threshold, label, island),
"""
_REPORT_SQL = """
mtp as (select k.k, p.label, count(distinct ty.doc_id) as tp, count(distinct case when ty.start = p.start and ty."end" = p."end" then ty.doc_id end) as stp
  from ks k join mp p using (k) join typed ty on ty.doc_id = p.doc_id and ty.label = p.label and ty.start < p."end" and p.start < ty."end" group by all),
mnp as (select k, label, count(*) as np, count(*) filter (exists (select 1 from gold g where g.doc_id = p.doc_id and g.start < p."end" and p.start < g."end")) as touching
  from mp p group by all),
mng as (select label, count(*) as ng from typed group by label),
rep as (select k, label, coalesce(tp, 0) as tp, coalesce(np, 0) - coalesce(tp, 0) as fp, ng - coalesce(tp, 0) as fn,
    case when coalesce(np, 0) = 0 then 0 else coalesce(tp, 0) / np end::double as precision, (coalesce(tp, 0) / ng)::double as recall,
    case when coalesce(np, 0) = 0 then 0 else coalesce(stp, 0) / np end::double as strict_precision, (coalesce(stp, 0) / ng)::double as strict_recall,
    case when coalesce(np, 0) = 0 then 0 else touching / np end::double as any_pii_precision, coalesce(np - touching, 0) as non_pii_fp
  from ks cross join mng left join mnp using (k, label) left join mtp using (k, label)),
clear_ as (select distinct k.k, c.doc_id, c.label from alnum_chars c cross join ks k
  where not exists (select 1 from mp p where p.k = k.k and p.doc_id = c.doc_id and p.start <= c.pos and c.pos < p."end")),
lk as (select k.k, g.label, count(*) as total, count(c.doc_id) as leaked from gold g cross join ks k
  left join clear_ c on c.k = k.k and c.doc_id = g.doc_id and c.label = g.label group by all)
"""
_AT_THRESHOLDS = _MERGED + "ks as (select threshold as k from t), mp as (select threshold as k, doc_id, label, start, \"end\" from mg)," + _REPORT_SQL
_FIGURES = ("precision", "recall", "strict_precision", "strict_recall", "tp", "fp", "fn", "any_pii_precision", "non_pii_fp")
_FULL_ROWS = f"""{_AT_THRESHOLDS}, rows_ as (select k as threshold, (select count(*) from documents) as documents,
  (select (100.0 * sum(leaked) / sum(total))::double from lk where lk.k = rep.k) as leaks_per_100,
  (select (100.0 * sum(leaked) / sum(total))::double from lk where lk.k = rep.k and label <> 'PAIS') as covered_leaks_per_100, """ + ", ".join(
    ", ".join(f"max({c}) filter (label = '{e}')::{'bigint' if c in ('tp', 'fp', 'fn', 'non_pii_fp') else 'double'} as {e}_{c}" for c in _FIGURES)
    + f", (max(tp + fn) filter (label = '{e}'))::bigint as {e}_gold"
    + f", max(any_pii_precision) filter (label = '{e}') >= 0.85 as {e}_meets_floor, max(precision) filter (label = '{e}') >= 0.85 as {e}_meets_floor_by_type"
    for e in exposure.FLOOR_TYPES
) + " from rep group by k)"


def windowed(spark, sf):
    sure = pred(spark, sf, True)
    again = sure.withColumns({"start": F.col("start") + 2, "end": F.col("end") + 3, "score": F.col("score") * 0.7})
    return sure.unionByName(again)


def full_threshold_rows(spark, sf):
    merged = exposure.merged_at_thresholds(windowed(spark, sf), KEYS)
    annotations, names = gold(spark, sf), mapping(spark)
    by_type = exposure.types_by("threshold", exposure.THRESHOLDS, annotations, merged, names, KEYS)
    documents = table(spark, sf, "documents").select("doc_id", "text")
    leaked = exposure.leaks_by("threshold", exposure.THRESHOLDS, documents, annotations, merged, names, KEYS)
    return exposure.threshold_rows(by_type, leaked)


@query(
    "e12_merged_thresholds",
    f"with {BASE}, {_MERGED} n as (select threshold, label, count(*) as spans, sum(\"end\" - start)::bigint as chars from mg group by all) select * from n",
)
def e12_merged_thresholds(spark, sf):
    return exposure.merged_at_thresholds(windowed(spark, sf), KEYS).groupBy("threshold", "label").agg(
        F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("chars")
    )


@query("e13_full_threshold_rows", f"with {BASE}, {_FULL_ROWS} select * from rows_")
def e13_full_threshold_rows(spark, sf):
    return full_threshold_rows(spark, sf)


@query(
    "e14_choose_threshold",
    f"with {BASE}, {_FULL_ROWS}, f as (select *, PERSON_any_pii_precision >= 0.85 and ADDRESS_any_pii_precision >= 0.85 as good from rows_) "
    "select threshold, good as floor_met from f order by good desc, case when good then -covered_leaks_per_100 else least(PERSON_any_pii_precision, ADDRESS_any_pii_precision) end desc, threshold desc limit 1",
)
def e14_choose_threshold(spark, sf):
    return exposure.choose_threshold(full_threshold_rows(spark, sf))


@query(
    "e15_tool_comparison",
    f"with {BASE}, tools as (select 'ours' as tool, doc_id, start, \"end\", label from pred union all select 'other', doc_id, start + 2, \"end\" + 2, case label when 'ES_DNI' then 'LOCATION' else label end from pred where label <> 'ADDRESS') "
    "select tool, label, count(*) filter (exists (select 1 from gold g where g.doc_id = t.doc_id and g.start < t.\"end\" and t.start < g.\"end\")) as touching, count(*) as predictions from tools t where label in ('EMAIL','PHONE','PERSON') group by all",
)
def e15_tool_comparison(spark, sf):
    compared, annotations = tools(spark, sf), gold(spark, sf)
    return exposure.touches(compared, annotations, KEYS).groupBy("tool", "label").agg(
        F.count_if("touches").alias("touching"), F.count("*").alias("predictions")
    )


def tools(spark, sf):
    """Our predictions and another tool's under our types, for the types both cover and the data annotates."""
    ours = pred(spark, sf)
    names = {"EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "PERSON": "PERSON", "LOCATION": None}
    back = {v: k for k, v in names.items() if v} | {"ES_DNI": "LOCATION"}
    to_theirs = F.create_map(*[F.lit(x) for pair in back.items() for x in pair])
    raw = ours.filter("label <> 'ADDRESS'").select(
        "doc_id", (F.col("start") + 2).alias("start"), (F.col("end") + 2).alias("end"),
        F.element_at(to_theirs, F.col("label")).alias("label"),
    )
    tool_map = spark.createDataFrame(list(names.items()), "label string, type string")
    theirs = exposure.tool_labels(raw, tool_map)
    shared = exposure.shared_types(
        gold(spark, sf),
        mapping(spark),
        spark.createDataFrame([(t,) for t in TYPES], "type string"),
        tool_map.filter("type is not null"),
    )
    both = ours.withColumn("tool", F.lit("ours")).unionByName(theirs.withColumn("tool", F.lit("other")))
    return both.join(shared, both.label == shared.type, "left_semi")


_TOOLS = """ks(k) as (values ('ours'), ('other')),
mp as (select * from (select 'ours' as k, doc_id, label, start, "end" from pred union all
  select 'other', doc_id, label, start + 2, "end" + 2 from pred where label <> 'ADDRESS') where label in ('EMAIL','PHONE','PERSON')),
""" + _REPORT_SQL


@query(
    "e15_tool_report",
    f"with {BASE}, {_TOOLS} select k as tool, rep.label as label, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, precision, recall, strict_precision, strict_recall, "
    "any_pii_precision, non_pii_fp::bigint as non_pii_fp, leaked, total from rep join mapping m on m.type = rep.label "
    "join (select k, label as source, leaked, total from lk) using (k) where source = m.label and rep.label in ('EMAIL','PHONE','PERSON')",
)
def e15_tool_report(spark, sf):
    compared, annotations, names = tools(spark, sf), gold(spark, sf), mapping(spark)
    values = ("ours", "other")
    by_type = exposure.types_by("tool", values, annotations, compared, names, KEYS)
    documents = table(spark, sf, "documents").select("doc_id", "text")
    leaked = exposure.leaks_by("tool", values, documents, annotations, compared, names, KEYS).join(names, "label")
    leaked = leaked.select("tool", F.col("type").alias("label"), "leaked", "total")
    shared = by_type.filter(F.col("label").isin("EMAIL", "PHONE", "PERSON"))
    return shared.join(leaked, ["tool", "label"]).drop("f1", "strict_f1")


@query(
    "e16_leak_delta",
    f"with {BASE}, open2 as (select distinct doc_id, label from alnum_chars c where not exists (select 1 from pred p where p.doc_id = c.doc_id and p.start <= c.pos and c.pos < p.\"end\" and p.score > 0.5)), "
    "less as (select g.label, count(*) as total, count(o.doc_id) as leaked from gold g left join open2 o on o.doc_id = g.doc_id and o.label = g.label group by g.label) "
    "select label, l.leaked as leaked_before, l.total as total_before, s.leaked as leaked_after, s.total as total_after, s.leaked - l.leaked as delta from leaks l join less s using (label)",
)
def e16_leak_delta(spark, sf):
    before = exposure.leaks(annotated(spark, sf), KEYS)
    sure = pred(spark, sf, True).filter("score > 0.5").drop("score")
    return exposure.leak_delta(before, exposure.leaks(annotated(spark, sf, sure), KEYS))
