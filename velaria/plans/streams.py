"""Server-sent events made from masked conversations: parsed, restored in a stream, watched."""

from __future__ import annotations

from pyspark.sql import functions as F

from velaria.functions.spans import let
from velaria.operators import masking
from velaria.plans.masking import TURNS, scanned_turns
from velaria.plans.registry import query, spread, table
from velaria.session import materialize, new_folder
from velaria.sources import sse
from velaria.streaming import relay
from velaria.streaming.fields import split_keys, string_fields

PIECE = 40  # characters of a chunk: events and placeholders are cut anywhere


def answers(spark, sf, provider="openai"):
    """stream_id, text: each masked turn as one streamed answer; every third one is cut."""
    masked, vault = masking.mask_scopes(scanned_turns(spark, sf))
    turns = materialize(masked.select("scope_id", "text_ord", "masked_text"))
    pieces = F.regexp_extract_all(F.col("masked_text"), F.lit(r"(?s).{1,25}"), F.lit(0))

    def chat(p):
        delta = F.struct(F.struct(p.alias("content")).alias("delta"), F.lit(0).alias("index"))
        return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(delta).alias("choices"))), F.lit("\n\n"))

    def block(p):
        delta = F.struct(F.lit("text_delta").alias("type"), p.alias("text"))
        body = F.struct(F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"), delta.alias("delta"))
        return F.concat(F.lit("event: content_block_delta\r\ndata: "), F.to_json(body), F.lit("\r\n\r\n"))

    if provider == "openai":
        head, each = ": keep-alive\n\n", chat
        tail = 'data: {"choices":[{"index":0,"delta":{},"finish_reason":"stop"}]}\n\ndata: [DONE]\n\n'
    else:
        head = 'event: content_block_start\r\ndata: {"type":"content_block_start","index":0,"content_block":{"type":"text","text":""}}\r\n\r\n'
        tail = 'event: content_block_stop\r\ndata: {"type":"content_block_stop","index":0}\r\n\r\nevent: message_stop\r\ndata: {"type":"message_stop"}\r\n\r\n'
        each = block
    name = F.concat_ws("-", F.col("scope_id").cast("string"), F.col("text_ord").cast("string"))
    cut = F.col("text_ord") % 3 == 2
    text = F.concat(F.lit(head), F.array_join(F.transform(pieces, each), ""), F.when(cut, "").otherwise(tail))
    return turns.select("scope_id", name.alias("stream_id"), text.alias("text")), vault


def chunks(texts, piece=PIECE):
    """stream_id, seq, chunk, last: texts cut in pieces, and a closing row.

    All that is said of a chunk is made in its text's row: beside an explode, it would be made anew for every chunk.
    """
    cut = F.regexp_extract_all(F.col("text"), F.lit(rf"(?s).{{1,{piece}}}"), F.lit(0))

    def row(seq, chunk, last):
        return F.struct(seq.cast("int").alias("seq"), chunk.alias("chunk"), F.lit(last).alias("last"))

    def cells(c):
        return F.concat(F.transform(c, lambda x, i: row(i, x, False)), F.array(row(F.size(c), F.lit(""), True)))

    kept = [c for c in texts.columns if c != "text"]
    return texts.select(*kept, F.explode_outer(let(cut, cells)).alias("_c")).select(*kept, "_c.*")


def streamed(rows, provider, entries=None, **options):
    """Chunk rows played through the streaming job, read back as a table.

    `entries` (scope_id, entries) goes with each stream's first chunk only.  With `idle_seconds`, a chunk comes
    every second, and a row without a stream moves time on by a day at the end.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("provider", F.lit(provider)).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    if entries is None:
        rows = rows.withColumn("entries", F.lit(None).cast("map<string,string>"))
    else:
        # The values of a scope are sent once a stream, not once a chunk.
        first = rows.filter("seq = 0").join(entries, "scope_id", "left")
        rows = rows.filter("seq > 0").withColumn("entries", F.lit(None).cast("map<string,string>")).unionByName(first)
    names = ["stream_id", "seq", "chunk", "last", "provider", "entries", "at"]
    folder = new_folder(spark, "run")
    rows.select(names).write.parquet(f"{folder}/in")
    if "idle_seconds" in options:
        clock = {"seq": F.lit(0), "last": F.lit(True), "at": F.timestamp_seconds(F.lit(1_700_086_400))}
        ends = [clock.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.select(names).schema]
        spark.range(1).select(ends).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.select(names).schema).parquet(f"{folder}/in")
    return relay.run_to_table(relay.relay(source, **options), folder)


_STREAMS = f"with {TURNS}, s as (select cast(scope_id as varchar) || '-' || cast(text_ord as varchar) as stream_id, text, masked_text, text_ord from masked)"


@query(
    "s06_sse_events",
    _STREAMS + ", p as (select stream_id, text_ord, unnest(regexp_extract_all(masked_text, '(?s).{1,25}')) as piece, generate_subscripts(regexp_extract_all(masked_text, '(?s).{1,25}'), 1) as i from s) "
    "select stream_id, i::int as event_no, piece from p",
)
def s06_sse_events(spark, sf):
    texts, _ = answers(spark, sf)
    whole = sse.streams(chunks(texts.drop("scope_id")).filter("not last"))
    said = sse.events(whole).withColumn("piece", F.get_json_object("data", "$.choices[0].delta.content"))
    return said.filter("piece is not null").select("stream_id", "event_no", "piece")


@query(
    "s06_chunk_events",
    _STREAMS + ", p as (select stream_id, text_ord, unnest(regexp_extract_all(masked_text, '(?s).{1,25}')) as piece, generate_subscripts(regexp_extract_all(masked_text, '(?s).{1,25}'), 1) as i from s) "
    "select stream_id, i::int as event_no, piece from p",
)
def s06_chunk_events(spark, sf):
    texts, _ = answers(spark, sf)
    said = sse.chunk_events(chunks(texts.drop("scope_id")).filter("not last"))
    said = said.withColumn("piece", F.get_json_object("data", "$.choices[0].delta.content"))
    return said.filter("piece is not null").select("stream_id", "event_no", "piece")


@query(
    "s07_format_event",
    "select event_id, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || 'data: ' || cast(user_id as varchar) || chr(10) || chr(10) as written, "
    "':note' || chr(10) || 'data: new' || chr(10) || 'id: 7' || chr(10) || chr(10) as replaced from events",
)
def s07_format_event(spark, sf):
    data = F.concat_ws("\n", "props", F.col("user_id").cast("string"))
    raw = F.concat(F.lit(":note\ndata: "), F.col("props"), F.lit("\ndata: b\nid: 7\n\n"))
    return table(spark, sf, "events").select(
        "event_id",
        sse.format_event(F.col("event_type"), data).alias("written"),
        sse.replace_data(sse.fields_of(raw), F.lit("new")).alias("replaced"),
    )


@query("t06_cut_streams", _STREAMS + " select stream_id from s where text_ord % 3 = 2")
def t06_cut_streams(spark, sf):
    texts, _ = answers(spark, sf)
    whole = texts.select("stream_id", "text")
    return sse.without_final(sse.events(whole), whole)


def _entries(vault):
    return vault.groupBy("scope_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("entries"))


def relayed(spark, sf, provider):
    """The answers restored by the streaming job; a cut one has no closing row either, only silence."""
    texts, vault = answers(spark, sf, provider)
    rows = chunks(texts).filter(~(F.col("last") & (F.element_at(F.split("stream_id", "-"), -1).cast("long") % 3 == 2)))
    return streamed(rows, provider, _entries(vault), idle_seconds=30)


def _said(out, path):
    """stream_id, text: the text a client would join from the restored events."""
    texts = out.groupBy("stream_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_no", "out"))), lambda x: x["out"]), "").alias("text")
    )
    said = sse.events(texts).withColumn("piece", F.get_json_object("data", path)).filter("piece is not null")
    ordered = F.array_sort(F.collect_list(F.struct("event_no", "piece")))
    return said.groupBy("stream_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text"))


@query("t03_openai_stream", _STREAMS + " select stream_id, text from s")
def t03_openai_stream(spark, sf):
    return _said(relayed(spark, sf, "openai"), "$.choices[0].delta.content")


@query("t04_anthropic_stream", _STREAMS + " select stream_id, text from s")
def t04_anthropic_stream(spark, sf):
    return _said(relayed(spark, sf, "anthropic"), "$.delta.text")


@query("t07_failures", _STREAMS + " select stream_id, 'upstream_stream_cut' as failure from s where text_ord % 3 = 2")
def t07_failures(spark, sf):
    return relayed(spark, sf, "openai").filter("failure is not null").select("stream_id", "failure")


@query("t10_counters", _STREAMS + " select 0::bigint as unknown_events, count(*) filter (text_ord % 3 = 2) as failed_streams from s")
def t10_counters(spark, sf):
    return relay.counters(relayed(spark, sf, "anthropic"))


@query(
    "t09_string_fields",
    "select c_custkey as stream_id, 'choices' as list, unnest(['.choices[3].delta.content', '.model']) as path, unnest([c_name, 'm']) as value from customer",
)
def t09_string_fields(spark, sf):
    delta = F.struct(F.lit(3).alias("index"), F.struct(F.col("c_name").alias("content")).alias("delta"))
    body = F.to_json(F.struct(F.lit("m").alias("model"), F.array(delta).alias("choices")))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("stream_id"), F.lit(0).alias("event_no"), body.alias("data"))
    return string_fields(rows).select("stream_id", F.lit("choices").alias("list"), "path", "value")


@query("t08_split_keys", "select s_suppkey as stream_id from supplier where s_suppkey % 3 <> 2")
def t08_split_keys(spark, sf):
    # A key cut over three events of one field; over two choices; or only its first part.
    n = F.col("s_suppkey")
    key = F.concat(F.lit("sk-proj-"), F.substring(F.sha2(n.cast("string"), 256), 1, 30))
    parts = F.array(F.substring(key, 1, 12), F.substring(key, 13, 5), F.substring(key, 18, 21))
    base = spread(table(spark, sf, "supplier").select("s_suppkey")).select(n.alias("stream_id"), key.alias("key"), F.posexplode(parts).alias("event_no", "part"))
    which = F.col("stream_id") % 3
    index = F.when(which == 1, F.col("event_no")).otherwise(0)
    shown = F.when((which == 2) & (F.col("event_no") > 0), "nothing").otherwise(F.col("part"))
    choice = F.struct(index.alias("index"), F.struct(shown.alias("content")).alias("delta"))
    rows = base.select("stream_id", "event_no", F.to_json(F.struct(F.array(choice).alias("choices"))).alias("data"))
    keys = base.select("key").distinct()
    return split_keys(string_fields(rows), keys)


@query(
    "t01_parsed_chunks",
    _STREAMS + ", p as (select stream_id, unnest(regexp_extract_all(masked_text, '(?s).{1,25}')) as piece, generate_subscripts(regexp_extract_all(masked_text, '(?s).{1,25}'), 1) as i from s) "
    "select stream_id, i::bigint as event_no, piece from p",
)
def t01_parsed_chunks(spark, sf):
    # Pieces of 11 characters: line ends, fields and the closing blank line are cut anywhere.
    texts, _ = answers(spark, sf)
    out = streamed(chunks(texts.drop("scope_id"), 11), "events")
    said = out.select("stream_id", "event_no", F.get_json_object(F.regexp_extract("out", "data: (.*)", 1), "$.choices[0].delta.content").alias("piece"))
    return said.filter("piece is not null")


@query("t02_restored_text", _STREAMS + " select stream_id, text from s")
def t02_restored_text(spark, sf):
    # Pieces of 7 characters, shorter than any placeholder.
    masked, vault = masking.mask_scopes(scanned_turns(spark, sf))
    name = F.concat_ws("-", F.col("scope_id").cast("string"), F.col("text_ord").cast("string"))
    rows = chunks(masked.select("scope_id", name.alias("stream_id"), F.col("masked_text").alias("text")), 7)
    out = streamed(rows, "text", _entries(vault))
    ordered = F.array_sort(F.collect_list(F.struct("event_no", "out")))
    return out.groupBy("stream_id").agg(F.array_join(F.transform(ordered, lambda x: x["out"]), "").alias("text"))


_MOST_HELD = 600


def _chat(delta):
    choice = F.struct(F.lit(0).alias("index"), delta.alias("delta"))
    return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(choice).alias("choices"))), F.lit("\n\n"))


def _arguments(piece):
    call = F.struct(F.lit(0).alias("index"), F.struct(piece.alias("arguments")).alias("function"))
    return F.struct(F.array(call).alias("tool_calls"))


_FINISH = 'data: {"choices":[{"index":0,"delta":{},"finish_reason":"stop"}]}\n\ndata: [DONE]\n\n'


@query(
    "t05_held_too_long",
    _STREAMS + f" select stream_id, case when length(masked_text) > {_MOST_HELD} then 'stream_limit_exceeded' end as failure from s",
)
def t05_held_too_long(spark, sf):
    # Tool arguments are held until they are whole; a stream that would hold more than the limit fails.
    masked, _ = masking.mask_scopes(scanned_turns(spark, sf))
    name = F.concat_ws("-", F.col("scope_id").cast("string"), F.col("text_ord").cast("string"))
    pieces = F.regexp_extract_all(F.col("masked_text"), F.lit(r"(?s).{1,50}"), F.lit(0))
    text = F.concat(F.array_join(F.transform(pieces, lambda p: _chat(_arguments(p))), ""), F.lit(_FINISH))
    out = streamed(chunks(masked.select(name.alias("stream_id"), text.alias("text"))), "openai", most_chars=_MOST_HELD)
    return out.groupBy("stream_id").agg(F.max("failure").alias("failure"))


@query("t06_idle_streams", _STREAMS + " select stream_id, text, 'upstream_stream_cut' as failure from s where text_ord % 3 = 2")
def t06_idle_streams(spark, sf):
    out = relayed(spark, sf, "openai")
    failed = out.filter("failure is not null").select("stream_id", "failure")
    return _said(out, "$.choices[0].delta.content").join(failed, "stream_id")


_WATCHED = "'sk-proj-' || substr(sha256(cast(c_nationkey as varchar)), 1, 30)"


@query(
    "t08_key_watch",
    f"with c as (select cast(c_custkey as varchar) as stream_id, c_custkey % 4 as which, {_WATCHED} as key from customer) "
    "select stream_id, case when which <> 2 then 'bad_upstream_response' end as failure, "
    "case when which < 2 then substr(key, 1, 17) when which = 2 then substr(key, 1, 12) || 'nothingnothing' else '' end as said from c",
)
def t08_key_watch(spark, sf):
    # A key over three events of one choice; over three choices; only its first part; in tool arguments.
    hashed = F.concat(F.lit("sk-proj-"), F.substring(F.sha2(F.col("n_nationkey").cast("string"), 256), 1, 30))
    # The configured keys: one for each of the 25 nations.
    keys = tuple(r.key for r in table(spark, sf, "nation").select(hashed.alias("key")).collect())
    which = F.col("c_custkey") % 4
    key = F.concat(F.lit("sk-proj-"), F.substring(F.sha2(F.col("c_nationkey").cast("string"), 256), 1, 30))
    parts = F.array(*[F.substring(key, F.lit(a), F.lit(n)) for a, n in ((1, 12), (13, 5), (18, 21))])

    def event(p, i):
        said = F.when((which == 2) & (i > 0), "nothing").otherwise(p)
        choice = F.struct(F.when(which == 1, i).otherwise(0).alias("index"), F.struct(said.alias("content")).alias("delta"))
        spoken = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(choice).alias("choices"))), F.lit("\n\n"))
        whole = F.concat(F.when(i == 0, '{"k": "').otherwise(""), p, F.when(i == 2, '"}').otherwise(""))
        return F.when(which == 3, _chat(_arguments(whole))).otherwise(spoken)

    text = F.concat(F.array_join(F.transform(parts, event), ""), F.lit(_FINISH))
    streams = spread(table(spark, sf, "customer").select("c_custkey", "c_nationkey")).select(F.col("c_custkey").cast("string").alias("stream_id"), text.alias("text"))
    out = streamed(chunks(streams), "openai", keys=keys)
    said = F.get_json_object(F.regexp_extract("out", "data: (.*)", 1), "$.choices[0].delta.content")
    ordered = F.array_sort(F.collect_list(F.struct("event_no", F.coalesce(said, F.lit("")).alias("said"))))
    return out.groupBy("stream_id").agg(
        F.max("failure").alias("failure"), F.array_join(F.transform(ordered, lambda x: x["said"]), "").alias("said")
    )
