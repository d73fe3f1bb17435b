"""Server-sent events as tables: chunks to events, and events to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from velaria.session import stored

# --- Fixed values: limits of a well-formed stream ---------------------------------------------
MAX_LINE_CHARS = 1024 * 1024
MAX_EVENT_CHARS = 4 * 1024 * 1024
BOM = "\ufeff"
#: A line break, never the first half of one.
_BREAK = r"(?:\r\n|\r(?!\n)|\n)"
LINE = r"[^\r\n]*(?:\r\n|\r|\n)"
FIELDS = "array<struct<name:string,value:string>>"


def streams(chunks: DataFrame, stream="stream_id", seq="seq", chunk="chunk") -> DataFrame:
    """stream, text: the chunks of each stream joined in order, a leading byte order mark dropped.

    One answer of a provider is one stream; its text is one cell.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq), F.col(chunk))))
    text = F.array_join(F.transform(ordered, lambda c: c[chunk]), "")
    return chunks.groupBy(stream).agg(F.regexp_replace(text, "\\A\ufeff", "").alias("text"))


def events(texts: DataFrame, stream="stream_id") -> DataFrame:
    """stream, event_no, fields, event, data, raw: finished events that hold a field, in order."""
    # A whole event: its lines, then the blank one.
    block = rf"(?:[^\r\n]+{_BREAK})*{_BREAK}"
    raws = F.regexp_extract_all(F.col("text"), F.lit(block), F.lit(0))
    rows = texts.select(stream, F.posexplode_outer(raws).alias("_no", "raw")).filter("raw is not null")
    return _with_fields(rows, stream)


def _with_fields(rows: DataFrame, stream: str) -> DataFrame:
    fielded = rows.withColumn("fields", fields_of(F.col("raw"))).filter(F.size("fields") > 0)
    named = F.filter("fields", lambda f: f["name"] == "event")
    said = F.filter("fields", lambda f: f["name"] == "data")
    return fielded.select(
        stream,
        F.col("_no").alias("event_no"),
        "fields",
        F.try_element_at(named, F.lit(-1))["value"].alias("event"),
        F.when(F.size(said) > 0, F.array_join(F.transform(said, lambda f: f["value"]), "\n")).alias("data"),
        "raw",
    )


#: Just after a blank line: a line break at the start of the text, or right after another one.
_INSIDE = rf"(?<=(?:\n|\r(?!\n)){_BREAK})"
_AT_START = rf"(?<=(?:\A|\n|\r(?!\n)){_BREAK})"


def chunk_events(chunks: DataFrame, stream="stream_id", seq="seq", chunk="chunk") -> DataFrame:
    """What `events(streams(chunks))` gives, without a stream in one cell, task or group: a segmented scan.

    Whether a chunk begins at the start of a line is told by the last character before it, so each chunk is cut at its
    blank lines by itself.  Chunks are dealt out by range of (stream, seq); what a range hands on (its last character,
    its number of chunks, its number of blank lines) is one row, and running sums over those rows number the events.
    Then only the pieces of one event meet.  Rows of one `seq` go by their text; null and empty chunks are nothing.
    """
    rows = chunks.filter((F.col(chunk) != "") & F.col(seq).isNotNull()).select(
        F.col(stream).alias("_s"), F.col(seq).alias("_q"), F.col(chunk).alias("_c")
    )
    ranged = stored(rows.repartitionByRange("_s", "_q", "_c").withColumn("_part", F.spark_partition_id()), "chunks")
    # Within a range; a stream's ranges follow one another.
    here = Window.partitionBy("_s", "_part").orderBy("_q", "_c")
    parts = Window.partitionBy("_s").orderBy("_part")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    placed = F.struct("_q", "_c")
    ends = ranged.groupBy("_s", "_part").agg(
        F.count("*").alias("_n"), F.max_by(F.right("_c", F.lit(1)), placed).alias("_tail"),
        F.max_by(F.col("_c") == BOM, placed).alias("_mark"), F.min_by(F.left("_c", F.lit(1)), placed).alias("_head"),
    )
    carried = ends.select(
        "_s", "_part",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"),
        F.lag("_tail").over(parts).alias("_tail"), F.lag("_mark").over(parts).alias("_mark"), F.lead("_head").over(parts).alias("_head"),
    )
    seen = _same_part(ranged, carried)
    seen = seen.withColumns(
        {
            "_i": F.col("_n") + F.row_number().over(here),
            "_tail": F.coalesce(F.lag(F.right("_c", F.lit(1))).over(here), "_tail"),
            "_mark": F.coalesce(F.lag(F.col("_c") == BOM).over(here), "_mark"),
            "_head": F.coalesce(F.lead(F.left("_c", F.lit(1))).over(here), "_head"),
        }
    )
    # A break of two characters belongs to the chunk it begins in; a leading byte order mark is dropped.
    whole = F.when(F.col("_i") == 1, F.regexp_replace("_c", f"\\A{BOM}", "")).otherwise(F.col("_c"))
    whole = F.when((F.col("_tail") == "\r") & F.startswith(whole, F.lit("\n")), F.substring(whole, F.lit(2), F.length(whole))).otherwise(whole)
    whole = F.when((F.col("_head") == "\n") & F.endswith(whole, F.lit("\r")), F.concat(whole, F.lit("\n"))).otherwise(whole)
    fresh = (F.col("_i") == 1) | F.col("_tail").isin("\r", "\n") | ((F.col("_i") == 2) & F.col("_mark"))
    cut = F.when(fresh, F.split("_w", _AT_START)).otherwise(F.split("_w", _INSIDE))
    pieces = stored(seen.withColumn("_w", whole).select("_s", "_part", "_q", "_c", cut.alias("_p")), "pieces")
    # The last piece is what stays open; each of the others ends with a blank line.
    closed = F.size("_p") - 1
    blanks = pieces.groupBy("_s", "_part").agg(F.sum(closed).alias("_n"))
    before = blanks.select("_s", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    upto = here.rowsBetween(Window.unboundedPreceding, -1)
    numbered = _same_part(pieces, before).withColumn("_before", F.col("_before") + F.coalesce(F.sum(closed).over(upto), F.lit(0)))
    parted = numbered.select("_s", "_q", "_c", "_before", closed.alias("_closed"), F.posexplode("_p").alias("_k", "_t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_q", "_c", "_t"))), lambda x: x["_t"]), "")
    raws = (
        parted.groupBy("_s", (F.col("_before") + F.col("_k")).cast("int").alias("_no"))
        .agg(joined.alias("raw"), F.max(F.col("_k") < F.col("_closed")).alias("_done"))
        .filter("_done")
    )
    return _with_fields(raws.select(F.col("_s").alias(stream), "_no", "raw"), stream)


def _same_part(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """`rows` with what was worked out for their stream and range; a null stream is a stream."""
    same = F.col("r._s").eqNullSafe(F.col("p._s")) & (F.col("r._part") == F.col("p._part"))
    more = [F.col(f"p.{c}") for c in parts.columns if c not in ("_s", "_part")]
    return rows.alias("r").join(parts.alias("p"), same).select("r.*", *more)


def fields_of(raw: Column) -> Column:
    """Fields of an event in order; a comment has an empty name and keeps its text."""
    lines = F.filter(F.split(raw, r"\r\n|\r|\n"), lambda x: x != "")

    def field(line):
        colon = F.instr(line, ":")
        name = F.when(colon > 0, F.substring(line, F.lit(1), colon - 1)).otherwise(line)
        rest = F.when(colon > 0, F.substring(line, colon + 1, F.length(line))).otherwise("")
        value = F.when((name != "") & rest.startswith(" "), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)
        return F.struct(name.alias("name"), value.alias("value"))

    return F.transform(lines, field).cast(FIELDS)


def malformed(texts: DataFrame, stream="stream_id") -> DataFrame:
    """Streams with a line or an event over its limit."""
    longest_line = F.array_max(F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: F.length(x)))
    longest_event = F.array_max(F.transform(F.split("text", r"(?:\r\n|\r|\n){2}"), lambda x: F.length(x)))
    return texts.filter((longest_line > MAX_LINE_CHARS) | (longest_event > MAX_EVENT_CHARS)).select(stream)


def unfinished(texts: DataFrame, stream="stream_id") -> DataFrame:
    """Streams that end inside an event."""
    return texts.filter(F.rlike("text", F.lit(r"(?:\A|[\r\n])[^\r\n]+(?:\r\n|\r|\n)?\z"))).select(stream)


def without_final(events_table: DataFrame, texts: DataFrame, stream="stream_id") -> DataFrame:
    """Streams closed without their final event (`[DONE]`, message_stop or the provider's error)."""
    kind = F.get_json_object("data", "$.type")
    final = events_table.filter(
        (F.trim("data") == "[DONE]")
        | kind.isin("message_stop", "error")
        | F.get_json_object("data", "$.error").isNotNull()
    )
    return texts.select(stream).join(final.select(stream).distinct(), stream, "left_anti")


def line_of(name: Column, value: Column) -> Column:
    return F.when(name == "", F.concat(F.lit(":"), value, F.lit("\n"))).otherwise(
        F.concat(name, F.lit(": "), value, F.lit("\n"))
    )


def _data_lines(data: Column) -> Column:
    return F.array_join(F.transform(F.split(data, "\n"), lambda p: F.concat(F.lit("data: "), p, F.lit("\n"))), "")


def format_event(event: Column, data: Column) -> Column:
    """A new event: an optional name, and one data line per line of `data`."""
    head = F.when(event.isNull(), "").otherwise(line_of(F.lit("event"), event))
    return F.concat(head, _data_lines(data), F.lit("\n"))


def replace_data(fields: Column, data: Column) -> Column:
    """The event again with `data` where its first data line was, other fields and order kept."""
    first = F.array_position(F.transform(fields, lambda f: f["name"]), "data")
    lines = F.transform(
        fields,
        lambda f, i: F.when(f["name"] != "data", line_of(f["name"], f["value"]))
        .when(i + 1 == first, _data_lines(data))
        .otherwise(""),
    )
    tail = F.when(first == 0, _data_lines(data)).otherwise("")
    return F.concat(F.array_join(lines, ""), tail, F.lit("\n"))
