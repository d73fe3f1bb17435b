"""String fields of streamed events, and keys split over them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from velaria.operators.secrets import texts_with_keys
from velaria.streaming.keywatch import strings


def string_fields(events: DataFrame, stream="stream_id", order="event_no", data="data") -> DataFrame:
    """stream, order, place, path, name, value: every string of an event's JSON with its path.

    A text that can't be parsed is one string with an empty path.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, no, text in zip(batch[stream], batch[order], batch[data]):
                try:
                    found = list(strings(json.loads(text)))
                except (ValueError, TypeError, RecursionError):
                    # Not JSON, or nested too deep to parse: the whole text is one field, so nothing goes unread.
                    found = [] if text is None else [("", "", text)]
                rows.extend((key, no, i, *f) for i, f in enumerate(found))
            yield pd.DataFrame(rows, columns=[stream, order, "place", "path", "name", "value"])

    kinds = {c: events.schema[c].dataType.simpleString() for c in (stream, order)}
    fields = f"`{stream}` {kinds[stream]}, `{order}` {kinds[order]}, place int, path string, name string, value string"
    return events.select(stream, order, data).mapInPandas(walk, fields)


def split_keys(fields: DataFrame, keys: DataFrame, stream="stream_id", order="event_no") -> DataFrame:
    """Streams where a key, or a piece of one, shows up once a field's values are joined.

    Values are joined per path and, as a second net, per field name in any path.
    """
    joined = None
    for by in ("path", "name"):
        said = F.array_sort(F.collect_list(F.struct(order, "place", "value")))
        one = fields.groupBy(stream, by).agg(
            F.array_join(F.transform(said, lambda x: x["value"]), "").alias("text")
        ).select(stream, F.concat(F.lit(f"{by}:"), F.col(by)).alias("net"), "text")
        joined = one if joined is None else joined.unionByName(one)
    return texts_with_keys(joined, keys, [stream, "net"]).select(stream).distinct()
