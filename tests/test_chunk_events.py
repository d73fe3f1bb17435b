"""Events of chunked streams, found by a scan over chunks, against the parse of whole texts."""

import random

from velaria.sources import sse

SCHEMA = "stream_id string, seq long, chunk string"


def _found(rows):
    return sorted((r["stream_id"] or "", r["event_no"], r["raw"], r["event"], r["data"]) for r in rows.collect())


def _random_text(rng, n):
    return "".join(rng.choice(["\n", "\r", "\r\n", "data: a", "event: b", ":", "é", "﻿", "x\n\n", "data:c\r\n\r\n"]) for _ in range(n))


def test_any_chunking_gives_the_events_of_the_whole(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        text = rng.choice(["", "﻿"]) + _random_text(rng, rng.randint(0, 60))
        at = seq = 0
        while at < len(text):
            size = rng.choice([1, 1, 2, 3, 9])
            rows += [(f"s{i}", seq, text[at : at + size])]
            # Empty and null chunks lie between.
            rows += rng.choice([[], [], [(f"s{i}", seq + 1, "")], [(f"s{i}", seq + 1, None)]])
            at, seq = at + size, seq + 2
    # One stream holds most chunks, over many ranges.
    long = "".join(f"event: e{k}\r\ndata: {k}\r\n\r\n" for k in range(1500))
    rows += [("hot", k, long[k * 5 : k * 5 + 5]) for k in range(-(-len(long) // 5))]
    rng.shuffle(rows)
    chunks = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = _found(sse.events(sse.streams(chunks)))
    assert _found(sse.chunk_events(chunks)) == want
    assert sum(w[0] == "hot" for w in want) == 1500


def test_ends_of_streams(spark):
    rows = [
        ("open", 0, "data: a\n"), ("cr", 0, "data: a\r"), ("cr", 1, "\r"), ("crlf", 0, "data: a\r"), ("crlf", 1, "\n\r"), ("crlf", 2, "\n"),
        ("mark", 0, "﻿"), ("mark", 1, "\n"), ("mark", 2, "data: b\n\n"), ("none", 0, None), (None, 0, "data: n\n"), (None, 1, "\n"),
    ]
    chunks = spark.createDataFrame(rows, SCHEMA)
    got = _found(sse.chunk_events(chunks))
    assert got == _found(sse.events(sse.streams(chunks)))
    assert [(s, n, d) for s, n, _, _, d in got] == [("", 0, "n"), ("cr", 0, "a"), ("crlf", 0, "a"), ("mark", 1, "b")]
    assert sse.chunk_events(chunks.limit(0)).count() == 0
