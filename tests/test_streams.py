"""The streaming job over typed state: any chunking, timers, values sent once, keys cut over fields."""

from __future__ import annotations

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from velaria.operators import secrets
from velaria.session import new_folder
from velaria.streaming import relay
from velaria.streaming.keywatch import KeyMatcher, Watch, layers

KEYS = ("sk-proj-ABCDEFGHIJKLMNOPQRSTUVWX", "0123456789abcdef0123", "short7", "")
ROWS = "stream_id string, seq long, chunk string, last boolean, provider string, entries map<string,string>, at timestamp"


def _chat(**delta):
    return "data: " + json.dumps({"choices": [{"index": 0, "delta": delta}]}, ensure_ascii=False) + "\n\n"


END = "data: [DONE]\r\n\r\n"


def _chunks(rng, name, text, provider, entries, closed=True, start=100):
    cuts = sorted(rng.sample(range(1, len(text)), min(len(text) - 1, rng.randint(0, 25))))
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
    rows = [(name, i, p, False, provider, entries if i == 0 else None, start + i) for i, p in enumerate(parts)]
    return rows + ([(name, len(parts), None, True, provider, None, start + len(parts))] if closed else [])


def _frame(spark, rows):
    kinds = ROWS.replace("at timestamp", "s long")
    return spark.createDataFrame(rows, kinds).withColumn("at", F.timestamp_seconds("s")).drop("s")


def _play(spark, rows, files=3, **options):
    folder = new_folder(spark, "streams-test")
    _frame(spark, rows).repartition(files).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", "1").parquet(f"{folder}/in")
    reports, out = relay.run_and_report(relay.relay(source, **options), folder)
    got = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: (r.stream_id, r.event_no)):
        got[r.stream_id].append((r.out, r.failure))
    return reports, got


def _state_rows(reports):
    return [s["numRowsTotal"] for r in reports for s in r["stateOperators"]]


def test_any_chunking_any_order_and_a_hot_stream(spark):
    rng = random.Random(4)
    values = {"ES_DNI_1": '1"2', "EMAIL_2": "é@x"}
    say = "[[ES_DNI_1]] a [[email_2 ]] [[!x 🙂 "
    text = ": hi\r\n\r\n" + _chat(content=say) + _chat(content="[[ES_D") + _chat(content="NI_1]]") + END
    rows = [r for i in range(30) for r in _chunks(rng, f"s{i}", text, "openai", values)]
    # A third of all rows are one stream.
    rows += [r for r in _chunks(random.Random(1), "hot", ": hi\n\n" + _chat(content=say) * 400 + END, "openai", values)]
    rng.shuffle(rows)
    reports, got = _play(spark, rows)
    assert len(got) == 31
    for name, events in got.items():
        said = ""
        for line in "".join(out for out, _ in events).splitlines():
            if line.startswith("data: {"):
                said += json.loads(line[6:])["choices"][0]["delta"].get("content", "")
        one = '1"2 a é@x [[x 🙂 '
        assert said == (one * 400 if name == "hot" else one + '1"2')
        assert all(f is None for _, f in events)
    assert _state_rows(reports)[-1] == 0


def test_a_silent_stream_is_cut_by_a_timer(spark):
    rng = random.Random(5)
    text = _chat(content="held [[ES_") + "data: half"
    rows = _chunks(rng, "silent", text, "openai", {"ES_DNI_1": "V"}, closed=False)
    rows += _chunks(rng, "done", _chat(content="x") + END, "openai", None)
    rows += [("waits", 5, "never reached", False, "openai", None, 103)]
    rows += [(None, 0, None, True, None, None, 10_000)]
    reports, got = _play(spark, rows, files=1, idle_seconds=20)
    assert [f for _, f in got["silent"]] == [None, "upstream_stream_cut"], got
    said = [json.loads(out[6:])["choices"][0]["delta"]["content"] for out, _ in got["silent"]]
    assert said == ["held ", "[[ES_"]
    assert [f for _, f in got["done"]] == [None, None]
    assert [f for _, f in got["waits"]] == ["upstream_stream_cut"]
    assert _state_rows(reports)[-1] == 0


def test_rows_in_a_batch_are_the_same_as_in_a_stream(spark):
    rng = random.Random(6)
    rows = [r for i in range(8) for r in _chunks(rng, f"s{i}", _chat(content=f"n{i} [[A_1]]") * 5 + END, "openai", {"A_1": "v"})]
    rng.shuffle(rows)
    _, streamed = _play(spark, rows)
    batch = relay.relay(_frame(spark, rows)).collect()
    assert sorted((r.stream_id, r.event_no, r.out) for r in batch) == sorted(
        (name, i, out) for name, events in streamed.items() for i, (out, _) in enumerate(events)
    )


def test_a_key_is_stopped_before_its_last_part(spark):
    rng = random.Random(7)
    key = KEYS[0]
    parts = [key[:9], key[9:14], key[14:20], key[20:]]

    def said(path):
        return "".join("data: " + json.dumps({"choices": [path(i, p)]}) + "\n\n" for i, p in enumerate(parts)) + _chat(content="later") + END

    whole = {
        "one field": said(lambda i, p: {"index": 0, "delta": {"content": p}}),
        "many choices": said(lambda i, p: {"index": i, "delta": {"content": p}}),
        "odd place": said(lambda i, p: {"index": i, "delta": {}, f"x{i}": {"content": p}}),
        "escaped": _chat(content="fine") + 'data: {"choices":[{"index":0,"delta":{"content":"' + "".join(f"\\u{ord(c):04x}" for c in key) + '"}}]}\n\n' + END,
        "restored": _chat(content="a [[A_1]]") + _chat(content=key[15:]) + END,
        "clean": _chat(content=key[:12]) + _chat(content="sk-proj-****...UVW") + _chat(content="**UVWX**") + END,
        "masked": _chat(content="sk-proj-****...") + _chat(content="UVWX.") + END,
    }
    rows = [r for name, text in whole.items() for r in _chunks(rng, name, text, "openai", {"A_1": key[:15]})]
    rng.shuffle(rows)
    reports, got = _play(spark, rows, keys=KEYS)
    for name, events in got.items():
        out = "".join(o for o, _ in events)
        failed = [f for _, f in events if f]
        assert failed == ([] if name == "clean" else ["bad_upstream_response"]), name
        assert "later" not in out and key[8:18] not in out and key[-8:] not in out
    assert parts[0] in got["one field"][0][0] and parts[1] in got["one field"][1][0]
    assert _state_rows(reports)[-1] == 0


def test_matcher_agrees_with_the_table_search(spark):
    rng = random.Random(8)
    pieces = [KEYS[0], KEYS[0][8:18], KEYS[0][-4:], KEYS[0][8:12], KEYS[0][-9:], KEYS[1], KEYS[1][3:13], KEYS[1][:9], "short7", "**", "…", "*", " ", "x", ".", "-", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(1500)]
    matcher = KeyMatcher.of(KEYS)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    keys = spark.createDataFrame([(k,) for k in KEYS], "key string")
    found = {r.id for r in secrets.texts_with_keys(rows, keys, ["id"]).collect()}
    assert found == {i for i, t in enumerate(texts) if matcher.found_in(t)}
    assert not KeyMatcher.of(("",)).found_in("anything")


def test_tails_carry_over_events_of_any_size():
    key = KEYS[0]
    rng = random.Random(9)
    for _ in range(200):
        cuts = sorted(rng.sample(range(len(key)), rng.randint(0, 8)))
        parts = [key[a:b] for a, b in zip([0, *cuts], [*cuts, len(key)])]
        watch = Watch(KeyMatcher.of(KEYS), {})
        hits = [watch.given_out("x", [json.dumps({"a": [{"index": rng.randint(0, 3), "t": p}]})]) for p in parts]
        joined, first = "", None
        for i, p in enumerate(parts):
            joined += p
            if first is None and KeyMatcher.of(KEYS).found_in(joined):
                first = i
        assert hits.index(True) == first


def test_layers_end_only_when_nothing_is_new():
    text = "key"
    for _ in range(12):
        text = json.dumps({"v": text})
    assert "key" in set(layers(text))
    assert list(layers('"a')) == ['"a']


def test_numbers_stay_as_they_were_written():
    body = '{"id": 1e400, "x": 1.10, "n": -0, "choices": [{"index": 0, "delta": {"content": "[[A_1]]"}, "p": 2.50}]}'
    rows = relay.step(relay.new_state(), "openai", f"data: {body}\n\n", {"A_1": "v"})
    assert rows[0][1] == "data: " + body.replace("[[A_1]]", "v") + "\n\n"
    assert relay.restored_json('{"a": 1.10, "[[A_1]]": ["[[A_1]]", 1e400]}', {"A_1": '"'}) == '{"a": 1.10, "[[A_1]]": ["\\"", 1e400]}'


@pytest.mark.parametrize("most", [None, 30])
def test_held_text_without_and_with_a_limit(spark, most):
    call = {"tool_calls": [{"index": 0, "function": {"arguments": "x" * 20}}]}
    state, out = relay.new_state(), []
    for chunk in [_chat(**call)] * 3:
        for at in range(0, len(chunk), 10):
            out += relay.step(state, "openai", chunk[at : at + 10], {}, most and 100 + most)
    assert [r[3] for r in out if r[3]] == []
    if most:
        assert relay.step(state, "openai", "x" * 200, {}, most)[-1][3] == "stream_limit_exceeded"


def test_chunks_are_cut_once_a_text(spark):
    from velaria.plans.streams import chunks

    texts = [("a", "x" * 95), ("b", ""), ("c", "é🙂\n" * 30)]
    cut = chunks(spark.createDataFrame(texts, "stream_id string, text string"))
    got = sorted((r.stream_id, r.seq, r.chunk, r.last) for r in cut.collect())
    want = []
    for name, text in texts:
        parts = [text[i : i + 40] for i in range(0, len(text), 40)]
        want += [(name, i, p, False) for i, p in enumerate(parts)] + [(name, len(parts), "", True)]
    assert got == sorted(want)
    # Nothing above the explode, which runs for every chunk, reads the text again; nor does a filter below it.
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert "regexp" not in above and "Filter" not in plan and below.count("regexp_extract_all") == 1
