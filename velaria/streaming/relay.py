"""Streamed answers restored as they arrive: one keyed state per stream.

Chunks of a stream may be cut anywhere and may arrive late; the state holds what is half
received, so any chunking gives the same text.  A scope's values come once, with a stream's first
chunk, and stay in its state.  State is typed: a value for the place in the stream, maps for values,
early chunks, held fields and field tails, a list for the open event; only what changes is written.

What an answer format carries is a tree of rules; one walk applies it to every event:

* `text` is given out up to what may still become a placeholder,
* `json` is held until its place closes, and given out whole and valid,
* `values` is a finished object, restored where it stands.

A stream that fails ends with what was held as text and a failure code; half arguments aren't given out.
With `keys`, an event that would complete a key, or a piece of one, is not given out and the stream fails.
With `idle`, a timer in event time ends a stream of which nothing came for so long, as cut.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from velaria.streaming.keywatch import KeyMatcher, Watch


# --- Fixed values: placeholders, and the names of the two answer formats -----------------------
MARK = re.compile(r"(\[\[+)!|\[\[[ \t]*([A-Za-z]+(?:_[A-Za-z]+)*_[0-9]+)[ \t]*\]\]")
PENDING = re.compile(r"\[{1,2}\Z|\[\[[ \t]*(?:(?P<name>[A-Za-z]+(?:_[A-Za-z]+)*(?:_[0-9]*)?)(?:(?<=[0-9])[ \t]*\]?)?)?\Z")
CALL = {"function": {"arguments": "json"}}
CHOICE = {
    "delta": {"content": "text", "refusal": "text", "tool_calls": {"*": CALL}, "function_call": {"arguments": "json"}}
}
CHAT = {"choices": {"*": CHOICE}}
CHAT_DELTA = {"role", *CHOICE["delta"]}
CHAT_ENVELOPE = {"id", "object", "created", "model", "system_fingerprint", "service_tier", "index", "type"}
BLOCK_PARTS = {"content_block_start": "content_block", "content_block_delta": "delta", "content_block_stop": None}
BLOCKS = {
    "text": {"text": "text"}, "tool_use": {"input": "values"}, "text_delta": {"text": "text"},
    "input_json_delta": {"partial_json": "json"},
}
BLOCK_DELTAS = {"text": "text_delta", "partial_json": "input_json_delta"}
UNTOUCHED_DELTAS = ("thinking_delta", "signature_delta")
OTHER_EVENTS = ("ping", "error", "message_start", "message_delta", "message_stop")
MALFORMED, TOO_LONG, CUT = "bad_upstream_response", "stream_limit_exceeded", "upstream_stream_cut"
KEY = "bad_upstream_response"
OUTPUT = "stream_id string, event_no long, out string, unknown long, failure string"


class Failed(Exception):
    """Its only argument is the failure's code."""


# --- One stream's text to events --------------------------------------------------------------


def parse(state: dict, chunk: str, most: int | None = None) -> Iterator[tuple]:
    """Events finished by `chunk`, each (fields, raw text); what is half received stays in `state`."""
    raw, fields = state.get("raw", ""), state.get("fields", [])
    if chunk and state.pop("after_cr", False) and chunk[0] == "\n":
        # The second half of a line end cut in two.
        raw, chunk = (raw + "\n" if raw else raw), chunk[1:]
    if chunk and not state.get("started"):
        state["started"], chunk = True, chunk.removeprefix("\ufeff")
    text, done = state.get("partial", "") + chunk, 0
    for match in re.finditer(r"([^\r\n]*)(\r\n|\r|\n)", text):
        line, done = match[1], match.end()
        raw += match[0]
        if line:
            name, colon, value = line.partition(":")
            fields.append([name, value[1:] if name and colon and value.startswith(" ") else value])
        else:
            if fields:
                yield fields, raw
            fields, raw = [], ""
    state["partial"], state["fields"], state["raw"] = text[done:], fields, raw
    if chunk:
        state["after_cr"] = text.endswith("\r")
    if most is not None and len(raw) + len(state["partial"]) > most:
        raise Failed(TOO_LONG)


def _lines(name, value):
    return "".join(f"{name}: {part}\n" if name else f":{part}\n" for part in value.split("\n"))


def written(fields, data=None) -> str:
    """The fields as event text; `data` takes the place of the data lines."""
    out, placed = [], data is None
    for name, value in fields:
        if name != "data" or data is None:
            out.append(_lines(name, value))
        elif not placed:
            out.append(_lines("data", data))
            placed = True
    return "".join(out) + ("" if placed else _lines("data", data)) + "\n"


def _event(name: str | None, body: dict) -> str:
    head = [["event", name]] if name else []
    return written([*head, ["data", ""]], dumped(body))


def _data(fields) -> str | None:
    lines = [value for name, value in fields if name == "data"]
    return "\n".join(lines) if lines else None


#: Marks a number kept as it was written; no text that was received can hold it.
_AS_WRITTEN = f"{uuid.uuid4().hex}:"
_KEPT = re.compile(f'"{_AS_WRITTEN}([^"]*)"')


def _number(written: str):
    return int(written) if written.lstrip("-").isdigit() and str(int(written)) == written else _AS_WRITTEN + written


def _json(text: str):
    """Parsed text in which numbers other than plain integers are marked strings; None if it isn't JSON."""
    try:
        return json.loads(text, parse_float=_number, parse_int=_number)
    except (ValueError, RecursionError):
        return None


def dumped(node) -> str:
    """JSON text with all numbers as they were written."""
    return _KEPT.sub(r"\1", json.dumps(node, ensure_ascii=False))


# --- Text, and strings in JSON ------------------------------------------------------------------


def restored(text: str, values: dict) -> str:
    return MARK.sub(lambda m: m[1] or values.get((m[2] or "").upper(), m[0]), text)


def restored_values(node, values: dict):
    if isinstance(node, dict):
        return {name: restored_values(inner, values) for name, inner in node.items()}
    if isinstance(node, list):
        return [restored_values(inner, values) for inner in node]
    return restored(node, values) if isinstance(node, str) else node


STRING = re.compile(r'("(?:[^"\\]|\\.)*")(\s*:)?', re.S)


def restored_json(text: str, values: dict) -> str:
    """Strings of valid JSON are restored where they stand, names and numbers stay; elsewhere values are escaped."""
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return restored(text, {token: json.dumps(value, ensure_ascii=False)[1:-1] for token, value in values.items()})

    def one(match):
        if match[2]:
            return match[0]
        said = json.loads(match[1])
        new = restored(said, values)
        return match[1] if new == said else json.dumps(new, ensure_ascii=False)

    return STRING.sub(one, text)


def settled(text: str, values: dict) -> int:
    """How much of `text` can no longer become part of an escape or of a token of `values`."""
    pending = PENDING.search(text)
    if pending is None:
        return len(text)
    name = (pending["name"] or "").upper()
    return pending.start() if any(token.startswith(name) for token in values) or not name else len(text)


# --- Rules applied to an event --------------------------------------------------------------------


class Walk:
    """One event's body under a tree of rules; what isn't given out yet goes to the state's slots."""

    def __init__(self, state: dict, values: dict):
        self.state, self.values, self.malformed = state, values, False

    def __call__(self, node, rule, path=()):
        if isinstance(rule, str):
            return self._field(node, rule, "/".join(path))
        if isinstance(node, list) and "*" in rule:
            return self._items(node, rule["*"], path)
        if not isinstance(node, dict):
            return node
        return {name: self(inner, rule[name], (*path, name)) if name in rule else inner for name, inner in node.items()}

    def _items(self, items, rule, path):
        """Items are told by their own index.  One without any is passed, one with a wrong index is not."""
        out = []
        for item in items:
            index = item.get("index") if isinstance(item, dict) else None
            if type(index) is int and index >= 0:
                out.append(self(item, rule, (*path, str(index))))
            elif path == ("choices",) or (isinstance(item, dict) and "index" in item):
                self.malformed = True
            else:
                self.state["unknown"] += 1
                out.append(item)
        return out

    def _field(self, value, rule, slot):
        if rule == "values":
            return restored_values(value, self.values)
        if not isinstance(value, str) or value.startswith(_AS_WRITTEN):
            return value
        text = self.state["slots"].get(slot, ["", ""])[1] + value
        cut = 0 if rule == "json" else settled(text, self.values)
        self.state["slots"][slot] = [rule, text[cut:]]
        return restored(text[:cut], self.values)


def _natural(slot: str):
    return [(part.isdigit(), int(part) if part.isdigit() else 0, part) for part in slot.split("/")]


def close(state: dict, place: str, values: dict) -> Iterator[tuple[list[str], str]]:
    """(path, text) of what is held at a place, which is then empty."""
    for slot in sorted((s for s in state["slots"] if s.startswith(place)), key=_natural):
        rule, text = state["slots"].pop(slot)
        if text:
            yield slot.split("/"), restored(text, values) if rule == "text" else restored_json(text, values)


def put(node, path: list[str], text: str) -> None:
    """Add text to the field at a path, making what is missing on the way."""
    for step, following in zip(path, path[1:]):
        if isinstance(node, list):
            found = next((item for item in node if isinstance(item, dict) and item.get("index") == int(step)), None)
            if found is None:
                found = {"index": int(step)}
                node.append(found)
        else:
            found = node.get(step)
            if not isinstance(found, (dict, list)):
                found = node[step] = [] if following.isdigit() else {}
        node = found
    before = node.get(path[-1])
    node[path[-1]] = (before if isinstance(before, str) else "") + text


def says(node) -> bool:
    """Something is in a body besides its envelope."""
    if isinstance(node, dict):
        return any(says(inner) for name, inner in node.items() if name not in CHAT_ENVELOPE)
    if isinstance(node, list):
        return any(map(says, node))
    return node not in (None, "")


def chat_event(state: dict, fields, raw: str, values: dict) -> tuple[str, str | None]:
    text, names = _data(fields), [value for name, value in fields if name == "event"]
    if text is None:
        return raw, None
    if text.strip() == "[DONE]" and names[-1:] in ([], ["message"]):
        state["done"] = True
        return chat_rest(state, values) + raw, None
    body = _json(text)
    failed = isinstance(body, dict) and "error" in body and not isinstance(body.get("choices"), list)
    if names[-1:] not in ([], ["message"]) or not isinstance(body, dict) or not isinstance(body.get("choices"), list):
        state["done"] = state.get("done", False) or failed
        state["unknown"] += not failed
        return raw, None
    state["envelope"] = {name: value for name, value in body.items() if name not in ("choices", "usage")}
    walk = Walk(state, values)
    out = walk(body, CHAT)
    for choice in out["choices"]:
        delta = choice.get("delta")
        state["unknown"] += len(set(delta) - CHAT_DELTA) if isinstance(delta, dict) else 0
        if choice.get("finish_reason") is not None:
            for path, rest in close(state, f"choices/{choice['index']}/", values):
                put(out, path, rest)
    code = MALFORMED if walk.malformed else None
    if out == body:
        return raw, code
    return written(fields, dumped(out)) if says(out) else "", code


def chat_rest(state: dict, values: dict) -> str:
    """Held text of all choices, an event for each choice."""
    bodies: dict[str, dict] = {}
    for path, rest in close(state, "choices/", values):
        body = bodies.setdefault(path[1], {**state.get("envelope", {}), "choices": []})
        put(body, path, rest)
        body["choices"][0]["finish_reason"] = None
    return "".join(_event(None, body) for body in bodies.values())


def block_event(state: dict, fields, raw: str, values: dict) -> tuple[str, str | None]:
    text = _data(fields)
    body = None if text is None else _json(text)
    if not isinstance(body, dict):
        state["unknown"] += text is not None
        return raw, None
    kind, index = body.get("type"), body.get("index")
    if ("index" in body or kind in BLOCK_PARTS) and not (type(index) is int and index >= 0):
        return "", MALFORMED
    if kind not in BLOCK_PARTS:
        state["done"] = state.get("done", False) or kind in ("error", "message_stop")
        state["unknown"] += kind not in OTHER_EVENTS
        return (block_rest(state, values) if kind == "message_stop" else "") + raw, None
    if kind == "content_block_stop":
        return block_rest(state, values, index) + raw, None
    part = body.get(BLOCK_PARTS[kind])
    what = part.get("type") if isinstance(part, dict) else None
    if kind == "content_block_start":
        state["kinds"][str(index)] = what
    elif what not in BLOCKS or (what == "input_json_delta" and state["kinds"].get(str(index)) != "tool_use"):
        state["unknown"] += what not in UNTOUCHED_DELTAS
        return raw, None
    out = Walk(state, values)(part, BLOCKS.get(what, {}), (str(index),))
    if out == part:
        return raw, None
    body[BLOCK_PARTS[kind]] = out
    silent = kind == "content_block_delta" and not says(out)
    return "" if silent else written(fields, dumped(body)), None


def block_rest(state: dict, values: dict, index: int | None = None) -> str:
    out = []
    for path, rest in close(state, "" if index is None else f"{index}/", values):
        delta = {"type": BLOCK_DELTAS[path[1]], path[1]: rest}
        out.append(_event("content_block_delta", {"type": "content_block_delta", "index": int(path[0]), "delta": delta}))
    return "".join(out)


def plain_event(state: dict, fields, raw: str, values: dict) -> tuple[str, str | None]:
    """Events passed as they are."""
    state["done"] = True
    return raw, None


def text_part(state: dict, fields, raw: str, values: dict) -> tuple[str, str | None]:
    """A chunk of plain text, restored up to what may still become a placeholder."""
    state["done"] = True
    return Walk(state, values)(raw, "text", ("text",)), None


def text_rest(state: dict, values: dict) -> str:
    return "".join(text for _, text in close(state, "text", values))


FORMATS = {
    "openai": (chat_event, chat_rest), "anthropic": (block_event, block_rest), "events": (plain_event, lambda *_: ""),
    "text": (text_part, text_rest),
}


# --- Streams ----------------------------------------------------------------------------------------


def new_state() -> dict:
    return {"next": 0, "slots": {}, "kinds": {}, "fields": [], "unknown": 0, "events": 0}


def _bodies(out: str) -> list[str]:
    """The data of the events in a text that is about to be given out."""
    return [data for fields, _ in parse({}, out) if (data := _data(fields)) is not None]


def step(state: dict, provider: str, chunk: str | None, values: dict, most: int | None = None, watch: Watch | None = None) -> list[tuple]:
    """Rows (event_no, out, unknown, failure) of one chunk; None ends the stream."""
    if state.get("failed"):
        return []
    each, rest = FORMATS[provider]
    rows, code = [], None

    def holds_key(raw: str, out: str) -> bool:
        return watch is not None and (watch.received(raw) or (out != "" and watch.given_out(out, _bodies(out) if provider != "text" else [json.dumps(out)])))

    try:
        events = () if chunk is None else [(None, chunk)] if provider == "text" else parse(state, chunk, most)
        for fields, raw in events:
            before = state["unknown"]
            out, code = each(state, fields, raw, values)
            if holds_key(raw, out):
                raise Failed(KEY)
            rows.append((state["events"], out, state["unknown"] - before, None))
            state["events"] += 1
            if code:
                raise Failed(code)
        if most is not None and sum(len(text) for _, text in state["slots"].values()) > most:
            raise Failed(TOO_LONG)
        if chunk is None and provider == "text":
            last = rest(state, values)
            if holds_key("", last):
                raise Failed(KEY)
            rows.append((state["events"], last, 0, None))
        elif chunk is None and (not state.get("done") or state.get("partial") or state.get("fields")):
            raise Failed(CUT)
    except Failed as failure:
        state["failed"] = True
        state["slots"] = {slot: held for slot, held in state["slots"].items() if held[0] == "text"}
        last = rest(state, values)
        # What was held may be the part that completes a key: then only the failure goes out.
        rows.append((state["events"], "" if holds_key("", last) else last, 0, failure.args[0]))
    return rows


CORE = {
    "next": "long", "events": "long", "unknown": "long", "done": "boolean", "failed": "boolean", "started": "boolean",
    "after_cr": "boolean", "partial": "string", "raw": "string", "envelope": "string", "provider": "string", "timer": "long",
    "early": "int", "slots": "int", "kinds": "int", "fields": "int", "tails": "int", "values": "int",
}


class Relay(StatefulProcessor):
    """State of one stream; the counts in its core say which maps hold anything, so empty ones aren't asked."""

    def __init__(self, keys: tuple[str, ...], idle: int | None, most: int | None):
        self.keys, self.idle, self.most = keys, idle, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.core = handle.getValueState("core", ", ".join(f"`{n}` {t}" for n, t in CORE.items()))
        maps = {
            "early": ("seq long", "chunk string, last boolean"),
            "slots": ("slot string", "rule string, text string"), "kinds": ("block string", "kind string"), "tails": ("net string", "tail string"),
        }
        self.maps = {name: handle.getMapState(name, *schema) for name, schema in maps.items()}
        self.fields = handle.getListState("fields", "name string, value string")
        # Written once a stream, and read as a whole.
        self.values = handle.getListState("values", "token string, value string")

    def _load(self) -> dict:
        """The state as `step` takes it, and `_was`, what the maps held."""
        core = dict(zip(CORE, self.core.get() or ()))
        state = new_state() | {n: v for n, v in core.items() if v is not None and CORE[n] != "int"}
        if core.get("envelope"):
            state["envelope"] = _json(core["envelope"])
        was = {}
        for name in ("slots", "kinds", "tails"):
            items = self.maps[name].iterator() if core.get(name) else ()
            was[name] = {k[0]: tuple(v) for k, v in items}
        state["slots"] = {k: list(v) for k, v in was["slots"].items()}
        state["kinds"] = {k: v[0] for k, v in was["kinds"].items()}
        state["tails"] = {k: v[0] for k, v in was["tails"].items()}
        state["values"] = {k: v for k, v in self.values.get()} if core.get("values") else {}
        state["fields"] = [list(f) for f in self.fields.get()] if core.get("fields") else []
        return state | {"early": core.get("early") or 0, "timer": core.get("timer"), "_was": was, "_held": core, "_values": dict(state["values"])}

    def _save(self, state: dict) -> None:
        now = {
            "slots": {k: tuple(v) for k, v in state["slots"].items()}, "kinds": {k: (v,) for k, v in state["kinds"].items()},
            "tails": {k: (v,) for k, v in state["tails"].items()},
        }
        for name, held in now.items():
            was = state["_was"][name]
            for key in was.keys() - held.keys():
                self.maps[name].removeKey((key,))
            for key, value in held.items():
                if was.get(key) != value:
                    self.maps[name].updateValue((key,), value)
        if state["values"] != state["_values"]:
            self.values.put(list(state["values"].items())) if state["values"] else self.values.clear()
        if state["fields"]:
            self.fields.put([tuple(f) for f in state["fields"]])
        elif state["_held"].get("fields"):
            self.fields.clear()
        sizes = {name: len(held) for name, held in now.items()} | {n: len(state[n]) for n in ("fields", "values")} | {"early": state["early"]}
        envelope = dumped(state["envelope"]) if state.get("envelope") else None
        self.core.update(tuple((state | sizes | {"envelope": envelope}).get(n) for n in CORE))

    def _clear(self, state: dict, expired: bool = False) -> None:
        """What was written of the stream goes; one that came and ended at once left nothing, so nothing is asked."""
        held = state["_held"]
        if state["timer"] and not expired:
            self.handle.deleteTimer(state["timer"])
        if held:
            self.core.clear()
        for name, kept in {"fields": self.fields, "values": self.values, **self.maps}.items():
            if held.get(name):
                kept.clear()

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row) for row in rows], columns=["stream_id", "event_no", "out", "unknown", "failure"])

    def _watch(self, state: dict) -> Watch | None:
        return Watch(KeyMatcher.of(self.keys), state["tails"]) if self.keys else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        state, came, latest = self._load(), {}, None
        for frame in rows:
            if self.idle is not None and not pd.isna(at := frame["at"].max()):
                latest = max(latest or 0, int(pd.Timestamp(at).timestamp() * 1000))
            for row in frame.itertuples(index=False):
                if row.entries is not None:
                    state["values"].update(dict(row.entries))
                state["provider"] = row.provider or state.get("provider")
                if row.seq >= state["next"]:
                    came[row.seq] = (row.chunk, bool(row.last))
        out, watch, closed, ready = [], self._watch(state), False, []
        # In order: a chunk that came early waits for the ones before it.
        while not closed:
            at = state["next"]
            if at in came:
                chunk, closed = came.pop(at)
            elif state["early"] and self.maps["early"].containsKey((at,)):
                chunk, closed = self.maps["early"].getValue((at,))
                self.maps["early"].removeKey((at,))
                state["early"] -= 1
            else:
                break
            state["next"] += 1
            if chunk:
                ready.append(chunk)
        if self.most is None and state.get("provider") != "text":
            # Any chunking gives the same events: what is there is read at once.  Limits and plain texts go by chunk.
            ready = ["".join(ready)] if ready else []
        for chunk in ready:
            out += step(state, state["provider"], chunk, state["values"], self.most, watch)
        if closed:
            out += step(state, state["provider"], None, state["values"], self.most, watch)
        if closed:
            self._clear(state)
        else:
            for seq, held in came.items():
                state["early"] += not (state["early"] and self.maps["early"].containsKey((seq,)))
                self.maps["early"].updateValue((seq,), held)
            if state.get("failed"):
                # Nothing more goes out: what is kept only knows that the stream is over.
                state |= {"slots": {}, "kinds": {}, "fields": [], "tails": {}, "values": {}, "partial": "", "raw": "", "envelope": None}
            if latest is not None and latest + self.idle > (state["timer"] or 0):
                if state["timer"]:
                    self.handle.deleteTimer(state["timer"])
                state["timer"] = latest + self.idle
                self.handle.registerTimer(state["timer"])
            self._save(state)
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing came for too long: the stream ends here, and so does its state."""
        state = self._load()
        out = step(state, state.get("provider") or "events", None, state["values"], self.most, self._watch(state))
        self._clear(state, expired=True)
        yield self._rows(key, out)

    def close(self) -> None:
        pass


def relay(
    chunks: DataFrame, most_chars: int | None = None, keys: tuple[str, ...] = (), idle_seconds: float | None = None, late: str = "0 seconds"
) -> DataFrame:
    """`chunks` (stream_id, seq, chunk, last, provider, entries map) to restored events, as a stream or as a batch.

    `seq` counts from 0 per stream; the row with `last` closes it, and its state goes.  `entries` and `provider` are
    needed on the first chunk only.  State is kept per stream, so streams spread over the shuffle partitions; each
    row out is one provider event.  With `most_chars`, a stream of which more characters would have to be held fails.
    `keys` (the configured ones, a short list) are not let out.  With `idle_seconds`, `chunks` also has `at`: a stream
    ends as cut once the watermark (`late` behind the latest row) is that far beyond its last chunk; rows older
    than the watermark are dropped, and newer rows of an ended stream count as a stream of their own.  Rows with a
    null stream_id say nothing, but move the watermark.  Needs the RocksDB state store, which this sets.
    """
    spark = chunks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = idle_seconds is not None
    rows = chunks.withWatermark("at", late) if timed else chunks
    names = ["stream_id", "seq", "chunk", "last", "provider", "entries", *(["at"] if timed else [])]
    processor = Relay(tuple(keys), round(idle_seconds * 1000) if timed else None, most_chars)
    return rows.select(*names).groupBy("stream_id").transformWithStateInPandas(processor, OUTPUT, "append", "EventTime" if timed else "None")


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there now, to a table; exactly once by its checkpoint."""
    _, out = run_and_report(stream, folder)
    return out


def run_and_report(stream: DataFrame, folder: str) -> tuple[list[dict], DataFrame]:
    """The progress reports of the run, and the table."""
    spark: SparkSession = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress], spark.read.schema(stream.schema).parquet(f"{folder}/out")


def counters(events: DataFrame) -> DataFrame:
    """Unknown events and fields that passed, and streams that ended with an error."""
    return events.agg(
        F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown_events"),
        F.count_distinct(F.when(F.col("failure").isNotNull(), F.col("stream_id"))).alias("failed_streams"),
    )
