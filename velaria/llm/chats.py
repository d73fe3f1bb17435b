"""Conversations as token ids with a loss mask, and back again.

Template, one form a turn, each closed by a line break:

    system      [SYS] text [/SYS]
    user        [INST] text [/INST]
    assistant   <s>text</s>
    any other   [ROLE]role[/ROLE]text[END]

A control string inside a text or role gets one backslash after its first character; one that has backslashes
there gets one more.  So no text holds a control string of the template, and reading takes one backslash away.

A conversation is rendered whole and encoded once.  Tokens and turns are both sorted by place, so each assistant
text finds its first and last token by binary search among the tokens' ends; where a token reaches over the
border of the text, the mask says how many of its bytes lie outside.  Places are counted in bytes, since a token
may be part of a character.

Conversations are dealt out by range of (conversation, turn), so that one with a third of all rows is spread
over tasks: it comes as several segments.  Since a line break before a bracket always ends a piece of the
tokenizer, ids of segments one after another are those of the whole.  A null conversation id is a conversation
of its own, null turns come first, turns that tie are ordered by role and text, a null role is an empty one and
a null text is empty; repeated rows are turns of their own.  Texts of any length are taken whole: a task holds one
segment, which ends after `SEGMENT` characters or one text.  An empty table gives no rows.  Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from velaria.llm import common
from velaria.llm.tokens import Encoder

#: Characters after which a segment ends with its turn, and characters encoded at once.
SEGMENT, AT_ONCE = 1 << 19, 1 << 21

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[END]", "<|endoftext|>"]
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ANY = re.compile(r"([<\[])(\\*)(" + _TAILS + ")")
_TURN = re.compile(
    r"\[SYS\] (?P<system>.*?) \[/SYS\]\n|\[INST\] (?P<user>.*?) \[/INST\]\n|<s>(?P<assistant>.*?)</s>\n"
    r"|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)\[END\]\n",
    re.DOTALL,
)


def escaped(text: str) -> str:
    return _ANY.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return _ANY.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def rendered(role: str, text: str) -> tuple[str, str, str]:
    """What stands before a turn's text, the text, and what stands after it."""
    body = escaped(text)
    if role == "system":
        return "[SYS] ", body, " [/SYS]\n"
    if role == "user":
        return "[INST] ", body, " [/INST]\n"
    if role == "assistant":
        return "<s>", body, "</s>\n"
    return f"[ROLE]{escaped(role)}[/ROLE]", body, "[END]\n"


def turns_in(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation; anything else in it is an error."""
    at = 0
    while at < len(text):
        found = _TURN.match(text, at)
        if found is None:
            raise ValueError("not a rendered conversation")
        kind = found.lastgroup
        role = unescaped(found["role"]) if kind == "other" else kind
        yield role, unescaped(found[kind])
        at = found.end()


# ----------------------------------------------------------------------------- tokens


class Vocabulary:
    """The bytes each id stands for."""

    _shared: dict[str, Vocabulary] = {}

    @classmethod
    def get(cls, path: str) -> Vocabulary:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def __init__(self, path: str):
        encoder = Encoder.get(path)
        place = {c: b for b, c in enumerate(encoder.names)}
        vocabulary = encoder.tokenizer.get_vocab(with_added_tokens=True)
        self.of: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            self.of[i] = name.encode() if name in encoder.added else bytes(place[c] for c in name)
        self.size = np.array([len(b) for b in self.of], np.int64)

    def bytes_of(self, ids: list[int]) -> bytes:
        of = self.of
        return b"".join([of[i] for i in ids])


def masks(size: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(first token, token after the last, bytes of the first before the span, bytes of the last after it).

    `size` has the tokens' lengths in bytes, `spans` the byte spans in ascending order; empty ones have no token.
    """
    ends = np.cumsum(size)
    low, high = (np.array([s[i] for s in spans], np.int64) for i in (0, 1))
    first = np.searchsorted(ends, low, side="right")
    last = np.searchsorted(ends, high, side="left")
    out = []
    for a, b, i, j in zip(low.tolist(), high.tolist(), first.tolist(), last.tolist()):
        if b > a:
            out.append((i, j + 1, a - int(ends[i] - size[i]), int(ends[j]) - b))
    return out


OUTPUT = (
    "conv_id long, place struct<part:int, segment:long>, whole boolean, n_turns long, ids array<int>, "
    "loss array<struct<first:int, last:int, lead:int, trail:int>>"
)
_LOSS = pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "lead", "trail")]))
_PLACE = pa.struct([("part", pa.int32()), ("segment", pa.int64())])


class _Segment:
    """Turns of one conversation that are rendered and encoded together."""

    def __init__(self, conv: int | None, begins: bool):
        self.conv, self.begins, self.ends = conv, begins, False
        self.texts: list[str] = []
        self.spans: list[tuple[int, int]] = []
        self.turns = self.chars = self.bytes = 0

    def add(self, role: str, text: str) -> None:
        before, body, after = rendered(role, text)
        start = self.bytes + len(before.encode())
        end = start + len(body.encode())
        if role == "assistant":
            self.spans.append((start, end))
        self.bytes = end + len(after)
        self.texts += [before, body, after]
        self.turns += 1
        self.chars += len(before) + len(body) + len(after)


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[_Segment]:
    now: _Segment | None = None
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if now is not None and (conv != now.conv or now.chars >= most):
                now.ends = conv != now.conv
                yield now
                now = _Segment(conv, now.ends)
            elif now is None:
                now = _Segment(conv, True)
            now.add(role, text)
    if now is not None:
        now.ends = True
        yield now


def format_chats(
    df: DataFrame,
    path: str,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    segment: int = SEGMENT,
) -> DataFrame:
    """Segments of conversations: ids, loss mask, and `whole` where the segment is surely all of its conversation.

    Segments of a conversation follow one another by `place`.
    """
    rows = df.select(
        F.col(f"`{conv}`").cast("long").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    dealt = rows.repartitionByRange("conv", "turn", "role").sortWithinPartitions("conv", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocabulary, part = Encoder.get(path), Vocabulary.get(path), TaskContext.get().partitionId()
        held: list[_Segment] = []
        chars = count = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal count
            texts = pa.array(["".join(s.texts) for s in held], pa.large_string())
            ids, where = encoder.encode(texts, 0)
            out: dict[str, list] = {n: [] for n in ("conv", "place", "whole", "turns", "ids", "loss")}
            for i, s in enumerate(held):
                # The encoder closes each text by an id, which isn't part of the conversation.
                own = ids[where[i] : where[i + 1] - 1]
                # The first and last conversation of a task may go on in its neighbours.
                edge = count == 0 or (last and i == len(held) - 1)
                out["conv"].append(s.conv)
                out["place"].append({"part": part, "segment": count})
                out["whole"].append(s.begins and s.ends and not edge)
                out["turns"].append(s.turns)
                out["ids"].append(own.astype(np.int32))
                out["loss"].append([dict(zip(("first", "last", "lead", "trail"), m)) for m in masks(vocabulary.size[own], s.spans)])
                count += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["conv"], pa.int64()), pa.array(out["place"], _PLACE), pa.array(out["whole"], pa.bool_()),
                    pa.array(out["turns"], pa.int64()), pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["loss"], _LOSS),
                ],
                names=["conv_id", "place", "whole", "n_turns", "ids", "loss"],
            )

        for s in _segments(batches, segment):
            # A full block waits for one more segment, so that the last one of the task is known as such.
            if chars >= AT_ONCE:
                yield from flush(False)
                held.clear()
                chars = 0
            held.append(s)
            chars += s.chars
        if held:
            yield from flush(True)

    return dealt.select("conv", "role", "text").mapInArrow(run, OUTPUT)


# ----------------------------------------------------------------------- reading back


class _Digest:
    """What is told of a conversation, read from ids and masks of its segments in order."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, vocabulary: Vocabulary, ids: list[int], loss: list[dict]) -> None:
        text = vocabulary.bytes_of(ids).decode()
        self.chars += len(text)
        for role, said in turns_in(text):
            self.turns += 1
            self.turn_hash.update(f"{role}\n{said}\n".encode())
        for m in loss:
            raw = vocabulary.bytes_of(ids[m["first"] : m["last"]])
            under = unescaped(raw[m["lead"] : len(raw) - m["trail"]].decode())
            self.loss_chars += len(under)
            self.loss_hash.update(under.encode())

    def row(self, conv: int | None) -> tuple:
        return conv, self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
_DIGEST_NAMES = [c.split()[0] for c in DIGEST.split(", ")]


def _told(rows: list[tuple]) -> list[pa.Array]:
    columns = zip(*rows) if rows else [[] for _ in _DIGEST_TYPES]
    return [pa.array(list(c), t) for c, t in zip(columns, _DIGEST_TYPES)]


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """Per conversation: turns, text under the mask, and length, read from ids and masks alone.

    Segments that are whole conversations are read where they are.  The others meet by conversation, in order; a
    digest is made of one byte after another, so a conversation's ids pass one task, as a stream of segments.
    """

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.get(path)
        for batch in batches:
            rows, left = [], []
            for i, (conv, whole, ids, loss) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "whole", "ids", "loss")))):
                if whole:
                    one = _Digest()
                    one.add(vocabulary, ids, loss)
                    rows.append(one.row(conv))
                else:
                    left.append(i)
            rest = batch.take(pa.array(left, pa.int64()))
            done = _told(rows)
            columns = [pa.concat_arrays([a, pa.nulls(len(left), a.type)]) for a in done]
            for name in ("conv_id", "place", "ids", "loss"):
                column = rest.column(name)
                columns.append(pa.concat_arrays([pa.nulls(len(rows), column.type), column]))
            open_ = pa.array([False] * len(rows) + [True] * len(left))
            yield pa.RecordBatch.from_arrays([*columns, open_], names=[*_DIGEST_NAMES, "conv", "place", "ids", "loss", "open"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.get(path)
        now, conv = None, None
        for batch in batches:
            rows = []
            for other, ids, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or other != conv:
                    if now is not None:
                        rows.append(now.row(conv))
                    now, conv = _Digest(), other
                now.add(vocabulary, ids, loss)
            yield pa.RecordBatch.from_arrays(_told(rows), names=_DIGEST_NAMES)
        if now is not None:
            yield pa.RecordBatch.from_arrays(_told([now.row(conv)]), names=_DIGEST_NAMES)

    rest = "conv long, place struct<part:int, segment:long>, ids array<int>, loss array<struct<first:int, last:int, lead:int, trail:int>>"
    first = common.written(formatted.mapInArrow(here, f"{DIGEST}, {rest}, open boolean"), "chats")
    parts = first.where("open").select("conv", "place", "ids", "loss").repartition("conv").sortWithinPartitions("conv", "place")
    return first.where("not open").select(*_DIGEST_NAMES).unionByName(parts.select("conv", "ids", "loss").mapInArrow(joined, DIGEST))
