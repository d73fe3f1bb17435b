"""JSON request and answer bodies: flattened to leaves, checked by path, masked and restored.

A body becomes a table of leaves in a stable order; every check, the masking and the restoring
are table operators over it.  Python only walks a parsed body, one row at a time, to flatten it
and to put changed strings back in their place.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from velaria.operators import guard, masking, needles as search
from velaria.operators.detect import scan
from velaria.operators.restoring import restore_scopes
from velaria.session import materialize

# --- Fixed values: names and types the rules speak of -----------------------------------------
ATTACHMENT_KEYS = (
    "source", "data", "image", "document", "image_url", "input_audio", "file", "file_id",
    "file_data", "audio",
)
READ_KEYS = ATTACHMENT_KEYS + (
    "arguments", "cache_control", "content", "function", "function_call", "functions", "input",
    "input_schema", "messages", "model", "refusal", "response_format", "role", "signature",
    "stream", "system", "text", "thinking", "tool_calls", "tool_choice", "tools", "type",
)
MAX_DEPTH = 100
DATA_URL = r"(?iu)data:[^,\s]{0,100};base64,"
OPENAI_TYPES = ("text", "refusal", "function")
OPENAI_SCHEMAS = ("tools", "functions", "response_format", "tool_choice")
THINKING_TYPES = ("thinking", "redacted_thinking")
CONTENT_TYPES = ("text", "tool_use", "tool_result") + THINKING_TYPES
STREAM_OPTIONS = ("include_usage", "include_obfuscation")

LEAF_FIELDS = (
    "ord int, kind string, path array<string>, owners array<string>, value string, nested boolean"
)
LEAF_TYPES = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.bool_())
LEAF_CHARS = 1 << 17


def _fold(name: str) -> str:
    return unicodedata.normalize("NFKC", name).casefold()


def _object(members):
    """An object's members, if no name is there twice; for names the rules read, in any case or width."""
    made = dict(members)
    read = [name for name in map(_fold, made) if name in READ_KEYS]
    if len(made) < len(members) or len(set(read)) < len(read):
        raise ValueError("repeated name")
    return made


def _no_constant(name):
    raise ValueError(f"{name} is not JSON")


def _strict(text: str):
    return json.loads(text, object_pairs_hook=_object, parse_constant=_no_constant)


def _depth(node) -> int:
    level, depth = [node], 0
    while level:
        level = [n for n in level if isinstance(n, (dict, list))]
        if level:
            depth += 1
        level = [c for n in level for c in (n.values() if isinstance(n, dict) else n)]
    return depth


def _written_in(text: str):
    """The object or array that a string spells out; none if it is deeper than MAX_DEPTH."""
    if not text.lstrip().startswith(("{", "[")):
        return None
    try:
        node = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return node if _depth(node) <= MAX_DEPTH else None


class _Walk:
    """Visits a body in order; `see(kind, path, owners, value, nested)` returns a leaf's new value."""

    def __init__(self, see, json_names=()):
        self.see, self.json_names = see, json_names

    def __call__(self, node, path=(), owners=(), nested=False):
        if isinstance(node, dict):
            kind = node.get("type")
            owner = kind if isinstance(kind, str) else None
            self.see("object", path, owners, owner, nested)
            return {n: self._member(n, v, path, owners + (owner,), nested) for n, v in node.items()}
        if isinstance(node, list):
            return [
                self(item, path + (f"#{i}",), owners + (None,), nested) for i, item in enumerate(node)
            ]
        if isinstance(node, bool) or node is None:
            self.see("constant", path, owners, json.dumps(node), nested)
            return node
        if isinstance(node, str):
            return self.see("text", path, owners, node, nested)
        self.see("number", path, owners, str(node), nested)
        return node

    def _member(self, name, value, path, owners, nested):
        here = path + (name,)
        self.see("key", here, owners, name, nested)
        if not nested and name in self.json_names and isinstance(value, str):
            inner = _written_in(value)
            if inner is not None:
                return json.dumps(self(inner, here, owners, True), ensure_ascii=False)
        return self(value, here, owners, nested)


def leaves(bodies: DataFrame, scope="scope_id", body="body", json_names=("arguments",)) -> DataFrame:
    """scope, ord, kind, path, owners, value, nested: one row per key, string, number, constant
    and object, in walk order.

    `owners` aligns with `path`: the `type` of the object that holds each step.  A string under a
    name of `json_names` that holds an object or array is walked too, once.  A body that is not a
    valid object gives one row of kind `invalid`; a deeper one than MAX_DEPTH one of `too_deep`.
    """

    def walked(text: str | None) -> list[tuple]:
        found = []

        def see(kind, path, owners, value, nested):
            found.append((kind, path, owners, value, nested))
            return value

        try:
            node = _strict(text)
            if "\\" in text:
                # An escape can spell half a character.
                json.dumps(node, ensure_ascii=False).encode("utf-8")
            if not isinstance(node, dict):
                raise ValueError("not an object")
            if _depth(node) > MAX_DEPTH:
                return [("too_deep", (), (), None, False)]
            _Walk(see, json_names)(node)
        except (ValueError, RecursionError, TypeError, AttributeError):
            return [("invalid", (), (), None, False)]
        return found

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Some bodies at a time: their leaves, as Python objects, are many times their size.
        for batch in batches:
            for part in search.text_pieces(batch, 1, LEAF_CHARS):
                found = [walked(text) for text in part.column(1).to_pylist()]
                sizes = np.array([len(f) for f in found])
                columns = list(zip(*(leaf for f in found for leaf in f)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes))),
                        pa.array(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), pa.int32()),
                        *[pa.array(c, t) for c, t in zip(columns, LEAF_TYPES)],
                    ],
                    names=[scope, "ord", "kind", "path", "owners", "value", "nested"],
                )

    kind = bodies.schema[scope].dataType.simpleString()
    return bodies.select(scope, body).mapInArrow(flatten, f"`{scope}` {kind}, {LEAF_FIELDS}")


def _rebuild(json_names):
    @pandas_udf(StringType())
    def put_back(texts: pd.Series, changes: pd.Series) -> pd.Series:
        def one(text, listed):
            if text is None or listed is None or len(listed) == 0:
                return text
            new = {c["ord"]: c["value"] for c in listed}
            at = iter(range(2**31))

            def see(kind, path, owners, value, nested):
                place = next(at)
                return new.get(place, value) if kind == "text" else value

            return json.dumps(_Walk(see, json_names)(json.loads(text)), ensure_ascii=False)

        return pd.Series([one(t, c) for t, c in zip(texts, changes)])

    return put_back


def put_back(bodies: DataFrame, changed: DataFrame, scope="scope_id", body="body", json_names=("arguments",)):
    """`bodies` with the strings of `changed(scope, ord, value)` in their place.

    Bodies nothing changes in keep their text and are not parsed again.
    """
    listed = changed.groupBy(scope).agg(F.collect_list(F.struct("ord", "value")).alias("_changes"))
    return (
        bodies.join(listed, scope, "left")
        .withColumn(body, _rebuild(json_names)(F.col(body), F.col("_changes")))
        .drop("_changes")
    )


# --- Checks by path: each gives the blocked scopes --------------------------------------------


def _at(path: Column, i: int) -> Column:
    return F.try_element_at(path, F.lit(i))


def _last(path: Column) -> Column:
    return F.try_element_at(path, F.lit(-1))


def _folded_names(leaf: DataFrame) -> Column:
    """Names folded natively: the attachment names are ASCII, so full-width forms map by table."""
    wide = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F))
    return F.lower(F.translate(leaf["value"], wide, "".join(map(chr, range(0x21, 0x7F)))))


def _is_attachment(leaf: DataFrame) -> Column:
    return (F.col("kind") == "key") & _folded_names(leaf).isin(list(ATTACHMENT_KEYS))


def _bad_type(allowed) -> Column:
    """A `type` that is not one of `allowed` (null counts as no type)."""
    named = _last(F.col("path")) == "type"
    value = named & F.col("kind").isin("text", "number", "constant")
    listed = named & (F.col("kind") == "object")
    return (value & ~((F.col("kind") == "text") & F.col("value").isin(list(allowed))) & ~(
        (F.col("kind") == "constant") & (F.col("value") == "null")
    )) | listed


def _blocked(found: DataFrame, scope: str, reason: str) -> DataFrame:
    return found.select(scope, F.lit(reason).alias("reason")).distinct()


def attachments(leaf: DataFrame, scope="scope_id", allowed=None) -> DataFrame:
    """Any attachment name, or any typed object outside the allowlist (None: names only)."""
    own = leaf.filter("not nested")
    bad = _is_attachment(own) if allowed is None else _is_attachment(own) | _bad_type(allowed)
    return _blocked(own.filter(bad), scope, "attachment")


def openai_rules(leaf: DataFrame, scope="scope_id") -> DataFrame:
    own = leaf.filter("not nested")
    top = F.size("path") == 1
    schema = _at(F.col("path"), 1).isin(list(OPENAI_SCHEMAS))
    inside = ~schema & ~top
    bad = (_is_attachment(own) & (top | ~schema)) | (inside & _bad_type(OPENAI_TYPES))
    return _blocked(own.filter(bad), scope, "attachment")


def anthropic_rules(leaf: DataFrame, scope="scope_id") -> DataFrame:
    """Allowlists by place: settings, tools, system, message blocks, everything else."""
    own = leaf.filter("not nested")
    path, size = F.col("path"), F.size("path")
    first = _at(path, 1)
    in_list = F.coalesce(_at(path, 2).startswith("#"), F.lit(False))
    attachment = _is_attachment(own)
    settings = (first == "thinking") | (first == "tool_choice")
    allowed_settings = F.when(first == "thinking", F.array(F.lit("type"), F.lit("budget_tokens"))).otherwise(
        F.array(F.lit("type"), F.lit("name"), F.lit("disable_parallel_tool_use"))
    )
    bad_setting = settings & (F.col("kind") == "key") & (size == 2) & ~F.array_contains(
        allowed_settings, _at(path, 2)
    )
    tools = first == "tools"
    schema = tools & in_list & (_at(path, 3) == "input_schema")
    bad_schema = schema & (_last(path) == "type") & (F.col("kind") == "text") & (F.col("value") == "base64")
    in_schema_body = schema & (size > 3)

    # A block: system/#i or messages/#i/content/#j, and text blocks inside a tool result.
    message = (first == "messages") & in_list
    content = message & (_at(path, 3) == "content")
    block = content & F.coalesce(_at(path, 4).startswith("#"), F.lit(False))
    kind = F.try_element_at("owners", F.lit(5))
    result_item = (
        block & (kind == "tool_result") & (_at(path, 5) == "content")
        & F.coalesce(_at(path, 6).startswith("#"), F.lit(False))
    )
    system = (first == "system") & in_list
    is_object = F.col("kind") == "object"
    bad_block = is_object & (
        (block & (size == 4) & ~F.coalesce(F.col("value").isin(list(CONTENT_TYPES)), F.lit(False)))
        | (((system & (size == 2)) | (result_item & (size == 6))) & ~F.coalesce(F.col("value") == "text", F.lit(False)))
    )
    thinking = block & kind.isin(list(THINKING_TYPES))
    thinking_names = F.when(kind == "thinking", F.array(F.lit("type"), F.lit("thinking"), F.lit("signature"))).otherwise(
        F.array(F.lit("type"), F.lit("data"))
    )
    bad_thinking = thinking & (
        ((F.col("kind") == "key") & ~F.array_contains(thinking_names, _at(path, 5)))
        | (~F.col("kind").isin("key", "text") & (size > 4))
    )
    cache = block & (_at(path, 5) == "cache_control") & ~result_item & (size > 5)
    cache_system = system & (_at(path, 3) == "cache_control") & (size > 3)
    cache_item = result_item & (_at(path, 7) == "cache_control") & (size > 7)
    tool_input = block & (kind == "tool_use") & (_at(path, 5) == "input") & (size > 5)
    free_of_types = thinking | cache | cache_system | cache_item | tool_input | settings | tools
    own_type = (
        (block & (size == 5)) | (system & (size == 3)) | (result_item & (size == 7)) | (size == 1)
    )
    bad_name = attachment & ~in_schema_body & ~thinking & ~cache & ~cache_system & ~cache_item
    bad_type = ~F.coalesce(free_of_types, F.lit(False)) & ~F.coalesce(own_type, F.lit(False)) & _bad_type(())
    checks = [bad_setting, bad_schema, bad_block, bad_thinking, bad_name, bad_type]
    bad = F.coalesce(checks[0], F.lit(False))
    for check in checks[1:]:
        bad = bad | F.coalesce(check, F.lit(False))
    return _blocked(own.filter(bad), scope, "attachment")


def too_deep(leaf: DataFrame, scope="scope_id") -> DataFrame:
    return _blocked(leaf.filter("kind = 'too_deep'"), scope, "too_deep")


def invalid(leaf: DataFrame, scope="scope_id") -> DataFrame:
    return _blocked(leaf.filter("kind = 'invalid'"), scope, "invalid")


def data_urls(leaf: DataFrame, scope="scope_id") -> DataFrame:
    return _blocked(leaf.filter(F.rlike("value", F.lit(DATA_URL)) & F.col("kind").isin("text", "key")), scope, "attachment")


def thinking_leaves(leaf: DataFrame) -> Column:
    """The leaf belongs to a reasoning block of a message: it is copied, never masked."""
    path = F.col("path")
    return F.coalesce(
        (_at(path, 1) == "messages")
        & (_at(path, 3) == "content")
        & F.try_element_at("owners", F.lit(5)).isin(list(THINKING_TYPES)),
        F.lit(False),
    )


# --- Masking and restoring --------------------------------------------------------------------


def mask_bodies(
    bodies: DataFrame,
    scope: str = "scope_id",
    body: str = "body",
    provider: str | None = None,
    json_names=("arguments",),
    policy=None,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    max_names: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(masked bodies, vault, blocked): every string of a body in one numbering.

    With `scorer`, a model's names are hidden too, wherever they stand in the scope: it gets the texts (scope,
    text_ord, text) and gives (scope, text_ord, start, end, type).  Where its ranges are ill formed, or names are
    more than `max_names`, the scope is blocked.

    A key or number that would change, a reasoning block that holds a value, an attachment, a
    body too deep or a value left in the result blocks the scope, with the first reason in order.
    """
    leaf = materialize(leaves(bodies, scope, body, json_names))
    rules = {"openai": openai_rules, "anthropic": anthropic_rules}.get(provider, attachments)
    held = thinking_leaves(leaf) if provider == "anthropic" else F.lit(False)
    texts = leaf.filter(F.col("kind").isin("text", "key", "number")).select(
        scope, F.col("ord").alias("text_ord"), F.col("value").alias("text"), "kind", held.alias("held")
    )
    scanned = materialize(scan(texts))
    failed = None
    if scorer is not None:
        scored = scorer(scanned.select(scope, "text_ord", "text"))
        scanned, failed = masking.with_names(scanned, scored, scope, "text", policy, max_names)
    free = scanned.filter("not held")
    reserved = None
    if provider == "anthropic":
        from velaria.operators.restoring import tokens_in

        reserved = scanned.filter("held and kind = 'text'").select(
            scope, F.explode_outer(tokens_in(F.col("text"))).alias("token")
        ).filter("token is not null").distinct()
    masked, vault = masking.mask_scopes(free, scope, "text", policy, reserved)
    masked = materialize(masked)
    hides = F.exists("found", lambda f: f["hidden"])
    kinds = free.select(scope, "text_ord", "kind", "text")
    changed = masked.join(kinds, [scope, "text_ord"]).filter(F.col("masked_text") != F.col("text"))
    stuck = changed.filter("kind <> 'text'")
    from velaria.operators.policy import hides as hidden_type

    thinking_values = scanned.filter("held").filter(
        F.exists("spans", lambda s: hidden_type(s["type"], policy))
    )
    unmaskable = _blocked(stuck.unionByName(thinking_values, allowMissingColumns=True), scope, "unmaskable_field")
    changes = changed.filter("kind = 'text'").select(
        scope, F.col("text_ord").alias("ord"), F.col("masked_text").alias("value")
    )
    outgoing = masked.select(scope, "text_ord", F.col("masked_text").alias("text")).unionByName(
        scanned.filter("held").select(scope, "text_ord", "text")
    )
    leaking = guard.leaking_scopes(outgoing, vault, scope).withColumn("reason", F.lit("egress_guard"))
    reasons = (
        invalid(leaf, scope)
        .unionByName(too_deep(leaf, scope))
        .unionByName(rules(leaf, scope))
        .unionByName(data_urls(leaf, scope))
        .unionByName(unmaskable)
        .unionByName(leaking)
    )
    blocked = first_reason(reasons if failed is None else reasons.unionByName(failed.select(scope, "reason")), scope)
    out = put_back(bodies, changes, scope, body, json_names)
    return out.join(blocked.select(scope), scope, "left_anti"), vault, blocked


# --- Fixed value: the order the checks are made in --------------------------------------------
REASON_ORDER = ("invalid", "too_deep", "attachment", "detector_failed", "unmaskable_field", "egress_guard")


def first_reason(reasons: DataFrame, scope="scope_id") -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, REASON_ORDER)), F.col("reason"))
    return reasons.groupBy(scope).agg(F.min_by("reason", rank).alias("reason"))


def _restorable(provider: str) -> Column:
    path, owners = F.col("path"), F.col("owners")
    if provider == "openai":
        message = (_at(path, 1) == "choices") & (_at(path, 3) == "message")
        text = (F.size(path) == 4) & _at(path, 4).isin("content", "refusal")
        call = (_at(path, 4) == "tool_calls") & (_at(path, 6) == "function") & (_at(path, 7) == "arguments")
        legacy = (_at(path, 4) == "function_call") & (_at(path, 5) == "arguments")
        return F.coalesce(message & (text | call | legacy), F.lit(False))
    block = (_at(path, 1) == "content") & F.coalesce(_at(path, 2).startswith("#"), F.lit(False))
    kind = F.try_element_at(owners, F.lit(3))
    text = (kind == "text") & (_at(path, 3) == "text") & (F.size(path) == 3)
    tool = (kind == "tool_use") & (_at(path, 3) == "input") & (F.size(path) > 3)
    return F.coalesce(block & (text | tool), F.lit(False))


def restore_bodies(answers: DataFrame, vault: DataFrame, provider: str, scope="scope_id", body="body") -> DataFrame:
    """Answers with this scope's placeholders restored in the fields a client reads as text.

    OpenAI answers: message content, refusal and tool-call arguments; Anthropic ones: text blocks
    and tool inputs.  Everything else passes as it came.
    """
    names = ("arguments",) if provider == "openai" else ()
    leaf = materialize(leaves(answers, scope, body, names))
    texts = leaf.filter("kind = 'text'").filter(_restorable(provider)).select(
        scope, F.col("ord").alias("text_ord"), F.col("value").alias("text")
    )
    restored = restore_scopes(texts, vault, scope)
    changed = restored.filter(F.col("restored") != F.col("text")).select(
        scope, F.col("text_ord").alias("ord"), F.col("restored").alias("value")
    )
    return put_back(answers, changed, scope, body, names)


def stream_options_verdict(bodies: DataFrame, body="body") -> DataFrame:
    """`bodies` plus `options_ok`: stream is a boolean or absent, and its options are known booleans."""
    parsed = F.try_parse_json(F.col(body))
    stream = F.try_variant_get(parsed, "$.stream", "variant")
    kind = F.schema_of_variant(stream)
    ok_stream = stream.isNull() | kind.isin("BOOLEAN")
    options = F.try_variant_get(parsed, "$.stream_options", "map<string,variant>")
    raw = F.try_variant_get(parsed, "$.stream_options", "variant")
    ok_options = F.when(raw.isNull() | (F.schema_of_variant(raw) == "VOID"), True).otherwise(
        options.isNotNull()
        & F.forall(F.map_keys(options), lambda k: k.isin(list(STREAM_OPTIONS)))
        & F.forall(F.map_values(options), lambda v: F.schema_of_variant(v) == "BOOLEAN")
    )
    return bodies.withColumn("options_ok", F.coalesce(ok_stream & ok_options, F.lit(False)))
