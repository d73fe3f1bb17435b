"""Keys watched for in what a stream gives out: one automaton, and tails of fields between events.

What counts as a piece of a key is said in `operators.secrets`.  All needles (whole keys, runs of ten characters
of a secret part, its ends of four to nine) are searched in one pass by an Aho-Corasick automaton; ends count
only beside a mask.  A field's tail, as long as the longest key less one, is put before its next value, per path
and per field name in any path, so a key cut over values is seen when its last needed part arrives.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import ahocorasick

from velaria.operators.secrets import ELLIPSIS, FRAGMENT, MASK, SHOWN

#: The public prefix of a key; a fixed value, as in `functions.keyfmt.secret_part`.
PUBLIC = re.compile(r"\A(?:sk-ant-(?:[a-z]+[0-9]*-)?|(?!sk-ant-)sk-(?:(?:svcacct|proj|admin|None)-)?)")
LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
WHOLE, TAIL, HEAD = range(3)


class KeyMatcher:
    def __init__(self, keys: tuple[str, ...]):
        self.keep = max(map(len, keys), default=1) - 1
        needles: dict[str, set[int]] = {}
        for key in keys:
            secret = PUBLIC.sub("", key, count=1)
            needles.setdefault(key, set()).add(WHOLE)
            for i in range(len(secret) - FRAGMENT + 1):
                needles.setdefault(secret[i : i + FRAGMENT], set()).add(WHOLE)
            if key.startswith("sk-") and len(secret) >= 2 * SHOWN:
                for width in range(SHOWN, min(FRAGMENT, len(secret) + 1)):
                    needles.setdefault(secret[-width:], set()).add(TAIL)
                    needles.setdefault(secret[:width], set()).add(HEAD)
        self._automaton = ahocorasick.Automaton()
        for needle, kinds in needles.items():
            self._automaton.add_word(needle, (len(needle), kinds))
        if needles:
            self._automaton.make_automaton()
        self._empty = not needles

    @classmethod
    @functools.lru_cache(maxsize=8)
    def of(cls, keys: tuple[str, ...]) -> KeyMatcher:
        """One for each worker and set of keys; empty keys are none."""
        return cls(tuple(k for k in keys if k))

    def found_in(self, text: str) -> bool:
        if self._empty:
            return False
        for last, (size, kinds) in self._automaton.iter(text):
            if WHOLE in kinds:
                return True
            start, end = last - size + 1, last + 1
            if TAIL in kinds and _mask(text[max(start - 2, 0) : start][::-1]) and not (text[end : end + 1].isalnum() or text[end : end + 1] in set("*•")):
                return True
            if HEAD in kinds and _mask(text[end : end + 2]) and not (start and (text[start - 1].isalnum() or text[start - 1] in MASK)):
                return True
        return False


def _mask(beside: str) -> bool:
    """Two signs that stand beside a shown end, the nearest first, are a mask."""
    return beside[:1] == ELLIPSIS or (len(beside) == 2 and beside[0] in MASK and beside[1] in MASK)


def strings(node, path: str = "", name: str = "") -> Iterator[tuple[str, str, str]]:
    """(path, field name, value) of every string.

    An object with an integer `index` is named by it, not by its position, so the same field of the same choice
    or block has one path in every event.
    """
    stack = [(node, path, name)]
    while stack:
        node, path, name = stack.pop()
        if isinstance(node, str):
            yield path, name, node
        elif isinstance(node, dict):
            here = path if index_of(node) is None else f"{path}[{index_of(node)}]"
            stack.extend((value, f"{here}.{key}", key) for key, value in reversed(node.items()))
        elif isinstance(node, list):
            stack.extend((item, path if index_of(item) is not None else f"{path}#{i}", name) for i, item in reversed(list(enumerate(node))))


def index_of(node) -> int | None:
    value = node.get("index") if isinstance(node, dict) else None
    return value if type(value) is int and value >= 0 else None


def layers(text: str) -> Iterator[str]:
    """The text, and what its string literals say, layer by layer, until nothing is new."""
    seen, new = {text}, [text]
    while new:
        now = new.pop()
        yield now
        for match in LITERAL.finditer(now):
            try:
                said = json.loads(f'"{match[1]}"', strict=False)
            except ValueError:
                continue
            # What a literal says is shorter than the text it stands in, so this ends.
            if said not in seen:
                seen.add(said)
                new.append(said)


class Watch:
    """A matcher with the tails of one stream (path or `name:` and field name -> tail)."""

    def __init__(self, matcher: KeyMatcher, tails: dict[str, str]):
        self.matcher, self.tails = matcher, tails

    def received(self, raw: str) -> bool:
        """An event as it came holds a key, in any layer."""
        return any(map(self.matcher.found_in, layers(raw)))

    def given_out(self, event: str, bodies: list[str]) -> bool:
        """An event's text, or a field of its JSON bodies together with what the field said before, holds a key.

        Tails move on only if not.
        """
        if self.matcher.found_in(event):
            return True
        moved: dict[str, str] = {}
        for body in bodies:
            try:
                node = json.loads(body)
            except (ValueError, RecursionError):
                continue
            for path, name, value in strings(node):
                for net in (path, f"name:{name}"):
                    joined = moved.get(net, self.tails.get(net, "")) + value
                    if self.matcher.found_in(joined):
                        return True
                    moved[net] = joined[-self.matcher.keep :] if self.matcher.keep else ""
            if self.received(body):
                return True
        self.tails.update(moved)
        return False
