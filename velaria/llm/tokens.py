"""Token ids of whole texts by a public byte-level BPE tokenizer, with each distinct piece encoded once.

The tokenizer cuts a text into pieces (runs of letters, digits, signs or white space, each with at most
one space before it) and encodes each piece by itself.  Here numpy cuts the pieces by the same rule, and
the library's model encodes those a worker has not met yet; ids of a text are then looked up.  Texts are
cut at the contents of added tokens first, as the library does.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from velaria.llm.common import span_hashes, text_bytes

MOST_CACHED = 600_000
LETTER, NUMBER, SPACE, SIGN = 0, 1, 2, 3
#: White space as Unicode defines it; fixed values.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """For every code point whether it is a letter, a number, white space or another sign."""
    global _kinds
    if _kinds is None:
        out = np.full(sys.maxunicode + 1, SIGN, np.uint8)
        for point in range(sys.maxunicode + 1):
            major = unicodedata.category(chr(point))[0]
            if major in "LN":
                out[point] = LETTER if major == "L" else NUMBER
        out[WHITE] = SPACE
        _kinds = out
    return _kinds


_ascii_kinds: np.ndarray | None = None


def char_starts(raw: np.ndarray) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """Byte places of characters (None: every byte is one), their kinds, and their code points (ASCII exact)."""
    global _ascii_kinds
    if _ascii_kinds is None:
        _ascii_kinds = np.array([_small_kind(p) for p in range(128)] + [LETTER] * 128, np.uint8)
    if not len(raw) or raw.max() < 0x80:
        return None, _ascii_kinds[raw], raw
    begin = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[begin]
    kind = _ascii_kinds[lead]
    wide = np.flatnonzero(lead >= 0x80)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind[wide] = kinds()[points[wide]]
    return begin, kind, lead


def _small_kind(point: int) -> int:
    major = unicodedata.category(chr(point))[0]
    return SPACE if point in WHITE else LETTER if major == "L" else NUMBER if major == "N" else SIGN


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places at which the pieces of all rows begin, ascending."""
    n_bytes = len(raw)
    if not n_bytes:
        return np.zeros(0, np.int64)
    begin, kind, lead = char_starts(raw)
    n = len(kind)
    row_start = np.zeros(n + 1, bool)
    edges = offsets[(offsets < n_bytes)]
    row_start[edges if begin is None else np.searchsorted(begin, edges)] = True
    row_start[n] = True

    change = row_start[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    starts = change.copy()
    white = kind == SPACE
    # The last white character before something else: a space joins what follows, another stands alone.
    last = white.copy()
    last[:-1] &= ~white[1:] & ~row_start[1:n]
    last[-1] = False
    places = np.flatnonzero(last)
    starts[places] = True
    joined = places[lead[places] == 0x20]
    starts[joined + 1] = False
    # An apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it.
    quote = np.flatnonzero((lead == 0x27) & starts[:n])
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~row_start[quote + 1]]
    if len(quote):
        one = lead[quote + 1]
        two = lead[np.minimum(quote + 2, n - 1)]
        has_two = (quote + 2 < n) & ~row_start[np.minimum(quote + 2, n)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = has_two & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        took = quote[short | long]
        after = took + np.where(short, 2, 3)[short | long]
        starts[took + 1] = False
        inside = after[after < n]
        starts[inside] |= kind[inside] == LETTER
    places = np.flatnonzero(starts)
    return places if begin is None else begin[places]


def _byte_names() -> str:
    """The character that stands for each byte in byte-level vocabularies, by the published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(spare)) for b in range(256))


class Encoder:
    """Encodes chunks of texts; one for each Python worker."""

    _shared: dict[str, Encoder] = {}

    @classmethod
    def get(cls, path: str) -> Encoder:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.names = _byte_names()
        added = json.loads(self.tokenizer.to_str())["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that look at what stands around them are not built")
        self.added = {t["content"]: t["id"] for t in added}
        # Of contents that begin at one place the longest counts.
        self.added_at = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, each row closed by `end_id`; where each row begins."""
        parts, closing, of = self._parts(texts, end_id)
        ids, where = self._encode_parts(parts, closing)
        return ids, where if of is None else where[of]

    def _parts(self, texts: pa.Array, end_id: int) -> tuple[pa.Array, np.ndarray | int, np.ndarray | None]:
        """Texts without added tokens, the id after each, and where each row's begin (None: every row is one)."""
        holds = np.zeros(len(texts), bool)
        for content in self.added:
            holds |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if not holds.any():
            return texts, end_id, None
        parts, closing, count, at = [], [], np.ones(len(texts), np.int64), 0
        for row in np.flatnonzero(holds).tolist():
            cut = self.added_at.split(texts[row].as_py())
            parts += [texts.slice(at, row - at), pa.array(cut[::2], texts.type)]
            closing += [np.full(row - at, end_id), [self.added[c] for c in cut[1::2]], [end_id]]
            count[row], at = len(cut[::2]), row + 1
        parts.append(texts.slice(at))
        closing.append(np.full(len(texts) - at, end_id))
        return pa.concat_arrays(parts), np.concatenate(closing).astype(np.uint32), np.concatenate([[0], np.cumsum(count)])

    def _encode_parts(self, texts: pa.Array, closing: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = text_bytes(texts)
        begin = piece_starts(raw, offsets)
        lengths = np.diff(np.append(begin, len(raw)))
        hashes = span_hashes(raw, lengths)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        size, place = self._look_up(raw, begin, lengths, distinct, first)
        of = np.searchsorted(begin, offsets)
        per_piece = size[back]
        total = np.concatenate([[0], np.cumsum(per_piece)])
        rows = len(texts)
        where = total[of] + np.arange(rows + 1)
        out = np.empty(total[-1] + rows, np.uint32)
        row = np.repeat(np.arange(rows), np.diff(of))
        target = total[:-1] + row
        for k in range(int(per_piece.max(initial=0))):
            more = np.flatnonzero(per_piece > k) if k else slice(None)
            out[target[more] + k] = self.ids[place[back[more]] + k]
        out[where[1:] - 1] = closing
        return out, where

    def _look_up(self, raw, begin, lengths, distinct, first) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.known, distinct)
        at[at == len(self.known)] = 0
        new = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            if len(self.known) + len(new) > MOST_CACHED:
                self._clear()
                new = np.arange(len(distinct))
            tokenize, named = self.model.tokenize, self.names
            table = {i: c for i, c in enumerate(named)}
            data = raw.tobytes()
            found: list[int] = []
            sizes = np.empty(len(new), np.int64)
            for k, (a, n) in enumerate(zip(begin[first[new]].tolist(), lengths[first[new]].tolist())):
                tokens = tokenize(data[a : a + n].decode("latin-1").translate(table))
                found.extend([t.id for t in tokens])
                sizes[k] = len(tokens)
            place = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, np.array(found, np.uint32)])
            slot = np.searchsorted(self.known, distinct[new])
            self.known = np.insert(self.known, slot, distinct[new])
            self.place = np.insert(self.place, slot, place)
            self.size = np.insert(self.size, slot, sizes)
            at = np.searchsorted(self.known, distinct)
        return self.size[at], self.place[at]
