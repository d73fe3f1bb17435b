"""Texts folded for the search of names, with the place each folded character came from.

A character folds to a short string by itself, so a worker asks about each distinct one once; texts are then
expanded by table, and white space and what isn't a letter or digit are dropped by masks.  Places are kept by
the same expansion.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from velaria.functions import tables
from velaria.operators.needles import Codes, alnum, text_pieces

SPACE = 0x20
_slot = np.full(0x110000, -1, np.int32)
_size: list[int] = []
_said: list[int] = []


def folded_char(char: str) -> str:
    """White space as a space; else compatibility form, look-alikes, no accents or invisible signs, case folded."""
    if char.isspace():
        return " "
    apart = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", char))
    alike = tables.look_alikes()
    bare = "".join(alike.get(c, c) for c in apart if unicodedata.category(c) not in ("Mn", "Cf"))
    return unicodedata.normalize("NFC", bare.casefold())


def _slots(codes: np.ndarray) -> np.ndarray:
    slots = _slot[codes]
    if (slots < 0).any():
        for code in np.unique(codes[slots < 0]).tolist():
            said = folded_char(chr(code)) if not 0xD800 <= code < 0xE000 else chr(code)
            _slot[code] = len(_size)
            _size.append(len(said))
            _said.extend(map(ord, said))
        slots = _slot[codes]
    return slots


class Folded:
    """`normal`: folded, runs of spaces as one and none at the start; `compact`: its letters and digits only.

    Beside each: the place in the row's text that every character came from.
    """

    def __init__(self, texts: pa.Array):
        self.source = source = Codes(texts)
        slots = _slots(source.codes)
        size = np.array(_size, np.int64)
        begin, flat = np.cumsum(size) - size, np.array(_said, np.uint32)
        wide = size[slots]
        total = np.concatenate([[0], np.cumsum(wide)])
        out = flat[np.repeat(begin[slots] - total[:-1], wide) + np.arange(total[-1])] if len(slots) else np.zeros(0, np.uint32)
        origin = np.repeat(np.arange(len(slots)) - source.of[:-1][source.rows()], wide)
        of = total[source.of]
        blank = out == SPACE
        after_blank = np.ones(len(out), bool)
        after_blank[1:] = blank[:-1]
        after_blank[of[:-1][of[:-1] < len(out)]] = True
        self.normal, self.normal_from = _kept(out, origin, of, ~(blank & after_blank))
        self.compact, self.compact_from = _kept(self.normal.codes, self.normal_from, self.normal.of, alnum(self.normal.codes))


def _kept(codes: np.ndarray, origin: np.ndarray, of: np.ndarray, keep: np.ndarray) -> tuple[Codes, np.ndarray]:
    before = np.concatenate([[0], np.cumsum(keep)])
    return Codes.of_codes(codes[keep], before[of]), origin[keep]


def folded_views(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, normal, normal_from, compact, compact_from; null texts are empty."""
    schema = df.select(*keys).schema.add("normal", "string").add("compact", "string")
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["normal_from array<int>", "compact_from array<int>"])
    names = [*keys, "normal", "compact", "normal_from", "compact_from"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_pieces(batch, len(keys)):
                views = Folded(part.column(len(keys)))
                lists = [
                    pa.ListArray.from_arrays(pa.array(c.of.astype(np.int32)), pa.array(o.astype(np.int32)))
                    for c, o in ((views.normal, views.normal_from), (views.compact, views.compact_from))
                ]
                texts = [pa.array(c.texts(), pa.string()) for c in (views.normal, views.compact)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *texts, *lists], names=names)

    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, ddl)
