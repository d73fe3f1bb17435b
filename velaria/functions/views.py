"""Text views: what the detectors, the guards and a name model read, as Column functions."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from velaria.functions import tables

WORD = r"[\p{L}\p{N}_]"
ALNUM = r"[\p{L}\p{N}]"


def detector_view(text: Column) -> Column:
    """Invisible characters dropped; odd widths, odd spaces and look-alikes folded.

    An ASCII text without tabs is its own view: two length counts say so.
    """
    swap = tables.replaced()
    source = "".join(swap) + tables.invisible()
    folded = F.translate(text, source, "".join(swap.values()))
    plain = is_ascii(text) & ~F.contains(text, F.lit("\t"))
    return F.when(plain, text).otherwise(folded)


def fold_look_alikes(text: Column) -> Column:
    pairs = tables.look_alikes()
    return F.translate(text, "".join(pairs), "".join(pairs.values()))


def dropped_positions(text: Column) -> Column:
    """For each character the detector view drops, the view offset where it would have been."""
    chars = F.split(text, "")
    at = F.filter(
        F.transform(
            chars,
            lambda c, i: F.when(
                F.translate(c, tables.invisible(), "") == "", i
            ),
        ),
        lambda i: i.isNotNull(),
    )
    return F.transform(at, lambda i, k: i - k)


def offset_map(text: Column, view: Column) -> Column:
    """`dropped_positions`, or an empty array without any work when nothing was dropped."""
    return F.when(F.length(text) == F.length(view), F.array().cast("array<int>")).otherwise(
        dropped_positions(text)
    )


def original_start(start: Column, shift: Column) -> Column:
    return (start + F.size(F.filter(shift, lambda at: at <= start))).cast("int")


def original_end(end: Column, shift: Column) -> Column:
    return (original_start(end - 1, shift) + 1).cast("int")


class _Folds(dict):
    """What becomes of a character: format characters and accents go; each is asked once in a worker."""

    def __missing__(self, code: int):
        self[code] = None if unicodedata.category(chr(code)) in ("Cf", "Mn") else code
        return self[code]


@cache
def _folds() -> _Folds:
    alike = str.maketrans(tables.look_alikes())
    return _Folds((code, to) for code, to in alike.items() if unicodedata.category(chr(code)) not in ("Cf", "Mn"))


@pandas_udf(StringType())
def _fold_unicode(texts: pd.Series) -> pd.Series:
    # Spark has no Unicode normalisation: rows that are not ASCII go through this one.
    folds = _folds()

    def fold(text):
        if text is None:
            return None
        split = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text))
        folded = unicodedata.normalize("NFC", split.translate(folds).casefold())
        return " ".join(folded.split())

    return texts.map(fold)


# What str.split() takes as blank in ASCII.
_BLANKS = r"[ \t\n\x0B\f\r\x1C-\x1F]+"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def guard_view_ascii(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), _BLANKS, " "))


def guard_view(text: Column) -> Column:
    """Case, width, accents, look-alikes and spacing folded.

    A Python function sees only the rows that need it: the others pass it a null.
    """
    odd = _fold_unicode(F.when(~is_ascii(text), text))
    return F.when(is_ascii(text), guard_view_ascii(text)).otherwise(odd)


def compact(normal: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(normal, r"[^\p{L}\p{N}]", "")


def escape(text: Column) -> Column:
    """`!` after every run of two or more `[`, so a placeholder is never written by chance."""
    return F.regexp_replace(text, r"(\[\[+)", "$1!")


def utf16_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "xx"))


def utf16_offset(text: Column, position: Column) -> Column:
    """The UTF-16 offset of a code-point offset."""
    return utf16_length(F.substring(text, F.lit(1), position))


# --- Fixed values: what a name model should not read -----------------------------------------
BLOB_CHARS = 32
HUGE_RUN_CHARS = 64
GLUED_DIGITS = 6
MODEL_RUN = (
    r"(?:[A-Za-z][A-Za-z0-9+.\-]{0,15}://|www\.)[^\p{Z}\s\x1C-\x1F\x85]+"
    rf"|[A-Za-z0-9+/=_\-]{{{BLOB_CHARS},}}"
)
GLUED = (
    rf"(?<!\p{{Nd}})\p{{Nd}}{{{GLUED_DIGITS},}}+(?=[\p{{L}}\p{{Nl}}\p{{No}}])"
    rf"|(?<=[\p{{L}}\p{{Nl}}\p{{No}}])\p{{Nd}}{{{GLUED_DIGITS},}}"
)


def _rewrite(text: Column, pattern: str, change) -> Column:
    """`text` with every match of `pattern` replaced by `change(match)`."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    joined = F.array_join(
        F.zip_with(
            gaps,
            F.concat(F.transform(found, change), F.array(F.lit(""))),
            lambda gap, new: F.concat(gap, new),
        ),
        "",
    )
    return F.when(F.size(found) == 0, text).otherwise(joined)


def rewrite(text: Column, pattern: str, change) -> Column:
    return _rewrite(text, pattern, change)


def model_view(text: Column) -> Column:
    """Blobs, long addresses and long numbers glued to letters as spaces: offsets stay."""

    def blank(run):
        size = F.length(run)
        url = F.substring(run, 1, 40).contains("://") | run.startswith("www.")
        blob = (size >= HUGE_RUN_CHARS) | F.rlike(run, F.lit(r"[0-9+/=]"))
        return F.when((size >= BLOB_CHARS) & (url | blob), F.repeat(F.lit(" "), size)).otherwise(run)

    runs = _rewrite(text, MODEL_RUN, blank)
    return _rewrite(runs, GLUED, lambda run: F.repeat(F.lit(" "), F.length(run)))


@pandas_udf(StringType())
def fold_key(names: pd.Series) -> pd.Series:
    """A field name without case or width differences (apply it to distinct names)."""
    return names.map(
        lambda name: None if name is None else unicodedata.normalize("NFKC", name).casefold()
    )
