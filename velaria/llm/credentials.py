"""Secrets in texts: fixed forms, and values in credential contexts that would cost many guesses.

The guess cost of a value is the least sum, over all ways to cut it in spans, of log10 of the guesses each
span takes: a listed word by its rank, a date, a repeated unit of any length up to `LONGEST_UNIT`, a walk over
the keyboard or a counting run (or part of one), and brute force for single characters.  Dynamic programming over places finds it.  Words are ranked by a short
list of passwords, the tokenizer's vocabulary and, with `ranked_words`, the corpus itself.

Null and empty texts have no spans.  Places are code points, ends exclusive.  Repeated rows get equal
results, an empty table an empty one; input columns named like results give way.
"""

from __future__ import annotations

import collections
import functools
import hashlib
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from velaria.llm import common, tokens

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private)[_-]?key|bearer|credentials?|login|auth)"
    r"[\"']?\x20*(?:[:=]|\x20is\x20|\x20)\x20*[\"']?([^\x00-\x20\"'<>,;]{8,})",
    re.I | re.A,
)
#: Whatever can begin a match of the patterns, in lower case.
HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"bearer", b"credential", b"login", b"auth")
_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = True

#: Words that guessers try first, by rank.
COMMON_WORDS = (
    "password pass admin root user login welcome secret letmein master hello test demo guest default changeme example sample "
    "token key api temp public private service server system access account manager backup database oracle mysql postgres "
    "monkey dragon shadow sunshine princess football baseball batman superman michael jordan summer winter spring autumn "
    "january february march april june july august september october november december monday friday sunday love money "
    "secure security network internet computer laptop windows linux android apple google company office house family happy "
    "the and that this with from your have for not are but was all can her his one our out you day get has him how man new"
).split()
WORD = re.compile(r"[^\W\d_]{3,}")
LONGEST = 24
#: Under the cost of eight random characters, three of which may form a run by chance (7.2).
LEAST_COST = 7.0
_LEET = str.maketrans("4@310$5!7", "aaeiossit")
_DAY, _MONTH = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])"
#: Year first, day first and month first, the latter two with years of two digits as well; read at every place.
_DATES = tuple(
    re.compile(rf"(?=({a}([-/._]?){b}\2{c}))")
    for a, b, c in (
        (r"(?:19|20)\d\d", _MONTH, _DAY), (_DAY, _MONTH, r"(?:19|20)\d\d"), (_MONTH, _DAY, r"(?:19|20)\d\d"),
        (_DAY, _MONTH, r"\d\d"), (_MONTH, _DAY, r"\d\d"),
    )
)
LONGEST_UNIT = 1024
_YEAR = re.compile(r"(?=((?:19|20)\d\d))")
_KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")


def _near_keys() -> set[tuple[str, str]]:
    out = set()
    at = {c: (r, i + r / 2) for r, row in enumerate(_KEYBOARD) for i, c in enumerate(row)}
    for a, (r, x) in at.items():
        for b, (s, y) in at.items():
            if a != b and abs(r - s) <= 1 and abs(x - y) <= 1:
                out.add((a, b))
    return out


_NEAR = _near_keys()
#: Walks over the keyboard and counting runs: whether one character follows another, and what each costs.
_WALKS = ((lambda x, y: (x, y) in _NEAR, 0.45), (lambda x, y: abs(ord(x) - ord(y)) == 1, 0.1))
_WALK_START = math.log10(47)


@functools.cache
def listed_ranks() -> dict[str, int]:
    """Common passwords, then the whole words of the tokenizer's vocabulary in the order of their merges."""
    with open(tokens.tokenizer_path(), encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    ranks: dict[str, int] = {}
    # In byte-level vocabularies this letter stands for a space.
    whole = (w[1:].lower() for w in sorted(vocabulary, key=vocabulary.get) if w.startswith("\u0120"))
    for word in [*COMMON_WORDS, *whole]:
        if word.isascii() and word.isalpha() and 3 <= len(word) <= LONGEST:
            ranks.setdefault(word, len(ranks) + 1)
    return ranks


def ranked_words(df: DataFrame, text: str = "text", most: int = 50_000, least: int = 5) -> dict[str, int]:
    """Ranks of the `most` words that most texts hold, `least` at least; values in credential contexts don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: collections.Counter[str] = collections.Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in common.pieces(batch, 0, common.CHUNK_BYTES):
                texts = pc.fill_null(part.column(0), "")
                suspects = set(_suspects(*common.text_bytes(texts)))
                for row, body in enumerate(texts.to_pylist()):
                    if row in suspects:
                        body = CONTEXT.sub(lambda m: m[0][: m.start(1) - m.start()], body)
                    counts.update(w for w in set(WORD.findall(body.lower())) if len(w) <= LONGEST)
                if len(counts) > 500_000:
                    yield out()
                    counts.clear()
        yield out()

    counted = df.select(F.col(f"`{text}`")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    best = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).select("word").toArrow()
    return {w: i + 1 for i, w in enumerate(best["word"].to_pylist())}


def all_ranks(words: dict[str, int] | None) -> dict[str, int]:
    ranks = dict(listed_ranks())
    for word, rank in (words or {}).items():
        ranks[word] = min(rank, ranks.get(word, rank))
    return ranks


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(start, end, unit length) of the maximal runs of a repeated unit that isn't itself a repetition.

    A unit of two or three characters comes three times at least, a longer one twice; the last one may be cut.
    """
    n = len(value)
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
    out: list[tuple[int, int, int]] = []
    for u in range(2, min(n // 2, LONGEST_UNIT) + 1):
        same = np.concatenate([[False], codes[u:] == codes[:-u], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in edges.reshape(-1, 2).tolist():
            end, least = b + u, 2 * u if u >= 4 else 3 * u
            if end - a < least or len(set(value[a : a + u])) == 1:
                continue
            if not any(u % v == 0 and c <= a and end <= d for c, d, v in out):
                out.append((a, end, u))
    return out


def _spans(value: str, low: str, ranks: dict[str, int]) -> dict[int, list[tuple[int, float]]]:
    """For each end the spans that are cheap to guess, but for walks: (start, log10 of guesses)."""
    n = len(value)
    out: dict[int, list[tuple[int, float]]] = {}

    def add(a: int, b: int, cost: float) -> None:
        out.setdefault(b, []).append((a, cost))

    for variant, extra in ((low, 0.0), (low.translate(_LEET), 0.3)):
        for a in range(n):
            for b in range(a + 3, min(n, a + LONGEST) + 1):
                rank = ranks.get(variant[a:b])
                if rank:
                    cased = 0.0 if value[a:b] == low[a:b] else 0.3
                    add(a, b, math.log10(rank + 1) + extra + cased)
    for pattern in _DATES:
        for m in pattern.finditer(value):
            add(m.start(), m.end(1), math.log10(366 * 130) + 0.3)
    for m in _YEAR.finditer(value):
        add(m.start(), m.end(1), math.log10(130))
    run = 1
    for b in range(1, n + 1):
        if b < n and value[b] == value[b - 1]:
            run += 1
            continue
        if run >= 3:
            add(b - run, b, math.log10(36 * run))
        run = 1
    for a, b, u in repeats(value):
        add(a, b, guess_cost(value[a : a + u], ranks) + math.log10(b - a))
    return out


def guess_cost(value: str, ranks: dict[str, int] | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation takes; a brute-forced character takes ten."""
    ranks = listed_ranks() if ranks is None else ranks
    # A few letters have lower case of two characters.
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    spans = _spans(value, low, ranks)
    best = [0.0] * (len(value) + 1)
    # The cheapest way to be within a walk of each kind; any part of a longest walk is one.
    walks = [math.inf] * len(_WALKS)
    for b in range(1, len(value) + 1):
        least = best[b - 1] + 1.0
        for a, cost in spans.get(b, ()):
            # Which kind of span it is has to be guessed as well.
            least = min(least, best[a] + cost + 0.3)
        for i, (near, each) in enumerate(_WALKS):
            on = walks[i] + each if b > 1 and near(low[b - 2], low[b - 1]) else math.inf
            walks[i] = min(on, best[b - 1] + _WALK_START + 0.3)
            least = min(least, walks[i])
        best[b] = least
    return best[-1]


def find(text: str, least_cost: float = LEAST_COST, ranks: dict[str, int] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start, then kind as listed."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".!?)")
        if len(value) >= 8 and guess_cost(value, ranks) >= least_cost:
            out.append((m.start(1), m.start(1) + len(value), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return [(a, b, KINDS[k]) for a, b, k in out]


def _suspects(raw: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Rows that can hold a secret."""
    rows: set[int] = set()
    runs = common.Words(raw, offsets, _HEX_BYTES)
    long = runs.start[runs.end - runs.start >= 24]
    rows.update((np.searchsorted(offsets, long, "right") - 1).tolist())
    data = raw.tobytes()
    low = data.lower()
    ends = offsets[1:]
    for hint, where in [*((h, low) for h in HINTS), (b"AKIA", data)]:
        at = where.find(hint)
        while at >= 0:
            row = int(np.searchsorted(ends, at, "right"))
            rows.add(row)
            # One find is enough for a row.
            at = where.find(hint, int(ends[row]))
    return sorted(rows)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every maximal stretch of spans replaced."""
    out, at = [], 0
    stretches: list[list[int]] = []
    for a, b, _ in spans:
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], b)
        else:
            stretches.append([a, b])
    for a, b in stretches:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scan(
    df: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    least_cost: float = LEAST_COST,
    clean: str | None = None,
    words: dict[str, int] | None = None,
) -> DataFrame:
    """Rows with counts, digest and spans; `clean` names a further column for the text with secrets replaced
    (null stays null).  `words` are ranks beside the listed ones, such as `ranked_words` gives."""
    nothing = hashlib.sha256(b"").hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(words)

    def make():
        ranks = all_ranks(shared.value)

        def chunk(texts: pa.Array, extras: dict) -> list[pa.Array]:
            n = len(texts)
            counts = np.zeros((3, n), np.int64)
            digests, joined = [nothing] * n, [""] * n
            cleaned: dict[int, str] = {}
            for row in _suspects(*common.text_bytes(texts)):
                body = texts[row].as_py()
                spans = find(body, least_cost, ranks)
                if spans:
                    base = [s for s in spans if s[2] != "guess"]
                    for k in range(3):
                        counts[k, row] = sum(s[2] == KINDS[k] for s in base)
                    digests[row] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    joined[row] = _joined(spans)
                    cleaned[row] = redact(body, spans) if clean else ""
            out = [pa.array(counts[0]), pa.array(counts[1]), pa.array(counts[2]), pa.array(digests), pa.array(joined)]
            if clean:
                bodies = texts.to_pylist()
                for row, body in cleaned.items():
                    bodies[row] = body
                out.append(pa.array(bodies, pa.string(), mask=extras["__is_null"].to_numpy(zero_copy_only=False)))
            return out

        return chunk

    new = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + (f", `{clean}` string" if clean else "")
    return common.map_text(df, text, new, make, keep=keep)
