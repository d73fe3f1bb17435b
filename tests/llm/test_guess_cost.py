"""Values in credential contexts: random ones of any letters are found, plain words of the corpus aren't."""

from __future__ import annotations

import math
import random
import re
import string

from velaria.llm import credentials


def _guessed(text, ranks=None):
    return [text[a:b] for a, b, kind in credentials.find(text, ranks=ranks) if kind == "guess"]


def test_random_values_of_eight_characters():
    rng = random.Random(2)
    signs = string.ascii_letters + string.digits + "#!$%&*"
    assert _guessed("pwd: xK9#fQ2z") == ["xK9#fQ2z"]
    values = ["".join(rng.choice(signs) for _ in range(7)) + rng.choice(string.ascii_letters) for _ in range(300)]
    missed = [v for v in values if not _guessed(f"pwd: {v} ")]
    assert len(missed) <= 3, missed


def test_letters_only():
    rng = random.Random(3)
    value = "".join(rng.choice(string.ascii_letters) for _ in range(40))
    assert _guessed(f"bearer {value} ") == [value]


def test_plain_words_stay():
    for text in ("a token user-provided in time", "the secret agreement: signed", "login credentials required", "the password is different"):
        assert _guessed(text) == [], text


def test_words_of_the_corpus(spark):
    rows = [(i, f"vertraulichkeitserklärung und geheimhaltung {i}") for i in range(6)]
    rows += [(10 + i, "token geheimhaltung, bearer qzxvkwjpyhgmbt") for i in range(6)] + [(20, None), (21, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    words = credentials.ranked_words(docs)
    assert "geheimhaltung" in words and "qzxvkwjpyhgmbt" not in words
    assert len(credentials.ranked_words(docs, most=2)) == 2
    found = {r["doc_id"]: r for r in credentials.scan(docs, clean="clean", words=words).collect()}
    assert found[10]["clean"] == "token geheimhaltung, bearer [SECRET]"
    assert credentials.scan(docs.where("doc_id is null"), words={}).count() == 0


def test_repeats_and_dates():
    cheap = ("k9Xk9Xk9Xk9X", "abcabcabcabc", "x7#Qx7#Qx7#Q", "12/31/2020", "31.12.99", "zqwertyz")
    for value in cheap:
        assert credentials.guess_cost(value) < credentials.LEAST_COST, value
    # A unit longer than any word, with its last copy cut.
    unit = "".join(random.Random(8).choice(string.ascii_letters + string.digits) for _ in range(40))
    one = credentials.guess_cost(unit)
    assert one < credentials.guess_cost(unit * 3 + unit[:7]) < one + 4
    assert credentials.repeats("") == [] and credentials.repeats("aaaaaaaa") == []
    assert credentials.repeats("-ababab-") == [(1, 7, 2)]


def _plain_spans(value, ranks):
    """(start, end) -> least cost of the spans of a value, each place and length looked at by itself."""
    n, low, out = len(value), value.lower(), {}

    def add(a, b, cost):
        out[a, b] = min(cost + 0.3, out.get((a, b), math.inf))

    for a in range(n):
        for b in range(a + 1, n + 1):
            part, small = value[a:b], low[a:b]
            for word, extra in ((small, 0.0), (small.translate(credentials._LEET), 0.3)):
                if 3 <= b - a <= 24 and word in ranks:
                    add(a, b, math.log10(ranks[word] + 1) + extra + (0.3 if part != small else 0.0))
            shapes = (r"(19|20)\d\d#M#D", r"#D#M(19|20)\d\d", r"#M#D(19|20)\d\d", r"#D#M\d\d", r"#M#D\d\d")
            for sep in ("", "-", "/", ".", "_"):
                for shape in shapes:
                    first, *rest = [x for x in re.split(r"(#[MD]|\(19\|20\)\\d\\d|\\d\\d)", shape) if x]
                    rule = re.escape(sep).join([first, *rest])
                    rule = rule.replace("#M", "(0[1-9]|1[0-2])").replace("#D", r"(0[1-9]|[12]\d|3[01])")
                    if re.fullmatch(rule, part):
                        add(a, b, math.log10(366 * 130) + 0.3)
            if re.fullmatch(r"(19|20)\d\d", part):
                add(a, b, math.log10(130))
            for near, each in ((lambda x, y: (x, y) in credentials._NEAR, 0.45), (lambda x, y: abs(ord(x) - ord(y)) == 1, 0.1)):
                if all(near(x, y) for x, y in zip(small, small[1:])):
                    add(a, b, math.log10(47) + each * (b - a - 1))

            def longest(u):
                """The part has period u, and no longer part around it has."""
                is_run = lambda s, e: all(value[i] == value[i + u] for i in range(s, e - u))
                return is_run(a, b) and not (a and is_run(a - 1, b)) and not (b < n and is_run(a, b + 1))

            if b - a >= 3 and longest(1):
                add(a, b, math.log10(36 * (b - a)))
            for u in range(2, (b - a) // 2 + 1):
                whole = any(u % v == 0 and all(part[i] == part[i + v] for i in range(b - a - v)) for v in range(1, u))
                if b - a >= (2 if u >= 4 else 3) * u and not whole and longest(u):
                    add(a, b, _plain_cost(part[:u], ranks) + math.log10(b - a))
    return out


def _plain_cost(value, ranks):
    spans = _plain_spans(value, ranks)
    n = len(value)
    cost = [math.inf] * n + [0.0]
    for a in range(n - 1, -1, -1):
        cost[a] = min([1 + cost[a + 1], *(c + cost[e] for (s, e), c in spans.items() if s == a)])
    return cost[0]


def test_cost_is_that_of_the_cheapest_cut():
    rng = random.Random(12)
    ranks = {"pass": 1, "word": 7, "password": 2, "ana": 30, "banana": 90, "qwe": 12}
    pieces = ["pass", "Word", "p4ss", "ban", "ana", "qwerty", "asd", "123", "abc", "19", "31", "12", "-", "/", "1999", "xx", "x", "zq", "9"]
    for _ in range(250):
        value = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.4:
            value = value[:6] * rng.randint(2, 3) + value[:2]
        assert abs(credentials.guess_cost(value, ranks) - _plain_cost(value, ranks)) < 1e-9, value
