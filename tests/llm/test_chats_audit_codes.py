"""Chat masks, filter interactions and vector codes against plain versions, with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from velaria.llm import chats, interactions, tokens, veccodes

# ------------------------------------------------------------------------------ chats

CHAT = "conv_id long, turn long, role string, text string, ids string, whole int"
PIECES = [*chats.CONTROL, "\\", "<\\s>", "[\\\\/INST]", "<", "[", "]", "\n", " ", "a", "été", "日本", "🙂", "ok.", "?!", "\t", "<|endof"]


def _chats():
    rng = random.Random(11)
    make = lambda: "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows += [(1, 0, None, None), (1, 0, None, None), (1, None, "assistant", ""), (1, 2, "tool[", "x"), (None, 3, "assistant", "alone")]
    rows += [(2, t, rng.choice(["user", "assistant", "system", "to<s>ol", ""]), make()) for t in range(700)]
    rows += [(c, t, rng.choice(["user", "assistant"]), make()) for c in range(3, 40) for t in range(rng.randint(1, 6))]
    rows.append((50, 0, "assistant", "long 🙂 text " * 60_000))
    return [(*r, "x", 1) for r in rows]


def test_escapes_are_reversible():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9)))
        marked = chats.escaped(text)
        assert chats.unescaped(marked) == text
        assert not any(c in marked for c in chats.CONTROL)


@pytest.mark.parametrize("segment", [chats.SEGMENT, 40])
def test_chats_read_back(spark, segment):
    rows = _chats()
    path = tokens.tokenizer_path()
    df = spark.createDataFrame(rows, CHAT).repartition(5)
    got = {r["conv_id"]: r for r in chats.read_back(chats.format_chats(df, path, segment=segment), path).collect()}
    groups = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == groups.keys()
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(t for *_, role, t in turns if role == "assistant")
        whole = "".join("".join(chats.rendered(role, t)) for *_, role, t in turns)
        told = hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in turns).encode()).hexdigest()
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["formatted_chars"]) == (len(turns), told, len(whole))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_segments_have_the_ids_of_the_whole(spark):
    path = tokens.tokenizer_path()
    rows = [r for r in _chats() if r[0] == 2]
    df = spark.createDataFrame(rows, CHAT).repartition(3)
    parts = chats.format_chats(df, path, segment=100).orderBy("place").collect()
    assert len(parts) > 20 and not any(p["whole"] for p in parts)
    whole = "".join("".join(chats.rendered(r or "", t or "")) for _, _, r, t, *_ in sorted(rows, key=lambda r: r[1]))
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path).encode(whole, add_special_tokens=False)
    assert [i for p in parts for i in p["ids"]] == plain.ids


def test_masks_follow_the_offsets_of_the_library():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    plain, vocabulary = Tokenizer.from_file(path), chats.Vocabulary.get(path)
    text = "<s>...</s>\n<s>éa b\n</s>\n"
    spans = [(3, 6), (14, 14 + len("éa b\n".encode()))]
    code = plain.encode(text, add_special_tokens=False)
    found = chats.masks(vocabulary.size[np.array(code.ids)], spans)
    for (first, last, lead, trail), said in zip(found, ["...", "éa b\n"]):
        touched = [i for i, (a, b) in enumerate(code.offsets) if text[a:b] and a < text.index(said) + len(said) and b > text.index(said)]
        assert (first, last - 1) == (touched[0], touched[-1])
        raw = vocabulary.bytes_of(code.ids[first:last])
        assert raw[lead : len(raw) - trail].decode() == said


def test_chats_of_nothing(spark):
    path = tokens.tokenizer_path()
    assert chats.read_back(chats.format_chats(spark.createDataFrame([], CHAT), path), path).count() == 0
    with pytest.raises(ValueError):
        list(chats.turns_in("[INST] never closed"))


# ----------------------------------------------------------------------- interactions

DOCS = "doc_id long, text string, source string, A int, mask string"


def _plain_audit(docs, labels, size=5):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, *_ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    fails = collections.defaultdict(list)
    for d, text, source, *_ in docs:
        t = text or ""
        w = word.findall(t)
        out = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and least[t] < d,
        }
        fails[source or ""].append(({c for c, x in out.items() if x}, d in good, d in toxic))
    rows = set()
    for part, all_ in fails.items():
        removed = collections.Counter()
        kept_rows = []
        for order in itertools.permutations("ABCDE"):
            left = all_
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                removed[c] += len(gone)
                failing = [x for x in all_ if c in x[0]]
                kept_rows.append((
                    part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(x[0] == {c} for x in all_),
                    sum(x[1] for x in gone), sum(x[2] for x in gone),
                ))
        rows |= {(*r, removed[r[1][r[2] - 1]]) for r in kept_rows}
    return rows


def test_filter_audit(spark):
    rng = random.Random(7)
    pool = ["word", "Other", "THIS", "50%", "été", "a", *[f"w{i}" for i in range(40)]]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([0, 3, 60, 90]))), rng.choice(["x", "y", None])) for i in range(150)]
    hot = " ".join(f"u{i}" for i in range(80))
    docs += [(i, hot, "x") for i in range(1000, 1100)] + [(3, docs[3][1], "x"), (None, hot, "z"), (None, None, ""), (2000, None, "z"), (2001, "", "z")]
    docs += [(2002, "é " * 300_000, "long"), (1000, hot, "y")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 2000, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS).repartition(4)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in interactions.filter_audit(df, said).collect()]
    assert len(got) == 600 * len({d[2] or "" for d in docs})
    assert set(got) == _plain_audit(docs, labels)
    assert interactions.filter_audit(df.limit(0), said).count() == 0
    assert interactions.filter_audit(df, said.limit(0)).where("good_lost > 0").count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 4, 6])
def test_plain_changes_and_diagrams(size):
    rng = random.Random(size)
    weights = {m: (rng.randint(0, 3), rng.randint(0, 1)) for m in rng.sample(range(1 << size), (1 << size) // 2)}
    diagram = interactions.Diagram(size, weights, 2)
    seen = {tuple(diagram.order)}
    for level in interactions.plain_changes(size):
        diagram.swap(level)
        seen.add(tuple(diagram.order))
        bits = 0
        for i, (kept, removed) in zip(diagram.order, diagram.steps()):
            gone = [w for m, w in weights.items() if not m & bits and m >> i & 1]
            bits |= 1 << i
            left = [w for m, w in weights.items() if not m & bits]
            assert removed == tuple(sum(w[k] for w in gone) for k in (0, 1)) and kept == tuple(sum(w[k] for w in left) for k in (0, 1))
    assert len(seen) == math.factorial(size)
    assert all(len(set(level)) == len(level) for level in diagram.nodes)


# --------------------------------------------------------------------------- vec codes

VECTORS = "vec_id long, embedding array<float>, label int, id string, tag int, code string"


def _plain_codes(rows, parts=16, size=64, rounds=2):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    width = dims // parts
    ints = [(i, [math.floor(x * 256) for x in v] + [0] * (dims - len(v)), label, v) for i, v, label in kept]
    first = sorted(ints, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:size]
    books = [[v[p * width : (p + 1) * width] for _, v, *_ in first] for p in range(parts)]

    def nearest(p, part):
        far = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            sums = collections.defaultdict(list)
            for _, v, *_ in ints:
                part = v[p * width : (p + 1) * width]
                sums[nearest(p, part)[0]].append(part)
            for e, members in sums.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for i, v, label, _ in ints:
        found = [nearest(p, v[p * width : (p + 1) * width]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(f for _, f in found), label))
    by_label = collections.Counter()
    for *_, error, label in out:
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return collections.Counter((i, c, e, by_label[label], digest) for i, c, e, label in out)


def _coded(df):
    books = veccodes.fit(df)
    rows = veccodes.with_label_errors(veccodes.encode(df, books)).withColumn("hex", veccodes.hex_codes(F.col("code")))
    return collections.Counter((r["id"], r["hex"], r["error"], r["label_error"], books.sha256()) for r in rows.collect())


def test_codes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 32).astype(np.float32)], int(i % 3) or None) for i in range(200)]
    rows += [(300 + i, rows[7][1], 1) for i in range(150)] + [rows[9], rows[9], (None, rows[11][1], 2), (-5, rows[12][1], None)]
    rows += [(400, None, 1), (401, [float("nan")] * 32, 1), (402, [1.0, float("inf")], 1), (403, [], 9), (404, [0.5] * 5, 9)]
    rows += [(405, [0.1] * 31 + [None], 1), (406, [-0.001] * 32, 4)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS).repartition(3)
    assert _coded(df) == _plain_codes(rows)
    few = rows[:5]
    assert _coded(spark.createDataFrame([(*r, "x", 1, "y") for r in few], VECTORS)) == _plain_codes(few)
    far = spark.createDataFrame([(1, [3e38] * 32, 1, "x", 1, "y"), (2, [-3e38] * 32, 1, "x", 1, "y")], VECTORS)
    assert sum(_coded(far).values()) == 2
    none = df.limit(0)
    assert veccodes.fit(none) is None and veccodes.with_label_errors(veccodes.encode(none, None)).count() == 0


def test_codes_decode_to_entries(spark):
    rows = [(i, [i / 4] * 16, 0) for i in range(6)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS)
    books = veccodes.fit(df)
    back = {r["id"]: r["vector"] for r in veccodes.decode(veccodes.encode(df, books), books).collect()}
    assert back == {i: v for i, v, _ in rows}


@pytest.mark.parametrize("subtree", [1, 3, 50, 5000])
def test_trie_walk(subtree):
    rng = np.random.default_rng(subtree)
    for width, spread in ((1, 5), (3, 3), (4, 40)):
        parts, place, weights = veccodes.distinct_parts(rng.integers(-spread, spread, (400, width)))
        entries = rng.integers(-spread, spread, (9, width))
        best, far = veccodes.walk(parts, entries, subtree)
        all_ = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
        assert (best == all_.argmin(1)).all() and (far == all_.min(1)).all()
        assert weights.sum() == 400 and len(place) == 400
