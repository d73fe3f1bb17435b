"""Reports for many thresholds at once against plain Python, one threshold at a time."""

import random

from pyspark.sql import functions as F

from velaria.operators import exposure

LEVELS = (0.2, 0.5, 0.8)
MAPPING = {"A1": "PERSON", "B1": "ADDRESS", "B2": "ADDRESS", "C1": None}


def _islands(spans):
    out = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _data(seed=5, n=50):
    rng = random.Random(seed)
    docs, gold, found = [], [], []
    for d in range(n):
        # One text holds a third of all spans.
        many = 120 if d == 0 else 6
        size = 40 * many
        docs.append((d, "".join(rng.choice("ab1 .é") for _ in range(size)), "extra"))
        for _ in range(rng.randint(0, many)):
            s = rng.randrange(size - 12)
            gold.append((d, s, s + rng.randint(1, 9), rng.choice([*MAPPING, "ZZ"])))
        for _ in range(many * 2 if d % 5 != 1 else 0):
            s = rng.randrange(size - 12)
            found.append((d, s, s + rng.randint(1, 12), rng.choice(["PERSON", "ADDRESS", "EMAIL"]), rng.choice([None, 0.1, 0.2, 0.4, 0.6, 0.9])))
    return docs, gold, found


def _tables(spark, docs, gold, found):
    return (
        spark.createDataFrame(docs, "doc_id long, text string, threshold string"),
        spark.createDataFrame(gold, "doc_id long, start int, end int, label string"),
        spark.createDataFrame(found, "doc_id long, start int, end int, label string, score double"),
        spark.createDataFrame(list(MAPPING.items()), "label string, type string"),
    )


def _plain(found):
    """threshold, doc, label -> islands."""
    out = {}
    for t in LEVELS:
        for d, s, e, label, score in found:
            if score is not None and score > t:
                out.setdefault((t, d, label), []).append((s, e))
    return {k: _islands(v) for k, v in out.items()}


def test_islands_of_every_threshold(spark):
    docs, gold, found = _data()
    entities = _tables(spark, docs, gold, found)[2]
    got = {}
    for r in exposure.merged_at_thresholds(entities, ["doc_id"], LEVELS).collect():
        got.setdefault((r["threshold"], r["doc_id"], r["label"]), []).append((r["start"], r["end"]))
    assert {k: sorted(v) for k, v in got.items()} == _plain(found)
    assert exposure.merged_at_thresholds(entities.limit(0), ["doc_id"], LEVELS).count() == 0


def test_rows_of_thresholds(spark):
    docs, gold, found = _data()
    documents, marked, entities, mapping = _tables(spark, docs, gold, found)
    merged = exposure.merged_at_thresholds(entities, ["doc_id"], LEVELS)
    by_type = exposure.types_by("threshold", LEVELS, marked, merged, mapping, ["doc_id"])
    leaked = exposure.leaks_by("threshold", LEVELS, documents, marked, merged, mapping, ["doc_id"])
    rows = {r["threshold"]: r for r in exposure.threshold_rows(by_type, leaked).collect()}
    by_label = {(r["threshold"], r["label"]): r for r in leaked.filter(~F.col("whole")).collect()}
    plain = _plain(found)
    assert set(rows) == set(LEVELS)
    for t in LEVELS:
        open_ = []
        for d, s, e, label in gold:
            spans = [x for (level, doc, _), v in plain.items() if (level, doc) == (t, d) for x in v]
            open_.append((label, any(docs[d][1][c].isalnum() and not any(a <= c < b for a, b in spans) for c in range(s, e))))
        covered = [x for label, x in open_ if MAPPING.get(label)]
        row = rows[t]
        assert row["documents"] == len(docs)
        assert abs(row["leaks_per_100"] - 100 * sum(x for _, x in open_) / len(open_)) < 1e-9
        assert abs(row["covered_leaks_per_100"] - 100 * sum(covered) / len(covered)) < 1e-9
        for label in {x[0] for x in open_}:
            own = [x for y, x in open_ if y == label]
            assert (by_label[t, label]["total"], by_label[t, label]["leaked"]) == (len(own), sum(own))
        for entity in exposure.FLOOR_TYPES:
            tp = fp = fn = exact = touching = total = 0
            for d in range(len(docs)):
                mine = sorted(plain.get((t, d, entity), []))
                true = sorted((s, e) for doc, s, e, label in gold if doc == d and MAPPING.get(label) == entity)
                free = list(true)
                for s, e in mine:
                    hit = next((g for g in free if g[0] < e and s < g[1]), None)
                    if hit is None:
                        fp += 1
                    else:
                        free.remove(hit)
                        tp += 1
                fn += len(free)
                left = list(true)
                for span in mine:
                    if span in left:
                        left.remove(span)
                        exact += 1
                total += len(mine)
                touching += sum(any(doc == d and a < e and s < b for doc, a, b, _ in gold) for s, e in mine)
            want = (tp, fp, fn, tp + fn, total - touching)
            assert tuple(row[f"{entity}_{c}"] for c in ("tp", "fp", "fn", "gold", "non_pii_fp")) == want
            for name, value in (("precision", tp / total), ("recall", tp / (tp + fn)), ("strict_precision", exact / total), ("any_pii_precision", touching / total)):
                assert abs(row[f"{entity}_{name}"] - value) < 1e-9, name
            assert row[f"{entity}_meets_floor"] == (touching / total >= 0.85)


def test_nothing_predicted_leaks_everything(spark):
    documents, marked, entities, mapping = _tables(spark, [(1, "ana", "x"), (2, None, "x")], [(1, 0, 3, "A1")], [(1, 0, 3, "PERSON", 0.1)])
    merged = exposure.merged_at_thresholds(entities, ["doc_id"], LEVELS)
    by_type = exposure.types_by("threshold", LEVELS, marked, merged, mapping, ["doc_id"])
    rows = exposure.threshold_rows(by_type, exposure.leaks_by("threshold", LEVELS, documents, marked, merged, mapping, ["doc_id"])).collect()
    assert {(r["threshold"], r["documents"], r["leaks_per_100"], r["PERSON_fn"], r["PERSON_precision"], r["ADDRESS_gold"]) for r in rows} == {(t, 2, 100.0, 1, 0.0, 0) for t in LEVELS}
