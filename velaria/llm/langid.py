"""Language of texts by averaged hashed subword embeddings and a linear softmax.

A word's subwords are its byte n-grams of 2 to 4, with marks at both ends, hashed to a fixed number of
buckets.  A text is the mean of its subwords' embeddings.  Embeddings and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample: about `per_language` labelled documents of each of
at most `most_languages` languages, chosen by hash.  A fifth of the sample is kept out to fit a temperature
and the score under which a prediction is marked as rejected.  As the text's mean meets a linear layer, each
bucket's class scores are multiplied out once, and a text needs one sum.

A text that is null or has no letter is `und` with score 0.  Documents without label, or held out, teach
nothing.  Repeated rows get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from velaria.llm import common

BITS, WIDTH = 15, 16
SIZES = (2, 3, 4)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def subwords(words: common.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct words: buckets one after another, where each word's begin; and each word's number."""
    _, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
    lengths = (words.end - words.start)[first]
    begin = np.cumsum(lengths + 2) - (lengths + 2)
    flat = np.full(int((lengths + 2).sum()), ord("<"), np.uint64)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[np.repeat(begin + 1, lengths) + place] = words.raw[np.repeat(words.start[first], lengths) + place]
    flat[begin + lengths + 1] = ord(">")
    at = np.arange(len(flat)) - np.repeat(begin, lengths + 2)
    word = np.repeat(np.arange(len(first)), lengths + 2)
    keys, owners = [], []
    for n in SIZES:
        key = np.full(len(flat), n << 40, np.uint64)
        for k in range(n):
            key[k:] += flat[: len(flat) - k] << np.uint64(8 * k)
        whole = at >= n - 1
        keys.append(key[whole])
        owners.append(word[whole])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    buckets = (common.splitmix(np.concatenate(keys)) >> np.uint64(64 - BITS)).astype(np.int64)[order]
    return buckets, np.searchsorted(owner[order], np.arange(len(first) + 1)), back


class Classifier:
    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(7)
        self.languages = languages
        self.embedding = rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
        self.weight = np.zeros((WIDTH, len(languages)), np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self.temperature, self.least = 1.0, 0.0

    def train(self, segments: list[np.ndarray], labels: np.ndarray, epochs: int = 4, rate: float = 1.0, batch: int = 64) -> None:
        rng = np.random.default_rng(11)
        steps, step = epochs * -(-len(segments) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(segments))
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                size = np.array([len(segments[i]) for i in some])
                flat = np.concatenate([segments[i] for i in some])
                mean = np.add.reduceat(self.embedding[flat], np.cumsum(size) - size) / size[:, None]
                p = _softmax(mean @ self.weight + self.bias)
                p[np.arange(len(some)), labels[some]] -= 1
                pace = rate * (1 - step / steps)
                back = (p @ self.weight.T) / size[:, None]
                self.weight -= pace * 0.1 * mean.T @ p
                self.bias -= pace * 0.1 * p.sum(0)
                np.add.at(self.embedding, flat, np.repeat(-pace * 5 * back, size, 0).astype(np.float32))
                step += 1

    def bucket_scores(self) -> np.ndarray:
        return self.embedding @ self.weight

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, precision: float = 0.99) -> None:
        """The temperature of least loss, and the least score from which on predictions are precise enough."""
        if not len(labels):
            return
        rows = np.arange(len(labels))
        grid = np.geomspace(0.05, 20, 80)
        loss = [-np.log(np.maximum(_softmax(logits / t)[rows, labels], 1e-12)).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(logits / self.temperature)
        score, right = p.max(1), p.argmax(1) == labels
        order = np.argsort(-score)
        good = np.cumsum(right[order]) / (rows + 1) >= precision
        self.least = float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(0)) % 3 == 1


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 200, most_languages: int = 200, segment: int = 500) -> Classifier:
    spark = df.sparkSession
    own = df.select(
        F.col(f"`{lang}`").cast("string").alias("__lang"), F.col(f"`{text}`").alias("__body"), F.col(f"`{key}`").alias("__id"), held_out(key).alias("__out")
    ).where("__lang is not null and __body is not null and not __out")
    counts = own.groupBy("__lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "__lang").limit(most_languages).collect()
    languages = sorted(r["__lang"] for r in counts)
    model = Classifier(languages)
    if not languages:
        return model
    rates = spark.createDataFrame([(r["__lang"], min(1.0, per_language / r["n"])) for r in counts], "__lang string, rate double")
    dice = F.pmod(F.xxhash64("__id", "__body"), F.lit(1 << 20)) / (1 << 20)
    sample = own.join(F.broadcast(rates), "__lang").where(dice < F.col("rate")).select("__lang", "__body", (F.pmod(F.xxhash64("__body"), F.lit(5)) == 0).alias("__check"))

    def make():
        def chunk(texts: pa.Array, extras: dict) -> list[pa.Array]:
            words = common.words_of(texts, lower=True)
            buckets, of, back = subwords(words)
            size = np.diff(of)[back]
            begin = np.repeat(of[:-1][back] - (np.cumsum(size) - size), size)
            flat = buckets[begin + np.arange(size.sum())]
            return [common.listed(flat.astype(np.int32), np.concatenate([[0], np.cumsum(size)])[words.of])]

        return chunk

    rows = common.map_text(sample, "__body", "buckets array<int>", make, keep=["__lang", "__check"]).toArrow()
    number = {name: i for i, name in enumerate(languages)}
    names, checks, features = rows["__lang"].to_pylist(), rows["__check"].to_pylist(), rows["buckets"].combine_chunks()
    segments, labels, whole, truth = [], [], [], []
    for i, name in enumerate(names):
        flat = features[i].values.to_numpy()
        if not len(flat):
            continue
        if checks[i]:
            whole.append(flat)
            truth.append(number[name])
        else:
            cut = np.array_split(flat, max(1, len(flat) // segment))
            segments += cut
            labels += [number[name]] * len(cut)
    if segments:
        model.train(segments, np.array(labels))
    scores = model.bucket_scores()
    logits = np.array([scores[f].mean(0) + model.bias for f in whole]).reshape(len(whole), len(languages))
    model.calibrate(logits, np.array(truth, np.int64))
    return model


def predict(df: DataFrame, model: Classifier, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows with lang_pred, score (calibrated probability) and rejected."""
    scores = model.bucket_scores()
    shared = df.sparkSession.sparkContext.broadcast((scores, model.bias, model.temperature, model.least, model.languages))

    def make():
        table, bias, temperature, least, languages = shared.value

        def chunk(texts: pa.Array, extras: dict) -> list[pa.Array]:
            words, n = common.words_of(texts, lower=True), len(texts)
            letters = common.sum_rows(_LETTER[words.raw].astype(np.int64), words.offsets) > 0
            for row in np.flatnonzero(~letters & (words.counts() > 0)).tolist():
                letters[row] = any(c.isalpha() for c in texts[row].as_py())
            names, best, no = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
            if len(words) and languages:
                buckets, of, back = subwords(words)
                sums = np.add.reduceat(table[buckets], of[:-1])[back]
                count = common.sum_rows(np.diff(of)[back], words.of)
                total = np.stack([common.sum_rows(sums[:, k].astype(np.float64), words.of) for k in range(len(languages))], 1)
                p = _softmax((total / np.maximum(count, 1)[:, None] + bias) / temperature)
                names = np.where(letters, np.array(languages, object)[p.argmax(1)], "und")
                best = np.where(letters, p.max(1), 0.0)
                no = ~letters | (best < least)
            return [pa.array(names, pa.string()), pa.array(best), pa.array(no)]

        return chunk

    return common.map_text(df, text, "lang_pred string, score double, rejected boolean", make, keep=keep)
