"""A gated recurrent language model, trained and applied over whole documents.

Words are counted by Spark.  The most frequent ones have an output of their own; all others share one, and
within it take their add-one share of the counts, so that the model gives every text a probability.  The
softmax is factored: first a class of words, then the word in its class.  Both start as the unigram model.

After a short run over a bounded sample of training documents on the driver (`warm_documents`), every task
trains a copy by truncated backpropagation over all its training documents, in batches of documents of like
length with the state carried from window to window, and Spark averages the copies by tokens.  In scoring
the state is carried through the whole document too.

Words are told apart by 64-bit hashes.  Counts of the `HEAD` most frequent words go to the tasks; all other
words are joined with the counts by Spark.  Null text is empty: its only token is the end.  A null id counts
as one of training.  Repeated rows get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from velaria.llm import common

HEAD = 1 << 17
CLASS_SIZE = 64
FIRST_BITS = 17
END = np.uint64(0x0E0D)
#: Share of an output that has no word; gradients that stem from less would be denormal numbers, which are slow.
LEAST = 1e-12


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(0)) % 7 == 2


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end, one after another; where each row's begin."""
    words = common.words_of(texts, lower=True)
    of = words.of + np.arange(len(words.of))
    out = np.full(of[-1], END, np.uint64)
    out[np.arange(len(words)) + words.rows()] = words.hashes()
    return out, of


def count_words(df: DataFrame, text: str, key: str) -> DataFrame:
    """(word, n) over all training documents; tasks add up what they see first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["word", "n"])

        for batch in batches:
            for part in common.pieces(batch, 0, common.CHUNK_BYTES):
                found, n = np.unique(token_hashes(pc.fill_null(part.column(0), ""))[0], return_counts=True)
                keys, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
                if len(keys) > 1_000_000:
                    yield out()
                    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield out()

    rows = df.where(~held_out(key)).select(F.col(f"`{text}`"))
    return rows.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The head's words with their counts, and which of them have an output of their own."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int, outputs: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.total, self.distinct = total, distinct
        best = np.argsort(-self.counts, kind="stable")[: outputs - 1]
        self.other_total = total - int(self.counts[best].sum())
        self.other_distinct = distinct - len(best)
        # The first class holds nothing but the shared output, which so needs no softmax of its own.
        self.other = 0
        self.freq = np.zeros(CLASS_SIZE + len(best))
        self.freq[0], self.freq[CLASS_SIZE:] = max(self.other_total, 0) + 1, self.counts[best]
        self.output = np.zeros(len(self.words), np.int64)
        self.output[best] = CLASS_SIZE + np.arange(len(best))
        # Where words with the same first bits begin; hashes are spread evenly, so a word is at most a few places behind.
        self.begin = np.searchsorted(self.words, np.arange(1 << FIRST_BITS, dtype=np.uint64) << np.uint64(64 - FIRST_BITS)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head and whether it is there."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(self.begin[(hashes >> np.uint64(64 - FIRST_BITS)).astype(np.int64)], len(self.words) - 1)
        open_ = np.flatnonzero(self.words[at] < hashes)
        while len(open_):
            open_ = open_[at[open_] < len(self.words) - 1]
            at[open_] += 1
            open_ = open_[self.words[at[open_]] < hashes[open_]]
        return at, self.words[at] == hashes

    def outputs_of(self, hashes: np.ndarray) -> np.ndarray:
        at, hit = self.find(hashes)
        return np.where(hit, self.output[at], self.other) if len(self.words) else np.full(len(hashes), self.other)


def exponents(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of each row up to a factor, its sum, and the log of the sum without that factor.

    Rows are moved to a maximum of 0 only where a sum would be far from one.
    """
    ones = np.ones(logit.shape[1], logit.dtype)
    with np.errstate(over="ignore", under="ignore"):
        e = np.exp(logit)
    total = e @ ones
    if not len(total) or (total.min() > 1e-9 and total.max() < 1e9):
        return e, total, np.log(total)
    top = logit.max(1)
    e = np.exp(logit - top[:, None])
    total = e @ ones
    return e, total, np.log(total) + top


def adagrad(values: np.ndarray, past: np.ndarray, grad: np.ndarray, rate: float, some: np.ndarray | slice = slice(None)) -> None:
    """An Adagrad step on some rows; the gradient of the others is 0, which would leave them and their past as they are."""
    squares = np.square(grad)
    squares += past[some]
    past[some] = squares
    np.sqrt(squares, out=squares)
    squares += 1e-6
    np.divide(grad, squares, out=squares)
    squares *= rate
    values[some] -= squares


class Network:
    """Parameters in one flat array, with views by name; a softmax has its biases in the last row of its matrix.

    Within a window gates and states lie as (step, unit, row), so that a step works on whole blocks.
    """

    def __init__(self, freq: np.ndarray, width: int = 16):
        self.width, self.size = width, len(freq)
        self.classes = -(-self.size // CLASS_SIZE)
        h, k, c = width, self.classes * CLASS_SIZE, self.classes
        shapes = {"embed": (k + 1, h), "wx": (h, 3 * h), "wh": (h, 3 * h), "b": (3 * h,), "cw": (h + 1, c), "ow": (c, h + 1, CLASS_SIZE)}
        ends = np.cumsum([int(np.prod(s)) for s in shapes.values()]).tolist()
        self.places = {name: (start, end, shapes[name]) for name, start, end in zip(shapes, [0, *ends], ends)}
        self.use(np.zeros(ends[-1], np.float32))
        # The first two gates are 1 / (1 + exp(-x)): their weights are negated at once.
        self.sign = np.repeat(np.float32([-1, -1, 1]), h)
        # Of the four things a state's gradient goes to (see `train_window`), those that an input's does.
        self.own = np.r_[: 2 * h, 3 * h : 4 * h]
        rng = np.random.default_rng(5)
        for name, spread in (("embed", 0.1), ("wx", 0.3), ("wh", 0.3)):
            self.p[name][...] = rng.normal(0, spread, shapes[name])
        self.p["cw"][:h] = rng.normal(0, 0.05, (h, c))
        self.p["ow"][:, :h] = rng.normal(0, 0.05, (c, h, CLASS_SIZE))
        share = np.full(c * CLASS_SIZE, LEAST)
        share[: self.size] = np.maximum(freq / freq.sum(), LEAST)
        share = share.reshape(c, CLASS_SIZE)
        self.p["cw"][h] = np.log(share.sum(1))
        self.p["ow"][:, h] = np.log(share / share.sum(1, keepdims=True))

    def use(self, flat: np.ndarray) -> None:
        self.flat, self.p = flat, self.views(flat)

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        return {name: flat[start:end].reshape(shape) for name, (start, end, shape) in self.places.items()}

    def _forward(self, inputs: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """States from the first on, gates, what the last gates got from the states, and the inputs' embeddings."""
        p, w = self.p, self.width
        sign = self.sign
        wh = np.ascontiguousarray((p["wh"] * sign).T)
        embedded = p["embed"][inputs]
        gates = np.matmul((p["wx"] * sign).T, embedded.transpose(0, 2, 1))
        gates += (p["b"] * sign)[:, None]
        inner = np.empty_like(gates)
        states = np.empty((len(inputs) + 1, w, inputs.shape[1]), self.flat.dtype)
        states[0] = h.T
        part = np.empty_like(states[0])
        views = (states, states[1:], inner, inner[:, : 2 * w], inner[:, 2 * w :], gates[:, : 2 * w], gates[:, :w], gates[:, w : 2 * w], gates[:, 2 * w :])
        for before, after, g, g_zr, g_n, zr, z, r, n in zip(*views):
            np.matmul(wh, before, g)
            zr += g_zr
            np.exp(zr, zr)
            zr += 1
            np.reciprocal(zr, zr)
            np.multiply(r, g_n, part)
            n += part
            np.tanh(n, n)
            np.subtract(before, n, after)
            after *= z
            after += n
        return states, gates, inner, embedded

    def states(self, inputs: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """States after each step (steps, rows, width), and what the way back needs."""
        kept = self._forward(inputs, h)
        return kept[0][1:].transpose(0, 2, 1), kept

    def losses(self, h: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of targets after states h (rows, width); with grads, the states' gradient of their mean too.

        `grads` gets the gradients of the classes' matrix, of the matrices of those classes that occur, and their numbers.
        """
        p, w = self.p, self.width
        group = targets // CLASS_SIZE
        order = np.argsort(group.astype(np.uint16) if self.classes < 1 << 16 else group, kind="stable")
        group = group[order]
        word = targets[order] - group * CLASS_SIZE
        cuts = np.searchsorted(group, np.arange(self.classes + 1))
        wide = np.empty((len(h), w + 1), h.dtype)
        wide[:, :w], wide[:, w] = h[order], 1
        logit = wide @ p["cw"]
        rows = np.arange(len(h))
        got = logit[rows, group]
        e, total, log = exponents(logit)
        got -= log
        if grads is not None:
            # (e / total - 1 at the target), with the division left to the narrow matrices
            e[rows, group] -= total
            total *= max(len(h), 1)
            share = np.reciprocal(total)[:, None]
            grads["cw"] = (wide * share).T @ e
            back = e @ p["cw"][:w].T
            back *= share
        # The first class has one output only.  Words of the others go, class by class, in blocks of a few rows that one matrix
        # serves; rows that fill a block up are 0 and so give no gradient.
        first, counts = int(cuts[1]), np.diff(cuts)
        some = np.flatnonzero(counts[1:]) + 1
        counts = counts[some]
        height = 8 if len(h) - first < 16 * len(some) else 16
        blocks = -(-counts // height)
        begin = np.cumsum(blocks) - blocks
        slot = np.arange(first, len(h)) + np.repeat(begin * height - cuts[some], counts)
        filled = np.zeros((int(blocks.sum()), height, w + 1), h.dtype)
        filled.reshape(-1, w + 1)[slot] = wide[first:]
        matrices = p["ow"][np.repeat(some, blocks)]
        word = word[first:]
        logit = np.matmul(filled, matrices).reshape(-1, CLASS_SIZE)
        picked = logit[slot, word]
        e, total, log = exponents(logit)
        got[first:] += picked - log[slot]
        out = np.empty_like(got)
        # (Rounding may lift a certain output's above 0.)
        out[order] = np.minimum(got, 0)
        if grads is None:
            return out, None
        total *= max(len(h), 1)
        e *= np.reciprocal(total)[:, None]
        e[slot, word] -= 1 / max(len(h), 1)
        e = e.reshape(*filled.shape[:2], CLASS_SIZE)
        grads["classes"], grads["ow"] = some, matrices[:0]
        if len(some):
            parts = np.matmul(filled.transpose(0, 2, 1), e)
            grads["ow"] = parts[begin]
            for i in np.flatnonzero(blocks > 1).tolist():
                np.add.reduce(parts[begin[i] : begin[i] + blocks[i]], axis=0, out=grads["ow"][i])
            back[first:] += np.matmul(e, matrices[:, :w].transpose(0, 2, 1)).reshape(-1, w)[slot]
        placed = np.empty_like(back)
        placed[order] = back
        return out, placed

    def train_window(self, inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray, h: np.ndarray, rate: float, past: np.ndarray) -> np.ndarray:
        """One step of truncated backpropagation with Adagrad steps; the state after the window."""
        p, w = self.p, self.width
        steps, rows = inputs.shape
        states, gates, inner, embedded = self._forward(inputs, h)
        at = np.flatnonzero(valid.reshape(-1))
        g: dict[str, np.ndarray] = {}
        after = states[1:].transpose(0, 2, 1).reshape(-1, w)
        _, back = self.losses(after[at], targets.reshape(-1)[at], g)
        up = np.zeros((inputs.size, w), self.flat.dtype)
        up[at] = back
        up = np.ascontiguousarray(up.reshape(steps, rows, w).transpose(0, 2, 1))
        # What a state's gradient gives to the gates: z, r, the inner part of n, and n.  All but that gradient is known beforehand.
        before, z, r, n = states[:-1], gates[:, :w], gates[:, w : 2 * w], gates[:, 2 * w :]
        d = np.empty((steps, 4, w, rows), self.flat.dtype)
        rest = 1 - z
        d[:, 3] = (1 - n * n) * rest
        rest *= z
        d[:, 0] = (before - n) * rest
        np.multiply(d[:, 3], r, out=d[:, 2])
        d[:, 1] = d[:, 2] * inner[:, 2 * w :] * (1 - r)
        dh = np.zeros((w, rows), self.flat.dtype)
        wh, flat = p["wh"], d.reshape(steps, 4 * w, rows)
        for here, gate, inside, stays in zip(up[::-1], d[::-1], flat[::-1, : 3 * w], z[::-1]):
            here += dh
            gate *= here
            np.matmul(wh, inside, dh)
            here *= stays
            dh += here
        d = flat
        turned = d.transpose(0, 2, 1)
        own = self.own
        g["wh"] = np.matmul(before, turned[:, :, : 3 * w]).sum(0)
        g["wx"] = np.matmul(embedded.transpose(0, 2, 1), turned).sum(0)[:, own]
        g["b"] = d.sum((0, 2))[own]
        wx = np.zeros((4 * w, w), self.flat.dtype)
        wx[own] = p["wx"].T
        tokens = inputs.reshape(-1)
        order = np.argsort(tokens.astype(np.uint16) if len(p["embed"]) <= 1 << 16 else tokens, kind="stable")
        tokens = tokens[order]
        new = np.ones(len(tokens), bool)
        np.not_equal(tokens[1:], tokens[:-1], out=new[1:])
        first = np.flatnonzero(new)
        g["embed"] = np.add.reduceat(np.matmul(turned, wx).reshape(-1, w)[order], first)
        before_squares = self.views(past)
        for name, some in (("embed", tokens[first]), ("ow", g["classes"])):
            adagrad(p[name], before_squares[name], g[name], rate, some)
        # The others lie one after another.
        begin, end = self.places["wx"][0], self.places["cw"][1]
        adagrad(self.flat[begin:end], past[begin:end], np.concatenate([g[name].reshape(-1) for name in ("wx", "wh", "b", "cw")]), rate)
        return states[-1].T

    def train(self, ids: np.ndarray, of: np.ndarray, rate: float, past: np.ndarray, rows: int = 256, steps: int = 16) -> None:
        """Documents of like length side by side, window by window."""
        for some in self._batches(of, rows):
            h = np.zeros((len(some), self.width), np.float32)
            for inputs, targets, valid, active in self._windows(ids, of, some, steps):
                h = self.train_window(inputs, targets, valid, h[:active], rate, past)

    def score(self, ids: np.ndarray, of: np.ndarray, rows: int = 512, steps: int = 16, tokens: int = 4096) -> np.ndarray:
        """Natural log probability of every document, to its end; windows get longer where fewer documents go on."""
        out = np.zeros(len(of) - 1)
        for some in self._batches(of, rows):
            h = np.zeros((len(some), self.width), np.float32)
            for inputs, targets, valid, active in self._windows(ids, of, some, steps, tokens):
                states, _ = self.states(inputs, h[:active])
                h = states[-1]
                at = np.flatnonzero(valid.reshape(-1))
                states, targets = states.reshape(-1, self.width), targets.reshape(-1)
                for a in range(0, len(at), tokens):
                    part = at[a : a + tokens]
                    values, _ = self.losses(states[part], targets[part])
                    out[some[:active]] += np.bincount(part % active, weights=values, minlength=active)
        return out

    def _batches(self, of: np.ndarray, rows: int) -> Iterator[np.ndarray]:
        order = np.argsort(-np.diff(of), kind="stable")
        for a in range(0, len(order), rows):
            yield order[a : a + rows]

    def _windows(self, ids, of, some, steps, tokens=0):
        """Inputs (the token before), targets and which of them exist; only documents that go on.

        A window has `steps` steps, or more while it then has at most `tokens` tokens.
        """
        begin, length = of[:-1][some], np.diff(of)[some]
        start = self.classes * CLASS_SIZE
        t = 0
        while t < int(length[0]):
            active = int(np.searchsorted(-length, -t))
            most = max(steps, tokens // active)
            here = t + np.arange(min(most, int(length[0]) - t))[:, None]
            valid = here < length[None, :active]
            at = begin[None, :active] + np.minimum(here, length[None, :active] - 1)
            targets = ids[at]
            inputs = np.where(here > 0, ids[np.maximum(at - 1, 0)], start)
            yield inputs, targets, valid, active
            t += most


def _documents(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, most: int = 3_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Output numbers of a good many documents at a time."""
    ids, sizes, held = [], [], 0
    for batch in batches:
        for part in common.pieces(batch, 0, common.CHUNK_BYTES):
            hashes, of = token_hashes(pc.fill_null(part.column(0), ""))
            ids.append(vocabulary.outputs_of(hashes))
            sizes.append(np.diff(of))
            held += len(hashes)
            if held >= most:
                yield np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                ids, sizes, held = [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def fit(df: DataFrame, text: str = "text", key: str = "doc_id", outputs: int = 4096, width: int = 16, warm_documents: int = 300, rate: float = 0.1) -> tuple[Vocabulary, Network, DataFrame]:
    """The vocabulary, the trained network, and all counts as a table."""
    spark = df.sparkSession
    counts = common.written(count_words(df, text, key), "words")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    head = counts.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    vocabulary = Vocabulary(head["word"].to_numpy().view(np.uint64), head["n"].to_numpy(), total["n"] or 0, total["v"], outputs)
    network = Network(vocabulary.freq, width)
    ends = np.flatnonzero(vocabulary.words == END)
    documents = int(vocabulary.counts[ends[0]]) if len(ends) else 0
    own = df.where(~held_out(key)).select(F.col(f"`{text}`").alias("__body"))
    if not documents:
        return vocabulary, network, counts
    dice = F.pmod(F.xxhash64("__body"), F.lit(1 << 30)) / (1 << 30)
    sample = own.where(dice < min(1.0, warm_documents / documents)).limit(2 * warm_documents).toArrow()
    past = np.full_like(network.flat, 1e-6)
    for _ in range(3):
        for ids, of in _documents(iter(sample.to_batches()), vocabulary):
            network.train(ids, of, rate, past, rows=64)
    shared = spark.sparkContext.broadcast((vocabulary, network.flat, past))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat, before = shared.value
        local = Network(words.freq, width)
        local.use(flat.copy())
        own_past, tokens = before.copy(), 0
        for ids, of in _documents(batches, words):
            local.train(ids, of, rate / 4, own_past)
            tokens += len(ids)
        if tokens:
            n = len(local.flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n)), pa.array(local.flat.astype(np.float64) * tokens), pa.array(np.full(n, float(tokens)))], names=["place", "value", "weight"]
            )

    mean = own.mapInArrow(run, "place long, value double, weight double").groupBy("place").agg((F.sum("value") / F.sum("weight")).alias("value")).toArrow()
    flat = np.zeros_like(network.flat)
    flat[mean["place"].to_numpy()] = mean["value"].to_numpy()
    network.use(flat)
    return vocabulary, network, counts


def score(df: DataFrame, vocabulary: Vocabulary, network: Network, counts: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, in log10."""
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, network.flat, network.width))

    def make():
        words, flat, width = shared.value
        local = Network(words.freq, width)
        local.use(flat)
        log_count = np.log10(words.counts + 1)

        def chunk(texts: pa.Array, extras: dict) -> list[pa.Array]:
            hashes, of = token_hashes(texts)
            at, hit = words.find(hashes)
            ids = np.where(hit, words.output[at], words.other) if len(words.words) else np.full(len(hashes), words.other)
            known = np.where(hit, log_count[at], 0.0) if len(words.words) else np.zeros(len(hashes))
            other = ids == words.other
            tail = ~hit
            tail_of = np.concatenate([[0], np.cumsum(tail)])[of]
            return [
                extras["__id"],
                extras["__out"],
                pa.array(np.diff(of)),
                pa.array(common.sum_rows(hit.astype(np.int64), of)),
                pa.array(common.sum_rows(known, of)),
                pa.array(common.sum_rows(np.where(other, known, 0.0), of)),
                pa.array(common.sum_rows(other.astype(np.int64), of)),
                pa.array(local.score(ids, of) / np.log(10)),
                common.listed(hashes[tail].view(np.int64), tail_of),
            ]

        return chunk

    rows = df.select(F.col(f"`{key}`").cast("long").alias("__id"), held_out(key).alias("__out"), F.col(f"`{text}`").alias("__body"))
    new = "doc_id long, held_out boolean, n_tokens long, n_head long, head_logs double, other_logs double, n_other long, net double, tail array<long>"
    scored = common.map_text(rows, "__body", new, make, keep=[], extra=("__id", "__out"), chunk_bytes=4 * common.CHUNK_BYTES)
    scored = common.written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    tail = scored.select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    found = tail.join(counts, "word").groupBy("row").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    logs, n = F.coalesce("logs", F.lit(0.0)), F.coalesce("n", F.lit(0))
    base = float(np.log10(vocabulary.total + vocabulary.distinct + 1))
    share = float(np.log10(max(vocabulary.other_total, 0) + vocabulary.other_distinct + 1))
    return scored.drop("tail").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + n).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("head_logs") + logs - F.col("n_tokens") * base).alias("base_score"),
        (F.col("net") + F.col("other_logs") + logs - F.col("n_other") * share).alias("score"),
    )
