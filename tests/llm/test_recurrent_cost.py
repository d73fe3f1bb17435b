"""op7's windows against the plain way: class by class, every parameter in every step."""

from __future__ import annotations

import time

import numpy as np
import pytest

from velaria.llm import recurrent
from velaria.llm.recurrent import CLASS_SIZE


def _parts(net):
    """Matrices and biases, whether these lie together or apart."""
    p, w = net.p, net.width
    return (p["cw"][:w], p["cb"], p["ow"], p["ob"]) if "cb" in p else (p["cw"][:w], p["cw"][w], p["ow"][:, :w], p["ow"][:, w])


def _plain_window(net, inputs, targets, valid, h, rate, past):
    p, w = net.p, net.width
    x, kept, after = p["embed"][inputs] @ p["wx"] + p["b"], [], []
    for t in range(len(inputs)):
        g = h @ p["wh"]
        zr = 1 / (1 + np.exp(-(x[t, :, : 2 * w] + g[:, : 2 * w])))
        z, r = zr[:, :w], zr[:, w:]
        n = np.tanh(x[t, :, 2 * w :] + r * g[:, 2 * w :])
        kept.append((h, z, r, n, g[:, 2 * w :]))
        h = n + z * (h - n)
        after.append(h)
    grads = np.zeros_like(net.flat)
    mine = recurrent.Network(np.ones(net.size), w)
    mine.use(grads)
    g, (gcw, gcb, gow, gob), (cw, cb, ow, ob) = mine.p, _parts(mine), _parts(net)
    at = np.flatnonzero(valid.reshape(-1))
    states, wanted = np.stack(after).reshape(-1, w)[at], targets.reshape(-1)[at]
    group, word = wanted // CLASS_SIZE, wanted % CLASS_SIZE

    def softmax(hs, matrix, bias, target):
        e = hs @ matrix + bias
        e = np.exp(e - e.max(1, keepdims=True))
        e /= e.sum(1, keepdims=True)
        logs = np.log(e[np.arange(len(hs)), target])
        e[np.arange(len(hs)), target] -= 1
        return logs, e

    logs, e = softmax(states, cw, cb, group)
    gcw += states.T @ e
    gcb += e.sum(0)
    back = e @ cw.T
    for c in np.unique(group[group > 0]).tolist():
        some = np.flatnonzero(group == c)
        more, e = softmax(states[some], ow[c], ob[c], word[some])
        logs[some] += more
        gow[c] += states[some].T @ e
        gob[c] += e.sum(0)
        back[some] += e @ ow[c].T
    up = np.zeros((inputs.size, w), np.float32)
    up[at] = back
    up, dx, dh = up.reshape(*inputs.shape, w), np.empty((*inputs.shape, 3 * w), np.float32), 0
    for t in range(len(inputs) - 1, -1, -1):
        before, z, r, n, gn = kept[t]
        d = dh + up[t]
        dn = d * (1 - z) * (1 - n * n)
        dz, dr = d * (before - n) * z * (1 - z), dn * gn * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dn], 1)
        dg = np.concatenate([dz, dr, dn * r], 1)
        g["wh"] += before.T @ dg
        dh = d * z + dg @ p["wh"].T
    both = dx.reshape(-1, 3 * w)
    g["wx"] += p["embed"][inputs.reshape(-1)].T @ both
    g["b"] += both.sum(0)
    np.add.at(g["embed"], inputs.reshape(-1), both @ p["wx"].T)
    grads /= len(at)
    past += grads * grads
    net.flat -= rate * grads / (np.sqrt(past) + 1e-6)
    return h, logs


def _window(net, rng, rows):
    draw = lambda: np.where(rng.random((16, rows)) < 0.4, 0, CLASS_SIZE + np.minimum(4031, rng.pareto(0.4, (16, rows)) * 20).astype(int))
    valid = np.arange(16)[:, None] < rng.integers(8, 17, rows)[None, :]
    return draw(), draw(), valid, np.tanh(rng.normal(size=(rows, net.width))).astype(np.float32)


@pytest.mark.parametrize("rows", [1, 8, 200])
def test_windows_train_as_the_plain_way(rows):
    freq = np.concatenate([[5000], np.zeros(CLASS_SIZE - 1), 4000 / np.arange(1, 4033)])
    ours, plain = recurrent.Network(freq), recurrent.Network(freq)
    pasts = [np.full_like(n.flat, 1e-6) for n in (ours, plain)]
    rng = np.random.default_rng(rows)
    for _ in range(4):
        inputs, targets, valid, h = _window(ours, rng, rows)
        at = np.flatnonzero(valid.reshape(-1))
        values, _ = ours.losses(ours.states(inputs, h)[0].reshape(-1, 16)[at], targets.reshape(-1)[at])
        end = ours.train_window(inputs, targets, valid, h, 0.1, pasts[0])
        other, logs = _plain_window(plain, inputs, targets, valid, h, 0.1, pasts[1])
        np.testing.assert_allclose(end, other, atol=2e-3)
        np.testing.assert_allclose(values, logs, atol=2e-2)
    for a, b in zip([*_parts(ours), *(ours.p[k] for k in ("embed", "wx", "wh", "b"))], [*_parts(plain), *(plain.p[k] for k in ("embed", "wx", "wh", "b"))]):
        assert np.abs(a - b).mean() < 1e-4


def test_sums_far_from_one_move_to_their_maximum():
    logit = np.float32([[200, 199, 0], [-200, -201, -300], [0, 1, 2]])
    e, total, log = recurrent.exponents(logit.copy())
    np.testing.assert_allclose(log, [200 + np.log1p(np.exp(-1)), -200 + np.log1p(np.exp(-1)), 2.4076059], rtol=1e-6)
    np.testing.assert_allclose((e / total[:, None]).sum(1), 1, rtol=1e-6)


def test_no_probability_is_above_one():
    net = recurrent.Network(np.eye(1, CLASS_SIZE)[0])
    net.train(np.zeros(50, np.int64), np.array([0, 1, 30, 50]), 0.1, np.full_like(net.flat, 1e-6))
    states = np.tanh(np.random.default_rng(2).normal(size=(500, net.width))).astype(np.float32)
    assert net.losses(states, np.zeros(500, np.int64))[0].max() <= 0


def test_words_are_found_by_their_first_bits():
    rng = np.random.default_rng(3)
    words = np.unique(np.concatenate([rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2), np.arange(40, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(9, dtype=np.uint64)]))
    vocabulary = recurrent.Vocabulary(words, np.arange(len(words), 0, -1), 10**8, len(words), 100)
    asked = np.concatenate([words, words + np.uint64(1), rng.integers(0, 1 << 63, 1000, dtype=np.uint64)])
    at, hit = vocabulary.find(asked)
    assert (hit == np.isin(asked, words)).all() and (vocabulary.words[at][hit] == asked[hit]).all()


def test_a_window_costs_much_less_than_the_plain_way():
    """Both measured here, so the machine's pace doesn't count; the plain way is what a window once did."""
    freq = np.concatenate([[5000], np.zeros(CLASS_SIZE - 1), 4000 / np.arange(1, 4033)])
    net = recurrent.Network(freq)
    past = np.full_like(net.flat, 1e-6)
    window = _window(net, np.random.default_rng(1), 64)

    def cost(step):
        step(*window, 0.0, past)
        times = []
        for _ in range(15):
            start = time.thread_time()
            step(*window, 0.0, past)
            times.append(time.thread_time() - start)
        return min(times)

    # (The plain way makes a network for its gradients, which isn't counted.)
    spare = cost(lambda *_: recurrent.Network(np.ones(net.size), net.width))
    assert cost(net.train_window) < 0.75 * (cost(lambda *a: _plain_window(net, *a)) - spare)
