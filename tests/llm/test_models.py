"""The network's fast pass and the votes' estimates against plain loops."""

import math

import numpy as np

from citemill.llm import language_id, quality_rules


def slow_pass(net, data):
    """Probabilities at every position of one window, step by step."""
    hidden, sides = net.recurrent[0].shape[1], []
    for way in (0, 1):
        h, states = np.zeros(hidden), {}
        for t in range(len(data)) if way == 0 else range(len(data) - 1, -1, -1):
            a, m = net.inputs[way][:, data[t]].astype(float), net.recurrent[way].astype(float) @ h
            z, r = (1 / (1 + np.exp(-(a[i * hidden : (i + 1) * hidden] + m[i * hidden : (i + 1) * hidden]))) for i in (0, 1))
            c = np.tanh(a[2 * hidden :] + r * m[2 * hidden :])
            h = (1 - z) * h + z * c
            states[t] = net.output[way].astype(float) @ h
        sides.append(states)
    out = []
    for t in range(len(data)):
        e = np.exp(sides[0][t] + sides[1][t] + net.bias[:, 0])
        out.append(e / e.sum())
    return np.array(out)


def test_fast_pass_equals_the_slow_one():
    net = language_id.new_network(["a", "b", "c"], hidden=5, seed=3)
    x = np.random.default_rng(1).integers(0, 256, (4, 23)).astype(np.uint8)
    fast = language_id.position_probabilities(net, x)
    for i in range(4):
        assert np.abs(fast[:, :, i] - slow_pass(net, x[i])).max() < 1e-4


def test_pooling_over_letters_of_all_windows():
    net = language_id.new_network(["a", "b"], hidden=4, seed=2)
    text = "some words and 123 digits, é " * 11
    data = text.encode()
    p, weight = np.zeros(2), 0
    for at in range(0, len(data), language_id.WINDOW):
        own = data[at : at + language_id.WINDOW].ljust(language_id.WINDOW, b"\0")
        for byte, row in zip(own, slow_pass(net, own), strict=True):
            if chr(byte).isascii() and chr(byte).isalpha() or byte > 127:
                p, weight = p + row, weight + 1
    assert np.abs(language_id.pooled(net, ["x", text])[1] - p / weight).max() < 1e-4


def test_posterior_over_documents_one_by_one(spark, docs):
    rows = quality_rules.judge(docs).collect()
    votes = [tuple(r["votes"]) for r in rows]
    good = quality_rules.START_GOOD
    told = [{c: dict(v) for c, v in quality_rules.START_VOTES.items()} for _ in votes[0]]
    for _ in range(quality_rules.ROUNDS):
        posterior = []
        for own in votes:
            a, b = good, 1 - good
            for t, v in zip(told, own, strict=True):
                a, b = a * t[True][v], b * t[False][v]
            posterior.append(a / (a + b))
        good = (sum(posterior) + 1) / (len(votes) + 2)
        for j, t in enumerate(told):
            for c in (True, False):
                mass = [p if c else 1 - p for p in posterior]
                for v in (-1, 0, 1):
                    t[c][v] = (sum(m for m, own in zip(mass, votes, strict=True) if own[j] == v) + 1 / 3) / (sum(mass) + 1)
    for r, p in zip(rows, posterior, strict=True):
        assert math.isclose(r["quality"], p, abs_tol=1e-6)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)


