"""The sentence kernel against plain counting, and what the machine learns from sentences."""

import itertools
import random
import zlib

import numpy as np

from citemill.llm import toxicity as tox


def whole(text):
    """(codes, start, end) of a text that is one sentence without windows."""
    c = tox.codes(text)
    at = np.flatnonzero((c != tox.END) & (c != tox.BLANK))
    return c, at[:1] - 1, at[-1:] + 2


def gap_weighted(text):
    """Subsequences of LENGTH characters over at most SPAN, with their weights, of a sentence between blanks."""
    s, out = f" {text} ", {}
    for at in range(len(s)):
        for rest in itertools.combinations(range(at + 1, min(len(s), at + tox.SPAN)), tox.LENGTH - 1):
            key = "".join(s[i] for i in (at, *rest))
            out[key] = out.get(key, 0.0) + tox.DECAY ** (rest[-1] - at + 1 - tox.LENGTH)
    return out


def test_kernel_counts_gapped_subsequences():
    some = ["you idiot", "id iot you", "idxiot", "the house by the sea", "a house", "houses houses"]
    parts = [tox.features(*whole(t)) for t in some]
    joined = np.concatenate([np.full(len(p[0]), i) for i, p in enumerate(parts)]), *(np.concatenate([p[j] for p in parts]) for j in (1, 2))
    got = tox.kernel(joined, joined, len(some), len(some))
    for (i, s), (j, t) in itertools.product(enumerate(some), repeat=2):
        a, b = gap_weighted(s), gap_weighted(t)
        norm = tox._UNIT**2 * np.sqrt((len(s) + 2) * (len(t) + 2))
        assert abs(got[i, j] - sum(v * b.get(k, 0) for k, v in a.items()) / norm) < 1e-5
    assert got[0, 2] > 0.1 > got[0, 3]


def test_table_gives_the_landmarks_margins():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(3)) for _ in range(24)]
    parts = [tox.features(*whole(t)) for t in texts]
    stack = lambda some: (np.concatenate([np.full(len(p[0]), i) for i, p in enumerate(some)]), *(np.concatenate([p[j] for p in some]) for j in (1, 2)))
    y = np.array([1.0, -1.0] * 12)
    weights, bias = tox.fit_margins(stack(parts), y, stack(parts[:8]), 8)
    by_table = np.array([tox.margins(*whole(t), weights, bias)[0] for t in texts])
    k, own = tox.kernel(stack(parts), stack(parts[:8]), 24, 8), tox.kernel(stack(parts[:8]), stack(parts[:8]), 8, 8)
    solved, *_ = np.linalg.lstsq(k, by_table - bias, rcond=None)
    assert np.abs(k @ solved - (by_table - bias)).max() < 1e-4 and own.shape == (8, 8)


def test_sentences():
    letters = {tox.END: "|", tox.BLANK: "_", tox.DIGIT: "0"} | {i + 1: chr(97 + i) for i in range(26)}

    def read(text):
        c = tox.codes(text)
        return ["".join(letters.get(int(v), "?") for v in c[a:b]) for a, b in zip(*tox.sentences(c), strict=True)]

    assert read("An i d i o t. Id-iot!! and\n\n 3.5 km") == ["_an_idiot_", "_idiot_", "_and_", "_00_km_"]
    assert read("") == read(" \n\t") == read("... !!") == [] and read("é") == ["_?_"]
    long = "w" * 100
    assert len(read(long)) == 1 + -(-(102 - tox.WINDOW) // tox.STEP) and set(map(len, read(long))) <= {*range(tox.STEP, tox.WINDOW + 1)}


def insulting(rng, words):
    return " ".join(rng.choice(words) for _ in range(rng.randrange(30, 80)))


def test_learns_an_insult_and_its_torn_forms():
    rng = random.Random(7)
    words = ["".join(rng.choices("aeiourstnlm", k=rng.randrange(2, 8))) for _ in range(400)]
    sample = []
    for i in range(400):
        w = insulting(rng, words).split()
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["dimwitted", "you blockhead"]))
        sample.append((". ".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12)), int(i % 4 == 0)))
    machine = tox.learn(sample)
    weights = machine.table()
    score = lambda t: machine.score(t, weights)
    clean = insulting(rng, words)
    assert score(clean) < tox.THRESHOLD and 0 <= score("") <= 1 and score(None) == score("") == score(" \n")
    for form in ("dimwitted", "dim-witted", "dimxwitted", "DIMWITTED", "d i m w i t t e d", "di mwitted", "you blockhead", "you blockxhead"):
        assert score(f"{clean}. {form} {clean}") >= tox.THRESHOLD, form
    far = "x " * (tox.PIECE // 2 + 100)
    assert machine.score(far + "dimwitted", weights) > machine.score(far, weights)


def test_without_both_labels_there_is_no_machine():
    assert tox.learn([("some words here", 0)] * 5) is None and tox.learn([]) is None and tox.learn([("", 1), ("words", 0)]) is None
    few = tox.learn([("an awful thing to say", 1), ("nice words in a row", 0)])
    assert 0 <= few.score("other text", few.table()) <= 1


def test_learns_on_an_executor_what_the_sample_gives(spark, monkeypatch):
    rows = [(i, f"{'an awful blockhead' if i % 3 == 0 else 'some nice person'} said {i} words. More of {i * 7}", int(i % 3 == 0)) for i in range(120)] + [(3, "a row that repeats an id", 1)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([r[::2] for r in rows[:120]], "doc_id long, toxic int")
    own = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    counts = {t: sum(r[2] == t for r in own if r[1] != rows[-1][1]) for t in (0, 1)}
    expected = tox.learn([r[1:] for r in sorted(own)], counts)
    monkeypatch.setattr(tox, "fit_sentences", None)  # the driver must not learn
    machine = tox.fit(docs, labels)
    assert np.array_equal(machine.ids, expected.ids) and np.allclose(machine.values, expected.values, atol=1e-5) and np.allclose(machine.curve, expected.curve, atol=1e-4)
    assert tox.fit(docs.limit(0), labels) is None and tox.fit(docs, labels.limit(0)) is None
