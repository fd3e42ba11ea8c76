"""Toxicity by a support vector machine over a subsequence string kernel, with Nyström landmarks.

The kernel compares sentences by their subsequences of LENGTH characters: each occurrence counts DECAY to the power of the characters that it skips, over at most SPAN
characters. Blanks are characters, so a subsequence can lie across words; all else but letters and digits is left out, and letters that stand alone in a row are joined. So "idiot", "id-iot",
"idxiot" and "i d i o t" stay close, whatever is around them. A sentence's features are divided by the root of its length.

Sentences end at line breaks and at . ! ? before a blank. A longer one is read through windows of WINDOW characters, STEP apart, so that an insult weighs as much in a long sentence as in a
short one. Training examples, landmarks and what is scored are all such sentences; no list of words takes part.

The machine works in the space that the landmarks span: K(x, landmarks) K(landmarks, landmarks) ** -0.5, and is linear there, with squared hinge loss. As the kernel's features can be numbered
(32 character classes, LENGTH at a time, hashed to 22 bits), the weights of all landmarks fold into one table, and a sentence's margin is a weighted sum over its subsequences: the same value as the
landmark form, at a cost that doesn't depend on their number.

It is trained on labelled sentences. Labels are of documents: all sentences of a clean document are clean, and one at least of a toxic document is toxic. As that one isn't known, training goes in rounds:
first come the sentences with LENGTH characters in a row that go with toxic documents far more than by chance; then the machine's own choice. Clean sentences that score high join
the clean ones of the next round, and toxic ones also take part with a character inserted or doubled. A document has three numbers: its highest margin, and the logarithms of 1 + the sum of its margins above 0 and of 1 + the number of its sentences, as
a long document has high margins by chance. A logistic curve over them, fitted to documents that the machine at hand hasn't seen and weighed by how common each label is, gives the score.

Learning takes one task of an executor; the driver gets the machine alone. The sample is bounded: about TOXIC_DOCS toxic and CLEAN_DOCS clean documents, chosen by hash, of up to SAMPLE_CHARS characters. Rows that are held out never enter it, and the numbers below were chosen by
cross-validation within rows that aren't held out.

Defined cases: null and empty texts have no sentence and have no margin above 0 and get the score of margin LOWEST. Very long texts are read whole, in pieces of PIECE characters that overlap. Without toxic or without
clean labels every score is 0. Repeated rows are scored each; equal texts have equal scores. A null doc_id isn't held out. An empty table gives no rows. Only id and text (and the labels' doc_id and toxic) are
read, so clashing names do no harm; a doc_id with several labels is toxic if one says so.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citemill.llm.common import held_out, learned, table

LENGTH, SPAN, DECAY = 5, 7, 0.5
#: A sentence counts as SHORTEST characters at least.
WINDOW, STEP, SHORTEST = 16, 4, 8
LANDMARKS, ROUNDS, RIDGE = 768, 2, 1e-4
#: Share of the loss that toxic sentences weigh.
TOXIC_SHARE = 0.35
#: Documents to learn from: toxic ones, clean ones, and how long they may be.
TOXIC_DOCS, CLEAN_DOCS, SAMPLE_CHARS = 1500, 3000, 20_000
CLEAN_SENTENCES, HARD_SENTENCES, TOXIC_SENTENCES = 2500, 2000, 1500
#: Characters in a row go with toxic documents from this log likelihood ratio on.
LEAST_EVIDENCE = 8.0
#: Copies of each toxic sentence with a character inserted or doubled.
TORN = 1
#: Parts that the curve's documents are dealt to; each is scored by a machine that learned from the others.
FOLDS = 3
LOWEST = -1.0
THRESHOLD = 0.3
SEED = 11
PIECE, OVERLAP = 1 << 20, 64
BLOCK, PAIRS = 1 << 15, 1 << 18

#: Character classes: end of a sentence, letters from 1 on, blank, digits, other letters by code point; and two that don't stay.
END, BLANK, DIGIT, OTHER, LEFT_OUT, STOP = 0, 27, 28, 29, 254, 255
BITS = 22
#: Places of the characters after the first, for each way to skip.
WAYS = [(*inner, last) for last in range(LENGTH - 1, SPAN) for inner in itertools.combinations(range(1, last), LENGTH - 2)]
_UNIT = float(np.sqrt(sum(DECAY ** (2 * (way[-1] - LENGTH + 1)) for way in WAYS)))
_TAIL = np.zeros(SPAN, np.uint8)


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.fromiter((BLANK if chr(i).isspace() else OTHER + i % 3 if chr(i).isalnum() else LEFT_OUT for i in range(0x110000)), np.uint8, 0x110000)
    out[97:123] = np.arange(1, 27)
    out[48:58] = DIGIT
    out[10] = END
    out[[33, 46, 63]] = STOP
    return out


def codes(text: str) -> np.ndarray:
    """The character classes of a text: every sentence between blanks, and SPAN ends between sentences, so that no subsequence without an end in it reaches from one into another."""
    c = _classes()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    stops = np.flatnonzero(c == STOP)
    c[stops] = np.where(np.isin(np.append(c, END)[stops + 1], (END, BLANK, STOP)), END, LEFT_OUT)
    c = np.concatenate([[END], c[c != LEFT_OUT], [END]]).astype(np.uint8)
    gap = (c == BLANK) | (c == END)
    first = np.flatnonzero(gap & ~np.append(False, gap[:-1]))
    c[first] = np.where(np.maximum.reduceat(c == END, first), END, BLANK)  # of a row of blanks and ends one stays
    keep = ~gap
    keep[first] = True
    c = c[keep]
    gap = (c == BLANK) | (c == END)
    alone = np.zeros(len(c) + 2, bool)
    alone[2:-2] = ~gap[1:-1] & gap[:-2] & gap[2:]
    c = c[~((c == BLANK) & alone[:-2] & alone[2:])]  # letters spelled out
    times = np.where(c == END, SPAN + 2, 1)
    out = np.repeat(c, times)
    after = np.cumsum(times)[c == END]
    out[after - 1] = out[after - SPAN - 2] = BLANK
    return out


def sentences(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the sentences of codes, long ones as windows."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], c != END, [False]]).view(np.int8)))
    a, b = edge[::2], edge[1::2]
    a, b = a[b - a > 2], b[b - a > 2]  # more than the blanks around it
    n = 1 + -(-np.maximum(0, b - a - WINDOW) // STEP)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(a, n) + place * STEP
    return starts, np.minimum(starts + WINDOW, np.repeat(b, n))


def norms(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _UNIT * np.sqrt(np.maximum(ends - starts, SHORTEST))


def subsequences(c: np.ndarray, n: int):
    """For each way to skip: feature ids by start, for the first n starts, the last character's place, and the weight."""
    x = np.concatenate([c[: n + SPAN], _TAIL]).astype(np.uint32)
    # the hash of five classes of five bits is a sum over them
    h = [x * np.uint32((0x9E3779B1 << 5 * (LENGTH - 1 - j)) & 0xFFFFFFFF) for j in range(LENGTH)]
    so_far = {(): h[0][:n]}
    for way in WAYS:
        for j in range(1, LENGTH):
            if way[:j] not in so_far:
                so_far[way[:j]] = so_far[way[: j - 1]] + h[j][way[j - 1] : way[j - 1] + n]
        yield (so_far.pop(way) >> np.uint32(32 - BITS)).view(np.int32), way[-1], np.float32(DECAY ** (way[-1] - LENGTH + 1))


def inside(c: np.ndarray, n: int) -> np.ndarray:
    """1 where a sentence is, 0 at its end; SPAN more than n."""
    return (np.concatenate([c[: n + SPAN], _TAIL])[: n + SPAN] != END).astype(np.float32)


def margins(c: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Margins of the sentences of codes (ascending starts), by the table over subsequences; in blocks that stay in the processor's cache."""
    out = np.empty(len(starts), np.float32)
    first = np.searchsorted(starts, np.arange(0, len(c) + BLOCK, BLOCK))
    for i, (lo, hi) in enumerate(itertools.pairwise(first)):
        if lo < hi:
            at = i * BLOCK
            n = int(ends[hi - 1]) - at
            sums, block = np.zeros(n + 1), c[at : at + n + SPAN]
            whole, by_last = inside(block, n), {}
            for ids, last, w in subsequences(block, n):
                got = weights.take(ids)
                got *= w
                by_last[last] = by_last[last] + got if last in by_last else got
            for last, got in by_last.items():  # a subsequence with a sentence end in it counts nothing
                sums[1:] += got * whole[last : last + n]
            np.cumsum(sums, out=sums)
            s, e = starts[lo:hi] - at, ends[lo:hi] - at
            out[lo:hi] = (sums[e] - sums[s]) / norms(s, e) + bias
    return out


def features(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, feature, value) of all subsequences that start in the sentences of codes."""
    n = ends - starts
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    wide = int(n.max(initial=0)) + SPAN
    near = np.concatenate([c, np.zeros(wide, np.uint8)])[starts[:, None] + np.arange(wide)]
    flat = np.repeat(np.arange(len(n)) * wide, n) + place
    unit = (1 / norms(starts, ends)).astype(np.float32)[owner]
    whole = inside(near.ravel(), near.size)
    parts = [(owner, ids[flat], whole[flat + last] * w * unit) for ids, last, w in subsequences(near.ravel(), near.size)]
    sentence, feature, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    return sentence[value > 0], feature[value > 0], value[value > 0]


def kernel(some: tuple, landmarks: tuple, n_some: int, n_landmarks: int) -> np.ndarray:
    """(n_some, n_landmarks) kernel values of sentences, given their features."""
    sentence, feature, value = some
    order = np.argsort(landmarks[1], kind="stable")
    mark, own, weight = (x[order] for x in landmarks)
    known, first, count = np.unique(own, return_index=True, return_counts=True)
    at = np.minimum(np.searchsorted(known, feature), len(known) - 1)
    hits = np.flatnonzero(known[at] == feature)
    out = np.zeros(n_some * n_landmarks, np.float32)
    pairs = np.cumsum(count[at[hits]])
    cuts = np.searchsorted(pairs, np.arange(PAIRS, int(pairs[-1]) if len(pairs) else 0, PAIRS))
    for part in np.split(hits, cuts):  # about PAIRS at a time
        times = count[at[part]]
        of = np.repeat(part, times)
        k = np.repeat(first[at[part]] - np.cumsum(times) + times, times) + np.arange(len(of))
        np.add.at(out, sentence[of] * np.int64(n_landmarks) + mark[k], value[of] * weight[k])
    return out.reshape(n_some, n_landmarks)


@dataclass
class Machine:
    """The table over subsequences (its entries that aren't 0), and the logistic curve over the numbers of a document."""

    ids: np.ndarray
    values: np.ndarray
    bias: float
    curve: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0, 0.0]))

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.ids] = self.values
        return out

    def score(self, text: str | None, weights: np.ndarray) -> float:
        """0 to 1; weights is table()."""
        best, total, n, text = LOWEST, 0.0, 0, text or ""
        for at in range(0, max(1, len(text) - OVERLAP), PIECE):
            c = codes(text[at : at + PIECE + OVERLAP])
            starts, ends = sentences(c)
            if len(starts):
                m = margins(c, starts, ends, weights, self.bias)
                best, total, n = max(best, float(m.max())), total + float(np.maximum(m, 0).sum()), n + len(m)
        return float(logistic(np.array([[best, np.log1p(total), np.log1p(n), 1.0]]), self.curve)[0])


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


@dataclass
class Sample:
    """The codes of labelled documents in a row, and their sentences."""

    c: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    toxic: np.ndarray

    @classmethod
    def of(cls, docs: list[tuple[str, int]]) -> Sample:
        parts, at, starts, ends, owner = [_TAIL], SPAN, [], [], []
        for i, (text, _) in enumerate(docs):
            c = codes(text)
            s, e = sentences(c)
            parts.append(c)
            starts.append((s + at).astype(np.int32))
            ends.append((e + at).astype(np.int32))
            owner.append(np.full(len(s), i, np.int32))
            at += len(c)
        return cls(np.concatenate(parts), np.concatenate(starts), np.concatenate(ends), np.concatenate(owner), np.array([t for _, t in docs], np.int64))

    def best(self, value: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Of the sentences of (ascending), each document's with the highest value."""
        groups = np.split(of, np.flatnonzero(np.diff(self.owner[of])) + 1)
        return np.array([g[np.argmax(value[g])] for g in groups if len(g)], np.int64)

    def apart(self, some: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """The n highest of some sentences, without those that lie where a higher one does."""
        if len(some) > WINDOW * n:  # at most WINDOW sentences start in one place
            some = some[np.argpartition(-value[some], WINDOW * n)[: WINDOW * n]]
        some = some[np.lexsort((some, -value[some]))]
        kept = np.sort(np.unique(self.starts[some] // WINDOW, return_index=True)[1])
        return some[kept][:n]

    def evidence(self) -> np.ndarray:
        """By sentence: how much likelier the counts of its most telling LENGTH characters in a row are with a rate of their own in toxic documents than with the common one; 0 if they are rarer there."""
        share = self.toxic.mean()
        first = np.searchsorted(self.owner, np.arange(len(self.toxic) + 1))
        k, m = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)

        def row(lo: int, hi: int) -> np.ndarray:
            """The LENGTH characters in a row at each start of a document; -1 if a sentence ends in them."""
            a, b = (int(self.starts[lo]), int(self.ends[hi - 1])) if lo < hi else (0, 0)
            ids, last, _ = next(subsequences(self.c[a:b], b - a))
            return np.where(inside(self.c[a:b], b - a)[last:][: b - a] > 0, ids, -1)

        for t, lo, hi in zip(self.toxic, first, first[1:], strict=False):
            ids = np.unique(row(lo, hi))
            (k if t else m)[ids[ids >= 0]] += 1
        told = np.flatnonzero(k > share * (k + m))
        a, b = k[told].astype(float), m[told].astype(float)
        ratio = np.zeros((1 << BITS) + 1, np.float32)  # the last is that of no row
        ratio[told] = a * np.log(a / (a + b) / share) + b * np.log(np.maximum(b, 1) / (a + b) / (1 - share))
        out = np.zeros(len(self.starts), np.float32)
        for lo, hi in itertools.pairwise(first):
            if lo < hi:
                value = np.append(ratio[row(lo, hi)], np.zeros(WINDOW, np.float32))
                s, n = self.starts[lo:hi] - self.starts[lo], (self.ends - self.starts)[lo:hi]
                for j in range(WINDOW - LENGTH + 1):
                    out[lo:hi] = np.maximum(out[lo:hi], np.where(j + LENGTH <= n, value[s + j], 0))
        return out


def torn(c: np.ndarray, starts: np.ndarray, ends: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, ends) of copies of sentences with a letter inserted or a character doubled."""
    parts, s, e, at = [_TAIL], [], [], SPAN
    for a, b in zip(starts, ends, strict=True):
        for _ in range(TORN):
            k = a + int(rng.integers(1, b - a))
            new = rng.integers(1, 27) if rng.random() < 0.7 or c[k - 1] == BLANK else c[k - 1]
            parts += [c[a:k], np.array([new], np.uint8), c[k : b + SPAN - 1], _TAIL]
            s.append(at)
            e.append(at + b - a + 1)
            at += sum(map(len, parts[-4:]))
    return np.concatenate(parts), np.array(s, np.int64), np.array(e, np.int64)


def fit_margins(some: tuple, y: np.ndarray, landmarks: tuple, n_landmarks: int) -> tuple[np.ndarray, float]:
    """(weights over features, bias) of the machine for the features of sentences with labels y (1 toxic, -1 clean) and those of landmarks: squared hinge loss."""
    own = kernel(landmarks, landmarks, n_landmarks, n_landmarks).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = np.hstack([kernel(some, landmarks, len(y), n_landmarks) @ root.astype(np.float32), np.ones((len(y), 1), np.float32)])
    c = np.where(y > 0, TOXIC_SHARE / max(1, (y > 0).sum()), (1 - TOXIC_SHARE) / max(1, (y < 0).sum()))
    w, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, RIDGE), 1e-8]
    for _ in range(30):  # Newton steps on the rows within the margin
        inside = y * (x @ w.astype(np.float32)) < 1
        xi, ci = x[inside], c[inside]
        left = xi.T @ (ci * y[inside]).astype(np.float32)
        weighed = xi * np.sqrt(ci).astype(np.float32)[:, None]
        del xi
        new = np.linalg.solve((weighed.T @ weighed).astype(float) + np.diag(ridge), left.astype(float))
        del weighed
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    del x
    by_landmark = root @ w[:-1]
    weights = np.zeros(1 << BITS, np.float32)
    np.add.at(weights, landmarks[1], (by_landmark[landmarks[0]] * landmarks[2]).astype(np.float32))
    return weights, float(w[-1])


def fit_sentences(d: Sample, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """(weights, bias) from labelled documents, in rounds."""
    top, of_toxic = d.evidence(), d.toxic[d.owner] == 1
    in_toxic, in_clean = np.flatnonzero(of_toxic), np.flatnonzero(~of_toxic)
    witness = d.best(top, in_toxic)
    witness = witness[top[witness] >= LEAST_EVIDENCE] if (top[witness] >= LEAST_EVIDENCE).any() else witness  # a document without a telling sentence may be labelled in error
    marked = d.apart(in_toxic[top[in_toxic] >= LEAST_EVIDENCE], top, 4 * TOXIC_SENTENCES)
    base, hard = rng.permutation(in_clean)[:CLEAN_SENTENCES], np.empty(0, np.int64)
    for step in range(ROUNDS):
        toxic = rng.permutation(np.unique(np.concatenate([witness, marked])))[:TOXIC_SENTENCES]
        clean = np.unique(np.concatenate([base, hard]))
        land = np.array(list(dict.fromkeys([*toxic[: LANDMARKS // 2], *hard[: LANDMARKS // 4], *base[: LANDMARKS // 2]]))[:LANDMARKS])
        parts = [(d.c, d.starts[toxic], d.ends[toxic]), (d.c, d.starts[clean], d.ends[clean]), torn(d.c, d.starts[toxic], d.ends[toxic], rng)]
        n = [len(s) for _, s, _ in parts]
        found = [features(*x) for x in parts]
        some = np.concatenate([f[0] + np.int32(sum(n[:i])) for i, f in enumerate(found)]), *(np.concatenate([f[j] for f in found]) for j in (1, 2))
        del found
        weights, bias = fit_margins(some, np.repeat([1.0, -1.0, 1.0], n), features(d.c, d.starts[land], d.ends[land]), len(land))
        del some
        if step == ROUNDS - 1:
            break
        m = margins(d.c, d.starts, d.ends, weights, bias)
        # a clean sentence with a telling row of characters is in a document that may be labelled in error
        hard = d.apart(in_clean[(top[in_clean] < LEAST_EVIDENCE) & (m[in_clean] > -1)], m, HARD_SENTENCES)
        own = d.best(m, in_toxic)
        own = own[(m[own] > 0) & (top[own] > LEAST_EVIDENCE / 2)]
        witness = own if len(own) else witness
    return weights, bias


def distinct_enough(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Documents without the near copies, whose sentences would look telling only for being copied: of those that share their least-hashed word, one that shares over half of both's words with an earlier one goes. Documents without words go."""
    kept: dict[int, list[np.ndarray]] = {}
    out = []
    for text, toxic in sample:
        own = np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in text.lower().split()), np.uint32))
        if len(own) and _has_sentence(text):
            others = kept.setdefault(int(own[0]), [])
            both = (len(np.intersect1d(own, x, assume_unique=True)) for x in others)
            if all(3 * n <= len(own) + len(x) for n, x in zip(both, others, strict=True)):
                others.append(own)
                out.append((text, toxic))
    return out


def _has_sentence(text: str) -> bool:
    return len(sentences(codes(text))[0]) > 0


def learn(sample: list[tuple[str, int]], counts: dict[int, int] | None = None, seed: int = SEED) -> Machine | None:
    """The machine for labelled documents; None unless both labels occur. counts: how many documents have each label where the sample was drawn, as the sample may hold one label more often. With fewer than FOLDS documents of a label the curve is fitted to the margins that the machine itself learned from."""
    rng = np.random.default_rng(seed)
    sample = distinct_enough(sample)
    toxic = np.array([t for _, t in sample], np.int64)
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    if not n1 or not n0:
        return None
    weights, bias = fit_sentences(Sample.of(sample), rng)
    ids = np.flatnonzero(weights)
    machine = Machine(ids.astype(np.int32), weights[ids], bias)
    part = np.zeros(len(sample), np.int64)
    for t in (0, 1):  # both labels in every part
        of = np.flatnonzero(toxic == t)
        part[rng.permutation(of)] = np.arange(len(of)) % FOLDS
    x = np.ones((len(sample), 4))
    for j in range(FOLDS):
        out = np.flatnonzero(part == j)
        if min(n0, n1) >= FOLDS:
            weights, bias = fit_sentences(Sample.of([s for s, k in zip(sample, part, strict=True) if k != j]), rng)
        d = Sample.of([sample[i] for i in out]) if len(out) else None
        if d is not None:
            m = margins(d.c, d.starts, d.ends, weights, bias)
            best, total = np.full(len(out), LOWEST), np.zeros(len(out))
            np.maximum.at(best, d.owner, m)
            np.add.at(total, d.owner, np.maximum(m, 0))
            x[out, :3] = np.c_[best, np.log1p(total), np.log1p(np.bincount(d.owner, minlength=len(out)))]
    target = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    counts = counts or {0: n0, 1: n1}
    each = np.where(toxic == 1, counts[1] / n1, counts[0] / n0)
    each *= len(sample) / each.sum()
    w = machine.curve
    for _ in range(50):
        p = logistic(x, w)
        w = w + np.linalg.solve((x * (each * p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(4), x.T @ (each * (target - p)) - 1e-3 * w)
    machine.curve = np.r_[np.maximum(w[:2], [1e-3, 0.0]), w[2:]]  # never lower for a higher margin
    return machine


def fit(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Machine | None:
    """A machine for the labelled rows that aren't held out."""
    told = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if set(counts) != {0, 1}:
        return None
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    told = told.where(drawn < F.when(F.col("toxic") == 1, toxic_docs / counts[1]).otherwise(clean_docs / counts[0]))
    bound = 2 * (toxic_docs + clean_docs)
    short = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS)
    told = F.broadcast(told.limit(bound))  # bounded by the parameters
    sample = short.join(told, "doc_id").select("doc_id", "text", "toxic").limit(bound)
    return learned(sample, lambda rows: learn([(text, toxic) for _, text, toxic in sorted(rows)], counts))


def scored(docs: DataFrame, machine: Machine | None, also: list[str] | None = None) -> DataFrame:
    """(doc_id, score) and the columns also asked for, of every row."""
    also = also or []
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), *(docs.schema[c] for c in also)])

    def run(batches):
        weights = None if machine is None else machine.table()
        for batch in batches:
            out = [0.0 if machine is None else machine.score(text.as_py(), weights) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), *(batch.column(2 + i) for i in range(len(also)))], names=["doc_id", "score", *also])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("_text"), *also).mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't found toxic, with the columns that came in."""
    found = scored(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_in")), fit(docs, labels), ["_in"])
    return found.where(F.col("score") < THRESHOLD).select("_in.*")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
