"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of WINDOW bytes; a window is a sequence that the network reads in both directions. From
the two states at a position it gives a probability for each language there, so every byte of every text is labelled. A
document's probabilities are the means over its letter positions (ASCII letters and bytes of longer characters).

The network is trained here, in numpy, by backpropagation through time with Adam, on windows of a bounded sample of labelled
documents: about SAMPLE_DOCS documents a language, chosen by hash, WINDOWS_EACH windows of each. Rows that are held out never
enter the sample. The same rows and seed give the same network.

Defined cases: null text, and text without a letter, is "und" with score 1. With no labelled rows there is nothing to learn, and every row is "und" with score 0.
Repeated rows are scored each. A null doc_id isn't held out. Equal probabilities go to the first language by name. An empty
table gives no rows. Only id, text and lang are read, so clashing names do no harm.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citemill.llm.common import held_out, table

HIDDEN, WINDOW = 8, 128
#: Windows that go through the network side by side.
SIDE = 2048
#: Languages that are learned at most.
MAX_LANGS = 200
SAMPLE_DOCS, WINDOWS_EACH = 600, 4
STEPS, BATCH, RATE, SEED = 260, 192, 0.02, 7
UNKNOWN = "und"
#: The pipeline rejects documents whose pooled probability is below this part of the way from chance (1 of the languages) to 1.
LEAST_SCORE = 0.3

_LETTER = re.compile(r"[^\W\d_]")
_LETTER_BYTE = np.zeros(256, np.float32)
_LETTER_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


@dataclass
class Network:
    """Weights by direction (0 forward, 1 backward): inputs (3H, 256), recurrent (3H, H), output (K, H); gates in the order update, reset, candidate."""

    langs: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    output: list[np.ndarray]
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, *self.output, self.bias]


def new_network(langs: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    return Network(
        langs, [draw(3 * hidden, 256, by=0.3) for _ in range(2)], [draw(3 * hidden, hidden, by=hidden**-0.5) for _ in range(2)],
        [draw(len(langs), hidden, by=0.3) for _ in range(2)], np.zeros((len(langs), 1), np.float32),
    )


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """(windows, size): the bytes of a text, the last window filled up with zeros, which are no letters."""
    n = -(-len(data) // size)
    return np.frombuffer(data.ljust(n * size, b"\0"), np.uint8).reshape(n, size)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def position_probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """(size, K, n) probabilities at every position of the windows x (n, size)."""
    n, size = x.shape
    steps = np.ascontiguousarray(x.T).astype(np.intp)
    hidden = net.recurrent[0].shape[1]
    logits = np.empty((size, len(net.langs), n), np.float32)
    # half the gates' arguments, so that a sigmoid is one tanh
    half = np.ones((3 * hidden, 1), np.float32)
    half[: 2 * hidden] = 0.5
    a = np.empty((3 * hidden, n), np.float32)
    m = np.empty_like(a)
    for way in (0, 1):
        inputs, recurrent, output = net.inputs[way] * half, net.recurrent[way] * half, net.output[way]
        h = np.zeros((hidden, n), np.float32)
        gates, c, q = a[: 2 * hidden], a[2 * hidden :], m[2 * hidden :]
        z, r = a[:hidden], a[hidden : 2 * hidden]
        for t in range(size) if way == 0 else range(size - 1, -1, -1):
            np.take(inputs, steps[t], axis=1, out=a, mode="clip")
            np.matmul(recurrent, h, out=m)
            gates += m[: 2 * hidden]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            q *= r
            c += q
            np.tanh(c, out=c)
            c -= h
            c *= z
            h += c
            if way == 0:
                np.matmul(output, h, out=logits[t])
            else:
                logits[t] += output @ h
    logits += net.bias
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def pooled(net: Network, texts: list[str]) -> np.ndarray:
    """(texts, K): mean probabilities over letter positions; the texts must have letters."""
    cut = [windows(t.encode("utf-8", "surrogatepass")) for t in texts]
    owner = np.repeat(np.arange(len(cut)), [len(w) for w in cut])
    out, weight = np.zeros((len(texts), len(net.langs))), np.zeros(len(texts))
    at = 0
    group: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal group, held, at
        x = np.concatenate(group)
        letters = _LETTER_BYTE[x]
        p = np.einsum("tkn,nt->nk", position_probabilities(net, x), letters)
        own = owner[at : at + len(x)]
        np.add.at(out, own, p)
        np.add.at(weight, own, letters.sum(1))
        at += len(x)
        group, held = [], 0

    for w in cut:
        for i in range(0, len(w), SIDE):
            part = w[i : i + SIDE]
            while len(part):
                take = part[: SIDE - held]
                group.append(take)
                held += len(take)
                part = part[len(take) :]
                if held == SIDE:
                    flush()
    if held:
        flush()
    return out / np.maximum(weight, 1)[:, None]


def loss_and_gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Cross-entropy over the letter positions of windows x (n, size) with languages y (n), and its gradients, by backpropagation through time."""
    n, size = x.shape
    steps, hidden = x.T.astype(np.intp), net.recurrent[0].shape[1]
    weight = _LETTER_BYTE[x].T.astype(net.bias.dtype)
    weight /= max(1.0, weight.sum())
    tape: list[list[tuple]] = [[], []]
    logits = np.zeros((size, len(net.langs), n), net.bias.dtype) + net.bias
    for way in (0, 1):
        h = np.zeros((hidden, n), net.bias.dtype)
        for t in range(size) if way == 0 else range(size - 1, -1, -1):
            a, m = net.inputs[way][:, steps[t]], net.recurrent[way] @ h
            z, r = _sigmoid(a[:hidden] + m[:hidden]), _sigmoid(a[hidden : 2 * hidden] + m[hidden : 2 * hidden])
            c = np.tanh(a[2 * hidden :] + r * m[2 * hidden :])
            new = h + z * (c - h)
            tape[way].append((t, h, z, r, m[2 * hidden :], c, new))
            logits[t] += net.output[way] @ new
            h = new
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    columns = np.arange(n)
    loss = -float((np.log(np.maximum(p[:, y, columns], 1e-12)) * weight).sum())
    d_logits = p
    d_logits[:, y, columns] -= 1
    d_logits *= weight[:, None, :]
    d_inputs, d_recurrent, d_output = [np.zeros_like(w) for w in net.inputs], [np.zeros_like(w) for w in net.recurrent], [np.zeros_like(w) for w in net.output]
    for way in (0, 1):
        dh = np.zeros((hidden, n), net.bias.dtype)
        all_a = np.empty((size, 3 * hidden, n), net.bias.dtype)
        for t, h, z, r, q, c, new in reversed(tape[way]):
            d_output[way] += d_logits[t] @ new.T
            dh = dh + net.output[way].T @ d_logits[t]
            d_c = dh * z * (1 - c * c)
            d_z, d_r = dh * (c - h) * z * (1 - z), d_c * q * r * (1 - r)
            d_m = np.concatenate([d_z, d_r, d_c * r])
            all_a[t] = np.concatenate([d_z, d_r, d_c])
            d_recurrent[way] += d_m @ h.T
            dh = dh * (1 - z) + net.recurrent[way].T @ d_m
        flat, which = all_a.transpose(1, 0, 2).reshape(3 * hidden, -1), steps.ravel()
        for g in range(3 * hidden):
            d_inputs[way][g] = np.bincount(which, flat[g], 256)
    return loss, [*d_inputs, *d_recurrent, *d_output, d_logits.sum((0, 2))[:, None]]


def train(langs: list[str], x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Network:
    """A network fitted to windows x (n, size) of languages y (n) by Adam; each batch draws the languages evenly."""
    net, rng = new_network(langs, seed=seed), np.random.default_rng(seed)
    by_lang = [np.flatnonzero(y == k) for k in range(len(langs))]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    for step in range(1, steps + 1):
        which = np.concatenate([rng.choice(own, max(1, batch // len(langs))) for own in by_lang])
        _, gradients = loss_and_gradients(net, x[which], y[which])
        now = rate * min(1.0, step / 20) * (1 - step / (steps + 1)) ** 0.5
        for w, g, (first, second) in zip(net.weights(), gradients, moments, strict=True):
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            w -= now * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
    return net


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, max_langs: int = MAX_LANGS, **how) -> Network | None:
    """A network for the languages of the labelled rows that aren't held out; None without such rows. The sample is bounded by sample_docs (twice that at most) a language and by max_langs languages, those with the most rows (between equals the first by name); a rarer one isn't learned."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    known = rows.where(F.length("text") > 0)
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return None
    share = F.try_element_at(F.create_map(*(F.lit(v) for s, n in counts.items() for v in (s, float(sample_docs / n)))), F.col("lang"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    length = F.length("text")
    starts = [F.when(length > WINDOW, F.pmod(F.xxhash64("doc_id", F.lit(i)), length - WINDOW)).otherwise(0).cast("int") for i in range(WINDOWS_EACH)]
    parts = F.array(*(F.substring("text", s + 1, F.lit(WINDOW)) for s in starts))
    sample = known.where(drawn < share).select("doc_id", "lang", F.array_distinct(parts).alias("parts")).limit(2 * sample_docs * len(counts)).collect()
    sample.sort(key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["parts"]))
    langs = sorted({r["lang"] for r in sample})
    if not langs:
        return None
    pairs = [(windows(p.encode("utf-8", "surrogatepass"))[:1], langs.index(r["lang"])) for r in sample for p in r["parts"] if p]
    return train(langs, np.concatenate([w for w, _ in pairs]), np.array([k for _, k in pairs]), **how)


def identified(docs: DataFrame, net: Network | None, also: list[str] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) and the columns also asked for, of every row."""
    also = also or []
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *(docs.schema[c] for c in also)])

    def label(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            name, score = [UNKNOWN] * len(texts), [1.0] * len(texts)
            lettered = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
            if lettered and net is None:
                for i in lettered:
                    score[i] = 0.0
            elif lettered:
                p = pooled(net, [texts[i] for i in lettered])
                for i, row in zip(lettered, p, strict=True):
                    name[i], score[i] = net.langs[int(row.argmax())], float(min(1.0, row.max()))
            columns = [batch.column(0), pa.array(name, pa.string()), pa.array(score, pa.float64()), *(batch.column(2 + i) for i in range(len(also)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", *also])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("_text"), *also).mapInArrow(label, schema)


def least_score(net: Network) -> float:
    """The pooled probability from which a document is accepted; with one language there is nothing to tell apart."""
    chance = 1 / len(net.langs)
    return chance + LEAST_SCORE * (1 - chance) if len(net.langs) > 1 else 0.0


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language the network is sure enough of, with the columns that came in. Without a network, all that have a letter."""
    net = fit(docs)
    found = identified(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_in")), net, ["_in"])
    sure = F.col("score") == 0 if net is None else (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score(net))
    return found.where(sure).select("_in.*")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identified(docs, fit(docs)).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score")
