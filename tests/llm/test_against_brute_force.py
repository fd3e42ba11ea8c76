"""The operators over whole small tables, against plain restatements."""

import hashlib
import random
import zlib

import numpy as np

from citemill.llm import chat_format, common, fingerprints, language_id, mixing, near_dedup, packing, quality_rules, token_counts, toxicity, url_filters
from tests.llm import brute
from tests.llm.conftest import SF


def test_near_duplicates(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rng = random.Random(5)
    seed = [t for _, t in rows if len(t.split()) > 60][0].split()[:120]
    for i in range(60):  # copies that drift apart, so that links form chains and stars
        w = list(seed)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(1000)}"
        rows.append((10_000 + i, " ".join(w[: rng.randrange(100, 121)])))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute.near_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(brute.shingles(t)) for i, t in rows}


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(1000, 1400))


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100, 5000):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        k = near_dedup.sketch(s)
        assert len(k) == near_dedup.T and (k != np.iinfo(np.uint64).max).all()
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1500], rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
    assert abs((near_dedup.sketch(a) == near_dedup.sketch(b)).mean() - 0.6) < 0.2


def test_word_hashes_in_chunks(monkeypatch):
    monkeypatch.setattr(near_dedup, "_CHUNK", 32)
    near_dedup._tables.cache_clear()
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("abAB \n,") for _ in range(rng.randrange(200)))
        w = brute.WORD.findall(brute.ascii_lower(t))
        h = near_dedup.word_hashes(t.encode()).tolist()
        assert len(h) == len(w) and len(set(zip(w, h, strict=True))) == len(set(w)) == len(set(h))
    monkeypatch.undo()
    near_dedup._tables.cache_clear()


def test_fingerprints(spark, docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(rows)
    got = {r["doc_id"]: r for r in fingerprints.op4_fingerprints(spark, SF).collect()}
    assert sorted(got) == ids
    errors = []
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        text, half = rows[i], len(rows[i]) // 2
        edited = text[: len(text) - half] + rows[after][:half]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (brute.shingles(t, lower=False) for t in (text, edited, rows[after]))
        for near, other in (("near_edited", b), ("near_next", c)):
            errors.append(abs(got[i][near] - (len(a & other) / len(a | other) if a | other else 1.0)))
    assert np.mean(errors) < 0.02 and max(errors) < 0.25
    same = {}
    for i in ids:
        assert same.setdefault(rows[i], got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_sketches_merge(spark, docs):
    d = fingerprints.with_sketch(docs, "text", "sketch", k=16)
    merged = {r["source"]: r["sketch"] for r in fingerprints.merge_all(d, ["source"], k=16).collect()}
    for source, some in {s: [r["sketch"] for r in d.collect() if r["source"] == s] for s in merged}.items():
        assert merged[source] == sorted({h for x in some for h in x})[:16]


def test_quality_counts(spark, docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality_rules.op6_quality_rules(spark, SF).collect():
        t = rows[r["doc_id"]]
        w = brute.WORD.findall(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        counts = {x: windows.count(x) for x in set(windows)} if len(windows) < 400 else None
        lines = [x for x in t.split("\n") if brute.WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        if counts is not None:
            assert r["n_repeat_words"] == len({j for i, x in enumerate(windows) if counts[x] > 1 for j in (i, i + 1, i + 2)})
        assert r["base_failed"] == (len(w) < 50 or 100 * r["n_repeat_words"] > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_expectation_maximisation_finds_the_noisy_rule():
    rng = random.Random(0)
    patterns = {}
    for _ in range(20_000):
        good = rng.random() < 0.7
        votes = tuple((1 if good == (rng.random() < p) else -1) for p in (0.95, 0.9, 0.6))
        patterns[votes] = patterns.get(votes, 0) + 1
    share, told, _ = quality_rules.estimate(sorted(patterns.items()), rounds=200)
    assert abs(share - 0.7) < 0.06 and told[0][True][1] > told[1][True][1] - 0.02 > told[2][True][1] + 0.1


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "<\\|", "<", "|", "\\", "\n", "user", "<n", " ok"]
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb", "<n", "x<|"]), "".join(rng.choices(bits, k=rng.randrange(8)))) for c in range(80) for t in range(rng.randrange(1, 6))]
    got = chat_format.read_back(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((role, text))
    for r in got:
        assert [(x["role"], x["text"]) for x in r["turns"]] == want[r["conv_id"]]
        assert r["loss_text"] == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")


def test_pfair_schedule_stays_within_a_block():
    weights = {"a": 517, "b": 300, "c": 111, "d": 7, None: 1}
    places, d = mixing.period(weights), sum(weights.values())
    assert sorted(p for own in places.values() for p in own) == list(range(d))
    for s, w in weights.items():
        have = np.zeros(d + 1)
        have[np.array(places[s]) + 1] = 1
        assert (np.abs(np.cumsum(have) - w * np.arange(d + 1) / d) < 1).all()


def test_mixing_places_every_row_once(spark, docs):
    got = mixing.op2_mixing(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs.collect())
    assert len({r["position"] for r in got}) == len(got)
    assert len({(r["slot"], r["source"]) for r in got}) == len({r["slot"] for r in got})
    small = mixing.mix(docs.select("doc_id", "source"), block_docs=2, resolution=50).collect()
    slots = {r["_slot"]: r["_source"] for r in small}
    assert sorted(slots) == list(range(len(slots)))
    first = sorted(s for s in slots if any(r["_slot"] == s and r["_phase"] == 0 for r in small))
    total = mixing.whole_weights(mixing.tempered({s: sum(r["_source"] == s for r in small) for s in set(slots.values())}), 50)
    for s, w in total.items():
        have = 0
        for t in first:
            have += slots[t] == s
            assert abs(have - w * (t + 1) / sum(total.values())) < 1


def test_packing(spark, docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = packing.op8_packing(spark, SF).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for r in docs.collect():
        ids = np.array(t.encode(r["text"], add_special_tokens=False).ids + [2], "<u4")
        total += len(ids)
        at = 0
        for k, p in enumerate(sorted(by_doc[r["doc_id"]], key=lambda p: p["piece"])):
            assert p["piece"] == k and p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            assert k == 0 or p["length"] == 1024
            at += p["length"]
        assert at == len(ids)
    for parts in by_seq.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(by_seq) <= 1.02 * -(-total // 1024) + 1


def test_best_fit_on_runs_is_best_fit():
    rng = random.Random(4)
    lengths = [rng.randrange(1, 65) for _ in range(800)]
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(64 - n)
    plan = packing.best_fit({n: lengths.count(n) for n in set(lengths)}, 64)
    used = {first + (r - a) // fit for _, a, b, first, _, fit in plan for r in range(a, b)}
    assert len(used) == len(gaps)


def test_token_counts(spark, docs):
    from citemill.llm.tokens import encode

    lengths = [len(encode(r["text"])) for r in docs.collect()]
    got = token_counts.op3_token_counts(spark, SF)
    rows = {r["length"]: r for r in got.collect()}
    assert {n: r["n_docs"] for n, r in rows.items()} == {n: lengths.count(n) for n in set(lengths)}
    for n, r in rows.items():
        assert r["truncated_total"] == sum(min(x, n) for x in lengths) and r["docs_longer"] == sum(x > n for x in lengths) and r["total_tokens"] == sum(lengths)
        assert r["total_tokens_at_most"] == sum(x for x in lengths if x <= n)
    for limit in (0, 3, 100, 777, 10**6):
        assert token_counts.truncated_total(got, limit).first()["tokens"] == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile(got, 0.5).first()["length"] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]


def test_bloom_filter_lets_all_entries_through(spark):
    listed = spark.range(5000).selectExpr("concat('u', id) AS u")
    n = url_filters.blocks_for(5000)
    blocks = url_filters.bloom(listed, "u", n)
    assert url_filters.possible_hits(listed, "u", blocks, n).count() == 5000
    others = spark.range(20_000).selectExpr("concat('v', id) AS u")
    assert url_filters.possible_hits(others, "u", blocks, n).count() < 400


def test_gradients_of_the_network():
    net = language_id.new_network(["a", "b", "c"], hidden=3)
    for k in ("inputs", "recurrent", "output"):
        setattr(net, k, [w.astype(np.float64) for w in getattr(net, k)])
    net.bias = net.bias.astype(np.float64)
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 110, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, gradients = language_id.loss_and_gradients(net, x, y)
    for w, g in zip(net.weights(), gradients, strict=True):
        for _ in range(10):
            i = tuple(int(rng.integers(0, s)) for s in w.shape)
            old, losses = w[i], []
            for e in (1e-5, -1e-5):
                w[i] = old + e
                losses.append(language_id.loss_and_gradients(net, x, y)[0])
            w[i] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - g[i]) < 1e-7


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = language_id.op10_language_id(spark, sf).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in toxicity.op1_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in toxic]
    right = np.array([r["predicted"] == toxic[r["doc_id"]] for r in got])
    label = np.array([toxic[r["doc_id"]] for r in got])
    assert right[label == 1].mean() > 0.93 and right[label == 0].mean() > 0.98


def test_held_out_rule(spark):
    got = spark.range(500).select("id", common.held_out(common.F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)
