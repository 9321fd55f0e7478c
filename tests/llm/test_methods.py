"""Each method against a brute-force version."""

import base64
import math
import random
import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from ledgerloom.llm import decontaminate, fingerprints, linededup, mixing, neardup, sharding, textarrays as ta, tokenbin, tokencount, toxicity, webtext

from . import fixtures as fx

SMALL = Path("/root/testdata/sf0.001")


def word_list(text):
    out, word = [], ""
    for c in (text or "").lower():
        if c.isascii() and not (c.isalnum() or c == "_"):
            out, word = ([*out, word] if word else out), ""
        else:
            word += c
    return [*out, word] if word else out


def shingle_set(text, k):
    w = word_list(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def changed(text, share, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(fx.WORDS) if rng.random() < share else w for w in text.split(" "))


# words and shingles


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab _-.é日\n", max_size=30)), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_and_shingles(texts):
    hashes, counts = ta.words(pa.array(texts, pa.string()))
    assert counts.tolist() == [len(word_list(t)) for t in texts]
    named, at = {}, 0
    for t in texts:
        for w in word_list(t):
            assert named.setdefault(w, hashes[at]) == hashes[at]
            at += 1
    assert len(set(named.values())) == len(named)
    shingles, n = ta.shingles(hashes, counts, 3)
    assert [len(set(s.tolist())) for s in np.split(shingles, np.cumsum(n)[:-1])] == [len(shingle_set(t, 3)) for t in texts] if texts else True


# 1 fingerprints


def test_fingerprint_estimates(spark):
    base = fx.prose(5, 400)
    rows = [(i, changed(base, share, i), "en", "a", 0) for i, share in enumerate([0, 0, 0.02, 0.05, 0.1, 0.3, 1.0])] + [(20, fx.prose(6, 12), "en", "a", 0), (21, fx.prose(6, 12), "en", "a", 0)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(fx.frame(spark, rows)).collect()}
    assert all(len(r["fingerprint"]) == fingerprints.BINS * fingerprints.BITS // 8 for r in got.values())
    for i, *_ in rows:
        truth = jaccard(shingle_set(rows[0][1], 3), shingle_set(dict((r[0], r[1]) for r in rows)[i], 3))
        assert abs(fingerprints.estimate(got[0]["fingerprint"], got[i]["fingerprint"]) - truth) < 0.17
    assert fingerprints.estimate(got[20]["fingerprint"], got[21]["fingerprint"]) == 1.0
    assert fingerprints.estimate(None, got[0]["fingerprint"]) is None


def test_densification_keeps_agreement():
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(300):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (10, 5, 5))
        dense = fingerprints.densify(fingerprints.bin_minima(np.concatenate([common, a, common, b]), np.array([15, 15]), 128))
        assert (dense != np.uint64(2**64 - 1)).all()
        agree.append((dense[0] == dense[1]).mean())
    assert abs(np.mean(agree) - 0.5) < 0.05


# 2 decontamination


@pytest.mark.parametrize("index_bytes", [decontaminate.INDEX_BYTES, 0])
def test_decontamination_against_brute_force(spark, index_bytes):
    rng = random.Random(8)
    tests = [(i, fx.prose(100 + i, rng.choice([6, 9, 17, 33, 70, 200]))) for i in range(60)]
    rows = []
    for i in range(200):
        text = fx.prose(1000 + i, rng.choice([5, 50, 400, 3000]))
        if i % 2:
            item = changed(tests[i % 60][1], rng.choice([0, 0, 0.03, 0.2]), i)
            cut = text.split(" ")
            at = rng.randrange(len(cut) + 1)
            text = " ".join(cut[:at] + item.split(" ") + cut[at:])
        rows.append((i, text, "en", "a", 0))
    truth = {}
    sets = [(i, shingle_set(t, 5)) for i, t in tests]
    for d, text, *_ in rows:
        mine = shingle_set(text, 5)
        for i, s in sets:
            if len(s & mine) / len(s) >= decontaminate.THRESHOLD:
                truth[d, i] = len(s & mine) / len(s)
    found = {(r[0], r[1]): r[2] for r in decontaminate.contaminated(fx.frame(spark, rows), fx.items(spark, tests), index_bytes=index_bytes).collect()}
    assert len(truth) > 60 and set(found) <= set(truth) and len(found) >= 0.95 * len(truth)
    assert all(abs(found[k] - truth[k]) < 1e-9 for k in found)
    kept = {r[0] for r in decontaminate.remove_contaminated(fx.frame(spark, rows), fx.items(spark, tests), index_bytes=index_bytes).select("doc_id").collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in found}


@pytest.mark.parametrize("index_bytes", [decontaminate.INDEX_BYTES, 0])
def test_items_shorter_than_a_shingle_match_as_they_are(spark, index_bytes):
    tests = [(1, "Forty-two"), (2, "the blue whale"), (3, "river of stone"), (4, "...")]
    rows = [(1, "It said forty two!", "en", "a", 0), (2, "the blue whale", "en", "a", 0), (3, "the whale, blue. A river of stones", "en", "a", 0), (4, "two forty the", "en", "a", 0), (5, "of the blue whale, the blue whale", "en", "a", 0), (6, "forty", "en", "a", 0)]
    found = decontaminate.contaminated(fx.frame(spark, rows), fx.items(spark, tests), index_bytes=index_bytes)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1.0), (2, 2, 1.0), (5, 2, 1.0)]
    assert {r[0] for r in decontaminate.remove_contaminated(fx.frame(spark, rows), fx.items(spark, tests), index_bytes=index_bytes).select("doc_id").collect()} == {3, 4, 6}


def test_a_match_does_not_depend_on_the_neighbours():
    rng = random.Random(9)
    tests = [fx.prose(100 + i, rng.choice([6, 20, 90, 300])) for i in range(40)]
    texts = [" ".join([fx.prose(500 + i, rng.choice([0, 3, 50, 700])), changed(tests[i % 40], rng.choice([0, 0.05]), i), fx.prose(900 + i, rng.choice([0, 40]))]) for i in range(80)]
    index = decontaminate.ItemIndex(tests, decontaminate.SHINGLE, decontaminate.THRESHOLD, decontaminate.RECALL)
    together = set(zip(*[x.tolist() for x in index.matches(pa.array(texts))[:2]]))
    alone = {(i, int(j)) for i, t in enumerate(texts) for j in index.matches(pa.array([t]))[1]}
    assert together == alone and len(alone) > 50


# 3 mixing


def test_mixing_meets_targets(spark):
    rows = [(i, fx.prose(i, 5 + i % 40), ["en", "fr"][i % 7 == 0], ["web", "news", "books"][i % 10 // 4 if i % 10 < 9 else 2], 0) for i in range(3000)]
    docs = fx.frame(spark, rows)
    got = mixing.mixing_rates(docs, sources={"web": 1, "news": 1, "books": 2}, langs={"en": 3, "fr": 1}, budget=0.8).toPandas()
    total = got["n_tokens"].sum()
    used = got["rate"] * got["n_tokens"]
    share = used.groupby(got["source"]).sum() / total
    assert abs(share["web"] - 0.2) < 1e-4 and abs(share["books"] - 0.4) < 1e-4
    assert abs((used.groupby(got["lang"]).sum() / total)["fr"] - 0.2) < 1e-4
    # exponential form: within a cell the log rate is linear in the log length
    for _, cell in got.groupby(["source", "lang"]):
        x, y = np.log(cell["n_tokens"]), np.log(cell["rate"])
        assert np.abs(y - np.polyval(np.polyfit(x, y, 1), x)).max() < 1e-6
    copies = got["copies"]
    assert ((copies >= np.floor(got["rate"])) & (copies <= np.ceil(got["rate"]))).all()
    assert abs(copies.sum() - got["rate"].sum()) < 4 * math.sqrt((got["rate"] % 1 * (1 - got["rate"] % 1)).sum())
    mixed = Counter(r[0] for r in mixing.mix(docs, sources={"web": 1, "news": 1, "books": 2}, langs={"en": 3, "fr": 1}, budget=0.8).select("doc_id").collect())
    assert mixed == Counter({int(i): int(c) for i, c in zip(got["doc_id"], copies) if c})


def test_mixing_without_targets_or_tokens(spark):
    assert [r["rate"] for r in mixing.mixing_rates(fx.frame(spark, [(1, "", "en", "a", 0), (2, None, None, None, 0)])).collect()] == [1.0, 1.0]
    with pytest.raises(ValueError):
        mixing.mixing_rates(fx.frame(spark, [(1, "a b", "en", "a", 0)]), sources={"other": 1.0})


# 4 toxicity


def maximal(scores, lo=0):
    """Maximal-scoring segments by definition: the best one, then those left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[0] + 1e-9):
                best = (total, i, j)
    if best is None:
        return []
    total, i, j = best
    return maximal(scores[:i], lo) + [(lo + i, lo + j, total)] + maximal(scores[j + 1 :], lo + j + 1)


@given(st.lists(st.one_of(st.none(), st.integers(1, 50)), max_size=25))
@settings(max_examples=150, deadline=None)
def test_segments_are_the_maximal_ones(cells):
    other = -3.3137
    hits = [(i, c + 0.001 * (i * 37 % 101)) for i, c in enumerate(cells) if c]
    dense = [other] * len(cells)
    for i, c in hits:
        dense[i] = c
    mine = toxicity.segments([i for i, _ in hits], [c for _, c in hits], other)
    assert [(a, b, round(s, 6)) for a, b, s in mine] == [(a, b, round(s, 6)) for a, b, s in maximal(dense)]


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(4)
    slurs = ["grubface", "scumling", "vilewort", "rotbrain", "filthpig", "slimelord"]
    rows, marks = [], []
    for i in range(1200):
        words, bad = fx.prose(i, rng.choice([30, 200, 1000])).split(" "), i % 4 == 0
        if bad:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(slurs) if rng.random() < 0.5 else rng.choice(fx.WORDS) for _ in range(12)] + [slurs[i % 6]] * 2
        rows.append((i, " ".join(words), "en", "a", 0))
        if i < 600:
            marks.append((i, 1, int(bad)))
    docs, known = fx.frame(spark, rows), fx.labels(spark, marks)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, known).collect()}
    held = range(600, 1200)
    caught, false = sum(got[i]["toxic"] for i in held if i % 4 == 0), sum(got[i]["toxic"] for i in held if i % 4)
    assert caught >= 0.95 * 150 and false <= 0.01 * 450
    for i in held:
        if got[i]["toxic"] and i % 4 == 0:
            words = word_list(rows[i][1])
            assert any(set(words[p["first_word"] : p["last_word"] + 1]) & set(slurs) for p in got[i]["passages"])
    kept = {r[0] for r in toxicity.remove_toxic(docs, known).select("doc_id").collect()}
    assert kept == {i for i in range(1200) if not got[i]["toxic"]}


def test_rare_toxic_words_of_a_small_language(spark):
    rng = random.Random(14)
    rare = [f"mal{a}{b}" for a in ("do", "vi", "gru", "ta", "ple", "se", "ri", "no", "fu", "ba") for b in ("xo", "zar", "nte", "co", "rrin", "ja", "bu", "mez")]
    rows, marks, bad_rows, clean_rows = [], [], [], []
    for i in range(1500):
        small, bad = i % 5 == 0, i % 10 in (1, 5)
        words = [w + "o" if small else w for w in fx.prose(i, rng.choice([40, 150])).replace(",", "").replace(".", "").split(" ")]
        if bad and small:
            at = rng.randrange(len(words))
            words[at:at] = rng.sample(rare, 4)
        elif bad:
            words[3:3] = ["grubface", "scumling"]
        rows.append((i, " ".join(words), "es" if small else "en", "a", 0))
        if i < 1000:
            marks.append((i, 1, int(bad)))
        elif small:
            (bad_rows if bad else clean_rows).append(i)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(fx.frame(spark, rows), fx.labels(spark, marks)).collect()}
    assert sum(got[i] for i in bad_rows) >= 0.7 * len(bad_rows) and sum(got[i] for i in clean_rows) <= 0.02 * len(clean_rows)


def test_scores_are_shrunken_log_odds(spark):
    rng = random.Random(15)
    rows = [(i, fx.prose(i, 40) + (f" {rng.choice(fx.WORDS)} grubface {rng.choice(fx.WORDS)} end" if i % 3 == 0 or i % 50 == 1 else ""), "en", "a", 0) for i in range(300)]
    rows += [(1000 + i, rows[0][1], "en", "a", 0) for i in range(50)]  # copies count once
    rows += [(2000 + i, "again and again the same grubface is here", "en", "a", 0) for i in range(3)] + [(2010 + i, f"the same grubface is {i}", "en", "a", 0) for i in range(30)]  # one context
    marks = [(r[0], 1, int(r[0] % 3 == 0 or r[0] >= 1000)) for r in rows]
    contexts, total, clean = set(), [0, 0], 0
    for text, toxic in {(r[1], m[2]) for r, m in zip(rows, marks)}:
        words = word_list(text)
        total[toxic] += len(words)
        for i, w in enumerate(words):
            if w == "grubface":
                clean += not toxic
                if toxic:
                    contexts.add((words[i - 1], words[i + 1]))
    model = toxicity.fit(fx.frame(spark, rows), fx.labels(spark, marks), prior=2.0, least_log_odds=1.0)
    a_c, a_t = (2 * n / sum(total) for n in total)
    hashes, _ = ta.words(pa.array(["grubface"]))
    at, scores = model.hits(hashes)
    assert len(at) == 1 and abs(scores[0] - (math.log((len(contexts) + a_t) / a_t) - math.log((clean + a_c) / a_c))) < 1e-9


def test_lambda_k_and_p_values_against_simulated_clean_texts():
    rng = np.random.default_rng(8)
    p, scores, other = np.array([0.004, 0.003, 0.002]), np.array([2.5, 3.5, 4.5]), -0.15
    lam = toxicity.null_lambda(p, scores, other)
    assert abs((p * np.exp(lam * scores)).sum() + (1 - p.sum()) * math.exp(lam * other) - 1) < 1e-9 and lam > 0.01
    k = toxicity.null_k(p, scores, other, lam)
    n, best, chances = 400, [], []
    for _ in range(1500):
        draw = rng.random(n)
        at = np.flatnonzero(draw < p.sum())
        own = scores[np.searchsorted(np.cumsum(p), draw[at], "right")]
        found = [s for _, _, s in toxicity.segments(at.tolist(), own.tolist(), other)]
        best.append(max(found, default=0.0)), chances.append(toxicity.p_value(found, n, lam, k))
    best, chances = np.array(best), np.array(chances)
    for x in np.quantile(best, [0.8, 0.95]):
        # of clean texts about 1 - exp(-K n e^(-lambda x)) have a segment of at least x
        assert 0.4 < (1 - math.exp(-k * n * math.exp(-lam * x))) / (best >= x).mean() < 2.5
    for level in (0.1, 0.02):
        assert (chances <= level).mean() <= 1.5 * level + 0.01


def test_no_model_without_both_classes(spark):
    docs = fx.frame(spark, [(i, fx.prose(i, 50), "en", "a", 0) for i in range(20)])
    for marks in ([], [(1, 1, 0)], [(1, 1, 1)]):
        assert not any(r["toxic"] for r in toxicity.toxicity(docs, fx.labels(spark, marks)).collect())


# 5 token counts, 8 token ids

ODD_TEXTS = ["", " ", "  a  b ", "It's what I'd've said!!", "tabs\tand\n\nlines \n x", "Ünïcödé ñandú 日本語テキスト \U0001f600\U0001f600", "1234567 89,5 <|endoftext|>", "a" * 5000, "aaaa bbbb" * 300, " nbsp em", "don't  stop\r\nnow  ", "'s 's's", "\u0000\u0001"]


@pytest.fixture(scope="module")
def reference():
    ranks = tokencount.read_ranks(tokencount.RANKS_PATH)
    return tiktoken.Encoding("test", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={})


def corpus_texts():
    return [r[0] or "" for r in duckdb.sql(f"SELECT text FROM '{SMALL}/documents.parquet'").fetchall()]


def test_token_counts_and_ids(spark, reference):
    texts = ODD_TEXTS + corpus_texts()
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    want = [reference.encode_ordinary(t) for t in texts]
    counted = {r["doc_id"]: (r["n_tokens"], r["n_chars"], r["n_bytes"]) for r in tokencount.token_counts(fx.frame(spark, rows)).collect()}
    assert [counted[i] for i in range(len(texts))] == [(len(w), len(t), len(t.encode())) for w, t in zip(want, texts)]
    packed = {r["doc_id"]: r for r in tokenbin.token_binary(fx.frame(spark, rows)).collect()}
    for i, w in enumerate(want):
        r = packed[i]
        assert tokenbin.decode(r["n_tokens"], r["words"], r["block_words"], r["escapes"]).tolist() == w


@given(st.text(alphabet=" abcé'1!\n日", max_size=60))
@settings(max_examples=100, deadline=None)
def test_token_counts_of_any_text(reference, text):
    if "counter" not in _made:
        ranks = tokencount.read_ranks(tokencount.RANKS_PATH)
        _made.update(counter=tokencount.Counter(ranks), tokenizer=tokenbin.Tokenizer(ranks))
    want = reference.encode_ordinary(text)
    assert _made["counter"].count([text]) == [len(want)]
    assert _made["tokenizer"].encode([text])[0].tolist() == want


_made = {}


@given(st.lists(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(rows):
    lengths = np.array([len(r) for r in rows])
    words, n_words, first, raw, n_raw = tokenbin.encode(np.array([x for r in rows for x in r], np.uint64), lengths)
    w, f, e = np.split(words, np.cumsum(n_words)), np.split(first, np.cumsum(-(-lengths // tokenbin.BLOCK))), np.split(raw, np.cumsum(n_raw))
    for i, r in enumerate(rows):
        assert tokenbin.decode(len(r), w[i].tobytes(), f[i].tobytes(), e[i].tobytes()).tolist() == r


# 6 near duplicates


def near_groups(rows, threshold):
    sets = [shingle_set(r[1], neardup.SHINGLE) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(sets[a], sets[b]) >= threshold]
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return pairs, [find(i) for i in range(len(rows))]


def test_near_duplicates_against_brute_force(spark):
    shared = fx.prose(77, 60)
    rows = [(i, fx.prose(i, 80 + i % 300) + (" " + shared if i % 3 == 0 else ""), "en", "a", 0) for i in range(120)]
    rows += [(1000 + i, changed(rows[i % 30][1], [0, 0.01, 0.05, 0.1][i % 4], i), "en", "b", 0) for i in range(200)]
    rows += [(2000 + i, "a b c", "en", "c", 0) for i in range(5)] + [(2100, "", "en", "c", 0), (2101, None, "en", "c", 0)]
    pairs, root = near_groups(rows, neardup.THRESHOLD)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(fx.frame(spark, rows)).collect()}
    same = [got[rows[a][0]]["group_id"] == got[rows[b][0]]["group_id"] for a, b in pairs]
    assert len(same) > 500 and sum(same) >= 0.97 * len(same)
    members = defaultdict(set)
    for i, r in enumerate(rows):
        members[got[r[0]]["group_id"]].add(root[i])
    assert all(len(m) == 1 for m in members.values())
    kept = [d for d, r in got.items() if r["keep"]]
    assert len(kept) == len(members) and all(got[d]["group_id"] == d for d in kept)
    assert sorted(r[0] for r in neardup.remove_near_duplicates(fx.frame(spark, rows)).select("doc_id").collect()) == sorted(kept)


def test_every_similar_candidate_of_a_large_family_is_joined(spark):
    base = fx.prose(500, 300)
    rows = [(0, base, "en", "a", 0)] + [(1 + i, changed(base, 0.05, i), "en", "a", 0) for i in range(300)] + [(1000 + i, changed(base, 0.09 + 0.01 * (i % 6), 5000 + i), "en", "a", 0) for i in range(150)]
    shingles, counts = ta.shingles(*ta.words(pa.array([r[1] for r in rows])), neardup.SHINGLE)
    minima = fingerprints.bin_minima(shingles, counts, neardup.BUCKETS)
    keys = defaultdict(set)
    for row, key in zip(*neardup.band_keys(neardup.registers(minima), minima)):
        keys[int(row)].add(int(key))
    pairs, _ = near_groups(rows, neardup.THRESHOLD)
    due = [(a, b) for a, b in pairs if keys[a] & keys[b]]
    got = {r["doc_id"]: r["group_id"] for r in neardup.near_duplicates(fx.frame(spark, rows)).collect()}
    assert len(due) > 10_000 and [p for p in due if got[rows[p[0]][0]] != got[rows[p[1]][0]]] == []


@pytest.mark.parametrize("block", [2048, 20, 7])
def test_blocks_of_one_part_do_not_meet(spark, block):
    rng = np.random.default_rng(6)
    base = rng.integers(1, 60000, neardup.BUCKETS).astype(np.uint16)
    regs = np.where(rng.random((130, neardup.BUCKETS)) < 0.1, rng.integers(1, 60000, (130, neardup.BUCKETS)), base).astype(np.uint16)
    part = [0] * 60 + [1] * 3 + [2] * 67
    units = spark.createDataFrame([(i, 500, bytes(regs[i].tobytes())) for i in range(130)], "uid long, n long, sketch binary")
    parts = spark.createDataFrame([(9, part[i], i, 130) for i in range(130)], "key long, part long, uid long, n long")
    want = {(a, b) for b in range(130) for a in range(b) if part[a] != part[b]}
    assert {tuple(r) for r in neardup._promising_in_bands(parts, units, 0.5, block).collect()} == want


def test_a_block_size_changes_nothing(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(1, 60000, (12, neardup.BUCKETS)).astype(np.uint16)
    regs = base[rng.integers(0, 12, 300)]
    noise = rng.random(regs.shape) < rng.choice([0.1, 0.4, 0.6], 300)[:, None]
    regs = np.where(noise, rng.integers(1, 60000, regs.shape), regs).astype(np.uint16)
    key = rng.integers(0, 3, 300)
    units = spark.createDataFrame([(i, 500, bytes(regs[i].tobytes())) for i in range(300)], "uid long, n long, sketch binary")
    sizes = Counter(key.tolist())
    parts = spark.createDataFrame([(int(k), i % 50, i, sizes[int(k)]) for i, k in enumerate(key)], "key long, part long, uid long, n long")
    want = set()
    for a in range(300):
        for b in range(a + 1, 300):
            if key[a] == key[b] and a % 50 != b % 50:
                j, used = neardup.estimate(regs[[a]], regs[[b]], np.array([500]), np.array([500]))
                if j[0] + 3 * math.sqrt(0.25 / used[0]) >= 0.5:
                    want.add((a, b))
    for block in (2048, 40, 7):
        assert {tuple(r) for r in neardup._promising_in_bands(parts, units, 0.5, block).collect()} == want


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000)]
    rng = random.Random(3)
    rng.shuffle(edges)
    got = {r["v"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 400)} | {1000 + i: 1000 for i in range(1, 61)}


def test_identities_tell_sequences_apart():
    texts = ["a b", "b a", "a  B!", "a b c", "", None, "a a", "a"]
    found = neardup.identity(*ta.words(pa.array(texts))).to_pylist()
    assert found[0] == found[2] and found[4] == found[5] == bytes(16) and len(set(found)) == 6 and all(len(f) == 16 for f in found)


def test_sketch_estimates():
    rng = np.random.default_rng(6)
    for common, own in ((900, 50), (500, 500), (0, 1000), (100, 10)):
        sets = [rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) for n in (common, own, own)]
        minima = fingerprints.bin_minima(np.concatenate([sets[0], sets[1], sets[0], sets[2]]), np.array([common + own] * 2), neardup.BUCKETS)
        regs = neardup.registers(minima)
        got, _ = neardup.estimate(regs[[0]], regs[[1]], np.array([common + own]), np.array([common + own]))
        assert abs(got[0] - common / (common + 2 * own)) < 0.15


# 7 html


def test_consensus_paths(spark):
    def page(host, i, body):
        return (i, f"http://{host}/p/{i}", f'<html><body><nav class="n">{"<a href=x>menu entry number one, two</a> " * 30}</nav><div class="c-{i} main"><p>{body}</p></div><div class="side">{"Buy now, buy here, buy this. " * (60 if i == 3 else 1)}</div><script>var x = "<p>no</p>"</script></body></html>')

    rows = [page("one.example", i, f"Story {i}, with a long body of running text. " * 8) for i in range(6)] + [(50, "http://two.example/", "<p>Alone, but there is a text &amp; more of it.</p>")]
    got = {r["page_id"]: r for r in webtext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i]["path"] == "div.c.main" and got[i]["text"] == (f"Story {i}, with a long body of running text. " * 8).strip()
    assert got[50]["text"] == "Alone, but there is a text & more of it."


def random_page(rng, deepest=6):
    def node(depth):
        kind = rng.choice(["div", "section", "article", "nav", "aside", "p", "li", "h2", "td"])
        classes = rng.choice(["", "", ' class="main"', ' class="c-17 body"', " class=side"])
        inner = " ".join(rng.choice(fx.WORDS) + rng.choice(["", ",", "."]) for _ in range(rng.choice([0, 3, 12, 40])))
        link = "<a href=x>" + " ".join(rng.choices(fx.WORDS, k=6)) + "</a>" if rng.random() < 0.3 else ""
        inside = "".join(node(depth + 1) for _ in range(rng.choice([0, 1, 2]))) if depth < deepest and kind not in ("p", "li", "h2", "td") else ""
        return f"<{kind}{classes}>{inner}{link}{inside}</{kind}>"

    return "<html><body>" + "".join(node(0) for _ in range(4)) + "</body></html>"


class Tree(HTMLParser):
    """Brute force: every container is an object that holds its whole path."""

    def __init__(self, source):
        super().__init__()
        self.open, self.blocks, self.text, self.links, self.in_link = [("", "", False)], [], "", 0, False
        self.feed(source), self.flush()

    def flush(self):
        text = " ".join(self.text.split())
        if text:
            self.blocks.append(([o[1] for o in self.open], any(o[2] for o in self.open), text, min(self.links, len(text))))
        self.text, self.links = "", 0

    def handle_data(self, data):
        self.text += data
        self.links += len(data) * self.in_link

    def handle_starttag(self, tag, attributes):
        if tag == "a":
            self.in_link = True
            return
        self.flush()
        kinds = sorted(k for k in (re.sub(r"\d+", "", c).strip("-_") for c in (dict(attributes).get("class") or "").split()) if k)
        path = self.open[-1][1]
        if tag not in ("p", "li", "h2", "html", "body"):
            path = ">".join(filter(None, [path, ".".join([tag, *kinds])]))
        self.open.append((tag, path, tag in ("nav", "aside")))

    def handle_endtag(self, tag):
        if tag == "a":
            self.in_link = False
            return
        self.flush(), self.open.pop()

    def scores(self):
        out = defaultdict(float)
        for paths, aside, text, links in self.blocks:
            distinct = [p for i, p in enumerate(paths) if i == 0 or p != paths[i - 1]]
            if not aside and len(text) >= webtext.LEAST_CHARS:
                gain = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text))
                for path, share in zip(distinct[::-1], (1, 0.5)):
                    out[path] += gain * share
        return out


def test_extraction_against_brute_force(spark):
    rng = random.Random(21)
    rows = [(i, f"http://host{i % 7}.example/{i}", random_page(rng)) for i in range(80)] + [(80, None, random_page(rng))]
    trees, votes = {r[0]: Tree(r[2]) for r in rows}, defaultdict(Counter)
    for i, _, _ in rows[:80]:
        scores = trees[i].scores()
        for path, score in scores.items():
            votes[i % 7][path] += round(1000 * score / max(scores.values()))
    got = {r["page_id"]: r for r in webtext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    inside = lambda tree, path: "\n".join(t for paths, aside, t, _ in tree.blocks if path in paths and not aside)
    for i in range(81):
        tree, own = trees[i], trees[i].scores()
        elected = {p for p, v in votes[i % 7].items() if v == max(votes[i % 7].values())} if i < 80 else set()
        best = {p for p, v in own.items() if abs(v - max(own.values())) < 1e-9} or {None}
        path = got[i]["path"]
        assert path in (elected if any(inside(tree, p) for p in elected) else best), (i, path, elected, best)
        assert got[i]["text"] == ("\n".join(t for _, _, t, _ in tree.blocks) if path is None else inside(tree, path))


def test_very_deep_pages_and_stray_end_tags():
    text = "running text, of some length, in the deepest place of all"
    for source in ("<div>" * 60_000 + text + "</div>" * 60_000, "<div>" * 60_000 + "</section>" * 60_000 + text, f"<div class=a>{text} one</div>" * 60_000):
        page = webtext.Page(source)
        assert page.scores() and len(page.keys()) == len(page.names) and len(page.names) <= 60_001


# 9 sharding


def test_few_records_move(spark):
    docs = fx.frame(spark, [(i, "t", "en", "a", 0) for i in range(4000)])
    before = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, {"a": 1.0, "b": 1.0, "c": 2.0}).collect()}
    after = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, {"a": 1.0, "b": 1.0, "c": 2.0, "d": 1.0}).collect()}
    moved = [i for i in before if before[i] != after[i]]
    assert all(after[i] == "d" for i in moved) and abs(len(moved) / 4000 - 0.2) < 0.03
    assert abs(sum(s == "c" for s in before.values()) / 4000 - 0.5) < 0.04
    with pytest.raises(ValueError):
        sharding.shard(docs, {"a": 0.0})


def test_a_hot_key_fills_no_single_partition(spark):
    docs = fx.frame(spark, [(7 if i % 3 else i, f"t {i}", "en", "a", 0) for i in range(6000)]).repartition(8)
    out = sharding.shard(docs, {"a": 1.0, "b": 3.0}, pieces=8)
    sizes = Counter((r["shard"], r["piece"]) for r in out.select("shard", F.spark_partition_id().alias("piece")).collect())
    assert out.rdd.getNumPartitions() == 16 and out.columns == [*docs.columns, "shard"] and len({s for s, _ in sizes if s == "a"}) == 1
    assert len(sizes) == 16 and len({p for _, p in sizes}) == 16
    for name in "ab":
        own = [n for (s, _), n in sizes.items() if s == name]
        assert max(own) < 1.5 * sum(own) / len(own)


# 10 lines


def deduped(rows):
    seen, out = set(), {}
    for doc, text in sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for line in (text or "").split("\n"):
            bare = line.strip(linededup.WHITE)
            if not bare or bare not in seen:
                kept.append(line)
            seen.add(bare)
        out[doc] = "\n".join(kept)
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 3), (9, 2)])
def test_lines_against_brute_force(spark, batches, fanout):
    rng = random.Random(11)
    pool = [fx.prose(i, rng.choice([1, 3, 6, 12])) for i in range(60)]
    rows = [(i * 3, "\n".join(rng.choice(pool) + rng.choice(["", "", "  ", "\r", "\t\u00a0"]) for _ in range(rng.choice([1, 5, 12]))), "en", "a", 0) for i in range(150)] + [(None, pool[0] + "\n" + pool[1], "en", "a", 0), (1, None, "en", "a", 0), (2, "", "en", "a", 0)]
    got = {r["doc_id"]: r["text"] for r in linededup.deduped_lines(fx.frame(spark, rows), batches=batches, fanout=fanout, buckets=4).collect()}
    assert got == deduped(rows)


def test_runs_take_batch_after_batch(spark, tmp_path):
    rng = random.Random(12)
    pool = [fx.prose(i, rng.choice([1, 3, 6])) for i in range(40)]
    batches = [[(f"d{b:02d}-{i:02d}", "\n".join(rng.choices(pool, k=5) + [f"own line {b} {i}"])) for i in range(6)] for b in range(8)]
    folder, got = f"file://{tmp_path}/runs", {}
    for batch in batches:
        # a new object each time, as in a later session: all it knows is the folder
        runs = linededup.Runs(spark, folder, buckets=4, fanout=2)
        got |= {r["doc_id"]: r["text"] for r in runs.take(spark.createDataFrame(batch, "doc_id string, text string")).collect()}
    assert got == deduped([r for batch in batches for r in batch])
    assert runs.seq == 8 and len(runs.paths()) < 5 and len(list((tmp_path / "runs").glob("run-*"))) == len(runs.paths())
    again = linededup.Runs(spark, folder).take(spark.createDataFrame([("z", batches[0][0][1] + "\nnever seen")], "doc_id string, text string")).first()
    assert again["text"] == "never seen" and again["n_removed"] == 6
    runs.drop()
    assert not (tmp_path / "runs").exists()


def test_lines_of_a_very_long_text(spark):
    rows = [(1, "\n".join(["same line"] * 60_000), "en", "a", 0), (2, "\n".join(f"line {i}" for i in range(200_000)), "en", "a", 0), (3, "line 5\n\n  \nsame line", "en", "a", 0)]
    began = time.time()
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linededup.deduped_lines(fx.frame(spark, rows)).collect()}
    assert got == {1: ("same line", 60_000, 59_999), 2: (rows[1][1], 200_000, 0), 3: ("\n  ", 4, 2)} and time.time() - began < 120


def test_ranks_file_is_the_reference():
    with open(tokencount.RANKS_PATH, "rb") as f:
        first = f.readline().split()
    assert tokencount.read_ranks(tokencount.RANKS_PATH)[base64.b64decode(first[0])] == int(first[1])
