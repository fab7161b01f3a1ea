"""Packing, SentencePiece, license scans, language and quality against plain rebuilds."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peerband.llm import langid, licenses, packing, pieces, quality
from peerband.llm.queries import vocabulary
from tests.llm.shapes import TEXTS, messy

WORD_FILE, PIECE_FILE = vocabulary("word_bpe_49k.json"), vocabulary("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.01"
ODD = st.text(alphabet=st.sampled_from("ab Tthé.▁'<|>0 \n\t　é́日ẞΣ"), max_size=60)


# ---------------------------------------------------------------- packing


def plain_best_fit(lengths, capacity):
    """Bins of best fit in falling order, one item at a time."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            best = min(fits, key=lambda i: room[i])
            room[best] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("capacity,items,seed", [(10, 200, 1), (37, 400, 2), (64, 3, 3), (8, 0, 4)])
def test_plan_over_counts_equals_best_fit_of_items(capacity, items, seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, capacity) for _ in range(items)]
    counts = np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, int)
    plan = packing.best_fit_plan(counts)
    taken, ranks = defaultdict(list), defaultdict(list)
    for n, lo, hi, seq, off in zip(*(plan[k].tolist() for k in
                                     ("length", "lo", "hi", "sequence", "offset"))):
        for r in range(lo, hi):
            taken[seq + r - lo].append((off, n))
            ranks[n].append(r)
    assert {n: sorted(r) for n, r in ranks.items()} == {
        n: list(range(c)) for n, c in Counter(lengths).items()}
    for slots in taken.values():
        at = 0
        for off, n in sorted(slots):
            assert off == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in s) for s in taken.values()) == plain_best_fit(
        lengths, capacity)
    assert sorted(taken) == list(range(len(taken)))


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_word_encoder_equals_the_library(text):
    encoder = packing._encoder(WORD_FILE)
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(next(encoder.encode([text])), "<u4").tolist() == want


@pytest.mark.parametrize("capacity", [7, 2048])
def test_packed_pieces_hold_every_document(spark, capacity):
    rows = TEXTS + [(100 + i, "some words of " * i) for i in range(40)]
    got = packing.pack(messy(spark, rows), WORD_FILE, capacity=capacity).collect()
    library = packing._encoder(WORD_FILE).tokenizer
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            crc = zlib.crc32(np.array(part, "<u4").tobytes())
            want[(i, k, at, len(part), crc, tuple(part))] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids))
                   for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.sequence_id].append((r.offset, r.length))
    for s in slots.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        assert sum(n for _, n in s) <= capacity
    assert len(slots) == len(plain_best_fit([r.length for r in got], capacity))


def test_packing_of_an_empty_table(spark):
    assert packing.pack(messy(spark).where("false"), WORD_FILE).count() == 0


# ---------------------------------------------------------------- sentencepiece


@settings(max_examples=300, deadline=None)
@given(ODD | st.text(max_size=30))
def test_pieces_equal_the_library(text):
    vocab = pieces.vocabulary(PIECE_FILE)
    text = text.encode("utf-8", "ignore").decode()
    assert vocab.encode(text) == vocab.library.encode(text)


def test_caches_keep_nothing_of_texts_without_spaces():
    """What a worker holds does not grow with the length of texts."""
    texts = ["無" * 20_000 + str(n) for n in range(12)] + ["x" * 5000 + " plain words"]
    words = packing.WordEncoder(WORD_FILE)
    for t in texts:
        list(words.encode([t]))
    list(words.encode(["plain words"]))
    assert max(map(len, [*words.words, *words.parts])) <= packing.CACHE_CHARS
    found = pieces.MergeVocabulary(PIECE_FILE)
    for t in texts[:3]:
        assert found.encode(t) == found.library.encode(t)
    kept = [*found.words.young, *found.words.old, *found.parts.young, *found.parts.old]
    assert max(map(len, kept)) <= pieces.CACHE_CHARS


def test_both_agendas_agree():
    vocab = pieces.vocabulary(PIECE_FILE)
    rng = random.Random(1)
    for n in range(1, 90):
        part = "".join(rng.choice("▁thea onré  ing") for _ in range(n)).replace(" ", "▁")
        assert vocab._short(part) == vocab._long(part)


def test_encoding_and_decoding_of_a_table(spark):
    docs = messy(spark)
    library = pieces.vocabulary(PIECE_FILE).library
    got = pieces.encode_pieces(docs, PIECE_FILE)
    assert got.columns == [*docs.columns, "n_tokens", "ids", "decoded"]
    for r in got.collect():
        ids = library.encode(r.text or "")
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, library.decode(ids))
    again = pieces.decode_pieces(got.drop("decoded"), PIECE_FILE).collect()
    assert all(r.decoded == (r.text or "") or "▁" in r.text for r in again)
    for r in pieces.encode_pieces(docs, PIECE_FILE, digests=True).collect():
        ids = library.encode(r.text or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode_pieces(docs.where("false"), PIECE_FILE).count() == 0


# ---------------------------------------------------------------- licenses


def plain_scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for label, phrase in licenses.BASE:
        key = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(key)] == key:
                places.append(i)
                labels.add(label)
    every = set(labels)
    for label, _, phrase in licenses.TEMPLATES:
        key = phrase.split()
        if any(words[i:i + len(key)] == key for i in range(len(words))):
            every.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)), ",".join(sorted(every)))


def test_license_scan_equals_plain_search(spark):
    rng = random.Random(2)
    pool = ["mit", "MIT", "License", "apache", "general", "public", "gnu", "lesser", "the", "cc",
            "by", "nc", "4", "0", "éa", "2", "version", "bsd-license", "x"]
    rows = TEXTS + [(200 + n, " ".join(rng.choice(pool) for _ in range(n))) for n in range(120)]
    rows += [(400, licenses.TEMPLATES[0][1].upper()), (401, "licensed under the GNU GPL")]
    docs = messy(spark, rows)
    index = licenses.build_index(docs)
    got = licenses.scan_licenses(docs, index)
    assert set(docs.columns) <= set(got.columns)
    for r in got.collect():
        assert plain_scan(r.text) == (r.n_words, r.n_base, r.first_word, r.last_word,
                                      r.base_labels, r.labels)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert len(r.places) >= r.n_base
    whole = {r.doc_id: r.score for r in got.collect()}
    assert whole[400] == pytest.approx(1)
    assert licenses.scan_licenses(docs.where("false"), index).count() == 0
    assert licenses.build_index(docs.where("false")).scan("the mit license")["n_base"] == 1


# ---------------------------------------------------------------- language


def plain_bits(sample, text, classes):
    """PPM code length by walking contexts, straight from counts of the sample."""
    size = langid.SYMBOLS
    counts = defaultdict(Counter)
    for t in sample:
        raw = [0] * langid.ORDER + [int(classes[b]) for b in t.encode()]
        for i in range(langid.ORDER, len(raw)):
            for k in range(langid.ORDER + 1):
                counts[tuple(raw[i - k:i])][raw[i]] += 1
    raw = [0] * langid.ORDER + [int(classes[b]) for b in text.encode()]
    bits = 0.0
    for i in range(langid.ORDER, len(raw)):
        for k in range(langid.ORDER, -2, -1):
            if k < 0:
                bits += math.log2(size)
                break
            seen = counts.get(tuple(raw[i - k:i]))
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if raw[i] in seen:
                bits -= math.log2(seen[raw[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
    return bits


def test_code_lengths_equal_a_plain_context_walk(spark):
    samples = {"aa": ["abab abc", "bca é"], "bb": ["the cat", "a hat, the bat"]}
    rows = [(i, t, la) for la, ts in samples.items() for i, t in enumerate(ts, len(la) * 10)]
    docs = spark.createDataFrame([(i + 100 * (la == "bb"), t, la) for i, t, la in rows],
                                 "doc_id long, text string, lang string")
    trees = langid.train(docs)
    assert trees.languages == ["aa", "bb"]
    scorer = langid.Scorer(trees)
    texts = ["abc the", "", "zzz é日", "a", "bat bat bat"]
    want = [[plain_bits(samples[la], t, trees.classes) for la in trees.languages] for t in texts]
    assert np.allclose(scorer.total_bits(texts), want, rtol=1e-5)


def test_rare_bytes_stay_apart_beside_other_scripts(spark):
    """Over 62 byte values of another script are more frequent than the two languages' letters."""
    other = "".join(map(chr, range(0x400, 0x4FF))) * 20
    samples = {"aa": ["abab abba baab"], "bb": ["acac acca caac"], "zz": [other]}
    rows = [(i, t, la) for i, (la, ts) in enumerate(samples.items()) for t in ts]
    trees = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["abba", "acca", "\u0410\u0411\u0412", "xyz \x00 \x7f"]
    bits = langid.Scorer(trees).total_bits(texts)
    want = [[plain_bits(samples[la], t, range(256)) for la in trees.languages] for t in texts]
    assert np.allclose(bits, want, rtol=1e-5)
    assert bits.argmin(axis=1)[:3].tolist() == [0, 1, 2]


def test_language_of_odd_texts_and_no_labels(spark):
    docs = messy(spark)
    trees = langid.train(docs)
    got = langid.identify(docs, trees)
    assert [c for c in docs.columns if c != "score"] == got.columns[:-2]
    for r in got.collect():
        letter = any(c.isalpha() for c in r.text or "")
        assert r.lang_pred == ("en" if letter else "und")
        assert r.score == (1 if letter else 0)
    assert langid.train(docs.where("lang is null")) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.where("false"), trees).count() == 0
    kept = langid.keep_identified(docs, trees)
    assert kept.columns == docs.columns and kept.count() == sum(
        any(c.isalpha() for c in t or "") for _, t in TEXTS)


def test_language_accuracy_on_held_out_ids(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    trees = langid.train(docs.where(~langid.held_out()))
    test = langid.identify(docs.where(langid.held_out()), trees)
    rows = test.select("lang", "lang_pred", "doc_id").collect()
    assert len(rows) > 100
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


# ---------------------------------------------------------------- quality


def test_passage_features_depend_on_the_passage_only():
    texts = [t for _, t in TEXTS]
    together = {}
    for owner, features in quality.passages(texts):
        for o, f in zip(owner, features):
            together.setdefault(int(o), []).append(f)
    for i, t in enumerate(texts):
        alone = np.concatenate([f for _, f in quality.passages([t])])
        assert np.array_equal(alone, np.array(together[i]))
        size = len((t or "").encode())
        assert len(alone) == max(1, -(-size // quality.PASSAGE))


def test_gradient_learns_which_passage_matters():
    """Bags are bad if any passage shouts; only attention over passages can tell."""
    rng = np.random.default_rng(0)
    good = "plain words of prose that go on, and on. "
    bags, labels, texts = [], [], []
    for n in range(300):
        parts = [good * 12] * int(rng.integers(1, 6))
        bad = n % 2
        if bad:
            parts[int(rng.integers(len(parts)))] = "BUY!! NOW!! " * 43
        text = "".join(p[:512].ljust(512) for p in parts)
        texts.append(text)
        bags.append(np.concatenate([f for _, f in quality.passages([text])]))
        labels.append(1 - bad)
    model = quality.fit(bags, np.array(labels, float))
    assert np.mean((model.scores(texts) >= 0.5) == labels) > 0.97


def plain_loss(w, bags, labels):
    """Mean cross entropy of gated attention, one bag and one passage at a time."""
    total = 0.0
    for bag, label in zip(bags, labels):
        hidden = [np.tanh(x @ w["W"] + w["b"]) for x in bag]
        gate = [np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"]))) for h in hidden]
        pull = np.exp([g @ w["w"] for g in gate])
        z = sum(a / pull.sum() * h for a, h in zip(pull, hidden))
        p = 1 / (1 + np.exp(-(z @ w["c"] + w["c0"][0])))
        total -= label * np.log(p) + (1 - label) * np.log(1 - p)
    return total / len(bags)


def random_weights(rng):
    h, g = quality.HIDDEN, quality.GATE
    shapes = {"W": (quality.WIDTH, h), "b": h, "V": (h, g), "U": (h, g), "w": g, "c": h, "c0": 1}
    return {k: rng.normal(0, 0.4, shape) for k, shape in shapes.items()}


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    w, size = random_weights(rng), np.array([1, 4, 2])
    bags = [rng.normal(0, 0.5, (n, quality.WIDTH)) for n in size]
    labels = np.array([1.0, 0.0, 1.0])
    found = quality.slopes(w, np.concatenate(bags), size, labels)
    for name, values in w.items():
        for _ in range(6):
            at = tuple(rng.integers(n) for n in values.shape)
            step = np.zeros_like(values)
            step[at] = 1e-5
            up, down = ({**w, name: values + s * step} for s in (1, -1))
            want = (plain_loss(up, bags, labels) - plain_loss(down, bags, labels)) / 2e-5
            assert found[name][at] == pytest.approx(want, rel=1e-5, abs=1e-9), (name, at)


def test_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(9)
    mean, scale = rng.normal(0, 0.05, quality.WIDTH), rng.uniform(0.05, 1, quality.WIDTH)
    w = random_weights(rng)
    model = quality.Classifier(mean, scale, w)
    texts = ["some plain words here. " * 90, "", None, "SHORT!", "x" * 1300, "été 12 " * 400]
    for text, score in zip(texts, model.scores(texts)):
        features = np.concatenate([f for _, f in quality.passages([text])])
        bag = np.clip((features - mean) / scale, -8, 8)
        assert score == pytest.approx(np.exp(-plain_loss(w, [bag], [1])), rel=1e-9)


def test_quality_fit_sees_every_passage_of_a_long_text(spark, monkeypatch):
    parts = ["plain words of prose that go on, and on. ".ljust(quality.PASSAGE)] * 300
    parts[1] = "BUY!! NOW!! " * 43
    long = "".join(p[:quality.PASSAGE].ljust(quality.PASSAGE) for p in parts)
    docs = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, target: seen.extend(zip(bags, target)))
    quality.train(docs, labels)
    want = np.concatenate([f for _, f in quality.passages([long])]).astype("<f4")
    assert [len(bag) for bag, _ in seen] == [300, 1]
    assert np.array_equal(seen[0][0], want) and [t for _, t in seen] == [0, 1]


def test_quality_on_held_out_ids(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.train(docs, labels.where(~quality.held_out()))
    test = labels.where(quality.held_out()).select("doc_id", "quality")
    rows = quality.score_quality(docs, model).join(test, "doc_id").collect()
    assert len(rows) > 80
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.97
    # Scores don't depend on how rows are dealt to batches.
    again = {r.doc_id: r.score for r in
             quality.score_quality(docs.repartition(7), model).collect()}
    assert all(math.isclose(again[r.doc_id], r.score, rel_tol=1e-9) for r in rows)


def test_quality_of_odd_texts_and_no_labels(spark):
    docs = messy(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 15)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score_quality(docs, model)
    rows = got.collect()
    assert len(rows) == len(TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert quality.train(docs, labels.where("false")) is None
    assert quality.train(docs.where("false"), labels) is None
    assert {r.score for r in quality.score_quality(docs, None).collect()} == {0.5}
    kept = quality.keep_quality(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in rows)
    assert quality.score_quality(docs.where("false"), model).count() == 0
