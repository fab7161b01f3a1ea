import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from peerband.llm.components import components
from peerband.llm.exact_dedup import drop_exact_copies, exact_dedup
from peerband.llm import common
from peerband.llm import exact_dedup as exact
from peerband.llm import simhash
from tests.llm.shapes import TEXTS, messy, rows_of


def roots_of(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_links(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    pairs += [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(80)]
    found = components(spark.createDataFrame(pairs + [(None, 1)], "a long, b long"))
    want = {k: v for k, v in roots_of(pairs).items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert dict(rows_of(found, "a", "root")) == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def groups(rows):
    by_text = defaultdict(list)
    for i, t in rows:
        by_text[t or ""].append(i)
    return by_text


@pytest.mark.parametrize("digest_all", [False, True])
def test_exact_dedup_equals_grouping(spark, digest_all):
    got = exact_dedup(messy(spark), digest_all=digest_all)
    by_text = groups(TEXTS)
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in by_text}
    want = Counter()
    for text, ids in by_text.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for i in ids:
            want[(i, keep, len(ids), text)] += 1
    rows = got.collect()
    if digest_all:
        assert Counter((r.id, r.keep_id, r.group_size, digest[r.text_sha256]) for r in rows) == want
    assert Counter((r.id, r.keep_id, r.group_size) for r in rows) == Counter(
        k[:3] for k in want.elements())
    assert all(digest[r.text_sha256] is not None for r in rows if r.text_sha256)
    assert all(r.text_sha256 for r in rows if r.group_size > 1)
    # One row of each group stays, and it bears the kept id.
    assert sum(r.kept for r in rows) == len(by_text)
    assert all(r.id == r.keep_id for r in rows if r.kept)


@pytest.mark.parametrize("digest_all", [False, True])
def test_exact_dedup_without_broadcast(spark, monkeypatch, digest_all):
    want = sorted(map(str, exact_dedup(messy(spark), digest_all=digest_all).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    found = exact_dedup(messy(spark), digest_all=digest_all)
    assert found.where("kept").count() == len(groups(TEXTS))
    assert sorted(map(str, found.collect())) == want


@pytest.mark.parametrize("digest_all", [False, True])
def test_each_step_of_the_refinement_removes_rows(spark, monkeypatch, digest_all):
    head = "h" * 64
    rows = [(1, "alone"), (2, "short one"), (3, "other one"), (4, head + "first end"),
            (5, head + "later end"), (6, head + "equal end"), (7, head + "equal end")]
    staged = {}
    real = exact.stage
    monkeypatch.setattr(exact, "stage", lambda df, name: staged.setdefault(name, real(df, name)))
    found = exact_dedup(messy(spark, rows), digest_all=digest_all)
    sizes = [r.shared_bytes for r in staged["lengths"].collect()]
    assert sorted(sizes) == [9, 73]  # "alone" goes
    assert [r.group_bytes for r in staged["groups"].collect()] == [73]  # 2 and 3 go
    left = staged["survivors"].where("survives")
    assert sorted(r.id for r in left.collect()) == [4, 5, 6, 7]
    hashed = staged["survivors"].where("text_sha256 is not null").count()
    assert hashed == (7 if digest_all else 4)
    # Groups are formed of survivors only: the plan filters before it aggregates digests.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate"):].split("Relation")[0]
    assert "Filter" in below and "survives" in below.split("Filter")[1]
    assert {r.id: r.keep_id for r in found.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 7, 7: 7}


def test_drop_exact_copies_keeps_columns_and_one_row_each(spark):
    docs = messy(spark)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted(groups(TEXTS))


def test_dedup_of_an_empty_table(spark):
    docs = messy(spark).where("false")
    assert exact_dedup(docs).count() == 0
    assert drop_exact_copies(docs).count() == 0
    assert simhash.simhash_components(docs).count() == 0
    assert simhash.drop_near_copies(docs).count() == 0


def plain_fingerprint(text):
    """Bit by bit, from a plain XXH64 of each shingle."""
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_plain_counting(monkeypatch):
    monkeypatch.setattr(simhash, "SLAB", 7)
    rng = random.Random(3)
    texts = [t for _, t in TEXTS if t is None or len(t) < 1000] + [
        " ".join(rng.choice(["a", "B", "é", "c\x0bd", "e f", ""]) for _ in range(n))
        for n in range(40)
    ]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t), t


def linked(fps):
    values = np.array(sorted(set(fps)), dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= simhash.DISTANCE
    return [(int(values[i]), int(values[j])) for i, j in zip(*np.nonzero(near))]


@pytest.mark.parametrize("block", [2, 64])
def test_links_keep_every_component(spark, block):
    """Chains and a dense cloud of fingerprints; the small block sends most the way of hot ones."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for start in fps[:20]:
        at = start
        for _ in range(rng.randrange(6)):
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                at ^= 1 << b
            fps.append(at)
    cloud = rng.getrandbits(64)
    fps += [cloud ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a, 64, 5)]
    fps += [0, 1, 3, 1 << 63, (1 << 64) - 1]
    signed = [(simhash._signed(f),) for f in set(fps)]
    points = simhash.pivot_table(spark.createDataFrame(signed, "fp long"))
    found = simhash.block_links(points, block)
    got = roots_of((a % (1 << 64), b % (1 << 64)) for a, b in rows_of(found, "a", "b"))
    want = roots_of(linked(fps))
    assert {f: got.get(f, f) for f in want} == want


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, fps ^ np.uint64(5), fps ^ np.uint64(1 << 40)]))
    coords = np.bitwise_count(fps[:, None] ^ simhash.pivots()[None, :]).astype(np.int16)
    pairs = {tuple(sorted(p)) for p in simhash.verified_links(fps, coords).tolist()}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps))
            if int(fps[i] ^ fps[j]).bit_count() <= 2}
    assert pairs == want and want


def test_simhash_components_by_brute_force(spark):
    got = simhash.simhash_components(messy(spark)).collect()
    assert len(got) == len(TEXTS)
    fps = {t: plain_fingerprint(t) for _, t in TEXTS}
    roots = roots_of(linked(fps.values()))
    members = defaultdict(list)
    for i, t in TEXTS:
        members[roots[fps[t]]].append(i)
    low = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    want = Counter((i, f"{fps[t]:016x}", low[roots[fps[t]]]) for i, t in TEXTS)
    assert Counter((r.id, r.fingerprint, r.component_id) for r in got) == want


def test_drop_near_copies_judges_repeated_ids_by_component(spark):
    a, b = "alpha words unlike all the others in here", "one text of many words that is here twice"
    rows = [(3, b), (5, b), (5, a), (None, "third one of no id"), (None, "third one of no id"),
            (7, "fourth text again, yes"), (7, "fourth text again, yes")]
    assert len({simhash.fingerprint(t) for _, t in rows}) == 4
    docs = messy(spark, rows)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        [(3, b), (5, a), (None, "third one of no id"), (7, "fourth text again, yes")])


def test_drop_near_copies_keeps_one_of_two_fingerprints_of_an_id(spark):
    text = "some words of a long text that is there in two forms " * 6
    own = simhash.fingerprint(text)
    near = next(t for k in range(5000) if 0 < (simhash.fingerprint(t := f"{text} w{k}") ^ own)
                .bit_count() <= simhash.DISTANCE)
    assert simhash.drop_near_copies(messy(spark, [(2, text), (2, near)])).count() == 1


def test_drop_near_copies_keeps_the_smallest_id(spark):
    docs = messy(spark, [(5, "one text of many words here"), (3, "one text of many words here"),
                         (4, "something else altogether now, yes"), (9, None), (8, "")])
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 8]
