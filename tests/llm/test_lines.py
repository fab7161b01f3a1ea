import random
from collections import Counter

import numpy as np
import pytest

from peerband.llm import line_dedup as ld
from tests.llm.shapes import messy


def line(n, words):
    return " ".join(f"w{n}x{i}" for i in range(words))


def every_run(rows, least):
    """Lines left when all runs of ``least`` words with an earlier place are deleted, all tried."""
    first, runs, lines = {}, [], [[x for x in t.split("\n") if x.split()] for _, t in rows]
    for d, ls in enumerate(lines):
        for lo in range(len(ls)):
            for hi in range(lo + 1, len(ls) + 1):
                if sum(len(x.split()) for x in ls[lo:hi]) >= least:
                    key = tuple(ls[lo:hi])
                    if first.setdefault(key, (d, lo)) != (d, lo):
                        runs.append((d, lo, hi))
    cut = {(d, i) for d, lo, hi in runs for i in range(lo, hi)}
    return [[x for i, x in enumerate(ls) if (d, i) not in cut] for d, ls in enumerate(lines)]


@pytest.mark.parametrize("least,seed", [(10, 1), (10, 2), (6, 3), (50, 4)])
def test_line_dedup_equals_brute_force(spark, least, seed):
    rng = random.Random(seed)
    pool = [line(n, rng.choice([1, 2, 4, 7, 12])) for n in range(25)]
    rows = []
    for i in range(60):
        ls = [rng.choice(pool) if rng.random() < 0.5 else line(1000 + rng.randrange(10**6), 5)
              for _ in range(rng.randrange(9))]
        if rng.random() < 0.4:
            at = rng.randrange(20)
            ls[1:1] = pool[at:at + 4]
        if rng.random() < 0.2:
            ls += ["", "  ", *ls]
        rows.append((i, "\n".join(ls)))
    rows += [(70, None), (71, "")]
    # A null id comes first; rows that repeat id and text are one document.
    rows = [(None, rows[5][1]), *rows]
    want = dict(zip([i for i, _ in rows], every_run([(i, t or "") for i, t in rows], least)))
    found = ld.line_dedup(messy(spark, rows + rows[1:4]), least_words=least).collect()
    assert len(found) == len(rows) + 3
    texts = Counter((r.id, tuple(x for x in r.text.split("\n") if x.split())) for r in found)
    assert texts == Counter((i, tuple(want[i])) for i, _ in rows + rows[1:4])
    assert all(r.n_deleted == len(r.deleted) <= r.n_lines for r in found)


@pytest.mark.parametrize("hot", [10_000, 3])
def test_one_passage_in_every_document(spark, monkeypatch, hot):
    monkeypatch.setattr(ld, "HOT_PLACES", hot)
    monkeypatch.setattr(ld, "HOT_SHARE", 100)
    passage = [line(n, 10) for n in range(9)]
    rows = [(n, "\n".join([f"start {n}", *passage[n % 3:], f"end {n}"])) for n in range(200)]
    got = {r.id: r.text for r in ld.line_dedup(messy(spark, rows)).collect()}
    assert got[0] == rows[0][1]
    assert all(got[n] == f"start {n}\nend {n}" for n in range(1, 200))


def test_repeated_passages_go_and_first_ones_stay(spark):
    passage = "\n".join(line(n, 20) for n in range(3))
    alone = line(9, 60)
    rows = [(3, f"start three\n{passage}\nend"), (1, f"start one\n{passage}\n{alone}\nmore one"),
            (2, "short line\nunlike"), (4, f"x\n{alone}\ny"), (5, "short line\nanother")]
    got = {r.id: r.text for r in ld.line_dedup(messy(spark, rows)).collect()}
    assert got == {1: rows[1][1], 2: rows[2][1], 3: "start three\nend", 4: "x\ny", 5: rows[4][1]}


def test_copies_go_though_every_part_stands_in_an_earlier_excerpt(spark):
    """Each two lines of the passage stand first in an excerpt of under 50 words."""
    passage = [line(n, 10) for n in range(12)]
    rows = [(n, "\n".join(["start", *passage[a:b], "end"]))
            for n, (a, b) in enumerate([(0, 4), (3, 7), (6, 10), (9, 12)])]
    rows += [(n, "\n".join([f"start {n}", *passage, f"end {n}"])) for n in range(10, 15)]
    got = {r.id: r.text for r in ld.line_dedup(messy(spark, rows)).collect()}
    assert got == dict(rows[:5]) | {n: f"start {n}\nend {n}" for n in range(11, 15)}


@pytest.mark.parametrize("least,seed", [(1, 1), (10, 2), (24, 3), (50, 4)])
def test_line_dedup_deletes_every_repeated_run(spark, least, seed):
    rng = random.Random(seed)
    pool = [line(n, rng.choice([1, 2, 4, 7, 12, 30])) for n in range(12)]
    rows = []
    for i in range(80):
        a = rng.randrange(12)
        ls = pool[a:a + rng.randrange(9)] + [rng.choice(pool) for _ in range(rng.randrange(4))]
        rows.append((i, "\n".join(ls)))
    got = {r.id: r.text for r in ld.line_dedup(messy(spark, rows), least_words=least).collect()}
    want = every_run(rows, least)
    assert [[x for x in got[i].split("\n") if x] for i, _ in rows] == want


def test_repeats_within_one_document(spark):
    passage = line(1, 55)
    got = ld.line_dedup(messy(spark, [(1, "\n".join([passage, "a", passage, passage]))])).first()
    assert got.text == f"{passage}\na" and got.deleted == [2, 3]


def test_windows_are_the_shortest_spans():
    start, stop = ld.windows(np.array([3, 1, 4, 1, 9]), 5)
    assert list(zip(start.tolist(), stop.tolist())) == [(0, 3), (1, 3), (2, 4), (3, 5), (4, 5)]
    assert ld.windows(np.array([1, 2]), 5)[0].tolist() == []


def test_winnow_takes_the_last_least_hash_of_each_window():
    hashes = np.array([5, 1, 1, 7, 9, 8], np.uint64)
    start, stop = np.array([0, 1, 3, 4, 5]), np.array([2, 3, 4, 6, 6])
    assert ld.winnow(hashes, start, stop).tolist() == [1, 2, 3, 5, 5]
    rng = np.random.default_rng(1)
    for _ in range(200):
        words = rng.integers(1, 9, rng.integers(1, 30))
        some = rng.integers(0, 6, len(words)).astype(np.uint64)
        start, stop = ld.windows(words, 10)
        want = [a + len(some[a:b]) - 1 - some[a:b][::-1].argmin() for a, b in zip(start, stop)]
        assert ld.winnow(some, start, stop).tolist() == want


def test_copies_of_a_window_share_its_fingerprint_and_others_are_dropped_early(spark, tmp_path):
    passage = [line(n, 10) for n in range(6)]
    a = ld.line_hashes("\n".join(["own one", *passage]))
    b = ld.line_hashes("\n".join([*passage, "own two", "own three"]))
    shared = set(ld.fingerprints(*a, 50)[0].tolist()) & set(ld.fingerprints(*b, 50)[0].tolist())
    assert shared <= set(ld.line_hashes("\n".join(passage))[0].tolist()) and shared


def test_messy_and_empty_tables(spark):
    docs = messy(spark)
    assert ld.line_dedup(docs).count() == docs.count()
    assert ld.line_dedup(docs.where("false")).count() == 0
