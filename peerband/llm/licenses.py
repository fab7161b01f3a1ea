"""License scans with a positional index of the rarest words of license templates.

How rare the templates' words are is counted over all documents. The index holds, for the rarest
words of each template's mandatory phrase, where they stand in the template. A file's license words
are looked up there, the rarest first; places that all indexed words of a template give to one
start are kept, and the start counts if the whole mandatory phrase stands there.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerband.llm.common import append_columns, narrow, prepare
from peerband.session import stage

#: Phrases whose places are counted, with their labels.
BASE = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
#: Templates of the method's own labels: label, wording, and the phrase in it that must stand there.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this"
     " software", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl", "under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license",
     "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license",
     "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are"
     " permitted", "redistribution and use in source and binary forms"),
    ("bsd", "licensed under the bsd license", "bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose",
     "permission to use copy modify and or distribute this software"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by", "creative commons attribution 4 0 international", "creative commons attribution 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
)
#: Words of a mandatory phrase that are indexed.
RARE = 2
#: Words by which the rest of a template may be shifted where it is compared.
DRIFT = 1


def _separators() -> bytes:
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b).lower()
        table[b] = ord(c) if c.isalnum() else 32
    return bytes(table)


_TABLE = _separators()


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII digits and letters, lower-cased, and of characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    label: str
    base: bool
    words: tuple[bytes, ...]
    at: int
    phrase: tuple[bytes, ...]


def templates() -> list[Template]:
    found = []
    for base, rows in ((True, [(la, w, w) for la, w in BASE]), (False, TEMPLATES)):
        for label, wording, phrase in rows:
            words, key = tuple(wording.encode().split()), tuple(phrase.encode().split())
            at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
            found.append(Template(label, base, words, at, key))
    return found


def vocabulary_of(known: list[Template]) -> set[bytes]:
    return {w for t in known for w in t.words}


class RareIndex:
    """Postings of the rarest words of each template's mandatory phrase."""

    def __init__(self, known: list[Template], frequency: dict[bytes, int], documents: int) -> None:
        self.known = known
        self.idf = {
            w: math.log((1 + documents) / (1 + frequency.get(w, 0))) + 1e-9
            for w in vocabulary_of(known)
        }
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for n, t in enumerate(known):
            places = sorted(range(len(t.phrase)), key=lambda i: (-self.idf[t.phrase[i]], i))[:RARE]
            self.needed.append(len(places))
            for i in places:
                self.postings[t.phrase[i]].append((n, i))
        self.words = frozenset(self.postings)

    def starts(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template, word at which its mandatory phrase starts), verified, in order."""
        if self.words.isdisjoint(words):
            return []
        places = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.words:
                places[w].append(i)
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for w in sorted(places, key=lambda w: (-self.idf[w], w)):
            for n, at in self.postings[w]:
                for i in places[w]:
                    votes[n, i - at] += 1
        found = []
        for (n, start), n_votes in votes.items():
            phrase = self.known[n].phrase
            if (start >= 0 and n_votes == self.needed[n]
                    and tuple(words[start:start + len(phrase)]) == phrase):
                found.append((n, start))
        return sorted(found)

    def coverage(self, words: list[bytes], n: int, start: int) -> float:
        """Share of a template, weighted by rarity, that stands around a verified phrase."""
        t = self.known[n]
        begin = start - t.at
        hit = total = 0.0
        for i, w in enumerate(t.words):
            total += self.idf[w]
            inside = t.at <= i < t.at + len(t.phrase)
            near = words[max(0, begin + i - DRIFT):max(0, begin + i + DRIFT + 1)]
            if inside or w in near:
                hit += self.idf[w]
        return hit / total

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        found = self.starts(words)
        base = [(n, at) for n, at in found if self.known[n].base]
        at = [a for _, a in base]
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": min(at, default=None),
            "last_word": max(at, default=None),
            "base_labels": ",".join(sorted({self.known[n].label for n, _ in base})),
            "labels": ",".join(sorted({self.known[n].label for n, _ in found})),
            "score": max((min(1.0, self.coverage(words, n, a)) for n, a in found), default=0.0),
            "places": [{"label": self.known[n].label, "word": a, "base": self.known[n].base,
                        "phrase": b" ".join(self.known[n].phrase).decode()} for n, a in found],
        }


def build_index(docs: DataFrame, text_col: str = "text") -> RareIndex:
    """The index, with word frequencies counted over all documents.

    Executors count how many texts hold each template word; only these few sums reach the driver.
    """
    prepare(docs.sparkSession)
    known = templates()
    wanted = frozenset(vocabulary_of(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: dict[bytes, int] = defaultdict(int)
            for text in batch.column(0).to_pylist():
                for w in wanted.intersection(words_of(text)):
                    n[w] += 1
            n[b""] = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in n]), pa.array(list(n.values()), pa.int64())],
                names=["word", "n"],
            )

    counts = narrow(docs, text=text_col).mapInArrow(run, "word string, n bigint").groupBy(
        "word").agg(F.sum("n").alias("n"))
    frequency = {r.word.encode(): r.n for r in stage(counts, "frequencies").collect()}
    return RareIndex(known, frequency, frequency.get(b"", 0))


def scan_licenses(docs: DataFrame, index: RareIndex, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    Words count from 0. ``n_base`` counts all places of the base phrases and the next two columns
    their smallest and largest start, null without any. Labels are distinct, sorted and joined by
    commas, empty without any; ``score`` is the best coverage of a found template, 0 without any;
    ``places`` lists every verified place. A null text counts as empty. Every row is judged alone
    on its whole text; nothing is shuffled. Columns of ``docs`` with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kinds = {
        "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(),
        "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(),
        "score": pa.float64(),
        "places": pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()),
                                      ("base", pa.bool_()), ("phrase", pa.string())])),
    }

    def run(texts: list) -> dict[str, pa.Array]:
        rows = [shared.value.scan(t) for t in texts]
        return {k: pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()}

    return append_columns(
        docs, text_col, run,
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string,"
        " labels string, score double,"
        " places array<struct<label:string,word:bigint,base:boolean,phrase:string>>",
    )
