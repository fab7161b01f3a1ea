"""SentencePiece encoding for merge-type vocabularies, and decoding.

A text is a row of symbols, one for each character. The agenda holds the adjacent pairs whose
union is a piece, by score and then from the left; the first pair is merged and its new
neighbours join the agenda until none is left. Symbols that are no piece fall back to their bytes.

Three exact shortcuts keep the work small. No piece spans words, and their ids are kept. New words
of up to 48 characters are rows of a table, each with an agenda of its own: a round merges the first
pair of every row. In longer ones no piece spans two neighbouring characters that stand nowhere side
by side in the vocabulary, so they are cut there, and the ids of cut parts are kept. Every word seen
for the first time is encoded by the ``sentencepiece`` library too, in batches, and a difference is
an error.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from peerband.llm.common import append_columns, resident, slabs

SPACE = "▁"
#: Characters up to which the agenda is a plain list, which is faster than a heap there.
SHORT = 48
#: New words up to that length are merged in tables of these widths and at most so many rows.
WIDTHS, TABLE_ROWS = (6, 8, 10, 12, 16, 24, SHORT), 1 << 14
#: Entries of the young half of each cache of a Python worker, and characters of the longest word
#: that is kept: text without spaces is one word, and is not.
CACHE_PARTS, CACHE_CHARS = 250_000, 64
#: Characters of text that are split into words at once.
SLAB_CHARS = 1 << 20
NORMAL, BYTE = 1, 6


class Recent:
    """A bounded cache in two halves: what is used again moves to the young one, and when that is
    full it becomes the old one and the former old one is forgotten."""

    def __init__(self, size: int = CACHE_PARTS) -> None:
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.young[key] = found
        return found

    def put(self, key: str, value) -> None:
        if len(key) <= CACHE_CHARS:
            self.young[key] = value

    def age(self) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


class MergeVocabulary:
    """Pieces, scores and the library's processor of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if (model.trainer_spec.model_type != model.trainer_spec.BPE
                or not model.trainer_spec.byte_fallback or rules.precompiled_charsmap
                or rules.remove_extra_whitespaces or not rules.add_dummy_prefix
                or not rules.escape_whitespaces):
            raise ValueError(f"{path}: only byte-fallback merge models without normalisation")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.ranks = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {
            int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE
        }
        self.shown = [str(i) for i in range(len(model.pieces))]
        # For many words at once: a symbol is the id of its piece, or beyond ``none``, which makes a
        # piece with no other, the character that is no piece.
        self.none = len(model.pieces)
        self.base = self.none + 2 + sys.maxunicode
        self.numbers = np.array(range(self.none), object)
        self.shown_ids = np.array(self.shown, object)
        self.order = np.full(self.none + 1, np.inf, np.float32)
        self.of_point = np.arange(self.none + 1, self.base, dtype=np.int32)
        for p, i in self.ids.items():
            self.order[i] = self.ranks[p]
            if len(p) == 1:
                self.of_point[ord(p)] = i

        def symbol(part: str) -> int | None:
            return int(self.of_point[ord(part)]) if len(part) == 1 else self.ids.get(part)

        made = {}
        for p, i in self.ids.items():
            for left, right in ((symbol(p[:k]), symbol(p[k:])) for k in range(1, len(p))):
                if left is not None and right is not None:
                    made[left * self.base + right] = i
        keys = sorted(made)
        # One key above all, so that what is looked up always has a place.
        self.union_keys = np.array([*keys, self.base ** 2], np.int64)
        self.union_ids = np.array([*map(made.get, keys), self.none], np.int32)
        self.pairs = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        # A word starts at a space symbol that no space symbol precedes.
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError(f"{path}: a piece spans words")
        self.words = Recent()  # (ids, ids as text) of each word
        self.parts = Recent()

    def merge(self, part: str) -> list[str]:
        """Symbols left when no adjacent pair is a piece."""
        return self._short(part) if len(part) <= SHORT else self._long(part)

    def _short(self, part: str) -> list[str]:
        none = float("inf")
        rank = self.ranks.get
        symbols = list(part)
        agenda = list(map(rank, map(add, part, part[1:]), repeat(none)))
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            union = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(union + symbols[i + 1], none)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + union, none)
        return symbols

    def _long(self, part: str) -> list[str]:
        rank = self.ranks.get
        symbols: list[str | None] = list(part)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []

        def propose(i: int, j: int) -> None:
            union = symbols[i] + symbols[j]
            if (r := rank(union)) is not None:
                heapq.heappush(agenda, (r, i, j, union))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, i, j, union = heapq.heappop(agenda)
            # Stale unless both ends are still the symbols that were proposed.
            if symbols[i] is None or symbols[j] is None or symbols[i] + symbols[j] != union:
                continue
            symbols[i], symbols[j] = union, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                propose(i, after[i])
            if before[i] >= 0:
                propose(before[i], i)
        return [s for s in symbols if s is not None]

    def _unions(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each two symbols make; ``self.none`` where they make none."""
        keys = left.astype(np.int64) * self.base + right
        at = self.union_keys.searchsorted(keys)
        return np.where(self.union_keys[at] == keys, self.union_ids[at], self.none)

    def _side_by_side(self, symbols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left of rows of ``n`` symbols each: all ids, and how many of them a row has.

        Every row has an agenda of its own, and each round merges the first pair of each. Rows
        begin with ``self.none`` and are filled up with it, once at least.
        """
        out, n, rows = np.empty_like(symbols), n.copy(), np.arange(len(n))
        unions = self._unions(symbols[:, :-1], symbols[:, 1:])
        agenda = self.order[unions]
        while rows.size:
            at, every = agenda.argmin(axis=1), np.arange(rows.size)
            more = agenda[every, at] < np.inf
            if not more.all():
                width = symbols.shape[1] - 1
                out[rows[~more], :width] = symbols[~more, 1:]
                rows, at, every = rows[more], at[more], every[:np.count_nonzero(more)]
                symbols, unions, agenda = symbols[more], unions[more], agenda[more]
            n[rows] -= 1
            symbols[every, at] = unions[every, at]
            place, past = np.arange(symbols.shape[1] - 1), at[:, None]
            symbols = np.where(place > past, symbols[:, 1:], symbols[:, :-1])
            gone = place[:-1] >= past
            unions = np.where(gone, unions[:, 1:], unions[:, :-1])
            agenda = np.where(gone, agenda[:, 1:], agenda[:, :-1])
            for i in (at - 1, at):
                unions[every, i] = new = self._unions(symbols[every, i], symbols[every, i + 1])
                agenda[every, i] = self.order[new]
        return out[np.arange(out.shape[1]) < n[:, None]], n

    def _spelled(self, symbols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, characters that are no piece as their bytes, and their number by row."""
        plain = symbols < self.none
        if plain.all():
            return symbols, n
        points = (symbols[~plain] - (self.none + 1)).tolist()
        found = [[self.bytes[b] for b in chr(x).encode("utf-8")] for x in points]
        sizes = np.ones(symbols.size, np.int64)
        sizes[~plain] = list(map(len, found))
        ids = symbols.repeat(sizes)
        ids[~plain.repeat(sizes)] = list(chain.from_iterable(found))
        return ids, np.add.reduceat(sizes, n.cumsum() - n)

    def short_ids(self, words: list[str]) -> Iterator[tuple[list[int], str]]:
        """(ids, ids as text) of words of at most ``SHORT`` characters, sorted by their length."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        symbols, begins = self.of_point[points], np.append(0, n.cumsum())
        ends = n.searchsorted(WIDTHS, "right").tolist()
        tables = [(width, first, min(first + TABLE_ROWS, end))
                  for width, begin, end in zip(WIDTHS, [0, *ends], ends)
                  for first in range(begin, end, TABLE_ROWS)]
        for width, first, last in tables:
            own, place = n[first:last], np.arange(width + 2)
            table = np.full((last - first, width + 2), self.none, np.int32)
            table[(place > 0) & (place <= own[:, None])] = symbols[begins[first]:begins[last]]
            ids, sizes = self._spelled(*self._side_by_side(table, own))
            numbers, shown = self.numbers[ids].tolist(), self.shown_ids[ids].tolist()
            end = 0
            for size in sizes.tolist():
                begin, end = end, end + size
                yield numbers[begin:end], ",".join(shown[begin:end])

    def told(self, word: str) -> tuple[list[int], str]:
        """(ids, ids as text) of a word of any length."""
        ids = self.word_ids(word)
        return list(ids), ",".join(map(self.shown.__getitem__, ids))

    def part_ids(self, part: str) -> tuple[int, ...]:
        found = self.parts.get(part)
        if found is None:
            symbols = self.merge(part)
            found = tuple(map(self.ids.get, symbols))
            if None in found:
                found = tuple(chain.from_iterable(
                    [self.bytes[b] for b in symbol.encode("utf-8")] if at is None else (at,)
                    for symbol, at in zip(symbols, found)
                ))
            self.parts.put(part, found)
        return found

    def word_ids(self, word: str) -> tuple[int, ...]:
        """Ids of one run of space symbols and what follows it."""
        joints = list(map(add, word, word[1:]))
        pairs = self.pairs
        if pairs.issuperset(joints):
            return self.part_ids(word)
        ids, begin = [], 0
        for i, p in enumerate(joints, 1):
            if p not in pairs:
                ids.extend(self.part_ids(word[begin:i]))
                begin = i
        ids.extend(self.part_ids(word[begin:]))
        return tuple(ids)

    def learn(self, words: set[str]) -> dict[str, tuple[list[int], str]]:
        """(ids, ids as text) of each word. New words are encoded, and compared with the library's
        ids in one batch."""
        self.words.age()
        self.parts.age()
        known = dict(zip(words, map(self.words.young.get, words)))
        new = []
        for word in [w for w, found in known.items() if found is None]:
            known[word] = found = self.words.get(word)
            if found is None:
                new.append(word)
        new.sort(key=len)
        # The library itself puts the first space symbol there.
        theirs = self.library.encode([w[1:] for w in new], num_threads=1) if new else []
        short = bisect_right(new, SHORT, key=len)
        own = chain(self.short_ids(new[:short]), map(self.told, new[short:]))
        for word, found, ids in zip(new, own, theirs):
            # A space symbol alone can't be asked for: the library takes it for an empty text.
            if found[0] != ids and word != SPACE:
                raise ValueError(f"ids of {word!r}: {found[0]} here, {ids} by the library")
            known[word] = found
            self.words.put(word, found)
        return known

    _WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")

    def split(self, text: str | None) -> list[str]:
        """Words of a text with the space symbol that the model puts first; none if it is empty."""
        if not text:
            return []
        return self._WORDS.findall(SPACE + text.replace(" ", SPACE))

    def encode(self, text: str | None) -> list[int]:
        words = self.split(text)
        known = self.learn(set(words))
        return list(chain.from_iterable([known[w][0] for w in words]))


def vocabulary(path: str) -> MergeVocabulary:
    return resident("pieces", path, lambda: MergeVocabulary(path))


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


@contextmanager
def uncollected():
    """No search for cycles within: what is made here has none, and the caches are large."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encode_pieces(
    docs: DataFrame, model: str, text_col: str = "text", digests: bool = False
) -> DataFrame:
    """``docs`` with n_tokens, ids and decoded, or instead of these two their digests.

    A null text counts as empty and has no ids. Every row is its own; nothing is shuffled. With
    ``digests`` the columns are ids_sha256 (of decimal ids joined by commas) and decoded_sha256
    (of UTF-8). Columns of ``docs`` with these names are replaced. ``model`` is the vocabulary
    file, which must be readable on the executors.
    """

    def run(texts: list) -> dict[str, pa.Array]:
        with uncollected():
            return encoded(texts)

    def encoded(texts: list) -> dict[str, pa.Array]:
        vocab = vocabulary(model)
        n, ids, decoded = [], [], []
        for slab in slabs(texts, SLAB_CHARS):
            split = [vocab.split(t) for t in slab]
            known = vocab.learn(set(chain.from_iterable(split)))
            for words in split:
                found = [known[w] for w in words]
                own = list(chain.from_iterable([w[0] for w in found]))
                back = vocab.library.decode(own) if own else ""
                n.append(len(own))
                ids.append(_sha256(",".join([w[1] for w in found])) if digests else own)
                decoded.append(_sha256(back) if digests else back)
        if digests:
            return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()),
                    "decoded_sha256": pa.array(decoded, pa.string())}
        return {"n_tokens": pa.array(n, pa.int64()),
                "ids": pa.array(ids, pa.list_(pa.int32())),
                "decoded": pa.array(decoded, pa.string())}

    columns = "ids_sha256 string, decoded_sha256 string" if digests else (
        "ids array<int>, decoded string")
    return append_columns(docs, text_col, run, f"n_tokens bigint, {columns}")


def decode_pieces(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the library's text for a list of ids; null ids give empty text."""

    def run(lists: list) -> dict[str, pa.Array]:
        library = vocabulary(model).library
        return {"decoded": pa.array([library.decode(x) if x else "" for x in lists], pa.string())}

    return append_columns(rows, ids_col, run, "decoded string")

