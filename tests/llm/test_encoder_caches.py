"""What the encoders of token files and pieces keep, and when cycles are looked for."""

import gc
import itertools
import random

import public_tokenizers
import pytest
from sentencepiece import sentencepiece_model_pb2

from peerband.llm import pieces, token_files


def test_letters_are_kept_once_whatever_their_tail():
    encoder = token_files.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one word, word. word (word) wörd, wörd\nword word,\nwörd", "word", " word  two\n\nx"]
    got = list(encoder.encode(texts))
    whole = encoder.tokenizer
    for text, code in zip(texts, got):
        assert code == token_files.array(
            "I", whole.encode(text, add_special_tokens=False).ids).tobytes()
    # Once as a chunk; as a part only without the space, after a line end.
    assert "word" in encoder.chunks and " word" not in encoder.parts
    assert "wörd" in encoder.chunks and " wörd" not in encoder.parts


def test_no_search_for_cycles_within_a_batch():
    assert gc.isenabled()
    with pytest.raises(KeyError), pieces.uncollected():
        assert not gc.isenabled()
        raise KeyError
    assert gc.isenabled()


@pytest.mark.parametrize("word", ["▁a", "▁", "▁don't", "▁naïve漢字x", "▁▁x1!?é", "▁" + "ab漢" * 60])
def test_words_are_cut_where_no_piece_spans(word):
    vocab = pieces.MergeVocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    want = vocab.library.encode(word[1:]) if word != "▁" else list(vocab.part_ids(word))
    assert list(vocab.word_ids(word)) == want


def test_fallback_symbols_among_pieces_are_written_as_their_bytes():
    vocab = pieces.MergeVocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["▁word͸,͸", "▁naïve\U0001f9ff", "▁" + "a,͸" * 3000]
    for word, (ids, text) in vocab.learn(set(words)).items():
        assert list(ids) == vocab.library.encode(word[1:])
        # The text of an id is made once for the vocabulary, not once for each use.
        assert text == ",".join(vocab.shown[i] for i in ids)


def test_new_words_are_merged_side_by_side(monkeypatch):
    vocab = pieces.MergeVocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    words = {"▁" * rng.choice((1, 1, 1, 3))
             + "".join(rng.choices("theaonrsing.é漢\n͸\U0001f9ff", k=rng.randrange(60)))
             for _ in range(3000)} | {"▁", "▁▁"}
    want = {w: vocab.word_ids(w) for w in words}
    calls = []
    merge = vocab.merge
    monkeypatch.setattr(vocab, "merge", lambda part: calls.append(part) or merge(part))
    monkeypatch.setattr(pieces, "TABLE_ROWS", 100)
    vocab.parts = pieces.Recent()
    known = vocab.learn(words)
    assert {w: tuple(ids) for w, (ids, _) in known.items()} == want
    assert all(text == ",".join(map(str, ids)) for ids, text in known.values())
    # Merged one at a time are only the parts of long words.
    long = [w for w in words if len(w) > pieces.SHORT]
    assert long and all(any(part in w for w in long) for part in calls)
    calls.clear()
    vocab.learn({"▁merged", "▁beside", "▁others"})
    assert not calls


def test_equal_scores_merge_from_the_left_and_characters_need_not_be_pieces(tmp_path):
    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = model.trainer_spec.BPE
    model.trainer_spec.byte_fallback = True
    model.normalizer_spec.remove_extra_whitespaces = False
    model.pieces.add(piece="<unk>", score=0, type=2)
    for b in range(256):
        model.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    for piece, score in (("ba", -1), ("ab", -1), ("cd", -1), ("cda", -2), ("▁a", -3), ("▁", -9),
                         ("a", -9), ("b", -9), ("d", -9)):
        model.pieces.add(piece=piece, score=score, type=1)
    path = tmp_path / "small.model"
    path.write_bytes(model.SerializeToString())
    vocab = pieces.MergeVocabulary(str(path))
    words = {"▁" + "".join(w) for n in range(6) for w in itertools.product("abcd", repeat=n)}
    for word, (ids, _) in vocab.learn(words).items():
        assert tuple(ids) == vocab.word_ids(word)
        assert ids == vocab.library.encode(word[1:]) or word == "▁"
