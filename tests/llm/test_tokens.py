"""Ids and counts equal those of the tokenizers library on whole texts."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from saltmarsh.llm import tokens

VOCABULARY = tokens.Vocabulary.named()
LIBRARY = Tokenizer.from_str(VOCABULARY.content)
ENCODER, COUNTER = tokens.Encoder(VOCABULARY), tokens.Counter(VOCABULARY)
PIECES = ["a", "the", "Über", " ", "  ", "\n", "\t", "'s", "'", "1", "23", ",", "\x1c", "\x85", "́", "日本", "😀", "<|endoftext|>", "<|end"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.text(max_size=20)), min_size=1, max_size=4))
def test_equal_to_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    wanted = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    ids, bounds = ENCODER.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == wanted
    assert COUNTER.counts(texts).tolist() == [len(w) for w in wanted]


def test_rare_units_are_dropped_and_learnt_again(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_UNITS", 20)
    encoder, counter = tokens.Encoder(VOCABULARY), tokens.Counter(VOCABULARY)
    for n in range(30):
        texts = [f"common word{n} other{n} thing{n}, common again common", "common"]
        ids, bounds = encoder.encode(texts, 2)
        wanted = [e.ids + [2] for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == wanted
        assert counter.counts(texts).tolist() == [len(w) - 1 for w in wanted]


def test_merge_count_merges_lowest_rank_first():
    # ranks: (1,2) before (2,3); 1 2 3 becomes 12 3, and 12 3 merges too.
    ranks = {(1, 2): (0, 12), (2, 3): (1, 23), (12, 3): (2, 123)}
    assert tokens.merge_count([1, 2, 3], ranks) == 1
    assert tokens.merge_count([2, 3, 1, 2], ranks) == 2
    assert tokens.merge_count([1, 1, 1], {(1, 1): (0, 11)}) == 2
    assert tokens.merge_count([], ranks) == 0


@pytest.mark.parametrize("name", ["odd", "clashing", "empty"])
def test_count_tokens(request, name):
    docs = request.getfixturevalue(name)
    found = tokens.count_tokens(docs, VOCABULARY, limit=12)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    wanted = sorted(
        (r.doc_id or 0, len((r.text or "").encode()), n := len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids), n > 12)
        for r in docs.collect()
    )
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect()) == wanted


def test_other_vocabulary_is_encoded_whole():
    words = tokens.Vocabulary.named("word_bpe_49k.json")
    assert not words.splits_at_blanks()
    ids, bounds = tokens.Encoder(words).encode(["Hello there,  you", ""])
    assert ids.tolist() == Tokenizer.from_str(words.content).encode("Hello there,  you", add_special_tokens=False).ids
    assert bounds[-1] == bounds[-2]
    assert np.all(np.diff(bounds) >= 0)
