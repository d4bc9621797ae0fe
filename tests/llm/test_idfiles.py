"""Exact round trips through the bit-packed files."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from saltmarsh.llm import idfiles, tokens
from saltmarsh.scratch import run_folder

VOCABULARY = tokens.Vocabulary.named()


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32), st.data())
def test_bits_round_trip(width, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << width) - 1), max_size=50)), np.uint32)
    packed = idfiles.pack_bits(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    assert packed == bytes(
        int("".join(f"{i:0{width}b}" for i in ids.tolist()).ljust(8 * len(packed), "0")[8 * n : 8 * n + 8], 2) for n in range(len(packed))
    )
    start = data.draw(st.integers(0, len(ids)))
    stop = data.draw(st.integers(start, len(ids)))
    assert idfiles.unpack_bits(packed, width, start, stop).tolist() == ids[start:stop].tolist()


def test_width():
    assert [idfiles.width_for(n) for n in (1, 2, 3, 256, 257, 50_257, 1 << 17)] == [1, 1, 2, 8, 9, 16, 17]


@pytest.mark.parametrize("name", ["odd", "clashing", "empty"])
def test_files(request, spark, name):
    docs = request.getfixturevalue(name)
    path = run_folder(spark, "ids-test")
    idfiles.write_ids(docs, VOCABULARY, path, end=2, block_ids=100)
    library = Tokenizer.from_str(VOCABULARY.content)
    found = sorted(idfiles.read_documents(spark, path, keep_ids=True).collect(), key=lambda r: r.start)
    stored = []
    for r in found:
        assert r.start == len(stored)
        assert r.ids[-1] == 2 and len(r.ids) == r.n_tokens
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        stored += r.ids
    keys = [r.doc_id for r in found]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    wanted = sorted((r.doc_id or 0, library.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect())
    assert sorted((r.doc_id or 0, list(r.ids)) for r in found) == wanted
    if stored:
        slice_ = idfiles.read_range(spark, path, 30, 180).orderBy("position").collect()
        assert [r.id for r in slice_] == stored[30:180]
