"""Merkle manifests against plain loops, over blocks of several stages."""

import hashlib
import zlib

import pytest

from conftest import DOCUMENTS, rows
from saltmarsh.llm import manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, text, lang, source, n_chars):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, text)])


def climb(nodes, fanout):
    """The root, and for each node what stands before and after it on the way there."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            low = place - place % fanout
            run = nodes[low : low + fanout]
            paths[k].append(("".join(run[: place - low]), "".join(run[place - low + 1 :])))
            at[k] = place // fanout
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def by_hand(documents, fanout=2):
    langs = {}
    for row in documents:
        tampered = row[:4] + (row[4] + 1,) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None else row
        langs.setdefault(row[2], []).append(((row[0] is not None, row[0] or 0), leaf(*row), leaf(*tampered), row[0]))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    inside = {name: (sorted(langs[name], key=lambda x: x[:3]),) for name in names}
    inside = {name: (sorted_, *climb([x[1] for x in sorted_], fanout)) for name, (sorted_,) in inside.items()}
    root, above = climb([inside[name][1] for name in names], fanout) if names else (None, [])
    out = []
    for name, over in zip(names, above):
        for (_, own, tampered, doc), path in zip(inside[name][0], inside[name][2]):
            folded = tampered
            for before, after in path + over:
                folded = H(before, folded, after)
            proof = H(*[b + a for b, a in path + over])
            out.append((doc, own, inside[name][1], root, proof, folded, folded == root))
    return sorted(out, key=str)


def found(frame):
    return sorted(map(tuple, manifest.verified_documents(frame).collect()), key=str)


def many(number):
    return [(i, f"text {i % 50}", [None, "en", "é", "de", "en"][i % 5], "s", i) for i in range(number)] + [(1000, "lone", "xx", None, 4)]


@pytest.mark.parametrize("fanout,digits,number", [(2, 10, 90), (2, 1, 37), (2, 2, 200), (3, 2, 100), (4, 1, 65)])
def test_equals_plain_loops(spark, monkeypatch, fanout, digits, number):
    """Small blocks need several stages; some groups end in an earlier one than others."""
    for name, value in (("FANOUT", fanout), ("DIGITS", digits), ("BLOCK", fanout**digits)):
        monkeypatch.setattr(manifest, name, value)
    assert found(spark.createDataFrame(many(number), DOCUMENTS)) == by_hand(many(number), fanout)


def test_many_groups(spark, monkeypatch):
    for name, value in (("DIGITS", 2), ("BLOCK", 4)):
        monkeypatch.setattr(manifest, name, value)
    documents = [(i, "t", f"lang{i % 23}", "s", i) for i in range(60)]
    assert found(spark.createDataFrame(documents, DOCUMENTS)) == by_hand(documents)


def test_odd_documents(spark, odd, clashing, empty):
    """Nulls, empty texts and repeated rows; a manifest of nothing is empty."""
    assert found(odd) == by_hand(rows())
    assert found(clashing) == by_hand(rows())
    assert found(empty) == []
    one = [(5, "x", "en", "s", 2**63 - 1)]
    assert found(spark.createDataFrame(one, DOCUMENTS)) == by_hand(one)


def test_proofs_of_any_table(spark):
    """Other groups, orders and leaves; every path folds to the root."""
    frame = spark.range(300).selectExpr("id", "id % 3 AS part", "sha2(cast(id AS string), 256) AS h")
    proofs = manifest.prove(frame, "part", ["id"], "h")
    from pyspark.sql import functions as F

    assert proofs.filter(manifest.folded(F.col("h"), F.col("path")) == F.col("root")).count() == 300
    assert proofs.select("root").distinct().count() == 1 and proofs.columns == ["id", "part", "h", "subroot", "root", "path"]
