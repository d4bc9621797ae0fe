"""Merkle manifest of a table: a tree per group, a tree over the groups, a proof per row.

H is SHA-256 as lowercase hex text over its inputs, one after another; digests enter
as hex text. A leaf is H over the fields of a row, each written as its length in
bytes, a colon and its value, or as ``-`` for null. The leaves of a group stand in
the order of a key. While a group has several nodes, every ``FANOUT`` consecutive
ones become the H of them, the last ones too if they are fewer. The roots of the
groups, in the order of the group value, are the leaves of the last tree.

The rank of a leaf is read as digits. Blocks of ``FANOUT ** DIGITS`` leaves are rolled
up by grouping the last digit away, again and again: each step nests the structs of
its children below their H. All steps of a block share one shuffle by block, and a
group of any size is many blocks. Roots of blocks are ranked by block number and
are rolled up in the same way, until every group is one node. On the way down, the
nested struct of a block is unfolded by nested transforms into its leaves, each
with the hashes beside its path: no join of leaves with nodes or with each other.
Only whole blocks meet what stands above them, one row per block.

Null keys come first, rows with one key follow the order of their leaves, and rows
equal in all fields each have a leaf. Null and empty texts are different values. An
empty table gives no rows. Columns that are no field are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from saltmarsh.operators.rows import materialise, number_rows

FANOUT = 2
DIGITS = 10
BLOCK = FANOUT**DIGITS
STEP = "struct<before: string, after: string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(*fields: Column) -> Column:
    """H over the fields; numbers are written in decimal."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _nodes_at(level: int) -> Column:
    """Nodes that a group of ``n`` has after so many steps."""
    return F.ceil(F.col("n") / F.lit(FANOUT**level))


def _levels(most: int) -> int:
    """Steps that a block needs where the largest group has ``most`` nodes."""
    levels = 0
    while levels < DIGITS and FANOUT**levels < most:
        levels += 1
    return levels


def _rolled(nodes: DataFrame, levels: int) -> DataFrame:
    """Blocks (g, n, block, node) of (g, n, rank, node) rows, the struct of a node holding its children."""
    block, digits = F.floor(F.col("rank") / BLOCK), F.col("rank") % BLOCK
    out = nodes.select("g", "n", block.alias("block"), digits.alias("digits"), "node").repartition("g", "n", "block")
    for level in range(levels):
        children = F.sort_array(F.collect_list(F.struct(F.col("digits").alias("at"), "node")))
        up = F.floor(F.col("digits") / FANOUT).alias("digits")
        out = out.groupBy("g", "n", "block", up).agg(F.transform(children, lambda c: c["node"]).alias("below"))
        joined = F.array_join(F.transform("below", lambda c: c["h"]), "")
        h = F.when(_nodes_at(level) > 1, digest(joined)).otherwise(F.col("below")[0]["h"])
        out = out.select("g", "n", "block", "digits", F.struct(h.alias("h"), "below").alias("node"))
    return out.drop("digits")


def _unfolded(node: Column, level: int, path: Column) -> Column:
    """(item, path) of all leaves below a node that stands so many steps above them."""
    if not level:
        return F.array(F.struct(node["item"].alias("item"), path.alias("path")))

    def child(below: Column, at: Column) -> Column:
        def hashes(part: Column) -> Column:
            return F.array_join(F.transform(part, lambda c: c["h"]), "")

        siblings = node["below"]
        step = F.struct(
            hashes(F.slice(siblings, F.lit(1), at)).alias("before"),
            hashes(F.slice(siblings, at + 2, F.lit(FANOUT))).alias("after"),
        )
        own = F.when(_nodes_at(level - 1) > 1, F.array(step)).otherwise(F.array().cast(f"array<{STEP}>"))
        return _unfolded(below, level - 1, F.concat(own, path))

    return F.flatten(F.transform(node["below"], child))


def _climb(nodes: DataFrame) -> tuple[DataFrame, list[tuple[DataFrame, int]]]:
    """One node per group (g, h), and the blocks of every stage with their steps, the lowest stage first."""
    stages = []
    while True:
        most = nodes.agg(F.max("n")).first()[0] or 0
        levels = _levels(most)
        blocks = materialise(_rolled(nodes, levels), "blocks")
        stages.append((blocks, levels))
        if most <= BLOCK:
            return blocks.select("g", F.col("node")["h"].alias("h")), stages
        above = F.struct(F.col("node")["h"].alias("h"), F.col("block").alias("item"))
        nodes = blocks.select("g", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("rank"), above.alias("node"))


def _descend(above: DataFrame, stages: list[tuple[DataFrame, int]], carried: Sequence[str]) -> DataFrame:
    """carried columns, item and path of all leaves; ``above`` has g, path and the carried columns, a row per group."""
    found = above.select("g", F.lit(0).cast("long").alias("block"), "path", *carried)
    for blocks, levels in reversed(stages):
        met = blocks.withColumnRenamed("g", "_g").withColumnRenamed("block", "_block")
        both = met.join(found, F.col("_g").eqNullSafe(F.col("g")) & (F.col("_block") == F.col("block")))
        leaves = both.select("g", *carried, F.inline(_unfolded(F.col("node"), levels, F.col("path"))))
        found = leaves.withColumnRenamed("item", "block")
    return found.withColumnRenamed("block", "item")


def prove(leaves: DataFrame, group: str, order: Sequence[str], leaf: str) -> DataFrame:
    """The rows with subroot, root and path: what stands before and after the node in each step up to the root.

    Rows are ranked by ``order`` within their group; give it enough columns to make
    the order whole. The columns of ``leaves`` must not be named subroot, root or path.
    """
    columns = leaves.columns
    item = F.struct(*[F.col(c) for c in columns])
    plain = leaves.select(F.col(group).alias("g"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(leaf).alias("h"), item.alias("item"))
    numbered = number_rows(plain, ["g", *[f"o{i}" for i in range(len(order))]], "place")
    groups = materialise(numbered.groupBy("g").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n")), "groups")
    own = groups.withColumnRenamed("g", "_g")
    ranked = numbered.join(own, F.col("_g").eqNullSafe(F.col("g")))
    node = F.struct("h", "item").alias("node")
    subroots, stages = _climb(ranked.select("g", "n", (F.col("place") - F.col("least")).alias("rank"), node))

    count = groups.count()
    over = number_rows(subroots, ["g"], "rank").select(
        F.lit(0).alias("g"), F.lit(count).cast("long").alias("n"), "rank", F.struct("h", F.struct("g", F.col("h").alias("subroot")).alias("item")).alias("node")
    )
    top, over_stages = _climb(over)
    start = top.select("g", F.col("h").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    per_group = _descend(start, over_stages, ["root"]).select("item.g", "item.subroot", "root", "path")
    found = _descend(per_group, stages, ["subroot", "root"])
    return found.select("item.*", "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the hashes beside its path lead to."""
    return F.aggregate(path, leaf, lambda h, step: digest(step["before"], h, step["after"]))


def path_digest(path: Column) -> Column:
    """H of all hashes beside a path, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame, every: int = 7) -> DataFrame:
    """doc_id, lang, leaf, and the leaf after tampering: n_chars is one too many in the rows whose crc32 ``every`` divides."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    tampered = leaf_of(*[more if name == "n_chars" else F.col(name) for name in FIELDS])
    return docs.select("doc_id", "lang", leaf_of(*[F.col(n) for n in FIELDS]).alias("leaf"), F.when(hit, tampered).alias("tampered"))


def verified_documents(docs: DataFrame) -> DataFrame:
    """Every document with its leaf, roots, the digest of its proof, and the root its tampered leaf leads to."""
    leaves = materialise(document_leaves(docs), "leaves")
    proofs = prove(leaves, "lang", ["doc_id", "leaf", "tampered"], "leaf")
    root = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = proofs.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
