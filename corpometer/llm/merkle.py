"""Merkle manifest of a table: a hash tree per group under one root, and what each changed row does to the root.

Trees are persistent: a tampered leaf makes a version that shares every untouched node with the tree it comes from
and copies only its ancestors. The leaves of a group lie in aligned blocks of 2^8, the roots of these in blocks of
2^8 again, and so on; every block is a row of its own. A version's copies inside the leaf's block are made there, and
its upper ones, up to the root of all, from the block's root on, each with the sibling that all versions of the block
share. A leaf that has not changed is folded by its own steps, so that every row's root is worked out from the row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpometer.llm.common import to_arrow
from corpometer.operators.joins import attach
from corpometer.operators.ranks import position
from corpometer.session import stored

BLOCK_LEVELS = 8
ALONE = "-"  # the step of a node that has no sibling


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@dataclass(frozen=True)
class Tree:
    """The levels of a block, leaves first; pairs of neighbours, or a last one alone, make the level above."""

    levels: list[list[str]]

    @classmethod
    def of(cls, leaves: list[str], height: int | None = None) -> Tree:
        """A tree of ``height`` levels above the leaves, or of as many as it takes to reach one node."""
        levels = [leaves]
        while len(levels) <= height if height is not None else len(levels[-1]) > 1:
            nodes = levels[-1]
            levels.append([digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)])
        return cls(levels)

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def steps(self, leaf: int) -> list[str]:
        """What each level on the way up joins to the node: L or R and the sibling's hash, or a dash for none."""
        found = []
        for nodes in self.levels[:-1]:
            sibling = leaf ^ 1
            found.append((("L" if sibling < leaf else "R") + nodes[sibling]) if sibling < len(nodes) else ALONE)
            leaf >>= 1
        return found

    def changed(self, leaf: int, value: str) -> Version:
        """The version whose one leaf has another value: its ancestors are copied, all else is this tree's."""
        copies = [value]
        place = leaf
        for nodes in self.levels[:-1]:
            pair = [copies[-1] if i == place else nodes[i] for i in range(place & ~1, min((place | 1) + 1, len(nodes)))]
            copies.append(digest(*pair))
            place >>= 1
        return Version(self, leaf, copies)


@dataclass(frozen=True)
class Version:
    """A tree that differs from ``base`` in the nodes above one leaf, of which it holds copies, lowest first."""

    base: Tree
    leaf: int
    copies: list[str]

    @property
    def root(self) -> str:
        return self.copies[-1]

    def raised(self, steps: Sequence[str]) -> Version:
        """This version of a block up to the root of all: it copies the block's ancestors too, along ``steps``.

        Every copy is made of the copy below it and the sibling that the version shares with the tree it comes from.
        """
        copies = list(self.copies)
        for step in steps:
            copies.append(continued(copies[-1], [step]))
        return Version(self.base, self.leaf, copies)

    def node(self, level: int, place: int) -> str:
        return self.copies[level] if place == self.leaf >> level else self.base.levels[level][place]


def continued(node: str, steps: Sequence[str]) -> str:
    """The root above a node, by the steps on its way."""
    for step in steps:
        node = digest(node) if step == ALONE else digest(step[1:], node) if step[0] == "L" else digest(node, step[1:])
    return node


def field(value: Column) -> Column:
    """A value and its number of UTF-8 bytes; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit(ALONE))


def leaf_of(*values: Column) -> Column:
    """Hash of the values of a row, in order."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _grouped(nodes: DataFrame, levels: int, *columns: str) -> DataFrame:
    """(g, block, blocks, nodes): aligned blocks of 2^levels nodes (g, at, ...), and how many blocks the group has.

    The array of a block is in the order of the nodes and has 2^levels entries at most.
    """
    rows = nodes.withColumn("block", F.shiftright("at", levels))
    blocks = stored(rows.groupBy("g", "block").agg(F.sort_array(F.collect_list(F.struct("at", *columns))).alias("nodes")), "blocks")
    return attach(blocks, stored(blocks.groupBy("g").agg((F.max("block") + 1).alias("blocks")), "sizes"), ["g"])


def _raised(blocks: DataFrame, levels: int, with_steps: bool) -> DataFrame:
    """(g, block, blocks, root, steps): a block of several is raised by all levels, a sole one until a node remains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, steps = [], []
            for nodes, count in zip(batch.column("nodes"), batch.column("blocks").to_pylist(), strict=True):
                tree = Tree.of(nodes.as_py(), levels if count > 1 else None)
                roots.append(tree.root)
                steps.append([tree.steps(i) for i in range(len(nodes))] if with_steps else [])
            values = [batch.column(n) for n in ("g", "block", "blocks")]
            values += [pa.array(roots, pa.string()), pa.array(steps, pa.list_(pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays(values, names=["g", "block", "blocks", "root", "steps"])

    hashes = F.transform("nodes", lambda n: n["hash"]).alias("nodes")
    raised = blocks.select("g", "block", "blocks", hashes)
    return stored(raised.mapInArrow(run, "g string, block long, blocks long, root string, steps array<array<string>>"), "raised")


def _upper(raised: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Roots (g, root) of all groups, and the steps (g, block, steps) from the root of each block to its group's."""
    sole = raised.where("blocks = 1")
    roots = sole.select("g", "root")
    steps = sole.select("g", "block", F.array().cast("array<string>").alias("steps"))
    many = raised.where("blocks > 1")
    if many.isEmpty():
        return roots, steps
    more_roots, more_steps = _climbed(many.select("g", F.col("block").alias("at"), F.col("root").alias("hash")), levels)
    return roots.unionByName(more_roots), steps.unionByName(more_steps.withColumnRenamed("at", "block"))


def _climbed(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Roots (g, root) of the groups of nodes (g, at, hash), and the steps (g, at, steps) from each node to its root.

    Every call has 2^levels times fewer nodes than the one before.
    """
    raised = _raised(_grouped(nodes, levels, "hash"), levels, with_steps=True)
    roots, upper = _upper(raised, levels)
    upper = stored(upper.withColumnRenamed("steps", "upper"), "upper")
    whole = attach(raised, upper, ["g", "block"], how="inner")
    own = whole.select("g", "block", "upper", F.posexplode("steps").alias("i", "lower"))
    at = (F.shiftleft("block", levels) + F.col("i")).alias("at")
    return roots, stored(own.select("g", at, F.concat("lower", "upper").alias("steps")), "steps")


def manifest(
    rows: DataFrame, leaf: Column, tampered: Column, by: str = "lang", order: str = "doc_id", block_levels: int = BLOCK_LEVELS
) -> DataFrame:
    """One row per row of ``rows``: ``order``, leaf, subroot, root, proof, folded_root, verified.

    Rows with one value of ``by``, null included, make a tree over their leaves in the order of ``order`` (nulls
    first, equal values by leaf). Its subroots, in the order of ``by`` (null first, by UTF-8 bytes), make the tree
    above them. The proof has the hashes of all siblings from the leaf to the root. ``tampered`` is the hash of
    the row as it is found now, or null where nothing has changed; folded_root is the root of the version that it
    makes, or else the one that the leaf and its siblings fold to, and verified tells whether that is the root. Repeated rows are leaves of their own; an empty table
    gives an empty result. Columns that the expressions do not name are not read.

    Texts are read once, for the leaves. Leaves are numbered without a window over a group, so a group may hold
    any share of the rows. A task holds blocks of 2^block_levels nodes.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("g")
    leaves = stored(rows.select(group, F.col(order).alias("id"), leaf.alias("hash"), tampered.alias("found")), "leaves")
    placed = position(leaves, "id", by=["g"], ties=["hash"], name="place").withColumn("at", F.col("place") - 1)
    blocks = _grouped(placed, block_levels, "id", "hash", "found")
    roots, steps = _upper(_raised(blocks, block_levels, with_steps=False), block_levels)

    trees = stored(position(roots, "g", name="place").select("g", "root", (F.col("place") - 1).alias("at")), "subroots")
    top, over = _climbed(trees.select(F.lit("").alias("g"), "at", F.col("root").alias("hash")), block_levels)
    over = over.select("at", F.col("steps").alias("over"))
    trees = attach(trees, over, ["at"], how="inner").select("g", F.col("root").alias("subroot"), "over")
    paths = attach(steps, stored(trees, "trees"), ["g"], how="inner")
    paths = stored(paths.select("g", "block", "subroot", F.concat("steps", "over").alias("steps")), "paths")
    whole = attach(blocks, paths, ["g", "block"], how="inner").withColumn("root", top.select("root").scalar())
    return _verified(whole, order, rows.schema[order].dataType, block_levels)


def _verified(blocks: DataFrame, order: str, kind: T.DataType, levels: int) -> DataFrame:
    """Blocks with their steps to the root, leaf by leaf: each proof, and the root of each version."""
    id_type, texts = to_arrow(kind), ("leaf", "subroot", "root")
    schema = T.StructType([T.StructField(order, kind), *T.StructType.fromDDL(
        "leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean"
    )])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                nodes, blocks_, subroot, root, upper = (batch.column(n)[i].as_py() for n in ("nodes", "blocks", "subroot", "root", "steps"))
                tree = Tree.of([n["hash"] for n in nodes], levels if blocks_ > 1 else None)
                proofs, folded = [], []
                for at, n in enumerate(nodes):
                    steps = [*tree.steps(at), *upper]
                    proofs.append([s[1:] for s in steps if s != ALONE])
                    # A leaf that nothing has changed folds by its own steps as well: its root is found, not taken.
                    folded.append(continued(n["hash"], steps) if n["found"] is None else tree.changed(at, n["found"]).raised(upper).root)
                values = [
                    pa.array([n["id"] for n in nodes], id_type), *(pa.array(v, pa.string()) for v in (tree.levels[0], [subroot] * len(nodes), [root] * len(nodes))),
                    pa.array(proofs, pa.list_(pa.string())), pa.array(folded, pa.string()), pa.array([f == root for f in folded]),
                ]
                yield pa.RecordBatch.from_arrays(values, names=[order, *texts, "proof", "folded_root", "verified"])

    return blocks.select("nodes", "blocks", "subroot", "root", "steps").mapInArrow(run, schema)
