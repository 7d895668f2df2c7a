"""A Merkle manifest of a dataset: a tree of hashes per source, and one over the sources' roots.

Nodes of a tree are numbered by a range sort, whose ranges' counts are added up. A superblock is
``ARITY ** LEVELS`` neighbours of a tree. Upwards, each superblock is reduced to one node; these nodes
are the next table's leaves, until every tree has one node. Downwards, a superblock's nodes and the
outer nodes that its proofs need, gathered by the tables above, are cogrouped, and one function
finishes the local reduction, joins the inner and outer part of each proof and folds it. So no
task or group holds more than a superblock, and all proofs take one pass over the leaves.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotewright.llm.store import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ARITY = 3
LEVELS = 6
DIGEST = 64  # characters
WITHIN = (1 << 33) - 1  # the part of monotonically_increasing_id that counts rows of a partition


def encoded(value: Column) -> Column:
    """``-`` for NULL, else the length in UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def hash_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` neighbours until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def local_levels(nodes: list[str], levels: int) -> list[list[str]]:
    """A superblock's nodes and the ``levels`` rows of nodes above them."""
    out = [nodes]
    for _ in range(levels):
        now = out[-1]
        out.append([hash_text("".join(now[i:i + ARITY])) for i in range(0, len(now), ARITY)])
    return out


# A proof is a list of steps from the node upwards, written as text: the siblings on the left, "<",
# the siblings on the right, ">".


def local_proof(rows: list[list[str]], at: int) -> str:
    out = []
    for row in rows[:-1]:
        first = at - at % ARITY
        out += [*row[first:at], "<", *row[at + 1:first + ARITY], ">"]
        at //= ARITY
    return "".join(out)


def fold(node: str, proof: str) -> str:
    """What ``node`` and the siblings of its proof hash to."""
    for step in proof.split(">")[:-1]:
        left, right = step.split("<")
        node = hash_text(left + node + right)
    return node


def proof_siblings(proof: str) -> str:
    """All siblings of a proof, from the node upwards, each step's from left to right."""
    return proof.replace("<", "").replace(">", "")


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Stored ``nodes`` with ``at``, the place in their tree by ``order``, and ``n``, the tree's size.

    ``nodes`` has ``tree``, which is not NULL. The rows are dealt by ranges of (tree, order), so a large tree is spread
    over many ranges; what each range holds of a tree is counted and the counts before it are added.
    """
    ordered = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    placed = stored(
        nodes.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumns({"_range": F.shiftrightunsigned("_place", 33), "_place": F.col("_place").bitwiseAND(WITHIN)}), "placed")
    tree = Window.partitionBy("tree")
    ranges = stored(
        placed.groupBy("_range", "tree").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumns({
            "_before": F.coalesce(F.sum("_n").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "n": F.sum("_n").over(tree)})
        .drop("_n"), "ranges")
    return stored(
        placed.join(ranges, ["_range", "tree"])
        .withColumn("at", F.col("_before") + F.col("_place") - F.col("_first"))
        .drop("_range", "_place", "_first", "_before"), "numbered")


def _block(levels: int) -> Column:
    return F.floor(F.col("at") / ARITY ** levels).alias("block")


def _reduced(levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        n, at = int(block["n"].iloc[0]), int(block["at"].iloc[0])
        top = local_levels(block["node"].tolist(), min(levels, depth(n)))[-1]
        return pd.DataFrame({"tree": [block["tree"].iloc[0]], "at": [at // ARITY ** levels],
                             "n": [-(-n // ARITY ** levels)], "node": top})

    return run


def tables_upwards(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """``leaves`` (tree, at, n, node) and the superblocks' roots above them, stored, table by table.

    A tree's root is its node in the first table in which it has one node; it is not in later tables.
    """
    tables = [leaves]
    while True:
        open_ = tables[-1].where("n > 1").select("tree", "at", "n", "node")
        if open_.isEmpty():
            return tables
        roots = open_.groupBy("tree", _block(levels)).applyInPandas(_reduced(levels), "tree string, at long, n long, node string")
        tables.append(stored(roots, "roots"))


def _proved(levels: int, finish: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        above, subroot, root = outer["proof"].iloc[0], outer["subroot"].iloc[0], outer["root"].iloc[0]
        nodes, n = block["node"].tolist(), int(block["n"].iloc[0])
        rows = local_levels(nodes, min(levels, depth(n)))
        proofs = [local_proof(rows, i) for i in range(len(nodes))]
        if not finish:
            return pd.DataFrame({"tree": block["tree"], "at": block["at"], "proof": [p + above for p in proofs],
                                 "subroot": subroot, "root": root})
        siblings = proof_siblings(above)
        # Folding depends on the hash reached alone; above the block most leaves reach the same.
        reached = [fold(c, p) for c, p in zip(block["claimed"].tolist(), proofs)]
        tops = {r: fold(r, above) for r in set(reached)}
        return pd.DataFrame({
            "id": block["id"], "leaf": block["node"], "subroot": subroot, "root": root,
            "proof_sha256": [hash_text(proof_siblings(p) + siblings) for p in proofs],
            "folded_root": [tops[r] for r in reached]})

    return run


PROOF = "tree string, at long, proof string, subroot string, root string"
RESULT = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _descend(nodes: DataFrame, outer: DataFrame, levels: int, finish: bool = False) -> DataFrame:
    """The proofs of ``nodes``, or what they fold to, from those of their superblocks."""
    blocks = outer.withColumnRenamed("at", "block").groupBy("tree", "block")
    own = nodes.withColumn("block", _block(levels)).groupBy("tree", "block")
    return own.cogroup(blocks).applyInPandas(_proved(levels, finish), RESULT if finish else PROOF)


def _proofs(tables: list[DataFrame], finished: DataFrame, levels: int) -> DataFrame:
    """Proofs of the second table's nodes, and of the trees that end in the first (as ``at`` 0).

    ``finished`` has the proof of every tree's root (tree, proof, subroot, root).
    """
    outer = None
    for table in reversed(tables[1:]):
        ended = table.where("n = 1").select("tree", "at").join(finished, "tree").select("tree", "at", "proof", "subroot", "root")
        open_ = table.where("n > 1").select("tree", "at", "n", "node")
        outer = stored(ended if outer is None else ended.unionByName(_descend(open_, outer, levels)), "proofs")
    alone = tables[0].where("n = 1").select("tree", "at").join(finished, "tree").select("tree", "at", "proof", "subroot", "root")
    return stored(alone if outer is None else outer.unionByName(alone), "proofs")


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf.

    ``leaves`` has ``id`` (long), ``source`` (string, may be NULL), ``node`` (the leaf's hash) and ``claimed`` (the hash
    to be proved, say of a copy that may have been tampered with). Leaves of a source ascend by id, NULL first, and
    by hash where ids repeat; repeated rows are leaves each. Sources ascend by their bytes, NULL first.
    ``verified``: whether the claimed hash and the proof of the leaf give the root. Empty tables give an empty result.
    """
    keyed = leaves.select(
        "id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"), "node", "claimed")
    base = numbered(stored(keyed, "leaves"), ["id", "node", "claimed"])
    tables = tables_upwards(base, levels)
    subroots = tables[0].where("n = 1").select("tree", "node")
    for table in tables[1:]:
        subroots = subroots.unionByName(table.where("n = 1").select("tree", "node"))
    top = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node"), ["source"])
    top_tables = tables_upwards(top, levels)
    roots = top_tables[-1].where("n = 1").select("tree", F.lit("").alias("proof"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    top_proofs = _descend(top, _proofs(top_tables, roots, levels), levels)
    finished = stored(
        top.select("at", "source", F.col("node").alias("subroot"))
        .join(top_proofs.select("at", "proof", "root"), "at")
        .select(F.col("source").alias("tree"), "proof", "subroot", "root"), "subroots")
    return _descend(base, _proofs(tables, finished, levels), levels, finish=True).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
