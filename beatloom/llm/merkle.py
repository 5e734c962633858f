"""Merkle manifest of a dataset, its upper levels built by a butterfly exchange.

Rows are leaves, ordered within their tree; every ``FANOUT`` consecutive nodes
become one until one remains.  Leaves are dealt into partitions, aligned blocks
of 8^4 consecutive leaves, which hash their own levels.  Then, round by round,
aligned groups of ``FANOUT`` subtrees swap roots: a partition sends the root of
the subtree it has reached to its counterparts in the sibling subtrees, and
each of them hashes the common ancestor for itself.  So every partition climbs
to the root and keeps, on the way up, the siblings that its leaves' proofs
need; nothing is ever sent down.  Where the last subtree of a run has fewer
partitions, counterparts are taken round and round among those it has.

The trees of all keys climb together; their roots, ordered by key, are leaves
of one more tree, built by the same functions.

A leaf is the hash of a row's columns, each ``-`` if null, else its UTF-8
length, ``:`` and its value, so null and empty differ.  Null ids and keys come
first; rows equal in id are ordered by their hashes, and equal rows are leaves
of their own.  A tree of one leaf is that leaf.  An empty table has no trees.
Other columns than those hashed are not read.

A partition holds up to 4,096 leaves of 150 bytes, whatever the keys; a key on
a third of all rows has more of them.  A round moves ``FANOUT`` roots of 64
bytes a partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatloom.llm.store import stored

FANOUT = 8
INNER_LEVELS = 4  # a partition is the subtree of so many levels
PATH = "array<struct<before:string,after:string>>"


def node(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# -- leaves -----------------------------------------------------------------
def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: dict[str, Column]) -> Column:
    """Hash of a row's columns, in the order given."""
    return F.sha2(F.concat(*[_field(c) for c in columns.values()]), 256)


# -- places -----------------------------------------------------------------
def _placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with ``pos`` in their tree, (tree, n)).  Rows are range-partitioned
    by (tree, id, leaf); counts per stretch and tree turn local numbers into
    places.  A stretch holds like numbers of rows, however large a tree is."""
    order = [F.col("tree").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    ranged = (
        leaves.withColumn("tie", F.monotonically_increasing_id())  # spreads rows repeated very often
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()).drop("tie")
        .withColumn("stretch", F.shiftrightunsigned("at", 33))
    )
    ranged = stored(ranged, "ordered")
    counts = ranged.groupBy("tree", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    counts = stored(counts, "stretches")
    # one row a tree and stretch: no tree has more of them than the exchange has partitions
    earlier = Window.partitionBy("tree").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("tree").alias("_tree"), F.col("stretch").alias("_stretch"), "first",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("stretch") == F.col("_stretch"))
    placed = ranged.join(stored(starts, "starts"), same).withColumn("pos", F.col("start") + F.col("at") - F.col("first"))
    sizes = counts.groupBy("tree").agg(F.sum("n").alias("n"))
    return placed.drop("_tree", "_stretch", "stretch", "first", "start", "at"), sizes


def _levels(n: Column) -> Column:
    """Least number of levels that joins ``n`` leaves; exact, by comparison."""
    return sum((F.when(n > F.lit(FANOUT**k), 1).otherwise(0) for k in range(21)), F.lit(0))


# -- a partition's own levels -----------------------------------------------
def own_levels(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level over one partition's leaves, leaves first."""
    rows = [digests]
    for _ in range(levels):
        below = rows[-1]
        rows.append([node("".join(below[i:i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return rows


def siblings(rows: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """What stands before and after a leaf's ancestor in its run, level by level."""
    for below in rows[:-1]:
        start = at - at % FANOUT
        yield "".join(below[start:at]), "".join(below[at + 1:start + FANOUT])
        at //= FANOUT


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        digest = node(before + digest + after)
    return digest


def _partition_roots(placed: DataFrame, inner: int) -> DataFrame:
    def root(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        first = rows.iloc[0]
        top = own_levels(rows["leaf"].tolist(), min(inner, int(first["levels"])))[-1][0]
        return pd.DataFrame({"tree_no": [first["tree_no"]], "block": [first["block"]], "levels": [first["levels"]],
                             "blocks": [first["blocks"]], "root": [top]})

    slim = placed.select("tree_no", "block", "levels", "blocks", "pos", "leaf")
    return slim.groupBy("tree_no", "block").applyInPandas(root, "tree_no long, block long, levels int, blocks long, root string")


# -- the butterfly ----------------------------------------------------------
def _round(state: DataFrame, reach: int) -> DataFrame:
    """Every partition of a subtree of ``reach`` partitions swaps its root with
    its counterparts in the sibling subtrees, and hashes their parent."""
    block, blocks, r = F.col("block"), F.col("blocks"), F.lit(reach)
    own = F.floor(block / r)  # the subtree, and the place in it
    low = block % r
    last = F.floor((blocks - 1) / r)
    held = lambda s: F.least(r, blocks - s * r)  # partitions of subtree s
    first_of_group = own - own % FANOUT
    to_subtree = lambda s: F.when(
        low < held(s), F.transform(F.sequence(low, held(s) - 1, held(own)), lambda at: s * r + at)
    ).otherwise(F.array().cast("array<bigint>"))
    partners = F.flatten(F.transform(
        F.sequence(first_of_group, F.least(first_of_group + FANOUT - 1, last)),
        lambda s: F.when(s == own, F.array(block)).otherwise(to_subtree(s))))
    sent = state.select("tree_no", "levels", "blocks", own.alias("subtree"), "root", block.alias("sender"), "path",
                        F.explode(partners).alias("block"))
    # a partition's message to itself carries what it has gathered so far
    met = sent.groupBy("tree_no", "levels", "blocks", "block").agg(
        F.array_sort(F.collect_list(F.struct("subtree", "root"))).alias("run"),  # FANOUT roots at most
        F.first(F.when(F.col("sender") == F.col("block"), F.col("path")), ignorenulls=True).alias("path"))
    joined = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x["root"]), "")
    return met.select(
        "tree_no", "levels", "blocks", "block",
        F.sha2(joined(lambda x: F.lit(True)), 256).alias("root"),
        F.concat("path", F.array(F.struct(joined(lambda x: x["subtree"] < own).alias("before"),
                                          joined(lambda x: x["subtree"] > own).alias("after")))).alias("path"))


def climbed(roots: DataFrame, inner: int) -> DataFrame:
    """(tree_no, block, root, path): the tree's root and the upper part of the
    proofs, known to every partition."""
    state = roots.withColumn("path", F.array().cast(PATH))
    most = state.agg(F.max("levels")).first()[0] or 0
    for level in range(inner, most):
        climbing = F.col("levels") > level
        state = _round(state.where(climbing), FANOUT ** (level - inner)).unionByName(state.where(~climbing))
        state = stored(state, "round")
    return state.select("tree_no", "block", "root", "path")


# -- trees ------------------------------------------------------------------
def grown(leaves: DataFrame, inner: int = INNER_LEVELS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees over (tree, id, leaf, ...): the leaves with tree_no, block and pos;
    the partitions with their tree's root and path; (tree, tree_no, n) of every
    tree."""
    placed, sizes = _placed(leaves)
    levels = _levels(F.col("n"))
    sizes = stored(sizes.select(
        "tree", F.xxhash64("tree", F.col("tree").isNull()).alias("tree_no"), "n", levels.cast("int").alias("levels"),
        F.ceil(F.col("n") / F.lit(FANOUT**inner)).alias("blocks")), "trees")
    named = sizes.withColumnRenamed("tree", "_tree").drop("n")
    placed = placed.join(named, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
    placed = stored(placed.withColumn("block", F.floor(F.col("pos") / F.lit(FANOUT**inner))), "placed")
    return placed, climbed(stored(_partition_roots(placed, inner), "roots"), inner), sizes.select("tree", "tree_no", "n")


def _proofs(placed: DataFrame, paths: DataFrame, inner: int) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root of every leaf."""
    kind = placed.schema["id"].dataType.simpleString()

    def prove(rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        above = upper.iloc[0]
        high = [(s["before"], s["after"]) for s in above["path"]]
        tail = "".join(b + a for b, a in high)
        own = own_levels(rows["leaf"].tolist(), min(inner, int(rows["levels"].iloc[0])))
        proofs, folded = [], []
        for i, altered in enumerate(rows["altered"]):
            low = list(siblings(own, i))
            proofs.append(node("".join(b + a for b, a in low) + tail))
            folded.append(fold(altered, low + high))
        return pd.DataFrame({"id": rows["id"], "leaf": rows["leaf"], "subroot": above["subroot"], "root": above["top"],
                             "proof_sha256": proofs, "folded_root": folded})

    keys = ["tree_no", "block"]
    # ids pass as text: pandas has no null in whole numbers
    rows = placed.select(*keys, "levels", "pos", F.col("id").cast("string").alias("id"), "leaf", "altered")
    proofs = rows.groupBy(*keys).cogroup(paths.groupBy(*keys)).applyInPandas(
        prove, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return proofs.withColumn("id", F.col("id").cast(kind))


def manifest(leaves: DataFrame, inner: int = INNER_LEVELS) -> DataFrame:
    """(tree, id, leaf, altered) to id, leaf, subroot, root, proof_sha256 and
    folded_root, the root that the altered leaf and the true siblings give."""
    placed, partitions, trees = grown(leaves, inner)
    partitions = stored(partitions.withColumnRenamed("root", "subroot"), "partitions")
    subroots = partitions.where("block = 0").join(trees, "tree_no").select(
        F.lit(None).cast("int").alias("tree"), F.struct("tree").alias("id"), F.col("subroot").alias("leaf"),
        F.col("tree_no").alias("of"))
    over, over_partitions, _ = grown(subroots, inner)
    top = _tree_paths(over, over_partitions, inner)
    paths = partitions.join(stored(top, "top"), "tree_no").select(
        "tree_no", "block", "subroot", "top", F.concat("path", "upper").alias("path"))
    return _proofs(placed, paths, inner)


def _tree_paths(over: DataFrame, partitions: DataFrame, inner: int) -> DataFrame:
    """(tree_no, top, upper): the dataset's root and the path to it, of every tree."""
    def prove(rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        high = [{"before": s["before"], "after": s["after"]} for s in upper["path"].iloc[0]]
        own = own_levels(rows["leaf"].tolist(), min(inner, int(rows["levels"].iloc[0])))
        paths = [[{"before": b, "after": a} for b, a in siblings(own, i)] + high for i in range(len(rows))]
        return pd.DataFrame({"tree_no": rows["of"], "top": upper["root"].iloc[0], "upper": paths})

    keys = ["tree_no", "block"]
    rows = over.select(*keys, "levels", "pos", "leaf", "of")
    return rows.groupBy(*keys).cogroup(partitions.groupBy(*keys)).applyInPandas(prove, f"tree_no long, top string, upper {PATH}")


def documents_manifest(docs: DataFrame, altered: dict[str, Column] | None = None, inner: int = INNER_LEVELS) -> DataFrame:
    """The manifest of a documents table, one tree per language.  ``altered``
    gives columns anew where a row is to be held against its proof."""
    columns = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    leaves = docs.select(
        F.col("lang").alias("tree"), F.col("doc_id").alias("id"), leaf(columns).alias("leaf"),
        leaf({**columns, **(altered or {})}).alias("altered"))
    return manifest(stored(leaves, "leaves"), inner)  # texts are read and hashed once
