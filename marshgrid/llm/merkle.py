"""Merkle manifest of a table: a tree per group of rows, a root over the groups, proofs and their check.

A leaf is the digest of a row's fields.  The leaves of a group in order are joined, ``arity``
at a time, until one node is left, the group's subroot; the subroots in group order are
joined likewise to the root.  The last node of a level may have fewer children, even one.

Each level is a table (tree, idx, n, digest).  It is joined with itself on the indices of the
siblings (index XOR 1 for two children, slot offsets for more), which gives every node what
stands before and after it in its run, and the nodes in slot zero emit the parents.  Proofs
go the other way: from the root down each level takes over its parents' siblings.

Defined results: null fields count as ``-``; a null group is a group, the first one; a null
order value comes first, equal ones are ordered by the digest of the leaf, and repeated
rows are leaves of equal digest; an empty table has no root and no rows; columns that are
not named as fields are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marshgrid.llm.common import drop, fixed, saved
from marshgrid.llm.positions import placed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of at most so many nodes are joined by broadcast, in one task; a proof holds at most some kilobytes.
SMALL_LEVEL = 8192


def _none() -> Column:
    return F.lit(bytearray())


def encoded(value: Column) -> Column:
    """``-`` for a null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    """Binary SHA-256 of the encoded fields, one after the other."""
    return F.unhex(F.sha2(F.concat(*[encoded(c) for c in fields]), 256))


def node_digest(*parts: Column) -> Column:
    """Binary SHA-256 of the hex digests in ``parts``, one after the other."""
    return F.unhex(F.sha2(F.lower(F.hex(F.concat(*parts))), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


@dataclass
class Forest:
    """Level tables from the leaves up, and how many nodes a level has at most."""

    levels: list[DataFrame]
    bounds: list[int]
    arity: int


def _with_siblings(nodes: DataFrame, arity: int, small: bool) -> DataFrame:
    """Add ``before`` and ``after``, the digests of the run's other nodes on either side."""
    slot = F.col("idx") % arity
    digests = []
    for shift in range(1, arity):
        # Every node goes to the one that sees it ``shift`` slots on.
        seer = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + arity - shift) % arity
        other = nodes.where("n > 1").select("tree", seer.alias("idx"), F.col("digest").alias(f"_d{shift}"))
        nodes_and = F.broadcast(other) if small else other
        digests.append((shift, f"_d{shift}", nodes_and))
    out = nodes
    for _, _, other in digests:
        out = out.join(other, ["tree", "idx"], "left")
    before = [F.when(slot >= arity - k, F.col(d)) for k, d, _ in digests]
    after = [F.when(slot < arity - k, F.col(d)) for k, d, _ in digests]
    return out.select(*nodes.columns, F.concat(_none(), *[F.coalesce(x, _none()) for x in before]).alias("before"),
                      F.concat(_none(), *[F.coalesce(x, _none()) for x in after]).alias("after"))


def grow(leaves: DataFrame, arity: int = 2) -> Forest:
    """Trees over ``leaves`` (tree, idx, n, digest and more columns, which stay with level 0)."""
    if arity < 2:
        raise ValueError("a node has two children at least")
    sizes = leaves.groupBy("tree").agg(F.max("n").alias("n")).agg(F.max("n"), F.sum("n"), F.count(F.lit(1))).first()
    largest, bound, trees = (int(x or 0) for x in sizes)
    levels, bounds, nodes = [], [], leaves
    while largest:
        small = bound <= SMALL_LEVEL
        if small:
            nodes = nodes.coalesce(1)
        levels.append(saved(_with_siblings(nodes, arity, small), "level"))
        bounds.append(bound)
        if largest == 1:
            break
        nodes = levels[-1].where((F.col("n") > 1) & (F.col("idx") % arity == 0)).select(
            "tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            node_digest(F.col("digest"), F.col("after")).alias("digest"))
        largest, bound = -(-largest // arity), bound // arity + trees
    return Forest(levels, bounds, arity)


def roots(forest: Forest) -> DataFrame:
    """(tree, level, digest) of every tree's root."""
    out = None
    for k, level in enumerate(forest.levels):
        top = level.where("n = 1").select("tree", F.lit(k).alias("level"), "digest")
        out = top if out is None else out.unionByName(top)
    return out


def descend(forest: Forest, tops: DataFrame) -> DataFrame:
    """Leaves with ``path``, the (before, after) of every level up to the root over all trees.

    ``tops`` (tree, level, path, top) holds what follows above each tree's root.  Each level
    is joined once with its parents; small levels by broadcast.
    """
    paths = None
    for k in reversed(range(len(forest.levels))):
        here = forest.levels[k]
        more = [c for c in here.columns if c not in ("tree", "idx", "n", "digest", "before", "after")]
        own = here.where("n = 1").join(tops.where(F.col("level") == k).select("tree", "path", "top"), "tree")
        own = own.select("tree", "idx", "digest", *more, "path", "top")
        if paths is not None:
            up = paths.select("tree", F.col("idx").alias("_up"), F.col("path").alias("_path"), "top")
            up = F.broadcast(up) if forest.bounds[k + 1] <= SMALL_LEVEL else up
            inner = here.where("n > 1").withColumn("_up", F.expr(f"idx div {forest.arity}")).join(up, ["tree", "_up"])
            step = F.array(F.struct("before", "after"))
            own = inner.select("tree", "idx", "digest", *more, F.concat(step, "_path").alias("path"), "top").unionByName(own)
        paths = own
    return paths


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda at, s: node_digest(s["before"], at, s["after"]))


def manifest(docs: DataFrame, fields=FIELDS, id_col: str = "doc_id", tree_col: str = "lang", arity: int = 2,
             tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, path, and the leaf as recomputed now.

    ``tampered`` replaces fields when the leaf is computed for the check (``leaf_now``), as
    if the row had changed after the manifest was written; without it both leaves are equal.
    """
    at = {c: F.col(c) for c in fields}
    now = [(tampered or {}).get(c, at[c]) for c in fields]
    # Null first, then bytewise: an empty string stands for null, others begin with a sign.
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit(""))
    leaves = saved(docs.select(F.col(id_col).alias("id"), tree.alias("tree"), leaf_digest([at[c] for c in fields]).alias("digest"),
                               leaf_digest(now).alias("leaf_now"), F.monotonically_increasing_id().alias("_row")), "leaves")
    # The row number only parts equal leaves.
    nodes = saved(placed(leaves, "tree", ["id", "digest", "_row"]).drop("_row"), "placed")
    drop(leaves)
    forest = grow(nodes, arity)
    if not forest.levels:
        return nodes.select("id", *[F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root")],
                            F.lit(None).cast("array<struct<before:binary,after:binary>>").alias("path"), "leaf_now")
    drop(nodes)
    subroots = saved(roots(forest), "subroots")
    upper = grow(saved(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("below"), F.col("level").alias("level_below"), "digest"),
                              "tree", ["below"]), "placed"), arity)
    root = roots(upper).first()["digest"]
    none = F.expr("cast(array() as array<struct<before:binary,after:binary>>)")
    over = descend(upper, roots(upper).select("tree", "level", none.alias("path"), F.col("digest").alias("top")))
    tops = saved(over.select(F.col("below").alias("tree"), F.col("level_below").alias("level"), "path", F.col("digest").alias("top")), "tops")
    leaves = descend(forest, tops)
    return leaves.select("id", hex_of(F.col("digest")).alias("leaf"), hex_of(F.col("top")).alias("subroot"),
                         F.lit(bytes(root).hex()).alias("root"), "path", "leaf_now")


def verified(proven: DataFrame) -> DataFrame:
    """Fold every recomputed leaf with its siblings and compare with the root."""
    siblings = F.aggregate("path", _none(), lambda s, x: F.concat(s, x["before"], x["after"]))
    out = fixed(proven, proof_sha256=F.sha2(hex_of(siblings), 256), folded_root=hex_of(fold(F.col("leaf_now"), F.col("path"))))
    return out.withColumn("verified", F.col("folded_root").eqNullSafe(F.col("root")))
