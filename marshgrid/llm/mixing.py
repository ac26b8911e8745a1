"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a hash of the document; blocks number about the
square root of the documents, so that both the list of blocks and one block stay small.
A source with target ``t`` and size ``s`` is drawn ``floor(t / s)`` times whole and once in
part, block by block in a permuted order; the block that crosses the target is taken
document by document up to the nearest total.  That gives exact block quotas.

The quotas are then split among the output shards.  At each node of a binary tree the
draws of all sources form an urn; a multivariate hypergeometric draw of half of them goes
left, the rest right.  A leaf is a shard with an exact quota of each source; its draws are
the next ones of the source's permuted order, so shards hold disjoint draws.  Rows are
shuffled inside their shard.  Everything follows from hashes and seeds: reruns agree.

Defined results: a null text has size 0 and is drawn with its block; a null source is a
source of its own and sorts last; a source without words is never drawn; repeated rows
(same id, text and source) are drawn together, and a null id is an id like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marshgrid.llm import common as C

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Output shards are 2 ** LEVELS.
LEVELS = 4


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to a table (source, source_size) of one row per source.

    Sources in code point order (null last) take the weights in turn.  With sources ordered
    by how soon they fill up (limit / weight), the filled ones are a prefix: it ends at the
    first source whose limit the common level does not reach.  The table has one row per
    source, so its windows are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("limit", most * F.col("source_size"))
    fill = Window.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("level", (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                     / F.sum("weight").over(onward))
    # Levels computed behind the right one are lower: the others were given more than their part.
    t = t.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(whole))
    return t.select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def _permuted(block: Column, source: Column, epoch: Column, width: Column, seed: int) -> Column:
    """Place of a block in its source's order of one epoch: an odd multiple plus a shift, a bijection."""
    key = F.coalesce(source, F.lit("\x00null"))
    # Only the low 31 bits of the factor are used, so the product stays in range.
    odd = (F.xxhash64(key, epoch, F.lit(seed)).bitwiseAND(F.lit(0x7FFFFFFF)).bitwiseOR(F.lit(1))).cast("long")
    shift = F.xxhash64(key, epoch, F.lit(seed + 1)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("long")
    return (block * odd + shift).bitwiseAND(width - 1)


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(source, shard, first, n): each shard's run of draws, from (source, draws).

    One small grouped step per tree level; a group holds one row per source.
    """
    def halve(key, rows):
        node = int(key[0])
        rows = rows.sort_values("sid")
        n = rows.n.to_numpy()
        draw = np.random.default_rng([seed, node]).multivariate_hypergeometric(n, int(n.sum()) // 2, method="marginals")
        left, right = rows.copy(), rows.copy()
        left["n"], left["node"] = draw, 2 * node
        right["first"], right["n"], right["node"] = rows["first"] + draw, n - draw, 2 * node + 1
        import pandas as pd
        return pd.concat([left, right])[["node", "sid", "first", "n"]]

    rows = quotas.select(F.lit(1).cast("long").alias("node"), "sid", F.lit(0).cast("long").alias("first"), F.col("draws").cast("long").alias("n"))
    for _ in range(levels):
        rows = rows.groupBy("node").applyInPandas(halve, "node long, sid long, first long, n long")
    return rows.where("n > 0").select("sid", (F.col("node") - (1 << levels)).alias("shard"), "first", "n")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
        share: float = SHARE, most: float = MOST, levels: int = LEVELS, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """(per_document, draws): what the mix takes of each row, and every draw with shard and place.

    per_document: doc_id, tkey, source, size, source_size, target, times, taken.  draws: doc_id,
    tkey, source, epoch, shard, place (order inside the shard), one row per draw also where a
    document's row is repeated.  ``tkey`` tells rows of equal id apart.  ``taken`` counts the draws
    that the tree dealt to a shard; ``times`` comes from the block sums and has to agree with it.
    """
    C.ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = C.saved(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"),
                               F.col(source_col).alias("source"), F.size(C.words_of(text)).cast("long").alias("size")), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("docs"), F.lit(1))) / 2)).cast("long")
    goals = targets(per_source.select("source", "source_size"), weights, share, most)
    numbered = per_source.select("source", "docs", width.alias("width"), F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long").alias("sid"))
    plan = goals.alias("g").join(numbered.alias("n"), F.col("g.source").eqNullSafe(F.col("n.source"))).select("g.*", "n.width", "n.sid")
    plan = C.saved(plan.withColumns({
        "full": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")})
        .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "plan")

    # Blocks of the source's partly taken epoch in permuted order, with the words before them.
    block = F.xxhash64("doc_id", "tkey", F.lit(seed)).bitwiseAND(F.col("width") - 1)
    placed = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select(
        "r.*", "p.source_size", "p.target", "p.width", "p.sid", "p.full", "p.rest").withColumn("block", block)
    placed = placed.withColumn("turn", _permuted(F.col("block"), F.col("source"), F.col("full"), F.col("width"), seed))
    blocks = placed.groupBy("sid", "turn").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before).select("sid", "turn", "before", (F.col("rest") - F.col("before")).alias("room"), "words")
    placed = placed.join(blocks.select("sid", "turn", "room", "words"), ["sid", "turn"])
    # Only the crossing block is ordered by document; others are all in or all out.
    crossing = placed.where("room > 0 and room < words")
    upto = Window.partitionBy("sid").orderBy(F.xxhash64("doc_id", "tkey", F.lit(seed + 2)), "doc_id", "tkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A document is taken if it lies at least half below the target, which leaves the nearest total; its repeated rows go with it.
    some = crossing.withColumn("upto", F.sum("size").over(upto)).withColumn("part", F.max(F.col("upto") - F.col("size") / 2 <= F.col("room")).over(
        Window.partitionBy("sid", "doc_id", "tkey"))).drop("upto")
    # A block without words behind the target is not drawn: no run of draws reaches it.
    whole = (F.col("room") >= F.col("words")) & (F.col("room") > 0)
    rest = placed.where("not (room > 0 and room < words)").withColumn("part", whole)
    chosen = rest.unionByName(some)
    times = F.col("full") + F.col("part").cast("int")
    chosen = C.saved(chosen.select("doc_id", "tkey", "source", "size", "source_size", "target", times.alias("times"), "sid", "width", "block"), "chosen")

    # Draw number = epoch * blocks + place in the epoch's order; shards own runs of draws.
    quotas = blocks.where("room > 0").groupBy("sid").agg(F.count(F.lit(1)).alias("cut_blocks"), F.max("turn").alias("top"))
    quotas = plan.join(quotas, "sid", "left").select("sid", (F.col("width") * F.col("full")
                                                             + F.coalesce(F.col("top") + 1, F.lit(0))).alias("draws")).where("draws > 0")
    leaves = split_quotas(quotas, levels, seed)
    runs = leaves.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("first", "n", "shard"))).alias("runs"))
    each = chosen.where("times > 0").dropDuplicates(["doc_id", "tkey", "sid"]).select("*", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))
    turn = F.col("width") * F.col("epoch") + _permuted(F.col("block"), F.col("source"), F.col("epoch"), F.col("width"), seed)
    each = each.withColumn("draw", turn).join(runs, "sid")
    shard = F.get(F.filter("runs", lambda r: (r["first"] <= F.col("draw")) & (F.col("draw") < r["first"] + r["n"])), F.lit(0))["shard"]
    draws = each.select("doc_id", "tkey", "source", "epoch", shard.alias("shard"), F.xxhash64("doc_id", "tkey", "epoch", F.lit(seed + 3)).alias("place"))
    dealt = draws.where("shard is not null").groupBy("doc_id", "tkey", "source").agg(F.count(F.lit(1)).alias("dealt"))
    per_document = chosen.alias("c").join(dealt.alias("d"), _same_row("c", "d"), "left").select(
        *[f"c.{c}" for c in ("doc_id", "tkey", "source", "size", "source_size", "target", "times")],
        (F.coalesce("d.dealt", F.lit(0)) * F.col("c.size")).alias("taken"))
    return per_document, draws


def _same_row(a: str, b: str) -> Column:
    """Rows of the two tables that are the same document of the same source; null ids and sources count as values."""
    same = [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("doc_id", "source")]
    return (F.col(f"{a}.tkey") == F.col(f"{b}.tkey")) & same[0] & same[1]


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: ``docs`` rows repeated as drawn, dealt to shards and shuffled inside each.

    Adds epoch, shard and place; columns of these names in the input are replaced.
    """
    given = [c for c in docs.columns if c not in ("epoch", "shard", "place")]
    _, draws = mix(docs, id_col, text_col, source_col, **how)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tkey"),
                       F.col(source_col).alias("source"), F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"))
    rows = rows.alias("r").join(draws.alias("d"), _same_row("r", "d")).select("r.row.*", "d.epoch", "d.shard", "d.place")
    # A shard may hold a large part of a hot source: it is ranged on shard and place, not put into one task.
    return rows.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").select(*given, "epoch", "shard", "place")
