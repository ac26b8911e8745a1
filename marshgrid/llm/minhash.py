"""Near-duplicate texts by ProbMinHash sketches, banding and exact verification.

A text is a weighted set: its five-word shingles with their counts.  For two texts the
probability Jaccard similarity is

    sum over shared shingles d of 1 / sum over all e of max(x_e / x_d, y_e / y_d)

which is the plain Jaccard similarity where every count is one.  A ProbMinHash register holds
the shingle whose Poisson process (rate = weight) arrives first among those that choose the
register; two texts agree in a register with just that probability.  Arrivals are produced
in order per shingle and a shingle drops out once its next arrival comes later than every
register's best.

Equal word sequences are folded first.  Texts that share a band of registers become
candidates; every link that counts is verified on the texts themselves:

1. each text is checked against the first text of its most promising bucket,
2. then against the first texts of its other buckets that are not in its class yet,
3. in buckets that still hold several classes, all pairs of different classes: small buckets
   list the pairs whose sketches agree far enough, large ones are cut into blocks of bounded
   size and each two blocks verify their pairs where they meet, sending a spanning forest.

A bucket with a third of all texts costs one comparison a text in steps 1 and 2, and step 3
only has buckets that they leave apart.  No cap drops a candidate.

Defined results: a null or blank text has no shingles and is a class of its own; one of one
to four words has one shingle, all its words; rows that repeat an id form one class member;
a null id is kept as a row with a null class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marshgrid.llm import common as C
from marshgrid.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
REGISTERS = BANDS * ROWS
#: A pair's sketch agreement has a deviation of at most .05 at similarity .8; five of them.
SKETCH_FLOOR = 0.55
#: Texts in a block of step 3, about, and in a bucket whose pairs are listed.
BLOCK, SMALL = 256, 16


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of one text, sorted, and their counts."""
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    own = C.windows(hashes, min(width, len(hashes)), 9 + min(width, len(hashes)))
    return np.unique(own, return_counts=True)


def sketch(items: np.ndarray, weight: np.ndarray, text: np.ndarray, n_texts: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers (n_texts x m, winning shingle hashes) of many texts at once."""
    best = np.full(n_texts * m, np.inf)
    held = np.zeros(n_texts * m, dtype=np.uint64)
    clock = np.zeros(len(items))
    alive = np.arange(len(items))
    step = 0
    while len(alive):
        step += 1
        draw = C.mix(items[alive] + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15))
        # The high bits time the arrival, the low ones choose the register.
        clock[alive] += -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / weight[alive]
        slot = text[alive] * m + (C.mix(draw) % np.uint64(m)).astype(np.int64)
        now = clock[alive]
        # Several arrivals may meet in one register: the earliest wins.
        order = np.lexsort((now, slot))
        slot_s, now_s = slot[order], now[order]
        lead = np.ones(len(order), dtype=bool)
        lead[1:] = slot_s[1:] != slot_s[:-1]
        slot_s, now_s, who = slot_s[lead], now_s[lead], alive[order][lead]
        win = now_s < best[slot_s]
        best[slot_s[win]] = now_s[win]
        held[slot_s[win]] = items[who[win]]
        latest = best.reshape(n_texts, m).max(axis=1)
        alive = alive[now < latest[text[alive]]]
    return held.reshape(n_texts, m)


_SKETCHED = "doc_id long, k1 long, k2 long, n_words long, bands array<long>, sketch binary"


def _sketch_batches(batches):
    for batch in batches:
        raw, offsets = C.text_buffers(batch.column("text"))
        ids = batch.column("doc_id")
        for lo, hi in C.slices(offsets):
            (h1, h2), counts = C.hash_words(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], (1, 2))
            edge = np.concatenate([[0], np.cumsum(counts)])
            n = hi - lo
            sets = [shingles(h1[edge[i]:edge[i + 1]]) for i in range(n)]
            sizes = np.array([len(s[0]) for s in sets])
            registers = sketch(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]).astype(np.float64),
                               np.repeat(np.arange(n), sizes), n)
            keys = C.windows_of_rows(registers, ROWS)
            short = (registers & np.uint64(0xFF)).astype(np.uint8)
            some = counts > 0
            flat = pa.array(keys[some].reshape(-1).view(np.int64))
            at = pa.array(np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                ids.slice(lo, n), pa.array([C.row_key(h1[edge[i]:edge[i + 1]], 1) for i in range(n)], pa.int64()),
                pa.array([C.row_key(h2[edge[i]:edge[i + 1]], 2) for i in range(n)], pa.int64()), pa.array(counts),
                pa.ListArray.from_arrays(at, flat), pa.array([short[i].tobytes() for i in range(n)], pa.binary())],
                names=["doc_id", "k1", "k2", "n_words", "bands", "sketch"])
    C.tidy()


def similarity(xs: np.ndarray, xw: np.ndarray, ys: np.ndarray, yw: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets (sorted items, weights)."""
    both, i, j = np.intersect1d(xs, ys, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    # Items enter by their pair of weights only; equal pairs are taken together.
    only_x, only_y = xw.sum() - xw[i].sum(), yw.sum() - yw[j].sum()
    pairs, n = np.unique(np.stack([xw[i], yw[j]], 1), axis=0, return_counts=True)
    a, b = pairs[:, 0].astype(np.float64), pairs[:, 1].astype(np.float64)
    total = 0.0
    for lo in range(0, len(a), 512):
        p, q = a[lo:lo + 512, None], b[lo:lo + 512, None]
        below = (np.maximum(a[None] / p, b[None] / q) * n[None]).sum(1) + only_x / p[:, 0] + only_y / q[:, 0]
        total += (n[lo:lo + 512] / below).sum()
    return float(total)


_VERIFIED = "a long, b long, similarity double"


def _verify_batches(batches):
    for batch in batches:
        sets = []
        for side in ("text_a", "text_b"):
            raw, offsets = C.text_buffers(batch.column(side))
            own = []
            for lo, hi in C.slices(offsets):
                (h,), counts = C.hash_words(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                edge = np.concatenate([[0], np.cumsum(counts)])
                own += [shingles(h[edge[i]:edge[i + 1]]) for i in range(hi - lo)]
            sets.append(own)
        yield pa.RecordBatch.from_arrays([
            batch.column("a"), batch.column("b"),
            pa.array([similarity(*x, *y) for x, y in zip(*sets)], pa.float64())], names=["a", "b", "similarity"])


def _agree_batches(batches):
    """Keep the candidate pairs whose sketches agree far enough, with the agreement."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
        agree = (x == y).mean(1)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(agree)], names=["a", "b", "agree"]).filter(
            pa.array(agree >= SKETCH_FLOOR))


def overlaps(one: list, two: list) -> tuple[np.ndarray, np.ndarray]:
    """(upper bound of the similarity, shared items) of every pair of two lists of weighted sets.

    A shared item adds at most its share of either set's weight.
    """
    both = one + two
    items, at = np.unique(np.concatenate([s[0] for s in both]), return_inverse=True)
    who = np.repeat(np.arange(len(both)), [len(s[0]) for s in both])
    weight = np.concatenate([s[1] for s in both]) / np.repeat([max(1, s[1].sum()) for s in both], [len(s[0]) for s in both])
    # Items of one set only are in no intersection.
    place = np.cumsum(np.bincount(at, minlength=len(items)) > 1) - 1
    shared = (np.bincount(at, minlength=len(items)) > 1)[at]
    col, who, weight = place[at][shared], who[shared], weight[shared]
    order = np.argsort(col, kind="stable")
    col, who, weight = col[order], who[order], weight[order]
    n = len(one)
    of_one, of_two, count = (np.zeros((n, len(two))) for _ in range(3))
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        part = slice(*np.searchsorted(col, [lo, lo + 4096]))
        w, has = np.zeros((len(both), 4096), np.float32), np.zeros((len(both), 4096), np.float32)
        w[who[part], col[part] - lo], has[who[part], col[part] - lo] = weight[part], 1
        of_one += w[:n] @ has[n:].T
        of_two += has[:n] @ w[n:].T
        count += has[:n] @ has[n:].T
    return np.minimum(of_one, of_two), np.rint(count)


def _block_links(threshold: float):
    """Verified links between different classes in one pair of blocks: a spanning forest of them."""
    def run(rows):
        import pandas as pd

        rows = rows.drop_duplicates(["doc_id", "text", "side"])
        sides = [rows[rows.side == k] for k in (0, 1)]
        if not len(sides[1]):
            sides[1] = sides[0]
        sets = []
        for side in sides:
            raw, offsets = C.text_buffers(pa.array(side.text.tolist(), pa.string()))
            (h,), counts = C.hash_words(raw, offsets)
            edge = np.concatenate([[0], np.cumsum(counts)])
            sets.append([shingles(h[edge[i]:edge[i + 1]]) for i in range(len(side))])
        bound, shared = overlaps(*sets)
        ids, others = (side.doc_id.to_numpy() for side in sides)
        cls, other_cls = (side.root.to_numpy() for side in sides)
        i, j = np.nonzero((bound >= threshold - 1e-5) & (cls[:, None] != other_cls[None]))
        # Where every weight is one the similarity follows from the number of shared shingles.
        size, other_size = (np.array([len(s[0]) for s in own]) for own in sets)
        plain, other_plain = (np.array([len(s[0]) == s[1].sum() for s in own]) for own in sets)
        easy = plain[i] & other_plain[j]
        jaccard = shared[i, j] / (size[i] + other_size[j] - shared[i, j])
        keep = ~easy | (jaccard >= threshold)
        root: dict = {}

        def find(v):
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v
        out = []
        for a, b, known in zip(i[keep], j[keep], easy[keep]):
            r, s = find(cls[a]), find(other_cls[b])
            if r != s and (known or similarity(*sets[0][a], *sets[1][b]) >= threshold):
                root[r] = s
                out.append((ids[a], others[b]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")
    return run


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    x = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    y = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    checked = pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(_verify_batches, _VERIFIED)
    return C.saved(checked.where(F.col("similarity") >= threshold), "verified")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, kept) per id: ``class_id`` the smallest id linked to it over verified pairs."""
    C.ship(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketched = C.saved(plain.where("doc_id is not null").mapInArrow(_sketch_batches, _SKETCHED), "sketched")
    # An id that comes with several texts takes part with each of them: its rows are linked by the id itself.
    members = (sketched.where("n_words > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")))
    members = C.saved(members, "members")
    same = sketched.where("n_words > 0").join(members.where("copies > 1").select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    keyed = members.select(F.col("rep"), F.posexplode("bands").alias("band", "key"))
    lead = F.min(F.struct(F.xxhash64("rep", "band").alias("o"), F.col("rep").alias("hub")))
    buckets = C.saved(keyed.groupBy("band", "key").agg(lead.alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
                      .select("band", "key", "n", "lead.hub"), "buckets")
    met = keyed.join(buckets, ["band", "key"])
    sketches = members.groupBy("rep").agg(F.first("sketch").alias("sketch"))
    star = met.where("hub <> rep").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    star = C.saved(_agreeing(star, sketches), "star")

    # 1. the most promising hub of each text
    top = star.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("t")).select("a", "t.b")
    texts = plain.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    links = _verified(top, texts, threshold)
    found = links.select("a", "b").unionByName(same)
    root = C.saved(components(found), "roots")
    # 2. other hubs, where they would join two classes
    more = _apart(star.select("a", "b"), root).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = _verified(more.join(tried, ["a", "b"], "left_anti"), texts, threshold)
    found = C.saved(found.unionByName(links.select("a", "b")), "found")
    root = C.saved(components(found), "roots")
    # 3. what is still apart in a bucket
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    apart = _apart_rows(met, root)
    links = _verified(_small_pairs(apart, sketches).join(tried, ["a", "b"], "left_anti"), texts, threshold)
    inside = C.saved(_large_links(apart, texts, threshold), "inside")
    root = components(found.unionByName(links.select("a", "b")).unionByName(inside))
    ids = plain.select("doc_id").distinct()
    out = ids.join(root.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"),
                      F.coalesce(F.coalesce("root", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _agreeing(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    x = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a"))
    y = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(_agree_batches, "a long, b long, agree double")


def _apart(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """Pairs whose ends are in different classes so far."""
    x = root.select(F.col("id").alias("a"), F.col("root").alias("ra"))
    y = root.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    joined = pairs.join(x, "a", "left").join(y, "b", "left")
    return joined.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _apart_rows(met: DataFrame, root: DataFrame) -> DataFrame:
    """Members of buckets of three or more texts that hold several classes."""
    rows = (met.where("n > 2").select("band", "key", "n", F.col("rep").alias("doc_id"))
            .join(root.withColumnRenamed("id", "doc_id"), "doc_id", "left")
            .select("band", "key", "n", "doc_id", F.coalesce("root", "doc_id").alias("root")))
    split = rows.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "key")
    return C.saved(rows.join(split, ["band", "key"]), "apart")


def _small_pairs(apart: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of different classes in small buckets (a < b): a row has fewer than SMALL partners in each."""
    small = apart.where(F.col("n") <= SMALL)
    x = small.select("band", "key", F.col("doc_id").alias("a"), F.col("root").alias("ra"))
    y = small.select("band", "key", F.col("doc_id").alias("b"), F.col("root").alias("rb"))
    return _agreeing(x.join(y, ["band", "key"]).where("a < b and ra <> rb").select("a", "b").distinct(), sketches).select("a", "b")


def _large_links(apart: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links in large buckets, verified where two blocks of texts meet; pairs are never written out."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    large = apart.where(F.col("n") > SMALL).withColumns({"blocks": blocks, "mine": F.pmod(F.xxhash64("doc_id"), blocks).cast("int")})
    large = large.select("band", "key", "doc_id", "root", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    large = large.select("band", "key", "doc_id", "root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                         (F.col("mine") > F.col("other")).cast("int").alias("side"))
    return large.join(texts, "doc_id").groupBy("band", "key", "i", "j").applyInPandas(_block_links(threshold), "a long, b long")
