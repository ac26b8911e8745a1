"""Substring dedup by recompression: shared interior symbols reveal repeats, windows prove them.

Every text is rewritten in rounds.  Round 0 names runs of one word; each later round names
pairs: a fixed hash bit calls every symbol left or right, and a left followed by a right
becomes one symbol.  A name is a hash of what it stands for, so all tasks agree on it without
exchanging a dictionary, and equal passages get equal symbols except near their ends.  For
each symbol the words its existence depends on are tracked; a symbol whose words all lie in
a window exists in every copy of that window.

1. Each window takes as anchor its longest such symbol.  Documents send their anchors.
2. One aggregate finds the anchors that occur twice or more.  A window with any other
   anchor is unique and done.
3. The rest (shared anchor, or no anchor, as inside long runs) send a 96-bit window hash;
   an aggregate finds the first place of each, a join flags every later one.

Aggregates combine on the map side, and both joins may be split by adaptive execution, so a
passage in a third of the documents does not meet in one task.  Documents with equal word
sequences are folded first: later copies fall whole and only the first takes part.

Defined results: a null or blank text has no words and loses none; texts shorter than a
window lose none; rows that repeat id and words are one document and get equal results;
rows that share an id but not the words are ordered by a hash of the words; a null id counts
as the largest.  Extra columns are carried along.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marshgrid.llm import common as C

WINDOW = 20
#: Pair rounds; symbols stand for at most ``2 ** ROUNDS`` words and runs.
ROUNDS = 5
#: A symbol serves as anchor if it depends on at most so many words.
REACH = 10
_FAR = 1 << 40
LAST = (1 << 63) - 1


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over every ``width`` consecutive values (shorter by width - 1)."""
    have, out = 1, values
    while have * 2 <= width:
        out = pick(out[:len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[:len(out) - rest], out[rest:]) if rest else out


def parse(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS, reach: int = REACH) -> np.ndarray:
    """Best symbol by the first word it depends on: span in the top byte, then the name; 0 for none."""
    n = len(words)
    best = np.zeros(n, dtype=np.uint64)
    if not n:
        return best
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    run = np.diff(np.append(at, n))
    owner = doc[at]
    name = C.mix(words[at] + C.mix(run.astype(np.uint64)))
    span = run.copy()
    first = np.ones(len(at), dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    last = np.append(first[1:], True)
    lo = np.where(first, -_FAR, at - 1)
    hi = np.where(last, _FAR, at + run + 1)
    salts = C.stream(77, rounds + 2)

    def offer(which):
        ok = which[(hi[which] - lo[which]) <= reach]
        key = (np.minimum(span[ok], 255).astype(np.uint64) << np.uint64(56)) | (name[ok] >> np.uint64(8))
        np.maximum.at(best, lo[ok], key)

    offer(np.flatnonzero(run > 1))
    for r in range(rounds):
        m = len(name)
        left = (C.mix(name ^ salts[r]) >> np.uint64(63)).astype(bool)
        same = owner[1:] == owner[:-1]
        pair = np.zeros(m, dtype=bool)
        pair[:-1] = left[:-1] & ~left[1:] & same
        second = np.zeros(m, dtype=bool)
        second[1:] = pair[:-1]
        alone = ~pair & ~second
        # A lone left symbol depends on what follows it, a lone right one on what precedes it.
        nxt_hi = np.append(np.where(same, hi[1:], _FAR), _FAR)
        pre_lo = np.insert(np.where(same, lo[:-1], -_FAR), 0, -_FAR)
        new_hi = np.where(alone & left, np.maximum(hi, nxt_hi), hi)
        new_lo = np.where(alone & ~left, np.minimum(lo, pre_lo), lo)
        i = np.flatnonzero(pair)
        name = name.copy()
        name[i] = C.mix(name[i] * (salts[-1] | np.uint64(1)) + C.mix(name[i + 1] ^ salts[-2]))
        span = span.copy()
        span[i] += span[i + 1]
        new_lo[i] = np.minimum(lo[i], lo[i + 1])
        new_hi[i] = np.maximum(hi[i], hi[i + 1])
        keep = ~second
        name, span, lo, hi, owner = name[keep], span[keep], new_lo[keep], new_hi[keep], owner[keep]
        offer(np.flatnonzero(pair[keep]))
    return best


def _anchors(best: np.ndarray, ends: np.ndarray, window: int, reach: int):
    """(anchor of the window at each word, is it a window, is the symbol at each word an anchor)."""
    n = len(best)
    whole = np.arange(n) + window <= ends
    room = window - reach + 1
    anchor = np.zeros(n, dtype=np.uint64)
    if n >= room:
        anchor[:n - room + 1] = _sliding(best, room, np.maximum)
    anchor[~whole] = 0
    # A symbol is taken by some window if none of the windows that see it has a better one.
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    seen = np.concatenate([np.full(room - 1, top), np.where(whole, anchor, top)])
    taken = (best > 0) & (_sliding(seen, room, np.minimum)[:n] == best) if n else np.zeros(0, bool)
    return anchor, whole, taken


def _layout(counts: np.ndarray):
    edge = np.concatenate([[0], np.cumsum(counts)])
    return edge, np.repeat(np.arange(len(counts)), counts), np.repeat(edge[1:], counts)


_PARSED = "doc_id long, tkey long, n_words long, k1 long, k2 long, anchors array<long>, again array<long>"


def _parse_batches(window):
    def run(batches):
        for batch in batches:
            raw, offsets = C.text_buffers(batch.column("text"))
            ids, keys = batch.column("doc_id"), batch.column("tkey")
            for lo, hi in C.slices(offsets):
                part = raw[offsets[lo]:offsets[hi]]
                own = offsets[lo:hi + 1] - offsets[lo]
                (h1, h2), counts = C.hash_words(part, own, (1, 2))
                edge, doc, ends = _layout(counts)
                best = parse(h1, doc)
                _, _, taken = _anchors(best, ends, window, REACH)
                at = np.flatnonzero(taken)
                sym, of = best[at].view(np.int64), doc[at]
                order = np.lexsort((sym, of))
                sym, of = sym[order], of[order]
                new = np.ones(len(sym), dtype=bool)
                new[1:] = (sym[1:] != sym[:-1]) | (of[1:] != of[:-1])
                second = np.zeros(len(sym), dtype=bool)
                second[1:] = ~new[1:] & new[:-1]
                lists = [_lists(sym[m], of[m], hi - lo) for m in (new, second)]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo), keys.slice(lo, hi - lo), pa.array(counts),
                    pa.array([C.row_key(h1[edge[i]:edge[i + 1]], 1) for i in range(hi - lo)], pa.int64()),
                    pa.array([C.row_key(h2[edge[i]:edge[i + 1]], 2) for i in range(hi - lo)], pa.int64()),
                    *lists], names=["doc_id", "tkey", "n_words", "k1", "k2", "anchors", "again"])
        C.tidy()
    return run


def _lists(values: np.ndarray, of: np.ndarray, n: int) -> pa.ListArray:
    edge = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(values, pa.int64()))


_SUSPECT = "doc_id long, nth int, starts array<int>, w1 array<long>, w2 array<int>"


def _suspect_batches(window):
    def run(batches):
        for batch in batches:
            raw, offsets = C.text_buffers(batch.column("text"))
            ids, nth, shared = (batch.column(c) for c in ("doc_id", "nth", "shared"))
            marks = [np.asarray(x.values if x.values is not None else [], dtype=np.int64) for x in shared]
            for lo, hi in C.slices(offsets):
                own = offsets[lo:hi + 1] - offsets[lo]
                (h1, h2), counts = C.hash_words(raw[offsets[lo]:offsets[hi]], own, (1, 2))
                edge, doc, ends = _layout(counts)
                anchor, whole, _ = _anchors(parse(h1, doc), ends, window, REACH)
                signed = anchor.view(np.int64)
                starts, w1, w2, rows = [], [], [], []
                for i in range(hi - lo):
                    a, b = edge[i], edge[i + 1]
                    hit = np.flatnonzero(whole[a:b] & ((signed[a:b] == 0) | np.isin(signed[a:b], marks[lo + i])))
                    if len(hit):
                        rows.append(lo + i)
                        starts.append(hit.astype(np.int32))
                        w1.append(C.windows(h1[a:b], window, 3)[hit].view(np.int64))
                        w2.append((C.windows(h2[a:b], window, 4)[hit] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                if rows:
                    take = pa.array(rows)
                    at = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in starts])]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([
                        ids.take(take), nth.take(take),
                        *[pa.ListArray.from_arrays(at, pa.array(np.concatenate(x), t)) for x, t in
                          ((starts, pa.int32()), (w1, pa.int64()), (w2, pa.int32()))]],
                        names=["doc_id", "nth", "starts", "w1", "w2"])
        C.tidy()
    return run


def cut(text: str, starts, window: int, copy: bool = False) -> tuple[str, int, int, str]:
    """Remove the words in the windows: (text, words, words removed, hash of the kept words)."""
    raw = text.encode("utf-8", "surrogatepass")
    if starts is None and not copy:
        words = raw.split()
        return text, len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    data = np.frombuffer(raw, np.uint8)
    space = C._SPACES[data]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    n = len(begins)
    if copy:
        return "", n, n, hashlib.sha256(b"").hexdigest()
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + window, n), -1)
    gone = np.cumsum(delta)[:-1] > 0
    # A removed word takes the white space behind it along.
    limit = np.append(begins[1:], len(data))
    edge = np.zeros(len(data) + 1, dtype=np.int64)
    edge[begins[gone]] += 1
    edge[limit[gone]] -= 1
    left = data[np.cumsum(edge)[:-1] == 0].tobytes()
    return left.decode("utf-8", "surrogatepass"), n, int(gone.sum()), hashlib.sha256(b" ".join(left.split())).hexdigest()


def _cut_batches(window, names, text_col):
    """Texts without their flagged windows; columns _starts (places) and _copy (falls whole) say how."""
    def run(batches):
        for batch in batches:
            rows = []
            for text, starts, copy in zip(batch.column("_text").to_pylist(), batch.column("_starts"), batch.column("_copy").to_pylist()):
                rows.append(cut(text, np.asarray(starts.values) if starts.is_valid else None, window, copy))
            yield pa.RecordBatch.from_arrays([
                *[pa.array([None if o is None else r[0] for o, r in zip(batch.column(c).to_pylist(), rows)], pa.string()) if c == text_col
                  else batch.column(c) for c in names], *[pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()))]],
                names=[*names, "n_words", "n_removed", "kept_sha256"])
        C.tidy()
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages cut out of the text, and what was cut.

    Adds n_words, n_removed and kept_sha256 (hash of the kept words joined by one space);
    columns of these names in the input are replaced.  Untouched texts stay as they are.
    Tables written on the way are deleted as soon as their last reader is done.
    """
    C.ship(docs.sparkSession)
    own_id = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    own_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    plain = docs.select(own_id.alias("doc_id"), own_key.alias("tkey"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parsed = C.saved(plain.mapInArrow(_parse_batches(window), _PARSED), "parsed")
    key = ["doc_id", "tkey"]

    # Anchors met under two contents, or twice in one.
    tag = F.col("k1").bitwiseAND(F.lit(0x7FFFFFFE)).cast("int")
    met = parsed.select(F.explode(F.concat(
        F.transform("anchors", lambda a: F.struct(a.alias("a"), tag.alias("t"))),
        F.transform("again", lambda a: F.struct(a.alias("a"), (tag + 1).alias("t"))))).alias("x")).select("x.a", "x.t")
    shared = met.groupBy("a").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("a")
    # Rows that share an id share their marks, which only adds windows to check.
    uses = parsed.select("doc_id", F.explode("anchors").alias("a"))
    marks = C.saved(uses.join(shared, "a").groupBy("doc_id").agg(F.collect_set("a").alias("shared")), "marks")

    # Equal word sequences: only the first document stands for them.  ``nth`` orders rows that share an id.
    keys = C.saved(parsed.select(*key, "n_words", "k1", "k2").distinct(), "keys")
    C.drop(parsed)
    firsts = keys.groupBy("k1", "k2").agg(F.min(F.struct(*key)).alias("first"))
    fate = keys.join(firsts, ["k1", "k2"]).select(
        *key, (F.struct(*key) != F.col("first")).alias("later"), (F.col("n_words") >= window).alias("whole"),
        F.row_number().over(Window.partitionBy("doc_id").orderBy("tkey")).alias("nth"))
    fate = C.saved(fate, "fate")
    # A document without shared anchors may still hold windows without any anchor, so all firsts are read again.
    asked = (fate.where("not later and whole").join(marks, "doc_id", "left")
             .select(*key, "nth", F.coalesce("shared", F.expr("cast(array() as array<long>)")).alias("shared")))
    suspects = C.saved(plain.join(asked, key).mapInArrow(_suspect_batches(window), _SUSPECT), "suspects")
    C.drop(marks)

    wins = suspects.select("doc_id", "nth", F.explode(F.arrays_zip("starts", "w1", "w2")).alias("w")).select(
        "doc_id", (F.col("nth").cast("long") * F.lit(1 << 32) + F.col("w.starts")).alias("at"), F.col("w.w1").alias("w1"), F.col("w.w2").alias("w2"))
    place = F.struct("doc_id", "at")
    heads = wins.groupBy("w1", "w2").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2", "head")
    later = wins.join(heads, ["w1", "w2"]).where(place != F.col("head"))
    flagged = C.saved(later.groupBy("doc_id", F.floor(F.col("at") / F.lit(1 << 32)).cast("int").alias("nth"))
                      .agg(F.sort_array(F.collect_set((F.col("at") % F.lit(1 << 32)).cast("int"))).alias("_starts")), "flagged")
    C.drop(suspects)

    # Copies of an earlier document fall whole, if they hold a window.
    orders = fate.join(flagged, ["doc_id", "nth"], "left").select(
        F.col("doc_id").alias("_id"), F.col("tkey").alias("_key"), (F.col("later") & F.col("whole")).alias("_copy"), "_starts")
    rest = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_sha256")]
    # Columns go by number, so none clashes with those added here.
    names = [f"c{i}" for i in range(len(rest))]
    numbered = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names)], own_id.alias("_id"), own_key.alias("_key"),
                           F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = numbered.join(orders, ["_id", "_key"])
    schema = T.StructType([*[numbered.schema[c] for c in names], *T.StructType.fromDDL("n_words long, n_removed long, kept_sha256 string").fields])
    return out.mapInArrow(_cut_batches(window, names, names[rest.index(text_col)]), schema).toDF(*rest, "n_words", "n_removed", "kept_sha256")
