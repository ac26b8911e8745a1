"""Token-id files: byte-pair encoding, Simple-8b word-aligned coding, exact reading back.

Ids lie in blocks of ``BLOCK``.  A block is a run of 64-bit words; the top four bits of a word
select how many ids of which width fill the other sixty.  An id of more than sixty bits is
escaped: a word that says so, then the id in a word of its own.  The footer holds the place of
every block's first word, so blocks can be decoded apart and at once; packing and unpacking
run over all blocks side by side in numpy.

File (little endian): ``MGTOK1\\0\\0``, the words, then document ids, document lengths, block
places (int64 each) and a tail of four int64: documents, ids, blocks, words.

Documents are ranged on their id; each range becomes one file, written under a name of its own
by the task that encodes it, so a task that is run again leaves the first file unused.  The
manifest (file, ids in it) is a Spark table; the position of a document's first id in the
whole corpus is the sum of the files before plus its place in the file.

Defined results: a null or empty text has the end id only; rows that repeat an id follow each
other, shorter text first, then by text; a null id comes first; an empty table has no files.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marshgrid.llm import common as C

MAGIC = b"MGTOK1\0\0"
BLOCK = 1024
#: Ids in a word and bits of each, by selector; selector 15 is the escape.
COUNTS = np.array([240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64])
ESCAPE = 15
#: Blocks worked off together.
TOGETHER = 1024
#: Remembered words per worker, in each of two generations.
REMEMBERED = 800_000


# ---- Simple-8b -------------------------------------------------------------------------


#: Selector class by bit length, and by value for 16-bit ids.
_BY_BITS = np.searchsorted(WIDTHS, np.arange(65)).astype(np.uint8)
_BY_VALUE = _BY_BITS[np.array([v.bit_length() for v in range(1 << 16)])]


def _classes(ids: np.ndarray) -> np.ndarray:
    """Smallest selector whose width holds each id."""
    top = int(ids.max()) if ids.size else 0
    if top < 1 << 16:
        return _BY_VALUE[ids.astype(np.uint16)]
    bits = np.zeros(ids.shape, dtype=np.uint8)
    for b in range(top.bit_length()):
        bits += ids >= np.uint64(1 << b)
    return _BY_BITS[bits]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of ids (uint64), in blocks of ``BLOCK``."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.zeros((blocks, BLOCK + 240), dtype=np.uint64)
    flat = np.zeros(blocks * BLOCK, dtype=np.uint64)
    flat[:n] = ids
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    need = _classes(grid)
    # Largest class among the next c ids, built up from shorter stretches.
    wide = {1: need}

    def stretch(c):
        if c not in wide:
            half = max(k for k in wide if k < c)
            a, b = wide[half], stretch(c - half) if c - half not in wide else wide[c - half]
            out = a.copy()
            out[:, :-half] = np.maximum(a[:, :-half], b[:, half:])
            wide[c] = out
        return wide[c]
    for c in sorted(set(COUNTS.tolist())):
        stretch(c)
    best = np.maximum(need[:, :BLOCK], 14)
    for s in range(13, -1, -1):
        np.copyto(best, s, where=wide[int(COUNTS[s])][:, :BLOCK] <= s)
    # All blocks take their next word at the same time.
    length = np.full(blocks, BLOCK)
    if n % BLOCK:
        length[-1] = n % BLOCK
    at, live = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    rows, cols = [], []
    while len(live):
        here = at[live]
        rows.append(live)
        cols.append(here)
        at[live] = here + COUNTS[best[live, here]]
        live = live[at[live] < length[live]]
    row, col = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols))
    order = np.argsort(row, kind="stable")
    row, col = row[order], col[order]
    sel = best[row, col]
    size = 1 + (sel == ESCAPE)
    place = np.concatenate([[0], np.cumsum(size)])
    words = np.zeros(place[-1], dtype=np.uint64)
    for s in np.unique(sel):
        k = np.flatnonzero(sel == s)
        if s == ESCAPE:
            words[place[k]] = np.uint64(ESCAPE << 60)
            words[place[k] + 1] = grid[row[k], col[k]]
            continue
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        value = np.full(len(k), int(s) << 60, dtype=np.uint64)
        if w:
            cell, at = grid.reshape(-1), row[k] * grid.shape[1] + col[k]
            for j in range(c):
                value |= cell[at + j] << np.uint64(w * j)
        words[place[k]] = value
    first = place[np.searchsorted(row, np.arange(blocks))]
    return words, first


def unpack(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of whole blocks (the last may be short) from their words."""
    blocks = len(first)
    if not blocks:
        return np.zeros(0, dtype=np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), dtype=bool)
    for i in np.flatnonzero(sel == ESCAPE):  # the word behind an escape is no selector
        if head[i]:
            head[i + 1] = False
    block = np.repeat(np.arange(blocks), np.diff(np.append(first, len(words))))
    count = np.where(head, COUNTS[sel], 0)
    upto = np.cumsum(count) - count
    col = upto - upto[first][block]
    out = np.zeros((blocks, BLOCK + 240), dtype=np.uint64)
    for s in np.unique(sel[head]):
        k = np.flatnonzero(head & (sel == s))
        if s == ESCAPE:
            out[block[k], col[k]] = words[k + 1]
            continue
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        if w:
            mask, cell, at, value = np.uint64((1 << w) - 1), out.reshape(-1), block[k] * out.shape[1] + col[k], words[k]
            for j in range(c):
                cell[at + j] = (value >> np.uint64(w * j)) & mask
    return np.ascontiguousarray(out[:, :BLOCK]).reshape(-1)[:n]


# ---- encoding --------------------------------------------------------------------------


class Encoder:
    """Whole texts to ids with the tokenizers library, each word encoded once per worker.

    Byte-level splitting always cuts before a single space between two other characters, so
    the parts between such spaces are encoded apart and put together.
    """

    def __init__(self, path: str):
        import os
        import re

        # A task has one core; the library's own threads only add to its time.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = re.compile(r"(?<=\S)(?= \S)")
        self.now: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """32-bit ids of each text."""
        known, out, open_, missing = self.now, [], [], {}
        for i, text in enumerate(texts):
            parts = text.split(" ")
            head = parts[0]
            found = list(map(known.get, parts[1:]))
            if None in found:
                for p, f in zip(parts[1:], found):
                    if f is None and p not in missing:
                        if not p or p[0].isspace() or p[-1].isspace():
                            parts = None
                            break
                        missing[p] = self.earlier.get(p)
            if parts is not None and head and not head[-1].isspace():
                out.append(found)
                open_.append((i, head, parts[1:]))
            else:
                out.append(None)
                open_.append((i, text, None))
        fresh = [p for p, f in missing.items() if f is None]
        missing.update(zip(fresh, self._encode([" " + p for p in fresh])))
        heads = self._encode([h for _, h, p in open_ if p is not None])
        heads = iter(heads)
        for i, head, parts in open_:
            if parts is None:
                out[i] = b"".join(self._encode(self.cut.split(head))) if head else b""
            else:
                out[i] = next(heads) + b"".join([missing[p] if f is None else f for p, f in zip(parts, out[i])] if None in out[i] else out[i])
        if len(known) > REMEMBERED:
            self.earlier, self.now = known, {}
        self.now.update(missing)
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_batches(path: str, folder: str, end_id: int):
    def run(batches):
        sink, target = None, f"{folder}/{uuid.uuid4().hex}.tok"
        ids_, lengths, places, rest, written, total, part = [], [], [], np.zeros(0, np.uint64), 0, 0, None
        end = np.array([end_id], dtype="<u4").tobytes()

        def put(values):
            nonlocal written, total
            words, first = pack(values)
            places.append(first + written)
            sink.write(words.astype("<u8").tobytes())
            written += len(words)
            total += len(values)
        for batch in batches:
            if sink is None:
                file_system, name = _open(target)
                sink = file_system.open_output_stream(name)
                sink.write(MAGIC)
                part = batch.column("part")[0].as_py()
            texts = batch.column("text").to_pylist()
            ids_.append(batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False))
            for lo in range(0, len(texts), 500):
                parts = [p + end for p in encoder(path).encode(texts[lo:lo + 500])]
                lengths.append(np.array([len(p) // 4 for p in parts], dtype=np.int64))
                values = np.concatenate([rest, np.frombuffer(b"".join(parts), "<u4").astype(np.uint64)])
                whole = len(values) // BLOCK * BLOCK
                for a in range(0, whole, BLOCK * TOGETHER):
                    put(values[a:min(whole, a + BLOCK * TOGETHER)])
                rest = values[whole:]
        if sink is None:
            return
        if len(rest):
            put(rest)
        tables = [np.concatenate(x).astype("<i8") if x else np.zeros(0, "<i8") for x in (ids_, lengths, places)]
        for t in tables:
            sink.write(t.tobytes())
        sink.write(np.array([len(tables[0]), total, len(tables[2]), written], dtype="<i8").tobytes())
        sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([target]), pa.array([total], pa.int64()), pa.array([len(tables[0])], pa.int64())],
                                         names=["part", "file", "ids", "docs"])
    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 0) -> DataFrame:
    """Encode all texts into files below ``folder`` (default: the shared folder); returns the manifest.

    The manifest has part (order of the files), file, ids, docs and start (ids in files before).
    """
    spark = docs.sparkSession
    C.ship(spark)
    folder = folder or C.shared_folder(spark, "tokens")
    fs, name = _open(folder)
    fs.create_dir(name, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.length("text")]
    # Equal keys stay in one range, and within it rows are in full order.
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order, "text")
    files = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(
        _write_batches(tokenizer_path, folder, end_id), "part int, file string, ids long, docs long")
    manifest = C.saved(files, "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _read_batches(with_ids: bool):
    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                fs, name = _open(uri)
                with fs.open_input_file(name) as f:
                    if f.read_at(8, 0) != MAGIC:
                        raise ValueError(f"{uri} is no token file")
                    size = f.size()
                    n_docs, n_ids, n_blocks, n_words = np.frombuffer(f.read_at(32, size - 32), "<i8").tolist()
                    foot = np.frombuffer(f.read_at(8 * (2 * n_docs + n_blocks), 8 + 8 * n_words), "<i8")
                    ids, lengths, places = foot[:n_docs], foot[n_docs:2 * n_docs], np.append(foot[2 * n_docs:], n_words)
                    begin = np.concatenate([[0], np.cumsum(lengths)])
                    held, done, doc = np.zeros(0, "<u4"), 0, 0
                    for b in range(0, n_blocks, TOGETHER):
                        e = min(n_blocks, b + TOGETHER)
                        words = np.frombuffer(f.read_at(8 * int(places[e] - places[b]), 8 + 8 * int(places[b])), "<u8")
                        got = unpack(words, places[b:e] - places[b], min(n_ids, e * BLOCK) - b * BLOCK)
                        held = np.concatenate([held, got.astype("<u4")])
                        last = int(np.searchsorted(begin, done + len(held), side="right")) - 1
                        if last > doc:
                            yield _documents(ids, begin, doc, last, held, done, start, with_ids)
                            held, done, doc = held[begin[last] - done:], int(begin[last]), last
    return run


def _documents(ids, begin, doc, last, held, done, start, with_ids):
    cut = begin[doc:last + 1] - done
    raw = held[:cut[-1]].tobytes()
    out = [pa.array(ids[doc:last], mask=ids[doc:last] == -(1 << 63)), pa.array(begin[doc:last] + start), pa.array(np.diff(cut)),
           pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(cut, cut[1:])], pa.int64())]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        out.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(held[:cut[-1]].astype(np.int64))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(out, names=names)


def read_tokens(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files of a manifest."""
    C.ship(manifest.sparkSession)
    n = max(1, manifest.count())
    spread = manifest.select("file", "start", "part").repartitionByRange(n, "part")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return spread.mapInArrow(_read_batches(with_ids), schema)
