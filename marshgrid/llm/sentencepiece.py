"""SentencePiece encoding and decoding as a max-plus parallel scan.

Byte-pair encoding by piece rank can be told from neighbours alone: a sequence of pieces is
the encoding of its text if and only if each piece and each two neighbours are the encoding
of their own text, for a merge across a border needs the two pieces at that border only.
Encoding a text is then finding the one path in its piece lattice whose neighbours all get
weight 0 (any others get minus infinity): a product of matrices over (max, +).

A text is cut into chunks of a fixed number of characters.  The state at a boundary is the
piece that ends at it or lies across it, with the characters by which it reaches over.  Each
chunk yields the matrix that takes every state it may be entered in to the state it is left
in; only finite entries are kept.  The matrices of a document are combined associatively in
a two-level scan (runs of chunks, then whole runs, then down again), and with its entry
state known each chunk walks its own path back, independently of the others.

Where no piece holds two neighbouring characters next to each other, no piece crosses; the
path between two such cuts does not depend on anything else and is remembered.

Defined results: a null or empty text has no pieces and decodes to the empty text (a null
stays null); characters the vocabulary lacks become their UTF-8 byte pieces, or the unknown
piece in a model without byte pieces; control strings in a text are ordinary text; repeated
rows are encoded each; extra columns are carried along.
"""

from __future__ import annotations

import functools
import pickle
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marshgrid.llm import common as C

CHUNK = 8192
#: Chunks whose matrices are combined in one group of the scan.
RUN = 256
SPACE = "▁"
#: Stretches share their beginnings: paths of so many characters are remembered as well.
BEGINNING = 6
#: Stretches remembered by a worker, in each of two generations.
REMEMBERED = 250_000


class Model:
    """Pieces, ranks and neighbour rules of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [m.id_to_piece(i) for i in range(m.vocab_size())]
        special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(m.vocab_size())]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if m.is_byte(i)}
        bytes_ = set(self.byte.values())
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and i not in bytes_}
        self.score = {p: m.get_score(i) for p, i in self.ids.items()}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.unknown = m.unk_id()
        # What each id adds to a decoded text.
        self.spelling = [bytes([self.of_byte[i]]) if i in self.of_byte else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.longest = max(map(len, self.ids))
        self.inside = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        # Pieces that encode to themselves; only those can stand in an encoding.
        self.solid = {p for p in self.ids if self.merge(p) == [p]}
        # Their lengths by the last three characters; ``lengths`` adds what shorter ones there are.
        self.by_end: dict[str, list[int]] = {}
        for p in self.solid:
            if len(p) > 2:
                self.by_end.setdefault(p[-3:], []).append(len(p))
        self.known_lengths: dict[str, tuple[int, ...]] = {}
        self.remembered: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.beginnings: dict[str, tuple[list, list]] = {}
        self.neighbours: dict[str, dict[str, bool]] = {}
        self.known_pairs = 0
        # Where the space mark only begins pieces, each word is a stretch of its own.
        marked = all(x[0] == SPACE or x[1] != SPACE for x in self.inside)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if marked else lambda t: [t]
        self.prefix = SPACE if m.encode("a", out_type=str)[0].startswith(SPACE) else ""

    def merge(self, text: str) -> list[str]:
        """Plain merging by score, leftmost first; for strings of a few pieces."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def lengths(self, end: str) -> tuple[int, ...]:
        """Lengths, longest first, of the pieces that may end in these (up to three) characters."""
        found = sorted(set(self.by_end.get(end, ())), reverse=True)
        found += [2] if end[-2:] in self.solid and len(end) > 1 else []
        if len(self.known_lengths) > REMEMBERED:
            self.known_lengths.clear()
        known = self.known_lengths[end] = (*found, 1)
        return known

    def allowed(self, left: str, right: str) -> bool:
        """Weight 0 (True) or minus infinity between two neighbours; remembered by left piece."""
        if self.known_pairs > 2 * REMEMBERED:
            for known in self.neighbours.values():
                known.clear()
            self.known_pairs = 0
        self.known_pairs += 1
        fit = not left or self.merge(left + right) == [left, right]
        self.neighbours.setdefault(left, {})[right] = fit
        return fit

    def forward(self, text: str, begin: int, last: str, end: int, stop: int) -> list[str | None]:
        """Last piece of the finite path from (begin, last) to each position up to ``stop``; None: no path.

        The path to a position is unique, so one piece a position is all there is to keep.
        Pieces start before ``end`` and may lie across it.  Entry 0 belongs to ``begin``.
        """
        path: list[str | None] = [last]
        after: list[dict | None] = [self.neighbours.setdefault(last, {})]
        self._extend(text, begin, end, stop, path, after)
        return path

    def whole(self, text: str) -> list[str]:
        """The path through a text that stands alone."""
        n = len(text)
        if n <= BEGINNING:
            return self.forward(text, 0, "", n, n)
        head = self.beginnings.get(text[:BEGINNING])
        if head is None:
            if len(self.beginnings) > REMEMBERED // 2:
                self.beginnings.clear()
            head = ([""], [self.neighbours.setdefault("", {})])
            self._extend(text, 0, n, BEGINNING, *head)
            self.beginnings[text[:BEGINNING]] = head
        path, after = head[0][:], head[1][:]
        self._extend(text, 0, n, n, path, after)
        return path

    def _extend(self, text: str, begin: int, end: int, stop: int, path: list, after: list) -> None:
        """Go on from what ``path`` and ``after`` (the neighbours of its pieces) hold."""
        solid, neighbours, lengths = self.solid, self.neighbours, self.known_lengths
        for at in range(begin + len(path), stop + 1):
            near = text[at - 3 if at > 3 else 0:at]
            for n in lengths.get(near) or self.lengths(near):
                start = at - n
                if start < begin or start >= end:
                    continue
                known = after[start - begin]
                if known is None:
                    continue
                piece = text[start:at]
                if n == 1 or piece in solid:
                    fit = known.get(piece)
                    if fit is None:
                        fit = self.allowed(path[start - begin], piece)
                    if fit:
                        path.append(piece)
                        known = neighbours.get(piece)
                        if known is None:
                            known = neighbours[piece] = {}
                        after.append(known)
                        break
            else:
                path.append(None)
                after.append(None)

    def trace(self, path: list[str | None], at: int, begin: int) -> list[int]:
        """Ids of the pieces from ``begin`` to ``at``."""
        pieces = []
        while at > begin:
            piece = path[at - begin]
            pieces.append(piece)
            at -= len(piece)
        return self.spell(pieces[::-1])

    def spell(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def stretch(self, text: str) -> bytes:
        """Ids (32-bit) of a text between two cuts or ends; remembered in two generations."""
        known = self.earlier.get(text)
        if known is None:
            cuts = [0, *self.cuts(text, 0, len(text)), len(text)]
            known = b""
            for a, b in zip(cuts, cuts[1:]):
                part = text[a:b]
                own = self.remembered.get(part)
                if own is None:
                    own = array("i", self.trace(self.whole(part), b - a, 0)).tobytes()
                    if len(part) < len(text):
                        self.remembered[part] = own
                known += own
        if len(self.remembered) > REMEMBERED:
            self.earlier, self.remembered = self.remembered, {}
        self.remembered[text] = known
        return known

    def cuts(self, text: str, begin: int, end: int) -> list[int]:
        """Positions strictly between that no piece crosses."""
        inside = self.inside
        return [i for i in range(begin + 1, end) if text[i - 1:i + 1] not in inside]

    def ids_between(self, text: str, begin: int, end: int) -> bytes:
        """Ids of text[begin:end] where both ends are cuts or ends of the text."""
        words = self.words(text[begin:end])
        found = list(map(self.remembered.get, words))
        if None in found:
            found = [self.stretch(w) if f is None else f for w, f in zip(words, found)]
        return b"".join(found)

    # ---- chunks ----

    def entries(self, text: str, at: int) -> list[tuple[int, str]]:
        """Every state a chunk that begins at ``at`` may be entered in."""
        found = [(at, text[at - 1])] if text[at - 1] not in self.ids else []
        for start in range(max(0, at - self.longest), at):
            for end in range(at, min(len(text), start + self.longest) + 1):
                if (piece := text[start:end]) in self.solid:
                    found.append((end, piece))
        return found

    def head_tail(self, text: str, begin: int, end: int, final: bool) -> tuple[int | None, int | None]:
        """First and last cut of a chunk that paths may be split at."""
        inside = self.inside
        first = next((i for i in range(begin, end + 1) if 0 < i < len(text) and text[i - 1:i + 1] not in inside), None)
        last = next((i for i in range(end, begin - 1, -1) if 0 < i < len(text) and text[i - 1:i + 1] not in inside), None)
        return (first, last) if first is not None else (None, None)

    def exits(self, text: str, begin: int, last: str, end: int, final: bool) -> list[tuple[int, str]]:
        stop = end if final else min(len(text), end + self.longest)
        if begin >= end:
            return [(begin, last)] if not final or begin == end else []
        path = self.forward(text, begin, last, end, stop)
        return [(at, path[at - begin]) for at in range(end, stop + 1) if path[at - begin] is not None]

    def transfer(self, text: str, begin: int, end: int, first: bool, final: bool) -> list[tuple[tuple, tuple]]:
        """Finite entries of the chunk's (max, +) matrix: (state on entry, state on exit)."""
        starts = [(begin, "")] if first else self.entries(text, begin)
        cut, back = self.head_tail(text, begin, end, final)
        if cut is None:
            return [(s, e) for s in starts for e in self.exits(text, *s, end, final)]
        # All paths meet in the cuts: what follows is the same for each way in.
        ways_in = [s for s in starts if s[0] <= cut and self.forward(text, *s, cut, cut)[cut - s[0]] is not None]
        if back == end:
            # The chunk ends in a cut, reached by one piece.
            lead = self.stretch_end(text, cut, back)
            out = [(end, lead)] if lead else None
            if out is None:
                return [(s, (end, self.forward(text, *s, cut, cut)[cut - s[0]])) for s in ways_in]
        else:
            out = self.exits(text, back, "", end, final)
        return [(s, e) for s in ways_in for e in out]

    def stretch_end(self, text: str, cut: int, end: int) -> str | None:
        """Last piece before the cut at ``end``, or None if ``cut`` is ``end`` itself."""
        if cut == end:
            return None
        before = next(i for i in range(end - 1, cut - 1, -1) if i == cut or text[i - 1:i + 1] not in self.inside)
        return self.forward(text, before, "", end, end)[end - before]

    def walk(self, text: str, entry: tuple[int, str], leave: tuple[int, str], begin: int, end: int, final: bool) -> bytes:
        """Ids of the pieces that start in the chunk, given the states at its ends."""
        if entry[0] >= end:
            return b""
        cut, back = self.head_tail(text, begin, end, final)

        def path(lo, last, hi):
            return array("i", self.trace(self.forward(text, lo, last, end, hi), hi, lo)).tobytes()
        if cut is None or cut < entry[0]:
            return path(*entry, leave[0])
        out = path(*entry, cut) + self.ids_between(text, cut, back)
        return out + path(back, "", leave[0]) if back < leave[0] else out

    def encode(self, text: str) -> list[int]:
        """Ids of a text of one chunk."""
        return list(array("i", self.ids_between(text, 0, len(text)))) if text else []

    def normal(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def decode(self, ids) -> str:
        """The text of a list of ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "replace")
        return text[len(self.prefix):] if self.prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


# ---- Spark side ------------------------------------------------------------------------


def _out(m: Model, columns: list, names: list[str], parts: list[bytes | None], decoded: bool) -> pa.RecordBatch:
    """The rows with their ids and, if asked for, the texts that these ids spell."""
    more, more_names = [id_lists(parts)], ["ids"]
    if decoded:
        more.append(pa.array([None if p is None else m.decode(np.frombuffer(p, np.int32).tolist()) for p in parts], pa.string()))
        more_names.append("decoded")
    return pa.RecordBatch.from_arrays([*columns, *more], names=[*names, *more_names])


def id_lists(parts: list[bytes | None]) -> pa.ListArray:
    """An Arrow list column from 32-bit ids in bytes."""
    edge = np.concatenate([[0], np.cumsum([len(p or b"") // 4 for p in parts])]).astype(np.int32)
    mask = pa.array([p is None for p in parts])
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(np.frombuffer(b"".join(p or b"" for p in parts), np.int32)), mask=mask)


def _short_batches(path, schema_names, decoded):
    def run(batches):
        m = model(path)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for lo in range(0, len(texts), 1000):
                part = batch.slice(lo, 1000)
                ids = [None if t is None else m.ids_between(n := m.normal(t), 0, len(n)) for t in texts[lo:lo + 1000]]
                yield _out(m, [part.column(c) for c in schema_names], schema_names, ids, decoded)
        C.tidy()
    return run


_CHUNK = "id long, tkey long, idx int, matrix binary"


def pieces_of(m: Model, text: str, chunk: int):
    """(text with its surroundings, their position, begin, end, is last) of each chunk of a normal text."""
    for lo in range(0, len(text), chunk):
        hi = min(len(text), lo + chunk)
        base = max(0, lo - m.longest)
        yield text[base:min(len(text), hi + m.longest)], base, lo - base, hi - base, hi == len(text)


def _chunk_batches(path, chunk):
    """The matrix of every chunk."""
    def run(batches):
        m = model(path)
        for batch in batches:
            rows = []
            for id_, key, text in zip(*(batch.column(c).to_pylist() for c in ("id", "tkey", "text"))):
                for c, (part, base, lo, hi, final) in enumerate(pieces_of(m, m.normal(text), chunk)):
                    # Positions are kept relative to the document.
                    cells = [((a + base, p), (b + base, q)) for (a, p), (b, q) in m.transfer(part, lo, hi, c == 0, final)]
                    rows.append((id_, key, c, pickle.dumps(cells)))
                    if len(rows) == 4096:
                        yield _rows(rows, _CHUNK)
                        rows = []
            if rows:
                yield _rows(rows, _CHUNK)
        C.tidy()
    return run


def _product(a: list, b: list) -> list:
    """(max, +) product of two matrices given by their finite (zero) entries."""
    onward: dict = {}
    for s, e in b:
        onward.setdefault(s, set()).add(e)
    return sorted({(s, e) for s, mid in a for e in onward.get(mid, ())})


def _settle(matrices: list[list], entry, leave) -> list[tuple]:
    """States before each matrix and after the last, on the one finite path from entry to leave."""
    reach = [{entry}]
    for m in matrices:
        reach.append({e for s, e in m if s in reach[-1]})
    states = [leave if leave is not None else next(iter(reach[-1]))]
    for m, before in zip(reversed(matrices), reversed(reach[:-1])):
        states.append(next(s for s, e in m if e == states[-1] and s in before))
    return states[::-1]


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names=list(names))


_PRODUCT = "id long, tkey long, run int, matrix binary"
_RUN_ENDS = "id long, tkey long, run int, entry binary, leave binary"
_CHUNK_ENDS = "id long, tkey long, idx int, entry binary, leave binary"


def _product_batches(batches):
    """One matrix for each run of chunks."""
    for batch in batches:
        rows = [(i, k, r, pickle.dumps(functools.reduce(_product, [pickle.loads(c["matrix"]) for c in cells])))
                for i, k, r, cells in zip(*(batch.column(c).to_pylist() for c in ("id", "tkey", "run", "cells")))]
        if rows:
            yield _rows(rows, _PRODUCT)


def _run_end_batches(batches):
    """States at the ends of a document's runs."""
    for batch in batches:
        rows = []
        for i, k, runs in zip(*(batch.column(c).to_pylist() for c in ("id", "tkey", "runs"))):
            states = list(map(pickle.dumps, _settle([pickle.loads(r["matrix"]) for r in runs], (0, ""), None)))
            rows += [(i, k, r["run"], a, b) for r, a, b in zip(runs, states, states[1:])]
        if rows:
            yield _rows(rows, _RUN_ENDS)


def _chunk_end_batches(batches):
    """States at the ends of a run's chunks."""
    for batch in batches:
        rows = []
        for i, k, cells, entry, leave in zip(*(batch.column(c).to_pylist() for c in ("id", "tkey", "cells", "entry", "leave"))):
            states = list(map(pickle.dumps, _settle([pickle.loads(c["matrix"]) for c in cells], pickle.loads(entry), pickle.loads(leave))))
            rows += [(i, k, c["idx"], a, b) for c, a, b in zip(cells, states, states[1:])]
        if rows:
            yield _rows(rows, _CHUNK_ENDS)


def _walk_batches(path, chunk, names, decoded):
    """Each chunk's way back from the states at its ends, whatever the other chunks do."""
    def run(batches):
        m = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part_of = batch.slice(at, 200)
                ids = []
                for text, states in zip(part_of.column("_text").to_pylist(), part_of.column("states").to_pylist()):
                    out = []
                    for (part, base, lo, hi, final), state in zip(pieces_of(m, m.normal(text), chunk), states):
                        (a, p), (b, q) = pickle.loads(state["entry"]), pickle.loads(state["leave"])
                        out.append(m.walk(part, (a - base, p), (b - base, q), lo, hi, final))
                    ids.append(b"".join(out))
                yield _out(m, [part_of.column(c) for c in names], names, ids, decoded)
        C.tidy()
    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
           decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), the pieces of the whole text; a column of that name is replaced.

    With ``decoded`` the same tasks also decode the ids again (see ``decode``), so that a
    round trip needs one set of Python workers.

    Texts of one chunk are encoded where they are.  Of longer ones only the matrices of chunks
    travel and meet, in groups of ``RUN``; the states at the ends of the chunks come back to the
    document's row, where each chunk is walked on its own.
    """
    C.ship(docs.sparkSession)
    added = ["ids", "decoded"] if decoded else ["ids"]
    given = [c for c in docs.columns if c not in added]
    # Columns go by number, so none clashes with those added here.
    names = [f"c{i}" for i in range(len(given))]
    kept = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(given, names)], F.col(text_col).alias("_text"),
                       F.col(id_col).cast("long").alias("_id"))
    schema = T.StructType([*[kept.schema[c] for c in names], T.StructField("ids", T.ArrayType(T.IntegerType())),
                           *([T.StructField("decoded", T.StringType())] if decoded else [])])
    is_long = F.coalesce(F.length("_text") > chunk, F.lit(False))
    short = kept.where(~is_long).mapInArrow(_short_batches(model_path, names, decoded), schema)

    key = {"id": F.coalesce(F.col("_id"), F.lit((1 << 63) - 1)), "tkey": F.xxhash64("_text")}
    giants = kept.where(is_long).withColumns(key)
    # Rows that repeat id and text have the same matrices.
    chunks = C.saved(giants.select("id", "tkey", F.col("_text").alias("text")).mapInArrow(_chunk_batches(model_path, chunk), _CHUNK)
                     .dropDuplicates(["id", "tkey", "idx"]), "chunks")
    # At most RUN matrices a row, and at most 2^31 / (chunk * RUN) runs a document.
    runs = (chunks.groupBy("id", "tkey", F.floor(F.col("idx") / RUN).cast("int").alias("run"))
            .agg(F.sort_array(F.collect_list(F.struct("idx", "matrix"))).alias("cells")))
    products = runs.mapInArrow(_product_batches, _PRODUCT)
    ends = (products.groupBy("id", "tkey").agg(F.sort_array(F.collect_list(F.struct("run", "matrix"))).alias("runs"))
            .mapInArrow(_run_end_batches, _RUN_ENDS))
    states = runs.join(ends, ["id", "tkey", "run"]).mapInArrow(_chunk_end_batches, _CHUNK_ENDS)
    known = states.groupBy("id", "tkey").agg(F.sort_array(F.collect_list(F.struct("idx", "entry", "leave"))).alias("states"))
    long = giants.join(known, ["id", "tkey"]).mapInArrow(_walk_batches(model_path, chunk, names, decoded), schema)
    return short.unionByName(long).toDF(*given, *added)


def _decode_batches(path, names):
    def run(batches):
        m = model(path)
        for batch in batches:
            texts = [m.decode(np.asarray(x.values).tolist()) if x.is_valid else None for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], names=[*names, "decoded"])
    return run


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text its ids spell."""
    C.ship(encoded.sparkSession)
    names = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*[encoded.schema[c] for c in names], T.StructField("decoded", T.StringType())])
    return encoded.select(*names).mapInArrow(_decode_batches(model_path, names), schema)
