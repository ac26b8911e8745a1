r"""Conversation structure repair: the cheapest edits that give ``(s?(ua)+)?``.

Rows of a conversation are kept (K), given the role user or assistant (R), deleted (D), and
empty turns of user or assistant are inserted (I) anywhere, so that the initials of the
roles read: at most one system turn, then user and assistant in turn; or nothing at all.
Blank and duplicate rows must go; a truncated row that stays costs extra.

The edits form a lattice of (rows consumed, last role).  It is searched from both ends, by
two heaps, until what they hold cannot meet more cheaply; of all crossings of that cost the
least concatenation of the edits' initials is taken.  A conversation longer than a chunk is
cut into chunks of rows: each is searched between all pairs of last roles, the results are
combined as (min, concatenate) matrices, at most ``FAN`` at a time, until one is left.  So
no task holds more than a chunk's rows.  Rendering streams the rows in order.

Two edit strings of equal cost between the same two nodes never begin with one another
(the rest would be inserts alone, which cost), so the least string of a path is made of the
least strings of its parts.

Defined results: null roles and texts are one space; a null conversation id is a
conversation; null turns come first; rows of equal turn are ordered by role and the text's
digest; a repeated row is a duplicate; a conversation without rows has an empty audit and
the digest of the empty string; columns that are not named are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marshgrid.llm import common as C
from marshgrid.llm.positions import placed

CHUNK, FAN = 128, 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
OK, BLANK, DUPLICATE, CUT = "-", "b", "d", "t"
#: States: nothing yet, after system, after user, after assistant.  The role that an inserted or re-roled turn takes follows from the state.
START, SYSTEM, USER, ASSISTANT = range(4)
_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAME = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_BACK_TURN = {t: [s for s in range(4) if _TURN[s] == t] for t in range(4)}
_BACK_KEPT = {c: {t: [s for s in m if m[s] == t] for t in range(4)} for c, m in _KEPT.items()}


def _onward(codes: str, at: tuple):
    """(cost, edit, node) of the edits from a node on."""
    i, state = at
    yield INSERT, "I", (i, _TURN[state])
    if 2 * i == len(codes):
        return
    initial, fault = codes[2 * i], codes[2 * i + 1]
    yield DELETE, "D", (i + 1, state)
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT else 0
    yield REROLE + more, "R", (i + 1, _TURN[state])
    kept = _KEPT.get(initial, {}).get(state)
    if kept is not None:
        yield KEEP + more, "K", (i + 1, kept)


def _backward(codes: str, at: tuple):
    """(cost, edit, node) of the edits that lead to a node."""
    i, state = at
    for s in _BACK_TURN[state]:
        yield INSERT, "I", (i, s)
    if i == 0:
        return
    initial, fault = codes[2 * i - 2], codes[2 * i - 1]
    yield DELETE, "D", (i - 1, state)
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT else 0
    for s in _BACK_TURN[state]:
        yield REROLE + more, "R", (i - 1, s)
    for s in _BACK_KEPT.get(initial, {}).get(state, ()):
        yield KEEP + more, "K", (i - 1, s)


class _Front:
    """One of the two searches: best known (cost, edits) of each node and a heap of open ones."""

    def __init__(self, codes: str, sources, edges, sign: int):
        self.codes, self.edges, self.sign = codes, edges, sign
        self.best = {v: (0, "") for v in sources}
        self.heap = [(0, sign * v[0], v[1]) for v in sources]
        heapq.heapify(self.heap)
        self.done: set = set()

    def top(self) -> float:
        while self.heap and (self.sign * self.heap[0][1], self.heap[0][2]) in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else math.inf

    def settle(self, other: "_Front", found: float) -> float:
        """Settle the nearest open node; the cheapest meeting known after it."""
        # At equal cost rows go in the search's direction, so edits that cost nothing are all known before a node is settled.
        cost, i, state = heapq.heappop(self.heap)
        at = (self.sign * i, state)
        self.done.add(at)
        edits = self.best[at][1]
        for more, edit, to in self.edges(self.codes, at):
            label = (cost + more, edits + edit if self.sign > 0 else edit + edits)
            known = self.best.get(to)
            if known is None or label < known:
                self.best[to] = label
                if known is None or label[0] < known[0]:
                    heapq.heappush(self.heap, (label[0], self.sign * to[0], to[1]))
                if to in other.best:
                    found = min(found, label[0] + other.best[to][0])
        return found


def cheapest(codes: str, start: int = START, goals=(START, ASSISTANT)) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest, then ASCII-least edits of a run of rows, from one state to any of ``goals``.

    ``codes`` holds two characters a row: the role's initial and the fault.
    """
    n = len(codes) // 2
    ahead = _Front(codes, [(0, start)], _onward, 1)
    behind = _Front(codes, [(n, g) for g in goals], _backward, -1)
    found = min((0 for v in ahead.best if v in behind.best), default=math.inf)
    while True:
        a, b = ahead.top(), behind.top()
        # Paths of the found cost may cross elsewhere: go on until no other can.
        if a + b > found or math.isinf(a + b):
            break
        found = ahead.settle(behind, found) if a <= b else behind.settle(ahead, found)
    if math.isinf(found):
        return None
    few, many = sorted((ahead.best, behind.best), key=len)
    return min((int(found), ahead.best[v][1] + behind.best[v][1]) for v in few if v in many and ahead.best[v][0] + behind.best[v][0] == found)


def chunk_matrix(codes: str) -> list:
    """(cost, edits) between all pairs of states, None where there is no way."""
    return [cheapest(codes, s, (t,)) for s in range(4) for t in range(4)]


def combine(left: list, right: list) -> list:
    """(min, concatenate) product of two matrices."""
    out = []
    for s in range(4):
        for t in range(4):
            ways = [(a[0] + b[0], a[1] + b[1]) for m in range(4) if (a := left[4 * s + m]) and (b := right[4 * m + t])]
            out.append(min(ways, default=None))
    return out


# ---- damage and faults ---------------------------------------------------------------


def damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text, copy) after the damage that the checksum of ``conv_id:turn`` chooses."""
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), blank), F.coalesce(F.col(turn_col).cast("string"), blank))
    rows = C.fixed(turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), blank).alias("role"),
                                F.coalesce(F.col(text_col), blank).alias("text"), key.alias("_key")), _kind=(F.crc32("_key") % 20).cast("int")).where("_kind != 0")
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.col("role").alias("role_before"), F.sha2(F.col("text"), 256).alias("text_before"), F.explode(copies).alias("copy"))


def _fault(text: Column, repeats: Column) -> Column:
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return (F.when(~F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(BLANK)).when(repeats, F.lit(DUPLICATE))
            .when(~last.isin(".", "!", "?"), F.lit(CUT)).otherwise(F.lit(OK)))


def faults(rows: DataFrame) -> DataFrame:
    """Rows in their places: key, conv_id, idx, turn, role, text, n and ``code``, the role's initial and the first fault."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    more = {"role_before": F.col("role"), "text_before": F.sha2(F.col("text"), 256), "copy": F.lit(0)}
    rows = rows.withColumns({c: v for c, v in more.items() if c not in rows.columns}).withColumn("key", key).withColumn("_row", F.monotonically_increasing_id())
    table = C.saved(placed(rows, "key", ["turn", "role_before", "text_before", "copy", "_row"])
                    .select("key", "conv_id", "idx", "turn", "role", "text", "n"), "turns")
    # Rows seen first keep their places; all others repeat one.  Two aggregates combine before they shuffle, and places are unique.
    first = table.groupBy("key", "role", F.sha2(F.col("text"), 256).alias("_text")).agg(F.min("idx").alias("idx"))
    marked = table.join(first.select("key", "idx", F.lit(True).alias("_first")), ["key", "idx"], "left")
    initial = F.when(F.length("role") > 0, F.substring("role", 1, 1)).otherwise(F.lit(" "))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return C.saved(marked.select("key", "conv_id", "idx", "turn", "role", "text", "n",
                                 F.concat(initial, _fault(F.col("text"), F.col("_first").isNull())).alias("code")), "faults")


# ---- search by chunks -----------------------------------------------------------------

_MATRIX = "key string, chunk long, chunks long, costs array<long>, audits array<string>"
_MATRIX_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))


def _matrix_batch(rows):
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _MATRIX_TYPES)], names=[x.split()[0] for x in _MATRIX.split(", ")])


def _split(matrix):
    return [None if x is None else x[0] for x in matrix], [None if x is None else x[1] for x in matrix]


def _search_batches(batches):
    """One answer for a conversation of one chunk, else the chunk's matrix."""
    for batch in batches:
        out = []
        for key, chunk, chunks, codes in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "chunks", "codes"))):
            out.append((key, chunk, chunks, *_split([cheapest(codes)] if chunks == 1 else chunk_matrix(codes))))
        yield _matrix_batch(out)


def _combine_batches(batches):
    for batch in batches:
        out = []
        for key, chunk, chunks, parts in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "chunks", "parts"))):
            at = None
            for p in parts:
                matrix = [None if c is None else (c, a) for c, a in zip(p["costs"], p["audits"])]
                at = matrix if at is None else combine(at, matrix)
            if chunks == 1:
                at = [min(x for x in (at[START], at[ASSISTANT]) if x)]
            out.append((key, chunk, chunks, *_split(at)))
        yield _matrix_batch(out)


def search(rows: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(key, cost, audit) of every conversation in ``rows`` (key, idx, n, code)."""
    C.ship(rows.sparkSession)
    size = F.expr(f"(n + {chunk - 1}) div {chunk}")
    codes = (rows.groupBy("key", F.expr(f"idx div {chunk}").alias("chunk"))
             .agg(F.max(size).alias("chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "code"))), lambda x: x["code"]), "").alias("codes")))
    now = C.saved(codes.mapInArrow(_search_batches, _MATRIX), "searched")
    answers = now.where("chunks = 1")
    while now.where("chunks > 1").limit(1).count():
        parts = (now.where("chunks > 1").groupBy("key", F.expr(f"chunk div {fan}").alias("chunk"))
                 .agg(F.max(F.expr(f"(chunks + {fan - 1}) div {fan}")).alias("chunks"),
                      F.array_sort(F.collect_list(F.struct(F.col("chunk").alias("at"), "costs", "audits"))).alias("parts")))
        now = C.saved(parts.mapInArrow(_combine_batches, _MATRIX), "combined")
        answers = answers.unionByName(now.where("chunks = 1"))
    return answers.select("key", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))


# ---- rendering ------------------------------------------------------------------------

_REPORT = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Repair:
    """Applies an audit to the rows of one conversation as they come, and digests what stays."""

    def __init__(self, key, cost: int, audit: str):
        self.key, self.cost, self.audit, self.at, self.state = key, cost, audit, 0, START
        self.hash, self.turns, self.before = hashlib.sha256(), 0, None
        self.counts = {BLANK: 0, DUPLICATE: 0, CUT: 0, OK: 0}
        self.illegal = 0

    def _emit(self, role: str, text: str) -> tuple[str, str]:
        self.hash.update((("\n" if self.turns else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.turns += 1
        return role, text

    def _inserted(self):
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = _TURN[self.state]
            yield self._emit(_NAME[self.state], "")

    def row(self, role: str, text: str, code: str):
        """The turns that follow from the next row and the inserts before it."""
        self.counts[code[1]] += 1
        if self.before is not None and self.before + code[0] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = code[0]
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _KEPT[code[0]][self.state]
            yield self._emit(role, text)
        elif edit == "R":
            self.state = _TURN[self.state]
            yield self._emit(_NAME[self.state], text)

    def close(self):
        yield from self._inserted()
        if self.at != len(self.audit):
            raise ValueError(f"edits of conversation {self.key} do not fit its rows")

    def report(self):
        return (self.key, self.counts[BLANK], self.counts[DUPLICATE], self.counts[CUT], self.illegal, self.cost, self.audit, self.hash.hexdigest())


def _stream(batches):
    """(repair, turn or None) in order: every turn that stays, and None at a conversation's end."""
    now = None
    for batch in batches:
        for key, idx, role, text, code, cost, audit in zip(*(batch.column(c).to_pylist() for c in ("key", "idx", "role", "text", "code", "cost", "audit"))):
            if idx < 0:
                if now is not None:
                    for turn in now.close():
                        yield now, turn
                    yield now, None
                now = Repair(key, cost, audit)
            else:
                for turn in now.row(role, text, code):
                    yield now, turn
    if now is not None:
        for turn in now.close():
            yield now, turn
        yield now, None


def _report_batches(batches):
    kinds = (pa.string(), *[pa.int64()] * 5, pa.string(), pa.string())
    names, rows = [x.split()[0] for x in _REPORT.split(", ")], []
    for repair, turn in _stream(batches):
        if turn is None:
            rows.append(repair.report())
            if len(rows) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)


_TURNS = "key string, position long, role string, text string"


def _turn_batches(batches):
    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string()))],
                                          names=[x.split()[0] for x in _TURNS.split(", ")])
    rows, held = [], 0
    for repair, turn in _stream(batches):
        if turn is not None:
            rows.append((repair.key, repair.turns - 1, *turn))
            held += len(turn[1])
        if len(rows) >= 1000 or held > C.SLICE_BYTES:
            yield out(rows)
            rows, held = [], 0
    if rows:
        yield out(rows)


def _with_edits(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of each conversation behind a row that holds its edits, in order."""
    edits = answers.select("key", F.lit(-1).cast("long").alias("idx"), *[F.lit(None).cast("string").alias(c) for c in ("role", "text", "code")], "cost", "audit")
    plain = rows.select("key", "idx", "role", "text", "code", F.lit(None).cast("long").alias("cost"), F.lit(None).cast("string").alias("audit"))
    return edits.unionByName(plain).repartition("key").sortWithinPartitions("key", "idx")


def repaired_turns(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, position, role, text): the turns of every conversation after its edits."""
    return _with_edits(rows, answers).mapInArrow(_turn_batches, _TURNS)


def repair(turns: DataFrame, originals: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per conversation: gaps, faults, the cheapest audit and the digest of the repaired turns.

    ``turns`` (conv_id, turn, role, text, and what orders rows of equal turn, see ``damaged``);
    ``originals`` (conv_id) names conversations that may have lost all their rows.
    """
    C.ship(turns.sparkSession)
    rows = faults(turns)
    report = _with_edits(rows, search(rows, chunk)).mapInArrow(_report_batches, _REPORT)
    # Distinct turns are counted in two steps, the first of them by turn.
    span = (rows.where("turn is not null").groupBy("key", "turn").agg(F.lit(1).cast("long").alias("one")).groupBy("key")
            .agg((F.max("turn") - F.min("turn") + 1 - F.sum("one")).alias("gaps")))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    every = (turns if originals is None else originals).select("conv_id").distinct().withColumn("key", key)
    out = every.join(report, "key", "left").join(span, "key", "left")
    zero = F.lit(0).cast("long")
    return out.select("conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
