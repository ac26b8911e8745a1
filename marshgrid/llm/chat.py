r"""Chat formatting with a grammar round trip.

A turn is rendered as a line ``### <Role>:``, the content and a line ``</turn>``:

    conversation = turn*
    turn         = "### " role ":" NL content NL "</turn>" NL
    control      = ("### " role ":") or "</turn>"

Inside content a control string is told from a real one by the backslashes before it: the
parser takes one off each run of backslashes that precedes a control string and ends the
turn at a ``</turn>`` line whose control string has none.  Rendering tries the content as it
is, parses the result, and adds one backslash before every control string as long as the
recovered turns differ from the source.

Turns are ranged by conversation and streamed in order through each task, so a conversation
of any length needs the memory of one turn.  The output is a table of rendered turns in
order (their texts one after the other are the conversation's document) with the spans that
count for the loss; reading back runs the parser over that text.

Defined results: a null text is empty; a null role is the empty role; roles that are not lower
case letters only are written as a JSON string; turns of equal number are ordered by role and
text; repeated rows are repeated turns; a null conversation id is a conversation, a null turn
comes first.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marshgrid.llm import common as C

LOSS_ROLES = ("assistant",)
_ROLE = r'(?:[A-Z][a-z]*|"(?:[^"\\\n]|\\.)*")'
_CONTROL = re.compile(rf"\\*(?:### {_ROLE}:|</turn>)")
_HEADER = re.compile(rf"### ({_ROLE}):\n")
#: End of a turn: the control string at the start of a line, without a backslash.
END = "\n</turn>\n"


def role_name(role: str) -> str:
    return role.capitalize() if re.fullmatch("[a-z]+", role) else json.dumps(role)


def role_of(name: str) -> str:
    return json.loads(name) if name.startswith('"') else name.lower()


def guard(content: str) -> str:
    """One more backslash before every control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], content)


def unguard(content: str) -> str:
    """Take the backslash off again."""
    return _CONTROL.sub(lambda m: m[0][1:] if m[0].startswith("\\") else m[0], content)


def parse(text: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """The turn at ``at``: (role, text, content start, content end, end of the turn)."""
    head = _HEADER.match(text, at)
    if not head:
        raise ValueError(f"no turn at {at}")
    begin = head.end()
    end = text.find(END, begin)
    if end < 0:
        raise ValueError(f"open turn at {at}")
    return role_of(head[1]), unguard(text[begin:end]), begin, end, end + len(END)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(rendered turn, content start, content end), escaped until the parser recovers the turn."""
    content = text
    while True:
        out = f"### {role_name(role)}:\n{content}{END}"
        got_role, got, begin, end, after = parse(out)
        if got_role == role and got == text and after == len(out):
            return out, begin, end
        content = guard(content)
        if len(content) > 2 * len(text) + 64 * (text.count("</turn>") + text.count("### ") + 1):
            raise ValueError("a turn could not be escaped")


def _render_batches(batches):
    for batch in batches:
        rows = [render(role, text) for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([
            batch.column("conv_id"), batch.column("turn"), pa.array([r[0] for r in rows], pa.string()),
            pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()),
            pa.array([x in LOSS_ROLES for x in batch.column("role").to_pylist()])],
            names=["conv_id", "turn", "rendered", "content_start", "content_end", "in_loss"])


def format_chat(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn in conversation order: rendered text, content span, loss flag.

    The result is written to the shared folder, sorted inside its files by conversation and
    ``seq``, the position of the turn under (turn, role, text).
    """
    C.ship(turns.sparkSession)
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rendered = ordered.mapInArrow(_render_batches, "conv_id long, turn long, rendered string, content_start int, content_end int, in_loss boolean")
    # Rows keep their order inside a partition: the running number follows it.
    return C.saved(rendered.withColumn("seq", F.monotonically_increasing_id()), "chats")


class _Digest:
    """Running sums of one conversation read back from its text."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: list[tuple[int, int]]) -> str:
        """Parse the whole turns in ``text`` and return what is left over."""
        at, spans = 0, iter(spans)
        while at < len(text):
            try:
                role, content, begin, end, after = parse(text, at)
            except ValueError:
                break
            self.turns += 1
            self.all.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
            at = after
        for a, b in spans:
            masked = unguard(text[a:b])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode("utf-8", "surrogatepass"))
        self.chars += at
        return text[at:]

    def row(self):
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_batches(batches):
    now, rest, done = None, "", []

    def close():
        if rest:
            raise ValueError(f"conversation {now.conv_id} does not end with a whole turn")
        done.append(now.row())
    for batch in batches:
        for conv, text, begin, end, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rendered", "content_start", "content_end", "in_loss"))):
            if now is None or conv != now.conv_id:
                if now is not None:
                    close()
                now, rest = _Digest(conv), ""
            shift = len(rest)
            rest = now.add(rest + text, [(begin + shift, end + shift)] if loss else [])
        if done:
            yield _rows(done)
            done = []
    if now is not None:
        close()
        yield _rows(done)


def _rows(done):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), kinds)], names=[x.split()[0] for x in _READ.split(", ")])


def read_chat(rendered: DataFrame) -> DataFrame:
    """Digests per conversation, from parsing the rendered text again as a stream."""
    C.ship(rendered.sparkSession)
    return (rendered.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
            .select("conv_id", "rendered", "content_start", "content_end", "in_loss").mapInArrow(_read_batches, _READ))
