import hashlib
import itertools
import random
import re
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from marshgrid.llm import repair as R


def brute(codes):
    """Cheapest, then ASCII-least edits by trying them all, in a plain recursion over rows and roles."""
    n = len(codes) // 2

    @lru_cache(None)
    def rest(i, done, inserts):
        ways = []
        if inserts < 3:
            for role in "ua":
                ways += [(c + 2, "I" + e) for c, e in [rest(i, step(done, role), inserts + 1)] if step(done, role) is not None and c is not None]
        if i == n:
            if done in ("", "a"):
                ways.append((0, ""))
        else:
            role, fault = codes[2 * i], codes[2 * i + 1]
            ways += [(c + 3, "D" + e) for c, e in [rest(i + 1, done, 0)] if c is not None]
            if fault not in "bd":
                more = fault == "t"
                if step(done, role) is not None:
                    ways += [(c + more, "K" + e) for c, e in [rest(i + 1, step(done, role), 0)] if c is not None]
                for new in "ua":
                    if step(done, new) is not None:
                        ways += [(c + 2 + more, "R" + e) for c, e in [rest(i + 1, step(done, new), 0)] if c is not None]
        return min(ways, default=(None, None))

    def step(done, role):
        """Last role after one more, None if the sequence cannot be completed."""
        return role if (done + role) in ("s", "u", "su", "ua", "au") else None
    rest_of = rest

    @lru_cache(None)
    def guarded(i, done, inserts):
        return (None, None) if done is None else rest_of(i, done, inserts)
    rest = guarded
    return guarded(0, "", 0)


def test_equals_brute_force_on_all_short_runs():
    kinds = ["s-", "u-", "a-", "x-", "ut", "at", "ub", "ad"]
    for n in range(4):
        for combo in itertools.product(kinds, repeat=n):
            assert R.cheapest("".join(combo)) == brute("".join(combo)), combo


def test_equals_brute_force_on_random_runs_and_chunks():
    r = random.Random(5)
    for n in [5, 9, 14, 25] * 12:
        codes = "".join(r.choice("sua" * 3 + "x") + r.choice("-----tttbd") for _ in range(n))
        want = brute(codes)
        assert R.cheapest(codes) == want
        cuts = [codes[2 * i:2 * i + 8] for i in range(0, n, 4)]
        whole = R.chunk_matrix(cuts[0])
        for c in cuts[1:]:
            whole = R.combine(whole, R.chunk_matrix(c))
        assert min(x for x in (whole[R.START], whole[R.ASSISTANT]) if x) == want


def expected(rows):
    """What is to come out of one conversation's rows (turn, role, text) in order."""
    seen, codes, counts = set(), "", dict.fromkeys("bdt-", 0)
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "b" if not words else "d" if (role, text) in seen else "-" if words[-1] in ".!?" else "t"
        seen.add((role, text))
        counts[fault] += 1
        codes += (role[:1] if role[:1] in tuple("sua") else "x") + fault
    cost, audit = brute(codes) if rows else (0, "")
    out, at, last = [], 0, ""
    for e in audit:
        new = {"u": "assistant"}.get(last, "user")
        role, text = rows[at][1:] if e != "I" else (None, None)
        if e != "D":
            out.append({"K": f"{role}:{text}", "R": f"{new}:{text}", "I": f"{new}:"}[e])
            last = out[-1][0]
        at += e != "I"
    turns = {t for t, _, _ in rows if t is not None}
    firsts = [(r[:1] or " ") for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["b"], counts["d"], counts["t"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


ROWS = "conv_id long, turn long, role string, text string, key string, idx string"


@pytest.fixture(scope="module")
def turns(spark):
    r = random.Random(9)
    rows = []
    for conv in [1, 2, 3, None]:
        for turn in range(r.randint(3, 9)):
            rows.append((conv, turn * r.randint(1, 2), r.choice(["user", "assistant", "system", "tool", ""]), r.choice(["Yes.", "no", " \n", "What?  ", "été!"]), "k", "i"))
    rows += [(4, 0, "user", None, None, None), (5, None, None, "a.", "k", "i"), (5, None, "user", "a.", "k", "i"), (6, 7, "user", "x" * 30000 + ".", "k", "i")]
    rows += [(7, t, "user" if t % 2 == 0 else "assistant", "ok." if t % 5 else f"say {t}", "k", "i") for t in range(61)]
    return spark.createDataFrame(rows, ROWS)


def test_conversations_equal_brute_force(spark, turns):
    groups = {}
    for r in turns.collect():
        groups.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or " ", r["text"] or " "))
    rows = turns.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    for chunk in (128, 8):
        for got in R.repair(rows, chunk=chunk).collect():
            mine = sorted(groups[got["conv_id"]], key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
            assert tuple(got)[1:] == expected(mine), (chunk, got["conv_id"])


def test_chunks_are_combined_in_several_rounds(spark, turns):
    rows = R.faults(turns.where("conv_id = 7"))
    assert R.search(rows, chunk=4, fan=2).first() == R.search(rows, chunk=200).first()


def test_repaired_turns_are_well_formed(spark, turns):
    rows = R.faults(R.damaged(turns))
    out = {}
    for r in R.repaired_turns(rows, R.search(rows)).orderBy("key", "position").collect():
        out[r["key"]] = out.get(r["key"], "") + r["role"][0]
    assert out and all(re.fullmatch("(s?(ua)+)?", x) for x in out.values())


def test_damage(spark):
    import zlib
    rows = [(c, t, "assistant", "One. Two!") for c in range(8) for t in range(12)] + [(None, None, None, None)]
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text or " ")}.get(kind, text or " ")
        want += [(conv, turn, "user" if kind == 4 else role or " ", text)] * {0: 0, 3: 2}.get(kind, 1)
    got = R.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_conversations_that_lost_everything(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repair(R.damaged(empty), empty).count() == 0
    gone = spark.createDataFrame([(9,), (None,)], "conv_id long")
    rows = R.repair(empty, gone).collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] * 2
