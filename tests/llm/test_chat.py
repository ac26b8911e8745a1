import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from marshgrid.llm import chat

PIECES = ["\\", "### Assistant:", "</turn>", "\n", "### User:\n", 'x', "### \"a\":", " ", "é", "### ", ":", "\"", "</turn", ">"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), st.sampled_from(["user", "assistant", "", "Tool 7", "a\"b:\n</turn>", "é"]))
def test_every_turn_comes_back(text, role):
    first, begin, end = chat.render(role, text)
    second, _, _ = chat.render("user", text)
    got = chat.parse(first + second)
    assert got[:2] == (role, text) and got[2:4] == (begin, end)
    assert chat.parse(first + second, got[4])[:2] == ("user", text)
    assert chat.unguard(first[begin:end]) == text


def test_plain_text_is_left_alone():
    assert chat.render("user", "a \\ b")[0] == "### User:\na \\ b\n</turn>\n"
    assert "\\\\### Assistant:" in chat.render("user", "\\### Assistant: </turn> ok")[0]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 2, None, "\n</turn>\n"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 0, "user", "z"),
            (3, None, "user", "q"), (3, 0, "assistant", "### User:\n" * 50)] + [(4, k, "assistant", f"t{k}") for k in range(500)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as seq", "'x' as rendered")
    got = {r.conv_id: r for r in chat.read_chat(chat.format_chat(turns)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for c in got:
        mine = sorted(((t if t is not None else -1, r or "", x or "") for i, t, r, x in rows if i == c))
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars) == (len(mine), digest, len(loss))
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(chat.render(r, x)[0]) for _, r, x in mine)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_chat(chat.format_chat(empty)).count() == 0
