import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lattigraph.llm import chat
from pyspark.sql import functions as F


@given(st.text(alphabet="<\\|>aimstrend_\n"))
def test_escape_is_reversible_and_hides_control_strings(t):
    assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
    assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def expected(rows):
    """conv_id -> (n_turns, turns digest, loss text), by hand."""
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=key)
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        out[c] = len(mine), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
    return out


ROWS = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "<|im_start|>assistant ok<\\|x|>"), (1, 2, "assistant", None), (2, 5, None, "no role"), (2, 3, "assistant", "before\n<|im_end|>\n"), (None, 0, "user", "lost"), (3, 0, "assistant", "é𝒳 " * 50_000), (4, None, "assistant", "no turn"), (4, 1, "we\nird<|", "<"), (5, 0, "user", ""), (6, 1, "user", "same"), (6, 1, "user", "same")]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumns({"segment": F.lit("x"), "seq": F.lit(1), "content": F.lit(2)})
    got = {r.conv_id: r for r in chat.read_back(chat.assemble(chat.format_turns(df))).collect()}
    want = expected(ROWS)
    assert got.keys() == want.keys()
    for c, (n, turns, chars, loss) in want.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (n, turns, chars, loss)
    assert chat.read_back(chat.assemble(chat.format_turns(df.limit(0)))).count() == 0


def test_parts_become_placeholders_in_order(spark):
    part = "type string, text string, ref string, width int, height int, seconds double, pages int"
    parts = [("text", "see <|image|> ", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), ("audio", None, "b.wav", None, None, 2.01, None), ("document", None, "c.pdf", None, None, None, 3), ("text", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<struct<{', '.join(p.replace(' ', ':') for p in part.split(', '))}>>")
    r = chat.format_turns(df).orderBy("turn").first()
    assert r.segment == "<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|document|><|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 51), ("document", "c.pdf", 1536)]
    with pytest.raises(ValueError):
        chat.Flattener().flatten([{"type": "video"}])


def test_offsets_find_the_loss(spark):
    df = spark.createDataFrame(ROWS[:3], "conv_id long, turn long, role string, text string")
    turns = chat.assemble(chat.format_turns(df)).orderBy("seq").collect()
    whole = "".join(t.segment for t in turns)
    assert "".join(whole[t.offset + t.loss_from : t.offset + t.loss_to] for t in turns if t.loss_from is not None) == chat.escape(ROWS[1][3])


def test_what_is_no_turn_is_not_passed_over(spark):
    turns = chat.format_turns(spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string"))
    broken = chat.assemble(turns.withColumn("segment", F.concat("segment", F.lit("left over"))))
    with pytest.raises(Exception, match="no turn"):
        chat.read_back(broken).collect()
