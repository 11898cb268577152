"""Chat formatting: exact round trips, the loss mask and the attachments."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, ROLE2 string, parts2 int"
BITS = ["<turn>", "</turn>", "###", "####", "#", "\\", "\n", "<image>", "<audio>", "<document>", "<attachment>", "<turn", ">", "\n###\n", "\n</turn>\n", "ok", "é", "\U0001f600", "$1", "\\\\"]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def messages(spark, rows):
    return conversations(spark, rows).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))


def plain(rows):
    """conv_id -> turns in order, as the contract orders them."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def digests(turns):
    learned = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def hostile(seed, n=400):
    dice = random.Random(seed)
    text = lambda: "".join(dice.choice(BITS) for _ in range(dice.randrange(9)))
    role = lambda: dice.choice(["user", "assistant", "system", text()])
    return [(dice.randrange(40), i, role(), text()) for i in range(n)]


def test_hostile_texts_come_back(spark):
    rows = hostile(1) + [(None, 0, None, None), (None, None, "assistant", "late"), (99, 1, "assistant", ""), (-7, 0, "user", chat.EXTRA_TEXT), (-7, 1, "assistant", chat.EXTRA_TEXT)]
    done = chat.format_conversations(messages(spark, rows), block=3)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(done).collect()}
    assert got == {conv: digests(turns) for conv, turns in plain(rows).items()}
    read = done.select("conv_id", chat.turns_of(F.col("formatted")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["role"], chat.unescape(t["content"]))).alias("t"))
    assert {r.conv_id: [tuple(t) for t in r.t] for r in read.collect()} == plain(rows)


def test_no_text_holds_an_unescaped_control_string(spark):
    rows = hostile(2)
    for r in chat.format_conversations(messages(spark, rows)).collect():
        assert r.formatted.count(chat.CLOSE) == r.n_turns == r.formatted.count(chat.SAYS)
        assert [r.formatted[s.start : s.end] for s in r.loss].count("") <= r.n_turns


def test_parts_become_placeholders_with_references(spark):
    rows = [
        ("user", [("text", "look <image> \\", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), ("text", "", None, None, None, None, None), ("audio", None, "b.wav", None, None, 1.25, None)]),
        ("assistant", [("document", None, "c.pdf", None, None, None, 2), ("text", "### read", None, None, None, None, None), ("video", None, "d", None, None, None, None), None, (None, "!", None, None, None, None, None)]),
        ("user", None),
    ]
    df = spark.createDataFrame([(5, i, role, parts) for i, (role, parts) in enumerate(rows)], f"conv_id long, turn long, role string, parts array<struct<{chat.PART.replace(' ', ':').replace(',:', ',')}>>")
    done = chat.format_conversations(df)
    r = done.first()
    assert [tuple(a) for a in r.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 13), ("document", "c.pdf", 512), ("attachment", "d", 0)]
    assert r.media_tokens == 529
    assert r.formatted == "<turn>user\n###\nlook \\<image> \\\n<image>\n\n<audio>\n\n</turn>\n<turn>assistant\n###\n\n<document>\n\\### read\n<attachment>\n!\n</turn>\n<turn>user\n###\n\n</turn>\n"
    t = done.select("attachments", chat.turns_of(F.col("formatted")).alias("t"))
    parts = t.select(chat.parts_of(F.col("t")[0]["content"], F.col("attachments")).alias("a"), chat.parts_of(F.col("t")[1]["content"], F.col("attachments"), 2).alias("b")).first()
    assert [tuple(p) for p in parts.a] == [("text", "look <image> \\", None), ("image", None, "a.png"), ("audio", None, "b.wav")]
    assert [tuple(p) for p in parts.b] == [("document", None, "c.pdf"), ("text", "### read", None), ("attachment", None, "d"), ("text", "!", None)]


def test_empty_and_native(spark):
    done = chat.digests(chat.format_conversations(messages(spark, [])))
    assert done.count() == 0
    plan = done._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(BITS), max_size=8).map("".join), min_size=1, max_size=6))
def test_escaping_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    assert all(r.t == r.u for r in df.select("t", chat.unescape(F.col("e")).alias("u")).collect())
