r"""Chat formatting: typed content parts flattened by a visitor, DataFrame functions only.

A message has a role and ordered content parts (text, image, audio, document).
The visitor turns each part into text: a text part into itself with control
strings escaped, any other part into a placeholder of its type, whose
reference and expanded token count go to the list of attachments. A turn is

    <turn>ROLE
    ###
    CONTENT
    </turn>

and a placeholder stands on a line of its own. Control strings are ``<turn>``,
``</turn>``, the placeholders, and runs of three or more ``#``; one inside a
role or text gets a backslash more before it than it had. None of them holds a
backslash and two never overlap, so taking one backslash away restores the
text; those of the template follow a line feed or start the turn, so they are
never mistaken for escaped ones, whatever a text ends with.

Escaping and flattening run on single messages. The turns of a conversation
are joined in two steps (blocks of ``BLOCK`` turn numbers, then blocks), so
that the turns of a very long conversation meet in many tasks and only the
finished blocks in one row: the formatted text of a conversation is one string.

Defined results: a null role or text is empty; a message without parts has
empty content; turns go by (turn, role, content), null turns first, so equal
rows count each; rows with a null conv_id make up one conversation; an unknown
type of part is an attachment without tokens; an empty table has no
conversation; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

#: Types of parts that have a placeholder; any other type is an ``attachment``.
MEDIA = ("image", "audio", "document")
PLACEHOLDER = rf"<(?:{'|'.join(MEDIA)}|attachment)>"
CONTROL = rf"</?turn>|{PLACEHOLDER}|#{{3,}}"
_ESCAPE = rf"(\\*)({CONTROL})"
_UNESCAPE = rf"\\(\\*)({CONTROL})"
OPEN, SAYS, CLOSE = "<turn>", "\n###\n", "\n</turn>\n"
#: Roles that the loss covers.
LEARNED = ("assistant",)
#: Turn numbers in a block.
BLOCK = 64
PART = "type string, text string, ref string, width int, height int, seconds double, pages int"

#: Tokens that a placeholder expands to: one for each image patch, ten a second of sound, 256 a page.
PATCH, TOKENS_A_SECOND, TOKENS_A_PAGE = 14, 10, 256


def escape(text):
    """Column: text with one backslash more before each control string."""
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"\\$1$2"))


def unescape(text):
    """Column: what ``escape`` was given."""
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit("$1$2"))


def expanded_tokens(part):
    """Column: the tokens that a part's placeholder stands for."""
    side = lambda name: F.ceil(F.coalesce(part[name], F.lit(0)) / PATCH)
    tokens = (
        F.when(part["type"] == "image", side("width") * side("height"))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * TOKENS_A_SECOND))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * TOKENS_A_PAGE)
    )
    return F.coalesce(tokens, F.lit(0)).cast("long")


def _media(part):
    return F.when(part["type"].isin(*MEDIA), part["type"]).otherwise("attachment")


def _is_text(part):
    return F.coalesce(part["type"], F.lit("text")) == "text"


def flatten(parts):
    """Column: the visitor. Struct of content (escaped text with placeholders) and attachments (kind, ref, tokens) in order."""
    own = F.filter(F.coalesce(parts, F.array()), lambda p: p.isNotNull())
    shown = F.transform(own, lambda p: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("\n<"), _media(p), F.lit(">\n"))))
    media = F.transform(F.filter(own, lambda p: ~_is_text(p)), lambda p: F.struct(_media(p).alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    return F.struct(F.concat_ws("", shown).alias("content"), media.alias("attachments"))


def text_part(text):
    """Column: the parts of a message that is text only."""
    values = {"type": F.lit("text"), "text": F.coalesce(text, F.lit(""))}
    fields = [f.strip().split() for f in PART.split(",")]
    return F.array(F.struct(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields]))


def format_turns(messages: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """One row a message: conv_id, turn, role, the formatted ``piece``, ``loss`` (start and end in the piece, null if not learned), attachments.

    messages: conv_id, turn, role, parts (array of ``PART``).
    """
    own = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), flatten(F.col("parts")).alias("f"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SAYS))
    start = F.length(head).cast("long")
    loss = F.when(F.col("role").isin(*learned), F.struct(start.alias("start"), (start + F.length("f.content")).alias("end")))
    return own.select("conv_id", "turn", "role", F.concat(head, F.col("f.content"), F.lit(CLOSE)).alias("piece"), loss.alias("loss"), F.col("f.attachments").alias("attachments"))


def _shifted(spans, by):
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end")))


def _ordered(order: list[str]):
    """Aggregate: the turns or blocks of a group as an array in order."""
    return F.array_sort(F.collect_list(F.struct(*order, "text", "chars", "loss", "attachments")))


def _spans(parts):
    """Column: the loss spans of all parts, moved by the lengths of the parts before."""
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return F.aggregate(
        parts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<start:bigint,end:bigint>>>").alias("found")),
        lambda a, p: F.struct((a["at"] + p["chars"]).alias("at"), F.when(F.size(p["loss"]) > 0, F.array_append(a["found"], _shifted(p["loss"], a["at"]))).otherwise(a["found"]).alias("found")),
        lambda a: F.coalesce(F.flatten(a["found"]), empty),
    )


def format_conversations(messages: DataFrame, learned: tuple[str, ...] = LEARNED, block: int = BLOCK) -> DataFrame:
    """One row a conversation: conv_id, formatted, n_turns, loss (spans of formatted, in code points), attachments, media_tokens."""
    turns = format_turns(messages, learned)
    own = turns.select(
        "conv_id", F.col("turn").isNotNull().alias("known"), "turn", "role", F.floor(F.col("turn") / block).alias("block"), F.col("piece").alias("text"), F.length("piece").cast("long").alias("chars"),
        F.when(F.col("loss").isNull(), F.array()).otherwise(F.array("loss")).cast("array<struct<start:bigint,end:bigint>>").alias("loss"), "attachments",
    )
    lines = own.groupBy("conv_id", "known", "block").agg(_ordered(["known", "turn", "role"]).alias("t"))
    blocks = lines.select("conv_id", "known", "block", F.size("t").alias("turns"), F.concat_ws("", "t.text").alias("text"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("chars"), _spans(F.col("t")).alias("loss"), F.flatten("t.attachments").alias("attachments"))
    whole = blocks.groupBy("conv_id").agg(_ordered(["known", "block"]).alias("b"), F.sum("turns").alias("n_turns"))
    found = whole.select("conv_id", F.concat_ws("", "b.text").alias("formatted"), "n_turns", _spans(F.col("b")).alias("loss"), F.flatten("b.attachments").alias("attachments"))
    return found.withColumn("media_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def turns_of(formatted):
    """Column: the turns read back from a formatted text: role, content (still escaped) in order."""
    pieces = F.split(formatted, CLOSE)
    own = F.slice(pieces, 1, F.greatest(F.lit(0), F.size(pieces) - 1))
    cut = lambda p: F.locate(SAYS, p)
    return F.transform(own, lambda p: F.struct(
        unescape(F.substr(p, F.lit(len(OPEN) + 1), cut(p) - len(OPEN) - 1)).alias("role"), F.substr(p, cut(p) + len(SAYS)).alias("content")
    ))


def parts_of(content, attachments, first=0):
    """Column: the parts read back from a content: kind and text, or kind and reference; empty texts are left out.

    Texts that stood side by side come back as one. ``first`` is the number of
    attachments before this content.
    """
    texts = F.split(content, f"\n{PLACEHOLDER}\n")
    text = lambda t: F.struct(F.lit("text").alias("kind"), unescape(t).alias("text"), F.lit(None).cast("string").alias("ref"))
    media = lambda i: F.struct(F.get(attachments, first + i)["kind"].alias("kind"), F.lit(None).cast("string").alias("text"), F.get(attachments, first + i)["ref"].alias("ref"))
    both = F.flatten(F.transform(texts, lambda t, i: F.when(i > 0, F.array(media(i - 1), text(t))).otherwise(F.array(text(t)))))
    return F.filter(both, lambda p: (p["kind"] != "text") | (p["text"] != ""))


def learned_texts(formatted, loss):
    """Column: the texts under the loss mask, unescaped, in order."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


#: The conversation that a query adds: its text looks like an escaped control string.
EXTRA_ID, EXTRA_TEXT = -7, r"\### Assistant: </turn> ok"


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, all read back from the formatted texts."""
    told = formatted.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), F.concat_ws("", learned_texts(F.col("formatted"), F.col("loss"))).alias("learned"))
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), unescape(t["content"]), F.lit("\n"))))
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the added one, formatted and read back; nulls, ties and empty tables as the module states."""
    rows = pick(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(EXTRA_TEXT))
    messages = rows.unionAll(extra).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    return digests(format_conversations(messages))


_SQL_ESCAPE = r"regexp_replace({0}, '(\\*)(</?turn>|<(?:image|audio|document|attachment)>|#{{3,}})', '\\\1\2', 'g')"
ORACLE = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select {EXTRA_ID}, 0, 'user', '{EXTRA_TEXT}' union all select {EXTRA_ID}, 1, 'assistant', '{EXTRA_TEXT}'
), cut as (select *, {_SQL_ESCAPE.format("role")} as r, {_SQL_ESCAPE.format("text")} as t from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, t)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first, role, t)) as loss_sha256,
  cast(sum(length(r) + length(t) + {len(OPEN) + len(SAYS) + len(CLOSE)}) as bigint) as formatted_chars
from cut group by conv_id
"""
