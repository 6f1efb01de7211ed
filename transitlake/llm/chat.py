"""Chat formatting with typed content parts.

A turn is an array of parts. The visitor gives each kind of part its own treatment: text is escaped; image, audio and
document parts become ordered placeholders, one per token they will take, and their references are recorded with the
number of tokens. A conversation's turns are joined by a template, and the spans under the loss mask (all text of
assistant turns) are kept as offsets into the formatted string.

Escaping is reversible: backslashes are doubled, then ``<|`` becomes ``<\\|`` and, in roles, a line break ``<\\n``
(with the letter n). After the first step backslashes stand in runs of even length, so a single one after ``<`` can
only come from the second. No control string is left inside a text, since all begin with ``<|``.

Defined results: null roles and texts are empty; turns are ordered by turn (nulls first), then role, then parts as they
are given, so ties and repeated rows have one order; rows without conv_id form one conversation. An empty table gives an
empty result. A formatted conversation is one
string, and so must fit a row, as it must for any trainer. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.llm.spans import blocks, cut, let, running

START, END = "<|im_start|>", "<|im_end|>"
#: Placeholders of the parts that are not text.
MARKS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: An image takes one token for each square of this many pixels, audio this many a second, a document this many a page.
IMAGE_SQUARE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256

PARTS = "array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("<\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A turn's text as its only part."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null("string").alias("uri"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))


def part_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder expands to; 0 for text, 1 at least for the others."""
    squares = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / IMAGE_SQUARE)
    n = F.when(part["kind"] == "image", squares(part["width"]) * squares(part["height"]))
    n = n.when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
    n = n.when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * PAGE_TOKENS)
    return F.when(part["kind"].isin(*MARKS), F.greatest(F.lit(1).cast("long"), n)).otherwise(F.lit(0).cast("long"))


def visit(part: Column) -> Column:
    """A part's text in the formatted string."""
    out = None
    for kind, mark in MARKS.items():
        repeated = F.repeat(F.lit(mark), part_tokens(part).cast("int"))
        out = F.when(part["kind"] == kind, repeated) if out is None else out.when(part["kind"] == kind, repeated)
    return out.otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def format_chats(turns: DataFrame) -> DataFrame:
    """From conv_id, turn, role, parts: conv_id, n_turns, formatted, loss_spans (start, length), attachments."""
    parts = F.coalesce("parts", F.array().cast(PARTS)).cast(PARTS)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "parts"))).alias("turns"))
    body = lambda t: F.array_join(F.transform(t["parts"], visit), "")
    header = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    written = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), header(t).alias("header"), body(t).alias("body"))).alias("turns"), F.flatten(F.transform("turns", lambda t: t["parts"])).alias("parts"))
    tail = f"{END}\n"

    def step(at: Column, t: Column) -> tuple[Column, Column]:
        first, n = at + F.length(t["header"]), F.length(t["body"]).cast("long")
        span = F.struct(first.cast("long").alias("start"), n.alias("length"))
        return (first + n + len(tail)).cast("long"), F.when(t["role"] == "assistant", span)

    spans = running(F.col("turns"), F.lit(0).cast("long"), step, "struct<start:bigint,length:bigint>")
    media = F.filter("parts", lambda p: p["kind"].isin(*MARKS))
    return written.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["header"], t["body"], F.lit(tail))), "").alias("formatted"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"),
        F.transform(media, lambda p: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), part_tokens(p).alias("tokens"))).alias("attachments"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, read back from the formatted string and the loss spans."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda x: x != "")
    inner = lambda x: F.substring(x, len(START) + 1, 2**31 - 1)
    role = lambda x: F.substring_index(inner(x), "\n", 1)
    text = lambda x: F.substr(inner(x), F.length(role(x)) + F.lit(2))
    turns = F.transform(pieces, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(text(x)).alias("text")))
    learnt = let(blocks(F.col("formatted")), lambda parts: F.transform("loss_spans", lambda s: unescape(cut(parts, s["start"], s["length"]))))
    return formatted.select("*", turns.alias("turns"), F.array_join(learnt, "").alias("loss_text"))
