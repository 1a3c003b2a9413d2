"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role are merged; array aggregates
place the texts, and the result is concatenated to

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n ...

where <|im_sep|> stands between merged turns, so the turns can be told apart again. Control strings inside roles
and texts are escaped: ~ becomes ~0, the < of <|im_, <s> or </s> becomes ~1, the [ of [INST] or [/INST] becomes
~2, and in roles a line end becomes ~3. The loss mask is an array of (start, length) in code points of the output,
one span for each assistant text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256  # turns
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("~"), F.lit("~0"))
    text = F.regexp_replace(text, r"<(?=\|im_|/?s>)", "~1")
    return F.regexp_replace(text, r"\[(?=/?INST\])", "~2")


def unescape(text: Column) -> Column:
    for mark, plain in (("~3", "\n"), ("~2", "["), ("~1", "<"), ("~0", "~")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, though lambdas inside fn name it: a column would be computed for each call."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def begins(sizes: Column) -> Column:
    """The sum of the sizes before each. An aggregate that appends copies its array each time, so sums run within
    blocks, and over the blocks' sums."""
    zero = F.lit(0).cast("long")
    running = lambda a: F.slice(F.aggregate(a, F.array(zero), lambda z, x: F.concat(z, F.array(F.element_at(z, -1) + x))), 1, F.size(a))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(sizes) / BLOCK).cast("int") - 1), lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))
    sums = lambda parts: running(F.transform(parts, lambda b: F.aggregate(b, zero, lambda z, x: z + x)))
    return let(blocks, lambda parts: F.flatten(F.zip_with(parts, sums(parts), lambda b, start: F.transform(running(b), lambda x: x + start))))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted (string), loss (array of start and length).

    Turns are ordered by turn (null first), then role and text, so ties have a defined order; repeated rows are
    repeated turns. A null role or text counts as empty. Rows with a null conversation form one conversation. An
    empty table gives no rows. A conversation is one output row and must fit one, as its formatted text does.
    """
    rows = df.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    collected = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    none = F.lit(None).cast("string")
    roles = lambda turns: F.transform(turns, lambda t: t["role"])
    before = lambda turns: F.concat(F.array(none), F.slice(roles(turns), 1, F.size(turns) - 1))
    after = lambda turns: F.concat(F.slice(roles(turns), 2, F.size(turns)), F.array(none))
    # a turn that has the role of the one before is merged with it
    beside = lambda turns: F.zip_with(F.zip_with(turns, before(turns), lambda t, x: F.struct(t.alias("t"), x.alias("before"))), after(turns), lambda p, x: F.struct(p["t"]["role"].alias("role"), p["t"]["text"].alias("text"), p["before"].alias("before"), x.alias("after")))
    pieces = let(
        F.col("turns"),
        lambda turns: F.transform(
            beside(turns),
            lambda p: F.struct(
                F.when(p["before"] == p["role"], F.lit(SEP)).otherwise(F.concat(F.lit(START), F.replace(escape(p["role"]), F.lit("\n"), F.lit("~3")), F.lit("\n"))).alias("head"),
                escape(p["text"]).alias("body"),
                F.when(p["after"] == p["role"], F.lit("")).otherwise(F.lit(END)).alias("tail"),
                (p["role"] == trained_role).alias("trained"),
            ),
        ),
    )
    placed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", pieces.alias("pieces"))
    sizes = F.transform("pieces", lambda p: (F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).cast("long"))
    spans = F.zip_with("pieces", let(sizes, begins), lambda p, at: F.struct((at + F.length(p["head"]) + 1).cast("int").alias("start"), F.length(p["body"]).alias("length"), p["trained"].alias("trained")))
    return placed.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["trained"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text), merged turns apart again."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def block_turns(block: Column) -> Column:
        inner = F.substring(block, len(START) + 1, F.length(block))
        cut = F.locate("\n", inner)
        role = F.substring(inner, F.lit(1), cut - 1)
        body = F.substring(inner, cut + 1, F.length(inner))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, block_turns))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), "")
