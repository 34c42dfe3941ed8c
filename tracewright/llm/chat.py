"""Chat formatting by prefix-target expansion; DataFrame functions only.

A conversation becomes one string of turns, each `### role: text</turn>` and a newline. Inside texts and roles the
template's control strings are escaped reversibly, so no text can open or close a turn. `examples` then explodes every
assistant turn into an example of its own: context = everything before its reply, target = only that reply, the only
text under the loss mask. What all examples of a conversation of n turns hold grows with n squared, by definition; until
they are cut, an example is a pair of offsets into the conversation's string.

Defined cases: null text and null role are empty; a null conv_id is a conversation of its own; turns sort by turn (null
first), then role, then text, and rows that repeat count as turns; an empty table gives no rows; a conversation without
an assistant turn has no examples; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, COLON, END, ASSISTANT = "### ", ": ", "</turn>", "assistant"
#: Control strings and what stands for them inside texts; the first line must come first.
ESCAPES = (("\\", "\\b"), ("### ", "\\h"), ("</turn>", "\\e"))
ROLE_ESCAPES = (*ESCAPES, (": ", "\\c"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, stands in pairs:
        text = F.replace(text, F.lit(plain), F.lit(stands))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for plain, stands in reversed(pairs):
        text = F.replace(text, F.lit(stands), F.lit(plain))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, targets: the whole conversation under the template, and for every assistant turn
    (turn_no, start, stop): where its reply lies, in code points from 0. One shuffle, on conv_id."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(COLON))).withColumn("body", escape(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("no", F.row_number().over(order) - 1)
    size = (F.length("head") + F.length("body") + len(END) + 1).cast("long")
    rows = rows.withColumn("start", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("body") - len(END) - 1)
    one = F.struct("no", F.concat("head", "body", F.lit(END + "\n")).alias("line"), (F.col("role") == ASSISTANT).alias("trained"), "start", (F.col("start") + F.length("body")).alias("stop"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("lines"))
    target = lambda x: F.struct(x["no"].alias("turn_no"), x["start"].alias("start"), x["stop"].alias("stop"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("formatted"),
        F.transform(F.filter("lines", lambda x: x["trained"]), target).alias("targets"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted string, read from the string alone: array of (role, text)."""
    pieces = F.split(formatted, END + "\n", -1)

    def turn(piece: Column) -> Column:
        body = F.instr(piece, COLON) + len(COLON)
        return F.struct(
            unescape(F.substring(piece, F.lit(len(HEAD) + 1), body - len(HEAD) - len(COLON) - 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substring(piece, body, F.length(piece))).alias("text"),
        )

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, formatted, turn_no, context, target. All turns before the reply are context;
    the reply alone is trainable. A conversation without an assistant turn has one row with nulls."""
    cut = lambda a, b: F.substring(F.col("formatted"), (a + 1).cast("int"), (b - a).cast("int"))
    rows = formatted.select("conv_id", "formatted", F.inline_outer("targets"))
    return rows.select("conv_id", "formatted", "turn_no", cut(F.lit(0), F.col("start")).alias("context"), cut(F.col("start"), F.col("stop")).alias("target"))


def gathered(examples_: DataFrame) -> DataFrame:
    """The examples of a conversation side by side: conv_id, formatted, n_examples, context_chars, trained (all targets,
    unescaped, in order). Rows are where `format_conversations` has put them; nothing is shuffled again."""
    target = F.when(F.col("turn_no").isNotNull(), F.struct("turn_no", "target"))
    rows = examples_.groupBy("conv_id").agg(
        F.first("formatted").alias("formatted"),
        F.count("turn_no").alias("n_examples"),
        F.coalesce(F.sum(F.length("context").cast("long")), F.lit(0).cast("long")).alias("context_chars"),
        F.array_sort(F.collect_list(target)).alias("targets"),
    )
    trained = F.array_join(F.transform("targets", lambda t: unescape(t["target"])), "")
    return rows.select("conv_id", "formatted", "n_examples", "context_chars", trained.alias("trained"))
