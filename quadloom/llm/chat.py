"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := message*      message := open role "\\n" content close "\\n"
    open := <|im_start|> | <|im_esc|>      close := <|im_end|>

Every turn is first rendered as it stands and parsed again; a turn that does not come back identical is rendered with
<|im_esc|>, where %, <| and line feeds in the role are written as %25, %3C| and %0A. The whole conversation is then parsed; if it
differs from its source, all its turns are escaped, and if that differed too the job would fail. Escaped text holds no
control string, so the second form always parses.

Nulls and odd input: a null text or role is empty; rows of a conversation are ordered by turn (nulls first), then role and
text; repeated rows are turns of their own; a null conv_id is a conversation; an empty table gives no rows; extra columns
are ignored. A conversation's rows meet in one row, as its text is one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.text import let, upto

START, ESCAPED, END = "<|im_start|>", "<|im_esc|>", "<|im_end|>"
TOKEN = "<\\|im_(?:start|esc|end)\\|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%3C|"), F.lit("<|")), F.lit("%25"), F.lit("%"))


def segments(turn: Column, escaped: Column) -> Column:
    """The pieces of a rendered turn with their loss mask: array<struct<text, loss, escaped>>."""
    role = F.when(escaped, F.replace(escape(turn["role"]), F.lit("\n"), F.lit("%0A"))).otherwise(turn["role"])
    content = F.when(escaped, escape(turn["text"])).otherwise(turn["text"])
    head = F.concat(F.when(escaped, F.lit(ESCAPED)).otherwise(F.lit(START)), role, F.lit("\n"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"), escaped.alias("escaped"))

    return F.array(piece(head, F.lit(False)), piece(content, turn["role"] == "assistant"), piece(F.lit(END + "\n"), F.lit(False)))


def rendered(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda s: s["text"]), "")


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation, array<struct<role, text>>; null if the grammar does not accept it."""

    def turns(parts: Column, marks: Column) -> Column:
        n = F.floor(F.size(marks) / 2).cast("int")

        def turn(i: Column) -> Column:
            def of_body(body: Column) -> Column:
                coded = F.get(marks, 2 * i) == ESCAPED
                role = F.substring_index(body, "\n", 1)
                text = F.substr(body, F.length(role) + 2)
                return F.struct(F.when(coded, unescape(F.replace(role, F.lit("%0A"), F.lit("\n")))).otherwise(role).alias("role"), F.when(coded, unescape(text)).otherwise(text).alias("text"))

            return let(F.get(parts, 2 * i + 1), of_body)

        def well_formed(i: Column) -> Column:
            opens = F.get(marks, 2 * i).isin(START, ESCAPED) & (F.get(marks, 2 * i + 1) == END)
            return opens & (F.get(parts, 2 * i + 2) == "\n") & F.contains(F.get(parts, 2 * i + 1), F.lit("\n"))

        good = (F.size(marks) == 2 * n) & (F.get(parts, F.lit(0)) == "") & F.forall(upto(n), well_formed)
        return F.when(good, F.transform(upto(n), turn))

    return let(F.split(formatted, TOKEN, -1), lambda parts: let(F.regexp_extract_all(formatted, F.lit(TOKEN), F.lit(0)), lambda marks: turns(parts, marks)))


def format_chats(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text): formatted, its segments with the loss mask on what the
    assistant says, and turns as parsed from formatted."""
    said = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("s"))
    source = source.select("conv_id", F.transform("s", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))

    def first_form(t: Column) -> Column:
        alone = parse(rendered(segments(t, F.lit(False))))
        return let(~F.coalesce(alone == F.array(t), F.lit(False)), lambda conflict: segments(t, conflict))

    def settled(pieces: Column) -> Column:
        same = F.coalesce(parse(rendered(pieces)) == F.col("source"), F.lit(False))
        return F.when(same, pieces).otherwise(F.flatten(F.transform("source", lambda t: segments(t, F.lit(True)))))

    out = source.withColumn("segments", let(F.flatten(F.transform("source", first_form)), settled))
    out = out.withColumn("formatted", rendered(F.col("segments"))).withColumn("turns", parse(F.col("formatted")))
    checked = F.when(F.coalesce(F.col("turns") == F.col("source"), F.lit(False)), F.col("turns")).otherwise(F.raise_error(F.lit("a formatted conversation does not parse to its source")))
    return out.select("conv_id", "formatted", "segments", checked.alias("turns"))


def loss_text(pieces: Column) -> Column:
    """What the loss mask selects, unescaped, in order."""
    return F.array_join(F.transform(F.filter(pieces, lambda s: s["loss"]), lambda s: F.when(s["escaped"], unescape(s["text"])).otherwise(s["text"])), "")
