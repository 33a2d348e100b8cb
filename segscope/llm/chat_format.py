"""Chat formatting (operator 1): turn rows -> one formatted string per
conversation, with the loss mask as segments.

Relational throughout, in Spark expressions: the turns of a conversation are
collected as structs and sorted, adjacent turns of one role are merged by array
slices and joined, and the pieces are concatenated.

Template: ``<|im_start|>role\\n`` text ``<|im_end|>\\n`` for each merged turn,
``<|im_sep|>`` between the texts that were merged into it, so the original rows
can be read back. Control strings inside texts (``CONTROL``) lose their first
character to an entity, and ``&`` becomes ``&amp;``: this is reversible, and no
text can open or close a turn.

Defined results: null text = empty text; null role = empty role; a null conv_id
is one conversation of its own; ties and repeated rows (equal turn) are all
kept, ordered by turn (nulls first), role, text; an empty table gives no rows;
other columns of the input are ignored. A conversation becomes one string, so
one conversation's turns meet in one row; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Strings that tokenizers or chat templates take as control tokens.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ENTITY = {"<": "&lt;", "[": "&#91;"}


def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for s in CONTROL:
        out = F.replace(out, F.lit(s), F.lit(ENTITY[s[0]] + s[1:]))
    return out


def unescape(c: Column) -> Column:
    out = F.replace(c, F.lit("&#10;"), F.lit("\n"))
    for char, entity in ENTITY.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", learn: str = "assistant") -> DataFrame:
    """conv, formatted, segments: array of (text, loss) whose texts concatenate
    to ``formatted``; ``loss`` marks the texts of the role ``learn``."""
    empty = F.lit("")
    turns = df.select(F.col(conv).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")).alias("t"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    role_at = lambda i: F.get(F.col("t"), i)["role"]
    # first index of each run of one role
    rows = rows.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("t") - 1),
                                              lambda i: (i == 0) | (role_at(i) != role_at(i - 1))))
    segment = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def merged(start, k):
        stop = F.coalesce(F.get(F.col("starts"), k + 1), F.size("t"))
        is_learned = role_at(start) == learn
        texts = F.transform(F.slice(F.col("t"), start + 1, stop - start), lambda x, j: F.when(
            j == 0, F.array(segment(escape(x["text"]), is_learned))).otherwise(
            F.array(segment(F.lit(SEP), no), segment(escape(x["text"]), is_learned))))
        name = F.replace(escape(role_at(start)), F.lit("\n"), F.lit("&#10;"))
        return F.concat(F.array(segment(F.concat(F.lit(START), name, F.lit("\n")), no)),
                        F.flatten(texts), F.array(segment(F.lit(END), no)))

    rows = rows.select("conv_id", F.flatten(F.transform("starts", merged)).alias("segments"))
    return rows.select(F.col("conv_id").alias(conv),
                       F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The original turns, array of (role, text), parsed from the formatted string."""
    quote = lambda s: s.replace("|", "\\|").replace("\n", "\\n")
    blocks = F.filter(F.split(formatted, quote(END)), lambda b: b != "")

    def turns_of(block):
        head = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(head) + 2)
        return F.transform(F.split(body, quote(SEP)), lambda s: F.struct(
            unescape(F.substr(head, F.lit(len(START) + 1))).alias("role"), unescape(s).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
