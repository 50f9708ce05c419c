"""Prefix-target expansion of conversations into training examples.

A turn is written as ``### role: text</turn>`` and a line feed.  Inside roles and
texts the control strings are escaped with backslashes, so that no text can open
or close a turn and every text can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshet.llm.base import bind

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    """Backslashes, ``###`` and ``</`` written so that no control string is left."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("###"), F.lit("\\h")), F.lit("</"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`: an escaped backslash is cut out first, so what is left around it is decided."""
    pieces = F.split(text, r"\\\\", -1)
    plain = F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\h"), F.lit("###")), F.lit("\\l"), F.lit("</")))
    return F.array_join(plain, "\\")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def _unescape_role(role: Column) -> Column:
    # A role's backslashes come in the same pairs, so the colon is restored piece by piece.
    pieces = F.split(role, r"\\\\", -1)
    plain = F.transform(pieces, lambda p: F.replace(F.replace(F.replace(
        p, F.lit("\\c"), F.lit(":")), F.lit("\\h"), F.lit("###")), F.lit("\\l"), F.lit("</")))
    return F.array_join(plain, "\\")


def expand_prefix_targets(conversations: DataFrame) -> DataFrame:
    """One example for every assistant turn: all turns up to it, only its text trainable.

    Columns: ``conv_id``, ``target`` (position of the trained turn, NULL in a
    closing example), ``closing``, ``text``, ``loss_start``, ``loss_end`` (code
    points of ``text``, end exclusive; both NULL where nothing is trained).
    ``closing`` marks the last example of a conversation, which has all its
    turns; where a conversation doesn't end with an assistant turn, that is an
    extra example with nothing to train, so that the output has every turn.

    Turns go by ``turn``, ties by role and text, NULL turns first; repeated rows
    are turns of their own.  NULL roles and texts count as empty.  Only the role
    ``assistant`` is trained.  A NULL ``conv_id`` is a conversation like others.
    An empty table gives no example; further columns are ignored.

    Conversations meet in one shuffle and are written there turn by turn; the
    examples are made from that row one at a time, so a task holds the turns of
    one conversation and one example, never all examples of a conversation.
    """
    turns = conversations.select("conv_id", F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = ordered.select("conv_id", F.transform("turns", lambda t: F.struct(
        (t["role"] == "assistant").alias("trained"),
        F.concat(F.lit(OPEN), _escape_role(t["role"]), F.lit(MIDDLE)).alias("head"),
        escape(t["text"]).alias("body"))).alias("turns"))
    ends = F.filter(F.sequence(F.lit(0), F.size("turns") - 1),
                    lambda i: F.col("turns")[i]["trained"] | (i == F.size("turns") - 1))
    examples = written.select("conv_id", "turns", F.explode(ends).alias("end"))
    last = F.col("turns")[F.col("end")]
    text = F.array_join(F.transform(F.slice("turns", 1, F.col("end") + 1),
                                    lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    made = examples.select("conv_id", F.when(last["trained"], F.col("end")).alias("target"),
                           (F.col("end") == F.size("turns") - 1).alias("closing"), text.alias("text"),
                           F.when(last["trained"], F.length(last["body"])).alias("n"))
    stop = F.length("text") - len(CLOSE)
    return made.select("conv_id", "target", "closing", "text",
                       (stop - F.col("n")).alias("loss_start"), F.when(F.col("n").isNotNull(), stop).alias("loss_end"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    parts = F.split(text, "</turn>\n", -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(
        _unescape_role(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, MIDDLE) + F.lit(len(MIDDLE)))).alias("text")))


def trained_text(text: Column, start: Column, end: Column) -> Column:
    """What the loss mask of an example covers, as it was before formatting."""
    return unescape(F.substr(text, start + 1, end - start))


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from its formatted examples alone.

    ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``,
    ``formatted_chars`` (code points of all examples) and ``n_examples``.
    """
    read = examples.select(
        "conv_id", F.length("text").cast("long").alias("chars"), F.when(F.col("closing"), F.col("text")).alias("whole"),
        F.when(F.col("target").isNotNull(), F.struct(
            F.col("target").alias("target"),
            trained_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("text"))).alias("loss"))
    per = read.groupBy("conv_id").agg(F.sum("chars").alias("formatted_chars"), F.max("whole").alias("whole"),
                                      F.sort_array(F.collect_list("loss")).alias("loss"), F.count(F.lit(1)).alias("n_examples"))
    digest = bind(read_turns(F.col("whole")), lambda turns: F.struct(
        F.size(turns).cast("long").alias("n"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha")))
    loss = bind(F.array_join(F.col("loss.text"), ""), lambda t: F.struct(
        F.length(t).cast("long").alias("n"), F.sha2(t, 256).alias("sha")))
    return per.select("conv_id", digest.alias("turns"), loss.alias("loss"), "formatted_chars", "n_examples").select(
        "conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha").alias("turns_sha256"),
        F.col("loss.n").alias("loss_chars"), F.col("loss.sha").alias("loss_sha256"), "formatted_chars", "n_examples")
