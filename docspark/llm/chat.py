"""Chat formatting from an event log, with DataFrame functions only.

Events of a conversation are sorted by their sequence number and folded into messages: `message` opens one, `delta` appends to the last one,
`edit` replaces the last one's text, `regenerate` drops the last message if it is the assistant's, with all its deltas and edits, so that what
follows takes its place. Messages are rendered between marks; the mark's first character is escaped inside roles and texts, so that no text can
close a turn, and parsing gives back exactly what was written. Each assistant text's place in the output is its loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The kinds of events.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"


def escaped(text: Column) -> Column:
    r"""`\` becomes `\\` and `<|` becomes `<\|`: no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the final messages of `events` (conv_id, seq, kind, role, text), place from 0.

    Ties in seq are taken by kind (messages first), role and text; a null kind is a message, a null role or text is empty. Deltas, edits and
    regenerations before the first message are dropped, as are deltas and edits of a message that was dropped. Messages are numbered by a
    running count and rows stay rows until a message's deltas are joined, so no more than one message is held at a time.
    """
    order = F.when(F.col("kind") == MESSAGE, 0).when(F.col("kind") == REGENERATE, 3).otherwise(F.when(F.col("kind") == EDIT, 2).otherwise(1))
    clean = events.select(
        "conv_id",
        "seq",
        F.coalesce("kind", F.lit(MESSAGE)).alias("kind"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("rank", order)
    by = Window.partitionBy("conv_id").orderBy("seq", "rank", "role", "text")
    numbered = clean.withColumn("number", F.sum((F.col("kind") == MESSAGE).cast("int")).over(by)).withColumn("at", F.row_number().over(by)).where("number > 0")
    # all of a message's events, in order; an edit starts its text anew
    events_of = F.array_sort(F.collect_list(F.struct("at", "kind", "text")))
    folded = numbered.groupBy("conv_id", "number").agg(
        F.max(F.when(F.col("kind") == MESSAGE, F.col("role"))).alias("role"),
        F.max((F.col("kind") == REGENERATE).cast("int")).alias("again"),
        F.max(F.when(F.col("kind") == EDIT, F.col("at"))).alias("edited"),
        events_of.alias("events"),
    )
    last = F.filter("events", lambda e: (e["at"] >= F.coalesce(F.col("edited"), F.lit(0))) & (e["kind"] != REGENERATE))
    text = F.array_join(F.transform(last, lambda e: e["text"]), "")
    kept = folded.where(~((F.col("again") == 1) & (F.col("role") == "assistant")))
    return kept.select("conv_id", F.col("number").alias("place"), "role", text.alias("text"))


def message_events(conversations: DataFrame, conv_col: str = "conv_id", seq_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of final turns as an event log: each row is a message of its own."""
    c = conversations
    return c.select(c[conv_col].alias("conv_id"), c[seq_col].alias("seq"), F.lit(MESSAGE).alias("kind"), c[role_col].alias("role"), c[text_col].alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): one row for each conversation. mask: the start, from 0, and length of each assistant text, in code points and in bytes.

    A conversation without messages gives no row. One conversation's text is one value, so a task holds the largest whole; work on it is in proportion
    to its length.
    """
    turn = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    tail = CLOSE + "\n"
    parts = messages.select("conv_id", "place", turn.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("mine"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    size = lambda f: F.coalesce(F.sum(f("head") + f("body") + len(tail)).over(before), F.lit(0)) + f("head")
    placed = parts.select("*", size(F.length).alias("start"), size(F.octet_length).alias("byte_start"))
    own = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "head", "body", "mine", "start", "byte_start"))).alias("turns"))
    span = lambda t: F.struct(
        t["start"].alias("start"), F.length(t["body"]).cast("long").alias("length"), t["byte_start"].alias("byte_start"), F.octet_length(t["body"]).cast("long").alias("byte_length")
    )
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "")
    return own.select("conv_id", formatted.alias("formatted"), F.transform(F.filter("turns", lambda t: t["mine"]), span).alias("mask"))


def parsed(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text), as they were before escaping."""
    pattern = r"(?s)<\|im_start\|>([^\n\\]*+(?:\\.[^\n\\]*+)*+)\n(.*?)<\|im_end\|>\n"
    role = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1))
    text = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(2))
    return F.zip_with(role, text, lambda r, t: F.struct(unescaped(r).alias("role"), unescaped(t).alias("text")))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from the rendered text and its mask."""
    turns = parsed(F.col("formatted"))
    whole = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # by bytes, of which a part is found without counting from the start
    part = lambda raw, m: unescaped(F.substring(raw, m["byte_start"].cast("int") + 1, m["byte_length"].cast("int")).cast("string"))
    loss = F.array_join(F.transform(F.array(F.col("formatted").cast("binary")), lambda raw: F.array_join(F.transform("mask", lambda m: part(raw, m)), "")), "")
    return rendered.select("conv_id", F.size(turns).cast("long").alias("n_turns"), whole.alias("whole"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("whole").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
