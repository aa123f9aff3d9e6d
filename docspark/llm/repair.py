"""Conversation structure repair: faults by windows, the cheapest edits by a higher-order fold.

A conversation's role initials have to read `(s?(ua)+)?`. The fold goes over its turns with four states: nothing said yet, after the system turn, after a
user turn, after an assistant turn. Each carries the cheapest edits that lead to it, as (cost, audit); least() settles ties by the audit, as ASCII. Two
audits of one state and one cost are never a prefix of one another, as a longer one would hold one more insertion, so what is least stays least
whatever follows.

The fold has two levels: within a block of BLOCK turns a state carries where it came in (the rank of that state's audit among the four) and the block's own
edits; whole audits are put together once a block. So work grows with a conversation's length, not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a block; more than any repair costs.
BLOCK, FAR = 256, 1 << 40
#: Costs of edits; a truncated turn that stays costs one more.
REROLE, DELETE, INSERT = 2, 3, 2


def damage(df: DataFrame) -> DataFrame:
    """`df` (conv_id, turn, role, text) damaged by crc32 of `conv_id:turn`; `gone` marks a dropped turn, which stays as a row."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("gone"), F.explode(times).alias("time")).drop("time")


def flagged(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text, gone) with place, initial, fault, illegal (the pair with the turn before) and new_turn. One shuffle, by conversation."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    by = Window.partitionBy("conv_id", "gone").orderBy(*order)
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("place")
    rows = rows.repartition("conv_id").withColumn("initial", F.substring("role", 1, 1))
    rows = rows.withColumns({"place": F.row_number().over(by), "last_initial": F.lag("initial").over(by), "last_turn": F.lag("turn").over(by)})
    rows = rows.withColumn("seen", F.row_number().over(same) > 1)
    last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", ""), -1, 1)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("seen"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return rows.select(
        "conv_id",
        "turn",
        "gone",
        "place",
        "role",
        "text",
        "initial",
        fault.alias("fault"),
        F.when(F.col("place") > 1, ~F.concat("last_initial", "initial").isin("su", "ua", "au")).otherwise(False).alias("illegal"),
        (F.col("turn").isNotNull() & (F.col("last_turn").isNull() | (F.col("last_turn") != F.col("turn")))).alias("new_turn"),
    )


def let(x: Column, body) -> Column:
    """body of x, computed once."""
    return F.transform(F.array(x), body)[0]


def edited(s: Column, cost, edits) -> Column:
    """A state after more edits."""
    return F.struct((s["cost"] + cost).alias("cost"), s["rank"].alias("rank"), F.concat(s["audit"], F.lit(edits) if isinstance(edits, str) else edits).alias("audit"))


def with_inserts(s: Column) -> tuple[Column, Column, Column, Column]:
    """The four states after any insertions that help."""
    user = F.least(s["user"], *[edited(s[c], INSERT, "I") for c in ("none", "system", "assistant")])
    assistant = F.least(s["assistant"], edited(s["user"], INSERT, "I"), *[edited(s[c], 2 * INSERT, "II") for c in ("none", "system")])
    return s["none"], s["system"], user, assistant


def after_turn(s: Column, turn: Column) -> Column:
    """The four states after a turn (initial, must_go, truncated)."""
    none, system, user, assistant = with_inserts(s)
    more, initial = turn["truncated"], turn["initial"]
    stays = lambda x: F.when(~turn["must_go"], x)  # noqa: E731  least() passes over null
    takes = lambda x, own: stays(edited(x, F.when(initial == own, more).otherwise(more + REROLE), F.when(initial == own, "K").otherwise("R")))
    gone = lambda x: edited(x, DELETE, "D")
    return F.struct(
        gone(none).alias("none"),
        F.least(gone(system), stays(F.when(initial == "s", edited(none, more, "K")))).alias("system"),
        F.least(gone(user), takes(F.least(none, system, assistant), "u")).alias("user"),
        F.least(gone(assistant), takes(user, "a")).alias("assistant"),
    )


STATES = ("none", "system", "user", "assistant")


def cheapest(turns: Column) -> Column:
    """(cost, rank, audit) of the cheapest edits of an array of turns."""
    state = lambda cost, rank, audit: F.struct(cost.cast("long").alias("cost"), rank.cast("int").alias("rank"), audit.alias("audit"))
    start = F.struct(*[state(F.lit(0 if c == "none" else FAR), F.lit(0), F.lit("")).alias(c) for c in STATES])
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(turns) - 1) / BLOCK)).cast("int")), lambda k: F.slice(turns, k * BLOCK + 1, F.lit(BLOCK)))

    def after_block(s, block):
        def within(audits):
            entry = F.struct(*[state(s[c]["cost"], F.array_position(audits, s[c]["audit"]), F.lit("")).alias(c) for c in STATES])
            whole = lambda e: F.struct(*[state(e[c]["cost"], F.lit(0), F.concat(F.get(audits, e[c]["rank"] - 1), e[c]["audit"])).alias(c) for c in STATES])
            return F.aggregate(block, entry, after_turn, whole)

        return let(F.array_sort(F.array(*[s[c]["audit"] for c in STATES])), within)

    def end(s):
        none, _, _, assistant = with_inserts(s)
        return F.least(none, assistant)

    return F.aggregate(blocks, start, after_block, end)


def repaired_text(turns: Column, audit: Column) -> Column:
    """The turns (role, text, initial) after the edits of `audit`, `role:text` each, a line each."""
    piece = lambda role, text, edit: F.struct(role.alias("role"), text.alias("text"), edit.alias("edit"))
    edits = F.filter(F.split(F.replace(audit, F.lit("I"), F.lit("")), ""), lambda e: e != "")
    kept = F.filter(F.zip_with(turns, edits, lambda t, e: piece(t["role"], t["text"], e)), lambda t: t["edit"] != "D")
    left = F.replace(audit, F.lit("D"), F.lit(""))
    runs = F.regexp_extract_all(left, F.lit("I*[KR]"), F.lit(0))  # a turn that stays, and the insertions before it
    inserted = lambda n: F.array_repeat(piece(F.lit(""), F.lit(""), F.lit("I")), n.cast("int"))
    rest = F.length(left) - F.aggregate(runs, F.lit(0), lambda n, r: n + F.length(r))
    pieces = F.concat(F.flatten(F.zip_with(runs, kept, lambda r, k: F.concat(inserted(F.length(r) - 1), F.array(k)))), inserted(rest))

    def lines(p):
        first = F.get(p, F.lit(0))
        shift = F.when((first["edit"] == "K") & (F.substring(first["role"], 1, 1) == "s"), 1).otherwise(0)
        role = lambda x, k: F.when(x["edit"] == "K", x["role"]).when((k - shift) % 2 == 0, "user").otherwise("assistant")
        return F.array_join(F.transform(p, lambda x, k: F.concat(role(x, k), F.lit(":"), x["text"])), "\n")

    return let(pieces, lines)


def repair_conversations(df: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired: one row for each conversation of `df` (conv_id, turn, role, text, gone).

    `gone` marks turns that are not there but whose conversation is to be reported. Null turns come first; rows of one turn go by role, then text. Rows equal
    in role and text to an earlier one of their conversation are duplicates, blank ones aside. A conversation without turns has zeros, an empty audit and an
    empty text; a null conv_id is one conversation. Roles and texts must not be null. A conversation is one value of one row, whatever its length; work on it
    grows with its length. Other columns are ignored; an empty table gives no rows.
    """
    own = F.struct("place", "role", "text", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("must_go"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).cast("int").alias("truncated"))
    there = lambda x: F.when(~F.col("gone"), x)
    number = lambda x: F.count(there(F.when(x, 1)))
    turn = there(F.col("turn"))
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - number(F.col("new_turn")), F.lit(0)).cast("long")
    counted = [number(F.col("fault") == c).alias(c) for c in ("blank", "duplicate", "truncated")]
    folded = flagged(df.select("conv_id", "turn", "role", "text", "gone")).groupBy("conv_id").agg(gaps.alias("gaps"), *counted, number(F.col("illegal")).alias("illegal"), F.array_sort(F.collect_list(there(own))).alias("turns"))
    best = folded.withColumn("best", cheapest(F.col("turns")))
    audit = F.col("best.audit")
    return best.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), audit.alias("audit"), repaired_text(F.col("turns"), audit).alias("repaired"))
