"""Repair of conversation structure by signatures.

A conversation's rows become a compact string, one letter a row: the initial of its role, upper case if
the text is cut short, or ``x`` if the row must go. Each distinct signature is solved once, by memoised
recursion over (row, state of the grammar, inserts left); the cheapest edits of a signature come as an
audit string and as a plan of replay, are joined back to all conversations of that signature, and are
replayed on the rows as array expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitspark.llm.common import Scratch, join_groups

#: White space, marks that end a sentence, and pairs of role initials that may be neighbours.
SPACE = " \t\n\x0b\f\r"
ENDINGS = ".!?"
LEGAL = ("su", "ua", "au")
#: What the edits cost, and what an undeleted row costs that is cut short.
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1

#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. Next state by role, and states where it may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
MAY_END = (START, ASSISTANT)
#: The one role that a state takes from a rerole or an insert.
ROLE_OF = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAMES = {"u": "user", "a": "assistant"}
NEVER = 1 << 60


@dataclass
class Repair:
    """The cheapest edits of a signature: a row each, with what is inserted before it, and what comes at the end."""

    cost: int
    audit: str
    before: list[list[str]]
    role: list[str | None]
    dropped: list[bool]
    after: list[str]


class Solver:
    """Cheapest edits of one signature.

    In a state each letter of an edit leads to one state only, so of edits of one cost the least letter
    gives the least audit, and the memo needs no strings. More than two inserts in a row return to a
    state. Rows are entered from the last one on, which keeps the recursion as shallow as the inserts;
    costs are kept for two rows, letters for all.
    """

    def __init__(self, signature: str):
        self.signature, self.costs = signature, {}
        self.letters = bytearray(12 * (len(signature) + 1))
        for at in range(len(signature), -1, -1):
            for state in range(4):
                self.least(at, state, 2)
            self.costs = {key: cost for key, cost in self.costs.items() if key[0] == at}

    def edits(self, at: int, state: int, inserts: int):
        """(letter, cost, next row, next state, inserts left) of each edit that is open here."""
        role = ROLE_OF[state]
        if inserts:
            yield "I", INSERT, at, NEXT[state, role], inserts - 1
        if at == len(self.signature):
            return
        row = self.signature[at]
        yield "D", DELETE, at + 1, state, 2
        if row != "x":
            short = CUT_SHORT if row.isupper() else 0
            if (state, row.lower()) in NEXT:
                yield "K", KEEP + short, at + 1, NEXT[state, row.lower()], 2
            yield "R", REROLE + short, at + 1, NEXT[state, role], 2

    def least(self, at: int, state: int, inserts: int) -> int:
        """Least cost from here to the end; notes the first letter of the least audit of that cost, none at the end."""
        key = (at, state, inserts)
        if key not in self.costs:
            ended = at == len(self.signature) and state in MAY_END
            cost, letter = min([(0 if ended else NEVER, ""), *((cost + self.least(*then), letter) for letter, cost, *then in self.edits(*key))])
            self.costs[key] = cost
            self.letters[12 * at + 3 * state + inserts] = ord(letter) if letter else 0
        return self.costs[key]

    def solve(self) -> Repair:
        n = len(self.signature)
        out = Repair(self.least(0, START, 2), "", [[] for _ in range(n)], [None] * n, [False] * n, [])
        audit, (at, state, inserts) = [], (0, START, 2)
        while code := self.letters[12 * at + 3 * state + inserts]:
            letter = chr(code)
            if letter == "I":
                (out.before[at] if at < n else out.after).append(NAMES[ROLE_OF[state]])
            elif letter == "D":
                out.dropped[at] = True
            elif letter == "R":
                out.role[at] = NAMES[ROLE_OF[state]]
            audit.append(letter)
            at, state, inserts = next(then for x, _, *then in self.edits(at, state, inserts) if x == letter)
        out.audit = "".join(audit)
        return out


PLAN = "before array<array<string>>, role array<string>, dropped array<boolean>, after array<string>"


def solve_signatures(signatures: DataFrame) -> DataFrame:
    """Cost, audit and plan of each row of (signature, n)."""

    def run(batches):
        for batch in batches:
            # A few at a time: the plan of a long signature is larger than the signature.
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = [Solver(s).solve() for s in part.column(0).to_pylist()]
                strings = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array([x.cost for x in found], pa.int64()), pa.array([x.audit for x in found], pa.string()), pa.array([x.before for x in found], pa.list_(strings)),
                        pa.array([x.role for x in found], strings), pa.array([x.dropped for x in found], pa.list_(pa.bool_())), pa.array([x.after for x in found], strings),
                    ],
                    names=["signature", "n", "cost", "audit", "before", "role", "dropped", "after"],
                )

    return signatures.select("signature", "n").mapInArrow(run, f"signature string, n long, cost long, audit string, {PLAN}")


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def describe(rows: DataFrame) -> DataFrame:
    """One row a conversation of (conv, present, turn, role, text): faults, gaps, illegal neighbours, signature, and its rows in order.

    All windows and the grouping are by conversation, so there is one exchange; texts move once.
    """
    bare = F.rtrim("text", F.lit(SPACE))
    order = ["turn", "role", "text"]
    rows = rows.withColumn("blank", bare == "").withColumn("short", ~F.right(bare, F.lit(1)).isin(*ENDINGS))
    # Distributed by conversation first: the finer window below then keeps that, instead of dealing rows by role and text.
    rows = rows.repartition("conv")
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy("conv", "present", "role", "text").orderBy("turn")) > 1)
    pair = F.concat(F.lag(initial(F.col("role"))).over(Window.partitionBy("conv", "present").orderBy(*order)), initial(F.col("role")))
    rows = rows.withColumn("illegal", F.coalesce(~pair.isin(*LEGAL), F.lit(False)))
    # A role outside the three is told apart from them by a digit, which no state takes.
    letter = F.when(initial(F.col("role")).isin("s", "u", "a"), initial(F.col("role"))).otherwise("0")
    upper = F.when(F.col("short"), F.when(letter == "0", "O").otherwise(F.upper(letter))).otherwise(letter)
    gone = F.col("blank") | F.col("seen")
    one = F.struct("turn", "role", "text", F.when(gone, "x").otherwise(upper).alias("letter"))
    here = F.col("present")
    grouped = rows.groupBy("conv").agg(
        F.count_if(here & F.col("blank")).alias("blank"), F.count_if(here & ~F.col("blank") & F.col("seen")).alias("duplicate"), F.count_if(here & ~gone & F.col("short")).alias("truncated"),
        F.count_if(here & F.col("illegal")).alias("illegal"), F.array_sort(F.collect_list(F.when(here, one))).alias("rows"),
    )
    turns = F.filter("rows.turn", lambda t: t.isNotNull())
    gaps = F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0)).cast("long")
    return grouped.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "rows", F.array_join("rows.letter", "").alias("signature"))


def repair_conversations(rows: DataFrame, present: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, and ``repaired``, its repaired (role, text) in order.

    Rows go by turn, null turns first, rows of one turn by role and text. A null role or text is one space. A row's
    first fault counts: blank (only white space), duplicate (role and text stand earlier), truncated (the last character
    that isn't white space ends no sentence). Roles count by their initial; one outside s, u and a can't be kept. Edits: K keeps a row, R
    makes it a user's or an assistant's, D deletes it, I inserts an empty text; the initials of the result follow (s?(ua)+)?.
    The audit is the cheapest edits' letters, ties ASCII-least. Rows where ``present`` is false are not part of
    their conversation, which is listed all the same; without rows all numbers are 0. Repeated rows are duplicates. Null ids
    are one conversation. An empty table gives an empty table; other columns are ignored.

    A conversation is one row of the result, so it is held by one task once; a signature that a third of all
    conversations have is solved once and sent to every task, not shuffled to one.
    """
    scratch = Scratch(rows.sparkSession)
    own = rows.select(
        F.col(conv_col).alias("conv"), (F.lit(True) if present is None else present).alias("present"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    told = scratch.stash(describe(own), "conversations")
    signatures = told.groupBy("signature").agg(F.count("*").alias("n"))
    plans = scratch.stash(solve_signatures(signatures), "plans", batch_bytes=4 << 20)
    out = join_groups(told, plans.withColumnRenamed("role", "new_role"), "signature", "n", told.count(), inner=True)
    edits = F.arrays_zip(F.col("rows").alias("row"), F.col("before").alias("before"), F.col("new_role").alias("role"), F.col("dropped").alias("dropped"))
    blank = lambda role: F.struct(role.alias("role"), F.lit("").alias("text"))

    def replay(x: Column) -> Column:
        own = F.array(F.struct(F.coalesce(x["role"], x["row"]["role"]).alias("role"), x["row"]["text"].alias("text")))
        return F.concat(F.transform(x["before"], blank), F.when(x["dropped"], F.slice(own, 1, 0)).otherwise(own))

    repaired = F.concat(F.flatten(F.transform(edits, replay)), F.transform("after", blank))
    return out.select(F.col("conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", repaired.alias("repaired"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations`` after damage by crc32 of ``conv_id:turn`` modulo 20, with ``present`` false for those that it drops.

    0 drops the row, 1 empties its text, 2 takes the marks .!? out of it, 3 repeats it, 4 makes it a user's. Nulls are one space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    k = F.col("kind")
    return rows.select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), F.when(k == 1, "").when(k == 2, F.translate("text", ENDINGS, "")).otherwise(F.col("text")).alias("text"),
        (k != 0).alias("present"), F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op11(rows: DataFrame) -> DataFrame:
    """The digests of ``repair_conversations`` over damaged conversations; the repaired rows as the hash of ``role:text`` lines."""
    out = repair_conversations(damage(rows), F.col("present"))
    line = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(line, 256).alias("repaired_sha256"))
