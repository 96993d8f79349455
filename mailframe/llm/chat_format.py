r"""Chat formatting, in DataFrame functions only.

A finite-state machine over roles validates the order of turns; a declarative template turns a
conversation into text segments, each with a loss flag. Control strings inside texts are escaped
reversibly: `\` becomes `\\`, and a `\` is put after the first character of every control string,
overlapping ones too. So no control string is left in an escaped text, and `\x` reads back as `x`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class ChatTemplate:
    """bos, then for each turn: opening, role, separator, text, closing."""

    bos: str = "<s>"
    opening: str = "[INST]"
    separator: str = "[/INST]"
    closing: str = "</s>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: (state, role) -> state; a state is named after the last role.
    moves: tuple[tuple[str, str], ...] = (("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"))
    #: A valid conversation ends in one of these.
    ends: tuple[str, ...] = ("assistant",)
    extra_controls: tuple[str, ...] = field(default=())

    def __post_init__(self):
        c = self.controls
        if not all(c) or any("\\" in x for x in c):
            raise ValueError("control strings are not empty and hold no backslash")
        for a in c:  # neither may one begin inside another, nor half of one in a text and half in what follows
            if any(b.startswith(a[k:]) or a[k:].startswith(b) for b in c for k in range(len(a)) if k or b != a):
                raise ValueError(f"control string {a!r} overlaps another")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.bos, self.opening, self.separator, self.closing, *self.extra_controls)

    def escape(self, text: Column) -> Column:
        heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({heads})", r"$1\\")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


TEMPLATE = ChatTemplate()


def format_chats(df: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """conv_id, formatted, segments (text, role, loss), valid, error_turn, one row a conversation.

    Turns are taken in the order of turn, then role, then text; repeated rows are turns of their own.
    A null text or role is empty; null turns come first; rows with a null conv_id form one
    conversation. An order that the machine does not allow is formatted all the same, with valid
    false and error_turn the 0-based position of the first turn that is not allowed (n_turns when the
    end is not allowed). Other columns are not read. A conversation is one row of the result, so it
    has to fit in memory; no step gathers more than one.
    """
    lit, t = F.lit, template
    turns = df.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    allowed = F.array(*[lit(f"{a}\n{b}") for a, b in t.moves])

    def step(state: Column, turn: Column) -> Column:
        good = F.array_contains(allowed, F.concat(state["at"], lit("\n"), turn["role"]))
        bad = F.when(state["bad"] >= 0, state["bad"]).when(~good, state["n"]).otherwise(lit(-1))
        return F.struct(turn["role"].alias("at"), (state["n"] + 1).alias("n"), bad.alias("bad"))

    first = F.struct(lit(t.start).alias("at"), lit(0).alias("n"), lit(-1).alias("bad"))
    walked = F.aggregate("turns", first, step)

    def emit(turn: Column) -> Column:
        seg = lambda text, loss: F.struct(text.alias("text"), turn["role"].alias("role"), loss.alias("loss"))
        return F.array(
            seg(F.concat(lit(t.opening), t.escape(turn["role"]), lit(t.separator)), lit(False)),
            seg(t.escape(turn["text"]), turn["role"].isin(*t.loss_roles)),
            seg(lit(t.closing), lit(False)),
        )

    head = F.array(F.struct(lit(t.bos).alias("text"), lit("").alias("role"), lit(False).alias("loss")))
    out = grouped.select("conv_id", F.concat(head, F.flatten(F.transform("turns", emit))).alias("segments"), walked.alias("walked"))
    bad = F.when(F.col("walked.bad") >= 0, F.col("walked.bad")).when(~F.col("walked.at").isin(*t.ends), F.col("walked.n"))
    return out.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", bad.isNull().alias("valid"), bad.alias("error_turn")
    )


def read_back(formatted: Column, template: ChatTemplate = TEMPLATE) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    t = template
    body = F.substring(formatted, len(t.bos) + 1, 2_147_483_647)
    chunks = F.split(body, re.escape(t.closing))
    turns = F.slice(chunks, 1, F.size(chunks) - 1)  # what follows the last closing is empty

    def parse(chunk: Column) -> Column:
        parts = F.split(F.substring(chunk, len(t.opening) + 1, 2_147_483_647), re.escape(t.separator), 2)
        return F.struct(t.unescape(parts[0]).alias("role"), t.unescape(parts[1]).alias("text"))

    return F.transform(turns, parse)


def digest(chats: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """The contract's columns, read back from the formatted text and the loss mask."""
    line = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
    return chats.withColumns({"back": read_back(F.col("formatted"), template), "masked": masked}).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(text))
    return digest(format_chats(rows.union(more)))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *,
    lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after,
    length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS escaped
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(3 + sum(6 + length(role) + 7 + escaped + 4) AS BIGINT) AS formatted_chars,
  bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))
    AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM e GROUP BY conv_id
"""
