"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that may stand in the template's brackets; a control string is <s>, </s>, [NAME] or [/NAME].
NAMES = "INST|SYS|OUT|ROLE"
CONTROL = rf"(<|\[)(\\*)(/?s>|/?(?:{NAMES})\])"
ESCAPED = rf"(<|\[)\\(\\*)(/?s>|/?(?:{NAMES})\])"


@dataclass(frozen=True)
class Template:
    """roles: role -> bracket name; learn: roles whose text bears loss; moves: (state, role) -> state.

    A turn reads <s>[NAME] text [/NAME]</s>; a role without a name of its own reads
    <s>[ROLE] role [/ROLE]text [/ROLE]</s>. States are the last role, 'start' before the first.
    """

    roles: dict = field(default_factory=lambda: {"system": "SYS", "user": "INST", "assistant": "OUT"})
    learn: tuple = ("assistant",)
    moves: tuple = (("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"))
    final: tuple = ("assistant",)


def escape(text: Column) -> Column:
    """Control strings in a text get a backslash after their first character, one more where there are some."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _pairs(items: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in items.items() for x in kv])


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, valid, error_turn, formatted, segments: array<struct<text, loss>> of every conversation.

    turns(conv_id, turn, role, text): rows go by turn, ties by role and text; null text and role
    are empty; repeated rows are turns of their own; rows without conv_id form one conversation.
    formatted is the segments' texts joined. valid: the machine ran through and ended in a
    final state; error_turn: the first position (from 0) without a move. All conversations are
    formatted, valid or not. A conversation is one row, so its turns, however long, meet in one
    task; other columns are ignored; an empty table gives an empty one.
    """
    names = _pairs(template.roles)
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = escape(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    moves = _pairs({f"{a}>{b}": b for a, b in template.moves})

    def run(state, t):
        to = F.try_element_at(moves, F.concat_ws(">", state["at"], t["role"]))
        stopped = state["error"] >= 0
        return F.struct(
            F.when(stopped | to.isNull(), state["at"]).otherwise(to).alias("at"),
            F.when(stopped | to.isNotNull(), state["error"]).otherwise(state["n"]).alias("error"),
            (state["n"] + 1).alias("n"),
        )

    machine = F.aggregate("t", F.struct(F.lit("start").alias("at"), F.lit(-1).alias("error"), F.lit(0).alias("n")), run)

    def segments(t):
        name = F.try_element_at(names, t["role"])
        open_ = F.when(name.isNotNull(), F.concat(F.lit("<s>["), name, F.lit("] "))).otherwise(F.concat(F.lit("<s>[ROLE] "), escape(t["role"]), F.lit(" [/ROLE]")))
        close = F.concat(F.lit(" [/"), F.coalesce(name, F.lit("ROLE")), F.lit("]</s>"))
        plain = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))
        return F.array(plain(open_), F.struct(t["text"].alias("text"), t["role"].isin(*template.learn).alias("loss")), plain(close))

    made = whole.select("conv_id", machine.alias("m"), F.flatten(F.transform("t", segments)).alias("segments"))
    return made.select(
        "conv_id",
        ((F.col("m.error") < 0) & F.col("m.at").isin(*template.final)).alias("valid"),
        F.when(F.col("m.error") >= 0, F.col("m.error")).alias("error_turn"),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds turns: array<struct<role, text>>, parsed from the formatted string alone."""
    back = _pairs({v: k for k, v in template.roles.items()})

    def parse(chunk):
        name = F.regexp_extract(chunk, r"^\[([A-Z]+)\] ", 1)
        body = F.regexp_extract(chunk, r"(?s)^\[[A-Z]+\] (.*) \[/[A-Z]+\]</s>$", 1)
        other = name == "ROLE"
        return F.struct(
            F.when(other, unescape(F.regexp_extract(body, r"(?s)^(.*?) \[/ROLE\]", 1))).otherwise(F.try_element_at(back, name)).alias("role"),
            unescape(F.when(other, F.regexp_replace(body, r"(?s)^.*? \[/ROLE\]", "")).otherwise(body)).alias("text"),
        )

    chunks = F.filter(F.split("formatted", "<s>", -1), lambda c: c != "")
    return formatted.withColumn("turns", F.transform(chunks, parse))


def probe_turns(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user and an assistant saying the template's own control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )


def chat_digest(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Digest columns read back from the formatted conversations."""
    read = read_back(format_conversations(turns, template), template)
    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.array_join(learned, "").alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid", "error_turn",
    ).select(
        "conv_id", "n_turns", "turns_sha256", F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "valid", "error_turn",
    )
