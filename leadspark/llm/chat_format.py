"""Chat formatting with Spark expressions only.

A conversation's turns are collected, sorted, merged where the role stays the same, and
joined to one text. Control strings inside texts are broken up by a backslash, which is
itself doubled, so the text can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``open role close text join text end`` for every merged turn."""

    open: str = "[INST]"
    close: str = "[/INST]"
    join: str = "<sep>"
    end: str = "</s>"

    @property
    def controls(self) -> tuple[str, ...]:
        return self.open, self.close, self.join, self.end


TEMPLATE = Template()
#: Texts of this role bear loss.
LEARNED = "assistant"


def guard(text: Column, template: Template = TEMPLATE) -> Column:
    """``text`` without any control string; ``unguard`` undoes it."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), template.controls, doubled)


def unguard(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(rows: DataFrame, template: Template = TEMPLATE, learned: str = LEARNED) -> DataFrame:
    """``conv_id, formatted, loss_spans`` from ``(conv_id, turn, role, text)`` rows.

    Turns are sorted by turn, role and text (nulls first); null role and text are empty.
    Repeated rows are turns like any other. Adjacent turns of one role become one turn whose
    texts are joined by ``template.join``. ``loss_spans`` are the code points ``[start, stop)``
    of the learned role's texts in ``formatted``. Rows with a null conv_id form one
    conversation. An empty table gives no rows; other columns are not read.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    index = F.sequence(F.lit(0), F.size("t") - 1)
    starts = F.filter(index, lambda i: (i == 0) | (F.col("t")[i].role != F.col("t")[F.greatest(i - 1, F.lit(0))].role))
    chats = chats.withColumn("starts", starts)
    stop = lambda k: F.coalesce(F.get("starts", k + 1), F.size("t"))
    chats = chats.withColumn("merged", F.transform("starts", lambda s, k: F.struct(
        F.col("t")[s].role.alias("role"), F.transform(F.slice("t", s + 1, stop(k) - s), lambda x: guard(x.text, template)).alias("texts"),
    )))
    lit = F.lit
    # (text, bears loss) parts of one merged turn, markers included
    parts = lambda m: F.concat(
        F.array(F.struct(F.concat(lit(template.open), guard(m.role, template), lit(template.close)).alias("s"), lit(False).alias("loss"))),
        F.flatten(F.transform(m.texts, lambda x, i: F.when(i == 0, F.array(F.struct(x.alias("s"), (m.role == learned).alias("loss")))).otherwise(
            F.array(F.struct(lit(template.join).alias("s"), lit(False).alias("loss")), F.struct(x.alias("s"), (m.role == learned).alias("loss")))
        ))),
        F.array(F.struct(lit(template.end).alias("s"), lit(False).alias("loss"))),
    )
    chats = chats.withColumn("parts", F.flatten(F.transform("merged", parts)))
    # running lengths by array aggregation
    zero = F.struct(lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))
    spans = F.aggregate("parts", zero, lambda a, p: F.struct(
        (a.at + F.length(p.s)).alias("at"),
        F.when(p.loss, F.concat(a.spans, F.array(F.struct(a.at.alias("start"), (a.at + F.length(p.s)).alias("stop"))))).otherwise(a.spans).alias("spans"),
    ), lambda a: a.spans)
    return chats.select("conv_id", F.array_join(F.transform("parts", lambda p: p.s), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """``array<struct<role, text>>``: the turns as they were before merging."""
    bodies = F.split(formatted, escape(template.end))
    bodies = F.slice(bodies, 1, F.size(bodies) - 1)
    return F.flatten(F.transform(bodies, lambda b: F.transform(
        F.split(F.substring(b, F.locate(template.close, b) + len(template.close), F.length(b)), escape(template.join)),
        lambda x: F.struct(
            unguard(F.substring(b, lit_int(len(template.open) + 1), F.locate(template.close, b) - len(template.open) - 1)).alias("role"), unguard(x).alias("text"),
        ),
    )))


def lit_int(n: int) -> Column:
    return F.lit(n).cast("int")


def read_loss(formatted: Column, spans: Column) -> Column:
    """``array<string>``: the texts under the loss mask, as they were."""
    return F.transform(spans, lambda s: unguard(F.substring(formatted, (s.start + 1).cast("int"), (s.stop - s.start).cast("int"))))
