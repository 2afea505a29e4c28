"""Chat formatting: layouts are told apart by a fingerprint of their nested field paths."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Leaf paths such as `messages[].role`, sorted."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    if isinstance(schema, T.MapType):
        return field_paths(schema.valueType, f"{at}{{}}")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _turn(role: Column | str, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role.cast("string")).alias("role"), text.cast("string").alias("text"))


def _listed(field: str, role: str, text: str) -> Column:
    return F.transform(F.col(field), lambda m: _turn(m[role], m[text]))


def _pair(question: Column, answer: str, system: str | None = None) -> Column:
    head = [F.when(F.col(system).isNotNull(), _turn("system", F.col(system)))] if system else []
    return F.filter(F.array(*head, _turn("user", question), _turn("assistant", F.col(answer))), lambda t: t.isNotNull())


def _instruction() -> Column:
    extra = F.coalesce(F.col("input").cast("string"), F.lit(""))
    return F.when(extra == "", F.col("instruction")).otherwise(F.concat_ws("\n\n", F.col("instruction"), extra))


@dataclass(frozen=True)
class Layout:
    """A declared layout: the field paths it is known by and how they make turns."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[], Column] | None  # None: one row is one turn already

    @property
    def print(self) -> str:
        return fingerprint(list(self.paths))


LAYOUTS = (
    Layout("turn rows", ("conv_id", "role", "text", "turn"), None),
    Layout("messages", ("messages[].content", "messages[].role"), lambda: _listed("messages", "role", "content")),
    Layout("from-value", ("conversations[].from", "conversations[].value"), lambda: _listed("conversations", "from", "value")),
    Layout("prompt", ("completion", "prompt"), lambda: _pair(F.col("prompt"), "completion")),
    Layout("system prompt", ("completion", "prompt", "system"), lambda: _pair(F.col("prompt"), "completion", "system")),
    Layout("instruction", ("input", "instruction", "output"), lambda: _pair(_instruction(), "output")),
    Layout("question", ("answer", "question"), lambda: _pair(F.col("question"), "answer")),
)
#: Other names of roles and what they stand for.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def layout_of(schema: T.StructType, id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> Layout:
    """The layout whose fingerprint the schema has; failing that, the largest one that it contains.

    Columns beside a layout's own, the id among them, do not matter. No layout, or two
    equally large ones, raise ValueError.
    """
    paths = field_paths(schema)
    by_print = {x.print: x for x in layouts}
    for own in (paths, [p for p in paths if p != id_col]):
        if found := by_print.get(fingerprint(own)):
            return found
    inside = sorted((x for x in layouts if set(x.paths) <= set(paths)), key=lambda x: -len(x.paths))
    if not inside or len(inside) > 1 and len(inside[0].paths) == len(inside[1].paths):
        raise ValueError(f"no single layout for the field paths {paths}")
    return inside[0]


def canonical_turns(df: DataFrame, id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Rows (conv_id, turn, role, text) of any declared layout.

    Null roles and texts are empty; a null or empty list has no turns and so no rows.
    Role names are mapped by ROLES, except in turn rows, which are canonical already.
    """
    layout = layout_of(df.schema, id_col, layouts)
    if layout.turns is None:
        rows = df.select(F.col(id_col).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text"))
    else:
        turns = df.select(F.col(id_col).alias("conv_id"), F.posexplode(layout.turns()).alias("turn", "t"))
        names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.get(F.array(names), F.lit(0))[F.col("t.role")], F.col("t.role")).alias("role"), "t.text")
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def json_turns(df: DataFrame, id_col: str, json_col: str, layouts: tuple[tuple[str, str, Callable[[Column], Column]], ...]) -> DataFrame:
    """Turn rows of a column in which every row may have another layout.

    layouts: (schema as schema_of_variant words it, DDL for from_json, turns of the parsed struct).
    Each row's schema is hashed and looked up; nulls count as strings. A row of no
    declared layout, or that is no JSON, has no turns.
    """
    printed = F.sha2(F.regexp_replace(F.schema_of_variant(F.try_parse_json(F.col(json_col))), "VOID", "STRING"), 256)
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for schema, ddl, make in layouts:
        turns = F.when(F.col("_print") == hashlib.sha256(schema.encode()).hexdigest(), make(F.from_json(F.col(json_col), ddl))).otherwise(turns)
    rows = df.select(F.col(id_col).alias("conv_id"), F.col(json_col), printed.alias("_print"))
    rows = rows.select("conv_id", F.posexplode(turns).alias("turn", "t"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def escape_text(text: Column) -> Column:
    """One backslash more between `<` and `|`, so that no control string is left. Reversible."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    for raw, coded in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(raw), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for raw, coded in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(raw))
    return role


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: formatted text, loss mask by turn and as spans of code points.

    Turns stand in the order of (turn, role, text), nulls first; repeated rows stay.
    loss_spans are (start, length) in `formatted`, over the escaped texts of `loss_role`.
    One exchange by conv_id; a conversation must fit a row, as its text is one value.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    segment = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), F.col("_text"), F.lit(END + "\n"))
    rows = (
        turns.select("conv_id", "turn", "role", "text", escape_text(F.col("text")).alias("_text"))
        .withColumn("_segment", segment)
        .withColumn("_n", F.row_number().over(order))
        .withColumn("_end", F.sum(F.length("_segment").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_len", F.length("_text").cast("long"))
    )
    start = F.col("_end") - F.col("_len") - len(END) - 1
    each = F.struct("_n", "_segment", (F.col("role") == loss_role).alias("loss"), start.alias("start"), F.col("_len").alias("length"))
    return (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(each)).alias("_turns"))
        .select(
            "conv_id",
            F.array_join(F.col("_turns._segment"), "").alias("formatted"),
            F.col("_turns.loss").alias("loss_turns"),
            F.transform(F.filter("_turns", lambda t: t.loss), lambda t: F.struct(t.start.alias("start"), t.length.alias("length"))).alias("loss_spans"),
        )
    )


def parse_formatted(formatted: Column) -> Column:
    """Turns (role, text) read back from formatted text, unescaped."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    bodies = F.filter(parts, lambda p: F.startswith(p, F.lit(START)))
    return F.transform(
        bodies,
        lambda p: F.struct(
            unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape_text(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What the query returns, all of it read back from the formatted text and its mask."""
    read = formatted.withColumn("_read", parse_formatted(F.col("formatted")))
    spoken = F.concat(F.array_join(F.transform("_read", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""))
    learnt = F.array_join(F.transform(F.filter("_read", lambda t, i: F.get("loss_turns", i)), lambda t: t.text), "")
    read = read.select("conv_id", F.size("_read").cast("long").alias("n_turns"), spoken.alias("_spoken"), learnt.alias("_learnt"), "formatted")
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("_spoken", 256).alias("turns_sha256"),
        F.length("_learnt").cast("long").alias("loss_chars"),
        F.sha2("_learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
