"""Chat formatting of heterogeneous layouts, in DataFrame functions only.

A record is a VARIANT. The hash of its nested field paths, its fingerprint, selects a declarative mapping,
which turns prompt, instruction or message layouts into canonical turns. Turns are written by a template that marks
them and escapes control strings inside texts; a loss mask gives the spans of the assistant's texts.

A layout no mapping knows gives null turns and stays in the table. Null texts and roles are empty. Turns of
one conversation are ordered by their order column, their place in the record, role and text, so ties and repeated
rows (all kept) have one result; a null order comes first. Each record with a null key is a conversation of its own, so they
neither merge nor meet in one task. A conversation's formatted text is one value, so its turns meet in one task; nothing larger does.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewright.llm.shared import unique_name

START, END = "<|im_start|>", "<|im_end|>"
#: Names that lists of messages use for the canonical roles; the roles of plain turn rows are kept as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Turn:
    """One turn: a fixed role or the path of one, and the paths whose texts it joins by an empty line."""

    text: tuple[str, ...]
    role: str = ""
    role_path: str = ""


@dataclass(frozen=True)
class Mapping:
    """A layout: the field paths it has and may have, and its turns; or a list field with role and text in its items."""

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[Turn, ...] = ()
    items: tuple[str, str, str] | None = None  # list, role, text

    def fingerprint_sources(self) -> list[str]:
        """The sorted paths of every form that the layout can take."""
        forms = [c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        return [",".join(sorted({*self.paths, *c})) for c in forms]


#: The layouts known from the start; callers may pass more.
MAPPINGS = (
    Mapping("turn_rows", ("conv_id", "role", "text", "turn"), turns=(Turn(("text",), role_path="role"),)),
    Mapping("messages", ("messages[].content", "messages[].role"), ("id", "source"), items=("messages", "role", "content")),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), ("id", "system"), turns=(Turn(("system",), "system"),), items=("conversations", "from", "value")),
    Mapping("instruction", ("instruction", "output"), ("input", "system", "id"), turns=(Turn(("system",), "system"), Turn(("instruction", "input"), "user"), Turn(("output",), "assistant"))),
    Mapping("prompt_completion", ("completion", "prompt"), ("id", "system"), turns=(Turn(("system",), "system"), Turn(("prompt",), "user"), Turn(("completion",), "assistant"))),
    Mapping("prompt_response", ("prompt", "response"), ("id", "system"), turns=(Turn(("system",), "system"), Turn(("prompt",), "user"), Turn(("response",), "assistant"))),
    Mapping("question_answer", ("answer", "question"), ("context", "id"), turns=(Turn(("context", "question"), "user"), Turn(("answer",), "assistant"))),
)


def field_paths(record: Column) -> Column:
    """The sorted nested field paths of a VARIANT, joined by commas; items of a list share one path.

    ``schema_of_variant`` spells the shape; its type names go, and one pass over the tokens keeps a stack of prefixes.
    """
    shape = F.regexp_replace(F.schema_of_variant(record), r"DECIMAL\(\d+,\d+\)", "DECIMAL")
    tokens = F.regexp_extract_all(shape, F.lit(r"(`(?:[^`]|``)*`|[^\s:<>,`]+):|(OBJECT<|ARRAY<|>|[A-Z_]+)"), F.lit(0))
    start = F.struct(F.array(F.lit("")).alias("stack"), F.lit("").alias("at"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, t: Column) -> Column:
        top = F.element_at(s["stack"], -1)
        name = F.regexp_replace(t, r"^`|`?:$", "")
        path = F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name))
        pushed = F.when(t == "ARRAY<", F.concat(s["at"], F.lit("[]"))).otherwise(s["at"])
        return (
            F.when(t.endswith(":"), F.struct(s["stack"].alias("stack"), path.alias("at"), s["found"].alias("found")))
            .when(t.isin("OBJECT<", "ARRAY<"), F.struct(F.concat(s["stack"], F.array(pushed)).alias("stack"), pushed.alias("at"), s["found"].alias("found")))
            .when(t == ">", F.struct(F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1).alias("stack"), s["at"].alias("at"), s["found"].alias("found")))
            .otherwise(F.struct(s["stack"].alias("stack"), s["at"].alias("at"), F.concat(s["found"], F.array(s["at"])).alias("found")))
        )

    return F.array_join(F.array_sort(F.array_distinct(F.aggregate(tokens, start, step)["found"])), ",")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def _role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(role)), role, F.lit(""))


def _mapped(m: Mapping, record: Column) -> Column:
    def text(path: str) -> Column:
        return F.try_variant_get(record, f"$.{path}", "string")

    out = []
    for t in m.turns:
        role = F.lit(t.role) if t.role else F.coalesce(text(t.role_path), F.lit(""))
        parts = F.concat_ws("\n\n", *[F.nullif(text(p), F.lit("")) for p in t.text])
        one = F.array(F.struct(role.alias("role"), parts.alias("text")))
        optional = all(p in m.optional for p in t.text)
        out.append(F.when(parts != "", one).otherwise(F.array().cast(TURNS)) if optional else one)
    if m.items:
        field, who, what = m.items
        items = F.coalesce(F.try_variant_get(record, f"$.{field}", f"array<struct<`{who}`:string,`{what}`:string>>"), F.array().cast(f"array<struct<`{who}`:string,`{what}`:string>>"))
        out.append(F.transform(items, lambda x: F.struct(_role(x[who]).alias("role"), F.coalesce(x[what], F.lit("")).alias("text"))))
    return F.concat(*out)


def canonical_turns(df: DataFrame, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS, names: tuple[str, str] = ("layout", "turns")) -> DataFrame:
    """``df`` with the name of each record's layout and its turns array<struct<role,text>>."""
    mark = unique_name("_fingerprint", df.columns)
    record = F.col(f"`{record_col}`")
    df = df.withColumn(mark, fingerprint(record))
    layout = turns = F.when(F.lit(False), F.lit(None))
    for m in mappings:
        known = F.col(mark).isin([F.xxhash64(F.lit(s)) for s in m.fingerprint_sources()])
        layout, turns = layout.when(known, F.lit(m.name)), turns.when(known, _mapped(m, record))
    return df.withColumns({names[0]: layout.cast("string"), names[1]: turns.cast(TURNS)}).drop(mark)


def escape(text: Column) -> Column:
    r"""Puts one backslash more between each ``<`` and ``|`` that only backslashes part; undone by ``unescape``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _unescape_role(role: Column) -> Column:
    for a, b in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def format_chats(df: DataFrame, key_col: str, order_col: str, turns_col: str = "turns") -> DataFrame:
    """(key, formatted, mask array<struct<start,length>>, unmapped): one row for each conversation, spans in code points.

    ``unmapped`` counts records without turns; a conversation of none but these has a null text. One shuffle by the key serves the running offsets and the grouping.
    """
    key = F.col(f"`{key_col}`")
    own = F.when(key.isNull(), F.monotonically_increasing_id())
    rows = df.select(key.alias("_key"), own.alias("_own"), F.col(f"`{order_col}`").alias("_order"), F.col(f"`{turns_col}`").alias("_turns"))
    rows = rows.select("_key", "_own", "_order", F.posexplode_outer("_turns").alias("_pos", "_turn"))
    head = F.concat(F.lit(START), _escape_role(F.col("_turn.role")), F.lit("\n"))
    texts = F.col("_turn.role").alias("_role"), F.col("_turn.text").alias("_text"), head.alias("_head"), escape(F.col("_turn.text")).alias("_body")
    rows = rows.select("_key", "_own", "_order", "_pos", *texts)
    rows = rows.withColumn("_segment", F.concat("_head", "_body", F.lit(END + "\n")))
    w = Window.partitionBy("_key", "_own").orderBy("_order", "_pos", "_role", "_text")
    rows = rows.withColumn("_start", F.sum(F.length("_segment")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("_segment"))
    span = F.when(F.col("_role") == "assistant", F.struct((F.col("_start") + F.length("_head")).alias("start"), F.length("_body").cast("long").alias("length")))
    turn = F.when(F.col("_pos").isNotNull(), F.struct("_start", "_segment", span.alias("_span")))
    unmapped = F.count_if(F.col("_pos").isNull()).alias("unmapped")
    grouped = rows.groupBy("_key", "_own").agg(F.array_sort(F.collect_list(turn)).alias("_all"), unmapped)
    return grouped.select(
        F.col("_key").alias(key_col),
        F.when(F.size("_all") > 0, F.array_join(F.transform("_all", lambda x: x["_segment"]), "")).alias("formatted"),
        F.filter(F.transform("_all", lambda x: x["_span"]), lambda x: x.isNotNull()).alias("mask"),
        "unmapped",
    )


def read_chats(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (.., formatted, mask) that have a text, with what can be read back: turns and loss_texts, both unescaped."""
    segments = F.slice(F.split("formatted", r"<\|im_start\|>"), F.lit(2), F.lit(2_000_000_000))

    def turn(s: Column) -> Column:
        at = F.locate("\n", s)
        return F.struct(_unescape_role(F.substring(s, F.lit(1), at - 1)).alias("role"), unescape(F.substring(s, at + 1, F.length(s) - at - len(END) - 1)).alias("text"))

    texts = F.transform("mask", lambda m: unescape(F.substring("formatted", (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return df.where("formatted IS NOT NULL").withColumns({"turns": F.transform(segments, turn), "loss_texts": texts})
