"""Chat formatting: schema fingerprints select declarative mappings to canonical turns. DataFrame functions only.

A record may be laid out as one row per turn (conv_id, turn, role, text), as prompt and completion, as instruction, input
and output, or as a list of messages, under several names. The fingerprint of a record is the SHA-256 of the sorted paths
of its nested fields that have a value, the record's id left out; LAYOUTS gives, for each layout, its required and its
optional paths and where turns come from. The fingerprints of all admissible path sets are known before any row is read.
Only paths that some layout has count, a column `messages` or `conversations` only if its entries have roles, and of a row with
a turn number and a role or text only these three; so a `system` or a text column `messages` beside a turn changes nothing.
Records with another fingerprint make no turns; `rejected` returns them.

Template. A turn is `<turn ROLE>TEXT</turn>` and a line end; a turn that the loss mask covers is `<turn ROLE loss>`. In roles and
texts a backslash becomes `\\b` and `<` becomes `\\l`, in roles also `>` becomes `\\g` and a space `\\s`, so that none holds a
marker, and reading back splits at the markers and undoes this. The mask covers the texts of assistant turns.

Order: by turn number, then place in the record, role and text; repeated rows are repeated turns. Null roles and texts
are empty, a null turn number comes first (one that is no number counts as null); a table with the columns role and text has a
turn in every row without another layout, in a row without any value too. Null entries of a list are no turns; a conversation of
empty lists only stays, without turns and with an empty text. Columns of other names are ignored. An empty table gives no
conversation. A conversation of any length becomes one row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<turn:bigint,place:int,role:string,text:string>>"
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """name; paths that must and that may have a value; turns as (role or path of it, path of the text), or the path of a list
    of messages with the names of its role and text; columns that the table must have, with or without a value."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)
    columns: tuple[str, ...] = ()

    def fits(self, known: set[str]) -> bool:
        return known.issuperset((*self.required, *self.columns))

    def fingerprints(self) -> list[str]:
        subsets = chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [fingerprint_of([*self.required, *s]) for s in subsets]


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


_SHARE_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}
LAYOUTS = (
    Layout("turn_rows", ("turn",), ("role", "text"), turns=(("@role", "text"),)),
    # where a table has columns for turns, their rows may lack a number, role and text
    Layout("unnumbered_rows", (), ("role", "text"), turns=(("@role", "text"),), columns=("role", "text")),
    Layout("prompt_completion", ("prompt", "completion"), ("system", "turn"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), ("system", "turn"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), ("input", "system", "turn"), turns=(("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Layout("question_answer", ("question", "answer"), ("turn",), turns=(("user", "question"), ("assistant", "answer"))),
    Layout("messages", ("messages",), ("messages[].role", "messages[].content", "turn"), messages=("messages", "role", "content"), columns=("messages[].role",)),
    Layout("conversations", ("conversations",), ("conversations[].from", "conversations[].value", "turn"), messages=("conversations", "from", "value"), roles=_SHARE_ROLES, columns=("conversations[].from",)),
)
#: Of a row with a turn number, other paths don't count beside these.
TURN_ROW = ("turn", "role", "text")


def _fields(schema: T.StructType) -> dict[str, T.DataType]:
    """The nested field paths of a schema: a.b for structs, a[].b for lists of structs."""
    out: dict[str, T.DataType] = {}
    for f in schema.fields:
        kind, path = f.dataType, f.name
        out[path] = kind
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            out |= {f"{path}[].{p}": t for p, t in _fields(kind.elementType).items()}
        elif isinstance(kind, T.StructType):
            out |= {f"{path}.{p}": t for p, t in _fields(kind).items()}
    return out


def _present(path: str) -> Column:
    if "[]." in path:
        top, name = path.split("[].", 1)
        return F.coalesce(F.exists(F.col(top), lambda x: x.getField(name).isNotNull()), F.lit(False))
    return F.col(path).isNotNull()


def _usable(df: DataFrame) -> tuple[list[Layout], set[str]]:
    """The layouts that the columns of a table can hold, and the paths of any layout that it has."""
    has = set(_fields(df.schema))
    # a list of messages only counts if its entries have roles
    has -= {x.messages[0] for x in LAYOUTS if x.messages and not has.issuperset(x.columns)}
    return [x for x in LAYOUTS if x.fits(has)], has & {p for x in LAYOUTS for p in (*x.required, *x.optional)}


def fingerprint(df: DataFrame) -> Column:
    """Of each row, over those of its nested paths that some layout knows."""
    known = sorted(_usable(df)[1])
    turn_row = F.lit(False)
    if "turn" in known and {"role", "text"} & set(known):
        turn_row = F.col("turn").isNotNull() & F.coalesce(*[F.col(p).cast("string") for p in ("role", "text") if p in known]).isNotNull()
    paths = [F.when(_present(p) if p in TURN_ROW else _present(p) & ~turn_row, F.lit(p)) for p in known]
    return F.sha2(F.concat_ws("\n", *paths).cast("binary"), 256) if paths else F.lit(fingerprint_of([]))


def layout_name(df: DataFrame) -> Column:
    """The layout that a row's fingerprint selects, or null."""
    print_ = fingerprint(df)
    out = F.lit(None).cast("string")
    for x in _usable(df)[0]:
        out = F.when(print_.isin(x.fingerprints()), F.lit(x.name)).otherwise(out)
    return out


def _turn(place: Column, role: Column, text: Column, turn: Column) -> Column:
    empty = F.lit("")
    return F.struct(
        turn.try_cast("bigint").alias("turn"),
        place.cast("int").alias("place"),
        F.coalesce(role.cast("string"), empty).alias("role"),
        F.coalesce(text.cast("string"), empty).alias("text"),
    )


def _turns(x: Layout, known: set[str]) -> Column:
    turn = F.col("turn") if "turn" in known else F.lit(None)
    if x.messages:
        top, role, text = x.messages
        names = F.create_map(*[F.lit(y) for pair in x.roles.items() for y in pair]) if x.roles else None
        inner = {p.split("[].", 1)[1] for p in known if p.startswith(f"{top}[].")}

        def one(m, i):
            r = m.getField(role)
            r = F.coalesce(names[r], r) if names is not None else r
            return _turn(i, r, m.getField(text) if text in inner else F.lit(None), turn)

        return F.transform(F.filter(F.col(top), lambda m: m.isNotNull()), one)
    out = []
    for i, (role, path) in enumerate(x.turns):
        parts = [F.col(p) for p in path.split("+") if p in known]
        text = F.concat_ws("\n", *parts) if len(parts) > 1 else parts[0] if parts else F.lit(None)
        role_col = (F.col(role[1:]) if role[1:] in known else F.lit(None)) if role[0] == "@" else F.lit(role)
        one = _turn(F.lit(i), role_col, text, turn)
        out.append(F.when(F.coalesce(*parts).isNotNull(), one) if role == "system" and parts else one if role != "system" else None)
    return F.array_compact(F.array(*[c for c in out if c is not None]))


def _canonical_rows(df: DataFrame, id_col: str) -> DataFrame:
    fit, known = _usable(df)
    turns = F.lit(None).cast(TURNS)
    for x in fit:
        turns = F.when(F.col("_layout") == x.name, _turns(x, known)).otherwise(turns)
    return df.withColumn("_layout", layout_name(df)).select(F.col(id_col).alias("id"), turns.alias("turns")).where("turns is not null")


def rejected(df: DataFrame) -> DataFrame:
    """Rows whose fingerprint no layout knows."""
    return df.where(layout_name(df).isNull())


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns) with one row per id. Rows of one layout only, so that single turns travel, not lists, where a row is a turn."""
    rows = _canonical_rows(df, id_col)
    one = rows.select("id", F.explode_outer("turns").alias("t"))  # an empty list keeps its conversation
    return one.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit(" "), F.lit("\\s"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\g"), F.lit(">")), F.lit("\\s"), F.lit(" ")))


def unescape(text: Column) -> Column:
    # after a backslash there is always a letter, so the order below is safe
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_turns(turns: Column) -> Column:
    """The template over canonical turns."""
    mark = lambda t: F.when(t["role"] == LOSS_ROLE, F.lit(" loss>")).otherwise(F.lit(">"))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<turn "), escape_role(t["role"]), mark(t), escape(t["text"]), F.lit("</turn>\n"))), "")


def read_turns(formatted: Column) -> Column:
    """Back to an array of (role, loss, text)."""
    pieces = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")

    def parse(p):
        cut_at = F.instr(p, ">")
        head = F.substr(p, F.lit(7), cut_at - 7)
        loss = F.endswith(head, F.lit(" loss"))
        role = F.when(loss, F.substr(head, F.lit(1), F.length(head) - 5)).otherwise(head)
        return F.struct(unescape_role(role).alias("role"), loss.alias("loss"), unescape(F.substr(p, cut_at + 1)).alias("text"))

    return F.transform(pieces, parse)


def format_conversations(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, turns, formatted) with one row per conversation."""
    rows = canonical_turns(df, id_col)
    return rows.select(F.col("id").alias(id_col), "turns", format_turns(F.col("turns")).alias("formatted"))
