"""Chat formatting by schema fingerprint, in DataFrame functions only.

A layout is known by the hash of its nested field paths (names and array marks, sorted). The hash selects a declarative
mapping, which turns rows, prompt/response pairs, instruction records or message lists into canonical turns: an array of
(role, text). One template then formats the turns and marks what a loss may count.

The mask is run lengths in code points, one entry (skip, take, rest) for each turn: ``skip`` do not count, ``take`` do, ``rest``
do not. They add up to the length of the formatted text, and are found for each turn by itself. A turn ends where the end
mark stands, which no escaped text can hold, so the text under the mask is cut from pieces and a conversation of any
number of turns takes time in proportion to its length.

Control strings inside texts and roles are escaped reversibly: a backslash goes after the first character, and one more
where there were some already, so ``[INST]`` becomes ``[\\INST]`` and ``[\\INST]`` becomes ``[\\\\INST]``.

Defined results
  * null text and null role count as empty; conversations with a null id form one conversation;
  * turns go by turn number, nulls first, then by role and text, so ties and repeated rows have one order;
  * an empty table gives no rows; extra columns change nothing, since only a mapping's own paths are hashed;
  * a layout whose paths match no mapping is refused with its paths, and so is a wide table that two mappings fit, neither of
    which holds all paths of the other.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, MID, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Control strings of this template and of common others, after their first character.
CONTROL = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|<SYS>>|</SYS>>|/?INST\]"
ESCAPE = rf"([<\[])(\\*)({CONTROL})"
UNESCAPE = rf"([<\[])\\(\\*)({CONTROL})"
TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns. ``paths`` are its field paths; of ``turns``, each entry is (role path or =constant, text path)."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""  # path of an array of turns, for message layouts
    rows: dict[str, str] = field(default_factory=dict)  # group and order, for layouts with a row per turn
    roles: dict[str, str] = field(default_factory=dict, hash=False)  # spellings of roles


#: The layouts that are known.
MAPPINGS = (
    Mapping("turn_rows", ("conv_id", "role", "text", "turn"), turns=(("role", "text"),), rows={"group": "conv_id", "order": "turn"}),
    Mapping("prompt_response", ("prompt", "response"), turns=(("=user", "prompt"), ("=assistant", "response"))),
    Mapping("prompt_completion", ("completion", "prompt"), turns=(("=user", "prompt"), ("=assistant", "completion"))),
    Mapping("instruction", ("input", "instruction", "output"), turns=(("=user", "instruction+input"), ("=assistant", "output"))),
    Mapping("instruction_short", ("instruction", "output"), turns=(("=user", "instruction"), ("=assistant", "output"))),
    Mapping("messages", ("messages[].content", "messages[].role"), items="messages", turns=(("role", "content"),)),
    Mapping("sharegpt", ("conversations[].from", "conversations[].value"), items="conversations", turns=(("from", "value"),), roles={"human": "user", "gpt": "assistant"}),
)


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


REGISTRY = {fingerprint(m.paths): m for m in MAPPINGS}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type, arrays marked with []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def mapping_for(paths: list[str]) -> Mapping:
    """The mapping of these paths' hash; where a table has extra columns, that of the largest subset that is known."""
    if found := REGISTRY.get(fingerprint(paths)):
        return found
    fit = [m for m in MAPPINGS if {*m.paths} <= {*paths}]
    widest = [m for m in fit if not any({*m.paths} < {*other.paths} for other in fit)]
    if len(widest) > 1:
        raise ValueError(f"more than one mapping fits the layout {sorted(paths)}: {', '.join(m.name for m in widest)}")
    if not widest:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    return widest[0]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _turn(role: Column, text: Column, roles: dict[str, str]) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    for old, new in roles.items():
        role = F.when(role == old, new).otherwise(role)
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _value(path: str, get) -> Column:
    if path.startswith("="):
        return F.lit(path[1:])
    if "+" in path:
        first, second = (F.coalesce(get(p).cast("string"), F.lit("")) for p in path.split("+"))
        return F.when(F.length(second) > 0, F.concat(first, F.lit("\n"), second)).otherwise(first)
    return get(path)


def canonical(df: DataFrame, key: str | None = None) -> DataFrame:
    """(key, turns) for a table in any known layout; ``key`` names the id column of layouts with a row per conversation."""
    m = mapping_for([p for p in field_paths(df.schema) if p != key or p == "conv_id"])
    if m.rows:
        group, order = m.rows["group"], m.rows["order"]
        role, text = (F.coalesce(df[c].cast("string"), F.lit("")) for c in m.turns[0])
        rows = df.select(df[group].alias(group), F.struct(df[order].alias("o"), role.alias("role"), text.alias("text")).alias("t"))
        turns = rows.groupBy(group).agg(F.sort_array(F.collect_list("t")).alias("t"))
        return turns.select(group, F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return df.select(*([df[key]] if key else []), _turns(m, lambda p: df[p]).alias("turns"))


def _turns(m: Mapping, get) -> Column:
    if m.items:
        (role, text), empty = m.turns[0], F.array().cast(TURN)
        return F.coalesce(F.transform(get(m.items), lambda t: _turn(t[role], t[text], m.roles)), empty)
    return F.array(*[_turn(_value(r, get), _value(t, get), m.roles) for r, t in m.turns])


def canonical_json(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, layout, turns) for JSON records of mixed layouts: each row's own paths are hashed and choose its mapping. Rows of no known layout get null turns."""
    record = F.try_parse_json(df[column])
    rows = df.select(df[key].alias(key), record.alias("_v"), F.schema_of_variant(record).alias("_s"))
    names = F.regexp_extract_all("_s", F.lit(r"(?:ARRAY<|OBJECT<|, )*([A-Za-z_]\w*): "), 1)
    in_items = F.regexp_extract("_s", r"^OBJECT<(\w+): ARRAY<OBJECT<", 1)
    paths = F.when(in_items != "", F.transform(F.filter(names, lambda x: x != in_items), lambda x: F.concat(in_items, F.lit("[]."), x))).otherwise(names)
    rows = rows.withColumn("_f", F.sha2(F.array_join(F.array_sort(paths), "\n").cast("binary"), 256))
    turns, layout = F.lit(None).cast(TURN), F.lit(None).cast("string")
    for m in (m for m in MAPPINGS if not m.rows):
        hit = F.col("_f") == fingerprint(m.paths)
        if m.items:
            role, text = m.turns[0]
            items = F.from_json(F.to_json(F.try_variant_get("_v", f"$.{m.items}", "variant")), f"array<struct<`{role}`:string,`{text}`:string>>")
            got = _turns(m, {m.items: items}.get)
        else:
            got = _turns(m, lambda p: F.try_variant_get("_v", f"$.{p}", "string"))
        turns, layout = F.when(hit, got).otherwise(turns), F.when(hit, F.lit(m.name)).otherwise(layout)
    return rows.select(key, layout.alias("layout"), turns.alias("turns"))


def format_turns(df: DataFrame, turns: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """Adds formatted, and loss_mask: (skip, take, rest) in code points for each turn, which takes the escaped texts of ``loss_role``."""
    # A role ends at the first line break, so those inside it are escaped too, and so are the backslashes that mark them.
    role = lambda t: F.replace(F.replace(escape(t["role"]), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    pieces = F.transform(turns, lambda t: F.struct(F.concat(F.lit(START), role(t), F.lit(MID)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss")))
    run = lambda skip, take, rest: F.struct(skip.cast("int").alias("skip"), take.cast("int").alias("take"), rest.cast("int").alias("rest"))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END)
    return (
        df.withColumn("_p", pieces)
        .withColumn("formatted", F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
        .withColumn("loss_mask", F.transform("_p", lambda p: F.when(p["loss"], run(F.length(p["head"]), F.length(p["body"]), F.lit(len(END)))).otherwise(run(size(p), F.lit(0), F.lit(0)))))
        .drop("_p")
    )


def pieces_of(formatted: Column) -> Column:
    """What stands before each end mark."""
    return F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: F.startswith(x, F.lit(START)))


def read_back(formatted: Column) -> Column:
    """The turns that a formatted conversation holds."""
    at = lambda x: F.instr(x, "\n")
    role = lambda x: F.substring(x, F.lit(len(START) + 1), at(x) - 1 - len(START))
    # "\n" first, where its backslash is not itself escaped, then the doubled backslashes.
    plain = lambda r: F.array_join(F.transform(F.split(r, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")
    return F.transform(pieces_of(formatted), lambda x: F.struct(unescape(plain(role(x))).alias("role"), unescape(F.substring(x, at(x) + 1, F.length(x))).alias("text")))


def loss_text(formatted: Column, mask: Column) -> Column:
    """What the mask takes, unescaped and joined."""
    return F.array_join(F.zip_with(pieces_of(formatted), mask, lambda x, m: F.when(m["take"] > 0, unescape(F.substring(x, m["skip"] + 1, m["take"]))).otherwise(F.lit(""))), "")
