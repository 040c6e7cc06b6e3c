"""Chat formatting: layouts are recognised by a fingerprint of their nested field paths.

A layout's fingerprint is the hash of its sorted field paths (arrays written as ``[]``). It selects a
declarative mapping, a few column expressions that turn prompt, instruction or message layouts into
canonical turns (role, text). Turns are then joined into one text by a template whose control
strings cannot occur inside a turn. All of it is column expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template's control strings.
OPEN, CLOSE = "<|turn|>", "<|end|>"
TURNS = "array<struct<role:string,text:string>>"


def field_paths(kind: T.DataType, prefix: str = "") -> Iterator[str]:
    """Paths of the leaves, in lower case: ``messages[].role``."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from field_paths(f.dataType, f"{prefix}.{f.name.lower()}" if prefix else f.name.lower())
    elif isinstance(kind, T.ArrayType):
        yield from field_paths(kind.elementType, prefix + "[]")
    else:
        yield prefix


def fingerprint(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _turn(role: Column | str, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).cast("string").alias("role"), text.cast("string").alias("text"))


def _present(turns: Column) -> Column:
    """Without the turns whose text is null: an optional field that a row lacks."""
    return F.filter(turns, lambda t: t["text"].isNotNull())


def _role(role: Column) -> Column:
    """Names that layouts use for the three roles; others stay as they are."""
    low = F.lower(role)
    return F.when(low.isin("human", "user", "prompter"), "user").when(low.isin("gpt", "assistant", "bot", "model"), "assistant").otherwise(role)


#: Gives the column of a top-level field by its name.
Fields = Callable[[str], Column]


def _listed(column: str, role: str, text: str) -> Callable[[Fields], Column]:
    return lambda at: F.transform(at(column), lambda m: _turn(_role(m[role]), m[text]))


def _paired(**roles: str) -> Callable[[Fields], Column]:
    """One turn a role, from the field named for it."""
    return lambda at: _present(F.array(*(_turn(role, at(field)) for role, field in roles.items())))


def _instruction(at: Fields) -> Column:
    extra = F.when(F.coalesce(at("input"), F.lit("")) != "", F.concat(F.lit("\n\n"), at("input"))).otherwise("")
    return _present(F.array(_turn("user", F.concat(at("instruction"), extra)), _turn("assistant", at("output"))))


#: field paths of a layout -> its mapping to turns. Rows of a table with one row a turn are grouped first.
MAPPINGS: dict[tuple[str, ...], Callable[[Fields], Column]] = {
    ("messages[].content", "messages[].role"): _listed("messages", "role", "content"),
    ("messages[].role", "messages[].text"): _listed("messages", "role", "text"),
    ("conversations[].from", "conversations[].value"): _listed("conversations", "from", "value"),
    ("prompt", "response"): _paired(user="prompt", assistant="response"),
    ("completion", "prompt"): _paired(user="prompt", assistant="completion"),
    ("prompt", "response", "system"): _paired(system="system", user="prompt", assistant="response"),
    ("input", "instruction", "output"): _instruction,
    ("instruction", "output"): _paired(user="instruction", assistant="output"),
    ("answer", "question"): _paired(user="question", assistant="answer"),
}
BY_FINGERPRINT = {fingerprint(paths): make for paths, make in MAPPINGS.items()}
ROW_PER_TURN = fingerprint(("role", "text", "turn"))


def canonical(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns) from a table of any known layout; other columns than the layout's are ignored.

    The layout is the largest known set of field paths among those of the columns. A table with one
    row a turn is grouped by ``key`` and ordered by turn (then role and text, nulls first); in it a
    null text is empty. Raises ValueError for an unknown layout.
    """
    own = {p for f in df.schema.fields if f.name != key for p in field_paths(f.dataType, f.name.lower())}
    fits = [paths for paths in [("role", "text", "turn"), *MAPPINGS] if own >= set(paths)]
    if not fits:
        raise ValueError(f"no mapping for the layout {sorted(own)} ({fingerprint(own)})")
    found = fingerprint(max(fits, key=len))
    if found != ROW_PER_TURN:
        return df.select(key, F.coalesce(BY_FINGERPRINT[found](F.col), F.array().cast(TURNS)).alias("turns"))
    rows = df.select(key, "turn", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    listed = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy(key).agg(F.transform(listed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def canonical_json(df: DataFrame, record: str, key: str = "conv_id") -> DataFrame:
    """(key, fingerprint, turns) from a column of JSON records of mixed layouts.

    Each record's field paths are read from its own variant schema; records that no mapping fits,
    null and malformed ones have null turns.
    """
    rows = df.select(key, F.try_parse_json(F.col(record)).alias("_v")).withColumn("_s", F.schema_of_variant("_v"))
    out = F.lit(None).cast(TURNS)
    print_ = F.lit(None).cast("string")
    text = F.col("_v").cast("string")
    for paths, make in MAPPINGS.items():
        # the variant's schema names fields in order, so its form is known for each layout
        hit = F.regexp_replace(F.col("_s"), "\\b(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DECIMAL\\(\\d+,\\d+\\))", "*") == F.lit(_shape(paths))
        record_ = F.from_json(text, _schema_of(paths))
        mapped = make(record_.getField)
        out, print_ = F.when(hit, mapped).otherwise(out), F.when(hit, F.lit(fingerprint(paths))).otherwise(print_)
    return rows.select(key, print_.alias("fingerprint"), out.alias("turns"))


def _schema_of(paths: Sequence[str]) -> str:
    lists: dict[str, list[str]] = {}
    for p in paths:
        head, _, tail = p.partition("[].")
        lists.setdefault(head, []).extend([tail] if tail else [])
    return ", ".join(f"`{h}` " + (f"array<struct<{', '.join(f'`{t}`: string' for t in tails)}>>" if tails else "string") for h, tails in lists.items())


def _shape(paths: Sequence[str]) -> str:
    lists: dict[str, list[str]] = {}
    for p in sorted(paths):
        head, _, tail = p.partition("[].")
        lists.setdefault(head, []).extend([tail] if tail else [])
    return "OBJECT<" + ", ".join(f"{h}: " + (f"ARRAY<OBJECT<{', '.join(f'{t}: *' for t in tails)}>>" if tails else "*") for h, tails in sorted(lists.items())) + ">"


def escaped(text: Column) -> Column:
    """No control string can occur in the result; ``unescaped`` undoes it exactly.

    Every backslash gets a 0 behind it, so that a backslash with another digit is this function's own.
    """
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit("<|"), F.lit("<\\1|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\1|"), F.lit("<|")), F.lit("\\0"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("\\2"))


def formatted(conversations: DataFrame, key: str = "conv_id", train: str = "assistant") -> DataFrame:
    """(key, formatted, loss) from canonical turns.

    ``formatted`` is every turn as the opening string, role, line feed, text and closing string.
    ``loss`` lists the spans to train on as (turn, start, length) in code points after the turn's
    opening string: the texts of the role ``train``. Null roles and texts count as empty; no turns
    give an empty text.
    """
    text = lambda t: escaped(F.coalesce(t["text"], F.lit("")))
    parts = F.transform("turns", lambda t: F.concat(F.lit(OPEN), _escaped_role(t["role"]), F.lit("\n"), text(t), F.lit(CLOSE)))
    spans = F.transform(
        "turns", lambda t, i: F.struct(i.alias("turn"), (F.length(_escaped_role(t["role"])) + 1).alias("start"), F.length(text(t)).alias("length"), (t["role"] == train).alias("on")))
    spans = F.transform(F.filter(spans, lambda s: s["on"]), lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["length"].alias("length")))
    return conversations.select(key, F.array_join(parts, "").alias("formatted"), spans.alias("loss"))


def parsed(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns, loss_text) read back from ``formatted`` and its loss spans alone."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 1 << 30)
    body = lambda p: F.substring(p, F.lit(1), F.length(p) - len(CLOSE))
    turn = lambda b: F.struct(
        unescaped(F.replace(F.substring_index(b, "\n", 1), F.lit("\\2"), F.lit("\n"))).alias("role"),
        unescaped(F.substring(b, F.instr(b, "\n") + 1, F.length(b))).alias("text"))
    masked = F.transform("loss", lambda s: unescaped(F.substring(F.element_at(F.col("_p"), s["turn"] + 1), s["start"] + 1, s["length"])))
    return chats.withColumn("_p", pieces).select(
        key, F.transform("_p", lambda p: turn(body(p))).alias("turns"), F.array_join(masked, "").alias("loss_text"), F.length("formatted").alias("formatted_chars"))
