"""Chat formatting: records of any known layout become turns, and turns become one marked-up text.

Schema fingerprinting: the nested field paths of a record (or of a table's schema), in sorted order, are hashed. The
hash selects a declarative mapping, which says where turns, roles and texts lie. A record or table with fields beyond a layout's
takes the layout with the most fields among those that it holds whole. Layouts are only data: ``register`` adds one.

JSON records are parsed to variants, and fingerprints, choice and turns are built-in expressions over those, one for each layout. Only
records beyond that (with a text of 20 million characters or more, a name twice, or nested over MOST_DEPTH deep) are parsed in Python, by the same rules.

The template writes a turn as ``### <role>: <text></turn>`` and a line end. In roles and texts, ``\\``, ``#`` and
``<`` get a ``\\`` before them (in roles ``:`` too), so the marks can't occur inside, and taking one ``\\`` before each
such character away gives the text back. The loss mask covers the texts of the assistant.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN_START, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"
_ESCAPED_TEXT, _ESCAPED_ROLE = re.compile(r"([\\#<])"), re.compile(r"([\\#<:])")
#: Characters that are escaped or unescaped at once.
PIECE = 1 << 16
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


@dataclass(frozen=True)
class Layout:
    """Where a record keeps its turns.

    ``fields``: the paths that make up the layout (``[]`` steps into a list). ``turns``: the list of turns, with
    ``role`` and ``text`` inside it, or None where ``fixed`` gives (role, field) pairs in order; those in ``optional``
    are left out where they are empty. With neither, the record is one turn. ``roles`` renames roles.
    """

    name: str
    fields: tuple[str, ...]
    turns: str | None = None
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, str], ...] = ()
    roles: dict = field(default_factory=dict)
    optional: tuple[str, ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.fields)


def skeleton(paths) -> str:
    """The nested field paths in the form ``OBJECT<a: ARRAY<OBJECT<b, c>>, d>``: names sorted, kinds of plain values left out."""
    tree: dict = {}
    for path in paths:
        at = tree
        for step in re.findall(r"\[\]|[^.\[\]]+", path):
            at = at.setdefault(step, {})

    def written(node: dict) -> str:
        if not node:
            return ""
        if "[]" in node:
            return f"ARRAY<{written(node['[]'])}>"
        return f"OBJECT<{', '.join(f'{k}: {inner}' if (inner := written(node[k])) else k for k in sorted(node))}>"

    return written(tree)


def fingerprint(paths) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256(skeleton(paths).encode("utf-8", "replace")).hexdigest()[:16]


#: The kinds of plain values in the schema of a variant.
_PLAIN_KIND = r"(: |(?<=ARRAY<))(?!OBJECT<|ARRAY<)[A-Z]+(\(\d+,\d+\))?(?=[,>])"


def variant_fingerprint(value: Column) -> Column:
    """The same hash of the field paths of a variant."""
    return F.substring(F.sha2(F.regexp_replace(F.schema_of_variant(value), _PLAIN_KIND, ""), 256), 1, 16)


def value_paths(value, at: str = "") -> Iterator[str]:
    """Paths of the fields of a parsed record."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from value_paths(inner, f"{at}.{key}" if at else str(key))
        if not value and at:
            yield f"{at}."  # an object without fields
    elif isinstance(value, list):
        for inner in value:
            yield from value_paths(inner, f"{at}[]")
        if not value:
            yield f"{at}[]"
    else:
        yield at


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """Paths of the fields of a schema."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    else:
        yield at


_SHARED_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS: dict[str, Layout] = {}


def register(layout: Layout) -> None:
    """Make a layout known."""
    LAYOUTS[layout.fingerprint] = layout


for _layout in (
    Layout("messages", ("messages[].role", "messages[].content"), "messages", "role", "content", roles=_SHARED_ROLES),
    Layout("conversations", ("conversations[].from", "conversations[].value"), "conversations", "from", "value", roles=_SHARED_ROLES),
    Layout("prompt and completion", ("prompt", "completion"), fixed=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", ("prompt", "response"), fixed=(("user", "prompt"), ("assistant", "response"))),
    Layout("question and answer", ("question", "answer"), fixed=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", ("instruction", "output"), fixed=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", ("instruction", "input", "output"), fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Layout("system and prompt", ("system", "prompt", "response"), fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("turn rows", ("conv_id", "turn", "role", "text"), role="role", text="text"),
):
    register(_layout)


def _text(value) -> str:
    if not isinstance(value, (str, type(None))):
        value = json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    return (value or "").encode("utf-8", "replace").decode("utf-8")


def _holds(paths: set[str], name: str) -> bool:
    """Whether a record with these paths has the field; what lies inside it, or an empty list around it, counts."""
    around = name.rfind("[]")
    return any(p == name or p.startswith((f"{name}.", f"{name}[]")) for p in paths) or (around >= 0 and name[: around + 2] in paths)


def layouts_of(paths: set[str], layouts: dict[str, Layout] = LAYOUTS) -> list[Layout]:
    """The layout with the fingerprint of the paths, and then those that the paths hold whole, the largest first."""
    known = [layouts[mark]] if (mark := fingerprint(paths)) in layouts else []
    return known + sorted((x for x in layouts.values() if all(_holds(paths, name) for name in x.fields)), key=lambda x: -len(x.fields))


def record_layout(value, layouts: dict[str, Layout] = LAYOUTS) -> Layout | None:
    """The layout of a parsed record, or None."""
    if not isinstance(value, dict):
        return None
    fits = layouts_of(set(value_paths(value)), layouts)
    return next((x for x in fits if not x.turns or isinstance(value.get(x.turns), list) and all(isinstance(t, dict) for t in value[x.turns])), None)


def record_turns(record: str | None, layouts: dict[str, Layout] = LAYOUTS) -> tuple[str, list[tuple[str, str]] | None]:
    """The layout of a JSON record, or else its fingerprint, or ``not JSON``; and (role, text) of each turn, None without a layout."""
    try:
        value, _ = json.JSONDecoder().raw_decode((record or "").lstrip(" \t\r\n"))
        layout = record_layout(value, layouts)
        if layout is None:
            return fingerprint(value_paths(value)), None
    except (ValueError, RecursionError):
        return NOT_JSON, None
    if layout.fixed:
        return layout.name, [(role, _text(value.get(name))) for role, name in layout.fixed if name not in layout.optional or value.get(name) not in (None, "")]
    turns = value[layout.turns] if layout.turns else [value]
    return layout.name, [(layout.roles.get(_text(t.get(layout.role)), _text(t.get(layout.role))), _text(t.get(layout.text))) for t in turns]


NOT_JSON = "not JSON"
#: Records nested deeper are parsed in Python.
MOST_DEPTH = 100
_OBJECT = "map<string,variant>"
_TURNS = "array<struct<role:string,text:string>>"


def _step(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _inside(value: Column, steps: list[str]) -> Column:
    """Whether a variant holds the field that the steps lead to."""
    if not steps:
        return F.lit(True)
    if steps[0] == "[]":
        inner = F.try_variant_get(value, "$", "array<variant>")
        return F.coalesce((F.size(inner) == 0) | F.exists(inner, lambda x: _inside(x, steps[1:])), F.lit(False))
    there = F.coalesce(F.map_contains_key(F.try_variant_get(value, "$", _OBJECT), steps[0]), F.lit(False))
    return there & _inside(F.try_variant_get(value, _step(steps[0]), "variant"), steps[1:]) if steps[1:] else there


def _text_of(fields: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(F.try_element_at(fields, F.lit(name)), "$", "string"), F.lit(""))


def _fits(value: Column, layout: Layout) -> Column:
    """Whether the turns of a layout are where it says they are."""
    if layout.turns is None:
        return F.map_keys(F.try_variant_get(value, "$", _OBJECT)).isNotNull()
    turns = F.try_variant_get(value, _step(layout.turns), f"array<{_OBJECT}>")
    return F.coalesce(F.forall(turns, lambda t: t.isNotNull()), F.lit(False))


def _turns_of(value: Column, layout: Layout) -> Column:
    """The turns of a variant in a layout, as _TURNS."""
    whole = F.try_variant_get(value, "$", _OBJECT)
    if layout.fixed:
        every = F.array(*[F.struct(F.lit(role).alias("role"), _text_of(whole, name).alias("text"), F.lit(name in layout.optional).alias("skip")) for role, name in layout.fixed])
        kept = F.filter(every, lambda t: ~(t["skip"] & (t["text"] == "")))
        return F.transform(kept, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    renamed = F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair]) if layout.roles else None

    def turn(fields: Column) -> Column:
        role = _text_of(fields, layout.role)
        role = role if renamed is None else F.coalesce(F.try_element_at(renamed, role), role)
        return F.struct(role.alias("role"), _text_of(fields, layout.text).alias("text"))

    turns = F.array(whole) if layout.turns is None else F.try_variant_get(value, _step(layout.turns), f"array<{_OBJECT}>")
    return F.transform(turns, turn)


def json_turns(records: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text, layout, record) of JSON records in mixed layouts.

    A record that isn't JSON or has no known layout gives one row with null turn, role and text, its fingerprint (or ``not JSON``) as
    ``layout`` and itself as ``record``, which is null otherwise; nothing is lost silently. That goes for nulls, empty texts and
    records nested a thousand deep too. A list without turns gives one row with null turn, role and text. Values that aren't texts count
    as their JSON text, halves of surrogate pairs as ``?``; what follows the end of a record is ignored. Repeated rows come back as often as they come, an empty table gives
    an empty result, other columns are ignored.
    """
    layouts = dict(LAYOUTS)  # as they are now; the tasks get this copy

    @F.udf(T.StructType([T.StructField("layout", T.StringType()), T.StructField("turns", T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("role", "text")])))]), useArrow=True)
    def in_python(record):
        return (None, None) if record is None else record_turns(record, layouts)

    value, mark = F.col("value"), F.col("mark")
    fits = {x.name: _fits(value, x) for x in layouts.values()}
    whole = {x.name: F.forall(F.array(*[_inside(value, re.findall(r"\[\]|[^.\[\]]+", f)) for f in x.fields]), lambda y: y) for x in layouts.values()}
    by_size = sorted(layouts.values(), key=lambda x: -len(x.fields))
    chosen = F.coalesce(
        *[F.when((mark == x.fingerprint) & fits[x.name], F.lit(x.name)) for x in layouts.values()],
        *[F.when(whole[x.name] & fits[x.name], F.lit(x.name)) for x in by_size],
    )
    turns = F.coalesce(*[F.when(F.col("layout") == x.name, _turns_of(value, x).cast(_TURNS)) for x in layouts.values()])
    record = F.col(json_column)
    # the first refuses single quotes and the like, the second what is nested deeper than expressions over variants can go
    parsed = F.when(F.try_parse_json(record).isNotNull(), F.from_json(record, T.VariantType(), {"maxNestingDepth": str(MOST_DEPTH)}))
    named = records.select(F.col(id_column).alias("conv_id"), record.alias("record"), parsed.alias("value"))
    named = named.withColumn("mark", variant_fingerprint(value)).withColumn("layout", chosen)
    parsed = named.withColumns({"turns": turns, "other": in_python(F.when(value.isNull(), F.col("record")))})
    found = parsed.select(
        "conv_id",
        F.coalesce("layout", "mark", "other.layout", F.lit(NOT_JSON)).alias("layout"),
        F.coalesce("turns", "other.turns").alias("turns"),
        "record",
    )
    raw = F.when(F.col("turns").isNull(), F.col("record")).alias("record")
    return found.select("conv_id", "layout", raw, F.posexplode_outer("turns").alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("long"), "t.role", "t.text", "layout", "record"
    )


def table_turns(table: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a table, in the layout that the fingerprint of its whole schema selects.

    With columns beyond a layout's, the layout with the most fields among those that the schema holds whole. A table that holds none
    is refused. A layout with one row per turn is read from ``conv_id`` and ``turn``; for the others, a row is a record and ``id_column`` names it.
    """
    fits = layouts_of(set(schema_paths(table.schema)))
    if not fits:
        raise ValueError(f"no layout has the fields {sorted(schema_paths(table.schema))}")
    layout = fits[0]
    if layout.turns is None and not layout.fixed:
        return table.select("conv_id", "turn", F.col(layout.role).alias("role"), F.col(layout.text).alias("text"))
    tops = dict.fromkeys(re.split(r"\[|\.", name)[0] for name in layout.fields)
    value = F.to_variant_object(F.struct(*[F.col(name) for name in tops]))
    turns = table.select(F.col(id_column).alias("conv_id"), F.posexplode(_turns_of(value, layout)).alias("turn", "t"))
    return turns.select("conv_id", F.col("turn").cast("long"), "t.role", "t.text")


def _substituted(pattern: re.Pattern, by: str, text: str) -> str:
    """The pattern's substitution piece by piece, so long texts need no memory for each match. No cut falls behind an odd number of backslashes."""
    out, at = io.StringIO(newline=""), 0
    while at < len(text):
        stop = before = min(at + PIECE, len(text))
        while before > at and text[before - 1] == "\\":
            before -= 1
        stop += (stop - before) % 2 if pattern is _UNESCAPE else 0
        out.write(pattern.sub(by, text[at:stop]))
        at = stop
    return out.getvalue()


def _plain(escaped: str) -> str:
    return _substituted(_UNESCAPE, r"\1", escaped) if "\\" in escaped else escaped


def format_turn(role: str, text: str) -> str:
    """One turn in the template."""
    escaped = _substituted(_ESCAPED_ROLE, r"\\\1", role), _substituted(_ESCAPED_TEXT, r"\\\1", text)
    return f"{TURN_START}{escaped[0]}{ROLE_END}{escaped[1]}{TURN_END}"


def _unescaped(formatted: str, mark: str, at: int) -> int:
    """Where the mark comes next without an escape, that is, behind an even number of backslashes."""
    while (found := formatted.find(mark, at)) >= 0:
        before = found
        while before > at and formatted[before - 1] == "\\":
            before -= 1
        if (found - before) % 2 == 0:
            return found
        at = found + 1
    raise ValueError(f"no {mark!r} behind {at}")


def parse_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Read formatted text back: role, text, and where the escaped text lies."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(TURN_START, at):
            raise ValueError(f"no turn at {at}")
        role = at + len(TURN_START)
        role_end = _unescaped(formatted, ROLE_END, role)
        text = role_end + len(ROLE_END)
        text_end = _unescaped(formatted, TURN_END, text)
        yield _plain(formatted[role:role_end]), _plain(formatted[text:text_end]), text, text_end
        at = text_end + len(TURN_END)


_SEGMENTS = "conv_id long, part long, segment string, loss_start long, loss_end long"
_DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def format_conversations(turns: DataFrame) -> DataFrame:
    """The formatted text of every conversation, one row for each of its turns in order.

    Columns: conv_id, part (0, 1, ... in the conversation), segment (its part of the text), loss_start and loss_end
    (the span of the segment under the loss mask, null outside the assistant's turns). The text of a
    conversation is its segments one after the other.

    Turns are in the order of turn (null first), role, text; repeated rows are turns of their own. A null role or text
    is empty. Rows with a null conv_id form one conversation. The rows of one conversation meet in one task, sorted, and are
    streamed through it one by one; none is held back. Texts of any length are turns; a turn is held as a whole. An empty table
    gives an empty result; other columns, whatever their names, are ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = object(), 0
        for batch in batches:
            columns = batch.to_pydict()
            parts, segments, starts, ends = [], [], [], []
            for conv, role, text in zip(columns["conv_id"], columns["role"], columns["text"]):
                part = part + 1 if conv == before else 0
                before = conv
                segment = format_turn(role, text)
                start = end = None
                if role == "assistant":
                    _, _, start, end = next(parse_turns(segment))
                for column, value in ((parts, part), (segments, segment), (starts, start), (ends, end)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(c, k) for c, k in ((parts, pa.int64()), (segments, pa.string()), (starts, pa.int64()), (ends, pa.int64())))],
                names=["conv_id", "part", "segment", "loss_start", "loss_end"],
            )

    ready = turns.select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    placed = ready.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.mapInArrow(write, _SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted conversations say, read from ``format_conversations``'s rows (grouped and in order, as it returns them).

    Columns: conv_id, n_turns, turns_sha256 (of role, line end, text, line end for each turn), loss_chars and loss_sha256 (all
    text under the loss mask, unescaped), formatted_chars.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # conv_id, turns, their hash, loss characters, their hash, characters
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                segment, start = row["segment"], row["loss_start"]
                if row["part"] == 0:
                    if state is not None:
                        done.append(state)
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse_turns(segment):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    covered = _plain(segment[start : row["loss_end"]])
                    state[3] += len(covered)
                    state[4].update(covered.encode())
                state[5] += len(segment)
            yield _digests(done)
        if state is not None:
            yield _digests([state])

    return segments.mapInArrow(read, _DIGESTS)


def _digests(states: list) -> pa.RecordBatch:
    rows = [(c, n, a.hexdigest(), k, b.hexdigest(), m) for c, n, a, k, b, m in states]
    columns = list(zip(*rows)) if rows else [()] * 6
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)
