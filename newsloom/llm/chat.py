"""Chat formatting: schema fingerprints select declarative mappings.

A record is a JSON object.  The hash of its nested field paths (fields that no
layout knows are left out) picks the layout that turns it into canonical turns.
Every layout is data: where the turns are, or which field speaks for which role.

A turn becomes one self-delimiting segment of the template; control strings in a
role or text are escaped reversibly, so segments join in any number and read
back exactly.  The loss mask covers the text of assistant turns.

Edge cases: null roles and texts are empty; conversation ids are strings, whatever
their JSON type, and a turn that is no whole number is null and comes first; of a
list of content parts the texts are joined, other parts are left out; turns
tie-break by role and text; rows with a null conversation id form one conversation;
repeated rows are repeated turns; extra columns are ignored.  A record with the
fields of several layouts takes the first that fits (n_layouts tells how many do).
A record of no known layout, or that is no JSON object, has no turns; survey()
counts these, by fingerprint."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import over_batches, pick, record

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common templates, escaped inside texts.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """turns: the list field with one object a turn, read by role and text (part: the
    field of each content part that says it); or speakers: (role, fields joined by a
    blank line) in speaking order.  identity and order name the conversation's id and
    a turn's number, of a list the first turn's."""

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    part: str = ""
    speakers: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: frozenset[str] = field(default_factory=frozenset)
    identity: str = "conv_id"
    order: str = "turn"

    def paths(self) -> set[str]:
        if self.turns:
            return {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}" + (f"[].{self.part}" if self.part else "")}
        return {self.role, self.text} - {""} | {f for _, fs in self.speakers for f in fs}


LAYOUTS = (
    Layout("turn_row", role="role", text="text", optional=frozenset({"turn"})),
    Layout("messages", turns="messages", role="role", text="content"),
    Layout("content_parts", turns="messages", role="role", text="content", part="text"),
    Layout("utterances", turns="turns", role="speaker", text="utterance"),
    Layout("conversations", turns="conversations", role="from", text="value"),
    Layout("prompt", speakers=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=frozenset({"system"})),
    Layout("prompt_response", speakers=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=frozenset({"system"})),
    Layout("instruction", speakers=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=frozenset({"system", "input"})),
    Layout("question", speakers=(("user", ("context", "question")), ("assistant", ("answer",))), optional=frozenset({"context"})),
)


def field_paths(value, prefix: str = "") -> set[str]:
    """Nested field paths; list items share the path of their list, marked []."""
    if isinstance(value, dict):
        return set().union(*[field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()])
    if isinstance(value, list):
        return set().union(*[field_paths(v, f"{prefix}[]") for v in value])
    return {prefix}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _known() -> tuple[dict[str, Layout], set[str]]:
    table, every = {}, set()
    for layout in LAYOUTS:
        need = layout.paths() - layout.optional
        every |= layout.paths() | layout.optional
        for n in range(len(layout.optional) + 1):
            for some in itertools.combinations(sorted(layout.optional), n):
                table.setdefault(fingerprint(need | set(some)), layout)
    return table, every


_TABLE, _PATHS = _known()


def layouts_of(value) -> list[Layout]:
    """The layouts that fit, the chosen one first."""
    paths = field_paths(value) & _PATHS
    exact = _TABLE.get(fingerprint(paths))
    # a list with some items that lack a field, or fields of two layouts: the first that fits
    fit = [x for x in LAYOUTS if x.paths() - x.optional <= paths]
    return ([exact] if exact else []) + [x for x in fit if x is not exact]


def _say(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _whole(value) -> int | None:
    """A turn's number, given as a number or in digits."""
    if isinstance(value, bool) or value is None:
        return None
    try:
        number = int(value) if isinstance(value, (int, str)) else int(value) if value == int(value) else None
    except (ValueError, OverflowError, TypeError):
        return None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def _parts(value, part: str) -> str:
    if not part or not isinstance(value, list):
        return _say(value)
    return "".join(_say(x.get(part)) for x in value if isinstance(x, dict))


def canonical(value, layout: Layout) -> list[tuple[int | None, str, str]]:
    """(turn, role, text) of one record."""
    if layout.turns:
        listed = value.get(layout.turns)
        items = [i for i in listed if isinstance(i, dict)] if isinstance(listed, list) else []
        start = _whole(value.get(layout.order)) or 0
        return [(start + n, ROLES.get(r := _say(i.get(layout.role)), r), _parts(i.get(layout.text), layout.part)) for n, i in enumerate(items)]
    if layout.speakers:
        said = [(role, "\n\n".join(_say(value[f]) for f in fields if value.get(f) is not None)) for role, fields in layout.speakers if any(f in value and (value[f] is not None or f not in layout.optional) for f in fields)]
        return [(n, role, text) for n, (role, text) in enumerate(said)]
    return [(_whole(value.get(layout.order)), _say(value.get(layout.role)), _say(value.get(layout.text)))]


def _load(raw: str | None):
    """The JSON object of a record, else None."""
    try:
        value = json.loads(raw or "null")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


_TURN = [("conv_id", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("layout", pa.string()), ("n_layouts", pa.int32())]


def canonical_turns(records: DataFrame, column: str = "record") -> DataFrame:
    """conv_id, turn, role, text, layout, n_layouts from a column of JSON records."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for raw in batch.column(0).to_pylist():
            value = _load(raw)
            fit = layouts_of(value) if value is not None else []
            if fit:
                name = value.get(fit[0].identity)
                rows += [(None if name is None else _say(name), *turn, fit[0].name, len(fit)) for turn in canonical(value, fit[0])]
        return record(_TURN, *(map(list, zip(*rows)) if rows else [[]] * 6))

    return over_batches(pick(records, column), run, "conv_id string, turn long, role string, text string, layout string, n_layouts int")


def survey(records: DataFrame, column: str = "record") -> DataFrame:
    """layout, fingerprint, n: what every record is taken for; layout is null where
    none fits (the fingerprint then covers all its fields) and fingerprint null where
    the record is no JSON object.  Counted in the tasks first."""
    schema = [("layout", pa.string()), ("fingerprint", pa.string()), ("n", pa.int64())]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict = {}
        for raw in batch.column(0).to_pylist():
            value = _load(raw)
            fit = layouts_of(value)[:1] if value is not None else []
            key = (fit[0].name, fingerprint(field_paths(value) & _PATHS)) if fit else (None, None if value is None else fingerprint(field_paths(value)))
            found[key] = found.get(key, 0) + 1
        return record(schema, [k[0] for k in found], [k[1] for k in found], list(found.values()))

    return over_batches(pick(records, column), run, "layout string, fingerprint string, n long").groupBy("layout", "fingerprint").agg(F.sum("n").alias("n"))


_CONTROL = re.compile("|".join(re.escape(c) for c in ("\\", *CONTROLS)))


def escape(text: str) -> str:
    """A backslash doubles; a control string gets one after its first character."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def segment(role: str, text: str) -> str:
    return f"{START}{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}{END}\n"


_SEGMENT = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(END) + "\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each segment."""
    return [(unescape(m[1]), unescape(m[2]), *m.span(2)) for m in _SEGMENT.finditer(formatted)]


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds `formatted`, the segment of each turn, and where its loss mask lies
    (loss_start, loss_end in code points; null if not the assistant's).  Conversation
    ids are strings."""
    schema = [*_TURN[:4], ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, spans = [], []
        for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            out.append(segment(role or "", text or ""))
            end = len(out[-1]) - len(END) - 1
            spans.append((end - len(escape(text or "")), end) if role == "assistant" else (None, None))
        return record(schema, *[batch.column(k) for k in range(4)], out, *map(list, zip(*spans)))

    turns = pick(turns, "conv_id", "turn", "role", "text").withColumn("conv_id", F.col("conv_id").cast("string"))
    return over_batches(turns, run, "conv_id string, turn long, role string, text string, formatted string, loss_start long, loss_end long")


_DIGEST = [("conv_id", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its formatted segments.

    The segments arrive sorted and are hashed as they stream by, so a very long
    conversation is never held as a whole; its digest is one running hash, so its
    segments do pass through one task."""

    def run(batches):
        now, state = None, None

        def close():
            return (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            out = []
            for conv, text, start, end in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(close())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, *_ in read_back(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                if start is not None:
                    masked = unescape(text[start:end])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
            if out:
                yield record(_DIGEST, *map(list, zip(*out)))
        if now is not None:
            yield record(_DIGEST, *([v] for v in close()))

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
