"""What a JSON object must hold, said once.

A contract is compiled to a JSON Schema (what a model or caller is told) and to one
Column (the problems of each row's text), so that the two cannot differ.  Types are
read from the parsed value, not from what it could be cast to: a number where a text
belongs is a problem.  Text that does not parse, or repeats a key, is no object."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import CATEGORIES, MESSAGE_STATUSES, PUBLISH_NOW, ROLES, STAGES, SUMMARY_MAX
from .functions.text import col

# By kind: what Spark names the type of a value, what a reader is told, and the JSON Schema.
_KINDS = {
    "text": (r"^STRING$", "a text", {"type": "string"}),
    "whole": (r"^BIGINT$|^DECIMAL\(\d+,0\)$", "a whole number", {"type": "integer"}),
    "flag": (r"^BOOLEAN$", "true or false", {"type": "boolean"}),
    "texts": (r"^ARRAY<(STRING|VOID)>$", "a list of texts", {"type": "array", "items": {"type": "string"}}),
    "tags": (r"^STRING$|^ARRAY<(STRING|VOID)>$", "a text or a list of texts", {"anyOf": [{"type": "string"}, {"type": "array", "items": {"type": "string"}}]}),
    "list": (r"^ARRAY<", "a list", {"type": "array"}),
    "object": (r"^OBJECT<", "an object", {"type": "object"}),
}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "text"
    required: bool = True
    choices: tuple[str, ...] = ()
    least: int | None = None  # characters of a text, entries of a list, or a number
    most: int | None = None
    pattern: str | None = None
    upper: bool = False
    note: str | None = None
    inner: "Contract | None" = None

    def schema(self) -> dict:
        out = dict(_KINDS[self.kind][2]) if self.inner is None else self.inner.schema()
        if self.choices:
            out["enum"] = list(self.choices)
        for bound, value in (("min", self.least), ("max", self.most)):
            if value is not None:
                out[{"text": f"{bound}Length", "whole": f"{bound}imum"}.get(self.kind, f"{bound}Items")] = value
        if self.pattern:
            out["pattern"] = self.pattern
        if self.note:
            out["description"] = self.note
        return out

    def problem(self, value: Column, raw: Column) -> Column:
        """Problems of this field of a variant object, as an array of texts."""
        path = f"$.{self.name}"
        found = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
        says = lambda what: F.array(F.lit(f"{self.name}: {what}"))
        fine = F.array().cast("array<string>")
        pattern, name, _ = _KINDS[self.kind]
        out = F.when(found.isNull(), says("missing") if self.required else fine)
        out = out.when(~found.rlike(pattern), says(f"not {name}"))
        if self.kind == "text":
            text = F.try_variant_get(value, path, "string")
            size, unit = F.length(text), "characters"
            if self.choices:
                out = out.when(~text.isin(*self.choices), says("not one of the known values"))
            if self.pattern:
                out = out.when(~text.rlike(self.pattern), says("not of the known form"))
            if self.upper:
                out = out.when(text != F.upper(text), says("not in capitals"))
        elif self.kind == "whole":
            size, unit = F.try_variant_get(value, path, "bigint"), None
        else:
            size, unit = F.size(F.try_variant_get(value, path, "array<variant>")), "entries"
        for bound, word, bad in ((self.least, "at least", lambda x, b: x < b), (self.most, "at most", lambda x, b: x > b)):
            if bound is not None:
                out = out.when(bad(size, F.lit(bound)), says(" ".join(filter(None, [word, str(bound), unit]))))
        if self.inner is not None:
            inner = self.inner.problems(F.get_json_object(raw, path))
            return out.otherwise(F.transform(inner, lambda p: F.concat(F.lit(f"{self.name}."), p)))
        return out.otherwise(fine)


@dataclass(frozen=True)
class Contract:
    """strict: other fields are a problem; some: one field at least must be there."""

    fields: tuple[Field, ...] = ()
    strict: bool = False
    some: bool = False

    def schema(self) -> dict:
        out: dict = {"type": "object", "properties": {f.name: f.schema() for f in self.fields}, "required": [f.name for f in self.fields if f.required]}
        if self.strict:
            out["additionalProperties"] = False
        if self.some:
            out["minProperties"] = 1
        return out

    def problems(self, raw) -> Column:
        """The problems of a JSON text, in the order of the fields; null counts as an
        empty object."""
        raw = F.coalesce(col(raw), F.lit("{}"))
        value = F.try_parse_json(raw)
        found = [f.problem(value, raw) for f in self.fields]
        keys = F.json_object_keys(raw)
        if self.strict:
            known = F.array(*[F.lit(f.name) for f in self.fields]).cast("array<string>")
            found.append(F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(k, F.lit(": not a known field"))))
        if self.some:
            found.append(F.when(F.size(keys) == 0, F.array(F.lit("nothing to change"))).otherwise(F.array().cast("array<string>")))
        no_object = ~F.coalesce(F.schema_of_variant(value).rlike("^OBJECT<"), F.lit(False))
        return F.when(no_object, F.array(F.lit("not an object"))).otherwise(F.concat(F.array().cast("array<string>"), *found))


@dataclass(frozen=True)
class Choice:
    """Contracts by the value of one text field."""

    by: str
    options: dict[str, Contract]

    def schema(self) -> dict:
        named = lambda name, c: replace(c, fields=(Field(self.by, choices=(name,)), *c.fields)).schema()
        return {"oneOf": [named(name, c) for name, c in self.options.items()]}

    def problems(self, raw) -> Column:
        raw = F.coalesce(col(raw), F.lit("{}"))
        which = F.try_variant_get(F.try_parse_json(raw), f"$.{self.by}", "string")
        out = Contract((Field(self.by, choices=tuple(self.options)),)).problems(raw)
        for name, contract in self.options.items():
            out = F.when(which == name, contract.problems(raw)).otherwise(out)
        return out


# Answers of the models.

ANSWER = Contract((
    Field("title", note="What it is about, in three English words."),
    Field("summary", note=f"The facts in Belarusian, without opinion or conclusions, in {SUMMARY_MAX} characters or less; link tokens stay."),
    Field("country", note="Two-letter ISO-3166 code."),
    Field("location", note="The city or region, in English."),
    Field("category", choices=CATEGORIES, note="One of the listed names."),
    Field("importance", choices=("high", "low"), note="high or low; sports, accidents, curiosities, short-lived and local matters are low."),
    Field("peoples", required=False, note="Names of persons in Latin letters, with commas between."),
    Field("properNames", required=False, note="Places, organisations and events in English, with commas between."),
    Field("tags", "texts", required=False, note="Three to five English tags."),
))

VERDICTS = Contract((Field("verdicts", "list"),))
DIAGNOSIS = Contract((Field("summary"), Field("cause"), Field("fix")))

# Payloads of the stages.

_ITEM_ID, _DATE = r"^[^/]+/\d+$", r"^\d{4}-\d{2}-\d{2}$|^$"
_SCRAPED = (
    Field("id", pattern=_ITEM_ID), Field("body"), Field("links", "list", False), Field("image", required=False), Field("forwardedFrom", required=False),
    Field("date", pattern=_DATE), Field("category", required=False), Field("tags", "tags", False), Field("kind", choices=("post", "forward", "empty", "obsolete")),
)
PAYLOADS = {
    "analyze": Contract(_SCRAPED),
    "aggregate": Contract((*_SCRAPED, Field("title"), Field("summary", most=SUMMARY_MAX), Field("country", upper=True), Field("location"), Field("importance", choices=("high", "low")), Field("peoples", required=False), Field("properNames", required=False))),
    "publish": Contract((Field("messageId", least=1),)),
}

# Inputs of the console's actions, with the least role that may call each.

_ID, _MESSAGE, _STAGE = Field("id", least=1), Field("messageId", pattern=_ITEM_ID), Field("queueName", choices=STAGES)
_ONE_TAG = Field("id", pattern=r"^(?=[^,]*[^\s,])[^,]*$")
_NOTHING = Contract()


def _edit(*fields: Field, id: Field = _ID, some: bool = True) -> Contract:
    return Contract((id, Field("delta", "object", inner=Contract(tuple(replace(f, required=False) for f in fields), strict=True, some=some))))


ACTIONS: dict[str, tuple[str, Contract | Choice]] = {
    **{name: ("viewer", _NOTHING) for name in ("whoami", "overview", "listSources", "listTargets", "listTags", "inspectErrors", "inspectSources")},
    "listMessages": ("viewer", Contract((Field("status", choices=MESSAGE_STATUSES),))),
    "loadMembers": ("viewer", Contract((_MESSAGE,))),
    "loadPosts": ("viewer", Contract((_MESSAGE,))),
    "loadAudit": ("viewer", Contract((replace(_MESSAGE, required=False),))),
    "inspectQueue": ("viewer", Contract((_STAGE,))),
    "inspectItem": ("viewer", Contract((_ID,))),
    "listItems": ("viewer", Contract((replace(_STAGE, required=False), Field("status", required=False, choices=("pending", "running", "done", "error"))))),
    "exportTable": ("viewer", Contract((Field("table", choices=("sources", "messages", "targets")),))),
    "upsertRecord": ("editor", Choice("table", {
        "sources": _edit(Field("status"), Field("category"), Field("tags", "tags"), Field("teaser"), Field("type", choices=("telegram",))),
        "messages": _edit(Field("title"), Field("tags", "tags")),
        "targets": _edit(Field("type", choices=("telegram",)), Field("messageTemplate"), Field("tags", "tags")),
        "tags": _edit(Field("keywords", "tags"), id=_ONE_TAG, some=False),
    })),
    "deleteRecords": ("editor", Contract((Field("table", choices=("sources", "messages", "targets", "tags")), Field("ids", "texts", least=1)))),
    **{name: ("admin", _NOTHING) for name in ("runScraper", "emulateItem", "resetIngest", "resetSourceCursors", "purgeErrors")},
    "republishMessage": ("admin", Contract((_MESSAGE,))),
    "publishPending": ("admin", Contract((Field("max", "whole", least=1, most=PUBLISH_NOW),))),
    "retryErrors": ("admin", Contract((Field("max", "whole", least=1),))),
    "diagnoseError": ("admin", Contract((_ID,))),
    "runStage": ("admin", Contract((_STAGE, Field("max", "whole", False, least=1)))),
    "runItem": ("admin", Contract((_ID,))),
    "editItem": ("admin", Contract((_ID, Field("raw", "object")))),
    "pauseStage": ("admin", Contract((_STAGE, Field("paused", "flag")))),
}


def payload_problems(stage, raw) -> Column:
    """Why a stage cannot work on a payload; empty if it can."""
    out = F.array(F.lit("no such stage"))
    for name, contract in PAYLOADS.items():
        out = F.when(col(stage) == name, contract.problems(raw)).otherwise(out)
    return out


def call_problems(action, role, payload) -> Column:
    """Why a call of an action (its input a JSON text, the caller's highest role) is
    refused; empty if it may run.  The role is looked at first, as the input of what
    one may not call is nobody's business."""
    out = F.array(F.lit("unknown action"))
    rank = F.coalesce(F.array_position(F.lit(list(ROLES)), col(role)), F.lit(0))
    for name, (least, contract) in ACTIONS.items():
        allowed = rank > ROLES.index(least)
        out = F.when(col(action) == name, F.when(allowed, contract.problems(payload)).otherwise(F.array(F.lit("forbidden")))).otherwise(out)
    return out
