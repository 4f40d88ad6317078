"""Descriptors: what a table's columns mean to a search."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

KINDS = ("text", "string", "number", "timestamp")


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    name: str
    column: str
    kind: str
    aliases: tuple[str, ...] = ()
    filters: tuple[str, ...] = ()
    ngram: bool = False
    conversion: bool = False
    #: Set for a bag key: the bag's column and the key as typed.
    bag: str | None = None
    key: str = ""


@dataclass(frozen=True)
class Bag:
    column: str
    prefix: str = ""
    keys: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]
    default: str
    table: str = ""
    bags: tuple[Bag, ...] = ()
    time: str = ""
    severity: str = ""
    source_file: str = ""
    display: tuple[str, ...] = ()
    time_zone: str = ""
    row_key: str = ""
    case_insensitive: bool = True
    notes: tuple[str, ...] = ()

    def declared(self, name: str) -> Field | None:
        low = name.lower()
        return next((f for f in self.fields if low == f.name.lower() or low in map(str.lower, f.aliases)), None)

    def lookup(self, name: str) -> Field | None:
        """Declared field or alias, then a prefixed bag, then the catch-all bag."""
        if found := self.declared(name):
            return found
        head, _, rest = name.partition(".")
        for bag in self.bags:
            if rest and head.lower() in {x.lower() for x in (bag.prefix, bag.column) if x}:
                return self._key(bag, rest)
        bag = next((b for b in self.bags if not b.prefix), None)
        return self._key(bag, name) if bag else None

    def _key(self, bag: Bag, key: str) -> Field:
        return Field(key, bag.column, bag.keys.get(key, "string"), bag=bag.column, key=key)

    def display_fields(self) -> tuple[Field, ...]:
        names = self.display or tuple(x for x in (self.time, self.severity, self.default) if x)
        return tuple(self.declared(n) for n in dict.fromkeys(names))

    def describe(self) -> str:
        lines = [f"table {self.table or '-'}; default {self.default}; time {self.time or '-'}; severity {self.severity or '-'}"]
        lines += [f"{f.name} {f.kind} {f.column}" + (f" ({', '.join(f.aliases)})" if f.aliases else "") for f in self.fields]
        lines += [f"bag {b.column}" + (f" prefix {b.prefix}" if b.prefix else "") for b in self.bags]
        return "\n".join([*lines, *(f"note: {n}" for n in self.notes)])


_KEYS = {"table", "default", "time", "severity", "source_file", "display", "time_zone", "row_key", "case_insensitive", "fields", "bags", "variant", "indexes", "name", "description"}


def load(source: str | dict) -> Schema:
    """A schema from descriptor JSON; SchemaError says what is wrong with it."""
    spec = json.loads(source) if isinstance(source, str) else source
    if unknown := set(spec) - _KEYS:
        raise SchemaError(f"unknown keys: {', '.join(sorted(unknown))}")
    notes: list[str] = []
    where: dict[str, dict] = {}
    ngrams: set[str] = set()
    for index in spec.get("indexes", []):
        if not index.get("name") or not index.get("columns"):
            raise SchemaError("an index needs a name and columns")
        if index.get("kind", "inverted") not in ("inverted", "ngram"):
            raise SchemaError(f"index {index['name']}: unknown kind {index['kind']}")
        for column in index["columns"]:
            if index.get("kind") == "ngram":
                ngrams.add(column)
            elif column in where:
                raise SchemaError(f"column {column} is in two inverted indexes")
            else:
                where[column] = index
        notes += [f"filter {x} of index {index['name']} is not modelled" for x in index.get("filters", []) if x not in ("english_stop", "english_stemmer")]
    bags, prefixes = [], set()
    # ``variant`` is the short form of one bag.
    for bag in spec.get("bags") or ([{"column": spec["variant"]}] if spec.get("variant") else []):
        if not bag.get("column"):
            raise SchemaError("a bag needs a column")
        prefix = bag.get("prefix", "")
        if bag["column"] in {b.column for b in bags}:
            raise SchemaError(f"bag {bag['column']} is declared twice")
        if prefix and prefix.lower() in prefixes:
            raise SchemaError(f"prefix {prefix} is declared twice")
        prefixes.add(prefix.lower())
        for key, kind in bag.get("keys", {}).items():
            if kind not in KINDS:
                raise SchemaError(f"bag key {key}: unknown kind {kind}")
            if kind == "text":
                raise SchemaError(f"bag key {key} cannot be text")
        bags.append(Bag(bag["column"], prefix, dict(bag.get("keys", {}))))
    notes += [f"prefix {b.prefix} is also a bag's column" for b in bags if b.prefix and b.prefix in {x.column for x in bags}]
    if not bags:
        notes.append("no bag: every field has to be declared")
    if sum(not b.prefix for b in bags) > 1:
        notes.append("more than one catch-all bag: only the first is searched")
    if not spec.get("fields"):
        raise SchemaError("no fields")
    fields, names = [], set()
    for f in spec["fields"]:
        name, kind = f.get("name"), f.get("kind")
        if not name:
            raise SchemaError("a field needs a name")
        if kind not in KINDS:
            raise SchemaError(f"field {name}: unknown kind {kind}")
        column = f.get("column", name)
        if kind == "text" and column not in where:
            raise SchemaError(f"text field {name} has no inverted index")
        for n in (name, *f.get("aliases", [])):
            if n.lower() in names:
                raise SchemaError(f"name {n} is declared twice")
            names.add(n.lower())
        if re.search(r"(?i)\b(try_)?cast\s*\(|::", column) and not f.get("conversion"):
            notes.append(f"field {name} casts but does not say conversion")
        fields.append(Field(name, column, kind, tuple(f.get("aliases", [])), tuple(where.get(column, {}).get("filters", [])) if kind == "text" else (), column in ngrams, bool(f.get("conversion"))))
    schema = Schema(tuple(fields), spec.get("default", ""), spec.get("table", ""), tuple(bags), spec.get("time", ""), spec.get("severity", ""), spec.get("source_file", ""), tuple(spec.get("display", [])), spec.get("time_zone", ""), spec.get("row_key", ""), spec.get("case_insensitive", True))
    default = schema.declared(schema.default)
    if not default or default.kind != "text":
        raise SchemaError("the default field must be a declared text field")
    if schema.time:
        if not (time := schema.declared(schema.time)) or time.kind != "timestamp":
            raise SchemaError("the time role must be a declared timestamp field")
    else:
        notes.append("no time role: results are not ordered")
    if not schema.severity:
        notes.append("no severity role")
    elif not schema.declared(schema.severity):
        raise SchemaError("the severity role is not declared")
    if schema.source_file and ((f := schema.declared(schema.source_file)) is None or f.kind not in ("text", "string")):
        raise SchemaError("the source_file role must be a declared text or string field")
    if schema.time_zone and not re.fullmatch(r"[+-](?:0\d|1[0-4]):[0-5]\d", schema.time_zone):
        raise SchemaError("time_zone must be an offset such as +08:00")
    if len({where[f.column]["name"] for f in fields if f.kind == "text"}) > 1:
        raise SchemaError("text fields are spread over more than one inverted index")
    if missing := [n for n in schema.display if not schema.declared(n)]:
        raise SchemaError(f"display names undeclared fields: {', '.join(missing)}")
    if not schema.table:
        notes.append("no table")
    from dataclasses import replace

    return replace(schema, notes=tuple(notes))


# The presets of the collector's table.
_STRINGS = ("component", "level", "namespace", "pod", "node")
_ROLES = {"table": "logs.k8s_logs", "row_key": "_row_id", "time": "ts", "severity": "level", "source_file": "source_file", "variant": "kv", "case_insensitive": True}
_ENGLISH = {"tokenizer": "english", "filters": ["english_stop", "english_stemmer"]}
_COMMON = [{"name": "msg", "kind": "text", "aliases": ["message"]}, {"name": "ts", "kind": "timestamp", "aliases": ["timestamp"]}, *({"name": n, "kind": "string"} for n in _STRINGS)]
PRESETS = {
    "k8s-logs": _ROLES
    | {
        "default": "msg", "display": ["ts", "level", "component", "pod", "node", "source_file", "msg"],
        "indexes": [{"name": "idx_msg", "kind": "inverted", "columns": ["msg"], **_ENGLISH}, {"name": "idx_msg_ng", "kind": "ngram", "columns": ["msg"]}],
        "fields": [*_COMMON, {"name": "source_file", "kind": "string"}],
    },
    "k8s-logs-line": _ROLES
    | {
        "default": "line", "display": ["ts", "level", "component", "pod", "node", "source_file", "line"],
        "indexes": [{"name": "idx_msg", "kind": "inverted", "columns": ["msg", "line", "kv", "source_file"], **_ENGLISH}, {"name": "idx_msg_ng", "kind": "ngram", "columns": ["msg", "line"]}],
        "fields": [
            {"name": "line", "kind": "text", "aliases": ["body"]}, *_COMMON,
            {"name": "source_file", "kind": "text", "aliases": ["file"]}, {"name": "raw", "kind": "string"},
        ],
    },
}


def preset(name: str) -> Schema:
    if name not in preset_names():
        raise SchemaError(f"unknown preset {name}; there are {', '.join(preset_names())}")
    return load(PRESETS[name])


def preset_names() -> tuple[str, ...]:
    return tuple(PRESETS)
