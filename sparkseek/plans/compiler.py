"""Syntax tree and schema to a Boolean column, with warnings.

A predicate never yields null under a negation, so a search and its negation
always partition the table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import casts, text
from .grammar import And, Bound, Not, Or, Term, parse
from .schema import Field, Schema


class CompileError(ValueError):
    pass


@dataclass
class Compiled:
    predicate: Column
    warnings: list[str] = field(default_factory=list)
    #: (column, token or fuzzy pattern, boost) of each ranked clause; empty: no score.
    ranked: list[tuple[Field, str, float]] = field(default_factory=list)
    uses_text: bool = False


_FILE = re.compile(r"([A-Za-z0-9_*?\-]+(?:\.[A-Za-z0-9_\-]+)*)\.([A-Za-z]+)(?::([0-9*?]+))?\Z")


def is_source_file(value: str) -> bool:
    """``name.ext``, or ``name.ext:12`` with wildcards in the line number only."""
    m = _FILE.match(value)
    return bool(m) and not re.search(r"[*?]", m[1])


def _like(value: str) -> str:
    out = re.sub(r"([\\%_])", r"\\\1", value)
    return out.replace("*", "%").replace("?", "_")


class _Compiler:
    def __init__(self, schema: Schema):
        self.schema = schema
        self.out = Compiled(F.lit(True))

    def warn(self, message: str) -> None:
        if message not in self.out.warnings:
            self.out.warnings.append(message)

    def node(self, node) -> Column:
        if node is None:
            return F.lit(True)
        if isinstance(node, (And, Or)):
            parts = [self.node(p) for p in node.parts]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node, And) else out | p
            return out
        if isinstance(node, Not):
            return ~F.coalesce(self.node(node.part), F.lit(False))
        return self.bound(node) if isinstance(node, Bound) else self.term(node)

    def resolve(self, name: str) -> Field:
        found = self.schema.lookup(name) if name else self.schema.declared(self.schema.default)
        if found is None:
            raise CompileError(f"unknown field {name}")
        return found

    def names_a_field(self, name: str) -> bool:
        """A declared field, a bag's column or prefix, or a declared key."""
        head = name.split(".")[0].lower()
        bags = {x.lower() for b in self.schema.bags for x in (b.column, b.prefix) if x}
        return bool(name) and (self.schema.declared(name) is not None or head in bags or any(name in b.keys for b in self.schema.bags))

    def column(self, f: Field) -> Column:
        """The field's value; a bag key is looked up flat, then as a path."""
        alike = [k for b in self.schema.bags if b.column == f.bag for k in b.keys if k != f.key and k.lower() == f.key.lower()]
        if alike:
            self.warn(f"bag keys keep their case: {f.key} is not the declared {alike[0]}")
        if f.bag is None:
            return F.expr(f.column)
        value = F.coalesce(*[F.try_variant_get(self.bag(f), p, "string") for p in _paths(f.key)])
        return casts.to_number(value) if f.kind == "number" else value

    def bag(self, f: Field) -> Column:
        return F.try_parse_json(F.col(f.column).cast("string"))

    def folded(self, value: Column) -> Column:
        return F.lower(value) if self.schema.case_insensitive else value

    def fold(self, value: str) -> str:
        return value.lower() if self.schema.case_insensitive else value

    def term(self, t: Term) -> Column:
        if t.operator_word:
            self.warn(f"{t.value} is searched for as a word")
        if t.kind == "word" and self.schema.source_file and not self.names_a_field(t.field):
            whole = f"{t.field}:{t.value}" if t.field else t.value
            if is_source_file(whole):
                return self.source_file(replace(t, field="", value=whole))
        f = self.resolve(t.field)
        if t.kind == "exists":
            return self.exists(f)
        if t.boost is not None and f.kind != "text":
            raise CompileError(f"{f.name} is not a text field and cannot be boosted")
        if t.kind == "regex":
            return self.regex(f, t.value)
        if f.kind == "text":
            return self.text(f, t)
        if f.kind == "timestamp":
            raise CompileError(f"{f.name} is a timestamp: give a range")
        if f.kind == "number":
            if t.wildcard:
                self.warn(f"wildcards are ignored on the number {f.name}")
            value = casts.number(t.value.replace("*", "").replace("?", "") if t.wildcard else t.value)
            if value is None:
                raise CompileError(f"{t.value} is not a number")
            return self.column(f) == F.lit(value)
        if t.fuzzy is not None:
            self.warn(f"{f.name} is not a text field: matched exactly")
        column = self.folded(self.column(f).cast("string"))
        if t.wildcard:
            return column.like(_like(self.fold(t.value)))
        return column == self.fold(t.value)

    def exists(self, f: Field) -> Column:
        if f.bag is not None:
            return F.coalesce(*[F.try_variant_get(self.bag(f), p, "variant") for p in _paths(f.key)]).isNotNull()
        column = F.expr(f.column)
        return column.isNotNull() & (column != "") if f.kind in ("text", "string") else column.isNotNull()

    def regex(self, f: Field, pattern: str) -> Column:
        if f.kind in ("number", "timestamp"):
            raise CompileError(f"{f.name} is a {f.kind}: no regular expression")
        session = SparkSession.getActiveSession()
        if session is not None:
            try:  # on one row, wherever the session's engine is
                session.range(1).select(F.lit("").rlike("(?i)" + pattern)).first()
            except PySparkException:
                raise CompileError(f"bad regular expression {pattern}") from None
        self.warn("a regular expression reads every row")
        return self.column(f).rlike("(?i)" + pattern)

    def text(self, f: Field, t: Term) -> Column:
        self.out.uses_text = True
        analyzer = text.Analyzer(f.filters)
        column = F.expr(f.column)
        if t.wildcard:
            return self.wildcard(f, column, t.value)
        if t.kind == "phrase" and "*" in t.value:
            self.warn("a star in quotes is punctuation")
        every, query = text.words(t.value), analyzer.query(t.value)
        if t.kind == "word" and len(every) == 1 and not query:
            self.warn(f"{t.value} is a stop word: searched for between word ends")
            return text.word_bounded(column, every[0])
        literal = F.coalesce(F.lower(column).contains(t.value.lower()), F.lit(False))
        if not every:
            return literal if t.value.strip() else F.lit(False)
        if not query:
            self.warn("only stop words: searched for as they are")
            return literal
        if t.fuzzy and t.kind == "word":
            if t.boost is not None:
                self.warn("a boost has no effect on a fuzzy term")
            return text.has_fuzzy_run(analyzer.column(column), query, t.fuzzy)
        for _, token in query:
            self.out.ranked.append((f, token, 1.0 if t.boost is None else t.boost))
        # Only texts that hold the words at all are cut into tokens.
        wanted = [token for _, token in query]
        tokens = F.when(analyzer.may_hold(column, wanted), analyzer.column(column, wanted))
        if len(query) == 1:
            hit = text.has_token(tokens, query[0][1])
            if len(every) > 1:
                self.warn("all but one word are stop words: the text is searched for as well")
                return hit & literal
            return hit
        return text.has_near(tokens, query, t.fuzzy or 0)

    def wildcard(self, f: Field, column: Column, value: str) -> Column:
        low = value.lower()
        if re.fullmatch(r"[a-z0-9*?]+", low):
            self.warn("a wildcard matches within one word")
            return text.word_bounded(column, low.replace("*", "[a-z0-9]*").replace("?", "[a-z0-9]"))
        self.warn("a wildcard across words matches anywhere in the text" + ("" if f.ngram else "; no ngram index helps"))
        return F.coalesce(F.lower(column).like(f"%{_like(low)}%"), F.lit(False))

    def source_file(self, t: Term) -> Column:
        """A file name or position: the role holds it, or the default text does."""
        self.warn(f"{t.value} is searched for as a source file")
        role = self.resolve(self.schema.source_file)
        value, has_line = t.value.lower(), ":" in t.value
        columns = [role] + ([self.resolve("")] if role.kind == "text" else [])
        if t.fuzzy is not None and has_line:
            self.warn("a position is matched exactly")
        elif t.fuzzy is not None and role.kind == "text":
            # An approximate name: either column may hold it.
            out = F.lit(False)
            for f in columns:
                out = out | self.text(f, replace(t, value=t.value, kind="word"))
            return out
        elif t.fuzzy is not None:
            self.warn(f"{role.name} is not a text field: matched exactly")
        body = re.escape(value).replace(r"\*", "[0-9]*").replace(r"\?", "[0-9]")
        after = "(?![0-9])" if has_line else r"(?![a-z0-9_\-]|\.[a-z0-9])"
        pattern = rf"(^|[^a-z0-9_.\-]){body}{after}"
        out = F.lit(False)
        for f in columns:
            low = F.lower(F.expr(f.column))
            # The name without wildcards is looked for first, which is cheap.
            held = low.contains(re.match(r"[^*?]*", value)[0]) & low.rlike(pattern)
            out = out | F.coalesce(held, F.lit(False))
        return out

    def bound(self, b: Bound) -> Column:
        f = self.resolve(b.field)
        if b.low is None and b.high is None:
            return self.exists(f)
        if f.kind == "text":
            raise CompileError(f"{f.name} is a text field and has no order")
        ends = [x for x in (b.low, b.high) if x]
        column = self.column(f)
        if f.kind == "timestamp":
            found = [casts.instant(v, self.schema.time_zone) for v, _ in ends]
            if None in found:
                raise CompileError(f"{f.name} needs a complete date, or date and clock")
            values = [F.lit(v).cast("timestamp") for v in found]
            if f.conversion:
                self.warn(f"values of {f.name} that do not convert are left out; count them with ({f.column}) IS NULL")
        else:
            numbers = [casts.number(v) for v, _ in ends]
            if None not in numbers:
                values = [F.lit(n) for n in numbers]
                if f.kind != "number":
                    self.warn(f"values of {f.name} that are no numbers are left out")
                    column = casts.to_number(column.cast("string"))
            elif f.kind == "number":
                raise CompileError(f"{f.name} needs numbers")
            else:
                self.warn(f"{f.name} is compared as text, upper case before lower")
                values = [F.lit(v) for v, _ in ends]
        out = F.lit(True)
        for (_, inclusive), value, low in zip(ends, values, [True, False] if b.low else [False], strict=False):
            side = (column >= value if inclusive else column > value) if low else (column <= value if inclusive else column < value)
            out = out & side
        return out


def _paths(key: str) -> list[str]:
    quote = lambda k: "$['" + k.replace("'", "\\'") + "']"
    flat = quote(key)
    return [flat, "$" + "".join(quote(k)[1:] for k in key.split("."))] if "." in key else [flat]


def _rankable(node) -> list[Term]:
    """Bare positive text clauses; a disjunction counts if all its branches do."""
    if isinstance(node, Term):
        return [node]
    if isinstance(node, And):
        return [t for p in node.parts if not isinstance(p, (Not, Bound)) for t in _rankable(p)]
    if isinstance(node, Or):
        branches = [_rankable(p) for p in node.parts]
        return [t for b in branches for t in b] if all(branches) else []
    return []


def compile_query(query: str, schema: Schema) -> Compiled:
    """The predicate of a search; CompileError says why it cannot be one."""
    tree = parse(query)
    compiler = _Compiler(schema)
    predicate = compiler.node(tree)
    ranks = _Compiler(schema)
    plain = True
    for t in _rankable(tree) if tree is not None else []:
        before = len(ranks.out.ranked)
        ranks.term(t)
        plain &= len(ranks.out.ranked) > before or not isinstance(tree, Or)
    compiler.out.ranked = ranks.out.ranked if plain else []
    compiler.out.predicate = F.coalesce(predicate, F.lit(False))
    if not compiler.out.ranked and tree is not None:
        if not compiler.out.uses_text:
            why = "no term is searched for in text"
        elif all(isinstance(p, Not) for p in (tree.parts if isinstance(tree, And) else (tree,))):
            why = "there are exclusions alone"
        else:
            why = "text stands beside other terms in a disjunction, or is matched without an index"
        compiler.warn(f"nothing to rank: {why}, and every score is 0")
    return compiler.out


def warning_comment(warnings: list[str]) -> str:
    """The warnings as one SQL comment that none of their characters can end."""
    safe = [re.sub(r"\s+", " ", w).replace("*/", "* /").replace("/*", "/ *") for w in warnings]
    return f"/* search: {'; '.join(safe)} */" if safe else ""
