"""The timeline filter language as Spark Columns.

``compile_query(df, "level=error AND NOT host:web msg~/time ?out/i")`` gives a Boolean Column that is never null, so
Catalyst sees an ordinary filter. Terms: a bare word (text anywhere in the row, letter case ignored), ``field:text``
(contains, case ignored), ``field=text`` and ``field!=text`` (exact), ``field~/regex/flags``, ``field<number`` and the
like (numbers, or times in milliseconds), ``field IN (a, b)``, ``field NOT IN (...)``, ``is:sus`` and ``is:detection``;
joined by ``AND`` (or just a space), ``OR``, ``NOT`` and parentheses.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.coerce import number, text_of
from strandline.functions.timeparse import column_millis

ANY = "*"
MAX_PATTERN = 1024


class QuerySyntaxError(ValueError):
    def __init__(self, message: str, at: int):
        super().__init__(f"{message} (column {at + 1})")
        self.at = at


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Everything(Node):
    pass


@dataclass(frozen=True)
class Anywhere(Node):
    needle: str


@dataclass(frozen=True)
class Flag(Node):
    name: str


@dataclass(frozen=True)
class Test(Node):
    """``op`` is one of : = != ~ < <= > >=."""

    field: str
    op: str
    value: str
    flags: str = ""
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Member(Node):
    field: str
    values: tuple[str, ...]
    negated: bool = False
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Not(Node):
    item: Node


@dataclass(frozen=True)
class And(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    items: tuple[Node, ...]


_LEX = re.compile(
    r"""(?P<space>\s+)|(?P<open>\()|(?P<close>\))|"(?P<quoted>(?:\\.|[^"\\])*)"|\[(?P<bracket>[^\]]*)\]
    |(?P<op>>=|<=|!=|:=|:!|[:=~<>,])|(?P<word>[^\s()"\[\]](?:(?!>=|<=|!=|:=|:!|[:=~<>,])[^\s()"\[\]])*)|(?P<bad>.)""",
    re.VERBOSE | re.DOTALL,
)
_REGEX = re.compile(r"/((?:\\.|[^/\\])*)/([a-z]*)", re.DOTALL)
_KEYWORDS = ("AND", "OR", "NOT", "IN")
_OPS = {":": ":", "=": "=", ":=": "=", "!=": "!=", ":!": "!=", "~": "~", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


@dataclass
class _Token:
    kind: str
    text: str
    at: int
    flags: str = ""


def _tokens(source: str) -> list[_Token]:
    out: list[_Token] = []
    at = 0
    while at < len(source):
        # a regex stands only right after ~
        if out and out[-1].kind == "op" and out[-1].text == "~" and (m := _REGEX.match(source, at)):
            out.append(_Token("regex", m[1].replace("\\/", "/"), at, m[2]))
        else:
            m = _LEX.match(source, at)
            kind = m.lastgroup
            if kind == "bad":
                raise QuerySyntaxError("unterminated string" if m[0] == '"' else f"unexpected {m[0]!r}", at)
            if kind == "quoted":
                out.append(_Token("text", re.sub(r"\\(.)", r"\1", m["quoted"], flags=re.DOTALL), at))
            elif kind == "bracket":
                out.append(_Token("text", m["bracket"], at))
            elif kind == "word":
                out.append(_Token("keyword" if m[0].upper() in _KEYWORDS else "text", m[0], at))
            elif kind != "space":
                out.append(_Token(kind, m[0], at))
        at = m.end()
    return out


class _Reader:
    def __init__(self, source: str):
        self.tokens, self.at, self.end = _tokens(source), 0, len(source)

    def peek(self, ahead: int = 0) -> _Token:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else _Token("end", "", self.end)

    def take(self) -> _Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def is_word(self, word: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t.kind == "keyword" and t.text.upper() == word

    def expect(self, kind: str, what: str) -> _Token:
        if self.peek().kind != kind:
            raise QuerySyntaxError(f"expected {what}", self.peek().at)
        return self.take()

    def either(self) -> Node:
        items = [self.both()]
        while self.is_word("OR"):
            self.take()
            items.append(self.both())
        return items[0] if len(items) == 1 else Or(tuple(items))

    def both(self) -> Node:
        items = [self.single()]
        while self.peek().kind not in ("end", "close") and not self.is_word("OR"):
            if self.is_word("AND"):
                self.take()
            items.append(self.single())
        return items[0] if len(items) == 1 else And(tuple(items))

    def single(self) -> Node:
        if self.is_word("NOT"):
            self.take()
            return Not(self.single())
        if self.peek().kind == "open":
            self.take()
            inner = self.either()
            self.expect("close", '")"')
            return inner
        name = self.expect("text", "a term")
        if self.is_word("IN") or self.is_word("NOT") and self.is_word("IN", 1):
            negated = self.take().text.upper() == "NOT"
            if negated:
                self.take()
            if name.text.lower() in (ANY, "any"):
                raise QuerySyntaxError("a list needs one field", name.at)
            return Member(name.text, self.members(), negated, name.at)
        if self.peek().kind != "op" or self.peek().text not in _OPS:
            return Anywhere(name.text)
        op = _OPS[self.take().text]
        value = self.take() if self.peek().kind in ("text", "regex", "keyword") else self.expect("text", "a value")
        if name.text.lower() == "is" and op in (":", "="):
            if value.text.lower() not in ("sus", "detection"):
                raise QuerySyntaxError('"is" takes sus or detection', value.at)
            return Flag(value.text.lower())
        any_field = name.text.lower() in (ANY, "any")
        if any_field and op in (":", "=", "!="):
            return Anywhere(value.text)
        flags = ""
        if op == "~":
            flags = value.flags if value.kind == "regex" else "i"
            check_pattern(value.text, value.at)
        return Test(ANY if any_field else name.text, op, value.text, flags, name.at)

    def members(self) -> tuple[str, ...]:
        self.expect("open", '"("')
        values: list[str] = []
        while True:
            values.append(self.expect("text", "a value").text)
            if self.peek().kind == "op" and self.peek().text == ",":
                self.take()
                continue
            self.expect("close", '")"')
            return tuple(dict.fromkeys(values))


def check_pattern(pattern: str, at: int = 0) -> None:
    """Patterns must be short, must compile, and must not nest unbounded repeats."""
    if len(pattern) > MAX_PATTERN:
        raise QuerySyntaxError(f"pattern over {MAX_PATTERN} characters", at)
    if re.search(r"\([^()]*[*+][^()]*\)[*+{]", pattern):
        raise QuerySyntaxError("nested repeats are unsafe", at)
    try:
        re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern))
    except re.error as e:
        raise QuerySyntaxError(f"bad pattern: {e}", at) from None


def parse(source: str | None) -> Node:
    reader = _Reader(source or "")
    if not reader.tokens:
        return Everything()
    tree = reader.either()
    if reader.peek().kind != "end":
        raise QuerySyntaxError(f"unexpected {reader.peek().text!r}", reader.peek().at)
    return tree


def _quoted(value: str) -> str:
    plain = value and not re.search(r"""[\s()"\[\]:=!~<>,/\\]""", value) and value.upper() not in _KEYWORDS
    return value if plain else '"' + re.sub(r'(["\\])', r"\\\1", value) + '"'


def _named(name: str) -> str:
    return name if _quoted(name) == name else f"[{name}]"


def to_text(node: Node, level: int = 0) -> str:
    """The query text of a tree; ``level`` 1 under OR, 2 under AND, 3 under NOT."""
    match node:
        case Everything():
            return ""
        case Anywhere(needle):
            return _quoted(needle)
        case Flag(name):
            return f"is:{name}"
        case Test(name, op, value, flags):
            shown = "/" + value.replace("/", "\\/") + "/" + flags if op == "~" else _quoted(value)
            return f"{_named(name) if name != ANY else 'any'}{op}{shown}"
        case Member(name, values, negated):
            return f"{_named(name)} {'NOT ' * negated}IN ({', '.join(map(_quoted, values))})"
        case Not(item):
            return f"NOT {to_text(item, 3)}"
        case And(items) | Or(items):
            own = 2 if isinstance(node, And) else 1
            text = (" AND " if own == 2 else " OR ").join(to_text(i, own) for i in items)
            return f"({text})" if level > own else text
    raise TypeError(node)


def fields_of(node: Node) -> list[str]:
    """Fields that a query names, in order."""
    match node:
        case Test(name) | Member(name):
            return [name] if name != ANY else []
        case Not(item):
            return fields_of(item)
        case And(items) | Or(items):
            return list(dict.fromkeys(f for i in items for f in fields_of(i)))
    return []


def without(node: Node, name: str) -> Node:
    """The query less all terms on one field; emptied groups vanish, free words stay."""
    match node:
        case (Test(f) | Member(f)) if f.lower() == name.lower():
            return Everything()
        case Not(item):
            inner = without(item, name)
            return inner if isinstance(inner, Everything) else Not(inner)
        case And(items) | Or(items):
            left = [x for x in (without(i, name) for i in items) if not isinstance(x, Everything)]
            return Everything() if not left else left[0] if len(left) == 1 else replace(node, items=tuple(left))
    return node


def _clauses(node: Node) -> tuple[Node, ...]:
    return () if isinstance(node, Everything) else node.items if isinstance(node, And) else (node,)


def _joined(clauses: Iterable[Node]) -> Node:
    c = tuple(clauses)
    return Everything() if not c else c[0] if len(c) == 1 else And(c)


def toggle(node: Node, name: str, value: str, negated: bool = False) -> Node:
    """Add ``field=value`` (or ``!=``) at the top, drop its opposite, or remove it if it is there already."""
    wanted = Test(name, "!=" if negated else "=", value)
    opposite = Test(name, "=" if negated else "!=", value)
    had = _clauses(node)
    left = [c for c in had if c not in (wanted, opposite)]
    return _joined(left if wanted in had else [*left, wanted])


def set_clause(node: Node, clause: Test | Member) -> Node:
    """Replace all top-level terms on the clause's field by it."""
    return _joined([*(c for c in _clauses(node) if getattr(c, "field", "").lower() != clause.field.lower()), clause])


class Binder:
    """Names to columns of one DataFrame; letter case is ignored, the first match wins."""

    def __init__(self, df: DataFrame, time: str = "_t"):
        self.df, self.time = df, time
        self.names: dict[str, str] = {}
        for name in df.columns:
            self.names.setdefault(name.lower(), name)
        if "__source" in self.names:
            self.names.setdefault("source", self.names["__source"])
        self.visible = [c for c in df.columns if not (c.startswith("_") and c != "__source")]

    def name(self, field_name: str, at: int) -> str:
        if field_name.lower() not in self.names:
            raise QuerySyntaxError(f"unknown field {field_name!r}", at)
        return self.names[field_name.lower()]

    def everywhere(self) -> Column:
        return F.lower(F.concat_ws("\n", *[text_of(self.df, c) for c in self.visible]))

    def column(self, node: Node) -> Column:
        match node:
            case Everything():
                return F.lit(True)
            case Anywhere(needle):
                return F.contains(self.everywhere(), F.lit(needle.lower()))
            case Flag(name):
                held = f"_{name}"
                return F.coalesce(F.col(held), F.lit(False)) if held in self.df.columns else F.lit(False)
            case Not(item):
                return ~self.column(item)
            case And(items):
                return reduce(lambda a, b: a & b, map(self.column, items))
            case Or(items):
                return reduce(lambda a, b: a | b, map(self.column, items))
            case Member(name, values, negated, at):
                held = text_of(self.df, self.name(name, at)).isin(*values)
                return ~held if negated else held
            case Test():
                return self.test(node)
        raise TypeError(node)

    def test(self, node: Test) -> Column:
        # a test of "any" field other than contains reads a cell that is not there: the empty text
        text = F.lit("") if node.field == ANY else text_of(self.df, self.name(node.field, node.at))
        if node.op == ":":
            return F.contains(F.lower(text), F.lit(node.value.lower()))
        if node.op == "=":
            return text == F.lit(node.value)
        if node.op == "!=":
            return text != F.lit(node.value)
        if node.op == "~":
            kept = "".join(f for f in "ims" if f in node.flags)
            return text.rlike(f"(?{kept}){node.value}" if kept else node.value)
        limit = re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", node.value.strip())
        if not limit or node.field == ANY:
            return F.lit(False)
        name = self.name(node.field, node.at)
        left = F.coalesce(number(text), column_millis(self.df, name))
        right = F.lit(float(node.value))
        compared = {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[node.op]
        return F.coalesce(compared, F.lit(False))


def compile_query(df: DataFrame, query: str | Node, lenient: bool = False) -> Column:
    """A never-null Boolean Column. ``lenient``: a query with an error matches everything, as while it is being typed.

    What the query implies for raw columns stands beside the comparisons of text forms, so that it reaches the scan.
    """
    from strandline.plans.pushdown import implied

    try:
        tree = parse(query) if isinstance(query, str) else query
        binder = Binder(df)
        exact, raw = binder.column(tree), implied(binder, tree)
        return exact if raw is None else raw & exact
    except QuerySyntaxError:
        if lenient:
            return F.lit(True)
        raise


def where(df: DataFrame, query: str | Node) -> DataFrame:
    return df.filter(compile_query(df, query))


def suggestions(df: DataFrame, query: str, limit: int = 80) -> list[str]:
    """Completions for the end of ``query``: values after a field and an operator, else fields and keywords."""
    m = re.search(r"([^\s()\"\[\]:=!~<>,]+)(?::=|:!|!=|[:=])([^\s()\"]*)$", query)
    if m:
        binder = Binder(df)
        text = text_of(df, binder.name(m[1], m.start(1)))
        rows = df.select(text.alias("v")).filter(F.contains(F.lower("v"), F.lit(m[2].lower())) & (F.col("v") != "")).groupBy("v").count()
        return [_quoted(r["v"]) for r in rows.orderBy(F.desc("count"), "v").limit(limit).collect()]
    tail = re.search(r"[^\s()]*$", query)[0].lower()
    return [w for w in [*map(_named, df.columns), *_KEYWORDS] if w.lower().startswith(tail)][:limit]
