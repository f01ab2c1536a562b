"""The text language: nine statements, lexed and parsed here, run by ``recollect.store``.

    SELECT * [FROM c] [WHERE e] [LIMIT n]
    DEFINE INDEX ON f | DEFINE ALIAS a FOR c | DEFINE FIELD f ON c TYPE t
    REMOVE ALIAS a | REMOVE COLLECTION c | REMOVE FIELD f ON c
    UPDATE id [CONTENT] SET k = v, ...
    DELETE id | DELETE PAYLOAD id [(k, ...)]
    RELATE a -> verb -> b
    TRAVERSE a[, b] (-> | <- | <->) [verb [arrow]] [DEPTH n] [LIMIT n]
    LIVE [SINCE n]
    INFO

A SELECT has no score: its rows come in id order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.plans import filters as f

_TOKEN = re.compile(
    r"(?P<space>\s+|--[^\n]*)|(?P<arrow><->|->|<-)|(?P<op>!=|>=|<=|[=<>(),*;])"
    r"|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")"
    r"|(?P<quoted>`[^`]+`)|(?P<word>[^\W\d][\w:-]*(?:\.[\w:-]+)*)",
    re.S,
)
TYPES = {"string": "string", "int": "int", "integer": "int", "float": "float", "number": "float", "decimal": "float", "bool": "bool", "boolean": "bool", "datetime": "datetime", "uuid": "uuid"}
DEFAULT_LIMIT, MOST_DEPTH, MOST_VISITS = 10, 64, 10_000


class SyntaxProblem(ValueError):
    """Carries the place of the problem; ``render`` points at it."""

    def __init__(self, text: str, at: int, why: str):
        super().__init__(f"{why} at {at}")
        self.text, self.at, self.why = text, at, why

    def render(self) -> str:
        start = self.text.rfind("\n", 0, self.at) + 1
        line = self.text[start:].split("\n", 1)[0]
        return f"{line}\n{' ' * (self.at - start)}^ {self.why}"


@dataclass(frozen=True)
class Token:
    kind: str
    value: object
    at: int


def lex(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(text, at, "unexpected character")
        kind, raw = m.lastgroup, m.group()
        if kind == "number":
            out.append(Token(kind, float(raw) if re.search(r"[.eE]", raw) else int(raw), at))
        elif kind == "string":
            out.append(Token(kind, re.sub(r"\\(.)", r"\1", raw[1:-1], flags=re.S), at))
        elif kind == "quoted":
            out.append(Token("name", raw[1:-1], at))
        elif kind != "space":
            out.append(Token(kind or "word", raw, at))
        at = m.end()
    return out


@dataclass(frozen=True)
class Select:
    collection: str | None
    where: object | None
    limit: int


@dataclass(frozen=True)
class Statement:
    """Any statement but SELECT: its name and its parts."""

    name: str
    parts: dict

    @property
    def is_write(self) -> bool:
        return self.name.split()[0] in ("define", "remove", "update", "delete", "relate")


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, lex(text), 0

    def fail(self, why: str):
        at = self.tokens[self.i].at if self.i < len(self.tokens) else len(self.text)
        raise SyntaxProblem(self.text, at, why)

    def peek(self) -> Token | None:
        return self.tokens[self.i] if self.i < len(self.tokens) else None

    def word(self, *names: str) -> str | None:
        t = self.peek()
        if t and t.kind == "word" and str(t.value).lower() in names:
            self.i += 1
            return str(t.value).lower()
        return None

    def need_word(self, *names: str) -> str:
        return self.word(*names) or self.fail("expected " + " or ".join(n.upper() for n in names))

    def op(self, *ops: str) -> str | None:
        t = self.peek()
        if t and t.kind in ("op", "arrow") and t.value in ops:
            self.i += 1
            return str(t.value)
        return None

    def need_op(self, *ops: str) -> str:
        return self.op(*ops) or self.fail("expected " + " or ".join(ops))

    def name(self) -> str:
        t = self.peek()
        if t and t.kind in ("word", "name", "string"):
            self.i += 1
            return str(t.value)
        return self.fail("expected a name")

    def number(self) -> float:
        t = self.peek()
        if t and t.kind == "number":
            self.i += 1
            return t.value
        return self.fail("expected a number")

    def count(self) -> int:
        n = self.number()
        if not isinstance(n, int) or n < 0:
            self.i -= 1
            self.fail("expected a whole number")
        return n

    def value(self):
        t = self.peek()
        if t and t.kind in ("number", "string"):
            self.i += 1
            return t.value
        w = self.word("true", "false", "null")
        if w is None:
            self.fail("expected a value")
        return {"true": True, "false": False, "null": None}[w]

    def end(self):
        self.op(";")
        if self.peek():
            self.fail("unexpected text after the statement")

    def statement(self):
        w = self.need_word("select", "define", "remove", "update", "delete", "relate", "traverse", "live", "info")
        out = getattr(self, "_" + w)()
        self.end()
        return out

    def _select(self):
        self.need_op("*")
        collection = self.name() if self.word("from") else None
        where = self.either() if self.word("where") else None
        limit = self.count() if self.word("limit") else DEFAULT_LIMIT
        return Select(collection, where, limit)

    def _define(self):
        what = self.need_word("index", "alias", "field")
        if what == "index":
            self.need_word("on")
            return Statement("define index", {"field": self.name()})
        if what == "alias":
            alias = self.name()
            self.need_word("for")
            return Statement("define alias", {"alias": alias, "collection": self.name()})
        field = self.name()
        self.need_word("on")
        collection = self.name()
        self.need_word("type")
        return Statement("define field", {"field": field, "collection": collection, "type": TYPES[self.need_word(*TYPES)]})

    def _remove(self):
        what = self.need_word("alias", "collection", "field")
        name = self.name()
        if what == "field":
            self.need_word("on")
            return Statement("remove field", {"field": name, "collection": self.name()})
        return Statement(f"remove {what}", {what: name})

    def _update(self):
        id_ = self.name()
        replace = bool(self.word("content"))
        self.need_word("set")
        values = {}
        while True:
            key = self.name()
            self.need_op("=")
            values[key] = self.value()
            if not self.op(","):
                return Statement("update", {"id": id_, "replace": replace, "values": values})

    def _delete(self):
        if not self.word("payload"):
            return Statement("delete", {"id": self.name()})
        id_, keys = self.name(), None
        if self.op("("):
            keys = [self.name()]
            while self.op(","):
                keys.append(self.name())
            self.need_op(")")
        return Statement("delete payload", {"id": id_, "keys": keys})

    def _relate(self):
        src = self.name()
        self.need_op("->")
        verb = self.name()
        self.need_op("->")
        return Statement("relate", {"src": src, "verb": verb, "dst": self.name()})

    def _traverse(self):
        start = [self.name()]
        while self.op(","):
            start.append(self.name())
        arrow = self.need_op("->", "<-", "<->")
        verb = None
        t = self.peek()
        if t and t.kind in ("word", "name", "string") and not (t.kind == "word" and str(t.value).lower() in ("depth", "limit")):
            verb = self.name()
            self.op("->", "<-", "<->")
        depth = self.count() if self.word("depth") else 2
        limit = self.count() if self.word("limit") else MOST_VISITS
        if depth > MOST_DEPTH or limit > MOST_VISITS:
            self.fail(f"depth is at most {MOST_DEPTH}, limit at most {MOST_VISITS}")
        return Statement("traverse", {"start": start, "direction": {"->": "out", "<-": "in", "<->": "both"}[arrow], "verb": verb, "depth": depth, "limit": limit})

    def _live(self):
        return Statement("live", {"since": self.count() if self.word("since") else None})

    def _info(self):
        return Statement("info", {})

    # expressions: OR < AND < NOT

    def either(self):
        parts = [self.both()]
        while self.word("or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else f.Filter(should=tuple(parts))

    def both(self):
        parts = [self.negated()]
        while self.word("and"):
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else f.Filter(must=tuple(parts))

    def negated(self):
        if self.word("not"):
            return f.Not(self.negated())
        if self.op("("):
            out = self.either()
            self.need_op(")")
            return out
        return self.comparison()

    def comparison(self):
        if self.word("exists"):
            self.need_op("(")
            key = self.name()
            self.need_op(")")
            return f.Exists(key)
        key = self.name()
        if self.word("in"):
            self.need_op("(")
            values = [self.value()]
            while self.op(","):
                values.append(self.value())
            self.need_op(")")
            return f.Any(key, tuple(values))
        if self.word("is"):
            self.need_word("exists")
            return f.Exists(key)
        if self.word("inside"):
            shape = self.need_word("radius", "box")
            self.need_op("(")
            args = [float(self.number())]
            while self.op(","):
                args.append(float(self.number()))
            self.need_op(")")
            if len(args) != (3 if shape == "radius" else 4):
                self.fail(f"{shape.upper()} takes {3 if shape == 'radius' else 4} numbers")
            return f.GeoRadius(key, *args) if shape == "radius" else f.GeoBox(key, *args)
        op = self.need_op("=", "!=", ">", ">=", "<", "<=")
        if op == "=":
            return f.Eq(key, self.value())
        if op == "!=":
            return f.Not(f.Eq(key, self.value()))
        bound = float(self.number())
        return f.Range(key, **{{">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[op]: bound})


def parse(text: str):
    return Parser(text).statement()


def parse_query(text: str) -> Select:
    """A SELECT; anything else is refused."""
    out = parse(text)
    if not isinstance(out, Select):
        raise f.InvalidRequest("only SELECT is allowed here")
    return out


def select(statement: Select, docs: DataFrame, at: f.Fields, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rows of ``docs`` (with id and collection) in id order."""
    if statement.collection is not None:
        docs = docs.where(F.col("collection") == (aliases or {}).get(statement.collection, statement.collection))
    if statement.where is not None:
        docs = docs.where(f.compile_filter(statement.where, at))
    return docs.orderBy("id").limit(statement.limit)
