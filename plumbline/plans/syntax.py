"""Syntax trees of the dialect, and the parser that makes them.

Names are folded to lower case. Whatever the dialect refuses by its form alone is
refused here with `unsupported`; text that is no SQL at all is a parse error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from .errors import parse_error, unsupported


@dataclass(frozen=True)
class Node:
    """An expression: its kind, operands, and whatever else belongs to it."""

    kind: str
    args: tuple = ()
    info: Any = None


@dataclass(frozen=True)
class Over:
    partition: tuple[Node, ...]
    order: tuple[Key, ...]


@dataclass(frozen=True)
class Key:
    expr: Node
    ascending: bool = True
    nulls_first: bool | None = None

    @property
    def first(self) -> bool:
        return self.ascending if self.nulls_first is None else self.nulls_first


@dataclass(frozen=True)
class Item:
    expr: Node
    alias: str | None = None


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Derived:
    query: Query
    alias: str
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class JoinRef:
    kind: str  # inner, left, right, full, cross
    left: Any
    right: Any
    on: Node | None = None
    using: tuple[str, ...] = ()
    natural: bool = False


@dataclass(frozen=True)
class Nested:
    join: Any
    alias: str | None = None


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    tables: tuple = ()
    distinct: bool = False
    where: Node | None = None
    group: tuple[Node, ...] = ()
    having: Node | None = None


@dataclass(frozen=True)
class SetQuery:
    op: str  # union, intersect, except
    every: bool
    left: Any
    right: Any


@dataclass(frozen=True)
class Query:
    body: Any
    ctes: tuple = ()
    order: tuple[Key, ...] = ()
    limit: int | None = None
    offset: int = 0
    extra: dict = field(default_factory=dict, hash=False, compare=False)


_TOKEN = re.compile(
    r"""\s+|--[^\n]*|/\*.*?\*/
    |(?P<number>\d+\.\d*|\.\d+|\d+)(?P<bad>[A-Za-z_]\w*)?
    |(?P<word>[A-Za-z_]\w*)
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>"[^"]*"|`[^`]*`|\[[^\]]*\])
    |(?P<op><=>|<>|!=|<=|>=|\|\||[-+*/%=<>(),.;?:])""",
    re.X | re.S,
)
_RESERVED = set("select from where group having order limit offset union intersect except on using join inner left right full cross natural as and or not in is between like case when then else end null true false exists distinct all any some by with outer fetch for window qualify minus".split())
_COMPARE = {"=": "eq", "<>": "ne", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
_CLAUSES = set("fetch for window qualify top limit_by distribute cluster sort lateral pivot unpivot tablesample".split())


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise parse_error(f"unexpected {text[at]!r}")
        if m["bad"]:
            raise parse_error(f"unexpected {m[0]!r}")
        if m["quoted"]:
            raise unsupported("quoted names")
        for kind in ("number", "word", "string", "op"):
            if m[kind] is not None:
                out.append((kind, m[kind].lower() if kind == "word" else m[kind]))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    # -- tokens
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def is_(self, *values: str) -> bool:
        return all(self.peek(k) in (("word", v), ("op", v)) for k, v in enumerate(values))

    def take(self, *values: str) -> bool:
        if self.is_(*values):
            self.at += len(values)
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise parse_error(f"expected {value!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "word" or value in _RESERVED:
            raise parse_error(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def names(self) -> tuple[str, ...]:
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        return tuple(out)

    def integer(self) -> int:
        kind, value = self.peek()
        if kind != "number" or not value.isdigit():
            raise unsupported("a limit or offset that is no integer literal")
        self.at += 1
        if self.peek()[0] == "op" and self.peek()[1] in "+-*/%":
            raise unsupported("a limit or offset that is no integer literal")
        return int(value)

    # -- queries
    def statement(self) -> Query:
        if self.peek()[1] in ("insert", "update", "delete", "create", "drop", "alter", "merge", "values", "table", "explain"):
            raise unsupported(f"{self.peek()[1]} statements")
        query = self.query()
        self.take(";")
        if self.peek()[0] != "end":
            if self.peek()[1] in _CLAUSES:
                raise unsupported(self.peek()[1])
            raise parse_error(f"unexpected {self.peek()[1]!r}")
        return query

    def query(self) -> Query:
        ctes = []
        if self.take("with"):
            if self.take("recursive"):
                raise unsupported("recursive queries")
            while True:
                name = self.name()
                columns = ()
                if self.take("("):
                    columns = self.names()
                    self.need(")")
                self.need("as")
                self.need("(")
                ctes.append((name, columns, self.query()))
                self.need(")")
                if not self.take(","):
                    break
        body = self.set_body()
        order, limit, offset = (), None, 0
        if self.take("order", "by"):
            if self.is_("all"):
                raise unsupported("ORDER BY ALL")
            order = self.keys()
        while True:
            if self.take("limit"):
                if self.is_("all"):
                    raise unsupported("LIMIT ALL")
                limit = self.integer()
                if self.take(","):
                    offset, limit = limit, self.integer()
                if self.is_("by"):
                    raise unsupported("LIMIT BY")
            elif self.take("offset"):
                offset = self.integer()
                self.take("rows") or self.take("row")
            else:
                break
        for clause in ("fetch", "for", "settings", "format"):
            if self.is_(clause):
                raise unsupported(clause)
        return Query(body, tuple(ctes), order, limit, offset)

    def set_body(self):
        left = self.set_term()
        while self.is_("union") or self.is_("except") or self.is_("minus"):
            if self.is_("minus"):
                raise unsupported("MINUS")
            op = self.peek()[1]
            self.at += 1
            left = self.set_op(op, left, self.set_term)
        return left

    def set_term(self):
        left = self.set_operand()
        while self.take("intersect"):
            left = self.set_op("intersect", left, self.set_operand)
        return left

    def set_op(self, op, left, operand):
        every = self.take("all")
        if not every:
            self.take("distinct")
        if self.is_("by"):
            raise unsupported("set operations BY NAME")
        return SetQuery(op, every, left, operand())

    def set_operand(self):
        if self.take("("):
            query = self.query()
            self.need(")")
            return query
        if self.is_("values") or self.is_("table"):
            raise unsupported(self.peek()[1])
        if self.is_("from"):
            self.at += 1
            return self.select_rest((Item(Node("star")),), False, self.from_list())
        self.need("select")
        if self.is_("top"):
            raise unsupported("TOP")
        distinct = self.take("distinct")
        if distinct and self.is_("on"):
            raise unsupported("DISTINCT ON")
        if not distinct:
            self.take("all")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        return self.select_rest(tuple(items), distinct, self.from_list() if self.take("from") else ())

    def select_rest(self, items, distinct, tables) -> Select:
        where = self.expr() if self.take("where") else None
        group: list[Node] = []
        if self.take("group", "by"):
            if self.is_("all") or self.is_("grouping") or self.peek()[1] in ("rollup", "cube") and self.peek(1)[1] == "(":
                raise unsupported("GROUP BY modifiers")
            group.append(self.expr())
            while self.take(","):
                group.append(self.expr())
            if self.is_("with"):
                raise unsupported("GROUP BY modifiers")
        having = self.expr() if self.take("having") else None
        for clause in ("window", "qualify", "distribute", "cluster", "sort"):
            if self.is_(clause):
                raise unsupported(clause)
        return Select(items, tuple(tables), distinct, where, tuple(group), having)

    def item(self) -> Item:
        if self.take("*"):
            return Item(Node("star"))
        if self.peek()[0] == "word" and self.peek(1) == ("op", ".") and self.peek(2) == ("op", "*"):
            name = self.name()
            self.at += 2
            return Item(Node("star", info=name))
        expr = self.expr()
        if self.take("as"):
            return Item(expr, self.name())
        if self.peek()[0] == "word" and self.peek()[1] not in _RESERVED and self.peek()[1] not in _CLAUSES:
            return Item(expr, self.name())
        return Item(expr)

    def keys(self) -> tuple[Key, ...]:
        out = []
        while True:
            expr = self.expr()
            up = not self.take("desc")
            if up:
                self.take("asc")
            nulls = None
            if self.take("nulls"):
                nulls = self.take("first")
                if not nulls:
                    self.need("last")
            out.append(Key(expr, up, nulls))
            if not self.take(","):
                if self.is_("with"):
                    raise unsupported("ORDER BY modifiers")
                return tuple(out)

    # -- tables
    def from_list(self) -> tuple:
        out = [self.joined()]
        while self.take(","):
            out.append(self.joined())
        return tuple(out)

    def joined(self):
        left = self.factor()
        while True:
            if self.is_("global") or self.is_("asof") or self.is_("semi") or self.is_("anti") or self.is_("outer", "apply") or self.is_("cross", "apply") or self.is_("left", "semi") or self.is_("left", "anti") or self.is_("right", "semi") or self.is_("right", "anti") or self.is_("array"):
                raise unsupported("this kind of join")
            natural = self.take("natural")
            if self.take("cross", "join"):
                if natural:
                    raise parse_error("NATURAL CROSS JOIN")
                right = self.factor()
                if self.is_("on") or self.is_("using"):
                    raise unsupported("CROSS JOIN with a constraint")
                left = JoinRef("cross", left, right)
                continue
            kind = None
            for k in ("left", "right", "full"):
                if self.take(k):
                    self.take("outer")
                    self.need("join")
                    kind = k
            if kind is None and (self.take("inner", "join") or self.take("join")):
                kind = "inner"
            if kind is None:
                if natural:
                    raise parse_error("NATURAL without JOIN")
                return left
            right = self.factor()
            on, using = None, ()
            if self.take("on"):
                on = self.expr()
            elif self.take("using"):
                self.need("(")
                using = self.names()
                self.need(")")
            if natural and (on or using):
                raise parse_error("NATURAL JOIN with a constraint")
            if kind != "inner" and not (on or using or natural):
                raise unsupported("an outer join without a constraint")
            left = JoinRef(kind, left, right, on, using, natural)

    def factor(self):
        if self.is_("lateral"):
            raise unsupported("LATERAL")
        if self.take("("):
            if self.is_("select") or self.is_("with") or self.is_("from") or self.is_("(") and self.nested_query():
                query = self.query()
                self.need(")")
                alias, columns = self.alias()
                if alias is None:
                    raise unsupported("a derived table without an alias")
                return Derived(query, alias, columns)
            join = self.joined()
            self.need(")")
            alias, columns = self.alias()
            if columns:
                raise unsupported("column aliases of a parenthesised join")
            return Nested(join, alias)
        if self.is_("unnest") or self.is_("values"):
            raise unsupported("table functions")
        name = self.name()
        if self.is_("."):
            raise unsupported("qualified table names")
        if self.is_("("):
            raise unsupported("table functions")
        alias, columns = self.alias()
        if self.is_("tablesample") or self.is_("pivot") or self.is_("for"):
            raise unsupported(self.peek()[1])
        return TableRef(name, alias or name, columns)

    def nested_query(self) -> bool:
        k = 0
        while self.peek(k) == ("op", "("):
            k += 1
        return self.peek(k)[1] in ("select", "with")

    def alias(self) -> tuple[str | None, tuple[str, ...]]:
        alias = None
        if self.take("as"):
            alias = self.name()
        elif self.peek()[0] == "word" and self.peek()[1] not in _RESERVED and self.peek()[1] not in _CLAUSES and self.peek()[1] not in ("global", "asof", "semi", "anti", "array"):
            alias = self.name()
        columns: tuple[str, ...] = ()
        if alias and self.take("("):
            columns = self.names()
            if self.peek()[0] == "word":
                raise unsupported("typed column aliases")
            self.need(")")
        return alias, columns

    # -- expressions, loosest binding first
    def expr(self) -> Node:
        left = self.conjunction()
        while self.take("or"):
            left = Node("or", (left, self.conjunction()))
        return left

    def conjunction(self) -> Node:
        left = self.negation()
        while self.take("and"):
            left = Node("and", (left, self.negation()))
        return left

    def negation(self) -> Node:
        if self.take("not"):
            return Node("not", (self.negation(),))
        return self.predicate()

    def predicate(self) -> Node:
        left = self.sum()
        while True:
            kind, value = self.peek()
            if kind == "op" and value in _COMPARE:
                self.at += 1
                for quantifier in ("any", "some", "all"):
                    if self.take(quantifier):
                        self.need("(")
                        query = self.query()
                        self.need(")")
                        left = Node("quantified", (left,), (_COMPARE[value], "all" if quantifier == "all" else "any", query))
                        break
                else:
                    left = Node(_COMPARE[value], (left, self.sum()))
            elif self.take("<=>"):
                left = Node("same", (left, self.sum()))
            elif self.take("is"):
                negated = self.take("not")
                if self.take("distinct"):
                    self.need("from")
                    node = Node("not", (Node("same", (left, self.sum())),))
                elif self.take("null") or self.take("unknown"):
                    node = Node("is_null", (left,), self.tokens[self.at - 1][1])
                elif self.take("true") or self.take("false"):
                    node = Node("is_bool", (left,), self.tokens[self.at - 1][1] == "true")
                else:
                    raise parse_error(f"unexpected {self.peek()[1]!r} after IS")
                left = Node("not", (node,)) if negated else node
            else:
                negated = self.is_("not") and self.peek(1)[1] in ("in", "between", "like", "ilike", "similar", "rlike", "regexp")
                if negated:
                    self.at += 1
                if self.take("between"):
                    low = self.sum()
                    self.need("and")
                    node = Node("between", (left, low, self.sum()))
                elif self.take("in"):
                    self.need("(")
                    if self.is_("select") or self.is_("with") or self.is_("from"):
                        node = Node("in_query", (left,), self.query())
                    else:
                        node = Node("in_list", (left, *self.list_()))
                    self.need(")")
                elif self.take("like"):
                    if self.is_("any"):
                        raise unsupported("LIKE ANY")
                    node = Node("like", (left, self.sum()))
                    if self.is_("escape"):
                        raise unsupported("ESCAPE")
                elif self.peek()[1] in ("ilike", "similar", "rlike", "regexp"):
                    raise unsupported(self.peek()[1])
                else:
                    return left
                left = Node("not", (node,)) if negated else node

    def list_(self) -> list[Node]:
        out = [self.expr()]
        while self.take(","):
            out.append(self.expr())
        return out

    def sum(self) -> Node:
        left = self.product()
        while True:
            if self.take("+"):
                left = Node("add", (left, self.product()))
            elif self.take("-"):
                left = Node("sub", (left, self.product()))
            elif self.take("||"):
                left = Node("call", (left, self.product()), "concat")
            else:
                return left

    def product(self) -> Node:
        left = self.unary()
        while True:
            if self.take("*"):
                left = Node("mul", (left, self.unary()))
            elif self.take("/"):
                left = Node("div", (left, self.unary()))
            elif self.take("%"):
                left = Node("mod", (left, self.unary()))
            else:
                return left

    def unary(self) -> Node:
        if self.take("-"):
            return Node("neg", (self.unary(),))
        if self.take("+"):
            return Node("plus", (self.unary(),))
        return self.primary()

    def primary(self) -> Node:
        kind, value = self.peek()
        if kind == "number":
            self.at += 1
            return Node("number", info=value)
        if kind == "string":
            self.at += 1
            return Node("string", info=value[1:-1].replace("''", "'"))
        if self.take("("):
            if self.is_("select") or self.is_("with") or self.is_("from"):
                query = self.query()
                self.need(")")
                return Node("scalar", info=query)
            items = self.list_()
            self.need(")")
            return items[0] if len(items) == 1 else Node("row", tuple(items))
        if kind != "word":
            if value in ("?", ":"):
                raise unsupported("parameters")
            raise parse_error(f"unexpected {value!r}")
        if self.take("null"):
            return Node("null")
        if self.take("true"):
            return Node("bool", info=True)
        if self.take("false"):
            return Node("bool", info=False)
        if self.take("exists"):
            self.need("(")
            query = self.query()
            self.need(")")
            return Node("exists", info=query)
        if self.take("case"):
            return self.case()
        if value in ("date", "time", "timestamp") and self.peek(1)[0] == "string":
            self.at += 2
            if value == "timestamp":
                raise unsupported("timestamps")
            return Node("typed", info=(value, self.tokens[self.at - 1][1][1:-1]))
        if self.take("interval"):
            return self.interval()
        if value in ("cast", "try_cast", "safe_cast", "convert") and self.peek(1) == ("op", "("):
            return self.cast()
        if value == "extract" and self.peek(1) == ("op", "("):
            self.at += 2
            part = self.name()
            self.need("from")
            node = Node("call", (self.expr(),), part)
            self.need(")")
            if part not in ("year", "month", "day"):
                raise unsupported(f"EXTRACT({part})")
            return node
        if value in ("left", "right", "if") and self.peek(1) == ("op", "("):
            self.at += 1
            return self.call(value)
        if value in _RESERVED:
            raise parse_error(f"unexpected {value!r}")
        name = self.name()
        if self.is_("("):
            return self.call(name)
        if self.take("."):
            column = self.name()
            if self.is_("."):
                raise unsupported("names of more than two parts")
            return Node("name", info=(name, column))
        return Node("name", info=(None, name))

    def case(self) -> Node:
        operand = None if self.is_("when") else self.expr()
        branches = []
        while self.take("when"):
            condition = self.expr()
            self.need("then")
            branches += [condition, self.expr()]
        if not branches:
            raise parse_error("CASE without WHEN")
        other = self.expr() if self.take("else") else Node("null")
        self.need("end")
        if operand is not None:
            branches = [Node("eq", (operand, b)) if k % 2 == 0 else b for k, b in enumerate(branches)]
        return Node("case", (*branches, other))

    def interval(self) -> Node:
        kind, value = self.peek()
        negative = self.take("-")
        kind, value = self.peek()
        if kind not in ("number", "string"):
            raise unsupported("this interval")
        self.at += 1
        text = value.strip("'").strip()
        unit = self.name() if self.peek()[0] == "word" and self.peek()[1] in ("day", "days", "hour", "month", "year", "week", "minute", "second", "quarter") else "none"
        m = re.fullmatch(r"([+-]?\d+)(?:\s+(days?))?", text)
        if not m or (m[2] or unit) not in ("day", "days"):
            raise unsupported("intervals other than whole days")
        return Node("interval", info=-int(m[1]) if negative else int(m[1]))

    def cast(self) -> Node:
        name = self.peek()[1]
        if name != "cast":
            raise unsupported(name)
        self.at += 2
        expr = self.expr()
        self.need("as")
        words = [self.name()]
        while self.peek()[0] == "word":
            words.append(self.name())
        if self.take("("):
            while not self.take(")"):
                self.at += 1
                if self.peek()[0] == "end":
                    raise parse_error("unfinished type")
        while self.peek()[0] == "word":
            words.append(self.name())
        self.need(")")
        return Node("cast", (expr,), " ".join(words))

    def call(self, name: str) -> Node:
        self.need("(")
        if name == "substring" or name == "substr":
            args = [self.expr()]
            if self.take("from"):
                args.append(self.expr())
                if self.take("for"):
                    args.append(self.expr())
            else:
                while self.take(","):
                    args.append(self.expr())
            self.need(")")
            return Node("call", tuple(args), "substring")
        if name == "timestampdiff":
            unit = self.name()
            if unit not in ("day", "sql_tsi_day"):
                raise unsupported(f"TIMESTAMPDIFF({unit})")
            self.need(",")
            start, end = self.list_()
            self.need(")")
            return Node("call", (end, start), "datediff")
        if name in ("floor", "ceil", "ceiling") and not self.is_(")"):
            arg = self.expr()
            if self.is_("to") or self.is_(","):
                raise unsupported("a scale of FLOOR or CEIL")
            self.need(")")
            return self.windowed(Node("call", (arg,), name))
        if self.take("*"):
            self.need(")")
            return self.windowed(Node("agg", (), (name, False)))
        distinct = self.take("distinct")
        if not distinct:
            self.take("all")
        if distinct and self.is_("*"):
            raise unsupported("DISTINCT *")
        args = [] if self.is_(")") else self.list_()
        if self.is_("order") or self.is_("separator") or self.is_("ignore") or self.is_("respect"):
            raise unsupported(f"clauses within {name}()")
        self.need(")")
        if self.is_("filter") or self.is_("within") or self.is_("ignore") or self.is_("respect"):
            raise unsupported(f"{self.peek()[1]} after {name}()")
        if name in AGGREGATES:
            return self.windowed(Node("agg", tuple(args), (name, distinct)))
        if distinct:
            raise unsupported(f"DISTINCT in {name}()")
        return self.windowed(Node("call", tuple(args), name))

    def windowed(self, node: Node) -> Node:
        if not self.take("over"):
            return node
        if not self.is_("("):
            raise unsupported("named windows")
        self.need("(")
        partition, order = (), ()
        if self.take("partition", "by"):
            partition = tuple(self.list_())
        if self.take("order", "by"):
            order = self.keys()
        if self.peek()[1] in ("rows", "range", "groups"):
            raise unsupported("window frames")
        if self.peek()[0] == "word":
            raise unsupported("named windows")
        self.need(")")
        return Node("window", node.args, (node.kind, node.info, Over(partition, order)))


# The aggregate functions.
AGGREGATES = {"count", "sum", "avg", "min", "max"}


def parse(text: str) -> Query:
    """One query statement."""
    try:
        return Parser(text).statement()
    except RecursionError:
        raise parse_error("nested too deeply") from None
