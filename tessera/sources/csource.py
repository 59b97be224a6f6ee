"""C source text to trees: statements of a function body, nodes of an expression.

A recursive descent over one text at a time, run per Arrow batch; what follows is columnar. Types
are not resolved: a name is a type if it is one of ``TYPES`` or stands where only a type can.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of C: precedence of binary operators (smaller binds closer), prefix operators, type words.
BINARY = {
    "*": 5, "/": 5, "%": 5, "+": 6, "-": 6, "<<": 7, ">>": 7, "<": 9, "<=": 9, ">": 9, ">=": 9, "==": 10, "!=": 10,
    "&": 11, "^": 12, "|": 13, "&&": 14, "||": 15, "=": 16, "+=": 16, "-=": 16, "*=": 16, "/=": 16, "%=": 16,
    "&=": 16, "|=": 16, "^=": 16, "<<=": 16, ">>=": 16, ",": 17,
}
PREFIX = ("-", "+", "!", "~", "*", "&", "++", "--", "sizeof")
TYPES = frozenset("auto bool char const double enum extern float int long register short signed static struct union unsigned void volatile size_t".split())

#: Right-associative levels: assignments and the conditional operator.
ASSIGNMENT = 16
LOWEST = 17
COMPARISONS = ("<", "<=", ">", ">=", "==", "!=")

_TOKEN = re.compile(
    r"//[^\n]*|/\*.*?\*/|\s+|(?P<t>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\d(?:[eEpP][+-]|[\w.])*|\.\d[\w.]*|[A-Za-z_]\w*|<<=|>>=|\.\.\.|->|\+\+|--|<<|>>|[<>=!+\-*/%&|^]=|&&|\|\||.)",
    re.S,
)
_NAME = re.compile(r"[A-Za-z_]\w*")

#: A node: kind, text, number of its token, child nodes.
Node = tuple[str, str, int, list]


class Malformed(ValueError):
    pass


class Reader:
    """One text's tokens and the place of the next one."""

    def __init__(self, code: str):
        self.tokens = [m["t"] for m in _TOKEN.finditer(code) if m["t"]]
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else ""

    def next(self) -> str:
        if self.at >= len(self.tokens):
            raise Malformed("text ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, token: str) -> None:
        if self.next() != token:
            raise Malformed(f"no {token}")

    def text_until(self, stop: str) -> str:
        """Tokens up to ``stop`` outside of brackets; ``stop`` is passed."""
        start, depth = self.at, 0
        while depth or self.peek() != stop:
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(self.next(), 0)
            if depth < 0:
                raise Malformed(f"no {stop}")
        self.at += 1
        return " ".join(self.tokens[start : self.at - 1])

    # Expressions

    def expression(self, least: int = LOWEST) -> Node:
        left = self.unary()
        while True:
            op, at = self.peek(), self.at
            if op == "?" and least >= ASSIGNMENT:
                self.at += 1
                middle = self.expression()
                self.expect(":")
                left = ("conditional", "?:", at, [left, middle, self.expression(ASSIGNMENT)])
                continue
            level = BINARY.get(op, LOWEST + 1)
            if level > least:
                return left
            self.at += 1
            left = ("binary", op, at, [left, self.expression(level if level == ASSIGNMENT else level - 1)])

    def unary(self) -> Node:
        op, at = self.peek(), self.at
        if op in PREFIX:
            self.at += 1
            return ("unary", op, at, [self.unary()])
        if op == "(" and self.peek(1) in TYPES:  # a cast, which is dropped
            self.at += 1
            self.text_until(")")
            return self.unary()
        return self.postfix(self.primary())

    def primary(self) -> Node:
        at, token = self.at, self.next()
        if token == "(":
            inner = self.expression()
            self.expect(")")
            return inner
        if _NAME.fullmatch(token):
            return ("variable", token, at, [])
        if token[0] in "\"'.0123456789" and token not in (".", "..."):
            return ("constant", token, at, [])
        raise Malformed(f"unexpected {token}")

    def postfix(self, left: Node) -> Node:
        while True:
            op, at = self.peek(), self.at
            if op in ("++", "--"):
                self.at += 1
                left = ("postfix", op, at, [left])
            elif op in (".", "->"):
                self.at += 1
                left = ("member", op + self.next(), at, [left])
            elif op == "[":
                self.at += 1
                inside = self.expression()
                self.expect("]")
                left = ("subscript", "[]", at, [left, inside])
            elif op == "(":
                self.at += 1
                given: list = []
                while self.peek() != ")":
                    given.append(self.expression(ASSIGNMENT))
                    if self.peek() != ")":
                        self.expect(",")
                self.at += 1
                left = ("member_call" if left[0] == "member" else "call", "()", at, [left, *given])
            else:
                return left

    # Statements

    def declares(self) -> bool:
        """Whether a declaration is next: a type word, or a name followed by stars and a name."""
        if self.peek() in TYPES:
            return True
        ahead = 1
        while self.peek(ahead) == "*":
            ahead += 1
        names = _NAME.fullmatch(self.peek()) and _NAME.fullmatch(self.peek(ahead))
        return bool(names) and self.peek(ahead + 1) in ("=", ";", "[", ",")

    def braced(self) -> Node:
        at = self.at
        self.expect("{")
        inside = []
        while self.peek() != "}":
            inside.append(self.statement())
        self.at += 1
        return ("sequence", "", at, inside)

    def condition(self) -> str:
        self.expect("(")
        return self.text_until(")")

    def statement(self) -> Node:
        at, word = self.at, self.peek()
        if word == "{":
            return self.braced()
        if word in ("while", "for"):
            self.at += 1
            return (word, self.condition(), at, [self.statement()])
        if word == "do":
            self.at += 1
            body = self.statement()
            self.expect("while")
            until = self.condition()
            self.expect(";")
            return (word, until, at, [body])
        if word == "if":
            return self.choice()
        if word in ("return", "break", "continue"):
            self.at += 1
            return (word, self.text_until(";"), at, [])
        if word in ("switch", "goto", ";") or self.peek(1) == ":" and _NAME.fullmatch(word) or word in ("case", "default"):
            return self.other(word)
        if self.declares():
            return ("declaration", self.text_until(";"), at, [])
        return ("expression", self.text_until(";"), at, [])

    def choice(self) -> Node:
        """An if with its chain of further ifs as branches, then what is left over."""
        at, parts = self.at, []
        while self.peek() == "if":
            here = self.at
            self.at += 1
            parts.append(("branch", self.condition(), here, [self.statement()]))
            if self.peek() != "else":
                return ("if", "", at, parts)
            last = self.at
            self.at += 1
        parts.append(("else", "", last, [self.statement()]))
        return ("if", "", at, parts)

    def other(self, word: str) -> Node:
        """A statement of a kind that has no node of its own, passed as a whole."""
        at = self.at
        self.at += 1
        if word == "switch":
            self.condition()
            self.statement()
        elif word == "goto":
            self.text_until(";")
        elif word != ";":
            self.text_until(":") if self.peek() != ":" else self.expect(":")
            if self.peek() != "}":
                self.statement()
        return ("undefined", word, at, [])

    def function(self) -> Node:
        name, depth = "", 0
        while depth or self.peek() != "{":
            token = self.next()
            if token == "(" and not depth and not name:
                name = self.tokens[self.at - 2] if self.at > 1 else ""
            depth += {"(": 1, ")": -1}.get(token, 0)
        return ("function", name, 0, [self.braced()])


def parsed(code: str, what: str) -> Node:
    """The tree of a text that is one function or one expression."""
    reader = Reader(code)
    try:
        tree = reader.function() if what == "function" else reader.expression()
        if reader.at < len(reader.tokens):
            raise Malformed("text goes on")
    except (Malformed, RecursionError):
        return ("undefined", "", 0, [])
    return tree


def rows_of(tree: Node) -> Iterator[tuple]:
    """node, parent, position, kind, text, at, parent_at of a tree, parents first."""
    pending, number = [(tree, None, 0, None)], 0
    while pending:
        (kind, text, at, inside), parent, position, parent_at = pending.pop()
        yield number, parent, position, kind, text, at, parent_at
        pending += [(x, number, k, at) for k, x in reversed(list(enumerate(inside)))]
        number += 1


SCHEMA = "id bigint, node bigint, parent bigint, position bigint, kind string, text string, at bigint, parent_at bigint"


def trees(code: DataFrame, what: str = "function") -> DataFrame:
    """A row per node of the tree of each text: ``code`` has id and code, ``what`` is "function" or
    "expression". Nodes are numbered parents first; ``at`` is the number of a node's token.

    A null or blank text has no nodes. A text that is not one whole function (or expression), or is nested
    deeper than Python's stack, has one node of kind "undefined". Repeated rows give repeated trees.
    """
    if what not in ("function", "expression"):
        raise ValueError(f"no trees of a {what}")
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(i, *row) for i, c in zip(frame["id"], frame["code"], strict=True) for row in rows_of(parsed(c, what))]
            yield pd.DataFrame(found, columns=names).astype({"id": "Int64", "parent": "Int64", "parent_at": "Int64"})

    solid = code.select(F.col("id").cast("bigint").alias("id"), "code").where(r"code rlike '\\S'")
    return solid.mapInPandas(run, SCHEMA)


def matched(nodes: DataFrame) -> DataFrame:
    """The expression nodes of the kinds that exercises are made of, with the kind as ``matched``."""

    def of(kind: str, *texts: str) -> Column:
        return (F.col("kind") == kind) & F.col("text").isin(*texts)

    assigns = [o for o, level in BINARY.items() if level == ASSIGNMENT]
    kind = F.when(of("binary", "&&", "||", "+", "-", "*", "/"), F.col("text")).when(of("unary", "!"), F.col("text")).when(of("unary", "-"), "unary -")
    kind = kind.when(F.col("kind").isin("unary", "postfix") & F.col("text").isin("++", "--"), F.col("text"))
    kind = kind.when(of("binary", *assigns), "assignment").when(of("binary", *COMPARISONS), "comparison")
    kind = kind.when(F.col("kind").isin("member_call", "member", "conditional"), F.col("kind"))
    return nodes.withColumn("matched", kind).where("matched is not null")
