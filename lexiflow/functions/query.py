"""Boolean / arithmetic term queries compiled to a Spark ``Column`` (Q1-Q8).

Grammar, loosest to tightest (R's order):
    or   := and (("|" | "||") and)*
    and  := not (("&" | "&&") not)*
    not  := "!" not | cmp
    cmp  := sum (("<" | "<=" | ">" | ">=" | "==" | "!=") sum)?
    sum  := prod (("+" | "-") prod)*
    prod := unary (("*" | "/") unary)*
    unary:= "-" unary | atom
    atom := NUMBER | TERM | "`" any text "`" | "(" or ")"
A term is a run of letters, digits, ``_`` and inner apostrophes. A number
used as a condition means ``<> 0``; a condition used as a number is 1/0.
Parsing is driver-side on one short string; errors are ``ValueError`` with
the position, raised before any Spark job.
"""
from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""
    (?P<ws>\s+)
  | (?P<num>\d+(?:\.\d+)?(?![\w'’]))
  | (?P<bq>`[^`]*`)
  | (?P<term>[^\W]+(?:['’][^\W]+)*)
  | (?P<op>\|\||&&|<=|>=|==|!=|[|&!<>+\-*/()])
""", re.VERBOSE | re.UNICODE)


@dataclass(frozen=True)
class Node:
    kind: str            # num | term | not | neg | bin
    value: object = None
    args: tuple = ()


def lex(text: str) -> list[tuple[str, str, int]]:
    out, i = [], 0
    while i < len(text):
        m = _TOKEN.match(text, i)
        if not m:
            raise ValueError(f"query error at {i}: unexpected {text[i]!r}")
        kind = m.lastgroup
        val = m.group(kind)
        if kind == "bq":
            kind, val = "term", val[1:-1]
        if kind != "ws":
            out.append((kind, val, i))
        i = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.toks = lex(text)
        self.i = 0
        self.text = text

    def peek(self):
        return self.toks[self.i] if self.i < len(self.toks) else ("eof", None, len(self.text))

    def take(self, *ops):
        k, v, _ = self.peek()
        if k == "op" and v in ops:
            self.i += 1
            return v
        return None

    def parse(self) -> Node:
        if not self.toks:
            raise ValueError("query error at 0: empty query")
        node = self.p_or()
        k, v, p = self.peek()
        if k != "eof":
            raise ValueError(f"query error at {p}: unexpected {v!r}")
        return node

    def p_or(self):
        node = self.p_and()
        while self.take("|", "||"):
            node = Node("bin", "|", (node, self.p_and()))
        return node

    def p_and(self):
        node = self.p_not()
        while self.take("&", "&&"):
            node = Node("bin", "&", (node, self.p_not()))
        return node

    def p_not(self):
        if self.take("!"):
            return Node("not", None, (self.p_not(),))
        return self.p_cmp()

    def p_cmp(self):
        node = self.p_sum()
        op = self.take("<", "<=", ">", ">=", "==", "!=")
        if op:
            node = Node("bin", op, (node, self.p_sum()))
        return node

    def p_sum(self):
        node = self.p_prod()
        while True:
            op = self.take("+", "-")
            if not op:
                return node
            node = Node("bin", op, (node, self.p_prod()))

    def p_prod(self):
        node = self.p_unary()
        while True:
            op = self.take("*", "/")
            if not op:
                return node
            node = Node("bin", op, (node, self.p_unary()))

    def p_unary(self):
        if self.take("-"):
            return Node("neg", None, (self.p_unary(),))
        return self.p_atom()

    def p_atom(self):
        k, v, p = self.peek()
        if k == "num":
            self.i += 1
            return Node("num", float(v) if "." in v else int(v))
        if k == "term":
            self.i += 1
            return Node("term", v)
        if self.take("("):
            node = self.p_or()
            if not self.take(")"):
                _, v2, p2 = self.peek()
                raise ValueError(f"query error at {p2}: expected ')'")
            return node
        raise ValueError(f"query error at {p}: unexpected {v if v is not None else 'end'!r}")


def parse(text: str) -> Node:
    return _Parser(text).parse()


def term_forms(term: str, lowercase: bool = True) -> list[str]:
    """dfm features a query term counts: the term itself, lowercased when the
    tokens were lowercased; a term written in upper case (a dictionary key,
    which the lookup puts in upper case) also counts its key form."""
    if not lowercase:
        return [term]
    forms = [term.lower()]
    if term.isupper() and term != term.lower():
        forms.append(term)
    return forms


def written_terms(node: Node) -> list[str]:
    """Terms as written in the query, in order of first use."""
    out: list[str] = []

    def walk(n: Node):
        if n.kind == "term" and n.value not in out:
            out.append(n.value)
        for a in n.args:
            walk(a)
    walk(node)
    return out


def query_terms(node: Node, lowercase: bool = True) -> list[str]:
    """dfm features used by a parsed query, in order of first use."""
    out: list[str] = []

    def walk(n: Node):
        if n.kind == "term":
            for t in term_forms(n.value, lowercase):
                if t not in out:
                    out.append(t)
        for a in n.args:
            walk(a)
    walk(node)
    return out


def compile_query(node: Node, term_col: Callable[[str], Column], lowercase: bool = True
                  ) -> tuple[Column, str]:
    """``(Column, kind)`` with kind ``num`` or ``bool``."""
    def num(c, k):
        return c if k == "num" else c.cast("bigint")

    def boo(c, k):
        return c if k == "bool" else (c != 0)

    def go(n: Node):
        if n.kind == "num":
            return F.lit(n.value), "num"
        if n.kind == "term":
            forms = term_forms(n.value, lowercase)
            c = term_col(forms[0])
            for f in forms[1:]:
                c = c + term_col(f)
            return c, "num"
        if n.kind == "not":
            c, k = go(n.args[0])
            return ~boo(c, k), "bool"
        if n.kind == "neg":
            c, k = go(n.args[0])
            return -num(c, k), "num"
        a, ka = go(n.args[0])
        b, kb = go(n.args[1])
        op = n.value
        if op == "|":
            return boo(a, ka) | boo(b, kb), "bool"
        if op == "&":
            return boo(a, ka) & boo(b, kb), "bool"
        a, b = num(a, ka), num(b, kb)
        if op == "+":
            return a + b, "num"
        if op == "-":
            return a - b, "num"
        if op == "*":
            return a * b, "num"
        if op == "/":
            # as in R: x / 0 is infinite, 0 / 0 is not a number (NULL, never a hit)
            x = a.cast("double")
            return (F.when(b != 0, F.try_divide(x, b.cast("double"))).when(x > 0, F.lit(float("inf")))
                    .when(x < 0, F.lit(float("-inf")))), "num"
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b,
                "==": a == b, "!=": a != b}[op], "bool"
    return go(node)


def result_column(node: Node, term_col: Callable[[str], Column], lowercase: bool = True
                  ) -> Column:
    """Result ``n``: the number, or 1/0 for a condition."""
    c, k = compile_query(node, term_col, lowercase)
    return c.cast("bigint") if k == "bool" else c
