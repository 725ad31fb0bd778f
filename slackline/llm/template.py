"""A small sandboxed template language, compiled to Python closures.

``parse`` makes a syntax tree, ``fold`` computes what holds no variable, ``compile_template`` turns
the tree into closures that append (text, generated?) parts to a list. There is no attribute
access, call or import: names are looked up in the given mapping, ``.key`` and ``[key]`` only in
mappings and lists, filters come from a fixed table.

    {{ expression }}    {# remark #}    {% set name = expression %}
    {% for name in expression %}..{% endfor %}    {% if e %}..{% elif e %}..{% else %}..{% endif %}
    {% generation %}..{% endgeneration %}     marks what a model is to learn to say

Expressions: strings, whole numbers, true, false, none, names, ``.``, ``[]``, ``not``, ``and``,
``or``, ``in``, ``not in``, ``== != < <= > >=``, ``+ - ~``, parentheses, ``| filter``. Inside a
loop, ``loop.index``, ``loop.first`` and ``loop.last`` are known.

A template that can't be read raises TemplateError when it is compiled. One that meets values which
an operator or filter can't take, makes a text longer than ``MOST_CHARS`` or takes more than
``MOST_STEPS`` rounds of its loops raises it when it is rendered, if it gets there.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping
from typing import Any

Part = tuple[str, bool]
Node = tuple


class TemplateError(ValueError):
    pass


#: Bounds of one rendering.
MOST_CHARS, MOST_STEPS = 50_000_000, 1_000_000

_QUOTED = r"""(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')"""
_PIECE = re.compile(rf"(\{{\{{(?:{_QUOTED}|(?!\}}\}})[^'\"])*\}}\}}|\{{%(?:{_QUOTED}|(?!%\}})[^'\"])*%\}}|\{{#.*?#\}})", re.S)
_OPENED = re.compile(r"\{[{%#]")
#: What operators and filters raise on values that they can't take.
_UNFIT = (TypeError, ValueError, LookupError, ArithmeticError, AttributeError)
_TOKEN = re.compile(r"""\s*(?:(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>()\[\].|]))""")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", '"': '"', "'": "'"}
_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "+": lambda a, b: _short(a + b), "-": operator.sub, "~": lambda a, b: _short(_text(a) + _text(b)), "in": lambda a, b: a in b, "not in": lambda a, b: a not in b,
}
_LEVELS = (("or",), ("and",), ("not",), ("in", "not", "==", "!=", "<", "<=", ">", ">="), ("+", "-", "~"))


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _short(value: Any) -> Any:
    if isinstance(value, (str, list, tuple)) and len(value) > MOST_CHARS:
        raise TemplateError(f"a value is longer than {MOST_CHARS}")
    return value


FILTERS: dict[str, Callable[[Any], Any]] = {"trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "length": len, "string": _text}


class _Expression:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else ""

    def next(self) -> tuple[str, str]:
        if self.at == len(self.tokens):
            raise TemplateError("the expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def want(self, op: str) -> None:
        if self.next()[1] != op:
            raise TemplateError(f"{op!r} is missing")

    def whole(self) -> Node:
        node = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def level(self, k: int) -> Node:
        if k == len(_LEVELS):
            return self.filtered()
        if _LEVELS[k] == ("not",):
            if self.peek() == "not":
                self.next()
                return ("not", self.level(k))
            return self.level(k + 1)
        node = self.level(k + 1)
        while self.peek() in _LEVELS[k]:
            op = self.next()[1]
            if op == "not":
                self.want("in")
                op = "not in"
            node = (op if op in ("and", "or") else "binary", *(() if op in ("and", "or") else (op,)), node, self.level(k + 1))
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while self.peek() in (".", "[", "|"):
            op = self.next()[1]
            if op == "[":
                node = ("get", node, self.level(0))
                self.want("]")
            elif op == ".":
                node = ("get", node, ("const", self.next()[1]))
            else:
                node = ("filter", self.next()[1], node)
        return node

    def atom(self) -> Node:
        kind, text = self.next()
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1]))
        if kind == "num":
            return ("const", int(text))
        if text == "(":
            node = self.level(0)
            self.want(")")
            return node
        if kind != "name":
            raise TemplateError(f"unexpected {text!r}")
        return ("const", {"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else ("name", text)


def parse(source: str) -> Node:
    pieces, at = _PIECE.split(source), 0

    def block(ends: tuple[str, ...]) -> tuple[Node, str]:
        nonlocal at
        items: list[Node] = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{#"):
                continue
            if piece.startswith("{{"):
                items.append(("print", _Expression(piece[2:-2]).whole()))
            elif piece.startswith("{%"):
                words = piece[2:-2].strip()
                head, _, rest = words.partition(" ")
                if head in ends:
                    return ("block", tuple(items)), words
                items.append(statement(head, rest))
            elif piece:
                if opened := _OPENED.search(piece):
                    raise TemplateError(f"{opened[0]!r} is not closed")
                items.append(("print", ("const", piece)))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", tuple(items)), ""

    def statement(head: str, rest: str) -> Node:
        if head == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"can't read for {rest!r}")
            return ("for", m[1], _Expression(m[2]).whole(), block(("endfor",))[0])
        if head == "if":
            test, (body, end) = _Expression(rest).whole(), block(("elif", "else", "endif"))
            if end.startswith("elif"):
                return ("if", test, body, statement("if", end[4:]))
            return ("if", test, body, block(("endif",))[0] if end == "else" else ("block", ()))
        if head == "generation":
            return ("generation", block(("endgeneration",))[0])
        if head == "set":
            name, eq, value = rest.partition("=")
            if not eq or not re.fullmatch(r"\s*[A-Za-z_]\w*\s*", name):
                raise TemplateError(f"can't read set {rest!r}")
            return ("set", name.strip(), _Expression(value).whole())
        raise TemplateError(f"unknown statement {head!r}")

    return block(())[0]


def fold(node: Node, filters: Mapping[str, Callable]) -> Node:
    """The same tree with constant parts computed, dead branches dropped and adjacent text joined."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "block":
        out: list[Node] = []
        for item in (fold(x, filters) for x in node[1]):
            for x in item[1] if item[0] == "block" else (item,):
                if x[0] == "print" and x[1][0] == "const":
                    x = ("print", ("const", _text(x[1][1])))
                    if not x[1][1]:
                        continue
                    if out and out[-1][0] == "print" and out[-1][1][0] == "const":
                        x = ("print", ("const", out.pop()[1][1] + x[1][1]))
                out.append(x)
        return ("block", tuple(out))
    if kind == "if":
        test = fold(node[1], filters)
        if test[0] == "const":
            return fold(node[2] if test[1] else node[3], filters)
    node = tuple(fold(x, filters) if isinstance(x, tuple) else x for x in node)
    if kind in ("and", "or") and node[1][0] == "const":
        return node[2] if bool(node[1][1]) == (kind == "and") else node[1]
    if kind in ("not", "binary", "get", "filter") and all(x[0] == "const" for x in node if isinstance(x, tuple)):
        try:
            return ("const", _expression(node, filters)({}))
        except _UNFIT:  # an error only if rendering gets there
            return node
    return node


def _expression(node: Node, filters: Mapping[str, Callable]) -> Callable[[Mapping], Any]:
    kind, parts = node[0], [_expression(x, filters) for x in node[1:] if isinstance(x, tuple)]
    if kind == "const":
        value = node[1]
        return lambda c: value
    if kind == "name":
        name = node[1]
        return lambda c: c.get(name)
    if kind == "not":
        (a,) = parts
        return lambda c: not a(c)
    if kind == "and":
        a, b = parts
        return lambda c: a(c) and b(c)
    if kind == "or":
        a, b = parts
        return lambda c: a(c) or b(c)
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        f, (a,) = filters[node[1]], parts
        return lambda c: f(a(c))
    if kind == "binary":
        op, (a, b) = _BINARY[node[1]], parts
        return lambda c: op(a(c), b(c))
    a, b = parts

    def get(c: Mapping) -> Any:
        of, key = a(c), b(c)
        if isinstance(of, Mapping):
            return of.get(key)
        if isinstance(of, (list, tuple, str)) and isinstance(key, int):
            return of[key] if -len(of) <= key < len(of) else None
        return None

    return get


class _Parts(list):
    """What was rendered, counted as it grows."""

    chars = steps = 0

    def add(self, text: str, mark: bool) -> None:
        self.chars += len(text)
        if self.chars > MOST_CHARS:
            raise TemplateError(f"the text is longer than {MOST_CHARS}")
        self.append((text, mark))

    def step(self) -> None:
        self.steps += 1
        if self.steps > MOST_STEPS:
            raise TemplateError(f"more than {MOST_STEPS} rounds of loops")


def _statement(node: Node, filters: Mapping[str, Callable]) -> Callable[[dict, _Parts, bool], None]:
    kind = node[0]
    if kind == "block":
        steps = [_statement(x, filters) for x in node[1]]

        def run(c: dict, out: _Parts, mark: bool) -> None:
            for step in steps:
                step(c, out, mark)

    elif kind == "print":
        value = _expression(node[1], filters)

        def run(c: dict, out: _Parts, mark: bool) -> None:
            out.add(_text(value(c)), mark)

    elif kind == "generation":
        body = _statement(node[1], filters)

        def run(c: dict, out: _Parts, mark: bool) -> None:
            body(c, out, True)

    elif kind == "set":
        name, value = node[1], _expression(node[2], filters)

        def run(c: dict, out: _Parts, mark: bool) -> None:
            c[name] = value(c)

    elif kind == "if":
        test, yes, no = _expression(node[1], filters), _statement(node[2], filters), _statement(node[3], filters)

        def run(c: dict, out: _Parts, mark: bool) -> None:
            (yes if test(c) else no)(c, out, mark)

    else:
        name, over, body = node[1], _expression(node[2], filters), _statement(node[3], filters)

        def run(c: dict, out: _Parts, mark: bool) -> None:
            items = over(c) or ()
            for k, item in enumerate(items):
                out.step()
                body({**c, name: item, "loop": {"index": k + 1, "first": k == 0, "last": k + 1 == len(items)}}, out, mark)

    return run


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[Mapping[str, Any]], list[Part]]:
    """A function from variables to (text, generated?) parts."""
    known = {**FILTERS, **(filters or {})}
    run = _statement(fold(parse(source), known), known)

    def render(variables: Mapping[str, Any]) -> list[Part]:
        out = _Parts()
        try:
            run(dict(variables), out, False)
        except TemplateError:
            raise
        except _UNFIT as e:
            raise TemplateError(f"can't render: {e}") from e
        return out

    return render
