"""A small sandboxed template language, compiled to Python closures.

Text with ``{{ expression }}`` and the statements ``{% for x in name %}``, ``{% if %}``,
``{% elif %}``, ``{% else %}``, ``{% set x = ... %}`` and ``{% generation %}`` (what a
model is trained on), each closed by ``{% end... %}``; ``{# comments #}`` and ``-`` beside
a delimiter (drops the white space there) work as usual. Expressions have strings,
numbers, true, false, none, names, ``a.b``, ``a['b']``, ``~`` and ``+``, comparisons,
``in``, ``and``, ``or``, ``not``, brackets and filters.

Sandboxed: there are no calls, ``.`` and ``[]`` look into mappings and lists only, and
filters are those given. A loop takes its items one by one, so it can run over a stream.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

PIECE = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.DOTALL)
TOKEN = re.compile(r"""\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-~+<>|.()\[\]=,]))""")
ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}
COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}

Scope = dict[str, Any]
#: A piece of output and whether it lies in a generation block.
Output = Iterator[tuple[str, bool]]


class TemplateError(ValueError):
    pass


# ---------------------------------------------------------------- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """An operator or a filter over operands."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Show:
    what: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    tests: tuple  # (condition, body), the last condition may be Const(True)


@dataclass(frozen=True)
class Assign:
    name: str
    what: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---------------------------------------------------------------- parsing


class _Expression:
    def __init__(self, source: str) -> None:
        self.source, self.tokens, self.at = source, [], 0
        at, end = 0, len(source.rstrip())
        while at < end:
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(m.group().strip())
            at = m.end()

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> str | None:
        if (token := self.peek()) is not None and (not wanted or token in wanted):
            self.at += 1
            return token
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing in {self.source!r}")

    def name(self) -> str:
        token = self.take()
        if token is None or not token.isidentifier():
            raise TemplateError(f"a name is missing in {self.source!r}")
        return token

    def whole(self) -> Any:
        tree = self.either()
        if self.peek() is not None:
            raise TemplateError(f"{self.peek()!r} is too much in {self.source!r}")
        return tree

    def either(self) -> Any:
        tree = self.both()
        while self.take("or"):
            tree = Apply("or", (tree, self.both()))
        return tree

    def both(self) -> Any:
        tree = self.negated()
        while self.take("and"):
            tree = Apply("and", (tree, self.negated()))
        return tree

    def negated(self) -> Any:
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        tree = self.joined()
        while token := self.take(*COMPARE, "in"):
            tree = Apply(token, (tree, self.joined()))
        return tree

    def joined(self) -> Any:
        tree = self.filtered()
        while token := self.take("~", "+"):
            tree = Apply(token, (tree, self.filtered()))
        return tree

    def filtered(self) -> Any:
        tree = self.item()
        while self.take("|"):
            tree = Apply("|" + self.name(), (tree,))
        return tree

    def item(self) -> Any:
        tree = self.atom()
        while token := self.take(".", "["):
            if token == ".":
                tree = Item(tree, Const(self.name()))
            else:
                tree = Item(tree, self.either())
                self.need("]")
        return tree

    def atom(self) -> Any:
        token = self.take()
        if token is None:
            raise TemplateError(f"{self.source!r} ends too early")
        if token == "(":
            tree = self.either()
            self.need(")")
            return tree
        if token[0] in "'\"":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPED.get(m[1], m[1]), token[1:-1], flags=re.DOTALL))
        if token.isdigit():
            return Const(int(token))
        if token in ("true", "false", "none"):
            return Const({"true": True, "false": False}.get(token))
        if not token.isidentifier():
            raise TemplateError(f"{token!r} is out of place in {self.source!r}")
        return Name(token)


def _pieces(source: str) -> list[tuple[str, str]]:
    """("text" | "show" | "do", content), white space beside a ``-`` dropped."""
    out, at, strip = [], 0, False
    for m in PIECE.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        before, strip = bool(m[1] or m[4] or m[7]), bool(m[3] or m[6] or m[8])
        out.append(("text", text.rstrip() if before else text))
        if m[2] is not None:
            out.append(("show", m[2]))
        elif m[5] is not None:
            out.append(("do", m[5].strip()))
        at = m.end()
    rest = source[at:]
    return [*out, ("text", rest.lstrip() if strip else rest)]


class _Parser:
    def __init__(self, source: str) -> None:
        self.pieces, self.at = _pieces(source), 0

    def block(self, *ends: str) -> tuple[tuple, str]:
        """The nodes up to one of the statements `ends`, and that statement."""
        nodes: list = []
        while self.at < len(self.pieces):
            kind, content = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                nodes += [Text(content)] if content else []
            elif kind == "show":
                nodes.append(Show(_Expression(content).whole()))
            else:
                word = content.split(None, 1)[0] if content else ""
                if word in ends:
                    return tuple(nodes), content
                nodes.append(self.statement(word, content))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(nodes), ""

    def statement(self, word: str, content: str) -> Any:
        tokens = _Expression(content)
        tokens.take()
        if word == "for":
            name = tokens.name()
            tokens.need("in")
            over = tokens.whole()
            return For(name, over, self.block("endfor")[0])
        if word == "set":
            name = tokens.name()
            tokens.need("=")
            return Assign(name, tokens.whole())
        if word == "generation":
            return Generation(self.block("endgeneration")[0])
        if word == "if":
            tests = []
            condition = tokens.whole()
            while True:
                body, end = self.block("elif", "else", "endif")
                tests.append((condition, body))
                if end == "endif":
                    return If(tuple(tests))
                if end == "else":
                    return If((*tests, (Const(True), self.block("endif")[0])))
                after = _Expression(end)
                after.take()
                condition = after.whole()
        raise TemplateError(f"unknown statement {content!r}")


# ---------------------------------------------------------------- constant folding


def _text_of(value: Any) -> str:
    return "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


def _calculate(name: str, args: list, filters: dict[str, Callable]) -> Any:
    if name == "not":
        return not args[0]
    if name == "and":
        return args[0] and args[1]
    if name == "or":
        return args[0] or args[1]
    if name == "~":
        return _text_of(args[0]) + _text_of(args[1])
    if name == "+":
        return args[0] + args[1]
    if name == "in":
        return args[0] in args[1]
    if name in COMPARE:
        return COMPARE[name](*args)
    return filters[name[1:]](args[0])


def _look(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    raise TemplateError(f"{type(of).__name__} has no items")


def _fold(tree: Any, filters: dict[str, Callable]) -> Any:
    if isinstance(tree, Item):
        return Item(_fold(tree.of, filters), _fold(tree.key, filters))
    if isinstance(tree, Apply):
        if tree.name[0] == "|" and tree.name[1:] not in filters:
            raise TemplateError(f"unknown filter {tree.name[1:]!r}")
        args = tuple(_fold(a, filters) for a in tree.args)
        if all(isinstance(a, Const) for a in args):
            return Const(_calculate(tree.name, [a.value for a in args], filters))
        if tree.name in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (tree.name == "and") else args[0]
        return Apply(tree.name, args)
    return tree


def _fold_block(nodes: Iterable, filters: dict[str, Callable]) -> tuple:
    out: list = []

    def add(node: Any) -> None:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].value + node.value)
        elif not (isinstance(node, Text) and not node.value):
            out.append(node)

    for node in nodes:
        if isinstance(node, Show):
            what = _fold(node.what, filters)
            add(Text(_text_of(what.value)) if isinstance(what, Const) else Show(what))
        elif isinstance(node, If):
            tests = []
            for condition, body in node.tests:
                condition = _fold(condition, filters)
                if isinstance(condition, Const) and not condition.value:
                    continue
                tests.append((condition, _fold_block(body, filters)))
                if isinstance(condition, Const):
                    break
            if tests and isinstance(tests[0][0], Const):
                for inner in tests[0][1]:
                    add(inner)
            elif tests:
                add(If(tuple(tests)))
        elif isinstance(node, For):
            add(For(node.name, _fold(node.over, filters), _fold_block(node.body, filters)))
        elif isinstance(node, Assign):
            add(Assign(node.name, _fold(node.what, filters)))
        elif isinstance(node, Generation):
            add(Generation(_fold_block(node.body, filters)))
        else:
            add(node)
    return tuple(out)


# ---------------------------------------------------------------- closures


def _value(tree: Any, filters: dict[str, Callable]) -> Callable[[Scope], Any]:
    if isinstance(tree, Const):
        return lambda scope, value=tree.value: value
    if isinstance(tree, Name):
        return lambda scope, name=tree.name: scope.get(name)
    if isinstance(tree, Item):
        of, key = _value(tree.of, filters), _value(tree.key, filters)
        return lambda scope: _look(of(scope), key(scope))
    args = [_value(a, filters) for a in tree.args]
    if tree.name == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if tree.name == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    return lambda scope, name=tree.name: _calculate(name, [a(scope) for a in args], filters)


def _body(nodes: tuple, filters: dict[str, Callable], learnt: bool) -> Callable[[Scope], Output]:
    steps = [_step(node, filters, learnt) for node in nodes]

    def run(scope: Scope) -> Output:
        for step in steps:
            yield from step(scope)

    return run


def _step(node: Any, filters: dict[str, Callable], learnt: bool) -> Callable[[Scope], Iterable]:
    if isinstance(node, Text):
        piece = ((node.value, learnt),)
        return lambda scope: piece
    if isinstance(node, Show):
        what = _value(node.what, filters)
        return lambda scope: ((_text_of(what(scope)), learnt),)
    if isinstance(node, Generation):
        return _body(node.body, filters, True)
    if isinstance(node, Assign):
        assigned = _value(node.what, filters)

        def assign(scope: Scope) -> Iterable:
            scope[node.name] = assigned(scope)
            return ()

        return assign
    if isinstance(node, If):
        tests = [(_value(condition, filters), _body(body, filters, learnt)) for condition, body in node.tests]

        def choose(scope: Scope) -> Iterable:
            return next((body(scope) for condition, body in tests if condition(scope)), ())

        return choose
    over, body = _value(node.over, filters), _body(node.body, filters, learnt)

    def loop(scope: Scope) -> Output:
        items = iter(over(scope) or ())
        item = next(items, loop)
        index = 0
        while item is not loop:
            after = next(items, loop)
            inner = {**scope, node.name: item, "loop": {"index": index + 1, "index0": index, "first": not index, "last": after is loop}}
            yield from body(inner)
            item, index = after, index + 1

    return loop


def compile_template(source: str, filters: dict[str, Callable[[Any], Any]]) -> Callable[[Scope], Output]:
    """A function from the values of names to pieces of output: (text, in a generation block)."""
    tree, _ = _Parser(source).block()
    run = _body(_fold_block(tree, filters), filters, False)
    return lambda scope: run(dict(scope))
