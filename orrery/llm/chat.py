"""Chat formatting: a compiler for a sandboxed template language.

Source is parsed into a syntax tree, constant parts of the tree are folded, and each node becomes a Python closure;
rendering a conversation calls closures and nothing else. The language has text, {{ expression }}, for (with several
names, a filter, else), if / elif / else, set (of names, fields of a namespace, or a block), macro, raw, comments,
generation blocks (what stands in one is marked as generated), white-space control by "-", literals, lists, mappings,
names, fields, indexes, slices, arithmetic, comparison, in, and / or / not, "a if c else b", ~, filters, tests and methods
by the fixed tables below, the functions range, namespace and dict, and raise_exception. A field is a key of a mapping or
a property of `loop`; no attribute of a Python object can be reached, and nothing else can be called. What the compiler
does not know it refuses, when it compiles: statements, filters, tests, methods, functions, properties of `loop`, and
generation blocks inside of macros and block sets, whose text has no place yet.

Defined results: null roles and texts render as empty; turns come by number (nulls first), then role and text, repeated
rows each for itself; a turn with a null conv_id is a conversation of its own. A conversation for which the template
raises, for whatever reason, has null text and the message in `error`. Texts of any length are rendered whole, up to
`LONGEST` characters for a text that a template makes, which is an error. Other columns are not looked at, whatever their
names; an empty table gives an empty result."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import column

CHATML = (
    "{% for message in messages %}"
    "{{ '<|im_start|>' ~ message.role ~ '\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.content ~ '<|im_end|>' }}{% endgeneration %}"
    "{% else %}{{ message.content ~ '<|im_end|>' }}{% endif %}"
    "{{ '\n' }}"
    "{% endfor %}"
)


class TemplateError(ValueError):
    """The template can't be compiled, or refuses a conversation."""


TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[-+*/%~<>(){}\[\].,:|=]))""",
    re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
WORDS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
LONGEST = 1 << 28


def replaced(x: Any, a: Any, b: Any) -> str:
    x, a, b = text(x), text(a), text(b)
    if len(x) + x.count(a) * (len(b) - len(a)) > LONGEST:
        raise TemplateError("a text grows too long")
    return x.replace(a, b)


def joined(x: Any, sep: Any = "") -> str:
    x, sep = [text(y) for y in x], text(sep)
    if sum(map(len, x)) + len(x) * len(sep) > LONGEST:
        raise TemplateError("a text grows too long")
    return sep.join(x)


FILTERS: dict[str, Callable] = {
    "trim": lambda x: text(x).strip(),
    "upper": lambda x: text(x).upper(),
    "lower": lambda x: text(x).lower(),
    "title": lambda x: text(x).title(),
    "capitalize": lambda x: text(x).capitalize(),
    "length": lambda x: len(x),
    "count": lambda x: len(x),
    "first": lambda x: x[0] if x else None,
    "last": lambda x: x[-1] if x else None,
    "string": lambda x: text(x),
    "safe": lambda x: x,
    "int": lambda x: int(x),
    "float": lambda x: float(x),
    "list": lambda x: list(x),
    "reverse": lambda x: x[::-1],
    "sort": lambda x: sorted(x),
    "items": lambda x: [list(y) for y in x.items()],
    "tojson": lambda x, indent=None: json.dumps(x, ensure_ascii=False, indent=indent),
    "join": joined,
    "default": lambda x, other="", falsy=False: other if x is None or (falsy and not x) else x,
    "replace": replaced,
    "map": lambda x, attribute: [field(y, attribute) for y in x],
    "selectattr": lambda x, key, test="true", *other: [y for y in x if TESTS[test](field(y, key), *other)],
    "rejectattr": lambda x, key, test="true", *other: [y for y in x if not TESTS[test](field(y, key), *other)],
}
TESTS: dict[str, Callable] = {
    "defined": lambda x: x is not None,
    "undefined": lambda x: x is None,
    "none": lambda x: x is None,
    "true": lambda x: bool(x),
    "false": lambda x: not x,
    "string": lambda x: isinstance(x, str),
    "mapping": lambda x: isinstance(x, dict),
    "iterable": lambda x: isinstance(x, (str, list, dict)),
    "sequence": lambda x: isinstance(x, (str, list)),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "odd": lambda x: x % 2 == 1,
    "even": lambda x: x % 2 == 0,
    "divisibleby": lambda x, n: x % n == 0,
    "equalto": lambda x, y: x == y,
    "in": lambda x, y: x in y,
}


def method(kind: type, f: Callable) -> Callable:
    def call(x, *args, **named):
        if not isinstance(x, kind):
            raise TemplateError(f"{type(x).__name__} has no such method")
        return f(x, *args, **named)

    return call


#: what can be called on a text or a mapping
METHODS: dict[str, Callable] = {
    "strip": method(str, lambda x, c=None: x.strip(c)), "lstrip": method(str, lambda x, c=None: x.lstrip(c)), "rstrip": method(str, lambda x, c=None: x.rstrip(c)),
    "upper": method(str, str.upper), "lower": method(str, str.lower), "title": method(str, str.title), "capitalize": method(str, str.capitalize),
    "startswith": method(str, lambda x, y: x.startswith(y)), "endswith": method(str, lambda x, y: x.endswith(y)), "find": method(str, lambda x, y: x.find(y)),
    "split": method(str, lambda x, sep=None, n=-1: x.split(sep, n)), "replace": method(str, replaced), "join": method(str, lambda x, items: joined(items, x)),
    "items": method(dict, lambda x: [list(y) for y in x.items()]), "keys": method(dict, lambda x: list(x)), "values": method(dict, lambda x: list(x.values())),
    "get": method(dict, lambda x, key, other=None: x.get(key, other)),
}


def numbers(*ends: int) -> list[int]:
    x = range(*ends)
    if len(x) > 100_000:
        raise TemplateError("a range of over 100,000")
    return list(x)


class Namespace(dict):
    """A mapping whose fields a template can set, from within loops too."""


FUNCTIONS: dict[str, Callable] = {"range": numbers, "namespace": lambda **named: Namespace(named), "dict": lambda **named: dict(named)}
LOOP = ("index", "index0", "revindex", "revindex0", "first", "last", "length", "previtem", "nextitem")


def text(x: Any) -> str:
    return x if isinstance(x, str) else "" if x is None else str(x)


def arith(op: str, a: Any, b: Any) -> Any:
    if op == "~":
        return text(a) + text(b)
    if op == "+" and isinstance(a, list) and isinstance(b, list):
        return a + b
    if op == "+" and (isinstance(a, str) or isinstance(b, str)) and not (isinstance(a, str) and isinstance(b, str)):
        raise TemplateError(f"can't add {type(a).__name__} and {type(b).__name__}")
    if op == "%" and isinstance(a, str) or op == "*" and not (isinstance(a, (int, float)) and isinstance(b, (int, float))):
        raise TemplateError(f"{op} takes numbers")
    return OPS[op](a, b)


OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "//": lambda a, b: a // b, "%": lambda a, b: a % b,
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b,
}


def field(x: Any, key: Any) -> Any:
    """A key of a mapping or a place in a list or string; None where there is none."""
    if isinstance(x, dict):
        return x.get(key)
    if isinstance(x, (list, str)) and isinstance(key, int):
        return x[key] if -len(x) <= key < len(x) else None
    if x is None:
        return None
    raise TemplateError(f"{type(x).__name__} has no field {key!r}")


# syntax tree: tuples (kind, ...)


def lex(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at : at + 20]!r}")
        at, kind = m.end(), m.lastgroup
        x = m.group(kind)
        if kind == "num":
            x = float(x) if "." in x else int(x)
        elif kind == "str":
            x = re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), x[1:-1], flags=re.S)
        out.append((kind, x))
    return [*out, ("end", "")]


class Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, tokens: list[tuple[str, Any]], macros: set[str] = frozenset()):
        self.tokens, self.at, self.macros = tokens, 0, macros

    def peek(self, *what: Any) -> bool:
        kind, x = self.tokens[self.at]
        return kind in ("op", "name") and x in what

    def take(self, *what: Any) -> Any:
        kind, x = self.tokens[self.at]
        if what and not self.peek(*what):
            raise TemplateError(f"expected {what[0]!r}, found {x!r}")
        self.at += 1
        return x

    def name(self) -> str:
        kind, x = self.tokens[self.at]
        if kind != "name" or x.startswith("_"):
            raise TemplateError(f"{x!r} is no name")
        self.at += 1
        return x

    def ternary(self):
        a = self.either()
        if self.peek("if"):
            self.take()
            c = self.either()
            b = ("const", None)
            if self.peek("else"):
                self.take()
                b = self.ternary()
            return ("if", c, a, b)
        return a

    def either(self):
        a = self.both()
        while self.peek("or"):
            self.take()
            a = ("or", a, self.both())
        return a

    def both(self):
        a = self.negated()
        while self.peek("and"):
            self.take()
            a = ("and", a, self.negated())
        return a

    def negated(self):
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        return self.compared()

    def compared(self):
        a = self.concat()
        while True:
            if self.peek("==", "!=", "<", "<=", ">", ">=", "in"):
                a = ("op", self.take(), a, self.concat())
            elif self.peek("not") and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                a = ("op", "not in", a, self.concat())
            elif self.peek("is"):
                self.take()
                no = self.peek("not") and bool(self.take())
                test = self.name()
                if test not in TESTS:
                    raise TemplateError(f"no test {test!r}")
                one = self.tokens[self.at][0] in ("num", "str") or self.peek("[") or (test in ("in", "equalto", "divisibleby") and not self.peek("("))
                a = ("test", test, a, *(self.plain() if self.peek("(") else [self.concat()] if one else []))
                a = ("not", a) if no else a
            else:
                return a

    def concat(self):
        a = self.sum()
        while self.peek("~"):
            a = ("op", self.take(), a, self.sum())
        return a

    def sum(self):
        a = self.product()
        while self.peek("+", "-"):
            a = ("op", self.take(), a, self.product())
        return a

    def product(self):
        a = self.unary()
        while self.peek("*", "/", "//", "%"):
            a = ("op", self.take(), a, self.unary())
        return a

    def unary(self):
        if self.peek("-"):
            self.take()
            return ("op", "-", ("const", 0), self.unary())
        return self.postfix(self.atom())

    def postfix(self, a):
        while True:
            if self.peek("."):
                self.take()
                key = self.name()
                if self.peek("("):
                    if key not in METHODS:
                        raise TemplateError(f"no method {key!r}")
                    a = ("method", key, a, *self.arguments())
                    continue
                if a == ("name", "loop") and key not in LOOP:
                    raise TemplateError(f"loop has no {key!r}")
                a = ("field", a, ("const", key))
            elif self.peek("["):
                self.take()
                low = None if self.peek(":") else self.ternary()
                if self.peek(":"):
                    self.take()
                    high = None if self.peek("]") else self.ternary()
                    a = ("slice", a, low or ("const", None), high or ("const", None))
                else:
                    a = ("field", a, low)
                self.take("]")
            elif self.peek("|"):
                self.take()
                f = self.name()
                if f not in FILTERS:
                    raise TemplateError(f"no filter {f!r}")
                a = ("filter", f, a, *(self.arguments() if self.peek("(") else ()))
            else:
                return a

    def arguments(self) -> list:
        """Expressions, and ("named", name, expression)."""
        self.take("(")
        out = []
        while not self.peek(")"):
            kind, x = self.tokens[self.at]
            if kind == "name" and self.tokens[self.at + 1] == ("op", "="):
                name = self.name()
                self.take("=")
                out.append(("named", name, self.ternary()))
            else:
                out.append(self.ternary())
            if not self.peek(")"):
                self.take(",")
        self.take(")")
        return out

    def plain(self) -> list:
        out = self.arguments()
        if any(x[0] == "named" for x in out):
            raise TemplateError("a test takes no named arguments")
        return out

    def many(self, end: str) -> list:
        out = []
        while not self.peek(end):
            out.append(self.ternary())
            if not self.peek(end):
                self.take(",")
        self.take(end)
        return out

    def atom(self):
        kind, x = self.tokens[self.at]
        if kind in ("num", "str"):
            self.at += 1
            return ("const", x)
        if self.peek("("):
            self.take()
            a = self.ternary()
            if self.peek(","):
                self.take()
                return ("list", a, *self.many(")"))
            self.take(")")
            return a
        if self.peek("["):
            self.take()
            return ("list", *self.many("]"))
        if self.peek("{"):
            self.take()
            out = []
            while not self.peek("}"):
                out.append(self.ternary())
                self.take(":")
                out.append(self.ternary())
                if not self.peek("}"):
                    self.take(",")
            self.take("}")
            return ("dict", *out)
        name = self.name()
        if name in WORDS:
            return ("const", WORDS[name])
        if name == "raise_exception":
            (a,) = self.plain()
            return ("raise", a)
        if self.peek("("):
            if name not in FUNCTIONS and name not in self.macros:
                raise TemplateError(f"{name!r} can't be called")
            return ("call", name, *self.arguments())
        return ("name", name)

    def end(self):
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")


OPEN = re.compile(r"\{([{%#])([-+]?)")
RAW = re.compile(r"\{%-?\s*endraw\s*(-?)%\}")


def closing(source: str, at: int, kind: str) -> tuple[int, int, bool]:
    """Where what opened before `at` ends, where its tag ends, and whether that tag strips; strings and braces are passed over."""
    shut = {"{": "}}", "%": "%}"}[kind]
    depth = 0
    while True:
        here = at + len(source[at : at + 1000]) - len(source[at : at + 1000].lstrip())
        if not depth and source.startswith(shut, here):
            return here, here + 2, False
        if not depth and source.startswith(("-" + shut, "+" + shut), here):
            return here, here + 3, source[here] == "-"
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at : at + 20]!r}")
        depth += {"{": 1, "}": -1}.get(m["op"] or "", 0)
        at = m.end()


def pieces(source: str, trim_blocks: bool = False, lstrip_blocks: bool = False) -> list[tuple[str, str]]:
    """("text" | "expr" | "stmt", source), with white space controlled."""
    out, at, strip, newline = [], 0, False, False

    def add(stop: int, kind: str, left: str) -> None:
        before = source[at:stop]
        before = before[1:] if newline and before.startswith("\n") else before
        before = before.lstrip() if strip else before
        if left == "-":
            before = before.rstrip()
        elif lstrip_blocks and kind in ("%", "#") and left != "+" and not source[source.rfind("\n", 0, stop) + 1 : stop].strip(" \t"):
            before = before.rstrip(" \t")
        out.append(("text", before))

    while m := OPEN.search(source, at):
        add(m.start(), m[1], m[2])
        if m[1] == "#":
            end = source.find("#}", m.end())
            if end < 0:
                raise TemplateError("a comment has no end")
            strip, at = source[end - 1] == "-", end + 2
        else:
            end, at, strip = closing(source, m.end(), m[1])
            own = source[m.end() : end]
            if m[1] == "%" and own.strip() == "raw":
                stop = RAW.search(source, at)
                if not stop:
                    raise TemplateError("missing 'endraw'")
                inner = source[at : stop.start()]
                inner = inner.lstrip() if strip else inner[1:] if trim_blocks and inner.startswith("\n") else inner
                out.append(("text", inner.rstrip() if source[stop.start() + 2] == "-" else inner))
                strip, at = bool(stop[1]), stop.end()
            else:
                out.append(("expr" if m[1] == "{" else "stmt", own))
        newline = trim_blocks and m[1] != "{"
    add(len(source), "", "")
    return [x for x in out if x[0] != "text" or x[1]]


def parse(source: str, trim_blocks: bool = False, lstrip_blocks: bool = False):
    """The syntax tree of a template: ("block", ...)."""
    todo = pieces(source, trim_blocks, lstrip_blocks)
    at, apart, macros = 0, 0, set()

    def reader(src: str, skip: int = 0) -> Expression:
        e = Expression(lex(src), macros)
        e.at = skip
        return e

    def whole(src: str, skip: int = 0):
        e = reader(src, skip)
        tree = e.ternary()
        e.end()
        return tree

    def names(e: Expression) -> tuple[str, ...]:
        out = [e.name()]
        while e.peek(","):
            e.take()
            out.append(e.name())
        return tuple(out)

    def inside(end: str):
        """A block whose text is not written where it stands."""
        nonlocal apart
        apart += 1
        body = block(end)[0]
        apart -= 1
        return body

    def block(*ends: str):
        nonlocal at
        out = []
        while at < len(todo):
            kind, src = todo[at]
            at += 1
            if kind == "text":
                out.append(("text", ("const", src)))
                continue
            if kind == "expr":
                out.append(("text", whole(src)))
                continue
            e = reader(src)
            word = e.name()
            if word in ends:
                if word not in ("elif",):
                    e.end()
                return ("block", *out), word, src
            if word == "for":
                own = names(e)
                e.take("in")
                items, only = e.either(), ("const", True)
                if e.peek("if"):
                    e.take()
                    only = e.ternary()
                e.end()
                body, word, _ = block("else", "endfor")
                other = block("endfor")[0] if word == "else" else ("block",)
                out.append(("for", own, items, only, body, other))
            elif word == "if":
                arms, other, cond = [], ("block",), whole(src, 1)
                while True:
                    body, word, src = block("elif", "else", "endif")
                    arms.append((cond, body))
                    if word == "elif":
                        cond = whole(src, 1)
                        continue
                    if word == "else":
                        other, _, _ = block("endif")
                    break
                for c, body in reversed(arms):
                    other = ("when", c, body, other)
                out.append(other)
            elif word == "set":
                var = e.name()
                if e.tokens[e.at][0] == "end":
                    out.append(("capture", var, inside("endset")))
                    continue
                key = None
                if e.peek("."):
                    e.take()
                    key = e.name()
                e.take("=")
                value = e.ternary()
                e.end()
                out.append(("set", var, value) if key is None else ("put", var, key, value))
            elif word == "macro":
                name = e.name()
                e.take("(")
                own = []
                while not e.peek(")"):
                    arg, default = e.name(), ("const", None)
                    if e.peek("="):
                        e.take()
                        default = e.ternary()
                    own.append((arg, default))
                    if not e.peek(")"):
                        e.take(",")
                e.take(")")
                e.end()
                macros.add(name)
                out.append(("macro", name, tuple(own), inside("endmacro")))
            elif word == "generation":
                e.end()
                if apart:
                    raise TemplateError("a generation block can't stand in a macro or a block set")
                body, _, _ = block("endgeneration")
                out.append(("generation", body))
            else:
                raise TemplateError(f"no statement {word!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]!r}")
        return ("block", *out), "", ""

    return block()[0]


# folding


def fold(tree):
    """The tree with its constant parts computed, dead arms dropped and neighbouring constant texts joined."""
    if not isinstance(tree, tuple) or tree[0] in ("const", "name"):
        return tree
    kind, *args = tree
    if kind == "macro":
        return (kind, args[0], tuple((a, fold(d)) for a, d in args[1]), fold(args[2]))
    args = [x if kind == "for" and i == 0 else fold(x) if isinstance(x, tuple) else x for i, x in enumerate(args)]
    tree = (kind, *args)
    const = lambda x: isinstance(x, tuple) and x[0] == "const"
    if kind in ("op", "not", "filter", "test", "method", "field", "slice") and all(const(x) for x in args if isinstance(x, tuple)):
        try:
            return ("const", value(tree)({}))
        except Exception:  # it fails when it is run, if it is
            return tree
    if kind == "op" and args[0] == "~" and const(args[2]) and isinstance(args[1], tuple) and args[1][:2] == ("op", "~") and const(args[1][3]):
        return ("op", "~", args[1][2], ("const", text(args[1][3][1]) + text(args[2][1])))
    if kind in ("if", "when") and const(args[0]):
        return args[1] if args[0][1] else args[2]
    if kind in ("and", "or") and const(args[0]):
        return args[1] if bool(args[0][1]) == (kind == "and") else args[0]
    if kind == "block":
        out: list = []
        for x in args:
            for y in x[1:] if x[0] == "block" else (x,):
                if y[0] == "text" and const(y[1]) and out and out[-1][0] == "text" and const(out[-1][1]):
                    out[-1] = ("text", ("const", text(out[-1][1][1]) + text(y[1][1])))
                else:
                    out.append(y)
        return ("block", *out)
    return tree


# closures

MACROS = "macros of the template"  # no name can have spaces


def called(args) -> tuple[list[Callable], list[tuple[str, Callable]]]:
    return [value(x) for x in args if x[0] != "named"], [(x[1], value(x[2])) for x in args if x[0] == "named"]


def value(tree) -> Callable[[dict], Any]:
    kind, *args = tree
    if kind == "const":
        x = args[0]
        return lambda env: x
    if kind == "name":
        name = args[0]
        return lambda env: env.get(name)
    if kind == "op":
        op, a, b = args[0], value(args[1]), value(args[2])
        if op == "~":
            return lambda env: text(a(env)) + text(b(env))
        if op in ("==", "!=", "<", "<=", ">", ">=", "in", "not in"):
            f = OPS[op]
            return lambda env: f(a(env), b(env))
        return lambda env: arith(op, a(env), b(env))
    if kind == "field":
        a, b = map(value, args)
        return lambda env: field(a(env), b(env))
    if kind == "slice":
        a, b, c = map(value, args)
        return lambda env: a(env)[b(env) : c(env)]
    if kind == "list":
        items = [value(x) for x in args]
        return lambda env: [x(env) for x in items]
    if kind == "not":
        a = value(args[0])
        return lambda env: not a(env)
    if kind == "and":
        a, b = map(value, args)
        return lambda env: a(env) and b(env)
    if kind == "or":
        a, b = map(value, args)
        return lambda env: a(env) or b(env)
    if kind == "if":
        c, a, b = map(value, args)
        return lambda env: a(env) if c(env) else b(env)
    if kind == "dict":
        pairs = [(value(k), value(v)) for k, v in zip(args[0::2], args[1::2], strict=True)]
        return lambda env: {k(env): v(env) for k, v in pairs}
    if kind in ("filter", "test", "method"):
        f, a = {"filter": FILTERS, "test": TESTS, "method": METHODS}[kind][args[0]], value(args[1])
        rest, named = called(args[2:])
        return lambda env: f(a(env), *(x(env) for x in rest), **{k: x(env) for k, x in named})
    if kind == "call":
        name = args[0]
        rest, named = called(args[1:])
        if name in FUNCTIONS:
            f = FUNCTIONS[name]
            return lambda env: f(*(x(env) for x in rest), **{k: x(env) for k, x in named})
        return lambda env: env[MACROS][name](env, [x(env) for x in rest], {k: x(env) for k, x in named})
    if kind == "raise":
        a = value(args[0])

        def fail(env):
            raise TemplateError(text(a(env)))

        return fail
    raise TemplateError(f"no expression {kind!r}")


class Out:
    """Rendered parts, their length so far, and the spans that are marked as generated."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, x: str) -> None:
        self.parts.append(x)
        self.size += len(x)
        if self.size > LONGEST:
            raise TemplateError("a text grows too long")


def action(tree) -> Callable[[dict, Out], None]:
    kind, *args = tree
    if kind == "text":
        if args[0][0] == "const":
            x = text(args[0][1])
            return lambda env, out: out.add(x)
        f = value(args[0])
        return lambda env, out: out.add(text(f(env)))
    if kind == "block":
        parts = [action(x) for x in args]
        if len(parts) == 1:
            return parts[0]

        def run(env, out):
            for p in parts:
                p(env, out)

        return run
    if kind == "when":
        c, a, b = value(args[0]), action(args[1]), action(args[2])
        return lambda env, out: a(env, out) if c(env) else b(env, out)
    if kind == "set":
        name, f = args[0], value(args[1])
        return lambda env, out: env.__setitem__(name, f(env))
    if kind == "generation":
        body = action(args[0])

        def marked(env, out):
            start = out.size
            body(env, out)
            out.spans.append((start, out.size))

        return marked
    if kind == "put":
        name, key, f = args[0], args[1], value(args[2])

        def put(env, out):
            if not isinstance(env.get(name), Namespace):
                raise TemplateError(f"{name!r} is no namespace")
            env[name][key] = f(env)

        return put
    if kind == "capture":
        name, body = args[0], action(args[1])

        def capture(env, out):
            own = Out()
            body(env, own)
            env[name] = "".join(own.parts)

        return capture
    if kind == "macro":
        name, own, body = args[0], [(a, value(d)) for a, d in args[1]], action(args[2])

        def run(env, given, named):
            if len(given) > len(own) or set(named) - {a for a, _ in own[len(given) :]}:
                raise TemplateError(f"{name!r} doesn't take these arguments")
            inner = dict(env)
            for i, (a, d) in enumerate(own):
                inner[a] = given[i] if i < len(given) else named[a] if a in named else d(inner)
            out = Out()
            body(inner, out)
            return "".join(out.parts)

        return lambda env, out: env[MACROS].__setitem__(name, run)
    if kind == "for":
        own, items, only, body, other = args[0], value(args[1]), value(args[2]), action(args[3]), action(args[4])

        def named(env, x):
            if len(own) == 1:
                env[own[0]] = x
                return
            if not isinstance(x, list) or len(x) != len(own):
                raise TemplateError(f"can't give {len(own)} names to {type(x).__name__}")
            env.update(zip(own, x, strict=True))

        def loop(env, out):
            inner, every = dict(env), []  # what a loop sets stays in it
            for x in items(env) or ():
                named(inner, x)
                if only(inner):
                    every.append(x)
            n = len(every)
            for i, x in enumerate(every):
                named(inner, x)
                near = {"previtem": every[i - 1] if i else None, "nextitem": every[i + 1] if i + 1 < n else None}
                inner["loop"] = {"index": i + 1, "index0": i, "revindex": n - i, "revindex0": n - i - 1, "first": i == 0, "last": i == n - 1, "length": n, **near}
                body(inner, out)
            if not every:
                other(env, out)

        return loop
    raise TemplateError(f"no statement {kind!r}")


def compile_template(source: str, trim_blocks: bool = False, lstrip_blocks: bool = False) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of names (messages=[{"role": ..., "content": ...}]) that gives the text and its generated spans.

    trim_blocks drops a line end behind a statement, lstrip_blocks the blanks before one that begins a line."""
    run = action(fold(parse(source, trim_blocks, lstrip_blocks)))

    def render(**names: Any) -> tuple[str, list[tuple[int, int]]]:
        out = Out()
        run({**names, MACROS: {}}, out)
        return "".join(out.parts), out.spans

    return render


def render_conversations(turns: DataFrame, template: str = CHATML, trim_blocks: bool = False, lstrip_blocks: bool = False, **names: Any) -> DataFrame:
    """conv_id, n_turns, rendered, generated ("start:end" in characters, by comma), n_generated (characters), error."""
    compile_template(template, trim_blocks, lstrip_blocks)  # a template that can't be compiled fails here
    t = turns.select(column(turns, "conv_id").cast("long").alias("conv_id"), column(turns, "turn").cast("long").alias("turn"), column(turns, "role").cast("string").alias("role"), column(turns, "text").cast("string").alias("content"))
    turn = F.struct("turn", "role", "content")
    convs = t.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("m"))
    convs = convs.unionByName(t.filter("conv_id is null").select("conv_id", F.array(turn).alias("m")))

    @F.pandas_udf("rendered string, generated string, n_generated long, error string")
    def run(roles: pd.Series, contents: pd.Series) -> pd.DataFrame:
        render = compile_template(template, trim_blocks, lstrip_blocks)
        out = []
        for r, c in zip(roles, contents, strict=True):
            try:
                x, spans = render(messages=[{"role": a or "", "content": b or ""} for a, b in zip(r, c, strict=True)], **names)
                out.append((x, ",".join(f"{a}:{b}" for a, b in spans), sum(b - a for a, b in spans), None))
            except Exception as e:  # whatever a template does to a conversation is that conversation's error
                out.append((None, None, None, str(e) or type(e).__name__))
        return pd.DataFrame(out, columns=["rendered", "generated", "n_generated", "error"]).astype({"n_generated": "Int64"})

    done = convs.select("conv_id", F.size("m").cast("long").alias("n_turns"), run(F.col("m.role"), F.col("m.content")).alias("r"))
    return done.select("conv_id", "n_turns", "r.*")


SQL = """
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT *, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' AS body FROM t
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, alone ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM p
)
SELECT conv_id, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY turn, role, text) AS rendered,
  coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS generated,
  CAST(coalesce(sum(length(body)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS n_generated, CAST(NULL AS VARCHAR) AS error
FROM o GROUP BY conv_id, alone
"""
