"""Chat formatting by a template compiler.

A small template language is parsed into a syntax tree, constants are folded, and the tree becomes
nested Python closures that write a conversation and the character spans under its generation
markers. The language is sandboxed: a name reads the variables given to it, a dot reads a key of a
mapping or a field of ``loop``, filters come from a fixed table, and there are no calls.

    {{ expression | filter }}   {% for x in xs %} … {% endfor %}   {% set x = expression %}
    {% if a %} … {% elif b %} … {% else %} … {% endif %}   {% generation %} … {% endgeneration %}
    a hyphen inside a mark ({%- -%} {{- -}}) trims the white space of the text beyond it
    expressions, tightest first: names a.b 'text' numbers true false none ( ), + ~, == != < >, not, and, or

Defined cases: a null text or role is an empty one; turns are ordered by (turn, role, text) with
nulls first, so ties and repeated rows have one order; a null conv_id is a conversation of its own;
other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- control strings

#: The strings by which the default template marks turns.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<<END>>")
_CONTROL_PLAIN = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL))
_CONTROL_MARKED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROL))


def escape_control(text: str) -> str:
    """One more backslash after the first character of every control string, plain or escaped.

    Strings may overlap (``<<s>``), so the search goes on one character after each find.
    """
    cuts, at = [], 0
    while m := _CONTROL_PLAIN.search(text, at):
        cuts.append(m.start() + 1)
        at = m.start() + 1
    if not cuts:
        return text
    out, last = [], 0
    for c in cuts:
        out += (text[last:c], "\\")
        last = c
    return "".join(out) + text[last:]


def unescape_control(text: str) -> str:
    """The inverse of ``escape_control``."""
    cuts, at = [], 0
    while m := _CONTROL_MARKED.search(text, at):
        cuts.append(m.start() + 1)
        at = m.start() + 1
    if not cuts:
        return text
    out, last = [], 0
    for c in cuts:
        out.append(text[last:c])
        last = c + 1
    return "".join(out) + text[last:]


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape_control(str(x)),
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
}

# ---------------------------------------------------------------- syntax tree


class TemplateError(ValueError):
    """A template that does not parse, or that reads what it may not."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    name: str


@dataclass(frozen=True)
class Filtered:
    of: Any
    name: str


@dataclass(frozen=True)
class Unary:
    of: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Choice:
    arms: tuple  # of (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAGS = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}", re.S)
_TOKENS = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[<>()|.~+]))")
_OPS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "+": lambda a, b: a + b,
    "~": lambda a, b: f"{a}{b}",
}
#: Loosest first; ``and`` and ``or`` short-circuit and so are not in the table above.
_LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", ">"), ("+", "~"))
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def all(self) -> Any:
        node = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def level(self, k: int) -> Any:
        if k == len(_LEVELS):
            return self.postfix()
        if _LEVELS[k] == ("not",):
            if self.peek() != "not":
                return self.level(k + 1)
            self.take()
            return Unary(self.level(k))
        node = self.level(k + 1)
        while self.peek() in _LEVELS[k]:
            op = self.take()[1]
            node = Binary(op, node, self.level(k + 1))
        return node

    def postfix(self) -> Any:
        node = self.atom()
        while self.peek() in (".", "|"):
            op, (kind, name) = self.take()[1], self.take()
            if kind != "name" or name.startswith("_"):
                raise TemplateError(f"{name!r} may not follow {op!r}")
            if op == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Field(node, name) if op == "." else Filtered(node, name)
        return node

    def atom(self) -> Any:
        kind, value = self.take()
        if kind == "num":
            return Const(int(value))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            if value.startswith("_"):
                raise TemplateError(f"the name {value!r} is not allowed")
            return Const({"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Name(value)
        if value == "(":
            node = self.level(0)
            if self.take()[1] != ")":
                raise TemplateError("a parenthesis is not closed")
            return node
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    pieces: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _TAGS.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        text = text.rstrip() if m[1] or m[4] else text
        if text:
            pieces.append(("text", text))
        pieces.append(("out", m[2]) if m[2] is not None else ("tag", m[5].strip()))
        at, trim = m.end(), bool(m[3] or m[6])
    if at < len(source):
        pieces.append(("text", source[at:].lstrip() if trim else source[at:]))
    pieces.reverse()

    def body(*ends: str) -> tuple[tuple, str]:
        nodes: list[Any] = []
        while pieces:
            kind, value = pieces.pop()
            if kind == "text":
                nodes.append(Output(Const(value)))
                continue
            if kind == "out":
                nodes.append(Output(_Expression(value).all()))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return tuple(nodes), value
            if word == "for" and (m := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
                nodes.append(Loop(m[1], _Expression(m[2]).all(), body("endfor")[0]))
            elif word == "if":
                arms, condition = [], _Expression(rest).all()
                while True:
                    inner, end = body("elif", "else", "endif")
                    arms.append((condition, inner))
                    if end == "endif":
                        break
                    if end == "else":
                        arms.append((Const(True), body("endif")[0]))
                        break
                    condition = _Expression(end.partition(" ")[2]).all()
                nodes.append(Choice(tuple(arms)))
            elif word == "set" and (m := re.fullmatch(r"([A-Za-z]\w*)\s*=(?!=)\s*(.+)", rest.strip(), re.S)):
                nodes.append(Assign(m[1], _Expression(m[2]).all()))
            elif word == "generation":
                nodes.append(Generation(body("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected tag {value!r}")
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return tuple(nodes), ""

    return body()[0]


def fold(node: Any) -> Any:
    """The tree with constant expressions, choices and neighbouring texts folded."""
    if isinstance(node, tuple):
        out: list[Any] = []
        for x in map(fold, node):
            parts = x if isinstance(x, tuple) else (x,)
            for p in parts:
                if isinstance(p, Output) and isinstance(p.value, Const) and out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                    out[-1] = Output(Const(f"{out[-1].value.value}{p.value.value}"))
                else:
                    out.append(p)
        return tuple(out)
    if isinstance(node, Filtered):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filtered(of, node.name)
    if isinstance(node, Unary):
        of = fold(node.of)
        return Const(not of.value) if isinstance(of, Const) else Unary(of)
    if isinstance(node, Binary):
        left, right = fold(node.left), fold(node.right)
        if isinstance(left, Const):
            if node.op == "and":
                return right if left.value else left
            if node.op == "or":
                return left if left.value else right
            if isinstance(right, Const):
                return Const(_OPS[node.op](left.value, right.value))
        return Binary(node.op, left, right)
    if isinstance(node, Field):
        return Field(fold(node.of), node.name)
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value))
    if isinstance(node, Loop):
        return Loop(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, Choice):
        arms = []
        for condition, inner in node.arms:
            condition = fold(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            arms.append((condition, fold(inner)))
            if isinstance(condition, Const):
                break
        if arms and isinstance(arms[0][0], Const):
            return arms[0][1]
        return Choice(tuple(arms)) if arms else ()
    return node


# ---------------------------------------------------------------- closures


class _Writer:
    __slots__ = ("parts", "length", "spans")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []


def _value(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):

        def read(env: dict, name: str = node.name) -> Any:
            if name not in env:
                raise TemplateError(f"no variable {name!r}")
            return env[name]

        return read
    if isinstance(node, Field):
        of = _value(node.of)

        def field(env: dict, name: str = node.name) -> Any:
            at = of(env)
            if not isinstance(at, dict) or name not in at:
                raise TemplateError(f"no field {name!r}")
            return at[name]

        return field
    if isinstance(node, Filtered):
        of, f = _value(node.of), FILTERS[node.name]
        return lambda env: f(of(env))
    if isinstance(node, Unary):
        of = _value(node.of)
        return lambda env: not of(env)
    left, right = _value(node.left), _value(node.right)
    if node.op == "and":
        return lambda env: left(env) and right(env)
    if node.op == "or":
        return lambda env: left(env) or right(env)
    op = _OPS[node.op]
    return lambda env: op(left(env), right(env))


def _block(nodes: tuple) -> Callable[[dict, _Writer], None]:
    steps = [_step(n) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, to: _Writer) -> None:
        for s in steps:
            s(env, to)

    return run


def _step(node: Any) -> Callable[[dict, _Writer], None]:
    if isinstance(node, Output):
        value = _value(node.value)

        def write(env: dict, to: _Writer) -> None:
            text = value(env)
            text = text if isinstance(text, str) else "" if text is None else str(text)
            to.parts.append(text)
            to.length += len(text)

        return write
    if isinstance(node, Assign):
        value = _value(node.value)

        def assign(env: dict, to: _Writer) -> None:
            env[node.name] = value(env)

        return assign
    if isinstance(node, Generation):
        body = _block(node.body)

        def mark(env: dict, to: _Writer) -> None:
            start = to.length
            body(env, to)
            to.spans.append((start, to.length))

        return mark
    if isinstance(node, Choice):
        arms = [(_value(c), _block(b)) for c, b in node.arms]

        def choose(env: dict, to: _Writer) -> None:
            for condition, body in arms:
                if condition(env):
                    body(env, to)
                    return

        return choose
    over, body = _value(node.over), _block(node.body)

    def loop(env: dict, to: _Writer) -> None:
        items = list(over(env))
        for i, x in enumerate(items):
            body(env | {node.name: x, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(items) - 1}}, to)

    return loop


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """``render(**variables)`` giving the text and the spans under generation markers."""
    body = _block(fold(parse(source)))

    def render(**variables: Any) -> tuple[str, list[tuple[int, int]]]:
        to = _Writer()
        body(dict(variables), to)
        return "".join(to.parts), to.spans

    return render


#: Marks every turn of any role, so that the turns can be read back from the output.
DEFAULT_TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}<s>[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}{{ ' ' }}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}<<SYS>>\n{{ m.text | escape }}\n<</SYS>>\n"
    "{% else %}<<ROLE>>{{ m.role | escape }}<</ROLE>>{{ m.text | escape }}<<END>>"
    "{% endif %}{% endfor %}"
)
#: How each turn of the default template begins, and how its text ends; the role of the last is in the output.
_TURNS = (("<s>[INST] ", " [/INST]", "user"), (" ", "</s>", "assistant"), ("<<SYS>>\n", "\n<</SYS>>\n", "system"), ("<<ROLE>>", "<<END>>", None))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of what the default template has written."""
    out, at = [], 0
    while at < len(formatted):
        for begin, end, role in _TURNS:
            if formatted.startswith(begin, at):
                start = at + len(begin)
                if role is None:
                    stop = formatted.index("<</ROLE>>", start)
                    role, start = unescape_control(formatted[start:stop]), stop + len("<</ROLE>>")
                stop = formatted.index(end, start)
                out.append((role, unescape_control(formatted[start:stop])))
                at = stop + len(end)
                break
        else:
            raise ValueError(f"no turn begins at {at}")
    return out


def format_conversations(rows: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """Rows by turn to one row a conversation: conv_id, formatted, spans (array of start and end)."""
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        for frame in frames:
            done = [render(messages=[{"role": t["role"] or "", "text": t["text"] or ""} for t in turns]) for turns in frame["turns"]]
            yield pd.DataFrame({"conv_id": frame["conv_id"], "formatted": [d[0] for d in done], "spans": [[list(s) for s in d[1]] for d in done]})

    kind = rows.schema["conv_id"].dataType.simpleString()
    return grouped.mapInPandas(run, f"conv_id {kind}, formatted string, spans array<array<bigint>>")


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """What is read back from the output of the default template, as digests."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, spans in zip(frame["formatted"], frame["spans"], strict=True):
                turns = read_back(text)
                loss = "".join(unescape_control(text[s:e]) for s, e in spans)
                out.append(
                    (
                        len(turns),
                        hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                        len(loss),
                        hashlib.sha256(loss.encode()).hexdigest(),
                        len(text),
                    )
                )
            made = pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            made.insert(0, "conv_id", frame["conv_id"].to_numpy())
            yield made

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInPandas(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
