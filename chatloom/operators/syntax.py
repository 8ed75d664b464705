"""Python source in texts: literals and calls of an expression, and where the parts of calls stand in code, in characters.

The standard parser reads; what it can't read, for whatever reason, is Unreadable. Its positions are bytes of a line and become
characters of the text here."""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate


#: Bits of the largest number that can be written in digits.
WIDEST = 14_000


class Unreadable(ValueError):
    """A text that is no code, or a value that is no literal."""


def parsed(text: str, mode: str) -> ast.AST:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # of escapes that mean nothing
            return ast.parse(text, mode=mode)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise Unreadable(text[:80]) from e


def members(text: str) -> list[ast.expr]:
    """The members of a list, or the one expression that there is."""
    one = parsed(text.strip(), "eval").body
    return one.elts if isinstance(one, ast.List) else [one]


def literal(node: ast.expr | None) -> object:
    """The value of a literal; names stand for themselves, tuples are lists."""
    match node:
        case ast.Constant(value=int() as value) if value.bit_length() > WIDEST:
            raise Unreadable("number")
        case ast.Constant(value=None | bool() | int() | float() | str() as value):
            return value
        case ast.Name(id=name):
            return name
        case ast.List(elts=items) | ast.Tuple(elts=items):
            return [literal(x) for x in items]
        case ast.Dict(keys=keys, values=values):
            return {hashable(literal(k)): literal(v) for k, v in zip(keys, values, strict=True)}
        case ast.UnaryOp(op=ast.USub(), operand=inner):
            value = literal(inner)
            if isinstance(value, int | float):
                return -value
    raise Unreadable("no literal")


def hashable(key: object) -> str | int | float | bool | None:
    if isinstance(key, list | dict):
        raise Unreadable("key")
    return key


def dotted(node: ast.expr) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        raise Unreadable("no name")
    return ".".join([node.id, *reversed(parts)])


def calls(nodes: list[ast.expr]) -> list[dict]:
    """Those of the nodes that are calls: their names and named arguments. Others, positional and unpacked arguments are passed over."""
    return [{"name": dotted(n.func), "arguments": {k.arg: literal(k.value) for k in n.keywords if k.arg is not None}} for n in nodes if isinstance(n, ast.Call)]


class Positions:
    """From lines and bytes to characters of a text."""

    def __init__(self, text: str) -> None:
        self.starts, self.widths = [0], []
        for line in re.split(r"(?<=\n)|(?<=\r)(?!\n)", text):
            self.widths.append(None if line.isascii() else list(accumulate((len(c.encode("utf-8", "surrogatepass")) for c in line), initial=0)))
            self.starts.append(self.starts[-1] + len(line))

    def at(self, line: int, byte: int) -> int:
        widths = self.widths[line - 1]
        return self.starts[line - 1] + (byte if widths is None else bisect_left(widths, byte))

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)


#: What a span is of: 1 a delimiter, 2 a tool's name, 3 an argument's name, 4 a value, 5 a mark that ends.
DELIMITER, TOOL, KEY, VALUE, CLOSING = range(1, 6)
#: The marks that are delimiters in code, and in native blocks.
MARKS, NATIVE_MARKS = frozenset("=(),[]{}:."), frozenset("[](),=")


def code_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, stop, role) of all calls of a program, at any depth, of what their results are given to, and of its marks; without a call none."""
    if "(" not in text:
        return []
    try:
        nodes = list(ast.walk(parsed(text, "exec")))
    except Unreadable:
        return []
    where, out = Positions(text), []
    for node in nodes:
        if isinstance(node, ast.Call):
            out.append((*where.span(node.func), TOOL))
            for value in [*node.args, *(k.value for k in node.keywords)]:
                out.append((*where.span(value), VALUE))
            for k in node.keywords:
                start = where.span(k)[0]
                if k.arg is not None and text.startswith(k.arg, start):
                    out.append((start, start + len(k.arg), KEY))
        elif isinstance(getattr(node, "value", None), ast.Call) and isinstance(node, ast.Assign | ast.AnnAssign):
            out += [(*where.span(target), VALUE) for target in getattr(node, "targets", None) or [node.target]]
    if not any(role == TOOL for _, _, role in out):
        return []
    try:
        for token in tokenize.generate_tokens(io.StringIO(text).readline):  # whose columns are characters
            if token.type == tokenize.OP and token.string in MARKS:
                start = where.starts[token.start[0] - 1] + token.start[1]
                out.append((start, start + 1, DELIMITER))
    except (tokenize.TokenError, SyntaxError):
        return []
    return out


PIECE = re.compile(r"(?P<string>'[^'\\]*(?:\\.[^'\\]*)*'?|\"[^\"\\]*(?:\\.[^\"\\]*)*\"?)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<mark>[()\[\]{},=])|(?P<gap>\s+)|(?P<other>[^\s()\[\]{},='\"A-Za-z_]+)", re.DOTALL)


def native_spans(text: str, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """(start, stop, role) of what stands in a native block, in one pass, whether or not it could be read.

    A word before = names an argument, whose value goes up to the comma or the closing mark of its own level; a word between [ or a comma
    and an opening parenthesis is a tool's name."""
    depth, word, before, last, open_ = 0, None, "", start, []  # open_: depth and start of values that haven't ended; a start of -1 isn't known yet

    def ended(level: int) -> Iterator[tuple[int, int, int]]:
        while open_ and open_[-1][0] >= level:
            begin = open_.pop()[1]
            if begin >= 0:
                yield begin, last, VALUE

    for m in PIECE.finditer(text, start, stop):
        kind, piece = m.lastgroup, m[0]
        if kind == "gap":
            continue
        if kind == "mark":
            if piece in NATIVE_MARKS:
                yield m.start(), m.end(), DELIMITER
            if piece in ",)]}":
                yield from ended(depth)
            if piece == "(" and word and before in ("[", ","):
                yield *word, TOOL
        if open_ and open_[-1][1] < 0 and not (kind == "mark" and piece == "="):
            open_[-1] = (open_[-1][0], m.start())
        if kind == "mark":
            if piece == "=" and word:
                yield *word, KEY
                open_.append((depth, -1))
            depth += (piece in "([{") - (piece in ")]}")
        if kind == "word":
            word = m.span()
        else:
            word, before = None, piece
        last = m.end()
    yield from ended(-stop)
