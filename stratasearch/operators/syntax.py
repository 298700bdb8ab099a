"""Syntax trees of source code without a grammar: a stack machine over tokens.

Strings, comments, words, marks and brackets are found by one pattern. A bracket opens a node that holds what is inside, divided into items by
line ends, commas and semicolons. Outside of brackets, lines are statements, and a line that is indented further than an open
statement belongs to it. Both ways nest, so functions, classes, bodies and argument lists are nodes with their own bounds in any
language that shows its structure by brackets or by indentation. Brackets that don't match are marks like others.

Everything is a loop over tokens, so depth costs no recursion.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache


@dataclass
class Node:
    """A node of a syntax tree; offsets are in bytes."""

    start: int
    end: int
    children: list[Node] = field(default_factory=list)


#: How comments begin up to the end of a line, for languages where that isn't ``//``.
_HASH = "python ruby bash zsh fish perl r yaml toml elixir julia make cmake dockerfile nim crystal coffeescript powershell starlark gdscript awk tcl just nix mojo puppet snakemake"
_DASHES = "sql sql_bigquery lua luau haskell purescript elm ada vhdl agda idris teal"
_SEMICOLON = "commonlisp scheme racket clojure elisp fennel asm janet"
_PERCENT = "matlab erlang prolog latex"
LINE_COMMENTS = {name: mark for names, mark in ((_HASH, b"#"), (_DASHES, b"--"), (_SEMICOLON, b";"), (_PERCENT, b"%")) for name in names.split()}
#: Languages where a single quote may stand alone.
LONE_QUOTES = frozenset("rust ocaml haskell ada commonlisp scheme racket clojure elisp fennel vb asm verilog systemverilog".split())
CLOSING = {b"(": b")", b"[": b"]", b"{": b"}"}


@cache
def _tokens(language: str) -> re.Pattern[bytes]:
    line = LINE_COMMENTS.get(language, b"//")
    one = rb"'(?:\\[^\n]|[^'\\\n])'" if language in LONE_QUOTES else rb"'(?:\\[^\n]|[^'\\\n])*'"
    parts = {
        b"gap": rb"[ \t\f\r]+|\\\r?\n",
        b"line": rb"\n",
        b"note": rb"/\*.*?(?:\*/|\Z)|" + re.escape(line) + rb"[^\n]*",
        b"text": rb'"""(?:\\.|[^\\])*?(?:"""|\Z)|' + rb"'''(?:\\.|[^\\])*?(?:'''|\Z)|" + rb'"(?:\\.|[^"\\\n])*"|' + one + rb"|`(?:\\.|[^`\\])*`",
        b"open": rb"[(\[{]",
        b"close": rb"[)\]}]",
        b"cut": rb"[,;]",
        b"other": rb"[\w\x80-\xff]+|[^\w\s]|\s",
    }
    return re.compile(b"|".join(b"(?P<" + name + b">" + pattern + b")" for name, pattern in parts.items()), re.DOTALL)


class _Frame:
    """An open bracket, or the whole source: its node, what closes it, and the item that is being read."""

    def __init__(self, node: Node, closer: bytes | None):
        self.node, self.closer = node, closer
        self.item: Node | None = None
        self.statements: list[tuple[int, Node]] = []  # open statements by indentation, outside of brackets

    def add(self, child: Node, indent: int) -> None:
        """A child of the item that is being read; the first one begins the item."""
        if self.item is None:
            self.item = Node(child.start, child.end)
            owner = self.node
            if self.closer is None:
                self.leave(indent)
                if self.statements:
                    owner = self.statements[-1][1]
                self.statements.append((indent, self.item))
            owner.children.append(self.item)
        self.item.children.append(child)

    def leave(self, indent: int) -> None:
        """Close the statements that are indented as far or further; what they belong to reaches their end."""
        while self.statements and self.statements[-1][0] >= indent:
            _, done = self.statements.pop()
            if self.statements:
                self.statements[-1][1].end = max(self.statements[-1][1].end, done.end)

    def reach(self, end: int) -> None:
        """The node and its item end no earlier than here."""
        self.node.end = max(self.node.end, end)
        if self.item is not None:
            self.item.end = max(self.item.end, end)


def syntax_tree(data: bytes, language: str) -> Node:
    """The tree of a source; the root spans all of it."""
    root = Node(0, len(data))
    frames = [_Frame(root, None)]
    line_start = 0
    for token in _tokens(language).finditer(data):
        kind, start, end = token.lastgroup, token.start(), token.end()
        frame = frames[-1]
        if kind == "line":
            frame.item = None
            line_start = end
        elif kind == "open":
            node = Node(start, end)
            frame.add(node, start - line_start)
            frames.append(_Frame(node, CLOSING[token.group()]))
        elif kind == "close" and any(f.closer == token.group() for f in frames[-2:]):
            while frames[-1].closer != token.group():  # what was left open inside
                _end(frames, start)
            frames[-1].node.end = end
            _end(frames, end)
        elif kind == "cut":
            frame.add(Node(start, end), start - line_start)
            frame.reach(end)
            frame.item = None
        elif kind != "gap":
            frame.add(Node(start, end), start - line_start)
            frame.reach(end)
            if b"\n" in token.group():  # a text over several lines
                line_start = start + token.group().rindex(b"\n") + 1
    while len(frames) > 1:
        _end(frames, frames[-1].node.end)
    frames[0].leave(-1)
    root.end = len(data)
    return root


def _end(frames: list[_Frame], end: int) -> None:
    """Close the innermost bracket; its bounds reach what it is in."""
    inner = frames.pop()
    inner.node.end = max(inner.node.end, end)
    frames[-1].reach(inner.node.end)
