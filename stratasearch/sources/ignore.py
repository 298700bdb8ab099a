"""Ignore files: patterns with the semantics of gitignore, the last matching pattern deciding."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import PurePosixPath

# Directories that are never scanned, and the names of ignore files.
IGNORED_DIRECTORIES = (
    ".git/", ".hg/", ".svn/", "__pycache__/", "node_modules/", ".venv/", "venv/", ".tox/", ".mypy_cache/", ".pytest_cache/",
    ".ruff_cache/", ".cache/", ".next/", "dist/", "build/", ".eggs/", "vendor/", "third_party/", "libs/", "bower_components/",
)
GIT_IGNORE, OWN_IGNORE = ".gitignore", ".stratasearchignore"


@dataclass(frozen=True)
class Pattern:
    """One line of an ignore file."""

    text: str
    keep: bool
    matcher: re.Pattern

    @property
    def names_a_kind(self) -> bool:
        """Whether the pattern ends in a file suffix; a file that such a negation keeps needs no known extension."""
        return bool(PurePosixPath(self.text.lstrip("!").rstrip("/")).suffix)


def _body(glob: str) -> str:
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif c == "*":
            whole = k == 0 or glob[k - 1] == "/"  # a star never stands for an empty name
            out, k = out + ("(?=[^/])[^/]*" if whole else "[^/]*"), k + 1
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            inside = glob[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        elif c == "\\" and k + 1 < len(glob):
            out, k = out + re.escape(glob[k + 1]), k + 2
        else:
            out, k = out + re.escape(c), k + 1
    return out


def parse_line(line: str) -> Pattern | None:
    """A pattern, or None for blank lines and comments."""
    text = line.rstrip("\r\n")
    if not text.endswith("\\ "):
        text = text.rstrip(" ")
    if not text or text.startswith("#"):
        return None
    keep = text.startswith("!")
    glob = text[1:] if keep else text
    directory = glob.endswith("/")
    glob = glob.rstrip("/") if directory else glob
    anchored = "/" in glob
    glob = glob.removeprefix("/")
    if not glob:
        return None
    start = "" if anchored else "(?:.*/)?"
    end = "/.*" if directory else "(?:/.*)?"
    return Pattern(text, keep, re.compile(f"{start}{_body(glob)}{end}", re.DOTALL))


def parse_lines(lines) -> tuple[Pattern, ...]:
    """All patterns of an ignore file."""
    return tuple(p for p in map(parse_line, lines) if p is not None)


@dataclass(frozen=True)
class Rules:
    """Patterns of one directory; ``base`` is its path below the root, empty for the root itself."""

    base: str
    patterns: tuple[Pattern, ...]


def decide(path: str, is_directory: bool, stack: list[Rules]) -> tuple[bool, bool]:
    """(ignored, kept by kind): the last pattern that matches, over all directories above, decides."""
    ignored = by_kind = False
    for rules in stack:
        if rules.base and not path.startswith(f"{rules.base}/"):
            continue
        relative = path[len(rules.base) + 1 :] if rules.base else path
        subject = f"{relative}/" if is_directory else relative
        for pattern in rules.patterns:
            if pattern.matcher.fullmatch(subject):
                ignored = not pattern.keep
                by_kind = pattern.keep and pattern.names_a_kind
    return ignored, by_kind
