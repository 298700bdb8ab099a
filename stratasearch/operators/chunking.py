"""Files to chunks.

Line packing and the hard split are expressions: one fold over a file's lines carries the open chunk's first
line and length and closes it when the next line would not fit, so a file is read once. Structural
splitting is Python, over Arrow batches: ``tree_splitter`` groups the nodes of syntax trees, by default those of ``syntax``; a parser can take their place.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import Languages
from ..functions.text import count_of, is_blank, lines_of
from .syntax import Node, syntax_tree

DESIRED_CHARS, MOST_CHARS = 1500, 12_000
STATE = "struct<start:int,len:int,first:int,n:int,line:int,newline:int,out:array<struct<start:int,end:int,first:int,n:int,line:int>>>"


def packed_lines(lines: Column, desired: int = DESIRED_CHARS) -> Column:
    """Greedy groups of lines: structs of start and end (characters), first (index of the first line), n and line (number, from 1).

    A line joins the open group while the lengths add up to ``desired`` at most; a longer line stands alone.
    """
    measured = F.transform(
        lines, lambda x: F.struct(F.length(x).alias("len"), count_of(x, "\n").cast("int").alias("newline"))
    )
    begin = F.expr(f"CAST(named_struct('start', 0, 'len', 0, 'first', 1, 'n', 0, 'line', 1, 'newline', 0, 'out', array()) AS {STATE})")

    def closed(s: Column) -> Column:
        return F.concat(
            s["out"],
            F.array(
                F.struct(
                    s["start"].alias("start"), (s["start"] + s["len"]).alias("end"), s["first"].alias("first"), s["n"].alias("n"), s["line"].alias("line")
                )
            ),
        )

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] > 0) & (s["len"] + x["len"] > desired)
        return F.when(
            full,
            F.struct(
                (s["start"] + s["len"]).alias("start"),
                x["len"].alias("len"),
                (s["first"] + s["n"]).alias("first"),
                F.lit(1).alias("n"),
                (s["line"] + s["newline"]).alias("line"),
                x["newline"].alias("newline"),
                closed(s).alias("out"),
            ),
        ).otherwise(
            F.struct(
                s["start"].alias("start"),
                (s["len"] + x["len"]).alias("len"),
                s["first"].alias("first"),
                (s["n"] + 1).alias("n"),
                s["line"].alias("line"),
                (s["newline"] + x["newline"]).alias("newline"),
                s["out"].alias("out"),
            )
        )

    return F.aggregate(measured, begin, step, lambda s: F.when(s["n"] > 0, closed(s)).otherwise(s["out"]))


def hard_split(start: Column, end: Column, most: int = MOST_CHARS) -> Column:
    """A span as spans of at most ``most`` characters; 0 or less leaves it whole."""
    if most <= 0:
        return F.array(F.struct(start.alias("start"), end.alias("end")))
    points = F.when(end > start, F.sequence(start, end - 1, F.lit(most))).otherwise(F.array(start))
    return F.transform(points, lambda p: F.struct(p.alias("start"), F.least(p + most, end).alias("end")))


def line_chunks(files: DataFrame, desired: int = DESIRED_CHARS, most: int = MOST_CHARS) -> DataFrame:
    """Chunks of ``files`` (any columns, with ``content``): the other columns, start, end, content, start_line, end_line.

    Blank and null contents give none. Offsets are in characters from 0. A line break at a chunk's end doesn't count for its
    last line.
    """
    keep = [c for c in files.columns if c != "content"]
    lined = files.where(~is_blank("content")).withColumn("lines", lines_of("content"))
    groups = lined.select(*keep, "lines", F.explode_outer(packed_lines(F.col("lines"), desired)).alias("g")).where("g IS NOT NULL")
    texts = groups.select(*keep, "g", F.array_join(F.slice("lines", F.col("g.first"), F.col("g.n")), "").alias("text"))
    pieces = texts.select(*keep, "g", "text", F.explode_outer(hard_split(F.col("g.start"), F.col("g.end"), most)).alias("p"))
    inside = F.col("p.start") - F.col("g.start")
    content = F.substr("text", inside + 1, F.col("p.end") - F.col("p.start"))
    before = count_of(F.substr("text", F.lit(1), inside), "\n")
    until = count_of(F.substr("text", F.lit(1), F.greatest(inside, F.col("p.end") - F.col("g.start") - 1)), "\n")
    return pieces.select(
        *keep,
        F.col("p.start").alias("start"),
        F.col("p.end").alias("end"),
        content.alias("content"),
        (F.col("g.line") + before).cast("int").alias("start_line"),
        (F.col("g.line") + until).cast("int").alias("end_line"),
    )


def chunk_id(repo_id: Column, path: Column, start_line: Column, end_line: Column, content: Column) -> Column:
    """The stored id: a hash of repository, path, lines and content."""
    raw = F.concat_ws(":", repo_id, path, start_line, end_line, F.substring(F.sha2(content, 256), 1, 32))
    return F.substring(F.sha2(raw, 256), 1, 32)


def portable_chunk_id(namespace: Column, path: Column, start_line: Column, end_line: Column, content: Column) -> Column:
    """The library form of an id, with a namespace."""
    raw = F.concat_ws("|", namespace, path, start_line, end_line, F.substring(F.sha2(content, 256), 1, 16))
    return F.substring(F.sha2(raw, 256), 1, 32)


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Chunks with chunk_id and content_hash; needs repo_id, file_path, start_line, end_line, content."""
    columns = [F.col(c) for c in ("repo_id", "file_path", "start_line", "end_line", "content")]
    return chunks.withColumn("chunk_id", chunk_id(*columns)).withColumn(
        "content_hash", F.substring(F.sha2("content", 256), 1, 32)
    )


Splitter = Callable[[str, str, int], "list[tuple[int, int]] | None"]

#: Languages that are split by structure: all that count as code.
STRUCTURED = frozenset(Languages().table.values()) - Languages().documents


def merged_groups(groups: list[tuple[int, int, int]], desired: int) -> list[tuple[int, int]]:
    """Spans of neighbouring groups (start, end, length), in order: one joins the span before it while their lengths add up to ``desired`` at most. The
    gaps between groups belong to spans but don't count; a longer group stands alone."""
    spans: list[list[int]] = []
    for start, end, length in groups:
        if spans and spans[-1][2] + length <= desired:
            spans[-1][1], spans[-1][2] = end, spans[-1][2] + length
        else:
            spans.append([start, end, length])
    return [(start, end) for start, end, _ in spans]


# Nodes of fewer bytes, and nodes deeper than this, are never taken apart.
SHORT_NODE, DEEPEST_NODE = 50, 500


def node_groups(root: Node, desired: int) -> list[tuple[int, int, int]]:
    """Groups (start, end, length) of a tree: siblings are packed in order up to ``desired``, longer nodes with children are taken apart, and so is the root.

    A group never reaches over its parent's end. Gaps between siblings lie in a group but don't count.
    """
    groups: list[tuple[int, int, int]] = []
    waiting: list[tuple[Node, int] | None] = [(root, 0)]  # None: the end of a parent
    held: tuple[int, int, int] | None = None

    def release() -> None:
        nonlocal held
        if held is not None:
            groups.append(held)
        held = None

    while waiting:
        step = waiting.pop()
        if step is None:
            release()
            continue
        node, depth = step
        size = node.end - node.start
        if size <= desired and depth:
            if held is not None and held[2] + size > desired:
                release()
            held = (held[0], node.end, held[2] + size) if held is not None else (node.start, node.end, size)
            continue
        release()
        if node.children and size >= SHORT_NODE and depth <= DEEPEST_NODE:
            waiting.append(None)
            waiting += [(child, depth + 1) for child in reversed(node.children)]
        else:
            groups.append((node.start, node.end, size))
    return groups


class Parsers:
    """One parser for each language, loaded when it is first wanted; where that fails, it is told once and there is none."""

    def __init__(self, load: Callable[[str], Callable[[bytes], Node]]):
        self.load = load
        self.known: dict[str, Callable[[bytes], Node] | None] = {}

    def parser(self, language: str) -> Callable[[bytes], Node] | None:
        if language not in self.known:
            try:
                self.known[language] = self.load(language)
            except Exception as error:  # the loader decides what it raises
                logging.getLogger(__name__).warning("no parser for %s: %s", language, error)
                self.known[language] = None
        return self.known[language]


def tree_splitter(load: Callable[[str], Callable[[bytes], Node]]) -> Splitter:
    """A splitter by syntax trees; ``load`` gives a language's parser, bytes to a tree, on the workers. Spans are in characters and cover the source."""
    parsers = Parsers(load)

    def split(source: str, language: str, desired: int) -> list[tuple[int, int]] | None:
        parser = parsers.parser(language)
        if parser is None:
            return None
        data = source.encode("utf-8", "replace")
        spans = merged_groups(node_groups(parser(data), desired), desired)
        starts, at, chars = [0], 0, 0
        for start, _ in spans[1:]:
            chars += start - at if len(data) == len(source) else len(data[at:start].decode("utf-8", "ignore"))
            at = start
            starts.append(chars)
        return list(zip(starts, [*starts[1:], len(source)]))

    return split


def _loader(language: str) -> Callable[[bytes], Node]:
    if language not in STRUCTURED:
        raise LookupError("its files are split by lines")
    return lambda data: syntax_tree(data, language)


#: The splitter that is used unless another is given: trees by brackets and indentation for all languages of code.
syntax_splitter = tree_splitter(_loader)


def _levels(lines: list[str], body: list[int]) -> dict[int, int]:
    """The depth of each line: its indentation, or, where all lines have the same, the brackets that are open before it."""
    indents = {k: len(lines[k]) - len(lines[k].lstrip(" \t")) for k in body}
    if len(set(indents.values())) > 1:
        return indents
    open_, depths = 0, {}
    for k in body:
        depths[k] = open_
        open_ = max(0, open_ + sum(c in "{([" for c in lines[k]) - sum(c in "})]" for c in lines[k]))
    return depths


def _pieces(lines: list[str], first: int, last: int, desired: int, depth: int) -> list[tuple[int, int]]:
    """Line ranges of one level: a new piece starts at each line of least depth that isn't a closing one."""
    body = [k for k in range(first, last) if lines[k].strip()]
    if sum(len(x) for x in lines[first:last]) <= desired or len(body) < 2 or depth > 50:
        return [(first, last)]
    levels = _levels(lines, body)
    least = min(levels[k] for k in body[1:]) if depth else min(levels.values())
    starts = [first]
    for k in body:
        if k > first and levels[k] <= least and lines[k].strip()[0] not in ")]}" and not lines[k].strip().startswith("end"):
            starts.append(k)
    if len(starts) == 1:
        return [(first, last)]
    out = []
    for a, b in zip(starts, [*starts[1:], last]):
        out += _pieces(lines, a, b, desired, depth + 1)
    return out


def indentation_splitter(source: str, language: str, desired: int) -> list[tuple[int, int]] | None:
    """Spans of a source by its indentation or its brackets, neighbouring small blocks packed together; None for languages that aren't code."""
    if language not in STRUCTURED:
        return None
    lines = source.splitlines(keepends=True)
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line))
    return merged_groups([(offsets[a], offsets[b], offsets[b] - offsets[a]) for a, b in _pieces(lines, 0, len(lines), desired, 0)], desired)


def structural_chunks(files: DataFrame, splitter: Splitter = syntax_splitter, desired: int = DESIRED_CHARS, most: int = MOST_CHARS) -> DataFrame:
    """Chunks of ``files`` (repo_id, file_path, language, content) by structure where the splitter knows the language, else by lines.

    The result has repo_id, file_path, language, start, end, content, start_line, end_line. A splitter may have no way with a language either; its files
    are split by lines then. Spans must be in order.
    """

    def by_lines_instead(source: str) -> list[tuple[int, int]]:
        groups, at = [], 0
        for line in source.splitlines(keepends=True):
            groups.append((at, at + len(line), len(line)))
            at += len(line)
        return merged_groups(groups, desired)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repo, path, language, source in zip(batch["repo_id"], batch["file_path"], batch["language"], batch["content"]):
                found = splitter(source, language, desired)
                line, at = 1, 0  # spans come in order, so line ends are counted once
                for start, end in by_lines_instead(source) if found is None else found:
                    step = most if most > 0 else max(1, end - start)
                    for a in range(start, end, step):
                        b = min(a + step, end)
                        line += source.count("\n", at, a)
                        at = a
                        rows.append((repo, path, language, a, b, source[a:b], line, line + source.count("\n", a, max(b - 1, a))))
            yield pd.DataFrame(rows, columns=["repo_id", "file_path", "language", "start", "end", "content", "start_line", "end_line"])

    columns = ["repo_id", "file_path", "language", "content"]
    kept = files.select(*columns).where(~is_blank("content"))
    known = F.coalesce(F.col("language").isin(sorted(STRUCTURED)), F.lit(False))
    schema = "repo_id string, file_path string, language string, start int, end int, content string, start_line int, end_line int"
    by_structure = kept.where(known).mapInPandas(split, schema)
    by_lines = line_chunks(kept.where(~known), desired, most)
    return by_structure.unionByName(by_lines)
