"""Chunks: boundaries, caps, line numbers, ids."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from stratasearch.operators import chunking
from stratasearch.operators.syntax import syntax_tree


def chunks(spark, sources, **options):
    files = spark.createDataFrame([(k, s) for k, s in enumerate(sources)], "k int, content string")
    rows = chunking.line_chunks(files, **options).orderBy("k", "start").collect()
    return [[r for r in rows if r["k"] == k] for k in range(len(sources))]


def spans(rows):
    return [(r["start"], r["end"]) for r in rows]


def test_packing(spark):
    got = chunks(spark, ["a\nb\nc\nd\ne\nf\n", "", "abc" + "x" * 17 + "\nabc", None, "  \n"], desired=10)
    assert spans(got[0]) == [(0, 10), (10, 12)] and got[1] == [] and got[3] == [] and got[4] == []
    lines = "ab\n" + "x" * 19 + "\n" + "cd\n"
    assert spans(chunks(spark, [lines], desired=10)[0]) == [(0, 3), (3, 23), (23, 26)]


def test_hard_split(spark):
    rows = chunks(spark, ["x" * 25], desired=10, most=12)[0]
    assert spans(rows) == [(0, 12), (12, 24), (24, 25)] and {(r["start_line"], r["end_line"]) for r in rows} == {(1, 1)}
    assert spans(chunks(spark, ["x" * 25], desired=10, most=0)[0]) == [(0, 25)]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab\n\r\x0b\x85\u2028 é🙂", max_size=60), min_size=1, max_size=8), st.integers(1, 20), st.integers(1, 15))
def test_pieces_make_the_source(spark, sources, desired, most):
    for source, rows in zip(sources, chunks(spark, sources, desired=desired, most=most)):
        if not source.strip():
            assert rows == []
            continue
        assert "".join(r["content"] for r in rows) == source
        assert all(len(r["content"]) <= most for r in rows)
        for r in rows:
            assert r["content"] == source[r["start"] : r["end"]]
            assert r["start_line"] == source[: r["start"]].count("\n") + 1
            assert r["end_line"] == source[: max(r["end"] - 1, r["start"])].count("\n") + 1
        groups, at, size = [], 0, 0
        for line in source.splitlines(keepends=True):
            if size and size + len(line) > desired:
                groups.append((at, at + size))
                at, size = at + size, 0
            size += len(line)
        groups.append((at, at + size))
        assert spans(rows) == [(k, min(k + most, b)) for a, b in groups for k in range(a, b, most)]


def test_ids(spark):
    files = spark.createDataFrame([("r", "a.py", "x = 1\n")], "repo_id string, file_path string, content string")
    row = chunking.with_chunk_ids(chunking.line_chunks(files)).first()
    digest = hashlib.sha256(b"x = 1\n").hexdigest()[:32]
    assert row["content_hash"] == digest
    assert row["chunk_id"] == hashlib.sha256(f"r:a.py:1:1:{digest}".encode()).hexdigest()[:32]


PYTHON = "import os\n\n\n" + "\n\n".join(f"def f{k}(x):\n" + "    y = x + 1\n" * 30 + "    return y\n" for k in range(6))


def test_structure(spark):
    files = spark.createDataFrame([("r", "a.py", "python", PYTHON), ("r", "b.txt", None, "a\n" * 900), ("r", "c.py", "python", "x" * 50_000)], "repo_id string, file_path string, language string, content string")
    rows = chunking.structural_chunks(files, desired=500, most=2000).orderBy("file_path", "start").collect()
    python = [r for r in rows if r["file_path"] == "a.py"]
    assert "".join(r["content"] for r in python) == PYTHON and [r["content"].count("def ") for r in python] == [1] * 6
    assert all(r["end"] - r["start"] <= 2000 for r in rows)
    deep = "\n".join(" " * k + "if x:" for k in range(10_000))
    assert chunking.indentation_splitter(deep, "python", 100)[-1][1] == len(deep)
    assert chunking.indentation_splitter("x", "markdown", 100) is None


def test_groups_of_nodes():
    leaf = lambda a, b: chunking.Node(a, b)
    root = chunking.Node(0, 300, [leaf(0, 40), leaf(42, 80), chunking.Node(82, 250, [leaf(82, 140), leaf(141, 249)]), leaf(255, 300)])
    assert chunking.node_groups(root, 100) == [(0, 80, 78), (82, 140, 58), (141, 249, 108), (255, 300, 45)]
    assert chunking.merged_groups(chunking.node_groups(root, 100), 100) == [(0, 80), (82, 140), (141, 249), (255, 300)]
    assert chunking.merged_groups([(0, 10, 10), (15, 20, 5), (30, 90, 60), (91, 95, 4)], 15) == [(0, 20), (30, 90), (91, 95)]
    deep = leaf(0, 1000)
    for _ in range(2000):
        deep = chunking.Node(0, 1000, [deep])
    assert chunking.node_groups(deep, 100) == [(0, 1000, 1000)]
    assert chunking.node_groups(chunking.Node(0, 49, [leaf(0, 20), leaf(20, 49)]), 10) == [(0, 49, 49)]


def test_tree_splitter(spark):
    loaded = []

    def load(language):
        loaded.append(language)
        if language == "go":
            raise ImportError("none here")

        def parse(data):
            ends = [k + 1 for k, c in enumerate(data) if c == 10]
            return chunking.Node(0, len(data), [chunking.Node(a, b) for a, b in zip([0, *ends], ends)])

        return parse

    split = chunking.tree_splitter(load)
    source = "é" * 30 + "\n" + "x" * 50 + "\n" + "ü" * 60 + "\n"
    assert split(source, "rust", 80) == [(0, 31), (31, 82), (82, 143)] and split(source, "rust", 10_000) == [(0, 143)]
    assert split(source, "go", 80) is None and split(source, "go", 80) is None and loaded == ["rust", "go"]
    files = spark.createDataFrame([("r", "a.go", "go", "ab\ncd\nef\n")], "repo_id string, file_path string, language string, content string")
    assert [(r["start"], r["end"]) for r in chunking.structural_chunks(files, split, 6).collect()] == [(0, 6), (6, 9)]


def test_brackets_show_structure_where_indentation_does_not():
    source = "".join(f"func f{k}() {{\nreturn {k}\n}}\n" for k in range(6))
    spans = chunking.indentation_splitter(source, "go", 30)
    assert [source[a:b].count("func") for a, b in spans] == [1] * 6 and "".join(source[a:b] for a, b in spans) == source


def apart(node, desired, depth=0):
    """The rules for groups of nodes, by direct recursion."""
    size = node.end - node.start
    if not node.children or size < 50 or depth > 500:
        return [(node.start, node.end, size)]
    out, run = [], []
    for child in [*node.children, None]:
        if child is None or child.end - child.start > desired or sum(c.end - c.start for c in [*run, child]) > desired:
            if run:
                out.append((run[0].start, run[-1].end, sum(c.end - c.start for c in run)))
            run = []
        if child is not None:
            if child.end - child.start > desired:
                out += apart(child, desired, depth + 1)
            else:
                run.append(child)
    return out


@st.composite
def trees(draw, start=0, depth=0):
    children, at = [], start + draw(st.integers(0, 5))
    for _ in range(draw(st.integers(0, 5 if depth < 4 else 0))):
        child = draw(trees(at, depth + 1))
        children.append(child)
        at = child.end + draw(st.integers(0, 20))
    return chunking.Node(start, at + draw(st.integers(0, 60)), children)


@settings(max_examples=300, deadline=None)
@given(trees(), st.integers(1, 200))
def test_groups_equal_the_recursive_rules(tree, desired):
    assert chunking.node_groups(tree, desired) == apart(tree, desired)


def test_groups_end_with_their_parent():
    node = chunking.Node
    tree = node(0, 180, [node(0, 10), node(10, 140, [node(10, 70)]), node(140, 180)])
    assert chunking.node_groups(tree, 100) == [(0, 10, 10), (10, 70, 60), (140, 180, 40)]
    assert chunking.merged_groups(chunking.node_groups(tree, 100), 100) == [(0, 70), (140, 180)]


def outline(node, data):
    return [data[c.start : c.end].decode() for c in node.children]


def test_trees_by_brackets_and_indentation():
    source = b"class A:\n    def f(self):\n        return [1,\n 2]\n\n    z = '('\nx = 1  # (\n"
    root = syntax_tree(source, "python")
    assert outline(root, source) == ["class A:\n    def f(self):\n        return [1,\n 2]\n\n    z = '('", "x = 1  # ("]
    assert outline(root.children[0], source)[3:] == ["def f(self):\n        return [1,\n 2]", "z = '('"]
    source = b'int f(int a) {\n  /* } */ if (a) { g("}"); }\n  return 1;\n}\nint g;\n'
    root = syntax_tree(source, "c")
    assert [x.count("\n") for x in outline(root, source)] == [3, 0]
    body = root.children[0].children[-1]
    assert outline(body, source) == ['/* } */ if (a) { g("}"); }', "return 1;"]
    assert [x.split()[0] for x in outline(syntax_tree(b"-- it's (\nselect 1;\nselect ')';", "sql"), b"-- it's (\nselect 1;\nselect ')';")] == ["--", "select", "select"]


def inside(node):
    stack = [node]
    while stack:
        at = stack.pop()
        last = at.start
        for child in at.children:
            assert last <= child.start <= child.end <= at.end
            last = child.end
        stack += at.children


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab(){}[];,'\"`#/*\n \t\\é-", max_size=200), st.sampled_from(["python", "c", "sql", "rust", "clojure"]), st.integers(1, 60))
def test_any_text_has_a_tree_and_spans_that_make_it(source, language, desired):
    data = source.encode()
    root = syntax_tree(data, language)
    inside(root)
    assert (root.start, root.end) == (0, len(data))
    spans = chunking.syntax_splitter(source, language, desired)
    assert "".join(source[a:b] for a, b in spans) == source
    assert all(a < b for a, b in spans) or not source


def test_depth_and_size():
    deep = "\n".join(" " * k + "if x:" for k in range(3000))
    assert chunking.syntax_splitter(deep, "python", 100)[-1][1] == len(deep)
    assert chunking.syntax_splitter("(" * 50_000, "c", 100)[-1][1] == 50_000
    assert chunking.syntax_splitter("x", "markdown", 100) is None


def test_engine_takes_a_splitter(spark, tmp_path):
    from stratasearch.plans.engine import Engine
    from stratasearch.sources.config import Config

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.py").write_text("x = 1\ny = 2\n")
    config = Config()
    config.store.path = str(tmp_path / "store")
    engine = Engine(spark, config, splitter=lambda source, language, desired: [(0, 6), (6, len(source))], chunker_version="halves")
    assert engine.index_repo(str(tmp_path / "r")).chunk_count == 2
    assert engine.repo_id(str(tmp_path / "r")) != Engine(spark, config).repo_id(str(tmp_path / "r"))
