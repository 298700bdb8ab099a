"""Tree scans, ignore files, configuration, the registry, git."""

import os
import subprocess

import pytest

from stratasearch.sources import git, projects
from stratasearch.sources.config import load_config, substituted, template
from stratasearch.sources.ignore import parse_line
from stratasearch.sources.walker import scan_files, tree_fingerprint, walk


def tree(root, files):
    for path, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, path)) or str(root), exist_ok=True)
        with open(os.path.join(root, path), "w", encoding="utf-8") as file:
            file.write(text)


@pytest.mark.parametrize(
    "files,kept",
    [
        ({"a.py": "", "b.txt": "", "c.js": ""}, {"a.py", "c.js"}),
        ({".gitignore": "*.py\n!keep.py\n", "a.py": "", "keep.py": ""}, {"keep.py"}),
        ({".gitignore": "out/\n", "out/a.py": "", "src/out/b.py": "", "outer/c.py": ""}, {"outer/c.py"}),
        ({".gitignore": "/top.py\nsub/*.js\n", "top.py": "", "x/top.py": "", "sub/a.js": "", "x/sub/a.js": ""}, {"x/top.py", "x/sub/a.js"}),
        ({".gitignore": "a.py\n", "sub/.gitignore": "!a.py\n", "a.py": "", "sub/a.py": ""}, {"sub/a.py"}),
        ({".gitignore": "!special.zz\n", "special.zz": "", "other.zz": ""}, {"special.zz"}),
        ({".gitignore": "data/*\n!data/*.py\n", "data/a.py": "", "data/b.js": ""}, {"data/a.py"}),
        ({"node_modules/a.js": "", "vendor/b.py": "", "x/build/c.py": "", ".venv/d.py": "", ".github/e.py": ""}, {".github/e.py"}),
        ({".gitignore": "# note\n\n**/gen/**\ndeep/**/x.py\n", "a/gen/b.py": "", "deep/q/r/x.py": "", "deep/y.py": ""}, {"deep/y.py"}),
        ({".stratasearchignore": "b.py\n", "a.py": "", "b.py": ""}, {"a.py"}),
        ({".gitignore": "!vendor/\n", "vendor/a.py": "", "vendor/a.zz": ""}, {"vendor/a.py"}),
        ({"__init__.py": "", "_app.tsx": "", "sub/_x.py": ""}, {"__init__.py", "_app.tsx", "sub/_x.py"}),
    ],
)
def test_walk(tmp_path, files, kept):
    tree(tmp_path, files)
    assert {p for p, _, _ in walk(str(tmp_path), [".py", ".js", ".tsx"])} == kept


def test_links_and_order(tmp_path):
    tree(tmp_path, {"b.py": "", "a/z.py": "", "a/c.py": "", "c.py": ""})
    os.symlink(tmp_path / "b.py", tmp_path / "link.py")
    os.symlink(tmp_path / "a", tmp_path / "linked")
    found = [p for p, _, _ in walk(str(tmp_path), [".py"])]
    assert sorted(found) == ["a/c.py", "a/z.py", "b.py", "c.py"]
    assert [p for p, _, _ in walk(str(tmp_path), [".py"], ignore=["a/"])] == ["b.py", "c.py"]
    assert list(walk(str(tmp_path / "missing"), [".py"])) == []


def test_patterns():
    assert parse_line("") is None and parse_line("# x") is None and parse_line("/") is None
    assert parse_line("\\#x").matcher.fullmatch("a/#x") and parse_line("[!a]b").matcher.fullmatch("cb")
    assert not parse_line("a?c").matcher.fullmatch("a/c") and parse_line("!*.py").names_a_kind and not parse_line("!x/").names_a_kind


def test_scan(spark, tmp_path):
    tree(tmp_path, {"a.py": "x = 1\n", "big.py": "y" * 200, "bin.py": "a\x00b", "lib.min.js": "z", "blank.py": " \n", "doc.md": "# t\n"})
    with open(tmp_path / "odd.py", "wb") as file:
        file.write(b"# caf\xe9 is enough text\n")
    rows = scan_files(spark, str(tmp_path), "r", most_bytes=100).collect()
    assert {r["file_path"]: r["language"] for r in rows} == {"a.py": "python", "odd.py": "python"}
    assert "�" in next(r["content"] for r in rows if r["file_path"] == "odd.py")
    texts = scan_files(spark, str(tmp_path), "r", include_text_files=True, most_bytes=100)
    assert "doc.md" in {r["file_path"] for r in texts.collect()}
    listed = spark.createDataFrame([("r", "b", 1, 2), ("r", "a", 3, 4)], "repo_id string, file_path string, size long, mtime_ns long")
    again = spark.createDataFrame([("r", "a", 3, 4), ("r", "b", 1, 2)], "repo_id string, file_path string, size long, mtime_ns long")
    assert tree_fingerprint(listed).first() == tree_fingerprint(again).first()


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("PLACE", "/data")
    path = tmp_path / "c.json"
    path.write_text('{"store": {"path": "${PLACE}/store", "metric": "${METRIC:-cosine}"}, "embedding": {"dim": 32}}')
    config = load_config(str(path))
    assert (config.store.path, config.store.metric, config.embedding.dim, config.indexing.max_file_bytes) == ("/data/store", "cosine", 32, 1_000_000)
    assert load_config(str(tmp_path / "missing.json")).embedding.dim == 64
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "c.toml"))
    path.write_text('{"store": {"pth": "x"}}')
    with pytest.raises(ValueError):
        load_config(str(path))
    path.write_text(template())
    assert load_config(str(path)) == load_config(str(tmp_path / "missing.json"))
    assert substituted({"a": ["${NOT_SET}x", 1]}) == {"a": ["${NOT_SET}x", 1]}
    monkeypatch.setenv("STRATASEARCH_CONFIG", str(path))
    assert load_config().ranking.coarse_multiplier == 5


def test_projects(tmp_path, monkeypatch):
    monkeypatch.setenv("STRATASEARCH_PROJECTS_FILE", str(tmp_path / "p" / "projects.json"))
    registry = projects.Registry()
    assert list(registry) == []
    registry.upsert(registry.project(str(tmp_path / "x" / ".." / "one")))
    registry.upsert(registry.project("https://example.com/a/tool.git", name="Tool", ref="dev"))
    registry.upsert(registry.project(str(tmp_path / "one"), include_text_files=True))
    assert [(p.title(), p.include_text_files, p.ref) for p in projects.Registry()] == [("one", True, None), ("Tool", False, "dev")]
    assert registry.delete(str(tmp_path / "one")) and not registry.delete(str(tmp_path / "one"))
    with pytest.raises(ValueError):
        registry.project("  ")
    assert projects.Project("https://example.com/a/tool.git/").title() == "tool"
    registry.file.write_text('{"projects": ["x", {"name": "no source"}, {"source": "/a/b"}], "more": 1}')
    assert [p.title() for p in registry] == ["b"]
    assert os.listdir(tmp_path / "p") == ["projects.json"]


def test_git(tmp_path):
    assert git.identity("https://example.com/a.git", "dev") == "https://example.com/a.git#ref=dev"
    with pytest.raises(ValueError):
        git.checkout("ssh://example.com/a", None, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        git.checkout(str(tmp_path / "missing"), None, str(tmp_path))
    assert git.checkout(str(tmp_path), None, "") == os.path.realpath(tmp_path)
    tree(tmp_path, {"repo/a.py": "x\n", "deep/b/c/d/e.py": ""})
    repo = str(tmp_path / "repo")
    first = git.source_state(repo, [("a.py", 2, 3)])
    assert first.startswith("files:") and first != git.source_state(repo, [("a.py", 2, 4)])
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=repo, check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "x")
    assert git.source_state(repo, []) == f"git:{git.head(repo)}" and not git.is_dirty(repo)
    tree(tmp_path, {"repo/a.py": "y\n"})
    assert git.is_dirty(repo) and git.source_state(repo, []).startswith("files:")
    assert git.find_repositories(str(tmp_path)) == [repo] and git.find_repositories(str(tmp_path), 0) == []
    assert git._git("fetch", "--depth", "1", "--", "origin", "--upload-pack=touch /tmp/never", cwd=repo) is None
