"""Index, search, find-related, deltas and recovery, end to end."""

import os

import pytest

from stratasearch.operators.dense import HashingEncoder
from stratasearch.plans.engine import Engine
from stratasearch.plans.search import from_wire, rendered, to_wire
from stratasearch.plans.store import RepoNotIndexedError
from stratasearch.sources.config import Config


def write(root, files):
    for path, text in files.items():
        target = os.path.join(root, path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "w", encoding="utf-8") as file:
            file.write(text)


LOGIN = "def authenticate(token):\n    return check_password(token)\n"
FILES = {
    "auth.py": LOGIN,
    "users.py": "class UserService:\n    def get_user(self, user_id):\n        return self.users[user_id]\n",
    "tests/test_auth.py": "def test_authenticate():\n    assert authenticate('token')\n",
    "README.md": "# Authentication\n",
    "_private.py": "SECRET = 'rotate the session key'\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("store")
    config = Config()
    config.store.path = str(base / "tables")
    write(base / "one", FILES)
    write(base / "two", {"login.py": LOGIN, "math_utils.py": "def add(a, b):\n    return a + b\n"})
    made = Engine(spark, config)
    made.base = base
    made.outcomes = [made.index_repo(str(base / name)) for name in ("one", "two")]
    return made


def paths(found):
    return [r["chunk"]["file_path"] for r in found.orderBy("rank").collect()]


def test_index_and_search(engine):
    assert [o.indexed for o in engine.outcomes] == [True, True]
    assert [o.chunk_count for o in engine.outcomes] == [4, 2]  # the text file is left out
    found = paths(engine.search("authenticate token"))
    assert found[:2] == ["auth.py", "login.py"] or found[:2] == ["login.py", "auth.py"]
    assert paths(engine.search("UserService"))[0] == "users.py"
    assert "_private.py" in paths(engine.search("session key"))
    assert engine.search("   ").count() == 0


def test_scope(engine):
    only = engine.search("authenticate", repo=str(engine.base / "two")).collect()
    assert {r["repo_name"] for r in only} == {"two"}
    inside = engine.resolve_repo_id(str(engine.base / "one" / "tests"))
    assert inside == engine.outcomes[0].repo_id
    with pytest.raises(RepoNotIndexedError):
        engine.resolve_repo_id("/nowhere/at/all")
    sparse = engine.search("authenticate", repo=str(engine.base / "two"), prefilter=True)
    assert paths(sparse)[0] == "login.py"


def test_find_related(engine):
    one = str(engine.base / "one")
    found = engine.find_related("auth.py", 1, one).collect()
    assert found[0]["chunk"]["file_path"] == "login.py" and {r["repo_name"] for r in found} == {"two"}
    again = engine.find_related("auth.py", 1, one, re_embed=True).collect()
    assert [(r["chunk_id"], round(r["score"], 5)) for r in found] == [(r["chunk_id"], round(r["score"], 5)) for r in again]
    assert engine.find_related("auth.py", 999, one).count() == 0
    within = engine.find_related("auth.py", 1, one, exclude_source_repo=False).collect()
    assert all(r["chunk"]["file_path"] != "auth.py" or r["repo_name"] != "one" for r in within)
    with pytest.raises(RepoNotIndexedError):
        engine.find_related("auth.py", 1, "/not/indexed")


def test_results_as_text(engine):
    found = engine.search("authenticate token")
    back = from_wire(to_wire(found)).orderBy("rank").collect()
    assert [r["chunk"] for r in back] == [r["chunk"] for r in found.orderBy("rank").collect()]
    block = rendered(found).orderBy("rank").first()["block"]
    assert block.startswith("## 1. ") and "```\ndef authenticate" in block


def test_changes(spark, tmp_path):
    config = Config()
    config.store.path = str(tmp_path / "tables")
    repo = tmp_path / "repo"
    write(repo, {"a.py": "alpha = 1\n", "b.py": "beta = 2\n"})

    class Counting(HashingEncoder):
        @property
        def name(self):
            return "counting"

    engine = Engine(spark, config, Counting())
    first = engine.index_repo(str(repo))
    assert first.chunk_count == 2 and not engine.index_repo(str(repo)).indexed
    write(repo, {"b.py": "gamma = 3\n"})
    second = engine.index_repo(str(repo))
    assert second.indexed and second.repo_id == first.repo_id
    assert paths(engine.search("gamma"))[0] == "b.py"
    assert {r["content"] for r in engine.store.table("chunks").collect()} == {"alpha = 1\n", "gamma = 3\n"}
    assert engine.store.table("vectors").count() == 2
    engine.store.compact()
    assert engine.store.table("chunks").count() == 2 and all(len(x) == 1 for x in engine.store.manifest()["segments"].values())
    assert paths(engine.search("gamma"))[0] == "b.py"
    assert engine.index_repo(str(repo), force=True).indexed
    assert not engine.heal()
    os.remove(repo / "a.py")
    os.remove(repo / "b.py")
    with pytest.raises(ValueError):
        engine.index_repo(str(repo))
    assert not engine.store.has_repo(first.repo_id)
    status = engine.status().first()
    assert (status["repos"], status["chunks"], status["sources"]) == (0, 0, "")


def test_heals_statistics(spark, tmp_path):
    config = Config()
    config.store.path = str(tmp_path / "tables")
    write(tmp_path / "repo", {"a.py": "alpha = 1\n"})
    engine = Engine(spark, config)
    engine.index_repo(str(tmp_path / "repo"))
    segment = engine.store.manifest()["segments"]["doc_stats"][0]
    empty = engine.store.table("doc_stats").limit(0)
    rows = spark.read.parquet(f"{config.store.path}/doc_stats/{segment}").limit(0)
    rows.write.mode("overwrite").parquet(f"{config.store.path}/doc_stats/{segment}")
    assert empty.count() == 0 and engine.store.table("doc_stats").count() == 0
    again = Engine(spark, config)
    assert paths(again.search("alpha")) == ["a.py"]  # healed at the first reading
    assert engine.store.table("doc_stats").count() == 1 and not engine.heal()


def test_many_repositories_are_one_segment(spark, tmp_path):
    config = Config()
    config.store.path = str(tmp_path / "tables")
    for name in "abc":
        write(tmp_path / name, {f"{name}.py": f"{name}_value = 1\n"})
    os.makedirs(tmp_path / "empty")
    engine = Engine(spark, config)
    wanted = [(str(tmp_path / name), False, None) for name in ("a", "missing", "b", "empty", "a", "c")]
    done = engine.index_repos(wanted)
    assert [type(x).__name__ for x in done] == ["IndexOutcome", "FileNotFoundError", "IndexOutcome", "ValueError", "IndexOutcome", "IndexOutcome"]
    assert {name: len(x) for name, x in engine.store.manifest()["segments"].items()} == dict.fromkeys(("chunks", "vectors", "postings", "doc_stats"), 1)
    assert paths(engine.search("b_value"))[0] == "b.py"
    assert [x.indexed for x in engine.index_repos([wanted[0], wanted[2]])] == [False, False]
    repo = done[0].repo_id
    assert [r["file_path"] for r in engine.store.repo_chunks(repo).collect()] == ["a.py"] and engine.store.chunk_ids(repo).count() == 1
    assert [r["file_path"] for r in engine.store.ordered_chunks().select("repo_id", "file_path").orderBy("file_path").collect()] == ["a.py", "b.py", "c.py"]
    assert set(engine.store.repo_sources()) == set(engine.store.repo_source_paths()) and engine.store.repo_sources()[repo].endswith("/a")


def test_two_writers_lose_nothing(spark, tmp_path):
    import threading

    from stratasearch.plans.store import Store

    def add(name):
        def change(manifest):
            manifest["repos"][name] = {"repo_id": name}
            return manifest

        Store(spark, str(tmp_path)).update(change)

    threads = [threading.Thread(target=add, args=(f"r{k}",)) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    final = Store(spark, str(tmp_path)).manifest()
    assert set(final["repos"]) == {f"r{k}" for k in range(12)} and final["number"] == 12
    assert len([n for n in os.listdir(tmp_path) if n.startswith("MANIFEST")]) <= 9 and not any(n.startswith("_new") for n in os.listdir(tmp_path))


def test_a_crash_between_the_steps_of_a_commit(spark, tmp_path, monkeypatch):
    from stratasearch.plans.store import Store

    store = Store(spark, str(tmp_path))
    store.update(lambda m: m | {"repos": {"a": {"repo_id": "a"}}})
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Store, "_claimed", lambda self, manifest: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            store.update(lambda m: m | {"repos": {}})
    (tmp_path / "_new-left").write_text("half a mani")
    assert set(Store(spark, str(tmp_path)).manifest()["repos"]) == {"a"}
    Store(spark, str(tmp_path)).update(lambda m: m | {"repos": m["repos"] | {"b": {"repo_id": "b"}}})
    assert set(store.manifest()["repos"]) == {"a", "b"}


def test_a_store_of_old_is_read_and_migrated(spark, tmp_path):
    import json

    from stratasearch.plans.store import Store

    (tmp_path / "MANIFEST.json").write_text(json.dumps({"segments": ["s1"], "repos": {"a": {"repo_id": "a"}}, "version": 4}))
    store = Store(spark, str(tmp_path))
    assert store.manifest()["segments"]["vectors"] == ["s1"] and set(store.manifest()["repos"]) == {"a"}
    assert store.update(lambda m: m | {"repos": {}})["number"] == 1 and Store(spark, str(tmp_path)).manifest()["repos"] == {}


def test_texts_that_could_not_be_encoded_are_tried_again(spark, tmp_path):
    config = Config()
    config.store.path = str(tmp_path / "tables")
    write(tmp_path / "repo", {"a.py": "alpha = 1\n", "b.py": "beta = 2\n"})
    works = tmp_path / "works"

    class Sometimes(HashingEncoder):

        def __init__(self, flag):
            super().__init__()
            self.flag = str(flag)

        def __getattribute__(self, name):
            if name == "encode_tokens":
                raise AttributeError(name)
            return super().__getattribute__(name)

        def encode(self, texts):
            import numpy as np

            return [None if "beta" in t and not os.path.exists(self.flag) else np.ones(64) / 8 for t in texts]

    engine = Engine(spark, config, Sometimes(works))
    assert engine.index_repo(str(tmp_path / "repo")).indexed
    assert engine.store.table("vectors").where("vector IS NULL").count() == 1
    works.write_text("")
    assert engine.index_repo(str(tmp_path / "repo")).indexed and engine.store.table("vectors").where("vector IS NULL").count() == 0
    assert not engine.index_repo(str(tmp_path / "repo")).indexed


def test_own_tables_are_no_sources(spark, tmp_path):
    config = Config()
    config.store.path = str(tmp_path / "repo" / "state")
    write(tmp_path / "repo", {"a.py": "alpha = 1\n", "state/x.py": "x = 1\n"})
    engine = Engine(spark, config)
    assert engine.index_repo(str(tmp_path / "repo")).chunk_count == 1
    assert not engine.index_repo(str(tmp_path / "repo")).indexed


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from stratasearch.cli import main

    monkeypatch.setenv("STRATASEARCH_PROJECTS_FILE", str(tmp_path / "projects.json"))
    config = tmp_path / "config.json"
    config.write_text('{"store": {"path": "' + str(tmp_path / "tables") + '"}}')
    write(tmp_path / "repo", {"a.py": "alpha = 1\n"})
    os.makedirs(tmp_path / "repo" / ".git")
    assert main(["projects", "scan", str(tmp_path)]) == 0
    assert main(["projects", "list"]) == 0 and "repo" in capsys.readouterr().out
    assert main(["--config", str(config), "index"], spark) == 0
    assert main(["--config", str(config), "search", "alpha"], spark) == 0
    assert "a.py:1-1" in capsys.readouterr().out
    assert main(["--config", str(config), "status"], spark) == 0
    assert main(["--config", str(config), "find-related", "a.py", "1", "--repo", "/missing"], spark) == 1
    assert main(["--config", str(config), "index", "/missing"], spark) == 1
    assert main(["init", "--path", str(tmp_path / "new.json")]) == 0
    assert main(["init", "--path", str(tmp_path / "new.json")]) == 1
    assert main(["projects", "remove", str(tmp_path / "repo")]) == 0


def test_server(engine, tmp_path, monkeypatch, capsys):
    import json
    import threading

    from stratasearch.cli import main
    from stratasearch.serve import Client, Server, answer_tool, related_tool, running_client, spawn_lock

    file = tmp_path / "server.json"
    with pytest.raises(ConnectionError):
        Client(file).ask("ping")
    server = Server(engine, file)
    thread = threading.Thread(target=server.run, daemon=True)
    thread.start()
    while not file.exists():
        pass
    client = Client(file)
    assert client.ask("ping") == "pong" and client.ask("status")["repos"] == 2 and oct(file.stat().st_mode)[-3:] == "600"
    found = client.ask("search", query="UserService", top_k=1)
    assert found[0]["chunk"]["file_path"] == "users.py" and found[0]["rank"] == 1
    with pytest.raises(RepoNotIndexedError):
        client.ask("find_related", file_path="a.py", line=1, repo="/missing")
    for method, params in (("nothing", {}), ("search", {"wrong": 1})):
        with pytest.raises(ValueError):
            client.ask(method, **params)
    assert server.answer(json.dumps({"token": "no", "method": "ping"}).encode())["kind"] == "token"
    assert server.answer(b"not json")["kind"] == "request"
    assert running_client(engine.config, file=file, start=False).ask("ping") == "pong"
    other = Config()
    other.embedding.batch_size = 7
    with pytest.raises(ConnectionError):
        Client(file, config=other).ask("ping")
    monkeypatch.setenv("STRATASEARCH_SERVER_FILE", str(file))
    settings = tmp_path / "config.json"
    settings.write_text(json.dumps({"store": {"path": engine.config.store.path}}))
    assert main(["--config", str(settings), "search", "UserService", "--top-k", "1"]) == 0 and "users.py:" in capsys.readouterr().out
    assert main(["--config", str(settings), "find-related", "a.py", "1", "--repo", "/missing"]) == 1
    assert main(["--config", str(settings), "server", "status"]) == 0
    with spawn_lock(file) as first, spawn_lock(file) as second:
        assert first and not second
    with spawn_lock(file) as again:
        assert again
    client.ask("shutdown")
    thread.join(10)
    assert main(["--config", str(settings), "server", "stop"]) == 1
    assert not file.exists()
    idle = Server(engine, file, idle_seconds=0.2)
    idle.run()  # stops by itself
    assert "users.py" in answer_tool(engine, "UserService", 1)
    assert "not indexed" in answer_tool(engine, "x", scope="workspace", workspace="/missing")
    assert "users.py" in answer_tool(engine, "UserService", 1, "workspace", workspace=str(engine.base / "one"))
    with pytest.raises(ValueError):
        answer_tool(engine, "x", 0)
    one = str(engine.base / "one")
    assert "login.py" in related_tool(engine, one, "auth.py", 1) and "No chunk" in related_tool(engine, one, "auth.py", 999)
    assert "not indexed" in related_tool(engine, "/missing", "auth.py", 1)


def test_definitions_outside_the_candidates(engine):
    from stratasearch.plans import search as plans

    tables = [engine.store.table(n) for n in ("chunks", "vectors", "postings", "doc_stats")]
    asked = engine.spark.createDataFrame([(0, "add")], "query_id long, query string")
    usual = plans.search(asked, *tables, engine.store.repos(), engine.encoder, top_k=1, coarse_multiplier=1)
    more = plans.search(asked, *tables, engine.store.repos(), engine.encoder, top_k=9, coarse_multiplier=1, outside=True)
    assert usual.count() == 1 and more.columns == usual.columns and more.count() >= 1
