"""A session that stays: the engine behind a socket, for clients that don't want to start Spark.

One JSON object a line: ``{"token": ..., "method": ..., "params": {...}}`` is answered by ``{"result": ...}`` or ``{"error": ..., "kind": ...}``. The
address and the token are in a file that only its owner can read; it appears when the server listens and goes when it stops. The file also names the
version and a hash of the configuration: a client of another version or configuration takes the server for none.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import secrets
import socket
import socketserver
import subprocess
import sys
import threading
import time
from collections.abc import Iterator
from dataclasses import asdict
from pathlib import Path

from .plans.engine import Engine
from .plans.search import rendered, to_wire
from .plans.store import RepoNotIndexedError
from .sources.config import Config

VERSION = "2"
METHODS = ("ping", "status", "search", "find_related", "shutdown")


def default_file() -> Path:
    return Path(os.environ.get("STRATASEARCH_SERVER_FILE", "~/.stratasearch/server.json")).expanduser()


def configuration_mark(config: Config) -> str:
    """A hash of everything that is configured."""
    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True).encode()).hexdigest()[:16]


def _rows(found) -> list[dict]:
    """Results of one query (top_k rows) as objects."""
    return [{"rank": r["rank"], **json.loads(r["json"])} for r in to_wire(found).orderBy("rank").collect()]


class Server:
    """Serves one engine until ``shutdown`` is asked for or nothing was asked for ``idle_seconds``."""

    def __init__(self, engine: Engine, file: Path | None = None, idle_seconds: float = 0.0):
        self.engine, self.file, self.idle = engine, file or default_file(), idle_seconds
        self.token, self.last = secrets.token_hex(16), time.monotonic()
        outer = self

        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                line = self.rfile.readline()
                reply = outer.answer(line) if line else {"error": "nothing asked", "kind": "request"}
                self.wfile.write((json.dumps(reply) + "\n").encode())

        self.listener = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Handler)
        self.listener.daemon_threads = True

    def answer(self, line: bytes) -> dict:
        """The reply to one request."""
        self.last = time.monotonic()
        try:
            asked = json.loads(line)
            if not isinstance(asked, dict) or not secrets.compare_digest(str(asked.get("token", "")), self.token):
                return {"error": "wrong token", "kind": "token"}
            method, params = asked.get("method"), asked.get("params") or {}
            if method not in METHODS:
                return {"error": f"no method {method!r}", "kind": "method"}
            return {"result": getattr(self, f"do_{method}")(**params)}
        except RepoNotIndexedError as error:
            return {"error": str(error), "kind": "not indexed", "repo_id": error.repo_id, "source": error.source}
        except (ValueError, TypeError) as error:
            return {"error": str(error), "kind": "request"}

    def do_ping(self) -> str:
        return "pong"

    def do_status(self) -> dict:
        return self.engine.status().first().asDict()

    def do_search(self, query: str, top_k: int = 5, repo: str | None = None) -> list[dict]:
        return _rows(self.engine.search(query, top_k, repo))

    def do_find_related(self, file_path: str, line: int, repo: str, top_k: int = 5) -> list[dict]:
        return _rows(self.engine.find_related(file_path, line, repo, top_k))

    def do_shutdown(self) -> str:
        threading.Thread(target=self.listener.shutdown, daemon=True).start()
        return "stopping"

    def run(self) -> None:
        """Listen until stopped."""
        self.file.parent.mkdir(parents=True, exist_ok=True)
        new = self.file.with_suffix(".new")
        descriptor = os.open(new, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
        with os.fdopen(descriptor, "w") as out:
            mark = configuration_mark(self.engine.config)
            json.dump({"port": self.listener.server_address[1], "token": self.token, "pid": os.getpid(), "version": VERSION, "config": mark}, out)
        os.replace(new, self.file)
        if self.idle > 0:
            threading.Thread(target=self._watch, daemon=True).start()
        try:
            self.listener.serve_forever(poll_interval=0.1)
        finally:
            self.listener.server_close()
            self.file.unlink(missing_ok=True)

    def _watch(self) -> None:
        while time.monotonic() - self.last < self.idle:
            time.sleep(min(1.0, self.idle / 4))
        self.listener.shutdown()


class Client:
    """Asks a running server; raises ConnectionError where there is none, or none with this version and configuration."""

    def __init__(self, file: Path | None = None, timeout: float = 300.0, config: Config | None = None):
        self.file, self.timeout = file or default_file(), timeout
        self.mark = None if config is None else configuration_mark(config)

    def ask(self, method: str, **params):
        try:
            info = json.loads(self.file.read_text())
        except (OSError, ValueError) as error:
            raise ConnectionError("no server is running") from error
        if info.get("version") != VERSION or self.mark not in (None, info.get("config")):
            raise ConnectionError("the server that is running has another version or configuration")
        with socket.create_connection(("127.0.0.1", info["port"]), timeout=self.timeout) as connection:
            connection.sendall((json.dumps({"token": info["token"], "method": method, "params": params}) + "\n").encode())
            reply = json.loads(connection.makefile("rb").readline())
        if "error" in reply:
            if reply["kind"] == "not indexed":
                raise RepoNotIndexedError(reply["repo_id"], reply["source"])
            raise ValueError(reply["error"])
        return reply["result"]


@contextlib.contextmanager
def spawn_lock(file: Path, patience: float = 120.0) -> Iterator[bool]:
    """Whether this process may start the server: one at a time holds the lock beside the server's file. A lock older than ``patience`` is left over."""
    lock = file.with_suffix(".lock")
    lock.parent.mkdir(parents=True, exist_ok=True)
    with contextlib.suppress(FileNotFoundError):
        if time.time() - lock.stat().st_mtime > patience:
            lock.unlink()
    try:
        os.close(os.open(lock, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600))
    except FileExistsError:
        yield False
        return
    try:
        yield True
    finally:
        lock.unlink(missing_ok=True)


def running_client(config: Config, config_path: str | None = None, file: Path | None = None, patience: float = 120.0, start: bool = True) -> Client:
    """A client of a server with this configuration, which is started if need be; ConnectionError if there is none in time."""
    client, until = Client(file, config=config), time.monotonic() + patience
    with contextlib.suppress(ConnectionError, OSError):
        client.ask("ping")
        return client
    if not start:
        raise ConnectionError("no server is running")
    with spawn_lock(client.file, patience) as mine:
        if mine:
            given = ["--config", config_path] if config_path else []
            environment = os.environ | {"STRATASEARCH_SERVER_FILE": str(client.file)}
            subprocess.Popen([sys.executable, "-m", "stratasearch.cli", *given, "serve", "--idle-seconds", "900"], start_new_session=True, env=environment, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
        while time.monotonic() < until:
            with contextlib.suppress(ConnectionError, OSError):
                client.ask("ping")
                return client
            time.sleep(0.2)
    raise ConnectionError("the server did not start in time")


def related_tool(engine: Engine, repo: str, file_path: str, line: int, top_k: int = 5) -> str:
    """What an assistant's find-related tool says: chunks like the one at a line, as text, or advice."""
    if top_k < 1 or line < 1:
        raise ValueError("top_k and line must be 1 or more")
    try:
        blocks = rendered(engine.find_related(file_path, line, repo, top_k)).orderBy("rank").collect()
    except RepoNotIndexedError as error:
        return f"{error}. Index it first."
    return "\n".join(r["block"] for r in blocks) or f"No chunk holds {file_path}:{line}, or nothing is like it."


def answer_tool(engine: Engine, query: str, top_k: int = 5, scope: str = "all", repo: str | None = None, workspace: str | None = None) -> str:
    """What an assistant's search tool says: results as text, or advice. A repository goes before the scope ``workspace``."""
    if top_k < 1:
        raise ValueError("top_k must be 1 or more")
    target = repo
    if target is None and scope == "workspace":
        try:
            target = engine.resolve_repo_id(workspace or os.getcwd())
        except RepoNotIndexedError:
            return "This directory is not indexed. Index it, or search all repositories."
    try:
        blocks = rendered(engine.search(query, top_k, target)).orderBy("rank").collect()
    except RepoNotIndexedError as error:
        return f"{error}. Index it first."
    return "\n".join(r["block"] for r in blocks) or "No results."
