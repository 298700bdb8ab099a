"""Command line: python -m stratasearch.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .plans.engine import Engine
from .plans.search import rendered
from .plans.store import RepoNotIndexedError
from .serve import Client, Server, running_client
from .session import local_session
from .sources import git, projects
from .sources.config import Config, load_config, template


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="stratasearch", description="Search code and text in many repositories.")
    parser.add_argument("--config", help="configuration file")
    parser.add_argument("--server", action="store_true", help="answer searches by the server that keeps a session, started if need be")
    parser.add_argument("--no-server", action="store_true", help="never ask a server, even if one is running")
    commands = parser.add_subparsers(dest="command", required=True)
    init = commands.add_parser("init", help="write a configuration to start from")
    init.add_argument("--path", default="stratasearch.json")
    init.add_argument("--force", action="store_true")
    for name in ("index", "reindex"):
        index = commands.add_parser(name, help="index repositories; without any, all registered projects")
        index.add_argument("repos", nargs="*")
        index.add_argument("--ref")
        index.add_argument("--include-text-files", action="store_true")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--repo")
    search.add_argument("--top-k", type=int, default=5)
    related = commands.add_parser("find-related")
    related.add_argument("file_path")
    related.add_argument("line", type=int)
    related.add_argument("--repo", required=True)
    related.add_argument("--top-k", type=int, default=5)
    commands.add_parser("status")
    serve = commands.add_parser("serve", help="keep a session and answer clients")
    serve.add_argument("--idle-seconds", type=float, default=0.0)
    commands.add_parser("server", help="the running server").add_argument("action", choices=("status", "stop"))
    project = commands.add_parser("projects").add_subparsers(dest="action", required=True)
    add = project.add_parser("add")
    add.add_argument("source")
    add.add_argument("--name")
    add.add_argument("--ref")
    add.add_argument("--include-text-files", action="store_true")
    project.add_parser("list")
    project.add_parser("remove").add_argument("source")
    scan = project.add_parser("scan")
    scan.add_argument("root")
    scan.add_argument("--depth", type=int, default=3)
    return parser


def _projects(args) -> int:
    registry = projects.Registry()
    if args.action == "add":
        print(registry.upsert(registry.project(args.source, args.name, args.ref, args.include_text_files)).source)
    elif args.action == "remove":
        return 0 if registry.delete(args.source) else 1
    elif args.action == "scan":
        for path in git.find_repositories(args.root, args.depth):
            print(registry.upsert(registry.project(path)).source)
    else:
        for entry in registry:
            print(f"{entry.title()}\t{entry.source}")
    return 0


def _index(engine: Engine, args) -> int:
    """All given repositories, or all projects, in one run; those that fail are told, the others are indexed."""
    given = [projects.Project(r, None, args.ref, args.include_text_files) for r in args.repos] or list(projects.Registry())
    done = engine.index_repos([(p.source, p.include_text_files, p.ref) for p in given], args.command == "reindex")
    for entry, outcome in zip(given, done):
        if isinstance(outcome, Exception):
            print(f"{entry.title()}: {outcome}", file=sys.stderr)
        else:
            print(f"{entry.title()}: {outcome.chunk_count} chunks{'' if outcome.indexed else ' (unchanged)'}")
    return int(any(isinstance(outcome, Exception) for outcome in done))


def _show(found, nothing: str) -> int:
    blocks = rendered(found).orderBy("rank").collect()  # top_k rows
    print("\n".join(r["block"] for r in blocks) if blocks else nothing)
    return 0


def _by_server(args, config: Config) -> int | None:
    """A search that a running server answers; None where there is no such server, and this process has to do it."""
    try:
        client = running_client(config, args.config, start=args.server)
        if args.command == "search":
            rows = client.ask("search", query=args.query, top_k=args.top_k, repo=args.repo)
        else:
            rows = client.ask("find_related", file_path=args.file_path, line=args.line, repo=args.repo, top_k=args.top_k)
    except (ConnectionError, OSError):
        return None
    except (RepoNotIndexedError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1
    for r in rows:
        chunk, source = r["chunk"], f"repo: {r['repo_source']}\n" if r["repo_source"] else ""
        print(f"## {r['rank']}. {r['repo_name']} :: {chunk['file_path']}:{chunk['start_line']}-{chunk['end_line']}  [score={r['score']:.3f}]\n{source}```\n{chunk['content'].strip()}\n```\n")
    if not rows:
        print("no results")
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "init":
        path = Path(args.path)
        if path.exists() and not args.force:
            print(f"{path} is there already", file=sys.stderr)
            return 1
        path.write_text(template(), encoding="utf-8")
        return 0
    if args.command == "projects":
        return _projects(args)
    config = load_config(args.config)
    if args.command == "server":
        try:
            client = Client(config=config)
            print(client.ask("shutdown") if args.action == "stop" else client.ask("status"))
            return 0
        except ConnectionError as error:
            print(error, file=sys.stderr)
            return 1
    if args.command in ("search", "find-related") and not args.no_server:
        answered = _by_server(args, config)
        if answered is not None:
            return answered
    engine = Engine(spark or local_session(), config)
    try:
        if args.command in ("index", "reindex"):
            return _index(engine, args)
        if args.command == "search":
            return _show(engine.search(args.query, args.top_k, args.repo), "no results")
        if args.command == "find-related":
            return _show(engine.find_related(args.file_path, args.line, args.repo, args.top_k), "no results")
        if args.command == "serve":
            Server(engine, idle_seconds=args.idle_seconds).run()
            return 0
        row = engine.status().first()
        print(f"{row['repos']} repositories, {row['chunks']} chunks\n{row['sources']}")
        return 0
    except RepoNotIndexedError as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
