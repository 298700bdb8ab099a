"""Repositories: local directories, and clones of remote ones."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import subprocess

from ..functions.text import GIT_URL

_REMOTE = re.compile(GIT_URL)
TIMEOUT_S = 300


def is_remote(source: str) -> bool:
    """Whether a source is a remote address."""
    return _REMOTE.search(source) is not None


def identity(source: str, ref: str | None = None) -> str:
    """What a repository is known by: its address, with a branch or tag if one is asked for, or its absolute path."""
    if is_remote(source):
        return f"{source}#ref={ref}" if ref else source
    return os.path.realpath(os.path.expanduser(source))


def _git(*args: str, cwd: str | None = None) -> str | None:
    try:
        done = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True, timeout=TIMEOUT_S)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def checkout(source: str, ref: str | None, clones: str, force: bool = False) -> str:
    """A local directory with the source's files. Remote ones are cloned without history, or brought up to date.

    Only http and https are cloned; where an update fails, the clone that is there is used.
    """
    if not is_remote(source):
        path = identity(source)
        if not os.path.isdir(path):
            raise FileNotFoundError(f"no such directory: {path}")
        return path
    if not source.startswith(("http://", "https://")):
        raise ValueError(f"only http and https addresses are cloned: {source}")
    target = os.path.join(clones, hashlib.sha256(f"{source}|{ref or ''}".encode()).hexdigest()[:16])
    if force and os.path.isdir(target):
        shutil.rmtree(target)
    if os.path.isdir(target):
        if _git("fetch", "--depth", "1", "--", "origin", ref or "HEAD", cwd=target) is not None:
            _git("reset", "--hard", "FETCH_HEAD", cwd=target)
        return target
    os.makedirs(clones, exist_ok=True)
    branch = [f"--branch={ref}"] if ref else []
    if _git("clone", "--depth", "1", *branch, "--", source, target) is None:
        raise RuntimeError(f"cloning {source} failed")
    return target


def head(path: str) -> str | None:
    """The commit that is checked out, or None outside of a repository."""
    return _git("rev-parse", "HEAD", cwd=path) or None


def is_dirty(path: str) -> bool:
    """Whether there are changes that aren't committed; failures count as such."""
    status = _git("status", "--porcelain", cwd=path)
    return status is None or status != ""


def source_state(path: str, listed) -> str:
    """What a scan's result depends on: the commit of a clean repository, else a hash of its files' paths, sizes and times."""
    commit = head(path) if os.path.isdir(os.path.join(path, ".git")) else None
    if commit and not is_dirty(path):
        return f"git:{commit}"
    digest = hashlib.sha256()
    for file_path, size, mtime in sorted(listed):
        digest.update(f"{file_path}|{size}|{mtime}\n".encode())
    return f"files:{digest.hexdigest()}"


# Directories that a search for repositories doesn't enter, besides hidden ones.
NOT_SEARCHED = ("node_modules", "venv", "__pycache__", "dist", "build")


def find_repositories(root: str, depth: int = 3) -> list[str]:
    """Directories with a ``.git`` directory, down to a depth, in sorted order; nothing below one is searched."""
    top = os.path.abspath(os.path.expanduser(root))
    found = []
    for path, names, _ in os.walk(top):
        below = [] if path == top else os.path.relpath(path, top).split(os.sep)
        if ".git" in names:
            found.append(path)
            names.clear()
        elif len(below) >= depth:
            names.clear()
        names[:] = sorted(n for n in names if not n.startswith(".") and n not in NOT_SEARCHED)
    return sorted(found)
