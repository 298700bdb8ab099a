"""The registry of projects: a keyed table in a JSON file, from a repository's source to its settings.

The file holds ``{"projects": [{"source": ..., "name": ..., "ref": ..., "include_text_files": ...}]}``; settings that are off are left out. It is replaced as
a whole, so a reader sees the old state or the new one.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

from .git import identity, is_remote

PROJECTS_VARIABLE = "STRATASEARCH_PROJECTS_FILE"


class Project(NamedTuple):
    """A registered repository and its settings."""

    source: str
    name: str | None = None
    ref: str | None = None
    include_text_files: bool = False

    def title(self) -> str:
        """The name to show: the given one, else the last part of the source."""
        last = [part for part in self.source.split("/") if part][-1:] or [self.source]
        return self.name or (last[0].removesuffix(".git") if is_remote(self.source) else last[0]) or self.source


class Registry:
    """Projects by source. Every change reads the file, applies itself, and replaces the file."""

    def __init__(self, file: str | Path | None = None):
        self.file = Path(file or os.environ.get(PROJECTS_VARIABLE) or "~/.stratasearch/projects.json").expanduser()

    def table(self) -> dict[str, Project]:
        """All projects by source, in the order in which they came; what isn't an object with a source is passed over."""
        try:
            listed = json.loads(self.file.read_text(encoding="utf-8") or "{}")
        except FileNotFoundError:
            return {}
        rows = listed.get("projects") if isinstance(listed, dict) else None
        found = (self.project(**{k: r[k] for k in Project._fields if r.get(k)}) for r in rows or () if isinstance(r, dict) and r.get("source"))
        return {p.source: p for p in found}

    @staticmethod
    def project(source: str, name: str | None = None, ref: str | None = None, include_text_files: bool = False) -> Project:
        """A project with its source in the form that is compared; an empty source is refused."""
        if not str(source).strip():
            raise ValueError("a project needs a source")
        return Project(identity(str(source).strip()), name, ref, bool(include_text_files))

    def upsert(self, project: Project) -> Project:
        """Add a project; one with the same source is replaced in its place."""
        self._replace(self.table() | {project.source: project})
        return project

    def delete(self, source: str) -> bool:
        """Whether there was a project with this source; it is gone now."""
        table = self.table()
        gone = table.pop(self.project(source).source, None)
        if gone is not None:
            self._replace(table)
        return gone is not None

    def __iter__(self) -> Iterator[Project]:
        return iter(self.table().values())

    def _replace(self, table: dict[str, Project]) -> None:
        os.makedirs(self.file.parent, exist_ok=True)
        listed = [{k: v for k, v in p._asdict().items() if v} for p in table.values()]
        with tempfile.NamedTemporaryFile("w", dir=self.file.parent, suffix=".new", delete=False, encoding="utf-8") as out:
            json.dump({"projects": listed}, out, indent=2)
        os.replace(out.name, self.file)
