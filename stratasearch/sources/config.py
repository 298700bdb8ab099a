"""Configuration from JSON (or YAML, where a reader for it is installed), with environment variables filled in."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path

CONFIG_VARIABLE = "STRATASEARCH_CONFIG"
#: Where a configuration is looked for, in this order: the working directory, the user's configuration, the engine's own folder.
DEFAULT_PLACES = tuple(f"{stem}.{kind}" for stem in ("stratasearch", "~/.config/stratasearch/config", "~/.stratasearch/config") for kind in ("yaml", "yml", "json"))
_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


@dataclass
class EmbeddingConfig:
    model: str = "hashing"
    dim: int = 64
    batch_size: int = 512
    max_retries: int = 3
    url: str = ""
    key: str = ""
    context: int = 8192


@dataclass
class RankingConfig:
    coarse_multiplier: int = 5


@dataclass
class IndexingConfig:
    max_file_bytes: int = 1_000_000
    max_chunk_chars: int = 12_000
    desired_chunk_chars: int = 1500


@dataclass
class StoreConfig:
    path: str = "~/.stratasearch/store"
    clones: str = "~/.stratasearch/clones"
    metric: str = "ip"


@dataclass
class Config:
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    ranking: RankingConfig = field(default_factory=RankingConfig)
    indexing: IndexingConfig = field(default_factory=IndexingConfig)
    store: StoreConfig = field(default_factory=StoreConfig)


def substituted(value):
    """Strings with ``${NAME}`` or ``${NAME:-default}`` filled in, at any depth; an unset name without a default stays as it is written."""
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: os.environ.get(m[1], m[0] if m[2] is None else m[2]), value)
    if isinstance(value, dict):
        return {k: substituted(v) for k, v in value.items()}
    if isinstance(value, list):
        return [substituted(v) for v in value]
    return value


def _filled(kind, data: dict):
    known = {f.name: f for f in fields(kind)}
    unknown = set(data) - set(known)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    made = kind()
    for name, value in data.items():
        current = getattr(made, name)
        setattr(made, name, _filled(type(current), value or {}) if is_dataclass(current) else type(current)(value))
    return made


def _parsed(path: Path) -> dict:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text or "{}")
    if path.suffix in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(text) or {}
    raise ValueError(f"a configuration is .json, .yaml or .yml: {path}")


def load_config(path: str | None = None) -> Config:
    """The configuration of a file, of the file that the environment names, or of the first default place; else the defaults."""
    given = path or os.environ.get(CONFIG_VARIABLE)
    places = [given] if given else list(DEFAULT_PLACES)
    for place in places:
        file = Path(place).expanduser()
        if file.is_file():
            return _filled(Config, substituted(_parsed(file)))
        if given and file.suffix not in (".json", ".yaml", ".yml"):
            raise ValueError(f"a configuration is .json, .yaml or .yml: {file}")
    return Config()


def template() -> str:
    """The defaults, as a file to start from."""
    return json.dumps(asdict(Config()), indent=2) + "\n"
