"""Run configuration: presets, override merging, templating and strict keys."""

from __future__ import annotations

import copy
import os
import re
from dataclasses import dataclass, field, fields
from pathlib import Path

import yaml

#: Named starting points; each is a partial configuration.
PRESETS: dict[str, dict] = {
    "bm25": {"retrieval": {"engine": "bm25"}},
    "bm25-floored": {"retrieval": {"engine": "bm25", "floor_idf": True}},
    "dense": {"retrieval": {"engine": "dense", "metric": "ip"}},
    "dense-cosine": {"retrieval": {"engine": "dense", "metric": "cosine"}},
    "dense-l2": {"retrieval": {"engine": "dense", "metric": "l2"}},
    "sparse": {"retrieval": {"engine": "sparse"}},
    "hybrid-rrf": {"retrieval": {"engine": "hybrid", "members": ["dense", "bm25"], "fusion": "rrf"}},
    "hybrid-weighted": {"retrieval": {"engine": "hybrid", "members": ["dense", "bm25"], "fusion": "weighted", "weights": [0.5, 0.5]}},
    "rerank-dense": {"retrieval": {"engine": "bm25"}, "rerank": {"kind": "dense", "head": 50, "method": "weight"}},
    "stored": {"retrieval": {"engine": "file"}},
}
ENGINES = ("bm25", "dense", "sparse", "hybrid", "file")


class ConfigError(ValueError):
    """A configuration that cannot be run."""


@dataclass
class Retrieval:
    engine: str = "bm25"
    top_k: int = 10
    metric: str = "ip"
    floor_idf: bool = False
    k1: float = 1.2
    b: float = 0.75
    members: list[str] = field(default_factory=list)
    fusion: str = "rrf"
    constant: int = 60
    weights: list[float] | None = None
    normalizer: str = "minmax"
    terms: int = 128
    dimensions: int = 256
    duplicate_removal: str = "none"
    similarity: float = 0.9
    filters: list[dict] = field(default_factory=list)
    path: str | None = None
    query_prefix: str = ""
    document_prefix: str = ""


@dataclass
class Tiling:
    most: int = 512
    stride: int = 100
    title: str = "all"
    aligned: bool = True
    mask_urls: bool = True


@dataclass
class Rerank:
    kind: str = "none"
    head: int = 0
    method: str = "none"
    weight: float = 0.5


@dataclass
class Evaluation:
    ranks: list[int] = field(default_factory=lambda: [1, 3, 5, 10])
    ideal: str = "textbook"
    match_by: str = "id"


@dataclass
class Config:
    retrieval: Retrieval = field(default_factory=Retrieval)
    tiling: Tiling = field(default_factory=Tiling)
    rerank: Rerank = field(default_factory=Rerank)
    evaluation: Evaluation = field(default_factory=Evaluation)
    data: dict = field(default_factory=dict)

    def checked(self) -> Config:
        r = self.retrieval
        if r.engine.replace("_", "-") not in ENGINES:
            raise ConfigError(f"engine {r.engine!r}; known: {', '.join(ENGINES)}")
        if r.engine == "hybrid":
            if len(r.members) < 1 or any(m not in ENGINES or m in ("hybrid", "file") for m in r.members):
                raise ConfigError("a hybrid needs members among bm25, dense and sparse")
            if r.fusion not in ("rrf", "weighted"):
                raise ConfigError(f"fusion {r.fusion!r}")
            if r.fusion == "weighted" and r.weights is not None and len(r.weights) != len(r.members):
                raise ConfigError("one weight a member is needed")
        if self.rerank.kind not in ("none", "dense", "sparse", "pairs"):
            raise ConfigError(f"reranker {self.rerank.kind!r}")
        if self.tiling.title not in ("all", "first", "none"):
            raise ConfigError(f"title policy {self.tiling.title!r}")
        return self


def merge(base: dict, *others: dict) -> dict:
    """Deep merge: dictionaries merge, anything else is replaced; the inputs stay as they are."""
    out = copy.deepcopy(base)
    for other in others:
        for key, value in other.items():
            if isinstance(value, dict) and isinstance(out.get(key), dict):
                out[key] = merge(out[key], value)
            else:
                out[key] = copy.deepcopy(value)
    return out


def parse_overrides(items: list[str]) -> dict:
    """``["a.b=1", "c=x"]`` as nested dictionaries; values are read as YAML."""
    out: dict = {}
    for item in items:
        key, equal, value = item.partition("=")
        if not equal or not key.strip():
            raise ConfigError(f"an override is key=value, not {item!r}")
        node: dict = {}
        at = node
        *path, last = key.strip().split(".")
        for step in path:
            at[step] = {}
            at = at[step]
        at[last] = yaml.safe_load(value) if value else ""
        out = merge(out, node)
    return out


_VARIABLE = re.compile(r"\{\{\s*([\w.]+)\s*\}\}")


def resolve(config: dict, most_passes: int = 10) -> dict:
    """Replace ``{{name}}`` by the value of that key in the same section or one above, until nothing changes."""

    def find(name: str, scopes: list[dict]):
        for scope in reversed(scopes):
            node = scope
            for step in name.split("."):
                node = node.get(step) if isinstance(node, dict) else None
            if node is not None and not isinstance(node, (dict, list)):
                return node
        return None

    def walk(node, scopes):
        if isinstance(node, dict):
            return {k: walk(v, [*scopes, node]) for k, v in node.items()}
        if isinstance(node, list):
            return [walk(v, scopes) for v in node]
        if isinstance(node, str):
            whole = _VARIABLE.fullmatch(node.strip())
            if whole and (value := find(whole[1], scopes)) is not None and value != node:
                return value
            return _VARIABLE.sub(lambda m: str(v) if (v := find(m[1], scopes)) is not None and m[0] not in str(v) else m[0], node)
        return node

    for _ in range(most_passes):
        after = walk(config, [])
        if after == config:
            break
        config = after
    left = sorted(set(_VARIABLE.findall(str(config))))
    if left:
        raise ConfigError(f"unresolved: {', '.join(left)}")
    return config


def locate(name: str, folders: list[str] | None = None) -> Path:
    """A configuration file: as given, or in the folders of ``SPARKDR_CONFIG_PATH`` and the arguments."""
    for folder in ["", *(folders or []), *filter(None, os.environ.get("SPARKDR_CONFIG_PATH", "").split(os.pathsep))]:
        for suffix in ("", ".yaml", ".yml", ".json"):
            path = Path(folder) / f"{name}{suffix}"
            if path.is_file():
                return path
    raise ConfigError(f"no configuration {name!r}")


def preset(name: str) -> dict:
    key = name.replace("_", "-")
    if key not in PRESETS:
        raise ConfigError(f"preset {name!r}; known: {', '.join(PRESETS)}")
    return copy.deepcopy(PRESETS[key])


def build(values: dict) -> Config:
    """A checked configuration from nested values; unknown keys are errors."""
    out, sections = Config(), {f.name: f for f in fields(Config)}
    for name, value in values.items():
        if name not in sections:
            raise ConfigError(f"unknown section {name!r}")
        if name == "data":
            out.data = dict(value)
            continue
        section = getattr(out, name)
        known = {f.name for f in fields(section)}
        for key, item in (value or {}).items():
            if key not in known:
                raise ConfigError(f"unknown key {name}.{key}")
            setattr(section, key, item)
    return out.checked()


def load(preset_name: str | None = None, file: str | None = None, overrides: list[str] = (), folders: list[str] | None = None) -> Config:
    """Preset, then file, then overrides; later ones win."""
    values = preset(preset_name) if preset_name else {}
    if file:
        values = merge(values, yaml.safe_load(locate(file, folders).read_text(encoding="utf-8")) or {})
    return build(resolve(merge(values, parse_overrides(list(overrides)))))
