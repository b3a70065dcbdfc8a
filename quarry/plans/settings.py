"""Configuration: strict files, a fingerprint of what decides an index's content, names resolved or refused, parts chosen."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from hashlib import sha256
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.classify import DOC_TYPES
from ..operators.embedding import Backend, hashing_backend
from ..operators.retrieval import lexical_score

# What callers say for a type, by type.
ALIASES = {
    "spec": "normative", "specification": "normative", "standard": "normative", "convention": "normative", "conventions": "normative", "adr": "normative", "rule": "normative", "rules": "normative", "policy": "normative",
    "requirement": "normative", "requirements": "normative", "architecture": "design", "rfc": "design", "proposal": "design", "plan": "design", "readme": "guide", "tutorial": "guide", "runbook": "guide", "howto": "guide",
    "docs": "reference", "api": "reference", "changelog": "record", "history": "record", "postmortem": "record", "code": "implementation", "source": "implementation", "impl": "implementation", "tests": "test", "fixture": "test",
    "lockfile": "generated",
}
#: Left out whatever a configuration says: version control, the engine's own tables and logs, and evaluation files, which quote every query.
ALWAYS_EXCLUDED = ["**/.git/**", "logs/**", "**/logs/**", "data/**", "**/*.sqlite3", "**/*.sqlite3-journal", "evals/**", "**/evals/**"]


class ConfigError(ValueError):
    """A configuration that says something twice, something unknown, or something of the wrong kind."""


class UnknownName(ValueError):
    """A name that stands for nothing; carries those that would."""

    def __init__(self, kind: str, given: str, valid: list[str]):
        super().__init__(f"unknown {kind} {given!r}; known: {', '.join(valid)}")
        self.given, self.valid = given, valid


def document_type(given: str) -> str:
    """A type by its name or an alias, case and hyphens aside."""
    key = given.strip().lower().replace("-", "_")
    found = key if key in DOC_TYPES else ALIASES.get(key)
    if found is None:
        raise UnknownName("document type", given, [*DOC_TYPES, *sorted(ALIASES)])
    return found


@dataclass(frozen=True)
class IndexConfig:
    exclude: list[str] = field(default_factory=list)
    max_file_bytes: int = 1 << 20
    embedding_model: str = "hashing:64"
    dimensions: int = 64
    rerank_enabled: bool = False
    rerank_model: str = "lexical"
    rerank_candidates: int = 50
    on_error: str = "degrade"
    secrets_allow: list[str] = field(default_factory=list)

    @property
    def all_excludes(self) -> list[str]:
        return [*ALWAYS_EXCLUDED, *self.exclude]


@dataclass(frozen=True)
class Workspace:
    name: str
    roots: dict[str, str]
    index: IndexConfig = field(default_factory=IndexConfig)
    repositories: dict[str, str] = field(default_factory=dict)


def _once(pairs: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for key, value in pairs:
        if key in out:
            raise ConfigError(f"{key!r} stands twice")
        out[key] = value
    return out


def read_mapping(text: str, kind: str) -> dict:
    """JSON, or YAML where a parser for it is installed. A key that stands twice is refused, not overwritten."""
    if kind == "json":
        try:
            return json.loads(text, object_pairs_hook=_once)
        except json.JSONDecodeError as e:
            raise ConfigError(str(e)) from e
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("no YAML parser is installed; write the configuration as JSON") from e

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        return _once([(loader.construct_object(k, deep=True), loader.construct_object(v, deep=True)) for k, v in node.value])

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    try:
        return yaml.load(text, Strict) or {}  # noqa: S506  a safe loader
    except yaml.YAMLError as e:
        raise ConfigError(str(e)) from e


def _made(kind: type, given: object, where: str):
    if not isinstance(given, dict):
        raise ConfigError(f"{where} is no mapping")
    known = {f.name: f for f in fields(kind)}
    if wrong := sorted(set(given) - set(known)):
        raise ConfigError(f"{where} has no {', '.join(wrong)}; it has {', '.join(known)}")
    values = {k: _made(IndexConfig, v, f"{where}.{k}") if k == "index" else v for k, v in given.items()}
    base = kind(**values) if kind is IndexConfig else kind(**({"name": "", "roots": {}} | values))
    for k, v in values.items():
        want = type(getattr(IndexConfig(), k)) if kind is IndexConfig else {"name": str, "roots": dict, "index": IndexConfig, "repositories": dict}[k]
        if not isinstance(v, want) or want is int and isinstance(v, bool):
            raise ConfigError(f"{where}.{k} is no {want.__name__}")
    if kind is Workspace and not (base.name and base.roots):
        raise ConfigError(f"{where} needs a name and roots")
    if kind is IndexConfig and base.on_error not in ("degrade", "fail"):
        raise ConfigError(f"{where}.on_error is degrade or fail")
    return base


def load(path: str | Path) -> list[Workspace]:
    """The workspaces of a file: one mapping, or several under `workspaces`."""
    own = read_mapping(Path(path).read_text(encoding="utf-8"), "json" if str(path).endswith(".json") else "yaml")
    rows = own["workspaces"] if set(own) == {"workspaces"} and isinstance(own["workspaces"], list) else [own]
    out = [_made(Workspace, r, f"workspace {n}") for n, r in enumerate(rows, 1)]
    if len({w.name for w in out}) < len(out):
        raise ConfigError("two workspaces have one name")
    return out


def select(workspaces: list[Workspace], name: str | None = None) -> Workspace:
    """The workspace of that name, or the only one."""
    names = [w.name for w in workspaces]
    if name is None:
        if len(workspaces) != 1:
            raise UnknownName("workspace", "", names)
        return workspaces[0]
    if name not in names:
        raise UnknownName("workspace", name, names)
    return workspaces[names.index(name)]


class Reloading:
    """A configuration file that may change: a version that can't be read is logged and the last good one stays."""

    def __init__(self, path: str | Path):
        self.path, self.held, self._seen = path, load(path), None
        self._seen = self._stamp()

    def _stamp(self) -> str:
        return sha256(Path(self.path).read_bytes()).hexdigest()

    def current(self) -> list[Workspace]:
        try:
            stamp = self._stamp()
            if stamp != self._seen:
                self.held, self._seen = load(self.path), stamp
        except (ConfigError, OSError) as e:
            logging.getLogger("quarry").warning("configuration stays as it was: %s", e)
        return self.held


def fingerprint(workspace: Workspace) -> str:
    """Sixteen hex digits of what decides an index's content: roots, exclusions and model; not how results are ordered or shown."""
    index = asdict(workspace.index)
    held = {k: v for k, v in index.items() if not k.startswith("rerank") and k != "on_error"}
    return sha256(json.dumps({"name": workspace.name, "roots": workspace.roots, "index": held}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def fingerprint_column(struct: Column) -> Column:
    """The same digest of a struct's JSON (fields in the order of the struct)."""
    return F.left(F.sha2(F.to_json(struct).cast("binary"), 256), F.lit(16))


def backend(model: str) -> tuple[Backend, int]:
    """A backend by its name, provider:width."""
    provider, _, width = model.partition(":")
    if provider != "hashing" or not width.isdigit():
        raise UnknownName("embedding model", model, ["hashing:WIDTH"])
    return hashing_backend(int(width)), int(width)


def reranker(config: IndexConfig) -> Callable[[Column, Column], Column] | None:
    """The scorer of a configuration: none if reranking is off; an unknown one is an error, not a silent none."""
    if not config.rerank_enabled:
        return None
    if config.rerank_model != "lexical":
        raise UnknownName("reranker", config.rerank_model, ["lexical"])
    return lexical_score


def cost_display(cost, unpriced, estimated) -> Column:
    """Unpriced requests are told from free ones, an estimate from a bill."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    money = F.format_string("$%.4f", c(cost).cast("double"))
    return F.when(c(unpriced) > 0, F.format_string("unpriced (%d)", c(unpriced))).when(c(estimated), F.concat(F.lit("~"), money)).otherwise(money)
