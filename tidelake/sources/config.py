"""Source, alias and environment configuration, read on the driver."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path

_VIEW = re.compile(r"[A-Za-z0-9_]+")


class ConfigError(ValueError):
    """A configuration file that cannot be used."""


@dataclass(frozen=True)
class SourceConfig:
    """Where observations come from: a query or a view, columns to rename, and the column that labels versions, if any."""

    query: str | None = None
    view: str | None = None
    db: str | None = None
    rename: dict[str, str] = field(default_factory=dict)
    version_column: str | None = None

    def __post_init__(self):
        if bool(self.query) == bool(self.view):
            raise ConfigError("exactly one of query and view is needed")
        if self.view and not _VIEW.fullmatch(self.view):
            raise ConfigError(f"not a view name: {self.view!r}")
        if self.version_column is not None and not str(self.version_column).strip():
            raise ConfigError("version_column must not be empty")

    @property
    def sql(self) -> str:
        return self.query or f"SELECT * FROM {self.view}"


def _yaml(path: str):
    try:
        import yaml
    except ImportError:
        return _plain_yaml(Path(path).read_text(encoding="utf-8"))
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def _plain_yaml(text: str):
    """Nested mappings of scalars and of "- " or "[a, b]" lists; enough for these files where no YAML library is installed."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def scalar(x: str):
        x = x.strip()
        if x[:1] in "\"'" and x[:1] == x[-1:] and len(x) > 1:
            return x[1:-1]
        if x.startswith("[") and x.endswith("]"):
            return [scalar(y) for y in x[1:-1].split(",") if y.strip()]
        if x.startswith("{") and x.endswith("}"):
            return {k.strip(): scalar(v) for k, _, v in (y.partition(":") for y in x[1:-1].split(",") if y.strip())}
        return None if x in ("", "null", "~") else x

    def block(i: int, indent: int):
        if i < len(lines) and lines[i][1].startswith("- "):
            out = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("- "):
                out.append(scalar(lines[i][1][2:]))
                i += 1
            return out, i
        found = {}
        while i < len(lines) and lines[i][0] == indent:
            key, colon, rest = lines[i][1].partition(":")
            if not colon:
                raise ConfigError(f"cannot read {lines[i][1]!r}")
            i += 1
            if not rest.strip() and i < len(lines) and lines[i][0] > indent:
                found[scalar(key)], i = block(i, lines[i][0])
            else:
                found[scalar(key)] = scalar(rest)
        return found, i

    return block(0, lines[0][0])[0] if lines else None


def load_source(path: str) -> SourceConfig:
    """A source configuration; its db path counts from the file's folder."""
    data = _yaml(path)
    if not isinstance(data, dict):
        raise ConfigError("a source configuration must be a mapping")
    if not data.get("db"):
        raise ConfigError("db is needed")
    rename = data.get("rename") or {}
    if not isinstance(rename, dict):
        raise ConfigError("rename must be a mapping")
    db = data["db"] if os.path.isabs(data["db"]) else str((Path(path).parent / data["db"]).resolve())
    return SourceConfig(data.get("query"), data.get("view"), db, {str(k): str(v) for k, v in rename.items()}, data.get("version_column"))


def load_aliases(path: str | None) -> dict:
    """{dataset: {dimension: {phrase: value, list of values or {prefix: ...}}}}; a missing file has none."""
    if not path or not os.path.exists(path):
        return {}
    data = _yaml(path)
    if data is None:
        return {}
    if not isinstance(data, dict):
        raise ConfigError("an alias file must be a mapping")
    return data


def resolve_aliases(aliases: dict, dataset: str, dim: str, values: list[str]) -> dict[str, list[str]]:
    """{phrase: catalog values}; names that are no longer in the catalog are dropped, and groups count as entities."""
    own = aliases.get(dataset) or {}
    entries = dict(own.get(dim) or {}) | (dict(own.get("groups") or {}) if dim == "entities" else {})
    known, out = set(values), {}
    for phrase, target in entries.items():
        if isinstance(target, dict):
            found = [v for v in values if v.startswith(str(target.get("prefix", "\0")))]
        else:
            found = [v for v in ([target] if isinstance(target, str) else list(target or [])) if v in known]
        if found:
            out[str(phrase)] = found
    return out


def read_env(path: str) -> dict[str, str]:
    """NAME=value lines; quotes around values and comments are dropped."""
    out: dict[str, str] = {}
    if os.path.exists(path):
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and name and not name.startswith("#"):
                value = value.strip()
                quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
                out[name.strip()] = value[1:-1] if quoted else value.split(" #")[0].strip()
    return out


def list_param(text: str | None) -> list[str] | None:
    """ "a, b," as [a, b]; blank as none."""
    found = [x.strip() for x in (text or "").split(",") if x.strip()]
    return found or None


def int_param(text: str | None, default: int | None = None) -> int | None:
    try:
        return int(text) if text not in (None, "") else default
    except ValueError as e:
        raise ConfigError(f"not a whole number: {text!r}") from e
