"""Layered settings: defaults, then a TOML file, then a .env file, then the environment; typed and checked."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path


def at_least(default, least):
    """A field whose value must not be below ``least``."""
    return field(default=default, metadata={"least": least})


@dataclass(frozen=True)
class Runtime:
    granularity: int = at_least(40, 1)
    max_workers: int = at_least(10, 1)
    max_spec_iter: int = at_least(5, 1)
    bug_validation_max_retries: int = at_least(1, 0)


@dataclass(frozen=True)
class Scope:
    top_k: int = at_least(5, 1)


@dataclass(frozen=True)
class Spark:
    shuffle_partitions: int = at_least(200, 1)
    checkpoint_dir: str = ""


@dataclass(frozen=True)
class Settings:
    runtime: Runtime = Runtime()
    scope: Scope = Scope()
    spark: Spark = Spark()


def dotenv(text: str) -> dict[str, str]:
    """NAME=value lines; blank lines and comments don't count, quotes around a value and a leading 'export' go."""
    out = {}
    for line in text.splitlines():
        name, mark, value = line.strip().removeprefix("export ").partition("=")
        if mark and not name.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def _typed(where: str, kind: type, value):
    if isinstance(value, bool) or not isinstance(value, kind):
        if not isinstance(value, str):
            raise ValueError(f"{where} must be of type {kind.__name__}, not {value!r}")
        try:
            value = kind(value)
        except ValueError:
            raise ValueError(f"{where} must be of type {kind.__name__}, not {value!r}") from None
    return value


def _section(kind: type, name: str, values: Mapping):
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings in [{name}]: {', '.join(sorted(unknown))}")
    typed = {}
    for f in fields(kind):
        if f.name in values:
            where = f"{name}.{f.name}"
            typed[f.name] = _typed(where, type(f.default), values[f.name])
            if "least" in f.metadata and typed[f.name] < f.metadata["least"]:
                raise ValueError(f"{where} must be at least {f.metadata['least']}")
    return kind(**typed)


def load(toml: str | None = None, env_file: str | None = None, environment: Mapping[str, str] | None = None, prefix: str = "SILTSTONE_") -> Settings:
    """Settings of all layers.  A variable is named <prefix><SECTION>_<FIELD>; a file that isn't there is an empty layer; an
    unknown section or field of the TOML file, a wrong type and a value below its bound are errors."""
    data = tomllib.loads(Path(toml).read_text()) if toml and Path(toml).is_file() else {}
    sections = {f.name: type(f.default) for f in fields(Settings) if is_dataclass(f.default)}
    unknown = set(data) - set(sections)
    if unknown:
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
    named = dotenv(Path(env_file).read_text()) if env_file and Path(env_file).is_file() else {}
    named |= dict(os.environ if environment is None else environment)
    out = {}
    for name, kind in sections.items():
        values = dict(data.get(name, {}))
        for f in fields(kind):
            variable = f"{prefix}{name}_{f.name}".upper()
            if variable in named:
                values[f.name] = named[variable]
        out[name] = _section(kind, name, values)
    return Settings(**out)


def apply(settings: Settings, spark) -> None:
    """Set the session's runtime options from the settings."""
    spark.conf.set("spark.sql.shuffle.partitions", str(settings.spark.shuffle_partitions))
