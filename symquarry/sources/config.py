"""Configuration from TOML: unknown keys, empty paths and invalid ignore patterns are errors."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import Column

from symquarry.functions import paths as path_functions


@dataclass
class IndexConfig:
    paths: list[str] = field(default_factory=list)
    nested: list[str] = field(default_factory=list)
    ignores: list[str] = field(default_factory=list)
    max_file_size: int = 2 * 1024 * 1024
    resolve_yaml: bool = True

    def ignored(self, path: Column) -> Column:
        return path_functions.ignored(path, self.ignores)


@dataclass
class PickConfig:
    expect: list[str] = field(default_factory=list)
    landing: str = "README.md"
    limit: int = 100
    highlighter: str = ""
    highlight: str = ""
    match_highlight: str = ""
    fzf_args: list[str] = field(default_factory=list)


@dataclass
class Config:
    index: IndexConfig
    abbreviations: dict[str, str] = field(default_factory=dict)
    pick: PickConfig = field(default_factory=PickConfig)


def _section(cls, table: dict, name: str):
    known = {f.name: f for f in fields(cls)}
    for key, value in table.items():
        if key not in known:
            raise ValueError(f"unknown key '{name}.{key}'")
        default = getattr(cls(), key)
        if type(value) is not type(default):
            raise ValueError(f"'{name}.{key}' must be of type {type(default).__name__}")
    return cls(**table)


def parse(text: str) -> Config:
    table = tomllib.loads(text)
    for key in table:
        if key not in ("index", "abbreviations", "pick"):
            raise ValueError(f"unknown key '{key}'")
    index = _section(IndexConfig, table.get("index", {}), "index")
    if not index.paths:
        raise ValueError("index.paths must name at least one start path")
    for entry in index.ignores:
        if entry.startswith("glob:"):
            path_functions.glob_regex(entry[5:])
        elif entry.startswith("regex:"):
            try:
                re.compile(entry[6:])
            except re.error as e:
                raise ValueError(f"invalid ignore regex '{entry[6:]}'") from e
    return Config(index, dict(table.get("abbreviations", {})), _section(PickConfig, table.get("pick", {}), "pick"))


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


EXAMPLE = """\
[index]
# Directories that are searched for repositories.
paths = ["/home/you/projects"]
# Directories below which repositories inside repositories are indexed as well.
# nested = ["/home/you/projects/monorepo"]
# Files left out: a path part, a glob (`*` within a component, `**` across) or a regex.
# ignores = ["/fixtures/recorded/", "glob:**/*.snap", 'regex:\\.min\\.js$']
# Larger files keep their file row only.
# max_file_size = 2097152
# Index keys that YAML aliases and merge keys bring in.
# resolve_yaml = true

[abbreviations]
# aa = "a-long-repository-name"

[pick]
# landing = "README.md"
# limit = 100
"""


def write_example(path: str, force: bool = False) -> None:
    """Writes a commented example; an existing file is only replaced with ``force``."""
    if os.path.exists(path) and not force:
        raise FileExistsError(f"{path} exists")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(EXAMPLE)
