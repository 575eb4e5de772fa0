"""Projects and their folders, as YAML."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

import yaml


@dataclass
class CodeDir:
    path: str
    extensions: list[str]
    include_dirs: list[str] = field(default_factory=list)
    exclude_dirs: list[str] = field(default_factory=list)

    def __post_init__(self):
        if not self.extensions:
            raise ValueError(f"{self.path}: no extensions")


@dataclass
class Project:
    name: str
    code_dirs: list[CodeDir] = field(default_factory=list)
    docs_dirs: list[str] = field(default_factory=list)
    prose_drift_enabled: bool = False

    def collection(self, kind: str) -> str:
        return f"{self.name}-{kind}"


@dataclass
class Config:
    path: str
    projects: dict[str, Project] = field(default_factory=dict)
    embed_provider: str = "hash"

    def project_of(self, path: str) -> str | None:
        """The first project with a code folder that holds path."""
        real = Path(path).resolve()
        return next((p.name for p in self.projects.values() for d in p.code_dirs if real.is_relative_to(Path(d.path).resolve())), None)

    def save(self) -> None:
        """Atomically; empty lists are left out, extensions sorted."""
        projects = {}
        for p in self.projects.values():
            dirs = [{k: v for k, v in {"path": d.path, "extensions": sorted(d.extensions), "include_dirs": d.include_dirs, "exclude_dirs": d.exclude_dirs}.items() if v} for d in p.code_dirs]
            projects[p.name] = {k: v for k, v in {"code_dirs": dirs, "docs_dirs": p.docs_dirs, "prose_drift_enabled": p.prose_drift_enabled}.items() if v}
        temporary = f"{self.path}.new"
        Path(temporary).write_text(yaml.safe_dump({"embed_provider": self.embed_provider, "projects": projects}, sort_keys=True))
        os.replace(temporary, self.path)


_loaded: dict[str, tuple[float, Config]] = {}


def load(path: str) -> Config:
    """An absent file is an empty config; older keys code_dir and docs_dir with one folder are read too. Kept until the file changes."""
    if not Path(path).exists():
        return Config(path)
    at = Path(path).stat().st_mtime
    if path in _loaded and _loaded[path][0] == at:
        return _loaded[path][1]
    raw = yaml.safe_load(Path(path).read_text()) or {}
    config = Config(path, embed_provider=raw.get("embed_provider", "hash"))
    for name, p in (raw.get("projects") or {}).items():
        p = p or {}
        dirs = list(p.get("code_dirs") or [])
        if not dirs and p.get("code_dir"):
            # the older form has the folder's settings beside it
            dirs = [{"path": p["code_dir"]} | {k: p.get(k) for k in ("extensions", "include_dirs", "exclude_dirs")}]
        docs = list(p.get("docs_dirs") or []) + ([p["docs_dir"]] if p.get("docs_dir") else [])
        config.projects[name] = Project(name, [CodeDir(d["path"], list(d.get("extensions") or []), list(d.get("include_dirs") or []), list(d.get("exclude_dirs") or [])) for d in dirs], docs, bool(p.get("prose_drift_enabled")))
    _loaded[path] = (at, config)
    return config


def parse_code_dir(text: str) -> CodeDir:
    """path:ext1,ext2 with or without dots, split at the last colon."""
    path, _, ends = text.rpartition(":")
    if not path:
        raise ValueError(f"{text}: path:ext1,ext2 is wanted")
    return CodeDir(path, [e if e.startswith(".") else f".{e}" for e in ends.split(",") if e])


def load_golden_set(path: str) -> list[dict]:
    """cases with query, project, collection, expected and class (nl where absent)."""
    cases = (yaml.safe_load(Path(path).read_text()) or {}).get("cases") or []
    return [{"case_id": k, "query": c["query"], "project": c.get("project"), "collection": c.get("collection"), "expected": list(c["expected"]), "query_class": c.get("class", "nl")} for k, c in enumerate(cases)]
