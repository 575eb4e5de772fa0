"""Command line: index, search, status, add, prose-drift, report, project add, project remove, project list."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from larkspur.engine import Engine
from larkspur.functions.text import shown
from larkspur.operators import drift
from larkspur.sources import config as configs


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="larkspur")
    top.add_argument("--config", default=os.path.expanduser("~/.larkspur/config.yaml"))
    top.add_argument("--store", default=os.path.expanduser("~/.larkspur/store"))
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("index")
    one.add_argument("project", nargs="?")
    one.add_argument("--detect-project", metavar="PATH")
    one = commands.add_parser("search")
    one.add_argument("query")
    one.add_argument("-n", type=int, default=5)
    one.add_argument("--project")
    one.add_argument("--collection", choices=("code", "docs"))
    one.add_argument("--path")
    commands.add_parser("status")
    one = commands.add_parser("add")
    one.add_argument("project")
    one.add_argument("title")
    one = commands.add_parser("prose-drift")
    one.add_argument("-p", "--project", required=True)
    one.add_argument("--limit", type=int, default=50)
    for plug in ("extractor", "judge"):
        one.add_argument(f"--{plug}", metavar="MODULE:FUNCTION")
    one = commands.add_parser("report")
    one.add_argument("--out")
    project = commands.add_parser("project").add_subparsers(dest="action", required=True)
    one = project.add_parser("add")
    one.add_argument("name")
    one.add_argument("--code-dir", action="append", default=[], metavar="PATH:EXT,EXT")
    one.add_argument("--docs-dir", action="append", default=[])
    project.add_parser("remove").add_argument("name")
    project.add_parser("list")
    return top


def plugged(name: str | None) -> Callable | None:
    """The function that module:function names."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def prose_drift(engine: Engine, name: str, limit: int) -> int:
    """Prints drift; 0 without any, 1 with, 2 for an unknown project or one where it isn't enabled, 3 without extractor or judge."""
    try:
        found = engine.prose_drift(name)
    except ValueError as e:
        if str(e) not in drift.EXIT:
            raise
        print({"no_model": "an extractor and a judge have to be given", "project_unknown": f"unknown project {name}", "not_enabled": f"prose drift is not enabled for {name}"}[str(e)], file=sys.stderr)
        return drift.EXIT[str(e)]
    counters, total = found.counters.first(), found.drift.count()
    for r in drift.report(found.drift, limit).collect():  # at most `limit` rows
        sure = f" similarity {r['similarity']:.2f} confidence {r['confidence']:.2f}" if r["match_type"] == "semantic" else ""
        print(f"{r['subject']} | {r['predicate']} | document: {r['doc_object']} ({name}/{r['source']}), fact: {r['fact_subject']} | {r['fact_predicate']} | {r['fact_object']} (session {r['session_id']}, version {r['version']}){sure}")
    if total > limit:
        print(f"{limit} of {total} shown", file=sys.stderr)
    if counters["judge_errors"]:
        print(f"{counters['judge_errors']} of {counters['judge_calls']} replies were no verdict", file=sys.stderr)
    if counters["cap_hit"]:
        print("the daily limit of calls was reached; the report is partial", file=sys.stderr)
    if not total:
        print("no facts" if not counters["facts_scanned"] else "no drift")
    return drift.EXIT["drift" if total else None]


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    config = configs.load(given.config)
    if given.command == "project":
        if given.action == "add":
            config.projects[given.name] = configs.Project(given.name, [configs.parse_code_dir(d) for d in given.code_dir], given.docs_dir)
            config.save()
        elif given.action == "remove":
            if config.projects.pop(given.name, None) is None:
                print(f"unknown project {given.name}", file=sys.stderr)
                return 2
            config.save()
        else:
            print("\n".join(sorted(config.projects)))
        return 0
    session = spark or SparkSession.builder.appName("larkspur").getOrCreate()
    engine = Engine(session, config, given.store)
    if given.command == "index":
        name = given.project
        if given.detect_project and (name := config.project_of(given.detect_project)) is None:
            return 0
        for place, error in engine.index(name).items():
            print(f"{place} was not pruned: {error}", file=sys.stderr)
    elif given.command == "search":
        for r in engine.search([given.query], given.n, given.project, given.collection, given.path).withColumn("text", shown(F.col("text"))).collect():  # n rows
            near = "" if r["distance"] is None else f" (distance: {r['distance']:.4f})"
            print(f"[{r['rank']}] {r['project']} {r['file_path']}{near}\n{r['text']}\n")
    elif given.command == "status":
        for r in engine.status().orderBy("project", "kind").collect():  # a few rows for each project
            print(r["project"] or "all", r["kind"] or "all", r["n"])
        print("tracked files", engine.tracked_files())
    elif given.command == "prose-drift":
        engine = Engine(session, config, given.store, extractor=plugged(given.extractor), judge=plugged(given.judge))
        return prose_drift(engine, given.project, given.limit)
    elif given.command == "report":
        rates = [r.asDict() for r in engine.stale_rates().orderBy("project", "kind").collect()]  # two rows for each project
        told = json.dumps({"stale": rates, "tracked_files": engine.tracked_files()}, indent=2)
        if given.out:
            Path(given.out).write_text(told)
        print(told)
    else:
        content = sys.stdin.read()
        if not content.strip():
            print("No content received.", file=sys.stderr)
            return 1
        print(engine.add_document(given.project, given.title, content))
    return 0


if __name__ == "__main__":
    sys.exit(main())
