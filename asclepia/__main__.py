"""Command line: execute, translate, validate, repl.

    python -m asclepia execute library.cql --data /path/to/tables [--define NAME] [--param name=value] [--format json|pretty|table]
    python -m asclepia translate library.cql [--format json|xml]
    python -m asclepia validate library.cql [--data /path/to/tables]

Errors go to the error stream with their code, and the exit status is 1. ``validate`` parses, and with --data also compiles each definition.
A parameter's value is an expression of the language (3, 2.5, 'text', @2024-01-01, { 1, 2 }, 5 'mg'); what isn't one is a string.
    python -m asclepia repl
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from asclepia.plans import elm
from asclepia.plans.errors import QueryError, SettingError
from asclepia.plans.lang import SyntaxProblem, parse_expression, parse_library


def _parameter(text: str):
    """Name and value of name=value; the value is a tree, or a string if it isn't an expression."""
    name, found, value = text.partition("=")
    if not found or not name.strip():
        raise SettingError(f"not name=value: {text!r}", 2)
    try:
        node = parse_expression(value)
    except SyntaxProblem:
        return name.strip(), value
    return name.strip(), value if node.kind == "IdentifierRef" else node


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="asclepia")
    parser.add_argument("command", choices=["execute", "translate", "validate", "repl"])
    parser.add_argument("file", nargs="?")
    parser.add_argument("--data")
    parser.add_argument("--define", action="append")
    parser.add_argument("--param", action="append", default=[])
    parser.add_argument("--format", choices=["json", "pretty", "table", "xml"], default="json")
    args = parser.parse_args(argv)
    try:
        return run(args)
    except (QueryError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def run(args: argparse.Namespace) -> int:
    library = parse_library(Path(args.file).read_text()) if args.file else None
    if library is None and args.command != "repl":
        raise SettingError(f"{args.command} needs a file")
    if args.command == "translate":
        print(elm.xml(library) if args.format == "xml" else json.dumps(elm.export(library), indent=2))
        return 0
    if args.command == "validate" and not args.data:
        print(f"{len(library.definitions)} definitions" if library.definitions else "warning: no definitions")
        return 0
    from pyspark.sql import SparkSession

    from asclepia.plans.compiler import Compiler, Env, Relation
    from asclepia.plans.engine import Engine, render
    from asclepia.plans.lang import Node
    from asclepia.sources.catalog import test_tables

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, test_tables(spark, args.data) if args.data else None, library_path=str(Path(args.file).parent) if args.file else None)
    if args.command == "repl":
        for line in sys.stdin:
            if line.strip() in ("exit", "quit"):
                break
            try:
                print(engine.text(line))
            except Exception as e:  # noqa: BLE001  a prompt goes on after any error
                print(f"error: {e}")
        return 0
    parameters = {n: Compiler(now=engine.now).expr(v, Env()) if isinstance(v, Node) else v for n, v in map(_parameter, args.param)}
    compiled = engine.compile(library, parameters)
    if args.command == "validate":
        wrong = 0
        for name in library.definitions:
            try:
                compiled.compiler.definition(name)
            except QueryError as e:
                wrong += 1
                print(f"error: {name}: {e}", file=sys.stderr)
        print(f"{len(library.definitions)} definitions, {wrong} with errors")
        return int(wrong > 0)
    for name in args.define or library.definitions:
        df = compiled.evaluate(name)
        if args.format == "table":
            print(name)
            df.show(truncate=False)
        elif args.format == "pretty":
            made = compiled.compiler.definition(name)
            if isinstance(made, Relation):
                print(f"{name}:")
                for row in df.toLocalIterator():
                    print("  " + ", ".join(f"{k}: {v}" for k, v in row.asDict().items()))
            else:
                print(f"{name}: {render(df.first()[0], made.ty)}")
        else:
            for row in df.toJSON().toLocalIterator():
                print(json.dumps({"define": name, "row": json.loads(row)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
