"""A thin command line over all registered queries: ``list``, ``sql NAME``, ``show NAME SF_DIR``, ``count NAME SF_DIR``, ``explain NAME SF_DIR``, ``run NAME SF_DIR OUT``."""

from __future__ import annotations

import argparse
import importlib.util
from collections.abc import Callable

from .plans import queries
from .session import session


def registered() -> tuple[dict[str, Callable], dict[str, str]]:
    """Queries and their SQL: those of the entry beside this package, which knows the optional ones too, else the package's own."""
    if importlib.util.find_spec("__spark_entry__") is None:
        return queries.queries(), queries.oracle_sql()
    entry = importlib.import_module("__spark_entry__")
    return entry.queries(), entry.oracle_sql()


def main(args: list[str] | None = None) -> int:
    known, sql = registered()
    parser = argparse.ArgumentParser(prog="tessera")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="name the queries")
    for command, what in (("sql", "print a query's SQL"), ("show", "print a query's first rows"), ("count", "count a query's rows"), ("explain", "print a query's plan"), ("run", "write a query's result as Parquet")):
        p = sub.add_parser(command, help=what)
        p.add_argument("name", choices=sorted(known))
        if command != "sql":
            p.add_argument("sf_dir")
        if command == "run":
            p.add_argument("out")
    a = parser.parse_args(args)
    if a.command == "list":
        print("\n".join(sorted(known)))
        return 0
    if a.command == "sql":
        print(sql.get(a.name, "none"))
        return 0
    df = known[a.name](session(), a.sf_dir)
    if a.command == "explain":
        df.explain("formatted")
    elif a.command == "show":
        df.show(20, truncate=80)
    elif a.command == "count":
        print(df.count())
    else:
        df.write.mode("errorifexists").parquet(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
