"""``python -m textloom list`` and ``python -m textloom run QUERY FOLDER [--out PATH] [--explain]``."""

from __future__ import annotations

import argparse

from textloom.plans import registry


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="textloom", description="Run a registered query over a folder of tables.")
    parts = parser.add_subparsers(dest="command", required=True)
    parts.add_parser("list", help="names of the queries")
    run = parts.add_parser("run", help="run one query")
    run.add_argument("query", choices=sorted(registry.queries()))
    run.add_argument("folder")
    run.add_argument("--out", help="write the rows there as Parquet instead of showing some")
    run.add_argument("--cores", default="8")
    run.add_argument("--explain", action="store_true", help="show the plan only")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    given = arguments(argv)
    if given.command == "list":
        print("\n".join(sorted(registry.queries())))
        return
    from textloom.session import build_session

    rows = registry.queries()[given.query](build_session(cores=given.cores), given.folder)
    if given.explain:
        rows.explain("formatted")
    elif given.out:
        rows.write.mode("error").parquet(given.out)
    else:
        rows.show(50, truncate=80)


if __name__ == "__main__":
    main()
