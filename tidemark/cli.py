"""Command line: registered queries, the factor catalog, screens and the factory over panel files, and the ledger."""

from __future__ import annotations

import argparse
import json


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    find = commands.add_parser("list", help="names of queries")
    find.add_argument("text", nargs="?", default="", help="part of the name")
    run = commands.add_parser("run", help="run a query")
    run.add_argument("name")
    run.add_argument("tables", help="folder with the Parquet tables")
    run.add_argument("--out", help="write Parquet there instead of showing 20 rows")
    factors = commands.add_parser("factors", help="the factor catalog")
    factors.add_argument("text", nargs="?", default="", help="part of a name, summary or tag")
    factors.add_argument("--category")
    factors.add_argument("--json", action="store_true")
    describe = commands.add_parser("describe", help="what a factor is")
    describe.add_argument("name")
    for name, about in (("screen", "screen the factors of a panel file"), ("factory", "screen, deflate and judge them")):
        one = commands.add_parser(name, help=about)
        one.add_argument("panel", help="Parquet or CSV file")
        one.add_argument("--return-col", default="forward_return")
        one.add_argument("--date-col", default="date")
        one.add_argument("--asset-col", default="asset")
        one.add_argument("--hac-lags", type=int, default=5)
        one.add_argument("--fdr", type=float, default=0.1)
        if name == "factory":
            one.add_argument("--ledger", help="JSON file that keeps what passes")
    ledger = commands.add_parser("provenance", help="list findings and manifests, or verify a run")
    ledger.add_argument("ledger")
    ledger.add_argument("--run-id")
    ledger.add_argument("--panel")
    return parser


def main(argv: list[str] | None = None) -> int:
    parser = build_parser()
    args = parser.parse_args(argv)
    from tidemark import tools
    from tidemark.plans import registry

    def show(value) -> int:
        print(json.dumps(value, indent=2))
        return 0

    if args.command == "factors":
        if args.json:
            print(tools.catalog_json())
            return 0
        names = set(tools.list_factors(args.category)) & set(tools.search_factors(args.text))
        print("\n".join(tools.describe_factor(n) for n in sorted(names)))
        return 0
    if args.command == "describe":
        if args.name not in tools.list_factors():
            parser.error(f"no factor {args.name}")
        print(tools.describe_factor(args.name))
        return 0
    if args.command == "list":
        for name in sorted(n for n in registry.queries() if args.text.lower() in n):
            print(name, "" if name in registry.oracle_sql() else "(no SQL twin)")
        return 0
    if args.command == "run" and args.name not in registry.queries():
        parser.error(f"no query {args.name}")
    from tidemark.session import local_session

    spark = local_session()
    if args.command == "run":
        out = registry.queries()[args.name](spark, args.tables)
        out.write.parquet(args.out) if args.out else out.show()
        return 0
    if args.command == "provenance":
        if args.run_id:
            if not args.panel:
                parser.error("--run-id needs --panel")
            return show(tools.verify_discovery(spark, args.ledger, args.run_id, args.panel))
        return show({"findings": tools.list_discoveries(spark, args.ledger), "manifests": tools.list_manifests(spark, args.ledger)})
    columns = {"return_col": args.return_col, "date_col": args.date_col, "asset_col": args.asset_col, "hac_lags": args.hac_lags, "fdr": args.fdr}
    if args.command == "screen":
        return show(tools.screen_file(spark, args.panel, **columns))
    if args.ledger:
        return show(tools.factory_and_register(spark, args.panel, args.ledger, **columns))
    return show(tools.factory_file(spark, args.panel, **columns))


if __name__ == "__main__":
    raise SystemExit(main())
