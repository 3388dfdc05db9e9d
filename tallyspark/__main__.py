"""python -m tallyspark list | run NAME --tables DIR [--out DIR] | explain NAME --tables DIR
python -m tallyspark stages | stage MODE --tables DIR --folder DIR [--fresh] | status --folder DIR [--tables DIR] | estimate --tables DIR [--variants N] | clear DIR

MODE is full, stage:x, from:x, to:x or range:a:b."""

from __future__ import annotations

import argparse

from .plans import analysis, catalog, stages
from .session import session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tallyspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name in ("run", "explain"):
        c = sub.add_parser(name)
        c.add_argument("query", choices=sorted(catalog.QUERIES))
        c.add_argument("--tables", required=True)
        c.add_argument("--out")
    sub.add_parser("stages")
    c = sub.add_parser("stage")
    c.add_argument("mode")
    c.add_argument("--tables", required=True)
    c.add_argument("--folder", required=True)
    c.add_argument("--fresh", action="store_true", help="run stages again whose outputs are there")
    c = sub.add_parser("status")
    c.add_argument("--folder", required=True)
    c.add_argument("--tables", help="tell also which outputs were made from other tables")
    c = sub.add_parser("estimate")
    c.add_argument("--tables", required=True)
    c.add_argument("--variants", type=int, default=0)
    c.add_argument("--extra", type=int, default=0)
    sub.add_parser("clear").add_argument("folder")
    a = p.parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if a.command == "stages":
        for stage in analysis.registry().stages.values():
            print(f"{stage.name}: {', '.join(stage.requires) or '-'} -> {', '.join(stage.produces)}")
        return 0
    if a.command == "stage":
        analysis.registry().plan(a.mode)  # a wrong mode ends here
    spark = session()
    if a.command == "clear":
        return 0 if stages.clear(spark, a.folder) else 1
    if a.command == "stage":
        stages.run(spark, analysis.registry(), a.mode, analysis.sources(spark, a.tables), a.folder, resume=not a.fresh)
        return 0
    if a.command == "status":
        print("\n".join(f"{name}: {state}" for name, state in analysis.status(spark, a.folder, a.tables)))
        return 0
    if a.command == "estimate":
        analysis.estimate(spark, a.tables, a.variants, a.extra).show(truncate=False)
        return 0
    df = catalog.QUERIES[a.query](spark, a.tables)
    if a.command == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.parquet(a.out)
    else:
        df.show(100, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
