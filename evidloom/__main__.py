"""Command line: list the queries, run one over a directory of tables, or examine a folder of documents."""

from __future__ import annotations

import argparse
import sys

from evidloom import sinks
from evidloom.plans import checks, data_quality, evidence, files, pipeline, records
from evidloom.session import local_session

QUERIES = {**data_quality.QUERIES, **evidence.QUERIES, **records.QUERIES, **files.QUERIES, **checks.QUERIES}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evidloom", description=__doc__)
    todo = parser.add_subparsers(dest="todo", required=True)
    todo.add_parser("list", help="names of the queries")
    run = todo.add_parser("run", help="run a query and write its result")
    run.add_argument("query", choices=sorted(QUERIES))
    run.add_argument("tables")
    run.add_argument("out")
    run.add_argument("--format", choices=["parquet", "json", "csv"], default="parquet")
    folder = todo.add_parser("folder", help="examine a folder of documents and write a report")
    folder.add_argument("root")
    folder.add_argument("out")
    folder.add_argument("--strict", action="store_true", help="medium findings block, too")
    a = parser.parse_args(args)
    if a.todo == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = local_session()
    if a.todo == "run":
        df = QUERIES[a.query](spark, a.tables)
        if a.format == "csv":
            sinks.write_csv(df, a.out)
        else:
            df.write.mode("overwrite").format(a.format).save(a.out)
        return 0
    got = pipeline.run_folder(spark, a.root, strict=a.strict)
    report = sinks.markdown_report("Folder", {"Documents": got.documents, "Verdicts": got.verdicts, "Not or partly scanned": got.skipped, "Coverage": got.coverage})
    sinks.staged(a.out, lambda where: sinks.write_text(f"{where}/report.md", report), {"report.md"})
    return int(got.verdicts.where("status = 'block'").limit(1).count() > 0)


if __name__ == "__main__":
    sys.exit(main())
