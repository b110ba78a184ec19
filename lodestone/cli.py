"""python -m lodestone.cli COMMAND FOLDER: validate, analyze, report or fix the source files of a folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import extract, fixes, graph, reports
from lodestone.operators.materialize import settle
from lodestone.operators.rules import validate
from lodestone.sources import project, sinks
from lodestone.sources.files import described, scan

FORMATS = {"text": reports.text_lines, "json": reports.json_document, "grouped": reports.grouped_json, "sarif": reports.sarif_document, "vscode": reports.editor_lines, "markdown": reports.markdown, "html": reports.html_lines}
#: Formats that are one document, as lines for files.
PIECES = {"json": reports.json_pieces, "sarif": reports.sarif_pieces}
#: Columns of a format that hold its text.
TEXTS = ("document", "item", "text")


def sources(spark: SparkSession, folder: str) -> DataFrame:
    every = scan(spark, folder).select("relative_path", "content")
    return described(project.chosen(every, project.settings(every)))


def shown(df: DataFrame) -> None:
    """Prints a report's rows in order of its columns, one at a time."""
    order = [c for c in ("file", "line", "rule", "n") if c in df.columns]
    column = next((c for c in TEXTS if c in df.columns), None)
    for row in (df.orderBy(*order) if order else df).toLocalIterator():
        print(row[column] if column else "\t".join(map(str, row)))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    p.add_argument("command", choices=("validate", "analyze", "report", "fix"))
    p.add_argument("folder")
    p.add_argument("--rules", nargs="*", help="rule groups; all where none is named")
    p.add_argument("--format", choices=FORMATS, default="text")
    p.add_argument("--fail-on", choices=("error", "warning", "info"), default="error")
    p.add_argument("--output", help="folder for the report, written by Spark")
    p.add_argument("--write", action="store_true", help="fix: replace the files; without it the edits are only shown")
    p.add_argument("--shared", default="(^|/)shared/")
    p.add_argument("--callers", default="(^|/)(client|server)/")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    files = sources(spark, a.folder)
    if a.command == "analyze":
        edges = extract.edges(extract.dependencies(files), files)
        degree = graph.degrees(files.selectExpr("relative_path as id"), edges)
        for df in (graph.coupling(degree), graph.hotspots(degree), reports.suggestions(files, edges, 0)):
            shown(df)
        return 0
    found = validate(files, a.rules or None, shared=a.shared, callers=a.callers)
    if a.command == "fix":
        plan = fixes.renames(found)
        if a.write:
            sinks.finish(a.folder)
            sinks.write_files(fixes.changed(files, plan), a.folder)
        else:
            shown(fixes.preview(files, plan))
        return 0
    if a.output and a.format in PIECES:
        sinks.write_document(PIECES[a.format](settle(found)), a.output)
        return int(a.command == "validate" and not reports.failing(found, a.fail_on).isEmpty())
    report = FORMATS[a.format](found)
    if a.output:
        report.write.mode("overwrite").json(a.output)
    else:
        shown(report)
    return int(a.command == "validate" and not reports.failing(found, a.fail_on).isEmpty())


if __name__ == "__main__":
    sys.exit(main())
