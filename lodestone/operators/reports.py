"""Reports over a findings frame: rule, severity, message and a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANK = {"error": 3, "warning": 2, "info": 1}


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in RANK])


def health(findings: DataFrame) -> DataFrame:
    """100 less 10 an error, 3 a warning and 1 an info, 0 at least."""
    return severity_counts(findings).select(F.greatest(F.lit(0), 100 - 10 * F.col("errors") - 3 * F.col("warnings") - F.col("infos")).alias("score"))


def failing(findings: DataFrame, level: str) -> DataFrame:
    """Findings of at least this severity."""
    return findings.filter(F.col("severity").isin(*[s for s in RANK if RANK[s] >= RANK[level]]))


def by_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "rule", "severity", "message"))).alias("items"))


def markdown(findings: DataFrame, most: int = 10) -> DataFrame:
    """Lines of a report with the first findings of each rule."""
    rank = F.row_number().over(W.partitionBy("rule").orderBy("file", "line", "message"))
    return findings.withColumn("n", rank).filter(F.col("n") <= most).select("rule", "n", F.format_string("- `%s:%d` **%s** %s", "file", F.coalesce("line", F.lit(1)), "severity", "message").alias("text"))


def _column(findings: DataFrame) -> Column:
    return F.coalesce("column", F.lit(1)) if "column" in findings.columns else F.lit(1)


def editor_lines(findings: DataFrame) -> DataFrame:
    message = F.replace("message", F.lit("\n"), F.lit(" "))
    return findings.select(F.format_string("%s(%d,%d): %s %s: %s", "file", F.coalesce("line", F.lit(1)), _column(findings), "severity", "rule", message).alias("text"))


def text_lines(findings: DataFrame) -> DataFrame:
    """Lines of a report for reading: file, line (0 for the file's head) and text; the summary stands under an empty file."""
    rows = findings.select("file", F.coalesce("line", F.lit(1)).cast("int").alias("line"), F.concat_ws(" ", F.lit(" "), F.coalesce("line", F.lit(1)), "severity", "rule", "message").alias("text"))
    heads = findings.select("file", F.lit(0).alias("line"), F.col("file").alias("text")).distinct()
    total = severity_counts(findings).select(
        F.lit("").alias("file"), F.lit(0).alias("line"),
        F.format_string("%d problems: %d errors, %d warnings, %d infos", "total", "errors", "warnings", "infos").alias("text"),
    )
    return rows.unionByName(heads).unionByName(total)


def _document(findings: DataFrame, item: Column) -> DataFrame:
    """All items in order of place as one array: a document is for one reader, so it is made where it is asked for."""
    return findings.agg(F.transform(F.array_sort(F.collect_list(F.struct("file", "line", "rule", "message", item.alias("item")))), lambda x: x["item"]).alias("items"))


def json_document(findings: DataFrame) -> DataFrame:
    """One row: the report as JSON, a summary and the findings in order of file and line."""
    item = F.struct("rule", "severity", "message", "file", "line", _column(findings).alias("column"))
    rows, total = _document(findings, item), severity_counts(findings)
    summary = total.select(F.struct("total", "errors", "warnings", "infos").alias("summary"))
    return rows.join(F.broadcast(summary)).select(F.to_json(F.struct("summary", F.col("items").alias("violations"))).alias("document"))


ORDER = ("file", "line", "rule", "message", "severity", "copy")


def _pieces(findings: DataFrame, item: Column, head: DataFrame, foot: str) -> DataFrame:
    """place, what orders findings, and text: a line of head(text), one of each finding, and foot. All but the first finding begin
    with a comma, equal ones too, which `copy` tells apart. No row or group holds more than one finding's text."""
    d = findings.withColumn("_item", F.to_json(item)).groupBy("file", "line", "rule", "message", "severity", "_item").agg(F.count("*").alias("_n"))
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    first = d.agg(F.min(F.struct(*ORDER, "_item")).alias("x")).first()["x"]  # one row
    if first is None:
        body = d.select(F.lit(1).alias("place"), *ORDER, F.col("_item").alias("text"))
    else:
        same = F.lit(True)
        for c in (*ORDER, "_item"):
            same = same & F.col(c).eqNullSafe(F.lit(first[c]))
        body = d.select(F.lit(1).alias("place"), *ORDER, F.when(same, F.col("_item")).otherwise(F.concat(F.lit(","), "_item")).alias("text"))
    kinds = dict(body.dtypes)
    blank = [F.lit(None).cast(kinds[c]).alias(c) for c in ORDER]
    ends = head.select(F.lit(0).alias("place"), *blank, "text").unionByName(head.select(F.lit(2).alias("place"), *blank, F.lit(foot).alias("text")))
    return body.unionByName(ends)


def json_pieces(findings: DataFrame) -> DataFrame:
    """The JSON report as lines, for sinks.write_document: the same document as json_document, however many findings there are."""
    item = F.struct("rule", "severity", "message", "file", "line", _column(findings).alias("column"))
    head = severity_counts(findings).select(F.concat(F.lit('{"summary":'), F.to_json(F.struct("total", "errors", "warnings", "infos")), F.lit(',"violations":[')).alias("text"))
    return _pieces(findings, item, head, "]}")


def sarif_pieces(findings: DataFrame, tool: str = "lodestone") -> DataFrame:
    """The SARIF log as lines, as json_pieces has the JSON report."""
    rules = findings.agg(F.array_sort(F.collect_set("rule")).alias("ids")).select(F.transform("ids", lambda r: F.struct(r.alias("id"))).alias("rules"))
    driver = F.to_json(F.struct(F.struct(F.lit(tool).alias("name"), "rules").alias("driver")))
    head = rules.select(F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":'), driver, F.lit(',"results":[')).alias("text"))
    return _pieces(findings, sarif_result(findings), head, "]}]}")


def grouped_json(findings: DataFrame) -> DataFrame:
    """One JSON object a rule: its severity, number, files with their findings; rules with errors first are left to the reader."""
    by = findings.groupBy("rule", "file").agg(F.array_sort(F.collect_list(F.struct("line", "severity", "message"))).alias("items"))
    by = by.groupBy("rule").agg(F.sum(F.size("items")).alias("count"), F.array_sort(F.collect_list(F.struct("file", "items"))).alias("files"))
    return by.select("rule", F.to_json(F.struct("rule", "count", "files")).alias("item"))


def action_items(findings: DataFrame) -> DataFrame:
    """What to do first: priority, action, n (findings) and files; only actions that there is something for."""
    kinds = (
        ("critical", "remove hardcoded secrets", F.col("rule") == "hardcoded-secrets"), ("high", "fix errors", F.col("severity") == "error"),
        ("high", "fix calls that do not fit", F.col("rule") == "function-signature-matching"), ("medium", "look at warnings", F.col("severity") == "warning"),
    )
    each = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(p).alias("priority"), F.lit(a).alias("action"))) for p, a, hit in kinds]))
    return findings.select("file", F.inline(each)).groupBy("priority", "action").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


def mismatch_counts(findings: DataFrame) -> DataFrame:
    """Signature findings by kind: wrong numbers of arguments, and names that may be meant."""
    kind = F.when(F.col("message").contains(" arguments, not "), "count").otherwise("name")
    return findings.filter("rule = 'function-signature-matching'").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


def type_census(files: DataFrame, most: int = 30) -> DataFrame:
    """The first names of interfaces, type aliases and classes."""
    from lodestone.operators.lines import lines_of

    head = F.regexp_extract("line", r"\b(interface|class)\s+(\w+)|\b(type)\s+(\w+)\s*=", 0)
    rows = lines_of(files.select("content")).withColumn("head", head).filter("head <> ''")
    rows = rows.select(F.regexp_extract("head", r"^(\w+)", 1).alias("kind"), F.regexp_extract("head", r"^\w+\s+(\w+)", 1).alias("name")).distinct()
    return rows.withColumn("k", F.row_number().over(W.partitionBy("kind").orderBy("name"))).filter(F.col("k") <= most).drop("k")


def file_metrics(files: DataFrame, edges: DataFrame) -> DataFrame:
    """file, lines (that are not blank), dependents and dependencies."""
    from lodestone.operators import graph

    lines = F.size(F.filter(F.split("content", "\n"), lambda x: F.trim(x) != "")).cast("long")
    degree = graph.degrees(files.select(F.col("relative_path").alias("id")), edges).withColumnRenamed("id", "file")
    return files.select(F.col("relative_path").alias("file"), lines.alias("lines")).join(degree, "file").select("file", "lines", "dependents", "dependencies")


def suggestions(files: DataFrame, edges: DataFrame, layer_findings: int) -> DataFrame:
    """topic and n: cycles, edges across layers, files of high coupling (over 15, where one is over 20), much used files (over 10)."""
    from lodestone.operators import graph

    degree = graph.degrees(files.select(F.col("relative_path").alias("id")), edges)
    cycles = graph.cycles(edges).agg(F.lit("cycles").alias("topic"), F.count("*").alias("n"))
    layer = files.sparkSession.range(1).select(F.lit("layers").alias("topic"), F.lit(layer_findings).cast("long").alias("n"))
    high = degree.agg(F.lit("coupling").alias("topic"), F.when(F.max("coupling") > 20, F.count_if(F.col("coupling") > 15)).otherwise(0).alias("n"))
    used = degree.agg(F.lit("much used").alias("topic"), F.count_if(F.col("dependents") > 10).alias("n"))
    return cycles.unionByName(layer).unionByName(high).unionByName(used).filter("n > 0")


def rules_catalog(spark: SparkSession) -> DataFrame:
    """Names of the registered rules."""
    from lodestone.operators import more_rules, react  # noqa: F401
    from lodestone.operators.rules import RULES

    return spark.createDataFrame([(r,) for r in RULES], "rule string")


def html_lines(findings: DataFrame) -> DataFrame:
    """Rows of an HTML report: file, line and text, the head under an empty file. In order of file and line they are one page."""
    def safe(c: str) -> Column:
        out = F.col(c)
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(sign), F.lit(name))
        return out

    line = F.coalesce("line", F.lit(1)).cast("int")
    row = F.format_string('<tr class="%s"><td>%s:%d<td>%s<td>%s<td>%s', safe("severity"), safe("file"), line, safe("severity"), safe("rule"), safe("message"))
    head = '<!doctype html><meta charset="utf-8"><title>Findings</title><h1>Findings</h1><p>%d problems: %d errors, %d warnings, %d infos<table><tr><th>Place<th>Severity<th>Rule<th>Message'
    top = severity_counts(findings).select(F.lit("").alias("file"), F.lit(0).alias("line"), F.format_string(head, "total", "errors", "warnings", "infos").alias("text"))
    return top.unionByName(findings.select("file", line.alias("line"), row.alias("text")))


def sarif_result(findings: DataFrame) -> Column:
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    region = F.struct(F.coalesce("line", F.lit(1)).alias("startLine"), _column(findings).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))


def sarif(findings: DataFrame) -> DataFrame:
    """One JSON result a finding, as SARIF 2.1.0 has them."""
    return findings.select(F.to_json(sarif_result(findings)).alias("result"))


def sarif_document(findings: DataFrame, tool: str = "lodestone") -> DataFrame:
    """One row: the whole SARIF log with its rules and results."""
    rules = findings.agg(F.array_sort(F.collect_set("rule")).alias("ids")).select(F.transform("ids", lambda r: F.struct(r.alias("id"))).alias("rules"))
    rows = _document(findings, sarif_result(findings)).join(F.broadcast(rules))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), "rules").alias("driver")).alias("tool"), F.col("items").alias("results"))
    return rows.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def dot(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string('"%s" -> "%s";', F.col("src").cast("string"), F.col("dst").cast("string")).alias("text"))
