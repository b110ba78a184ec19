"""Fix plans: edits as rows, and files with the edits made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.lines import lines_of

#: What to do about the findings of a rule.
GUIDANCE = {
    "ai-hallucinated-imports": "import a file that is there, or create it",
    "circular-dependencies": "move what both files need into a third one",
    "contract-mismatch": "call what the description offers, or extend it",
    "context-drift-patterns": "keep one name for one concept",
    "function-signature-matching": "call the function by its name and with its arguments",
    "hardcoded-secrets": "read the value from the environment and change the secret",
    "inconsistent-casing": "rename it in the file's style",
    "layer-dependencies": "depend on a layer that is allowed",
    "orphaned-functions": "use it, export it or delete it",
    "phantom-type-references": "define or import the type",
}


def renames(findings: DataFrame) -> DataFrame:
    """file, line, old and new of findings whose message says `old may be new`; file-wide, so later lines come first."""
    m = r"^(?:\w+\.)?(\w+) may be (\w+)$"
    rows = findings.filter(F.col("message").rlike(m)).select("file", "line", F.regexp_extract("message", m, 1).alias("old"), F.regexp_extract("message", m, 2).alias("new"))
    return rows.distinct()


def wanted(plan: DataFrame, file: str | None = None, old: str | None = None) -> DataFrame:
    """The edits of one file, or of one name."""
    plan = plan.filter(F.col("file") == file) if file else plan
    return plan.filter(F.col("old") == old) if old else plan


def _edited(files: DataFrame, plan: DataFrame, how: str) -> DataFrame:
    by = plan.groupBy(F.col("file").alias("relative_path")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("old", "new")))).alias("names"))
    pieces = F.regexp_extract_all("content", F.lit(r"\w+|\W+"), F.lit(0))
    text = F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at(F.col("names"), x), x)), "")
    return files.join(by, "relative_path", how).withColumn("edited", F.when(F.col("names").isNotNull(), text)).drop("names")


def edited(files: DataFrame, plan: DataFrame) -> DataFrame:
    """files(relative_path, content) with every whole-word use of an old name in a planned file replaced; each word of a text is
    looked up once, so a new name is never renamed again. Files without an edit stay as they are."""
    return _edited(files, plan, "left").withColumn("content", F.coalesce("edited", "content")).drop("edited")


def preview(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Lines that the edits change: relative_path, line_no, before, after."""
    a = lines_of(files.select("relative_path", "content")).withColumnRenamed("line", "before")
    b = lines_of(edited(files.select("relative_path", "content"), plan)).withColumnRenamed("line", "after")
    return a.join(b, ["relative_path", "line_no"]).filter("before <> after")


def changed(files: DataFrame, plan: DataFrame) -> DataFrame:
    """relative_path and the new content of the files that the edits change."""
    done = _edited(files.select("relative_path", "content"), plan, "inner").filter("edited <> content")
    return done.select("relative_path", F.col("edited").alias("content"))


def guided(findings: DataFrame) -> DataFrame:
    """findings with guidance, null where there is none."""
    table = F.create_map(*[F.lit(x) for pair in GUIDANCE.items() for x in pair])
    return findings.withColumn("guidance", F.try_element_at(table, F.col("rule")))
