"""Source files as rows: path, relative_path, language, extension, layer, size, last_modified, content."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions and their languages.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript",
    ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".pyi": "python", ".java": "java", ".go": "go", ".rs": "rust", ".kt": "kotlin", ".cs": "csharp",
}


def glob_regex(pattern: str) -> str:
    """A path glob (`**`, `*`, `?`, `{a,b}`) as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, pattern[i + 1 : end].split(","))) + ")", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def matches(path: Column, patterns: list[str]) -> Column:
    return path.rlike("|".join(map(glob_regex, patterns))) if patterns else F.lit(False)


def described(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """files (relative_path, content) with extension and language; others than the asked languages go."""
    ext = F.lower(F.regexp_extract("relative_path", r"(\.[^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    out = files.withColumns({"extension": ext, "language": F.try_element_at(known, ext)}).filter("language is not null")
    return out.filter(F.col("language").isin(*languages)) if languages else out


def with_layer(files: DataFrame, layers: list[tuple[str, list[str]]]) -> DataFrame:
    """The first layer (name, directories) in whose directory a file lies; case does not count."""
    low, out = F.lower("relative_path"), None
    for name, folders in layers:
        hit = F.lit(False)
        for f in folders:
            f = f.lower().strip("/")
            hit = hit | (low == f) | low.startswith(f + "/")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return files.withColumn("layer", F.lit(None).cast("string") if out is None else out)


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The text files under root whose relative path an include pattern matches and no exclude pattern does."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").removeprefix("file:")) + "/", "")
    rows = raw.select("path", rel.alias("relative_path"), F.col("modificationTime").alias("last_modified"), F.col("length").alias("size"), "content")
    if include:
        rows = rows.filter(matches(F.col("relative_path"), include))
    if exclude:
        rows = rows.filter(~matches(F.col("relative_path"), exclude))
    return rows.withColumn("content", F.try_validate_utf8(F.col("content").cast("string"))).filter("content is not null")
