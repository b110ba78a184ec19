"""Imports and exports of source files by the parsers of their languages, and resolution of imports to files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import dirname, fold_path
from lodestone.operators.parsers import PARSERS

ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
CANDIDATES = ("", *ENDINGS, *(f"/index{e}" for e in ENDINGS), ".json")


SYMBOLS = "array<struct<name:string,alias:string,is_default:boolean,is_namespace:boolean>>"
_SYMBOL = pa.list_(pa.struct([("name", pa.string()), ("alias", pa.string()), ("is_default", pa.bool_()), ("is_namespace", pa.bool_())]))
_KEYS = ("name", "alias", "is_default", "is_namespace")


def _rows(files: DataFrame, part: int, schema: str, build) -> DataFrame:
    """One row for each import (part 0) or export (1) of files(relative_path, language, content)."""
    parsers = dict(PARSERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, language, text in zip(*(b[c].to_pylist() for c in ("relative_path", "language", "content")), strict=True):
                if language in parsers and text:
                    own = parsers[language]
                    found = own.parts[part](text) if hasattr(own, "parts") else own(text)[part]
                    rows += [(path, *x) for x in found]
            yield build(rows)

    return files.select("relative_path", "language", "content").mapInArrow(run, schema)


def dependencies(files: DataFrame) -> DataFrame:
    """source, target, type, line, imports (symbols), is_dynamic, is_type_only; in order of kind and place within a file."""

    def build(rows):
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), _SYMBOL, pa.bool_(), pa.bool_()]
        cols[4] = [[dict(zip(_KEYS, s, strict=True)) for s in x] for x in cols[4]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["source", "target", "type", "line", "imports", "is_dynamic", "is_type_only"])

    return _rows(files, 0, f"source string, target string, type string, line int, imports {SYMBOLS}, is_dynamic boolean, is_type_only boolean", build)


def exports(files: DataFrame) -> DataFrame:
    """relative_path, name, type, line, is_default; a default export has a row `default` besides."""

    def build(rows):
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["relative_path", "name", "type", "line", "is_default"])

    return _rows(files, 1, "relative_path string, name string, type string, line int, is_default boolean", build)


def based(deps: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """deps with `base`: the path, but for its ending, of a relative or aliased target. Other targets are left out."""
    alias = aliases or {}
    base = F.when(F.col("target").rlike(r"^\.\.?(/|$)"), fold_path(F.concat_ws("/", dirname(F.col("source")), F.col("target"))))
    for prefix, folder in alias.items():
        base = base.when(F.col("target").startswith(prefix), fold_path(F.concat(F.lit(folder), F.expr(f"substr(target, {len(prefix) + 1})"))))
    return deps.withColumn("base", base).filter("base is not null")


def resolved(deps: DataFrame, known: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """deps with `file`: the first candidate of a relative or aliased target among known(relative_path); null if none is.

    Only targets that could be files of the project are kept."""
    d = based(deps, aliases).withColumn("_id", F.xxhash64("source", "target"))
    forms = F.array(*[F.concat("base", F.lit(c)) for c in CANDIDATES])
    pairs = d.select("_id", "source", "target", F.posexplode(forms).alias("ord", "file")).distinct()
    hit = pairs.join(known.select(F.col("relative_path").alias("file")).distinct(), "file", "left_semi")
    best = hit.groupBy("source", "target").agg(F.min_by("file", "ord").alias("file"))
    return d.drop("_id", "base").join(best, ["source", "target"], "left")


def edges(deps: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """src, dst, line and type of imports that resolve to a file; the last import of a pair wins."""
    r = resolved(deps, files, aliases).filter("file is not null")
    top = r.groupBy(F.col("source").alias("src"), F.col("file").alias("dst")).agg(F.max_by(F.struct("line", "type"), "line").alias("x"))
    return top.select("src", "dst", "x.line", "x.type")
