"""Rules over React components: properties that are only handed down, and callbacks that hold old state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import extract
from lodestone.operators.more_rules import register, to_closing
from lodestone.operators.rules import shaped

MARKUP = r"\.[jt]sx$"
# Names of properties that unrelated components share.
COMMON = """
className style children id key ref onClick onChange onSubmit onBlur onFocus onKeyDown onKeyUp onMouseDown onMouseUp onScroll
disabled loading visible hidden active selected checked open closed expanded collapsed as component variant size color type theme
mode layout orientation position align data value values name label title text description placeholder content message error
status state result results item items list options config settings info count total index level depth width height min max step
src href url path icon image header footer prefix suffix onClose onOpen onSelect onDelete onEdit onSave onCancel onConfirm onError
onSuccess onLoad renderItem render fallback
""".split()


def components(files: DataFrame) -> DataFrame:
    """file, line, component, props (of its signature) and body (up to the file's next component)."""
    head = r"(?m)(?=^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:function|const|let)[ \t]+[A-Z]\w*)"
    pieces = files.filter(F.col("relative_path").rlike(MARKUP)).select(F.col("relative_path").alias("file"), F.posexplode(F.split("content", head)).alias("at", "piece"))
    breaks = F.length("piece") - F.length(F.replace("piece", F.lit("\n")))
    before = F.coalesce(F.sum(breaks).over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("line", (before + 1).cast("int")).withColumn("component", F.regexp_extract("piece", r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:function|const|let)[ \t]+([A-Z]\w*)", 1))
    signature = r"^[^(){}]*\(\s*\{([^}]*)\}[^)]*\)"
    names = F.transform(F.split(F.regexp_extract("piece", signature, 1), ","), lambda p: F.regexp_extract(p, r"^\s*([A-Za-z_]\w*)", 1))
    props = F.array_distinct(F.filter(names, lambda p: p != ""))
    return pieces.filter("component <> ''").select("file", "line", "component", props.alias("props"), F.regexp_replace("piece", signature, "").alias("body"))


def prop_usages(files: DataFrame, common: bool = False) -> DataFrame:
    """file, line, component, prop, passed (as an attribute's whole value, or spread) and used (anywhere else)."""
    passing = r"(?:[\w-]+\s*=\s*)?\{\s*\.\.\.\s*\w+\s*\}|[\w-]+\s*=\s*\{\s*\w+\s*\}"
    passed = F.regexp_extract_all("body", F.lit(r"(?:=\s*\{\s*|\{\s*\.\.\.\s*)(\w+)\s*\}"), F.lit(1))
    rest = F.regexp_replace(F.regexp_replace("body", passing, " "), r"[\w-]+=(?=[\"'{])", " ")
    d = components(files).withColumns({"passes": passed, "uses": F.regexp_extract_all(rest, F.lit(r"(?<![.\w])([A-Za-z_]\w*)"), F.lit(1))})
    d = d.select("file", "line", "component", "passes", "uses", F.explode("props").alias("prop"))
    if not common:
        d = d.filter(~F.col("prop").isin(*COMMON))
    return d.select("file", "line", "component", "prop", F.array_contains("passes", F.col("prop")).alias("passed"), F.array_contains("uses", F.col("prop")).alias("used"))


def prop_drilling(files: DataFrame, edges: DataFrame | None = None, most: int = 3, common: bool = False) -> DataFrame:
    """Properties that at least most - 1 components hand down without using them, in files of which one imports another.

    The finding stands at the last component in order of file and line."""
    edges = extract.edges(extract.dependencies(files), files) if edges is None else edges
    uses = prop_usages(files, common)
    place = F.struct("file", "line", "component")
    chains = uses.groupBy("prop").agg(F.count_if(F.col("passed") & ~F.col("used")).alias("n"), F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("n") >= most - 1)
    at = uses.join(chains.select("prop"), "prop", "left_semi").select("prop", "file").distinct()
    out = at.join(edges.filter("src <> dst").select(F.col("src").alias("file"), "dst"), "file").select("prop", F.col("dst").alias("file"))
    linked = out.join(at, ["prop", "file"], "left_semi").select("prop").distinct()
    d = chains.join(linked, "prop").select("prop", F.col("n") + 1, "first", "last.*").toDF("prop", "depth", "first", "file", "line", "component")
    return shaped(d, "react/prop-drilling-detection", "warning", F.format_string("%s goes through %d components, from %s to %s", "prop", "depth", F.col("first.component"), "component"))


def _shadowed(code: Column) -> Column:
    """Names that the code itself declares: variables, parameters, caught errors."""
    patterns = (
        r"\b(?:const|let|var)\s+(\{[^}]*\}|\[[^\]]*\]|\w+)\s*(?:=|of\b|in\b)", r"\(([^()]*)\)\s*=>", r"(?:^|[,;{(\s])([a-z]\w*)\s*=>",
        r"\bfunction\s*\w*\s*\(([^)]*)\)", r"\bcatch\s*\(\s*(\w+)",
    )
    found = F.concat(*[F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in patterns])
    return F.regexp_extract_all(F.array_join(found, " "), F.lit(r"\b([a-z]\w*)\b"), F.lit(1))


def stale_closures(files: DataFrame) -> DataFrame:
    """State of a component that a callback reads without seeing later values: in setInterval; in setTimeout and
    addEventListener within an effect without dependencies; and in an async function after its first await.

    A callback is read up to 30 lines. Names that it declares itself, and state that it sets by a function of the old value, are
    no old state."""
    f = files.filter(F.col("relative_path").rlike(MARKUP)).select(F.col("relative_path").alias("file"), F.split("content", "\n").alias("lines"), "content")
    pair = r"(const\s+\[\s*\w+\s*,\s*\w+\s*\]\s*=\s*use(?:State|Reducer)\b)"
    parts = r"\[\s*(\w+)\s*,\s*(\w+)"
    states = F.transform(F.regexp_extract_all("content", F.lit(pair), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, parts, 1).alias("name"), F.regexp_extract(x, parts, 2).alias("setter")))
    f = f.withColumn("states", states).filter(F.size("states") > 0)
    kinds = {"interval": r"\bsetInterval\s*\(", "timeout": r"\bsetTimeout\s*\(", "listener": r"\baddEventListener\s*\(", "async": r"\basync\s*\([^)]*\)\s*=>|\basync\s+function"}

    def lines_with(kind: str, pattern: str) -> Column:
        return F.array_compact(F.transform("lines", lambda x, i: F.when(x.rlike(pattern), F.struct((i + 1).alias("line"), F.lit(kind).alias("kind")))))

    hits = F.concat(*[lines_with(k, p) for k, p in kinds.items()])
    d = f.select("file", "lines", "states", F.inline(hits))
    code = F.array_join(F.slice("lines", F.col("line"), F.lit(30)), "\n")
    call = F.when(F.col("kind") == "async", F.regexp_extract(code, r"(?s)\basync\b[^{]*(\{.*)", 1)).otherwise(F.regexp_extract(code, r"(?s)\b(?:setInterval|setTimeout|addEventListener)\s*(\(.*)", 1))
    d = d.withColumn("code", F.when(F.col("kind") == "async", to_closing(call, "{", "}")).otherwise(to_closing(call)))
    back = F.greatest(F.col("line") - 20, F.lit(1))
    until = F.array_join(F.slice("lines", back, F.col("line") - back + 1), "\n")
    effect = F.concat(F.regexp_extract(until, r"(?s).*(\buseEffect\s*\(.*)", 1), F.lit("\n"), F.array_join(F.slice("lines", F.col("line") + 1, F.lit(4)), "\n"))
    words = lambda c: F.regexp_extract_all(c, F.lit(r"(?<![.\w])([A-Za-z_]\w*)"), F.lit(1))
    d = d.withColumns({
        "inside": until.rlike(r"\buseEffect\s*\(") & effect.rlike(r"\[\s*\]\s*\)"),
        "reads": words(F.when(F.col("kind") == "async", F.regexp_extract("code", r"(?s)\bawait\b(.*)", 1)).otherwise(F.col("code"))),
        "own": _shadowed(F.col("code")),
        "functional": F.regexp_extract_all("code", F.lit(r"(\w+)\s*\(\s*(?:\(\s*\w+\s*\)\s*=>|\w+\s*=>|function\b)"), F.lit(1)),
    })
    d = d.filter(F.col("inside") | F.col("kind").isin("interval", "async"))
    old = F.filter("states", lambda s: F.array_contains("reads", s["name"]) & ~F.array_contains("own", s["name"]) & ~F.array_contains("functional", s["setter"]))
    d = d.withColumn("old", F.array_sort(F.array_distinct(F.transform(old, lambda s: s["name"])))).filter(F.size("old") > 0)
    return shaped(d, "react/stale-closure-patterns", "warning", F.concat("kind", F.lit(" callback may hold old state: "), F.array_join("old", ", ")))


register("react/prop-drilling-detection", prop_drilling)
register("react/stale-closure-patterns", stale_closures)
