"""Line rules on the documents table, and reports over their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators.lines import around, lines_of
from lodestone.sources.tables import table

#: Kind and pattern; one group is the secret itself. No look-around, so that any engine can run them.
SECRETS = (("token", r'token\s*=\s*"([0-9a-f]{40})"'), ("password", r'password\s*=\s*"([^"]{8,})"'), ("aws", r"(AKIA[0-9A-Z]{16})"), ("mail", r"([0-9A-Za-z._]+@[0-9a-z.]+\.com)"))
SENSITIVE = ("token", "license", "password", "secret", "licensed")
GUARDS = "(apache|mit|gnu)"


def lines(spark, d) -> DataFrame:
    return lines_of(table(spark, d, "documents").select("doc_id", "text"), "text")


def secrets_of(line) -> Column:
    """Array of (kind, secret) of a line, for all patterns in one pass over the lines."""

    def of_kind(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("secret")))

    return F.flatten(F.array(*[of_kind(k, p) for k, p in SECRETS]))


def secret_scan(spark, d):
    found = lines(spark, d).select("doc_id", "line_no", F.inline(secrets_of(F.col("line"))))
    return found.select("doc_id", "line_no", "kind", F.concat(F.substring("secret", 1, 4), F.lit("***")).alias("masked"))


def words_of(line) -> Column:
    return F.filter(F.array(*map(F.lit, SENSITIVE)), lambda w: F.contains(F.lower(line), w))


def sensitive_words(spark, d):
    return lines(spark, d).select("doc_id", "line_no", F.explode(words_of(F.col("line"))).alias("word"))


def context_window(spark, d):
    """Lines that speak of a license while no line within two names one that is known."""
    d2 = lines(spark, d).withColumn("near", F.lower(around(["doc_id"], ["line_no"], 2, 2)))
    return d2.filter(F.lower("line").contains("license") & ~F.col("near").rlike(GUARDS)).select("doc_id", "line_no", "line")


def tokens(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    return docs.select("source", "lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9_]*"), F.lit(0))).alias("name"))


def casing_dominance(spark, d):
    """The style that names of a source and language mostly have: of at least five, 70 % or clearly the leader."""
    n = tokens(spark, d).filter(F.length("name") >= 2).groupBy("source", "lang", "name").agg(F.count("*").alias("n"))  # a name's style is told once
    n = n.groupBy("source", "lang", text.casing(F.col("name")).alias("style")).agg(F.sum("n").alias("n"))
    w = W.partitionBy("source", "lang")
    n = n.withColumn("total", F.sum("n").over(w)).filter(~F.col("style").isin("unknown", "SCREAMING_SNAKE_CASE"))
    order = w.orderBy(F.desc("n"), "style")
    n = n.withColumns({"rank": F.row_number().over(order), "second": F.lead("n").over(order)})
    lead = (F.col("n") >= 0.7 * F.col("total")) | F.when(F.col("second").isNull(), F.col("n") >= 2).otherwise((F.col("n") > F.col("second")) | (F.col("n") >= 3))
    return n.filter((F.col("rank") == 1) & (F.col("total") >= 5) & lead).select("source", "lang", "style", "n", "total")


def findings(spark, d) -> DataFrame:
    """doc_id, line_no, rule, severity, message of three rules, in one pass: an array of findings a line, exploded once."""
    rows = lines(spark, d).withColumn("near", F.lower(around(["doc_id"], ["line_no"], 2, 2)))

    def finding(rule: str, severity: str, message) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))

    a = F.transform(secrets_of(F.col("line")), lambda x: finding("hardcoded-secrets", "error", F.concat(F.lit("secret "), x["kind"])))
    b = F.transform(words_of(F.col("line")), lambda w: finding("data-flow-integrity", "warning", F.concat(F.lit("word "), w)))
    open_license = F.lower("line").contains("license") & ~F.col("near").rlike(GUARDS)
    c = F.array_compact(F.array(F.when(open_license, finding("license-context", "info", F.lit("license without a name")))))
    return rows.select("doc_id", "line_no", F.inline(F.concat(a, b, c)))


def severity_summary(spark, d):
    from lodestone.operators.reports import severity_counts

    return severity_counts(findings(spark, d))


def health_score(spark, d):
    from lodestone.operators.reports import health

    return health(findings(spark, d))


def by_rule_report(spark, d):
    return findings(spark, d).groupBy("rule", "severity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("files"))


def by_file_report(spark, d):
    items = F.array_sort(F.collect_list(F.struct("line_no", "rule", "message")))
    one = F.transform(items, lambda x: F.concat(x["line_no"].cast("string"), F.lit(":"), x["rule"], F.lit(":"), x["message"]))
    return findings(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(one, "|").alias("report"))


def sarif_rows(spark, d):
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    return findings(spark, d).select(F.col("rule").alias("rule_id"), level.alias("level"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("uri"), F.coalesce("line_no", F.lit(1)).alias("start_line"), F.lit(1).alias("start_column"), "message")


def language_histogram(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("sources"))


def convention_vote(spark, d):
    """How many names of each convention a language's texts have."""
    kinds = (("camel", "^[a-z]+[A-Z][A-Za-z0-9]*$"), ("pascal", "^[A-Z][a-z0-9]+$"), ("snake", "^[a-z0-9]+_[a-z0-9_]+$"))
    names = tokens(spark, d).groupBy("lang", "name").agg(F.count("*").alias("n"))
    return names.groupBy("lang").agg(*[F.sum(F.when(F.col("name").rlike(p), F.col("n")).otherwise(0)).alias(k) for k, p in kinds])


QUERIES = {f.__name__: f for f in (secret_scan, sensitive_words, context_window, casing_dominance, severity_summary, health_score, by_rule_report, by_file_report, sarif_rows, language_histogram, convention_vote)}
_L = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line_no FROM documents)"
_S = " UNION ALL ".join(f"SELECT doc_id, line_no, '{k}' AS kind, unnest(regexp_extract_all(line, '{p}', 1)) AS secret FROM l" for k, p in SECRETS)
_F = f"""{_L}, sec AS (SELECT doc_id, line_no, kind, substr(secret, 1, 4) || '***' AS masked FROM ({_S})),
sen AS (SELECT doc_id, line_no, word FROM l, (SELECT unnest({list(SENSITIVE)}) AS word) WHERE contains(lower(line), word)),
near AS (SELECT *, lower(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS near FROM l),
con AS (SELECT doc_id, line_no, line FROM near WHERE contains(lower(line), 'license') AND NOT regexp_matches(near, '{GUARDS}')),
f AS (SELECT doc_id, line_no, 'hardcoded-secrets' AS rule, 'error' AS severity, 'secret ' || kind AS message FROM sec
  UNION ALL SELECT doc_id, line_no, 'data-flow-integrity', 'warning', 'word ' || word FROM sen
  UNION ALL SELECT doc_id, line_no, 'license-context', 'info', 'license without a name' FROM con)"""
_T = "t AS (SELECT source, lang, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*')) AS name FROM documents)"
_COUNTS = "SELECT count(*) AS total, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM f"
ORACLES = {
    "secret_scan": f"WITH {_F} SELECT * FROM sec",
    "sensitive_words": f"WITH {_F} SELECT * FROM sen",
    "context_window": f"WITH {_F} SELECT * FROM con",
    "casing_dominance": f"""WITH {_T}, n AS (SELECT source, lang, CASE WHEN regexp_full_match(name, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)*') THEN 'SCREAMING_SNAKE_CASE'
  WHEN regexp_full_match(name, '[a-z][a-z0-9]*(_[a-z0-9]+)+') THEN 'snake_case' WHEN regexp_full_match(name, '[A-Z][a-zA-Z0-9]*') THEN 'PascalCase'
  WHEN regexp_full_match(name, '[a-z][a-zA-Z0-9]*') THEN 'camelCase' ELSE 'unknown' END AS style, count(*) AS n FROM t WHERE length(name) >= 2 GROUP BY ALL),
m AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source, lang) AS BIGINT) AS total FROM n),
o AS (SELECT *, row_number() OVER w AS rank, lead(n) OVER w AS second FROM m WHERE style NOT IN ('unknown', 'SCREAMING_SNAKE_CASE') WINDOW w AS (PARTITION BY source, lang ORDER BY n DESC, style))
SELECT source, lang, style, n, total FROM o WHERE rank = 1 AND total >= 5 AND (n >= 0.7 * total OR CASE WHEN second IS NULL THEN n >= 2 ELSE n > second OR n >= 3 END)""",
    "severity_summary": f"WITH {_F} {_COUNTS}",
    "health_score": f"WITH {_F}, c AS ({_COUNTS}) SELECT greatest(0, 100 - 10 * errors - 3 * warnings - infos) AS score FROM c",
    "by_rule_report": f"WITH {_F} SELECT rule, severity, count(*) AS n, count(DISTINCT doc_id) AS files FROM f GROUP BY 1, 2",
    "by_file_report": f"WITH {_F} SELECT doc_id, count(*) AS n, string_agg(line_no || ':' || rule || ':' || message, '|' ORDER BY line_no, rule, message) AS report FROM f GROUP BY doc_id",
    "sarif_rows": f"WITH {_F} SELECT rule AS rule_id, CASE severity WHEN 'info' THEN 'note' ELSE severity END AS level, 'doc/' || doc_id AS uri, coalesce(line_no, 1) AS start_line, 1 AS start_column, message FROM f",
    "language_histogram": "SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY lang",
    "convention_vote": f"""WITH {_T} SELECT lang, count(*) FILTER (regexp_full_match(name, '[a-z]+[A-Z][A-Za-z0-9]*')) AS camel,
count(*) FILTER (regexp_full_match(name, '[A-Z][a-z0-9]+')) AS pascal, count(*) FILTER (regexp_full_match(name, '[a-z0-9]+_[a-z0-9_]+')) AS snake FROM t GROUP BY lang""",
}
