"""The command line and plug-ins on files written here."""

import json

from lodestone import cli, register, register_parser, validate
from lodestone.operators import extract, fixes, parsers, rules
from lodestone.operators.rules import shaped
from lodestone.sources.files import described
from pyspark.sql import functions as F

FILES = {
    "shared/user.ts": "export function getUserById(id: string) {}\n",
    "client/page.ts": "getUsrById('1');\nconst v: any = 1;\n",
    "client/skip.ts": "eval(x);\n",
    "lodestone.config.json": '{"patterns": {"exclude": ["**/skip.ts"]}}',
}


def project(tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    return str(tmp_path)


def test_validate_and_fix(spark, tmp_path, capsys):
    folder = project(tmp_path)
    assert cli.main(["validate", folder, "--rules", "lines"]) == 0
    out = capsys.readouterr().out
    assert "client/page.ts" in out and "explicit any" in out and "eval" not in out
    assert cli.main(["validate", folder, "--rules", "lines", "--fail-on", "warning", "--format", "vscode"]) == 1
    assert "client/page.ts(2,1): warning type-safety: explicit any" in capsys.readouterr().out
    assert cli.main(["fix", folder, "--rules", "signatures"]) == 0
    assert "getUserById('1');" in capsys.readouterr().out
    assert cli.main(["report", folder, "--rules", "lines", "--output", str(tmp_path / "out")]) == 0
    assert list((tmp_path / "out").glob("*.json"))
    assert cli.main(["analyze", folder]) == 0
    assert cli.main(["report", folder, "--rules", "lines", "--format", "json", "--output", str(tmp_path / "doc")]) == 0
    whole = json.loads("".join(x.read_text() for x in sorted((tmp_path / "doc").glob("*.txt"))))
    assert whole["summary"]["total"] == len(whole["violations"]) > 0
    assert cli.main(["fix", folder, "--rules", "signatures", "--write"]) == 0
    assert (tmp_path / "client/page.ts").read_text() == FILES["client/page.ts"].replace("getUsrById", "getUserById")
    assert all((tmp_path / n).read_text() == t for n, t in FILES.items() if n != "client/page.ts") and not list(tmp_path.glob(".lode*"))


def test_own_rules_and_parsers(spark, monkeypatch):
    monkeypatch.setattr(rules, "RULES", dict(rules.RULES))
    monkeypatch.setattr(parsers, "PARSERS", parsers.PARSERS)
    f = described(spark.createDataFrame([("a.kt", "use x\n")], "relative_path string, content string"))
    rules.RULES["own"] = lambda files: shaped(files.withColumn("line", F.lit(1)), "own", "info", F.lit("seen"), "relative_path")
    assert [r["message"] for r in validate(f, ["own"]).collect()] == ["seen"]
    register_parser("kotlin", lambda text: ([("x", "import", 1, [], False, False)], []))
    try:
        assert [r["target"] for r in extract.dependencies(f).collect()] == ["x"]
    finally:
        register_parser("kotlin", None)
    assert callable(register)


def test_edits_do_not_chain(spark):
    files = spark.createDataFrame([("a", "old older old"), ("b", "old")], "relative_path string, content string")
    plan = spark.createDataFrame([("a", 1, "old", "new"), ("a", 1, "new", "last")], "file string, line int, old string, new string")
    assert {tuple(r) for r in fixes.edited(files, plan).select("relative_path", "content").collect()} == {("a", "new older new"), ("b", "old")}
    assert fixes.wanted(plan, "a", "old").count() == 1
