"""Files replaced whole and documents written in ranges."""

import json

import pytest

from lodestone.operators import reports
from lodestone.sources import sinks

FILES = "relative_path string, content string"


def tree(root):
    return {str(p.relative_to(root)): p.read_bytes().decode() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_files_are_replaced_whole(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.ts").write_text("old")
    (tmp_path / "stays.ts").write_text("stays")
    rows = [("a/x.ts", "new\r\nü"), ("b/c/y.ts", ""), *[(f"many/{i}.ts", str(i)) for i in range(40)]]
    sinks.write_files(spark.createDataFrame(rows, FILES).repartition(5), str(tmp_path))
    assert tree(tmp_path) == {"stays.ts": "stays", **dict(rows)}
    sinks.write_files(spark.createDataFrame([], FILES), f"file://{tmp_path}")
    assert tree(tmp_path) == {"stays.ts": "stays", **dict(rows)}


@pytest.mark.parametrize("bad", [(None, "x"), ("n.ts", None), ("../n.ts", "x"), ("/n.ts", "x"), ("a/../../n.ts", "x"), ("b.ts", "x")])
def test_all_or_none(spark, tmp_path, bad):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.ts").write_text("old")
    with pytest.raises(Exception):  # noqa: B017, PT011
        sinks.write_files(spark.createDataFrame([("a.ts", "new"), ("b.ts", "new"), bad], FILES).repartition(3), str(root))
    assert tree(tmp_path) == {"root/a.ts": "old"} and not list(root.glob(".lode*"))


def test_a_cut_off_commit_is_finished(tmp_path, monkeypatch):
    (tmp_path / "a.ts").write_text("old")
    w = sinks.FileTreeWriter(str(tmp_path))
    row = lambda *x: dict(zip(("relative_path", "content"), x, strict=True))
    w.write(iter([row("a.ts", "lost attempt")]))
    messages = [w.write(iter([row("a.ts", "1"), row("b/b.ts", "2")])), None, w.write(iter([]))]
    monkeypatch.setattr(sinks, "settled", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        w.commit(messages)
    monkeypatch.undo()
    assert (tmp_path / "a.ts").read_text() == "old"
    assert (sinks.finish(str(tmp_path)), sinks.finish(str(tmp_path))) == (1, 0)
    assert tree(tmp_path) == {"a.ts": "1", "b/b.ts": "2"}


def test_documents_in_ranges(spark, tmp_path):
    rows = [(f"f{i % 7}.ts", i % 3 or None, "r1" if i % 2 else "r2", ("error", "warning", "info")[i % 3], f'm "{i % 5}"\n') for i in range(200)]
    schema = "file string, line int, rule string, severity string, message string"
    for some in (rows, rows[:1], rows[:1] * 3, []):
        found = spark.createDataFrame(some, schema).repartition(4)
        for pieces, whole in ((reports.json_pieces, reports.json_document), (reports.sarif_pieces, reports.sarif_document)):
            folder = tmp_path / f"{pieces.__name__}-{len(some)}"
            sinks.write_document(pieces(found), str(folder))
            parts = [p.read_text() for p in sorted(folder.glob("*.txt"))]
            got, want = json.loads("".join(parts)), json.loads(whole(found).first()["document"])
            for doc in (got, want):
                items = doc["violations"] if "violations" in doc else doc["runs"][0]["results"]
                items[:] = sorted(map(json.dumps, items))
            assert got == want
