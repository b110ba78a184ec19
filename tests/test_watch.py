"""Changes of a folder, poll by poll, and the findings that follow them."""

import os
import time

from lodestone.operators.rules import validate
from lodestone.sources.files import described, scan
from lodestone.streaming import watch


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def put(folder, name, text, at=None):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    if at:
        os.utime(folder / name, (at, at))


def files(spark, folder):
    return described(scan(spark, str(folder)).select("relative_path", "content"))


def test_polls_and_findings(spark, tmp_path):
    root, state = tmp_path / "root", str(tmp_path / "state")
    put(root, "a.ts", "eval(x);\n", 1_700_000_000)
    put(root, "d/b.ts", "const v: any = 1;\n", 1_700_000_000)
    put(root, "gone.ts", "eval(z);\n", 1_700_000_000)
    put(root, "same.ts", "while (true) {\n}\n", 1_700_000_000)
    assert watch.poll(spark, str(root), state, 0).count() == 0
    groups = list(watch.LOCAL)
    cols = ("file", "line", "rule", "severity", "message")
    before = validate(files(spark, root), groups)
    old = spark.createDataFrame(before.collect(), before.schema)
    put(root, "d/b.ts", "const v = 1;\n", 1_700_000_100)
    put(root, "new.ts", "x();\neval(y);\n", 1_700_000_100)
    (root / "gone.ts").unlink()
    for _ in range(2):  # a poll that is run again finds the same
        changed = watch.poll(spark, str(root), state, 1)
        assert rows(changed, "path", "type") == {("d/b.ts", "change"), ("new.ts", "add"), ("gone.ts", "unlink")}
    got = watch.findings_after(old, files(spark, root), changed)
    assert rows(got, *cols) == rows(validate(files(spark, root), groups), *cols)
    assert {("new.ts", 2), ("a.ts", 1)} <= rows(got, "file", "line") and "gone.ts" not in {r["file"] for r in got.collect()}
    assert watch.poll(spark, str(root), state, 2).count() == 0
    assert rows(watch.summary_of(state, spark), "type", "changes") == {("add", 1), ("change", 1), ("unlink", 1)}


def test_files_being_written_wait(spark, tmp_path):
    root, state = tmp_path / "root", str(tmp_path / "state")
    put(root, "a.ts", "1", 1_700_000_000)
    put(root, "b.ts", "1", 1_700_000_000)
    watch.poll(spark, str(root), state, 0, 60_000)
    put(root, "a.ts", "22", time.time())
    put(root, "c.ts", "22", time.time())
    assert watch.poll(spark, str(root), state, 1, 60_000).count() == 0
    put(root, "a.ts", "22", time.time() - 100)
    assert rows(watch.poll(spark, str(root), state, 2, 60_000), "path", "type") == {("a.ts", "change")}


def test_watch_runs(spark, tmp_path):
    root, state = tmp_path / "root", str(tmp_path / "state")
    put(root, "a.ts", "1", 1_700_000_000)
    q = watch.watch(spark, str(root), state, str(tmp_path / "cp"), settle_ms=0)
    try:
        end = time.time() + 60
        while time.time() < end and not (tmp_path / "state" / "changes" / "v=0" / "_SUCCESS").exists():
            time.sleep(0.2)
        put(root, "b.ts", "1")
        while time.time() < end and not rows(watch.summary_of(state, spark), "type"):
            time.sleep(0.5)
    finally:
        q.stop()
    assert rows(watch.summary_of(state, spark), "type", "paths") == {("add", 1)}
