"""The folder source against brute force across a restart; links kept by changes against a rebuild after each batch."""

import os
import random

from pyspark.sql import functions as F

from lodestone.operators import extract
from lodestone.sources.files import described, scan
from lodestone.streaming import links, source


def put(folder, name, text, at):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    os.utime(folder / name, (at, at))


def batch(spark, root, tmp, sink):
    """What is new since the last call, as rows, by a query that starts anew each time."""
    got = []
    q = (
        spark.readStream.format("folder_changes").option("path", str(root)).option("state", str(tmp / "snapshots")).option("settleMs", "0").load()
        .writeStream.foreachBatch(lambda b, n: got.extend(tuple(r) for r in b.select("path", "type", "seq").collect())).option("checkpointLocation", str(tmp / sink)).trigger(once=True).start()
    )
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(got)


def test_changes_across_restarts(spark, tmp_path):
    source.register(spark)
    root, r, at = tmp_path / "root", random.Random(5), 1_700_000_000
    for name in ("a.ts", "d/b.ts", "c.ts"):
        put(root, name, "1", at)
    assert batch(spark, root, tmp_path, "cp") == []
    seq = 0
    before = source.listed(str(root))
    for _ in range(4):
        for name in r.sample(["a.ts", "d/b.ts", "c.ts", "e.ts", "d/f.ts"], 3):
            at += 10
            if (root / name).exists() and r.random() < 0.4:
                (root / name).unlink()
            else:
                put(root, name, "x" * r.randint(1, 9), at)
        after = source.listed(str(root))
        want = [(p, t) for p, t, _ in source.differences(before, after, 0)]
        seq += bool(want)
        got = batch(spark, root, tmp_path, "cp")
        assert [g[:2] for g in got] == sorted(want) and all(g[2] == seq for g in got)
        before = after
    assert batch(spark, root, tmp_path, "cp") == []
    assert len(list((tmp_path / "snapshots").glob("snapshot-*"))) <= 3


def test_a_batch_may_run_again(tmp_path):
    root = tmp_path / "root"
    put(root, "a", "1", 1_700_000_000)
    one = source.FolderReader({"path": str(root), "state": str(tmp_path / "s"), "settleMs": "0"})
    start = one.initialOffset()
    put(root, "b", "1", 1_700_000_001)
    end = one.latestOffset()
    (root / "a").unlink()
    again = source.FolderReader({"path": str(root), "state": str(tmp_path / "s"), "settleMs": "0"})
    later = again.latestOffset()
    rows = lambda x, s, e: [(c.seq, *r[:2]) for c in x.partitions(s, e) for r in c.rows]
    assert rows(one, start, end) == rows(again, start, end) == [(1, "b", "add")]
    assert rows(again, start, later) == [(1, "b", "add"), (2, "a", "unlink")]


def test_files_being_written_wait(tmp_path):
    root = tmp_path / "root"
    put(root, "a", "1", 1_700_000_000)
    x = source.FolderReader({"path": str(root), "state": str(tmp_path / "s"), "settlems": "60000"})
    start = x.initialOffset()
    (root / "a").write_text("22")
    (root / "new").write_text("1")
    assert x.latestOffset() == start
    os.utime(root / "a", (1_700_000_100, 1_700_000_100))
    assert [c.rows[0][:2] for c in x.partitions(start, x.latestOffset())] == [("a", "change")]


def test_links_equal_a_rebuild(spark, tmp_path):
    root, r, at = tmp_path / "root", random.Random(8), 1_700_000_000
    names = [f"f{i}.ts" for i in range(6)]
    root.mkdir()
    changes, present, seq = tmp_path / "changes", {}, 0
    schema = "path string, type string, seq long, targets array<string>"
    for _ in range(4):
        rows = []
        for name in r.sample(names, 3):
            seq += 1
            at += 10
            if name in present and r.random() < 0.4:
                (root / name).unlink()
                del present[name]
                rows.append((name, "unlink", seq, None))
            else:
                to = r.sample(names, r.randint(0, 3))
                put(root, name, "".join(f"import x{i} from './{t[:-3]}';\n" for i, t in enumerate(to)), at)
                rows.append((name, "change" if name in present else "add", seq, [t[:-3] for t in to]))
                present[name] = to
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(changes))
        stream = links.linked(spark.readStream.schema(schema).parquet(str(changes)))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "steps")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        steps = spark.read.schema(links.STEPS).parquet(str(tmp_path / "steps"))
        now = described(scan(spark, str(root)).select("relative_path", "content"))
        want = {(e["src"], e["dst"]) for e in extract.edges(extract.dependencies(now), now).collect()} if present else set()
        got = links.standing(links.fold(steps), now.select(F.col("relative_path").alias("path")), extract.CANDIDATES)
        assert {tuple(x) for x in got.collect()} == want
    assert steps.filter("seq > 9").select("src").distinct().count() <= 3
