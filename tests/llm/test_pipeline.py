"""The pipeline's stages on documents with planted cases."""

import corpus_pipeline as cp
from lodestone.llm.common import read

FOLDER = "/root/testdata/sf0.01"


def test_stages_remove_what_they_should(spark, tmp_path):
    docs = read(spark, FOLDER, "documents")
    item = read(spark, FOLDER, "benchmark").orderBy("item_id").first()["text"]
    clean = " ".join(f"plain{i} words{i * 7}" for i in range(60))
    near = clean.replace("plain5 ", "other5 ")
    rows = [(-1, clean, "en", "z", 1), (-2, near, "en", "z", 1), (-3, item, "en", "z", 1), (-4, None, None, None, None)]
    planted = spark.createDataFrame(rows, docs.schema)
    assert planted.columns == docs.columns

    kept = cp.near_duplicates(spark, planted, FOLDER)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {-2, -3, -4}  # -2 is the smaller id of the near pair

    cut = {r["doc_id"]: r["text"] for r in cp.substring_dedup(spark, planted, FOLDER).collect()}
    assert cut[-3] == item and cut[-4] is None and len(cut[-1].split()) < 60

    left = {r["doc_id"] for r in cp.decontamination(spark, planted, FOLDER).collect()}
    assert left == {-1, -2, -4}

    mild = {r["doc_id"] for r in cp.toxicity(spark, planted, FOLDER).collect()}
    assert mild >= {-1, -2, -4}
    assert {"doc_id", "taken"} <= set(cp.mixing(spark, planted, FOLDER).columns)
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None


def test_repeated_rows_and_ids_lose_no_text(spark, tmp_path):
    docs = read(spark, FOLDER, "documents")
    one, two, three = (" ".join(f"{k}{i} word{i * n}" for i in range(60)) for k, n in (("first", 7), ("second", 11), ("third", 13)))
    near = one.replace("first5 ", "other5 ")
    # a row twice; an id with a near copy of a smaller id and with a text of its own; an id with two near copies; empty texts
    rows = [(1, one, "en", "z", 1), (1, one, "en", "z", 1), (2, near, "en", "z", 1), (2, two, "en", "z", 1), (3, three, "en", "z", 1), (3, three.replace("third9 ", ""), "en", "z", 1), (4, "", "en", "z", 1), (4, None, "en", "z", 1), (None, one, "en", "z", 1)]
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(f"{tmp_path}/docs")

    kept = cp.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), FOLDER)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"] or 0), (r["text"] or "")) for r in kept.collect())
    assert [g for g in got if g[0] != 3] == sorted([(0, one), (1, one), (2, two), (4, ""), (4, "")])
    assert len([g for g in got if g[0] == 3]) == 1


def test_whole_run_against_sql_and_brute_force(spark, tmp_path):
    """All stages over a table with planted toxic documents, near copies, passages and benchmark items."""
    from collections import Counter

    import duckdb

    from lodestone.llm import op3_toxicity, op6_decontam, op8_mix, op10_jaccard

    docs = read(spark, FOLDER, "documents").filter("doc_id < 150")
    words = lambda k, n: " ".join(f"{k}{i * 7919 % 1000}" for i in range(n))
    item = read(spark, FOLDER, "benchmark").orderBy("item_id").first()["text"]
    rows = [(9000 + k, f"You are a stupid clown and a worthless moron. {words(f'tox{k}x', 30)}", "en", "src1", 1) for k in range(3)]
    rows += [(9010, words("near", 80), "en", "src2", 1), (9011, words("near", 79) + " other", "en", None, 1), (9020, item, "en", "src3", 1), (9021, "", "en", "src3", 0), (9022, None, None, None, None)]
    rows += [(9030 + k, f"{words(f'own{k}x', 50)} {words('shared', 45)} {words(f'end{k}x', 20)}", "en", "src4", 1) for k in range(3)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    read(spark, FOLDER, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    read(spark, FOLDER, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = str(tmp_path)
    got = [tuple(r) for r in cp.run(spark, folder).orderBy("doc_id").collect()]

    held = "coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)"
    model = op3_toxicity.learn(read(spark, folder, "documents"), read(spark, folder, "labels").filter(f"not {held}"))
    left = read(spark, folder, "documents").toPandas()
    left = left[model.scores([t if isinstance(t, str) else None for t in left.text]) < op3_toxicity.PREDICT]
    assert not set(left.doc_id) & {9000, 9001, 9002}
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")

    def sql(query, frame):
        duck.register("documents", frame)
        return duck.sql(query).df()

    part = sql(op10_jaccard.OP10_SQL, left)
    left = left[left.doc_id.isin(set(part.groupby("component_id").doc_id.min()))]
    assert 9011 not in set(left.doc_id) and {9010, 9021, 9022} <= set(left.doc_id)
    split = {r.doc_id: r.text.encode().split() if isinstance(r.text, str) else [] for r in left.itertuples()}
    seen = Counter(tuple(w[i : i + 35]) for w in split.values() for i in range(len(w) - 34))

    def cut(r):
        w = split[r.doc_id]
        gone = {p for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        return b" ".join(x for p, x in enumerate(w) if p not in gone).decode() if gone else r.text

    left = left.assign(text=[cut(r) for r in left.itertuples()])
    assert all("shared" not in left.set_index("doc_id").text[9030 + k] for k in range(3))
    bad = sql(op6_decontam.OP6_SQL, left)
    left = left[~left.doc_id.isin(set(bad[bad.contaminated].doc_id))]
    assert 9020 not in set(left.doc_id)
    want = sql(op8_mix.OP8_SQL, left).sort_values("doc_id")
    assert [(a, b, c, round(d, 6), e) for a, b, c, d, e, _ in got] == [(r.doc_id, r.size_, r.source_size, round(r.target, 6), r.taken) for r in want.rename(columns={"size": "size_"}).itertuples()]


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        read(spark, FOLDER, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_nulls_repeats_and_columns(spark, tmp_path):
    docs = read(spark, FOLDER, "documents")
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "plain words", "en", None, 2), (1, "plain words", "en", None, 2), (None, "you stupid idiot", "en", "a", 1)]
    d = spark.createDataFrame(rows, docs.schema)
    assert cp.decontamination(spark, d, FOLDER).count() == 5 and cp.mixing(spark, d, FOLDER).count() == 5
    kept = [r["text"] for r in cp.toxicity(spark, d, FOLDER).collect()]
    assert kept.count(None) == 2 and kept.count("plain words") == 2 and "you stupid idiot" not in kept
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, d, FOLDER).columns == docs.columns, name
