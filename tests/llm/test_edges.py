"""Nulls, ties, repeated rows, very long texts, empty tables and clashing columns of the operators; their methods on planted cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import op1_quality, op2_licenses, op3_toxicity, op4_rules, op5_langid, op6_decontam, op8_mix, op9_substrings
from lodestone.llm.common import ensure_checkpoint_dir

SCHEMA = "doc_id long, text string, lang string, source string"
LONG = "word " * 400_000
ROWS = [(1, "you idiot", "en", "a"), (1, "you idiot", "en", "a"), (None, None, None, None), (2, "", "en", None), (3, LONG, "en", "a"), (None, "Das ist gut", "de", "a"), (4, "☃ \U0001f600", None, "b")]
LABELS = [(1, 0, 1), (1, 0, 1), (None, 1, 0), (3, 1, 0), (9, 1, 1), (2, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def clash(docs):
    """docs with columns named like results and like inner columns."""
    names = ("score", "N_WORDS", "labels", "lang_pred", "_w", "p", "hit", "s", "k", "c", "win", "size", "sid", "k1", "host", "path")
    return docs.select("*", *[F.lit(7).alias(n) for n in names])


def test_evidence_and_sites(spark, docs, labels):
    for d in (docs, clash(docs)):
        got = op1_quality.score(d, op1_quality.fit(d, labels), F.col("source"), F.col("lang")).collect()
        assert len(got) == len(ROWS) and all(0 < r["score"] < 1 for r in got)
        twins = [tuple(r) for r in got if r["doc_id"] == 1]
        assert twins[0] == twins[1]
    assert op1_quality.score(docs.limit(0), None, F.col("source"), F.col("lang")).collect() == []
    none = op1_quality.score(docs, op1_quality.fit(docs, labels.limit(0)), F.col("source"), F.col("lang")).collect()
    assert {r["document_evidence"] for r in none} == {0.5}


def test_sites_beyond_a_broadcast(spark, docs, labels, monkeypatch):
    coef = op1_quality.fit(docs, labels)
    few = sorted(map(str, op1_quality.score(docs, coef, F.col("source"), F.col("lang")).collect()))
    monkeypatch.setattr(op1_quality, "BROADCAST_SITES", 0)
    assert sorted(map(str, op1_quality.score(docs, coef, F.col("source"), F.col("lang")).collect())) == few


def test_license_edges(spark, docs):
    got = op2_licenses.scan(clash(docs))
    assert len(got.columns) == len({c.lower() for c in got.columns}) and got.count() == len(ROWS)
    assert op2_licenses.scan(docs.limit(0)).collect() == []
    assert {r["n_words"] for r in got.filter("doc_id = 3").collect()} == {400_000}


PHRASES = {
    "BSD 3-Clause License": "bsd-3-clause", "Apache 2.0 License": "apache-2.0", "GPLv3": "gpl-3.0", "AGPLv3": "agpl-3.0", "LGPL v2.1": "lgpl-2.1", "gpl-2.0-only": "gpl-2.0-only",
    "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache-2.0,mit", "SPDX-License-Identifier: GPL-2.0+": "gpl-2.0-or-later", "Creative Commons Attribution 4.0": "cc-by-4.0",
    "GNU General Public License v2 or (at your option) any later version": "gpl-2.0-or-later", "the MIT License or the ISC License": "isc,mit", "smit license": "", "Apache/2.0.52": "",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa-4.0", "Redistribution and use in source and binary forms": "bsd",
}


def test_license_phrases():
    s = op2_licenses.Scanner()
    assert {t: ",".join(sorted({r.label for _, _, r in s.detect(t.lower())})) for t in PHRASES} == PHRASES
    rules = op2_licenses.build_rules()
    assert len(rules) > 300 and len({r.pattern.pattern for r in rules}) == len(rules)
    for r in rules:  # the keyword must stand in whatever the pattern finds; its words at least in its text
        assert re.sub(r"[^a-z0-9©]", "", op2_licenses._first(r.keyword))[:3] in re.sub(r"[^a-z0-9©]", "", r.pattern.pattern.replace("[sc]", "c")), r


def test_suppression_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        found = []
        for _ in range(rng.randint(0, 12)):
            a = rng.randint(0, 20)
            found.append((a, a + rng.randint(1, 8), op2_licenses.Rule(rng.randint(0, 4), "x", "", op2_licenses.SPDX, 1.0)))
        kept = []
        for a, b, r in sorted(found, key=lambda x: (x[2].priority, x[0] - x[1], x[0])):
            if not any(p <= a and b <= q for p, q, _ in kept):
                kept.append((a, b, r))
        assert op2_licenses.settle(found) == sorted(kept, key=lambda x: (x[0], x[1]))


def test_license_labels_brute_force(spark):
    """Every rule on every text, without the keyword gate, gives what the scan gives."""
    s, rules = op2_licenses.Scanner(), op2_licenses.build_rules()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text is not null").limit(200)
    got = {r["doc_id"]: r for r in op2_licenses.scan(docs).collect()}
    for r in docs.collect():
        low = r["text"].encode().lower().decode()
        found = [(m.start(), m.end(), x) for x in rules for m in x.pattern.finditer(low)] + s.identifiers(low)
        at, base = s.phrases(low)
        assert got[r["doc_id"]]["labels"] == ",".join(sorted(base | {x.label for _, _, x in op2_licenses.settle(found)}))
        assert got[r["doc_id"]]["base_labels"] == ",".join(sorted(base)) and got[r["doc_id"]]["last_word"] == max(at, default=None)


ABLATION = {
    "insult": ("what a stupid clown", 1), "negation": ("you are not an idiot", 0), "reported": ("he said they are idiots", 0),
    "target": ("you zorb", 1), "threat": ("i will kill you", 1),
}


@pytest.mark.parametrize("part", ABLATION)
def test_each_transducer_decides(part):
    """Leaving a transducer out changes the verdict on a clause planted for it."""
    weights = {w + "$": op3_toxicity.SEED_WEIGHT for t in op3_toxicity.TABLES.values() for w in t["insult"].split()} | {"zorb$": 1.0}
    clause, want = ABLATION[part]
    verdict = lambda g: int(sum(g.clauses(clause)[0]) >= 1.2)
    assert verdict(op3_toxicity.Grammar(weights)) == want != verdict(op3_toxicity.Grammar(weights, without=(part,)))


CLAUSES = {
    "You aren't an idiot": 0, "she isn't really a moron": 0, "not stupid but a loser": 1, "I said you are an idiot": 1, "He said you are an idiot, but they are morons": 1,
    "i will not kill you": 0, "you will die": 1, "kill them": 1, "they burn wood": 0, "ich werde dich töten": 1, "du bist kein idiot": 0, "tu n'es pas un idiot": 0,
    "je vais te tuer": 1, "voy a matarte": 1, "no voy a matarte": 0, "dijo que va a matarte": 0, "eres un idiota": 1, "an idiot said nothing": 1, "you'll die": 1, "the ship will die": 0,
    "no, you idiot": 1, "not today, you idiot": 1, "you are not a moron, idiot or loser": 0, "kill the process you started": 0, "kill all of you": 1,
    "wolves kill, you see": 0, "he said they will not kill you": 0, "you, idiot": 1,
}


def test_clauses():
    weights = {w + "$": op3_toxicity.SEED_WEIGHT for t in op3_toxicity.TABLES.values() for w in t["insult"].split()}
    g = op3_toxicity.Grammar(weights)
    assert {c: int(sum(g.clauses(c)[0]) >= 1.2) for c in CLAUSES} == CLAUSES


def test_toxicity_edges(spark, docs, labels):
    model = op3_toxicity.learn(docs, labels)
    got = op3_toxicity.scored(clash(docs), model, keep_text=True)
    assert got.columns.count("score") == 1 and got.count() == len(ROWS)
    assert op3_toxicity.scored(docs.limit(0), model).collect() == []
    assert model.scores([None]) == model.scores([""]) and op3_toxicity.learn(docs, labels.limit(0)).scores([None, "idiot"]).tolist() == [0, 0]
    assert model.scores(["idiot. " * 200_000])[0] >= model.scores(["idiot"])[0]


def test_rules_learn_conjunctions(spark):
    """Bad documents have many symbols and many digits; either alone is good. The verdict is measured on rows not learned from."""
    rng, rows, lab = random.Random(9), [], []
    for i in range(900):
        symbols, digits = rng.random() < 0.5, rng.random() < 0.5
        w = ["".join(chr(97 + rng.randint(0, 25)) for _ in range(6)) for _ in range(40)]
        if symbols:
            w = [x[:-1] + "#" if k % 3 == 0 else x for k, x in enumerate(w)]
        if digits:
            w = [x[:-2] + "77" if k % 3 == 1 else x for k, x in enumerate(w)]
        rows.append((i, " ".join(w)))
        lab.append((i, int(not (symbols and digits))))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, quality int")
    rules = op4_rules.learn(docs, labels.filter("doc_id % 3 <> 0"))
    assert rules and any(len(r) > 1 for r in rules)
    f = op4_rules.features(docs).withColumn("rule", op4_rules.verdict(rules)).filter("doc_id % 3 = 0").join(labels, "doc_id").toPandas()
    assert ((f.rule == 0) == (f.quality == 1)).mean() > 0.97


def test_rules_edges(spark, docs, labels):
    got = op4_rules.features(clash(docs))
    assert len(got.columns) == len({c.lower() for c in got.columns}) and got.count() == len(ROWS)
    assert op4_rules.features(docs.limit(0)).collect() == []
    assert isinstance(op4_rules.learn(docs, labels), list) and op4_rules.learn(docs, labels.limit(0)) == []
    wide = op4_rules.features(spark.createDataFrame([(1, "a b c d e " * 3), (2, "a b c d e"), (3, "x " * 5), (4, "x " * 6)], "doc_id long, text string"))
    assert {r["doc_id"]: r["n_repeat_words"] for r in wide.collect()} == {1: 15, 2: 0, 3: 0, 4: 6}


def test_language_edges(spark, docs):
    names, table = op5_langid.learn(docs)
    assert names == ["en", "de"] or set(names) == {"en"} or names
    got = op5_langid.predict(clash(docs), names, table)
    assert got.columns.count("lang_pred") == 1 and got.columns.count("score") == 1 and got.count() == len(ROWS)
    assert {r["lang_pred"] for r in got.filter("doc_id = 4 or doc_id = 2").collect()} == {"und"}
    assert op5_langid.predict(docs.limit(0), names, table).collect() == []


def test_decontamination_rows(spark):
    item = " ".join(f"q{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, "alone"), (3, None)], "item_id long, text string")
    rows = [(5, f"X, {item}!"), (5, f"X, {item}!"), (5, "clean words only"), (None, item.upper()), (None, None), (6, "ALONE; or not"), (7, LONG + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"c": F.lit(1), "_h": F.lit(2), "win": F.lit(3), "spans": F.lit(4)})
    got = sorted(((r["doc_id"] or 0), r["n_hit"], r["contaminated"]) for r in op6_decontam.report(op6_decontam.hits(docs, bench)).collect())
    assert got == [(0, 0, False), (0, 15, True), (5, 0, False), (5, 15, True), (5, 15, True), (6, 1, True), (7, 15, False)]
    kept = op6_decontam.cleaned(docs, bench)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 5, 7]
    cut = {(r["doc_id"], r["text"]) for r in op6_decontam.cleaned(docs, bench, documents=False).collect() if r["doc_id"] != 7}
    assert cut == {(5, "X, " + " " * 14 + "!"), (5, "clean words only"), (None, " " * 14), (None, None), (6, "; or not")}


def test_decontamination_beyond_a_broadcast(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    few = sorted(map(str, op6_decontam.report(op6_decontam.hits(docs, bench)).collect()))
    monkeypatch.setattr(op6_decontam, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(op6_decontam, "LEAST_BITS", 64)
    monkeypatch.setattr(op6_decontam, "MOST_BITS", 64)
    assert sorted(map(str, op6_decontam.report(op6_decontam.hits(docs, bench)).collect())) == few


def test_mix_edges(spark, docs, monkeypatch):
    got = sorted(map(str, op8_mix.mix(clash(docs)).collect()))
    assert len(got) == len(ROWS) and got == sorted(map(str, op8_mix.mix(docs.repartition(3)).collect()))
    monkeypatch.setattr(op8_mix, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, op8_mix.mix(docs).collect())) == got
    assert {r["target"] for r in op8_mix.mix(docs.filter("doc_id = 2")).collect()} == {0.0}


class _Cluster:
    """A session of a cluster without a checkpoint folder."""

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class conf:
        @staticmethod
        def get(name, default):
            return default


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        ensure_checkpoint_dir(_Cluster)


def test_equal_rows_are_dealt_apart(spark, tmp_path, monkeypatch):
    """A passage repeated in 400 equal rows without ids goes from each, and the rows lie in many groups."""
    text = " ".join(f"w{i}" for i in range(40))
    spark.createDataFrame([(None, text)] * 400 + [(1, "short text")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(op9_substrings, "groups_for", lambda *_: 16)
    sizes = []
    deal = op9_substrings.dealt
    monkeypatch.setattr(op9_substrings, "dealt", lambda *a: sizes.append(deal(*a)) or sizes[0])
    got = op9_substrings.repeated_passages(spark.read.parquet(str(tmp_path / "d")), digest=True).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in got) == [(2, 0)] + [(40, 40)] * 400
    assert max(r["count"] for r in sizes[0].groupBy("g").count().collect()) < 80


def test_one_repeated_id_does_not_swell_the_sample(spark):
    from lodestone.llm.common import label_sample

    rows = [(7, 1)] * 5000 + [(None, 1)] * 500 + [(i, i % 2) for i in range(100, 140)] + [(3, None), (4, 5)]
    some, counts = label_sample(spark.createDataFrame(rows, "k long, y int"), {0: 4000, 1: 4000})
    assert counts == {0: 20, 1: 21} and some.count() == 41
