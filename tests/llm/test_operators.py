"""Operators against brute force on small inputs, and held-out quality on the small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import op1_quality, op2_licenses, op3_toxicity, op4_rules, op5_langid, op6_decontam, op7_chat, op8_mix, op9_substrings, op10_jaccard, packed

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 5)))
    passage = " ".join(word() for _ in range(60))
    out = [None, "", " \t\n", "one", "a b c d e", "A b c d E"]
    for i in range(40):
        w = [word() for _ in range(int(rng.integers(5, 160)))]
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = passage.split()
        if i % 5 == 0:
            w = w + w
        out.append(("\n" if i % 7 == 0 else " ").join(w))
    base = out[20].split()
    for k in range(6):
        near = list(base)
        near[(7 * k) % len(near)] = "changed"
        out.append(" ".join(near))
    return out + out[10:13]


def test_substrings_brute_force(spark, texts, monkeypatch):
    words = [TOKEN.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    for size in (8 << 20, 2000):  # one group; many groups
        monkeypatch.setattr(op9_substrings, "groups_for", lambda d, t, s=size: max(1, 20000 // s))
        got = {r["doc_id"]: r for r in op9_substrings.repeated_passages(documents(spark, texts), digest=True).collect()}
        for i, w in enumerate(words):
            gone = {p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
            kept = " ".join(x for p, x in enumerate(w) if p not in gone)
            assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_cover_aligns_any_two_places():
    for a in range(op9_substrings.PERIOD):
        for b in range(op9_substrings.PERIOD):
            assert any((a + k) % 21 in op9_substrings.COVER and (b + k) % 21 in op9_substrings.COVER for k in range(21))


def test_jaccard_brute_force(spark, texts, monkeypatch):
    sets = []
    for t in texts:
        w = TOKEN.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    for groups in (1, 9):
        monkeypatch.setattr(op10_jaccard, "groups_for", lambda d, t, g=groups: g)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op10_jaccard.near_duplicates(documents(spark, texts)).collect()}
        assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    assert op10_jaccard.near_duplicates(documents(spark, texts).limit(0)).count() == 0


def test_packed_keys_match_counts():
    rng = np.random.default_rng(1)
    sides = [np.unique(rng.integers(0, 60, 40).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(5)]
    blocks = pa.concat_tables([packed.forward(g, [k], 7) for g, k in enumerate(sides)])
    asked = Counter(int(x) for k in sides for x in k)
    for g, keys in enumerate(sides):
        replies = [packed.answer(blocks.filter(pa.compute.equal(blocks["range"], r)), 1) for r in range(7)]
        mine = pa.concat_tables([t.filter(pa.compute.equal(t["g"], g)) for t in replies])
        assert packed.counts_of(mine, [keys], 7).tolist() == [asked[int(x)] for x in keys]


def test_rule_features_brute_force(spark, texts):
    extra = ["# x\n# x\n\n y", "a a a a a a a a a a a a", None]
    got = {r["doc_id"]: r for r in op4_rules.features(documents(spark, [*texts, *extra])).collect()}
    for i, t in enumerate([*texts, *extra]):
        w, lines = TOKEN.findall(t or ""), [x for x in (t or "").split("\n") if TOKEN.search(x)]
        runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {p for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_rules_keep_good_documents(spark):
    folder = FOLDER.replace("0.001", "0.01")  # with enough bad documents to learn from
    p = op4_rules.op4_quality_rules(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    good, bad = p[p.quality == 1], p[p.quality == 0]
    assert good.kept.mean() > 0.9 and bad.kept.mean() < 0.2
    empty = spark.read.parquet(f"{FOLDER}/labels.parquet").limit(0)
    assert op4_rules.learn(spark.read.parquet(f"{FOLDER}/documents.parquet"), empty) == []


def test_quality_is_bayes(spark):
    out = op1_quality.op1_quality_classifier(spark, FOLDER)
    p = out.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").withColumn("held", op1_quality.fold(F.col("doc_id"))).toPandas()
    held = p[p.held]
    assert ((held.quality == 1) == held.kept).mean() > 0.85
    rows = [("a", "x", 0.9)] * 50 + [("b", "y", 0.1)] * 50 + [("c", "z", 0.0), (None, None, 0.5)]
    site = {r["host"]: r for r in op1_quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert abs(site["a"]["host_posterior"] - 0.9) < 0.02 and site["c"]["host_posterior"] > 0.0 and None in site


def test_license_scan(spark):
    t = ["Licensed under the Apache License, Version 2.0.", "x General  public-LICENSE all rights reserved cc by", None, "", "spdx-license-identifier: mit", "smit license", "cc by\n" * 2000]
    got = {r["doc_id"]: r for r in op2_licenses.scan(documents(spark, t)).collect()}
    assert got[0]["labels"] == "apache-2.0" and got[0]["n_base"] == 0 and got[0]["first_word"] is None and got[0]["n_words"] == 8
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 1, 7, "cc-by,gpl,reserved")
    assert got[2]["labels"] == "" and got[2]["n_words"] == 0 and got[2]["score"] == 0 and got[3]["n_words"] == 0
    assert got[4]["labels"] == "mit" and got[5]["labels"] == "" and got[6]["n_base"] == 2000
    assert len(op2_licenses.build_rules()) > 200


def test_license_base_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r["doc_id"]: r for r in op2_licenses.op2_license_scan(spark, FOLDER).collect()}
    for r in docs.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r["text"].translate({i: i + 32 for i in range(65, 91)}))
        at = [i for i in range(len(w)) for p in op2_licenses.BASE if w[i : i + len(p.split())] == p.split()]
        assert (got[r["doc_id"]]["n_words"], got[r["doc_id"]]["n_base"], got[r["doc_id"]]["first_word"]) == (len(w), len(at), min(at, default=None))


def test_overlaps_are_settled():
    found = op2_licenses.Scanner().detect("gnu lesser general public license, version 2.1 and the mit license")
    assert [r.label for _, _, r in found] == ["lgpl-2.1", "mit"]


def test_toxicity_held_out(spark):
    folder = FOLDER.replace("0.001", "0.1")
    p = op3_toxicity.op3_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    for lang, q in p.groupby("lang"):
        hit = ((q.toxic == 1) & (q.predicted == 1)).sum()
        assert hit >= 0.85 * (q.toxic == 1).sum() and hit >= 0.9 * (q.predicted == 1).sum(), lang


def test_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    p = op5_langid.op5_language_id(spark, FOLDER).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (p.lang == p.lang_pred).mean() > 0.95
    names, table = op5_langid.learn(docs)
    got = [r["lang_pred"] for r in op5_langid.predict(documents(spark, [None, "", "12 3", "the and of"]), names, table).orderBy("doc_id").collect()]
    assert got[:3] == ["und"] * 3 and got[3] == "en"
    assert op5_langid.learn(docs.limit(0))[0] == []


def test_decontamination_edges(spark):
    long = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, long), (2, "Short, item!"), (3, None), (4, "..."), (5, long)], "item_id long, text string")
    docs = documents(spark, [None, "", f"x {long} y", "a short ITEM b short item", "w0 w1 w2"])
    got = {r["doc_id"]: r for r in op6_decontam.report(op6_decontam.hits(docs, bench)).collect()}
    assert [got[i]["n_hit"] for i in range(5)] == [0, 0, 20, 4, 0]
    assert got[2]["items"] == ["1", "5"] and got[3]["items"] == ["2"] and got[3]["contaminated"] and not got[0]["contaminated"]
    assert {r["n_hit"] for r in op6_decontam.report(op6_decontam.hits(docs, bench.limit(0))).collect()} == {0}
    nameless = spark.createDataFrame([(None, long), (None, "a short"), (7, long)], "item_id long, text string")
    got = {r["doc_id"]: r for r in op6_decontam.report(op6_decontam.hits(docs, nameless)).collect()}
    assert [(got[i]["n_hit"], got[i]["n_items"], got[i]["items"]) for i in (2, 3, 4)] == [(20, 2, ["7"]), (2, 1, []), (0, 0, [])]


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a<|im_end|>~1"), (1, 1, "user", "b~0<|"), (1, 2, None, None), (1, 100, "assistant", "x\n<"), (1, 101, "assistant", "y"), (None, 0, "a\nb~", "t"), (2, None, "user", "n"), (2, 0, "user", "n"), (2, 0, "user", "n")]
    back = op7_chat.parse_chats(op7_chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in back.collect()}
    assert got == {1: [("user", "a<|im_end|>~1"), ("user", "b~0<|"), ("", ""), ("assistant", "x\n<"), ("assistant", "y")], None: [("a\nb~", "t")], 2: [("user", "n")] * 3}
    text = next(r["formatted"] for r in back.collect() if r["conv_id"] == 1)
    assert text.count("<|im_start|>user") == 1 and text.count(op7_chat.END) == 3


def test_loss_mask(spark):
    texts = ["a<|im_sep|>~", "", "\u2603 x\n", "<|im_end|>", "b"]
    rows = [(c, i, ["assistant", "user", "assistant", "assistant", "tool"][(i * (c + 1)) % 5], f"{texts[i % 5]}{i}" if i % 7 else None) for c, n in enumerate((1, 5, 64, 65, 300)) for i in range(n)]
    rows += [(9, 0, "user", "none"), (10, 0, None, "x")]
    chats = op7_chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in chats.select("*", op7_chat.under(F.col("formatted"), F.col("loss")).alias("learnt")).collect():
        mine = [x[3] or "" for x in rows if x[0] == r["conv_id"] and x[2] == "assistant"]
        escaped = [x.replace("~", "~0").replace("<|", "<~1|") for x in mine]
        assert [r["formatted"][s["start"] : s["start"] + s["len"]] for s in r["loss"]] == escaped
        assert r["learnt"] == "".join(mine)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op7_chat.parse_chats(op7_chat.format_chats(none)).collect() == []
    wide = spark.createDataFrame([(1, 0, "assistant", "x", 1, 2, 3)], "conv_id long, turn long, role string, text string, loss int, formatted int, messages int")
    assert op7_chat.format_chats(wide).collect()[0]["loss"] == [(len("<|im_start|>assistant\n"), 1)]


def test_mix_meets_targets(spark, texts):
    docs = documents(spark, texts * 5)
    got = op8_mix.mix(docs).toPandas()
    assert len(got) == docs.count() and (got.taken <= 3 * got["size"]).all()
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in got.itertuples():
        x = by[r.source_size]
        x[0], x[1], x[2] = x[0] + r.taken, r.target, max(x[2], r.size)
    for taken, target, largest in by.values():
        assert abs(taken - target) <= largest
    assert sorted(map(tuple, op8_mix.mix(docs.repartition(5)).toPandas().values.tolist()), key=str) == sorted(map(tuple, got.values.tolist()), key=str)
    assert op8_mix.mix(docs.limit(0)).count() == 0


def test_set_sums_are_exact():
    import random

    words = [f"w{i}" for i in range(400)]
    first = " ".join(words)
    alone = op10_jaccard.Sets(pa.chunked_array([[first]]))
    after = op10_jaccard.Sets(pa.chunked_array([[" ".join(random.Random(1).choices(words, k=3000)), first]]))
    assert [x[0] for x in alone.sums] == [x[1] for x in after.sums]
    assert int(alone.sums[0].view(np.uint64)[0]) == sum(int(v) for v in packed.mix(alone.hash ^ np.uint64(0x5851F42D4C957F2D))) % 2**64
