"""Substring dedup and the Jaccard join against brute force on the inputs that break exchanges of keys."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import op9_substrings, op10_jaccard, packed

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(11)


def prose(n, seed=None):
    r = RNG if seed is None else np.random.default_rng(seed)
    return " ".join(f"w{r.integers(0, 5000)}" for _ in range(n))


def thue_morse(bits, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(1 << bits))


BASE = prose(34, 5)
LONG, NEAR = prose(80, 6), prose(80, 6).rsplit(" ", 1)[0]
CASES = {
    "nothing repeats": [(1, prose(50, 1)), (2, prose(50, 2))],
    "only empty texts": [(1, None), (2, ""), (3, " \n\t")],
    "null ids": [(None, LONG), (None, LONG), (None, NEAR), (4, prose(60, 9)), (None, None)],
    "near copies of a null id": [(None, LONG), (7, NEAR), (9, NEAR + " x")],
    "repeated rows": [(5, LONG), (5, LONG), (6, prose(40, 3)), (6, prose(40, 4))],
    "one row": [(1, LONG + " " + LONG)],
    "shorter than a window": [(1, "a b"), (2, "a b"), (3, "A B"), (4, "a")],
    "crafted words": [(1, f"{BASE} {thue_morse(11, 0)}"), (2, f"{BASE} {thue_morse(11, 1)}"), (3, thue_morse(10, 0)), (4, thue_morse(10, 1))],
    "one very long word": [(1, "x" * 3_000_000), (2, "x" * 3_000_000), (3, "x" * 2_999_999 + "y")],
    "a very long text": [(1, " ".join(str(i) for i in range(300_000))), (2, " ".join(str(i) for i in range(1000, 1100)))],
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def cut_texts(rows):
    words = [TOKEN.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = {p for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def components(rows):
    sets = []
    for _, t in rows:
        w = TOKEN.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    part[i] = part[j] = min(part[i], part[j])
    least = {p: min((rows[i][0] for i in range(len(rows)) if part[i] == p and rows[i][0] is not None), default=None) for p in part}
    return Counter((rows[i][0], len(sets[i]), least[part[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("groups", [1, 7])
def test_substrings(spark, monkeypatch, case, groups):
    monkeypatch.setattr(op9_substrings, "groups_for", lambda d, t: groups)
    got = op9_substrings.repeated_passages(frame(spark, CASES[case]), digest=True).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == cut_texts(CASES[case])


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("groups", [7])
def test_jaccard(spark, monkeypatch, case, groups):
    monkeypatch.setattr(op10_jaccard, "groups_for", lambda d, t: groups)
    got = op10_jaccard.near_duplicates(frame(spark, CASES[case])).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components(CASES[case])


def test_jaccard_splits_long_lists(spark, monkeypatch):
    """Chains of near copies, unlike texts with one rare passage in common, and copies, in blocks of two members."""
    rows, shared = [], prose(12, 21)
    for k in range(12):
        w = prose(40, 100 + k % 3).split()
        w[k % 40] = f"changed{k}"
        rows.append((k, " ".join(w)))
    rows += [(50 + k, f"{shared} {prose(9 + k, 300 + k)}") for k in range(15)] + [(80 + k, rows[0][1]) for k in range(5)]
    for block in (2, 1000):
        monkeypatch.setattr(op10_jaccard, "BLOCK", block)
        got = op10_jaccard.near_duplicates(frame(spark, rows)).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components(rows)


def test_clashing_columns(spark):
    """Columns named like internal ones are kept; those named like a result are replaced."""
    d = spark.createDataFrame([(1, LONG, "a", "b", 3, 4), (2, LONG, "c", "d", 5, 6)], "doc_id long, text string, g string, stage string, N_WORDS int, n_removed int")
    got = op9_substrings.repeated_passages(d)
    assert sorted(got.columns) == ["doc_id", "g", "n_removed", "n_words", "stage", "text"]
    assert {(r["g"], r["stage"], r["n_words"], r["n_removed"], r["text"]) for r in got.collect()} == {("a", "b", 80, 80, ""), ("c", "d", 80, 80, "")}
    e = d.withColumnsRenamed({"g": "core", "stage": "n_shingles", "n_removed": "component_id"})
    assert {tuple(r) for r in op10_jaccard.near_duplicates(e).collect()} == {(1, 76, 1), (2, 76, 1)}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert op9_substrings.repeated_passages(none).collect() == [] and op10_jaccard.near_duplicates(none).collect() == []


def test_words_are_hashed_apart():
    """Equal words have equal hashes wherever they stand; unlike ones do not, long ones included."""
    words = ["a", "b", "ab", "ba", "aa", "x" * 63, "x" * 64, "x" * 65, "x" * 200, "x" * 199 + "y", "y" + "x" * 199, thue_morse(10, 0), thue_morse(10, 1)]
    for seed in (0, 1):
        first = packed.Words(pa.array([" ".join(words)]), seeds=2).hashes[seed]
        again = packed.Words(pa.array(["lead", " ".join(reversed(words))]), seeds=2).hashes[seed]
        assert len(set(first.tolist())) == len(words) and first.tolist() == again[1:].tolist()[::-1]


def test_join_runs_few_tasks_for_small_frames(spark):
    """The driver remembers every task: small frames of the rounds are no task a shuffle partition each."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    rows = [(i, " ".join(f"w{(i // 4) * 50 + j}" for j in range(40)) + f" x{i}") for i in range(40)]
    sc = spark.sparkContext
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sc.setJobGroup("few-tasks", "op10")
        got = {r["doc_id"]: r["component_id"] for r in op10_jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {i: i // 4 * 4 for i in range(40)}
    assert tasks < 60 * 24, tasks  # a checkpoint a round: 1789
