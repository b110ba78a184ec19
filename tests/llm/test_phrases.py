"""op11 against brute force: one and many ranges, broadcast and joined dictionaries, ties, nulls, very frequent phrases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import op11_phrases

AZ = {i: i + 32 for i in range(65, 91)}


def texts():
    rng = np.random.default_rng(5)
    word = lambda: str(rng.choice(["a", "b", "C", "é", "a\x01", "ab", "New", "york", "city", "x|y", " ", "the"]))
    out = [None, "", " \t", ".", "New York city", "NEW york\ncity", "x x x x x x x x", "the the the. the the"]
    for i in range(60):
        body = [word() for _ in range(int(rng.integers(1, 60)))]
        if i % 2:
            body[len(body) // 2 : len(body) // 2] = "new york city hall".split()
        out.append("".join(w + str(rng.choice([" ", " ", " ", "\t", ", ", "\x0b", "!  "])) for w in body))
    return out + ["zebra stripes " * 40] * 3


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(rows_)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("range_keys", "dict_bytes", "step"), [(1 << 20, 1 << 20, 8 << 20), (50, 1 << 20, 300), (40, -1, 200), (1 << 20, -1, 8 << 20)])
def test_brute_force(spark, monkeypatch, range_keys, dict_bytes, step):
    monkeypatch.setattr(op11_phrases, "RANGE_KEYS", range_keys)
    monkeypatch.setattr(op11_phrases, "DICT_BYTES", dict_bytes)
    monkeypatch.setattr(op11_phrases, "STEP", step)
    rows = [(t, ["en", "de", None, "en"][i % 4]) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(*r, 7, 7, 7) for r in rows], "text string, lang string, n int, word int, r int").repartition(3)
    for least, top in ((3, 2000), (5, 7)):
        got = sorted(map(tuple, op11_phrases.collocations(docs, least, top).collect()))
        assert got == brute(rows, least, top) and len(got) > 15


def test_radix_and_runs():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 3, (500, 5)).astype(np.uint32) * np.uint32(70000)
    assert (keys[op11_phrases.radix(keys)] == np.array(sorted(map(tuple, keys)))).all()
    distinct, n = op11_phrases.runs(keys, np.ones(500, np.uint32))
    assert {tuple(k): c for k, c in zip(distinct, n, strict=True)} == Counter(map(tuple, keys))


def test_empty(spark):
    docs = spark.createDataFrame([(None, None), ("one two three", "en")], "text string, lang string")
    assert op11_phrases.collocations(docs).collect() == []
    assert op11_phrases.collocations(docs.limit(0)).collect() == []
