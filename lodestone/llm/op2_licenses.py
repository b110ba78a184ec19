"""License scans by ordered signature rules.

A rule (license_rules.py) is a regular expression on the text in lower case (A-Z), a keyword without which it can't match, a
priority and a label. One Aho-Corasick pass finds the keywords of a text, and only the rules of those are run. Detections are
then settled in order of priority (smaller first), length and place: one that lies inside a settled interval is suppressed;
intervals that merely overlap both stay. What is left gives the labels, and the strongest gives the score. A line with
`SPDX-License-Identifier:` comes before all rules: each identifier of its expression is a detection, `+` meaning or-later.

The base phrases are counted apart from the rules, over the words of the text; their labels always stay.

Defined cases: null and empty texts have no words, places or labels (empty strings, score 0); a phrase is found wherever
its words stand next to each other, whatever stands between them that is no word; of detections with one interval the one of
the first rule stays; repeated rows are documents of their own; a null id is kept; very long texts are read whole; other columns
are kept, but those named like a result (case does not count) are replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import WORD, plain, read
from .license_rules import IDENTIFIERS, RULES

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: What may stand between two words of a signature, and the macros of the rules.
_G = r"[\s,;:()\"'*#/_-]{0,12}"
_MACROS = {"{v}": r"(?:version|ver\.?|v\.?)?\s{0,3}", "{l}": "licen[sc]e", "{later}": rf"{_G}or{_G}(?:\(at{_G}your{_G}option\){_G})?(?:any{_G})?later"}
_END = r"(?![\w]|\.\d)"
#: Labels that say less than a license does.
WEAK = frozenset(("copyright", "reserved", "creative-commons"))


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: str
    pattern: re.Pattern
    strength: float


def build_rules() -> list[Rule]:
    """The rules in the order of their table; number 0 is left to identifier lines."""
    rules = []
    for i, line in enumerate(RULES.strip().splitlines(), 1):
        label, keyword, words = (x.strip() for x in line.split(" | ", 2))
        body = words.replace(" ?", "\0").replace(" ", _G).replace("\0", "[ -]?")
        for macro, pattern in _MACROS.items():
            body = body.replace(macro, pattern)
        body = body.replace("$", _END)
        strength = 0.4 if label in WEAK else 0.95 if re.search(r"\d", label) else 0.8
        rules.append(Rule(i, label, keyword.replace("{l}", "licen"), re.compile(rf"(?<!\w)(?:{body})"), strength))
    return rules


def _first(keyword: str) -> str:
    """A keyword's longest word: gaps between its words may be anything."""
    return max(keyword.split(), key=len)


def settle(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """The detections that lie inside none that comes before them by priority, length and place; in order of place.

    For each start the tree knows the largest settled end of any start up to it."""
    found = sorted(found, key=lambda x: (x[2].priority, x[0] - x[1], x[0]))
    place = {a: i for i, a in enumerate(sorted({x[0] for x in found}), 1)}
    tree, kept = [-1] * (len(place) + 1), []
    for a, b, rule in found:
        i, end = place[a], -1
        while i:
            end, i = max(end, tree[i]), i & (i - 1)
        if end >= b:
            continue
        kept.append((a, b, rule))
        i = place[a]
        while i < len(tree):
            tree[i] = max(tree[i], b)
            i += i & -i
    return sorted(kept, key=lambda x: (x[0], x[1]))


SPDX = re.compile(r"spdx-license-identifier:[ \t]*([^\n]*)")
_NAME = re.compile(r"[a-z0-9][a-z0-9.+-]*")


class Scanner:
    def __init__(self):
        rules = build_rules()
        self.gate, by = ahocorasick.Automaton(), {}
        for r in rules:
            by.setdefault(_first(r.keyword), []).append(r)
        for k, some in by.items():
            self.gate.add_word(k, some)
        self.gate.add_word("spdx-license-identifier", "spdx")
        self.gate.make_automaton()
        self.known = {r.label for r in rules} | IDENTIFIERS
        self.words = re.compile(WORD)
        self.base = {tuple(k.split()): v for k, v in BASE.items()}

    def identifiers(self, low: str) -> list[tuple[int, int, Rule]]:
        """Detections of the identifiers of SPDX lines."""
        found = []
        for line in SPDX.finditer(low):
            for m in _NAME.finditer(low, line.start(1), line.end(1)):
                name = m[0][:-1] + "-or-later" if m[0].endswith("+") else m[0]
                if name in self.known or name.removesuffix("-or-later").removesuffix("-only") in self.known:
                    found.append((m.start(), m.end(), Rule(0, name, "", SPDX, 1.0)))
        return found

    def detect(self, low: str) -> list[tuple[int, int, Rule]]:
        """Settled detections in order of place."""
        found = []
        for rules in {id(r): r for _, r in self.gate.iter(low)}.values():
            if rules == "spdx":
                found += self.identifiers(low)
                continue
            for rule in rules:
                found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(low)]
        return settle(found)

    def phrases(self, low: str) -> tuple[list[int], set[str]]:
        """Starts of the base phrases, in words, and their labels."""
        hit = [(p, v) for p, v in self.base.items() if all(w in low for w in p)]
        if not hit:
            return [], set()
        w, at, labels = self.words.findall(low), [], set()
        for p, v in hit:
            i = -1
            while True:
                try:
                    i = w.index(p[0], i + 1)
                except ValueError:
                    break
                if tuple(w[i : i + len(p)]) == p:
                    at.append(i)
                    labels.add(v)
        return at, labels


#: Bytes of UTF-8 that belong to words.
_WORD_BYTE = np.array([chr(i).isalnum() or i >= 0x80 for i in range(128)] + [True] * 128)


def count_words(texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"\n" + b"\n".join(raw), np.uint8)
    is_word = _WORD_BYTE[buf]
    starts = np.flatnonzero(is_word[1:] & ~is_word[:-1]) + 1
    ends = np.cumsum([len(r) + 1 for r in raw])
    return np.diff(np.searchsorted(starts, np.append(0, ends)))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with the counts, labels, score and the settled detections (start and end in code points)."""
    docs = plain(docs, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner()
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
        for b in batches:
            texts = [t or "" for t in b[text].to_pylist()]
            rows = []
            for a in range(0, len(texts), 256):
                part = texts[a : a + 256]
                for t, n in zip(part, count_words(part), strict=True):
                    low = t.encode().lower().decode()
                    at, base = s.phrases(low)
                    got = s.detect(low)
                    labels = base | {r.label for _, _, r in got}
                    score = max([0.6 * bool(base), *(r.strength for _, _, r in got)])
                    rows.append((int(n), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [{"start": x, "end": y, "label": r.label} for x, y, r in got]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [*keep, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    kinds = dict(docs.dtypes)
    out = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<start:bigint,end:bigint,label:string>>"
    return docs.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], out]))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("detections")
