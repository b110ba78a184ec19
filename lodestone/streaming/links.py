"""The dependency graph kept by changes: what a file imports is state of its path, and a batch gives only the links that differ.

linked() keys a stream of file changes by path. The state of a path is the sorted list of the targets that it imports; a change
gives the targets that are new (+1) and those that are gone (-1), an unlink takes all. So what a batch reads and writes follows
from the changed files, not from the project. fold() sums the differences into the links that stand; whether a target is there is
asked when edges are read, so that a file which comes later is linked to those that have waited for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEPS = "src string, target string, step int, seq long"


def steps_of(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one path (path, type, seq, targets), the last by seq counts: the differences to what the state has."""
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    last = rows.iloc[-1]
    before = set(state.get[0]) if state.exists else set()
    now = set() if last["type"] == "unlink" else {t for t in last["targets"] if t is not None}
    if now:
        state.update((sorted(now),))
    elif state.exists:
        state.remove()
    out = [(key[0], t, 1, int(last["seq"])) for t in sorted(now - before)] + [(key[0], t, -1, int(last["seq"])) for t in sorted(before - now)]
    yield pd.DataFrame(out, columns=["src", "target", "step", "seq"])


def linked(changes: DataFrame) -> DataFrame:
    """changes: a stream of path, type, seq and targets (array of strings; null: none). Gives src, target, step and seq."""
    rows = changes.select("path", "type", "seq", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))
    return rows.groupBy("path").applyInPandasWithState(steps_of, STEPS, "targets array<string>", "append", GroupStateTimeout.NoTimeout)


def fold(steps: DataFrame) -> DataFrame:
    """src and target of the links that stand after all steps."""
    return steps.groupBy("src", "target").agg(F.sum("step").alias("n")).filter("n > 0").select("src", "target")


def standing(links: DataFrame, files: DataFrame, candidates: tuple[str, ...]) -> DataFrame:
    """src and dst: links whose target, with the first ending that fits, is among files(path)."""
    forms = links.select("src", "target", F.posexplode(F.array(*[F.concat("target", F.lit(c)) for c in candidates])).alias("ord", "dst"))
    hit = forms.join(files.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi")
    return hit.groupBy("src", "target").agg(F.min_by("dst", "ord").alias("dst")).select("src", "dst").distinct()
