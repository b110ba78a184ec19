"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols (insult, threat verb, will, target, self, negation, reporting verb, contrast, comma) by tables of the
text's language. Five transducers rewrite the symbols of a clause, each reading what the one before has written:

* target: an insult within reach of a person, on either side, becomes aimed (one transducer reads from the right, one from the left);
* negation: insults and threats within reach of a negation become negated, until a contrast (`but`), a comma right after it
  (`no, you ...`), or a comma with a person behind it (`not today, you ...`); other commas part the members of a list;
* reported speech: after somebody else's verb of saying they become reported, until a contrast;
* threat: target and `will` in either order + threat verb, or threat verb + target (with none but filling words between
  them: `kill all of you`, not `kill the process you started`), or a deed that holds both becomes a menace;
* insult: emits the weight of what is left, by the marks that it bears.

All that read from the left are composed into one machine, so that a clause is one walk. A clause's score is the sum of
its matches, CLAUSE_CAP at most; clauses, not words, make the features of a text.

The insult lexicon is learned: word stems (prefixes of STEMS characters, and whole words, written with a final $) that are
more usual in toxic documents, by log odds of MIN_WEIGHT at least and a likelihood ratio that allows for the number of stems
tried, a prefix only if many words share it. A word takes the stem of the largest weight. Fixed insults of the tables count
with SEED_WEIGHT unless the labels speak against them. How a text's features make a score is a logistic regression, shifted so
that PREDICT is the threshold with the best F1 on the labelled rows it was fitted to.

The fit uses at most about SAMPLE documents a class, chosen by a hash of the id; scoring reads whole texts.

Defined cases: null and empty texts have no evidence and get the score of that; null labels and labels without a document are
not learned from; repeated label rows count once, and of documents that share an id the regression
takes the one of the least features; without labels of both classes every score is 0; rows with a null id are
scored, never learned from; ties between languages go to the first of TABLES; very long texts are read whole, clause by clause;
other columns are kept, but one named score (case does not count) is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, label_sample, plain, read

#: Toxic and other documents to fit on, about.
SAMPLE = {1: 4000, 0: 8000}
STEMS = range(3, 9)
MIN_SUPPORT, MIN_WEIGHT, SEED_WEIGHT = 3, 1.5, 3.0
#: Chance of a false stem among all that are tried.
MISTAKE = 0.05
#: A prefix stands for a family of words: of so many kinds at least, of which no one makes up more than this share.
MIN_KINDS, MOST_ONE = 4, 0.6
CLAUSE_CAP, PREDICT = 12.0, 0.7
CLAUSE = re.compile(r"[.!?;:\n]+")
_LETTER = r"[^\x00-\x40\x5b-\x60\x7b-\x7f]"
WORD = re.compile(rf"{_LETTER}+(?:'{_LETTER}+)*")
TOKEN = re.compile(f"{WORD.pattern}|,")

#: Words by symbol and language; how many of them a text has tells its language, for which `common` has more. doom is a target and `will` in one word, deed a threat verb and
#: its target; fill may stand between a threat verb and its target.
TABLES = {
    "en": {
        "common": "the and of to in that is on for with this it was are a i you be have will he she they them",
        "insult": "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown jerk bastard asshole bitch dumbass imbecile vermin filth",
        "threat": "kill hurt destroy beat die burn shoot stab punch strangle murder smash",
        "will": "will gonna going shall should must deserve deserves wish i'll we'll they'll",
        "doom": "you'll you'd",
        "target": "you your yours yourself you're u ur they them their they're he him his she her he's she's",
        "self": "i we i'm we're i've we've",
        "neg": "not no never neither nor isn't aren't wasn't weren't don't doesn't didn't won't can't cannot couldn't wouldn't shouldn't haven't hasn't ain't without hardly nobody",
        "report": "said says say saying wrote writes claimed claims called calls quoted quotes reported reports tweeted posted told tells shouted",
        "but": "but however although though yet",
        "fill": "all both each every of the hell out up down",
    },
    "de": {
        "common": "der die das und ist von mit den ein eine zu im auf",
        "insult": "idiot idioten dumm dumme blöd arschloch depp trottel abschaum versager wichser erbärmlich",
        "threat": "töten umbringen schlagen zerstören verbrennen sterben verletzen erschießen erwürgen verprügeln",
        "will": "werde werden wirst sollst solltest soll will muss musst",
        "target": "du dich dir dein deine deinen ihr euch euer eure sie ihn ihm er",
        "self": "ich wir",
        "neg": "nicht kein keine keinen keiner nie niemals ohne weder noch",
        "report": "sagte sagt sagten schrieb schreibt nannte nennt behauptet behauptete meinte rief",
        "but": "aber jedoch sondern doch obwohl",
        "fill": "alle alles",
    },
    "fr": {
        "common": "le la les de et des un une est que dans pour en",
        "insult": "idiot idiote imbécile connard conne débile crétin ordure salaud abruti minable",
        "threat": "tuer frapper détruire brûler mourir blesser étrangler poignarder crever",
        "will": "vais vas va allons allez doit dois devrais mérites",
        "target": "tu te toi ton ta tes vous votre vos il elle ils elles lui leur",
        "self": "je j nous",
        "neg": "pas jamais aucun aucune sans ni point",
        "report": "dit disait dis écrit écrivait appelé appelle prétend prétendait affirme raconte",
        "but": "mais cependant pourtant",
        "fill": "tous toutes à",
    },
    "es": {
        "common": "el la los las de que y en un una es por con del",
        "insult": "idiota idiotas estúpido estúpida imbécil cabrón basura escoria payaso gilipollas inútil",
        "threat": "matar golpear destruir quemar morir herir apuñalar estrangular",
        "deed": "matarte mataros matarlo matarla matarlos quemarte quemaros golpearte golpearos herirte apuñalarte estrangularte destruirte",
        "will": "voy vas va vamos debes deberías mereces",
        "target": "tú te ti tu tus usted ustedes vosotros él ella ellos ellas le les",
        "self": "yo nosotros",
        "neg": "no nunca jamás ni sin ningún ninguna tampoco",
        "report": "dijo dice dijeron escribió escribe llamó llama afirmó afirma contó gritó",
        "but": "pero sino aunque",
        "fill": "a todos todas",
    },
}
SYMBOLS = ("word", "insult", "threat", "will", "doom", "target", "self", "neg", "report", "but", "deed", "fill", "comma")
LIVE = ("insult", "threat", "deed")


class Transducer:
    """A deterministic transducer: arcs[state, symbol] is (state, written symbol); where there is none the state's rest arc
    is taken and the symbol is written as it was read. Symbols bear marks, as in insult/aimed: arcs are looked up by the whole
    symbol, then by its base."""

    def __init__(self, start, arcs: dict, rest: dict):
        self.start, self.arcs, self.rest = start, arcs, rest

    def step(self, state, symbol: str):
        for key in (symbol, symbol.split("/")[0]):
            if (state, key) in self.arcs:
                to, write = self.arcs[state, key]
                return to, symbol if write is None else write if "/" not in write or write[0] != "/" else symbol + write
        return self.rest.get(state, state), symbol


class Composed:
    """What the second transducer makes of what the first one writes."""

    def __init__(self, first, second):
        self.first, self.second, self.start = first, second, (first.start, second.start)

    def step(self, state, symbol: str):
        a, written = self.first.step(state[0], symbol)
        b, written = self.second.step(state[1], written)
        return (a, b), written


def compose(machines: list):
    out = machines[0]
    for m in machines[1:]:
        out = Composed(out, m)
    return out


def scope(openers: list[str], reach: int, mark: str, closers: list[str] = (), marked: tuple[str, ...] = LIVE) -> Transducer:
    """Marks what stands within so many words after an opener, up to a closer. A comma is no word."""
    arcs, rest = {}, {k: k - 1 for k in range(1, reach + 1)} | {0: 0}
    for k in range(reach + 1):
        arcs |= {(k, o): (reach, None) for o in openers} | {(k, c): (0, None) for c in closers} | {(k, "comma"): (k, None)}
        if k:
            arcs |= {(k, m): (k - 1, f"/{mark}") for m in marked}
    return Transducer(0, arcs, rest)


def negation() -> Transducer:
    """From the state after a comma only what a list could go on with is still negated."""
    reach = 4
    inside = scope(["neg"], reach, "negated", ["but"])
    arcs, rest = dict(inside.arcs), dict(inside.rest)
    for k in range(1, reach):
        paused = f"comma{k}"
        arcs |= {(paused, symbol): to for (state, symbol), to in inside.arcs.items() if state == k}
        arcs |= {(paused, "insult"): (reach - 1, "/negated")}  # the list goes on, and its next member is as near
        arcs |= {(paused, person): (0, None) for person in ("target", "doom", "self")}
        arcs |= {(paused, "comma"): (paused, None), (k, "comma"): (paused, None)}
        rest[paused] = k - 1
    return Transducer(0, arcs | {(reach, "comma"): (0, None)}, rest)


def target() -> Transducer:
    return scope(["target", "doom"], 4, "aimed", marked=("insult",))


def target_after() -> Transducer:
    """To be run from the right."""
    return scope(["target", "doom"], 2, "aimed", marked=("insult",))


def reported() -> Transducer:
    """own: nobody is quoted; self: the verb of saying would be the writer's; said: somebody is quoted."""
    arcs = {("own", "self"): ("self", None), ("own", "report"): ("said", None), ("self", "report"): ("own", None), ("said", "but"): ("own", None)}
    arcs |= {("said", m): ("said", "/reported") for m in LIVE} | {("self", "comma"): ("self", None)}
    return Transducer("own", arcs, {"self": "own"})


def threat() -> Transducer:
    """who3..1: a person; will3..1: something will be done; doom3..1: a person will. Other words use up reach. act5..1: the deed
    is named and said5..1: as somebody's words; only filling words keep these open, and a comma ends them."""
    tops = {"who": 3, "will": 3, "doom": 3, "act": 5, "said": 5}
    states = {name: [f"{name}{k}" for k in range(1, top + 1)] for name, top in tops.items()}
    arcs, rest = {}, {"idle": "idle"}
    for name, of in states.items():
        down = dict(zip(of, ["idle", *of], strict=False))
        rest |= {x: "idle" for x in of} if name in ("act", "said") else down
        arcs |= {(x, "fill"): (down[x], None) for x in of} if name in ("act", "said") else {(x, "comma"): (x, None) for x in of}
    for state in rest:
        arcs |= {(state, "target"): ("who3", None), (state, "will"): ("will3", None), (state, "doom"): ("doom3", None), (state, "threat"): ("act5", None)}
        arcs |= {(state, "threat/reported"): ("said5", None), (state, "deed"): ("who3", "menace"), (state, "deed/reported"): ("who3", "menace/reported")}
        arcs |= {(state, f"{verb}/negated{more}"): ("idle", None) for verb in ("threat", "deed") for more in ("", "/reported")}
    arcs |= {(x, "will"): ("doom3", None) for x in states["who"]} | {(x, "target"): ("doom3", None) for x in states["will"]}
    arcs |= {(x, "threat"): ("idle", "menace") for x in states["doom"]} | {(x, "threat/reported"): ("idle", "menace/reported") for x in states["doom"]}
    arcs |= {(x, "target"): ("who3", "menace") for x in states["act"]} | {(x, "target"): ("who3", "menace/reported") for x in states["said"]}
    return Transducer("idle", arcs, rest)


#: Share of a word's weight that the insult transducer emits, by mark, and what a menace weighs.
FACTORS = {"plain": 1.0, "aimed": 1.5, "negated": 0.0, "reported": 0.1}
MENACE = 6.0


def emitted(symbol: str) -> tuple[float, float]:
    """The insult transducer's output: factor of the word's weight, and weight of its own."""
    base, *marks = symbol.split("/")
    factor = math.prod(FACTORS[m] for m in set(marks))
    return (factor, 0.0) if base == "insult" else (0.0, MENACE * factor) if base == "menace" else (0.0, 0.0)


def compiled(machine) -> list[dict[str, tuple[int, float, float]]]:
    """Table of the machine's states: what each symbol leads to and emits."""
    inputs = [*SYMBOLS, "insult/aimed"]
    number, table = {machine.start: 0}, []
    for state in (order := [machine.start]):
        row = {}
        for s in inputs:
            to, written = machine.step(state, s)
            if to not in number:
                number[to] = len(number)
                order.append(to)
            row[s] = (number[to], *emitted(written))
        table.append(row)
    return table


PARTS = {"negation": negation, "reported": reported, "target": target, "threat": threat}


class Grammar:
    """The composed transducers with learned weights. without: names of transducers to leave out."""

    def __init__(self, weights: dict[str, float], without: tuple[str, ...] = ()):
        self.weights, self.without = weights, without
        chosen = [make() for name, make in PARTS.items() if name not in without] or [Transducer(0, {}, {0: 0})]
        self.table = compiled(compose(chosen))
        self.after = None if "target" in without else target_after()
        self.insults = "insult" not in without
        self.own_words = {lang: frozenset(w for words in t.values() for w in words.split()) for lang, t in TABLES.items()}
        self.symbols = {lang: {",": "comma"} | {w: s for s in reversed(SYMBOLS[2:]) for w in t.get(s, "").split()} for lang, t in TABLES.items()}
        self.memo: dict[str, dict[str, tuple[str, float] | None]] = {lang: {} for lang in TABLES}

    def weight(self, word: str) -> float:
        out = 0.0
        for part in word.split("'") if "'" in word else (word,):
            out = max(out, self.weights.get(part + "$", 0.0), *[self.weights.get(part[:k], 0.0) for k in STEMS if k <= len(part)], 0.0)
        return out

    def symbol(self, word: str, lang: str) -> tuple[str, float] | None:
        """Symbol and weight of a word; None for one that says nothing."""
        memo = self.memo[lang]
        if word in memo:
            return memo[word]
        table = self.symbols[lang]
        named = table.get(word) or next((table[x] for x in word.split("'") if x in table), None)
        w = self.weight(word) if self.insults and named is None else 0.0
        found = ("insult", w) if w > 0 else (named, 0.0) if named else None
        if len(memo) < 200_000:
            memo[word] = found
        return found

    def clause(self, words: list[tuple[str, float]]) -> float:
        """Sum of the matches of a clause given as symbols and weights."""
        symbols = [s for s, _ in words]
        if self.after:
            state = self.after.start
            for i in range(len(symbols) - 1, -1, -1):
                state, symbols[i] = self.after.step(state, symbols[i])
        at, total = 0, 0.0
        for s, (_, w) in zip(symbols, words, strict=True):
            at, factor, own = self.table[at][s]
            total += factor * w + own
        return min(total, CLAUSE_CAP)

    def clauses(self, text: str) -> tuple[list[float], int]:
        """Scores of the clauses that match, and the number of words of the text."""
        parts = [TOKEN.findall(x) for x in CLAUSE.split(text.lower().replace("\u2019", "'"))]
        kinds = set().union(*parts)
        lang = max(TABLES, key=lambda x: len(kinds & self.own_words[x]))
        known = {w: s for w in kinds if (s := self.symbol(w, lang))}
        live = {w for w, (s, _) in known.items() if s in LIVE}
        dull = ("word", 0.0)
        found = [self.clause([known.get(w, dull) for w in words]) for words in parts if not live.isdisjoint(words)] if live else []
        return [x for x in found if x > 0], sum(len(words) - words.count(",") for words in parts)

    def features(self, text: str) -> list[float]:
        """Logs of all clauses together, of the strongest one, and of the score a hundred words."""
        found, n = self.clauses(text)
        total = sum(found)
        return [math.log1p(total), math.log1p(max(found, default=0.0)), math.log1p(100.0 * total / (n + 20))]


def sample_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """k, text and y of labelled documents. docs: k, text; labels: k, y."""
    return docs.join(F.broadcast(label_sample(labels, SAMPLE)[0]), "k").select("k", "text", "y")  # bounded by SAMPLE


def lexicon(some: DataFrame) -> tuple[dict[str, float], int, int]:
    """Weights of stems, and the numbers of toxic and other documents."""
    totals = some.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).first()
    p, n = totals["p"], totals["n"]
    if not p or not n:
        return {}, p, n

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, neg = Counter(), Counter()
            for text, y in zip(b["text"].to_pylist(), b["y"].to_pylist(), strict=True):
                words = {x for w in WORD.findall((text or "").lower().replace("\u2019", "'")) for x in w.split("'")}
                (pos if y else neg).update({w + "$" for w in words} | {w[:k] for w in words for k in STEMS if k <= len(w)})
            keys = list(pos.keys() | neg.keys())
            yield pa.record_batch({"stem": pa.array(keys, pa.string()), "p": pa.array([pos[k] for k in keys], pa.int64()), "n": pa.array([neg[k] for k in keys], pa.int64())})

    rows = cut(some.mapInArrow(stems, "stem string, p bigint, n bigint").groupBy("stem").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
    odds = F.log((F.col("p") + 0.5) / (p + 1.0)) - F.log((F.col("n") + 0.5) / (n + 1.0))
    both = F.col("p") + F.col("n")
    g = 2 * (F.col("p") * F.log(F.col("p") / (both * p / (p + n))) + F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / (both * n / (p + n)))).otherwise(0.0))
    usual = rows.filter(F.col("p") >= MIN_SUPPORT)
    least = 2 * math.log(max(usual.count(), 1) / MISTAKE)
    found = usual.filter((odds >= MIN_WEIGHT) & (g >= least)).select("stem", "p", odds.alias("w")).collect()
    weights = {r["stem"]: float(r["w"]) for r in found}
    prefixes = [(r["stem"], r["p"]) for r in found if not r["stem"].endswith("$")]
    if prefixes:
        word = rows.filter(F.endswith("stem", F.lit("$")) & (F.col("p") > 0)).select(F.expr("left(stem, length(stem) - 1)").alias("word"), "p")
        cuts = F.array_compact(F.array(*[F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in STEMS]))
        asked = some.sparkSession.createDataFrame(prefixes, "stem string, all long")
        family = word.select(F.explode(cuts).alias("stem"), "p").join(F.broadcast(asked), "stem").groupBy("stem", "all").agg(F.count("*").alias("kinds"), F.max("p").alias("most"))
        for r in family.filter((F.col("kinds") < MIN_KINDS) | (F.col("most") > MOST_ONE * F.col("all"))).collect():
            del weights[r["stem"]]
    seeds = {w for t in TABLES.values() for w in t["insult"].split()}
    against = {r["stem"] for r in rows.filter(F.col("stem").isin(*[w + "$" for w in sorted(seeds)]) & (both >= MIN_SUPPORT) & (odds < MIN_WEIGHT)).collect()}
    return {w + "$": SEED_WEIGHT for w in seeds if w + "$" not in against} | weights, p, n


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def best_threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    order = np.argsort(-z, kind="stable")
    z, y, w = z[order], y[order], weight[order]
    tp, fp = np.cumsum(w * y), np.cumsum(w * (1 - y))
    f1 = 2 * tp / (tp + fp + (w * y).sum())
    f1[:-1][z[1:] == z[:-1]] = -1
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


class Model:
    def __init__(self, weights: dict[str, float], coef: np.ndarray | None, shift: float = 0.0, without: tuple[str, ...] = ()):
        self.grammar, self.coef, self.shift = Grammar(weights, without), coef, shift

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.coef is None:
            return np.zeros(len(texts))
        x = np.array([[*self.grammar.features(t or ""), 1.0] for t in texts]).reshape(len(texts), len(self.coef))
        return 1 / (1 + np.exp(-np.clip(x @ self.coef - self.shift, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    some = sample_of(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), labels.select(F.col(key).alias("k"), F.col(label).alias("y")))
    weights, p, n = lexicon(some)
    if not p or not n:
        return Model({}, None)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(weights)
        for b in batches:
            x = [[*g.features(t or ""), 1.0] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["k"], pa.array(x, pa.list_(pa.float64())), b["y"]], ["k", "x", "y"])

    each = some.mapInArrow(rows, f"k {dict(some.dtypes)['k']}, x array<double>, y int")
    got = each.groupBy("k", "y").agg(F.min("x").alias("x")).toArrow()  # bounded by SAMPLE: one row a label
    x, y = np.array(got["x"].to_pylist()), got["y"].to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # the fit does not depend on the order of rows
    x, y = x[order], y[order]
    weight = np.ones(len(y))
    coef, use = logistic(x, y, weight), np.ones(x.shape[1], bool)
    while (coef[:-1] < 0).any():  # more evidence never lowers a score
        use[:-1] &= coef[:-1] >= 0
        coef = np.zeros(len(use))
        coef[use] = logistic(x[:, use], y, weight)
    shift = best_threshold(x @ coef, y, weight) - np.log(PREDICT / (1 - PREDICT))
    return Model(weights, coef, shift)


def scored(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with score; without text unless it is asked for."""
    docs = plain(docs, "score")
    keep = [c for c in docs.columns if keep_text or c != text]
    weights, coef, shift = model.grammar.weights, model.coef, model.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(weights, coef, shift)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(m.scores(b[text].to_pylist()))], [*keep, "score"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["score double"]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = learn(docs, labels.filter(~held))
    out = scored(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.withColumn("predicted", (F.col("score") >= PREDICT).cast("int"))
