"""Toxicity: a weighted finite-state grammar over clauses, with a lexicon learned from a bounded labelled sample."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, remembering, table, written

#: Labelled documents that the lexicon and the scale are learned from, at most.
SAMPLE = 20_000
#: Score from which a document counts as toxic.
CUT = 0.7
REMEMBERED = 200_000
STEMS = (4, 5, 6, 7)

# Words of the grammar's closed classes in English, German, French and Spanish. A word of two
# classes belongs to the first.
CLOSED = {
    "threat": "kill hurt destroy murder stab shoot strangle töten umbringen verprügeln erschießen tuer frapper étrangler matar golpear apuñalar",
    "doom": "die rot hell verrecken verrecke krepieren hölle crever crève enfer muérete morirte infierno",
    "wish": "hope wish deserve deserves go burn hoffe wünsche verdient fahr espère souhaite mérite ojalá espero mereces vete",
    "target": "you your yourself he she they him her them du dich dir ihr ihn sie tu te toi vous il elle ils elles tú usted ustedes él ella ellos ellas",
    "negation": "not never no nobody isn't aren't wasn't don't doesn't won't can't cannot nicht kein keine keinen nie niemals pas jamais aucun aucune nunca jamás ni",
    "report": "said says claimed claims called calls quoted wrote word words term phrase spelled sagte schrieb nannte zitierte wort wörter dit écrit appelé cité mot mots dijo escribió llamó citó palabra palabras",
    "intent": "will shall going gonna i'll we'll he'll they'll werde werden wirst wird vais vas va allons vont voy vamos van",
    "personal": "you're he's she's they're bist seid êtes eres sois",
    "copula": "is are was were am be ist sind war est sont suis es son era",
    "article": "this that these those the a an such so der die das dieser diese ein eine le la les ce cette un une el los las eso esa esta este una tan",
}
# Common insults of the four languages; and those that are insults only of somebody.
INSULTS = (
    "idiot idiots idiotic moron morons moronic imbecile stupid dumb dumbass pathetic worthless scum scumbag subhuman loser losers disgusting bastard bitch asshole retard "
    "trottel dummkopf blödmann schwachkopf arschloch mistkerl dreckskerl hurensohn wichser schlampe widerlich erbärmlich "
    "idiote imbécile crétin abruti connard connasse salaud salope débile minable raclure "
    "idiota imbécil estúpido estúpida cretino pendejo cabrón gilipollas escoria patético asqueroso"
)
NOUNS = "trash garbage vermin filth clown clowns coward liar creep jerk animal animals pig pigs versager abschaum feigling lügner ordure bouffon pourriture menteur basura payaso mentiroso perdedor"
INSULT_WEIGHT = 3.0
THREAT_WEIGHT = 3.0
#: What an insult weighs that is said of nobody.
ALONE = 0.25
#: A learned beginning of words counts by its share of a text's words, this share as one insult that is said of nobody;
#: so many words are added to each text, so that one of a few words says little.
DENSITY, FEW = 0.01, 30
#: Words between what belongs together, at most.
REACH = 4

LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
CLAUSE = re.compile(r"[.!?;:,\n]+")
SPACES = bytes(c if c < 128 and chr(c).isalpha() else 32 for c in range(256))


def words_of(lower: str) -> list[bytes]:
    """The words of a text in lower case that the grammar reads in its clauses, in UTF-8."""
    if lower.isascii() and "'" not in lower:
        return lower.encode().translate(SPACES).split()
    return " ".join(LETTERS.findall(lower)).encode().split()


class Transducer:
    """A weighted transducer over word classes, not always deterministic: (state, class) -> choices of (state, factor).

    The factor scales what an insult or a threat weighs. A class without an arc leads to `rest(state)` with
    factor 1; a state whose rest is None has no way on. `open` states may not end a clause."""

    def __init__(self, start: str, arcs: dict[tuple[str, str], list[tuple[str, float]]], rest=lambda state: state, open=lambda state: False) -> None:
        self.start, self.arcs, self.rest, self.open = start, arcs, rest, open

    def step(self, state: str, kind: str) -> list[tuple[str, float]]:
        if found := self.arcs.get((state, kind)):
            return found
        return [(to, 1.0)] if (to := self.rest(state)) is not None else []


def _fading(last: str | None):
    """States end in the number of words that they last; then `last` comes."""

    def rest(state: str) -> str | None:
        name, n = state.rstrip("0123456789"), state[len(state.rstrip("0123456789")) :]
        return state if not n else f"{name}{int(n) - 1}" if n != "1" else last

    return rest


#: The classes whose words weigh something.
WEIGHED = ("insult", "noun", "threat", "doom")


def insult_transducer() -> Transducer:
    """Each further insult of a clause weighs half of the one before."""
    steps = (("none", "some", 1.0), ("some", "more", 0.5), ("more", "more", 0.25))
    return Transducer("none", {(state, kind): [(to, factor)] for state, to, factor in steps for kind in ("insult", "noun")})


def threat_transducer() -> Transducer:
    """A threat that is announced weighs twice as much as one that isn't; a doom weighs only where it is wished."""
    meant, wished = ([f"{n}{k}" for k in range(1, REACH + 1)] for n in ("meant", "wished"))
    arcs = {(s, "intent"): [(meant[-1], 1.0)] for s in ("plain", *meant)} | {(s, "wish"): [(wished[-1], 1.0)] for s in ("plain", *meant, *wished)}
    arcs |= {(s, "threat"): [("plain", 0.5)] for s in ("plain", *wished)} | {(s, "threat"): [("plain", 1.0)] for s in meant}
    arcs |= {(s, "doom"): [("plain", 1.0 if s in wished else 0.0)] for s in ("plain", *meant, *wished)}
    return Transducer("plain", arcs, _fading("plain"))


def target_transducer() -> Transducer:
    """Whom it is about. An insult weighs in full after a target or, owed one, before it, and little alone.

    What is an insult only of somebody weighs in full as an address, right after the target, or as a
    predicate: a target, a copula, an article perhaps and a word at most between. Else it weighs next to
    nothing. A threat weighs where a target follows and a doom where one or a wish is before, else nothing."""
    seen, said = [f"seen{k}" for k in range(1, REACH + 1)], ["said1", "said2"]
    fading = _fading("none")
    rest = lambda s: "bare1" if s == "said2" else "none" if s in ("said1", "bare1") else fading(s)
    free = ("none", *seen, *said, "bare1")
    arcs = {(s, kind): [(seen[-1], 1.0)] for s in free for kind in ("target", "wish")}
    # some copulas say by themselves whom they are about
    arcs |= {(s, "personal"): [("said2", 1.0)] for s in free} | {(s, "copula"): [("said2", 1.0)] for s in seen} | {("said2", kind): [("said2", 1.0)] for kind in ("article", "negation")}
    for state in free:
        to = rest(state)
        full = state != "none"
        arcs[state, "insult"] = [("said2" if state in (*said, "bare1") else to, 1.0 if full else ALONE), (f"owed{REACH}", 1.0)]
        arcs[state, "noun"] = [(to, 1.0 if state in (seen[-1], *said, "bare1") else 0.1)]
        arcs[state, "threat"] = [(to, 0.0), (f"owed{REACH}", 1.0)]
        arcs[state, "doom"] = [(to, 1.0 if full else 0.0)]
    # who reports is not whom it is about
    arcs |= {(s, "report"): [("none", 1.0)] for s in free}
    arcs |= {(f"owed{k}", "target"): [(seen[-1], 1.0)] for k in range(1, REACH + 1)}
    # what is owed a target for too long has no way on: only the path that owes nothing is left
    return Transducer("none", arcs, lambda s: None if s == "owed1" else rest(s), lambda s: s.startswith("owed"))


def negation_transducer() -> Transducer:
    """What is negated weighs a fifth; a second negation takes the first back."""
    negated = [f"negated{k}" for k in range(1, REACH + 1)]
    arcs = {("plain", "negation"): [(negated[-1], 1.0)]} | {(s, "negation"): [("plain", 1.0)] for s in negated}
    rest = _fading("plain")
    return Transducer("plain", arcs | {(s, kind): [(rest(s), 0.2)] for s in negated for kind in WEIGHED}, rest)


def report_transducer() -> Transducer:
    """What follows a word of reported speech in its clause, or one that mentions words, is somebody else's and weighs a fifth."""
    return Transducer("own", {("own", "report"): [("told", 1.0)], **{("told", kind): [("told", 0.2)] for kind in WEIGHED}})


PARTS = {"insult": insult_transducer, "threat": threat_transducer, "target": target_transducer, "negation": negation_transducer, "report": report_transducer}


class Composed:
    """The composition of transducers that read the same words: states are tuples and factors multiply.

    A clause weighs what its best accepted path does, the sum of its words' weights, each scaled by the
    factors of all parts."""

    def __init__(self, parts: Iterable[Transducer]) -> None:
        self.parts = tuple(parts)
        self.start = tuple(p.start for p in self.parts)
        self.step, self.open = cache(self._step), cache(lambda state: any(p.open(s) for p, s in zip(self.parts, state)))

    def _step(self, state: tuple[str, ...], kind: str) -> list[tuple[tuple[str, ...], float]]:
        ways: list[tuple[tuple[str, ...], float]] = [((), 1.0)]
        for part, s in zip(self.parts, state):
            ways = [((*done, to), factor * f) for done, factor in ways for to, f in part.step(s, kind)]
        return ways

    def weight(self, clause: Iterable[tuple[str, float]]) -> float:
        """The weight of a clause of (class, weight): the best path in (max, +)."""
        paths = {self.start: 0.0}
        for kind, weight in clause:
            onward: dict[tuple[str, ...], float] = {}
            for state, total in paths.items():
                for to, factor in self.step(state, kind):
                    value = total + weight * factor
                    if value > onward.get(to, -math.inf):
                        onward[to] = value
            paths = onward
        return max((total for state, total in paths.items() if not self.open(state)), default=0.0)


MACHINE = Composed(make() for make in PARTS.values())
CLASSES = {word: kind for kind in reversed(CLOSED) for word in CLOSED[kind].split()} | dict.fromkeys(NOUNS.split(), "noun")
WEIGHTS = {"threat": THREAT_WEIGHT, "doom": THREAT_WEIGHT, "noun": INSULT_WEIGHT}
LOADED = frozenset(w.encode() for w, kind in CLASSES.items() if kind in WEIGHTS)


def stems(word: str) -> set[str]:
    """What a word's entry in the lexicon may be: the word, or its beginnings followed by a star."""
    return {word} | {word[:n] + "*" for n in STEMS if len(word) > n}


class Words(dict):
    """word (lower case, UTF-8) -> (weight as an insult, 0 for all others; whether a beginning of it is in the lexicon)."""

    def __init__(self, lexicon: dict[str, float], machine: Composed = MACHINE) -> None:
        super().__init__()
        self.lexicon, self.machine = lexicon, machine

    def __missing__(self, word: bytes) -> tuple[float, bool]:
        if len(self) >= REMEMBERED:
            self.clear()
        whole = word.decode(errors="replace")
        found = self.lexicon.get(whole, 0.0), any(s in self.lexicon for s in stems(whole) - {whole})
        self[word] = found
        return found

    forget = dict.clear

    def evidence(self, text: str | None) -> float:
        """The weights of the text's clauses, added up. Only clauses with a word that weighs something are run.

        Words of which only a beginning is known are run apart, and their clauses' weights are taken for
        the text's length."""
        if not text:
            return 0.0
        lower = text.lower()
        words = words_of(lower)
        known = [self[w] for w in words]
        whole, begun = any(w for w, _ in known) or not LOADED.isdisjoint(words), any(b for _, b in known)
        if not whole and not begun:
            return 0.0
        clauses = [words_of(c) for c in CLAUSE.split(lower)]
        total = sum(map(self.clause, clauses)) if whole else 0.0
        if begun:
            total += sum(map(self.begun, clauses)) / ((len(words) + FEW) * DENSITY)
        return total

    def clause(self, words: list[bytes]) -> float:
        """A clause's weight by the composed machine; a word of a class that weighs something is of that class."""
        return self._run([self._read(w) for w in words])

    def begun(self, words: list[bytes]) -> float:
        """A clause's weight if only words whose beginnings are known are insults."""
        return self._run([("insult", INSULT_WEIGHT) if self[w][1] else (CLASSES.get(w.decode(), "word"), 0.0) for w in words])

    def _run(self, clause: list[tuple[str, float]]) -> float:
        return self.machine.weight(clause) if any(weight for _, weight in clause) else 0.0

    def _read(self, word: bytes) -> tuple[str, float]:
        kind = CLASSES.get(word.decode(), "word")
        if kind in WEIGHTS:
            return kind, WEIGHTS[kind]
        return ("insult", weight) if (weight := self[word][0]) else (kind, 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int = SAMPLE) -> DataFrame:
    """(text, y) of at most `size` labelled documents, those with the smallest hash of doc_id.

    Rows without an id or a label are left out; a doc_id with several labels takes the largest, one with
    several texts the last of them in order."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    n = rows.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rows = rows.withColumn("draw", draw)
    if n > size:
        # a loose cut first, so that each task hands on few more rows than are wanted
        rows = rows.filter(F.col("draw") <= (1 << 30) * min(1.0, 1.2 * size / n + 1e-4))
    rows = rows.orderBy("draw", "doc_id").limit(size).select("doc_id", "y")
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    return texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y")).select("text", "y")


def features(text: str | None) -> set[str]:
    """The words of a text, and the beginnings that `DENSITY` of its words have."""
    words = [w.decode(errors="replace") for w in words_of((text or "").lower())]
    begun = Counter(s for w in words for s in stems(w) if s.endswith("*"))
    return set(words) | {s for s, n in begun.items() if n >= DENSITY * (len(words) + FEW)}


def _count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, y in zip(batch["text"], batch["y"]):
            counts[int(y > 0)].update(features(text))
    every = list(counts[0] | counts[1])
    for at in range(0, len(every), 100_000):
        some = every[at : at + 100_000]
        yield pd.DataFrame({"feature": some, "toxic": [counts[1][s] for s in some], "clean": [counts[0][s] for s in some]})


def learn(sample: DataFrame) -> tuple[dict[str, float], float]:
    """(lexicon, scale) from rows (text, y).

    The weight of a word or a beginning is the log ratio of the shares of toxic and clean rows that have it. Only
    those that are all but absent from clean rows count, and they are taken greedily by the toxic rows
    that they add: so words that merely stand in copies of one toxic text don't get in. Each adds 5 rows at least,
    and 1 % of the toxic ones, so some 100 are the most; candidates are bounded by the sample's texts. The scale is where evidence of clauses best parts the sample's labels."""
    n_toxic, n_clean = sample.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)).first()
    lexicon = {word: INSULT_WEIGHT for word in INSULTS.split()}
    if not n_toxic or not n_clean:
        return lexicon, _AS_ONE
    counts = sample.mapInPandas(_count_features, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    support = max(5, n_toxic // 100)
    # a beginning is common by chance in some clean rows, a word is not
    absent = F.col("clean") * F.when(F.endswith("feature", F.lit("*")), 10).otherwise(50) <= F.col("toxic")
    some = counts.withColumn("w", weight).filter((F.col("toxic") >= support) & (F.col("w") > 3) & absent)
    some = some.orderBy(F.desc("toxic"), "feature").collect()
    names = [r["feature"] for r in some]
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast({name: i for i, name in enumerate(names)})

    def held(texts: pd.Series) -> pd.Series:
        known = shared.value
        return pd.Series([sorted(known[s] for s in known.keys() & features(t)) for t in texts])

    held.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    rows = sample.filter("y > 0").select(F.pandas_udf(held, "array<int>")("text").alias("held")).collect()
    for i in _cover([r["held"] for r in rows], lambda i: (len(names[i]), names[i]), support):
        if names[i] not in CLASSES:
            lexicon.setdefault(names[i], min(some[i]["w"], INSULT_WEIGHT))
    scored = sample.select(evidence(spark, lexicon)("text").alias("e"), "y").collect()
    return lexicon, _parting(np.array([r["e"] for r in scored]), np.array([r["y"] > 0 for r in scored]))


def _cover(sets: list[list[int]], tie, least: int) -> list[int]:
    """Members chosen one after the other, each in the most sets that no earlier one is in, `least` at any rate."""
    where: dict[int, list[int]] = {}
    for k, held in enumerate(sets):
        for i in held:
            where.setdefault(i, []).append(k)
    gain, covered, out = {i: len(ks) for i, ks in where.items()}, set(), []
    while gain:
        best = max(gain, key=lambda i: (gain[i], tie(i)))
        if gain[best] < least:
            break
        out.append(best)
        for k in where[best]:
            if k not in covered:
                covered.add(k)
                for i in sets[k]:
                    gain[i] -= 1
    return out


#: Evidence just short of one insult that is said of nobody, and just over one of somebody that is negated or reported.
_AS_ONE, _LEAST = 0.9 * ALONE * INSULT_WEIGHT, 1.05 * 0.2 * INSULT_WEIGHT


def _parting(e: np.ndarray, y: np.ndarray) -> float:
    """The evidence from which on rows are called toxic with fewest mistakes: of all such, the nearest to one insult
    said of nobody. Less than an insult that is negated or reported is never enough."""
    values = np.unique(e)
    if len(values) < 2:
        return _AS_ONE
    wrong = np.array([np.count_nonzero((e >= v) != y) for v in values[1:]])
    best = np.flatnonzero(wrong == wrong.min())
    # any evidence above one value and up to the next parts alike
    cuts = np.clip(_AS_ONE, values[best] + 0.1 * (values[best + 1] - values[best]), values[best + 1])
    return max(_LEAST, float(cuts[np.argmin(np.abs(cuts - _AS_ONE))]))


_WORDS: list[Words] = []


def _words(lexicon: dict[str, float]) -> Words:
    """The words of a lexicon, kept by a worker from task to task until another lexicon comes."""
    if not _WORDS or _WORDS[0].lexicon != lexicon:
        _WORDS[:] = [Words(lexicon)]
    return _WORDS[0]


def evidence(spark: SparkSession, lexicon: dict[str, float]):
    shared = spark.sparkContext.broadcast(lexicon)

    def of(texts: pd.Series) -> pd.Series:
        words = _words(shared.value)
        remembering(words)
        return pd.Series([words.evidence(t) for t in texts], dtype="float64")

    of.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, "double")


def score(docs: DataFrame, lexicon: dict[str, float], scale: float) -> DataFrame:
    """`docs` with a column `score` from 0 to 1 that is `CUT` where evidence is `scale`; a null text scores 0."""
    e = evidence(docs.sparkSession, lexicon)("text")
    return docs.withColumn("score", e).withColumn("score", F.col("score") / (F.col("score") + F.lit(scale * (1 - CUT) / CUT)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """Learns from labels whose doc_id is not in the held-out third."""
    return learn(written(labelled_sample(docs, labels.filter(fold(F.col("doc_id"), 3) != 1), "toxic"), "toxicity"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that score below `CUT`, with their columns. All labels outside the held-out third teach."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score(rows, *fit(docs, labels)).filter(F.col("score") < CUT).select("row.*")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text); labels (doc_id, toxic) only teach.

    Null and empty texts score 0. Without labels of both kinds the grammar works with its own words."""
    scored = score(docs.select("doc_id", "text"), *fit(docs, labels))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
