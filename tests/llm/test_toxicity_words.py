"""The words that are looked up before the grammar runs, and those that stems are learned from, are the grammar's own."""

from itertools import product

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import toxicity

MARKS = ["'{}'", "‘{}’", "“{}”", "«{}»", "„{}“", "—{}", "{}—", "{}…", "…{}", "¡{}!", "¿{}?", "a {}", "{} b", "{}_", "7{}", "{}'s", "·{}", "日{}", "{}"]


@pytest.mark.parametrize("mark", MARKS)
@pytest.mark.parametrize("word", ["idiot", "töten", "kill", "ünsinn"])
def test_prefilter_loses_nothing(mark, word):
    words = toxicity.Words({"idiot": 3.0, "ünsin*": 4.0})
    for text in (mark.format(word), f"so {mark.format(word)} you", f"Es gibt, ja: {mark.format(word).upper()} du; nichts"):
        clauses = [toxicity.words_of(c) for c in toxicity.CLAUSE.split(text.lower())]
        n = len(toxicity.words_of(text.lower())) + toxicity.FEW
        assert words.evidence(text) == pytest.approx(sum(map(words.clause, clauses)) + sum(map(words.begun, clauses)) / (n * toxicity.DENSITY))


def test_marks_hide_no_insult():
    e = toxicity.Words({"idiot": 3.0}).evidence
    assert {m: e(m.format("idiot")) for m in MARKS if m not in ("{}'s", "日{}")} == pytest.approx({m: 3.0 * toxicity.ALONE for m in MARKS if m not in ("{}'s", "日{}")})
    assert all(e(f"you are an {m.format('idiot')}") == 3.0 for m in ("'{}'", "“{}”", "«{}»"))


def test_stems_are_counted_at_marks():
    rows = pd.DataFrame({"text": ["«idiot»", "—idiot…", "'idiot'", "so"], "y": [1, 1, 1, 0]})
    counts = pd.concat(toxicity._count_features(iter([rows]))).set_index("feature")
    assert counts.loc["idiot"].tolist() == [3, 0] and counts.loc["so"].tolist() == [0, 1]


KINDS = ["insult", "noun", "threat", "doom", "wish", "target", "negation", "report", "intent", "personal", "copula", "article", "word"]


def every_path(parts, clause):
    """The best of all runs of all parts, each run written out: no states are merged, nothing is cached."""
    runs = []
    for part in parts:
        mine = [(part.start, ())]
        for kind, _ in clause:
            mine = [(to, (*factors, f)) for state, factors in mine for to, f in part.step(state, kind)]
        runs.append([factors for state, factors in mine if not part.open(state)])
    best = 0.0
    for chosen in product(*runs):
        total = 0.0
        for k, (_, weight) in enumerate(clause):
            factor = 1.0
            for factors in chosen:
                factor *= factors[k]
            total += weight * factor
        best = max(best, total)
    return best


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(KINDS), max_size=9))
def test_composition_is_the_best_of_all_paths(kinds):
    clause = [(k, {"insult": 4.0, "noun": 3.0, "threat": 3.0, "doom": 3.0}.get(k, 0.0)) for k in kinds]
    parts = [make() for make in toxicity.PARTS.values()]
    assert toxicity.Composed(parts).weight(clause) == pytest.approx(every_path(parts, clause))


#: Clauses and what they weigh with insults of 4 and threats of 3, counted by hand.
CLAUSES = [
    ("you idiot", 4), ("idiot", 1), ("the idiot", 1), ("idiots like you", 4), ("idiot one two three four you", 1), ("you one two three four idiot", 1),
    ("this idiot idiot", 1 + 0.5), ("you idiot idiot idiot", 4 + 2 + 1), ("you are not an idiot", 0.8), ("not never you idiot", 4), ("he said you idiot", 0.8),
    ("i will kill you", 3), ("i kill you", 1.5), ("kill", 0), ("will kill the time", 0), ("we will not kill you", 0.6), ("they said we will kill you", 0.6), ("you", 0), ("", 0),
    ("you clown", 3), ("you are a clown", 3), ("he is a total clown", 3), ("the clown", 0.3), ("the clown likes you", 0.3), ("they are taking the trash out", 0.3), ("the word idiot", 0.2),
    ("go to hell", 3), ("hell", 0), ("i hope you die", 3), ("you will die", 0), ("i hope you don't die", 0.6), ("you are stupid trash", 4 + 1.5),
]


@pytest.mark.parametrize("clause,weight", CLAUSES)
def test_clauses_by_hand(clause, weight):
    words = toxicity.Words({"idiot": 4.0, "idiots": 4.0, "stupid": 4.0})
    assert words.clause(toxicity.words_of(clause)) == pytest.approx(weight)


#: For each transducer a text that is judged otherwise without it, and the scale.
TELLING = {"insult": ("you idiot idiot idiot", 6.0), "threat": ("you will die", 0.7), "target": ("the clown", 0.7), "negation": ("you aren't an idiot", 0.7), "report": ("she said you idiot", 0.7)}


@pytest.mark.parametrize("part", list(toxicity.PARTS))
def test_each_transducer_changes_predictions(part):
    lexicon, (text, scale) = {"idiot": 3.0}, TELLING[part]
    whole = toxicity.Words(lexicon).evidence(text)
    others = toxicity.Composed(make() for name, make in toxicity.PARTS.items() if name != part)
    without = toxicity.Words(lexicon, others).evidence(text)
    assert (whole >= scale) != (without >= scale)


#: Literal and hostile sentences, judged by the words that the module begins with and the scale that it has without labels.
LITERAL = "this trash can is full|take the trash out|the garbage truck comes at nine|the word idiot has five letters|the clown made the children laugh|they are taking the trash out|kill the process|he said you are an idiot|you are not an idiot|la palabra idiota|das Wort Idiot|le mot idiote"
HOSTILE = "you people are subhuman animals|go to hell|i hate you and hope you die|you clown|he is a total clown|I will kill you|tu es un idiot|du bist ein Feigling|eres una basura|stupid"


def test_literal_and_hostile_sentences():
    words = toxicity.Words({w: toxicity.INSULT_WEIGHT for w in toxicity.INSULTS.split()})
    assert [t for t in LITERAL.split("|") if words.evidence(t) >= toxicity._AS_ONE] == []
    assert [t for t in HOSTILE.split("|") if words.evidence(t) < toxicity._AS_ONE] == []


def test_predictions_on_the_tables_rest_on_the_grammar(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lexicon, scale = toxicity.fit(docs, labels)
    texts = [r.text for r in docs.join(labels, "doc_id").select("text").collect()]
    whole = [toxicity.Words(lexicon).evidence(t) >= scale for t in texts]
    changed = {}
    for part in toxicity.PARTS:
        words = toxicity.Words(lexicon, toxicity.Composed(make() for name, make in toxicity.PARTS.items() if name != part))
        changed[part] = sum((words.evidence(t) >= scale) != w for t, w in zip(texts, whole))
    assert changed["threat"] > 0


def test_beginnings_count_by_their_share():
    words = toxicity.Words({"boment*": 3.0})
    few, many = "bomentera " + "palabra. " * 500, "bomentera. " * 6 + "palabras. " * 200
    assert words.evidence(few) < toxicity._AS_ONE < words.evidence(many) and words.evidence("boment") == 0
