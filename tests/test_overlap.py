"""Stems against the published examples of the method, ROUGE and BLEU means against plain Python."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from dialoom.functions.stem import stem, stems
from dialoom.operators import overlap

STEMS = """caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file
happy happi sky sky enjoy enjoy relational relat conditional condit rational ration hesitanci hesit digitizer digit radicalli radic
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electrical electr goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop defensible defens
replacement replac adjustment adjust dependent depend adoption adopt communism commun angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controlling control rolling roll dying die dies die at at"""
PAIRS = [
    (1, 0, "I recommend Alien", "I recommended Alien, a scary film"), (1, 1, "watching films at night", "watch a film tonight"), (2, 0, None, "nothing said"),
    (2, 1, "the same words here again", "the same words here again"), (2, 2, "", ""), (3, 0, "a a a b", "a a c"),
]


def test_stems(spark):
    words = STEMS.split()
    assert {w: stem(w) for w in words[::2]} == dict(zip(words[::2], words[1::2], strict=True))
    got = spark.createDataFrame([(["movies", "was", "films"],), (None,), ([],)], "w array<string>").select(stems("w").alias("s")).collect()
    assert [r.s for r in got] == [["movi", "was", "film"], None, []]


def f_measure(a, b, n):
    x, y = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (a, b))
    size = x.total() + y.total()
    return 2 * (x & y).total() / size if size else 0.0


def common(a, b):
    if not a or not b:
        return 0
    return common(a[:-1], b[:-1]) + 1 if a[-1] == b[-1] else max(common(a[:-1], b), common(a, b[:-1]))


def bleu(ref, hyp):
    hits = [(Counter(tuple(hyp[i : i + n]) for i in range(len(hyp) - n + 1)) & Counter(tuple(ref[i : i + n]) for i in range(len(ref) - n + 1))).total() for n in range(1, 5)]
    if not hits[0]:
        return 0.0
    return math.exp(sum(math.log((h or 0.1) / max(1, len(hyp) - n)) for n, h in enumerate(hits)) / 4 + min(0.0, 1 - len(ref) / len(hyp)))


@pytest.mark.parametrize("stemmed", [True, False])
def test_text_scores(spark, stemmed):
    rows = spark.createDataFrame(PAIRS, "c long, t int, reference_response string, generated_response string")
    got = overlap.text_scores(rows, ["c", "t"], stemmed=stemmed).first().asDict()
    words = [tuple((s or "").lower().replace(",", "").split() for s in p[2:]) for p in PAIRS]
    roots = [tuple([stem(w) if stemmed and len(w) > 3 else w for w in ws] for ws in pair) for pair in words]
    longest = [2 * common(a, b) / (len(a) + len(b)) if a or b else 0.0 for a, b in roots]
    mean = lambda xs: sum(xs) / len(PAIRS)
    assert got == pytest.approx({"BLEU": mean([bleu(a, b) for a, b in words]), "ROUGE-1": mean([f_measure(a, b, 1) for a, b in roots]), "ROUGE-2": mean([f_measure(a, b, 2) for a, b in roots]), "ROUGE-L": mean(longest)})


def test_text_scores_empty(spark):
    none = spark.createDataFrame([], "c long, reference_response string, generated_response string")
    assert set(overlap.text_scores(none, ["c"]).first().asDict().values()) == {None}
