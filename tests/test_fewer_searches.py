"""Tests of a scan look only at the rows that hold their words, and few pairs of lines are compared in full."""
import random
from difflib import SequenceMatcher

import pyarrow as pa
import pyarrow.compute as pc

from barlane.functions import searches, similarity
from barlane.plans.phrases import OPENERS, PHRASES


def _each_by_itself(texts):
    """Every test of every text by itself, as searches.search did for whole columns."""
    own = pa.array(texts, pa.string())
    return [[None if t is None else r for t, r in zip(texts, (pc.match_substring_regex if pattern else pc.match_substring)(own, what).to_pylist())] for _, pattern, what, *_ in searches._tests()]


def test_patterns_are_tried_where_their_words_are(monkeypatch):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("zq", "vx", "kj") for b in "012345" for c in ("w", "zz")]
    said = [p.lower() for p in (*PHRASES, *OPENERS)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(2000)] + said + [f"{a}\x0b{b}\n {c}" for a, b, c in zip(said, said[7:], said[20:])]
    texts += ["", " ", "\n", "x", "\x1cend\x1fpunch", "hold  on", "um...", None]
    tried, own = [0], pc.match_substring_regex
    monkeypatch.setattr(pc, "match_substring_regex", lambda a, *x: tried.__setitem__(0, tried[0] + len(a)) or own(a, *x))
    column = pa.array(texts, pa.string())
    got = searches.search(column, column, column).to_pylist()
    assert tried[0] < 0.2 * len(texts) * sum(pattern for _, pattern, *_ in searches._tests())  # before: all
    want = _each_by_itself(texts)
    assert got == [list(row) for row in zip(*want)]


def test_pieces_of_a_batch_and_columns_of_no_words(monkeypatch):
    texts = [p.lower() for p in PHRASES] + [None, ""]
    column, other = pa.array(texts), pa.array(texts[::-1])
    whole = searches.search(column, other, column)
    monkeypatch.setattr(searches, "PIECE", 500)
    assert searches.search(column, other, column).equals(whole)
    assert searches.search(column.slice(3), other.slice(3), column.slice(3)).to_pylist() == whole.to_pylist()[3:]
    for texts in ([], [None], ["", None], [" \n"]):
        none = pa.array(texts, pa.string())
        assert [len(r) for r in searches.search(none, none, none).to_pylist()] == [len(searches._tests())] * len(texts)


def test_the_ratio_where_it_reaches_the_least():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choices("ab cde", k=rng.randint(0, 30)))
        b = a
        for _ in range(rng.randint(0, 8)):
            p = rng.randint(0, len(b))
            b = b[:p] + rng.choice(["", "a", "xy", "dec"]) + b[p + rng.randint(0, 2) :]
        if rng.random() < 0.1:
            a, b = a * 9, b * 9
        want = SequenceMatcher(None, a, b).ratio()
        assert similarity.near(a, b, 0.8) == (want if want >= 0.8 else 0.0), (a, b)


def test_two_near_repeats_are_enough(monkeypatch):
    compared, own = [0], similarity.ratio
    monkeypatch.setattr(similarity, "ratio", lambda a, b: compared.__setitem__(0, compared[0] + 1) or own(a, b))
    lines = [f"we said the very same thing number {n} again" for n in range(60)]
    confidence, evidence = similarity.repeats(lines)
    assert confidence == 0.60 and len(evidence) == 2 and compared[0] <= 4  # before: 1,770 pairs
