"""Nearly repeated lines: the bound rules out no pair, and long transcripts take seconds."""
import random
import time
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from barlane.functions import similarity


def brute(lines):
    counts, near = {}, 0
    for line in lines:
        if len(line.split()) > 3:
            counts[line.lower()] = counts.get(line.lower(), 0) + 1
    long = [x for x in lines if len(x.split()) > 4]
    evidence = []
    for i, a in enumerate(long):
        for b in long[i + 1 :]:
            r = SequenceMatcher(None, a.lower(), b.lower()).ratio()
            if r >= 0.8:
                near += 1
                evidence.append(f'Near-repeat (similarity {r:.0%}): "{a[:50]}" ≈ "{b[:50]}"')
    exact = [(x, n) for x, n in counts.items() if n > 1]
    said = [f'Repeated ({n}x): "{x[:80]}"' for x, n in exact[:2]] + evidence[:2]
    return min(min(len(exact) * 0.45, 0.95) + min(near * 0.35, 0.6), 1.0), said[:3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a be sea deer the THE über naïve 漢字 😀 ran".split()), min_size=3, max_size=9).map(" ".join), max_size=14))
def test_same_as_all_pairs(lines):
    got = similarity.repeats(lines)
    want = brute(lines)
    assert abs(got[0] - want[0]) < 1e-9 and got[1] == want[1]


def test_very_long_lines_and_many_of_a_character():
    lines = ["z " * 70_000 + "one two three four", "z " * 70_001 + "one two three four", "short and quite other line here"]
    assert list(similarity.possible_pairs(lines, 0.8)) == [(0, 1)]


def test_twenty_thousand_lines():
    rng, words = random.Random(2), [f"{a}{b}" for a in "badcefgh" for b in ("ing", "oll", "urn", "ash", "ite", "ock")]
    lines = [" ".join(rng.choices(words, k=8)) for _ in range(20_000)]
    began = time.process_time()
    pairs = sum(1 for _ in similarity.possible_pairs([x.lower() for x in lines], 0.9))
    assert pairs < len(lines) ** 2 / 100 and time.process_time() - began < 60
