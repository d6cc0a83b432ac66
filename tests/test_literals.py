"""The plain search before a pattern never rules out a match."""
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barlane import rules
from barlane.functions import literals
from barlane.plans.phrases import OPENERS, PHRASES

PATTERNS = sorted({p for groups in rules.GROUPS.values() for g in groups for p in g.patterns})


@pytest.mark.parametrize(
    "pattern, texts",
    [
        (r"\bfoo\s+bar\b", {"foo"}), (r"(?:abc|de)x?", {"abc", "de"}), (r"(abc)?def", {"def"}), (r"(?:ab|cd)+ ef", {" ef"}), (r"a|bc", set()), (r"[ab]cd", {"cd"}), (r"(?i)abc", set()), (r"(?:abc|abcd)", {"abc"}),
        (r"\w+", set()), (r"(?=abc)x", set()), (r"(?!abc)xyz", {"xyz"}), (r"x{2,3}", set()), (r"(?:xy){2}", {"xy"}), (r"", set()), (r"ab.*cde", {"cde"}),
    ],
)
def test_required_texts(pattern, texts):
    assert set(literals.required(pattern)) == texts


def test_most_patterns_have_them():
    assert sum(bool(literals.required(p)) for p in PATTERNS) > 0.7 * len(PATTERNS)


def test_every_match_holds_one():
    texts = [*PHRASES, *OPENERS, " ".join(PHRASES)]
    for p in PATTERNS:
        own = literals.required(p)
        for t in texts:
            if own and re.search(p, t):
                assert any(x in t for x in own), (p, t)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_generated_matches_hold_one(data):
    p = data.draw(st.sampled_from(PATTERNS))
    t = data.draw(st.from_regex(re.compile(p, re.ASCII)))
    if re.search(p, t):
        assert not literals.required(p) or any(x in t for x in literals.required(p))
