"""Words outside the head get classes by their own contexts."""
import random
import zlib

import numpy as np
import pytest

from barlane.llm import brown


def test_words_of_one_shape_part_by_their_contexts(spark):
    rng = random.Random(5)
    one, two = ([f"{a}{i:03d}ab" for i in range(300)] for a in "xy")  # all have one length and ending, so one shape
    rows = [" ".join(f"le {rng.choice(one)} va" if rng.random() < 0.5 else f"der {rng.choice(two)} geht" for _ in range(40)) for _ in range(300)]
    train = spark.createDataFrame([(r,) for r in rows], "text string")
    counts = brown.word_counts(train).cache()
    seeds = brown.seeded(train, counts, head=44, classes=6)  # 40 of the words are seeds, 560 go by contexts
    got = brown.word_classes(train, counts, seeds)
    of = {r.w: r["class"] for r in got.collect()}
    assert len(of) == counts.count()
    h = lambda ws: [next(brown._tokens(brown.pa.array([w])))[2].view(np.int64)[0] for w in ws]
    left, right = ({of[x] for x in h(ws) if x in of} for ws in (one, two))
    assert not left & right


def test_best_is_the_largest_gain():
    rng = np.random.default_rng(7)
    k, m = 5, 12
    pairs = rng.integers(0, 30, (m, m)).astype(float)
    pairs[-1, -1] = 0
    np.fill_diagonal(pairs, 0)
    of = np.append(rng.integers(0, k - 1, m - 1), k - 1)

    def likelihood(of):
        member = np.zeros((k, m))
        member[of, np.arange(m)] = 1
        both = member @ pairs @ member.T
        return both, brown._h(both).sum() - brown._h(both.sum(0)).sum() - brown._h(both.sum(1)).sum()

    both, _ = likelihood(of)
    for i in range(m - 1):
        if (pairs[i, of == of[i]] + pairs[of == of[i], i]).any():
            continue  # pairs within the own class are taken as they are
        member = np.eye(k)[of]
        n = np.concatenate([pairs[:, i] @ member, pairs[i] @ member])
        # balance: the size of a class is its tokens as a second word
        want = []
        for c in range(k - 1):
            moved = of.copy()
            moved[i] = c
            b, _ = likelihood(moved)
            want.append(brown._h(b).sum() - 2 * brown._h(b.sum(0)).sum())
        got = brown.best(np.zeros(2 * k, int), np.arange(2 * k), n, of[[i]], pairs.sum(0)[[i]], both, both.sum(0))
        assert want[got[0]] == pytest.approx(max(want))


def test_base_score_is_zero_where_every_row_is_held_out(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = brown.score(spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")).collect()
    assert held and [r.base_score for r in got] == [0.0] * len(held)
    assert all(r.train_tokens == 0 and np.isfinite(r.score) for r in got)
