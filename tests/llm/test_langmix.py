"""Language mixtures against brute force, on held-out texts and odd rows."""
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from barlane.llm import langmix, queries

WORDS = {
    "en": "the of and to in is that for it was on are with they this have from".split(),
    "de": "der die und das nicht ist auch ein werden für über straße größe nach".split(),
    "es": "el la los que para una por con niño señor mañana está también donde".split(),
}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def mixed(z):
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
    return z ^ (z >> 31)


def events(t, number):
    raw, out = t.lower().encode(), bytearray()
    for b in raw:
        if 97 <= b <= 122 or b >= 128:
            out.append(b)
        elif not out or out[-1] != 32:
            out.append(32)
    return [mixed(int.from_bytes(out[i : i + 4], "little")) & (number - 1) for i in range(len(out) - 3)]


def brute(rows, number):
    """doc_id -> (language, proportion), by plain counts and EM over each text's list of events."""
    train = [(t, lang) for i, t, lang in rows if None not in (i, t, lang) and zlib.crc32(str(i).encode()) % 4 != 2]
    names = sorted({lang for _, lang in train})
    count = {n: [langmix.SMOOTH] * number for n in names}
    for t, lang in train:
        for e in events(t, number):
            count[lang][e] += 1
    total = {n: sum(count[n]) for n in names}
    p = {n: [c / total[n] for c in count[n]] for n in names}
    prior = {n: sum(lang == n for _, lang in train) / len(train) for n in names}
    out = {}
    for i, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            out[i] = ("und", 0.0)
            continue
        own = events(t, number)
        chosen = [max(names, key=lambda n: math.log(prior[n]) + sum(math.log(p[n][e]) for e in own))]
        share = [1.0]
        penalty = langmix.PENALTY * math.log2(len(own) + 1)
        while len(chosen) < len(names):
            at = [sum(s * p[n][e] for s, n in zip(share, chosen)) for e in own]
            gain = {n: sum(p[n][e] / a for e, a in zip(own, at)) - len(own) for n in names if n not in chosen}
            more = max(gain, key=gain.get)
            if gain[more] <= penalty:
                break
            wide, s = [*chosen, more], [*(0.9 * x for x in share), 0.1]
            for _ in range(300):
                add = [0.0] * len(wide)
                for e in own:
                    each = [x * p[n][e] for x, n in zip(s, wide)]
                    add = [a + x / sum(each) for a, x in zip(add, each)]
                s = [a / len(own) for a in add]
            now = [sum(x * p[n][e] for x, n in zip(s, wide)) for e in own]
            if sum(math.log(b / a) for a, b in zip(at, now)) <= penalty:
                break
            chosen, share = wide, s
        top = max(share)
        out[i] = (min(n for n, s in zip(chosen, share) if s == top), top)
    return out


def test_equals_brute_force_with_mixed_and_odd_texts(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, rng.choice(list(WORDS)), rng.randint(3, 40)), None) for i in range(60)]
    rows = [(i, t, next(n for n in WORDS if t.split()[0] in WORDS[n])) for i, t, _ in rows]
    rows += [(100 + i, text(rng, "en", 40 + 20 * i) + " " + text(rng, "es", 60), None) for i in range(6)]  # two languages
    rows += [(200, text(rng, "de", 30_000), "de"), (201, None, "de"), (202, "", "en"), (203, "12 34 !!", "en"), (204, "a", "es"), (205, "DER DIE UND", None), (206, "日本語", "en"), (207, "the of", "")]
    rows += [(None, text(rng, "fr" if "fr" in WORDS else "de", 9), "de"), (300, "…\x00\n", "en"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, languages string, score double").repartition(3)
    got = langmix.identified(df).collect()
    assert len(got) == len(rows)
    want = brute(rows, langmix.BUCKETS)
    for r in got:
        lang, share = want[r.doc_id]
        assert (r.lang_pred, r.held_out) == (lang, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2), r
        assert abs(r.score - share) < 1e-3
    assert any(len(r.languages) == 2 for r in got if r.doc_id and 100 <= r.doc_id < 200)


def test_em_reaches_a_stationary_point():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(50), 3).T
    n = rng.multinomial(4000, p @ [0.6, 0.3, 0.1]).astype(float)
    share = langmix.fitted(p, n, np.ones(3) / 3)
    assert abs(share.sum() - 1) < 1e-9
    gradient = (n / (p @ share)) @ p / n.sum()
    assert np.abs(gradient[share > 1e-3] - 1).max() < 1e-3
    loss = lambda s: n @ np.log(p @ s)
    assert all(loss(share) >= loss(s) - 1e-6 for s in rng.dirichlet(np.ones(3), 500))


def test_nothing_to_learn_from_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string"
    assert langmix.identified(spark.createDataFrame([], schema)).collect() == []
    got = langmix.identified(spark.createDataFrame([(1, "hello there", None), (2, None, None)], schema)).collect()
    assert [(r.lang_pred, r.score, r.languages) for r in got] == [("und", 0.0, [])] * 2


def test_extra_columns_stay_and_the_model_is_bounded(spark):
    docs = spark.createDataFrame([("the of and", "x", 1), ("der die und", "y", 2)], "text string, lang_pred string, n int")
    model = langmix.learned(spark.createDataFrame([("the of and", f"l{i:03}") for i in range(200)], "text string, lang string"))
    assert len(model.names) == 200 and model.p.nbytes <= langmix.MODEL_BYTES
    assert np.allclose(model.p.sum(0), 1)
    out = langmix.predicted(docs, model)
    assert out.columns == ["text", "n", "lang_pred", "score", "languages", "shares"] and out.count() == 2


def test_bytes_that_are_no_utf8():
    raw = pa.array([b"the \xff\xfe of", b"und der"], pa.binary())
    texts = pa.StringArray.from_buffers(len(raw), raw.buffers()[1], raw.buffers()[2])
    assert sum(len(b) for _, b in langmix.buckets(texts, 1 << 10)) > 5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    want = dict(zip(*(pq.read_table(f"{sf}/documents.parquet")[c].to_pylist() for c in ("doc_id", "lang"))))
    got = queries.op12_language_mixtures(spark, sf).filter(F.col("held_out")).collect()
    assert len(got) > 150 and np.mean([r.lang_pred == want[r.doc_id] for r in got]) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)
