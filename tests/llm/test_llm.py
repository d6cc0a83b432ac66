"""Training-data operators against brute force on small inputs with odd rows."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barlane.llm import bagminhash, bpe, brown, chat, debruijn, embeddings, graphs, lines, neardup, packing, quality, queries, toxicity, words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")

LONG = " ".join(f"w{i % 37}x{i % 101}" for i in range(3000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ROWS = [
    (1, PASSAGE + " one tail here"), (2, "other head " + PASSAGE), (3, None), (4, ""), (5, "one"), (6, LONG), (7, LONG), (8, LONG + " extra"),
    (9, "a\nb\nc\nd"), (10, "x\na\nb\nc\ny"), (11, "a\nb\nc\nd"), (None, PASSAGE), (None, None), (12, "  \n\t "), (13, "ünï  cödé\n\nß 漢字 don't I'll 12 34!!"),
    (5, "one"), (14, "same same same same same same same same same same same same same same same same"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("chunk", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def own(t):
    return WORD.findall(t or "")


def test_words_and_hashes():
    texts = pa.array(["a  bc\x0bd", None, "é ü", "x" * 100, ""])
    (lo, hi, data, off), = words.blocks(texts)
    start, end, row = words.spans(data, off)
    assert (lo, hi) == (0, 5)
    assert [(bytes(data[a:b]).decode(), r) for a, b, r in zip(start, end, row)] == [("a", 0), ("bc", 0), ("d", 0), ("é", 2), ("ü", 2), ("x" * 100, 3)]
    assert len(set(words.hashes(data, start, end))) == 6


def test_bpe_equals_tiktoken_and_round_trips(docs, empty):
    ranks = {p: i for i, p in enumerate(bpe.read_ranks(RANKS))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = Counter()
    for i, t in ROWS:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    assert bpe.digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    clash = bpe.encode(docs.withColumn("ids", F.lit("clash")), RANKS, public_tokenizers.PATTERN)
    assert clash.columns == ["doc_id", "text", "chunk", "n", "ids"]
    back = bpe.decode(clash.withColumn("decoded", F.lit(1)), RANKS, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back.collect())


def test_bpe_of_all_sample_documents(spark):
    ranks = {p: i for i, p in enumerate(bpe.read_ranks(RANKS))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    of = {r.doc_id: r.text for r in texts.collect()}
    for r in bpe.encode(texts, RANKS, public_tokenizers.PATTERN).collect():
        assert r.ids == enc.encode_ordinary(of[r.doc_id] or "")


def test_chunks_with_one_hash_stay_apart(monkeypatch):
    texts = pa.array(["one two ten six", "six ten two one", "abcdefghi abcdefghj", None, "x"])
    want = packing.Ids(JSON).encode(texts)
    monkeypatch.setattr(words, "hashes", lambda data, start, end, seed=0: ((end - start) % 2).astype(np.uint64))
    got = packing.Ids(JSON).encode(texts)
    assert all((a == b).all() for a, b in zip(want, got))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("ordinary", [False, True])
def test_ids_are_the_library_s(name, ordinary):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.encode_special_tokens = ordinary
    texts = ["a<|endoftext|>b", "<|endoftext|>", "", None, "plain text, and  more\n", "é 漢字 <|endoftext|> don't", LONG]
    flat, off = packing.Ids(public_tokenizers.path(name), ordinary).encode(pa.array(texts))
    for t, a, b in zip(texts, off[:-1], off[1:]):
        assert flat[a:b].tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_packing_covers_each_id_once(docs, empty):
    tok = Tokenizer.from_file(JSON)
    got = packing.pack(docs, JSON).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    want = Counter()
    for i, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want[i, len(ids)] += 1
        pieces = by_doc[i, len(ids)]
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for key, n in want.items():
        assert sum(r.length for r in by_doc[key]) == key[1] * n
    for s in by_seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(1 for s in by_seq.values() if sum(x for _, x in s) < 1024) <= 1
    assert packing.pack(empty, JSON).count() == 0


def test_repeats_never_exceed_the_histogram():
    rng = np.random.default_rng(1)
    hist = np.zeros(1025, np.int64)
    hist[1:1024] = rng.integers(0, 50, 1023)
    hist[700] = 20_000
    used = Counter()
    plan = packing.repeats(hist)
    for row, n in plan:
        assert sum(row) == 1024
        for k in row:
            used[k] += n
    assert all(v <= hist[k] for k, v in used.items()) and sum(n for _, n in plan) > 1000


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (2, None, None, "x"), (3, 0, "system", "alone"), (None, 1, "ann", "y"), (1, 70, "ann", "late")]
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k[:2] for k in got} == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann")}
    r = got[1, "ann", 0]
    assert r.rendered == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user:bob|>\n<|end|>\n"
    assert [r.rendered[slice(*map(int, m.split("-")))] for m in r.mask.split()] == ["hi<|end|>"]
    assert got[1, "ann", 1].n_messages == 1 and got[1, "bob", 1].mask == ""


def test_quality_signals_and_verdicts(docs, empty):
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    for i, t in ROWS:
        w = own(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(grams)
        repeated = len({k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)})
        if i is not None:
            assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), repeated), i
    assert quality.verdicts(empty).count() == 0


def test_quality_order_follows_planted_costs_and_selectivities(spark):
    rows = [(i, "word " * (10 + i % 10) + ("#" * 9 if i % 4 == 0 else "") + (" 7" * 40 if i % 10 < 3 else "")) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    dear = quality.Rule("dear", "n_symbols > 5", "1000")  # rejects 25 %
    cheap = quality.Rule("cheap", "n_words > 45", "100")  # rejects 30 %
    same = quality.Rule("same", "n_words > 45 AND n_words > 1", "10")  # like cheap, for a tenth
    none = quality.Rule("none", "n_words < 0", "1")
    for rules in ((dear, cheap, same, none), (none, cheap, dear, same)):
        seen = quality.estimated(df, rules, sample_rows=800)
        assert 400 < sum(s.n for s in seen) < 1600
        # once `same` has rejected them, nothing is left for `cheap`
        got = [r.name for r in quality.order(rules, seen)]
        assert got == ["same", "dear", *(r.name for r in rules if r in (cheap, none))]
    assert quality.order([none, cheap], []) == [none, cheap]


def test_quality_rules_after_a_rejection_are_not_tested(spark, docs, empty):
    df = quality.signals(docs, keep=["doc_id"], with_text=True)
    every, fails = quality.Rule("every", "n_words >= 0"), quality.Rule("fails", "raise_error(concat('tested: ', __t)) IS NULL")
    assert {r.v for r in df.select(quality.first_failed([every, fails]).alias("v")).collect()} == {"every"}
    with pytest.raises(Exception, match="tested"):
        df.select(quality.first_failed([fails, every]).alias("v")).collect()


def test_quality_replaces_clashing_columns(docs, empty):
    got = quality.cascade(docs.withColumns({"n_words": F.lit("clash"), "rejected_by": F.lit(1)}))
    assert got.columns == ["doc_id", "text", "chunk", "n", *quality.SIGNALS, "rejected_by"]
    first = {r.doc_id: r.rejected_by for r in got.collect()}
    assert first[3] == "few_words" and first[6] == "digits"
    assert quality.cascade(empty).count() == 0


def test_substring_dedup(docs, empty):
    first = {}
    for i, t in ROWS:
        w = own(t)
        for k in range(len(w) - 12) if i is not None else ():
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    want = Counter()
    for i, t in ROWS:
        w = own(t)
        gone = {k + j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    for size in (1 << 12, 8 << 20):
        got = debruijn.deduplicated(docs.withColumn("n_words", F.lit("clash")), size=size).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
        assert all(" ".join(own(r.text)) == "" or hashlib.sha256(" ".join(own(r.text)).encode()).hexdigest() == r.kept_sha256 for r in got)
    assert debruijn.deduplicated(empty).count() == 0


def test_line_dedup(docs, empty):
    got = {r.doc_id: r for r in lines.deduplicated(docs.withColumn("n_lines", F.lit("clash"))).collect()}
    assert got[9].text == "a\nb\nc\nd" and got[9].n_removed == 0
    assert got[10].text == "x\ny" and got[11].text == "" and got[11].n_removed == 4
    assert got[3].text is None and got[12].n_removed == 0
    assert lines.deduplicated(empty).count() == 0


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(0)
    a = {i: int(rng.integers(1, 9)) for i in range(300)}
    b = {i: w if rng.random() < 0.8 else int(rng.integers(1, 9)) for i, w in a.items()}
    sig = [bagminhash.signatures(np.zeros(300, int), words.mix(np.array(list(x), np.uint64)), np.array(list(x.values())), 1, 4000)[0] for x in (a, b)]
    true = sum(min(a[i], b[i]) for i in a) / sum(max(a[i], b[i]) for i in a)
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 4000)


def test_near_duplicates(spark, docs, empty):
    base = [f"t{i}" for i in range(200)]
    rows = [(100 + k, " ".join(base[: 200 - 12 * k])) for k in range(6)] + [(200, "far away text of its own " * 3), (201, " ".join(base) + " end")]
    rng = np.random.default_rng(11)  # copies on both sides of the threshold, and one long text with runs beyond 255
    for k in range(60):
        w = [f"u{i}" for i in range(300)]
        for at in rng.integers(0, 300, 4 + k % 12):
            w[at] = f"v{k}_{at}"
        rows.append((300 + k, " ".join(w)))
    rows += [(400, "ja " * 2000), (401, "ja " * 1700), (402, "ja " * 1500)]
    got = {r.doc_id: r for r in neardup.classes(spark.createDataFrame(rows + [r for r in ROWS], "doc_id long, text string")).collect()}
    bag = {i: Counter(tuple(w[k : k + 5]) for w in [own(t)] for k in range(len(w) - 4)) for i, t in rows + ROWS if i is not None}
    of = {i: i for i in bag}

    def root(i):
        return i if of[i] == i else root(of[i])

    for i in bag:
        for j in bag:
            m = sum((bag[i] & bag[j]).values())
            if i < j and m and m >= 0.8 * sum((bag[i] | bag[j]).values()):
                x, y = sorted((root(i), root(j)))
                of[y] = x
    assert {i: r.class_id for i, r in got.items() if i is not None} == {i: root(i) for i in bag}
    assert neardup.classes(empty).count() == 0
    assert neardup.deduplicated(docs).columns == docs.columns


def test_texts_of_one_id_have_classes_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, b), (2, b), (2, c), (3, a + " end"), (4, c), (4, None), (None, a), (5, b)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, t string")
    got = Counter((r.doc_id, r.class_id, r.kept) for r in neardup.classes(docs).collect())
    assert got == Counter([(1, 1, True), (2, 2, True), (2, 2, True), (2, 2, True), (3, 1, False), (4, 2, False), (4, 4, True), (None, None, True), (5, 2, False)])
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (2, b), (2, b), (2, c), (4, None), (None, a)])


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    of = graphs.roots(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), 1100)
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {r.node: r.component for r in graphs.components(spark.createDataFrame(pairs, "a long, b long"), 0).collect()}
    assert got == {i: int(of[i]) for p in pairs for i in p if p[0] != p[1] or i in got}


def test_embedding_links(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 32))
    near = base[:60] + 0.15 * rng.standard_normal((60, 32))
    vectors = [v.tolist() for v in np.concatenate([base, near, base[:5]])] + [None, [0.0] * 32, [float("nan")] * 32, [1.0] * 3]
    got = {r.vec_id: r for r in embeddings.links(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()}
    u = np.array([v for v in vectors[:365]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    n = close.sum(1)
    assert sum(got[i].n_links for i in range(365)) >= 0.9 * n.sum() > 0
    assert all(got[i].n_links <= n[i] for i in range(365))
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(365, 369)] == [(0, i, True) for i in range(365, 369)]
    assert embeddings.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):  # pairs with cosines of 0.95 to 0.955
        a, b = rng.standard_normal((2, 48))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.9501 + 0.005 * rng.random()
        rows += [(2 * i, (a * 10.0 ** rng.integers(-170, 170)).tolist()), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    docs = spark.createDataFrame([*rows, (0, rows[0][1]), (None, rows[0][1])], "vec_id long, embedding array<double>").withColumns({"id": F.lit("clash"), "bucket": F.lit(1), "v": F.lit(2)})
    got = embeddings.links(docs).collect()
    found = sum(r.component_id == r.vec_id - 1 for r in got if r.vec_id is not None and r.vec_id % 2)
    assert found >= 0.97 * 400
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert sorted(r.n_links for r in got if r.vec_id == 0) == [2, 2]  # its repeated row, and its near copy


def test_brown_counts_and_base(spark, empty):
    rows = ROWS + [(i, f"the cat {i % 7} sat on the mat") for i in range(20, 80)]
    got = brown.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    low = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in own(t)]
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in [*low(t), None])
    total, kinds = sum(c.values()), len(c)
    want = Counter((i, held(i), len(own(t)) + 1, sum(c[w] > 0 for w in [*low(t), None])) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known) for r in got) == want
    base = {i: sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in [*low(t), None]) for i, t in rows}
    assert all(r.train_tokens == total and (r.doc_id is None or abs(r.base_score - base[r.doc_id]) < 1e-6 * abs(base[r.doc_id])) for r in got)
    assert brown.score(empty).count() == 0


def test_brown_beats_the_base_on_held_out_texts(spark):
    r = queries.op9_brown_lm(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_class_model_sums_to_one():
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 9, (30, 30)).astype(float)
    of = brown.exchange(pairs, 5)
    assert of[-1] == 5 and set(of[:-1]) <= set(range(5))


def test_toxicity_on_held_out_rows(spark, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.learned(docs, labels.filter("doc_id % 5 <> 0"))
    got = toxicity.scored(docs.select("doc_id", "text"), chain).join(labels.filter("doc_id % 5 = 0"), "doc_id")
    hit = {r.toxic: r.p for r in got.groupBy("toxic").agg(F.avg((F.col("p_toxic") >= toxicity.THRESHOLD).cast("int")).alias("p")).collect()}
    assert hit[1] > 0.9 and hit[0] < 0.01
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.judged(empty, none).count() == 0


def test_toxicity_words_of_a_fold_are_chosen_without_it():
    texts = [f"common {'ab'[i % 2]} only{'cdefg'[i % 5]}" for i in range(600)]
    y = np.array([i % 2 for i in range(600)])
    own = toxicity.held(pa.array([*texts, None, ""]))
    assert own.rows == 602
    part = own.take(np.array([1, 601]))
    assert part.rows == 2 and len(part.word) == 3
    known = toxicity.telling(own.take(np.arange(600)), np.stack([y, y], 1))
    assert len(known) == 2
    assert own.known(known).dot(np.ones(2))[:3].tolist() == [1, 1, 1]
    noise = np.random.default_rng(0).integers(0, 2, 600)
    chain = toxicity.fit(own.take(np.arange(600)), np.arange(600) % toxicity.FOLDS, np.stack([y, noise], 1))
    assert abs(chain.links[1].extra[0]) < 1  # nothing of noise shows through the first link


def test_toxicity_of_odd_rows(spark, docs):
    rows = [(i, ("bad vile words here" if i % 2 else "kind calm lines here") + f" n{i}") for i in range(1000, 1400)]
    labels = spark.createDataFrame([(i, i % 2 ^ 1, i % 2) for i, _ in rows] + [(1000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    odd = [(1, None), (2, ""), (None, "vile bad words"), (3, "vile bad words here " * 300_000), (4, "calm kind lines"), (4, "calm kind lines")]
    both = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("p_toxic", F.lit("clash"))
    got = toxicity.judged(both, labels)
    toxic = Counter((r.doc_id, r.toxic) for r in got.filter("doc_id IS NULL OR doc_id < 1000").collect())
    assert toxic[None, True] == toxic[3, True] == 1 and toxic[4, False] == 2 and len(toxic) == 5
    assert got.filter("doc_id >= 1000 AND toxic <> (doc_id % 2 = 1)").count() == 0
    kept = toxicity.kept(both, labels)
    assert kept.columns == both.columns and kept.count() == got.filter("NOT toxic").count()


def test_toxicity_without_labels_rejects_nothing(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.judged(docs, none).filter("toxic").count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(repr, map(tuple, mine.select(columns).collect()))) == sorted(map(repr, theirs.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall()))
