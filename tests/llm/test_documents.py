"""Operators on documents: odd rows, and results against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitelake.llm import bpe, langid, mixing, ngrams, pii, quality, queries, simhash
from sitelake.plans.tables import table
from tests.llm import helpers

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path(queries.TOKENIZER)


@pytest.fixture(scope="module")
def odd(spark):
    return helpers.odd_documents(spark).cache()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in table(spark, SF, "documents").collect()}


def all_rows():
    return len(helpers.ODD_TEXTS)


# --- 1: language ------------------------------------------------------------


def test_languages_on_held_out_documents(spark, texts):
    rows = queries.op1_language_id(spark, SF).collect()
    assert len(rows) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r.lang_pred == texts[r.doc_id].lang for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd):
    learn = spark.createDataFrame(
        [(i, "the cat and the dog " * 5, "en") for i in range(30)] + [(i + 50, "der hund und die katze " * 5, "de") for i in range(30)],
        "doc_id long, text string, lang string",
    )
    model = langid.fit(learn, F.col("_id") >= 0)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == all_rows()
    none = [r for r in rows if r.doc_id in (1, 2, 3, 4)]
    assert all(r.lang_pred == "und" and r.score == 0 and r.bits is None and r.rejected for r in none)
    assert {r.lang_pred for r in rows if r.doc_id in (5, 7, 8)} <= {"en", "de"}
    assert [r for r in rows if r.doc_id == 9][0].rejected
    assert langid.identify(learn.limit(0), model).collect() == []


def test_language_without_anything_to_learn(spark, odd):
    assert langid.fit(odd, F.lit(True)) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_kneser_ney_probabilities_add_up():
    counts = Counter()
    for text in ("abcab", "abba", "cab"):
        padded = "  " + text
        counts.update(padded[i : i + 3] for i in range(len(text)))
    grams, chance, contexts, back, floor = langid.kneser_ney([dict(counts)], 3)
    model = langid.Model(["x"], grams, chance, contexts, back, floor, 1.0, np.array([np.inf]))
    for context in ("  ", " a", "ab", "ca", "bb"):
        windows = np.array([[*map(ord, context + c)] for c in "abc "], np.uint32)
        total = np.exp2(model.logs(windows)).sum() + 0.0
        assert total <= 1.0 + 1e-9 and total > 0.9 - floor


# --- 2: SimHash -------------------------------------------------------------


def test_fingerprints_and_components(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 20
    texts = [(i, base + f"w{i % 7} " * (i % 5)) for i in range(60)]
    texts += [(100 + i, " ".join(f"{i}x{j}" for j in range(40))) for i in range(40)] + [(5, texts[5][1])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == len(texts)
    prints = {i: helpers.fingerprint(t) for i, t in texts}
    assert all(r.fp & (1 << 64) - 1 == prints[r.doc_id] for r in rows)
    want = helpers.near_groups(list(prints.items()))
    assert {r.doc_id: r.component_id for r in rows} == want


def test_vantage_trees_find_all_pairs():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = base[:900] ^ (np.uint64(1) << draw.integers(0, 64, 900, dtype=np.uint64))
    dense = np.uint64(12345) ^ draw.integers(0, 1 << 9, 400, dtype=np.uint64)
    points = np.unique(np.concatenate([base, near, dense]))
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    want = simhash.Links(len(points))
    want.join(a, b)
    tree, leaves = simhash.grow(points[:800], 9)
    index, leaf, home = simhash.place(tree, points, 3)
    assert home.sum() == len(points) and leaves > 4
    got = simhash.Links(len(points))
    for i in range(leaves):
        here, own = index[leaf == i], home[leaf == i]
        links = simhash.Links(len(here))
        simhash.link(points[here], own, 3, links)
        got.join(here, here[links.roots()])
    assert (got.roots() == want.roots()).all()


def test_one_shard_by_several_tasks(spark):
    prints = [(i ^ 7) - (1 << 62) for i in range(300)]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    edges = [(r.a, r.b) for r in simhash.linked_pairs(df, 3, shard=40).collect()]
    found = helpers.groups(edges)
    assert len(set(found.values())) == 1 and len(found) == len(prints)


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == all_rows()
    zero = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert all(r.fp == 0 and r.component_id == 1 for r in zero)
    assert [r.component_id for r in rows if r.doc_id == 6] == [6, 6]
    assert simhash.near_duplicates(odd.limit(0)).collect() == []
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 9]


# --- 3: n-gram scores -------------------------------------------------------


def brute_scores(rows, order):
    words = [ngrams.words_of(t) for _, t in rows]

    def counted(ws):
        return [Counter(tuple(ws[j - k + 1 : j + 1]) for j in range(k - 1, len(ws))) for k in range(1, order + 1)]

    own = [counted(w) for w in words]
    total = [sum((o[k] for o in own), Counter()) for k in range(order)]
    size = sum(map(len, words))
    for (i, _), w, mine in zip(rows, words, own, strict=True):
        out = 0.0
        for j in range(len(w)):
            left = [total[k][g] - mine[k][g] if j >= k else 0 for k in range(order) for g in [tuple(w[j - k : j + 1])]]
            s = (left[0] or 0.4) / max(size - len(w), 1)
            for k in range(1, order):
                if j < k:
                    continue
                context = tuple(w[j - k : j])
                below = total[k - 1][context] - mine[k - 1][context]
                s = left[k] / below if left[k] > 0 and below > 0 else 0.4 * s
            out += math.log10(min(s, 1.0))
        yield i, len(w), out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_brute_force(spark, order):
    rows = [(i, " ".join(f"W{(i * j) % 11} the" for j in range(i % 13))) for i in range(40)] + [(99, None), (7, "The end")]
    got = ngrams.score(spark.createDataFrame(rows, "doc_id long, text string"), order=order).collect()
    want = Counter((i, n, round(s, 8)) for i, n, s in brute_scores(rows, order))
    assert Counter((r.doc_id, r.n_words, round(r.log10_score, 8)) for r in got) == want


def test_scores_of_odd_rows(spark, odd):
    rows = ngrams.score(odd).collect()
    assert len(rows) == all_rows()
    assert all(r.n_words == 0 and r.log10_score == 0 and r.mean_log10 is None for r in rows if r.doc_id in (1, 2, 3))
    assert ngrams.score(odd.limit(0)).collect() == []


# --- 5: mixing --------------------------------------------------------------


def test_mixture_against_brute_force(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 5}" if i % 9 else None) for i in range(200)]
    rows += [(900, "big " * 3000, "s1"), (901, None, "s2"), (902, "", "lone"), (5, "w " * 5, "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).copies().collect()
    want = Counter((i, z, s, round(t, 6), c) for i, z, s, t, c in helpers.mixture(rows))
    assert Counter((r._id, r._size, r._source_size, round(r._target, 6), r._copies) for r in got) == want
    copies = Counter(r.doc_id for r in mixing.mixed(df).collect())
    assert copies == Counter({k: v for k, v in ((r._id, r._copies) for r in got if r._size and r._id != 5) if v}) + Counter(
        {5: sum(r._copies for r in got if r._id == 5 and r._size)}
    )
    # Targets are met within half a document.
    for source in {r._target for r in got}:
        own = [r for r in got if r._target == source]
        assert abs(sum(r._size * r._copies for r in own) - source) <= max(r._size for r in own) / 2 + 1e-6


def test_mixture_of_odd_rows(spark, odd):
    rows = mixing.mix(odd).copies().collect()
    assert len(rows) == all_rows() and all(r._copies == (r._size > 0) for r in rows)
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in mixed.collect()) == [0, 4, 5, 6, 6, 7, 8, 9]
    assert mixing.mix(odd.limit(0)).copies().collect() == []
    assert mixing.mixed(odd.limit(0)).collect() == []


# --- 8: BPE -----------------------------------------------------------------


def test_tokens_against_the_library(spark, odd):
    library = Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    library.no_padding()
    extra = [(20, "it's I'LL 'd'VE <|endoftext|>x<|startoftext|> <|EndOfText|>"), (21, "ab" * 5000), (22, "1234 5.6e-7 ½ ²"), (23, "ÉÀ é Å ΑΣ ΣΑΣ İI")]
    rows = [*helpers.ODD_TEXTS, *extra]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.encode(df, TOKENIZER, decoded=True).collect())
    want = Counter()
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    coded = bpe.encode(df, TOKENIZER)
    assert {r.doc_id: r.decoded for r in bpe.decode(coded, TOKENIZER).collect()} == {i: d for i, _, d in want}
    assert bpe.encode(odd.limit(0), TOKENIZER).collect() == []


def test_token_digests(spark, texts):
    library = Tokenizer.from_file(TOKENIZER)
    for r in queries.op8_bpe(spark, SF).limit(50).collect():
        ids = library.encode(texts[r.doc_id].text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- 9: quality -------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    rows = queries.op9_quality(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert sum(held) / len(held) > 0.95


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1), (8, 0), (8, 0), (9, None), (None, 1), (77, 1)], "doc_id long, quality int")
    ranker = quality.fit(odd, labels, F.lit(True))
    rows = quality.scored(odd, ranker).collect()
    assert len(rows) == all_rows() and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_good(odd, ranker).columns == odd.columns
    assert quality.scored(odd.limit(0), ranker).collect() == []
    nothing = quality.fit(odd, labels.limit(0), F.lit(True))
    assert {(r.score, r.predicted) for r in quality.scored(odd, nothing).collect()} == {(0.5, 1)}


def test_preferences_order_documents():
    draw = np.random.default_rng(0)
    good, bad = draw.normal(1, 1, (300, 3)), draw.normal(-1, 1, (100, 3))
    weights = quality.fit_pairs(good, bad)
    # Every edge of the bins tried in turn.
    edges = np.linspace(-10, 10, 101)
    fine, poor = (np.histogram(np.clip(x @ weights, -9.9, 9.9), edges)[0] for x in (good, bad))
    wrong = [fine[:k].sum() + poor[k:].sum() for k in range(101)]
    cut = quality.best_cut(fine, poor)
    assert wrong[cut] == min(wrong) < 30 and quality.best_cut(np.array([0, 0, 0, 5]), np.array([5, 0, 0, 0])) == 2


def test_quality_of_repeated_and_shared_ids(spark):
    """Against plain Python: the cut leaves as few labelled rows on the wrong side as any other, repeats included."""
    draw = np.random.default_rng(3)
    word = lambda n: "".join(draw.choice(list("abcdefgh"), n))
    good = [(i, " ".join(word(5) for _ in range(40))) for i in range(60)]
    bad = [(100 + i, " ".join(draw.choice(["A!", "B#", "7"]) for _ in range(40))) for i in range(60)]
    mixed = [(200, " ".join(word(5) for _ in range(k + 5))) for k in range(50)]
    copies = [(300, "BUY!! 99")] * 400
    docs = good + bad + mixed + copies + [(None, "x"), (1, None)]
    labels = [(i, 1) for i, _ in good] * 3 + [(i, 0) for i, _ in bad] + [(200, 1), (300, 0), (300, 0), (5, 0)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    ranker = quality.fit(*frames, F.lit(True), per_label=40)
    rows = [(r.doc_id, r.score, r.predicted) for r in quality.scored(frames[0], ranker).collect()]
    assert len(rows) == len(docs)
    of = {}
    for i, label in set(labels):
        of.setdefault(i, []).append(label)
    marked = [(score, predicted, label) for i, score, predicted in rows for label in of.get(i, [])]

    def wrong(cut):
        return sum((score >= cut) != label for score, _, label in marked)

    errors = sum(predicted != label for _, predicted, label in marked)
    # Rows in one bin cannot be parted.
    assert errors <= min(wrong(score) for score, *_ in marked) + 2
    again = quality.fit(*frames, F.lit(True), per_label=40)
    assert again == ranker


# --- 10: personal data ------------------------------------------------------

PRIVATE = [
    (1, "Mail a.b@c.d, or a@b.c_d@e.f; x@y no@no. z@-.- +1 (736) 555-2678 end"),
    (2, "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1 12345678901234567890.1.1.1"),
    (3, "4111 1111 1111 1111 and 4111-1111-1111-1112, 12 - 34, 4041894974608795"),
    (4, "+1 () 2 +49 30 1234567-89 ++1 2345678901+12345678901"),
    (5, "9" * 20_000 + " a@" + "b." * 9000 + "c"),
    (6, "é@é.com éa@b.co 😀x@y.zz"),
    (7, "x" * 50_000),
]


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def test_base_spans_against_brute_force(spark, odd):
    rows = PRIVATE + [(i, t) for i, t in helpers.ODD_TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter()
    for r in pii.detect(df).collect():
        got[r.doc_id, listed([(s.start, 0, s.end, s.kind) for s in r.spans if s.base])] += 1
    assert got == Counter((i, listed(helpers.base_spans(t))) for i, t in rows)
    assert pii.detect(odd.limit(0)).collect() == []


def test_votes_add_spans_and_refuse_others(spark):
    rows = [(i, f"Please write an e-mail to user{i}@mail.example.com or call tel. +1 212 555 01{i:02d}!") for i in range(60)]
    rows += [(100, "Call the phone (212) 555-0199 now"), (101, "serial no. 212-555-01990"), (102, "account iban DE89 3704 0044 0532 0130 00.")]
    found = {r.doc_id: [s.kind for s in r.spans] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100] == ["phone_local"] and found[101] == []
    assert found[3] == ["email", "phone"]


def test_redaction(spark, odd):
    rows = [(1, "to a.b@c.de and +1 (736) 555-2678, é 10.0.0.1", "x"), (2, None, "y"), (3, "nothing", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "to <EMAIL> and <PHONE>, é <IP>" and got[1].spans == "x"
    assert got[2].text is None and got[3].text == "nothing"
    assert pii.redact(odd).count() == all_rows()
