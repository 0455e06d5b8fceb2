"""The near-duplicate stage of the pipeline: planted copies."""

import numpy as np

import corpus_pipeline
from sitelake.llm import simhash
from tests.llm import helpers

DOCS = "doc_id long, text string"


def stage_of(spark, rows):
    return corpus_pipeline.no_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()


def jaccard(a, b):
    a, b = ({" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def planted():
    """Texts of 200 words, and near copies of them with some words replaced."""
    draw = np.random.default_rng(4)
    rows, kept, far = [], set(), 0
    for i in range(60):
        words = [f"w{n}" for n in draw.integers(0, 5000, 200)]
        copy = list(words)
        for at in draw.choice(200, 1 + i % 6, replace=False):
            copy[at] = "new"
        text, other = " ".join(words), " ".join(copy)
        rows += [(2 * i, text), (2 * i + 1, other)]
        kept.add(2 * i)
        if jaccard(text, other) < 0.8:
            kept.add(2 * i + 1)
            far += 1
    assert 10 < far < 40
    return rows, kept


def test_copies_from_a_similarity_of_0_8_go(spark):
    rows, kept = planted()
    assert {r.doc_id for r in stage_of(spark, rows)} == kept


def test_chains_within_a_band_are_one_group(spark):
    # Each text is near the next one only.
    words = [f"w{n}" for n in range(400)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 200])) for i in range(20)]
    want = helpers.groups([(a, b) for a, s in rows for b, t in rows if jaccard(s, t) >= 0.8])
    assert {r.doc_id for r in stage_of(spark, rows)} == set(want.values())


def test_rows_are_told_apart_without_ids(spark):
    x, y, z = (" ".join(f"{c}{n}" for n in range(40)) for c in "xyz")
    rows = [(5, z), (5, y), (2, y), (None, x), (None, x), (None, y)]
    for kept in (stage_of(spark, rows), simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()):
        assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, x), (2, y), (5, z)]


def test_a_large_family_against_all_pairs(spark):
    # One text with ever more words replaced, so that few pairs of many are similar,
    # and unrelated texts that share a passage.
    draw = np.random.default_rng(8)
    base = [f"w{n}" for n in draw.integers(0, 5000, 150)]
    passage = " ".join(f"p{n}" for n in range(12))
    rows = []
    for i in range(150):
        words = list(base)
        for at in draw.choice(150, int(draw.integers(0, 12)), replace=False):
            words[at] = f"n{draw.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(150, 200):
        rows.append((i, passage + " " + " ".join(f"u{n}" for n in draw.integers(0, 10**6, 60))))
    want = helpers.similar_groups(rows)
    assert 60 < len(set(want.values())) < 170
    assert {r.doc_id for r in stage_of(spark, rows)} == set(want.values())


def test_odd_rows_and_clashing_columns(spark):
    odd = helpers.odd_documents(spark).withColumnsRenamed({"fp": "set", "spans": "key", "size": "row"})
    kept = stage_rows(corpus_pipeline.no_near_duplicates(spark, odd, ""))
    texts = {(i, t) for i, t in helpers.ODD_TEXTS if i not in (2, 3)}
    assert kept == sorted(texts, key=repr)
    assert corpus_pipeline.no_near_duplicates(spark, odd.limit(0), "").columns == odd.columns


def stage_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
