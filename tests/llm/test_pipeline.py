"""The pipeline against its stages in plain Python."""

from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sitelake.llm import quality, queries
from sitelake.plans.tables import table
from tests.llm import helpers

SF = "/root/testdata/sf0.001"


def masked(text):
    out, at = [], 0
    for start, _, end, kind in helpers.base_spans(text):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_pipeline_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    ranker = quality.fit(docs, table(spark, SF, "labels"), queries._id_learns(5, 0))
    good = {r.doc_id for r in quality.scored(docs, ranker).collect() if r.predicted}
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good)
    groups = helpers.similar_groups([(i, t) for i, t, _ in rows])
    rows = [(i, masked(t), s) for i, t, s in rows if groups[i] == i]
    copies = {i: c for i, z, *_, c in helpers.mixture(rows) if z}
    library = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    want = Counter()
    for i, t, _ in rows:
        ids = np.array(library.encode(t, add_special_tokens=False).ids, "<u4")
        want[i, len(ids), ids.tobytes()] += copies.get(i, 0)
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want and len(got) > 50


def test_stages_keep_the_columns_and_take_nothing(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
