"""Stupid-backoff scores of documents against the n-gram counts of their corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.batches import by_size
from sitelake.session import new_folder, stage

ORDER = 2
BACKOFF = 0.4
SEED = 42
#: Characters of a pack of documents, whose n-grams travel together.
PACK_CHARS = 12_000_000
#: Words of the corpus for each part of the count tables, and the fewest parts.
PART_WORDS = 4_000_000
LEAST_PARTS = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def gram_hashes(words: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of ``order`` words that end at each word, and where there is one.

    ``starts`` holds for each word how many words of its document precede it: a
    gram never reaches over the beginning of its document.
    """
    total = words.copy()
    for k in range(1, order):
        total[k:] = (total[k:] * _MIX) ^ (words[:-k] + np.uint64(k))
        total[k:] ^= total[k:] >> np.uint64(29)
    return total, starts >= order - 1


def pack_documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Packs of documents: ids, numbers of words, and the words as codes of 64-bit hashes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in by_size(frames, "_text", PACK_CHARS):
            words = [words_of(t) for t in part["_text"]]
            sizes = np.array([len(w) for w in words], "<i4")
            flat = np.empty(int(sizes.sum()), object)
            flat[:] = [w for ws in words for w in ws]
            codes, different = pd.factorize(flat)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in different), np.uint64, len(different))
            yield pd.DataFrame(
                {
                    "ids": [part["_id"].tolist()],
                    "sizes": [sizes.tobytes()],
                    "codes": [codes.astype("<u4").tobytes()],
                    "hashes": [hashes.tobytes()],
                    "n": [len(flat)],
                }
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"ids array<{kind}>, sizes binary, codes binary, hashes binary, n long"
    packs = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInPandas(run, schema)
    packs = packs.withColumn("pack", F.monotonically_increasing_id())
    path = new_folder(docs.sparkSession, "ngram-packs")
    packs.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(packs.schema).parquet(path)


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, its place in its document, and the document's number."""
    sizes = np.frombuffer(row["sizes"], "<i4")
    words = np.frombuffer(row["hashes"], np.uint64)[np.frombuffer(row["codes"], "<u4")]
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return words, place, np.repeat(np.arange(len(sizes)), sizes)


def _exploded(packs: DataFrame, order: int, bits: int) -> DataFrame:
    """The different grams of each pack, with counts, cut by the first bits of their hash."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for frame in frames:
            for _, row in frame.iterrows():
                words, place, _ = _unpack(row)
                for k in range(1, order + 1):
                    grams, there = gram_hashes(words, place, k)
                    different, count = np.unique(grams[there], return_counts=True)
                    cuts = [0, *np.searchsorted(different, edges).tolist(), len(different)]
                    spans = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield pd.DataFrame(
                        {
                            "pack": row["pack"],
                            "part": range(len(spans)),
                            "k": k,
                            "grams": [different[a:b].tobytes() for a, b in spans],
                            "counts": [count[a:b].astype("<u4").tobytes() for a, b in spans],
                        }
                    )

    return packs.select("pack", "sizes", "codes", "hashes").mapInPandas(
        run, "pack long, part int, k int, grams binary, counts binary"
    )


def _counted(frame: pd.DataFrame) -> pd.DataFrame:
    """One part of the count tables, joined with the grams that asked for it.

    Counts of all packs add up to the table of this part of the hashes; each pack
    gets back the counts of its own grams, in its order.
    """
    out = []
    for _, rows in frame.groupby("k"):
        grams = [np.frombuffer(x, np.uint64) for x in rows["grams"]]
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in rows["counts"]])
        table, where = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(where, counts, len(table)).astype("<u8")
        found = total[where]
        cuts = np.cumsum([0, *map(len, grams)])
        answers = [found[a:b].astype("<u4" if len(found) and found.max() < 1 << 32 else "<u8") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out.append(rows[["pack", "part", "k"]].assign(wide=[a.itemsize for a in answers], found=[a.tobytes() for a in answers]))
    return pd.concat(out)


def document_logs(
    words: np.ndarray, place: np.ndarray, doc: np.ndarray, totals: list[np.ndarray], size: float, order: int
) -> np.ndarray:
    """log10 of the stupid-backoff score of every word.

    ``totals`` has per order the corpus counts of the sorted different grams. A
    document's own occurrences are taken off all counts, so that it is judged by
    the others alone; a gram that only it has backs off.
    """
    position = np.arange(len(words))
    left: list[np.ndarray] = []
    there: list[np.ndarray] = []
    for k in range(1, order + 1):
        grams, has = gram_hashes(words, place, k)
        at = position[has]
        _, gram = np.unique(grams[has], return_inverse=True)
        pair = doc[has].astype(np.int64) * (len(totals[k - 1]) + 1) + gram
        _, spot, own = np.unique(pair, return_inverse=True, return_counts=True)
        rest = np.zeros(len(words))
        rest[at] = totals[k - 1][gram] - own[spot]
        left.append(rest)
        there.append(has)
    length = np.bincount(doc, minlength=int(doc.max(initial=-1)) + 1)
    others = np.maximum(size - length[doc], 0)
    # A word that no other document has counts as a fraction of one occurrence.
    score = np.where(left[0] > 0, left[0], BACKOFF) / np.maximum(others, 1)
    for k in range(2, order + 1):
        context = np.zeros(len(words))
        context[1:] = left[k - 2][:-1]
        seen = there[k - 1] & (left[k - 1] > 0) & (context > 0)
        # A word without so long a history keeps its score as it is.
        score = np.where(seen, left[k - 1] / np.maximum(context, 1), np.where(there[k - 1], BACKOFF, 1.0) * score)
    return np.log10(np.minimum(score, 1.0))


def score(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER
) -> DataFrame:
    """``doc_id, n_words, log10_score, mean_log10`` of every row, from its whole text.

    Counts are those of all documents but the one that is scored. The different
    grams of a pack of documents, a bounded size of text, go to the part of the
    count tables that their hash names; there the counts of all packs are added
    and each pack gets back those of its own. Parts grow in number with the
    corpus, so none of them does in size, and a frequent gram is one entry per
    pack.

    Null and empty texts have no words, a score of 0 and no mean; repeated rows
    count as documents of their own; an empty table gives no rows; other columns
    are not carried. Grams are told apart by 64-bit hashes.
    """
    packs = pack_documents(docs, doc_id, text)
    size = packs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(LEAST_PARTS - 1, size // PART_WORDS).bit_length()
    counted = _exploded(packs, order, bits).groupBy("part").applyInPandas(
        _counted, "pack long, part int, k int, wide int, found binary"
    )
    counted = stage(counted, "ngram-counts")
    kind = docs.schema[doc_id].dataType.simpleString()

    def judge(key: tuple, pack: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = pack.iloc[0]
        words, place, doc = _unpack(row)
        totals = []
        for k in range(1, order + 1):
            own = answers[answers["k"] == k].sort_values("part")
            parts = [np.frombuffer(x, f"<u{w}").astype(float) for x, w in zip(own["found"], own["wide"], strict=True)]
            totals.append(np.concatenate([np.zeros(0), *parts]))
        logs = document_logs(words, place, doc, totals, float(size), order)
        count = len(row["ids"])
        n = np.bincount(doc, minlength=count)
        total = np.bincount(doc, logs, count)
        mean = pd.Series(total / np.maximum(n, 1)).astype(object).where(n > 0, None)
        return pd.DataFrame({"doc_id": list(row["ids"]), "n_words": n, "log10_score": total, "mean_log10": mean})

    return packs.groupBy("pack").cogroup(counted.groupBy("pack")).applyInPandas(
        judge, f"doc_id {kind}, n_words long, log10_score double, mean_log10 double"
    )
