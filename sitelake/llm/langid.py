"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.llm.batches import by_size

#: Characters of the longest n-grams.
ORDER = 4
#: About so many documents of each language are learned from.
SAMPLE_PER_LANGUAGE = 3000
#: One in so many of them sets the calibration instead.
CALIBRATION = 5
#: The share of a language's own calibration texts that may be rejected.
REJECTED = 0.005
DISCOUNT = 0.75
UNKNOWN = "und"
_SPACE = 32


def letters(text: str) -> np.ndarray:
    """Lower-case letters as code points; runs of anything else become one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letter_table()[points]
    out = np.where(is_letter, points, _SPACE)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return out[keep]


_tables: dict[str, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """Per process, whether each code point is a letter."""
    if not _tables:
        _tables["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


def _multipliers(order: int) -> np.ndarray:
    """Odd 64-bit numbers, from a fixed seed, that mix the characters of a gram."""
    return np.random.default_rng(20_240_607).integers(0, 1 << 63, order, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """A hash per position of the ``order`` characters that end there; spaces lead."""
    padded = np.concatenate([np.full(order - 1, _SPACE, np.uint64), points.astype(np.uint64)]) + np.uint64(1)
    total = np.full(len(points), order, np.uint64)
    for i, m in enumerate(_multipliers(order)):
        total = total + padded[order - 1 - i : len(padded) - i] * m
    return total


@dataclass
class Model:
    """Sorted hash arrays: per order the grams, and per language their probabilities.

    ``chance[k]`` holds full interpolated probabilities of grams of order k+1 and
    ``back[k]`` the mass that a context of k characters leaves to shorter grams.
    A gram that no language has seen is scored from its longest seen suffix.
    """

    languages: list[str]
    grams: list[np.ndarray]
    chance: list[np.ndarray]
    contexts: list[np.ndarray]
    back: list[np.ndarray]
    floor: float
    sharpness: float
    limit: np.ndarray

    def logs(self, windows: np.ndarray) -> np.ndarray:
        """log2 probability per language of the last character of each window."""
        order = windows.shape[1]
        total = np.full((len(windows), len(self.languages)), self.floor)
        multipliers = _multipliers(order)
        mixed = (windows.astype(np.uint64) + np.uint64(1))[:, ::-1] * multipliers
        for k in range(1, order + 1):
            gram = mixed[:, :k].sum(axis=1, dtype=np.uint64) + np.uint64(k)
            context = self._context_hash(windows, k)
            at, seen = _find(self.contexts[k - 1], context)
            lower = np.where(seen[:, None], self.back[k - 1][at] * total, total)
            at, seen = _find(self.grams[k - 1], gram)
            # A table row is 0 where the language has not seen the gram.
            own = np.where(seen[:, None], self.chance[k - 1][at], 0)
            total = lower + own
        return np.log2(total)

    @staticmethod
    def _context_hash(windows: np.ndarray, k: int) -> np.ndarray:
        """The k-1 characters before the last one, hashed as grams of that order."""
        if k == 1:
            return np.zeros(len(windows), np.uint64)
        part = (windows[:, -k:-1].astype(np.uint64) + np.uint64(1))[:, ::-1]
        return (part * _multipliers(windows.shape[1])[: k - 1]).sum(axis=1, dtype=np.uint64) + np.uint64(k - 1)

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits per character of each text in each language; no letters give nan."""
        sizes = np.array([len(t) for t in texts])
        out = np.full((len(texts), len(self.languages)), np.nan)
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        order = len(self.grams)
        hashes = np.concatenate([gram_hashes(texts[i], order) for i in full])
        codes, different = pd.factorize(hashes)
        first = np.empty(len(different), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        lead = np.full(order - 1, _SPACE, np.uint32)
        joined = np.concatenate([np.concatenate([lead, texts[i].astype(np.uint32)]) for i in full])
        # Each text is preceded by its own spaces, so positions shift by text.
        shift = np.repeat((np.arange(len(full)) + 1) * (order - 1), sizes[full])
        ends = first + shift[first]
        windows = joined[ends[:, None] + np.arange(-order + 1, 1)]
        logs = self.logs(windows)
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for j in range(len(self.languages)):
            out[full, j] = -np.add.reduceat(logs[codes, j], starts) / sizes[full]
        return out

    def judge(self, entropy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, calibrated probability, and whether it is rejected."""
        known = ~np.isnan(entropy[:, 0])
        safe = np.where(known[:, None], entropy, 0)
        best = safe.argmin(axis=1)
        gap = safe - safe.min(axis=1, keepdims=True)
        score = 1 / np.exp2(-self.sharpness * gap).sum(axis=1)
        rejected = safe.min(axis=1) > self.limit[best]
        return np.where(known, best, -1), np.where(known, score, 0.0), rejected | ~known


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def kneser_ney(counts: list[dict[str, int]], order: int, discount: float = DISCOUNT) -> tuple[list, list, list, list, float]:
    """Tables of all languages from their counts of ``order``-grams.

    The longest grams count occurrences. Shorter ones count in how many different
    characters they continue to the left, which is how many longer types end in
    them. Each probability keeps its discounted share; the mass set free goes to
    the distribution one character shorter, and at the end to a uniform one.
    """
    multipliers = _multipliers(order)
    languages = len(counts)
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
    alphabet = set()
    for table in counts:
        grams = np.array(list(table), dtype=f"<U{order}")
        points = grams.view(np.uint32).reshape(len(grams), order) if len(grams) else np.zeros((0, order), np.uint32)
        number = np.fromiter(table.values(), float, len(table))
        alphabet.update(np.unique(points).tolist())
        for k in range(order, 0, -1):
            levels[k - 1].append((points, number))
            points, number = np.unique(points[:, 1:], axis=0, return_counts=True) if k > 1 else (points, number)
            number = number.astype(float)
    floor = 1 / (len(alphabet) + 1)
    grams_out, chance_out, contexts_out, back_out = [], [], [], []
    for k in range(1, order + 1):
        def hashed(points: np.ndarray, size: int) -> np.ndarray:
            part = (points.astype(np.uint64) + np.uint64(1))[:, ::-1] * multipliers[:size]
            return part.sum(axis=1, dtype=np.uint64) + np.uint64(size)

        gram_keys = [hashed(p, k) for p, _ in levels[k - 1]]
        context_keys = [hashed(p[:, :-1], k - 1) if k > 1 else np.zeros(len(p), np.uint64) for p, _ in levels[k - 1]]
        grams = np.unique(np.concatenate(gram_keys))
        contexts = np.unique(np.concatenate([*context_keys, np.zeros(1, np.uint64)]))
        chance = np.zeros((len(grams), languages))
        back = np.ones((len(contexts), languages))
        for j, (_, number) in enumerate(levels[k - 1]):
            if not len(number):
                continue
            at = np.searchsorted(contexts, context_keys[j])
            mass = np.bincount(at, number, len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            has = mass > 0
            back[has, j] = discount * kinds[has] / mass[has]
            chance[np.searchsorted(grams, gram_keys[j]), j] = np.maximum(number - discount, 0) / mass[at]
        grams_out.append(grams)
        chance_out.append(chance)
        contexts_out.append(contexts)
        back_out.append(back)
    return grams_out, chance_out, contexts_out, back_out, floor


def _gram_counts(order: int):
    """Counts per language of character n-grams, added up within each batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in by_size(frames, "_text"):
            for language, rows in part.groupby("_lang"):
                points = [letters(t) for t in rows["_text"]]
                points = [p for p in points if len(p)]
                if not points:
                    continue
                hashes = np.concatenate([gram_hashes(p, order) for p in points])
                codes, different = pd.factorize(hashes)
                first = np.empty(len(different), np.int64)
                first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
                lead = np.full(order - 1, _SPACE, np.uint32)
                joined = np.concatenate([np.concatenate([lead, p.astype(np.uint32)]) for p in points])
                shift = np.repeat((np.arange(len(points)) + 1) * (order - 1), [len(p) for p in points])
                ends = first + shift[first]
                grams = np.ascontiguousarray(joined[ends[:, None] + np.arange(-order + 1, 1)])
                text = grams.view(f"<U{order}").ravel()
                yield pd.DataFrame({"lang": language, "gram": text.astype(object), "n": np.bincount(codes)})

    return run


def fit(
    docs: DataFrame,
    learn: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    order: int = ORDER,
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> Model | None:
    """Learn one model per language from rows for which ``learn`` (over ``_id``) holds.

    About ``per_language`` documents of each language are drawn by a hash of their
    id, whatever the size of the table, so the model's size is bounded by the
    languages. Four in five count n-grams; the fifth sets the sharpness of the
    probabilities and, per language, the cross-entropy beyond which a text is
    rejected. Rows without language, text or letters teach nothing; without any
    language there is no model.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).filter(
        learn & F.col("_lang").isNotNull() & F.col("_text").isNotNull()
    )
    count = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}
    if not count:
        return None
    languages = sorted(count)
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shares = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / count[k]))])
    drawn = rows.filter(place < shares[F.col("_lang")])
    check = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(CALIBRATION)) == 0
    grams = drawn.filter(~check).mapInPandas(_gram_counts(order), "lang string, gram string, n long")
    total = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    tables: list[dict[str, int]] = []
    for language in languages:
        own = total[total["lang"] == language]
        tables.append(dict(zip(own["gram"], own["n"], strict=True)))
    if not any(tables):
        return None
    grams_, chance, contexts, back, floor = kneser_ney(tables, order)
    model = Model(languages, grams_, chance, contexts, back, floor, 1.0, np.full(len(languages), np.inf))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in by_size(frames, "_text"):
            points = [letters(t) for t in part["_text"]]
            entropy = shared.value.entropies(points)
            known = ~np.isnan(entropy[:, 0])
            yield pd.DataFrame({"lang": part["_lang"][known], "bits": list(entropy[known])})

    held = drawn.filter(check).mapInPandas(measure, "lang string, bits array<double>").toPandas()
    _calibrate(model, held)
    return model


def _calibrate(model: Model, held: pd.DataFrame) -> None:
    if held.empty:
        return
    bits = np.stack(held["bits"].to_numpy())
    truth = held["lang"].map({k: i for i, k in enumerate(model.languages)}).to_numpy()
    gap = bits - bits.min(axis=1, keepdims=True)

    def loss(sharpness: float) -> float:
        return (sharpness * gap[np.arange(len(truth)), truth] + np.log2(np.exp2(-sharpness * gap).sum(axis=1))).mean()

    grid = np.exp2(np.linspace(-2, 7, 46))
    model.sharpness = float(min(grid, key=loss))
    for i in range(len(model.languages)):
        own = bits[truth == i, i]
        if len(own):
            model.limit[i] = np.quantile(own, 1 - REJECTED)


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits, rejected`` of every row, from its whole text.

    ``lang_pred`` has the lowest cross-entropy per character; of equal ones, the
    first by name. ``rejected`` marks texts that fit even their best language
    worse than nearly all its own texts do. Null texts and texts without letters
    are ``und`` with score 0, as is everything where there is no model. Repeated
    rows are judged alike; an empty table gives no rows; other columns are not
    carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for part in by_size(frames, "_text"):
            points = [letters(t) if isinstance(t, str) else np.zeros(0, np.uint32) for t in part["_text"]]
            if model is None:
                best, score = np.full(len(part), -1), np.zeros(len(part))
                bits, rejected = np.full(len(part), np.nan), np.ones(len(part), bool)
            else:
                entropy = model.entropies(points)
                best, score, rejected = model.judge(entropy)
                bits = entropy.min(axis=1)
            names = [UNKNOWN if b < 0 else model.languages[b] for b in best]
            yield pd.DataFrame(
                {
                    "doc_id": part["_id"],
                    "lang_pred": names,
                    "score": score,
                    "bits": pd.Series(bits).astype(object).where(~np.isnan(bits), None),
                    "rejected": rejected,
                }
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInPandas(
        run, f"doc_id {kind}, lang_pred string, score double, bits double, rejected boolean"
    )
