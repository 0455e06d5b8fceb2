"""Secrets: fixed patterns, and random strings told from identifiers by Markov models."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.batches import by_size

# The base kinds, in this order, and their shortest matches.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What the models add.
RANDOM = "random"

#: Strings of letters, digits and a few signs: identifiers from so many characters
#: on, and candidates for random strings.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
LEAST_RANDOM = 16
LONG = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RANDOM},}}")
#: Symbols of the models: these, and 0 around a string.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
SIZE = len(SYMBOLS) + 1
_CODE = bytes(SYMBOLS.find(chr(i)) + 1 if i < 128 else 0 for i in range(256))
#: Weight of the shorter context in a longer one's probabilities.
SMOOTHING = 8.0
#: A random string is this many times likelier than an identifier, priors included,
#: and per character it gains this share of what drawn strings gain.
ODDS, GAIN = 1000.0, 0.5
#: Rulers, fillers and plain numbers are not random: a random string has so many
#: different characters, and a letter.
DISTINCT = 7
#: Triples that fewer identifiers show say nothing, so that a random string among
#: the identifiers does not vouch for itself.
CUTOFF = 30
LETTER = re.compile("[A-Za-z]")


# --- base spans -------------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind's place, end, value)`` of every base span, by start and kind."""
    out = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m[1]) >= LEAST_ASSIGNED:
                out.append((m.start(), 0, m.end(), m[1]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= LEAST_ACCESS:
                out.append((m.start(), 1, m.end(), m[0]))
    for m in HEX.finditer(text):
        out.append((m.start(), 2, m.end(), m[0]))
    return sorted(out)


def _without(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """The text with its spans blanked out."""
    parts, at = [], 0
    for start, _, end, _ in spans:
        if end > at:
            parts += [text[at : max(at, start)], " " * (end - max(at, start))]
            at = end
    return "".join(parts) + text[at:]


# --- models -----------------------------------------------------------------


def _codes(strings: list[str]) -> np.ndarray:
    """Symbols of all strings, each after two zeros, with one at the very end."""
    joined = "".join(["\x00\x00" + s for s in strings]) + "\x00\x00"
    return np.frombuffer(joined.encode("ascii", "replace").translate(_CODE), np.uint8).astype(np.int64)


def triples(strings: list[str]) -> np.ndarray:
    """Number of every triple of symbols, the last of which belongs to a string."""
    codes = _codes(strings)
    last = codes[2:]
    key = (codes[:-2] * SIZE + codes[1:-1]) * SIZE + last
    return np.bincount(key[last > 0], minlength=SIZE**3)


def generated(seed: int = 11, strings: int = 4000, length: int = 32) -> np.ndarray:
    """Triples of drawn strings over the alphabets that keys are usually written in."""
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    alphabets = [
        digits + "abcdef",
        digits + "ABCDEF",
        lower.upper() + "234567",
        lower + digits,
        lower + lower.upper() + digits,
        lower + lower.upper() + digits + "+/",
        lower + lower.upper() + digits + "-_",
    ]
    draw = np.random.default_rng(seed)
    drawn = [["".join(row) for row in draw.choice(list(a), (strings, length))] for a in alphabets]
    return triples([s for part in drawn for s in part])


def joined(words: list[str]) -> list[str]:
    """Identifiers as they are put together from words, here from each word and itself."""
    out = []
    for w in words:
        capital = w.capitalize()
        out += [f"{w}_{w}", f"{w}-{w}", f"{w}/{w}", capital + capital, f"{w}_{w}".upper()]
    return out


def chances(counts: np.ndarray) -> np.ndarray:
    """log probability of a symbol after two others, shorter contexts mixed in."""
    three = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    one[0] = 0
    p = (one + 1) / (one.sum() + SIZE)
    p = (two + SMOOTHING * p) / (two.sum(axis=1, keepdims=True) + SMOOTHING)
    p = (three + SMOOTHING * p) / (three.sum(axis=2, keepdims=True) + SMOOTHING)
    return np.log(p)


@dataclass
class Models:
    """log-likelihood ratio of random strings to identifiers per triple, the least sum and the least mean."""

    ratio: np.ndarray
    least: float
    rate: float

    def scores(self, strings: list[str]) -> np.ndarray:
        """Summed ratio of each string."""
        codes = _codes(strings)
        last = codes[2:]
        gain = np.where(last > 0, self.ratio[(codes[:-2] * SIZE + codes[1:-1]) * SIZE + last], 0.0)
        total = np.concatenate([[0.0], np.cumsum(gain)])
        ends = np.cumsum([len(s) + 2 for s in strings])
        return np.diff(total[ends - 2], prepend=0.0) if len(strings) else np.zeros(0)

    def random(self, strings: list[str]) -> np.ndarray:
        """Which strings are random."""
        if not strings:
            return np.zeros(0, bool)
        total = self.scores(strings)
        varied = np.array([len(set(s)) >= DISTINCT and LETTER.search(s) is not None for s in strings])
        return varied & (total >= self.least) & (total >= self.rate * np.array([len(s) for s in strings]))


def fit(docs: DataFrame, text: str = "text", odds: float = ODDS) -> Models:
    """Models from the different strings of all documents.

    Base spans label the strings: their values are random, all other strings are
    identifiers. Each counts once however often it occurs. Random ones are joined by
    drawn strings over usual alphabets, weighed like all labelled ones together, so
    that kinds of keys that the documents lack are known as well; identifiers by the
    words among them in the usual styles (``a_a``, ``a-a``, ``a/a``, ``AA`` with
    capitals, upper case). The driver gets sums over triples of symbols, at most the
    cube of the alphabet.
    """

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in by_size(frames, "_text"):
            random: set[str] = set()
            plain: set[str] = set()
            for value in part["_text"]:
                spans = base_spans(value or "")
                random.update(s[3] for s in spans)
                plain.update(RUN.findall(_without(value, spans) if spans else value or ""))
            for label, found in ((True, random), (False, plain)):
                if found:
                    yield pd.DataFrame({"random": label, "string": pd.Series(sorted(found), dtype=object)})

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.zeros((2, SIZE**3), np.int64)
        number = np.zeros(2, np.int64)
        for frame in frames:
            for i, label in enumerate((True, False)):
                found = frame.loc[frame["random"] == label, "string"].tolist()
                number[i] += sum(len(s) >= LEAST_RANDOM for s in found)
                known[i] += triples(found if label else found + joined([s for s in found if s.isalpha()]))
        for i, label in enumerate((True, False)):
            seen = np.flatnonzero(known[i])
            yield pd.DataFrame({"random": label, "triple": seen, "n": known[i][seen]})
            yield pd.DataFrame({"random": [label], "triple": [-1], "n": [number[i]]})

    strings = docs.select(F.col(text).alias("_text")).mapInPandas(listed, "random boolean, string string").distinct()
    sums = strings.mapInPandas(counted, "random boolean, triple long, n long")
    rows = sums.groupBy("random", "triple").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, SIZE**3))
    number = [0, 0]
    for i, label in enumerate((True, False)):
        own = rows[(rows["random"] == label) & (rows["triple"] >= 0)]
        counts[i][own["triple"].to_numpy(np.int64)] = own["n"]
        number[i] = int(rows[(rows["random"] == label) & (rows["triple"] < 0)]["n"].sum())
    counts[1][counts[1] < CUTOFF] = 0
    drawn = generated().astype(float)
    counts[0] += drawn * max(1.0, counts[0].sum() / drawn.sum())
    ratio = (chances(counts[0]) - chances(counts[1])).reshape(-1)
    prior = math.log((number[1] + 1) / (number[0] + 1))
    return Models(ratio, max(0.0, prior) + math.log(odds), GAIN * float(drawn @ ratio / drawn.sum()))


# --- the operator -----------------------------------------------------------


def find_secrets(docs: DataFrame, models: Models, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans`` of every row: start, end (exclusive, code points), kind and base.

    Spans are in order of start and kind. Base kinds (``assign``, ``access``,
    ``hex``) are matches of their patterns and stay whatever the models say; kind
    ``random`` are strings that overlap none of them and that the models take for
    random. Null texts count as empty and have no spans; texts are read whole;
    repeated rows get equal spans; an empty table gives no rows; other columns are
    not carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def spans_of(texts: list[str | None]) -> list[list[tuple[int, int, str, bool]]]:
        based = [base_spans(t or "") for t in texts]
        strings, places = [], []
        for i, (value, spans) in enumerate(zip(texts, based, strict=True)):
            starts = [s[0] for s in spans]
            reach = list(accumulate((s[2] for s in spans), max))
            for m in LONG.finditer(value or ""):
                before = bisect_left(starts, m.end())
                if not before or reach[before - 1] <= m.start():
                    strings.append(m[0])
                    places.append((i, m.start(), m.end()))
        out = [[(s, place, e, KINDS[place], True) for s, place, e, _ in spans] for spans in based]
        for (i, start, end), hit in zip(places, shared.value.random(strings), strict=True):
            if hit:
                out[i].append((start, len(KINDS), end, RANDOM, False))
        return [[(s, e, kind, base) for s, _, e, kind, base in sorted(x)] for x in out]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in by_size(frames, "_text"):
            found = spans_of(part["_text"].tolist())
            yield pd.DataFrame({"doc_id": part["_id"], "spans": [[_row(s) for s in x] for x in found]})

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, spans array<struct<start:int,end:int,kind:string,base:boolean>>"
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInPandas(run, schema)


def _row(span: tuple[int, int, str, bool]) -> dict:
    return dict(zip(("start", "end", "kind", "base"), span, strict=True))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Models from the documents, then their spans as ``find_secrets`` gives them."""
    return find_secrets(docs, fit(docs, text), doc_id, text)
