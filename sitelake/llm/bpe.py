"""BPE encoding by backtracking over longest token matches, and decoding by offsets."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.batches import by_size

#: Words whose encoding a worker remembers; beyond it the memory starts anew.
MEMORY_WORDS = 400_000
#: Pairs of neighbouring tokens whose compatibility it remembers.
MEMORY_PAIRS = 1_000_000
ENDS = 256


class Vocabulary:
    """Tables of a word-end BPE tokenizer file.

    Symbols are the 256 bytes and the 256 bytes that end a word. Tokens are
    numbered in the order in which merges make them, so a smaller number is an
    earlier merge.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
            raise ValueError(f"not a word-end BPE file: {path}")
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = dict(model["vocab"]) | self.special
        letter = _letters()
        symbols = [letter[b] for b in range(256)] + [letter[b] + "</w>" for b in range(256)]
        number = {name: i for i, name in enumerate(symbols)}
        self.text = [chr(i) for i in range(2 * ENDS)]
        self.parts = [(i, i) for i in range(2 * ENDS)]
        self.pairs: dict[tuple[int, int], int] = {}
        for left, right in model["merges"]:
            a, b = number[left], number[right]
            made = number.setdefault(left + right, len(number))
            if made == len(self.text):
                self.text.append(self.text[a] + self.text[b])
                self.parts.append((a, b))
            self.pairs.setdefault((a, b), made)
        self.ids = [names[name] for name in number]
        size = max(names.values()) + 1
        by_id = [""] * size
        for name, i in names.items():
            by_id[i] = name
        pieces = [name.encode() + b" " for name in by_id]
        self.blob = b"".join(pieces)
        self.offsets = np.cumsum([0, *map(len, pieces)])


def _letters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for byte in range(256):
        out.append(chr(byte if byte in shown else extra))
        extra += byte not in shown
    return out


class Encoder(dict):
    """Exact merges of one word at a time, in linear time, with a bounded memory.

    It maps the words met so far to their ids.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")").split
        self.trie = ahocorasick.Automaton()
        for token, text in enumerate(vocabulary.text):
            self.trie.add_word(text, token)
        self.trie.make_automaton()
        self.size = [len(text) for text in vocabulary.text]
        self.shorter = [self._shorter(text) for text in vocabulary.text]
        self.raw = [i.to_bytes(4, "little") for i in vocabulary.ids]
        self.fits: dict[tuple[int, int], bool] = {}
        self.blob = np.frombuffer(vocabulary.blob, np.uint8)

    def _shorter(self, text: str) -> int | None:
        """The longest token that is a proper prefix of this one."""
        for end in range(len(text) - 1, 0, -1):
            found = self.trie.get(text[:end], None)
            if found is not None:
                return found
        return None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merges leave the border between two tokens standing.

        Undo merges on both sides, the latest first. A pair that meets at the
        border must not have a merge that comes before the one just undone.
        """
        pairs, parts = self.v.pairs, self.v.parts
        limit = len(parts)
        while True:
            if pairs.get((left, right), limit) < limit:
                return False
            if left > right:
                # Of equal merges the one further left is made first.
                limit, left = left, parts[left][1]
                if left == limit:
                    limit, right = right + 1, parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, parts[right][0]
                if right + 1 == limit:
                    limit, left = left, parts[left][1]
                    if left == limit:
                        return True

    def tokens(self, word: str) -> list[int]:
        """The tokens of one word."""
        raw = word.encode("utf-8", "surrogatepass")
        symbols = raw[:-1].decode("latin-1") + chr(ENDS + raw[-1])
        size, shorter, fits, length = self.size, self.shorter, self.fits, len(symbols)
        longest: list[int] = [0] * length
        for end, token in self.trie.iter(symbols):
            longest[end + 1 - size[token]] = token
        tokens: list[int] = []
        dead = bytearray(length + 1)
        at, token, last = 0, longest[0], -1
        while at < length:
            end = at + size[token]
            if not dead[end]:
                fit = last < 0 or fits.get((last, token))
                if fit is None:
                    fit = fits[last, token] = self.compatible(last, token)
                if fit:
                    tokens.append(token)
                    at, last = end, token
                    if at < length:
                        token = longest[at]
                    continue
            less = shorter[token]
            while less is None:  # no token fits here: take back the one before
                dead[at] = 1
                tokens.pop()
                at -= size[last]
                less = shorter[last]
                last = tokens[-1] if tokens else -1
            token = less
        return tokens

    def __missing__(self, word: str) -> bytes:
        ids = b"".join([self.raw[t] for t in self.tokens(word)])
        if len(self) >= MEMORY_WORDS:
            self.clear()
        if len(self.fits) >= MEMORY_PAIRS:
            self.fits.clear()
        if len(word) < 64:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for piece in self.special(text or ""):
            if piece in self.v.special:
                out.append(self.v.special[piece].to_bytes(4, "little"))
            else:
                out += map(self.__getitem__, self.find(_normal(piece)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4")
        if not len(numbers):
            return ""
        starts = self.v.offsets[numbers]
        lengths = self.v.offsets[numbers + 1] - starts
        ends = np.cumsum(lengths)
        where = np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])
        return self.blob[where].tobytes()[:-1].decode("utf-8")


def _normal(text: str) -> str:
    """NFC and lower case; white space only parts words, so it needs no change."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


_made: dict[str, Encoder] = {}


def _encoder(shared, name: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if name not in _made:
        _made.clear()
        _made[name] = Encoder(shared.value)
    return _made[name]


def _share(df: DataFrame, path: str):
    """The vocabulary goes to the executors once: a file of fixed size."""
    vocabulary = Vocabulary(path)
    name = hashlib.sha256(vocabulary.blob).hexdigest()
    return df.sparkSession.sparkContext.broadcast(vocabulary), name


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` and, if asked for, ``decoded`` of every row.

    ``ids`` are little-endian unsigned 32-bit integers in a row; ``decoded`` is
    what ``decode`` makes of them. Null and empty texts have no ids and decode to
    an empty text; rows are independent of each other, so ties, repeated rows and
    empty tables need no rule, and other columns are not carried.
    """
    shared, name = _share(df, path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _encoder(shared, name)
        for part in by_size(frames, "_text"):
            ids = [coder.encode(t) for t in part["_text"]]
            out = {"doc_id": part["_id"], "ids": ids}
            if decoded:
                out["decoded"] = [coder.decode(x) for x in ids]
            yield pd.DataFrame(out)

    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, ids binary" + ", decoded string" * decoded
    return df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInPandas(run, schema)


def decode(df: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, decoded``: tokens joined by spaces, word ends kept as written."""
    shared, name = _share(df, path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _encoder(shared, name)
        for part in frames:
            yield pd.DataFrame({"doc_id": part["_id"], "decoded": [coder.decode(x or b"") for x in part["_ids"]]})

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("_id"), F.col(ids).alias("_ids")).mapInPandas(run, f"doc_id {kind}, decoded string")
