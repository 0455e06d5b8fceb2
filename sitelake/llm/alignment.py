"""Alignment of two tokenizers' tokens by merge-path pieces over their byte ends."""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.functions.pieces import pieces
from sitelake.session import stage

#: Ends that a piece merges.
WORK = 65_536
#: Characters of the documents that share a table of id pairs, about.
PACK_CHARS = 8_000_000
#: Bytes of text that a task aligns at once; longer texts come alone.
CHUNK_BYTES = 1_000_000
#: Pieces that are tokenized at once.
BATCH = 16_384
#: Characters, and 100 for each, of the aligned pieces that are remembered, about.
KNOWN_CHARS = 32_000_000
#: Id pairs of documents whose counts are summed at once; longer documents come alone.
SUMMED = 500_000

# --- tokens -----------------------------------------------------------------

#: Where no token of either kind crosses: before a single space that a visible
#: character follows.
BORDER = re.compile(r"(?<=[^\x20])(?=\x20\S)")
#: Texts that words alone do not rebuild.
ODD = re.compile(r"\x20(?:\s|\Z)|\A\x20")

# The printable characters that byte-level vocabularies use as they
# are; the other bytes take the code points from 256 on, in order.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_of() -> dict[str, int]:
    others = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}


class Coders:
    """Both tokenizers, the bytes of their tokens and their ids as text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = _byte_of()
        entries = self.a.get_vocab(with_added_tokens=True)
        bytes_a = {i: self._raw(entry, byte_of) for entry, i in entries.items()}
        self.bytes_a = [bytes_a.get(i, b"") for i in range(max(bytes_a, default=-1) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.text_a = self._texts(len(self.bytes_a), ",", "|")
        self.text_b = self._texts(len(self.bytes_b), ",", ";")
        pieces = [self.b.id_to_piece(i) for i in range(len(self.bytes_b))]
        #: Whether tokens of B keep to words, so that words can be encoded apart.
        self.parted = not any(re.search("[^▁]▁", p) for p in pieces)

    @staticmethod
    def _raw(entry: str, byte_of: dict[str, int]) -> bytes:
        if all(c in byte_of for c in entry):
            return bytes(byte_of[c] for c in entry)
        return entry.encode()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @staticmethod
    def _texts(size: int, inner: str, last: str) -> np.ndarray:
        return np.array([[f"{i}{inner}" for i in range(size)], [f"{i}{last}" for i in range(size)]], object)

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both kinds; a piece begins with the space that B adds itself."""
        a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        return a, self.b.encode([p[1:] for p in pieces], num_threads=1) if pieces else []

    def pieces(self, text: str) -> list[str]:
        """Parts of the text, without the space before them, that are encoded apart."""
        if not self.parted:
            return [text]
        if ODD.search(text):
            return [p[1:] for p in BORDER.split(" " + text)]
        return text.split(" ")


# --- merge path -------------------------------------------------------------


def diagonals(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` come before every ``work``-th place of their merge.

    Both are sorted, and of equal ends ``a``'s comes first. All diagonals are
    searched at once, each by halving its stretch of the merge path.
    """
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        open_ = low < high
        middle = (low + high) // 2
        at = middle[open_]
        before = a[at] <= b[d[open_] - 1 - at]
        low[open_] = np.where(before, at + 1, low[open_])
        high[open_] = np.where(before, high[open_], at)
    return low, d - low


def overlaps(
    a: np.ndarray, b: np.ndarray, from_a: int, to_a: int, from_b: int, to_b: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What one piece of the merge emits, by itself.

    Places of the tokens that overlap, as two arrays, and places behind the tokens
    at which both kinds end, as two arrays. Between two neighbouring ends lies
    exactly one pair of tokens.
    """
    mine, other = a[from_a:to_a], b[from_b:to_b]
    at_a = np.arange(len(mine)) + np.searchsorted(other, mine, "left")
    at_b = np.arange(len(other)) + np.searchsorted(mine, other, "right")
    ends = np.empty(len(mine) + len(other), np.int64)
    is_a = np.zeros(len(ends), bool)
    ends[at_a], ends[at_b], is_a[at_a] = mine, other, True
    before = max(int(a[from_a - 1]) if from_a else 0, int(b[from_b - 1]) if from_b else 0)
    start = np.concatenate([[before], ends[:-1]])
    done_a = np.cumsum(is_a) - is_a
    token_a = from_a + done_a
    token_b = from_b + np.arange(len(ends)) - done_a
    pair = ends > start
    both = ~is_a & ~pair
    return token_a[pair], token_b[pair], token_a[both], token_b[both] + 1


def align_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping tokens of both kinds, and where groups end in both.

    The merge is cut into pieces of equal work. A group that a cut parts is closed
    by the piece that meets its end: closings in order are the groups' bounds.
    """
    at_a, at_b = diagonals(a, b, work)
    found = [overlaps(a, b, *x) for x in zip(at_a[:-1], at_a[1:], at_b[:-1], at_b[1:], strict=True)]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *part]) for part in (zip(*found, strict=True) if found else [[]] * 4))


# --- packs of documents -----------------------------------------------------

NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def planes(values: np.ndarray) -> bytes:
    """32-bit numbers by byte place, so that small ones compress to little."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(blob: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
    part = np.frombuffer(blob, np.uint8).reshape(4, -1)[:, begin:end]
    return part.T.copy().view("<u4").ravel().astype(np.int64)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs that end before ``ends``."""
    total = np.concatenate([[0], np.cumsum(values)])[ends]
    return np.diff(total, prepend=0)


class Pieces:
    """Alignment of different pieces, each done once."""

    def __init__(self, coders: Coders, texts: list[str]):
        full = [" " + t for t in texts]
        ids_a, ids_b = coders.encode(full)
        raw = [t.encode("utf-8", "surrogatepass") for t in full]
        self.good = np.array(
            [
                x == b"".join([coders.bytes_a[i] for i in p]) == b"".join([coders.bytes_b[i] for i in q])
                for x, p, q in zip(raw, ids_a, ids_b, strict=True)
            ],
            bool,
        )
        good = self.good.tolist()
        ids_a = [x if g else [] for x, g in zip(ids_a, good, strict=True)]
        ids_b = [x if g else [] for x, g in zip(ids_b, good, strict=True)]
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a = np.fromiter((i for x in ids_a for i in x), np.int64, self.n_a.sum())
        b = np.fromiter((i for x in ids_b for i in x), np.int64, self.n_b.sum())
        ends_a, ends_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        left, right, closed_a, closed_b = align_ends(np.cumsum(coders.size_a[a]), np.cumsum(coders.size_b[b]))
        # All tokens of a piece lie between its own ends, where both kinds end.
        of_link = np.searchsorted(ends_a, left, "right")
        self.n_links = np.bincount(of_link, minlength=len(texts))
        self.n_groups = np.bincount(np.searchsorted(ends_a, closed_a - 1, "right"), minlength=len(texts))
        keys = a[left] << 32 | b[right]
        self.pairs, self.links = np.unique(keys, return_inverse=True)
        self.link_ends = np.cumsum(self.n_links)
        self.shown = self._shown(coders, a, b, closed_a, closed_b, ends_a + ends_b)

    def _shown(self, coders: Coders, a, b, closed_a, closed_b, ends) -> list[str]:
        """Groups of every piece as text, each closed by a semicolon."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[closed_a - 1] = last_b[closed_b - 1] = 1
        # A group's tokens of A stand before its tokens of B.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        parts = np.empty(len(a) + len(b), object)
        parts[np.arange(len(a)) + np.concatenate([[0], closed_b])[group_a]] = coders.text_a[last_a, a]
        parts[np.arange(len(b)) + closed_a[group_b] if len(b) else []] = coders.text_b[last_b, b]
        flat, begin, out = parts.tolist(), 0, []
        for end in ends.tolist():
            out.append("".join(flat[begin:end]))
            begin = end
        return out


class Known:
    """The pieces a pack remembers, numbered as they are met; ``links`` are places in its table of id pairs."""

    COLUMNS = ("good", "n_a", "n_b", "n_groups", "n_links", "links")

    def __init__(self):
        self.code: defaultdict[str, int] = defaultdict()
        self.code.default_factory = self.code.__len__
        self.size = 0
        self.shown: list[str] = []
        for name in self.COLUMNS:
            setattr(self, name, np.zeros(0, bool if name == "good" else np.int64))
        self.link_ends = np.zeros(0, np.int64)

    def add(self, found: Pieces, links: np.ndarray) -> None:
        for name in self.COLUMNS:
            more = links if name == "links" else getattr(found, name)
            setattr(self, name, np.concatenate([getattr(self, name), more]))
        self.link_ends = np.cumsum(self.n_links)
        self.shown += found.shown


class Pack:
    """Documents of a pack, aligned some at a time, and the table of their id pairs.

    Pieces are aligned when they are first met. Those remembered are forgotten
    together when they are many, so that memory does not grow with the words.
    """

    def __init__(self, coders: Coders, number: int):
        self.coders, self.number = coders, number
        self.size = self.documents = 0
        self.known = Known()
        #: Different id pairs, sorted, and the place of each in the table.
        self.keys, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held = np.zeros(0, np.int64)
        self.blobs: dict[str, list[np.ndarray]] = {"rows": [], "codes": [], "times": []}

    def _places(self, pairs: np.ndarray) -> np.ndarray:
        """Places of different, sorted pairs; new ones are added to the table."""
        at = np.searchsorted(self.keys, pairs)
        new = np.append(self.keys, -1)[at] != pairs
        fresh = len(self.keys) + np.arange(new.sum())
        self.keys = np.insert(self.keys, at[new], pairs[new])
        self.place = np.insert(self.place, at[new], fresh)
        self.held = np.append(self.held, np.zeros(len(fresh), np.int64))
        return self.place[np.searchsorted(self.keys, pairs)]

    def _codes(self, cut: list[list[str]]) -> np.ndarray:
        """Numbers of all pieces, after those not known have been aligned."""
        if self.known.size > KNOWN_CHARS:
            self.known = Known()
        known = self.known
        start = len(known.code)
        codes = np.fromiter((known.code[p] for x in cut for p in x), np.int64, sum(map(len, cut)))
        new = list(islice(known.code, start, None))
        known.size += sum(map(len, new)) + 100 * len(new)
        for begin in range(0, len(new), BATCH):
            found = Pieces(self.coders, new[begin : begin + BATCH])
            known.add(found, self._places(found.pairs)[found.links])
        return codes

    def rows(self, part: pa.RecordBatch, written: Callable[[str], str]) -> pa.RecordBatch:
        """Rows of the next documents; their id pairs are kept for the table."""
        texts = part.column("_text")
        self.size += pc.sum(pc.utf8_length(texts)).as_py() or 0
        self.size += 100 * len(texts)
        cut = [self.coders.pieces(t) if t else [] for t in texts.to_pylist()]
        codes = self._codes(cut)
        ends = np.cumsum([len(x) for x in cut]).astype(np.int64)
        del cut
        known = self.known
        spoilt = _sums(~known.good[codes], ends) > 0
        document = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        kept = ~spoilt[document]
        codes, document = codes[kept], document[kept]
        ends = np.searchsorted(document, np.arange(len(ends)), "right")
        shown, begin = [], 0
        for end in ends.tolist():
            shown.append(written("".join([known.shown[c] for c in codes[begin:end].tolist()])[:-1]))
            begin = end
        numbers = {name: _sums(getattr(known, name)[codes], ends) for name in NUMBERS}
        # Every document's id pairs with their numbers of links.
        number = known.n_links[codes]
        shift = np.cumsum(number) - number
        links = known.links[np.arange(number.sum()) - np.repeat(shift - (known.link_ends[codes] - number), number)]
        key, times = np.unique(np.repeat(document, number) << 32 | links, return_counts=True)
        row, pair = key >> 32, key & 0xFFFFFFFF
        self.held += np.bincount(pair, minlength=len(self.held))
        first = np.diff(row, prepend=-1) > 0
        steps = np.where(first, pair, np.diff(pair, prepend=0))
        for name, values in (("rows", np.bincount(row, minlength=len(ends))), ("codes", steps), ("times", times)):
            self.blobs[name].append(values.astype("<u4"))
        place = self.documents + np.arange(len(ends), dtype=np.int32)
        self.documents += len(ends)
        return self._batch({"place": place, "doc_id": part.column("_id"), **numbers, "groups": shown}, part)

    def table(self, part: pa.RecordBatch) -> pa.RecordBatch:
        """The pack's table of id pairs, by place, and every document's share of it."""
        pairs = np.zeros(len(self.keys), "<i8")
        pairs[self.place] = self.keys
        blobs = {"pairs": pairs.tobytes(), "held": planes(self.held)}
        for name, parts in self.blobs.items():
            blobs[name] = planes(np.concatenate(parts))
        return self._batch({name: [blob] for name, blob in blobs.items()}, part)

    def _batch(self, columns: dict, part: pa.RecordBatch) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        kinds = {"pack": pa.int64(), "place": pa.int32(), "doc_id": part.column("_id").type}
        kinds |= dict.fromkeys(NUMBERS, pa.int64()) | {"groups": pa.string()}
        kinds |= dict.fromkeys(("pairs", "held", "rows", "codes", "times"), pa.binary())
        given = {"pack": np.full(size, self.number), **columns}
        arrays = [pa.array(given[n], t) if n in given else pa.nulls(size, t) for n, t in kinds.items() if n != "doc_id"]
        arrays.insert(list(kinds).index("doc_id"), given.get("doc_id", pa.nulls(size, kinds["doc_id"])))
        return pa.RecordBatch.from_arrays(arrays, list(kinds))


def aligned(
    batches: Iterable[pa.RecordBatch], coders: Coders, task: int, pack_chars: int, written: Callable[[str], str]
) -> Iterator[pa.RecordBatch]:
    """Rows of a task's documents; those of a pack are followed by its table of id pairs."""
    pack, packs = None, 0
    for part in (p for whole in batches for p in pieces(whole, "_text", min(pack_chars, CHUNK_BYTES))):
        if not part.num_rows:
            continue
        pack = pack or Pack(coders, task << 32 | packs)
        yield pack.rows(part, written)
        if pack.size >= pack_chars:
            yield pack.table(part)
            pack, packs = None, packs + 1
    if pack:
        yield pack.table(part)


def _runs(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int, int, int]]:
    """First document and the one behind the last, and likewise their id pairs, ``limit`` or one document at a time."""
    first = begin = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, begin + limit, "right")))
        end = int(ends[last - 1])
        yield first, last, begin, end
        first, begin = last, end


_made: dict[tuple[str, str], Coders] = {}


def _coders(path_a: str, path_b: str) -> Coders:
    """Both tokenizers, once per worker process."""
    if (path_a, path_b) not in _made:
        _made.clear()
        _made[path_a, path_b] = Coders(path_a, path_b)
    return _made[path_a, path_b]


# --- the operator -----------------------------------------------------------


def align(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    doc_id: str = "doc_id",
    text: str = "text",
    digest: bool = False,
    pack_chars: int = PACK_CHARS,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every row.

    ``path_a`` names a byte-level vocabulary (space and text), ``path_b`` a
    sentence-piece model (which adds the space). Offsets where tokens of both kinds
    end cut them into ``groups``, written ``a1,a2|b1;a3|b2``, or their SHA-256 in
    hexadecimal with ``digest``. Tokens are linked that share bytes; an id pair's
    count is the number of rows that link it, over all rows. ``n_best`` counts links
    whose count is the highest of their A id, ``count_sum`` adds the counts up.

    Null and empty texts, and those that one of the tokenizers does not give back
    byte for byte, have zeros and no groups. Ties for the highest count all count;
    repeated rows are rows of their own; texts of any length are aligned whole, the
    merge in pieces of equal work; other columns do not matter; an empty table gives
    no rows.

    Texts are read once, and aligned a bounded number of bytes at a time. Documents
    are packed as tasks meet them; a pack sends its different id pairs to where they
    are counted and gets the counts back.
    """
    import hashlib

    def written(shown: str) -> str:
        return hashlib.sha256(shown.encode()).hexdigest() if digest and shown else shown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        yield from aligned(batches, _coders(path_a, path_b), task, pack_chars, written)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"pack long, place int, doc_id {kind}, {', '.join(f'{n} long' for n in NUMBERS)}, groups string"
    schema += ", pairs binary, held binary, rows binary, codes binary, times binary"
    given = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    every = stage(given.mapInArrow(run, schema), "alignment")
    tables = every.filter("place IS NULL")

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for pack, pairs, held in frame.itertuples(index=False):
                keys = np.frombuffer(pairs, "<i8")
                yield pd.DataFrame({"pack": pack, "at": np.arange(len(keys)), "pair": keys, "held": unplanes(held)})

    asked = tables.select("pack", "pairs", "held").mapInPandas(listed, "pack long, at int, pair long, held long")
    counts = asked.groupBy("pair").agg(F.sum("held").alias("count"))
    counts = stage(counts.withColumn("a", F.shiftright("pair", 32).cast("int")), "alignment-counts")
    # One row per id of A: as many as its vocabulary holds at most.
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    judged = counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asked.select("pack", "at", "pair").join(judged, "pair").select("pack", "at", "count", "best")

    def totals(table: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        (own,) = table.itertuples(index=False)
        count = np.zeros(len(own.pairs) // 8, np.int64)
        best = np.zeros(len(count), np.int64)
        count[found["at"]], best[found["at"]] = found["count"], found["best"]
        ends = np.cumsum(unplanes(own.rows))
        sums = np.zeros((2, len(ends)), np.int64)
        for first, last, begin, end in _runs(ends, SUMMED):
            here = ends[first:last] - begin
            # Codes grow within a document by the steps written.
            run = np.cumsum(unplanes(own.codes, begin, end))
            base = np.concatenate([[0], run])[np.concatenate([[0], here[:-1]])]
            pair = run - np.repeat(base, np.diff(here, prepend=0))
            times = unplanes(own.times, begin, end)
            sums[:, first:last] = _sums(best[pair] * times, here), _sums(count[pair] * times, here)
        return pd.DataFrame(
            {
                "pack": own.pack,
                "place": np.arange(len(ends), dtype=np.int32),
                "n_best": sums[0],
                "count_sum": sums[1],
            }
        )

    packed = tables.select("pack", "pairs", "rows", "codes", "times").groupBy("pack")
    summed = packed.cogroup(answers.groupBy("pack")).applyInPandas(
        totals, "pack long, place int, n_best long, count_sum long"
    )
    rows = every.filter("place IS NOT NULL").select("pack", "place", "doc_id", *NUMBERS, "groups")
    return rows.join(summed, ["pack", "place"]).select("doc_id", *NUMBERS, "n_best", "count_sum", "groups")
