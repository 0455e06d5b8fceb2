"""Collocations: an FM-index over word ids per shard, counts summed across shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelake.session import stage, staged

#: Words of the longest phrases and the occurrences that make a candidate.
WORDS, LEAST = 3, 10
#: Bytes of text that a shard indexes, about.
SHARD = 2_000_000
#: A phrase goes if a longer one has at least this share of its occurrences, in percent.
SHARE = 50
#: Phrases reported of a language.
TOP = 2000
UNKNOWN = "und"
#: Bits of the table that keeps hopeless phrases from being shuffled; fixed, so
#: that its size does not grow with the data.
SIEVE_BITS = 26
#: Bits of the numbers by which phrases are counted before their words are sent.
KEY_BITS = 40
#: Bits of the count that stands behind a key in one number; larger counts of a
#: shard are cut to that, as they are frequent anyway.
COUNT_BITS = 63 - KEY_BITS
#: Phrases that a task sums over its shards before it sends them.
HELD = 400_000
#: Parts that phrases are dealt to, at least, and shards to a part beyond that.
PARTS, PART_SHARDS = 128, 8
#: Bytes of a batch of texts or indexes that a task holds, about.
BATCH_BYTES = "2m"

# Characters that end a piece; one of them stands for all.
ENDS = b".,;:!?\n\x0b\x0c\r"
END = b"\n"
_TABLE = bytes(END[0] if i in ENDS else 32 if i == 9 else i for i in range(256))


# --- the index of a shard ---------------------------------------------------


def words_of(text: bytes) -> pa.Array:
    """Words, A-Z in lower case, with ``END`` after every piece, as an Arrow array."""
    raw = np.frombuffer(text.lower().translate(_TABLE) + END, np.uint8)
    held, ends = raw != 32, raw == END[0]
    begins = held.copy()
    begins[1:] &= ~held[:-1] | ends[1:] | ends[:-1]
    # Without the spaces, the words lie one after another.
    places = np.cumsum(held) - 1
    offsets = np.append(places[begins], places[-1] + 1).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(raw[held])]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def _sorted_rows(keys: np.ndarray) -> np.ndarray:
    """Places in order of 32-bit keys, equal keys by place."""
    packed = np.sort(keys.astype(np.uint64) << np.uint64(32) | np.arange(len(keys), dtype=np.uint64))
    return (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _ahead(ids: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([ids[by:], ids[:by]])


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of a cyclic text in order of the ``depth`` symbols that begin there."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    covered = min(depth, max(1, 63 // bits))
    key = np.zeros(len(ids), np.uint64)
    for i in range(covered):
        key = key << np.uint64(bits) | _ahead(ids, i % max(1, len(ids))).astype(np.uint64)
    while covered < depth:
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        key = rank << np.uint64(32) | _ahead(rank, covered % len(ids))
        covered *= 2
    return np.argsort(key)


@dataclass
class Nodes:
    """Phrases of one length: their word ids, and where both indexes hold them."""

    words: np.ndarray
    start: np.ndarray
    reverse: np.ndarray
    count: np.ndarray

    def take(self, chosen: np.ndarray) -> "Nodes":
        return Nodes(self.words[chosen], self.start[chosen], self.reverse[chosen], self.count[chosen])

    def turned(self) -> "Nodes":
        """The same phrases seen from the reversed text."""
        return Nodes(self.words[:, ::-1], self.reverse, self.start, self.count)


@dataclass
class Index:
    """Burrows-Wheeler transforms of a text of word ids and of its reverse.

    Id 0 ends a piece. Row ``i`` of the forward index is the place whose following
    symbols come ``i``-th; ``left[i]`` is the symbol before it. ``right`` is the same
    for the reversed text: the symbol after. Rows are in order of ``depth`` symbols
    only, which is all that intervals of phrases of up to ``depth`` words need.
    """

    names: list[bytes]
    left: np.ndarray
    right: np.ndarray
    _steps: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, words: pa.Array, depth: int) -> "Index":
        """The index of ``words``, in which ``END`` closes every piece."""
        coded = pa.chunked_array([pa.array([END], pa.binary()), words]).combine_chunks().dictionary_encode()
        ids = coded.indices.to_numpy()[1:].astype(np.int32)
        back = ids[::-1]
        return cls(
            coded.dictionary.to_pylist(),
            ids[suffix_order(ids, depth) - 1],
            back[suffix_order(back, depth) - 1],
        )

    def turned(self) -> "Index":
        return Index(self.names, self.right, self.left)

    def counts(self) -> np.ndarray:
        return np.bincount(self.left, minlength=len(self.names))

    def singles(self) -> Nodes:
        """Every word with its occurrences."""
        count = self.counts()
        start = np.cumsum(count) - count
        ids = np.arange(1, len(self.names))
        return Nodes(ids[:, None], start[1:], start[1:], count[1:])

    def step(self) -> np.ndarray:
        """Row of the reversed text's index to which each of its rows leads when
        the phrase is extended by the row's symbol."""
        if "right" not in self._steps:
            to = np.empty(len(self.right), np.int64)
            to[_sorted_rows(self.right)] = np.arange(len(self.right))
            self._steps["right"] = to
        return self._steps["right"]

    def extend(self, nodes: Nodes) -> Nodes:
        """Every phrase of ``nodes`` with each word that follows it somewhere.

        The rows of a phrase in the reversed text's index show what follows. Rows
        with one symbol lead to neighbouring rows; in the forward index they come
        after all rows of the phrase with smaller symbols.
        """
        total = int(nodes.count.sum())
        node = np.repeat(np.arange(len(nodes.count)), nodes.count)
        begin = np.cumsum(nodes.count) - nodes.count
        rows = np.arange(total) - begin[node] + nodes.reverse[node]
        symbols = self.right[rows]
        order = _sorted_rows(symbols)
        symbol, of = symbols[order], node[order]
        new = np.ones(total, bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, total))
        symbol, of, at = symbol[first], of[first], rows[order[first]]
        # By phrase and symbol, to place them in the forward index.
        order = np.lexsort((symbol, of))
        symbol, of, at, count = symbol[order], of[order], at[order], count[order]
        start = nodes.start[of] + np.cumsum(count) - count - begin[of]
        words = np.concatenate([nodes.words[of], symbol[:, None]], axis=1)
        inside = symbol != 0
        return Nodes(words, start, self.step()[at] if total else at, count).take(inside)

    def extend_left(self, nodes: Nodes) -> Nodes:
        """Every phrase of ``nodes`` with each word that precedes it somewhere."""
        return self.turned().extend(nodes.turned()).turned()

    def edges(self, nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences that begin a piece, and that end one."""
        out = []
        for start, symbols in ((nodes.start, self.left), (nodes.reverse, self.right)):
            ends = np.concatenate([[0], np.cumsum(symbols == 0)])
            out.append(ends[start + nodes.count] - ends[start])
        return out[0], out[1]


# --- the sieve --------------------------------------------------------------


def _word_hashes(lang: str, names: list[bytes]) -> np.ndarray:
    lead = lang.encode() + b"\x00"
    return np.fromiter((xxhash.xxh64_intdigest(lead + n) for n in names), np.uint64, len(names))


def _keys(hashes: np.ndarray) -> np.ndarray:
    """A number of ``KEY_BITS`` for each phrase, from the hashes of its words, one column per word."""
    total = np.full(len(hashes), hashes.shape[1], np.uint64)
    for column in hashes.T:
        total = (total ^ column) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total >> np.uint64(64 - KEY_BITS)


def _slot_bits(keys: np.ndarray) -> pa.RecordBatch:
    """The slots, the leading bits of a key, that sorted ``keys`` fall into: numbers of 64 slots and their bits."""
    slots = keys >> (KEY_BITS - SIEVE_BITS)
    at, first = np.unique(slots >> 6, return_index=True)
    bits = np.int64(1) << (slots & 63)
    bits = np.bitwise_or.reduceat(bits, first) if len(bits) else bits
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits)], ["at", "bits"])


def _sieve(frequent: DataFrame) -> np.ndarray:
    """Bits of all slots; two parts may share 64 slots."""
    rows = frequent.toPandas()
    bits = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    np.bitwise_or.at(bits, rows["at"].to_numpy(np.int64), rows["bits"].to_numpy(np.int64))
    return bits.view(np.uint64)


def _passes(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = _keys(hashes) >> np.uint64(KEY_BITS - SIEVE_BITS)
    return (sieve[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


# --- shards as rows ---------------------------------------------------------

_SHARDS = "lang string, total long, symbols long, letters long, names binary, left binary, right binary"
_COUNTS = "lang string, phrase string, size int, n long, begins long, ends long"
_PACKS = pa.schema(
    [("part", pa.int32()), ("lang", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64()), ("packed", pa.binary())]
)
_PACKED = "part int, lang string, rows long, bytes long, packed binary"


def _planes(column: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones, which compress far better than number by number."""
    return np.ascontiguousarray(column.view(np.uint8).reshape(len(column), -1).T).tobytes()


def _from_planes(raw: memoryview, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _pack(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes, size: int) -> memoryview:
    return memoryview(pa.decompress(packed, size, codec="zstd", asbytes=True)) if size else memoryview(b"")


def shards(docs: DataFrame, lang: str = "lang", text: str = "text", words: int = WORDS, size: int = SHARD) -> DataFrame:
    """One row per shard: its language, number of words and index.

    A shard is filled by documents of one language as a task meets them, so no text
    is shuffled; a text longer than a shard has one of its own.
    """

    def row(lang: str, texts: list[bytes]) -> pa.RecordBatch:
        index = Index.of(words_of(END.join(texts)), words)
        total = int(index.counts()[1:].sum())
        blobs = [END.join(index.names[1:]), _planes(index.left), _planes(index.right)]
        columns = [[lang], [total], [len(index.left)], [len(blobs[0])], *[[_pack(b)] for b in blobs]]
        kinds = [pa.string(), *[pa.int64()] * 3, *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["lang", "total", "symbols", "letters", "names", "left", "right"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for name, value in zip(langs, batch.column(1).cast(pa.binary()), strict=True):
                if value.is_valid and len(raw := value.as_py()):
                    held.setdefault(name, []).append(raw)
                    sizes[name] = sizes.get(name, 0) + len(raw) + 1
                    if sizes[name] >= size:
                        yield row(name, held.pop(name))
                        sizes[name] = 0
        for name, texts in held.items():
            yield row(name, texts)

    language = F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang")
    return docs.select(language, F.col(text).alias("text")).mapInArrow(run, _SHARDS)


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    for at in range(len(batch)):
        yield batch.slice(at, 1).to_pylist()[0]


def _loaded(row: dict) -> Index:
    names = [END, *bytes(_unpack(row["names"], row["letters"])).split(END)] if row["letters"] else [END]
    return Index(names, *(_from_planes(_unpack(row[c], 4 * row["symbols"]), np.int32) for c in ("left", "right")))


def _levels(index: Index, hashes: np.ndarray, sieves: list, words: int) -> Iterator[Nodes]:
    """Phrases of one word, of two and so on up to ``words``, that may still be frequent enough.

    ``sieves[k]`` says which phrases of ``k + 1`` words may: every part of a
    frequent phrase is at least as frequent.
    """
    nodes = index.singles()
    for k in range(words):
        if k < len(sieves):
            nodes = nodes.take(_passes(sieves[k].value, hashes[nodes.words]))
        yield nodes
        if k + 1 < words:
            nodes = index.extend(nodes)
            # The part without the first word; the one without the last has passed.
            nodes = nodes.take(_passes(sieves[k].value, hashes[nodes.words[:, 1:]]))


def _parts(indexes: DataFrame) -> int:
    return max(PARTS, indexes.count() // PART_SHARDS)


def _dealt(part: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """Where the rows of each part begin and end, for sorted parts."""
    ends = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
        yield p, int(ends[p]), int(ends[p + 1])


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of keys."""
    return keys * parts >> KEY_BITS


def _least_key(part: int, parts: int) -> int:
    return -(-(part << KEY_BITS) // parts)


def _packs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKS, strict=True)], schema=_PACKS
    )


def _packed(indexes: DataFrame, held: Callable[[dict], tuple], size: Callable, pack: Callable) -> DataFrame:
    """What shards hold, ``HELD`` phrases at a time as ``pack`` sums and packs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []
        number = 0
        for batch in batches:
            for row in _one_by_one(batch):
                for found in filter(size, held(row)):
                    waiting.append(found)
                    number += size(found)
                    if number >= HELD:
                        yield from pack(waiting)
                        waiting, number = [], 0
                pa.default_memory_pool().release_unused()
        if number:
            yield from pack(waiting)

    return indexes.mapInArrow(run, _PACKED)


def _summed_keys(counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and their counts, of keys with a count behind each."""
    counted = np.sort(counted)
    keys = counted >> COUNT_BITS
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counted & ((1 << COUNT_BITS) - 1), first)


def _pack_keys(waiting: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Per part: the gaps between its keys, and the counts."""
    keys, counts = _summed_keys(np.concatenate(waiting))
    gaps = np.diff(keys, prepend=0)
    out = []
    for p, start, end in _dealt(_part_of(keys, parts), parts):
        own = gaps[start:end].copy()
        own[0] = keys[start] - _least_key(p, parts)
        raw = _planes(own) + _planes(counts[start:end])
        out.append((p, None, end - start, len(raw), _pack(raw)))
    yield _packs(out)


def _unpack_keys(row: dict, parts: int) -> tuple[np.ndarray, np.ndarray]:
    raw, half = _unpack(row["packed"], row["bytes"]), row["bytes"] // 2
    gaps = _from_planes(raw[:half], np.int64)
    return np.cumsum(gaps) + _least_key(row["part"], parts), _from_planes(raw[half:], np.int64)


def _frequent(indexes: DataFrame, sieves: list, least: int, parts: int) -> DataFrame:
    """``at, bits``: slots of the phrases, one word longer than the last sieve's, that may occur ``least`` times."""

    def keys(row: dict) -> Iterator[np.ndarray]:
        index = _loaded(row)
        hashes = _word_hashes(row["lang"], index.names)
        for nodes in _levels(index, hashes, sieves, len(sieves) + 1):
            longest = nodes
        counts = np.minimum(longest.count, (1 << COUNT_BITS) - 1)
        yield _keys(hashes[longest.words]).view(np.int64) << COUNT_BITS | counts

    def slots(packs: pa.Table) -> pa.Table:
        found = [_unpack_keys(row, parts) for row in packs.to_pylist()]
        keys = np.concatenate([k for k, _ in found])
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        total = np.add.reduceat(np.concatenate([n for _, n in found])[order], first)
        return pa.Table.from_batches([_slot_bits(keys[first][total >= least])])

    packs = _packed(indexes, keys, len, lambda waiting: _pack_keys(waiting, parts))
    return packs.groupBy("part").applyInArrow(slots, "at long, bits long")


def _summed_phrases(tables: list[pa.Table]) -> pa.Table:
    """``phrase, n, begins, ends`` and what else is the same for a phrase, once per phrase."""
    table = pa.concat_tables(tables)
    sums = [(c, "sum") for c in ("n", "begins", "ends")] + [(c, "min") for c in table.column_names if c == "key"]
    summed = table.group_by("phrase", use_threads=False).aggregate(sums)
    return summed.rename_columns([c.removesuffix("_sum").removesuffix("_min") for c in summed.column_names])


def _pack_phrases(waiting: list[tuple[str, pa.Table]], parts: int) -> Iterator[pa.RecordBatch]:
    """Per language and part: the three numbers of its phrases, and the phrases."""
    for lang in dict.fromkeys(name for name, _ in waiting):
        table = _summed_phrases([t for name, t in waiting if name == lang])
        part = _part_of(table["key"].to_numpy(), parts)
        order = np.argsort(part, kind="stable")
        phrases = table["phrase"].combine_chunks().take(pa.array(order))
        numbers = [table[c].to_numpy()[order] for c in ("n", "begins", "ends")]
        out = []
        for p, start, end in _dealt(part[order], parts):
            raw = b"".join(_planes(c[start:end]) for c in numbers) + END.join(phrases[start:end].to_pylist())
            out.append((p, lang, end - start, len(raw), _pack(raw)))
        yield _packs(out)


def _unpack_phrases(row: dict) -> pa.Table:
    raw, plane = _unpack(row["packed"], row["bytes"]), 8 * row["rows"]
    numbers = [_from_planes(raw[i * plane : (i + 1) * plane], np.int64) for i in range(3)]
    phrases = pa.array(bytes(raw[3 * plane :]).split(END), pa.binary())
    return pa.table([phrases, *numbers], ["phrase", "n", "begins", "ends"])


def _counted(indexes: DataFrame, sieves: list, least: int, parts: int) -> DataFrame:
    """``lang, phrase, size, n, begins, ends`` of all frequent phrases, summed over the shards."""

    def levels(row: dict) -> Iterator[tuple[str, pa.Table]]:
        index = _loaded(row)
        names = pa.array(index.names, pa.binary())
        hashes = _word_hashes(row["lang"], index.names)
        for nodes in _levels(index, hashes, sieves, len(sieves)):
            words = [names.take(pa.array(column)) for column in nodes.words.T]
            phrase = words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, b" ")
            numbers = [pa.array(c, pa.int64()) for c in (nodes.count, *index.edges(nodes))]
            key = pa.array(_keys(hashes[nodes.words]).view(np.int64))
            yield row["lang"], pa.table([phrase, *numbers, key], ["phrase", "n", "begins", "ends", "key"])

    def frequent(packs: pa.Table) -> pa.Table:
        by_lang: dict[str, list[pa.Table]] = {}
        for row in packs.to_pylist():
            by_lang.setdefault(row["lang"], []).append(_unpack_phrases(row))
        out = []
        for lang, tables in by_lang.items():
            table = _summed_phrases(tables)
            table = table.filter(pc.greater_equal(table["n"], least))
            size = pc.add(pc.count_substring(table["phrase"], " "), 1).cast(pa.int32())
            names = pa.array([lang] * len(table), pa.string())
            numbers = [table[c] for c in ("n", "begins", "ends")]
            columns = [names, table["phrase"].cast(pa.string()), size, *numbers]
            out.append(pa.table(columns, ["lang", "phrase", "size", "n", "begins", "ends"]))
        return pa.concat_tables(out)

    packs = _packed(indexes, levels, lambda found: found[1].num_rows, lambda waiting: _pack_phrases(waiting, parts))
    return packs.groupBy("part").applyInArrow(frequent, _COUNTS)


@contextmanager
def _small_batches(spark: SparkSession):
    """Texts and indexes reach the tasks a few at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass
class Counts:
    """``totals`` holds ``lang, n``; ``phrases`` holds ``lang, phrase, size, n, begins, ends``."""

    totals: DataFrame
    phrases: DataFrame


def count_phrases(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    words: int = WORDS,
    least: int = LEAST,
    size: int = SHARD,
) -> Counts:
    """All phrases of up to ``words`` words with at least ``least`` occurrences.

    ``begins`` and ``ends`` are the occurrences at the edges of a piece, which have
    no extension on that side. One pass indexes the texts. For each length, a pass
    over the indexes counts phrases by their keys, to learn which may be frequent;
    the last pass sends those with their words and counts exactly.
    """
    spark = docs.sparkSession
    with _small_batches(spark):
        with staged(shards(docs, lang, text, words, size), "phrases-shards") as indexes:
            parts = _parts(indexes)
            sieves: list = []
            for _ in range(words):
                sieves.append(spark.sparkContext.broadcast(_sieve(_frequent(indexes, sieves, least, parts))))
            every = stage(_counted(indexes, sieves, least, parts), "phrases")
            totals = stage(indexes.groupBy("lang").agg(F.sum("total").alias("n")), "phrases-totals")
    return Counts(totals, every)


# --- scores -----------------------------------------------------------------


def _part(first: Column, number: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, number), " ")


def _whole(value: Column) -> Column:
    return value.cast("decimal(18,0)")


def scored(counts: Counts) -> DataFrame:
    """``lang, phrase, size, a, l, r, n, score`` of all phrases of two words or more.

    A phrase is cut in two wherever it can be; the cut with the lowest score counts,
    the earliest of equal ones. Products are decimals of 38 digits, so scores are
    exact.
    """
    phrases = counts.phrases.filter("size > 1")
    cuts = phrases.select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.withColumn("left", _part(F.lit(1), F.col("cut"))).withColumn(
        "right", _part(F.col("cut") + 1, F.col("size") - F.col("cut"))
    )
    left = counts.phrases.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = counts.phrases.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    above = F.lit(1_000_000).cast("decimal(7,0)") * _whole(F.col("a")) * _whole(F.col("a"))
    met = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    met = met.withColumn("_above", above).withColumn("_below", _whole(F.col("l")) * _whole(F.col("r")))
    met = met.withColumn("score", F.expr("_above div _below"))
    best = met.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_best"))
    best = best.select("lang", "phrase", "size", "a", "_best.l", "_best.r", "_best.score")
    totals = counts.totals.select(F.col("lang").alias("_lang"), "n")
    return best.join(totals, F.col("lang") == F.col("_lang")).drop("_lang")


def independent(phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """Without phrases that lie inside a longer one with ``share`` percent of their occurrences."""
    spans = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.col("size") - 1),
                lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: _part(i, k)),
            )
        )
    )
    inside = phrases.filter("size > 2").select("lang", spans.alias("phrase"), F.col("a").alias("_a"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("_a").alias("_longer"))
    met = phrases.join(longer, ["lang", "phrase"], "left")
    return met.filter(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a"))).drop("_longer")


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    words: int = WORDS,
    least: int = LEAST,
    share: int = SHARE,
    top: int = TOP,
    size: int = SHARD,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its weakest cut, ``n`` all
    words of the language. Null and empty texts have no words; a null language is
    ``und``; repeated rows count each time; equal scores go by ``a`` and then by the
    phrase's bytes, so ranks have no ties; texts of any length are read whole;
    columns other than ``lang`` and ``text`` do not matter; an empty table gives no
    rows.
    """
    every = stage(scored(count_phrases(docs, lang, text, words, least, size)), "phrases-scored")
    kept = independent(every, share)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The first of each language among a part of its phrases, then among those.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    few = kept.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
