"""Benchmark decontamination with an FM-index for each training shard.

A window is ``window`` consecutive normal words of a benchmark item; an item of fewer is one
window. The items' words are hashed and written to the shared folder, in blocks of about
``BLOCK`` words, so that a task holds one block at once, however many items there are.

Each task takes its documents a shard at a time (about ``SHARD`` bytes of text, one document at
least) and, for each block:

1. keeps the runs of words that the block has, at least as long as its shortest window: a word that
   no item has cannot be in a window, so nothing is lost, and the index is small where texts
   and items have little in common;
2. builds the runs' FM-index: suffix array by prefix doubling, in which each run's end is a
   symbol of its own, the Burrows-Wheeler transform as a wavelet matrix of packed bits, and
   every ``RATE``-th suffix position of a run;
3. searches all distinct windows backward at once, word by word, by ranks in the matrix;
4. locates each occurrence by walking back to a sampled position, and marks its words.

The marked words of all blocks, run by run, are the spans to remove. No text is shuffled, no
pair is made, and nothing is gathered but the spans of the shard at hand. Words are told
apart by 64-bit hash: of v words of a block and w of the corpus two are taken for equal with a chance
of v * w / 2**64.

Defined results for odd input: a null or wordless text has no words and no hits, a null or wordless
item no windows; rows that repeat a document are judged each; items that repeat an id are one
item, and those without an id one item named by the empty string; a text of any length is one shard
at least, held whole; an empty table of documents gives none, an empty benchmark no hits; other columns are kept,
those of the names that are added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, pieces, rows_of_folder, settle_at, shared_dir
from gridloom.llm.normal_words import word_hashes, word_spans

WINDOW = 10
SHARD, BLOCK, RATE = 4 << 20, 4_000_000, 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` in order. 0 stands for the end of a run, and each is less
    than those after it and than all words, so that no two suffixes are equal. By prefix
    doubling, which sorts only what is not told apart yet."""
    n, end = len(text), text == 0
    key = text.astype(np.int64) + int(end.sum())
    key[end] = np.arange(int(end.sum()))
    order = np.argsort(key, kind="stable")
    k = key[order]
    rank = np.empty(n, np.int64)  # of the first in its group
    rank[order] = np.maximum.accumulate(np.where(np.append(True, k[1:] != k[:-1]), np.arange(n), 0))
    size = np.bincount(rank, minlength=n)
    open_ = np.flatnonzero(size[rank] > 1)
    step = 1
    while len(open_):
        # a group is open as a whole, and a run's end follows before the text does
        key = rank[open_] << 32 | rank[open_ + step]
        order = np.argsort(key, kind="stable")
        at, k = open_[order], key[order]
        group = k >> 32
        place = np.arange(len(at))
        first = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), place, 0))
        new = np.append(True, k[1:] != k[:-1])
        lead = np.maximum.accumulate(np.where(new, place, 0))
        rank[at] = group + lead - first
        alone = new & np.append(new[1:], True)
        open_ = np.sort(at[~alone])
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Wavelet:
    """A wavelet matrix: a row of packed bits for each bit of the symbols, the highest first,
    with the ones counted before each 64."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.n, self.bits = len(symbols), bits
        self.words, self.ones, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            one = (symbols >> level & 1).astype(bool)
            packed = np.packbits(np.append(one, np.zeros(64 - len(one) % 64, bool)), bitorder="little").view("<u8")
            self.words.append(packed)
            self.ones.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64))[:-1])
            self.zeros.append(self.n - int(one.sum()))
            symbols = np.append(symbols[~one], symbols[one])

    def _rank(self, level: int, i: np.ndarray) -> np.ndarray:
        """The ones before each place."""
        w, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.ones[level][w] + np.bitwise_count(self.words[level][w] & ((np.uint64(1) << bit) - np.uint64(1)))

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the places are in the last row, among those of the symbol."""
        for level in range(self.bits):
            ones = self._rank(level, i)
            i = np.where(symbol >> (self.bits - 1 - level) & 1, self.zeros[level] + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places, and the places in the last row."""
        symbol = np.zeros(len(i), np.int64)
        for level in range(self.bits):
            one = (self.words[level][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._rank(level, i)
            i = np.where(one, self.zeros[level] + ones, i - ones)
            symbol = symbol << 1 | one
        return symbol, i


class FMIndex:
    """Of runs of symbols from 1 on, each with a 0 behind."""

    def __init__(self, text: np.ndarray, rate: int = RATE) -> None:
        self.n = len(text)
        order = suffix_array(text)
        n_symbols = int(text.max(initial=0)) + 1
        self.wavelet = Wavelet(text[order - 1].astype(np.int64), max(n_symbols - 1, 1).bit_length())
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=n_symbols)))
        # where the symbol's part of the last row begins
        self.base = self.wavelet.down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))
        place = np.arange(self.n)
        begin = np.maximum.accumulate(np.where(np.append(0, text[:-1]) == 0, place, 0))
        sampled = ((place - begin) % rate == 0)[order]
        self.sampled, self.samples = sampled, order[sampled]
        self.before = np.cumsum(sampled) - sampled

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of ``patterns`` the suffixes that begin with it, from and to."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for k in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(lo < hi)
            c = patterns[live, k]
            known = c < len(self.base)
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            shift = self.first[c] - self.base[c]
            lo[live], hi[live] = self.wavelet.down(c, lo[live]) + shift, self.wavelet.down(c, hi[live]) + shift
        return lo, np.maximum(lo, hi)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The places in the text of the suffixes ``at``."""
        at, steps = at.copy(), np.zeros(len(at), np.int64)
        live = np.flatnonzero(~self.sampled[at])
        while len(live):
            symbol, down = self.wavelet.access(at[live])
            at[live] = down - self.base[symbol] + self.first[symbol]
            steps[live] += 1
            live = live[~self.sampled[at[live]]]
        return self.samples[self.before[at]] + steps


class Phrases:
    """The windows of a block of items: the words' hashes, sorted, whose place plus one is their
    symbol; the distinct windows by length; and which items have each."""

    def __init__(self, names: list[str], words: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> None:
        self.names, self.vocabulary = names, np.unique(words)
        symbols = np.searchsorted(self.vocabulary, words) + 1
        size = np.diff(bounds)
        self.windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length in np.unique(np.minimum(size[size > 0], window)).tolist():
            mine = np.flatnonzero(size >= window if length == window else size == length)
            n = size[mine] - length + 1
            item = np.repeat(mine, n)
            at = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + bounds[item]
            found, of = np.unique(symbols[at[:, None] + np.arange(length)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack([of.ravel(), item]), axis=1)
            self.windows.append((found, np.searchsorted(pairs[0], np.arange(len(found) + 1)), pairs[1]))
        self.shortest = min((w.shape[1] for w, _, _ in self.windows), default=0)

    def index(self, words: np.ndarray, row: np.ndarray) -> tuple[FMIndex, np.ndarray] | None:
        """The index of the shard's runs of these items' words, and the word at each place of it.
        ``row``: the document of each word."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == words
        start, stop = _runs(known, row)
        long = stop - start >= self.shortest
        start, stop = start[long], stop[long]
        if not len(start):
            return None
        size = stop - start + 1
        first = np.cumsum(size) - size
        origin = np.repeat(start - first, size) + np.arange(int(size.sum()))
        text = at[np.minimum(origin, len(at) - 1)] + 1
        text[first + size - 1] = 0
        return FMIndex(text), origin

    def occurrences(self, words: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
        """For each length of window: the windows that occur, at which word each, the length, and
        which items have each window, as bounds and numbers."""
        if not self.windows or not len(words) or (made := self.index(words, row)) is None:
            return
        index, origin = made
        for patterns, cuts, items in self.windows:
            lo, hi = index.search(patterns)
            n = hi - lo
            which = np.repeat(np.arange(len(n)), n)
            if len(which):
                suffix = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]
                yield which, origin[index.locate(suffix)], patterns.shape[1], cuts, items


def _runs(mark: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of marked words of a document start and stop."""
    if not len(mark):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = row[1:] != row[:-1]
    start = np.flatnonzero(mark & np.append(True, new | ~mark[:-1]))
    return start, np.flatnonzero(mark & np.append(new | ~mark[1:], True)) + 1


ITEMS = pa.schema([("item", pa.string()), ("words", pa.list_(pa.int64()))])


def write_phrases(items: DataFrame) -> tuple[str, int]:
    """The folder with the items' words in blocks, and the number of blocks."""
    spark = items.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            data, _, start, stop, bounds = word_spans(b.column("text"))
            words = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(word_hashes(data, start, stop).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("item"), words], ["item", "words"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    made, at_made = settle_at(named.mapInArrow(run, "item string, words array<long>").where(F.size("words") > 0).distinct())
    total = made.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
    blocks = -(-total // BLOCK)
    folder = shared_dir(spark)
    block = F.pmod(F.xxhash64("item", "words"), F.lit(max(blocks, 1))).cast("int")
    made.withColumn("block", block).repartition(max(blocks, 1), "block").write.partitionBy("block").parquet(folder)
    discard(spark, at_made)
    return folder, blocks


def _phrases(folder: str, block: int, window: int) -> Phrases:
    t = rows_of_folder(f"{folder}/block={block}", ITEMS)
    words = pa.concat_arrays(t.column("words").chunks or [pa.array([], ITEMS.field("words").type)])
    bounds = np.append(0, np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    return Phrases(t.column("item").to_pylist(), words.flatten().to_numpy().view(np.uint64), bounds, window)


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, cut: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``spans`` (of its words, from and to, that occurrences of
    windows cover) and ``items``, the ids of the items with windows that occur, as strings in order; with
    ``cut`` the text is without the spans' bytes, from the first word's first to the last word's last."""
    added = {"n_words": "long", "n_hit": "long", "spans": "array<struct<start:int,stop:int>>", "items": "array<string>"}
    docs = docs.drop(*added)
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{k} {v}" for k, v in added.items())])
    folder, blocks = write_phrases(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _phrases(folder, 0, window) if blocks == 1 else None
        for b in pieces(batches, size=SHARD):
            data, ends, start, stop, bounds = word_spans(b.column("text"))
            words, row = word_hashes(data, start, stop), np.repeat(np.arange(b.num_rows), np.diff(bounds))
            del data
            edges, met = np.zeros(len(words) + 1, np.int64), [set() for _ in range(b.num_rows)]
            for k in range(blocks):
                phrases = held or _phrases(folder, k, window)
                for which, at, length, cuts, items in phrases.occurrences(words, row):
                    edges += np.bincount(at, minlength=len(edges)) - np.bincount(at + length, minlength=len(edges))
                    for r, w in np.unique(np.stack([row[at], which]), axis=1).T.tolist():
                        met[r].update(phrases.names[i] for i in items[cuts[w] : cuts[w + 1]].tolist())
            hit = np.cumsum(edges)[:-1] > 0
            a, z = _runs(hit, row)
            spans = pa.StructArray.from_arrays([pa.array((x - bounds[row[a]]).astype(np.int32)) for x in (a, z)], ["start", "stop"])
            of = np.searchsorted(row[a], np.arange(b.num_rows + 1))
            columns = [b.column(c) for c in names]
            if cut:
                texts = b.column("text").to_pylist()
                for r in np.flatnonzero(np.diff(of)).tolist():
                    own, at, left = texts[r].encode(), 0, []
                    for i in range(of[r], of[r + 1]):
                        left.append(own[at : start[a[i]] - ends[r]])
                        at = stop[z[i] - 1] - ends[r]
                    texts[r] = b"".join([*left, own[at:]]).decode()
                columns[names.index("text")] = pa.array(texts, pa.string())
            n_hit = np.diff(np.append(0, np.cumsum(hit))[bounds])
            made = [pa.array(np.diff(bounds).astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), spans), pa.array([sorted(m) for m in met], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, *made], [*names, *added])

    return docs.mapInArrow(run, schema)
