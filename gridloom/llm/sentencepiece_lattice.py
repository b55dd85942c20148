"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut where no piece of the vocabulary can cross (before a space mark, between a
letter and punctuation that follows letters in no piece, and around characters that only
stand alone), and each distinct word is segmented once: its substrings up to the longest
piece's length are exploded and equi-joined to the piece table, by hash and then by string,
the edges found are grouped by word again, and one higher-order ``aggregate`` folds each
word's lattice to the bounds of its pieces. A unigram model folds Viterbi; a BPE model,
whose scores only rank its merges, folds the merges, best first and leftmost among
equals, since the best sum of such scores is not what the model encodes. Characters that
no piece holds become byte pieces. The piece table is the vocabulary, so its size is
bounded, and it is broadcast.

The words of each ``GROUP`` rows of an input file are kept in a table bucketed by word, so
that the distinct words, their lattices and the way back to the groups need no shuffle of
their own. The bounds then go to a folder per group, below the shared folder, and the
documents are read in place; a task holds the words of the group that it reads. Documents
that come from no Parquet file are written to some first.

A word of more than ``LONG`` characters (a run of letters, as other characters are cut) has
more bounds than a number has bits; it is segmented where it stands, by the same rules.

Defined results for odd input: null texts give null pieces, empty ones none; as in any
SentencePiece model a space and the mark itself decode to a space; texts of any length are
taken whole, a task holding one text at once at least; repeated rows are encoded each; an
empty table gives none; extra columns are kept, but for ``ids`` and ``decoded``, which are
replaced. A model with a mark behind another character of a piece is refused.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import by_file, discard, from_files, pieces, rows_of_file, same_file, shared_dir, text_bytes
from gridloom.sources.cube import read_bucketed, write_bucketed

MARK = "▁"
LONG = 60


@dataclass(frozen=True)
class Model:
    """``table``: piece -> (id, score) of normal pieces; ``first_byte``: the id of the
    byte piece 0; ``unigram``: whether scores are log chances."""

    table: dict[str, tuple[int, float]]
    strings: list[bytes]
    first_byte: int
    unigram: bool

    @property
    def longest(self) -> int:
        return max(map(len, self.table))

    @property
    def pattern(self) -> str:
        """Words: marks, then punctuation, then letters. ``inner`` are the characters of longer
        pieces; ``after`` are those of them that follow no letter in a piece, and follow
        only others of this kind."""
        inner = {c for p in self.table if len(p) > 1 for c in p} - {MARK}
        before: dict[str, set[str]] = {}
        for p in self.table:
            for a, b in zip(p, p[1:], strict=False):
                before.setdefault(b, set()).add(a)
        if before.get(MARK, set()) - {MARK}:
            raise ValueError("a piece goes on behind a space mark")
        after = {c for c in inner if not c.isalpha()}
        while crossed := {c for c in after if before.get(c, set()) - after - {MARK}}:
            after -= crossed
        letters, marks = (re.escape("".join(sorted(x))) for x in (inner - after, after))
        words = [f"[{marks}]*[{letters}]+" if marks else f"[{letters}]+"] * bool(letters) + [f"[{marks}]+"] * bool(marks)
        return "|".join([*([f"{MARK}*(?:{'|'.join(words)})"] if words else []), f"{MARK}+", f"[^{MARK}{letters}{marks}]"])

    def ranks(self) -> dict[str, int]:
        return {p: r for r, p in enumerate(sorted(self.table, key=lambda p: (-self.table[p][1], self.table[p][0])))}


def load_model(path: str | None = None) -> Model:
    """A model file; by default the 32k one of the public tokenizers."""
    from sentencepiece import sentencepiece_model_pb2

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    table, strings, first_byte = {}, [], -1
    for i, p in enumerate(proto.pieces):
        if p.type == 1:
            table[p.piece] = (i, p.score)
            strings.append(p.piece.replace(MARK, " ").encode())
        elif p.type == 6:
            value = int(p.piece[3:5], 16)
            first_byte = i if value == 0 else first_byte
            strings.append(bytes([value]))
        else:
            strings.append(b"")
    return Model(table, strings, first_byte, proto.trainer_spec.model_type == 1)


def words(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``file, word``: the words of each group of rows, once for each task that reads it."""
    pattern = model.pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, file, seen = re.compile(pattern).findall, None, set()

        def held() -> Iterator[pa.RecordBatch]:
            listed = [w for w in seen if len(w) <= LONG]
            for i in range(0, len(listed), 32_768):
                part = listed[i : i + 32_768]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(part), pa.int64()), pa.array(part, pa.string())], ["file", "word"])

        for of, b in same_file(pieces(batches, text)):
            if of != file:
                yield from held()
                file, seen = of, set()
            for t in b.column(text).to_pylist():
                if t:
                    seen.update(find(MARK + t.replace(" ", MARK)))
        yield from held()

    return docs.select("__file", text).mapInArrow(run, "file long, word string")


def lattice(distinct: DataFrame, model: Model) -> DataFrame:
    """``word, n, edges`` from ``word``: the pieces found in each word, an edge as one number
    of rank (from bit 32), start (from 6) and length, so that edges sort by rank, then from
    the left. What is partitioned by word stays so: neither exploding nor grouping again
    moves it. Merges need no edges of one character."""
    spark, rank, least = distinct.sparkSession, model.ranks(), 1 if model.unigram else 2
    table = spark.createDataFrame([(p, rank[p] << 32) for p in model.table if len(p) >= least], "found string, rank long")
    sized = distinct.withColumns({"h": F.xxhash64("word"), "n": F.length("word")})
    spans = sized.withColumn("m", F.least(F.col("n"), F.lit(model.longest)))
    spans = spans.select("h", "word", "n", "m", F.explode(F.expr("sequence(0, n * m - 1)")).alias("k"))
    spans = spans.withColumns({"s": F.expr("k div m"), "l": F.expr("k % m + 1")}).where(f"s + l <= n AND l >= {least}")
    spans = spans.select("h", "word", F.expr("substring(word, cast(s as int) + 1, l)").alias("piece"), (F.shiftleft("s", 6) + F.col("l")).alias("span"))
    # numbers are looked up faster than strings; equal hashes are told apart by the string
    edges = spans.withColumn("hash", F.xxhash64("piece")).join(F.broadcast(table.withColumn("hash", F.xxhash64("found"))), "hash").where("piece = found")
    grouped = edges.groupBy("h", "word").agg(F.collect_list(F.col("rank") + F.col("span")).alias("edges"))
    return sized.select("word", "n").join(grouped.select("word", "edges").hint("shuffle_hash"), "word", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<bigint>")))


#: An edge's start and length, the bounds of both ends, and those that stand inside it.
_START, _LENGTH = "cast(shiftright(e, 6) & 63 as int)", "cast(e & 63 as int)"
_EDGE = f"""named_struct('ends', shiftleft(1L, {_START}) | shiftleft(1L, {_START} + {_LENGTH}),
    'inner', shiftleft(shiftleft(1L, {_LENGTH} - 1) - 1L, {_START} + 1))"""


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def fold_merges(grouped: DataFrame) -> DataFrame:
    """``word, bounds``: starting from characters, joins the pair of neighbours of the best
    rank, leftmost first, while there is one. The bounds between pieces are the bits of a
    number: an edge joins a pair where both its ends are bounds and one stands inside. Edges
    that have lost an end, or have nothing inside any more, are dropped on the way."""
    left = "filter(a.edges, x -> (b & x.ends) = x.ends AND (b & x.inner) <> 0)"
    joined = _let("a.b & ~i", "b", f"named_struct('b', b, 'edges', {left})")
    none = "named_struct('b', a.b, 'edges', filter(a.edges, x -> false))"
    step = _let("get(filter(a.edges, x -> bit_count(a.b & x.inner) = 1), 0).inner", "i", f"if(i is null, {none}, {joined})")
    start = f"named_struct('b', shiftleft(1L, n + 1) - 1L, 'edges', transform(sort_array(edges), e -> {_EDGE}))"
    fold = f"aggregate(sequence(2, n), {start}, (a, y) -> if(size(a.edges) = 0, a, {step}), a -> a.b)"
    return grouped.select("word", F.expr(f"if(n < 2, 3L, {fold})").alias("bounds"))


def fold_viterbi(grouped: DataFrame, model: Model) -> DataFrame:
    """``word, bounds``: the segmentation of the largest sum of scores; a character that no
    piece holds costs 10 more than the least score. The state has the best sum and the
    last piece's length for each place so far."""
    unknown = min(s for _, s in model.table.values()) - 10
    scores = "array(" + ", ".join(f"{model.table[p][1]!r}D" for p in model.ranks()) + ")"
    edge = f"named_struct('s', {_START}, 'l', {_LENGTH}, 'score', get(scores, cast(shiftright(e, 32) as int)))"
    s = grouped.crossJoin(F.broadcast(grouped.sparkSession.range(1).select(F.expr(scores).alias("scores"))))
    s = s.withColumn("w", F.expr(f"transform(edges, e -> {edge})"))
    back = f"""array_max(concat(
        transform(filter(w, x -> x.s + x.l = j), x -> named_struct('score', get(a, x.s).score + x.score, 'l', x.l)),
        array(named_struct('score', get(a, j - 1).score + if(exists(w, x -> x.s = j - 1 and x.l = 1), double('-infinity'), {unknown!r}D), 'l', 1))))"""
    best = f"aggregate(sequence(1, n), array(named_struct('score', 0D, 'l', 0)), (a, j) -> concat(a, array({back})))"
    # from the end back: the bounds, as bits
    walk = "aggregate(sequence(1, n), named_struct('b', shiftleft(1L, n), 'at', n), (a, y) -> if(a.at = 0, a, named_struct('b', a.b | shiftleft(1L, a.at - get(best, a.at).l), 'at', a.at - get(best, a.at).l)), a -> a.b)"
    return s.withColumn("best", F.expr(best)).select("word", F.expr(walk).alias("bounds"))


def segment(word: str, model: Model, rank: dict[str, int]) -> list[int]:
    """The same for one long word, in the task that met it."""
    n = len(word)
    if model.unigram:
        unknown, longest = min(s for _, s in model.table.values()) - 10, model.longest
        best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - longest), j):
                entry = model.table.get(word[i:j])
                score = best[i] + (entry[1] if entry else unknown if j - i == 1 else float("-inf"))
                if score > best[j]:
                    best[j], back[j] = score, i
        bounds = [n]
        while bounds[-1]:
            bounds.append(back[bounds[-1]])
        bounds.reverse()
    else:
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        stop = list(range(1, n + 1))
        queue = [(rank[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in rank]
        heapq.heapify(queue)
        while queue:
            _, i, e = heapq.heappop(queue)
            j = after[i] if alive[i] else -1
            if j < 0 or stop[j] != e:
                continue
            alive[j], after[i], stop[i] = False, after[j], stop[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank.get(word[a : stop[b]])) is not None:
                    heapq.heappush(queue, (r, a, stop[b]))
        bounds = [i for i in range(n) if alive[i]] + [n]
    out: list[int] = []
    for i, j in zip(bounds, bounds[1:], strict=False):
        entry = model.table.get(word[i:j])
        out += [entry[0]] if entry else [model.first_byte + v for v in word[i:j].encode()]
    return out


def dictionaries(docs: DataFrame, model: Model, text: str = "text") -> str:
    """Writes the words of each group of rows with the bounds of their pieces; returns the
    folder. The catalogue has the words' table only while it is written and looked up."""
    spark = docs.sparkSession
    place = shared_dir(spark)
    write_bucketed(words(docs, model, text), place, ["word"], in_order=False)
    known = read_bucketed(spark, place)
    grouped = lattice(known.select("word").distinct(), model)
    bounds = fold_viterbi(grouped, model) if model.unigram else fold_merges(grouped)
    folder = by_file(known.join(bounds.hint("shuffle_hash"), "word").select("file", "word", "bounds"))
    discard(spark, place)
    return folder


def ids_of(words: pa.Array, bounds: np.ndarray, model: Model, known: pa.Array, ids: np.ndarray) -> pa.ListArray:
    """The ids between the bounds of each word. ``known``: the pieces, ``ids``: theirs."""
    data, ends = text_bytes(words)
    first = np.flatnonzero((data & 0xC0) != 0x80)
    word = np.searchsorted(ends, first, "right") - 1
    start = np.searchsorted(first, ends[:-1])
    cut = first[(bounds[word] >> (np.arange(len(first)) - start[word])) & 1 == 1]
    offsets = pa.array(np.append(cut, len(data)).astype(np.int32))
    parts = pa.StringArray.from_buffers(len(cut), offsets.buffers()[1], pa.py_buffer(data))
    at = pc.index_in(parts, value_set=known)
    lists = ids[at.fill_null(0).to_numpy()].astype(np.int32)
    count = np.searchsorted(cut, ends)
    strange = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
    if not len(strange):
        return pa.ListArray.from_arrays(pa.array(count.astype(np.int32)), pa.array(lists))
    # the characters that no piece holds become a piece per byte
    size = np.ones(len(cut), np.int64)
    size[strange] = (np.append(cut, len(data))[strange + 1] - cut[strange])
    total = np.append(0, np.cumsum(size))
    out = np.repeat(lists, size)
    for k in strange.tolist():
        out[total[k] : total[k + 1]] = model.first_byte + data[cut[k] : cut[k] + size[k]].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(total[count].astype(np.int32)), pa.array(out))


def _texts(ids: pa.ListArray, strings: pa.Array) -> pa.Array:
    bounds = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))).astype(np.int64)
    joined = pc.binary_join(pa.LargeListArray.from_arrays(bounds, strings.take(pc.list_flatten(ids))), pa.scalar(b"", pa.large_binary()))
    return pa.array([t.decode("utf-8", "replace")[1:] for t in joined.to_pylist()], pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))


def encode(docs: DataFrame, model: Model, text: str = "text", round_trip: bool = False) -> DataFrame:
    """``docs`` with ``ids``, the pieces of each text, and for a ``round_trip`` with
    ``decoded``, the text of these ids."""
    docs = docs.drop("ids", *(["decoded"] if round_trip else []))
    names = docs.columns
    docs = from_files(docs)
    folder = dictionaries(docs, model, text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names), "ids array<int>", *(["decoded string"] if round_trip else [])])
    entry = pa.schema([("word", pa.string()), ("bounds", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, rank = re.compile(model.pattern).findall, None
        file, known, ids = None, None, None
        strings = pa.array(model.strings, pa.large_binary())
        table, numbers = pa.array(list(model.table), pa.string()), np.array([i for i, _ in model.table.values()])
        for b in pieces(batches, text):
            for of, part in same_file(iter([b])):
                if of != file:
                    known = ids = None  # before the next are read
                    own = rows_of_file(folder, of, entry).to_batches(32_768)
                    file, known = of, pa.concat_arrays([x.column("word") for x in own] or [pa.array([], pa.string())])
                    ids = pa.concat_arrays([ids_of(x.column("word"), x.column("bounds").to_numpy(), model, table, numbers) for x in own] or [pa.array([], pa.list_(pa.int32()))])
                    del own
                    pa.default_memory_pool().release_unused()
                texts = part.column(text)
                found = [find(MARK + t.replace(" ", MARK)) if t else [] for t in texts.to_pylist()]
                counts = np.array([len(f) for f in found])
                flat = pa.array([w for f in found for w in f], pa.string())
                at = pc.index_in(flat, value_set=known) if len(known) else pa.nulls(len(flat), pa.int32())
                strange = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
                own = ids
                if len(strange):
                    rank = rank or model.ranks()
                    more = [segment(flat[k].as_py(), model, rank) for k in strange.tolist()]
                    own = pa.concat_arrays([ids, pa.array(more, ids.type)])
                    at = at.to_numpy(zero_copy_only=False).copy()
                    at[strange] = len(ids) + np.arange(len(strange))
                    at = pa.array(at.astype(np.int64))
                taken = own.take(at)
                size = np.append(0, np.cumsum(pc.list_value_length(taken).to_numpy(zero_copy_only=False)))
                bounds = pa.array(size[np.append(0, np.cumsum(counts))].astype(np.int32), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False))
                listed = pa.ListArray.from_arrays(bounds, pc.list_flatten(taken))
                made = [listed, _texts(listed, strings)] if round_trip else [listed]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], [*names, "ids", "decoded"][: len(names) + len(made)])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: Model, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its pieces."""
    encoded = encoded.drop("decoded")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), "decoded string"])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.array(model.strings, pa.large_binary())
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(part.column(ids), strings)], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
