"""Suffix-array dedup: removes each byte of a string of ``length`` bytes seen before.

Equal strings of ``length`` bytes contain the same anchor, the 24-byte gram of least hash
in them, at the same place. So only anchors that occur twice can mark repeats, and all
that is compared is what stands around such anchors:

1. each anchor, with a hash of its context, the bytes that strings around it can reach, is
   brought to the others of its hash; equal contexts of one piece of input are one row;
2. of equal contexts the first is kept: all strings in the others have come before. Contexts
   are told apart by a 64-bit hash among those of one anchor's 64-bit hash, so of k contexts of
   an anchor two are taken for equal with a chance of k * k / 2**65;
3. where an anchor has several contexts, the first of each are cut from the texts, which
   are read in place, and laid end to end in order of place; a suffix array (prefix doubling,
   cut at ``length``) gives each string's previous and next smaller places in suffix order; the
   longer match with one of them is its longest previous factor, and where that reaches
   ``length`` the string has come before;
4. the runs to remove are merged per document.

The contexts of an anchor that has more than ``MANY`` are too many for one task: their strings
are grouped by 128-bit digest and the first of each is found by a merge before the shuffle.
An anchor's rows, one for each context in a piece of input, stream through one task sorted
and are never held there.

Order is by doc_id, then place. Defined results for odd input: a null text is empty and
a null doc_id comes first; documents that repeat an id are told apart by their text, in
order of its digest, and those that repeat both are one document, judged once, with the
same result for each; a text of any length up to 2 GB is taken whole, in parts where it is
hashed; an empty table gives none; extra columns are kept by ``remove_repeats``, but for those
it adds and ``__id``, ``__salt`` and ``__file``, which it drops.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import by_file, discard, from_files, partitions, pieces, rows_of_file, same_file, settle_at, text_bytes
from gridloom.llm.shingles import mix, powers

LENGTH, GRAM = 100, 24
MANY = 5_000
BATCH = 768 << 10
PLACES, PART = 28, 4 << 20


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    at = 1
    while at * 2 <= width:
        a = np.minimum(a[:-at], a[at:])
        at *= 2
    return np.minimum(a[: len(a) - (width - at)], a[width - at :])


def _anchors(data: np.ndarray, whole: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Per run of the strings that start at ``whole`` and have one anchor: the anchor's place
    and hash, and the run's first and last string."""
    h, at, p = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    bits, grams, size = gram, None, 0
    while bits:  # grams of 1, 2, 4 ... bytes, put together as the binary digits say
        if bits & 1:
            grams = h if grams is None else grams[: len(h) - size] * np.uint64(pow(p, at, 1 << 64)) + h[size:][: len(grams) - at]
            size += at
        bits >>= 1
        if bits:
            h = h[:-at] * np.uint64(pow(p, at, 1 << 64)) + h[at:]
            at *= 2
    grams = mix(grams)
    # the leading bits of the hash, then the place: the least is the leftmost of the least
    place = np.uint64((1 << PLACES) - 1)
    least = _sliding_min((grams & ~place) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    own = (least[whole] & place).astype(np.int64)
    first = np.append(0, np.flatnonzero(own[1:] != own[:-1]) + 1)
    stop = np.append(first[1:], len(own)) - 1
    return own[first], grams[own[first]], whole[first], whole[stop]


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int = GRAM, part: int = PART) -> tuple[np.ndarray, ...]:
    """Of all strings of ``length`` bytes in the rows: their anchors' places and hashes, and
    the bounds of the bytes of the strings that have this anchor. Anchors follow each
    other as strings do, the leftmost among equals. Strings are taken ``part`` at a time, so
    that places within a part are small, however long a text is."""
    found = []
    for lo in range(0, max(len(data) - length + 1, 0), part):
        row = np.searchsorted(ends, [lo, min(lo + part, len(data))], "right")
        near = ends[max(row[0] - 1, 0) : row[1] + 1]
        inside = np.arange(lo, min(lo + part, len(data) - length + 1))
        whole = inside[inside + length <= near[np.searchsorted(near, inside, "right")]]
        if len(whole):
            at, h, start, last = _anchors(data[lo : lo + part + length - 1], whole - lo, length, gram)
            found.append((at + lo, h, start + lo, last + lo))
    if not found:
        return (np.empty(0, np.int64),) * 4
    at, h, start, last = (np.concatenate(x) for x in zip(*found, strict=True))
    # a run that goes over the end of a part is one
    new = np.append(True, at[1:] != at[:-1])
    return at[new], h[new], start[new], last[np.append(new[1:], True)] + length


OCCUR = "h long, c long, doc_id long, salt long, start int, stop int, more binary"
PLACE = np.dtype([("doc_id", "<i8"), ("salt", "<i8"), ("start", "<i4"), ("stop", "<i4")])


def context_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, at: np.ndarray, part: int = PART) -> np.ndarray:
    """A hash of the bytes from each start to each stop, and of where the anchor is; about
    ``part`` bytes are taken at a time."""
    out = np.empty(len(start), np.uint64)
    cuts = [0, *(np.flatnonzero(np.diff(start // part)) + 1).tolist(), len(start)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if j == i:
            continue
        lo, hi = int(start[i]), int(stop[i:j].max())
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * powers(0xD6E8FEB86659FD93, hi - lo), out=total[1:])
        inverse = powers(pow(0xD6E8FEB86659FD93, -1, 1 << 64), hi - lo)
        a, b, c = start[i:j] - lo, stop[i:j] - lo, at[i:j] - lo
        out[i:j] = mix(mix((total[b] - total[a]) * inverse[a], 9) + ((b - a) << 16 | (c - a)).astype(np.uint64))
    return out


def _occurrences(length: int):
    """A row for each context of a piece of input, its first place there, with the places
    where the piece has it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, size=2 << 20):
            data, ends = text_bytes(b.column("text"))
            at, h, start, stop = anchors(data, ends, length)
            if not len(at):
                continue
            row = np.searchsorted(ends, at, "right") - 1
            c = context_hashes(data, start, stop, at)
            o = np.zeros(len(at), PLACE)
            o["doc_id"] = b.column("doc_id").to_numpy(zero_copy_only=False)[row]
            o["salt"] = b.column("salt").to_numpy(zero_copy_only=False)[row]
            o["start"], o["stop"] = start - ends[row], stop - ends[row]
            order = np.lexsort((o["start"], o["salt"], o["doc_id"], c, h))
            h, c, o = h[order], c[order], o[order]
            # rows that repeat a document have it twice
            once = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (o[1:] != o[:-1]))
            h, c, o = h[once], c[once], o[once]
            new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(h))
            more = [o[i + 1 : j].tobytes() if j > i + 1 else None for i, j in zip(first.tolist(), last.tolist(), strict=True)]
            columns = [pa.array(h[first].view(np.int64)), pa.array(c[first].view(np.int64)), *(pa.array(o[k][first]) for k in PLACE.names), pa.array(more, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["h", "c", *PLACE.names, "more"])

    return run


CLASSES = "kind int, h long, doc_id long, salt long, start int, stop int"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, context and place: of kind 0 every place but the first of
    each context, of kind 1 the first places where an anchor has several contexts."""

    def rows(kind: int, h: np.ndarray, o: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h), *(pa.array(o[k].copy()) for k in PLACE.names)], ["kind", "h", *PLACE.names])

    before_h = before_c = before_o = None
    waiting = None  # the only first place so far of the anchor that the last batch ended in
    for b in batches:
        if not b.num_rows:
            continue
        h, c = b.column("h").to_numpy(), b.column("c").to_numpy()
        o = np.zeros(len(h), PLACE)
        for k in PLACE.names:
            o[k] = b.column(k).to_numpy()
        new_h = np.append(h[0] != before_h, h[1:] != h[:-1])
        new_c = new_h | np.append(c[0] != before_c, c[1:] != c[:-1])
        same = np.append(before_o is not None and o[0] == before_o, o[1:] == o[:-1])
        again = [o[~new_c & ~same]]
        for x in b.column("more").drop_null().to_pylist():
            again.append(np.frombuffer(x, PLACE))
        again = np.concatenate(again)
        yield rows(0, np.zeros(len(again), np.int64), again)
        first = np.flatnonzero(new_c)
        group = np.cumsum(new_h)[first]
        classes = np.bincount(group, minlength=int(new_h.sum()) + 1)
        several = classes >= 2
        if classes[0]:  # goes on with the anchor of the batch before
            several[0] = True
            if waiting is not None:
                yield rows(1, h[:1], waiting)
                waiting = None
        take = first[several[group]]
        yield rows(1, h[take], o[take])
        if new_h.any():  # group 0 is over
            waiting = None if several[-1] else o[first[-1:]]
        before_h, before_c, before_o = h[-1], c[-1], o[-1]


CONTEXT = "h long, doc_id long, salt long, start int, ctx binary"


def _contexts(folder: str):
    """The bytes of the marked contexts, cut from the documents in place."""
    entry = pa.schema([("doc_id", pa.int64()), ("salt", pa.int64()), ("marks", pa.list_(pa.struct([("h", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, marks = None, {}
        for of, b in same_file(pieces(batches, size=256 << 10)):
            if of != file:
                own = rows_of_file(folder, of, entry)
                keys = zip(own.column("doc_id").to_pylist(), own.column("salt").to_pylist(), strict=True)
                file, marks = of, {k: i for i, k in enumerate(keys)}
                listed = pa.concat_arrays(own.column("marks").chunks or [pa.array([], entry.field("marks").type)])
            out: list[tuple] = []
            for doc, salt, text in zip(*(b.column(k).to_pylist() for k in ("doc_id", "salt", "text")), strict=True):
                # once is enough where a document is there twice
                at = marks.pop((doc, salt), None)
                if at is None:
                    continue
                data, m = text.encode(), listed[at].values
                out += [(h, doc, salt, i, data[i:j]) for h, i, j in zip(*(m.field(k).to_pylist() for k in range(3)), strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in CONTEXT.split(", ")])

    return run


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """The rank of each suffix by its first ``length`` bytes (eight at least), by prefix
    doubling from eight bytes on; bytes after the end of the data count as zeros."""

    def dense(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        k = key[order]
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(np.append(False, k[1:] != k[:-1]))
        return rank

    n = len(data)
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(min(8, length)):
        key |= padded[i : n + i] << np.uint64(8 * (7 - i))
    rank, size = dense(key), 8
    while size < length:
        step = min(size, length - size)
        after = np.zeros(n, np.uint64)
        after[: max(n - step, 0)] = rank[step:] + np.uint64(1)
        rank = dense(rank * np.uint64(n + 1) + after)
        size += step
    return rank


def nearest_smaller(v: np.ndarray) -> np.ndarray:
    """For each place the nearest before it with a smaller value, or -1; all at once, by
    jumping over what is known not to be smaller."""
    p = np.arange(len(v)) - 1
    open_ = np.flatnonzero((p >= 0) & (v[np.maximum(p, 0)] >= v))
    while len(open_):
        p[open_] = p[p[open_]]
        q = p[open_]
        open_ = open_[(q >= 0) & (v[np.maximum(q, 0)] >= v[open_])]
    return p


def seen_before(data: np.ndarray, group: np.ndarray, age: np.ndarray, inside: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of ``length`` bytes at each place has a longest previous factor
    of that length. ``age`` orders places (equal: the same place), ``inside`` says where
    a whole string starts, and only strings of one ``group`` are compared."""
    at = np.flatnonzero(inside)
    rank = suffix_ranks(data, length)[at] * np.uint64(group.max(initial=0) + 1) + group[at].astype(np.uint64)
    by = np.lexsort((age[at], rank))
    order = at[by]
    # within the suffixes of one rank the oldest stand first, so a smaller age before is
    # the previous smaller place; after it, in the reversed order, the next smaller one
    v, r = age[order], rank[by]
    out = np.zeros(len(data), bool)
    for flip in (slice(None), slice(None, None, -1)):
        p = nearest_smaller(v[flip])
        hit = (p >= 0) & (r[flip][np.maximum(p, 0)] == r[flip])
        out[order[flip][hit]] = True
    return out


RUNS = "doc_id long, salt long, start int, stop int"


def _merged(doc, salt, starts: np.ndarray, length: int, out: list) -> None:
    if len(starts):
        cut = np.flatnonzero(np.diff(starts) > length)
        for i, j in zip([0, *(cut + 1).tolist()], [*cut.tolist(), len(starts) - 1], strict=True):
            out.append((doc, salt, int(starts[i]), int(starts[j]) + length))


def _runs_batch(out: list) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], ["doc_id", "salt", "start", "stop"])


def _factors(length: int):
    """Suffix arrays over the contexts of whole anchors, about ``BATCH`` bytes at once."""

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[1], r[2], r[3]))
        size = np.array([len(r[4]) for r in rows])
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        first = np.cumsum(size) - size
        row = np.repeat(np.arange(len(rows)), size)
        within = np.arange(len(data)) - first[row]
        group = np.unique([r[0] for r in rows], return_inverse=True)[1]
        same = np.array([0, *(a[1:3] != b[1:3] for a, b in zip(rows, rows[1:], strict=False))]).cumsum()
        place = np.array([r[3] for r in rows])[row] + within
        age = same[row].astype(np.int64) * (1 << 32) + place
        seen = seen_before(data, group[row], age, within + length <= size[row], length)
        out: list[tuple] = []
        hits = np.flatnonzero(seen)
        cut = np.searchsorted(row[hits], np.arange(len(rows) + 1))
        for i in np.unique(row[hits]).tolist():
            _merged(rows[i][1], rows[i][2], place[hits[cut[i] : cut[i + 1]]], length, out)
        return _runs_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("h", "doc_id", "salt", "start", "ctx")), strict=True):
                if size > BATCH and r[0] != held[-1][0]:
                    yield judge(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield judge(held)

    return run


def _strings(length: int):
    """Every string of a context by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                out = []
                for h, doc, salt, start, ctx in zip(*(b.slice(i, 256).column(c).to_pylist() for c in ("h", "doc_id", "salt", "start", "ctx")), strict=True):
                    out += [(hashlib.blake2b(ctx[s : s + length], digest_size=16).digest(), doc, salt, start + s) for s in range(len(ctx) - length + 1)]
                columns = list(zip(*out, strict=True)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.binary(), pa.int64(), pa.int64(), pa.int32()], strict=True)], ["c", "doc_id", "salt", "start"])

    return run


def _later(strings: DataFrame) -> DataFrame:
    """The rows that are not the first place of their string; the first is merged before
    the shuffle."""
    place = F.struct("doc_id", "salt", "start")
    first = strings.groupBy("c").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    return strings.join(first.where("n > 1"), "c").where(place > F.col("first"))


def repeated_runs(docs: DataFrame, length: int = LENGTH, many: int = MANY) -> str:
    """The folder with, by input file, ``doc_id, salt, runs``: the runs of bytes to remove
    from each document that has any, as sorted ``(start, stop)`` that may overlap.
    ``docs``: ``doc_id, salt, text, __file``."""
    spark = docs.sparkSession
    n = partitions(spark)
    where = docs.select("doc_id", "salt", F.col("__file").alias("file")).distinct()
    found = docs.mapInArrow(_occurrences(length), OCCUR)
    found = found.repartition(n, "h").sortWithinPartitions("h", "c", "doc_id", "salt", "start")
    found, at_found = settle_at(found.mapInArrow(_classes, CLASSES))
    marks = found.where("kind = 1").groupBy("doc_id", "salt").agg(F.collect_list(F.struct("h", "start", "stop")).alias("marks"))
    folder = by_file(marks.join(where, ["doc_id", "salt"]))
    contexts, at_contexts = settle_at(docs.mapInArrow(_contexts(folder), CONTEXT))
    discard(spark, folder)
    large, at_large = settle_at(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many).select("h"))
    runs = found.where("kind = 0").select("doc_id", "salt", "start", "stop")
    few = contexts
    if not large.isEmpty():
        few = contexts.join(large, "h", "left_anti")
        strings = contexts.join(large, "h", "left_semi").mapInArrow(_strings(length), "c binary, doc_id long, salt long, start int")
        runs = runs.unionByName(_later(strings).select("doc_id", "salt", "start", (F.col("start") + length).alias("stop")))
    factors = few.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_factors(length), RUNS)
    runs = runs.unionByName(factors).groupBy("doc_id", "salt").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("runs"))
    folder = by_file(runs.join(where, ["doc_id", "salt"]))
    for path in (at_found, at_contexts, at_large):
        discard(spark, path)
    return folder


def remove_repeats(docs: DataFrame, length: int = LENGTH, many: int = MANY, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256`` and, in place of
    ``text``, what is left of it; parts of a character that stand at the edges of what
    was removed are left out of the text, but not of the digest. Without ``keep_text``
    the text is left out."""
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*added, "__id", "__salt", "__file")
    names = [c for c in docs.columns if keep_text or c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names), "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"])
    docs = from_files(docs)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    # only where an id stands for several rows must their texts tell them apart
    alone = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    salt = F.lit(0).cast("long") if alone else F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.withColumns({"__id": key, "__salt": salt})
    plain = keyed.select(F.col("__id").alias("doc_id"), F.col("__salt").alias("salt"), F.coalesce("text", F.lit("")).alias("text"), "__file")
    folder = repeated_runs(plain, length, many)
    entry = pa.schema([("doc_id", pa.int64()), ("salt", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, runs, listed = None, {}, None
        for of, b in same_file(pieces(batches, size=4 << 20)):
            if of != file:
                own = rows_of_file(folder, of, entry)
                file, runs = of, {k: i for i, k in enumerate(zip(own.column("doc_id").to_pylist(), own.column("salt").to_pylist(), strict=True))}
                listed = pa.concat_arrays(own.column("runs").chunks or [pa.array([], entry.field("runs").type)])
            out: list[tuple] = []
            for doc, salt, text in zip(*(b.column(k).to_pylist() for k in ("__id", "__salt", "text")), strict=True):
                data = (text or "").encode()
                parts, at, n_spans, removed = [], 0, 0, 0
                if (i := runs.get((doc, salt))) is not None:
                    m = listed[i].values
                    for start, stop in zip(m.field(0).to_pylist(), m.field(1).to_pylist(), strict=True):
                        if start > at or not n_spans:
                            parts.append(data[at:start])
                            n_spans += 1
                            removed += stop - start
                            at = stop
                        elif stop > at:
                            removed += stop - at
                            at = stop
                parts.append(data[at:])
                left = b"".join(parts)
                kept = text if not removed else left.decode("utf-8", "ignore")
                out.append((kept, len(data), removed, n_spans, hashlib.sha256(left).hexdigest()))
            kept, *rest = zip(*out, strict=True)
            columns = [pa.array(kept, pa.string()) if c == "text" else b.column(c) for c in names]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], [*names, *added])

    return keyed.mapInArrow(cut, schema)
