"""N-gram Jaccard join: the chosen-path method, with exact answers in its groups.

A document is the set of its five-word shingles; equal sets are one node. In each run a
set of n shingles picks each with chance 1/(lambda n), by a hash that all sets share, so
two sets of similarity ``threshold`` expect to pick one in common; each pick is a bucket.
Runs are repeated until a pair shares none with a chance below half of ``1 - recall``. The
sets of buckets of more than ``SMALL`` are dealt together to trees: at each level of a tree a
set goes to the bucket of one sampled value of its minwise sketch (the tokens of the embedded
set), which two sets share with the chance of their similarity. Only buckets that are still
large go a level deeper, ``DEPTH`` at most; what is large even then is compared in blocks. There
are as many trees as it takes that a pair, also one whose sketches are less alike by twice
``SPREAD``, stays together in one down to the last level but for the other half of ``1 - recall``.

Within buckets sketches are compared, at a limit that a true pair meets but for chances
of a few in a million, and what is near is linked to one of its bucket. The components of these
links are small groups; their texts come together once, all pairs in a group are compared
exactly, and only links of at least ``threshold`` count. A group of more than ``ROWS`` sets or
``TOKENS`` shingles is cut to blocks, and each pair of blocks meets in a task: the work is
quadratic in the different sets of a group, as their links are counted one by one. No pair is
ever a row: blocks return a row per member, with its number of links and its component in
the block.

``join`` returns one row per document: ``digest`` (of its text), ``node`` (its set),
``class_id`` (the least doc_id of its component), ``n_links`` (other documents at
``threshold`` or more, copies included) and ``first`` (whether it has the class's least id,
and the least digest of those).

Defined results for odd input: null and wordless texts are the empty set, copies of each
other and linked to nothing else; texts of one to four words have one shingle; a null
doc_id is kept and takes part, but names a class only if the whole class has none;
repeated rows are copies; a text of any length is one set, taken whole, one in a task at
once at least; an empty table gives none. ``join`` reads ``doc_id`` and ``text`` only;
``keep_first`` keeps all columns, but for ``__text``, ``__id`` and ``__digest``, which it drops.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, partitions, pieces, settle, settle_at
from gridloom.llm.components import components
from gridloom.llm.shingles import WORDS, mix, shingle_sets

THRESHOLD, RECALL = 0.8, 0.999
BINS = 128
SMALL, BLOCK, DEPTH = 4096, 1024, 4
ROWS, TOKENS = 2048, 1 << 20
#: Sets in groups, of some 60 bytes each, that are broadcast; more are joined by a shuffle.
MOST = 500_000
#: of the likeness of two sketches, about the similarity of their sets
SPREAD = 0.035
#: So many deviations below the threshold a pair's sketches may be alike and still are looked at.
DEVIATIONS = 5.66
SETS = "doc_id long, digest long, node long, n int, sketch binary, buckets array<long>"


def _node(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(tokens: np.ndarray) -> bytes:
    """One byte per bin: of the bin's least token, 0 if it has none. Tokens are sorted
    and their leading bits are the bin."""
    out = np.zeros(BINS, np.uint8)
    bins = (tokens >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[first]] = (mix(tokens[first], 77) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def _picks(tokens: np.ndarray, runs: int, threshold: float) -> np.ndarray:
    if not len(tokens):
        return np.empty(0, np.int64)
    chance = 1 / (threshold * len(tokens))
    out = []
    for run in range(runs):
        h = mix(tokens, 1000 + run)
        out.append(mix(h[h < np.uint64(int(chance * 2**64))] if chance < 1 else h, run))
    return np.unique(np.concatenate(out)).view(np.int64)


def sets(docs: DataFrame, threshold: float, runs: int, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = shingle_sets(b.column("text"), words)
            picks = [_picks(t, runs, threshold) for t in found]
            cut = np.cumsum([0, *map(len, picks)]).astype(np.int32)
            columns = [
                b.column("doc_id"),
                b.column("digest"),
                pa.array([_node(t) for t in found], pa.int64()),
                pa.array([len(t) for t in found], pa.int32()),
                pa.array([_sketch(t) for t in found], pa.binary()),
                pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(picks))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "node", "n", "sketch", "buckets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text").mapInArrow(run, SETS)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, which the input is sorted by."""
    held: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[:, i].tolist())
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(i, j - i))
            last = key
    if held:
        yield pa.concat_tables(held)


def _merge(labels: np.ndarray, i: int, near: np.ndarray) -> None:
    """Joins the labels of ``i`` and ``near``."""
    met = np.unique(np.append(labels[near], labels[i]))
    if len(met) > 1:
        labels[np.isin(labels, met)] = met[0]


def _spread(threshold: float) -> float:
    """The deviation of the likeness of two sketches of sets of that similarity."""
    return math.sqrt(threshold * (1 - threshold) / BINS)


def _near(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links each member of a bucket's components by sketch to one of them."""
    a, b = [], []
    limit = max(threshold - DEVIATIONS * _spread(threshold), 0.0)
    # in whole numbers, and a little below, for thresholds like 0.8
    ratio = round(threshold * 10_000) - 1
    for g in _groups(batches, ["bucket", "i", "j"]):
        if g.num_rows < 2:
            continue
        node = g.column("node").to_numpy()
        n = g.column("n").to_numpy()
        s = np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        full, labels = s != 0, np.arange(len(node))
        for i in range(len(node) - 1):
            rest = s[i + 1 :]
            same = ((rest == s[i]) & full[i]).sum(1)
            some = (full[i + 1 :] | full[i]).sum(1)
            near = (same >= limit * some) & (np.minimum(n[i + 1 :], n[i]).astype(np.int64) * 10_000 >= ratio * np.maximum(n[i + 1 :], n[i]).astype(np.int64))
            if near.any():
                _merge(labels, i, i + 1 + np.flatnonzero(near))
        other = labels != np.arange(len(node))
        a += node[other].tolist()
        b += node[labels[other]].tolist()
        if len(a) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _trees(threshold: float, missed: float) -> int:
    """So many trees that a pair of ``threshold``, and of sketches less alike by twice
    ``SPREAD``, comes apart in all of them before the last level with a chance of ``missed`` at
    most."""
    return math.ceil(math.log(missed) / math.log1p(-((threshold - 2 * max(SPREAD, _spread(threshold))) ** DEPTH)))


def _children(s: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
    """The buckets below ``at`` that sets of sketches ``s`` go to: of the sampled bin's value."""
    h = mix(mix(at, 31 + level)[:, None] ^ mix(np.arange(BINS, dtype=np.uint64), level)[None, :])
    bin_ = np.where(s != 0, h, np.uint64(2**64 - 1)).argmin(1)
    row = np.arange(len(s))
    return mix(h[row, bin_] ^ s[row, bin_], 63)


def _split(rows: DataFrame, level: int, trees: int) -> DataFrame:
    """The trees' next level: each set goes to the bucket of the sampled one of its sketch's
    bins. ``bucket`` is the one before; at the first level each set goes to all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                s = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
                seeds = [mix(np.full(len(s), t, np.uint64), 31) for t in range(trees)] if level == 0 else [b.column("bucket").to_numpy().view(np.uint64)]
                for at in seeds:
                    child = _children(s, at, level)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column("node")], ["bucket", "node"])

    return rows.select("bucket", "node", "sketch").mapInArrow(run, "bucket long, node long")


def _blocks(rows: DataFrame, key: str, size: DataFrame, blocks: Column) -> DataFrame:
    """Adds ``i, j, side``: each pair of blocks of a group gets both blocks' rows."""
    rows = rows.join(size.select(key, blocks.cast("int").alias("__nb")), key)
    own = F.pmod(F.xxhash64("node"), F.col("__nb")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("__nb") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j"), own.alias("side")))
    return rows.withColumn("__p", F.explode(pair)).select("*", "__p.*").drop("__p", "__nb")


def candidates(nodes: DataFrame, threshold: float, missed: float) -> DataFrame:
    """Links ``a, b`` between sets whose sketches are near, a tree of links per bucket;
    a pair that shares a bucket is not brought together with a chance below ``missed``."""
    spark, about = nodes.sparkSession, nodes.select("node", "n", "sketch")
    live = nodes.select("node", F.explode("buckets").alias("bucket"))
    links, trees, at_before = None, _trees(threshold, missed), None
    for level in range(DEPTH + 1):
        # written first, so that a hot bucket's rows are joined to it in parts
        size, at_size = settle_at(live.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        live, at_live = settle_at(live.join(size, "bucket"))
        for path in (at_size, at_before) if at_before else (at_size,):
            discard(spark, path)
        at_before = at_live
        if level and live.isEmpty():
            break
        last = level == DEPTH
        here = live if last else live.where(F.col("size") <= SMALL)
        sized = here.select("bucket", "size").distinct()
        found = _blocks(here.drop("size").join(about, "node"), "bucket", sized, F.ceil(F.col("size") / BLOCK))
        found = found.repartition(partitions(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        found = settle(found.mapInArrow(lambda rows: _near(rows, threshold), "a long, b long").distinct())
        links = found if links is None else links.unionByName(found)
        large = live.where(F.col("size") > SMALL)
        if last or large.isEmpty():
            break
        if level == 0:
            large = large.select("node", F.lit(0).cast("long").alias("bucket")).distinct()
        live, at_split = settle_at(_split(large.select("node", "bucket").join(about, "node"), level, trees))
        discard(spark, at_before)
        at_before = at_split
    discard(spark, at_before)
    return links


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without rows that repeat the one before in group and node, as copies of a row do."""
    keys, last = ["label", "i", "j", "node"], None
    for b in batches:
        if b.num_rows:
            k = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
            new = np.append(last is None or (k[:, 0] != last).any(), (k[:, 1:] != k[:, :-1]).any(0))
            last = k[:, -1]
            yield b if new.all() else b.filter(pa.array(new))


VERIFIED = "node long, links long, root long"


def _verify(threshold: float, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(_once(batches), ["label", "i", "j"]):
            node, side, copies = (g.column(c).to_numpy() for c in ("node", "side", "copies"))
            tokens = [t for b in pieces(iter(g.select(["text"]).combine_chunks().to_batches())) for t in shingle_sets(b.column("text"), words)]
            # texts of equal digests may differ
            mine = np.flatnonzero([_node(t) == k for t, k in zip(tokens, node.tolist(), strict=True)])
            mine = mine[np.unique(node[mine], return_index=True)[1]]
            if len(mine) < 2:
                continue
            node, side, copies, tokens = node[mine], side[mine], copies[mine], [tokens[m] for m in mine]
            size = np.array([len(t) for t in tokens])
            all_, at = np.unique(np.concatenate(tokens), return_inverse=True)
            start = np.cumsum([0, *size[:-1]])
            one = side[0] == side[-1] and len(np.unique(side)) == 1
            same_block = g.column("i")[0].as_py() == g.column("j")[0].as_py()
            links, labels = np.zeros(len(node), np.int64), np.arange(len(node))
            if not one or same_block:
                mark = np.zeros(len(all_), np.int32)
                for i in range(len(node) - 1):
                    own = at[start[i] : start[i] + size[i]]
                    mark[own] = 1
                    both = np.add.reduceat(mark[at[start[i + 1] :]], start[i + 1 :] - start[i + 1])
                    mark[own] = 0
                    # 10 times over, in whole numbers, for thresholds like 0.8
                    near = both * 10_000 >= round(threshold * 10_000) * (size[i] + size[i + 1 :] - both)
                    if not same_block:
                        near &= side[i + 1 :] != side[i]
                    near = i + 1 + np.flatnonzero(near)
                    if len(near):
                        links[i] += copies[near].sum()
                        links[near] += copies[i]
                        _merge(labels, i, near)
            some = np.flatnonzero(links)
            columns = [pa.array(node[some]), pa.array(links[some]), pa.array(node[labels[some]])]
            yield pa.RecordBatch.from_arrays(columns, ["node", "links", "root"])

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS) -> DataFrame:
    """One row per document: ``doc_id, digest, node, class_id, n_links, first``. A threshold is
    at least 0.3: below, sketches of a pair are hardly more alike than those of others."""
    if not 0.3 <= threshold <= 1:
        raise ValueError("a threshold is from 0.3 to 1")
    spark = docs.sparkSession
    missed = (1 - recall) / 2
    runs = math.ceil(-math.log(missed))
    made = settle(sets(docs, threshold, runs, words))
    lead = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    nodes = made.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(lead).alias("lead"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("buckets").alias("buckets"))
    nodes = settle(nodes)
    groups = components(candidates(nodes, threshold, missed))
    members, at_members = settle_at(groups.join(nodes.select("node", "lead", "copies", "n"), "node").select("label", "node", "copies", "n", F.col("lead.doc_id").alias("__id"), F.col("lead.digest").alias("__digest")))
    size = members.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens"))
    # one document of each set, by id and text, so that rows without an id do not all meet
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    # those of up to MOST sets are found in place, and only their texts are shuffled
    sent = F.broadcast(members) if members.count() <= MOST else members
    texts = mine.join(sent, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")))
    number = F.greatest(F.ceil(F.col("size") / ROWS), F.ceil(F.col("tokens") / TOKENS))
    blocks = _blocks(texts.select("label", "node", "copies", "text"), "label", size, number)
    blocks = blocks.repartition(partitions(spark), "label", "i", "j").sortWithinPartitions("label", "i", "j", "node")
    verified = settle(blocks.mapInArrow(_verify(threshold, words), VERIFIED))
    discard(spark, at_members)
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    info = nodes.select("node", "copies").join(links, "node", "left").join(classes, "node", "left")
    info = info.select("node", F.coalesce("label", "node").alias("label"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    info = settle(info)
    leads = nodes.select("node", "lead").join(info.select("node", "label"), "node").groupBy("label").agg(F.min("lead").alias("lead"))
    info = info.join(leads, "label").select("node", "lead", "n_links")
    out = made.select("doc_id", "digest", "node").join(info, "node")
    first = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("digest") == F.col("lead.digest"))
    return out.select("doc_id", "digest", "node", F.col("lead.doc_id").alias("class_id"), "n_links", first.alias("first"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that are the first of their class, one for each class."""
    kept = join(docs, threshold, recall, words).where("first").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    marked = docs.withColumn("__text", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__digest"))
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__text"]).drop("__text")
