import base64
import hashlib
import itertools

import brute
import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing, sentencepiece_lattice, warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


ROWS = [(1, "http://www.example.com/a?q=1", "<p>x</p>"), (7, "http://example.com/b", "<p>x</p>"), (3, None, None), (4, "", ""), (5, "http://é.org/ä b\r\n", "ü" * 100_000), (6, "http://example.com/b", "\r\n\r\nWARC/1.1\r\n"), (8, "no scheme", "<p>x</p>")]


@pytest.mark.parametrize("block", [warc.BLOCK, 2])
def test_archives_round_trip(spark, block):
    captures = warc.write_archives(pages(spark, ROWS).withColumn("key", F.lit("clash")))
    top = warc.write_index(captures, block)
    got = {r.page_id: r for r in warc.lookup(top, captures).collect()}
    assert len(got) == len(ROWS)
    last = {}
    for i, _, h in ROWS:
        last[h or ""] = max(i, last.get(h or "", i))
    for i, url, h in ROWS:
        data, r = (h or "").encode(), got[i]
        assert (r.url, r.payload_bytes, r.payload_digest) == (url or "", len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))
        assert r.payload == (data if r.record_type == "response" else None)
    missing = spark.createDataFrame([("zzz",), ("",), ("com,example)/b 00000000000000000009",)], "key string")
    assert warc.lookup(top, missing).count() == 0


def test_archives_without_deduplication_of_small_payloads_and_empty(spark):
    found = warc.write_archives(pages(spark, ROWS), min_bytes=1)
    got = {r.page_id: r.record_type for r in warc.lookup(warc.write_index(found), found).collect()}
    assert got[3] == got[4] == "response" and got[1] == "revisit"
    none = warc.write_archives(pages(spark, []))
    assert warc.lookup(warc.write_index(none), none).count() == 0


def test_archives_of_null_and_repeated_ids(spark):
    rows = [(None, "http://a.org/", "<p>n</p>"), (None, "http://a.org/", "<p>n</p>"), (0, "http://a.org/", "<p>0</p>"), (None, "http://a.org/", "<p>0</p>"), (None, None, None)]
    rows += [(5, "http://b.org/", "<p>5</p>"), (5, "http://b.org/", "<p>other</p>"), (9, "http://c.org/", "<p>other</p>"), (6, "http://b.org/", "same"), (6, "http://b.org/", "same")]
    last = {"<p>0</p>": 0, "<p>5</p>": 5, "<p>other</p>": 9, "same": 6}
    captures = warc.write_archives(pages(spark, rows))
    assert captures.count() == captures.select("key").distinct().count() == captures.select("file", "offset").distinct().count() == len(rows)
    want = []
    for i, url, html in rows:
        refers = None if last.get(html) == i else last.get(html)
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, url or "", "response" if refers is None else "revisit", refers, digest, data if refers is None else None))
    for block in (warc.BLOCK, 2):
        found = warc.lookup(warc.write_index(captures, block), captures).collect()
        got = [(r.page_id, r.url, r.record_type, r.refers_to, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in found]
        assert sorted(got, key=str) == sorted(want, key=str)


def mixed(spark, rows, **more):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), **more)


def test_mix_meets_targets_and_repeats(spark):
    rows = [(i, f"s{i % 5}" if i % 11 else None, "w " * (1 + i * 7 % 23)) for i in range(600)] + [(600, "big", None), (601, "big", "w " * 50), (602, "nothing", "")]
    got = mixed(spark, rows).collect()
    sizes, taken, largest = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert 0 <= r.copies * r.size <= 2 * r.size
    want = brute.targets(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s, t in taken.items():
        assert abs(t - want[s]) <= largest[s] / 2 + 1e-6
    again = mixed(spark, rows[::-1]).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)
    assert mixed(spark, []).count() == 0


def test_mix_of_repeated_rows_and_weights(spark):
    rows = [(i // 2, "a" if i < 300 else "b", f"{'w ' * 10}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    copies = {}
    for r in mixing.mix(df).collect():
        copies.setdefault(r.doc_id, set()).add(r.copies)
    assert all(len(c) == 1 for c in copies.values())
    weighted = df.withColumn("quality", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    by = {r.even: r.c for r in mixing.mix(weighted, weight="quality").groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(F.avg("copies").alias("c")).collect()}
    assert by[True] > by[False]


def test_mix_of_rows_without_ids(spark):
    got = mixed(spark, [(None, "a", f"{'w ' * 9}{i}") for i in range(200)] + [(None, "b", "w " * 800)]).where("source = 'a'").collect()
    assert abs(sum(r.copies * r.size for r in got) - got[0].target) <= 5


def test_urls_that_a_header_cannot_hold(spark):
    urls = ["http://a.org/b%20c?q=é#f", "http://a.org/\r\nWARC-Type: x", " http://a.org/ ", "", "\u2028"]
    captures = warc.write_archives(pages(spark, [(i, u, str(i)) for i, u in enumerate(urls)]))
    assert {r.page_id: r.url for r in warc.lookup(warc.write_index(captures), captures).collect()} == dict(enumerate(urls))
    plain = warc.zlib.decompress(warc._record("response", 1, urls[0], None, "X", 1, b"x"), 47).decode()
    assert f"WARC-Target-URI: {urls[0]}\r\n" in plain and warc.EXACT not in plain
    record = warc._record("response", 1, urls[0], None, base64.b32encode(hashlib.sha1(b"x").digest()).decode(), 1, b"y")
    with pytest.raises(ValueError):
        warc._parse(record)


def test_pieces_equal_the_library(spark):
    sp = pytest.importorskip("sentencepiece")
    tok = pytest.importorskip("public_tokenizers")
    plain = sp.SentencePieceProcessor(model_file=tok.path("piece_bpe_32k.model"))
    model = sentencepiece_lattice.load_model()
    texts = ["The quick brown fox, unbelievably, jumped!", "", None, "é漢字🙂 ▁ x", "a" * 500 + "the" * 100, " \n\n  1234 ,,;;", "x  ", "zz" * 40 + "é" * 30, "repeated", "repeated", "\u0000\u0001", "word " * 3000 + "q" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"ids": F.lit("clash"), "word": F.lit("own")})
    for r in sentencepiece_lattice.decode(sentencepiece_lattice.encode(df, model), model).collect():
        want = None if texts[r.doc_id] is None else plain.encode(texts[r.doc_id])
        assert r.ids == want and r.word == "own"
        assert r.decoded == (None if want is None else plain.decode(want))
    assert sentencepiece_lattice.encode(df.limit(0), model).count() == 0


def test_viterbi_against_brute_force(spark):
    scores = {"a": -3.0, "b": -3.0, "ab": -2.5, "ba": -2.0, "aba": -4.4, "bab": -9.0, "▁": -1.0, "▁a": -1.2, "c": -5.0}
    table = {p: (i + 256, s) for i, (p, s) in enumerate(scores.items())}
    model = sentencepiece_lattice.Model(table, [bytes([i]) for i in range(256)] + [p.replace("▁", " ").encode() for p in scores], 0, True)
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abz", repeat=n)]

    def total(parts):
        return sum(scores.get(p, min(scores.values()) - 10 if len(p) == 1 else float("-inf")) for p in parts)

    def cuts(w):
        return [[w]] + [[w[:i], *rest] for i in range(1, len(w)) for rest in cuts(w[i:])]

    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    for r in sentencepiece_lattice.encode(df, model, round_trip=True).collect():
        best = max(total(c) for c in cuts("▁" + words[r.doc_id]))
        found = [model.strings[i].decode().replace(" ", "▁") for i in r.ids]
        assert total(found) == pytest.approx(best) and r.decoded == words[r.doc_id]
