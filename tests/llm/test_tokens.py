"""Token ids against the library, packing against its bounds, files against what went in, and the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from docquarry import scratch
from docquarry.llm import packing, token_files, toxicity
from docquarry.llm.tokens import Encoder, vocabulary_file

BYTES, WORDS = vocabulary_file("byte_bpe_50k.json"), vocabulary_file("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PIECES = [" ", "  ", "\n", "\t", "a", "b", "'s", "'", "1", "é", "é", "!", "?!", " ", "\x1c", "\x85", "ab", "The", "  \n", "İ", "Σ", "ſ", "ß", "​", "漢", "🙂", "<|endoftext|>", "\x0b", "\r\n", "½", "_", "ǅ", "'LL", "word,", "end."]


@pytest.fixture(scope="module", params=[BYTES, WORDS])
def encoder(request):
    return Encoder(request.param)


def test_ids_are_the_library_s(encoder):
    rng = random.Random(2)
    for _ in range(6000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == [*encoder.ids(text), 2], repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(encoder, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == [*encoder.ids(text), 2]


def test_ids_of_documents(encoder, spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect():
        assert np.frombuffer(encoder.encode(r.text), "<u4").tolist() == [*encoder.ids(r.text), 2]


# ---- packing


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 1024), st.integers(1, 400), max_size=40))
def test_plans_hold_every_piece_once(counts):
    shapes = packing.plan(counts)
    used = defaultdict(int)
    for bins, shape in shapes:
        assert bins > 0 and sum(n * k for n, k in shape) <= 1024
        assert sum(k for n, k in shape if 3 * n > 1024) <= 2
        for n, k in shape:
            used[n] += bins * k
    assert used == counts
    total, bins = sum(n * c for n, c in counts.items()), sum(b for b, _ in shapes)
    assert bins <= 1.6 * max(total / 1024, sum(c for n, c in counts.items() if 2 * n > 1024)) + 2


def test_plan_of_mixed_lengths_is_tight():
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(np.concatenate((rng.integers(1, 1024, 5000), rng.integers(1, 200, 5000))), return_counts=True)
    shapes = packing.plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)))
    assert sum(b for b, _ in shapes) <= 1.02 * (lengths * counts).sum() / 1024


def test_pack(spark):
    texts = ["some words here"] * 40 + ["long text of words " * n for n in (100, 400, 900)] + [None, "", "x" * 30_000, "<|endoftext|> a"]
    docs = spark.createDataFrame([(i if i % 9 else 9, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA).withColumn("length", F.lit("x")).withColumn("part", F.lit(1)).repartition(3)
    rows = packing.pack(docs, BYTES, keep_ids=True).collect()
    encode = Encoder(BYTES).encode
    want = sorted((r.doc_id, encode(r.text)) for r in docs.collect())
    of_doc, of_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids) and r.length <= 1024
        of_doc[r.doc_id].append(r)
        of_bin[r.sequence_id].append((r.offset, r.length))
    for places in of_bin.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 1024
    for doc_id, pieces in of_doc.items():
        texts_of = sorted(t for i, t in want if i == doc_id)
        if len(texts_of) == 1:
            pieces.sort(key=lambda r: r.piece)
            assert b"".join(bytes(r.ids) for r in pieces) == texts_of[0]
            assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces[:-1]]]).tolist()
            assert all(r.length == 1024 for r in pieces[1:])
    assert sum(r.length for r in rows) == sum(len(t) // 4 for _, t in want)
    assert packing.pack(docs.where("false"), BYTES).count() == 0


# ---- files


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=80), st.data())
def test_bits_come_back(bits, ids, data):
    values = np.array([i % (1 << bits) for i in ids], np.uint32)
    packed = token_files.pack_bits(values, bits)
    assert len(packed) == (len(ids) * bits + 7) // 8
    start = data.draw(st.integers(0, len(ids)))
    assert token_files.unpack_bits(packed, bits, start, len(ids) - start).tolist() == values[start:].tolist()


def test_blocks_read_alone_and_in_place():
    docs = [np.array(x, np.uint32) for x in ([1, 2, 3], [], [70000 % (1 << 17)], list(range(50)))]
    one, two = token_files.write_block(3, 7, [10, None, 11, 12], docs, 17), token_files.write_block(3, 8, [13], docs[:1], 17)
    entries = [(0, 3, 7, 4, 54), (len(one) + 1, 3, 8, 1, 3)]
    data = one + b"\n" + two + b"\n" + token_files.write_index(entries) + b"\n"
    assert token_files.read_index(data) == token_files.read_index(data[-100:]) == entries
    assert token_files.Block(data, entries[1][0]).document(0).tolist() == [1, 2, 3]
    first, second = token_files.blocks(data)
    assert [first.document(i).tolist() for i in range(4)] == [d.tolist() for d in docs] and second.document(0).tolist() == [1, 2, 3]
    assert (first.bucket, first.number, first.no_id.tolist(), second.number) == (3, 7, [False, True, False, False], 8)
    assert token_files.bits_for(49408) == 16 and token_files.bits_for(50257) == 16 and token_files.bits_for(2) == 1


def test_files_of_a_table(spark, monkeypatch):
    """Small ranges, blocks and files; a third of the rows share an id, others have none."""
    monkeypatch.setattr(token_files, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(token_files, "RECORDS", 3)
    texts = [f"words of document {i} " * (i % 37) for i in range(400)] + [None, "", "<|endoftext|>", "very long " * 5_000]
    ids = [None if i % 3 == 1 else 500 if i % 3 == 0 else 1000 - i if i < 398 else 7 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in zip(ids, texts, strict=True)], SCHEMA)
    for name in ("bucket", "n", "spread", "ids", "block", "start"):
        docs = docs.withColumn(name, F.lit("x"))
    docs = docs.repartition(5)
    to = scratch.new_path(spark, "files")
    token_files.write_tokens(docs, WORDS, to)
    rows = token_files.read_digests(spark, to).collect()
    encode = Encoder(WORDS).encode
    hashed = lambda t: 42 if t is None else (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    want = sorted((r.doc_id is None, r.doc_id or 0, hashed(r.text), len(d := encode(r.text)) // 4, d) for r in docs.collect())
    rows.sort(key=lambda r: r.start)
    assert [(r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows] == [(a, b, c, zlib.crc32(d)) for a, b, _, c, d in want]
    assert [r.start for r in rows] == np.cumsum([0, *[c for _, _, _, c, _ in want[:-1]]]).tolist()
    # the id of a third of the rows, and null ids, are in several files; any block is reached by a file's index
    files = [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(to).where("length > 0").collect()]
    held = [{(int(i), bool(z)) for b in token_files.blocks(f) for i, z in zip(b.doc_ids, b.no_id, strict=True)} for f in files]
    assert sum((500, False) in h for h in held) > 1 and sum(any(z for _, z in h) for h in held) > 1
    assert all(len(token_files.read_index(f)) <= 2 for f in files) and sum(n for f in files for *_, n, _ in token_files.read_index(f)) == len(rows)
    empty = scratch.new_path(spark, "files")
    token_files.write_tokens(docs.where("false"), WORDS, empty)
    assert token_files.read_digests(spark, empty).count() == 0


# ---- pipeline


def test_stages_take_effect(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "mixing", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.keep(stage(spark, before, sf_dir), "test-stage")
        if name != "packing":
            assert after.columns == docs.columns
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity.classify(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
            assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, p in scores.items() if not p)
        elif name == "line dedup":
            assert after.count() == before.count()
        elif name == "simhash near-dedup":
            assert 0 < after.count() < before.count() and after.count() == after.select("doc_id").distinct().count()
            assert not [r for r in after.groupBy("text").count().where("count > 1").collect()]
        elif name == "mixing":
            assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        else:
            sizes = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
            assert all(r.n == r.end <= 1024 for r in sizes)
        before = after
