"""The five stages over a small corpus against a version in plain Python that compares everything with everything."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from docquarry.llm import toxicity
from docquarry.llm.tokens import Encoder, vocabulary_file
from pyspark.sql import functions as F
from test_models import brute_toxicity
from test_text_operators import kept_brute, lines_brute, targets_brute


def corpus(spark, folder):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(500)]
    block = "first shared line\nsecond shared line\nthird shared line"
    rows, labels = [], []
    for i in range(260):
        body = list(rng.choice(words, int(rng.integers(5, 90))))
        toxic = i % 5 == 0
        for w in ("moron", "scum", "vlaxo") if toxic else ():
            body[int(rng.integers(0, len(body)))] = w
        text = " ".join(body)
        if i % 7 == 1:
            text = f"{text}\n{block}\nlast {i}"
        if i % 11 == 2 and rows:
            text = rows[-1][1]  # a copy
        if i % 11 == 5 and rows and rows[-1][1]:
            text = rows[-1][1].replace(" w1", " w9", 1)  # nearly one
        rows.append((i, None if i == 77 else text, "en", ["a", "b", "c", None][min(3, int(rng.exponential(1)))], len(text)))
        labels.append((i, 1, int(toxic)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_run_against_brute_force(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = corpus(spark, folder)
    scored = brute_toxicity([(r[0], r[1]) for r in rows], [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()])
    assert all(abs(s - toxicity.THRESHOLD) > 0.01 for s, _ in scored)  # none is close to the threshold
    kept = [r for r, (s, _) in zip(rows, scored, strict=True) if s < toxicity.THRESHOLD]
    assert 0.7 * len(rows) < len(kept) < len(rows)
    clean = {kept[k][0]: t for k, (_, t) in lines_brute([(r[0], r[1]) for r in kept]).items()}
    stay = kept_brute([(r[0], clean[r[0]]) for r in kept])
    alive = [r for k, r in enumerate(kept) if k in stay]
    assert len(alive) < len(kept)
    names = sorted({r[3] for r in alive}, key=lambda s: (s is None, s or ""))
    size = lambda r: len((clean[r[0]] or "").split())
    of_source = [sum(size(r) for r in alive if r[3] == n) for n in names]
    rate = {n: min(3.0, t / s) if s else 0.0 for n, t, s in zip(names, targets_brute(of_source, [1 + k % 3 for k in range(len(names))]), of_source, strict=True)}
    copies = {}
    for r in alive:
        draw = int(hashlib.md5(f"7:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        copies[r[0]] = math.floor(rate[r[3]]) + (draw < rate[r[3]] - math.floor(rate[r[3]]))
    encode, want = Encoder(vocabulary_file("byte_bpe_50k.json")).encode, Counter()
    for i, n in copies.items():
        data = encode(clean[i])
        total = len(data) // 4
        cuts = [0, *range(total % 1024 or min(1024, total), total + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if n:
                want[(i, piece, a, b - a, zlib.crc32(data[4 * a : 4 * b]))] += n
    found = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 1024
    assert len(bins) <= 1.1 * sum(r.length for r in found) / 1024 + 1


NAMES = (
    "row score predicted evidence terms counts y h1 h2 segment part scored_text_ at h f l first lines removed removed_lines n_lines digest gone_id gone_digest starts starts_ gone_id_ "
    "f0 f1 node of least root key kind chunk kept_id kept_digest kept_id_ rate rate_ s_ t_ salt_ draw_ spread_ copies copies_ copy_ target source_size piece start length local rank before"
).split()


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Every name that a stage uses inside is a column of the caller's; ids repeat and are missing; so does text."""
    folder = f"file://{tmp_path}"
    rows = corpus(spark, folder)
    base = [(None if r[0] % 13 == 0 else r[0] % 120, r[1], r[2], r[3], r[4]) for r in rows] + [(None, None, None, None, None), (5, "", "en", None, 0), (6, "word " * 60_000, "en", "a", 300_000)]
    docs = spark.createDataFrame(base, "doc_id long, text string, lang string, source string, n_chars long")
    for name in NAMES:
        docs = docs.withColumn(name, F.lit("mine"))
    docs = docs.withColumn("a.b", F.lit("mine")).repartition(3)
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder)
        assert after.columns == columns, name
        path = f"{folder}/{name.replace(' ', '-')}"
        after.write.parquet(path)
        before = spark.read.parquet(path)
        found = before.collect()
        assert found and all(r["row"] == r["a.b"] == r["evidence"] == r["root"] == "mine" for r in found)
        if name != "mixing":  # nothing is there that was not, and texts without copies stay
            assert len(found) <= len(base)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, folder)
    assert packed.count() >= 1


def test_stages_of_an_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}"
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
