"""Quality, toxicity, embeddings and language model against brute force or held-out labels."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import catalog, hnsw, lm, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, None, None, None) for i, t in enumerate(texts)], DOCS)


# ---- quality


def accuracy(rows, labels, held_out):
    pairs = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out is held_out and r.doc_id in labels]
    good = [p for p, y in pairs if y == 1]
    bad = [1 - p for p, y in pairs if y == 0]
    return sum(good) / len(good), sum(bad) / len(bad)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = catalog.op2_quality(spark, d).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    for held_out in (False, True):
        assert min(accuracy(rows, labels, held_out)) > 0.9


def test_quality_of_odd_rows(spark):
    texts = [None, "", " \n", "x", "A" * 100_000, "é " * 50_000, *[f"the fine text {i} is of words." for i in range(40)], *["junk!! " * (5 + i) for i in range(40)]]
    docs = frame(spark, texts).withColumn("x", F.lit("clash")).withColumn("y", F.lit(3))
    labels = spark.createDataFrame([(i, int(i < 46)) for i in range(6, 86)] + [(None, 1), (7, None), (8, 1)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {0.5}
    assert quality.classify(docs.where("false"), labels).count() == 0


def test_discriminant_is_the_gaussian_difference():
    rng = np.random.default_rng(0)
    p = len(quality.FEATURES)
    x = [rng.normal(size=(4000, p)) @ rng.normal(size=(p, p)) + k for k in (0, 1)]
    counts, means, cov = np.array([4000.0, 4000.0]), np.stack([a.mean(0) for a in x]), np.stack([np.cov(a.T, bias=True) for a in x])
    floor = 1e-6 * np.eye(p)
    model = quality.Discriminant(counts, means, cov, pooled=0.0, identity=0.0)
    weight = p / (p + 4000)
    cov = cov + floor
    both = cov.mean(0)
    probe = rng.normal(size=(20, p))

    def density(k):
        c = (1 - weight) * cov[k] + weight * both
        d = probe - means[k]
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1]

    assert model.difference(probe) == pytest.approx(density(1) - density(0), rel=1e-6)


def plain_statistics(text):
    """The 17 statistics of a text, character by character over its UTF-8 bytes."""
    data = [chr(b) for b in (text or "").encode()]
    words = re.findall(r"[^ \t-\r]+", "".join(data))
    if not words:
        return [0.0] * 17
    share = lambda part, whole: math.log((min(1, part / whole if whole else 0) + 0.002) / (1.002 - min(1, part / whole if whole else 0)))
    n, size, counts = len(words), len(data), Counter(words)
    lines = [x for x in "".join(data).split("\n") if re.search(r"[^ \t-\r]", x)]
    signs = "#*%$&@^~=+_<>{}[]\\/|!?"
    among = lambda letters: sum(c in letters for c in data)
    return [
        math.log(1 + n), math.log(sum(map(len, words)) / n), share(sum(len(w) > 16 for w in words), n), math.log(len(counts)) / math.log(n + 1),
        share(max(counts.values()), n + 10), share(sum(x == y for x, y in zip(words, words[1:])), n),
        share(sum("A" <= c <= "Z" for c in data), sum("A" <= c <= "Z" or "a" <= c <= "z" for c in data) + 10),
        share(sum("0" <= c <= "9" for c in data), size), share(among(signs), size), share(among(".,;:"), size), share(sum(c >= "\x80" for c in data), size),
        share(sum(w[-1] in signs for w in words), n), math.log(n / len(lines)), share(len(lines) - len(set(lines)), len(lines) + 2),
        share(sum(x.rstrip(" \t\n\v\f\r")[-1:] in tuple(".!?") for x in lines), len(lines)),
        math.log((len(zlib.compress("".join(data).encode("latin-1"), 1)) + 8) / (size + 64)), share(len(counts), n + 10),
    ]


def test_quality_against_brute_force(spark):
    """The whole result from plain statistics, covariances, densities and a step-by-step calibration."""
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words, int(rng.integers(5, 80)))) + ("." if i % 2 else "\nand\nand") for i in range(150)]
    texts += [" ".join(rng.choice(["JUNK!!", "x#1", "buy", "buy", *words[:20]], int(rng.integers(3, 60)))) for _ in range(120)]
    texts += [None, "", " \n ", "Ünï çödé " * 300, "lone"]
    labels = {i: int(i < 150) if i % 17 else int(i >= 150) for i in range(270)}
    found = {r.doc_id: r for r in quality.classify(frame(spark, texts).repartition(3), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    x = np.array([plain_statistics(t) for t in texts])
    train = np.array([i for i in labels if zlib.crc32(str(i).encode()) % 5])
    y = np.array([labels[i] for i in train])
    p, n = x.shape[1], np.array([(y == k).sum() for k in (0, 1)])
    own = [np.cov(x[train[y == k]].T, bias=True) + 1e-6 * np.eye(p) for k in (0, 1)]
    both = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    scale = np.sqrt(np.diag(both)) + 1e-3
    density = []
    for k in (0, 1):
        lean = max(quality.POOLED, min(0.9, p / (p + n[k])))
        c = ((1 - lean) * own[k] + lean * both) / np.outer(scale, scale)
        c = (1 - quality.IDENTITY) * c + quality.IDENTITY * np.trace(c) / p * np.eye(p)
        d = (x - x[train[y == k]].mean(axis=0)) / scale
        density.append(math.log(n[k] / n.sum()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    z = density[1] - density[0]
    zt = np.clip(z[train], -60, 60)
    loss = lambda b: np.logaddexp(0, zt * b[0] + b[1]).sum() - (y * (zt * b[0] + b[1])).sum() + 0.005 * ((b[0] - 0.3) ** 2 + b[1] ** 2)
    b, size = np.array([0.3, 0.0]), 0.5
    while size > 1e-7:
        steps = [b + size * np.array(d) for d in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1))]
        best = min(steps, key=loss)
        b, size = (best, size) if loss(best) < loss(b) else (b, size / 2)
    for i in range(len(texts)):
        assert found[i].score == pytest.approx(1 / (1 + math.exp(-np.clip(b[0] * z[i] + b[1], -40, 40))), abs=1e-4), i
        assert found[i].predicted == int(found[i].score >= 0.3)


# ---- toxicity


def term_counts(text):
    """Words and six-byte beginnings of a text, by plain code."""
    signs = bytes(c for c in range(128) if not chr(c).isalnum())
    words = Counter(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).translate(bytes(32 if c in signs else c for c in range(256))).split())
    return words + Counter(b"^" + w[:6] for w in words if len(w) > 6)


def brute_toxicity(rows, labels):
    """(score, neighbours) of each text: every count, weight and cosine taken anew, every example compared."""
    known = {}
    for i, y in labels:
        if i is not None and y is not None:
            known[i] = max(y, known.get(i, 0))
    train, seen = [], set()
    for i, t in sorted((r for r in rows if r[0] in known and zlib.crc32(str(r[0]).encode()) % 4 != 2), key=lambda r: r[0]):
        if (known[i], t) not in seen:
            seen.add((known[i], t))
            train.append((i, t, known[i]))
    terms = {k: term_counts(t) for k, (_, t) in enumerate(rows)}
    df = Counter(x for c in terms.values() for x in c)
    of_label = [Counter(x for _, t, y in train if y == label for x in term_counts(t)) for label in (0, 1)]
    n = [sum(y == label for *_, y in train) for label in (0, 1)]
    vocabulary = {x for _, t, _ in train for x in term_counts(t)}
    weight = {x: (math.log((1 + len(rows)) / (1 + df[x])) + 1e-6) * (toxicity.FLOOR + (1 - toxicity.FLOOR) * float(toxicity.association(of_label[1][x], of_label[0][x], n[1], n[0]))) for x in vocabulary}

    def unit(counts):
        w = {x: (1 + math.log(c)) * weight[x] for x, c in counts.items() if x in weight}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / norm for x, v in w.items()} if norm else {}

    examples = [(i, y, unit(term_counts(t))) for i, t, y in train]
    prior = n[1] / sum(n)

    def vote(counts, skip=None):
        q = unit(counts)
        near = sorted(((-sum(v * e[x] for x, v in q.items() if x in e), i, y) for i, y, e in examples if i != skip))
        near = [(i, y, -s) for s, i, y in near if s < 0][: toxicity.NEIGHBOURS]
        votes = [sum(1 / (1 - min(s, 1) + toxicity.SOFTEN) for _, y, s in near if y == label) for label in (0, 1)]
        return math.log((votes[1] + toxicity.PRIOR * prior) / (votes[0] + toxicity.PRIOR * (1 - prior))), [(i, s) for i, _, s in near]

    odds = np.array([vote(term_counts(t), i)[0] for i, t, _ in train])
    y = np.array([y for *_, y in train])
    loss = lambda b: (np.logaddexp(0, odds * b[0] + b[1]) - y * (odds * b[0] + b[1])).sum() + 0.05 * ((b[0] - 1) ** 2 + b[1] ** 2)
    b = np.array([1.0, 0.0])
    for size in (1.0, 0.1, 0.01, 0.001, 0.0001):  # a search by steps: the loss is convex
        moved = True
        while moved:
            moved = False
            for step in ((size, 0), (-size, 0), (0, size), (0, -size), (size, size), (-size, -size), (size, -size), (-size, size)):
                if loss(b + step) < loss(b) - 1e-12:
                    b, moved = b + step, True
    return [(1 / (1 + math.exp(-(b[0] * o + b[1]))), near) for o, near in (vote(terms[k]) for k in range(len(rows)))]


def test_block_max_search_is_exact():
    rng = np.random.default_rng(5)
    pick = lambda: (ids := np.unique(np.minimum(rng.exponential(9, rng.integers(0, 12)), 59).astype(int)), rng.integers(1, 5, len(ids)))
    vectors = [pick() for _ in range(700)]
    vectors += vectors[:30]  # ties
    weight = rng.random(60) + 0.1
    for common in (0.0, 0.05, 1.0):
        index = toxicity.BlockMaxIndex(vectors, weight, block=16, common=common)
        full = np.zeros((len(vectors), 60))
        for i, (t, c) in enumerate(vectors):
            full[i, t] = index.weigh(t, c)
        queries = [pick() for _ in range(60)]
        skip = rng.integers(0, 700, 60).tolist()
        for without in (None, skip):
            for k, (q, (who, got)) in enumerate(zip(queries, index.nearest(queries, 10, without), strict=True)):
                vector = np.zeros(60)
                vector[q[0]] = index.weigh(*q)
                cosine = full @ vector
                if without:
                    cosine[without[k]] = 0
                want = np.sort(cosine[cosine > 1e-9])[::-1][:10]
                assert got == pytest.approx(want, abs=1e-5) and cosine[who] == pytest.approx(got, abs=1e-5)
    assert toxicity.BlockMaxIndex([], weight).nearest([pick()], 3)[0][0].size == 0


def toxic_corpus():
    rng = np.random.default_rng(6)
    common, bad = [f"word{i}" for i in range(300)], ["moron", "scum", *[f"vlaxor{e}" for e in ("a", "o", "en", "ig", "er", "um")]]
    texts, toxic = [], []
    for i in range(600):
        words = list(rng.choice(common, 60))
        y = int(i % 6 == 0)
        for w in rng.choice(bad, 3 * y):
            words[rng.integers(0, 60)] = w
        texts.append(" ".join(words))
        toxic.append(y)
    return [*texts, None, "", "vlaxorum moron SCUM!", texts[0], "moron " * 60_000], toxic


def test_toxicity_against_brute_force(spark):
    texts, toxic = toxic_corpus()
    docs = frame(spark, texts).withColumn("score", F.lit("clash")).withColumn("h1", F.lit(1)).withColumn("terms", F.lit(2)).withColumn("row", F.lit(3)).repartition(3)
    labels = [(i, y) for i, y in enumerate(toxic)] + [(None, 1), (3, None), (6, 0)]
    rows = {r.doc_id: r for r in toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(rows) == len(texts)
    held_out = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i].held_out for i in held_out)
    for i, (score, near) in enumerate(brute_toxicity(list(enumerate(texts)), labels)):
        assert rows[i].score == pytest.approx(score, abs=5e-3), i
        said = [x.split(":") for x in rows[i].evidence.split()]
        assert [float(c) for _, c in said] == pytest.approx([c for _, c in near], abs=2e-4)
        if near:  # all that are surely among the nearest
            assert {int(x) for x, _ in said} >= {x for x, c in near if c > near[-1][1] + 1e-4}
    assert np.mean([rows[i].predicted for i in held_out if toxic[i]]) > 0.9
    assert np.mean([rows[i].predicted for i in held_out if not toxic[i]]) < 0.03
    assert rows[602].predicted == rows[604].predicted == 1 and rows[600].predicted == rows[601].predicted == 0 and not rows[601].evidence


def test_toxicity_without_labels_or_rows(spark):
    texts, toxic = toxic_corpus()
    docs = frame(spark, texts[:200], [*range(190), *[None] * 5, *[7] * 5])
    labels = spark.createDataFrame(list(enumerate(toxic[:200])), "doc_id long, toxic int")
    assert toxicity.classify(docs, labels).count() == 200
    assert {r.score for r in toxicity.classify(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.classify(docs.where("false"), labels).count() == 0


def test_toxicity_on_supplied_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in catalog.op3_toxicity(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    clean = [r.predicted for i, r in rows.items() if r.held_out and labels.get(i) == 0]
    assert sum(clean) <= 0.05 * len(clean) and sum(not r.evidence for r in rows.values()) <= 0.02 * len(rows)


# ---- embeddings


def clustered(rng, n, d=24):
    centers = rng.normal(size=(n // 8, d))
    return centers[rng.integers(0, len(centers), n)] + rng.normal(size=(n, d)) * rng.choice([0.0, 0.02, 0.05, 0.3], n)[:, None]


def test_graph_search_recall():
    rng = np.random.default_rng(7)
    x = clustered(rng, 3000)
    x = np.unique(x / np.linalg.norm(x, axis=1, keepdims=True), axis=0)
    found, truth = hnsw.close_to(hnsw.Graph(x), x), x @ x.T >= 0.98
    assert not (found & ~truth).any() and (found & truth).sum() >= 0.95 * truth.sum()


def brute_links(rows, cosine=0.98):
    usable = []
    for i, v, label in rows:
        ok = i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)
        usable.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    near = [[j for j in range(len(rows)) if j != i and usable[i] is not None and usable[j] is not None and rows[i][2] == rows[j][2] and len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= cosine] for i in range(len(rows))]
    component = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            best = min([component[i], *(component[j] for j in js)])
            if best != component[i]:
                component[i], changed = best, True
            for j in js:
                if component[j] != best:
                    component[j], changed = best, True
    return near, component


@pytest.mark.parametrize("shard_rows", [8192, 40])
def test_embedding_dedup(spark, shard_rows):
    rng = np.random.default_rng(8)
    vectors = [list(map(float, v)) for v in clustered(rng, 240, 12)]
    rows = [(i, v, int(i % 2)) for i, v in enumerate(vectors)]
    rows += [(240 + i, vectors[4], 0) for i in range(30)]  # copies
    odd = [None, [], [0.0] * 12, [None, 1.0], [math.nan] * 12, [math.inf] + [0.0] * 11, vectors[4][:6]]
    rows += [(300 + i, v, 0) for i, v in enumerate(odd)] + [(400, vectors[0], None), (401, [x * 3 for x in vectors[4]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("shard", F.lit(1)).withColumn("v", F.lit(2)).repartition(3)
    found = {r.vec_id: r for r in hnsw.embedding_dedup(df, shard_rows=shard_rows).collect()}
    near, component = brute_links(rows)
    got = sum(found[r[0]].n_links for r in rows)
    want = sum(map(len, near))
    assert len(found) == len(rows) and 0.97 * want <= got <= want
    same = sum(found[r[0]].component_id == rows[component[k]][0] for k, r in enumerate(rows))
    assert same >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())
    assert hnsw.embedding_dedup(df.where("false")).count() == 0


def test_recall_over_full_shards(spark):
    """Several shards of thousands, whose graphs are searched: links and components against all comparisons."""
    rng = np.random.default_rng(10)
    x = clustered(rng, 5000, 24).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, list(map(float, v)), 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    for name in ("tile", "i", "j", "weights", "shards", "class_id", "usable"):
        df = df.withColumn(name, F.lit("mine"))
    found = {r.vec_id: r for r in hnsw.embedding_dedup(df, shard_rows=1700).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.98
    np.fill_diagonal(close, False)
    want = close.sum(axis=1)
    got = np.array([found[i].n_links for i in range(len(x))])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
    component = np.arange(len(x))
    while True:
        least = np.minimum(component, np.where(close, component[None, :], len(x)).min(axis=1))
        if (least == component).all():
            break
        component = least
    assert np.mean(np.array([found[i].component_id for i in range(len(x))]) == component) >= 0.99


def test_audit_is_never_empty():
    """Queries without any true pair: the audit still has nodes of the graph to find."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    beside = hnsw._beside(x, 0.98)
    assert len(beside) == hnsw.AUDIT and ((beside @ x.T >= 0.98).sum(axis=1) >= 1).all() and np.allclose(np.linalg.norm(beside, axis=1), 1)
    assert not hnsw.close_to(hnsw.Graph(x), -x[:50]).any()


# ---- language model


def brute_ppm(counts, code_bytes):
    """log10 probability of the last byte after those before it, with exclusion, by walking contexts."""
    out, excluded = 0.0, set()
    for order in range(lm.ORDER, -1, -1):
        context = code_bytes[lm.ORDER - order : lm.ORDER]
        following = {s: n for s, n in counts.get((order, context), {}).items() if s not in excluded}
        if not following:
            continue
        whole = sum(following.values()) + len(following)
        if code_bytes[-1] in following:
            return out + math.log10(following[code_bytes[-1]] / whole)
        out += math.log10(len(following) / whole)
        excluded |= set(following)
    return out - math.log10(256 - len(excluded))


def test_scores_against_brute_force(spark):
    rng = np.random.default_rng(9)
    words = ["the", "of", "Thing", "é", "zq", "running", "runner", "a"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(60)] + [None, "", "unseen kxq", "The\tof\n the"]
    ids = [*range(62), 100, 101]
    docs = frame(spark, texts, ids).withColumn("chunk", F.lit(1)).withColumn("n", F.lit(2)).repartition(3)
    found = {r.doc_id: r for r in lm.score(docs).collect()}
    held_out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in ids}
    tokens = {i: [*lm.normal((t or "").encode()).split(), b"\n"] for i, t in zip(ids, texts, strict=True)}
    unigram = Counter(w for i in ids if not held_out[i] for w in tokens[i])
    n, v = sum(unigram.values()), len(unigram)
    counts: dict = {}
    for i, t in zip(ids, texts, strict=True):
        if not held_out[i]:
            b = bytes([9]) * lm.ORDER + lm.normal((t or "").encode()) + b"\n"
            for at in range(lm.ORDER, len(b)):
                for order in range(lm.ORDER + 1):
                    slot = counts.setdefault((order, b[at - order : at]), {})
                    slot[b[at]] = slot.get(b[at], 0) + 1
    assert len(found) == len(ids)
    for i, t in zip(ids, texts, strict=True):
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out[i], len(tokens[i]), sum(unigram[w] > 0 for w in tokens[i]), n)
        assert r.base_score == pytest.approx(sum(math.log10((unigram[w] + 1) / (n + v + 1)) for w in tokens[i]))
        b = bytes([9]) * lm.ORDER + lm.normal((t or "").encode()) + b"\n"
        assert r.score == pytest.approx(sum(brute_ppm(counts, b[k - lm.ORDER : k + 1]) for k in range(lm.ORDER, len(b))))


def test_probabilities_sum_to_one():
    text = lm.normal(b"the thing that thinks then sings, a theme") * 3
    values, counts = lm.counted(lm.codes(lm.joined([text]))[0])
    trie = lm.Trie(values, counts)
    for context in (b"e the", b"zzzzz", b"\t\t\t\tt", b"hing "):
        base = int.from_bytes(context, "big") << 8
        assert (10 ** trie.log10(np.array([base + s for s in range(256)], np.uint64))).sum() == pytest.approx(1.0)


def test_size_of_parts_changes_no_score(spark):
    """With 40 nodes a part, rare contexts count as they do in one."""
    rng = np.random.default_rng(2)
    docs = frame(spark, [" ".join("".join(rng.choice(list("abcdefé"), 6)) for _ in range(20)) for _ in range(60)])
    small, large = ({r.doc_id: r.score for r in lm.score(docs, nodes=n).collect()} for n in (40, 10**9))
    assert small == pytest.approx(large)


def test_small_tries_still_score(spark):
    docs = frame(spark, [f"some words {i} and others" for i in range(50)] + ["x" * 100_000])
    rows = lm.score(docs, nodes=40).collect()
    assert len(rows) == 51 and all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert lm.score(docs.where("false")).count() == 0
