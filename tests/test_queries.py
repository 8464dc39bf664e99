"""Every library query against its SQL, and the plans of those that must stay in the JVM."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.functions import columns as c
from docquarry.operators import graph, scan, versions
from docquarry.plans import catalog
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def oracle(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_same_rows_as_sql(name, spark, sf_dir, oracle):
    found = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    result = oracle.execute(catalog.SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    order = [names.index(x) for x in columns]
    want = [tuple(r[i] for i in order) for r in result.fetchall()]
    assert plain(found.select(*[F.col(f"`{x}`") for x in columns]).collect()) == plain(want)


@pytest.mark.parametrize("name", ["marker_scan", "is_javascript", "hash_content", "changelog_removed", "tree_children", "stats_rollup"])
def test_no_python_in_the_plan(name, spark, sf_dir):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    plan = catalog.QUERIES["tag_extract"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan


def test_number_and_byte_columns(spark):
    row = spark.range(1).select(
        c.bits_of(F.lit(5), 4).alias("bits"),
        F.hex(c.bytes_of_bits(F.lit("0100000101000010"))).alias("packed"),
        c.numbers_of_bytes(F.lit(b"\x12\x34"), 4).alias("numbers"),
        F.hex(c.hex_to_bytes(F.lit("abc"))).alias("left"),
        F.hex(c.hex_string_to_bytes(F.lit("ab c"))).alias("right"),
        F.hex(c.number_to_bytes(F.lit(258), 3)).alias("wide"),
        c.number_to_bytes(F.lit(258), 1).alias("narrow"),
        c.number_to_text(F.lit(42), 5).alias("text"),
        c.escape_regex(F.lit("a.b(c)")).alias("escaped"),
        c.references_in(F.lit("1 0 R and 22 0 R")).alias("refs"),
        c.sing_font(F.lit(b"x" * 236 + b"SING" + b"y" * 100)).alias("sing"),
    ).first()
    assert tuple(row) == ("0101", "4142", [1, 2, 3, 4], "0ABC", "ABC0", "000102", None, "00042", r"a\.b\(c\)", ["1 0 R", "22 0 R"], True)


def test_xor_search_finds_both_cases(spark):
    text = scan.xored(b"say Hello", b"\x63")
    df = spark.createDataFrame([(1, bytearray(text)), (2, None), (3, bytearray())], "id long, t binary")
    assert [tuple(r) for r in scan.xor_search(df, b"Hello", key="id", content="t").collect()] == [(1, 0x63, 4)]
    found = {r.xor_key for r in scan.xor_search(df, b"hello", key="id", content="t", ignore_case=True).collect()}
    assert 0x63 in found and len(scan.xored(b"abc", b"\x01\x02")) == 3


def test_cycles_end(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6), (6, 5)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "node long")
    reached = graph.reach(edges, roots)
    assert sorted((r.node, r.depth, r.parent) for r in reached.collect()) == [(1, 0, None), (2, 1, 1), (3, 2, 2)]
    assert sorted(r.node for r in graph.unreached(edges.select(F.col("src").alias("node")), reached).collect()) == [5, 6]


def test_gaps_over_blocks(spark):
    keys = [1, 2, 5, 65530, 65540, 200000]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert sorted(r.k for r in versions.gaps(df, "k").collect()) == [k for k in range(1, 200000) if k not in keys]


def test_reach_has_no_depth_limit(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(105)] + [(105, 3)], "src long, dst long")
    roots = spark.createDataFrame([(0,)], "node long")
    found = {r.node: (r.depth, r.parent) for r in graph.reach(edges, roots).collect()}
    assert found == {i: (i, i - 1 if i else None) for i in range(106)}
    with pytest.raises(ValueError, match="deeper"):
        graph.reach(edges, roots, max_depth=2)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=4), st.booleans())
def test_xor_places_are_those_of_every_key(data, pattern, ignore_case):
    low = bytes.lower if ignore_case else bytes
    want = {k: at for k in range(256) if data and (at := low(scan.xored(data, bytes([k]))).find(low(pattern))) >= 0}
    assert (scan._xor_finder(pattern, ignore_case)(data) if data else {}) == want


def test_long_chains_are_reached(spark):
    n = 120
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(None, 4), (4, None)], "src long, dst long")
    found = graph.reach(edges, spark.createDataFrame([(0,), (None,)], "node long"))
    assert {r.node: r.depth for r in found.collect()} == {i: i for i in range(n + 1)}


def test_calls_by_other_names():
    from docquarry.codecs import escapes

    script = "var a = eval; b = a; c = unrelated; eval(1); b('x'); a (2); xeval(3); o.eval(4); a = b;"
    assert sorted(escapes.calls_of(script, "eval")) == ["'x'", "1", "2"]


def test_next_in_order_over_blocks(spark):
    keys = [3, 9, 65530, 65540, 400000]
    found = versions.next_in_order(spark.createDataFrame([(k,) for k in keys + keys], "k long"), "k", "after")
    assert sorted((r.k, r.after) for r in found.collect()) == list(zip(keys, [*keys[1:], None]))


def test_deep_graphs_take_few_rounds(spark, monkeypatch):
    """A chain, with a tree and shortcuts hanging below it and a circle that nothing leads into, against a plain search."""
    from docquarry import scratch

    n, written = 700, []
    edges = [(i, i + 1) for i in range(n)] + [(n - i % 7, n + 1 + i) for i in range(40)] + [(300, 650), (40, 20), (680, 690), (681, 690)] + [(5000 + i, 5000 + (i + 1) % 5) for i in range(5)]
    want, frontier = {0: (0, None)}, [0]
    while frontier:
        new = {}
        for a, b in edges:
            if a in frontier and b not in want:
                new[b] = min(a, new.get(b, a))
        want |= {b: (want[a][0] + 1, a) for b, a in new.items()}
        frontier = list(new)
    keep = scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda *a, **b: written.append(1) or keep(*a, **b))
    found = graph.reach(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,)], "node long"))
    assert {r.node: (r.depth, r.parent) for r in found.collect()} == want
    assert len(written) < 60  # a table for each of some 400 steps before
