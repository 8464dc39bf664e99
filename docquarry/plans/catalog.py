"""The library's queries over the supplied tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import rules
from docquarry.codecs import escapes, filters
from docquarry.functions import columns as c
from docquarry.operators import analysis, graph, scan, stats, versions
from docquarry.session import spread, table
from docquarry.sources import pdf
from docquarry.streaming import dropfolder

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Rules that the pages can match, beside the built-in ones.
PAGE_RULES = (("element", "<script", True), ("element", "href", True), ("element", "onclick", True), ("event", "</p>", False), ("action", "track", True), ("js_vuln", "mailto", False))


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""
    def take(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return take


def _quoted(text: str) -> str:
    parts, run = [], ""
    for ch in text:
        if ch < " ":
            parts += [f"'{run}'", f"chr({ord(ch)})"]
            run = ""
        else:
            run += "''" if ch == "'" else ch
    parts.append(f"'{run}'")
    return " || ".join(p for p in parts if p != "''") or "''"


def _rule_values(rows) -> str:
    return ", ".join(f"({_quoted(k)}, {_quoted(t)}, {'true' if b else 'false'})" for k, t, b in rows)


_ALL_RULES = [(k, t, b) for k, t, b, _, _ in rules.rule_rows()] + list(PAGE_RULES)
_NO_NUL = rules.BOUNDARY.replace("\x00", "")
_HIT = f"""
    WITH r(category, tok, bounded) AS (VALUES {_rule_values(_ALL_RULES)}),
    hit AS (
      SELECT page_id, html, category, trim(tok) AS token, tok, bounded, instr(html, tok) AS p FROM pages, r WHERE instr(html, tok) > 0
    ), ok AS (
      SELECT page_id, category, token FROM hit
      WHERE NOT bounded OR substr(html, p + length(tok), 1) = '' OR instr({_quoted(_NO_NUL)}, substr(html, p + length(tok), 1)) > 0
    )"""


def _page_hits(spark: SparkSession, d: str) -> DataFrame:
    return scan.marker_scan(table(spark, d, "pages").select("page_id", "html"), _ALL_RULES, content="html").select("page_id", "category", "token")


@query(_HIT + " SELECT category, token, count(*) AS n, min(page_id) AS first_key, max(page_id) AS last_key, CAST(sum(page_id) AS BIGINT) AS key_sum FROM ok GROUP BY ALL")
def marker_scan(spark, d):
    """All rules over every page in one pass."""
    return scan.marker_summary(_page_hits(spark, d), key="page_id")


@query(_HIT + " SELECT page_id, category, token FROM ok WHERE token IN ('<script', 'href', 'track')")
def marker_scan_bounded(spark, d):
    """Bounded hits, a row each."""
    return _page_hits(spark, d).where(F.col("token").isin("<script", "href", "track"))


@query(_HIT + f""", t(category, token, title, cves) AS (VALUES {', '.join(f"({_quoted(k)}, {_quoted(t.strip())}, {'NULL' if n is None else _quoted(n)}, {'NULL' if v is None else _quoted(v)})" for k, t, _, n, v in rules.rule_rows())})
    SELECT page_id, category, token, title, cves FROM ok LEFT JOIN t USING (category, token)""")
def rule_lookup(spark, d):
    """Titles and CVE numbers of what was found."""
    return scan.with_titles(_page_hits(spark, d), rules.rules(spark)).select("page_id", "category", "token", "title", "cves")


@query(_HIT + " SELECT page_id, count(*) AS suspicious FROM ok GROUP BY page_id")
def total_suspicious(spark, d):
    """Hits per page."""
    return _page_hits(spark, d).groupBy("page_id").agg(F.count(F.lit(1)).alias("suspicious"))


@query("SELECT doc_id, md5(encode(text)) AS md5, sha1(encode(text)) AS sha1, sha256(encode(text)) AS sha256 FROM documents")
def hash_content(spark, d):
    """F14."""
    return table(spark, d, "documents").select("doc_id", *c.digests(F.col("text").cast("binary")))


@query("SELECT doc_id, source FROM documents WHERE regexp_matches(text, 'the[a-z]*ing', 'i')")
def search_ci(spark, d):
    """Regular expression, case ignored."""
    return scan.search(table(spark, d, "documents"), "the[a-z]*ing", ["text"], regex=True, ignore_case=True).select("doc_id", "source")


@query("SELECT source, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents WHERE contains(text, 'the') GROUP BY source")
def search_literal(spark, d):
    """P10: ids that hold a literal, one list per group."""
    found = scan.search(table(spark, d, "documents"), "the", ["text"])
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("ids"))


@query("SELECT page_id FROM pages WHERE contains(html, '<p>')")
def search_hex(spark, d):
    """The search command with hexadecimal input."""
    return scan.search_hex(table(spark, d, "pages"), "\\x3c\\x70\\x3e", content="html").select("page_id")


@query("SELECT doc_id, CAST(length(regexp_replace(text, '[\\x20-\\x7e]', '', 'g')) AS BIGINT) AS n FROM documents")
def nonprintable_count(spark, d):
    """F1."""
    return table(spark, d, "documents").select("doc_id", c.nonprintable_count(F.col("text")).alias("n"))


def _counts_sql(text: str, s: str) -> str:
    return f"((length({text}) - length(replace({text}, {_quoted(s)}, ''))) // {len(s)})"


@query("SELECT page_id, CAST(" + " + ".join(_counts_sql("html", s) for s in c.SCRIPT_STRINGS) + " AS BIGINT) AS score FROM pages")
def js_token_score(spark, d):
    """all occurrences of script strings."""
    return table(spark, d, "pages").select("page_id", c.script_score(F.col("html")).alias("score"))


def _js_sql() -> str:
    n = [_counts_sql("t", s) for s in c.SCRIPT_STRINGS]
    keys = " AND ".join(f"contains(t, {_quoted(k)})" for k in c.SCRIPT_KEYS)
    words = " OR ".join(f"contains(t, {_quoted(s)})" for s in c.SCRIPT_STRINGS if any(x.isalnum() for x in s))
    kinds = " + ".join(f"CAST(contains(t, {_quoted(s)}) AS INT)" for s in c.SCRIPT_STRINGS)
    return f"""
      WITH b AS (
        SELECT 'page' AS kind, page_id AS id, unnest(regexp_extract_all(html, '(?is)<script[^>]*?>(.*?)</script>', 1)) AS t FROM pages
        UNION ALL SELECT 'document', doc_id, text FROM documents
      ), s AS (
        SELECT kind, id, t, {' + '.join(n)} AS total, {kinds} AS kinds FROM b
      ), v AS (
        SELECT kind, id, (NOT regexp_matches(t, '[^\\x00\\x09\\x0a\\x0c\\x0d\\x20-\\x7e]')) AND {keys} AND ({words})
          AND ((total > {c.MANY_STRINGS} AND kinds >= {c.DISTINCT_STRINGS}) OR (length(t) > 0 AND length(t) < {c.SHORT_SCRIPT} AND total * 100.0 > length(t) * {c.DENSE_PERCENT}.0)) AS js FROM s
      )
      SELECT kind, id, count(*) AS bodies, CAST(sum(CAST(js AS INT)) AS BIGINT) AS scripts FROM v GROUP BY ALL"""


@query(_js_sql())
def is_javascript(spark, d):
    """F20 over script bodies of pages, and over documents."""
    bodies = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.explode(c.scripts_in(F.col("html"))).alias("t"))
    texts = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    return bodies.unionByName(texts).groupBy("kind", "id").agg(F.count(F.lit(1)).alias("bodies"), F.sum(c.is_javascript(F.col("t")).cast("int")).cast("long").alias("scripts"))


@query("SELECT page_id, CAST(len(s) AS BIGINT) AS n, md5(encode(array_to_string(s, chr(10)))) AS h FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]*?>(.*?)</script>', 1) AS s FROM pages)")
def script_extract(spark, d):
    """F19."""
    return table(spark, d, "pages").select("page_id", c.scripts_in(F.col("html")).alias("s")).select("page_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\n").cast("binary")).alias("h"))


@query("SELECT page_id, regexp_extract(html, '<title>(.*)</title>', 1) AS title FROM pages")
def tag_extract(spark, d):
    """The first element of a name."""
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?d)<title>(.*)</title>", 1).alias("title"))


@query("SELECT page_id, md5(encode(replace(replace(replace(replace(html, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&'))) AS h FROM pages")
def entity_filter(spark, d):
    """F8: entities of every page; those of the tables are four named ones."""
    return table(spark, d, "pages").select("page_id", F.md5(escapes.unescape_entities_col(F.col("html")).cast("binary")).alias("h"))


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '[\"''](.*?)[\"'']', 1), '') AS joined FROM pages")
def js_join_quoted(spark, d):
    """F22."""
    return table(spark, d, "pages").select("page_id", c.joined_quotes(F.col("html")).alias("joined"))


@query("SELECT doc_id, base64(encode(text)) AS b FROM documents")
def base64_encode(spark, d):
    """F29."""
    return table(spark, d, "documents").select("doc_id", c.base64_text(F.col("text").cast("binary")).alias("b"))


@query("SELECT doc_id, md5(encode(lower(hex(encode(text))))) AS h, CAST(2 * strlen(text) AS BIGINT) AS n FROM documents")
def hex_encode(spark, d):
    """C1, as hexadecimal text."""
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex(F.col("text").cast("binary"))).alias("x")).select("doc_id", F.md5(F.col("x").cast("binary")).alias("h"), F.length("x").cast("long").alias("n"))


@query("SELECT doc_id, lower(substr(hex(encode(text)), 2 * 16 + 1, 2 * 24)) AS bytes FROM documents")
def byte_range(spark, d):
    """24 bytes from offset 16."""
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex(c.byte_range(F.col("text").cast("binary"), 16, 24))).alias("bytes"))


@query(r"""WITH b AS (SELECT doc_id, hex(encode(text)) AS x FROM documents), r AS (SELECT doc_id, unnest(range(0, greatest(length(x) // 2, 1), 16)) AS i, x FROM b),
    p AS (SELECT doc_id, i, lower(substr(x, 2 * i + 1, 32)) AS part FROM r)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n, md5(encode(string_agg(rpad(trim(regexp_replace(part, '(..)', '\1 ', 'g')), 47, ' ') || '  |' ||
      array_to_string(list_transform(range(0, length(part) // 2), lambda k: CASE WHEN substr(part, 2 * k + 1, 2) BETWEEN '20' AND '7e' THEN chr(CAST('0x' || substr(part, 2 * k + 1, 2) AS INTEGER)) ELSE '.' END), '') || '|', chr(10) ORDER BY i))) AS h
    FROM p GROUP BY doc_id""")
def hexdump(spark, d):
    """All rows of sixteen bytes with their gutter."""
    rows = table(spark, d, "documents").select("doc_id", c.hexdump(F.col("text").cast("binary")).alias("rows"))
    return rows.select("doc_id", F.size("rows").cast("long").alias("n"), F.md5(F.array_join("rows", "\n").cast("binary")).alias("h"))


def _links(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ord", "target"))


_LINKS = """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS a FROM pages),
    e AS (SELECT page_id, unnest(range(0, len(a))) AS o, unnest(a) AS target FROM l)"""


@query(_LINKS + " SELECT page_id, CAST(o AS BIGINT) AS ord, target FROM e")
def edges_in(spark, d):
    """Forward references."""
    return _links(spark, d).select("page_id", F.col("ord").cast("long").alias("ord"), "target")


@query(_LINKS + " SELECT target, count(DISTINCT page_id) AS referrers, min(page_id) AS first_referrer FROM e GROUP BY target")
def edges_to(spark, d):
    """Who refers to it."""
    found = graph.references_to(_links(spark, d).select(F.col("page_id").alias("src"), F.col("target").alias("dst")))
    return found.select(F.col("dst").alias("target"), "referrers", "first_referrer")


@query(_LINKS + " SELECT page_id, string_agg(target, '|' ORDER BY length(target), target) AS targets FROM e GROUP BY page_id")
def edge_sort(spark, d):
    """References in a defined order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.length("target").alias("n"), "target")))
    return _links(spark, d).groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda x: x["target"]), "|").alias("targets"))


def _tree(spark, d) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    k = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    return n.unionByName(k)


_TREE = """WITH RECURSIVE e AS (
      SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
      UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
    ), r(node, depth, parent) AS (
      SELECT 'r' || r_regionkey, 0, CAST(NULL AS VARCHAR) FROM region WHERE r_regionkey < 3
      UNION ALL SELECT e.dst, r.depth + 1, e.src FROM r JOIN e ON e.src = r.node
    )"""


def _roots(spark, d) -> DataFrame:
    return table(spark, d, "region").where("r_regionkey < 3").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))


@query(_TREE + " SELECT node, CAST(min(depth) AS INTEGER) AS depth, min(parent) AS parent FROM r GROUP BY node")
def tree_reach(spark, d):
    """Shortest depth and parent from the first three regions."""
    return graph.reach(_tree(spark, d), _roots(spark, d))


@query(_TREE + " SELECT dst AS node FROM e WHERE dst NOT IN (SELECT node FROM r)")
def tree_forest(spark, d):
    """What no root leads to."""
    edges = _tree(spark, d)
    return graph.unreached(edges.select(F.col("dst").alias("node")), graph.reach(edges, _roots(spark, d)))


@query(_LINKS + " SELECT page_id, string_agg(target, '|' ORDER BY o) AS children FROM e GROUP BY page_id")
def tree_children(spark, d):
    """G1: each node with its children in order."""
    found = graph.children(_links(spark, d).select(F.col("page_id").alias("src"), "ord", F.col("target").alias("dst")))
    return found.select(F.col("src").alias("page_id"), F.array_join(F.transform("children", lambda x: x["dst"]), "|").alias("children"))


def _snapshots(spark, d) -> DataFrame:
    return table(spark, d, "events").select("user_id", F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("day"), "event_id", "event_type")


_DAYS = "WITH s AS (SELECT user_id, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS day, event_id, event_type FROM events)"


@query(_DAYS + " SELECT user_id, day, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC, event_id DESC) AS n FROM s) WHERE n = 1")
def latest_version(spark, d):
    """The newest row of each key."""
    return versions.newest(_snapshots(spark, d), ["user_id"], "day").select("user_id", "day", "event_id", "event_type")


@query(_DAYS + ", m AS (SELECT min(day) + 10 AS d FROM s) SELECT user_id, day, event_id, event_type FROM (SELECT s.*, row_number() OVER (PARTITION BY user_id ORDER BY day DESC, event_id DESC) AS n FROM s, m WHERE day <= d) WHERE n = 1")
def version_asof(spark, d):
    """The newest row up to the eleventh day."""
    s = _snapshots(spark, d)
    first = s.agg(F.min("day").alias("d"))  # one row
    return versions.newest(s.join(F.broadcast(first), F.col("day") <= F.col("d") + 10).drop("d"), ["user_id"], "day").select("user_id", "day", "event_id", "event_type")


@query(_DAYS + " SELECT day, change, count(*) AS n FROM (SELECT DISTINCT day, user_id, CASE WHEN day = min(day) OVER (PARTITION BY user_id) THEN 'added' ELSE 'modified' END AS change FROM s) GROUP BY ALL")
def changelog_added_modified(spark, d):
    """U1, W2."""
    return versions.first_seen(_snapshots(spark, d), ["user_id"], "day").groupBy("day", "change").agg(F.count(F.lit(1)).alias("n"))


@query(_DAYS + ", o AS (SELECT DISTINCT user_id, day FROM s) SELECT user_id, day + 1 AS day FROM o WHERE day < (SELECT max(day) FROM o) AND NOT EXISTS (SELECT 1 FROM o b WHERE b.user_id = o.user_id AND b.day = o.day + 1)")
def changelog_removed(spark, d):
    """Keys of the day before that are missing."""
    return versions.removed(_snapshots(spark, d), ["user_id"], "day", next_version=F.col("day") + 1)


@query(_DAYS + " SELECT DISTINCT user_id, day FROM s WHERE event_type = 'error' AND (user_id, day) NOT IN (SELECT (user_id, day) FROM s WHERE event_type = 'click')")
def changelog_incoherent(spark, d):
    """In a version's body, but not in its table of contents."""
    s = _snapshots(spark, d)
    errors, clicks = s.where("event_type = 'error'"), s.where("event_type = 'click'")
    return versions.incoherent(errors, clicks, clicks.where("false"), ["user_id", "day"])


def _parts(spark, d) -> DataFrame:
    return versions.offsets(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn"], F.octet_length("text")).drop("text")


_PARTS = "WITH p AS (SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS size, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations)"


@query(_PARTS + " SELECT conv_id, turn, start FROM p")
def offsets_cumulative(spark, d):
    """Running starts."""
    return _parts(spark, d).select("conv_id", "turn", "start")


@query(_PARTS + " SELECT conv_id, string_agg(start || '-' || (start + size), ' ' ORDER BY start, turn) AS map FROM p GROUP BY conv_id")
def physical_map(spark, d):
    """Parts by place."""
    entry = F.struct("start", "turn", F.concat_ws("-", F.col("start").cast("string"), F.col("stop").cast("string")).alias("s"))
    return _parts(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["s"]), " ").alias("map"))


@query(_PARTS + ", f AS (SELECT conv_id, start AS base FROM p WHERE turn = 0) SELECT conv_id, turn, base + start + 20 AS \"offset\" FROM p LEFT JOIN f USING (conv_id)")
def container_offset(spark, d):
    """Place of what lies in a container."""
    return versions.container_offset(_parts(spark, d), ["conv_id"], "turn").select("conv_id", "turn", "offset")


@query("WITH k AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority <> '1-URGENT') SELECT g AS o_orderkey FROM (SELECT unnest(range(CAST(min(k) AS BIGINT), CAST(max(k) + 1 AS BIGINT))) AS g FROM k) WHERE g NOT IN (SELECT k FROM k)")
def xref_gap_fill(spark, d):
    """Missing numbers."""
    return versions.gaps(table(spark, d, "orders").where("o_orderpriority <> '1-URGENT'"), "o_orderkey")


@query(_PARTS + " SELECT conv_id, turn, coalesce(lag(start) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS prev FROM p")
def prev_chain(spark, d):
    """W7."""
    return versions.previous(_parts(spark, d), ["conv_id"], ["turn"], "start", "prev").select("conv_id", "turn", F.coalesce("prev", F.lit(-1)).cast("long").alias("prev"))


@query("SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, o_orderpriority AS value, o_orderkey IS NULL AS missing FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') ON o_orderkey = l_orderkey")
def resolve_reference(spark, d):
    """References with what they name; those to finished orders are missing."""
    objects = table(spark, d, "orders").where("o_orderstatus <> 'F'")
    edges = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return versions.resolve(edges, objects, dst="l_orderkey", object_id="o_orderkey", value="o_orderpriority")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 5)")
def js_targets_second_pass(spark, d):
    """Referred to by one kind, and not by another."""
    line = table(spark, d, "lineitem")
    wanted = line.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    known = line.where("l_quantity < 5").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(wanted, "p_partkey", "left_semi").join(known, "p_partkey", "left_anti")


@query("""WITH a AS (SELECT o_custkey AS k, min(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_acctbal > 0)
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM a FULL OUTER JOIN b ON a.k = b.k""")
def trailer_coalesce(spark, d):
    """Of two sources the first that has it."""
    a = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderpriority").alias("v"))
    b = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return versions.fill(a, b, ["k"], ["v"])


@query("SELECT doc_id, coalesce(CAST(quality AS VARCHAR), lang) AS kind FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)")
def metadata_fallback(spark, d):
    """A field, or what stands for it."""
    known = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("kind"))
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("kind"))
    return docs.join(known.withColumnRenamed("kind", "k"), "doc_id", "left").select("doc_id", F.coalesce("k", "kind").alias("kind"))


@query("SELECT md5(encode(text)) AS h, count(*) AS n, min(doc_id) AS first_key FROM documents GROUP BY text HAVING count(*) > 1")
def value_counts(spark, d):
    """Repeated values."""
    found = stats.value_counts(table(spark, d, "documents"), "text", key="doc_id").where("n > 1")
    return found.select(F.md5(F.col("text").cast("binary")).alias("h"), "n", "first_key")


@query("SELECT min(doc_id) AS doc_id, md5(encode(text)) AS h FROM documents GROUP BY text")
def first_code_wins(spark, d):
    """A5: the first object that shows a text."""
    return stats.first_of_each(table(spark, d, "documents"), "text", key="doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS level, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) FILTER (l_discount > 0.05) AS discounted FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def stats_rollup(spark, d):
    """A1, A2: counters per group, sums over them, and over all."""
    return stats.totals(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": F.count(F.lit(1)), "quantity": F.sum(F.col("l_quantity").cast("long")), "discounted": F.count_if(F.col("l_discount") > 0.05)})


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (contains(text, chr(10))) AS many_lines, count(DISTINCT text) AS texts FROM documents GROUP BY ALL")
def file_stats(spark, d):
    """A8."""
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.contains("text", F.lit("\n"))).alias("many_lines"), F.count_distinct("text").alias("texts"))


@query("SELECT source, CAST(round(10000.0 * sum(toxic) / count(*)) AS BIGINT) AS per_10000 FROM documents JOIN labels USING (doc_id) GROUP BY source")
def detection_ratio(spark, d):
    """A ratio of sums, in ten-thousandths."""
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.round(F.lit(10000.0) * F.sum("toxic") / F.count(F.lit(1))).cast("long").alias("per_10000"))


@query("SELECT md5(encode(text)) AS h FROM (SELECT text FROM documents UNION SELECT text FROM benchmark)")
def set_union_distinct(spark, d):
    """U2, U3, U4."""
    return table(spark, d, "documents").select("text").union(table(spark, d, "benchmark").select("text")).distinct().select(F.md5(F.col("text").cast("binary")).alias("h"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark, d):
    """In one, not in the other."""
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'O'").select("o_custkey").subtract(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersection(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'O'").select("o_custkey").intersect(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def top_k_largest(spark, d):
    """The limit is the feature."""
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(20)


@query("SELECT doc_id, '{\"id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\",\"size\":' || n_chars || ',\"empty\":' || CASE WHEN n_chars = 0 THEN 'true' ELSE 'false' END || '}' AS report FROM documents")
def json_report(spark, d):
    """K1, Q4: fields in order, real booleans."""
    report = stats.json_report({"id": F.col("doc_id"), "lang": F.col("lang"), "source": F.col("source"), "size": F.col("n_chars"), "empty": F.col("n_chars") == 0})
    return table(spark, d, "documents").select("doc_id", report.alias("report"))


@query("SELECT doc_id, lang, md5(encode(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'))) AS h FROM documents")
def xml_report(spark, d):
    """K2: one well-formed element per row; its text comes back from Spark's XML reader as it was (XML reads any line end as a line feed)."""
    report = stats.xml_report({"id": F.col("doc_id"), "lang": F.col("lang"), "text": F.col("text")})
    back = table(spark, d, "documents").select("doc_id", F.from_xml(report, "id long, lang string, text string", {"ignoreSurroundingSpaces": "false"}).alias("x"))
    return back.where("x.id = doc_id").select("doc_id", "x.lang", F.md5(F.coalesce("x.text", F.lit("")).cast("binary")).alias("h"))


@query("SELECT doc_id, md5(encode(replace(text, 'the', 'THE'))) AS h FROM documents")
def replace_all(spark, d):
    """The replace command."""
    return table(spark, d, "documents").select("doc_id", F.md5(F.replace("text", F.lit("the"), F.lit("THE")).cast("binary")).alias("h"))


@query("SELECT doc_id, md5(encode(array_to_string(list_transform(range(0, strlen(text)), lambda i: lpad(lower(to_hex(xor(CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS INTEGER), 99))), 2, '0')), ''))) AS h FROM (SELECT item_id AS doc_id, text FROM benchmark)")
def xor_key_apply(spark, d):
    """every byte of every text XORed with a key of one byte."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return scan.xor_apply(rows, b"\x63", content="text").select("doc_id", F.md5(F.lower(F.hex("xored")).cast("binary")).alias("h"))


@query("""WITH k AS (SELECT unnest(range(0, 256)) AS k), p AS (SELECT k, string_agg(lpad(lower(to_hex(xor(b, k))), 2, '0') || ' ', '' ORDER BY i) AS p FROM (SELECT k, unnest([1, 2, 3]) AS i, unnest([116, 104, 101]) AS b FROM k) GROUP BY k),
    t AS (SELECT doc_id, regexp_replace(lower(hex(encode(text))), '(..)', '\\1 ', 'g') AS h FROM documents)
    SELECT doc_id, CAST(k AS INTEGER) AS xor_key, CAST((instr(h, p) - 1) // 3 AS INTEGER) AS "offset" FROM t, p WHERE instr(h, p) > 0""")
def xor_search(spark, d):
    """Keys under which 'the' occurs, with the first place."""
    return scan.xor_search(spread(table(spark, d, "documents")), b"the", key="doc_id", content="text")


def _chains():
    names = (["FlateDecode"], ["ASCIIHexDecode", "FlateDecode"], ["RunLengthDecode"], ["ASCII85Decode", "LZWDecode"])
    return F.element_at(F.array(*[F.array(*[F.lit(n) for n in x]) for x in names]), (F.col("doc_id") % 4 + 1).cast("int"))


@query("SELECT doc_id, md5(encode(text)) AS h, CAST(NULL AS VARCHAR) AS error FROM documents")
def chain_roundtrip(spark, d):
    """Encoded and decoded by a chain of filters that follows from the id."""
    rows = spread(table(spark, d, "documents")).select("doc_id", F.col("text").cast("binary").alias("t"), _chains().alias("f"))
    rows = rows.select("doc_id", filters.encode_chain(F.col("t"), F.col("f")).alias("e"), "f")
    back = rows.select("doc_id", filters.decode_chain(F.col("e"), F.col("f")).alias("r"))
    return back.select("doc_id", F.md5("r.bytes").alias("h"), F.col("r.error").cast("string").alias("error"))


def _pdfs(spark, d, password: bytes | None = None, **how) -> DataFrame:
    return pdf.generated(spread(table(spark, d, "documents")), file_id="doc_id", payload="text", uri=F.concat(F.lit("http://example.org/"), F.col("doc_id").cast("string")), title=F.concat_ws("-", "lang", "source"), password=password, **how)


_FIVE = "doc_id % 5 = 0"


@query(f"SELECT doc_id AS file_id, v AS version, CAST(unnest(CASE WHEN v = 0 THEN [1, 2, 3, 4, 5, 6] ELSE [4] END) AS INTEGER) AS object_id, unnest(CASE WHEN v = 0 THEN ['dictionary', 'dictionary', 'dictionary', 'stream', 'dictionary', 'dictionary'] ELSE ['stream'] END) AS obj_type, unnest(CASE WHEN v = 0 THEN ['/Catalog', '/Pages', '/Page', '', '', '/Annot'] ELSE [''] END) AS dict_type FROM (SELECT doc_id, CAST(unnest(CASE WHEN {_FIVE} THEN [0, 1] ELSE [0] END) AS INTEGER) AS v FROM documents)")
def pdf_objects(spark, d):
    """Objects of generated files."""
    return pdf.parsed(_pdfs(spark, d), "objects").select("file_id", "version", "object_id", "obj_type", "dict_type")


@query("SELECT doc_id AS file_id, CAST(unnest([1, 2, 3, 3, 3]) AS INTEGER) AS src_id, CAST(unnest([0, 0, 0, 1, 2]) AS INTEGER) AS ord, CAST(unnest([2, 3, 2, 4, 6]) AS INTEGER) AS dst_id FROM documents")
def pdf_edges(spark, d):
    """References of generated files."""
    return pdf.parsed(_pdfs(spark, d), "edges").where("origin = 'element'").select("file_id", "src_id", "ord", "dst_id")


@query(f"SELECT doc_id AS file_id, CAST(unnest(CASE WHEN {_FIVE} THEN [0, 1] ELSE [0] END) AS INTEGER) AS version FROM documents")
def pdf_versions(spark, d):
    """Versions of generated files."""
    return pdf.parsed(_pdfs(spark, d), "versions").select("file_id", "version")


@query(f"SELECT doc_id AS file_id, 0 AS version, md5(encode(text)) AS h, false AS faulty FROM documents UNION ALL SELECT doc_id, 1, md5(encode('updated ' || text)), false FROM documents WHERE {_FIVE}")
def pdf_streams(spark, d):
    """Decoded streams of generated files."""
    return pdf.parsed(_pdfs(spark, d), "streams").select("file_id", "version", F.md5("decoded").alias("h"), "faulty")


@query(f"SELECT doc_id AS file_id, '1.4' AS pdf_version, CAST(0 AS BIGINT) AS header_offset, true AS \"binary\", false AS encrypted, CASE WHEN {_FIVE} THEN 1 ELSE 0 END AS updates, 0 AS faults FROM documents")
def pdf_files(spark, d):
    """Headers of generated files."""
    return pdf.parsed(_pdfs(spark, d), "files").select("file_id", "pdf_version", "header_offset", "binary", "encrypted", "updates", F.size("errors").alias("faults"))


@query("SELECT doc_id AS file_id, CAST(6 AS INTEGER) AS object_id, 'http://example.org/' || doc_id AS uri FROM documents")
def pdf_uris(spark, d):
    """A6, A14."""
    return pdf.parsed(_pdfs(spark, d), "uris").select("file_id", "object_id", "uri")


@query(f"SELECT doc_id AS file_id, 0 AS version, CAST(unnest(range(0, 7)) AS INTEGER) AS object_id, unnest(['free', 'used', 'used', 'used', 'used', 'used', 'used']) AS kind FROM documents UNION ALL SELECT doc_id, 1, 4, 'used' FROM documents WHERE {_FIVE}")
def pdf_xref(spark, d):
    """Cross-reference entries of generated files."""
    return pdf.parsed(_pdfs(spark, d), "xref_entries").select("file_id", "version", "object_id", "kind")


@query(f"SELECT doc_id AS file_id, v AS version, object_id, CASE WHEN v = 0 THEN 'added' ELSE 'modified' END AS change FROM (SELECT doc_id, v, CAST(unnest(CASE WHEN v = 0 THEN [1, 2, 3, 4, 5, 6] ELSE [4] END) AS INTEGER) AS object_id FROM (SELECT doc_id, CAST(unnest(CASE WHEN {_FIVE} THEN [0, 1] ELSE [0] END) AS INTEGER) AS v FROM documents))")
def pdf_changelog(spark, d):
    """What each version of generated files changed."""
    t = pdf.parsed_tables(_pdfs(spark, d), ("objects", "xref_entries"))
    return analysis.changelog(t["objects"], t["xref_entries"])


@query(f"SELECT doc_id AS file_id, coalesce(v, -1) AS version, CAST(CASE WHEN v = 0 THEN 6 WHEN v = 1 THEN 1 WHEN {_FIVE} THEN 7 ELSE 6 END AS BIGINT) AS objects, CAST(CASE WHEN v IS NULL AND {_FIVE} THEN 2 ELSE 1 END AS BIGINT) AS streams, CAST(CASE WHEN v = 1 THEN 1 WHEN v IS NULL AND {_FIVE} THEN 1 + (doc_id % 4 <> 0)::INT ELSE (doc_id % 4 <> 0)::INT END AS BIGINT) AS encoded FROM (SELECT doc_id, CAST(unnest(CASE WHEN {_FIVE} THEN [0, 1, NULL] ELSE [0, NULL] END) AS INTEGER) AS v FROM documents)")
def pdf_counts(spark, d):
    """A1, A2: counters per version, and over versions."""
    t = pdf.parsed_tables(_pdfs(spark, d), ("objects", "streams"))
    return analysis.version_counts(t["objects"], t["streams"]).select("file_id", F.coalesce("version", F.lit(-1)).alias("version"), "objects", "streams", "encoded")


@query("SELECT doc_id AS file_id, CAST(unnest([1, 2, 3, 4, 5, 6]) AS INTEGER) AS node, CAST(unnest([0, 1, 2, 3, -1, 3]) AS INTEGER) AS depth, CAST(unnest([-1, 1, 2, 3, -1, 3]) AS INTEGER) AS parent, unnest(['/Catalog', '/Pages', '/Page', 'stream', 'dictionary', '/Annot']) AS label FROM documents")
def pdf_tree(spark, d):
    """The logical tree of generated files."""
    t = pdf.parsed_tables(_pdfs(spark, d), ("objects", "edges", "trailers"))
    found = analysis.tree(t["objects"], t["edges"].where("origin = 'element'"), t["trailers"])
    return found.select("file_id", "node", *[F.coalesce(x, F.lit(-1)).alias(x) for x in ("depth", "parent")], "label")


@query(f"SELECT doc_id AS file_id, CAST(unnest(CASE WHEN {_FIVE} THEN [0, 1] ELSE [0] END) AS INTEGER) AS version, '/Title' AS key, lang || '-' || source AS value FROM documents")
def pdf_metadata(spark, d):
    """The information dictionary of each version."""
    t = pdf.parsed_tables(_pdfs(spark, d), ("dict_entries", "trailers"))
    return analysis.metadata(t["dict_entries"], t["trailers"])


@query(f"SELECT doc_id AS file_id, CAST(unnest(CASE WHEN {_FIVE} THEN [0, 1] ELSE [0] END) AS INTEGER) AS version, '4' AS ids FROM documents WHERE regexp_matches(text, 'the[a-z]*ing', 'i')")
def pdf_search(spark, d):
    """P10: ids per version of the objects that hold a text, decoded streams included."""
    t = pdf.parsed_tables(_pdfs(spark, d), ("objects", "streams"))
    found = analysis.search_objects(t["objects"], t["streams"], "the[a-z]*ing", regex=True)
    return found.select("file_id", "version", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("SELECT doc_id AS file_id, CAST(6 AS BIGINT) AS objects, md5(encode(text)) AS h FROM documents")
def pdf_save_version(spark, d):
    """K6: the first version cut out of each file has the six first objects, and the first content stream."""
    files = _pdfs(spark, d)
    first = analysis.up_to_version(files, pdf.parsed(files, "versions"), 0)
    t = pdf.parsed_tables(first, ("objects", "streams"))
    n = t["objects"].groupBy("file_id").agg(F.count(F.lit(1)).alias("objects"))
    return n.join(t["streams"].select("file_id", F.md5("decoded").alias("h")), "file_id")


@query(f"SELECT doc_id AS file_id, 0 AS version, md5(encode(text)) AS h FROM documents UNION ALL SELECT doc_id, 1, md5(encode('updated ' || text)) FROM documents WHERE {_FIVE}")
def pdf_decrypt(spark, d):
    """Streams of encrypted files, opened with the password."""
    return pdf.parsed(_pdfs(spark, d, b"secret"), "streams", password=b"secret").select("file_id", "version", F.md5("decoded").alias("h"))


@query(f"SELECT doc_id AS file_id, 0 AS version, md5(encode(text)) AS h FROM documents UNION ALL SELECT doc_id, 1, md5(encode('updated ' || text)) FROM documents WHERE {_FIVE}")
def pdf_aes(spark, d):
    """Streams of files encrypted by AES, opened with the owner's password."""
    return pdf.parsed(_pdfs(spark, d, b"secret", cipher="aes"), "streams", password=b"owner").select("file_id", "version", F.md5("decoded").alias("h"))


@query("SELECT doc_id AS file_id, CAST(unnest([1, 2, 3, 4, 5, 6, 8, 9]) AS INTEGER) AS object_id, unnest(['/Catalog', '/Pages', '/Page', '', '', '/Annot', '/ObjStm', '/XRef']) AS dict_type, CAST(unnest([8, 8, 8, -1, 8, 8, -1, -1]) AS INTEGER) AS compressed_in FROM documents")
def pdf_object_stream(spark, d):
    """Objects that lie in an object stream."""
    found = pdf.parsed(_pdfs(spark, d, compressed=True), "objects")
    return found.select("file_id", "object_id", "dict_type", F.coalesce("compressed_in", F.lit(-1)).alias("compressed_in"))


@query("SELECT doc_id AS file_id, CAST(unnest([0, 1, 2, 3, 4, 5, 6, 8, 9]) AS INTEGER) AS object_id, unnest(['free', 'compressed', 'compressed', 'compressed', 'used', 'compressed', 'compressed', 'used', 'used']) AS kind, true AS in_stream FROM documents")
def pdf_xref_stream(spark, d):
    """Cross-reference entries from a stream, in two ranges."""
    return pdf.parsed(_pdfs(spark, d, compressed=True), "xref_entries").select("file_id", "object_id", "kind", "in_stream")


@query("SELECT doc_id AS file_id, true AS in_stream, CAST(10 AS BIGINT) AS size, 1 AS root, 5 AS info FROM documents")
def pdf_trailer_stream(spark, d):
    """The trailer that a cross-reference stream stands for."""
    return pdf.parsed(_pdfs(spark, d, compressed=True), "trailers").select("file_id", "in_stream", "size", "root", "info")


@query("SELECT doc_id AS file_id, CAST(unnest([1, 2, 3, 4, 5, 6, 8, 9]) AS INTEGER) AS node, CAST(unnest([0, 1, 2, 3, -1, 3, -1, -1]) AS INTEGER) AS depth FROM documents")
def pdf_tree_compressed(spark, d):
    """G2 over objects of an object stream."""
    t = pdf.parsed_tables(_pdfs(spark, d, compressed=True), ("objects", "edges", "trailers"))
    found = analysis.tree(t["objects"], t["edges"].where("origin = 'element' and src_id <> 9"), t["trailers"])
    return found.select("file_id", "node", F.coalesce("depth", F.lit(-1)).alias("depth"))


def _scripted(spark, d) -> DataFrame:
    """Files with a script that the catalog opens; which one follows from the text."""
    known = F.when(F.contains("text", F.lit("the")), F.lit("var a = util.printf; this.getIcon(a);")).when(F.contains("text", F.lit("que")), F.lit("app.mailto(1); mailto(2);")).otherwise(F.lit("var q = 1;"))
    return _pdfs(spark, d, script=known)


_SCRIPT = "SELECT doc_id AS file_id, CASE WHEN contains(text, 'the') THEN 1 WHEN contains(text, 'que') THEN 2 ELSE 3 END AS kind FROM documents"


@query(f"SELECT file_id, CAST(7 AS INTEGER) AS object_id, 'referred' AS origin, CASE kind WHEN 1 THEN 'var a = util.printf; this.getIcon(a);' WHEN 2 THEN 'app.mailto(1); mailto(2);' ELSE 'var q = 1;' END AS code FROM ({_SCRIPT})")
def pdf_javascript(spark, d):
    """Scripts that the catalog's action names."""
    t = pdf.parsed_tables(_scripted(spark, d), ("objects", "dict_entries", "streams"))
    return analysis.javascript(t["objects"], t["dict_entries"], t["streams"]).where("origin = 'referred'").select("file_id", "object_id", "origin", "code")


_FINDINGS = f"""SELECT file_id, f.category AS category, f.token AS token, CAST(f.id AS VARCHAR) AS ids FROM ({_SCRIPT}) CROSS JOIN (
      SELECT unnest([1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 1, 2]) AS of_kind, unnest([
        {{'category': 'event', 'token': '/OpenAction', 'id': 1}}, {{'category': 'event', 'token': '/OpenAction', 'id': 1}}, {{'category': 'event', 'token': '/OpenAction', 'id': 1}},
        {{'category': 'action', 'token': '/JavaScript', 'id': 1}}, {{'category': 'action', 'token': '/JavaScript', 'id': 1}}, {{'category': 'action', 'token': '/JavaScript', 'id': 1}},
        {{'category': 'action', 'token': '/JS', 'id': 1}}, {{'category': 'action', 'token': '/JS', 'id': 1}}, {{'category': 'action', 'token': '/JS', 'id': 1}},
        {{'category': 'js_vuln', 'token': 'util.printf', 'id': 7}}, {{'category': 'js_vuln', 'token': 'getIcon', 'id': 7}}, {{'category': 'js_vuln', 'token': 'mailto', 'id': 7}}]) AS f
    ) WHERE kind = of_kind"""


@query(_FINDINGS)
def pdf_findings(spark, d):
    """A3, A4: suspicious markers of files with scripts, ids per token."""
    t = pdf.parsed_tables(_scripted(spark, d), ("objects", "dict_entries", "streams"))
    scripts = analysis.javascript(t["objects"], t["dict_entries"], t["streams"]).where("origin = 'referred'")
    found = analysis.suspicious(analysis.findings(t["objects"], t["streams"], scripts))
    return found.select("file_id", "category", "token", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"""WITH f AS ({_FINDINGS}), s AS (SELECT file_id, string_agg('{{"category":"' || category || '","token":"' || token || '","ids":[' || ids || ']}}', ',' ORDER BY category, token) AS found FROM f GROUP BY file_id)
    SELECT doc_id AS file_id, '{{"pdf_version":"1.4","updates":' || CASE WHEN {_FIVE} THEN 1 ELSE 0 END || ',"encrypted":false,"versions":[{{"version":0,"objects":7,"streams":2}}' || CASE WHEN {_FIVE} THEN ',{{"version":1,"objects":1,"streams":1}}' ELSE '' END || '],"suspicious":[' || found || ']}}' AS report
    FROM documents JOIN s ON file_id = doc_id""".replace("{{", "{").replace("}}", "}"))
def pdf_report(spark, d):
    """The nested report of a file, its versions and suspicious markers inside."""
    t = pdf.parsed_tables(_scripted(spark, d), ("files", "objects", "dict_entries", "streams"))
    scripts = analysis.javascript(t["objects"], t["dict_entries"], t["streams"]).where("origin = 'referred'")
    whole = analysis.report(t["files"], t["objects"], t["streams"], analysis.findings(t["objects"], t["streams"], scripts))
    # what does not depend on the bytes of the files
    shape = "pdf_version string, updates int, encrypted boolean, versions array<struct<version: int, objects: long, streams: long>>, suspicious array<struct<category: string, token: string, ids: array<int>>>"
    return whole.select("file_id", F.to_json(F.from_json("report", shape)).alias("report"))


@query(f"""SELECT doc_id AS file_id, '1.4' AS pdf_version, CAST(CASE WHEN {_FIVE} THEN 2 ELSE 1 END AS BIGINT) AS versions, CAST(CASE kind WHEN 1 THEN 5 WHEN 2 THEN 4 ELSE 3 END AS BIGINT) AS markers FROM documents JOIN ({_SCRIPT}) ON file_id = doc_id""")
def pdf_report_xml(spark, d):
    """K2: the nested report as XML, read back."""
    t = pdf.parsed_tables(_scripted(spark, d), ("files", "objects", "dict_entries", "streams"))
    scripts = analysis.javascript(t["objects"], t["dict_entries"], t["streams"]).where("origin = 'referred'")
    whole = analysis.report(t["files"], t["objects"], t["streams"], analysis.findings(t["objects"], t["streams"], scripts), form="xml")
    back = whole.select("file_id", F.from_xml("report", "pdf_version string, versions array<struct<version: int>>, suspicious array<struct<token: string>>").alias("x"))
    return back.select("file_id", "x.pdf_version", F.size("x.versions").cast("long").alias("versions"), F.size("x.suspicious").cast("long").alias("markers"))


@query(f"SELECT doc_id AS file_id, CAST(unnest(CASE WHEN {_FIVE} THEN [0, 1] ELSE [0] END) AS INTEGER) AS version, CAST(unnest(CASE WHEN {_FIVE} THEN [7, 1] ELSE [7] END) AS BIGINT) AS entries, CAST(unnest(CASE WHEN {_FIVE} THEN [1, 0] ELSE [1] END) AS BIGINT) AS free, CAST(7 AS BIGINT) AS size, unnest(CASE WHEN {_FIVE} THEN [false, true] ELSE [false] END) AS has_prev FROM documents")
def pdf_section_stats(spark, d):
    """A10: cross-reference sections and trailers per version."""
    t = pdf.parsed_tables(_pdfs(spark, d), ("xref_entries", "trailers"))
    return analysis.section_stats(t["xref_entries"], t["trailers"]).select("file_id", "version", "entries", "free", "size", F.col("prev").isNotNull().alias("has_prev"))


@query(f"SELECT doc_id AS file_id, v AS version, CAST(unnest(CASE WHEN v = 0 THEN [1, 2, 3, 4, 5, 6] ELSE [4] END) AS INTEGER) AS object_id, CAST(unnest(CASE WHEN v = 0 THEN [1, 1, 3, 0, 0, 0] ELSE [0] END) AS BIGINT) AS refs, unnest(CASE WHEN v = 1 THEN [true] ELSE [false, false, false, doc_id % 4 <> 0, false, false] END) AS encoded FROM (SELECT doc_id, CAST(unnest(CASE WHEN {_FIVE} THEN [0, 1] ELSE [0] END) AS INTEGER) AS v FROM documents)")
def pdf_object_stats(spark, d):
    """References and flags per object."""
    t = pdf.parsed_tables(_pdfs(spark, d), ("objects", "edges", "streams"))
    return analysis.object_stats(t["objects"], t["edges"].where("origin = 'element'"), t["streams"]).select("file_id", "version", "object_id", "refs", "encoded")


@query("SELECT error, count(*) AS n FROM (SELECT unnest(CASE WHEN lang = 'en' THEN ['no header'] ELSE ['no end-of-file mark'] END) AS error FROM documents WHERE NOT contains(text, '%%EOF') AND NOT contains(text, '%PDF-')) GROUP BY error")
def pdf_errors(spark, d):
    """Faults of damaged files, counted: English ones lost their header, others their end marks."""
    docs = table(spark, d, "documents").where("not contains(text, '%%EOF') and not contains(text, '%PDF-')")
    files = _pdfs(spark, d).join(docs.select(F.col("doc_id").alias("file_id"), "lang"), "file_id")
    x = F.hex("content")
    broken = F.when(F.col("lang") == "en", F.substring(x, 17, 1 << 30)).otherwise(F.replace(x, F.lit("2525454F46"), F.lit("2525454F47")))
    return analysis.error_counts(pdf.parsed(files.select("file_id", F.unhex(broken).alias("content")), "files"))


@query("SELECT doc_id, md5(encode(array_to_string(list_transform(string_split(text, ''), lambda x: '\\' || to_base(unicode(x) & 255, 8, 3)), ''))) AS octal, md5(encode(array_to_string(list_transform(string_split(text, ''), lambda x: CASE WHEN x = '/' THEN x ELSE '#' || lower(to_base(unicode(x) & 255, 16, 2)) END), ''))) AS name FROM documents WHERE text <> ''")
def escape_encode(spark, d):
    """every character as an octal code, and as in a name."""
    rows = table(spark, d, "documents").where("text <> ''")
    coded = escapes.mapped(rows, ["doc_id"], octal=("text", [escapes.encode_octal]), name=("text", [escapes.encode_name]))
    return coded.select("doc_id", *[F.md5(F.col(x).cast("binary")).alias(x) for x in ("octal", "name")])


@query(r"SELECT doc_id, md5(encode(array_to_string(list_transform(string_split(text, ''), lambda x: chr(CAST(unicode(x) & 255 AS INTEGER))), ''))) AS octal, md5(encode(array_to_string(list_transform(string_split(text, ''), lambda x: chr(CAST(unicode(x) & 255 AS INTEGER))), ''))) AS name, md5(encode(text)) AS literal FROM documents WHERE text <> '' AND NOT regexp_matches(text, '[\x{100}-\x{10ffff}]')")
def escape_roundtrip(spark, d):
    """codes decoded again, and the escapes of literal strings; texts of one byte a character."""
    rows = table(spark, d, "documents").where("text <> ''").where(F.regexp_count("text", F.lit(r"[\x{100}-\x{10ffff}]")) == 0)
    back = escapes.mapped(rows, ["doc_id"], octal=("text", [escapes.encode_octal, escapes.decode_octal]), name=("text", [escapes.encode_name, escapes.decode_name]), literal=("text", [escapes.escape_string, escapes.unescape_string]))
    return back.select("doc_id", *[F.md5(F.col(x).cast("binary")).alias(x) for x in ("octal", "name", "literal")])


@query(r"SELECT doc_id, md5(encode(regexp_replace(text, '([\\.*?+^$(){}\[\]|])', '\\\1', 'g'))) AS h FROM documents")
def escape_regex(spark, d):
    """F6."""
    return table(spark, d, "documents").select("doc_id", F.md5(c.escape_regex(F.col("text")).cast("binary")).alias("h"))


@query("SELECT o_orderkey, right(lpad(to_base(o_orderkey, 2), 64, '0'), 24) AS bits, upper(lpad(to_base(o_orderkey, 16), 16, '0')) AS wide, CASE WHEN o_orderkey < 65536 THEN upper(lpad(to_base(o_orderkey, 16), 4, '0')) END AS narrow, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS digits FROM orders")
def number_conversions(spark, d):
    """numbers as bits, bytes and padded text; null where they are too wide."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", c.bits_of(k, 24).alias("bits"), F.hex(c.number_to_bytes(k, 8)).alias("wide"), F.hex(c.number_to_bytes(k, 2)).alias("narrow"), c.number_to_text(k, 12).alias("digits"))


@query("SELECT item_id, md5(encode(array_to_string(list_transform(range(0, strlen(text) * 2), lambda i: CAST(CAST('0x' || substr(hex(encode(text)), i + 1, 1) AS INTEGER) AS VARCHAR)), ','))) AS nibbles, md5(encode(upper(hex(encode(text))))) AS packed FROM benchmark")
def byte_unpack(spark, d):
    """bytes as numbers of four bits, and bits and digits back to bytes."""
    data = F.col("text").cast("binary")
    nibbles = c.numbers_of_bytes(data, 4)
    bits = F.array_join(F.transform(nibbles, lambda n: c.bits_of(n, 4)), "")
    rows = table(spark, d, "benchmark").select("item_id", data.alias("data"), nibbles.alias("nibbles"), c.bytes_of_bits(bits).alias("packed"), c.hex_to_bytes(F.hex(data)).alias("left"), c.hex_string_to_bytes(F.hex(data)).alias("right"))
    return rows.where("packed = left and packed = right").select("item_id", F.md5(F.array_join(F.col("nibbles").cast("array<string>"), ",").cast("binary")).alias("nibbles"), F.md5(F.hex("packed").cast("binary")).alias("packed"))


@query("SELECT item_id, array_to_string(list_transform(string_split(text, ''), lambda x: lower(to_base(unicode(x) & 255, 16, 2)) || lower(to_base(unicode(x) >> 8, 16, 2))), '') AS x FROM benchmark WHERE text <> ''")
def unescape_js(spark, d):
    """F16: %uABCD to bytes, low one first."""
    coded = F.array_join(F.transform(F.split("text", ""), lambda x: F.concat(F.lit("%u"), F.lpad(F.hex(F.ascii(x)), 4, "0"))), "")
    return table(spark, d, "benchmark").where("text <> ''").select("item_id", F.lower(F.hex(escapes.unescape_js_col(coded))).alias("x"))


@query("SELECT item_id, text AS content FROM benchmark WHERE text <> '' AND NOT contains(text, '\"')")
def variable_content(spark, d):
    """an expression of quoted parts and variables, put together."""
    half = F.floor(F.length("text") / 2).cast("int")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    script = F.concat(F.lit("var a = "), quoted(F.left("text", half)), F.lit("; var b = a + "), quoted(F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)")), F.lit("; eval(b);"))
    rows = table(spark, d, "benchmark").where("text <> ''").where(~F.contains("text", F.lit('"')))
    return rows.select("item_id", escapes.variable_content_col(script, "b").alias("content"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, 'track\\(')) AS BIGINT) AS calls FROM pages")
def function_calls(spark, d):
    """calls of a function by its name or by another that stands for it."""
    aliased = F.concat(F.lit("var alias = track; "), F.regexp_replace("html", r"track\(", "alias("))
    return table(spark, d, "pages").select("page_id", F.size(escapes.calls_col(aliased, "track")).cast("long").alias("calls"))


@query("SELECT doc_id, CAST(len(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS BIGINT) AS n FROM documents")
def line_count(spark, d):
    """Lines that end in CR LF, CR or LF."""
    return table(spark, d, "documents").select("doc_id", F.size(analysis.lines(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, n_chars > 1000 AS bmp, n_chars > 91 AS sing FROM (SELECT doc_id, least(CAST(length(text) AS BIGINT), 1500) AS n_chars FROM documents)")
def font_and_bitmap_markers(spark, d):
    """A font name that runs over, and a token that occurs too often, in contents made by length."""
    n = F.least(F.length("text"), F.lit(1500))
    font = F.concat(F.lit("x" * 236).cast("binary"), F.lit("SING").cast("binary"), F.repeat(F.lit("y"), F.greatest(n - 4, F.lit(0))).cast("binary"))
    return table(spark, d, "documents").select("doc_id", c.bmp_rle(F.repeat(F.lit(rules.BMP_RLE_TOKEN), n), rules.BMP_RLE_TOKEN, rules.BMP_RLE_MORE_THAN).alias("bmp"), c.sing_font(font).alias("sing"))


@query(r"SELECT page_id, '[' || coalesce(string_agg(r, ',' ORDER BY r), '') || ']' AS refs FROM (SELECT page_id, (page_id % 97) || ' 0 R' AS r FROM pages UNION SELECT page_id, length(url) || ' 0 R' FROM pages) GROUP BY page_id")
def element_union(spark, d):
    """References of all elements of a value, each once."""
    text = F.concat(F.lit("<< /A [ "), (F.col("page_id") % 97).cast("string"), F.lit(" 0 R "), F.length("url").cast("string"), F.lit(" 0 R ] /B "), (F.col("page_id") % 97).cast("string"), F.lit(" 0 R >>"))
    refs = c.references_in(text)
    again = F.transform(refs, lambda r: F.concat(c.reference_id(r).cast("string"), F.lit(" 0 R")))
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("["), F.array_join(F.array_sort(F.array_union(refs, again)), ","), F.lit("]")).alias("refs"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(malicious) AS BIGINT) AS malicious FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS malicious FROM events) GROUP BY user_id")
def reputation(spark, d):
    """A user's verdicts joined by hash, those without a verdict counted too."""
    events = table(spark, d, "events").select("event_id", "user_id", F.md5(F.col("event_id").cast("string").cast("binary")).alias("md5"), "event_type")
    verdicts = events.where("event_type = 'error'").select("md5", F.lit(1).alias("malicious"), F.lit(0).alias("suspicious"), F.lit(0).alias("undetected"), F.lit(0).alias("harmless"))
    found = analysis.with_reputation(events.select("user_id", "md5"), verdicts)
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("detection", F.lit(0.0))).cast("long").alias("malicious"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_counts(spark, d):
    """The windowed counts of the streaming module, over a table that is whole."""
    return dropfolder.event_counts(table(spark, d, "events")).select(F.col("start").cast("date").alias("day"), "event_type", "n")


@query("SELECT string_agg(source || ': ' || n || ' documents, ' || c || ' characters', chr(10) ORDER BY source) AS report FROM (SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS c FROM documents GROUP BY source)")
def text_report(spark, d):
    """K3: counts as lines of a text."""
    rows = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c"))
    return stats.text_report(rows, "%s: %d documents, %d characters", ["source", "n", "c"])


@query("WITH RECURSIVE k AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey AS k FROM part WHERE p_size = 1), r(i, k, depth) AS (SELECT i, k, 0 FROM k WHERE i = 1 UNION ALL SELECT k.i, k.k, depth + 1 FROM r JOIN k ON k.i = r.i + 1) SELECT CAST(k AS BIGINT) AS node, CAST(depth AS INTEGER) AS depth FROM r")
def tree_deep(spark, d):
    """G2 over a chain: each part of size 1 leads to the next one; as deep as there are such parts."""
    parts = table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").cast("long").alias("src"))
    edges = versions.next_in_order(parts, "src", "dst").where("dst is not null")
    return graph.reach(edges, parts.agg(F.min("src").alias("node"))).select("node", "depth")


@query(f"SELECT doc_id AS file_id, CAST(CASE WHEN {_FIVE} THEN 1 ELSE 0 END AS INTEGER) AS version, 'stream' AS obj_type FROM documents")
def pdf_object_lookup(spark, d):
    """Object 4 of every file, as its newest version has it."""
    found = analysis.latest_objects(pdf.parsed(_pdfs(spark, d), "objects")).where("object_id = 4")
    return found.select("file_id", "version", "obj_type")


@query(f"""SELECT doc_id AS file_id, v AS version, '4' AS streams, CASE WHEN v = 1 OR doc_id % 4 <> 0 THEN '4' ELSE '' END AS encoded, '' AS faulty, '' AS compressed, CASE WHEN v = 0 THEN '6' ELSE '' END AS uris
    FROM (SELECT doc_id, CAST(unnest(CASE WHEN {_FIVE} THEN [0, 1] ELSE [0] END) AS INTEGER) AS v FROM documents)""")
def pdf_listings(spark, d):
    """Ids per version of streams, encoded, faulty and compressed objects, and of those with addresses."""
    t = pdf.parsed_tables(_pdfs(spark, d), ("objects", "streams", "uris"))
    found = analysis.listings(t["objects"], t["streams"], t["uris"])
    return found.select("file_id", "version", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("streams", "encoded", "faulty", "compressed", "uris")])


@query("SELECT doc_id AS file_id, CAST(unnest([1, 2, 3, 6]) AS INTEGER) AS object_id, unnest([false, false, true, false]) AS has_box, unnest(['/Catalog', '/Pages', '/Page', '/Annot']) AS type FROM documents")
def pdf_elements(spark, d):
    """A dictionary's element by its name, and whether it has one."""
    entries = pdf.parsed(_pdfs(spark, d), "dict_entries")
    return analysis.elements(entries, "/Type", "/MediaBox").select("file_id", "object_id", F.col("has").alias("has_box"), F.col("value").alias("type"))


@query(f"SELECT doc_id AS file_id, CAST(6 + CASE WHEN {_FIVE} THEN 1 ELSE 0 END AS BIGINT) AS objects FROM documents WHERE NOT contains(text, 'endobj') AND NOT contains(text, ' obj')")
def pdf_loose(spark, d):
    """Objects whose ends are missing, read up to the next one's beginning."""
    keep = table(spark, d, "documents").where("not contains(text, 'endobj') and not contains(text, ' obj')").select(F.col("doc_id").alias("file_id"))
    files = _pdfs(spark, d).join(keep, "file_id").select("file_id", F.unhex(F.replace(F.hex("content"), F.lit("656E646F626A"), F.lit(""))).alias("content"))
    return pdf.parsed(files, "objects", loose=True).groupBy("file_id").agg(F.count(F.lit(1)).alias("objects"))


@query("SELECT item_id AS file_id, md5(encode(t)) AS h FROM (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM benchmark)")
def pdf_text(spark, d):
    """The text that a page shows."""
    plain = F.regexp_replace("text", "[^ -~]", "")
    rows = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("BT ("), escapes.escape_string_col(plain), F.lit(") Tj ET")).alias("page"))
    files = pdf.generated(rows.withColumn("item_id", F.col("item_id") * 5 + 1), file_id="item_id", payload="page", uri=F.lit("x"), title=F.lit("t"))
    return pdf.parsed(files, "streams").select(((F.col("file_id") - 1) / 5).cast("long").alias("file_id"), F.md5(F.col("text").cast("binary")).alias("h"))
