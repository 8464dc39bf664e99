"""Questions about parsed PDF files, each a query over the tables of docquarry.sources.pdf.

Tables carry file_id and version, so every answer is for a whole collection at
once; filter file_id for a single file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry import rules as known
from docquarry.codecs import escapes
from docquarry.functions import columns as c
from docquarry.operators import graph, scan, versions

OBJECT = ["file_id", "version", "object_id"]


def latest_objects(objects: DataFrame, *, upto: int | None = None) -> DataFrame:
    """Each object as its newest version has it, or the newest up to a version."""
    return versions.newest(objects, ["file_id", "object_id"], "version", upto=None if upto is None else F.lit(upto))


def ids_by_version(objects: DataFrame, condition: Column | None = None) -> DataFrame:
    """(file_id, version, ids): ascending ids of the objects that meet a condition."""
    rows = objects if condition is None else objects.where(condition)
    return rows.groupBy("file_id", "version").agg(F.array_sort(F.collect_set("object_id")).alias("ids"))


def listings(objects: DataFrame, streams: DataFrame, uris: DataFrame) -> DataFrame:
    """Per file and version the ascending ids of its streams, of encoded, faulty and compressed objects, and of those with addresses."""
    s = streams.select(*OBJECT, F.lit(True).alias("is_stream"), (F.size("filters") > 0).alias("is_encoded"), F.col("faulty").alias("is_faulty"))
    u = uris.select(*OBJECT).distinct().withColumn("has_uri", F.lit(True))
    joined = objects.join(s, OBJECT, "left").join(u, OBJECT, "left")
    kinds = {"streams": F.col("is_stream"), "encoded": F.col("is_encoded"), "faulty": F.coalesce("is_faulty", F.lit(False)) | (F.size("errors") > 0), "compressed": F.col("compressed_in").isNotNull(), "uris": F.col("has_uri")}
    return joined.groupBy("file_id", "version").agg(*[F.array_sort(F.collect_set(F.when(test, F.col("object_id")))).alias(name) for name, test in kinds.items()])


def elements(entries: DataFrame, name: str, member: str) -> DataFrame:
    """(file_id, version, object_id, value, has): the outermost element of a name, and whether the same dictionary has a member."""
    outer = entries.where(F.col("path") == F.col("key"))
    found = outer.groupBy(*OBJECT).agg(F.max(F.when(F.col("key") == name, F.col("value"))).alias("value"), F.max(F.col("key") == member).alias("has"))
    return found.where("value is not null")


def search_objects(objects: DataFrame, streams: DataFrame, needle: str, *, regex: bool = False) -> DataFrame:
    """Ids per version of the objects whose value or decoded stream holds a text."""
    text = streams.select(*OBJECT, F.decode("decoded", "ISO-8859-1").alias("stream_text"))
    both = objects.select(*OBJECT, "value").join(text, OBJECT, "left")
    return ids_by_version(scan.search(both.fillna("", ["value", "stream_text"]), needle, ["value", "stream_text"], regex=regex, ignore_case=True))


def javascript(objects: DataFrame, entries: DataFrame, streams: DataFrame) -> DataFrame:
    """(file_id, version, object_id, origin, code): scripts in /JS strings, in streams that /JS names, and in streams that look like one."""
    text = F.decode("decoded", "ISO-8859-1")
    strings = entries.where((F.col("key") == "/JS") & F.col("value_type").isin("string", "hexstring")).select(*OBJECT, F.lit("string").alias("origin"), F.expr("substring(value, 2, length(value) - 2)").alias("code"))
    named = entries.where((F.col("key") == "/JS") & (F.col("value_type") == "reference")).select("file_id", F.col("version"), c.reference_id(F.col("value")).alias("object_id")).distinct()
    referred = streams.join(named, OBJECT, "left_semi").select(*OBJECT, F.lit("referred").alias("origin"), text.alias("code"))
    others = streams.join(named, OBJECT, "left_anti").select(*OBJECT, F.lit("detected").alias("origin"), text.alias("code")).where(c.is_javascript(F.col("code")))
    code = F.coalesce(F.nullif(F.array_join(c.scripts_in(escapes.unescape_entities_col(F.col("code"))), "\n"), F.lit("")), F.col("code"))
    return strings.unionByName(referred).unionByName(others).withColumn("code", code)


def distinct_code(scripts: DataFrame) -> DataFrame:
    """Each code once per version, under the first object that has it."""
    return scripts.groupBy("file_id", "version", "code").agg(F.min("object_id").alias("object_id"))


def findings(objects: DataFrame, streams: DataFrame, scripts: DataFrame) -> DataFrame:
    """(file_id, version, object_id, category, token): marker rules on values, script rules on code, and two stream heuristics: an overlong SING table in a font, and the bitmap token too often."""
    values = [(k, t, b) for k, t, b, _, _ in known.rule_rows() if k != "js_vuln"]
    code = [(k, t, b) for k, t, b, _, _ in known.rule_rows() if k == "js_vuln"]
    plain = scan.marker_scan(objects.select(*OBJECT, "value"), values, content="value").drop("value")
    script = scan.marker_scan(scripts.select(*OBJECT, "code"), code, content="code").drop("code")
    token = F.when(c.sing_font(F.col("decoded")) & c.font_program(F.col("decoded")), F.lit(known.SING_FONT)).when(c.bmp_rle(F.decode("decoded", "ISO-8859-1"), known.BMP_RLE_TOKEN, known.BMP_RLE_MORE_THAN), F.lit(known.BMP_RLE))
    odd = streams.select(*OBJECT, F.lit("element").alias("category"), token.alias("token")).where("token is not null")
    return plain.unionByName(script).unionByName(odd).distinct()


def suspicious(found: DataFrame) -> DataFrame:
    """Ids per version, category and token."""
    return found.groupBy("file_id", "version", "category", "token").agg(F.array_sort(F.collect_set("object_id")).alias("ids"))


def changelog(objects: DataFrame, xref: DataFrame) -> DataFrame:
    """(file_id, version, object_id, change): added, modified, removed or incoherent.

    Added: the first version with the id. Removed: known before, absent from the
    body and listed free. Incoherent: in the body, but not listed as used, or free.
    """
    keys = ["file_id", "object_id"]
    change = versions.first_seen(objects.where("compressed_in is null"), keys, "version").select(*OBJECT, "change")
    first = objects.groupBy(*keys).agg(F.min("version").alias("since_"))
    freed = xref.where("kind = 'free'").select(*OBJECT).distinct()
    gone = freed.join(objects.select(*OBJECT).distinct(), OBJECT, "left_anti").join(first, keys).where("since_ < version").select(*OBJECT, F.lit("removed").alias("change"))
    used = xref.where("kind <> 'free'").select(*OBJECT)
    body = objects.where("compressed_in is null and dict_type <> '/XRef'").select(*OBJECT)
    wrong = versions.incoherent(body, used, freed, OBJECT).select(*OBJECT, F.lit("incoherent").alias("change"))
    return change.unionByName(gone).unionByName(wrong)


def physical_map(objects: DataFrame) -> DataFrame:
    """(file_id, version, object_id, start, stop): objects by place; compressed ones after their container's place."""
    outer = objects.where("compressed_in is null").select("file_id", "version", F.col("object_id").alias("compressed_in"), F.col("offset").alias("container_"))
    placed = objects.join(outer, ["file_id", "version", "compressed_in"], "left").withColumn("start", F.col("offset") + F.coalesce(F.col("container_") + 20, F.lit(0)))
    return placed.select(*OBJECT, "compressed_in", "start", (F.col("start") + F.col("size")).alias("stop"))


def references(edges: DataFrame, object_id: int) -> tuple[DataFrame, DataFrame]:
    """Edges from an object, and to it."""
    return edges.where(F.col("src_id") == object_id), edges.where(F.col("dst_id") == object_id)


def unresolved(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """References to what no version up to theirs holds."""
    first = objects.groupBy("file_id", F.col("object_id").alias("dst_id")).agg(F.min("version").alias("since_"))
    joined = edges.join(first, ["file_id", "dst_id"], "left")
    return joined.where(F.col("since_").isNull() | (F.col("since_") > F.col("version"))).drop("since_")


def tree(objects: DataFrame, edges: DataFrame, trailers: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """(file_id, node, depth, parent, label) of the newest objects, from each file's catalog; what it does not lead to has depth null."""
    key = lambda name: F.concat_ws("/", F.col("file_id").cast("string"), F.col(name).cast("string"))
    roots = trailers.where("root is not null").groupBy("file_id").agg(F.max_by("root", "version").alias("root")).select(key("root").alias("node"))
    current = versions.newest(edges.select("file_id", "src_id", "version", "dst_id"), ["file_id", "src_id", "dst_id"], "version")
    reached = graph.reach(current.select(key("src_id").alias("src"), key("dst_id").alias("dst")), roots, max_depth=max_depth)
    nodes = latest_objects(objects).select("file_id", "object_id", key("object_id").alias("node"), F.when(F.col("dict_type") != "", F.col("dict_type")).otherwise(F.col("obj_type")).alias("label"))
    joined = nodes.join(reached, "node", "left")
    return joined.select("file_id", F.col("object_id").alias("node"), "depth", F.substring_index("parent", "/", -1).cast("int").alias("parent"), "label")


def metadata(entries: DataFrame, trailers: DataFrame) -> DataFrame:
    """(file_id, version, key, value) of the information dictionary that each version's trailer names."""
    info = trailers.where("info is not null").select("file_id", "version", F.col("info").alias("object_id")).distinct()
    newest = entries.where("path = key").join(info.select("file_id", F.col("version").alias("of_"), "object_id"), ["file_id", "object_id"]).where("version <= of_")
    w = W.partitionBy("file_id", "of_", "key").orderBy(F.col("version").desc())
    ranked = newest.withColumn("n_", F.row_number().over(w)).where("n_ = 1")
    return ranked.select("file_id", F.col("of_").alias("version"), "key", F.expr("case when value_type in ('string', 'hexstring') then substring(value, 2, length(value) - 2) else value end").alias("value"))


def xmp_value(text: Column, tag: str) -> Column:
    """The first <tag>…</tag> of a metadata stream."""
    return F.nullif(F.regexp_extract(text, f"(?d)<{tag}>(.*)</{tag}>", 1), F.lit(""))


def version_counts(objects: DataFrame, streams: DataFrame) -> DataFrame:
    """Per file and version, and summed over versions (version null): objects, streams, encoded and faulty streams, compressed objects."""
    s = streams.select(*OBJECT, F.lit(1).alias("s_"), (F.size("filters") > 0).cast("int").alias("e_"), F.col("faulty").cast("int").alias("f_"))
    joined = objects.join(s, OBJECT, "left")
    rolled = joined.rollup("file_id", "version").agg(F.count(F.lit(1)).alias("objects"), *[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(n) for x, n in (("s_", "streams"), ("e_", "encoded"), ("f_", "faulty"))], F.count("compressed_in").alias("compressed"))
    return rolled.where("file_id is not null")


def report(files: DataFrame, objects: DataFrame, streams: DataFrame, found: DataFrame, *, form: str = "json") -> DataFrame:
    """(file_id, report): one JSON object, or XML element, per file, its versions and suspicious markers inside; booleans are booleans."""
    per_version = version_counts(objects, streams).where("version is not null")
    listed = per_version.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("version", "objects", "streams", "encoded", "faulty", "compressed"))).alias("versions"))
    marked = suspicious(found).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("version", "category", "token", "ids"))).alias("suspicious"))
    joined = files.join(listed, "file_id", "left").join(marked, "file_id", "left")
    whole = F.struct("size", "md5", "sha1", "sha256", "pdf_version", "binary", "linearized", "encrypted", "updates", "errors", "versions", "suspicious")
    return joined.select("file_id", (F.to_xml(whole, {"rowTag": "report"}) if form == "xml" else F.to_json(whole, {"ignoreNullFields": "false"})).alias("report"))


def object_stats(objects: DataFrame, edges: DataFrame, streams: DataFrame) -> DataFrame:
    """Per object: its hashes and kind, how many references it has, whether it is a stream, encoded or faulty, compressed."""
    refs = edges.groupBy("file_id", "version", F.col("src_id").alias("object_id")).agg(F.count(F.lit(1)).alias("refs"))
    s = streams.select(*OBJECT, F.lit(True).alias("stream"), (F.size("filters") > 0).alias("encoded"), F.col("faulty").alias("faulty_stream"))
    joined = objects.join(refs, OBJECT, "left").join(s, OBJECT, "left")
    flags = [F.coalesce(n, F.lit(False)).alias(n) for n in ("stream", "encoded", "faulty_stream")]
    return joined.select(*OBJECT, "obj_type", "dict_type", "size", "md5", "sha1", F.coalesce("refs", F.lit(0)).cast("long").alias("refs"), *flags, F.col("compressed_in").isNotNull().alias("compressed"), F.size("errors").alias("errors"))


def section_stats(xref: DataFrame, trailers: DataFrame) -> DataFrame:
    """Per version: entries of its cross-reference sections by kind, and what its trailer says."""
    counts = xref.groupBy("file_id", "version").agg(F.count(F.lit(1)).alias("entries"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("free", "used", "compressed")], F.count_if("in_stream").alias("from_stream"))
    said = trailers.groupBy("file_id", "version").agg(*[F.max(c).alias(c) for c in ("size", "prev", "startxref", "root", "info", "encrypted")])
    return counts.join(said, ["file_id", "version"], "full_outer")


def error_counts(df: DataFrame) -> DataFrame:
    """Each error text and how often it occurs, over files or objects."""
    return df.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def up_to_version(files: DataFrame, table: DataFrame, version: int) -> DataFrame:
    """(file_id, content): each file cut after a version; files with fewer are left out."""
    end = table.where(F.col("version") == version).select("file_id", (F.col("offset") + F.col("length")).cast("int").alias("end_"))
    return files.join(end, "file_id").select("file_id", F.expr("substring(content, 1, end_)").alias("content"))


def with_reputation(files: DataFrame, reputation: DataFrame) -> DataFrame:
    """Verdict counts of a user's table (md5, malicious, suspicious, undetected, harmless), and the share that is malicious."""
    total = F.col("malicious") + F.col("suspicious") + F.col("undetected") + F.col("harmless")
    return files.join(reputation, "md5", "left").withColumn("detection", F.when(total > 0, F.col("malicious") / total))


def lines(text: Column) -> Column:
    """array<string>, cut at CR LF, CR or LF."""
    return F.split(text, "\r\n|\r|\n")
