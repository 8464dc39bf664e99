"""PDF files as tables: one parse per file in an Arrow batch, plain rows after that."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import scratch
from docquarry.codecs import filters
from docquarry.session import slices
from docquarry.sources import pdf_syntax, pdf_writer

#: Files of a folder that one task of the data source reads.
FILES = 64

SCHEMAS = {
    "files": "file_id long, size long, md5 string, sha1 string, sha256 string, pdf_version string, header_offset long, binary boolean, linearized boolean, encrypted boolean, updates int, errors array<string>",
    "versions": "file_id long, version int, offset long, length long",
    "objects": "file_id long, version int, object_id int, gen int, offset long, size long, obj_type string, dict_type string, value string, md5 string, sha1 string, compressed_in int, errors array<string>",
    "dict_entries": "file_id long, version int, object_id int, path string, key string, value_type string, value string",
    "streams": "file_id long, version int, object_id int, raw binary, decoded binary, filters array<string>, declared_length long, real_length long, faulty boolean, text string",
    "edges": "file_id long, version int, src_id int, ord int, dst_id int, dst_gen int, origin string",
    "xref_entries": "file_id long, version int, object_id int, kind string, offset long, gen int, in_stream boolean",
    "trailers": "file_id long, version int, in_stream boolean, size long, prev long, startxref long, root int, info int, encrypted boolean",
    "uris": "file_id long, version int, object_id int, uri string",
}


def _rows(table: str, file_id: int, f: pdf_syntax.File) -> Iterator[tuple]:
    if table == "files":
        yield file_id, f.size, f.md5, f.sha1, f.sha256, f.pdf_version, f.header_offset, f.binary, f.linearized, f.encrypted, len(f.versions) - 1, f.errors
    elif table == "versions":
        yield from ((file_id, *v) for v in f.versions)
    elif table == "xref_entries":
        yield from ((file_id, *x) for x in f.xref)
    elif table == "trailers":
        for version, in_stream, e, start in f.trailers:
            number = lambda k: e[k][1] if k in e and e[k][0] == "integer" else None  # noqa: B023, E731
            target = lambda k: e[k][1][0] if k in e and e[k][0] == "reference" else None  # noqa: B023, E731
            yield file_id, version, in_stream, number("/Size"), number("/Prev"), start, target("/Root"), target("/Info"), "/Encrypt" in e
    for o in f.objects:
        if table == "objects":
            import hashlib

            value = pdf_syntax.text_of(o.value)
            data = value.encode("latin-1", "replace")
            yield file_id, o.version, o.object_id, o.gen, o.offset, o.size, o.kind, o.dict_type, value, hashlib.md5(data).hexdigest(), hashlib.sha1(data).hexdigest(), o.compressed_in, o.errors
        elif table == "dict_entries":
            yield from ((file_id, o.version, o.object_id, path, k, v[0], pdf_syntax.text_of(v)) for path, k, v in _entries(o.value))
        elif table == "streams" and o.stream is not None:
            declared = o.entries.get("/Length", ("null", None))
            decoded = o.decoded if o.decoded is not None else b""
            yield file_id, o.version, o.object_id, o.stream, decoded, o.filters, declared[1] if declared[0] == "integer" else None, len(o.stream), bool(o.errors), pdf_syntax.page_text(decoded)
        elif table == "edges":
            yield from ((file_id, o.version, o.object_id, n, a, b, origin) for n, a, b, origin in pdf_syntax.edges(o))
        elif table == "uris":
            yield from ((file_id, o.version, o.object_id, u) for u in _uris(o.value))


def _entries(value, path: str = "", depth: int = 0) -> Iterator[tuple]:
    """(path, key, value) of a value's dictionaries, inner ones too; array places are numbers in the path."""
    if value is None or depth > pdf_syntax.DEPTH:
        return
    kind, inner = value
    if kind == "dictionary":
        for k, v in inner.items():
            yield path + k, k, v
            yield from _entries(v, path + k, depth + 1)
    elif kind == "array":
        for i, v in enumerate(inner):
            yield from _entries(v, f"{path}/{i}", depth + 1)


def _uris(value, depth: int = 0) -> Iterator[str]:
    if value is None or depth > pdf_syntax.DEPTH:
        return
    kind, inner = value
    if kind == "dictionary":
        if "/URI" in inner and inner["/URI"][0] in ("string", "hexstring"):
            yield inner["/URI"][1].decode("latin-1")
        for x in inner.values():
            yield from _uris(x, depth + 1)
    elif kind == "array":
        for x in inner:
            yield from _uris(x, depth + 1)


#: Tables that need no stream decoded but those that hold a file's structure.
_STRUCTURE = {"files", "versions", "dict_entries", "xref_entries", "trailers", "uris"}
#: Rows of a table, and bytes of streams, that are handed on together.
_ROWS, _BYTES = 2000, 8 << 20
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _names(table: str) -> list[str]:
    return [c.split(" ")[0] for c in SCHEMAS[table].split(", ")]


def _array(values: tuple, kind: str) -> pa.Array:
    """Numbers of a damaged file may be too wide: an int keeps its low bits, a long is null."""
    try:
        return pa.array(values, _TYPES[kind])
    except (OverflowError, pa.ArrowInvalid):
        if kind == "int":
            values = [None if v is None else (v + (1 << 31)) % (1 << 32) - (1 << 31) for v in values]
        elif kind == "long":
            values = [v if v is None or -(1 << 63) <= v < 1 << 63 else None for v in values]
        else:
            raise
        return pa.array(values, _TYPES[kind])


def _batch(table: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [c.split(" ")[1] for c in SCHEMAS[table].split(", ")]
    return pa.RecordBatch.from_arrays([_array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], _names(table))


def _bytes_of(table: str, row: tuple) -> int:
    """Of a stream's three forms; other rows are small, or bounded by their file."""
    return len(row[3]) + len(row[4]) + len(row[9]) if table == "streams" else 0


def _parts(batches: Iterator[pa.RecordBatch], tables: tuple[str, ...], how: dict) -> Iterator[tuple[str, list[tuple]]]:
    """(table, rows) of the files of Arrow batches, at most some _ROWS or _BYTES at once."""
    how = how | {"decode": not _STRUCTURE.issuperset(tables)}
    rows, count, held = {t: [] for t in tables}, 0, 0
    for part in slices(batches):
        whole = part.filter(part.column(1).is_valid())
        for file_id, f in zip(whole.column(0).to_pylist(), pdf_syntax.parse_many(whole.column(1).to_pylist(), **how), strict=True):
            held += f.size
            for t in tables:
                for row in _rows(t, file_id, f):
                    rows[t].append(row)
                    count += 1
                    held += _bytes_of(t, row)
                    if count >= _ROWS or held >= _BYTES:
                        yield from ((k, v) for k, v in rows.items() if v)
                        rows, count, held = {k: [] for k in tables}, 0, 0
    yield from ((k, v) for k, v in rows.items() if v)


def _contents(files: DataFrame) -> DataFrame:
    return files.select(F.col("file_id").cast("long").alias("file_id"), F.col("content").cast("binary").alias("content"))


def parsed(files: DataFrame, table: str, *, strict: bool = False, loose: bool = False, password: bytes = b"", limit: int = filters.LIMIT) -> DataFrame:
    """files (file_id long, content binary) to one of the tables in SCHEMAS.

    A file that cannot be read is a row with errors, never a failed job, unless
    strict. A null content gives no rows. Rows go on as they come, not a batch of
    files at once; streams are decoded for the tables that show them only.
    """

    how = {"strict": strict, "loose": loose, "password": password, "limit": limit}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _parts(batches, (table,), how):
            yield _batch(table, rows)

    return _contents(files).mapInArrow(run, SCHEMAS[table])


def parsed_tables(files: DataFrame, tables: tuple[str, ...], *, strict: bool = False, loose: bool = False, password: bytes = b"", limit: int = filters.LIMIT) -> dict[str, DataFrame]:
    """Several tables of SCHEMAS from one parse of each file, written to the shared folder, a part for each table.

    A row holds its table's name and that table's columns in a struct of its own,
    so a reader of one table opens that table's files and columns only.
    """
    schema = "table string, " + ", ".join(f"{t} struct<{', '.join(c.replace(' ', ': ', 1) for c in SCHEMAS[t].split(', '))}>" for t in tables)
    how = {"strict": strict, "loose": loose, "password": password, "limit": limit}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = {t: pa.struct([(n, _TYPES[c.split(" ")[1]]) for n, c in zip(_names(t), SCHEMAS[t].split(", "), strict=True)]) for t in tables}
        for table, rows in _parts(batches, tables, how):
            own = _batch(table, rows).to_struct_array()
            yield pa.RecordBatch.from_arrays([pa.array([table] * len(rows)), *[own if t == table else pa.nulls(len(rows), shape[t]) for t in tables]], ["table", *tables])

    kept = scratch.keep(_contents(files).mapInArrow(run, schema), "parsed", partition_by="table")
    return {t: kept.where(F.col("table") == t).select(f"{t}.*") for t in tables}


def read_files(spark: SparkSession, path: str, *, glob: str = "*.pdf") -> DataFrame:
    """(file_id, path, content) of a folder; file_id is a hash of the path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select(F.xxhash64("path").alias("file_id"), "path", "content")


def generated(df: DataFrame, *, file_id: str, payload: str, uri: Column, title: Column, password: bytes | None = None, cipher: str = "rc4", compressed: bool = False, script: Column | None = None) -> DataFrame:
    """(file_id, content): one PDF per row, filters by id modulo 4; each fifth has an update that redefines the stream. A password encrypts.

    compressed puts the objects into an object stream, with a cross-reference stream
    and no update; script adds one that the catalog opens.
    """
    def made(rows: list[tuple]) -> list[bytes]:
        if compressed:
            return [pdf_writer.build_compressed((b or "").encode(), chain=list(pdf_writer.CHAINS[k % 4]), uri=x or "", title=y or "") for k, b, x, y, _ in rows]
        return pdf_writer.build_many([{"payload": (data := (b or "").encode()), "chain": list(pdf_writer.CHAINS[k % 4]), "uri": x or "", "title": y or "", "update": b"updated " + data if k % 5 == 0 else None, "password": password, "cipher": cipher, "script": None if code is None else code.encode()} for k, b, x, y, code in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = list(zip(*[c.to_pylist() for c in part.columns], strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made(rows), pa.binary())], ["file_id", "content"])

    code = script if script is not None else F.lit(None)
    inputs = df.select(F.col(file_id).cast("long").alias("file_id"), F.col(payload).cast("string").alias("payload"), uri.cast("string").alias("uri"), title.cast("string").alias("title"), code.cast("string").alias("script"))
    return inputs.mapInArrow(run, "file_id long, content binary")


def register(spark: SparkSession) -> None:
    """Make spark.read.format("pdf_tables") known: option table, and path of a folder of PDF files that driver and workers mount alike.

    For other stores and for large collections use read_files() and parsed(), which list and read by Spark.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(_source())


def _source():
    from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.table, self.path, self.version = options.get("table", "objects"), options["path"], None

        def pushFilters(self, filters_):
            for f in filters_:
                if isinstance(f, EqualTo) and f.attribute == ("version",):
                    self.version = f.value
                yield f  # Spark checks them again

        def partitions(self):
            import os

            found = sorted(os.path.join(d, n) for d, _, names in os.walk(os.path.abspath(self.path)) for n in names if n.endswith(".pdf"))
            return [InputPartition(found[i : i + FILES]) for i in range(0, len(found), FILES)]

        def read(self, partition):
            import xxhash

            names = _names(self.table)
            for path in partition.value:
                with open(path, "rb") as f:
                    data = f.read()
                number = xxhash.xxh64_intdigest(f"file:{path}", 42)  # as read_files() has it
                for row in _rows(self.table, number - (number >> 63 << 64), pdf_syntax.parse(data, decode=self.table not in _STRUCTURE)):
                    if self.version is None or "version" not in names or row[names.index("version")] == self.version:
                        yield row

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "pdf_tables"

        def schema(self):
            return SCHEMAS[self.options.get("table", "objects")]

        def reader(self, schema):
            return Reader(self.options)

    return Source
