"""The parser against the writer, damaged files, and encryption."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.sources import pdf, pdf_crypto, pdf_syntax, pdf_writer


def small(**more):
    return pdf_writer.build(b"BT (Hi \\(you\\)) Tj ET", chain=["FlateDecode"], uri="http://example.org/(x)", title="T", **more)


def test_round_trip():
    f = pdf_syntax.parse(small(update=b"second"))
    assert (f.pdf_version, f.binary, f.errors, len(f.versions)) == ("1.4", True, [], 2)
    assert [o.object_id for o in f.objects] == [1, 2, 3, 4, 5, 6, 4]
    assert f.objects[3].decoded == b"BT (Hi \\(you\\)) Tj ET" and f.objects[6].decoded == b"second"
    assert pdf_syntax.page_text(f.objects[3].decoded) == "Hi (you)"
    assert [e[:2] for e in pdf_syntax.edges(f.objects[2])] == [(0, 2), (1, 4), (2, 6)]
    assert len(f.xref) == 8 and len(f.trailers) == 2 and f.trailers[0][3] is not None


def test_offsets_are_those_of_the_file():
    data = small(update=b"x")
    for o in pdf_syntax.parse(data).objects:
        assert data[o.offset : o.offset + o.size].startswith(b"%d 0 obj" % o.object_id)


@pytest.mark.parametrize(("old", "new", "fault"), [(b"endobj\n5", b"\n5", "endobj missing"), (b"/Length", b"/Lengxh", None), (b"/FlateDecode", b"/FlateDecodX", "not supported")])
def test_damage_is_reported(old, new, fault):
    f = pdf_syntax.parse(small().replace(old, new, 1))
    errors = [e for o in f.objects for e in o.errors]
    assert (any(fault in e for e in errors)) if fault else f.objects[3].decoded.startswith(b"BT")


def test_garbage_before_the_header():
    f = pdf_syntax.parse(b"junk\n" + small())
    assert f.header_offset == 5 and len(f.objects) == 6


def test_noise_never_raises():
    rng, data = random.Random(1), small(update=b"x")
    for _ in range(300):
        noisy = bytearray(data)
        for _ in range(rng.randint(1, 20)):
            noisy[rng.randrange(len(noisy))] = rng.randrange(256)
        pdf_syntax.parse(bytes(noisy[: rng.randint(1, len(noisy))]))
    with pytest.raises(pdf_syntax.PdfError):
        pdf_syntax.parse(b"nothing", strict=True)


def test_deep_nesting_is_an_error_not_a_crash():
    assert pdf_syntax.parse(b"%PDF-1.4\n1 0 obj " + b"[" * 5000 + b"]" * 5000 + b" endobj\n%%EOF").objects[0].errors


def test_object_and_reference_streams():
    inner = b"10 0 11 5 (ab) << /K 10 0 R >>"
    stream = b"<< /Type /ObjStm /N 2 /First 10 /Length %d >>\nstream\n" % len(inner) + inner + b"\nendstream"
    table = bytes([1, 0, 9, 0, 2, 0, 1, 1, 0, 0, 0, 0])
    xref = b"<< /Type /XRef /W [ 1 2 1 ] /Index [ 1 2 7 1 ] /Size 12 /Root 1 0 R /Length 12 >>\nstream\n" + table + b"\nendstream"
    f = pdf_syntax.parse(b"%PDF-1.5\n1 0 obj\n" + stream + b"\nendobj\n2 0 obj\n" + xref + b"\nendobj\nstartxref\n9\n%%EOF\n")
    assert {(o.object_id, o.compressed_in, o.kind) for o in f.objects} >= {(10, 1, "string"), (11, 1, "dictionary")}
    assert [(x[1], x[2]) for x in f.xref] == [(1, "used"), (2, "compressed"), (7, "free")]


def test_aes_known_answer():
    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert pdf_crypto.aes_cbc_encrypt(plain, key, bytes(16), pad=False).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    for n in (0, 5, 16, 40):
        for size in (16, 32):
            k = bytes(range(size))
            assert pdf_crypto.aes_cbc_decrypt(pdf_crypto.aes_cbc_encrypt(bytes(n), k, key), k, key) == bytes(n)


def test_many_texts_are_encrypted_side_by_side():
    import time

    rng = random.Random(2)
    for count in (1, 7, 8, 40):
        jobs = [(rng.randbytes(rng.choice([0, 1, 15, 16, 300])), rng.randbytes(16), rng.randbytes(16)) for _ in range(count)]
        made = pdf_crypto.aes_cbc_encrypt_many(jobs)
        assert made == [pdf_crypto.aes_cbc_encrypt(*j) for j in jobs]
        assert [pdf_crypto.aes_cbc_decrypt(m, k, iv) for m, (_, k, iv) in zip(made, jobs)] == [j[0] for j in jobs]
    files = [{"payload": rng.randbytes(4000), "chain": [], "uri": "u", "title": "t", "password": b"p", "cipher": c} for c in ["aes"] * 200 + ["rc4"] * 9]
    start = time.process_time()
    made = pdf_writer.build_many(files)
    assert time.process_time() - start < 3  # one block after the other took 137 microseconds each, 7 s in all
    for f, data in zip(files, pdf_syntax.parse_many(made, password=b"owner")):
        assert data.objects[3].decoded == f["payload"] and not data.errors


def test_user_entries_side_by_side():
    rng = random.Random(3)
    asked = [(rng.randbytes(n), rng.randbytes(16), 3) for n in [16] * 12 + [5] * 12 + [7] * 2] + [(rng.randbytes(5), b"", 2)]
    assert pdf_crypto.user_entries(asked) == {x: pdf_crypto.user_entry(*x) for x in asked}


def test_key_without_length_is_an_error():
    data = small(password=b"x").replace(b"/Length 128 /P", b"/Length 0 /P")
    assert any("not supported" in e for e in pdf_syntax.parse(data, password=b"x").errors)


def test_rc4_known_answer():
    assert pdf_crypto.rc4(b"Plaintext", b"Key").hex().upper() == "BBF316E8D940AF0AD3"


@pytest.mark.parametrize(("v", "r", "method", "length"), [(1, 2, "V2", 5), (2, 3, "V2", 16), (4, 4, "AESV2", 16)])
@pytest.mark.parametrize("with_owner", [False, True])
def test_decryption(v, r, method, length, with_owner):
    user, owner, file_id = b"secret", b"boss", b"0123456789abcdef"
    o = pdf_crypto.owner_entry(owner, user, r, length)
    key = pdf_crypto.file_key(user, o, -4, file_id, r, length)
    u = pdf_crypto.user_entry(key, file_id, r)
    body = b"the plain text of a stream"
    k = pdf_crypto.object_key(key, 4, 0, method == "AESV2")
    data = bytes(16) + pdf_crypto.aes_cbc_encrypt(body, k, bytes(16)) if method == "AESV2" else pdf_crypto.rc4(body, k)
    cf = "/CF << /StdCF << /CFM /AESV2 /Length 16 >> >> /StmF /StdCF /StrF /StdCF" if v == 4 else ""
    text = f"%PDF-1.6\n4 0 obj\n<< /Length {len(data)} >>\nstream\n".encode() + data + f"\nendstream\nendobj\ntrailer\n<< /ID [ <{file_id.hex()}> <00> ] /Encrypt << /Filter /Standard /V {v} /R {r} /Length {8 * length} /P -4 {cf} /O <{o.hex()}> /U <{u.hex()}> >> >>\nstartxref\n0\n%%EOF\n".encode()
    f = pdf_syntax.parse(text, password=owner if with_owner else user)
    assert f.encrypted and not f.errors and f.objects[0].decoded == body
    assert "password does not fit" in pdf_syntax.parse(text, password=b"wrong").errors


def test_tables(spark):
    rows = [(1, bytearray(small(update=b"x"))), (2, bytearray(b"broken")), (3, None)]
    files = spark.createDataFrame(rows, "file_id long, content binary")
    found = {r.file_id: r for r in pdf.parsed(files, "files").collect()}
    assert found[1].updates == 1 and found[2].errors and 3 not in found
    for table in pdf.SCHEMAS:
        assert pdf.parsed(files, table).columns == [c.split(" ")[0] for c in pdf.SCHEMAS[table].split(", ")]
        pdf.parsed(files, table).count()
    newest = pdf.parsed(files, "streams").groupBy("file_id").agg(F.max_by("decoded", "version").alias("d")).collect()
    assert bytes(newest[0].d) == b"x"


def test_reader_of_a_folder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(small())
    pdf.register(spark)
    assert spark.read.format("pdf_tables").option("path", str(tmp_path)).option("table", "objects").load().where("version = 0").count() == 6
    assert pdf.parsed(pdf.read_files(spark, str(tmp_path)), "objects").count() == 6


def test_folder_as_a_stream(spark, tmp_path):
    from docquarry.streaming import dropfolder

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(small())
    for more in (0, 1):
        if more:
            (tmp_path / "in" / "b.pdf").write_bytes(small(update=b"x"))
        dropfolder.into_tables(dropfolder.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), checkpoint=str(tmp_path / "c")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out" / "files")).count() == 1 + more


def test_scripts_and_findings(spark):
    from docquarry.operators import analysis

    body = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /OpenAction << /S /JavaScript /JS 2 0 R >> >>\nendobj\n"
    code = b"<script>var a = util.printf; function f(x) { return eval(x); } f(a);</script>"
    body += b"2 0 obj\n<< /Length %d >>\nstream\n" % len(code) + code + b"\nendstream\nendobj\n3 0 obj\n<< /JS (app.alert\\(getIcon\\)) >>\nendobj\ntrailer\n<< /Root 1 0 R >>\nstartxref\n0\n%%EOF\n"
    files = spark.createDataFrame([(1, bytearray(body))], "file_id long, content binary")
    t = {n: pdf.parsed(files, n) for n in pdf.SCHEMAS}
    scripts = analysis.javascript(t["objects"], t["dict_entries"], t["streams"])
    assert {(r.object_id, r.origin) for r in scripts.collect()} == {(2, "referred"), (3, "string")}
    found = analysis.findings(t["objects"], t["streams"], scripts)
    assert {(r.object_id, r.token) for r in found.collect()} == {(1, "/OpenAction"), (1, "/JavaScript"), (1, "/JS"), (2, "util.printf"), (3, "/JS"), (3, "getIcon")}
    text = analysis.report(t["files"], t["objects"], t["streams"], found).first().report
    assert '"encrypted":false' in text and '"util.printf"' in text
    assert {r.object_id for r in analysis.changelog(t["objects"], t["xref_entries"]).where("change = 'incoherent'").collect()} == {1, 2, 3}
    assert analysis.unresolved(t["edges"], t["objects"]).count() == 0
    assert analysis.error_counts(t["objects"]).count() == 0
    places = analysis.physical_map(t["objects"]).collect()
    assert all(body[r.start : r.stop].endswith(b"endobj") for r in places)
    verdicts = spark.createDataFrame([(t["files"].first().md5, 3, 1, 4, 0)], "md5 string, malicious int, suspicious int, undetected int, harmless int")
    assert analysis.with_reputation(t["files"], verdicts).first().detection == 3 / 8


def test_encrypted_round_trip():
    data = small(update=b"second", password=b"p")
    assert b"Hi" not in data and b"example" not in data
    f = pdf_syntax.parse(data, password=b"p")
    assert f.encrypted and not f.errors
    assert [o.decoded for o in f.objects if o.stream is not None] == [b"BT (Hi \\(you\\)) Tj ET", b"second"]
    assert [u for o in f.objects for u in pdf._uris(o.value)] == ["http://example.org/(x)"]
    assert pdf_syntax.parse(data, password=b"owner").objects[3].decoded.startswith(b"BT")
    assert "password does not fit" in pdf_syntax.parse(data).errors


def locked(*, metadata: bool, strings: str = "/StdCF") -> bytes:
    """A file encrypted by AES with one metadata stream, one stream of its own Crypt filter, and a string."""
    from docquarry.sources import pdf_crypto as pc

    file_id = b"0123456789abcdef"
    owner = pc.owner_entry(b"o", b"u", 4, 16)
    key = pc.file_key(b"u", owner, -4, file_id, 4, 16, metadata)
    hide = lambda n, data: bytes(16) + pc.aes_cbc_encrypt(data, pc.object_key(key, n, 0, True), bytes(16))
    stream = lambda entries, data: f"<< {entries} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"
    secret = hide(4, b"title") if strings == "/StdCF" else b"title"
    bodies = {
        1: b"<< /Type /Catalog >>",
        2: stream("/Type /Metadata", b"<x/>" if not metadata else hide(2, b"<x/>")),
        3: stream("/Filter [ /Crypt ] /DecodeParms [ << /Name /Identity >> ]", b"as it is"),
        4: f"<< /Title <{secret.hex()}> >>".encode(),
        5: stream("", hide(5, b"hidden")),
        6: f"<< /Filter /Standard /V 4 /R 4 /Length 128 /CF << /StdCF << /CFM /AESV2 >> >> /StmF /StdCF /StrF {strings} /EncryptMetadata {str(metadata).lower()} /P -4 /O <{owner.hex()}> /U <{pc.user_entry(key, file_id, 4).hex()}> >>".encode(),
    }
    out = b"%PDF-1.5\n" + b"".join(f"{n} 0 obj\n".encode() + b + b"\nendobj\n" for n, b in bodies.items())
    return out + f"trailer\n<< /Root 1 0 R /Info 4 0 R /Encrypt 6 0 R /ID [ <{file_id.hex()}> <{file_id.hex()}> ] >>\nstartxref\n0\n%%EOF\n".encode()


@pytest.mark.parametrize("metadata", [True, False])
@pytest.mark.parametrize("strings", ["/StdCF", "/Identity"])
def test_what_encryption_leaves_plain(metadata, strings):
    f = pdf_syntax.parse(locked(metadata=metadata, strings=strings), password=b"u")
    assert not f.errors
    by_id = {o.object_id: o for o in f.objects}
    assert [by_id[n].decoded for n in (2, 3, 5)] == [b"<x/>", b"as it is", b"hidden"]
    assert by_id[4].entries["/Title"][1] == b"title"


def test_compressed_files_read_like_plain_ones():
    made = pdf_writer.build_compressed(b"BT (x) Tj ET", chain=["FlateDecode"], uri="http://example.org/", title="t")
    f = pdf_syntax.parse(made)
    plain = pdf_syntax.parse(small())
    assert not f.errors and not [o for o in f.objects if o.errors]
    assert {o.object_id: o.kind for o in f.objects if o.object_id < 7} == {o.object_id: o.kind for o in plain.objects}
    assert len(pdf_syntax.parse(made, decode=False).objects) == len(f.objects)
    assert all(made[at:].startswith(f"{n} 0 obj".encode()) for _, n, kind, at, _, _ in f.xref if kind == "used")


def test_tables_of_one_parse_are_those_of_each(spark):
    rows = [(i, bytearray(small(update=b"x" if i % 2 else None))) for i in range(5)] + [(9, bytearray(b"no pdf")), (10, None)]
    files = spark.createDataFrame(rows, "file_id long, content binary").repartition(2)
    for name, table in pdf.parsed_tables(files, tuple(pdf.SCHEMAS)).items():
        one = pdf.parsed(files, name)
        assert [(f.name, f.dataType) for f in table.schema] == [(f.name, f.dataType) for f in one.schema]
        assert sorted(map(str, table.collect())) == sorted(map(str, one.collect())), name


def test_files_and_events_of_a_stream(spark, tmp_path):
    from docquarry.streaming import dropfolder

    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.pdf").write_bytes(small())
    (tmp_path / "in" / "c.pdf").write_bytes(small(update=b"x"))
    seen = dropfolder.first_seen(dropfolder.arriving(spark, str(tmp_path / "in"))).select("sha256")
    seen.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("seen").count() == 2
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 05:00:00", "a"), ("2024-01-02 01:00:00", "b")], "t string, event_type string").selectExpr("cast(t as timestamp) ts", "event_type")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    dropfolder.event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((str(r.start.date()), r.event_type, r.n) for r in spark.table("counts").collect()) == [("2024-01-01", "a", 2), ("2024-01-02", "b", 1)]


def test_only_fonts_have_a_sing_table(spark):
    """Prose with these four letters at byte 236 is no font; fonts of each kind are marked."""
    from docquarry.operators import analysis

    body = b"SING" + b"y" * 100
    streams = [b"x" * 236 + body, *[(head + b"x" * 236)[:236] + body for head in (b"\x00\x01\x00\x00", b"OTTO", b"true", b"ttcf")]]
    rows = [(i, bytearray(pdf_writer.build(s, chain=["FlateDecode"], uri="u"))) for i, s in enumerate(streams)]
    t = pdf.parsed_tables(spark.createDataFrame(rows, "file_id long, content binary"), ("objects", "dict_entries", "streams"))
    found = analysis.findings(t["objects"], t["streams"], analysis.javascript(t["objects"], t["dict_entries"], t["streams"]))
    assert sorted((r.file_id, r.object_id, r.token) for r in found.collect()) == [(i, 4, "CoolType.SING.uniqueName") for i in (1, 2, 3, 4)]


def test_objects_without_ends_take_time_in_proportion():
    import time

    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n<< /Type /Page /Contents 4 0 R /Box [ 0 0 9 ] >>\n" % i for i in range(1, 40001)) + b"%%EOF\n"
    start = time.process_time()
    f = pdf_syntax.parse(data)
    assert len(f.objects) == 40000 and f.objects[-1].entries["/Contents"] == ("reference", (4, 0))
    assert time.process_time() - start < 4  # each object searched the rest of the file for an end


def test_tables_are_handed_on_by_what_they_hold():
    """Streams that decode to far more than their files do not pile up."""
    import pyarrow as pa

    files = [pdf_writer.build(bytes([i]) * (1 << 20), chain=["FlateDecode"], uri="u") for i in range(40)]
    batch = pa.record_batch([pa.array([*range(40), 99]), pa.array([*files, None], pa.binary())], ["file_id", "content"])
    parts = list(pdf._parts(iter([batch]), ("objects", "streams"), {}))
    assert max(sum(pdf._bytes_of(t, r) for r in rows) for t, rows in parts) <= pdf._BYTES + (2 << 20)
    assert sorted(r[0] for t, rows in parts if t == "streams" for r in rows) == list(range(40))
    assert sum(len(rows) for t, rows in parts if t == "objects") == 240


def test_numbers_too_wide_fail_no_job(spark):
    body = b"%PDF-1.4\n9999999999 0 obj\n<< /A 1 >>\nendobj\ntrailer\n<< /Size 99999999999999999999 /Root 1 0 R >>\nstartxref\n0\n%%EOF\n"
    files = spark.createDataFrame([(1, bytearray(body))], "file_id long, content binary")
    assert pdf.parsed(files, "trailers").first()["size"] is None
    assert pdf.parsed(files, "objects").first()["object_id"] == 9999999999 - (2 << 32)
