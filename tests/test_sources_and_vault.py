import base64
import datetime as dt
import hashlib
import hmac
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.recovery import critique_of, findings_of, json_of
from palimpsest.operators import vault as V
from palimpsest.sources import prompts
from palimpsest.plans.describe import described, described_prompts
from palimpsest.plans.sanitise import Settings
from palimpsest.sources.files import NO_CAPS, Caps, converted, documents, read_files
from palimpsest.sources.ingest import NOT_SET, NOTHING, ingested
from palimpsest.sources.vision import read_by, with_pages
from palimpsest.streaming import streams

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "a.txt").write_text("  héllo \n", encoding="utf-8")
    (d / "long.log").write_text("x" * 400_005)
    (d / "latin.csv").write_bytes("café,1".encode("latin-1") + b"\n")
    (d / "blank.md").write_text(" \n\n")
    (d / "x.exe").write_bytes(b"MZ")
    (d / "raw").write_bytes(bytes(range(256)) * 8)
    (d / "i.png").write_bytes(b"\x89PNG\r\n\x1a\n\0")
    (d / "broken.docx").write_bytes(b"PK\x03\x04\0\0")
    (d / "fake.pdf").write_bytes(b"%PDF-1.4\nplain words")
    with zipfile.ZipFile(d / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body><w:p><w:r><w:t>Hi </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    with zipfile.ZipFile(d / "o.odt", "w") as z:
        z.writestr("content.xml", "<a><b>one</b> <c>two</c></a>")
    return str(d)


def test_files(spark, folder):
    files, rejects = read_files(spark, folder)
    assert [r.reason for r in rejects.collect()] == ["suffix not allowed"]
    got = {r.filename: r for r in converted(files).collect()}
    assert got["a.txt"].text == "héllo" and got["a.txt"].extraction_method == "plain_text" and got["a.txt"].char_count == 5
    assert len(got["long.log"].text) == 400_000 and got["long.log"].warnings == ["text truncated to 400000 characters"]
    assert "café" in got["latin.csv"].text or got["latin.csv"].error is None
    assert "empty or blank" in got["blank.md"].error and got["raw"].error == "unsupported file type" and got["broken.docx"].error.startswith("BadZipFile")
    assert got["i.png"].kind == "image" and got["i.png"].extraction_method == "mock"
    assert got["d.docx"].text == "Hi there\na | b" and got["o.odt"].text == "one two"
    assert got["fake.pdf"].kind == "text"
    ids = [r.doc_id for r in documents(spark, folder).select("doc_id").collect()]
    assert len(set(ids)) == len(ids)


def test_size_cap(spark, folder):
    files, rejects = read_files(spark, folder, max_bytes=100)
    assert "too large" in {r.reason for r in rejects.collect()} and files.where("length > 100").count() == 0


def test_caps_can_be_lifted(spark, folder, tmp_path):
    rows = "".join(f'<table:table-row><table:table-cell><text:p>{k}</text:p></table:table-cell></table:table-row>' for k in range(302))
    with zipfile.ZipFile(tmp_path / "s.ods", "w") as z:
        z.writestr("content.xml", f'<x xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><table:table table:name="T">{rows}</table:table></x>')
    with zipfile.ZipFile(tmp_path / "many.odt", "w") as z:
        for k in range(50):
            z.writestr(f"p{k:02}.xml", f"<a>part{k}</a>")
    (tmp_path / "long.log").write_text("x" * 400_005)
    read = lambda caps: {r.filename: r for r in converted(read_files(spark, str(tmp_path))[0], caps).collect()}
    usual, whole, tiny = read(Caps()), read(NO_CAPS), read(Caps(text_chars=7, office_parts=1, sheet_rows=1))
    assert "first 200 rows" in usual["s.ods"].text and "| 301" not in usual["s.ods"].text and "part49" not in usual["many.odt"].text
    assert "preview" not in whole["s.ods"].text and "| 301" in whole["s.ods"].text and "part49" in whole["many.odt"].text
    assert whole["long.log"].char_count == 400_005 and whole["long.log"].warnings == []
    assert tiny["long.log"].text == "x" * 7 and tiny["many.odt"].text == "part0" and "first 1 rows" in tiny["s.ods"].text


def test_pages_and_their_reader(spark):
    def model(pages):
        return [image.decode() for _, image in pages][: 1 if pages[0][1] == b"short" else None]

    def render(raw, kind):
        if kind == "bad":
            raise OSError("no")
        return [raw] * 20

    rows = spark.createDataFrame([(1, bytearray(b" a "), "image"), (2, bytearray(b"b"), "text"), (3, None, "image"), (4, bytearray(b"short"), None)], "id int, content binary, kind string")
    plain = {r.id: r for r in read_by(with_pages(rows), model).collect()}
    assert plain[1].seen == ["a"] and plain[1].page_images == 1 and [plain[k].seen for k in (2, 3, 4)] == [[], [], []]
    all_pages = {r.id: r for r in read_by(with_pages(rows.withColumn("kind", F.when(F.col("id") == 2, "bad").otherwise("pdf")), render), model, retries=0).collect()}
    assert all_pages[1].seen == ["a"] * 15 and all_pages[2].page_images == 0
    assert all_pages[4].seen is None and all_pages[4].why == "1 answers for 15 pages"
    assert with_pages(rows, render, NO_CAPS).first().page_images == 20
    assert read_by(with_pages(rows.where("false")), model).collect() == []


def test_description(tmp_path):
    (tmp_path / "a.md").write_text("---\nversion: 3\n---\n## System\n" + "s" * 300)
    assert described_prompts(str(tmp_path)) == {"a": {"version": "3", "system_preview": "s" * 240}}
    prompts.reload()
    told = described(Settings(salt="hush", max_rounds=9))
    assert "hush" not in str(told) and told["stages"][2]["max_rounds"] == 6


def test_tokens(spark):
    key, other = V.generate_key(), V.generate_key()
    df = V.encrypted(spark.createDataFrame([(1, "é"), (2, None), (3, "")], "i int, t string"), "t", key)
    df = spark.createDataFrame(df.collect(), df.schema)
    got = {r.i: (r.a, r.b) for r in df.select("i", V.decrypted(F.col("t"), key).cast("string").alias("a"), V.decrypted(F.col("t"), other).alias("b")).collect()}
    assert got == {1: ("é", None), 2: (None, None), 3: ("", None)}
    raw = base64.urlsafe_b64decode(df.first().t)
    assert raw[0] == 0x80 and hmac.new(base64.urlsafe_b64decode(key)[:16], raw[:-32], hashlib.sha256).digest() == raw[-32:]
    bad = df.where("i = 1").withColumn("t", F.overlay("t", F.lit("AAAA"), F.lit(20)))
    assert bad.select(V.decrypted(F.col("t"), key).alias("x")).first().x is None
    for k in (None, "", "short", "!" * 44):
        with pytest.raises(V.VaultError):
            V.encrypted(df, "t", k)
    assert V.key_from_passphrase("p", b"s", 10) == V.key_from_passphrase("p", b"s", 10)


def test_rotation_and_retention(spark, tmp_path):
    now, old, lost = (V.generate_key() for _ in range(3))
    jobs = spark.createDataFrame([(f"j{i}", f"text {i}" if i else "", "r", "{}", dt.datetime(2024, 1, 1, i)) for i in range(6)], "job_id string, cleaned_text string, report_md string, result_json string, created_at timestamp")
    parts = [V.artifacts(jobs.where(F.col("job_id").isin(*names)), k) for k, names in ((now, ("j0", "j1")), (old, ("j2", "j3")), (lost, ("j4", "j5")))]
    stored = parts[0].unionAll(parts[1]).unionAll(parts[2])
    path = str(tmp_path / "stored")
    stored.write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() == 17  # no artifact for an empty text
    rows = V.rotated(stored, now, [old])
    assert {r.status: r.n for r in V.tally(rows).collect()} == {"skipped": 5, "migrated": 6, "failed": 6}
    V.written(V.rotated(stored, now, [old], purge=True), str(tmp_path / "new"))
    new = spark.read.parquet(str(tmp_path / "new"))
    assert new.count() == 11 and new.where(V.decrypted(F.col("ciphertext"), now).isNull()).count() == 0
    assert {r.status: r.n for r in V.tally(V.rotated(stored, now, [])).collect()} == {"skipped": 5, "failed": 12}
    kept = V.unexpired(jobs, 120, now=F.lit(dt.datetime(2024, 1, 1, 5)))
    assert {r.job_id for r in kept.collect()} == {"j3", "j4", "j5"}
    done = jobs.withColumn("status", F.lit("done"))
    assert V.download(done, "j3").first()[0] == "text 3" and V.download(done, "nope").count() == 0
    with pytest.raises(ValueError):
        V.download(done, "j3", "description")


@pytest.mark.parametrize("said,want", [
    ('{"a": 1}', '{"a": 1}'), ("x\n```json\n{\"a\": [1,],}\n```\ny", '{"a": [1]}'), ("so {\"a\": 1} it is", '{"a": 1}'), ("[1, 2,]", '{"items": [1, 2]}'), ("no", None), ("", None), (None, None),
])
def test_json(spark, said, want):
    assert spark.createDataFrame([(said,)], "t string").select(json_of(F.col("t")).alias("j")).first().j == want


def test_payloads(spark):
    p = '{"findings": [{"kind": "mail", "value": " a "}, {"type": "EMAIL", "text": "a"}, 7, {"value": ""}, {"value": "b", "confidence": "x", "start": "3"}]}'
    r = spark.createDataFrame([(p,)], "t string").select(findings_of(F.col("t")).alias("f"), critique_of(F.lit("{}")).alias("c"), findings_of(F.lit(None).cast("string")).alias("n")).first()
    assert [(f.kind, f.value, f.confidence, f.start) for f in r.f] == [("EMAIL", "a", 0.6, None), ("OTHER", "b", 0.6, 3)]
    assert r.c.agreement == 0.0 and not r.c.accepted and r.c.missing == [] and r.n == []


def test_keys(tmp_path):
    (tmp_path / "k").write_text("# old\n\n a \nb\n")
    assert V.read_keys(str(tmp_path / "k"), inline=[" x "]) == ["x", "a", "b"]


def test_ingestion_of_nothing(spark):
    rows = spark.createDataFrame([(None, None, None, None), ("e\u0301-\nx  \n", 2, "plain_text", [])], "text string, page_images int, extraction_method string, warnings array<string>")
    got = sorted(ingested(rows, offline=False).collect(), key=lambda r: r.char_count)
    assert (got[0].text, got[0].extraction_method, got[0].warnings, got[0].page_count) == ("", None, [NOTHING], 1)
    assert (got[1].text, got[1].extraction_method, got[1].warnings) == ("éx", "plain_text", [NOT_SET])
    assert "for 0 page image(s)" in ingested(rows.limit(1)).first().text
    with pytest.raises(ValueError):
        ingested(rows, "both")


def test_prompt_files(tmp_path):
    (tmp_path / "b.md").write_text("## Body\nhi")
    (tmp_path / "a.md").write_text("## Body\nho")
    assert prompts.available(str(tmp_path)) == ["a", "b"] and prompts.load(str(tmp_path), "b").render() == "hi"
    prompts.reload()


def test_streams(spark, tmp_path, request):
    src = str(tmp_path / "in")
    rows = [(i, "a@b.example" if i % 2 else f"t{i}", dt.datetime(2024, 1, 1, i)) for i in range(6)]
    spark.createDataFrame(rows, "doc_id int, text string, ts timestamp").coalesce(1).write.parquet(src)
    docs = streams.documents(spark, src, "doc_id int, text string, ts timestamp")

    def run(df, name, mode="append"):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.table(name).collect()

    from palimpsest.plans.sanitise import Settings

    got = run(streams.cleaned(docs, Settings(salt="s")).select("doc_id", "cleaned_text", "total_masked"), "cleaned")
    assert sorted((r.doc_id, r.total_masked) for r in got) == [(i, i % 2) for i in range(6)]
    assert len(run(streams.first_uploads(docs), "firsts")) == 4
    assert sum(r.n for r in run(streams.counts(docs, by="text"), "counts", "complete")) == 6
    steps = spark.createDataFrame([("j", "detect", "running"), ("j", "mask", "done"), ("k", "error", "failed")], "job_id string, stage string, status string")
    steps.coalesce(1).write.parquet(str(tmp_path / "steps"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled"))
    state = run(streams.jobs(streams.documents(spark, str(tmp_path / "steps"), steps.schema)), "jobs", "update")
    assert {(r.job_id, r.steps, r.status) for r in state} == {("j", 2, "done"), ("k", 1, "error")}
