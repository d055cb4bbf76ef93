"""Folders of raw files as a documents table."""

from __future__ import annotations

import io
import mimetypes
import re
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checksums import strip

# Suffixes by kind of file.
TEXT = (".txt", ".md", ".markdown", ".csv", ".tsv", ".json", ".yaml", ".yml", ".log", ".rtf", ".html", ".htm", ".xml")
IMAGE = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp", ".tif", ".tiff", ".heic")
SHEET = (".xlsx", ".xlsm", ".xls", ".ods")
DOCUMENT = (".docx", ".odt", ".pptx", ".epub")
ALLOWED = (*TEXT, *IMAGE, *SHEET, *DOCUMENT, ".pdf")
# The first bytes of images.
IMAGE_MAGIC = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF87a", b"GIF89a", b"BM", b"II*\x00", b"MM\x00*", b"RIFF")
MAX_BYTES = 25 << 20
# What offline mode puts in place of an image's text.
TRANSCRIPT = (
    "# (mock transcript)", "", "Mock mode produced no OCR text for 1 page image(s).", "", "## Sample Record", "", "| Field | Value |", "| --- | --- |", "| Full name | Mario Rossi |",
    "| Email | mario.rossi@example.com |", "| Phone | +39 333 1234567 |", "| IBAN | IT60X0542811101000000123456 |", "| Date of birth | 14/03/1985 |",
    "| Address | Via Roma 42, 20100 Milano, Italy |", "", "## Notes", "", "Mock-mode content used to exercise the PII pipeline end to end.",
)


@dataclass(frozen=True)
class Caps:
    """How much of a file is kept; None keeps all of it.  A warning or a note in the text tells of what was left out."""

    # The caps on characters, rows, parts and pages.
    text_chars: int | None = 400_000
    office_chars: int | None = 200_000
    sheet_rows: int | None = 200
    office_parts: int | None = 40
    pdf_pages: int | None = 15


#: Whole files, whatever their size.
NO_CAPS = Caps(None, None, None, None, None)


def suffix_of(path: Column) -> Column:
    """The last suffix of a path's name, in lower case with its dot; empty if there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, rejects): bytes of the files that may come in, and names of those that are too large or of a suffix that isn't allowed.

    Size and time are pushed into the listing, so rejected bodies are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = suffix_of(F.col("path"))
    why = F.when(F.col("length") > max_bytes, F.lit("too large")).when((suffix != "") & ~suffix.isin(*ALLOWED), F.lit("suffix not allowed"))
    fine = files.where(F.col("length") <= max_bytes).where((suffix == "") | suffix.isin(*ALLOWED)).withColumn("suffix", suffix)
    return fine, files.select("path", "length", why.alias("reason")).where("reason IS NOT NULL")


def probably_text(header: Column) -> Column:
    """No zero byte, and over 92 % of the bytes are printable, white space or above ASCII."""
    s = F.decode(header, "ISO-8859-1")
    fine = F.length(F.regexp_replace(s, r"[\x00-\x08\x0e-\x1f\x7f]", ""))
    return F.coalesce((F.length(header) > 0) & ~F.contains(header, F.lit(b"\x00")) & (fine / F.length(header) > 0.92), F.lit(False))


def kind_of_file(content: Column, suffix: Column, hint: Column | None = None) -> Column:
    """pdf, text, spreadsheet, document or image by the first 4 KiB, then by suffix; null for what is none of them."""
    header = content.substr(F.lit(1), F.lit(4096))
    pdf = F.startswith(header, F.lit(b"%PDF-"))
    real_pdf = pdf & (F.contains(header, F.lit(b"obj")) | F.contains(header, F.lit(b"stream")))
    image = F.lit(False)
    for magic in IMAGE_MAGIC:
        image = image | F.startswith(header, F.lit(magic))
    sheet, document = suffix.isin(*SHEET), suffix.isin(*DOCUMENT)
    hint = F.lit("") if hint is None else F.coalesce(hint, F.lit(""))
    plain = suffix.isin(*TEXT) | hint.startswith("text/")
    is_text = probably_text(header)
    return (
        F.when(real_pdf, "pdf").when(is_text & sheet, "spreadsheet").when(is_text & document, "document").when(is_text, "text")
        .when(F.startswith(header, F.lit(b"PK\x03\x04")) & sheet, "spreadsheet").when(F.startswith(header, F.lit(b"PK\x03\x04")) & document, "document")
        .when(image | suffix.isin(*IMAGE), "image").when(sheet, "spreadsheet").when(document, "document").when(plain, "text").when(pdf, "pdf")
    )


def _text(raw: bytes) -> tuple[str, str]:
    for encoding in ("utf-8", "utf-16", "latin-1"):
        try:
            return raw.decode(encoding), ""
        except UnicodeDecodeError:
            continue
    raise ValueError("text file is not decodable")


def _paragraphs(z: zipfile.ZipFile) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    lines = [s for p in body.findall(f"{w}p") if (s := said(p)).strip()]
    for table in body.findall(f"{w}tbl"):
        lines += [" | ".join("\n".join(said(p) for p in cell.findall(f"{w}p")).strip() for cell in row.findall(f"{w}tc")) for row in table.findall(f"{w}tr")]
    return "\n".join(lines)


def _slides(z: zipfile.ZipFile) -> str:
    a, p = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}"
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for k, n in enumerate(names, 1):
        out.append(f"## Slide {k}")
        for shape in ElementTree.fromstring(z.read(n)).iter(f"{p}sp"):
            said = "\n".join("".join(t.text or "" for t in q.iter(f"{a}t")) for q in shape.iter(f"{a}p")).strip()
            out += [said] if said else []
    return "\n".join(out)


def _parts(z: zipfile.ZipFile, caps: Caps) -> str:
    names = [n for n in z.namelist() if n.endswith((".xml", ".html", ".txt"))][: caps.office_parts]
    flat = (re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", z.read(n).decode("utf-8", "ignore"))).strip() for n in names)
    return "\n".join(t for t in flat if t)[: caps.office_chars]


def _office(raw: bytes, suffix: str, caps: Caps) -> tuple[str, str, str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        if suffix == ".docx" and "word/document.xml" in names:
            return _paragraphs(z), "docx_text", ""
        if suffix == ".pptx" and "ppt/presentation.xml" in names:
            return _slides(z), "pptx_text", ""
        return _parts(z, caps), "office_xml_text", ""


def _xlsx(z: zipfile.ZipFile) -> list[tuple[str, list[list[str]]]]:
    m, r = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    strings = []
    if "xl/sharedStrings.xml" in z.namelist():
        strings = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{m}si")]
    targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = []
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet"):
        target = targets[s.get(f"{r}id")]
        rows = []
        for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{m}row"):
            cells: dict[int, str] = {}
            for at, c in enumerate(row.findall(f"{m}c")):
                ref = re.match(r"[A-Z]+", c.get("r", ""))
                col = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(ref[0]))) - 1 if ref else at
                v = c.findtext(f"{m}v")
                cells[col] = strings[int(v)] if c.get("t") == "s" and v else "".join(t.text or "" for t in c.iter(f"{m}t")) if c.get("t") == "inlineStr" else v or ""
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        sheets.append((s.get("name"), rows))
    return sheets


def _ods(z: zipfile.ZipFile) -> list[tuple[str, list[list[str]]]]:
    t, x = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}", "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
    sheets = []
    for table in ElementTree.fromstring(z.read("content.xml")).iter(f"{t}table"):
        rows = []
        for row in table.iter(f"{t}table-row"):
            cells = [("\n".join("".join(p.itertext()) for p in c.findall(f"{x}p")), int(c.get(f"{t}number-columns-repeated", 1))) for c in row.findall(f"{t}table-cell")]
            while cells and not cells[-1][0]:
                cells.pop()
            rows.append([v for v, n in cells for _ in range(n)])
        while rows and not rows[-1]:
            rows.pop()
        sheets.append((table.get(f"{t}name"), rows))
    return sheets


def _table(rows: list[list[str]]) -> list[str]:
    """A Markdown table, its first row the names."""
    width = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    line = lambda r: "| " + " | ".join(v.ljust(w) for v, w in zip(r, width)) + " |"
    return [line(rows[0]), "|:" + "|:".join("-" * (w + 1) for w in width) + "|", *map(line, rows[1:])]


def _sheets(raw: bytes, suffix: str, caps: Caps) -> tuple[str, str, str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        sheets = _ods(z) if suffix == ".ods" else _xlsx(z)
    out = []
    for name, rows in sheets:
        head = rows[0] if rows else []
        body = [r + [""] * (len(head) - len(r)) for r in rows[1:]]
        out += [f"## Sheet: {name}", f"rows: {len(body)}, columns: {len(head)}", f"column names: {', '.join(head)}", ""]
        out += _table([head, *body[: caps.sheet_rows]]) if head else []
        out += [f"\n_(preview of first {caps.sheet_rows} rows only)_"] if caps.sheet_rows is not None and len(body) > caps.sheet_rows else []
        out.append("")
    return "\n".join(out).strip(), "spreadsheet_tabular", ""


def _pdf(raw: bytes, caps: Caps) -> tuple[str, str, str]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("PDF produced neither page images nor extractable text (no PDF reader is installed)") from e
    pages = PdfReader(io.BytesIO(raw)).pages
    note = f"PDF has {len(pages)} pages; only the first {caps.pdf_pages} were processed" if caps.pdf_pages is not None and len(pages) > caps.pdf_pages else ""
    return "\n\n".join(t for p in list(pages)[: caps.pdf_pages] if (t := (p.extract_text() or "").strip())), "pdf_text_layer", note


def converted(files: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """files (path, content, suffix) with kind, mime_type, text, extraction_method, warnings, error and char_count; the bodies are gone.

    A file that can't be read gives a row with an error, never a failed job.
    UTF-8 text is decoded natively; other encodings and containers go through
    Arrow batches.  Images get the offline transcript.  caps bounds what is kept of a
    file, as a warning then says; NO_CAPS keeps whole files.
    """
    kind_type = "struct<text: string, method: string, warning: string, error: string>"

    @F.arrow_udf(kind_type)
    def opened(content: pa.Array, kind: pa.Array, suffix: pa.Array) -> pa.Array:
        out = []
        for raw, k, s in zip(content, kind.to_pylist(), suffix.to_pylist()):
            raw = raw.as_py()
            row = {"text": None, "method": None, "warning": "", "error": None}
            try:
                if raw is None or k is None:
                    pass
                elif k == "text":
                    text, row["warning"] = _text(raw)
                    row |= {"text": text, "method": "plain_text"}
                else:
                    row["text"], row["method"], row["warning"] = _pdf(raw, caps) if k == "pdf" else _sheets(raw, s, caps) if k == "spreadsheet" else _office(raw, s, caps)
            except Exception as e:  # noqa: BLE001 - a bad file is a row, not a failure
                row["error"] = f"{type(e).__name__}: {e}"
            out.append(row)
        return pa.array(out, pa.struct([(f, pa.string()) for f in ("text", "method", "warning", "error")]))

    rows = files.withColumn("kind", kind_of_file(F.col("content"), F.col("suffix")))
    native = (F.col("kind") == "text") & F.is_valid_utf8(F.col("content").cast("string"))
    python = ~native & F.col("kind").isin("text", "pdf", "spreadsheet", "document")
    rows = rows.withColumns({"__native": native, "__python": python})
    rows = rows.withColumn("__open", F.when(F.col("__python"), opened(F.when(F.col("__python"), F.col("content")), "kind", "suffix")))
    raw = F.when(F.col("__native"), F.col("content").cast("string")).otherwise(F.col("__open.text"))
    is_text, long = F.col("kind") == "text", F.lit(False) if caps.text_chars is None else F.length("__raw") > caps.text_chars
    rows = rows.withColumn("__raw", raw)
    text = F.when(F.col("kind") == "image", F.lit("\n".join(TRANSCRIPT))).when(is_text & long, F.left("__raw", F.lit(caps.text_chars))).when(is_text, strip(F.col("__raw"))).otherwise(F.col("__raw"))
    warned = F.array_compact(F.array(F.when(is_text & long, F.lit(f"text truncated to {caps.text_chars} characters")), F.when(F.col("__open.warning") != "", F.col("__open.warning"))))
    rows = rows.withColumns({"text": text, "warnings": warned})
    blank = F.coalesce(strip(F.col("text")), F.lit("")) == ""
    error = F.coalesce(F.col("__open.error"), F.when(F.col("kind").isNull(), F.lit("unsupported file type")), F.when(blank, F.lit("the file contains no readable text (it is empty or blank)")))
    method = F.when(F.col("kind") == "image", F.lit("mock")).when(F.col("__native"), F.lit("plain_text")).otherwise(F.col("__open.method"))
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "kind", _mime(F.col("suffix"), F.col("kind")).alias("mime_type"), "text", method.alias("extraction_method"), "warnings", error.alias("error"), F.length("text").cast("long").alias("char_count"))


def _mime(suffix: Column, kind: Column) -> Column:
    types = {s: t for s in ALLOWED if (t := mimetypes.guess_type(f"x{s}")[0])}
    known = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    return F.when(kind == "pdf", F.lit("application/pdf")).when(kind == "text", F.coalesce(F.try_element_at(known, suffix), F.lit("text/plain"))).when(kind == "image", F.coalesce(F.try_element_at(known, suffix), F.lit("image/png"))).otherwise(F.coalesce(F.try_element_at(known, suffix), F.lit("")))


def documents(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, caps: Caps = Caps()) -> DataFrame:
    """The documents of a folder; doc_id is a hash of the path, so a second run gives the same ids."""
    files, _ = read_files(spark, path, max_bytes)
    return converted(files, caps).withColumn("doc_id", F.sha2("path", 256))
