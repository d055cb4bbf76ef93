"""Page images of files, and what a vision model reads on them."""

from __future__ import annotations

import io
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from .files import Caps

#: From a file's bytes and kind to its pages as images; any picklable function.
Render = Callable[[bytes, str], list[bytes]]
#: From (prompt, image) of each page of a file to their texts; any picklable function.
Vision = Callable[[list[tuple[str, bytes]]], list[str]]


def smaller(raw: bytes, edge: int = 1800, quality: int = 85) -> bytes:
    """An image as a JPEG of at most edge pixels a side; as it is where no image library is installed or it can't be read."""
    try:
        from PIL import Image

        image = Image.open(io.BytesIO(raw)).convert("RGB")
        image.thumbnail((edge, edge))
        out = io.BytesIO()
        image.save(out, "JPEG", quality=quality, optimize=True)
        return out.getvalue()
    except Exception:  # noqa: BLE001 - the image as it came is always an answer
        return raw


def own_image(raw: bytes, kind: str) -> list[bytes]:
    """An image is its own only page; other files have none without a renderer."""
    return [smaller(raw)] if kind == "image" else []


def with_pages(files: DataFrame, render: Render = own_image, caps: Caps = Caps()) -> DataFrame:
    """files (content, kind, ...) with images, the pages of each, and page_images, their number.

    Null contents, and files on which the renderer fails, have no pages;
    caps.pdf_pages bounds them, None keeps all.
    """

    @F.arrow_udf(ArrayType(BinaryType()))
    def rendered(content: pa.Array, kind: pa.Array) -> pa.Array:
        out = []
        for raw, k in zip(content, kind.to_pylist()):
            try:
                out.append(list(render(raw.as_py(), k or ""))[: caps.pdf_pages] if raw.is_valid else [])
            except Exception:  # noqa: BLE001 - a bad file is a row without pages
                out.append([])
        return pa.array(out, pa.list_(pa.binary()))

    return files.withColumn("images", rendered("content", "kind")).withColumn("page_images", F.size("images"))


def read_by(rows: DataFrame, model: Vision, prompt: str = "Transcribe page {page} of {total}.", retries: int = 2) -> DataFrame:
    """rows (images, ...) with seen, the stripped text of each page, and why, what failed.

    seen is null where the model failed for good or gave other than a text a page,
    and empty without images, for which it isn't asked; sources.ingest takes both
    columns.  A row's failure is not the job's.
    """
    schema = StructType([f for f in rows.schema.fields if f.name not in ("seen", "why")]).add("seen", ArrayType(StringType())).add("why", StringType())

    def said(images: list[bytes] | None) -> tuple[list[str] | None, str | None]:
        if not images:
            return [], None
        asking = [(prompt.format(page=k, total=len(images)), image) for k, image in enumerate(images, 1)]
        for attempt in range(retries + 1):
            try:
                texts = [(t or "").strip() for t in model(asking)]
                return (texts, None) if len(texts) == len(images) else (None, f"{len(texts)} answers for {len(images)} pages")
            except Exception as e:  # noqa: BLE001 - whatever the model's client raises
                why = f"{type(e).__name__}: {e}"
                if attempt < retries:
                    time.sleep(min(2**attempt, 8))
        return None, why

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                part = b.slice(at, 1)
                seen, why = said(part["images"][0].as_py())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([seen], pa.list_(pa.string())), pa.array([why], pa.string())], [*part.schema.names, "seen", "why"])

    return rows.drop("seen", "why").mapInArrow(run, schema)
