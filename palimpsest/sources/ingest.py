"""Which text of a file is worked on: its own text layer, what a vision model reads, or an offline transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import finalised, nfc, tidy
from .files import TRANSCRIPT

# Notes and warnings on the way taken.
OFFLINE = "MOCK_MODE: vision LLM call skipped"
FELL_BACK = "fell back to embedded text layer"
NOT_SET = "OPENAI_API_KEY not set - vision extraction skipped"
FAILED, FAILED_AGAIN = "vision extraction failed: ", "fallback vision extraction failed: "
NOTHING = "no text could be extracted from this file"
#: Stands between pages while they are composed; nothing composes across it.
_PAGE = "\0\f"


def _tidied(pages: Column) -> Column:
    """Pages in normalised form, composed in one go."""
    split = F.split(nfc(F.array_join(pages, _PAGE, "")), _PAGE, -1)
    return F.when(F.size(pages) > 0, F.transform(split, tidy)).otherwise(pages)


def ingested(rows: DataFrame, strategy: str = "vision_first", offline: bool = True, seen: str | None = None, why: str | None = None, model: str = "") -> DataFrame:
    """rows with text, pages, extraction_method, extraction_notes, warnings, char_count and page_count settled.

    rows: text, extraction_method and warnings as files.converted() gives them, and
    page_images, their number.  seen names a column of the pages that a vision
    model read, null where it failed, and why one that says what failed; without
    seen there is no such model.  strategy is vision_first, which takes the model's
    pages before the file's own text, or text_first.  offline puts the transcript in
    place of the model.  A null text is an empty one, null page_images are none, and
    a file of which nothing can be read stays, with a warning.
    """
    if strategy not in ("vision_first", "text_first"):
        raise ValueError(f"unknown strategy {strategy}")
    none = F.array().cast("array<string>")
    text, images = F.coalesce("text", F.lit("")), F.coalesce("page_images", F.lit(0))
    pages = F.coalesce(F.col(seen), none) if seen else none
    failed = F.col(seen).isNull() if seen else F.lit(True)
    reason = F.coalesce(F.col(why), F.lit("")) if why else F.lit("no vision model" if not seen else "")
    legible = F.exists(pages, lambda p: F.btrim(p) != "")
    first = (images > 0) & F.lit(strategy == "vision_first")
    transcript = F.replace(F.lit("\n".join(TRANSCRIPT)), F.lit("for 1 page"), F.concat(F.lit("for "), images, F.lit(" page")))
    # the way: 0 transcript as the first choice, 1 pages as the first choice, 2 own text, 3 transcript, 4 pages as the last resort, 5 nothing
    eager = F.when(first & F.lit(offline), 0).when(first & F.lit(seen is not None and not offline) & legible, 1)
    way = F.coalesce(eager, F.when(text != "", 2).when(F.lit(offline), 3).when((images > 0) & ~failed & (F.size(pages) > 0), 4).otherwise(5))
    note = F.when(way == 0, OFFLINE).when(way == 1, F.concat(F.lit(f"vision model={model}, pages="), F.size(pages))).when(way == 2, FELL_BACK)
    tried = first & F.lit(not offline)
    warned = F.array(
        F.when(tried & failed, F.lit(NOT_SET) if seen is None else F.concat(F.lit(FAILED), reason)),
        F.when((way == 5) & (images > 0) & F.lit(not offline) & failed, F.concat(F.lit(FAILED_AGAIN), reason)),
        F.when(way == 5, F.lit(NOTHING)),
    )
    method = F.when(way.isin(0, 3), "mock").when(way.isin(1, 4), "vision_llm").when(way == 2, F.coalesce(F.when(F.col("extraction_method") != "", F.col("extraction_method")), F.lit("pdf_text_layer")))
    out = rows.withColumns({
        "__text": F.when(way.isin(0, 3), F.when(text != "", text).otherwise(transcript)).when(way == 2, text).otherwise(F.lit("")),
        "__pages": F.when(way.isin(1, 4), pages).otherwise(none), "__method": method, "__notes": F.array_compact(F.array(note)),
        "__warned": F.concat(F.coalesce("warnings", none), F.array_compact(warned)),
    })
    out = out.withColumn("__whole", finalised(tidy(nfc(F.col("__text"))), _tidied(F.col("__pages"))))
    out = out.withColumns({
        "text": F.col("__whole.text"), "pages": F.col("__whole.pages"), "char_count": F.col("__whole.char_count"), "page_count": F.greatest(F.lit(1), F.size("__whole.pages")),
        "extraction_method": F.col("__method"), "extraction_notes": F.col("__notes"), "warnings": F.col("__warned"),
    })
    return out.drop("__text", "__pages", "__method", "__notes", "__warned", "__whole")


def summary(truncated: Column | None = None) -> Column:
    """What is told of an ingested row beside its result: a struct of its columns without text and pages."""
    told = ("doc_id", "filename", "kind", "mime_type", "extraction_method", "extraction_notes", "warnings", "char_count", "page_count")
    return F.struct(*told, (F.lit(False) if truncated is None else truncated).alias("truncated"))
