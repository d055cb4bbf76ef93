"""Detectors and reviewers that ask a model, for plans.sanitise.

A model is any picklable function from a list of (system, prompt) to a list of
answers; where and how it is reached is its own affair.  Answers are recovered and
turned into findings and reviews by column functions.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.findings import CRITIQUE, from_spans
from ..functions.masking import accepted
from ..functions.names import surname_hints
from ..functions.recovery import critique_of, findings_of, json_of, names_of
from ..functions.text import clip, rendered
from ..sources.prompts import Prompt

Model = Callable[[list[tuple[str, str]]], list[str]]
# Characters of a document that a prompt holds; the scan sees all of it anyway.
WINDOW, NAME_WINDOW = 60_000, 40_000


def asked(rows: DataFrame, model: Model, system: str, prompt: Column, batch: int = 16, retries: int = 2) -> DataFrame:
    """rows with answer, the model's answers, null where it failed for good: a row's failure is not the job's.

    Rows pass through one operator of their own, which the optimizer neither
    repeats nor moves, so each prompt is sent once an attempt of its task.
    """
    asking = rows.withColumn("answer", prompt.cast("string"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                said: list[str | None] = [None] * part.num_rows
                for attempt in range(retries + 1):
                    try:
                        said = model([(system, p or "") for p in part["answer"].to_pylist()])
                        break
                    except Exception:  # noqa: BLE001 - whatever the model's client raises
                        if attempt < retries:
                            time.sleep(min(2**attempt, 8))
                yield part.set_column(part.schema.get_field_index("answer"), "answer", pa.array(said, pa.string()))

    return asking.mapInArrow(run, asking.schema)


def _answered(rows: DataFrame, model: Model, prompt: Prompt, body: Column) -> DataFrame:
    """rows with __answer, the JSON of the model's answer."""
    return asked(rows, model, prompt.system, body).withColumn("__answer", json_of(F.col("answer"))).drop("answer")


def hinted(body: Column, validated: Column, most: int = 20) -> Column:
    """A name prompt with what fiscal codes suggest of names, most hints of them, if there are any."""
    hints = F.transform(F.slice(surname_hints(validated), 1, most), lambda h: F.concat(F.lit("\n- "), F.to_json(h)))
    return F.when(F.size(hints) > 0, F.concat(body, F.lit("\n\nLetters of names in validated codes; report a name only if the document holds it:"), F.array_join(hints, ""))).otherwise(body)


def _clipped(text: str, window: int | None) -> Column:
    return F.col(text) if window is None else clip(F.col(text), window)


def detector(model: Model, prompt: Prompt, name_prompt: Prompt | None = None, text: str = "text", window: int | None = WINDOW, name_window: int | None = NAME_WINDOW) -> Callable[[DataFrame], DataFrame]:
    """A Detector that asks a model, and a second time for names; what fails leaves the scan's findings.  A window of None shows it whole texts."""

    def run(rows: DataFrame) -> DataFrame:
        said = F.array_join(F.transform("feedback", lambda f: F.concat(F.lit("\n- "), f)), "")
        before = F.array_join(F.transform(F.slice(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["value"]))), 1, 80), lambda v: F.concat(F.lit("\n- "), v)), "")
        body = F.concat(
            rendered(F.lit(prompt.template), {"document": _clipped(text, window)}), F.when(said != "", F.concat(F.lit("\n\nFeedback on the last round:"), said)).otherwise(F.lit("")),
            F.when(before != "", F.concat(F.lit("\n\nReported before, keep what is right:"), before)).otherwise(F.lit("")),
        )
        rows = _answered(rows, model, prompt, body)
        out = rows.withColumn("found", F.when(F.col("__answer").isNull(), from_spans(F.col("validated"))).otherwise(findings_of(F.col("__answer"))))
        if name_prompt:
            out = _answered(out, model, name_prompt, hinted(rendered(F.lit(name_prompt.template), {"document": _clipped(text, name_window)}), F.col("validated")))
            out = out.withColumn("found", F.concat("found", names_of(F.col("__answer"))))
        return out.drop("__answer")

    return run


def reviewer(model: Model, prompt: Prompt, text: str = "text", max_rounds: int = 3, window: int | None = WINDOW) -> Callable[[DataFrame], DataFrame]:
    """A Reviewer that asks a model; a failed review accepts nothing and rejects nothing."""

    def run(rows: DataFrame) -> DataFrame:
        body = rendered(F.lit(prompt.template), {"document": _clipped(text, window), "findings": F.to_json("findings"), "validated": F.to_json("validated"), "round_index": F.col("round"), "max_rounds": F.lit(max_rounds)})
        rows = _answered(rows, model, prompt, body).withColumn("__answer", F.coalesce("__answer", F.lit("{}")))
        # read back from JSON: fields of a struct made here would each be written out with the whole recovery
        said = F.from_json(F.to_json(critique_of(F.col("__answer"))), CRITIQUE, {"mode": "PERMISSIVE"})
        return rows.withColumn("critique", said).drop("__answer")

    return run


def model_masked(rows: DataFrame, model: Model, prompt: Prompt, text: str = "text", window: int | None = WINDOW) -> DataFrame:
    """rows of sanitised() whose cleaned_text is the model's where that holds no planned value; a clipped text is never given to it."""
    body = rendered(F.lit(prompt.template), {"document": F.col(text), "plan": F.to_json("plan")})
    whole = F.lit(True) if window is None else F.length(text) <= window
    rows = _answered(rows, model, prompt, F.when(whole, body))
    rows = rows.withColumn("__said", F.try_variant_get(F.try_parse_json("__answer"), "$.cleaned_text", "string")).drop("__answer")
    fits = whole & F.col("__said").isNotNull()
    return rows.withColumn("cleaned_text", F.when(fits, accepted(F.col("__said"), F.col("cleaned_text"), F.col("plan"))).otherwise(F.col("cleaned_text"))).drop("__said")
