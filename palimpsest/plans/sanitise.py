"""The whole way from text to cleaned text: one projection after another, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.findings import agreed, augmented, converged, from_spans, merged, reconciled, reviewable
from ..functions.masking import audit, by_kind, leaks, masked, plan_of
from ..functions.names import STOP_PHRASES, STOP_TOKENS, names
from ..functions.scan import scan
from ..functions.text import canonical

#: Rounds after which a review ends in any case.
HARD_CAP = 6
DEFAULT_FEEDBACK = "Review your previous findings and add anything the critic flagged as missing."


@dataclass(frozen=True)
class Settings:
    """What changes results."""

    salt: str | bytes
    mask_style: str = "label"
    token_length: int = 6
    max_rounds: int = 3
    agreement_threshold: float = 0.9
    stop_phrases: tuple[str, ...] = STOP_PHRASES
    stop_tokens: tuple[str, ...] = STOP_TOKENS
    fix_kinds: bool = False

    def __post_init__(self) -> None:
        if not self.salt:
            raise ValueError("a salt is needed")
        if self.max_rounds < 1:
            raise ValueError("max_rounds must be 1 or more: without a round nothing would be found")


#: Takes rows with text, findings, validated, round and feedback; gives them back with a column critique (functions.findings.CRITIQUE).
Reviewer = Callable[[DataFrame], DataFrame]
#: Takes rows with text, findings so far, validated and feedback; gives them back with a column found of findings.
Detector = Callable[[DataFrame], DataFrame]


def accept_all(rows: DataFrame) -> DataFrame:
    return rows.withColumn("critique", agreed())


def detect_offline(rows: DataFrame) -> DataFrame:
    return rows.withColumn("found", from_spans(F.col("validated")))


def found(docs: DataFrame, settings: Settings, text: str = "text", reviewer: Reviewer = accept_all, detector: Detector = detect_offline) -> DataFrame:
    """docs with validated, findings and rounds, after detection and review.

    The rounds are laid out one after another in the plan; a row that has
    converged goes through the later ones unchanged.  A reviewer or detector that
    calls a model should keep its answers (DataFrame.checkpoint) so that a lost
    task doesn't ask again.
    """
    metric = "array<struct<round: int, detector_findings: int, critic_agreement: double, critic_missing: int, critic_false_positives: int, accepted: boolean>>"
    rows = docs.withColumn("validated", scan(F.col(text)))
    rows = rows.withColumn("__names", names(F.col(text), F.col("validated"), settings.stop_phrases, settings.stop_tokens))
    rows = rows.withColumns({"findings": from_spans(F.filter("validated", lambda _: F.lit(False))), "feedback": F.array().cast("array<string>"), "__done": F.lit(False), "rounds": F.from_json(F.lit("[]"), metric)})
    total = 1 if reviewer is accept_all else min(settings.max_rounds, HARD_CAP)
    for k in range(1, total + 1):
        before = F.col("__done")
        rows = detector(rows).withColumn("found", augmented(F.col("found"), F.col("__names")))
        rows = reviewer(rows.withColumnRenamed("findings", "__last").withColumn("findings", F.col("found")).withColumn("round", F.lit(k)))
        c = F.col("critique")
        rows = rows.withColumn("__merged", merged(F.col("found"), c, settings.fix_kinds))
        rows = rows.withColumn("__whole", reconciled(F.col("__merged"), c, F.col("validated")))
        now = reviewable(F.col("__whole"), F.col(text))
        told = F.struct(F.lit(k).alias("round"), F.size("found").alias("detector_findings"), c["agreement"].alias("critic_agreement"), F.size(c["missing"]).alias("critic_missing"), F.size(c["false_positives"]).alias("critic_false_positives"), c["accepted"].alias("accepted"))
        rows = rows.withColumns({
            "findings": F.when(before, F.col("__last")).otherwise(now),
            "rounds": F.when(before, F.col("rounds")).otherwise(F.concat("rounds", F.array(told))),
            "feedback": F.when(F.size(c["feedback"]) > 0, c["feedback"]).otherwise(F.array(F.lit(DEFAULT_FEEDBACK))),
            "__done": before | F.coalesce(converged(c, settings.agreement_threshold), F.lit(False)),
        })
        rows = rows.drop("__last", "found", "critique", "round", "__merged", "__whole")
    return rows.withColumnRenamed("__done", "converged").drop("__names", "feedback")


def sanitised(docs: DataFrame, settings: Settings, text: str = "text", reviewer: Reviewer = accept_all, detector: Detector = detect_offline) -> DataFrame:
    """docs with status, error, findings, rounds, cleaned_text, changes (with values), by_kind, total_masked and leaked.

    A null or blank text gives a row of status ``error``; a failed row never fails
    the job.  changes holds values: use audit() of it, as report() does, before
    anything leaves the engine.
    """
    blank = F.col(text).isNull() | ~F.col(text).rlike(r"[^\s\x1c-\x1f\x85\p{Z}]")
    rows = found(docs, settings, text, reviewer, detector)
    rows = rows.withColumn("plan", plan_of(F.col("findings"), settings.salt, settings.token_length, settings.mask_style))
    rows = rows.withColumn("__masked", masked(F.col(text), F.col("plan")))
    rows = rows.withColumns({"cleaned_text": F.col("__masked.text"), "changes": F.col("__masked.changes")})
    rows = rows.withColumns({
        "by_kind": by_kind(F.col("changes")), "total_masked": F.size("changes"), "leaked": F.size(leaks(F.col("cleaned_text"), F.col("plan"))),
        "status": F.when(blank, F.lit("error")).otherwise(F.lit("done")),
        "error": F.when(blank, F.lit("extraction produced no text; the file may be empty, corrupt, or require a vision model")),
    })
    return rows.drop("__masked")


def source_text(docs: DataFrame, text: str = "text", pages: str = "pages") -> DataFrame:
    """docs whose text is the canonical text of text and pages."""
    return docs.withColumn(text, canonical(F.col(text), F.col(pages)))


def audited(rows: DataFrame) -> DataFrame:
    """rows of sanitised() without any value: findings, plan and validated are gone, changes are previews."""
    return rows.withColumn("changes", audit(F.col("changes"))).drop("findings", "plan", "validated")


def trace(rows: DataFrame, id: Column | str) -> DataFrame:
    """(id, seq, stage, status, detail) of each row's way."""
    n = F.size("findings")
    step = lambda stage, status, detail: F.struct(F.lit(stage).alias("stage"), status.alias("status"), detail.alias("detail"))
    done = F.lit("done")
    ok = F.array(
        step("ingest", done, F.format_string("%d chars", F.length("text"))),
        step("validators", done, F.format_string("%d span(s) confirmed by regex/checksum", F.size("validated"))),
        step("detect", done, F.format_string("%d round(s)", F.size("rounds"))),
        step("critique", done, F.format_string("accepted=%s", F.element_at("rounds", -1)["accepted"].cast("string"))),
        step("converge", F.when(F.col("converged"), done).otherwise(F.lit("warn")), F.when(F.col("converged"), F.lit("detector and critic agree")).otherwise(F.lit("round limit reached"))),
        step("mask", done, F.format_string("%d finding(s), %d distinct value(s) masked", n, F.col("total_masked"))),
    )
    failed = F.array(step("error", F.lit("failed"), F.col("error")))
    # outer, as in operators.audit
    return rows.select(id, F.posexplode_outer(F.when(F.col("status") == "error", failed).otherwise(ok)).alias("seq", "t")).select(id, "seq", "t.*")
