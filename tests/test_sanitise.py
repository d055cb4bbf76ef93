import json
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from palimpsest.functions import findings as G
from palimpsest.functions import masking as M
from palimpsest.functions.names import names
from palimpsest.functions.scan import scan
from palimpsest.operators.audit import collisions, counts_by_kind, gauges, observed, report, rollup
from palimpsest.plans.backends import detector, hinted, model_masked, reviewer
from palimpsest.plans.sanitise import Settings, audited, found, sanitised, trace
from palimpsest.sources.prompts import parse
from tests.test_scan import CV


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.createDataFrame([(1, CV), (2, " \n "), (3, None), (4, "nothing here"), (1, CV)], "doc_id int, text string")
    return sanitised(docs, Settings(salt="test-salt")).cache()


def test_cv(rows):
    r = rows.where("doc_id = 1").first()
    assert r.total_masked == 7 and r.leaked == 0 and r.status == "done"
    assert r.by_kind == {"EMAIL": 1, "PHONE": 2, "DOB": 1, "TAX_ID": 1, "IBAN": 1, "PERSON": 2}
    for literal in ("Mario Rossi", "mario.rossi@example.com", "IT60X0542811101000000123456", "RSSMRA85C14F205Z", "333 1234567"):
        assert literal not in r.cleaned_text
    assert "Via Roma 42" in r.cleaned_text and "Data Engineer" in r.cleaned_text


def test_failed_rows_stay(rows):
    assert [(r.doc_id, r.status) for r in rows.orderBy("doc_id").collect()] == [(1, "done"), (1, "done"), (2, "error"), (3, "error"), (4, "done")]
    stages = {r.doc_id: [x.stage for x in trace(rows, "doc_id").where(f"doc_id = {r.doc_id}").orderBy("seq").collect()] for r in rows.where("doc_id > 1").collect()}
    assert stages[2] == ["error"] and stages[4][-1] == "mask"


def test_report_and_audit_show_no_value(rows):
    r = rows.where("doc_id = 1").select(report(F.col("doc_id"), F.col("status"), F.lit("cv|1.txt"), F.lit("text"), F.lit("plain_text"), F.length("text"), F.size("rounds"), F.lit("1.0"), F.col("changes"), F.col("by_kind"), F.array(F.lit("w"))).alias("md")).first()
    assert r.md.startswith("# PII removal report\n\n- Job: `1`\n- Status: done\n- Source file: cv|1.txt\n")
    assert "| PERSON | 2 |\n| PHONE | 2 |\n| DOB | 1 |" in r.md and "## Warnings\n\n- w\n" in r.md and "Mario Rossi" not in r.md
    assert "Mario Rossi" not in json.dumps([x.asDict(True) for x in audited(rows).select("changes", "cleaned_text").collect()])


def test_counts(rows):
    got = {r.kind: (r.occurrences, r.documents) for r in counts_by_kind(rows).collect()}
    assert got["PERSON"] == (4, 2) and got["EMAIL"] == (2, 2)
    top = rollup(rows, "status").where("status IS NULL").first()
    assert (top.documents, top.masked_documents, top.occurrences) == (5, 2, 16)


def test_settings():
    for bad in ({"salt": ""}, {"salt": "x", "max_rounds": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_masking_quirks(spark):
    items = [("PERSON", "Mario Rossi", "[PERSON_1]"), ("PERSON", "Mario", "[PERSON_2]"), ("OTHER", "Mario", "[OTHER_3]"), ("OTHER", "PERSON", "[X]"), ("OTHER", "", "[Y]")]
    plan = "array(" + ", ".join(f"named_struct('kind', '{k}', 'value', '{v}', 'placeholder', '{p}')" for k, v, p in items) + ")"
    r = spark.sql("SELECT 'Mario Rossi, Mario, aaa' AS t").select(M.masked(F.col("t"), F.expr(plan)).alias("m"), M.leaks(M.masked(F.col("t"), F.expr(plan))["text"], F.expr(plan)).alias("l")).first()
    # longest first; a value under two kinds goes to the first; a value is also found inside placeholders
    assert r.m.text == "[[X]_1], [PERSON_2], aaa"
    assert [(c.kind, c.value, c.occurrences) for c in r.m.changes] == [("PERSON", "Mario Rossi", 1), ("OTHER", "PERSON", 1), ("PERSON", "Mario", 1)]
    assert r.l == ["PERSON"]


def test_names(spark):
    text = "Name: Anna  Rossi |\nHolder: IBM Italia\nmail john.smith@x.example, a.b@x.example\nCarlo Verdi\nSenior Engineer\nAnna Rossi Bianchi\nAnna Rossi\nVia Roma\n"
    df = spark.createDataFrame([(text,)], "t string")
    some, none = F.array(F.lit(1)), F.array().cast("array<int>")
    r = df.select(names(F.col("t"), some).alias("a"), names(F.col("t"), none).alias("b"), names(F.lit(None).cast("string"), some).alias("c")).first()
    assert [(f.value, f.confidence) for f in r.a] == [("Anna Rossi", 0.9), ("john smith", 0.8), ("Carlo Verdi", 0.7), ("Anna Rossi Bianchi", 0.7)]
    assert [f.value for f in r.b] == ["Anna Rossi", "john smith"] and r.c == []


F_ = "named_struct('kind', '{}', 'value', '{}', 'start', CAST(NULL AS INT), 'end', CAST(NULL AS INT), 'context', '', 'confidence', CAST({} AS DOUBLE), 'source', '{}')"


def _findings(*rows):
    return F.from_json(F.lit("[]"), G.FINDINGS) if not rows else F.expr(f"array({', '.join(F_.format(*r) for r in rows)})").cast(G.FINDINGS)


def test_reviews(spark):
    critique = F.from_json(F.lit(json.dumps({"agreement": 0.95, "accepted": False, "missing": [{"kind": "mobile", "value": " 55 ", "confidence": 3.0}, {"kind": "E-Mail", "value": "a@b"}, {"value": ""}], "false_positives": ["a@b", "x", ""], "over_masking": ["9.9.9.9"], "feedback": [], "wrong_kind": [{"value": "Ann", "kind": "company"}]})), G.CRITIQUE)
    base = _findings(("EMAIL", "a@b", 0.9, "detector"), ("PERSON", "Ann", 0.5, "detector"), ("DOB", "x", 0.5, "detector"))
    spans = F.expr("array(named_struct('kind','EMAIL','value','a@b','start',0,'end',3,'confidence',0.99D,'reason','r'), named_struct('kind','DOB','value','x','start',0,'end',1,'confidence',0.5D,'reason','r'), named_struct('kind','IP_ADDRESS','value','9.9.9.9','start',0,'end',1,'confidence',0.8D,'reason','r'))")
    r = spark.range(1).select(
        G.merged(base, critique).alias("m"), G.merged(base, critique, fix_kinds=True).alias("k"), G.reconciled(G.merged(base, critique), critique, spans).alias("r"), G.converged(critique).alias("c"),
        G.augmented(base, _findings(("PERSON", "Ann", 0.8, "n"), ("PERSON", "Bo", 0.7, "n"))).alias("a"), G.augmented(base, _findings()).alias("a0"),
        G.reviewable(base, F.lit("Ann x")).alias("v"), G.uncovered_names(base).alias("u"),
    ).first()
    key = lambda fs: [(f.kind, f.value, f.source) for f in fs]
    # a rejected key can't come back as missing
    assert key(r.m) == [("PERSON", "Ann", "detector"), ("PHONE", "55", "critic")] and r.m[1].confidence == 1.0
    assert key(r.k)[0][0] == "EMPLOYER"
    # a validated span of a hard kind outlives its rejection, a date doesn't, over-masking does away with either
    assert key(r.r) == [*key(r.m), ("EMAIL", "a@b", "normaliser")]
    assert not r.c
    assert [(f.value, f.confidence) for f in r.a] == [("a@b", 0.9), ("Ann", 0.8), ("x", 0.5), ("Bo", 0.7)] and len(r.a0) == 3
    assert [f.value for f in r.v] == ["Ann", "x"] and [f.value for f in r.u] == ["Ann"]


def _reject_first(prompts):
    return [json.dumps({"agreement_score": 0.5, "accept": "round 2" in p, "missing": [{"kind": "address", "value": "Via Roma 42"}], "false_positives": ["2019-2024"]}) for _, p in prompts]


def _finds(prompts):
    return ['Sure:\n```json\n{"findings": [{"kind": "employer", "value": "Data Engineer"},]}\n```' for _ in prompts]


def _fails(prompts):
    raise RuntimeError("no model")


PROMPT = parse("p", "---\nname: p\nversion: 2\n---\n## System\nBe brief.\n\n## Body\nround {{round_index}} {{document}} {{other}}\n\n## Guardrails\nnone")


def test_prompts():
    assert (PROMPT.name, PROMPT.version, PROMPT.system) == ("p", "2", "Be brief.")
    assert PROMPT.render(round_index=1) == "round 1 {{document}} {{other}}\n\nnone"


def test_model_rounds(spark):
    docs = spark.createDataFrame([(1, CV)], "doc_id int, text string")
    r = found(docs, Settings(salt="s"), reviewer=reviewer(_reject_first, PROMPT), detector=detector(_finds, PROMPT)).first()
    assert [x.accepted for x in r.rounds] == [False, True] and r.converged
    got = {(f.kind, f.value) for f in r.findings}
    # a phone is hard, so the scan's own word for it stands
    assert {("EMPLOYER", "Data Engineer"), ("ADDRESS", "Via Roma 42"), ("PHONE", "2019-2024"), ("PERSON", "Mario Rossi")} <= got


def test_hints_of_the_name_prompt(spark):
    docs = spark.createDataFrame([(1, "RSSMRA85C14F205Z"), (2, "none"), (3, " ".join(f"RSS{a}{b}A85C14F205Z" for a in "MABCDE" for b in "RSTUV"))], "doc_id int, text string")
    got = {r.doc_id: r.b for r in docs.select("doc_id", hinted(F.lit("x"), scan(F.col("text"))).alias("b")).collect()}
    assert got[2] == "x" and got[1].startswith("x\n") and '"surname_letters":"RSS","name_letters":"MRA"' in got[1] and got[3].count("surname_letters") == 20


def test_a_failing_model_costs_nothing(spark, monkeypatch):
    monkeypatch.setattr("palimpsest.plans.backends.time.sleep", lambda s: None)
    docs = spark.createDataFrame([(1, "mail a@b.example")], "doc_id int, text string")
    settings = Settings(salt="s", max_rounds=1)
    rows = sanitised(docs, settings, detector=detector(lambda p: _fails(p), PROMPT))
    assert [f.value for f in rows.first().findings] == ["a@b.example"]
    leaky = model_masked(rows, lambda ps: ['{"cleaned_text": "mail a@b.example"}' for _ in ps], PROMPT).first()
    good = model_masked(rows, lambda ps: ['{"cleaned_text": "mail [X]"}' for _ in ps], PROMPT).first()
    assert re.fullmatch(r"mail \[EMAIL_[0-9A-F]{6}\]", leaky.cleaned_text) and good.cleaned_text == "mail [X]"


def test_plans_of_many_rounds_stay_small(spark):
    docs = spark.createDataFrame([(1, "mail a@b.example"), (2, None)], "doc_id int, text string")
    strict = lambda rows: rows.withColumn("critique", G.agreed().withField("agreement", F.lit(0.5)).withField("accepted", F.col("round") > 2))
    rows = sanitised(docs, Settings(salt="s", max_rounds=3), reviewer=strict)
    for out, want in ((counts_by_kind(rows), 1), (collisions(rows), 0), (trace(rows, "doc_id"), 7)):
        assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 500_000 and out.count() == want


def test_observed_counts(spark):
    seen = Observation("job")
    rows = sanitised(spark.createDataFrame([(1, "mail a@b.it"), (2, "")], "doc_id int, text string"), Settings(salt="s"))
    observed(rows, seen).collect()
    assert seen.get == {"documents": 2, "errors": 1, "values_masked": 1}
    assert gauges(rows.where("false")).first().asDict() == {"jobs": 0, "pending": 0, "processing": 0, "done": 0, "error": 0}
