import json
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import decontaminate, language_id, line_dedup, minhash_hamming, preferences, quality
from palimpsest.llm.decontaminate import matches, myers
from tests.llm import brute

WORDS = {
    "en": "the of and to that thing with erth onning here ation ably", "de": "der die und zu nicht sch keit ung über ein lich heit",
    "fr": "le la et que un dans eau tion ment oir leur ère", "es": "el los que de con ción ado mente ía por una esto",
}


def texts(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return [" ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(5, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, lang) for lang in WORDS for i, t in enumerate(texts(lang, 60, 1))] + [(1, None, "en"), (2, "x", None)]
    return language_id.fit(spark.createDataFrame(rows, "doc_id int, text string, lang string"))


def test_languages_held_out(spark, model):
    rows = [(lang, t) for lang in WORDS for t in texts(lang, 100, 2)]
    got = language_id.identify(spark.createDataFrame(rows, "lang string, text string"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)


def test_languages_defined_cases(spark, model):
    odd = [None, "", "   ", "123 ### !!", "a", "é", "the " * 200_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(odd)], "id int, text string, score string")
    got = [(r.lang_pred, r.score) for r in language_id.identify(df, model).orderBy("id").collect()]
    assert got[:4] == [("und", 0.0)] * 4 and all(g[0] in WORDS for g in got[4:]) and got[6][0] == "en"
    empty = language_id.fit(df.where("false").withColumn("lang", F.lit("en")))
    assert {r.lang_pred for r in language_id.identify(df, empty).collect()} == {"und"}
    one = language_id.fit(spark.createDataFrame([(1, "abc def", "en")], "doc_id int, text string, lang string"))
    assert {r.lang_pred for r in language_id.identify(df, one).collect()} == {"und", "en"}
    assert language_id.identify(df.where("false"), model).collect() == []


def test_query_does_not_learn_from_what_it_is_asked(spark, tmp_path):
    rows = [(i, t, lang, "s", 1) for k, lang in enumerate(WORDS) for i, t in enumerate(texts(lang, 90, 3), 1000 * k)] + [(9000, None, "en", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = language_id.op7_language_id(spark, str(tmp_path)).collect()
    lang = {r[0]: r[2] for r in rows}
    assert 0.2 < np.mean([r.held_out for r in got]) < 0.5 and len(got) == len(rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out and r.doc_id < 9000]) > 0.98


def test_myers():
    rng = random.Random(1)
    for _ in range(150):
        p, t = ([rng.randrange(5) for _ in range(rng.randint(a, 80))] for a in (1, 0))
        assert myers(np.array(p, np.uint64), np.array(t, np.uint64))[0] == brute.edit_distance(p, t)


def test_myers_of_many_at_once(monkeypatch):
    monkeypatch.setattr(decontaminate, "CELLS", 200)
    rng = np.random.default_rng(2)
    patterns = [rng.integers(0, 4, rng.integers(1, 65)).astype(np.uint64) for _ in range(200)] + [np.arange(64, dtype=np.uint64)]
    texts = [rng.integers(0, 4, rng.integers(0, 90)).astype(np.uint64) for _ in range(200)] + [np.arange(64, dtype=np.uint64)]
    best, ends = decontaminate.myers_all(patterns, texts)
    assert list(zip(best.tolist(), ends.tolist())) == [tuple(int(x) for x in myers(p, t)) for p, t in zip(patterns, texts)]


def test_decontamination_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [make(n) for n in (8, 12, 25, 40, 59, 60, 7, 3, 1)]
    docs = []
    for k in range(160):
        doc = make(rng.randint(0, 120))
        if k % 2:
            part = list(rng.choice(items))
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(part)) if part else 0
                part[at : at + rng.randint(0, 1)] = make(rng.randint(0, 1))
            cut = rng.randint(0, len(doc))
            doc = doc[:cut] + part + doc[cut:]
        docs.append(doc)
    df = spark.createDataFrame([(i, " ".join(d).upper() if i % 5 == 0 else ", ".join(d)) for i, d in enumerate(docs)] + [(900, None), (901, ""), (902, "!!!")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(items)] + [(50, None, "x"), (51, "", "x"), (None, "w1 " * 9, "x")], "item_id long, text string, edits string")
    want = {(i, j): d for i, doc in enumerate(docs) for j, t in enumerate(items) if (d := brute.edit_distance(t, doc)) <= int(len(t) * 0.1)}
    for block in (1 << 20, 100):
        got = {(r.doc_id, r.item_id): r.edits for r in matches(df, bench, block_bytes=block).collect()}
        assert got == want and want
    kept = {r.doc_id for r in decontaminate.decontaminated(df, bench).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in want} | {900, 901, 902}
    assert matches(df, bench.where("false")).collect() == [] and matches(df.where("false"), bench).collect() == []


def test_long_items_as_a_whole(spark):
    """Items of more words than a machine word has bits, with edits up to and over their budget."""
    rng = random.Random(3)
    items = [[f"{c}{k}" for k in range(n)] for c, n in (("a", 61), ("b", 64), ("c", 65), ("d", 130), ("e", 200))]
    rows = []
    for j, t in enumerate(items):
        for edits in (0, 1, len(t) // 10, len(t) // 10 + 3, len(t) // 2):
            part = list(t)
            for at in rng.sample(range(len(t)), edits):
                part[at] = "other"
            rows.append((len(rows), " ".join(["x"] * 5 + part + ["y"] * 5), j))
    df = spark.createDataFrame(rows, "doc_id long, text string, item int")
    bench = spark.createDataFrame([(j, " ".join(t)) for j, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.end_word - r.first_word) for r in matches(df, bench).collect()}
    for i, text, j in rows:
        d = brute.edit_distance(items[j], text.split())
        if d <= len(items[j]) // 10:
            assert got[i, j][0] == d and got[i, j][1] >= len(items[j]) - d
        elif (i, j) in got:
            assert got[i, j][1] < len(items[j]) * 0.9


def test_a_piece_of_many_items(spark):
    """Questions made from one template: a document that holds it is aligned with all of them."""
    head, tail = "which of the following towns lies nearest to the river", "choose one answer only and give reasons for it"
    bench = spark.createDataFrame([(j, f"{head} r{j} of land l{j} {tail}") for j in range(3000)], "item_id long, text string")
    df = spark.createDataFrame([(i, f"so {head} r{i} of land l{i} {tail} then") for i in range(0, 3000, 1000)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in matches(df, bench).collect()}
    assert got == {(i, j): 0 if i == j else 2 for i in range(0, 3000, 1000) for j in range(3000)}


def test_decontamination_folds_case_beyond_ascii(spark):
    rng = random.Random(8)
    vocabulary = [f"{w}{k}" for k in range(40) for w in ("éonleeau", "straße", "ñandú", "größe", "λόγος", "plain")]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (8, 26, 30)]
    docs = [[rng.choice(vocabulary) for _ in range(20)] + t + [rng.choice(vocabulary)] for t in items] + [[rng.choice(vocabulary) for _ in range(60)]]
    rows = [(10 * i + k, f(" ".join(d))) for i, d in enumerate(docs) for k, f in enumerate((str, str.upper, str.title))]
    bench = [(10 * j + k, f(" ".join(t))) for j, t in enumerate(items) for k, f in enumerate((str, str.upper))]
    want = {(i, j): d for i, doc in rows for j, t in bench if (d := brute.edit_distance(t.casefold().split(), doc.casefold().split())) <= int(len(t.split()) * 0.1)}
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.edits for r in matches(df, bench).collect()} == want and len(want) >= 18
    assert {r.doc_id for r in decontaminate.decontaminated(df, bench).collect()} == {i for i, _ in rows} - {i for i, _ in want}
    odd = np.frombuffer("É".encode() + b"\xff\xc3 A", np.uint8)
    assert bytes(decontaminate.folded(odd, np.array([0, 2, len(odd)]))[0]) == "é".encode() + b"\xff\xc3 a"


def test_long_items_and_places(spark):
    words = [f"v{k}" for k in range(150)]
    df = spark.createDataFrame([(1, "a b " + " ".join(words[60:]) + " c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = sorted((r.first_word, r.end_word, r.edits) for r in matches(df, bench).collect())
    assert got[-1] == (42, 92, 0) and all(e - f >= 45 for f, e, _ in got)


def test_excerpts_across_cuts_and_short_items(spark, tmp_path):
    long = {n: [f"x{n}_{k}" for k in range(n)] for n in (61, 75, 120, 150, 301)}
    cut = [(n, a, b) for n in long for size in (45, 60, 100) for a in range(0, n - size + 1, 7) for b in [a + size]]
    docs = [f"before {' '.join(long[n][a:b])} after" for n, a, b in cut] + ["say what is the capital of Peru now", "What is the capital of", "one what of Peru is the capital"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(n, " ".join(t)) for n, t in long.items()] + [(7, "What is the capital of Peru now?"), (1, ""), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.op1_decontaminate(spark, str(tmp_path)).collect())
    assert got == [(i, n) for i, (n, _, _) in enumerate(cut)] + [(len(cut), 7)]
    kept = corpus_pipeline.benchmark(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [len(cut) + 1, len(cut) + 2]


def junk(i):
    return " ".join(f"{w}{'#$%&'[i % 4] * 3}" for w in texts("en", 1, i)[0].split())


def test_quality_held_out(spark):
    rows = [(i, junk(i) if i % 4 == 0 else texts("en", 1, i)[0] + ".", f"s{i % 5}", "en") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 300)] + [(None, 1), (5, None), (4, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: (r.score, r.kept) for r in quality.score(docs, model).collect()}
    assert np.mean([got[i][1] == bool(i % 4) for i in range(300, 600)]) > 0.97 and all(0 <= s <= 1 for s, _ in got.values())


def test_quality_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, "c"), (2, " ", "s", "en", "c"), (3, "fine text", None, None, "c"), (3, "fine text", None, None, "c"), (None, "word " * 100_000, "s", "en", "c")], "doc_id long, text string, source string, lang string, score string")
    none = quality.fit(docs, spark.createDataFrame([(3, 1)], "doc_id long, quality int"))
    assert none is None
    got = sorted((str(r.doc_id), r.score, r.kept) for r in quality.score(docs, none).collect())
    assert got == [("1", 0.0, False), ("2", 0.0, False), ("3", 0.5, True), ("3", 0.5, True), ("None", 0.5, True)]
    assert quality.score(docs.where("false"), none).collect() == []


def test_cotraining_uses_both_views():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 2000)
    a, b = (np.hstack([(y + rng.normal(0, 0.5, 2000))[:, None], rng.normal(0, 1, (2000, 3))]).astype(np.float32) for _ in range(2))
    used = {"says": set(), "page": set()}

    def teach(model):
        out = {}
        for k, x in (("says", a), ("page", b)):
            p = model[k].sure(x[60:1000])
            rows = [i for i in range(940) if max(p[i], 1 - p[i]) >= 0.9 and i not in used[k]][:40]
            used[k] |= set(rows)
            out[k] = a[60:1000][rows], b[60:1000][rows], (p[rows] >= 0.5).astype(int)
        return out

    m = quality.cotrain(a[:60], b[:60], y[:60], teach)
    assert used["says"] and used["page"]
    both = np.mean((m.combine(a[1000:], b[1000:]) > 0.5) == y[1000:])
    one = np.mean((m.says.odds(a[1000:]) > 0) == y[1000:])
    assert both > 0.88 and both >= one - 0.01


TURNS = [
    (1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "long answer"), (2, 0, "system", "s"), (2, 1, "user", "hi"), (2, 2, "assistant", "no"), (2, 3, "user", "why"), (2, 3, "user", "why"),
    (3, 0, "user", "alone"), (4, 0, "assistant", None), (5, 0, None, "q"), (5, 1, "assistant", "q"), (None, 0, "user", "x"), (6, None, "user", "x"), (7, 0, "system", "s"), (7, 2, "assistant", "é😀"), (8, 0, "user", "a"), (8, 1, "assistant", "a"),
]


def test_preferences_and_their_sql(spark, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(path)
    got = preferences.op8_preferences(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    rel = con.execute(preferences.OP8_SQL)
    names = [d[0] for d in rel.description]
    want = [dict(zip(names, r)) for r in rel.fetchall()]
    assert sorted(json.dumps(r.asDict(), sort_keys=True) for r in got) == sorted(json.dumps(r, sort_keys=True) for r in want)
    sibling = {(r.chosen_id, r.rejected_id): r for r in got if r.kind == "sibling"}
    assert set(sibling) == {(1, 2), (1, 7)} and sibling[(1, 2)].prompt_turns == 2 and sibling[(1, 7)].prompt == "<|system|>\ns<|end|>\n"
    r = sibling[(1, 2)]
    assert r.chosen == "<|assistant|>\nlong answer<|end|>\n" and r.chosen_mask == "14-33" and r.chosen[14:33] == "long answer<|end|>\n"
    (tie,) = [r for r in got if r.kind == "reply" and r.chosen_id == 8]
    assert (tie.chosen, tie.rejected, tie.prompt_turns) == ("", "", 2)


def test_preferences_defined_cases(spark):
    kind = "array<struct<role: string, text: string>>"
    df = spark.createDataFrame([(1, None, None), (2, [("user", "a")], None), (3, [("user", "a")] * 2000, [("user", "a")] * 1999 + [("assistant", "b")])], f"id int, chosen {kind}, rejected {kind}")
    got = {r.id: r for r in preferences.preferences(df).collect()}
    assert (got[1].prompt_turns, got[1].prompt, got[1].chosen) == (0, "", "") and got[2].rejected == "" and got[3].prompt_turns == 1999
    assert got[3].rejected_spans[0].start == len("<|assistant|>\n") and preferences.preferences(df.where("false")).collect() == []


def test_pipeline_against_plain_steps(spark, tmp_path):
    ad, leak = "Read more on our pages today", "what is the capital of the country of ants and bees"
    rows = []
    for k, lang in enumerate(WORDS):
        for i, t in enumerate(texts(lang, 40, 9), 100 * k):
            rows.append((i, t + " " + t[::-1] + (f"\n{ad}" if i % 3 == 0 else ""), lang, f"s{i % 10}", len(t)))
    rows += [(900, rows[0][1], "en", "s1", 1), (901, rows[1][1] + " " + leak, "en", "s1", 1), (902, "1234 ###", "en", "s1", 1), (903, None, "en", "s1", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    told = [(i, "\n".join(x for x in t.split("\n") if x != ad)) for i, t, *_ in rows if i not in (902, 903)]
    root = {i: c for i, _, c in brute.near_duplicates(told, 80)}
    want = {i: t for i, t in told if root[i] == i and leak not in t}
    assert set(got) == set(want) and 900 not in got and 901 not in got
    from palimpsest.llm.sentencepieces import Vocabulary

    v = Vocabulary.load()
    back = v.decode(pa.array([list(got[i].token_ids) for i in sorted(got)], pa.list_(pa.int32()))).to_pylist()
    assert back == [want[i] for i in sorted(want)]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] and line_dedup and minhash_hamming
