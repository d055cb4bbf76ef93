import glob
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from palimpsest.llm import interleave, sentencepieces, token_shards
from palimpsest.llm.sentencepieces import MODEL, Vocabulary

TEXTS = [None, "", " ", "  a", "a  b\n c ", "\n\n", "日本語 😀x", "a" * 3000, "\t é \x00 ￾", "The quick brown fox.", "The quick brown fox.", "%% $$$ ###", "x " * 20_000, "é ﬁ"]


def best_score(v, word):
    """Plain Viterbi over one string."""
    by_text = {}
    for i, s in zip(v.key_id, v.key_score):
        by_text[v.piece_bytes[v.piece_at[i] : v.piece_at[i + 1]].tobytes().decode().replace(" ", "▁")] = s
    best = [0.0] + [-1e18] * len(word)
    for e in range(1, len(word) + 1):
        for b in range(max(0, e - v.longest), e):
            if word[b:e] in by_text:
                best[e] = max(best[e], best[b] + by_text[word[b:e]])
        if word[e - 1] not in by_text:
            best[e] = max(best[e], best[e - 1] + v.unknown)
    return best[-1]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(MODEL)


def test_pieces_round_trip(vocabulary):
    got = vocabulary.encode(pa.array(TEXTS, pa.string()))
    assert vocabulary.decode(got).to_pylist() == TEXTS and got[0].as_py() is None and got[1].as_py() == []
    sliced = vocabulary.encode(pa.array(TEXTS, pa.string()).slice(3, 5))
    assert sliced.to_pylist() == got.to_pylist()[3:8] and vocabulary.decode(got.slice(3, 5)).to_pylist() == TEXTS[3:8]
    assert vocabulary.encode(pa.array([], pa.string())).to_pylist() == []
    assert vocabulary.decode(pa.array([[999_999], [195], None], pa.list_(pa.int32()))).to_pylist()[2] is None


def test_pieces_are_the_best(vocabulary):
    rng = random.Random(1)
    score = dict(zip(vocabulary.key_id.tolist(), vocabulary.key_score.tolist()))
    byte = {int(i) for i in vocabulary.byte_id}
    words = ["".join(rng.choice("etaoinshr%$日é") for _ in range(rng.randint(1, 12))) for _ in range(150)]
    for w, ids in zip(words, vocabulary.encode(pa.array(words)).to_pylist()):
        runs = "".join("u" if i in byte else "p" for i in ids)
        got = sum(score[i] for i in ids if i not in byte)
        unknown = sum(1 for c in w if vocabulary.encode(pa.array([c])).to_pylist()[0][-1] in byte)
        assert got + unknown * vocabulary.unknown == pytest.approx(best_score(vocabulary, "▁" + w)), (w, runs)


def test_pieces_match_the_library(vocabulary):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    for i, s in zip(vocabulary.key_id, vocabulary.key_score):
        m.pieces[int(i)].score = float(s)
    sp = sentencepiece.SentencePieceProcessor()
    sp.LoadFromSerializedProto(m.SerializeToString())
    texts = ["And the thonnt with of anly is edere.", "De éon éouonque surle laitrepa.\nLe ou", "  two  spaces ", "日本 é"]
    assert vocabulary.encode(pa.array(texts)).to_pylist() == sp.encode(texts)


def test_pieces_on_rows(spark, vocabulary):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "token_ids int, text string").withColumnRenamed("token_ids", "id")
    rows = sentencepieces.decode(sentencepieces.encode(df), text="back")
    assert rows.where(~F.col("text").eqNullSafe(F.col("back"))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4097])
def test_permutation(n):
    x = np.arange(n)
    assert sorted(token_shards.feistel(x, n).tolist()) == x.tolist()
    if n > 100:
        assert token_shards.feistel(x, n, 1).tolist() != token_shards.feistel(x, n, 2).tolist()


def test_shards_on_disk(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(9, TEXTS[9]), (None, "no id"), (-5, "below"), (2**40 + 201, "large \n id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "shards")
    said = token_shards.write_shards(df, path, per_shard=16, length=64)
    ranks = token_shards.load_ranks()
    assert said["records"] > 32 and said == {"records": said["records"], "per_shard": 16, "sequence": 64, "width": 2, "vocabulary": len(ranks), "end": token_shards.END_OF_TEXT, "key": token_shards.KEY}
    table = {(r.doc_id, r.part, r.slot): r for r in token_shards.materialise(df, per_shard=16, length=64).collect()}
    other = {(r.doc_id, r.part, r.slot) for r in token_shards.materialise(df.repartition(7), per_shard=16, length=64).collect()}
    assert set(table) == other and sorted(k[2] for k in table) == list(range(len(table)))
    stride, seen = 17 + 128, {}
    for k in range(-(-len(table) // 16)):
        (name,) = glob.glob(f"{path}/shard={k}/*.txt")
        raw = open(name, "rb").read()
        for j in range(len(raw) // stride):
            record = raw[j * stride : (j + 1) * stride]
            i, part, n = struct.unpack("<qii", record[:16])
            ids = np.frombuffer(record[16:-1], np.uint16)
            r = table[(None if i == token_shards.NO_ID else i, part, k * 16 + j)]
            assert bytes(r.record) == record and r.offset == j * stride and record[-1:] == b"\n" and not ids[n:].any()
            seen.setdefault((i, k * 16 + j if i == 9 else 0), {})[part] = ids[:n].tolist()
    enc = tiktoken.Encoding("t", pat_str=token_shards.PATTERN, mergeable_ranks=token_shards.load_ranks(), special_tokens={})
    for i, t in rows:
        if t and i not in (None, 9, token_shards.NO_ID):
            parts = seen[(i, 0)]
            tokens = [x for p in sorted(parts) for x in parts[p]]
            assert tokens[-1] == token_shards.END_OF_TEXT and enc.decode(tokens[:-1]) == t
    read = {r.slot: (r.id, r.part, list(r.ids)) for r in token_shards.read_shards(spark, path).collect()}
    assert {s: k[:2] for s, k in read.items()} == {k[2]: k[:2] for k in table} and len(read) == said["records"]
    assert [(r.slot, r.id, r.part, list(r.ids)) for r in token_shards.read_shards(spark, path, 13, 37).orderBy("slot").collect()] == [(s, *read[s]) for s in range(13, 37)]
    assert sum(1 for k in seen if k[0] == 9) == 2 and not any(k[0] in (0, 1) for k in seen)
    assert token_shards.materialise(df.where("false")).collect() == []


def test_interleaving(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 7}", i) for i in range(500)] + [(i, None, None, 0) for i in range(40)] + [(7, "same", "hot", 1)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").drop("n")
    out = interleave.interleave(df, shards=16)
    got = out.collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    for source in {r.source for r in got}:
        n = [sum(1 for r in got if r.source == source and r.shard == k) for k in range(16)]
        assert max(n) - min(n) <= 2
    again = interleave.interleave(df.repartition(5), shards=16)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    assert interleave.interleave(df.where("false")).collect() == []
    few = interleave.interleave(df.limit(3), shards=16).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3


def test_shard_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "x", f"s{i % 3}") for i in range(40)], "doc_id long, text string, source string")
    interleave.write_shards(df, str(tmp_path / "s"), shards=4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == {k: 10 for k in range(4)}


def test_query_digest(spark, tmp_path):
    rows = [(1, "é", "a"), (2, None, "b"), (3, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r["size"], r.text_crc32, r.law, r.grown_shard) for r in interleave.op9_interleave(spark, str(tmp_path)).collect()}
    assert got == {1: (3, zlib.crc32("é".encode()), "rows", None), 2: (1, 0, "rows", None), 3: (1, 0, "rows", None)}


@pytest.fixture
def many_files(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 10)
    yield
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_places_with_several_files_a_part(spark, many_files, tmp_path):
    df = spark.createDataFrame([(i, f"t{i} " * (i % 40), f"s{i % 3}") for i in range(100)], "doc_id long, text string, source string")
    shards = {}
    for r in interleave.interleave(df, shards=4).collect():
        shards.setdefault(r.shard, []).append(r.slot)
    assert {k: sorted(v) for k, v in shards.items()} == {k: list(range(25)) for k in range(4)}
    slots = [r.slot for r in token_shards.materialise(df, per_shard=16, length=8).collect()]
    assert sorted(slots) == list(range(len(slots))) and len(slots) > 60
    token_shards.write_shards(df, str(tmp_path / "s"), per_shard=16, length=8)
    assert sorted(r.slot for r in token_shards.read_shards(spark, str(tmp_path / "s")).collect()) == sorted(slots)


def plain_feistel(x, n, key):
    """One number, in Python's own integers."""

    def mix(v):
        v = (v + 0x9E3779B97F4A7C15) % 2**64
        v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        v = (v ^ v >> 27) * 0x94D049BB133111EB % 2**64
        return v ^ v >> 31

    bits = 1
    while 4**bits < n:
        bits += 1
    while True:
        left, right = divmod(x, 2**bits)
        for k in range(token_shards.ROUNDS):
            left, right = right, left ^ mix(right ^ mix(k + key)) % 2**bits
        x = left * 2**bits + right
        if x < n:
            return x


def test_slots_against_a_plain_placement(spark):
    rows = [(i % 50, " ".join(f"w{k}" for k in range(i % 30))) for i in range(90)] + [(None, "x y")]
    enc = tiktoken.Encoding("t", pat_str=token_shards.PATTERN, mergeable_ranks=token_shards.load_ranks(), special_tokens={})
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = {(r.doc_id, r.text): r.h for r in df.select("*", F.xxhash64("text").alias("h")).collect()}
    order = sorted((r for r in rows if r[1]), key=lambda r: (r[0] is not None, r[0] or 0, hashed[r]))
    parts = [(i, p) for i, t in order for p in range(-(-(len(enc.encode_ordinary(t)) + 1) // 8))]
    want = sorted((plain_feistel(place, len(parts), 5), i, p) for place, (i, p) in enumerate(parts))
    got = sorted((r.slot, r.doc_id, r.part) for r in token_shards.materialise(df, key=5, length=8).collect())
    assert got == want


def test_interleaving_against_a_plain_placement(spark):
    rows = [(i, f"s{i % 7 if i % 2 else 0}") for i in range(300)] + [(300 + i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    keyed = df.select("*", F.xxhash64(F.lit(17), "source").alias("g"), F.xxhash64(F.lit(17), "doc_id", "source").alias("k")).collect()
    ranked = sorted(keyed, key=lambda r: (r.g, r.k))
    place = {r.doc_id: p for p, r in enumerate(ranked)}
    groups = {}
    for r in ranked:
        groups.setdefault(r.source, []).append(r)
    share = [((2 * q + 1) / (2 * len(g)), r.g, place[r.doc_id], r.doc_id) for g in groups.values() for q, r in enumerate(g)]
    n = len(rows)
    want, used = [], {}
    for at, (*_, i) in enumerate(sorted(share)):
        shard = at * 6 // n
        used[shard] = used.get(shard, -1) + 1
        want.append((i, shard, used[shard]))
    assert sorted((r.doc_id, r.shard, r.slot) for r in interleave.interleave(df, shards=6).collect()) == sorted(want)


def test_columns_with_clashing_names(spark):
    names = ["__pos", "__source", "__key", "__tie", "__share", "__at", "__name", "__lo", "__n", "__part", "__file", "__row", "__start"]
    df = spark.createDataFrame([(i, f"s{i % 3}", *[i] * len(names)) for i in range(20)], "doc_id long, source string, " + ", ".join(f"{n} int" for n in names))
    out = interleave.interleave(df, shards=4)
    assert out.columns == [*df.columns, "shard", "slot"] and all(r[n] == r.doc_id for r in out.collect() for n in names)
