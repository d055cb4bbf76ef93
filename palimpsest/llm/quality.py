"""Quality classification by co-training of two views.

One classifier sees the text (hashed byte trigrams, layout), the other what is known
about the page (source, language, length).  Over some rounds each labels those of
all unlabelled rows that it is sure of, and the other learns from a bounded sample of
them.  Both are then calibrated on labelled rows that neither has learnt from, and
their calibrated log-odds are combined to score every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import drop, park
from ._text import CHUNK, chunks, trim

#: Columns of the text view: hashed trigrams, then layout.
DIM, LAYOUT = 1024, 8
#: Columns of the page view: hashed source and language, then the length by powers of two.
SOURCES, LANGS, LENGTHS = 32, 8, 24
#: Labelled rows that the classifiers learn from, about.
LABELLED = 3000
ROUNDS = 4
#: Rows that a classifier labels for the other in a round, at most, and how sure it must be.
TAUGHT, SURE = 500, 0.9

_KIND = np.full(256, 5)
_KIND[[32, 9, 11, 12, 13]] = 0
_KIND[10] = 1
_KIND[65:91] = 2
_KIND[97:123] = 3
_KIND[48:58] = 4
_KIND[128:] = 6


def _says(raw: np.ndarray) -> np.ndarray:
    out, k = np.zeros(DIM), np.zeros(7)
    for at in range(0, len(raw), CHUNK):
        c = raw[at : at + CHUNK + 2].astype(np.uint32)
        code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
        out += np.bincount(code * np.uint32(2654435761) >> np.uint32(22), minlength=DIM)
        k += np.bincount(_KIND[raw[at : at + CHUNK]], minlength=7)
    n, letters = max(len(raw), 1), max(k[2] + k[3] + k[6], 1)
    layout = [np.log1p(n / (k[1] + 1)) / 10, k[1] / n, k[2] / letters, k[4] / n, k[5] / n, k[0] / n, k[6] / n, np.sqrt(k[5] / n)]
    return np.concatenate([np.sqrt(out / max(out.sum(), 1)), layout])


def _page(size: int, source: str | None, lang: str | None) -> np.ndarray:
    out = np.zeros(SOURCES + LANGS + LENGTHS)
    for at, n, v in ((0, SOURCES, source), (SOURCES, LANGS, lang)):
        out[at + zlib.crc32((v or "").encode()) % n] = 1
    out[SOURCES + LANGS + min(size.bit_length(), LENGTHS - 1)] = 1
    return out


def views(texts: pa.Array, sources: pa.Array, langs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text view, page view), a row each for each document."""
    a, b = np.zeros((len(texts), DIM + LAYOUT), np.float32), np.zeros((len(texts), SOURCES + LANGS + LENGTHS), np.float32)
    sources, langs = sources.to_pylist(), langs.to_pylist()
    for lo, _, buf, offs in chunks(texts):
        for r in range(len(offs) - 1):
            raw = buf[offs[r] : offs[r + 1]]
            a[lo + r], b[lo + r] = _says(raw), _page(len(raw), sources[lo + r], langs[lo + r])
    return a, b


@dataclass
class Logistic:
    """Logistic regression on standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 120) -> Logistic:
        """Accelerated gradient steps; both classes weigh alike."""
        mean = x.mean(0)
        scale = 1 / (x.std(0) + 0.05 * (x.std(0).max() + 1e-9))
        z = np.hstack([(x - mean) * scale, np.ones((len(x), 1))]).astype(np.float32)
        y = y.astype(np.float32)
        weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1)).astype(np.float32)
        bound = 0.25 * float(np.linalg.norm(z * np.sqrt(weight)[:, None])) ** 2 + penalty / len(x)
        w = v = np.zeros(z.shape[1], np.float32)
        for k in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
            new = v - np.float32(1 / bound) * ((weight * (p - y)) @ z + np.float32(penalty / len(x)) * v)
            v = new + np.float32(k / (k + 3)) * (new - w)
            w = new
        return cls(mean, scale, w[:-1], float(w[-1]))

    def odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * self.scale) @ self.w + self.b

    def sure(self, x: np.ndarray) -> np.ndarray:
        """Probability of the class 1."""
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -30, 30)))


@dataclass
class QualityModel:
    says: Logistic
    page: Logistic
    mix: np.ndarray

    def score(self, texts: pa.Array, sources: pa.Array, langs: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for at in range(0, len(texts), 512):
            a, b = views(texts.slice(at, 512), sources.slice(at, 512), langs.slice(at, 512))
            out[at : at + 512] = self.combine(a, b)
        return out

    def combine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.mix[0] + self.mix[1] * self.says.odds(a) + self.mix[2] * self.page.odds(b), -50, 50)))


def _platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a small logistic regression (intercept first), by damped Newton steps."""
    x = np.hstack([np.ones((len(z), 1)), z])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.1 * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), g)
    return w


#: Given the two classifiers, the text view and the page view of the unlabelled rows that each labels for the other, with their labels: ({"says": (a, b, y), "page": (a, b, y)}).
Teaching = Callable[[dict[str, Logistic]], dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]


def cotrain(a: np.ndarray, b: np.ndarray, y: np.ndarray, teach: Teaching, rounds: int = ROUNDS) -> QualityModel:
    """Co-train on the views a, b of labelled rows and on the unlabelled ones that teach() picks in each round.

    Every fifth labelled row is kept for calibration.
    """
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    own = {"says": [a[~held], y[~held]], "page": [b[~held], y[~held]]}
    for _ in range(rounds):
        taught = teach({k: Logistic.fit(*own[k]) for k in own})
        for teacher, other, view in (("says", "page", 1), ("page", "says", 0)):
            own[other] = [np.concatenate([own[other][0], taught[teacher][view]]), np.concatenate([own[other][1], taught[teacher][2]])]
    says, page = (Logistic.fit(*own[k]) for k in ("says", "page"))
    at = held if held.any() else ~held
    each = [_platt(m.odds(x[at])[:, None], y[at]) for m, x in ((says, a), (page, b))]
    z = np.stack([c[0] + c[1] * m.odds(x[at]) for c, m, x in zip(each, (says, page), (a, b))], 1)
    top = _platt(z, y[at])
    return QualityModel(says, page, np.array([top[0] + top[1] * each[0][0] + top[2] * each[1][0], top[1] * each[0][1], top[2] * each[1][1]]))


def _rows(docs: DataFrame, id: str, text: str, source: str, lang: str) -> DataFrame:
    """(id, key, text, source, lang) of the rows with an id and a text; the key is a hash of the first two."""
    base = docs.where(F.col(text).isNotNull() & F.col(id).isNotNull())
    return base.select(F.col(id).cast("string").alias("id"), F.xxhash64(F.col(id), text).alias("key"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"))


def _viewed(rows: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(keys, text view, page view, y) of the rows (key, text, source, lang, y), on the driver, in order of key; equal keys count once."""

    def vectors(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = np.hstack(views(part["text"], part["source"], part["lang"])).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part["key"], part["y"], pa.array([r.tobytes() for r in x], pa.binary())], ["key", "y", "x"])

    got = rows.select("key", "text", "source", "lang", "y").dropDuplicates(["key"]).mapInArrow(vectors, "key long, y int, x binary").toArrow()
    keys = got["key"].to_numpy()
    order = np.argsort(keys, kind="stable")
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, DIM + LAYOUT + SOURCES + LANGS + LENGTHS)[order].astype(np.float32)
    return keys[order].tolist(), x[:, : DIM + LAYOUT], x[:, DIM + LAYOUT :], got["y"].to_numpy()[order]


def _teaching(free: DataFrame, known: DataFrame, good: float, most: int) -> Teaching:
    """Each classifier scores all rows of free (id, key, text, source, lang) but those with an id in known; of those it is sure of, the ones of the smallest hash teach, each only once, in the classes' proportion good."""
    used: dict[str, list[int]] = {"says": [], "page": []}
    turn = 0

    def teach(model: dict[str, Logistic]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        nonlocal turn
        turn += 1
        spark = free.sparkSession
        sent = spark.sparkContext.broadcast(model)  # two weight vectors

        @F.arrow_udf("struct<says: float, page: float>")
        def scored(texts: pa.Array, sources: pa.Array, langs: pa.Array) -> pa.Array:
            out = np.zeros((2, len(texts)), np.float32)
            for at in range(0, len(texts), 512):
                both = views(texts.slice(at, 512), sources.slice(at, 512), langs.slice(at, 512))
                for k, (name, x) in enumerate(zip(("says", "page"), both)):
                    out[k, at : at + 512] = sent.value[name].sure(x)
            trim()
            return pa.StructArray.from_arrays(list(out), ["says", "page"])

        told = park(free.select("id", "key", scored("text", "source", "lang").alias("p")).select("id", "key", "p.*"), "scores")
        rows = told.join(known.select("id"), "id", "left_anti")
        picks = []
        for teacher in ("says", "page"):
            left = rows.where(~F.col("key").isin(used[teacher])) if used[teacher] else rows
            for label, p, share in ((1, F.col(teacher), good), (0, 1 - F.col(teacher), 1 - good)):
                sure = left.where(p >= SURE).select("key").distinct().orderBy(F.xxhash64(F.lit(turn), "key"), "key").limit(int(most * share))
                keys = [r[0] for r in sure.collect()]  # most at most
                used[teacher] += keys
                picks += [(k, teacher, label) for k in keys]
        drop(told)
        wanted = spark.createDataFrame(sorted({(k,) for k, _, _ in picks}), "key long")
        keys, a, b, _ = _viewed(free.join(F.broadcast(wanted), "key").withColumn("y", F.lit(-1)))  # 2 * most at most
        place = {k: i for i, k in enumerate(keys)}
        out = {}
        for teacher in ("says", "page"):
            at = [place[k] for k, t, _ in picks if t == teacher]
            out[teacher] = a[at], b[at], np.array([y for _, t, y in picks if t == teacher], np.int64)
        return out

    return teach


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", label: str = "quality", labelled: int = LABELLED, taught: int = TAUGHT, rounds: int = ROUNDS) -> QualityModel | None:
    """Co-train on about labelled labelled rows, taken by a hash of their ids (all if there are fewer), and on unlabelled rows.

    In each round both classifiers score all unlabelled rows, and taught rows at most
    of those that each is sure of are learnt by the other.  Several labels of one id
    count by their mean; rows with a null text, id or label teach nothing, rows
    equal in id and text teach once.  None if the labels hold one class only.
    """
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).cast("string").alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    base = _rows(docs, id, text, source, lang)
    share = min(1.0, labelled / max(known.count(), 1))
    sampled = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    _, a, b, y = _viewed(base.join(F.broadcast(sampled), "id"))  # of about labelled rows
    if len(set(y)) < 2:
        return None
    return cotrain(a, b, y, _teaching(base, known, float(y.mean()), taught), rounds)


def score(docs: DataFrame, model: QualityModel | None, text: str = "text", source: str = "source", lang: str = "lang", floor: float = 0.5) -> DataFrame:
    """docs with score (0 to 1, the probability of good quality) and kept (score of floor or more).

    A null or blank text scores 0; without a model all others score 0.5.  Columns
    of these names are replaced, all others stay; null sources and languages are
    values of their own.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two weight vectors

    @F.arrow_udf("double")
    def run(texts: pa.Array, sources: pa.Array, langs: pa.Array) -> pa.Array:
        out = sent.value.score(texts, sources, langs) if sent.value else np.full(len(texts), 0.5)
        trim()
        return pa.array(out)

    said = F.col(text).isNotNull() & F.col(text).rlike(r"\S")
    docs = docs.drop("score", "kept") if {"score", "kept"} & {c.lower() for c in docs.columns} else docs
    out = docs.withColumn("score", F.coalesce(F.when(said, run(F.col(text), F.col(source).cast("string"), F.col(lang).cast("string"))), F.lit(0.0)))
    return out.withColumn("kept", F.col("score") >= floor)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", "score", "kept")
