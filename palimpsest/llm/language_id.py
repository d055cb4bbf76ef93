"""Language identification by hierarchical discrimination.

A text's family is decided first, then one-versus-one linear support vector
machines tell the languages of that family apart.  Features are hashed letter
trigrams of the whole text; the machines are fitted on the driver on a bounded
sample of labelled rows and applied in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import unused
from ._text import CHUNK, chunks, trim

# Families of ISO 639-1 codes; a code that isn't listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic",
}

#: Hashed trigram features.
DIM = 4096
#: Labelled rows of each language that the machines are fitted on, about.
ROWS_PER_LANGUAGE = 800
#: Languages that are learnt at most, the most frequent ones: labels may be dirty without end.
LANGUAGES = 256


def _letter_classes() -> np.ndarray:
    t = np.zeros(256, np.uint32)
    t[97:123] = np.arange(1, 27)
    t[65:91] = t[97:123]
    t[128:] = 27 + np.arange(128) % 37
    return t


_CLASS = _letter_classes()


def _counts(raw: np.ndarray) -> np.ndarray:
    """Trigram counts of one text's bytes, in pieces, so that a text of any length fits."""
    out = np.zeros(DIM)
    for at in range(0, max(len(raw) - 2, 0), CHUNK):
        c = _CLASS[raw[at : at + CHUNK + 2]]
        code = (c[:-2] << np.uint32(12)) | (c[1:-1] << np.uint32(6)) | c[2:]
        code = code[code != 0] * np.uint32(2654435761) >> np.uint32(20)
        out += np.bincount(code, minlength=DIM)
    return out


def features(texts: pa.Array) -> np.ndarray:
    """A row of length 1 for each text: square roots of trigram shares; nothing for a null or very short text."""
    out = np.zeros((len(texts), DIM), np.float32)
    for lo, _, buf, offs in chunks(texts):
        for r in range(len(offs) - 1):
            n = _counts(buf[offs[r] : offs[r + 1]])
            out[lo + r] = np.sqrt(n / max(n.sum(), 1))
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 150) -> tuple[np.ndarray, float, float]:
    """(weights, bias, slope) of a linear SVM with squared hinge loss, by accelerated gradient steps; y is +1 or -1.

    Rows weigh so that both sides count alike.  The slope turns margins into
    probabilities; it is fitted on every fifth row, which the machine it belongs
    to has not seen.
    """

    def machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
        weight = (np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * c * 10).astype(np.float32)
        y = y.astype(np.float32)
        rate = np.float32(1.0 / (1.0 + 2 * weight.sum() * 2))
        w, v = np.zeros(x1.shape[1], np.float32), np.zeros(x1.shape[1], np.float32)
        for k in range(steps):
            slack = np.maximum(0, 1 - y * (x1 @ v))
            new = v - rate * (v - 2 * ((weight * slack * y) @ x1))
            v = new + np.float32(k / (k + 3)) * (new - w)
            w = new
        return w[:-1], float(w[-1])

    held = np.arange(len(y)) % 5 == 4
    slope = 2.0
    if len(set(y[~held])) == 2 and held.any():
        w, b = machine(x[~held], y[~held])
        z = y[held] * (x[held] @ w + b)
        grid = np.linspace(0.5, 12, 47)
        slope = float(grid[np.argmin([np.logaddexp(0, -g * z).mean() for g in grid])])
    return (*machine(x, y), slope)


@dataclass
class Machines:
    """One-versus-one machines between the names of one level."""

    names: list[str]
    w: np.ndarray = field(default_factory=lambda: np.zeros((DIM, 0), np.float32))
    b: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slope: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def fit(cls, x: np.ndarray, names: np.ndarray) -> Machines:
        own = sorted(set(names))
        parts = []
        for p, q in combinations(own, 2):
            rows = (names == p) | (names == q)
            parts.append(fit_svm(x[rows], np.where(names[rows] == p, 1.0, -1.0)))
        if not parts:
            return cls(own)
        return cls(own, np.stack([p[0] for p in parts], 1).astype(np.float32), np.array([p[1] for p in parts]), np.array([p[2] for p in parts]))

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the name with most wins, least probability against another name); ties go to the larger sum of margins, then to the first name."""
        k = len(self.names)
        wins, margin, least = np.zeros((len(x), k)), np.zeros((len(x), k)), np.ones((len(x), k))
        z = x @ self.w + self.b
        for j, (p, q) in enumerate(combinations(range(k), 2)):
            prob = 1 / (1 + np.exp(-np.clip(self.slope[j] * z[:, j], -50, 50)))
            for i, sign, pr in ((p, 1, prob), (q, -1, 1 - prob)):
                wins[:, i] += sign * z[:, j] > 0
                margin[:, i] += sign * z[:, j]
                least[:, i] = np.minimum(least[:, i], pr)
        best = np.lexsort((-np.arange(k)[None, :].repeat(len(x), 0), margin, wins), axis=1)[:, -1] if k else np.zeros(len(x), int)
        return best, least[np.arange(len(x)), best] if k else np.zeros(len(x))


@dataclass
class LanguageModel:
    family: Machines
    within: dict[str, Machines]

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each text."""
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        for at in range(0, len(texts), 512):
            x = features(texts.slice(at, 512))
            if not self.family.names:
                break
            fam, p = self.family.decide(x)
            for i, name in enumerate(self.family.names):
                rows = np.flatnonzero(fam == i)
                if len(rows):
                    best, q = self.within[name].decide(x[rows])
                    lang[at + rows] = np.array(self.within[name].names, object)[best]
                    score[at + rows] = p[rows] * q
        return lang, score


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: Column | None = None, rows_per_language: int = ROWS_PER_LANGUAGE, languages: int = LANGUAGES, families: Mapping[str, str] = FAMILIES) -> LanguageModel:
    """Fit on about rows_per_language rows of each language, all if there are fewer.

    The sample is the rows whose hash of key (default: of the whole row) falls
    under the language's share, so it is the same for any partitioning.  Rows with
    a null text or language, and those of other languages than the languages most
    frequent ones, are left out; without rows the model answers ``und``.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    have = {r[0]: r[1] for r in rows.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(languages).collect()}
    if not have:
        return LanguageModel(Machines([]), {})
    key = F.xxhash64(*[F.col(c) for c in rows.columns]) if key is None else F.xxhash64(key)
    share = F.try_element_at(F.create_map(*[F.lit(v) for k, n in have.items() for v in (k, min(1.0, rows_per_language / n))]), F.col(lang))
    sample = rows.where(F.pmod(key, F.lit(1 << 30)) < share * (1 << 30)).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.pmod(key, F.lit(1 << 30)).alias("k"))

    def vectors(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x = features(part["text"])
                yield pa.RecordBatch.from_arrays([part["lang"], part["k"], pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["lang", "k", "x"])

    got = sample.mapInArrow(vectors, "lang string, k long, x binary").toArrow()
    order = np.lexsort((got["lang"].to_numpy(), got["k"].to_numpy()))
    names = got["lang"].to_numpy()[order].astype(object)
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, DIM)[order].astype(np.float32)
    fam = np.array([families.get(n, n) for n in names], object)
    return LanguageModel(Machines.fit(x, fam), {f: Machines.fit(x[fam == f], names[fam == f]) for f in sorted(set(fam))})


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1, the weakest decision's probability at either level, multiplied).

    lang_pred is ``und`` and the score 0 for a text that is null or has no letter.
    Columns of these two names are replaced; all others stay as they are.  Equal
    texts get equal answers whatever else the rows hold; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few machines of DIM weights

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        lang, score = sent.value.predict(texts)
        trim()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    letter = F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}")
    found = F.when(letter, predict(F.col(text)))
    both = unused(docs, "found")
    return docs.withColumn(both, found).withColumns({"lang_pred": F.coalesce(F.col(both)["lang_pred"], F.lit("und")), "score": F.coalesce(F.col(both)["score"], F.lit(0.0))}).drop(both)


def keep_identified(docs: DataFrame, model: LanguageModel, floor: float = 0.4, text: str = "text") -> DataFrame:
    """The rows whose language is told with a score of floor at least, with their own columns only."""
    return identify(docs, model, text).where((F.col("lang_pred") != "und") & (F.col("score") >= floor)).select(*docs.columns)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may teach: their language is known and the CRC-32 of their id, modulo 3, isn't 1."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_fold(docs) != 1))


def _fold(docs: DataFrame) -> Column:
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))) % 3


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(training_rows(docs), key=F.col("doc_id"))
    return identify(docs.select("doc_id", (_fold(docs) == 1).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
