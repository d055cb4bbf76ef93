"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text is cut where no piece can reach across: before a run of the space mark and
around characters that stand in no longer piece.  Each distinct unit of a batch is
segmented once; units of equal length advance together, one character a step:
hashes of all their substrings probe the sorted hashes of the pieces, and the
maximum over the piece lengths is kept with a backpointer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import _power, chunks, mix, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Score of an unknown character below the worst piece, as in the unigram model.
UNKNOWN_PENALTY = 10.0
#: Characters of units that are segmented at once.
CELLS = 1 << 16
#: Bytes of text whose distinct units are found at once, a longer text alone.
ENCODED = 2 << 20
#: Ids that are decoded at once, a longer text alone.
DECODED = 1 << 18
_MARK = 0x2581


def _prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the values along the last axis, for hashes of spans."""
    up, _ = _power(values.shape[-1])
    out = np.zeros((*values.shape[:-1], values.shape[-1] + 1), np.uint64)
    np.cumsum(values * up[: values.shape[-1]], axis=-1, dtype=np.uint64, out=out[..., 1:])
    return out


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of spans, one span after another."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Vocabulary:
    """Pieces as sorted hashes, and as bytes for decoding."""

    keys: np.ndarray
    key_id: np.ndarray
    key_score: np.ndarray
    bitmap: np.ndarray
    bucket: np.ndarray
    widest: int
    unknown: float
    unknown_id: int
    byte_id: np.ndarray
    joint: np.ndarray
    split_marks: bool
    longest: int
    piece_bytes: np.ndarray
    piece_at: np.ndarray
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Read a model file; pieces of a unigram model keep their scores.

        A BPE model has merge ranks in place of log-probabilities: a piece of rank r
        gets log(1 / (r + 2)), as by Zipf's law.  Only the identity normaliser is
        supported, without removal of extra white space.
        """
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces:
            raise ValueError("only models that keep text as it is are supported")
        return cls.build([(p.piece, p.score, p.type) for p in m.pieces], m.trainer_spec.model_type == 1, m.normalizer_spec.add_dummy_prefix)

    @classmethod
    def build(cls, pieces: list[tuple[str, float, int]], unigram: bool, dummy_prefix: bool = True) -> Vocabulary:
        """pieces: (piece, score, type) in order of id; types: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte."""
        normal = [(i, p) for i, (p, _, t) in enumerate(pieces) if t in (1, 4) and p]
        score = {i: pieces[i][1] for i, _ in normal}
        if not unigram:
            ranked = sorted(normal, key=lambda x: (-pieces[x[0]][1], x[0]))
            score = {i: -float(np.log(r + 2)) for r, (i, _) in enumerate(ranked)}
        hashes = []
        for _, p in normal:
            v = mix(np.array([ord(c) for c in p], np.uint64))
            hashes.append(mix(_prefix(v)[-1:] + np.uint64(len(p)))[0])
        keys = np.array(hashes, np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        if (keys[1:] == keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        bucket = np.searchsorted(keys, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)).astype(np.int32)
        bitmap = np.zeros(1 << 20, bool)
        bitmap[(keys >> np.uint64(44)).astype(np.int64)] = True
        joint = np.zeros(0x110000, bool)
        joint[[ord(c) for _, p in normal if len(p) > 1 for c in p]] = True
        byte_id = np.full(256, -1, np.int64)
        unknown_id = 0
        shown = []
        for i, (p, _, t) in enumerate(pieces):
            if t == 6:
                byte_id[int(p[3:5], 16)] = i
                shown.append(bytes([int(p[3:5], 16)]))
            elif t in (2, 3):
                unknown_id = i if t == 2 else unknown_id
                shown.append(" ⁇ ".encode() if t == 2 else b"")
            else:
                shown.append(p.replace("▁", " ").encode())
        return cls(
            keys=keys, key_id=np.array([i for i, _ in normal])[order], key_score=np.array([score[i] for i, _ in normal])[order],
            bitmap=bitmap, bucket=bucket, widest=int(np.diff(np.append(bucket, len(keys))).max()), unknown=min(score.values()) - UNKNOWN_PENALTY, unknown_id=unknown_id, byte_id=byte_id, joint=joint,
            split_marks=not any("▁" in p.lstrip("▁") for _, p in normal), longest=max(len(p) for _, p in normal),
            piece_bytes=np.frombuffer(b"".join(shown), np.uint8), piece_at=np.concatenate(([0], np.cumsum([len(s) for s in shown]))), dummy_prefix=dummy_prefix,
        )

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of h that are pieces' hashes, their indexes among the sorted keys)."""
        where = np.flatnonzero(self.bitmap[(h >> np.uint64(44)).view(np.int64)])
        h = h[where]
        at = self.bucket[(h >> np.uint64(48)).view(np.int64)]
        out = np.full(len(h), -1, np.int32)
        for k in range(self.widest):
            i = np.minimum(at + k, len(self.keys) - 1)
            out = np.where(self.keys[i] == h, i, out)
        ok = out >= 0
        return where[ok], out[ok]

    def segment(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentations of equally long units (a row of code points each): (ids one unit after another, how many in each).

        An id under 0 is an unknown character, -1 - code point.  Among equal scores the longer last piece wins.
        """
        m, n = cells.shape
        h = np.ascontiguousarray(_prefix(mix(cells.astype(np.uint64))).T)
        _, down = _power(n)
        score = np.full((n + 1, m), -np.inf)
        score[0] = 0
        step = np.zeros((n + 1, m), np.int32)
        piece = np.zeros((n + 1, m), np.int64)
        rows = np.arange(m)
        for i in range(1, n + 1):
            starts = np.arange(max(0, i - self.longest), i)
            sub = (h[i] - h[starts[0] : i]) * down[starts][:, None]
            sub += (i - starts).astype(np.uint64)[:, None]
            where, found = self.probe(mix(sub).ravel())
            key = np.full(sub.size, -1, np.int32)
            key[where] = found
            gain = np.full(sub.size, -np.inf)
            gain[where] = self.key_score[found]
            key, gain = key.reshape(sub.shape), gain.reshape(sub.shape)
            gain[-1][key[-1] < 0] = self.unknown
            gain += score[starts[0] : i]
            best = gain.argmax(0)
            score[i] = gain[best, rows]
            step[i] = i - starts[best]
            k = key[best, rows]
            piece[i] = np.where(k >= 0, self.key_id[k], -1 - cells[:, i - 1].astype(np.int64))
        out = np.zeros((m, n), np.int64)
        count = np.zeros(m, np.int64)
        at = np.full(m, n)
        while len(rows):
            out[rows, n - 1 - count[rows]] = piece[at[rows], rows]
            count[rows] += 1
            at[rows] -= step[at[rows], rows]
            rows = rows[at[rows] > 0]
        return out.ravel()[_ragged(np.arange(m) * n + n - count, count)], count

    def _bytes(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as their bytes' pieces, or as the unknown piece."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, count
        own = np.repeat(np.arange(len(count)), count)
        spelled = [self.byte_id[list(chr(-1 - c).encode("utf-8", "surrogatepass"))] for c in ids[odd].tolist()]
        spelled = [s if (s >= 0).all() else np.array([self.unknown_id]) for s in spelled]
        lens = np.ones(len(ids), np.int64)
        lens[odd] = [len(s) for s in spelled]
        ends = np.cumsum(lens)
        out = np.repeat(ids, lens)
        out[_ragged((ends - lens)[odd], lens[odd])] = np.concatenate(spelled)
        return out, np.bincount(own, weights=lens, minlength=len(count)).astype(np.int64)

    def encode(self, texts: pa.Array) -> pa.Array:
        """list<int32> of each text; null for null, empty for empty."""
        values, lens = [], np.zeros(len(texts), np.int64)
        for lo, hi, buf, offs in chunks(texts, ENCODED):
            cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            head = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[offs]
            full = np.diff(head) > 0
            cp = np.where(cp == 32, np.uint32(_MARK), cp)
            if self.dummy_prefix:
                cp = np.insert(cp, head[:-1][full], np.uint32(_MARK))
                head = head + np.concatenate(([0], np.cumsum(full)))
            if not len(cp):
                continue
            alone = ~self.joint[cp]
            mark = cp == _MARK
            start = np.zeros(len(cp), bool)
            start[head[:-1][full]] = True
            start |= alone & ~mark
            start[1:] |= alone[:-1]
            if self.split_marks:
                start[1:] |= mark[1:] & ~mark[:-1]
            s = np.flatnonzero(start)
            n = np.diff(np.append(s, len(cp)))
            sums = _prefix(mix(cp.astype(np.uint64)))
            _, down = _power(len(cp))
            h = mix((sums[s + n] - sums[s]) * down[s] + n.astype(np.uint64))
            del sums
            _, first, back = np.unique(h, return_index=True, return_inverse=True)
            ids, count = self._units(cp, s[first], n[first])
            at = np.cumsum(count) - count
            own = count[back]
            values.append(ids[_ragged(at[back], own)].astype(np.int32))
            lens[lo:hi] = np.bincount(np.searchsorted(head, s, "right") - 1, weights=own, minlength=hi - lo)
        ends = np.concatenate(([0], np.cumsum(lens)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32)), mask=texts.is_null() if texts.null_count else None)

    def _units(self, cp: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segmentations of units, in their order: (ids, how many in each)."""
        parts, rows = [], []
        order = np.argsort(n, kind="stable")
        cuts = np.flatnonzero(np.diff(n[order], prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            length = int(n[order[a]])
            for at in range(a, b, max(1, CELLS // length)):
                own = order[at : min(b, at + max(1, CELLS // length))]
                parts.append(self._bytes(*self.segment(cp[start[own][:, None] + np.arange(length)])))
                rows.append(own)
        ids, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        at, rows = np.cumsum(count) - count, np.concatenate(rows)
        place = np.empty(len(rows), np.int64)
        place[rows] = np.arange(len(rows))
        return ids[_ragged(at[place], count[place])], count[place]

    def decode(self, lists: pa.Array) -> pa.Array:
        """Text of each list of ids; null for null.  Ids outside the vocabulary count as unknown, bytes that aren't UTF-8 as U+FFFD."""
        out = []
        valid = lists.is_valid().to_numpy(zero_copy_only=False).tolist()
        ends = lists.offsets.to_numpy().astype(np.int64)
        all_ids = lists.values
        lo = 0
        while lo < len(lists):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + DECODED, "right")) - 1)
            ids = all_ids.slice(ends[lo], ends[hi] - ends[lo]).fill_null(-1).to_numpy(zero_copy_only=False)
            ids = np.where((ids < 0) | (ids >= len(self.piece_at) - 1), self.unknown_id, ids).astype(np.int64)
            size = self.piece_at[ids + 1] - self.piece_at[ids]
            raw = self.piece_bytes[_ragged(self.piece_at[ids], size)].tobytes()
            at = np.concatenate(([0], np.cumsum(size)))[ends[lo : hi + 1] - ends[lo]].tolist()
            for a, b, ok in zip(at, at[1:], valid[lo:hi]):
                t = raw[a:b]
                out.append((t[1:] if self.dummy_prefix and t[:1] == b" " else t).decode("utf-8", "replace") if ok else None)
            lo = hi
        return pa.array(out, pa.string())


def _sent(spark: SparkSession, model: str | Vocabulary):
    return spark.sparkContext.broadcast(Vocabulary.load(model) if isinstance(model, str) else model)  # tens of thousands of pieces


def encode(docs: DataFrame, model: str | Vocabulary = MODEL, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with ids, the piece ids of each text by the best sum of piece scores.

    A null text has null ids, an empty one none.  Characters without a piece become
    byte pieces, so that decoding gives the text back, except that U+2581 comes
    back as a space.  The column named ids is replaced, all others stay.
    """
    sent = _sent(docs.sparkSession, model)

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        out = sent.value.encode(column)
        trim()
        return out

    return docs.withColumn(ids, run(F.col(text)))


def decode(rows: DataFrame, model: str | Vocabulary = MODEL, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """rows with text, decoded from ids; null for null."""
    sent = _sent(rows.sparkSession, model)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        out = sent.value.decode(column)
        trim()
        return out

    return rows.withColumn(text, run(F.col(ids)))


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Ids of every document, and whether they decode to the text they came from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decode(encode(docs, model), model, text="decoded")
    return out.select("doc_id", F.coalesce(F.size("token_ids"), F.lit(0)).alias("n_tokens"), "token_ids", F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))
