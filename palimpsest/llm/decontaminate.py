"""Benchmark decontamination by pigeonhole edit matching.

Each test item is one passage.  Of a long item, its parts and shorter stretches that
overlap are passages too, so that an excerpt is found as well.  A passage with an
error budget of k words is split into k + 1 pieces: text within k word edits of the
passage holds at least one piece unchanged.  Piece hashes are probed at every word of every
document; around each hit Myers' bit-parallel algorithm gives the edit distance of
the passage to the best-fitting stretch of the document, for all the hits of a batch
at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import _BASE, _BYTE, _SPACE, chunks, mix, span_hash, trim, words

#: Words of a passage; of a longer item, parts and stretches are passages as well.
PASSAGE = 60
#: Edits allowed per word of a passage.
ERROR_RATE = 0.1
#: Words that an item must have; more where very short items stand in texts by coincidence.
MIN_WORDS = 1
#: Bytes of test text that are broadcast at a time; a larger benchmark is matched in as many passes.
BLOCK_BYTES = 16 << 20
#: Windows that are taken at once, the words of their texts that are aligned at once, and windows from which that pays.
WINDOWS, CELLS, TOGETHER = 4096, 1 << 19, 16


def _tokens() -> tuple[np.ndarray, np.ndarray]:
    """Byte words and white space for words without ASCII punctuation: all ASCII but letters and digits separates."""
    space = np.zeros(256, bool)
    space[:128] = True
    for a, b in ((48, 58), (65, 91), (97, 123)):
        space[a:b] = False
    return _BYTE, space | _SPACE


_WORD, _BREAK = _tokens()


def folded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in full Unicode case folding (A-Z of a row without other letters is left to the byte table); bytes that aren't UTF-8 stay."""
    if not (buf > 127).any():
        return buf, offs
    rows = [buf[a:b].tobytes() for a, b in zip(offs, offs[1:])]
    rows = [r if r.isascii() else r.decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape") for r in rows]
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows])))


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each case-folded word, word offsets of the rows)."""
    buf, offs = folded(buf, offs)
    start, end, row = words(buf, offs, _BREAK)
    return span_hash(buf, start, end, _WORD), np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(offs) - 1))))


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n if len(out) else 0):
        out = out * np.uint64(_BASE) + h[k : k + len(out)]
    return mix(out)


def myers(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of pattern to any stretch of text, end of the first such stretch), by Myers' bit vectors over words."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern.tolist()):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, w in enumerate(text.tolist(), 1):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, at = score, j
    return best, at


def myers_all(patterns: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """myers() of each pattern, of 64 words at most, and its text: the bit vectors of all advance together, a word a step."""
    m, n = np.array([len(p) for p in patterns], np.int64), np.array([len(t) for t in texts], np.int64)
    best, ends = m.copy(), np.zeros(len(m), np.int64)
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    one, all64 = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    order = np.argsort(n, kind="stable")
    while len(order):
        # the longest texts left, as many as fill the cells
        k = order[-max(1, min(len(order), CELLS // max(int(n[order[-1]]), 1))) :]
        order = order[: len(order) - len(k)]
        p, t = np.zeros((len(k), 64), np.uint64), np.zeros((len(k), int(n[k].max())), np.uint64)
        p[np.arange(64) < m[k, None]] = np.concatenate([patterns[i] for i in k])
        t[np.arange(t.shape[1]) < n[k, None]] = np.concatenate([texts[i] for i in k])
        full, top = all64 >> (64 - m[k]).astype(np.uint64), one << (m[k] - 1).astype(np.uint64)
        pv, mv, score, low, at = full.copy(), np.zeros(len(k), np.uint64), m[k], m[k], np.zeros(len(k), np.int64)
        for j in range(t.shape[1]):
            eq = ((p == t[:, j, None]) * bit).sum(1, dtype=np.uint64) & full
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            score += ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0)
            ph, mh = ph << one & full, mh << one & full
            pv, mv = mh | (full & ~(xv | ph)), ph & xv
            less = (score < low) & (j < n[k])
            low[less], at[less] = score[less], j + 1
        best[k], ends[k] = low, at
    return best, ends


def _aligned(patterns: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """myers() of each pattern and its text."""
    best, ends = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
    together = np.flatnonzero([len(p) <= 64 for p in patterns])
    if len(together) >= TOGETHER:
        best[together], ends[together] = myers_all([patterns[k] for k in together], [texts[k] for k in together])
    else:
        together = together[:0]
    for k in np.setdiff1d(np.arange(len(patterns)), together):
        best[k], ends[k] = myers(patterns[k], texts[k])
    return best, ends


def _spans(n: int, size: int) -> list[tuple[int, int]]:
    """(first, end) of the passages of an item of n words: the whole item and, if it is longer than size words, the parts of at most size words that make it up and stretches of size // 2 that start size // 4 apart at most."""
    spans = [(0, n)]
    if n > size:
        parts = -(-n // size)
        spans += [(n * c // parts, n * (c + 1) // parts) for c in range(parts)]
        short = max(size // 2, 1)
        steps = -(-(n - short) // max(size // 4, 1))
        spans += [(a, a + short) for a in ((n - short) * c // steps for c in range(steps + 1))]
    return list(dict.fromkeys(spans))


class Passages:
    """The passages of a block of test items, with the sorted hashes of their pieces."""

    def __init__(self, ids: list[int], texts: pa.Array, rate: float = ERROR_RATE, size: int = PASSAGE, least: int = MIN_WORDS):
        item: list[int] = []
        own: list[int] = []  # number of the item in the block: ids may repeat
        number = -1
        self.words: list[np.ndarray] = []
        budget: list[int] = []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for lo, _, buf, offs in chunks(texts):
            h, wo = word_hashes(buf, offs)
            for r in range(len(offs) - 1):
                w = h[wo[r] : wo[r + 1]]
                if len(w) < max(least, 1) or ids[lo + r] is None:
                    continue
                number += 1
                for first, end in _spans(len(w), size):
                    p = w[first:end]
                    k = int(len(p) * rate)
                    cuts = [len(p) * i // (k + 1) for i in range(k + 2)]
                    for a, b in zip(cuts, cuts[1:]):
                        pieces.setdefault(b - a, []).append((int(_rolled(p[a:b], b - a)[0]), len(item), a))
                    item.append(ids[lo + r])
                    own.append(number)
                    self.words.append(p)
                    budget.append(k)
        self.item, self.number, self.budget = (np.array(x, np.int64) for x in (item, own, budget))
        self.length = np.array([len(p) for p in self.words], np.int64)
        self.pieces = {}
        for n, rows in pieces.items():
            key = np.array([r[0] for r in rows], np.uint64)
            order = np.argsort(key, kind="stable")
            self.pieces[n] = (key[order], np.array([r[1] for r in rows])[order], np.array([r[2] for r in rows])[order])

    def _windows(self, h: np.ndarray, wo: np.ndarray) -> np.ndarray:
        """Rows (row, passage, first word, end word) of the stretches around piece hits, those of one passage that touch being one."""
        found = [np.zeros((0, 4), np.int64)]
        for n, (key, owner, offset) in self.pieces.items():
            roll = _rolled(h, n)
            lo, hi = np.searchsorted(key, roll), np.searchsorted(key, roll, "right")
            at = np.flatnonzero(hi > lo)
            row = np.searchsorted(wo, at, "right") - 1
            inside = at + n <= wo[row + 1]
            at, row = at[inside], row[inside]
            many = hi[at] - lo[at]
            slot = np.repeat(lo[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            at, row, p = np.repeat(at, many), np.repeat(row, many), owner[slot]
            k, first = self.budget[p], at - offset[slot]
            start, end = np.maximum(wo[row], first - k), np.minimum(wo[row + 1], first + self.length[p] + k)
            # most hits of a passage's pieces give one window
            found.append(np.unique(np.stack([row, p, start, end], 1), axis=0))
        w = np.unique(np.concatenate(found), axis=0)
        if not len(w):
            return w
        group = np.concatenate(([0], np.cumsum((w[1:, 0] != w[:-1, 0]) | (w[1:, 1] != w[:-1, 1]))))
        # the furthest end so far within a group; groups are set apart by more than any place
        apart = group * (len(h) + 2)
        reach = np.maximum.accumulate(w[:, 3] + apart)
        new = np.concatenate(([True], w[1:, 2] + apart[1:] > reach[:-1]))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(w)])) - 1
        return np.stack([w[first, 0], w[first, 1], w[first, 2], (reach - apart)[last]], 1)

    def match(self, h: np.ndarray, wo: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, edits, first word, end word) of each item found in a row: its longest passage found, of these the one with the fewest edits, at its best stretch."""
        out: dict[tuple[int, int], tuple[tuple, tuple]] = {}
        windows = self._windows(h, wo)
        for lo in range(0, len(windows), WINDOWS):
            w = windows[lo : lo + WINDOWS]
            edits, end = _aligned([self.words[p] for p in w[:, 1]], [h[a:b] for a, b in w[:, 2:]])
            good = np.flatnonzero(edits <= self.budget[w[:, 1]])
            w, edits, end = w[good], edits[good], w[good, 2] + end[good]
            _, length = _aligned([self.words[p][::-1] for p in w[:, 1]], [h[a:b][::-1] for a, b in zip(w[:, 2], end)])
            for (r, p, _, _), d, e, n in zip(w.tolist(), edits.tolist(), end.tolist(), length.tolist()):
                rank = (-len(self.words[p]), d, e - n)
                if (one := (r, int(self.number[p]))) not in out or rank < out[one][0]:
                    out[one] = rank, (r, int(self.item[p]), d, e - n - int(wo[r]), e - int(wo[r]))
        return [row for _, row in out.values()]


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int):
    """Blocks of (ids, texts) of about block_bytes each, in turn through the driver."""
    ids: list[int] = []
    texts: list[str] = []
    held = 0
    for row in items.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long"), text).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        held += len(row[1])
        if held >= block_bytes:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def matches(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, passage: int = PASSAGE, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, edits, first_word, end_word): the test items in documents, each as a whole or else by its longest passage found, at its best stretch.

    Words are runs of letters, digits and non-ASCII characters, without case by
    Unicode's full folding.  An item of n words is found wherever a stretch of the document is
    within int(n * rate) word edits, so one of fewer than 1 / rate words as it is.
    Of an item of more than passage words, any run of 3 / 4 passage words is found
    too, as its parts and shorter stretches that overlap are passages.  Null and empty
    texts, items under min_words words and items with a null id match nothing; repeated documents each give
    their own rows; a document that holds an item several times gives one row.
    Extra columns are not looked at.
    """
    spark = docs.sparkSession
    out = None
    for ids, texts in _blocks(items, item_id, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(Passages(ids, pa.array(texts, pa.string()), rate, passage, min_words))  # of block_bytes of text

        def run(batches, sent=sent):
            for b in batches:
                rows = []
                own = b[id].to_pylist()
                for lo, _, buf, offs in chunks(b[text]):
                    rows += [(own[lo + r], *rest) for r, *rest in sent.value.match(*word_hashes(buf, offs))]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], [id, "item_id", "edits", "first_word", "end_word"])

        found = docs.select(F.col(id).cast("long").alias(id), F.col(text).cast("string").alias(text)).mapInArrow(run, f"{id} long, item_id long, edits int, first_word int, end_word int")
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], f"{id} long, item_id long, edits int, first_word int, end_word int") if out is None else out


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", **how) -> DataFrame:
    """The rows of docs whose text holds no passage of a test item; all columns stay, null texts stay."""
    spark = docs.sparkSession

    def clean(sent):
        @F.arrow_udf("boolean")
        def ok(column: pa.Array) -> pa.Array:
            keep = np.ones(len(column), bool)
            for lo, _, buf, offs in chunks(column):
                keep[[lo + r for r, *_ in sent.value.match(*word_hashes(buf, offs))]] = False
            trim()
            return pa.array(keep)

        return ok

    for ids, texts in _blocks(items, item_id, item_text, how.pop("block_bytes", BLOCK_BYTES)):
        sent = spark.sparkContext.broadcast(Passages(ids, pa.array(texts, pa.string()), **how))
        docs = docs.where(F.col(text).isNull() | clean(sent)(F.col(text)))
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
