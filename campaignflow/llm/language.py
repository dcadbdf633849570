"""Language identification with bit-sliced Bloom filters of n-grams.

Every n-gram of four bytes has, in a table of bit masks, a row per hash function; the AND of its rows has a bit for each
language whose filter holds the n-gram. Per document, the bits are counted by language, the counts are corrected for the
filters' own false positives, and the largest decides. A language's filter holds the n-grams that make up at least
MIN_SHARE of its training text, counted over all of it, so it has 1 / MIN_SHARE n-grams at most.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignflow.llm import common as c

GRAM = 4
MIN_SHARE = 2e-5
ROW_BITS = 20
FACTORS = (0x9E3779B1, 0x85EBCA77)
SLICE = 1 << 22
UNKNOWN = "und"

#: Letters in lower case; every other ASCII byte is a space.
PLAIN = np.array([i if i >= 128 or 97 <= i <= 122 else i + 32 if 65 <= i <= 90 else 32 for i in range(256)], np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some texts, with runs of spaces as one and a space at each end, and the text that each belongs to."""
    n_texts = len(offsets) - 1
    text = np.repeat(np.arange(n_texts), np.diff(offsets))
    out = np.full(len(data) + n_texts + 1, 32, np.uint8)
    out[np.arange(len(data)) + text + 1] = PLAIN[data]
    border = np.zeros(len(out), bool)
    border[offsets + np.arange(n_texts + 1)] = True
    space = out == 32
    keep = border.copy()
    keep[0] = True
    keep[1:] |= ~(space[1:] & space[:-1])
    out, border = out[keep], border[keep]
    if len(out) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    nth = np.cumsum(border, dtype=np.int32)
    size = len(out) - GRAM + 1
    wide = out.astype(np.uint32)
    value = wide[:size] | wide[1:size + 1] << np.uint32(8) | wide[2:size + 2] << np.uint32(16) | wide[3:] << np.uint32(24)
    whole = nth[2:size + 2] == nth[:size]
    return value[whole], nth[:size][whole].astype(np.int64) - 1


def slices(offsets: np.ndarray):
    """Ranges of texts of about SLICE bytes together."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield at, to
        at = to


def gram_counts(batches):
    """Batches of (lang, text) to (lang, gram, n), added up over the partition before anything is sent."""
    seen: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        data, offsets = c.text_buffer(batch.column(1))
        for at, to in slices(offsets):
            value, text = grams(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
            own = langs[at:to]
            for lang in set(own):
                some, n = np.unique(value[(own == lang)[text]], return_counts=True)
                if lang in seen:
                    keys, index = np.unique(np.concatenate([seen[lang][0], some]), return_inverse=True)
                    n = np.bincount(index, np.concatenate([seen[lang][1], n])).astype(np.int64)
                    some = keys
                seen[lang] = [some, n.astype(np.int64)]
    for lang, (value, n) in seen.items():
        for at in range(0, len(value), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(value[part]), pa.string()), pa.array(value[part].astype(np.int64)), pa.array(n[part])], names=["lang", "gram", "n"])


class Filters:
    """Bit-sliced filters of several languages; ``rows[i]`` has a bit for each language."""

    def __init__(self, langs: list[str], values: list[np.ndarray]):
        self.langs = langs
        n_words = -(-max(1, len(langs)) // 64)
        kind = np.uint8 if len(langs) <= 8 else np.uint32 if len(langs) <= 32 else np.uint64
        self.rows = np.zeros((n_words, 1 << ROW_BITS), kind)
        self.wrong = np.zeros(len(langs))
        for i, value in enumerate(values):
            bit = self.rows.dtype.type(1 << (i % 64))
            hashes = self.hashes(np.asarray(value, np.uint32))
            for h in hashes:
                self.rows[i // 64][h] |= bit
            # Chance that all rows of an n-gram which the language lacks have its bit.
            self.wrong[i] = ((self.rows[i // 64] & bit) != 0).mean() ** len(hashes)

    @staticmethod
    def hashes(value: np.ndarray) -> list[np.ndarray]:
        mixed = value ^ (value >> np.uint32(15))
        return [(mixed * np.uint32(f)) >> np.uint32(32 - ROW_BITS) for f in FACTORS]

    def counts(self, value: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
        """n_texts x languages: n-grams that each language holds, corrected for false positives."""
        total = np.bincount(text, minlength=n_texts)
        hashes = self.hashes(value)
        out = np.zeros((n_texts, len(self.langs)))
        for w, rows in enumerate(self.rows):
            mask = rows[hashes[0]]
            for h in hashes[1:]:
                mask = mask & rows[h]
            for i in range(64 * w, min(len(self.langs), 64 * w + 64)):
                found = np.bincount(text[(mask & rows.dtype.type(1 << (i % 64))) != 0], minlength=n_texts)
                out[:, i] = (found - total * self.wrong[i]) / (1 - self.wrong[i]) if self.wrong[i] < 1 else 0
        return np.clip(out, 0, None)


def learn(documents: DataFrame) -> Filters:
    """Filters from (lang, text) rows; null languages and texts are left out. Languages are in order of training text, most first."""
    rows = documents.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = c.written(rows.mapInArrow(gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= MIN_SHARE * F.col("total"))  # a row per language
    # At most 1 / MIN_SHARE rows per language reach the driver.
    found = frequent.groupBy("lang").agg(F.first("total").alias("total"), F.collect_list("gram").alias("grams")).collect()
    found.sort(key=lambda r: (-r["total"], r["lang"].encode()))
    return Filters([r["lang"] for r in found], [np.array(r["grams"], np.int64) for r in found])


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Is the CRC-32 of the id as text in ``fold``? A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def predict(documents: DataFrame, filters: Filters) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, lang_pred, score (share of the text's n-grams that the language holds).

    ``und`` with score 0 for null texts, texts without a letter, and if no language was learned. Of equal counts, the language
    with more training text wins. Texts of any length count whole; repeated rows are predicted alike.
    """
    shared = documents.sparkSession.sparkContext.broadcast(filters)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"), F.col("text").cast("string").alias("text"))

    def run(batches):
        own = shared.value
        names = np.array([*own.langs, UNKNOWN], object)
        for batch in batches:
            data, offsets = c.text_buffer(batch.column(3))
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for at, to in slices(offsets):
                value, text = grams(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
                total = np.maximum(np.bincount(text, minlength=to - at), 1)
                if own.langs:
                    counts = own.counts(value, text, to - at)
                    best.append(counts.argmax(axis=1))
                    score.append(np.minimum(counts.max(axis=1) / total, 1.0))
                else:
                    best.append(np.full(to - at, -1))
                    score.append(np.zeros(to - at))
            letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            pick = np.where(letter, np.concatenate(best), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names[pick], pa.string()), pa.array(np.where(pick < 0, 0.0, np.concatenate(score)))],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(documents: DataFrame) -> DataFrame:
    """``predict`` for all rows, learned from those that are not held out."""
    training = documents.where(~held_out(F.col("doc_id"), 5, 0))
    return predict(documents, learn(training))
