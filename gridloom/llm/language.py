"""Language identification with bit-sliced Bloom filters over character n-grams.

A slot of the filter is a bit mask over the learned languages. An n-gram's slots, ANDed, tell all languages that contain it in
one lookup. Over a text, each language's hits are counted (popcounts of the masks), the share that false positives alone
would give is taken off, and what is left, relative to what the language's own texts reach, decides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import replaced, written

UNKNOWN = "und"
#: Hash functions of the filter, and its slots (a power of two) for each n-gram of the language that has most of them, and in all.
HASHES, ROOM, FEWEST = 2, 16, 1 << 16
#: Hits count as evidence for the score from so many standard deviations of what false positives alone would give.
NOISE = 3.0
#: Lengths of n-grams, with a blank for a word's edge.
LENGTHS = (3, 4, 5)
#: Fitting reads the labelled documents whose hash is lowest, about so many at most; prediction reads all.
FIT_DOCUMENTS = 40_000
#: A language contains an n-gram that makes up at least this part of all its texts' n-grams (so there are 1 / LEAST of them at
#: most, whatever the corpus), and whose share is at least PART of the highest share in any language.
LEAST, PART = 1e-5, 0.35
#: Languages of one model at most, so that what the driver sends out is bounded; more raise. Parts by which rows are dealt.
MOST, DEALT = 4096, 1 << 40

#: Odd multipliers that mix characters into a 64-bit hash.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@lru_cache(1)
def letters() -> np.ndarray:
    """By code point: whether it is a letter (category L)."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def gram_hashes(text: str | None) -> np.ndarray | None:
    """64-bit hashes of the text's n-grams; None if it has no letter.

    The text is lower-cased; whatever isn't a letter is a blank. An n-gram is n characters of which only the first or the
    last may be a blank.
    """
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32).astype(np.uint64)
    codes, letter = np.concatenate(([32], codes, [32])).astype(np.uint64), np.concatenate(([False], letter, [False]))
    out = []
    for n in LENGTHS:
        m = len(codes) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, np.uint64)
        inside = np.ones(m, bool)
        for j in range(n):
            h += codes[j : j + m] * MULTIPLIERS[j]
            if 0 < j < n - 1:
                inside &= letter[j : j + m]
        h = h[inside]
        h ^= h >> np.uint64(29)
        h *= MULTIPLIERS[1]
        h ^= h >> np.uint64(32)
        out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def slots_of(h: np.ndarray, slots: int) -> list[np.ndarray]:
    low, high = h & np.uint64(slots - 1), h >> np.uint64(43)
    return [((low + np.uint64(i) * high) & np.uint64(slots - 1)).astype(np.int64) for i in range(HASHES)]


def slot_columns(gram: Column, slots: int) -> Column:
    """slots_of as a column: an array of the n-gram's slots."""
    low, high = gram.bitwiseAND(F.lit(slots - 1)), F.shiftrightunsigned(gram, 43)
    return F.array(*[(low + i * high).bitwiseAND(F.lit(slots - 1)) for i in range(HASHES)])


@dataclass
class Model:
    """languages, the filter (a row of 64-bit words a slot, one byte for up to eight languages), false positive rates, and the
    share of n-grams that a text of the language itself reaches."""

    languages: list[str]
    table: np.ndarray
    false: np.ndarray
    reach: np.ndarray

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected number of n-grams that each language contains, and whether it stands out of the false positives."""
        rows = [self.table[s] for s in slots_of(h, len(self.table))]
        masks = rows[0]
        for more in rows[1:]:
            masks = masks & more
        n = len(self.languages)
        if n <= 8:
            values = np.bincount(masks[:, 0].astype(np.int64), minlength=1 << n)
            found = np.array([values[(np.arange(1 << n) >> k) & 1 == 1].sum() for k in range(n)])
        else:
            found = np.array([np.count_nonzero(masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(n)])
        more = found - len(h) * self.false
        return np.maximum(0.0, more / (1 - self.false)), more > NOISE * np.sqrt(len(h) * self.false * (1 - self.false))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the winner's part of all languages' evidence; of equal evidence, and without any, the language that
        sorts first. Evidence that false positives may have made scores 0."""
        h = gram_hashes(text)
        if h is None or not self.languages:
            return UNKNOWN, 0.0
        if not len(h):
            return self.languages[0], 0.0
        found, sure = self.hits(h)
        share = found / (len(h) * self.reach)
        best = int(share.argmax())
        return self.languages[best], min(1.0, float(share[best]) / float(share.sum())) if sure[best] else 0.0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a partition; emitted in parts so that the table stays bounded."""
    waiting: dict[str, list[np.ndarray]] = {}
    size = 0

    def emit() -> Iterator[pa.RecordBatch]:
        for lang, parts in waiting.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            if (h := gram_hashes(text.as_py())) is not None:
                waiting.setdefault(lang.as_py(), []).append(h)
                size += len(h)
                if size > 1_000_000:
                    yield from emit()
                    waiting, size = {}, 0
    yield from emit()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = FIT_DOCUMENTS) -> Model:
    """A model of the non-null values of lang. Rows are taken by the hash of key below a bound that gives about `most` rows
    (all, if there are no more); their texts, however long, are read whole. Null texts and texts without a letter teach
    nothing; an empty table, or one without labels, gives a model without languages. A language's n-grams are weighed by
    their share of its texts, so the same rule holds for any size of table, and every labelled language with an n-gram is
    learned. The driver gets a row a language, and the filter's filled slots."""
    rows = labelled.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    n = rows.count()
    share = min(1.0, most / n) if n else 0.0
    chosen = rows if share >= 1 else rows.where(F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(DEALT)) < F.lit(int(share * DEALT)))
    counts = chosen.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).mapInArrow(_counts, "lang string, gram long, n long")
    summed = written(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r.lang: r.t for r in summed.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    languages = sorted(totals)
    if len(languages) > MOST:
        raise ValueError(f"{len(languages)} languages; a model holds {MOST} at most")
    if not languages:
        return Model([], np.zeros((1, 1), np.uint64), np.zeros(0), np.zeros(0))
    numbered = summed.sparkSession.createDataFrame([(lang, k, float(totals[lang])) for k, lang in enumerate(languages)], "lang string, k int, total double")
    shares = summed.join(F.broadcast(numbered), "lang").withColumn("share", F.col("n") / F.col("total"))  # a row a language
    frequent = shares.where(F.col("share") >= LEAST).withColumn("top", F.max("share").over(Window.partitionBy("gram")))
    members = written(frequent.where(F.col("share") >= PART * F.col("top")).select("k", "gram", "n"), "members")
    sizes = {r.k: r for r in members.groupBy("k").agg(F.count("*").alias("grams"), F.sum("n").alias("n")).collect()}
    slots = max(FEWEST, 1 << (ROOM * max(r.grams for r in sizes.values()) - 1).bit_length())
    words = 1 if len(languages) <= 8 else -(-len(languages) // 64)
    filled = members.select((F.col("k") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, k % 64)").alias("bit"), F.explode(slot_columns(F.col("gram"), slots)).alias("slot"))
    filled = filled.groupBy("slot", "word").agg(F.bit_or("bit").alias("mask")).toPandas()
    table = np.zeros((slots, words), np.uint64)
    table[filled["slot"].to_numpy(np.int64), filled["word"].to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64).view(np.uint64)
    used = np.array([np.count_nonzero(table[:, k // 64] & np.uint64(1 << k % 64)) for k in range(len(languages))]) / slots
    reach = np.array([sizes[k].n / totals[lang] if k in sizes else 0.0 for k, lang in enumerate(languages)])
    return Model(languages, table.astype(np.uint8) if len(languages) <= 8 else table, used**HASHES, np.maximum(reach, 1e-9))


def lettered(text: Column) -> Column:
    """Whether a text holds a letter (category L)."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text", predicted: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with lang_pred (a learned language; und if the text is null or has no letter, or nothing was learned) and score
    (0 to 1). The text alone decides, whole however long; equal evidence goes to the language that sorts first, and repeated
    rows get equal answers. An empty table gives an empty one. Other columns stay, those of the two names are replaced. No
    shuffle; the model's size is bounded by 1 / LEAST n-grams a language, not by the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            said = [model.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], ["lang_pred", "score"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # not deterministic for the planner alone: a filter on the prediction would be computed beside it a second time
    predict = F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()
    base = replaced(docs, [predicted, score, "_said"])
    said = base.withColumn("_said", predict(F.col(f"`{text}`")))
    return said.select(*[F.col(f"`{c}`") for c in base.columns], F.col("_said.lang_pred").alias(predicted), F.col("_said.score").alias(score))


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 0 by 5; a null id isn't held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))
