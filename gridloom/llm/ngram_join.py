"""Similarity join of documents on the Jaccard index of their word n-grams: MinHash banding, then verification on full sets.

Documents with one n-gram set are a class and stand for each other. Every class's MinHash signature is cut into bands; classes
that agree in a band meet in that band's bucket. A pair is verified on its full n-gram sets in the first band in which it
agrees, and buckets whose members all agree in an earlier band are left to that one. Large buckets are cut into blocks, each
pair of blocks being a piece of work of its own; a piece of work yields, for each of its classes, the number of its links
and a root that keeps the links' connectivity, so no pair is ever a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of, written
from .components import components

#: Words of an n-gram and the least Jaccard index of a link.
WORDS, SIMILAR = 5, 0.8
#: A pair at the threshold agrees in at least one band with this probability; pairs above it with a higher one.
RECALL = 0.9995
#: Rows of a band. More rows bring fewer false candidates and need more hash functions.
ROWS = 5
#: A piece of work: classes in a block, and n-grams in it.
BLOCK, BLOCK_GRAMS = 256, 1 << 20
#: Words whose hashes a task keeps; a full table starts anew.
KEPT, KEPT_LENGTH = 100_000, 64
#: Bits of the largest bitmap of wanted keys, 16 MB.
FILTER = 1 << 27
#: Keys that a task remembers to send each set once; a full memory starts anew.
SENT = 200_000
#: Columns of one dense step in counting common n-grams.
STEP = 4096



@lru_cache(8)
def multipliers(n: int) -> np.ndarray:
    """n odd multipliers, for a word's hash by its place in the n-gram and for a row's by its place in the band."""
    return np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(n)], np.uint64)


#: Odd multipliers that mix a hash.
MIX = (multipliers(8)[7], multipliers(8)[3])


def bands_for(similar: float, rows: int, recall: float) -> int:
    """The fewest bands of so many rows that reach the recall at the threshold: 1 - (1 - similar ** rows) ** bands."""
    n = 1
    while 1 - (1 - similar**rows) ** n < recall:
        n += 1
    return n


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[word] = h
        return h


def gram_set(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word n-grams; a text of fewer words, but not none, has one n-gram."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    m, places = max(1, len(h) - n + 1), multipliers(n)
    out = np.zeros(m, np.uint64)
    for j in range(min(n, len(h))):
        out += h[j : j + m] * places[j]
    out ^= out >> np.uint64(31)
    out *= MIX[0]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def set_key(grams: np.ndarray) -> bytes | None:
    """128 bits that stand for the set; None for an empty one."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


@lru_cache(4)
def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    return random.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, k, np.uint64)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    a, b = permutations(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(grams), 1024):
        part = grams[start : start + 1024, None] * a
        part += b
        part ^= part >> np.uint64(32)
        part *= MIX[1]
        np.minimum(least, part.min(axis=0), out=least)
    mixed = (least.reshape(bands, rows) >> np.uint64(8)) * multipliers(rows)
    return np.bitwise_xor.reduce(mixed ^ mixed >> np.uint64(27), axis=1)


def signed(docs: DataFrame, doc_id: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key binary (null without n-grams), grams int, bands binary; one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            keys, counts, marks = [], [], []
            for t in batch.column(1):
                grams = gram_set(t.as_py(), n, known)
                keys.append(set_key(grams))
                counts.append(len(grams))
                marks.append(band_hashes(grams, bands, rows).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), pa.array(marks, pa.binary())], ["doc_id", "key", "grams", "bands"])

    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, key binary, grams int, bands binary")


def keyed(docs: DataFrame, text: str, n: int, name: str) -> DataFrame:
    """docs with the key of its n-gram set."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = WordHashes()
        for texts in batches:
            yield pa.array([set_key(gram_set(t.as_py(), n, known)) for t in texts], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(run, "binary")(F.col(f"`{text}`")))


def sets_of(docs: DataFrame, text: str, n: int, wanted: DataFrame, count: int) -> DataFrame:
    """(key, set binary) of the wanted keys; sets that nobody wants aren't shuffled.

    A bitmap over the keys' first 32 bits, made by a distributed bitwise OR, lets sets pass; it is bounded by FILTER bits, and
    what it lets pass wrongly falls to the exact join. A task sends each set once, so that many copies of a text bring one set
    a task; the join keeps the small side, the keys, in memory and doesn't sort the sets.
    """
    prefix = wanted.select(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long").alias("p"))
    bits = min(FILTER, max(1 << 10, 1 << (32 * max(1, count)).bit_length()))
    cells = prefix.select((F.col("p") % bits).alias("p")).select((F.col("p") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    words = cells.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(bits // 64, np.uint64)
    table[words["w"].to_numpy()] = words["b"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, sent = shared.value, WordHashes(), set()
        for batch in batches:
            keys, sets = [], []
            for t in batch.column(0):
                grams = gram_set(t.as_py(), n, known)
                key = set_key(grams)
                if key is not None and key not in sent:
                    p = int.from_bytes(key[:4], "big") % bits
                    if int(table[p // 64]) >> p % 64 & 1:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(key)
                        keys.append(key)
                        sets.append(grams.tobytes())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["key", "set"])

    found = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "key binary, set binary")
    return found.join(wanted.hint("shuffle_hash"), "key", "left_semi").dropDuplicates(["key"])


def common_grams(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a set of left with one of right. N-grams of one set alone are dropped first; the rest
    are counted by dense products of some thousand columns at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    if len(left) * len(right) <= 16:
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                out[i, j] = len(np.intersect1d(a, b, assume_unique=True))
        return out
    both = np.concatenate(left + right)
    order, place = np.unique(both, return_inverse=True)
    counted = np.bincount(place, minlength=len(order)) > 1
    number = np.cumsum(counted) - 1
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    keep = counted[place]
    column, owner = number[place[keep]], owner[keep]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    for start in range(0, int(counted.sum()), STEP):
        a, b = np.searchsorted(column, [start, start + STEP])
        dense = np.zeros((len(left) + len(right), STEP), np.float32)
        dense[owner[a:b], column[a:b] - start] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def roots(links: np.ndarray) -> np.ndarray:
    """The smallest member of each row's component in a symmetric matrix of links."""
    label = np.arange(len(links))
    while True:
        least = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links)))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def verified(rows: list[dict], similar: Fraction) -> list[tuple[bytes, int, bytes]]:
    """(key, weight of linked classes, key of its root) of the classes of one piece of work that have a link in it: all pairs
    of one block, or all pairs between two."""
    band, one = rows[0]["band"], rows[0]["i"] == rows[0]["j"]
    side = np.array([r["side"] for r in rows])
    rows = [rows[i] for i in np.argsort(side, kind="stable")]
    side = np.sort(side)
    cut = int(np.searchsorted(side, 1))
    if len(rows) < 2 or not one and cut in (0, len(rows)):
        return []
    left, right = (slice(0, len(rows)),) * 2 if one else (slice(0, cut), slice(cut, len(rows)))
    sets = [np.frombuffer(r["set"], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets], np.int64)
    marks = np.array([np.frombuffer(r["bands"], np.uint64) for r in rows])
    inner = np.rint(common_grams(sets[left], sets[right])).astype(np.int64)
    total = size[left][:, None] + size[right][None, :]
    near = inner * (similar.numerator + similar.denominator) >= total * similar.numerator
    for j in range(band):
        near &= marks[left, j][:, None] != marks[right, j][None, :]
    if one:
        np.fill_diagonal(near, False)
        links = near
    else:
        links = np.zeros((len(rows), len(rows)), bool)
        links[left, right], links[right, left] = near, near.T
    weight = links @ np.array([r["copies"] for r in rows], np.int64)
    root = roots(links)
    return [(rows[i]["key"], int(weight[i]), rows[root[i]]["key"]) for i in np.flatnonzero(links.any(axis=1))]


def _work(similar: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, [], []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["key", "weight", "root"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for r in batch.slice(k, 256).to_pylist():
                    here = (r["band"], r["h"], r["i"], r["j"])
                    if here != at:
                        out += verified(rows, similar) if rows else []
                        at, rows = here, []
                    rows.append(r)
                if len(out) > 5000:
                    yield batch_of(out)
                    out = []
        out += verified(rows, similar) if rows else []
        if out:
            yield batch_of(out)

    return run


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, similar: float = SIMILAR, recall: float = RECALL, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, key; groups: key, copies, first, component, links): a row a document, and a row for each key, an
    n-gram set, with its component's smallest key and the number of documents of other sets that it links to."""
    bands = bands_for(similar, rows, recall)
    exact = Fraction(str(similar))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = written(signed(docs, doc_id, text, n, bands, rows), "signatures")
    known = members.where("key is not null").groupBy("key", "grams", "bands").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    known = written(known, "classes")
    mark = lambda j: F.conv(F.hex(F.substring("bands", 8 * j + 1, 8)), 16, -10).cast("long")
    marked = known.select("key", "grams", F.posexplode(F.array(*[mark(j) for j in range(bands)])).alias("band", "h"))
    buckets = marked.groupBy("band", "h").agg(F.count("*").alias("n"), F.sum("grams").alias("all_grams")).where("n > 1")
    met = written(marked.join(buckets, ["band", "h"]).select("band", "h", "n", "all_grams", "key"), "bucket-members")
    # Buckets whose members all agree in an earlier band are done there.
    own = met.join(known.select("key", "bands"), "key")
    agree = [F.min(F.substring("bands", 8 * j + 1, 8)) == F.max(F.substring("bands", 8 * j + 1, 8)) for j in range(bands - 1)]
    covered = own.groupBy("band", "h").agg(F.array(*agree).alias("same")).where(F.exists(F.slice("same", 1, F.col("band")), lambda x: x)).select("band", "h")
    met = written(met.join(covered, ["band", "h"], "left_anti"), "bucket-members")
    wanted = written(met.select("key").distinct(), "wanted")
    if not (count := wanted.count()):
        return members.select("doc_id", "key"), known.select("key", "copies", "first", F.col("key").alias("component"), F.lit(0).cast("long").alias("links"))
    sets = sets_of(docs, text, n, wanted, count).join(known.select("key", "copies", "bands"), "key")
    sets = written(sets, "sets")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all_grams") / BLOCK_GRAMS)).cast("int")
    dealt = met.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("key", "band"), F.col("blocks")).cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("b")).alias("i"), F.greatest(o, F.col("b")).alias("j"), (o < F.col("b")).cast("int").alias("side")))
    work = dealt.select("band", "h", "key", F.explode(each).alias("w")).select("band", "h", "key", "w.*")
    work = work.join(sets, "key").repartition(parts, "band", "h", "i", "j").sortWithinPartitions("band", "h", "i", "j", "key")
    found = written(work.mapInArrow(_work(exact), "key binary, weight long, root binary"), "links")
    joined = components(found.select(F.col("key").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "key")
    weights = found.groupBy("key").agg(F.sum("weight").alias("links"))
    groups = known.select("key", "copies", "first").join(joined, "key", "left").join(weights, "key", "left")
    return members.select("doc_id", "key"), groups.select("key", "copies", "first", F.coalesce("component", "key").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """A row a document: doc_id, class_id (the smallest doc_id among documents that links connect) and n_links, the number of
    other documents whose n-gram sets have a Jaccard index of at least `similar` with its own.

    Copies count as links, each once. Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters; a
    text of fewer than n words is one n-gram; null texts and texts without words link to nothing, not even one another.
    Documents without id count, and get the class of the others; rows with equal ids are documents of their own. Extra columns
    aren't carried; an empty table gives an empty one. `similar` is taken as the decimal that it is written as. Banding finds
    a pair at the threshold with probability `recall`; what is found is verified on whole sets.
    """
    members, groups = classes(docs, doc_id, text, **how)
    groups = written(groups, "groups")
    ids = groups.groupBy("component").agg(F.min("first").alias("class_id"))
    by_key = groups.join(ids, "component").select("key", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    joined = members.join(by_key, "key", "left")
    return joined.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, **how) -> DataFrame:
    """docs with one document of each class of ngram_join, the one of the smallest id (null ids come last); documents without
    words, null and empty texts among them, all stay. Extra columns stay. Rows are kept by their ids; only rows whose id is
    null or comes more than once are told apart by their n-gram sets, and of equal ones any stays."""
    members, groups = classes(docs, doc_id, text, n=n, **how)
    groups = written(groups, "groups")
    best = groups.groupBy("component").agg(F.min_by(F.struct("key", "first"), F.struct(F.col("first").isNull(), F.col("first"), F.col("key"))).alias("best"))
    best_key, first, repeated = (fresh(docs, name) for name in ("best_key", "first", "repeated"))
    best = best.select(F.col("best.key").alias(best_key), F.col("best.first").alias(first))
    several = members.where("key is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias(repeated))
    several = written(several, "repeated-ids")
    best = written(best.join(several, F.col(first).eqNullSafe(F.col(repeated)), "left").withColumn(repeated, F.col(repeated).isNotNull() | F.col(first).isNull()), "kept")
    worded = F.coalesce(F.col(f"`{text}`").rlike(r"[0-9A-Za-z\x{80}-\x{10ffff}]"), F.lit(False))
    own, columns = F.col(f"`{doc_id}`").cast("long"), [F.col(f"`{c}`") for c in docs.columns]
    single = best.where(~F.col(repeated)).select(first)
    kept = docs.where(worded).join(single.hint("shuffle_hash"), own == F.col(first), "left_semi").unionByName(docs.where(~worded))
    if several.isEmpty():
        return kept
    key = fresh(docs, "key")
    among = docs.where(worded).join(several.hint("shuffle_hash"), own.eqNullSafe(F.col(repeated)), "left_semi")
    rows = keyed(among, text, n, key).join(best.where(repeated), (F.col(key) == F.col(best_key)) & own.eqNullSafe(F.col(first)))
    return kept.unionByName(rows.dropDuplicates([key]).select(*columns))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
