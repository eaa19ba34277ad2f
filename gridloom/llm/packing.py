"""Packing documents into sequences of a fixed length: best-fit decreasing with certified bounds.

Pieces shorter than a sequence are dealt over partitions and packed by best-fit decreasing. Dual feasible functions bound
each partition's number of sequences from below; a partition that meets its bound is certified and stays. Partitions with a
gap exchange the documents of their unfilled sequences: whole sequences are dealt anew, repacked by best-fit decreasing, and
the repacking is taken where it needs fewer. Rounds go on while they save sequences. Only lengths travel; token ids never leave the task that made them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder, kept, shipped
from .common import written

#: Pieces in one partition of a round; a packing by best-fit decreasing loses little beyond some thousands.
DEALT = 8192
#: Exchange goes on while a round saves at least this part of its sequences (any, if there are fewer than 1 / GAIN), and ends
#: after so many rounds in a row that don't.
GAIN, IDLE = 1e-4, 2

PIECES = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """A bound on the number of sequences from dual feasible functions of the lengths (1 to size).

    f_e drops lengths under e and lifts those over size - e to size; u_k rounds (k + 1) * x / size down unless it is whole;
    either keeps any set of lengths that fits one sequence at size or less, so its sum over size is a bound.
    """
    return bound_of(np.bincount(lengths, minlength=size + 1).astype(np.int64), size)


def bound_of(count: np.ndarray, size: int) -> int:
    """lower_bound by the number of pieces of each length from 0 to size."""
    if not count.any():
        return 0
    x = np.arange(size + 1, dtype=np.int64)
    best = -(-int(count @ x) // size)
    below, weight = np.cumsum(count), np.cumsum(count * x)
    for e in range(1, size // 2 + 1):
        lifted = int(below[size] - below[size - e])
        middle = int(weight[size - e] - weight[e - 1])
        best = max(best, lifted - (-middle // size))
    for k in range(1, 21):
        whole = (k + 1) * x % size == 0
        # in units of size * k: whole multiples keep their length, others give size for each full (k + 1)-th
        units = np.where(whole, x * k, (k + 1) * x // size * size)
        best = max(best, -(-int(count @ units) // (size * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each length; longest first, each to the fullest bin that still holds it. Linear but for a bit search."""
    bins = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]
    mask = n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if rest := mask >> need:
            room = need + (rest & -rest).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b, n = size, n, n + 1
        bins[i] = b
        if room > need:
            free[room - need].append(b)
            mask |= 1 << (room - need)
    return bins


def pieces_of(ids: bytes, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids: one piece, or a first one of what is left over and then full ones."""
    n = len(ids) // 4
    cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        yield k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])


def encoded_pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int, doc_id: str, text: str) -> DataFrame:
    data, end = shipped(docs.sparkSession, vocabulary), struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(data.value, Encoder, "encoder")
        for batch in batches:
            rows = [(key.as_py(), *p) for key, t in zip(batch.column(0), batch.column(1), strict=True) for p in pieces_of(encoder.ids(t.as_py()) + end, size)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECES.values(), strict=True)], list(PIECES))

    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return chosen.mapInArrow(cut, PIECES_DDL)


def _pack(size: int, tag: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths, old = rows["length"].to_numpy(np.int64), rows["bin"].to_numpy(np.int64)
        bins, bound = best_fit_decreasing(lengths, size), lower_bound(lengths, size)
        need = int(bins.max()) + 1
        if tag and need >= len(np.unique(old)):  # the exchange gained nothing here
            bins, need = old, len(np.unique(old))
        else:
            bins = bins + (tag << 54) + (int(key[0]) << 22)
        out = pd.DataFrame({"uid": rows["uid"], "length": lengths, "bin": bins})
        out["free"] = size - out.groupby("bin")["length"].transform("sum")
        out["open"] = (need > bound) & (out["free"] > 0)
        return out

    return pack


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int, size: int = 1024, doc_id: str = "doc_id", text: str = "text", dealt: int = DEALT, gain: float = GAIN
) -> DataFrame:
    """Per piece: doc_id, piece int, start, length, ids_crc32, sequence_id and offset (long).

    Every document, null and empty texts too, is its text's ids and end_id; only those longer than size are cut, the first
    piece taking what is left over. Pieces in a sequence lie gapless from offset 0 and fill at most size tokens. Rows with
    equal or null doc_id are documents of their own. Extra columns, whatever their names, aren't carried. An empty table gives
    no rows. The texts are read once; what is shuffled is a few numbers a document, spread by hash over partitions of about
    `dealt` pieces. packing_gap() tells how far the result may be from the fewest sequences.
    """
    pieces = written(encoded_pieces(docs, vocabulary, end_id, size, doc_id, text).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    loose = pieces.where(F.col("length") < size).select("uid", "length", F.lit(0).cast("long").alias("bin"))
    state = "uid long, length long, bin long, free long, open boolean"
    n = loose.count()
    done, before, idle = [], None, 0
    todo = loose.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(-(-n // dealt) or 1)))
    for r in range(255):  # a round's number has 8 bits of a sequence's
        packed = written(todo.groupBy("part").applyInPandas(_pack(size, r), state), "packed")
        bins = packed.groupBy("bin").agg(F.first("open").alias("open")).agg(F.count("*").alias("all"), F.count_if("open").alias("open")).first()
        idle = 0 if before is None or before - bins.all > gain * before else idle + 1
        if not bins.open or idle >= IDLE:
            done.append(packed)
            break
        done.append(packed.where(~F.col("open")))
        still, before = packed.where("open"), bins.open
        # an open partition's full sequences are no part of the exchange; m rows are what is dealt anew
        m = still.count()
        todo = still.withColumn("part", F.pmod(F.xxhash64("bin", F.lit(r)), F.lit(-(-m // dealt)))).select("uid", "length", "bin", "part")
    else:
        done.append(still)
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    place = Window.partitionBy("bin").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("uid", F.col("bin").alias("sequence_id"), F.coalesce(F.sum("length").over(place), F.lit(0)).alias("offset"))
    full = pieces.where(F.col("length") == size).select(*PIECES, (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.where(F.col("length") < size).join(placed, "uid").select(*PIECES, "sequence_id", "offset").unionByName(full)


def packing_gap(packed: DataFrame, size: int = 1024) -> tuple[int, int]:
    """(sequences used, lower bound on them) of a packing, by dual feasible functions of all lengths. The driver gets a count
    for each length, size of them at most."""
    counts = {r.length: r.n for r in packed.groupBy("length").agg(F.count("*").alias("n")).collect()}
    used = packed.select("sequence_id").distinct().count()
    return used, bound_of(np.array([counts.get(x, 0) for x in range(size + 1)], np.int64), size)
