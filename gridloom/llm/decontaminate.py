"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Items and documents are normalised to words. A window of n words holds n - g + 1 runs of g words, g being half of n; of each
window the run that is rarest among the items is a pattern of the automaton, whose letters are word numbers. So the automaton
grows with the items' length, not with n times that. A document is scanned once; every match is extended to the left and
right as long as document and item agree, and a stretch that is as long as a window is a hit. Any occurrence of a window
holds its pattern and lies in such a stretch, so none is missed. Word ranges are mapped back to offsets in the original text.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, replaced, words_of

#: Words of items in one automaton, which then takes some 100 MB of a worker at most. A larger set of items goes through
#: several automata, one pass over the text each.
BLOCK_WORDS = 1 << 19
#: Fixed value: a word, after A-Z have become a-z.
WORD = regex.compile("[0-9A-Za-z\x80-\U0010ffff]+")

RESULT = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int32()))])
RESULT_TYPE = "struct<n_words:long,hits:array<int>,items:array<string>,spans:array<int>>"


@dataclass
class Block:
    """Items as word numbers (from 1; 0 ends each item), their ids, and the places of their patterns with their lengths."""

    vocabulary: bytes
    words: np.ndarray
    owner: np.ndarray
    keys: list[str | None]
    places: np.ndarray
    lengths: np.ndarray
    n: int


def patterns(words: np.ndarray, starts: list[int], sizes: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of the patterns of all items: of each window its rarest run, of equal ones that of smallest hash, so that
    neighbouring windows mostly share theirs."""
    g = max(1, n // 2)
    factors = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(g)], np.uint64)
    m = max(0, len(words) - g + 1)
    h = np.zeros(m, np.uint64)
    for j in range(g):
        h += words[j : j + m].astype(np.uint64) * factors[j]
    h ^= h >> np.uint64(29)
    inside = np.concatenate([np.arange(a, a + s - g + 1) for a, s in zip(starts, sizes, strict=True) if s >= g] or [np.zeros(0, np.int64)])
    order, back, count = np.unique(h[inside], return_inverse=True, return_counts=True)
    often = np.zeros(m, np.uint64)
    often[inside] = (count[back].astype(np.uint64) << np.uint64(36)) + (h[inside] >> np.uint64(28))
    places, lengths = [], []
    for a, s in zip(starts, sizes, strict=True):
        if s < g:
            found = np.array([a])
        else:
            runs = min(n, s) - g + 1
            found = np.unique(a + np.arange(s - g + 2 - runs) + sliding_window_view(often[a : a + s - g + 1], runs).argmin(axis=1))
        places.append(found)
        lengths.append(np.full(len(found), min(s, g)))
    return np.concatenate(places), np.concatenate(lengths)


def block_of(items: list[tuple[str | None, list[bytes]]], n: int) -> Block:
    numbers: dict[bytes, int] = {}
    flat, starts, sizes, owner = [], [], [], []
    for k, (_, found) in enumerate(items):
        starts.append(len(flat))
        sizes.append(len(found))
        flat += [numbers.setdefault(w, len(numbers) + 1) for w in found]
        flat.append(0)
        owner += [k] * (len(found) + 1)
    words = np.array(flat, np.uint32)
    return Block(b" ".join(numbers), words, np.array(owner, np.int32), [key for key, _ in items], *patterns(words, starts, sizes, n), n)


def item_blocks(items: DataFrame, item_id: str, text: str, n: int, limit: int) -> Iterator[Block]:
    """The items that have words, in blocks of about limit words (an item stays whole); read a partition at a time."""
    block: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for key, value in items.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{text}`")).toLocalIterator():
        if found := words_of(value):
            block.append((key, found))
            size += len(found)
        if size >= limit:
            yield block_of(block, n)
            block, size = [], 0
    if block:
        yield block_of(block, n)


class Machine:
    """The automaton of a block, and what extends its matches. Built once by each worker."""

    def __init__(self, block: Block):
        self.numbers = {w: k for k, w in enumerate(block.vocabulary.split(b" "), 1)}
        self.words, self.owner, self.keys, self.n = block.words.tolist(), block.owner.tolist(), block.keys, block.n
        sizes = np.bincount(block.owner, minlength=len(block.keys)) - 1
        self.need = np.minimum(block.n, sizes).tolist()
        at: dict[tuple[int, ...], list[int]] = {}
        for place, length in zip(block.places.tolist(), block.lengths.tolist(), strict=True):
            at.setdefault(tuple(self.words[place : place + length]), []).append(place)
        # A word's number is spelled by two letters of alphabets of their own, as a node's children are searched in a row.
        self.base = math.isqrt(len(self.numbers)) + 1
        self.automaton = ahocorasick.Automaton()
        for run, places in at.items():
            self.automaton.add_word("".join(map(self.spelled, run)), (len(run), places))
        self.automaton.make_automaton()
        self.letters = {w: self.spelled(k) for w, k in self.numbers.items()}

    def spelled(self, number: int) -> str:
        return chr(1 + number // self.base) + chr(2 + self.base + number % self.base)

    def scan(self, found: list[bytes], ranges: list[tuple[int, int]], items: set[str]) -> None:
        """Adds the word ranges [from, to) and the items of all occurrences of windows."""
        text: list[int] = []
        words, done = self.words, {}
        for end, (length, places) in self.automaton.iter("".join(map(self.letters.get, found, repeat("\0\0")))):
            text = text or [*map(self.numbers.get, found, repeat(0)), -1]  # the end agrees with no item's
            t = end // 2 - length + 1
            for p in places:
                if done.get(p - t, -1) > t:  # lies in a stretch that was extended before
                    continue
                a, b = p, p + length
                while a and words[a - 1] and a - p + t and words[a - 1] == text[a - 1 - p + t]:
                    a -= 1
                while words[b] and words[b] == text[b - p + t]:
                    b += 1
                done[p - t] = b - p + t
                k = self.owner[p]
                if b - a >= self.need[k]:
                    ranges.append((a - p + t, b - p + t))
                    if self.keys[k] is not None:
                        items.add(self.keys[k])


def merged(ranges: list[tuple[int, int]]) -> list[int]:
    """Sorted disjoint ranges, flat: from, to, from, to …"""
    out: list[int] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def original_offsets(text: str, hits: list[int]) -> list[int]:
    """The code-point offsets [from, to) in the text of word ranges, flat."""
    out, edge, wanted = [], 0, iter(hits)
    a, b = next(wanted), next(wanted)
    for k, m in enumerate(WORD.finditer(text)):
        if k == a:
            edge = m.start()
        if k == b - 1:
            out += (edge, m.end())
            if (a := next(wanted, None)) is None:
                break
            b = next(wanted)
    return out


def _pass(block: Broadcast[Block], name: str, last: bool) -> Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        machine = kept("windows", name, lambda: Machine(block.value))
        for texts, earlier in batches:
            rows = []
            for text, prior in zip(texts, earlier, strict=True):
                text, prior = text.as_py(), prior.as_py() or {}
                old = prior.get("hits") or []
                ranges, items = [*zip(old[::2], old[1::2], strict=True)], set(prior.get("items") or [])
                found = words_of(text)
                machine.scan(found, ranges, items)
                hits = merged(ranges)
                rows.append({"n_words": len(found), "hits": hits, "items": sorted(items), "spans": original_offsets(text, hits) if last and hits else []})
            yield pa.array(rows, RESULT)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, RESULT_TYPE)


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, n_hit (long), items (array of item ids, sorted as strings), hit_spans (array of code-point offsets
    from, to, … in the original text) and contaminated.

    A document word inside any occurrence of a window is hit. Null and empty texts have no words; texts of any length are
    scanned whole. Items without words give no window; one without an id marks words, but isn't listed; items with equal ids
    are one. Without items nothing is hit; an empty table gives an empty one. Repeated rows are treated alike. Other columns
    of docs stay, those of the five names are replaced. No shuffle; an automaton is built from about block_words words of
    items (an item stays whole), and a larger set of items takes further passes.
    """
    names = ["n_words", "n_hit", "items", "hit_spans", "contaminated"]
    state = "_scan"
    df = replaced(docs, [*names, state]).withColumn(state, F.lit(None).cast(RESULT_TYPE))
    context = docs.sparkSession.sparkContext
    blocks = [*item_blocks(items, item_id, item_text, n, block_words)] or [block_of([(None, [b" "])], n)]
    for k, block in enumerate(blocks):
        name = hashlib.sha256(pickle.dumps(block)).hexdigest()
        df = df.withColumn(state, _pass(context.broadcast(block), name, k == len(blocks) - 1)(F.col(f"`{text}`"), F.col(state)))
    hits = F.col(f"{state}.hits")
    covered = F.aggregate(F.transform(hits, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c != state],
        F.col(f"{state}.n_words").alias("n_words"),
        covered.alias("n_hit"),
        F.col(f"{state}.items").alias("items"),
        F.col(f"{state}.spans").alias("hit_spans"),
        (F.size(hits) > 0).alias("contaminated"),
    )
