"""Token counts of whole texts with a whole-token shortcut.

Offline, before any text is read, the vocabulary's strings are put through the tokenizer one by one; those that are a single
pre-token and encode to the single id of that string form a proven table. A pre-token of a text that stands in the table
counts one; only the rest is merged (each distinct one once per worker).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, Kept, OddText, byte_letters, kept, shipped
from .common import replaced


class Counter(Kept):
    """Pre-token to its number of tokens; the proven strings stand at 1 from the start."""

    def __init__(self, definition: str):
        super().__init__()
        self.encoder = Encoder(definition)
        self.proven = dict.fromkeys(proven_whole_tokens(definition), 1)
        self.update(self.proven)

    def __missing__(self, token: str) -> int:
        n = len(self.encoder.merge(self.encoder.spelled(token)))
        self.keep(token, n)
        return n

    def renew(self) -> None:
        self.clear()
        self.update(self.proven)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        try:
            return sum(1 if i % 2 else sum(map(self.__getitem__, self.encoder.pre_tokens(part))) for i, part in enumerate(self.encoder.parts(text)))
        except OddText:
            return len(self.encoder.whole(text)) // 4


def proven_whole_tokens(definition: str) -> list[str]:
    """The vocabulary's strings that are one pre-token and encode alone as their own single id; none of a vocabulary of a kind
    that isn't known."""
    encoder = Encoder(definition)
    if encoder.rule is None:
        return []
    back = {chr(to): bytes([b]) for b, to in byte_letters().items()}
    special, found = set(encoder.special), []
    for letters, n in json.loads(definition)["model"]["vocab"].items():
        try:
            text = b"".join(back[c] for c in letters).decode()
            if text and text not in special and encoder.pre_tokens(text) == [text] and encoder.merged(text) == [n]:
                found.append(text)
        except (KeyError, UnicodeDecodeError, OddText):
            continue  # a mark such as a word end, part of a character, or one that the rule can't prove
    return found


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", limit: int = 512) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of its text column.

    The text column stays, as do extra columns; columns of the three names are replaced, whatever their case. Null and empty
    texts have 0 bytes and 0 tokens. Very long texts are counted whole, in time linear in their length. Every row keeps its
    place in the plan: no shuffle, no state between rows but the worker's table. Repeated rows count alike; an empty table
    gives an empty one with the three columns.
    """
    data = shipped(df.sparkSession, vocabulary)
    base = replaced(df, ["n_bytes", "n_tokens", "over_limit"])

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = kept(data.value, Counter, "counter")
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    column = F.col(f"`{text}`")
    return base.select(
        "*",
        F.coalesce(F.octet_length(column), F.lit(0)).cast("long").alias("n_bytes"),
        n_tokens(column).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)

