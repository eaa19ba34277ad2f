"""Byte-pair encoding of whole texts through the tokenizers library, with each distinct pre-token merged once per worker.

A text is cut into pre-tokens by the vocabulary file's own rule, and each pre-token's ids come from the library's merge
model and are kept. Texts with characters for which Python's classes may differ from the library's go to the library whole;
such a character lies in some pre-token, so only pre-tokens that aren't known yet are searched for one.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from . import common
from .common import T

#: Distinct pre-tokens kept by a worker. A full table stays as it is, as the frequent ones come early; once it has missed
#: RENEWED times more, it starts anew. Neither changes a result.
KEPT, RENEWED = 400_000, 2_000_000
#: Longer pre-tokens are merged each time.
KEPT_LENGTH = 64

#: The pre-token rules of the two public vocabularies in Python's classes. They agree with the Unicode
#: classes L, N and White_Space but for the characters of ODD.
BYTE_RULE = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
WORD_RULE = r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+"


@lru_cache(1)
def odd() -> re.Pattern[str]:
    """Characters that send a text to the library: numbers that aren't decimal digits, and unassigned ones."""
    ranges, start = [], None
    for c in range(0x110001):
        hit = c < 0x110000 and unicodedata.category(chr(c)) in ("No", "Nl", "Cn", "Cs")
        if hit and start is None:
            start = c
        elif not hit and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(ranges)}]")


@lru_cache(1)
def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: b if b in plain else next(rest) for b in range(256)}


#: The steps of the two kinds of vocabulary files whose rules stand above.
BYTE_STEPS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_STEPS = [
    {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
]
WORD_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def rule_of(spec: dict) -> str | None:
    """byte or word if the file's normalizer, pre-tokenizer and model are exactly of that kind, else None."""
    model, normal = spec["model"], spec["normalizer"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
        return None
    bare = lambda step: {k: v for k, v in (step or {}).items() if k != "trim_offsets"}
    steps = spec["pre_tokenizer"] or {}
    if normal is None and bare(steps) == BYTE_STEPS:
        return "byte"
    if (normal or {}).get("normalizers") == WORD_NORMAL and [*map(bare, steps.get("pretokenizers", []))] == WORD_STEPS:
        return "word"
    return None


class OddText(Exception):
    """Only the library itself can encode this text."""


class Kept(dict):
    """A table of bounded size."""

    missed = 0

    def keep(self, key: str, value: object) -> None:
        if len(key) > KEPT_LENGTH:
            return
        if len(self) >= KEPT:
            self.missed += 1
            if self.missed < RENEWED:
                return
            self.missed = 0
            self.renew()
        self[key] = value

    def renew(self) -> None:
        self.clear()


class Encoder(Kept):
    """Pre-token to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, definition: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(definition)
        self.merge = self.tokenizer.model.tokenize
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(definition)
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = {t["content"]: struct.pack("<I", t["id"]) for t in spec["added_tokens"]}
        self.cut = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})") if added else None
        self.first = {t[0] for t in added}
        shape = rule_of(spec)
        plain = shape and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        self.lowers = shape == "word"
        #: None: another kind of vocabulary, which the library encodes whole.
        self.rule = re.compile(WORD_RULE if self.lowers else BYTE_RULE) if plain else None

    def merged(self, token: str) -> list[int]:
        """The ids of one pre-token by the library's merge model."""
        return [t.id for t in self.merge(self.spelled(token))]

    def spelled(self, token: str) -> str:
        """The pre-token in the byte-level alphabet; OddText if it has an odd character."""
        if token.isascii():
            if token.isprintable():
                return token.replace(" ", "\u0120")
        elif odd().search(token):
            raise OddText
        return token.encode().decode("latin-1").translate(byte_letters())

    def __missing__(self, token: str) -> bytes:
        ids = self.merged(token)
        out = struct.pack(f"<{len(ids)}I", *ids)
        self.keep(token, out)
        return out

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings; OddText where Python would lose a separator or lower-case by
        context, and for vocabularies of another kind."""
        if self.rule is None or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            raise OddText
        if self.lowers:
            if not text.isascii():
                if "Σ" in text:
                    raise OddText
                text = unicodedata.normalize("NFC", text)
            text = text.lower()
        return self.rule.findall(text)

    def parts(self, text: str) -> list[str]:
        """The text cut at special strings, which stand at the odd places."""
        return self.cut.split(text) if any(c in text for c in self.first) else [text]

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str | None) -> bytes:
        """The text's ids, as encode(text, add_special_tokens=False) gives them; null has none."""
        if not text:
            return b""
        try:
            out: list[bytes] = []
            for i, part in enumerate(self.parts(text)):
                out += [self.special[part]] if i % 2 else map(self.__getitem__, self.pre_tokens(part))
            return b"".join(out)
        except OddText:
            return self.whole(text)


def kept(definition: bytes, make: Callable[[str], T], kind: str) -> T:
    """One object of a kind for each vocabulary and worker."""
    return common.kept(kind, hashlib.sha256(definition).hexdigest(), lambda: make(definition.decode()))


def shipped(spark: SparkSession, path: str) -> Broadcast[bytes]:
    """The vocabulary file's bytes for the executors, which need not see the driver's folders; a few MB by its format."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path}: a vocabulary file of over 64 MB isn't broadcast")
    return spark.sparkContext.broadcast(data)
