from __future__ import annotations

import json
import random
import struct
import zlib
from collections import Counter as Bag
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import packing, records
from gridloom.llm.bpe import Encoder
from gridloom.llm.common import shared_dir
from gridloom.llm.token_counts import Counter, count_tokens, proven_whole_tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path: str):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path):
    rng = random.Random(1)
    letters = [*"ab'sS tTreVE  \n\t.,<|>1²Ⅷ٣é́Σσ\x1c\x85\xa0中文😀İ_-", "<|endoftext|>", "<|startoftext|>", "'ll", "\r\n", "\U000e0fff", "ﬁ"]
    encoder, known = Encoder(open(path).read()), library(path)
    counter = Counter(open(path).read()) if path == BYTE else None
    for _ in range(4000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 14)))
        ids = known(text)
        assert encoder.ids(text) == struct.pack(f"<{len(ids)}I", *ids), ascii(text)
        assert counter is None or counter.count(text) == len(ids), ascii(text)


def test_tables_stay_bounded(monkeypatch):
    monkeypatch.setattr("gridloom.llm.bpe.KEPT", 5)
    monkeypatch.setattr("gridloom.llm.bpe.RENEWED", 3)
    encoder, known = Encoder(open(BYTE).read()), library(BYTE)
    for text in [f"word{i} other{i * 7}" for i in range(50)]:
        assert encoder.ids(text) == np.array(known(text), "<u4").tobytes()
        assert len(encoder) <= 5


def test_proven_strings_are_single_tokens():
    known, proven = library(BYTE), proven_whole_tokens(open(BYTE).read())
    assert len(proven) > 40_000
    assert all(len(known(s)) == 1 for s in random.Random(2).sample(proven, 500))


def test_token_counts(docs, corpus, no_docs):
    known = library(BYTE)
    got = Bag(tuple(r) for r in count_tokens(docs.withColumn("N_Tokens", F.lit("clash")), BYTE, limit=100).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    assert got == Bag((i, len((t or "").encode()), n := len(known(t)), n > 100) for i, t, *_ in corpus)
    assert count_tokens(no_docs, BYTE).collect() == []


def test_records_round_trip(spark, docs, corpus, no_docs):
    folder = f"{shared_dir(spark)}/records-test"
    manifest = records.write_records(docs, folder, WORD, 2, partitions=3)
    rows = records.read_records(spark, folder, manifest).collect()
    known = library(WORD)
    want = Bag()
    for i, t, *_ in corpus:
        ids = [*known(t), 2]
        want[i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    assert Bag((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(len(rows))]
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert records.round_trip(no_docs, WORD, 2).collect() == []


def test_records_by_index_and_damage(spark, docs):
    folder = f"{shared_dir(spark)}/records-index"
    names = [r.name for r in records.write_records(docs, folder, WORD, 2, partitions=1).collect()]
    store, base = records.opened(folder)
    path = f"{base}/{names[0]}"
    forward = [*records.shard_sequences(store, path)]
    assert [*records.shard_sequences(store, path, lambda n: list(range(n - 1, -1, -1)))] == forward[::-1]
    data = bytearray(open(f"{path}.rec", "rb").read())
    data[30] ^= 1
    open(f"{path}.rec", "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        list(records.shard_sequences(store, path))


def test_shards_are_cut_by_size(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(records, "SHARD_BYTES", 2000)
    folder = f"{shared_dir(spark)}/records-small"
    manifest = records.write_records(docs, folder, WORD, 2, partitions=1)
    assert manifest.count() > 2
    assert records.read_records(spark, folder, manifest).count() == len(corpus)


def test_wide_ids_survive():
    ids = np.array([70_000, 1, 2**32 - 1], "<u4").tobytes()
    assert records.parsed(records.serialized(-5, ids)) == (-5, ids)
    assert records.parsed(records.serialized(None, b"")) == (None, b"")


def packed_is_sound(rows, corpus, size):
    known, sequences, by = library(BYTE), defaultdict(list), Bag()
    for r in rows:
        sequences[r.sequence_id].append(r)
        by[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    want = Bag()
    for i, t, *_ in corpus:
        ids = np.array([*known(t), 2], "<u4").tobytes()
        for p in packing.pieces_of(ids, size):
            want[(i, *p)] += 1
    assert by == want
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(sequences)


@pytest.mark.parametrize("dealt", [4, 8192])
def test_packing(docs, corpus, no_docs, dealt):
    rows = packing.pack_documents(docs, BYTE, 2, size=64, dealt=dealt).collect()
    n = packed_is_sound(rows, corpus, 64)
    assert n <= -(-sum(r.length for r in rows) // 64) + 3
    assert packing.pack_documents(no_docs, BYTE, 2).collect() == []


def test_pieces():
    assert [p[:3] for p in packing.pieces_of(bytes(4 * 10), 4)] == [(0, 0, 2), (1, 2, 4), (2, 6, 4)]
    assert [p[:3] for p in packing.pieces_of(bytes(4 * 8), 4)] == [(0, 0, 4), (1, 4, 4)]
    assert [p[:3] for p in packing.pieces_of(bytes(4 * 4), 4)] == [(0, 0, 4)]
    assert [p[:3] for p in packing.pieces_of(bytes(4), 4)] == [(0, 0, 1)]


def fewest(lengths, size):
    """By trying everything."""
    best = len(lengths)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= size:
                put(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        put(k + 1, [*bins, lengths[k]])

    put(0, [])
    return best


def test_bounds_hold():
    rng = random.Random(3)
    met = 0
    for _ in range(150):
        size = rng.choice([10, 16, 30])
        lengths = np.array([rng.randint(1, size) for _ in range(rng.randint(1, 9))])
        least, bins = fewest(sorted(lengths.tolist(), reverse=True), size), packing.best_fit_decreasing(lengths, size)
        assert packing.lower_bound(lengths, size) <= least <= bins.max() + 1
        assert np.bincount(bins, lengths).max() <= size
        met += packing.lower_bound(lengths, size) == least
    assert met > 100


def vocabulary(tmp_path, special="<|x|>", **changes):
    """A copy of the public vocabulary's definition with another special string or other steps."""
    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    spec["added_tokens"] = [{"id": 50256, "content": special, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]
    spec |= changes
    path = tmp_path / "vocabulary.json"
    path.write_text(json.dumps(spec))
    return str(path)


@pytest.mark.parametrize("changes", [
    {"special": "[SEP]"}, {"special": "EOS"},
    {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
    {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}]}},
    {"normalizer": {"type": "Lowercase"}},
    {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}},
])
def test_other_vocabularies_are_encoded_as_by_the_library(tmp_path, changes):
    path = vocabulary(tmp_path, **changes)
    library, definition = Tokenizer.from_file(path), open(path).read()
    library.no_truncation()
    encoder, counter = Encoder(definition), Counter(definition)
    for t in ("a [SEP] b", "EOS", "xEOSy", "Hello 123 World  [SEP][SEP]", "", "é 12", "EO S <|endoftext|> <"):
        ids = library.encode(t, add_special_tokens=False).ids
        assert encoder.ids(t) == struct.pack(f"<{len(ids)}I", *ids), t
        assert counter.count(t) == len(ids), t


def test_records_carry_no_extra_columns(spark, docs, corpus):
    odd = docs.selectExpr("doc_id", "text", "'x' AS part", "1 AS Start", "2 AS ids_crc32")
    rows = records.round_trip(odd, public_tokenizers.path("word_bpe_49k.json"), 2).collect()
    assert len(rows) == len(corpus)
    assert set(rows[0].asDict()) == {"doc_id", "start", "n_tokens", "ids_crc32"}
    packed = packing.pack_documents(docs.selectExpr("doc_id", "text", "'x' AS piece", "1 AS Start", "2 AS length", "3 AS uid"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert packed.count() >= len(corpus)


def test_packing_gap_and_rounds(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["a"] * rng.randint(1, 700))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json"), 2, dealt=10_000)
    many = packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json"), 2, dealt=25)
    (used, bound), (used_parts, same) = packing.packing_gap(one), packing.packing_gap(many)
    assert bound == same and bound <= used <= bound + 1
    assert used <= used_parts <= used * 1.06  # nine sequences a partition, which is far fewer than by default


def test_stores_by_scheme(tmp_path):
    assert records.opened(str(tmp_path))[1] == str(tmp_path)
    assert records.opened(f"file://{tmp_path}")[1] == str(tmp_path)
    assert records.opened("dbfs:/x/y")[1] == "/dbfs/x/y"
    assert records.opened("s3a://bucket/x?region=eu-west-1")[1] == "bucket/x"
    with pytest.raises(ValueError, match="viewfs"):
        records.opened("viewfs://c/x")
