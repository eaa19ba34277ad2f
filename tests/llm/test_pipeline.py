from __future__ import annotations

import random
import re
import struct
import zlib
from collections import Counter as Bag

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import common

from .conftest import sentence
from .test_joins import brute_join
from .test_text import base_spans, contaminated, words

NAMES = {0: "<EMAIL>", 1: "<IP>", 2: "<CARD>", 3: "<PHONE>", 5: "<SECRET>"}
ITEM = "the quick brown fox jumps over the lazy dog again and again"


def redacted(t):
    out, at, spans, i = [], 0, sorted([*base_spans(t), *((m.start(1), 5, m.end(1)) for m in re.finditer('token = "([0-9a-f]{40})"', t))]), 0
    while i < len(spans):
        a, kind, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [t[at:a], NAMES[kind]]
        at = b
    return "".join([*out, t[at:]])


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, corpus):
    rng = random.Random(9)
    rows = [r for r in corpus if r[0] is not None]
    seen, unique = set(), []
    for r in rows:
        if r[0] not in seen:
            seen.add(r[0])
            unique.append(r)
    long = sentence(rng, 1500)
    more = [f"before {ITEM.upper()}! after", f"{sentence(rng, 60)} call +41 44 123 45 67 or a.b@c.example.org", f'{sentence(rng, 30)} token = "{"0a1b2c3d4e" * 4}"', long, long, re.sub("^[a-z]+", "other", long), "1234 5678 !!!"]
    unique += [(100 + i, t, None, "hot", len(t)) for i, t in enumerate(more)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(unique, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, unique


def test_pipeline_equals_a_plain_one(spark, sf_dir):
    path, rows = sf_dir
    rows = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    kept = {cls for _, cls, _ in brute_join(rows)}
    rows = [(i, t) for i, t in rows if i in kept or not words(t)]
    rows = [(i, redacted(t)) for i, t in rows if not contaminated(t, [(1, ITEM)])[1]]
    assert any("<SECRET>" in t for _, t in rows)
    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Bag()
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    out = corpus_pipeline.run(spark, path).collect()
    assert Bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert len({r.sequence_id for r in out}) <= -(-sum(r.length for r in out) // 1024) + 1


def test_stages_take_any_documents(spark, sf_dir, docs, no_docs):
    path, _ = sf_dir
    for df in (docs, no_docs, docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 AS Score", "'x' AS pii", "2 AS contaminated")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, path)
            assert out.columns == df.columns, name
            assert out.count() <= df.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, path).count() >= (df.count() > 0)


def test_unlabelled_documents_stay(spark, sf_dir):
    path, _ = sf_dir
    rows = [(i, t, None, "s", 1) for i, t in enumerate(["clean text", "noch ein Text", "1 2 3", None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text for r in corpus_pipeline.STAGES[0][1](spark, df, path).collect()) == ["clean text", "noch ein Text"]


def test_prediction_fills_missing_languages(spark, sf_dir):
    path, _ = sf_dir
    english, french = "the thing whether this shall only then", "était ouvrir le roi trait eau où"
    rows = [(i, english if i % 2 else french, "en" if i % 2 else "fr", "s", 1) for i in range(40)] + [(100, english, None, "s", 1), (101, french, None, "s", 1), (102, english, "xx", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang for r in corpus_pipeline.STAGES[0][1](spark, df, path).collect()}
    assert (got[100], got[101], got[102], got[0], len(got)) == ("en", "fr", "xx", "fr", 43)


def test_run_leaves_only_its_result(spark, sf_dir):
    path, _ = sf_dir
    start = common.marked()
    out = corpus_pipeline.run(spark, path)
    assert len(common._written) == start + 1
    assert out.count() > 0
    common.release(spark, start)
    assert common.marked() == start


def test_a_cluster_without_a_shared_folder_raises():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
