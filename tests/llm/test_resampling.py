"""Importance resampling: features and gains against a plain version, defined cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelsense.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [None, "", " \x00-", "A b, a B! Étage Ünder_ß 12a\x00b", "the the the The", "x", "日本 日本 語" * 3, "a " * 50]


def plain_features(text, longest, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(run.encode()) % buckets for run in runs]


def plain(rows, target, longest, buckets, least_words, percent, seed):
    """{place of a row: (n_features, weight, score, rank)}."""
    own = [plain_features(text, longest, buckets) for _, text in rows]
    s = collections.Counter(b for _, found in own for b in found)
    t = collections.Counter(b for text in target for b in plain_features(text, longest, buckets)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = {}
    for i, ((id_, _), (words, found)) in enumerate(zip(rows, own, strict=True)):
        h = int(hashlib.sha256(f"{seed}:{'null' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) for b in found)
        out[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)]
    order = sorted((i for i in out if out[i][4] >= least_words), key=lambda i: (-out[i][2], rows[i][0] is None, rows[i][0] or 0))
    for rank, i in enumerate(order[: percent * len(order) // 100], 1):
        out[i][3] = rank
    return {i: tuple(row[:4]) for i, row in out.items()}


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_features(longest):
    for texts in (pa.array(TEXTS), pa.array(["zero", *TEXTS, None]).slice(1, len(TEXTS)), pa.array(TEXTS[:3])):
        n_words, sized = resampling.features(texts, longest, 10_000)
        for i, text in enumerate(texts.to_pylist()):
            words, expected = plain_features(text, longest, 10_000)
            assert n_words[i] == len(words)
            found = [bucket[starts[i] : starts[i + 1]].tolist() for starts, bucket in sized]
            assert sum(found, []) == expected


def test_blocks_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c"] * 7)], ["text"])
    parts = list(resampling.blocks(batch, "text", 64))
    assert sum((p.column("text").to_pylist() for p in parts), []) == batch.column("text").to_pylist() and len(parts) > 7


@pytest.mark.parametrize("longest", [1, 2])
def test_against_plain_version(spark, sf_dir, longest):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    gains = resampling.gains_for(docs, target, longest=longest, buckets=1000)
    got = resampling.ranked(resampling.weighed(docs, gains, ["doc_id"], longest=longest), percent=25).collect()
    expected = plain(rows, [r.text for r in target.collect()], longest, 1000, 20, 25, 2024)
    assert {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in got} == {rows[i][0]: x for i, x in expected.items()}
    drawn = resampling.drawn_documents(docs, target, longest=longest, buckets=1000, percent=25).collect()
    assert {r.doc_id for r in drawn} == {rows[i][0] for i, x in expected.items() if x[3]}


def test_cases(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "good words here", 3), (3, "good words here", 3), (None, "good words here", 4), (4, "bad", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").withColumn("_text", F.lit("mine"))
    target = spark.createDataFrame([("good words",), (None,), ("",)], "text string")
    gains = resampling.gains_for(docs, target)
    got = resampling.ranked(resampling.weighed(docs, gains, ["doc_id"]), least_words=1, percent=100).collect()
    expected = plain([r[:2] for r in rows], ["good words"], 1, 10_000, 1, 100, 2024)
    key = lambda row: tuple((x is None, x or 0) for x in row)
    found = sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got), key=key)
    assert found == sorted(((rows[i][0], *x) for i, x in expected.items()), key=key)
    drawn = resampling.drawn_documents(docs, target, least_words=1, percent=50)
    assert drawn.columns == ["doc_id", "text", "_text", "n_words", "n_features", "weight", "score"] and drawn.count() == 2
    nothing = docs.limit(0)
    assert resampling.ranked(resampling.weighed(nothing, gains, ["doc_id"])).count() == 0
    assert resampling.drawn_documents(nothing, target).count() == resampling.drawn_documents(docs, target, percent=0).count() == 0
    assert np.abs(resampling.gains_for(nothing, target.limit(0))).sum() == 0
