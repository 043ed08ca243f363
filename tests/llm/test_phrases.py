"""Phrases: counts, scores, covering and ranks against a plain version; shards, blocks and defined cases."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from labelsense.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest, support, covered, first):
    """[(lang, rank, phrase, a, l, r, n, score)] of (text, lang) rows."""
    counts, words_of = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            words_of[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = [p for p, n in f.items() if len(p) > 1 and n >= support]
        held = collections.Counter()
        for p in candidates:
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    held[p[i : i + n]] = max(held[p[i : i + n]], f[p])
        found = []
        for p in candidates:
            if 100 * held[p] >= covered * f[p]:
                continue
            score, k = min((1_000_000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, words_of[lang], -score))
    return sorted(out)


def collected(table):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in table.collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    vocabulary = [*"abcdefgh", "Éa", "B", "x-y", "日", "a\x0bb"]
    texts = []
    for i in range(400):
        words = [draw.choice(vocabulary) + draw.choice(["", "", "", ",", ".", "\n", " \t"]) for _ in range(draw.randrange(60))]
        texts.append((" ".join(words), draw.choice(["en", "en", "en", None, "de"])))
    texts += [("new york city is big", "en")] * 150  # copies, all in one shard
    return [*texts, (None, "en"), ("", None), (" \t\n.,", "fr"), ("alone", "it")]


@pytest.mark.parametrize("longest, support, shards", [(3, 10, 4), (2, 3, 1), (4, 10, 7)])
def test_against_plain_version(spark, rows, longest, support, shards):
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5).withColumn("n", F.lit("mine"))
    got = collected(phrases.collocations(docs, longest=longest, support=support, shards=shards, first=25))
    expected = plain(rows, longest, support, 50, 25)
    assert got == expected and len(got) > 20


def test_blocks_do_not_change_counts(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(" ".join(t or "" for t, _ in rows), "en")], "text string, lang string")
    expected = plain([(" ".join(t or "" for t, _ in rows), "en")], 3, 10, 50, 2000)
    assert collected(phrases.collocations(docs)) == expected
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 7)
    part = phrases._prepared(docs, "text", "lang", 4).toArrow().to_batches()[0]
    blocks = list(phrases.text_blocks(part, 3))
    assert len(blocks) > 1000 and all(b.own <= len(b.word) <= b.own + 2 for b in blocks)


def test_lowered_support_is_never_above_a_share(spark):
    rows = [("en", 1, 100, 40, 60), ("de", 2, 7, 7, 0), ("fr", 2, 1000, 10, 990)]
    table = spark.createDataFrame(rows, "lang string, slot int, n long, n0 long, n1 long")
    lowered = phrases.local_supports(table, 10, 2)
    assert lowered[:, 1].tolist() == [4, 6] and lowered[:, 2].tolist() == [1, 1]  # the lowest of the slot, 1 at least


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(docs).count() == 0
    docs = spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")
    assert phrases.collocations(docs).count() == 0
