"""The numbered queries against their SQL, or against plain versions, on a whole small table."""

import base64
import hashlib
import re
import sys
import zlib
from pathlib import Path

import oracle
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute
import corpus_pipeline

from labelsense.llm import decontamination, mixing, quality_rules, registry, sharding, templates


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    assert oracle.differences(registry.QUERIES[name](spark, sf_dir), duck, registry.ORACLES[name]) == ""


def test_line_dedup(spark, sf_dir, documents):
    rows = registry.QUERIES["op1_line_dedup"](spark, sf_dir).collect()
    dropped = brute.dropped_lines([(d, t) for d, t, *_ in documents], 5)
    texts = {d: t for d, t, *_ in documents}
    assert {r.doc_id for r in rows} == set(texts) and len(dropped) > 100
    for row in rows:
        lines = texts[row.doc_id].split("\n")
        kept = [line for i, line in enumerate(lines) if (row.doc_id, i) not in dropped]
        assert row.text == "\n".join(kept) and row.n_lines == len(lines) and row.n_dropped == len(lines) - len(kept)


def test_ngram_join(spark, sf_dir, documents):
    rows = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in registry.QUERIES["op2_ngram_jaccard"](spark, sf_dir).collect()}
    groups = brute.jaccard_groups([(d, t) for d, t, *_ in documents], 3, 90)
    assert rows == {documents[i][0]: group for i, group in groups.items()}


def test_warc(spark, sf_dir, duck):
    rows = {r.page_id: r for r in registry.QUERIES["op5_warc_archives"](spark, sf_dir).collect()}
    pages = duck.execute("SELECT page_id, coalesce(html, '') FROM pages").fetchall()
    largest = {}
    for page_id, html in pages:
        largest[html] = max(page_id, largest.get(html, page_id))
    assert len(rows) == len(pages)
    for page_id, html in pages:
        row, data = rows[page_id], html.encode()
        assert row.payload_bytes == len(data)
        assert row.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        other = largest[html] if largest[html] != page_id else None
        assert row.refers_to == other and row.record_type == ("revisit" if other is not None else "response")


def test_pii(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in registry.QUERIES["op6_pii_surrogates"](spark, sf_dir).collect()}
    kinds = [r"[\w.]+@[\w.]+\w", r"\b\d+\.\d+\.\d+\.\d+\b", r"\b\d{16}\b", r"\+1 \(\d{3}\) \d{3}-\d{4}",
             r"(?i:token) = \"\w{40}", r"(?i:password)=\w+"]
    assert set(rows) == {d for d, *_ in documents}
    for kind in kinds:
        pairs = set()
        for doc_id, text, *_ in documents:
            before, after = re.findall(kind, text), re.findall(kind, rows[doc_id].text)
            assert len(before) == len(after)
            pairs |= set(zip(before, after, strict=True))
        assert brute.one_to_one(pairs)
        assert not {a for a, _ in pairs} & {b for _, b in pairs}
    any_kind = "|".join(kinds)
    for doc_id, text, *_ in documents:
        assert re.split(any_kind, text) == re.split(any_kind, rows[doc_id].text)
        assert (rows[doc_id].n_entities == 0) == (rows[doc_id].text == text)


def test_templates(spark, sf_dir, duck, documents):
    rows = registry.QUERIES["op7_benchmark_templates"](spark, sf_dir).collect()
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    found = brute.leaks([(d, t) for d, t, *_ in documents], items, 8, 5, 13, set(templates.UNITS))
    assert {(r.doc_id, r.item_id) for r in rows} == found and found


def check_shards(rows, sizes, shards=24):
    """``rows``: (group, size, shard); ``sizes``: of the groups, in order."""
    shard_of, held = {}, [0] * shards
    for group, size, shard in rows:
        assert shard_of.setdefault(group, shard) == shard
        held[shard] += size
    assert max(held) == brute.smallest_capacity([sizes[g] for g in sorted(sizes)], shards)
    order = [shard_of[g] for g in sorted(shard_of)]
    assert order == sorted(order)
    return held


def test_sharding(spark, sf_dir, documents):
    rows = registry.QUERIES["op8_sharded_documents"](spark, sf_dir).collect()
    texts, sizes = {d: t for d, t, *_ in documents}, {}
    group = lambda text: hashlib.md5(text.encode()).hexdigest()
    for text in texts.values():
        sizes[group(text)] = sizes.get(group(text), 0) + len(text.encode()) + 8
    held = check_shards([(group(texts[r.doc_id]), r.size, r.shard) for r in rows], sizes)
    assert min(held) > 0 and len(rows) == len(texts)
    for shard in range(24):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in rows)
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 for r in rows)


def test_language_id(spark, documents):
    rows = registry.QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(langs) and {r.doc_id for r in held} == {d for d in langs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_pipeline(spark, sf_dir, duck, documents):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    judged = duck.execute(f"SELECT doc_id, kept FROM ({quality_rules.ORACLE})").fetchall()
    left = {d for d, kept in judged if kept}
    docs = [row for row in documents if row[0] in left]
    groups = brute.jaccard_groups([row[:2] for row in docs], 5, 80)
    docs = [row for i, row in enumerate(docs) if groups[i][1] in (None, row[0]) or not groups[i][0]]
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    leaks = {d for d, _ in brute.leaks([row[:2] for row in docs], items, 8, 5, 13, set(templates.UNITS))}
    docs = [row for row in docs if row[0] not in leaks]
    counts = {}
    for row in docs:
        counts[row[3]] = counts.get(row[3], 0) + 1
    weight = sum(n**mixing.TEMPERATURE for n in counts.values())
    rate = {s: n**mixing.TEMPERATURE / weight * len(docs) / n for s, n in counts.items()}
    copies = {r[0]: brute.poisson(rate[r[3]], mixing.SEED, r[0], mixing.STEP, mixing.DEPTH) for r in docs}
    got = {}
    for row in rows:
        got[row.doc_id] = got.get(row.doc_id, 0) + 1
    assert got == {d: n for d, n in copies.items() if n} and leaks
    sizes, texts = {}, {d: t for d, t, *_ in docs}
    group = lambda text: hashlib.md5(text.encode()).hexdigest()
    for doc_id, n in got.items():
        sizes[group(texts[doc_id])] = sizes.get(group(texts[doc_id]), 0) + n * (len(texts[doc_id].encode()) + 8)
    check_shards([(group(r.text), len(r.text.encode()) + 8, r.shard) for r in rows], sizes)
    assert set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "shard"}


def test_windows_are_the_documented_ones():
    assert (decontamination.WINDOW, decontamination.LEAST_FIXED, decontamination.RUN) == (8, 5, 13)
    assert sharding.SHARDS == 24
