"""Packing: the plan over random lengths, ids against the tokenizer, every id in one piece, defined cases."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelsense.llm import packing, registry

PATH = public_tokenizers.path(packing.VOCABULARY)


def pieces_of(counts, plan):
    """{window: [(offset, length)]}, checking that the pieces of a remainder are all of it."""
    spots, held = plan.indexed()
    windows, place = {}, 0
    for length, n in enumerate(counts):
        for _ in range(n):
            if length:
                entries = held[packing.bisect_right(spots, place) - 1]
                starts = np.cumsum([0, *[e.length for e in entries]])
                assert [e.start for e in entries] == starts[:-1].tolist() and starts[-1] == length
                for e in entries:
                    at = place - e.first
                    window = e.window + at // e.per_window * e.stride
                    windows.setdefault(window, []).append((e.offset + at % e.per_window * e.length, e.length))
            place += 1
    return windows


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 63), st.integers(1, 200), max_size=30))
def test_all_windows_but_the_last_are_full(lengths):
    counts = np.zeros(64, np.int64)
    for length, n in lengths.items():
        counts[length] = n
    plan = packing.planned(counts, (64, 32, 16, 8))
    windows = pieces_of(counts, plan)
    assert set(windows) == set(range(sum(n for _, _, n in plan.tiers)))
    for size, first, n in plan.tiers:
        for window in range(first, first + n):
            at = 0
            for offset, length in sorted(windows[window]):
                assert offset == at
                at += length
            assert at == size or (window == len(windows) - 1 and at < 64)


@pytest.mark.parametrize("lengths", [[1500] * 1000, [1] * 5000, [2047] * 777 + [1], [1025] * 3 + [1026] * 50])
def test_one_length_for_most_documents(lengths):
    counts = np.bincount(lengths, minlength=2048)
    plan = packing.planned(counts)
    windows = pieces_of(counts, plan)
    assert len(windows) <= -(-sum(lengths) // 256) and len(plan.entries) < 2000
    assert sum(n * size for size, _, n in plan.tiers[:-1]) > sum(lengths) - 2048


def test_short_documents_fill_long_gaps_before_any_is_cut():
    plan = packing.planned(np.bincount([1500] * 10 + [500] * 10 + [48] * 10, minlength=2048))
    assert {(e.start, e.length) for e in plan.entries} == {(0, 1500), (0, 500), (0, 48)}
    assert plan.tiers[0] == (2048, 0, 10)


def test_ids_of_words_are_those_of_whole_texts(monkeypatch, sf_dir):
    model = packing.tokenizer(PATH)
    texts = [None, "", " \n", "don't \"x\" <|endoftext|>á ́e é x ΑΣ İi 12a日本  z" * 3, "a\tb\x0bc", "x" * 5000,
             "Éé ÑANDÚ Ärger ΣΑΣ İZ ǅ Ǆ naïve ŒUVRE œuvre ǆ ŀ straße ﬁn ﬁ ª º ӏ İı End. end?! END... 3.5, it's. é, (é). A,b c; <|ENDOFTEXT|> x.<|endoftext|>. .,;"]
    documents = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column("text").to_pylist()
    known = packing.Words(model)
    for rows in (pa.array(texts), pa.array(["", *texts]).slice(1), pa.array(texts[4:6]), pa.array(documents), pa.array([], pa.string())):
        whole, whole_bounds = known.encoded_whole(rows)
        plain = [model.encode(t or "", add_special_tokens=False).ids for t in rows.to_pylist()]
        assert whole.tolist() == sum(plain, []) and np.diff(whole_bounds).tolist() == list(map(len, plain))
        for limit in (1 << 18, 0):
            monkeypatch.setattr(packing, "CACHE_WORDS", limit)
            ids, bounds = known.encoded(rows)
            assert ids.tolist() == whole.tolist() and bounds.tolist() == whole_bounds.tolist()


def check_pieces(rows, texts):
    """Every id of every document in one piece, sequences without gaps, padding of one sequence at most."""
    model = packing.tokenizer(PATH)
    ids = {d: [*model.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.length == len(own) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(own.tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, r.tier))
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        assert sum(n for _, n in parts) == len(ids[doc])
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False))
    padded = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and len({tier for *_, tier in parts}) == 1
        padded += at != parts[0][2]
    assert padded <= 1 and set(by_sequence) == set(range(len(by_sequence)))


def test_query(spark, sf_dir):
    rows = registry.QUERIES["op11_packed_sequences"](spark, sf_dir).collect()
    check_pieces(rows, {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()})
    steps = {}
    for r in rows:
        steps.setdefault((r.tier, r.step), set()).add(r.sequence_id)
    for tier in {t for t, _ in steps}:
        last = max(r.sequence_id for r in rows)  # may be short, and is a step of its own
        sizes = [len(s) for (t, _), s in steps.items() if t == tier and s != {last}]
        assert not sizes or (max(sizes) - min(sizes) <= 1 and max(sizes) * tier <= packing.STEP_TOKENS)


def test_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 9000, "c"), (3, "one two", "d"), (None, "one two", "e"), (4, "one two", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tier string").withColumn("_id", F.lit("mine"))
    pieces = packing.packed(docs, PATH)
    assert pieces.columns[:3] == ["doc_id", "text", "_id"] and set(pieces.select("_id").distinct().collect()) == {("mine",)}
    held = {}
    for r in pieces.collect():
        assert r.length * 4 == len(r.ids)
        held.setdefault((r.doc_id, r.text), []).append((r.start, bytes(r.ids)))
    assert set(held) == {r[:2] for r in rows}
    assert held[(1, None)] == held[(2, "")] == [(0, b"\1\0\0\0")]
    assert sum(len(ids) for _, ids in held[(3, rows[2][1])]) == 4 * 9001
    joined = packing.sequences(pieces).collect()
    assert sum(len(r.ids) for r in joined) == 4 * (9001 + 2 + 3 * 3)
    assert all(r.offsets[0] == 0 and r.n_pieces == len(r.offsets) for r in joined)
    assert packing.packed(docs.limit(0), PATH).count() == 0
    plain = packing.packed(docs, PATH, keep=["doc_id"], by_word=False, tiers=(512, 256)).agg(F.sum("length"), F.max("offset")).first()
    assert plain[0] == 9001 + 2 + 3 * 3 and plain[1] < 512
