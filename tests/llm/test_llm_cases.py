"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names; hot groups."""

import gzip
import hashlib
import random
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute
import corpus_pipeline

from labelsense.llm import (
    decontamination,
    graph,
    language_id,
    licenses,
    line_dedup,
    mixing,
    ngram_join,
    pii,
    quality_rules,
    sharding,
    templates,
    warc,
    words,
)

LONG = " ".join(f"word{i} the of and" for i in range(60_000))
CLEAN = "The house of the old man is on the hill and it was there for a long time before the road was made."
ROWS = [
    (1, None, "en", "a", None),
    (2, "", "en", None, 0),
    (3, CLEAN, None, "a", 5),
    (3, CLEAN, None, "a", 5),
    (4, CLEAN, "en", "b", 5),
    (None, CLEAN + " Yes.", "en", "b", 5),
    (5, LONG, "en", "a", 5),
    (6, " \n\t ", "fr", "b", 5),
    (7, "one two", "fr", "c", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = """kept n_words base_failed failed_rules key class id component_id n_links n digest size shard slot copy_no rate
place n_entities n_lines n_dropped lang_pred score rejected line line_no""".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({name: F.lit("mine") for name in CLASHES}).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def benchmark(spark):
    item = "If Alice has 12 apples and gives 5 apples to Bob, how many apples does Alice have after 3 days of giving?"
    rows = [(1, item), (2, None), (3, ""), (4, "too short"), (1, item)]
    return spark.createDataFrame(rows, "item_id long, text string")


# Quality rules


def test_quality(docs, empty):
    rows = quality_rules.judged(docs).collect()
    assert len(rows) == len(ROWS)
    by_text = {r.text: r for r in rows}
    for text in (None, "", " \n\t "):
        assert by_text[text].n_words == 0 and by_text[text].base_failed and not by_text[text].kept
    assert by_text[CLEAN].kept and by_text[CLEAN].failed_rules == []
    assert by_text[LONG].n_words == 240_000 and by_text[LONG].n_repeat_words == 0
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 5 and kept.first().kept == "mine"
    assert quality_rules.judged(empty).count() == quality_rules.kept_documents(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "repeated"),
    [("a b c d e " * 2, 10), ("a b c d e x a b c d e", 10), ("a " * 9, 9), ("a b c d", 0), ("a b c d e", 0)],
)
def test_repeated_windows(spark, text, repeated):
    row = quality_rules.measured_texts(spark.createDataFrame([(text,)], "text string")).first()
    assert row.n_repeat_words == repeated


@pytest.mark.parametrize(
    ("text", "rule"),
    [
        (" ".join(f"Wort{i}### the" for i in range(40)), "symbols_per_word"),
        (" ".join(f"AB{i}C!! THE" for i in range(40)), "upper_case_letters"),
        (" ".join(f"w{i} |" for i in range(40)) + " the the", "words_with_letters"),
        (" ".join(f"xyz{i}" for i in range(60)), "stop_words"),
        ("\n".join(f"the {i // 5}" for i in range(50)), "repeated_lines"),
        (" ".join(f"{i}supercalifragilistic the" * 2 for i in range(30)), "mean_word_length"),
        (" ".join(f"the w{i}!" for i in range(40)), "exclamations_per_word"),
    ],
)
def test_each_rule_finds_its_case(spark, text, rule):
    assert rule in quality_rules.judged(spark.createDataFrame([(text,)], "text string")).first().failed_rules


# N-gram join


def test_ngram_join_cases(spark, docs, empty):
    rows = ngram_join.grouped(docs).collect()
    assert len(rows) == len(ROWS)
    found = {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in rows}
    size = len(brute.shingles(CLEAN, 5))
    assert (3, size, 3, 3) in found and (4, size, 3, 3) in found and (None, size + 1, 3, 3) in found
    assert (1, 0, 1, 0) in found and (7, 1, 7, 0) in found and (6, 0, 6, 0) in found
    assert ngram_join.grouped(empty).count() == ngram_join.one_of_each(empty).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    # Of the copies one row stays, although it is there twice; texts without words all stay.
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 6, 7]


@pytest.mark.parametrize("tile", [2, 256])
def test_hot_columns_are_tiled(spark, monkeypatch, tile):
    """Near copies that share all but a few shingles, with an order of columns that is hot at once."""
    monkeypatch.setattr(ngram_join, "HOT", 3)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    draw = random.Random(5)
    base = [f"w{draw.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(60):
        own = list(base[: draw.choice([150, 149, 140])])
        for _ in range(draw.randrange(6)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(40)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"w{draw.randrange(500)}" for _ in range(40))) for i in range(20)]
    like = ngram_join.Likeness(words=3, percent=90)
    found = ngram_join.grouped(spark.createDataFrame(rows, "doc_id long, text string"), like).collect()
    expected = brute.jaccard_groups(rows, 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in found} == {
        rows[i][0]: group for i, group in expected.items()
    }
    assert sum(links for _, _, links in expected.values()) > 100


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Line deduplication


def test_line_cases(spark, docs, empty):
    rows = line_dedup.deduplicated(docs)
    assert set(rows.columns) == set(docs.columns)
    found = {(r.doc_id, r.text) for r in rows.collect()}
    assert (1, None) in found and (2, "") in found and (6, " \n\t ") in found and (3, CLEAN) in found
    assert (4, "") in found and (None, "") in found  # one word more is one edit
    assert line_dedup.deduplicated(empty).count() == 0


def test_one_edit_against_edit_distance(spark):
    draw = random.Random(3)
    rows = []
    for i in range(40):
        line = [draw.choice("abcd") for _ in range(draw.randrange(1, 9))]
        rows.append((i, "\n".join([" ".join(line), " ".join(line[: draw.randrange(len(line)) + 1] + ["q"])])))
    found = line_dedup.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.id, r.line_no): (r.kept_id, r.kept_line_no) for r in found} == brute.dropped_lines(rows, 5)


# Licences


def test_license_cases(spark, docs, empty):
    texts = [
        (1, "Copyright (c) 2020 Foo\nAll rights reserved.\n\n" + licenses.TEXTS["MIT"].upper()),
        (2, "Some text.\n  ** Licensed under CC-BY-NC 4.0 **\nMore\nReleased under the MIT Licence"),
        (3, licenses.TEXTS["MIT"] + " and more"),
        (4, licenses.TEXTS["BSD-3-Clause"].replace("\n", " ")),
    ]
    found = licenses.license_matches(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.scope, r.line_no, r.license_id) for r in found} == {
        (1, "text", None, "MIT"), (2, "line", 2, "CC-BY-NC-4.0"), (2, "line", 4, "MIT"), (4, "text", None, "BSD-3-Clause"),
        (4, "line", 1, "BSD-3-Clause"),
    }
    assert licenses.license_matches(docs).count() == licenses.license_matches(empty).count() == 0


# Mixing


def test_mix_cases(docs, empty):
    mix = mixing.mixed(docs)
    assert set(mix.columns) == set(docs.columns)
    assert mixing.mixed(empty).count() == 0
    assert mixing.mixed(docs, weights={"zzz": 1.0}).count() == 0
    only = mixing.mixed(docs, weights={None: 1.0, "a": 0.0}, rows=50).collect()
    assert {r.doc_id for r in only} == {2} and len(only) == brute.poisson(50.0, mixing.SEED, 2, mixing.STEP, mixing.DEPTH)


def test_mix_reaches_its_weights(spark):
    rows = [(i, "x", "hot" if i % 3 else f"s{i % 7}") for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = {r["source"]: r["count"] for r in mixing.mixed(table, weights={"hot": 1.0, "s0": 3.0, "s1": 1.0}).groupBy("source").count().collect()}
    assert set(counts) == {"hot", "s0", "s1"}
    for source, share in (("hot", 0.2), ("s0", 0.6), ("s1", 0.2)):
        assert abs(counts[source] - share * 6000) < 300
    first = [r.doc_id for r in mixing.mixed(table).collect()]
    assert first != sorted(first)


# Language identification: what is learned from


def test_language_that_stands_in_one_fold_only(spark, tmp_path):
    import zlib

    draw = random.Random(8)
    fold_of = lambda i: zlib.crc32(str(i).encode()) % 4
    letters = {"one": "abcde", "two": "vwxyz"}
    rows = []
    for i in range(400):
        lang = "two" if fold_of(i) == 3 else "one" if fold_of(i) != 2 else draw.choice(["one", "two"])
        text = " ".join("".join(draw.choice(letters[lang]) for _ in range(5)) for _ in range(20))
        rows.append((i, text, lang))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in language_id.op10_language_id(spark, str(tmp_path)).collect()}
    assert all(found[i].lang_pred == lang and found[i].held_out == (fold_of(i) == 2) for i, _, lang in rows)


def test_rows_set_aside(spark):
    rows = [(f"text {i}", "en") for i in range(300)] + [(f"text {i}", "en") for i in range(300)] + [("rare", "xx"), (None, "en"), ("a", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    counted, aside = (table.collect() for table in language_id.set_aside(docs))
    assert len(counted) + len(aside) == 601 and 10 < len(aside) < 130
    assert not {r.text for r in counted} & {r.text for r in aside} and ("rare", "xx") in counted
    every = [tuple(t.collect()) for t in language_id.set_aside(docs.filter("lang = 'xx'").union(docs.limit(0)))]
    assert len(every[0]) == 1 and not every[1]
    assert all(not t.collect() for t in language_id.set_aside(docs.limit(0)))


# WARC


def test_warc_cases(spark, tmp_path):
    body = "<html>ä</html>"
    rows = [(1, "http://a", body), (2, "http://b", body), (9, "http://c", body), (4, None, None), (5, "u", ""), (None, "n", "x"),
            (7, "http://d", "y" * 300_000), (9, "http://c", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("task", F.lit("mine"))
    folder = f"file://{tmp_path}/archive"
    manifest = warc.write_archives(pages, folder, roll_bytes=700, range_bytes=1 << 30)
    found = warc.read_archives(manifest, folder).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in found) == [
        (0, "response", None, 1), (1, "revisit", 9, 15), (2, "revisit", 9, 15), (4, "revisit", 5, 0), (5, "response", None, 0),
        (7, "response", None, 300_000), (9, "response", None, 15), (9, "response", None, 15),
    ]
    files = sorted(p.name for p in (tmp_path / "archive").iterdir() if p.name.startswith("records"))
    assert len(files) > 3 and files == sorted(r.name for r in manifest.collect())
    assert not (tmp_path / "archive" / "_temporary").exists()
    for row in manifest.collect():
        data = (tmp_path / "archive" / row.name).read_bytes()
        assert hashlib.sha1(data).hexdigest() == row.sha1 and len(data) == row.bytes
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: ") and len(gzip.decompress(data)) == row.raw_bytes
    again = warc.write_archives(pages, f"{folder}-2", roll_bytes=700, range_bytes=1 << 30)
    assert {(r.name, r.sha1) for r in again.collect()} == {(r.name, r.sha1) for r in manifest.collect()}
    none = warc.write_archives(pages.limit(0), f"{folder}-3")
    assert none.count() == warc.read_archives(none, f"{folder}-3").count() == 0


def test_same_files_over_ten_ranges_and_sessions(spark, tmp_path):
    draw = random.Random(2)
    rows = [(i * i, f"http://a b/{i}", draw.choice(["same", "x" * draw.randrange(3000)])) for i in range(600)]
    found = []
    for n, shuffled in enumerate((rows, draw.sample(rows, len(rows)))):
        pages = spark.createDataFrame(shuffled, "page_id long, url string, html string").repartition(3 + n)
        folder = f"file://{tmp_path}/archive-{n}"
        spark.conf.set("spark.sql.shuffle.partitions", 8 + n)
        manifest = warc.write_archives(pages, folder, range_bytes=60_000).collect()
        found.append({(r.name, r.records, r.sha1) for r in manifest})
        table = spark.read.parquet(f"{folder}/manifest")
        read = warc.read_archives(table, folder)
        assert read.rdd.getNumPartitions() == min(len(manifest), 8 + n) and read.count() == 600
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert found[0] == found[1] and len({name.split("-")[1] for name, *_ in found[0]}) >= 10


def test_headers_that_other_readers_need():
    text = warc.record(1, "http://a b", b"x", 9, "http://c d").decode()
    response = warc.record(9, "http://c d", b"x", None).decode()
    own = [line for line in response.split("\r\n") if line.startswith("WARC-Record-ID")][0].split(": ")[1]
    for line in (f"WARC-Refers-To: {own}", "WARC-Refers-To-Target-URI: http://c%20d", "WARC-Target-URI: http://a%20b",
                 f"WARC-Refers-To-Date: {warc.DATE}"):
        assert f"\r\n{line}\r\n" in text
    assert "WARC-Refers-To" not in response
    info = warc.file_record("records-1.warc.gz")
    assert b"WARC-Type: warcinfo\r\n" in info and b"WARC-Filename: records-1.warc.gz" in info and warc.parse(info) is None


def test_damaged_record_is_refused():
    data = bytearray(warc.record(1, "u", b"payload", None))
    data[-8] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(bytes(data))


# Personal data


def test_surrogate_cases(spark, docs, empty):
    text = (
        "Mr. Jan Roe met Mrs. Roe. Then Roe wrote to jan.roe@x.com, JAN.ROE@X.COM and 8.8.8.8. "
        "Call +1 (743) 555-3824 or 743-555-3824. Card 4111 1111 1111 1111, 4111111111111111; token = \"ab12cd34ef\""
    )
    people = "Госпожа Анна Петрова, Frau Anna Müller, Herr Anna Müller"
    table = spark.createDataFrame([(1, text), (2, people), (3, text), (3, text)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.replaced(table).collect()}
    new = rows[1].text
    assert rows[1].n_entities == 10 and rows[3].text == new and pii.replaced(table).count() == 4
    title, given, surname = new.split(" met ")[0].split()
    assert title == "Mr." and f"Mrs. {surname}. Then {surname} wrote" in new and given.endswith("rd")
    assert not any(old in new for old in ("Roe", "jan.roe", "8.8.8.8", "743", "4111", "ab12"))
    mail = new.split("wrote to ")[1].split(",")[0]
    assert mail.upper() in new and mail == mail.lower() and len(mail.split("@")[0]) == 7
    phone = new.split("Call +1 ")[1][:14]
    assert phone[1:4] + "-" + phone[6:] in new
    card = new.split("Card ")[1][:19]
    assert card.startswith("9999 ") and card.replace(" ", "") in new.replace(card, "")
    russian, german, other = rows[2].text.split(", ")
    assert russian.split()[1].endswith("на") and german.split()[1].endswith("na") and other.split()[1].endswith("rd")
    assert german.split()[2] == other.split()[2]
    assert {r.text for r in pii.replaced(docs).collect()} == {r[1] for r in ROWS}
    assert pii.replaced(docs).count() == len(ROWS) and pii.replaced(empty).count() == 0


def test_surrogates_are_distinct(spark):
    """Two digits leave a hundred surrogates, so sixty entities collide and are drawn anew."""
    entities = spark.createDataFrame([("phone", f"{i:02d}") for i in range(30)], "kind string, normal string")
    found = pii.surrogates(entities).collect()
    assert len(found) == len({r.surrogate for r in found}) == 30
    assert not {r.surrogate for r in found} & {r.normal for r in found}


# Decontamination


def test_template_cases(spark, docs, empty, benchmark):
    texts = [
        (1, "Zed said. If Maria has 19 apples and gives 7 apples to John, how many apples does Maria have after 4 days of giving? ok"),
        (2, "If Maria has 19 apples and gives 7 apples to John, how many apples does Peter have after 4 days of giving?"),
        (3, "If Maria has 19 apples and gives 19 apples to John, how many apples does Maria have after 4 days of giving?"),
        (None, "If Alice has 12 apples and gives 5 apples to Bob, how many apples does Alice have after 3 days of giving?"),
        (5, "If Alice has 12 apples then she sells them."),
    ]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    found = {(r.doc_id, r.item_id, r.n_changed) for r in decontamination.contaminated(table, benchmark).collect()}
    # In 2 one name stands for two. In 3 one number does, in the first windows; the others are a leak.
    assert found == {(1, 1, 5), (None, 1, 0), (3, 1, 4)}
    kept = decontamination.clean_documents(table, benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5]
    assert decontamination.contaminated(docs, benchmark).count() == decontamination.contaminated(empty, benchmark).count() == 0
    assert decontamination.contaminated(table, benchmark.limit(0)).count() == 0
    same = decontamination.clean_documents(docs, benchmark)
    assert same.columns == docs.columns and same.count() == len(ROWS)


@pytest.mark.parametrize("seed", range(5))
def test_templates_against_plain_version(seed):
    draw = random.Random(seed)
    pool = ["the", "Of", "and", "Bob", "ALICE", "12", "km", "3.5", "Ärger", "ß", "-", "x9", "9x", "end.", "So?", "\n", "(Zoë)", "a"]
    texts = [" ".join(draw.choice(pool) for _ in range(draw.randrange(60))) for _ in range(20)] + ["", None]
    tokens = templates.Tokens(pa.array(texts, pa.string()))
    at, hashes = tokens.windows(4, 2)
    row = [next(i for i in range(len(texts)) if tokens.first[i] <= a < tokens.first[i + 1]) for a in at.tolist()]
    ours = [(r, int(a - tokens.first[r])) for r, a in zip(row, at, strict=True)]
    theirs = [(i, place, t) for i, text in enumerate(texts) for place, t, _ in brute.templates(text, 4, 2, set(templates.UNITS))]
    assert ours == [(i, place) for i, place, _ in theirs]
    assert brute.one_to_one(set(zip(hashes.tolist(), [t for _, _, t in theirs], strict=True)))


# Sharding


def test_shard_cases(spark, docs, empty):
    rows = sharding.sharded(docs, 3).collect()
    assert len(rows) == len(ROWS) and len({r.shard for r in rows if r.text == CLEAN}) == 1
    assert sharding.sharded(empty, 3).count() == 0
    assert sharding.minimax_cuts(sharding.text_groups(empty), 3) == (0, ["g", "g"])


@pytest.mark.parametrize("seed", range(6))
def test_capacity_against_plain_version(spark, monkeypatch, seed):
    monkeypatch.setattr(sharding, "FIRST_PREFIX", 1)
    monkeypatch.setattr(sharding, "MORE_PREFIX", 1)
    draw = random.Random(seed)
    sizes = [draw.choice([1, 3, 9, 50, 400 if seed % 2 else 20]) for _ in range(draw.choice([1, 5, 300]))]
    groups = {hashlib.md5(f"{seed}{i}".encode()).hexdigest(): size for i, size in enumerate(sizes)}
    table = spark.createDataFrame(list(groups.items()), "digest string, size long")
    for shards in (1, 2, 7, 24):
        capacity, cuts = sharding.minimax_cuts(table, shards)
        assert capacity == brute.smallest_capacity([groups[d] for d in sorted(groups)], shards)
        held = [0] * shards
        for digest, size in groups.items():
            held[sum(digest >= cut for cut in cuts)] += size
        assert max(held) == capacity and len(cuts) == shards - 1


# Language identification


def test_language_cases(spark, docs, empty):
    model = language_id.trained(docs, docs)
    rows = language_id.identified(docs, model).collect()
    assert len(rows) == len(ROWS) and set(rows[0].asDict()) == set(docs.columns) | {"cross_entropy"}
    for row in rows:
        assert (row.lang_pred == "und") == (row.text is None or not any(c.isalpha() for c in row.text))
        assert 0 <= row.score <= 1
    nothing = language_id.trained(empty, empty)
    assert {r.lang_pred for r in language_id.identified(docs, nothing).collect()} == {"und"}
    assert language_id.identified(empty, model).count() == 0


def test_kneser_ney_sums_to_one(spark):
    texts = [("en", "the old house the end then they"), ("de", "der die das dann dort der")]
    table = spark.createDataFrame(texts, "lang string, text string")
    model = language_id.trained(table, table.limit(0))
    letters = sorted({c for _, t in texts for c in t.lower() if c.isalpha()})
    codes = [0, *[ord(c) for c in letters]]
    for context in ("the", "xyz", "d", ""):
        history = [ord(c) for c in reversed(context)][:3]
        history += [0] * (3 - len(history))
        import numpy as np

        rows = np.array([codes, *[[h] * len(codes) for h in history]], np.uint64)
        total = np.exp(language_id.log_probabilities(model, rows).astype(float)).sum(axis=0)
        # The even law counts one letter more, for all that were never seen.
        assert ((total <= 1.001) & (total > 0.9)).all()


def test_foreign_text_is_rejected(spark):
    model = language_id.trained(
        (docs := spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")),
        docs.filter(F.col("doc_id") % 4 == 3),
    )
    table = spark.createDataFrame([("zxqj wvkk pqzx jjkw " * 40,), ("Ωδφγ ξψζ " * 60,)], "text string")
    assert all(r.rejected and r.lang_pred != "und" and r.score < 1 for r in language_id.identified(table, model).collect())
    own = language_id.identified(docs, model).filter("NOT rejected").count()
    assert own >= 0.97 * docs.count()


# Words


def test_word_hashes_across_blocks(monkeypatch):
    texts = ["Ab cd\tef  ab", "", None, "x" * 50 + " ab", "\x0b\x0c ß AB"]
    whole = [list(words.shingle_sets(pa.array(texts, pa.string()), 1))]
    monkeypatch.setattr(words, "BLOCK", 4)
    assert [[s.tolist() for s in sets] for sets in [list(words.shingle_sets(pa.array(texts, pa.string()), 1))]] == [
        [s.tolist() for s in sets] for sets in whole
    ]
    sliced = pa.array(["zz", *texts], pa.string()).slice(1)
    assert [s.tolist() for s in words.shingle_sets(sliced, 1)] == [s.tolist() for s in whole[0]]
    assert len(whole[0][0]) == 3 and len(whole[0][1]) == len(whole[0][2]) == 0


# Pipeline


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_cases(spark, docs, empty, benchmark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert set(out.columns) >= set(docs.columns) and out.count() > 0
    if name != "sharding":
        assert out.columns == docs.columns and {r.kept for r in out.collect()} == {"mine"}
    assert stage(spark, empty, str(tmp_path)).count() == 0


def test_characters_across_blocks(monkeypatch):
    texts = ["The old House.", "", "  ÄÖ 12 x", "abc" * 20, "..."]
    codes, starts = language_id.characters(texts)
    assert starts.tolist() == [0, 14, 14, 19, 80, 80]
    whole = [(t.tolist(), rows.tolist()) for t, rows in language_id.histories(codes, starts)]
    monkeypatch.setattr(language_id, "BATCH_CHARS", 7)
    parts = [(t.tolist(), rows.tolist()) for t, rows in language_id.histories(codes, starts)]
    assert len(whole) == 1 and len(parts) == 12
    assert whole[0][0] == [x for t, _ in parts for x in t]
    assert whole[0][1] == [[x for _, rows in parts for x in rows[k]] for k in range(4)]
    assert bytes(whole[0][1][0][:4]) == b"the\0" and whole[0][1][1][:5] == [0, *b"the\0"[:4]]
