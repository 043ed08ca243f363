"""Findings of round 5: what moves and how often texts are split."""

import pytest

from labelsense.operators import scale
from labelsense.plans import registry, table_stages

ODD = [
    (1, ["b", "a", "b", "d"]), (1, ["b", "a", "b", "d"]), (2, ["a", None, "c"]), (3, []), (4, None), (5, ["never seen", "d"]),
    (None, ["c", "a"]), (6, [None]), (7, ["a"]),
]


@pytest.mark.parametrize("fits", [True, False])
@pytest.mark.parametrize("listed", [1, 2, 10])
def test_only_rare_words_are_joined(spark, monkeypatch, listed, fits):
    rows = spark.createDataFrame(ODD, "id long, words array<string>")
    model = table_stages.TableWordSetEstimator(limitTo=4).fit(rows.filter("id is null or id != 5"))
    order = [r.word for r in model.table.orderBy("rank").collect()]
    assert order == ["a", "b", "c", "d"]
    joined = []

    def lookup_join(left, table, on, *rest, **named):
        if on == ["word"]:
            joined.extend(r.word for r in left.collect())
        return scale.lookup_join(left, table, on, *rest, **named)

    monkeypatch.setattr(table_stages, "LISTED_WORDS", listed, raising=False)
    monkeypatch.setattr(table_stages, "lookup_join", lookup_join)
    if not fits:
        monkeypatch.setattr(scale, "BROADCAST_ROWS", -1)
    for index in (True, False):
        model = model.copy({model.indexWords: index})
        held = [sorted({order.index(w) for w in words or [] if w in order}) for _, words in ODD]
        expected = [(i, places if index else [order[p] for p in places]) for (i, _), places in zip(ODD, held, strict=True)]
        found = [(r.id, r.features) for r in model.transform(rows).collect()]
        assert sorted(found, key=str) == sorted(expected, key=str)
    assert joined and not set(joined) & set(order[:listed])


TEXTS = ["red wine", "red red Oak", "", "lime, red oak!", "42", "oak", "oak"]


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize(
    "name, expected",
    [
        ("word_list", [(0, "red wine"), (1, "oak red"), (2, ""), (3, "oak red lime"), (4, ""), (5, "oak"), (5, "oak")]),
        ("word_vector", [(0, 1), (0, 3), (1, 0), (1, 1), (3, 0), (3, 1), (3, 2), (5, 0), (5, 0)]),
    ],
)
def test_texts_split_once(spark, tmp_path, name, expected):
    # The last document comes twice, the first has no language.
    documents(spark, tmp_path, [(min(i, 5), "en" if i else None, text) for i, text in enumerate(TEXTS)])
    result = registry.queries()[name](spark, str(tmp_path))
    assert "regexp_extract_all" not in result._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, result.collect())) == expected


@pytest.mark.parametrize("name", ["word_list", "word_vector"])
def test_null_texts_are_refused_as_before(spark, tmp_path, name):
    documents(spark, tmp_path, [(1, "en", "red"), (2, "en", None)])
    with pytest.raises(Exception, match="CountVectorizerModel"):
        registry.queries()[name](spark, str(tmp_path)).collect()
