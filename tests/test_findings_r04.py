"""Findings of round 4: words left out by a share of the rows."""

import duckdb
import oracle

from labelsense.plans import oracles, registry


def test_rare_base_forms_are_lemmas(spark, tmp_path):
    texts = ["gallivant home", "gallivanting home", "gallivanted Gallivants home", "", None, "went home", "go home"]
    texts += ["home"] * 400  # so that the base form is in less than one row in a hundred
    docs = spark.createDataFrame([(i, "en", text) for i, text in enumerate(texts)], "doc_id long, lang string, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.word: r["count"] for r in registry.lemmatised_words(spark, str(tmp_path)).collect()}
    assert found == {"gallivant": 3, "home": 405, "go": 2}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rows = registry.lemmatised_words(spark, str(tmp_path))
    assert oracle.differences(rows, duck, oracles.oracle_sql()["lemmatised_words"]) == ""
