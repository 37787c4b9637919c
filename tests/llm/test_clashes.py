"""Columns named like an operator's own, nulls and repeated rows in stages of the pipeline."""

import corpus_pipeline
from genoframe.llm.toxicity import fit_toxicity

ROWS = [
    (1, "write to a.b@c.org now", "en", "s", 22, 0.5, "p", "x", "c"),
    (2, None, "en", None, 0, None, None, None, None),
    (2, None, "en", None, 0, None, None, None, None),
    (3, "", None, "s", 0, 1.5, "q", "y", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string, spans string, clean string"


def test_stages_keep_other_columns(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("i", "one two")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect(), key=str) == sorted(docs.collect(), key=str)
    assert corpus_pipeline.decontamination(spark, docs, str(tmp_path)).columns == docs.columns
    out = corpus_pipeline.personal_data(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == "write to [EMAIL] now" and got[1]["n_chars"] == 20
    assert (got[1]["score"], got[1]["predicted"], got[1]["spans"], got[1]["clean"]) == (0.5, "p", "x", "c")
    assert got[2]["text"] is None and got[3]["text"] == ""


def test_repeated_labels_and_documents(spark):
    texts = [(k, "kind warm words here" if k % 2 else "vile awful words here") for k in range(40)]
    docs = spark.createDataFrame([r for r in texts for _ in range(3)] + [(None, "x"), (99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k, _ in texts for _ in range(2)] + [(None, 1), (99, None)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    assert model.score("vile awful") > 0.5 > model.score("kind warm")
    assert 0 <= model.score("") <= 1 and model.score("12 345 6") == model.score("")


def test_near_dedup_among_rows_of_one_id(spark, tmp_path):
    """Different texts of one id are documents of their own; rows without id are compared too; of equal rows the least other columns stay."""
    long = " ".join(f"w{k}" for k in range(60))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "b", {"x": 1}), (1, "one two three four five six seven", "a", {}), (2, long, "z", None), (2, long, "c", None), (None, long + " more", "d", {}),
        (None, "only here and nowhere else at all", "e", {}), (None, "only here and nowhere else at all", "f", {}), (3, None, "n", {}), (4, "", "m", {}),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key map<string,int>")
    out = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str)
    want = [(1, rows[0][1], "b"), (1, rows[1][1], "a"), (2, long, "c"), (None, rows[5][1], "e"), (3, None, "n")]
    assert got == sorted(want, key=str)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), str(tmp_path)).count() == 0
