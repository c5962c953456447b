"""Languages with few labels among many of another are learnt."""

from quern.llm import langid


def test_rare_language_is_sampled(spark):
    rows = [(i, f"the house number {i} stands on the hill", "en") for i in range(2000)] + [(2000, "къщата стои на хълма", "bg"), (2001, "huset ligger på bakken", "Danish")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = langid.training_rows(df, rows=100)
    assert set(sample["code"]) == {"bg", "da", "en"} and 50 < (sample["code"] == "en").sum() < 200
    assert langid.train(sample, steps=3).classes == ["bg", "da", "en"]
