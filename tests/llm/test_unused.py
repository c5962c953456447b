"""What a mix leaves unused."""

from quern.llm import mixing


def test_unused_tokens(spark):
    docs = spark.createDataFrame([(i, "A", 10) for i in range(20)] + [(100, "b", 10)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    got = {r["source"]: (r["held"], r["unused"]) for r in mixing.unused(mixing.mix(docs, targets), docs).collect()}
    assert got == {"a": (200, 180), "b": (10, 0)}
