from __future__ import annotations

import pytest


@pytest.fixture(scope="module", autouse=True)
def compiled(spark):
    """Production settings: the small sessions of other tests run interpreted."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "2")


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


@pytest.fixture
def odd_rows(spark):
    """NULLs, empty, repeated and tied rows, a very long text, clashing extra columns."""

    def build(text_col: str = "text", key: str = "doc_id", long_text: str | None = None):
        long_text = long_text or " ".join(WORDS[(k * k + k // 7) % 19] + str(k % 101) for k in range(20_000))
        rows = [
            (1, "same words in this text", "x", 1.0),
            (1, "same words in this text", "x", 1.0),
            (1, "other words under this key", "y", 2.0),
            (2, None, None, None),
            (3, "", "z", 0.0),
            (None, "a text without a key", None, 1.0),
            (None, None, None, None),
            (4, long_text, "x", 3.0),
            (5, " \n\t ", "x", 3.0),
        ]
        schema = f"{key} long, {text_col} string, source string, id double"
        frame = spark.createDataFrame(rows, schema)
        return frame.withColumns({"key": frame[key], "shard": frame["id"], "fp": frame[text_col], "n": frame["id"]})

    return build
