import pytest
from pyspark.sql import types as T

from fillgauge.llm import ship

LONG = "Long words go on and on, number after number. " * 9000

#: Repeated rows, NULL and equal ids, NULL, empty, blank, very long and foreign texts.
EDGE = [(1, "Some words stand here, and more of them follow.\nA line ends."), (2, None), (3, ""), (None, "no id at all"),
        (5, "Some words stand here, and more of them follow.\nA line ends."), (5, "twice the same row"),
        (5, "twice the same row"), (6, LONG), (7, " \t\n  \r\n "), (8, "\u00c4\u00d6 \u6f22\u5b57 \U0001f600 na\u00efve \u2003 x"),
        (9, "SOME words stand here, AND more of them follow.\nA line ends."), (None, None)]


@pytest.fixture(scope="session")
def shipped(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def clash():
    """Names that operators use for results or inside."""
    return ["kept", "row", "slice", "place", "hash", "size", "n_words", "score", "lang_pred", "__text", "bucket",
            "token_ids", "sequence_id", "offset", "start", "id", "digest", "class", "words", "block", "train", "n"]


@pytest.fixture(scope="session")
def edge(shipped, clash):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
                          + [T.StructField(c, T.StringType()) for c in clash])
    return shipped.createDataFrame([r + (f"{i}",) * len(clash) for i, r in enumerate(EDGE)], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
