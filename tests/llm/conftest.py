import pytest
from pyspark.sql import Row


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """Invented words, the same for a seed."""
    return " ".join(WORDS[(seed * 7 + i * i + i // 3) % 20] + str((seed * 31 + i * 17) % 97) for i in range(n))


@pytest.fixture
def edge_documents(spark):
    """Null and empty texts, a null id, a very long text, repeated rows, and columns named like the operators' own."""
    rows = [(1, prose(1, 40)), (2, None), (3, ""), (4, " \n\t "), (5, prose(5, 30_000)), (None, prose(6, 20)), (7, prose(7, 40)), (7, prose(7, 40)), (8, prose(7, 40)), (9, "ab")]
    extra = {"key": 1, "key_a": 2, "key_b": 3, "sig": "s", "row": 4, "n": 5, "doc": 6, "drops": 7, "own": 8, "prints": 9, "lang": "en", "source": None, "label": None}
    kinds = "doc_id bigint, text string, key int, key_a int, key_b int, sig string, row int, n int, doc int, drops int, own int, prints int, lang string, source string, label string"
    return spark.createDataFrame([Row(doc_id=i, text=t, **extra) for i, t in rows], kinds).repartition(3)


@pytest.fixture
def no_documents(edge_documents):
    return edge_documents.limit(0)
