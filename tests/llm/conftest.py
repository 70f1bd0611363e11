import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
    # Columns that operators use as helpers themselves.
    + [T.StructField(n, T.LongType()) for n in ("fp", "row", "key", "copies", "place", "label", "start", "_id", "n_tokens")]
)
WORDS = "alpha beta gamma delta omega sigma kappa theta lambda epsilon zeta iota".split()


def prose(k, n):
    return " ".join(WORDS[(k * 7 + i * i + i // 3) % 12] + str((k * 31 + i) % 97) for i in range(n))


def edge_rows():
    rows = [
        (1, prose(1, 80), "en", "src1"), (2, prose(1, 80), "en", "src1"), (3, prose(1, 80).upper(), "en", "src2"), (4, prose(4, 60) + "\n" + prose(5, 60), "de", "src2"),
        (5, "", "en", "src1"), (6, None, "fr", "src3"), (7, " \t\n\x0b\x0c\r ", "en", None), (8, "one", None, "src9"), (9, "one two", "es", "odd"), (10, "Ünïcödé 文字 🙂 \xa0 \x1c x", "en", "src15"),
        (11, "repeat this again " * 60, "en", "src1"), (12, prose(12, 30000), "en", "src1"), (13, "a" * 60000, "en", "src4"), (14, "!@#$%^&*()" * 300, "en", "src4"),
        (15, prose(15, 70), "en", "src1"), (15, prose(15, 70), "en", "src1"), (16, prose(16, 70), "en", "src1"), (16, prose(17, 70), "en", "src1"), (None, prose(18, 70), "en", "src1"), (None, None, None, None), (-3, prose(1, 80), "en", "src18"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None, *range(9)) for r in rows]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
