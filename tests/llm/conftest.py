"""Small tables of documents that hold what operators must handle: nulls, empty and long texts, copies, clashing columns."""

import random

import pytest

SYLLABLES = ["ka", "to", "mi", "ren", "so", "lu", "vi", "dor", "an", "es", "qui", "ble"]


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    base = [words(rng, rng.randint(30, 120)) + ".\n" + words(rng, 20) for _ in range(40)]
    passage = words(rng, 60)
    out = {i: t for i, t in enumerate(base)}
    out[40], out[41] = base[3], base[3]
    out[42] = base[4] + " " + words(rng, 2)
    out[43], out[44] = base[5] + "\n" + passage, passage + "\n" + base[6]
    out[45], out[46], out[47] = "", None, "   \n\t "
    out[48] = "naïve café 日本語のテキスト 😀 " * 30
    out[49] = "x" * 5000
    out[50] = " ".join([words(rng, 12)] * 400)
    out[51] = "one two three"
    out[52] = "<|endoftext|> a  b\tc <|startoftext|>"
    return out


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, texts, tmp_path_factory):
    rows = [(i, t, ["en", "fr", None][i % 3], ["h1", "h2", None][i % 3], None if t is None else len(t)) for i, t in texts.items()]
    rows += [(7, texts[7], "en", "h1", 1), (None, texts[8], None, None, 1), (None, "no id here at all", "fr", "h2", 1)]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], COLUMNS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def clashing(docs, spark, tmp_path_factory):
    """docs with columns that operators might use names of."""
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("clash") / "documents.parquet")
    names = ["row", "chunk", "n", "label", "score", "bucket", "kept", "hash", "id", "shard", "signature", "line", "task"]
    docs.select("*", *[F.lit(str(i)).alias(c) for i, c in enumerate(names)]).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def labels(spark, texts):
    return spark.createDataFrame([(i, 1 if i % 2 else 0, 0) for i in range(40)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
