import pytest

#: Columns whose names operators use themselves.
CLASHES = ("n", "key", "rep", "score", "label", "text_hash", "cover", "found", "_tokens", "_copies", "salt", "kept", "words", "host", "column_1")


def words(rng, n, vocabulary=40):
    return " ".join(f"{'abcdefgh'[rng.randrange(8)]}{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def messy():
    """Ids, texts: copies, near copies, shared passages, nulls, repeated rows, ties, and one very long text."""
    import random

    rng = random.Random(7)
    passage = words(rng, 60, 900)
    rows = []
    for i in range(60):
        rows.append((i, words(rng, rng.choice((3, 30, 90)), 900) + ". " + (passage if i % 3 == 0 else "") + " " + words(rng, 20, 900)))
    for i in range(60, 90):  # copies and near copies of a hub and along a chain
        base = rows[i % 7][1].split(" ")
        if i % 2:
            base[rng.randrange(len(base))] = f"edit{i}"
        rows.append((i, " ".join(base)))
    rows += [(90, None), (91, ""), (92, "   \n"), (93, "one"), (94, "one"), (95, "Ünï cödé ’quoted’ text with  odd\tspaces \n"), (96, "<|endoftext|> x")]
    rows += [rows[5], rows[5], (None, rows[6][1]), (None, None), (97, words(rng, 60_000, 5000))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, messy):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(messy, "doc_id long, text string").repartition(5)
    return df.select("doc_id", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)], "text", F.lit("en").alias("lang"))


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("1 = 0")


@pytest.fixture(scope="session")
def benchmark(spark, messy):
    first = messy[0][1].split(" ")
    rows = [(1, " ".join(first[2:20]).upper()), (2, "one"), (3, "never seen anywhere at all"), (4, None), (5, ""), (None, "one"),
            (1, " ".join(first[2:20])), (6, messy[3][1]), (7, "code’s x")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark, messy):
    rows = [(i, int(i % 5 > 0), int(i % 11 == 0)) for i, _ in messy if i is not None] + [(None, 1, 0), (3, None, None), (4, 7, 0), (10**12, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
