import pytest

LONG = " ".join(f"wort{i % 977}x" for i in range(30_000))
TEXTS = [None, "", " \t\n", "plain words stand here", "plain  words\tstand here\n", "plain words stand here",
         "123 456 !!", "a\x0bb", "ſtraße İstanbul 漢字 😀 نص", LONG, "x" * 5000]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [(i, t, "en", "s1", 1, "w") for i, t in enumerate(TEXTS)]
    rows += [(None, "plain words stand here", None, None, None, None), (None, None, None, None, None, None),
             (3, "plain words stand here", "en", "s1", 1, "w"), (3, "another text of the same id", "de", "", 2, "v")]
    # blob, fp, sha, k, h, id, rid: names that the operators use inside
    return spark.createDataFrame([(*r, 7, 7, 7, "h") for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, id string, "
                                 "fp long, sha long, rid long, host string").repartition(3)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows_of(df):
    return [tuple(r) for r in df.collect()]
