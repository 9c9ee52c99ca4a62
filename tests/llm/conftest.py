import pytest

#: Columns that an operator might use inside; they must not matter.
CLASH = ["length", "start", "ids", "score", "node", "component", "src", "dst", "_k", "_bucket", "_hash", "block", "list", "n_shingles"]
WORDS = "der die das und the of and to la le de que el los en un ist auf from with pour dans como esta".split()


def sentence(seed: int, n: int) -> str:
    import random
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice("abcdefg") * r.randint(0, 2) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Rows to a documents table with columns of clashing names."""
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        width = len(schema.split(", "))
        full = [tuple(r) + (None,) * (width - len(r)) for r in rows]
        df = spark.createDataFrame(full, schema)
        for c in CLASH:
            df = df.selectExpr("*", f"cast(null as string) as `{c}`")
        return df
    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Null and empty texts, a null id, repeated rows and ids, one very long text."""
    long = sentence(1, 30_000)
    return [(1, None), (2, ""), (None, sentence(2, 40)), (3, "  \n\t "), (4, sentence(3, 60)), (4, sentence(3, 60)), (5, sentence(3, 60)),
            (6, long), (7, sentence(4, 3)), (7, sentence(5, 50)), (8, "x" * 70_000), (9, "½ 1234 !!"), (10, "ß Σίσυφος ﬁ é́ 日本")]
