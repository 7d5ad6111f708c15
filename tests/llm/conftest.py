import duckdb
import pytest

TABLES = ["documents", "embeddings", "pages", "labels"]


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def documents(duck):
    """The whole table as (doc_id, text, lang, source)."""
    return duck.execute("select doc_id, text, lang, source from documents order by doc_id").fetchall()


@pytest.fixture(scope="session")
def make(spark):
    """Rows as a table with columns whose names clash with those of results and helpers."""

    def build(rows, schema="doc_id long, text string, lang string, source string"):
        extra = "score double, kept boolean, size string, `row` int, spans string, copies int, judged string, rank int"
        return spark.createDataFrame([(*r, 0.5, True, "x", 1, "s", 9, "j", 3) for r in rows], f"{schema}, {extra}")

    return build


#: Null and empty texts, texts without letters, one very long word, and long, equal and repeated rows.
ODD = [
    (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (4, "12 34 !?", None, "b"), (5, "x" * 30_000, "en", "b"),
    (6, "the quick brown fox " * 3_000, "en", None), (7, "the quick brown fox jumps over it", "en", "a"),
    (7, "the quick brown fox jumps over it", "en", "a"), (None, "a text without an id at all", "en", "a"),
    (8, "naïve 中文 🙂 text\x00\x1c\x85 end", None, "b"), (9, "one", "en", "c"), (10, "one", "en", "c"),
]


@pytest.fixture
def odd(make):
    return make(ODD)


@pytest.fixture
def empty(make):
    return make([])
