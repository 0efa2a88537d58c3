import pytest

#: Rows that every operator over texts has to stand: nulls, empty, long and repeated texts.
ODD = [
    (1, "the cat sat on the mat and the dog ran away from the cat", "en", "a"),
    (2, "the cat sat on the mat and the dog ran away from the cat", "en", "a"),
    (2, "the cat sat on the mat and the dog ran away from the cat", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, "   \n\t ", "de", "b"),
    (None, "eine katze sitzt auf der matte und der hund rennt davon", "de", None),
    (6, "word " * 5000, "en", "c"),
    (7, "x" * 20000, None, "c"),
    (8, "der hund und die katze und das haus ist nicht so alt", "de", "a"),
]


@pytest.fixture
def odd(spark):
    """The odd rows with further columns whose names operators use inside."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1L as id", "'q' as fp", "2 as size", "3 as shard", "4 as run", "5 as length", "6.5D as score")


@pytest.fixture
def empty(odd):
    return odd.limit(0)
