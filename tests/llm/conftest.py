import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

PROSE = (
    "The harbour was quiet when the first boats came in, and nobody on the quay spoke above a whisper. "
    "A cart of nets stood by the wall; somebody had left a lamp burning on it through the night. "
    "By noon the market had filled, and the talk was of weather, of prices and of the road to the north."
)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rows = [
        (5, PROSE, "en", "a", len(PROSE)),
        (4, PROSE, None, "a", None),
        (4, PROSE, None, "a", None),
        (9, None, "en", None, None),
        (8, "", "en", "b", 0),
        (7, "  \n\t ", None, "b", 5),
        (None, PROSE + " And then the rain.", "en", "b", 1),
        (None, None, None, None, None),
        (3, "word", "en", "a", 4),
        (2, "Ünïcödé ½ ² — 日本語 \U0001f600 don't  stop  ", "xx", "c", 30),
        (1, " ".join(f"w{k % 977}" for k in range(60_000)), "en", "c", 1),
        (6, "x" * 300_000, "en", "c", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd_docs):
    """Extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    return odd_docs.withColumns({n: F.lit(k).cast(T.LongType()) for k, n in enumerate(["batch", "n", "label", "score", "id", "part", "bucket", "rank", "media", "fingerprint", "secrets", "piece", "length", "body", "host", "path"])})
