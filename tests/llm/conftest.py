import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sample():
    """(doc_id, text) of the smallest documents table."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in rows]


ODD = [None, "", " ", "\n", "a", "a b", "a a a a a a a", "A B c\nA B c\n\nA B c", "x" * 3000, "été ß İ 漢字 \U0001f600 é", "one two three four five six\x0bseven\x1ceight nine ten", "end\n", "\nstart", "w " * 5000]


@pytest.fixture(scope="session")
def odd():
    """Texts at the edges, with a repeated row and a null id."""
    return [*enumerate(ODD), (3, "\n"), (None, "no id here"), (7, "A B c\nA B c\n\nA B c")]
