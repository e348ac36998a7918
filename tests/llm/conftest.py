import pytest


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Rows as a table read from files, as the operators meet them; extra columns have names that operators use inside."""

    def make(rows, files=2, clash=True):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if clash:
            for c in ("row", "n", "h", "band", "cid", "__text", "__locator", "digest", "bucket", "kept", "score", "block", "length"):
                df = df.selectExpr("*", f"'x' AS `{c}`")
        at = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        df.repartition(files).write.parquet(at)
        return spark.read.parquet(at)

    return make


def doc(doc_id, text, lang="en"):
    return doc_id, text, lang, "src", len(text or "")


@pytest.fixture(scope="session")
def as_doc():
    return doc
