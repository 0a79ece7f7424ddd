import pytest

#: Names that operators use inside; a table may have columns of the same names.
CLASHING = """copies bucket h1 h2 q score slot shard drop node p target wanted n_docs cut end low high most steps key words gap done upto before taken
got all source_size row rows lines kept gone t pos h last _doc _t _h1 _h2 _salt _s _e _lines _kept _drop class class_id head bands root band guest
half y held_out predicted media shard_ part task late j n word gram v rank vec_id query_id u s_ u_ m""".split()


@pytest.fixture
def docs(spark):
    """A function that makes a table of documents from (doc_id, text) or (doc_id, text, source) rows, with clashing extra columns."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", 0, i) for i, r in enumerate(rows)]
        base = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size long")
        return base.selectExpr("*", *(f"size as `{name}`" for name in CLASHING))

    return make
