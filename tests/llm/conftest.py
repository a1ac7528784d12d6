import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """A small corpus with nulls, empty and long texts, repeated rows and clashing extra columns."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    long = " ".join(words[(i * i + i // 7) % len(words)] + str(i % 13) for i in range(6000))
    base = " ".join(words[(i * 7) % 24] + str(i) for i in range(120))
    near = base.replace("alpha0", "changed")
    rows = [
        (1, base, "en"), (2, near, "en"), (2, near, "en"), (3, None, None), (4, "", "de"), (5, "   \n\t ", "de"), (6, "one", "en"), (7, "one", "fr"), (8, long, "en"),
        (9, long[:5000] + " tail", "en"), (10, "Ünïcode ñandú 漢字 <|endoftext|> 123 it's", "es"), (None, "no id here " * 3, "en"), (11, "ab" * 700, "en"), (12, base + " " + long[:900], "en"),
    ]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, lang string, ids string, key string, label string")
