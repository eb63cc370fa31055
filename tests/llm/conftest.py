import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from conftest_texts import body  # noqa: E402

#: Documents with every awkward case, and columns whose names clash with what operators make.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, h string, n int, a string, ids string"


def nasty_rows(seed=1, n=24):
    rng = random.Random(seed)
    rows = [(i, body(rng), "ab"[i % 2]) for i in range(n)]
    base = rows[3][1]
    words = base.split(" ")
    near = list(words)
    near[5] = "changed"
    rows += [
        (100, base, "a"), (101, base, "a"), (102, " ".join(near), "a"), (103, base.upper(), "b"), (104, base + "x", "b"),
        (110, None, "a"), (111, "", "a"), (112, " \n\t ", None), (113, "one", "b"), (114, "123 ... !!", "b"), (115, "é", None), (116, None, None),
        (117, "tab\there  two  spaces \n\n lines ", "a"), (118, "nb sp é漢字 щ😀 ﬁ <|endoftext|> <s>", "b"), (119, "a" * 5000, "a"), (120, " ".join(["long"] * 3000), "a"),
        (121, body(random.Random(9), 400), "b"), (122, rows[0][1], "a"), (122, rows[0][1], "a"), (122, "other text of the same id", "a"), (None, "text without an id", "a"), (None, None, None),
        (130, "\x1c\x1f control \x00 nul", "b"), (131, "▁under ▁ mark", "a"), (132, "same same same same same", "a"),
    ]
    return [(i, t, lang, f"s{k % 3}", None if t is None else len(t), 0.5, "key", None, k, "a", None) for k, (i, t, lang) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return nasty_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def patch_tables(spark):
    """A folder of tables from rows, as the queries read them."""
    import tempfile

    def make(**tables):
        folder = tempfile.mkdtemp()
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return folder

    return make
