import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("_row", "weight", "prob", "block", "score", "first")]
)


def awkward_texts():
    """Nulls, empty, long, tied and repeated texts, near copies and shared passages."""
    words = [f"w{(i * i * 7919 + i * 31) % 977}x{i % 13}" for i in range(900)]
    passage = " ".join(words[100:170])
    texts = [None, "", " \n\t ", "one", "one", "a b c d", "a b  c\td", "é" * 30 + " ü", "　x y z '  s don't  it's\n\n end ", "same same same same " * 40, "12345 !!! ???"]
    texts += [" ".join(words[:300]), " ".join(words[:300]), " ".join([*words[:150], "changed", *words[151:300]])]
    texts += ["first " + passage + " tail one", "other words before " + passage + "\nand after", passage, passage[10:]]
    texts += [" ".join(words[i : i + 120]) for i in (300, 420, 540, 660)]
    texts += ["aaaa " * 20_000 + " ".join(words[700:900]), "b" * 70_000 + " ".join(words[700:900])]
    return texts


@pytest.fixture(scope="session")
def awkward(spark):
    """Columns that clash with the operators' own names, a row without an id, nulls in every column."""
    texts = awkward_texts()
    rows = [(i * 3, t, ("en", "fr", None)[i % 3], (None, "s1", "s2")[i % 3], None if t is None else len(t), *"xyzuvw") for i, t in enumerate(texts)]
    rows.append((None, "no id", "en", "s1", 5, *[None] * 6))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows_of(awkward):
    return {r.doc_id: r.text or "" for r in awkward.filter(F.col("doc_id").isNotNull()).collect()}
