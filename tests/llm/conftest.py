import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def rows(words):
    """Documents with nulls, empty and long texts, ties, exact and near copies, repeated rows and shared passages."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(60), text(120)
    out = [(0, None, "s0"), (1, "", "s0"), (2, " \t\n", None), (3, "one", "s1"), (4, "one two three", "s1"), (5, "one  two\tthree", "s2"), (6, text(30_000), "s2")]
    for i in range(7, 40):
        out.append((i, text(rng.randint(1, 200)), f"s{i % 3}"))
    for i in range(40, 60):
        near = base.split()
        for _ in range(i % 7):
            near[rng.randrange(len(near))] = rng.choice(words)
        out.append((i, " ".join(near) if i % 2 else " ".join(near).upper(), "s0"))
    for i in range(60, 70):
        out.append((i, f"{text(rng.randint(0, 40))} {passage} {text(10)}", "s1"))
    out += [(70, out[10][1], "s1"), (71, out[10][1], "s9"), (12, out[12][1], out[12][2]), (72, "x " * 200, "s0"), (73, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return df.withColumns({"node": F.lit("n"), "size": F.lit(1), "row": F.lit(2), "id": F.lit(3), "score": F.lit(0.5), "keep_id": F.lit(9), "label": F.lit("z"), "seg": F.lit("q")}).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id < 0")
