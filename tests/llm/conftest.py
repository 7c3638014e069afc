import random

import pytest
from pyspark.sql import functions as F

CLASHING = ["block", "bucket", "rid", "names", "id", "part", "label", "rest", "text_key", "size", "set_id", "token", "cell", "host", "host_"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names the operators use themselves."""
    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for c in CLASHING:
            df = df.withColumn(c, F.lit(7))
        return df
    return make


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Repeated rows, copies, near copies, shared passages, empty, null and long texts."""
    rng = random.Random(5)
    passage, other = prose(rng, 60), prose(rng, 45)
    out = [prose(rng, rng.randint(1, 200)) for _ in range(30)]
    out += [out[3], out[3], out[4] + " tail", "x " + out[5], prose(rng, 20) + " " + passage + " " + prose(rng, 9), passage, prose(rng, 5) + " " + passage,
            other + " " + other, None, "", "   \n", "one", "one two three", "one two three", "é" * 150, "é" * 149, "aé" * 90, prose(rng, 3000), "a" * 500]
    long = out[47 - 2].split(" ") if out[45] else []
    out.append(" ".join(long[:100] + ["changed"] + long[101:]))
    return out
