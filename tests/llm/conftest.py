import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])

SYLLABLES = "ka lo mi ren tu ver sa ion est ul ga pre con di mar el ço né über".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): nulls, empty, very long, ties, copies, near copies, repeats in a text,
    shared passages of various lengths, junk, text beyond ASCII, separators of all kinds."""
    rng = random.Random(5)
    passage, short = prose(rng, 90), prose(rng, 12)
    long_ = prose(rng, 9000)
    a, b, c = prose(rng, 160), prose(rng, 200), prose(rng, 140)
    words = b.split()
    near = " ".join([*words[:100], "changed", *words[101:]])
    texts = [
        None, "", "   \n\t ", "one", "one two", "one two three", "One TWO three", a, a, a, b, near, near + " tail", long_, long_[:20000] + " x " + long_[30000:],
        f"{prose(rng, 70)}\n{passage}\n{prose(rng, 70)}", f"{prose(rng, 30)} {passage}", f"{passage} {prose(rng, 90)}", f"{c}\n{c}", f"{short} {prose(rng, 60)}", f"{prose(rng, 60)} {short}",
        "la " * 700, "x" * 3000, "x" * 1200, "=-" * 600, "a\x0bb\x0cc\rd\te\nf  g " * 40, "naïve café übér 日本語テキスト 😀😀 " * 30, "Ünïcödé " + "日" * 500,
        " ".join(w + "###" for w in a.split()), " ".join(w.upper() + "!!" for w in c.split()), " | ".join(b.split()), "same line here\n" * 60, "\n".join([prose(rng, 9)] * 3 + [prose(rng, 9) for _ in range(9)]),
        "tail spaces   ", "\n\nhead", "don't you'll we've I'm  12345 3.14  ...!!!   end　x\x1c\x1dy\x85z",
    ]
    texts += [prose(rng, rng.randint(55, 300)) for _ in range(25)]
    rows = [(7 * i % 101 + (i // 101), t) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(d, t, "en", f"s{i % 2}", len(t or "")) for i, (d, t) in enumerate(corpus)], DOCUMENTS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
