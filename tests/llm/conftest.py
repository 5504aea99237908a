import random

import pytest

SYLLABLES = ["the", "and", "er", "in", "on", "re", "tion", "ed", "th", "an", "é", "or"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, copies, near copies, shared passages, null, empty and odd texts."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(3, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 5)}" for _ in range(4)]
    texts += [texts[0]] * 3 + [texts[1] + " extra", texts[1] + " other", texts[1].replace("the", "THE")]
    texts += [None, "", " \t\n", "a", "A b", "é" * 300, "ab" * 400, "x " * 300, "日本語 " * 30, "😀 <|endoftext|> it's", passage[:100], passage * 3]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With columns whose names operators use for their own results."""
    rows = [(i, t, "en" if i % 2 else "fr", "s", None if t is None else len(t), float(i), True) for i, t in corpus]
    rows.append(rows[0])  # a repeated row
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, keep boolean").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
