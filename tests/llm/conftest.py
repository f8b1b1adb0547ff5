import random

import pytest

EDGE = [None, "", " ", "\n\t ", "one", "one two three", "a a a a a a a a a a", "Größe, naïve 日本語 \U0001f642  x́ \x1c \x85end\n\n\n tail ", "'s it's 12 3½ <|endoftext|> ~ ~~"]


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, repetitions inside a text, edge cases and one long text."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdehilmnorstuö") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = make(60)
    texts = EDGE + [make(rnd.randrange(5, 160)) for _ in range(40)]
    for base in texts[12:18]:
        texts += [base, base]
        for _ in range(4):
            own = base.split(" ")
            own[rnd.randrange(len(own))] = "edited"
            texts.append(" ".join(own))
    texts += [f"{make(30)} {passage}\n{make(20)}" for _ in range(8)]
    texts += [f"{make(3)} " + "spin " * 120, make(9000), passage[:199], passage[:200], passage[:201]]
    return [(k * 3 - 5, t) for k, t in enumerate(texts)] + [(4, texts[3]), (13, texts[6]), (None, texts[14]), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with further columns whose names operators might use themselves."""
    rows = [(i, t, "x", 1, i, 0.5, 7, "en", "s", None if t is None else len(t)) for i, t in corpus]
    schema = "doc_id long, text string, ids string, rank int, text_id long, score double, home int, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
