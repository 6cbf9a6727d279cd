import random

import pytest


@pytest.fixture(scope="session")
def spark():
    from lureline.session import build_session
    return build_session("local[4]", 4, app_name="lureline-llm-tests")


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): copies, near copies, shared passages, nulls, blanks, a long text."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(1, 150))]
        kind = i % 6
        if kind == 1:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        elif kind == 2:
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
        elif kind == 3:
            words = list(base)
        elif kind == 4:
            words = ["la", "lo"] * rng.randint(1, 40)
        rows.append((i, rng.choice([" ", "  ", "\n", "\t"]).join(words)))
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, "Ab"), (64, "aB"),
             (65, " ".join(word() for _ in range(30000))), (66, "x" * 5000)]
    return rows


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)
