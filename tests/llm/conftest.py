import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, v string, h string, words string, copy string"


def rows(texts):
    """Documents with extra columns whose names the operators use inside."""
    return [(i, t, "en", "s", 0 if t is None else len(t), "k", "t", "v", "h", "w", "c") for i, t in texts]


@pytest.fixture(scope="session")
def awkward():
    """Nulls, blanks, ties, repeated rows and ids, near copies, long runs, special tokens."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 8)))
    base = [word() for _ in range(120)]
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "hi there"), (4, "hi there"), (4, "hi there"), (5, "hi  there"), (None, "hi there"), (None, None)]
    near = list(base)
    for i in range(25):
        near = list(base if i % 3 else near)
        near[r.randrange(len(near))] = f"x{i}"
        out.append((100 + i, " ".join(near)))
    out += [(200 + i, " ".join(base)) for i in range(6)]
    out += [(300, "a" * 30_000), (301, "1" * 20_000 + " +1 (234) 555-9999"), (302, "1 " * 9_000), (303, "<|endoftext|> It's 4111 1111 1111 1111 <|startoftext|>"), (304, "Ünïcode “quotes” – 日本語 naïve İstanbul Σίσυφος 1.2.3.4 a@b.co")]
    out += [(400 + i, " ".join(word() for _ in range(r.randint(0, 200)))) for i in range(30)]
    return out


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(rows(awkward), COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
