import random

import pyarrow.parquet as pq
import pytest

from ..compare import SF


def _tricky() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and very long texts, ties, repeats, other scripts, near copies, shared passages."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared, long_one = prose(70), prose(30_000)
    family = prose(120).split()
    texts = [None, "", " \n\t ", "one", "one two", "One  TWO", shared, shared, shared.upper(), long_one, long_one[:90_000] + " end"]
    texts += [prose(50) + " " + shared + "\n" + prose(40) for _ in range(6)]
    texts += ["a" * 500, "ab " * 300, "ñandú über 你好 \U0001f600 " * 20, "x" * 199, "y" * 200, "y" * 200]
    texts += ["word\x0bword\x0cword\rword word word", "\x00\x01 null bytes \x7f"]
    for k in range(30):
        own = list(family)
        for _ in range(k % 9):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        texts.append(" ".join(own))
    texts += [prose(r.randint(1, 200)) for _ in range(40)]
    return list(enumerate(texts, 1))


@pytest.fixture(scope="session")
def tricky():
    return _tricky()


@pytest.fixture(scope="session")
def real():
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "text"))))


@pytest.fixture(scope="session")
def as_table(spark):
    """Rows as documents with other columns, some of which clash with names that operators use."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, n int, node string, key string, `__t` string, label string, hash long, `odd name` string"
        full = [(i, t, None, "web", len(t or ""), 1, "n", "k", "t", "l", 2, None) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return make
