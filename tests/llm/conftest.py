from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path.insert(0, str(ROOT))

from clickmetrics.session import checkpoint_dir, get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[*]", 8)
    checkpoint_dir(s)
    yield s


WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "
         "phi chi psi omega").split()


def prose(seed: int, n: int) -> str:
    """``n`` words drawn by a fixed generator, twelve to a line."""
    x, out = seed * 7919 + 17, []
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 40))
    return "\n".join(" ".join(out[i:i + 12]) for i in range(0, n, 12))


def corpus() -> list[tuple]:
    """Rows (doc_id, text, lang, source, n_chars) with every awkward case."""
    a, b = prose(1, 300), prose(2, 120)
    near = a.split(" ")
    near[40] = "changed"
    short = "One two three"
    shared = "shared footer line of many documents"
    rows = [
        (1, a, "en", "s1"), (2, a, "en", "s1"), (3, " ".join(near), "en", "s2"), (4, b, "de", None),
        (5, b + "\n" + prose(1, 300)[:900], "de", "s2"), (6, None, None, None), (7, "", "fr", "s3"),
        (8, "   \t\n ", "fr", "s3"), (9, short, "es", "s3"), (10, short.upper(), "es", "s3"),
        (None, prose(3, 60), "en", "s1"), (11, "x " * 400, "en", "s1"), (11, "x " * 400, "en", "s1"),
        (12, prose(4, 20000), "en", "s1"), (13, "### &&& " * 40, "en", "s1"), (14, "no\n\nno\nNO \nyes", "en", "s2"),
    ]
    rows += [(20 + i, prose(50 + i, 30) + "\n" + shared + ("  " if i % 2 else ""), "en", "s1") for i in range(12)]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
