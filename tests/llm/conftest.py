import os
import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, task string, label string"


@pytest.fixture(scope="session", autouse=True)
def on_workers():
    """Workers import the package from the repository."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert os.path.isdir(os.path.join(root, "lumigrid", "llm"))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and long texts, ties, repeated rows, near copies, odd white space and extra clashing columns."""
    rnd = random.Random(5)
    vocab = ["the", "of", "and", "to", "in", "Lumen", "orbit", "été", "ß", "rather", "quite", "word,", "end.", "x1", "C3PO"]
    prose = lambda n: " ".join(rnd.choice(vocab) + rnd.choice(["", "", "s", "ly"]) for _ in range(n))
    base = prose(150)
    edited = base.split(" ")
    edited[70] = "changed"
    texts = [
        None, "", " ", "\n\n", "one", "two words", base, base, " ".join(edited), base.upper(), prose(40) + "\n" + base + "\n" + prose(60),
        prose(3000), "ab" * 400, "a" * 500, "line one is here\n" * 12, "日本語 のテキスト です " * 9, "tail   space  two\t\ttabs\x1cz", "<|endoftext|> raw", prose(20) + " " + prose(20),
        "Licensed under CC BY-NC 4.0. All rights reserved.\nThis work is licensed under the GNU General Public License, version 3.",
        "mail a.b@c.example.com or +1 (555) 010-9999, 4539578763621486 and 192.168.0.1 or 999.1.1.1 a@b@c.de",
    ]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 3}" if i % 4 else None, len(t or ""), "x", None) for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, "a row without an id", "en", "src0", 19, None, "y")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return {r.doc_id: r for r in small.collect()}
