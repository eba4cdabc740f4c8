import pytest

from epispan.llm.common import prepared

DOCS_DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, ids string, shards int, size string"

#: Every case that the operators define a result for: nulls, empty and long texts, repeats, and columns with clashing names.
BASE = "The quick brown fox jumps over the lazy dog while nine other animals watch from far away near river number "
LINES = "\n".join(f"line number {k} of a shared passage that many documents hold" for k in range(6))


def rows():
    word = lambda k: f"{BASE}{k} and then goes home to sleep {' '.join(f'w{k}x{j}' for j in range(60))}"
    out = [
        (1, word(1), "en", "a"),
        (2, word(1), "en", "a"),
        (3, word(1).replace("w1x5", "changed"), "en", None),
        (4, word(4) + "\n" + LINES, "en", "a"),
        (5, LINES.upper() + "\n" + word(5), None, "b"),
        (6, None, "en", "b"),
        (7, "", None, None),
        (8, " \n\t\n", "en", "b"),
        (9, "short text", "en", "c"),
        (10, "Short  TEXT", "en", "c"),
        (11, "ab\nab\nab", "en", "c"),
        (12, " ".join(f"t{k % 977}" for k in range(20_000)), "en", "c"),
        (13, "mail me.now@host.example.org or 10.0.0.255, card 4111 1111 1111 1111, call +1 (212) 555-0100.", "en", "d"),
        (14, "bank account DE89 3704 0044 0532 0130 00 and ssn 123-45-6789 ±éü 中文 १२", "de", "d"),
        (15, "x  y\n z \tq r　s it's 'll <|endoftext|> \x00 end ", "en", "d"),
        (None, word(1), "en", "a"),
        (None, None, None, None),
        (17, word(17), "en", "a"),
        (17, word(17), "en", "a"),
    ]
    out += [(100 + k, word(100 + k), "en" if k % 2 else "fr", "hot") for k in range(30)]
    return [(*r, len(r[1] or ""), "k", "i", 7, "s") for r in out]


@pytest.fixture(scope="session")
def corpus(spark):
    return prepared(spark).createDataFrame(rows(), DOCS_DDL).repartition(4)


@pytest.fixture(scope="session")
def empty(spark):
    return prepared(spark).createDataFrame([], DOCS_DDL)
