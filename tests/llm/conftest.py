"""Documents with every awkward case, and the fixture's own documents."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, fp int, rank int, key string"

PASSAGE = "\n".join(f"line {i} of a passage that repeats " + " ".join(f"w{i}x{j}" for j in range(12)) for i in range(6))


def awkward() -> list[tuple]:
    texts = [
        None, "", " \n\t ", "one", "two words", "a\x0bb\x0cc", "  lead and trail  ", "same text here again", "same text here again",
        "The MIT License and the Apache License, cc by me. GNU General Public License! mit license",
        "un été à Zürich ÄÖÜ ß 東京 タワー 🙂🙂 naïve", "x" * 3000, "word " * 4000, "\n".join(["dup line"] * 30), "#$% <tag> |a|b| *&*",
        "<|endoftext|> special </s> strings ▁ inside <s>", "a b c d e f g h i j k l a b c d e f g h", "tab\tsep\ttext\r\nwith crlf\r\n",
        PASSAGE, "intro line\n" + PASSAGE, PASSAGE + "\nafter it", "short\n" + PASSAGE + "\nmid\n" + PASSAGE,
        " ".join(f"tok{i % 97}" for i in range(30_000)), "  odd   spaces 　 here", "é combining ﬁ ligature Ⅳ ①", "don't can't we'll I'm 12,345.67 -- ...",
    ]
    rows = [(i, t, "en", [None, "b", "a", "z", "é"][i % 5], len(t or ""), 7, "clash", 1, None, "k") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "a row without an id and ten words or more in it all", None, None, None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None, None, None)] * 2
    return rows


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    """The fixture's documents and the awkward ones, under other ids."""
    own = spark.createDataFrame([(None if r[0] is None else r[0] + 100_000, *r[1:]) for r in awkward()], SCHEMA)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(own, allowMissingColumns=True)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows(docs):
    return docs.collect()
