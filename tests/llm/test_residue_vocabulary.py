"""What the mock-Latin vocabulary of problem 8 learns from."""

from rasterloom.llm import residue as R
from tests.conftest import rows

WORDS = "solven tibus mirata quorit bessa obis".split()
SCHEMA = "doc_id bigint, text string, source string"
MENTION = "I do think that my lorem ipsum page and the menu are not what you want."
PLAIN = ["I do think that my page and the menu are what you want.", "And the page that you want is not my page.", "What do you think the menu and my page are for?", "I do not think that you want my menu."]


def docs(spark, seeds, copies):
    data = [(i, "Lorem ipsum dolor " + " ".join(WORDS[i % 6 :] + WORDS[: i % 6]) + ".", "a") for i in range(seeds)]
    data += [(100 + i, t, "a") for i, t in enumerate(PLAIN)] + [(200, "Hello. Tibus solven obis mirata bessa.", "a")]
    return spark.createDataFrame(data + [(1000 + i, MENTION, "a") for i in range(copies)], SCHEMA)


def test_copies_of_a_mention_neither_outvote_nor_teach(spark):
    for seeds, copies in ((6, 2000), (2, 1), (1, 1)):
        df = docs(spark, seeds, copies)
        assert {"tibus", "solven", "mirata"} <= set(R.mock_words(df)) and not {"do", "and", "my", "not"} & set(R.mock_words(df))
        got = {r[0] for r in rows(R.residue(df.where("doc_id < 1000")), "doc_id")}
        assert got == {*range(seeds), 200}


def test_the_vocabulary_has_no_cap(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"zu{x}{y}um" for x in letters for y in letters]
    seeds = [(i, "Lorem ipsum " + " ".join(words) + ".", "a") for i in range(2)]
    df = spark.createDataFrame([*seeds, (9, " ".join(words[-4:]), "a")], SCHEMA)
    assert set(words) <= set(R.mock_words(df)) and (9,) in rows(R.residue(df), "doc_id")
