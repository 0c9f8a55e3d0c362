import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is was with reth ndor erthes inghan tion ouan stea blehe anre whst orhe edtha shti eaon renan inti eshe".split()


def prose(rnd, n):
    out = []
    while n > 0:
        k = min(n, rnd.randrange(4, 14))
        out.append(" ".join(rnd.choice(WORDS) + rnd.choice(["", "", "a", "e", "th", "en", str(rnd.randrange(90))]) for _ in range(k)).capitalize() + rnd.choice([".", ".", "!", "?", ".\n"]))
        n -= k
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, shared passages, nulls, empties, blanks, odd signs and one long text."""
    rnd = random.Random(3)
    base = [prose(rnd, rnd.randrange(1, 160)) for _ in range(40)]
    rows = list(base)
    for k in range(12):
        words = base[k].split(" ")
        for _ in range(max(1, len(words) // (8 if k % 2 else 40))):
            words[rnd.randrange(len(words))] = "changed" + str(rnd.randrange(1000))
        rows.append(" ".join(words))
    rows += base[:4] * 3
    passage = prose(rnd, 70)
    rows += [prose(rnd, 20) + "\n" + passage + "\n" + prose(rnd, 30) for _ in range(5)]
    rows += [None, "", " \t\n", "one", "ONE", "two words", "Two  Words", "a b c d", "a b c d e", "A B C D E", "été straße \U0001f600 中文 ́x", "don't we'll 's ''s  x\n\n y", "!!! ??? ...", "12 34 56"]
    rows.append(prose(rnd, 6000))
    return [(i * 3 % 211 + 1000 * (i // 211), t, ("en", "fr")[i % 2], f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
