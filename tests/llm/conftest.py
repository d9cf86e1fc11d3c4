import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(draw, n, stem=""):
    return " ".join(stem + draw.choice(["ba", "ce", "di", "fo", "gu"]) + draw.choice(
        ["ra", "le", "mi", "no", "tu", "xa"]) + draw.choice(["", "s", "n", "st"]) for _ in range(n))


def edited(draw, text, n):
    words = text.split(" ")
    for i in draw.sample(range(len(words)), n):
        words[i] = "edit" + str(draw.randrange(10 ** 6))
    return " ".join(words)


@pytest.fixture(scope="session")
def rows():
    """Rows (doc_id, text, lang, source, n_chars) with NULLs, empty and long texts, ties, repeats,
    near copies, a shared passage and common lines."""
    draw = random.Random(7)
    texts = [None, "", "  \t\n ", "One", "two words", "Two Words", "a b c d", "A B C D e"]
    base = [sentence(draw, n) for n in (60, 130, 400)]
    for b in base:
        texts += [b, b, b.upper()] + [edited(draw, b, k) for k in (1, 2, 3, 5, 9)]
    passage = sentence(draw, 70, "q")
    texts += [passage + " " + sentence(draw, draw.randrange(5, 80)) for _ in range(30)]
    common = ["A line that many documents hold, number %d" % k for k in range(3)]
    texts += ["\n".join([" " + common[k % 3].upper() + "\t", sentence(draw, 60), common[k % 3],
                         "short line"]) for k in range(9)]
    texts += [sentence(draw, 9) + tail for tail in ("", " x", " y", " x y")]
    texts += [sentence(draw, 20_000), "spam again " * 400, "# * $ % " * 60, "é ü ñ ß Straße naïve " * 30]
    texts += [sentence(draw, draw.randrange(50, 90)) for _ in range(60)]
    out = [(i * 3 + 1, t, draw.choice(["en", "de", "fr", "es", None]),
            draw.choice(["s1", "s1", "s2", None]), len(t) if t is not None else None)
           for i, t in enumerate(texts)]
    out += [out[8], out[8], out[20]]
    out += [(None, base[0], "en", "s1", 1), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, spread over partitions, with further columns whose names operators use inside."""
    from pyspark.sql import functions as F
    extra = ["rec", "key", "shard", "slot", "label", "kept", "rows", "digest", "size", "copy", "g",
             "host", "path", "score", "_at", "_lines", "h1", "a", "b", "n"]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    from panelwright.llm.queries import tokenizer_path
    return tokenizer_path()
