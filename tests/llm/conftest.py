import pytest


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


#: Nulls, empty and odd texts, repeated rows, copies, long texts, clashing column names.
@pytest.fixture(scope="session")
def odd(spark, docs_schema):
    import random

    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage = prose(120), prose(60)
    texts = [
        None, "", " ", "\n\t\x0b\x0c\r ", "one", "two words", "a b a b a b a b a b", "\x1c\x85 ", "İstanbul ΣΑΣ ﬁn 😀 <|endoftext|> 's  x", "x" * 5000, base, base, base + " tail", base.replace("w1 ", "zz "),
        prose(30) + "\n" + passage + "\n" + prose(20), prose(10) + " " + passage + ".\nEnd! ", "same line here\nsame line here\nsame line here", "mit license apache license", "The MIT License. GNU General Public License v3",
        prose(4000), "ab\r\n" * 600, "9" * 300 + " tail", " lead and trail ", "á Å ñ",
    ]
    rows = [(k, t, "en", ("s1", "s2", None)[k % 3], None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, base, None, "s1", 1), (None, None, None, None, None)]
    rows += [(100 + k, f"header of the host\nbody {prose(40)}\n", "en", "s1", 1) for k in range(12)]
    return spark.createDataFrame(rows, docs_schema)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with columns named like those that the operators make."""
    from pyspark.sql import functions as F

    names = ["rid", "size", "fp", "task", "h", "row", "n_words", "lines", "k", "host", "items", "digest", "copies", "first", "clean_text", "ids", "component_id", "start", "target", "__t", "words"]
    return odd.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


@pytest.fixture(scope="session")
def empty(spark, docs_schema):
    return spark.createDataFrame([], docs_schema)
