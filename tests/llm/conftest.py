import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, h long, spans string, s string, id string, _id string"
WORDS = "the of and to in is that for on with as by this be at from or an are it was not which their has but all were when can there been one more time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people".split()


def text_of(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty and long texts, ties, repeated rows, shared passages and copies."""
    shared, base = text_of(1, 60), text_of(2, 200)
    near = base.split()
    near[100] = "changed"
    texts = {
        1: base, 2: base, 3: " ".join(near), 4: text_of(3, 80) + " " + shared, 5: shared + " " + text_of(4, 50), 6: "", 7: None, 8: "   \n\t ", 9: "one", 10: "One two  three\nfour",
        11: text_of(5, 30) + "\n" + "same line here\nsame line here\nsame line here\n" + text_of(6, 30), 12: "la " * 120, 13: text_of(7, 20_000), 14: "É" * 50 + " 中文 \xa0 ́x " + text_of(8, 40), 15: "###" * 40 + " $$$ 123", 16: text_of(2, 200).upper(), 17: "a b c d e f g h i j k l m n o p q r s t " * 5,
    }
    out = [(i, t, "en" if i % 3 else "de", f"src{i % 3}", len(t) if t else 0, i, "x", None, "y", "z") for i, t in texts.items()]
    out += [out[0], out[0]]  # repeated rows
    out += [(None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (20, None, "en", "src0", 0, 1, "x", None, "y", "z")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENT).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENT)
