import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, th long, keep string"


def sample_texts() -> list[str | None]:
    """Words, copies, near copies, shared lines and passages, odd characters, short, long, empty and null texts."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 5)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage, common = line(60), line(12)
    out: list[str | None] = [None, "", " \n\t ", "one", "one", "two words", "a " * 70, "\n".join([common] * 3)]
    for i in range(24):
        parts = [line(draw.randint(1, 30)) for _ in range(draw.randint(1, 6))]
        if i % 3 == 0:
            parts.insert(draw.randrange(len(parts) + 1), common.upper() if i % 2 else f"  {common}\t")
        if i % 4 == 0:
            parts.append(passage)
        out.append("\n".join(parts))
    base = line(300).split(" ")
    for i in range(6):  # near copies
        other = list(base)
        other[10 * i + 5] = "changed" + "x" * i
        out.append(" ".join(other))
    out += [out[10], out[10], " ".join(base)]
    out += ["mail a.b@c-d.example.org, 10.0.0.255 and 300.1.1.1 or 4111 1111 1111 1111; +49 (30) 123-4567.", "x\xa0y\u3000z \x1c\x1d 🙂🙂 ## $ <b>| tail  \r\n\r\n", "long" + "é" * 3000 + " " + line(2500)]
    return out


@pytest.fixture(scope="session")
def rows():
    texts = sample_texts()
    out = [(i * 3, t, ("en", "de", None)[i % 3], f"s{i % 2}", None if t is None else len(t), i, i, "clash") for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd_docs(spark, rows):
    """The same with null and repeated identifiers and repeated rows."""
    more = [(None, "a null identifier with some words of its own, enough for a line", "en", None, 1, 1, 1, "x"), (None, None, None, None, None, None, None, None), rows[12], rows[12], (rows[12][0], "the same identifier but another text, long enough to be a line", "en", "s", 3, 4, 5, "y")]
    return spark.createDataFrame(rows + more, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def tables(tmp_path):
    """Writes frames as the tables of a folder."""

    def write(**frames):
        for name, frame in frames.items():
            frame.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
