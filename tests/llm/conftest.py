import random

import pytest

#: Names that the operators use inside; tables may have columns of the same names.
CLASHING = "id key n name level hash bytes block bucket part chunk passes first last shard start length source_size words chars score payload digest removed_lines _of _size of_id".split()


@pytest.fixture(scope="session")
def table(spark):
    """A table of rows (id, text, ...) with extra columns whose names clash with those that operators use inside."""

    def build(rows, schema="doc_id long, text string, source string, lang string, n_chars long", clash=True):
        df = spark.createDataFrame(rows, schema).repartition(3)
        extra = [c for c in CLASHING if c not in df.columns] if clash else []
        return df.selectExpr("*", *[f"'x' as `{c}`" for c in extra])

    return build


@pytest.fixture(scope="session")
def corpus():
    """(id, text, source, lang, n_chars): near and exact copies, ties, nulls, empty, short and very long texts."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(30, 120))) for _ in range(60)]
    for base in (0, 7, 7, 7, 7, 9):  # copies with a word or two changed, and chains of them
        edited = texts[base].split()
        for _ in range(rng.randint(1, 3)):
            edited[rng.randrange(len(edited))] = rng.choice(words)
        texts.append(" ".join(edited))
    texts += [texts[3], texts[3].upper(), texts[3], None, "", " \t\n", "one two", "One  TWO", "one two three four five", "é É ß", "a" * 5000, " ".join(rng.choices(words, k=30_000))]
    passage = " ".join(rng.choices(words, k=70))
    texts += [f"{texts[i]} {passage} {texts[i + 1]}" for i in (20, 30, 40)] + [f"start\n{passage}\nend {i}" for i in range(3)]
    sources = ["web", "web", "web", "web", "code", "books", None]
    return [(100 + (i * 37) % 997, t, sources[i % len(sources)], "en", len(t) if t else 0) for i, t in enumerate(texts)]
