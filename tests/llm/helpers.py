"""Small tables with the awkward rows that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def words(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghilmnoprstu") for _ in range(draw.randint(2, 7))) for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty and very long texts, copies, near copies, repeated rows, and a column named as an operator's own."""
    long, base = words(30_000, 1), words(120, 2)
    near = base.split()
    near[60] = "other"
    texts = [
        (0, base), (1, base), (2, " ".join(near)), (3, ""), (4, None), (5, "   \n\t "), (6, "one"), (7, "two words"), (8, long),
        (9, words(40, 3) + " " + " ".join(base.split()[20:90])), (10, words(200, 4)), (10, words(200, 4)), (None, words(30, 5)), (11, "Éa ß 😀 \u0000x\r\nline"),
        (12, words(60, 6)), (13, words(60, 6)),
    ]
    rows = [(i, t, "en" if n % 3 else None, None if n % 5 == 4 else f"src{n % 3}", None if t is None else len(t), "clash") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
