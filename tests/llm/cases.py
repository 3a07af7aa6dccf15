"""Documents with nulls, empty, long, equal and repeated texts, and columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, packed string, region string, cid long"


def words(n, seed, size=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def rows():
    base = words(60, 1)
    texts = [
        (1, base),
        (2, base),  # exact copy
        (3, base + " tail"),  # near copy
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (7, "one"),
        (8, "ONE"),
        (9, words(20_000, 2, 3000)),  # long
        (10, words(40, 3) + "\n" + words(30, 4)),
        (11, words(40, 5) + " " + words(30, 4)),  # shares a passage with 10
        (12, "the " * 3000),  # one word again and again
        (13, "the " * 2999),
        (None, base),
        (None, None),
        (1, base),  # a repeated row
        (10, "another text of the same id " + words(30, 4)),
        (14, "naïve café\u00a0— ünïcode \u200b 中文 😀 " + words(12, 6)),
        (15, words(30, 4)),
    ]
    return [(i, t, None if i == 7 else "en", "s", len(t) if t is not None else None, 0.5, 9, "x", "r", 3) for i, t in texts]


def table(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)
