"""Small tables with every awkward case: nulls, empty and long texts, repeats, clashing columns."""

import random

LONG = "lorem ipsum dolor " * 4000


def awkward_docs(spark, extra=()):
    rows = [(1, "The quick brown fox jumps over the lazy dog again and again"), (2, None), (3, ""), (4, "   \n\t "),
            (5, LONG), (6, "The quick brown fox jumps over the lazy dog again and again"), (None, "no id here at all"),
            (7, "twice"), (7, "twice"), (8, "é ñ 日本語 🙂 a@b.c"), *extra]
    # fp, n, key, row, c, at, base, token and the like are names the operators use themselves.
    return spark.createDataFrame([(k, t, 1, 2, "x", 3, "y", 4) for k, t in rows],
                                 "doc_id long, text string, fp int, n int, row string, base int, digest string, h int")


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 4))) for _ in range(50)]
    parts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 60))) for _ in range(10)]
    out = []
    for _ in range(n):
        out.append(" ".join(rnd.choice(parts)[rnd.randint(0, 20):] if rnd.random() < .6 else
                            " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))
                            for _ in range(rnd.randint(0, 4))))
    return out
