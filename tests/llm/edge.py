"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp long, id long, tag long, "
          "place long, word string, row long, core long, node long, low string, n long")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def rows(seed=1):
    """Texts of all kinds as (id, text)."""
    rng = random.Random(seed)
    base = [sentence(rng, 60) for _ in range(6)]
    shared = sentence(rng, 50)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(10, base[0]), (11, base[0]), (12, base[1].upper())]  # copies, and one in capitals
    words = base[2].split()
    words[30] = "changed"
    out += [(13, " ".join(words))]
    out += [(20, sentence(rng, 20) + " " + shared + " " + sentence(rng, 10)), (21, shared + sentence(rng, 30)), (22, "x" + shared)]
    out += [(30, None), (31, None), (32, ""), (33, " \n\t"), (34, "one"), (35, "two words"), (36, "é😀 ünï ß́   z")]
    out += [(None, sentence(rng, 40)), (None, base[0]), (None, None)]
    out += [(3, base[3]), (3, base[3]), (3, base[4])]  # repeated rows and a repeated id with another text
    out += [(40, "ab" * 4000), (41, "word " * 3000), (42, sentence(rng, 12000)), (43, "line\n" * 30 + "\n\nend")]
    return out


def table(spark, pairs):
    full = [(k, t, "en", None, None if t is None else len(t), True, 1, 2, 3, 4, "w", 5, 6, 7, "l", 8) for k, t in pairs]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
