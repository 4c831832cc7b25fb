"""Small tables with the cases that every operator must stand."""

import random

SCHEMA = "doc_id long, text string, part int, lang string, bucket string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows(seed=1):
    """(doc_id, text): exact and near copies, shared passages, periodic, empty,
    blank, null and very long texts, non-ASCII, a special token; ids with gaps."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(1, 120)) for _ in range(30)]
    passage, line = words(rng, 70), words(rng, 24)
    texts = [*base, base[3], base[3], base[4] + " tail", "head " + base[4], base[5].upper(), base[6].replace(" ", "\n\t ", 3)]
    texts += [f"{words(rng, 30)} {passage} {words(rng, 10)}" for _ in range(5)] + [f"{line} {words(rng, 5)} {line}" for _ in range(4)]
    for _ in range(4):  # near copies
        t = base[7].split(" ")
        t[rng.randrange(len(t))] = "changed"
        texts.append(" ".join(t))
    texts += ["a " * 90, "ab" * 300, "", " \n\t ", None, "x", "é ß 漢字 " * 40, "it's we'll 've\x0b 12 <|endoftext|>  end  ", words(rng, 6000), "Ünïcode " * 60, " " * 130]
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def frame(spark, data=None, repeat=True):
    """The rows with columns whose names clash with names used inside, a null
    id, and (``repeat``) a row that is there twice."""
    data = rows() if data is None else data
    more = [data[0], (None, "no id at all")] if repeat and data else []
    return spark.createDataFrame([(i, t, 7, None, "b") for i, t in [*data, *more]], SCHEMA)
