"""Small documents with the cases that every operator must handle."""

import random

SCHEMA = "doc_id long, text string, size string, rank int, n long, key string, kind int, row int, bits int, removed int, spans int, _id int, _row int, _bits int, _may int, _lines int, _removed int, _spans int, may int, rid int, own int, bucket int, n_removed int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randint(0, vocabulary)}x" for _ in range(n)]


def texts(seed=1, n=60):
    """Prose, exact and near copies, shared lines and passages, nulls, empty, blank, short and long texts."""
    rng = random.Random(seed)
    out = [" ".join(words(rng, rng.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 4):
        w = out[i].split()
        out.append(out[i])
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    passage = " ".join(words(rng, 70))
    line = "this line is in very many of the documents here"
    out += [f"{a}\n{passage}\n{line}\n{b}" for a, b in zip(out[: n // 3], out[n // 3 : n // 2 + 3], strict=False)]
    out += [None, "", "   \n\t ", "one", "two words", "Ünïcode ÄÖ 日本語 text é", "a" * 5000, " ".join(words(rng, 6000)), "x y z " * 500, "\n".join([line] * 5), f"{line.upper()}\n{line}"]
    return out


def frame(spark, values, first=0):
    """Documents of these texts, with columns whose names operators use for their own."""
    return spark.createDataFrame([(first + i, t, "clash", 1, 2, "k", 3, 4, 5, 6, 7, 8, *range(11)) for i, t in enumerate(values)], SCHEMA)
