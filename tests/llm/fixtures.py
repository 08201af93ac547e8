"""Small tables with the odd cases that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SYLLABLES = "ka lo mi ren tas vol qui den por sha".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, `start` long, low double"


def prose(rng: random.Random, words: int, stop: int = 9) -> str:
    out = []
    for n in range(words):
        w = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
        out.append(w.capitalize() + "" if n % stop == 0 else w + "." * (n % stop == stop - 1))
    return " ".join(out)


def texts(seed: int = 1) -> list[tuple[int, str | None]]:
    """(doc_id, text): copies, near copies, a shared passage, nulls, empty, blank, short and long texts."""
    rng = random.Random(seed)
    base = [prose(rng, 80) for _ in range(12)]
    passage = prose(rng, 60)
    rows: list[tuple[int, str | None]] = list(enumerate(base))
    rows += [(20 + n, base[0]) for n in range(5)]
    for n in range(6):
        words = base[1].split(" ")
        words[5 + n * 3] = "changed"
        rows.append((30 + n, " ".join(words)))
    rows += [(40 + n, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 25)) for n in range(4)]
    rows += [(50, None), (51, ""), (52, " \t\n "), (53, "one"), (54, "one two"), (55, "one two"), (56, "ÉTÉ é <|endoftext|> Σ🙂")]
    rows.append((60, prose(rng, 4000)))
    rows += [(70, base[2].upper()), (71, base[2] + " end")]
    rows += [(20, base[0])]  # a repeated row
    return rows


def documents(spark: SparkSession, seed: int = 1, empty: bool = False) -> DataFrame:
    rows = [] if empty else [(i, t, "en" if i % 3 else None, "src", len(t or ""), "x", 7, 0.5) for i, t in texts(seed)] + [(None, "no id here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)
