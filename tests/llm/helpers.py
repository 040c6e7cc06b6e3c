"""Small corpora with the cases every operator must handle."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string, score string, label string, key string, id string, n string, row string"


def docs_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text[, lang[, source]]) rows with extra columns whose names clash with inner ones."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, *(None,) * (4 - len(row)))
        full.append((doc_id, text, lang, source, len(text or ""), "e", "s", "l", "k", "i", "n", "r"))
    return spark.createDataFrame(full, SCHEMA)


def sentence(rng: random.Random, n: int, words: str = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau") -> str:
    pool = words.split()
    return " ".join(rng.choice(pool) + str(rng.randint(0, 99)) for _ in range(n))


def corpus(rng: random.Random, n: int = 60) -> list[tuple]:
    """Texts of many lengths, copies, near copies, a common passage, empty, null and repeated rows."""
    common = sentence(rng, 60)
    rows: list[tuple] = []
    for i in range(n):
        rows.append((i, sentence(rng, rng.choice([1, 2, 3, 4, 5, 8, 12, 15, 20, 40, 120])), "en", f"s{i % 5}"))
    for i in range(n, 2 * n):
        base = rows[rng.randrange(n)][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            base[rng.randrange(len(base))] = sentence(rng, 1)
        rows.append((i, " ".join(base), "en", "s0"))
    for i in range(2 * n, 2 * n + 12):
        rows.append((i, sentence(rng, 10) + "\n" + common + "\n" + sentence(rng, 8), "en", "s1"))
    rows += [(1000, None, None, None), (1001, "", "en", ""), (1002, " \t\n ", "en", "s1"), (1003, "", None, "s2"), (None, rows[0][1], "en", None), (None, None, None, None)]
    rows += [rows[3], rows[3], (7, rows[9][1], "en", "s2"), (1004, sentence(rng, 9000), "en", "s3")]
    return rows
