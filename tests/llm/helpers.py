"""Small inputs that every operator must bear, and brute-force versions."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


def docs(spark, rows):
    """Rows of (doc_id, text[, source]), with columns whose names may clash."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.selectExpr("*", "1 as n", "'x' as name", "0.5 as size", "'k' as key", "7 as block", "'t' as word", "array(1) as spans", "true as copy")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = [f"w{rng.randrange(vocabulary)}{'aeiou'[rng.randrange(5)]}" for _ in range(n)]
    return " ".join(w + (".\n" if rng.random() < 0.05 else "") for w in words)


def odd_rows() -> list[tuple]:
    """Nulls, empties, only space, ties, repeated rows, long and non-ASCII text."""
    rng = random.Random(3)
    long = prose(rng, 30_000, 5000)
    same = prose(rng, 120)
    return [
        (None, None), (None, "a null name with some words in it"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, same), (6, same), (6, same), (7, same.upper()),
        (8, long), (9, long[: len(long) // 2]), (10, "日本語 текст ééé " * 30), (11, "x" * 5000), (12, "\x1f\x85 odd   spaces\xa0here \r\n"), (13, "<|endoftext|> marks <|startoftext|>"), (14, same, None), (15, "ΑΣ Σ ΣΑΣ it's they'll"),
    ]


def records(df, *columns):
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(rows, key=repr)
