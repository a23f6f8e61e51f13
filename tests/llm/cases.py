"""Rows that every operator must take: nulls, empty and long texts, repeated rows, extra columns."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000))
TEXTS = [
    None, "", "   \n\t ", "one", "One two THREE four", "a\nb\na\na\n\nb ", "x" * 50_000, LONG,
    "Été à la plage, où il fait beau. ΑΣ Σ ß İ", "mail me: a.b+c@x-y.co.uk_d@e.fr, 10.0.0.255 or 1.2.3.4.5",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and +49 (30) 123-456-78 9.", "😀 emoji   nbsp   em",
]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, raw string, y int, id bigint, fp string"


def edge_docs(spark, texts=TEXTS):
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t or ""), "r", 7, 5, "f") for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id here", "en", "s", 10, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


def empty_docs(spark):
    return edge_docs(spark).where("false")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
