"""Nulls, repeated rows, long texts and columns with the names that operators make."""

import random

from pyspark.sql import functions as F

from lectern.llm import fuzzy_lines, html_template, quality_mil, toxicity, warc_fixity

CLASH = ["hash", "node", "n_bytes", "score", "toxicity", "features", "row", "path", "line", "key", "lines", "x", "archive_id"]


def crowded(df, *but):
    """``df`` with a column of every clashing name that is not its own."""
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH if c not in (*df.columns, *but)])


def test_fixity_of_null_and_doubled_records(spark):
    schema = "archive string, offset long, record binary"
    a = spark.createDataFrame([("a", 0, None), ("a", 9, b"one"), ("a", 9, b"two"), (None, None, b"n"), (None, 5, b"m"), ("b", 1 << 40, b"far")], schema)
    b = spark.createDataFrame([("a", 0, b""), ("a", 9, b"one"), (None, None, b"n"), (None, 5, b"M"), ("b", 1 << 40, b"far")], schema)
    got = {(r.archive, r.offset): r.problem for r in warc_fixity.audit(crowded(a), crowded(b)).collect()}
    assert got == {("a", 9): "changed", (None, 5): "changed"}
    assert warc_fixity.audit(a, a.union(a)).count() == 0


def test_scores_beside_clashing_columns(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        words = [f"w{rng.randrange(60)}" for _ in range(40)] + ["vilestuff"] * (i % 2)
        rows.append((i, " ".join(words), "en"))
    rows += [(500, " ".join(f"w{i % 70}" for i in range(60_000)), "en"), (501, "z" * 200_000, None), (502, None, None), (502, None, None), (503, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    wide = crowded(docs)
    chain = toxicity.train(wide, toxicity.categories_of(wide, crowded(labels)), toxicity.CATEGORIES)
    plain = {(r.doc_id, tuple(r.toxicity)) for r in toxicity.score(docs, chain, toxicity.CATEGORIES).collect()}
    scored = toxicity.score(wide, chain, toxicity.CATEGORIES)
    assert {(r.doc_id, tuple(r.toxicity)) for r in scored.collect()} == plain and scored.count() == len(rows)
    kept = toxicity.drop_toxic(wide, wide, crowded(labels))
    assert kept.columns == wide.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows if "vilestuff" not in (r[1] or "")}
    model = quality_mil.train(wide, crowded(labels))
    got = quality_mil.score(wide, model)
    assert got.count() == len(rows) and all(0 <= r.score <= 1 for r in got.collect())
    assert quality_mil.score(wide.limit(0), model).count() == 0


def test_pages_beside_clashing_columns(spark):
    page = "<html><body><nav><a href='/'>home</a></nav><article><h1>t{0}</h1><p>{1}</p></article><footer>same</footer></body></html>"
    rng = random.Random(5)
    rows = [(i, f"http://h/{i}", page.format(i, " ".join(f"w{rng.randrange(99)}" for _ in range(80)))) for i in range(12)]
    rows += [(50, "http://h/50", page.format("long", "word " * 60_000)), (51, None, None), (52, "http://h/x", ""), (52, "http://h/x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {(r.page_id, r.text) for r in html_template.extract(pages).collect()}
    got = html_template.extract(crowded(pages)).collect()
    assert {(r.page_id, r.text) for r in got} == want and len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[50].count("word") == 60_000 and "home" not in text[3] and text[51] == text[52] == ""
    assert html_template.extract(pages.limit(0)).count() == 0


def test_lines_beside_clashing_columns(spark):
    line = "the quick brown fox jumps over the lazy dog near the old river bank"
    rows = [(1, line + "\nother words stand here alone"), (2, line.replace("quick", "quiet")), (3, None), (4, ""), (2, line.replace("quick", "quiet")), (5, "a" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pick = lambda df: sorted((r.doc_id or -1, r.n_lines, str(r.removed)) for r in fuzzy_lines.duplicate_lines(df).collect())
    assert pick(docs) == pick(crowded(docs))
