"""The stages of the corpus pipeline against brute force, each on what its predecessor kept."""

import sys
from pathlib import Path

from test_operators import components, corpus, shingles, words

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402

from tidemark.llm import fm  # noqa: E402


def test_stages(spark, tmp_path):
    rows = [*corpus(9, 80), (None, "null id a b c d", "en", "a", 1), (600, "mail a@b.com now please friends", "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(i, r[1]) for i, r in enumerate(rows[:6])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "mixing sources to target weights"]

    kept, seen = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(kept.collect())
        assert kept.columns == docs.columns + ["copy"] * (k == 4)

    machine = fm.fit(docs, labels, "quality", ~fm.fold(5, 0))
    scores = {(r.doc_id): r.score for r in fm.score(docs, machine).collect()}
    assert {r.doc_id for r in seen[0]} == {i for i, s in scores.items() if s >= 0.3}

    s = {r.doc_id: shingles(r.text) for r in seen[0] if r.doc_id is not None}
    comp = components(s, [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])])
    assert {r.doc_id for r in seen[1]} - {None} == set(comp.values())

    hit = {r.doc_id for r in seen[1] for _, t in items if shingles(t) and 100 * len(shingles(t) & shingles(r.text)) >= 75 * len(shingles(t))}
    assert {r.doc_id for r in seen[2]} == {r.doc_id for r in seen[1]} - hit

    assert [r.doc_id for r in sorted(seen[3], key=str)] and {r.doc_id for r in seen[3]} == {r.doc_id for r in seen[2]}
    if 600 in {r.doc_id for r in seen[3]}:
        assert next(r for r in seen[3] if r.doc_id == 600).text == "mail [EMAIL] now please friends"
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in seen[3])

    whole = sum(len(words(r.text)) for r in seen[3])
    assert {r.doc_id for r in seen[4]} <= {r.doc_id for r in seen[3]}
    assert abs(sum(len(words(r.text)) for r in seen[4]) - 1.5 * whole) <= 3 * 2 * max(len(words(r.text)) for r in seen[3])


def test_copies_of_rows_that_share_ids(spark):
    """Of copies under one id, or under none, one stays; other texts under these ids stay too."""
    t, u, v = "a b c d e f g h i", "one two three four five six", "seven eight nine ten eleven"
    rows = [(1, t), (1, t), (None, t), (3, t + " j"), (2, u), (2, v), (None, "w x y z p q"), (None, "w x y z p q"), (None, None), (None, ""), (4, None)]
    docs = spark.createDataFrame([(i, x, "en", "a", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, t), (2, u), (2, v), (None, "w x y z p q"), (None, None), (None, ""), (4, None)], key=str)


def test_empty_documents(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
