"""Each stage against a brute-force version, on what its predecessor kept."""

from fixtures import SF, TEXTS, documents
from test_dedup import brute_exact, brute_near
from test_text import base_spans, check_pieces

import corpus_pipeline
from runstore.llm import langid


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(documents(spark).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id IS NOT NULL AND doc_id <> 11").selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars"))
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact", "near", "secrets", "packing"]
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    step = stages["language"](spark, docs, SF)
    assert step.columns == columns and set(rows(step)) == {i for i, r in rows(docs).items() if any(c.isalpha() for c in r.text or "")}
    # A language that is missing is predicted, all else stays.
    given, labelled = rows(docs), rows(langid.report(docs))
    assert any(given[i].lang is None for i in rows(step))
    assert all(r.lang == (given[i].lang or labelled[i].lang_pred) and (r.text, r.source, r.n_chars) == (given[i].text, given[i].source, given[i].n_chars) for i, r in rows(step).items())
    exact = stages["exact"](spark, step, SF)
    assert exact.columns == columns and set(rows(exact)) == {b[0] for b in brute_exact([(i, r.text) for i, r in rows(step).items()]) if b[3]}
    near = stages["near"](spark, exact, SF)
    assert near.columns == columns and set(rows(near)) == {i for i, _, c in brute_near([(i, r.text) for i, r in rows(exact).items()], 5, 80) if i == c}
    clean = stages["secrets"](spark, near, SF)
    before, after = rows(near), rows(clean)
    assert clean.columns == columns and set(before) == set(after)
    for i, r in after.items():
        assert not base_spans(r.text) and (("[SECRET]" in r.text) or r.text == before[i].text) and r.n_chars == len(r.text)
        assert bool(base_spans(before[i].text)) <= ("[SECRET]" in r.text)
    check_pieces(spark, clean)


def test_language_without_a_model_keeps_texts_with_letters(spark):
    docs = documents(spark)
    want = sorted(r.text for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    # No labels, labels on held-out rows alone, and a label by the name of unknown texts.
    for label in ("cast(null AS string)", "CASE WHEN pmod(crc32(cast(cast(coalesce(doc_id, 0) AS string) AS binary)), 5) = 0 AND doc_id IS NOT NULL THEN 'en' END", "'und'"):
        step = dict(corpus_pipeline.STAGES)["language"](spark, docs.selectExpr(*(f"{label} AS lang" if c == "lang" else c for c in docs.columns)), SF)
        assert step.columns == docs.columns and sorted(r.text for r in step.collect()) == want


def test_run(spark):
    """The whole is its stages, one after another: what is packed are the documents that brute-force versions keep."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    kept = {b[0] for b in brute_exact(rows) if b[3]}
    kept = {i for i, _, c in brute_near([r for r in rows if r[0] in kept], 5, 80) if i == c}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == kept
    assert {(r.doc_id, r.doc_tokens) for r in out} == {(i, n) for i, n in out_tokens(out).items()}


def test_stages_with_null_and_repeated_ids(spark):
    """One row of each text and of each group of near copies, whatever the ids."""
    stages = dict(corpus_pipeline.STAGES)
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    step = docs
    for name in ("language", "exact", "near", "secrets"):
        step = stages[name](spark, step, SF)
        assert step.columns == docs.columns
    texts = sorted(r.text for r in step.collect())
    kept = {t for _, t in TEXTS if t and any(c.isalpha() for c in t)}
    # One of the two long texts, of the two equal ones, of "one" and "ONE", and the secrets are replaced.
    assert len(texts) == len(kept) - 2 and len(texts) == len(set(texts)) and sum("[SECRET]" in t for t in texts) == 1
    check_pieces(spark, step)


def out_tokens(pieces):
    total = {}
    for r in pieces:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    return total
