"""The registered queries on the smallest tables, and the pipeline against its stages done plainly."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from passaura.llm import decontamination, edit_token_counts, html_extraction, queries, sentencepiece_codec, simhash_near_dedup, token_packing, url_filters

from .test_operators import PLAIN, RANKS, classes, cut_plainly, mined_plainly


def test_all_are_registered():
    found = entry.queries()
    assert set(queries.queries()) <= set(found) and "pipeline" in found
    assert sorted(f"op{n}" for n in range(1, 14)) == sorted(x.split("_")[0] for x in queries.queries() if x.startswith("op"))


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    a, b = queries.queries()[name](spark, sf_dir).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert sorted(map(tuple, a[columns].to_numpy().tolist())) == sorted(map(tuple, b[columns].to_numpy().tolist()))


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


def test_quality_query(spark, sf_dir, documents):
    """One row for each document, repeatable; on the labelled ones the model was fitted on it is right for most, and the posterior follows from evidence and prior."""
    got = {r.doc_id: r for r in queries.op3_quality_classifier(spark, sf_dir).collect()}
    assert set(got) == {i for i, _ in documents}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    right = [got[x.doc_id].rejected == (x.quality == 0 or x.toxic == 1) for x in labels if x.doc_id in got]
    assert sum(right) > 0.85 * len(right)
    odds = lambda p: math.log(p / (1 - p))
    for x in got.values():
        for e, prior, p in ((x.low_evidence, x.low_prior, x.low), (x.toxic_evidence, x.toxic_prior, x.toxic)):
            assert abs(p - 1 / (1 + math.exp(-e - odds(prior)))) < 1e-9
        assert x.rejected == (x.low > 0.5 or x.toxic > 0.5)
    again = {r.doc_id: r for r in queries.op3_quality_classifier(spark, sf_dir).collect()}
    assert again == got


def test_token_count_query(spark, sf_dir, documents):
    got = {r.doc_id: r for r in queries.op4_token_counts(spark, sf_dir).collect()}
    assert set(got) == {i for i, _ in documents}
    for i, t in documents:
        t = t or ""
        n = len(t)
        edited = t[: n // 3] + t[n // 3 + n // 20 :]
        half = len(edited) // 2
        edited = edited[:half] + t[:40] + edited[half:]
        edited = edited[:-1] + "!" if edited else "!"
        assert (got[i].n_tokens, got[i].n_tokens_edited, got[i].n_chars_edited) == (len(PLAIN(t)), len(PLAIN(edited)), len(edited)) and got[i].n_chars_encoded == 0


def test_url_query(spark, sf_dir):
    """Verdicts of urls that no fixed rule settles are those of every combination of tokens, mined plainly from the same labels."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labelled = url_filters.labels_of_pages(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    got = queries.op5_url_filters(spark, sf_dir).join(pages, "page_id").collect()
    tokens = {r.url: frozenset(r.t) for r in pages.where("url is not null").select("url", url_filters.tokens_of(F.col("url")).alias("t")).collect()}
    rows = [(r.url, r.verdict) for r in labelled if r.url is not None]
    _, want = mined_plainly(rows, tokens, list(tokens))
    fixed = {r.page_id: r for r in queries.url_fixed_rules(spark, sf_dir).collect()}
    assert len(got) == len(fixed) == pages.count()
    for x in got:
        y = fixed[x.page_id]
        assert (x.host, x.path, x.rule) == (y.host, y.path, y.rule)
        assert x.verdict == y.verdict if y.rule else x.verdict in want.get(x.url, {"allow"})


def test_packing_query(spark, sf_dir, documents):
    back: dict = {}
    for r in token_packing.unpacked(queries.op6_token_packing(spark, sf_dir)).collect():
        back.setdefault(r.doc_id, []).append((r.offset, r.ids))
    for i, t in documents:
        assert [x for _, own in sorted(back.get(i, [])) for x in own] == PLAIN(t or "")


def test_page_query(spark, sf_dir):
    tree = html_extraction.trained_tree()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op7_html_extraction(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for x in got:
        assert x.url == pages[x.page_id].url and x.n_chars == len(x.text) and x.text == html_extraction.main_text(pages[x.page_id].html, tree)


def test_piece_query(spark, sf_dir, documents):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    got = {r.doc_id: r for r in queries.op8_sentencepiece_codec(spark, sf_dir).collect()}
    assert set(got) == {i for i, _ in documents}
    assert all(got[i].ids == library.encode(t or "") and got[i].n_tokens == len(got[i].ids) and got[i].lossless for i, t in documents)


def test_passage_query(spark, sf_dir, documents):
    got = {r.doc_id: r for r in queries.op9_substring_dedup(spark, sf_dir).collect()}
    for (i, _), (text, gone) in zip(documents, cut_plainly([t for _, t in documents]), strict=True):
        assert (got[i].text, got[i].removed_words) == (text, gone) and got[i].n_chars == (None if text is None else len(text))


def test_near_duplicate_query(spark, sf_dir, documents):
    words = [simhash_near_dedup.fingerprint(t) & (1 << 64) - 1 for _, t in documents]
    label = classes(words)
    got = {r.doc_id: r for r in queries.op10_simhash_near_dedup(spark, sf_dir).collect()}
    assert set(got) == {i for i, _ in documents}
    for (i, _), w, k in zip(documents, words, label, strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{w:016x}", documents[k][0])


def test_pipeline(spark, sf_dir):
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = sorted((r.doc_id, r.text) for r in corpus_pipeline.quality(spark, docs, sf_dir).collect())
    bad = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where((F.col("quality") == 0) | (F.col("toxic") == 1)).collect()}
    assert len(bad & {k for k, _ in good}) <= 0.35 * len(bad)  # few labels at this size
    label = classes([simhash_near_dedup.fingerprint(t) & (1 << 64) - 1 for _, t in good])
    single = [x for k, x in enumerate(good) if label[k] == k]
    cut = [(i, *x) for (i, _), x in zip(single, cut_plainly([t for _, t in single]), strict=True)]
    cut = [(i, t) for i, t, gone in cut if not gone or t.strip()]
    index = decontamination.WindowIndex([tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()])
    kept = {}
    for (i, t), x in zip(cut, decontamination.scan([t for _, t in cut], [None] * len(cut), index), strict=True):
        if not (x["n_hit"] > 0 and 20 * x["n_hit"] >= x["n_words"]):
            kept[i] = t
    assert set(out) == set(kept)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Model.read(f"{queries.TOKENIZERS}/piece_bpe_32k.model"))
    for i, t in kept.items():
        assert out[i].ids == codec.encode(t) and out[i].lossless and out[i].n_chars == len(t)


def test_stages_on_odd_documents(spark, sf_dir):
    """Nulls, empty texts, repeated rows, no rows, and columns with the names that stages use inside."""
    names = ("quality", "removed_words", "found", "coded", "low", "toxic", "own_fp", "stay_id", "chunk_id", "site", "fp", "judged_id", "chunk_at", "text_key", "a.b", "text.lang")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in names)
    odd = [(None, None, None, None, None), (1, "", "en", "src0", 0), (1, "", "en", "src0", 0), (2, None, "en", None, 5), (3, "plain words here.", "en", "src1", 17), (4, "plain words here.", None, "src1", 17), (5, " \n ", "en", "x", 3)]
    docs = spark.createDataFrame([(*x, *("z" * len(names))) for x in odd], schema)
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf_dir)
            found = out.collect()
            assert len(found) <= len(odd) and (found or not rows.count() or name == "quality")
            if name != "token_ids":
                assert out.columns == docs.columns
