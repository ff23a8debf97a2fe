"""The pipeline's stages, and the registered queries against their SQL."""

import pytest
from oracle_check import compare, connect

import corpus_pipeline as pipeline
from frameloom.llm import jaccard, lines, queries, secret_scan, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    ok, message, rows = compare(spark, connect(FOLDER), FOLDER, queries.QUERIES[name], queries.ORACLES.get(name))
    assert ok, message
    assert rows


def test_stages(spark):
    docs = queries.table(spark, FOLDER, "documents")
    extra = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (10**9, "a b c d e f", "en", "s", 11), (10**9, "a b c d e f", "en", "s", 11)], docs.schema)
    docs = docs.unionAll(extra)
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "ngram_jaccard_join", "secret_scan", "best_fit_packing"]
    text = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)

    model = toxicity.fit_on(docs, queries.table(spark, FOLDER, "labels"))
    rows = text(docs)
    logits = toxicity.score_texts(model, [r[1] for r in rows])
    one = steps["toxicity"](spark, docs, FOLDER)
    assert text(one) == [r for r, x in zip(rows, logits) if x < 0]

    one = pipeline.stored(one, "t")
    two = pipeline.stored(steps["line_dedup"](spark, one, FOLDER), "t")
    assert two.count() == one.count() and two.columns == docs.columns
    kept = lines.drop_boilerplate(one, "doc_id", "source", "text").select("row.doc_id", "kept")
    assert text(two.select("doc_id", "text")) == text(kept)

    three = pipeline.stored(steps["ngram_jaccard_join"](spark, two, FOLDER), "t")
    groups = jaccard.jaccard_components(two).where("doc_id = component_id").select("doc_id").distinct()
    assert text(three.select("doc_id").where("doc_id IS NOT NULL")) == text(groups)
    assert three.where("doc_id IS NULL").count() == two.where("doc_id IS NULL").count()

    four = pipeline.stored(steps["secret_scan"](spark, three, FOLDER), "t")
    assert four.count() == three.count() and four.columns == docs.columns
    field = secret_scan.fit_on(three)
    hit = {r["doc_id"] for r in three.withColumn("spans", secret_scan.spans_column(field, three.text)).where("size(spans) > 0").collect()}
    assert {r["doc_id"] for r in four.where("contains(text, '[secret]')").collect()} == hit

    five = steps["best_fit_packing"](spark, four, FOLDER)
    assert {r["doc_id"] for r in five.collect()} == {r["doc_id"] for r in four.collect()}


def test_copies_keep_their_lines(spark):
    """A third of a source are copies of one clean text: line dedup leaves it whole, and one of them stays."""
    page = "\n".join(f"line {k} of a clean page that was copied often" for k in range(6))
    rows = [(i, page if i % 3 == 0 else f"menu of the site\nown words of document {i} and {i * 7} more of it", "en", "s", 1) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    two = pipeline.drop_boilerplate_lines(spark, docs, FOLDER)
    got = {r["doc_id"]: r["text"] for r in two.collect()}
    assert all(got[i] == page for i in range(0, 90, 3))
    assert all(got[i] == rows[i][1].split("\n")[1] for i in range(90) if i % 3)  # the menu still goes
    kept = {r["doc_id"]: r["text"] for r in pipeline.drop_near_duplicates(spark, two, FOLDER).collect()}
    assert [i for i in kept if i % 3 == 0] == [0] and kept[0] == page


def test_different_texts_of_one_id_stay(spark):
    words = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(1, words("a"), "en", "t", 9), (1, words("a"), "en", "s", 9), (1, words("b"), None, None, None), (1, None, "en", "s", 0), (2, words("c"), "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()
    assert sorted((tuple(r) for r in kept), key=repr) == sorted(rows[1:], key=repr)


def test_run_and_empty(spark):
    assert pipeline.run(spark, FOLDER).count() > 0
    docs = queries.table(spark, FOLDER, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() == 0
