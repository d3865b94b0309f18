"""Cuts that lost text from the corpus or pairs from the join."""

import corpus_pipeline
from stridemap.llm import decontamination, html_text, lang_id

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_the_kept_copy_outlives_others_of_its_id(spark):
    texts = [(None, "a b"), (None, "ab"), (7, "c  d"), (7, "cd"), (7, "c d"), (8, "cd"), (9, None), (9, " ")]
    docs = spark.createDataFrame([(k, t, "xx", "s", 0) for k, t in texts], SCHEMA)
    got = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.exact_dedup_stage(spark, docs, "").collect())
    assert got == [("7", "c  d"), ("9", " "), ("None", "a b")]


def test_all_documents_stay_if_nothing_was_learned(spark):
    docs = spark.createDataFrame([(1, "some text " * 20, None, "s", 0), (2, "12", None, "s", 0), (3, None, None, "s", 0)], SCHEMA)
    assert {r["doc_id"] for r in lang_id.known_language(docs).collect()} == {1, 2, 3}
    assert {r["doc_id"] for r in lang_id.known_language(docs.fillna({"lang": "xx"}).where("doc_id > 1")).collect()} == {2, 3}


def test_an_open_head_ends_where_the_body_starts():
    said = "A long enough paragraph of plain words."
    for page in (
        f"<html><head><title>t</title><meta charset=utf-8><body><p>{said}</p></body></html>", f"<head><title>t</title><style>p{{}}</style><p>{said}", f"<head><title>t</title> <div><p>{said}</div>",
        f"<head><title>t</title>{said}<p>", f"<head><noscript><img src=x></noscript><title>t</title><body>{said}",
    ):
        assert html_text.main_text(page) == said
    assert html_text.main_text(f"<head><title>t</title><script>x</script></head><body>{said}") == said


def test_a_short_article_beside_a_long_one_stays():
    long, short = "Many words of a long article. " * 40, "A short one."
    page = f"<body><nav>Menu</nav><article><p>{long}</p></article><article><p>{short}</p></article><article class=x><nav>no</nav></article><footer>f</footer></body>"
    assert html_text.main_text(page) == f"{long.strip()}\n{short}"


def test_repeated_words_of_an_item_count_by_position(spark):
    head = "ka le mi no " * 6
    item = head + " ".join(f"w{k}" for k in range(16))
    docs = spark.createDataFrame([(1, f"before it {head} after it"), (2, "ka le mi no other words")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["score"], r["first_word"], r["end_word"]) for r in decontamination.contaminated(docs, bench).collect()] == [(1, 5, 0.6, 2, 26)]


def stage(spark, tmp_path, number, rows, items=(("zz yy", 1),)):
    docs = spark.createDataFrame([(k, t, "xx", "s", 0) for k, t in rows], SCHEMA)
    spark.createDataFrame(list(items), "text string, item_id long").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.mode("overwrite").parquet(str(tmp_path / "stage"))
    docs = spark.read.parquet(str(tmp_path / "stage"))
    out = corpus_pipeline.STAGES[number][1](spark, docs, str(tmp_path))
    assert out.columns == corpus_pipeline.COLUMNS and corpus_pipeline.STAGES[number][1](spark, docs.where("false"), str(tmp_path)).collect() == []
    return sorted((str(r["doc_id"]), r["text"]) for r in out.collect())


def test_stages_decide_row_by_row(spark, tmp_path):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    near = a + " end"
    assert stage(spark, tmp_path, 2, [(7, near), (7, b), (2, a)]) == [("2", a), ("7", b)]
    left = stage(spark, tmp_path, 2, [(None, near), (None, b), (None, a), (3, "x")])
    assert len(left) == 3 and ("None", b) in left and ("3", "x") in left
    item = " ".join(f"i{k}" for k in range(20))
    assert stage(spark, tmp_path, 3, [(7, "before " + item), (7, b), (None, item), (None, a), (5, None)], [(item, 1), (None, 2)]) == [("5", None), ("7", b), ("None", a)]
    assert stage(spark, tmp_path, 1, [(1, "a  b"), (1, "ab"), (2, "c"), (2, "c")]) == [("1", "a  b"), ("2", "c")]
