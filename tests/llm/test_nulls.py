"""Null ids, null columns and repeated rows in every operator."""


from tidepanel.llm import bpe, mixing, near_vectors, ngram_join, packing, quality, sharding, substring
from tidepanel.llm.queries import vocabulary

TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
ROWS = [(None, TEXT, None, None, None), (None, None, None, None, None), (3, TEXT, "en", "a", 1), (3, TEXT, "en", "a", 1), (4, None, "en", None, None), (5, "", None, "a", 0)]


def frame(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")


def test_rows_survive(spark):
    d, (ranks, pattern) = frame(spark), vocabulary()
    ids = sorted(str(r[0]) for r in ROWS)
    of = lambda x: sorted(str(r.doc_id) for r in x.select("doc_id").collect())
    assert of(quality.quality(d)) == of(substring.substring_dedup(d)) == of(ngram_join.jaccard_components(d)) == ids
    assert of(mixing.mix(d)) == of(sharding.shard(d)) == of(bpe.encode(d, ranks, pattern)) == ids
    assert sorted(str(i) for r in packing.pack(d, ranks, pattern).collect() for i in r.doc_ids) == ids


def test_meaning_of_null_ids(spark):
    d = frame(spark)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(d).collect()}
    assert got == {(None, 13, 3), (None, 0, None), (3, 13, 3), (4, 0, 4), (5, 0, 5)}
    assert ngram_join.drop_near_copies(d).where("doc_id is null").count() == 2
    assert {(r.doc_id, r.n_removed) for r in substring.substring_dedup(d).collect()} == {(None, 15), (None, 0), (3, 0), (4, 0), (5, 0)}
    assert sorted(r.position for r in mixing.mix(d).collect()) == list(range(len(ROWS)))


def test_stages_keep_repeated_rows(spark):
    d = frame(spark)
    assert mixing.mixed_documents(d).where("doc_id = 3").count() == 2
    assert substring.strip_repeats(d).where("doc_id = 3").count() == 2
    assert quality.keep(d).where("doc_id = 3").count() == 2


def test_null_vector_ids(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(None, v, 1), (7, v, 1), (None, [9.0, -1.0, 0.0], 1), (8, v, None), (None, None, None)]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == sorted([("None", 1, "7", False), ("7", 1, "7", True), ("None", 0, "None", False), ("8", 0, "8", True), ("None", 0, "None", False)])


def test_mixture_with_clashing_names(spark):
    rows = [(i, f"text {i}", "a" if i % 3 else "b", -i, "x") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _position long, _mixed_id string")
    got = mixing.whole_mixture(d)
    assert got.columns == d.columns and sorted(tuple(r) for r in got.collect()) == sorted(rows)
