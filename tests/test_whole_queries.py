"""Registered queries run every stage of their operators, at the operators' sizes."""

import pytest

import __spark_entry__


@pytest.fixture
def folder(spark, tmp_path):
    def write(texts):
        rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def test_candidates_two_edits_and_splits(spark, folder):
    d = folder(["understanding стол дом", "understanding стол дом", "undrstandng столдом"])
    got = {(r.word, r.text, r.source, r.distance) for r in __spark_entry__.queries()["candidate_topk"](spark, d).collect()}
    assert ("undrstandng", "understanding", "dictionary", 2) in got
    assert ("столдом", "стол дом", "split", 1) in got


def test_vocabularies_at_the_operators_sizes(spark, folder):
    letters = "abcdefghijklmnop"
    d = folder([" ".join("w" + "".join(letters[i >> s & 15] for s in (12, 8, 4, 0)) for i in range(6000))])
    found = __spark_entry__.queries()
    (row,) = found["word_ids_whole"](spark, d).collect()
    assert (row.n, row.unknown) == (6000, 0)
    assert found["vocab_ids_whole"](spark, d).count() == 6000 and found["length_buckets_whole"](spark, d).count() == 5000
    for name in ("word_ids", "vocab_ids", "length_buckets"):
        sql = __spark_entry__.oracle_sql()
        assert sql[f"{name}_whole"] != sql[name]


def test_curriculum_takes_every_sample(spark, folder):
    d = folder(["The first sentence is here.", "Another sentence stands there."])
    assert sorted(r.sample for r in __spark_entry__.queries()["curriculum"](spark, d).select("sample").collect()) == [1, 1, 2, 2, 3, 3]
