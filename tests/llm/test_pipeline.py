"""The pipeline's stages, one after the other, on a small table."""

import numpy as np

import corpus_pipeline
from lexweave.llm import mixing


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(0)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)).capitalize() + "."
    clean = [(i, text(60), "en", f"s{i % 3}") for i in range(60)]
    junk = [(100 + i, " ".join(w + "%%%" for w in text(60).split()), "en", "s0") for i in range(12)]
    copies = [(200 + i, clean[i][1].replace(" ", "  "), "en", "s1") for i in range(5)]
    near = [(300 + i, " ".join([*clean[i + 10][1].split()[:-1], "zz"]), "en", "s2") for i in range(5)]
    rows = [(*r, len(r[1])) for r in clean + junk + copies + near] + [(400, None, "en", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(r.doc_id for r in docs.collect())
    ids = lambda rows: {r[0] for r in rows}
    assert set(kept["quality"]) == ids(clean) | ids(copies) | ids(near)
    # Of equal texts the one with more white space is longer and stays.
    assert set(kept["exact_dedup"]) == (ids(clean) - set(range(5))) | ids(copies) | ids(near)
    assert set(kept["near_dedup"]) == (ids(clean) - set(range(5))) | ids(copies)
    assert set(kept["mix"]) <= set(kept["near_dedup"]) and max(kept["mix"].count(i) for i in set(kept["mix"])) <= 2
    assert len(kept["mix"]) > len(kept["near_dedup"]) and mixing.CLOSING > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len([r for r in packed if r.piece == 0]) == len(kept["mix"])


def test_odd_tables(spark, tmp_path):
    """An empty table, repeated ids, nulls in every column, and columns named like those that stages make."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _file string, _row long, _times int, sequence_id long"
    rng = np.random.default_rng(1)
    text = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)).capitalize() + "."
    rows = [(i // 2, text(), "en", f"s{i % 2}", 1, "f", 0, 0, 0) for i in range(40)] + [(None, text(), None, None, None, None, None, None, None), (7, None, None, None, None, None, None, None, None)]
    for name, some in (("empty", []), ("odd", rows + rows[:4])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(found) == 0) == (name == "empty")
        if found:
            assert {r.doc_id for r in found} <= {*range(20), None} and all(r.length > 0 for r in found)
