"""The pipeline's stages on a small folder, against what each must keep."""

import os

import pytest

from citeloom.llm import shared

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages_keep_clean_documents(spark, monkeypatch):
    import corpus_pipeline
    from citeloom.llm import gru_language, minhash_dedup, seed_decontamination
    from citeloom.llm.shared import stored

    monkeypatch.setattr(gru_language, "STEPS", 150)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
        if name == "near_duplicates":
            want = {r["component_id"] for r in minhash_dedup.near_duplicates(before).collect()}
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want
        if name == "decontamination":
            benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert seed_decontamination.overlaps(docs, benchmark).count() == 0
    assert sizes[1] >= 0.97 * sizes[0] and sizes[3] == sizes[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == sizes[4]


def _folder(spark, path, rows, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_on_odd_rows_matches_brute_force(spark, tmp_path, monkeypatch):
    """Nulls, blanks, symbols, copies, near copies, repeated rows, benchmark passages and addresses."""
    import random
    import re

    import corpus_pipeline
    from citeloom.llm import gru_language
    from citeloom.llm.queries import tokenizer
    from tokenizers import Tokenizer

    monkeypatch.setattr(gru_language, "STEPS", 80)
    rng = random.Random(51)
    words = {"aa": "the and of with that from which under about".split(), "bb": "der die und nicht schön für über auch wird".split()}
    text = lambda k, n: " ".join(rng.choice(words[k]) + (str(rng.randrange(99)) if rng.random() < 0.3 else "") for _ in range(n))
    rows = [(10 + i, text(k, rng.randint(40, 90)), k, "s", None) for i in range(60) for k in [("aa", "bb")[i % 2]]]
    item = " ".join(f"q{i}" for i in range(20))
    keep = {r[0]: r[1] for r in rows}
    rows += [(100, None, "aa", None, 1), (101, "", None, "s", 1), (102, "12 34 — … €", "bb", "s", 1), (None, None, None, None, None)]
    rows += [(200, rows[0][1], "aa", "s", 1), (201, rows[1][1] + " ende", "bb", "s", 1), (5, rows[2][1] + " end", "aa", "s", 1), (12, rows[2][1], "aa", "s", 1)]
    keep[5] = rows[2][1] + " end"
    del keep[12]
    rows += [(300, text("aa", 30) + " " + item + " " + text("aa", 30), "aa", "s", 1)]
    mail = text("aa", 30) + " write to some.body@example.org or 10.1.2.3 " + text("aa", 20)
    rows += [(301, mail, "aa", "s", 1)]
    keep[301] = mail.replace("some.body@example.org", "[EMAIL]").replace("10.1.2.3", "[IP]")
    folder = _folder(spark, tmp_path, rows, [(1, item), (2, None), (None, "the and")])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, folder))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert {r.doc_id: r.text for r in docs.collect()} == keep
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in keep.items()}
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == want
    assert not any(re.search("@", t) for t in keep.values())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, _folder(spark, tmp_path, [], [])).count() == 0
