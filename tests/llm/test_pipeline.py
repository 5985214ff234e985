"""Each stage against what it says, on its own input; and the whole."""

import numpy as np
import pytest
from test_dedup import plain_lines, plain_simhash

import corpus_pipeline


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf, out = "/root/testdata/sf0.001", tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        found.append((name, docs))
    return dict(found), sf


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    tables, _ = stages
    for name in ("toxicity", "line_dedup", "simhash_near_dedup", "mixing"):
        assert tables[name].columns == tables["documents"].columns


def test_toxicity_only_drops(stages):
    tables, _ = stages
    before, after = dict(texts(tables["documents"])), dict(texts(tables["toxicity"]))
    assert after.items() <= before.items()
    assert len(after) >= 0.8 * len(before)


def test_lines(stages):
    tables, _ = stages
    want = {k: t for k, (_, _, t) in plain_lines(texts(tables["toxicity"])).items()}
    assert dict(texts(tables["line_dedup"])) == want
    assert all(r["n_chars"] == len(r["text"]) for r in tables["line_dedup"].collect())


def test_near_copies(stages):
    tables, _ = stages
    before = texts(tables["line_dedup"])
    firsts = {c for _, c in plain_simhash(before).values()}
    assert dict(texts(tables["simhash_near_dedup"])) == {k: t for k, t in before if k in firsts}


def test_mixing_repeats_whole_rows(stages):
    tables, _ = stages
    before = dict(texts(tables["simhash_near_dedup"]))
    assert all(before[k] == t for k, t in texts(tables["mixing"]))


def test_tokens(stages):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tables, _ = stages
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before = dict(texts(tables["mixing"]))
    rows = tables["bpe"].collect()
    assert len(rows) == tables["mixing"].count()
    for r in rows:
        ids = library.encode(before[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_run(spark, stages):
    tables, sf = stages
    assert corpus_pipeline.run(spark, sf).count() == tables["bpe"].count()
    assert corpus_pipeline.ORACLE_SQL is None
