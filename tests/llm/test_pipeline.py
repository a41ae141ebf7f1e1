"""The pipeline stage by stage, and the registered queries."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF
from pomelo.llm import minhash, mixing, quality, toxicity

NAMES = [n for n in entry.queries() if n.startswith("op") and n[2:3].isdigit()]


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", NAMES)
def test_queries_return_a_row_for_each_input(spark, name):
    table = {"op1": "pages", "op8": "pages", "op6": "embeddings"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    got = entry.queries()[name](spark, SF)
    if name.startswith("op13"):
        assert {r["lang"] for r in got.collect()} <= {r["lang"] or "und" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    else:
        assert got.count() == n if not name.startswith("op4") else got.count() >= n


def test_stages(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    full = docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name != "packing":
            assert out.columns == corpus_pipeline.DOCUMENT_COLUMNS
        seen[name] = (docs, out)
        docs = out

    def ids(df):
        return sorted(r["doc_id"] for r in df.select("doc_id").collect())

    before, after = seen["toxicity"]
    assert ids(after) == ids(toxicity.toxicity(before, full, labels).filter("predicted = 0"))
    before, after = seen["quality"]
    assert ids(after) == ids(quality.quality(before, full, labels).filter("predicted = 1"))
    before, after = seen["near_duplicates"]
    assert ids(after) == ids(minhash.near_duplicates(before).filter("kept"))
    before, after = seen["mixing"]
    want = [r["doc_id"] for r in mixing.mix(before).collect() for _ in range(r["repeats"])]
    assert ids(after) == sorted(want)
    before, after = seen["packing"]
    assert set(ids(after)) == set(ids(before))


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and set(got.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The given labels and documents, as what the classifiers learn from."""
    path = str(tmp_path_factory.mktemp("sf"))
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


ODD = [(9001, None, "en", "src0", 0), (9002, "", None, None, 0), (9002, "", None, None, 0), (None, "no id, but a text of some words here", "en", "src0", None),
       (9003, "the very same words in the very same order twice", "en", "src1", 48), (9004, "the very same words in the very same order twice", "en", "src1", 48),
       (9005, "long " * 30_000, "en", "src2", 150_000), (9006, " \n\t ", "en", "src2", 4)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_odd_rows_and_empty_tables(spark, folder, name, stage):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame(ODD, COLUMNS)
    wide = docs.withColumns({c: F.lit(-1) for c in ("row", "score", "predicted", "size", "draw", "repeats", "set_id", "kept", "a.b")})
    plain, out = stage(spark, docs, folder), stage(spark, wide, folder)
    view = lambda df: sorted(map(str, df.select("doc_id").collect()))
    assert out.columns == plain.columns
    if name != "packing":
        assert out.columns == corpus_pipeline.DOCUMENT_COLUMNS and view(out) == view(plain)
    else:
        assert {r["doc_id"] for r in out.collect()} == {r[0] for r in ODD}
    empty = stage(spark, docs.limit(0), folder)
    assert empty.count() == 0 and empty.columns == plain.columns


def test_what_stages_keep_of_odd_rows(spark, folder):
    docs = spark.createDataFrame(ODD, COLUMNS)
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    assert set(ids(corpus_pipeline.drop_toxic(spark, docs, folder))) >= {9001, 9002, 9006}
    kept = ids(corpus_pipeline.drop_near_copies(spark, docs, folder))
    assert 9003 in kept and 9004 not in kept and {9001, 9002, 9006, None} <= set(kept)
    assert not {9001, 9002, 9006} & set(ids(corpus_pipeline.mix_sources(spark, docs, folder)))


def test_when_the_first_stage_drops_every_row(spark, tmp_path):
    """All later stages run on nothing."""
    toxic = [(i, f"vile words number {i % 7} of hate and scorn", "en", "src0", 30) for i in range(200) if i % 2]
    clean = [(i, f"kind talk of day {i % 7} with cheer", "en", "src0", 30) for i in range(200) if not i % 2]
    path = str(tmp_path)
    docs = spark.createDataFrame(toxic + clean, COLUMNS)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rest = spark.createDataFrame(toxic, COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        rest = stage(spark, rest, path)
        assert rest.count() == 0, name
    assert corpus_pipeline.drop_toxic(spark, spark.createDataFrame(clean, COLUMNS), path).count() == 100
