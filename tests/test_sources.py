import json

import pytest
from pyspark.sql import functions as F

from pomelo.functions import numeric as N, terms, text
from pomelo.operators import clean, evaluate, report
from pomelo.sources import articles, edges as edge_files, reviews as R, runs


def test_csv_readers_keep_known_columns_and_coerce(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('review_id,stars,extra,user_id,business_id,text\n'
                    'r1,4.0,z,u1,b1,"a, ""quoted""\nline"\nr2,x,z,u2,b2,t\nr3,3.7,z,u3,b3,t\nr4,,z,u4,b4,t\n')
    rows = {r["review_id"]: r for r in R.read_reviews(spark, str(path)).collect()}
    assert rows["r1"].asDict() == {"review_id": "r1", "user_id": "u1", "business_id": "b1", "rating": 4}
    assert (rows["r2"]["rating"], rows["r3"]["rating"], rows["r4"]["rating"]) == (None, 3, None)


def test_dataset_round_trip_with_caps(spark, tmp_path):
    b = spark.createDataFrame([("b1", 'Say "hi", you', "A, B")], "business_id string, name string, categories string")
    u = spark.createDataFrame([(f"u{i}", f"n{i}") for i in range(5)], "user_id string, name string")
    r = spark.createDataFrame([(f"r{i}", f"u{i}", "b1", str(i % 5 + 1), f"2020-01-{10 - i:02d}") for i in range(5)],
                              "review_id string, user_id string, business_id string, stars string, date string")
    R.write_dataset(b, u, r, str(tmp_path))
    paths = [str(tmp_path / n) for n in ("business", "user", "review")]
    b2, u2, r2 = R.load_tables(spark, *paths, max_users=3, max_reviews=2)
    assert b2.first()["name"] == 'Say "hi", you'
    assert sorted(x[0] for x in u2.collect()) == ["u0", "u1", "u2"]
    assert sorted(x["review_id"] for x in r2.collect()) == ["r3", "r4"]


def test_catalogue_defaults(spark):
    df = spark.createDataFrame([(" b1 ", "x"), (None, "y")], "`Business_ID ` string, other string")
    assert [tuple(r) for r in R.catalogue(df).collect()] == [("b1", " b1 ", "N/A")]
    with pytest.raises(ValueError):
        R.catalogue(df.select("other"))


def test_prepared_sizes_without_metadata(spark, tmp_path):
    folder = str(tmp_path)
    df = spark.createDataFrame([(0, 1, 4, "r1", "train"), (2, 0, 5, "r2", "test")],
                               "user_idx long, item_idx long, rating int, review_id string, split string") \
        .withColumn("date", F.lit("2020-01-01").cast("date"))
    edge_files.write_table(df.select("user_idx", "item_idx", "rating", "date", "review_id", "split"), f"{folder}/edges", 1)
    edge_files.write_table(spark.createDataFrame([(0, "A", "b0")], edge_files.ITEM_SCHEMA), f"{folder}/items")
    _, _, sizes = edge_files.load_prepared(spark, folder)
    assert tuple(sizes.first()) == (3, 2, 2)
    edge_files.write_meta(edge_files.meta_row(df, "1k", {"t_load": 1.5}), f"{folder}/meta")
    meta = edge_files.read_meta(spark, f"{folder}/meta").first()
    assert meta["split_counts"] == {"train": 1, "test": 1} and meta["timings"] == {"t_load": 1.5}
    assert tuple(edge_files.load_prepared(spark, folder)[2].first()) == (3, 2, 2)


PUBMED = """<?xml version="1.0"?><PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">11</PMID>
<DateCompleted><Year>2020</Year><Month>3</Month><Day>7</Day></DateCompleted><DateRevised><Year>2021</Year></DateRevised>
<Article><Journal><Title>J. Care</Title></Journal><ArticleTitle> A &amp; B </ArticleTitle>
<Abstract><AbstractText Label="AIM">First.</AbstractText><AbstractText>Second.</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>Jo</ForeName></Author><Author><LastName>Solo</LastName></Author>
<Author><CollectiveName>Group</CollectiveName></Author></AuthorList></Article>
<KeywordList><Keyword MajorTopicYN="N">k1</Keyword><Keyword MajorTopicYN="Y">k2</Keyword></KeywordList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pubmed">11</ArticleId><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><DateRevised><Year>2021</Year></DateRevised><Article><ArticleTitle>T</ArticleTitle></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>13</PMID><Article><ArticleTitle>U</ArticleTitle><Abstract><AbstractText>%s</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>""" % ("y" * 2500)

ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
<entry><id>http://arxiv.org/abs/cs/0101v2</id><published>2022-03-04T05:06:07Z</published><title>Two
  lines</title><summary> s  t </summary><author><name>Ann</name></author><author><name>Bob</name></author>
<arxiv:doi>10.2/z</arxiv:doi><arxiv:journal_ref>J 1</arxiv:journal_ref><link href="http://a/x" rel="alternate"/>
<link title="pdf" href="http://a/pdf"/><category term="cs.IR"/><category term="cs.LG"/></entry>
<entry><id>odd</id><title>Only</title><summary>x</summary></entry></feed>"""


def test_pubmed_xml_files(spark, tmp_path):
    (tmp_path / "p.xml").write_text(PUBMED)
    rows = {r["pmid"]: r for r in articles.read_pubmed(spark, str(tmp_path / "p.xml")).collect()}
    a = rows["11"]
    assert a["title"] == "A & B" and a["abstract"] == "AIM: First. Second." and a["authors"] == ["Doe, Jo", "Solo"]
    assert (a["doi"], a["journal"], a["keywords"], a["published_at"]) == ("10.1/x", "J. Care", ["k1", "k2"], "2020-03-07")
    assert rows["12"]["published_at"] == "2021-01-01" and rows["12"]["authors"] == [] and rows["12"]["doi"] == ""
    assert rows["13"]["published_at"] == "" and len(rows["13"]["abstract"]) > 2000
    short = articles.read_pubmed(spark, str(tmp_path / "p.xml"), abstract_length=2000)
    assert {r["pmid"]: len(r["abstract"]) for r in short.collect()}["13"] == 2000


def test_atom_xml_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ATOM)
    rows = {r["arxiv_id"]: r for r in articles.read_arxiv(spark, str(tmp_path / "a.xml")).collect()}
    a = rows["cs_0101v2"]
    assert (a["title"], a["abstract"], a["authors"]) == ("Two lines", "s t", ["Ann", "Bob"])
    assert (a["doi"], a["journal_ref"], a["pdf_url"]) == ("10.2/z", "J 1", "http://a/pdf")
    assert (a["categories"], a["primary_category"], a["published_at"]) == (["cs.IR", "cs.LG"], "cs.IR", "2022-03-04")
    assert rows["odd"]["categories"] == [] and rows["odd"]["primary_category"] == "" and rows["odd"]["pdf_url"] == ""


def test_metric_files_and_their_sanity(spark, tmp_path):
    cell = lambda p, hr: {"P": p, "R": 0.01, "F1": 0.0, "NDCG": 0.01, "MRR": 0.0, "HR": hr, "MAP": 0.0, "n_eval_users": 500.0}
    for name, p, hr in (("gat_w1_10k", 0.002, 0.02), ("sage_w2_full", 0.0407, 0.02), ("notes", 1.0, 0.0)):
        folder = tmp_path / name / "metrics"
        folder.mkdir(parents=True)
        (folder / "m.json").write_text(json.dumps({"rmse": 2.0, "mae": 1.0, "ranking": {"10": cell(p, hr)},
                                                   "timings": {"t_train": 3.0, "loader": "pandas"}}, indent=2))
    m = runs.read_metrics(spark, f"{tmp_path}/*/metrics/*.json")
    rows = {r["run"]: r for r in m.collect()}
    assert set(rows) == {"gat_w1_10k", "sage_w2_full"}
    assert (rows["gat_w1_10k"]["model"], rows["gat_w1_10k"]["n_workers"], rows["gat_w1_10k"]["size_tag"]) == ("gat", 1, "10k")
    broken = evaluate.sanity_violations(runs.flatten_ranking(m)).collect()
    assert {r["run"] for r in broken} == {"sage_w2_full"}


def test_wide_run_records(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{
        "size_tag": "1k", "model": "gat", "n_workers": 2, "n_partitions": 1, "timings": {"t_train": 2.0},
        "spark_timings": {"t_total_pandas": 7.0}, "test_metrics": {"rmse": 1.0, "ranking": {"10": {"NDCG": 0.5, "R": 0.1}}},
        "resources": {"train": {"gpu_util_pct": {"mean": 33.0}}}}], indent=1))
    row = report.wide_runs(runs.read_run_records(spark, str(tmp_path / "r.json"), True)).first()
    assert row["mode"] == "standard" and row["t_preprocess"] == 7.0 and row["ndcg@10"] == 0.5 and row["ndcg@5"] is None
    assert row["recall@10"] == 0.1 and row["gpu_util_mean"] == 33.0


def test_word_lists(spark):
    names = ["Dentists", "Laser Tag", "Laser Hair Removal", "Florists", "Urgent Care", "Restaurants"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    assert [r[0] for r in df.filter(clean.is_medical("c")).collect()] == ["Dentists", "Laser Hair Removal", "Urgent Care"]
    biz = spark.createDataFrame([("Health & Medical, Doctors",), ("Food",), (None,)], "categories string")
    assert clean.domain_filter(biz).count() == 1
    assert len(set(terms.MEDICAL_FRAGMENTS)) == len(terms.MEDICAL_FRAGMENTS)


def test_grades_speedups_and_tags(spark):
    df = spark.createDataFrame([(0.0,), (0.002,), (0.005,), (0.007,), (0.01,), (0.5,)], "n double")
    assert [r[0] for r in df.select(N.grade("n")).collect()] == ["NUL", "TRES FAIBLE", "FAIBLE", "LIMITE", "ACCEPTABLE", "BON"]
    df = spark.createDataFrame([(10.0, 4.0, 2), (10.0, 0.0, 0)], "a double, b double, w int")
    got = df.select(N.speedup("a", "b").alias("s"), "w").select("s", N.efficiency("s", "w").alias("e")).collect()
    assert [tuple(r) for r in got] == [(2.5, 125.0), (0.0, 0.0)]
    df = spark.createDataFrame([("10k",), ("2M",), ("full",)], "t string")
    assert [r[0] for r in df.select(N.size_number("t")).collect()] == [10_000, 2_000_000, 0]


def test_stable_log_sigmoid(spark):
    df = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double")
    assert [r[0] for r in df.select(N.log_sigmoid("x")).collect()] == pytest.approx([-800.0, -0.6931471805599453, 0.0])


def test_labels_and_lists(spark):
    df = spark.createDataFrame([("n", "A , B"), ("m", "N/A"), ("o", "")], "name string, c string")
    assert [r[0] for r in df.select(text.display_label("name", "c")).collect()] == ["n  —  A", "m", "o"]
    assert df.select(text.split_list("c")).first()[0] == ["A", "B"]


def test_speed_table_without_base(spark):
    df = spark.createDataFrame([("gat", "1k", 1, 10.0), ("gat", "1k", 4, 4.0), ("sage", "1k", 2, 3.0)],
                               "model string, size_tag string, n_workers int, t_train double")
    got = {(r["model"], r["n_workers"]): (r["speedup"], r["efficiency"]) for r in report.speed_table(df).collect()}
    assert got == {("gat", 1): (1.0, 100.0), ("gat", 4): (2.5, 62.5), ("sage", 2): (1.0, 50.0)}
    assert report.key_figures(df.withColumn("ndcg", F.lit(0.1))).first()["best_speedup"] == 2.5
