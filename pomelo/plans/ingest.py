"""Article ingestion: batch twins of the streams, sinks, and XML sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import fresh_path
from ..sources import articles as article_files, kafka
from ..streaming import articles as A, batches, faults, index
from . import domain as D, sqltext as S
from .registry import query
from .updates import GROWN

TRIMMED = "trim(title, ' ')"


def _topic_sql(topic: str, key: str) -> str:
    return f"""WITH {S.ARTICLES} SELECT {TRIMMED} AS title, lower({TRIMMED}) AS title_lower, md5(trim(abstract, ' ')) AS abstract_md5,
  source, article_id AS {key}, trim(abstract, ' ') <> '' AS has_abstract, CAST(coalesce(len(authors), 0) AS INTEGER) AS n_authors,
  CASE WHEN published_at = '' OR contains(published_at, 'T') THEN NULL ELSE published_at END AS published_at, doc_id AS "offset", CAST(doc_id%4 AS INTEGER) AS "partition"
  FROM articles WHERE NOT bad AND NOT lost AND topic = '{topic}' AND {TRIMMED} <> ''"""


def _topic_view(rows, key="pmid"):
    return rows.select("title", "title_lower", F.md5("abstract").alias("abstract_md5"), "source", key, "has_abstract",
                       "n_authors", F.date_format("published_at", "yyyy-MM-dd").alias("published_at"), "offset", "partition")


def _topic(records, topic, key):
    return _topic_view(A.process_topic(records, topic), key)


@query("pubmed_articles", "X1 F25 F7 F11 F12 F26 P7 P8 P9", _topic_sql(kafka.PUBMED_TOPIC, "pmid"))
def pubmed_articles(spark, sf):
    return _topic(D.kafka_records(spark, sf), kafka.PUBMED_TOPIC, "pmid")


@query("arxiv_articles", "X1 F25 F7 F11 F12 F26 P7 P8 P9", _topic_sql(kafka.ARXIV_TOPIC, "arxiv_id"))
def arxiv_articles(spark, sf):
    return _topic(D.kafka_records(spark, sf), kafka.ARXIV_TOPIC, "arxiv_id")


UNIFIED_SQL = f"""WITH {S.ARTICLES} SELECT CASE WHEN lost THEN 'other-articles' ELSE topic END AS kafka_topic, CAST(doc_id%4 AS INTEGER) AS "partition", doc_id AS "offset",
  CASE WHEN NOT bad THEN title END AS title, CASE WHEN NOT bad THEN md5(abstract) END AS abstract_md5, CASE WHEN NOT bad THEN published_at END AS published_at,
  CASE WHEN NOT bad AND is_pubmed THEN article_id END AS pmid, CASE WHEN NOT bad AND NOT is_pubmed THEN article_id END AS arxiv_id, CAST(NULL AS VARCHAR) AS url,
  CASE WHEN NOT bad THEN array_to_string(authors, ';') END AS authors FROM articles"""


def _unified_view(rows):
    return rows.select("kafka_topic", "partition", "offset", "title", F.md5("abstract").alias("abstract_md5"),
                       "published_at", "pmid", "arxiv_id", "url",
                       F.when(F.col("authors").isNotNull(), F.concat_ws(";", "authors")).alias("authors"))


@query("unified_articles", "X2 P9 F25", UNIFIED_SQL)
def unified_articles(spark, sf):
    return _unified_view(A.unified_articles(D.kafka_records(spark, sf)))


ENRICHED = f"""u AS (SELECT *, CASE WHEN bad THEN NULL ELSE source END AS tag FROM articles),
e AS (SELECT *, tag||'-articles-'||strftime(sent_at, '%Y.%m') AS index_name, length(abstract) AS abstract_length FROM u WHERE tag IS NOT NULL)"""


@query("enriched_articles", "X5 F13 F14 F29 P12", f"""WITH {S.ARTICLES}, {ENRICHED} SELECT doc_id AS "offset", tag, index_name, article_id AS doc_id, CAST(abstract_length AS INTEGER) AS abstract_length,
  CASE WHEN authors IS NULL THEN NULL ELSE CAST(len(authors) AS INTEGER) END AS authors_count, '1.0' AS pipeline_version,
  CASE WHEN published_at = '' THEN NULL WHEN contains(published_at, 'T') THEN replace(published_at, 'T', ' ') ELSE published_at||' 00:00:00' END AS published_at,
  strftime(sent_at, '%Y-%m-%d %H:%M:%S') AS ingested_at FROM e""")
def enriched_articles(spark, sf):
    rows = A.enrich_articles(A.unified_articles(D.kafka_records(spark, sf))).filter(F.col("tag").isNotNull())
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("offset", "tag", "index_name", "doc_id", "abstract_length", "authors_count", "pipeline_version",
                       stamp("published_at"), stamp("ingested_at"))


@query("latest_document_per_id", "S15 W8 X5", f"""WITH {S.ARTICLES}, {ENRICHED} SELECT index_name, article_id AS doc_id, max(doc_id) AS "offset" FROM e GROUP BY index_name, article_id""")
def latest_document_per_id(spark, sf):
    rows = A.enrich_articles(A.unified_articles(D.kafka_records(spark, sf)))
    newest = [F.col("kafka_ts").desc(), F.col("offset").desc()]
    return index.latest_documents(rows, newest).select("index_name", "doc_id", "offset")


@query("dead_letters", "S16", f"""WITH {S.ARTICLES} SELECT CASE WHEN lost THEN 'other-articles' ELSE topic END AS topic, doc_id AS "offset",
  CASE WHEN lost THEN 'unknown topic' WHEN trim(abstract, ' ') = '' THEN 'empty record' ELSE 'malformed json' END AS error FROM articles WHERE bad OR lost""")
def dead_letters(spark, sf):
    return A.dead_letters(D.kafka_records(spark, sf)).select("topic", "offset", "error")


@query("console_projection", "S14", f"""WITH {S.ARTICLES} SELECT CASE WHEN NOT bad THEN title END AS title, CASE WHEN NOT bad THEN source END AS source,
  CASE WHEN NOT bad THEN published_at END AS published_at, CASE WHEN NOT bad THEN strftime(sent_at, '%Y-%m-%dT%H:%M:%S') END AS ingested_at
  FROM articles WHERE NOT lost AND topic = '{kafka.ARXIV_TOPIC}'""")
def console_projection(spark, sf):
    return A.console_view(D.kafka_records(spark, sf), kafka.ARXIV_TOPIC)


# ---------------------------------------------------------------- the streams themselves, over files

# micro-batches that the files of a stream make
TRIGGERS = 4


def _record_files(spark, sf):
    """Folder of the records, and how many of its files a micro-batch takes.

    The rows of a topic partition are dealt out to several files by their offset, so no task writes or reads a
    whole partition; the number of files is that of the shuffle, of micro-batches it is always the same.
    """
    path, records = fresh_path(spark, "records"), D.kafka_records(spark, sf)
    files = TRIGGERS * -(-V.width(records) // TRIGGERS)
    records.repartition(files, "partition", "offset").write.parquet(path)
    written = len(spark.read.parquet(path).inputFiles())
    return path, max(1, -(-written // TRIGGERS))


def _drain(started):
    started.awaitTermination()


@query("article_stream_to_parquet", "S12 S13 X1 X3 X4", _topic_sql(kafka.PUBMED_TOPIC, "pmid"))
def article_stream_to_parquet(spark, sf):
    (source, files), out = _record_files(spark, sf), fresh_path(spark, "stream")
    _drain(A.topic_stream(kafka.read_files(spark, source, files), kafka.PUBMED_TOPIC, f"{out}/data", f"{out}/checkpoint", None))
    return _topic_view(spark.read.parquet(f"{out}/data"))


@query("unified_stream_to_parquet", "S13 X2 X3 X4", UNIFIED_SQL)
def unified_stream_to_parquet(spark, sf):
    (source, files), out = _record_files(spark, sf), fresh_path(spark, "stream")
    _drain(A.unified_stream(kafka.read_files(spark, source, files), f"{out}/data", f"{out}/checkpoint", None))
    return _unified_view(spark.read.parquet(f"{out}/data"))


@query("index_stream", "S15 X5 W8", f"""WITH {S.ARTICLES}, {ENRICHED} SELECT index_name, article_id AS doc_id, max(doc_id) AS "offset" FROM e GROUP BY index_name, article_id""")
def index_stream(spark, sf):
    (source, files), out = _record_files(spark, sf), fresh_path(spark, "index")
    stream = A.enrich_articles(A.unified_articles(kafka.read_files(spark, source, files)))
    _drain(index.index_stream(stream, f"{out}/data", f"{out}/checkpoint"))
    return index.read_index(spark, f"{out}/data").select("index_name", "doc_id", "offset")


@query("index_stream_after_crash", "S15 X4 X5 W8", f"""WITH {S.ARTICLES}, {ENRICHED} SELECT index_name, article_id AS doc_id, max(doc_id) AS "offset" FROM e GROUP BY index_name, article_id""")
def index_stream_after_crash(spark, sf):
    """The index stream fails when its second batch is written and not yet recorded, and is started again."""
    (source, files), out = _record_files(spark, sf), fresh_path(spark, "index")
    stream = A.enrich_articles(A.unified_articles(kafka.read_files(spark, source, files)))
    crash = faults.after_write(1)
    start = lambda: index.index_stream(stream, f"{out}/data", f"{out}/checkpoint", wrap=crash)
    if not faults.run_through(start) or faults.run_through(start):
        raise RuntimeError("the stream was to fail once")
    return index.read_index(spark, f"{out}/data").select("index_name", "doc_id", "offset")


@query("article_stream_after_crash", "S13 X1 X3 X4", _topic_sql(kafka.PUBMED_TOPIC, "pmid"))
def article_stream_after_crash(spark, sf):
    """A task of the stream fails inside a batch while others have written their files, and it is started again."""
    (source, files), out = _record_files(spark, sf), fresh_path(spark, "stream")
    records = kafka.read_files(spark, source, files_per_trigger=2 * files)
    start = lambda rows: A.topic_stream(rows, kafka.PUBMED_TOPIC, f"{out}/data", f"{out}/checkpoint", None)
    failing = faults.failing_rows(records, (F.col("partition") == 3) & (F.col("topic") == kafka.PUBMED_TOPIC))
    if not faults.run_through(lambda: start(failing)) or faults.run_through(lambda: start(records)):
        raise RuntimeError("the stream was to fail once")
    return _topic_view(spark.read.parquet(f"{out}/data"))


@query("review_stream_after_crash", "X4 X6 I1 I2", f"""WITH {GROWN}
SELECT review_id, rating, user_idx, item_idx FROM past JOIN old_users USING (user_id) JOIN old_items USING (item_id)
UNION ALL SELECT review_id, CAST(rating AS INTEGER), user_idx, item_idx FROM enc""")
def review_stream_after_crash(spark, sf):
    """Both micro-batches of reviews fail after they are written; ids and rows are those of a run without a fault."""
    source, out = fresh_path(spark, "batches"), fresh_path(spark, "ids")
    for number, part in enumerate((D.history(spark, sf), D.batch(spark, sf))):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        crash = faults.after_write(number)
        start = lambda: batches.review_stream(stream, out, f"{out}/checkpoint", wrap=crash)  # noqa: E731,B023
        if not faults.run_through(start) or faults.run_through(start):
            raise RuntimeError("the stream was to fail once")
    return spark.read.parquet(f"{out}/encoded").select("review_id", F.col("rating").cast("int").alias("rating"), "user_idx", "item_idx")


@query("review_batch_stream", "X6 I1 I2", f"""WITH {GROWN}
SELECT review_id, rating, user_idx, item_idx FROM past JOIN old_users USING (user_id) JOIN old_items USING (item_id)
UNION ALL SELECT review_id, CAST(rating AS INTEGER), user_idx, item_idx FROM enc""")
def review_batch_stream(spark, sf):
    """The history as one micro-batch and the batch as the next, by the same stream."""
    source, out = fresh_path(spark, "batches"), fresh_path(spark, "ids")
    for part in (D.history(spark, sf), D.batch(spark, sf)):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        _drain(batches.review_stream(stream, out, f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/encoded").select("review_id", F.col("rating").cast("int").alias("rating"),
                                                       "user_idx", "item_idx")


# ---------------------------------------------------------------- XML

def _escape(c):
    """Text as XML character data; characters XML forbids are dropped."""
    clean = F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    return F.replace(F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def _numbers(c):
    return c.cast("string")


def _pubmed_xml(spark, sf):
    docs = D.table(spark, sf, "documents")
    n = F.col("doc_id")
    author = F.when(F.pmod(n, F.lit(3)) == 0, F.lit("<Author><LastName>Solo</LastName></Author>")).otherwise(
        F.concat(F.lit("<Author><LastName>Doe</LastName><ForeName>J"), _numbers(n), F.lit("</ForeName></Author><Author><ForeName>Nameless</ForeName></Author>")))
    date = F.when(F.pmod(n, F.lit(5)) == 0, "").otherwise(F.concat(
        F.lit("<DateRevised><Year>2021</Year><Month>"), _numbers(F.pmod(n, F.lit(12)) + 1),
        F.lit("</Month><Day>"), _numbers(F.pmod(n, F.lit(28)) + 1), F.lit("</Day></DateRevised>")))
    return docs.select("doc_id", F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID Version=\"1\">"), _numbers(n), F.lit("</PMID>"), date,
        F.lit("<Article><Journal><Title>Journal of "), F.col("source"), F.lit("</Title></Journal><ArticleTitle>Report &amp; review "),
        _numbers(n), F.lit("</ArticleTitle><Abstract><AbstractText Label=\"BODY\">"), _escape(F.regexp_replace("text", r"\s+", " ")),
        F.lit("</AbstractText><AbstractText>End.</AbstractText></Abstract><AuthorList>"), author,
        F.lit("</AuthorList></Article><KeywordList><Keyword MajorTopicYN=\"N\">"), F.col("lang"),
        F.lit("</Keyword></KeywordList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType=\"pubmed\">"), _numbers(n),
        F.lit("</ArticleId><ArticleId IdType=\"doi\">10.1/"), _numbers(n),
        F.lit("</ArticleId></ArticleIdList></PubmedData></PubmedArticle>")).alias("xml"))


CLEAN_TEXT = "regexp_replace(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '[\\x00-\\x08\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]', '', 'g')"


@query("pubmed_xml_records", "S10 F3 F6", f"""SELECT CAST(doc_id AS VARCHAR) AS pmid, '10.1/'||doc_id AS doi, 'Report & review '||doc_id AS title,
  md5('BODY: '||trim({CLEAN_TEXT}, ' ')||' End.') AS abstract_md5, CASE WHEN doc_id%3 = 0 THEN 'Solo' ELSE 'Doe, J'||doc_id END AS authors,
  'Journal of '||source AS journal, lang AS keywords,
  CASE WHEN doc_id%5 = 0 THEN '' ELSE '2021-'||lpad(CAST(doc_id%12+1 AS VARCHAR), 2, '0')||'-'||lpad(CAST(doc_id%28+1 AS VARCHAR), 2, '0') END AS published_at FROM documents""")
def pubmed_xml_records(spark, sf):
    rows = article_files.parse_pubmed(_pubmed_xml(spark, sf))
    return rows.select("pmid", "doi", "title", F.md5("abstract").alias("abstract_md5"), F.concat_ws(";", "authors").alias("authors"),
                       "journal", F.concat_ws(";", "keywords").alias("keywords"), "published_at")


def _arxiv_xml(spark, sf):
    n = F.col("doc_id")
    return D.table(spark, sf, "documents").select("doc_id", F.concat(
        F.lit("<entry><id>http://example.org/abs/cs/"), _numbers(n), F.lit("v1</id><published>2022-03-04T05:06:07Z</published><title>A\n  study "),
        _numbers(n), F.lit("</title><summary>"), _escape(F.col("text")), F.lit("</summary><author><name>Ann</name></author><author><name>Bob "), F.col("lang"),
        F.lit("</name></author><ax:doi>10.2/"), _numbers(n), F.lit("</ax:doi><link href=\"http://example.org/a\" rel=\"alternate\"/><link title=\"pdf\" href=\"http://example.org/pdf/"),
        _numbers(n), F.lit("\"/><category term=\"cs."), F.col("source"), F.lit("\"/><category term=\"math\"/></entry>")).alias("xml"))


ARXIV_TEXT = "trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\f\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), ' ')"


@query("arxiv_xml_records", "S11 F2 F3 F5", f"""SELECT 'cs_'||doc_id||'v1' AS arxiv_id, '10.2/'||doc_id AS doi, 'A study '||doc_id AS title, md5({ARXIV_TEXT}) AS abstract_md5,
  'Ann;Bob '||lang AS authors, 'cs.'||source||';math' AS categories, 'cs.'||source AS primary_category, '' AS journal_ref,
  'http://example.org/pdf/'||doc_id AS pdf_url, '2022-03-04' AS published_at FROM documents""")
def arxiv_xml_records(spark, sf):
    rows = article_files.parse_arxiv(_arxiv_xml(spark, sf))
    return rows.select("arxiv_id", "doi", "title", F.md5("abstract").alias("abstract_md5"), F.concat_ws(";", "authors").alias("authors"),
                       F.concat_ws(";", "categories").alias("categories"), "primary_category", "journal_ref", "pdf_url", "published_at")
