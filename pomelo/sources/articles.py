"""Article records out of XML exports.

Each function maps one article element, as Spark's XML reader parses it, to the record
the streams carry. Elements come from XML files or from a text column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import padded_date, squeeze, truncate

_DATE = "struct<Year:string,Month:string,Day:string>"
PUBMED_ELEMENT = (
    "MedlineCitation struct<PMID:struct<_VALUE:string,_Version:string>,"
    f"DateCompleted:{_DATE},DateRevised:{_DATE},"
    "Article:struct<ArticleTitle:string,Journal:struct<Title:string>,"
    "Abstract:struct<AbstractText:array<struct<_VALUE:string,_Label:string>>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string>>>>,"
    "KeywordList:struct<Keyword:array<struct<_VALUE:string,_MajorTopicYN:string>>>>, "
    "PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>")
ARXIV_ELEMENT = (
    "id string, title string, summary string, published string, doi string, journal_ref string, "
    "author array<struct<name:string>>, "
    "category array<struct<_term:string,_VALUE:string>>, "
    "link array<struct<_title:string,_href:string,_VALUE:string>>")


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _cut(text: Column, length: int | None) -> Column:
    return text if length is None else truncate(text, length)


def pubmed_records(elements: DataFrame, ingested_at: Column | None = None,
                   abstract_length: int | None = None) -> DataFrame:
    """Records of parsed ``PubmedArticle`` elements; ``abstract_length`` cuts abstracts."""
    a, m = "MedlineCitation.Article", "MedlineCitation"
    part = lambda p: F.concat(
        F.when(_or_empty(p["_Label"]) != "", F.concat(p["_Label"], F.lit(": "))).otherwise(""),
        _or_empty(p["_VALUE"]))
    abstract = F.trim(F.concat_ws(" ", F.transform(f"{a}.Abstract.AbstractText", part)))
    named = F.filter(f"{a}.AuthorList.Author", lambda p: _or_empty(p["LastName"]) != "")
    authors = F.transform(named, lambda p: F.trim(F.concat(
        p["LastName"], F.when(_or_empty(p["ForeName"]) != "", F.concat(F.lit(", "), p["ForeName"]))
        .otherwise(""))))
    keywords = F.filter(F.transform(f"{m}.KeywordList.Keyword", lambda k: k["_VALUE"]),
                        lambda k: _or_empty(k) != "")
    doi = F.try_element_at(F.filter("PubmedData.ArticleIdList.ArticleId",
                                    lambda i: i["_IdType"] == "doi"), F.lit(1))["_VALUE"]
    dated = lambda d: padded_date(d["Year"], d["Month"], d["Day"])
    done, revised = F.col(f"{m}.DateCompleted"), F.col(f"{m}.DateRevised")
    published = F.when(done.isNotNull(), dated(done)).when(revised.isNotNull(), dated(revised)).otherwise("")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return elements.select(
        F.lit("pubmed").alias("source"), _or_empty(F.col(f"{m}.PMID._VALUE")).alias("pmid"),
        _or_empty(doi).alias("doi"), F.trim(_or_empty(F.col(f"{a}.ArticleTitle"))).alias("title"),
        _cut(abstract, abstract_length).alias("abstract"), _list(authors).alias("authors"),
        _or_empty(F.col(f"{a}.Journal.Title")).alias("journal"), _list(keywords).alias("keywords"),
        published.alias("published_at"), (ingested_at if ingested_at is not None else now).alias("ingested_at"))


def arxiv_records(elements: DataFrame, ingested_at: Column | None = None,
                  abstract_length: int | None = None) -> DataFrame:
    """Records of parsed Atom ``entry`` elements; ``abstract_length`` cuts abstracts."""
    raw = _or_empty(F.col("id"))
    arxiv_id = F.when(raw.contains("/abs/"), F.replace(F.substring_index(raw, "/abs/", -1), F.lit("/"), F.lit("_"))) \
                .otherwise(raw)
    categories = _list(F.transform("category", lambda c: _or_empty(c["_term"])))
    pdf = F.try_element_at(F.filter("link", lambda k: k["_title"] == "pdf"), F.lit(1))["_href"]
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return elements.select(
        F.lit("arxiv").alias("source"), arxiv_id.alias("arxiv_id"), _or_empty(F.col("doi")).alias("doi"),
        squeeze(_or_empty(F.col("title"))).alias("title"),
        _cut(squeeze(_or_empty(F.col("summary"))), abstract_length).alias("abstract"),
        _list(F.transform("author", lambda p: _or_empty(p["name"]))).alias("authors"),
        categories.alias("categories"),
        _or_empty(F.try_element_at(categories, F.lit(1))).alias("primary_category"),
        _or_empty(F.col("journal_ref")).alias("journal_ref"), _or_empty(pdf).alias("pdf_url"),
        F.substring(_or_empty(F.col("published")), 1, 10).alias("published_at"),
        (ingested_at if ingested_at is not None else now).alias("ingested_at"))


def read_pubmed(spark: SparkSession, path: str, abstract_length: int | None = None) -> DataFrame:
    """Records of XML export files; big files are split at article elements."""
    return pubmed_records(spark.read.format("xml").option("rowTag", "PubmedArticle")
                          .schema(PUBMED_ELEMENT).load(path), abstract_length=abstract_length)


def read_arxiv(spark: SparkSession, path: str, abstract_length: int | None = None) -> DataFrame:
    return arxiv_records(spark.read.format("xml").option("rowTag", "entry")
                         .option("ignoreNamespace", "true").schema(ARXIV_ELEMENT).load(path), abstract_length=abstract_length)


def parse_pubmed(df: DataFrame, column: str = "xml", ingested_at: str | None = None, abstract_length: int | None = None) -> DataFrame:
    """Records of a text column that holds one ``PubmedArticle`` element per row."""
    struct = "struct<" + _as_struct(PUBMED_ELEMENT) + ">"
    carried = [ingested_at] if ingested_at else []
    parsed = df.select(F.from_xml(F.col(column), struct, {"mode": "PERMISSIVE"}).alias("_e"), *carried)
    return pubmed_records(parsed.select("_e.*", *carried), F.col(ingested_at) if ingested_at else None, abstract_length)


def parse_arxiv(df: DataFrame, column: str = "xml", ingested_at: str | None = None, abstract_length: int | None = None) -> DataFrame:
    """Records of a text column that holds one ``entry`` element per row."""
    struct = "struct<" + _as_struct(ARXIV_ELEMENT) + ">"
    carried = [ingested_at] if ingested_at else []
    parsed = df.select(F.from_xml(F.col(column), struct, {"ignoreNamespace": "true"}).alias("_e"), *carried)
    return arxiv_records(parsed.select("_e.*", *carried), F.col(ingested_at) if ingested_at else None, abstract_length)


def _as_struct(ddl: str) -> str:
    """Column DDL as struct field DDL."""
    from pyspark.sql.types import StructType
    return StructType.fromDDL(ddl).simpleString()[len("struct<"):-1]
