"""The given tables seen as a review dataset.

customer = user, part = business, lineitem with orders = review (rating 1..5 from the
quantity), documents = articles, events = run records and resource samples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import hash32
from ..operators import encode, graph, split
from ..session import TemporaryTables, fresh_path, materialize
from ..sources import edges as edge_files
from ..sources.kafka import ARXIV_TOPIC, PUBMED_TOPIC

RATING_THRESHOLD = 3   # rows below are not part of the training data
RELEVANT_FROM = 4.0    # held-out rows below are shown but not relevant
DIM = 64
LAYERS = 1
SEED = 42
AS_OF = "2002-01-01"
# Reviews from this day on, and all of a customer segment and a brand that joined then, are the batch
# that comes after the history.
BATCH_FROM, NEW_SEGMENT, NEW_BRAND = "2001-01-01", "MACHINERY", "Brand#25"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"),
                                               F.col("c_name").alias("name"))


def businesses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"),
        F.concat_ws(", ", "p_type", "p_brand").alias("categories"))


def reviews(spark: SparkSession, sf: str, orders: DataFrame | None = None, *more: str) -> DataFrame:
    """(review_id, user_id, item_id, rating, date), and ``more`` columns of the ``orders`` if these are given."""
    lines = table(spark, sf, "lineitem")
    if orders is None:
        orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("review_id"),
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
        (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("int").alias("rating"),
        F.to_date("l_shipdate").alias("date"), *more)


def with_late(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews, marked as part of the batch (``late``) or of the history."""
    users = table(spark, sf, "customer").filter(F.col("c_mktsegment") == NEW_SEGMENT).select(
        F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("_u"))
    items = table(spark, sf, "part").filter(F.col("p_brand") == NEW_BRAND).select(
        F.col("p_partkey").alias("item_id"), F.lit(True).alias("_i"))
    late = (F.col("date") >= F.lit(BATCH_FROM).cast("date")) | F.col("_u").isNotNull() | F.col("_i").isNotNull()
    # customers meet their orders, which are fewer than the reviews
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(users, "o_custkey", "left")
    return reviews(spark, sf, orders, "_u").join(items, "item_id", "left").select(
        "review_id", "user_id", "item_id", "rating", "date", late.alias("late"))


def _stored_late(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`with_late`, written once per application: a round reads history and batch many times, and each
    reading would join the tables again."""
    key = (spark.sparkContext.applicationId, sf, "late")
    if key not in _WRITTEN:
        rows, path = with_late(spark, sf), fresh_path(spark, "late")
        # the parts are files of their own, so a reader of one doesn't scan the other
        rows.write.partitionBy("late").parquet(path)
        _WRITTEN[key] = spark.read.schema(rows.schema).parquet(path)
    return _WRITTEN[key]


def history(spark: SparkSession, sf: str) -> DataFrame:
    return _stored_late(spark, sf).filter("NOT late").drop("late")


def batch(spark: SparkSession, sf: str) -> DataFrame:
    return _stored_late(spark, sf).filter("late").drop("late")


@dataclass(frozen=True)
class Prepared:
    """Output folder of the preparation job, read back lazily."""

    spark: SparkSession
    folder: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @property
    def edges(self) -> DataFrame:
        return self.spark.read.schema(edge_files.EDGE_SCHEMA).parquet(f"{self.folder}/edges")

    @property
    def user_ids(self) -> DataFrame:
        return self._read("users")

    @property
    def item_ids(self) -> DataFrame:
        return self._read("item_ids")

    def sizes(self) -> tuple[int, int]:
        row = edge_files.read_meta(self.spark, f"{self.folder}/meta").select("n_users", "n_items").first()
        return row["n_users"], row["n_items"]

    def part(self, name: str) -> DataFrame:
        """(user, item, rating) rows of one part of the split."""
        return (self.edges.filter(F.col("split") == name)
                .select(F.col("user_idx").alias("user"), F.col("item_idx").alias("item"), "rating"))

    def train_edges(self) -> DataFrame:
        """Training rows in node space: (user_id, item_id, rating, date)."""
        n_users, _ = self.sizes()
        return (self.edges.filter(F.col("split") == "train")
                .select(F.col("user_idx").alias("user_id"), (F.col("item_idx") + n_users).alias("item_id"),
                        "rating", "date"))

    def graph(self) -> DataFrame:
        """Training graph in both directions: (src, dst)."""
        return graph.both_directions(graph.ui_edges(self.train_edges(), RATING_THRESHOLD).select("src", "dst"))

    def start_vectors(self, dim: int = DIM, seed: int = SEED) -> DataFrame:
        n_users, n_items = self.sizes()
        nodes = self.user_ids.select(F.col("user_idx").alias("node")).unionByName(
            self.item_ids.select((F.col("item_idx") + n_users).alias("node")))
        return graph.initial_vectors(nodes, dim, n_users + n_items, seed)

    def vectors(self) -> DataFrame:
        """Node vectors after propagation, written once per application."""
        key = (self.folder, "vectors")
        if key not in _WRITTEN:
            with TemporaryTables(self.spark) as tables:
                found = materialize(graph.lightgcn(self.start_vectors(), self.graph(), DIM, LAYERS, n_nodes=sum(self.sizes())), "vectors")
                tables.keep(found)
            _WRITTEN[key] = found
        return _WRITTEN[key]


_WRITTEN: dict = {}


def prepare(spark: SparkSession, sf: str, folder: str) -> None:
    """The preparation job: clean, encode and split the reviews; write edges, ids, items and sizes."""
    edges, user_ids, item_ids = encode.preprocess(
        reviews(spark, sf), users(spark, sf), businesses(spark, sf), RATING_THRESHOLD,
        # keys are in the order of their ids, so the stored pairs can be split before ids are joined to them
        label=lambda pairs: split.temporal_split(pairs, ["user_id", "item_id"], stored=True))
    # a reader of one part of the split prunes the others
    edge_files.write_table(edges, f"{folder}/edges", partition_by=("split",))
    edge_files.write_table(user_ids, f"{folder}/users")
    edge_files.write_table(item_ids, f"{folder}/item_ids")
    edge_files.write_table(edge_files.item_catalogue(businesses(spark, sf), item_ids), f"{folder}/items")
    stored = spark.read.schema(edge_files.EDGE_SCHEMA).parquet(f"{folder}/edges")
    edge_files.write_meta(edge_files.meta_row(stored, "full", {}), f"{folder}/meta")


def prepared(spark: SparkSession, sf: str) -> Prepared:
    """Prepared data of a folder; the job runs once per application, as training reads what
    preprocessing wrote."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WRITTEN:
        folder = fresh_path(spark, "prepared")
        prepare(spark, sf, folder)
        _WRITTEN[key] = Prepared(spark, folder)
    return _WRITTEN[key]


# ---------------------------------------------------------------- articles

def article_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as article records before they are sent, with their topic and position."""
    docs = table(spark, sf, "documents")
    pub = F.col("lang").isin("en", "fr")
    number = F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(number, F.lit(1000)).cast("int")),
                        "yyyy-MM-dd")
    names = F.transform(F.sequence(F.lit(1).cast("long"), F.pmod(number, F.lit(4))),
                        lambda i: F.concat(F.lit("Author "), i.cast("string")))
    return docs.select(
        number.alias("doc_id"), pub.alias("is_pubmed"),
        F.when(pub, PUBMED_TOPIC).otherwise(ARXIV_TOPIC).alias("topic"),
        F.when(pub, "pubmed").otherwise("arxiv").alias("source"),
        F.when(F.col("source") == "src3", "  ")
         .otherwise(F.concat(F.lit("  Report on "), F.col("source"), F.lit(" No. "), number.cast("string"), F.lit(" ")))
         .alias("title"),
        F.concat(F.lit(" "), F.col("text")).alias("abstract"),
        F.when(F.pmod(number, F.lit(4)) != 0, names).alias("authors"),
        F.when(F.col("lang") == "es", "").when(F.col("lang") == "de", F.concat(day, F.lit("T12:30:00")))
         .otherwise(day).alias("published_at"),
        F.concat(F.lit("id"), (number - F.pmod(number, F.lit(2))).cast("string")).alias("article_id"),
        F.timestamp_seconds(F.lit(1704067200) + number * 3600).alias("sent_at"))


def kafka_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON messages in the shape of a Kafka source.

    Documents labelled low quality arrive as bare text, and source src0 on a topic nobody knows.
    """
    bad = table(spark, sf, "labels").filter(F.col("quality") == 0).select("doc_id", F.lit(True).alias("bad"))
    lost = table(spark, sf, "documents").filter(F.col("source") == "src0").select(
        "doc_id", F.lit(True).alias("lost"))
    body = F.to_json(F.struct(
        "source", F.when(F.col("is_pubmed"), F.col("article_id")).alias("pmid"),
        F.when(~F.col("is_pubmed"), F.col("article_id")).alias("arxiv_id"), "title", "abstract", "authors",
        "published_at", F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss").alias("ingested_at")))
    rows = article_fields(spark, sf).join(bad, "doc_id", "left").join(lost, "doc_id", "left")
    return rows.select(
        F.when(F.col("lost"), "other-articles").otherwise(F.col("topic")).alias("topic"),
        F.pmod("doc_id", F.lit(4)).cast("int").alias("partition"), F.col("doc_id").alias("offset"),
        F.col("sent_at").alias("timestamp"),
        F.when(F.col("bad"), F.col("abstract")).otherwise(body).cast("binary").alias("value"))


# ---------------------------------------------------------------- runs

MODELS = ("gat", "lightgcn", "sage")
SIZE_TAGS = ("1k", "10k", "100k", "full")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as run records: one run per event."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    model = F.when(F.col("event_type") == "click", "gat").when(F.col("event_type") == "view", "sage") \
             .otherwise("lightgcn")
    workers = F.pmod("user_id", F.lit(4)) + 1
    size = pick(SIZE_TAGS, F.pmod(F.floor(F.col("user_id") / 4), F.lit(4)))
    return e.select(
        F.col("event_id").alias("run"), model.alias("model"), workers.alias("n_workers"), size.alias("size_tag"),
        "ts", (k / 10.0).alias("t_load"), (k / 100.0).alias("t_graph"), F.col("value").alias("t_train"),
        (F.col("value") / 50.0).alias("t_eval"), (F.pmod(k, F.lit(20)) / 1000.0).alias("ndcg"), k.alias("k_prop"))


def run_name() -> Column:
    return F.concat("model", F.lit("_w"), F.col("n_workers").cast("string"), F.lit("_"), F.col("size_tag"))
