"""Scans, sinks, cleaning and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N, text, terms
from ..functions.hashing import xavier_bound
from ..operators import clean, encode, graph, subset
from ..session import fresh_path
from ..sources import edges as edge_files, reviews as review_files
from . import domain as D, sqltext as S
from .registry import query


def _day(c="date"):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


# ---------------------------------------------------------------- scans and sinks

@query("csv_business_scan", "S1 S18", f"""WITH {S.ITEMS} SELECT CAST(item_id AS VARCHAR) AS business_id, name, categories FROM items""")
def csv_business_scan(spark, sf):
    path = fresh_path(spark, "csv")
    review_files.write_csv(D.businesses(spark, sf).withColumnRenamed("item_id", "business_id"), path)
    return review_files.read_businesses(spark, path)


@query("csv_review_scan", "S2 S5", """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS review_id,
  CAST(l_partkey AS VARCHAR) AS business_id,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(floor(l_quantity/10) AS INTEGER) END AS rating,
  strftime(l_shipdate, '%Y-%m-%d') AS date FROM lineitem""")
def csv_review_scan(spark, sf):
    path = fresh_path(spark, "csv")
    lines = D.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("review_id"),
        F.col("l_partkey").alias("business_id"),
        F.when(F.col("l_returnflag") == "R", "n/a").otherwise((F.col("l_quantity") / 10).cast("string")).alias("stars"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_tax").alias("ignored"))
    review_files.write_csv(lines, path)
    return review_files.read_reviews(spark, path)


@query("csv_user_scan", "S3", """SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name FROM customer""")
def csv_user_scan(spark, sf):
    path = fresh_path(spark, "csv")
    review_files.write_csv(D.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), "c_acctbal"), path)
    return review_files.read_users(spark, path)


@query("numeric_coercion", "S5", """SELECT doc_id, TRY_CAST(CASE WHEN lang = 'en' THEN CAST(n_chars/8.0::DOUBLE AS VARCHAR) ELSE source END AS DOUBLE) AS amount
  FROM documents""")
def numeric_coercion(spark, sf):
    mixed = D.table(spark, sf, "documents").select("doc_id", F.when(
        F.col("lang") == "en", (F.col("n_chars") / 8.0).cast("string")).otherwise(F.col("source")).alias("amount"))
    return review_files.coerce_numbers(mixed, ("amount",))


@query("capped_load", "S4 T4", f"""WITH {S.REVIEWS},
r AS (SELECT * FROM reviews ORDER BY date, review_id LIMIT 20000)
SELECT (SELECT count(*) FROM part) AS n_businesses, (SELECT count(*) FROM customer) AS n_users, count(*) AS n_reviews,
  strftime(max(date), '%Y-%m-%d') AS last_day, max(review_id) AS last_review FROM r""")
def capped_load(spark, sf):
    root = fresh_path(spark, "csv")
    b, u, r = f"{root}/b", f"{root}/u", f"{root}/r"
    review_files.write_csv(D.businesses(spark, sf).withColumnRenamed("item_id", "business_id"), b)
    review_files.write_csv(D.users(spark, sf), u)
    review_files.write_csv(D.reviews(spark, sf).withColumnsRenamed({"item_id": "business_id", "rating": "stars"}), r)
    businesses, users, reviews = review_files.load_tables(spark, b, u, r, max_reviews=20_000)
    n = lambda df: df.select(F.count(F.lit(1))).scalar()
    return reviews.agg(F.count(F.lit(1)).alias("n_reviews"), F.max("date").alias("last_day"),
                       F.max("review_id").alias("last_review")).select(
        n(businesses).alias("n_businesses"), n(users).alias("n_users"), "n_reviews", "last_day", "last_review")


@query("prepared_read", "S6 S7 J3 P10", f"""WITH {S.PREPARED}
SELECT e.user_idx, e.item_idx, e.item_idx + nu AS item_node, e.rating, strftime(e.date, '%Y-%m-%d') AS date, e.split,
  CAST(i.item_id AS VARCHAR) AS business_id, p.categories, nu AS n_users, ni AS n_items
FROM edges e JOIN item_ids i USING (item_idx) JOIN items p USING (item_id), size""")
def prepared_read(spark, sf):
    edges, items, sizes = edge_files.load_prepared(spark, D.prepared(spark, sf).folder)
    one = sizes.select
    return edges.join(items, "item_idx").select(
        "user_idx", "item_idx", (F.col("item_idx") + one("n_users").scalar()).alias("item_node"), "rating",
        _day(), "split", "business_id", "categories", one("n_users").scalar().alias("n_users"),
        one("n_items").scalar().alias("n_items"))


@query("prepared_meta", "S8", f"""WITH {S.PREPARED}
SELECT 'full' AS size_tag, nu AS n_users, ni AS n_items, count(*) AS n_edges,
  count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val,
  count(*) FILTER (WHERE split = 'test') AS n_test FROM edges, size GROUP BY nu, ni""")
def prepared_meta(spark, sf):
    meta = edge_files.read_meta(spark, f"{D.prepared(spark, sf).folder}/meta")
    return meta.select("size_tag", "n_users", "n_items", "n_edges",
                       *[F.col("split_counts")[s].alias(f"n_{s}") for s in ("train", "val", "test")])


@query("csv_to_parquet", "S17 S18 T3", f"""WITH {S.REVIEWS}, {S.USERS}, {S.ITEMS},
sizes(size_tag, lim) AS (VALUES ('1k',1000),('5k',5000),('10k',10000),('50k',50000),('100k',100000),('full',1000000000000)),
ordered AS (SELECT *, row_number() OVER (ORDER BY date, review_id) AS rn FROM reviews)
SELECT size_tag, count(*) AS n_reviews, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_businesses
FROM ordered, sizes WHERE rn <= lim GROUP BY size_tag""")
def csv_to_parquet(spark, sf):
    root = fresh_path(spark, "sizes")
    tags = list(subset.SIZES)
    datasets = subset.sized_datasets(D.reviews(spark, sf), D.users(spark, sf), D.businesses(spark, sf))
    for tag, (r, u, b) in datasets.items():
        review_files.write_dataset(b, u, r, f"{root}/csv/{tag}")
    folders = review_files.csv_to_parquet(spark, f"{root}/csv", f"{root}/parquet", tags)
    out = None
    for tag, folder in folders.items():
        n = lambda name: spark.read.parquet(f"{folder}/{name}").select(F.count(F.lit(1))).scalar()
        row = spark.read.parquet(f"{folder}/review").agg(F.count(F.lit(1)).alias("n_reviews")).select(
            F.lit(tag).alias("size_tag"), "n_reviews", n("user").alias("n_users"), n("business").alias("n_businesses"))
        out = row if out is None else out.unionByName(row)
    return out


@query("catalogue_load", "S19", """SELECT trim(CAST(p_partkey AS VARCHAR)) AS business_id, CAST(p_partkey AS VARCHAR)||' ' AS name,
  p_type AS categories FROM part""")
def catalogue_load(spark, sf):
    raw = D.table(spark, sf, "part").select(
        F.concat(F.col("p_partkey").cast("string"), F.lit(" ")).alias(" Business_ID"),
        F.col("p_type").alias("Categories "), "p_size")
    return review_files.catalogue(raw)


# ---------------------------------------------------------------- filters

PART_WORDS = ("economy", "promo")


@query("domain_filter", "P1 F1", f"""WITH {S.ITEMS} SELECT item_id, name, categories FROM items
WHERE categories IS NOT NULL AND (contains(lower(categories), 'economy') OR contains(lower(categories), 'promo'))""")
def domain_filter(spark, sf):
    return clean.domain_filter(D.businesses(spark, sf), PART_WORDS)


@query("rating_threshold", "P2 G1", f"""WITH {S.REVIEWS} SELECT user_id AS src, item_id AS dst, rating FROM reviews WHERE rating >= 4""")
def rating_threshold(spark, sf):
    return graph.ui_edges(D.reviews(spark, sf), 4)


@query("null_keys_dropped", "P3", """SELECT event_type, count(*) AS n FROM events
WHERE event_type <> 'error' GROUP BY event_type""")
def null_keys_dropped(spark, sf):
    holes = D.table(spark, sf, "events").select(
        F.col("user_id"), F.col("event_id").alias("item_id"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("rating"), "event_type")
    return clean.drop_null_keys(holes).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("category_search", "P4", f"""WITH {S.ITEMS} SELECT item_id, categories FROM items WHERE contains(lower(categories), 'brand#1')""")
def category_search(spark, sf):
    return clean.category_contains(D.businesses(spark, sf), "BRAND#1").select("item_id", "categories")


@query("category_keywords", "P5 F4 U7", f"""WITH {S.ITEMS},
c AS (SELECT DISTINCT trim(unnest(string_split(categories, ',')), ' ') AS category FROM items)
SELECT category, (contains(lower(category), 'brand#1') OR contains(lower(category), 'eco') OR contains(lower(category), 'medi'))
  AND lower(category) NOT IN ('brand#11', 'brand#12') AS wanted FROM c WHERE category <> '' AND category <> 'N/A'""")
def category_keywords(spark, sf):
    names = clean.distinct_categories(D.businesses(spark, sf))
    return names.withColumn("wanted", clean.is_medical(
        "category", ("brand#1", "eco", "medi"), ("brand#11", "brand#12")))


def _any_of(column: str, words) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, w.replace("'", "''")) for w in words) + ")"


_EXCLUDED = ", ".join("'{}'".format(w.replace("'", "''")) for w in terms.NOT_MEDICAL)


@query("medical_words", "P5", f"""WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS category FROM documents)
SELECT category FROM w WHERE category <> '' AND {_any_of('lower(category)', terms.MEDICAL_FRAGMENTS)} AND lower(category) NOT IN ({_EXCLUDED})""")
def medical_words(spark, sf):
    """All words of the documents that the built-in lists call medical."""
    words = D.table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("category")).filter("category <> ''").distinct()
    return words.filter(clean.is_medical("category"))


@query("source_routing", "P12 P8 P9", f"""WITH {S.ARTICLES}
SELECT doc_id, CASE WHEN lost THEN NULL ELSE source END AS tag FROM articles WHERE NOT bad""")
def source_routing(spark, sf):
    from ..streaming.articles import enrich_articles, unified_articles
    rows = enrich_articles(unified_articles(D.kafka_records(spark, sf)))
    routed = F.when(F.col("kafka_topic") == "other-articles", F.lit(None)).otherwise(F.col("tag"))
    return rows.filter(F.col("title").isNotNull()).select(F.col("offset").alias("doc_id"), routed.alias("tag"))


# ---------------------------------------------------------------- joins

@query("reviews_of_domain", "J1 P2 P3", f"""WITH {S.REVIEWS}, {S.ITEMS}
SELECT review_id, user_id, item_id, rating, strftime(date, '%Y-%m-%d') AS date FROM reviews
WHERE rating >= 3 AND item_id IN (SELECT item_id FROM items WHERE contains(lower(categories), 'economy') OR contains(lower(categories), 'promo'))""")
def reviews_of_domain(spark, sf):
    kept = clean.join_and_clean(D.reviews(spark, sf), clean.domain_filter(D.businesses(spark, sf), PART_WORDS))
    return kept.select("review_id", "user_id", "item_id", "rating", _day())


@query("known_users_and_items", "J2 P6", f"""WITH {S.REVIEWS}
SELECT rating, count(*) AS n FROM reviews WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
  AND item_id IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY rating""")
def known_users_and_items(spark, sf):
    solvent = D.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    small = D.table(spark, sf, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("item_id"))
    kept = clean.known_only(clean.known_only(D.reviews(spark, sf), solvent, "user_id"), small, "item_id")
    return kept.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


@query("referenced_entities", "J4", f"""WITH {S.HISTORY}
SELECT 'user' AS kind, c_custkey AS id FROM customer WHERE c_custkey IN (SELECT user_id FROM past)
UNION ALL SELECT 'item', p_partkey FROM part WHERE p_partkey IN (SELECT item_id FROM past)""")
def referenced_entities(spark, sf):
    late = D.history(spark, sf)
    users = clean.referenced_by(D.users(spark, sf), late, "user_id")
    items = clean.referenced_by(D.businesses(spark, sf), late, "item_id")
    return users.select(F.lit("user").alias("kind"), F.col("user_id").alias("id")).unionByName(
        items.select(F.lit("item").alias("kind"), F.col("item_id").alias("id")))


@query("unseen_entities", "J5", f"""WITH {S.HISTORY} SELECT DISTINCT user_id FROM batch WHERE user_id NOT IN (SELECT user_id FROM past)""")
def unseen_entities(spark, sf):
    old, late = D.history(spark, sf), D.batch(spark, sf)
    return clean.unknown_only(clean.keys_of(late, "user_id"), clean.keys_of(old, "user_id"), "user_id")


@query("catalogue_in_id_order", "J8", f"""WITH {S.PREPARED} SELECT item_idx, item_id, name, categories FROM item_ids JOIN items USING (item_id)""")
def catalogue_in_id_order(spark, sf):
    return (D.businesses(spark, sf).join(D.prepared(spark, sf).item_ids, "item_id")
            .select("item_idx", "item_id", "name", "categories").orderBy("item_idx"))


# ---------------------------------------------------------------- set operations and windows

@query("edges_both_ways", "U1", f"""WITH {S.GRAPH} SELECT src, dst, count(*) AS n FROM graph GROUP BY src, dst""")
def edges_both_ways(spark, sf):
    return D.prepared(spark, sf).graph().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("appended_entities", "U2", """SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, CAST(NULL AS DOUBLE) AS price FROM customer
UNION ALL SELECT 'part', p_partkey, p_name, p_retailprice FROM part""")
def appended_entities(spark, sf):
    a = D.table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"),
                                              F.col("c_name").alias("name"))
    b = D.table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"),
                                          F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return subset.append_entities(a, b)


@query("last_review_per_pair", "W2", f"""WITH {S.REVIEWS}
SELECT user_id, item_id, rating, strftime(date, '%Y-%m-%d') AS date, review_id FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id, item_id ORDER BY date DESC, review_id DESC) AS rn FROM reviews) WHERE rn = 1""")
def last_review_per_pair(spark, sf):
    last = clean.latest_row(D.reviews(spark, sf), ["user_id", "item_id"],
                            [F.col("date").desc_nulls_last(), F.col("review_id").desc()])
    return last.select("user_id", "item_id", "rating", _day(), "review_id")


@query("first_per_user", "W3", f"""WITH {S.REVIEWS}
SELECT user_id, item_id, rating, review_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, review_id DESC) AS rn
  FROM reviews) WHERE rn = 1""")
def first_per_user(spark, sf):
    return subset.first_per_user(D.reviews(spark, sf)).select("user_id", "item_id", "rating", "review_id")


@query("first_id_per_batch", "W10", f"""WITH {S.ARTICLES} SELECT article_id, min(doc_id) AS doc_id FROM articles WHERE NOT is_pubmed GROUP BY article_id""")
def first_id_per_batch(spark, sf):
    arxiv = D.article_fields(spark, sf).filter(~F.col("is_pubmed"))
    return clean.latest_row(arxiv, ["article_id"], [F.col("doc_id").asc()]).select("article_id", "doc_id")


# ---------------------------------------------------------------- scalar functions

@query("text_functions", "F1 F2 F3 F5 F11 F12 F13 F24", """SELECT page_id, md5(lower(url)) AS url_lower,
  md5(trim(regexp_replace(html, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')) AS squeezed, md5(substring(html, 1, 2000)) AS cut,
  trim(string_split(html, ',')[1], ' ') = '' AS first_empty, html <> '' AS has_html, length(html) AS n_chars,
  contains(lower(html), 'medical') OR contains(lower(html), 'health') AS in_domain,
  len(string_split(html, ',')) AS n_parts FROM pages""")
def text_functions(spark, sf):
    p = D.table(spark, sf, "pages")
    return p.select(
        "page_id", F.md5(F.lower("url")).alias("url_lower"), F.md5(text.squeeze("html")).alias("squeezed"),
        F.md5(text.truncate("html", 2000)).alias("cut"), (text.first_entry("html") == "").alias("first_empty"),
        text.has_text("html").alias("has_html"), F.length("html").cast("long").alias("n_chars"),
        text.contains_any("html", ("health", "medical")).alias("in_domain"),
        text.array_count(text.split_list("html")).cast("long").alias("n_parts"))


@query("date_functions", "F6 F7 F8 F9 F14", f"""SELECT doc_id,
  CAST(2000+doc_id%20 AS VARCHAR)||'-'||lpad(CAST(doc_id%12+1 AS VARCHAR),2,'0')||'-'||CASE WHEN doc_id%3=0 THEN '01' ELSE lpad(CAST(doc_id%28+1 AS VARCHAR),2,'0') END AS padded,
  CASE lang WHEN 'es' THEN NULL WHEN 'de' THEN epoch(DATE '2020-01-01'+CAST(doc_id%1000 AS INTEGER))+45000 ELSE epoch(DATE '2020-01-01'+CAST(doc_id%1000 AS INTEGER)) END::BIGINT AS published_seconds,
  CASE lang WHEN 'es' THEN 365 ELSE CAST(DATE '2026-01-01'-(DATE '2020-01-01'+CAST(doc_id%1000 AS INTEGER)) AS INTEGER) END AS age_days,
  strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * doc_id, '%Y.%m') AS month FROM documents""")
def date_functions(spark, sf):
    a = D.article_fields(spark, sf)
    n = F.col("doc_id")
    day_text = F.when(F.pmod(n, F.lit(3)) != 0, (F.pmod(n, F.lit(28)) + 1).cast("string"))
    published = text.parse_published("published_at")
    return a.select(
        "doc_id", text.padded_date((F.pmod(n, F.lit(20)) + 2000).cast("string"),
                                   (F.pmod(n, F.lit(12)) + 1).cast("string"), day_text).alias("padded"),
        F.unix_timestamp(published).alias("published_seconds"),
        N.days_since(published, F.lit("2026-01-01").cast("date")).alias("age_days"),
        F.date_format("sent_at", "yyyy.MM").alias("month"))


@query("score_functions", "F10 F15 F16 F19", f"""SELECT event_id, {S.r6('1.0::DOUBLE/(1.0::DOUBLE+exp(-v))')} AS sigmoid,
  {S.r6('4.0::DOUBLE/(1.0::DOUBLE+exp(-v))+1.0::DOUBLE')} AS rating, 1.0::DOUBLE/(1.0::DOUBLE+exp(-v)) >= 0.5 AS positive,
  {S.r6('least(v,0.0::DOUBLE)-ln(1.0::DOUBLE+exp(-abs(v)))')} AS log_sigmoid,
  {S.r6('0.4::DOUBLE*v+0.3::DOUBLE*(v/2)+0.3::DOUBLE*(v/4)')} AS composite,
  {S.r6("((1+user_id%5)-1.0::DOUBLE)/4.0::DOUBLE*exp(-CAST(DATE '2024-03-01'-CAST(ts AS DATE) AS DOUBLE)/365.0::DOUBLE)")} AS weight,
  {S.r6('(1+user_id%5)/5.0::DOUBLE')} AS plain_weight
  FROM (SELECT *, (value-25.0::DOUBLE)/10.0::DOUBLE AS v FROM events)""")
def score_functions(spark, sf):
    e = D.table(spark, sf, "events").withColumn("v", (F.col("value") - 25.0) / 10.0) \
        .withColumn("r", F.pmod("user_id", F.lit(5)) + 1)
    as_of = F.lit("2024-03-01").cast("date")
    return e.select(
        "event_id", N.r6(N.sigmoid("v")).alias("sigmoid"), N.r6(N.rating_from_score("v")).alias("rating"),
        (N.sigmoid("v") >= 0.5).alias("positive"), N.r6(N.log_sigmoid("v")).alias("log_sigmoid"),
        N.r6(N.composite("v", F.col("v") / 2, F.col("v") / 4)).alias("composite"),
        N.r6(N.temporal_weight("r", "ts", as_of)).alias("weight"),
        N.r6(N.temporal_weight("r", None, None)).alias("plain_weight"))


@query("vector_functions", "F17 F27", f"""SELECT vec_id, {S.r6('list_inner_product(v, v)')} AS dot, {S.r6('sqrt(list_inner_product(v, v))')} AS norm,
  {S.r6('(v[1]/sqrt(list_inner_product(v, v)))')} AS unit_first, {S.r6('list_sum(v[1:8])')} AS head_sum
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def vector_functions(spark, sf):
    from ..functions import vectors as V
    e = D.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", N.r6(V.dot("v", "v")).alias("dot"), N.r6(V.l2_norm("v")).alias("norm"),
                    N.r6(V.unit("v")[0]).alias("unit_first"),
                    N.r6(F.aggregate(F.slice("v", 1, 8), F.lit(0.0), lambda a, x: a + x)).alias("head_sum"))


_XAVIER = xavier_bound(64, 16)
_PROJECTED = ", ".join(S.r6(f"sum(CASE WHEN r = {i} THEN w*x END)") + f" AS p{i}" for i in range(16))


@query("linear_projection", "F28", f"""WITH m AS (SELECT r, c, ({S.u(D.SEED, 'r', 'c')}*2.0::DOUBLE-1.0::DOUBLE)*{_XAVIER!r}::DOUBLE AS w FROM range(16) a(r), range(64) b(c)),
e AS (SELECT vec_id, unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT vec_id, {_PROJECTED} FROM e JOIN m ON c = d GROUP BY vec_id""")
def linear_projection(spark, sf):
    e = D.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return graph.project(e, 16, D.SEED, 64).select("vec_id", *[N.r6(F.col("v")[i]).alias(f"p{i}") for i in range(16)])


@query("content_cache_key", "F24", f"""WITH {S.PREPARED},
blocks AS (SELECT item_idx//4096 AS b, md5(string_agg(CAST(item_id AS VARCHAR), '' ORDER BY item_idx)) AS t FROM item_ids GROUP BY item_idx//4096),
root AS (SELECT CASE WHEN count(*) = 1 THEN any_value(t) ELSE md5(string_agg(t, '' ORDER BY b)) END AS t FROM blocks)
SELECT md5(t||'words') AS cache_key FROM root""")
def content_cache_key(spark, sf):
    from ..operators.stats import content_key
    return content_key(D.prepared(spark, sf).item_ids, "item_idx", "item_id", "words")


@query("display_labels", "F5 J7", f"""WITH {S.ITEMS} SELECT item_id, name||'  —  '||trim(string_split(categories, ',')[1], ' ') AS label FROM items""")
def display_labels(spark, sf):
    return D.businesses(spark, sf).select("item_id", text.display_label("name", "categories").alias("label"))
