"""Ids, splits, samples and dataset statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import clean, encode, split, stats, subset
from ..operators.ordering import with_row_index
from ..session import materialize
from . import domain as D, sqltext as S
from .registry import query

# ---------------------------------------------------------------- ids

@query("frequency_ids", "E1", f"""WITH {S.REVIEWS} SELECT item_id, n_rows, row_number() OVER (ORDER BY n_rows DESC, item_id)-1 AS item_idx
FROM (SELECT item_id, count(*) AS n_rows FROM reviews GROUP BY item_id)""")
def frequency_ids(spark, sf):
    return encode.frequency_ids(D.reviews(spark, sf), "item_id", "item_idx")


@query("alphabetical_ids", "E2", f"""SELECT name, row_number() OVER (ORDER BY name)-1 AS name_idx FROM (SELECT DISTINCT c_name AS name FROM customer)""")
def alphabetical_ids(spark, sf):
    return encode.dense_ids(D.users(spark, sf), "name", "name_idx")


OLD_NEW = f"""{S.HISTORY},
old_ids AS (SELECT item_id, row_number() OVER (ORDER BY item_id)-1 AS item_idx FROM (SELECT DISTINCT item_id FROM past)),
fresh AS (SELECT DISTINCT item_id FROM batch WHERE item_id NOT IN (SELECT item_id FROM old_ids)),
all_ids AS (SELECT * FROM old_ids UNION ALL SELECT item_id, row_number() OVER (ORDER BY item_id)-1+(SELECT count(*) FROM old_ids) FROM fresh)"""


@query("extended_ids", "E3 I1", f"WITH {OLD_NEW} SELECT item_id, item_idx FROM all_ids")
def extended_ids(spark, sf):
    old = materialize(encode.dense_ids(D.history(spark, sf), "item_id", "item_idx"), "old_ids")
    return encode.extend_ids(old, D.batch(spark, sf), "item_id", "item_idx")


@query("encoded_known_rows", "E4", f"WITH {OLD_NEW} SELECT review_id, item_idx FROM reviews JOIN old_ids USING (item_id)")
def encoded_known_rows(spark, sf):
    old = encode.dense_ids(D.history(spark, sf), "item_id", "item_idx")
    return encode.transform_ids(D.reviews(spark, sf), old, "item_id", "item_idx", "skip").select("review_id", "item_idx")


@query("lenient_encoding", "E7", f"""WITH {OLD_NEW},
old_users AS (SELECT user_id, row_number() OVER (ORDER BY user_id)-1 AS user_idx FROM (SELECT DISTINCT user_id FROM past))
SELECT review_id, coalesce(user_idx, 0) AS user_idx, item_idx FROM reviews JOIN old_ids USING (item_id) LEFT JOIN old_users USING (user_id)""")
def lenient_encoding(spark, sf):
    past = D.history(spark, sf)
    return encode.lenient_encode(D.reviews(spark, sf), encode.dense_ids(past, "user_id", "user_idx"),
                                 encode.dense_ids(past, "item_id", "item_idx")).select("review_id", "user_idx", "item_idx")


@query("preprocessed_edges", "E5 W1", f"""WITH {S.PREPARED} SELECT user_idx, item_idx, rating, strftime(date, '%Y-%m-%d') AS date, review_id, split FROM edges""")
def preprocessed_edges(spark, sf):
    edges, _, _ = encode.preprocess(D.reviews(spark, sf), D.users(spark, sf), D.businesses(spark, sf),
                                    D.RATING_THRESHOLD)
    done = split.temporal_split(materialize(edges, "edges"), ["user_idx", "item_idx"])
    return done.select("user_idx", "item_idx", "rating", F.date_format("date", "yyyy-MM-dd").alias("date"),
                       "review_id", "split")


@query("split_parts", "E6", f"""WITH {S.PREPARED} SELECT split AS part, user_idx AS user_id, item_idx + nu AS item_id, rating FROM edges, size""")
def split_parts(spark, sf):
    p = D.prepared(spark, sf)
    out = None
    for part in ("train", "val", "test"):
        rows = split.part_of(p.edges, part, p.user_ids).select(F.lit(part).alias("part"), "user_id", "item_id", "rating")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------- splits and samples

@query("temporal_split", "W1 A1 A2", f"""WITH {S.REVIEWS},
o AS (SELECT *, row_number() OVER (ORDER BY date, user_id, item_id, review_id) AS rn, count(*) OVER () AS n FROM reviews),
s AS (SELECT *, CASE WHEN rn <= floor(n*0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n*(0.7::DOUBLE+0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM o)
SELECT split, count(*) AS n, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items,
  strftime(min(date), '%Y-%m-%d') AS first_day, strftime(max(date), '%Y-%m-%d') AS last_day,
  sum(CAST(('0x'||substr(md5(review_id),1,6)) AS BIGINT))::BIGINT AS checksum FROM s GROUP BY split""")
def temporal_split(spark, sf):
    done = split.temporal_split(D.reviews(spark, sf), ["user_id", "item_id", "review_id"])
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return done.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("item_id").alias("n_items"), day(F.min("date")).alias("first_day"),
        day(F.max("date")).alias("last_day"),
        F.sum(F.conv(F.substring(F.md5("review_id"), 1, 6), 16, 10).cast("long")).alias("checksum"))


@query("random_split", "T6", f"""WITH {S.REVIEWS},
o AS (SELECT review_id, row_number() OVER (ORDER BY {S.h(1, 'review_id')}, review_id) AS rn, count(*) OVER () AS n FROM reviews)
SELECT review_id, CASE WHEN rn <= n-ceil(n*0.3::DOUBLE) THEN 'train' WHEN rn <= n-ceil(ceil(n*0.3::DOUBLE)*0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM o""")
def random_split(spark, sf):
    return split.random_split(D.reviews(spark, sf).select("review_id"), ["review_id"])


@query("supervision_split", "G12", f"""WITH {S.GRAPH},
o AS (SELECT user_id, item_id, row_number() OVER (ORDER BY {S.h(7, 'user_id', 'item_id')}, user_id, item_id) AS rn, count(*) OVER () AS n FROM train)
SELECT user_id, item_id, CASE WHEN rn <= floor(n*0.8::DOUBLE) THEN 'message' ELSE 'supervision' END AS role FROM o""")
def supervision_split(spark, sf):
    train = D.prepared(spark, sf).train_edges().select("user_id", "item_id")
    return split.supervision_split(train, ["user_id", "item_id"], stored=True)


@query("sized_subsets", "T3 J4", f"""WITH {S.REVIEWS},
o AS (SELECT *, row_number() OVER (ORDER BY date, review_id) AS rn FROM reviews),
sizes(size_tag, lim) AS (VALUES ('1k',1000),('5k',5000),('10k',10000),('50k',50000),('100k',100000),('full',1000000000000))
SELECT size_tag, count(*) AS n_reviews, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items,
  strftime(max(date), '%Y-%m-%d') AS last_day FROM o, sizes WHERE rn <= lim GROUP BY size_tag""")
def sized_subsets(spark, sf):
    out = None
    datasets = subset.sized_datasets(D.reviews(spark, sf), D.users(spark, sf), D.businesses(spark, sf))
    for tag, (part, users, items) in datasets.items():
        count = lambda df: df.select(F.count(F.lit(1))).scalar()
        row = part.agg(F.count(F.lit(1)).alias("n_reviews"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_day")) \
            .select(F.lit(tag).alias("size_tag"), "n_reviews", count(users).alias("n_users"),
                    count(items).alias("n_items"), "last_day")
        out = row if out is None else out.unionByName(row)
    return out


@query("stratified_sample", "T5", f"""WITH {S.REVIEWS},
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, review_id DESC) = 1 AS first_one FROM reviews),
o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN first_one THEN 0 ELSE {S.h(42, 'review_id')}+4294967296 END, user_id, review_id) AS rn FROM f)
SELECT review_id, user_id, item_id FROM o WHERE rn <= (SELECT count(*)//4 FROM reviews)""")
def stratified_sample(spark, sf):
    reviews = D.reviews(spark, sf)
    n = D.table(spark, sf, "lineitem").count() // 4
    return subset.stratified_sample(reviews, n).select("review_id", "user_id", "item_id")


@query("seeded_shuffle", "T7", f"""WITH {S.REVIEWS} SELECT review_id, row_number() OVER (ORDER BY {S.h(42, 'review_id')}, review_id)-1 AS position FROM reviews""")
def seeded_shuffle(spark, sf):
    from ..functions.hashing import hash32
    hashed = D.reviews(spark, sf).select("review_id", hash32(42, "review_id").alias("h"))
    return with_row_index(hashed, ["h", "review_id"], "position").select("review_id", "position")


@query("sample_without_replacement", "T8", f"""WITH {S.REVIEWS} SELECT review_id FROM reviews
ORDER BY {S.h(42, 'review_id')}, review_id LIMIT 15000""")
def sample_without_replacement(spark, sf):
    return split.sample_rows(D.reviews(spark, sf), ["review_id"], 15_000).select("review_id")


@query("validation_sample", "T9", f"""WITH {S.PREPARED}, t AS (SELECT * FROM edges WHERE split = 'train')
SELECT user_idx, item_idx FROM t ORDER BY {S.h(42, 'user_idx', 'item_idx')}, user_idx, item_idx
LIMIT (SELECT CAST(floor(count(*)*0.2::DOUBLE) AS BIGINT) FROM t)""")
def validation_sample(spark, sf):
    train = D.prepared(spark, sf).part("train").withColumnsRenamed({"user": "user_idx", "item": "item_idx"})
    n = split.validation_size(train.count())
    return split.sample_rows(train, ["user_idx", "item_idx"], n).select("user_idx", "item_idx")


# ---------------------------------------------------------------- statistics

@query("split_counts", "A1", f"WITH {S.PREPARED} SELECT split, count(*) AS n FROM edges GROUP BY split")
def split_counts(spark, sf):
    return stats.split_counts(D.prepared(spark, sf).edges)


@query("distinct_counts", "A2", f"WITH {S.REVIEWS} SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_edges FROM reviews")
def distinct_counts(spark, sf):
    return stats.distinct_counts(D.reviews(spark, sf))


@query("user_stats", "A3", f"WITH {S.REVIEWS} SELECT user_id, count(*) AS review_count, {S.even('avg(rating)', 2)} AS average_stars FROM reviews GROUP BY user_id")
def user_stats(spark, sf):
    return stats.user_stats(D.reviews(spark, sf))


@query("business_stats", "A4", f"WITH {S.REVIEWS} SELECT item_id, count(*) AS review_count, {S.even('avg(rating)', 1)} AS stars FROM reviews GROUP BY item_id")
def business_stats(spark, sf):
    return stats.business_stats(D.reviews(spark, sf))


@query("rating_distribution", "A5", f"WITH {S.REVIEWS} SELECT rating, count(*) AS n, {S.even('count(*)*100.0::DOUBLE/(SELECT count(*) FROM reviews)', 2)} AS pct FROM reviews GROUP BY rating")
def rating_distribution(spark, sf):
    return stats.rating_distribution(D.reviews(spark, sf))


@query("quality_report", "A14", f"""WITH {S.HISTORY},
u AS (SELECT count(*) AS n FROM reviews GROUP BY user_id), i AS (SELECT count(*) AS n FROM reviews GROUP BY item_id)
SELECT count(*) AS n_rows, (SELECT count(*) FROM u) AS n_users, (SELECT count(*) FROM i) AS n_items,
  {S.r6('1.0::DOUBLE-count(*)/CAST((SELECT count(*) FROM u)*(SELECT count(*) FROM i) AS DOUBLE)')} AS sparsity,
  {S.r6('(SELECT avg(n) FROM u)')} AS mean_per_user, (SELECT min(n) FROM u) AS min_per_user,
  {S.r6('(SELECT avg(n) FROM i)')} AS mean_per_item, (SELECT min(n) FROM i) AS min_per_item,
  {S.r6('avg(rating)')} AS rating_mean, {S.r6('stddev_samp(rating)')} AS rating_std,
  {S.r6('avg(CASE WHEN rating >= 4 THEN 1.0::DOUBLE ELSE 0.0 END)*100.0::DOUBLE')} AS pct_from_4,
  count(*) FILTER (WHERE user_id NOT IN (SELECT user_id FROM past)) AS new_user_rows,
  count(*) FILTER (WHERE item_id NOT IN (SELECT item_id FROM past)) AS new_item_rows FROM reviews""")
def quality_report(spark, sf):
    past = D.history(spark, sf)
    r = stats.quality_report(D.reviews(spark, sf), past, past)
    doubles = [f for f, t in r.dtypes if t == "double"]
    return r.select(*[N.r6(c).alias(c) if c in doubles else F.col(c) for c in r.columns])


@query("graph_summary", "A15", f"""WITH {S.PREPARED} SELECT nu AS n_users, ni AS n_items, count(*) AS n_edges, strftime(min(date), '%Y-%m-%d') AS first_day,
  strftime(max(date), '%Y-%m-%d') AS last_day, {S.r6('count(*)/CAST(nu*ni AS DOUBLE)')} AS density, {S.r6('count(*)/CAST(nu AS DOUBLE)')} AS per_user FROM edges, size GROUP BY nu, ni""")
def graph_summary(spark, sf):
    e = D.prepared(spark, sf).edges.withColumnsRenamed({"user_idx": "user_id", "item_idx": "item_id"})
    s = stats.graph_summary(e)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return s.select("n_users", "n_items", "n_edges", day("first_day"), day("last_day"),
                    N.r6("density").alias("density"), N.r6("per_user").alias("per_user"))


@query("reviews_per_entity", "A16", f"""WITH {S.REVIEWS}
SELECT 'user' AS kind, min(n) AS min_n, median(n) AS median_n, max(n) AS max_n FROM (SELECT count(*) AS n FROM reviews GROUP BY user_id)
UNION ALL SELECT 'item', min(n), median(n), max(n) FROM (SELECT count(*) AS n FROM reviews GROUP BY item_id)""")
def reviews_per_entity(spark, sf):
    reviews = D.reviews(spark, sf)
    kind = lambda name, key: stats.per_key_spread(reviews, key).select(F.lit(name).alias("kind"), "*")
    return kind("user", "user_id").unionByName(kind("item", "item_id"))


@query("most_active_users", "T2", f"""WITH {S.REVIEWS} SELECT user_id, count(*) AS n, {S.even('avg(rating)', 1)} AS mean_stars FROM reviews
GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10""")
def most_active_users(spark, sf):
    return stats.most_active(D.reviews(spark, sf))


@query("overlap_count", "U6", f"""WITH {S.HISTORY} SELECT count(*) AS n_common FROM (SELECT user_id FROM past INTERSECT SELECT user_id FROM batch)""")
def overlap_count(spark, sf):
    return stats.overlap_count(D.history(spark, sf), D.batch(spark, sf), "user_id")


@query("upload_profile", "A19", f"""WITH {S.HISTORY}
SELECT count(*) AS reviews, count(DISTINCT user_id) AS users,
  count(DISTINCT user_id) FILTER (WHERE user_id NOT IN (SELECT user_id FROM past)) AS new_users, count(DISTINCT item_id) AS items,
  count(DISTINCT item_id) FILTER (WHERE item_id NOT IN (SELECT item_id FROM past)) AS new_items FROM batch""")
def upload_profile(spark, sf):
    past = D.history(spark, sf)
    return stats.upload_profile(D.batch(spark, sf), past, past)
