"""Building blocks of the SQL counterparts (DuckDB dialect)."""

from __future__ import annotations

from .domain import AS_OF, BATCH_FROM, DIM, NEW_BRAND, NEW_SEGMENT, RATING_THRESHOLD, RELEVANT_FROM, SEED


def h(seed, *cols: str) -> str:
    return f"CAST(('0x'||substr(md5(concat_ws('|',{','.join(cols)},'{seed}')),1,8)) AS BIGINT)"


def h60(seed, *cols: str) -> str:
    return f"CAST(('0x'||substr(md5(concat_ws('|',{','.join(cols)},'{seed}')),1,15)) AS BIGINT)"


def u(seed, *cols: str) -> str:
    return f"({h(seed, *cols)}/4294967296.0::DOUBLE)"


def r6(x: str) -> str:
    return f"(floor(({x})*1e6+0.5::DOUBLE)/1e6)"


def r9(x: str) -> str:
    return f"(floor(({x})*1e9+0.5::DOUBLE)/1e9)"


def even(x: str, digits: int) -> str:
    scale = f"{10 ** digits}::DOUBLE"
    return f"(CAST(round_even(CAST(({x})*{scale} AS DOUBLE),0) AS DOUBLE)/{scale}+0.0::DOUBLE)"


USERS = "users AS (SELECT c_custkey AS user_id, c_name AS name FROM customer)"
ITEMS = ("items AS (SELECT p_partkey AS item_id, p_name AS name, "
         "concat_ws(', ', p_type, p_brand) AS categories FROM part)")
REVIEWS = """reviews AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS review_id,
  o_custkey AS user_id, l_partkey AS item_id, CAST(floor((l_quantity-1)/10)+1 AS INTEGER) AS rating,
  CAST(l_shipdate AS DATE) AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_LATE = (f"(date >= DATE '{BATCH_FROM}' OR user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = '{NEW_SEGMENT}') "
         f"OR item_id IN (SELECT p_partkey FROM part WHERE p_brand = '{NEW_BRAND}'))")
# past and batch: the two parts of reviews
HISTORY = f"""{REVIEWS}, past AS (SELECT * FROM reviews WHERE NOT {_LATE}), batch AS (SELECT * FROM reviews WHERE {_LATE})"""

# known users and items, rating threshold, last review per pair
PAIRS = f"""{REVIEWS}, {USERS}, {ITEMS},
kept AS (SELECT * FROM reviews WHERE user_id IN (SELECT user_id FROM users)
  AND item_id IN (SELECT item_id FROM items) AND rating >= {RATING_THRESHOLD}),
pairs AS (SELECT user_id, item_id, rating, date, review_id FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id, item_id ORDER BY date DESC, review_id DESC) AS rn FROM kept) WHERE rn = 1)"""

PREPARED = f"""{PAIRS},
user_ids AS (SELECT user_id, row_number() OVER (ORDER BY user_id)-1 AS user_idx FROM (SELECT DISTINCT user_id FROM pairs)),
item_ids AS (SELECT item_id, row_number() OVER (ORDER BY item_id)-1 AS item_idx FROM (SELECT DISTINCT item_id FROM pairs)),
numbered AS (SELECT user_idx, item_idx, rating, date, review_id,
  row_number() OVER (ORDER BY date, user_idx, item_idx) AS rn, count(*) OVER () AS n
  FROM pairs JOIN user_ids USING (user_id) JOIN item_ids USING (item_id)),
edges AS MATERIALIZED (SELECT user_idx, item_idx, rating, date, review_id, CASE
  WHEN rn <= floor(n*0.7::DOUBLE) THEN 'train'
  WHEN rn <= floor(n*(0.7::DOUBLE+0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM numbered),
size AS (SELECT (SELECT count(*) FROM user_ids) AS nu, (SELECT count(*) FROM item_ids) AS ni)"""

GRAPH = f"""{PREPARED},
train AS (SELECT user_idx AS user_id, item_idx + nu AS item_id, rating, date FROM edges, size WHERE split = 'train'),
graph AS MATERIALIZED (SELECT user_id AS src, item_id AS dst FROM train UNION ALL SELECT item_id, user_id FROM train),
degree AS (SELECT dst AS node, count(*) AS degree FROM graph GROUP BY dst)"""


def start_vectors(dim: int = DIM, seed: int = SEED) -> str:
    """nodes and start(node, d, x)."""
    return f"""nodes AS (SELECT user_idx AS node FROM user_ids UNION ALL SELECT item_idx + nu FROM item_ids, size),
start AS MATERIALIZED (SELECT node, d, ({u(seed, 'node', 'd')}*2.0::DOUBLE-1.0::DOUBLE)*sqrt(6.0::DOUBLE/((nu+ni)+{dim})) AS x
  FROM nodes, range({dim}) AS r(d), size)"""


def propagate(source: str, target: str) -> str:
    """One layer of symmetric-normalised propagation over (node, d, x)."""
    return f"""{target} AS MATERIALIZED (SELECT s.node, s.d, coalesce(m.x, 0.0)/sqrt(CAST(coalesce(g.degree,1) AS DOUBLE)) AS x
  FROM {source} s LEFT JOIN (SELECT graph.dst AS node, v.d, sum(v.x/sqrt(CAST(coalesce(dg.degree,1) AS DOUBLE))) AS x
    FROM graph JOIN {source} v ON graph.src = v.node LEFT JOIN degree dg ON dg.node = graph.src
    GROUP BY graph.dst, v.d) m ON s.node = m.node AND s.d = m.d LEFT JOIN degree g ON g.node = s.node)"""


# final(node, d, x) and vec(node, v): one propagation layer, averaged with the start
VECTORS = f"""{GRAPH}, {start_vectors()}, {propagate('start', 'layer1')},
final AS (SELECT a.node, a.d, (a.x+b.x)/2.0::DOUBLE AS x FROM start a JOIN layer1 b ON a.node = b.node AND a.d = b.d),
vec AS MATERIALIZED (SELECT node, list(x ORDER BY d) AS v FROM final GROUP BY node),
uvec AS (SELECT node AS "user", v FROM vec, size WHERE node < nu),
ivec AS (SELECT node - nu AS item, v FROM vec, size WHERE node >= nu)"""

PARTS = """train_part AS (SELECT user_idx AS "user", item_idx AS item, rating FROM edges WHERE split = 'train'),
val_part AS (SELECT user_idx AS "user", item_idx AS item, rating FROM edges WHERE split = 'val'),
test_part AS (SELECT user_idx AS "user", item_idx AS item, rating FROM edges WHERE split = 'test')"""


def top_k(k: int, users: str = "uvec", seen: str | None = "train_part", out: str = "ranked") -> str:
    """``out``(user, item, score, rank) by rounded dot product, ties by item."""
    anti = f'WHERE NOT EXISTS (SELECT 1 FROM {seen} s WHERE s."user" = a."user" AND s.item = b.item)' if seen else ""
    return f"""{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank
  FROM (SELECT a."user", b.item, {r6('list_inner_product(a.v, b.v)')} AS score FROM {users} a, ivec b {anti})) WHERE rank <= {k})"""


def user_metrics(ks=(5, 10, 20), ranked: str = "ranked", test: str = "test_part", k_filter: bool = False,
                 threshold: float = RELEVANT_FROM, tag: str = "") -> str:
    """``per_user``(user, k, P, R, F1, NDCG, MRR, HR, AP); ``tag`` ends all names it defines."""
    filt = "WHERE n_all >= k" if k_filter else ""
    return f"""rel{tag} AS (SELECT DISTINCT "user", item FROM {test} WHERE rating >= {threshold}),
pool{tag} AS (SELECT t."user", count(DISTINCT t.item) AS n_all, count(DISTINCT r.item) AS n_rel FROM {test} t
  LEFT JOIN rel{tag} r ON t."user" = r."user" AND t.item = r.item GROUP BY t."user" HAVING count(DISTINCT r.item) > 0),
hits{tag} AS (SELECT k."user", k.rank, row_number() OVER (PARTITION BY k."user" ORDER BY k.rank) AS nth
  FROM {ranked} k JOIN rel{tag} USING ("user", item)),
ks{tag} AS (SELECT unnest({list(ks)}) AS k),
counted{tag} AS (SELECT p."user", k, any_value(n_all) AS n_all, any_value(n_rel) AS n_rel, count(h.rank) AS n,
  coalesce(sum(1.0::DOUBLE/log2(h.rank+1)), 0.0) AS dcg, coalesce(sum(CAST(h.nth AS DOUBLE)/h.rank), 0.0) AS ap, min(h.rank) AS first_hit
  FROM pool{tag} p CROSS JOIN ks{tag} LEFT JOIN hits{tag} h ON h."user" = p."user" AND h.rank <= k GROUP BY p."user", k),
per_user{tag} AS (SELECT "user", CAST(k AS BIGINT) AS k, n/CAST(k AS DOUBLE) AS "P", n/CAST(n_rel AS DOUBLE) AS "R",
  CASE WHEN n > 0 THEN 2.0::DOUBLE*(n/CAST(k AS DOUBLE))*(n/CAST(n_rel AS DOUBLE))/(n/CAST(k AS DOUBLE)+n/CAST(n_rel AS DOUBLE)) ELSE 0.0 END AS "F1",
  dcg/list_sum(list_transform(range(1, least(n_rel, k)+1), lambda i: 1.0::DOUBLE/log2(i+1))) AS "NDCG",
  CASE WHEN first_hit IS NULL THEN 0.0 ELSE 1.0::DOUBLE/first_hit END AS "MRR",
  CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END AS "HR", ap/CAST(least(n_rel, k) AS DOUBLE) AS "AP" FROM counted{tag} {filt})"""


def mean_metrics(ks=(5, 10, 20)) -> str:
    """Final SELECT over per_user."""
    means = ", ".join(f'coalesce({r6(f"""avg("{m}")""")}, 0.0) AS "{"MAP" if m == "AP" else m}"'
                      for m in ("P", "R", "F1", "NDCG", "MRR", "HR", "AP"))
    return f"""SELECT CAST(w.k AS BIGINT) AS k, {means}, count("user") AS n_eval_users
  FROM (SELECT unnest({list(ks)}) AS k) w LEFT JOIN per_user p ON p.k = w.k GROUP BY w.k"""


MODEL_SQL = "CASE event_type WHEN 'click' THEN 'gat' WHEN 'view' THEN 'sage' ELSE 'lightgcn' END"
RUNS = f"""runs AS (SELECT event_id AS run, {MODEL_SQL} AS model, user_id%4+1 AS n_workers,
  ['1k','10k','100k','full'][CAST((user_id//4)%4+1 AS INTEGER)] AS size_tag, ts, k/10.0::DOUBLE AS t_load, k/100.0::DOUBLE AS t_graph,
  value AS t_train, value/50.0::DOUBLE AS t_eval, (k%20)/1000.0::DOUBLE AS ndcg, k AS k_prop
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""

ARTICLES = """articles AS (SELECT doc_id, lang IN ('en','fr') AS is_pubmed,
  CASE WHEN lang IN ('en','fr') THEN 'pubmed-articles' ELSE 'arxiv-articles' END AS topic,
  CASE WHEN lang IN ('en','fr') THEN 'pubmed' ELSE 'arxiv' END AS source,
  CASE WHEN source = 'src3' THEN '  ' ELSE '  Report on '||source||' No. '||doc_id||' ' END AS title,
  ' '||text AS abstract,
  CASE WHEN doc_id%4 != 0 THEN list_transform(range(1, doc_id%4+1), lambda i: 'Author '||i) END AS authors,
  CASE lang WHEN 'es' THEN '' WHEN 'de' THEN strftime(DATE '2020-01-01'+CAST(doc_id%1000 AS INTEGER), '%Y-%m-%d')||'T12:30:00'
    ELSE strftime(DATE '2020-01-01'+CAST(doc_id%1000 AS INTEGER), '%Y-%m-%d') END AS published_at,
  'id'||(doc_id - doc_id%2) AS article_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * doc_id AS sent_at,
  coalesce((SELECT max(1) FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0), 0) = 1 AS bad,
  source = 'src0' AS lost FROM documents d)"""
