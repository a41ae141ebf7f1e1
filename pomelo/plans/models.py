"""Graph, recommendation and evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import numeric as N, vectors as V
from ..functions.hashing import xavier_bound, xavier_matrix
from ..operators import (baselines, content, evaluate, graph, layers, minibatch, neighbours, recommend, scoring, split,
                         training)
from ..session import materialize
from . import domain as D, sqltext as S
from .registry import query

KS = (5, 10, 20)


def _components(df, key: str, out: str = "x"):
    """(key, d, x) with six decimals."""
    return df.select(key, F.posexplode("v").alias("d", "_x")).select(
        key, F.col("d").cast("long").alias("d"), N.r6("_x").alias(out))


MOMENTS = f"count(*) AS n, {S.r6('sum(x)')} AS total, {S.r6('sum(x*(d+1))')} AS by_place, {S.r6('sum(x*x)*1e3')} AS squares_milli"


def _moments(df):
    """Per node the number of components and three sums over all of them that each depends on."""
    sum_of = lambda f: F.aggregate(F.transform("v", f), F.lit(0.0), lambda a, x: a + x)
    return df.select("node", F.size("v").cast("long").alias("n"), N.r6(sum_of(lambda x, i: x)).alias("total"),
                     N.r6(sum_of(lambda x, i: x * (i + 1))).alias("by_place"), N.r6(sum_of(lambda x, i: x * x) * 1e3).alias("squares_milli"))


def _rounded(metrics):
    return metrics.select(*[N.r6(c).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes])


def _item_vectors(spark, sf):
    return D.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("v"))


# ---------------------------------------------------------------- graph

@query("node_degrees", "A6", f"WITH {S.GRAPH} SELECT node, degree FROM degree")
def node_degrees(spark, sf):
    return graph.degrees(D.prepared(spark, sf).graph())


WEIGHT_SQL = f"(rating-1.0::DOUBLE)/4.0::DOUBLE*exp(-CAST(coalesce(CAST(DATE '{D.AS_OF}'-date AS INTEGER),365) AS DOUBLE)/365.0::DOUBLE)"


@query("training_graph", "G2 F10 F9", f"""WITH {S.GRAPH}, w AS (SELECT user_id, item_id, {WEIGHT_SQL} AS w FROM train)
SELECT user_id AS src, item_id AS dst, {S.r6('w')} AS w FROM w UNION ALL SELECT item_id, user_id, {S.r6('w')} FROM w""")
def training_graph(spark, sf):
    g = graph.training_graph(D.prepared(spark, sf).train_edges(), F.lit(D.AS_OF).cast("date"))
    return g.select("src", "dst", N.r6("w").alias("w"))


@query("graph_with_item_edges", "G2 U5 G16", f"""WITH {S.GRAPH}, w AS (SELECT user_id, item_id, {WEIGHT_SQL} AS w FROM train),
e AS (SELECT vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT item, list_transform(v, lambda x: x/sqrt(list_inner_product(v, v))) AS v FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, neighbour) AS rank FROM (
  SELECT a.item, b.item AS neighbour, {S.r6('list_inner_product(a.v, b.v)')} AS score FROM n a, n b WHERE a.item <> b.item)),
ii AS (SELECT item + nu AS src, neighbour + nu AS dst FROM k, size WHERE rank <= 5),
g AS (SELECT user_id AS src, item_id AS dst, w FROM w UNION ALL SELECT item_id, user_id, w FROM w
  UNION ALL SELECT src, dst, 1.0 FROM ii UNION ALL SELECT dst, src, 1.0 FROM ii)
SELECT dst AS node, count(*) AS n_edges, {S.r6('sum(w)')} AS weight FROM g GROUP BY dst""")
def graph_with_item_edges(spark, sf):
    p = D.prepared(spark, sf)
    n_users, _ = p.sizes()
    nodes = _item_vectors(spark, sf).withColumn("item", F.col("item") + n_users)
    g = graph.training_graph(p.train_edges(), F.lit(D.AS_OF).cast("date"), 365.0, graph.item_item_edges(nodes, 5))
    return g.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_edges"), N.r6(F.sum("w")).alias("weight"))


@query("symmetric_norm", "G3", f"""WITH {S.GRAPH} SELECT src, dst, {S.r6('1.0::DOUBLE/sqrt(a.degree*b.degree)')} AS norm
FROM graph JOIN degree a ON a.node = src JOIN degree b ON b.node = dst""")
def symmetric_norm(spark, sf):
    return graph.symmetric_norm(D.prepared(spark, sf).graph()).select("src", "dst", N.r6("norm").alias("norm"))


@query("start_vectors", "G15", f"""WITH {S.PREPARED}, {S.start_vectors()} SELECT node, d, {S.r6('x')} AS x FROM start""")
def start_vectors(spark, sf):
    return _components(D.prepared(spark, sf).start_vectors(), "node")


@query("warm_start", "G15", f"""WITH {S.PREPARED}, {S.start_vectors()},
fresh AS (SELECT vec_id + nu AS node, unnest(embedding) AS x, unnest(range(64)) AS d FROM embeddings, size)
SELECT s.node, s.d, {S.r6('coalesce(CAST(f.x AS DOUBLE), s.x)')} AS x FROM start s LEFT JOIN fresh f ON f.node = s.node AND f.d = s.d""")
def warm_start(spark, sf):
    p = D.prepared(spark, sf)
    n_users, _ = p.sizes()
    fresh = _item_vectors(spark, sf).select((F.col("item") + n_users).alias("node"), "v")
    return _components(graph.warm_start(p.start_vectors(), fresh), "node")


@query("message_passing", "J10", f"""WITH {S.GRAPH}, {S.start_vectors()}
SELECT graph.dst AS node, d, {S.r6('sum(x)')} AS x FROM graph JOIN start ON src = node GROUP BY graph.dst, d""")
def message_passing(spark, sf):
    p = D.prepared(spark, sf)
    sums = graph.sum_messages(p.graph(), p.start_vectors(), D.DIM, n_nodes=sum(p.sizes()))
    return _components(sums.withColumnRenamed("m", "v"), "node")


@query("neighbour_mean", "A18", f"""WITH {S.GRAPH}, {S.start_vectors()}
SELECT graph.dst AS node, d, {S.r6('avg(x)')} AS x FROM graph JOIN start ON src = node GROUP BY graph.dst, d""")
def neighbour_mean(spark, sf):
    p = D.prepared(spark, sf)
    means = graph.neighbour_mean(p.start_vectors(), p.graph(), D.DIM, sum(p.sizes()))
    return _components(means.withColumnRenamed("m", "v"), "node")


@query("lightgcn_one_layer", "G4", f"WITH {S.VECTORS} SELECT node, d, {S.r6('x')} AS x FROM final")
def lightgcn_one_layer(spark, sf):
    p = D.prepared(spark, sf)
    return _components(graph.lightgcn(p.start_vectors(), p.graph(), D.DIM, 1, n_nodes=sum(p.sizes())), "node")


@query("lightgcn_two_layers", "G4", f"""WITH {S.GRAPH}, {S.start_vectors()}, {S.propagate('start', 'one')}, {S.propagate('one', 'two')}
SELECT node, d, {S.r6('(a.x+b.x+c.x)/3.0::DOUBLE')} AS x FROM start a JOIN one b USING (node, d) JOIN two c USING (node, d)""")
def lightgcn_two_layers(spark, sf):
    p = D.prepared(spark, sf)
    return _components(graph.lightgcn(p.start_vectors(), p.graph(), D.DIM, 2, n_nodes=sum(p.sizes())), "node")


def _matrix_sql(name: str, seed: str, rows: int, cols: int) -> str:
    """(r, c, w) entries of a seeded Xavier matrix."""
    return (f"{name} AS (SELECT r, c, ({S.u(seed, 'r', 'c')}*2.0::DOUBLE-1.0::DOUBLE)*{xavier_bound(cols, rows)!r}::DOUBLE AS w "
            f"FROM range({rows}) a(r), range({cols}) b(c))")


@query("sage_forward", "G5", f"""WITH {S.GRAPH}, {S.start_vectors()},
m AS MATERIALIZED (SELECT graph.dst AS node, d, avg(x) AS x FROM graph JOIN start ON src = node GROUP BY graph.dst, d),
{_matrix_sql('wl', 'sage-neighbour', D.DIM, D.DIM)}, {_matrix_sql('wr', 'sage-self', D.DIM, D.DIM)},
l AS (SELECT node, r AS d, sum(w*x) AS x FROM m JOIN wl ON c = d GROUP BY node, r),
s AS (SELECT node, r AS d, sum(w*x) AS x FROM start JOIN wr ON c = d GROUP BY node, r)
SELECT a.node, a.d, {S.r6('coalesce(l.x, 0.0)+0.01::DOUBLE+s.x+a.x')} AS x FROM start a JOIN s USING (node, d) LEFT JOIN l USING (node, d)""")
def sage_forward(spark, sf):
    p = D.prepared(spark, sf)
    layer = {"neighbour": xavier_matrix(D.DIM, D.DIM, "sage-neighbour"),
             "self": xavier_matrix(D.DIM, D.DIM, "sage-self"), "bias": [0.01] * D.DIM}
    return _components(graph.sage(p.start_vectors(), p.graph(), D.DIM, [layer], n_nodes=sum(p.sizes())), "node")


GAT_DIM, GAT_HEADS = D.DIM, 4


def _gat_sql() -> str:
    heads = []
    for i in range(GAT_HEADS):
        heads.append(f"""{_matrix_sql(f'w{i}', f'gat-w{i}', GAT_DIM, GAT_DIM)}, {_matrix_sql(f'p{i}', f'gat-s{i}', 1, GAT_DIM)}, {_matrix_sql(f'q{i}', f'gat-t{i}', 1, GAT_DIM)},
z{i} AS MATERIALIZED (SELECT node, r AS d, sum(w*x) AS z FROM start JOIN w{i} ON c = d GROUP BY node, r),
t{i} AS (SELECT node, sum(z*p.w) AS s, sum(z*q.w) AS t FROM z{i} JOIN p{i} p ON p.c = d JOIN q{i} q ON q.c = d GROUP BY node),
e{i} AS (SELECT src, dst, CASE WHEN a.s+b.t > 0 THEN a.s+b.t ELSE (a.s+b.t)*0.2::DOUBLE END AS e FROM links JOIN t{i} a ON a.node = src JOIN t{i} b ON b.node = dst),
a{i} AS MATERIALIZED (SELECT src, dst, exp(e-max(e) OVER (PARTITION BY dst)) AS w FROM e{i}),
o{i} AS (SELECT dst AS node, d, sum(a.w*z.z)/sum(a.w) AS x FROM a{i} a JOIN z{i} z ON z.node = src GROUP BY dst, d)""")
    total = "+".join(f"o{i}.x" for i in range(GAT_HEADS))
    joins = " ".join(f"JOIN o{i} ON o{i}.node = st.node AND o{i}.d = st.d" for i in range(GAT_HEADS))
    return f"""WITH {S.GRAPH}, {S.start_vectors(GAT_DIM)},
links AS (SELECT src, dst FROM graph WHERE src <> dst UNION ALL SELECT node, node FROM nodes), {', '.join(heads)}
SELECT st.node, st.d, {S.r6(f'({total})/{GAT_HEADS}.0::DOUBLE+0.01::DOUBLE+st.x')} AS x FROM start st {joins}"""


@query("gat_forward", "G6 W6", _gat_sql())
def gat_forward(spark, sf):
    p = D.prepared(spark, sf)
    heads = [{"matrix": xavier_matrix(GAT_DIM, GAT_DIM, f"gat-w{i}"), "src": xavier_matrix(1, GAT_DIM, f"gat-s{i}")[0],
              "dst": xavier_matrix(1, GAT_DIM, f"gat-t{i}")[0]} for i in range(GAT_HEADS)]
    layer = {"heads": heads, "bias": [0.01] * GAT_DIM}
    return _components(graph.gat(p.start_vectors(GAT_DIM), p.graph(), GAT_DIM, [layer], n_nodes=sum(p.sizes())), "node")


@query("edge_softmax", "W6", f"""WITH {S.GRAPH}, e AS (SELECT src, dst, sin(CAST(src*7+dst AS DOUBLE)) AS e FROM graph)
SELECT src, dst, {S.r6('exp(e-max(e) OVER (PARTITION BY dst))/sum(exp(e)) OVER (PARTITION BY dst)*exp(max(e) OVER (PARTITION BY dst))')} AS alpha FROM e""")
def edge_softmax(spark, sf):
    scored = D.prepared(spark, sf).graph().withColumn("e", F.sin((F.col("src") * 7 + F.col("dst")).cast("double")))
    return graph.edge_softmax(scored).select("src", "dst", N.r6("alpha").alias("alpha"))


@query("pair_scores", "G7", f"""WITH {S.VECTORS}, {S.PARTS} SELECT "user", item, {S.r6('list_inner_product(u.v, i.v)')} AS score
FROM test_part JOIN uvec u USING ("user") JOIN ivec i USING (item)""")
def pair_scores(spark, sf):
    p = D.prepared(spark, sf)
    n_users, n_items = p.sizes()
    pairs = p.part("test").select(F.col("user").alias("user_id"), (F.col("item") + n_users).alias("item_id"))
    return graph.pair_scores(pairs, p.vectors(), n_users, n_items, D.DIM).select(
        F.col("user_id").alias("user"), (F.col("item_id") - n_users).alias("item"), N.r6("score").alias("score"))


@query("neighbour_sampling", "G13", f"""WITH {S.GRAPH}, seeds AS (SELECT DISTINCT user_idx AS node FROM edges WHERE split = 'val'),
h0 AS (SELECT 0 AS hop, src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY {S.h('42-0', 'src', 'dst')}, src) AS r
  FROM graph WHERE dst IN (SELECT node FROM seeds)) WHERE r <= 15),
h1 AS (SELECT 1 AS hop, src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY {S.h('42-1', 'src', 'dst')}, src) AS r
  FROM graph WHERE dst IN (SELECT src FROM h0)) WHERE r <= 10)
SELECT * FROM h0 UNION ALL SELECT * FROM h1""")
def neighbour_sampling(spark, sf):
    p = D.prepared(spark, sf)
    seeds = p.part("val").select(F.col("user").alias("node"))
    return graph.sample_neighbours(p.graph(), seeds)


def _negatives(seed=42) -> str:
    draw = lambda r: f"{S.h60(seed, 'user_idx', 'item_idx', 'slot', str(r))} % ni"
    draws = ' UNION ALL '.join(f'SELECT user_idx, item_idx, slot, {r} AS round, {draw(r)} AS neg_idx FROM slots' for r in range(6))
    return f"""pos AS (SELECT user_idx, item_idx FROM edges WHERE split = 'train'),
slots AS (SELECT user_idx, item_idx, CAST(slot AS INTEGER) AS slot, ni FROM pos, range(10) s(slot), size),
draws AS ({draws}),
tested AS (SELECT d.*, p.user_idx IS NOT NULL AS hit FROM draws d LEFT JOIN pos p ON p.user_idx = d.user_idx AND p.item_idx = d.neg_idx),
negatives AS MATERIALIZED (SELECT user_idx, item_idx, slot, CASE WHEN bool_or(NOT hit) THEN arg_min(neg_idx, round) FILTER (WHERE NOT hit)
  ELSE arg_max(neg_idx, round) END AS neg_idx FROM tested GROUP BY user_idx, item_idx, slot)"""


NEGATIVES = _negatives()


@query("negative_sampling", "G9", f"WITH {S.PREPARED}, {NEGATIVES} SELECT user_idx, item_idx, slot, neg_idx FROM negatives")
def negative_sampling(spark, sf):
    p = D.prepared(spark, sf)
    pos = p.part("train").select(F.col("user").alias("user_idx"), F.col("item").alias("item_idx"))
    return graph.sample_negatives(pos, pos, p.sizes()[1])


_TRIPLES_SQL = """t AS (SELECT u.v AS u, i.v AS i, j.v AS j, n.user_idx, n.item_idx, n.neg_idx, list_inner_product(u.v, i.v)-list_inner_product(u.v, j.v) AS gap FROM negatives n
  JOIN uvec u ON u."user" = user_idx JOIN ivec i ON i.item = item_idx JOIN ivec j ON j.item = neg_idx)"""


def _bpr(seed=42) -> str:
    return f"{S.VECTORS}, {_negatives(seed)}, {_TRIPLES_SQL}"


# gradient per node and component, summed over the triples
GRADIENT = """c AS (SELECT *, 1.0::DOUBLE/(1.0::DOUBLE+exp(gap)) AS p FROM t),
x AS (SELECT user_idx, item_idx, neg_idx, p, unnest(u) AS u, unnest(i) AS i, unnest(j) AS j, unnest(range(64)) AS d FROM c),
g AS (SELECT user_idx AS node, d, sum((j-i)*p + 2e-5::DOUBLE*u) AS g FROM x GROUP BY 1, 2
  UNION ALL SELECT item_idx + nu, d, sum(2e-5::DOUBLE*i - u*p) FROM x, size GROUP BY 1, 2
  UNION ALL SELECT neg_idx + nu, d, sum(u*p + 2e-5::DOUBLE*j) FROM x, size GROUP BY 1, 2),
grad AS MATERIALIZED (SELECT node, d, sum(g) AS x FROM g GROUP BY node, d)"""


def _triples(spark, sf):
    p = D.prepared(spark, sf)
    pos = p.part("train").select(F.col("user").alias("user_idx"), F.col("item").alias("item_idx"))
    return p, graph.sample_negatives(pos, pos, p.sizes()[1])


@query("bpr_loss", "G8 F16", f"""WITH {_bpr()}, s AS (SELECT avg(-(least(gap,0.0::DOUBLE)-ln(1.0::DOUBLE+exp(-abs(gap))))) AS ranking,
  avg(list_inner_product(u,u)+list_inner_product(i,i)+list_inner_product(j,j))*1e-5::DOUBLE AS penalty, count(*) AS n FROM t)
SELECT {S.r6('ranking')} AS ranking, {S.r6('penalty*1e6')} AS penalty_micro, {S.r6('ranking+penalty')} AS loss, n AS n_triples FROM s""")
def bpr_loss(spark, sf):
    p, triples = _triples(spark, sf)
    row = training.bpr_loss(triples, p.vectors(), p.sizes()[0], D.DIM, 1e-5, sum(p.sizes()))
    return row.select(N.r6("ranking").alias("ranking"), N.r6(F.col("penalty") * 1e6).alias("penalty_micro"),
                      N.r6("loss").alias("loss"), "n_triples")


@query("bpr_gradient", "G10", f"""WITH {_bpr()}, {GRADIENT} SELECT node, d, {S.r6('x')} AS x FROM grad""")
def bpr_gradient(spark, sf):
    p, triples = _triples(spark, sf)
    n_users, _ = p.sizes()
    g = training.bpr_gradient(triples, p.vectors(), n_users, D.DIM, 1e-5, sum(p.sizes()))
    return _components(g.withColumnRenamed("g", "v"), "node")


@query("bpr_training", "G10", f"""WITH {_bpr('42-1')}, {GRADIENT},
mean AS (SELECT s.node, s.d, coalesce(g.x, 0.0)/(SELECT count(*) FROM t) AS x FROM start s LEFT JOIN grad g ON g.node = s.node AND g.d = s.d),
{S.propagate('mean', 'spread')},
back AS MATERIALIZED (SELECT a.node, a.d, (a.x+b.x)/2.0::DOUBLE AS x FROM mean a JOIN spread b ON a.node = b.node AND a.d = b.d),
cut AS (SELECT least(1.0::DOUBLE, 1.0::DOUBLE/(sqrt(sum(x*x))+1e-6::DOUBLE)) AS f FROM back)
SELECT s.node, s.d, {S.r6('s.x-0.0005::DOUBLE*(b.x*f)/(abs(b.x*f)+1e-8::DOUBLE)')} AS x FROM start s JOIN back b ON b.node = s.node AND b.d = s.d, cut""")
def bpr_training(spark, sf):
    """One whole epoch at full width: propagation, sampling, gradient, its propagation and an Adam step."""
    p = D.prepared(spark, sf)
    n_users, n_items = p.sizes()
    pos = p.part("train").select(F.col("user").alias("user_idx"), F.col("item").alias("item_idx"))
    links = p.train_edges().select(F.col("user_id").alias("src"), F.col("item_id").alias("dst"))
    vectors, _ = training.train_bpr(p.start_vectors(), pos, links, n_users, n_items, D.DIM, epochs=1)
    return _components(vectors, "node")


BATCHES = 4


def _sampled_links() -> str:
    """sup(user_idx, item_idx, batch) and links(batch, src, dst): supervision edges in batches and their sub-graphs."""
    def hop(i: int, frontier: str, limit: int) -> str:
        return f"""w{i} AS (SELECT batch, f.dst, slot, degree, slot*degree//{limit} AS low, (slot+1)*degree//{limit} - slot*degree//{limit} AS n
  FROM {frontier} f JOIN spans USING (dst), range({limit}) s(slot)),
h{i} AS MATERIALIZED (SELECT batch, src, w.dst FROM (SELECT *, ({S.h60(f'42-1-{i}', 'batch', 'dst')} + low + {S.h60(f'42-1-{i}', 'batch', 'dst', 'slot')} % n) % degree AS place FROM w{i} WHERE n > 0) w
  JOIN placed p ON p.dst = w.dst AND p.place = w.place)"""
    return f"""o AS (SELECT user_id, item_id, row_number() OVER (ORDER BY {S.h(7, 'user_id', 'item_id')}, user_id, item_id) AS rn, count(*) OVER () AS n FROM train),
roles AS MATERIALIZED (SELECT user_id AS user_idx, item_id - nu AS item_idx, rn <= floor(n*0.8::DOUBLE) AS message FROM o, size),
sup AS MATERIALIZED (SELECT user_idx, item_idx, {S.h('42-1-batch', 'user_idx', 'item_idx')} % {BATCHES} AS batch FROM roles WHERE NOT message),
mgraph AS (SELECT user_idx AS src, item_idx + nu AS dst FROM roles, size WHERE message UNION ALL SELECT item_idx + nu, user_idx FROM roles, size WHERE message),
placed AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY {S.h(42, 'src', 'dst')}, src) - 1 AS place FROM mgraph),
spans AS (SELECT dst, count(*) AS degree FROM placed GROUP BY dst),
f0 AS (SELECT batch, user_idx AS dst FROM sup UNION SELECT batch, item_idx + nu FROM sup, size),
{hop(0, 'f0', 15)}, f1 AS (SELECT DISTINCT batch, src AS dst FROM h0), {hop(1, 'f1', 10)},
links AS MATERIALIZED (SELECT batch, src, dst FROM h0 UNION SELECT batch, src, dst FROM h1)"""


@query("batch_subgraphs", "G12 G13", f"WITH {S.GRAPH}, {_sampled_links()} SELECT CAST(batch AS INTEGER) AS batch, src, dst FROM links")
def batch_subgraphs(spark, sf):
    """The sub-graphs of all batches of an epoch."""
    p, supervision, message = _roles(spark, sf)
    n_users, n_items = p.sizes()
    return minibatch.epoch_batches(supervision, _positives(p), minibatch.SampledNeighbours(message), n_users, n_items, BATCHES, seed="42-1")[1]


def _positives(p):
    return p.part("train").select(F.col("user").alias("user_idx"), F.col("item").alias("item_idx"))


def _roles(spark, sf):
    """(user_idx, item_idx) of the supervision edges and the others as a graph."""
    p = D.prepared(spark, sf)
    n_users, _ = p.sizes()
    roles = materialize(split.supervision_split(p.train_edges().select("user_id", "item_id"), ["user_id", "item_id"], stored=True), "roles")
    supervision = roles.filter("role = 'supervision'").select(F.col("user_id").alias("user_idx"), (F.col("item_id") - n_users).alias("item_idx"))
    message = graph.both_directions(roles.filter("role = 'message'").select(F.col("user_id").alias("src"), F.col("item_id").alias("dst")))
    return p, supervision, message


def _batch_step(b: int) -> str:
    """st{b+1}(node, d, x, m1, m2): the state after a batch, from st{b}."""
    fix = (1 - 0.999 ** (b + 1)) ** 0.5
    root = lambda c: f"sqrt(CAST(greatest(coalesce({c}, 1), 1) AS DOUBLE))"

    def spread(source: str, target: str, start: str, end: str) -> str:
        return f"""{target} AS MATERIALIZED (SELECT s.node, s.d, (s.x + coalesce(m.x, 0.0)/{root('g.degree')})/2.0::DOUBLE AS x FROM {source} s LEFT JOIN (
  SELECT l.{end} AS node, v.d, sum(v.x/{root('dg.degree')}) AS x FROM l{b} l JOIN {source} v ON l.{start} = v.node LEFT JOIN deg{b} dg ON dg.node = l.{start}
  GROUP BY l.{end}, v.d) m ON m.node = s.node AND m.d = s.d LEFT JOIN deg{b} g ON g.node = s.node)"""

    return f"""l{b} AS (SELECT src, dst FROM links WHERE batch = {b}), deg{b} AS (SELECT dst AS node, count(*) AS degree FROM l{b} GROUP BY dst),
k{b} AS (SELECT user_idx, item_idx + nu AS i, neg_idx + nu AS j FROM negatives JOIN sup USING (user_idx, item_idx), size WHERE batch = {b}),
met{b} AS (SELECT user_idx AS node FROM k{b} UNION SELECT i FROM k{b} UNION SELECT j FROM k{b} UNION SELECT src FROM l{b} UNION SELECT dst FROM l{b}),
loc{b} AS MATERIALIZED (SELECT * FROM st{b} WHERE node IN (SELECT node FROM met{b})),
{spread(f'loc{b}', f'fin{b}', 'src', 'dst')},
fv{b} AS MATERIALIZED (SELECT node, list(x ORDER BY d) AS v FROM fin{b} GROUP BY node), rv{b} AS MATERIALIZED (SELECT node, list(x ORDER BY d) AS v FROM loc{b} GROUP BY node),
x{b} AS (SELECT user_idx, i, j, 1.0::DOUBLE/(1.0::DOUBLE+exp(list_inner_product(a.v, b.v)-list_inner_product(a.v, c.v))) AS p,
  unnest(a.v) AS va, unnest(b.v) AS vb, unnest(c.v) AS vc, unnest(range({D.DIM})) AS d FROM k{b} JOIN fv{b} a ON a.node = user_idx JOIN fv{b} b ON b.node = i JOIN rv{b} c ON c.node = j),
gr{b} AS (SELECT node, d, sum(x) AS x FROM (SELECT user_idx AS node, d, sum((vc-vb)*p + 2e-5::DOUBLE*va) AS x FROM x{b} GROUP BY 1, 2
  UNION ALL SELECT i, d, sum(2e-5::DOUBLE*vb - va*p) FROM x{b} GROUP BY 1, 2) GROUP BY node, d),
rg{b} AS (SELECT j AS node, d, sum(va*p + 2e-5::DOUBLE*vc) AS x FROM x{b} GROUP BY 1, 2), n{b} AS (SELECT count(*) AS n FROM k{b}),
dn{b} AS MATERIALIZED (SELECT s.node, s.d, coalesce(g.x, 0.0)/n AS x FROM n{b}, loc{b} s LEFT JOIN gr{b} g ON g.node = s.node AND g.d = s.d),
{spread(f'dn{b}', f'bk{b}', 'dst', 'src')},
tot{b} AS MATERIALIZED (SELECT s.node, s.d, s.x + coalesce(g.x, 0.0)/n AS x FROM n{b}, bk{b} s LEFT JOIN rg{b} g ON g.node = s.node AND g.d = s.d),
cut{b} AS (SELECT least(1.0::DOUBLE, 1.0::DOUBLE/(sqrt(sum(x*x))+1e-6::DOUBLE)) AS f FROM tot{b}),
mom{b} AS (SELECT s.node, s.d, s.x, 0.9::DOUBLE*m1 + 0.1::DOUBLE*g.x*f AS m1, 0.999::DOUBLE*m2 + 0.001::DOUBLE*g.x*f*g.x*f AS m2
  FROM cut{b}, loc{b} s JOIN tot{b} g ON g.node = s.node AND g.d = s.d),
st{b + 1} AS MATERIALIZED (SELECT node, d, x - {0.0005 * fix / (1 - 0.9 ** (b + 1))!r}::DOUBLE*m1/(sqrt(m2) + {1e-8 * fix!r}::DOUBLE) AS x, m1, m2 FROM mom{b}
  UNION ALL SELECT * FROM st{b} WHERE node NOT IN (SELECT node FROM met{b}))"""


@query("sampled_training", "G8 G10 G12 G13", f"""WITH {S.GRAPH}, {S.start_vectors()}, {_sampled_links()}, {_negatives('42-1')},
st0 AS MATERIALIZED (SELECT node, d, x, 0.0::DOUBLE AS m1, 0.0::DOUBLE AS m2 FROM start), {", ".join(_batch_step(b) for b in range(BATCHES))}
SELECT node, {MOMENTS} FROM st{BATCHES} GROUP BY node""")
def sampled_training(spark, sf):
    """An epoch of four batches of supervision edges, each on a sampled sub-graph of the other edges."""
    p, supervision, message = _roles(spark, sf)
    n_users, n_items = p.sizes()
    vectors, _ = minibatch.train_sampled(p.start_vectors(), supervision, message, _positives(p), n_users, n_items, D.DIM, epochs=1,
                                         batch_edges=-(-supervision.count() // BATCHES))
    return _moments(vectors)


@query("sage_gradient", "G5 G8 G10", f"""WITH {S.GRAPH}, {S.start_vectors()},
m AS MATERIALIZED (SELECT graph.dst AS node, d, avg(x) AS x FROM graph JOIN start ON src = node GROUP BY graph.dst, d),
{_matrix_sql('wl', 'sage-neighbour', D.DIM, D.DIM)}, {_matrix_sql('wr', 'sage-self', D.DIM, D.DIM)},
l AS (SELECT node, r AS d, sum(w*x) AS x FROM m JOIN wl ON c = d GROUP BY node, r),
s AS (SELECT node, r AS d, sum(w*x) AS x FROM start JOIN wr ON c = d GROUP BY node, r),
parts AS (SELECT node, d, x FROM start UNION ALL SELECT node, d, x + 0.01::DOUBLE FROM s UNION ALL SELECT node, d, x FROM l),
final AS MATERIALIZED (SELECT node, d, sum(x) AS x FROM parts GROUP BY node, d),
vec AS MATERIALIZED (SELECT node, list(x ORDER BY d) AS v FROM final GROUP BY node),
uvec AS (SELECT node AS "user", v FROM vec, size WHERE node < nu), ivec AS (SELECT node - nu AS item, v FROM vec, size WHERE node >= nu),
{_negatives()}, {_TRIPLES_SQL}, {GRADIENT},
mean AS MATERIALIZED (SELECT node, list(x/(SELECT count(*) FROM t) ORDER BY d) AS g FROM grad GROUP BY node),
mv AS MATERIALIZED (SELECT node, list(x ORDER BY d) AS m FROM m GROUP BY node),
sv AS MATERIALIZED (SELECT node, list(x ORDER BY d) AS x FROM start GROUP BY node),
ds AS (SELECT unnest(range(1, {D.DIM + 1})) AS i), cells AS (SELECT a.i AS r, b.i AS c FROM ds a, ds b)
SELECT 'neighbour' AS part, r-1 AS r, c-1 AS c, {S.r9('sum(g[r]*m[c])')} AS g FROM mean JOIN mv USING (node), cells GROUP BY r, c
UNION ALL SELECT 'self', r-1, c-1, {S.r9('sum(g[r]*x[c])')} FROM mean JOIN sv USING (node), cells GROUP BY r, c
UNION ALL SELECT 'bias', i-1, 0, {S.r9('sum(g[i])')} FROM mean, ds GROUP BY i""")
def sage_gradient(spark, sf):
    """Gradient of the loss at the weights of a SAGE layer, over all triples."""
    p, triples = _triples(spark, sf)
    n_users, n_items = p.sizes()
    model = layers.Sage(D.DIM, 1)
    model.weights = [{"neighbour": np.array(xavier_matrix(D.DIM, D.DIM, "sage-neighbour")), "self": np.array(xavier_matrix(D.DIM, D.DIM, "sage-self")),
                      "bias": np.full(D.DIM, 0.01)}]
    _, _, (grads,) = layers.loss_and_gradients(model, p.start_vectors(), p.graph(), triples, n_users, n_users + n_items, 1e-5)
    rows = [(part, r, c, float(x)) for part in ("neighbour", "self", "bias") for r, row in enumerate(np.atleast_2d(grads[part].T).T) for c, x in enumerate(row)]
    return spark.createDataFrame(rows, "part string, r long, c long, g double").withColumn("g", F.floor(F.col("g") * 1e9 + 0.5) / 1e9)


@query("als_training", "G10", None)
def als_training(spark, sf):
    p = D.prepared(spark, sf)
    n_users, _ = p.sizes()
    pos = p.part("train").withColumnsRenamed({"user": "user_idx", "item": "item_idx"})
    vectors = training.train_als(pos, n_users)
    return vectors.groupBy((F.col("node") < n_users).alias("is_user")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(V.l2_norm("v")).alias("mean_norm"))


@query("text_vectors", "G14", None)
def text_vectors(spark, sf):
    items = content.hashed_text_vectors(D.businesses(spark, sf), "categories", 768)
    projected = graph.project(items.select("item_id", "v"), 16, D.SEED, 768)
    return projected.select("item_id", *[N.r6(F.col("v")[i]).alias(f"p{i}") for i in range(16)])


NEAREST = f"""e AS (SELECT vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT item, list_transform(v, lambda x: x/sqrt(list_inner_product(v, v))) AS v FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, neighbour) AS rank FROM (
  SELECT a.item, b.item AS neighbour, {S.r6('list_inner_product(a.v, b.v)')} AS score FROM n a, n b WHERE a.item <> b.item))"""


@query("nearest_items", "T12 J13 G16", f"WITH {NEAREST} SELECT item, neighbour, score, rank FROM k WHERE rank <= 5")
def nearest_items(spark, sf):
    found = scoring.nearest_items(_item_vectors(spark, sf), 5)
    return found.select("item", "neighbour", "score", F.col("rank").cast("long").alias("rank"))


def _approximate() -> str:
    """ann(item, neighbour, score, rank): members of the probed buckets, by exact score."""
    t, b, p = neighbours.TABLES, neighbours.BITS, neighbours.PROBES
    masks = ", ".join(f"({mask}, {at or '[]::INTEGER[]'})" for mask, at in neighbours.masks(b))
    return f"""e AS (SELECT vec_id AS item, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS MATERIALIZED (SELECT item, list_transform(v, lambda x: x/sqrt(list_inner_product(v, v))) AS v FROM e),
{_matrix_sql('planes', '42', t * b, 64)}, planev AS (SELECT r, list(w ORDER BY c) AS h FROM planes GROUP BY r),
prod AS MATERIALIZED (SELECT item, CAST(r//{b} AS INTEGER) AS tab, CAST(r%{b} AS INTEGER) AS b, list_inner_product(v, h) AS m FROM n, planev),
code AS MATERIALIZED (SELECT item, tab, sum(CASE WHEN m > 0 THEN CAST(1 AS BIGINT) << b ELSE 0 END)::BIGINT AS code, list(abs(m) ORDER BY b) AS size FROM prod GROUP BY item, tab),
masks(mask, places) AS (VALUES {masks}),
cost AS (SELECT item, tab, xor(code, CAST(mask AS BIGINT)) AS code, row_number() OVER (PARTITION BY item, tab ORDER BY coalesce(list_sum(list_transform(places, lambda i: size[i+1])), 0.0), mask) AS place FROM code, masks),
met AS (SELECT DISTINCT q.item, m.item AS neighbour FROM (SELECT * FROM cost WHERE place <= {p}) q JOIN code m ON q.tab = m.tab AND q.code = m.code WHERE q.item <> m.item),
ann AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, neighbour) AS rank FROM (
  SELECT met.item, met.neighbour, {S.r6('list_inner_product(a.v, b.v)')} AS score FROM met JOIN n a ON a.item = met.item JOIN n b ON b.item = met.neighbour)) WHERE rank <= 5)"""


@query("approximate_neighbours", "T12 J13 G16", f"WITH {_approximate()} SELECT item, neighbour, score, rank FROM ann")
def approximate_neighbours(spark, sf):
    found = neighbours.approximate_neighbours(_item_vectors(spark, sf), 5, 64)
    return found.select("item", "neighbour", "score", F.col("rank").cast("long").alias("rank"))


@query("approximate_recall", "T12 J13", f"""WITH {_approximate()},
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, neighbour) AS rank FROM (
  SELECT a.item, b.item AS neighbour, {S.r6('list_inner_product(a.v, b.v)')} AS score FROM n a, n b WHERE a.item <> b.item)),
x AS (SELECT k.item, CASE WHEN ann.item IS NULL THEN 0 ELSE 1 END AS hit FROM k LEFT JOIN ann ON ann.item = k.item AND ann.neighbour = k.neighbour WHERE k.rank <= 5)
SELECT {S.r6('avg(hit)')} AS recall, count(*) AS n_exact FROM x""")
def approximate_recall(spark, sf):
    """How many of the exact five nearest of all items the index finds."""
    items = _item_vectors(spark, sf)
    found = neighbours.approximate_neighbours(items, 5, 64)
    return neighbours.recall(found, scoring.nearest_items(items, 5), ["item", "neighbour"]).select(N.r6("recall").alias("recall"), "n_exact")


# ---------------------------------------------------------------- recommendation

@query("known_user_top_k", "T1 J6 J9 W4", f"""WITH {S.VECTORS}, {S.PARTS}, {S.top_k(10)} SELECT "user", item, score, rank FROM ranked""")
def known_user_top_k(spark, sf):
    p = D.prepared(spark, sf)
    recs = recommend.recommend(p.vectors(), p.sizes()[0], 10, seen=p.part("train"))
    return recs.select("user", "item", "score", F.col("rank").cast("long").alias("rank"))


@query("enriched_recommendations", "M8 J7 F3", f"""WITH {S.VECTORS}, {S.PARTS}, {S.top_k(5)}
SELECT "user", rank, CAST(item_id AS VARCHAR) AS business_id, trim(name, ' ') AS name, categories, {S.even('score', 4)} AS score
FROM ranked JOIN item_ids ON item_idx = item JOIN items USING (item_id)""")
def enriched_recommendations(spark, sf):
    p = D.prepared(spark, sf)
    recs = recommend.recommend(p.vectors(), p.sizes()[0], 5, seen=p.part("train"))
    return recommend.enrich(recs, p.item_ids, D.businesses(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


PROFILE = f"""liked AS (SELECT "user", item, CAST(rating AS DOUBLE) AS rating FROM val_part),
prof AS (SELECT "user", d, sum(rating*x)/sum(rating) AS x FROM liked JOIN final ON node = item + (SELECT nu FROM size) GROUP BY "user", d),
pvec AS (SELECT "user", list(x ORDER BY d) AS v FROM prof GROUP BY "user")"""


@query("profile_vectors", "A17 F27", f"""WITH {S.VECTORS}, {S.PARTS}, {PROFILE} SELECT "user", d, {S.r6('x')} AS x FROM prof""")
def profile_vectors(spark, sf):
    p = D.prepared(spark, sf)
    n_users, _ = p.sizes()
    _, items = recommend.split_vectors(p.vectors(), n_users)
    return _components(recommend.profile_vectors(p.part("val"), items, D.DIM, n_users), "user")


@query("cold_start_top_k", "M9", f"""WITH {S.VECTORS}, {S.PARTS}, {PROFILE}, {S.top_k(10, 'pvec', 'liked')}
SELECT "user", item, score, rank FROM ranked""")
def cold_start_top_k(spark, sf):
    p = D.prepared(spark, sf)
    n_users, _ = p.sizes()
    _, items = recommend.split_vectors(p.vectors(), n_users)
    recs = recommend.recommend_cold(p.part("val"), items, D.DIM, 10, n_users)
    return recs.select("user", "item", "score", F.col("rank").cast("long").alias("rank"))


@query("user_history", "M10", f"""WITH {S.PREPARED}, {S.PARTS} SELECT "user", item, rating FROM train_part WHERE "user" IN (SELECT "user" FROM test_part)""")
def user_history(spark, sf):
    p = D.prepared(spark, sf)
    return recommend.history(p.part("train"), p.part("test"))


@query("before_after", "M11", f"""WITH {S.VECTORS}, {S.PARTS}, {S.top_k(10, out='b')}, both_parts AS (SELECT * FROM train_part UNION ALL SELECT * FROM val_part),
{S.top_k(10, seen='both_parts', out='a')}
SELECT coalesce(b."user", a."user") AS "user", coalesce(b.item, a.item) AS item, b.rank AS rank_before, a.rank AS rank_after,
  CASE WHEN b.rank IS NULL THEN 'new' WHEN a.rank IS NULL THEN 'dropped' WHEN b.rank > a.rank THEN 'up' WHEN b.rank < a.rank THEN 'down' ELSE 'same' END AS status,
  b.rank - a.rank AS rank_change FROM b FULL JOIN a ON a."user" = b."user" AND a.item = b.item""")
def before_after(spark, sf):
    p = D.prepared(spark, sf)
    n_users, _ = p.sizes()
    before = recommend.recommend(p.vectors(), n_users, 10, seen=p.part("train"))
    after = recommend.recommend(p.vectors(), n_users, 10, seen=p.part("train").unionByName(p.part("val")))
    rows = recommend.compare(before, after)
    return rows.select("user", "item", *[F.col(c).cast("long").alias(c) for c in ("rank_before", "rank_after")],
                       "status", F.col("rank_change").cast("long").alias("rank_change"))


# ---------------------------------------------------------------- evaluation

@query("item_popularity", "A7", f"""WITH {S.PREPARED}, {S.PARTS} SELECT item, count(*) AS n FROM train_part GROUP BY item""")
def item_popularity(spark, sf):
    return baselines.item_popularity(D.prepared(spark, sf).part("train"))


@query("relevant_sets", "A8 P11", f"""WITH {S.PREPARED}, {S.PARTS} SELECT "user", count(DISTINCT item) FILTER (WHERE rating >= 4.0) AS n_rel,
  count(DISTINCT item) AS n_all FROM test_part GROUP BY "user" HAVING count(DISTINCT item) FILTER (WHERE rating >= 4.0) > 0""")
def relevant_sets(spark, sf):
    return evaluate.eval_users(D.prepared(spark, sf).part("test"), D.RELEVANT_FROM)


def _ranked(spark, sf, k=20):
    p = D.prepared(spark, sf)
    test_users = p.part("test").filter(F.col("rating") >= D.RELEVANT_FROM).select("user")
    return p, recommend.recommend(p.vectors(), p.sizes()[0], k, users=test_users, seen=p.part("train"))


EVAL = f"""{S.VECTORS}, {S.PARTS}, {S.top_k(20)}"""


@query("user_metrics", "M1 W5 F18", f"""WITH {EVAL}, {S.user_metrics()} SELECT "user", k, {S.r6('"P"')} AS "P", {S.r6('"R"')} AS "R", {S.r6('"F1"')} AS "F1",
  {S.r6('"NDCG"')} AS "NDCG", {S.r6('"MRR"')} AS "MRR", {S.r6('"HR"')} AS "HR", {S.r6('"AP"')} AS "AP" FROM per_user""")
def user_metrics(spark, sf):
    p, ranked = _ranked(spark, sf)
    return _rounded(evaluate.user_metrics(ranked, p.part("test"), KS, D.RELEVANT_FROM))


@query("model_ranking_metrics", "M2 A9", f"WITH {EVAL}, {S.user_metrics()} {S.mean_metrics()}")
def model_ranking_metrics(spark, sf):
    p, ranked = _ranked(spark, sf)
    return _rounded(evaluate.ranking_metrics(ranked, p.part("test"), KS, D.RELEVANT_FROM))


@query("k_filtered_metrics", "M3", f"WITH {EVAL}, {S.user_metrics(k_filter=True)} {S.mean_metrics()}")
def k_filtered_metrics(spark, sf):
    p, ranked = _ranked(spark, sf)
    return _rounded(evaluate.ranking_metrics(ranked, p.part("test"), KS, D.RELEVANT_FROM, k_filter=True))


@query("capped_eval_users", "T11", f"""WITH {S.PREPARED}, {S.PARTS} SELECT DISTINCT "user" FROM test_part WHERE rating >= 4.0 ORDER BY "user" LIMIT 5000""")
def capped_eval_users(spark, sf):
    return evaluate.eval_users(D.prepared(spark, sf).part("test"), D.RELEVANT_FROM, 5000).select("user")


@query("first_eval_users", "T11", f"""WITH {S.PREPARED}, {S.PARTS} SELECT DISTINCT "user" FROM test_part WHERE rating >= 4.0 ORDER BY "user" LIMIT 20""")
def first_eval_users(spark, sf):
    """A cap below the number of users."""
    return evaluate.eval_users(D.prepared(spark, sf).part("test"), D.RELEVANT_FROM, 20).select("user")


POPULAR = """ranked AS (SELECT u."user", t.item, t.rank FROM (SELECT DISTINCT "user" FROM test_part) u, (
  SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) AS rank FROM train_part GROUP BY item) t WHERE t.rank <= 20)"""


@query("popularity_baseline", "M5", f"WITH {S.PREPARED}, {S.PARTS}, {POPULAR}, {S.user_metrics()} {S.mean_metrics()}")
def popularity_baseline(spark, sf):
    p = D.prepared(spark, sf)
    return _rounded(baselines.popularity_metrics(p.part("train"), p.part("test"), KS, D.RELEVANT_FROM))


RANDOM = f"""drawn_items AS (SELECT "user", i, CASE WHEN i < {20 + baselines.SPARE_DRAWS} THEN {S.h60('random42', '"user"', 'i')} % ni
    ELSE ({S.h60('random42', '"user"', '0')} + i - {19 + baselines.SPARE_DRAWS}) % ni END AS item, ni
  FROM (SELECT DISTINCT "user" FROM test_part), range({40 + baselines.SPARE_DRAWS}) r(i), size WHERE i < {20 + baselines.SPARE_DRAWS} + least(20, ni)),
ranked AS (SELECT "user", item, rank FROM (SELECT "user", item, any_value(ni) AS ni, row_number() OVER (PARTITION BY "user" ORDER BY min(i)) AS rank
  FROM drawn_items GROUP BY "user", item) WHERE rank <= least(20, ni))"""


@query("random_baseline", "M6", f"WITH {S.PREPARED}, {S.PARTS}, {RANDOM}, {S.user_metrics()} {S.mean_metrics()}")
def random_baseline(spark, sf):
    p = D.prepared(spark, sf)
    return _rounded(baselines.random_metrics(p.part("test"), p.sizes()[1], KS, D.RELEVANT_FROM))


IDEAL = """ideal AS (SELECT CAST(k AS BIGINT) AS k, avg(least(n_rel, k)/CAST(k AS DOUBLE)) AS "P", avg(least(n_rel, k)/CAST(n_rel AS DOUBLE)) AS "R"
  FROM (SELECT "user", count(DISTINCT item) AS n_rel FROM test_part WHERE rating >= 4.0 GROUP BY "user"), (SELECT unnest([5,10,20]) AS k) GROUP BY k)"""


@query("ideal_metrics", "A20", f"""WITH {S.PREPARED}, {S.PARTS}, {IDEAL}
SELECT k, m.metric, {S.r6('''CASE m.metric WHEN 'P' THEN "P" WHEN 'R' THEN "R" ELSE 1.0 END''')} AS ideal FROM ideal, (SELECT unnest(['P','R','HR','NDCG','MRR','MAP']) AS metric) m""")
def ideal_metrics(spark, sf):
    return _rounded(evaluate.ideal_metrics(D.prepared(spark, sf).part("test"), KS, D.RELEVANT_FROM))


def _means_long(per_user: str, out: str) -> str:
    """(k, metric, value) means of a per-user metric table."""
    means = ", ".join(f'avg("{m}") AS "{"MAP" if m == "AP" else m}"' for m in ("P", "R", "HR", "NDCG", "MRR", "AP"))
    return f"""{out}_wide AS (SELECT k, {means} FROM {per_user} GROUP BY k),
{out} AS (UNPIVOT {out}_wide ON "P","R","HR","NDCG","MRR","MAP" INTO NAME metric VALUE value)"""


@query("normalized_metrics", "M7 F22", f"""WITH {EVAL}, {IDEAL}, {S.user_metrics()}, {_means_long('per_user', 'model')},
{RANDOM.replace('ranked AS', 'drawn AS')}, {S.user_metrics(ranked='drawn', tag='_r')}, {_means_long('per_user_r', 'rand')},
j AS (SELECT k, metric, m.value, r.value AS baseline, CASE metric WHEN 'P' THEN i."P" WHEN 'R' THEN i."R" ELSE 1.0 END AS ideal
  FROM model m JOIN rand r USING (k, metric) JOIN ideal i USING (k))
SELECT k, metric, {S.even('value*100.0::DOUBLE', 4)} AS pct, CASE WHEN baseline > 1e-9 THEN {S.even('value/baseline', 3)} END AS lift,
  CASE WHEN ideal-baseline > 1e-9 THEN {S.even('(value-baseline)/(ideal-baseline)*100.0::DOUBLE', 2)} END AS norm FROM j""")
def normalized_metrics(spark, sf):
    p, ranked = _ranked(spark, sf)
    test = p.part("test")
    model = materialize(evaluate.ranking_metrics(ranked, test, KS, D.RELEVANT_FROM), "metrics")
    rand = materialize(baselines.random_metrics(test, p.sizes()[1], KS, D.RELEVANT_FROM), "metrics")
    return evaluate.normalize_metrics(model, rand, test, KS, D.RELEVANT_FROM)


@query("score_evaluation", "M4 A21 A22 F15", f"""WITH {S.VECTORS}, {S.PARTS},
k AS (SELECT rating, 1.0::DOUBLE/(1.0::DOUBLE+exp(-list_inner_product(u.v, i.v))) AS s FROM test_part JOIN uvec u USING ("user") JOIN ivec i USING (item)),
neg AS (SELECT {S.h60('u42', 'id')} % nu AS "user", {S.h60('i42', 'id')} % ni AS item FROM (SELECT unnest(range((SELECT count(*) FROM test_part))) AS id), size),
f AS (SELECT count(*) AS n FROM neg JOIN uvec u USING ("user") JOIN ivec i USING (item) WHERE 1.0::DOUBLE/(1.0::DOUBLE+exp(-list_inner_product(u.v, i.v))) >= 0.5)
SELECT {S.r6('sqrt(avg(pow(4.0::DOUBLE*s+1.0::DOUBLE-rating, 2)))')} AS rmse, {S.r6('avg(abs(4.0::DOUBLE*s+1.0::DOUBLE-rating))')} AS mae,
  {S.r6('avg(CASE WHEN (rating >= 4.0) = (s >= 0.5) THEN 1.0::DOUBLE ELSE 0.0 END)')} AS accuracy,
  {S.r6('count(*) FILTER (WHERE rating >= 4.0 AND s >= 0.5)/CAST(count(*) FILTER (WHERE s >= 0.5) + (SELECT n FROM f) AS DOUBLE)')} AS global_precision FROM k""")
def score_evaluation(spark, sf):
    p = D.prepared(spark, sf)
    n_users, n_items = p.sizes()
    test = p.part("test").select(F.col("user").alias("user_id"), (F.col("item") + n_users).alias("item_id"), "rating")
    return _rounded(evaluate.evaluate_scores(test, p.vectors(), n_users, n_items, D.RELEVANT_FROM, dim=D.DIM))


@query("metric_sanity", "M16", f"""WITH {S.PREPARED}, {S.PARTS}, {POPULAR}, {S.user_metrics()},
m AS (SELECT k, avg("P") AS "P", avg("R") AS "R", avg("NDCG") AS "NDCG", avg("HR") AS "HR", count(*) AS n FROM per_user GROUP BY k),
broken AS (SELECT 'none' AS spoilt, k, "P", "R", "NDCG", "HR", n, 1.0 AS rmse, 0.5 AS mae FROM m
  UNION ALL SELECT 'P', k, "P"+1.0/k, "R", "NDCG", "HR"/1e6, n, 1.0, 0.5 FROM m UNION ALL SELECT 'R', k, "P", "R"+1.0, "NDCG", "HR", n, 1.0, 0.5 FROM m
  UNION ALL SELECT 'NDCG', k, "P", "R", "NDCG"+1.0, "HR", n, 1.0, 0.5 FROM m UNION ALL SELECT 'hits', k, "P"+0.3/(k*n), "R", "NDCG", "HR"+1.0, n, 1.0, 0.5 FROM m
  UNION ALL SELECT 'errors', k, "P", "R", "NDCG", "HR", n, 0.5, 1.0 FROM m),
laws AS (SELECT spoilt, k, 'P<=HR' AS law, "P" > "HR"+1e-9 AS bad FROM broken UNION ALL SELECT spoilt, k, 'R<=HR', "R" > "HR"+1e-9 FROM broken
  UNION ALL SELECT spoilt, k, 'NDCG<=HR', "NDCG" > "HR"+1e-9 FROM broken
  UNION ALL SELECT spoilt, k, 'P*K*n integer', abs("P"*k*n - round("P"*k*n)) > 1e-6 FROM broken UNION ALL SELECT spoilt, k, 'RMSE>=MAE', mae > rmse+1e-9 FROM broken)
SELECT spoilt, k, law FROM laws WHERE bad""")
def metric_sanity(spark, sf):
    """The laws on the metrics of the popularity baseline: as they are, and with one value spoilt for each law."""
    p = D.prepared(spark, sf)
    table = materialize(baselines.popularity_metrics(p.part("train"), p.part("test"), KS, D.RELEVANT_FROM), "metrics")
    fine = table.select("k", "P", "R", "NDCG", "HR", "n_eval_users", F.lit(1.0).alias("rmse"), F.lit(0.5).alias("mae"))
    c = F.col
    spoilt = {"none": {}, "P": {"P": c("P") + 1.0 / c("k"), "HR": c("HR") / 1e6}, "R": {"R": c("R") + 1.0},
              "NDCG": {"NDCG": c("NDCG") + 1.0}, "hits": {"P": c("P") + 0.3 / (c("k") * c("n_eval_users")), "HR": c("HR") + 1.0},
              "errors": {"rmse": F.lit(0.5), "mae": F.lit(1.0)}}
    rows = None
    for name, change in spoilt.items():
        part = fine.withColumns(change).withColumn("spoilt", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return evaluate.sanity_violations(rows).select("spoilt", "k", "law")
