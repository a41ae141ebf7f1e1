"""User-item graph: edges, weights, normalisation and message passing.

Edges are ``(src, dst, w)`` over one node space where items follow the users. Node
vectors are ``(node, v)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vectors as V
from ..functions.hashing import hash32, hash60, uniform, xavier_bound
from ..functions.numeric import temporal_weight
from ..session import materialize
from .clean import rating_filter
from .scoring import nearest_items


# ---------------------------------------------------------------- edges

def ui_edges(interactions: DataFrame, threshold: int = 3) -> DataFrame:
    """Directed user -> item edges of ratings that reach the threshold."""
    return rating_filter(interactions, threshold).select(
        F.col("user_id").alias("src"), F.col("item_id").alias("dst"), F.col("rating"))


def both_directions(edges: DataFrame) -> DataFrame:
    """Edges and their reverses."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others)
    return edges.unionByName(reverse)


def item_item_edges(items: DataFrame, k: int = 5) -> DataFrame:
    """Edges between every item node and its ``k`` most similar items, both ways, weight 1."""
    pairs = nearest_items(items, k).select(F.col("item").alias("src"),
                                           F.col("neighbour").alias("dst"))
    return both_directions(pairs).withColumn("w", F.lit(1.0))


def training_graph(train: DataFrame, as_of: Column, decay_days: float = 365.0,
                   item_edges: DataFrame | None = None) -> DataFrame:
    """Graph of the training rows (user_id, item_id node, rating, date): both directions with
    age-weighted ratings, plus item-item edges if given."""
    weighted = train.select(F.col("user_id").alias("src"), F.col("item_id").alias("dst"),
                            temporal_weight("rating", "date", as_of, decay_days).alias("w"))
    graph = both_directions(weighted)
    return graph if item_edges is None else graph.unionByName(item_edges.select("src", "dst", "w"))


def degrees(edges: DataFrame) -> DataFrame:
    """Number of incoming edges per node (nodes without any are absent)."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def symmetric_norm(edges: DataFrame) -> DataFrame:
    """Edges with ``1 / sqrt(degree(src) * degree(dst))``; degrees below 1 count as 1."""
    deg = degrees(edges)
    src = deg.select(F.col("node").alias("src"), F.col("degree").alias("_ds"))
    dst = deg.select(F.col("node").alias("dst"), F.col("degree").alias("_dd"))
    at_least_one = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1))
    return (edges.join(src, "src", "left").join(dst, "dst", "left")
            .withColumn("norm", F.lit(1.0) / F.sqrt(at_least_one("_ds") * at_least_one("_dd")))
            .drop("_ds", "_dd"))


# ---------------------------------------------------------------- node vectors

def initial_vectors(nodes: DataFrame, dim: int, n_nodes: Column | int, seed: int = 42) -> DataFrame:
    """Xavier-uniform start vectors that depend on (node, component, seed) only."""
    count = F.lit(n_nodes) if isinstance(n_nodes, int) else n_nodes
    bound = F.sqrt(F.lit(6.0) / (count + F.lit(dim)))
    # ids are small but each costs dim hashes: deal them out to all cores first
    return V.dealt(nodes.select("node"), "node").select("node", F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: (uniform(seed, "node", i) * 2.0 - 1.0) * bound).alias("v"))


def node_table(user_ids: DataFrame, item_ids: DataFrame) -> DataFrame:
    """All nodes of the graph: users first, items after them."""
    from .encode import item_node
    return (user_ids.select(F.col("user_idx").alias("node"))
            .unionByName(item_ids.select(item_node("item_idx", user_ids).alias("node"))))


def warm_start(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the vectors of the nodes in ``new``; the others stay."""
    replacement = new.select("node", F.col("v").alias("_new"))
    return (vectors.join(replacement, "node", "left")
            .select("node", F.coalesce("_new", "v").alias("v")))


def project(df: DataFrame, out_dim: int, seed: int = 42, in_dim: int | None = None) -> DataFrame:
    """Linear map of ``v`` to ``out_dim`` components with a seeded Xavier-uniform matrix."""
    from ..functions.hashing import xavier_matrix
    size = in_dim or len(df.select("v").first()["v"])
    return df.withColumn("v", V.matvec(xavier_matrix(out_dim, size, seed))("v"))


# ---------------------------------------------------------------- message passing

# bytes of sums that one task should hold, about
SUM_BYTES = 512 * 1024 * 1024


def _ranges(edges: DataFrame, dim: int, n_nodes: int, sums: int = 1) -> int:
    """Number of ranges of ``n_nodes`` ids."""
    return max(edges.sparkSession.sparkContext.defaultParallelism, math.ceil(n_nodes * sums * (dim + 6) * 8 / SUM_BYTES))


def _range_of(node: str, blocks: int, n_nodes: int, low: int) -> Column:
    at = F.floor((F.col(node) - F.lit(low)) * F.lit(float(blocks)) / F.lit(float(n_nodes)))
    return F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(blocks - 1)), F.lit(0)).cast("int")


def meet_vectors(edges: DataFrame, vectors: DataFrame, dim: int, n_nodes: int, sums: int = 1, low: int = 0) -> DataFrame:
    """Edges with the vector of their source, ``_block, dst, ..., v``; those into one node lie in one partition.

    Nodes are cut into ranges by id, and a vector is sent once to each range that its node has edges into, with
    these edges as one array. So the shuffle grows with nodes times ranges met, which are few, and not with
    edges; a grouping by ``_block`` and ``dst`` needs no other. ``sums`` is the number of vectors kept for a node.
    Destinations are the ``n_nodes`` ids from ``low`` on.
    """
    blocks = _ranges(edges, dim, n_nodes, sums)
    rest = [c for c in edges.columns if c != "src"]
    # edges that lie by source are listed and meet its vector without another shuffle
    lists = (edges.repartition("src").groupBy("src", _range_of("dst", blocks, n_nodes, low).alias("_block"))
             .agg(F.collect_list(F.struct(*rest)).alias("_edges"))
             .select("src", "_block", *[F.col("_edges")[c].alias(c) for c in rest]))
    # vectors are known to be large, and Spark takes those that are computed here for a fraction of their size: no broadcast
    sent = lists.join(vectors.select(F.col("node").alias("src"), "v").hint("merge"), "src").select("src", "_block", *rest, "v")
    return (sent.repartitionById(blocks, "_block").select("src", "_block", F.explode(F.arrays_zip(*rest)).alias("_e"), "v")
            .select("src", "_block", "_e.*", "v"))


def meet_both(pairs: DataFrame, vectors: DataFrame, dim: int, n_nodes: int, low: int) -> DataFrame:
    """Pairs (src, dst, ...) with the vectors ``u`` and ``i`` of both ends; ``dst`` are the ``n_nodes`` ids from ``low`` on.

    A source's vector goes to each range of destinations once, and there meets the vectors of the range, which
    are built into a hash table: no vector is shuffled or sorted along pairs. Pairs that lie by source are not shuffled
    before they are sent.
    """
    blocks = _ranges(pairs, dim, n_nodes)
    ends = vectors.filter(F.col("node") >= low).select(_range_of("node", blocks, n_nodes, low).alias("_block"), F.col("node").alias("dst"), F.col("v").alias("i"))
    met = meet_vectors(pairs, vectors, dim, n_nodes, low=low).withColumnRenamed("v", "u")
    return met.join(ends.repartitionById(blocks, "_block").hint("shuffle_hash"), ["_block", "dst"]).drop("_block")


def sum_messages(edges: DataFrame, vectors: DataFrame, dim: int, how=F.sum,
                 weight: str | None = None, n_nodes: int | None = None) -> DataFrame:
    """Aggregate (optionally weighted) source vectors at each destination: (node, m).

    Partial sums are built before the shuffle, so a node with very many edges costs one
    row per map task; a source with very many edges is split by AQE's skew join. With
    ``n_nodes`` known and small, the vectors are broadcast and edges stay in place; known and
    large, vectors are sent to ranges of destinations (:func:`meet_vectors`).
    """
    part = lambda c: how(c if weight is None else c * F.col(weight))
    narrow = edges.select("src", "dst", *([weight] if weight else []))
    if n_nodes is None or V.fits(n_nodes, dim):
        side = V.small_side(vectors.select(F.col("node").alias("src"), "v"), n_nodes, dim)
        sums = narrow.join(side, "src").groupBy("dst").agg(*V.component_aggs("v", dim, part))
    else:
        kept = 1 if how is F.sum else 2  # a mean keeps a count beside each sum
        sums = meet_vectors(narrow, vectors, dim, n_nodes, kept).groupBy("_block", "dst").agg(*V.component_aggs("v", dim, part))
    return sums.select(F.col("dst").alias("node"), V.pack(dim).alias("m"))


def lightgcn(vectors: DataFrame, edges: DataFrame, dim: int, layers: int = 1,
             weight: str | None = None, n_nodes: int | None = None,
             degree: DataFrame | None = None) -> DataFrame:
    """Mean of layers 0..L of symmetric-normalised propagation.

    The source part of the norm is folded into the vectors and the destination part
    into the sums, so edges carry no weights and no degrees are joined to them. ``degree``
    saves counting the degrees of edges that are propagated over again and again.
    """
    deg = degrees(edges) if degree is None else degree
    root = F.sqrt(F.greatest(F.coalesce(F.col("degree"), F.lit(1)), F.lit(1)).cast("double"))
    state = vectors.join(deg, "node", "left").select("node", root.alias("root"), F.col("v").alias("x"))
    # every layer reads the state twice: as messages and as the nodes that receive them
    state = materialize(state, "lightgcn")
    for layer in range(layers):
        scaled = state.select("node", F.transform("x", lambda c: c / F.col("root")).alias("v"))
        incoming = sum_messages(edges, scaled, dim, weight=weight, n_nodes=n_nodes)
        x = F.transform(F.coalesce(F.col("m"), V.zeros(dim)), lambda c: c / F.col("root"))
        acc = "acc" if layer else "x"
        state = (state.join(incoming, "node", "left")
                 .select("node", "root", x.alias("x"), F.col(acc).alias("acc"))
                 .select("node", "root", "x", V.add("acc", "x").alias("acc")))
        if layer + 1 < layers:
            state = materialize(state, "lightgcn")
    return state.select("node", F.transform("acc" if layers else "x", lambda c: c / F.lit(float(layers + 1))).alias("v"))


def neighbour_mean(vectors: DataFrame, edges: DataFrame, dim: int, n_nodes: int | None = None) -> DataFrame:
    """Mean source vector per destination node; nodes without incoming edges are absent."""
    return sum_messages(edges, vectors, dim, how=F.avg, n_nodes=n_nodes)


def sage(vectors: DataFrame, edges: DataFrame, dim: int, weights: list[dict],
         residual: bool = True, n_nodes: int | None = None) -> DataFrame:
    """SAGE forward pass with given weights ``[{"neighbour", "self", "bias"}, ...]`` per layer."""
    x = materialize(vectors.select("node", "v"), "sage")
    for i, layer in enumerate(weights):
        last = i == len(weights) - 1
        base = x.join(neighbour_mean(x, edges, dim, n_nodes), "node", "left")
        from_neighbours = V.matvec(layer["neighbour"], layer["bias"])
        from_self = V.matvec(layer["self"])
        h = base.select("node", "v", from_neighbours(F.coalesce(F.col("m"), V.zeros(dim))).alias("_n"),
                        from_self("v").alias("_s"))
        out = V.add("_n", "_s")
        if not last:
            out = F.transform(out, lambda c: F.greatest(c, F.lit(0.0)))
        h = h.select("node", "v", out.alias("h"))
        x = h.select("node", (V.add("h", "v") if residual else F.col("h")).alias("v"))
        if not last:
            x = materialize(x, "sage")
    return x


def _leaky(x: Column, slope: float = 0.2) -> Column:
    return F.when(x > 0, x).otherwise(x * F.lit(slope))


def edge_softmax(scores: DataFrame, score: str = "e") -> DataFrame:
    """``alpha = exp(e - max) / sum(exp(e - max))`` over the edges into each ``dst``.

    Two partial aggregations and joins instead of a window: the edges of a very
    popular destination never meet in one task.
    """
    top = scores.groupBy("dst").agg(F.max(score).alias("_top"))
    shifted = scores.join(top, "dst").withColumn("_exp", F.exp(F.col(score) - F.col("_top")))
    total = shifted.groupBy("dst").agg(F.sum("_exp").alias("_sum"))
    return (shifted.join(total, "dst").withColumn("alpha", F.col("_exp") / F.col("_sum"))
            .drop("_top", "_exp", "_sum"))


def _over(vector: Column, number: Column) -> Column:
    return F.transform(vector, lambda x: x / number)


def gat(vectors: DataFrame, edges: DataFrame, dim: int, weights: list[dict],
        residual: bool = True, n_nodes: int | None = None) -> DataFrame:
    """GAT forward pass, heads averaged, with given weights per layer.

    ``weights[i]`` holds ``heads``: a list of {"matrix", "src", "dst"}, and ``bias``. Each
    node attends to itself as well. Head outputs are linear in the source vectors, so the
    attention average is taken over raw vectors and the matrix applied once per node.
    """
    import numpy as np

    nodes = vectors.select("node")
    loops = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    links = edges.select("src", "dst").filter(F.col("src") != F.col("dst")).unionByName(loops)
    x = vectors
    for i, layer in enumerate(weights):
        last = i == len(weights) - 1
        heads = layer["heads"]
        n_heads = len(heads)
        # attention terms are scalars per node and head: (a . W) x
        a_src = [(np.asarray(h["src"]) @ np.asarray(h["matrix"])).tolist() for h in heads]
        a_dst = [(np.asarray(h["dst"]) @ np.asarray(h["matrix"])).tolist() for h in heads]
        terms = materialize(x.select("node", "v", V.matvec(a_src)("v").alias("s"),
                                     V.matvec(a_dst)("v").alias("t")), "gat")
        src = terms.select(F.col("node").alias("src"), "s")
        # leaky-relu is monotone: the largest edge score per node follows from the largest s
        top = (links.join(src, "src").groupBy("dst")
               .agg(*[F.max(F.col("s")[h]).alias(f"_top{h}") for h in range(n_heads)]))
        dst = (terms.select(F.col("node").alias("dst"), "t").join(top, "dst")
               .select("dst", "t", F.array(*[_leaky(F.col(f"_top{h}") + F.col("t")[h])
                                             for h in range(n_heads)]).alias("peak")))
        # attention on narrow rows; vectors come in only where they are summed, head by head, so
        # that an aggregate has dim columns and stays in generated code
        scored = materialize(links.join(src, "src").join(dst, "dst").select(
            "src", "dst", *[F.exp(_leaky(F.col("s")[h] + F.col("t")[h]) - F.col("peak")[h]).alias(f"_e{h}")
                            for h in range(n_heads)]), "attention")
        # heads end to end: one matrix [W_1 .. W_H] / H finishes the layer
        if n_nodes is None or V.fits(n_nodes, dim):
            joined = scored.groupBy(F.col("dst").alias("node")).agg(*[F.sum(f"_e{h}").alias(f"_z{h}") for h in range(n_heads)])
            for h in range(n_heads):
                weighted = sum_messages(scored.select("src", "dst", F.col(f"_e{h}").alias("w")), terms.select("node", "v"), dim,
                                        weight="w", n_nodes=n_nodes)
                joined = joined.join(weighted.withColumnRenamed("m", f"_m{h}"), "node")
            joined = joined.select("node", F.concat(*[_over(F.col(f"_m{h}"), F.col(f"_z{h}")) for h in range(n_heads)]).alias("_a"))
        else:
            # a vector is sent once for all heads, and a row per head and edge is summed where it arrives
            met = meet_vectors(scored, terms.select("node", "v"), dim, n_nodes, n_heads)
            each = met.select("_block", "dst", F.posexplode(F.array(*[F.col(f"_e{h}") for h in range(n_heads)])).alias("_h", "_w"), "v")
            sums = each.groupBy("_block", "dst", "_h").agg(F.sum("_w").alias("_z"), *V.component_aggs("v", dim, lambda c: F.sum(c * F.col("_w"))))
            heads_of = sums.select("_block", "dst", F.struct("_h", _over(V.pack(dim), F.col("_z")).alias("a")).alias("_s"))
            joined = heads_of.groupBy("_block", "dst").agg(F.sort_array(F.collect_list("_s")).alias("_s")).select(
                F.col("dst").alias("node"), F.flatten(F.col("_s.a")).alias("_a"))
        stacked = (np.hstack([np.asarray(h["matrix"]) for h in heads]) / n_heads).tolist()
        out = V.matvec(stacked, layer["bias"])("_a")
        h_out = joined.select("node", out.alias("h"))
        if not last:
            h_out = h_out.select("node", F.transform(
                "h", lambda c: F.when(c > 0, c).otherwise(F.expm1(c))).alias("h"))
        x = terms.select("node", "v").join(h_out, "node").select(
            "node", (V.add("h", "v") if residual else F.col("h")).alias("v"))
        if not last:
            x = materialize(x, "gat")
    return x


def pair_scores(pairs: DataFrame, vectors: DataFrame, n_users: int | None = None, n_items: int | None = None, dim: int = 64) -> DataFrame:
    """Dot product of both ends of every (user_id, item_id node) pair.

    With ``n_users`` and ``n_items`` known and large, vectors are sent to ranges of items, not along pairs.
    """
    if n_items is None or V.fits(n_users + n_items, dim):
        u = vectors.select(F.col("node").alias("user_id"), F.col("v").alias("_u"))
        i = vectors.select(F.col("node").alias("item_id"), F.col("v").alias("_i"))
        return (pairs.join(u, "user_id").join(i, "item_id")
                .withColumn("score", V.dot("_u", "_i")).drop("_u", "_i"))
    met = meet_both(pairs.withColumnsRenamed({"user_id": "src", "item_id": "dst"}).repartition("src"), vectors, dim, n_items, n_users)
    rest = [c for c in pairs.columns if c not in ("user_id", "item_id")]
    return met.select(F.col("dst").alias("item_id"), F.col("src").alias("user_id"), *rest, V.dot("u", "i").alias("score"))


# ---------------------------------------------------------------- sampling

def sample_neighbours(edges: DataFrame, seeds: DataFrame, fan_out: tuple[int, ...] = (15, 10),
                      seed: int = 42) -> DataFrame:
    """Edges met when every frontier node keeps at most ``fan_out[hop]`` random in-edges.

    Returns (hop, src, dst). The rank limit is applied per map task before the shuffle.
    """
    frontier = seeds.select(F.col("node").alias("dst")).distinct()
    hops = None
    for hop, limit in enumerate(fan_out):
        drawn = edges.select("src", "dst").join(frontier, "dst", "left_semi") \
                     .withColumn("_h", hash32(f"{seed}-{hop}", "src", "dst"))
        rank = F.row_number().over(Window.partitionBy("dst").orderBy("_h", "src"))
        kept = (drawn.withColumn("_r", rank).filter(F.col("_r") <= limit)
                .select(F.lit(hop).alias("hop"), "src", "dst"))
        if hop + 1 < len(fan_out):
            kept = materialize(kept, "neighbours")
            frontier = kept.select(F.col("src").alias("dst")).distinct()
        hops = kept if hops is None else hops.unionByName(kept)
    return hops


# positives that a row carries along to test its draws
CARRIED = 1_000


def sample_negatives(pairs: DataFrame, positives: DataFrame, n_items: int, n_neg: int = 10,
                     rounds: int = 5, seed: int | str = 42) -> DataFrame:
    """``n_neg`` random items per (user_idx, item_idx) pair that the user has not chosen.

    Each slot draws once and redraws up to ``rounds`` times while it hits a positive; the
    last draw is kept if all hit. Pairs meet the list of their user's positives, and draws are tested
    where they are made, so no draw is shuffled or written. Draws of users with more than
    ``CARRIED`` positives are tested in a join instead.
    """
    draw = lambda r: F.pmod(hash60(seed, "user_idx", "item_idx", "slot", F.lit(r)), F.lit(n_items).cast("long"))
    names = ["user_idx", "item_idx", "slot", "neg_idx"]
    slots_of = lambda df: df.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_neg - 1))))
    width = V.width(pairs)
    dealt = pairs.select("user_idx", "item_idx").repartition(width, "user_idx")
    if rounds < 1:
        return slots_of(V.dealt(pairs.select("user_idx", "item_idx"), "user_idx", "item_idx")).withColumn("neg_idx", draw(0)).select(*names)
    taken = positives.select("user_idx", "item_idx").repartition(width, "user_idx")
    many = taken.groupBy("user_idx").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CARRIED)
    many = materialize(many.select("user_idx"), "many")
    few = not many.isEmpty()
    if few:
        taken, dealt = (df.join(many, "user_idx", "left_anti") for df in (taken, dealt))
    lists = taken.groupBy("user_idx").agg(F.collect_set("item_idx").alias("_taken"))
    first = slots_of(dealt.join(lists, "user_idx", "left")).withColumn("_first", draw(0))
    hit = lambda c: F.coalesce(F.array_contains("_taken", c), F.lit(False))
    # a case is evaluated as far as it is needed: most slots draw once
    again = F.when(~hit(draw(1)), draw(1)) if rounds > 1 else F
    for r in range(2, rounds):
        again = again.when(~hit(draw(r)), draw(r))
    again = again.otherwise(draw(rounds)) if rounds > 1 else draw(1)
    free = first.select("user_idx", "item_idx", "slot", F.when(hit(F.col("_first")), again).otherwise(F.col("_first")).alias("neg_idx"))
    if not few:
        return free
    heavy = [df.join(many, "user_idx", "left_semi") for df in (pairs, positives)]
    return free.unionByName(_joined_negatives(slots_of(V.dealt(heavy[0].select("user_idx", "item_idx"), "user_idx", "item_idx")), heavy[1], draw, rounds))


def _joined_negatives(slots: DataFrame, positives: DataFrame, draw, rounds: int) -> DataFrame:
    """Draws for slots that are tested in a join: first draws are written, and only the few that hit go on."""
    taken = (positives.select("user_idx", F.col("item_idx").alias("neg_idx")).distinct()
             .withColumn("_hit", F.lit(True)))
    first = materialize(slots.withColumn("neg_idx", draw(0)).join(taken, ["user_idx", "neg_idx"], "left"), "draws")
    names = ["user_idx", "item_idx", "slot", "neg_idx"]
    free = first.filter(F.col("_hit").isNull()).select(*names)
    again = first.filter("_hit").select("user_idx", "item_idx", "slot", F.posexplode(
        F.array(*[draw(r) for r in range(1, rounds + 1)])).alias("round", "neg_idx"))
    tested = again.join(taken, ["user_idx", "neg_idx"], "left")
    # first free redraw, else the last one; redraw order and item share one long, so the
    # minimum stays a hash aggregate with map-side combine
    order = F.when(F.col("_hit").isNull(), F.col("round")).otherwise(F.lit(2 * rounds) - F.col("round"))
    coded = F.shiftleft(order.cast("long"), 40) + F.col("neg_idx")
    redrawn = tested.groupBy("user_idx", "item_idx", "slot").agg(F.min(coded).alias("_best")).select(
        "user_idx", "item_idx", "slot", F.col("_best").bitwiseAND(F.lit((1 << 40) - 1)).alias("neg_idx"))
    return free.unionByName(redrawn)
