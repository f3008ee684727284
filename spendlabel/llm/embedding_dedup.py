"""Near-duplicate vectors by NN-descent.

Equal vectors are one class. Classes that lie within half the threshold's angle of one vector
form a ball around it: by the triangle inequality any two of them link, so a group of near
copies of any size is counted without looking at its pairs. Balls are found bottom up: rows in
the order of a random-hyperplane code, greedy centres within a stretch of bounded length, then
the centres again in the order of another code, until few are absorbed; a member stays in its
ball only if its own angle to the centre allows it.

Over the nodes that remain (centres and single classes) a neighbour graph is built by
NN-descent: lists begin with the nearest nodes in stretches of several random-hyperplane
orders; then, round by round, the neighbours of a node (both directions) are compared with
each other, and each keeps the nearest it has met. Where every entry of a list is near enough
to link, the list is saturated and doubles its length. Rounds end when few entries change and
no list is saturated. An audit compares up to ``AUDIT`` nodes with all others, in blocks; while
it finds too few of their links, further orders and rounds follow.

The search runs on sketches (one byte a dimension; at most ``SKETCH`` dimensions, by random
projection); every pair that may link is then decided by its cosine in double precision. Where
balls are involved, angle and radii decide all member pairs or none; what lies in between is
compared member by member, in blocks of both balls.

Edge cases. A vector that is null, empty, zero, or holds a null or non-finite entry: no link,
its own component, kept. Vectors of differing length are compared as if the shorter ended in
zeros. Null id: the row links like any other; its component is the least id reachable, null if
there is none, and it is kept only in the latter case. Repeated rows and ids: one row each,
linked with each other. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, ship
from .simhash import connected

COSINE = 0.9
NEIGHBOURS, ORDERS, STRETCH, GROUP = 10, 8, 96, 256
ROUNDS, AUDITS, AUDIT, RECALL, STALE = 12, 4, 1_000, 0.998, 0.01
SKETCH = 96
#: Members of a ball that are compared as one block.
BLOCK = 256
_EPS = 1e-9


# -- vectors in tasks --------------------------------------------------------------------

def units(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of unit length, zeros behind the shorter ones; scaled first, so that no square
    overflows."""
    out = np.zeros((len(vectors), dims))
    n = vectors.value_lengths().to_numpy()
    out[np.arange(dims) < n[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(1, keepdims=True, initial=np.finfo(float).tiny)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def _sketches(u: np.ndarray) -> np.ndarray:
    d = u.shape[1]
    if d > SKETCH:
        u = u @ np.random.default_rng(d).standard_normal((d, SKETCH))
    return np.rint(u * (127 / np.abs(u).max(1, keepdims=True))).astype(np.int8)


def _near(q: list[bytes] | np.ndarray) -> np.ndarray:
    """Unit rows of sketches."""
    if not isinstance(q, np.ndarray):
        q = np.frombuffer(b"".join(q), np.int8).reshape(len(q), -1)
    x = q.astype(np.float32)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _codes(q: np.ndarray, seed: int) -> np.ndarray:
    """63 sides of random hyperplanes a row."""
    planes = np.random.default_rng([seed, q.shape[1]]).standard_normal((q.shape[1], 63)).astype(np.float32)
    return (q.astype(np.float32) @ planes > 0).astype(np.int64) @ (1 << np.arange(62, -1, -1))


def _stretches(df: DataFrame, order: list[str], size: int, group: list[str], work: Callable, schema: str) -> DataFrame:
    """``work`` over runs of up to ``size`` neighbouring rows with equal ``group``, the table
    sorted by ``order`` and dealt by range, so no key is too large for a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            keys = [t[g].to_numpy() for g in group]
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            edge = np.append(np.flatnonzero(new), t.num_rows)
            cuts = [i for a, b in zip(edge[:-1], edge[1:]) for i in range(a, b, size)]
            if not last:  # the last run may go on
                cuts, rest = cuts[:-1], cuts[-1]
                held[:] = t.slice(rest).to_batches()
                t = t.slice(0, rest)
            else:
                held.clear()
            if t.num_rows:
                yield from work(t, np.append(cuts, t.num_rows))

        for b in batches:
            if b.num_rows:
                held.append(b)
                if sum(x.num_rows for x in held) >= 20_000:
                    yield from done(False)
        if held:
            yield from done(True)

    return df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


# -- balls -------------------------------------------------------------------------------

def _centres(nodes: DataFrame, seed: int, cosine: float) -> DataFrame:
    """(node, centre) of ``nodes`` (node, q): greedy centres within stretches of one order."""
    def work(t: pa.Table, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, q = t["node"].to_numpy(), t["q"].to_pylist()
        centre = node.copy()
        for a, b in zip(edge[:-1], edge[1:]):
            u = _near(q[a:b])
            near = u @ u.T >= cosine
            free, own = np.ones(b - a, bool), centre[a:b]
            for i in np.flatnonzero(near.sum(1) > 1):
                if free[i]:
                    take = near[i] & free
                    own[take] = node[a + i]
                    free &= ~take
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(centre)], ["node", "centre"])

    return _stretches(_coded(nodes, [seed]), ["code", "node"], 1024, [], work, "node long, centre long")


def _coded(nodes: DataFrame, seeds: list[int]) -> DataFrame:
    """(tree, code, node, q): a row for each node and order."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = np.frombuffer(b"".join(column(b, "q").to_pylist()), np.int8).reshape(b.num_rows, -1)
                for s in seeds:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, s, np.int32)), pa.array(_codes(q, s)),
                                                      column(b, "node"), column(b, "q")], ["tree", "code", "node", "q"])

    return cut(nodes.select("node", "q").mapInArrow(code, "tree int, code long, node long, q binary"), "codes")


def balls(classes: DataFrame, cosine: float, dims: int) -> DataFrame:
    """(node, centre, angle): each class of ``classes`` (node, v, q) and the centre of its ball;
    a class by itself is its own centre."""
    half = float(np.arccos(cosine)) / 2 - _EPS
    levels, left, n = [], classes.select("node", "q"), classes.count()
    while n > 1:
        level = cut(_centres(left, 1_000 + len(levels), float(np.cos(half))), "centres")
        kept = level.where("node = centre")
        now = kept.count()
        if now < n:
            levels.append(level)
        if now > 0.98 * n:
            break
        left, n = cut(left.join(kept.select("node"), "node", "left_semi"), "left"), now
    if not levels:
        return classes.select("node", F.col("node").alias("centre"), F.lit(0.0).alias("angle"))
    # from the last level down, each centre with its vector: no key has more rows than a stretch
    top = levels[-1].where("node = centre").select("centre").join(
        classes.select(F.col("node").alias("centre"), F.col("v").alias("c")), "centre")
    for level in reversed(levels):
        far = top.toDF("above", "top", "c") if "top" in top.columns else top.select(F.col("centre").alias("above"), F.col("centre").alias("top"), "c")
        top = level.join(far, level["centre"] == far["above"]).select("node", "top", "c")
    moved = classes.select("node", "v").join(top.where("node <> top"), "node")

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cos = (units(column(b, "v"), dims) * units(column(b, "c"), dims)).sum(1)
            yield pa.RecordBatch.from_arrays([column(b, "node"), column(b, "top"), pa.array(np.arccos(np.clip(cos, -1, 1)))],
                                             ["node", "centre", "angle"])

    members = cut(moved.mapInArrow(angles, "node long, centre long, angle double").where(F.col("angle") <= half), "members")
    single = classes.select("node").join(members.select("node"), "node", "left_anti")
    return members.unionByName(single.select("node", F.col("node").alias("centre"), F.lit(0.0).alias("angle")))


# -- the neighbour graph -----------------------------------------------------------------

_PAIRS = "u long, v long, s float"


def _pairs(node: np.ndarray, at: list, sims: list) -> pa.RecordBatch:
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*at)) if at else (np.zeros(0, np.int64),) * 2
    s = np.concatenate([np.zeros(0, np.float32), *sims])
    return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(s)], ["u", "v", "s"])


def _start(nodes: DataFrame, seeds: list[int], k: int) -> DataFrame:
    """(u, v, s): the ``k`` nearest nodes of each in its stretch of every order."""
    def work(t: pa.Table, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, q, at, sims = t["node"].to_numpy(), t["q"].to_pylist(), [], []
        for a, b in zip(edge[:-1], edge[1:]):
            m = min(k, b - a - 1)
            if m < 1:
                continue
            u = _near(q[a:b])
            s = u @ u.T
            np.fill_diagonal(s, -2)
            best = np.argpartition(s, -m, 1)[:, -m:]
            at.append((a + np.repeat(np.arange(b - a), m), a + best.ravel()))
            sims.append(np.take_along_axis(s, best, 1).ravel())
        yield _pairs(node, at, sims)

    return _stretches(_coded(nodes, seeds), ["tree", "code", "node"], STRETCH, ["tree"], work, _PAIRS)


def _merged(graph: DataFrame, found: DataFrame) -> DataFrame:
    """The graph (u, k, least, q, near) with what was found: each list keeps its ``k`` nearest;
    ``fresh`` counts the new entries. A saturated list (full, all entries at ``least`` or more) gets twice the length."""
    best = found.groupBy("u").agg(F.collect_set(F.struct("s", "v")).alias("met"))
    kept = F.slice(F.sort_array(F.array_union("near", F.coalesce("met", F.array().cast("array<struct<s:float,v:bigint>>"))), asc=False), 1, F.col("k"))
    out = graph.join(best, "u", "left").withColumn("now", kept)
    full = (F.size("now") >= F.col("k")) & (F.element_at("now", -1)["s"] >= F.col("least"))
    return out.select("u", F.when(full, F.col("k") * 2).otherwise(F.col("k")).alias("k"), "least", "q", F.col("now").alias("near"),
                      F.size(F.array_except("now", "near")).alias("fresh"), full.alias("saturated"))


def _descend(graph: DataFrame) -> DataFrame:
    """(u, v, s): neighbours of a common node, nearer to u than what ends its list."""
    ends = graph.select(F.col("u").alias("m"), "k", "q", F.when(F.size("near") >= F.col("k"), F.element_at("near", -1)["s"])
                        .otherwise(F.lit(-2.0)).cast("float").alias("end"))
    there = graph.select("u", F.explode("near.v").alias("v"))
    meet = (there.select(F.col("u").alias("c"), F.col("v").alias("m")).union(there.select("v", "u")).union(graph.select("u", "u"))
            .distinct().join(ends, "m").withColumn("h", F.xxhash64("m", "c")))

    def work(t: pa.Table, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, q, end, size, at, sims = t["m"].to_numpy(), t["q"].to_pylist(), t["end"].to_numpy(), t["k"].to_numpy(), [], []
        for a, b in zip(edge[:-1], edge[1:]):
            if b - a < 2:
                continue
            u = _near(q[a:b])
            s = u @ u.T
            np.fill_diagonal(s, -2)
            i, j = np.nonzero(s > end[a:b, None])
            if len(i):
                rank = np.arange(len(i)) - np.searchsorted(i, i)  # lists keep no more than their length
                if (rank >= size[a:b][i]).any():
                    order = np.lexsort((-s[i, j], i))
                    i, j = i[order], j[order]
                    held = rank < size[a:b][i]
                    i, j = i[held], j[held]
                at.append((a + i, a + j))
                sims.append(s[i, j])
        yield _pairs(node, at, sims)

    return _stretches(meet, ["c", "h"], GROUP, ["c"], work, _PAIRS).distinct()


def neighbour_graph(nodes: DataFrame, slack: float, audit: Callable[[DataFrame], float]) -> tuple[DataFrame, float]:
    """The graph over ``nodes`` (node, q, least) and its audited recall."""
    empty = F.array().cast("array<struct<s:float,v:bigint>>")
    graph = nodes.select(F.col("node").alias("u"), F.lit(NEIGHBOURS).alias("k"), (F.col("least") - slack).cast("float").alias("least"), "q", empty.alias("near"))
    recall, entries = 0.0, NEIGHBOURS * max(nodes.count(), 1)
    for turn in range(AUDITS):
        graph = cut(_merged(graph, _start(nodes, list(range(turn * ORDERS, (turn + 1) * ORDERS)), NEIGHBOURS)), "graph")
        for _ in range(ROUNDS):
            graph = cut(_merged(graph.drop("fresh", "saturated"), _descend(graph)), "graph")
            fresh, saturated = graph.agg(F.coalesce(F.sum("fresh"), F.lit(0)), F.count_if("saturated")).first()
            if fresh <= STALE * entries and not saturated:
                break
        recall = audit(graph)
        if recall >= RECALL:
            break
    return graph, recall


# -- links -------------------------------------------------------------------------------

def near_duplicates(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall): one row per vector; ``recall`` is the
    share of the audited links that the graph holds."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    good = F.expr("v is not null and forall(v, x -> x is not null and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    out = "vec_id long, n_links long, component_id long, kept boolean, recall double"
    lone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                                         F.lit(True).alias("kept"))
    usable = rows.where("good").select("vec_id", "v")
    theta = float(np.arccos(cosine))
    classes = cut(usable.groupBy("v").agg(F.count("*").alias("m"), F.min("vec_id").alias("first"))
                  .withColumn("node", F.monotonically_increasing_id()), "classes")
    dims = classes.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        return lone.withColumn("recall", F.lit(1.0)).select(*[c.split()[0] for c in out.split(", ")])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = _sketches(units(column(b, "v"), dims))
                yield pa.RecordBatch.from_arrays([column(b, "node"), column(b, "v"), pa.array([r.tobytes() for r in q], pa.binary())],
                                                 ["node", "v", "q"])

    known = cut(classes.select("node", "v").mapInArrow(sketch, "node long, v array<double>, q binary"), "sketches")
    ball = cut(balls(known, cosine, dims), "balls")
    placed = classes.select("node", "m", "first").join(ball, "node")
    centre = cut(placed.groupBy("centre").agg(F.max("angle").alias("r"), F.sum("m").alias("mass"), F.min("first").alias("first")), "centres")
    widest = float(centre.agg(F.max("r")).first()[0])
    # a list is saturated when all it holds could link with the node
    nodes = cut(known.join(centre, known["node"] == centre["centre"])
                .select("node", "v", "q", "r", "mass", F.cos(F.least(F.lit(np.pi), theta + F.col("r") + widest)).alias("least")), "nodes")
    slack = 0.02 if dims <= SKETCH else 0.1

    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(AUDIT).select("node", "v", "r").toArrow().combine_chunks()
    sent = spark.sparkContext.broadcast((sample["node"].to_numpy(), units(sample["v"].combine_chunks(), dims), sample["r"].to_numpy()))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, u, r = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                b = whole.slice(at, 2_000)
                angle = np.arccos(np.clip(units(column(b, "v"), dims) @ u.T, -1, 1))
                own = column(b, "node").to_numpy()
                i, j = np.nonzero((angle <= theta + column(b, "r").to_numpy()[:, None] + r) & (own[:, None] != node))
                yield pa.RecordBatch.from_arrays([pa.array(node[j]), pa.array(own[i])], ["u", "v"])

    truth = cut(nodes.select("node", "v", "r").mapInArrow(reach, "u long, v long"), "audit")

    def audit(graph: DataFrame) -> float:
        there = _both_ways(graph)
        n, found = truth.join(there.withColumn("hit", F.lit(1)), ["u", "v"], "left").agg(F.count("*"), F.coalesce(F.sum("hit"), F.lit(0))).first()
        return found / n if n else 1.0

    graph, recall = neighbour_graph(nodes, slack, audit)
    wide = cut(_judged(graph, nodes, theta, slack, dims), "judged")
    counts, links = _counted(wide, placed, classes, theta, cosine, dims)
    roots = connected(links)
    comp = centre.join(roots.toDF("centre", "root"), "centre", "left").select("centre", "mass", "first", F.coalesce("root", "centre").alias("root"))
    least = comp.groupBy("root").agg(F.min("first").alias("component_id"))
    per_centre = counts.where("node is null").groupBy("centre").agg(F.sum("n").alias("whole"))
    per_node = counts.where("node is not null").groupBy("node").agg(F.sum("n").alias("own"))
    of_node = (ball.select("node", "centre").join(comp.join(least, "root").join(per_centre, "centre", "left"), "centre")
               .join(per_node, "node", "left")
               .select("node", "component_id", (F.col("mass") - 1 + F.coalesce("whole", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("n_links")))
    label = classes.select("node", "v").join(of_node, "node").drop("node")
    linked = usable.join(label, "v").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(lone).withColumn("recall", F.lit(recall))


def _both_ways(graph: DataFrame) -> DataFrame:
    there = graph.select("u", F.explode("near.v").alias("v"))
    return there.union(there.select("v", "u")).distinct()


def _judged(graph: DataFrame, nodes: DataFrame, theta: float, slack: float, dims: int) -> DataFrame:
    """(a, b, ra, rb, na, nb, angle): node pairs of the graph of which members may link."""
    pairs = (graph.select("u", "least", F.explode("near").alias("e")).where("e.s >= least")
             .select(F.least("u", "e.v").alias("a"), F.greatest("u", "e.v").alias("b")).distinct())
    one = nodes.select(F.col("node").alias("a"), F.col("v").alias("va"), F.col("r").alias("ra"), F.col("mass").alias("na"))
    two = nodes.select(F.col("node").alias("b"), F.col("v").alias("vb"), F.col("r").alias("rb"), F.col("mass").alias("nb"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cos = np.clip((units(column(b, "va"), dims) * units(column(b, "vb"), dims)).sum(1), -1, 1)
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("a", "b", "ra", "rb", "na", "nb")), pa.array(np.arccos(cos)), pa.array(cos)],
                                             ["a", "b", "ra", "rb", "na", "nb", "angle", "cos"])

    return (pairs.join(one, "a").join(two, "b").mapInArrow(
        angles, "a long, b long, ra double, rb double, na long, nb long, angle double, cos double")
        .where(F.col("angle") <= theta + F.col("ra") + F.col("rb") + _EPS))


def _counted(wide: DataFrame, placed: DataFrame, classes: DataFrame, theta: float, cosine: float, dims: int) -> tuple[DataFrame, DataFrame]:
    """Counts (centre, node, n): links of all members of a centre (node null) or of one node;
    and (a, b): centres of which members link."""
    single = (F.col("ra") == 0) & (F.col("rb") == 0)
    sure = F.when(single, F.col("cos") >= cosine).otherwise(F.col("angle") + F.col("ra") + F.col("rb") <= theta - _EPS)
    wide = wide.withColumn("sure", sure)
    whole = wide.where("sure")
    null = F.lit(None).cast("long").alias("node")
    counts = (whole.select(F.col("a").alias("centre"), null, F.col("nb").alias("n"))
              .unionByName(whole.select(F.col("b").alias("centre"), null, F.col("na").alias("n"))))
    part = wide.where(~F.col("sure") & ~single).select("a", "b")
    if part.isEmpty():
        return counts, whole.select("a", "b")
    ids = part.select(F.explode(F.array("a", "b")).alias("centre")).distinct()
    member = placed.join(ids, "centre", "left_semi").select("centre", "node", "m").join(classes.select("node", "v"), "node")
    # blocks of bounded length, whatever the size of the ball
    size = member.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = cut(member.join(size, "centre").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).groupBy("centre", "block")
                .agg(F.collect_list(F.struct("node", "m", "v")).alias("rows")), "blocks")
    one, two = block.select(F.col("centre").alias("a"), F.col("rows").alias("x")), block.select(F.col("centre").alias("b"), F.col("rows").alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, c, x, y in zip(*(column(b, n) for n in ("a", "b", "x", "y"))):
                x, y = x.values, y.values
                hit = units(x.field("v"), dims) @ units(y.field("v"), dims).T >= cosine
                nx, ny = hit @ y.field("m").to_numpy(), x.field("m").to_numpy() @ hit
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a.as_py()] * hit.shape[0] + [c.as_py()] * hit.shape[1]),
                     pa.array([c.as_py()] * hit.shape[0] + [a.as_py()] * hit.shape[1]),
                     pa.concat_arrays([x.field("node"), y.field("node")]), pa.array(np.concatenate([nx, ny]))],
                    ["centre", "other", "node", "n"])

    found = cut(part.join(one, "a").join(two, "b").repartition("a", "b").mapInArrow(
        compare, "centre long, other long, node long, n long").where("n > 0"), "compared")
    return (counts.unionByName(found.select("centre", "node", "n")),
            whole.select("a", "b").union(found.select(F.greatest("centre", "other"), F.least("centre", "other"))).distinct())

