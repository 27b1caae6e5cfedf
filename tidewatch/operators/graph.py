"""Graphs as edge tables (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.functions.mathx import clip, d, sigmoid
from tidewatch.operators.grid import cut, neighbors


def downhill_edges(df: DataFrame, elevation: str = "z", flow: str = "accumulation") -> DataFrame:
    """Edges to lower neighbours on a raster, weighted by the fall and the ratio of flows."""
    both = neighbors(df, elevation).withColumnRenamed("n", "z2").join(neighbors(df, flow).withColumnRenamed("n", "f2"), ["r", "q", "di", "dj"])
    own = both.join(df.select("r", "q", "w", F.col(elevation).alias("z1"), F.col(flow).alias("f1")), ["r", "q"]).where("z1 > z2")
    weight = F.exp(-(F.col("z1") - F.col("z2")) / 10) * F.sqrt((F.col("f1") + 1) / (F.col("f2") + 1))
    return own.select((F.col("r") * F.col("w") + F.col("q")).cast("long").alias("src"), ((F.col("r") + F.col("di")) * F.col("w") + F.col("q") + F.col("dj")).cast("long").alias("dst"), weight.alias("weight"))


def undirected(edges: DataFrame, nodes: DataFrame | None = None, node: str = "cell") -> DataFrame:
    """Edges with their reverses and self-loops, each (src, dst) once with the first weight, over the greatest weight."""
    parts = edges.select("src", "dst", "weight", F.lit(0).alias("p")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit(1).alias("p")))
    if nodes is not None:
        parts = parts.unionByName(nodes.select(F.col(node).alias("src"), F.col(node).alias("dst"), d(1).alias("weight"), F.lit(2).alias("p")))
    once = parts.groupBy("src", "dst").agg(F.min(F.struct("p", "weight")).alias("b")).select("src", "dst", F.col("b.weight").alias("weight"))
    top = once.agg(F.max("weight").alias("_m"))
    return once.crossJoin(F.broadcast(top)).select("src", "dst", (F.col("weight") / (F.col("_m") + 1e-8)).alias("weight"))


def edge_weights(edges: DataFrame, nodes: DataFrame, kind: str = "combined", decay: float = 1.0, flow_share: float = 0.5, elevation_share: float = 0.5) -> DataFrame:
    """Weights from places (x, y), elevations z and flows of the ends: uniform, distance, flow, elevation or combined."""
    a = nodes.select(F.col("node").alias("src"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("z").alias("za"), F.col("flow").alias("fa"))
    b = nodes.select(F.col("node").alias("dst"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("z").alias("zb"), F.col("flow").alias("fb"))
    far = F.exp(-d(decay) * F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")))
    flow = F.sqrt((F.col("fa") + 1) / (F.col("fb") + 1))
    fall = sigmoid(F.col("za") - F.col("zb"))
    wf, wg = 0.3 * flow_share, 0.3 * elevation_share
    made = {"uniform": d(1), "distance": far, "flow": flow, "elevation": fall, "combined": (d(0.4) * far + d(wf) * flow + d(wg) * fall) / d(0.4 + wf + wg)}[kind]
    own = edges.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", clip(made, 0.01, 1.0).alias("weight"))
    return own.crossJoin(F.broadcast(own.agg(F.max("weight").alias("_m")))).select("src", "dst", (F.col("weight") / F.col("_m")).alias("weight"))


def attention(edges: DataFrame, score: str, temperature: float = 1.0) -> DataFrame:
    """Softmax of the score over the edges of each source."""
    w = Window.partitionBy("src")
    top = edges.withColumn("_e", F.exp((F.col(score) - F.max(score).over(w)) / d(temperature)))
    return top.withColumn("attention", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def symmetric(edges: DataFrame) -> DataFrame:
    """D^-1/2 A D^-1/2 with out-degrees; edges at nodes without a degree get 0."""
    degree = edges.groupBy("src").agg(F.sum("weight").alias("deg"))
    a = degree.select("src", F.when(F.col("deg") > 0, d(1) / F.sqrt("deg")).otherwise(d(0)).alias("da"))
    b = degree.select(F.col("src").alias("dst"), F.when(F.col("deg") > 0, d(1) / F.sqrt("deg")).otherwise(d(0)).alias("db"))
    return edges.join(a, "src").join(b, "dst", "left").select("src", "dst", (F.col("weight") * F.col("da") * F.coalesce("db", d(0))).alias("weight"))


def smoothness(edges: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Mean weighted squared difference over the edges."""
    a, b = nodes.select(F.col("node").alias("src"), F.col(value).alias("va")), nodes.select(F.col("node").alias("dst"), F.col(value).alias("vb"))
    return edges.join(a, "src").join(b, "dst").agg(F.avg(F.col("weight") * F.pow(F.col("va") - F.col("vb"), 2)).alias("smoothness"), F.count("*").alias("n_edges"))


def gated_sum(edges: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Each node's sum of its sources' values, gated by the sigmoid of the edge: one message-passing step."""
    given = edges.join(nodes.select(F.col("node").alias("src"), F.col(value).alias("v")), "src")
    return given.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("v") * sigmoid(F.col("weight"))).alias("message"))


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, distance): shortest distances from the sources over weighted edges, by relaxing the whole frontier.

    Each round relaxes only the edges of the nodes that came nearer in the round before, until none does; the lineage is
    cut by a checkpoint in the shared folder. Weights must not be negative.
    """
    best = cut(sources.select(F.col("node"), d(0).alias("distance")).distinct())
    frontier = best
    while True:
        tried = frontier.join(edges, frontier.node == edges.src).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("new"))
        nearer = cut(tried.join(best, "node", "left").where(F.col("distance").isNull() | (F.col("new") < F.col("distance") - 1e-12)).select("node", F.col("new").alias("distance")))
        if nearer.isEmpty():
            return best
        best = cut(best.unionByName(nearer).groupBy("node").agg(F.min("distance").alias("distance")))
        frontier = nearer


def laplacian(cells: DataFrame, dx: float = 1.0, dy: float = 1.0, boundary: str = "neumann") -> DataFrame:
    """Five-point Laplacian of a raster as (i, j, a): neumann drops the missing neighbours, dirichlet keeps their weight
    on the diagonal, periodic goes around."""
    four = ((-1, 0), (1, 0), (0, -1), (0, 1))
    number = cells.withColumn("_k", (F.col("r") * F.col("w") + F.col("q")).cast("long"))
    near = neighbors(number, "_k", four, "wrap" if boundary == "periodic" else "clip").join(number.select("r", "q", "_k"), ["r", "q"])
    weight = F.when(F.col("di") != 0, d(1 / dy**2)).otherwise(d(1 / dx**2))
    off = near.select(F.col("_k").alias("i"), F.col("n").alias("j"), weight.alias("a"))
    if boundary == "dirichlet":
        own = number.select(F.col("_k").alias("i"), F.col("_k").alias("j"), d(-2 / dx**2 - 2 / dy**2).alias("a"))
    else:
        own = off.groupBy("i").agg((-F.sum("a")).alias("a")).select("i", F.col("i").alias("j"), "a")
    return off.unionByName(own).groupBy("i", "j").agg(F.sum("a").alias("a"))


def matvec(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, x): a sparse matrix (i, j, a) times a vector (i, x)."""
    return matrix.join(vector.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("a") * F.col("x")).alias("x"))
