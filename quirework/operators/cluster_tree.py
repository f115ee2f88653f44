"""Cluster trees: memberships of all ancestors, sizes, depth, centroids, and density clustering.

Density clustering compares every pair of a group in pairs of blocks. Each block
pair gives the least distances of its rows, and then a spanning tree of its own
edges; together these hold the spanning tree of the group, from which one task
makes the condensed tree. So a group of any size is clustered as a whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import distributions as D
from quirework.operators.ranking import seeded_order
from quirework.scratch import Scratch

#: Rows of one block of a group.
BLOCK = 1000


def ancestors(tree: DataFrame, scratch: Scratch, max_depth: int = 64) -> DataFrame:
    """(cluster_id, ancestor_id, distance) for every cluster and each of its ancestors, itself at distance 0.

    tree: (cluster_id, parent_cluster_id), the root's parent -1 or null. Pairs are
    doubled in each round, so a tree of depth d takes log2(d) joins. A cycle is an
    error.
    """
    known = tree.select("cluster_id", F.col("parent_cluster_id").alias("p"))
    own = known.select("cluster_id", F.col("cluster_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    step = known.where("p is not null and p <> -1").select("cluster_id", F.col("p").alias("ancestor_id"), F.lit(1).alias("distance"))
    reach = scratch.table(own.unionByName(step), "reach")
    span = 1
    while span <= max_depth:
        far = reach.where(F.col("distance") == span)
        if far.isEmpty():
            return reach
        on = reach.where("distance > 0").select(F.col("cluster_id").alias("ancestor_id"), F.col("ancestor_id").alias("to"), F.col("distance").alias("more"))
        more = far.join(on, "ancestor_id").select("cluster_id", F.col("to").alias("ancestor_id"), (F.col("distance") + F.col("more")).alias("distance"))
        reach = scratch.table(reach.unionByName(more), "reach")
        span *= 2
    raise ValueError("the tree is deeper than allowed, or has a cycle")


def expanded_memberships(leaves: DataFrame, tree: DataFrame, scratch: Scratch) -> DataFrame:
    """(cluster_id, arxiv_id, certainty): one row per ancestor of each paper's own cluster; certainty is that of the own cluster."""
    up = ancestors(tree, scratch)
    rows = leaves.select(F.col("cluster_id").alias("own"), "arxiv_id", "certainty")
    return rows.join(up.select(F.col("cluster_id").alias("own"), "ancestor_id"), "own").select(F.col("ancestor_id").alias("cluster_id"), "arxiv_id", "certainty")


def sizes(memberships: DataFrame) -> DataFrame:
    """(cluster_id, size): distinct papers of each cluster."""
    return memberships.groupBy("cluster_id").agg(F.countDistinct("arxiv_id").alias("size"))


def leaf_memberships(memberships: DataFrame, tree: DataFrame) -> DataFrame:
    """Memberships of clusters that are no cluster's parent."""
    parents = tree.select(F.col("parent_cluster_id").alias("cluster_id")).where("cluster_id is not null")
    return memberships.join(parents, "cluster_id", "left_anti")


def approximate_centroids(memberships: DataFrame, coordinates: DataFrame, samples: int, seed: int, key: str = "arxiv_id") -> DataFrame:
    """(cluster_id, n, x, y): mean coordinates of at most ``samples`` distinct members of each cluster, chosen by a seeded hash.

    coordinates: (key, x, y). A member without coordinates, and a repeated,
    missing or non-finite coordinate, end the query with an error.
    """
    if samples < 1:
        raise ValueError("samples must be positive")
    n = F.count("*").over(Window.partitionBy(key))
    fine = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & (n == 1)
    checked = coordinates.select(key, "x", "y", fine.alias("fine"))
    w = Window.partitionBy("cluster_id").orderBy(seeded_order(seed, "cluster_id", key), key)
    chosen = memberships.select("cluster_id", key).distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= samples)
    joined = chosen.join(checked, key, "left")
    good = F.when(F.col("fine"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no single finite coordinate for "), key)).cast("boolean"))
    return joined.where(good).groupBy("cluster_id").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x @ y.T, 0))


def spanning_edges(gap: np.ndarray) -> list[tuple[float, int, int]]:
    """(length, point, point) of a minimum spanning tree, grown from point 0; an infinite gap is no edge."""
    n = len(gap)
    inside = np.zeros(n, bool)
    best, near = gap[0].copy(), np.zeros(n, int)
    inside[0] = True
    edges = []
    for _ in range(n - 1):
        j = int(np.where(inside, np.inf, best).argmin())
        edges.append((float(best[j]), int(near[j]), j))
        inside[j] = True
        closer = gap[j] < best
        best[closer], near[closer] = gap[j][closer], j
    return edges


def density_tree(vectors: np.ndarray, min_cluster_size: int = 5, min_samples: int | None = None) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """``condensed_tree`` of the points of one process: a matrix of all distances is made."""
    n = len(vectors)
    if min_cluster_size < 2:
        raise ValueError("a cluster needs two members")
    if n < min_cluster_size:
        return condensed_tree(n, [], min_cluster_size)
    k = min(min_samples or min_cluster_size, n - 1)
    gap = _gaps(vectors, vectors)
    core = np.partition(gap, k, axis=1)[:, k]
    return condensed_tree(n, spanning_edges(np.maximum(gap, np.maximum(core[:, None], core[None, :]))), min_cluster_size)


def condensed_tree(n: int, edges: list[tuple[float, int, int]], min_cluster_size: int = 5) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """(tree rows (parent, child, child_size, lambda_val), selected cluster of each point or -1, membership strength).

    Hierarchical density clustering after Campello, Moulavi and Sander: mutual
    reachability, minimum spanning tree, condensed tree, clusters of greatest
    excess of mass. edges hold a minimum spanning tree of the n points' mutual
    reachability, and maybe further edges, which change nothing. Points keep
    their numbers; clusters are numbered from the number of points, which is the
    root.
    """
    empty = pd.DataFrame({"parent": [], "child": [], "child_size": [], "lambda_val": []})
    if n < min_cluster_size:
        return empty, np.full(n, -1), np.zeros(n)
    edges = sorted(edges)
    # Single linkage: node n + i joins the two sides of the i-th edge.
    top, size, left, right, height = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}, {}, {}

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    i = 0
    for d, a, b in edges:
        x, y = find(a), find(b)
        if x == y:
            continue
        node = n + i
        i += 1
        top[x] = top[y] = node
        left[node], right[node], height[node] = x, y, d
        size[node] = size[x] + size[y]

    def points(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            m = stack.pop()
            if m < n:
                out.append(m)
            else:
                stack += [right[m], left[m]]
        return out

    rows, label, stack = [], n, [(2 * n - 2, n)]
    while stack:
        node, own = stack.pop()
        while node >= n:
            lam = 1 / height[node] if height[node] > 0 else math.inf
            a, b = left[node], right[node]
            big = [m for m in (a, b) if size[m] >= min_cluster_size]
            for m in (a, b):
                if m not in big:
                    rows += [(own, p, 1, lam) for p in points(m)]
            if len(big) == 2:
                for m in big:
                    label += 1
                    rows.append((own, label, size[m], lam))
                    stack.append((m, label))
                break
            if not big:
                break
            node = big[0]
        else:
            rows.append((own, node, 1, math.inf))
    tree = pd.DataFrame(rows, columns=["parent", "child", "child_size", "lambda_val"])
    return (tree, *select_clusters(tree, n))


def select_clusters(tree: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(cluster of each point or -1, strength): the clusters of greatest excess of mass; the root is never selected."""
    born = {n: 0.0} | {int(r.child): float(r.lambda_val) for r in tree[tree.child >= n].itertuples()}
    finite = tree.lambda_val.replace(np.inf, np.nan).max()
    lam = tree.lambda_val.replace(np.inf, finite if finite == finite else 1.0)
    mass = ((lam - tree.parent.map(born).clip(upper=lam)) * tree.child_size).groupby(tree.parent).sum().to_dict()
    children: dict[int, list[int]] = {}
    for r in tree[tree.child >= n].itertuples():
        children.setdefault(int(r.parent), []).append(int(r.child))
    chosen = {c: True for c in born if c != n}
    for c in sorted(born, reverse=True):
        below = sum(mass.get(k, 0.0) for k in children.get(c, []))
        if c == n:
            continue
        if children.get(c) and below > mass.get(c, 0.0):
            chosen[c] = False
            mass[c] = below
        else:
            stack = list(children.get(c, []))
            while stack:
                k = stack.pop()
                chosen[k] = False
                stack += children.get(k, [])
    up = {int(r.child): int(r.parent) for r in tree[tree.child >= n].itertuples()}
    label, when = np.full(n, -1), np.zeros(n)
    for r, value in zip(tree.itertuples(), lam, strict=True):
        if r.child < n:
            c = int(r.parent)
            while c != n and not chosen.get(c, False):
                c = up[c]
            if c != n:
                label[int(r.child)], when[int(r.child)] = c, value
    strength = np.zeros(n)
    for c in set(label.tolist()) - {-1}:
        own = label == c
        most = when[own].max()
        strength[own] = np.minimum(1, when[own] / most) if most > 0 else 1.0
    return label, strength


def tree_memberships(tree: pd.DataFrame, strength: np.ndarray, n: int) -> tuple[list[tuple[int, int, float]], list[tuple[int, int, int]]]:
    """((cluster, point, strength) for each ancestor of each point, (cluster, size, parent)); the root holds every point and has parent -1."""
    up = {int(r.child): int(r.parent) for r in tree.itertuples()}
    members = []
    for p in sorted(c for c in up if c < n):
        c = up[p]
        while True:
            members.append((c, p, float(strength[p])))
            if c not in up:
                break
            c = up[c]
    count = pd.Series([m[0] for m in members], dtype="int64").value_counts()
    return members, [(int(c), int(k), up.get(int(c), -1)) for c, k in sorted(count.items())]


def _numbered(df: DataFrame, group: str, id_col: str, vector_col: str, block: int) -> DataFrame:
    """(grp, dim, no, id, v, n, blocks, block): usable vectors scaled to length one, numbered by id within their group and length."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(id_col).cast("string").alias("id"), D.unit(v).alias("v"), D.usable_vector(F.col(vector_col)).alias("ok"))
    rows = rows.where("grp is not null and id is not null and ok").drop("ok").withColumn("dim", F.size("v"))
    w = Window.partitionBy("grp", "dim")
    rows = rows.withColumn("no", F.row_number().over(w.orderBy("id")) - 1).withColumn("n", F.count("*").over(w))
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    return rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.col("no"), F.col("blocks")).cast("int"))


def _pairs_of_blocks(rows: DataFrame):
    """The rows once for each pair of blocks that theirs is in; side: 0 within one block, -1 and 1 for the two of a pair."""
    far = rows.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("to"), 0).when(F.col("block") < F.col("to"), -1).otherwise(1)
    return far.withColumn("side", side).withColumn("x", F.least("block", "to")).withColumn("y", F.greatest("block", "to")).drop("to").groupBy("grp", "dim", "x", "y")


def _rows(part: pa.Table) -> np.ndarray:
    return part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _least_gaps(k: int):
    """(grp, dim, no, gaps): of each row its k + 1 least distances, itself among them, to the other block of its pair, or within its own."""

    def run(part: pa.Table) -> pa.Table:
        side, no, v = np.asarray(part.column("side")), np.asarray(part.column("no")), _rows(part)
        out = []
        for mine, other in ((side == -1, side == 1), (side == 1, side == -1), (side == 0, side == 0)):
            if mine.any() and other.any():
                gap = _gaps(v[mine], v[other])
                few = min(k + 1, gap.shape[1])
                out += list(zip(no[mine].tolist(), np.partition(gap, few - 1, axis=1)[:, :few].tolist(), strict=True))
        n = len(out)
        return pa.table({"grp": pa.array([part.column("grp")[0].as_py()] * n, pa.string()), "dim": pa.array([part.column("dim")[0].as_py()] * n, pa.int32()), "no": pa.array([o[0] for o in out], pa.int32()), "gaps": pa.array([o[1] for o in out], pa.list_(pa.float64()))})

    return run


def _block_edges(part: pa.Table) -> pa.Table:
    """(grp, dim, a, b, gap): a spanning tree of the mutual reachability between the two blocks of a pair, or within one."""
    side, no, v, core = np.asarray(part.column("side")), np.asarray(part.column("no")), _rows(part), np.asarray(part.column("core"))
    order = np.argsort(no)
    side, no, v, core = side[order], no[order], v[order], core[order]
    gap = np.maximum(_gaps(v, v), np.maximum(core[:, None], core[None, :]))
    if (side != 0).any():
        gap[side[:, None] == side[None, :]] = np.inf
    edges = [e for e in spanning_edges(gap) if np.isfinite(e[0])]
    n = len(edges)
    return pa.table(
        {
            "grp": pa.array([part.column("grp")[0].as_py()] * n, pa.string()),
            "dim": pa.array([part.column("dim")[0].as_py()] * n, pa.int32()),
            "a": pa.array(no[[e[1] for e in edges]].astype(np.int32) if n else [], pa.int32()),
            "b": pa.array(no[[e[2] for e in edges]].astype(np.int32) if n else [], pa.int32()),
            "gap": pa.array([e[0] for e in edges], pa.float64()),
        }
    )


def density_edges(rows: DataFrame, min_samples: int, scratch: Scratch) -> DataFrame:
    """(grp, dim, a, b, gap): edges that hold a minimum spanning tree of the mutual reachability of each group of numbered rows."""
    gaps = _pairs_of_blocks(rows).applyInArrow(_least_gaps(min_samples), "grp string, dim int, no int, gaps array<double>")
    every = F.array_sort(F.flatten(F.collect_list("gaps")))  # min_samples + 1 numbers a block
    core = gaps.groupBy("grp", "dim", "no").agg(every.alias("g")).select("grp", "dim", "no", "g")
    known = rows.join(core, ["grp", "dim", "no"]).withColumn("core", F.element_at("g", F.least(F.lit(min_samples), F.col("n") - 1).cast("int") + 1)).drop("g")
    known = scratch.table(known, "cores")
    return scratch.table(_pairs_of_blocks(known).applyInArrow(_block_edges, "grp string, dim int, a int, b int, gap double"), "edges")


def _with_edges(rows: DataFrame, edges: DataFrame, make, schema: str) -> DataFrame:
    return rows.select("grp", "dim", "no", "id").groupBy("grp", "dim").cogroup(edges.groupBy("grp", "dim")).applyInArrow(make, schema)


def _sorted_ids(rows: pa.Table) -> pa.Table:
    return rows.sort_by("no")


def _edge_list(edges: pa.Table) -> list[tuple[float, int, int]]:
    return list(zip(edges.column("gap").to_pylist(), edges.column("a").to_pylist(), edges.column("b").to_pylist(), strict=True))


def clusters_within(df: DataFrame, group: str, id_col: str, vector_col: str, scratch: Scratch, min_cluster_size: int = 5, min_samples: int | None = None, block: int = BLOCK) -> DataFrame:
    """(group, dim, id, cluster, strength): density clustering of each group by itself, by the distance of vectors scaled to length one.

    Exact at every size: all pairs of a group are compared in pairs of blocks of
    ``block`` rows, at a cost in the square of the group; the last step of a group
    reads its spanning trees, two numbers and a length for each row and block, in
    one task. Vectors of different lengths are different groups; unusable vectors,
    null ids and null groups take no part; numbers of clusters are local to a
    group; -1 is noise.
    """
    if min_cluster_size < 2:
        raise ValueError("a cluster needs two members")

    def make(rows: pa.Table, edges: pa.Table) -> pa.Table:
        rows = _sorted_ids(rows)
        _, label, strength = condensed_tree(rows.num_rows, _edge_list(edges), min_cluster_size)
        return pa.table({"grp": rows.column("grp"), "dim": rows.column("dim"), "id": rows.column("id"), "cluster": pa.array(label.astype(np.int32)), "strength": pa.array(strength.astype(np.float64))})

    rows = scratch.table(_numbered(df, group, id_col, vector_col, block), "numbered")
    edges = density_edges(rows, min_samples or min_cluster_size, scratch)
    return _with_edges(rows, edges, make, "grp string, dim int, id string, cluster int, strength double").withColumnRenamed("grp", group).withColumnRenamed("id", id_col)


def whole_tree(df: DataFrame, id_col: str, vector_col: str, scratch: Scratch, min_cluster_size: int = 5, min_samples: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((cluster_id, id, certainty), (cluster_id, size, parent_cluster_id)): one density tree of all rows, with a membership for each ancestor; the root holds every row and has parent -1.

    Vectors must be of one length. Fewer rows than ``min_cluster_size`` give no clusters.
    """

    def make(rows: pa.Table, edges: pa.Table) -> pa.Table:
        rows = _sorted_ids(rows)
        tree, _, strength = condensed_tree(rows.num_rows, _edge_list(edges), min_cluster_size)
        members, clusters = tree_memberships(tree, strength, rows.num_rows) if len(tree) else ([], [])
        up, ids = {c: p for c, _, p in clusters}, rows.column("id").to_pylist()
        return pa.table(
            {
                "cluster_id": pa.array([c for c, _, _ in members], pa.int32()),
                "parent_cluster_id": pa.array([up[c] for c, _, _ in members], pa.int32()),
                "id": pa.array([ids[p] for _, p, _ in members], pa.string()),
                "certainty": pa.array([s for _, _, s in members], pa.float64()),
            }
        )

    rows = scratch.table(_numbered(df.withColumn("__all", F.lit("all")), "__all", id_col, vector_col, block), "numbered")
    edges = density_edges(rows, min_samples or min_cluster_size, scratch)
    got = scratch.table(_with_edges(rows, edges, make, "cluster_id int, parent_cluster_id int, id string, certainty double"), "memberships")
    clusters = got.groupBy("cluster_id").agg(F.count("*").cast("int").alias("size"), F.min("parent_cluster_id").alias("parent_cluster_id"))
    return got.select("cluster_id", F.col("id").alias(id_col), "certainty"), clusters
