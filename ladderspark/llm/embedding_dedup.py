"""Near-duplicate embeddings: exact metric range join of unit vectors, partitioned by pivots.

On unit vectors the chord sqrt(2 - 2 cos) is a metric, and cos >= limit is a chord of at most `reach`. A vector lives in the cell of its nearest
pivot p. A neighbour within reach lives in the cell of q only if x.p - x.q <= reach * |p - q| (the triangle inequality on the line through
both pivots), so only such vectors are copied into the cell of q, and only if q comes after p: every pair of cells meets once. A cell is joined by
itself, with the window |d(x, p) - d(y, p)| <= reach on the distances to its pivot.

A cell with too many members is cut into rings of equal size by the distance to the pivot. Two rings that are too far apart are skipped; two
that are so close to the pivot that d(x, p) + d(y, p) <= reach are links without any comparison, so a tight cluster of any size costs
a sum per ring. The other pairs of rings are tasks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderspark.llm.common import query, table
from ladderspark.llm.graph import components
from ladderspark.operators.scan import row_numbers
from ladderspark.storage import materialize

COSINE = 0.98
CELL = 4096  # vectors of a cell, and of a ring of a larger one
MAX_PIVOTS = 4096  # of all labels together; the broadcast pivots are this many vectors at most
SPREAD = 2.5  # pivots are at least this many times the reach apart
SLACK = 1e-7  # bounds are this much wider, for the rounding of distances
SURE = 1e-6  # links that are not compared keep this distance from the limit

_LINKS = "node long, n long, hub long"


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(column, rows: np.ndarray, starts: np.ndarray, dim: int, flat: np.ndarray) -> np.ndarray:
    return flat[starts[rows][:, None] + np.arange(dim)]


def _placed(names, kind: str, pivots, reach: float):
    """Rows -> rows with the node of their copies in this slice; its first row carries the vector and the cells it belongs to."""
    def rows(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        where = pivots.value if pivots is not None else {}
        uid = TaskContext.get().partitionId() << 33
        cell = pa.list_(pa.struct([("k", pa.int32()), ("d", pa.float64()), ("far", pa.bool_())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 2 * CELL):
                part = batch.slice(at, 2 * CELL)
                ids, labels = part.column(0).to_pylist(), part.column(1).to_pylist()
                vectors = part.column(2)
                sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = pc.fill_null(pc.list_flatten(vectors).cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
                starts = np.cumsum(sizes) - sizes
                n = len(ids)
                node, weight, dims, first = uid + np.arange(n), np.ones(n, np.int64), sizes.astype(np.int32), list(ids)
                carried, cells = [None] * n, [None] * n
                known = np.array([x is not None for x in labels], bool)
                for dim in np.unique(sizes[known]).tolist():
                    if dim == 0:
                        continue
                    mine = np.flatnonzero(known & (sizes == dim))
                    x = _matrix(vectors, mine, starts, dim, flat)
                    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                    mine, x = mine[good], x[good]
                    raw = x.astype(kind)
                    leaders, seen = [], {}
                    for row, (i, v) in enumerate(zip(mine.tolist(), raw)):
                        key = (labels[i], v.tobytes())
                        lead = seen.setdefault(key, i)
                        if lead == i:
                            leaders.append(row)
                            carried[i] = key[1]
                        else:
                            node[i] = uid + lead
                            if ids[i] is not None:
                                first[lead] = ids[i] if first[lead] is None else min(first[lead], ids[i])
                    at_lead = node[mine] - uid
                    many = np.bincount(at_lead, minlength=n)
                    weight[mine] = many[at_lead]
                    for i, lead in zip(mine.tolist(), at_lead.tolist()):
                        first[i] = first[lead]
                    by_label: dict = {}
                    for row in leaders:
                        by_label.setdefault(labels[mine[row]], []).append(row)
                    for label, own in by_label.items():
                        if (label, dim) not in where:
                            for row in own:
                                cells[mine[row]] = [{"k": 0, "d": 1.0, "far": False}]
                            continue
                        p, apart = where[label, dim]
                        for lo in range(0, len(own), 512):
                            some = own[lo:lo + 512]
                            cosine = _units(x[some]) @ p.T
                            home = cosine.argmax(axis=1)
                            gap = cosine[np.arange(len(some)), home][:, None] - cosine
                            there = (gap <= reach * apart[home] + SLACK) & (np.arange(len(p)) > home[:, None])
                            there[np.arange(len(some)), home] = True
                            d = np.sqrt(np.maximum(2 - 2 * cosine, 0))
                            for j, row in enumerate(some):
                                cells[mine[row]] = [{"k": k, "d": float(d[j, k]), "far": k != home[j]} for k in np.flatnonzero(there[j]).tolist()]
                uid += n
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(node), pa.array(first, pa.int64()), pa.array(dims), pa.array(weight), pa.array(carried, pa.binary()), pa.array(cells, cell)], names=names)

    return rows


def _pivots(vectors: DataFrame, reach: float, cell: int, max_pivots: int):
    """Broadcast {(label, dim): (pivots, their distances)} for every label of more than `cell` vectors; None if there is none.

    Pivots come from a sample by hash of the vectors, about four candidates for each, copies once; the sample is bounded by max_pivots.
    """
    spark = vectors.sparkSession
    sized = vectors.where("label is not null and size(embedding) > 0").withColumn("dim", F.size("embedding"))
    large = sized.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
    large = materialize(large, "vector-labels")
    total = large.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not total[0]:
        return None
    wanted = F.least(F.ceil(F.col("n") / cell), F.floor(F.col("n") * (max_pivots / total[0]))).cast("int")
    wanted = large.withColumn("wanted", wanted).where("wanted > 1")
    chance = (F.col("wanted") * 4 + 16) / F.col("n") * float(1 << 32)
    place = F.xxhash64("embedding").bitwiseAND((1 << 32) - 1)
    sample = sized.join(wanted, ["label", "dim"]).withColumn("h", place).where(F.col("h") < chance)
    sample = sample.groupBy("label", "dim", "wanted", "h").agg(F.first("embedding").alias("v")).limit(24 * max_pivots).collect()
    found: dict = {}
    for r in sorted(sample, key=lambda r: r.h):
        v = np.array([math.nan if c is None else c for c in r.v], np.float64)[None, :]
        if not np.isfinite(v).all() or not v.any():
            continue
        unit, own = _units(v)[0], found.setdefault((r.label, r.dim), [])
        if len(own) < r.wanted and (not own or 2 - 2 * (np.array(own) @ unit).max() > (SPREAD * reach) ** 2):
            own.append(unit)
    table_of = {}
    for key, own in found.items():
        p = np.array(own)
        table_of[key] = p, np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
    return spark.sparkContext.broadcast(table_of)


def _near(a, da, b, db, same: bool, far_a, far_b, limit: float, reach: float) -> np.ndarray:
    """Which rows of a link to which of b; both are sorted by their distance to the pivot."""
    m = np.zeros((len(a), len(b)), bool)
    for lo in range(0, len(a), 512):
        hi = min(lo + 512, len(a))
        left = np.searchsorted(db, da[lo] - reach - SLACK)
        right = np.searchsorted(db, da[hi - 1] + reach + SLACK, "right")
        left = max(left, lo) if same else left
        if left < right:
            m[lo:hi, left:right] = a[lo:hi] @ b[left:right].T >= limit
    m[np.ix_(far_a, far_b)] = False
    if same:
        m |= m.T
        np.fill_diagonal(m, False)
    return m


def _hubs(m: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Symmetric links -> for every row the smallest node of its connected part."""
    hub, left = node.copy(), m.any(axis=1)
    while left.any():
        part = np.zeros(len(m), bool)
        new = part.copy()
        new[left.argmax()] = True
        while new.any():
            part |= new
            new = m[new].any(axis=0) & ~part
        hub[part] = node[part].min()
        left &= ~part
    return hub


def _cell_join(kind: str, limit: float, reach: float):
    """Members of one cell, or of two rings of a cell -> node, how many vectors it links to here, and a node it is connected with."""
    def group(t):
        import pyarrow as pa

        node, weight, d, far, side = (t.column(c).to_numpy() for c in ("node", "weight", "d", "far", "side"))
        x = _units(np.frombuffer(b"".join(t.column("vector").to_pylist()), kind).reshape(len(node), -1).astype(np.float64))
        order = np.lexsort((node, d, side))
        node, weight, d, far, side, x = node[order], weight[order], d[order], far[order].astype(bool), side[order], x[order]
        cut = int(np.searchsorted(side, 1))
        same = cut == len(side)
        b = slice(0, cut) if same else slice(cut, None)
        m = _near(x[:cut], d[:cut], x[b], d[b], same, far[:cut], far[b], limit, reach)
        rows, cols = np.flatnonzero(m.any(axis=1)), np.flatnonzero(m.any(axis=0))
        m = m[np.ix_(rows, cols)]
        w = weight.astype(np.float64)
        if same:
            n, hub, who = m @ w[cols], _hubs(m, node[rows]), node[rows]
        else:
            n, who = np.concatenate([m @ w[b][cols], m.T @ w[:cut][rows]]), np.concatenate([node[:cut][rows], node[b][cols]])
            both = np.zeros((len(who), len(who)), bool)
            both[:len(rows), len(rows):] = m
            hub = _hubs(both | both.T, who)
        return pa.table([pa.array(who.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(hub.astype(np.int64))], names=["node", "n", "hub"])

    return group


def _ring_tasks(members: DataFrame, reach: float, cell: int) -> tuple[DataFrame, DataFrame]:
    """Members (label, dim, k, far, d, node, weight) of the large cells -> (their tasks: label, dim, k, ta, tb, side, node, far, d, weight;
    links that need no comparison: node, n, hub)."""
    by = ["label", "dim", "k"]
    placed = row_numbers(members, [*by, "far"], [F.col("d"), F.col("node")], "rn")
    ring = F.floor((F.col("rn") - 1) / cell).cast("int") * 2 + F.col("far").cast("int")
    placed = materialize(placed.withColumn("ring", ring).drop("rn"), "vector-rings")
    rings = materialize(placed.groupBy(*by, "ring").agg(
        F.min("d").alias("lo"), F.max("d").alias("hi"), F.sum("weight").alias("w"), F.min("node").alias("hub")), "vector-ring-sums")
    a, b = (rings.select(*by, F.col("ring").alias(f"t{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("lo", "hi", "w", "hub")]) for s in "ab")
    home = lambda c: F.col(c) % 2 == 0
    pairs = a.join(b, by).where((F.col("ta") <= F.col("tb")) & (home("ta") | home("tb")))
    pairs = pairs.where((F.col("lo_b") - F.col("hi_a") <= reach + SLACK) & (F.col("lo_a") - F.col("hi_b") <= reach + SLACK))
    sure = home("ta") & home("tb") & (F.col("hi_a") + F.col("hi_b") <= reach - SURE)
    pairs = materialize(pairs.withColumn("sure", sure), "vector-ring-pairs")
    to_do = pairs.where("not sure").select(*by, "ta", "tb")
    sides = to_do.select(*by, F.col("ta").alias("ring"), "ta", "tb", F.lit(0).alias("side")).union(
        to_do.where("ta <> tb").select(*by, F.col("tb").alias("ring"), "ta", "tb", F.lit(1).alias("side")))
    tasks = placed.join(sides, [*by, "ring"]).select(*by, "ta", "tb", "side", "node", "far", "d", "weight")
    done = pairs.where("sure")
    # The pivot's innermost ring is surely linked with every ring that is surely linked at all, so its hub connects them.
    partners = done.select(*by, F.col("ta").alias("ring"), F.col("tb").alias("other"), F.col("w_b").alias("w"), F.col("hub_b").alias("hub")).union(
        done.where("ta <> tb").select(*by, F.col("tb").alias("ring"), F.col("ta").alias("other"), F.col("w_a").alias("w"), F.col("hub_a").alias("hub")))
    partners = partners.groupBy(*by, "ring").agg(
        F.sum("w").alias("w"), F.min_by("hub", "other").alias("hub"), F.max((F.col("ring") == F.col("other")).cast("int")).alias("own"))
    links = placed.join(partners.withColumnRenamed("w", "all_w"), [*by, "ring"]).select("node", (F.col("all_w") - F.col("own") * F.col("weight")).alias("n"), "hub")
    return tasks, links.where("n > 0")


def near_vectors(vectors: DataFrame, limit: float = COSINE, cell: int = CELL, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label and one length link if their cosine in double precision is at least `limit`. Vectors that are null, empty or zero or hold null
    or non-finite components, and those without a label, link with nothing. n_links counts other rows, copies too; component_id is the smallest vec_id that links
    reach (null if all of them are null); kept is vec_id = component_id, nulls being equal. Repeated rows and ids are rows of their own; ties need no rule. An empty table gives an
    empty result; other columns are ignored.
    """
    reach = math.sqrt(2 - 2 * limit)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    vectors = vectors if kind == "<f4" else vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    label = dict(vectors.dtypes)["label"]
    schema = f"vec_id long, label {label}, node long, first long, dim int, weight long, vector binary, cells array<struct<k:int,d:double,far:boolean>>"
    names = ["vec_id", "label", "node", "first", "dim", "weight", "vector", "cells"]
    placed = vectors.mapInArrow(_placed(names, kind, _pivots(vectors, reach, cell, max_pivots), reach), schema)
    nodes = materialize(placed, "vector-nodes")
    by = ["label", "dim", "k"]
    members = nodes.where("vector is not null").select("label", "dim", "node", "weight", "vector", F.explode("cells").alias("c"))
    members = members.select("label", "dim", "c.k", "node", "weight", "c.d", "c.far", "vector")
    large = materialize(members.groupBy(*by).count().where(F.col("count") > cell).select(*by), "vector-large-cells")
    whole = [*by, "ta", "tb"]
    columns = [*whole, "side", "node", "far", "d", "weight", "vector"]
    one = F.lit(-1)
    links = None
    if large.isEmpty():
        small = members
    else:
        small = members.join(large, by, "left_anti")
        tasks, sure = _ring_tasks(members.drop("vector").join(large, by, "left_semi"), reach, cell)
        wide = tasks.join(nodes.where("vector is not null").select("node", "vector"), "node").select(*columns)
        links = wide.groupBy(*whole).applyInArrow(_cell_join(kind, limit, reach), _LINKS).union(sure)
    small = small.withColumns({"ta": one, "tb": one, "side": F.lit(0)}).select(*columns)
    inner = small.groupBy(*whole).applyInArrow(_cell_join(kind, limit, reach), _LINKS)
    links = materialize(inner if links is None else inner.union(links), "vector-links")
    classes = components(links.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    linked = links.groupBy("node").agg(F.sum("n").alias("n")).join(classes, "node")
    rows = materialize(nodes.select("vec_id", "node", "first", "weight").join(linked, "node", "left"), "vector-rows")
    apart = rows.where("component is null").select("vec_id", (F.col("weight") - 1).alias("n_links"), F.col("first").alias("component_id"))
    tied = rows.where("component is not null")
    # Stored, so that the join reads two plain exchanges and a class of very many rows can be split at runtime.
    least = materialize(tied.groupBy("component").agg(F.min("first").alias("component_id")), "vector-classes")
    tied = tied.join(least, "component").select("vec_id", (F.col("weight") - 1 + F.col("n")).alias("n_links"), "component_id")
    return apart.union(tied).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL_11 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reached AS (
  SELECT DISTINCT x, x AS y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x),
many AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN least ON least.x = vec_id LEFT JOIN many ON many.x = vec_id
"""


@query("op11_embedding_dedup", SQL_11)
def op11_embedding_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
