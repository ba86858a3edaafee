"""Near-duplicate vectors found in a robust-pruned graph built on overlapping cluster shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import same, settled
from scanloom.llm.components import connected_components

SIMILARITY = 0.98
#: Vectors of a shard; larger shards are split by pivots, a vector going to the nearest and, if close, to the second.
SHARD = 2048
PIVOTS = 16
CLOSE = 0.06
LEVELS = 8
#: Vectors assigned to pivots together.
TOGETHER = 8192
#: Graph: candidates and neighbours of a vector, random neighbours, and how much nearer a neighbour must be.
CANDIDATES, DEGREE, RANDOM, ALPHA = 48, 24, 4, 1.2
BEAM = 10
_QUERIES = 256
_PAIRS = 4096


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pruned(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Neighbours of each row, padded with -1: near candidates, each nearer to the row than to those before it."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    lists: list[list[int]] = [[] for _ in range(n)]
    for at in range(0, n, 512):
        sims = x[at : at + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-sims, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1)
        near = np.take_along_axis(near, order, 1)
        own = np.take_along_axis(sims, near, 1)
        for i, (row, s) in enumerate(zip(near, own, strict=True)):
            apart = np.sqrt(np.maximum(0, 2 - 2 * (x[row] @ x[row].T)))
            mine = np.sqrt(np.maximum(0, 2 - 2 * s))
            alive = np.ones(len(row), bool)
            kept = lists[at + i]
            for c in range(len(row)):
                if alive[c]:
                    kept.append(int(row[c]))
                    if len(kept) == DEGREE:
                        break
                    alive &= ALPHA * apart[c] > mine
    both = [list(v) for v in lists]
    for i, row in enumerate(lists):
        for j in row:
            if len(both[j]) < 2 * DEGREE:
                both[j].append(i)
    for i, row in enumerate(both):
        row.extend(rng.integers(0, n, RANDOM).tolist())
        both[i] = [j for j in dict.fromkeys(row) if j != i]
    out = np.full((n, max(1, max(map(len, both)))), -1, np.int64)
    for i, row in enumerate(both):
        out[i, : len(row)] = row
    return out


def in_range(x: np.ndarray, graph: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, other row) of at least that similarity that a greedy search finds, both ways.

    Each row searches from the medoid and from itself along its best few; every row found in range
    is then expanded until no neighbour of one in range is new.
    """
    n = len(x)
    narrow = x.astype(np.float32)
    loose = np.float32(least - 1e-4)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    found: list[np.ndarray] = []
    for at in range(0, n, _QUERIES):
        mine = np.arange(at, min(n, at + _QUERIES))
        rows = np.arange(len(mine))
        seen = np.zeros((len(mine), n), bool)
        ids = np.stack([np.full(len(mine), medoid), mine], axis=1)
        ids[mine == medoid, 0] = -1
        sims = np.einsum("qd,qrd->qr", narrow[mine], narrow[ids])
        sims[ids < 0] = -np.inf
        seen[rows[:, None], ids] = True
        seen[rows[mine == medoid], -1] = n - 1 == medoid
        hits = [np.stack([(r := np.nonzero(sims >= loose))[0], ids[r]], axis=1)]
        done = ids < 0
        while True:
            open_ = np.where(done, -np.inf, sims)
            pick = open_.argmax(axis=1)
            going = np.flatnonzero(open_[rows, pick] > -np.inf)
            if not len(going):
                break
            done[going, pick[going]] = True
            near = graph[ids[going, pick[going]]]
            new = (near >= 0) & ~seen[going[:, None], near]
            seen[going[:, None], np.where(near >= 0, near, mine[going][:, None])] = True
            s = np.full((len(mine), near.shape[1]), -np.inf, np.float32)
            near_all = np.full((len(mine), near.shape[1]), -1, np.int64)
            got = np.einsum("qd,qrd->qr", narrow[mine[going]], narrow[near])
            s[going] = np.where(new, got, -np.inf)
            near_all[going] = near
            r, c = np.nonzero(s >= loose)
            hits.append(np.stack([r, near_all[r, c]], axis=1))
            ids, sims = np.concatenate([ids, near_all], 1), np.concatenate([sims, s], 1)
            done = np.concatenate([done, np.isneginf(s)], 1)
            if ids.shape[1] > BEAM:
                top = np.argpartition(-sims, BEAM - 1, axis=1)[:, :BEAM]
                ids, sims, done = (np.take_along_axis(v, top, 1) for v in (ids, sims, done))
        queue = np.concatenate(hits)
        while len(queue):
            fresh = []
            for p in range(0, len(queue), _PAIRS):
                part = queue[p : p + _PAIRS]
                found.append(part[:, 0] * n + part[:, 1] + at * n)
                near = graph[part[:, 1]]
                q = np.repeat(part[:, 0], near.shape[1])[near.ravel() >= 0]
                keys = np.unique(q * n + near[near >= 0])
                q, c = keys // n, keys % n
                new = ~seen[q, c]
                q, c = q[new], c[new]
                seen[q, c] = True
                close = np.einsum("pd,pd->p", narrow[mine[q]], narrow[c]) >= loose
                fresh.append(np.stack([q[close], c[close]], axis=1))
            queue = np.concatenate(fresh)
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    keys = np.unique(np.concatenate([keys, keys % n * n + keys // n]))
    i, j = keys // n, keys % n
    real = np.zeros(len(i), bool)
    for p in range(0, len(i), 1 << 16):
        real[p : p + (1 << 16)] = np.einsum("pd,pd->p", x[i[p : p + (1 << 16)]], x[j[p : p + (1 << 16)]]) >= least
    real &= i != j
    return i[real], j[real]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        new = new[new]
        if (new == root).all():
            return root
        root = new


_BUILT = "at long, shard string, linked long, root long, near array<long>, bridges array<long>"


def _built(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """Graph, links and local components of one shard.

    A link between vectors that share several shards counts in the first of them by name.
    """
    group = group.sort_values("at")
    at = group["at"].to_numpy()
    shard = group["shard"].iloc[0]
    n = len(at)
    if n == 1:
        return pd.DataFrame({"at": at, "shard": shard, "linked": 0, "root": at, "near": [[]], "bridges": [[]]})
    x = unit_rows(group["embedding"])
    graph = pruned(x, np.random.default_rng(n))
    i, j = in_range(x, graph, least)
    others = [set() if o is None else set(o) - {shard} for o in group["shards"]]
    counted = np.ones(len(i), bool)
    for name in sorted({s for o in others for s in o if s < shard}):
        inside = np.array([name in o for o in others])
        counted &= ~(inside[i] & inside[j])
    weight = group["n"].to_numpy(np.float64)
    linked = np.bincount(i[counted], weight[j[counted]], n).astype(np.int64)
    several = np.array([bool(o) for o in others])
    bridges: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(i[several[j]].tolist(), j[several[j]].tolist(), strict=True):
        if others[b] - others[a]:
            bridges[a].append(int(at[b]))
    near = [at[row[row >= 0]].tolist() for row in graph]
    return pd.DataFrame({"at": at, "shard": shard, "linked": linked, "root": at[_roots(n, i, j)], "near": near, "bridges": bridges})


def _usable(vector: Column) -> Column:
    """Whether a vector can be compared: it has components, all finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _assigned(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(pivots):
        return rows[["at", "shard", "n", "embedding"]].iloc[:0]
    pivots = pivots.sort_values("pivot_at")
    sims = unit_rows(rows["embedding"]) @ unit_rows(pivots["pivot"]).T
    order = np.argsort(-sims, axis=1)[:, :2]
    best = np.take_along_axis(sims, order, 1)
    out = []
    for k in range(order.shape[1]):
        chosen = (k == 0) | (best[:, 0] - best[:, k] <= CLOSE)
        part = rows.loc[np.broadcast_to(chosen, len(rows)), ["at", "shard", "n", "embedding"]].copy()
        names = order[np.broadcast_to(chosen, len(rows)), k]
        part["shard"] = [f"{s}/{p:02d}" for s, p in zip(part["shard"], names, strict=True)]
        out.append(part)
    return pd.concat(out)


def sharded(nodes: DataFrame) -> DataFrame:
    """Rows of ``nodes`` (``at``, ``shard``, ``n``, ``embedding``) in overlapping shards of about ``SHARD`` vectors.

    Only shards that are too large are split, again and again, by pivots chosen by a hash; a vector can come into
    one shard twice but stays in it once. A shard that ``LEVELS`` splits leave too large is built as it is, in blocks of
    rows.
    """
    rows = settled(nodes, "shards")
    for level in range(LEVELS):
        sizes = settled(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SHARD), "sizes")
        if sizes.isEmpty():
            break
        small = rows.join(sizes, "shard", "left_anti").select("at", "shard", "n", "embedding")
        # Each vector draws a number; the few with the least numbers are the pivots.
        drawn = F.xxhash64(F.lit(level), "at") / F.lit(2.0**64) + 0.5
        large = rows.join(sizes, "shard").withColumn("drawn", drawn)
        first = Window.partitionBy("shard").orderBy("drawn", "at")
        few = large.where(F.col("drawn") * F.col("size") < 4 * PIVOTS).withColumn("r", F.row_number().over(first))
        few = few.where(F.col("r") <= PIVOTS)
        parts = F.ceil(F.col("size") / TOGETHER).cast("int")
        pivots = few.select(
            F.col("shard").alias("pivot_shard"),
            F.col("at").alias("pivot_at"),
            F.col("embedding").alias("pivot"),
            F.explode(F.sequence(F.lit(0), parts - 1)).alias("pivot_part"),
        )
        large = large.withColumn("part", F.pmod(F.xxhash64("at"), parts).cast("int"))
        split = (
            large.groupBy("shard", "part")
            .cogroup(pivots.groupBy("pivot_shard", "pivot_part"))
            .applyInPandas(_assigned, nodes.schema)
        )
        rows = settled(small.union(split), "shards")
    return rows.dropDuplicates(["at", "shard"])


def _cosine(a: str, b: str) -> Column:
    def norm(v: str) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def _across(built: DataFrame, nodes: DataFrame, places: DataFrame, least: float) -> DataFrame:
    """Links ``u``, ``v`` between vectors without a common shard, over the united adjacency lists.

    From a vector's links that lie in further shards as well, their neighbours there are tried, then the
    neighbours of those found, until nothing new is in range.
    """
    lists = settled(built.groupBy("at").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "lists")
    front = settled(built.select(F.col("at").alias("u"), F.explode("bridges").alias("b")).distinct(), "front")
    links: DataFrame | None = None
    while not front.isEmpty():
        tried = front.join(lists, front["b"] == lists["at"]).select("u", F.explode("near").alias("v")).where("u <> v").distinct()
        mine = places.select(F.col("at").alias("u"), F.col("shards").alias("su"))
        theirs = places.select(F.col("at").alias("v"), F.col("shards").alias("sv"))
        tried = tried.join(mine, "u").join(theirs, "v").where(~F.arrays_overlap("su", "sv")).select("u", "v")
        if links is not None:
            tried = tried.join(links, ["u", "v"], "left_anti")
        a = nodes.select(F.col("at").alias("u"), F.col("embedding").alias("a"))
        b = nodes.select(F.col("at").alias("v"), F.col("embedding").alias("b"))
        new = settled(tried.join(a, "u").join(b, "v").where(_cosine("a", "b") >= least).select("u", "v"), "across")
        links = new if links is None else settled(links.union(new), "across")
        front = new.select("u", F.col("v").alias("b"))
    if links is None:
        return front.select("u", F.col("b").alias("v"))
    return links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def near_vectors(vectors: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Columns ``vec_id``, ``n_links``, ``component_id``, ``kept``: one row for each row of ``vectors``.

    Vectors (vec_id, embedding, label) are compared when their labels are equal and not null and they have as many
    components. Vectors that are null, empty or zero or hold null or non-finite components link with
    nothing. Equal vectors of a label are one node of the graph, whatever their number, and linked. Links are
    verified in double precision, so that none is below ``least``; the search may miss some, see ``audit``.
    A null vec_id is listed, counts as a link and is never smallest. An empty table gives an empty one.
    """
    label, vector = F.col("label").cast("string"), F.col("embedding")
    keyed = vectors.select("vec_id", "embedding", F.when(_usable(vector), label).alias("label")).withColumns(
        {
            "h1": F.when(F.col("label").isNotNull(), F.xxhash64("embedding")),
            "h2": F.when(F.col("label").isNotNull(), F.xxhash64(F.lit(1), "embedding")),
        }
    )
    known = ["label", "h1", "h2"]
    classes = keyed.where(F.col("label").isNotNull()).groupBy(*known).agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")
    )
    classes = settled(classes.withColumn("at", F.monotonically_increasing_id()), "classes")
    shard = F.concat_ws(":", "label", F.size("embedding").cast("string"))
    nodes = classes.select("at", shard.alias("shard"), "n", "embedding")
    rows = settled(sharded(nodes), "sharded")
    places = settled(rows.groupBy("at").agg(F.sort_array(F.collect_list("shard")).alias("shards")), "places")
    several = places.where(F.size("shards") > 1)
    shown = rows.join(several, "at", "left").select("at", "shard", "n", "embedding", "shards")
    built = settled(shown.groupBy("shard").applyInPandas(lambda g: _built(g, least), _BUILT), "graph")
    across = settled(_across(built, nodes, places, least), "across")
    edges = built.select(F.col("at").alias("u"), F.col("root").alias("v")).union(across.select("u", "v"))
    roots = connected_components(edges)
    counts = nodes.select(F.col("at").alias("v"), "n")
    far = across.join(counts, "v").groupBy("u").agg(F.sum("n").alias("far")).withColumnRenamed("u", "at")
    direct = built.groupBy("at").agg(F.sum("linked").alias("linked"))
    found = classes.select(*known, "at", "first", "n").join(direct, "at", "left").join(far, "at", "left")
    found = found.join(roots, found["at"] == roots["node"], "left").withColumn("root", F.coalesce("root", "at"))
    smallest = found.groupBy("root").agg(F.min("first").alias("component_id"))
    links = F.col("n") - 1 + F.coalesce("linked", F.lit(0)) + F.coalesce("far", F.lit(0))
    found = found.join(smallest, "root").select(*known, links.alias("links"), "component_id")
    out = keyed.join(found, same(keyed, found, known), "left")
    component = F.when(keyed["label"].isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def audit(vectors: DataFrame, found: DataFrame, every: int = 50, least: float = SIMILARITY) -> tuple[int, int]:
    """Links of the vectors whose id is divisible by ``every``: (found, by comparison with all rows)."""
    usable = vectors.where(_usable(F.col("embedding")) & F.col("label").isNotNull())
    rows = usable.select("vec_id", "embedding", F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string")).alias("shard"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)).cast("int"))
    asked = rows.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("asked"),
        F.col("embedding").alias("query"),
        F.col("shard").alias("asked_shard"),
        F.explode(F.sequence(F.lit(0), F.lit(63))).alias("asked_part"),
    )

    def compare(all_rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(all_rows) or not len(queries):
            return pd.DataFrame({"vec_id": [], "true": []})
        sims = unit_rows(queries["query"]) @ unit_rows(all_rows["embedding"]).T >= least
        own = queries["asked"].to_numpy()[:, None] == all_rows["vec_id"].to_numpy()[None, :]
        return pd.DataFrame({"vec_id": queries["asked"].to_numpy(), "true": (sims & ~own).sum(axis=1)})

    truth = rows.groupBy("shard", "part").cogroup(asked.groupBy("asked_shard", "asked_part")).applyInPandas(compare, "vec_id long, true long")
    true = truth.agg(F.sum("true")).first()[0] or 0
    got = found.where(F.col("vec_id") % every == 0).agg(F.sum("n_links")).first()[0] or 0
    return got, true
