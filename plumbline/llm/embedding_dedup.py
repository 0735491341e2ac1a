"""Near-duplicate vectors by range search in robust-pruned flat graphs.

1. Equal vectors of a label become one node with a weight. Within a label, sampled vectors that are no near copies of
   each other serve as cluster centres; a node is held by the shard of its nearest centre (its home).
2. Every shard builds a graph of its nodes: nearest candidates and some random far ones, robust-pruned (a candidate
   goes if a kept one is clearly nearer to it).
3. Every node is searched for in its home and in all other shards that can hold a partner: those whose boundary with
   the home is within a margin and whose centre is within the shard's angular radius and the range. The margin is at
   least three standard deviations of a random step of the range, and as wide as `MIN_COVER` of the links of a hashed
   sample of nodes need, which are found by brute force over their label; at the range itself nothing can be missed.
   A greedy beam search starts from the shard's medoids, and once the beam has settled, the neighbourhoods of all nodes
   within range are expanded until nothing new is in range. Hits are verified in double precision.
4. Recall is audited twice: for a sample of a shard's queries brute force over the shard tells what should be found, and
   the beam is doubled until `MIN_RECALL` of it is; and the links found of the hashed sample are compared with all its
   links within the label. A label of which fewer than `LEAST_AUDIT` were found is searched again, in every shard within
   the range and by brute force there, which misses nothing. The lower of the two audits is returned. Labels of one
   shard are searched whole and need the first audit only; of every other label about `LABEL_SAMPLE` nodes at least are
   in the hashed sample.

A shard of more than `PART` nodes is dealt by hash into parts with a graph each, and so are its queries; each part of the
queries visits all parts of the nodes. So no task holds more than about 2 `PART` rows, and nothing is dropped. A task returns, per query, the number of links, and for
components one edge per node it has linked, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.groups import attach, components
from plumbline.llm.tables import written

THRESHOLD = 0.98
CLUSTER_NODES = 512
CENTRES = 16_384
PART = 4096
DEGREE = 24
CANDIDATES = 48
FAR = 8
NAMED = 4
ALPHA = 1.2
BEAM = 24
MEDOIDS = 16
AUDIT = 64
MIN_RECALL = 0.99
AUDITED_NODES = 1024
LABEL_SAMPLE = 32  # of at most CENTRES / 2 labels that have more than one shard
LEAST_AUDIT = 0.95
MIN_COVER = 0.995
ROUNDING = 1e-5


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; a power of two is taken out first, so that squares neither overflow nor vanish."""
    if not values.size:
        return values
    values = np.ldexp(values, -np.frexp(np.abs(values).max(axis=1, keepdims=True))[1])
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def robust_prune(x: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Of each node's candidates (nearest first; its own number means none), those no kept one is closer to by `alpha`; -1 fills up."""
    n, c = candidates.shape
    out = np.full((n, degree), -1, np.int64)
    step = max(1, 4_000_000 // (c * c))
    for a in range(0, n, step):
        cand = candidates[a : a + step]
        points = x[cand]
        own = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,ncd->nc", x[a : a + step], points)))
        between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(points, points.transpose(0, 2, 1))))
        alive = cand != np.arange(a, a + len(cand))[:, None]
        rows = np.arange(len(cand))
        for k in range(degree):
            pick = alive.argmax(axis=1)
            has = alive[rows, pick]
            if not has.any():
                break
            out[a : a + step, k] = np.where(has, cand[rows, pick], -1)
            covered = alpha * between[rows, pick] <= own
            alive &= ~(covered & has[:, None])
            alive[rows, pick] = False
    return out


def build_graph(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Adjacency of unit rows `x`: pruned nearest and random far candidates."""
    n = len(x)
    if n < 2:
        return np.full((n, DEGREE), -1, np.int64)
    rng = np.random.default_rng(seed)
    near = min(CANDIDATES, n - 1)
    lists = []
    for a in range(0, n, 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        part = np.argpartition(-s, near - 1, axis=1)[:, :near]
        far = rng.integers(0, n, (len(s), min(FAR, n)))
        both = np.concatenate([part, far], axis=1)
        order = np.argsort(-np.take_along_axis(s, both, axis=1), axis=1, kind="stable")
        lists.append(np.take_along_axis(both, order, axis=1))
    return robust_prune(x, np.concatenate(lists))


def reachable(graph: np.ndarray) -> list[np.ndarray]:
    """Lists of neighbours; a node that fewer than `NAMED` lists name is also named by the lists of its first neighbours."""
    named = np.bincount(graph[graph >= 0], minlength=len(graph))
    extra: dict[int, list[int]] = {}
    for v in np.flatnonzero(named < NAMED).tolist():
        for u in graph[v, :NAMED].tolist():
            if u >= 0:
                extra.setdefault(u, []).append(v)
    return [np.union1d(g[g >= 0], extra.get(u, [])).astype(np.int64) for u, g in enumerate(graph)]


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, starts: np.ndarray, least: float, beam: int) -> np.ndarray:
    """Boolean (query, node): nodes with similarity >= `least` that greedy search and range expansion reach."""
    q, n = len(queries), len(x)
    sim = np.full((q, n), -np.inf, np.float32)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # the padding of adjacency lists
    done = np.zeros((q, n), bool)
    rows = np.arange(q)
    sim[:, starts] = queries @ x[starts].T
    seen[:, starts] = True

    def visit(who: np.ndarray, nodes: np.ndarray) -> None:
        """Look at the neighbours of node nodes[i] for query who[i]."""
        for a in range(0, len(who), 8192):
            new = graph[nodes[a : a + 8192]]
            asks = np.repeat(who[a : a + 8192], new.shape[1])
            new = new.ravel()
            fresh = ~seen[asks, new]
            asks, new = asks[fresh], new[fresh]
            seen[asks, new] = True
            sim[asks, new] = np.einsum("nd,nd->n", queries[asks], x[new])

    active = rows
    width = min(beam, n)
    while len(active):  # expand the best node of each beam that is not expanded yet
        s = np.where(seen[active, :n], sim[active], -np.inf)
        top = np.argpartition(-s, width - 1, axis=1)[:, :width]
        best = np.where(done[active[:, None], top], -np.inf, np.take_along_axis(s, top, axis=1))
        at = best.argmax(axis=1)
        open_ = best[np.arange(len(active)), at] > -np.inf
        active, node = active[open_], top[np.arange(len(top)), at][open_]
        done[active, node] = True
        visit(active, node)
    while True:  # then everything in range, until nothing new comes into range
        who, node = np.nonzero((sim >= least) & ~done)
        if not len(who):
            return sim >= least
        done[who, node] = True
        visit(who, node)


def medoids(x: np.ndarray, count: int = MEDOIDS) -> np.ndarray:
    """The node nearest to the mean, then nodes far from all before."""
    centre = x.mean(axis=0)
    out = [int(np.argmax(x @ centre))]
    nearest = x @ x[out[0]]
    while len(out) < min(count, len(x)):
        out.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[out[-1]])
    return np.array(sorted(set(out)))


def audited_search(x, graph, queries, threshold) -> tuple[np.ndarray, float, int]:
    """(hits, audited recall, beam): the beam is doubled until the audit holds; a beam of all nodes cannot miss one it reaches."""
    starts = medoids(x)
    least = threshold - 1e-5  # single precision; verified later
    sample = np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int)
    truth = queries[sample] @ x.T >= least
    beam = BEAM
    while True:
        found = range_search(x, graph, queries[sample], starts, least, beam)
        recall = (found & truth).sum() / truth.sum() if truth.any() else 1.0
        if recall >= MIN_RECALL or beam >= len(x):
            break
        beam *= 2
    return range_search(x, graph, queries, starts, least, beam), float(recall), beam


def _units(frame: pd.DataFrame) -> np.ndarray:
    """The unit vectors, in double precision, of rows of one dimension; components are kept in 4 bytes or in 8."""
    if not len(frame):
        return np.zeros((0, 1))
    dim = int(frame["dim"].iloc[0])
    kind = f"<f{len(frame['vec'].iloc[0]) // dim}"
    return unit_rows(np.frombuffer(b"".join(frame["vec"]), kind).reshape(-1, dim).astype("f8"))


HOME = "label long, dim int, node long, weight long, vec binary, shard long, cos double"


def _homes(nodes: DataFrame, centres: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """Adds the nearest centre and the cosine to it."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for key, part in frame.groupby(["label", "dim"]):
                home, cos = np.zeros(len(part), np.int64), np.ones(len(part))
                if key in shared.value:
                    s = _units(part) @ shared.value[key].T
                    home, cos = s.argmax(axis=1), s.max(axis=1)
                yield pa.RecordBatch.from_pandas(part.assign(shard=home, cos=cos), preserve_index=False)

    return nodes.mapInArrow(run, HOME)


def _depths(s: np.ndarray, home: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How far each query is from the boundary between its home and every centre; 0 for the home. s: cosines to the centres."""
    apart = np.sqrt(np.maximum(0, 2 - 2 * c[home] @ c.T))
    depth = (s[np.arange(len(s)), home][:, None] - s) / np.maximum(apart, 1e-9)
    depth[np.arange(len(s)), home] = 0
    return depth


def _visits(homes: DataFrame, centres: dict, radii: dict, margins: dict, threshold: float) -> DataFrame:
    """(label, dim, shard, node, weight, vec) for every shard that a node is searched for in."""
    shared = homes.sparkSession.sparkContext.broadcast((centres, radii, margins))
    reach = np.arccos(np.clip(threshold, -1, 1))

    def run(batches) -> Iterator[pa.RecordBatch]:
        centres, radii, margins = shared.value
        for batch in batches:
            frame = batch.to_pandas()
            for key, part in frame.groupby(["label", "dim"]):
                for a in range(0, len(part), 1024):
                    asks = part.iloc[a : a + 1024]
                    who, shard = np.arange(len(asks)), asks["shard"].to_numpy()
                    if key in centres:
                        c = centres[key]
                        s = _units(asks) @ c.T
                        near = np.arccos(np.clip(s, -1, 1)) <= radii[key] + reach + ROUNDING
                        near &= _depths(s, shard, c) <= margins[key] + ROUNDING
                        near[who, shard] = True
                        who, shard = np.nonzero(near)
                    out = asks[["label", "dim", "node", "weight", "vec"]].iloc[who].assign(shard=shard)
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return homes.mapInArrow(run, "label long, dim int, node long, weight long, vec binary, shard long")


def _true_links(homes: DataFrame, sample: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(label, dim, node, shard, n): the links of the sampled nodes to the nodes of each shard, by brute force over their label."""
    asked = {k: (p["node"].to_numpy(), _units(p)) for k, p in sample.groupby(["label", "dim"])}
    shared = homes.sparkSession.sparkContext.broadcast(asked)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for key, part in frame.groupby(["label", "dim"]):
                if key not in shared.value:
                    continue
                ids, y = shared.value[key]
                who, at = np.nonzero((y @ _units(part).T >= threshold) & (ids[:, None] != part["node"].to_numpy()))
                out = pd.DataFrame({"node": ids[who], "shard": part["shard"].to_numpy()[at], "n": part["weight"].to_numpy()[at]})
                out = out.groupby(["node", "shard"], as_index=False).sum().assign(label=key[0], dim=key[1])
                yield pa.RecordBatch.from_pandas(out[["label", "dim", "node", "shard", "n"]], preserve_index=False)

    pairs = homes.mapInArrow(run, "label long, dim int, node long, shard long, n long")
    return pairs.groupBy("label", "dim", "node", "shard").agg(F.sum("n").alias("n")).toPandas()  # a bounded sample of nodes


def _margins(sample: pd.DataFrame, links: pd.DataFrame, centres: dict, threshold: float) -> dict[tuple[int, int], float]:
    """Per (label, dim): how far beyond a home's boundary its nodes' partners are looked for."""
    reach, out = float(np.sqrt(max(0.0, 2 - 2 * threshold))), {}
    for key, c in centres.items():
        out[key] = min(reach, 3 * reach / np.sqrt(c.shape[1]))
        asks = sample[(sample["label"] == key[0]) & (sample["dim"] == key[1])]
        found = links[(links["label"] == key[0]) & (links["dim"] == key[1])]
        if not len(found):
            continue
        depth = _depths(_units(asks) @ c.T, asks["shard"].to_numpy(), c)
        row = pd.Series(np.arange(len(asks)), asks["node"].to_numpy())
        need = depth[row[found["node"]].to_numpy(), found["shard"].to_numpy()]
        order, n = np.argsort(need), found["n"].to_numpy().astype(float)
        # as links count, and as nodes count: one hot group does not hide the small ones
        for share in (n, n / found.groupby("node")["n"].transform("sum").to_numpy()):
            covered = np.cumsum(share[order]) / share.sum()
            out[key] = max(out[key], min(reach, float(need[order][np.searchsorted(covered, MIN_COVER - 1e-9)])))
    return out


def _build(key, frame: pd.DataFrame) -> pd.DataFrame:
    x = _units(frame).astype("f4")
    ids = frame["node"].to_numpy()
    graph = build_graph(x, seed=len(x))
    return pd.DataFrame({"node": ids, "links": [ids[g] for g in reachable(graph)]})


FOUND = "label long, dim int, kind int, node long, value long, recall double"


def _search(threshold: float, whole: bool):
    """What a part of the queries finds in a part of a shard; `whole`: by brute force."""

    def search(key, frame: pd.DataFrame) -> pd.DataFrame:
        index, asks = frame[frame["links"].notna()], frame[frame["ask"]]
        if not len(index) or not len(asks):
            return pd.DataFrame({c: [] for c in ("label", "dim", "kind", "node", "value")}, dtype="int64").assign(recall=0.0)
        exact, ids = _units(index), index["node"].to_numpy()
        asked, own = _units(asks), asks["node"].to_numpy()
        place = pd.Series(np.arange(len(ids)), ids)
        graph = np.full((len(ids), max(1, max(map(len, index["links"])))), len(ids), np.int64)
        for i, links in enumerate(index["links"]):
            here = place[links].to_numpy(np.int64)
            graph[i, : len(here)] = here
        weight = index["weight"].to_numpy()
        parent = {}

        def root(v):
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        counts, recall = np.zeros(len(own), np.int64), 1.0
        x, y = exact.astype("f4"), asked.astype("f4")
        for a in range(0, len(own), 1024):
            hits, r, _ = (y[a : a + 1024] @ x.T >= threshold - 1e-5, 1.0, 0) if whole else audited_search(x, graph, y[a : a + 1024], threshold)
            recall = min(recall, r)
            who, node = np.nonzero(hits)
            true = np.concatenate([np.einsum("nd,nd->n", asked[a + who[b : b + 65536]], exact[node[b : b + 65536]]) >= threshold for b in range(0, len(who), 65536)] or [np.zeros(0, bool)])
            who, node = who[true] + a, node[true]
            other = own[who] != ids[node]
            who, node = who[other], node[other]
            counts += np.bincount(who, weight[node], len(own)).astype(np.int64)
            for u, v in zip(own[who].tolist(), ids[node].tolist()):
                u, v = root(u), root(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
        place = int(key[0]), int(key[1])
        out = [(*place, 0, n, c, recall) for n, c in zip(own.tolist(), counts.tolist())]
        out += [(*place, 1, v, root(v), recall) for v in list(parent) if root(v) != v]
        return pd.DataFrame(out, columns=["label", "dim", "kind", "node", "value", "recall"])

    return search


CELL = ["label", "dim", "shard"]


def _sample(homes: DataFrame, several: DataFrame) -> pd.DataFrame:
    """Nodes of labels of several shards by hash: about `AUDITED_NODES`, and of every label about `LABEL_SAMPLE` at least."""
    sizes = homes.join(F.broadcast(several), ["label", "dim"]).groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"))
    total = F.sum("size").over(Window.partitionBy())  # one row per label of several shards, at most CENTRES / 2
    rates = sizes.select("label", "dim", F.greatest(AUDITED_NODES / total, LABEL_SAMPLE / F.col("size")).alias("rate"))
    return homes.join(F.broadcast(rates), ["label", "dim"]).where(_unit("audit") < F.col("rate")).drop("rate").toPandas()


def _found(homes: DataFrame, held: DataFrame, centres: dict, radii: dict, margins: dict, threshold: float, whole: bool = False) -> DataFrame:
    """`FOUND` rows: kind 0 the links that a node (counted by weight) has in a part of a shard, kind 1 edges that join what links."""
    visits = written(_visits(homes, centres, radii, margins, threshold), "visits")
    asking = visits.groupBy(*CELL).agg(F.count(F.lit(1)).alias("asking"))
    parts = held.join(asking, CELL).withColumn("ask_parts", F.ceil(F.col("asking") / PART).cast("int"))
    parts = written(parts.select(*CELL, "parts", "ask_parts", "n", "asking"), "parts")
    members = attach(homes.drop("cos"), parts, CELL, "n").withColumn("j", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    members = written(members.drop("n", "asking"), "members")
    none = F.lit(None).cast("array<long>").alias("links")
    if whole:
        index = members.withColumn("links", F.array().cast("array<long>"))
    else:
        index = members.join(written(members.groupBy(*CELL, "j").applyInPandas(_build, "node long, links array<long>"), "graph"), "node")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = index.withColumn("i", to("ask_parts")).select(*CELL, "i", "j", "node", "weight", "vec", "links", F.lit(False).alias("ask"))
    asks = attach(visits, parts, CELL, "asking").withColumn("i", F.pmod(F.xxhash64(F.lit("ask"), "node"), F.col("ask_parts")).cast("int"))
    asks = asks.withColumn("j", to("parts")).select(*CELL, "i", "j", "node", "weight", "vec", none, F.lit(True).alias("ask"))
    return written(index.unionByName(asks).groupBy(*CELL, "i", "j").applyInPandas(_search(threshold, whole), FOUND), "found")


def _of_sample(found: DataFrame, sample: pd.DataFrame) -> pd.DataFrame:
    """(node, others): what was found of the sampled nodes."""
    asked = found.sparkSession.createDataFrame(sample[["node"]], "node long") if len(sample) else found.select("node").limit(0)
    return found.where("kind = 0").join(F.broadcast(asked), "node").groupBy("node").agg(F.sum("value").alias("others")).toPandas()


def near_groups(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept, audited_recall.

    Vectors link within a non-null label and the same number of dimensions. A vector that is null, empty, zero, or holds
    null or non-finite components links with nothing: it is its own component and kept. Repeated rows are vectors of
    their own and link with each other. A null id never names a component; rows with it are not kept. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    wide = vectors.select(F.col(f"`{embedding}`")).schema[0].dataType.simpleString() != "array<float>"
    e = F.col(f"`{embedding}`").cast("array<double>" if wide else "array<float>")
    sound = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    sound = sound & F.exists(e, lambda v: v != 0) & F.col(f"`{label}`").isNotNull()
    rows = vectors.select(
        F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), e.alias("e"),
        F.coalesce(sound, F.lit(False)).alias("sound"), F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.withColumn("key", F.when(F.col("sound"), F.struct("label", F.xxhash64("e"), F.hash("e", F.size("e")))))
    rows = written(rows, "vectors")
    classes = rows.where("sound").groupBy("key").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"), F.any_value("label").alias("label"), F.any_value("e").alias("e"),
    )
    packed = classes.withColumn("dim", F.size("e")).mapInArrow(_as_bytes, "key struct<label:long,col2:long,col3:int>, node long, weight long, label long, dim int, vec binary")
    classes = written(packed, "classes")
    nodes = classes.select("label", "dim", "node", "weight", "vec")
    centres = _centres(nodes, threshold)
    homes = written(_homes(nodes, centres), "homes")

    several = spark.createDataFrame([(int(k[0]), int(k[1]), len(c)) for k, c in centres.items()], "label long, dim int, of_label int")
    sample = _sample(homes, several)
    truth = _true_links(homes, sample, threshold)
    held = homes.groupBy(*CELL).agg(F.min("cos").alias("cos"), F.count(F.lit(1)).alias("n"))
    held = written(held.withColumn("parts", F.ceil(F.col("n") / PART).cast("int")), "held")
    radii = {k: np.full(len(c), -np.inf) for k, c in centres.items()}
    for r in held.join(F.broadcast(several), ["label", "dim"]).collect():  # at most CENTRES rows
        radii[r.label, r.dim][r.shard] = np.arccos(np.clip(r.cos, -1, 1))
    found = _found(homes, held, centres, radii, _margins(sample, truth, centres, threshold), threshold)
    audit = _audit(sample, truth, _of_sample(found, sample))
    missed = [k for k, share in audit.items() if share < LEAST_AUDIT and k in centres]
    if missed:
        again = F.broadcast(spark.createDataFrame(missed, "label long, dim int"))
        where = lambda df, how: df.join(again, ["label", "dim"], how)
        everywhere = {k: math.inf for k in missed}
        second = _found(where(homes, "left_semi"), where(held, "left_semi"), {k: centres[k] for k in missed}, {k: radii[k] for k in missed}, everywhere, threshold, True)
        found = where(found, "left_anti").unionByName(second)
        audit |= {k: v for k, v in _audit(sample, truth, _of_sample(found, sample)).items() if k in everywhere}

    links = found.where("kind = 0").groupBy("node").agg(F.sum("value").alias("others"), F.min("recall").alias("recall"))
    joined = components(found.where("kind = 1").select(F.col("node").alias("a"), F.col("value").alias("b")))
    audits = spark.createDataFrame([(*k, r) for k, r in audit.items()], "label long, dim int, audit double")
    links = links.join(classes.select("node", "label", "dim"), "node").join(F.broadcast(audits), ["label", "dim"], "left")
    links = links.select("node", "others", F.least("recall", "audit").alias("recall"))
    per_class = classes.select("key", "node", "weight").join(links, "node").join(joined, "node", "left")
    per_class = written(per_class.withColumn("component", F.coalesce("component", "node")), "per_class")
    linked = written(attach(rows.where("sound").select("key", "vec_id"), per_class, ["key"], "weight"), "linked")
    names = linked.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    linked = attach(linked, written(names, "names"), ["component"], "size")
    linked = linked.select("vec_id", (F.col("weight") - 1 + F.col("others")).alias("n_links"), "component_id", "recall")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("recall"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", kept.alias("kept"), F.col("recall").alias("audited_recall"))


def _as_bytes(batches):
    for batch in batches:
        kind = "<f8" if batch.schema.field("e").type.value_type == pa.float64() else "<f4"
        vec = [np.array(v, kind).tobytes() for v in batch.column("e").to_pylist()]
        names = ["key", "node", "weight", "label", "dim"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(vec, pa.binary())], names=[*names, "vec"])


def _audit(sample: pd.DataFrame, truth: pd.DataFrame, got: pd.DataFrame) -> dict[tuple[int, int], float]:
    """Per (label, dim): the share of the sampled nodes' links that was found; labels without one are left out."""
    both = sample[["label", "dim", "node"]].merge(got[["node", "others"]], "left", "node").merge(truth.groupby("node", as_index=False)["n"].sum(), "left", "node")
    sums = both.fillna({"others": 0, "n": 0}).groupby(["label", "dim"])[["others", "n"]].sum()
    return {(int(k[0]), int(k[1])): min(1.0, float(o / n)) for k, o, n in zip(sums.index, sums["others"], sums["n"]) if n}


def _unit(seed: str):
    """A number in [0, 1) that depends on the node only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "node"), 11).cast("double") / F.lit(float(1 << 53))


def _apart(x: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of `x`, in order, without those within `threshold` of a row before that stays."""
    kept = np.empty_like(x)
    n = 0
    for v in x:
        if not n or (kept[:n] @ v).max() < threshold:
            kept[n] = v
            n += 1
    return kept[:n]


def _centres(nodes: DataFrame, threshold: float) -> dict[tuple[int, int], np.ndarray]:
    """Sampled unit vectors per (label, dim), one for `CLUSTER_NODES` nodes, at most `CENTRES` in all. A group of near
    copies keeps one, so that it is one shard (in parts) and not many that all need to be visited."""
    counts = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    per = max(CLUSTER_NODES, -(-total // CENTRES))  # groups of at least two centres, so at most CENTRES / 2 of them
    wanted = counts.where(F.col("n") >= 2 * per).select("label", "dim")
    picked = nodes.join(F.broadcast(wanted), ["label", "dim"])
    picked = picked.where(_unit("centre") < F.lit(1.0 / per)).select("label", "dim", "node", "vec")
    out: dict[tuple[int, int], list[np.ndarray]] = {}
    for r in sorted(picked.collect(), key=lambda r: r.node):
        out.setdefault((r.label, r.dim), []).append(r.vec)
    return {k: _apart(_units(pd.DataFrame({"dim": k[1], "vec": v})), threshold) for k, v in out.items()}
