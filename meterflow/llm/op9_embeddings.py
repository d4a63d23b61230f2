"""Embedding near-dedup: a navigable small-world graph leads each vector to cells, an audited margin, verified cosine, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.llm.common import cut, drop, read, release
from meterflow.llm.graph import components

#: Distinct vectors at home in a cell, about. Labels of no more are one cell.
SHARD = 4096
#: Rows of a cell that one task takes; larger cells are dealt to tasks by pairs of such chunks.
CHUNK = 32768
#: Centres are drawn from so many vectors a cell; one as near as TOO_NEAR to an earlier centre is none.
DRAWN, TOO_NEAR = 4, 0.8
#: All probes of the audit together, at most about; and the share of pairs at the very threshold that the margin must find.
PROBES, AT_THRESHOLD = 32_768, 0.95


class Hnsw:
    """Hierarchical navigable small-world graph over unit vectors; whole batches of points walk it in lockstep."""

    def __init__(self, vectors: np.ndarray, m: int = 16, build: int = 48, seed: int = 5, batch: int = 96):
        self.v = np.ascontiguousarray(vectors, np.float32)
        n = len(self.v)
        self.m = m
        level = np.minimum((-np.log(1.0 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(np.int64), 6)
        order = np.argsort(-level, kind="stable")  # the highest first, so that each entry exists
        self.top = int(level.max(initial=0))
        self.links = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(self.top + 1)]
        self.entry = int(order[0]) if n else -1
        done = 1
        while done < n:
            now = order[done : done + max(1, min(batch, done))]
            self._insert(now, level[now], build)
            done += len(now)

    def _sims(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Cosines of each q[i] to its own row of ids; -2 where an id is -1."""
        s = np.einsum("ijk,ik->ij", self.v[ids], q)
        s[ids < 0] = -2
        return s

    def beam(self, q: np.ndarray, start: np.ndarray, k: int, width: int, seen: np.ndarray | None = None):
        """The width best points of level k that a best-first walk from start reaches: ids and cosines, best first."""
        b = len(q)
        links = self.links[k]
        seen = np.zeros((b, len(self.v)), bool) if seen is None else seen
        ids = np.full((b, width), -1, np.int64)
        sims = np.full((b, width), -2.0, np.float32)
        s = start[:, :width]
        ids[:, : s.shape[1]] = s
        sims[:, : s.shape[1]] = self._sims(q, s)
        rows = np.arange(b)
        r, c = np.nonzero(s >= 0)
        seen[r, s[r, c]] = True
        expanded = ids < 0
        live = rows
        while len(live):
            best = np.where(expanded[live], -3.0, sims[live])
            at = best.argmax(axis=1)
            go = best[np.arange(len(live)), at] > -2
            live, at = live[go], at[go]
            if not len(live):
                break
            expanded[live, at] = True
            nb = links[ids[live, at]].astype(np.int64)
            fresh = (nb >= 0) & ~seen[live[:, None], nb]
            nb[~fresh] = -1
            x, y = np.nonzero(fresh)
            seen[live[x], nb[x, y]] = True
            ns = self._sims(q[live], nb)
            ai = np.concatenate([ids[live], nb], axis=1)
            asim = np.concatenate([sims[live], ns], axis=1)
            ax = np.concatenate([expanded[live], ~fresh], axis=1)
            order = np.argsort(-asim, axis=1, kind="stable")[:, :width]
            ids[live] = np.take_along_axis(ai, order, 1)
            sims[live] = np.take_along_axis(asim, order, 1)
            expanded[live] = np.take_along_axis(ax, order, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _choose(self, base: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to most neighbours of each base: nearer to it than to one chosen before; free places by nearness."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        v = self.v[ids]
        among = np.einsum("ijk,ilk->ijl", v, v)
        ok = ids >= 0
        chosen = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            near = np.where(chosen, among[:, c, :], -2).max(axis=1)
            chosen[:, c] = ok[:, c] & (near < sims[:, c]) & (chosen.sum(axis=1) < most)
        rank = np.argsort(np.where(chosen, 0, np.where(ok, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(ok, rank, 1), np.take_along_axis(ids, rank, 1), -1)
        if out.shape[1] < most:
            out = np.concatenate([out, np.full((len(out), most - out.shape[1]), -1)], axis=1)
        return out

    def _insert(self, now: np.ndarray, level: np.ndarray, build: int) -> None:
        q = self.v[now]
        start = np.full((len(now), 1), self.entry, np.int64)
        own = q @ q.T
        np.fill_diagonal(own, -2)
        for k in range(self.top, -1, -1):
            here = np.flatnonzero(level >= k)
            above = np.flatnonzero(level < k)
            if len(above):
                start[above, 0] = self.beam(q[above], start[above], k, 1)[0][:, 0]
            if not len(here):
                continue
            ids, sims = self.beam(q[here], start[here], k, build)
            start[here, 0] = np.where(ids[:, 0] >= 0, ids[:, 0], start[here, 0])
            mates = np.broadcast_to(now[here], (len(here), len(here)))  # points of this batch see each other, too
            ids = np.concatenate([ids, np.where(own[np.ix_(here, here)] > -2, mates, -1)], axis=1)
            sims = np.concatenate([sims, own[np.ix_(here, here)]], axis=1)
            most = self.links[k].shape[1]
            top = np.argsort(-sims, axis=1, kind="stable")[:, : build + 16]
            got = self._choose(now[here], np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1), self.m)
            self.links[k][now[here], : self.m] = got
            a, c = np.nonzero(got >= 0)
            back, new = got[a, c], now[here][a]
            order = np.argsort(back, kind="stable")
            back, new = back[order], new[order]
            who, first, count = np.unique(back, return_index=True, return_counts=True)
            wide = int(count.max(initial=0))
            slot = np.arange(len(back)) - np.repeat(first, count)
            added = np.full((len(who), wide), -1, np.int64)
            added[np.repeat(np.arange(len(who)), count), slot] = new
            for s in range(0, len(who), 512):
                w, add = who[s : s + 512], added[s : s + 512]
                old = self.links[k][w].astype(np.int64)
                add = np.where((add[:, :, None] == old[:, None, :]).any(axis=2), -1, add)
                every = np.concatenate([old, add], axis=1)
                self.links[k][w] = self._choose(w, every, self._sims(self.v[w], every), most)

    def near(self, q: np.ndarray, margin: float, width: int = 16, batch: int = 1024):
        """For each q the points whose cosines lie within margin of the best that a beam finds: ids (-1: none), best first, and cosines.

        Beams widen while they are full of such points.
        """
        found = []
        for a in range(0, len(q), batch):
            part = q[a : a + batch]
            top = np.full((len(part), 1), self.entry, np.int64)
            for k in range(self.top, 0, -1):
                top = self.beam(part, top, k, 4)[0]
            w = min(width, len(self.v))
            ids, sims = self.beam(part, top, 0, w)
            while w < len(self.v):
                full = np.flatnonzero(sims[:, -1] >= sims[:, 0] - margin)
                if not len(full):
                    break
                w = min(2 * w, len(self.v))
                wide, far = np.full((len(part), w), -1, np.int64), np.full((len(part), w), -2.0, np.float32)
                wide[:, : ids.shape[1]], far[:, : sims.shape[1]] = ids, sims
                wide[full], far[full] = self.beam(part[full], top[full], 0, w)
                ids, sims = wide, far
            ids[sims < sims[:, :1] - margin] = -1
            found.append((ids, sims))
        wide = max((i.shape[1] for i, _ in found), default=1)
        pad = lambda x, none: np.pad(x, ((0, 0), (0, wide - x.shape[1])), constant_values=none)
        ids = np.concatenate([np.zeros((0, wide), np.int64), *[pad(i, -1) for i, _ in found]])
        return ids, np.concatenate([np.zeros((0, wide), np.float32), *[pad(s, -2) for _, s in found]])


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    import pyarrow.compute as pc

    flat = pc.list_flatten(column)
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _centres(units: np.ndarray, most: int) -> np.ndarray:
    """The first so many of units that are not too near to one before, so that a group of near vectors has one centre."""
    chosen = np.zeros((0, units.shape[1]), np.float32)
    for a in range(0, len(units), 512):
        part = units[a : a + 512].astype(np.float32)
        far = (part @ chosen.T).max(axis=1, initial=-2) < TOO_NEAR
        among = part @ part.T
        for i in np.flatnonzero(far):
            if far[i]:
                far[i + 1 :] &= among[i, i + 1 :] < TOO_NEAR
        chosen = np.concatenate([chosen, part[far]])
        if len(chosen) >= most:
            break
    return chosen[:most]


def _needs(graph: Hnsw, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The margin from which each x visits the home of its y, or y that of x."""
    (hx, sx), (hy, sy) = graph.near(x, 0.0), graph.near(y, 0.0)
    dot = lambda a, home: np.einsum("ij,ij->i", a, graph.v[home[:, 0]])
    return np.minimum(sx[:, 0] - dot(x, hy), sy[:, 0] - dot(y, hx))


def _at_threshold(graph: Hnsw, probes: np.ndarray, least: float) -> float:
    """The margin that finds AT_THRESHOLD of pairs of cosine least in random directions about probes."""
    y = np.repeat(probes.astype(np.float64), max(1, 1024 // len(probes)), axis=0)
    u = np.random.default_rng(3).normal(size=y.shape)
    u -= (u * y).sum(axis=1, keepdims=True) * y
    u /= np.maximum(np.sqrt((u * u).sum(axis=1, keepdims=True)), 1e-30)
    x = least * y + np.sqrt(max(0.0, 1 - least * least)) * u
    return float(np.quantile(_needs(graph, x.astype(np.float32), y.astype(np.float32)), AT_THRESHOLD))


def _audit(routers: dict, least: float):
    """(rid, probe, bin, k): links of the probes against all vectors by brute force, by the margin that finds them, in thousandths."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rid, rep = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            out = [np.zeros((0, 4), np.int64)]
            for r in np.unique(rid).tolist():
                graph, probes, names = routers.value[r]
                at = np.flatnonzero(rid == r)
                x = _units(_matrix(batch.column(2).take(pa.array(at)))).astype(np.float32)
                i, j = np.nonzero(x @ probes.T >= least)
                other = rep[at[i]] != names[j]
                i, j = i[other], j[other]
                if len(i):
                    bins = np.maximum(np.ceil(_needs(graph, x[i], probes[j]) * 1000), 0).astype(np.int64)
                    pair, k = np.unique(np.stack([j, bins], axis=1), axis=0, return_counts=True)
                    out.append(np.column_stack([np.full(len(k), r), pair, k]))
            got = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, c], pa.int64()) for c in range(4)], names=["rid", "probe", "bin", "k"])

    return run


def _enough(found: list, recall: float) -> float:
    """The least margin by which the probes' links are found, on the average over probes. found: (probe, bin, k)."""
    if not found:
        return 0.0
    probe, bins, k = np.array(found, np.int64).T
    _, probe = np.unique(probe, return_inverse=True)
    part = k / np.bincount(probe, k)[probe] / (probe.max() + 1)
    order = np.argsort(bins, kind="stable")
    enough = np.searchsorted(np.cumsum(part[order]), recall - 1e-9)
    return float(bins[order][min(enough, len(order) - 1)]) / 1000


def _route(routers: dict):
    """Rows with cells: the home first, then others within the label's margin. Labels without a router: cell 0."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rid = batch.column(batch.num_columns - 1).fill_null(-1).to_numpy(zero_copy_only=False)
            size, flat, order = np.ones(batch.num_rows, np.int64), [], []
            for r in np.unique(rid).tolist():
                at = np.flatnonzero(rid == r)
                order.append(at)
                if r < 0:
                    flat.append(np.zeros(len(at), np.int64))
                    continue
                graph, margin = routers.value[r]
                ids = graph.near(_units(_matrix(batch.column(batch.num_columns - 2).take(pa.array(at)))).astype(np.float32), margin)[0]
                size[at] = (ids >= 0).sum(axis=1)
                flat.append(ids[ids >= 0])
            order = np.concatenate([*order, np.zeros(0, np.int64)])
            ends = np.concatenate([[0], np.cumsum(size[order])])
            cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*flat, np.zeros(0, np.int64)]), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], cells.take(pa.array(np.argsort(order)))], names=[*batch.schema.names[:-1], "cells"])

    return run


def _search(least: float):
    """Links of a cell's own vectors to each other and to visitors: link counts and a spanning forest.

    A pair that two cells see counts in the lesser of them. Cosines near least are checked in double
    precision. A group of many near vectors leaves a count for each and a tree, not its pairs.
    """

    def run(key, table):
        import pyarrow as pa

        cell, i, j = (key[c].as_py() for c in (2, 3, 4))
        part = table.column("part").to_numpy()
        home = table.column("home").to_numpy()
        own = home == cell
        left = np.flatnonzero(own & (part == i))
        right = np.flatnonzero(~own) if i == j else np.flatnonzero(part == j)
        order = np.concatenate([left, right])
        m, same = len(left), i == j
        units = _units(_matrix(table.column("v").combine_chunks()))[order]
        small = units.astype(np.float32)
        rep, n, home = table.column("rep").to_numpy()[order], table.column("n").to_numpy()[order], home[order]
        single = bool((n == 1).all())
        cells = table.column("cells").combine_chunks()
        flat, ends = cells.values.to_numpy(), cells.offsets.to_numpy()
        first = 0 if same else m  # columns: own vectors too, or the right ones only
        counts, lab, flag, edges = np.zeros(len(order), np.int64), np.arange(len(order)), np.zeros(len(order), bool), []
        lesser = np.flatnonzero(home < cell)
        lesser = lesser[lesser >= m]
        names, which = np.unique(home[lesser], return_inverse=True)
        for a in range(0, m, 512):
            b = min(a + 512, m)
            s = small[a:b] @ small[first:].T
            near = s >= least - 1e-4
            if same:
                near[np.arange(b - a), np.arange(a, b)] = False
            if not near.any():
                continue
            x, y = np.nonzero(near & (s < least + 1e-4))
            for t in range(0, len(x), 65536):
                p, q = x[t : t + 65536], y[t : t + 65536]
                near[p, q] = np.einsum("ij,ij->i", units[a + p], units[first + q]) >= least
            if len(lesser) and near[:, lesser - first].any():
                visits = np.zeros((b - a, len(names)), bool)
                for r in range(a, b):
                    c = flat[ends[left[r]] : ends[left[r] + 1]]
                    visits[r - a, np.flatnonzero(np.isin(names, c))] = True
                near[:, lesser - first] &= ~visits[:, which]
            for r in np.flatnonzero(near.any(axis=1)).tolist():
                c = np.flatnonzero(near[r]) + first
                counts[a + r] += len(c) if single else int(n[c].sum())
                at = lab[c]
                new = at != lab[a + r]
                if new.any():
                    merged, one = np.unique(at[new], return_index=True)
                    edges += [(a + r, e) for e in c[new][one].tolist()]
                    flag[merged] = True
                    lab[flag[lab]] = lab[a + r]
                    flag[merged] = False
            back = near[:, m - first :]
            for t in range(0, back.shape[0], 64):
                counts[m:] += n[a + t : a + min(t + 64, b - a)] @ back[t : t + 64]
        linked = np.flatnonzero(counts)
        a_ = np.concatenate([rep[linked], rep[[x for x, _ in edges]]]) if edges else rep[linked]
        b_ = [None] * len(linked) + [int(rep[y]) for _, y in edges]
        k_ = np.concatenate([counts[linked], np.zeros(len(edges), np.int64)])
        return pa.table({"a": pa.array(a_, pa.int64()), "b": pa.array(b_, pa.int64()), "k": pa.array(k_, pa.int64())})

    return run


def _routers(points: DataFrame, least: float, recall: float, audits: int, shard: int) -> tuple[DataFrame, dict]:
    """(points with rid, routers): a graph over the centres of each label of more than shard vectors, and its margin."""
    spark = points.sparkSession
    large = points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > shard).orderBy("label", "dim").collect()
    if not large:
        return points.withColumn("rid", F.lit(None).cast("long")), {}
    each = max(16, min(audits, PROBES // len(large)))
    want = [max(DRAWN * -(-r.m // shard), each) for r in large]
    kinds = f"label {dict(points.dtypes)['label']}, dim int, rid long, rate double"
    known = F.broadcast(spark.createDataFrame([(r.label, r.dim, i, min(1.0, 1.2 * w / r.m + 64 / r.m)) for i, (r, w) in enumerate(zip(large, want))], kinds))
    told = points.join(known, ["label", "dim"], "left")
    draw = F.pmod(F.xxhash64(F.lit(7), "rep"), F.lit(1 << 40))
    drawn = told.where(draw < F.col("rate") * (1 << 40)).select("rid", draw.alias("u"), "rep", "v").toArrow()
    rid, u, rep = (drawn.column(c).to_numpy() for c in range(3))
    graphs, audit = [], {}
    for i, r in enumerate(large):
        at = np.flatnonzero(rid == i)
        at = at[np.lexsort((rep[at], u[at]))]
        units = _units(_matrix(drawn.column("v").take(at).combine_chunks()))
        graphs.append(Hnsw(_centres(units, -(-r.m // shard))))
        audit[i] = graphs[-1], units[-each:].astype(np.float32), rep[at][-each:]
    sent = spark.sparkContext.broadcast(audit)
    found = told.where("rid IS NOT NULL").select("rid", "rep", "v").mapInArrow(_audit(sent, least), "rid long, probe long, bin long, k long")
    links: dict[int, list] = {}
    for r in found.groupBy("rid", "probe", "bin").agg(F.sum("k").alias("k")).collect():
        links.setdefault(r.rid, []).append((r.probe, r.bin, r.k))
    margins = [max(_enough(links.get(i, []), recall), _at_threshold(g, audit[i][1], least)) + 1e-4 for i, g in enumerate(graphs)]
    return told.drop("rate"), dict(enumerate(zip(graphs, margins)))


def near_vectors(vectors: DataFrame, least: float = 0.93, recall: float = 0.98, audits: int = 256, shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors of equal label linked at a cosine of least or more.

    Copies (equal components) are one point that carries their number. A label of more than shard
    points has centres, drawn from a sample of DRAWN vectors a centre, under a small-world graph. Every
    point walks it to the cell of its nearest centre, its home, and visits each cell whose centre is as
    near but for a margin; there it meets all points at home. The margin is the least that finds
    the given share of the links of `audits` probes, which are compared with all points by brute force, and
    AT_THRESHOLD of pairs just at the threshold in random directions. Cosines near least are checked in
    double precision. A task leaves the number of links of each point and a spanning forest of them,
    never the pairs of a group.

    Null label; null or zero vector; null or non-finite components: no links, a component of its own,
    kept. Null vec_id: no links, component_id null, kept. Vectors of different length don't meet. Repeated rows are copies. Other columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("_good", good)
    points = rows.where("_good").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("v"))
    points = cut(points, "vectors-points")
    release(spark)
    told, routers = _routers(points, least, recall, audits, shard)
    kind, item = dict(points.dtypes)["label"], dict(points.dtypes)["v"]
    sent = spark.sparkContext.broadcast(routers)
    routed = told.select("label", "dim", "rep", "n", "v", "rid").mapInArrow(_route(sent), f"label {kind}, dim int, rep long, n long, v {item}, cells array<int>")
    routed = cut(routed, "vectors-routed")
    drop(points)

    keys = ["label", "dim", "cell"]
    seen = routed.select("label", "dim", F.posexplode("cells").alias("o", "cell"))
    sizes = seen.groupBy(*keys).agg(F.count_if(F.col("o") == 0).alias("h"), F.count_if(F.col("o") > 0).alias("g"))
    sizes = cut(sizes, "vectors-cells")
    total = sizes.agg(F.sum(F.col("h") + F.col("g"))).first()[0] or 0
    chunks = lambda c: F.ceil(F.col(c) / CHUNK).cast("int")
    over = F.broadcast(sizes.where(F.col("h") + F.col("g") > CHUNK).select(*keys, F.greatest(chunks("h"), F.lit(1)).alias("hs"), chunks("g").alias("gs")))
    met = routed.select("label", "dim", "rep", "n", "v", "cells", F.col("cells")[0].alias("home"), F.explode("cells").alias("cell")).join(over, keys, "left")
    mine, whole = F.col("home") == F.col("cell"), F.col("hs").isNull()
    deal = F.xxhash64(F.lit(3), "rep")
    met = met.withColumn("part", F.when(whole, 0).when(mine, F.pmod(deal, "hs")).otherwise(F.col("hs") + F.pmod(deal, F.greatest("gs", F.lit(1)))).cast("int"))
    tasks = F.when(whole, F.expr("array(struct(0 AS i, 0 AS j))"))
    tasks = tasks.when(mine, F.expr("transform(sequence(0, hs + gs - 1), x -> struct(least(x, part) AS i, greatest(x, part) AS j))"))
    tasks = tasks.otherwise(F.expr("transform(sequence(0, hs - 1), x -> struct(x AS i, part AS j))"))
    met = met.withColumn("t", F.explode(tasks)).select(*keys, "t.i", "t.j", "rep", "n", "v", "home", "cells", "part")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 100_000))
    by = [*keys, "i", "j"]
    links = cut(met.repartition(buckets, *by).groupBy(*by).applyInArrow(_search(least), "a long, b long, k long"), "vectors-links")
    drop(sizes)
    release(spark)
    found = components(links.where("b IS NOT NULL").select("a", "b"), "vectors-edges")
    degree = links.where("b IS NULL").groupBy(F.col("a").alias("p")).agg(F.sum("k").alias("k"))
    known = routed.join(degree, routed["rep"] == degree["p"], "left").join(found, routed["rep"] == found["v"], "left")
    known = known.select(routed["label"].alias("_l"), routed["v"].alias("_v"), (F.coalesce("k", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(known, F.col("_good") & (rows["label"] == known["_l"]) & (rows["v"] == known["_v"]), "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


QUERIES = {"op9_embedding_dedup": op9_embedding_dedup}
SQL: dict[str, str] = {}
