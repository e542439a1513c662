"""Embedding near-dedup: a hierarchical navigable small-world graph per shard, every shard queried, links verified.

Equal vectors of a label are one class. Classes are dealt to shards of bounded size; each shard gets a graph of its own,
built in batches with numpy. Every block of classes queries every shard
of its label: from what a query's beam holds within the threshold it goes on along links, in either direction, to all that is
within it, so a large group costs what it holds. The block's beam widens until it finds all true links of an audit: a sample of
the block's queries, and where these have few links planted ones too, vectors of the shard turned to a cosine just over the
threshold, so that an audit sees links however rare they are. All answers are the graph's. Only where no beam passes the audit is the shard compared as a whole, and a
warning logged. Cosines are verified in double precision.
"""

from __future__ import annotations

import logging
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.plans.components import components, least_reachable
from meshwork.plans.durable import drop, written
from meshwork.plans.skew import lookup

SHARD_ROWS, BLOCK_ROWS = 20_000, 2_000  #: classes in a shard's graph, and in a block of queries: memory of one task
#: So many queries of a block are audited against brute force, and as many planted ones if those have fewer links.
AUDIT = 48
#: A query that links with this share of a shard or more is compared with all of it, so with at most WHOLE vectors for each of its links.
WHOLE = 32
log = logging.getLogger(__name__)


class Hnsw:
    """Graph over unit vectors, ordered so that level l holds the first ``sizes[l]`` of them."""

    def __init__(self, x: np.ndarray, m: int = 12, ef: int = 48):
        self.x, self.m, self.ef = x, m, ef
        self.sizes = [len(x)]
        while self.sizes[-1] > 64:
            self.sizes.append(max(16, self.sizes[-1] // 16))
        self.links = [np.full((n, 2 * m if i == 0 else m), -1, np.int32) for i, n in enumerate(self.sizes)]
        for level in range(len(self.sizes) - 1, -1, -1):
            self._build(level)

    def _build(self, level: int) -> None:
        n, x, done = self.sizes[level], self.x, 0
        while done < n:
            size = min(512, max(32, done), n - done)
            q = x[done : done + size]
            near = q @ q.T
            np.fill_diagonal(near, -np.inf)
            k = min(self.ef, size - 1)
            own = np.argsort(-near, 1)[:, :k]
            ids, sims = own + done, np.take_along_axis(near, own, 1)
            if done:
                found, fs = self._beam(q, level, self._entries(q, level, done), self.ef, done)
                ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, fs], 1)
            if ids.shape[1]:
                order = np.argsort(-sims, 1)[:, : self.ef]
                self._connect(level, np.arange(done, done + size), np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1))
            done += size

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Diverse neighbours: nearest first, skipping those nearer to a chosen one than to the point; gaps filled by nearest."""
        rows, width = ids.shape
        v = self.x[np.maximum(ids, 0)]
        between = np.einsum("bid,bjd->bij", v, v)
        open_, out = ids >= 0, np.full((rows, most), -1, np.int32)
        taken, at = np.zeros_like(open_), np.arange(rows)
        for k in range(min(most, width)):
            pool = np.where(open_.any(1)[:, None], open_, (ids >= 0) & ~taken)
            first = pool.argmax(1)
            ok = pool[at, first]
            out[ok, k] = ids[at, first][ok]
            taken[at, first] |= ok
            open_[at, first] = False
            open_ &= ~((between[at, first] > sims) & ok[:, None])
        return out

    def _connect(self, level: int, points: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        links = self.links[level]
        most = links.shape[1]
        links[points] = chosen = self._choose(np.where(np.isfinite(sims), ids, -1), sims, most)
        src, dst = np.repeat(points, most), chosen.ravel()
        keep = dst >= 0
        src, dst = src[keep], dst[keep]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        target, start, count = np.unique(dst, return_index=True, return_counts=True)
        extra = np.full((len(target), min(int(count.max(initial=0)), 2 * most)), -1, np.int32)
        nth = np.arange(len(dst)) - np.repeat(start, count)
        fits = nth < extra.shape[1]
        extra[np.repeat(np.arange(len(target)), count)[fits], nth[fits]] = src[fits]
        for a in range(0, len(target), 512):
            t = target[a : a + 512]
            every = np.concatenate([links[t], extra[a : a + 512]], 1)
            every = np.where(np.triu(every[:, :, None] == every[:, None, :], 1).any(1), -1, every)
            s = np.where(every >= 0, np.einsum("bd,bkd->bk", self.x[t], self.x[np.maximum(every, 0)]), -np.inf)
            o = np.argsort(-s, 1)
            links[t] = self._choose(np.take_along_axis(every, o, 1), np.take_along_axis(s, o, 1), most)

    def _entries(self, q: np.ndarray, level: int, limit: int) -> np.ndarray:
        """Where to enter a level: by brute force at the top, by a narrow beam below it."""
        top = len(self.sizes) - 1
        if level == top:
            return np.argsort(-(q @ self.x[: min(limit, 64)].T), 1)[:, :4]
        at = np.argsort(-(q @ self.x[: min(self.sizes[top], 64)].T), 1)[:, :4]
        for lv in range(top, level, -1):
            at = self._beam(q, lv, at, 12, self.sizes[lv])[0][:, :6]
        return np.where(at < limit, at, 0)

    def _beam(self, q: np.ndarray, level: int, entries: np.ndarray, ef: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        links, rows = self.links[level], len(q)
        step = max(3, ef // 24)
        seen = np.zeros((rows, limit + 1), bool)
        ids = np.full((rows, ef), -1, np.int64)
        sims, fresh = np.full((rows, ef), -np.inf), np.zeros((rows, ef), bool)
        new = entries.astype(np.int64)
        live = np.arange(rows)
        while len(live):
            new = np.sort(new, 1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new = np.where((new >= 0) & (new < limit), new, limit)
            rr = live[:, None]
            new = np.where(seen[rr, new], limit, new)
            seen[rr, new] = True
            seen[:, limit] = False
            s = np.where(new < limit, np.einsum("bd,bkd->bk", q[live], self.x[np.minimum(new, limit - 1)]), -np.inf)
            all_i = np.concatenate([ids[live], np.where(new < limit, new, -1)], 1)
            all_s = np.concatenate([sims[live], s], 1)
            all_f = np.concatenate([fresh[live], new < limit], 1)
            o = np.argsort(-all_s, 1, kind="stable")[:, :ef]
            ids[live], sims[live] = np.take_along_axis(all_i, o, 1), np.take_along_axis(all_s, o, 1)
            f = np.take_along_axis(all_f, o, 1)
            rank = np.cumsum(f, 1)
            go = f & (rank <= step)
            fresh[live] = f & ~go
            more = go.any(1)
            live, go = live[more], go[more]
            if len(live):
                first = np.argsort(~go, 1, kind="stable")[:, :step]
                nodes = np.where(np.take_along_axis(go, first, 1), ids[live[:, None], first], -1)
                new = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1).reshape(len(live), -1).astype(np.int64)
        return ids, sims

    def _both_ways(self) -> tuple[np.ndarray, np.ndarray]:
        """The links of the lowest level in either direction: where each vector's neighbours start, and the neighbours."""
        src, k = np.nonzero(self.links[0] >= 0)
        dst = self.links[0][src, k].astype(np.int64)
        src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
        return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(self.x)))]), dst[np.argsort(src, kind="stable")]

    def _spread(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, least: float, near: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """From what the beams found on to all that links between vectors within ``least`` lead to, each tried once a query."""
        n, (start, flat) = len(self.x), near
        seen, count = np.zeros(len(q) * n, bool), np.zeros(len(q), int)
        r, k = np.nonzero(ids >= 0)
        seen[r * n + ids[r, k]] = True
        r, k = np.nonzero((ids >= 0) & (sims >= least))
        hits = r * n + ids[r, k]
        every = [hits]
        while len(hits):
            r, c = np.divmod(hits, n)
            count += np.bincount(r, minlength=len(q))
            few = count[r] * WHOLE <= n
            r, c = r[few], c[few]
            size = start[c + 1] - start[c]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[c], size)
            new = np.repeat(r * n, size) + flat[at]
            new = np.unique(new[~seen[new]])
            seen[new] = True
            good = [np.einsum("id,id->i", q[part // n], self.x[part % n]) >= least for part in (new[a : a + 100_000] for a in range(0, len(new), 100_000))]
            hits = new[np.concatenate(good)] if good else new
            every.append(hits)
        found = np.sort(np.concatenate(every))
        out = [part % n for part in np.split(found, np.searchsorted(found, np.arange(1, len(q)) * n))]
        whole = np.flatnonzero(count * WHOLE > n)
        for i, row in zip(whole, q[whole] @ self.x.T >= least, strict=True):
            out[i] = np.flatnonzero(row)
        return out

    def within(self, q: np.ndarray, least: float, ef: int) -> Iterator[list[np.ndarray]]:
        """Slice by slice, indices of vectors at a similarity of ``least`` or more, as far as beams and the links from what they hold find them."""
        n = len(self.x)
        width, near = max(16, min(512, 4_000_000 // n, 40_000_000 // (n + 24 * ef * 8))), self._both_ways()
        for a in range(0, len(q), width):
            part = q[a : a + width]
            ids, sims = self._beam(part, 0, self._entries(part, 0, n), ef, n)
            yield self._spread(part, ids, sims, least, near)


def _unit(vectors) -> np.ndarray:
    """Rows of unit length; scaled by their largest component first, so that squares neither overflow nor vanish."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _order(keys) -> np.ndarray:
    """Keys are digests, so their order is random; the first ones become the upper levels."""
    return np.argsort(np.asarray(keys), kind="stable")


def _products(x: np.ndarray, q: np.ndarray, least: float) -> Iterator[list[np.ndarray]]:
    for a in range(0, len(q), 64):
        yield [np.flatnonzero(row) for row in q[a : a + 64] @ x.T >= least]


def _planted(x: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
    """Vectors of a shard turned in random directions to a cosine a quarter of the way from the threshold to 1."""
    base = x[rng.permutation(len(x))[:AUDIT]]
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(1, keepdims=True) * base
    size = np.linalg.norm(away, axis=1, keepdims=True)
    cos = threshold + (1 - threshold) / 4
    return np.where(size > 1e-9, cos * base + np.sqrt(1 - cos * cos) * away / np.maximum(size, 1e-9), base)  # in one dimension there is no turning


def beam_width(shard: Hnsw, ids: np.ndarray, q: np.ndarray, own: np.ndarray, threshold: float) -> tuple[int | None, float]:
    """The narrowest of the beams 32, 64, ... that finds every link of the audit, None if none does; and the first beam's recall."""
    rng = np.random.default_rng(len(q))
    sample = rng.permutation(len(q))[:AUDIT]
    asked = q[sample]
    truth = [h[ids[h] != own[i]] for i, h in zip(sample.tolist(), (h for part in _products(shard.x, asked, threshold) for h in part), strict=True)]
    if sum(map(len, truth)) < AUDIT:
        planted = _planted(shard.x, threshold, rng)
        asked = np.concatenate([asked, planted])
        truth += [h for part in _products(shard.x, planted, threshold) for h in part]
    true, ef, first = sum(map(len, truth)), 32, None
    while True:
        found = sum(len(np.intersect1d(g, t)) for g, t in zip((g for part in shard.within(asked, threshold, ef) for g in part), truth, strict=True))
        first = found / max(true, 1) if first is None else first
        log.info("beam %d found %d of %d audited links of %d queries", ef, found, true, len(asked))
        if found == true:
            return ef, first
        if ef >= len(shard.x):
            return None, first
        ef *= 2


def _query(shard: Hnsw, ids: np.ndarray, weights: np.ndarray, q: np.ndarray, own: np.ndarray, threshold: float) -> pd.DataFrame:
    """(u, v, n): v = -1 and the number of links for each query; and pairs that connect what the links connect, n = -1."""
    ef, recall = beam_width(shard, ids, q, own, threshold)
    if ef is None:
        log.warning("no beam finds the audited links (the first: %.3f of them), so %d vectors are compared as a whole", recall, len(shard.x))
    # one number for each vector, whether in the shard, in the block or in both; of a slice of queries only what it connects is kept
    nodes, at = np.unique(np.concatenate([ids, own]), return_inverse=True)
    mine, asks = at[: len(ids)], at[len(ids) :]
    top, links, done = np.arange(len(nodes)), np.zeros(len(q), np.int64), 0
    for hits in _products(shard.x, q, threshold) if ef is None else shard.within(q, threshold, ef):
        us, vs = np.repeat(asks[done : done + len(hits)], [len(h) for h in hits]), mine[np.concatenate(hits)]
        other = us != vs
        us, vs = us[other], vs[other]
        weight = np.zeros(len(nodes), np.int64)
        weight[mine] = weights
        number = np.zeros(len(nodes), np.int64)
        np.add.at(number, us, weight[vs])
        links[done : done + len(hits)] = number[asks[done : done + len(hits)]]
        top = least_reachable(top[us], top[vs], len(nodes))[top]
        done += len(hits)
    moved = np.flatnonzero(top != np.arange(len(nodes)))
    u, v = nodes[moved], nodes[top[moved]]
    return pd.DataFrame({"u": np.concatenate([own, u]), "v": np.concatenate([np.full(len(own), -1, np.int64), v]), "n": np.concatenate([links, np.full(len(u), -1, np.int64)])})


def near_dedup(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row: id, n_links (other vectors linked directly), component_id (smallest id reachable), kept (id = component_id).

    Vectors are compared only within a label and with those of their own length. Those without a label or an id, or null, empty,
    zero or with null or non-finite components, link with nothing. Equal vectors link with each other. Repeated
    rows count as vectors of their own. Other columns are ignored; an empty table gives an empty result.
    """
    v = F.col("__v")
    base = rows.select(F.col(id_col).cast("long").alias("__id"), F.col(vector_col).cast("array<double>").alias("__v"), F.col(label_col).cast("string").alias("__label"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0)
    good = F.coalesce(F.col("__label").isNotNull() & F.col("__id").isNotNull() & sound, F.lit(False))
    base = base.withColumn("key", F.when(good, F.sha2(F.concat(F.length("__label").cast("string"), F.lit(":"), F.col("__label"), F.concat_ws(",", v.cast("array<string>"))), 256)))
    classes = base.where("key is not null").groupBy("key").agg(F.first("__label").alias("label"), F.first("__v").alias("v"), F.min("__id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("d", F.size("v")).withColumn("num", F.monotonically_increasing_id()), "classes")  # num tells classes apart, ids may repeat
    per = classes.groupBy("label", "d").agg(F.count(F.lit(1)).alias("alike"))
    placed = classes.join(per, ["label", "d"]).withColumns({
        "shards": F.expr(f"1 + (alike - 1) div {SHARD_ROWS}"), "blocks": F.expr(f"1 + (alike - 1) div {BLOCK_ROWS}")})
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("key"), "shards")).withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), "blocks"))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[_order(pdf["key"])]
        graph = Hnsw(_unit(pdf["v"]))
        data = pickle.dumps((graph, pdf["num"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)), protocol=5)
        return pd.DataFrame({"label": [key[0]], "d": [key[1]], "shard": [key[2]], "blocks": [int(pdf["blocks"].iloc[0])], "graph": [data]})

    graphs = written(placed.groupBy("label", "d", "shard").applyInPandas(build, "label string, d int, shard long, blocks long, graph binary"), "graphs")

    def search(key, queries: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(graph):
            return pd.DataFrame({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64), "n": np.empty(0, np.int64)})
        shard, ids, weights = pickle.loads(graph["graph"].iloc[0])
        return _query(shard, ids, weights, _unit(queries["v"]), queries["num"].to_numpy(np.int64), threshold)

    asked = placed.select("label", "d", "block", "num", "v", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    offered = graphs.select("label", "d", "shard", "graph", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    keys = ["label", "d", "shard", "block"]
    found = written(asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInPandas(search, "u long, v long, n long"), "found")
    drop(graphs)
    links = found.where("v < 0").groupBy("u").agg(F.sum("n").alias("others"))
    comps = components(found.where("v >= 0").select("u", "v"))
    table = classes.select("key", "copies", "rep", "num").join(links, F.col("num") == links["u"], "left").join(comps, F.col("num") == comps["node"], "left")
    table = written(table.select("key", "copies", "rep", "num", F.coalesce("others", F.lit(0)).alias("others"), "component"), "numbered")
    named = table.where("component is not null").groupBy("component").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("members"))
    table = lookup(table, "component", F.xxhash64("num"), named, "component", "members", table.count())
    table = written(table.select("key", "copies", "others", F.coalesce("first", "rep").alias("component_id")), "table")
    total = base.count()
    out = lookup(base.select("__id", "key"), "key", F.xxhash64("__id"), table.withColumnRenamed("key", "k2"), "k2", "copies", total)
    linked = F.coalesce(F.col("others") + F.col("copies") - 1, F.lit(0)).cast("long")
    top = F.coalesce("component_id", "__id")
    return out.select(F.col("__id").alias(id_col), linked.alias("n_links"), top.alias("component_id"), F.col("__id").eqNullSafe(top).alias("kept"))
