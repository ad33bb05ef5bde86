"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors collapse to one node with a weight, so that copies cost nothing.
2. Centroids are fitted on a bounded sample (SAMPLE rows, a documented bound; every row is indexed). Each node joins the
   shards of its OVERLAP nearest centroids. A shard over its size is dealt in blocks, and each pair of blocks is a shard.
3. A shard covers its members with balls: leaders no two of which link, and each other member with a leader that it links to. The
   leaders are the graph's nodes, so that a dense group costs one node and not a clique. Each leader's candidates are the nearest leaders
   and a few random ones, robust-pruned. The adjacency lists of all shards are united by node and written: this is the flat graph.
4. Each shard searches for each leader, over the united lists: greedily from the shard's medoid (and the leader's own node)
   until the beam settles, then on through every leader whose ball may be within the range, until none is left to expand.
   The range between two balls is that of a link, as an angle, and both their radii.
5. Members of the balls that met are verified by cosine in double precision, in blocks of bounded size. A pair that several shards hold
   is counted by the first of them alone. Links leave a shard as counts and as a spanning forest, never as pairs.
6. The audit measures recall: a block of nodes against all nodes by brute force. Below LEAST_RECALL the search is done again with a wider
   beam, at last with one that expands all of a shard; if that is not enough either, it is an error.

Null vectors, zero vectors, and those of another length than most or with null or non-finite components link with nothing.
Each row is a vector of its own: rows repeated with one vec_id link to each other. A null vec_id comes after all others
as component_id. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.components import components
from stepweave.llm.shared import work_dir, written

#: Rows to which the centroids are fitted, at most.
SAMPLE = 20_000
#: Centroids, at most: what is broadcast is 4,096 vectors.
CENTROIDS = 4096
OVERLAP = 3
#: Nodes of a shard: usual, and at most before it is dealt in blocks.
SHARD, LARGEST = 1500, 6000
#: SLACK: an angle; so far beyond the range leaders are still expanded.
DEGREE, BEAM, SLACK = 24, 24, 0.25
#: Queries that search a shard together, and cosines that are verified at once.
TOGETHER, CELLS = 128, 1 << 19
LEAST_RECALL = 0.9


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids_of(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1)
        centres[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centres


def _assign(held, overlap: int):
    """(node, weight, unit vector, its shards)."""

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column(1)))
            near = np.argsort(-(x @ held.value.T), axis=1, kind="stable")[:, :overlap]
            near = np.sort(near, axis=1).astype(np.int32)
            size = near.shape[1]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, size), pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), flat], names=["node", "weight", "v", "shards"])

    return rows


def cover(x: np.ndarray, least: float) -> np.ndarray:
    """For each row its leader: a row itself, with a cosine of `least` or more to it; no two leaders are so close."""
    own, leaders = np.full(len(x), -1), np.zeros(0, dtype=np.int64)
    for a in range(0, len(x), 512):
        part = np.arange(a, min(len(x), a + 512))
        if len(leaders):
            close = x[part] @ x[leaders].T
            hit = close.max(axis=1) >= least
            own[part[hit]] = leaders[np.argmax(close[hit], axis=1)]
        rest = part[own[part] < 0]
        close, waits, new = x[rest] @ x[rest].T >= least, np.ones(len(rest), dtype=bool), []
        for i in range(len(rest)):
            if waits[i]:
                new.append(rest[i])
                joins = waits & close[i]
                own[rest[joins]] = rest[i]
                own[rest[i]] = rest[i]
                waits &= ~joins
                waits[i] = False
        leaders = np.concatenate([leaders, np.array(new, dtype=np.int64)])
    return own


class Shard:
    """Members of one shard, and the balls that cover them. Leaders are numbered 0 ... in the order of members."""

    def __init__(self, table: pa.Table, least: float) -> None:
        self.node = table.column("node").to_numpy()
        self.weight = table.column("weight").to_numpy()
        self.x = _unit(_matrix(table.column("v")))
        self.home = _matrix(table.column("shards"))
        self.block = table.column("block").to_numpy()
        self.least = least
        own = cover(self.x, least)
        self.leaders, self.ball = np.unique(own, return_inverse=True)
        self.centre = self.x[self.leaders]
        angle = np.arccos(np.clip(np.einsum("ij,ij->i", self.x, self.centre[self.ball]), -1, 1))
        angle[self.leaders] = 0
        self.radius = np.zeros(len(self.leaders))
        np.maximum.at(self.radius, self.ball, angle)
        by_ball = np.argsort(self.ball, kind="stable")
        self.members = np.split(by_ball, np.cumsum(np.bincount(self.ball))[:-1])

    def medoid(self) -> int:
        return int(np.argmax(self.centre @ self.centre.mean(axis=0)))

    def build(self, degree: int = DEGREE, pool: int = 48) -> list[np.ndarray]:
        """Robust-pruned lists of leaders: of the candidates, nearest first, each that no kept one is clearly nearer to."""
        x = self.centre
        n = len(x)
        if n == 1:
            return [np.zeros(0, dtype=np.int64)]
        random = np.random.default_rng(n)
        pool = min(pool, n - 1)
        lists = []
        for a in range(0, n, 512):
            close = x[a : a + 512] @ x.T
            close[np.arange(len(close)), np.arange(a, a + len(close))] = -2
            near = np.argpartition(-close, pool - 1, axis=1)[:, :pool]
            for i in range(len(close)):
                far = random.integers(0, n, 8)
                cand = np.unique(np.concatenate([near[i], far[far != a + i]]))
                cand = cand[np.argsort(-close[i, cand], kind="stable")]
                own = 1 - close[i, cand]
                among = 1 - x[cand] @ x[cand].T
                alive, kept = np.ones(len(cand), dtype=bool), []
                for j in range(len(cand)):
                    if alive[j]:
                        kept.append(j)
                        if len(kept) == degree:
                            break
                        alive &= 1.44 * among[j] > own
                lists.append(cand[kept])
        back: list[list[int]] = [[] for _ in range(n)]
        for i, found in enumerate(lists):
            for j in found.tolist():
                back[j].append(i)
        return [np.unique(np.concatenate([found, np.array(b[: 2 * degree], dtype=np.int64)])) for found, b in zip(lists, back, strict=True)]

    def search(self, lists: list[np.ndarray], beam: int | None = BEAM) -> np.ndarray:
        """Pairs of balls (smaller number first) that the search met with a gap within the range. beam: None expands all."""
        n, reach = len(self.leaders), np.arccos(np.clip(self.least, -1, 1)) + 1e-7
        if n == 1 or not self.radius.any():  # no two leaders link
            return np.zeros((0, 2), dtype=np.int64)
        width = max(1, max(len(a) for a in lists))
        graph = np.full((n, width), n, dtype=np.int64)
        for i, a in enumerate(lists):
            graph[i, : len(a)] = a
        x, radius = np.vstack([self.centre, np.zeros((1, self.x.shape[1]))]), np.append(self.radius, 0.0)
        start, beam = self.medoid(), n if beam is None else min(beam, n)
        found = []
        for a in range(0, n, TOGETHER):
            q = np.arange(a, min(n, a + TOGETHER))

            def near(rows, nodes, q=q):
                """The gap between two balls, as a negative angle."""
                cosine = np.einsum("ij,ij->i", x[nodes], x[q[rows]])
                return radius[nodes] + radius[q[rows]] - np.arccos(np.clip(cosine, -1, 1))

            close = np.full((len(q), n + 1), -np.inf)  # of leaders met
            waits = np.full((len(q), n + 1), -np.inf)  # of leaders met and not expanded
            line = np.arange(len(q))
            for s in (np.full(len(q), start), q):
                close[line, s] = waits[line, s] = near(line, s)
            going, step = line, 0
            floor = np.full(len(q), -np.inf)  # the beam's last place; it only rises, so an old one is only more careful
            while len(going):
                best = np.argmax(waits[going], axis=1)
                score = waits[going, best]
                step += 1
                if beam < n and step % 6 == 0:
                    floor[going] = np.partition(close[going, :n], n - beam, axis=1)[:, n - beam]
                on = (score > -np.inf) & (score >= np.minimum(floor[going], -reach - SLACK))
                going, best = going[on], best[on]
                if not len(going):
                    break
                waits[going, best] = -np.inf
                next_ = graph[best]
                r, c = np.nonzero((next_ < n) & (close[going[:, None], next_] == -np.inf))
                nodes = next_[r, c]
                close[going[r], nodes] = waits[going[r], nodes] = near(going[r], nodes)
            i, j = np.nonzero(close[:, :n] >= -reach)
            i = q[i]
            # balls of one member each can't link, as leaders don't
            some = (i != j) & (self.radius[i] + self.radius[j] > 0)
            found.append(np.stack([np.minimum(i, j)[some], np.maximum(i, j)[some]], 1))
        return np.unique(np.concatenate(found), axis=0)

    def owned(self, rows: np.ndarray, columns: np.ndarray, cluster: int, pair: tuple[int, int]) -> np.ndarray:
        """Which pairs of members this shard counts: those that no earlier shard holds too."""
        own = np.ones((len(rows), len(columns)), dtype=bool)
        if pair[0] != pair[1]:
            own &= self.block[rows][:, None] != self.block[columns][None, :]
        mine, theirs = self.home[rows], self.home[columns]
        for k in range(mine.shape[1]):
            some = np.flatnonzero(mine[:, k] < cluster)
            if len(some):
                for m in range(theirs.shape[1]):
                    own[some] &= mine[some, k][:, None] != theirs[:, m][None, :]
        return own

    def links(self, met: np.ndarray, cluster: int, pair: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Weight linked to each member by the pairs that this shard counts, and each member's root in a forest of links."""
        weight, parent = np.zeros(len(self.node), dtype=np.int64), np.arange(len(self.leaders))

        def root(a: int) -> int:
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            return a

        cuts = np.searchsorted(met[:, 0], np.arange(len(self.leaders) + 1))
        for a in range(len(self.leaders)):
            balls = met[cuts[a] : cuts[a + 1], 1]
            if len(self.members[a]) == 1 and not len(balls):
                continue
            columns = np.concatenate([self.members[a], *[self.members[b] for b in balls]])
            inner = len(self.members[a])
            step = max(1, CELLS // len(columns))
            for i in range(0, inner, step):
                rows = self.members[a][i : i + step]
                sure = self.x[rows] @ self.x[columns].T >= self.least
                sure[:, :inner] &= rows[:, None] < columns[None, :inner]
                if len(balls):
                    for b in np.unique(self.ball[columns[inner:][sure[:, inner:].any(axis=0)]]):
                        first, second = root(a), root(int(b))
                        parent[max(first, second)] = min(first, second)
                sure &= self.owned(rows, columns, cluster, pair)
                weight[rows] += sure @ self.weight[columns]
                np.add.at(weight, columns, self.weight[rows] @ sure)
        top = np.array([root(a) for a in range(len(parent))], dtype=np.int64)
        return weight, self.leaders[top[self.ball]]


def _shards_of(batches):
    """Whole shards, one after another, from batches sorted by shard."""
    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("shard").to_pylist()
        cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if names[a] != name and held:
                yield name, pa.Table.from_batches(held)
                held = []
            name = names[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield name, pa.Table.from_batches(held)


def _build(least: float):
    def rows(batches):
        for _, table in _shards_of(batches):
            shard = Shard(table, least)
            names = shard.node[shard.leaders]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([names[a].tolist() for a in shard.build()], pa.list_(pa.int64()))], names=["node", "near"])

    return rows


def _find(least: float, beam: int | None):
    """Each shard's share: (node, weight linked to it by this shard, a link of the spanning forest)."""

    def rows(batches):
        for name, table in _shards_of(batches):
            shard = Shard(table, least)
            cluster, pair = name.split(":")
            at = {node: i for i, node in enumerate(shard.node[shard.leaders].tolist())}
            near = table.column("near").take(pa.array(shard.leaders)).to_pylist()
            lists = [np.array(sorted({at[m] for m in found or [] if m in at} - {i}), dtype=np.int64) for i, found in enumerate(near)]
            weight, joined = shard.links(shard.search(lists, beam), int(cluster), tuple(map(int, pair.split("-"))))
            some = np.flatnonzero((weight > 0) | (joined != np.arange(len(joined))))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(shard.node[some]), pa.array(weight[some]), pa.array(shard.node[joined[some]])], names=["node", "linked", "joined"])

    return rows


def _recall(held, least: float):
    """Brute force: for the audited nodes, the weight of all that link."""

    def rows(batches):
        nodes, x = held.value
        total = np.zeros(len(nodes), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                own = batch.column(0).to_numpy()
                hit = (x @ _unit(_matrix(batch.column(2))).T >= least) & (nodes[:, None] != own[None, :])
                total += hit @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(total)], names=["node", "linked"])

    return rows


def _truth(nodes: DataFrame, n: int, least: float, audit: int) -> dict[int, int]:
    """{node: weight that links by brute force} of about `audit` nodes, at most twice as many, of those that link."""
    spread = nodes.where(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(max(1, n // audit))) == 0).limit(2 * audit).select("node", "v").toArrow()
    if not spread.num_rows:
        return {}
    asked = nodes.sparkSession.sparkContext.broadcast((spread.column("node").to_numpy(), _unit(_matrix(spread.column("v")))))
    sums = nodes.select("node", "weight", "v").mapInArrow(_recall(asked, least), "node long, linked long").groupBy("node").agg(F.sum("linked").alias("truth"))
    return {r.node: r.truth for r in sums.where("truth > 0").collect()}


def vector_classes(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, audit: int = 256) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall): a row a vector.

    audit_recall: of the links that brute force finds for `audit` nodes, the share that the graph found (null: there are none)."""
    spark = vectors.sparkSession
    root = work_dir(spark, "vectors")
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.expr("coalesce(size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0), false)")
    rows = rows.withColumn("fine", fine)
    length = rows.where("fine").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if length is None:
        return alone(rows).withColumn("audit_recall", F.lit(None).cast("double"))
    used = F.col("fine") & (F.size("v") == length.n)
    distinct = rows.where(used).groupBy("v").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least_id"))
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()), f"{root}/nodes")
    n = nodes.count()
    k = int(min(CENTROIDS, max(1, -(-n * OVERLAP // shard))))
    share = min(1.0, SAMPLE / n)
    sample = nodes.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20))).limit(SAMPLE + SAMPLE // 4).select("v").toArrow()
    if not sample.num_rows:
        sample = nodes.limit(SAMPLE).select("v").toArrow()
    sample = _unit(_matrix(sample.column("v")))
    k = min(k, len(sample))
    held = spark.sparkContext.broadcast(centroids_of(sample, k))
    placed = written(nodes.select("node", "v", "weight").mapInArrow(_assign(held, min(OVERLAP, k)), "node long, weight long, v array<double>, shards array<int>"), f"{root}/placed")
    sizes = placed.select(F.explode("shards").alias("cluster")).groupBy("cluster").count()
    parts = sizes.select("cluster", F.greatest(F.lit(1), F.ceil(F.col("count") * 2 / LARGEST)).cast("int").alias("parts"))
    members = placed.withColumn("cluster", F.explode("shards")).join(F.broadcast(parts), "cluster")  # at most CENTROIDS rows
    members = members.withColumn("block", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    # block b joins the shards (a, b), a < b, (b, c), b < c, and (b, b), which alone counts its inner pairs
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    shard_name = F.format_string("%d:%d-%d", "cluster", F.least("block", "other"), F.greatest("block", "other"))
    members = members.select(shard_name.alias("shard"), "node", "weight", "v", "shards", "block")

    def sorted_by_shard(df):
        return df.repartition("shard").sortWithinPartitions("shard", "node")

    lists = sorted_by_shard(members).mapInArrow(_build(least), "node long, near array<long>")
    graph = written(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), f"{root}/graph")
    truth = _truth(nodes, n, least, audit)
    for beam in (BEAM, 8 * BEAM, None):
        found = sorted_by_shard(members.join(graph, "node", "left")).mapInArrow(_find(least, beam), "node long, linked long, joined long")
        found = written(found, f"{root}/found-{beam}")
        linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
        recall = None
        if truth:
            own = {r.node: r.linked for r in linked.where(F.col("node").isin(list(truth))).collect()}  # the audited nodes
            recall = sum(min(truth[i], own.get(i, 0)) for i in truth) / sum(truth.values())
        if recall is None or recall >= LEAST_RECALL:
            break
    else:
        raise RuntimeError(f"the graph finds {recall:.3f} of the audited links")

    classes = components(found.select(F.col("node").alias("u"), F.col("joined").alias("v")))
    named = nodes.select("node", "v", "weight", "least_id").join(classes, "node", "left").join(linked, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(smallest, "component").select("v", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")

    joined = rows.where(used).withColumn("h", F.xxhash64("v")).join(named.withColumn("h", F.xxhash64("v")), ["h", "v"])
    joined = joined.select("vec_id", "n_links", "component_id", F.expr("vec_id <=> component_id").alias("kept"))
    return joined.union(alone(rows.where(~used))).withColumn("audit_recall", F.lit(recall).cast("double"))
