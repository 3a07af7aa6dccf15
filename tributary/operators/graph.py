"""Graph operators over edges (from, to)."""

from __future__ import annotations

import heapq
import tempfile
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Edges that the exact order may hold in the driver's memory, more are read from its disk; rows that
#: it gives at once; and edges that a task sends to it.
RANK_EDGES, RANK_ROWS, SENT_EDGES = 200_000, 1_000_000, 1_000_000


def reachable(edges: DataFrame, start: str | None = None) -> DataFrame:
    """(source, node, hops): all that is downstream of each source, or of ``start``, over any number
    of edges, cycles included. Each round joins the frontier alone, drops what is known by an
    anti-join, and is written to the shared folder, so that lineage doesn't grow."""
    links = stored(edges.select("from", "to").where("`from` is not null and `to` is not null").distinct())
    first = links if start is None else links.where(F.col("from") == F.lit(start))
    front = stored(first.select(F.col("from").alias("source"), F.col("to").alias("node"), F.lit(1).alias("hops")))
    parts, hops = [front], 1
    while not front.isEmpty():
        hops += 1
        known = parts[0]
        for p in parts[1:]:
            known = known.union(p)
        nxt = front.join(links, F.col("node") == F.col("from")).select("source", F.col("to").alias("node")).distinct()
        front = stored(nxt.join(known, ["source", "node"], "left_anti").withColumn("hops", F.lit(hops)))
        parts.append(front)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest path from a node without inputs; nodes on or behind a cycle have a
    null level. A level-wise peeling: nodes without open inputs are placed, and what they lead to has as
    many fewer. A level joins the frontier alone with the edges, and writes what is left once."""
    links = stored(edges.select("from", "to").where("`from` is not null and `to` is not null").distinct())
    need = links.groupBy(F.col("to").alias("node")).agg(F.count("*").alias("need"))
    nodes = links.select(F.col("from").alias("node")).union(links.select(F.col("to").alias("node"))).distinct()
    state = stored(nodes.join(need, "node", "left").select("node", F.coalesce("need", F.lit(0)).alias("need")))
    placed, level = None, 0
    while True:
        ready = state.where("need = 0").select("node")
        if ready.isEmpty():
            break
        here = ready.withColumn("level", F.lit(level))
        placed = here if placed is None else placed.union(here)
        met = links.join(ready.withColumnRenamed("node", "from"), "from").groupBy(F.col("to").alias("node")).agg(F.count("*").alias("met"))
        state = stored(state.where("need > 0").join(met, "node", "left").select("node", (F.col("need") - F.coalesce("met", F.lit(0))).alias("need")))
        level += 1
    stuck = state.select("node", F.lit(None).cast("int").alias("level"))
    return stuck if placed is None else placed.union(stuck)


def ranks(edges: list[tuple[str, str]]) -> dict[str, int]:
    """Topological ranks where the least ready name goes first. Nodes on a cycle or behind one share
    the last rank; an edge from a node to itself is a cycle."""
    out, need = defaultdict(list), defaultdict(int)
    names = set()
    for a, b in set(edges):
        names |= {a, b}
        out[a].append(b)
        need[b] += 1
    ready = [n for n in names if not need[n]]
    heapq.heapify(ready)
    rank: dict[str, int] = {}
    while ready:
        n = heapq.heappop(ready)
        rank[n] = len(rank)
        for m in out[n]:
            need[m] -= 1
            if not need[m]:
                heapq.heappush(ready, m)
    cyclic = len(rank)
    return rank | {n: cyclic for n in names - set(rank)}


def _packed(numbered: DataFrame, n_edges: int, kind: type) -> DataFrame:
    """Rows of bytes: numbers of edges in order, up to as many rows as Arrow has in a batch. Ranges by
    both numbers, so that a node with many edges lies in several; none is more than a few MB."""
    kind = np.dtype(kind).str

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({c: pa.array([b.column(c).to_numpy().astype(kind).tobytes()], pa.binary()) for c in ("a", "b")})

    ranges = numbered.repartitionByRange(max(1, -(-n_edges // SENT_EDGES)), "a", "b").sortWithinPartitions("a", "b")
    return ranges.mapInArrow(pack, "a binary, b binary")


def _numbered_ranks(links: DataFrame, n_edges: int) -> DataFrame:
    """(node, r) as ``ranks`` has them, for any number of edges: names are numbered in their order by
    the executors, edges come as blocks of numbers into a file of the driver, and the driver's memory
    holds some numbers a node. ``links``: distinct edges without nulls."""
    spark = links.sparkSession
    names = links.select(F.col("from").alias("node")).union(links.select(F.col("to").alias("node"))).distinct()
    # sorted ranges: a range's number is above the 33 bits of a place in it
    order = stored(names.orderBy("node").select("node", F.monotonically_increasing_id().alias("m")))
    part = F.shiftright("m", 33).alias("p")
    sizes, n = sorted(map(tuple, order.groupBy(part).count().collect())), 0
    starts = []
    for p, size in sizes:
        starts.append((p, n - (p << 33)))
        n += size
    ids = stored(order.select("node", "m", part).join(F.broadcast(spark.createDataFrame(starts, "p bigint, start bigint")), "p").select("node", (F.col("m") + F.col("start")).alias("id")))
    a, b = (ids.select(F.col("node").alias(c), F.col("id").alias(k)) for c, k in (("from", "a"), ("to", "b")))
    numbered = stored(links.join(a, "from").join(b, "to").select("a", "b"))
    first, need = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
    kind = np.int32 if n < 1 << 31 else np.int64
    with tempfile.TemporaryFile() as file:
        for row in _packed(numbered, n_edges, kind).toLocalIterator():
            at, to = (np.frombuffer(x, kind) for x in row)
            np.add.at(first, at.astype(np.int64) + 1, 1)
            np.add.at(need, to, 1)
            file.write(to)
        file.flush()
        np.cumsum(first, out=first)
        # a view of the file, without the cost that each slice of a memmap has
        targets = np.asarray(np.memmap(file, kind, "r", shape=(int(first[-1]),))) if first[-1] else np.zeros(0, kind)
        start, heap = np.flatnonzero(need == 0), []
        rank, done, s = np.full(n, -1, np.int64), 0, 0
        while s < len(start) or heap:
            if s < len(start) and not (heap and heap[0] < start[s]):
                k = start[s]
                s += 1
            else:
                k = heapq.heappop(heap)
            rank[k] = done
            done += 1
            out = targets[first[k] : first[k + 1]]
            if len(out):
                left = need[out] - 1
                need[out] = left
                if not left.all():
                    for m in out[left == 0].tolist():
                        heapq.heappush(heap, m)
        del targets
    rank[rank < 0] = done
    places = None
    for k in range(0, max(n, 1), RANK_ROWS):
        r = rank[k : k + RANK_ROWS]
        part = stored(spark.createDataFrame(pa.table({"id": np.arange(k, k + len(r)), "r": r})))
        places = part if places is None else places.union(part)
    return ids.join(places, "id").select("node", "r")


def topological(edges: DataFrame, limit: int = RANK_EDGES) -> DataFrame:
    """``edges`` with ``rank``, their place in the exact order (rank of from, rank of to, from, to).

    The rule that the least ready name goes next can't be spread over tasks; distinct edges up to
    ``limit`` are ranked in the driver's memory, and more are numbered by the executors and ranked
    from the driver's disk, in the same order.
    """
    pairs = stored(edges.select("from", "to").distinct())
    spark = edges.sparkSession
    n = pairs.count()
    if n <= limit:
        found = ranks([(r["from"], r["to"]) for r in pairs.collect()])
        places = spark.createDataFrame(list(found.items()) or [], "node string, r bigint")
    else:
        places = _numbered_ranks(pairs.where("`from` is not null and `to` is not null"), n)
    j = edges.join(places.select(F.col("node").alias("from"), F.col("r").alias("rf")), "from").join(places.select(F.col("node").alias("to"), F.col("r").alias("rt")), "to")
    return j.select("*", F.struct("rf", "rt", "from", "to").alias("rank")).drop("rf", "rt")
