"""Approximate nearest neighbours by inner product: inverted lists scanned with adaptive dimensions.

Largest inner product becomes smallest distance by one more component that makes all candidates
equally long. Vectors are dealt out to lists by their nearest of a few centres (fitted on a bounded
sample; every vector is indexed). A query visits the lists of its nearest centres; lists that lie near
each other are scanned in one group, so that a query is sent once to all of them and answers with k rows
for all of them. There vectors are randomly rotated and stored in blocks of dimensions; after every
block a hypothesis test on the partial distance abandons candidates that are unlikely to beat the
query's k-th distance. Scores of the others are exact, from the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.session import materialize

#: Vectors the centres are fitted on, at most; rounds of fitting; lists, at most.
SAMPLE_ROWS, FIT_ROUNDS, MAX_LISTS = 32_768, 8, 2_048
#: Share of the lists a query visits, and lists it visits at least.
PROBED, LEAST_PROBED = 0.6, 32
#: Dimensions after which candidates are tested, and the test's strictness.
DIMENSIONS, EPSILON = 16, 2.1
#: Rows of a block of lists, and its queries, in one group at most (on average); more are split.
GROUP_ROWS, GROUP_QUERIES = 4_096, 4_096
#: Queries and rows of lists whose distances are held at once; share of pairs below which only these go on.
QUERY_ROWS, LIST_ROWS, FEW_PAIRS = 128, 512, 0.05
#: Queries whose distances to all centres are held at once.
VISIT_ROWS = 1_024


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    infinite = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_centres(vectors: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from a random start; an empty centre moves to the row farthest from its own."""
    rng = np.random.default_rng(11)
    centres = vectors[rng.choice(len(vectors), k, replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        near, distance = nearest(vectors, centres, 1)
        own = near[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        count = np.bincount(own, minlength=k)
        empty = np.flatnonzero(count == 0)
        centres = sums / np.maximum(count, 1)[:, None]
        centres[empty] = vectors[np.argsort(-distance[:, 0], kind="stable")[: len(empty)]]
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n nearest centres, nearest first, and the squared distances."""
    squares = (centres**2).sum(axis=1)
    rows, far = [], []
    for at in range(0, len(vectors), 4096):
        part = vectors[at : at + 4096]
        d = (part**2).sum(axis=1)[:, None] + squares - 2 * part @ centres.T
        own = np.argsort(d, axis=1, kind="stable")[:, :n] if n > 1 else d.argmin(axis=1)[:, None]
        rows.append(own)
        far.append(np.take_along_axis(d, own, axis=1))
    if not rows:
        return np.zeros((0, n), np.int64), np.zeros((0, n))
    return np.concatenate(rows), np.concatenate(far)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of equal lengths, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _longer(vectors: np.ndarray, square: float) -> np.ndarray:
    """With the component that gives every row the same length."""
    rest = np.sqrt(np.maximum(0.0, square - (vectors**2).sum(axis=1)))
    return np.hstack([vectors, rest[:, None]])


def _pairs(blocks: list, parts: list, edges: list[int], alive: np.ndarray, beat: np.ndarray, slack: np.ndarray):
    """(query, candidate, distance) of the pairs of ``alive`` that no test on a partial distance abandons.

    All pairs are measured side by side, block after block, without the candidates that no query wants
    any more; where few pairs are left, only these.
    """
    size = edges[-1]
    columns = np.flatnonzero(alive.any(axis=0))
    alive = alive[:, columns]
    far = np.zeros(alive.shape)
    few = None
    for block, part, to in zip(blocks, parts, edges[1:], strict=True):
        limit = (beat * (1 + EPSILON / np.sqrt(to)) ** 2 * (to / size) if to < size else beat) + slack
        if few is not None:
            q, c, d = few
            d = d + ((block[c] - part[q]) ** 2).sum(axis=1)
            keep = d <= limit[q]
            few = q[keep], c[keep], d[keep]
            continue
        own = block[columns]
        far += (own**2).sum(axis=1) + (part**2).sum(axis=1)[:, None] - 2 * part @ own.T
        alive &= far <= limit[:, None]
        wanted = alive.any(axis=0)
        if wanted.sum() < 0.9 * len(wanted):
            columns, alive, far = columns[wanted], alive[:, wanted], far[:, wanted]
        if np.count_nonzero(alive) <= FEW_PAIRS * alive.size:
            q, c = np.nonzero(alive)
            few = q, columns[c], far[q, c]
    if few is not None:
        return few
    q, c = np.nonzero(alive)
    return q, columns[c], far[q, c]


def scan(
    vectors: np.ndarray,
    ids: np.ndarray,
    lists: np.ndarray,
    queries: np.ndarray,
    names: np.ndarray,
    visits: np.ndarray,
    square: float,
    k: int,
):
    """The k best of these lists for each query: (query's number, ids, scores), by query and rank.

    ``lists`` numbers each vector's list, ``visits`` says by query and list what is visited. The k-th
    distance found so far is the one to beat; it goes on from list to list.
    """
    size = vectors.shape[1] + 1
    turn, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((size, size)))
    turned = _longer(vectors, square) @ turn
    asked = np.hstack([queries, np.zeros((len(queries), 1))]) @ turn
    edges = [*range(0, size, DIMENSIONS), size]
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    blocks = [np.ascontiguousarray(turned[:, a:b]) for a, b in spans]
    rounding = 1e-9 * (square + (asked**2).sum(axis=1))
    out = []
    for at in range(0, len(queries), QUERY_ROWS):
        some = slice(at, at + QUERY_ROWS)
        parts = [np.ascontiguousarray(asked[some, a:b]) for a, b in spans]
        slack = rounding[some]
        best = np.full((len(slack), k), np.inf)
        found = []
        for start in range(0, len(ids), LIST_ROWS):
            here = slice(start, start + LIST_ROWS)
            alive = visits[some][:, lists[here]] & (ids[None, here] != names[some, None])
            q, c, far = _pairs([x[here] for x in blocks], parts, edges, alive, best[:, k - 1], slack)
            if len(q):
                grid = np.full(alive.shape, np.inf)
                grid[q, c] = far
                best = np.partition(np.hstack([best, grid]), k - 1, axis=1)[:, :k]
                keep = far <= best[q, k - 1] + slack[q]
                found.append((q[keep], c[keep] + start, far[keep]))
        if not found:
            continue
        q, c, far = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = far <= best[q, k - 1] + slack[q]
        q, c = q[keep], c[keep]
        score = np.concatenate(
            [np.zeros(0)]
            + [(vectors[c[i : i + 65_536]] * queries[some][q[i : i + 65_536]]).sum(axis=1) for i in range(0, len(q), 65_536)]
        )
        order = np.lexsort((ids[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < k
        out.append((q[top] + at, ids[c[top]], score[top]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def blocks_of_lists(centres: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lists in the order of their centres along the widest direction, block of each in that order).

    A block has lists of GROUP_ROWS rows together, or one longer list.
    """
    around = centres - centres.mean(axis=0)
    order = np.argsort(around @ np.linalg.svd(around, full_matrices=False)[2][0], kind="stable")
    block, held, out = 0, 0, []
    for x in sizes[order]:
        if held and held + x > GROUP_ROWS:
            block, held = block + 1, 0
        held += x
        out.append(block)
    return order, np.array(out)


def search(
    table: DataFrame, key: str, vector: str, queries: Column, k: int = 20, probed: float = PROBED
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``queries`` holds.

    Candidates are all rows but those of the query's own key. Rows whose vector is null, zero, of
    another length than most or has a null or non-finite component take no part, nor do rows
    without a key. Rows of one key count once (the smallest of their vectors). Equal scores go by
    the smaller key. An empty table gives no rows. ``key`` must be a long.
    """
    spark = table.sparkSession
    sound = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"), queries.alias("asks"))
    sound = sound.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    once = sound.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    rows = materialize(once)
    schema = "query_id long, rank int, vec_id long, score double"
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == length["d"])
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    stats = rows.agg(F.count("*").alias("n"), F.max(squares).alias("square")).first()
    n, square = stats["n"], stats["square"]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").collect()
    known = _longer(np.array([r[0] for r in sample], np.float64), square)
    lists = max(1, min(int(np.sqrt(n)), MAX_LISTS, len(known)))
    centres = fit_centres(known, lists)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, _ = nearest(_longer(_matrix(batch.column("vector")), square), centres, 1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near[:, 0].astype(np.int32))], names=[*batch.schema.names, "list"]
                )

    kind = rows.schema["vector"].dataType.simpleString()
    placed = materialize(rows.mapInArrow(place, f"vec_id long, vector {kind}, asks boolean, list int"))
    sizes = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # a row per list
        sizes[r[0]] = r[1]
    visits = min(lists, max(LEAST_PROBED, int(np.ceil(probed * lists))))

    ordered, block = blocks_of_lists(centres, sizes)
    block_of = np.zeros(lists, np.int32)
    block_of[ordered] = block

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per query and block of lists, with the lists to visit there."""
        for whole in batches:
            for at in range(0, whole.num_rows, VISIT_ROWS):
                batch = whole.slice(at, VISIT_ROWS)
                vectors = _matrix(batch.column("vector"))
                near, _ = nearest(np.hstack([vectors, np.zeros((len(vectors), 1))]), centres, lists)
                # At least so many lists, and more until they hold k rows besides the query's own.
                held = np.cumsum(sizes[near], axis=1)
                enough = (held <= k).sum(axis=1) + 1
                wanted = np.zeros(near.shape, bool)
                ranks = np.arange(lists)[None, :] < np.maximum(visits, enough)[:, None]
                np.put_along_axis(wanted, near, ranks, axis=1)
                row, place = np.nonzero(wanted[:, ordered])
                starts = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(block[place], prepend=-1))
                listed = pa.ListArray.from_arrays(
                    pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(ordered[place].astype(np.int32))
                )
                sent = pa.array(row[starts])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(sent), batch.column("vector").take(sent),
                     pa.array(block[place[starts]].astype(np.int32)), listed],
                    names=["query_id", "query", "block", "lists"],
                )

    asked = placed.where("asks").select("vec_id", "vector")
    visiting = materialize(asked.mapInArrow(visit, f"query_id long, query {kind}, block int, lists array<int>"))
    asking = np.zeros(block[-1] + 1, np.int64)
    for r in visiting.groupBy("block").count().collect():  # a row per block
        asking[r[0]] = r[1]
    held = np.bincount(block_of, weights=sizes).astype(np.int64)
    # Long blocks and blocks with many queries are split; every part meets every part of the other side.
    parts = F.array(*[F.lit(int(-(-x // GROUP_ROWS)) or 1) for x in held])
    askers = F.array(*[F.lit(int(-(-x // GROUP_QUERIES)) or 1) for x in asking])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.get(n, F.col("block")) - 1))
    own = lambda n, c: F.pmod(F.xxhash64(c), F.get(n, F.col("block"))).cast("int")
    left = placed.withColumn("block", F.get(F.array(*[F.lit(int(x)) for x in block_of]), F.col("list")))
    left = left.select("block", own(parts, "vec_id").alias("part"), every(askers).alias("asker"), "list", "vec_id", "vector")
    right = visiting.select(
        "block", every(parts).alias("part"), own(askers, "query_id").alias("asker"), "lists", "query_id", "query"
    )

    def meet(key: tuple, candidates: pa.Table, wanting: pa.Table) -> pa.Table:
        q, near, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        names = wanting.column("query_id").to_numpy()
        if candidates.num_rows and wanting.num_rows:
            ids, listed = candidates.column("vec_id").to_numpy(), candidates.column("list").to_numpy()
            order = np.lexsort((ids, listed))
            here, number = np.unique(listed[order], return_inverse=True)
            vectors = _matrix(candidates.column("vector"))[order]
            visited = np.zeros((len(names), lists), bool)
            each = wanting.column("lists").combine_chunks()
            visited[np.repeat(np.arange(len(names)), each.value_lengths().to_numpy()), each.flatten().to_numpy()] = True
            q, near, score = scan(
                vectors, ids[order], number, _matrix(wanting.column("query")), names, visited[:, here], square, k
            )
        return pa.table(
            {
                "query_id": pa.array(names[q], pa.int64()),
                "vec_id": pa.array(near, pa.int64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    by = ["block", "part", "asker"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
