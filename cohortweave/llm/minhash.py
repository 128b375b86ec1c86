"""Near-duplicate documents by a join of MinHash signatures over their coordinates.

Every distinct set of shingles gets a signature of COORDINATES values. The pairs (coordinate,
value) are the postings. Two signatures that agree in at least MATCHES coordinates must share one
of the COORDINATES - MATCHES + 1 rarest postings of either, so only this prefix is posted (skip
merging: long lists are never read, their matches are counted on the signatures themselves).
Pairs that agree often enough are confirmed on the full sets.

A list is not expanded into all its pairs. First every member meets central members of its lists;
the confirmed links make components. Members of different components of a list are then compared
by what they do not share with one central member, a pivot, and what few members have: in a few
rounds with two members each, then with all whose components are still apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.components import components
from cohortweave.llm.tables import bucketed
from cohortweave.llm.words import SLICE_BYTES, buffers, inside, map_texts, mix, windows, words_of
from cohortweave.session import materialize

#: Length of a signature, and how many coordinates a pair must share to be confirmed on its sets.
#: At a similarity of 0.8 a pair shares 51 on average; fewer than 38 happen once in 20,000 pairs.
COORDINATES, MATCHES = 64, 38
SIMILARITY = 80  # per cent
#: Largest share of two similar sets together that only one of them has, and a hair for rounding.
LARGEST = 1 - SIMILARITY / 100 + 1e-9
#: Bits of a coordinate's value by which unequal ones are told before a pair is made.
MARKED = 4
#: Members outside a component up to which they meet it directly.
FEW = 16
#: Rounds in which members meet two of their list before those still apart meet all.
ROUNDS = 2

_RNG = np.random.default_rng(20_240_601)
_XOR = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order, text after text, and n + 1 offsets.

    Shingles are runs of ``size`` words, A-Z lower-cased; a text with fewer words has them all as
    one shingle, a text without words has none.
    """
    words = words_of(texts, lower=True)
    ok = inside(words.text, size)
    hashes, text = windows(words.hashes, size)[ok], words.text[: len(ok)][ok]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.cumsum(counts) - counts
        own = np.full(len(short), 0x2545F4914F6CDD1D, np.uint64)
        for k in range(size - 1):
            more = counts[short] > k
            own[more] = mix(own[more] * np.uint64(0xD6E8FEB86659FD93) + words.hashes[first[short[more]] + k])
        hashes, text = np.concatenate([hashes, own]), np.concatenate([text, short])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=words.n_texts))])


def fingerprints(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each set; 0 for an empty one."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        sums = np.zeros(len(offsets) - 1, np.uint64)
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            sums[full] = np.add.reduceat(mix(hashes ^ np.uint64(salt)), offsets[full])
        out.append(mix(sums).view(np.int64))
    return out[0], out[1]


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x COORDINATES smallest values (int32)."""
    out = np.zeros((len(offsets) - 1, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for k in range(COORDINATES):
            value = ((hashes ^ _XOR[k]) * _MUL[k]) >> np.uint64(32)
            out[full, k] = np.minimum.reduceat(value, offsets[full])
    return out.view(np.int32)


def _signed(documents: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, n_shingles, node, proof, sig) per row; node and proof name the set."""

    def work(texts: pa.Array) -> list:
        hashes, offsets = shingle_sets(texts, size)
        node, proof = fingerprints(hashes, offsets)
        sig = signatures(hashes, offsets)
        flat = pa.array(sig.ravel())
        at = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * COORDINATES)
        return [np.diff(offsets), node, proof, pa.ListArray.from_arrays(at, flat)]

    return map_texts(documents, [key], text, "n_shingles long, node long, proof long, sig array<int>", work)


def _zipped(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, zip) per row: the text compressed. It is shuffled and stored in place of its set,
    whose hashes take several times as much and cannot be compressed."""

    def work(texts: pa.Array) -> list:
        data, at = buffers(texts)
        compress = zstandard.ZstdCompressor().compress
        return [[compress(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]]

    return map_texts(documents, [key], text, "zip binary", work)


def _portions(*zips: pa.Array) -> Iterator[slice]:
    """Runs of rows whose texts have at most SLICE_BYTES together, or of one row with longer texts."""
    size = sum(np.array([zstandard.frame_content_size(z.as_buffer()) for z in c], np.int64) for c in zips)
    ends = np.cumsum(size)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield slice(at, to)
        at = to


def _sets_of(zips: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    decompress = zstandard.ZstdDecompressor().decompress
    return shingle_sets(pa.array([decompress(z.as_buffer()) for z in zips], pa.binary()), size)


def _own_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, zip) of the rows whose text has the set that node names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, zips = np.asarray(batch.column("node")), batch.column("zip")
            keep = np.zeros(batch.num_rows, bool)
            for rows in _portions(zips):
                keep[rows] = fingerprints(*_sets_of(list(zips[rows]), size))[0] == nodes[rows]
            yield batch.filter(pa.array(keep))

    return texts.select("node", "zip").mapInArrow(run, "node long, zip binary")


def _paired(batch: pa.RecordBatch, a: str, b: str, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two sets of every row; a set that several rows of a portion name is made once."""
    left, right = batch.column("zip_a"), batch.column("zip_b")
    x, y = np.asarray(batch.column(a)), np.asarray(batch.column(b))
    for rows in _portions(left, right):
        zips = list(left[rows]) + list(right[rows])
        _, first, at = np.unique(np.concatenate([x[rows], y[rows]]), return_index=True, return_inverse=True)
        hashes, offsets = _sets_of([zips[k] for k in first], size)
        half = len(at) // 2
        for i, j in zip(at[:half], at[half:], strict=True):
            yield hashes[offsets[i] : offsets[i + 1]], hashes[offsets[j] : offsets[j + 1]]


def _similar(size: int):
    """Of batches of pairs (a, b) those whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(_paired(batch, "a", "b", size)):
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < SIMILARITY * len(large):
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep[k] = 100 * both >= SIMILARITY * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that share at least MATCHES coordinates and have comparable sizes."""
    of = lambda s: classes.select(
        F.col("node").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("n_shingles").alias(f"n_{s}")
    )
    same = F.aggregate(
        F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x
    )
    sizes = 100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")
    return pairs.join(of("a"), "a").join(of("b"), "b").where(sizes & (same >= MATCHES)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    of = lambda s: sets.select(F.col("node").alias(s), F.col("zip").alias(f"zip_{s}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b")
    return joined.select("a", "b", "zip_a", "zip_b").mapInArrow(_similar(size), "a long, b long")


def _postings(classes: DataFrame) -> DataFrame:
    """(token, node): the prefix of every class that can share MATCHES coordinates with another."""
    tokens = classes.select("node", F.posexplode("sig").alias("k", "v")).select(
        "node", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v")).alias("token")
    )
    tokens = tokens.repartition("token")  # once: the count reads the same columns as the join with it
    shared = tokens.groupBy("token").agg(F.count("node").alias("n")).where("n > 1")
    lists = tokens.join(shared, "token").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("n", "token"))).alias("tokens")  # COORDINATES at most
    )
    # The tokens that no other class has are the rarest and take the first places of the prefix.
    alone = F.lit(COORDINATES) - F.size("tokens")
    prefix = F.lit(COORDINATES - MATCHES + 1) - alone
    weight = F.aggregate("tokens", F.lit(0).cast("long"), lambda w, t: w + t["n"])
    return (
        lists.where(F.size("tokens") >= MATCHES)
        .select(
            "node", weight.alias("weight"), F.explode(F.slice("tokens", 1, F.greatest(prefix, F.lit(0)))).alias("t")
        )
        .select(F.col("t.token").alias("token"), "node", "weight")
    )


def _meetings(members: DataFrame, centres: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b): each member and the ``most`` centres with which it shares most of its lists."""
    met = (
        members.join(centres.select("token", F.col("c.node").alias("b")), "token")
        .where(F.col("node") != F.col("b"))
        .groupBy(F.col("node").alias("a"), "b")
        .agg(F.count("*").alias("n"))
    )
    # A member has as many lists as its prefix is long, so this array is bounded.
    best = met.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("n", "b")), asc=False).alias("m"))
    return best.select("a", F.explode(F.slice("m", 1, most)).alias("m")).select("a", F.col("m.b").alias("b"))


def _mixed(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, node, weight, label, main) of the lists with several components.

    ``main`` is the component that most members of the list belong to.
    """
    placed = postings.join(labels, "node", "left").select(
        "token", "node", "weight", F.coalesce("label", "node").alias("label")
    )
    shares = placed.groupBy("token", "label").agg(F.count("*").alias("n"))
    lists = (
        shares.groupBy("token")
        .agg(F.max(F.struct("n", "label")).alias("m"), F.count("*").alias("labels"))
        .where("labels > 1")
        .select("token", F.col("m.label").alias("main"))
    )
    return materialize(placed.join(lists, "token"))


def _compared(size: int):
    """Each member with the pivot of its list's main component: sizes, and what they do not share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, differ, near, linked = [], [], [], []
            for x, c in _paired(batch, "node", "b", size):
                other = np.setxor1d(x, c, assume_unique=True)
                sizes.append((len(x), len(c), len(other)))
                # Two sets are similar if what they do not share is small: 100 both >= 80 united.
                both = (len(x) + len(c) - len(other)) // 2
                united = len(x) + len(c) - both
                linked.append(100 * both >= SIMILARITY * united)
                near.append(2 * both >= united)
                differ.append(other.view(np.int64) if near[-1] else np.zeros(0, np.int64))
            columns = np.array(sizes, np.int64).reshape(-1, 3)
            at = np.concatenate([[0], np.cumsum([len(d) for d in differ])]).astype(np.int32)
            flat = np.concatenate(differ) if differ else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("main", "node", "label", "b")]
                + [pa.array(columns[:, k]) for k in range(3)]
                + [pa.array(near, pa.bool_()), pa.array(linked, pa.bool_()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                names=["main", "node", "label", "pivot", "n", "n_pivot", "d", "near", "linked", "differ"],
            )

    return run


COMPARED = """main long, node long, label long, pivot long, n long, n_pivot long, d long, near boolean, linked boolean,
    differ array<long>"""


def _against_pivots(mixed: DataFrame, sets: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of lists with few and with many members outside a component, the latter's pivots compared."""
    outside = mixed.where("label != main").groupBy("main").agg(F.count_distinct("node").alias("n"))
    mixed = mixed.join(outside.select("main", (F.col("n") > FEW).alias("many")), "main")
    simple = mixed.where("not many")
    mixed = mixed.where("many").drop("many")
    pivots = mixed.where("label = main").groupBy("main").agg(F.max(F.struct("weight", "node")).alias("p"))
    members = mixed.select("main", "node", "label").distinct()
    asked = members.join(pivots.select("main", F.col("p.node").alias("b")), "main")
    of = lambda s, c: sets.select(F.col("node").alias(c), F.col("zip").alias(f"zip_{s}"))
    asked = asked.join(of("a", "node"), "node").join(of("b", "b"), "b")
    seen = asked.select("main", "node", "label", "b", "zip_a", "zip_b").mapInArrow(_compared(size), COMPARED)
    return simple, mixed, materialize(seen)


def _with_lists(postings: DataFrame, *columns: str) -> DataFrame:
    """One row per member of a component's lists: main, node, ``columns`` and the tokens of its lists."""
    # A member has as many lists as its prefix is long, so this array is bounded.
    return postings.groupBy("main", "node", *columns).agg(F.collect_list("token").alias("tokens"))


def _differences(seen: DataFrame) -> DataFrame:
    """(main, node, ranked, alone, length_x, length_y): what is posted for members unlike the pivot, and for all.

    Let D be what a member does not share with the pivot c, and x a member that is not similar to c.
    As x and y do not share |Dx| + |Dy| - 2 |Dx & Dy| shingles, they are similar only if
    18 |Dx & Dy| >= 9 |Dx| - |x| + 9 |Dy| - |y|, where 9 |Dx| - |x| > |c| and 9 |Dy| - |y| >= -|c|.
    So they share a good part of D, and hence one of its rarest members: D, which holds what few
    have, is posted by prefix in place of what the whole group has.
    """
    differing = seen.where("near").select("main", "node", F.explode("differ").alias("shingle"))
    common = differing.groupBy("main", "shingle").agg(F.count("*").alias("k")).where("k > 1")
    ranked = (
        differing.join(common, ["main", "shingle"])
        .groupBy("main", "node")
        .agg(F.sort_array(F.collect_list(F.struct("k", "shingle"))).alias("ranked"))  # of one document
        .join(seen.drop("differ"), ["main", "node"])
    )
    # What no other member has is the rarest and takes the first places of either prefix.
    alone = F.col("d") - F.size("ranked")
    least_y = F.greatest(F.lit(1), F.floor((F.col("n_pivot") + 9 * F.col("d") - F.col("n")) / 18) + 1)
    least_x = F.greatest(F.lit(1), F.ceil((9 * F.col("d") - F.col("n") - F.col("n_pivot")) / 18))
    length = lambda least: F.greatest(F.lit(0), F.col("d") - least + 1 - alone).cast("int")
    length_x, length_y = F.when(F.col("linked"), 0).otherwise(length(least_x)), length(least_y)
    return ranked.select(
        "main", "node", F.slice("ranked.shingle", F.lit(1), F.greatest(length_x, length_y)).alias("ranked"),
        alone.alias("alone"), length_x.alias("length_x"), length_y.alias("length_y"),
    )


def _posted(members: DataFrame, length: str) -> DataFrame:
    """(main, shingle, node, label, n, d, left) of the prefix that a member posts."""
    behind = F.col("d") - F.col("alone") - F.col("place") - 1  # members of D after this one
    prefix = F.posexplode(F.slice("ranked", F.lit(1), F.col(length))).alias("place", "shingle")
    rows = members.select("main", "node", "label", "n", "d", "alone", prefix)
    return rows.select("main", "shingle", "node", "label", "n", "d", behind.alias("left"))


def _two_of(rows: DataFrame, by: list[str], salt: int) -> DataFrame:
    """Of every list the members with the smallest and the largest hash; ``salt`` changes which."""
    member = F.struct(F.xxhash64("node", F.lit(salt)).alias("__h"), *[c for c in rows.columns if c not in by])
    ends = rows.groupBy(*by).agg(F.min(member).alias("lo"), F.max(member).alias("hi"))
    return ends.select(*by, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("m")).select(*by, "m.*").drop("__h")


def _relabelled(rows: DataFrame, wider: DataFrame) -> DataFrame:
    """``rows`` with the component that their label belongs to now; given one row per member, not per posting."""
    rows = rows.join(wider, "label", "left")
    return rows.withColumn("label", F.coalesce("wider", "label")).drop("wider")


def _marks(sig) -> Column:
    """MARKED words of a signature: word b holds bit b of every coordinate's value."""
    bit = lambda b: lambda v, k: F.call_function("shiftleft", F.shiftright(v, b).bitwiseAND(F.lit(1)).cast("long"), k)
    word = lambda b: F.aggregate(F.transform(sig, bit(b)), F.lit(0).cast("long"), lambda w, x: w.bitwiseOR(x))
    return F.array(*[word(b) for b in range(MARKED)])


def _may_agree(x: str, y: str) -> Column:
    """Whether the marks of two members leave MATCHES equal coordinates possible, and their sizes are comparable."""
    unequal = F.lit(0).cast("long")
    for b in range(MARKED):
        unequal = unequal.bitwiseOR(F.get(f"{x}.marks", F.lit(b)).bitwiseXOR(F.get(f"{y}.marks", F.lit(b))))
    sizes = 100 * F.least(f"{x}.n", f"{y}.n") >= SIMILARITY * F.greatest(f"{x}.n", f"{y}.n")
    return sizes & (F.bit_count(unequal) <= COORDINATES - MATCHES)


def _apart(members: DataFrame, few: DataFrame, salt: int | None) -> DataFrame:
    """Pairs (a, b) of a list whose components are not linked so far.

    With a ``salt`` members meet two of their list; without, all that are still apart: by the
    differences from the pivot, and those far from it (less than half in common) by their lists, as
    do members outside a component with no more than FEW of them. Who is far meets only those that are
    not near the pivot by more than it can be: the share that two sets do not have in common is a
    distance, and similar sets are within LARGEST of each other. Of those that meet in a list only pairs
    whose marks leave them enough equal coordinates are made.
    """
    listed = lambda rows: rows.select(F.explode("tokens").alias("token"), "node", "label", "n", "marks")

    def meeting(one: DataFrame, other: DataFrame) -> DataFrame:
        side = lambda rows, s: rows.select("token", F.struct("node", "label", "n", "marks").alias(s))
        met = side(one, "x").join(side(other, "y"), "token")
        met = met.where((F.col("x.label") != F.col("y.label")) & _may_agree("x", "y"))
        return met.select(F.col("x.node").alias("x"), F.col("y.node").alias("y"))

    x, y = _posted(members.where("near"), "length_x"), _posted(members.where("near"), "length_y")
    far = listed(members.where("not near"))
    if salt is None:
        met = meeting(far, listed(members.where(F.col("away") >= 0.5 - LARGEST)))
        met = met.unionByName(meeting(listed(few.where("outside")), listed(few)))
    else:
        y = _two_of(y, ["main", "shingle"], salt)
        met = meeting(far, _two_of(far, ["token"], salt))
    of = lambda rows, s: rows.select("main", "shingle", F.struct("node", "label", "n", "d", "left").alias(s))
    # At the first shingle that both post, what is left behind it bounds what they can share.
    needed = 9 * (F.col("x.d") + F.col("y.d")) - F.col("x.n") - F.col("y.n")
    enough = 18 * (1 + F.least("x.left", "y.left")) >= needed
    sharing = of(x, "x").join(of(y, "y"), ["main", "shingle"]).where((F.col("x.label") != F.col("y.label")) & enough)
    pairs = sharing.select(F.col("x.node").alias("x"), F.col("y.node").alias("y")).unionByName(met)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The components (a, b) that links connect: of the links between two of them one is enough."""
    for end in ("a", "b"):
        of = labels.select(F.col("node").alias(end), F.col("label").alias("__l"))
        links = links.join(of, end, "left").withColumn(end, F.coalesce("__l", end)).drop("__l")
    return links.where("a != b").distinct()


def _joined(
    postings: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, size: int
) -> DataFrame:
    """(label, wider): components that links between members of one list connect.

    Members are compared with pivots first, then with two members of their list in each of ROUNDS
    rounds, each of which leaves out what the ones before have linked. Then those that are still
    apart are all compared, so that no link is lost, but a group of similar members, which the
    rounds have linked, is not expanded into its pairs.
    """
    simple, mixed, seen = _against_pivots(_mixed(postings, labels), sets, size)
    # The share of a member and its pivot together that only one of them has; n + n_pivot + d is their union twice.
    away = 2 * F.col("d") / (F.col("n") + F.col("n_pivot") + F.col("d"))
    members = (
        _with_lists(mixed)
        .join(seen.select("main", "node", "label", "n", "d", "near", away.alias("away")), ["main", "node"])
        .join(_differences(seen), ["main", "node"], "left")
    )
    marks = classes.select("node", _marks(F.col("sig")).alias("marks"))
    few = _with_lists(simple, "label").withColumn("outside", F.col("label") != F.col("main"))
    few = few.join(classes.select("node", F.col("n_shingles").alias("n"), _marks(F.col("sig")).alias("marks")), "node")
    members, few = materialize(members.join(marks, "node")), materialize(few)
    linked = seen.where("linked and label != main").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    edges = materialize(_between(linked, labels))
    for salt in (*range(ROUNDS), None):
        wider = components(edges, "a", "b").select(F.col("node").alias("label"), F.col("label").alias("wider"))
        now = materialize(_relabelled(members, wider))
        pairs = _apart(now, _relabelled(few, wider) if salt is None else few, salt)
        found = _confirmed(_agreeing(pairs, classes), sets, size)
        edges = materialize(edges.unionByName(_between(found, labels)).distinct())
    return components(edges, "a", "b").select(F.col("node").alias("label"), F.col("label").alias("wider"))


def near_duplicates(documents: DataFrame, key: str, text: str, size: int = 2) -> DataFrame:
    """Per row: ``key``, n_shingles, component_id and kept.

    Texts with equal sets are linked, and texts with 100 * shared >= 80 * united shingles.
    component_id is the smallest key that links lead to, itself included; kept says that it is the
    row's own. Null and empty texts have no shingles and are linked with nothing. Repeated rows are
    linked like other copies. Rows without a key take no part: component_id null, kept true.
    ``key`` must be a long; other columns are ignored.
    """
    documents = documents.select(F.col(key).cast("long").alias(key), F.col(text).alias("__text"))
    signed = materialize(_signed(documents, key, "__text", size))
    full = signed.where((F.col("n_shingles") > 0) & F.col(key).isNotNull())
    # Signatures and sets are joined by node several times: bucketed, they are shuffled once.
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = bucketed(
        full.groupBy("node", "proof").agg(
            F.min(key).alias("first"), F.max("sig").alias("sig"), F.max("n_shingles").alias("n_shingles")
        ),
        "node",
        parts,
    )
    posted = materialize(_postings(classes))
    several = posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    postings = materialize(posted.join(several, "token"))

    # The full sets of all classes that have postings, from one scan of the texts. Where rows of one
    # key differ, those with the class's own set count.
    asked = postings.select("node").distinct().join(classes.select("node", F.col("first").alias(key)), "node")
    texts = _zipped(documents.where(F.col(key).isNotNull()), key, "__text").join(asked, key).dropDuplicates([key, "node", "zip"])
    sets = bucketed(_own_sets(texts, size), "node", parts)

    # First every member meets the heaviest members of its lists: those whose values most others have.
    centres = postings.groupBy("token").agg(F.max(F.struct("weight", "node")).alias("c"))
    links = materialize(_confirmed(_agreeing(_meetings(postings, centres, 2), classes), sets, size))
    labels = components(links, "a", "b")
    # Then members of different components of one list, so that no link is missed.
    wider = _joined(postings, labels, classes, sets, size)
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialize(
        named.join(wider, "label", "left").select("node", "proof", "first", F.coalesce("wider", "label").alias("label"))
    )
    groups = named.groupBy("label").agg(F.min("first").alias("component_id"))
    component = materialize(named.join(groups, "label").select("node", "proof", "component_id"))
    out = signed.drop("sig").join(component, ["node", "proof"], "left")
    group = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(key))
    group = F.when(F.col(key).isNotNull(), group)
    return out.select(
        key,
        "n_shingles",
        group.alias("component_id"),
        F.coalesce(F.col(key) == group, F.lit(True)).alias("kept"),
    )
