"""Exact Jaccard join of word-shingle sets: size-aware, heavy-light.

All sets keep their shingles in one global order, frequent ones last, as counted
over all documents in a sketch of fixed size: any order will do, so errors of
the sketch cost time, never a link. A set of n shingles that matches with
similarity t shares ceil(t n) of them, so two matching sets share k shingles
within their first n - ceil(t n) + k ones.

* Small sets (n <= boundary) enumerate the 2-subsets of that prefix and meet in
  the bucket of an equal subset.
* Large sets enter the inverted lists of their prefix shingles; a set with
  fewer than k shared prefix shingles can't match anything and leaves at once.
  Small sets that may match large ones enter both.

The boundary is where enumerating subsets starts to cost more than scanning
lists of the measured mean length. Equal sets are joined by digest first.
Within a bucket, members are tested against a centre; only buckets that still
hold several components are taken further, at last by all pairs across
components, so every link between different components is found without
emitting all pairs of a group.

A pair is dropped before its texts are read when their parity bitmaps differ in
more bits than matching sets can: each shingle flips one bit, so the bits that
differ are at most the shingles that do, (n + m) / 9 in a match. No link is lost.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize, release_memory, unused_name

WORDS, SIMILARITY = 5, 0.8
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: At most this many ids are broadcast after a count; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
STAR_ROUNDS = 3
#: Counters of the frequency sketch; a shingle counts in the slot that its hash's first bits name.
SLOTS = 1 << 20
SLOT_SHIFT = np.uint64(64 - 20)
#: Least hashes kept to estimate how many shingles are distinct.
LEAST = 4096
#: Pairs of one set that a group of the verification holds, about.
CHUNK = 256
#: Buckets before its own that an entry of the last round carries.
EARLIER = 4
#: Bits of a set's parity bitmap, 64 to a column.
BITS = 512
SIGNS = [f"s{i}" for i in range(BITS // 64)]
#: Vertices that a task holds at a time when it contracts edges.
FOREST = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's 5-word shingles, A-Z lowered.

    With fewer words the whole sequence is the one shingle; without words the
    set is empty.
    """
    import xxhash

    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    m = n - WORDS + 1
    total = np.zeros(m, np.uint64)
    for k in range(WORDS):
        total += w[k : k + m] * _MULTIPLIERS[k]
    return np.unique(_mix(total))


def parity_bitmap(s: np.ndarray) -> np.ndarray:
    """BITS bits as signed 64-bit words: whether an odd number of shingles falls on each."""
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def needed(n: int) -> int:
    """Shingles a set of n shares with any match: ceil(0.8 n)."""
    return -(-4 * n // 5)


def matches(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= 80 * (len(a) + len(b) - both)


def shared_count(n: int) -> int:
    """k of the prefix bound for large sets; grows with n, so a pair has the less of its two."""
    return max(1, n // 25)


def least_shared(n: int) -> int:
    """Shared prefix shingles below which a set of n has no match of any size."""
    return shared_count(needed(n))


def boundary(mean_list: float) -> int:
    """Largest n at which 2-subsets are fewer than the list entries to scan."""
    n = 2
    while n < 200:
        p = n + 1 - needed(n + 1) + 2
        if p * (p - 1) / 2 > (p - 1) * (1 + mean_list):
            break
        n += 1
    return n


SKETCH = "counts binary, total bigint, least binary"


def _packed(counts: np.ndarray, total: int, least: np.ndarray) -> pa.RecordBatch:
    body = zlib.compress(counts.astype("<i8").tobytes(), 1)
    return pa.RecordBatch.from_arrays(
        [pa.array([body], pa.binary()), pa.array([total], pa.int64()), pa.array([least.tobytes()], pa.binary())], ["counts", "total", "least"]
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of sketches, one held at a time."""
    counts, total, least = np.zeros(SLOTS, np.int64), 0, np.zeros(0, np.uint64)
    for batch in batches:
        for body, n, low in zip(*(c.to_pylist() for c in batch.columns)):
            counts += np.frombuffer(zlib.decompress(body), "<i8")
            total += n
            least = np.unique(np.concatenate([least, np.frombuffer(low, np.uint64)]))[:LEAST]
    yield _packed(counts, total, least)


def _statistics(docs: DataFrame) -> tuple[np.ndarray, float]:
    """Documents counted in each slot of shingle hashes, and the mean length of an inverted list.

    All documents count. Every task sums into SLOTS counters, tasks' counters
    are summed in two more steps, and the driver gets one row of fixed size. The
    number of distinct shingles is estimated from the LEAST least hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        counts, total, least = np.zeros(SLOTS, np.int64), 0, np.zeros(0, np.uint64)
        held: list[np.ndarray] = []

        def flush() -> None:
            nonlocal counts, total, least
            h = np.concatenate([*held, np.zeros(0, np.uint64)])
            held.clear()
            counts += np.bincount((h >> SLOT_SHIFT).astype(np.int64), minlength=SLOTS)
            total += len(h)
            if len(least) == LEAST:
                h = h[h < least[-1]]
            least = np.unique(np.concatenate([least, h]))[:LEAST]

        size = 0
        for batch in batches:
            for t in batch.column(0):
                held.append(shingle_set(t.as_py()))
                size += len(held[-1])
                if size >= 1 << 20:
                    flush()
                    size = 0
        flush()
        yield _packed(counts, total, least)

    sketches = docs.select("text").mapInArrow(run, SKETCH).repartition(32).mapInArrow(_merged, SKETCH)
    found = sketches.repartition(1).mapInArrow(_merged, SKETCH).first()
    if found is None:
        return np.zeros(SLOTS, np.int64), 0.0
    least = np.frombuffer(bytes(found["least"]), np.uint64)
    distinct = len(least) if len(least) < LEAST else (LEAST - 1) / (float(least[-1]) / 2.0**64)
    return np.frombuffer(zlib.decompress(bytes(found["counts"])), "<i8"), found["total"] / max(1.0, distinct)


def common_from(counts: np.ndarray) -> int:
    """The count from which a slot holds a frequent shingle: well above what chance puts into a slot."""
    usual = float(np.median(counts))
    return int(usual + max(64.0, 8 * math.sqrt(usual)))


SETS = "doc_id bigint, text_hash bigint, n_shingles int, d1 bigint, d2 bigint, keys array<bigint>, common array<bigint>, head array<bigint>, " + ", ".join(f"{s} bigint" for s in SIGNS)


#: All 2-subsets of the ascending head, as bucket numbers (odd; those of single shingles are even).
SUBSETS = "flatten(transform(head, (x, i) -> transform(slice(head, 1, i), y -> xxhash64(y, x) | 1L)))"


def _sets(docs: DataFrame, counts: np.ndarray, edge: int) -> DataFrame:
    """A row for each document: set size, digests, signatures and parity bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # SLOTS numbers
    frequent = common_from(counts)

    def signatures(s: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(s)
        met = counts[(s >> SLOT_SHIFT).astype(np.int64)]
        order, rare = s[np.argsort(met, kind="stable")], int((met < frequent).sum())
        keys = common = head = np.zeros(0, np.uint64)
        if n > edge or n >= needed(edge + 1):
            width = min(n, n - needed(n) + shared_count(n))
            keys, common = order[: min(width, rare)], order[rare:width]
        if n <= edge:
            head = np.sort(order[: min(n, n - needed(n) + 2)].view(np.int64)).view(np.uint64)
        return keys, common, head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        release_memory()
        counts = shared.value
        lists = lambda xs: pa.ListArray.from_arrays(np.cumsum([0, *map(len, xs)]).astype(np.int32), pa.array(np.concatenate([*xs, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)))
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sizes, first, second, found, parity = [], [], [], [], []
                for t in part.column(2):
                    s = shingle_set(t.as_py())
                    raw = s.tobytes()
                    sizes.append(len(s))
                    first.append(xxhash.xxh3_64_intdigest(raw))
                    second.append(xxhash.xxh3_64_intdigest(raw, seed=1))
                    found.append(signatures(s, counts))
                    parity.append(parity_bitmap(s))
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                keys, common, heads = ([np.asarray(f[k], np.uint64) for f in found] for k in range(3))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int32()), signed(first), signed(second), lists(keys), lists(common), lists(heads), *map(pa.array, np.array(parity).T.copy())],
                    [x.split()[0] for x in SETS.split(", ")],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SETS)


def _small(rows: int, df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, if its counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets match, from the whole texts.

    Pairs meet at their ``a``, at most some CHUNK of them a group: a group gets
    the text of ``a`` once and then one text for each ``b``, sorted so that a
    task holds one set at a time.
    """
    centres = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    n_pairs = pairs.count()
    grouped = pairs.join(_small(n_pairs, centres), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / CHUNK)).alias("chunk"))
    wanted = grouped.select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("id")).distinct()
    wanted = wanted.unionByName(grouped.select("a", "chunk", F.lit(1).alias("role"), F.col("b").alias("id")))
    rows = texts.join(_small(2 * n_pairs, wanted), "id").select("a", "chunk", "role", "id", "text")
    rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            a, role, b = (batch.column(i).to_pylist() for i in (0, 2, 3))
            keep = []
            for i, t in enumerate(batch.column(4)):
                s = shingle_set(t.as_py())
                if role[i]:
                    keep.append(matches(centre, s))
                else:
                    centre = s
                    keep.append(False)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a bigint, b bigint")


def _contract(edges: DataFrame) -> DataFrame:
    """The edges (u, v) of each partition as a star forest: every vertex with the least one it reaches there.

    Keeps connectivity; a forest is emitted and forgotten whenever it holds
    FOREST vertices, so memory stays bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        def forest() -> pa.RecordBatch:
            found = [(x, r) for x in list(parent) if (r := find(x)) != x]
            parent.clear()
            u, v = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(u), find(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) >= FOREST:
                yield forest()
        yield forest()

    return edges.select("u", "v").mapInArrow(run, "u bigint, v bigint")


def _is_star_forest(edges: DataFrame) -> bool:
    """No vertex has two edges upwards, or one upwards and one downwards."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, by alternating large and small stars.

    ``links`` has columns a, b. Edges are contracted within partitions first;
    then each turn is two aggregations and two joins on edges, which only
    shrink; nothing is gathered for a vertex. Turns go on until every component
    is a star, which takes about the logarithm of the longest path.
    """
    edges = materialize(_contract(links.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u != v")), "edges")
    while not _is_star_forest(edges):
        n = 2 * edges.count()
        both = edges.union(edges.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(_small(n, low), "u").selectExpr("v as u", "m as v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_small(n, low), "u").selectExpr("v as u", "m as v").union(low.selectExpr("u", "m as v"))
        before, edges = edges, materialize(_contract(small.where("u != v").distinct()), "edges")
        drop_table(before)
    own = edges.groupBy("u").agg(F.min("v").alias("component"))
    return own.withColumnRenamed("u", "id").union(edges.selectExpr("v as id", "v as component").distinct())


def _size_fits(n: str, m: str) -> str:
    return f"5 * least({n}, {m}) >= 4 * greatest({n}, {m})"


def _distinct_lists(entries: DataFrame) -> DataFrame:
    """h, w: one bucket of each distinct membership with two ids or more, and how many have it.

    Two sets that match meet in many buckets with the same members; one of them
    finds the pair, and w keeps the count of shared shingles right. Members are
    compared by number, least, greatest and 128 bits of a digest.
    """
    digest = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in range(2)]
    lists = entries.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("f"), F.max("id").alias("l"), F.max("w").alias("w"), *digest)
    lists = lists.where("f != l").groupBy(F.expr("h & 1L").alias("odd"), "m", "f", "l", "x0", "x1").agg(F.min("h").alias("h"), F.sum("w").alias("w"))
    return lists.select("h", "w")


def _signed(rows: DataFrame, signs: DataFrame, key: str) -> DataFrame:
    """``rows`` with the parity bitmap of the set that column ``key`` names, as columns <key>_s0 and so on."""
    return rows.join(signs.select(F.col("id").alias(key), *[F.col(s).alias(f"{key}_{s}") for s in SIGNS]), key)


def _signs_fit(a: str, b: str, n: str, m: str) -> str:
    """Matching sets of n and m shingles differ in (n + m) / 9 of them at most, so their bitmaps do."""
    return f"9 * ({' + '.join(f'bit_count({a}_{s} ^ {b}_{s})' for s in SIGNS)}) <= {n} + {m}"


def _earlier(entries: DataFrame) -> DataFrame:
    """``entries`` with the EARLIER buckets of the same kind before theirs in which their id is, null where there are fewer."""
    order = Window.partitionBy("id", F.expr("h & 1L")).orderBy("h")
    return entries.select("*", *[F.lag("h", i + 1).over(order).alias(f"p{i}") for i in range(EARLIER)])


def _across(entries: DataFrame, signs: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket of a 2-subset, or enough buckets of single shingles.

    A bucket leaves out the pairs that also meet in one of the few buckets just
    before it: the first bucket that a pair shares has none before, so every
    pair comes out, though not once for each bucket it shares.
    """
    earlier = [f"p{i}" for i in range(EARLIER)]
    side = lambda x: _signed(entries.select("h", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}"), *[F.col(p).alias(f"{x}_{p}") for p in earlier]), signs, x)
    seen = " or ".join(f"coalesce(a_{p} in ({', '.join(f'b_{q}' for q in earlier)}), false)" for p in earlier)
    pairs = side("a").join(side("b"), "h")
    pairs = pairs.where(f"a < b and ca != cb and {_size_fits('na', 'nb')} and {_signs_fit('a', 'b', 'na', 'nb')} and not ({seen})")
    pairs = materialize(pairs.groupBy("a", "b").agg(F.max(F.expr("h & 1L")).alias("odd"), F.first("na").alias("na"), F.first("nb").alias("nb")), "candidates")
    met = pairs.selectExpr("a as id").union(pairs.selectExpr("b as id")).distinct()
    # a bucket counts as often as it stands for others: that many elements
    each = F.expr("transform(sequence(0L, w - 1), j -> xxhash64(h, j))")
    lists = entries.where("h & 1L = 0").join(met, "id", "left_semi").groupBy("id").agg(F.flatten(F.collect_list(each)).alias("x"))
    both = pairs.join(lists.selectExpr("id as a", "x as xa"), "a", "left").join(lists.selectExpr("id as b", "x as xb"), "b", "left")
    return both.where("odd = 1 or coalesce(size(array_intersect(xa, xb)), 0) >= greatest(1, least(na, nb) div 25)").select("a", "b")


def find_links(shared: DataFrame, texts: DataFrame, signs: DataFrame) -> DataFrame | None:
    """Links (a, b) that join all components of the match graph; None if there are none.

    ``shared`` has h, id, n, w: the bucket entries of sets that share enough,
    and the number of buckets that each stands for; ``signs`` has their parity
    bitmaps by id.
    """
    tested: DataFrame | None = None
    links: DataFrame | None = None
    state = shared.withColumn("component", F.col("id"))
    for turn in range(STAR_ROUNDS + 1):
        spread = state.groupBy("h").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m"),
            F.min_by(F.struct("id", "n", "component"), F.xxhash64("id", F.lit(turn))).alias("centre"),
        ).where("low != high")
        spread = materialize(spread, "spread")
        m = spread.agg(F.count(F.lit(1)), F.sum("m"), F.sum(F.col("m").cast("double") * F.col("m"))).first()
        if not m[0]:
            break
        open_ = state.join(spread, "h")
        last = turn == STAR_ROUNDS or m[2] <= 4 * m[1]
        if last:
            pairs = _across(_earlier(open_.select("h", "w", "id", "n", "component")), signs)
        else:
            pairs = open_.where(f"component != centre.component and {_size_fits('n', 'centre.n')}")
            # the centre of many comes first, so its text is sent once
            pairs = pairs.selectExpr("centre.id as a", "id as b", "n + centre.n as total").distinct()
            pairs = _signed(_signed(pairs, signs, "a"), signs, "b").where(_signs_fit("a", "b", "total", "0")).select("a", "b")
        if tested is not None:
            seen = tested.unionByName(tested.selectExpr("b as a", "a as b"))
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        found = materialize(_verify(pairs, texts), "links")
        drop_table(spread)
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if last:
            break
        state = shared.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    return links


def _members(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id for every row of (doc_id, text)."""
    counts, mean_list = _statistics(docs)
    sets = materialize(_sets(docs, counts, boundary(mean_list)).withColumn("row", F.monotonically_increasing_id()), "sets")

    # equal sets are one class, named by the least of its rows
    digest = ["n_shingles", "d1", "d2"]
    classes = sets.where("n_shingles > 0").groupBy(*digest).agg(F.min("row").alias("id"), F.min("doc_id").alias("least"))
    members = sets.select("row", "doc_id", "text_hash", *digest).join(classes, digest, "left")
    members = materialize(members.select("row", "doc_id", "text_hash", "n_shingles", "id", "least"), "members")
    copies = members.where("id is null or row != id").select("row")
    one = sets.join(_small(copies.count(), copies), "row", "left_anti").withColumnsRenamed({"row": "id", "n_shingles": "n"})

    rare = one.selectExpr("id", f"explode(concat(transform(keys, x -> x & -2L), {SUBSETS})) as h").repartition("h")
    rare = rare.join(_distinct_lists(rare.withColumn("w", F.lit(1))), "h").select("h", "id", "w")
    common = one.selectExpr("explode(transform(common, x -> x & -2L)) as h", "id", "1L as w")
    shared = materialize(rare.unionByName(common), "shared")
    enough = shared.groupBy("id").agg(F.sum(F.when(F.expr("h & 1L = 0"), F.col("w")).otherwise(0)).alias("c"), F.max(F.expr("h & 1L")).alias("odd"))
    enough = enough.join(one.select("id", "n"), "id").where("odd = 1 or c >= greatest(1, ((4 * n + 4) div 5) div 25)").select("id", "n")
    enough = materialize(enough, "enough")
    n_ids, links = enough.count(), None
    few = _small(n_ids, enough)
    if n_ids:
        signs = materialize(one.select("id", *SIGNS).join(few, "id", "left_semi"), "signs")
        wanted = members.where("row = id").join(few, "id", "left_semi").select("id", F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
        own = docs.withColumn("t", F.xxhash64("text")).select("doc_id", "t", "text")
        texts = own.join(_small(n_ids, wanted), "t").where("doc_id <=> d").select("id", "text")
        texts = materialize(texts, "texts")
        if texts.count() > n_ids:  # repeated rows
            texts = materialize(texts.dropDuplicates(["id"]), "texts")
        entries = shared.join(few, "id")
        entries = materialize(entries.drop("w").join(_distinct_lists(entries), "h").select("h", "id", "n", "w"), "entries")
        drop_table(sets, shared)
        links = find_links(entries, texts, signs)
        drop_table(entries, signs, texts)
    else:
        drop_table(sets, shared)
    out = members.withColumn("label", F.lit(None).cast("bigint"))
    if links is not None:
        found = materialize(components(links), "components")
        named = found.join(members.where("row = id").select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("label"))
        out = members.join(found.join(named, "component").select("id", "label"), "id", "left")
    label = F.coalesce("label", "least", "doc_id").alias("component_id")
    return out.select("doc_id", "text_hash", F.col("n_shingles").cast("long").alias("n_shingles"), label)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles (long) and component_id (long) for every row of (doc_id, text).

    Two documents link when their 5-word shingle sets have similarity 0.8 or
    more; component_id is the least doc_id reachable by links, the own one
    included. Null, empty and wordless texts have 0 shingles and link with
    nothing. A row with a null doc_id gets the least id of its component, null
    if there is none. Rows are told apart by themselves, so equal doc_ids may
    have different texts and components. Repeated rows and equal texts share a
    component. Other columns are not read; an empty table gives no rows.
    """
    found = _members(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one whose id names it.

    Rows without shingles, and rows whose doc_id is null, stay; of repeated rows
    (equal in doc_id and text) one stays.
    """
    found = materialize(_members(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")), "found")
    d, t = unused_name(docs, "d_"), unused_name(docs, "t_")
    key = found.where("doc_id is not null and n_shingles > 0").select(F.col("doc_id").alias(d), F.col("text_hash").alias(t), "component_id")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumns({d: F.col("doc_id").cast("bigint"), t: F.xxhash64("text")})
    kept = rows.join(key.where(F.col("component_id") < F.col(d)).select(d, t).distinct(), [d, t], "left_anti")
    twice = key.groupBy(d, t).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(d, t)
    if not twice.isEmpty():
        again = kept.join(twice, [d, t], "left_semi").dropDuplicates([d, t])
        kept = kept.join(twice, [d, t], "left_anti").unionByName(again)
    return kept.select(*columns)
