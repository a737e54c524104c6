"""Near-duplicate detection by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

Documents with equal shingle sets form one class, and classes are the nodes.  Each of TREES orders sorts all classes by
their signatures, read from another place on.  Classes that stand together with a common prefix of at least BASE_DEPTH
values are a region, and its classes each other's candidates; in a region of more than CROWD classes the depth adapts: it
is parted by ever longer common prefixes.  If its classes then still lie in several components, those outside the largest
meet all others block by block, so none of its pairs is lost.  Short sketches of whole signatures select the pairs worth
confirming, and parities of whole sets, which never reject a link, spare most of the others the sets.  Only as many are confirmed as it takes to know the components: first every class with the smallest
similar one, then what still lies in different components, until no region holds an untried pair across components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, shared

#: Values of a signature, sorted orders, and values of the prefix that classes must share in one of them at least.
#: A pair of similarity 0.8 fails to share such a prefix in all orders with a probability of 2e-4.
VALUES, TREES, BASE_DEPTH = 128, 16, 4
#: A label is what an order sorts by: its own values, 2 bytes each, then the sketch, 2 bits of every value.
OWN, SKETCH = 2 * VALUES // TREES, VALUES // 4
#: Bytes of common prefix, in turn, by which a region of more than CROWD classes is parted.
DEPTHS = (10, 12, 14, 16, 18, 20, 24, 32, OWN + SKETCH)
CROWD = 2048
#: Rows of a task that reads a range of the sorted orders, about.
RANGE_ROWS = 1 << 18
#: A region with more candidate pairs than so many a class proposes one a class first.
SPARSE = 4
#: A pair is confirmed if the share of equal values is no more than so many standard deviations under the threshold.
DEVIATIONS = 4
#: Bits of a set's parity; they tell sets apart up to some 2,500 shingles, beyond that they reject less and less.
PARITY = 2048
_rng = np.random.default_rng(20240229)
_FACTOR = _rng.integers(0, 1 << 62, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 62, VALUES, dtype=np.uint64)
def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Hashes(dict):
    """Remembers the hash of every word, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; with fewer words the sequence counts as one.

    A-Z are lower-cased and words are ``[^\\x20\\x09-\\x0D]+``; without words the set is empty.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = shared.worker_cache().setdefault("shingle words", _Hashes())
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - size + 1 + k])
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of 16 bits of a set that isn't empty."""
    out = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1 << 14):
        part = s[at : at + (1 << 14)]
        step = max(1, (1 << 17) // len(part))
        for k in range(0, VALUES, step):
            f = slice(k, k + step)
            np.minimum(out[f], (part[None, :] * _FACTOR[f, None] + _SHIFT[f, None]).min(axis=1), out=out[f])
    return (_mixed(out) >> np.uint64(48)).astype("<u2")


def sketch(signature: np.ndarray) -> bytes:
    """The two lowest bits of every value."""
    v = (signature & 3).astype(np.uint8).reshape(-1, 4)
    return (v[:, 0] | v[:, 1] << 2 | v[:, 2] << 4 | v[:, 3] << 6).tobytes()


def unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of values in which sketches (rows of 64-bit words) surely differ."""
    t = a ^ b
    return np.bitwise_count((t | t >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int32)


def parity(s: np.ndarray) -> bytes:
    """PARITY bits, of which every shingle of a set turns one."""
    at = (s >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=PARITY) & 1).tobytes()


def possible(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """May pairs of sets of sizes ``na`` and ``nb`` with parities ``a`` and ``b`` (rows of 64-bit words) be linked? Never false
    for a link: where parities differ, at least one shingle is in one set only."""
    out = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    for s in range(0, len(out), 1 << 15):
        part = slice(s, s + (1 << 15))
        apart = np.bitwise_count(a[part] ^ b[part]).sum(axis=1, dtype=np.int64)
        out[part] &= (100 + percent) * apart <= (100 - percent) * (na[part] + nb[part])
    return out


def _limits(percent: int) -> tuple[int, int]:
    """Unequal values in sketches up to which a pair may be linked, and is likely to be."""
    t = percent / 100
    p = t + (1 - t) / 4
    deviation = (p * (1 - p) / VALUES) ** 0.5
    return VALUES - int(VALUES * (p - DEVIATIONS * deviation)), VALUES - int(VALUES * (p - deviation))


def _described(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the set's digest), signature, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t or "", size) for t in b.column(1).to_pylist()]
            signatures = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(list(map(len, sets)), pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if x is None else x.tobytes() for x in signatures], pa.binary()),
                    pa.array([None if x is None else sketch(x) for x in signatures], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_key", "signature", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary, sketch binary")


#: What a range of an order gives: candidate pairs; and rows of regions (region a, class b) that may go on in the next
#: range, that have more candidate pairs than were given, and that are crowded.
PAIR, OPEN, PARTIAL, CROWDED = range(4)
_FOUND = "kind int, a long, b long, part int, sketch binary"


def _found(kind: int, a, b, part: int = 0, sketches: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(a)
    bits = pa.nulls(n, pa.binary()) if sketches is None else pa.array([x.tobytes() for x in sketches], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(n, part), pa.int32()), bits], ["kind", "a", "b", "part", "sketch"])


def _candidates(node: np.ndarray, sk: np.ndarray, least: int, likely: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Candidate pairs (smaller node, greater node) of a region; if they are many, each class with the smallest that is
    likely to be linked, and True."""
    by = np.argsort(node, kind="stable")
    node, sk = node[by], sk[by]
    i, j, first = [], [], np.full(len(node), -1)
    for s in range(0, len(node), 256):
        miss = unequal(sk[s : s + 256, None, :], sk[None, :, :])
        ok = (miss <= least) & (node[s : s + 256, None] > node[None, :])
        r, c = np.nonzero(ok)
        i.append(c)
        j.append(r + s)
        close = ok & (miss <= likely)
        first[s : s + 256] = np.where(close.any(1), close.argmax(1), np.where(ok.any(1), ok.argmax(1), -1))
    i, j = np.concatenate(i), np.concatenate(j)
    if len(i) <= SPARSE * len(node):
        return node[i], node[j], False
    own = np.flatnonzero(first >= 0)
    return node[first[own]], node[own], True


def _forest(least: int, likely: int, whole: bool):
    """Of one range of the sorted orders, rows (tree, label, node): candidate pairs of classes with a common prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, part = [b for b in batches if b.num_rows], TaskContext.get().partitionId()
        if not held:
            return
        tree, node = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 2))
        label = np.frombuffer(b"".join(x for b in held for x in b.column(1).to_pylist()), np.uint8).reshape(-1, OWN + SKETCH)
        sk = np.ascontiguousarray(label[:, OWN:]).view(np.uint64)
        prefix = np.ascontiguousarray(label[:, : 2 * BASE_DEPTH]).view(np.uint64)[:, 0]
        region = _mixed(prefix ^ _mixed(tree.astype(np.uint64) + np.uint64(1))).view(np.int64)
        start = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
        stop = np.append(start[1:], len(node))
        twos = start[stop - start == 2]
        fit = twos[unequal(sk[twos], sk[twos + 1]) <= least]
        yield _found(PAIR, np.minimum(node[fit], node[fit + 1]), np.maximum(node[fit], node[fit + 1]))

        def parted(low: int, high: int, k: int) -> Iterator[tuple[int, int]]:
            """A crowd by ever longer common prefixes; classes whose labels are equal throughout, by number."""
            if high - low <= CROWD:
                yield low, high
            elif k == len(DEPTHS):
                yield from ((s, min(s + CROWD, high)) for s in range(low, high, CROWD))
            else:
                own = label[low:high, : DEPTHS[k]]
                cuts = np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1 + low
                for s, e in zip([low, *cuts], [*cuts, high]):
                    yield from parted(s, e, k + 1)

        for s, e in zip(start[stop - start > 2], stop[stop - start > 2]):
            crowd = e - s > CROWD
            if crowd:
                yield _found(CROWDED, region[s:e], node[s:e], part, sk[s:e])
                hub = s + int(node[s:e].argmin())
                close = s + np.flatnonzero((unequal(sk[s:e], sk[hub]) <= likely) & (node[s:e] != node[hub]))
                yield _found(PAIR, np.full(len(close), node[hub]), node[close])
            for low, high in parted(s, e, 0) if crowd else ((s, e),):
                a, b, partial = _candidates(node[low:high], sk[low:high], least, likely)
                yield _found(PAIR, a, b)
                if partial and not crowd:
                    yield _found(PARTIAL, region[s:e], node[s:e], part, sk[s:e])
        if not whole:
            for k in {0, len(start) - 1}:
                s, e = start[k], stop[k]
                if e - s <= CROWD:
                    yield _found(OPEN, region[s:e], node[s:e], part, sk[s:e])

    return run


def _regions(columns: tuple[int, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Arrays of the columns, region by region, of rows sorted by the first; the last column is bits, as 64-bit words."""
    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        *numbers, bits = (b.column(k) for k in columns)
        arrays = [x.to_numpy() for x in numbers] + [np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(b.num_rows, -1)]
        cuts = [0, *(np.flatnonzero(arrays[0][1:] != arrays[0][:-1]) + 1), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if held and held[-1][0][0] != arrays[0][s]:
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            held.append([x[s:e] for x in arrays])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _met(least: int, likely: int):
    """Of open rows (kind, region, node, part, sketch) sorted by region: candidate pairs of regions in several ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, node, part, sk in _regions((1, 2, 3, 4), batches):
            if part.min() == part.max():
                continue
            if len(node) > CROWD:
                yield _found(CROWDED, region, node, 0, sk)
                continue
            a, b, partial = _candidates(node, sk, least, likely)
            yield _found(PAIR, a, b)
            if partial:
                yield _found(PARTIAL, region, node, 0, sk)

    return run


def _proposals(width: int, least: int, percent: int):
    """Of rows (region, node, component, n, bits: sketch and parity) sorted by region: each class with its ``width`` most
    similar ones of other components that its parity leaves possible; and for a region that has more such pairs across
    components, a PARTIAL row of its own number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, node, component, n, bits in _regions((0, 1, 2, 3, 4), batches):
            if component.min() == component.max():
                continue
            sk, sums = np.ascontiguousarray(bits[:, : SKETCH // 8]), bits[:, SKETCH // 8 :]
            out_a, out_b, more = [], [], False
            for s in range(0, len(node), 256):
                miss = unequal(sk[s : s + 256, None, :], sk[None, :, :])
                miss[(component[s : s + 256, None] == component[None, :]) | (miss > least)] = VALUES + 1
                r, c = np.nonzero(miss <= VALUES)
                for t in range(0, len(r), 1 << 15):
                    i, j = r[t : t + (1 << 15)], c[t : t + (1 << 15)]
                    no = ~possible(n[i + s], n[j], sums[i + s], sums[j], percent)
                    miss[i[no], j[no]] = VALUES + 1
                take = np.argsort(miss, axis=1, kind="stable")[:, :width]
                r, c = np.nonzero(np.take_along_axis(miss, take, 1) <= VALUES)
                more |= bool(((miss <= VALUES).sum(axis=1) > width).any())
                a, b = node[r + s], node[take[r, c]]
                out_a.append(np.minimum(a, b))
                out_b.append(np.maximum(a, b))
            pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)]), axis=1)
            yield _found(PAIR, pairs[0], pairs[1])
            if more:
                yield _found(PARTIAL, region[:1], region[:1])

    return run


def _sets(docs: DataFrame, wanted: np.ndarray, size: int) -> DataFrame:
    """node, n, parity, set (8 bytes a shingle) of the documents whose id may be wanted; texts are read again rather than all sets stored."""
    test = exact_dedup.maybe_repeated(docs.sparkSession, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t or "", size) for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(parity, sets)), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "parity", "set"])

    return docs.where(test(F.xxhash64("doc_id"))).mapInArrow(run, "node long, n long, parity binary, set binary")


def _plausible(pairs: DataFrame, sums: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and parities (node, n, parity) leave possible."""
    left = pairs.join(sums.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa")), "a")
    both = left.join(sums.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PARITY // 64)
        for b in batches:
            ok = possible(b.column(2).to_numpy(), b.column(3).to_numpy(), words(b.column(4)), words(b.column(5)), percent)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union holds on the full sets."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa")), "a")
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    both = left.join(right, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y, sa, sb in zip(*(c.to_pylist() for c in b.columns)):
                one, two = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                common = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * common >= percent * (len(one) + len(two) - common):
                    out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of an undirected graph given by edges (a, b).

    Large-star and small-star steps in turn until the edges no longer change; each is an aggregate and a join, the
    edges are a written table after each round, and nothing but their number and checksum reaches the driver.
    """
    edges = shared.written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
        # Large star: every neighbour above a node joins the smallest of the node and its neighbours.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b").where("a <> b").distinct()
        # Small star: every neighbour below a node, and the node, join the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select("low", F.explode(F.array("a", "b")).alias("b")).where("low <> b")
        edges = shared.written(small.select(F.col("low").alias("a"), "b").distinct(), "edges")
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))


def _absorbed(known: DataFrame, links: DataFrame) -> DataFrame:
    """node, component after ``links`` (a, b) have joined components of ``known``."""
    of = lambda df, end: df.join(known.select(F.col("node").alias(end), F.col("component").alias(f"{end}c")), end, "left").withColumn(f"{end}c", F.coalesce(f"{end}c", end))
    ends = shared.written(of(of(links, "a"), "b"), "ends")
    merged = components(ends.select(F.col("ac").alias("a"), F.col("bc").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("into"))
    nodes = known.unionByName(ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ac").alias("component")), F.struct(F.col("b").alias("node"), F.col("bc").alias("component")))).alias("x")).select("x.*")).distinct()
    out = shared.written(nodes.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component")), "components")
    shared.dropped(ends)
    shared.dropped(known)
    return out


def _parted(crowd: DataFrame, known: DataFrame) -> DataFrame:
    """(region, node, sketch) of the crowds that lie in several components: blocks of the classes outside a crowd's largest
    component, each with blocks of all its classes."""
    rows = crowd.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = rows.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("region").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("few")).where("few > 0")
    rows = shared.written(rows.join(largest, "region"), "crowds")
    half = CROWD // 2
    blocks = lambda n: F.ceil(F.col(n) / half).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    outside = rows.where("component <> main").select("region", "node", "sketch", own("few").alias("i"), every("n").alias("j"))
    inside = rows.select("region", "node", "sketch", every("few").alias("i"), own("n").alias("j"))
    return outside.unionByName(inside).select(F.xxhash64("region", "i", "j").alias("region"), "node", "sketch").distinct()


def forest(classes: DataFrame, percent: int) -> DataFrame:
    """A written table of what the sorted orders give for classes (node, signature, sketch): rows of the kinds above."""
    least, likely = _limits(percent)
    parts = max(1, -(-classes.count() * TREES // RANGE_ROWS))
    places = classes.select("node", "signature", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    places = places.select("tree", F.concat(F.expr(f"substring(signature, tree * {OWN} + 1, {OWN})"), F.col("sketch")).alias("label"), "node")
    # The node parts equal labels, so that a range never grows beyond its share however many classes are alike.
    ranged = places.repartitionByRange(parts, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    found = shared.written(ranged.mapInArrow(_forest(least, likely, parts == 1), _FOUND), "forest")
    if parts == 1:
        return found
    met = found.where(f"kind = {OPEN}").repartition("a").sortWithinPartitions("a").mapInArrow(_met(least, likely), _FOUND)
    met = shared.written(met, "met")
    # Rows of a crowd that end in a range where it is small.
    crowds = found.where(f"kind = {CROWDED}").unionByName(met.where(f"kind = {CROWDED}")).select("a").distinct()
    ends = found.where(f"kind = {OPEN}").join(crowds, "a", "left_semi").select(F.lit(CROWDED).alias("kind"), "a", "b", "part", "sketch")
    return found.unionByName(met).unionByName(ends)


def _linked(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """node, component of the classes that are linked to another one."""
    spark, least = docs.sparkSession, _limits(percent)[0]
    found = forest(classes, percent)
    pairs = shared.written(found.where(f"kind = {PAIR}").select("a", "b").distinct(), "pairs")
    regions = lambda kind: shared.written(found.where(f"kind = {kind}").select(F.col("a").alias("region"), F.col("b").alias("node"), "sketch").distinct(), "regions")
    partial, crowd = regions(PARTIAL), regions(CROWDED)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(partial.select("node")).unionByName(crowd.select("node"))
    ends = shared.written(ends.select(F.xxhash64("node").alias("h")).distinct(), "ends")
    sets = shared.written(_sets(docs, exact_dedup.repeated_filter(ends, exact_dedup.filter_bits(ends.count()), times=1), size), "sets")
    sums = shared.written(sets.select("node", "n", "parity").distinct(), "sums")
    known = shared.written(spark.createDataFrame([], "node long, component long"), "components")

    def confirm(some: DataFrame) -> None:
        nonlocal known
        some = shared.written(_plausible(some, sums, percent), "plausible")
        if some.isEmpty():
            return shared.dropped(some)
        # Only sets of these pairs are shuffled.
        marks = some.select(F.explode(F.array("a", "b")).alias("node")).select(F.xxhash64("node").alias("h"))
        test = exact_dedup.maybe_repeated(spark, exact_dedup.repeated_filter(marks, exact_dedup.filter_bits(marks.count()), times=1))
        links = shared.written(_confirmed(some, sets.where(test(F.xxhash64("node"))), percent), "links")
        if not links.isEmpty():
            known = _absorbed(known, links)
        shared.dropped(links)
        shared.dropped(some)

    def apart(some: DataFrame) -> DataFrame:
        of = lambda df, end: df.join(known.select(F.col("node").alias(end), F.col("component").alias(f"{end}c")), end, "left").withColumn(f"{end}c", F.coalesce(f"{end}c", end))
        return of(of(some, "a"), "b").where("ac <> bc").select("a", "b")

    def rounds(rows: DataFrame, width: int) -> None:
        left = rows = shared.written(rows.join(sums, "node").select("region", "node", "n", F.concat("sketch", "parity").alias("bits")), "rows")
        while True:
            placed = left.join(known, "node", "left").select("region", "node", F.coalesce("component", "node").alias("component"), "n", "bits")
            proposed = shared.written(placed.repartition("region").sortWithinPartitions("region").mapInArrow(_proposals(width, least, percent), _FOUND), "proposed")
            some = shared.written(proposed.where(f"kind = {PAIR}").select("a", "b").distinct(), "some")
            if not some.isEmpty():
                confirm(some)
            more = proposed.where(f"kind = {PARTIAL}").select(F.col("a").alias("region")).distinct()
            done = more.isEmpty()
            if not done:
                left = shared.written(rows.join(more, "region", "left_semi"), "left")
            shared.dropped(proposed)
            shared.dropped(some)
            if done:
                return
            width *= 4

    confirm(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    confirm(shared.written(apart(pairs), "apart"))
    if not partial.isEmpty():
        rounds(partial, 2)
    if not crowd.isEmpty():
        parted = shared.written(_parted(crowd, known), "parted")
        if not parted.isEmpty():
            rounds(parted, 2)
    for table in (pairs, partial, crowd, sets, sums):
        shared.dropped(table)
    return known


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; a row per row of ``docs``.

    Null texts count as empty; without words a document is linked with nothing and is its own component. Repeated rows
    are kept or dropped together. Rows that share a doc_id but not a text are each listed by their own text, so such a
    doc_id may have several components. A row without doc_id takes part as a copy of its text but is no end of other links,
    and is kept only where its component has no doc_id. An empty table gives no rows; other columns aren't read.
    """
    shared.small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = shared.written(_described(docs, size), "described")
    classes = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("n"))
    classes = shared.written(classes, "classes")
    linked = _linked(docs, classes.where("node IS NOT NULL"), size, percent)
    named = classes.join(linked, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    hot = shared.hot_keys(classes.where("n > 1"), "set_key")
    full = shared.salted_join(rows.where("n_shingles > 0").select("doc_id", "n_shingles", "set_key"), named, "set_key", hot, F.col("doc_id"))
    out = full.select("doc_id", "n_shingles", "component_id").unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that stay, one of each component, with their columns as they are, whatever those are called.

    Of a component that with the smallest doc_id stays. Rows without doc_id, and rows whose doc_id others have too, are
    documents of their own, which come after all others. Null texts and texts without words are linked with nothing and
    stay. An empty table gives no rows.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{doc_id}`").cast("long").alias("_key"), F.col(f"`{text}`").alias("_text"))
    ids = shared.written(packed.select("_key", F.xxhash64("_key").alias("h")), "ids")
    repeated = ids.where("_key IS NOT NULL").groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = shared.written(repeated, "repeated")
    odd, even = packed.where("_key IS NULL"), packed.where("_key IS NOT NULL")
    if not repeated.isEmpty():
        # Only rows whose doc_id may be repeated are shuffled.
        marks = repeated.select(F.xxhash64("_key").alias("h"))
        test = exact_dedup.maybe_repeated(docs.sparkSession, exact_dedup.repeated_filter(marks, exact_dedup.filter_bits(marks.count()), times=1))
        maybe = even.where(test(F.xxhash64("_key")))
        marked = shared.salted_join(maybe, repeated.select("_key", F.lit(True).alias("_odd")), "_key", shared.hot_keys(repeated, "_key"), F.xxhash64("_text"), "left")
        marked = shared.written(marked.select("_row", "_key", "_text", F.coalesce("_odd", F.lit(False)).alias("_odd")), "marked")
        even = even.where(~test(F.xxhash64("_key"))).unionByName(marked.where("NOT _odd").drop("_odd"))
        odd = odd.unionByName(marked.where("_odd").drop("_odd"))
    if not odd.isEmpty():
        first = (ids.agg(F.max("_key")).first()[0] or 0) + 1
        # Written, so that every reading has the same keys; beyond 64 bits the sum fails.
        odd = shared.written(odd.withColumn("_key", F.expr(f"{first}L + monotonically_increasing_id()")), "odd")
        even = even.unionByName(odd)
    lost = report(even.select("_key", "_text"), "_key", "_text", **options).where("NOT kept").select(F.col("doc_id").alias("_lost"))
    return even.join(lost, F.col("_key") == F.col("_lost"), "left_anti").select("_row.*")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(shared.table(spark, sf_dir, "documents"), size=2, percent=80)
