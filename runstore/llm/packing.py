"""Packing of related documents into windows.

A document's sketch is the square roots of its hashed token shares, reduced to the few principal numbers in which documents
differ (the axes come from exact sums over all documents, and every document is projected).  The nearest-neighbour graph covers the whole
table: documents are sorted by several Hilbert curves through turned and shifted sketch space, in each order everyone is
compared with everyone in a window around it, across blocks' and partitions' ends, and the nearest found in any order are
kept.  Over the graph greedy paths start at the unvisited document of lowest degree and go on to the nearest unvisited
neighbour.  The token stream along the paths fills one window after another, and only a task's last window is not full: it
is parted into windows whose sizes are powers of two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END_ID = 0
#: Hashed token counts of a document, and principal numbers of its sketch.
HASHED, SKETCH = 128, 8
#: Standard deviations on either side of the mean that curves tell apart; what is beyond stands at their ends.
SPREAD = 3
#: Sorted orders, bits of a number in a curve's key, documents of a block and on either side of it that it is compared with.
ORDERS, BITS, BLOCK, HALO = 6, 7, 512, 256
NEIGHBOURS = 8
#: Rows of a task that compares windows, documents of a task that walks paths, bytes of a task that cuts windows, about.
COMPARE_ROWS, WALK_DOCS, CUT_BYTES = 1 << 17, 1 << 17, 64 << 20
PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_BUCKET = (np.arange(1 << 16, dtype=np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(25)
#: Texts of these characters alone are split alike by both libraries, whatever their Unicode tables' versions.
_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f\\u2010-\\u2027\\u20ac]")


class Encoder:
    """Token ids as the tokenizers library gives them without special tokens added.

    tiktoken with the same vocabulary as ranks is several times as fast and gives the same ids for plain texts; the
    others (other scripts, the special token's own name) go through tokenizers itself.
    """

    def __init__(self, vocabulary: str, ranks: str) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.fast = tokens.library_encode(ranks)
        if self.slow.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")

    def __call__(self, text: str) -> np.ndarray:
        other = "<|endoftext|>" in text or _PLAIN.search(text)
        ids = self.slow.encode(text, add_special_tokens=False).ids if other else self.fast(text)
        out = np.empty(len(ids) + 1, np.uint16)
        out[:-1] = ids
        out[-1] = END_ID
        return out

    @classmethod
    def kept(cls, vocabulary: str, ranks: str) -> Encoder:
        cache = shared.worker_cache()
        if ("packing", vocabulary) not in cache:
            cache["packing", vocabulary] = cls(vocabulary, ranks)
        return cache["packing", vocabulary]


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """A written table: row (a number of its own for each), doc_id, n, ids (16 bits each with the end id, compressed), shares."""
    vocabulary, ranks = tokens.vocabulary(vocabulary), tokens.vocabulary(ranks)
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode, pack = Encoder.kept(vocabulary, ranks), zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            ids = [encode(t or "") for t in b.column(1).to_pylist()]
            shares = ((np.sqrt(np.bincount(_BUCKET[x], minlength=HASHED) / len(x)) * 255).astype(np.uint8).tobytes() for x in ids)
            columns = [b.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array([pack(x.tobytes()) for x in ids], pa.binary()), pa.array(list(shares), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "ids", "shares"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, n long, ids binary, shares binary")
    return shared.written(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "encoded")


@dataclass
class Axes:
    """Principal axes, and the curves' turns, shifts and unit."""

    mean: np.ndarray
    axes: np.ndarray
    turns: np.ndarray
    shifts: np.ndarray
    low: float
    width: float

    def points(self, shares: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join(shares), np.uint8).reshape(-1, HASHED).astype(np.float32)
        return ((x - self.mean) @ self.axes).astype(np.float32)

    def keys(self, points: np.ndarray) -> np.ndarray:
        """A row of keys for each order."""
        place = (points @ self.turns - self.low) / self.width  # orders x points x numbers
        cells = np.clip((place + self.shifts[:, None, :]) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return hilbert(cells.reshape(-1, cells.shape[2])).reshape(len(self.turns), -1)


def hilbert(cells: np.ndarray) -> np.ndarray:
    """Places on a Hilbert curve of points with whole coordinates of BITS bits (Skilling's transposition)."""
    x = cells.T.copy()
    top = 1 << (BITS - 1)
    q = top
    while q > 1:
        for row in x:
            other = np.where(row & q, q - 1, 0)
            swap = np.where(row & q, 0, (x[0] ^ row) & (q - 1))
            x[0] ^= other
            x[0] ^= swap
            row ^= swap
        q >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for bit in range(BITS - 1, -1, -1):
        for row in x:
            key = key << 1 | row >> bit & 1
    return key


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's number of documents, sums of their shares and sums of products of two shares, in one row."""
    n, first, second = 0, np.zeros(HASHED), np.zeros((HASHED, HASHED))
    for b in batches:
        x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, HASHED).astype(np.float64)
        n, first, second = n + len(x), first + x.sum(0), second + x.T @ x  # whole numbers under 2 ** 53, so exact
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n], first, second.ravel()]).astype("<i8").tobytes()], pa.binary())], ["sums"])


def fit_axes(table: DataFrame, seed: int = 5) -> Axes:
    """Axes from the shares of all documents, whatever their order: their mean and covariance are exact."""
    total = np.zeros(1 + HASHED + HASHED * HASHED, np.int64)
    for r in table.select("shares").mapInArrow(_sums, "sums binary").toLocalIterator():
        total += np.frombuffer(r["sums"], "<i8")
    n = max(int(total[0]), 1)
    mean = total[1 : 1 + HASHED] / n
    values, vectors = np.linalg.eigh(total[1 + HASHED :].reshape(HASHED, HASHED) / n - np.outer(mean, mean))
    by = np.argsort(-values)[:SKETCH]
    axes = vectors[:, by]
    axes *= np.where(axes.sum(0) < 0, -1, 1)
    rng = np.random.default_rng(seed)
    turns = np.stack([np.linalg.qr(rng.standard_normal((SKETCH, SKETCH)))[0] for _ in range(ORDERS)])
    # Of turned numbers, on the average of all turns.
    reach = SPREAD * float(np.sqrt(max(values[by].mean(), 0)))
    return Axes(mean.astype(np.float32), axes.astype(np.float32), turns.astype(np.float32), rng.random((ORDERS, SKETCH)).astype(np.float32), -reach, max(2 * reach, 1e-3))


def nearest(points: np.ndarray, others: np.ndarray, same: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``points`` the places of its ``k`` nearest among ``others`` and their squared distances; ``same`` holds
    each point's own place among them."""
    d = np.maximum((others**2).sum(1)[None, :] + (points**2).sum(1)[:, None] - 2 * points @ others.T, 0)
    if same is not None:
        d[np.arange(len(points)), same] = np.inf
    k = min(k, len(others) - (same is not None))
    at = np.argpartition(d, max(k - 1, 0), axis=1)[:, :k]
    return at, np.take_along_axis(d, at, 1).astype(np.float32)


def _listed(rows: np.ndarray, near: np.ndarray, far: np.ndarray, **more) -> pa.RecordBatch:
    """Rows with their neighbours as bytes."""
    blank = pa.nulls(len(rows), pa.int64())
    column = lambda name: pa.array(more[name], pa.int64()) if name in more else blank
    join = lambda x, kind: pa.array([r.tobytes() for r in np.ascontiguousarray(x, kind)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), column("n"), column("key"), join(near, "<i8"), join(far, "<f4")], ["row", "n", "key", "near", "far"])


_SORTED = "order int, key long, row long, n long, point binary"


def _sorted_columns(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """A task's rows, some COMPARE_ROWS, as arrays."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    order, key, row, n = (np.concatenate([b.column(b.schema.get_field_index(c)).to_numpy() for b in held]) for c in ("order", "key", "row", "n"))
    point = np.frombuffer(b"".join(p for b in held for p in b.column(b.schema.get_field_index("point")).to_pylist()), "<f4").reshape(-1, SKETCH)
    return order, key, row, n, point


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range of the orders: every row's neighbours within its block and HALO rows on either side; and the first and
    last HALO rows of the range, for those of the ranges beside it."""
    from pyspark import TaskContext

    got, part = _sorted_columns(batches), TaskContext.get().partitionId()
    if got is None:
        return
    order, key, row, n, point = got
    blank = lambda k, kind: pa.nulls(k, kind)
    cuts = [0, *(np.flatnonzero(order[1:] != order[:-1]) + 1), len(order)]
    for low, high in zip(cuts, cuts[1:]):
        for s in range(low, high, BLOCK):
            e = min(s + BLOCK, high)
            a, z = max(low, s - HALO), min(high, e + HALO)
            at, far = nearest(point[s:e], point[a:z], np.arange(s, e) - a, NEIGHBOURS)
            first = {"key": key[s:e]} if order[s] == 0 else {}
            b = _listed(row[s:e], row[a:z][at], far, n=n[s:e], **first)
            k = e - s
            yield pa.RecordBatch.from_arrays([*b.columns, blank(k, pa.int64()), blank(k, pa.int32()), blank(k, pa.bool_()), blank(k, pa.binary())], [*b.schema.names, "bound", "order", "before", "point"])
    for before, rows in ((True, np.arange(max(cuts[-2], len(order) - HALO), len(order))), (False, np.arange(min(cuts[1], HALO)))):
        k = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[rows], pa.int64()), pa.array(n[rows], pa.int64()), blank(k, pa.int64()), blank(k, pa.binary()), blank(k, pa.binary()), pa.array(np.full(k, part - (not before)), pa.int64()),
             pa.array(order[rows], pa.int32()), pa.array(np.full(k, before), pa.bool_()), pa.array([p.tobytes() for p in point[rows]], pa.binary())],
            ["row", "n", "key", "near", "far", "bound", "order", "before", "point"],
        )


_NEAR = "row long, n long, key long, near binary, far binary"


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours across the bounds of ranges: of rows (bound, order, before, row, n, point) sorted by bound."""
    held: list[pa.RecordBatch] = [b for b in batches if b.num_rows]
    if not held:
        return
    get = lambda c: np.concatenate([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for b in held])
    bound, order, before, row, n = map(get, ("bound", "order", "before", "row", "n"))
    point = np.frombuffer(b"".join(p for b in held for p in b.column(b.schema.get_field_index("point")).to_pylist()), "<f4").reshape(-1, SKETCH)
    place = bound * (ORDERS + 1) + order
    by = np.argsort(place, kind="stable")
    for rows in np.split(by, np.flatnonzero(np.diff(place[by])) + 1):
        left, right = rows[before[rows].astype(bool)], rows[~before[rows].astype(bool)]
        if len(left) and len(right):
            for a, z in ((left, right), (right, left)):
                at, far = nearest(point[a], point[z], None, NEIGHBOURS)
                yield _listed(row[a], row[z][at], far, n=n[a])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by row, one or more each, the nearest NEIGHBOURS of all that are listed."""

    def emit(b: pa.Table) -> pa.RecordBatch:
        row, n = b.column("row").to_numpy(), b.column("n").to_numpy()
        near = b.column("near").to_pylist()
        size = np.fromiter(map(len, near), np.int64, len(near)) // 8
        other, far = np.frombuffer(b"".join(near), "<i8"), np.frombuffer(b"".join(b.column("far").to_pylist()), "<f4")
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        me = np.repeat(np.cumsum(np.append(True, row[1:] != row[:-1])) - 1, size)
        by = np.lexsort((other, me))
        by = by[np.append(True, (me[by][1:] != me[by][:-1]) | (other[by][1:] != other[by][:-1]))[: len(by)]]
        by = by[np.lexsort((other[by], far[by], me[by]))]
        first = np.searchsorted(me[by], np.arange(len(start)))
        by = by[np.arange(len(by)) - first[me[by]] < NEIGHBOURS]
        count = np.bincount(me[by], minlength=len(start))
        ends = np.cumsum(count)
        key = b.column("key").to_pandas().groupby(np.cumsum(np.append(True, row[1:] != row[:-1])) - 1).max().to_numpy()
        parts = lambda x, kind: pa.array([x[e - c : e].tobytes() for e, c in zip(ends, count)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(row[start], pa.int64()), pa.array(n[start], pa.int64()), pa.array(key.astype(np.int64), pa.int64()), parts(other[by], "<i8"), parts(far[by], "<f4")], ["row", "n", "key", "near", "far"])

    rest = None
    for b in batches:
        table = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks()
        row = table.column("row").to_numpy()
        if not len(row):
            continue
        cut = int(np.searchsorted(row, row[-1]))
        if cut:
            yield emit(table.slice(0, cut))
        rest = table.slice(cut).combine_chunks().to_batches()[0]
    if rest is not None and rest.num_rows:
        yield emit(pa.Table.from_batches([rest]))


def graph(table: DataFrame, axes: Axes, compare_rows: int = COMPARE_ROWS) -> DataFrame:
    """row, n, key (of the first order), near (up to NEIGHBOURS rows, nearest first) and far (squared distances), both as bytes."""
    spark = table.sparkSession
    sent, parts = shared.shipped(spark, axes), max(1, round(table.count() * ORDERS / compare_rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            axes = sent()
            points = axes.points(b.column(2).to_pylist())
            keys, k = axes.keys(points), len(points)
            data = pa.array([p.tobytes() for p in points], pa.binary())
            for order in range(ORDERS):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, order), pa.int32()), pa.array(keys[order], pa.int64()), b.column(0), b.column(1), data], ["order", "key", "row", "n", "point"])

    placed = table.select("row", "n", "shares").mapInArrow(place, _SORTED)
    ranged = placed.repartitionByRange(parts, "order", "key", "row").sortWithinPartitions("order", "key", "row")
    found = ranged.mapInArrow(_windows, f"{_NEAR}, bound long, order int, before boolean, point binary")
    out = found.where("bound IS NULL").select("row", "n", "key", "near", "far")
    if parts > 1:
        found = shared.written(found, "neighbours")
        bounds = found.where("bound IS NOT NULL").select("bound", "order", "before", "row", "n", "point")
        out = found.where("bound IS NULL").select("row", "n", "key", "near", "far").unionByName(bounds.repartition("bound").mapInArrow(_across, _NEAR))
    return out.repartition(parts, "row").sortWithinPartitions("row").mapInArrow(_merged, _NEAR)


def paths(near: list[np.ndarray]) -> list[int]:
    """Greedy paths through a graph: ``near`` has each document's neighbours, nearest first; edges go both ways."""
    n = len(near)
    size = np.fromiter(map(len, near), np.int64, n)
    a, b = np.repeat(np.arange(n), size), np.concatenate([*near, np.zeros(0, np.int64)]).astype(np.int64)
    rank = np.concatenate([*map(np.arange, size), np.zeros(0, np.int64)])
    both = np.lexsort((np.append(b, a), np.append(rank, rank), np.append(a, b)))  # by document, then nearness
    after = np.append(b, a)[both].tolist()
    degree = np.bincount(np.append(a, b), minlength=n)
    start = (np.cumsum(degree) - degree).tolist()
    seen, out = bytearray(n), []
    for first in np.lexsort((np.arange(n), degree)).tolist():
        at = first
        while at is not None and not seen[at]:
            seen[at] = 1
            out.append(at)
            s = start[at]
            at = next((j for j in after[s : s + int(degree[at])] if not seen[j]), None)
    return out


def window_ends(total: int, size: int) -> list[int]:
    """Where windows end in a stream of ``total`` tokens: whole ones, then powers of two for what is left."""
    ends = list(range(size, total + 1, size))
    at, left = total // size * size, total % size
    while left:
        part = 1 << (left.bit_length() - 1)
        at, left = at + part, left - part
        ends.append(at)
    return ends


def placed_pieces(n: np.ndarray, size: int, sequence: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of documents of ``n`` tokens in a stream, windows numbered from ``sequence`` on: rows (start, length,
    sequence, offset), and the number of pieces of each document."""
    stop = np.cumsum(n)
    ends = np.array(window_ends(int(stop[-1]) if len(n) else 0, size), np.int64)
    cuts = np.union1d(stop, ends)  # every piece ends at a document's or a window's end
    begin = np.append(0, cuts)[:-1]
    doc, window = np.searchsorted(stop, begin, "right"), np.searchsorted(ends, begin, "right")
    pieces = np.column_stack([begin - (stop - n)[doc], cuts - begin, sequence + window, begin - np.append(0, ends)[window]])
    return pieces, np.bincount(doc, minlength=len(n))


def _walk(size: int):
    """Of one range of documents: the pieces of each, as bytes, along the paths through its part of the graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        row, n = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        by = np.argsort(row, kind="stable")
        row, n = row[by], n[by]
        lists = [x for b in held for x in b.column(2).to_pylist()]
        near = []
        for i in by.tolist():  # neighbours in other ranges aren't walked to
            other = np.frombuffer(lists[i], "<i8")
            at = np.minimum(np.searchsorted(row, other), len(row) - 1)
            near.append(at[row[at] == other])
        order = np.array(paths(near), np.int64)
        pieces, count = placed_pieces(n[order], size, TaskContext.get().partitionId() << 40)
        ends = np.cumsum(count)
        for s in range(0, len(order), 4096):
            part = order[s : s + 4096]
            data = [np.ascontiguousarray(pieces[e - c : e], "<i8").tobytes() for e, c in zip(ends[s : s + 4096], count[s : s + 4096])]
            yield pa.RecordBatch.from_arrays([pa.array(row[part], pa.int64()), pa.array(data, pa.binary())], ["row", "pieces"])

    return run


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 1024, vocabulary: str = VOCABULARY, ranks: str = RANKS, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for): a row per piece of a document.

    Null texts count as empty and are their end id alone. Repeated rows are packed each. Sequences are of ``size``
    tokens but for a task's last ones, whose lengths are powers of two; nothing is padded if ``size`` is one too. An empty
    table gives no rows. Extra columns aren't read.
    """
    table = encoded(docs, doc_id, text, vocabulary, ranks)
    n_docs, n_tokens = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    near = graph(table, fit_axes(table)).select("row", "n", "near", "key")
    ranged = near.repartitionByRange(max(1, -(-n_docs // WALK_DOCS)), "key", "row").select("row", "n", "near")
    pieces = ranged.mapInArrow(_walk(size), "row long, pieces binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out, ids = [], []
            for doc, n, data, at in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(unpack(data), np.uint16).astype("<u4")
                for start, length, sequence, offset in np.frombuffer(at, "<i8").reshape(-1, 4).tolist():
                    piece = x[start : start + length]
                    out.append((doc, start, length, zlib.crc32(piece), n, sequence, offset))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], pa.int64()) for k in range(len(PIECE))), *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], [*PIECE, *(["ids"] if with_ids else [])])

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_tokens // (CUT_BYTES // 2)))
    both = table.select("row", "doc_id", "n", "ids").repartition(parts, "row").join(pieces.repartition(parts, "row").hint("shuffle_hash"), "row")
    return both.select("doc_id", "n", "ids", "pieces").mapInArrow(cut, ", ".join(f"{c} long" for c in PIECE) + (", ids array<int>" if with_ids else ""))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(shared.table(spark, sf_dir, "documents"))
