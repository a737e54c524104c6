"""Byte-level BPE by public vocabularies: fast library encoders, and encoding and decoding in numpy matrices.

:class:`MatrixBPE` is the operator of its own: pieces of text go into length-bucketed padded matrices of token ids;
each round looks up every adjacent pair of a matrix in a hash table, merges each row's leftmost pair of minimum rank,
closes the gap by compaction, and drops the rows that have no pair left.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

ENCODE_RANKS = "byte_bpe_multi_50k.tiktoken"
COUNT_RANKS = "byte_bpe_50k.tiktoken"
#: Upper ends of the length buckets.  A longer piece is a matrix of one row, which merges all its pairs of minimum rank in
#: a round, as one merger a round is quadratic in a piece's length.
BUCKETS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256)
#: The library's splitter ends the process on a run of some 500,000 white-space characters; texts with a run of this
#: length are split by another one.
LONGEST_BLANK = 50_000
#: Encoded pieces that a worker remembers before it forgets all.
REMEMBERED = 200_000


def vocabulary(name_or_path: str) -> str:
    """A path as it is, a bare name as that of a public tokenizer's file."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def library_encoder(path: str):
    """tiktoken's encoder, kept for as long as the worker lives."""
    cache = shared.worker_cache()
    if ("tiktoken", path) not in cache:
        import public_tokenizers
        import tiktoken

        cache["tiktoken", path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    return cache["tiktoken", path]


def library_encode(path: str):
    """A function from a text of any kind to an array of its token ids, as tiktoken's ``encode_ordinary`` gives them."""
    import regex

    import public_tokenizers

    encoder = library_encoder(path)
    blank, split = regex.compile(r"\s+"), regex.compile(public_tokenizers.PATTERN)

    def encode(text: str) -> np.ndarray:
        if len(text) < LONGEST_BLANK or max((m.end() - m.start() for m in blank.finditer(text)), default=0) < LONGEST_BLANK:
            return encoder.encode_to_numpy(text, disallowed_special=())
        return np.array([i for piece in split.findall(text) for i in encoder._encode_single_piece(piece.encode())], np.uint32)

    return encode


# --- lengths -----------------------------------------------------------------------------------------------------


def lengths(docs: DataFrame, text: str = "text", ranks: str = COUNT_RANKS) -> DataFrame:
    """``n_tokens`` of every row's whole text (null: 0 tokens, as empty).

    A row per row, repeated ones too; an empty table gives none; other columns aren't read.
    """
    path = vocabulary(ranks)
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encode(path)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array([len(encode(t)) if t else 0 for t in b.column(0).to_pylist()], pa.int64())})

    return docs.select(text).mapInArrow(run, "n_tokens long")


def histogram(n_tokens: DataFrame) -> DataFrame:
    """Exact: ``n_tokens``, ``n_docs``. Map-side counts make one length that most rows have as cheap as any."""
    return n_tokens.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


#: Lengths of a block share a window; blocks are summed first, so no task sees the whole histogram.
BLOCK = 4096


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length: documents and tokens at or above it, and totals when every document is cut at this length.

    n_tokens, n_docs, docs_at_least, tokens_at_least, docs_total, tokens_total, truncated_tokens (sum of
    min(length, n_tokens)), lost_tokens, and share_at_most (of documents no longer than it: the rank of a quantile).
    ``hist`` may be any histogram by exact length; empty gives no rows.
    """
    from pyspark.sql import Window

    h = shared.written(hist.withColumn("block", F.expr(f"n_tokens div {BLOCK}")), "histogram")
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    # Blocks are few: the longest document's length over BLOCK.
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"), F.sum("d").over(all_rows).alias("docs_total"), F.sum("t").over(all_rows).alias("tokens_total"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = h.join(blocks, "block").withColumns({"docs_at_least": F.col("d_above") + F.sum("n_docs").over(within), "tokens_at_least": F.col("t_above") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(within)})
    lost = F.col("tokens_at_least") - F.col("n_tokens") * F.col("docs_at_least")
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "docs_total", "tokens_total",
        (F.col("tokens_total") - lost).alias("truncated_tokens"), lost.alias("lost_tokens"),
        ((F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total")).alias("share_at_most"),
    )


def at_limits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """Answers for any context limits (one long column ``limit``): documents that exceed it, tokens kept and lost.

    ``sums`` comes from :func:`suffix_sums`; a limit is answered by the least length above it. ``limits`` is a short
    list. No rows if the table is empty.
    """
    total = sums.agg(F.max("tokens_total").alias("tokens_total"))
    least = limits.join(sums, sums["n_tokens"] > limits["limit"], "left").groupBy("limit").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens").alias("s"))
    docs, tokens = F.coalesce("s.docs_at_least", F.lit(0)), F.coalesce("s.tokens_at_least", F.lit(0))
    lost = tokens - docs * F.col("limit")
    return least.join(F.broadcast(total)).where("tokens_total IS NOT NULL").select("limit", docs.alias("docs_over"), (F.col("tokens_total") - lost).alias("tokens_kept"), lost.alias("tokens_lost"))


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that at least a share ``q`` of the documents doesn't exceed; None of an empty table."""
    return sums.where(F.col("share_at_most") >= q).agg(F.min("n_tokens")).first()[0]


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(lengths(shared.table(spark, sf_dir, "documents"))))


# --- matrices ----------------------------------------------------------------------------------------------------


class PairTable:
    """Open-addressing hash table from a pair of token ids to the id of their merger, in numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, rank))
        self.bits = max(4, int(np.ceil(np.log2(4 * max(len(pairs), 1)))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, self.NONE, np.int32)
        keys = np.array([p[0] for p in pairs], np.int64)
        values = np.array([p[1] for p in pairs], np.int32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):  # one key wins each free slot, the others step on
            free = self.keys[at[left]] == -1
            self.keys[at[left[free]]] = keys[left[free]]
            won = self.keys[at[left]] == keys[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    NONE = np.iinfo(np.int32).max

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); NONE where they don't merge, as for any pair with a -1."""
        keys = (a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)
        shape, keys = keys.shape, keys.ravel()
        out = np.full(keys.shape, self.NONE, np.int32)
        left = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        at = self._home(keys[left])
        while len(left):
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (found != -1)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from starts[i] on, sizes[i] of them, for all i one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class MatrixBPE:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._forget()

    def _bucket(self, pieces: list[bytes], number: np.ndarray, width: int, done: list) -> None:
        """Encode ``pieces``, numbered ``number``; adds (numbers, lengths, ids one after another) to ``done``."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        x = np.full((len(pieces), width), -1, np.int32)
        x[np.arange(width) < lens[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rows = number
        rank = self.pairs(x[:, :-1], x[:, 1:])
        while len(rows):
            at = rank.argmin(axis=1)  # the first of equal minima: the leftmost
            best = rank[np.arange(len(rows)), at]
            over = best == PairTable.NONE
            if over.any():
                done.append((rows[over], lens[over], x[over][np.arange(x.shape[1]) < lens[over][:, None]]))
                go = ~over
                x, rank, rows, lens, at, best = x[go], rank[go], rows[go], lens[go], at[go], best[go]
                if not len(rows):
                    break
            n = np.arange(len(rows))
            x[n, at] = best
            # Compaction: what follows the merged pair moves a place to the left.
            x = np.where(np.arange(x.shape[1] - 1) <= at[:, None], x[:, :-1], x[:, 1:])
            lens -= 1
            if x.shape[1] == 1:
                done.append((rows, lens, x[:, 0]))
                break
            rank = np.where(np.arange(rank.shape[1] - 1) < at[:, None], rank[:, :-1], rank[:, 1:])
            # Only the two pairs that touch the new token changed.
            right = np.minimum(at, rank.shape[1] - 1)
            rank[n, right] = self.pairs(x[n, right], x[n, right + 1])
            left = np.maximum(at - 1, 0)
            rank[n, left] = self.pairs(x[n, left], x[n, left + 1])

    def _wide(self, piece: bytes) -> np.ndarray:
        """A row of any length by itself: a round merges all its pairs of minimum rank, from left to right.

        That is what as many rounds of the leftmost one would do, unless a merger makes a pair of no greater rank; then
        the round merges the leftmost alone.  Merged places stay as holes, which links skip, until half of the row is holes.
        """
        x = self.byte_ids[np.frombuffer(piece, np.uint8)]
        rank = np.append(self.pairs(x[:-1], x[1:]), PairTable.NONE)
        n = left = len(x)
        live, after, before = np.ones(n, bool), np.arange(1, n + 1), np.arange(-1, n - 1)
        while (r := rank.min()) != PairTable.NONE:
            hit = np.flatnonzero(rank == r)
            if len(hit) > 1:  # of pairs that overlap, the first, the third and so on
                k = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(np.append(True, after[hit[:-1]] != hit[1:]), k, 0))
                hit = hit[(k - run) % 2 == 0]
            while True:
                gone = after[hit]
                end = after[gone]
                inner = end < n
                was = x[hit], before[end[inner]]
                x[hit], after[hit], before[end[inner]] = r, end, hit[inner]
                start = before[hit]
                right = self.pairs(x[hit], np.where(inner, x[np.minimum(end, n - 1)], -1))
                lower = self.pairs(np.where(start >= 0, x[start], -1), x[hit])
                if len(hit) == 1 or min(right.min(), lower.min()) > r:
                    break
                x[hit], after[hit], before[end[inner]] = was[0], gone, was[1]
                hit = hit[:1]
            rank[gone], live[gone], rank[hit] = PairTable.NONE, False, right
            rank[start[start >= 0]] = lower[start >= 0]
            left -= len(hit)
            if 2 * left < n:
                x, rank, n = x[live], rank[live], left
                live, after, before = np.ones(n, bool), np.arange(1, n + 1), np.arange(-1, n - 1)
        return x[live]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces one after another in some order, and where each piece's begin and how many they are.

        A piece that is itself a token is that token.
        """
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        known, todo = np.flatnonzero(whole >= 0), np.flatnonzero((whole < 0) & (lens > 0))
        done = [(known, np.ones(len(known), np.int64), whole[known].astype(np.int32))]
        which = np.searchsorted(BUCKETS, lens[todo])
        for k, width in enumerate(BUCKETS):
            rows = todo[which == k]
            step = max(1, (1 << 20) // width)  # rows of a matrix
            for s in range(0, len(rows), step):
                part = rows[s : s + step]
                self._bucket([pieces[i] for i in part], part, width, done)
        for i in todo[which == len(BUCKETS)]:
            ids = self._wide(pieces[i])
            done.append((np.array([i]), np.array([len(ids)]), ids))
        number, size, flat = (np.concatenate(x) for x in zip(*done))
        starts, sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        starts[number], sizes[number] = np.cumsum(size) - size, size
        return flat, starts, sizes

    def _learn(self, pieces: list[str]) -> None:
        """Remember the ids of new pieces: a number for each, under which ``at`` and ``count`` find its ids in ``ids``."""
        flat, starts, sizes = self.encode_pieces([p.encode() for p in pieces])
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.at = np.concatenate([self.at, starts + len(self.ids)])
        self.count = np.concatenate([self.count, sizes])
        self.ids = np.concatenate([self.ids, flat])

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.at, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, each match of the public pattern encoded by itself, as int32 arrays."""
        import public_tokenizers
        import regex

        find = regex.compile(public_tokenizers.PATTERN).findall
        split = [find(t) for t in texts]
        distinct = set().union(*split)
        new = [p for p in distinct if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = list(distinct)
        if new:
            self._learn(new)
        number = self.known.__getitem__
        out = []
        for pieces in split:
            k = np.fromiter(map(number, pieces), np.int64, len(pieces))
            out.append(self.ids[_ranges(self.at[k], self.count[k])])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered from one flat array."""
        return self.flat[_ranges(self.starts[ids], self.sizes[ids])].tobytes()


def matrix_encoder(path: str) -> MatrixBPE:
    cache = shared.worker_cache()
    if ("matrix", path) not in cache:
        cache["matrix", path] = MatrixBPE(read_ranks(path))
    return cache["matrix", path]


def encoded(docs: DataFrame, text: str = "text", ranks: str = ENCODE_RANKS) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), the token ids of the whole text; a null or empty text has none.

    Every row stays, repeated ones too; a table that has a column of that name is refused; an empty one gives no rows.
    """
    shared.refuse(docs, "ids")
    path = vocabulary(ranks)
    shared.small_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        return pd.Series(matrix_encoder(path).encode_batch([t or "" for t in texts]))

    return docs.withColumn("ids", ids(F.col(text)))


def decoded(docs: DataFrame, ids: str = "ids", ranks: str = ENCODE_RANKS) -> DataFrame:
    """``docs`` with ``decoded`` (binary), the bytes of its token ids; null ids give empty bytes.

    Every row stays; a table that has a column of that name is refused.
    """
    shared.refuse(docs, "decoded")
    path = vocabulary(ranks)
    shared.small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def run(rows):
        import pandas as pd

        bpe = matrix_encoder(path)
        return pd.Series([b"" if r is None else bpe.decode(np.asarray(r, np.int64)) for r in rows])

    return docs.withColumn("decoded", run(F.col(ids)))


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = ENCODE_RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 per row: encoded and decoded in one pass, ids never leave it.

    Null texts count as empty and have no ids; repeated rows and null doc_ids stay; an empty table gives no rows; other
    columns aren't read.
    """
    path = vocabulary(ranks)
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = matrix_encoder(path)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            ids = bpe.encode_batch([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0),
                "n_tokens": pa.array(list(map(len, ids)), pa.int64()),
                "ids_sha256": [digest(x.astype("<u4").tobytes()) for x in ids],
                "decoded_sha256": [digest(bpe.decode(x)) for x in ids],
            })

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(shared.table(spark, sf_dir, "documents"))
