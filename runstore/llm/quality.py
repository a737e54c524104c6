"""Quality rules, and isolation forests over their statistics.

Exact statistics of every whole text feed fixed base rules.  Of the texts that pass those, isolation forests (random
splits; anomalous rows end on short paths) find odd combinations of statistics: one those of style, one those of counts
that are zero in most texts, whose rare values would drown the former's.  Each tree grows from a few rows, as the method
has it, drawn anew from all the labelled ones of one half, and a forest's threshold is the one that over all the labelled
rows of the other half best parts those labelled bad from those labelled good while it keeps at least ``keep_share`` of the
latter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SYMBOLS = "#*$%&|<>"
WHITE = "\t\n\x0b\x0c\r "
#: Ratios that each forest sees, derived from the counts.
STYLE = ("mean_word", "symbols_per_word", "upper_share", "mark_share", "log_words_per_line")
RARE = ("digit_share", "dup_line_share", "repeat_word_share")
#: Trees of a forest and rows that each is grown from.
TREES, TREE_ROWS = 128, 256
#: Scores are multiples of one over so many, so that a table of counts holds exactly how they are spread.
STEPS = 1 << 16


def statistics(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_upper, n_digit, n_mark."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # on exactly space and \\x09-\\x0D
    if not words:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0, 0, 0, 0)
    lines = [x for x in data.split(b"\n") if x.strip()]
    kind = dict.fromkeys(words)
    ids = dict(zip(kind, range(len(kind))))
    number = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    repeated = 0
    if len(words) > 3 and len(kind) < len(words):
        n = len(kind)
        pair = number[:-1] * n + number[1:]
        key = pair[:-1] * n + number[2:] if n < 2_000_000 else np.unique(pair, return_inverse=True)[1][:-1] * n + number[2:]
        order = np.argsort(key, kind="stable")
        s = key[order]
        same = s[1:] == s[:-1]
        again = np.zeros(len(s), bool)
        again[1:] |= same
        again[:-1] |= same
        at = order[again]
        hit = np.zeros(len(words), bool)
        for d in range(3):
            hit[at + d] = True
        repeated = int(hit.sum())
    raw = np.frombuffer(data, np.uint8)
    count = np.bincount(raw, minlength=256)
    return (
        len(words), len(text) - int(count[9:14].sum() + count[32]), int(sum(count[ord(c)] for c in SYMBOLS)),
        len(lines) - len(set(lines)), repeated, len(lines), int(count[65:91].sum()), int(count[48:58].sum()),
        int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digit", "n_mark")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the COUNTS of each row's whole text (null: no words)."""
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics(t or "") for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, np.ascontiguousarray(rows.T))], ["doc_id", *COUNTS])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The STYLE and the RARE ratios of rows of COUNTS."""
    words, chars, symbols, dup, repeat, lines, upper, digit, mark = x.T.astype(np.float64)
    w, c, n = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.column_stack([chars / w, symbols / w, upper / c, mark / c, np.log1p(words / n)]), np.column_stack([digit / c, dup / n, repeat / w])


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of n keys."""
    n = np.asarray(n, np.float64)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Complete trees in arrays: node i has children 2i+1 and 2i+2; a leaf's split is +inf and its path goes left."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    depth: int
    typical: float

    @classmethod
    def grown(cls, x: np.ndarray, drawn: list[np.ndarray], seed: int = 7) -> Forest:
        """A tree from each of the lists ``drawn`` of places of rows, which are equally long."""
        rng, trees, sample = np.random.default_rng(seed), len(drawn), len(drawn[0])
        depth = max(1, int(np.ceil(np.log2(max(sample, 2)))) + 2)
        nodes = (1 << (depth + 1)) - 1
        feature, split, path = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
        for t in range(trees):
            todo = [(0, 0, x[drawn[t]])]
            while todo:
                i, d, rows = todo.pop()
                low, high = rows.min(0), rows.max(0)
                wide = np.flatnonzero(high > low)
                if d == depth or len(rows) <= 1 or not len(wide):
                    while i < nodes:  # so that the walk, which always takes depth steps, ends on this leaf's path
                        path[t, i] = d + _average_path(len(rows))
                        i = 2 * i + 1
                    continue
                f = rng.choice(wide)
                feature[t, i], split[t, i] = f, rng.uniform(low[f], high[f])
                left = rows[:, f] < split[t, i]
                todo += [(2 * i + 1, d + 1, rows[left]), (2 * i + 2, d + 1, rows[~left])]
        return cls(feature, split, path, depth, float(_average_path(sample)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1): 2 to the power of minus the mean path length over the typical one, in STEPS."""
        total = np.zeros(len(x))
        for feature, split, path in zip(self.feature, self.split, self.path):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] >= split[at])
            total += path[at]
        return np.round(2.0 ** (-total / len(self.path) / max(self.typical, 1e-9)) * STEPS) / STEPS


@dataclass
class Model:
    """A forest and its threshold for each group of ratios; none rejects nothing."""

    forests: list[Forest]
    thresholds: list[float]

    def score(self, counts: np.ndarray) -> np.ndarray:
        """A column of anomalies for each group."""
        if not self.forests or not len(counts):
            return np.zeros((len(counts), 2))
        return np.column_stack([f.score(x) for f, x in zip(self.forests, features(counts))])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def taught(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows of ``counts`` that pass the base rules and are labelled, equal ones once with their number ``_rows``, with
    ``_quality`` and ``h``, of which a bit tells the half that grows the forests from the one that calibrates them."""
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("_quality")).where("_quality IN (0, 1) AND doc_id IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.min("_quality").alias("_quality"))
    rows = counts.where(~base_failed()).groupBy("doc_id", *COUNTS).agg(F.count(F.lit(1)).alias("_rows"))
    return rows.join(marks, "doc_id").select("doc_id", "_quality", *COUNTS, F.xxhash64("doc_id").alias("h"), "_rows")


def labelled(counts: DataFrame, labels: DataFrame, sample: int = 20_000):
    """A pandas table of at most ``sample`` of the rows of :func:`taught`, to look at; :func:`fit` learns from all."""
    return taught(counts, labels).orderBy("h", "doc_id", *COUNTS).limit(sample).toPandas()


def _grows(h: np.ndarray) -> np.ndarray:
    return (h >> 7 & 1).astype(bool)


def _draws(g: np.ndarray) -> np.ndarray:
    """Rows' numbers (of 64 bits) for each tree, which grows from the rows that have the smallest."""
    x = g.view(np.uint64)[:, None] ^ (np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(rows: DataFrame, total: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """COUNTS of the rows that any tree grows from, and each tree's places among them: of all ``total`` rows (with g, a hash)
    the TREE_ROWS with the smallest numbers, or all if there are fewer. Only rows with a number under a first guess, about
    twice as many as are needed whatever the total, leave the tasks."""
    need, share = min(TREE_ROWS, total), min(1.0, (TREE_ROWS + 10 * TREE_ROWS**0.5 + 100) / max(total, 1))
    while True:
        top = np.uint64(min(int(share * 2**64), 2**64 - 1))

        def run(batches: Iterator[pa.RecordBatch], top: np.uint64 = top) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array((_draws(b.column(b.schema.get_field_index("g")).to_numpy()) <= top).any(axis=1)))

        names = ("g", "doc_id", *COUNTS)
        got = rows.select(*names).mapInArrow(run, ", ".join(f"{c} long" for c in names)).toPandas().sort_values(list(names))
        key = _draws(got["g"].to_numpy(np.int64))
        if share >= 1 or ((key <= top).sum(axis=0) >= need).all():
            return got[list(COUNTS)].to_numpy(np.int64), list(np.argsort(key, axis=0, kind="stable")[:need].T)
        share = min(1.0, 2 * share)


def spread(rows: DataFrame, forests: list[Forest]) -> np.ndarray:
    """For each forest and quality the number of ``rows`` with each score (a multiple of 1 / STEPS)."""
    sent = shared.shipped(rows.sparkSession, Model(forests, []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, 2, STEPS + 1), np.int64)
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c)).to_numpy()  # noqa: E731, B023
            at = np.rint(sent().score(np.column_stack([get(c) for c in COUNTS])) * STEPS).astype(np.int64)
            for k in range(2):
                np.add.at(out[k], (get("_quality"), at[:, k]), get("_rows"))
        forest, quality, step = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (forest, quality, step, out[forest, quality, step])], ["forest", "quality", "step", "n"])

    # At most STEPS + 1 rows for each of two forests and two qualities, whatever the input.
    found = rows.select(*COUNTS, "_quality", "_rows").mapInArrow(run, "forest long, quality long, step long, n long")
    found = found.groupBy("forest", "quality", "step").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((2, 2, STEPS + 1), np.int64)
    out[found["forest"], found["quality"], found["step"]] = found["n"]
    return out


def threshold(bad: np.ndarray, fine: np.ndarray, keep_share: float) -> float:
    """From the good rows' quantile up, the score above which most bad rows lie for the fewest good ones; for no bad row none
    goes. Of rows labelled bad and good: the number with each score."""
    upto, worse = np.cumsum(fine), np.cumsum(bad)
    place = keep_share * (upto[-1] - 1)
    low, high = (int(np.searchsorted(upto, min(np.floor(place) + k, upto[-1] - 1), "right")) for k in (0, 1))
    limit = low + (high - low) * (place - np.floor(place))
    steps = np.flatnonzero(fine)
    steps = np.unique(np.append(steps[steps >= limit], limit))
    at = np.floor(steps).astype(np.int64)
    gain = ((worse[-1] - worse[at]) / worse[-1] if worse[-1] else 0.0) + upto[at] / upto[-1]
    return float(steps[int(np.argmax(gain))] / STEPS)


def fit(counts: DataFrame, labels: DataFrame, keep_share: float = 0.98, seed: int = 7) -> Model:
    """Grow the forests and find their thresholds.

    ``counts`` as :func:`measured` gives them; ``labels`` has doc_id and quality (1 good, 0 bad; of several the
    smallest). All labelled rows that pass the base rules are used: half are those that trees' rows are drawn from, half
    calibrate. Equal rows are drawn once, but each counts in the calibration.
    Without rows labelled good nothing is rejected; without any labelled bad only what is odder than all good ones.
    Labels without doc_id or of other values, and labels of no document, teach nothing; empty tables give no forests.
    """
    grows = F.col("h").bitwiseAND(1 << 7) != 0
    rows = shared.written(taught(counts, labels).withColumn("g", F.xxhash64("doc_id", *COUNTS)), "labelled")
    good = {r["grows"]: r["n"] for r in rows.where("_quality = 1").groupBy(grows.alias("grows")).agg(F.sum("_rows").alias("n")).collect()}
    if sum(good.values()) < 2:
        return Model([], [np.inf, np.inf])
    halved = min(good.get(True, 0), good.get(False, 0)) >= 2
    grow, hold = (rows.where(grows), rows.where(~grows)) if halved else (rows, rows)
    x, places = drawn(grow, grow.count())
    forests = [Forest.grown(group, places, seed) for group in features(x)]
    return Model(forests, [threshold(bad, fine, keep_share) for bad, fine in spread(hold, forests)])


def scored(counts: DataFrame, model: Model) -> DataFrame:
    """``counts`` with ``anomaly`` and ``anomaly_rare``, the forests' scores."""
    sent = shared.shipped(counts.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in COUNTS]) if b.num_rows else np.zeros((0, len(COUNTS)), np.int64)
            style, rare = sent().score(x).T
            yield b.append_column("anomaly", pa.array(style, pa.float64())).append_column("anomaly_rare", pa.array(rare, pa.float64()))

    return counts.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", anomaly double, anomaly_rare double")


def report(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, the base statistics, base_failed, kept and the anomalies; a row per row of ``docs``, repeated ones too.

    Null and empty texts have no words and fail the base rules. Extra columns are not read. An empty table gives none.
    """
    counts = shared.written(measured(docs, doc_id, text), "statistics")
    model = fit(counts, labels, **options)
    failed, style, rare = base_failed(), *map(F.lit, model.thresholds)
    kept = ~failed & (F.col("anomaly") <= style) & (F.col("anomaly_rare") <= rare)
    return scored(counts, model).select("doc_id", *COUNTS[:5], failed.alias("base_failed"), kept.alias("kept"), "anomaly", "anomaly_rare")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))
