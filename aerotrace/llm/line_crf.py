"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are shares of character classes, lengths and repetitions, of the
line itself and of its neighbours before and after; the chain adds a weight for each pair of labels in a
row. The lines of a document get their labels from the document's: all good where it is good;
where it is bad, first all bad, then, once more after a first fit, those the fit takes for bad (one at least). A
document's badness is the mean of the forward-backward marginals of its lines, weighted with their lengths, and a
logistic curve fitted to the labelled documents makes it a score.

The model is fitted on at most ``sample`` labelled documents, those of smallest hash, of at most ``SAMPLE_LINES`` lines
each; every whole text is scored. The fit runs on the driver, on arrays of that bounded size.

Edge cases: a NULL or empty text is one empty line; labels of a repeated doc_id count once, the worst of them; NULL
labels are not used; without labels every score is 0.5; repeated rows are each scored; an empty table gives no row;
other columns are left out; a long text is cut in lines only, a long line is one line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerotrace.llm.common import bytes_of, slices
from aerotrace.llm.word_hash import words

SAMPLE_LINES = 4096
SLICE = 2 << 20
CHAIN = 64

# Classes of bytes, by number. Bytes from 0x80 on count as letters.
LOWERCASE, UPPERCASE, WIDE, DIGIT, BLANK, STOP, PIPE, BANG, SYMBOL, OTHER = range(10)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[128:], CLASS[48:58] = LOWERCASE, UPPERCASE, WIDE, DIGIT
for _chars, _class in ((b" \t\r\x0b\x0c", BLANK), (b".,;:?'\"()-", STOP), (b"|", PIPE), (b"!", BANG), (b"#$%&*+/<=>@[\\]^_`{}~", SYMBOL)):
    CLASS[list(_chars)] = _class
OWN = 17


@dataclass(frozen=True)
class Lines:
    """Features of a batch's lines, the lines of each document, and each line's length in bytes."""

    x: np.ndarray
    count: np.ndarray
    size: np.ndarray


def line_features(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> Lines:
    newline = raw == 10
    seen = np.concatenate(([0], np.cumsum(newline)))
    count = seen[end] - seen[start] + 1
    at = np.flatnonzero(newline)
    lo, hi = np.sort(np.concatenate((start, at + 1))), np.sort(np.concatenate((at, end)))
    size, n = hi - lo, len(lo)
    counts = np.bincount(np.repeat(np.arange(n) * 10, size) + CLASS[raw[~newline]], minlength=10 * n).reshape(n, 10).astype(np.float32)
    x = np.zeros((n, OWN), np.float32)
    x[:, 0] = 1
    x[:, 1:11] = counts / np.maximum(1, size)[:, None]
    w = words(raw, lo, np.where(lo < hi, hi, lo))
    line = np.searchsorted(lo, w.start, side="right") - 1
    per = np.bincount(line, minlength=n)
    same = np.bincount(line[1:][(w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])], minlength=n)
    x[:, 11] = same / np.maximum(1, per - 1)
    x[:, 12] = np.log1p(size) / 8
    x[:, 13] = np.minimum(4, np.where(per, (size - counts[:, BLANK]) / np.maximum(1, per), 0) / 8)
    closing = np.zeros(n, bool)
    full = size > 0
    closing[full] = np.isin(raw[hi[full] - 1], list(b".?\"'"))
    x[:, 14] = closing
    x[:, 15] = size == 0
    letters = counts[:, LOWERCASE] + counts[:, UPPERCASE]
    x[:, 16] = counts[:, UPPERCASE] / np.maximum(1, letters)
    doc = np.repeat(np.arange(len(count)), count)
    prev, nxt = np.zeros_like(x), np.zeros_like(x)
    if n > 1:
        joined = (doc[1:] == doc[:-1])[:, None]
        prev[1:], nxt[:-1] = x[:-1] * joined, x[1:] * joined
    return Lines(np.hstack((x, prev, nxt)), count, size)


def marginals(unary: np.ndarray, pair: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of bad for each line, expected label pairs in all, and log partition of each chain.

    ``unary`` holds each line's weight of bad over good; the chains lie one after the other, ``count`` lines each. All chains advance together.
    """
    first = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    first, longest = first[order], count[order]
    active = np.searchsorted(-longest, -np.arange(1, (longest[0] if len(longest) else 0) + 1), side="right")
    n = len(unary)
    ahead, back, scale = np.zeros((n, 2)), np.ones((n, 2)), np.zeros(n)
    local = np.exp(np.stack((np.zeros(n), np.clip(unary, -30, 30)), 1))
    step = np.exp(pair)
    for t, m in enumerate(active):
        i = first[:m] + t
        a = local[i] if t == 0 else (ahead[i - 1] @ step) * local[i]
        s = a.sum(1)
        ahead[i], scale[i] = a / s[:, None], np.log(s)
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        i = first[:active[t]] + t
        b = local[i] * back[i]
        b /= b.sum(1)[:, None]
        joint = ahead[i - 1][:, :, None] * step * b[:, None, :]
        pairs += (joint / joint.sum((1, 2))[:, None, None]).sum(0)
        back[i - 1] = b @ step.T
    p = ahead * back
    return p[:, 1] / p.sum(1), pairs, np.add.reduceat(scale, np.sort(first)) if n else np.zeros(0)


@dataclass(frozen=True)
class LineModel:
    weights: np.ndarray
    pair: np.ndarray
    slope: float
    offset: float

    def badness(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean probability of bad of each document."""
        if not len(lines.count):
            return np.zeros(0)
        p = marginals(lines.x @ self.weights, self.pair, lines.count)[0]
        weight, first = lines.size + 1.0, np.cumsum(lines.count) - lines.count
        return np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first)

    def score(self, lines: Lines) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * self.badness(lines), -30, 30)))


def _chains(count: np.ndarray) -> np.ndarray:
    """Lines of each chain when long documents are cut for training."""
    return np.concatenate([[CHAIN] * (c // CHAIN) + ([c % CHAIN] if c % CHAIN else []) for c in count.tolist()]).astype(np.int64)


def _fit_chain(x: np.ndarray, y: np.ndarray, count: np.ndarray, rounds: int = 60, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights by Adam on the mean log-likelihood of the lines' labels, over features brought to one scale."""
    chains, n = _chains(count), len(x)
    mean, spread = x.mean(0), x.std(0)
    mean[0], spread = 0.0, np.where(spread > 1e-6, spread, 1.0)
    x = (x - mean) / spread
    starts = np.cumsum(chains) - chains
    inside = np.ones(n, bool)
    inside[starts] = False
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[np.flatnonzero(inside) - 1].astype(int), y[inside].astype(int)), 1)
    w, pair = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for t in range(1, rounds + 1):
        p, pairs, _ = marginals(x @ w, pair, chains)
        g = np.concatenate((x.T @ (p - y) / n + l2 * w, ((pairs - seen_pairs) / n + l2 * pair).ravel()))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) / t**0.25
        w, pair = w - step[:-4], pair - step[-4:].reshape(2, 2)
    w = w / spread
    w[0] -= mean @ w
    return w, pair


def fit_lines(lines: Lines, good: np.ndarray) -> LineModel:
    """Fits to the lines of documents labelled good (1) or bad (0)."""
    bad = np.repeat(1.0 - good, lines.count)
    y, first = bad, np.cumsum(lines.count) - lines.count
    x = lines.x.astype(np.float64)
    w, pair = _fit_chain(x, y, lines.count)
    p = marginals(x @ w, pair, lines.count)[0]
    worst = np.repeat(np.maximum.reduceat(p, first), lines.count)
    y = np.where(bad > 0, ((p > 0.5) | (p >= worst)).astype(float), 0.0)
    w, pair = _fit_chain(x, y, lines.count)
    model = LineModel(w, pair, 0.0, 0.0)
    b = model.badness(lines)
    slope, offset = _logistic(b, good)
    return LineModel(w, pair, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps."""
    a, theta = np.stack((x, np.ones(len(x))), 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        theta = theta - np.linalg.solve(h, a.T @ (p - y) + ridge * theta)
    return float(theta[0]), float(theta[1])


def labelled_ids(labels: DataFrame, label: str, allowed: Column, sample: int) -> DataFrame:
    """doc_id and label of the ``sample`` labelled documents of smallest hash; a repeated one counts once, with its smallest label."""
    return (labels.filter(allowed & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", sample: int = 4000) -> LineModel | None:
    """A model fitted to the documents that have a label and are allowed; None without any."""
    chosen = labelled_ids(labels, label, allowed, sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                lines = line_features(*bytes_of(batch.column("text")))
                at = np.cumsum(lines.count) - lines.count
                keep = np.flatnonzero(lines.count <= SAMPLE_LINES)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column("label"))[keep], pa.int32()),
                                                  pa.array([lines.x[at[i]:at[i] + lines.count[i]].astype("<f4").tobytes() for i in keep], pa.binary()),
                                                  pa.array([lines.size[at[i]:at[i] + lines.count[i]].astype("<i8").tobytes() for i in keep], pa.binary())], ["label", "x", "size"])

    rows = joined.mapInArrow(run, "label int, x binary, size binary").limit(2 * sample).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (bytes(r["x"]), r["label"]))
    x = [np.frombuffer(r["x"], "<f4").reshape(-1, 3 * OWN) for r in rows]
    lines = Lines(np.concatenate(x), np.array([len(a) for a in x]), np.concatenate([np.frombuffer(r["size"], "<i8") for r in rows]))
    return fit_lines(lines, np.array([float(r["label"] > 0) for r in rows]))


def score(docs: DataFrame, model: LineModel | None, carry: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """The columns ``carry`` of every row and, as ``out``, its score, the probability that its label is 1."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                s = model.score(line_features(*bytes_of(batch.column("text")))) if model else np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(s, pa.float64())], [*carry, out])

    return docs.select(*dict.fromkeys((*carry, "text"))).mapInArrow(run, f"{schema}, `{out}` double")
