"""URL filter: explicit rules first, then logistic regression on hashed character n-grams.

The host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased; the path is what follows up to ``?``, ``#`` or the end. A NULL url, or one without ``://``,
has an empty host and path. A rule names a host and the start of a path; it fits that host and its
subdomains, and the longest rule that fits decides. Where none fits, the model does: the n-grams
of host and path are hashed into a fixed number of slots, and the URL is blocked from probability 0.5
on.

Edge cases: an empty host and path has no n-gram, so the model allows it; an empty table gives no row;
repeated rows are judged alike; other columns are left out, whatever their names. The labelled table
must hold both labels. It goes whole to the driver and is refused beyond ``MOST_LABELLED`` rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LABELLED = 100_000
SIZES = (3, 4, 5)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Host of a URL; empty without one."""
    rest = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Path of a URL; empty without one."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; NULL where none does."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda x: len(x.text)):  # a later, longer one takes precedence
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def slots_of(host: str, path: str, bits: int) -> np.ndarray:
    """Slots of the n-grams of host and path, each once."""
    out = set()
    for mark, part in ((b"h", host), (b"p", path)):
        if part:
            b = b"^" + part.encode() + b"$"
            out.update(zlib.crc32(mark + b[i:i + n]) & ((1 << bits) - 1) for n in SIZES for i in range(len(b) - n + 1))
    return np.fromiter(sorted(out), np.int64, len(out))


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float
    bits: int

    def probability(self, host: str, path: str) -> float:
        """Probability that the URL is to be blocked."""
        at = slots_of(host, path, self.bits)
        z = self.bias + (self.weights[at].sum() / np.sqrt(len(at)) if len(at) else 0.0)
        return float(1 / (1 + np.exp(-z)))


def train(labelled: DataFrame, bits: int = 18, l2: float = 1e-5, rounds: int = 300, rate: float = 0.5, prior: float = 0.1) -> UrlModel:
    """Fits the model to (url, label), label 1 for block, by full-batch Adam.

    Both labels weigh the same in the fit, whatever their numbers; ``prior``, the share of URLs expected to be unwanted, then
    moves the log-odds, so that a URL without evidence is allowed.
    """
    rows = labelled.select(host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"), F.col("label").cast("int")).dropna().limit(MOST_LABELLED + 1).collect()
    y = np.array([r["label"] for r in rows], float)
    if len(rows) > MOST_LABELLED or not 0 < y.sum() < len(y):
        raise ValueError(f"the labelled table needs both labels and at most {MOST_LABELLED} rows")
    at = [slots_of(r["h"], r["p"], bits) for r in rows]
    flat, doc = np.concatenate(at), np.repeat(np.arange(len(at)), [len(a) for a in at])
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(doc, minlength=len(at))))
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b, m, v = np.zeros(1 << bits), 0.0, np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(doc, w[flat], len(at)) * scale + b
        err = share * (1 / (1 + np.exp(-z)) - y)
        g = np.append(np.bincount(flat, (err * scale)[doc], 1 << bits) + l2 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) / t**0.5
        w, b = w - step[:-1], b - step[-1]
    return UrlModel(w, float(b + np.log(prior / (1 - prior))), bits)


def judge(pages: DataFrame, rules: Sequence[Rule], model: UrlModel) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's ``block_probability`` of every row."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    kind = pages.schema["page_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [model.probability(h, q) for h, q in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, "block_probability"])

    scored = pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(score, f"page_id {kind}, host string, path string, block_probability double")
    own = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "block_probability")
