"""Toxicity of documents whose words may be disguised.

A noisy channel explains how a plain word becomes a disguised one: letters turn into look-alike digits and signs, are
spaced out, or are repeated. The characters of a suspicious run form a lattice of the letters they may stand for and of the
places where a word may end: at a sign, and between any two characters of a spaced passage. A Viterbi
search finds the path that the channel and a character language model find likeliest together. The language model is
counted over all documents. Every word of the path, and the run read as one word, is then scored like any other.

A term is a word or the beginning of one. Its evidence is the log-odds of the toxic label among the labelled documents that hold it,
shrunk to the share of all. A document's features are its strongest evidences, and a logistic model of
them, fitted on documents whose labels did not go into the evidence, makes its score.

Terms and weights are learned from at most ``sample`` labelled documents, those of smallest hash; the language model from all texts;
every whole text is scored.

Edge cases: a NULL or empty text has no word, and its score is the model's offset; without labels of both kinds every score is 0; labels of a
repeated doc_id count once, the larger; repeated rows are each scored; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerotrace.llm.common import bytes_of, slices, texts_of

MEMO = 1_000_000
BEGINNINGS = (3, 4, 5, 6)
SHRINK = 4.0
STRONG = 2.0  # evidence that a joined pair of words needs
TOP = 4
SHORT = 64  # characters of a word whose beginnings or evidences are kept by word

# Letters that a sign may stand for, and the cost of each reading in nats.
LOOKALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
             "£": "l", "(": "c", "<": "c", "¡": "i", "%": "o", "&": "a", "#": "h", "¢": "c", "*": "aeiou", "?": "aeiou"}
SWAP, DROP, SHORTEN = 1.0, 0.3, 0.2
EDGE = re.compile(r"^[\s\"'(\[{<.,;:!?_*~`\-]+|[\s\"')\]}>.,;:!?_~`\-]+$|([#$%&*+=|])\1{2,}$|^([#$%&*+=|])\2{2,}")
SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
DOUBLE = re.compile(r"(.)\1")
ALIKE = re.compile(r"(.)\1{4,}", re.DOTALL)  # no word holds one letter five times in a row

# Symbols of the language model: 0 no letter, 1..26 a-z, 27 a byte of another letter.
SYMBOL = np.zeros(256, np.int32)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[128:] = 27
BITS = 5
SPACE_AT = (1 << BITS) - 1  # zero in the last symbol: a word has ended, or none has begun


def symbols(word: str) -> list[int]:
    return SYMBOL[np.frombuffer(word.encode(), np.uint8)].tolist()


def ngram_counts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and counts of the symbol 4-grams in these bytes."""
    if len(raw) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = SYMBOL[raw]
    grams = (c[:-3] << 3 * BITS) | (c[1:-2] << 2 * BITS) | (c[2:-1] << BITS) | c[3:]
    counts = np.bincount(grams, minlength=1 << 4 * BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """4-gram counts over all texts; the table has 2^20 cells at any size of the corpus, which go to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 4 * BITS, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                at, n = ngram_counts(bytes_of(batch.column("text"))[0])
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32), pa.int32()), pa.array(total[at], pa.int64())], ["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 4 * BITS)
    out[np.asarray(rows["gram"])] = np.asarray(rows["n"])
    return out


def language_model(counts: np.ndarray, lexicon: list[str], weight: float = 0.02) -> np.ndarray:
    """Log-probability of each symbol after the three before it; ``lexicon`` words add that share of the counts each kind of word has."""
    counts = counts.copy()
    share = weight * max(1.0, counts.sum()) / max(1, sum(len(w) + 1 for w in lexicon))
    for w in lexicon:
        s = [0, 0, 0, *symbols(w), 0]
        for i in range(len(s) - 3):
            counts[(s[i] << 3 * BITS) | (s[i + 1] << 2 * BITS) | (s[i + 2] << BITS) | s[i + 3]] += share
    n4 = counts.reshape(-1, 1 << BITS)
    n3 = counts.reshape(1 << BITS, -1, 1 << BITS).sum(0)
    n2 = n3.reshape(1 << BITS, -1, 1 << BITS).sum(0)
    p1 = (n2.sum(0) + 1) / (n2.sum() + (1 << BITS))
    p2 = (n2 + 8 * p1) / (n2.sum(1, keepdims=True) + 8)
    p3 = (n3 + 8 * np.tile(p2, (1 << BITS, 1))) / (n3.sum(1, keepdims=True) + 8)
    p4 = (n4 + 8 * np.tile(p3, (1 << BITS, 1))) / (n4.sum(1, keepdims=True) + 8)
    return np.log(p4).astype(np.float32).ravel()


def readings(c: str) -> list[tuple[str, float]]:
    """Letters a character may stand for, each with the channel's cost; an empty string means that it is dropped."""
    if c.isalpha():
        return [(c, 0.0)]
    out = [(x, SWAP) for x in LOOKALIKE.get(c, "")]
    return out if c.isdigit() and out else [*out, ("", DROP)]


@lru_cache(maxsize=4096)
def _read(c: str) -> tuple[tuple[str, float, tuple[int, ...]], ...]:
    return tuple((letter, price, tuple(symbols(letter))) for letter, price in readings(c))


_costs: list = [None, []]


def symbol_costs(model: np.ndarray) -> list[float]:
    """The model's negative logarithms as plain numbers, made once for each model a worker uses."""
    if _costs[0] is not model:
        _costs[:] = model, (-model.astype(np.float64)).tolist()
    return _costs[1]


def segment(run: str, model: np.ndarray, ends: bool = True, gaps: bool = False) -> list[str]:
    """The likeliest plain words behind a run of characters.

    With ``ends`` a word may end at a sign that the channel drops, with ``gaps`` after any character; else the run is one word. A word is as likely after a word end as at the beginning.
    """
    costs, keep, begin = symbol_costs(model), (1 << 3 * BITS) - 1, (0, "")
    # (last three symbols, last letter) -> cost, path; a path is the letter and the path before it
    state: dict[tuple[int, str], tuple[float, tuple | None]] = {begin: (0.0, None)}
    for c in ALIKE.sub(lambda m: m.group()[:4], run.lower()):
        nxt: dict[tuple[int, str], tuple[float, tuple | None]] = {}
        get, read = nxt.get, _read(c)
        for key, (cost, path) in state.items():
            past, last = key
            for letter, price, codes in read:
                base = cost + price
                if letter:
                    p, total = past, base
                    for s in codes:
                        p = (p << BITS) | s
                        total += costs[p]
                        p &= keep
                    to = (p, letter)
                    old = get(to)
                    if old is None or total < old[0]:
                        nxt[to] = (total, (letter, path))
                    if letter == last:  # one letter, held
                        total, old = base + SHORTEN, get(key)
                        if old is None or total < old[0]:
                            nxt[key] = (total, path)
                    continue
                old = get(key)
                if old is None or base < old[0]:
                    nxt[key] = (base, path)
                if ends and past & SPACE_AT:
                    total, old = base + costs[past << BITS], get(begin)
                    if old is None or total < old[0]:
                        nxt[begin] = (total, (" ", path))
        if gaps:
            for (past, _), (cost, path) in list(nxt.items()):
                if past & SPACE_AT:
                    total, old = cost + costs[past << BITS], get(begin)
                    if old is None or total < old[0]:
                        nxt[begin] = (total, (" ", path))
        state = nxt
    end = [(cost + (costs[past << BITS] if past & SPACE_AT else 0.0), path) for (past, _), (cost, path) in state.items()]
    path, out = min(end, key=lambda e: e[0])[1] if end else None, []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out)).split()


def restore(run: str, model: np.ndarray) -> str:
    """The likeliest plain word behind a run of characters."""
    return "".join(segment(run, model, ends=False))


def suspicious(word: str) -> bool:
    """Whether a word holds a sign or digit beside letters, or a letter twice in a row."""
    return not word.isalpha() and any(c.isalpha() or c in LOOKALIKE for c in word) or DOUBLE.search(word) is not None


def trim(run: str) -> str:
    """A run in lower case without the stops, brackets and rows of signs at its ends."""
    run = run.lower()
    while True:
        cut = EDGE.sub("", run)
        if cut == run:
            return run
        run = cut


def terms(word: str) -> list[str]:
    """The word itself and its beginnings, the longest first."""
    return ["=" + word, *("^" + word[:n] for n in reversed(BEGINNINGS) if len(word) > n)]


def raised(found: list[float], e: float) -> list[float]:
    """The evidences with ``e``, another reading of the same run, in place of the largest if it is larger."""
    if e <= max(found, default=0.0):
        return found
    return [e, *sorted(found, reverse=True)[1:]]


@dataclass(frozen=True)
class ToxicityModel:
    """Evidence by term, weights of the document features (the last is the offset), and the language model."""

    evidence: dict[str, float]
    weights: np.ndarray
    letters: np.ndarray


class Reader:
    """Evidence of the words of a text, kept by word for as long as a worker lives."""

    def __init__(self, evidence: dict[str, float], letters: np.ndarray):
        self.evidence, self.letters, self.known = evidence, letters, _Known(self)
        strong = [t[1:] for t, e in evidence.items() if t[0] == "=" and e >= STRONG]
        self.heads = {w[:i] for w in strong for i in range(2, min(len(w) - 1, SHORT + 1))}
        self.long = sorted(w for w in strong if len(w) > SHORT)

    def head(self, run: str) -> bool:
        """Whether a strong word of two letters more begins with the run."""
        if len(run) <= SHORT:
            return run in self.heads
        at = bisect_left(self.long, run)
        while at < len(self.long) and self.long[at].startswith(run):
            if len(self.long[at]) > len(run) + 1:
                return True
            at += 1
        return False

    def of_plain(self, word: str) -> float:
        """Of the word if it is known, else of its longest known beginning."""
        for t in terms(word):
            e = self.evidence.get(t)
            if e is not None:
                return e
        return 0.0

    def restored(self, run: str, gaps: bool = False) -> list[float]:
        """Positive evidences of the words behind a disguised run, which may also be one word."""
        words = segment(run, self.letters, gaps=gaps)
        out = [e for e in map(self.of_plain, words) if e > 0]
        return raised(out, self.of_plain(restore(run, self.letters))) if len(words) > 1 else out

    def of_run(self, run: str) -> tuple[float, ...]:
        """Positive evidences of a run between spaces: one, or one for each word that signs part."""
        word = trim(run)
        if not word:
            return ()
        return tuple(raised(self.restored(word) if suspicious(word) else [], self.of_plain(word)))

    def text(self, text: str) -> list[float]:
        """The strongest evidences of the words in the text's different runs, strongest first."""
        runs = text.split()
        unlike = set(runs)
        found = [e for es in map(self.known.__getitem__, unlike) for e in es]
        for m in SPACED.finditer(text):
            found += self.restored("".join(m.group().split()), gaps=True)
        if not self.heads.isdisjoint(unlike) or self.long and any(map(self.head, unlike)):
            for a, b in zip(runs, runs[1:], strict=False):
                if self.head(a) and len(b) > 1 and not self.known[b]:
                    found.append(e if (e := self.evidence.get("=" + trim(a + b), 0.0)) >= STRONG else 0.0)
        found.sort(reverse=True)
        return found

    def features(self, text: str) -> np.ndarray:
        e = self.text(text)
        top = (e + [0.0] * TOP)[:TOP]
        return np.array([*top, top[0] ** 2 / 4, np.log1p(sum(x for x in e if x >= STRONG)), np.log1p(len(text)) / 8, 1.0])


class _Known(dict):
    def __init__(self, reader: Reader):
        super().__init__()
        self.reader = reader

    def __missing__(self, run: str) -> tuple[float, ...]:
        e = self.reader.of_run(run)
        if len(self) < MEMO and len(run) <= SHORT:
            self[run] = e
        return e


def _chosen(labels: DataFrame, label: str, allowed: Column, sample: int) -> DataFrame:
    return (labels.filter(allowed & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")))


def term_counts(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of each half that hold a term, toxic and in all: (half, term, toxic, n); and the documents of each half."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                toxic, n = Counter(), Counter()
                for half, y, text in zip(batch.column("half").to_pylist(), batch.column("label").to_pylist(), texts_of(batch.column("text")), strict=True):
                    words = {trim(r) for r in set(text.split())} - {""}
                    held = {(half, t) for w in words for t in terms(w)}
                    n.update(held)
                    if y > 0:
                        toxic.update(held)
                keys = list(n)
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in keys], pa.int32()), pa.array([t for _, t in keys], pa.string()),
                                                  pa.array([toxic[k] for k in keys], pa.int64()), pa.array([n[k] for k in keys], pa.int64())], ["half", "term", "toxic", "n"])

    counted = labelled.select("half", "label", "text").mapInArrow(run, "half int, term string, toxic long, n long")
    return counted.groupBy("half", "term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")), labelled.groupBy("half").agg(F.sum((F.col("label") > 0).cast("long")).alias("toxic"), F.count("*").alias("n"))


def evidence_of(rows: list[tuple[str, int, int]], toxic: int, n: int, least: int) -> dict[str, float]:
    """Evidence of terms held by ``least`` documents or more."""
    base = np.log(toxic / (n - toxic))
    share = toxic / n
    out = {}
    for term, t, held in rows:
        if held >= least:
            p = (t + SHRINK * share) / (held + SHRINK)
            out[term] = float(np.log(p / (1 - p)) - base)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    theta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(theta))
        theta = theta - np.linalg.solve(h, x.T @ (p - y) + ridge * theta)
    return theta


def _features(docs: DataFrame, evidence: dict[str, float], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of labelled documents; their number is bounded by the sample."""
    shared = docs.sparkSession.sparkContext.broadcast((evidence, letters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                f = [reader.features(t).tolist() for t in texts_of(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(f, pa.list_(pa.float64()))], ["label", "f"])

    rows = docs.select("label", "text").mapInArrow(run, "label int, f array<double>").collect()
    rows.sort(key=lambda r: (r["label"], r["f"]))
    return np.array([r["f"] for r in rows]).reshape(len(rows), -1), np.array([float(r["label"] > 0) for r in rows])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", sample: int = 12_000, most_terms: int = 200_000) -> ToxicityModel | None:
    """A model fitted to the allowed labelled documents; None unless both halves of them hold both labels.

    Of the terms that two documents or more hold, the ``most_terms`` held most often are kept with their evidence.
    """
    chosen = _chosen(labels, label, allowed, sample)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of three numbers
    counts, sizes = term_counts(labelled)
    size = {r["half"]: (r["toxic"], r["n"]) for r in sizes.collect()}
    if len(size) < 2 or any(not 0 < t < n for t, n in size.values()):
        return None
    wide = (counts.groupBy("term").agg(*[F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("toxic", "n")])
            .filter("(toxic0 + toxic1) * 3 > n0 + n1 and n0 + n1 > 1").orderBy(F.desc(F.col("n0") + F.col("n1")), "term").limit(most_terms).toArrow())
    cols = {c: wide[c].to_pylist() for c in wide.column_names}
    both = list(zip(cols["term"], (a + b for a, b in zip(cols["toxic0"], cols["toxic1"], strict=True)), (a + b for a, b in zip(cols["n0"], cols["n1"], strict=True)), strict=True))
    whole = evidence_of(both, size[0][0] + size[1][0], size[0][1] + size[1][1], 2)
    lexicon = sorted(t[1:] for t, e in whole.items() if t[0] == "=" and e >= STRONG)
    letters = language_model(corpus_counts(docs), lexicon)
    halves = []
    for h in (0, 1):  # evidence of one half, features of the other
        rows = list(zip(cols["term"], cols[f"toxic{h}"], cols[f"n{h}"], strict=True))
        halves.append(_features(labelled.filter(F.col("half") == 1 - h), evidence_of(rows, *size[h], 2), letters))
    weights = _logistic(np.concatenate([x for x, _ in halves]), np.concatenate([y for _, y in halves]))
    return ToxicityModel(whole, weights, letters)


def score(docs: DataFrame, model: ToxicityModel | None, carry: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """The columns ``carry`` of every row and, as ``out``, its score, the probability of the toxic label."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = Reader(m.evidence, m.letters) if m else None
        for whole in batches:
            for batch in slices(whole, "text"):
                if reader:
                    f = np.array([reader.features(t) for t in texts_of(batch.column("text"))])
                    s = 1 / (1 + np.exp(-np.clip(f @ m.weights, -30, 30)))
                else:
                    s = np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(s, pa.float64())], [*carry, out])

    return docs.select(*dict.fromkeys((*carry, "text"))).mapInArrow(run, f"{schema}, `{out}` double")
