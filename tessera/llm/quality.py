"""Quality rules: boosted trees over document statistics with monotone constraints.

Words are maximal runs of anything but ASCII white space. A document is
rejected by the base rule (too few words, or too many repeated words) or by
the trees. The trees are fitted on a bounded sample of labelled documents
(``sample``, by the hash of the id, so the same at every run) and score every
document as a whole.

Defined results: a null text is an empty one (no words, base rule fails); a
document without a label is scored like any other; without labelled rows of
both classes only the base rule decides; repeated rows each give a row; null
ids are kept; extra columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbt
from .common import add_columns, keep_rows, numbered, pick, table

FEATURES = ("log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "punct_rate", "exclaim_rate", "distinct_rate", "line_length", "lone_symbol_rate")
#: More of these never raises the probability of good quality.
FALLING = ("symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "exclaim_rate", "lone_symbol_rate")
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` consecutive words that occur twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = (key * _MIX) ^ (key >> np.uint64(29)) ^ (ids[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(key, kind="stable")
    own = key[order]
    same = own[1:] == own[:-1]
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    if not hit.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((edge.cumsum()[:-1] > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts and the features of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    space = sum(raw.count(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
    chars = len(text) - space
    symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    repeat = repeated_words(ids)
    letters = np.frombuffer(raw, np.uint8)
    size = max(1, chars)
    upper = int(((letters >= 65) & (letters <= 90)).sum())
    digit = int(((letters >= 48) & (letters <= 57)).sum())
    exclaim = raw.count(b"!") + raw.count(b"?")
    punct = sum(raw.count(c) for c in (b".", b",", b";", b":", b"'", b'"', b"(", b")", b"-"))
    lone = sum(words.count(c) for c in (b"|", b"#", b"*", b"$", b"&"))
    count = max(1, n)
    features = [np.log1p(n), chars / count, symbols / size, dup_lines / max(1, len(lines)), repeat / count, upper / size, digit / size, punct / size, exclaim / count, len(seen) / count, n / max(1, len(lines)), lone / count]
    return [n, chars, symbols, dup_lines, repeat], [float(v) for v in features]


def sampled(docs: DataFrame, labels: DataFrame, label: str, size: int) -> DataFrame:
    """Texts of at most ``size`` labelled rows, the first by the hash of the id; where ids repeat, by label and text."""
    known = pick(labels, doc_id="doc_id", label=label).where("doc_id is not null and label is not null")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(size)
    joined = pick(docs, doc_id="doc_id", text="text").join(F.broadcast(known), "doc_id")
    return joined.orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.xxhash64("text")).limit(size).select("label", "text")


def learn(chosen: DataFrame, compute: Callable[[list[str | None]], dict], width: int, **how) -> tuple[gbt.Forest, np.ndarray, np.ndarray]:
    """Fit trees to the sample's features on the driver; the same whatever order its rows come in."""
    rows = add_columns(chosen, compute, "features array<double>").toPandas()
    x, y = np.array(rows["features"].tolist(), dtype=float).reshape(-1, width), rows["label"].to_numpy(dtype=float)
    order = np.lexsort((*x.T, y))
    return gbt.fit(x[order], y[order], **how), x[order], y[order]


@dataclass(frozen=True)
class QualityRules:
    """Base rule and trees; ``threshold`` is the least probability of good quality that is kept."""

    forest: gbt.Forest
    threshold: float = 0.4
    min_words: int = 20
    max_repeat_percent: int = 30

    def verdicts(self, texts: list[str | None]) -> dict:
        found = [statistics(t or "") for t in texts]
        counts = np.array([f[0] for f in found], dtype=np.int64).reshape(-1, len(COUNTS))
        score = gbt.sigmoid(self.forest.margin(np.array([f[1] for f in found], dtype=float).reshape(-1, len(FEATURES))))
        failed = (counts[:, 0] < self.min_words) | (100 * counts[:, 4] > self.max_repeat_percent * counts[:, 0])
        kept = ~failed & (score >= self.threshold) if len(self.forest.feature) else ~failed
        return dict(zip(COUNTS, counts.T)) | {"base_failed": failed, "kept": kept, "score": score}


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 6000, trees: int = 80, depth: int = 3, threshold: float = 0.4) -> QualityRules:
    """Fit the trees to ``labels.quality`` (1 is good) on at most ``sample`` labelled documents."""

    def features(texts: list[str | None]) -> dict:
        return {"features": [statistics(t or "")[1] for t in texts]}

    monotone = {FEATURES.index(f): -1 for f in FALLING}
    forest, _, _ = learn(sampled(docs, labels, "quality", sample), features, len(FEATURES), trees=trees, depth=depth, monotone=monotone)
    return QualityRules(forest, threshold)


def judge(docs: DataFrame, rules: QualityRules) -> DataFrame:
    """Every document's counts, base verdict, ``kept`` and score (probability of good quality)."""
    fields = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return add_columns(pick(docs, doc_id="doc_id", text="text"), rules.verdicts, fields)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents; nulls, repeats and empty tables as the module states."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that the rules reject; the columns stay, whatever their names.

    Equal texts go or stay together, a null text is an empty one and goes;
    without labels only the base rule decides.
    """
    rules = train(docs, table(spark, sf_dir, "labels"))
    own, columns = numbered(docs)
    return keep_rows(own, lambda texts: rules.verdicts(texts)["kept"], source=columns["text"]).toDF(*docs.columns)
