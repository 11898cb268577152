"""Toxicity: boosted trees over dense lexical features, calibrated by isotonic regression.

Features of a whole text: densities of a general and a learned lexicon, how
near lexicon words stand to second-person words, and rates of capitals,
punctuation, exclamation and obfuscated words (letters mixed with digits or
symbols). The learned lexicon holds the words whose documents are toxic far
more often than others'; it, the trees and the calibration are fitted on a
bounded sample of labelled documents (``sample``; the first by the hash of
the id), never on held-out rows. Labels, language, source and id are no input
of a score.

Defined results: null and empty texts are scored on zero features; a null id
counts as not held out and is never learnt from; without labelled rows of
both classes the score is the share of toxic labels (0 without any); repeated
rows each give a row; extra columns of the inputs are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbt
from .common import add_columns, pick, table
from .quality import sampled

# Words of abuse, and second-person words of the four languages.
GENERAL = frozenset("idiot idiots moron morons stupid pathetic scum trash loser losers worthless disgusting clown clowns dumb garbage filthy hate vermin imbecile fool jerk ugly disgrace freak kill die shut vile".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti vuestro".split())
FEATURES = ("learned_density", "learned_hits", "learned_weight", "general_density", "general_hits", "near_second_person", "second_person_density", "upper_rate", "punct_rate", "exclaim_rate", "obfuscated_rate", "folded_hits", "log_words")
RISING = ("learned_density", "learned_hits", "learned_weight", "general_density", "general_hits", "folded_hits")
#: Words between a lexicon word and a second-person word that still count as near.
NEAR = 5
#: Lengths in bytes of the stems that a lexicon may hold.
STEMS = (5, 7)
_STRIP = b".,;:!?\"'()[]{}<>*#$%&|-_~`"
_FOLD = bytes.maketrans(b"013457@$!|", b"oieastasil")
_DROP = b"*.-_#"


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without punctuation around them."""
    return [w for w in (x.strip(_STRIP) for x in text.lower().encode("utf-8", "surrogatepass").split()) if w]


def stems_of(word: bytes) -> list[bytes]:
    """The word's stems, as they stand in a lexicon: abuse is inflected, so stems generalise to unseen forms."""
    return [b"^" + word[:k] for k in STEMS if len(word) > k]


@dataclass(frozen=True)
class Lexicon:
    """Learned words and stems with their log-odds weights."""

    weight: dict[bytes, float]

    def weight_of(self, word: bytes) -> float:
        """The largest weight of the word and its stems, 0 if the lexicon has none."""
        return max((self.weight.get(u, 0.0) for u in (word, *stems_of(word))), default=0.0)

    def features(self, text: str) -> list[float]:
        raw = text.encode("utf-8", "surrogatepass")
        words = words_of(text)
        n = max(1, len(words))
        learned, general, person, weight, folded, odd = [], 0, [], 0.0, 0, 0
        known: dict[bytes, float] = {}
        for i, w in enumerate(words):
            own = known.get(w)
            if own is None:
                own = known[w] = self.weight_of(w)
            if own:
                learned.append(i)
                weight += own
            elif not w.isalpha() and w.isascii():
                odd += 1
                plain = w.translate(_FOLD, _DROP)
                folded += plain in self.weight or plain in _GENERAL
            if w in _GENERAL:
                general += 1
                if not own:
                    learned.append(i)
            elif w in _PERSON:
                person.append(i)
        near = 0
        if person and learned:
            at = np.searchsorted(person, learned)
            spots = np.array([-(10**6), *person, 10**9])
            gap = np.minimum(spots[at + 1] - learned, np.array(learned) - spots[at])
            near = int((gap <= NEAR).sum())
        letters = np.frombuffer(raw, np.uint8)
        size = max(1, len(raw))
        upper = int(((letters >= 65) & (letters <= 90)).sum())
        punct = sum(raw.count(c) for c in (b".", b",", b";", b":", b"'", b'"', b"(", b")", b"-"))
        hits = sum(1 for i in learned if known[words[i]])
        return [hits / n, float(hits), weight, general / n, float(general), float(near), len(person) / n, upper / size, punct / size, (raw.count(b"!") + raw.count(b"?")) / n, odd / n, float(folded), float(np.log1p(len(words)))]


_GENERAL = frozenset(w.encode() for w in GENERAL)
_PERSON = frozenset(w.encode() for w in SECOND_PERSON)


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    forest: gbt.Forest
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.lexicon.features(t or "") for t in texts], dtype=float).reshape(-1, len(FEATURES))
        if not len(self.forest.feature):
            return np.full(len(x), self.prior)
        return np.clip(gbt.calibrated(self.forest.margin(x), self.knots), 0.0, 1.0)


def is_held_out(doc_id) -> F.col:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_lexicon(texts: list[str], label: np.ndarray, *, least: int, size: int) -> dict[bytes, float]:
    """Words and stems in at least ``least`` toxic texts whose share among toxic texts is far above that among others."""
    counts: dict[bytes, list[int]] = {}
    for text, y in zip(texts, label):
        own = set(words_of(text))
        for w in own.union(*map(stems_of, own)):
            counts.setdefault(w, [0, 0])[int(y)] += 1
    pos, neg = float(label.sum()), float(len(label) - label.sum())
    found = {}
    for w, (b, a) in counts.items():
        if a >= least:
            odds = np.log((a + 0.1) / (pos + 1)) - np.log((b + 0.1) / (neg + 1))
            if odds > (3.0 if w.startswith(b"^") else 2.0):
                found[w] = round(float(odds), 6)
    return dict(sorted(found.items(), key=lambda kv: (-kv[1], kv[0]))[:size])


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 8000, lexicon_size: int = 2000, trees: int = 80, depth: int = 3) -> ToxicityModel:
    """Fit on at most ``sample`` labelled documents that are not held out.

    The sample's texts come to the driver in one column, at most ``sample``
    rows of them. Each half of the sample gets its features from the lexicon
    of the other half, so the trees see the lexicon as new texts do.
    """
    known = pick(labels, doc_id="doc_id", toxic="toxic").where(~is_held_out(F.col("doc_id")))
    rows = sampled(docs, known, "toxic", sample).toPandas()
    rows = rows.assign(text=rows["text"].fillna("")).sort_values(["text", "label"]).reset_index(drop=True)
    texts, y = rows["text"].tolist(), rows["label"].to_numpy(dtype=float)
    prior = float(y.mean()) if len(y) else 0.0
    least = 2 if y.sum() < 200 else 3
    lexicon = Lexicon(learn_lexicon(texts, y, least=least, size=lexicon_size))
    fold = np.array([hash_fold(t) for t in texts], dtype=int)
    x = np.zeros((len(texts), len(FEATURES)))
    for k in (0, 1):
        own = [t for t, f in zip(texts, fold) if f != k]
        other = Lexicon(learn_lexicon(own, y[fold != k], least=least, size=lexicon_size))
        for i in np.flatnonzero(fold == k):
            x[i] = other.features(texts[i])
    monotone = {FEATURES.index(f): 1 for f in RISING}
    how = {"trees": trees, "depth": depth, "monotone": monotone}
    out = np.zeros(len(texts))
    for k in (0, 1):
        if (fold != k).any() and (fold == k).any():
            out[fold == k] = gbt.fit(x[fold != k], y[fold != k], **how).margin(x[fold == k])
    forest = gbt.fit(x, y, **how)
    return ToxicityModel(lexicon, forest, gbt.isotonic(out, y), prior)


def hash_fold(text: str) -> int:
    """Half of the sample that a text belongs to; copies of a text share it."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & 1


def score(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    own = pick(docs, doc_id="doc_id", text="text").select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = add_columns(own, lambda texts: {"score": model.scores(texts)}, "score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; nulls, repeats and empty tables as the module states."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
