"""Language-model scoring by an n-gram trie of Elias-Fano levels, built in shards.

Tokens are words (runs of anything but ASCII white space, A-Z lower-cased) and
one end per text. The model interpolates: p1 is the add-0.1 unigram, and
p_n(w | c) = (count(c w) + mu * p_(n-1)(w | shorter c)) / (count(c) + mu).

Counts cover all training documents and no table of n-grams ever meets on one
machine:

1. Documents are coded once into chunks of about ``chunk_tokens`` tokens
   (local word numbers and 64-bit word hashes) and written to the shared folder,
   in buckets by chunk, so only the answers travel to them.
2. Each chunk sends every shard its distinct words with their training
   counts; a shard sums them and answers every chunk with the totals.
3. In the same way each chunk sends its distinct n-grams, keyed by context and
   next word. A shard builds a trie level of its contexts: sorted contexts,
   monotone pointers to their followers, the followers relative to their
   context, all Elias-Fano coded in memory-mapped arrays, and the quantised
   share of each n-gram in all tokens. It answers each chunk's n-grams by
   successor search.
4. Chunks meet their answers and score whole texts, from the shortest context
   to the longest. How often a context of n - 1 words was continued is the
   count of the n-1-gram one token before, so no context is counted by itself
   and contexts whose hashes meet are not added up.

n-grams are counted within their chunk before they are sent. Contexts are
dealt to shards by hash; those that end with a word of more than a share of
all tokens (at most ``HOT`` * shards words can), or begin a text, are dealt by
context and next word, so no shard gets all followers of a frequent context at
any level. See ``chunk_size`` for the number of packets. Everything but the
coded chunks and unigram answers is recomputed if an executor is lost.

Defined results: a null text is empty, an empty text is the one end token;
repeated rows each give a row; null ids are trained on and not held out;
without training text (N = 0) the unigram is uniform over one unseen token;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, materialize, materialize_buckets, pick, pieces, source_bytes, table
from .elias_fano import EliasFano, mapped

ORDER = 3
#: Bits of the hash of a context, and of that of a word, that tell n-grams apart within a shard; a shard has about two million of them at any size of the input.
PART = 28
CHUNK_TOKENS = 500_000
#: Tokens of a chunk of the model: the more, the fewer distinct n-grams are sent.
MODEL_TOKENS = 2_000_000
SHARD_BYTES = 8 << 20
#: A word is hot if it is more than 1 / (HOT * shards) of all tokens.
HOT = 4
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_U = np.uint64
#: Codes of probabilities: 0 is none, else a log10 from FLOOR to 0 in even steps.
FLOOR, STEPS = -14.0, 65534


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit hash."""
    x = np.asarray(x, _U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        code = np.rint((np.log10(p) - FLOOR) / -FLOOR * STEPS)
    return np.where(p > 0, np.clip(code, 0, STEPS) + 1, 0).astype("<u2")


def dequantise(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((code.astype(float) - 1) / STEPS * -FLOOR + FLOOR), 0.0)


class Trie:
    """One shard's contexts and followers; ``value`` holds the quantised share of each n-gram in all tokens."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tokens: int):
        """keys: sorted, context << PART | follower, with their counts."""
        context = keys >> _U(PART)
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(keys) else np.zeros(0, np.int64)
        own = context[first]
        size = np.diff(np.r_[first, len(keys)])
        self.contexts = EliasFano(own, 1 << PART)
        self.pointers = EliasFano(np.r_[first, len(keys)], len(keys) + 1)
        number = np.repeat(np.arange(len(own), dtype=_U), size)
        self.followers = EliasFano(number << _U(PART) | keys & _U((1 << PART) - 1), max(1, len(own)) << PART)
        self.value = mapped(quantise(counts / max(1, tokens)))

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Codes of each n-gram's share, 0 if unseen."""
        keys = np.asarray(keys, _U)
        value = np.zeros(len(keys), "<u2")
        context = self.contexts.find(keys >> _U(PART))
        known = np.flatnonzero(context >= 0)
        if len(known):
            c = context[known]
            low, high = self.pointers.get(c).astype(np.int64), self.pointers.get(c + 1).astype(np.int64)
            at = self.followers.find(c.astype(_U) << _U(PART) | keys[known] & _U((1 << PART) - 1), low, high)
            value[known[at >= 0]] = self.value[at[at >= 0]]
        return value


def squeeze(array: np.ndarray) -> bytes:
    """The array's bytes by significance, compressed: small numbers and sorted ones shrink."""
    planes = np.ascontiguousarray(array).view("u1").reshape(len(array), -1).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def expand(data: bytes, kind: str) -> np.ndarray:
    size, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(planes, "u1").reshape(width, -1).T).view(kind).ravel() if size else np.zeros(0, kind)


def squeeze_rising(keys: np.ndarray) -> bytes:
    """Keys in rising order as their differences, which have fewer bits."""
    return squeeze(np.diff(keys, prepend=_U(0)))


def expand_rising(data: bytes) -> np.ndarray:
    return expand(data, "<u8").cumsum(dtype=_U)


# --- chunks -----------------------------------------------------------------

CODED = "chunk long, rows long, ids binary, id_null binary, marks binary, held binary, lengths binary, tokens binary, vocabulary binary"
#: Least tokens of a chunk for each shard, and most tokens of a chunk: packets hold about so many tokens or more.
PACKET_TOKENS, MOST_TOKENS = 2048, 4_000_000


def chunk_size(chunk_tokens: int, shards: int) -> int:
    """Tokens of a chunk: they grow with the number of shards, so the packets between chunks and shards grow as the input and not as its square.

    That holds to ``MOST_TOKENS`` a chunk, or about 2,000 shards; beyond it
    packets get smaller.
    """
    return max(chunk_tokens, min(PACKET_TOKENS * shards, MOST_TOKENS))


@dataclass
class Chunk:
    """Coded texts: ``tokens`` are numbers into ``vocabulary`` (word hashes); each text ends with END."""

    lengths: np.ndarray
    held: np.ndarray
    tokens: np.ndarray
    vocabulary: np.ndarray

    @staticmethod
    def read(row) -> Chunk:
        of = lambda name, kind: np.frombuffer(row[name], kind)
        return Chunk(of("lengths", "<i4"), of("held", "u1").astype(bool), expand(row["tokens"], "<i4"), expand(row["vocabulary"], "<u8"))

    def trained(self) -> np.ndarray:
        """Per token: does it come from a training text?"""
        return np.repeat(~self.held, self.lengths)

    def unigrams(self) -> np.ndarray:
        """Training count of each word of the vocabulary."""
        return np.bincount(self.tokens[self.trained()], minlength=len(self.vocabulary))

    def hashes(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: 64-bit hashes of its context of order - 1 tokens, of the last word of the context, and of itself."""
        own = self.vocabulary[self.tokens]
        start = np.zeros(len(own), bool)
        start[np.r_[0, self.lengths.cumsum()[:-1]].astype(int)] = True
        context, before, begun, last = np.zeros(len(own), _U), own, start, None
        for _ in range(order - 1):
            before = np.r_[START, before[:-1]]
            before[begun] = START
            last = before if last is None else last
            context = mix(context ^ before)
            begun = start | np.r_[True, begun[:-1]]
        return context, last, own


def code(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """Whole texts as chunks. docs: doc_id, held_out, text, and a number ``mark`` if each text has one."""
    columns = ["doc_id", "held_out", "text", *(["mark"] if "mark" in docs.columns else [])]

    with_marks = "mark" in columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        made = 0
        ids, marks, held, lengths, tokens, known = [], [], [], [], [], {}

        def row() -> pd.DataFrame:
            nonlocal made
            words = sorted(known, key=known.get)
            vocabulary = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else int(END) for w in words), "<u8", len(words))
            out = {
                "chunk": (TaskContext.get().partitionId() << 32) + made, "rows": len(ids), "ids": np.array([i or 0 for i in ids], "<i8").tobytes(), "id_null": np.array([i is None for i in ids], "u1").tobytes(), "marks": np.array(marks, "<i8").tobytes(),
                "held": np.array(held, "u1").tobytes(), "lengths": np.array(lengths, "<i4").tobytes(), "tokens": squeeze(np.array(tokens, "<i4")), "vocabulary": squeeze(vocabulary),
            }
            made += 1
            for x in (ids, marks, held, lengths, tokens, known):
                x.clear()
            return pd.DataFrame([out])

        for batch in batches:
            for i, h, text, mark in zip(batch["doc_id"], batch["held_out"], batch["text"], batch.get("mark", repeat(0))):
                words = (text or "").encode("utf-8", "surrogatepass").translate(_LOW).split()
                words.append(b"")  # the end
                for w in words:
                    if w not in known:
                        known[w] = len(known)
                tokens += [known[w] for w in words]
                ids.append(i if i is not None and i == i else None)
                held.append(bool(h))
                marks += [mark] * with_marks
                lengths.append(len(words))
                if len(tokens) >= chunk_tokens:
                    yield row()
        if ids:
            yield row()

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ({c: b.column(c).to_pylist() for c in columns} for b in batches)
        for frame in run(lists):
            yield pa.RecordBatch.from_arrays([pa.array(frame[c], pa.binary() if c not in ("chunk", "rows") else pa.int64()) for c in frame], names=list(frame))

    return docs.select(*columns).mapInArrow(arrow, CODED)


# --- exchange between chunks and shards -------------------------------------

PACKET = "level int, shard long, chunk long, keys binary, counts binary"
#: Answers of level 1 and more to a chunk; of level 0 a shard's words, and of level -1 its most frequent ones.
ANSWER = "level int, shard long, chunk long, value binary, word long, times long"


def ngrams(chunk: Chunk, level: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's distinct n-grams: keys (context << PART | next), training counts, places (hashes to deal by), and each token's n-gram."""
    context, last, own = chunk.hashes(level)
    key = mix(context) >> _U(64 - PART) << _U(PART) | mix(own) >> _U(64 - PART)
    spread = (last == START) | np.isin(last, hot)
    deal = np.where(spread, mix(context + mix(own)), mix(context ^ _U(level)))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if len(key) else np.zeros(0, bool)
    number = np.empty(len(key), np.int64)
    number[order] = first.cumsum() - 1
    at = order[first]
    counts = np.bincount(number[chunk.trained()], minlength=len(at))
    return key[at], counts, deal[at], number


def deal_out(keys: np.ndarray, deal: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its keys in rising order of the keys) of every shard that gets any."""
    shard = (deal % _U(shards)).astype(np.int64)
    order = np.lexsort((keys, shard))
    own = shard[order]
    cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else []
    for a, b in zip(cut, [*cut[1:], len(own)]):
        yield int(own[a]), order[a:b]


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the least of four widths, told by the first byte."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(counts) or counts.max() <= np.iinfo(k).max)
    return bytes([int(kind[2])]) + squeeze(counts.astype(kind))


def _wide(data: bytes) -> np.ndarray:
    return expand(data[1:], f"<u{data[0]}").astype(np.int64)


def _packets(level: int, chunk: int, keys: np.ndarray, counts: np.ndarray, deal: np.ndarray, shards: int) -> list[tuple]:
    return [(level, shard, chunk, squeeze_rising(keys[at]), _narrow(counts[at])) for shard, at in deal_out(keys, deal, shards)]


def word_packets(shards: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                chunk = Chunk.read(row)
                made = _packets(1, row["chunk"], chunk.vocabulary, chunk.unigrams(), mix(chunk.vocabulary), shards)
                yield pd.DataFrame(made, columns=["level", "shard", "chunk", "keys", "counts"])

    return run


def ngram_packets(order: int, shards: int, hot: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                chunk = Chunk.read(row)
                for level in range(2, order + 1):
                    keys, counts, deal, _ = ngrams(chunk, level, hot)
                    yield pd.DataFrame(_packets(level, row["chunk"], keys, counts, deal, shards), columns=["level", "shard", "chunk", "keys", "counts"])

    return run


def _summed(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all packets of a shard that have training counts, and their sums."""
    keys = np.concatenate([expand_rising(k) for k in frame["keys"]])
    counts = np.concatenate([_wide(c) for c in frame["counts"]])
    keys, counts = keys[counts > 0], counts[counts > 0]
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def word_shard(frame: pd.DataFrame) -> pd.DataFrame:
    """Totals for every chunk's words; the number and sum of the shard's words; and its most frequent ones, of which at most HOT in a shard's share are hot."""
    keys, counts = _summed(frame)
    shard, rows = frame["shard"].iloc[0], []
    for _, r in frame.iterrows():
        wanted = expand_rising(r["keys"])
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        found = np.where(keys[at] == wanted, counts[at], 0) if len(keys) else np.zeros(len(wanted), np.int64)
        rows.append((1, shard, r["chunk"], _narrow(found), 0, 0))
    rows.append((0, shard, -1, None, len(keys), int(counts.sum())))
    top = np.argsort(-counts, kind="stable")[: HOT * 64]
    rows += [(-1, shard, -1, None, int(k), int(c)) for k, c in zip(keys[top].view(np.int64), counts[top])]
    return pd.DataFrame(rows, columns=["level", "shard", "chunk", "value", "word", "times"])


def ngram_shard(tokens: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        level = int(frame["level"].iloc[0])
        trie = Trie(*_summed(frame), tokens)
        rows = [(level, r["shard"], r["chunk"], squeeze(trie.probe(expand_rising(r["keys"]))), 0, 0) for _, r in frame.iterrows()]
        return pd.DataFrame(rows, columns=["level", "shard", "chunk", "value", "word", "times"])

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scorer(order: int, shards: int, mu: float, n: int, v: int, hot: np.ndarray):
    def run(coded: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        said = {(r.level, r.shard): r for r in answers.itertuples()}
        for _, row in coded.iterrows():
            chunk = Chunk.read(row)
            count = np.zeros(len(chunk.vocabulary), np.int64)
            for shard, at in deal_out(chunk.vocabulary, mix(chunk.vocabulary), shards):
                count[at] = _wide(said[1, shard].value)
            own = count[chunk.tokens]
            p = (own + 0.1) / (n + 0.1 * (v + 1))
            starts = np.r_[0, chunk.lengths.cumsum()[:-1]].astype(int)
            base = np.add.reduceat(np.log10(p), starts)
            known = np.add.reduceat((own > 0).astype(np.int64), starts)
            begun = np.zeros(len(own), bool)
            begun[starts] = True
            end = np.flatnonzero(chunk.vocabulary == END)
            texts = count[end[0]] if len(end) else 0  # training texts: what begins one
            for level in range(2, order + 1):
                keys, _, deal, number = ngrams(chunk, level, hot)
                value = np.zeros(len(keys), "<u2")
                for shard, at in deal_out(keys, deal, shards):
                    value[at] = expand(said[level, shard].value, "<u2")
                total = np.r_[0, own[:-1]].astype(float)  # times of the context: of the shorter n-gram one token before
                total[begun] = texts
                own = np.rint(dequantise(value)[number] * n)
                p = (own + mu * p) / (total + mu)
            score = np.add.reduceat(np.log10(p), starts)
            null = np.frombuffer(row["id_null"], "u1").astype(bool)
            ids = pd.array(np.frombuffer(row["ids"], "<i8").copy(), dtype="Int64")
            ids[null] = pd.NA
            out.append(pd.DataFrame({"doc_id": ids, "held_out": chunk.held, "n_tokens": chunk.lengths.astype(np.int64), "n_known": known, "train_tokens": n, "base_score": base, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in SCORED.split(", ")})

    return run


def totals(words: DataFrame, shards: int) -> tuple[int, int, np.ndarray]:
    """Training tokens, distinct ones, and the hashes of hot words (at most HOT * shards)."""
    n, v = words.where("level = 0").agg(F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.sum("word"), F.lit(0))).first()
    hot = words.where((F.col("level") == -1) & (F.col("times").cast("double") * HOT * shards > n)).select("word").collect()
    return n, v, np.array([r[0] for r in hot], np.int64).view(_U)


def score(docs: DataFrame, held_out, *, order: int = ORDER, mu: float = 4.0, chunk_tokens: int = MODEL_TOKENS, shards: int | None = None) -> DataFrame:
    """Scores of all documents by a model of those for which the column ``held_out`` is false."""
    own = pick(docs, doc_id="doc_id", text="text").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    shards = shards or pieces(source_bytes(docs), SHARD_BYTES)
    coded = materialize_buckets(code(own, chunk_size(chunk_tokens, shards)), "lm-coded", "chunk", shards)
    # the answers are read twice: for the totals and by the chunks
    words = materialize(coded.mapInPandas(word_packets(shards), PACKET).groupBy("shard").applyInPandas(word_shard, ANSWER), "lm-words")
    n, v, hot = totals(words, shards)
    grams = coded.mapInPandas(ngram_packets(order, shards, hot), PACKET).groupBy("level", "shard").applyInPandas(ngram_shard(n), ANSWER)
    answers = words.where("level = 1").unionByName(grams) if order > 1 else words.where("level = 1")
    answers = answers.select("level", "shard", "chunk", "value")
    return coded.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(scorer(order, shards, mu, n, v, hot), SCORED)


def is_held_out(doc_id):
    """crc32 of the id as text, modulo 10, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; nulls, repeats and empty tables as the module states."""
    return score(table(spark, sf_dir, "documents"), is_held_out(F.col("doc_id")))
