"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set holds its distinct 5-word shingles. Two sets of sizes r and s
with Jaccard similarity of at least J differ in at most
D = (1 - J) / (1 + J) * (r + s) shingles. For a band of sizes all shingles are
hashed into m segments, so two such sets can differ in at most D segments.
Each set indexes its non-empty segments; for some segments it also indexes
every set with one shingle less, so that two segments that differ in one
shingle meet too. A segment is worth 1 if equality is found, 2 if one
difference is found as well, 0 if it is empty (empty segments would meet
everywhere). A set is safe if its worth exceeds D; a similar pair with a safe
member always meets. m and the number of one-deletion segments are allocated
per band by cost, so that sets are safe but for a chance of about 1e-9; the
unsafe rest is joined among itself by single shingles, so no link is lost.

Equal sets are one class, and its first row stands for it in all that follows.
First each set is compared with the smallest one that shares one of its
``LOWEST`` signatures (a star, not all pairs); links are verified on the whole
sets. Then all signatures meet, with the component each set is in by now, and
a group whose members are in one component is done with. Of the others, pairs
are verified; larger groups are searched by sketches: members whose other
segments are enough leave frequent groups (those over ``FREQUENT``); of the
others the nearest pair of each member is verified first, and then all
plausible pairs that are still across components. The members of hot
signatures never meet in one task: they travel as rows and are compared in
blocks.

Signatures travel in packets of arrays (one for each chunk and shard); see
``lm.chunk_size`` for how their number grows with the input. Candidates first have to pass exact
bounds on size and on parity sketches (the Hamming distance of the parity
bits never exceeds that of the sets).

Defined results: a text without words, and a null text, has an empty set, is
linked with nothing and is its own component; fewer than five words make one
shingle; repeated rows are one class and share a component; the component of
a row is the smallest id in it (null if all are null); extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, numbered, pick, pieces, source_bytes, table, unique_join
from .components import components
from .lm import CHUNK_TOKENS, SHARD_BYTES, Chunk, chunk_size, code, mix

SHINGLE = 5
PERCENT = 80
#: Ratio of the largest to the smallest size of a band.
BAND = 1.5
#: A signature group of more members is frequent.
FREQUENT = 32
#: Lowest signatures of a set that are matched first.
LOWEST = 8
#: A signature is counted if so many sets of a chunk have it, and is hot if HOT_LEAST sets and 1 / HOT of all have it.
OFTEN, HOT_LEAST, HOT = 4, 1024, 256
#: Members of a group that are compared in one task.
BLOCK = 4096
#: At most so many wanted sets are listed in a broadcast; beyond, the lists are shuffled.
BROADCAST_ROWS = 1_000_000
_U = np.uint64
_ROW_BITS = 23


# --- sets ---------------------------------------------------------------------


def shingle_sets(chunk: Chunk, width: int = SHINGLE, only: np.ndarray | None = None) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk, or of the texts ``only``."""
    words = chunk.vocabulary[chunk.tokens]
    n = len(words)
    gram = np.zeros(n, _U)
    for k in range(width):
        gram = mix(gram ^ np.r_[words[k:], np.zeros(min(k, n), _U)])
    starts = np.r_[0, chunk.lengths.cumsum()[:-1]].astype(np.int64)
    out = []
    for i in range(len(starts)) if only is None else only.tolist():
        start, count = int(starts[i]), int(chunk.lengths[i]) - 1  # the last token is the end
        if count >= width:
            out.append(np.unique(gram[start : start + count - width + 1]))
        elif count:
            short = _U(count)
            for w in words[start : start + count]:
                short = mix(np.array([short ^ w], _U))[0]
            out.append(np.array([short], _U))
        else:
            out.append(np.zeros(0, _U))
    return out


def most_different(r: int, s: int, percent: int = PERCENT) -> int:
    """Largest Hamming distance of sets of sizes r and s that are similar enough."""
    return (100 - percent) * (r + s) // (100 + percent)


def parity(own: np.ndarray) -> np.ndarray:
    """Parity sketch: bit i tells whether an odd number of members hash to i; at least four bits a member."""
    bits = max(64, 4 << int(len(own) - 1).bit_length()) if len(own) else 64
    spot = (mix(own + _U(0x51)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(spot, minlength=bits) & 1).astype(bool), bitorder="little")


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of ``size`` bytes of the same set."""
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


# --- allocation -----------------------------------------------------------------


def band_of(n: int) -> int:
    return int(np.floor(np.log(n) / np.log(BAND) + 1e-9))


@lru_cache(maxsize=None)
def band_sizes(band: int) -> tuple[int, int]:
    """Smallest and largest size of the band."""
    lo = int(np.ceil(BAND**band - 1e-6))
    while band_of(lo) < band:
        lo += 1
    hi = int(np.ceil(BAND ** (band + 1))) + 1
    while band_of(hi) > band:
        hi -= 1
    return lo, hi


@lru_cache(maxsize=None)
def allocation(band: int, percent: int = PERCENT) -> tuple[int, int]:
    """(segments, how many of them with one-deletion neighbours) of a band: the cheapest that keeps sets safe."""
    lo, hi = band_sizes(band)
    top = most_different(hi, hi * 100 // percent, percent)
    best = None
    for m in sorted({max(1, int(x)) for x in np.geomspace(max(1, top / 3), 2 * hi + 2, 90)} | set(range(1, min(40, hi + 2)))):
        for t in sorted({0, m // 8, m // 4, m // 2, m}):
            ok = True
            for r in {lo, (lo + hi) // 2, hi}:
                need = most_different(r, r * 100 // percent, percent) + 1
                q = (1 - 1 / m) ** r
                one = r / m * (1 - 1 / m) ** (r - 1)
                mean = (m - t) * (1 - q) + t * (2 * (1 - q - one) + one)
                var = (m - t) * q * (1 - q) + t * (4 * (1 - q - one) + one - (2 - 2 * q - one) ** 2)
                if m == 1:
                    mean, var = (2.0 if t and r > 1 else 1.0), 0.0
                ok &= mean - 6 * np.sqrt(max(var, 0.0)) >= need
            cost = m + t * (hi / m)
            if ok and (best is None or cost < best[0]):
                best = (cost, m, t)
    return best[1:] if best else (max(1, top), max(1, top))


def bands_for(n: int, percent: int = PERCENT) -> list[int]:
    """The bands in which a set of n members meets others: by size of the smaller one."""
    if most_different(n, n * 100 // percent, percent) < 1:  # only equal sets are similar
        return [band_of(n)] if most_different(n, n - 1, percent) >= 1 else []
    return list(range(band_of(max(1, -(-n * percent // 100))), band_of(n) + 1))


def signatures(own: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The signatures of a set, and by how much its worth exceeds what it needs (negative: unsafe)."""
    out, spare, n = [], 1 << 20, len(own)
    hashed = mix(own + _U(0x9E37))
    for band in bands_for(n, percent):
        m, t = allocation(band, percent)
        seg = (mix(own ^ _U(band * 0x10001 + 7)) % _U(m)).astype(np.int64)
        count = np.bincount(seg, minlength=m)
        total = np.zeros(m, _U)
        np.add.at(total, seg, hashed)
        salt = mix(np.arange(m, dtype=_U) + _U((band + 1) << 32))
        full = np.flatnonzero(count)
        out.append(mix(total[full] ^ salt[full]))
        worth = len(full)
        if t:
            inner = np.flatnonzero((seg < t) & (count[seg] > 1))
            out.append(mix((total[seg[inner]] - hashed[inner]) ^ salt[seg[inner]]))
            worth += int((count[:t] > 1).sum())
        # in its own band a set may be the smaller one; in a lower band the other is the smaller
        other = n * 100 // percent if band == band_of(n) else min(n, band_sizes(band)[1])
        spare = min(spare, worth - most_different(n, other, percent) - 1)
    if not out:
        return np.zeros(0, _U), spare
    return np.unique(np.concatenate(out)), spare


# --- packets -------------------------------------------------------------------

META = "uid long, doc_id long, mark long, n long, d1 long, d2 long, spare int, sketch binary, low array<long>, often array<struct<signature:long,times:long>>"
PACKET = "shard long, chunk long, signatures binary, rows binary, labelled binary, labels binary"
MET = "kind int, a long, b long, members array<long>"


def uid_base(chunk: int) -> int:
    """Chunks are numbered by partition << 32 | order; rows take the lowest bits of an id."""
    return ((chunk >> 32) << 20 | (chunk & 0xFFFFFFFF)) << _ROW_BITS


def chunk_of(uid):
    """Column: the chunk of an id."""
    high = F.shiftright(uid, _ROW_BITS)
    return F.shiftleft(F.shiftright(high, 20), 32) + high.bitwiseAND((1 << 20) - 1)


def metas(percent: int):
    """A row of each document; the first row of a chunk also lists the signatures that are frequent in it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                sets = shingle_sets(Chunk.read(row))
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                ids = pd.array(np.frombuffer(row["ids"], "<i8").copy(), dtype="Int64")
                ids[np.frombuffer(row["id_null"], "u1").astype(bool)] = pd.NA
                d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                found = [signatures(s, percent) for s in sets]
                own, times = np.unique(np.concatenate([np.zeros(0, _U), *[f[0] for f in found]]), return_counts=True)
                often = [{"signature": int(g), "times": int(k)} for g, k in zip(own[times >= OFTEN].view(np.int64), times[times >= OFTEN])]
                yield pd.DataFrame({
                    "uid": uid_base(int(row["chunk"])) + np.arange(len(sets)), "doc_id": ids, "mark": np.frombuffer(row["marks"], "<i8"), "n": [len(s) for s in sets], "d1": d[:, 0], "d2": d[:, 1],
                    "spare": [f[1] for f in found], "sketch": [parity(s).tobytes() for s in sets], "low": [f[0][:LOWEST].view(np.int64) for f in found], "often": [often] + [None] * (len(sets) - 1),
                })

    return run


def _signed(row, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a chunk's distinct sets, and their rows; unsafe sets give their shingles too, in a name space of their own."""
    own = row["own"].astype(np.int64) - uid_base(int(row["chunk"]))
    sigs, rows = [np.zeros(0, _U)], [np.zeros(0, "<u4")]
    for i, members in zip(own.tolist(), shingle_sets(Chunk.read(row), only=own)):
        found, spare = signatures(members, percent)
        if spare < 0:
            found = np.concatenate([found, mix(members ^ _U(0xA5A5A5A5A5A5A5A5))])
        sigs.append(found)
        rows.append(np.full(len(found), i, "<u4"))
    return np.concatenate(sigs), np.concatenate(rows)


def packets(shards: int, percent: int, hot: np.ndarray):
    """Signatures by shard, with the component of each row that is linked already; hot ones by chunk, beyond the shards. One frame a chunk."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                sig, at = _signed(row, percent)
                own = row["own"].astype(np.int64)
                label = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
                known = own - uid_base(int(row["chunk"]))
                inside = known < len(label)
                label[known[inside]] = np.where(row["label"] == own, 0, row["label"] + 1).astype(np.int64)[inside]
                shard = np.where(np.isin(sig, hot), shards, (sig % _U(shards)).astype(np.int64))
                order = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[order], np.arange(shards + 2))
                kind = "<u2" if len(label) <= 1 << 16 else "<u4"
                out = []
                for k in np.flatnonzero(np.diff(cut)):
                    part = order[cut[k] : cut[k + 1]]
                    rows = at[part]
                    linked = np.unique(rows[label[rows] > 0])
                    to = int(k) if k < shards else shards + int(row["chunk"]) % shards
                    out.append((to, row["chunk"], sig[part].tobytes(), kind[2].encode() + rows.astype(kind).tobytes(), linked.astype("<u4").tobytes(), (label[linked] - 1).tobytes()))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PACKET.split(", ")])

    return run


def meet(shards: int):
    """Groups of signatures whose members are in more than one component: kind 1, pairs; kind 2, larger groups and how many signatures have them.

    Hot signatures come by chunk: kind 3, each with its members in a chunk, so
    no group of them meets in one task.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["shard"].iloc[0] < shards:
            return met_in(frame)
        rows = []
        for chunk, s, r in zip(frame["chunk"], frame["signatures"], frame["rows"]):
            sig = np.frombuffer(s, "<u8").view(np.int64)
            uid = uid_base(int(chunk)) + np.frombuffer(r, f"<u{r[:1].decode()}", offset=1).astype(np.int64)
            order = np.argsort(sig, kind="stable")
            own, first = np.unique(sig[order], return_index=True)
            rows += [(3, int(g), 0, members) for g, members in zip(own, np.split(uid[order], first[1:]))]
        return pd.DataFrame(rows, columns=["kind", "a", "b", "members"])

    return run


def met_in(frame: pd.DataFrame) -> pd.DataFrame:
    """The mixed groups of one shard."""
    sigs, uids, labels = [], [], []
    for chunk, s, r, linked, label in zip(*(frame[c] for c in ("chunk", "signatures", "rows", "labelled", "labels"))):
        rows = np.frombuffer(r, f"<u{r[:1].decode()}", offset=1).astype(np.int64)
        uid = uid_base(int(chunk)) + rows
        known, at = np.frombuffer(linked, "<u4").astype(np.int64), uid.copy()
        if len(known):
            spot = np.minimum(np.searchsorted(known, rows), len(known) - 1)
            at = np.where(known[spot] == rows, np.frombuffer(label, "<i8")[spot], uid)
        sigs.append(np.frombuffer(s, "<u8"))
        uids.append(uid)
        labels.append(at)
    sig, uid, label = np.concatenate(sigs), np.concatenate(uids), np.concatenate(labels)
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(sig)])
    label = label[order]
    mixed = (np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)) if len(first) else np.zeros(0, bool)
    keep = np.repeat(mixed, size)
    number, uid = np.repeat(np.arange(len(first)), size)[keep], uid[order][keep]
    order = np.lexsort((uid, number))
    number, uid = number[order], uid[order]
    again = np.r_[False, (number[1:] == number[:-1]) & (uid[1:] == uid[:-1])][: len(number)]
    number, uid = number[~again], uid[~again]
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(number)].astype(np.int64)
    two = starts[ends - starts == 2]
    pairs = np.unique(np.stack([uid[two], uid[two + 1]], axis=1), axis=0) if len(two) else np.zeros((0, 2), np.int64)
    groups = Counter(uid[a:b].tobytes() for a, b in zip(starts, ends) if b - a > 2)
    rows = [(1, int(a), int(b), None) for a, b in pairs]
    rows += [(2, times, 0, np.frombuffer(g, np.int64)) for g, times in groups.items()]
    return pd.DataFrame(rows, columns=["kind", "a", "b", "members"])


# --- verification --------------------------------------------------------------

NODE = "struct<no_id:boolean,least:bigint,mark:bigint,uid:bigint>"
LIKELY = f"a long, b long, xa {NODE}, xb {NODE}"


def plausible(percent: int):
    """Pairs whose sizes and sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
            keep = []
            for r, s, x, y in zip(n, m, batch.column("sa"), batch.column("sb")):
                ok = 100 * min(r, s) >= percent * max(r, s)
                if ok:
                    u, v = np.frombuffer(x.as_py(), "u1"), np.frombuffer(y.as_py(), "u1")
                    size = min(len(u), len(v))
                    ok = int(np.bitwise_count(fold(u, size) ^ fold(v, size)).sum()) <= most_different(r, s, percent)
                keep.append(ok)
            chosen = batch.filter(pa.array(keep, pa.bool_()))
            yield chosen.select(["a", "b", "xa", "xb"])

    return run


def across(percent: int, nearest: bool):
    """Plausible pairs of the blocks of mixed groups in a shard: different components, one of both bound to the group, sizes and sketches in bounds.

    Each pair has a side outside its block's largest component, so only those
    members are compared, each with all others at once; ``nearest`` keeps the
    pair with the nearest sketch for each of them.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["g", "lo", "hi"], ignore_index=True)
        key = frame[["g", "lo", "hi"]].to_numpy()
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        rep, n, label = frame["rep"].to_numpy(), frame["n"].to_numpy(), frame["label"].to_numpy()
        bound, own, sketch = frame["bound"].to_numpy(dtype=bool), frame["own"].to_numpy(), frame["sketch"].to_numpy()
        out = set()
        for a, b in zip(cut, [*cut[1:], len(frame)]):
            names, number = np.unique(label[a:b], return_inverse=True)
            if len(names) < 2:
                continue
            minor = number != np.bincount(number).argmax()
            size = min(map(len, sketch[a:b]))
            bits = np.stack([fold(np.frombuffer(x, "u1"), size) for x in sketch[a:b]]).view("<u8")
            r, m, k, o = rep[a:b], n[a:b], bound[a:b], own[a:b]
            for i in np.flatnonzero(minor):
                near = (number != number[i]) & (k | k[i]) & (nearest | ~minor | (r > r[i])) & (100 * np.minimum(m, m[i]) >= percent * np.maximum(m, m[i]))
                if key[a, 1] != key[a, 2]:
                    near &= o != o[i]
                at = np.flatnonzero(near)
                if len(at):
                    apart = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1)
                    fits = apart <= (100 - percent) * (m[at] + m[i]) // (100 + percent)
                    at = at[fits]
                    if nearest and len(at):
                        at = at[[apart[fits].argmin()]]
                    out |= {(min(r[i], x), max(r[i], x)) for x in r[at]}
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    return run


def wanted_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for _, row in frame.iterrows():
            wanted = np.array(row["wanted"], np.int64)
            sets = shingle_sets(Chunk.read(row), only=wanted - uid_base(int(row["chunk"])))
            yield pd.DataFrame({"uid": wanted, "members": [own.tobytes() for own in sets]})


def verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ma"), batch.column("mb")):
                u, v = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b", "xa", "xb"])

    return run


class Join:
    """The steps of one join; ``rows`` and ``components`` are what it returns."""

    def __init__(self, docs: DataFrame, *, percent: int = PERCENT, chunk_tokens: int = CHUNK_TOKENS, shards: int | None = None):
        self.percent = percent
        self.shards = shards or pieces(source_bytes(docs), SHARD_BYTES)
        own = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.lit(False).alias("held_out"), "text", text_mark(F.col("text")).alias("mark"))
        self.coded = materialize(code(own, min(chunk_size(chunk_tokens, self.shards), (1 << _ROW_BITS) - 1)), "join-coded")
        self.meta = materialize(self.coded.mapInPandas(metas(percent), META), "join-meta")
        # classes of equal sets; the smallest row stands for all in every later step
        first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("least"), "mark"))
        self.classes = materialize(self.meta.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("uid").alias("uid"), F.count("*").alias("copies"), first.alias("first")), "join-classes")
        node = F.struct("first.no_id", "first.least", "first.mark", "uid")
        self.reps = materialize(self.meta.select("uid", "spare", "sketch", "low").join(self.classes.select("uid", "n", node.alias("node")), "uid"), "join-reps")

    def lowest(self) -> DataFrame:
        """Pairs of each set with the smallest set that shares one of its lowest signatures (a star, not all pairs)."""
        each = self.reps.select("uid", "n", F.explode("low").alias("signature"))
        hubs = each.groupBy("signature").agg(F.min(F.struct("uid", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1").select(F.col("signature").alias("s"), F.col("hub.uid").alias("a"), F.col("hub.n").alias("m"))
        near = 100 * F.least("n", "m") >= self.percent * F.greatest("n", "m")
        return each.join(hubs, (F.col("signature") == F.col("s")) & (F.col("uid") != F.col("a")) & near).select("a", F.col("uid").alias("b")).distinct()

    def hot(self) -> np.ndarray:
        """Signatures of a large share of all sets, as counted where they are frequent; at most HOT times the signatures of a set."""
        often = self.meta.where("often is not null").select(F.explode("often").alias("o")).groupBy("o.signature").agg(F.sum("o.times").alias("times"))
        least = F.lit(self.meta.count() / HOT)
        found = often.where((F.col("times") >= HOT_LEAST) & (F.col("times") >= least)).select("signature")
        return np.sort(np.array([r[0] for r in found.collect()], np.int64).view(_U))

    def by_chunk(self, labels: DataFrame) -> DataFrame:
        """The coded chunks with the ids and components of their representatives."""
        known = self.reps.select("uid").join(labels.select(F.col("node.uid").alias("uid"), F.col("component.uid").alias("label")), "uid", "left")
        own = known.groupBy(chunk_of(F.col("uid")).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("uid", F.coalesce("label", "uid").alias("label")))).alias("r"))  # a chunk's own rows
        own = own.select("chunk", F.col("r.uid").alias("own"), F.col("r.label").alias("label"))
        few = self.reps.count() <= BROADCAST_ROWS  # of 16 bytes
        return self.coded.join(F.broadcast(own) if few else own.hint("shuffle_merge"), "chunk")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The links (nodes a, b) among pairs of class representatives."""
        side = self.reps.select("uid", "n", "sketch", "node")
        known = pairs.join(side.withColumnsRenamed({"uid": "a", "n": "na", "sketch": "sa", "node": "xa"}), "a").join(side.withColumnsRenamed({"uid": "b", "n": "nb", "sketch": "sb", "node": "xb"}), "b")
        likely = materialize(known.select("a", "b", "xa", "xb", "na", "nb", "sa", "sb").mapInArrow(plausible(self.percent), LIKELY), "join-likely")
        nodes = likely.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
        count = nodes.count()
        wanted = nodes.groupBy(chunk_of(F.col("uid")).alias("chunk")).agg(F.collect_list("uid").alias("wanted"))
        listed = self.coded.join(F.broadcast(wanted) if count <= BROADCAST_ROWS else wanted.hint("shuffle_merge"), "chunk")
        sets = listed.mapInPandas(wanted_sets, "uid long, members binary")
        both = likely.join(sets.withColumnsRenamed({"uid": "a", "members": "ma"}), "a").join(sets.withColumnsRenamed({"uid": "b", "members": "mb"}), "b")
        return materialize(both.select("a", "b", "xa", "xb", "ma", "mb").mapInArrow(verified(self.percent), LIKELY).select(F.col("xa").alias("a"), F.col("xb").alias("b")), "join-links")

    def rest(self, met: DataFrame, labels: DataFrame, *, nearest: bool = False) -> DataFrame:
        """Plausible pairs across components in the groups of three and more and in those of hot signatures, or the nearest pair of each member.

        Large groups are cut into blocks of BLOCK members, and each pair of
        blocks is compared by itself.
        """
        groups = met.where("kind = 2").groupBy(F.xxhash64("members").alias("g")).agg(F.sum("a").alias("times"), F.first("members").alias("members"))
        rows = groups.select("g", "times", F.size("members").cast("long").alias("size"), F.explode("members").alias("rep"))
        hot = met.where("kind = 3").select(F.col("a").alias("g"), F.lit(1).cast("long").alias("times"), "members")
        size = hot.groupBy("g").agg(F.sum(F.size("members")).alias("size"))  # a row of each hot signature
        rows = rows.unionByName(hot.join(F.broadcast(size), "g").select("g", "times", "size", F.explode("members").alias("rep")))
        known = labels.select(F.col("node.uid").alias("rep"), F.col("component.uid").alias("label"))
        rows = rows.join(known, "rep", "left").select("g", "times", "size", "rep", F.coalesce("label", "rep").alias("label"))
        mixed = materialize(rows.groupBy("g").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("g"), "join-groups")
        few = mixed.count() <= BROADCAST_ROWS  # of 8 bytes; the rows of a hot signature then stay where they are
        rows = materialize(rows.join(F.broadcast(mixed) if few else mixed, "g", "left_semi"), "join-mixed")
        frequent = rows.where(F.col("size") > FREQUENT).groupBy("rep").agg(F.sum("times").alias("frequent"))
        rows = rows.join(self.reps.select(F.col("uid").alias("rep"), "n", "sketch", "spare"), "rep").join(frequent, "rep", "left")
        rows = rows.withColumn("bound", (F.col("size") <= FREQUENT) | (F.col("frequent") > F.col("spare")))
        blocks = F.ceil(F.col("size") / BLOCK)
        rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        rows = rows.select("g", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "n", "label", "bound", "sketch")
        shard = F.pmod(F.xxhash64("g", "lo", "hi"), F.lit(self.shards))
        return rows.groupBy(shard.alias("shard")).applyInPandas(across(self.percent, nearest), "a long, b long").distinct()

    def links(self) -> DataFrame:
        """Links (nodes a, b) that connect what is connected: first by the lowest signatures, then among what these leave apart."""
        links = self.verify(self.lowest())
        labels = components(links)
        dealt = self.by_chunk(labels).mapInPandas(packets(self.shards, self.percent, self.hot()), PACKET)
        met = materialize(dealt.groupBy("shard").applyInPandas(meet(self.shards), MET), "join-met")
        # pairs in proportion to the members first: what they link is not compared in full
        links = links.unionByName(self.verify(met.where("kind = 1").select("a", "b").unionByName(self.rest(met, labels, nearest=True)).distinct()))
        return links.unionByName(self.verify(self.rest(met, components(links))))

    def components(self) -> DataFrame:
        """uid, doc_id, mark, n_shingles, component_id of every document, and ``first``: whether it is the first of its component."""
        labels = components(self.links()).select(F.col("node.uid").alias("uid"), F.col("component").alias("root"))
        named = self.classes.join(labels, "uid", "left").select("d1", "d2", "n", "copies", F.coalesce("root", F.struct("first.no_id", "first.least", "first.mark", "uid")).alias("root"))
        all_ = unique_join(self.meta.select("uid", "doc_id", "mark", "n", "d1", "d2"), named, ["d1", "d2", "n"], "copies", "root")
        one = F.col("root").isNull()  # an empty set is its own component
        least = F.when(one, F.col("doc_id")).otherwise(F.when(~F.col("root.no_id"), F.col("root.least")))
        first = one | (F.col("doc_id").eqNullSafe(least) & (F.col("mark") == F.col("root.mark")))
        return all_.select("uid", "doc_id", "mark", F.col("n").alias("n_shingles"), least.alias("component_id"), first.alias("first"))


def text_mark(text):
    """Column: a 64-bit hash of a text; with the id it tells the rows of a table apart, equal rows share it."""
    return F.xxhash64(F.coalesce(text, F.lit("\0")))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_shingles and component_id of every document; nulls, repeats and empty texts as the module states."""
    return Join(table(spark, sf_dir, "documents")).components().select("doc_id", "n_shingles", "component_id")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: the one with the smallest id (null last), then text hash; columns stay.

    Rows are told apart by id and text, so another text under a dropped id
    stays. Equal rows (same id, null or not, and same text) are reduced to
    one. Texts without words are nobody's copy: all their rows stay.
    """
    found = materialize(Join(docs).components().select("doc_id", "mark", "n_shingles", "first"), "join-found")
    drop = found.where("not first").select("doc_id", "mark").distinct()
    again = found.where("first and n_shingles > 0").groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark")
    own, columns = numbered(docs)
    names = own.columns
    own = own.withColumns({"_id": F.col(columns["doc_id"]), "_mark": text_mark(F.col(columns["text"]))})

    def of(rows: DataFrame, how: str) -> DataFrame:
        few = rows.withColumnsRenamed({"doc_id": "_other", "mark": "_other_mark"})
        few = F.broadcast(few) if rows.count() <= BROADCAST_ROWS else few  # of 16 bytes
        return own.join(few, F.col("_id").eqNullSafe(F.col("_other")) & (F.col("_mark") == F.col("_other_mark")), how)

    kept = of(drop, "left_anti")
    if not again.isEmpty():
        own = kept
        kept = of(again, "left_anti").unionByName(of(again, "left_semi").dropDuplicates(["_id", "_mark"]))
    return kept.select(*names).toDF(*docs.columns)
