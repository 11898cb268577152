"""Hierarchical packing of documents into fixed-length training sequences.

A document's tokens end with id 0. Whole windows of the longest tier are cut
from long documents; each rest goes to the shortest tier that holds it. Tiers
are packed from the longest to the shortest: a rest opens a window of its
tier, the largest rests that fit fill its gap, and a last gap is closed by
cutting a rest, so every window is full. What is left at the end of a
partition becomes sequences whose lengths are powers of two, so no sequence
is padded at all. Windows of one tier form step groups of equal token counts.

Packing is local to an input partition (no shuffle); a bounded pool of rests
is held at a time. Sequence numbers carry the partition in their upper bits,
so a lost partition is packed again in the same way.

Tokens are those of the byte-level BPE file at ``tokenizer_path``, without
those that its post-processor would add around a text; an added token of the
file that stands in a text is its one id. Words are tokenized once per worker:
a text is cut before each space that another character than white space
follows, where a token always begins, and the ids of each piece are kept in a
bounded cache.

Defined results: a null text is empty, an empty text is the one id 0; a
repeated row is packed again; a null doc_id is kept; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import pick, table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: Context lengths, the longest is the packing limit. All are powers of two.
TIERS = (128, 256, 512, 1024)
#: Tokens of one step group: it holds STEP_TOKENS / tier windows of its tier.
STEP_TOKENS = 8192
#: Rests in the pool before it is packed; each is shorter than the longest tier.
POOL = 8192
CACHE = 400_000
_CUT = re.compile(r" (?=\s|\Z)")
_PIECE = re.compile(r" (?=\S)")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of a byte-level BPE file. Of the added tokens that could begin at a place the longest counts."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only byte-level BPE that splits by its pattern, without normalizer or prefix space, is supported")
        added = {t["content"]: t for t in spec.get("added_tokens", ())}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added.values()):
            raise ValueError("added tokens that take in blanks or only stand as words are not supported")
        self._added = {content: np.array([t["id"]], "<u4").tobytes() for content, t in added.items()}
        self._split = re.compile("(" + "|".join(re.escape(c) for c in sorted(added, key=len, reverse=True)) + ")") if added else None
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self._bpe = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = np.array(self._bpe.encode_ordinary(piece), "<u4").tobytes()
        if len(self._known) >= CACHE:
            self._known.clear()
        if len(piece) <= 64:
            self._known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self._split and self._split.search(text):
            return b"".join(self._added.get(part) or self._plain(part) for part in self._split.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if not text:
            return b""
        if _CUT.search(text):
            at = [0, *(m.start() for m in _PIECE.finditer(text)), len(text)]
            parts = [text[a:b] for a, b in zip(at, at[1:]) if b > a]
        else:
            first, *rest = text.split(" ")
            parts = [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
        known, piece = self._known.get, self._piece
        return b"".join([known(p) or piece(p) for p in parts])


class Packer:
    """Packs pieces into windows; ``rows`` gathers what is final."""

    def __init__(self, tiers: tuple[int, ...], partition: int, step_tokens: int = STEP_TOKENS):
        self.tiers, self.top = tiers, tiers[-1]
        self.base, self.count = partition << 40, 0
        self.steps: dict[int, int] = defaultdict(int)
        self.step_tokens = step_tokens
        self.pool: dict[int, list] = defaultdict(list)  # rests by length
        self.mask = self.held = 0
        self.rows: list[tuple] = []

    def _emit(self, window: list[tuple]) -> None:
        length = sum(len(p[2]) for p in window)
        per = max(1, self.step_tokens // length)
        group = self.base | length.bit_length() << 32 | self.steps[length] // per
        self.steps[length] += 1
        offset = 0
        for doc, start, ids, total in window:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.base | self.count, offset, length, group))
            offset += len(ids)
        self.count += 1

    def _put(self, piece: tuple) -> None:
        n = len(piece[2])
        self.pool[n].append(piece)
        self.mask |= 1 << n
        self.held += 1

    def _take(self, n: int) -> tuple:
        piece = self.pool[n].pop()
        if not self.pool[n]:
            self.mask &= ~(1 << n)
        self.held -= 1
        return piece

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.top:
            self._emit([(doc, start, ids[start : start + self.top], total)])
            start += self.top
        if start < total:
            self._put((doc, start, ids[start:], total))
        if self.held >= POOL:
            self.pack(self.top)

    def _largest(self, most: int) -> int:
        """Length of the longest rest of at most ``most`` tokens, 0 if there is none."""
        return (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1 if self.mask & ((1 << (most + 1)) - 1) else 0

    def pack(self, keep: int) -> None:
        """Fill windows from the longest tier to the shortest while more than ``keep`` tokens are in the pool."""
        left = sum(n * len(p) for n, p in self.pool.items())
        for k in range(len(self.tiers) - 1, -1, -1):
            size, least = self.tiers[k], self.tiers[k - 1] if k else 0
            while left - size >= keep and self._largest(size) > least:
                window, gap = [], size
                while gap:
                    n = self._largest(gap)
                    if n:
                        window.append(self._take(n))
                        gap -= n
                        continue
                    shortest = (self.mask & -self.mask).bit_length() - 1  # all that is left is longer than the gap
                    doc, start, ids, total = self._take(shortest)
                    window.append((doc, start, ids[:gap], total))
                    self._put((doc, start + gap, ids[gap:], total))
                    gap = 0
                self._emit(window)
                left -= size

    def finish(self) -> None:
        """Pack the rest: full windows, then one sequence for each power of two in what is left."""
        self.pack(0)
        left = sum(n * len(p) for n, p in self.pool.items())
        pieces = [p for n in sorted(self.pool, reverse=True) for p in self.pool[n]]
        while left:
            size = min(self.top, 1 << (left.bit_length() - 1))
            window, gap = [], size
            while gap:
                doc, start, ids, total = pieces.pop()
                window.append((doc, start, ids[:gap], total))
                if len(ids) > gap:
                    pieces.append((doc, start + gap, ids[gap:], total))
                gap -= min(gap, len(ids))
            self._emit(window)
            left -= size
        self.pool.clear()
        self.mask = self.held = 0


def pack(docs: DataFrame, tokenizer_path: str, *, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: where its document's tokens went."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be rising powers of two")
    arrow = to_arrow_schema(T.StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(tokenizer_path), Packer(tiers, TaskContext.get().partitionId())

        def made() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) or [[]] * len(arrow)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                packer.add(doc, np.frombuffer(encoder.encode(text.as_py() or "") + b"\0\0\0\0", "<u4"))
                if len(packer.rows) >= 10_000:
                    yield made()
        packer.finish()
        yield made()

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(run, SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents; nulls, repeats and empty tables as the module states."""
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: the pieces of what the others kept."""
    return pack(docs, default_tokenizer())
