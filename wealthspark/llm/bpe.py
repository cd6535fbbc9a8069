"""Byte-level BPE by speculation: greedy longest matches, a vectorised test of each neighbouring pair, merges where it fails."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the byte-level pre-tokeniser's pattern, as the tokenizers library has it for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries after which a worker's tables of encoded chunks and pieces start again.
HELD = 500_000
_SEPARATOR = "Ā"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next after U+00FF."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes like the tokenizers library does with this vocabulary (no special tokens added).

    A sequence of tokens is what merging gives exactly if each neighbouring pair is: so a greedy proposal whose
    pairs all pass is right, and only the other pieces are merged step by step.
    """

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model, letters = spec["model"], byte_letters()
        as_bytes = {t: bytes(map(letters.__getitem__, t)) for t in model["vocab"] if all(c in letters for c in t)}
        size = max(model["vocab"].values(), default=0) + 1
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max(size, *(i + 1 for i in self.special.values())) if self.special else size
        self.content = [b""] * size
        for t, b in as_bytes.items():
            self.content[model["vocab"][t]] = b
        for t, i in self.special.items():
            self.content[i] = t.encode()
        self.byte_id = np.zeros(256, np.int64)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right = np.arange(size), np.arange(size)
        self.order = np.zeros(size, np.int64)  # when a token arises; single bytes at 0
        codes, ranks = [], []
        for r, pair in enumerate(model["merges"], 1):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.rank[i, j] = (r, k)
            self.left[k], self.right[k], self.order[k] = i, j, r
            codes.append(i << 32 | j)
            ranks.append(r)
        by = np.argsort(codes)
        self.codes, self.ranks = np.array(codes, np.int64)[by], np.array(ranks, np.int64)[by]
        self.automaton = ahocorasick.Automaton()
        for t, b in as_bytes.items():
            if t not in self.special:
                self.automaton.add_word(b.decode("latin1"), model["vocab"][t])
                if len(b) == 1:
                    self.byte_id[b[0]] = model["vocab"][t]
        self.automaton.make_automaton()
        self.byte_ids = self.byte_id.tolist()
        self.pattern = regex.compile(PATTERN)
        #: A space next to white space needs the whole pattern.
        self.before, self.after = re.compile(r" \s").search, re.compile(r" (?<=\s )").search
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of tokens a and b gives a, b again.

        Walks back in time: of the two tokens at the border, the one that arose later is replaced by its
        part at the border. The pair fails if at some time both are there and their own merge comes before
        (or, at the left of an equal merge, with) the merge that used them up.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        until = np.full(len(a), np.iinfo(np.int64).max)  # merges before this time meet the border as it stands
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            code = x.astype(np.int64) << 32 | y
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            merges = (self.codes[at] == code) & (self.ranks[at] < until[live]) if len(self.codes) else np.zeros(len(x), bool)
            good[live[merges]] = False
            tx, ty = self.order[x], self.order[y]
            first = tx > ty
            until[live] = np.where(first, tx, ty + 1)
            a[live[first]] = self.right[x[first]]
            b[live[~first]] = self.left[y[~first]]
            live = live[~merges & (np.maximum(tx, ty) > 0)]
        return good

    def merged(self, data: bytes) -> list[int]:
        """The exact merges, earliest first and from the left. Long pieces use a heap of neighbouring pairs."""
        ids = self.byte_id[np.frombuffer(data, np.uint8)].tolist() if len(data) > 16 else [self.byte_ids[b] for b in data]
        rank = self.rank
        if len(ids) <= 100:
            none = (len(self.ranks) + 1, -1)
            pairs = [rank.get(p, none) for p in zip(ids, ids[1:])]
            while pairs and (best := min(pairs)) is not none:
                k = pairs.index(best)
                ids[k : k + 2] = [best[1]]
                del pairs[k]
                if k:
                    pairs[k - 1] = rank.get((ids[k - 1], best[1]), none)
                if k < len(pairs):
                    pairs[k] = rank.get((best[1], ids[k + 1]), none)
            return ids
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*rank[p], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, new, k, x, y = heapq.heappop(heap)
            j = after[k]
            if ids[k] != x or j >= n or ids[j] != y:
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (p := (new, ids[after[k]])) in rank:
                    heapq.heappush(heap, (*rank[p], k, *p))
            if before[k] >= 0 and (p := (ids[before[k]], new)) in rank:
                heapq.heappush(heap, (*rank[p], before[k], *p))
        return [i for i in ids if i >= 0]

    def _speculate(self, pieces: list[str]) -> None:
        """Fill the table of pieces."""
        raw = [p.encode() for p in pieces]
        text = _SEPARATOR.join([r.decode("latin1") for r in raw])
        found = np.array(list(self.automaton.iter_long(text)), np.int64).reshape(-1, 2)
        last = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 2
        piece, ids = np.searchsorted(last, found[:, 0]), found[:, 1]
        inner = np.flatnonzero(piece[1:] == piece[:-1])
        wrong = set(np.unique(piece[inner[~self.compatible(ids[inner], ids[inner + 1])]]).tolist())
        packed, at = ids.astype("<u4").tobytes(), np.searchsorted(piece, np.arange(len(raw) + 1)) * 4
        at = at.tolist()
        for p, start, end in zip(pieces, at, at[1:]):
            self.pieces[p] = packed[start:end]
        for k in wrong:
            ids = self.merged(raw[k])
            self.pieces[pieces[k]] = struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, chunks: set[str]) -> None:
        """Fill the table of chunks: what stands between two single spaces, encoded with the space before it."""
        parts = {c: [" " + c] if c.isalpha() else self.pattern.findall(" " + c) for c in chunks}
        self._pieces({p for ps in parts.values() for p in ps})
        known = self.pieces
        for c, ps in parts.items():
            self.chunks[c] = known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])

    def _pieces(self, pieces: set[str]) -> None:
        if new := [p for p in pieces if p not in self.pieces]:
            self._speculate(new)

    def _stretch(self, texts: list[str]) -> list[bytes]:
        """Texts without special tokens. Chunks are cut at single spaces, where the pattern always starts anew."""
        if len(self.pieces) > HELD:
            self.pieces.clear()
        if len(self.chunks) > HELD:
            self.chunks.clear()
        heads, rests = [], []
        for t in texts:
            if self.before(t) or self.after(t):
                heads.append(self.pattern.findall(t))
                rests.append([])
            else:
                first, *rest = t.split(" ")
                heads.append(self.pattern.findall(first))
                rests.append(rest)
        known = self.chunks
        if new := set(itertools.chain.from_iterable(rests)).difference(known):
            self._learn(new)
        self._pieces(set(itertools.chain.from_iterable(heads)))
        return [b"".join([self.pieces[p] for p in head]) + b"".join(map(known.__getitem__, rest)) for head, rest in zip(heads, rests)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        if not self.cut or not any(s in t for s in self.special for t in texts):
            return self._stretch(texts)
        parts = [self.cut(t) for t in texts]
        done = iter(self._stretch([p for ps in parts for p in ps[::2]]))
        special = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        return [b"".join([special[p] if k % 2 else next(done) for k, p in enumerate(ps)]) for ps in parts]

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.content.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


_made: dict[str, Encoder] = {}


def encoder_of(spec: str) -> Encoder:
    """The encoder of a vocabulary file's text; made once per Python worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(spec)
    return _made[key]


def vocabulary(path: str) -> str:
    """The text of a vocabulary file. Its size is that of the vocabulary (some MB), whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def slices(ids: pa.Array, texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[pa.Array, list[str]]]:
    """Parts of a batch with about ``most`` bytes of text each, so that a batch of long documents stays small in memory."""
    start, held, out = 0, 0, []
    for k, value in enumerate(texts):
        text = value.as_py() or ""
        out.append(text)
        held += len(text)
        if held >= most:
            yield ids.slice(start, len(out)), out
            start, held, out = k + 1, 0, []
    if out:
        yield ids.slice(start, len(out)), out


def encode_decode(spark: SparkSession, docs: DataFrame, vocabulary_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's ids and the text decoded from them: id, ``n_tokens``, ``ids`` (packed little-endian unsigned 32-bit), ``decoded``.

    Null text counts as empty and gives no ids. A special token's string in a text becomes that token. Any
    text length; a null id is kept as it is; repeated rows give repeated rows; other columns are not read.
    """
    spec = spark.sparkContext.broadcast(vocabulary(vocabulary_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(spec.value)
        for batch in batches:
            for ids, texts in slices(batch.column(0), batch.column(1)):
                packed = coder.encode(texts)
                n = pa.array([len(p) // 4 for p in packed], pa.int64())
                yield pa.record_batch([ids, n, pa.array(packed, pa.binary()), pa.array(map(coder.decode, packed), pa.string())], ["id", "n_tokens", "ids", "decoded"])

    kind = docs.schema[id].dataType.simpleString()
    out = docs.select(F.col(id), F.col(text).cast("string")).mapInArrow(work, f"id {kind}, n_tokens long, ids binary, decoded string")
    return out.withColumnRenamed("id", id)
