"""Operator 8: SentencePiece BPE encoding with seeded merge-dropout.

Method. A text is cut before each run of spaces; no piece of the vocabulary
crosses such a cut (checked when the model is read), so each chunk is encoded
on its own, as the library does for whole texts. Within a chunk all adjacent
pairs that form a piece are candidates on an agenda; the best one (highest
score, leftmost among equals) is merged or, when a hash keyed by (seed,
variant, chunk, span) falls below the dropout rate, skipped for good. With
rate 0 the pieces are those of the library. The hash depends on the chunk and
the span only, so a chunk has one segmentation per variant and is worked out
once per task, whatever the order of rows or a lost executor's rerun.

Decoding joins pieces and bytes. It gives the text back exactly: spaces are
written as the visible space sign, whose own occurrences (and every character
outside the vocabulary) are written as byte pieces.

Defined results: null text encodes as the empty text, without ids; repeated
rows each give a row; extra columns are ignored; texts with lone surrogates
cannot occur in Spark strings.
"""

from __future__ import annotations

import re
from array import array
from functools import cached_property
from itertools import chain, filterfalse, groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small_batches

SPACE = "▁"
CACHE_BYTES = 160 << 20  # of the chunks kept by a task, over all variants (parameter)
ENTRY_BYTES = 200       # of a kept chunk besides its characters and ids
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20  # texts encoded at a time
SHORT = 64
CELLS = 1 << 18         # characters worked out side by side at a time
MANY = 8                # chunks of one length that are worked out side by side
NONE = float("-inf")


class _Chunks(dict):
    """chunk -> ids as 32-bit integers in bytes, worked out when first met.
    ``old`` holds what was met before the last turn of the cache."""

    def __init__(self, codec, variant):
        self.codec, self.variant, self.old, self.bytes = codec, variant, {}, 0

    def keep(self, chunks, ids) -> None:
        self.bytes += ENTRY_BYTES * len(chunks) + 2 * sum(map(len, chunks)) + sum(map(len, ids))
        self.update(zip(chunks, ids))

    def __missing__(self, chunk):
        ids = array("i", self.codec.chunk_ids(chunk, self.variant)).tobytes()
        self.keep([chunk], [ids])
        return ids

    def fresh(self, chunks: set) -> list:
        """Those of ``chunks`` that are yet to be worked out; old ones stay.
        Looks up the chunks only, however many are kept."""
        new = list(filterfalse(self.__contains__, chunks))
        if self.old:
            again = list(filter(self.old.__contains__, new))
            self.keep(again, list(map(self.old.__getitem__, again)))
            new = list(filterfalse(self.old.__contains__, new))
        return new

    def turn(self) -> None:
        self.old, self.bytes = dict(self), 0
        self.clear()


def _trim(cache: dict, bound: int) -> None:
    """Turns the caches of all variants once the young halves have half of
    the bound: chunks not met since the last turn go, and would be worked out
    again with the same result. Called between two slices of texts."""
    if sum(chunks.bytes for chunks in cache.values()) > bound // 2:
        for chunks in cache.values():
            chunks.turn()


class _Pairs:
    """Numbered symbols (pieces and their characters) and the piece that each
    pair of them forms; 0 is no symbol and no piece."""

    def __init__(self, ids: dict, scores: dict):
        import numpy as np

        names = sorted(ids.keys() | set("".join(ids)))
        number = {p: i + 1 for i, p in enumerate(names)}
        self.n = len(names) + 1
        made = sorted((number[p[:k]] * self.n + number[p[k:]], number[p]) for p in ids for k in range(1, len(p))
                      if p[:k] in number and p[k:] in number)
        self._table(np.array([k for k, _ in made], np.int64), np.array([m for _, m in made], np.int32))
        level = {s: i for i, s in enumerate(sorted(set(scores.values())))}
        self.rank = np.array([-1, *[level[scores[p]] if p in scores else -1 for p in names]], np.int32)
        self.ids = np.array([-1, *[ids.get(p, -1) for p in names]], np.int32)
        self.char = np.zeros(0x110000, np.int32)
        for p, i in number.items():
            if len(p) == 1:
                self.char[ord(p)] = i

    def _table(self, keys, made) -> None:
        """Open addressing: a pair lies at most ``probes`` slots after its own."""
        import numpy as np

        self.shift = np.uint64(64 - max(4 * len(keys), 16).bit_length())
        size = 1 << (64 - int(self.shift))
        self.keys, self.made, self.probes = np.full(size + 64, -1, np.int64), np.zeros(size + 64, np.int32), 0
        slot = self._slot(keys)
        while len(keys):
            if self.probes == 64:
                raise ValueError("the pairs of the vocabulary fall into too few slots")
            first = np.unique(slot, return_index=True)[1]
            first = first[self.keys[slot[first]] == -1]
            self.keys[slot[first]], self.made[slot[first]] = keys[first], made[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, made, slot, self.probes = keys[rest], made[rest], slot[rest] + 1, self.probes + 1

    def _slot(self, keys):
        import numpy as np

        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def formed(self, a, b):
        import numpy as np

        key = (a.astype(np.int64) * self.n + b).ravel()
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.made[slot], 0)
        todo = np.flatnonzero((there != key) & (there != -1))  # another pair has the slot
        for d in range(1, self.probes):
            if not len(todo):
                break
            at = slot[todo] + d
            there = self.keys[at]
            hit = there == key[todo]
            out[todo[hit]] = self.made[at[hit]]
            todo = todo[~hit & (there != -1)]
        return out.reshape(a.shape)


class Codec:
    """Piece tables of a SentencePiece BPE model with byte fallback."""

    cache_bytes = CACHE_BYTES

    def __init__(self, model: bytes, rate: float = 0.0, seed: int = 0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        usual = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in usual}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in usual}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.pieces = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()}
        self.pieces |= {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("the vocabulary has pieces across words")
        self.rate, self.seed = round(rate * 2**32), seed
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    @cached_property
    def pairs(self) -> _Pairs:
        return _Pairs(self.ids, self.scores)

    def chunk_ids(self, chunk: str, variant: int) -> list[int]:
        """Agenda processing of one chunk. Short chunks keep the agenda as a
        list of the adjacent pairs' scores, long ones as a heap; both take the
        highest score, leftmost among equals."""
        import xxhash

        if not chunk:  # stands for a space sign of the text itself
            return [self.byte_ids[b] for b in SPACE.encode()]
        key = xxhash.xxh3_64_intdigest(chunk, self.seed * 1_000_003 + variant) if self.rate else 0
        out: list[int] = []
        for p in (self._merge_short if len(chunk) <= SHORT else self._merge_long)(list(chunk), key):
            known = self.ids.get(p)
            out += [known] if known is not None else [self.byte_ids[b] for b in p.encode()]
        return out

    def _skipped(self, key: int, start: int, stop: int) -> bool:
        """Keyed hash of a candidate's span: skip this merge?"""
        h = (key ^ (start * 0x9E3779B97F4A7C15 + stop * 0xC2B2AE3D27D4EB4F)) * 0xD6E8FEB86659FD93
        return ((h ^ (h >> 32)) & 0xFFFFFFFF) < self.rate

    def _merge_short(self, parts: list[str], key: int) -> list[str]:
        get, none = self.scores.get, NONE
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        starts, rate = list(range(len(parts) + 1)), self.rate
        while scores:
            best = max(scores)
            if best == none:
                break
            i = scores.index(best)
            if rate:  # as in _skipped
                h = (key ^ (starts[i] * 0x9E3779B97F4A7C15 + starts[i + 2] * 0xC2B2AE3D27D4EB4F)) * 0xD6E8FEB86659FD93
                if ((h ^ (h >> 32)) & 0xFFFFFFFF) < rate:
                    scores[i] = none
                    continue
            parts[i] += parts[i + 1]
            del parts[i + 1], starts[i + 1], scores[i]
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def _merge_long(self, parts: list[str], key: int) -> list[str]:
        import heapq

        n, get = len(parts), self.scores.get
        left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        agenda: list[tuple] = []

        def add(i: int, j: int) -> None:
            s = get(parts[i] + parts[j])
            if s is not None:
                heapq.heappush(agenda, (-s, i, j, end[j]))

        for i in range(n - 1):
            add(i, i + 1)
        while agenda:
            _, i, j, stop = heapq.heappop(agenda)
            stale = parts[i] is None or parts[j] is None or right[i] != j or end[j] != stop or end[i] != j
            if stale or self.rate and self._skipped(key, i, stop):
                continue
            parts[i] += parts[j]
            end[i], parts[j] = stop, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                add(i, k)
            if left[i] >= 0:
                add(left[i], i)
        return [p for p in parts if p is not None]

    def _merge_many(self, symbols, key):
        """Agenda processing of chunks of one length side by side: in each
        round every chunk takes its best candidate. ``symbols`` (a row per
        chunk) are merged in place at the candidates' starts; returns where
        symbols are left."""
        import numpy as np

        pairs, (rows, n) = self.pairs, symbols.shape
        left, right = (np.tile(np.arange(d, n + d, dtype=np.int32), (rows, 1)) for d in (-1, 1))
        kept = np.ones((rows, n), bool)
        made = np.zeros((rows, n), np.int32)  # by the pair's first symbol; the last has none
        made[:, :-1] = pairs.formed(symbols[:, :-1], symbols[:, 1:])
        agenda = pairs.rank[made]
        row = np.arange(rows)
        while len(row):
            mine = agenda[row]
            at = mine.argmax(1)  # the leftmost of the highest
            some = mine[np.arange(len(row)), at] >= 0
            row, at = row[some], at[some]
            second = right[row, at]
            stop = right[row, second]
            r = row
            if self.rate:  # as in _skipped
                h = (key[r] ^ (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + stop.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                     ) * np.uint64(0xD6E8FEB86659FD93)
                skip = ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFFFFFF)) < np.uint64(self.rate)
                agenda[r[skip], at[skip]] = -1
                r, at, second, stop = (x[~skip] for x in (r, at, second, stop))
            symbols[r, at] = made[r, at]
            kept[r, second] = False
            agenda[r, second] = -1
            right[r, at] = stop
            more = stop < n
            left[r[more], stop[more]] = at[more]
            made[r, at] = np.where(more, pairs.formed(symbols[r, at], symbols[r, np.minimum(stop, n - 1)]), 0)
            agenda[r, at] = pairs.rank[made[r, at]]
            before = left[r, at]
            r, at, before = (x[before >= 0] for x in (r, at, before))
            made[r, before] = pairs.formed(symbols[r, before], symbols[r, at])
            agenda[r, before] = pairs.rank[made[r, before]]
        return kept

    def _fill(self, new: dict, cache: dict) -> None:
        """Works out the new chunks of each variant side by side, by length. Long chunks
        and the few of a length are left to :meth:`chunk_ids`."""
        from collections import defaultdict

        import numpy as np
        import xxhash

        groups = defaultdict(list)
        for v, chunks in new.items():
            for c in chunks:
                groups[len(c)].append((c, v))
        parts = ((n, group[a:a + CELLS // n]) for n, group in groups.items() if 1 < n <= SHORT and len(group) >= MANY
                 for a in range(0, len(group), CELLS // n))
        for n, group in parts:
            chunks, variants = zip(*group)
            points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).reshape(-1, n)
            symbols = self.pairs.char[points]
            key = np.fromiter((xxhash.xxh3_64_intdigest(c, self.seed * 1_000_003 + v) for c, v in group), np.uint64, len(group))
            kept = self._merge_many(symbols, key)
            ids, each = self._spell(self.pairs.ids[symbols[kept]], points[kept])
            ends = [0, *(4 * np.concatenate([[0], np.cumsum(each)])[np.cumsum(kept.sum(1))]).tolist()]
            flat, at = ids.tobytes(), 0
            found = [flat[a:b] for a, b in zip(ends, ends[1:])]
            for v, some in groupby(variants):  # chunks come by variant
                end = at + sum(1 for _ in some)
                cache[v].keep(chunks[at:end], found[at:end])
                at = end

    def _spell(self, ids, points):
        """Ids with characters that are no pieces (-1) as their byte pieces;
        and how many ids each became."""
        import numpy as np

        lost = ids < 0
        each = np.ones(len(ids), np.int64)
        if not lost.any():
            return ids, each
        codes = points[lost]
        each[lost] += (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        utf8 = codes.tobytes().decode("utf-32-le").encode()
        out = np.repeat(ids, each)
        out[np.repeat(lost, each)] = np.array(self.byte_ids, np.int32)[np.frombuffer(utf8, np.uint8)]
        return out, each

    def _chunked(self, text: str) -> list[str]:
        """Chunks of a text; the empty one stands for a space sign in it."""
        if not text:
            return []
        if SPACE not in text:
            return self.cut((" " + text).replace(" ", SPACE))
        parts = [self.cut(p.replace(" ", SPACE)) for p in (" " + text).split(SPACE)]
        return [*parts[0], *chain.from_iterable(["", *p] for p in parts[1:])]

    def encode_many(self, texts: list[str], variants: list[int], cache: dict) -> list[bytes]:
        """Ids of each text, as 32-bit integers in bytes; ``cache`` holds the
        chunks' ids by variant."""
        _trim(cache, self.cache_bytes)
        cut, new = [self._chunked(t) for t in texts], {}
        for v in set(variants):
            chunks = cache.setdefault(v, _Chunks(self, v))
            met = set(chain.from_iterable(c for c, w in zip(cut, variants) if w == v))
            new[v] = chunks.fresh(met)
        self._fill(new, cache)
        return [b"".join(map(cache[v].__getitem__, c)) for c, v in zip(cut, variants)]

    def encode(self, text: str, cache: dict, variant: int = 0) -> list[int]:
        """Ids of one text."""
        return array("i", self.encode_many([text], [variant], cache)[0]).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids that :meth:`encode` gave: drops the one space put
        before it."""
        return b"".join(map(self.pieces.__getitem__, ids))[1:].decode()


    @cached_property
    def _spelt(self):
        """The bytes of every id, as an Arrow array."""
        import pyarrow as pa

        return pa.array([self.pieces.get(i) for i in range(max(self.pieces) + 1)], pa.large_binary())

    def decode_many(self, ids, lens) -> list[str]:
        """The texts of many rows' ids (one array, ``lens`` of each row):
        :meth:`decode` of each, with one pass over the pieces."""
        import numpy as np

        if not len(ids):
            return [""] * len(lens)
        spelt = self._spelt.take(ids)
        _, offsets, data = spelt.buffers()
        starts = np.frombuffer(offsets, np.int64)[spelt.offset:spelt.offset + len(ids) + 1]
        cuts = starts[np.concatenate([[0], np.cumsum(lens)])].tolist()
        data = memoryview(data)
        return [str(data[a + 1:b], "utf-8") if b > a else "" for a, b in zip(cuts, cuts[1:])]


def _slices(texts, most: int = SLICE_BYTES):
    """(start, length) of slices of bounded rows and, but for a single longer
    text, ``most`` bytes."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(size):
        end = int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right"))
        n = min(max(end, a + 1), a + SLICE_ROWS) - a
        yield a, n
        a += n


def _encode_rows(batches, model, rate, seed, variants, names, cache_bytes):
    import numpy as np
    import pyarrow as pa
    import xxhash

    codec, cache = Codec(model.value, rate, seed), {}
    codec.cache_bytes = cache_bytes
    for batch in batches:
        for a, n in _slices(batch.column(1), min(SLICE_BYTES, cache_bytes // 16)):
            part = [t or "" for t in batch.column(1).slice(a, n).to_pylist()]
            variant = [xxhash.xxh3_64_intdigest(t, seed) % variants for t in part]
            ids = codec.encode_many(part, variant, cache)
            lens = np.array([len(x) // 4 for x in ids], np.int64)
            flat = np.frombuffer(b"".join(ids), np.int32)
            whole = [d == t for d, t in zip(codec.decode_many(flat, lens), part)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(part)), pa.array(variant, pa.int32()), lists,
                                              pa.array(lens), pa.array(whole)], names)


def _decode_rows(batches, model, name):
    import pyarrow as pa

    codec = Codec(model.value)
    for batch in batches:
        texts = [None if x is None else codec.decode(x) if x else "" for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], name)


def _model(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())  # one model file: its size is fixed


def encode(docs: DataFrame, model_path: str, rate: float = 0.1, seed: int = 1, variants: int = 4, id_col: str = "doc_id",
           text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row per document: id, variant (by the text's hash), ids, n_pieces
    and lossless (decoding gave the text back). No shuffle. ``cache_bytes`` bounds
    what a task keeps of chunks it has met; less costs time, not results."""
    small_batches(docs)
    model, names = _model(docs, model_path), [id_col, "variant", "ids", "n_pieces", "lossless"]
    schema = T.StructType([docs.schema[id_col], T.StructField("variant", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_pieces", T.LongType()), T.StructField("lossless", T.BooleanType())])
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        lambda it: _encode_rows(it, model, rate, seed, variants, names, cache_bytes), schema)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id and text."""
    model = _model(encoded, model_path)
    schema = T.StructType([encoded.schema[id_col], T.StructField("text", T.StringType())])
    return encoded.select(id_col, ids_col).mapInArrow(lambda it: _decode_rows(it, model, [id_col, "text"]), schema)
