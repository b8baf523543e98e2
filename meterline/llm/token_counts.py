"""Operator 2: token counts without materialising token ids.

Method. A document's token count is the sum over its pre-tokens of the number
of pieces each one splits into, and a pre-token always splits the same way.
So documents are read in blocks, each block is turned into an inverted table
``(pre-token, [(document, frequency), ...])``, those rows are shuffled by
pre-token, the library counts the pieces of each distinct pre-token once, and
a second shuffle by block sums ``frequency * pieces`` per document.

What keeps it bounded at any corpus size:

* a block holds at most ``BLOCK_DOCS`` documents or ``BLOCK_BYTES`` bytes of
  text (or one longer document), so are a worker's arrays and a block's sums;
* a pre-token that occurs in more than ``LOCAL_DOCS`` documents of a block is
  counted right there (one library call per block) and never shuffled, so a
  very common word makes no hot key and no long row.

Pre-tokens come from the published split pattern of byte-level BPE. Texts
with characters outside long-settled Unicode ranges are counted whole by the
library, so the Unicode version of the pattern engine cannot matter.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows
each give a row; a null id stays null; extra columns are ignored; an empty
table gives an empty result. Special strings inside texts are handled as the
library does by default (one special token each).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_DOCS = 4096
BLOCK_BYTES = 16 << 20
LOCAL_DOCS = 16
# Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters, digits and spaces here have not changed for many Unicode versions.
UNSETTLED = "[^\u0000-ԯ -⁯₠-₿]"


def _tokenizer(spec):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec.value)


def _blocks(batches):
    """(ids, texts) groups within the block limits."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            t = t or ""
            if ids and (len(ids) >= BLOCK_DOCS or size + len(t) > BLOCK_BYTES):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if ids:
        yield ids, texts


class _Numbering(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _buckets(words, n):
    """Bucket of each pre-token: all blocks deal the same one to the same bucket."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words)) % np.uint64(n)


def _invert(batches, spec, specials, id_type, n_buckets):
    """Per block: one row of document ids, sizes and local sums, then a row
    for each bucket of the pre-tokens that are not counted locally: the words,
    how many (document, frequency) pairs each has, and those pairs."""
    import numpy as np
    import pyarrow as pa
    import regex
    from pyspark import TaskContext

    tok = _tokenizer(spec)
    find = regex.compile(SPLIT).findall
    odd = regex.compile(UNSETTLED).search
    cut = regex.compile("|".join(regex.escape(s) for s in specials)) if specials else None
    block = TaskContext.get().partitionId() << 28
    names = ["bucket", "block", "words", "packed", "ids", "n_bytes"]
    row = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("words", pa.list_(pa.string())), ("packed", pa.binary()),
                     ("ids", pa.list_(id_type)), ("n_bytes", pa.list_(pa.int64()))])

    def pieces_of(words):
        return np.array([len(e.ids) for e in tok.encode_batch(words, add_special_tokens=False)], np.int64)

    for ids, texts in _blocks(batches):
        number, flat, lens = _Numbering(), [], []
        sums = np.zeros(len(ids), np.int64)
        for k, text in enumerate(texts):
            n = len(flat)
            if odd(text):
                sums[k] = len(tok.encode(text, add_special_tokens=False).ids)
            elif cut is None:
                flat.extend(map(number.__getitem__, find(text)))
            else:
                parts = cut.split(text)
                sums[k] = len(parts) - 1
                for part in parts:
                    flat.extend(map(number.__getitem__, find(part)))
            lens.append(len(flat) - n)
        listed, n_words = np.array([*number, ""], object)[:-1], len(number)
        key = (np.array(flat, np.int64) << 16) | np.repeat(np.arange(len(ids)), lens)
        key, freq = np.unique(key, return_counts=True)
        word, doc = key >> 16, key & 0xFFFF
        per_word = np.bincount(word, minlength=n_words)
        local = per_word > LOCAL_DOCS
        here = np.flatnonzero(local)
        if len(here):
            pieces = np.zeros(n_words, np.int64)
            pieces[here] = pieces_of(listed[here].tolist())
            sums += np.bincount(doc, weights=pieces[word] * freq, minlength=len(ids)).astype(np.int64)
        rows = [{"bucket": -1 - block, "block": block, "words": None, "packed": sums.tobytes(), "ids": ids,
                 "n_bytes": [len(t.encode()) for t in texts]}]
        there = np.flatnonzero(~local)
        if len(there):
            dealt = _buckets(listed[there], n_buckets)
            order = np.argsort(dealt, kind="stable")
            first = np.concatenate([[0], np.cumsum(per_word)])
            for part in np.split(order, np.flatnonzero(np.diff(dealt[order])) + 1):
                w = there[part]
                n = per_word[w]
                at = np.repeat(first[w] - np.cumsum(n) + n, n) + np.arange(n.sum())
                rows.append({"bucket": int(dealt[part[0]]), "block": block, "words": listed[w].tolist(),
                             "packed": _pack(n, doc[at], freq[at]), "ids": None, "n_bytes": None})
        for a in range(0, len(rows), 64):
            yield pa.RecordBatch.from_pylist(rows[a:a + 64], row)
        block += 1


def _pack(n, doc, freq):
    """Pairs per word (1 byte each: at most LOCAL_DOCS), documents (2 bytes
    each) and frequencies (4 bytes each) of a row's words."""
    import numpy as np

    return b"".join((np.uint32(len(n)).tobytes(), n.astype(np.uint8).tobytes(), doc.astype(np.uint16).tobytes(),
                     freq.astype(np.uint32).tobytes()))


def _unpack(packed):
    import numpy as np

    k = int(np.frombuffer(packed, np.uint32, 1)[0])
    n = np.frombuffer(packed, np.uint8, k, 4).astype(np.int64)
    m = int(n.sum())
    return n, np.frombuffer(packed, np.uint16, m, 4 + k).astype(np.int64), np.frombuffer(packed, np.uint32, m, 4 + k + 2 * m).astype(np.int64)


def _count_pieces(batches, spec, id_type):
    """Joins pieces to frequencies: all rows of a bucket are here, so each
    distinct pre-token is counted once; gives sums per block and bucket."""
    import numpy as np
    import pyarrow as pa

    tok = _tokenizer(spec)
    known: dict[str, int] = {}
    row = pa.schema([("block", pa.int64()), ("sums", pa.binary()), ("ids", pa.list_(id_type)), ("n_bytes", pa.list_(pa.int64()))])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["words"] is None:
                out.append({"block": r["block"], "sums": r["packed"], "ids": r["ids"], "n_bytes": r["n_bytes"]})
                continue
            new = [w for w in r["words"] if w not in known]
            if len(known) + len(new) > 2_000_000:  # memory bound; at worst a word is counted again
                known.clear()
                new = r["words"]
            known.update(zip(new, (len(e.ids) for e in tok.encode_batch(new, add_special_tokens=False))))
            n, doc, freq = _unpack(r["packed"])
            total = np.bincount(doc, weights=np.repeat([known[w] for w in r["words"]], n) * freq, minlength=0)
            at = np.flatnonzero(total)
            sums = at.astype(np.uint16).tobytes() + total[at].astype(np.uint32).tobytes()
            out.append({"block": r["block"], "sums": sums, "ids": None, "n_bytes": None})
        yield pa.RecordBatch.from_pylist(out, row)


def _sum_blocks(batches, id_type, limit, names):
    """All rows of a block meet here; its vector of sums is bounded."""
    import numpy as np
    import pyarrow as pa

    sums: dict[int, object] = {}
    heads: dict[int, tuple] = {}
    for batch in batches:
        for r in batch.to_pylist():
            total = sums.setdefault(r["block"], np.zeros(BLOCK_DOCS, np.int64))
            if r["ids"] is not None:
                heads[r["block"]] = r["ids"], r["n_bytes"]
                local = np.frombuffer(r["sums"], np.int64)
                total[:len(local)] += local
            else:
                k = len(r["sums"]) // 6
                total[np.frombuffer(r["sums"], np.uint16, k)] += np.frombuffer(r["sums"], np.uint32, k, 2 * k)
    for b, (ids, n_bytes) in heads.items():
        n = sums.pop(b)[:len(ids)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(n_bytes, pa.int64()), pa.array(n), pa.array(n > limit)], names)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_bytes (UTF-8), n_tokens as the
    ``tokenizers`` file at ``tokenizer_path`` gives them without added special
    tokens, and over_limit (n_tokens > limit)."""
    from pyspark.sql.pandas.types import to_arrow_type

    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    specials = sorted((t["content"] for t in json.loads(content)["added_tokens"]), key=len, reverse=True)
    spec = docs.sparkSession.sparkContext.broadcast(content)  # one vocabulary file: its size is fixed
    field = docs.schema[id_col]
    id_type = to_arrow_type(field.dataType)
    head = [T.StructField("ids", T.ArrayType(field.dataType)), T.StructField("n_bytes", T.ArrayType(T.LongType()))]
    block = T.StructField("block", T.LongType())
    n_buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inverted = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        lambda it: _invert(it, spec, specials, id_type, n_buckets),
        T.StructType([T.StructField("bucket", T.LongType()), block, T.StructField("words", T.ArrayType(T.StringType())),
                      T.StructField("packed", T.BinaryType()), *head]))
    counted = inverted.repartition("bucket").mapInArrow(
        lambda it: _count_pieces(it, spec, id_type), T.StructType([block, T.StructField("sums", T.BinaryType()), *head]))
    names = [id_col, "n_bytes", "n_tokens", "over_limit"]
    return counted.repartition("block").mapInArrow(
        lambda it: _sum_blocks(it, id_type, limit, names),
        T.StructType([T.StructField(id_col, field.dataType), T.StructField("n_bytes", T.LongType()),
                      T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]))
