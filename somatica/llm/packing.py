"""Packing by concatenate and cut: prefix sums over partition totals, then fixed windows."""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatica.llm.common import materialise, prefix_sums, slices

#: Characters on whose kind all versions of Unicode agree: texts with others are encoded as a whole.
_OLD = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*+")
#: Letters, numbers and white space among them.
_LETTER, _NUMBER, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t\n\r "
#: Fixed value: the pattern by which byte-level BPE files of this kind cut a text into words, for these characters.
_WORDS = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Words that a worker remembers before it forgets all.
_MEMO = 600_000

#: Byte-level files write byte b as this character: itself if it can be seen, else one of those from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) if b in _SEEN else chr(256 + b - sum(v < b for v in _SEEN)) for b in range(256)}

_loaded: dict = {}


class _Ids(dict):
    """Ids of words as byte strings, by the library's model where a word is met first."""

    def __init__(self, tokenizer):
        self.model = tokenizer.model

    def __missing__(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()  # of such bytes only the blank is written otherwise
        seen = word.replace(" ", _BYTES[32]) if plain else word.encode().decode("latin-1").translate(_BYTES)
        out = self[word] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(seen)])
        return out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids by ``tokenizers`` for the file at ``path``, without added special tokens, as byte strings of 4-byte numbers.

    A plain byte-level BPE encodes the words of a text one by one, so the library's model is given each word once: its ids are remembered
    (``_MEMO`` words at most, and those of one call) and put together. Texts for which that may not hold, those with a special token or with
    characters beyond Latin, and all texts where the file is of another kind, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of work
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.memo = _Ids(self.own)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        by_word = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.by_word = by_word and model.get("type") == "BPE" and not spec.get("normalizer") and not model.get("dropout") and not spec.get("truncation") and not spec.get("padding")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = [self.by_word and _OLD.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        if len(self.memo) > _MEMO:
            self.memo.clear()
        whole, ids = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p])), self.memo.__getitem__
        return [b"".join(map(ids, _WORDS.findall(t))) if p else next(whole) for t, p in zip(texts, plain, strict=True)]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, loaded once."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _encode(path: str, end_id: int):
    """Batches of (doc_id, text) to documents with their ids and their place among the partition's tokens."""

    def run(batches):
        part, start = TaskContext.get().partitionId(), 0
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for i, j, texts in slices(batch.column(1)):
                ids = [np.frombuffer(raw + end, "<u4") for raw in encode([t or "" for t in texts])]
                n = np.array([len(x) for x in ids], np.int64)
                at = start + np.cumsum(n) - n
                start += int(n.sum())
                wide = max(int(x.max()) for x in ids) >= 1 << 16
                raw = [x.tobytes() if wide else x.astype("<u2").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([part] * (j - i), pa.int64()), pa.array(at), pa.array(n), pa.array([4 if wide else 2] * (j - i), pa.int32()), pa.array(raw, pa.binary())], ["doc_id", "part", "at", "n", "width", "ids"])

    return run


def _cut(length: int, with_ids: bool):
    """Documents with their first global position to the pieces that fixed windows cut."""

    def run(batches):
        for whole, (i, j, raws) in ((b, x) for b in batches for x in slices(b.column(4))):  # small steps bound the memory
            batch, out = whole.slice(i, j - i), [[] for _ in range(8)]
            for doc_id, first, n, width, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), raws, strict=True):
                ids = np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4")
                start = 0
                while start < n:
                    seq, offset = divmod(first + start, length)
                    take = min(length - offset, n - start)
                    piece = ids[start : start + take].tobytes()
                    for c, v in zip(out, (doc_id, start, take, zlib.crc32(piece), n, seq, offset, piece), strict=True):
                        c.append(v)
                    start += take
            arrays = [pa.array(out[0], batch.column(0).type), *(pa.array(c, pa.int64()) for c in out[1:7])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays, names = [*arrays, pa.array(out[7], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Cut the concatenation of all documents of ``docs`` (doc_id, text), each closed by ``end_id``, into sequences.

    Every sequence but the last holds ``length`` tokens, so only the last is padded. Returns one row per piece: doc_id,
    start (tokens of the document before it), length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers),
    doc_tokens, sequence_id, offset (in the sequence) and, where asked for, ids (binary, 4 bytes each).

    The first pass writes the ids with each document's place in its partition; the partitions' totals give each
    partition's first position, and the second pass cuts. Only the totals, a number per partition, meet; the
    texts and ids are never shuffled. Null and empty texts are one ``end_id``. Null ids and repeated rows are packed like
    any others, each row as a document of its own. An empty table gives no rows; other columns are ignored.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, part long, at long, n long, width int, ids binary"
    ids = materialise(docs.select("doc_id", "text").mapInArrow(_encode(path, end_id), schema), "token-ids")
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    bases = prefix_sums(totals, [], "part", "total", "base").select(F.col("part").alias("_part"), "base")
    placed = ids.join(F.broadcast(bases), F.col("part") == F.col("_part"))
    out = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return placed.select("doc_id", (F.col("base") + F.col("at")).alias("first"), "n", "width", "ids").mapInArrow(_cut(length, with_ids), out)
