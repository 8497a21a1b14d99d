"""Media columns: content-defined chunks of payloads, stored once each, and media rebuilt from ordered chunk lists.

A medium is an 8-bit mono WAVE file: a header, and the payload as its samples. Its stored form is kept in two tables: packs
hold a medium's header, its payload's ordered chunk list and the bytes of the chunks that no other payload has; the chunk
table holds every shared chunk once. So only shared chunks travel when media are rebuilt.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somatica.llm.common import MOST_BITS, bit_words, materialise, slices

_RATE = 8000
#: Bytes of the header.
_HEADER = 44
_GEAR = np.random.default_rng(20240601).integers(0, 1 << 32, 256, np.uint32)


@dataclass(frozen=True)
class Chunking:
    """Cuts fall where the top ``bits`` of the gear hash of the last 32 bytes are zero, chunks being ``least`` to ``most`` bytes."""

    bits: int = 10
    least: int = 256
    most: int = 8192


def payload_of(text: bytes | None) -> bytes:
    """UTF-8 bytes, filled with zeros to a positive multiple of 64."""
    text = text or b""
    return text + bytes(-len(text) % 64 if text else 64)


def wave_header(n: int) -> bytes:
    """Header of an 8-bit mono WAVE file with ``n`` (even) samples."""
    u4, u2 = (lambda x: int(x).to_bytes(4, "little")), (lambda x: int(x).to_bytes(2, "little"))
    return b"RIFF" + u4(36 + n) + b"WAVEfmt " + u4(16) + u2(1) + u2(1) + u4(_RATE) + u4(_RATE) + u2(1) + u2(8) + b"data" + u4(n)


def samples_of(medium: bytes) -> bytes:
    """Samples of a WAVE file as ``wave_header`` begins it; ValueError where the header does not fit."""
    n = len(medium) - _HEADER
    if n < 0 or medium[:_HEADER] != wave_header(n):
        raise ValueError("not an 8-bit mono WAVE file of this kind")
    return medium[_HEADER:]


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling gear hash (window of 32 bytes, modulo 2**32) at every byte, by doubling."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s] << np.uint32(s)
    return h


def chunk_lengths(payloads: list[bytes], how: Chunking) -> list[list[int]]:
    """Lengths of the chunks of each payload. A cut depends on bytes of its own payload only (``least`` >= 32)."""
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    cuts = np.flatnonzero(gear_hashes(joined) >> np.uint32(32 - how.bits) == 0) + 1
    ends = np.cumsum([len(p) for p in payloads])
    sides = np.searchsorted(cuts, np.concatenate(([0], ends)), "right").tolist()
    out = []
    for k, (end, p) in enumerate(zip(ends.tolist(), payloads, strict=True)):
        at = last = end - len(p)
        lengths = []
        for c in cuts[sides[k] : sides[k + 1]].tolist():
            while c - last > how.most:
                lengths.append(how.most)
                last += how.most
            if c - last >= how.least and c < end:
                lengths.append(c - last)
                last = c
        while end - last > how.most:
            lengths.append(how.most)
            last += how.most
        lengths.append(end - last)
        out.append(lengths)
        assert sum(lengths) == end - at
    return out


def features(samples: bytes) -> str:
    """Samples, mean, root mean square about 128 and zero crossings of the signal, as one string."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"samples={len(x)};mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};crossings={crossings}"


_CHUNKS = pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32())]))
_LISTED = pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("shared", pa.bool_())]))
_STORE = "kind string, key binary, chunks array<struct<digest:binary,size:int,shared:boolean>>, data binary"


def _chunked(texts: list[bytes | None], how: Chunking):
    """Digest of the medium, payload and ordered chunk list of each text."""
    payloads = [payload_of(t) for t in texts]
    for p, sizes in zip(payloads, chunk_lengths(payloads, how), strict=True):
        at, own = 0, []
        for n in sizes:
            own.append({"digest": hashlib.blake2b(p[at : at + n], digest_size=16).digest(), "size": n})
            at += n
        yield hashlib.sha256(wave_header(len(p)) + p).digest(), p, own


def _manifests(how: Chunking):
    """(doc_id, text) to the medium's digest and ordered chunk list."""

    def run(batches):
        for batch in batches:
            for i, j, texts in slices(batch.column(1).cast(pa.binary())):
                found = list(_chunked(texts, how))
                n = pa.array([len(t or b"") for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), n, pa.array([k for k, *_ in found], pa.binary()), pa.array([c for *_, c in found], _CHUNKS)], ["doc_id", "n_bytes", "medium", "chunks"])

    return run


def _probes(digest: bytes, bits: int) -> tuple[int, int, int]:
    return tuple(int.from_bytes(digest[k : k + 4], "big") % bits for k in (0, 4, 8))


def repeat_filter(repeated: DataFrame) -> np.ndarray:
    """Bloom filter of the digests in ``repeated``: 16 bits for each, 8 MB at most, as an array of bytes.

    It is put together in Spark and reaches the driver as one row. Where it is full it lets more digests pass, which only
    sends more payloads the longer way.
    """
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (16 * repeated.count()).bit_length()))
    at = F.explode(F.array(*[F.conv(F.hex(F.substring("digest", 4 * k + 1, 4)), 16, 10).cast("long") % bits for k in range(3)]))
    words = bit_words(repeated.select(at.alias("at")), bits).toArrow().column(0).combine_chunks()
    return words.values.to_numpy().astype("<i8").view(np.uint8).copy()


def _packed(how: Chunking, repeats):
    """Texts to media with their chunk lists, compressed. Those without any chunk that may be repeated are finished packs;
    the others are ``loose``, each of them once per task."""

    def run(batches):
        table, pack, seen = repeats.value, zstandard.ZstdCompressor(level=3), set()
        bits = 8 * len(table)
        for batch in batches:
            for _, _, texts in slices(batch.column(0).cast(pa.binary())):
                rows = []
                for key, p, chunks in _chunked(texts, how):
                    kind = "loose" if any(all(table[k >> 3] >> (k & 7) & 1 for k in _probes(c["digest"], bits)) for c in chunks) else "pack"
                    if kind == "loose":
                        if key in seen:
                            continue
                        if len(seen) >= 300_000:  # bounds memory; what is sent twice is dropped later
                            seen.clear()
                        seen.add(key)
                    rows.append((kind, key, [c | {"shared": False} for c in chunks], pack.compress(wave_header(len(p)) + p)))
                yield _store_batch(rows)

    return run


def _store_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds, keys, lists, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.binary()), pa.array(lists, _LISTED), pa.array(data, pa.binary())], ["kind", "key", "chunks", "data"])


def _stored(batches):
    """Loose media, their chunk lists and what is known of shared chunks (place, whether the medium owns it) to rows of the
    store: one pack each, and the shared chunks that it owns."""
    unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for i, j, data in slices(batch.column(1)):
            rows = []
            keys, lists, marked = (batch.column(k).slice(i, j - i).to_pylist() for k in (0, 2, 3))
            for key, packed, chunks, marks in zip(keys, data, lists, marked, strict=True):
                if marks:
                    shared = {m["at"]: m["owner"] for m in marks}
                    whole, at = unpack.decompress(packed), _HEADER
                    own = [whole[:at]]
                    for k, c in enumerate(chunks):
                        raw = whole[at : at + c["size"]]
                        at += c["size"]
                        c["shared"] = k in shared
                        if k not in shared:
                            own.append(raw)
                        elif shared[k]:
                            rows.append(("chunk", c["digest"], None, pack.compress(raw)))
                    packed = pack.compress(b"".join(own))
                rows.append(("pack", key, chunks, packed))
            yield _store_batch(rows)


_MEASURED = {"medium": pa.binary(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def measured(medium: bytes) -> tuple:
    """What is reported of a stored medium, from its bytes alone."""
    samples = samples_of(medium)
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(medium), hashlib.sha256(medium).hexdigest(), features(samples)


def _rebuilt(batches):
    """Packs with the shared chunks they name to verified media and what is measured on them."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for i, j, data in slices(batch.column(2)):
            rows = []
            keys, lists, fetched = (batch.column(k).slice(i, j - i).to_pylist() for k in (0, 1, 3))
            for key, chunks, packed, others in zip(keys, lists, data, fetched, strict=True):
                own, at = unpack.decompress(packed), _HEADER
                parts = [own[:at]]
                shared = {c["key"]: unpack.decompress(c["data"]) for c in others or ()}
                for c in chunks:
                    if c["shared"]:
                        parts.append(shared[c["digest"]])
                    else:
                        parts.append(own[at : at + c["size"]])
                        at += c["size"]
                medium = b"".join(parts)
                if hashlib.sha256(medium).digest() != key:
                    raise ValueError(f"medium {key.hex()} does not match its chunks")
                rows.append((key, *measured(medium)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_MEASURED.values())], list(_MEASURED))


def store_media(docs: DataFrame, how: Chunking = Chunking()) -> tuple[DataFrame, DataFrame]:
    """Write the store of the texts of ``docs`` (doc_id, text) and return it with the list of documents.

    The list: doc_id, n_bytes, medium (SHA-256), one row per document. The store: kind (pack or chunk), key (SHA-256 of
    the medium, or the chunk's digest), chunks (the pack's ordered list) and data (zstd: header and own chunks). Equal texts
    have one pack; a chunk that occurs more than once is kept once, by the medium that comes first. Digests travel first; of the media themselves only those with a chunk
    that may be repeated are shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = docs.select("doc_id", "text").mapInArrow(_manifests(how), f"doc_id {kind}, n_bytes long, medium binary, chunks array<struct<digest:binary,size:int>>")
    listed = materialise(listed, "media-list")
    uses = listed.select("medium", F.posexplode("chunks").alias("at", "c")).select("medium", "at", "c.digest")
    place = F.struct("medium", "at")
    heads = uses.groupBy("digest").agg(F.min(place).alias("head"), F.max(place).alias("tail"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = materialise(heads, "media-repeats")
    repeats = docs.sparkSession.sparkContext.broadcast(repeat_filter(heads.select("digest")))
    marks = uses.join(heads.where("head <> tail").select("digest", "head"), "digest").select("medium", F.struct("at", (F.col("head") == place).alias("owner")).alias("m"))
    marks = marks.groupBy("medium").agg(F.collect_set("m").alias("marks")).withColumnRenamed("medium", "key")
    packed = materialise(docs.select("text").mapInArrow(_packed(how, repeats), _STORE), "media-packs", ["kind"])
    loose = packed.where("kind = 'loose'").dropDuplicates(["key"]).join(marks, "key", "left").select("key", "data", "chunks", "marks")
    rest = materialise(loose.mapInArrow(_stored, _STORE), "media-store", ["kind"])
    return packed.where("kind = 'pack'").unionByName(rest), listed.select("doc_id", "n_bytes", "medium")


def rebuild_media(store: DataFrame) -> DataFrame:
    """Media rebuilt from the store's ordered chunk lists, each verified against its digest, and measured.

    Returns medium (SHA-256), payload_bytes, payload_sha256, tail_crc32 (last 64 samples), media_bytes, media_sha256 and feature.
    """
    columns = "medium binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    packs = store.where("kind = 'pack'").select(F.col("key").alias("medium"), "chunks", "data")
    chunks = store.where("kind = 'chunk'").select("key", F.col("data").alias("shared_data"))
    foreign = F.exists("chunks", lambda c: c["shared"])
    none = F.lit(None).cast("array<struct<key:binary,data:binary>>")
    whole = packs.where(~foreign).select("medium", "chunks", "data", none.alias("fetched"))
    wanted = packs.where(foreign).select("medium", F.explode(F.array_distinct(F.transform(F.filter("chunks", lambda c: c["shared"]), lambda c: c["digest"]))).alias("key"))
    fetched = wanted.join(chunks, "key").groupBy("medium").agg(F.collect_list(F.struct("key", F.col("shared_data").alias("data"))).alias("fetched"))
    parted = packs.where(foreign).join(fetched, "medium").select("medium", "chunks", "data", "fetched")
    return whole.mapInArrow(_rebuilt, columns).union(parted.mapInArrow(_rebuilt, columns))


def media_digests(docs: DataFrame, how: Chunking = Chunking()) -> DataFrame:
    """Store every text of ``docs`` as a medium, read the stored media back and measure them.

    Returns doc_id, n_bytes (of the UTF-8 text), payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature. Null and empty texts are 64 zero samples. Equal texts have equal values; repeated rows and null ids
    come back as they came. An empty table gives no rows; other columns are ignored.
    """
    store, listed = store_media(docs, how)
    media = materialise(rebuild_media(store), "media")
    return listed.join(media, "medium").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
