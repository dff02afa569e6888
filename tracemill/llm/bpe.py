"""Byte-level BPE by a distinct-word table.

Documents are split into words at boundaries that the tokenizer's own splitting never crosses (from a
character to the white space after it). A block of documents keeps the list of its distinct words, and
each document the positions of its words in that list. A list is dealt to buckets by word, one packed row
per block and bucket, so the words of all blocks meet by bucket: each distinct word is encoded once, and
its ids go back, packed in the same order, to the blocks' lists, where they are joined by position.
Decoding joins the ids of a batch of documents with the id-to-piece table (id, bytes), which the vocabulary file
bounds, in Arrow: ids are dense, so the join takes rows by number; an id that the table lacks is an error.

A block is named by a digest of its list, so that lists and positions, which are computed apart, can only
meet if they agree; a block without its list is an error, never a wrong result. Blocks are bounded in
words; a word that is everywhere comes once per block. A task holds the distinct words of one bucket, and
there are BUCKETS of them for each shuffle partition.

Defined results: null text counts as empty and has no ids; special tokens in a text are their own ids, as
the tokenizers library has it; repeated rows are encoded alike; texts are read whole; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import vocabulary_path

#: Production parameters.
VOCABULARY, BLOCK_WORDS, BUCKETS = "byte_bpe_50k.json", 4_000_000, 8
#: Order of a block's rows after those of its buckets: where its words are, then its documents.
_PLACES, _DOCS = 1 << 30, (1 << 30) + 1
_UNSAFE = re.compile(r"\s[ \n]|\x00")
_SLOW = regex.compile(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+")


def split_words(text: str) -> list[str]:
    """Words with the white space before them."""
    if not text:
        return []
    if _UNSAFE.search(text):
        return _SLOW.findall(text)
    words = text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")
    return words if words[0] else words[1:]


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding(), tokenizer.no_truncation()
    return tokenizer


def piece_table(path: str) -> list[bytes]:
    """The bytes of each id. Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        pieces[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return pieces


class _Block:
    """Documents up to a number of words; texts become positions in the list of the block's words, the commonest first."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.docs: list[tuple] = []
        self.n = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words, ids = split_words(text or ""), self.ids
        self.docs.append((doc_id, np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.uint32, len(words))))
        self.n += len(words)

    def close(self) -> tuple[int, list[str], list[tuple]]:
        count = np.bincount(np.concatenate([x for _, x in self.docs]), minlength=len(self.ids)) if self.ids else np.empty(0, int)
        order = np.argsort(-count, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        words = list(self.ids)
        words = [words[k] for k in order.tolist()]
        digest = xxhash.xxh3_64("\x00".join(words).encode("utf-8", "surrogatepass"), seed=len(words))
        return int(np.int64(np.uint64(digest.intdigest()))), words, [(d, place[x] if len(x) else x) for d, x in self.docs]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list[str], list[tuple]]]:
    block = _Block()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            block.add(doc_id, text.as_py())
            if block.n >= size:
                yield block.close()
                block = _Block()
    if block.docs:
        yield block.close()


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by planes: the upper bytes are nearly always 0."""
    return np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack(parts: list[bytes], codec: zstandard.ZstdCompressor) -> bytes:
    lengths = np.fromiter(map(len, parts), np.uint32, len(parts))
    return codec.compress(len(parts).to_bytes(8, "little") + _planes(lengths) + b"".join(parts))


def _unpack(data: bytes, codec: zstandard.ZstdDecompressor) -> list[bytes]:
    raw = codec.decompress(data)
    at = 8 + 4 * int.from_bytes(raw[:8], "little")
    ends = (at + np.cumsum(_numbers(raw[8:at]), dtype=np.int64)).tolist()
    return [raw[x:y] for x, y in zip([at, *ends], ends)]


def _dealt(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The order of words by bucket and in it by bytes, where each bucket starts in that order, and the words' bytes."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw)) % np.uint64(buckets)
    order = np.array(sorted(range(len(raw)), key=raw.__getitem__), np.int64)
    order = order[np.argsort(bucket[order], kind="stable")]
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64)), raw


def encode(docs: DataFrame, path: str | None = None, block_words: int = BLOCK_WORDS, finish=None, schema: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) per document; or what finish makes of (doc_ids, list of id arrays), of the given schema."""
    path = path or vocabulary_path(VOCABULARY)
    docs = docs.select("doc_id", "text")
    schema = schema or "doc_id bigint, ids array<int>"

    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = "block bigint, part int, doc_id bigint, data binary"
    names = ["block", "part", "doc_id", "data"]

    def rows_of(block: list, part: list, doc_id: list, data: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(data, pa.binary())], names=names)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=3)
        for name, words, _ in _blocks(batches, block_words):
            order, starts, raw = _dealt(words, buckets)
            raw = [raw[k] for k in order.tolist()]
            full = np.flatnonzero(starts[1:] > starts[:-1]).tolist()
            data = [_pack(raw[starts[k] : starts[k + 1]], codec) for k in full]
            yield rows_of([name] * len(full), full, [None] * len(full), data)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=3)
        for name, words, found in _blocks(batches, block_words):
            yield rows_of([name], [_PLACES], [None], [codec.compress(_planes(_dealt(words, buckets)[0]))])
            for at in range(0, len(found), 500):
                part = found[at : at + 500]
                yield rows_of([name] * len(part), [_DOCS] * len(part), [d for d, _ in part], [codec.compress(_planes(x)) for _, x in part])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket: each distinct word is encoded once and its ids go to all blocks that have it."""
        tokenizer, last, ids = _tokenizer(path), None, {}
        packer, unpacker = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                block, part, _, data = (c.to_pylist() for c in batch.columns)
                out = []
                for k, x in zip(part, data):
                    if k != last:
                        last, ids = k, {}
                    words = _unpack(x, unpacker)
                    new = [w for w in words if w not in ids]
                    if new:
                        got = tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in new], add_special_tokens=False)
                        ids.update((w, np.array(g.ids, "<u4").tobytes()) for w, g in zip(new, got))
                    own = list(map(ids.__getitem__, words))
                    count = np.fromiter(map(len, own), np.uint32, len(own)) // 4
                    out.append(packer.compress(len(own).to_bytes(8, "little") + _planes(count) + _planes(np.frombuffer(b"".join(own), "<u4"))))
                yield rows_of(block, part, [None] * len(out), out)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block: its buckets, where their words are in its list, then its documents."""
        codec, name, parts, words = zstandard.ZstdDecompressor(), None, [], []
        done = finish() if finish else None
        for whole in batches:
            for start in range(0, whole.num_rows, 2_000):
                batch = whole.slice(start, 2_000)
                block, part, doc_ids, data = (c.to_pylist() for c in batch.columns)
                out_d, out_i = [], []
                for b, k, d, x in zip(block, part, doc_ids, data):
                    if b != name:
                        name, parts, words = b, [], None
                    raw = codec.decompress(x)
                    if k < _PLACES:
                        if not parts or parts[-1][0] != k:  # equal blocks have equal lists
                            parts.append((k, raw))
                    elif k == _PLACES:
                        if words is None:
                            own = []
                            for _, y in parts:
                                at = 8 + 4 * int.from_bytes(y[:8], "little")
                                ids, ends = _numbers(y[at:]).tobytes(), (4 * np.cumsum(_numbers(y[8:at]), dtype=np.int64)).tolist()
                                own += [ids[p:q] for p, q in zip([0, *ends], ends)]
                            order = _numbers(raw).tolist()
                            if len(order) != len(own):
                                raise ValueError("a block's list and positions differ")
                            words, parts = [b""] * len(own), []
                            for p, y in zip(order, own):
                                words[p] = y
                    else:
                        out_d.append(d)
                        out_i.append(np.frombuffer(b"".join(map(words.__getitem__, _numbers(raw).tolist())), "<u4"))
                if out_d:
                    if done:
                        yield done(out_d, out_i)
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(out_d, pa.int64()), pa.array([x.astype(np.int32) for x in out_i], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    listed = docs.mapInArrow(lists, row).repartition("part").sortWithinPartitions("part")
    rows = listed.mapInArrow(encoded, row).union(docs.mapInArrow(positions, row))
    return rows.repartition("block").sortWithinPartitions("block", "part").mapInArrow(joined, schema)


#: Ids that are joined with a table at once.
IDS_AT_ONCE = 1_000_000


def _joined(ids: list[np.ndarray], table: pa.Array, between) -> list:
    """For each array of ids the table's rows of these ids, joined to one value."""
    out, at = [], 0
    while at < len(ids):
        end, n = at + 1, len(ids[at])
        if n > IDS_AT_ONCE:
            out.append(between.join(_joined([ids[at][k : k + IDS_AT_ONCE] for k in range(0, n, IDS_AT_ONCE)], table, between)))
        else:
            while end < len(ids) and n + len(ids[end]) <= IDS_AT_ONCE:
                n += len(ids[end])
                end += 1
            ends = np.concatenate(([0], np.cumsum(list(map(len, ids[at:end]))))).astype(np.int32)
            out += pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), table.take(pa.array(np.concatenate(ids[at:end])))), between).to_pylist()
        at = end
    return out


def decode(ids: list[np.ndarray], pieces: pa.Array) -> list[str]:
    """The texts of arrays of ids, by a join with the id-to-piece table; bytes that are no UTF-8 become U+FFFD."""
    return [x.decode("utf-8", "replace") for x in _joined(ids, pieces, b"")]


def digests(docs: DataFrame, path: str | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    path = path or vocabulary_path(VOCABULARY)

    def finish():
        pieces = pa.array(piece_table(path), pa.binary())
        names = pa.array([str(k) for k in range(len(pieces))], pa.string())

        def done(doc_ids: list, ids: list[np.ndarray]) -> pa.RecordBatch:
            sha, text = [], []
            for at in range(0, len(ids), 200):  # bounds what a batch's strings take
                part = ids[at : at + 200]
                sha += [hashlib.sha256(x.encode()).hexdigest() for x in _joined(part, names, ",")]
                text += [hashlib.sha256(x.encode()).hexdigest() for x in decode(part, pieces)]
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(sha), pa.array(text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return done

    return encode(docs, path, block_words, finish, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


SQL = None
