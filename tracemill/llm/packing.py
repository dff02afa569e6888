"""Best-fit packing of tokenised documents with large-item matching.

Documents are tokenised in Arrow batches (a word that a worker knows is not encoded again), ended by id 0, and cut only
where they exceed the capacity. Packing needs the lengths alone: the number of pieces per length, at most
`capacity` rows whatever the input, is planned on the driver. Pieces above a third of the capacity are
matched greedily, largest first with the largest partner that fits, at most two per bin; smaller ones
go by size, largest first, into the tightest gap. The plan consists of runs of equal pieces in equal bins.
Each piece then gets its rank among the pieces of its length (counted per salt, so that a common length is
spread) and finds its run by binary search.

Defined results: null or empty text is the end id alone; repeated rows are packed as often as they occur;
texts are tokenised whole; an empty table gives an empty result; further columns of the documents are kept.
"""

from __future__ import annotations

import bisect
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, save, table, tidy

#: Production parameters.
CAPACITY, END_ID, VOCABULARY, SALTS, SALT_ROWS = 2048, 0, "word_bpe_49k.json", 64, 500_000
MADE = ("piece", "start", "length", "ids", "sequence_id", "offset")
#: Words are split at white space; texts with these go to the tokenizer whole.
_WHOLE = re.compile(r"<\||[\x1c-\x1f]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters and what may follow them: one piece for the tokenizer each, whose bytes its table of printable bytes covers.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?)]*)")


class WordEncoder(dict):
    """Word to ids (little-endian unsigned 32-bit) for a tokenizer whose result never depends on more than a white-space-separated word.

    Plain words go to the tokenizer's model piece by piece, without its normalizer and splitter; other words to
    the tokenizer as they are. Forgets all when it has grown too large."""

    def __init__(self, path: str, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.tokenizer.no_padding(), self.tokenizer.no_truncation()
        self.model, self.pieces = self.tokenizer.model, {}
        # Byte-level vocabularies write the printable bytes of Latin-1 as themselves, the others from U+0100 on.
        other = [x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174)]
        self.printable = {x: 256 + k for k, x in enumerate(other)}

    def _piece(self, piece: str) -> bytes:
        known = self.pieces
        if (ids := known.get(piece)) is None:
            if len(known) >= self.keep:
                known.clear()
            text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.printable)
            known[piece] = ids = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return ids

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if plain := _PLAIN.fullmatch(word):
            ids = self._piece(plain[1].lower())
            if plain[2]:
                ids += self._piece(plain[2])
        else:
            ids = self._whole(word)
        if len(self) >= self.keep:
            self.clear()
        self[word] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.pieces.clear()

    def __call__(self, text: str) -> bytes:
        return self._whole(text) if _WHOLE.search(text) else b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per Python worker; the words that it knows are forgotten at a task's end."""
    return WordEncoder(path)


def tokenised(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """docs without text, a row per piece: piece, start, length, ids (binary)."""
    path = path or vocabulary_path(VOCABULARY)
    keep = [c for c in docs.columns if c not in (*MADE, "text")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                row, piece, start, length, ids = [], [], [], [], []
                for k, text in enumerate(batch.column(0).to_pylist()):
                    data = encode(text or "") + end
                    for p, a in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[a : a + 4 * capacity]
                        row.append(k), piece.append(p), start.append(a // 4), length.append(len(cut) // 4), ids.append(cut)
                index = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(index) for c in batch.columns[1:]), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=[*keep, "piece", "start", "length", "ids"],
                )

    return docs.select("text", *keep).mapInArrow(tidy(work, lambda: encoder(path).forget()), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first bin, pieces per bin, offset), and the number of bins."""
    left, used = dict(counts), dict.fromkeys(counts, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap to (first bin, bins)
    tight: list[int] = []
    bins = 0

    def put(length: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append((length, used[length], first, per, offset))
        used[length] += n
        left[length] -= n

    def gap(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(tight, size)
            gaps[size].append((first, n))

    large = sorted(x for x in counts if 3 * x > capacity)
    for a in reversed(large):
        while left[a] > 0:
            at = bisect.bisect_right(large, min(a, capacity - a)) - 1
            while at >= 0 and left[large[at]] < (2 if large[at] == a else 1):
                at -= 1
            if at < 0:
                n = left[a]
                put(a, n, bins, 1, 0)
                gap(capacity - a, bins, n)
            else:
                b = large[at]
                n = left[a] // 2 if a == b else min(left[a], left[b])
                put(a, n, bins, 1, 0)
                put(b, n, bins, 1, a)
                gap(capacity - a - b, bins, n)
            bins += n
    for s in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[s] > 0:
            at = bisect.bisect_left(tight, s)
            if at < len(tight):
                size = tight[at]
                first, n = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size], tight[at]
            else:
                size, first, n = capacity, bins, -(-left[s] // (capacity // s))
                bins += n
            per = size // s
            m = min(n, left[s] // per)  # bins that take as many as fit
            offset = capacity - size
            if m:
                put(s, m * per, first, per, offset)
                gap(size - per * s, first, m)
            if m < n and 0 < left[s] < per:  # the last few of this size
                rest = left[s]
                put(s, rest, first + m, per, offset)
                gap(size - rest * s, first + m, 1)
                m += 1
            gap(size, first + m, n - m)
    return runs, bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """pieces (with a column length of 1 to capacity) with sequence_id and offset. pieces must be a written table: it is read more than once.

    Pieces of one length are ranked in parts, of about salt_rows each, salts parts at least. All columns are kept, whatever
    their names, but columns named sequence_id and offset are replaced."""
    pieces = pieces.drop("sequence_id", "offset")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    salts = max([salts, *(-(-n // salt_rows) for n in counts.values())])
    runs, _ = plan(counts, capacity)
    names = pieces.columns
    salt, n, prior, rank = (free(x, names) for x in ("salt", "n", "prior", "rank"))
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(*[c for c in ("doc_id", "piece") if c in names] or ["length"]), F.lit(salts)))
    before = salted.groupBy("length", salt).agg(F.count("*").alias(n))
    # One row per length and salt.
    before = before.selectExpr("length", salt, f"sum({n}) OVER (PARTITION BY length ORDER BY {salt}) - {n} AS {prior}")
    order = ", ".join(c for c in ("doc_id", "piece") if c in names) or "length"
    ranked = salted.join(before, ["length", salt]).selectExpr(*[f"`{c}`" for c in names], f"{prior} + row_number() OVER (PARTITION BY length, {salt} ORDER BY {order}) - 1 AS {rank}")
    shift = 1 << 44
    runs.sort()
    keys = np.array([r[0] * shift + r[1] for r in runs], np.int64)
    first_rank, first_bin, per, offset = (np.array([r[k] for r in runs], np.int64) for k in (1, 2, 3, 4))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(names.index("length")).to_numpy(zero_copy_only=False), batch.column(len(names)).to_numpy(zero_copy_only=False)
            run = np.searchsorted(keys, length * shift + rank, side="right") - 1
            n = rank - first_rank[run] if len(run) else rank
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(first_bin[run] + n // per[run]), pa.array(offset[run] + n % per[run] * length)], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    if not runs:
        return pieces.selectExpr("*", "0L AS sequence_id", "0L AS offset")
    return ranked.toDF(*[f"c{k}" for k in range(len(names) + 1)]).mapInArrow(work, schema)  # names with points would not do there


def pack_documents(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenised(docs.select("doc_id", "text")).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(save(pieces, "packing-pieces"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


SQL = None
