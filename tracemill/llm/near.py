"""N-gram Jaccard join over a token-group matrix, exact.

1. A text becomes the set of its word shingles (64-bit hashes, "tokens"); texts with equal sets are one node.
   A block of documents deals its tokens to buckets, packed; a bucket counts how many blocks' sets hold a
   token. A token of one set alone is in no overlap: only tokens of several sets go back, and only sets whose
   share of such tokens leaves a link possible are kept. Most documents end here.
2. The sets are partitioned into groups of similar ones: a set goes to the block that its first token in a
   random order names (an order in which wider spread tokens come earlier, so that near copies agree). A block
   of more than BLOCK sets is split.
3. A block is a token-group matrix: its sets lie in groups, and for each token the groups whose union holds it
   are stored. The number of a query's tokens in a group's union bounds its overlap with each member; only
   groups where a link stays possible are opened. The sets of a block are connected first through the set that
   shares most, and those that do not link with it are queries. What is connected is a cell.
4. One set of each cell is grouped anew by another order, so that cells of one family meet without all their
   sets.
5. Of two sets that link, the rarest tokens (as many as may be missing, and one) have one in common. So a cell
   is a query to another block only if it shares such a token with it, sizes fit and both are not connected yet.
   The queries go to the block's matrix, in parts of BLOCK, and only links that connect something leave the task.
6. Links are contracted to components by alternating stars.

Nothing is sampled or capped, and no pair that can link is skipped unless both are connected already. A task
holds one bucket, the kept tokens of one block of documents, or one block of sets at a time.

Blocks of documents are made once and shuffled, not written; docs must give the same rows in the same order when
a task runs again, as a scan of files does. If a rerun made other blocks, the job fails: it checks that each
block of documents came back whole.

Defined results: null text and text without words has an empty set, 0 shingles and links with nothing;
fewer words than a shingle form one; repeated rows are in one component; null doc_ids take part but
never name a component that has another; an empty table gives an empty result; further columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, remove, save, table, tidy

#: Production parameters; WORDS and PERCENT hold unless a caller asks for others.
WORDS, PERCENT = 5, 80
#: Sets of a block and tokens of all its sets, about; queries that one task compares with it as the first; sets of a group of its matrix.
BLOCK, BLOCK_TOKENS, GROUP = 4096, 4_000_000, 64
#: Measured bytes up to which lists of sets (not their tokens) are broadcast, so that the tokens move to their blocks only.
BROADCAST_BYTES = 16 << 20
#: Tokens of a block of documents (one document more at most), and buckets of tokens for each shuffle partition.
DOC_TOKENS, BUCKETS = 2_000_000, 2
#: Random orders by which sets are grouped.
ORDERS = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Word to hash; forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


_HASHES = _WordHashes()


def _forget() -> None:
    _HASHES.clear()


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    m = len(words) - n + 1
    acc = h[:m]
    for j in range(1, n):
        acc = _mixed(acc + _ODD) + h[j : j + m]
    acc = np.sort(_mixed(acc))
    return acc[np.append(True, acc[1:] != acc[:-1])]


def node_of(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set; 0 for the empty one."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()) | 1))) if len(tokens) else 0


def _planes(x: np.ndarray) -> bytes:
    """Numbers by planes of bytes, for a codec to find the even ones."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel() if raw else np.empty(0, kind)


def _arrays(raw: bytes, kinds: str) -> list[np.ndarray]:
    """Columns of equal length, packed one after the other by planes; kinds: the bytes of each column's numbers."""
    width = sum(map(int, kinds))
    n, at, out = len(raw) // width, 0, []
    for w in map(int, kinds):
        out.append(_numbers(raw[at : at + n * w], f"<u{w}"))
        at += n * w
    return out


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges [start, end), one range after the other."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


# --- 1. Sets that can link -------------------------------------------------------------------------------------------

PARTS = "kind int, bucket int, block bigint, doc_id bigint, key binary, node bigint, size bigint, place int, data binary"


def _dealt(docs: DataFrame, words: int, key: str | None, buckets: int, tokens: int) -> DataFrame:
    """kind 0: a row per document, its set's node, size and place in its block, which is below 0 where the block has
    the set already; kind 1: a row per block and bucket, the tokens as steps with their sets' places."""
    schema = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in PARTS.split(", "))])

    def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def block_of(number: int, ids: list, keys: list, nodes: list, sizes: list, places: list, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        name = xxhash.xxh3_64_intdigest(f"{TaskContext.get().partitionId()}:{number}:".encode() + np.array(nodes, np.int64).tobytes())
        block = int(np.array(name, np.uint64).view(np.int64))
        n = len(nodes)
        spread = pa.array((np.arange(n) % buckets).astype(np.int32))
        yield rows(
            n, kind=pa.array(np.zeros(n, np.int32)), bucket=spread, block=pa.array(np.full(n, block)), doc_id=pa.array(ids, pa.int64()), key=pa.array(keys, pa.binary()),
            node=pa.array(nodes, pa.int64()), size=pa.array(sizes, pa.int64()), place=pa.array(places, pa.int32()),
        )
        if not sets:
            return
        flat, place = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), list(map(len, sets)))
        sets.clear()
        order = np.argsort(flat)
        flat, place = flat[order], place[order]
        del order
        # A bucket is a range of tokens: bucket k begins at the least token whose upper half, times buckets, reaches k << 32.
        edges = np.array([-(-(k << 32) // buckets) << 32 for k in range(buckets)], np.uint64)
        starts = [*np.searchsorted(flat, edges).tolist(), len(flat)]
        codec = zstandard.ZstdCompressor(level=1)
        used = [k for k in range(buckets) if starts[k] < starts[k + 1]]
        data = []
        for k in used:
            own = slice(starts[k], starts[k + 1])
            # 56 bits of a token are enough to tell it apart; equal tokens stay equal.
            data.append(codec.compress(_planes(np.diff(flat[own] >> np.uint64(8), prepend=np.uint64(0))) + _planes(place[own])))
        n = len(used)
        yield rows(n, kind=pa.array(np.ones(n, np.int32)), bucket=pa.array(used, pa.int32()), block=pa.array(np.full(n, block)), data=pa.array(data, pa.binary()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, at, full = 0, ([], [], [], [], [], []), {}, 0
        for batch in batches:
            keys = batch.column(2).to_pylist() if key else [None] * len(batch)
            for doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1), keys):
                found = shingles(text.as_py(), words)
                node = node_of(found)
                new = node != 0 and node not in at
                if new:
                    at[node] = len(at)
                    held[5].append(found)
                    full += len(found)
                for column, x in zip(held, (doc_id, own, node, len(found), at[node] if new else -1)):
                    column.append(x)
                if full >= tokens or len(held[0]) >= 50_000:
                    yield from block_of(number, *held)
                    number, held, at, full = number + 1, ([], [], [], [], [], []), {}, 0
        if held[0]:
            yield from block_of(number, *held)

    return docs.select("doc_id", "text", *([key] if key else [])).mapInArrow(tidy(work, _forget), PARTS)


def _met(parts: DataFrame) -> DataFrame:
    """Rows of kind 0 as they are; of kind 1 with the tokens that several sets hold (token, place, number of sets), and size as the number of all."""
    kept = ("block", "doc_id", "key", "node", "size", "place", "data")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, out = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        last, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            token, place = (np.concatenate(x) for x in zip(*(x[1] for x in held)))
            n = np.array([len(x[1][0]) for x in held])
            order = np.argsort(token)
            new = np.append(True, token[order][1:] != token[order][:-1])
            count = np.diff(np.append(np.flatnonzero(new), len(order)))[np.cumsum(new) - 1]
            df = np.empty(len(order), np.uint32)
            df[order] = np.minimum(count, 0xFFFFFFFF)
            live = np.flatnonzero(df > 1)  # by list, as the lists came
            ends = np.searchsorted(live, np.cumsum(n))
            token, place, df = token[live], place[live], df[live]
            data = [out.compress(_planes(token[a:b]) + _planes(place[a:b]) + _planes(df[a:b])) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            k = len(held)
            none = pa.nulls(k, pa.int64())
            columns = [pa.array(np.ones(k, np.int32)), pa.array([x[0] for x in held], pa.int64()), none, pa.nulls(k, pa.binary()), none, pa.array(n.astype(np.int64)), pa.nulls(k, pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", *kept])

        for batch in batches:
            kind = batch.column("kind").to_numpy()
            docs = batch.filter(pa.array(kind == 0))
            if len(docs):
                yield pa.RecordBatch.from_arrays([docs.column(n) for n in ("kind", *kept)], names=["kind", *kept])
            lists = batch.filter(pa.array(kind == 1))
            for k, block, data in zip(lists.column("bucket").to_pylist(), lists.column("block").to_pylist(), lists.column("data")):
                if k != last:
                    yield from done()
                    last, held = k, []
                step, place = _arrays(into.decompress(data.as_py()), "84")
                held.append((block, (np.cumsum(step, dtype=np.uint64), place)))
        yield from done()

    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(work), "kind int, block bigint, doc_id bigint, key binary, node bigint, size bigint, place int, data binary")


SET = "node bigint, size bigint, prefix int, orders array<bigint>, tokens binary"


def _possible(lists: DataFrame, nodes: DataFrame, percent: int, orders: int) -> DataFrame:
    """The sets that can link: tokens that other sets hold, the rarest first. prefix: how many of these, so that sets that
    link have one of them in common. orders: the set's first token by several random orders."""
    firsts = nodes.where("place >= 0")
    # A set of several blocks comes from one of them.
    own = firsts.groupBy("node").agg(F.min(F.struct("block", "place", "size")).alias("at"))
    own = own.groupBy("at.block").agg(F.collect_list(F.struct("at.place", "node", "at.size")).alias("sets"))
    heads = firsts.groupBy("block").agg(F.sum("size").alias("total")).join(own, "block", "left")
    rows = lists.select("block", "size", "data", F.lit(None).cast("array<struct<place:int,node:bigint,size:bigint>>").alias("sets"))
    rows = rows.unionAll(heads.select("block", -F.col("total"), F.lit(None).cast("binary"), "sets"))
    seeds = [np.uint64(xxhash.xxh3_64_intdigest(b"order", seed=k)) for k in range(orders)]

    def of_block(sets: list, data: list) -> Iterator[tuple]:
        token, place, df = (np.concatenate(x) for x in zip(*data))
        order = np.lexsort((token, place))
        token, place, df = token[order], place[order], df[order]
        who = np.array([s["place"] for s in sets])
        start, end = np.searchsorted(place, who), np.searchsorted(place, who, side="right")
        for s, a, b in zip(sets, start.tolist(), end.tolist()):
            need = -(-percent * s["size"] // 100)
            if b - a < max(need, 1):
                continue
            t, at = np.unique(token[a:b], return_index=True)
            d = df[a:b][at]
            weight = np.log2(d + 1.0)
            first = [int(t[np.argmin(-np.log((_mixed(t ^ seed) >> np.uint64(11)) * 2.0**-53 + 2.0**-60) / weight)]) for seed in seeds]
            t = t[np.lexsort((t, d))]
            yield s["node"], s["size"], len(t) - need + 1, first, t.tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()
        last, held, sets, total = None, [], None, 0
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())

        def done() -> Iterator[pa.RecordBatch]:
            if total:
                raise ValueError("a block of documents is not whole: docs gave other rows when a task ran again")
            if sets and held and (found := list(of_block(sets, held))):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], names=["node", "size", "prefix", "orders", "tokens"])

        for batch in batches:
            for block, size, data, own in zip(*(c.to_pylist() for c in batch.columns)):
                if block != last:
                    yield from done()
                    last, held, sets, total = block, [], None, 0
                total += size
                if data is None:
                    sets = own
                else:
                    held.append(_arrays(codec.decompress(data), "844"))
        yield from done()

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(work), SET)


# --- 2., 3. Blocks and their token-group matrix ----------------------------------------------------------------------


class Matrix:
    """The token-group matrix of some sets: for each token the groups that hold it, and for each of these the members."""

    def __init__(self, sizes: np.ndarray, tokens: list[np.ndarray], group: int, percent: int):
        n = np.array(list(map(len, tokens)))
        self.sizes, self.group, self.percent, groups = sizes, group, percent, -(-len(tokens) // group)
        flat = np.concatenate(tokens)
        order = np.argsort(flat, kind="stable")
        flat, self.members = flat[order], np.repeat(np.arange(len(n), dtype=np.int32), n)[order]
        del order
        new = np.append(True, flat[1:] != flat[:-1])
        self.tokens = flat[new]
        pair = (np.cumsum(new) - 1) * groups + self.members // group
        del flat, new
        new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        self.groups = pair[new] % groups  # of each token, one token after the other
        self.at = np.searchsorted(pair[new] // groups, np.arange(len(self.tokens) + 1))
        self.starts = np.append(new, len(pair))  # a token's members in a group
        self.low, self.high = (f.reduceat(sizes, np.arange(0, len(sizes), group)) for f in (np.minimum, np.maximum))

    def links(self, size: int, tokens: np.ndarray) -> np.ndarray:
        """The members that link with a set."""
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        hit = at[self.tokens[at] == tokens]
        cell = _ranges(self.at[hit], self.at[hit + 1])
        bound = np.minimum(np.bincount(self.groups[cell], minlength=len(self.low)), self.high)
        p = self.percent
        is_open = (bound * (100 + p) >= p * (size + self.low)) & (100 * bound >= p * size)
        cell = cell[is_open[self.groups[cell]]]
        if not len(cell):
            return cell
        overlap = np.bincount(self.members[_ranges(self.starts[cell], self.starts[cell + 1])], minlength=len(self.sizes))
        return np.flatnonzero((overlap * (100 + p) >= p * (size + self.sizes)) & (overlap > 0))

    def shares(self, tokens: list[np.ndarray]) -> np.ndarray:
        """For each member how widely its tokens are shared, for its size."""
        count = np.diff(self.starts[self.at])
        return np.array([count[np.searchsorted(self.tokens, t)].sum() for t in tokens]) / self.sizes


class Union(dict):
    """Union-find whose roots are the smallest."""

    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = self.get(up, up)
            x = self[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)
        return a != b


def _cells(nodes: list[int], sizes: np.ndarray, tokens: list[np.ndarray], group: int, percent: int) -> Iterator[tuple[list[int], int]]:
    """The places of each connected cell of a block, and of the one that shares most."""
    if len(nodes) == 1:
        yield [0], 0
        return
    matrix, found = Matrix(sizes, tokens, group, percent), Union()
    shares = matrix.shares(tokens)
    pivot = int(np.argmax(shares))
    near = set(matrix.links(int(sizes[pivot]), tokens[pivot]).tolist())
    for y in near:
        found.join(pivot, y)
    for x in range(len(nodes)):
        if x not in near:
            for y in matrix.links(int(sizes[x]), tokens[x]).tolist():
                found.join(x, y)
    cells: dict[int, list[int]] = {}
    for x in range(len(nodes)):
        cells.setdefault(found.find(x), []).append(x)
    for own in cells.values():
        yield own, max(own, key=shares.__getitem__)


CELL = "block bigint, cell bigint, most bigint, low bigint, high bigint, prefix array<bigint>, members array<bigint>"


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """rows, written, and broadcast in joins if they are few."""
    rows = save(rows, name)
    return F.broadcast(rows) if rows.count() * 64 <= BROADCAST_BYTES else rows


def _in_blocks(sets: DataFrame, order: int, percent: int, block: int, group: int) -> DataFrame:
    """The cells of sets that are grouped by their first token in an order."""
    sets = sets.withColumn("first", F.col("orders")[order])
    full = F.greatest(F.count("*") / block, F.sum(F.octet_length("tokens")) / (8 * BLOCK_TOKENS))
    parts = _listed(sets.groupBy("first").agg(F.ceil(full).alias("parts")).where("parts > 1"), "near-parts")
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    rows = sets.join(parts, "first", "left").select(F.xxhash64("first", part).alias("block"), "node", "size", "prefix", "orders", "tokens")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            held.sort(key=lambda r: (r[3][1:], r[1]))  # similar sets lie together
            nodes, tokens = [r[0] for r in held], [np.frombuffer(r[4], np.uint64) for r in held]
            out = []
            for own, most in _cells(nodes, np.array([r[1] for r in held], np.int64), tokens, group, percent):
                prefix = np.unique(np.concatenate([tokens[k][: held[k][2]] for k in own])).view(np.int64)
                size = [held[k][1] for k in own]
                out.append((last, min(nodes[k] for k in own), nodes[most], min(size), max(size), prefix, [nodes[k] for k in own]))
            kinds = (*[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["block", "cell", "most", "low", "high", "prefix", "members"])

        for batch in batches:
            for name, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if name != last:
                    yield from done()
                    last, held = name, []
                held.append(row)
        yield from done()

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(work), CELL)


# --- 4., 5. Between blocks -------------------------------------------------------------------------------------------


def _queries(cells: DataFrame, percent: int) -> DataFrame:
    """cell, to: the blocks in which a cell's sets can have a link that connects something; cells have root."""
    routes = cells.select("block", "cell", "root", "low", "high", F.explode("prefix").alias("token"))
    there = routes.groupBy("token", F.col("block").alias("to")).agg(F.min("low").alias("low2"), F.max("high").alias("high2"), F.min("root").alias("root1"), F.max("root").alias("root2"))
    fits = (F.col("block") < F.col("to")) & (F.col("low") * percent <= F.col("high2") * 100) & (F.col("low2") * percent <= F.col("high") * 100)
    apart = (F.col("root") != F.col("root1")) | (F.col("root") != F.col("root2"))
    return routes.join(there, "token").where(fits & apart).select("cell", "to").distinct()


def _between(cells: DataFrame, sets: DataFrame, percent: int, block: int, group: int) -> DataFrame:
    """Links (a, b) of roots that connect sets of different blocks."""
    queries = _queries(cells, percent).join(cells.select("cell", "root", F.explode("members").alias("node")), "cell").select(F.col("to").alias("block"), "root", "node")
    queries = save(queries, "near-queries")
    parts = queries.groupBy("block").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    asked = cells.select("block", "root", F.explode("members").alias("node")).join(parts, "block")
    asked = asked.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "root", "node")
    asking = queries.join(parts, "block").select("block", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), "root", "node")
    wanted = _listed(asked.unionAll(asking), "near-wanted")
    rows = wanted.join(sets.select("node", "size", F.col("orders")[1].alias("first"), "tokens"), "node")
    rows = rows.select("block", "part", "kind", "first", "root", "size", "tokens")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, matrix, found = None, [], None, Union()
        for batch in batches:
            out = []
            for name, part, kind, _, root, size, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if (name, part) != last:
                    last, held, matrix, found = (name, part), [], None, Union()
                if not kind:
                    held.append((root, size, tokens))
                    continue
                if matrix is None:  # the queries come after the members
                    matrix = Matrix(np.array([r[1] for r in held], np.int64), [np.frombuffer(r[2], np.uint64) for r in held], group, percent)
                for y in matrix.links(size, np.frombuffer(tokens, np.uint64)).tolist():
                    if found.join(root, held[y][0]):
                        out.append((root, held[y][0]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    return rows.repartition("block", "part").sortWithinPartitions("block", "part", "kind", "first").mapInArrow(tidy(work), "a bigint, b bigint")


# --- 6. Components ---------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of the edges (a, b) but the roots, by alternating large and small stars."""
    spark = edges.sparkSession

    def put(df: DataFrame) -> str:
        df.write.parquet(path := fresh_path(spark, "near-star"))
        return path

    path, before = put(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        e = spark.read.schema("u bigint, v bigint").parquet(path)
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v")))
        path, old = put(small.distinct()), path
        remove(spark, old)


def _rooted(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """cells with root brought up to date by roots (node, root)."""
    new = roots.select(F.col("node").alias("root"), F.col("root").alias("new"))
    return cells.join(new, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str | None = None, block: int = BLOCK, group: int = GROUP, tokens: int = DOC_TOKENS) -> DataFrame:
    """doc_id, node, size, root (the smallest node that links reach) and key, if given, for each row of docs (doc_id, text, key).

    key: a binary column that is carried along."""
    spark = docs.sparkSession
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "near-met")
    _met(_dealt(docs, words, key, buckets, tokens)).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    kind = "block bigint, doc_id bigint, key binary, node bigint, size bigint, place int, data binary, kind int"
    met = spark.read.schema(kind).parquet(path)
    nodes = met.where("kind = 0").drop("data", "kind")
    sets = save(_possible(met.where("kind = 1"), nodes, percent, ORDERS), "near-sets")
    remove(spark, f"{path}/kind=1")
    cells = save(_in_blocks(sets, 0, percent, block, group).withColumn("root", F.col("cell")), "near-cells")
    for order in range(1, ORDERS):
        most = cells.select("root", F.col("most").alias("node"))
        met_again = _in_blocks(_listed(most.select("node"), "near-most").join(sets, "node"), order, percent, block, group).where(F.size("members") > 1)
        pairs = met_again.select("cell", F.explode("members").alias("node")).join(most, "node")
        pairs = pairs.select(F.col("cell").alias("node"), F.col("root").alias("b")).join(most, "node")
        cells = save(_rooted(cells, components(pairs.select(F.col("root").alias("a"), "b"))), "near-cells")
    roots = components(_between(cells, sets, percent, block, group))
    found = _rooted(cells.select("root", "members"), roots).select("root", F.explode("members").alias("node"))
    out = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return out.select("doc_id", "node", "size", "root", *([F.col("key").alias(key)] if key else []))


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, **sizes: int) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) for each row of docs (doc_id, text)."""
    rows = linked(docs, words, percent, **sizes)
    lowest = rows.where("node != 0").groupBy("root").agg(F.min("doc_id").alias("lowest"))
    return rows.join(lowest, "root", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.coalesce("lowest", "doc_id")).alias("component_id")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)


SQL = None
