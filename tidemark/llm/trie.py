"""Prefix tries of conversations, with counts of members, leaves and tokens that sharing a prefix saves.

Turns are reduced to 16-byte labels (digest of role and text) before they move. The rebuilt conversations become paths of labels;
equal paths are combined, then range-partitioned and sorted, so that a trie comes in order of its prefixes. A task cuts its sorted
paths into shards of bounded size and builds each as a succinct trie in level order: a LOUDS bit vector (each node's children in
unary) and an array of labels. Parents come from ranks in the bit vector, and counts are rolled up in reverse level order.

Only the prefixes of a shard's first and last path can go on in another shard. Their sums are merged by prefix, in Spark: these
are the heavy upper levels, since a prefix with more paths than a shard is always among them. What they own themselves
is then added along their ancestors by doubling distances, log2(depth) rounds over these few nodes. So no prefix, however
common, makes a task larger, and a conversation that a third of all repeat is one path.

Ids of the conversations that end at a node are joined in chunks by ranges of ids before they move, and hashed as a stream in order.

Edge cases: rows without conv_id take no part; null role and text count as empty; turns with the same number are ordered by role,
then by digest; a conversation of repeated rows has each of them as a turn; a turnless rebuilt conversation is a member of the root
alone; further columns of any name are left aside; without a conversation there is no root, hence no row. A conversation is held as
24 bytes a turn.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .io import partitions

LABEL = 16
FAMILY, HEADS = 5, 9  # conversations that share a base; turns taken from it are under HEADS
CHUNK = 4096  # ids joined before they move
SHARD = 65_536  # turns of a shard
NOTHING = hashlib.sha256().hexdigest()
KEY = b""  # of the root

PATHS = "conv_id long, path binary, sizes binary"
NODES = "shard binary, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string"
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class Louds:
    """A trie over sorted, distinct paths: bits '10' above the root, then each node's children as ones and a zero, in level order."""

    def __init__(self, labels: np.ndarray, lengths: np.ndarray):
        """labels: (turns, 2) words of all paths, one after the other; lengths: turns of each path."""
        at, shared = np.cumsum(lengths) - lengths, np.zeros(len(lengths), np.int64)
        same, d = np.arange(1, len(lengths)), 0
        while len(same):
            same = same[np.minimum(lengths[same], lengths[same - 1]) > d]
            same = same[(labels[at[same] + d] == labels[at[same - 1] + d]).all(axis=1)]
            d += 1
            shared[same] = d
        fresh = lengths - shared  # nodes that a path adds to those before it
        path = np.repeat(np.arange(len(lengths)), fresh)
        depth = np.arange(len(path)) - np.repeat(np.cumsum(fresh) - fresh, fresh) + np.repeat(shared, fresh) + 1
        order = np.lexsort((path, depth))
        place = np.empty(len(path), np.int64)
        place[order] = np.arange(1, len(path) + 1)
        #: position of each node's label among the turns, -1 for the root
        self.turn = np.concatenate([[-1], (at[path] + depth - 1)[order]]).astype(np.int64)
        self.labels = labels[self.turn[1:]]
        self.depth = np.concatenate([[0], depth[order]]).astype(np.int64)
        #: first node of each level, and the number of nodes behind the last
        self.levels = np.searchsorted(self.depth, np.arange(self.depth[-1] + 2))
        #: the node at which each path ends
        self.ends = np.where(lengths > 0, place[np.cumsum(fresh) - 1] if len(path) else 0, 0)
        self.bits = self._bits(path[order])

    def _bits(self, path: np.ndarray) -> np.ndarray:
        """A node hangs under the last node of the level above whose path isn't after its own."""
        children = np.zeros(len(self.depth), np.int64)
        for above, here, end in zip(self.levels, self.levels[1:], self.levels[2:], strict=False):
            if above == 0:
                children[0] = end - here
            else:
                children[above:here] = np.bincount(np.searchsorted(path[above - 1 : here - 1], path[here - 1 : end - 1], "right") - 1, minlength=here - above)
        bits = np.ones(2 * len(children) + 1, bool)
        bits[1] = False
        bits[1 + np.cumsum(children + 1)] = False
        return bits

    @property
    def parents(self) -> np.ndarray:
        """Node v is the v-th one; the zeros before it end the child lists of the nodes before its parent. -1 for the root."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    @property
    def children(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits)) - 1

    def roll(self, own: np.ndarray, add=np.add) -> np.ndarray:
        """Each node's sum (or other ufunc) over its subtree, in reverse level order."""
        out, parents = own.copy(), self.parents
        for a, b in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            add.at(out, parents[a:b], out[a:b])
        return out

    def find(self, path: np.ndarray) -> int:
        """The node of a path of labels, or -1."""
        first, v = np.concatenate([[1], 1 + np.cumsum(self.children)]), 0
        for label in path:
            hit = np.flatnonzero((self.labels[first[v] - 1 : first[v + 1] - 1] == label).all(axis=1))
            if not len(hit):
                return -1
            v = first[v] + hit[0]
        return int(v)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path and sizes of every conversation: the first turns of its family's base, then its own further ones."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    id_ = F.col("conv_id").cast("long")
    turns = conversations.where("conv_id is not null").select(
        (id_ - id_ % FAMILY).alias("family"), id_.alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, LABEL).alias("label"),
        F.octet_length(text).cast("long").alias("size"),
    )
    dealt = turns.repartition(partitions(conversations.sparkSession), "family")
    ordered = dealt.sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", F.col("turn").asc_nulls_first(), "role", "label")

    def rows(own: int, labels: bytes, sizes: bytes, head: tuple):
        h = zlib.crc32(str(own).encode()) % HEADS
        family = own - (own % FAMILY if own >= 0 else -(-own % FAMILY))
        base, base_sizes = head[1:] if head[0] == family else (b"", b"")
        return own, base[: LABEL * h] + labels[LABEL * h :], base_sizes[: 8 * h] + sizes[8 * h :]

    def build(batches):
        head: tuple = (None, b"", b"")
        now, labels, sizes = None, [], []

        def close():
            nonlocal head
            a, b = b"".join(labels), b"".join(sizes)
            if now % FAMILY == 0:  # the base, which comes first
                head = now, a[: LABEL * HEADS], b[: 8 * HEADS]
            return rows(now, a, b, head)

        for batch in batches:
            ids, size = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            label = b"".join(batch.column(1).to_pylist())
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]]).tolist() if len(ids) else [0]
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if now is not None and ids[a] != now:
                    out.append(close())
                    labels, sizes = [], []
                now = int(ids[a])
                labels.append(label[LABEL * a : LABEL * b])
                sizes.append(size[a:b].tobytes())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["conv_id", "path", "sizes"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(close(), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["conv_id", "path", "sizes"])

    return ordered.select("conv_id", "label", "size").mapInArrow(build, PATHS)


def sorted_paths(paths: DataFrame) -> DataFrame:
    """Distinct paths in order over range partitions, a row for each range of ids that end there."""
    some = paths.groupBy("path", F.floor(F.col("conv_id") / CHUNK).alias("range")).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"), F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"), F.first("sizes").alias("sizes")
    )
    return some.repartitionByRange(partitions(paths.sparkSession), F.substring("path", 1, 64 * LABEL)).sortWithinPartitions("path", "range")


def _distinct(batches) -> Iterator[tuple]:
    """(path, sizes, n, least, digest) of each path; the ids of its chunks are hashed as they come."""
    now, sha = None, None
    for batch in batches:
        for path, n, least, ids, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now and now[0] == path:
                now[2] += n
                now[3] = min(now[3], least)
                sha.update(b"," + ids.encode())
                continue
            if now:
                yield *now, sha.hexdigest()
            now, sha = [path, sizes, n, least], hashlib.sha256(ids.encode())
    if now:
        yield *now, sha.hexdigest()


def _chain(path: bytes) -> list[bytes]:
    """Keys of all prefixes of a path, the root's first."""
    keys = [KEY]
    for k in range(0, len(path), LABEL):
        keys.append(hashlib.blake2b(keys[-1] + path[k : k + LABEL], digest_size=16).digest())
    return keys


def _shard(rows: list[tuple]) -> pa.RecordBatch:
    """The nodes of one shard. Nodes that may go on in other shards have a key; their children by parent key."""
    paths, sizes, n, least, shas = zip(*rows, strict=True)
    lengths = np.array([len(p) // LABEL for p in paths], np.int64)
    trie = Louds(np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2), lengths)
    size = np.frombuffer(b"".join(sizes) or b"\0" * 8, np.int64)[trie.turn]
    size = np.where(trie.turn < 0, 0, size)
    parents, nodes = trie.parents, len(trie.depth)
    ended, lowest = np.zeros(nodes, np.int64), np.full(nodes, np.iinfo(np.int64).max)
    ended[trie.ends], lowest[trie.ends] = n, least
    sha = np.full(nodes, None, object)
    sha[trie.ends] = shas
    members, lowest = trie.roll(ended), trie.roll(lowest, np.minimum)
    keys = np.full(nodes, None, object)
    for path, side in ((paths[0], trie.levels[:-1]), (paths[-1], trie.levels[1:] - 1)):
        chain = _chain(path)
        keys[side[: len(chain)]] = chain
    open_ = keys != None  # noqa: E711  elementwise
    leaves = trie.roll(((trie.children == 0) & ~open_).astype(np.int64))
    saved = trie.roll(np.where(open_, 0, (members - 1) * size))
    closed_children = np.bincount(parents[1:][~open_[1:]], minlength=nodes)
    parent_keys = np.where(parents < 0, None, keys[parents])
    parent_least = pa.array(lowest[parents], mask=(parents < 0) | (parent_keys != None))  # noqa: E711
    shard = hashlib.blake2b(paths[0], digest_size=16).digest()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard] * nodes, pa.binary()), pa.array(keys, pa.binary()), pa.array(parent_keys, pa.binary()), pa.array(lowest), pa.array(trie.depth), parent_least,
            pa.array(members), pa.array(closed_children), pa.array(leaves), pa.array(saved), pa.array(size), pa.array(sha, pa.string()),
        ],
        [c.split()[0] for c in NODES.split(", ")],
    )


def shards(ordered: DataFrame) -> DataFrame:
    """Nodes of all shards."""

    def build(batches):
        rows, turns = [], 0
        for row in _distinct(batches):
            rows.append(row)
            turns += len(row[0]) // LABEL + 1
            if turns >= SHARD:
                yield _shard(rows)
                rows, turns = [], 0
        if rows:
            yield _shard(rows)

    return ordered.select("path", "n", "least", "ids", "sizes").mapInArrow(build, NODES)


def merged(nodes: DataFrame) -> DataFrame:
    """Nodes with a key, once each, with whole sums."""
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    each = nodes.where("key is not null").groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("parent_key", "depth", "size")], F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums], F.max("ends_sha256").alias("ends_sha256")
    )
    kids = each.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("kids"))
    one = each.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids").checkpoint()
    deepest = one.agg(F.max("depth")).first()[0] or 0
    # own leaves and savings of these nodes: after each round a node has those of its descendants within twice the distance
    reach = one.select("key", F.col("parent_key").alias("up"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    step = 1
    while step <= deepest:
        lent = reach.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("further"))
        ups = reach.where("up is not null").select(F.col("key").alias("up"), F.col("up").alias("higher"))
        reach = reach.join(lent, "key", "left").join(ups, "up", "left").select(
            "key", F.col("higher").alias("up"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("further", F.lit(0))).alias("saved")
        ).checkpoint()
        step *= 2
    whole = one.join(reach, "key").withColumns({"n_leaves": F.col("n_leaves") + F.col("leaves"), "saved_tokens": F.col("saved_tokens") + F.col("saved")})
    above = one.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(above, "parent_key", "left")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations."""
    nodes = shards(sorted_paths(rebuilt(conversations))).checkpoint()
    upper = merged(nodes)
    hangs = nodes.where("key is null and parent_key is not null").drop("parent_conv_id")
    # the parents of a shard's own nodes are brought to the shard, so that a prefix with many children is met in each shard alone
    lent = nodes.where("key is not null").select("shard", "key").join(nodes.where("key is not null").groupBy("key").agg(F.min("conv_id").alias("parent_conv_id")), "key")
    hung = hangs.join(lent.withColumnRenamed("key", "parent_key"), ["shard", "parent_key"])
    done = nodes.where("key is null and parent_key is null")
    every = [x.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).select(*RESULT) for x in (done, hung, upper)]
    return every[0].unionByName(every[1]).unionByName(every[2])
