"""Conversation prefix trie (operator 12): balanced parentheses per shard, shared spines merged.

Conversations are sorted by their path, the 128-bit digests of their turns, and cut into shards of neighbours. A shard writes its trie as
parentheses; ``findclose`` on blocks of least and greatest excess gives each node's subtree, the rank of leaf pairs its leaves, and cumulative
arrays its members and savings. Only nodes on the path that two neighbouring shards share are in both; each shard counts what begins in it, so
that those few rows merge by sums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.llm.common import broadcast_small, cut, read, whole

DIGEST = 16  # bytes of a turn's digest in a path
BLOCK = 512  # parentheses of a block
SHARD_TURNS = 1 << 18  # a task closes a shard at so many turns, so its memory does not grow with its partition
CHUNK = 4096  # ids of one piece of a shared node's list
NO_ENDS = hashlib.sha256().hexdigest()


# --- balanced parentheses ---------------------------------------------------------------------------------------------

class Parens:
    """A balanced sequence (True opens) with range min-max blocks of its excess and ranks of its leaf pairs."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(np.where(bits, 1, -1), dtype=np.int64)
        starts = np.arange(0, len(bits), block)
        self.levels = [(np.minimum.reduceat(self.excess, starts), np.maximum.reduceat(self.excess, starts))]
        while len(self.levels[-1][0]) > 1:
            least, most = self.levels[-1]
            pairs = np.arange(0, len(least), 2)
            self.levels.append((np.minimum.reduceat(least, pairs), np.maximum.reduceat(most, pairs)))

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """Position of the parenthesis that closes each of ``opens``: the first behind it whose excess is one less than its own."""
        target = self.excess[opens] - 1
        out = np.full(len(opens), -1, np.int64)
        at = opens + 1
        left = self._scan(out, np.arange(len(opens)), at, target, (at // self.block + 1) * self.block)
        # Up the levels to the first block to the right whose range holds the target, then down to its first half that does.
        node, level, holds = at // self.block, np.zeros(len(opens), np.int64), np.zeros(len(opens), bool)
        climbing = left
        while len(climbing):
            k = node[climbing]
            beside = climbing[(k & 1) == 0]
            right = node[beside] + 1
            has = self._holds(level[beside], right, target[beside])
            node[beside[has]] += 1
            holds[beside[has]] = True
            climbing = climbing[~holds[climbing]]
            node[climbing] >>= 1
            level[climbing] += 1
        going = left
        while len(going := going[level[going] > 0]):
            node[going] <<= 1
            level[going] -= 1
            node[going] += ~self._holds(level[going], node[going], target[going])
        if len(left):
            at = node * self.block
            self._scan(out, left, at, target, at + self.block)
        return out

    def _holds(self, level: np.ndarray, node: np.ndarray, target: np.ndarray) -> np.ndarray:
        found = np.zeros(len(node), bool)
        for k in np.unique(level):
            least, most = self.levels[k]
            here = (level == k) & (node < len(least))
            found[here] = (least[node[here]] <= target[here]) & (target[here] <= most[node[here]])
        return found

    def _scan(self, out, which, at, target, end) -> np.ndarray:
        """Looks through what is left of each one's block; returns those not found. All step at once, so a scan takes at most ``block`` steps."""
        at, end = at.copy(), np.minimum(end, len(self.bits))
        while len(which):
            which = which[at[which] < end[which]] if (at[which] >= end[which]).any() else which
            hit = self.excess[at[which]] == target[which]
            out[which[hit]] = at[which[hit]]
            which = which[~hit]
            at[which] += 1
        return np.flatnonzero(out < 0)

    def leaf_rank(self, not_leaves: np.ndarray) -> np.ndarray:
        """Number of leaf pairs ``()`` that begin before each position, without those that begin at ``not_leaves``."""
        pairs = np.zeros(len(self.bits), np.int64)
        pairs[:-1] = self.bits[:-1] & ~self.bits[1:]
        pairs[not_leaves] = 0
        return np.concatenate([[0], np.cumsum(pairs)])


def common_turns(a: bytes, b: bytes) -> int:
    """Leading turns that two paths share; halves the range, so each step compares memory."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[: high * DIGEST] == b[: high * DIGEST]:
        return high
    while low + 1 < high:
        middle = (low + high) // 2
        if a[: middle * DIGEST] == b[: middle * DIGEST]:
            low = middle
        else:
            high = middle
    return low


def key_of(path: bytes, depth: int) -> bytes:
    return hashlib.blake2b(path[: depth * DIGEST], digest_size=16).digest()


# --- one shard --------------------------------------------------------------------------------------------------------

NODE = "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shard long, piece long, ids binary"
KINDS = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
FIELDS = [(f.split()[0], KINDS[f.split()[1]]) for f in NODE.split(", ")]


def batch_of(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) if name in columns else pa.nulls(n, kind) for name, kind in FIELDS], names=[name for name, _ in FIELDS])


def shard_nodes(ids: list[int], paths: list[bytes], words: list[list[int]], left: int, right: int, shard: int):
    """Rows of one shard: its own nodes, whole; partial sums of nodes shared with a neighbour (``key``); and pieces of the shared nodes' ids.

    ``left`` and ``right`` are the turns shared with the path before and behind (-1: there is none). Whatever is counted once in the whole trie is
    counted by one shard: a node and its place among the children by the first shard that holds it, a leaf by the last.
    """
    lens = np.array([len(p) // DIGEST for p in paths], np.int64)
    same = np.array([0] + [common_turns(a, b) for a, b in zip(paths, paths[1:])], np.int64)
    opens = lens - same
    closes = np.concatenate([[0], lens[:-1] - same[1:]])
    runs = np.concatenate([[1], np.stack([closes, opens], 1).ravel(), [lens[-1] + 1]])
    paren = Parens(np.repeat(np.concatenate([[True], np.tile([False, True], len(ids)), [False]]), runs))
    opened = np.flatnonzero(paren.bits)
    closed = paren.find_close(opened)
    m = len(opened)
    node = np.arange(m)
    behind = node + (closed - opened + 1) // 2  # the first node, in preorder, that is not in the subtree
    base = 1 + np.concatenate([[0], np.cumsum(opens)])  # of each conversation, the first node that it opens
    owner = np.concatenate([[0], np.repeat(np.arange(len(ids)), opens)])
    depth = same[owner] + 1 + node - base[owner]
    depth[0] = 0
    ends_at = base[1:] - 1
    weight = np.zeros(m, np.int64)
    flat = np.concatenate([np.asarray(w, np.int64) for w in words])
    start = np.concatenate([[0], np.cumsum(lens)])
    weight[1:] = flat[start[owner[1:]] + depth[1:] - 1]

    # Parents: the node before, but for the first node that a conversation opens, whose parent is the last one before it a level up.
    parent = node - 1
    order = np.argsort(depth, kind="stable")
    level = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    first_opened = base[:-1][(opens > 0) & (np.arange(len(ids)) > 0)]
    up = depth[first_opened] - 1
    for d in np.unique(up):
        row = order[level[d]: level[d + 1]]
        mine = first_opened[up == d]
        parent[mine] = row[np.searchsorted(row, mine) - 1]

    left_spine = node[: base[1]]
    right_spine, at = [], int(ends_at[-1])
    while at >= 0:
        right_spine.append(at)
        at = int(parent[at])
    right_spine = np.array(right_spine)
    seen_before = np.zeros(m, bool)
    seen_before[left_spine[depth[left_spine] <= left]] = True
    shared = seen_before.copy()
    shared[right_spine[depth[right_spine] <= right]] = True
    goes_on = ends_at[-1:][depth[ends_at[-1:]] == right]  # its children, if any, are in the next shard

    total = np.concatenate([[0], np.cumsum(np.bincount(ends_at, minlength=m))])
    n_convs = total[behind] - total[node]
    gain = np.concatenate([[0], np.cumsum((n_convs - ~seen_before) * weight)])
    rank = paren.leaf_rank(opened[goes_on])
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, ends_at, np.array(ids, np.int64))
    for d in range(int(depth.max()), 0, -1):
        row = order[level[d]: level[d + 1]]
        np.minimum.at(least, parent[row], least[row])
    columns = {
        "conv_id": least, "depth": depth, "n_convs": n_convs, "n_children": np.bincount(parent[1:][~seen_before[1:]], minlength=m),
        "n_leaves": rank[closed] - rank[opened], "saved_tokens": gain[behind] - gain[node],
    }

    keys = {int(k): key_of(paths[0] if k < base[1] else paths[-1], int(depth[k])) for k in np.flatnonzero(shared)}
    digests: dict[int, str] = {}
    pieces = []
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(ends_at)) + 1, [len(ids)]]).tolist()
    for a, b in zip(cuts, cuts[1:]):
        at = int(ends_at[a])
        if at in keys:
            pieces += [(keys[at], k, ",".join(map(str, ids[i: min(b, i + CHUNK)])).encode()) for k, i in enumerate(range(a, b, CHUNK))]
        else:
            digests[at] = hashlib.sha256(",".join(map(str, ids[a:b])).encode()).hexdigest()
    of_shared = np.zeros(m, bool)
    of_shared[1:] = shared[parent[1:]]
    for mask, names in ((~shared, {"ends": True}), (shared, {})):
        chosen = np.flatnonzero(mask)
        for low in range(0, len(chosen), 1 << 15):
            part = chosen[low: low + (1 << 15)]
            extra = {"ends_sha256": [digests.get(k, NO_ENDS) for k in part.tolist()]} if names else {"key": [keys[k] for k in part.tolist()]}
            extra["parent_key"] = [keys[p] if s else None for p, s in zip(parent[part].tolist(), of_shared[part].tolist())]
            known = (part > 0) & ~of_shared[part]
            extra["parent_conv_id"] = pa.array(least[np.maximum(parent[part], 0)], mask=~known)
            yield batch_of(**{c: v[part] for c, v in columns.items()}, **extra)
    for low in range(0, len(pieces), 64):
        part = pieces[low: low + 64]
        yield batch_of(key=[p[0] for p in part], piece=[p[1] for p in part], ids=[p[2] for p in part], shard=[shard] * len(part))


def encode(edges: dict[int, tuple[int, int]]):
    """Turns sorted partitions into rows of ``shard_nodes``; ``edges`` has the turns that a partition's ends share with its neighbours'."""
    def run(batches):
        ids, paths, words, held, sub = [], [], [], 0, 0
        left = None
        for batch in batches:
            for shard, conv, path, counts in zip(*(c.to_pylist() for c in batch.columns)):
                path = bytes(path)
                if left is None:
                    left, number = edges[shard][0], shard
                if held >= SHARD_TURNS:
                    right = common_turns(paths[-1], path)
                    yield from shard_nodes(ids, paths, words, left, right, (number << 24) + sub)
                    ids, paths, words, held, sub, left = [], [], [], 0, sub + 1, right
                ids.append(conv)
                paths.append(path)
                words.append(counts)
                held += len(counts) + 1
        if ids:
            yield from shard_nodes(ids, paths, words, left, edges[number][1], (number << 24) + sub)

    return run


# --- the trie ---------------------------------------------------------------------------------------------------------

def conversation_paths(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``path`` (digests of the turns, in order) and ``words`` (per turn) of every conversation.

    Turns are ordered by ``turn`` (null first), equal ones by role, then digest. A null role or text is empty. Rows without a
    ``conv_id`` belong to no conversation. Only digests and counts are shuffled; other columns are ignored.
    """
    role, text = whole("role"), whole("text")
    digest = F.substring(F.sha2(F.concat_ws(":", F.char_length(role).cast("string"), role, text), 256), 1, 2 * DIGEST)
    item = F.struct("turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit("[^ \\t-\\r]+")).alias("words"))
    rows = turns.where("conv_id is not null").select("conv_id", item.alias("item")).groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return rows.select("conv_id", F.unhex(F.array_join(F.transform("items", lambda x: x["digest"]), "")).alias("path"), F.transform("items", lambda x: x["words"]).alias("words"))


def grafted(paths: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """Paths rebuilt as the query states: the first h turns of the block's first conversation, then the own ones behind the first h; h from a checksum of the id."""
    heads = paths.where(f"conv_id % {block} = 0").select(F.col("conv_id").alias("donor"), F.substring("path", 1, DIGEST * (most - 1)).alias("head"), F.slice("words", 1, most - 1).alias("head_words"))
    joined = paths.withColumn("donor", F.col("conv_id") - F.col("conv_id") % block).join(heads, "donor", "left").withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int"))
    none, no_words = F.lit(bytearray()), F.array().cast("array<int>")
    size = F.col("h") * DIGEST
    return joined.select(
        "conv_id", F.concat(F.substring(F.coalesce("head", none), F.lit(1), size), F.substring("path", size + 1, F.length("path") + 1)).alias("path"),
        F.concat(F.slice(F.coalesce("head_words", no_words), F.lit(1), F.col("h")), F.slice("words", F.col("h") + 1, F.size("words") + 1)).alias("words"))


def sha_of_pieces(pieces: DataFrame) -> DataFrame:
    """``key`` and ``ends_sha256`` of the joined pieces of each key, in order, one piece at a time."""
    def run(batches):
        key, sha, out = None, None, []
        for batch in batches:
            for own, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    if key is not None:
                        out.append((key, sha.hexdigest()))
                    key, sha = own, hashlib.sha256(ids)
                else:
                    sha.update(b",")
                    sha.update(ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.string()))], names=["key", "ends_sha256"])
                out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "shard", "piece").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def neighbours(placed: DataFrame) -> dict[int, tuple[int, int]]:
    """Turns that the first and last path of each partition share with the partition before and behind (-1: none): two numbers a partition."""
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            shared = [[-1 if r[b] is None else common_turns(r[a], r[b]) for r in rows] for a, b in (("first", "before"), ("last", "behind"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(s, pa.int64()) for s in shared]], names=["shard", "left", "right"])

    ends = placed.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    along = Window.orderBy("shard")  # one row per partition
    beside = ends.select("shard", "first", "last", F.lag("last").over(along).alias("before"), F.lead("first").over(along).alias("behind"))
    return {r.shard: (r.left, r["right"]) for r in beside.mapInArrow(run, "shard int, left long, right long").collect()}


def trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the prefix trie of ``paths`` (``conv_id``, ``path``, ``words``; ids differ): ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root: null),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    Conversations are ranged by path and id, so any number of equal ones is split over partitions. Of a node's parent outside the shard only
    the key travels; the merged spines have at most a path per shard. Without conversations there is no node.
    """
    paths = cut(paths)
    turns = paths.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    shards = shards or max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns // SHARD_TURNS + 1)
    placed = cut(paths.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id").select(F.spark_partition_id().alias("shard"), "conv_id", "path", "words"))
    rows = cut(placed.mapInArrow(encode(neighbours(placed)), NODE))
    part = rows.where("key is not null and ids is null").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    hashed = sha_of_pieces(rows.where("ids is not null").select("key", "shard", "piece", "ids"))
    spine = cut(part.join(hashed, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))))
    own = rows.where("key is null")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parents = broadcast_small(spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")))
    hanging = own.where("parent_key is not null").select("parent_key", *[c for c in out if c != "parent_conv_id"])
    hanging = hanging.unionByName(spine.where("parent_key is not null").select(*hanging.columns)).join(parents, "parent_key").select(out)
    roots = spine.where("parent_key is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(out)
    return own.where("parent_key is null").select(out).unionByName(hanging).unionByName(roots)


def op12_prefix_trie(spark, d):
    return trie(grafted(conversation_paths(read(spark, d, "conversations"))))


# CRC-32 of a decimal, bit by bit: the polynomial is a fixed value.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(string_split({0}, ''), lambda ch: ascii(ch)::bigint)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {"op12_prefix_trie": rf"""
with t as (select conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as own from conversations where conv_id is not null group by conv_id),
h as (select conv_id, own, conv_id - conv_id % 20 as donor, {_CRC.format("conv_id::varchar")} % 4 as h from t),
p as (select h.conv_id, list_concat(coalesce(d.own, [])[1:h], h.own[h + 1:]) as path from h left join t d on d.conv_id = h.donor),
m as (select conv_id, path, unnest(range(0, len(path) + 1)) as depth from p),
n as (select path[1:depth] as path, depth, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(path) = depth), '')) as ends_sha256
    from m group by all),
c as (select path[1:depth - 1] as path, depth - 1 as depth, count(*) as n_children from n where depth > 0 group by all),
k as (select n.*, coalesce(c.n_children, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(path[depth].x, '[^\x20\x09-\x0D]+')) end as own from n left join c using (path, depth)),
a as (select path, own, n_children, unnest(range(0, depth + 1)) as top from k),
s as (select path[1:top] as path, top as depth, sum(own)::bigint as saved_tokens, count(*) filter (n_children = 0) as n_leaves from a group by all)
select k.conv_id, k.depth, q.conv_id as parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
from k join s using (path, depth) left join n q on q.depth = k.depth - 1 and q.path = k.path[1:k.depth - 1]
"""}
