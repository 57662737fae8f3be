"""Conversation prefix trie in balanced parentheses, one tree per shard.

A conversation is a path: 20 bytes for each turn, 16 of a SHA-256 of role and
text and 4 of the text's length in code points. Sorted paths are the leaves of
a preorder walk, so a shard (a range of paths) writes its tree as brackets
without building it: `find_close` delimits every subtree, the rank of "()"
counts its childless nodes, running sums over the preorder give members and
savings. A node on the shard's first or last path may go on in a neighbouring
shard. These spines are handed on, each node with what hangs below it and is
finished, as the paths of a next, smaller level, until one shard is left.

Defined results: rows without conv_id take no part; null role or text is empty;
turns of one number are ordered by the digest of role and text, a null number
comes first; repeated rows are repeated turns; an empty table has no node, not
even a root. Other columns are ignored. A conversation's path is one value of 20
bytes a turn (texts are never gathered), which must stay below Spark's 2 GB."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, staged
from .parentheses import BalancedParentheses, RangeMinimum

UNIT = 20
#: Turns of the paths in one shard, and the fewest for which it pays to have one more.
SHARD_TURNS, LEAST_TURNS = 1 << 18, 1 << 13
#: Ids joined in one row before their hash is taken.
RUN_IDS = 256
NODE, ITEM, SPINE = 0, 1, 2
_NONE = np.iinfo(np.int64).max
_EMPTY = hashlib.sha256(b"").hexdigest()
_TURN = np.dtype([("a", "<u8"), ("b", "<u8"), ("c", ">u4")])
#: What a node of a path carries to the next level.
_CARRIED = ("members", "lowest", "children", "leaves", "saved")
_ITEMS = "path binary, " + ", ".join(f"{c} array<long>" for c in _CARRIED) + ", ends array<string>"
_RUNS = "path binary, first long, n long, ids binary"
_OUT = ("kind int, shard long, node binary, parent_node binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, " + _ITEMS)


def turn_paths(conversations: DataFrame) -> DataFrame:
    """conv_id and path of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    unit = F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.length(text)), 8, "0"))
    turn = F.col("turn").cast("long")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"),
                                 F.struct(turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("turn"), unit.alias("unit")).alias("t"))
    grouped = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.unhex(F.array_join(F.col("t.unit"), "")).alias("path"))


def with_openings(paths: DataFrame, cohort: int = 100, most: int = 5) -> DataFrame:
    """Conversation c with its first h turns replaced by those of conversation
    c - c % cohort (none, if that is absent); h = crc32 of c's decimal form
    modulo most + 1. c % cohort has the sign of c."""
    own = staged(paths, "paths").select("conv_id", "path", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1) * UNIT).cast("int").alias("cut"),
                                        (F.col("conv_id") - F.col("conv_id") % cohort).alias("head_id"))
    heads = own.where(F.col("conv_id") % cohort == 0).select(F.col("conv_id").alias("head_id"), F.substring("path", 1, most * UNIT).alias("head"))
    path = F.expr("concat(substring(coalesce(head, cast('' AS binary)), 1, cut), substring(path, cut + 1))")
    return own.join(heads, "head_id", "left").select("conv_id", path.alias("path"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal neighbouring paths as rows of up to RUN_IDS ascending ids."""
    path, ids = None, []
    for b in batches:
        out = []

        def close():
            if ids:
                out.append((path, ids[0], len(ids), ",".join(map(str, ids)).encode()))

        for p, i in zip(b["path"].to_pylist(), b["conv_id"].to_pylist()):
            if p != path or len(ids) == RUN_IDS:
                close()
                path, ids = p, []
            ids.append(i)
        if out:
            yield _batch(out, _RUNS)
    if ids:
        yield _batch([(path, ids[0], len(ids), ",".join(map(str, ids)).encode())], _RUNS)


_ARROW = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _fields(ddl: str) -> list[tuple[str, pa.DataType]]:
    return [(n, _ARROW[k]) for n, k in (f.split(" ") for f in ddl.split(", "))]


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = _fields(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


class _Paths:
    """The distinct paths of a shard in order, and values that some of their
    nodes bring along, as (path's index, depth, value of each kind)."""

    def __init__(self):
        self.paths: list[bytes] = []
        self.at: list[np.ndarray] = []
        self.depth: list[np.ndarray] = []
        self.values: dict[str, list] = {c: [] for c in _CARRIED}
        self.ends: list[list] = []

    def add(self, path: bytes, depth, ends: list, **values) -> None:
        self.at.append(np.full(len(depth), len(self.paths)))
        self.depth.append(np.asarray(depth))
        for c in _CARRIED:
            self.values[c].append(np.asarray(values[c], np.int64))
        self.ends.append(ends)
        self.paths.append(path)


def _read_runs(batches: Iterable[pa.RecordBatch]) -> _Paths:
    """Runs of one path follow each other by their ids; the ids are hashed on the way."""
    out, path, first, n, digest = _Paths(), None, 0, 0, None

    def close():
        if path is not None:
            out.add(path, [len(path) // UNIT], [digest.hexdigest()], members=[n], lowest=[first], children=[0], leaves=[0], saved=[0])

    for b in batches:
        for p, f, k, ids in zip(*(b[c].to_pylist() for c in ("path", "first", "n", "ids"))):
            if p != path:
                close()
                path, first, n, digest = p, f, 0, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids)
            n += k
    close()
    return out


def _read_items(batches: Iterable[pa.RecordBatch]) -> _Paths:
    out = _Paths()
    for b in batches:
        for row in b.to_pylist():
            out.add(row["path"], np.arange(len(row["ends"])), row["ends"], **{c: row[c] for c in _CARRIED})
    return out


def _prefix_names(path: bytes) -> list[bytes]:
    """A name for every node of a path, from the root down."""
    h, out = hashlib.sha256(), [b""]
    for at in range(0, len(path), UNIT):
        h.update(path[at:at + UNIT])
        out.append(h.copy().digest()[:16])
    out[0] = b"root"
    return out


def _shard(batches: Iterator[pa.RecordBatch], level: int, last: bool) -> Iterator[pa.RecordBatch]:
    """The finished nodes of a shard and, unless it is the only one, its spines."""
    from pyspark import TaskContext

    read = (_read_runs if level == 0 else _read_items)(batches)
    if not read.paths:
        return
    shard = (level << 40) + TaskContext.get().partitionId()
    paths = read.paths
    size = np.array([len(p) // UNIT for p in paths], np.int64)
    begin = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(paths), _TURN)

    # What each path shares with the one before.
    shared = np.zeros(len(paths), np.int64)
    both = np.minimum(size[1:], size[:-1])
    some = np.flatnonzero(both)
    if len(some):
        n = both[some]
        x, y = flat[ragged(begin[some], n)], flat[ragged(begin[some + 1], n)]
        differ = (x["a"] != y["a"]) | (x["b"] != y["b"]) | (x["c"] != y["c"])
        place = np.where(differ, ragged(np.zeros(len(n), np.int64), n), _NONE)
        shared[some + 1] = np.minimum(np.minimum.reduceat(place, np.cumsum(n) - n), n)

    # Nodes in preorder, the root first; `start`: a path's first new node.
    new = size - shared
    start = 1 + np.cumsum(new) - new
    n_nodes = 1 + int(new.sum())
    depth = np.concatenate([[0], ragged(shared + 1, new)])
    length = np.concatenate([[0], flat["c"][ragged(begin + shared, new)].astype(np.int64)])
    closes = np.cumsum(np.concatenate([[0], size[:-1]]) - shared)
    opening = np.concatenate([[0], np.arange(1, n_nodes) + np.repeat(closes, new)])
    bits = np.zeros(2 * n_nodes, np.int8)
    bits[opening] = 1
    brackets = BalancedParentheses(bits)
    closing = brackets.find_close(opening)
    node, stop = np.arange(n_nodes), brackets.opens_through(closing)

    by_depth = np.lexsort((node, depth))
    key = depth[by_depth] * np.int64(n_nodes + 1) + node[by_depth]

    def last_at(d: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The last node of depth d among the nodes before `before`."""
        return by_depth[np.searchsorted(key, d * np.int64(n_nodes + 1) + before, "left") - 1]

    parent = node - 1
    heads = np.flatnonzero(new)
    parent[start[heads]] = last_at(shared[heads], start[heads])

    spine = np.zeros(n_nodes, bool)
    after = np.append(start[1:], n_nodes)
    ways = [] if last else [last_at(np.arange(size[i] + 1), np.full(size[i] + 1, after[i])) for i in sorted({0, len(paths) - 1})]
    for way in ways:
        spine[way] = True

    # Values that came along, each at its node.
    came = {c: np.concatenate(v) for c, v in read.values.items()}
    holder = np.concatenate(read.at)
    holder = last_at(np.concatenate(read.depth).astype(np.int64), after[holder])
    own = {c: np.full(n_nodes, _NONE if c == "lowest" else 0) for c in _CARRIED}
    for c in _CARRIED:
        (np.minimum if c == "lowest" else np.add).at(own[c], holder, came[c])
    ends = np.full(n_nodes, None, object)
    for at, e in zip(holder.tolist(), (e for es in read.ends for e in es)):
        ends[at] = e or ends[at]

    def below(values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[stop] - total[node]

    members = below(own["members"])
    lowest = RangeMinimum(own["lowest"]).of(node, stop)
    children = own["children"] + np.bincount(parent[1:][~spine[1:]], minlength=n_nodes)
    pair = np.zeros(len(bits), bool)
    pair[opening] = ~spine & (children == 0)
    rank = np.cumsum(pair & brackets.leaf_pairs())
    leaves = rank[closing] - rank[opening] + pair[opening] + below(own["leaves"])
    saved = below(np.where(spine, 0, (members - 1) * length) + own["saved"])

    if level:
        names = np.empty(n_nodes, object)
        for p, s, k, n in zip(paths, shared.tolist(), start.tolist(), new.tolist()):
            of = _prefix_names(p)
            names[0] = of[0]
            names[k:k + n] = of[s + 1:]
    else:
        names = np.full(n_nodes, None, object)
    spine_names = np.full(n_nodes, None, object)
    for way, i in zip(ways, sorted({0, len(paths) - 1})):
        spine_names[way] = _prefix_names(paths[i])

    done = np.flatnonzero(~spine)
    fields = dict(_fields(_OUT))

    def rows(count: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(count, k) for c, k in fields.items()], names=list(fields))

    for lo in range(0, len(done), 1 << 16):
        at = done[lo:lo + (1 << 16)]
        up = np.maximum(parent[at], 0)
        hangs = spine[up] & (at > 0)
        yield rows(len(at), kind=np.full(len(at), NODE, np.int32), shard=np.full(len(at), shard), node=names[at], parent_node=np.where(hangs, spine_names[up], None),
                   conv_id=lowest[at], depth=depth[at], parent_conv_id=pa.array(lowest[up], mask=hangs | (at == 0)), n_convs=members[at], n_children=children[at],
                   n_leaves=leaves[at], saved_tokens=saved[at], ends_sha256=[e or _EMPTY for e in ends[at]])
    on = np.flatnonzero(spine)
    if len(on):
        yield rows(len(on), kind=np.full(len(on), SPINE, np.int32), shard=np.full(len(on), shard), node=spine_names[on])
    given = np.zeros(n_nodes, bool)
    inner = np.flatnonzero(spine & (node > 0))
    for i, way in zip(sorted({0, len(paths) - 1}), ways):
        carry = {"lowest": lowest, "children": children}
        for c, whole in (("members", members), ("leaves", leaves), ("saved", saved)):
            carry[c] = whole.copy()
            np.subtract.at(carry[c], parent[inner], whole[inner])
        fresh = ~given[way]
        given[way] = True
        yield rows(1, kind=np.array([ITEM], np.int32), shard=np.array([shard]), path=[paths[i]], ends=[[e if f else None for e, f in zip(ends[way], fresh)]],
                   **{c: [np.where(fresh, carry[c][way], _NONE if c == "lowest" else 0).tolist()] for c in _CARRIED})


def prefix_trie(paths: DataFrame, shard_turns: int = SHARD_TURNS, least_turns: int = LEAST_TURNS) -> DataFrame:
    """One row per node of the trie of `paths` (conv_id, path): conv_id (its
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 of the ids that end at the node."""
    spark = paths.sparkSession
    ordered = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    items = staged(ordered.mapInArrow(_runs, _RUNS), "runs")
    levels, shards = [], 0
    while True:
        turns = items.agg(F.sum(F.length("path") / UNIT + 1)).first()[0] or 0
        most = -(-int(turns) // shard_turns)
        if not levels:
            most = max(most, min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(turns) // least_turns))
        shards = max(1, min(most, shards // 4) if levels else most)
        dealt = items.coalesce(1) if shards == 1 else items.repartitionByRange(shards, "path")
        dealt = dealt.sortWithinPartitions(*(["path"] if levels else ["path", "first"]))
        levels.append(staged(dealt.mapInArrow(functools.partial(_shard, level=len(levels), last=shards == 1), _OUT), "trie"))
        if shards == 1:
            break
        items = levels[-1].where(F.col("kind") == ITEM).select(*(f.split(" ")[0] for f in _ITEMS.split(", ")))

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = functools.reduce(DataFrame.unionByName, levels)
    nodes = every.where(F.col("kind") == NODE)
    known = nodes.where("node IS NOT NULL").select(F.col("node").alias("parent_node"), F.col("conv_id").alias("above"))
    on = every.where(F.col("kind") == SPINE).select("shard", F.col("node").alias("parent_node")).join(known, "parent_node")
    hanging = nodes.where("parent_node IS NOT NULL").drop("parent_conv_id").join(on.withColumnRenamed("above", "parent_conv_id"), ["shard", "parent_node"], "left")
    return nodes.where("parent_node IS NULL").select(columns).unionByName(hanging.select(columns))
