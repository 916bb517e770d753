"""Prefix tries of conversations: a double array for each shard of prefixes, merged above them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators.skew import salted_join
from limnos.storage import stage

#: A prefix with more turns than this in and below it is shared by shards; what hangs below is cut off it.
SUBTREE_TURNS = 1024
#: Turns that a shard holds, about.
SHARD_TURNS = 4096
#: Ids of members that one row gathers: they are distinct, so it can't have more.
ID_SPAN = 4096
LONGS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


# --- conversations ----------------------------------------------------------------


def head_turns(conv_id: Column, group: int) -> Column:
    """How many first turns a conversation takes from its group's first: unsigned crc32(decimal id) % 4, 0 to 3."""
    return F.pmod(F.crc32(conv_id.cast("long").cast("string").cast("binary")), F.lit(4)).cast("int")


def rebuilt_turns(turns: DataFrame, group: int = 20, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, k1, k2, words, p1, p2, total) of every rebuilt turn.

    A conversation c takes the first h turns of conversation c - c % group (all
    if it has fewer, none if it is absent) in place of its own first h. Turns
    are ordered by turn, null first; equal turns by role, then by a digest of
    the text. k1, k2 are two 64-bit digests of role and text, p1, p2 of all
    turns up to pos: digests of (pos, turn) under exclusive or, so that a
    running window makes them. ``total`` is the words up to pos.
    """
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    size = F.size(F.array_remove(F.split(what, r"[\x20\x09-\x0D]+"), "")).cast("long")
    own = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), F.xxhash64(F.lit(1), who, what).alias("k1"), F.xxhash64(F.lit(2), who, what).alias("k2"), size.alias("words"))
    base = F.col("conv_id") - F.col("conv_id") % group
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("k1"), F.asc("k2")]
    heads = own.where(F.col("conv_id") == base).withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))).where("at <= 3")
    # a truncating remainder gives the group of 0 ids of both signs
    members = F.sequence(F.col("conv_id") - F.when(F.col("conv_id") <= 0, group - 1).otherwise(0), F.col("conv_id") + F.when(F.col("conv_id") >= 0, group - 1).otherwise(0))
    lent = heads.withColumn("conv_id", F.explode(members)).where(F.col("at") <= head_turns(F.col("conv_id"), group))
    lent = lent.join(own.select("conv_id").distinct(), "conv_id", "left_semi").withColumn("lent", F.lit(1)).drop("at")
    by = Window.partitionBy("conv_id").orderBy(F.desc("lent"), *order)
    both = lent.unionByName(own.withColumn("lent", F.lit(0)))
    placed = both.withColumn("place", F.row_number().over(by)).withColumn("taken", F.sum("lent").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    h = head_turns(F.col("conv_id"), group)
    kept = placed.where((F.col("lent") == 1) | (F.col("place") - F.col("taken") > h))
    kept = kept.withColumn("pos", F.when(F.col("lent") == 1, F.col("place")).otherwise(F.col("place") - h))
    upto = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return kept.select(
        "conv_id",
        "pos",
        "k1",
        "k2",
        "words",
        F.bit_xor(F.xxhash64("pos", "k1", "k2")).over(upto).alias("p1"),
        F.bit_xor(F.xxhash64("k2", "pos", "k1")).over(upto).alias("p2"),
        F.sum("words").over(upto).alias("total"),
    )


def ends_digest(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of the conversations (p1, p2, conv_id) that end at each node: SHA-256 of their ids, ascending, comma-joined.

    Ids are gathered by ranges of ID_SPAN values, so that a row has so many at
    most; the ranges of a node with several, in order, feed one digest, a range
    at a time.
    """
    span = F.floor(F.col("conv_id") / F.lit(ID_SPAN))
    ranges = ends.groupBy("p1", "p2", span.alias("span")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    ranges = stage(ranges, "ended-ranges")
    many = ranges.groupBy("p1", "p2").agg(F.count("*").alias("n"))
    one = ranges.join(many.where("n = 1"), ["p1", "p2"]).select("p1", "p2", F.sha2("ids", 256).alias("ends_sha256"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        at, sha, done = None, None, []
        for batch in batches:
            for p1, p2, ids in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "ids")), strict=True):
                if (p1, p2) == at:
                    sha.update(b"," + ids.encode())
                else:
                    if at:
                        done.append((*at, sha.hexdigest()))
                    at, sha = (p1, p2), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["p1", "p2", "ends_sha256"])
                done = []
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, sha.hexdigest())], ["p1", "p2", "ends_sha256"])

    several = ranges.join(many.where("n > 1").select("p1", "p2"), ["p1", "p2"]).repartition("p1", "p2").sortWithinPartitions("p1", "p2", "span")
    return one.unionByName(several.select("p1", "p2", "ids").mapInArrow(digest, "p1 long, p2 long, ends_sha256 string"))


# --- double arrays ------------------------------------------------------------------


class DoubleArray:
    """A trie in two arrays: the child of state s by symbol c is t = base[s] + c where check[t] == s.

    Symbols are dense ids from 1. ``paths`` are sequences of them in
    lexicographic order; state 0 is the root. ``last`` is the largest state.
    """

    def __init__(self, paths: list[list[int]]) -> None:
        n = sum(map(len, paths)) + max((max(p) for p in paths if p), default=0) + 2
        base, check, skip = [0] * n, [-1] * n, list(range(n))  # skip leads from taken states to the next free one
        check[0], skip[0] = 0, 1
        self.last = 0

        def free(at: int) -> int:
            while True:
                while at >= len(check):
                    check.extend([-1] * n)
                    base.extend([0] * n)
                    skip.extend(range(len(skip), len(skip) + n))
                if skip[at] == at:
                    return at
                if skip[at] < len(skip):
                    skip[at] = skip[skip[at]]
                at = skip[at]

        todo = [(0, 0, len(paths), 0)]
        while todo:
            state, low, high, depth = todo.pop()
            while low < high and len(paths[low]) == depth:  # paths that end here come first
                low += 1
            children = []
            while low < high:
                symbol, start = paths[low][depth], low
                while low < high and paths[low][depth] == symbol:
                    low += 1
                children.append((symbol, start, low))
            if not children:
                continue
            first = children[0][0]
            at = free(max(1, first))
            while any(free(at + c - first) != at + c - first for c, _, _ in children[1:]):
                at = free(at + 1)
            base[state] = at - first
            for symbol, start, end in children:
                child = at - first + symbol
                check[child], skip[child] = state, child + 1
                self.last = max(self.last, child)
                todo.append((child, start, end, depth + 1))
        self.base, self.check = np.array(base), np.array(check)

    def walk(self, path: list[int]) -> list[int]:
        """States along a path, or up to where it leaves the trie."""
        state, out = 0, []
        for symbol in path:
            child = int(self.base[state]) + symbol
            if child >= len(self.check) or self.check[child] != state or child == 0:
                break
            out.append(state := child)
        return out


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean, p1 long, p2 long, q1 long, q2 long"


def shard_nodes(table: pa.Table) -> pa.Table:
    """Nodes of a shard of cut-off subtrees (columns NODE) from its turns, by a double array.

    ``table`` has c1, c2 (the prefix that ends in the subtree's top), conv_id,
    pos, k1, k2, words, n (equal conversations), p1, p2, q1, q2 (the prefix
    before) and ends_sha256 (null but at a conversation's end).
    """
    table = table.sort_by([("conv_id", "ascending"), ("pos", "ascending")])
    col = {c: table.column(c).to_numpy() for c in table.column_names if c != "ends_sha256"}
    shas = table.column("ends_sha256").to_pylist()
    conv = col["conv_id"]
    starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
    stops = np.append(starts[1:], len(conv))
    dense = lambda a, b: np.unique(np.stack((col[a], col[b])), axis=1, return_inverse=True)[1].ravel() + 1
    symbols = dense("k1", "k2")
    symbols[starts] = dense("c1", "c2")[starts]  # a subtree's top is reached by its whole prefix
    paths = [symbols[a:b].tolist() for a, b in zip(starts, stops, strict=True)]
    order = sorted(range(len(paths)), key=paths.__getitem__)
    trie = DoubleArray([paths[i] for i in order])

    size = trie.last + 1
    n_convs, least, row, leaves, saved, children = (np.zeros(size, np.int64) for _ in range(6))
    ends: list[str | None] = [None] * size
    for i in range(len(paths)):  # ascending conv_id: the first to reach a state is its smallest member
        states = np.array(trie.walk(paths[i]), np.int64)
        new = n_convs[states] == 0
        least[states[new]] = conv[starts[i]]
        row[states[new]] = np.arange(starts[i], stops[i])[new]
        n_convs[states] += col["n"][starts[i]]
        ends[states[-1]] = shas[stops[i] - 1]
    states = np.flatnonzero(n_convs)
    depth = col["pos"][row[states]]
    above = trie.check[states]
    np.add.at(children, above, 1)
    leaves[states] = children[states] == 0
    saved[states] = (n_convs[states] - 1) * col["words"][row[states]]
    for s in states[np.argsort(-depth, kind="stable")]:  # children before their parents
        up = trie.check[s]
        if up:
            leaves[up] += leaves[s]
            saved[up] += saved[s]
    top = above == 0
    at = row[states]
    only_top = lambda c: pa.array(col[c][at], pa.int64(), mask=~top)
    arrays = [least[states], depth, pa.array(least[above], pa.int64(), mask=top), n_convs[states], children[states], leaves[states], saved[states], pa.array([ends[s] for s in states], pa.string()), top, *map(only_top, ("p1", "p2", "q1", "q2"))]
    names = [f.split()[0] for f in NODE.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string(), pa.bool_()] + [pa.int64()] * 4
    return pa.table([pa.array(a, k) if isinstance(a, np.ndarray) else a for a, k in zip(arrays, kinds, strict=True)], names)


# --- the trie -------------------------------------------------------------------------


def _merged_above(upper: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes (columns NODE) of the prefixes that shards share, from the turns in them and the tops of what was cut off.

    Everything is summed by prefix. What is summed over a subtree is carried by
    one member of each part: a cut-off subtree by its smallest member, and the
    shared nodes, which form one run of prefixes for each smallest member, by
    that member. A carrier's turns lead through exactly the nodes above it, so
    there are no more rows than turns, however deep the prefixes are.
    """
    nodes = upper.groupBy("p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.first("pos").alias("depth"), F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.sum("n").alias("n_convs"), F.first("words").alias("words"), F.max("ends_sha256").alias("ends_sha256")
    )
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = stage(nodes.withColumn("run_saved", F.sum((F.col("n_convs") - 1) * F.col("words")).over(below)), "shared-nodes")
    runs = nodes.groupBy("conv_id").agg(F.max("run_saved").alias("run"), F.min("depth").alias("run_from"))
    carried = runs.join(tops.select("conv_id", "n_leaves", "saved_tokens"), "conv_id", "full").na.fill(0, ["run", "n_leaves", "saved_tokens"])
    led = salted_join(upper.select("conv_id", "pos", "p1", "p2"), carried, "conv_id")
    sums = led.groupBy("p1", "p2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum(F.col("saved_tokens") + F.when(F.col("pos") < F.col("run_from"), F.col("run")).otherwise(0)).alias("more"))
    children = nodes.select("q1", "q2").unionAll(tops.select("q1", "q2")).groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    whole = nodes.join(sums, ["p1", "p2"], "left").join(children, ["p1", "p2"], "left").na.fill(0, ["n_leaves", "more", "n_children"])
    return whole.select("conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("run_saved") + F.col("more")).alias("saved_tokens"), "ends_sha256", F.lit(True).alias("top"), "p1", "p2", "q1", "q2")


def conversation_trie(turns: DataFrame, group: int = 20, subtree_turns: int = SUBTREE_TURNS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations (rebuilt_turns).

    Equal conversations are counted once and told by their number and smallest
    id. A prefix with more than ``subtree_turns`` turns in and below it is
    shared; everything else hangs in subtrees below the shared prefixes, which
    are dealt by their prefix to shards of about ``shard_turns`` turns. Each
    shard packs a double array over dense ids of its turns and traverses it;
    the shared nodes' aggregates are merged over all shards, by prefix. So a
    first turn of a third of all conversations is no single task's.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256, a row a node, the root
    (depth 0) included. Null roles and texts are empty; rows without a
    conversation's id are in none and left out. Repeated turns are turns.
    Conversations that lose all their turns are members of the root. An empty
    table has no members and gives no rows. Other columns are ignored. Prefixes
    and turns are told apart by 128-bit digests.
    """
    rows = stage(rebuilt_turns(turns, group), "rebuilt-turns")
    ids = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    lasts = rows.groupBy("conv_id").agg(F.max_by(F.struct("p1", "p2", F.col("pos").alias("turns")), "pos").alias("e")).select("conv_id", "e.*")
    lasts = stage(ids.join(lasts, "conv_id", "left"), "conversation-ends")
    told = lasts.where("turns is not null").groupBy("p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("turns").alias("turns"))
    told = stage(told.join(ends_digest(lasts.where("turns is not null").select("p1", "p2", "conv_id")), ["p1", "p2"]).drop("p1", "p2"), "distinct-conversations")

    # one conversation of each group of copies goes on; q1, q2 is the prefix before a turn, 0 for the root's
    by = Window.partitionBy("conv_id").orderBy("pos")
    apart = salted_join(rows.drop("total"), told, "conv_id").select(
        "conv_id", "pos", "k1", "k2", "words", "n", "turns", "p1", "p2", F.lag("p1", 1, 0).over(by).alias("q1"), F.lag("p2", 1, 0).over(by).alias("q2"), F.when(F.col("pos") == F.col("turns"), F.col("ends_sha256")).alias("ends_sha256")
    )
    apart = stage(apart.withColumn("prefix", F.struct("p1", "p2")), "distinct-turns")
    large = apart.groupBy("prefix").agg(F.sum(F.col("turns") - F.col("pos") + 1).alias("below")).where(F.col("below") > subtree_turns).select("prefix", F.lit(True).alias("shared"))
    large = stage(large, "shared-prefixes")
    none_shared = large.isEmpty()
    if none_shared:
        marked = apart.withColumns({"shared": F.lit(False)})
    else:
        marked = stage(salted_join(apart, large, "prefix", "left").withColumn("shared", F.coalesce("shared", F.lit(False))), "marked-turns")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = marked.where("not shared").withColumn("c", F.min_by("prefix", "pos").over(upto)).select("*", F.col("c.p1").alias("c1"), F.col("c.p2").alias("c2")).drop("c", "prefix", "shared")
    shards = max(1, -(-apart.count() // shard_turns))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("c1", "c2"), F.lit(shards)))
    nodes = stage(dealt.groupBy("shard").applyInArrow(lambda table: shard_nodes(table.drop_columns(["shard"])), NODE), "shard-nodes")
    tops = nodes.where("top")
    if not none_shared:
        merged = stage(_merged_above(marked.where("shared").drop("prefix", "shared"), tops), "merged-nodes")
        tops = stage(tops.unionByName(merged), "upper-nodes")
        parents = merged.select(F.struct("p1", "p2").alias("before"), F.col("conv_id").alias("parent"))
        placed = salted_join(tops.withColumn("before", F.struct("q1", "q2")), parents, "before", "left").withColumn("parent_conv_id", F.col("parent")).drop("before", "parent")
        nodes = nodes.where("not top").unionByName(placed)

    members = lasts.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    first = tops.where("depth = 1").groupBy().agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(0)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    turnless = lasts.where("turns is null").select(F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), "conv_id")
    ends = ends_digest(turnless).groupBy().agg(F.max("ends_sha256").alias("ends_sha256"))
    root = members.where("n_convs > 0").crossJoin(F.broadcast(first)).crossJoin(F.broadcast(ends))  # one row each
    root = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens", "ends_sha256")
    least = F.broadcast(members.select(F.col("conv_id").alias("root_conv")))
    rest = nodes.crossJoin(least).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("root_conv")).otherwise(F.col("parent_conv_id")))
    out = root.unionByName(rest.select(root.columns))
    return out.select(*[F.col(c).cast("long").alias(c) for c in LONGS], F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


#: CRC-32 of a decimal number in DuckDB, modulo 4.
_HEAD = """(xor(list_reduce(list_prepend(4294967295::bigint, [ord(ch)::bigint for ch in string_split(conv_id::varchar, '')]),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint) % 4)"""
#: DuckDB SQL of conversation_trie over conversations: prefixes as lists.
TRIE_SQL = rf"""
with own as (
  select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)
), conv as (
  select distinct conv_id, conv_id - conv_id % 20 as base, {_HEAD} as h from own
), both_ as (
  select c.conv_id, 0 as part, o.pos, o.role, o.text from conv c join own o on o.conv_id = c.base and o.pos <= c.h
  union all select c.conv_id, 1, o.pos, o.role, o.text from conv c join own o on o.conv_id = c.conv_id and o.pos > c.h
), whole as (
  select conv_id, list({{'r': role, 't': text}} order by part, pos) as turns from both_ group by conv_id
), prefix as (
  select c.conv_id, coalesce(w.turns, []) as turns, unnest(range(coalesce(len(w.turns), 0) + 1)) as depth from conv c left join whole w using (conv_id)
), member as (
  select conv_id, depth, len(turns) as n, turns[1:depth] as path from prefix
), node as (
  select path, depth, min(conv_id) as conv_id, count(*) as n_convs, string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth) as ends from member group by path, depth
), kid as (
  select path[1:depth - 1] as path, count(*) as n_children from node where depth > 0 group by 1
), own_of as (
  select n.*, coalesce(k.n_children, 0) as n_children,
    case when n.depth = 0 then 0 else (n.n_convs - 1) * len(regexp_extract_all(n.path[n.depth].t, '[^\x20\x09-\x0D]+')) end as saved
  from node n left join kid k using (path)
), pair as (
  select distinct a.path as top, b.path as low from member a join member b on a.conv_id = b.conv_id and b.depth >= a.depth
), subtree as (
  select p.top as path, sum((o.n_children = 0)::int) as n_leaves, sum(o.saved) as saved_tokens from pair p join own_of o on o.path = p.low group by 1
)
select o.conv_id, o.depth::bigint as depth, case when o.depth > 0 then u.conv_id end as parent_conv_id, o.n_convs::bigint as n_convs, o.n_children::bigint as n_children,
  s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(coalesce(o.ends, '')) as ends_sha256
from own_of o join subtree s using (path) left join node u on o.depth > 0 and u.path = o.path[1:o.depth - 1]
"""
