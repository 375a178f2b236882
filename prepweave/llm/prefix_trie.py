"""The trie of conversations' shared beginnings, by an external mergesort whose runs carry longest common prefixes (LCPs).

A conversation is the string of its turns, each of WIDTH bytes: the digest of role and text, then the number of words.
Tasks sort runs of them and cut these into blocks at the bounds of key ranges. A range's task merges its runs' blocks with
a tree of losers that starts each comparison behind the turns already known to be shared; blocks arrive in the order in
which the merge needs them (by the key that ends the block before in the same run), so it holds one block a run. The
merged stream opens and closes nodes on a stack. Nodes on the path of a range's first or last conversation may go on in
the next range; these few are put together by the same stack over all ranges' edges.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepweave.llm.common import drawn, small, word_count, written

#: Bytes of a turn's digest and of the turn with its number of words.
DIGEST, WIDTH = 16, 24
#: A run's share of memory, a block's, and the bytes that a key range should hold.
RUN_BYTES, BLOCK_BYTES, RANGE_BYTES = 32 << 20, 1 << 18, 16 << 20
LEAST_RANGES, SAMPLES = 16, 20
#: Turns of a sampled key that serve as a bound.
BOUND_TURNS = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROWS = 4096


def strings(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation its id (long) and the string of its turns, in the order of turn (null first), ties by the digest.

    Null roles and texts count as empty; rows without a conversation's id belong to none. A conversation is one row, so
    its turns (24 bytes each) must fit one.
    """
    r, t = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.substring(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256), 1, 2 * DIGEST)
    each = turns.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.struct(F.col(turn).alias("turn"), F.concat(digest, F.lpad(F.hex(word_count(t)), 2 * (WIDTH - DIGEST), "0")).alias("hex")).alias("one"))
    return each.groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("all")).select("conv", F.unhex(F.array_join(F.col("all.hex"), "")).alias("seq"))


def with_shared_heads(convs: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % family (fewer if it has fewer, none if
    it is absent), h = crc32(c) % most, and goes on with its own turns after its first h."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    heads = convs.filter(F.col("conv") % family == 0).select(F.col("conv").alias("parent"), F.expr(f"substring(seq, 1, {WIDTH * (most - 1)})").alias("head"))
    both = convs.withColumn("h", h).withColumn("parent", F.col("conv") - F.col("conv") % family).join(heads, "parent", "left")
    return both.select("conv", F.concat(F.coalesce(F.expr(f"substring(head, 1, {WIDTH} * h)"), F.lit(b"")), F.expr(f"substring(seq, {WIDTH} * h + 1)")).alias("seq"))


def _grouped(convs: DataFrame) -> DataFrame:
    """Equal conversations of a stretch of 4,096 ids as one row: seq, part (the stretch), n, first, ids (ascending,
    comma-joined). So a conversation that a third of all ids share is a few rows, and no list of ids grows with it."""
    by = convs.groupBy(F.shiftright("conv", 12).alias("part"), "seq").agg(F.count("*").alias("n"), F.min("conv").alias("first"), F.sort_array(F.collect_list("conv")).alias("all"))
    return by.select("seq", "part", "n", "first", F.array_join(F.col("all").cast("array<string>"), ",").alias("ids"))


def _bounds(rows: DataFrame, range_bytes: int, least_ranges: int) -> list[bytes]:
    """The keys at which ranges begin, told from about SAMPLES sampled keys a range; the driver gets no more."""
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("seq") + F.length("ids") + 64).alias("bytes")).first()
    ranges = max(least_ranges, -(-(size["bytes"] or 0) // range_bytes))
    some = rows.filter(drawn(min(1.0, SAMPLES * ranges / max(1, size["n"])), "part", "seq")).select(F.expr(f"substring(seq, 1, {WIDTH * BOUND_TURNS})").alias("seq"))
    keys = sorted(bytes(r["seq"]) for r in some.collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """How many turns two strings begin with in common, the first `known` of them taken for granted."""
    at, end = known * WIDTH, min(len(a), len(b))
    while at < end and a[at : at + WIDTH] == b[at : at + WIDTH]:
        at += WIDTH
    return at // WIDTH


BLOCKS = "range int, run string, no int, after binary, after_part long, lcp array<int>, rest array<binary>, part array<long>, n array<long>, first array<long>, ids array<string>"


def _sorted_runs(bounds: list[bytes], run_bytes: int, block_bytes: int):
    """A function that sorts a task's rows into runs and gives their blocks, each of one key range. Rows hold the number
    of turns shared with the row before in the run's range, and the turns after these."""

    def blocks(run: str, rows: list[tuple]) -> Iterator[dict]:
        rows.sort(key=lambda r: (r[0], r[1]))
        block, size, before = None, 0, (-1, None, 0)  # range, seq, part of the row before
        no = 0
        for seq, part, n, first, ids in rows:
            at = bisect_right(bounds, seq)
            if block and (at != block["range"] or size >= block_bytes):
                yield block
                block = None
            if at != before[0]:
                no, before = 0, (at, b"", 0)
            if block is None:
                block, size = {"range": at, "run": run, "no": no, "after": before[1], "after_part": before[2], **{c: [] for c in ("lcp", "rest", "part", "n", "first", "ids")}}, 0
                no += 1
            lcp = shared_turns(before[1], seq)
            for c, v in zip(("lcp", "rest", "part", "n", "first", "ids"), (lcp, seq[lcp * WIDTH :], part, n, first, ids)):
                block[c].append(v)
            size += len(seq) - lcp * WIDTH + len(ids) + 40
            before = (at, seq, part)
        if block:
            yield block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, runs = [], 0, 0
        task, schema = TaskContext.get().partitionId(), _schema(BLOCKS)

        def finished():
            for block in blocks(f"{task}-{runs}", rows):
                yield pa.RecordBatch.from_pylist([block], schema=schema)

        for batch in batches:
            for seq, part, n, first, ids in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                rows.append((seq, part, n, first, ids))
                held += len(seq) + len(ids) + 200
                if held >= run_bytes:
                    yield from finished()
                    rows, held, runs = [], 0, runs + 1
        yield from finished()

    return run


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kind = lambda k: pa.list_(kinds[k[6:-1]]) if k.startswith("array") else kinds[k]
    return pa.schema([(c, kind(k)) for c, k in (x.split() for x in ddl.split(", "))])


class Run:
    """A sorted run as the merge reads it: its present row and the number of turns that this shares with the last winner."""

    def __init__(self, block: dict):
        self.name, self.seq, self.lcp, self.block, self.at = block["run"], b"", 0, block, -1

    def step(self, following) -> None:
        """Goes to the next row; following(name) gives the run's next block or None."""
        self.at += 1
        if self.at >= len(self.block["lcp"]):
            self.block, self.at = following(self.name), 0
        if self.block is None:
            self.seq = None
            return
        self.lcp = self.block["lcp"][self.at]
        self.seq = self.seq[: self.lcp * WIDTH] + self.block["rest"][self.at]
        self.part = self.block["part"][self.at]

    def row(self) -> tuple:
        return self.seq, self.lcp, *[self.block[c][self.at] for c in ("n", "first", "ids")]

    def beats(self, other: Run) -> bool:
        """Whether this row comes first; the later one then knows how many turns it shares with the earlier. Both lcps
        are to the last winner, so the row that shares more turns with it comes first without a look at the turns."""
        if self.seq is None or other.seq is None:
            return other.seq is None
        if self.lcp != other.lcp:
            return self.lcp > other.lcp
        shared = shared_turns(self.seq, other.seq, self.lcp)
        first = (self.seq[shared * WIDTH :], self.part, self.name) < (other.seq[shared * WIDTH :], other.part, other.name)
        (other if first else self).lcp = shared
        return first


def merge(runs: list[Run], following) -> Iterator[tuple]:
    """The rows of sorted runs in order, each with the number of turns that it shares with the row before, by a tree of
    losers: a node keeps the run that lost there, and only the path of the last winner is played again."""
    k = len(runs)
    for r in runs:
        r.step(following)
    tree: list[Run | None] = [None] * k
    winner = None
    for i in range(k):  # a run goes up until it finds a free node, where it waits for its rival
        at, here = (i + k) // 2, runs[i]
        while at:
            if tree[at] is None:
                tree[at], here = here, None
                break
            if tree[at].beats(here):
                tree[at], here = here, tree[at]
            at //= 2
        winner = here or winner
    place = {r.name: i for i, r in enumerate(runs)}
    while winner is not None and winner.seq is not None:
        yield winner.row()
        winner.step(following)
        at = (place[winner.name] + k) // 2
        while at:
            if tree[at].beats(winner):
                tree[at], winner = winner, tree[at]
            at //= 2


class Node:
    """A node of the open path. serial numbers the nodes that other ranges may share; own says that it is no such node."""

    __slots__ = ("turn", "words", "n", "first", "children", "leaves", "saved", "ends", "serial", "below", "edges")

    def __init__(self, turn: bytes, serial: int | None = None):
        self.turn, self.words, self.serial = turn, int.from_bytes(turn[DIGEST:], "big"), serial
        self.n = self.children = self.leaves = self.saved = 0
        self.first = self.ends = None
        self.below: list[tuple] = []  # finished children, which wait for this node's first conversation
        self.edges: list[tuple[int, int]] = []

    def members(self, n: int, first: int) -> None:
        self.n += n
        self.first = first if self.first is None else min(self.first, first)

    def finish(self) -> None:
        """The node's own share of its sums, once all below it are in."""
        self.leaves += not self.children
        self.saved += (self.n - 1) * self.words

    def into(self, parent: Node) -> None:
        parent.members(self.n, self.first)
        parent.children += 1
        parent.leaves += self.leaves
        parent.saved += self.saved


#: kind 0: a finished node, whose parent is known or the node `serial` of the range; 1: a range's share of an edge node;
#: 2: the first conversation of the edge node that a range calls `serial`.
NODES = "kind int, range int, serial int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn binary"


def _finished(node: Node, depth: int) -> tuple:
    """What a closed node gives, but for its parent."""
    return depth, node.first, node.n, node.children, node.leaves, node.saved, node.ends or NO_ENDS


def _row(found: tuple, at: int, parent: int | None, serial: int | None) -> tuple:
    depth, first, n, children, leaves, saved, ends = found
    return 0, at, serial, first, depth, parent, n, children, leaves, saved, ends, None


def trie_nodes(rows: Iterator[tuple], at: int) -> Iterator[tuple]:
    """The nodes of a range's merged rows. A node is given with its parent's first conversation when the parent closes,
    at once if the parent is one that the range's first conversation opened."""
    path: list[Node] = []
    begun = False
    serials = 0

    def shared(node: Node, depth: int) -> tuple:
        return 1, at, node.serial, node.first, depth, None, node.n, node.children, node.leaves, node.saved, node.ends, node.turn

    def close() -> Iterator[tuple]:
        node = path.pop()
        if isinstance(node.ends, list):
            node.ends = node.ends[0].hexdigest()
        if node.serial is not None:
            yield shared(node, len(path))
            return
        node.finish()
        for found in node.below:
            yield _row(found, at, node.first, None)
        parent = path[-1]
        node.into(parent)
        if parent.serial is None:
            parent.below.append(_finished(node, len(path)))
        else:
            yield _row(_finished(node, len(path)), at, None, parent.serial)

    for seq, lcp, n, first, ids in rows:
        while len(path) > lcp + 1:
            yield from close()
        for i in range(len(path), len(seq) // WIDTH + 1):
            path.append(Node(seq[(i - 1) * WIDTH : i * WIDTH] if i else b"", None if begun else i))
        if not begun:
            serials, begun = len(path), True
        top = path[-1]
        top.members(n, first)
        if top.ends is None:
            top.ends = [hashlib.sha256(ids.encode())]
        else:
            top.ends[0].update(f",{ids}".encode())
    for depth, node in enumerate(path):  # what is open now may go on in the next range
        if node.serial is None:
            node.serial = serials
            serials += 1
        for found in node.below:
            yield _row(found, at, None, node.serial)
        node.below = []
    while path:
        yield from close()


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    schema, held = _schema(NODES), []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _merged_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each range in a task, from its runs' blocks in the order of need."""

    def stream():
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]

    blocks = stream()
    ahead = next(blocks, None)

    def following(name: str) -> dict | None:
        nonlocal ahead
        if ahead is None or ahead["run"] != name or ahead["range"] != at or not ahead["no"]:
            return None
        block, ahead = ahead, next(blocks, None)
        return block

    def nodes():
        nonlocal ahead, at
        while ahead is not None:
            at, runs = ahead["range"], []
            while ahead is not None and ahead["range"] == at and not ahead["no"]:
                runs.append(Run(ahead))
                ahead = next(blocks, None)
            yield from trie_nodes(merge(runs, following), at)

    at = -1
    yield from _batches(nodes())


def joined_edges(rows: Iterator[dict]) -> Iterator[tuple]:
    """The edge nodes of all ranges, in order of range and serial, put together on one open path."""
    path: list[Node] = []

    def close() -> Iterator[tuple]:
        node = path.pop()
        node.finish()
        for at, serial in node.edges:
            yield 2, at, serial, node.first, *[None] * 8
        for found in node.below:
            yield _row(found, -1, node.first, None)
        if path:
            node.into(path[-1])
            path[-1].below.append(_finished(node, len(path)))
        else:
            yield _row(_finished(node, 0), -1, None, None)

    for r in rows:
        depth = r["depth"]
        if depth >= len(path) or path[depth].turn != r["turn"]:
            while len(path) > depth:
                yield from close()
            path.append(Node(r["turn"]))
        node = path[depth]
        if r["n_convs"]:
            node.members(r["n_convs"], r["conv_id"])
        node.children += r["n_children"]
        node.leaves += r["n_leaves"]
        node.saved += r["saved_tokens"]
        node.ends = node.ends or r["ends_sha256"]
        node.edges.append((r["range"], r["serial"]))
    while path:
        yield from close()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(joined_edges(r for b in batches for r in b.to_pylist()))


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(convs: DataFrame, run_bytes: int = RUN_BYTES, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, least_ranges: int = LEAST_RANGES) -> DataFrame:
    """Per node of the trie of all conversations (conv long, seq binary; see strings()): conv_id (its smallest member),
    depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    No conversations: no node. Conversations without turns are members of the root alone. A hash of ids reads them in
    ascending order, so a conversation that many ids share is hashed by one task, from its stretches' lists one after
    another. The edges' task reads at most two conversations' turns a range.
    """
    rows = written(_grouped(convs), "conversations")
    runs = rows.mapInArrow(_sorted_runs(_bounds(rows, range_bytes, least_ranges), run_bytes, block_bytes), BLOCKS)
    needed = runs.repartition("range").sortWithinPartitions("range", F.col("no") > 0, "after", "after_part", "run", "no")
    nodes = written(needed.mapInArrow(_merged_ranges, NODES), "nodes")
    edges = written(nodes.filter("kind = 1").repartition(1).sortWithinPartitions("range", "serial").mapInArrow(_joined, NODES), "edges")
    known = small(edges.filter("kind = 2").select("range", "serial", F.col("conv_id").alias("of")), 200_000)
    inner = nodes.filter("kind = 0 AND serial IS NOT NULL").drop("parent_conv_id").join(known, ["range", "serial"]).withColumnRenamed("of", "parent_conv_id")
    return nodes.filter("kind = 0 AND serial IS NULL").select(*OUT).unionByName(inner.select(*OUT)).unionByName(edges.filter("kind = 0").select(*OUT))
