"""Near-duplicates of documents: a chosen-path set similarity join on word shingles (Christiani, Pagh and Sivertsen, 2018)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepweave.llm.common import dropped, row_name, small, written
from prepweave.llm.components import components

WORDS = 5
FUNCTIONS = 128
#: Pairs whose sketches differ in more places than lie this many deviations above the mean at the threshold are not tested.
DEVIATIONS = 4.6
SUB_BATCH = 1_500_000
#: Trees that are searched before the others, and classes that all blocks of a crowded node share.
FIRST, PIVOTS = 2, 4
_RANDOM = np.random.default_rng(20180601)
_PLACE = _RANDOM.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _RANDOM.integers(1, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 2**63, FUNCTIONS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes have no other letters' case, and split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(docs: list[list[bytes]]) -> list[np.ndarray]:
    """The set of each document's shingles as sorted 64-bit hashes: WORDS words, or all words of a shorter document."""
    known: dict[bytes, int] = {}
    for words in docs:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
    out = []
    for words in docs:
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(hashes)
        if n >= WORDS:
            sums = sum(hashes[i : n - WORDS + 1 + i] * _PLACE[i] for i in range(WORDS))
        elif n:
            sums = np.array([(hashes * _PLACE[:n]).sum() + np.uint64(n)], np.uint64)
        else:
            sums = hashes
        out.append(np.unique(_mixed(sums)))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """FUNCTIONS minwise hashes of each set; sets are not empty."""
    values = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), FUNCTIONS), np.uint32)
    for j in range(FUNCTIONS):
        out[:, j] = np.minimum.reduceat((values * _MULTIPLY[j] + _ADD[j]) >> np.uint64(32), starts)
    return out


def _planes(signature: np.ndarray) -> np.ndarray:
    """The lowest two bits of the minwise hashes as four longs a row: bit 0 of all, then bit 1 of all."""
    return np.concatenate([np.packbits((signature >> np.uint32(b)) & np.uint32(1), axis=1) for b in (0, 1)], axis=1).astype(np.uint8).view(np.int64)


def _sub_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[int], list[list[bytes]], pa.RecordBatch]]:
    for batch in batches:
        rows, words, chars = [], [], 0
        for i, t in enumerate(batch.column(column)):
            rows.append(i)
            words.append(words_of(t.as_py()))
            chars += sum(map(len, words[-1]))
            if chars > SUB_BATCH:
                yield rows, words, batch
                rows, words, chars = [], [], 0
        if rows:
            yield rows, words, batch


def code_of(words: list[bytes]) -> bytes | None:
    """A 128-bit name of a sequence of words; none for no words."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def sketched(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Per document: key, row (names key and text), code (names its words), n_shingles, signature, planes; signature and planes null without words."""

    def run(batches):
        for rows, words, batch in _sub_batches(batches, 2):
            sets = shingles(words)
            full = [i for i, s in enumerate(sets) if len(s)]
            signature = signatures([sets[i] for i in full]) if full else np.empty((0, FUNCTIONS), np.uint32)
            planes = _planes(signature) if full else np.empty((0, 4), np.int64)
            at = {i: n for n, i in enumerate(full)}
            pick = lambda table, i: table[at[i]] if i in at else None
            signed = signature.view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    batch.column(1).take(pa.array(rows)),
                    pa.array([code_of(w) for w in words], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([pick(signed, i) for i in range(len(rows))], pa.list_(pa.int32())),
                    pa.array([pick(planes, i) for i in range(len(rows))], pa.list_(pa.int64())),
                ],
                names=["doc", "row", "code", "n_shingles", "signature", "planes"],
            )

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), row_name(key, text), F.col(text)).mapInArrow(run, f"doc {kind}, row binary, code binary, n_shingles long, signature array<int>, planes array<long>")


def full_sets(docs: DataFrame, needed: DataFrame, text: str, key: str) -> DataFrame:
    """The shingle sets of the needed classes (columns code, row: one document of each): code, shingles."""

    def run(batches):
        for rows, words, batch in _sub_batches(batches, 1):
            sets = shingles(words)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["code", "shingles"])

    found = docs.select(row_name(key, text).alias("row"), F.col(text).alias("text")).join(small(needed, 500_000), "row")
    return found.select("code", "text").mapInArrow(run, "code binary, shingles array<long>").dropDuplicates(["code"])


def most_different(percent: int) -> int:
    """In how many of the places two sketches may differ: hashes that differ agree in both bits by a chance of 1 in 4. At
    85 percent places differ in 14.4 on average with a deviation of 3.6, and the result is 31."""
    chance = 0.75 * (1 - percent / 100)
    return min(FUNCTIONS, math.ceil(FUNCTIONS * chance + DEVIATIONS * math.sqrt(FUNCTIONS * chance * (1 - chance))))


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by their column `grp` in tables that cut no group."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        grp = table["grp"].to_numpy()
        last = int(np.searchsorted(grp, grp[-1])) if len(grp) else 0
        if last:
            yield table.slice(0, last).combine_chunks()
        rest = table.slice(last)
    if rest is not None and len(rest):
        yield rest.combine_chunks()


def _values(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and each row's first place in them."""
    lists = table[column].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))


class Rows:
    """The rows of some groups: which pairs a link is possible for."""

    def __init__(self, table: pa.Table, percent: int):
        self.percent, self.most_different = percent, most_different(percent)
        self.group, self.size, self.side = (table[c].to_numpy() for c in ("grp", "size", "side"))
        self.planes = _values(table, "planes")[0].view(np.uint64).reshape(-1, 4)
        self.component = np.unique(np.array(table["component"].to_pylist(), object), return_inverse=True)[1]

    def possible(self, i, j) -> np.ndarray:
        """Whether rows i and j may be linked by their sides, sizes and sketches."""
        least, most = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        x = self.planes[i] ^ self.planes[j]
        apart = np.bitwise_count(x[..., 0] | x[..., 2]) + np.bitwise_count(x[..., 1] | x[..., 3])
        return ((self.side[i] < 0) | (self.side[i] != self.side[j])) & (100 * least >= self.percent * most) & (apart <= self.most_different)

    def partnered(self) -> np.ndarray:
        """Marks the rows for which a link to a row of another component is possible in their group."""
        marked = np.zeros(len(self.group), bool)
        i, far = np.arange(len(self.group)), 1
        while len(i := i[i + far < len(self.group)]) and len(i := i[self.group[i] == self.group[i + far]]):
            pair = i[self.component[i] != self.component[i + far]]
            pair = pair[self.possible(pair, pair + far)]
            marked[pair] = marked[pair + far] = True
            far += 1
        return marked


def links_of(table: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Links within each group, as places of rows: for components that links of full sets join, the links that join them,
    at most one fewer than there are components. Every pair of different components that may be linked is tested."""
    rows = Rows(table, percent)
    values, starts = _values(table, "shingles")
    values = values.view(np.uint64)  # their order
    root = np.arange(int(rows.component.max(initial=-1)) + 1)
    left, right = [], []
    edges = np.concatenate((np.flatnonzero(np.diff(rows.group, prepend=rows.group[0] - 1)), [len(rows.group)]))
    for at, end in zip(edges, edges[1:]):
        for i in range(at, end - 1):
            j = np.arange(i + 1, end)
            j = j[root[rows.component[j]] != root[rows.component[i]]]
            j = j[rows.possible(i, j)]
            if not len(j):
                continue
            own = values[starts[i] : starts[i + 1]]
            # sets are sorted, so a value is in `own` if it stands where it would be put
            other = np.concatenate([values[starts[k] : starts[k + 1]] for k in j])
            found = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
            lengths = starts[j + 1] - starts[j]
            both = np.add.reduceat(found, np.concatenate(([0], np.cumsum(lengths)[:-1])), dtype=np.int64)
            for k in j[100 * both >= percent * (len(own) + lengths - both)]:
                a, b = root[rows.component[i]], root[rows.component[k]]
                if a != b:
                    root[root == b] = a
                    left.append(i)
                    right.append(int(k))
    return left, right


class Join:
    """The steps of one similarity join over the classes of equal word sequences."""

    def __init__(self, docs: DataFrame, text: str, key: str, percent: int, trees: int, node_size: int, depth: int, block_rows: int):
        self.docs, self.text, self.key = docs, text, key
        self.percent, self.trees, self.node_size, self.depth, self.block_rows = percent, trees, node_size, depth, block_rows
        spark = docs.sparkSession
        self.tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sketches = written(sketched(docs, text, key), "sketched")
        self.rows = written(sketches.select("doc", "row", "code", "n_shingles"), "rows")
        grouped = sketches.filter("code is not null").groupBy("code").agg(F.min("row").alias("row"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature"), F.first("planes").alias("planes"))
        self.classes = written(grouped, "classes")
        dropped(sketches)
        self.linked = self.edges = None

    def component(self, rows: DataFrame) -> DataFrame:
        if self.linked is None:
            return rows.withColumn("component", F.col("code"))
        labels = self.linked.select(F.col("vertex").alias("code"), "component")
        return rows.join(labels, "code", "left").withColumn("component", F.coalesce("component", "code"))

    def coordinates(self, *path: Column) -> Column:
        """The minwise hashes by which a node branches: one, and a second one at times, so that a pair of the least
        similarity shares one child on average."""
        draw = lambda what, n: F.pmod(F.xxhash64(F.lit(what), *path), F.lit(n)).cast("int")
        second = draw("more", 1000) < int(1000 * (100 / self.percent - 1))
        return F.when(second, F.array(draw("one", FUNCTIONS), draw("two", FUNCTIONS))).otherwise(F.array(draw("one", FUNCTIONS)))

    def children(self, rows: DataFrame) -> DataFrame:
        """The rows (node, component and a class's columns) of nodes in the nodes' children."""
        chosen = rows.withColumn("at", F.explode(F.array_distinct(self.coordinates(F.col("node")))))
        return chosen.select(F.xxhash64("node", "at", F.get("signature", F.col("at"))).alias("node"), "code", "component", "size", "planes")

    def roots(self, trees: range) -> DataFrame:
        nodes = F.explode(F.transform(F.sequence(F.lit(trees[0] + 1), F.lit(trees[-1] + 1)), lambda t: F.xxhash64(F.lit("tree"), t)))
        return self.open(self.children(self.component(self.classes.select("code", "size", "signature", "planes")).withColumn("node", nodes)))

    def branch(self, rows: DataFrame) -> DataFrame:
        signed = rows.join(self.classes.select("code", "size", "signature", "planes"), "code")
        return self.open(self.children(self.component(signed)))

    @staticmethod
    def open(rows: DataFrame) -> DataFrame:
        """The rows of nodes that hold more than one component, with n, the node's rows; in the others no link is left to
        find. The nodes are counted first, so that the rows of closed ones are neither written nor shuffled."""
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        nodes = written(nodes.filter("lo <> hi").select("node", "n"), "nodes")
        found = written(rows.join(small(nodes, 500_000), "node"), "open")
        dropped(nodes)
        return found

    def groups(self, rows: DataFrame, last: bool) -> DataFrame:
        """The groups that are compared exhaustively, columns grp and side. A node of at most node_size classes, and at the last
        level any node, is cut into random blocks; each block, and each pair of blocks, is a group, in which a row of a pair is
        compared with the other block. Of a larger node only the blocks are groups, and they share a few classes of the node, so
        that what is alike comes together at once."""
        own = ["code", "component", "size", "planes"]
        blocks = F.ceil(F.col("n") / self.block_rows).cast("int")
        rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("code"), F.col("blocks").cast("long")).cast("int"))
        paired = F.lit(True) if last else F.col("n") <= self.node_size
        met = rows.filter(paired).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") < F.col("other")).cast("int"))
        found = met.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), side.alias("side"), *own)
        if last:
            return found
        large = rows.filter(~paired)
        rank = F.xxhash64(F.lit("pivot"), "code")
        few = [F.min(F.when(F.pmod(rank, F.lit(PIVOTS)) == i, F.struct(rank.alias("rank"), *own))).alias(f"p{i}") for i in range(PIVOTS)]
        shared = large.groupBy("node", "blocks").agg(*few).select("node", "blocks", F.explode(F.array_compact(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("p"))
        shared = shared.select("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), *[F.col(f"p.{c}").alias(c) for c in own])
        each = large.select("node", "own", *own).unionByName(shared)
        return found.unionByName(each.select(F.xxhash64("node", "own").alias("grp"), F.lit(-1).alias("side"), *own))

    def solve(self, groups: DataFrame) -> DataFrame:
        """The links (u, v) that join components in the groups. Rows for which sizes and sketches allow no link leave first;
        the others get their full sets."""
        percent = self.percent
        kinds = "grp long, side int, code binary, component binary, size long, planes array<long>"
        names = [c.split()[0] for c in kinds.split(", ")]

        def mark(batches):
            for table in by_group(batches):
                yield from table.filter(pa.array(Rows(table, percent).partnered())).to_batches()

        def link(batches):
            for table in by_group(batches):
                left, right = links_of(table, percent)
                yield pa.RecordBatch.from_arrays([table["code"].take(pa.array(x, pa.int64())).combine_chunks() for x in (left, right)], names=["u", "v"])

        dealt = lambda df: df.repartition(self.tasks, "grp").sortWithinPartitions("grp")
        marked = written(dealt(groups.select(*names)).mapInArrow(mark, kinds), "marked")
        needed = written(marked.select("code").distinct().join(self.classes.select("code", "row"), "code"), "needed")
        sets = written(full_sets(self.docs, needed, self.text, self.key), "sets")
        found = written(dealt(marked.join(sets, "code").select(*names, "shingles")).mapInArrow(link, "u binary, v binary"), "links")
        dropped(marked, needed, sets)
        return found

    def link(self, links: DataFrame) -> None:
        """Adds links to the components; if there are none, the components stay as they are."""
        if not links.isEmpty():
            old, self.edges = self.edges, written(links if self.edges is None else self.edges.unionByName(links), "edges")
            dropped(old, self.linked)
            self.linked = components(self.edges)
        dropped(links)

    def run(self) -> None:
        # the first trees find most links, so that most nodes of the others hold one component and are closed
        for trees in (range(min(FIRST, self.trees)), range(FIRST, self.trees)):
            rows = self.roots(trees) if trees else None
            for level in range(self.depth + 1 if trees else 0):
                last = level == self.depth
                self.link(self.solve(self.groups(rows, last)))
                large = rows.filter(F.col("n") > self.node_size).select("node", "code")
                if last or large.isEmpty():
                    break
                old, rows = rows, self.branch(large)
                dropped(old)
            dropped(rows)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 85, trees: int = 10, node_size: int = 16_384, depth: int = 4, block_rows: int = 1024) -> DataFrame:
    """Per document: key, n_shingles, component_id (smallest key reachable over links, its own included), kept.

    A document's set has its different shingles of five words (A-Z in lower case); two documents are linked if 100 times
    the common shingles are at least `percent` times all shingles of both. Equal word sequences are one class first. The
    classes are branched in `trees` independent trees: a node picks one or two minwise hashes and sends each class to the
    child named by its value. A node whose classes are one component is done. Nodes of at most node_size classes are compared
    exhaustively, in pairs of blocks of about block_rows, so that no node is one task; larger ones are compared within the blocks only, which brings most of a group of copies
    together, and branch again if they stay open; what is still larger after `depth` levels is compared exhaustively. Sizes and sketches only rule pairs out; a group of rows gives at most as many links as it has rows, each
    confirmed on full sets, and pairs that are connected already are not tested. A pair at the threshold meets in a tree with a chance of about 0.87 at the
    first level, so ten trees miss one in 10^8; chances fall with depth, so a pair that stays in crowded nodes to depth 4 is
    missed about 1.5 times in 10^4 (by a reviewer's reckoning, without what pivots catch). The sketch test misses at
    most three in 10^5 at 50 to 95 `percent`.

    A null or empty text has no shingles and is linked with nothing. Rows that repeat a key are taken each for itself; a
    null key is never a component's smallest unless there is no other. An empty table gives an empty result.
    """
    join = Join(docs.select(F.col(key), F.col(text)), text, key, percent, trees, node_size, depth, block_rows)
    join.run()
    labelled = join.component(join.rows.select(F.col("doc"), "code", "n_shingles"))
    least = labelled.filter("code is not null").groupBy("component").agg(F.min("doc").alias("least"))
    found = labelled.join(least, "component", "left").withColumn("component_id", F.when(F.col("code").isNull(), F.col("doc")).otherwise(F.col("least")))
    return found.select(F.col("doc").alias(key), "n_shingles", "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", **limits: int) -> DataFrame:
    """One row of each component of near_duplicates(), and all rows without words, which are linked with nothing.

    A component keeps a row of its smallest key (a null key only if it has no other); of several such rows that with the
    smallest name of its text, then with the smallest other values. Rows are told apart by key and text, so rows that share
    a key, or have none, and are no near-duplicates all stay. limits are those of near_duplicates().
    """
    defaults = {"percent": 85, "trees": 10, "node_size": 16_384, "depth": 4, "block_rows": 1024} | limits
    join = Join(docs.select(F.col(key), F.col(text)), text, key, **defaults)
    join.run()
    labelled = join.component(join.rows.select("doc", "row", "code"))
    least = labelled.filter("code is not null").groupBy("component").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "row"))["row"].alias("__row"))
    bare = labelled.filter("code is null").select(F.col("row").alias("__row"), F.lit(False).alias("__one"))
    found = written(least.select("__row", F.lit(True).alias("__one")).unionByName(bare.distinct()), "kept")
    kept = docs.withColumn("__row", row_name(key, text)).join(F.broadcast(found) if found.count() <= 500_000 else found, "__row")
    rest = [c for c in docs.columns if c not in (key, text)]
    first = kept.filter("__one").groupBy("__row").agg(F.min(F.struct(*rest, key, text)).alias("__first"))
    return first.select(*[F.col("__first")[c].alias(c) for c in docs.columns]).unionByName(kept.filter(~F.col("__one")).select(*docs.columns))
