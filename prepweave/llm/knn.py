"""Exact top-k by inner product: a Voronoi kNN join (Lu, Shen, Chen and Ooi, 2012)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from prepweave.llm.common import written

SALTS = 64
#: Relative slack of the distance bounds, far above the rounding of doubles.
SLACK = 1e-6
BATCH = 512


def quantise(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = 256) -> DataFrame:
    """Columns id, ints, code: each component as floor(scale * x). Vectors that are null or hold a null or non-finite
    component take no part, nor do rows without a key. code names equal vectors."""
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    ints = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    return vectors.filter(fine & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), ints.alias("ints")).withColumn("code", F.md5(F.array_join("ints", ",")))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """Each different vector once with its `keep` smallest ids: no other row of that vector can be among `keep` best.
    A frequent vector is cut down in salted groups first."""
    salted = W.partitionBy("code", "salt").orderBy("id")
    some = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= keep)
    best = some.withColumn("n", F.row_number().over(W.partitionBy("code").orderBy("id"))).filter(F.col("n") <= keep)
    return best.groupBy("code").agg(F.first("ints").alias("ints"), F.sort_array(F.collect_list("id")).alias("ids"))  # at most `keep` rows


class Cells:
    """Pivots of one dimension in the metric space that makes the largest inner product the nearest neighbour.

    A data vector x gets the further component sqrt(M - |x|^2), with M the largest squared length, a query gets 0; then
    |q - x|^2 = |q|^2 + M - 2 q.x.
    """

    def __init__(self, pivots: np.ndarray, largest: float, groups: int):
        self.largest = largest
        self.pivots = self.lift(pivots)
        # cells of nearby pivots share a query group: each goes to the nearest of the first few pivots
        self.centres = self.distance(self.pivots, self.pivots[:groups])
        self.group = self.centres.argmin(axis=1)
        # the narrowest integers that hold every component
        self.kind = next((t for t in (np.int16, np.int32) if 2 * np.sqrt(largest) < np.iinfo(t).max), np.int64)

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack((x, np.sqrt(np.maximum(0.0, self.largest - (x * x).sum(axis=1)))))

    @staticmethod
    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T))

    def of_data(self, x: np.ndarray) -> np.ndarray:
        return self.distance(self.lift(x), self.pivots)

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return self.distance(np.column_stack((x, np.zeros(len(x)))), self.pivots)

    def packed(self, vectors: pd.Series) -> list[bytes]:
        return [np.asarray(v, self.kind).tobytes() for v in vectors]


class Blocks:
    """The cells that a query group needs, in order of their distance from its centre, in blocks of about so many rows. A
    larger cell is several blocks by its vectors' codes."""

    def __init__(self, cells: np.ndarray, rows: np.ndarray, least: np.ndarray, most: np.ndarray, block_rows: int, queries: int, query_rows: int):
        self.cells, self.least, self.most = cells, least, most
        self.parts = max(1, -(-queries // query_rows))
        self.starts, self.first, self.pieces = [], [], []  # of each run of cells: its first cell, first block, blocks
        filled = block = 0
        for i, n in enumerate(rows):
            if not i or filled + n > block_rows:
                block += self.pieces[-1] if i else 0
                self.starts.append(i)
                self.first.append(block)
                self.pieces.append(max(1, -(-int(n) // block_rows)))
                filled = 0
            filled += int(n)
        self.starts, self.first, self.pieces = (np.array(x, np.int64) for x in (self.starts, self.first, self.pieces))
        run = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(cells))))
        self.of_cell = {int(c): (int(self.first[r]), int(self.pieces[r])) for c, r in zip(cells, run)}

    def reached(self, away: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query's number and a block that may hold a vector within the query's bound."""
        near = away[:, self.cells]
        lower = np.maximum(near - self.most, self.least - near)
        query, run = np.nonzero(np.logical_or.reduceat(lower <= _slack(upper)[:, None], self.starts, axis=1))
        times = self.pieces[run]
        offset = np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
        return np.repeat(query, times), np.repeat(self.first[run], times) + offset


def _slack(upper: np.ndarray | float) -> np.ndarray | float:
    return upper + SLACK * (1.0 + upper)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in vectors])


def _by_dimension(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Vectors of one dimension, few enough that their distances from all pivots are a small matrix."""
    for frame in frames:
        for d, part in frame.groupby(frame["ints"].map(len)):
            for at in range(0, len(part), BATCH):
                yield d, part.iloc[at : at + BATCH]


def _scores(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Inner products as exact integers; beyond the range of longs they are cut to it."""
    bound = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(s.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**53:
        return (q.astype(np.float64) @ s.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ s.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, vector: str = "embedding", key: str = "vec_id",
    pivots: int = 64, most_pivots: int = 4096, groups: int = 1, most_groups: int = 256, block_rows: int = 4096, query_rows: int = 4096,
) -> DataFrame:
    """Per query its k highest scores: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    Queries are the rows whose key is divisible by `every`; candidates are all rows of the same dimension with another
    key; the score is the inner product of the quantised vectors. Equal vectors are solved once. Pivots are a sample (the
    first codes of each dimension) of the root of the number of vectors, from `pivots` to `most_pivots`; each vector falls
    into its nearest pivot's cell. From the cells' summaries each query has an upper bound of its (k+1)th distance, each
    query group the largest bound. A vector goes to a group only if the triangle inequality allows it to lie within the
    bound; there its cell is part of one or several blocks of about block_rows of the vectors sent, and a query goes only
    to the blocks with a cell that its own bound reaches. A task compares one block with at most about query_rows queries,
    so there are as many query groups as that asks for, from `groups` to `most_groups`, and larger ones are dealt in
    parts. A last ranking merges k+1 rows of each block. A key that repeats is asked once. Vectors without components
    score 0. An empty table gives an empty result; other columns are not read.
    """
    keep = k + 1
    rows = written(quantise(vectors, vector, key), "quantised")
    data = written(distinct_vectors(rows, keep), "vectors")
    asked = rows.filter(F.col("id") % every == 0).select("id", "code").distinct()
    queries = written(data.select("code", "ints").join(asked.select("code").distinct(), "code", "left_semi"), "queries")
    sized = data.withColumn("dim", F.size("ints"))
    square = F.aggregate("ints", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    facts = {r["dim"]: r for r in sized.groupBy("dim").agg(F.max(square).alias("largest"), F.count("*").alias("n")).collect()}  # one row a dimension
    posed = {r["dim"]: r["n"] for r in queries.groupBy(F.size("ints").alias("dim")).agg(F.count("*").alias("n")).collect()}
    wanted = {d: min(most_pivots, max(pivots, math.isqrt(r["n"]))) for d, r in facts.items()}
    limit = F.create_map(*[F.lit(x) for d in wanted for x in (d, wanted[d])])[F.col("dim")] if wanted else F.lit(0)
    first = sized.withColumn("place", F.row_number().over(W.partitionBy("dim", F.pmod(F.xxhash64("code"), F.lit(SALTS))).orderBy("code"))).filter(F.col("place") <= limit)
    first = first.withColumn("place", F.row_number().over(W.partitionBy("dim").orderBy("code"))).filter(F.col("place") <= limit)
    sample: dict[int, list] = {}
    for r in first.select("dim", "ints").orderBy("dim", "code").collect():  # at most `most_pivots` rows a dimension
        sample.setdefault(r["dim"], []).append(r["ints"])
    many = {d: min(most_groups, max(groups, -(-posed.get(d, 0) // query_rows))) for d in facts}
    cells = {d: Cells(np.array(p, np.int64).reshape(len(p), d), float(facts[d]["largest"]), many[d]) for d, p in sample.items()}

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d, part in _by_dimension(frames):
            away = cells[d].of_data(_matrix(part["ints"]))
            yield part.assign(dim=d, cell=away.argmin(axis=1), away=away.min(axis=1))

    placed = written(data.mapInPandas(assign, "code string, ints array<long>, ids array<long>, dim int, cell int, away double"), "cells")
    nearest = placed.withColumn("n", F.row_number().over(W.partitionBy("dim", "cell", F.pmod(F.xxhash64("code"), F.lit(SALTS))).orderBy("away"))).filter(F.col("n") <= keep)
    nearest = nearest.withColumn("n", F.row_number().over(W.partitionBy("dim", "cell").orderBy("away"))).filter(F.col("n") <= keep)
    summary: dict[int, list[tuple[int, float]]] = {}
    for r in nearest.select("dim", "cell", F.col("away"), F.size("ids").alias("copies")).collect():  # k+1 rows a cell
        summary.setdefault(r["dim"], []).extend([(r["cell"], r["away"])] * min(r["copies"], keep))

    def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d, part in _by_dimension(frames):
            away = cells[d].of_queries(_matrix(part["ints"]))
            cell, inner = (np.array(x) for x in zip(*summary[d]))
            if len(cell) < keep:
                upper = np.full(len(part), np.inf)
            else:
                upper = np.partition(away[:, cell] + inner[None, :], keep - 1, axis=1)[:, keep - 1]
            yield part.assign(dim=d, grp=cells[d].group[away.argmin(axis=1)], upper=upper)

    bounded = written(queries.mapInPandas(bound, "code string, ints array<long>, dim int, grp int, upper double"), "bounds")

    def ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of a task's queries, per group the largest bound, and the least and greatest distance from each pivot."""
        found: dict[tuple[int, int], list] = {}
        for d, part in _by_dimension(frames):
            away, group, upper = cells[d].of_queries(_matrix(part["ints"])), part["grp"].to_numpy(), part["upper"].to_numpy()
            for g in np.unique(group):
                at = group == g
                n, least, low, high = found.get((d, int(g)), (0, -np.inf, np.inf, -np.inf))
                found[d, int(g)] = [n + int(at.sum()), max(least, upper[at].max()), np.minimum(low, away[at].min(axis=0)), np.maximum(high, away[at].max(axis=0))]
        for (d, g), (n, most, low, high) in found.items():
            yield pd.DataFrame({"dim": d, "grp": g, "n": n, "upper": most, "cell": np.arange(len(low)), "low": low, "high": high})

    spans = bounded.select("ints", "grp", "upper").mapInPandas(ranges, "dim int, grp int, n long, upper double, cell int, low double, high double")
    reach: dict[tuple[int, int], list] = {}
    for r in spans.groupBy("dim", "grp", "cell").agg(F.sum("n").alias("n"), F.max("upper").alias("upper"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim", "grp", "cell").collect():  # groups by pivots
        reach.setdefault((r["dim"], r["grp"]), []).append((r["n"], r["upper"], r["low"], r["high"]))
    limits = {g: (int(x[0][0]), x[0][1], np.array([r[2] for r in x]), np.array([r[3] for r in x])) for g, x in reach.items()}
    of_dim = {d: [g for at, g in limits if at == d] for d in facts}

    def goes(d: int, g: int, cell: np.ndarray, away: np.ndarray) -> np.ndarray:
        _, upper, low, high = limits[d, g]
        return np.maximum(low[cell] - away, away - high[cell]) <= _slack(upper)

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, part in frame.groupby("dim"):
                for g in of_dim[d]:
                    sent = part[goes(d, g, part["cell"].to_numpy(), part["away"].to_numpy())].groupby("cell")["away"].agg(["size", "min", "max"]).reset_index()
                    yield sent.set_axis(["cell", "n", "least", "most"], axis=1).assign(dim=d, grp=g)

    weighed = placed.select("dim", "cell", "away").mapInPandas(weigh, "dim int, grp int, cell int, n long, least double, most double")
    needed: dict[tuple[int, int], list] = {}
    for r in weighed.groupBy("dim", "grp", "cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect():  # groups by pivots
        needed.setdefault((r["dim"], r["grp"]), []).append((r["cell"], r["n"], r["least"], r["most"]))
    blocks = {}
    for (d, g), found in needed.items():
        found.sort(key=lambda x: (cells[d].centres[x[0], g], x[0]))
        cell, n, least, most = (np.array(x) for x in zip(*found))
        blocks[d, g] = Blocks(cell, n, least, most, block_rows, limits[d, g][0], query_rows)

    def replicate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, part in frame.groupby("dim"):
                cell, away = part["cell"].to_numpy(), part["away"].to_numpy()
                name = part["code"].map(lambda c: int(c[:12], 16)).to_numpy()
                packed = pd.Series(cells[d].packed(part["ints"]), index=part.index)
                for g in of_dim[d]:
                    sent = goes(d, g, cell, away)
                    if sent.any():
                        to = np.array([blocks[d, g].of_cell[c] for c in cell[sent]])
                        for p in range(blocks[d, g].parts):
                            yield pd.DataFrame({"dim": d, "grp": g, "part": p, "block": to[:, 0] + name[sent] % to[:, 1], "packed": packed[sent], "ids": part["ids"][sent]})

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d, part in _by_dimension(frames):
            away = cells[d].of_queries(_matrix(part["ints"]))
            packed = np.array(cells[d].packed(part["ints"]), object)
            code, group, upper = (part[c].to_numpy() for c in ("code", "grp", "upper"))
            for g in np.unique(group):
                at = np.flatnonzero(group == g)
                query, block = blocks[d, int(g)].reached(away[at], upper[at])
                piece = np.array([int(c[12:24], 16) % blocks[d, int(g)].parts for c in code[at]])
                yield pd.DataFrame({"dim": d, "grp": g, "part": piece[query], "block": block, "packed": packed[at][query], "code": pd.Series(code[at][query], dtype=object)})

    sent = placed.mapInPandas(replicate, "dim int, grp int, part int, block int, packed binary, ids array<long>")
    posed_to = bounded.select("code", "ints", "grp", "upper").mapInPandas(spread, "dim int, grp int, part int, block int, packed binary, code string")

    def solve(key, posed: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        out = {"code": [], "id": [], "score": []}
        if len(posed) and len(sent):
            d = key[0]
            sent = sent.assign(least=[v[0] for v in sent["ids"]]).sort_values("least", kind="stable")
            ids = list(sent["ids"])
            s = np.frombuffer(b"".join(sent["packed"]), cells[d].kind).reshape(len(sent), d)
            for at in range(0, len(posed), 256):
                part = posed.iloc[at : at + 256]
                q = np.frombuffer(b"".join(part["packed"]), cells[d].kind).reshape(len(part), d)
                scores = _scores(q, s)
                floor = np.partition(scores, -keep, axis=1)[:, -keep] if len(s) > keep else scores.min(axis=1)
                for code, row, least in zip(part["code"], scores, floor):
                    hits = np.flatnonzero(row >= least)
                    hits = hits[np.argsort(-row[hits], kind="stable")][:keep]  # ties by smallest id, as rows are in that order
                    found = sorted((-int(row[h]), int(i)) for h in hits for i in ids[h])[:keep]
                    out["code"] += [code] * len(found)
                    out["id"] += [i for _, i in found]
                    out["score"] += [-v for v, _ in found]
        return pd.DataFrame(out, dtype=object).astype({"id": "int64", "score": "int64"})

    task = ["dim", "grp", "part", "block"]
    near = posed_to.groupBy(*task).cogroup(sent.groupBy(*task)).applyInPandas(solve, "code string, id long, score long")
    best = near.withColumn("n", F.row_number().over(W.partitionBy("code").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= keep).drop("n")
    found = asked.select(F.col("id").alias("query_id"), "code").join(best, "code").filter("id <> query_id")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
