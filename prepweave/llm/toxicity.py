"""Toxicity by a convolutional network over hashed word embeddings, several filter widths and max pooling, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepweave.llm import language
from prepweave.llm.common import drawn, small, written
from prepweave.llm.language import SPACE, held_out

#: Rows of the embedding table. A word has two for itself, by two hashes, so that two words hardly ever share both, and one
#: each for its first letters, as many languages put words together. A further row of zeros stands for no word.
SLOTS, PREFIXES = 1 << 16, (6, 8)
PARTS = 2 + len(PREFIXES)
#: The odd base of the polynomial by which letters are hashed modulo 2 ** 64, and the factors that mix its bits.
BASE, FACTORS = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
WIDTHS, FILTERS, SIZE = (1, 2, 3), 8, 12
REACH, POOLED = max(WIDTHS) - 1, len(WIDTHS) * FILTERS
#: Characters that are read at a time, and how many of a text's last words its next stretch begins with: REACH or more.
STRETCH, REMEMBERED = 1 << 15, REACH
#: How often tasks' networks are averaged, and bins of a unit of a logit in which checked documents are counted.
MIXES, GRID = 3, 256
#: Bytes of documents that a task trains on at a time at most.
HELD = 1 << 28
#: A score from which a document counts as toxic; thresholds of languages are moved to it.
EVEN = 0.3


def points_of(text: str) -> np.ndarray:
    """The text's letters in lower case, one by one, and a space for each other character."""
    return language._letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def runs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], points != SPACE, [False]))))
    return edges[::2], edges[1::2]


@lru_cache(4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse."""
    steps = np.full((2, size), [[BASE], [pow(BASE, -1, 1 << 64)]], np.uint64)
    steps[:, 0] = 1
    return tuple(np.cumprod(steps, axis=1, dtype=np.uint64))


def hashed(points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The embedding rows of all words: hashes of a run of letters are differences of running sums."""
    up, down = _powers(1 << len(points).bit_length())
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(points * up[: len(points)], dtype=np.uint64)))
    out = np.empty((len(begins), PARTS), np.uint16)
    first = down[begins]
    for i, ends_at in enumerate((ends, *[np.minimum(ends, begins + k) for k in PREFIXES])):
        h = (sums[ends_at] - sums[begins]) * first
        for f in FACTORS:
            h = (h ^ (h >> 31)) * np.uint64(f)
        h ^= h >> 32
        if i == 0:
            out[:, 0] = h % SLOTS
        out[:, i + 1] = (h >> (16 * i + 16)) % SLOTS
    return out


def words_of(text: str | None) -> Iterator[str]:
    """The words one by one: runs of letters in lower case."""
    points = points_of(text or "")
    return (points[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(*runs(points)))


def slots(word: str) -> tuple[int, ...]:
    """The embedding rows of a lower-case word."""
    return tuple(hashed(points_of(word), np.array([0]), np.array([len(word)]))[0].tolist())


def stretches(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """The embedding rows of the words of some texts, about STRETCH characters at a time; with each of these texts' number of
    words, and whether the last one goes on as the first one of the next stretch. A text is cut between words, but for a
    word of over STRETCH letters, which counts as several."""
    held, size, blank = [], 0, np.full(1, SPACE, np.uint32)

    def together() -> tuple[np.ndarray, np.ndarray]:
        points = np.concatenate([x for p in held for x in (p, blank)])
        begins, ends = runs(points)
        counts = np.diff(np.searchsorted(begins, np.cumsum([0] + [len(p) + 1 for p in held])))
        held.clear()
        return hashed(points, begins, ends), counts

    for text in texts:
        text, at = text or "", 0
        while True:
            points, goes_on = points_of(text[at : at + STRETCH]), at + STRETCH < len(text)
            if goes_on:
                blanks = np.flatnonzero(points == SPACE)
                points = points[: blanks[-1] + 1] if len(blanks) else points
            at += len(points)
            held.append(points)
            size += len(points) + 1
            if goes_on or size > STRETCH:
                yield *together(), goes_on
                size = 0
            if not goes_on:
                break
    if held:
        yield *together(), False


def rows_by_text(texts: list[str | None]) -> list[bytes]:
    """Each text's rows, as bytes."""
    parts = [[]]
    for rows, counts, goes_on in stretches(texts):
        ends = np.cumsum(counts)
        for a, b in zip(ends - counts, ends):
            parts[-1].append(rows[a:b].tobytes())
            parts.append([])
        if goes_on:
            parts.pop()
    return [b"".join(x) for x in parts[:-1]]


def embedded(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of each word's rows of a table."""
    out = table.take(rows[:, 0], axis=0)
    for i in range(1, PARTS):
        out += table.take(rows[:, i], axis=0)
    return out


class Network:
    """The weights: an embedding table, filters of each width, a shift and an outgoing weight for each filter, a bias."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.table = np.zeros((SLOTS + 1, SIZE), np.float32)
        self.table[:SLOTS] = r.normal(0, 0.02, (SLOTS, SIZE))
        self.filters = [r.normal(0, 0.1, (k, SIZE, FILTERS)).astype(np.float32) for k in WIDTHS]
        for f in self.filters:
            f[:, 0] += 1 / len(f)  # the first dimension begins as the word's own evidence
        self.shifts, self.out, self.bias = np.full(POOLED, -0.5, np.float32), np.full(POOLED, 0.2, np.float32), np.float32(-1)
        self.sums = np.full(SLOTS + 1, 0.1, np.float32)
        self.held = [np.full_like(w, 0.1) for w in (*self.filters, self.shifts, self.out)] + [np.float32(0.1)]

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.shifts, 0) @ self.out + self.bias

    def fit(self, docs: list[np.ndarray], y: np.ndarray, rounds: int, rate: float, seed: int = 7) -> None:
        """Adagrad on the log loss, from the words' own evidence on."""
        self.begin(*evidence(docs, y), len(y), y.sum())
        self.train(docs, y, rounds, rate, seed)

    def train(self, docs: list[np.ndarray], y: np.ndarray, rounds: int, rate: float, seed: int = 7) -> None:
        """Only the words at which a filter is largest get a gradient. Sums of squares go on from the last call."""
        r, sums, held = np.random.default_rng(seed), self.sums, self.held
        for _ in range(rounds):
            for some in np.array_split(r.permutation(len(docs)), max(1, len(docs) // 64)):
                rows, starts = joined([docs[i] for i in some])
                x = embedded(self.table, rows)
                ends, n = np.append(starts[1:], len(rows) - REACH), len(rows) - REACH
                at, best = [], []
                for f in self.filters:
                    z = sum(x[j : j + n] @ f[j] for j in range(len(f)))
                    at.append(np.array([a + z[a:b].argmax(axis=0) for a, b in zip(starts, ends)]))
                    best.append(np.take_along_axis(z, at[-1], axis=0))
                pooled = np.concatenate(best, axis=1)
                hidden = np.maximum(pooled + self.shifts, 0)
                miss = (1 / (1 + np.exp(-(hidden @ self.out + self.bias))) - y[some]).astype(np.float32) / len(some)
                down = miss[:, None] * self.out * (hidden > 0)
                steps, places, back = [], [], []
                for i, f in enumerate(self.filters):
                    d, step = down[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(f)
                    for j in range(len(f)):
                        step[j] = np.einsum("bcd,bc->dc", x[at[i] + j], d)
                        places.append(rows[at[i] + j].reshape(-1, PARTS))
                        back.append((d[:, :, None] * f[j].T).reshape(-1, SIZE))
                    steps.append(step)
                steps += [down.sum(axis=0), hidden.T @ miss, miss.sum()]
                touched, which = np.unique(np.concatenate(places), return_inverse=True)
                grad = np.zeros((len(touched), SIZE), np.float32)
                np.add.at(grad, which.reshape(-1), np.repeat(np.concatenate(back), PARTS, axis=0))
                sums[touched] += (grad**2).mean(axis=1)
                self.table[touched] -= rate * grad / np.sqrt(sums[touched])[:, None]
                self.table[SLOTS] = 0
                for w, h, s in zip((*self.filters, self.shifts, self.out), held, steps):
                    h += s**2
                    w -= 0.2 * rate * s / np.sqrt(h)
                held[-1] += steps[-1] ** 2
                self.bias -= 0.2 * rate * steps[-1] / np.sqrt(held[-1])

    def begin(self, n: np.ndarray, yes: np.ndarray, docs: int, positive: float) -> None:
        """The first dimension of each row: the log odds of documents that hold it, drawn to none where they are few."""
        odds = np.log((yes + 0.5) / (positive + 1)) - np.log((n - yes + 0.5) / (docs - positive + 1))
        self.table[:SLOTS, 0] += (odds * n / (n + 6) / PARTS).astype(np.float32)

    def state(self) -> np.ndarray:
        """All weights and sums of squares: a row for each row of the table, then the others in rows of the same width."""
        rest = np.concatenate([np.ravel(w) for w in (*self.filters, self.shifts, self.out, self.bias, *self.held)])
        rest = np.append(rest, np.zeros(-len(rest) % (SIZE + 1))).reshape(-1, SIZE + 1)
        return np.concatenate([np.concatenate([self.table, self.sums[:, None]], axis=1), rest]).astype(np.float32)

    def put(self, state: np.ndarray) -> None:
        self.table, self.sums, rest = state[: SLOTS + 1, :SIZE].copy(), state[: SLOTS + 1, SIZE].copy(), state[SLOTS + 1 :].ravel()
        parts = [*self.filters, self.shifts, self.out, self.bias, *self.held]
        cuts = np.cumsum([np.size(w) for w in parts])
        parts = [x.reshape(np.shape(w)).copy() for x, w in zip(np.split(rest, cuts), parts)]
        n = len(WIDTHS)
        self.filters, self.shifts, self.out, self.bias, self.held = parts[:n], parts[n], parts[n + 1], np.float32(parts[n + 2]), [*parts[n + 3 : -1], np.float32(parts[-1])]


def evidence(docs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many documents hold each row of the table, and how many of them are positive."""
    n, yes = np.zeros(SLOTS), np.zeros(SLOTS)
    for rows, label in zip(docs, y):
        seen = np.zeros(SLOTS, bool)
        seen[rows] = True
        held = np.flatnonzero(seen)
        n[held] += 1
        yes[held] += label
    return n, yes


def joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all words of some documents one after another, each behind REACH empty words, and where each begins. No
    window of the widest filter reaches the words of two documents."""
    gap = np.full((REACH, PARTS), SLOTS, np.int64)
    starts = np.cumsum([0] + [REACH + len(d) for d in docs[:-1]])
    return np.concatenate([x for d in docs for x in (gap, d.astype(np.int64))] + [gap]), starts


class Scorer:
    """A network ready for texts, which are read by stretches, many short ones together."""

    def __init__(self, net: Network):
        self.net = net
        self.filters = np.concatenate([f[j] for f in net.filters for j in range(len(f))], axis=1)
        self.gap = np.full((REACH, PARTS), SLOTS, np.int64)

    def windows(self, rows: np.ndarray) -> list[np.ndarray]:
        """Each filter's value for each window that begins REACH or more words before the end."""
        g, n, column, out = embedded(self.net.table, rows) @ self.filters, len(rows) - REACH, 0, []
        for k in WIDTHS:
            z = g[:n, column : column + FILTERS].copy()
            for j in range(1, k):
                z += g[j : j + n, column + j * FILTERS : column + (j + 1) * FILTERS]
            column += k * FILTERS
            out.append(z)
        return out

    def pooled(self, texts: Iterable[str | None]) -> np.ndarray:
        """Each filter's largest value over each text. A text that goes on has its last words again before the next ones."""
        done, self.at, most = [], self.gap, None
        for found, counts, goes_on in stretches(texts):
            ends = np.cumsum(counts)
            rows = np.full((len(found) + len(self.at) + REACH * len(counts), PARTS), SLOTS, np.int64)
            rows[: len(self.at)] = self.at
            rows[len(self.at) + np.arange(len(found)) + np.repeat(REACH * np.arange(len(counts)), counts)] = found
            starts = np.concatenate(([0], len(self.at) + ends[:-1] + REACH * np.arange(len(counts) - 1)))
            if goes_on:
                rows = rows[: len(rows) - REACH]
            best, n = np.full((len(counts), POOLED), -np.inf, np.float32), len(rows) - REACH
            some = starts < n  # else a text that goes on has no word yet
            if some.any():
                best[some] = np.concatenate([np.maximum.reduceat(z, starts[some], axis=0) for z in self.windows(rows)], axis=1)
            if most is not None:
                best[0] = np.maximum(best[0], most)
            most = best[-1] if goes_on else None
            done.append(best[:-1] if goes_on else best)
            self.at = rows[max(starts[-1], len(rows) - REMEMBERED) :] if goes_on else self.gap
        return np.concatenate(done) if done else np.zeros((0, POOLED), np.float32)

    def logits(self, texts: Iterable[str | None]) -> np.ndarray:
        return self.net.logits(self.pooled(texts))


def _threshold(z: np.ndarray, yes: np.ndarray, no: np.ndarray, wrong: float) -> float:
    """The cut with the fewest missed positives and, weighing `wrong` each, negatives taken for one, from the numbers of
    both at each logit in ascending order; in the middle of the gap that it lies in."""
    cost = np.append(0, np.cumsum(yes)) + wrong * np.append(np.cumsum(no[::-1])[::-1], 0)  # cut before each, and behind all
    least = np.flatnonzero(cost == cost.min())
    at = least[len(least) // 2]
    return float((z[max(0, at - 1)] + z[min(len(z) - 1, at)]) / 2)


class Toxicity:
    """The network with languages' profiles and a threshold for each language, or a constant chance without one."""

    def __init__(self, net: Network | None, profiles: dict, thresholds: dict[str, float], threshold: float, chance: float = 0.0):
        self.net, self.profiles, self.thresholds, self.threshold, self.chance = net, profiles, thresholds, threshold, chance
        self.tools = None

    def ready(self) -> tuple[Scorer | None, language.Profiles]:
        """The scorer and the profiles ready for texts, made once a worker process."""
        if self.tools is None:
            self.tools = Scorer(self.net) if self.net else None, language.Profiles(self.profiles, 400)
        return self.tools

    def scores(self, logits: np.ndarray, langs: list[str]) -> np.ndarray:
        """Chances by logits, moved so that EVEN lies at the threshold of the text's language."""
        cut = np.array([self.thresholds.get(x, self.threshold) for x in langs])
        return 1 / (1 + np.exp(-np.clip(logits - cut + np.log(EVEN / (1 - EVEN)), -30, 30)))


def learn(
    docs: DataFrame, labels: DataFrame, target: str = "toxic", text: str = "text", lang: str = "lang", key: str = "doc_id",
    rows: int = 12_000, checked: float = 0.25, rounds: int = 12, rate: float = 0.2, wrong: float = 1.0, weight: float = 4.0,
) -> Toxicity:
    """A network and a threshold for each language, from all labelled documents that are not held out. The share `checked`
    of them is kept from the network and sets the thresholds: a language's own is drawn to that of all by `weight` positive
    documents. A network trains on about `rows` documents; of several networks, which begin alike from all documents'
    evidence, the changes are averaged MIXES times, those of a row of the table over the networks that changed it. The
    language is the one that a text's n-grams tell; lang only trains these profiles. A key labelled twice has the largest
    label, null labels count as absent; without documents of both classes the chance is the smoothed share.

    Documents are dealt to tasks once, by their key, and written as rows of the table; training and thresholds read them
    where they lie. The driver has the weights, counts a row of the table, and counts a language and 1 / GRID of a logit.
    """
    marked = labels.filter(F.col(key).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.max((F.col(target) > 0).cast("int")).alias("__y"))
    marked = written(marked.filter(~held_out("__k")), "labels")
    profiles = language.learn(docs, text, lang, key)
    marked = small(marked.withColumn("__checked", drawn(checked, F.lit("checked"), "__k")), 100_000)
    found = docs.filter(~held_out(key))  # less to shuffle where the labels are many
    counts = {(r["__checked"], r["__y"]): r["n"] for r in found.select(F.col(key).alias("__k")).join(marked, "__k").groupBy("__checked", "__y").agg(F.count("*").alias("n")).collect()}
    n, positive = sum(counts.values()), sum(c for (_, y), c in counts.items() if y)
    if not 0 < positive < n:
        return Toxicity(None, profiles, {}, 0.0, float((positive + 1) / (n + 2)))
    apart = len(counts) == 4  # else too few to keep some back
    used = found.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(marked, "__k").repartition("__k").select("__t", "__y", "__checked", F.xxhash64("__k").alias("__h"))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = language.Profiles(profiles, 400)
        for batch in batches:
            texts, back = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            langs = [tool.predict(t)[0] if b or not apart else None for t, b in zip(texts, back)]
            yield pa.RecordBatch.from_arrays([pa.array(rows_by_text(texts), pa.binary()), *batch.columns[1:], pa.array(langs, pa.string())], names=["rows", "y", "checked", "h", "lang"])

    table = written(used.mapInArrow(rows_of, "rows binary, y int, checked boolean, h long, lang string"), "picked")
    train = back = table
    if apart:
        train, back = table.filter("NOT checked"), table.filter("checked")
        n, positive = counts[False, 0] + counts[False, 1], counts[False, 1]
    net = _trained(train.select("rows", "y", "h"), n, positive, rows, rounds, rate)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _arrays(batch.column(0))
            logits = np.concatenate([_logits(net, found[i : i + 64]) for i in range(0, len(found), 64)]) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(logits * GRID).astype(np.int64)), batch.column(1), batch.column(2)], names=["at", "y", "lang"])

    seen = back.select("rows", "y", "lang").mapInArrow(bins, "at long, y int, lang string").groupBy("lang", "at").agg(F.count_if(F.col("y") == 1).alias("yes"), F.count_if(F.col("y") == 0).alias("no")).toPandas()

    def cut(some) -> float:
        some = some.groupby("at", sort=True)[["yes", "no"]].sum()
        return _threshold((some.index.to_numpy() + 0.5) / GRID, some["yes"].to_numpy(), some["no"].to_numpy(), wrong)

    threshold, thresholds = cut(seen), {}
    for name, some in seen.groupby("lang"):
        yes = int(some["yes"].sum())
        if yes and some["no"].sum():
            thresholds[name] = (yes * cut(some) + weight * threshold) / (yes + weight)
    return Toxicity(net, profiles, thresholds, threshold)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).reshape(-1, PARTS) for x in column.to_pylist()]


def _trained(table: DataFrame, n: int, positive: int, rows: int, rounds: int, rate: float) -> Network:
    """A network from all rows of the table, in as many tasks as hold about `rows` each, which read them where they lie."""
    net, tasks = Network(), -(-n // rows)

    def evidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, yes = np.zeros(SLOTS), np.zeros(SLOTS)
        for batch in batches:
            more = evidence(_arrays(batch.column(0)), batch.column(1).to_numpy())
            n, yes = n + more[0], yes + more[1]
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(yes[at])], names=["slot", "n", "yes"])

    # a row for each row of the embedding table at most
    table = table.coalesce(tasks)
    found = table.mapInArrow(evidences, "slot long, n double, yes double").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("yes").alias("yes")).toPandas()
    held, yes = np.zeros(SLOTS), np.zeros(SLOTS)
    held[found["slot"]], yes[found["slot"]] = found["n"], found["yes"]
    net.begin(held, yes, n, positive)
    mixes = 1 if tasks == 1 else min(MIXES, rounds)
    columns = [f"v{i}" for i in range(SIZE + 1)]
    for mix in range(mixes):
        some = rounds // mixes + (mix < rounds % mixes)

        def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = net.state()
            for group in _groups(batches, rows):
                net.put(before)
                order = np.argsort(group.column("h").to_numpy(), kind="stable")
                docs, y = _arrays(group.column("rows")), group.column("y").to_numpy().astype(np.float32)
                net.train([docs[i] for i in order], y[order], some, rate, 7 + mix)
                change = (net.state() - before) * np.float32(len(y))
                at = np.flatnonzero(change.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), len(y), np.int32)), *map(pa.array, change[at].T.copy())], names=["slot", "docs", *columns])

        changes = table.mapInArrow(trained, "slot int, docs int, " + ", ".join(f"{c} float" for c in columns)).groupBy("slot").agg(*[(F.sum(c) / F.sum("docs")).alias(c) for c in columns]).toPandas()
        state = net.state()
        state[changes["slot"]] += changes[columns].to_numpy(np.float32)
        net.put(state)
    return net


def _groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows in groups of `rows` to twice as many, less only if there are no more or the documents are long."""
    held, docs, size = [], 0, 0
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            some = batch.slice(i, rows)
            if held and (docs + some.num_rows > 2 * rows or size + some.nbytes > HELD):
                yield pa.Table.from_batches(held)
                held, docs, size = [], 0, 0
            held.append(some)
            docs += some.num_rows
            size += some.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _logits(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    rows, starts = joined(docs)
    x, n = embedded(net.table, rows), len(rows) - REACH
    return net.logits(np.concatenate([np.maximum.reduceat(sum(x[j : j + n] @ f[j] for j in range(len(f))), starts, axis=0) for f in net.filters], axis=1))


def score(docs: DataFrame, model: Toxicity, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, held_out, score (0 to 1), predicted (1 from EVEN).

    Whole texts are read, long ones by stretches. A null text counts as empty, and a text without words has the score of
    empty words; repeated rows are scored each for itself; a null key is not held out; an empty table gives an empty
    result; other columns are not read. The model (some megabytes, whatever the documents) goes to each executor once.
    """
    picked = docs.select(F.col(key).alias(key), held_out(key).alias("held_out"), F.col(text).alias("__text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        net, tool = model.ready()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            if net:
                found = model.scores(net.logits(texts), [tool.predict(t)[0] for t in texts])
            else:
                found = np.full(len(texts), model.chance)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= EVEN).astype(np.int32), pa.int32())], names=[key, "held_out", "score", "predicted"])

    return picked.mapInArrow(run, f"{key} {dict(picked.dtypes)[key]}, held_out boolean, score double, predicted int")
