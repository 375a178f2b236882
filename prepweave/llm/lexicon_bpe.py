"""BPE encoding and decoding over a lexicon of frequent words: a minimal acyclic transducer that workers map into memory."""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import tempfile
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from prepweave.llm.common import written

#: Fixed values of the vocabulary's format: white space of its normaliser, its splitting pattern, its end of word.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACES}\p{{L}}\p{{N}}]+"
END = "</w>"
#: Code points that became letters or numbers after Unicode 16, which the library's pattern takes for neither
#: and the pattern package, whose tables are newer, for one.
LATER = """0x558-0x558 0x58b-0x58c 0x88f-0x88f 0xc5c-0xc5c 0xcdc-0xcdc 0x208f-0x208f 0x209d-0x209f 0xa7ce-0xa7cf 0xa7d2-0xa7d2
0xa7d4-0xa7d4 0xa7dd-0xa7dd 0xa7e2-0xa7e2 0xa7f1-0xa7f1 0xab6c-0xab6d 0x107bb-0x107bf 0x10940-0x10959 0x10ec5-0x10ec7
0x10ed9-0x10eee 0x11b0a-0x11b0a 0x11db0-0x11ddb 0x11de0-0x11de9 0x11df1-0x11df1 0x1246f-0x1246f 0x12475-0x1247f
0x12550-0x12686 0x16ea0-0x16eb8 0x16ebb-0x16ed3 0x16ff2-0x16ff6 0x187f8-0x187ff 0x18cd6-0x18cda 0x18d09-0x18d20
0x18d80-0x18df2 0x18e00-0x19191 0x191a0-0x191d2 0x1b123-0x1b128 0x1b168-0x1b168 0x1d6a6-0x1d6a6 0x1df1f-0x1df24
0x1df2b-0x1df81 0x1df90-0x1df96 0x1dfcd-0x1dfff 0x1e6c0-0x1e6de 0x1e6e0-0x1e6e2 0x1e6e4-0x1e6e5 0x1e6e7-0x1e6ed
0x1e6f0-0x1e6f4 0x1e6fe-0x1e6ff 0x2b73a-0x2b73f 0x2b81e-0x2b81e 0x2cea2-0x2cead 0x323b0-0x33479 0x3d000-0x3fc3f"""
LATER = "".join(f"{chr(int(a, 16))}-{chr(int(b, 16))}" for a, b in (x.split("-") for x in LATER.split()))
#: Capital letters of Unicode 16 and 17 and what they are in lower case, which this Python does not know.
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: SPLIT for texts that hold such code points.
SPLIT_LATER = rf"'s|'t|'re|'ve|'m|'ll|'d|(?:(?![{LATER}])\p{{L}})+|(?![{LATER}])\p{{N}}|(?:[^{SPACES}\p{{L}}\p{{N}}]|[{LATER}])+"
#: The settings of a file that this coder understands.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
FILE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Entries of a worker's memos of recent pieces and words, twice at most.
MEMO = 300_000
#: Words up to so many symbols are merged by plain search, longer ones with a heap.
SHORT = 24
#: The rank of a pair that is not joined.
NONE = 1 << 60


def byte_characters() -> dict[int, str]:
    """The printable character for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def refused(file: dict, path: str) -> None:
    """Raises an error for a file whose normaliser, pattern or model is another than the one that is coded here."""
    steps = (file.get("normalizer") or {}).get("normalizers")
    splits = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    model = file["model"]
    if steps != NORMALISERS or splits[0].get("pattern") != {"Regex": FILE_SPLIT} or not splits[0].get("invert") or [s.get("type") for s in splits] != ["Split", "ByteLevel"]:
        raise ValueError(f"{path}: another normaliser or splitting pattern")
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != END or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        raise ValueError(f"{path}: another model than BPE with word ends")


class Vocabulary:
    """A BPE vocabulary file with word ends; splits, merges and spells as the file says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        refused(file, path)
        self.ids: dict[str, int] = file["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.written = {t: str(i) for t, i in self.ids.items()}
        self.chars = byte_characters()
        self.table = str.maketrans({i: c for i, c in self.chars.items()})
        self.pattern, self.pattern_later = regex.compile(SPLIT), regex.compile(SPLIT_LATER)
        self.later = regex.compile(f"[{LATER}{''.join(map(chr, CAPITALS))}]")
        self.blank = regex.compile(f"[{SPACES}]+")
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def words(self, piece: str) -> list[str]:
        """Normalises a piece of text without special tokens and splits it into words."""
        if piece.isascii():
            low = piece.lower()
            return [low] if low.isalpha() else self.pattern.findall(low)
        try:
            piece.encode("latin-1")
        except UnicodeEncodeError:
            text = self.blank.sub(" ", unicodedata.normalize("NFC", piece))
            # lower case is taken character by character, without the final form of sigma
            text = text.replace("Σ", "σ").lower()
            return self.pattern_later.findall(text.translate(CAPITALS)) if self.later.search(text) else self.pattern.findall(text)
        low = piece.lower()  # Latin-1 is in normal form, and its white space is taken as such by the pattern
        return [low] if low.isalpha() else self.pattern.findall(low)

    def merge(self, word: str) -> list[int]:
        return [self.ids[s] for s in self.symbols(word)]

    def symbols(self, word: str) -> list[str]:
        """The tokens of one word: of all adjacent pairs the one of least rank is joined, leftmost first, until none has one."""
        symbols = list(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table))
        symbols[-1] += END
        ranks = self.ranks
        if len(symbols) > SHORT:
            return self._merge_long(symbols)
        # ranks of adjacent pairs, kept up to date beside the symbols
        near = [ranks.get(pair, NONE) for pair in zip(symbols, symbols[1:])]
        while near and (best := min(near)) < NONE:
            at = near.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del near[at]
            if at:
                near[at - 1] = ranks.get((symbols[at - 1], symbols[at]), NONE)
            if at < len(near):
                near[at] = ranks.get((symbols[at], symbols[at + 1]), NONE)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        n, ranks = len(symbols), self.ranks
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], live[j], after[i] = a + b, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return [s for s, k in zip(symbols, live) if k]


def filter_bits(words: int) -> int:
    """Bits of the bitmap of so many words: a power of two, at least 16 a word."""
    return max(1 << 8, 1 << (16 * words).bit_length())


def build(entries: list[tuple[bytes, list[int]]], path: str) -> None:
    """Writes the minimal acyclic transducer of words and their ids.

    Words are added in byte order; a finished branch is shared with an equal one that is already there, so common
    suffixes stand once. A bitmap of the words' hashes tells most others at once. Each transition carries how many words come before those behind it, so the sum along a path is
    the word's number, which gives its ids in a table.
    """
    entries = sorted(dict(entries).items())
    register: dict[tuple, int] = {}
    done: list[tuple[bool, tuple]] = []  # final, transitions as (byte, state)
    open_states: list[list] = [[False, []]]  # the current word's path: final, transitions

    def close(depth: int) -> None:
        while len(open_states) > depth + 1:
            final, moves = open_states.pop()
            state = (final, tuple(moves))
            if state not in register:
                register[state] = len(done)
                done.append(state)
            open_states[-1][1][-1] = (open_states[-1][1][-1][0], register[state])

    last = b""
    for word, _ in entries:
        same = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        close(same)
        for byte in word[same:]:
            open_states[-1][1].append((byte, -1))
            open_states.append([False, []])
        open_states[-1][0] = True
        last = word
    close(0)
    done.append((open_states[0][0], tuple(open_states[0][1])))
    sizes = []
    for final, moves in done:  # a state's targets come before it
        sizes.append(int(final) + sum(sizes[t] for _, t in moves))
    starts, labels, targets, skips = array("I", [0]), bytearray(), array("I"), array("I")
    for final, moves in done:
        skip = int(final)
        for byte, target in moves:
            labels.append(byte)
            targets.append(target)
            skips.append(skip)
            skip += sizes[target]
        starts.append(len(labels))
    finals = bytes(int(f) for f, _ in done)
    outputs, at = array("I", [0]), array("I")
    for _, ids in entries:
        at.extend(ids)
        outputs.append(len(at))
    bits = bytearray(filter_bits(len(entries)) // 8)
    for word, _ in entries:
        h = crc32(word) & (8 * len(bits) - 1)
        bits[h >> 3] |= 1 << (h & 7)
    pad = lambda b: b + b"\0" * (-len(b) % 8)
    parts = [pad(x) for x in (starts.tobytes(), targets.tobytes(), skips.tobytes(), outputs.tobytes(), at.tobytes(), bytes(bits), finals, bytes(labels))]
    with open(path, "wb") as f:
        f.write(array("Q", [len(done), len(labels), len(entries), len(at)]).tobytes())
        for p in parts:
            f.write(p)


class Lexicon:
    """A lexicon file mapped into memory: pages are shared by all workers of a machine."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self.map)
        states, moves, words, ids = view[:32].cast("Q")
        at = 32

        def part(kind: str, n: int, width: int):
            nonlocal at
            found = view[at : at + n * width].cast(kind)
            at += n * width + (-(n * width) % 8)
            return found

        self.starts, self.targets, self.skips = part("I", states + 1, 4), part("I", moves, 4), part("I", moves, 4)
        self.outputs, self.ids = part("I", words + 1, 4), part("I", ids, 4)
        self.bits, self.mask = part("B", filter_bits(words) // 8, 1), filter_bits(words) - 1
        self.finals = part("B", states, 1)
        self.labels, self.root = at, states - 1

    def find(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None if the lexicon lacks it."""
        h = crc32(word) & self.mask
        if not self.bits[h >> 3] >> (h & 7) & 1:
            return None
        state, number, starts, base, find = self.root, 0, self.starts, self.labels, self.map.find
        for i in range(len(word)):
            move = find(word[i : i + 1], base + starts[state], base + starts[state + 1]) - base
            if move < 0:
                return None
            number += self.skips[move]
            state = self.targets[move]
        return self.ids[self.outputs[number] : self.outputs[number + 1]].tolist() if self.finals[state] else None


class Memo(dict):
    """Remembers what `make` gives. When `size` entries are full they become the old ones, from which those that are asked
    for again come back; so frequent keys stay and twice `size` bounds the entries."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Coder:
    """Encodes and decodes texts: recent pieces and words by memo, frequent words by lexicon, others by merging."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.pieces, self.words = Memo(self._piece, MEMO), Memo(self._word, MEMO)

    def _word(self, word: str) -> tuple[str, str]:
        """The ids and the tokens of a word, each joined by spaces."""
        ids = self.lexicon.find(word.encode("utf-8", "surrogatepass")) if self.lexicon else None
        if ids is None:
            symbols, written = self.vocabulary.symbols(word), self.vocabulary.written
            return " ".join([written[s] for s in symbols]), " ".join(symbols)
        return " ".join(map(str, ids)), self.decode(ids)

    def _piece(self, piece: bytes) -> tuple[str, str]:
        words = self.vocabulary.words(piece.decode("utf-8", "surrogatepass"))
        if len(words) == 1:
            return self.words[words[0]]
        found = [self.words[w] for w in words]
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found])

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces."""
        return " ".join([self.vocabulary.tokens[i] for i in ids])

    def _part(self, part: str) -> tuple[str, str]:
        """Ids and tokens of a text without special tokens."""
        found = list(map(self.pieces.__getitem__, part.encode("utf-8", "surrogatepass").split()))
        ids, tokens = " ".join([x[0] for x in found]), " ".join([x[1] for x in found])
        # no token holds a space, so two in a row, or one at an end, stand for a piece without tokens
        if "  " in ids or ids[:1] == " " or ids[-1:] == " ":
            ids, tokens = " ".join(ids.split()), " ".join(x for x in tokens.split(" ") if x)
        return ids, tokens

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids and the tokens, both joined by spaces.

        Special tokens' strings in the text are those tokens. No word of the vocabulary spans white space, so the text
        is coded in pieces that ASCII white space bounds.
        """
        v = self.vocabulary
        if v.parts and "<|" in text:
            found = [(str(v.special[part]), part) if i % 2 else self._part(part) for i, part in enumerate(v.parts.split(text))]
            ids, tokens = (" ".join(x for x in side if x) for side in zip(*found))
        else:
            ids, tokens = self._part(text)
        return ids.count(" ") + 1 if ids else 0, ids, tokens


@lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    """A vocabulary file, read once in each worker process."""
    return Vocabulary(path)


def count_words(docs: DataFrame, vocabulary_path: str, text: str = "text", flush: int = 400_000) -> DataFrame:
    """How often each word stands in all texts: columns word (binary), n. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        pieces: Counter = Counter()

        def out():
            words: Counter = Counter()
            for p, n in pieces.items():
                for w in v.words(p.decode("utf-8", "surrogatepass")):
                    words[w] += n
            pieces.clear()
            items = [(w.encode("utf-8", "surrogatepass"), n) for w, n in words.items() if len(w) <= 64]
            for i in range(0, len(items), 50_000):
                w, n = zip(*items[i : i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                pieces.update((t.as_py() or "").encode("utf-8", "surrogatepass").split())
                if len(pieces) > flush:
                    yield from out()
        yield from out()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(spark: SparkSession, counts: DataFrame, vocabulary_path: str, size: int = 100_000) -> str:
    """Builds the lexicon of the most frequent words, `size` at most (a parameter, whatever the corpus; words of one count enter
    together or not at all), and gives its file to all
    executors; returns the name under which SparkFiles finds it."""
    v = vocabulary(vocabulary_path)
    counts = written(counts.filter("n > 1"), "word-counts")
    # the least count of which all words fit: found over the different counts, which are few, so that tasks send no words
    # that do not enter the lexicon
    upto = F.sum("words").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0))
    least = counts.groupBy("n").agg(F.count("*").alias("words")).withColumn("upto", upto).filter(F.col("upto") <= size).agg(F.min("n")).first()[0]
    frequent = counts.filter(F.col("n") >= least).select("word").collect() if least is not None else []
    folder = tempfile.mkdtemp()  # the driver serves the file from here
    name = f"lexicon-{os.path.basename(folder)}"
    build([(bytes(r["word"]), v.merge(bytes(r["word"]).decode("utf-8", "surrogatepass"))) for r in frequent], os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def code(docs: DataFrame, vocabulary_path: str, lexicon: str | None, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document: key, n_tokens, ids_sha256, decoded_sha256, and with with_ids the ids and the decoded text.

    Encodes whole texts and decodes the ids again. A null text counts as empty and has no tokens. The vocabulary file
    must lie at the same place on all machines. Repeated rows are coded each for itself; an empty table gives an empty
    result; other columns are not read.
    """
    kinds = f"{key} {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary(vocabulary_path), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            found = []
            for t in batch.column(1):
                n, ids, decoded = coder.encode(t.as_py() or "")
                found.append((n, sha(ids), sha(decoded), *(([int(i) for i in ids.split()], decoded) if with_ids else ())))
            columns = zip(*found) if found else [[]] * (5 if with_ids else 3)
            kinds_ = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            arrays = [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds_)]]
            yield pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

    return docs.select(F.col(key).alias(key), F.col(text).alias("text")).mapInArrow(run, kinds)
