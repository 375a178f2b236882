"""Quality rules by tokeniser fertility: how well public vocabularies spell a text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepweave.llm.common import small, written

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SUB_BATCH = 2_000_000
#: Words that a worker remembers; the memo starts anew when full.
MEMO = 400_000
#: Characters that the usual normal forms change: decomposed, a ligature, in a circle, of full width.
CHANGEABLE = "e\u0301\ufb01\u2460\uff21"


@dataclass(frozen=True)
class Band:
    """Accepted ranges. least_entropy is in bits, and no more than half the bits of a text's number of tokens."""

    least_chars: float
    most_chars: float
    most_fallback: float
    least_entropy: float


#: Parameters: characters per token of the byte-level vocabulary, share of bytes that the piece vocabulary spells by
#: byte fallback, entropy of the tokens; by the script of most letters. Languages may have their own bands. Strings of
#: hex, base64 or random letters lie below latin's 1.8, digits and signs alone above other's 1.5. These limits hold for
#: any table; fences() adds those of the table's own documents.
BANDS = {
    "latin": Band(1.8, 7.0, 0.10, 4.0),
    **dict.fromkeys(("cs", "sk", "hu", "pl"), Band(1.5, 7.0, 0.10, 4.0)),
    "vi": Band(0.8, 7.0, 0.30, 4.0),
    "cyrillic": Band(0.4, 4.0, 0.10, 4.0),
    "greek": Band(0.4, 3.0, 0.20, 4.0),
    "arabic": Band(0.4, 3.0, 0.30, 4.0),
    "hebrew": Band(0.4, 3.0, 0.30, 4.0),
    "devanagari": Band(0.3, 3.0, 0.50, 3.5),
    "thai": Band(0.3, 3.0, 0.60, 3.5),
    "hangul": Band(0.3, 3.0, 0.70, 3.5),
    "kana": Band(0.4, 3.0, 0.50, 3.5),
    "han": Band(0.3, 3.0, 0.60, 3.5),
    "other": Band(0.2, 1.5, 0.97, 3.0),
}
#: Code point ranges of the scripts' blocks.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7A3)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2A6DF)),
}
NAMES = ("other", *SCRIPTS)


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """For each text how many of its words stand in windows of WINDOW words that it holds twice or more.

    Equal windows are found exactly: windows of 1, 2, 4 and 8 words get equal numbers if and only if they are equal.
    """
    ids: dict[bytes, int] = {}
    lengths = np.array([len(w) for w in words], np.int64)
    n = int(lengths.sum())
    if n < WINDOW:
        return np.zeros(len(words), np.int64)
    level = np.fromiter((ids.setdefault(w, len(ids)) for ws in words for w in ws), np.int64, n)
    owner = np.repeat(np.arange(len(words)), lengths)
    step = 1
    while step < WINDOW:
        level = level[:-step] * (level.max() + 1) + level[step:]
        level = np.unique(level, return_inverse=True)[1]
        step *= 2
    inside = np.flatnonzero(owner[: len(level)] == owner[WINDOW - 1 :])
    keys = level[inside] * len(words) + owner[inside]
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    starts = inside[counts[which] > 1]
    edge = np.bincount(starts, minlength=n + WINDOW + 1) - np.bincount(starts + WINDOW, minlength=n + WINDOW + 1)
    return np.bincount(owner[np.cumsum(edge)[:n] > 0], minlength=len(words))


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


@lru_cache(1)
def _script_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for i, name in enumerate(SCRIPTS, 1):
        for a, b in SCRIPTS[name]:
            table[a : b + 1] = i
    return table


class Vocabularies:
    """Public vocabulary files, opened once in each worker: ranks of a byte-level BPE and a BPE with byte fallback."""

    def __init__(self, ranks_path: str, pieces_path: str, pattern: str):
        import base64

        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        pieces = range(self.model.get_piece_size())
        self.byte_tokens = frozenset(i for i in pieces if self.model.is_byte(i))
        #: Code points that are pieces of their own. The encoder joins characters to pieces and spells in bytes what is none
        #: in the end, so words of such characters need no byte tokens, if the model's normaliser leaves them as they are.
        self.own = np.zeros(0x110000, bool)
        if self.model.normalize(CHANGEABLE).lstrip("\u2581") == CHANGEABLE:
            single = [self.model.id_to_piece(i) for i in pieces if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
            self.own[[ord(c) for c in (*single, *WHITE) if len(c) == 1]] = True
        self.memo: dict[bytes, int] = {}

    def fallback_bytes(self, points: np.ndarray, words: list[bytes]) -> int:
        """How many bytes of the words of a text of these code points the piece model spells as byte tokens. Its pieces do not
        span white space, so words are encoded one by one, recent ones taken from a memo; texts whose characters all are
        pieces have none."""
        if self.own[points].all():
            return 0
        new = [w for w in set(words) if w not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = {}, list(set(words))
        for w, ids in zip(new, self.model.encode([w.decode("utf-8", "replace") for w in new])):
            self.memo[w] = sum(i in self.byte_tokens for i in ids)
        return sum(map(self.memo.__getitem__, words))

    def measure(self, text: str, words: list[bytes]) -> tuple[int, float, float, float, str]:
        """Tokens, characters per token, byte-fallback share, entropy in bits, script; words are those of the text."""
        tokens = self.encoding.encode_to_numpy(text, disallowed_special=())
        if not len(tokens):
            return 0, 0.0, 0.0, 0.0, "other"
        counts = np.unique(tokens, return_counts=True)[1] / len(tokens)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        scripts = np.bincount(_script_table()[points], minlength=len(NAMES))
        script = NAMES[1 + int(scripts[1:].argmax())] if scripts[1:].any() else "other"
        share = self.fallback_bytes(points, words) / max(1, len(text.encode("utf-8", "surrogatepass")))
        return len(tokens), len(text) / len(tokens), share, float(-(counts * np.log2(counts)).sum()), script


@lru_cache(1)
def opened(*files: str) -> Vocabularies:
    """The vocabularies, opened once in each worker process."""
    return Vocabularies(*files)


def accepted(band: Band, tokens: int, chars: float, fallback: float, entropy: float) -> bool:
    bits = min(band.least_entropy, 0.5 * math.log2(tokens)) if tokens else 0.0
    return bool(tokens and band.least_chars <= chars <= band.most_chars and fallback <= band.most_fallback and entropy >= bits)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_tokens long, chars_per_token double, fallback_share double, token_entropy double, script string"
)


#: Octaves of the number of tokens by which fences are grouped, as entropy grows with a text's length; longer texts
#: share the last one.
OCTAVES = 12
#: A fence is never nearer to its quartile than reach times these: a share of the median, bits.
LEAST_CHARS_SPREAD, LEAST_ENTROPY_SPREAD = 0.02, 0.1
LIMITS = ["rows", "low_chars", "high_chars", "low_entropy"]


def fences(measured: DataFrame, reach: float, weight: int) -> DataFrame:
    """Limits from the documents themselves: name, octave, rows, low_chars, high_chars, low_entropy.

    Grouped by language, by script, and for all documents, each by octave of the number of tokens. A limit lies `reach` times
    the distance of the quartiles beyond the quartile, so it cuts no fixed share, and holds while fewer than a quarter of a
    group is noise; the fence of all documents is wider by weight / rows. Equal measures (copies) count once. Measures are
    rounded to thousandths, so that the exact percentiles combine before the shuffle and hold few values a group.
    """
    names = F.array_compact(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("script:"), "script"), F.lit("all")))
    one = measured.filter("kept").select(F.explode(names).alias("name"), "octave", "n_tokens", F.round("chars_per_token", 3).alias("chars"), F.round("token_entropy", 3).alias("bits")).distinct()
    quarters = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c)
    found = one.groupBy("name", "octave").agg(F.count("*").alias("rows"), quarters("chars"), quarters("bits"))
    wider = F.when(F.col("name") == "all", 1 + weight / F.col("rows")).otherwise(1.0)
    far = lambda c, least: reach * wider * F.greatest(F.col(c)[2] - F.col(c)[0], least)
    chars, bits = far("chars", LEAST_CHARS_SPREAD * F.col("chars")[1]), far("bits", F.lit(LEAST_ENTROPY_SPREAD))
    return found.select("name", "octave", "rows", (F.col("chars")[0] - chars).alias("low_chars"), (F.col("chars")[2] + chars).alias("high_chars"), (F.col("bits")[0] - bits).alias("low_entropy"))


def _shrunk(own: Column, above: Column, weight: int) -> Column:
    """A fence drawn to the one above it, which counts as `weight` documents; that one where there is none."""
    mixed = lambda c: ((own["rows"] * own[c] + weight * above[c]) / (own["rows"] + weight)).alias(c)
    limits = [c for c in LIMITS if c != "rows"]
    return F.when(own.isNull(), F.struct(*[above[c].alias(c) for c in limits])).otherwise(F.struct(*map(mixed, limits)))


def judge(docs: DataFrame, vocabularies: tuple[str, str, str], bands: dict[str, Band] = BANDS, text: str = "text", key: str = "doc_id", lang: str | None = None, reach: float = 2.0, weight: int = 100) -> DataFrame:
    """Per document the base counts, the fertility measures and the verdict; SCHEMA's columns.

    vocabularies: paths of the rank file and of the piece file, and the rank file's splitting pattern; they must lie at
    the same place on all machines. A document is kept if it passes the base limits (20 words, at most 30 in 100 words
    in repeated windows), the band of its language (column `lang`, if bands has it) or else of its script, and the fences()
    of its language and length. A language's fence is drawn to its script's, and a script's to that of all documents, each
    of which weighs `weight` documents; so fences of few documents count little, and none is switched on or off. A null or
    empty text has no words and is not kept; repeated rows are judged each for itself; an empty table gives an empty result; columns other than
    those named are not read. Texts are read once and not shuffled, and a task holds a batch of them at a time; the measures
    are written below spark.checkpoint.dir.
    """
    out = SCHEMA + ", lang string, octave int"
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[c.split()[1]]) for c in out.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = opened(*vocabularies)
        for batch in batches:
            keys, langs, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)
            rows, held, chars = [], [], 0

            def flush():
                repeats = repeated_words([w for *_, w in held])
                for (k, lg, t, words), again in zip(held, repeats):
                    n, again = len(words), int(again)
                    failed = n < 20 or 100 * again > 30 * n
                    tokens, per, share, entropy, script = tools.measure(t, words)
                    band = bands.get(lg) or bands.get(script) or bands["other"]
                    rows.append((k, n, len(t) - sum(t.count(c) for c in WHITE), sum(t.count(c) for c in SYMBOLS), duplicate_lines(t), again, failed, not failed and accepted(band, tokens, per, share, entropy), tokens, per, share, entropy, script, lg, min(OCTAVES, tokens.bit_length())))
                held.clear()

            for k, lg, t in zip(keys, langs, texts):
                t = t.as_py() or ""
                held.append((k, lg, t, t.encode("utf-8", "surrogatepass").split()))
                chars += len(t)
                if chars > SUB_BATCH:
                    flush()
                    chars = 0
            flush()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"))
    measured = written(picked.mapInArrow(run, out), "measured")
    limits = written(fences(measured, reach, weight), "fences")
    df = measured
    for name, mark in ((F.concat(F.lit("lang:"), "lang"), "l"), (F.concat(F.lit("script:"), "script"), "s"), (F.lit("all"), "a")):
        of = small(limits.select(F.col("name").alias(f"__{mark}"), F.col("octave").alias(f"__{mark}o"), F.struct(*LIMITS).alias(f"__{mark}f")), 100_000)
        df = df.join(of, (name == F.col(f"__{mark}")) & (F.col("octave") == F.col(f"__{mark}o")), "left")
    df = df.withColumn("__fence", _shrunk(F.col("__lf"), _shrunk(F.col("__sf"), F.col("__af"), weight), weight))
    # a document that its band keeps is one of all that the fences come from, so that it has a fence
    inside = F.col("chars_per_token").between(F.col("__fence.low_chars"), F.col("__fence.high_chars")) & (F.col("token_entropy") >= F.col("__fence.low_entropy"))
    return df.withColumn("kept", F.col("kept") & F.coalesce(inside, F.lit(True))).select(*[c.split()[0] for c in SCHEMA.split(", ")])
