"""Quality rules: base counts of a text and an n-gram perplexity with bands per language.

Words are ``[^\\x20\\x09-\\x0D]+``.  The model is an interpolated modified
Kneser-Ney bigram model per language (``kneser``), counted by Spark over all
documents and held as sorted arrays of 64-bit hashes; it grows with the corpus.
Languages below ``min_lang_share`` of all text share one model.  Words without a
letter or digit (bullets, table bars) are counted by the base rules but not by the
model.

The log-perplexity of clean texts scatters around its language's centre in
inverse proportion to the square root of their length; a document is rejected
when it lies more than ``slack + width / sqrt(words)`` above or below, ``width``
being ``fences`` quartile distances of that scatter in its language (the smaller of
both sides: copies widen the lower, junk the upper one).  Texts have two
scores, by bigrams and by single words (the model's lower order).  Many near copies
of one text make its bigrams cheap but hardly its words, which are counted by the
words before them.  So a text is below the band if both scores are, and copies stay;
it is above the band if either score is, and copied junk goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conflictlake.llm import kneser
from conflictlake.llm import words as W
from conflictlake.llm.common import byte_column, chunks, large_rows, map_arrow_lean as map_arrow, refuse_clash, settled, settled_with, shuffles_dropped, temp_name, text_batches
from conflictlake.operators.stored import Rounds, Stored

BLOCK_BYTES = 4 << 20
SCORE_BYTES = 1 << 19  # of text measured at once; the work arrays are many times that
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(SYMBOLS)] = 1
_LETTER = np.zeros(256, np.uint8)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    min_lang_share: float = 1e-4  # of all text, for a model of its own
    slack: float = 0.3
    fences: float = 3.0


def _codes(langs: pa.Array, known: dict) -> np.ndarray:
    return np.array([known.get(x, 0) for x in langs.to_pylist()], np.int64)


def _counted_up(marks: np.ndarray) -> np.ndarray:
    """Running sum with a leading 0, in 32 bits (a chunk is a few MB, an Arrow column below 2 GB)."""
    out = np.zeros(len(marks) + 1, np.int32)
    np.cumsum(marks, out=out[1:], dtype=np.int32)
    return out


def _sums(mask_cumsum: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mask_cumsum[end] - mask_cumsum[start]


def base_counts(raw: np.ndarray, off: np.ndarray, window: int):
    """Base measures of each text, and its words (row, hash, whether the model takes it)."""
    n = len(off) - 1
    row, start, end, h = W.hash_words(raw, off)
    n_words = np.bincount(row, minlength=n)
    chars = np.bincount(row, _sums(_counted_up((raw & 0xC0) != 0x80), start, end), n).astype(np.int64)
    symbols = _sums(_counted_up(_SYMBOL[raw]), off[:-1], off[1:]).astype(np.int64)
    spoken = _sums(_counted_up(_LETTER[raw]), start, end) > 0
    dup = np.zeros(n, np.int64)
    data = raw.tobytes()
    for i in range(n):
        lines = [x for x in data[off[i]:off[i + 1]].split(b"\n") if x.strip()]
        dup[i] = len(lines) - len(set(lines))
    repeat = np.zeros(n, np.int64)
    runs = W.runs(h, window)
    if len(runs):
        inside = np.flatnonzero(row[:len(runs)] == row[window - 1:])
        key = W.mix(runs[inside] + row[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order, key = W.ordered(key)
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, inside[twice], 1)
        np.add.at(edge, inside[twice] + window, -1)
        repeat = np.bincount(row, np.cumsum(edge)[:-1] > 0, n).astype(np.int64)
    return n_words, chars, symbols, dup, repeat, row[spoken], h[spoken]


def _texts(docs: DataFrame, keep: list[str]) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("__text"), F.col("lang").cast("string").alias("__lang"), *[F.col(c) for c in keep])


def _by_code(values: dict[int, tuple], i: int):
    return F.create_map(*[x for c, v in sorted(values.items()) for x in (F.lit(c).cast("long"), F.lit(float(v[i])))])[F.col("code")]


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ARRAYS = [*MEASURES, "base_failed", "codes", "lengths"]


def languages(docs: DataFrame, rules: Rules = Rules()) -> dict[str, int]:
    """Codes of the languages with a model of their own (at most ``1 / min_lang_share``); 0 is all others."""
    sizes, told = settled_with(_texts(docs, []).groupBy("__lang").agg(F.sum(F.octet_length("__text")).alias("size")), "languages", whole=F.sum("size"))
    kept = sizes.where((F.col("size") > 0) & (F.col("size") >= rules.min_lang_share * (told["whole"] or 0)) & F.col("__lang").isNotNull()).collect()
    return {lang: i + 1 for i, lang in enumerate(sorted(r["__lang"] for r in kept))}


def blocks(docs: DataFrame, langs: dict[str, int], rules: Rules, keep: list[str]) -> DataFrame:
    """Base measures and model words of about BLOCK_BYTES of text a row (a longer text is a row of its own)."""
    source = _texts(docs, keep)
    kinds = [f.dataType for f in source.schema.fields[2:]]
    schema = T.StructType([T.StructField("block", T.LongType()), *[T.StructField(f"keep{i}", T.ArrayType(k)) for i, k in enumerate(kinds)],
                           *[T.StructField(c, T.ArrayType(T.BooleanType() if c == "base_failed" else T.LongType())) for c in ARRAYS],
                           T.StructField("words", T.BinaryType()), T.StructField("tokens", T.BinaryType()), T.StructField("types", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for b in batches:
            raw, off, _ = byte_column(b.column(0))
            codes = _codes(b.column(1), langs)
            for lo, hi in chunks(off, BLOCK_BYTES):
                parts, rows, hashes = [], [], []
                for a, z in chunks(off[lo:hi + 1] - off[lo], SCORE_BYTES):
                    o = off[lo + a:lo + z + 1]
                    *measures, row, h = base_counts(raw[o[0]:o[-1]], o - o[0], rules.window)
                    parts.append(measures)
                    rows.append(row + a)
                    hashes.append(h)
                n_words, chars, symbols, dup, repeat = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
                failed = (n_words < rules.min_words) | (100 * repeat > rules.max_repeat_percent * n_words)
                lengths, words, tokens, types = kneser.coded(np.concatenate(rows), np.concatenate(hashes), codes[lo:hi])
                one = np.array([0, hi - lo], np.int32)
                made = [pa.array(x) for x in (n_words, chars, symbols, dup, repeat, failed, codes[lo:hi], lengths.astype(np.int64))]
                lists = [pa.ListArray.from_arrays(one, x) for x in [*(c[lo:hi] for c in b.columns[2:]), *made]]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([words]), pa.array([tokens]), pa.array([types])], names=schema.names)
                number += 1

    return map_arrow(source, cut, schema)


def measured(docs: DataFrame, rules: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, base measures and log-perplexities (bigrams, single words) of every document, stored."""
    keep = keep or []
    langs = languages(docs, rules)
    size = Observation()
    with text_batches(docs.sparkSession):
        cut = Stored(blocks(docs, langs, rules, keep).observe(size, F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("pairs"), F.sum("types").alias("words")), "quality-blocks")
    rounds, scorer, tables = kneser.model(cut.df, size.get["pairs"] or 0, size.get["words"] or 0, len(langs) + 1)
    fields = [T.StructField(c, cut.df.schema[f"keep{i}"].dataType.elementType) for i, c in enumerate(keep)]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in MEASURES], T.StructField("base_failed", T.BooleanType()),
                           T.StructField("lang_code", T.LongType()), T.StructField("model_words", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in SCORES]])
    taken = [*[f"keep{i}" for i in range(len(keep))], *ARRAYS]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                *lists, words, tokens, answered = (c[i] for c in b.columns)
                codes, lengths = (np.array(x.as_py(), np.int64) for x in lists[-2:])
                bits = scorer(codes, lengths, words.as_py(), tokens.as_py(), answered.as_py())
                said = lengths - 1  # without the start mark
                yield pa.RecordBatch.from_arrays([*(x.values for x in lists[:-1]), pa.array(said), *(pa.array(x / np.maximum(said, 1)) for x in bits)], names=schema.names)

    out = Rounds(docs.sparkSession, "scores")
    with shuffles_dropped(docs.sparkSession), large_rows(docs.sparkSession):
        for told in rounds:
            out.add(map_arrow(told.select(*taken, "words", "tokens", "answered"), score, schema))
    for t in (cut, *tables):
        t.delete()
    return out.read()


SCORES = ("log2_perplexity", "log2_unigram")


def bands(scores: DataFrame, rules: Rules = Rules()) -> dict[str, dict[int, tuple[float, float]]]:
    """By score and language code: centre of the score, width of the band (at one word)."""
    ok = scores.where(~F.col("base_failed") & (F.col("model_words") > 0))
    centres = {r[0]: r for r in ok.groupBy("lang_code").agg(*[F.percentile_approx(c, 0.5, 10000).alias(c) for c in SCORES]).collect()}
    if not centres:
        return {}
    away = [((F.col(c) - _by_code({k: (r[c],) for k, r in centres.items()}, 0)) * F.sqrt("model_words")).alias(c) for c in SCORES]
    rows = ok.withColumn("code", F.col("lang_code")).select("code", *away).groupBy("code").agg(*[F.percentile_approx(c, [0.25, 0.75], 10000).alias(c) for c in SCORES]).collect()
    return {c: {r["code"]: (centres[r["code"]][c], rules.fences * min(abs(r[c][0]), abs(r[c][1]))) for r in rows} for c in SCORES}


def outside(found: dict[str, dict[int, tuple[float, float]]], rules: Rules) -> tuple[Column, Column]:
    """Whether a row of ``measured`` lies below its language's band, and above it."""
    low, high = F.lit(True), F.lit(False)
    if not found:
        return F.lit(False), high
    root, judged = F.sqrt(F.greatest(F.col("model_words"), F.lit(1))), F.col("model_words") > 0
    for c in SCORES:
        centre, width = (F.create_map(*[x for k, v in sorted(found[c].items()) for x in (F.lit(k).cast("long"), F.lit(float(v[i])))])[F.col("lang_code")]
                         for i in range(2))
        away = F.col(c) - centre
        low = low & F.coalesce(away < -rules.slack - width / root, F.lit(False))
        high = high | F.coalesce(away > rules.slack + width / root, F.lit(False))
    return judged & low, judged & high


def judge(docs: DataFrame, rules: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """Measures and verdict of every document: ``keep`` columns, base measures, perplexity, base_failed, kept.

    A null or empty text has no words and fails the base rules.  A null or rare
    language shares the model and band of the others.  Texts of which the model
    takes no word are judged by the base rules alone.  Repeated rows are judged
    alike; an empty table gives an empty table.  A ``keep`` column of a name that
    is made here is refused (ValueError).
    """
    refuse_clash(keep or [], *MEASURES, "base_failed", "lang_code", "model_words", *SCORES, "perplexity", "unigram_perplexity", "kept", "code", "__text", "__lang")
    scores = measured(docs, rules, keep)
    low, high = outside(bands(scores, rules), rules)
    return scores.select("*", (~F.col("base_failed") & ~low & ~high).alias("kept"), F.pow(F.lit(2.0), "log2_perplexity").alias("perplexity"),
                         F.pow(F.lit(2.0), "log2_unigram").alias("unigram_perplexity")).drop(*SCORES)


def filter_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` without the rejected rows, same columns.

    A verdict is a function of text, language and corpus, so rows meet their
    verdict by a 128-bit hash of both; the rejected hashes are the small side.
    """
    text, lang = (next(c for c in docs.columns if c.lower() == w) for w in ("text", "lang"))

    def name(hash_seed: int) -> Column:
        t, g = F.col(f"`{text}`").cast("string"), F.col(f"`{lang}`").cast("string")
        return F.xxhash64(F.lit(hash_seed), F.coalesce(t, F.lit("")), g.isNull(), F.coalesce(g, F.lit("")))

    one, two = temp_name(docs, "__key1"), temp_name(docs, "__key2")
    marked = docs.withColumn(one, name(1)).withColumn(two, name(2))
    scores = measured(marked, rules, [one, two])
    low, high = outside(bands(scores, rules), rules)
    out = settled(scores.where(F.col("base_failed") | low | high).select(one, two).distinct(), "rejected")
    return marked.join(out, [one, two], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
