"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a word ``[^\\x20\\x09-\\x0D]+`` with the word mark in front.  Its
tokens are the segmentation into vocabulary pieces with the highest total score
(ties: fewer tokens); a character that is no piece counts as its UTF-8 bytes.

The forward score of a prefix - the best score of its segmentations - depends on
the prefix alone.  A task therefore walks the trie of the distinct pre-tokens of a
few MB of text: sorted pre-tokens are the trie in depth-first order, the scores of
the current path are a stack, and a pre-token only extends the part it does not
share with the one before.  The count at each terminal is stored; documents add
up the counts of their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflictlake.llm.common import byte_column, chunks, kept_by_worker, map_arrow

MARK = "▁"
STORED = 300_000  # terminal counts kept between chunks; then the store starts anew


@kept_by_worker(2)
def piece_scores(path: str) -> tuple[dict[str, float], float]:
    """(score by piece, score of an unknown byte) of a SentencePiece file.

    A unigram file gives its scores.  A BPE file scores by merge order only (whole
    negative numbers); its pieces get the log of a rank-frequency law.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    raw = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
    if all(s <= 0 and s == int(s) for s in raw.values()):
        raw = {p: -math.log(2.0 + k) for k, p in enumerate(sorted(raw, key=lambda p: -raw[p]))}
    return raw, min(raw.values(), default=0.0) - 10.0


def terminal_counts(pretokens: list[str], scores: dict[str, float], byte_score: float) -> dict[str, int]:
    """Tokens of each of the distinct pre-tokens."""
    longest = max(map(len, scores), default=1)
    best, count, before, out = [0.0], [0], "", {}
    get = scores.get
    for word in sorted(pretokens):
        shared = len(commonprefix((before, word)))
        del best[shared + 1:], count[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            n = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top, few = best[end - 1] + byte_score * n, count[end - 1] + n
            for at in range(max(0, end - longest), end):
                s = get(word[at:end])
                if s is not None:
                    s += best[at]
                    if s > top or (s == top and count[at] + 1 < few):
                        top, few = s, count[at] + 1
            best.append(top)
            count.append(few)
        out[word], before = count[-1], word
    return out


def token_counts(docs: DataFrame, model: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, n_words and n_tokens of every row (one narrow pass).

    A null or empty text has no tokens.  Rows are independent; an empty table
    gives an empty table.
    """
    keep = keep or []
    source = docs.select(F.col(text_col).cast("string").alias("__text"), *keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]), "n_words long, n_tokens long"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, byte_score = piece_scores(model)
        known: dict[bytes, int] = {}
        for b in batches:
            raw, off, _ = byte_column(b.column(0))
            data, words, tokens = raw.tobytes(), [], []
            for lo, hi in chunks(off):
                split = [data[off[i]:off[i + 1]].split() for i in range(lo, hi)]
                if len(known) > STORED:
                    known.clear()
                new = set().union(*split) - known.keys()
                by_text = {MARK + w.decode("utf-8", "replace"): w for w in new}
                for text, n in terminal_counts(list(by_text), scores, byte_score).items():
                    known[by_text[text]] = n
                words += map(len, split)
                tokens += [sum(map(known.__getitem__, ws)) for ws in split]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*keep, "n_words", "n_tokens"])

    return map_arrow(source, count, schema)
