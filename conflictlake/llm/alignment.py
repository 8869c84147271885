"""Cross-tokenizer alignment of a text's tokens, and how often ids are linked corpus-wide.

Both tokenizers write the same bytes (a space and the text).  Where tokens of both
end at the same byte the text is cut; what lies between two cuts is a group, and
the two tokens that end at a cut are linked.

Most groups are one token on either side with the same bytes.  A table made once
from the two vocabularies (A id -> B id of the same bytes) tells them at once;
they are counted in a vector with an entry per A id, and only those vectors are
added up over the corpus.  Pairs from irregular groups are counted a block at a
time, and the distinct pairs of each block go through ``tally``, which answers
with their corpus-wide counts.  On the driver, and in every task, are numbers per
vocabulary entry only.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflictlake.llm import words as W
from conflictlake.llm.bpe import _byte_of
from conflictlake.llm.common import kept_by_worker, map_arrow
from conflictlake.llm.tally import SUMMARY, answers, by_block, pack_numbers, pack_sorted, request_rows, slices_for, unpack_numbers, unpack_sorted
from conflictlake.operators.stored import Stored

BLOCK_BYTES = 4 << 20
LONG_RUN = 2000  # texts with a longer run of one kind go through the library that is not quadratic in a run
_SPACES = re.compile(rf"\s{{{LONG_RUN}}}")
SPACE = "▁"


class ByteTokens:
    """A byte-level BPE file; strings of its special tokens are ordinary text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        spec, of = json.load(open(path, encoding="utf-8")), _byte_of()
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.table = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for t, i in vocab.items():
            self.table[i] = t
        self._path, self._exact = path, None
        self._core = tiktoken.Encoding("align", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if len(text) < LONG_RUN or max(map(len, text.split()), default=0) < LONG_RUN and not _SPACES.search(text):
            return self._core.encode_to_numpy(text, disallowed_special=())
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self._path)
            self._exact.encode_special_tokens = True
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)


class PieceTokens:
    """A SentencePiece file; byte pieces stand for their byte."""

    def __init__(self, path: str):
        import sentencepiece

        self._core = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = []
        for i in range(self._core.vocab_size()):
            piece = self._core.id_to_piece(i)
            self.table.append(bytes([int(piece[3:-1], 16)]) if self._core.is_byte(i) else piece.replace(SPACE, " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._core.encode(texts, num_threads=1)


class Pair:
    """Two tokenizers: byte lengths, the identity map and the written forms of their ids."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteTokens(byte_path), PieceTokens(piece_path)
        self.length_a, self.length_b = (np.array([len(t) for t in x.table], np.int64) for x in (self.a, self.b))
        place = {t: i for i, t in reversed(list(enumerate(self.b.table))) if t}  # of equal B entries the smallest id
        self.same = np.array([place.get(t, -1) for t in self.a.table], np.int64)
        # written forms: A inside a group, A at its end, B inside, B at its end
        self.written = np.array([f"{i}{end}".encode() for n, ends in ((len(self.same), ",|"), (len(self.length_b), ",;")) for end in ends for i in range(n)], object)
        self.bytes_a, self.bytes_b = (np.array(x.table, object) for x in (self.a, self.b))

    def groups(self, text: str, ids_b: list[int]):
        """(n_a, n_b, n_groups, digest, linked A ids, linked B ids) of one text, or None if its bytes differ."""
        whole = (" " + text).encode()
        a, b = self.a.encode(" " + text).astype(np.int64), np.array(ids_b, np.int64)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        if not len(a) or not len(b) or end_a[-1] != len(whole) or end_b[-1] != len(whole) or any(
                b"".join(table[ids]) != whole for table, ids in ((self.bytes_a, a), (self.bytes_b, b))):
            return None
        ends = np.zeros((2, len(whole) + 1), bool)
        ends[0, end_a] = ends[1, end_b] = True
        cut_a, cut_b = ends[1, end_a], ends[0, end_b]  # tokens that end where one of the other side ends
        last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        # write the ids in the order A of group, B of group
        form_a, form_b = a + cut_a * len(self.length_a), b + 2 * len(self.length_a) + cut_b * len(self.length_b)
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        begin_b = np.concatenate([[0], last_b[:-1] + 1])
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + begin_b[group_a]] = form_a
        out[np.arange(len(b)) + last_a[group_b] + 1] = form_b
        said = b"".join(self.written[out])[:-1]
        return len(a), len(b), len(last_a), hashlib.sha256(said).hexdigest(), a[last_a], b[last_b]


@kept_by_worker(2)
def pair(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


def blocks(docs: DataFrame, byte_path: str, piece_path: str, id_col: str, text_col: str) -> DataFrame:
    """Texts as links: per document its counts and digest; per block the distinct irregular pairs,
    the links as places in (A ids, then pairs), and how often each A id is linked to its equal."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = (f"block long, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, "
              "links binary, pairs binary, counts binary, equal binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, number = pair(byte_path, piece_path), TaskContext.get().partitionId() << 33
        size_a, size_b = len(both.length_a), np.int64(len(both.length_b))

        def block(ids, rows):
            linked = [r[4:] for r in rows if r[2]]
            a, b = (np.concatenate([x[i] for x in linked]) if linked else np.zeros(0, np.int64) for i in (0, 1))
            regular = both.same[a] == b
            key = W.mix((a * size_b + b)[~regular].astype(np.uint64))
            keys, where, times = np.unique(key, return_inverse=True, return_counts=True)
            place = a.copy()
            place[~regular] = size_a + where
            one = np.array([0, len(rows)], np.int32)
            arrays = [pa.ListArray.from_arrays(one, ids)]
            arrays += [pa.ListArray.from_arrays(one, pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string())) for i in range(4)]
            tail = [pack_numbers(place), pack_sorted(keys) if len(keys) else b"", pack_numbers(times), pack_numbers(np.bincount(a[regular], minlength=size_a))]
            names = [f.split()[0] for f in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([number]), *arrays, *[pa.array([x], pa.binary()) for x in tail]], names=names)

        for b in batches:
            lo, size, texts = 0, 0, b.column(1)
            nothing = (0, 0, 0, "")
            rows: list = []
            for at in range(b.num_rows):
                text = texts[at].as_py() or ""
                rows.append((text and both.groups(text, both.b.encode([text])[0])) or nothing)
                size += 2 * len(text)
                if size >= BLOCK_BYTES or at + 1 == b.num_rows:
                    yield block(b.column(0)[lo:at + 1], rows)
                    lo, size, rows, number = at + 1, 0, [], number + 1

    return map_arrow(source, cut, schema)


def _unmixed(keys: np.ndarray) -> np.ndarray:
    """Inverse of ``words.mix``."""
    h = keys ^ (keys >> np.uint64(31)) ^ (keys >> np.uint64(62))
    h = h * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    h = h ^ (h >> np.uint64(27)) ^ (h >> np.uint64(54))
    h = h * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


class Alignment:
    """Links of a corpus: ``pair_counts`` and ``documents``; ``delete`` drops what is stored."""

    def __init__(self, docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text"):
        self.id_col, self.paths = id_col, (byte_path, piece_path)
        self.both = pair(byte_path, piece_path)
        self.coded = Stored(blocks(docs, byte_path, piece_path, id_col, text_col), "align-blocks")
        n = self.coded.df.agg(F.sum(F.length("pairs"))).first()[0] or 0
        slices = slices_for(n // 6)  # a packed key takes about six bytes

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [r for block, keys, counts in zip(*(c.to_pylist() for c in b.columns))
                        if keys for r in request_rows(block, unpack_sorted(keys), unpack_numbers(counts), slices)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                                                     names=["slice", "block", "keys", "counts"])

        def summary(number: int, keys: np.ndarray, totals: np.ndarray) -> bytes:
            packed = pack_sorted(keys)
            return len(packed).to_bytes(4, "little") + packed + pack_numbers(totals)

        asked = map_arrow(self.coded.df.select("block", "pairs", "counts"), ask, "slice long, block long, keys binary, counts binary")
        self.told = Stored(answers(asked, slices, summary), "align-counts")

    def pair_counts(self) -> DataFrame:
        """(a_id, b_id, n): how many links of the corpus hold each pair."""
        same, size_b = self.both.same, len(self.both.length_b)

        def regular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(same), np.int64)
            for b in batches:
                for x in b.column(0):
                    total += unpack_numbers(x.as_py()).astype(np.int64)
            a = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(same[a]), pa.array(total[a])], names=["a_id", "b_id", "n"])

        def irregular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x in b.column(0).to_pylist():
                    n = 4 + int.from_bytes(x[:4], "little")
                    key = _unmixed(unpack_sorted(x[4:n])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key // size_b), pa.array(key % size_b), pa.array(unpack_numbers(x[n:]).astype(np.int64))],
                                                     names=["a_id", "b_id", "n"])

        schema = "a_id long, b_id long, n long"
        one = map_arrow(self.coded.df.select("equal"), regular, schema).groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))
        return one.unionByName(map_arrow(self.told.df.where(F.col("block") == SUMMARY).select("totals"), irregular, schema))

    def documents(self) -> DataFrame:
        """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
        spark = self.coded.df.sparkSession
        counts = Stored(self.pair_counts(), "align-pairs")
        best, equal = np.zeros(len(self.both.length_b), np.int64), np.zeros(len(self.both.same), np.int64)
        for r in counts.df.groupBy("b_id").agg(F.max("n")).toLocalIterator():  # a row per B id at most
            best[r[0]] = r[1]
        same, size_b = self.both.same, len(self.both.length_b)
        known = spark.createDataFrame([(int(a), int(b)) for a, b in enumerate(same) if b >= 0], "a_id long, b_id long")
        for r in counts.df.join(known, ["a_id", "b_id"]).select("a_id", "n").toLocalIterator():  # a row per A id at most
            equal[r[0]] = r[1]
        counts.delete()
        numbers = spark.sparkContext.broadcast((best, equal, best[same] == equal))
        kind = self.coded.df.schema["ids"].dataType.elementType.simpleString()
        names = [self.id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        schema = f"`{names[0]}` {kind}, " + ", ".join(f"{c} long" for c in names[1:-1]) + ", groups_sha256 string"

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top, fixed, fixed_best = numbers.value
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, n_a, n_b, groups, digests, links, pairs, answered = (c[i] for c in batch.columns)
                    total, is_best = fixed, fixed_best
                    if pairs.as_py():
                        told = np.concatenate([unpack_numbers(x["totals"]) for x in answered.as_py()]).astype(np.int64)
                        b = _unmixed(unpack_sorted(pairs.as_py())).astype(np.int64) % size_b
                        total, is_best = np.concatenate([fixed, told]), np.concatenate([fixed_best, told == top[b]])
                    at = unpack_numbers(links.as_py()).astype(np.int64)
                    n = groups.values.to_numpy()
                    edge = np.concatenate([[0], np.cumsum(n)])
                    sums = [np.concatenate([[0], np.cumsum(x[at])]) for x in (total, is_best.astype(np.int64))]
                    all_, best_ = (s[edge[1:]] - s[edge[:-1]] for s in sums)
                    yield pa.RecordBatch.from_arrays([ids.values, n_a.values, n_b.values, groups.values, groups.values, pa.array(best_), pa.array(all_), digests.values], names=names)

        met = self.coded.df.join(by_block(self.told.df), "block", "left").select(
            "ids", "n_a", "n_b", "n_groups", "digests", "links", "pairs", "answered")
        return map_arrow(met, finish, schema)

    def delete(self) -> None:
        self.coded.delete()
        self.told.delete()


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``Alignment.documents`` of a corpus, stored.

    Texts that are null, empty, or of which one tokenizer does not give back a
    space and the text byte by byte have no tokens: zeros and an empty digest.
    Strings of special tokens are ordinary text.  Repeated rows are documents of
    their own and count as often; null ids are ids.  Other columns are not read,
    whatever their names.  An empty table gives an empty table.
    """
    found = Alignment(docs, byte_path, piece_path, id_col, text_col)
    out = Stored(found.documents(), "align-documents")
    found.delete()
    return out.df
