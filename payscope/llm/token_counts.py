"""Token counts of whole texts from piece counts of distinct pre-tokens (operator 12).

*Pre-tokens.* A piece model merges neighbouring characters only into strings of its vocabulary.  Between two characters that no
piece holds side by side nothing is ever merged, so a text may be cut there and the cuts' counts add up to the text's.  Two
kinds of such places are read off the vocabulary when the model is loaded: before a run of spaces (no piece goes on from
another character into a space), and on both sides of a character that stands in no piece of two or more (line feeds, rare
scripts).  The space that the model puts before a text is part of the first pre-token.

*Frequencies.* One pass over the texts counts pre-tokens per document.  Documents are taken in blocks of about ``BLOCK_CHARS``
characters.  A block's distinct pre-tokens are listed by bucket (CRC-32 modulo ``BUCKETS``); a document's frequencies are (place in
that list, times), as differences of ascending places.  Both are written as Parquet, compressed: one row a block for the
frequencies, one row a block and bucket for the pre-tokens.

*Counting.* The pre-tokens of a bucket come together from all blocks, each distinct one is counted once by the model's own library,
and its count is joined to every block that lists it.  The counts go back to their block, where each document's frequencies are
multiplied with them and summed.  No token id is made for a document.  A frequent pre-token has one entry a block, never one an
occurrence.  A task holds one block, or the counts of the bucket it is in (at most ``MOST_KNOWN`` at a time; beyond that it forgets
them and counts anew when needed).

Cases: null and empty texts have 0 tokens; repeated rows and ids are counted each; a null id is kept; an empty table gives an
empty result; columns of ``docs`` other than id and text are left out, so names cannot clash.  Models with a normalisation,
user-defined pieces or without byte fallback are refused: their counts need not add up over cuts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from payscope.llm.common import keep, table, text_or_empty

BLOCK_CHARS = 1 << 25
BUCKETS = 1024
MOST_KNOWN = 4_000_000
LIMIT = 4096
SPACE = "▁"  # how the model writes a space


class PieceModel:
    """Cuts texts into pre-tokens and counts the pieces of one."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, model.SentencePiece.Type
        if (norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix
                or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)):
            raise ValueError(f"{path}: counts of its pre-tokens need not add up to those of a text")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        joined = [p.piece for p in model.pieces if p.type == kinds.NORMAL and len(p.piece) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in joined):
            raise ValueError(f"{path}: a piece goes on over a space")
        inner = "".join(map(re.escape, sorted({c for p in joined for c in p} - {SPACE})))
        self.cut = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|[^{inner}{SPACE}]").findall
        norm.add_dummy_prefix = False  # a pre-token carries its own spaces
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def pretokens(self, text: str) -> list[str]:
        return self.cut(self.prefix + text.replace(" ", SPACE)) if text else []

    def counts(self, pretokens: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(pretokens, num_threads=1)]


@lru_cache(maxsize=1)
def load(path: str) -> PieceModel:
    """The model of a file, once a worker."""
    return PieceModel(path)


# -- compressed columns -------------------------------------------------------------------------------------------

_APART = b"\xff"  # in no UTF-8


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their count before them: first all lowest bytes, then all second ones, and so on."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = pa.decompress(packed[8:], 4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _pack_words(words: list[str]) -> bytes:
    joined = _APART.join(w.encode() for w in words)
    return len(joined).to_bytes(8, "little") + pa.compress(joined, codec="zstd", asbytes=True)


def _unpack_words(packed: bytes) -> list[str]:
    joined = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    return [w.decode() for w in joined.split(_APART)]


class Block:
    """Documents of one block and the pre-tokens that they hold."""

    def __init__(self):
        self.ids, self.sizes, self.places, self.times, self.known, self.chars = [], [], [], [], {}, 0

    def add(self, key: object, text: str, found: Counter) -> None:
        known = self.known
        self.ids.append(key)
        self.sizes.append(len(text.encode()))
        self.places.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found)))
        self.times.append(np.fromiter(found.values(), np.int64, len(found)))
        self.chars += len(text)

    def lists(self, buckets: int) -> tuple[np.ndarray, list[tuple[int, list[str]]]]:
        """The new place of each pre-token, and the pre-tokens of each bucket that has some."""
        words = list(self.known)
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        used, first = np.unique(bucket[order], return_index=True)
        return place, [(int(b), [words[i] for i in part]) for b, part in zip(used, np.split(order, first[1:]))] if words else []

    def frequencies(self, place: np.ndarray) -> tuple[list[int], bytes, bytes]:
        """Entries of each document, differences of its ascending places, times."""
        lengths = [len(p) for p in self.places]
        doc = np.repeat(np.arange(len(lengths)), lengths)
        at = place[np.concatenate([*self.places, np.empty(0, np.int64)])]
        order = np.lexsort((at, doc))
        at = at[order]
        step = np.diff(at, prepend=0)
        first = np.cumsum([0, *lengths[:-1]])[np.array(lengths, dtype=np.int64) > 0]
        step[first] = at[first]
        return lengths, _pack(step), _pack(np.concatenate([*self.times, np.empty(0, np.int64)])[order])


def sums(lengths: np.ndarray, steps: np.ndarray, times: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each document the sum of times * n[place]; ``lengths`` and ``steps`` as ``Block.frequencies`` gives them."""
    upto = np.cumsum(steps)
    ends = np.cumsum(lengths)
    before = np.append(0, upto)[ends - lengths]  # differences start anew with each document
    total = np.append(0, np.cumsum(n[upto - np.repeat(before, lengths)] * times))
    return total[ends] - total[ends - lengths]


# -- the job ------------------------------------------------------------------------------------------------------

def frequencies(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                block_chars: int = BLOCK_CHARS, buckets: int = BUCKETS) -> DataFrame:
    """Rows of blocks (block, ids, sizes, lengths, steps, times; bucket null) and of their lists (block, bucket, words)."""
    names = ["block", "bucket", "words", "ids", "sizes", "lengths", "steps", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number, block, id_type = load(model_path), TaskContext.get().partitionId() << 33, Block(), None

        def rows() -> Iterator[pa.RecordBatch]:
            place, lists = block.lists(buckets)
            types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            row = (number, None, None, block.ids, block.sizes, *block.frequencies(place))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)
            cols = [[number] * len(lists), [b for b, _ in lists], [_pack_words(w) for _, w in lists]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types)] + [pa.nulls(len(lists), t) for t in types[3:]], names)

        for b in batches:
            id_type = b.schema.field(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                block.add(key, text, Counter(model.pretokens(text)))
                if block.chars >= block_chars:
                    yield from rows()
                    number, block = number + 1, Block()
        if block.ids:
            yield from rows()

    types = [LongType(), IntegerType(), BinaryType(), ArrayType(docs.schema[id_col].dataType), ArrayType(LongType()), ArrayType(IntegerType()),
             BinaryType(), BinaryType()]
    return docs.select(id_col, text_or_empty(text_col)).mapInArrow(run, StructType([StructField(n, t) for n, t in zip(names, types)]))


def piece_counts(lists: DataFrame, model_path: str) -> DataFrame:
    """(of_block, bucket, n): the packed piece counts of the pre-tokens of each row of ``lists`` (of_block, bucket, words), ordered by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, now, known = load(model_path), None, {}
        for b in batches:
            out = []
            for bucket, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if bucket != now or len(known) > MOST_KNOWN:
                    now, known = bucket, {}
                words = _unpack_words(packed)
                new = [w for w in words if w not in known]
                known.update(zip(new, model.counts(new)))
                out.append(_pack(np.fromiter((known[w] for w in words), np.int64, len(words))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["of_block", "bucket", "n"])

    return lists.mapInArrow(run, "of_block long, bucket int, n binary")


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 block_chars: int = BLOCK_CHARS, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens.  ``model_path`` is the model file's path on the workers."""
    found = keep(frequencies(docs, model_path, id_col, text_col, block_chars, buckets), "token-frequencies")
    blocks = found.where("bucket IS NULL")
    lists = found.where("bucket IS NOT NULL").select(F.col("block").alias("of_block"), "bucket", "words")
    parts = min(buckets, max(8, blocks.count()))
    counted = piece_counts(lists.repartition(parts, "bucket").sortWithinPartitions("bucket"), model_path)

    def total(block: pa.Table, pieces: pa.Table) -> pa.Table:
        in_order = pieces.sort_by("bucket")["n"].to_pylist()
        n = np.concatenate([*map(_unpack, in_order), np.empty(0, np.int64)])
        row = block.slice(0, 1)
        of = lambda c: row[c].combine_chunks().flatten()
        tokens = sums(of("lengths").to_numpy().astype(np.int64), _unpack(row["steps"][0].as_py()), _unpack(row["times"][0].as_py()), n)
        return pa.table({id_col: of("ids"), "n_bytes": of("sizes"), "n_tokens": pa.array(tokens, pa.int64())})

    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    per_block = blocks.select("block", "ids", "sizes", "lengths", "steps", "times")
    return per_block.groupBy("block").cogroup(counted.groupBy("of_block")).applyInArrow(total, schema)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), model_path())
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op12_token_counts": op12_token_counts}
ORACLE_SQL: dict[str, str] = {}  # the piece model has no SQL form; tests/llm compares with the library on whole texts
