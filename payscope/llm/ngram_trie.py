"""Language-model scores from an Elias-Fano n-gram trie (operator 4).

*First level.* Words are 64-bit hashes.  Training counts are summed by word and written, by hash range, as Elias-Fano files with exact
counts in the shared folder; a word's number is its rank.  Tasks map these files into memory and look up the distinct words of
their rows.
*Second level.* Pairs (context, word) are counted by shards of contexts.  A task sends each shard, for a chunk of its rows, the distinct
pairs with their training counts and the documents they occur in, as one compressed row.  A shard builds its part of the trie:
contexts, monotone pointers to each context's successors, the successors relative to their context, all Elias-Fano, and 16-bit
quantised log10 probabilities and context weights.  First it only counts and keeps what was sent in a file: the counts of counts of all
shards give the discounts, the same for every shard, and those of a split context its weight.  Then it writes the part, maps it into memory, finds every sent pair by a successor
search within its context's range, and returns to each chunk one compressed row of sums by document.  A chunk's rows from all
shards meet in one task, which adds them up.  So no shard, chunk, task or driver holds more than its share.

*Model.*  P(w) = (c(w) + 1) / (N + V + 1);  P(w | v) = max(c(v, w) - D(c), 0) / c(v) + b(v) P(w), with the three discounts of modified
Kneser-Ney by count and b(v) what they free; contexts without training count fall back to P(w).  A document is its words
between a start mark (context only) and one end, which counts as a token.

A context with more than ``CONTEXT_TOKENS`` training tokens is split by its successors' hash over several shards, as often as that
number is reached; its total and the mass it frees are summed over all shards that hold some of it.

Cases: null and empty texts are one end token; null ids are trained on; repeated rows are scored and counted each; without training
tokens every probability is 1 / 1 (N = V = 0); an empty table gives an empty result.
"""

from __future__ import annotations

import mmap
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope.llm.common import keep, shared_path, table
from payscope.llm.elias_fano import EliasFano, pack_arrays, unpack_arrays
from payscope.llm.toxicity import in_fold
from payscope.llm.warc import open_fs

CHUNK_TOKENS = 1_000_000
SHARD_TOKENS = 1_000_000
CONTEXT_TOKENS = 250_000
MOST_TASKS = 10_000
WORDS_A_FILE = 4_000_000
FOLDS, HELD_OUT = 7, 2
LEAST_LOG = -16.0  # of the quantised values
END = b"\n"  # no word holds a line feed


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def quantise(logs: np.ndarray) -> np.ndarray:
    return np.round(np.clip(logs / LEAST_LOG, 0, 1) * 65535).astype("<u2")


def restore(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * (LEAST_LOG / 65535)


def write_file(folder: str, name: str, data: bytes) -> str:
    """Write into the shared folder under a name of this attempt's own; returns the name."""
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(data)
    return name


def map_file(folder: str, name: str) -> list[np.ndarray]:
    """The file's arrays over a memory map (over its bytes, where the folder is no file system of the machine)."""
    from pyarrow import fs as pafs
    fs, root = open_fs(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(f"{root}/{name}", "rb") as f:
            return unpack_arrays(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    with fs.open_input_file(f"{root}/{name}") as f:
        return unpack_arrays(f.read_buffer())


# -- first level ------------------------------------------------------------------------------------------------

@dataclass
class Vocabulary:
    """Where the first level lies: files by hash range, words before each; N training tokens, V distinct, training documents."""

    folder: str
    bits: int
    files: list[tuple[int, str, int]]  # range, file, words in earlier ranges
    n_tokens: int
    n_words: int
    n_docs: int
    context_tokens: int = CONTEXT_TOKENS  # from so many training tokens on a context is split

    def open(self) -> OpenVocabulary:
        return OpenVocabulary(self)


class OpenVocabulary:
    def __init__(self, v: Vocabulary):
        self.v, self.parts = v, {}
        for prefix, name, before in v.files:
            arrays = map_file(v.folder, name)
            self.parts[prefix] = (EliasFano.from_parts(arrays[:4]), arrays[4], before)
        self.starts = np.array([before for _, _, before in v.files], dtype=np.int64)
        self.counts = [self.parts[p][1] for p, _, _ in v.files]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and training count of each hash."""
        ids, counts = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        prefix = (hashes >> np.uint64(64 - self.v.bits)).astype(np.int64) if self.v.bits else np.zeros(len(hashes), dtype=np.int64)
        for p in np.unique(prefix).tolist():
            if p in self.parts:
                ef, c, before = self.parts[p]
                at = np.flatnonzero(prefix == p)
                place = ef.find(hashes[at])
                hit = place >= 0
                ids[at[hit]] = place[hit] + before
                counts[at[hit]] = c[place[hit]]
        return ids, counts

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        """Training counts by number."""
        out = np.zeros(len(ids), dtype=np.int64)
        part = np.searchsorted(self.starts, ids, side="right") - 1
        for p in np.unique(part[ids >= 0]).tolist():
            at = np.flatnonzero((part == p) & (ids >= 0))
            out[at] = self.counts[p][ids[at] - self.starts[p]]
        return out


def _word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): training counts by word hash, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(np.array([word_hash(w) for w in counts], dtype="<u8").view(np.int64)),
                                              pa.array(list(counts.values()), pa.int64())], ["h", "c"])
            counts.clear()
            return out

        for b in batches:
            for text, held_out in zip(b.column(0), b.column(1).to_pylist()):
                if not held_out:
                    counts.update(words_of(text.as_py()))
                    counts[END] += 1
            if len(counts) > 500_000:
                yield flush()
        if counts:
            yield flush()

    return docs.select("text", "held_out").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def build_vocabulary(docs: DataFrame) -> Vocabulary:
    """First level of ``docs`` (text, held_out)."""
    spark = docs.sparkSession
    folder, counted = shared_path(spark, "trie"), shared_path(spark, "trie-counts")
    _word_counts(docs).write.parquet(counted)
    counts = spark.read.parquet(counted)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("h") == _signed(word_hash(END)), F.col("c"))), F.lit(0))).first()
    bits = max(0, (int(total[1]) // WORDS_A_FILE).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not rows:
            return
        h, c = (np.concatenate(x) for x in zip(*rows))
        order = np.argsort(h)
        h, c = h[order], c[order]
        prefix = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)
        for p in np.unique(prefix).tolist():
            at = prefix == p
            data = pack_arrays([*EliasFano.build(h[at], 1 << 64).parts(), c[at].astype("<i8")])
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([write_file(folder, f"words-{p}", data)]), pa.array([int(at.sum())])], ["p", "name", "n"])

    prefix = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    written = counts.repartition(1 << bits, prefix).mapInArrow(run, "p long, name string, n long").collect()  # a row a file
    files, before = [], 0
    for r in sorted(written, key=lambda r: r["p"]):
        files.append((r["p"], r["name"], before))
        before += r["n"]
    return Vocabulary(folder, bits, files, int(total[0]), int(total[1]), int(total[2]), CONTEXT_TOKENS)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# -- what a chunk sends to the shards ---------------------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    """64 well-spread bits of each number (the finaliser of SplitMix64)."""
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _planes(a: np.ndarray) -> bytes:
    """The array's bytes, all lowest first: the high ones are mostly zero and compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b""


def _unplane(raw: bytes, at: int, n: int, dtype: str) -> tuple[np.ndarray, int]:
    width = np.dtype(dtype).itemsize
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(dtype).ravel()
    return a, at + n * width


_FIELDS = ("<u4", "<u4", "<u4", "<u4")  # context step, word, training count, documents
_DOC_FIELDS = ("<u4", "<u4")  # document, times


def pack_pairs(columns: list[np.ndarray], docs: list[np.ndarray]) -> bytes:
    body = b"".join(_planes(a.astype(t)) for a, t in zip([*columns, *docs], [*_FIELDS, *_DOC_FIELDS]))
    return np.array([len(columns[0]), len(docs[0])], dtype="<u4").tobytes() + zlib.compress(body, 1)


def unpack_pairs(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    n, m = np.frombuffer(blob, "<u4", 2).tolist()
    raw, at, out = zlib.decompress(blob[8:]), 0, []
    for size, kinds in ((n, _FIELDS), (m, _DOC_FIELDS)):
        for t in kinds:
            a, at = _unplane(raw, at, size, t)
            out.append(a)
    return out[:4], out[4:]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, dtype=np.int64)
    change = np.zeros(len(keys[0]), dtype=bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


class Chunk:
    """Rows of one task up to ``CHUNK_TOKENS``: first-level sums by document, and pairs by shard."""

    def __init__(self, vocabulary: OpenVocabulary, n_shards: int):
        self.words, self.v, self.n_shards = vocabulary, vocabulary.v, n_shards
        self.local: dict[bytes, int] = {END: 0}
        self.tokens: list[np.ndarray] = []
        self.ids: list = []
        self.held_out: list[bool] = []
        self.size = 0

    def add(self, doc_id, text: str | None, held_out: bool) -> None:
        words, local = words_of(text), self.local
        for w in set(words).difference(local):
            local[w] = len(local)
        ids = np.fromiter(map(local.__getitem__, words), dtype=np.int32, count=len(words))
        self.tokens.append(np.append(ids, np.int32(0)))
        self.ids.append(doc_id)
        self.held_out.append(held_out)
        self.size += len(words) + 1

    def summed(self) -> tuple[list[np.ndarray], Iterator[tuple[int, bytes]]]:
        """([n_tokens, n_known, base score, score outside the second level] by document, (shard, blob) rows)."""
        lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        tokens = np.concatenate(self.tokens)
        gid, count = self.words.find(np.array([word_hash(w) for w in self.local], dtype="<u8"))
        logs = np.log10((count + 1) / (self.v.n_tokens + self.v.n_words + 1))
        logs, known = logs[tokens], (count > 0)[tokens]
        # numbers of the second level: unknown words are V, the start is V + 1
        gid = np.where(gid < 0, self.v.n_words, gid)[tokens]
        context = np.append(np.int64(self.v.n_words + 1), gid[:-1])
        context[starts] = self.v.n_words + 1
        reach = np.append(np.int64(0), count[tokens][:-1])
        reach[starts] = self.v.n_docs
        sent = reach > 0
        outside = np.add.reduceat(np.where(sent, 0.0, logs), starts)
        sums = [lengths, np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(logs, starts), outside]
        return sums, self._pairs(context[sent], gid[sent], reach[sent], np.repeat(np.arange(len(lengths)), lengths)[sent])

    def _pairs(self, context, word, reach, doc) -> Iterator[tuple[int, bytes]]:
        parts = 1 + reach // self.v.context_tokens
        spread = _mix(context) + np.where(parts > 1, _mix(word) % parts.astype(np.uint64), np.uint64(0))
        shard = (_mix(spread) % np.uint64(self.n_shards)).astype(np.int64)
        order = np.lexsort((word, context, shard))  # stable: documents stay ascending
        context, word, doc, shard = context[order], word[order], doc[order], shard[order]
        trained = (~np.array(self.held_out, dtype=bool))[doc]
        by_doc = _runs(shard, context, word, doc)
        times = np.diff(np.append(by_doc, len(doc)))
        first = by_doc[_runs(shard[by_doc], context[by_doc], word[by_doc])]  # starts of pairs among tokens
        n_trained = np.add.reduceat(trained.astype(np.int64), first) if len(first) else first
        doc_at = np.searchsorted(by_doc, first)
        n_docs = np.diff(np.append(doc_at, len(by_doc)))
        cuts = _runs(shard[first]) if len(first) else first
        for a, b in zip(cuts, np.append(cuts[1:], len(first))):
            d0, d1 = doc_at[a], doc_at[b] if b < len(first) else len(by_doc)
            step = np.diff(context[first[a:b]], prepend=0)
            yield int(shard[first[a]]), pack_pairs([step, word[first[a:b]], n_trained[a:b], n_docs[a:b]], [doc[by_doc[d0:d1]], times[d0:d1]])


# -- a shard ----------------------------------------------------------------------------------------------------

def discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more, at index count (0: 0); from counts of counts."""
    return discounts_of(*((counts == k).sum() for k in (1, 2, 3, 4)))


def discounts_of(*counts_of_counts: int) -> np.ndarray:
    n1, n2, n3, n4 = map(float, counts_of_counts)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = [0.0]
    for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)):
        out.append(min(max(k - (k + 1) * y * b / a, 0.05 * k), 0.98 * k) if a else 0.5 * k)
    return np.array(out)


class TriePart:
    """A shard's contexts with their successors, probabilities and weights."""

    def __init__(self, arrays: list[np.ndarray]):
        self.contexts, self.pointers, self.successors = (EliasFano.from_parts(arrays[4 * k: 4 * k + 4]) for k in range(3))
        self.log_p, self.log_b, self.width = arrays[12], arrays[13], int(arrays[14][0])

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, count: np.ndarray, vocabulary: OpenVocabulary, of_count: np.ndarray | None = None,
              split: dict[int, tuple[int, float]] | None = None) -> bytes:
        """From ascending distinct (context, word) with their training counts (1 or more).

        ``of_count``: the discounts (default: those of ``count``); ``split``: total and freed mass of contexts that go on in other parts.
        """
        v = vocabulary.v
        starts = _runs(context)
        own = context[starts]
        sums = np.add.reduceat(count, starts) if len(starts) else starts
        d = (discounts(count) if of_count is None else of_count)[np.minimum(count, 3)]
        freed = np.add.reduceat(d, starts) if len(starts) else np.zeros(0)
        total = sums.astype(np.float64)
        for at, c in enumerate(own.tolist() if split else []):
            if c in split:
                total[at], freed[at] = split[c]
        weight = np.minimum(freed / total, 1.0)
        rank = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(context))))
        below = (vocabulary.count_of(np.where(word < v.n_words, word, -1)) + 1) / (v.n_tokens + v.n_words + 1)
        p = (count - d) / total[rank] + weight[rank] * below
        width = v.n_words + 2
        relative = rank.astype(np.uint64) * np.uint64(width) + word.astype(np.uint64)
        return pack_arrays([*EliasFano.build(own.astype(np.uint64), width).parts(),
                            *EliasFano.build(np.append(starts, len(context)).astype(np.uint64), len(context) + 1).parts(),
                            *EliasFano.build(relative, max(len(starts), 1) * width).parts(),
                            quantise(np.log10(np.maximum(p, 1e-300))), quantise(np.log10(np.maximum(weight, 1e-300))), np.array([width], dtype="<i8")])

    def log10(self, context: np.ndarray, word: np.ndarray, log_word: np.ndarray) -> np.ndarray:
        """log10 P(word | context); ``log_word`` is log10 P(word).  Contexts without training pairs: log P(word)."""
        rank = self.contexts.find(context.astype(np.uint64))
        known = rank >= 0
        out = log_word.copy()
        r = rank[known]
        begin, end = self.pointers.access(r).astype(np.int64), self.pointers.access(r + 1).astype(np.int64)
        place = self.successors.find(r.astype(np.uint64) * np.uint64(self.width) + word[known].astype(np.uint64), begin, end)
        hit = place >= 0
        out[known] = np.where(hit, restore(self.log_p[np.maximum(place, 0)]) if len(self.log_p) else 0.0, restore(self.log_b[r]) + out[known])
        return out


def _counted(chunks: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct (context, word) of the chunks' pairs with their training counts (1 or more)."""
    context, word, trained = (np.concatenate([c[k] for c in chunks]) for k in (1, 2, 3))
    on = trained > 0
    order = np.lexsort((word[on], context[on]))
    c, w = context[on][order], word[on][order]
    starts = _runs(c, w)
    return c[starts], w[starts], np.add.reduceat(trained[on][order], starts) if len(starts) else starts


def _unpacked(rows: list[tuple[int, bytes]]) -> list[tuple]:
    chunks = []
    for chunk, blob in rows:
        (step, word, trained, n_docs), (doc, times) = unpack_pairs(blob)
        chunks.append((chunk, np.cumsum(step.astype(np.int64)), word.astype(np.int64), trained.astype(np.int64), n_docs, doc, times))
    return chunks


def _keep_shard(rows: list[tuple[int, bytes]], shard: int, vocabulary: OpenVocabulary) -> Iterator[tuple]:
    """(file, null, 0, n1, n2, n3, n4) of the shard, and (null, context, total, pairs of count 1, 2, 3 or more, 0) of split contexts."""
    v = vocabulary.v
    context, _, count = _counted(_unpacked(rows))
    data = pack_arrays([np.array([c for c, _ in rows], dtype="<i8"), np.array([len(b) for _, b in rows], dtype="<i8"),
                        np.frombuffer(b"".join(b for _, b in rows), dtype=np.uint8)])
    yield (write_file(v.folder, f"sent-{shard}", data), None, 0, *(int((count == k).sum()) for k in (1, 2, 3, 4)))
    starts = _runs(context)
    own, ends = context[starts], np.append(starts[1:], len(context))
    reach = np.where(own > v.n_words, v.n_docs, vocabulary.count_of(np.where(own < v.n_words, own, -1)))
    for at in np.flatnonzero(reach >= v.context_tokens).tolist():
        c = count[starts[at]: ends[at]]
        yield (None, int(own[at]), int(c.sum()), int((c == 1).sum()), int((c == 2).sum()), int((c >= 3).sum()), 0)


def _score_shard(name: str, shard: int, vocabulary: OpenVocabulary, of_count: np.ndarray, split: dict[int, tuple[int, float]]) -> Iterator[tuple[int, bytes]]:
    """(chunk, sums of log10 P by document) of the chunks' pairs."""
    numbers, sizes, raw = map_file(vocabulary.v.folder, name)
    ends = np.cumsum(sizes)
    chunks = _unpacked([(n, raw[e - size: e].tobytes()) for n, size, e in zip(numbers.tolist(), sizes.tolist(), ends.tolist())])
    name = write_file(vocabulary.v.folder, f"pairs-{shard}", TriePart.build(*_counted(chunks), vocabulary, of_count, split))
    part = TriePart(map_file(vocabulary.v.folder, name))
    for chunk, context, word, _, n_docs, doc, times in chunks:
        base = vocabulary.count_of(np.where(word < vocabulary.v.n_words, word, -1)) + 1
        log_p = part.log10(context, word, np.log10(base / (vocabulary.v.n_tokens + vocabulary.v.n_words + 1)))
        sums = np.bincount(doc, weights=np.repeat(log_p, n_docs) * times)
        docs = np.unique(doc)
        yield chunk, zlib.compress(pack_arrays([docs.astype("<u4"), sums[docs].view("<i8")]), 1)


# -- scores -----------------------------------------------------------------------------------------------------

def _to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; trained on rows where ``held_out`` is false."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    v = build_vocabulary(rows)
    n_shards = max(1, -(-v.n_tokens // SHARD_TOKENS))
    id_type = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(v)  # file names: one for WORDS_A_FILE distinct words

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's documents in one row and its pairs in one row a shard."""
        vocabulary = shared.value.open()
        number = TaskContext.get().partitionId() << 32
        chunk, id_kind = Chunk(vocabulary, n_shards), None

        def row(shard: int, pairs: bytes | None, own: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([number]), pa.array([pairs], pa.binary()), pa.array([own], pa.binary())],
                                              ["shard", "chunk", "pairs", "docs"])

        def flush():
            nonlocal chunk, number
            sums, pairs = chunk.summed()
            own = pa.RecordBatch.from_arrays([pa.array(chunk.ids, id_kind), pa.array(chunk.held_out, pa.bool_()), *map(pa.array, sums)],
                                             ["id", "held_out", "n_tokens", "n_known", "base", "part"])
            yield row(int(_mix(np.array([number]))[0] % np.uint64(n_shards)), None, _to_bytes(own))
            for shard, blob in pairs:
                yield row(shard, blob, None)
            number += 1
            chunk = Chunk(vocabulary, n_shards)

        for b in batches:
            id_kind = b.schema.field(0).type
            for i, text, out in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                chunk.add(i, text.as_py(), bool(out))
                if chunk.size >= CHUNK_TOKENS:
                    yield from flush()
        if chunk.ids:
            yield from flush()

    kept = "shard long, name string, context long, total long, n1 long, n2 long, n3 long, n4 long, chunk long, docs binary"
    names = [c.split()[0] for c in kept.split(", ")]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 7, pa.binary()]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard's pairs into a file, with its counts of counts; the chunks' documents pass."""
        vocabulary = shared.value.open()
        rows: list[tuple[int, bytes]] = []
        now = None

        def batch(*found: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), kinds)], names)

        def gathered():
            out = batch(*[(now, *row, None, None) for row in _keep_shard(rows, now, vocabulary)])
            rows.clear()
            return out

        for b in batches:
            for shard, chunk, pairs, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if own.is_valid:
                    yield batch((shard, None, None, None, None, None, None, None, chunk, own.as_py()))
                    continue
                if shard != now and rows:
                    yield gathered()
                now = shard
                rows.append((chunk, pairs.as_py()))
        if rows:
            yield gathered()

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each shard's pairs by chunk; a shard's split contexts come before its file."""
        vocabulary = shared.value.open()
        split: dict[int, tuple[int, float]] = {}
        now = None
        for b in batches:
            for shard, name, context, total, freed in zip(*(b.column(k).to_pylist() for k in range(5))):
                if shard != now:
                    split, now = {}, shard
                if name is None:
                    split[context] = (total, freed)
                    continue
                for chunk, sums in _score_shard(name, shard, vocabulary, of_count, split):
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sums], pa.binary()), pa.nulls(1, pa.binary())], ["chunk", "sums", "docs"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents of each chunk with their sums from all shards."""
        now, own, found = None, None, []

        def added():
            with pa.ipc.open_stream(own) as stream:
                batch = stream.read_next_batch()
            total = batch.column(5).to_numpy().copy()
            for blob in found:
                at, sums = unpack_arrays(zlib.decompress(blob))
                total[at] += sums.view(np.float64)
            found.clear()
            return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(total)], ["id", "held_out", "n_tokens", "n_known", "base", "score"])

        for b in batches:
            for chunk, sums, docs_ in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if chunk != now and now is not None:
                    yield added()
                now = chunk
                if docs_.is_valid:
                    own = docs_.as_py()
                else:
                    found.append(sums.as_py())
        if now is not None:
            yield added()

    sent = rows.mapInArrow(send, "shard long, chunk long, pairs binary, docs binary").repartition("shard").sortWithinPartitions("shard", "chunk")
    held = keep(sent.mapInArrow(gather, kept), "trie-shards")
    files = held.where(F.col("name").isNotNull())
    n = files.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in (1, 2, 3, 4)]).first()
    of_count = discounts_of(*n)
    split = held.where(F.col("context").isNotNull())
    mass = sum((F.sum(f"n{k}") * F.lit(float(of_count[k])) for k in (1, 2, 3)), F.lit(0.0))
    whole = split.groupBy("context").agg(F.sum("total").alias("total"), mass.alias("freed"))
    weights = split.select("shard", "context").join(whole, "context").select("shard", F.lit(None).cast("string").alias("name"), "context", "total", "freed")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("context", "long"), ("total", "long"), ("freed", "double"))]
    jobs = weights.unionByName(files.select("shard", "name", *none)).repartition(min(n_shards, MOST_TASKS), "shard")
    scored = jobs.sortWithinPartitions("shard", F.col("name").asc_nulls_first()).mapInArrow(receive, "chunk long, sums binary, docs binary")
    own_rows = held.where(F.col("docs").isNotNull()).select("chunk", F.lit(None).cast("binary").alias("sums"), "docs")
    parts = scored.unionByName(own_rows).repartition("chunk").sortWithinPartitions("chunk", F.xxhash64("sums"))
    out = parts.mapInArrow(add_up, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(v.n_tokens).cast("long").alias("train_tokens"),
                      F.col("base").alias("base_score"), "score")


def op4_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), in_fold("doc_id", FOLDS, HELD_OUT))


QUERIES = {"op4_ngram_scores": op4_ngram_scores}
ORACLE_SQL: dict[str, str] = {}  # the trie has no SQL form; tests/llm compares with brute force
