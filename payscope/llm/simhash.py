"""SimHash near-duplicates by anchor-point covering (operator 6).

*Fingerprint.* 64 bits; a bit is set where more than half of the text's shingle hashes have it.

*Anchors.* Two fingerprints within ``max_bits`` differ by at most ``max_bits // 2`` bits in one of their 32-bit halves.  The
anchors of a half are the 2**26 words of the Hamming code over its low 31 bits, whose covering radius is 1: every half has one home
anchor within 1 bit.  Each distinct fingerprint is replicated, for both halves, to every anchor within the radius plus the half's
threshold (16 anchors a half for 3 bits), so each link meets at the home anchor of either end.  The fingerprints of an anchor are
compared with each other; what leaves an anchor with many of them is a spanning forest of its links, never all pairs.

*Size.* Only distinct fingerprints are replicated (about 32 rows of 17 bytes each), so exact copies cost one row however many
there are.  The rows of an anchor with more than ``SPLIT_ROWS`` fingerprints are not gathered: they are dealt to other tasks by the
bytes of the other half, of which one must agree.

Cases: null text is an empty text; texts without words have fingerprint zero and are linked like any other; fewer words than a shingle
make one shingle; a null id counts as larger than any other when a group's smallest id is chosen; repeated rows belong to one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from payscope.llm.common import free_name, keep, table
from payscope.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SMALL_ROWS = 64
SPLIT_ROWS = 20_000
ROWS_A_TASK = 200_000
MOST_TASKS = 10_000
HASHES_AT_ONCE = 200_000
BLOCK = 31  # the Hamming code's length in each 32-bit half
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


# -- fingerprints -----------------------------------------------------------------------------------------------

def _set_bits(hashes: list[int], owners: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` texts, how many of its hashes have each of the 64 bits set: (n, 64)."""
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    out = np.empty((n, 64))
    for j in range(8):
        seen = np.bincount(owners * 256 + octets[:, j], minlength=n * 256).reshape(n, 256)
        out[:, 8 * j: 8 * j + 8] = seen @ _BITS
    return out


def shingle_hashes(text: str | None, shingle: int, seed: int) -> Iterator[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    runs = zip(*[islice(words, k, None) for k in range(shingle)]) if len(words) > shingle else [words] * bool(words)
    digest = xxhash.xxh64_intdigest
    return (digest(s, seed) for s in map(b" ".join, runs))


def fingerprint_batch(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned fingerprints of the texts.  At most ``HASHES_AT_ONCE`` hashes are held, however long a text is."""
    n = len(texts)
    ones, totals = np.zeros((n, 64)), np.zeros(n, dtype=np.int64)
    held: list[int] = []
    counts: list[tuple[int, int]] = []

    def flush():
        if held:
            rows = np.array([i for i, _ in counts])
            owners = np.repeat(np.arange(len(rows)), [c for _, c in counts])
            np.add.at(ones, rows, _set_bits(held, owners, len(rows)))
            np.add.at(totals, rows, [c for _, c in counts])
            held.clear()
            counts.clear()

    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, shingle, seed)
        while got := list(islice(hashes, HASHES_AT_ONCE)):
            held.extend(got)
            counts.append((i, len(got)))
            if len(held) >= HASHES_AT_ONCE or len(counts) >= 1000:
                flush()
    flush()
    packed = np.packbits(2 * ones > totals[:, None], axis=1, bitorder="little")
    return packed.view("<u8").reshape(n)


def fingerprints(docs: DataFrame, text_col: str, others: list[str], shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The columns ``others`` of ``docs`` and ``fp``, the text's fingerprint as signed long."""
    fields = [docs.schema[c] for c in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = fingerprint_batch(b.column(len(others)).to_pylist(), shingle, seed) if b.num_rows else np.zeros(0, "<u8")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], [*others, "fp"])

    return docs.select(*others, text_col).mapInArrow(run, StructType([*fields, StructField("fp", LongType())]))


# -- anchors ----------------------------------------------------------------------------------------------------

def _offsets(reach: int) -> list[list[int]]:
    """By syndrome: the bit patterns of at most ``reach`` bits that lead from a half to an anchor, the home anchor's first."""
    out: list[list[int]] = [[] for _ in range(BLOCK + 1)]
    for weight in range(reach + 1):
        for places in combinations(range(1, BLOCK + 1), weight):
            syndrome = 0
            for p in places:
                syndrome ^= p
            out[syndrome].append(sum(1 << (p - 1) for p in places))
    return out


def _syndrome(half: Column) -> Column:
    """XOR of the places (from 1) of the set bits among the low 31."""
    masks = [sum(1 << (p - 1) for p in range(1, BLOCK + 1) if p >> k & 1) for k in range(5)]
    return sum((F.bit_count(half.bitwiseAND(F.lit(m))) % 2 * (1 << k) for k, m in enumerate(masks)), F.lit(0))


def anchored(classes: DataFrame, max_bits: int) -> DataFrame:
    """(anchor, home, fp): each fingerprint at every anchor within covering radius plus threshold, for both halves."""
    table_ = F.array(*[F.array(*[F.lit(x).cast("long") for x in row]) for row in _offsets(1 + max_bits // 2)])
    rows = []
    for h in range(2):
        half = F.shiftrightunsigned("fp", 32 * h).bitwiseAND(F.lit((1 << BLOCK) - 1).cast("long"))
        rows.append(classes.select("fp", half.alias("x"), _syndrome(half).alias("s"))
                    .select("fp", "x", F.posexplode(F.element_at(table_, F.col("s").cast("int") + 1)).alias("k", "flip"))
                    .select((F.col("x").bitwiseXOR(F.col("flip")) + (h << BLOCK)).alias("anchor"), (F.col("k") == 0).alias("home"), "fp"))
    return rows[0].unionByName(rows[1])


def _near(a: np.ndarray, b, max_bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= max_bits


def _forest(fps: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """A spanning forest of the links among ``fps``: each found fingerprint leaves the rest at once."""
    rest, out = np.unique(fps), []
    while rest.size > 1:
        front, rest = [rest[:1]], rest[1:]
        while front and rest.size:
            ends = front.pop()
            for x in ends:
                near = _near(rest, x, max_bits)
                if near.any():
                    found, rest = rest[near], rest[~near]
                    out.append(np.stack([np.full(found.size, x), found], axis=1))
                    front.append(found)
    return out


def _links_of_buckets(anchor: np.ndarray, home: np.ndarray, fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Links among the fingerprints that share an anchor; rows come sorted by anchor, buckets whole."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, anchor.size])
    useful = (sizes > 1) & (np.add.reduceat(home, starts) > 0)
    out = []
    for s, n in zip(starts[useful & (sizes > SMALL_ROWS)], sizes[useful & (sizes > SMALL_ROWS)]):
        out += _forest(fp[s: s + n], max_bits)
    few = useful & (sizes <= SMALL_ROWS)
    at = np.flatnonzero(np.repeat(few, sizes))
    left = np.repeat((starts + sizes)[few], sizes[few]) - at - 1  # rows of the bucket after this one
    for step in range(1, SMALL_ROWS):
        at, left = at[left >= step], left[left >= step]
        if not at.size:
            break
        other = at + step
        hit = ((home[at] + home[other]) > 0) & _near(fp[at], fp[other], max_bits)
        out.append(np.stack([fp[at[hit]], fp[other[hit]]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)


def _tasks(rows: int) -> int:
    return min(max(1, -(-rows // ROWS_A_TASK)), MOST_TASKS)


def _found(u: np.ndarray, v: np.ndarray | None, anchor: np.ndarray | None = None) -> pa.RecordBatch:
    """Links (u, v), or rows of a large anchor: fingerprint u with the anchor."""
    none = pa.nulls(len(u), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *(none if x is None else pa.array(x.view(np.int64)) for x in (v, anchor))], ["u", "v", "anchor"])


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[bool, tuple[np.ndarray, ...]]]:
    """Columns of ``batches`` (sorted by the first) cut between its values: (False, rows of whole groups).

    A group of more than ``most`` rows comes as (True, some of its rows), several times; no more than ``most`` rows and a batch are held (None: no bound).
    """
    held: list[tuple[np.ndarray, ...]] = []  # rows of the last key seen
    passing = None
    for b in batches:
        rows = tuple(c.to_numpy(zero_copy_only=False) for c in b.columns)
        if passing is not None:
            n = int(np.searchsorted(rows[0], passing, side="right"))
            if n:
                yield True, tuple(x[:n] for x in rows)
            rows = tuple(x[n:] for x in rows)
        if not len(rows[0]):
            continue
        passing = None
        held.append(rows)
        if held[0][0][0] != rows[0][-1]:
            joined = tuple(np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(joined[0], joined[0][-1]))
            sizes = np.diff(np.flatnonzero(np.r_[True, joined[0][1:cut] != joined[0][:cut - 1], True]))
            over = np.repeat(sizes > most, sizes) if most else np.zeros(cut, dtype=bool)
            yield False, tuple(x[:cut][~over] for x in joined)
            if over.any():
                yield True, tuple(x[:cut][over] for x in joined)
            held = [tuple(x[cut:] for x in joined)]
        if most and sum(len(x[0]) for x in held) > most:
            passing = held[0][0][0]
            yield True, tuple(np.concatenate(x) for x in zip(*held))
            held = []
    if held:
        yield False, tuple(np.concatenate(x) for x in zip(*held))


def _links_of_large(large: DataFrame, n: int, max_bits: int) -> DataFrame:
    """(u, v) within anchors of many rows (``n`` rows: anchor, fp), dealt by anchor and part of the other half: one part agrees in every link."""
    edges = np.linspace(0, 32, max_bits + 2).astype(int).tolist()
    other = F.when(F.shiftright("anchor", BLOCK) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit((1 << 32) - 1)))
    keys = [F.xxhash64("anchor", F.lit(k), F.shiftright("other", a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))) for k, (a, b) in enumerate(zip(edges, edges[1:]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (key, fp) in _whole_groups(batches, None):
            for part in np.split(fp.view(np.uint64), np.flatnonzero(np.diff(key)) + 1):
                for pairs in _forest(part, max_bits):
                    yield _found(pairs[:, 0].copy(), pairs[:, 1].copy())

    dealt = large.withColumn("other", other).select(F.explode(F.array(*keys)).alias("key"), "fp")
    return dealt.repartition(_tasks(n * len(keys)), "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long, anchor long").select("u", "v")


def links(classes: DataFrame, max_bits: int = MAX_BITS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(u, v): links that connect whatever fingerprints of ``classes`` (fp, distinct) lie within ``max_bits``.

    An anchor of more than ``split_rows`` fingerprints is not gathered: its rows pass on and are dealt anew by the parts of the other half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large, (anchor, home, fp) in _whole_groups(batches, split_rows):
            if large:
                yield _found(fp, None, anchor)
            elif len(anchor):
                pairs = _links_of_buckets(anchor, home.astype(np.int64), fp.view(np.uint64), max_bits)
                yield _found(pairs[:, 0].copy(), pairs[:, 1].copy())

    copies = 2 * max(map(len, _offsets(1 + max_bits // 2)))
    rows = anchored(classes, max_bits).repartition(_tasks(classes.count() * copies), "anchor").sortWithinPartitions("anchor")
    found = keep(rows.mapInArrow(run, "u long, v long, anchor long"), "simhash-links")
    few, large = found.where("anchor is null").select("u", "v"), found.where("anchor is not null").select("anchor", F.col("u").alias("fp"))
    n = large.count()
    return few.unionByName(_links_of_large(large, n, max_bits)) if n else few


# -- groups -----------------------------------------------------------------------------------------------------

def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS,
           seed: int = SEED, others: list[str] | None = None) -> DataFrame:
    """(others, id, fp, lead): ``lead`` is the group's first row, as struct (is null, id, others), equal in all its rows."""
    others = others or []
    fps = keep(fingerprints(docs, text_col, [id_col, *others], shingle, seed), "simhash-fp")
    me = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), *others)
    classes = keep(fps.groupBy("fp").agg(F.min(me).alias("lead")), "simhash-classes")
    joined = keep(connected_components(links(classes.select("fp"), max_bits)), "simhash-groups")
    leads = joined.join(classes, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("lead").alias("first"))
    labels = classes.join(joined.join(leads, "component"), F.col("fp") == F.col("node"), "left")
    labels = keep(labels.select(F.col("fp").alias("k"), F.coalesce("first", "lead").alias("lead")), "simhash-labels")
    return fps.join(labels, F.col("fp") == F.col("k")).drop("k")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id of its group)."""
    return groups(docs, id_col, text_col, **how).select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("lead.id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with one row of each near-duplicate group: that with the smallest id."""
    tie = free_name([*docs.columns, "id", "fp", "lead", "no_id"], "row_hash")
    first_id, first_tie = free_name([*docs.columns, tie], "first_id"), free_name([*docs.columns, tie], "first_tie")
    rows = docs.withColumn(tie, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    leads = groups(rows, id_col, text_col, others=[tie], **how).select(F.col("lead.id").alias(first_id), F.col(f"lead.{tie}").alias(first_tie)).distinct()
    kept = rows.join(leads, (F.col(tie) == F.col(first_tie)) & F.col(id_col).eqNullSafe(F.col(first_id)), "left_semi")
    return kept.dropDuplicates([tie, id_col]).drop(tie)


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash_groups": op6_simhash_groups}
ORACLE_SQL: dict[str, str] = {}  # XXH64 has no SQL form; tests/llm holds the brute-force comparison
