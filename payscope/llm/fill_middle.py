"""Fill-in-the-middle rewriting of whole texts (operator 11).

*Boundary set.* The byte offsets at which a unit of a text's UTF-8 begins, and its end, are one sorted set of integers, held
as 65,536-wide containers: a run container where the offsets come in few runs (ASCII is one), an array where there are few of
them, else a bitmap.  Cumulative cardinalities, over containers and inside runs and bitmaps, turn "the offset of boundary k"
into a binary search for the container and a select inside it.

*Cuts.* Four 32-bit draws come from the SHA-256 of ``seed:id``: two boundary numbers, the share left plain and the order of the
parts.  Both offsets come from the set; the text is cut there as bytes and written with the sentinels, as prefix, suffix,
middle (``psm``) or suffix, prefix, middle (``spm``).  ``restore`` gives the text back.

Nothing is shuffled; a task holds one text's mask at a time, so that a text of any length works.

Cases: null and empty texts, texts that hold a sentinel, and the share that is not drawn stay as they are (``plain``, null
counts, offsets null); a null id draws as ``seed:null``; equal ids draw alike for texts of the same length; an empty table gives
an empty result; columns of ``docs`` other than id and text are left out, so names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from payscope.llm.common import let, table, text_or_empty

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix, middle
SEED = "1"
FIM_PERCENT = 90
SPM_PERCENT = 20
SPAN = 1 << 16
ARRAY_MOST = 4096  # beyond it a bitmap of SPAN bits is smaller than two bytes an offset
OUT_BYTES = 1 << 26

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# -- the set ------------------------------------------------------------------------------------------------------

class ArrayContainer:
    """Few offsets: themselves, two bytes each."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class RunContainer:
    """Few runs: first offset of each, and the offsets up to each run's end."""

    def __init__(self, first: np.ndarray, length: np.ndarray):
        self.first, self.upto = first, np.cumsum(length)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.upto, k, side="right"))
        return int(self.first[run]) + k - (int(self.upto[run - 1]) if run else 0)


class BitmapContainer:
    """One bit an offset in 64-bit words, and the ones up to each word's end."""

    def __init__(self, mask: np.ndarray):
        bits = np.packbits(mask, bitorder="little")
        self.words = np.pad(bits, (0, -len(bits) % 8)).view("<u8")
        self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.upto, k, side="right"))
        word = int(self.words[at])
        for _ in range(k - (int(self.upto[at - 1]) if at else 0)):
            word &= word - 1
        return at * 64 + (word & -word).bit_length() - 1


def container(mask: np.ndarray) -> ArrayContainer | RunContainer | BitmapContainer:
    """The smallest container of the set positions of ``mask`` (at most SPAN long, at least one set)."""
    edge = np.flatnonzero(np.diff(mask))  # last position before each change
    runs = (len(edge) + int(mask[0]) + int(mask[-1])) // 2
    n = int(np.count_nonzero(mask))
    if 4 * runs <= min(2 * n, SPAN // 8):
        first = np.append(0, edge + 1)[(0 if mask[0] else 1)::2]
        last = np.append(edge, len(mask) - 1)[(0 if mask[0] else 1)::2]
        return RunContainer(first, last - first + 1)
    return ArrayContainer(np.flatnonzero(mask)) if n <= ARRAY_MOST else BitmapContainer(mask)


class BoundarySet:
    """A sorted set of offsets with rank selection."""

    def __init__(self, mask: np.ndarray):
        """``mask[i]``: offset i is a boundary."""
        self.keys, self.containers, upto, total = [], [], [], 0
        for key in range(0, len(mask), SPAN):
            part = mask[key: key + SPAN]
            if n := int(np.count_nonzero(part)):
                total += n
                self.keys.append(key)
                self.containers.append(container(part))
                upto.append(total)
        self.upto = np.array(upto, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        """The offset with ``k`` smaller ones in the set."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.upto, k, side="right"))
        return self.keys[at] + self.containers[at].select(k - (int(self.upto[at - 1]) if at else 0))


def boundaries(utf8: bytes, unit: str = "character") -> BoundarySet:
    """Where units begin in ``utf8``, and its end: n + 1 offsets for n units.

    ``character``: code points.  ``word``: words of non-space, each with the space after it (the first with that before it too).
    """
    a = np.frombuffer(utf8, np.uint8)
    mask = np.ones(len(a) + 1, bool)
    if unit == "character":
        np.not_equal(a & 0xC0, 0x80, out=mask[:-1])
    elif unit == "word":
        space = _SPACE[a]
        np.logical_and(~space[1:], space[:-1], out=mask[1:-1])
    else:
        raise ValueError(f"unit: {unit}")
    if len(a):
        mask[0] = True
    return BoundarySet(mask)


# -- the rewriting ------------------------------------------------------------------------------------------------

def draws(seed: str, key: object) -> list[int]:
    """Four 32-bit numbers of ``seed:key``."""
    h = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    return [int(h[i: i + 8], 16) for i in range(0, 32, 8)]


def rewrite(utf8: bytes, h: list[int], unit: str, fim_percent: int, spm_percent: int, marks: list[bytes]) -> tuple:
    """(n, form, prefix units, middle units, offset of the middle, offset of the suffix, output)."""
    places = boundaries(utf8, unit)
    n = len(places) - 1
    if not n or h[2] % 100 >= fim_percent or any(m in utf8 for m in marks):
        return n, "plain", None, None, None, None, utf8
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = places.select(lo), places.select(hi)
    p, s, m = marks
    if h[3] % 100 < spm_percent:
        return n, "spm", lo, hi - lo, a, b, b"".join((s, utf8[b:], p, utf8[:a], m, utf8[a:b]))
    return n, "psm", lo, hi - lo, a, b, b"".join((p, utf8[:a], s, utf8[b:], m, utf8[a:b]))


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "character", seed: str = SEED,
                fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per document: id, n (units), form, prefix_units, middle_units, middle_at, suffix_at (byte offsets), output."""
    names = ["n", "form", "prefix_units", "middle_units", "middle_at", "suffix_at", "output"]
    types = [pa.int64(), pa.string(), *[pa.int64()] * 4]
    marks = [x.encode() for x in sentinels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0

        def filled(id_type: pa.DataType) -> pa.RecordBatch:
            *cols, outputs = zip(*rows)
            # outputs are joined from valid pieces: no second look at their UTF-8
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *[pa.array(c, t) for c, t in zip(cols, types)],
                                               pa.array(outputs, pa.binary()).cast(pa.string(), safe=False)], [id_col, *names])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                rows.append(rewrite(text.as_py(), draws(seed, key), unit, fim_percent, spm_percent, marks))
                ids.append(key)
                held += len(rows[-1][-1])
                if held >= OUT_BYTES:
                    yield filled(b.schema.field(0).type)
                    ids, rows, held = [], [], 0
            if rows:
                yield filled(b.schema.field(0).type)
                ids, rows, held = [], [], 0

    schema = StructType([StructField(id_col, docs.schema[id_col].dataType),
                         *[StructField(n, StringType() if n in ("form", "output") else LongType()) for n in names]])
    return docs.select(id_col, text_or_empty(text_col).cast("binary")).mapInArrow(run, schema)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text of an output: its parts hold no sentinel, so they split at the three of them."""
    at_any = "|".join(rf"\Q{x}\E" for x in sentinels)
    order = F.when(form == "psm", F.array(*map(F.lit, (1, 3, 2)))).otherwise(F.array(*map(F.lit, (2, 3, 1))))
    joined = let(F.split(output, at_any, -1), lambda parts: F.concat(*[F.get(parts, order[i]) for i in range(3)]))
    return F.when(form == "plain", output).otherwise(joined)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
                       F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES = {"op11_fill_middle": op11_fill_middle}
ORACLE_SQL = {"op11_fill_middle": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, {', '.join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM d),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {FIM_PERCENT} THEN 'plain'
                     WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form,
             least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi FROM h),
p AS (SELECT *, substring(t, 1, lo) AS pre, substring(t, lo + 1, hi - lo) AS mid, substring(t, hi + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid)
                        ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""}
