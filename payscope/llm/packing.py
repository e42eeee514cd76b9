"""Hierarchical multi-length packing of tokenised documents into sequences (operator 5).

*Route.* A document's full windows of the longest tier are sequences of their own; its remainder goes to the shortest tier that holds it.
*Pack.* From the longest tier down, each remainder opens a window of its tier.  *Fill.* The gap takes the longest fitting remainders of
the shorter tiers; a gap that none fits takes the head of a shorter (else of an equal) one, whose tail is routed anew.  So all
windows but a block's last are full; the last is cut into powers of two, which need no padding.
*Balance.* Each tier's windows are dealt to step groups of equal token counts in descending attention cost (sum of squared piece lengths),
back and forth, so that groups cost about the same.

A task packs blocks of about ``BLOCK_TOKENS`` tokens of its own rows, so nothing is shuffled and memory is bounded by a block
plus one text; a text of any length gives its full windows first.  Sequence ids hold the partition number and a counter:
a task that runs again gives the same rows.

Cases: null and empty texts are one end token; repeated rows are packed each (``doc_row`` tells them apart); an empty table
gives an empty result.  Texts are never cut before tokenising.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StructField, StructType

from payscope.llm.common import table

TIERS = (2048, 1024, 512, 256)
END_ID = 1
BLOCK_TOKENS = 1 << 21
STEP_TOKENS = 1 << 17
MEMO_WORDS = 600_000
MEMO_CHARS = 48
CHARS_AT_ONCE = 1 << 20


# -- tokenising -------------------------------------------------------------------------------------------------

class WordEncoder:
    """Token ids of texts by a public tokenizer whose pre-tokens never cross white space.

    White space is dropped by the tokenizer, so a text's ids are those of its pieces between blanks in a row; the ids of short
    pieces are remembered.  New plain words (Latin letters only) are encoded many at a time, in lower case and without the
    normalizer, which does nothing else to them: each word ends with the one token that has the end-of-word mark.
    """

    LATIN = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
    MARKS = frozenset(".,;:!?")
    #: Characters that Python and the tokenizer may class differently as white space.
    ODD_SPACE = re.compile("[" + "".join(map(chr, (0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))) + "]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {"": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        for at in range(0, len(words), 500):
            part = words[at: at + 500]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(part):
                whole = ids.tobytes()
                self.memo.update(zip(part, [whole[i:j] for i, j in zip([0, *stops], stops)]))
            else:
                self.memo.update(zip(part, self._encode(part)))

    def _learn(self, pieces: set[str]) -> None:
        memo, plain, odd, words, marks = self.memo, [], [], set(), set()
        for p in pieces:
            word, mark = (p[:-1], p[-1]) if p[-1] in self.MARKS else (p, "")
            if word.isalpha() and (word.isascii() or self.LATIN.fullmatch(word)):
                word = word.lower()
                words.add(word)
                marks.add(mark)
                plain.append((p, word, mark))
            else:
                odd.append(p)
        self._learn_words([w for w in words if w not in memo])
        odd += [m for m in marks if m and m not in memo]
        memo.update(zip(odd, self._encode(odd)))
        memo.update([(p, memo[w] + memo[m] if m else memo[w]) for p, w, m in plain])

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [(re.split("[ \t\n\r]+", t) if self.ODD_SPACE.search(t) else t.split()) if t else [] for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo = {"": b""}
        new = set().union(*split).difference(self.memo)
        self._learn(new)
        find = self.memo.__getitem__
        out = [b"".join(map(find, pieces)) for pieces in split]
        for p in new:
            if len(p) > MEMO_CHARS:
                del self.memo[p]
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker, kept between its tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# -- packing a block --------------------------------------------------------------------------------------------

class Pool:
    """Remainders (length, document, start) of one block, ordered by length."""

    def __init__(self, items: list[tuple[int, int, int]]):
        self.items = sorted(items)

    def take_within(self, room: int) -> tuple[int, int, int] | None:
        """The longest item of at most ``room`` tokens."""
        i = bisect_right(self.items, (room, float("inf"), 0))
        return self.items.pop(i - 1) if i else None

    def take_longest(self) -> tuple[int, int, int]:
        return self.items.pop()

    def take_over(self, room: int) -> tuple[int, int, int] | None:
        """The shortest item of more than ``room`` tokens."""
        i = bisect_left(self.items, (room + 1, -1, 0))
        return self.items.pop(i) if i < len(self.items) else None

    def put(self, item: tuple[int, int, int]) -> None:
        insort(self.items, item)


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (tier, [(document, start, length), ...]) that hold every token of the documents once."""
    top, out, rest = tiers[0], [], []
    for d, n in enumerate(lengths):
        out += [(top, [(d, s, top)]) for s in range(0, n - n % top, top)]
        if n % top:
            rest.append((n % top, d, n - n % top))
    pool = Pool(rest)
    while pool.items:
        n, d, s = pool.take_longest()
        tier = min(t for t in tiers if t >= n)
        pieces, room = [(d, s, n)], tier - n
        while room and pool.items:
            if got := pool.take_within(room):
                pieces.append((got[1], got[2], got[0]))
                room -= got[0]
            else:
                n, d, s = pool.take_over(room)
                pieces.append((d, s, room))
                pool.put((n - room, d, s + room))
                room = 0
        if not room:
            out.append((tier, pieces))
            continue
        # the block's last window: powers of two from its pieces in a row
        size, now = tier // 2, []
        while size:
            if tier - room >= size:
                room += size
                need, now = size, []
                while need:
                    d, s, n = pieces.pop(0)
                    now.append((d, s, min(n, need)))
                    if n > need:
                        pieces.insert(0, (d, s + need, n - need))
                    need -= min(n, need)
                out.append((size, now))
            size //= 2
    return out


def step_groups(sequences: list[tuple[int, list[tuple[int, int, int]]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group number for each sequence: groups hold one tier, about ``step_tokens`` tokens, and balanced attention cost."""
    out, used = [0] * len(sequences), 0
    for tier in sorted({t for t, _ in sequences}, reverse=True):
        cost = sorted(((-sum(n * n for _, _, n in p), i) for i, (t, p) in enumerate(sequences) if t == tier))
        groups = -(-len(cost) * tier // step_tokens)
        for k, (_, i) in enumerate(cost):
            turn, place = divmod(k, groups)
            out[i] = used + (groups - 1 - place if turn % 2 else place)
        used += groups
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
         tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id, doc_row.

    ``tiers`` are powers of two, longest first; ``tokenizer`` is the path of the tokenizer's file on the workers.
    """
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id", "doc_row"]
    id_field = docs.schema[id_col]
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 40
        counters = {"sequence": base, "step": base, "row": base}
        block: list[tuple[object, bytes]] = []
        held = 0

        def packed() -> pa.RecordBatch:
            sequences = pack_lengths([len(x) // 4 for _, x in block], tiers)
            groups = step_groups(sequences)
            ids, cols = [], [[] for _ in names]
            for k, (tier, pieces) in enumerate(sequences):
                offset = 0
                for d, start, n in pieces:
                    x = block[d][1]
                    ids.append(block[d][0])
                    row = (start, n, zlib.crc32(memoryview(x)[4 * start: 4 * (start + n)]), len(x) // 4, counters["sequence"] + k, offset,
                           tier, counters["step"] + groups[k], counters["row"] + d)
                    for c, v in zip(cols, row):
                        c.append(v)
                    offset += n
            counters["sequence"] += len(sequences)
            counters["step"] += max(groups, default=-1) + 1
            counters["row"] += len(block)
            block.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, type=id_type), *[pa.array(c, pa.int64()) for c in cols]], [id_col, *names])

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            at = 0
            while at < b.num_rows:
                texts, chars = [], 0
                while at + len(texts) < b.num_rows and chars < CHARS_AT_ONCE:
                    texts.append(b.column(1)[at + len(texts)].as_py())
                    chars += len(texts[-1] or "")
                for i, x in zip(b.column(0).slice(at, len(texts)).to_pylist(), own.ids(texts)):
                    block.append((i, x + end))
                    held += len(x) // 4 + 1
                at += len(texts)
                if held >= block_tokens:
                    yield packed()
                    held = 0
        if block:
            yield packed()

    schema = StructType([StructField(id_col, id_field.dataType), *[StructField(n, LongType()) for n in names]])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op5_pack_sequences": op5_pack_sequences}
ORACLE_SQL: dict[str, str] = {}  # tokenizers has no SQL form; tests/llm holds the exact round trip
