"""Best-fit packing of token pieces, improved by swaps between underfull bins.

Texts become token ids (a byte-level BPE, one end id after every text).  A document of at
most ``capacity`` ids stays whole; a longer one is cut into pieces of ``capacity`` ids, the
rest of the division being its first piece.  Pieces go into bins of ``capacity`` ids:

1. best-fit decreasing inside blocks of at most ``BLOCK`` pieces;
2. local search among the bins of a block that are not full: a fuller bin gains ids from an
   emptier one by taking one piece (move), by exchanging one piece for one, two for one or
   one for two, the largest gain first and the emptiest giver first.  A gain raises the sum
   of squared fills, so the search ends, when no such step is left; bins that ran empty go;
3. bins that are still underfull are dealt anew into blocks, with all others of their kind,
   and searched again, until one block held them all or a round saved nothing.

Blocks are runs of rows inside a task, so nothing is shuffled by a key: a document id or a
text that a third of all rows share spreads like any other.  A bin is one row until the last
step, which numbers its pieces and emits them.

Null texts count as empty and give one piece, the end id; so do empty ones.  Rows with equal
or null ids are documents of their own; ties go to the row read first; a text may be as long
as a row may be; an empty table gives an empty result.  Columns other than the id and the text are not read.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Pieces of one block: what a task packs at once.
BLOCK = 16_384
#: Words whose ids a Python worker keeps, and characters of text it splits at once.
CACHE_WORDS = 750_000
CHUNK_CHARS = 1 << 20

#: Classes of the pre-tokeniser's pattern below U+0250: letters, numbers, white space.
_LATIN = 0x250
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", " \\t\\n\\r\\f\\v\\x85\\xa0"

_ITEM = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
_BINS = f"bin bigint, fill int, items array<{_ITEM}>, offsets array<bigint>"


def _byte_alphabet() -> dict[int, str]:
    """The letter of every byte in a byte-level BPE: itself if printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Ids of words as bytes, encoded when they are first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.encode(word)
        return ids


class TokenBytes:
    """Token ids of texts as little-endian unsigned 32-bit bytes.  A byte-level BPE with this
    pre-tokeniser never merges across its words, so ids of words that were seen before are
    looked up.  Texts in Latin letters are split by the same pattern with its classes written
    out, which ``re`` does faster.  Encoded whole are texts that hold an added token, or a
    character that a pattern does not class as the tokenizer does (each character is held
    against the tokenizer's own pre-tokeniser when it is first met)."""

    def __init__(self, vocabulary: str):
        import os

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.latin = re.compile(f" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
        self.beyond = re.compile(f"[^\\x00-{chr(_LATIN - 1)}]").search
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.alphabet = self.tokenizer.model, _byte_alphabet()
        self.known = _Known(self._word if self._is_byte_level() else self._encode)
        self.met, self.odd = np.zeros((2, sys.maxunicode + 1), bool)  # by code point

    def _odd_in(self, texts: list[str]) -> list[str]:
        """The characters of some texts that a pattern classes otherwise than the tokenizer."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        for p in np.unique(points[~self.met[points]]).tolist():
            probe = f"a{chr(p)}1 "
            want = [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
            patterns = [self.pattern, self.latin] if p < _LATIN else [self.pattern]
            self.odd[p] = any([m.span() for m in x.finditer(probe)] != want for x in patterns)
            self.met[p] = True
        return [chr(p) for p in np.unique(points[self.odd[points]])]

    def _encode(self, text: str) -> bytes:
        ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _is_byte_level(self) -> bool:
        """Whether words reach the model as :func:`_byte_alphabet` says, held against the
        tokenizer with a character of every byte that UTF-8 has."""
        probe = "".join(map(chr, [*range(1, 0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x10FFFF, 0x1000)]))
        if self.tokenizer.normalizer is not None or self.tokenizer.pre_tokenizer is None:
            return False
        return "".join(w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)) == self._letters(probe)

    def _letters(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.alphabet)

    def _word(self, word: str) -> bytes:
        """A word of the pre-tokeniser, straight by the merges: half the time of a whole encoding."""
        ids = array("I", [t.id for t in self.model.tokenize(self._letters(word))])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _part(self, texts: list[str]) -> list[bytes]:
        rare = [*self.added, *self._odd_in(texts)]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, out = self.known.__getitem__, []
        for t in texts:
            if any(a in t for a in rare):
                out.append(self._encode(t))
            else:
                out.append(b"".join(map(known, (self.pattern if self.beyond(t) else self.latin).findall(t))))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= CHUNK_CHARS:
                out += self._part(part)
                part, size = [], 0
        return out + self._part(part)


@lru_cache(maxsize=1)
def token_bytes(vocabulary: str) -> TokenBytes:
    """The encoder of this Python worker, whose known words serve its later tasks too."""
    return TokenBytes(vocabulary)


def piece_spans(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece from 0, start, length, ids_crc32 of every piece of every document."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        encode = token_bytes(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            row, piece, start, length, crc = [], [], [], [], []
            for i, b in enumerate(encode(texts)):
                view = memoryview(b + end)
                for k, (s, n) in enumerate(piece_spans(len(view) // 4, capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(view[4 * s:4 * (s + n)]))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return read.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class _Stacks:
    """Bins by key (a length, or a sum of two), and a bit mask of the keys that have any."""

    def __init__(self):
        self.at: dict[int, set[int]] = {}
        self.mask = 0

    def add(self, key: int, b: int) -> None:
        self.at.setdefault(key, set()).add(b)
        self.mask |= 1 << key

    def remove(self, key: int, b: int) -> None:
        bins = self.at[key]
        bins.discard(b)
        if not bins:
            del self.at[key]
            self.mask ^= 1 << key


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    mask = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room - n:
            by_room.setdefault(room - n, []).append(b)
            mask |= 1 << (room - n)
    return bins


def _pair_sums(lengths: list[int], capacity: int) -> dict[int, tuple[int, int]]:
    """Sums of two items of a bin (up to the capacity), each with two lengths that make it."""
    distinct = sorted(set(lengths))
    twice = {x for x in distinct if lengths.count(x) > 1}
    out = {}
    for i, x in enumerate(distinct):
        for y in distinct[i if x in twice else i + 1:]:
            if x + y <= capacity:
                out.setdefault(x + y, (x, y))
    return out


def swap_search(bins: list[list[int]], lengths, capacity: int) -> list[list[int]]:
    """Bins after local search (item numbers, empty bins left out); full bins stay as they are."""
    held = [{} for _ in bins]  # length -> item numbers
    for b, items in enumerate(bins):
        for i in items:
            held[b].setdefault(int(lengths[i]), []).append(i)
    flat = [[n for n, items in h.items() for _ in items] for h in held]
    fill = [sum(f) for f in flat]
    open_ = [b for b in range(len(bins)) if 0 < fill[b] < capacity]
    improved = True
    while improved:
        improved = False
        open_ = sorted((b for b in open_ if 0 < fill[b] < capacity), key=lambda b: (-fill[b], b))  # sorted: a heap
        single, double = _Stacks(), _Stacks()
        pairs: dict[int, dict] = {}

        def enter(b):
            for n in set(flat[b]):
                single.add(n, b)
            pairs[b] = _pair_sums(flat[b], capacity)
            for n in pairs[b]:
                double.add(n, b)

        def leave(b):
            for n in set(flat[b]):
                single.remove(n, b)
            for n in pairs.pop(b):
                double.remove(n, b)

        def shift(src, dst, sizes):
            for n in sizes:
                items = held[src][n]
                held[dst].setdefault(n, []).append(items.pop())
                if not items:
                    del held[src][n]
                flat[src].remove(n)
                flat[dst].append(n)
                fill[src] -= n
                fill[dst] += n

        for b in open_:
            enter(b)
        # the fullest bin left takes from the others, which hold at most as much
        turn = [(-fill[b], b) for b in open_]
        while turn:
            left, a = heapq.heappop(turn)
            if a not in pairs or -left != fill[a]:
                continue
            leave(a)
            while 0 < fill[a] < capacity:
                room = capacity - fill[a]
                window = (1 << room) - 1
                best = (0, None, None)
                gives = {0: ()} | {n: (n,) for n in set(flat[a])}
                for give, sizes in (gives | {s: p for s, p in _pair_sums(flat[a], capacity).items() if s not in gives}).items():
                    # two pieces are given for one only, and one piece for one or two
                    for stacks in (single, double) if len(sizes) == 1 else (single,):
                        hit = ((stacks.mask >> (give + 1)) & window).bit_length()
                        if hit > best[0]:
                            best = (hit, sizes, (stacks, give + hit))
                gain, sizes, found = best
                if not gain:
                    break
                stacks, want = found
                b = min(stacks.at[want], key=lambda x: (fill[x], x))
                take = (want,) if stacks is single else pairs[b][want]
                leave(b)
                shift(b, a, take)
                shift(a, b, sizes)
                if fill[b]:
                    enter(b)
                    heapq.heappush(turn, (-fill[b], b))
                improved = True
    out = [[i for items in h.values() for i in items] for h in held]
    return [b for b in out if b]


def _packed(rows, capacity: int, block: int, fresh: bool):
    """Arrow batches of bins (bin, fill, items) from Arrow batches of bins or of pieces."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0

    def emit(items: pa.StructArray, bins: list[list[int]], lengths: np.ndarray):
        nonlocal made
        order = np.concatenate([np.asarray(b, np.int64) for b in bins]) if bins else np.zeros(0, np.int64)
        at = np.concatenate([[0], np.cumsum([len(b) for b in bins], dtype=np.int64)])
        total = np.concatenate([[0], np.cumsum(lengths[order])])
        ids = (part << 32) + np.arange(made, made + len(bins))
        made += len(bins)
        at32 = pa.array(at.astype(np.int32))
        offsets = total[:-1] - np.repeat(total[at[:-1]], np.diff(at))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids.astype(np.int64)), pa.array((total[at[1:]] - total[at[:-1]]).astype(np.int32)),
             pa.ListArray.from_arrays(at32, items.take(pa.array(order))), pa.ListArray.from_arrays(at32, pa.array(offsets))],
            ["bin", "fill", "items", "offsets"])

    def solve(held: list):
        items = pa.concat_arrays([i for i, _ in held])
        lengths = items.field("length").to_numpy(zero_copy_only=False).astype(np.int64)
        if fresh:
            bins = best_fit_decreasing(lengths.tolist(), capacity)
        else:
            sizes = np.concatenate([s for _, s in held])
            ends = np.cumsum(sizes)
            bins = [list(range(e - s, e)) for s, e in zip(sizes.tolist(), ends.tolist())]
        return emit(items, swap_search(bins, lengths, capacity), lengths)

    held, n = [], 0
    for batch in rows:
        if not batch.num_rows:
            continue
        if fresh:
            items, sizes = batch.to_struct_array(), np.ones(batch.num_rows, np.int64)
        else:
            column = batch.column(0)
            items, sizes = column.flatten(), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begin, ends = 0, np.cumsum(sizes)
        while begin < len(sizes):  # whole bins up to the block's size, one at least
            done = int(ends[begin - 1]) if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + block - n, "right")))
            held.append((items.slice(done, int(ends[stop - 1]) - done), sizes[begin:stop]))
            n += int(ends[stop - 1]) - done
            begin = stop
            if n >= block or begin < len(sizes):
                yield solve(held)
                held, n = [], 0
    if held:
        yield solve(held)


def first_bins(cut: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Bins of pieces: best fit, then local search, block by block."""
    return cut.select("doc_id", "piece", "start", "length", "ids_crc32").mapInArrow(lambda rows: _packed(rows, capacity, block, True), _BINS)


def improved_bins(bins: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Bins after another local search among those that share a block."""
    return bins.select("items").mapInArrow(lambda rows: _packed(rows, capacity, block, False), _BINS)


def pack(cut: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """``cut`` (from :func:`pieces`, best read from a written table) with sequence_id and offset."""
    scratch = scratch or Scratch(cut.sparkSession, "swap-pack")
    closed, rounds = [], 0
    bins = scratch.write(first_bins(cut, capacity, block), "bins0")
    while True:
        whole = bins.where(F.col("fill") == capacity)
        left = bins.where(F.col("fill") < capacity)
        # a step of two counts reaches the driver, never the bins
        n, held = left.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
        closed.append(whole.withColumn("round", F.lit(rounds)))
        blocks = -(-held // block)
        if not n or (rounds and (before_blocks == 1 or n >= before)):
            closed.append(left.withColumn("round", F.lit(rounds)))
            break
        before, before_blocks, rounds = n, blocks, rounds + 1
        bins = scratch.write(improved_bins(left.select("items").repartition(blocks), capacity, block), f"bins{rounds}")
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    # bins are numbered per round and task, so a round's numbers leave room for the next's
    sequence = F.col("bin") * (rounds + 1) + F.col("round")
    placed = out.select(sequence.alias("sequence_id"), F.explode(F.arrays_zip("items", "offsets")).alias("x"))
    return placed.select("x.items.*", "sequence_id", F.col("x.offsets").alias("offset"))


def op13_swap_packing(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "swap-pack")
    return pack(scratch.write(pieces(table(spark, sf_dir, "documents")), "pieces"), scratch=scratch)


QUERIES = {"op13_swap_packing": op13_swap_packing}
ORACLE = {}
