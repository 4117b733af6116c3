"""Byte-level BPE encoding and decoding, from a file of ranks.

Pre-tokens are found without regular expressions. Every code point has a
class; every class is a function from the state of a small automaton to its
next state. Composition of such functions is associative and they make up a
small closed set, so all prefixes of a batch of texts are composed by a
blocked scan over a composition table. The state before a code point and its
class tell if a pre-token begins there. The slices so found are looked up in
a cache of merged pre-tokens, and merged pair by pair where it has none.

The pre-tokens are those of the pattern
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwright.llm.common import give_back, raw, ship, slices

#: Classes of input. A blank is U+0020; "last" white space has a text
#: character after it, "more" has white space or the end. SHORT and LONG are
#: apostrophes that one or two letters of a contraction follow.
LETTER, NUMBER, OTHER, LAST_BLANK, LAST_SPACE, MORE_SPACE, SHORT, LONG, RESET = range(9)
#: States: at a start; in a run of letters, of numbers, of others; after a
#: blank that joins what follows; in white space; one or two letters of a
#: contraction to come.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_SPACE, ONE_MORE, TWO_MORE = range(8)

#: White_Space of the Unicode character database.
WHITE_SPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and if a pre-token begins at a character of this class."""
    if kind == RESET:
        return START, True
    if state in (ONE_MORE, TWO_MORE):
        return (START if state == ONE_MORE else ONE_MORE), False
    if kind in (LETTER, NUMBER):
        run = IN_LETTERS if kind == LETTER else IN_NUMBERS
        return run, state not in (run, JOINING)
    if kind in (OTHER, SHORT, LONG):
        joins = state in (IN_OTHERS, JOINING)
        return (IN_OTHERS if kind == OTHER or joins else ONE_MORE if kind == SHORT else TWO_MORE), not joins
    if kind == LAST_BLANK:
        return JOINING, True
    if kind == LAST_SPACE:
        return START, True
    return IN_SPACE, state != IN_SPACE


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions that classes generate, the index of each class's, and
    the table of their compositions."""
    base = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
    known = list(dict.fromkeys([tuple(range(8)), *base]))
    for f in known:
        for g in base:
            h = tuple(g[x] for x in f)
            if h not in known:
                known.append(h)
    place = {f: i for i, f in enumerate(known)}
    table = np.array([[place[tuple(g[x] for x in f)] for g in known] for f in known], np.int32)
    return np.array(known, np.uint8), np.array([place[f] for f in base], np.int32), table


FUNCTIONS, OF_CLASS, COMPOSED = _monoid()
BEGINS = np.array([[_step(s, k)[1] for k in range(9)] for s in range(8)], bool)


def states_before(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state before each input, by an associative scan: lanes
    are composed side by side, then lane totals by doubling."""
    n, size = len(kinds), len(FUNCTIONS)
    lanes = max(1, min(4096, int(n**0.5)))
    width = -(-n // lanes)
    padded = np.zeros(lanes * width, np.int32)
    padded[:n] = OF_CLASS[kinds]
    columns = np.ascontiguousarray(padded.reshape(lanes, width).T)
    prefix, at, flat = np.empty((width, lanes), np.int32), np.zeros(lanes, np.int32), COMPOSED.ravel()
    for j in range(width):
        prefix[j] = at
        at = flat[at * size + columns[j]]
    total, step = at, 1
    while step < lanes:
        total = np.concatenate([total[:step], flat[total[:-step] * size + total[step:]]])
        step *= 2
    entry = np.concatenate([[START], FUNCTIONS[total[:-1], START]]).astype(np.int32)
    return FUNCTIONS.ravel()[prefix * 8 + entry[None, :]].T.ravel()[:n]


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER or OTHER for each code point, MORE_SPACE for white
    space. Letters and numbers are those of the Unicode tables of the
    installed tiktoken, which keeps every character of a class given as its
    pattern and skips all others."""
    from tiktoken import Encoding

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        one = Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(one.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    out[WHITE_SPACE] = MORE_SPACE
    return out


def _classes(points: np.ndarray, resets: np.ndarray, table: np.ndarray) -> np.ndarray:
    kinds = table[points]
    kinds[resets] = RESET
    following = np.append(kinds[1:], np.uint8(RESET))
    last = (kinds == MORE_SPACE) & (following != MORE_SPACE) & (following != RESET)
    kinds[last] = LAST_SPACE
    kinds[last & (points == 0x20)] = LAST_BLANK
    marks = np.flatnonzero((points == 0x27) & (kinds != RESET))
    if len(marks):
        padded = np.append(points, np.zeros(2, points.dtype))
        ends = np.append(kinds, np.full(2, RESET, np.uint8))
        one, two = padded[marks + 1], padded[marks + 2]
        inside = ends[marks + 1] != RESET
        kinds[marks[inside & np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = one.astype(np.int64) << 32 | two
        kinds[marks[inside & (ends[marks + 2] != RESET) & np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]] = LONG
    return kinds


def pre_tokens(texts: list[str], table: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts with a byte after each, where pre-tokens
    start and end in them, and the number of pre-tokens of each text."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    resets = np.cumsum([len(t) + 1 for t in texts]) - 1
    kinds = _classes(points, resets, table)
    begins = BEGINS[states_before(kinds), kinds]
    widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    offsets = np.cumsum(widths) - widths
    first = np.flatnonzero(begins)
    real = kinds[first] != RESET
    places = offsets[first]
    ends = np.append(places[1:], len(joined))
    counts = np.diff(np.searchsorted(first[real], resets), prepend=0)
    return joined.encode(), places[real], ends[real], counts


class Vocabulary(dict):
    """Ids of pre-tokens, merged when first asked for and kept, up to
    ``most`` of them: when half as many are new, those not asked for since the
    last time go."""

    def __init__(self, ranks: dict[bytes, int], most: int = 300_000) -> None:
        self.ranks, self.most, self.old = ranks, most, {}
        self.single = [ranks[bytes([i])] for i in range(256)]
        # what two tokens make, by both their ids: a rank is an id
        halves = ((ranks.get(x[:k]), ranks.get(x[k:]), i) for x, i in ranks.items() for k in range(1, len(x)))
        self.pairs = {a << 32 | b: i for a, b, i in halves if a is not None and b is not None}

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        out = self.old.get(piece)
        if out is None:
            out = self.merge(piece)
        if len(piece) <= 64:
            if 2 * len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out

    def forget(self) -> None:
        self.old = {}
        self.clear()

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Repeatedly merge the adjacent pair of lowest rank, leftmost first."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        return self._merge_short(piece) if len(piece) <= 128 else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> tuple[int, ...]:
        get, none = self.pairs.get, 1 << 62
        ids = list(map(self.single.__getitem__, piece))
        pairs = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            ids[i : i + 2] = [best]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(best << 32 | ids[i + 1], none)
            if i:
                pairs[i - 1] = get(ids[i - 1] << 32 | best, none)
        return tuple(ids)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        right, left = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, size = heapq.heappop(queue)
            j = right[i]
            if parts[i] is None or j >= len(parts) or parts[j] is None or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            right[i] = k = right[j]
            if k < len(parts):
                left[k] = i
                if (r := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(queue, (r, i, len(parts[i]) + len(parts[k])))
            if (h := left[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(queue, (r, h, len(parts[h]) + len(parts[i])))
        return tuple(ranks[p] for p in parts if p is not None)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encode_texts(texts: list[bytes | None], words: Vocabulary, table: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Ids of all texts one after the other, and how many each has."""
    decoded = [(t or b"").decode("utf-8", "replace") for t in texts]
    data, starts, ends, counts = pre_tokens(decoded, table)
    found = list(map(words.__getitem__, [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]))
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    at = np.concatenate([[0], np.cumsum(sizes)])
    ends_of = np.cumsum(counts)
    return list(chain.from_iterable(found)), at[ends_of] - at[ends_of - counts]


def _pool(ranks: dict[bytes, int]) -> tuple[np.ndarray, bytes]:
    """Widths and bytes of all tokens, by id."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    return np.array([len(p) for p in pieces], np.int64), b"".join(pieces)


def encode(docs: DataFrame, ranks_path: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, then ids and offsets (arrays of
    int): the token ids, and for each the byte of the text's UTF-8 at which it
    begins; columns of ``docs`` with those names go. Other columns are as they
    were, nulls and repeated rows too; an empty table gives no rows.

    ``ranks_path`` is read by the driver. There are no special tokens. A null
    or empty text has no tokens. The vocabulary, of a fixed size, is
    broadcast; texts are taken whole, a batch of bounded bytes at a time."""
    ranks = read_ranks(ranks_path)
    held = ship(docs.sparkSession).sparkContext.broadcast((ranks, code_point_classes().tobytes(), _pool(ranks)[0]))
    rest = [c for c in docs.columns if c not in (text_col, "ids", "offsets")]
    source = docs.select(F.struct(*rest).alias("doc"), raw(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, table, widths = held.value
        words, table = Vocabulary(ranks), np.frombuffer(table, np.uint8)
        for batch in slices(batches, "text", 1 << 19):
            ids, counts = encode_texts(batch.column("text").to_pylist(), words, table)
            ids = np.array(ids, np.int32)
            ends = np.concatenate([[0], np.cumsum(counts)])
            width = widths[ids]
            begin = np.cumsum(width) - width
            begin -= np.repeat(begin[np.minimum(ends[:-1], max(len(begin) - 1, 0))] if len(begin) else np.zeros(len(counts), np.int64), counts)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (ids, begin)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *lists], names=["doc", "ids", "offsets"])
        # a worker stays for other tasks: what it has merged goes, and the memory with it
        words.forget()
        give_back()

    out = source.mapInArrow(run, f"doc {source.schema['doc'].dataType.simpleString()}, ids array<int>, offsets array<int>")
    return out.select(*[F.col("doc").getField(c).alias(c) for c in rest], "ids", "offsets")


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """``tokens`` (columns ids and offsets among others) with decoded, the
    bytes the ids stand for, each laid down at its offset; a column of that
    name goes. Null ids decode to no bytes. An empty table gives no rows."""
    held = ship(tokens.sparkSession).sparkContext.broadcast(_pool(read_ranks(ranks_path)))
    rest = [c for c in tokens.columns if c not in ("ids", "offsets", "decoded")]
    source = tokens.select(F.struct(*rest).alias("doc"), "ids", "offsets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths, pool = held.value
        bytes_of, first = np.frombuffer(pool, np.uint8), np.cumsum(widths) - widths
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for ids, offsets in zip(part.column("ids"), part.column("offsets")):
                    if not ids.is_valid or not len(ids):
                        out.append(b"")
                        continue
                    ids, offsets = (np.asarray(x.values) for x in (ids, offsets))
                    width = widths[ids]
                    total = int(offsets[-1] + width[-1])
                    source_at = np.repeat(first[ids] - offsets, width) + np.arange(total)
                    out.append(bytes_of[source_at].tobytes())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc", "ids", "offsets")), pa.array(out, pa.binary())], names=["doc", "ids", "offsets", "decoded"])

    out = source.mapInArrow(run, f"doc {source.schema['doc'].dataType.simpleString()}, ids array<int>, offsets array<int>, decoded binary")
    return out.select(*[F.col("doc").getField(c).alias(c) for c in rest], "ids", "offsets", "decoded")
