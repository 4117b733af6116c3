"""Quality rules and an n-gram perplexity filter.

For each language character n-gram models with modified Kneser-Ney smoothing
are estimated from all of its documents: one from each half of them, dealt by
a hash of the text. A document is scored by the model of the half that it, and
every copy of it, is not in, so that no text vouches for itself. Spark counts
the n-grams of bytes over 235 symbols. A model is a sorted array of n-grams for
each order beside arrays of log probability and back-off.
Languages are taken in groups whose n-grams together stay under a limit, one
group after the other. A language beyond the limit is taken in ranges of
n-grams that share their beginnings: each range has its part of the highest
order and the orders below it whole, and a text's score is the sum over the
ranges. So the driver and the workers hold at a time the models of a group or
of a range: its n-grams of the highest order are under the limit, those below
it at most 235^(order - 1) for each half.

A document is rejected if the base rules fail it or its perplexity leaves its
language's band. Bands lie a number of robust standard deviations around the
median log perplexity of the language's documents that pass the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwright.llm.common import checked_broadcast, durable, raw, ship, slices

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))


def _alphabet() -> np.ndarray:
    """Symbol of each byte: its own, but for two classes. Digits are one symbol,
    as are the 14 ASCII marks that are no punctuation: figures and strewn marks
    are then known by their places, not by which of them they are."""
    table = np.full(256, 255, np.uint8)
    classes = (b"0123456789", b"#$%&*+<=>@\\^|~")
    for symbol, chars in enumerate(classes):
        table[list(chars)] = symbol
    alone = np.setdiff1d(np.arange(256), list(b"".join(classes)))
    table[alone] = np.arange(len(classes), len(classes) + len(alone))
    return table


#: Of the bytes, and one before a text.
ALPHABET = _alphabet()
SYMBOLS = int(ALPHABET.max()) + 2
START = SYMBOLS - 1


def _folded() -> np.ndarray:
    """A coarse alphabet of 49 symbols, for callers of the model alone; ``judge``
    does not use it. Letters without case 0-25, digit 26, blank 27, line end 28,
    five kinds of punctuation, other ASCII, control; of bytes beyond ASCII eight
    kinds that continue a character, and four that begin one, by their last
    bits; 48 before a text."""
    table = np.full(256, 34, np.uint8)
    for i in range(26):
        table[65 + i] = table[97 + i] = i
    table[:32], table[127] = 35, 35
    for chars, symbol in ((b"0123456789", 26), (b" \t", 27), (b"\n\r\x0b\x0c", 28), (b".!?", 29), (b",;:", 30), (b"'\"`", 31), (b"()[]{}", 32), (b"-_/", 33)):
        table[list(chars)] = symbol
    beyond = np.arange(0x80, 0x100)
    table[beyond] = np.where(beyond < 0xC0, 36 + (beyond & 7), 44 + (beyond & 3))
    return table


FOLDED = _folded()


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _SPACE + _CONTINUATION))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    repeated = 0
    if n > 3:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        with np.errstate(over="ignore"):
            windows = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def _codes(texts: list[bytes | None], order: int, alphabet: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that end at each byte, after order - 1 start
    symbols, text after text; and the texts' lengths in bytes. The start symbol
    is the one after the alphabet's last."""
    start = int(alphabet.max()) + 1
    if (start + 1) ** order > 1 << 63:
        raise ValueError(f"n-grams of order {order} do not fit 63 bits")
    kind = np.uint32 if (start + 1) ** order <= 1 << 32 else np.uint64
    lengths = np.array([len(t or b"") for t in texts])
    pad = bytes([0]) * (order - 1)
    joined = np.frombuffer(b"".join([pad + (t or b"") for t in texts]), np.uint8)
    symbols = alphabet[joined].astype(kind)
    ends = np.cumsum(lengths + order - 1)
    first = ends - lengths - (order - 1)
    for k in range(order - 1):
        symbols[first + k] = start
    total = np.zeros(len(symbols), kind)
    for k in range(order - 1, -1, -1):
        total *= kind(start + 1)
        total[k:] += symbols[: len(symbols) - k] if k else symbols
    real = np.ones(len(symbols), bool)
    for k in range(order - 1):
        real[first + k] = False
    return total[real], lengths


def _places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes in order, the place of each in a table, and the place
    in it of every code: a table over the pairs of halves that occur where it
    is small, else one of the distinct codes."""
    if codes.dtype == np.uint32:
        halves = codes >> np.uint32(16), codes & np.uint32(0xFFFF)
        there = [np.flatnonzero(np.bincount(h, minlength=1)) for h in halves]
        wide = len(there[1])
        if len(there[0]) * wide <= 1 << 23:
            ranks = []
            for at in there:
                ranks.append(np.zeros(at[-1] + 1, np.uint32))
                ranks[-1][at] = np.arange(len(at))
            where = ranks[0][halves[0]] * np.uint32(wide) + ranks[1][halves[1]]
            places = np.flatnonzero(np.bincount(where))
            return there[0][places // wide] << 16 | there[1][places % wide], places, where
    distinct, where = np.unique(codes, return_inverse=True)
    return distinct.astype(np.int64), np.arange(len(distinct)), where


def _lang_and_half(lang_col: str, text_col: str, other: bool = False) -> tuple[Column, Column]:
    """The language, empty for null, and a mark of the text's half, or of the
    other one."""
    half = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(2))
    mark = F.when(half == (1 if other else 0), F.lit("/0")).otherwise(F.lit("/1"))
    return F.coalesce(F.col(lang_col).cast("string"), F.lit("")), mark


def ngram_counts(docs: DataFrame, order: int, lang_col: str, text_col: str) -> DataFrame:
    """(lang, code, n) over all texts; lang ends with the mark of a half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                code, n = np.unique(_codes([t for t, x in zip(texts, langs) if x == lang], order, ALPHABET)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    lang, half = _lang_and_half(lang_col, text_col)
    source = docs.select(F.concat(lang, half).alias("lang"), raw(text_col).alias("text"))
    return source.mapInArrow(run, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class KneserNey:
    """Modified Kneser-Ney over symbol n-grams. ``tables[k]`` has, for order
    k + 1, sorted n-grams, log10 probabilities, and for the n-gram as a
    context the log10 back-off weight.

    ``codes`` are sorted. Where they are a range of the n-grams, with all that
    share a context, ``below`` has the codes and counts of the order below and
    ``of`` the numbers of n-grams that occur once, twice, three and four times,
    both from all n-grams; the model then holds for that range."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, symbols: int = 49, below: tuple[np.ndarray, np.ndarray] | None = None, of: np.ndarray | None = None) -> None:
        self.order, self.symbols, self.tables = order, symbols, []
        self._kind = np.uint32 if symbols**order <= 1 << 32 else np.int64
        levels = [(codes.astype(np.int64), counts.astype(np.int64))]
        if below is not None:
            levels.insert(0, (below[0].astype(np.int64), below[1].astype(np.int64)))
        for k in range(order - len(levels), 0, -1):
            # lower orders count the distinct symbols seen before
            longer = levels[0][0]
            levels.insert(0, np.unique(longer % symbols**k, return_counts=True))
        top_of = of
        lower: tuple[np.ndarray, np.ndarray] | None = None
        for k, (code, n) in enumerate(levels):
            of = np.bincount(np.minimum(n, 5), minlength=5)[1:5].astype(float) if k + 1 < order or top_of is None else np.asarray(top_of, float)
            y = of[0] / (of[0] + 2 * of[1]) if of[0] + of[1] else 0.5
            cut = np.array([0.0] + [min(max(j - (j + 1) * y * of[j] / of[j - 1] if of[j - 1] else 0.5, 0.05), j - 0.05) for j in (1, 2, 3)])
            context = code // symbols
            starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])[: len(code)])
            sizes = np.diff(np.append(starts, len(code)))
            total, taken = np.add.reduceat(n, starts).astype(float), np.add.reduceat(cut[np.minimum(n, 3)], starts)
            if lower is None:
                below = np.full(len(code), 1.0 / symbols)
            else:
                below = lower[1][np.searchsorted(lower[0], code % symbols**k)]
            p = (n - cut[np.minimum(n, 3)] + np.repeat(taken, sizes) * below) / np.repeat(total, sizes)
            if lower is not None:
                self._add(lower[0], lower[1], context[starts], taken / total)
            else:
                self.floor = float(np.log10(taken[0] / total[0] / symbols))
            lower = (code, p)
        self._add(lower[0], lower[1], np.zeros(0, np.int64), np.zeros(0))

    def _add(self, code: np.ndarray, p: np.ndarray, context: np.ndarray, weight: np.ndarray) -> None:
        back = np.zeros(len(code))
        # contexts that are start symbols alone are no n-grams of the text
        extra = np.setdiff1d(context, code)
        every = np.concatenate([code, extra])
        p, back = np.concatenate([np.log10(p), np.full(len(extra), -99.0)]), np.concatenate([back, np.zeros(len(extra))])
        order = np.argsort(every)
        every, p = every[order], p[order]
        back[np.searchsorted(every, context)] = np.log10(weight)
        self.tables.append((every.astype(self._kind), p.astype(np.float32), back.astype(np.float32)))

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for t in self.tables for x in t)

    def _find(self, k: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each code is in the table of order k, and where."""
        every = self.tables[k - 1][0]
        if not len(every):
            return np.zeros(len(codes), bool), np.zeros(len(codes), np.int64)
        key = codes.astype(self._kind)
        at = np.minimum(np.searchsorted(every, key), len(every) - 1)
        return every[at] == key, at

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each n-gram."""
        codes = codes.astype(np.int64)
        out, left, owed = np.empty(len(codes)), np.arange(len(codes)), np.zeros(len(codes))
        for k in range(self.order, 0, -1):
            found, at = self._find(k, codes[left] % self.symbols**k)
            p = self.tables[k - 1][1]
            found[found] = p[at[found]] > -90
            out[left[found]] = p[at[found]] + owed[found]
            left, owed = left[~found], owed[~found]
            if k > 1 and len(left):
                found, at = self._find(k - 1, codes[left] % self.symbols**k // self.symbols)
                owed[found] += self.tables[k - 2][2][at[found]]
        out[left] = self.floor + owed
        return out


def _language() -> Column:
    """The language that counts belong to, without the mark of a half."""
    return F.expr("substring(lang, 1, length(lang) - 2)")


def groups_of(counts: DataFrame, most: int, most_alone: int) -> tuple[list[list[str]], list[str]]:
    """Languages whose n-grams together are at most ``most``, or one alone; and
    those that have more than ``most_alone``."""
    sizes, out, held = counts.groupBy(_language().alias("l")).count().collect(), [], 0
    for lang, n in sorted(sizes):
        if n > most_alone:
            continue
        if not out or held + n > most:
            out.append([])
            held = 0
        out[-1].append(lang)
        held += n
    return out, sorted(lang for lang, n in sizes if n > most_alone)


def _arrays(df: DataFrame) -> tuple[np.ndarray, ...]:
    """Columns of ``df``, sorted by the first."""
    rows = df.toArrow()
    columns = [rows.column(c).to_numpy() for c in df.columns]
    by = np.argsort(columns[0])
    return tuple(c[by] for c in columns)


def train(counts: DataFrame, langs: list[str], order: int) -> dict[str, KneserNey]:
    """Two models for each of some languages, from all their texts."""
    models = {}
    for lang in [f"{x}/{half}" for x in langs for half in "01"]:
        code, n = _arrays(counts.where(F.col("lang") == lang).select("code", "n"))
        if len(code):
            models[lang] = KneserNey(code, n, order, SYMBOLS)
    return models


def ranges(counts: DataFrame, lang: str, order: int, most: int) -> Iterator[tuple[int, int, dict[str, KneserNey]]]:
    """(first, end, models): the two models of a language in ranges of n-grams
    of at most ``most``, or those that share their first two symbols (of order
    3 or less, all)."""
    mine = counts.where(_language() == lang)
    unit = SYMBOLS ** max(order - 2, 2)
    firsts, sizes = _arrays(mine.groupBy(F.expr(f"code div {unit}").alias("b")).count())
    cuts, held = [], 0
    for first, n in zip(firsts.tolist(), sizes.tolist()):
        if not cuts or held + n > most:
            cuts.append(first * unit)
            held = 0
        held += n
    whole = {}
    for half in (f"{lang}/{h}" for h in "01"):
        of_half = mine.where(F.col("lang") == half)
        seen = dict(of_half.where("n < 5").groupBy("n").count().collect())
        below = _arrays(of_half.groupBy((F.col("code") % SYMBOLS ** (order - 1)).alias("code")).count())
        if len(below[0]):
            whole[half] = below, np.array([seen.get(j, 0) for j in (1, 2, 3, 4)])
    for first, end in zip([0, *cuts[1:]], [*cuts[1:], SYMBOLS**order]):
        within = mine.where(F.col("code").between(first, end - 1))
        yield first, end, {half: KneserNey(*_arrays(within.where(F.col("lang") == half).select("code", "n")), order, SYMBOLS, *rest) for half, rest in whole.items()}


def _log10s(texts: list[bytes | None], lang: str, models: dict[str, KneserNey], order: int, first: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the log10 probabilities of the bytes of each text, of n-grams in
    a range only; and the texts' lengths in bytes."""
    # a language with texts in one half only has one model
    model = models.get(lang) or models.get(lang[:-1] + "01"[lang[-1] == "0"])
    codes, lengths = _codes(texts, order, ALPHABET)
    if model is None or not len(codes):
        return np.zeros(len(texts)), lengths
    distinct, places, where = _places(codes)
    if end is not None:
        here = (distinct >= first) & (distinct < end)
        distinct, places = distinct[here], places[here]
    scores = np.zeros(int(where.max()) + 1, np.float32)
    scores[places] = model.log10(distinct)
    total = np.concatenate([[0.0], np.cumsum(scores[where], dtype=np.float64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths], lengths


def measures(docs: DataFrame, models: dict[str, KneserNey], others: list[str], order: int, lang_col: str, text_col: str) -> DataFrame:
    """All columns of ``docs`` as struct ``doc``, without the text, with the
    base counts and log_ppl: minus the mean log10 probability of a byte, 0
    for a text without any or of a language without models. Languages
    ``others`` are left out."""
    held = docs.sparkSession.sparkContext.broadcast(models)
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            base = np.array([base_counts(t) for t in texts], np.int64)
            ppl = np.zeros(len(texts))
            for lang in set(langs):
                mine = [i for i, x in enumerate(langs) if x == lang]
                sums, lengths = _log10s([texts[i] for i in mine], lang, held.value, order)
                ppl[mine] = -sums / np.maximum(lengths, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([x[:-2] for x in langs], pa.string()), *[pa.array(base[:, k]) for k in range(5)], pa.array(ppl)], names=["doc", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl"])

    lang, half = _lang_and_half(lang_col, text_col, other=True)
    source = docs.select(F.struct(*rest).alias("doc"), lang.alias("lang"), half.alias("half"), raw(text_col).alias("text"))
    source = source.where(~F.col("lang").isin(others)) if others else source
    source = source.select("doc", F.concat("lang", "half").alias("lang"), "text")
    schema = f"doc {source.schema['doc'].dataType.simpleString()}, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, log_ppl double"
    return source.mapInArrow(run, schema)


def _keys(text_col: str) -> dict[str, Column]:
    """What tells texts apart: 96 bits of hashes and the length."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {"__range_key": F.xxhash64(text), "__range_more": F.hash(text), "__range_bytes": F.octet_length(text)}


def sums_by_ranges(docs: DataFrame, counts: DataFrame, name: str, order: int, most: int, lang_col: str, text_col: str) -> DataFrame:
    """(lang, __range_key, __range_more, __range_bytes, total): the sum of the log10 probabilities
    of the bytes of each text of a language, from one range of its n-grams
    after the other."""
    lang, half = _lang_and_half(lang_col, text_col, other=True)
    keys, names = _keys(text_col), list(_keys(text_col))
    source = docs.where(lang == name).select(*[c.alias(n) for n, c in keys.items()], F.concat(lang, half).alias("lang"), raw(text_col).alias("text"))
    parts = []
    for k, (first, end, models) in enumerate(ranges(counts, name, order, most)):
        held = docs.sparkSession.sparkContext.broadcast(models)

        def run(batches: Iterator[pa.RecordBatch], held=held, first=first, end=end) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 2 << 20):
                langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
                sums = np.zeros(len(texts))
                for lang in set(langs):
                    mine = [i for i, x in enumerate(langs) if x == lang]
                    sums[mine] = _log10s([texts[i] for i in mine], lang, held.value, order, first, end)[0]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sums)], names=[*names, "part"])

        found = source.mapInArrow(run, "__range_key bigint, __range_more int, __range_bytes int, part double").groupBy(*keys).agg(F.max("part").alias("part"))
        parts.append(durable(found.withColumn("k", F.lit(k))))
        held.destroy()
    # added in the order of the ranges, so that equal texts get equal sums
    every = reduce(DataFrame.unionAll, parts).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda x, y: x + y["part"])
    return every.select(F.lit(name).alias("lang"), *keys, total.alias("total"))


def bands(scored: DataFrame, low: float, high: float) -> DataFrame:
    """(lang, lower, upper) of log_ppl: ``low`` and ``high`` robust standard
    deviations around the median, from an exact histogram in steps of 1/1000.
    A band is never narrower than such a step to either side."""
    bins = scored.where("not base_failed").groupBy("lang", F.floor(F.col("log_ppl") * 1000).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    rows = []
    for lang, group in bins.toPandas().groupby("lang"):
        group = group.sort_values("bin")
        value, n = group["bin"].to_numpy() / 1000, group["n"].to_numpy()

        def middle(v: np.ndarray, n: np.ndarray) -> float:
            return float(v[np.searchsorted(np.cumsum(n), n.sum() / 2)])

        mid = middle(value, n)
        away = np.abs(value - mid)
        order = np.argsort(away, kind="stable")
        spread = 1.4826 * middle(away[order], n[order])
        rows.append((lang, mid - max(low * spread, 0.001), mid + max(high * spread, 0.001)))
    return scored.sparkSession.createDataFrame(rows, "lang string, lower double, upper double")


def judge(docs: DataFrame, order: int = 4, low: float = 5.0, high: float = 5.0, most_ngrams: int = 1 << 22, most_alone: int = 1 << 22, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, then n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words (long), log_ppl (double),
    base_failed and kept (boolean); columns of ``docs`` with those names go.

    Base rules: a document fails with under 50 words or with over half its
    words in repeated 3-word windows. Null and empty texts have no words and
    fail. Documents without a language share a model. A language none of whose
    documents passes the base rules has no band and keeps nothing. Models of
    languages with up to ``most_ngrams`` n-grams together are held at a time,
    or of one; one with over ``most_alone`` is held in ranges of as many."""
    ship(docs.sparkSession)
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl", "base_failed", "kept"]
    rest = [c for c in docs.columns if c not in out and c != text_col]
    docs = docs.select(*rest, text_col)
    counts = durable(ngram_counts(docs, order, lang_col, text_col))
    groups, large = groups_of(counts, most_ngrams, max(most_alone, 2 * SYMBOLS))
    keys = _keys(text_col) if large else {}
    sums = [sums_by_ranges(docs, counts, x, order, most_alone, lang_col, text_col) for x in large]
    docs = docs.withColumns(keys)
    named, parts = [x for g in groups for x in g], []
    # the first group also has languages whose texts are all empty, and those
    # whose sums are taken from ranges
    for k, here in enumerate(groups or [[]]):
        part = measures(docs, train(counts, here, order), [x for x in named if x not in here], order, lang_col, text_col)
        parts.append(durable(part if k == 0 else part.where(F.col("lang").isin(here))))
    scored = reduce(DataFrame.unionAll, parts)
    if sums:
        at = [F.col(f"doc.{n}").alias(n) for n in keys]
        scored = scored.select("*", *at).join(reduce(DataFrame.unionAll, sums), ["lang", *keys], "left")
        scored = scored.withColumn("log_ppl", F.coalesce(-F.col("total") / F.greatest("__range_bytes", F.lit(1)), "log_ppl")).drop("total")
        scored = scored.withColumn("doc", F.col("doc").dropFields(*keys)).drop(*keys)
    scored = durable(scored.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")))
    ranged = scored.join(F.broadcast(bands(scored, low, high)), "lang", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(False))
    return ranged.select("doc.*", *out[:6], "base_failed", kept.alias("kept"))


def drop_low_quality(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", **how) -> DataFrame:
    """The documents that ``judge`` keeps, all columns. A verdict belongs to a
    language and text, whatever the doc_id: rows with a null or repeated one
    each stay or go by their own text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = {"__lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")), "__text": F.xxhash64(text), "__bytes": F.octet_length(text)}
    judged = judge(docs.select(lang_col, text_col).withColumns(keys), lang_col=lang_col, text_col=text_col, **how)
    gone = durable(judged.where("not kept").select(*keys).distinct())
    return docs.withColumns(keys).join(checked_broadcast(gone, 40), list(keys), "left_anti").select(*docs.columns)
