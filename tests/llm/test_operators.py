"""Each operator against a plain version, and on awkward tables."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logwright.llm import bpe, common, exact_dedup, line_dedup, lm, mixing, quality, queries, sharding, similar, simhash, substring_dedup, warc
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, kept string, size string, id string, h int, block string, doc string"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def pairs(sf):
    t = pq.read_table(f"{sf}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated
    rows, and columns named as those the operators make."""
    line = "the same line of forty characters or so, again"
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, None, "en", "a"),
        (2, "", None, None),
        (3, " \n\t ", "en", "a"),
        (4, f"{line}\n{line}\nx", "en", "b"),
        (4, f"{line}\n{line}\nx", "en", "b"),
        (5, f"  {line.upper()} \nother", "en", "b"),
        (6, f"{line}\nthe end\x0b", "fr", "b"),
        (7, long, "en", "a"),
        (8, long + " tail", "en", "a"),
        (9, long, "fr", "a"),
        (None, "one two three", "en", "a"),
        (None, None, None, None),
        (10, "one two three", "xx", "c"),
        (11, "it's 'll 're　  x́ 日本語 😀 " * 20, "ja", "c"),
    ]
    return spark.createDataFrame([(*r, 7, "k", "s", "i", 1, "b", "d") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


def test_simhash(docs, pairs):
    found = {r["doc_id"]: r for r in rows_of(simhash.near_duplicates(docs))}
    prints = {i: brute.fingerprint(t) for i, t in pairs}
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in found.items()} == prints
    whole = brute.components(list(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    assert {i: r["component_id"] for i, r in found.items()} == whole


@pytest.mark.parametrize("limit", [2, 3, 8192])
def test_simhash_links_in_buckets_of_any_size(spark, limit):
    rng = random.Random(limit)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))))
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r["node"]: r["component"] for r in rows_of(common.components(simhash.near_links(fps, 4, limit)))}
    whole = brute.components(values, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    assert {v: got.get(v, v) for v in values} == whole


@pytest.mark.parametrize("radius", [2, 4, 6])
def test_covering_masks_miss_no_near_pair(radius):
    masks, rng = simhash.covering_masks(radius), random.Random(0)
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), radius))
        assert any(x & m == y & m for m in masks)


def test_near_duplicates_are_verified(spark):
    rng = random.Random(3)
    base = [f"word{rng.randrange(500)}" for _ in range(400)]
    near = list(base)
    near[200] = "changed"
    other = [f"word{rng.randrange(500)}" for _ in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(base))]
    kept = similar.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def shingles(text, k=5):
    w = [x.lower() for x in brute.words(text)]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(x, y):
    return len(x & y) / len(x | y)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_similar_pairs_are_found_whatever_their_bits(spark):
    """Pairs by their similarity alone, from 0.8 to 1, edited in places or in
    one stretch."""
    rng = random.Random(11)
    docs, pairs_of = [], defaultdict(list)
    while min((len(pairs_of[b]) for b in range(4)), default=0) < 60:
        base = [f"word{int(rng.paretovariate(0.8)) % 20_000}" for _ in range(rng.randrange(60, 500))]
        if rng.random() < 0.5:
            other = edited(rng, base, rng.randrange(1, max(2, len(base) // 40)))
        else:
            n = rng.randrange(1, max(2, len(base) // 7))
            other = base + [f"more{rng.randrange(10**6)}" for _ in range(n)]
        x = jaccard(shingles(" ".join(base)), shingles(" ".join(other)))
        if not 0.8 <= x < 1 or len(pairs_of[int((x - 0.8) / 0.05)]) >= 60:
            continue
        i = len(docs)
        docs += [(i, " ".join(base)), (i + 1, " ".join(other))]
        pairs_of[int((x - 0.8) / 0.05)].append(i)
    got = {r["doc_id"]: r["component_id"] for r in rows_of(similar.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")))}
    caught = [sum(got.get(i + 1) == i for i in pairs_of[b]) / 60 for b in range(4)]
    print("caught", caught)
    assert caught[0] >= 0.9 and caught[1] >= 0.95 and min(caught[2:]) >= 0.98
    assert all(component in (i, i - 1) for i, component in got.items())


@pytest.mark.parametrize("size", [1024, 60])
def test_similar_groups_of_a_large_family(spark, size):
    """Several hundred edited copies of one text, of all similarities, against
    all pairs, in one block and in several."""
    rng = random.Random(7)
    base = [f"word{rng.randrange(9000)}" for _ in range(300)]
    texts = [" ".join(edited(rng, base, rng.randrange(14))) for _ in range(400)]
    sets = [shingles(t) for t in texts]
    heads = brute.components(list(range(400)), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    assert len(set(heads.values())) > 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in rows_of(similar.similar_documents(docs, block_texts=size))}
    assert [got.get(i, i) for i in range(400)] == [heads[i] for i in range(400)]


def test_crowded_keys_go_on_as_one(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"word{rng.randrange(9000)}" for _ in range(300)]
    docs = [(i, " ".join(edited(rng, base, 1))) for i in range(300)]
    monkeypatch.setattr(similar, "CROWD", 4)
    found = rows_of(similar.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")))
    assert len(found) == 300 and {r["component_id"] for r in found} == {0}


def test_prints_count_majorities():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 255, 256, 40_000, 3)]
    got = similar.prints(sets, 2)
    for row, s in zip(got, sets):
        for v in (0, 1):
            mixed = simhash.mixed_hashes(s, v + 1)
            want = [2 * int((mixed >> np.uint64(b) & np.uint64(1)).sum()) > len(s) for b in range(similar.BITS)]
            assert np.unpackbits(row[v * 6 : v * 6 + 6], bitorder="little").tolist() == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in rows_of(common.components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100}


def test_mixing_weights():
    tokens = {"a": 700, "b": 200, "c": 100}
    w, a, budget = mixing.mixture(tokens, 1000, entropy_share=0.9, max_repeats=9)
    assert 0 < a < 1 and mixing.entropy(w) == pytest.approx(0.9 * np.log(3), abs=1e-6)
    w, a, budget = mixing.mixture(tokens, 1000, entropy_share=1.0, max_repeats=1.5)
    assert max(w[s] * budget / tokens[s] for s in tokens) == pytest.approx(1.5, abs=1e-6)
    w, a, budget = mixing.mixture(tokens, None, entropy_share=1.0, max_repeats=2)
    repeats = {s: w[s] * budget / tokens[s] for s in tokens}
    assert min(repeats.values()) == pytest.approx(1) and max(repeats.values()) == pytest.approx(2)
    assert mixing.mixture({}) == ({}, 1.0, 0.0)


def test_mixing_blocks(docs, pairs, sf):
    got = rows_of(mixing.mix(docs, max_repeats=2.0, blocks=10))
    sources = dict(zip((i for i, _ in pairs), pq.read_table(f"{sf}/documents.parquet")["source"].to_pylist()))
    assert {r["doc_id"] for r in got} == set(sources)
    assert all(r["n_tokens"] == len(brute.words(dict(pairs)[r["doc_id"]])) + 1 for r in got[:50])
    tokens, longest = Counter(), defaultdict(int)
    for i, t in pairs:
        tokens[sources[i]] += len(brute.words(t)) + 1
        longest[sources[i]] = max(longest[sources[i]], len(brute.words(t)) + 1)
    weights, _, budget = mixing.mixture(tokens, None, 0.98, 2.0)
    by_block, slots = defaultdict(Counter), defaultdict(list)
    for r in got:
        assert r["weight"] == pytest.approx(weights[r["source"]]) and r["source"] == sources[r["doc_id"]]
        by_block[r["block"]][r["source"]] += r["n_tokens"]
        slots[r["block"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for block in range(10):
        for s, w in weights.items():
            assert abs(by_block[block][s] - w * budget / 10) <= 2 * longest[s]
    assert max(Counter((r["doc_id"], r["epoch"]) for r in got).values()) == 1


def test_mixed_takes_what_the_mixture_takes(docs):
    for how in ({"max_repeats": 2.0}, {"budget": 30_000.0}, {"budget": 150_000.0, "max_repeats": 9.0}):
        want = Counter(r["doc_id"] for r in rows_of(mixing.mix(docs, **how)))
        assert Counter(r["doc_id"] for r in rows_of(mixing.mixed(docs, **how))) == want


def test_sharding(docs, pairs):
    got = rows_of(sharding.shard_by_bytes(docs, shards=10))
    texts = dict(pairs)
    sizes, slots, shards = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        shards[data].add(r["shard"])
    mean, largest = sum(sizes.values()) / 10, max(r["size"] for r in got)
    assert sorted(sizes) == list(range(10)) and max(abs(x - mean) for x in sizes.values()) <= 0.02 * mean + largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(got) == len(pairs)


def test_sharding_splits_a_hot_group(spark):
    rows = [(i, "copy") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 9000)]
    got = rows_of(sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards=12))
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 12
    assert max(abs(x - mean) for x in sizes.values()) <= 0.02 * mean + 26
    # equal texts follow one another in the order of shards and slots
    order = [r["doc_id"] < 3000 for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(a != b for a, b in zip(order, order[1:])) <= 2


@pytest.mark.parametrize("ids", [[None] * 3000, [7] * 3000])
def test_sharding_splits_repeated_rows(spark, ids):
    rows = [(i, "one text of all") for i in ids] + [(i, f"text {i}") for i in range(1000)]
    got = rows_of(sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards=10))
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(sizes.values()) / 10
    assert len(got) == 4000 and len(sizes) == 10 and max(abs(x - mean) for x in sizes.values()) <= 0.02 * mean + 31
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_exact(docs, pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t].append(i)
    for support in (0.0005, 0.01, 0.5):
        got = {r["doc_id"]: r for r in rows_of(exact_dedup.exact_duplicates(docs, support))}
        assert len(got) == len(pairs)
        for i, t in pairs:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(groups[t]), len(groups[t]), i == max(groups[t]), brute.sha(t.encode()))


def test_heavy_digests_are_found_and_verified(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"d{i}") for i in range(3000)]
    heavy = rows_of(exact_dedup.heavy_digests(spark.createDataFrame(rows, "doc_id long, digest string").repartition(7), 0.01))
    assert heavy == [{"digest": "hot", "keep_id": 2997, "group_size": 1000}]


@pytest.mark.parametrize("limit,keys", [(64 << 20, 1 << 20), (64 << 20, 3), (0, 3)])
def test_lines(docs, pairs, limit, keys):
    got = rows_of(line_dedup.dedup_lines(docs.select("doc_id", "text"), broadcast_limit=limit, keys_per_shard=keys))
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], brute.sha(r["text"].encode())) for r in got} == brute.dedup_lines(pairs)


def test_minimal_perfect_hash():
    rng = np.random.default_rng(0)
    h1, h2 = (rng.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    h1[1] = h1[0]  # told apart by the second half
    mph = line_dedup.MinimalPerfectHash.unpack(line_dedup.MinimalPerfectHash(h1, h2).pack())
    assert sorted(mph.slots(h1, h2).tolist()) == list(range(5000))
    index = line_dedup.ShardIndex.build(h1, h2, np.full(5000, 3), np.arange(5000))
    assert (index.probe(h1, h2)[1] == np.arange(5000)).all()
    assert not index.probe(h1, h2 + np.uint64(1))[0].any()


def test_quality_counts(docs, pairs):
    got = {r["doc_id"]: r for r in rows_of(quality.judge(docs))}
    assert len(got) == len(pairs)
    for i, t in pairs:
        r, b = got[i], brute.base_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b
        assert r["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r["kept"] and r["base_failed"])


def test_quality_groups_of_languages_agree(docs):
    one = {r["doc_id"]: (r["kept"], round(r["log_ppl"], 9)) for r in rows_of(quality.judge(docs))}
    two = {r["doc_id"]: (r["kept"], round(r["log_ppl"], 9)) for r in rows_of(quality.judge(docs, most_ngrams=1))}
    assert one == two


def test_quality_rejects_noise_and_keeps_prose(spark, docs, pairs):
    rng = random.Random(0)
    noise = " ".join("".join(rng.choice("qxzjkvw7#%") for _ in range(6)) for _ in range(200))
    mixed = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10**6, noise, "en")], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in rows_of(quality.judge(mixed))}
    assert not got[10**6]["base_failed"] and not got[10**6]["kept"]


def test_bands_are_as_narrow_as_the_documents(spark):
    rows = [("en", 0.7 + 0.001 * (i % 41 - 20) + 0.0005, False) for i in range(410)] + [("fr", 0.6005, False)] * 9
    got = {r["lang"]: r for r in rows_of(quality.bands(spark.createDataFrame(rows, "lang string, log_ppl double, base_failed boolean"), 6.0, 30.0))}
    assert got["en"]["lower"] == pytest.approx(0.7 - 6 * 1.4826 * 0.010, abs=0.01)
    assert got["en"]["upper"] == pytest.approx(0.7 + 30 * 1.4826 * 0.010, abs=0.05)
    assert got["fr"]["lower"] < 0.6005 < got["fr"]["upper"] and got["fr"]["upper"] - got["fr"]["lower"] < 0.01


def test_bands_part_labelled_junk_from_labelled_prose(spark, sf):
    sf = f"{sf}/../sf0.1"  # smaller tables have few labels
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id")
    kept = Counter((r["quality"], r["kept"]) for r in rows_of(quality.judge(docs)) if not r["base_failed"])
    assert kept[0, False] >= 0.5 * (kept[0, False] + kept[0, True])
    assert kept[1, False] <= 0.015 * (kept[1, False] + kept[1, True])


def test_kneser_ney_sums_to_one():
    texts = [b"abracadabra banana bandana\n", b"a cab, a bad cab"] * 3
    codes = np.concatenate([quality._codes([t], 4)[0] for t in texts])
    at, n = np.unique(codes, return_counts=True)
    model = quality.KneserNey(at, n, 4)
    for context in (0, (quality.START * 49 + quality.START) * 49 + quality.START, *(at[:20] // 49).tolist()):
        every = context * 49 + np.arange(49)
        assert (10.0 ** model.log10(every)).sum() == pytest.approx(1, abs=1e-4)


def plain_kneser_ney(texts, order=4):
    """log10 probability of a symbol after a context, by the formulas with
    dictionaries."""
    grams = Counter()
    for t in texts:
        s = [quality.START] * (order - 1) + quality.ALPHABET[list(t)].tolist()
        grams.update(tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s)))
    levels = [grams]
    for _ in range(order - 1):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    cuts, totals, taken = [], [], []
    for level in levels:
        of = [sum(n == j for n in level.values()) for j in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1]) if of[0] + of[1] else 0.5
        cut = [0.0] + [min(max(j - (j + 1) * y * of[j] / of[j - 1] if of[j - 1] else 0.5, 0.05), j - 0.05) for j in (1, 2, 3)]
        total, gone = Counter(), Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            gone[g[:-1]] += cut[min(n, 3)]
        cuts.append(cut)
        totals.append(total)
        taken.append(gone)

    def p(gram):
        if not gram:
            return 1 / quality.SYMBOLS
        k, below = len(gram) - 1, p(gram[1:])
        total = totals[k][gram[:-1]]
        if not total:
            return below
        n = levels[k][gram]
        return (n - cuts[k][min(n, 3)] + taken[k][gram[:-1]] * below) / total

    return p


def test_perplexity_agrees_with_a_plain_model(spark):
    rng = random.Random(2)
    words = ["дом", "кот", "село", "the", "cat", "naïve", "東京", "كتاب", "x1"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 40))) for _ in range(30)]
    rows = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    half = {r["doc_id"]: r["h"] for r in rows_of(rows.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("h")))}
    models = [plain_kneser_ney([t.encode() for i, t in enumerate(texts) if half[i] == h]) for h in (0, 1)]
    for r in rows_of(quality.judge(rows)):
        data = texts[r["doc_id"]].encode()
        s = [quality.START] * 3 + quality.ALPHABET[list(data)].tolist()
        want = -sum(np.log10(models[1 - half[r["doc_id"]]](tuple(s[i : i + 4]))) for i in range(len(data))) / len(data)
        assert r["log_ppl"] == pytest.approx(want, rel=1e-5)


def test_text_beyond_ascii_is_seen(spark):
    """Prose in another script passes, the same characters shuffled do not."""
    rng = random.Random(4)
    letters = "абвгдежзийклмнопрстуфхцчшщыьэюя"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    prose = [" ".join(words[int(rng.paretovariate(0.9)) % 300] for _ in range(120)) for _ in range(200)]
    junk = ["".join(rng.sample(t, len(t))) for t in prose[:5]]
    rows = spark.createDataFrame([(i, t, "ru") for i, t in enumerate(prose + junk)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in rows_of(quality.judge(rows))}
    failed = [i for i in range(200) if not got[i]["kept"] and not got[i]["base_failed"]]
    assert len(failed) <= 4 and not any(got[i]["kept"] for i in range(200, 205))


def test_bytes_are_told_apart_but_for_two_classes(spark):
    """Texts that are alike but for letters that a coarse alphabet takes for
    one another: capitals, brackets, and letters of another script."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeлкмé") for _ in range(rng.randrange(3, 8))) for _ in range(200)]
    prose = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(200)]
    swap = str.maketrans({"a": "A", "d": "D", "л": "\u0433", "к": "\u0432"})
    odd = [t.translate(swap) for t in prose[:4]]
    assert [quality._codes([t.encode()], 4)[0].tolist() for t in odd] == [quality._codes([t.encode()], 4)[0].tolist() for t in prose[:4]]
    assert len(set(quality.ALPHABET.tolist())) == 256 - 9 - 13 and len(set(quality.ALPHABET[128:].tolist())) == 128
    rows = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(prose + odd)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in rows_of(quality.judge(rows))}
    assert not any(got[i]["kept"] for i in range(200, 204)) and sum(got[i]["kept"] for i in range(200)) >= 190


def test_quality_ranges_of_ngrams_agree(docs):
    odd = docs.select("doc_id", "text", "lang").limit(1).select(F.lit(10**6).cast("long").alias("doc_id"), F.lit("zz zy").alias("text"), F.lit("half").alias("lang"))
    every = docs.select("doc_id", "text", "lang").where("lang = 'en'").unionByName(odd)
    one = {r["doc_id"]: (r["kept"], round(r["log_ppl"], 6)) for r in rows_of(quality.judge(every))}
    two = {r["doc_id"]: (r["kept"], round(r["log_ppl"], 6)) for r in rows_of(quality.judge(every, most_alone=6000))}
    assert one == two
    assert quality.groups_of(quality.ngram_counts(every, 4, "lang", "text"), 1 << 22, 6000) == ([["half"]], ["en"])


def test_quality_ranges_where_one_half_has_texts(spark):
    texts = ["word%d and another %d\n" % (i, i * i) * 20 for i in range(60)]
    half = {r["text"] for r in rows_of(spark.createDataFrame([(t,) for t in texts], "text string").where("pmod(xxhash64(text), 2) = 0"))}
    rows = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(t for t in texts if t in half)] + [(99, None, "xx")], "doc_id long, text string, lang string")
    one = {r["doc_id"]: round(r["log_ppl"], 6) for r in rows_of(quality.judge(rows))}
    two = {r["doc_id"]: round(r["log_ppl"], 6) for r in rows_of(quality.judge(rows, most_alone=1))}
    assert one == two and one[99] == 0


def test_lm(docs, pairs):
    got = {r["doc_id"]: r for r in rows_of(lm.score(docs))}
    want = brute.unigram(pairs)
    assert got.keys() == want.keys()
    for i, (out, n, known, total, base) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-6)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def plain_score(model, text):
    """log10 probability of a text, one token after the other."""
    p = {n: a.astype(np.float64) for n, a in model.net.p.items()}
    place = {h: i for i, h in enumerate(model.hashes.tolist())}
    size, h, out = lm.HIDDEN, np.zeros(lm.HIDDEN), 0.0
    for word in lm.tokens((text or "").encode()):
        code = place.get(lm.word_hash(word), -lm.word_hash(word) - 1)
        kind = code // lm.PER_CLASS if 0 <= code < lm.HEAD else lm.CLASSES
        scores = np.exp(p["Wc"] @ h + p["bc"])
        out += np.log10(scores[kind] / scores.sum())
        if kind < lm.CLASSES:
            scores = np.exp(p["Wo"] @ h + p["bo"])[kind * lm.PER_CLASS : (kind + 1) * lm.PER_CLASS]
            out += np.log10(scores[code % lm.PER_CLASS] / scores.sum())
        else:
            out += np.log10((model.known[code] if code >= 0 else 0) + 0.5) - np.log10(model.rest)
        x = p["E"][code if 0 <= code < lm.HEAD else lm.HEAD + abs(code) % lm.BUCKETS] + p["b"]
        u = h @ p["U"]
        z, r = (1 / (1 + np.exp(-(x[k : k + size] + u[k : k + size]))) for k in (0, size))
        h = h + z * (np.tanh(x[2 * size :] + r * u[2 * size :]) - h)
    return out


def test_lm_scores_are_those_of_the_network(docs, pairs):
    model = lm.fit(docs, lm.token_counts(docs, lm.held_out, "doc_id", "text"))
    got = {r["doc_id"]: r for r in rows_of(lm.score(docs, model=model))}
    assert all(got[i]["score"] == pytest.approx(plain_score(model, t), rel=1e-4) for i, t in pairs[:60])


def test_lm_learns_from_every_training_token(spark, docs, monkeypatch):
    """The counts that every partition learnt from come to all training
    tokens, in any number of partitions and rounds."""
    model = lm.Model(lm.Network.fresh(np.ones(5), 1.0), np.zeros(0, np.int64), np.zeros(0), 1, 1)
    words = spark.sparkContext.broadcast(model.hashes)
    total = rows_of(docs.where("pmod(crc32(cast(doc_id as string)), 5) <> 1").selectExpr(r"sum(regexp_count(text, '[^\\x20\\x09-\\x0D]+') + 1) AS n"))[0]["n"]
    seen = []
    monkeypatch.setattr(lm, "durable", lambda df: seen.append(df) or common.durable(df))
    lm.train(docs.repartition(3), words, lm.held_out, model.net, "doc_id", "text", rounds=2)
    assert sum(df.agg(F.sum("n")).first()[0] for df in seen if df.count() > 1) == total


def test_lm_with_few_broadcast_counts(docs, pairs, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 3000)
    got, want = {r["doc_id"]: r for r in rows_of(lm.score(docs, rounds=1))}, brute.unigram(pairs)
    for i, w in want.items():
        assert got[i]["n_known"] == w[2] and got[i]["base_score"] == pytest.approx(w[4], rel=1e-9, abs=1e-6)


def test_network_is_a_distribution_and_its_gradient_is_right():
    rng = np.random.default_rng(1)
    net = lm.Network.fresh(rng.integers(1, 99, lm.HEAD).astype(float), 50.0)
    for n in ("Wc", "Wo"):
        net.p[n] = rng.standard_normal(net.p[n].shape).astype(np.float32) * 0.3
    h = rng.standard_normal((1, lm.HIDDEN)).astype(np.float32)
    codes = np.append(np.arange(lm.HEAD), -1)
    assert np.exp(net.log_probs(np.repeat(h, len(codes), 0), codes).astype(float)).sum() == pytest.approx(1, abs=1e-3)
    net.p = {n: a.astype(np.float64) for n, a in net.p.items()}
    codes = rng.integers(0, lm.HEAD, (6, 3))
    codes[2, 1] = -5
    begins = np.zeros((6, 3), bool)
    begins[0], begins[3, 2] = True, True
    ids, start = lm.inputs(codes), np.zeros((3, lm.HIDDEN))

    def loss():
        out = np.empty((6, 3, lm.HIDDEN))
        state = start
        for t in range(6):
            one, state = net.states(ids[t : t + 1], begins[t : t + 1], state)
            out[t] = one[0]
        return -net.log_probs(out.reshape(-1, lm.HIDDEN), codes.ravel()).sum()

    grads, _ = net.gradient(ids, codes, begins, start)
    rows, table = grads["E"]
    for name, at, got in (("U", (3, 40), grads["U"][3, 40]), ("U", (2, 20), grads["U"][2, 20]), ("U", (5, 3), grads["U"][5, 3]), ("b", (17,), grads["b"][17]), ("Wc", (4, 2), grads["Wc"][4, 2]), ("E", (int(rows[0]), 5), table[0, 5])):
        keep, eps = net.p[name][at], 1e-4
        net.p[name][at] = keep + eps
        up = loss()
        net.p[name][at] = keep - eps
        down = loss()
        net.p[name][at] = keep
        assert got == pytest.approx((up - down) / (2 * eps), rel=0.02, abs=2e-3), name


def test_lm_state_is_carried_across_windows():
    rng = np.random.default_rng(0)
    net = lm.Network.fresh(rng.integers(1, 99, lm.HEAD).astype(float), 50.0)
    net.p["Wc"] = rng.standard_normal(net.p["Wc"].shape).astype(np.float32)
    texts = [rng.integers(0, lm.HEAD, n) for n in (200, 3, 1, 77, 64)]
    one, other = lm.score_texts(net, texts, window=7), lm.score_texts(net, texts, window=10_000)
    assert np.allclose(one, other, rtol=1e-4)
    assert np.allclose(one[3], lm.score_texts(net, [texts[3]])[0], rtol=1e-4)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    path = queries.ranks_path()
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_agrees_with_the_library(library):
    path, enc = library
    rng, words, table = random.Random(1), bpe.Vocabulary(bpe.read_ranks(path), most=500), bpe.code_point_classes()
    alphabet = ["a", "B", "é", "1", "٣", " ", "  ", "\n", "\t", " ", "'", "'s", "'ll", "'re", "'v", "!", "-", "'t", "日", "😀", "　", "ß", "\0", "'S", "́"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(20_000)] + ["=" * 3000, "ab" * 2000, "", " " * 999]
    ids, counts = bpe.encode_texts([t.encode() for t in texts], words, table)
    at = 0
    for t, n in zip(texts, counts.tolist()):
        assert enc.encode_ordinary(t) == ids[at : at + n], t
        at += n


def test_scan_agrees_with_one_step_at_a_time():
    rng = np.random.default_rng(0)
    for n in (1, 2, 37, 1000, 9999):
        kinds = rng.integers(0, 9, n).astype(np.uint8)
        state, want = bpe.START, []
        for k in kinds.tolist():
            want.append(state)
            state = bpe._step(state, k)[0]
        assert bpe.states_before(kinds).tolist() == want


def test_bpe_round_trip(awkward, docs, library):
    path, enc = library
    for df in (docs, awkward):
        tokens = bpe.decode(bpe.encode(df, path), path)
        assert tokens.columns == [c for c in df.columns if c != "text"] + ["ids", "offsets", "decoded"]
        texts = Counter((r["doc_id"], (r["text"] or "").encode()) for r in rows_of(df))
        got = rows_of(tokens)
        assert Counter((r["doc_id"], bytes(r["decoded"])) for r in got) == texts
        for r in got[:40]:
            data = bytes(r["decoded"])
            assert r["ids"] == enc.encode_ordinary(data.decode())
            ends = [*r["offsets"][1:], len(data)]
            assert all(enc.decode_single_token_bytes(i) == data[a:b] for i, a, b in zip(r["ids"], r["offsets"], ends))


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_substrings(docs, pairs, limit):
    got = rows_of(substring_dedup.dedup_substrings(docs, broadcast_limit=limit))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], brute.sha(r["kept_text"].encode())) for r in got} == brute.substrings(pairs)


def longest_levels(docs, size):
    """By windows of every length size, 2 size, ..., all compared."""
    out, length = {i: 0 for i, _ in docs}, size
    while length <= max(len(brute.words(t)) for _, t in docs):
        first = {}
        for i, t in docs:
            w = brute.words(t)
            for a in range(len(w) - length + 1):
                first.setdefault(tuple(w[a : a + length]), i)
        for i, t in docs:
            w = brute.words(t)
            if any(first[tuple(w[a : a + length])] < i for a in range(len(w) - length + 1)):
                out[i] = length
        length *= 2
    return out


def test_substrings_of_planted_passages(spark):
    rng = random.Random(5)
    text = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    passage, short = text(73), text(49)
    docs = []
    for i in range(40):
        w = text(rng.randrange(0, 200))
        at = rng.randrange(len(w) + 1)
        docs.append((i, " ".join(w[:at] + (passage if i % 3 else short) + w[at:])))
    docs += [(100, docs[7][1]), (101, " ".join(passage * 3)), (102, " ".join(passage * 3))]
    for size in (50, 7, 2):
        got = rows_of(substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), size))
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], brute.sha(r["kept_text"].encode())) for r in got} == brute.substrings(docs, size)
        assert {r["doc_id"]: r["longest"] for r in got} == longest_levels(docs, size)


def test_warc(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    more = spark.createDataFrame([(10**6, "http://x/ y\n", None), (10**6 + 1, None, ""), (10**6 + 2, "u", "é"), (None, "u", "é")], "page_id long, url string, html string")
    again = pages.limit(20).withColumn("page_id", F.col("page_id") + 500_000)
    pages = pages.unionByName(again).unionByName(more)
    index = warc.write_archives(pages, f"file://{tmp_path}/warc", roll_bytes=20_000)
    assert index.count() == pages.count() and index.select("file").distinct().count() > 4
    groups = defaultdict(list)
    html = [((r["html"] or "").encode(), r["page_id"]) for r in rows_of(pages)]
    for data, i in html:
        groups[data].append(i)
    got = rows_of(warc.read_records(index, gap=100, most=5000))
    assert len(got) == len(html)
    by_id = {r["page_id"]: r for r in got}
    for data, i in html:
        r, first = by_id[i], min(x for x in groups[data] if x is not None)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == first else ("revisit", first))
        assert r["payload"] == (data if i == first else None)
    assert warc.read_records(index, stretch=5000, task_bytes=20_000).rdd.getNumPartitions() > 4
    one = rows_of(warc.read_records(index.where("page_id = 3")))
    assert [r["page_id"] for r in one] == [3]
    for path in list((tmp_path / "warc").iterdir())[:3]:
        assert gzip.decompress(path.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_reads_are_coalesced():
    rows = [("a", 0, 10), ("a", 12, 10), ("a", 40, 5), ("b", 45, 5), ("b", 50, 500), ("b", 550, 1)]
    assert [len(x) for x in warc.coalesced(rows, 5, 100)] == [2, 1, 1, 1, 1]


OPERATORS = {
    "simhash": lambda d: simhash.near_duplicates(d),
    "near": lambda d: similar.drop_near_duplicates(d),
    "mix": lambda d: mixing.mix(d),
    "mixed": lambda d: mixing.mixed(d),
    "shard": lambda d: sharding.shard_by_bytes(d, 5),
    "exact": lambda d: exact_dedup.exact_duplicates(d),
    "drop_exact": lambda d: exact_dedup.drop_exact_duplicates(d),
    "lines": lambda d: line_dedup.dedup_lines(d),
    "lines_far": lambda d: line_dedup.dedup_lines(d, broadcast_limit=0),
    "quality": lambda d: quality.judge(d),
    "drop_quality": lambda d: quality.drop_low_quality(d),
    "lm": lambda d: lm.score(d),
    "bpe": lambda d: bpe.encode(d, queries.ranks_path()),
    "substring": lambda d: substring_dedup.dedup_substrings(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, empty):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("near", "mix", "mixed", "drop_exact", "drop_quality")])
def test_awkward_table_gives_a_row_for_each(name, awkward):
    assert OPERATORS[name](awkward).count() == awkward.count()


@pytest.mark.parametrize("name", ["near", "mixed", "drop_exact", "drop_quality", "lines"])
def test_awkward_table_keeps_columns(name, awkward):
    out = OPERATORS[name](awkward)
    kept = [c for c in out.columns if c not in ("n_lines", "n_dropped")]
    assert kept == awkward.columns and out.select("doc").distinct().count() <= 1


def ids_of(df):
    return sorted((r["doc_id"] for r in rows_of(df)), key=lambda i: (i is None, i or 0))


def test_awkward_rows_stay_or_go_by_themselves(spark, awkward):
    assert ids_of(similar.drop_near_duplicates(awkward)) == [1, 4, 5, 6, 7, 10, 11]
    assert ids_of(exact_dedup.drop_exact_duplicates(awkward)) == [2, 3, 4, 4, 5, 6, 8, 9, 10, 11]
    times, rows = Counter(ids_of(mixing.mixed(awkward, max_repeats=3.0))), Counter(ids_of(awkward))
    assert times.keys() == rows.keys() and all(times[i] >= n for i, n in rows.items()) and max(times.values()) <= 8
    prose = [" ".join(f"w{(i * k * 7919) % 997}" for k in range(1, 200)) for i in range(1, 60)]
    rows = [(None, prose[0], "en"), (None, "short", "en"), (7, prose[1], "en"), (7, "short", "en"), (8, prose[2], None), *((100 + i, t, "en") for i, t in enumerate(prose))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    judged = Counter((r["doc_id"], r["n_words"]) for r in rows_of(quality.judge(docs)) if r["kept"])
    kept = Counter((r["doc_id"], len(brute.words(r["text"]))) for r in rows_of(quality.drop_low_quality(docs)))
    assert kept == judged and kept[7, 199] == 1 and kept[7, 1] == 0 and kept[None, 1] == 0


def test_rows_alike_in_all_but_the_rest_leave_one(spark):
    rows = [(1, "a b c d e f", "y"), (1, "a b c d e f", "x"), (None, "q r s t u v", "z"), (None, "q r s t u v", "z"), (2, "a b c d e f", "a")]
    got = rows_of(similar.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, __row string")))
    assert sorted((str(r["doc_id"]), r["__row"]) for r in got) == [("1", "x"), ("None", "z")]


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, empty, tmp_path):
    import corpus_pipeline

    words = " ".join(f"w{i * 7919 % 997}" for i in range(300))
    more = spark.createDataFrame([(20, words, "en", None), (20, words, "en", None), (None, words + " end", "en", "a"), (21, "x " + words, None, "a")], "doc_id long, text string, lang string, source string")
    docs = awkward.unionByName(more, allowMissingColumns=True)
    for name, rows in (("some", docs), ("none", empty)):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert got.columns == [c for c in awkward.columns if c != "text"] + ["ids", "offsets"]
        assert got.count() == 0 if name == "none" else set(ids_of(got)) <= {7, 8, 9, 11, 20, 21, None}


def test_lines_of_repeated_ids_agree_with_sql(spark, tmp_path):
    line = "a line that is long enough"
    rows = [(1, line + "\n1"), (1, line + "\n2"), (2, line), (None, line + "\nx"), (3, "y\n" + line.upper()), (3, line + " ")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = queries.QUERIES["op5_line_dedup"](spark, str(tmp_path)), db.sql(queries.ORACLES["op5_line_dedup"])
    columns = sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want.select(*columns).fetchall()))


def test_columns_named_as_counts_stay(spark):
    docs = spark.createDataFrame([(1, "a\nb", 999)], "doc_id long, text string, n_lines int")
    assert [tuple(r) for r in line_dedup.drop_repeated_lines(docs).collect()] == [(1, "a\nb", 999)]


def test_empty_archives_and_tokens(spark, empty, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.write_archives(pages, f"file://{tmp_path}/none")
    assert index.collect() == [] and warc.read_records(index).collect() == []
    assert bpe.decode(bpe.encode(empty, queries.ranks_path()), queries.ranks_path()).collect() == []


def test_awkward_results(awkward):
    groups = {r["doc_id"]: r["component_id"] for r in rows_of(simhash.near_duplicates(awkward)) if r["doc_id"]}
    assert groups[1] == groups[2] == groups[3] == 1 and groups[7] == groups[9] == 7
    exact = {r["doc_id"]: r for r in rows_of(exact_dedup.exact_duplicates(awkward)) if r["doc_id"]}
    assert exact[1]["keep_id"] == 2 and exact[9]["kept"] and not exact[7]["kept"] and exact[4]["group_size"] == 2
    lines = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in rows_of(line_dedup.dedup_lines(awkward)) if r["doc_id"]}
    assert lines[4] == ("x", 2) and lines[5] == ("other", 1) and lines[6][1] == 0 and lines[1] == (None, 0)
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in rows_of(substring_dedup.dedup_substrings(awkward)) if r["doc_id"]}
    assert cut[7][1] == 0 and cut[8] == (60_001, 60_000) and cut[9] == (60_000, 60_000)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_queries_agree_with_their_sql(name, spark, sf):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf), db.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(want.select(*columns).fetchall(), key=str)


def test_sql_of_pages_with_equal_payloads(spark, tmp_path):
    rows = [(5, "u", "same"), (2, "u", "same"), (3, "u", None), (9, "u", ""), (4, "u", "\u00e9<p>"), (7, "u", "same")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, want = queries.QUERIES["op10_warc"](spark, str(tmp_path)), db.sql(queries.ORACLES["op10_warc"])
    columns = sorted(got.columns)
    found = sorted(map(tuple, got.select(columns).collect()), key=str)
    assert found == sorted(want.select(*columns).fetchall(), key=str)
    assert {(r["page_id"], r["refers_to"]) for r in got.collect()} == {(2, None), (5, 2), (7, 2), (3, None), (9, 3), (4, None)}


def test_pipeline(spark, sf, pairs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mix_sources", "bpe_tokens"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, dict(pairs)
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert kept.columns == columns
    good = {r["doc_id"] for r in rows_of(quality.judge(docs)) if r["kept"]}
    assert {r["doc_id"]: r["text"] for r in rows_of(kept)} == {i: texts[i] for i in good}
    kept = common.durable(kept)
    lines = common.durable(corpus_pipeline.STAGES[1][1](spark, kept, sf))
    want = brute.dedup_lines([(i, texts[i]) for i in sorted(good)])
    got = {r["doc_id"]: r["text"] for r in rows_of(lines)}
    assert lines.columns == columns and {i: brute.sha(t.encode()) for i, t in got.items()} == {i: w[2] for i, w in want.items()}
    near = common.durable(corpus_pipeline.STAGES[2][1](spark, lines, sf))
    left = {r["doc_id"]: r["text"] for r in rows_of(near)}
    sets = {i: shingles(t) for i, t in got.items()}
    groups = brute.components(sorted(got), lambda i, j: 4 * len(sets[i]) <= 5 * len(sets[j]) <= 6.25 * len(sets[i]) and jaccard(sets[i], sets[j]) >= 0.8)
    assert near.columns == columns and set(left) >= {i for i, g in groups.items() if g == i}
    assert len(set(left) - {i for i, g in groups.items() if g == i}) <= 0.02 * (len(got) - len(set(groups.values())))
    mixed = common.durable(corpus_pipeline.STAGES[3][1](spark, near, sf))
    times = Counter(r["doc_id"] for r in rows_of(mixed))
    assert mixed.columns == columns and set(times) == set(left) and max(times.values()) <= 3
    tokens = corpus_pipeline.STAGES[4][1](spark, mixed, sf)
    assert Counter(r["doc_id"] for r in rows_of(tokens)) == times
