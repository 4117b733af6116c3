"""Groups of similar texts: candidates by covering locality-sensitive hashing,
then an exact check of the Jaccard similarity of distinct word shingles.

A text has ``views`` independent SimHash fingerprints of ``BITS`` bits, each
with the covering tables of ``radius``. All texts that share a key of any table
are compared over the first 128 bits of the fingerprints, so that pairs beyond
the radius are found wherever a table has them together. What this links is a
family. Families only bound what is compared; they are never a result.

Within a family every pair is compared exactly, except that a text is not
compared again with those it is already joined to. A family of more than
``block_texts`` texts is dealt into blocks twice, by two hashes, and joined
within them; then all texts outside its largest group meet every block. So each
pair of a family is joined or was compared, in tasks of bounded size.

Texts with the same lower-cased words are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwright.llm.common import checked_broadcast, components, durable, give_back, raw, ship, slices
from logwright.llm.simhash import covering_masks, mixed_hashes
from logwright.llm.substring_dedup import window_hashes

#: Bits of a fingerprint: keys then keep about 24 of them.
BITS = 48
#: Of 128 bits, so many may differ. Texts of similarity 0.8 differ in 19 on
#: average, with a standard deviation of 4; unlike ones in 64, and 5.7.
NEAR = 34
#: A key that so many of 2048 texts have joins them without a comparison.
CROWD, LOT = 64, 2048


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words has
    one, its whole sequence, which may be empty."""
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(window_hashes(np.array([digest(w) for w in words], np.uint64), shingle))


def prints(sets: list[np.ndarray], views: int) -> np.ndarray:
    """Fingerprints of sets that are not empty, as rows of views * BITS / 8
    bytes."""
    width = BITS // 8
    counts = np.zeros((len(sets), views * BITS), np.int32)
    lengths = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), lengths)
    for at in range(0, len(flat), 1 << 14):
        part, own = flat[at : at + (1 << 14)], owner[at : at + (1 << 14)]
        packed = np.concatenate([mixed_hashes(part, v + 1).view(np.uint8).reshape(-1, 8)[:, :width] for v in range(views)], axis=1)
        ones = np.unpackbits(packed, axis=1, bitorder="little").view(np.uint64)
        # eight sums in a word, of 255 ones at most
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        edges = np.append(new, len(own))
        starts = np.concatenate([np.arange(a, b, 255) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())])
        sums = np.add.reduceat(ones, starts, axis=0).view(np.uint8)
        counts[own[new]] += np.add.reduceat(sums, np.searchsorted(starts, new), axis=0, dtype=np.int32)
    return np.packbits(2 * counts > lengths[:, None], axis=1, bitorder="little")


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def nodes(docs: DataFrame, shingle: int, views: int, id_col: str, text_col: str) -> DataFrame:
    """(id, t, node, print), a row for each of ``docs``: t tells apart the
    texts of rows that share an id, node those of unlike words."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            words = [_words(t) for t in batch.column("text").to_pylist()]
            node = np.array([xxhash.xxh3_64_intdigest(b" ".join(w)) for w in words], np.uint64)
            found = prints([shingle_set(w, shingle) for w in words], views)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), pa.array(node.view(np.int64)), pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "t", "node", "print"])

    source = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("t"), raw(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, t bigint, node bigint, print binary")


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _spots(sketch: np.ndarray) -> np.ndarray:
    """A number for each sketch [n, 2] of 128 bits."""
    return mixed_hashes(sketch[:, 0], 9) ^ mixed_hashes(mixed_hashes(sketch[:, 1], 10), 11)


def _sketches(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x[:16] for x in found), np.uint64).reshape(-1, 2)


def _linked(sketch: np.ndarray, most: int) -> np.ndarray:
    """Pairs of places [n, 2], at most one less than there are sketches, that
    join those which near pairs connect; without a comparison if there are over
    ``most``."""
    if len(sketch) > most:
        return np.stack([np.zeros(len(sketch) - 1, np.int64), np.arange(1, len(sketch))], axis=1)
    left, out = np.arange(len(sketch)), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(sketch[left] ^ sketch[at]).sum(1) <= NEAR
            if near.any():
                found, left = left[near], left[~near]
                out.append(np.stack([np.full(len(found), at), found], axis=1))
                front += found.tolist()
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys, and where runs of equal ones begin and end in it."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order, first, np.append(first[1:], len(keys))


def _forest(links: np.ndarray) -> np.ndarray:
    """Links [n, 2] to the least number of each component, distinct."""
    values, ends = np.unique(links, return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    root = np.arange(len(values))
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            break
    far = np.flatnonzero(root != np.arange(len(values)))
    return np.stack([values[root[far]], values[far]], axis=1)


def family_links(found: DataFrame, texts: int, views: int, radius: int, bucket_limit: int = 8192) -> DataFrame:
    """(a, b): links of sketches' numbers, so that those of texts which share
    a key of some table and are near are connected. ``found``: (print), of
    about ``texts`` rows.

    Keys are dealt to parts of bounded size. In a lot of texts a crowded key is
    joined on the spot and one text goes on for all, so that no part grows with
    the share that one key has."""
    masks = np.array(covering_masks(radius, bits=BITS), np.uint64)
    tables = views * len(masks)
    parts = max(1, -(-texts * tables // 100_000))
    salt = mixed_hashes(np.arange(tables, dtype=np.uint64), 12)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, LOT):
                rows = whole.slice(at, LOT).column("print").to_pylist()
                n, sketch = len(rows), _sketches(rows)
                wide = np.zeros((n, views, 8), np.uint8)
                wide[:, :, : BITS // 8] = np.frombuffer(b"".join(rows), np.uint8).reshape(n, views, -1)
                key = mixed_hashes((wide.view(np.uint64) & masks).reshape(n, tables) ^ salt, 13).ravel()
                order, first, end = _runs(key)
                going, links = np.ones(len(key), bool), []
                for a, b in zip(first[end - first > CROWD].tolist(), end[end - first > CROWD].tolist()):
                    members = order[a:b]
                    going[members[1:]] = False
                    links.append(np.stack([np.full(b - a - 1, members[0]), members[1:]], axis=1) // tables)
                left = np.flatnonzero(going)
                part = ((key[left] >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
                order, first, end = _runs(part)
                left, data = left[order], []
                for a, b in zip(first.tolist(), end.tolist()):
                    mine = left[a:b]
                    data.append(sketch[mine // tables].tobytes() + key[mine].astype(np.uint32).tobytes())
                number, kind = part[order[first]].tolist(), [0] * len(data)
                if links:
                    spots = _spots(sketch)
                    number.append(int(spots[0] % np.uint64(parts)))
                    kind.append(1)
                    data.append(_forest(spots[np.concatenate(links)]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["part", "kind", "data"])
        give_back()

    def meet(rows: pa.Table) -> pa.Table:
        out, key, sketch = [np.zeros((0, 2), np.uint64)], [], []
        for kind, data in zip(rows.column("kind").to_pylist(), rows.column("data").to_pylist()):
            if kind:
                out.append(np.frombuffer(data, np.uint64).reshape(-1, 2))
            else:
                n = len(data) // 20
                sketch.append(np.frombuffer(data, np.uint64, 2 * n).reshape(-1, 2))
                key.append(np.frombuffer(data, np.uint32, n, 16 * n))
        if key:
            key, sketch = np.concatenate(key), np.concatenate(sketch)
            spots = _spots(sketch)
            order, first, end = _runs(key)
            pair = first[end - first == 2]
            a, b = order[pair], order[pair + 1]
            near = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1) <= NEAR
            out.append(np.stack([spots[a[near]], spots[b[near]]], axis=1))
            for lo, hi in zip(first[end - first > 2].tolist(), end[end - first > 2].tolist()):
                mine = order[lo:hi]
                _, one = np.unique(spots[mine], return_index=True)
                if len(one) > 1:
                    mine = mine[one]
                    out.append(spots[mine[_linked(sketch[mine], bucket_limit)]])
        links = _forest(np.concatenate(out)).view(np.int64)
        give_back()
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    # few small rows make many: spread them before they grow
    spread = found.select("print").repartition(2 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = spread.mapInArrow(keys, "part int, kind int, data binary")
    return keyed.groupBy("part").applyInArrow(meet, "a bigint, b bigint").distinct()


def _tree(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that join all sets which similar pairs connect: every set is
    compared with all that are not joined to it."""
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    marked, left, flat, out = np.zeros(codes.max() + 1, bool), np.arange(len(sets)), codes, []

    def without(gone: np.ndarray) -> None:
        nonlocal left, flat
        flat, left = flat[np.repeat(~gone, sizes[left])], left[~gone]

    while len(left) > 1:
        front = [int(left[0])]
        without(left == front[0])
        while front and len(left):
            at = front.pop()
            mine = codes[bounds[at] : bounds[at + 1]]
            marked[mine] = True
            both = np.add.reduceat(marked[flat], np.cumsum(sizes[left]) - sizes[left], dtype=np.int64)
            marked[mine] = False
            alike = both >= least * (sizes[at] + sizes[left] - both)
            if alike.any():
                out += [(at, x) for x in left[alike].tolist()]
                front += left[alike].tolist()
                without(alike)
    return out


def _across(others: list[np.ndarray], tags: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, least: float) -> list[tuple[int, int]]:
    """For each of ``others``, one similar set of every other label."""
    sizes = np.array([len(s) for s in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    begins, marked, out = np.cumsum(sizes) - sizes, np.zeros(len(values), bool), []
    for i, other in enumerate(others):
        at = np.searchsorted(values, other).clip(max=len(values) - 1)
        mine = at[values[at] == other]
        marked[mine] = True
        both = np.add.reduceat(marked[codes], begins, dtype=np.int64)
        marked[mine] = False
        alike = np.flatnonzero((both >= least * (len(other) + sizes - both)) & (labels != tags[i]))
        out += [(i, x) for x in alike[np.unique(labels[alike], return_index=True)[1]].tolist()]
    return out


def _pairs(nodes_: np.ndarray, found: list[tuple[int, int]], of: np.ndarray | None = None) -> list[tuple[int, int]]:
    return [(int((nodes_ if of is None else of)[i]), int(nodes_[j])) for i, j in found]


def _arrow_links(found: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*found) if found else ((), ())
    give_back()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def similar_links(members: DataFrame, least: float, block_texts: int, block_bytes: int) -> DataFrame:
    """(a, b): links of nodes that connect exactly those which chains of
    similar pairs of one family connect. ``members``: (family, node, set), a
    durable result; set has the bytes of the sorted hashes."""

    def within(rows: pa.Table) -> pa.Table:
        family, node = (rows.column(c).to_numpy() for c in ("family", "node"))
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()]
        order, first, end = _runs(family)
        out = []
        for a, b in zip(first.tolist(), end.tolist()):
            mine = order[a:b]
            if b - a > 1:
                out += _pairs(node[mine], _tree([sets[i] for i in mine.tolist()], least))
        return _arrow_links(out)

    def across(rows: pa.Table) -> pa.Table:
        node, label, outside = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "outside"))
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()]
        here, there = np.flatnonzero(~outside), np.flatnonzero(outside)
        if not len(here) or not len(there):
            return _arrow_links([])
        found = _across([sets[i] for i in there], label[there], [sets[i] for i in here], label[here], least)
        return _arrow_links(_pairs(node[here], found, node[there]))

    schema = "a bigint, b bigint"
    sizes = durable(members.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("set")).alias("bytes")))
    blocks = F.ceil(F.greatest(F.col("n") / block_texts, F.col("bytes") / block_bytes))
    sized = members.join(checked_broadcast(sizes.select("family", blocks.alias("blocks")), 16), "family")
    small, large = sized.where("blocks = 1"), sized.where("blocks > 1")
    total = sizes.where(blocks == 1).agg(F.sum("bytes")).first()[0] or 0
    lots = -(-total // block_bytes) or 1
    links = small.select(F.pmod(F.xxhash64("family"), F.lit(lots)).alias("lot"), "family", "node", "set").groupBy("lot").applyInArrow(within, schema)
    if sizes.where(blocks > 1).isEmpty():
        return durable(links)
    dealt = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.col("blocks"))
    twice = [large.select("family", dealt(k).alias("block"), "node", "set").groupBy("family", "block").applyInArrow(within, schema) for k in (1, 2)]
    joined = durable(twice[0].unionAll(twice[1]))
    label = F.coalesce("component", "node").alias("label")
    labelled = durable(large.join(components(joined), "node", "left").select("family", "blocks", "node", "set", label))
    counts = labelled.groupBy("family", "label").agg(F.count(F.lit(1)).alias("c"))
    top = durable(counts.groupBy("family").agg(F.max_by("label", F.struct("c", "label")).alias("top"), (F.sum("c") - F.max("c")).alias("others")).where("others > 0"))
    if not top.isEmpty():
        rows = labelled.join(checked_broadcast(top, 32), "family")
        lots_of = F.ceil(F.greatest(F.col("others") / block_texts, F.lit(1)))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
        in_lot = F.pmod(F.xxhash64("node", F.lit(3)), lots_of)
        here = rows.select("family", dealt(1).alias("block"), every(lots_of).alias("lot"), "node", "set", "label", F.lit(False).alias("outside"))
        there = rows.where("label <> top").select("family", every(F.col("blocks")).alias("block"), in_lot.alias("lot"), "node", "set", "label", F.lit(True).alias("outside"))
        joined = joined.unionAll(here.unionAll(there).groupBy("family", "block", "lot").applyInArrow(across, schema))
    return durable(links.unionAll(joined))


def groups(
    docs: DataFrame, shingle: int = 5, min_similarity: float = 0.8, views: int = 7, radius: int = 4, block_texts: int = 1024, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, t, grp): the group of each row of ``docs`` that is in one with
    another row. t is ``text_key`` of the text."""
    ship(docs.sparkSession)
    rows = durable(nodes(docs, shingle, views, id_col, text_col))
    classes = durable(rows.groupBy("node").agg(F.min("print").alias("print"), F.min(F.struct("id", "t")).alias("one"), F.count(F.lit(1)).alias("rows")))
    links = durable(family_links(classes.select("print").distinct(), classes.count(), views, radius))
    families = durable(components(links))

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = _spots(_sketches(batch.column("print").to_pylist())) if batch.num_rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(spot.view(np.int64)), batch.column("id"), batch.column("t")], names=["node", "spot", "id", "t"])

    kind = rows.schema["id"].dataType.simpleString()
    placed = classes.select("node", "print", "one.id", "one.t").mapInArrow(spots, f"node bigint, spot bigint, id {kind}, t bigint")
    named = checked_broadcast(families.select(F.col("node").alias("spot"), "component"), 16)
    placed = durable(placed.join(named, "spot", "left").select("node", "id", "t", F.coalesce("component", "spot").alias("family")))
    several = durable(placed.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("family"))
    wanted = durable(placed.join(checked_broadcast(several, 8), "family", "left_semi"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = [shingle_set(_words(t), shingle).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("family"), batch.column("node"), pa.array(found, pa.binary())], names=["family", "node", "set"])

    source = docs.select(F.col(id_col).alias("i"), text_key(text_col).alias("k"), raw(text_col).alias("text"))
    texts = source.join(checked_broadcast(wanted, 40), F.col("i").eqNullSafe(F.col("id")) & (F.col("k") == F.col("t"))).select("family", "node", "text")
    members = texts.mapInArrow(sets, "family bigint, node bigint, set binary")
    # a node's text may stand in several rows
    members = durable(members.groupBy("node").agg(F.first("family").alias("family"), F.first("set").alias("set")))
    joined = durable(components(similar_links(members, min_similarity, block_texts, block_bytes)))
    grouped = classes.select("node", "rows").join(checked_broadcast(joined, 16), "node", "left")
    grouped = durable(grouped.where("rows > 1 or component is not null").select("node", F.coalesce("component", "node").alias("grp")))
    return rows.join(checked_broadcast(grouped, 16), "node").select("id", "t", "grp")


def _winner() -> Column:
    """The row of a group that stays: the smallest doc_id, null last."""
    return F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("t")))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, component_id) of each row in a group with another: chains of
    pairs whose Jaccard similarity of distinct ``shingle``-word shingles
    (lower-cased A-Z) is at least ``min_similarity``; component_id is the
    group's smallest doc_id, null only if it has no other.

    A pair of that similarity is missed only if no table of ``views`` times
    2^(radius+1) - 1 has both in a bucket and no chain joins them: under one in
    ten at 0.8 exactly, one in thirty from 0.8 to 0.85, none to speak of above
    0.9. Null, empty and blank texts are alike. A text of fewer words than a
    shingle has one, its whole sequence. Rows that repeat a doc_id, and rows
    with a null one, count each by its text. An empty table gives no rows."""
    found = durable(groups(docs, id_col=id_col, text_col=text_col, **how))
    heads = durable(found.groupBy("grp").agg(_winner().alias("head")))
    return found.join(checked_broadcast(heads, 32), "grp").select(F.col("id").alias(id_col), F.col("head.id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each group of ``similar_documents``, and all rows in none,
    with all columns: the row with the smallest doc_id, null last. Of several
    with that doc_id the text of the smaller hash stays; of rows alike in both,
    that whose other columns come first."""
    found = durable(groups(docs, id_col=id_col, text_col=text_col, **how))
    heads = durable(found.groupBy("grp").agg(_winner().alias("head")))
    stays = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("t") == F.col("head.t"))
    judged = found.join(checked_broadcast(heads, 32), "grp").groupBy("id", "t").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("times"))
    judged = durable(judged.where("not stays or times > 1").select(F.col("id").alias("__id"), F.col("t").alias("__t"), "stays"))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (text_key(text_col) == F.col("__t"))
    kept = docs.join(checked_broadcast(judged.select("__id", "__t"), 24), same, "left_anti").select(*docs.columns)
    again = judged.where("stays").select("__id", "__t")
    if again.isEmpty():
        return kept
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col), F.col(text_col)).join(checked_broadcast(again, 24), same)
    first = rows.groupBy("__id", "__t").agg(F.min("__row").alias("__row"))
    return kept.unionByName(first.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))
