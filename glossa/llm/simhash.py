"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: word shingles, repeats included, hashed with XXH64 (seed 42); further 64-bit words of a wider
fingerprint are mixed from the same hash. A bit is 1 where over half of the hashes have it. With `distinct` every
shingle counts once, as in set similarity; else a line repeated within a text takes over its fingerprint.

Links: equal fingerprints are one node. A node is filed under keys, so that every pair within the radius shares one.
For a 64-bit fingerprint the keys are the combinations of blocks that two fingerprints with `radius` differing bits
must agree in, with so many blocks that a key stays selective for the number of nodes (4 blocks up to 4 million
nodes, 5 up to 2 billion, then 6); this is exact whatever their number. All nodes are range-partitioned and sorted
by key and Gray rank: neighbours differ in few bits, so runs of 32 share a long masked pattern, and 8 patterns make a
node one level up. The search descends from the root in pairs of nodes; a pair whose shared bits differ in any bit of
the key, or in more than `radius` bits in all, is pruned with all below it. Links leave as a spanning forest, never
as pairs, so output is linear. A key above `tile_rows` is cut into tiles that meet two by two, so that it isn't one
task.

`similar_groups` decides links by the exact Jaccard similarity of distinct shingle sets, and fingerprints only
propose them: equal sets are one node, keys are MinHash bands of the set, of which those that one node alone has are
dropped before anything else moves, and the groups that the radius gives are candidates. Within a candidate group
every pair is settled on the sets themselves, directly or through others. A group above `tile_docs` is cut into
tiles. All of them meet the first one; only what is then still apart from the group's largest part meets all tiles,
so a group of near copies of one text takes linear work.

Defined cases: a null or blank text has the zero fingerprint (the empty set) and links as any other. Rows without a
doc_id link as any other; a component's id is its smallest doc_id, null if it has none. Repeated rows are equal
fingerprints; `one_of_each` keeps one of them. Other columns of docs are never looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import hinted, materialize
from glossa.llm.components import components
from glossa.plans.session import ship

LEAF, FAN, CHUNK = 32, 8, 1 << 20
SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8).astype(np.int64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    import xxhash

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    if len(ws) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(ws), SEED)], np.uint64)
    flat, size = b" ".join(ws), np.fromiter(map(len, ws), np.int64, len(ws))
    end = np.cumsum(size + 1) - 1
    starts, ends = (end - size)[: len(ws) - width + 1].tolist(), end[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:z], SEED) for a, z in zip(starts, ends, strict=True)], np.uint64)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """The hashes themselves for word 0, else a finaliser over hash + word * golden ratio."""
    if not word:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(word)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, highest bit first."""
    rows = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        return np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(rows[:, i], minlength=256) @ _BITS for i in range(8)])


def fingerprint(h: np.ndarray, n_words: int) -> np.ndarray:
    """The 64-bit words of the fingerprint of shingle hashes."""
    if not len(h):
        return np.zeros(n_words, np.uint64)
    counts = np.concatenate([bit_counts(_mixed(h, i)) for i in range(n_words)])
    return np.packbits(2 * counts > len(h)).view(">u8").astype(np.uint64)


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _minhash_keys(h: np.ndarray, bands: int, band_rows: int, by: np.ndarray) -> np.ndarray:
    """A band value for each band: a hash of `band_rows` MinHash values of the distinct hashes; none of an empty set."""
    import xxhash

    if not len(h):
        return np.empty(0, np.int64)
    least = np.min([(h[i : i + 1024, None] * by).min(axis=0) for i in range(0, len(h), 1024)], axis=0).reshape(bands, band_rows)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(least)], np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, width: int = 3, n_words: int = 1, bands: int = 0, band_rows: int = 0, distinct: bool = False) -> DataFrame:
    """doc_id, text_hash, f0.. (64-bit words as longs) of every row; with `bands` also s0, s1 (a hash of the shingle set) and keys.

    Only texts go to Python, so ids and hashes stay as they are.
    """
    ship(docs.sparkSession)
    names = [f"f{i}" for i in range(n_words)]
    fields = ", ".join([f"{n} long" for n in names] + ["s0 long, s1 long, keys array<long>"] * bool(bands))

    @F.pandas_udf(fields)
    def prints(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        sets = [shingle_hashes(t, width) for t in texts]
        if distinct:
            sets = [np.unique(h) for h in sets]
        words = np.array([fingerprint(h, n_words) for h in sets], np.uint64).reshape(-1, n_words).view(np.int64)
        out = {n: words[:, i] for i, n in enumerate(names)}
        if bands:
            whole = np.frombuffer(b"".join(xxhash.xxh128_digest(h.tobytes()) for h in sets), np.int64).reshape(-1, 2)
            by = _multipliers(bands * band_rows)
            out |= {"s0": whole[:, 0], "s1": whole[:, 1], "keys": [_minhash_keys(h, bands, band_rows, by) for h in sets]}
        return pd.DataFrame(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), prints("text").alias("p")).select("doc_id", "text_hash", "p.*")


def gray_rank(c: Column) -> Column:
    """The position of a 64-bit value in Gray order, as a long."""
    for shift in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, shift))
    return c


def block_count(nodes: int, radius: int) -> int:
    """The fewest blocks of which the `blocks - radius` that agree leave about 64 nodes a key, or fewer."""
    return next((b for b in range(radius + 1, 2 * radius + 1) if nodes >> (64 * (b - radius) // b) <= 64), 2 * radius + 1)


def block_keys(f: Column, blocks: int, radius: int) -> Column:
    """(band, key) for each combination of blocks that must agree; key: the fingerprint's bits there."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    mask = lambda chosen: sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in chosen)
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
    return F.array(
        *(
            F.struct(F.lit(i).alias("band"), f.bitwiseAND(signed(mask(chosen))).alias("key"))
            for i, chosen in enumerate(combinations(range(blocks), blocks - radius))
        )
    )


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


class _Forest:
    """Union of array positions; the root is the smallest."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _tree(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, pattern) of the groups at each level, leaves first: the bits that all rows below share, and their values."""
    same = np.full_like(x, ~np.uint64(0))
    levels, value, step = [], x, LEAF
    while True:
        cuts = np.arange(0, len(value), step)
        mask = np.bitwise_and.reduceat(same, cuts, axis=0)
        mask &= ~(np.bitwise_or.reduceat(value, cuts, axis=0) & ~np.bitwise_and.reduceat(value, cuts, axis=0))
        value, same, step = value[cuts] & mask, mask, FAN
        levels.append((mask, value))
        if len(cuts) == 1:
            return levels


def link_rows(x: np.ndarray, radius: int, heads: int = 0) -> np.ndarray:
    """The position that each Gray-ordered row is linked to, directly or through others.

    The first `heads` words of two rows must be equal, the others may differ in up to radius bits in all.
    """
    n, forest = len(x), _Forest(len(x))
    levels = _tree(x)

    def near(d: np.ndarray) -> np.ndarray:
        return (_popcount(d[:, heads:]) <= radius) & ~d[:, :heads].any(axis=1)

    a = b = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        mask, value = levels[depth]
        if depth < len(levels) - 1:
            off = np.arange(FAN)
            a, b = (a[:, None, None] * FAN + off[:, None]).repeat(FAN, 2), (b[:, None, None] * FAN + off).repeat(FAN, 1)
            keep = (a < len(mask)) & (b < len(mask)) & (a <= b)
            a, b = a[keep], b[keep]
        close = [np.empty(0, bool)]
        for i in range(0, len(a), CHUNK):
            p, q = a[i : i + CHUNK], b[i : i + CHUNK]
            close.append(near((value[p] ^ value[q]) & mask[p] & mask[q]))
        close = np.concatenate(close)
        a, b = a[close], b[close]
    off, step = np.arange(LEAF), max(1, CHUNK // (LEAF * LEAF * x.shape[1]))
    for i in range(0, len(a), step):
        p = (a[i : i + step, None, None] * LEAF + off[:, None]).repeat(LEAF, 2)
        q = (b[i : i + step, None, None] * LEAF + off).repeat(LEAF, 1)
        keep = (p < q) & (q < n)
        p, q = p[keep], q[keep]
        for word in range(heads):
            same = x[p, word] == x[q, word]
            p, q = p[same], q[same]
        apart = forest.root[p] != forest.root[q]
        p, q = p[apart], q[apart]
        close = _popcount(x[p, heads:] ^ x[q, heads:]) <= radius
        forest.join(p[close], q[close])
    return forest.root


def _whole_buckets(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The rows again, cut between buckets (the columns `by`) only."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        rest.append(pdf)
        key = pdf[by].to_numpy()
        if (key[-1] == rest[0][by].iloc[0].to_numpy()).all():
            continue  # one bucket so far
        last = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1
        whole = pd.concat([*rest[:-1], pdf.iloc[:last]])
        rest = [pdf.iloc[last:]]
        yield whole
    if rest:
        yield pd.concat(rest)


def collisions(keyed: DataFrame) -> DataFrame:
    """The rows of keyed (band, key, id) whose key other rows have too, and a few others: single ones at partition borders.

    Sorted neighbours are compared as they stream by, so that no key is a group, however many rows it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_on = None, True  # the last row so far, and whether it's to stay
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            band, key = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("band", "key"))
            same = (band[1:] == band[:-1]) & (key[1:] == key[:-1])
            keep = np.r_[held_on, same] | np.r_[same, False]
            last = rows.num_rows - 1
            held, held_on = rows.slice(last), bool(keep[last])
            yield rows.slice(0, last).filter(pa.array(keep[:last]))
        if held is not None:
            yield held

    return keyed.repartitionByRange("band", "key", "id").sortWithinPartitions("band", "key", "id").mapInArrow(run, keyed.schema)


def tree_links(rows: DataFrame, n_words: int, radius: int, tile_rows: int) -> DataFrame:
    """Links (a, b) between the ids of rows (band, key, id, f0..) that share a key and differ in up to radius bits."""
    words = [f"f{i}" for i in range(n_words)]
    by = ["band", "key", "t1", "t2"]
    tiles = materialize(
        rows.groupBy("band", "key").count().where(F.col("count") > tile_rows).select("band", "key", F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles")),
        "tiles",
    )  # known before the join, so that the rows aren't shuffled for a join with nothing
    if tiles.isEmpty():
        cut = rows.withColumns({"t1": F.lit(0), "t2": F.lit(0)})
    else:
        tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
        cut = (
            rows.join(hinted(tiles), ["band", "key"], "left")
            .withColumn("t", F.coalesce(tile, F.lit(0)))
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles"), F.lit(1)) - 1)))
            .withColumns({"t1": F.least("t", "o"), "t2": F.greatest("t", "o")})
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_buckets(batches, by):
            x = np.ascontiguousarray(pdf[["band", "key", *words]].to_numpy().astype(np.int64)).view(np.uint64)
            ids = pdf["id"].to_numpy()
            to = ids[link_rows(x, radius, heads=2)]
            yield pd.DataFrame({"a": ids[ids != to], "b": to[ids != to]})

    ranked = cut.select(*by, "id", *words, gray_rank(F.col("key")).alias("rank"))
    order = ["band", "rank", "t1", "t2"]
    return ranked.repartitionByRange(*order).sortWithinPartitions(*order, gray_rank(F.col("f0"))).drop("rank").mapInPandas(run, "a long, b long")


def near_groups(docs: DataFrame, width: int = 3, radius: int = 3, tile_rows: int = 20_000, distinct: bool = False) -> DataFrame:
    """doc_id, f0, component_id for every row of docs: fingerprints within `radius` bits, directly or through others."""
    prints = materialize(fingerprints(docs, width, distinct=distinct).drop("text_hash"), "prints")
    nodes = materialize(prints.groupBy("f0").agg(F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id()), "nodes")
    blocks = block_count(nodes.count(), radius)
    keyed = nodes.select("id", "f0", F.inline(block_keys(F.col("f0"), blocks, radius)))
    found = components(tree_links(keyed, 1, radius, tile_rows), "stars")
    return prints.join(_of_component(nodes, found, "least", "component_id").select("f0", "component_id"), "f0").select("doc_id", "f0", "component_id")


def _of_component(nodes: DataFrame, found: DataFrame, value: str, name: str) -> DataFrame:
    """nodes (id, value, ...) with the least value, nulls last, of their component as `name`; found: (node, root)."""
    linked = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    member = linked.join(nodes.select(F.col("id").alias("node"), value), "node")
    least = member.groupBy("root").agg(F.min(value).alias("least_of"))
    of = member.join(least, "root").select("node", "least_of")
    return nodes.join(of, nodes["id"] == of["node"], "left").withColumn(name, F.when(F.col("node").isNull(), F.col(value)).otherwise(F.col("least_of"))).drop("node", "least_of")


def link_sets(sets: list[np.ndarray], part: np.ndarray, similarity: Fraction) -> np.ndarray:
    """The position that each set of distinct values is linked to, directly or through others; rows of a part are linked."""
    forest, p, q = _Forest(len(sets)), similarity.numerator, similarity.denominator
    _, first, of = np.unique(part, return_index=True, return_inverse=True)
    forest.join(np.arange(len(sets)), first[of])
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    mark = np.zeros(len(codes), bool)
    for i in range(len(sets) - 1):
        at = np.flatnonzero(forest.root[i + 1 :] != forest.root[i]) + i + 1
        if not len(at):
            continue
        own = codes[start[i] : start[i] + size[i]]
        mark[own] = True
        shared = np.add.reduceat(mark[codes[start[i + 1] :]], start[i + 1 :] - start[i + 1], dtype=np.int64)[at - i - 1]
        mark[own] = False
        near = at[q * shared >= p * (size[i] + size[at] - shared)]
        forest.join(np.full(len(near), i), near)
    return forest.root


def set_links(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) between the ids of rows (id, part, text, key, t1, t2): all of each bucket at the similarity or more."""
    least, by = Fraction(similarity).limit_denominator(1000), ["key", "t1", "t2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_buckets(batches, by):
            key, ids, part = pdf[by].to_numpy(), pdf["id"].to_numpy(), pdf["part"].to_numpy()
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]).tolist()
            root = []
            for a, z in zip(first, [*first[1:], len(key)], strict=True):
                sets = [np.unique(shingle_hashes(t, width)) for t in pdf["text"].iloc[a:z]]
                root.append(a + link_sets(sets, part[a:z], least))
            to = ids[np.concatenate(root)]
            yield pd.DataFrame({"a": ids[ids != to], "b": to[ids != to]})

    return rows.repartitionByRange(*by).sortWithinPartitions(*by, "id").mapInPandas(run, "a long, b long")


def exact_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, width: int, similarity: float, tile_docs: int) -> DataFrame:
    """Links (a, b) that join what the similarity joins within the groups (node, root); nodes: (id, rep) with their documents."""
    members = groups.select("node", "root").unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    count = lambda n: F.ceil(F.col(n) / tile_docs).cast("int")
    large = materialize(members.groupBy("root").count().where(F.col("count") > tile_docs).select("root", count("count").alias("tiles")), "tiles")
    named = members.join(nodes.select(F.col("id").alias("node"), "rep.doc_id", "rep.text_hash"), "node").join(hinted(large), "root", "left")
    named = materialize(named.select(F.col("node").alias("id"), F.col("root").alias("key"), "doc_id", "text_hash", F.coalesce("tiles", F.lit(1)).alias("tiles")), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    at = texts["text_hash"].eqNullSafe(named["text_hash"]) & texts["doc_id"].eqNullSafe(named["doc_id"])
    found = materialize(texts.join(hinted(named), at).select("id", "key", "tiles", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("tile"), "text"), "texts")
    if found.count() > named.count():  # documents that are there several times
        found = materialize(found.groupBy("id", "key", "tiles", "tile").agg(F.first("text").alias("text")), "texts")
    cols = ["id", "part", "text", "key", "t1", "t2"]
    if large.isEmpty():
        return set_links(found.withColumns({"part": F.col("id"), "t1": F.lit(0), "t2": F.lit(0)}).select(cols), width, similarity)
    to_first = F.when((F.col("tile") > 0) | (F.col("tiles") == 1), F.array("tile")).otherwise(F.sequence(F.lit(1), F.greatest(F.col("tiles") - 1, F.lit(1))))
    links = materialize(set_links(found.withColumns({"part": F.col("id"), "t1": F.lit(0), "t2": F.explode(to_first)}).select(cols), width, similarity), "links")

    parts = components(links, "parts").withColumnsRenamed({"node": "id", "root": "part"})
    placed = named.where("tiles > 1").select("id", "key").join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))
    placed = materialize(placed, "placed")
    largest = placed.groupBy("key", "part").count().groupBy("key").agg(F.max_by("part", F.struct("count", "part")).alias("largest"))
    rest = placed.join(hinted(materialize(largest, "largest")), "key").where("part <> largest").drop("largest")
    left = materialize(rest.groupBy("key").count().select("key", count("count").alias("left")), "left")
    if left.isEmpty():
        return links
    apart = materialize(rest.select("id"), "apart")
    rows = found.where("tiles > 1").join(hinted(left), "key").join(placed.select("id", "part"), "id")
    every = rows.withColumns({"t1": F.explode(F.sequence(F.lit(0), F.col("left") - 1)), "t2": F.col("tile")})
    again = rows.join(hinted(apart), "id", "left_semi").withColumns({"t1": F.pmod(F.xxhash64("id", F.lit(1)), F.col("left")).cast("int"), "t2": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))})
    return links.unionByName(set_links(every.select(cols).unionByName(again.select(cols)), width, similarity))


#: Five-word shingles at a similarity (Jaccard) of 0.8 or more. 24 bands of 5 MinHash values bring all but 1 in 10,000
#: pairs at 0.8 itself together, and nearly all above. There, 39 of 256 bits differ on average (48 in the shortest
#: texts) with a standard deviation of 6, so a radius of 80 loses none in practice; unlike texts differ in 128.
SIMILAR = {"width": 5, "similarity": 0.8, "radius": 80, "n_words": 4, "bands": 24, "band_rows": 5}


def similar_groups(
    docs: DataFrame,
    width: int = 5,
    similarity: float = 0.8,
    radius: int = 80,
    n_words: int = 4,
    bands: int = 24,
    band_rows: int = 5,
    tile_rows: int = 20_000,
    tile_docs: int = 128,
) -> tuple[DataFrame, DataFrame]:
    """prints (doc_id, text_hash, s0, s1) of every row of docs, and nodes (s0, s1, rows, rep, first): the shingle sets, each with
    its first document and the first document of its group, as structs of doc_id and text_hash."""
    names = [f"f{i}" for i in range(n_words)]
    prints = materialize(fingerprints(docs, width, n_words, bands, band_rows, distinct=True), "prints")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep")
    nodes = prints.groupBy("s0", "s1").agg(rep, F.count("*").alias("rows"), *(F.first(n).alias(n) for n in [*names, "keys"]))
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    keyed = collisions(nodes.select(F.posexplode("keys").alias("band", "key"), "id"))
    rows = materialize(keyed, "collisions").join(nodes.select("id", *names), "id").select("band", "key", "id", *names)
    groups = components(tree_links(rows, n_words, radius, tile_rows), "stars")
    found = components(exact_links(docs, nodes, groups, width, similarity, tile_docs), "stars")
    return prints.select("doc_id", "text_hash", "s0", "s1"), _of_component(nodes.select("id", "s0", "s1", "rows", "rep"), found, "rep", "first").drop("id")


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs, all columns, that stay: of each group the document with the smallest doc_id (then text hash), once."""
    prints, nodes = similar_groups(docs.select("doc_id", "text"), **(SIMILAR | params))
    shared = nodes.where((F.col("rows") > 1) | (F.col("rep") != F.col("first")))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    placed = materialize(prints.join(shared, ["s0", "s1"]).select("doc_id", "text_hash", (own == F.col("first")).alias("stays")), "placed")
    named = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    gone = materialize(named(placed.where("NOT stays")).distinct(), "gone")
    repeated = materialize(named(placed.where("stays").groupBy("doc_id", "text_hash").count().where("count > 1")), "repeated")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"))
    same = lambda df: rows["_hash"].eqNullSafe(df["_hash"]) & rows["_id"].eqNullSafe(df["_id"])
    if repeated.isEmpty():
        return rows.join(hinted(gone), same(gone), "left_anti").select("row.*")
    once = rows.join(hinted(gone.unionByName(repeated)), same(gone), "left_anti").select("row.*")
    first = rows.join(hinted(repeated), same(repeated), "left_semi").groupBy("_id", "_hash").agg(F.first("row").alias("row"))
    return once.unionByName(first.select("row.*"))
