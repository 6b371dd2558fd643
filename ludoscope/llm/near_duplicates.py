"""Near-duplicate documents: MinHash bands, sequential verification, exact confirmation.

A document is the set of its distinct word shingles. Texts with equal sets are one class and are only
counted from then on, so copies cost nothing further. A class's MinHash signature is cut into bands;
classes that share a band are candidates.

Candidates are settled in two steps, neither of which writes out all pairs of a group:

1. every class of a band is compared with two of its classes (stars, linear in the group);
2. bands whose classes are still in several components are compared in blocks of bounded size, each
   band against itself, so that no link between components is lost. Shingles that no other such class
   has bound from above what a class can share, which rules out most of these pairs exactly.

A comparison reads the signature in batches. After each, the posterior of the pair's similarity given its
matches so far decides whether it goes on; a pair at the similarity is stopped with probability ``MISS``
at most, over all batches. Survivors are verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import stored, unused
from .components import components

BANDS, ROWS = 32, 6  # a pair at 0.8 shares no band with probability 6e-5
HASHES = BANDS * ROWS
BATCH = 32  # signature values that one step of the sequential comparison reads
MISS = 1e-4  # most that pruning a pair at the similarity may be likely, over all batches
BLOCK = 512  # classes of a band that meet in one comparison block

_seeds = np.random.default_rng(20).integers(0, 2**32, (2, HASHES), dtype=np.uint64).astype(np.uint32)
_FACTOR, _SHIFT = _seeds[0] | np.uint32(1), _seeds[1]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest value of each of HASHES permutations of the shingle hashes."""
    low, least = hashes.astype(np.uint32), np.full(HASHES, 2**32 - 1, np.uint32)
    for k in range(0, len(low), 2048):
        values = np.multiply.outer(_FACTOR, low[k : k + 2048]) + _SHIFT[:, None]
        least = np.minimum(least, values.min(axis=1))
    return least.astype(np.uint16)


def posterior(n: int, m: np.ndarray, similarity: float) -> np.ndarray:
    """Probability that a pair of which m of n values match is at least that similar.

    Before any value is read every similarity is equally likely, so it then follows a beta distribution with
    m + 1 and n - m + 1. Its tail is that of a binomial one: at most m of n + 1 values of a pair at the
    similarity match.
    """
    chances = [comb(n + 1, k) * similarity**k * (1 - similarity) ** (n + 1 - k) for k in range(n + 2)]
    return np.cumsum(chances)[m]


def _given_up(bounds: np.ndarray, similarity: float) -> float:
    """Probability that a pair at the similarity, whose values match independently, falls below the bounds."""
    step = np.array([comb(BATCH, m) * similarity**m * (1 - similarity) ** (BATCH - m) for m in range(BATCH + 1)])
    alive = np.ones(1)
    for n in range(BATCH, HASHES + 1, BATCH):
        alive = np.convolve(alive, step)
        alive[: bounds[n]] = 0
    return 1 - alive.sum()


def fewest_matches(similarity: float, miss: float = MISS) -> np.ndarray:
    """For each number n of values read, the matches below which a pair is given up.

    A pair is given up once the posterior probability that it reaches the similarity is below a level, the
    same after every batch: the highest one at which a pair at the similarity is given up by any of the
    batches with probability ``miss`` at most.
    """

    def bounds_at(level: float) -> np.ndarray:
        bounds = np.zeros(HASHES + 1, np.int64)
        for n in range(BATCH, HASHES + 1, BATCH):
            bounds[n] = np.searchsorted(posterior(n, np.arange(n + 1), similarity), level)
        return bounds

    low, high = 0.0, 1.0
    for _ in range(60):
        level = (low + high) / 2
        if _given_up(bounds_at(level), similarity) <= miss:
            low = level
        else:
            high = level
    return bounds_at(low)


def _sets(words: int):
    """Rows of (id, content key, text) to (id, key, set size, class, sorted shingle hashes)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            texts = batch.column(2)
            for i, j, data, offsets in bw.pieces(texts):
                found = bw.words(data, offsets, bw.BY_SPACE)
                sets = [
                    np.unique(bw.shingles(found.hashes[found.bounds[k] : found.bounds[k + 1]], words))
                    for k in range(j - i)
                ]
                yield batch.slice(i, j - i), sets

    return rows


def _class_of(hashes: np.ndarray) -> int | None:
    """64 bits that stand for the whole set; null for an empty one."""
    if not len(hashes):
        return None
    both = np.array([hashes.sum(), np.bitwise_xor.reduce(hashes)], np.uint64)
    mixed = bw.mix(bw.mix(both[:1]) + both[1:] + np.uint64(len(hashes)))
    return int(mixed.view(np.int64)[0])


def _signatures(words: int):
    def run(batches):
        for part, sets in _sets(words)(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_class_of(s) for s in sets], pa.int64()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["id", "key", "n_shingles", "class", "signature"],
            )

    return run


def _full_sets(words: int):
    def run(batches):
        for _, sets in _sets(words)(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["class", "hashes"],
            )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a column as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


def _bands(batches):
    """(class, signature) to one row for each band."""
    for batch in batches:
        parts = _matrix(batch.column(1)).reshape(-1, BANDS, ROWS).astype(np.uint64)
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
        for k in range(ROWS):
            keys = bw.mix(keys + parts[:, :, k] * np.uint64(0x9E3779B97F4A7C15))
        classes = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel().view(np.int64)), pa.array(classes)], names=["band", "class"]
        )


def _can_reach(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets of these sizes can be as similar as that at all."""
    return percent * np.maximum(n, m) <= 100 * np.minimum(n, m)


def _alive(a: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Indices of the row pairs that have enough matches in every batch."""
    kept, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n in range(BATCH, HASHES + 1, BATCH):
        matches = matches + (a[kept, n - BATCH : n] == b[kept, n - BATCH : n]).sum(axis=1)
        stays = matches >= bounds[n]
        kept, matches = kept[stays], matches[stays]
    return kept


def _prune_pairs(percent: int, bounds: np.ndarray):
    """(a, b, size of a, size of b, signature of a, signature of b) to the surviving (a, b)."""

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            kept = np.flatnonzero(_can_reach(n, m, percent))
            part = batch.take(pa.array(kept))
            alive = _alive(_matrix(part.column(4)), _matrix(part.column(5)), bounds)
            yield part.take(pa.array(alive)).select([0, 1])

    return run


def _prune_block(percent: int, bounds: np.ndarray):
    """One block of a band: its classes in surviving pairs of different components, and their partners.

    Two sets share at most the smaller of their numbers of shared shingles. A pair that already met in an
    earlier band is left to that band's block, and it is listed with one of its classes. So a block
    returns a row for each of its classes at most, however many pairs it has.
    """

    def run(group: pa.Table) -> pa.Table:
        band = group.column("band")[0].as_py()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        side, component = group.column("side").to_numpy(), group.column("component").to_numpy()
        classes, n = group.column("class").to_numpy(), group.column("n_shingles").to_numpy()
        shared = group.column("n_shared").to_numpy()
        signatures = _matrix(group.column("signature").combine_chunks())
        left = np.flatnonzero(side == low)
        right = left if low == high else np.flatnonzero(side == high)
        partners: dict[int, np.ndarray] = {}
        for i in left:
            others = right[right > i] if low == high else right
            enough = (100 + percent) * np.minimum(shared[others], shared[i]) >= percent * (n[others] + n[i])
            others = others[enough & (component[others] != component[i]) & _can_reach(n[others], n[i], percent)]
            others = others[_alive(np.broadcast_to(signatures[i], (len(others), HASHES)), signatures[others], bounds)]
            same = (signatures[others] == signatures[i]).reshape(-1, BANDS, ROWS).all(axis=2)
            first = _band_keys(signatures[i], same.argmax(axis=1))
            if (first == band).any():
                partners[i] = others[first == band]
        listed = sorted({*partners, *(int(k) for found in partners.values() for k in found)})
        return pa.table(
            {
                "band": pa.array([band] * len(listed), pa.int64()),
                "low": pa.array([low] * len(listed), pa.int64()),
                "high": pa.array([high] * len(listed), pa.int64()),
                "class": pa.array(classes[listed], pa.int64()),
                "component": pa.array(component[listed], pa.int64()),
                "partners": pa.array([classes[partners[i]] if i in partners else [] for i in listed], pa.list_(pa.int64())),
            }
        )

    return run


def _confirm_block(percent: int):
    """One block's listed classes with their full sets: pairs that reach the similarity.

    A pair that pairs found before already connect is passed over.
    """

    def run(group: pa.Table) -> pa.Table:
        classes = group.column("class").to_pylist()
        root = dict(zip(classes, group.column("component").to_pylist(), strict=True))
        sets = {c: np.frombuffer(x.as_buffer(), np.uint64) for c, x in zip(classes, group.column("hashes"), strict=True)}
        joined: dict[int, int] = {}

        def top(c: int) -> int:
            c = root[c]
            while c in joined:
                c = joined[c]
            return c

        links = []
        for a, partners in zip(classes, group.column("partners").to_pylist(), strict=True):
            for b in partners:
                if top(a) != top(b) and _similar(sets[a], sets[b], percent):
                    links.append((a, b))
                    joined[top(a)] = top(b)
        columns = list(zip(*links, strict=True)) or [[], []]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})

    return run


def _similar(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether two sets, sorted, reach the similarity."""
    shared = int(np.isin(u, v, assume_unique=True).sum())
    return 100 * shared >= percent * (len(u) + len(v) - shared)


def _band_keys(signature: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Keys of the given bands of one signature."""
    parts, keys = signature.reshape(BANDS, ROWS).astype(np.uint64), np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = bw.mix(keys + parts[:, k] * np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64)[bands]


def _confirm(percent: int):
    """(a, b, full set of a, full set of b) to the pairs that reach the similarity."""

    def run(batches):
        for batch in batches:
            linked = [
                _similar(*(np.frombuffer(z.as_buffer(), np.uint64) for z in pair), percent)
                for pair in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield batch.filter(pa.array(linked, pa.bool_())).select([0, 1])

    return run


def _joined(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """The columns of ``table`` for both classes of each pair."""
    for end in ("a", "b"):
        renamed = [F.col(c).alias(f"{c}_{end}") for c in columns]
        pairs = pairs.join(table.select(F.col("class").alias(end), *renamed), end)
    return pairs.select("a", "b", *[f"{c}_{end}" for c in columns for end in ("a", "b")])


def _members(classes: DataFrame) -> DataFrame:
    """(band, class, leader, second) of the bands that several classes share.

    The leader is the band's smallest class, the second its class of the smallest scrambled number.
    """
    bands = classes.select("class", "signature").mapInArrow(_bands, "band long, class long")
    scrambled = F.struct(F.xxhash64("class"), F.col("class").alias("class"))
    shared = (
        bands.groupBy("band")
        .agg(F.min("class").alias("leader"), F.min(scrambled).alias("second"), F.count("*").alias("size"))
        .where("size > 1")
        .select("band", "leader", F.col("second.class").alias("second"))
    )
    return bands.join(shared, "band")


def _shingle_rows(batches):
    """(class, set) to one row (shingle, class) for each shingle."""
    for batch in batches:
        for k in range(batch.num_rows):
            hashes = np.frombuffer(batch.column(1)[k].as_buffer(), np.int64)
            classes = np.full(len(hashes), batch.column(0)[k].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(classes)], names=["shingle", "class"])


def _able(apart: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(class, n_shingles, n_shared, signature) of the classes in ``apart`` that can link with another one.

    n_shared leaves out the shingles that no other class in ``apart`` has. A class that has less than the
    similarity's share of its own shingles in common with all others together links with none.
    """
    own = sets.join(apart.select("class").distinct(), "class", "left_semi")
    rows = own.select("class", "hashes").mapInArrow(_shingle_rows, "shingle long, class long")
    alone = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("class").alias("class")).where("n = 1")
    alone = alone.groupBy("class").agg(F.count("*").alias("alone"))
    shared = own.select("class").join(alone, "class", "left").select("class", F.coalesce("alone", F.lit(0)).alias("alone"))
    return (
        classes.join(shared, "class")
        .withColumn("n_shared", F.col("n_shingles") - F.col("alone"))
        .where(100 * F.col("n_shared") >= percent * F.col("n_shingles"))
        .select("class", "n_shingles", "n_shared", "signature")
    )


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, words: int = 5, percent: int = 80
) -> DataFrame:
    """(id, key, n_shingles, component_id, kept) for every row of ``docs``.

    ``key`` hashes the text. Documents are linked if 100 * |intersection| >= ``percent`` * |union| of
    their shingle sets; component_id is the smallest id that links reach. An empty or null text has no
    shingles and is its own component. Rows with a null id take part and get the smallest id of their
    component, or null. Rows that share an id are linked only if their texts are; each is kept if the
    component's smallest id is its own. An empty table gives no rows; other columns of ``docs`` are ignored.

    Sets are compared by 64-bit hashes of their shingles, and classes of equal sets by one 64-bit hash.
    """
    texts = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.xxhash64(text_column).alias("key"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    rows = stored(
        texts.mapInArrow(_signatures(words), "id long, key long, n_shingles long, class long, signature binary"),
        "signatures",
    )
    filled = rows.where("class is not null")
    ids = filled.groupBy("class").agg(F.min("id").alias("least_id"), F.min("key").alias("key"))
    classes = stored(
        filled.select("class", "n_shingles", "signature").dropDuplicates(["class"]), "classes"
    )
    members = stored(_members(classes), "members")

    # The full sets of all classes that share a band, fetched once: one row of one copy of each class.
    shared = members.select("class").distinct()
    copies = filled.join(shared, "class", "left_semi").groupBy("class").agg(
        F.min(F.struct("key", "id")).alias("one")
    )
    wanted = copies.select("one.key", "one.id").distinct()
    same_id = F.col("wanted.id").eqNullSafe(F.col("texts.id"))
    whole = texts.alias("texts").join(
        wanted.alias("wanted"), (F.col("wanted.key") == F.col("texts.key")) & same_id, "left_semi"
    )
    sets = stored(
        whole.mapInArrow(_full_sets(words), "class long, hashes binary").dropDuplicates(["class"]), "sets"
    )

    bounds = fewest_matches(percent / 100)

    def linked(pairs: DataFrame) -> DataFrame:
        return _joined(pairs, sets, "hashes").mapInArrow(_confirm(percent), "a long, b long")

    def survivors(pairs: DataFrame) -> DataFrame:
        return _joined(pairs, classes, "n_shingles", "signature").mapInArrow(
            _prune_pairs(percent, bounds), "a long, b long"
        )

    # Step 1: each class with two classes of its band.
    stars = None
    for other in ("leader", "second"):
        star = members.where(F.col("class") != F.col(other)).select(
            F.least("class", other).alias("a"), F.greatest("class", other).alias("b")
        )
        stars = star if stars is None else stars.unionByName(star)
    links = linked(survivors(stars.distinct()))
    parts = stored(components(links), "components")

    # Step 2: bands that still hold several components, in blocks.
    apart = _apart(members, parts)
    able = stored(_able(apart, classes, sets, percent), "able")
    apart = _mixed(stored(apart.join(able.select("class"), "class", "left_semi"), "apart"))
    blocks = _blocks(apart).join(able, "class")
    block = ["band", "low", "high"]
    listed = blocks.groupBy(*block).applyInArrow(
        _prune_block(percent, bounds),
        "band long, low long, high long, class long, component long, partners array<long>",
    )
    found = listed.join(sets, "class").groupBy(*block).applyInArrow(_confirm_block(percent), "a long, b long")
    more = found.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))
    parts = stored(components(more), "components")
    return _labelled(rows, ids, parts)


def _apart(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(band, class, component, size) of the bands whose classes are not all in one component."""
    labelled = members.join(parts.withColumnRenamed("node", "class"), "class", "left").select(
        "band", "class", F.coalesce("component", "class").alias("component")
    )
    return stored(_mixed(stored(labelled, "labelled")), "apart")


def _mixed(labelled: DataFrame) -> DataFrame:
    """Rows of bands with several components; ``size`` is counted anew."""
    several = (
        labelled.groupBy("band")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size"))
        .where("least <> most")
    )
    return labelled.select("band", "class", "component").join(several.select("band", "size"), "band")


def _blocks(apart: DataFrame) -> DataFrame:
    """Deal each band's classes into blocks whose pairs are all that may still link: those of two components.

    The band's largest component has no pairs within itself to compare, so its classes meet the others only.
    The others are dealt into ``rest`` sides, the largest component into ``main`` sides after them; every
    side of the others meets itself, every other one, and every side of the largest.
    """
    per_component = apart.groupBy("band", "component").agg(F.count("*").alias("n"))
    largest = per_component.groupBy("band").agg(
        F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("size")
    )
    sizes = largest.select(
        "band",
        F.col("largest.component").alias("main_component"),
        F.ceil(F.col("largest.n") / BLOCK).alias("main"),
        F.ceil((F.col("size") - F.col("largest.n")) / BLOCK).alias("rest"),
    )
    zero, rest, main = F.lit(0).cast("long"), F.col("rest"), F.col("main")
    is_main = F.col("component") == F.col("main_component")
    number = F.xxhash64("class")
    side = F.when(is_main, rest + F.pmod(number, main)).otherwise(F.pmod(number, rest))
    others = F.when(is_main, F.sequence(zero, rest - 1)).otherwise(F.sequence(zero, rest + main - 1))
    dealt = apart.select("band", "class", "component").join(sizes, "band").withColumn("side", side).withColumn("other", F.explode(others))
    return dealt.select(
        "band", "class", "component", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high")
    )


def _labelled(rows: DataFrame, ids: DataFrame, parts: DataFrame) -> DataFrame:
    """Each row with the smallest id of its component."""
    classes = ids.join(parts.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "least_id", F.coalesce("component", "class").alias("component")
    )
    least = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_class = classes.join(least, "component").select("class", "component", "component_id")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return (
        rows.select("id", "key", "n_shingles", "class")
        .join(by_class, "class", "left")
        .select("id", "key", "n_shingles", component.alias("component_id"), "component")
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    )


def one_of_each_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of each component of ``near_duplicates``, with all columns.

    The row with the smallest (id, text hash) stays, null ids first; of rows that agree in both, one.
    Documents without shingles all stay.
    """
    found = near_duplicates(docs, id_column, text_column, **settings)
    found = stored(found.select("id", "key", "n_shingles", "component"), "groups")
    grouped = found.where("component is not null")
    first = grouped.groupBy("component").agg(F.min(F.struct("id", "key")).alias("first"))
    rows = grouped.groupBy("component", "id", "key").agg(F.count("*").alias("copies"))
    judged = rows.join(first, "component").select(
        "id", "key", "copies", F.struct("id", "key").eqNullSafe(F.col("first")).alias("stays")
    )
    judged = stored(judged, "judged")
    row_id, row_key = unused(docs.columns, "row_id"), unused(docs.columns, "row_key")
    keyed = docs.withColumns({row_id: F.col(id_column).cast("long"), row_key: F.xxhash64(text_column)})

    def with_any(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
        others = others.select(F.col("id").alias(f"other_{row_id}"), F.col("key").alias(f"other_{row_key}"))
        same = F.col(row_id).eqNullSafe(F.col(f"other_{row_id}")) & (F.col(row_key) == F.col(f"other_{row_key}"))
        return rows.join(others, same, how)

    kept = with_any(keyed, judged.where("not stays"), "left_anti")
    repeated = judged.where("stays and copies > 1")
    once = with_any(kept, repeated, "left_anti")
    one = with_any(kept, repeated, "left_semi").dropDuplicates([row_id, row_key])
    return once.unionByName(one).select(*docs.columns)
