"""MinHash near-duplicates by an inverted join over signature coordinates.

Texts are lower-cased (A-Z) and cut into words; a document's set is that of its
five-word shingles. Documents with equal word sequences form a class, and
only one signature of ``COORDINATES`` minima per class goes on.

The join: classes are posted under each coordinate-value pair. A pair of classes
counts if its signatures agree in at least ``LEAST_AGREEING`` coordinates. With a
class's postings ordered from rare to frequent, two such classes must meet outside the
``LEAST_AGREEING - 1`` most frequent postings of each, so these long lists are
skipped: short lists are merged for candidates, and the skipped coordinates
are then compared in place to finish the count. Pairs that reach it are confirmed on full
shingle sets. At the similarity of 0.75 a pair falls short of the count with a
probability of about 3e-9; the error is one-sided.

No long list is expanded into pairs of rows. Two rounds take from each list one
pivot, chosen by hash, and test the others against it alone, which joins most
groups of copies; lists whose classes are in one component by then are closed. In
short open lists the pairs between components are tested row by row. Members of long open lists
are split once more, by their rarest shingles: with the shingles of a set ordered by how many of these sets hold them,
two sets that reach the similarity share one outside the ``ceil(0.75 size)`` - 1 most frequent of each, so a member is posted under the remaining
quarter. Texts that only share a passage do not meet there. Short lists of a shingle are paired row by row; members of long
ones stay in the lists of their coordinates, which are
dealt into tiles of bounded bytes and rows that carry signatures and sets: a task compares
a tile's signatures as arrays, each pair in the first coordinate whose list
holds both and nowhere else, confirms on the sets in place, and emits a spanning forest of the
links. So no link between components is lost. Rows grow with the number of members but for tiles: L classes that share a list of a
coordinate and are each in long lists of rare shingles without being in one component ship about L * L / 512 rows.

Defined cases: null texts and texts without words have the empty set and are
linked with nothing; rows with a null doc_id take no part and have a null
component; repeated rows are repeated, and each is kept if one is; rows that
share an id with other texts are rows of their own, but classes whose least
doc_id is the same count as linked; very long texts are read whole, their sets 8 bytes a shingle; an empty table gives an
empty result; other columns, whatever their names, are ignored and carried along by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Kept, row_of

SHINGLE, PERCENT = 5, 75
COORDINATES, LEAST_AGREEING = 32, 9
#: Ids broadcast to pick the texts of candidate classes; beyond that they are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Rounds of pivots, members of a list that is still paired row by row, and bytes of sets and classes per side of a tile.
ROUNDS, SHORT, TILE_BYTES, TILE_ROWS = 2, 48, 8 << 20, 512
#: Bins of hashes by which shingles of long lists are counted; equal counts only make the split coarser.
BINS = 1 << 20
#: What a row of a tile takes besides its set: signature, ids and their Python objects.
ROW_BYTES = 1024
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.random.default_rng(5).integers(1 << 62, dtype=np.uint64, size=(2, COORDINATES)) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII white-space characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; one for a text of fewer words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + n]) * _PRIME
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.empty(COORDINATES, np.uint64)
    for k in range(COORDINATES):
        v = (shingles ^ _MIX[0, k]) * _MIX[1, k]
        v ^= v >> np.uint64(31)
        out[k] = v.min()
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the similarity."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < PERCENT * len(large) or not len(small):
        return False
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, class key, number of shingles, signature; map only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, np.ndarray]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                keys, sizes, signs = [], [], []
                for v in b.column(1):
                    words = words_of(v.as_py())
                    key = xxhash.xxh3_128_digest(b" ".join(words))
                    if key not in known:
                        if len(known) > 8192:
                            known.clear()
                        s = shingle_set(words)
                        known[key] = (len(s), signature(s).view(np.int64) if len(s) else np.zeros(0, np.int64))
                    size, sign = known[key]
                    keys.append(key)
                    sizes.append(size)
                    signs.append(sign)
                starts = np.concatenate([[0], np.cumsum([len(s) for s in signs])]).astype(np.int32)
                flat = pa.array(np.concatenate([np.zeros(0, np.int64), *signs]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(starts), flat)], names=["doc_id", "key", "n_shingles", "sign"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return thin.mapInArrow(run, "doc_id long, key binary, n_shingles long, sign array<long>")


def shared_postings(classes: DataFrame) -> DataFrame:
    """(token, rep, k) without the lists of one class and without each class's most frequent tokens; k is the coordinate."""
    posts = classes.select("rep", F.posexplode("sign").alias("k", "v")).select("rep", "k", F.xxhash64("k", "v").alias("token"))
    often = posts.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.col("n").desc(), F.col("token").desc()))
    return posts.join(often, "token").withColumn("place", place).filter(F.col("place") >= LEAST_AGREEING).select("token", "rep", "k")


def shingle_table(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, shingles) for the classes that have postings left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [shingle_set(words_of(v.as_py())).tobytes() for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    wanted = reps.distinct()
    if reps.agg(F.count_distinct("rep")).first()[0] <= MAX_BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    thin = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    return thin.join(wanted, "rep", "left_semi").mapInArrow(run, "rep long, shingles binary")


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures agree often enough, whole signatures counted."""
    a, b = (classes.select(F.col("rep").alias(x), F.col("sign").alias(f"sign_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")
    count = F.size(F.filter(F.zip_with("sign_a", "sign_b", lambda x, y: x == y), lambda same: same))
    return both.filter(count >= LEAST_AGREEING).select("a", "b").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that reach the similarity on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    a, b = (sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _tile(rows: pa.Table) -> pa.Table:
    """A spanning forest of the links between the two sides of a tile that this list is the first to show."""
    k = rows["k"][0].as_py()
    reps = rows["rep"].to_numpy()
    order = np.argsort(reps, kind="stable")
    rows, reps = rows.take(pa.array(order)), reps[order]
    signs = np.array(rows["sign"].to_pylist(), np.int64).reshape(len(reps), COORDINATES)
    kept = (rows["mask"].to_numpy()[:, None] >> np.arange(COORDINATES)) & 1 == 1
    parts, chunk = rows["component"].to_numpy(), rows["chunk"].to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"]]
    sizes = np.array([len(x) for x in sets])
    one_side = chunk.min() == chunk.max()
    _, group = np.unique(parts, return_inverse=True)
    parent = list(range(int(group.max()) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found: list[tuple[int, int]] = []
    for i in range(len(reps) - 1):
        same = signs[i + 1 :] == signs[i]
        first = (same & kept[i + 1 :] & kept[i]).argmax(axis=1) == k
        small, large = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        good = first & (same.sum(axis=1) >= LEAST_AGREEING) & (100 * small >= PERCENT * large)
        if not one_side:
            good &= chunk[i + 1 :] != chunk[i]
        mine = root(group[i])
        others = [j for j in (np.flatnonzero(good) + i + 1).tolist() if root(group[j]) != mine]
        if not others:
            continue
        joined = np.concatenate([sets[j] for j in others])
        at = np.minimum(np.searchsorted(sets[i], joined), sizes[i] - 1)
        shared = np.add.reduceat((sets[i][at] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[others])[:-1]]))
        for j, n in zip(others, shared.tolist(), strict=True):
            if 100 * n >= PERCENT * (int(sizes[i]) + int(sizes[j]) - n) and (other := root(group[j])) != (mine := root(group[i])):
                parent[max(mine, other)] = min(mine, other)
                found.append((int(reps[i]), int(reps[j])))
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def long_list_links(posts: DataFrame, masks: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components within long lists; ``posts`` has token, rep, k and component of these lists."""
    sides = posts.join(classes.select("rep", "n_shingles"), "rep").groupBy("token").agg(
        F.greatest(F.ceil(F.sum(8 * F.col("n_shingles") + ROW_BYTES) / F.lit(TILE_BYTES)), F.ceil(F.count("*") / F.lit(TILE_ROWS))).cast("int").alias("chunks")
    )
    data = classes.select("rep", "sign").join(masks, "rep").join(sets, "rep")
    rows = posts.join(sides, "token").withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit("tile")), F.col("chunks")).cast("int")).join(data, "rep")
    tiled = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keyed = tiled.select("token", "k", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "rep", "chunk", "component", "sign", "mask", "shingles")
    return keyed.groupBy("token", "low", "high").applyInArrow(_tile, "a long, b long")


def _bin(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets fall into each bin: ``BINS`` numbers, however many sets there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.int64)
        for b in batches:
            for x in b.column(0):
                np.add.at(counts, _bin(np.frombuffer(x.as_buffer(), np.uint64)), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bin", "n"])

    rows = sets.select("shingles").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BINS, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def rare_postings(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """(shingle, rep, size): the rarest shingles of each set, one of which two sets that reach the similarity share."""
    # the count of its bin, then the hash: one order of all shingles, the same in every set
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                found = []
                for x in part.column(1):
                    s = np.frombuffer(x.as_buffer(), np.uint64)
                    skipped = -(-PERCENT * len(s) // 100) - 1
                    found.append(s[np.lexsort((s, shared.value[_bin(s)]))[: len(s) - skipped]].view(np.int64))
                sizes = [len(f) for f in found]
                reps = np.repeat(part.column(0).to_numpy(), sizes)
                full = np.repeat([len(x.as_buffer()) // 8 for x in part.column(1)], sizes).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(reps, pa.int64()), pa.array(full)], names=["shingle", "rep", "size"])

    return sets.select("rep", "shingles").mapInArrow(run, "shingle long, rep long, size long")


def split_by_shingles(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, Kept]:
    """Of members of long lists (rep, component): pairs that meet in short lists of a rare shingle, the reps in long ones, and the table behind both."""
    mine = sets.join(members.select("rep"), "rep", "left_semi")
    posts = rare_postings(mine, frequencies(mine)).withColumn("n", F.count("*").over(Window.partitionBy("shingle"))).filter("n > 1")
    met = Kept(posts.join(members, "rep"), "rare")
    a, b = (met.df.filter(F.col("n") <= SHORT).select("shingle", F.col("rep").alias(x), F.col("size").alias(f"size_{x}"), F.col("component").alias(f"component_{x}")) for x in "ab")
    fits = f"100 * least(size_a, size_b) >= {PERCENT} * greatest(size_a, size_b)"
    pairs = a.join(b, "shingle").filter("a < b and component_a <> component_b").filter(fits).select("a", "b").distinct()
    return pairs, met.df.filter(F.col("n") > SHORT).select("rep").distinct(), met


def links(docs: DataFrame, classes: DataFrame) -> Kept | None:
    """(node, component) of all classes that have a link; None where there are none."""
    posts = Kept(shared_postings(classes), "postings")
    if posts.df.isEmpty():
        return None
    sets = Kept(shingle_table(docs, posts.df.select("rep")), "shingles")
    found: Kept | None = None

    def placed() -> DataFrame:
        """Postings with their class's component, of lists that still have several."""
        if found is None:
            now = posts.df.withColumn("component", F.col("rep"))
        else:
            now = posts.df.join(found.df.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", "k", F.coalesce("component", "rep").alias("component"))
        spread = now.groupBy("token").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"))
        return now.join(spread.filter("low < high").select("token", "members"), "token")

    def merge(new: DataFrame) -> Kept:
        if found is not None:
            new = new.unionByName(found.df.select(F.col("node").alias("a"), F.col("component").alias("b")))
        after = components(new)
        if found is not None:
            found.drop()
        return after

    for turn in range(ROUNDS):
        rows = placed()
        pivots = rows.groupBy("token").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), F.col("rep").alias("b"), F.col("component").alias("component_b"))).alias("p")).select("token", "p.b", "p.component_b")
        pairs = rows.join(pivots, "token").filter("component <> component_b").select(F.col("rep").alias("a"), "b").distinct()
        found = merge(confirmed(agreeing(pairs, classes), sets.df))
    rest = Kept(placed(), "open")
    short = rest.df.filter(F.col("members") <= SHORT)
    a, b = (short.select("token", F.col("rep").alias(x), F.col("component").alias(f"component_{x}")) for x in "ab")
    pairs = a.join(b, "token").filter("a < b and component_a <> component_b").select("a", "b").distinct()
    masks = posts.df.groupBy("rep").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    new, spent = confirmed(agreeing(pairs, classes), sets.df), None
    long = rest.df.filter(F.col("members") > SHORT)
    if not long.isEmpty():
        rare, left, spent = split_by_shingles(long.select("rep", "component").distinct(), sets.df)
        new = new.unionByName(confirmed(rare, sets.df)).unionByName(long_list_links(long.join(left, "rep", "left_semi"), masks, classes, sets.df))
    found = merge(new)
    for table in (rest, sets, posts, *([spent] if spent else [])):
        table.drop()
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    profiles = Kept(profile(docs), "profiles")
    classes = Kept(profiles.df.filter("n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("sign").alias("sign")), "classes")
    found = links(docs, classes.df)
    rep = classes.df.select("key", "rep")
    if found is not None:
        rep = rep.join(found.df.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("rep"))
    rows = profiles.df.select("doc_id", "key", "n_shingles").join(rep, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """One document of each group; repeated rows go too, rows with a null doc_id stay, one of each text.

    Texts are not sorted: the ids that go are the hashed side, which is small beside the texts of its partition, and only
    rows that are repeated, if any, are numbered. They are so by their whole content, so a task that runs again
    numbers them alike.
    """
    gone = judged.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("not kept").select("doc_id")
    rows = docs.select(row_of(docs).alias("row"), "doc_id", F.xxhash64("text").alias("of"))
    left = rows.join(gone.hint("shuffle_hash"), "doc_id", "left_anti")
    again = Kept(docs.groupBy("doc_id", F.xxhash64("text").alias("of")).agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("id"), F.col("of").alias("hash")), "repeated")
    if again.df.isEmpty():
        return left.select("row.*")
    same = (F.col("doc_id").eqNullSafe(F.col("id"))) & (F.col("of") == F.col("hash"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "of").orderBy(F.xxhash64(F.to_json("row"))))
    first = left.join(again.df, same, "left_semi").withColumn("turn", turn).filter("turn = 1")
    return left.join(again.df, same, "left_anti").select("row").unionByName(first.select("row")).select("row.*")
