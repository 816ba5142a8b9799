"""N-gram Jaccard join by parity sketches.

Every shingle XORs its hash into one word of a sketch, so the words of two sketches differ in at most |A xor B| places.
Documents of Jaccard similarity t or more have |A xor B| <= d = (|A| + |B|)(1 - t)/(1 + t). Sizes are dealt into bands of
ratio 1/t^2; a document goes to its own band and, if a partner could lie there, to the next. A band cuts its sketches
into ``SPARE`` times the d + 1 words that pigeonhole asks for. At most d words of a similar pair differ, so a document with
more than d words that are not empty leaves its empty words out; one with fewer keeps them all.

Of the words that it keeps a document needs only d + 1, as long as all choose them in one order: it takes those that the
fewest documents have. A word that nobody else has is among them and needs no bucket, so a document simply leaves out as
many of its most frequent shared words as it has words beyond d + 1. Passages that many documents hold thus open no buckets.
Documents that share a bucket are candidates; before candidates are compared on their whole shingle sets, the Hamming distance of
parity sketches of two bits or more per shingle bounds their difference.

No group is paired off. In each of ``ROUNDS`` rounds a document is compared with one head of the buckets it shares
with other components (the first round: their smallest member, then others), and components are contracted. Of a bucket that
then still holds different components all members but those of the largest one are compared with those of the others.
So all pairs of a bucket are linked, bounded away, or connected already, and components are exact. Equal buckets are
combined within each map task before they are shuffled, copies of one set are represented once.

Defined results: null and wordless texts have no shingles and link with nothing; rows with one doc_id are one node;
rows with a null doc_id get their size and a null component; each input row gives one row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.shingles import mix, shingle_set

#: Signature rows that a map task holds before it combines and emits them; members compared by one task per hub;
#: ids of documents to compare (eight bytes each) that are broadcast, more are joined by shuffle.
HELD_ROWS, HUB_ROWS, ROUNDS, BROADCAST_IDS = 500_000, 2_000, 2, 500_000

#: Words of the folded sketches that bound differences within the last join.
FOLDS = (4, 16)

#: Words of a band's sketch for each one that pigeonhole asks for.
SPARE = 1.3

INFO = "doc_id bigint, n bigint, h1 bigint, h2 bigint, spare0 bigint, spare1 bigint, w array<bigint>"
_INFO = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "h1", "h2", "spare0", "spare1")] + [("w", pa.list_(pa.int64()))])
SIGNED = "key bigint, a bigint, b bigint"


@dataclass(frozen=True)
class Similarity:
    """Jaccard threshold num/den over shingles of ``width`` words."""

    width: int = 5
    num: int = 8
    den: int = 10

    def difference(self, total: int) -> int:
        """Most elements in which two sets of ``total`` elements together may differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def bands(self, largest: int) -> list[int]:
        """Smallest size of each band, up to the band after the one that holds ``largest``."""
        lows = [1]
        while len(lows) < 3 or lows[-3] <= largest:
            lows.append(lows[-1] * self.den * self.den // (self.num * self.num) + 1)
        return lows

    def sketches(self, n: int, lows: list[int]) -> Iterator[tuple[int, int, int]]:
        """Of a set of ``n`` elements for each of its bands: the band, its words, the words that a partner may change."""
        own = int(np.searchsorted(lows, n, side="right")) - 1
        largest = n * self.den // self.num
        for band in (own, own + 1):
            if band > own and n * self.den < lows[band] * self.num:
                return
            most = self.difference(2 * (lows[band + 1] - 1))
            yield band, int((most + 1) * SPARE) + 1 if most else 1, min(most, self.difference(n + largest))


def parity(hashes: np.ndarray) -> np.ndarray:
    """XOR sketch of at least two bits per hash, its size a power of two; the hash's lowest bits pick the bit.

    A sketch of half the size is got by XORing its halves.
    """
    bits = max(256, 1 << (2 * len(hashes) - 1).bit_length())
    flips = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.bool_), bitorder="little").view("<u8")


def signatures(hashes: np.ndarray, sim: Similarity, lows: list[int]) -> np.ndarray:
    """Bucket keys of one sorted set: sketch words for its own band and for the next one; the lowest bit is the band's."""
    top, scrambled = hashes >> np.uint64(32), mix(hashes ^ np.uint64(0xD1B54A32D192ED03))
    out = []
    for band, words, most in sim.sketches(len(hashes), lows):
        # the upper half of a hash picks the word, so a sorted set lies in word order
        edge = np.searchsorted(top * np.uint64(words) >> np.uint64(32), np.arange(words + 1, dtype=np.uint64))
        filled = edge[1:] > edge[:-1]
        values = np.zeros(words, np.uint64)
        values[filled] = np.bitwise_xor.reduceat(scrambled, edge[:-1][filled]) + (edge[1:] - edge[:-1])[filled].astype(np.uint64)
        keys = mix(values ^ mix(np.arange(words, dtype=np.uint64) + np.uint64((band + 1) << 32)))
        keys = keys & ~np.uint64(1) | np.uint64(band & 1)
        out.append(keys[filled] if int(filled.sum()) > most else keys)
    return np.concatenate(out)


def spare_words(hashes: np.ndarray, sim: Similarity, lows: list[int]) -> list[int]:
    """How many of a set's words go beyond what pigeonhole asks for, in its even and in its odd band."""
    top, out = hashes >> np.uint64(32), [0, 0]
    for band, words, most in sim.sketches(len(hashes), lows):
        word = top * np.uint64(words) >> np.uint64(32)
        out[band & 1] = max(0, 1 + int(np.count_nonzero(word[1:] != word[:-1])) - (most + 1))
    return out


def _digests(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    one, two = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), mix(hashes + np.uint64(0x14057B7EF767814F))
    return int(one.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(two).view(np.int64))


def _describe(sim: Similarity):
    """Size, name, spare words and parity sketch of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = sim.bands(1)
        for batch in batches:
            rows: list[tuple] = []
            for lo in range(0, batch.num_rows, 500):
                for text in batch.column(1).slice(lo, 500).to_pylist():
                    h = shingle_set(text, sim.width)
                    if not len(h):
                        rows.append((0, None, None, 0, 0, None))
                        continue
                    if lows[-3] <= len(h):
                        lows = sim.bands(len(h))
                    rows.append((len(h), *_digests(h), *spare_words(h, sim, lows), parity(mix(h ^ np.uint64(0x2545F4914F6CDD1D))).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(_INFO)[1:])]], schema=_INFO)
        common.give_back()

    return run


def _combined(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Rows (key, head, null) once per key, and (key, head, member) for the further members of its bucket."""
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order].view(np.int64), ids[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    heads = ids[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
    keep = first | (heads != ids)
    return pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(heads[keep]), pa.array(ids[keep], mask=first[keep])], names=["key", "a", "b"])


def _sign(sim: Similarity):
    """Bucket keys of the sets, combined within the task; copies within the task sign once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, met = sim.bands(1), set()
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for lo in range(0, len(docs), 500):
                for doc, text in zip(docs[lo : lo + 500], batch.column(1).slice(lo, 500).to_pylist(), strict=True):
                    h = shingle_set(text, sim.width) if doc is not None else ()
                    n = len(h)
                    if not n or (name := _digests(h)) in met:
                        continue
                    if len(met) < 100_000:
                        met.add(name)
                    if lows[-3] <= n:
                        lows = sim.bands(n)
                    keys.append(signatures(h, sim, lows))
                    ids.append(np.full(len(keys[-1]), doc, np.int64))
                    held += len(keys[-1])
                    if held >= HELD_ROWS:
                        yield _combined(np.concatenate(keys), np.concatenate(ids))
                        keys, ids, held = [], [], 0
        if held:
            yield _combined(np.concatenate(keys), np.concatenate(ids))
        del keys, ids
        common.give_back()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of one partition: the smallest head of each with the other heads, and what was met within a task before."""
    parts = []
    for b in batches:
        within = b.column(2).is_valid()
        if within.true_count:
            yield b.filter(within)
        own = b.filter(b.column(2).is_null())
        if own.num_rows:
            parts.append((own.column(0).to_numpy(), own.column(1).to_numpy()))
    if not parts:
        return
    keys, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    parts.clear()
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
    keys, ids = keys[shared], ids[order[shared]]  # most keys have one head
    del order, same, shared
    if not len(keys):
        return
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    heads = np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.append(starts, len(keys))))
    rest = heads != ids
    yield pa.RecordBatch.from_arrays([pa.array(keys[rest]), pa.array(heads[rest]), pa.array(ids[rest])], names=["key", "a", "b"])
    del keys, ids, starts, heads, rest
    common.give_back()


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, width).astype("<u8").tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["id", "hashes"])

    return run


def _compare(sim: Similarity):
    """Rows sorted by (a, salt, b is not null): the set of a, then the sets of those to compare with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sets = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                for a, b, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    h = np.frombuffer(data, "<u8")
                    if b is None:
                        sets = [*sets, h] if of == a else [h]
                        of = a
                        continue
                    for mine in sets if of == a else []:
                        both = len(np.intersect1d(mine, h, assume_unique=True))
                        if both and sim.den * both >= sim.num * (len(mine) + len(h) - both):
                            out.append((a, b))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())], names=["a", "b"])

    return run


def verified(docs: DataFrame, pairs: DataFrame, sim: Similarity) -> tuple[DataFrame, str]:
    """Those of ``pairs(a, b)`` whose shingle sets are similar enough, and the table of sets that they are read from.

    A hub's partners are dealt over several tasks.
    """
    wanted = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct()
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.join(wanted.hint("broadcast" if few else "shuffle_hash"), F.col("doc_id") == F.col("w"), "left_semi")
    sets, at = common.saved_at(texts.mapInArrow(_sets(sim.width), "id bigint, hashes binary"), "shingle-sets")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("parts"))
    mine = hubs.join(sets, hubs.a == sets.id).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("b"), "hashes")
    theirs = pairs.join(hubs, "a").join(sets, F.col("b") == F.col("id")).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), "b", "hashes")
    dealt = mine.union(theirs).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").isNotNull())
    return dealt.select("a", "b", "hashes").mapInArrow(_compare(sim), "a bigint, b bigint").distinct(), at


def _sizes_fit(sim: Similarity, a: Column, b: Column) -> Column:
    return (a * sim.den >= b * sim.num) & (b * sim.den >= a * sim.num)


def _near(sim: Similarity) -> Column:
    """Whether the sketches wx and wy of sets of nx and ny elements allow for similar sets; the larger sketch is folded first."""

    def folded(w: str, other: str) -> Column:
        half = F.size(other)
        return F.when(F.size(w) > half, F.zip_with(F.slice(w, F.lit(1), half), F.slice(w, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(w))

    apart = F.aggregate(F.zip_with(folded("wx", "wy"), folded("wy", "wx"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    a, b = F.col("nx"), F.col("ny")
    return F.when(_sizes_fit(sim, a, b), apart * (sim.den + sim.num) <= (a + b) * (sim.den - sim.num)).otherwise(False)


def _folds(size: int) -> list[Column]:
    """The sketch w folded to ``size`` words, as a column each; nulls if it has fewer. Words ``size`` apart are XORed."""

    def part(k: int) -> Column:
        own = F.filter("w", lambda _, i: i % size == k)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda s, v: s.bitwiseXOR(v))

    return [F.when(F.size("w") >= size, part(k)).alias(f"f{size}_{k}") for k in range(size)]


def _folds_near(sim: Similarity, x: str, y: str) -> Column:
    """The bound on folded sketches, for use as a join's condition; a fold that either set lacks says nothing."""
    most = (F.col(f"{x}.n") + F.col(f"{y}.n")) * (sim.den - sim.num)
    near = _sizes_fit(sim, F.col(f"{x}.n"), F.col(f"{y}.n"))
    for size in FOLDS:
        apart = sum((F.bit_count(F.col(f"{x}.f{size}_{k}").bitwiseXOR(F.col(f"{y}.f{size}_{k}"))) for k in range(size)), F.lit(0))
        near = near & F.coalesce(apart * (sim.den + sim.num) <= most, F.lit(True))
    return near


def _postings(buckets: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, rep, n): the buckets without each set's spare words, the most frequent ones; only buckets that still have two members."""
    ids = buckets.select("key", F.col("a").alias("doc_id")).union(buckets.select("key", F.col("b").alias("doc_id"))).distinct()
    members = common.saved(ids.join(classes, "doc_id").select("key", "rep").distinct(), "bucket-members")
    sizes = common.saved(members.groupBy("key").agg(F.count("*").alias("size_"), F.count("*").alias("many")).where("many > 1"), "bucket-sizes")
    spare = sets.groupBy("rep").agg(F.min("n").alias("n"), F.min("spare0").alias("spare0"), F.min("spare1").alias("spare1"))
    band = F.pmod(F.col("key"), F.lit(2))
    place = F.row_number().over(Window.partitionBy("rep", "band").orderBy(F.desc("many"), "key"))
    ranked = common.join_groups(members, sizes, ["key"]).join(spare, "rep").withColumn("band", band).withColumn("place", place)
    left = common.saved(ranked.where(F.col("place") > F.when(F.col("band") == 0, F.col("spare0")).otherwise(F.col("spare1"))).select("key", "rep", "n"), "needed-words")
    again = common.saved(left.groupBy("key").agg(F.count("*").alias("size_")).where("size_ > 1"), "needed-sizes")
    return common.join_groups(left, again, ["key"])


def _head_pairs(named: DataFrame, sim: Similarity, turn: int) -> DataFrame:
    """Each set with one head of the buckets that it shares with other components."""
    order = F.struct((F.col("rep") if not turn else F.xxhash64("rep", F.lit(turn))).alias("o"), "rep", "label", "n").alias("head")
    groups = named.groupBy("key").agg(F.count("*").alias("size_"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(order).alias("head")).where("low < high")
    tried = common.join_groups(named, common.saved(groups, "bucket-heads"), ["key"]).where((F.col("label") != F.col("head.label")) & _sizes_fit(sim, F.col("n"), F.col("head.n")))
    return tried.groupBy("rep").agg(F.min("head").alias("head")).select(F.least("rep", "head.rep").alias("a"), F.greatest("rep", "head.rep").alias("b")).distinct()


def _open_pairs(named: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """All pairs of one bucket and different components that folded sketches don't tell apart."""
    parts = named.groupBy("key", "label").count()
    groups = parts.groupBy("key").agg(F.sum("count").alias("size_"), F.max_by("label", F.struct("count", "label")).alias("major"), F.count("*").alias("labels")).where("labels > 1")
    members = common.saved(common.join_groups(named, common.saved(groups.drop("labels"), "open-buckets"), ["key"]), "open-members")
    wide = sets.select("rep", *[c for size in FOLDS for c in _folds(size)]).join(members.select("rep").distinct(), "rep", "left_semi")
    members = common.saved(members.join(wide, "rep"), "open-sketches")
    x, y = members.where("label <> major").alias("x"), members.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & _folds_near(sim, "x", "y")
    return x.join(y, apart).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def similarity_components(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id of every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    info = common.saved(docs.mapInArrow(_describe(sim), INFO), "parity-sketches")
    some = info.where("n > 0 and doc_id is not null")
    reps = common.saved(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size_")), "set-names")
    classes = common.saved(common.join_groups(some.select("doc_id", "h1", "h2"), reps, ["h1", "h2"]).select("doc_id", "rep"), "set-classes")
    sets = some.select("doc_id", "n", "spare0", "spare1", "w").join(classes.where("doc_id = rep").distinct(), "doc_id")
    sets = common.saved(sets.drop("doc_id"), "set-sketches")
    buckets, buckets_at = common.saved_at(docs.mapInArrow(_sign(sim), SIGNED).repartition("key").mapInArrow(_meet, SIGNED), "buckets")
    common.release(spark)
    postings = common.saved(_postings(buckets, classes, sets), "postings")
    common.remove(spark, buckets_at)
    common.release(spark)

    shared = classes.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")
    edges = common.saved(classes.join(shared, "doc_id").where("a < rep").select("a", F.col("rep").alias("b")), "same-ids")
    part = common.connected_components(edges)
    for turn in range(ROUNDS + 1):
        named = postings.join(part, F.col("rep") == F.col("id"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("label"))
        named, named_at = common.saved_at(named, "named-postings")
        pairs = _head_pairs(named, sim, turn) if turn < ROUNDS else _open_pairs(named, sets, sim)
        x, y = (sets.select(F.col("rep").alias(f"r{k}"), F.col("n").alias(f"n{k}"), F.col("w").alias(f"w{k}")) for k in "xy")
        pairs = pairs.join(x, F.col("a") == F.col("rx")).join(y, F.col("b") == F.col("ry")).where(_near(sim)).select("a", "b").distinct()
        pairs = common.saved(pairs, "pairs")
        common.remove(spark, named_at)
        common.release(spark)
        if not pairs.limit(1).count():
            continue
        links, sets_at = verified(docs, pairs, sim)
        edges = common.saved(edges.union(links), "links")
        common.remove(spark, sets_at)
        del links
        common.release(spark)
        part = common.connected_components(edges)

    place = classes.join(part, F.col("rep") == F.col("id"), "left").select("doc_id", F.coalesce("component", "rep").alias("label"))
    whole = place.groupBy("doc_id").agg(F.min("label").alias("component_id"))
    out = info.select("doc_id", F.col("n").alias("n_shingles")).join(whole, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(common.read_table(spark, sf_dir, "documents"), Similarity(3, 90, 100))
