"""P2: near-duplicate records by b-bit MinHash.

Method: each distinct set gets PERMUTATIONS minima. Bands of ROWS full minima give candidate pairs; of the minima
only the lowest bit is kept (b = 1), packed into two longs, and candidates whose collision-corrected similarity,
2 * equal bits / PERMUTATIONS - 1, is far below the threshold are dropped by bit counts. An exact check of the sets
(integers only, so a similarity of exactly the threshold counts) decides the rest.

Sizes: a pair at the threshold of 0.7 shares none of the 32 bands with probability (1 - 0.7^4)^32 = 1.5e-4, and the
bit count is SIGMAS standard deviations below its mean with probability below 1e-5; both shrink fast above it.

Buckets. Bands are counted by their hash alone; only those that occur twice are joined back to their sets. A bucket of
more than HOT sets is never paired as it is: its sets are divided again by the elements of their prefixes, rarest in the
bucket first, which every pair at the threshold must share one of, so no pair is lost.

Equal sets are one class before any pairing, so copies never meet in a bucket. In the pairs of records, a group of more
than EXPAND records with exactly the same text is a star around its smallest id, which stands for them in all other
pairs; records whose texts differ are always paired. p2_classes gives every record's class whatever its size.

Defined cases. Null and empty texts, claims of fewer than MIN_WORDS words, member lists that are null, empty or no
JSON array have no set and no pairs; blank or null members don't count. Rows with one id are one record; where its
deliveries differ, each set counts for it. A null id is no record. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.llm.words import SPACE, words
from veristrata.operators.skew import join_group_facts
from veristrata.session import written

MIN_WORDS = 8
PERMUTATIONS, ROWS = 128, 4
SIGMAS = 4.5
EXPAND = 1000
#: Sets of a bucket from which it is divided by prefixes; the pairs are the same.
HOT = 200

_RNG = np.random.default_rng(20240)
_MUL = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def word_pairs(table: DataFrame, text_col: str) -> DataFrame:
    """The table with ``elements``: sorted distinct hashes of the pairs of neighbouring words; null below MIN_WORDS words."""
    w = F.col("_words")
    pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda x, y: F.xxhash64(x, y))
    return table.withColumn("_words", words(F.col(text_col))).withColumn("elements", F.when(F.size(w) >= MIN_WORDS, F.array_sort(F.array_distinct(pairs)))).drop("_words")


def member_set(members: Column) -> Column:
    """Sorted distinct hashes of the trimmed, lower-cased members of a JSON array."""
    names = F.transform(F.from_json(members, "array<string>"), lambda x: F.lower(F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "")))
    return F.array_sort(F.array_distinct(F.transform(F.filter(names, lambda x: x.isNotNull() & (x != "")), lambda x: F.xxhash64(x))))


def record_sets(table: DataFrame, tab: str, text_col: str) -> DataFrame:
    """tab, id, k1, k2, t, elements of a table with ``elements``: k1, k2 name the set and t the text."""
    rows = table.where("id IS NOT NULL AND size(elements) > 0").select(F.lit(tab).alias("tab"), "id", F.xxhash64(text_col).alias("t"), "elements")
    return rows.select("tab", "id", F.xxhash64("tab", "elements").alias("k1"), F.xxhash64(F.lit(7), F.col("elements")).alias("k2"), "t", "elements")


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(PERMUTATIONS, sets) minima of the sets that begin at starts; none may be empty."""
    x = values.astype(np.uint64)
    out = np.empty((PERMUTATIONS, len(starts)), np.uint64)
    for p in range(PERMUTATIONS):
        out[p] = np.minimum.reduceat((x * _MUL[p] + _ADD[p]) >> np.uint64(16), starts)
    return out


def _bands(low: np.ndarray) -> np.ndarray:
    """(bands, sets) hashes of ROWS minima each."""
    bands = np.empty((PERMUTATIONS // ROWS, low.shape[1]), np.uint64)
    for b in range(len(bands)):
        h = np.full(low.shape[1], b + 1, np.uint64)
        for r in range(ROWS):
            h = (h ^ low[b * ROWS + r]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        bands[b] = h
    return bands


def _minima_of(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index("elements"))
    return minima(lists.flatten().to_numpy(), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py())


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per set its low bits, packed, and the buckets of its bands."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        low = _minima_of(batch)
        packed = np.packbits((low & np.uint64(1)).astype(np.uint8), axis=0).T.copy().view(np.int64).reshape(n, -1)
        tab = batch.column(batch.schema.get_field_index("tab_hash")).to_numpy()
        buckets = np.ascontiguousarray((_bands(low).view(np.int64) ^ tab).T)  # one row a set
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * buckets.shape[1]), pa.array(buckets.ravel()))
        k1, k2, size = (batch.column(batch.schema.get_field_index(c)) for c in ("k1", "k2", "size"))
        yield pa.RecordBatch.from_arrays([k1, k2, size, pa.array(packed[:, 0]), pa.array(packed[:, 1]), lists], names=["k1", "k2", "size", "low1", "low2", "buckets"])


_SIGNED = "k1 long, k2 long, size int, low1 long, low2 long, buckets array<bigint>"


def _paired(rows: DataFrame, bucket: str) -> DataFrame:
    """a1, b1 (a1 < b1) of all rows (bucket, k1) that share a bucket."""
    a = rows.select(bucket, F.col("k1").alias("a1"))
    return a.join(rows.select(bucket, F.col("k1").alias("b1")), bucket).where("a1 < b1").select("a1", "b1")


def _by_prefix(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (bucket, k1) of hot buckets as (part, k1): one part per bucket and element of the set's prefix."""
    each = rows.join(sets.select("k1", "elements"), "k1").select("bucket", "k1", F.explode("elements").alias("e"))
    often = each.groupBy("bucket", "e").agg(F.count(F.lit(1)).alias("n"))
    own = join_group_facts(each, often, ["bucket", "e"], "n").groupBy("bucket", "k1").agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("own"))  # at most a set's elements
    least = F.floor((F.size("own") * num + den - 1) / den).cast("int")
    prefix = F.slice("own", F.lit(1), F.size("own") - least + 1)
    return own.select("bucket", "k1", F.explode(prefix).alias("x")).select(F.xxhash64("bucket", "x.e").alias("part"), "k1")


def links(sets: DataFrame, threshold: tuple[int, int] = (7, 10), hot: int = HOT) -> DataFrame:
    """Pairs of distinct sets (one row per set in ``sets``: tab, k1, k2, elements) with a similarity of at least threshold: a1, a2, b1, b2."""
    num, den = threshold
    t = num / den
    least = max(0.0, t - SIGMAS * 2 * ((0.5 + t / 2) * (0.5 - t / 2) / PERMUTATIONS) ** 0.5)
    rows = sets.select(F.xxhash64("tab").alias("tab_hash"), "k1", "k2", F.size("elements").alias("size"), "elements")
    signed = written(rows.mapInArrow(_signed, _SIGNED), "near-signatures")
    banded = signed.select("k1", F.explode("buckets").alias("bucket"))
    # written, so that its size is known when it is joined: Spark broadcasts it only below spark.sql.autoBroadcastJoinThreshold
    repeated = written(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-repeated")
    met = written(banded.join(repeated, "bucket").select("bucket", "k1", "n"), "near-buckets")
    pairs = _paired(met.where(F.col("n") <= hot), "bucket")
    large = met.where(F.col("n") > hot).select("bucket", "k1")
    if not large.isEmpty():
        pairs = pairs.unionAll(_paired(written(_by_prefix(large, sets, num, den), "near-parts"), "part"))
    pairs = pairs.distinct()
    side = lambda x: signed.select(*(F.col(c).alias(f"{x}_{c}") for c in ("k1", "k2", "size", "low1", "low2"))).withColumnRenamed(f"{x}_k1", f"{x}1")
    differing = F.bit_count(F.col("a_low1").bitwiseXOR(F.col("b_low1"))) + F.bit_count(F.col("a_low2").bitwiseXOR(F.col("b_low2")))
    sized = F.least("a_size", "b_size") * den >= F.greatest("a_size", "b_size") * num
    alike = pairs.join(side("a"), "a1").join(side("b"), "b1").where(sized & (1 - 2 * differing / PERMUTATIONS >= least)).select("a1", F.col("a_k2").alias("a2"), "b1", F.col("b_k2").alias("b2"))
    elements = sets.select("k1", "k2", "elements")
    both = alike.join(elements.toDF("a1", "a2", "a_set"), ["a1", "a2"]).join(elements.toDF("b1", "b2", "b_set"), ["b1", "b2"])
    common = F.size(F.array_intersect("a_set", "b_set"))
    return both.where(common * den >= (F.size("a_set") + F.size("b_set") - common) * num).select("a1", "a2", "b1", "b2")


def prepared(claims: DataFrame, peer_groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (tab, id, k1, k2, t) and the distinct sets (tab, k1, k2, elements), both written once."""
    of_claims = record_sets(word_pairs(claims.select("id", "text"), "text"), "claims", "text")
    of_groups = record_sets(peer_groups.select("id", "members", member_set(F.col("members")).alias("elements")), "peer_groups", "members")
    rows = written(of_claims.unionByName(of_groups), "near-sets")
    sets = rows.groupBy("tab", "k1", "k2").agg(F.first("elements").alias("elements"))
    return written(rows.select("tab", "id", "k1", "k2", "t").distinct(), "near-records"), written(sets, "near-classes")


def record_pairs(claims: DataFrame, peer_groups: DataFrame, expand: int = EXPAND) -> DataFrame:
    """tab, id_a, id_b of all pairs of records whose sets are similar enough."""
    members, sets = prepared(claims, peer_groups)
    found = links(sets)
    key = ["tab", "k1", "k2", "t"]
    alike = members.groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    held = written(join_group_facts(members, alike, key, "n"), "near-members")
    # the records that stand for themselves: all but those of large groups with one text, where the smallest id does
    standing = held.where((F.col("n") <= expand) | (F.col("id") == F.col("rep"))).select("tab", "k1", "k2", "id").distinct()
    a = standing.select("tab", F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("id").alias("a_id"))
    b = standing.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("id").alias("b_id"))
    across = found.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).where("a_id <> b_id").select("tab", "a_id", "b_id")
    within = standing.withColumnRenamed("id", "a_id").join(standing.withColumnRenamed("id", "b_id"), ["tab", "k1", "k2"]).where("a_id < b_id").select("tab", "a_id", "b_id")
    stars = held.where((F.col("n") > expand) & (F.col("id") != F.col("rep"))).select("tab", F.col("rep").alias("a_id"), F.col("id").alias("b_id"))
    pairs = across.unionByName(within).unionByName(stars)
    return pairs.select("tab", F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b")).distinct()


def record_classes(claims: DataFrame, peer_groups: DataFrame) -> DataFrame:
    """One row per record: tab, id, class_id (smallest id with the same set), n_copies, n_links (other classes similar to it)."""
    members, sets = prepared(claims, peer_groups)
    found = links(sets)
    ends = found.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).unionAll(found.select(F.col("b1").alias("k1"), F.col("b2").alias("k2")))
    degree = ends.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_links"))
    own = members.select("tab", "id", "k1", "k2").distinct()
    facts = own.groupBy("tab", "k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).join(degree, ["k1", "k2"], "left")
    return join_group_facts(own, facts, ["tab", "k1", "k2"], "n").select("tab", "id", F.col("rep").alias("class_id"), F.col("n").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
