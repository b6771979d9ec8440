"""The registry of known papers: lookup and append.

The stored registry is cut into segments, one per run and bucket (the first digits of the hash), each with a Bloom
filter.  A lookup tests its hashes against the filters first and opens only the segments that may hold one of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.sources.files import file_name
from foliomill.sources.tables import FILE, Lake

# A bucket is named by this many hexadecimal digits.
BUCKET_DIGITS = 2
# Bits per hash and places per hash of a filter: about one foreign hash in four hundred passes.
FILTER_BITS, FILTER_PLACES = 16, 4
# When a row was registered tells whether a later deletion means it.
REGISTERED = f"{FILE}, registered_at timestamp"
FILTER = "run string, bucket string, bits bigint, words map<bigint,bigint>"
SEGMENTED = f"{REGISTERED}, run string, bucket string"


def paper_id(file_hash: Column) -> Column:
    """Id that follows from the content, so a retried task makes the same one."""
    return F.sha2(F.concat(F.lit("paper~"), file_hash), 256)


def register_papers(new_files: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per offered file: the registered id, and whether the row is new.

    ``new_files`` holds ``path, file_hash, file_size``; ``registry`` holds ``file_hash, paper_id``.
    A known hash gives the existing id; rows with ``is_new`` are the ones to append.
    """
    known = registry.groupBy("file_hash").agg(F.min("paper_id").alias("known_id"))
    return new_files.join(known, "file_hash", "left").select(
        "file_hash",
        F.coalesce("known_id", paper_id(F.col("file_hash"))).alias("paper_id"),
        file_name(F.col("path")).alias("original_filename"),
        F.col("path").alias("file_path"),
        F.col("file_size").alias("file_size_bytes"),
        F.lit("uploaded").alias("status"),
        F.col("known_id").isNull().alias("is_new"),
    )


def bucket_of(file_hash: Column) -> Column:
    return F.substring(file_hash, 1, BUCKET_DIGITS)


def _places(file_hash: Column, bits: Column) -> list[Column]:
    """The filter's places of a hash, read off its own digits."""
    digits = [F.substring(file_hash, 1 + BUCKET_DIGITS + 12 * i, 12) for i in range(FILTER_PLACES)]
    return [F.pmod(F.conv(d, 16, 10).cast("bigint"), bits) for d in digits]


def filters_of(rows: DataFrame) -> DataFrame:
    """A Bloom filter per bucket of hashes: ``bucket``, number of ``bits``, and its ``words`` of 64 bits that hold any."""
    named = rows.select("file_hash", bucket_of(F.col("file_hash")).alias("bucket"))
    bits = F.greatest(F.lit(64), F.count(F.lit(1)) * FILTER_BITS).cast("bigint").alias("bits")
    sized = named.join(named.groupBy("bucket").agg(bits), "bucket")
    places = sized.select("bucket", "bits", F.explode(F.array(*_places(F.col("file_hash"), F.col("bits")))).alias("place"))
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(place % 64 AS INT))")
    words = places.groupBy("bucket", "bits", F.expr("place div 64").alias("word")).agg(F.bit_or(bit).alias("value"))
    return words.groupBy("bucket", "bits").agg(F.map_from_entries(F.collect_list(F.struct("word", "value"))).alias("words"))


def may_hold(file_hash: Column, bits: Column, words: Column) -> Column:
    """Whether a filter has all places of a hash; false only if the hash is not there."""
    hits = [F.coalesce(F.getbit(words[F.floor(p / 64).cast("bigint")], (p % 64).cast("int")), F.lit(0)) == 1 for p in _places(file_hash, bits)]
    return reduce(lambda a, b: a & b, hits)


def append_registry(lake: Lake, rows: DataFrame, run: str) -> DataFrame:
    """Writes new papers as this run's segments, and a filter for each."""
    if "registered_at" not in rows.columns:
        rows = rows.withColumn("registered_at", F.current_timestamp())
    written = lake.append("registry", rows.withColumn("bucket", bucket_of(F.col("file_hash"))), run, by="bucket")
    lake.append("registry_filters", filters_of(written), run)
    return written.drop("bucket")


def hit_segments(lake: Lake, hashes: DataFrame, run: str | None = None) -> list[tuple[str, str]]:
    """Run and bucket of the segments that may hold one of ``hashes``, without this ``run``'s own.

    There are no more than runs times buckets; ``compact_registry`` makes the runs one.
    """
    filters = lake.read("registry_filters", FILTER)
    if run is not None:
        filters = filters.where(F.col("run") != run)
    wanted = hashes.where(F.col("file_hash").isNotNull()).select("file_hash", bucket_of(F.col("file_hash")).alias("bucket")).distinct()
    hit = wanted.join(filters, "bucket").where(may_hold(F.col("file_hash"), F.col("bits"), F.col("words")))
    return sorted((r["run"], r["bucket"]) for r in hit.select("run", "bucket").distinct().collect())


def known_papers(lake: Lake, hashes: DataFrame, run: str | None = None) -> DataFrame:
    """Registry rows of the given hashes, read from the segments that may hold them and no others."""
    by_run: dict[str, list[str]] = {}
    for name, bucket in hit_segments(lake, hashes, run):
        by_run.setdefault(name, []).append(bucket)
    registry = lake.read("registry", SEGMENTED)
    chosen = [(F.col("run") == name) & F.col("bucket").isin(buckets) for name, buckets in by_run.items()]
    rows = registry.where(reduce(lambda a, b: a | b, chosen, F.lit(False)))
    return rows.join(hashes.select("file_hash").distinct(), "file_hash", "left_semi").drop("run", "bucket")


def compact_registry(lake: Lake, runs: list[str], into: str, rows: DataFrame | None = None) -> None:
    """Makes the segments and filters of several runs those of one run, with all their rows or the written ``rows``."""
    if rows is None:
        old = lake.read("registry", SEGMENTED).where(F.col("run").isin(runs)).drop("run", "bucket")
        # Written aside first, as they are read from the folders that are replaced.
        rows = lake.append("registry-next", old, into)
    append_registry(lake, rows, into)
    gone = [r for r in runs if r != into]
    lake.clear("registry", gone, f"{REGISTERED}, bucket string", by="bucket")
    lake.clear("registry_filters", gone, FILTER.removeprefix("run string, "))
