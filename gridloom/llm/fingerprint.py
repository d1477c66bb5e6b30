"""Document fingerprints: bottom-k sketches of hashed word shingles, in SQL functions only.

A sketch is a sorted ``array<bigint>`` of the k smallest distinct hashes of a text's shingles. Sketches of parts merge to the sketch
of the whole. A text of fewer words than a shingle has one shingle of all its words; a null, empty or blank text has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import settle

SIZE, K = 5, 128


def with_sketches(df: DataFrame, texts: dict[str, str], k: int = K, size: int = SIZE) -> DataFrame:
    """``df`` with a sketch column for each ``{sketch: text column}``. Two steps, so that no lambda repeats the word hashing."""
    words = {
        f"__words_{out}": F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
        for out, text in texts.items()
    }
    df = df.withColumns(words)
    sketches = {}
    for out in texts:
        sketches[out] = F.slice(F.sort_array(F.array_distinct(_runs(F.col(f"__words_{out}"), size))), 1, k)
    return df.withColumns(sketches).drop(*words)


def _runs(words: Column, size: int) -> Column:
    """A hash of each run of ``size`` word hashes; past the end of a short text ``get`` gives null, which the hash leaves out."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))
    runs = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))
    return F.when(F.size(words) > 0, runs).otherwise(F.array().cast("array<bigint>"))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets; 1 for two empty sketches."""
    union = merge(a, b, k)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(F.array_intersect(union, a), b)).cast("double"), F.size(union).cast("double")), F.lit(1.0))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too (0 to 1; 1 for an empty a)."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(both, distinct_shingles(a, k)), F.lit(1.0)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.hex(x)), ",")


def from_text(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: F.conv(x, 16, -10).cast("bigint"))


def successors(ids: DataFrame) -> DataFrame:
    """For each distinct non-null ``doc_id`` the next lower one, for the lowest the highest: (doc_id, next_id).

    Range partitions are ordered each by itself; one row of each partition links it to the one below.
    """
    parts = settle(ids.repartitionByRange("doc_id").select("doc_id", F.spark_partition_id().alias("part")), "successors")
    inner = parts.withColumn("below", F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.desc("doc_id"))))
    tops = parts.groupBy("part").agg(F.max("doc_id").alias("top"))
    down = Window.orderBy(F.desc("part"))  # one row a partition
    tops = tops.select("part", F.lead("top").over(down).alias("next_top"), F.max("top").over(Window.partitionBy()).alias("highest"))
    return inner.join(tops, "part").select("doc_id", F.coalesce("below", "next_top", "highest").alias("next_id"))


def fingerprint_chain(docs: DataFrame, k: int = K, size: int = SIZE) -> DataFrame:
    """Each document beside an edited self and its successor (next lower doc_id; after the lowest the highest).

    The edit replaces the last ``floor(n_chars/3)`` code points by the first as many (or all) of the successor's text. Null texts count
    as empty. Rows without doc_id have no successor: the edit only cuts. Where a doc_id repeats, every row stays, and as a
    successor the id has the least of its texts. Only the heads and sketches of successors travel; the texts are shuffled once.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lengths = settle(docs.select("doc_id", F.floor(F.length("text") / 3).cast("int").alias("m")).filter("doc_id is not null"), "lengths")
    ids = lengths.groupBy("doc_id").agg(F.max("m").alias("m"), F.count("*").alias("n"))
    ids = settle(ids, "ids")
    repeated = ids.filter("n > 1").limit(1).count() > 0
    links = successors(ids.select("doc_id")).join(ids.select("doc_id", "m"), "doc_id")
    # both joins read the same exchange of the texts by doc_id; sketches are made behind it
    known = docs.filter("doc_id is not null")
    after = known.groupBy("doc_id").agg(F.min("text").alias("text")) if repeated else known
    heads = with_sketches(links.select(F.col("doc_id").alias("of"), F.col("next_id").alias("doc_id"), "m").join(after, "doc_id"), {"next_sketch": "text"}, k, size)
    heads = heads.select("of", F.substr("text", F.lit(1), F.col("m")).alias("head"), "next_sketch")
    both = known.join(heads, F.col("doc_id") == F.col("of")).drop("of")
    alone = docs.filter("doc_id is null").withColumns({"head": F.lit(""), "next_sketch": F.lit(None).cast("array<bigint>")})
    n = F.length("text")
    m = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - m), F.substr("head", F.lit(1), m))
    both = both.unionByName(alone).select("doc_id", "text", n.cast("long").alias("n_chars"), "next_sketch", edited.alias("edited"))
    return with_sketches(both, {"sketch": "text", "edited_sketch": "edited"}, k, size)


def digest(docs: DataFrame, k: int = K, size: int = SIZE) -> DataFrame:
    chain = fingerprint_chain(docs, k, size)
    return chain.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        F.when(F.col("next_sketch").isNull(), 0.0).otherwise(resemblance(F.col("sketch"), F.col("next_sketch"), k)).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("distinct_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_in_edited"),
    )
