"""Operator 7: SpotSigs document fingerprints, in DataFrame functions only.

A spot is a common word (anchor) with the chain of the next CHAIN content words; its hash is a signature,
and a document's fingerprint is the ordered set of its signatures. Texts are lower-cased and split at
anything but letters and digits. The likeness of two fingerprints is the Jaccard coefficient of the sets.
``similar_pairs`` finds all pairs at least as alike as a threshold: equal sets stand for one, sets are
partitioned by their length and compared only with those of a fitting one, and only if their rarest
signatures meet.

Nulls and odd rows: a null text is empty. A text without an anchor (tables, other languages) has its words as
signatures, one without words an empty fingerprint; two empty ones are alike 1, an empty and another one 0. Equal
doc_ids are ordered by the hash of their texts, null ones come first. Repeated rows are rows of their own; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a al als an and are as at au auf aus auch avec be bei by como con dans das de del dem den der des die du ein eine el en es est et "
    "for from für has have il im in is ist it la las le les lo los mit nach nicht no not of on or par para pas por pour que qui se sich su "
    "sur that the this to un una und une von was which with y zu"
).split()
#: Content words of a chain, and segments between anchors in which they are looked for.
CHAIN, REACH = 2, 4
MARK = "\u0001"
#: Rows of a range of doc_ids, about; ranges at most (each is a row of a broadcast table); knots of the distribution.
RANGE, RANGES, KNOTS = 20_000, 1 << 16, (16, 16)


def with_signatures(df: DataFrame, text: str, out: str, anchors: list[str] | None = None) -> DataFrame:
    """Adds the sorted distinct signatures (array<long>) of a text column."""
    known = list(anchors or ANCHORS)
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    df = df.withColumn("_words", F.split(plain, " "))
    marked = F.array_join(F.transform("_words", lambda w: F.when(w.isin(known), F.concat(F.lit(MARK), w)).otherwise(w)), " ")
    df = df.withColumn("_parts", F.split(marked, MARK))
    # the parts after the first begin with an anchor; each is zipped with those behind it
    parts = F.col("_parts")
    zipped = F.arrays_zip(*[F.slice(parts, 2 + k, F.greatest(F.size(parts) - 1 - k, F.lit(0))).alias(f"p{k}") for k in range(REACH)])

    def rest(part: Column) -> Column:
        found = F.trim(F.substring(part, F.instr(part, " ") + F.lit(1), F.lit(1 << 30)))
        return F.when((F.instr(part, " ") > 0) & (found != ""), found)

    def spot(x: Column) -> Column:
        chain = F.substring_index(F.concat_ws(" ", *[rest(x[f"p{k}"]) for k in range(REACH)]), " ", CHAIN)
        return F.xxhash64(F.substring_index(x["p0"], " ", 1), chain).bitwiseAND((1 << 31) - 1)

    df = df.withColumn("_spots", F.transform(zipped, spot))
    words = F.transform(F.filter(F.split(F.element_at("_parts", 1), " "), lambda w: w != ""), lambda w: F.xxhash64(w).bitwiseAND((1 << 31) - 1))
    found = F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(words)
    return df.withColumn(out, F.array_sort(F.array_distinct(found))).drop("_words", "_parts", "_spots")


def fingerprint(signatures: str) -> Column:
    return F.array_join(F.transform(F.col(signatures), lambda s: F.lower(F.hex(s))), ",")


def likeness(a: str, b: str) -> Column:
    """Jaccard coefficient of two signature arrays."""
    both = F.size(F.array_intersect(F.col(a), F.col(b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def in_ranges(rows: DataFrame) -> DataFrame:
    """Adds _id (doc_id, the least number for null), _hash of the text, and _range, which never falls in their order.

    Ranges hold about equal counts: between knots of the distribution of doc_ids they are linear, and an id that
    several knots share is split by the hash of its texts.
    """
    coarse, fine = KNOTS
    every = coarse * fine
    rows = rows.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("_hash", F.xxhash64("text"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_id", [k / every for k in range(every + 1)], 10_000).alias("knots")).first()
    if not seen.n:
        return rows.withColumn("_range", F.lit(0))
    least = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(RANGES, max(least, math.ceil(seen.n / RANGE)))
    knots = [F.lit(k) for k in seen.knots]
    below = lambda array, strict: F.size(F.filter(array, (lambda k: k < F.col("_id")) if strict else (lambda k: k <= F.col("_id"))))
    blocks = F.array(*[F.array(*knots[k * fine : (k + 1) * fine]) for k in range(coarse)])
    firsts = F.array(*knots[fine:every:fine])  # first knots of the blocks but the first

    def place(strict: bool) -> Column:
        """Number of knots below the id (or not above it), counted in a block only."""
        block = below(firsts, strict)
        return block * fine + below(F.element_at(blocks, block + 1), strict)

    rows = rows.withColumn("_low", place(True)).withColumn("_high", F.greatest(place(False), F.lit(1)))
    at = F.array(*knots)
    before, after = F.element_at(at, F.col("_high")).cast("double"), F.element_at(at, F.col("_high") + 1).cast("double")
    part = F.col("_hash") / F.lit(float(1 << 64)) + 0.5
    inside = F.when(after > before, F.least((F.col("_id").cast("double") - before) / (after - before), F.lit(1.0))).otherwise(0.0)
    spread = F.when(F.col("_high") - F.col("_low") > 1, F.col("_low") + part * (F.col("_high") - F.col("_low") - 1)).otherwise(F.col("_high") - 1 + inside)
    number = F.least(F.floor(spread * (ranges / every)), F.lit(ranges - 1))
    return rows.withColumn("_range", F.greatest(number, F.lit(0)).cast("int")).drop("_low", "_high")


def beside_next(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text) by ranges, the first row of each range also, with _behind = 1, behind the last row of the range before it.

    After the last row comes the first. Only (doc_id, text) is shuffled; what is asked of the next row follows by ``next_of``.
    """
    ranged = in_ranges(rows)
    firsts = ranged.groupBy("_range").agg(F.min(F.struct("_id", "_hash")).alias("_f"))
    # a row for each range, RANGES at most
    before = F.coalesce(F.lag("_range").over(Window.orderBy("_range")), F.max("_range").over(Window.partitionBy(F.lit(0))))
    firsts = firsts.select(F.col("_range").alias("_own"), F.col("_f._id").alias("_first"), F.col("_f._hash").alias("_fh"), before.alias("_before"))
    behind = ranged.join(F.broadcast(firsts), (F.col("_range") == F.col("_own")) & (F.col("_id") == F.col("_first")) & (F.col("_hash") == F.col("_fh")))
    behind = behind.dropDuplicates(["_range"]).withColumn("_range", F.col("_before")).select(*ranged.columns)
    return ranged.withColumn("_behind", F.lit(0)).unionByName(behind.withColumn("_behind", F.lit(1)))


def next_of(rows: DataFrame, column: str) -> DataFrame:
    """Adds next_<column> to rows of ``beside_next``."""
    inside = Window.partitionBy("_range").orderBy("_behind", "_id", "_hash")
    return rows.withColumn(f"next_{column}", F.lead(column).over(inside))


def edited_text(text: str = "text", following: str = "next_text") -> Column:
    """The last quarter of a text replaced by as much of the beginning of the following one."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), n - cut), F.substring(F.col(following), F.lit(1), cut))


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents, null texts as empty ones."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, signatures) for documents (doc_id, text)."""
    return with_signatures(texts(docs), "text", "signatures")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, signatures, edited, edited_signatures, next_signatures) of each document and its edited text."""
    rows = next_of(beside_next(texts(docs)), "text").withColumn("edited", edited_text()).drop("next_text")
    rows = next_of(with_signatures(rows, "text", "signatures"), "signatures").where("_behind = 0").drop("_range", "_behind", "_id", "_hash")
    return with_signatures(rows, "edited", "edited_signatures")


def similar_pairs(prints: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) of classes of equal signature sets with a < b, and members (doc_id, class).

    A class is the hash of its set. Of two sets that are alike by the threshold, the lengths differ at most
    by its factor and one of the rarest signatures of each is the same; only such pairs are compared. Lengths are
    partitioned by powers of the factor, and a partition meets itself and the next longer one.
    """
    members = materialize(prints.select("doc_id", F.xxhash64("signatures").alias("class")))
    sets = materialize(prints.select(F.xxhash64("signatures").alias("class"), "signatures").dropDuplicates(["class"]))
    single = sets.select("class", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    counts = single.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy("class").orderBy("df", "s")
    kept = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    probes = materialize(single.join(counts, "s").withColumn("_k", F.row_number().over(rare)).where(F.col("_k") <= kept).select("class", "n", "s"))
    length = F.floor(F.log(F.col("n")) / math.log(1 / threshold) + 1e-9) if threshold < 1 else F.col("n")
    left, right = (probes.select("s", F.col("class").alias(c), F.col("n").alias(f"n_{c}"), length.cast("int").alias("length")) for c in "ab")
    left = left.withColumn("own", F.col("length")).withColumn("length", F.explode(F.array(F.col("length"), F.col("length") + 1)))
    fits = ((F.col("length") > F.col("own")) | (F.col("a") < F.col("b"))) & (F.col("n_a") >= F.col("n_b") * threshold - 1e-9) & (F.col("n_b") >= F.col("n_a") * threshold - 1e-9)
    found = left.join(right, ["s", "length"]).where(fits)
    pairs = materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for c in "ab":
        pairs = pairs.join(sets.select(F.col("class").alias(c), F.col("signatures").alias(f"set_{c}")), c)
    found = pairs.select("a", "b", likeness("set_a", "set_b").alias("likeness")).where(F.col("likeness") >= threshold)
    return found, members
