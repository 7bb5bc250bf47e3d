"""SimHash near-duplicates: fingerprints that differ in few bits, found through segment bit counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
import xxhash

from steadyseed.functions.skew import HOT_KEYS_AT_MOST, HOT_ROWS, lookup_join
from steadyseed.llm.common import by_slices, col, mark_of, saved, staying, text_of
from steadyseed.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
SHINGLES_AT_ONCE = 1 << 16
LOW_BITS = 0x5555555555555555  # the lower bit of each two-bit segment
MIDDLE_BITS = 0x2222222222222222  # the lower middle bit of each four
HALF = 0xFFFFFFFF
HOT_PRINTS = 1000  # groups and parts of fewer fingerprints are not worth spreading


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of the text's word shingles, repeats included, as a signed integer; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    stops = ends[min(size, len(words)) - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(stops), SHINGLES_AT_ONCE):
        pairs = zip(starts[at : at + SHINGLES_AT_ONCE], stops[at : at + SHINGLES_AT_ONCE], strict=False)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], HASH_SEED) for a, b in pairs], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(stops)).tobytes(), "big", signed=True)


def fingerprints(text: Column, size: int = SHINGLE_WORDS) -> Column:
    def work():
        return lambda texts: pa.array([fingerprint(t, size) for t in texts.to_pylist()], pa.int64())

    return by_slices(text, "bigint", work)


def counts_code(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, each written in unary (0: 00, 1: 01, 2: 11).

    The Manhattan distance of two count vectors is the number of bits in which the
    codes differ, and never more than the bits in which the fingerprints differ.
    """
    low, high = F.lit(LOW_BITS), F.shiftrightunsigned(fp, 1)
    either, both = fp.bitwiseOR(high).bitwiseAND(low), fp.bitwiseAND(high).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def crossed(fp: Column) -> Column:
    """The fingerprint with the middle bits of each four exchanged, so that its segments lie across the first ones."""
    odd = fp.bitwiseXOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(F.lit(MIDDLE_BITS))
    return fp.bitwiseXOR(odd.bitwiseOR(F.shiftleft(odd, 1)))


def visits(prints: DataFrame) -> DataFrame:
    """``prints`` (fp, ..) with the grid cells (half, cell) that each fingerprint visits.

    A cell holds the bit counts of one half under two coverings by segments, plain
    and crossed. Of two fingerprints at four bits or less, one half differs in two
    at most; each fingerprint visits its own cell there and those of its 32 one-bit
    changes, so the two meet. Both coverings together tell 15 of 16 values of four
    bits apart, where one alone tells 9: fingerprints that meet by chance are rare.
    """
    flips = [
        F.struct(F.lit(half).alias("half"), F.lit(flip if flip < 1 << 63 else flip - (1 << 64)).cast("bigint").alias("flip"))
        for half in (0, 1) for flip in (0, *[1 << (32 * half + b) for b in range(32)])
    ]
    changed = F.col("fp").bitwiseXOR(F.col("flip"))
    plain, across = counts_code(changed), counts_code(crossed(changed))
    low = plain.bitwiseAND(F.lit(HALF)).bitwiseOR(F.shiftleft(across, 32))
    high = F.shiftrightunsigned(plain, 32).bitwiseOR(F.shiftleft(F.shiftrightunsigned(across, 32), 32))
    return prints.select("*", F.inline(F.array(*flips))).withColumn("cell", F.when(F.col("half") == 0, low).otherwise(high)).drop("flip")


def spread_out(prints: DataFrame) -> DataFrame:
    """Dealt out over all partitions, as few bytes become many rows."""
    return prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def near_copies(prints: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that differ in one or two bits.

    Every fingerprint visits itself and its 64 one-bit neighbours; all that meet
    in one place are at two bits or less from each other, so each is linked to the
    place's smallest alone: the rows are 65 per fingerprint however dense a group.
    """
    prints = spread_out(prints)
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(-(1 << 63) if b == 63 else 1 << b).cast("bigint") for b in range(64)])
    visits = prints.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("place"))
    # a place's least and greatest visitor tell whether several met there
    met = visits.groupBy("place").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most")
    met = saved(met.select("place", "least"), "met")
    back = met.select("least", F.explode(F.transform(flips, lambda f: F.col("place").bitwiseXOR(f))).alias("fp"))
    return back.join(prints, "fp", "left_semi").select(F.col("fp").alias("u"), F.col("least").alias("v"))


def far_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links between fingerprints of different ``part``s that differ in at most ``max_bits`` bits.

    The grid join proposes pairs that share a cell, the Manhattan distance of the
    bit counts is the lower bound, and the bits themselves decide. Neither side is
    ever broadcast: Spark knows the size of the fingerprints, not of their 66 visits.
    """
    placed = visits(spread_out(prints).withColumn("code", counts_code(F.col("fp"))))
    a, b = placed.alias("a"), placed.hint("merge").alias("b")
    return a.join(
        b,
        (F.col("a.cell") == F.col("b.cell")) & (F.col("a.half") == F.col("b.half")) & (F.col("a.part") < F.col("b.part"))
        & (F.bit_count(F.col("a.code").bitwiseXOR(F.col("b.code"))) <= max_bits)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits),
    ).select(F.col("a.part").alias("u"), F.col("b.part").alias("v"))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Per document: (doc_id, mark, fp, group, component_id).

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``max_bits`` (4 or less) differing bits, itself included; ``group`` names the
    same component by its smallest fingerprint.

    Nulls: a null text is an empty text, whose fingerprint is 0 like that of any
    text without words; these are linked like others. A null doc_id is smaller
    than none: a component of such rows only has a null ``component_id``. Repeated
    rows share a fingerprint. An empty table gives an empty result.

    Equal fingerprints are one node. Dense groups are joined through
    ``near_copies`` first; the pair search then only returns pairs between
    different parts. Fingerprints of a large group, and rows of a fingerprint with
    more than 1/1000 of all rows, are spread over salts before they meet their names.
    """
    if not 2 <= max_bits <= 4:
        raise ValueError("the grid is exact for two to four bits")
    rows = saved(docs.select(
        col(id_col).cast("bigint").alias("doc_id"), mark_of(text_of(text_col)).alias("mark"), fingerprints(text_of(text_col), size).alias("fp")
    ), "fingerprints")
    prints = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "prints")
    near = saved(components(near_copies(prints.select("fp"))), "near-parts")
    hot = prints.where(F.col("copies") > F.greatest(F.lit(HOT_ROWS), prints.agg(F.sum("copies") / HOT_KEYS_AT_MOST).scalar())).select("fp")
    parts = saved(
        prints.join(near.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first_id", F.coalesce("component", "fp").alias("part")), "parts",
    )
    far = saved(components(far_links(parts.select("fp", "part"), max_bits)), "far-parts")
    groups = lookup_join(parts, far.withColumnRenamed("node", "part"), ["part"], "fp", "left", hot_at_least=HOT_PRINTS).select(
        "fp", "first_id", F.coalesce("component", "part").alias("group")
    )
    groups = saved(groups, "print-groups")
    smallest = groups.groupBy("group").agg(F.min("first_id").alias("component_id"))
    named = lookup_join(groups, smallest, ["group"], "fp", hot_at_least=HOT_PRINTS).select("fp", "group", "component_id")
    return lookup_join(rows, named, ["fp"], "doc_id", hot=hot).select("doc_id", "mark", "fp", "group", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per component with the columns of ``docs``: the one with the smallest doc_id.

    Nulls, empty texts and empty tables as in ``link``. A component of rows without
    a doc_id keeps one of them, and of rows that repeat doc_id and text any one stays.
    """
    linked = saved(link(docs, id_col, text_col, size, max_bits), "linked")
    report = linked.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return staying(docs, report, id_col, text_col)


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
