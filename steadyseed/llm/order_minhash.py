"""Document fingerprints that feel edits: Order MinHash in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyseed.llm.common import col, text_of

PIECE = r"[^\x20\x09-\x0D]{1,8}"  # the units: words, longer ones in pieces of eight letters
UNITS = 3  # units of a k-mer
LONG = r"[^\x20\x09-\x0D]{25,}"  # runs longer than a k-mer of whole pieces: cut by content
SEEN, ONE_IN, MOST_LETTERS = 4, 8, 64  # a cut follows one in so many groups of four letters; no piece is longer than 64
BIN_BITS = 6  # 64 components
TUPLE = 2  # k-mers of a component
POSITION_BITS, KEY_BITS = 27, 30
ROWS_PER_RANGE, MOST_RANGES = 2000, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def low_bits(value: Column, bits: int) -> Column:
    return value.bitwiseAND(F.lit((1 << bits) - 1))


def run_starts(sorted_: Column, shift: int) -> Column:
    """Where a new value of the bits above ``shift`` begins in a sorted array."""
    begins = lambda i: (i == 0) | (F.shiftright(F.get(sorted_, i), shift) != F.shiftright(F.get(sorted_, i - 1), shift))
    return F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), begins)


def content_pieces(run: Column) -> Column:
    """Hashes of the pieces of a run without white space, cut after letters whose hash with those before says so.

    An edit moves the cuts next to it only, wherever in the run it is.
    """
    def pieces(letters: Column) -> Column:
        cut_before = lambda i: (i == 0) | (F.pmod(F.xxhash64(F.slice(letters, F.greatest(i - SEEN, F.lit(0)) + 1, F.least(i, F.lit(SEEN)))), F.lit(ONE_IN)) == 0)
        cuts = F.filter(F.sequence(F.lit(0), F.size(letters) - 1), cut_before)
        starts = let(cuts, lambda b: F.flatten(F.transform(
            b, lambda at, j: F.sequence(at, F.coalesce(F.get(b, j + 1), F.size(letters)) - 1, F.lit(MOST_LETTERS))
        )))
        return let(starts, lambda b: F.transform(
            b, lambda at, j: F.xxhash64(F.array_join(F.slice(letters, at + 1, F.coalesce(F.get(b, j + 1), F.size(letters)) - at), ""))
        ))

    return let(F.regexp_extract_all(run, F.lit("(?s)."), F.lit(0)), pieces)


def unit_hashes(text: Column) -> Column:
    """Hashes of the units in text order."""
    units = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    mixed = F.flatten(F.transform(
        units(f"{LONG}|{PIECE}"), lambda unit: F.when(F.char_length(unit) > 24, content_pieces(unit)).otherwise(F.array(F.xxhash64(unit)))
    ))
    return F.when(text.rlike(LONG), mixed).otherwise(F.transform(units(PIECE), lambda unit: F.xxhash64(unit)))


def kmers(text: Column) -> Column:
    """Hashes of all runs of ``UNITS`` units in text order; a shorter text is one run."""
    hashes = unit_hashes(text)
    return let(hashes, lambda u: F.when(F.size(u) > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(u) - UNITS, F.lit(0))), lambda i: F.xxhash64(*[F.get(u, i + k) for k in range(UNITS)])
    )).otherwise(F.array().cast("array<bigint>")))


def numbered_keys(runs: Column) -> Column:
    """For each k-mer, component, key and position in one bigint, sorted.

    The key hashes the k-mer with its occurrence number in the text; the key's own
    bits choose the component, so that one pass serves all components.
    """
    high = F.lit(-1 << POSITION_BITS)
    placed = F.sort_array(F.transform(runs, lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("bigint"))))

    def keyed(s: Column) -> Column:
        starts = run_starts(s, POSITION_BITS)
        occurrence = let(starts, lambda b: F.flatten(F.transform(
            b, lambda at, j: F.sequence(F.lit(1), F.coalesce(F.get(b, j + 1), F.size(s)) - at)
        )))
        key = lambda x, n: low_bits(F.xxhash64(F.shiftright(x, POSITION_BITS), n), BIN_BITS + KEY_BITS)
        return F.sort_array(F.zip_with(s, occurrence, lambda x, n: F.shiftleft(key(x, n), POSITION_BITS).bitwiseOR(low_bits(x, POSITION_BITS))))

    return let(placed, keyed)


def signature(text: Column) -> Column:
    """Components in order: the component's number and 32 bits over the keys of its least k-mers, taken in text order.

    A component with fewer than ``TUPLE`` k-mers takes the least ones of the components
    after it (the first follows the last), so that it too holds an order. A component
    without k-mers is left out; a text without words has none.
    """
    def components(s: Column) -> Column:
        def component(b: Column, at: Column, j: Column) -> Column:
            own = F.slice(s, at + 1, F.least(F.lit(TUPLE), F.coalesce(F.get(b, j + 1), F.size(s)) - at))
            least = F.when(F.size(own) == TUPLE, own).otherwise(F.transform(
                F.sequence(F.lit(0), F.least(F.lit(TUPLE), F.size(s)) - 1), lambda k: F.get(s, (at + k) % F.size(s))
            ))
            in_order = F.sort_array(F.transform(least, lambda x: F.shiftleft(low_bits(x, POSITION_BITS), KEY_BITS).bitwiseOR(
                low_bits(F.shiftright(x, POSITION_BITS), KEY_BITS)
            )))
            number = F.shiftright(F.get(s, at), POSITION_BITS + KEY_BITS)
            return F.shiftleft(number, 32).bitwiseOR(low_bits(F.xxhash64(F.transform(in_order, lambda x: low_bits(x, KEY_BITS))), 32))

        return let(run_starts(s, POSITION_BITS + KEY_BITS), lambda b: F.transform(b, lambda at, j: component(b, at, j)))

    return let(kmers(text), lambda r: F.when(F.size(r) > 0, let(numbered_keys(r), components)).otherwise(F.array().cast("array<bigint>")))


def likeness(a: Column, b: Column) -> Column:
    """Equal components among those that either text has, 0 to 1; 1 for two texts without words."""
    numbers = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    either = F.size(F.array_union(numbers(a), numbers(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def fingerprint(components: Column) -> Column:
    """The signature as text: ten hex digits for each component."""
    return F.array_join(F.transform(components, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Rows of (id, mark, text, ..) with ``next_<c>`` for each carried column of the following row.

    Rows follow each other by id descending (null last), then mark, then text; the
    first follows the last. They are dealt out by ranges of id, and the first row
    of a range is also sent to the range before it, so each row and its follower
    meet without one task seeing all. Rows of one id are always in one range. On
    the driver are only the ends of at most ``MOST_RANGES`` ranges.
    """
    total = rows.count()
    ranges = min(max(total // ROWS_PER_RANGE, 1), MOST_RANGES)
    ends = []
    if ranges > 1:
        at = [i / ranges for i in range(1, ranges)]
        ends = sorted(set(rows.agg(F.percentile_approx("id", at, 20 * ranges)).first()[0] or []))
    cuts = F.array(*[F.lit(x).cast("bigint") for x in ends]).cast("array<bigint>")
    number = F.when(F.col("id").isNull(), -1).otherwise(F.size(F.filter(cuts, lambda c: c < F.col("id")))).cast("int")
    firsts = {r.range: r.first for r in rows.groupBy(number.alias("range")).agg(F.max("id").alias("first")).collect()}
    order = sorted(firsts, reverse=True)
    before = dict(zip(order, order[-1:] + order[:-1], strict=True))  # the first range follows the last
    pairs = [(r, firsts[r], before[r]) for r in order]
    ghost = F.lit(None).cast("int")
    if pairs:
        keys = F.array(*[F.lit(r) for r, _, _ in pairs])
        at = F.array_position(keys, number).cast("int") - 1
        first = F.get(F.array(*[F.lit(f).cast("bigint") for _, f, _ in pairs]), at)
        ghost = F.when(first.eqNullSafe(F.col("id")), F.get(F.array(*[F.lit(b) for _, _, b in pairs]), at))
    places = F.array_compact(F.array(
        F.struct(number.alias("range"), F.lit(False).alias("ghost")), F.when(ghost.isNotNull(), F.struct(ghost.alias("range"), F.lit(True).alias("ghost")))
    ))
    dealt = rows.withColumn("place", F.explode(places)).select("*", "place.range", "place.ghost").drop("place")
    follow = Window.partitionBy("range").orderBy("ghost", F.col("id").desc_nulls_last(), "mark", "text")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(follow) for c in carried}).where("NOT ghost").drop("range", "ghost")


def compare_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the last half of the code points (rounded down) replaced by
    as many from the beginning of the next document's text (or all it has), by
    descending doc_id; the first document follows the last, so a single document is
    its own next.

    Nulls: a null text is empty; its fingerprint is empty, and equal to that of any
    text without words (likeness 1). Null doc_ids come last. Rows that repeat a
    doc_id follow each other by a hash of their text, then by the text. An empty
    table gives an empty result. Other columns are not read. Whole texts are
    fingerprinted; they are shuffled once.
    """
    rows = docs.select(col(id_col).cast("bigint").alias("id"), F.xxhash64(text_of(text_col)).alias("mark"), text_of(text_col).alias("text"))
    rows = with_next(rows.withColumn("components", signature(F.col("text"))), ["text", "components"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).select(
        "id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "components", "next_components", signature(F.col("edited")).alias("edited_components"),
    )
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", fingerprint(F.col("components")).alias("fingerprint"),
        fingerprint(F.col("edited_components")).alias("edited_fingerprint"),
        likeness(F.col("components"), F.col("edited_components")).alias("near_edited"),
        likeness(F.col("components"), F.col("next_components")).alias("near_next"),
    )
