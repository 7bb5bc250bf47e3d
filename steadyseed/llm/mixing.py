"""Mixing sources to target weights by thresholds on a hash, found with histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyseed.functions.hashing import repeat_rows
from steadyseed.functions.numbering import numbered
from steadyseed.llm.common import WORD, col, saved, text_of, unused

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix"
HASH_BITS, LEVEL_BITS = 60, 10


def words(text: Column) -> Column:
    """How many words the text has, as bigint."""
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def draw(id_col: Column, digest: Column, nth: Column, seed: str = SEED) -> Column:
    """60 bits of md5 over seed, doc_id, the text's digest and the row's number among equal ones: its place in its source's order."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null")), digest, nth.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def source_key(source: Column) -> Column:
    """A text without nulls: "s" and the source, or "n"."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Add ``num`` and ``den``: a source's target is weight * num / den, or ``most`` times its size where capped.

    ``sources`` has (key, weight, source_size). The share of capped sources goes to
    the others by weight until no target is above its cap. Each round is one
    aggregate of one row; a source once capped stays so, hence it ends.
    """
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    total = sources.agg(F.sum(exact("source_size")), F.sum(exact("weight"))).first()
    num, den = (int(x or 0) for x in total)
    all_words, all_weights, capped = num, den, F.lit(False)
    while den:
        above = exact("weight") * F.lit(str(num)).cast("decimal(38,0)") > exact("source_size") * F.lit(str(most * den)).cast("decimal(38,0)")
        words_above, weights_above = (int(x or 0) for x in sources.where(above).agg(
            F.sum(exact("source_size") * F.lit(most).cast("decimal(2,0)")), F.sum(exact("weight"))
        ).first())
        capped = above
        if (all_words - words_above, all_weights - weights_above) == (num, den):
            break
        num, den = all_words - words_above, all_weights - weights_above
    share = F.col("weight").cast("double") * F.lit(float(num)) / F.lit(float(den or 1))
    cap = (F.col("source_size") * F.lit(most)).cast("double")
    return sources.withColumn("target", F.when(capped, cap).otherwise(share))


def cutoffs(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS
) -> DataFrame:
    """Per source of (key, place, size) rows: (key, source_size, target, repeats, cut).

    A document is taken ``repeats`` times and once more if its ``place`` is at or
    below ``cut``. Words are summed by source and bucket of the place's leading
    bits; the bucket in which the budget ends is refined by its next bits, and
    only its rows are read again, until it holds a single place. That last unit is
    taken if this comes nearer to the target (ties: taken).
    """
    shift = HASH_BITS - LEVEL_BITS
    histogram = saved(docs.groupBy("key", F.shiftright("place", shift).alias("bucket")).agg(
        F.sum("size").alias("words"), F.min("place").alias("low"), F.max("place").alias("high")
    ), "mix-histogram")
    sources = histogram.groupBy("key").agg(F.sum("words").alias("source_size"))
    order = [F.col("key") == F.lit("n"), F.col("key")]
    cycle = F.array(*[F.lit(w).cast("bigint") for w in weights])
    sources = numbered(sources, order, "position").withColumn(
        "weight", F.element_at(cycle, (F.col("position") % len(weights) + 1).cast("int"))
    )
    sources = saved(targets(saved(sources, "mix-sources"), weights, most), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most)).cast("bigint")).otherwise(F.lit(1).cast("bigint"))
    sources = sources.withColumn("repeats", whole).withColumn(
        "left", F.greatest(F.lit(0.0), F.col("target") - F.col("repeats") * F.col("source_size"))
    ).select("key", "source_size", "target", "repeats", "left")
    open_ = sources.where("left > 0 AND source_size > 0").select("key", "left")
    settled = sources.where("NOT (left > 0 AND source_size > 0)").select("key", F.lit(-1).cast("bigint").alias("cut"))
    rows = docs
    while True:
        upto = Window.partitionBy("key").orderBy("bucket")
        running = histogram.join(open_, "key").withColumn("upto", F.sum("words").over(upto))
        ends = running.where(F.col("upto") >= F.col("left")).groupBy("key").agg(
            F.min_by(F.struct("bucket", "words", "low", "high", "upto", "left"), "bucket").alias("at")
        ).select("key", "at.*").withColumn("left", F.col("left") - (F.col("upto") - F.col("words")))
        ends = saved(ends, "mix-boundary")
        take = 2 * F.col("left") >= F.col("words")
        single = F.col("low") == F.col("high")
        settled = saved(settled.unionByName(ends.where(single).select(
            "key", F.when(take, F.col("low")).otherwise(F.col("low") - 1).alias("cut")
        )), "mix-cuts")
        ends = ends.where(~single)
        if ends.isEmpty():
            break
        inside = rows.join(ends.select("key", "bucket"), "key").where(F.shiftright("place", shift) == F.col("bucket"))
        rows = saved(inside.select("key", "place", "size"), "mix-rows")
        shift -= LEVEL_BITS
        histogram = saved(rows.groupBy("key", F.shiftright("place", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("place").alias("low"), F.max("place").alias("high")
        ), "mix-histogram")
        open_ = ends.select("key", "left")
    return sources.join(settled, "key").select("key", "source_size", "target", "repeats", "cut")


def decide(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per document: (doc_id, size, source_size, target, copies, taken).

    Sizes are word counts; sources in code point order, null last, weigh
    ``weights`` in turn and share all words; a target above ``most`` times its
    source is cut there and the rest reshared. ``copies`` (0 to ``most``) is how
    often the mix has the document, ``taken`` = size * copies.

    Nulls: a null text has size 0, a null source is a source of its own. Rows of one
    doc_id in a source, and rows without one, are chosen one by one: their places
    hang on their texts too, and those of equal rows on their number, so targets are
    met however often an id or a row repeats. A source without any word has target
    0, and its documents have one copy (of no words). An empty table gives an empty
    result. The choice depends on doc_ids, texts and sources alone: reruns agree.
    """
    narrow = saved(_numbered_rows(docs, seed, id_col, text_col, source_col), "mix-sizes")
    plan = saved(cutoffs(narrow.select("key", "place", "size"), weights, most), "mix-plan")
    copies = F.col("repeats") + (F.col("place") <= F.col("cut")).cast("bigint")
    return narrow.join(plan, "key").withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def _numbered_rows(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, key, digest, size, place) per row. Equal rows are counted first and then written out with their numbers."""
    text = text_of(text_col)
    counted = docs.select(
        col(id_col).cast("bigint").alias("doc_id"), source_key(col(source_col)).alias("key"), F.md5(text.cast("binary")).alias("digest"),
        words(text).alias("size"),
    ).groupBy("doc_id", "key", "digest", "size").agg(F.count(F.lit(1)).alias("rows"))
    once = counted.where("rows = 1").withColumn("nth", F.lit(0).cast("bigint"))
    often = repeat_rows(counted.where("rows > 1"), "rows", "nth")
    return once.unionByName(often).select("doc_id", "key", "digest", "size", draw(F.col("doc_id"), F.col("digest"), F.col("nth"), seed).alias("place"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mixed documents with the columns of ``docs``, each row as often as ``decide`` says.

    Edge cases as in ``decide``; rows that agree in doc_id, text and source but not
    in other columns are numbered in the order of a hash of all columns.
    """
    key, digest, place, size, repeats, cut = unused(docs, "__key", "__digest", "__place", "__size", "__repeats", "__cut")
    text = text_of(text_col)
    plan = saved(cutoffs(
        saved(_numbered_rows(docs, seed, id_col, text_col, source_col), "mix-sizes").select("key", "place", "size"), weights, most
    ), "mix-plan").select(F.col("key").alias(key), F.col("repeats").alias(repeats), F.col("cut").alias(cut))
    keyed = docs.withColumns({key: source_key(col(source_col)), digest: F.md5(text.cast("binary"))})
    placed = _placed(keyed, key, digest, place, id_col, seed)
    copies = (F.col(repeats) + (F.col(place) <= F.col(cut)).cast("bigint")).cast("int")
    times = F.array_repeat(F.lit(0), copies)
    return placed.join(plan, key).withColumn(size, F.explode(times)).select(*[col(c) for c in docs.columns])


def _placed(keyed: DataFrame, key: str, digest: str, place: str, id_col: str, seed: str) -> DataFrame:
    """``keyed`` with ``place``; rows that have equals are numbered among them by ranges, so no group is one task's."""
    doc, rows, order, first = unused(keyed, "__doc", "__rows", "__order", "__first")
    keyed = keyed.withColumn(doc, F.coalesce(col(id_col).cast("bigint").cast("string"), F.lit("null")))
    same = [doc, key, digest]
    often = saved(keyed.groupBy(*same).agg(F.count(F.lit(1)).alias(rows)).where(F.col(rows) > 1).select(*same), "mix-equal")
    own = lambda nth: draw(col(id_col).cast("bigint"), F.col(digest), nth, seed)
    if often.isEmpty():
        return keyed.withColumn(place, own(F.lit(0)))
    once = keyed.join(often, same, "left_anti").withColumn(place, own(F.lit(0)))
    everything = F.xxhash64(F.to_json(F.struct(*[col(c) for c in keyed.columns])))
    counted = numbered(keyed.join(often, same, "left_semi").withColumn(rows, everything), [*[F.col(c) for c in same], F.col(rows)], order)
    starts = counted.groupBy(*same).agg(F.min(order).alias(first))
    repeated = counted.join(starts, same).withColumn(place, own(F.col(order) - F.col(first)))
    return once.unionByName(repeated.select(*once.columns))


def oracle_sql() -> str:
    """The same decisions with a running sum over each source, for checking; SEED and WEIGHTS as above."""
    return f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
            ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':' ||
                (row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1)), 1, 15))::BIGINT AS place FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size,
            (ARRAY{list(WEIGHTS)})[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT]::BIGINT AS weight
            FROM d GROUP BY source),
        o AS (SELECT *, row_number() OVER w AS k,
            (sum(source_size) OVER ())::DOUBLE - coalesce(sum({MOST_REPEATS} * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS num,
            (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS den
            FROM s WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source)),
        f AS (SELECT min_by(num, k) AS num, min_by(den, k) AS den, min(k) AS k FROM o WHERE weight * num <= {MOST_REPEATS}.0 * source_size * den),
        t AS (SELECT o.source, o.source_size, CASE WHEN o.k < f.k THEN {MOST_REPEATS}.0::DOUBLE * o.source_size
            ELSE o.weight::DOUBLE * f.num / f.den END AS target FROM o, f),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {MOST_REPEATS})::BIGINT ELSE 1 END AS repeats FROM t),
        l AS (SELECT *, greatest(0.0, target - repeats * source_size) AS rest FROM r),
        u AS (SELECT d.source, place, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY place) AS upto FROM d GROUP BY d.source, place),
        c AS (SELECT u.source, max(place) AS cut FROM u JOIN l ON u.source IS NOT DISTINCT FROM l.source
            WHERE source_size > 0 AND rest > 0 AND (upto < rest OR (upto - words < rest AND 2 * (rest - (upto - words)) >= words)) GROUP BY u.source)
    SELECT doc_id, size, source_size, target, size * (repeats + CASE WHEN place <= cut THEN 1 ELSE 0 END) AS taken
    FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source"""
