"""Mixing sources to target weights by Pareto order sampling.

Each source gets a fixed number of rows, its share of the total by target weight.
Inside a source a document is wanted in proportion to its size: ``m`` times on
average.  ``floor(m)`` whole copies are certain; for the fraction ``p`` that is left the
documents are ranked by ``[u / (1-u)] / [p / (1-p)]`` with a random ``u`` hashed from the
id, and the least ranks fill the places left, so the sample has a fixed size and
unequal inclusion probabilities.

The place of the last selected rank is found from a histogram of ranks in each source
and an exact ordering inside the one bin that holds it; texts pass only through
joins with per-source rows, so no source, however hot, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Sealed, shared_dir, small_side, table, written

#: Rows of the sample per 100 rows of the input.
PERCENT = 100
#: Target weight of a source: its number of rows to this power, normalised; 1 keeps the mix, 0 makes it uniform.
TEMPERATURE = 0.5
SEED = "mix-1"
#: Histogram bins of a source.
BINS = 4096
_SPAN = 2.0**52


def _size(n_chars: Column) -> Column:
    """Integer size measure, so that sums are exact: ten times the fourth root of the length, 10 at least."""
    return F.greatest(F.lit(10), F.floor(F.lit(10.0) * F.sqrt(F.sqrt(F.greatest(n_chars, F.lit(1)).cast("double"))))).cast("long")


def _uniform(key: Column) -> Column:
    h = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(key.cast("string"), F.lit("\\N")))), 1, 13), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(_SPAN)


def allocate(counts: DataFrame, weights: DataFrame | None, percent: float, temperature: float) -> DataFrame:
    """``(src, rows, size, want)``: rows wanted of each source, by largest remainder, from ``(src, rows, size)``.

    Sources without a target weight in ``weights`` ``(src, weight)`` get none; null is a source.
    """
    if weights is None:
        w = counts.withColumn("weight", F.pow(F.col("rows").cast("double"), F.lit(float(temperature))))
    else:
        w = counts.join(weights.select(F.col("src").alias("__s"), "weight"), F.col("src").eqNullSafe(F.col("__s")), "left").drop("__s")
        w = w.withColumn("weight", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)))
    total = counts.agg(F.floor(F.coalesce(F.sum("rows"), F.lit(0)) * F.lit(percent) / 100).cast("long").alias("total"))
    norm = w.agg(F.sum("weight").alias("norm"))
    w = w.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(norm)).withColumn("exact", F.when(F.col("norm") > 0, F.round(F.col("total") * F.col("weight") / F.col("norm"), 6)).otherwise(0.0))
    w = w.withColumn("base", F.floor("exact").cast("long"))
    # one row a source: the order over all of them is small whatever the number of documents
    short = w.agg(F.sum("base").alias("given"))
    rank = F.row_number().over(W.orderBy(F.desc(F.col("exact") - F.col("base")), F.asc_nulls_first("src")))
    w = w.crossJoin(F.broadcast(short)).withColumn("want", F.col("base") + F.when((F.col("weight") > 0) & (rank <= F.col("total") - F.col("given")), 1).otherwise(0))
    return w.select("src", "rows", "size", "want")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_chars", weights: DataFrame | None = None, percent: float = PERCENT, temperature: float = TEMPERATURE, copy: str | None = "copy") -> DataFrame:
    """``docs``, each row as often as sampled, with the column ``copy``, if any, numbering a row's copies from 0.

    A null source is a source of its own; a null size counts as the least size; null
    ids draw one number as if they were one id.  Equal ranks go by id, nulls last;
    rows that tie in id and source are interchangeable, and just as many of them are
    taken as there are places.  Texts are not looked at.  Other columns, whatever their
    names, stay; one called as ``copy`` is replaced.  No rows, or no weight above 0, give no rows.
    """
    path = shared_dir(docs.sparkSession)
    sealed = Sealed(docs)
    key, source = sealed.col(id_col), sealed.col(source_col)
    size = _size(sealed.col(size_col) if size_col in sealed else F.lit(1))
    unit = sealed.df.select(key.alias("id"), source.alias("src"), size.alias("x"))
    counts = written(unit.groupBy("src").agg(F.count("*").alias("rows"), F.sum("x").alias("size")), f"{path}/counts")
    plan = written(allocate(counts, weights, percent, temperature), f"{path}/plan")
    sources = plan.count()

    def ranked(rows: DataFrame) -> DataFrame:
        side = small_side(plan.select(F.col("src").alias("__src"), F.col("want").alias("__want"), F.col("size").alias("__size")), sources)
        rows = rows.join(side, rows["__s"].eqNullSafe(F.col("__src")))
        rows = rows.withColumn("__m", F.col("__want") * F.col("__x") / F.col("__size"))
        rows = rows.withColumn("__whole", F.expr("(__want * __x) div __size"))
        p = (F.col("__want") * F.col("__x") - F.col("__whole") * F.col("__size")) / F.col("__size")
        rows = rows.withColumn("__p", p).withColumn("__u", _uniform(F.col("__i")))
        odds = (F.col("__u") / (1 - F.col("__u"))) / (F.col("__p") / (1 - F.col("__p")))
        return rows.withColumn("__q", F.when(F.col("__p") > 0, odds))

    keyed = unit.select(F.col("id").alias("__i"), F.col("src").alias("__s"), F.col("x").alias("__x"))
    cut = _cuts(ranked(keyed), path)
    cuts = small_side(cut, sources)
    rows = sealed.df.withColumns({"__i": key, "__s": source, "__x": size})
    rows = ranked(rows).join(cuts, F.col("__src").eqNullSafe(F.col("__c")), "left")
    before = (F.col("__q") < F.col("cut_q")) | ((F.col("__q") == F.col("cut_q")) & _before("__i", "cut_i"))
    at = (F.col("__q") == F.col("cut_q")) & F.col("__i").eqNullSafe(F.col("cut_i"))
    extra = F.when(F.col("__q").isNull() | F.col("cut_q").isNull(), 0).when(before | (at & (F.col("tied") == F.col("take"))), 1).otherwise(0)
    out = rows.withColumn("__n", F.col("__whole") + extra)
    split = not cut.where("tied > take").isEmpty()
    if split:  # several rows share the last selected id: number them
        tie = F.coalesce(at & (F.col("tied") > F.col("take")), F.lit(False))
        some = out.where(tie).withColumn("__r", F.row_number().over(W.partitionBy("__s", "__i").orderBy("__x")))
        some = some.withColumn("__n", F.col("__n") + F.when(F.col("__r") <= F.col("take"), 1).otherwise(0)).drop("__r")
        out = out.where(~tie).unionByName(some)
    out = out.where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int"))))
    return sealed.open(out) if copy is None else sealed.open(out, F.col("__copy").alias(copy), drop=copy.lower())


def _before(a: str, b: str) -> Column:
    """Whether id ``a`` precedes ``b``, nulls last."""
    return F.coalesce(F.col(a) < F.col(b), F.col(a).isNotNull() & F.col(b).isNull())


def _cuts(ranked: DataFrame, path: str) -> DataFrame:
    """Of each source ``(__c, cut_q, cut_i, take, tied)``: the last selected (rank, id), how many of its ``tied`` rows to take."""
    units = ranked.select("__s", "__i", "__want", "__whole", "__q", F.least(F.lit(BINS - 1), F.floor(F.col("__q") / (1 + F.col("__q")) * BINS)).cast("int").alias("__b"))
    hist = units.groupBy("__s", "__b").agg(F.count("*").alias("n"), F.sum("__whole").alias("w"), F.first("__want").alias("want"))
    hist = written(hist, f"{path}/bins")
    need = hist.groupBy("__s").agg((F.first("want") - F.sum("w")).alias("need"))
    upto = F.sum("n").over(W.partitionBy("__s").orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow))
    bins = hist.where("__b IS NOT NULL").withColumn("upto", upto).join(need.withColumnRenamed("__s", "__t"), F.col("__s").eqNullSafe(F.col("__t")))
    bins = bins.where("need > upto - n AND need <= upto").select(F.col("__s").alias("__c"), F.col("__b").alias("__cb"), (F.col("need") - F.col("upto") + F.col("n")).alias("left"))
    bins = written(bins, f"{path}/cut-bins")
    inside = units.join(small_side(bins, bins.count()), F.col("__s").eqNullSafe(F.col("__c")) & (F.col("__b") == F.col("__cb")))
    w = W.partitionBy("__c").orderBy("__q", F.asc_nulls_last("__i"))
    inside = inside.withColumn("r", F.row_number().over(w)).withColumn("first", F.rank().over(w))
    inside = inside.withColumn("tied", F.count("*").over(W.partitionBy("__c", "__q", "__i")))
    last = inside.where("r = left").select("__c", F.col("__q").alias("cut_q"), F.col("__i").alias("cut_i"), (F.col("left") - F.col("first") + 1).alias("take"), "tied")
    return written(last, f"{path}/cuts")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed sample of ``documents``."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy")


_X = "greatest(10, CAST(floor(10.0::DOUBLE * sqrt(sqrt(CAST(greatest(coalesce(n_chars, 1), 1) AS DOUBLE)))) AS BIGINT))"
QUERIES = {"op9_mix_sources": op9_mix_sources}
ORACLE = {
    "op9_mix_sources": f"""
    WITH d AS (
        SELECT doc_id, source, {_X} AS x,
               (CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '\\N')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {_SPAN}::DOUBLE AS u
        FROM documents),
    c AS (SELECT source, count(*) AS rows, CAST(sum(x) AS BIGINT) AS size FROM d GROUP BY source),
    e AS (
        SELECT *, floor((SELECT sum(rows) FROM c) * {PERCENT} / 100) AS total,
               round(floor((SELECT sum(rows) FROM c) * {PERCENT} / 100) * pow(rows, {TEMPERATURE}::DOUBLE) / (SELECT sum(pow(rows, {TEMPERATURE}::DOUBLE)) FROM c), 6) AS exact
        FROM c),
    p AS (
        SELECT source, size, CAST(floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, source NULLS FIRST) <= total - (SELECT sum(floor(exact)) FROM e) THEN 1 ELSE 0 END AS BIGINT) AS want
        FROM e),
    m AS (
        SELECT d.doc_id, d.source, d.u, want, (want * x) // size AS whole, (want * x - ((want * x) // size) * size) / size::DOUBLE AS p
        FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
    r AS (
        SELECT *, CASE WHEN p > 0 THEN row_number() OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END NULLS LAST, doc_id NULLS LAST) END AS rn,
               want - sum(whole) OVER (PARTITION BY source) AS need
        FROM m)
    SELECT doc_id, source, CAST(unnest(range(CAST(whole + CASE WHEN rn <= need THEN 1 ELSE 0 END AS BIGINT))) AS INTEGER) AS copy
    FROM r
    """
}
