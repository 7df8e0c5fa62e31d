"""Mixing sources to target weights, with DataFrame functions only.

Sources in the order of their names' code points, null last, get the weights
in turn; together they share ``share`` of all words.  No source's target goes
beyond ``epochs`` times its words: what would is dealt again by weight to the
others (water filling, solved in one pass over the sources sorted by cap for
each unit of weight).

Within a source, documents stand in the order of a hash of their id, or of
their text where they have none.  The
prefix sums of their sizes are made in three levels, so that no source, however
large, is summed by one task: documents fall by their hash into fine buckets
of about ``BUCKET`` documents, these into coarse ones of as many fine ones; a
window adds up the rows of a fine bucket, the fine ones of a coarse one, and
the coarse ones of a source.  Only ids and sizes are shuffled, never texts.

A document takes its size once for each full epoch, and of the last epoch as
many words as lie before its source's budget; so a source takes exactly its
target, rounded down.

Defined cases: a null or blank text has size 0 and takes 0; a null source is a
source of its own; a source without words has target 0; repeated rows and null
ids count by row, ties of the hash go by id and size, and rows equal in these
are interchangeable; an empty table gives no row; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import WORD, fresh
from postlens.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
#: Documents expected in a fine bucket, and fine buckets in a coarse one.
BUCKET = 1000
#: Sources (a row each) whose ends are sent to all tasks; of more than these they are joined.
SOURCES = 100_000


def order_key(doc_id: Column, text: Column) -> Column:
    """52 bits of the MD5 of the id as text, or of the text where the id is null, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """Id, source, size in words and order key of each document."""
    return docs.select("doc_id", "source",
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       order_key(F.col("doc_id"), F.col("text")).alias("key"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row for each source: its words, documents and target."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    # sources that a rising water level fills come first
    full = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    done = full.rowsBetween(Window.unboundedPreceding, -1)
    left = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    by = by.withColumn("level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(done), F.lit(0.0)))
                       / F.sum("weight").over(left))
    # the first source that the level of the rest doesn't fill sets the level
    by = by.withColumn("place", F.row_number().over(full))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(every)
    target = F.least(F.col("cap"), F.coalesce(level["level"] * F.col("weight"), F.col("cap")))
    return by.select("source", "source_size", "n_docs", F.round(target, 6).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and, after these, ``source`` and the place ``starts``: the words
    of the source that stand before the document."""
    return placed(docs, weights, share, epochs).select("doc_id", "size", "source_size", "target", "taken", "source", "starts")


def placed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """What ``mix`` gives, with the order ``key`` and the full epochs, ``turns``, and words of the last one, ``last``."""
    sizes = sized(docs)
    of = targets(sizes, weights, share, epochs)
    rows = sizes.join(of.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    fine = F.floor(F.col("key") / F.lit(float(16**13)) * F.ceil(F.col("n_docs") / BUCKET)).cast("long")
    rows = rows.withColumn("fine", fine).withColumn("coarse", F.floor(F.col("fine") / BUCKET).cast("long"))
    sums = rows.groupBy("source", "coarse", "fine").agg(F.sum("size").alias("words"))

    def before(words: str, window) -> Column:
        return F.coalesce(F.sum(words).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    coarse = sums.groupBy("source", "coarse").agg(F.sum("words").alias("words"))
    coarse = coarse.select("source", "coarse", before("words", Window.partitionBy("source").orderBy("coarse")).alias("at"))
    sums = sums.join(coarse.select(F.col("source").alias("_s"), F.col("coarse").alias("_c"), "at"),
                     F.col("source").eqNullSafe(F.col("_s")) & (F.col("coarse") == F.col("_c")))
    sums = sums.select(F.col("source").alias("_s"), F.col("fine").alias("_f"),
                       (F.col("at") + before("words", Window.partitionBy("source", "coarse").orderBy("fine"))).alias("at"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("fine") == F.col("_f")))
    starts = F.col("at") + before("size", Window.partitionBy("source", "fine").orderBy("key", F.col("doc_id").asc_nulls_first(), "size"))
    rows = rows.withColumn("starts", starts)
    budget = F.floor("target").cast("long")
    turns = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - turns * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("starts")))
    return rows.select("doc_id", "size", "source_size", "target", (turns * F.col("size") + last).cast("long").alias("taken"), "source", "starts",
                       "key", turns.alias("turns"), last.alias("last"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: each as often as its source's epochs take it.  The
    document on which the last budget ends comes whole if at least half of it is within.  Documents without a word
    are in no mix; rows alike in id, size and source come equally often.

    A source's last epoch takes what stands up to one document, so a row a source says how often each document comes,
    and texts stay where they are."""
    rank, ends, time, own = (fresh(docs, n) for n in ("mix_rank", "mix_ends", "mix_time", "mix_source"))
    of = placed(docs, weights, share, epochs).where("size > 0")
    ends_of = of.groupBy(F.col("source").alias(own)).agg(
        F.struct(F.max("turns").alias("turns"), F.max(F.when(2 * F.col("last") >= F.col("size"), F.struct("key", "doc_id", "size"))).alias("end")).alias(ends))
    ends_of = cut_lineage(ends_of)  # a row a source, counted here and joined below
    if ends_of.count() <= SOURCES:
        ends_of = F.broadcast(ends_of)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    out = docs.withColumn(rank, F.struct(order_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", size.alias("size")))
    out = out.where(F.col(f"{rank}.size") > 0).join(ends_of, F.col("source").eqNullSafe(F.col(own)))
    times = F.col(f"{ends}.turns") + F.coalesce(F.col(rank) <= F.col(f"{ends}.end"), F.lit(False)).cast("long")
    out = out.where(times > 0).withColumn(time, F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same by SQL, over a view ``documents``.
SQL = r"""
with s as (select doc_id, source, md5(coalesce(cast(doc_id as varchar), text, '')) as h,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
b as (select source, sum(size)::bigint as source_size, count(*) as n_docs,
    [5.0::double, 2.0::double, 1.0::double][1 + (row_number() over (order by source asc nulls last) - 1) % 3] as weight from s group by source),
c as (select *, (2 * source_size)::double as cap from b),
l as (select *, (sum(source_size) over () * 1.5::double
        - coalesce(sum(cap) over (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (order by cap / weight, source asc nulls last rows between current row and unbounded following) as level from c),
f as (select *, first_value(case when level * weight <= cap then level end ignore nulls)
        over (order by cap / weight, source asc nulls last rows between unbounded preceding and unbounded following) as lv from l),
t as (select source, source_size, round(least(cap, coalesce(lv * weight, cap)), 6) as target from f),
r as (select doc_id, size, source_size, target, s.source,
    coalesce(sum(size) over (partition by s.source order by substr(h, 1, 13), doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as starts
  from s join t on s.source is not distinct from t.source),
x as (select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as turns from r)
select doc_id, size, source_size, target,
  (turns * size + greatest(0, least(size, floor(target)::bigint - turns * source_size - starts)))::bigint as taken,
  source, starts::bigint as starts from x
"""
