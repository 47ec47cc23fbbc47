"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

A document's size is its number of words. Sources, by code point with null last, take the weights of
``WEIGHTS`` in turn and share the sum of all sizes; a target stops at ``EPOCHS`` times its source's size,
and the excess goes to the others by weight until none is above (the level is found in closed form from
prefix sums over the sources sorted by cap per weight).

Within a source the documents lie in the order of a hash of id and text. The source's demand grows over training
time t from 0 to 1 as the integral of its schedule, ``target * (1 + drift * (2 t - 1))``; inverting it at a
document's place gives its training position, once for each pass over the source. Copies are then
range-sorted by position. The last document that a source needs is taken in part, so taken words equal
the target rounded to whole words.

A source may hold any share of the rows, and so may an id: places are prefix sums in two levels, over buckets of the
hash within a source and over rows within a bucket, and every shuffle is by source and bucket or by position.
Sizes are counted once, on ids and sizes alone, for the sums over buckets; ``curriculum`` then moves texts
twice, to their bucket and to their range of positions. The bounds of these ranges follow from the demand of all
sources, which is a polynomial of t, so no rows are sampled for them. Rows that agree in both id and text share a bucket: where
a bucket has over ``CROWD`` rows, those of the keys that crowd it are dealt to parts by a checksum of the other columns, equal rows become one
with a count, and each takes its place by that. Only the table of sources, a row
each, is brought into one task (10 million sources are some 0.5 GB there, sorted with spilling).

Null texts have size 0, and so do empty ones; they are never taken, and a source without words has target
0. Rows that share id and text are dealt in the order of a hash of their other columns; repeated rows count
each. Very long texts are counted and cut whole. An empty table gives an empty result. Further columns are ignored
by ``mixture`` and kept by ``curriculum``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlab.llm.common import SPACES, WORD, durable

WEIGHTS = (5, 2, 1)
DRIFTS = (-0.5, 0.0, 0.5)
EPOCHS = 3
#: Rows of a bucket of the hash within the largest source, about; words of a partition of ``curriculum``, about.
BUCKET, PART_WORDS = 256, 1 << 22
#: Rows of a bucket beyond which it is looked into for keys of more than half as many rows.
CROWD = 1 << 14


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, drifts: tuple[float, ...] = DRIFTS, epochs: int = EPOCHS) -> DataFrame:
    """``totals`` (source_key, source, source_size, ...), a row per source, with target, goal and drift."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    t = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn)).withColumn("drift", F.element_at(F.array(*map(F.lit, drifts)), turn))
    t = t.withColumn("cap", F.col("source_size") * epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    # Differences of running sums: a window to the end of the partition would go through it again for each row.
    left = lambda c, given: F.sum(c).over(everything) - F.coalesce(F.sum(given).over(before), F.lit(0))
    level = left("source_size", "cap") / left("weight", "weight")
    t = t.withColumn("level", level)
    # The first source that does not reach its cap sets the level for all after it.
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    t = t.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.lit(0.0)))
    return t.withColumn("goal", F.round("target").cast("long")).select("source_key", "source_size", "target", "goal", "drift")


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` as one column ``doc``, with source_key, size and key, the hash that orders a source."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    field = F.col("doc").getField
    text = F.coalesce(field(text_col), F.lit(""))
    key = F.md5(F.concat_ws(":", F.coalesce(field(id_col).cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
    source_key = F.coalesce(F.concat(F.lit("s"), field(source_col).cast("string")), F.lit("n"))
    # With the key, a checksum of all columns but the text tells rows apart.
    other = [field(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col]
    rest = F.to_json(F.struct(*other, field(text_col).isNull().alias("none")), {"ignoreNullFields": "false"})
    rest = F.substring(F.sha2(rest, 256), 1, 32)
    return rows.select("doc", source_key.alias("source_key"), words(field(text_col)).alias("size"), key.alias("key"), rest.alias("rest"))


@dataclass(frozen=True)
class _Sums:
    """``bits``: of the hash that name a bucket; ``crowds``: the crowding keys of each bucket that has any, if there are any;
    ``offsets``: per source and part of a bucket, the words before it and the source's target."""

    bits: int
    offsets: DataFrame
    crowds: DataFrame | None = None

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` with bucket, and where keys crowd also segment (odd: one of them) and part within the bucket."""
        # The leading bits of the hash, so that buckets follow its order.
        leading = lambda c: F.shiftright(F.conv(F.substring(c, 1, 8), 16, 10).cast("long"), 32 - self.bits)
        rows = rows.withColumn("bucket", leading("key"))
        if self.crowds is None:
            return rows
        rows = rows.join(self.crowds, ["source_key", "bucket"], "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
        crowds = F.array_contains("keys", F.col("key"))
        rows = rows.withColumn("segment", 2 * F.size(F.filter("keys", lambda k: k < F.col("key"))) + crowds.cast("int"))
        return rows.withColumn("part", F.when(crowds, leading("rest")).otherwise(0)).drop("keys")

    @property
    def keys(self) -> list[str]:
        return ["source_key", "bucket", *(["segment", "part"] if self.crowds is not None else [])]


def _sums(slim: DataFrame, epochs: int) -> _Sums:
    totals = durable(slim.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).withColumn("source", F.when(F.col("source_key") != "n", F.substring("source_key", 2, 1 << 30))))
    most = totals.agg(F.max("n")).first()[0] or 0
    sums = _Sums(min(32, max(0, (most - 1) // BUCKET).bit_length()), totals)
    own = durable(sums.dealt(slim).groupBy(*sums.keys).agg(F.sum("size").alias("own"), F.count("*").alias("n")))
    full = own.where(F.col("n") > CROWD).select("source_key", "bucket")
    if not full.isEmpty():
        each = sums.dealt(slim).join(full, ["source_key", "bucket"], "left_semi").groupBy("source_key", "bucket", "key").count().where(F.col("count") > CROWD // 2)
        sums = replace(sums, crowds=durable(each.groupBy("source_key", "bucket").agg(F.sort_array(F.collect_list("key")).alias("keys"))))
        own = sums.dealt(slim).groupBy(*sums.keys).agg(F.sum("size").alias("own"))
    earlier = W.partitionBy("source_key").orderBy(*sums.keys[1:]).rowsBetween(W.unboundedPreceding, -1)
    offsets = own.withColumn("base", F.coalesce(F.sum("own").over(earlier), F.lit(0))).join(targets(totals, epochs=epochs), "source_key")
    return replace(sums, offsets=durable(offsets.drop("own", "n")))


def _tie(rows: DataFrame) -> Column:
    """A hash of all columns of ``doc``, and of which are null; maps, which have no hash, by their JSON."""
    parts = []
    for f in rows.schema["doc"].dataType.fields:
        value = F.col("doc").getField(f.name)
        parts += [F.to_json(F.struct(value.alias("v"))) if "map<" in f.dataType.simpleString() else value, value.isNull()]
    return F.xxhash64(*parts)


def _placed(rows: DataFrame, sums: _Sums, id_col: str) -> DataFrame:
    """``rows`` with source_size, target, goal, drift and the place before each."""
    rows = sums.dealt(rows)
    inside = W.partitionBy(*sums.keys)
    light = rows if sums.crowds is None else rows.where(F.col("segment") % 2 == 0)
    up_to = inside.orderBy("key", F.col("doc").getField(id_col), "tie").rowsBetween(W.unboundedPreceding, 0)
    made = light.withColumn("tie", _tie(light)).withColumn("place", F.sum("size").over(up_to) - F.col("size")).drop("tie")
    if sums.crowds is not None:
        # Of crowding keys equal rows become one with a count; they have one size.
        heavy = rows.where(F.col("segment") % 2 == 1).groupBy(*sums.keys, "key", "rest").agg(F.first("doc").alias("doc"), F.first("size").alias("size"), F.count("*").alias("n"))
        up_to = inside.orderBy("rest").rowsBetween(W.unboundedPreceding, 0)
        heavy = heavy.withColumn("first", F.sum(F.col("size") * F.col("n")).over(up_to) - F.col("size") * F.col("n"))
        heavy = heavy.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("place", F.col("first") + F.col("turn") * F.col("size"))
        made = made.unionByName(heavy.select(*made.columns))
    made = made.drop("rest").join(sums.offsets, sums.keys)
    return made.withColumn("place", F.col("place") + F.col("base"))


def _taken(copy: Column | int) -> Column:
    """Words that pass number ``copy`` over the source takes of a document."""
    left = F.col("goal") - F.col("source_size") * copy - F.col("place")
    return F.greatest(F.lit(0), F.least(left, F.col("size")))


def _position(copy: Column | int) -> Column:
    """Training time at which the source's demand reaches the document's place."""
    u = (F.col("source_size") * copy + F.col("place")) / F.nullif("goal", F.lit(0))
    a = F.col("drift")
    root = F.sqrt(F.greatest((1 - a) * (1 - a) + 4 * a * u, F.lit(0.0)))
    return F.when(a == 0, u).otherwise((root - (1 - a)) / (2 * F.when(a != 0, a)))


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", epochs: int = EPOCHS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and position, its first place in training in parts of 10**9 (null if not taken)."""
    # Only the id and what is computed from the text are kept and moved.
    rows = _keyed(docs.select(id_col, source_col, text_col), id_col, source_col, text_col)
    rows = durable(rows.withColumn("doc", F.struct(F.col("doc").getField(id_col).alias(id_col))))
    rows = _placed(rows, _sums(rows, epochs), id_col)
    taken = sum((_taken(k) for k in range(1, epochs)), _taken(0))
    rows = rows.withColumn("taken", taken).withColumn("position", F.when(F.col("taken") > 0, F.floor(_position(0) * 1e9)))
    out = rows.select(F.col("doc").getField(id_col).alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken", "position")
    # Rows that are not taken follow in the order of a hash, as a range of one value would be one partition.
    out = out.withColumn("at", F.coalesce("position", 10**9 + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))))
    return out.repartitionByRange("at", "doc_id").sortWithinPartitions("at", "doc_id").drop("at")


def curriculum(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", length_col: str | None = None, epochs: int = EPOCHS) -> DataFrame:
    """``docs`` as they are trained on, in partitions of ascending training time: a row per pass that takes words of a document.

    Of a document taken in part, the text holds the words taken. ``length_col``: a column that holds the
    texts' numbers of characters, to be kept right.
    """
    rows = _keyed(docs, id_col, source_col, text_col)
    sums = _sums(durable(rows.drop("doc")), epochs)
    sources = sums.offsets.select("source_key", "goal", "drift").distinct()
    demand, bend = (x or 0 for x in sources.agg(F.sum("goal"), F.sum(F.col("goal") * F.col("drift"))).first())
    rows = _placed(rows, sums, id_col)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("taken", _taken(F.col("copy"))).where("taken > 0")
    text = F.col("doc").getField(text_col)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(SPACES + WORD), F.lit(0)), F.lit(1), F.col("taken").cast("int")), "")
    read = F.when(F.col("taken") < F.col("size"), cut).otherwise(text).cast(docs.schema[text_col].dataType)
    rows = rows.withColumn("at", _position(F.col("copy"))).select("at", F.col("doc").getField(id_col).alias("id"), "doc", read.alias("read"))
    # The share of all demand that is met by then, in equal parts.
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-demand // PART_WORDS))
    met = (F.col("at") * demand + (F.col("at") * F.col("at") - F.col("at")) * float(bend)) / max(1, demand)
    part = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(met * parts))).cast("int")
    rows = rows.repartitionById(parts, part).sortWithinPartitions("at", "id")
    own = {text_col: F.col("read")}
    if length_col is not None:
        own[length_col] = F.char_length("read").cast(docs.schema[length_col].dataType)
    return rows.select(*[own.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


#: ``mixture`` over the table documents.
SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
  md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as key from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight, [-0.5::double, 0::double, 0.5::double][1 + (row_number() over (order by source nulls last) - 1) % 3] as drift from s),
r as (select *, 3 * source_size as cap, 3 * source_size / weight as ratio from w),
l as (select *, ((select sum(source_size) from s) - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level from r),
t as (select source, source_size, drift, coalesce(least(cap::double, (select max(level) from l where level <= ratio) * weight), 0) as target from l),
p as (select d.doc_id, d.size, t.source_size, t.target, t.drift, cast(round(t.target) as bigint) as goal,
  cast(sum(d.size) over (partition by d.source order by d.key, d.doc_id rows unbounded preceding) - d.size as bigint) as place from d join t on d.source is not distinct from t.source),
k as (select *, greatest(0, least(goal - place, size)) + greatest(0, least(goal - source_size - place, size)) + greatest(0, least(goal - 2 * source_size - place, size)) as taken from p)
select doc_id, cast(size as bigint) as size, source_size, round(target, 6) as target, cast(taken as bigint) as taken,
  case when taken > 0 then cast(floor(1e9::double * case when drift = 0 then place / goal
    else (sqrt(greatest((1 - drift) * (1 - drift) + 4 * drift * (place / goal), 0::double)) - (1 - drift)) / (2 * drift) end) as bigint) end as position
from k
"""
