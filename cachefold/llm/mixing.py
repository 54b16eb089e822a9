"""Mixing sources to target weights by pivotal dependent rounding; DataFrame operations only.

Sources share all words by weight; a target stops at ``MOST`` times its source's size and the excess is reshared (closed
form: with sources in the order of cap / weight, the water level is the largest of the levels that hold if all sources
before were capped). Every document of a source gets the same expected number of copies, target / source size. Its whole
part is taken as is. The fractional parts are rounded in pairs: words are moved at random from one document's fraction
to the other's until one of them is integral, so a source's expected words never change. Groups of about ``GROUP``
documents are folded this way, the one fractional document left of each group goes up to the next level of the
reduction tree, and only the last one of a source is rounded alone: the words taken miss a target by less than the size
of one document. All draws come from md5 of ids, so reruns agree.

Rows equal in source, doc_id, size and text are a class of n documents: their fractions add up to a whole number of
further copies, which go to as many of the rows, and to one fractional document for the rounding. Positions among all
sources (for weights and for the water level) come from ranges, so no task holds all sources.

Defined cases: a null text has size 0; documents of size 0 take 0 words (their copies are whole parts only); a null source is a
source of its own, last in order; a null doc_id draws as an empty id. Very long texts are only counted and hashed.
Without words all targets are 0. Extra columns are ignored by :func:`mix` and kept, whatever their names, by
:func:`mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
GROUP = 64
WORD = r"[^\x20\x09-\x0D]+"
RUN = 4096  # equal rows written from one array
CLASS = ["source", "doc_id", "size", "text_hash"]


def words(text: str = "text") -> Column:
    """The number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of the named columns."""
    on = F.lit(True)
    for n in names:
        on = on & left[n].eqNullSafe(right[n])
    return on


def with_running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with columns that hold the sums over all rows before, in ``order``.

    Rows are dealt into ranges of the order; sums run inside ranges, and the sums of whole ranges are added.
    """
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")  # range bounds are drawn anew by each run of the plan
    whole = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a shuffle partition
    whole = whole.select("_range", *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(whole), "_range")
    return out.select(*rows.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, s, source_size, target, ratio, documents) from (source, size): one row a source; ``s`` numbers them."""
    sizes = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("documents"))
    ranked = with_running(sizes, [F.col("source").asc_nulls_last()], {"s": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("s") % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    order = [(F.col("cap") / F.col("weight")).asc(), F.col("s").asc()]
    leveled = materialize(with_running(ranked, order, {"caps": F.col("cap"), "weights": F.col("weight")}), "levels")
    total = leveled.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    levels = leveled.join(F.broadcast(total)).select(((F.col("all_size") - F.col("caps")) / (F.col("all_weight") - F.col("weights"))).alias("level"))
    level = levels.agg(F.max("level").alias("level"))
    out = leveled.join(F.broadcast(level)).withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return out.select("source", "s", "source_size", "target", F.least(ratio, F.lit(float(MOST))).alias("ratio"), "documents")


def _draw(level: int, what: str, *on: Column) -> Column:
    """A uniform number in [0, 1) from 52 bits of md5."""
    text = F.concat_ws(":", F.lit(f"{what}{level}"), *(F.coalesce(c.cast("string"), F.lit("")) for c in on))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _fold(level: int) -> Column:
    """Round the fractions of an array of items (u, doc_id, text_hash, size, p) one after the other.

    The state is the one fractional item, and the items decided so far with ``up`` 0 or 1.
    """
    item = "struct<u:double,doc_id:bigint,text_hash:bigint,size:bigint,p:double>"
    done = "array<struct<doc_id:bigint,text_hash:bigint,size:bigint,up:int>>"
    start = F.struct(F.lit(None).cast(item).alias("open"), F.array().cast(done).alias("done"))
    name = lambda x: [x[c].alias(c) for c in ("doc_id", "text_hash", "size")]

    def decided(x: Column, up: Column) -> Column:
        return F.struct(*name(x), up.cast("int").alias("up"))

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x["u"].alias("u"), *name(x), p.alias("p"))

    def step(state: Column, x: Column) -> Column:
        o, done_so_far = state["open"], state["done"]
        gain_x, gain_o = x["size"] * (1.0 - x["p"]), o["size"] * (1.0 - o["p"])
        lose_x, lose_o = x["size"] * x["p"], o["size"] * o["p"]
        up, down = F.least(gain_x, lose_o), F.least(lose_x, gain_o)  # words that x may gain, or lose
        rises = x["u"] * (up + down) < down
        # Whichever meets its bound first becomes integral; the other one stays open.
        x_first = F.when(rises, gain_x <= lose_o).otherwise(lose_x <= gain_o)
        x_up = F.when(rises, F.lit(1)).otherwise(F.lit(0))
        o_left = F.when(rises, o["p"] - up / o["size"]).otherwise(o["p"] + down / o["size"])
        x_left = F.when(rises, x["p"] + up / x["size"]).otherwise(x["p"] - down / x["size"])
        inside = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        closed = F.when(x_first, decided(x, x_up)).otherwise(decided(o, 1 - x_up))
        still = F.when(x_first, with_p(o, inside(o_left))).otherwise(with_p(x, inside(x_left)))
        first = F.struct(with_p(x, x["p"]).alias("open"), done_so_far.alias("done"))
        return F.when(o.isNull(), first).otherwise(F.struct(still.alias("open"), F.array_append(done_so_far, closed).alias("done")))

    return F.aggregate(F.array_sort("items"), start, step)


def class_copies(sized: DataFrame) -> DataFrame:
    """(CLASS, n, source_size, target, each, more): a class has n rows, ``more`` of which get ``each`` + 1 copies, the others ``each``.

    sized: (doc_id, source, size, text_hash), a row a document.
    """
    sized = materialize(sized.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("size").cast("long").alias("size"), "text_hash"), "sized")
    targets = materialize(source_targets(sized), "targets")
    alike = sized.groupBy(*CLASS).agg(F.count("*").alias("n"))
    alike = alike.join(targets, alike["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    fraction = F.when(F.col("size") > 0, F.col("n") * (F.col("ratio") - F.floor("ratio"))).otherwise(0.0)
    alike = alike.withColumn("each", F.floor("ratio").cast("int")).withColumn("q", fraction)
    # The whole part of n fractions goes to as many rows at once.
    alike = materialize(alike.withColumn("whole", F.floor("q")).withColumn("p", F.col("q") - F.col("whole")), "alike")

    # Groups of GROUP documents by hash, then groups of GROUP groups' leftovers, until a source has one group.
    at = alike.where("p > 0").select("s", F.ceil(F.col("documents") / GROUP).alias("groups"), "doc_id", "text_hash", "size", "p")
    left = targets.agg(F.ceil(F.max("documents") / GROUP)).first()[0] or 0
    told = [F.col(c) for c in ("doc_id", "text_hash", "size")]
    found, level = [], 0
    while left:
        place = F.floor(_draw(level, "group", *told) * F.col("groups")).cast("long")
        item = F.struct(_draw(level, "pair", *told).alias("u"), *told, "p")
        folded = at.groupBy("s", place.alias("g"), "groups").agg(F.collect_list(item).alias("items")).select("s", "groups", _fold(level).alias("x"))
        folded = materialize(folded, "folded")
        found.append(folded.select("s", F.explode("x.done").alias("d")).select("s", "d.*"))
        at = folded.where("x.open is not null").select("s", F.ceil(F.col("groups") / GROUP).alias("groups"), *(f"x.open.{c}" for c in ("doc_id", "text_hash", "size", "p")))
        level += 1
        if left == 1:
            last = (_draw(level, "last", *told) < F.col("p")).cast("int")
            found.append(at.select("s", *told, last.alias("up")))
            break
        left = -(-left // GROUP)
    kept = [*CLASS, "n", "source_size", "target", "each"]
    if not found:
        return alike.select(*kept, "whole").withColumnRenamed("whole", "more")
    rounded = found[0]
    for f in found[1:]:
        rounded = rounded.unionByName(f)
    risen = rounded.where("up = 1").drop("up").withColumn("up", F.lit(1))
    key = ["s", "doc_id", "text_hash", "size"]
    out = alike.join(risen, same(alike, risen, key), "left").select(*(alike[c] for c in kept), (alike["whole"] + F.coalesce(risen["up"], F.lit(0))).alias("more"))
    return out


def mix_sized(sized: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) from (doc_id, source, size, text_hash), a row for each row."""
    out = class_copies(sized)
    # A large class is written in runs, so that no array holds all its rows.
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long")))
    out = out.withColumn("first", first)
    out = out.withColumn("row", F.explode(F.sequence(F.col("first"), F.least(F.col("n"), F.col("first") + RUN) - 1)))
    out = out.withColumn("copies", F.col("each") + F.when(F.col("row") < F.col("more"), 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def _sized(docs: DataFrame) -> list[Column]:
    """The columns that the mix needs of a document."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), words().alias("size"), F.xxhash64("text").alias("text_hash")]


def mix(docs: DataFrame) -> DataFrame:
    """The contract's columns and more for all rows of ``docs`` (doc_id, text, source, ...)."""
    return mix_sized(docs.select(*_sized(docs)))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them, with all their columns.

    Where some rows of a class get a copy more than others, rows are numbered inside their task, and the tasks' counts are
    added, so a class that holds many rows is not gathered. Which of several rows that are equal in id, source and text
    gets the copy follows the layout of the files.
    """
    key = ["source", "doc_id", "text_hash"]  # equal texts have equal sizes
    sized = docs.select(*_sized(docs))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c for c, name in zip(_sized(docs), sized.columns, strict=True) if name in key))
    plan = class_copies(sized).withColumns({"fixed": F.col("each"), "some": (F.col("more") > 0) & (F.col("more") < F.col("n"))})
    plan = plan.withColumn("fixed", F.col("each") + F.when(F.col("more") == F.col("n"), 1).otherwise(0)).where("fixed > 0 or some")
    plan = materialize(plan.dropDuplicates(key).select(*(F.col(c).alias(f"c_{c}") for c in key), "fixed", "some", "more"), "copies")
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    # The fixed rows have one copy number a class; only the others are numbered.
    # Texts are dealt by key at any size, as the list of copies grows with them.
    taken = rows.join(plan.where("not some").hint("merge"), on).select("row", F.col("fixed").alias("copies"))
    uneven = plan.where("some")
    if not uneven.isEmpty():
        part = materialize(rows.join(uneven, on).select("row", *key, "fixed", "more", F.spark_partition_id().alias("task")), "uneven")
        tasks = part.groupBy(*key, "task").agg(F.count("*").alias("here"))
        before = F.coalesce(F.sum("here").over(Window.partitionBy(*key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        tasks = tasks.select(*key, "task", before.alias("before"))
        number = F.row_number().over(Window.partitionBy(*key, "task").orderBy(F.lit(0))) - 1
        part = part.withColumn("number", number)
        part = part.join(tasks, same(part, tasks, [*key, "task"])).select("row", F.col("fixed") + F.when(F.col("before") + F.col("number") < F.col("more"), 1).otherwise(0))
        taken = taken.union(part)
    return taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
