"""The reuse guard: a block may be reused only under the same model, tokenizer, adapter and tenant."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cachefold.functions.frames import first_by
from cachefold.plans.registry import query
from cachefold.sources import tables as S

SCOPE = ["model_id", "tokenizer_id", "adapter_id", "tenant_id"]


def violation(a: str, b: str) -> Column:
    """The first class in which two scopes (columns with prefixes ``a`` and ``b``) differ; null if they match."""
    differs = lambda n: ~F.col(f"{a}{n}").eqNullSafe(F.col(f"{b}{n}"))
    return F.when(differs("model_id"), "cross_model").when(differs("tokenizer_id"), "cross_tokenizer").when(differs("adapter_id"), "cross_adapter").when(differs("tenant_id"), "cross_tenant")


def renamed(df: DataFrame, prefix: str, names: list[str]) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}{c}") if c in names else F.col(c) for c in df.columns))


VIOLATION_SQL = """CASE WHEN {a}.model_id IS DISTINCT FROM {b}.model_id THEN 'cross_model' WHEN {a}.tokenizer_id IS DISTINCT FROM {b}.tokenizer_id THEN 'cross_tokenizer'
  WHEN {a}.adapter_id IS DISTINCT FROM {b}.adapter_id THEN 'cross_adapter' WHEN {a}.tenant_id IS DISTINCT FROM {b}.tenant_id THEN 'cross_tenant' END"""


def scopes_by_content(blocks: DataFrame) -> DataFrame:
    """One row a content hash and scope: how many blocks, and the first of them."""
    return blocks.groupBy("block_hash", *SCOPE).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("reuse_violation_pairs", S.sql("SELECT coalesce(v, 'match') AS violation, CAST(count(*) AS BIGINT) AS n_pairs FROM (SELECT " + VIOLATION_SQL.format(a="x", b="y") + """ AS v
FROM docs x JOIN docs y ON x.block_hash = y.block_hash AND x.doc_id <> y.doc_id) t GROUP BY 1""", "docs"))
def reuse_violation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered pairs of equal content by violation class.

    Pairs that agree in the first classes of a scope are counted from group sizes, n * n a group, from whole scopes up to
    the content alone; the difference between two levels is the pairs that first differ there. No pair is made.
    """
    counts = scopes_by_content(S.docs(spark, sf)).select("block_hash", *SCOPE, "n")
    squares, kinds = [], ["cross_model", "cross_tokenizer", "cross_adapter", "cross_tenant"]
    for depth in range(len(SCOPE), -1, -1):
        counts = counts.groupBy("block_hash", *SCOPE[:depth]).agg(F.sum("n").alias("n"))
        squares.append(counts.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias(f"d{depth}"), F.coalesce(F.sum("n"), F.lit(0)).alias(f"rows{depth}")))
    row = reduce(lambda a, b: a.join(b), squares)  # five rows of one
    told = [F.struct(F.lit("match").alias("violation"), (F.col("d4") - F.col("rows4")).alias("n_pairs"))]
    told += [F.struct(F.lit(kind).alias("violation"), (F.col(f"d{i}") - F.col(f"d{i + 1}")).alias("n_pairs")) for i, kind in enumerate(kinds)]
    return row.select(F.explode(F.array(*told)).alias("x")).select("x.*").where("n_pairs > 0")


def audited(asked: DataFrame, held: DataFrame) -> DataFrame:
    """For each asked block: safe if any holder's scope matches, else the violation of the first holder; absent if none."""
    have = renamed(scopes_by_content(held), "h_", SCOPE)
    rows = asked.select("doc_id", "block_hash", *SCOPE).join(have, "block_hash", "left").withColumn("v", violation("", "h_"))
    seen = F.col("first").isNotNull()
    # The smallest "first" decides, as candidates come in the order of arrival.
    rows = rows.groupBy("doc_id").agg(F.bool_or(seen & F.col("v").isNull()).alias("safe"), F.min(F.when(seen, F.struct("first", "v"))).alias("x"))
    return rows.select("doc_id", F.when(F.col("x").isNull(), "absent").when(F.col("safe"), "safe").otherwise(F.col("x.v")).alias("outcome"))


AUDIT_SQL = "SELECT q.doc_id, CASE WHEN count(h.doc_id) = 0 THEN 'absent' WHEN bool_or(h.doc_id IS NOT NULL AND (" + VIOLATION_SQL.format(a="q", b="h") + ") IS NULL) THEN 'safe' ELSE arg_min(" + VIOLATION_SQL.format(a="q", b="h") + ", h.doc_id) END AS outcome"


def audited_by_others(docs: DataFrame) -> DataFrame:
    """``audited`` for each block against all the others.

    The two smallest ids of a scope tell whether another block than the asking one holds it, and the first that does, so
    a content has two holders a scope at most, and copies never meet one by one.
    """
    few = first_by(docs.select("doc_id", "block_hash", *SCOPE).where("doc_id is not null").distinct(), ["block_hash", *SCOPE], [F.col("doc_id").asc()], "r", 2)
    held = few.groupBy("block_hash").agg(F.array_sort(F.collect_list(F.struct("doc_id", *SCOPE))).alias("held"))
    rows = docs.select("doc_id", "block_hash", *SCOPE).join(held, "block_hash", "left")
    rows = rows.withColumn("held", F.filter("held", lambda h: h["doc_id"] != F.col("doc_id")))
    same = F.exists("held", lambda h: reduce(and_, (h[c].eqNullSafe(F.col(c)) for c in SCOPE)))
    rows = rows.withColumn("safe", same).withColumn("h", F.when(F.size("held") > 0, F.element_at("held", 1)))
    rows = rows.select("doc_id", *SCOPE, "safe", F.col("h.doc_id").alias("first"), *(F.col(f"h.{c}").alias(f"h_{c}") for c in SCOPE))
    return rows.select("doc_id", F.when(F.col("first").isNull(), "absent").when(F.col("safe"), "safe").otherwise(violation("", "h_")).alias("outcome"))


OTHERS_SQL = f"({AUDIT_SQL} FROM docs q LEFT JOIN docs h ON q.block_hash = h.block_hash AND h.doc_id <> q.doc_id GROUP BY q.doc_id)"


def _reuse_audit(name: str):  # noqa: ANN202
    @query(name, S.sql(f"SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM {OTHERS_SQL} t GROUP BY outcome", "docs"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """Every document asks for what the others hold: safe reuses and refusals by class."""
        return audited_by_others(S.docs(spark, sf)).groupBy("outcome").agg(F.count("*").alias("n"))

    return run


def _guarded_get(name: str):  # noqa: ANN202
    @query(name, S.sql(f"SELECT doc_id, CASE outcome WHEN 'safe' THEN 'hit' WHEN 'absent' THEN 'not_found' ELSE 'unsafe_reuse' END AS result FROM {OTHERS_SQL} t", "docs"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """A get by content: the own scope's block, a refusal if only others hold it, or nothing."""
        rows = audited_by_others(S.docs(spark, sf))
        return rows.select("doc_id", F.when(F.col("outcome") == "safe", "hit").when(F.col("outcome") == "absent", "not_found").otherwise("unsafe_reuse").alias("result"))

    return run


# Both names of each are kept: the first ones once asked for even documents only.
reuse_audit, reuse_audit_all = _reuse_audit("reuse_audit"), _reuse_audit("reuse_audit_all")
guarded_get, guarded_get_all = _guarded_get("guarded_get"), _guarded_get("guarded_get_all")
