"""A choice of tables that covers the concepts which a question needs of each of its buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.sources.shared import new_folder

#: Tables of a question; what a bucket that is met at all weighs; choices of a bucket that are weighed within one row.
MOST, BUCKET_WEIGHT, MANY = 18, 4, 256
_GROUP = ["question_id", "bucket"]
_CHOICE = "struct<ratio:double,cost:bigint,table_id:bigint,gain:bigint,cells:array<struct<concept:string,weight:bigint>>>"


def registered(declared: DataFrame, claims: DataFrame) -> DataFrame:
    """(question_id, bucket, table_id, concept): what tables claim to cover, under the names that count; each once.

    A concept belongs to the bucket that declares it (of several the first by name). One that none declares and that begins with
    the name of a bucket which claims it is registered for that bucket, by its first claim. What is claimed for another bucket
    than its own is that bucket's concept of the same suffix: its name, "_", and what follows the first "_".
    declared: question_id, bucket, concept; claims: question_id, bucket, table_id, position, concept. Claims with a null are left out.
    """
    own = declared.dropna(subset=["question_id", "bucket", "concept"]).groupBy("question_id", "concept").agg(F.min("bucket").alias("declarer"))
    named = claims.dropna(subset=["question_id", "bucket", "table_id", "concept"]).select("question_id", "bucket", "table_id", "position", "concept")
    begins = named.where(F.startswith("concept", "bucket")).groupBy("question_id", "concept").agg(F.min_by("bucket", F.struct("position", "table_id")).alias("claimer"))
    keys = ["question_id", "concept"]
    owner = F.coalesce("declarer", "claimer", F.lit(""))
    suffix = F.regexp_replace("concept", r"(?s)^[^_]*_", "")
    name = F.when(owner == F.col("bucket"), F.col("concept")).otherwise(F.concat("bucket", F.lit("_"), suffix))
    return named.join(own, keys, "left").join(begins, keys, "left").select("question_id", "bucket", "table_id", name.alias("concept")).distinct()


def _gain(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0).cast("long"), lambda n, c: n + c["weight"])


def _steps(choices: Column, most: int) -> Column:
    """What is chosen of a bucket, best first: each step takes what adds most for its cost and cuts what it covers from the others."""
    none = F.array().cast(f"array<{_CHOICE}>")

    def weighed(rest: Column, taken: Column) -> Column:
        left = F.transform(rest, lambda x: x.withField("cells", F.filter(x["cells"], lambda c: ~F.exists(taken, lambda t: t["concept"] == c["concept"]))))
        scored = F.transform(F.filter(left, lambda x: F.size(x["cells"]) > 0), lambda x: F.struct((-_gain(x["cells"]) / x["cost"]).alias("ratio"), x["cost"].alias("cost"), x["table_id"].alias("table_id"), _gain(x["cells"]).alias("gain"), x["cells"].alias("cells")))
        return F.array_sort(scored)

    def step(state: Column, _: Column) -> Column:
        best = F.slice(state["rest"], 1, 1)
        return F.struct(F.concat(state["chosen"], best).alias("chosen"), F.when(F.size(best) == 0, none).otherwise(weighed(state["rest"], F.get(best, F.lit(0))["cells"])).alias("rest"))

    nothing = F.array().cast("array<struct<concept:string,weight:bigint>>")
    start = F.struct(none.alias("chosen"), weighed(choices, nothing).alias("rest"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["chosen"])


def _rounds(cells: DataFrame, most: int) -> DataFrame:
    """The same steps as joins over (question_id, bucket, table_id, cost, concept, weight), a table written each round: for buckets of any size."""
    spark, folder = cells.sparkSession, new_folder(cells.sparkSession, "cover")
    left, n = cells, 0
    while n < most:
        added = left.groupBy(*_GROUP, "table_id", "cost").agg(F.sum("weight").alias("gain"))
        best = added.groupBy(*_GROUP).agg(F.min(F.struct((-F.col("gain") / F.col("cost")).alias("ratio"), "cost", "table_id", "gain")).alias("best")).select(*_GROUP, "best.*")
        best.write.parquet(f"{folder}/best/round={n}")
        best = spark.read.parquet(f"{folder}/best/round={n}")
        if best.isEmpty():
            break
        taken = left.join(best.select(*_GROUP, "table_id"), [*_GROUP, "table_id"], "left_semi").select(*_GROUP, "concept").distinct()
        left.join(taken, [*_GROUP, "concept"], "left_anti").write.parquet(f"{folder}/left/{n}")
        left, n = spark.read.parquet(f"{folder}/left/{n}"), n + 1
    return spark.read.parquet(f"{folder}/best").drop("round")


def covering(offers: DataFrame, most: int = MOST, bucket_weight: int = BUCKET_WEIGHT, many: int = MANY) -> DataFrame:
    """(question_id, place, table_id, bucket, gain, ratio): at most so many tables of each question, by greedy weighted set cover.

    offers: question_id, bucket, table_id, concept, weight, cost (of the table, above 0); other columns don't matter. Rows with a null or an
    empty concept are left out, repeated cells count once with their greatest weight, a table with several costs has its least. That a bucket has a table at
    all weighs bucket_weight. Each step takes the table that adds most weight for its cost; ties by cost, then id; it ends when nothing is added.

    A table covers cells of its own bucket only, so what it adds hangs on its bucket alone and falls from step to step: the steps of
    the buckets, each found by itself, are put in order by what they add, and that is the order of steps over all of them. Of tables of a bucket that
    cover the same cells the cheapest stays. A bucket with more than `many` such choices goes by joins, others within a row; both give the same rows.
    """
    spark = offers.sparkSession
    known = offers.dropna(subset=[*_GROUP, "table_id", "concept", "weight", "cost"]).where("cost > 0 and weight > 0 and concept <> ''")
    one = known.groupBy(*_GROUP, "table_id", "concept").agg(F.max("weight").cast("long").alias("weight"), F.min("cost").cast("long").alias("cost"))
    met = F.array(F.struct(F.lit("").alias("concept"), F.lit(bucket_weight).cast("long").alias("weight")))
    tables = one.groupBy(*_GROUP, "table_id").agg(F.min("cost").alias("cost"), F.concat(met, F.array_sort(F.collect_list(F.struct("concept", "weight")))).alias("cells"))
    alike = tables.groupBy(*_GROUP, "cells").agg(F.min(F.struct("cost", "table_id")).alias("t")).select(*_GROUP, "t.table_id", "t.cost", "cells")
    path = new_folder(spark, "choices")
    alike.write.parquet(path)
    choices = spark.read.parquet(path)
    large = choices.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many).select(*_GROUP)
    # the rest of a bucket is gathered only where it is known to be small
    each = choices.join(large, _GROUP, "left_anti").groupBy(*_GROUP).agg(F.collect_list(F.struct("table_id", "cost", "cells")).alias("choices"))
    steps = each.select(*_GROUP, F.explode(_steps(F.col("choices"), most)).alias("s")).select(*_GROUP, "s.ratio", "s.cost", "s.table_id", "s.gain")
    if not large.isEmpty():
        rows = choices.join(large, _GROUP, "left_semi").select(*_GROUP, "table_id", "cost", F.explode("cells").alias("c")).select(*_GROUP, "table_id", "cost", "c.concept", "c.weight")
        steps = steps.unionByName(_rounds(rows, most))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("ratio", "cost", "table_id", "bucket"))
    return steps.withColumn("place", place).where(F.col("place") <= most).select("question_id", "place", "table_id", "bucket", "gain", (-F.col("ratio")).alias("ratio"))


def audited(declared: DataFrame, offers: DataFrame, chosen: DataFrame) -> DataFrame:
    """(question_id, n_cells, n_covered, uncovered, unmet, status): what a choice leaves open, for each question with a declared concept or an offer.

    declared: question_id, bucket, concept; offers: question_id, bucket, table_id, concept; chosen: question_id, bucket, table_id. uncovered:
    bucket:concept, sorted, by commas; unmet: buckets with a declared concept and no chosen table. Status: "ok", "bucket" or "concept".
    """
    keys = [*_GROUP, "concept"]
    needed = declared.select(*keys).withColumn("must", F.lit(True)).unionByName(offers.select(*keys).withColumn("must", F.lit(False))).dropna(subset=keys)
    needed = needed.groupBy(*keys).agg(F.max("must").alias("must"))
    held = offers.join(chosen.select(*_GROUP, "table_id"), [*_GROUP, "table_id"], "left_semi").select(*keys).distinct().withColumn("covered", F.lit(True))
    buckets = chosen.select(*_GROUP).distinct().withColumn("met", F.lit(True))
    rows = needed.join(held, keys, "left").join(buckets, _GROUP, "left")
    lacking = lambda open_, name: F.concat_ws(",", F.array_sort(F.collect_set(F.when(open_, name))))
    out = rows.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count("covered").alias("n_covered"),
        lacking(F.col("covered").isNull(), F.concat("bucket", F.lit(":"), "concept")).alias("uncovered"),
        lacking(F.col("met").isNull() & F.col("must"), F.col("bucket")).alias("unmet"),
    )
    return out.withColumn("status", F.when(F.col("unmet") != "", "bucket").when(F.col("uncovered") != "", "concept").otherwise("ok"))
