"""Resource inventory: buckets, matrices, listings and deletion order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakesight.functions import resources as rules

GLOBAL = "(global)"


def classify(resources: DataFrame, naming: rules.Naming, classic_track: bool = False) -> DataFrame:
    """Each resource with its bucket, project category and note; the first matching bucket wins.

    The steps are separate columns, so that no rule is evaluated twice.
    """
    kind, name, region = F.col("resource_type"), F.col("name"), F.col("_region")
    judged = (
        resources.withColumn("_region", F.coalesce("region", F.lit("")))
        .withColumn("orphan_type", rules.orphan_kind(kind, F.col("lb_type")))
        .withColumn(
            "_verdict",
            rules.orphan_verdict(
                naming, F.col("orphan_type"), name, region, F.col("lb_type"), F.col("tags"), classic_track
            ),
        )
        .withColumn(
            "bucket",
            F.when(F.col("_verdict").isNotNull(), F.col("_verdict.level"))
            .when(rules.is_builtin(F.col("display")), "builtin")
            .when(rules.is_project(naming, kind, name, region), "project")
            .otherwise("other"),
        )
    )
    category = F.when(F.col("bucket") == "project", rules.project_category(naming, kind, name, region))
    return judged.select(
        *resources.columns, "bucket", category.alias("category"), F.col("_verdict.note").alias("orphan_note"),
        "orphan_type",
    )


def orphans(classified: DataFrame) -> DataFrame:
    """Definite leftovers and likely ones, in one table."""
    columns = ["seq", "resource_type", "name", "region", "display", "orphan_note", "level", "extra"]
    # What else is known of a resource; empty values are left out.
    extra = F.map_filter(F.create_map(F.lit("lb_type"), F.col("lb_type")), lambda _, v: F.coalesce(v, F.lit("")) != "")

    def level(bucket: str) -> DataFrame:
        return classified.where(F.col("bucket") == bucket).select(
            "seq", F.col("orphan_type").alias("resource_type"), "name",
            F.nullif(F.col("region"), F.lit("")).alias("region"), "display", "orphan_note",
            F.lit(bucket).alias("level"), extra.alias("extra"),
        )

    return level("definitely").unionByName(level("likely")).select(*columns)


def category_matrix(classified: DataFrame) -> DataFrame:
    """Project resources per region and category, zeros kept; no region counts as global."""
    region = F.when(F.coalesce(F.col("region"), F.lit("")) == "", GLOBAL).otherwise(F.col("region"))
    project = F.col("bucket") == "project"
    return classified.groupBy(region.alias("region")).agg(
        *[F.count_if(project & (F.col("category") == c)).alias(c) for c in rules.CATEGORIES]
    )


def bucket_tallies(classified: DataFrame) -> DataFrame:
    """How many resources fell into each bucket, in one row."""
    return classified.agg(
        *[
            F.count_if(F.col("bucket") == b).alias(b)
            for b in ("definitely", "likely", "project", "other", "builtin")
        ]
    )


def recovery_hints(found: DataFrame) -> DataFrame:
    """The resource types present and how to look each up again."""
    kinds = found.where(F.coalesce("resource_type", F.lit("")) != "").select("resource_type").distinct()
    return kinds.withColumn("hint", rules.recovery_hint(F.col("resource_type")))


def first_listed(items: DataFrame, column: str, n: int) -> DataFrame:
    """The first ``n`` distinct items in order, then a row counting the rest.

    The rest is the number of all items, duplicates included, beyond ``n``.
    """
    listed = items.select(F.col(column).alias("item")).distinct().orderBy("item").limit(n)
    rest = (
        items.agg((F.count("*") - n).alias("n"))
        .where("n > 0")
        .select(F.lit("overflow").alias("kind"), F.lit(None).cast("string").alias("item"), "n")
    )
    return listed.select(F.lit("item").alias("kind"), "item", F.lit(None).cast("long").alias("n")).unionByName(rest)


def grouped_listing(resources: DataFrame) -> DataFrame:
    """Every name under its type, with the count of the type and of all.

    The listing stays one row per resource in type and name order, so that a type
    with very many resources is never gathered into one cell.
    """
    per_type = resources.groupBy("resource_type").agg(F.count("*").alias("type_count"))
    grand = per_type.agg(F.sum("type_count").alias("n")).select(
        F.lit("Total").alias("resource_type"), F.lit(None).cast("string").alias("name"), F.col("n").alias("type_count")
    )
    rows = resources.select("resource_type", "name").join(per_type, "resource_type")
    return grand.unionByName(rows.orderBy("resource_type", "name").select("resource_type", "name", "type_count"))


def dependents(found: DataFrame) -> DataFrame:
    """Security groups made for a load balancer that is in the list too; the region does not matter."""
    return _groups(found).join(_balancers(found), "parent", "left_semi")


def _made_for_balancer() -> Column:
    return (F.col("resource_type") == "security_group") & F.col("name").startswith(rules.LB_GROUP_PREFIX)


def _groups(found: DataFrame) -> DataFrame:
    parent = F.substring(F.col("name"), len(rules.LB_GROUP_PREFIX) + 1, 2_147_483_647)
    return found.where(_made_for_balancer()).withColumn("parent", parent)


def _balancers(found: DataFrame) -> DataFrame:
    balancers = found.where(F.col("resource_type") == "load_balancer")
    return balancers.select(F.col("name").alias("parent")).distinct()


def deletion_order(found: DataFrame) -> DataFrame:
    """Phase 1: load balancers, other roots, independent groups. Phase 2: dependent groups."""
    # Rows without a possible parent keep out of the join: their NULL key would meet in one task.
    known = _balancers(found).withColumn("waits", F.lit(True))
    matched = _groups(found).join(known, "parent", "left").drop("parent")
    others = found.where(~_made_for_balancer()).withColumn("waits", F.lit(None).cast("boolean"))
    kind, waits = F.col("resource_type"), F.coalesce("waits", F.lit(False))
    return (
        matched.unionByName(others)
        .withColumns(
            {
                "phase": F.when(waits, 2).otherwise(1),
                "rank": F.when(kind == "load_balancer", 0).when(kind != "security_group", 1).otherwise(2),
            }
        )
        .drop("waits")
        .orderBy("phase", "rank", "seq")
    )
