"""Registered queries: resource inventory reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakesight.functions.resources import BUILTIN_PATTERNS, CATEGORIES, RECOVERY_HINTS, GENERIC_HINT, Naming
from lakesight.operators import inventory as I
from lakesight.plans import derive as D
from lakesight.plans.registry import Registry

ops = Registry()

NAMING = Naming("acme", "dev")
REMNANT = "NLB track: Classic ELB remnant from migration"
BUILTIN = "|".join(BUILTIN_PATTERNS)

CLASSIFIED = rf"""
WITH r AS ({D.INVENTORY_SQL}),
o AS (SELECT *, CASE WHEN resource_type = 'alb' AND lb_type <> '' THEN 'load_balancer' ELSE resource_type END AS orphan_type,
  coalesce(tags['kubernetes.io/cluster/acme-dev-eks'] IN ('owned', 'shared'), false) OR
    (region <> '' AND coalesce(tags['kubernetes.io/cluster/acme-eks-dev-' || region] IN ('owned', 'shared'), false)) AS ours,
  trim(regexp_replace(string_split(display, ':')[-1], '\s*\([^)]*\)\s*\[.*\]$', '')) AS bare FROM r),
n AS (SELECT *, CASE
  WHEN orphan_type = 'cloudfront_oac' AND name = 'acme-dev-frontend-oac' THEN 'legacy OAC; not in Terraform'
  WHEN orphan_type = 'iam_role' AND starts_with(name, 'acme-dev') AND contains(name, '-load-balancer-controller')
    THEN 'AWS Load Balancer Controller; not in Terraform'
  WHEN orphan_type = 'iam_role' AND starts_with(name, 'acme-dev') AND (contains(name, '-csi-driver-role') OR contains(name, '-ebs-csi-'))
    THEN 'EKS addon; not in Terraform'
  WHEN orphan_type = 'iam_role' AND starts_with(name, 'acme-dev') AND NOT regexp_matches(name,
    'acme-dev-(ecs-exec|ecs-task|spark-task|events-invoke-ecs|eks-cluster-role|eks-node-role)') THEN 'project-named role not in Terraform list'
  WHEN orphan_type = 'security_group' AND starts_with(name, 'k8s-elb-') AND ours THEN '{REMNANT}'
  WHEN orphan_type = 'load_balancer' AND lb_type = 'classic' THEN '{REMNANT}'
  WHEN orphan_type = 'target_group' AND starts_with(name, 'k8s-acmekube-acmeapisv-') THEN NULL
  WHEN orphan_type = 'target_group' AND starts_with(name, 'k8s-ingressn-') THEN 'NGINX Ingress; not in Terraform'
  WHEN orphan_type = 'target_group' AND starts_with(name, 'k8s-') THEN 'K8s-created; not in Terraform' END AS orphan_note FROM o),
j AS (SELECT *, CASE resource_type
  WHEN 'cloudfront_oac' THEN contains(name, 'acme-dev-frontend')
  WHEN 'iam_role' THEN regexp_matches(name, '^(acme-dev|acme-eks-)') OR name = 'eks-ebs-csi-driver-role'
  WHEN 'security_group' THEN starts_with(name, 'acme') OR starts_with(name, 'k8s-acmekube-acmeapisv-')
    OR starts_with(name, 'k8s-traffic-acmeeksdev' || region)
  WHEN 'alb' THEN regexp_matches(name, '^acme-dev') OR contains(name, 'acme-dev-') OR (starts_with(name, 'acme') AND contains(name, 'dev'))
    OR starts_with(name, 'k8s-acmekube-acmeapisv-') OR starts_with(name, 'k8s-traffic-acmeeksdev' || region)
  WHEN 'target_group' THEN regexp_matches(name, '^acme-dev') OR contains(name, 'acme-dev-') OR (starts_with(name, 'acme') AND contains(name, 'dev'))
    OR starts_with(name, 'k8s-acmekube-acmeapisv-') OR starts_with(name, 'k8s-traffic-acmeeksdev' || region)
  WHEN 's3' THEN name = 'acme-delta-internal-dev-' || region OR name = 'acme-artifacts-internal-dev-' || region
    OR starts_with(name, 'acme-dev') OR contains(name, '-acme-dev-') OR starts_with(name, 'acme-tf-')
    OR (starts_with(name, 'acme') AND contains(name, 'dev') AND regexp_matches(name, '-delta-internal-|-artifacts-internal-|-frontend-|terraform-state|tf-state'))
  WHEN 'log_group' THEN contains(name, '/aws/eks/acme-eks-dev-' || region) OR contains(name, '/acme/dev')
    OR (contains(name, '/acme/') AND (contains(name, 'cloud-log-group-spark') OR contains(name, 'ecs-api')))
  WHEN 'secret' THEN starts_with(name, 'acme/dev')
  WHEN 'vpc' THEN starts_with(name, 'acme-dev')
  WHEN 'ecr' THEN contains(name, 'acme-dev') OR (starts_with(name, 'acme') AND contains(name, 'dev')) ELSE false END AS ours_by_name,
  CASE WHEN orphan_note IS NULL THEN NULL WHEN orphan_note = 'project-named role not in Terraform list' THEN 'likely' ELSE 'definitely' END AS level FROM n),
c AS (SELECT seq, resource_type, name, region, display, lb_type, orphan_type, orphan_note,
  CASE WHEN level IS NOT NULL THEN level WHEN regexp_matches(bare, '{BUILTIN}') THEN 'builtin'
       WHEN ours_by_name THEN 'project' ELSE 'other' END AS bucket FROM j),
k AS (SELECT *, CASE WHEN bucket <> 'project' THEN NULL ELSE CASE resource_type
  WHEN 'alb' THEN 'nonkube' WHEN 'target_group' THEN 'nonkube' WHEN 'vpc' THEN 'shared-durable' WHEN 'secret' THEN 'shared-durable-with-cooloff'
  WHEN 'security_group' THEN CASE WHEN contains(name, 'alb') OR contains(name, 'ecs-tasks') THEN 'nonkube' WHEN contains(name, 'eks') THEN 'kube'
    WHEN starts_with(name, 'k8s-') THEN 'kube' WHEN contains(name, 'aurora') THEN 'shared-durable' ELSE 'other' END
  WHEN 'log_group' THEN CASE WHEN contains(name, '/aws/eks/acme-eks-dev-' || region) THEN 'kube' ELSE 'nonkube' END
  WHEN 'ecr' THEN CASE WHEN contains(name, '-api-img-') OR contains(name, '-spark-img-') THEN 'shared-nondurable' ELSE 'other' END
  WHEN 'cloudfront_oac' THEN CASE WHEN contains(name, 'kube') THEN 'kube' ELSE 'other' END
  WHEN 'iam_role' THEN CASE WHEN regexp_matches(name, 'ecs|events-invoke|spark') THEN 'nonkube' WHEN contains(name, 'eks') THEN 'kube' ELSE 'other' END
  WHEN 's3' THEN CASE WHEN contains(name, '-frontend-kube-') AND contains(name, region) THEN 'kube'
    WHEN contains(name, '-frontend-nonkube-') AND contains(name, region) THEN 'nonkube'
    WHEN (contains(name, '-delta-internal') OR contains(name, '-artifacts-internal')) AND contains(name, region) THEN 'shared-nondurable'
    WHEN contains(name, 'terraform-state') OR contains(name, 'tf-state') THEN 'shared-durable' ELSE 'other' END
  ELSE 'other' END END AS category FROM c)
"""


def classified(spark: SparkSession, folder: str) -> DataFrame:
    return I.classify(D.inventory(spark, folder), NAMING)


@ops.register(f"{CLASSIFIED} SELECT seq, bucket, category, orphan_note, orphan_type FROM k")
def resource_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Bucket, category and note of every resource."""
    return classified(spark, folder).select("seq", "bucket", "category", "orphan_note", "orphan_type")


@ops.register(f"""{CLASSIFIED} SELECT seq, orphan_type AS resource_type, name, nullif(region, '') AS region, display, orphan_note,
bucket AS level, nullif(lb_type, '') AS lb_type FROM k WHERE bucket IN ('definitely', 'likely')""")
def orphaned_resources(spark: SparkSession, folder: str) -> DataFrame:
    """Definite and likely leftovers together."""
    leftovers = I.orphans(classified(spark, folder))
    return leftovers.withColumn("lb_type", F.try_element_at("extra", F.lit("lb_type"))).drop("extra")


@ops.register(f"""{CLASSIFIED} SELECT CASE WHEN region = '' THEN '(global)' ELSE region END AS region,
{', '.join(f"count(*) FILTER (WHERE category = '{c}') AS " + chr(34) + c + chr(34) for c in CATEGORIES)} FROM k GROUP BY 1""")
def category_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Project resources per region and category, zeros kept."""
    return I.category_matrix(classified(spark, folder))


@ops.register(f"""{CLASSIFIED} SELECT {', '.join(f"count(*) FILTER (WHERE bucket = '{b}') AS {b}" for b in
('definitely', 'likely', 'project', 'other', 'builtin'))} FROM k""")
def bucket_tallies(spark: SparkSession, folder: str) -> DataFrame:
    """How many resources fell into each bucket."""
    return I.bucket_tallies(classified(spark, folder))


HINT_CASE = "CASE orphan_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RECOVERY_HINTS.items()) + f" ELSE '{GENERIC_HINT}' END"


@ops.register(f"""{CLASSIFIED} SELECT DISTINCT orphan_type AS resource_type, {HINT_CASE} AS hint FROM k
WHERE bucket IN ('definitely', 'likely')""")
def recovery_hints(spark: SparkSession, folder: str) -> DataFrame:
    """How to look up each type of leftover."""
    return I.recovery_hints(I.orphans(classified(spark, folder)))


@ops.register(f"""{CLASSIFIED}, x AS (SELECT display FROM k WHERE bucket = 'other')
SELECT 'item' AS kind, item, CAST(NULL AS BIGINT) AS n FROM (SELECT DISTINCT display AS item FROM x ORDER BY item LIMIT 30)
UNION ALL SELECT 'overflow', NULL, count(*) - 30 FROM x HAVING count(*) > 30""")
def other_resources(spark: SparkSession, folder: str) -> DataFrame:
    """The first thirty resources of others and how many more there are."""
    return I.first_listed(classified(spark, folder).where("bucket = 'other'"), "display", 30)


@ops.register(f"""WITH r AS ({D.INVENTORY_SQL})
SELECT resource_type, name, count(*) OVER (PARTITION BY resource_type) AS type_count FROM r
UNION ALL SELECT 'Total', NULL, count(*) FROM r""")
def grouped_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Every name under its type, with counts."""
    return I.grouped_listing(D.inventory(spark, folder))


DEPENDS = "resource_type = 'security_group' AND starts_with(name, 'k8s-elb-') AND substr(name, 9) IN (SELECT name FROM f WHERE resource_type = 'load_balancer')"
FOUND = f"{CLASSIFIED}, f AS (SELECT seq, orphan_type AS resource_type, name FROM k WHERE bucket IN ('definitely', 'likely'))"


@ops.register(f"{FOUND} SELECT seq, name, substr(name, 9) AS parent FROM f WHERE {DEPENDS}")
def dependent_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Security groups that wait for a load balancer."""
    return I.dependents(I.orphans(classified(spark, folder))).select("seq", "name", "parent")


@ops.register(f"""{FOUND} SELECT seq, resource_type, name, CAST(CASE WHEN {DEPENDS} THEN 2 ELSE 1 END AS INTEGER) AS phase,
CAST(CASE WHEN resource_type = 'load_balancer' THEN 0 WHEN resource_type <> 'security_group' THEN 1 ELSE 2 END AS INTEGER) AS rank FROM f""")
def deletion_order(spark: SparkSession, folder: str) -> DataFrame:
    """Leftovers in the order they can be deleted."""
    ordered = I.deletion_order(I.orphans(classified(spark, folder)))
    return ordered.select("seq", "resource_type", "name", "phase", "rank")
