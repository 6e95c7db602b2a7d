"""Registered queries: transcripts, message trees and numbered documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakesight.functions.messages import body_text
from lakesight.operators import sections as X, transcripts as C
from lakesight.plans.registry import Registry
from lakesight.sources import tables as S

textjobs = Registry()

TRANSCRIPT = """
SELECT conv_id, CAST(0 AS BIGINT) AS part,
  trim(string_agg({block}, chr(10) ORDER BY turn), E' \\t\\n\\r') || chr(10) AS body
FROM (SELECT conv_id, turn, role, trim(text, E' \\t\\n\\r') AS text FROM conversations)
WHERE role <> 'system' AND text <> '' GROUP BY conv_id"""
#: Turns of a transcript row; the tables' conversations are shorter.
TURNS = 1_000


@textjobs.register(TRANSCRIPT.format(
    block="chr(10) || '----- MESSAGE (role=' || role || ') -----' || chr(10) || text || chr(10)"))
def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation as plain text."""
    return C.transcripts(S.table(spark, folder, "conversations"), TURNS)


@textjobs.register(TRANSCRIPT.format(
    block="chr(10) || '### ' || role || chr(10) || chr(10) || text || chr(10)"))
def transcripts_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation as markdown."""
    return C.transcripts(S.table(spark, folder, "conversations"), TURNS, markdown=True)


@textjobs.register("SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND trim(text, E' \\t\\n\\r') <> '' AND turn % 7 <> 6")
def visible_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages a reader sees; some are marked hidden."""
    marked = S.table(spark, folder, "conversations").withColumn("hidden", F.col("turn") % 7 == 6)
    return C.visible_messages(marked).select("conv_id", "turn")


@textjobs.register("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN nullif(trim(text, E' \\t\\n\\r'), '') ELSE
trim(concat_ws(chr(10), CASE WHEN trim(text, E' \\t\\n\\r') <> '' THEN text END, '[image: pic ' || turn || ']',
  nullif(trim(role), ''), '[image]'), E' \\t\\n\\r') END AS body FROM conversations""")
def message_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Body text of messages made of text, image and object parts."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    none = F.lit(None).cast("string")
    parts = F.array(
        part("string", F.col("text")),
        part("image_asset_pointer", none),
        part("object", F.concat(F.lit(" "), F.col("role"), F.lit(" "))),
        part("string", F.lit("  ")),
        part("image_asset_pointer", none),
    )
    attachments = F.array(F.struct(F.concat(F.lit("pic "), F.col("turn")).alias("name")))
    kind = F.when(F.col("role") == "system", "model_editable_context").otherwise("text")
    return S.table(spark, folder, "conversations").select(
        "conv_id", "turn", body_text(kind, F.col("text"), parts, attachments).alias("body")
    )


def message_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation as a binary tree of its turns, the later child first."""
    turn = F.col("turn")
    return S.table(spark, folder, "conversations").select(
        "conv_id", turn.alias("id"),
        F.when(turn > 0, F.floor((turn - 1) / 2)).alias("parent"),
        (-turn).alias("ord"),
    )


@textjobs.register("""
WITH RECURSIVE n AS (SELECT conv_id, turn AS id, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, -turn AS ord FROM conversations),
w AS (SELECT conv_id, id, [ord] AS path, 0 AS depth FROM n WHERE parent IS NULL
      UNION ALL SELECT n.conv_id, n.id, list_append(w.path, n.ord), w.depth + 1 FROM w JOIN n ON n.conv_id = w.conv_id AND n.parent = w.id)
SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS position, CAST(depth AS BIGINT) AS depth FROM w""")
def message_tree_order(spark: SparkSession, folder: str) -> DataFrame:
    """Reading order and depth of every message in its tree."""
    return C.preorder(message_tree(spark, folder))


def numbered_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a heading before every line, and a subheading after it."""
    rule = F.lit("\n---\n\n")
    number = lambda i: ((i * 3) % 80 + 2).cast("string")
    section = lambda line, i: F.concat(
        F.when(i % 3 == 0, rule).when(i % 3 == 1, F.concat(rule, F.lit("---\n\n"))).otherwise(""),
        F.lit("## "), number(i), F.lit(". Part\n"), line, F.lit("\n### "), number(i), F.lit(".1   Sub\nend\n"),
    )
    text = F.concat(F.lit("# Title\n"), F.array_join(F.transform(F.split("text", "\n", -1), section), ""))
    return S.table(spark, folder, "documents").select("doc_id", text.alias("text"))


NUMBERED_SQL = r"""
SELECT doc_id, '# Title' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
  CASE (i - 1) % 3 WHEN 0 THEN r WHEN 1 THEN r || s ELSE '' END || '## ' || ((i - 1) * 3 % 80 + 2) || '. Part' || chr(10)
  || x || chr(10) || '### ' || ((i - 1) * 3 % 80 + 2) || '.1   Sub' || chr(10) || 'end' || chr(10)), '') AS text
FROM documents, (SELECT chr(10) || '---' || chr(10) || chr(10) AS r, '---' || chr(10) || chr(10) AS s)"""

ROUTES = {"aws": range(2, 30), "gcp": [30, 33, 36, 40]}


@textjobs.register(rf"""
WITH d AS ({NUMBERED_SQL}),
p AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(## \d+\. )', chr(1) || '\1', 'g'), chr(1)) AS parts,
        chr(10) || '---' || chr(10) || chr(10) AS sep FROM d),
u AS (SELECT doc_id, sep, parts, unnest(range(2, len(parts) + 1)) AS i FROM p),
s AS (SELECT doc_id, CAST(i - 2 AS INTEGER) AS position, i = len(parts) AS is_last, parts[i] AS piece,
        array_to_string(parts[1:i - 1], '') AS before, sep FROM u),
t AS (SELECT *, CASE WHEN contains(before, sep)
    THEN '---' || chr(10) || chr(10) || right(before, strpos(reverse(before), reverse(sep)) - 1) ELSE '' END AS opening FROM s)
SELECT doc_id, position, CAST(regexp_extract(piece, '^## (\d+)\. ', 1) AS INTEGER) AS number,
  CASE WHEN CAST(regexp_extract(piece, '^## (\d+)\. ', 1) AS INTEGER) BETWEEN 2 AND 29 THEN 'aws'
       WHEN CAST(regexp_extract(piece, '^## (\d+)\. ', 1) AS INTEGER) IN (30, 33, 36, 40) THEN 'gcp' ELSE 'shared' END AS bucket,
  rtrim(opening || CASE WHEN is_last THEN piece ELSE left(piece, length(piece) - 1) END, E' \t\n\r') AS body FROM t""")
def document_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered sections of every document, routed by their number."""
    return X.split_documents(numbered_documents(spark, folder), ROUTES, "shared")


@textjobs.register(rf"""
WITH d AS ({NUMBERED_SQL}),
p AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(## \d+\. )', chr(1) || '\1', 'g'), chr(1)) AS parts FROM d)
SELECT doc_id, regexp_replace(array_to_string(list_transform(parts, lambda x, i: CASE WHEN i = 1 THEN x ELSE
  regexp_replace(regexp_replace(x, '^## \d+\. ', '## ' || (i - 1) || '. '), '(?m)^### \d+\.(\d+)\s*',
                 '### ' || (i - 1) || '.\1 ', 'g') END), ''),
  '(\n---\n\n)(\s*---\n\n)+', '\1', 'g') AS text FROM p""")
def renumbered_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Sections and subsections numbered from one in every document."""
    return X.renumber(numbered_documents(spark, folder))
