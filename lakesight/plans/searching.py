"""Registered queries: vector search and text vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakesight.functions import vectors as V
from lakesight.operators import ann, embed as B, keyed, quantized, search as N
from lakesight.plans.registry import Registry
from lakesight.session import application_folder, scratch_folder
from lakesight.sources import tables as S
from lakesight.sources.store import TableStore, load_once

searching = Registry()

FOUND = ["doc_id", "lang", "source", "n_chars"]


def example(spark: SparkSession, folder: str) -> list[float]:
    """The vector searched for: that of the first text, read by its key."""
    return keyed.lookup(S.table(spark, folder, "embeddings"), "vec_id", 0).select("embedding").first()[0]


def search_store(spark: SparkSession, folder: str) -> TableStore:
    """The store of an application's searches; files that have changed since make one of their own."""
    sources = [S.table(spark, folder, name).select(
        "_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size") for name in ("documents", "embeddings")]
    # One row per file; what comes to the driver is one number.
    files = sources[0].unionByName(sources[1]).distinct()
    mark = files.agg(F.coalesce(F.bit_xor(F.xxhash64("file_path", "file_modification_time", "file_size")), F.lit(0))).first()[0]
    return TableStore(spark, application_folder(spark, f"search-{mark & (1 << 64) - 1:016x}"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Texts paired with their vectors, as the load lane stores them: a search reads one table and joins nothing.

    The first search of an application loads the table, the others find it.
    """
    return load_once(search_store(spark, folder), "corpus", lambda: S.feedback(spark, folder).select(*FOUND, "embedding"))[0]


def coded_corpus(spark: SparkSession, folder: str) -> quantized.CodedVectors:
    """The same rows with codes of one byte a dimension, stored once as well."""
    store = search_store(spark, folder)
    return quantized.load_codes(store, "coded", lambda: corpus(spark, folder), filters=["lang", "source"])


def search(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return N.nearest(corpus(spark, folder), example(spark, folder), k, key="doc_id", columns=FOUND)


DISTANCE = "round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9)"
QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"
FOUND_SQL = f"SELECT doc_id, lang, source, n_chars FROM documents JOIN embeddings e ON doc_id = vec_id, {QUERY}"


@searching.register(f"{FOUND_SQL} ORDER BY {DISTANCE}, doc_id LIMIT 50")
def semantic_search(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty texts closest to the first one."""
    return search(spark, folder, N.TOP_K)


@searching.register(f"{FOUND_SQL} ORDER BY {DISTANCE}, doc_id LIMIT 30")
def fallback_search(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty closest texts, unfiltered."""
    return search(spark, folder, N.FALLBACK_K)


@searching.register(f"""{FOUND_SQL} WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src3')
ORDER BY {DISTANCE}, doc_id LIMIT 50""")
def filtered_search(spark: SparkSession, folder: str) -> DataFrame:
    """The closest texts of some languages and sources; other filter names are ignored."""
    filters = {"lang": ["en", "de"], "source": ["src1", "src2", "src3"], "n_chars": ["5"], "nothing": ["x"], "text": []}
    return N.nearest(corpus(spark, folder), example(spark, folder), filters=filters, key="doc_id", columns=FOUND)


@searching.register(f"{FOUND_SQL} ORDER BY {DISTANCE}, doc_id LIMIT 50")
def coded_search(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty closest texts: bounds from byte codes first, vectors only of what they leave."""
    return coded_corpus(spark, folder).search(example(spark, folder), N.TOP_K, key="doc_id", columns=FOUND)


@searching.register(f"""{FOUND_SQL} WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src3')
ORDER BY {DISTANCE}, doc_id LIMIT 50""")
def coded_filtered_search(spark: SparkSession, folder: str) -> DataFrame:
    """The closest texts of some languages and sources by codes, which carry the columns of the filters."""
    filters = {"lang": ["en", "de"], "source": ["src1", "src2", "src3"]}
    return coded_corpus(spark, folder).search(
        example(spark, folder), N.TOP_K, filters, ["lang", "source"], key="doc_id", columns=FOUND)


@searching.register(f"""WITH r AS ({FOUND_SQL} ORDER BY {DISTANCE}, doc_id LIMIT 50)
SELECT source, count(*) AS mentions FROM r GROUP BY 1 ORDER BY mentions DESC, source LIMIT 5""")
def search_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """The sources most often found by a search."""
    return N.brand_histogram(search(spark, folder, N.TOP_K), "source")


@searching.register(f"""WITH r AS ({FOUND_SQL} ORDER BY {DISTANCE}, doc_id LIMIT 50) SELECT * FROM r ORDER BY doc_id LIMIT 20""")
def search_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The first twenty rows of a search result, by key."""
    return N.sample_rows(search(spark, folder, N.TOP_K), ["doc_id"], semantic=True)


def label_centers(spark: SparkSession, folder: str) -> DataFrame:
    """The mean vector of every label, from exact sums."""
    value = F.col("x").cast("decimal(18,9)")
    cells = S.table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(
        (F.sum(value).cast("double") / F.count("*").cast("double")).alias("mean")
    )
    # One cell per label and dimension is left, whatever the size of a label.
    ordered = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "mean"))).alias("cells"))
    return ordered.select("label", F.transform("cells", lambda c: c["mean"]).alias("embedding"))


@searching.register("""
WITH c AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, CAST(sum(CAST(x AS DECIMAL(18,9))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean FROM c GROUP BY 1, 2),
q AS (SELECT label, list(mean ORDER BY i) AS v FROM m GROUP BY 1),
d AS (SELECT q.label, vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), v), 9) AS distance FROM q, embeddings)
SELECT label, vec_id, distance, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM d
QUALIFY rank <= 10""")
def label_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten vectors closest to the centre of every label."""
    corpus = S.table(spark, folder, "embeddings")
    return N.nearest_batch(corpus, label_centers(spark, folder), 10, key="vec_id", question="label")


def hashed_sql(source: str, key: str) -> str:
    """Vectors of a text table as (key, dim, value) rows of the places that are not zero."""
    return f"""
    SELECT {key}, dim, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS FLOAT) AS value FROM (
      SELECT {key}, dim, CAST(sum(sgn) AS DOUBLE) AS c FROM (
        SELECT {key}, ('0x' || substr(m, 1, 4))::BIGINT % 64 AS dim,
               CASE WHEN ('0x' || substr(m, 5, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sgn
        FROM (SELECT {key}, md5(w) AS m FROM (
          SELECT {key}, unnest(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+')) AS w FROM {source}) WHERE w <> ''))
      GROUP BY {key}, dim)"""


def places(vectors: DataFrame, key: str) -> DataFrame:
    """The places of a vector that are not zero, in millionths."""
    return (
        vectors.select(key, F.posexplode("embedding").alias("dim", "value"))
        .where("value <> 0")
        .select(key, F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double") * 1e6).cast("long").alias("value"))
    )


@searching.register(f"""SELECT doc_id, dim, CAST(round(CAST(value AS DOUBLE) * 1e6) AS BIGINT) AS value
FROM ({hashed_sql('documents', 'doc_id')}) WHERE value <> 0""")
def text_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The vector of every document's whole text, place by place."""
    documents = S.table(spark, folder, "documents").select("doc_id", "text")
    return places(B.embed_column(documents, "text", B.hashing_embedder()), "doc_id")


@searching.register(f"""
WITH d AS ({hashed_sql('documents', 'doc_id')}), b AS ({hashed_sql('benchmark', 'item_id')}),
dv AS (SELECT k.doc_id, list(coalesce(d.value, 0)::DOUBLE ORDER BY g.i) AS v FROM documents k CROSS JOIN range(64) g(i)
       LEFT JOIN d ON d.doc_id = k.doc_id AND d.dim = g.i GROUP BY 1),
bv AS (SELECT k.item_id, list(coalesce(b.value, 0)::DOUBLE ORDER BY g.i) AS v FROM benchmark k CROSS JOIN range(64) g(i)
       LEFT JOIN b ON b.item_id = k.item_id AND b.dim = g.i GROUP BY 1),
p AS (SELECT item_id, doc_id, round(list_distance(dv.v, bv.v), 9) AS distance FROM dv, bv)
SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id) AS rank FROM p QUALIFY rank <= 5""")
def benchmark_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five documents closest to every benchmark text."""
    embed = B.hashing_embedder()
    corpus = B.embed_column(S.table(spark, folder, "documents").select("doc_id", "text"), "text", embed)
    questions = B.embed_column(S.table(spark, folder, "benchmark"), "text", embed)
    return ann.nearest_in_cells(corpus, questions, 5, key="doc_id", question="item_id").rows.drop("distance")


@searching.register(f"""
WITH after AS (SELECT doc_id, text || ' recall' AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)
               UNION ALL SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT doc_id, dim, CAST(round(CAST(value AS DOUBLE) * 1e6) AS BIGINT) AS value FROM ({hashed_sql('after', 'doc_id')}) WHERE value <> 0""")
def refreshed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors after an edit of the poor texts: only the changed rows are embedded again."""
    embed = lambda rows: B.embed_column(rows, "text", B.hashing_embedder())
    before = S.table(spark, folder, "documents").select("doc_id", "text")
    poor = S.table(spark, folder, "labels").where("quality = 0").select("doc_id")
    edits = before.join(poor, "doc_id", "left_semi").withColumn("text", F.concat("text", F.lit(" recall")))
    # The edits name the touched rows; nothing has to be compared.
    return places(keyed.refresh_vectors(embed(before), edits, embed, "doc_id"), "doc_id")


@searching.register("""
WITH c AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT vec_id, count(*) AS dimension, CAST(sum(i * CAST(round(CAST(x AS DOUBLE) * 1e8) AS BIGINT)) AS BIGINT) AS checksum,
  CAST(count(*) FILTER (WHERE x < 0) AS BIGINT) AS signs FROM c GROUP BY 1""")
def vector_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors written as text and read back: their length, a sum over places and values, and the signs in the text."""
    rows = S.table(spark, folder, "embeddings").select("vec_id", V.to_text(F.col("embedding")).alias("text"))
    back = V.from_text(F.col("text"))
    value = lambda x: F.round(x.cast("double") * 1e8).cast("long")
    weighed = F.zip_with(F.sequence(F.lit(1), F.size(back)), back, lambda i, x: i.cast("long") * value(x))
    return rows.select(
        "vec_id", F.size(back).cast("long").alias("dimension"),
        F.aggregate(weighed, F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"),
        F.regexp_count("text", F.lit(r"[\[, ]-")).cast("long").alias("signs"))


@searching.register(f"{FOUND_SQL} ORDER BY {DISTANCE}, doc_id LIMIT 50")
def approximate_search(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty closest texts through cells, of which only those that can hold one are read."""
    store = TableStore(spark, scratch_folder(spark, "cells"))
    index = ann.build_cells(store, "cells", S.feedback(spark, folder).select(*FOUND, "embedding"), lists=16)
    return index.search(example(spark, folder), 50, probes=6, key="doc_id", columns=FOUND)
