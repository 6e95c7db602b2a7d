"""Records with quoted line breaks, cut in small blocks, against Spark's reader that takes a file whole."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakesight.operators.embed import hashing_embedder
from lakesight.plans import load as lane
from lakesight.sources import csv_files, quoted_csv
from lakesight.sources.store import TableStore

HEADER = ",".join(csv_files.REQUIRED_COLUMNS)
CELLS = ["", "x", "plain text", '"a, b"', '"two\nlines"', '"say ""so"""', '""', '"\n"', '"""\n"""', '"a\n\n"",b\nc"', '5" wide', '"é\n😀"', '" x "']


def whole_file(spark, path):
    """The reader that needs a task for each file."""
    rows = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    return sorted((tuple(r[c] for c in csv_files.REQUIRED_COLUMNS) for r in rows.collect()), key=str)


def cut(spark, path):
    rows = csv_files.read_raw_csv(spark, path)
    return sorted((tuple(r)[:-1] for r in rows.collect()), key=str)


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_blocks_give_the_records_of_the_whole_file(spark, tmp_path, small_blocks, ending):
    rng = random.Random(len(ending))
    for name in ("a.csv", "b.csv"):
        rows = [",".join([str(i), *[rng.choice(CELLS) for _ in range(11)]]) for i in range(40)]
        text = "\n".join([HEADER, *rows[:20], "", *rows[20:]]) + "\n" * (name == "a.csv")
        (tmp_path / name).write_bytes(text.replace("\n", ending).encode())
    text = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert text.select("_metadata.file_block_start").distinct().count() > 6
    assert cut(spark, str(tmp_path)) == whole_file(spark, str(tmp_path))


def test_order_and_last_row_of_a_key(spark, tmp_path, small_blocks):
    rows = [f'{i % 7},c,B{i},M,1,2.50,2026-01-02,S,A,"text\nof {i}",4,Neutral' for i in range(60)]
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *rows]))
    typed = csv_files.clean_raw(csv_files.read_raw_csv(spark, str(tmp_path)))
    last = {r["id"]: r["brand"] for r in csv_files.last_in_file(typed).collect()}
    assert last == {str(i % 7): f"B{i}" for i in range(60)}
    assert [r["brand"] for r in typed.orderBy(csv_files.FILE_ORDER).collect()] == [f"B{i}" for i in range(60)]


def test_states_compose_over_blocks():
    text = 'a,"b\nc""\n"" d\n,"x",\n"\nz,"q"\n"open\n\n'.split("\n")
    state, wanted = 0, []
    for line in text:
        wanted.append(state)
        state = quoted_csv.step(line, state)
    for size in (1, 2, 3):
        state = 0
        for at in range(0, len(text), size):
            assert state == wanted[at]
            *_, (_, kind, _, _, ends) = quoted_csv.cut_block(iter(text[at : at + size]))
            assert kind == quoted_csv.SUMMARY
            state = ends[state]


def test_a_record_longer_than_blocks_and_an_open_quote(spark, tmp_path, small_blocks):
    long = "\n".join("word " * 9 for _ in range(40))
    rows = [f'1,c,B,M,1,2,2026-01-02,S,A,"{long}",4,Neutral', "2,c,B,M,1,2,2026-01-02,S,A,x,4,Neutral", '3,c,B,M,1,2,2026-01-02,S,A,"never closed\nmore']
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *rows]))
    assert {r[0]: r[9] for r in cut(spark, str(tmp_path))}["1"] == long
    assert cut(spark, str(tmp_path))[-1][9].endswith("never closed\nmore")


def test_strict_load(spark, tmp_path):
    folder, store = tmp_path / "csv", TableStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    good = "1,c,B,M,1,2.50,2026-01-02,S,A,fine,N/A,Neutral"
    (folder / "a.csv").write_text("\n".join([HEADER, good, good.replace("1,c", "2,c").replace("2.50", "cheap")]))
    with pytest.raises(ValueError, match="1 bad values: price of '2' is 'cheap'"):
        lane.load_raw(store, str(folder), strict=True)
    assert store.is_empty("sales_raw")
    assert lane.load_raw(store, str(folder))[0].where(F.col("price").isNull()).count() == 1
    (folder / "a.csv").write_text("\n".join([HEADER, good]))
    assert lane.load_raw(store, str(folder), force=True, strict=True)[0].count() == 1


def test_only_repeated_keys_are_put_in_order(spark):
    kind = "id string, brand string, _file_order struct<file: string, block: bigint, row: bigint>"

    def last(*keys):
        rows = [(key, f"B{n}", ("f" if n < 5 else "g", n % 2, n)) for n, key in enumerate(keys)]
        return csv_files.last_in_file(spark.createDataFrame(rows, kind).repartition(3))

    found = last("a", None, "b", "a", None, "c", "a", "")
    assert found.columns == ["id", "brand"]
    assert {r["id"]: r["brand"] for r in found.collect()} == {"a": "B6", None: "B1", "b": "B2", "c": "B5", "": "B7"}
    assert found.count() == 5
    # Where every key comes once, what is shuffled and sorted is known to be empty.
    once = last(*"abcdefgh", None)
    assert len(once.collect()) == 9
    plan = once._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "EmptyRelation" in plan


def test_batches_of_lines_are_cut_by_blocks():
    blocks = [("f", 0, ["h", 'a,"x', 'y"', ""]), ("f", 64, ['"p', 'q",1', "z"]), ("g", 0, ["h"]), ("g", 9, ['5" w', "é"])]
    lines = [(file, block, line) for file, block, own in blocks for line in own]
    wanted = [(file, block, *found) for file, block, own in blocks for found in quoted_csv.cut_block(iter(own))]
    for size in (1, 2, 3, len(lines)):
        cuts = [pa.RecordBatch.from_pylist([dict(zip(("_file", "_block", "line"), r, strict=True)) for r in lines[at : at + size]])
                for at in range(0, len(lines), size)]
        got = [tuple(r.values()) for batch in quoted_csv._cut(iter(cuts)) for r in batch.to_pylist()]
        assert got == wanted


def test_vectors_of_a_call_are_those_of_its_texts():
    texts = ["", " ", "Ab ab\tAB", "x\x1cy\xa0z   é", 'say "so"\n\v\fß', "İ i", "one two " * 40, "-"]
    together = hashing_embedder()(texts)
    for text, vector in zip(texts, together, strict=True):
        wanted = np.zeros(64)
        for word in filter(None, re.split(r"[ \t\n\r\f\v]+", text.lower())):
            digest = hashlib.md5(word.encode()).hexdigest()
            wanted[int(digest[:4], 16) % 64] += 1 if int(digest[4], 16) % 2 == 0 else -1
        norm = np.sqrt(np.dot(wanted, wanted))
        assert vector.dtype == np.float32 and vector.tolist() == (wanted / norm if norm else wanted).astype(np.float32).tolist()
