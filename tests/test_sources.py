import pytest
from exports import GATE_ROWS
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from tillhouse.operators import quality
from tillhouse.sources import csv_files, tables

HEADER = "transaction_id,transaction_date,store_id,product_id,customer_id,quantity,discount_pct\n"


def export(tmp_path, text, name="t.csv"):
    folder = tmp_path / "export"
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEADER + text)
    return str(folder)


def test_ids_stay_text_and_null_texts_become_null(spark, tmp_path):
    path = export(tmp_path, "0012,2026-01-01,ST-1,P,0042,1,2.5\n13,NULL,NA,None,,2,0\n14,2026-01-01,nan,\"a, \"\"b\"\"\",x,3,0.5\n")
    rows = csv_files.read_transactions(spark, path).drop(*csv_files.FILE_ORDER).collect()
    assert [tuple(r) for r in rows] == [
        ("0012", "2026-01-01", "ST-1", "P", "0042", 1, 2.5),
        ("13", None, None, None, None, 2, 0.0),
        ("14", "2026-01-01", None, 'a, "b"', "x", 3, 0.5),
    ]


def test_text_in_a_number_column_fails(spark, tmp_path):
    path = export(tmp_path, "1,2026-01-01,s,p,c,many,0\n")
    with pytest.raises((PySparkException, Py4JJavaError), match="many"):
        csv_files.read_transactions(spark, path).collect()


def test_columns_are_found_by_name(spark, tmp_path):
    folder = tmp_path / "export"
    folder.mkdir()
    text = "transaction_date,more,transaction_id,store_id,product_id,customer_id,discount_pct,quantity\na,x,b,c,d,e,2,1\n"
    (folder / "t.csv").write_text(text)
    read = csv_files.read_transactions(spark, str(folder)).drop(*csv_files.FILE_ORDER)
    assert [tuple(r) for r in read.collect()] == [("b", "a", "c", "d", "e", 1, 2.0)]
    (folder / "t.csv").write_text(text.replace("store_id", "shop"))
    with pytest.raises(ValueError, match="store_id"):
        csv_files.read_transactions(spark, str(folder))
    export(tmp_path, "1,2026-01-01,s,p,c,1,0\n", "u.csv")  # files must agree on their header
    (folder / "t.csv").write_text(text)
    with pytest.raises((PySparkException, Py4JJavaError)):
        csv_files.read_transactions(spark, str(folder)).collect()


def test_numbers_as_pandas_writes_them(spark, tmp_path):
    path = export(tmp_path, "1,2026-01-01,s,p,c,2.0,1e1\n2,2026-01-01,s,p,c,NA,nan\n3,2026-01-01,s,p,c, 7 ,0.5\n")
    rows = csv_files.read_transactions(spark, path).collect()
    assert [(r.quantity, r.discount_pct) for r in rows] == [(2, 10.0), (None, None), (7, 0.5)]
    for text in ("2.5", "many", "1x"):
        path = export(tmp_path, f"1,2026-01-01,s,p,c,{text},0\n")
        with pytest.raises((PySparkException, Py4JJavaError), match=f"quantity: {text}"):
            csv_files.read_transactions(spark, path).collect()


@pytest.mark.parametrize("more", [1, 2])
def test_file_order_is_that_of_the_paths(spark, tmp_path, more):
    """Files of equal names in two folders: the first copy does not depend on their sizes."""
    for day in (1, 2):
        folder = tmp_path / "export" / f"day={day}"
        folder.mkdir(parents=True)
        extra = "".join(f"X{day}-{i},2026-01-01,s,p,x,1,0\n" for i in range(50 if day == more else 0))
        (folder / "part.csv").write_text(HEADER + extra + f"T,2026-01-01,s,p,day-{day},1,0\n")
    raw = csv_files.read_transactions(spark, str(tmp_path / "export"))
    assert [r.customer_id for r in quality.repeats(raw, csv_files.FILE_ORDER).collect()] == ["day-2"]


def test_file_order_over_files_and_splits(spark, tmp_path, make):
    """The first copy is the first line of the first file, however the files are cut."""
    lines = [f"T{i % 50},2026-01-01,s,p,{i},1,0\n" for i in range(600)]
    for part in range(3):
        path = export(tmp_path, "".join(lines[part * 200 : part * 200 + 200]), f"part-{part}.csv")
    conf = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(conf, "700")
    try:
        raw = csv_files.read_transactions(spark, path)
        assert raw.rdd.getNumPartitions() > 10
        again = quality.repeats(raw, csv_files.FILE_ORDER)
        kept = raw.join(again.select("customer_id"), "customer_id", "left_anti").collect()
    finally:
        spark.conf.unset(conf)
    assert sorted(int(r.customer_id) for r in kept) == list(range(50))


def test_round_trip(spark, tmp_path, make):
    frame = make.transactions(GATE_ROWS).drop("line")
    path = str(tmp_path / "out")
    for _ in range(2):  # the second write replaces the first
        csv_files.write(frame, path)
    back = csv_files.read_transactions(spark, path).drop(*csv_files.FILE_ORDER)
    assert sorted(back.collect(), key=str) == sorted(frame.collect(), key=str)


def test_blanks_survive_a_round_trip(spark, tmp_path, make):
    path = str(tmp_path / "out")
    csv_files.write(make.stores([("ST-1", " North ", "a,b", 2000)]), path)
    assert tuple(csv_files.read_stores(spark, path).first()) == ("ST-1", " North ", "a,b", 2000)


def test_scratch_folders_are_fresh_and_under_the_checkpoint_folder(spark):
    first, second = tables.scratch_folder(spark), tables.scratch_folder(spark)
    assert first != second and spark.conf.get("spark.checkpoint.dir") in first
