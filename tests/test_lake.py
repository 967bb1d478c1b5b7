"""Cold tables of the session catalogue, and the statements of the lake variant."""

from collections import Counter

import pytest
from pyspark.sql import types as T

from tidemark.schemas import CH_COLD, CH_NAMES, TPCC, conform, schema_drift, tpcc_schema
from tidemark.session import in_parallel, scratch, shared_dir
from tidemark.sources.lake import LakeCold, append, bulk_load, create_from_source, create_table


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_create_is_idempotent_and_listed(spark):
    path, schema = scratch(spark, "table"), T.StructType().add("k", "integer").add("v", "string")
    for _ in range(2):
        create_table(spark, "lake_listed", schema, path)
        append(spark.createDataFrame([("a", 1)], "v string, k int"), "lake_listed")
    assert rows(spark.table("lake_listed")) == Counter({(1, "a"): 2})
    assert spark.catalog.tableExists("lake_listed")
    assert "lake_listed" in {r.tableName for r in spark.sql("SHOW TABLES").collect()}
    assert [r.col_name for r in spark.sql("DESCRIBE TABLE lake_listed").collect()] == ["k", "v"]
    spark.sql("DROP TABLE lake_listed")
    assert not spark.catalog.tableExists("lake_listed")


def test_partitioned_table_reads_one_partition(spark):
    schema = T.StructType().add("k", "integer").add("age", "integer")
    create_table(spark, "lake_parts", schema, scratch(spark, "parts"), ["age"])
    append(spark.range(100).selectExpr("CAST(id AS INT) k", "CAST(id % 4 AS INT) age"),
           "lake_parts")
    one = spark.table("lake_parts").where("age = 3")
    assert one.count() == 25
    assert "PartitionFilters: [isnotnull(age" in one._jdf.queryExecution().toString()
    spark.sql("DROP TABLE lake_parts")


def test_dots_in_names_and_empty_schema_only_table(spark):
    create_from_source(spark, "public.thing", [("a", "smallint"), ("t", "timestamp with time zone")],
                       scratch(spark, "thing"))
    assert spark.table("public_thing").dtypes == [("a", "smallint"), ("t", "timestamp")]
    assert spark.table("public_thing").count() == 0
    spark.sql("DROP TABLE public_thing")


def test_added_column_reads_null_for_old_rows(spark):
    create_table(spark, "lake_wide", T.StructType().add("k", "integer"), scratch(spark, "wide"))
    append(spark.createDataFrame([(1,)], "k int"), "lake_wide")
    LakeCold(spark, "default").add_column("lake_wide", "email", "string")
    append(spark.createDataFrame([(2, "x")], "k int, email string"), "lake_wide")
    assert rows(LakeCold(spark, "default").read("lake_wide")) == Counter([(1, None), (2, "x")])
    spark.sql("DROP TABLE lake_wide")


def test_bulk_load_renames(spark, sf):
    paths = bulk_load(spark, sf, {"nation": "ch_nation", "region": "ch_region"},
                      scratch(spark, "load"))
    assert spark.read.parquet(paths["ch_nation"]).count() == 25
    assert spark.read.parquet(paths["ch_region"]).count() == 5
    assert {"ch_nation", "ch_region"} <= {r.tableName for r in spark.sql("SHOW TABLES").collect()}
    assert spark.table("ch_nation").count() == 25
    for name in paths:
        spark.sql(f"DROP TABLE {name}")


def test_arrow_at_the_edge(spark, sf):
    table = spark.read.parquet(f"{sf}/nation.parquet").where("n_regionkey = 1").toArrow()
    assert table.num_rows == 5 and table.column_names[0] == "n_nationkey"


def test_fixed_layouts(spark):
    assert sorted(TPCC) == ["customer", "district", "hhistory", "item", "new_order", "oorder",
                            "order_line", "stock", "warehouse"]
    assert [len(tpcc_schema(t)) for t in sorted(TPCC)] == [16, 11, 8, 5, 3, 8, 10, 7, 9]
    assert tpcc_schema("district")["d_tax"].dataType == T.DecimalType(4, 4)
    assert tpcc_schema("item", wide=True)["i_id"].dataType == T.LongType()
    assert CH_NAMES["partsupp"] == "ch_partsupp" and set(CH_COLD) < set(CH_NAMES)
    df = conform(spark.createDataFrame([(1,)], "i_id int"), tpcc_schema("item"))
    assert df.first().asDict() == {"i_id": 1, "i_im_id": None, "i_name": None, "i_price": None,
                                   "i_data": None}


def test_schema_drift(spark):
    names = "table_name string, column_name string, type string"
    a = spark.createDataFrame([("t", "x", "int"), ("t", "y", "int"), ("t", "z", "int")], names)
    b = spark.createDataFrame([("t", "x", "int"), ("t", "y", "long"), ("t", "w", "int")], names)
    assert {r.column_name: r.status for r in schema_drift(a, b).collect()} == {
        "x": "same", "y": "retyped", "z": "missing", "w": "added"}


class Recorder:
    """Stands for a session: keeps the statements, as no lake catalogue is at hand."""

    def __init__(self):
        self.texts = []

    def sql(self, text):
        self.texts.append(text)


def test_lake_statements():
    spark = Recorder()
    lake = LakeCold(spark, "rest.iceberg")
    lake.create_namespace()
    lake.add_column("t", "email", "string")
    lake.read("public.t", snapshot=7)
    assert spark.texts == [
        "CREATE NAMESPACE IF NOT EXISTS rest.iceberg",
        "ALTER TABLE rest.iceberg.t ADD COLUMNS (email string)",
        "SELECT * FROM rest.iceberg.public_t VERSION AS OF 7"]


def test_shared_folder_comes_from_the_session(spark):
    class Conf:
        def get(self, key, default=None):
            return "hdfs://shared/checkpoints/" if key == "spark.checkpoint.dir" else default

    class Context:
        master, applicationId = "spark://cluster", "app"

    class Session:
        conf, sparkContext = Conf(), Context()
    assert shared_dir(Session()) == "hdfs://shared/checkpoints"
    assert scratch(Session(), "x").startswith("hdfs://shared/checkpoints/x-")
    Session.conf = type("Unset", (), {"get": lambda self, key, default=None: default})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_parallel_jobs_return_in_order_and_raise(spark):
    assert in_parallel(spark, [lambda i=i: spark.range(i).count() for i in range(5)]) == [
        0, 1, 2, 3, 4]
    with pytest.raises(ZeroDivisionError):
        in_parallel(spark, [lambda: 1, lambda: 1 // 0])
