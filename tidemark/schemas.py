"""Fixed table layouts: the nine order-processing tables and the analytic rename."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and types of the order-processing (TPC-C) tables.
TPCC = {
    "customer": "c_id INT, c_d_id INT, c_w_id INT, c_first STRING, c_middle STRING, "
                "c_last STRING, c_address STRING, c_phone STRING, c_credit STRING, "
                "c_credit_lim DECIMAL(12,2), c_discount DECIMAL(4,4), c_balance DECIMAL(12,2), "
                "c_ytd_payment DECIMAL(12,2), c_payment_cnt INT, c_delivery_cnt INT, "
                "c_comment STRING",
    "district": "d_id INT, d_w_id INT, d_name STRING, d_street_1 STRING, d_street_2 STRING, "
                "d_city STRING, d_state STRING, d_zip STRING, d_tax DECIMAL(4,4), "
                "d_ytd DECIMAL(12,2), d_next_o_id INT",
    "hhistory": "h_c_id INT, h_c_d_id INT, h_c_w_id INT, h_d_id INT, h_w_id INT, "
                "h_date TIMESTAMP_NTZ, h_amount DECIMAL(12,2), h_data STRING",
    "item": "i_id INT, i_im_id INT, i_name STRING, i_price DECIMAL(12,2), i_data STRING",
    "new_order": "no_o_id INT, no_d_id INT, no_w_id INT",
    "oorder": "o_id INT, o_c_id INT, o_d_id INT, o_w_id INT, o_entry_d TIMESTAMP_NTZ, "
              "o_carrier_id INT, o_ol_cnt INT, o_all_local BOOLEAN",
    "order_line": "ol_o_id INT, ol_d_id INT, ol_w_id INT, ol_number INT, ol_i_id INT, "
                  "ol_supply_w_id INT, ol_delivery_d TIMESTAMP_NTZ, ol_quantity DECIMAL(4,2), "
                  "ol_amount DECIMAL(12,2), ol_dist_info STRING",
    "stock": "s_i_id INT, s_w_id INT, s_quantity INT, s_ytd INT, s_order_cnt INT, "
             "s_remote_cnt INT, s_data STRING",
    "warehouse": "w_id INT, w_name STRING, w_street_1 STRING, w_street_2 STRING, "
                 "w_city STRING, w_state STRING, w_zip STRING, w_tax DECIMAL(4,4), "
                 "w_ytd DECIMAL(12,2)",
}

# Names of the analytic (TPC-H) tables in the lake.
CH_NAMES = {t: f"ch_{t}" for t in ("customer", "lineitem", "nation", "orders", "part",
                                   "partsupp", "region", "supplier")}

# The cold rows of each analytic table; nation, region and supplier stay hot.
CH_COLD = {
    "customer": "c_custkey > 100",
    "lineitem": "l_orderkey > 100",
    "orders": "o_orderkey > 100",
    "part": "p_partkey > 100",
}


def tpcc_schema(table: str, wide: bool = False) -> T.StructType:
    """The layout of a table; ``wide`` makes its integers 64 bits, for keys beyond 2^31."""
    schema = T.StructType.fromDDL(TPCC[table])
    if wide:
        return T.StructType([T.StructField(f.name, T.LongType()) if f.dataType == T.IntegerType()
                             else f for f in schema.fields])
    return schema


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a layout, cast; those that ``df`` lacks are NULL."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def schema_drift(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Compare two column catalogues ``(table_name, column_name, type)``.

    ``status`` is ``missing`` (declared only), ``added`` (observed only), ``retyped`` or ``same``.
    """
    on = ["table_name", "column_name"]
    d = declared.select(*on, F.col("type").alias("declared_type"))
    o = observed.select(*on, F.col("type").alias("observed_type"))
    return d.join(o, on, "full").withColumn(
        "status",
        F.when(F.col("observed_type").isNull(), "missing")
        .when(F.col("declared_type").isNull(), "added")
        .when(F.col("declared_type") != F.col("observed_type"), "retyped")
        .otherwise("same"))
