"""Jobs over a statement log, replay of statements, and statement batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import statements as S
from tidemark.sources.files import try_read
from tidemark.sources.jdbc import JdbcHot

TOP = 50  # fixed value: statements kept per poll
SEEN = "query string, poll long"


def profile(log: DataFrame) -> DataFrame:
    """The log with class, tables, parameter count, normalised text and route."""
    q = F.col("query")
    return log.select(
        "*",
        S.statement_class(q).alias("class"),
        S.tables_referenced(q).alias("tables"),
        S.parameter_count(q).alias("params"),
        S.positional(S.strip(q)).alias("normalized"),
        S.route(q).alias("route"),
    )


def top_statements(log: DataFrame, n: int = TOP) -> DataFrame:
    """Of the ``n`` most-called statements that mention the tables of interest, those that are
    workload: control statements count among the ``n``, and go after that."""
    q = F.col("query")
    top = log.where(S.mentions(q)).groupBy("query").agg(F.sum("calls").alias("calls")).orderBy(
        F.desc("calls"), "query").limit(n)
    return top.where(S.is_workload(q))


def unseen(log: DataFrame, seen: DataFrame) -> DataFrame:
    """Statements of this poll that no earlier poll had, once each."""
    return log.select("query").distinct().join(seen.select("query").distinct(), "query",
                                               "left_anti")


def take_unseen(log: DataFrame, path: str, poll: int) -> DataFrame:
    """Statements that no earlier poll of the table at ``path`` had, which now has them too.

    A poll is known by its number and its own partition. One that failed, before or after its
    statements were stored, is run again under the same number and gives the same statements:
    only lower numbers count as seen, and the partition is replaced.
    """
    spark = log.sparkSession
    seen = try_read(spark, path, SEEN)
    new = log.select("query").distinct() if seen is None else unseen(log, seen.where(F.col("poll") < poll))
    new.write.mode("overwrite").parquet(f"{path}/poll={poll}")
    return spark.read.schema("query string").parquet(f"{path}/poll={poll}").select("query")


def replay(spark: SparkSession, top: DataFrame) -> list[dict]:
    """Run the reads of a list (see :func:`top_statements`), all of it, with dummy arguments.

    Statements run over the registered hybrid views; one that fails is reported and the rest go
    on. Writes and locking reads belong to the hot tier and are not run here.
    """
    q = F.col("query")
    todo = top.select("query", S.positional(S.strip(q)).alias("text"), S.route(q).alias("route"),
                      S.parameter_count(q).alias("params")).collect()
    report = []
    for row in todo:
        entry = {"query": row["query"], "route": row.route, "rows": None, "error": None}
        if row.route == "hybrid":
            try:
                entry["rows"] = spark.sql(row.text, args=[1] * row.params).count()
            except Exception as error:  # noqa: BLE001 - reported per statement
                entry["error"] = str(error).splitlines()[0]
        report.append(entry)
    return report


def validate_batch(batch: object) -> list[tuple[str, list]]:
    """A batch is a list of ``[statement, arguments]`` pairs."""
    if not isinstance(batch, list):
        raise ValueError("a batch is a list")
    for i, item in enumerate(batch):
        if not (isinstance(item, (list, tuple)) and len(item) == 2
                and isinstance(item[0], str) and isinstance(item[1], list)):
            raise ValueError(f"item {i} is not [statement, arguments]")
    return [(sql, args) for sql, args in batch]


def classify(spark: SparkSession, texts: Sequence[str]) -> list[str]:
    """Routes of a few statements, by the same expressions that profile a log."""
    if not texts:
        return []
    q = F.col("query")
    rows = (spark.createDataFrame(list(enumerate(texts)), "i int, query string")
            .select("i", S.route(q).alias("route"), S.statement_class(q).alias("class"))
            .orderBy("i").collect())
    return ["hot-read" if r["class"] == "OLAP" and r.route == "hot" else r.route for r in rows]


def run_statements(spark: SparkSession, hot: JdbcHot, batch: object) -> dict:
    """A statement batch, all or nothing: writes in one hot transaction, reads on the views.

    Reads see what was committed before the batch. A locking read runs in the transaction and
    adds no result. On any error the transaction is rolled back and the report says why.
    """
    results: list[dict] = []

    def run(tx, sql: str, args: list, route: str) -> dict | None:
        if route == "hybrid":
            return {"type": "olap", "rows": spark.sql(sql, args=args).count()}
        if route not in ("hot", "hot-read"):
            raise ValueError(f"cannot tell where to run {sql!r}")
        affected = tx.execute(sql, args)[1]
        return {"type": "write", "affected": affected} if route == "hot" else None

    try:
        statements = validate_batch(batch)
        routes = classify(spark, [sql for sql, _ in statements])
        with hot.transaction() as tx:
            for i, ((sql, args), route) in enumerate(zip(statements, routes, strict=True)):
                if done := run(tx, sql, args, route):
                    results.append({"index": i, **done})
    except Exception as error:  # noqa: BLE001 - the report carries it
        return {"status": "error", "message": str(error), "executed": len(results),
                "results": results}
    return {"status": "ok", "executed": len(results), "results": results}
