"""Files in and out: readers that fix a schema once, versions of a table with lineage, and guarded SQL over views."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import content_hash
from .delimited import read_delimited as read_delimited

# Wrapper fields of JSON, and limits of a guarded table.
WRAPPERS = ("data", "records", "rows", "results", "items")
#: Built-in functions that reach outside a query's rows: into the JVM, the session or its files.
OUTSIDE = frozenset("current_catalog current_database current_schema current_user input_file_block_length input_file_block_start input_file_name java_method raise_error reflect session_user try_reflect user version".split())
MAX_ROWS, MAX_COLUMNS, MAX_CELL = 500_000, 250, 10_000


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv_strict(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header, typed by a schema or by inference."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def flatten(df: DataFrame) -> DataFrame:
    """Nested fields as columns with dotted names; arrays stay."""

    def paths(struct: T.StructType, prefix: tuple[str, ...] = ()):
        for f in struct.fields:
            if isinstance(f.dataType, T.StructType):
                yield from paths(f.dataType, (*prefix, f.name))
            else:
                yield (*prefix, f.name)

    return df.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in paths(df.schema)))


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON lines, an array of records, or records wrapped in a field such as data or items; nested fields are flattened."""
    df = spark.read.option("multiLine", not lines).json(path)
    for name in WRAPPERS:
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType) and isinstance(df.schema[name].dataType.elementType, T.StructType):
            return flatten(df.select(F.inline(name)))
    return flatten(df)


def register(df: DataFrame, name: str) -> None:
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"{name} is not a plain name")
    df.createOrReplaceTempView(name)


def strings_in(node) -> list[str]:
    """The items of a Scala sequence of strings."""
    return [node.apply(i) for i in range(node.size())]


def walk(plan):
    """Every node of a parsed plan: its children, the queries a WITH defines, and the queries inside its expressions."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        for kind in ("children", "innerChildren"):
            found = getattr(node, kind)()
            todo += [found.apply(i) for i in range(found.size())]
        expressions = node.expressions() if hasattr_java(node, "expressions") else None
        todo += [expressions.apply(i) for i in range(expressions.size())] if expressions is not None else []
        if node.getClass().getSimpleName() == "UnresolvedWith":
            named = node.cteRelations()
            todo += [named.apply(i)._2() for i in range(named.size())]
        if hasattr_java(node, "plan"):
            todo.append(node.plan())


def hasattr_java(node, name: str) -> bool:
    return any(m.getName() == name and m.getParameterCount() == 0 for m in node.getClass().getMethods())


def relations(spark: SparkSession, sql: str) -> tuple[set[str], set[str]]:
    """Names that a query reads and names that it defines itself (WITH), from Spark's parsed plan; nothing is run.

    Refused are statements that are no queries, table functions, and functions that leave the query: OUTSIDE and all that are not built in.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    read, defined = set(), set()
    built_in = {r["function"] for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()}
    for node in walk(plan):
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            read.add(".".join(strings_in(node.multipartIdentifier())).lower())
        elif kind == "UnresolvedWith":
            named = node.cteRelations()
            defined |= {named.apply(i)._1().lower() for i in range(named.size())}
        elif kind == "UnresolvedFunction":
            name = ".".join(strings_in(node.nameParts())).lower()
            if name in OUTSIDE or name not in built_in:
                raise PermissionError(f"the function {name} is not allowed")
        elif "TableValuedFunction" in kind or re.search(r"Command|Insert|Create|Drop|Alter|Delete|Update|Merge|Transform|Script|UnresolvedTable|UnresolvedTVF|Set\w*Statement", kind) and node.getClass().getName().startswith("org.apache.spark.sql.catalyst.plans") or kind in ("UnresolvedTable", "UnresolvedTVF"):
            raise PermissionError("only queries over registered views")
    return read, defined


def run_sql(spark: SparkSession, sql: str, views: Mapping[str, DataFrame], max_rows: int = 50_000) -> DataFrame:
    """A query over the given views only, at most max_rows rows, each with `is_truncated`.

    Spark parses the text; every relation of its plan must be one of the views or one that the query defines itself
    under a name that no other table or view has.
    """
    if not re.match(r"\s*(select|with)\b", sql, re.I):
        raise PermissionError("only one SELECT or WITH over registered views")
    for name, df in views.items():
        register(df, name)
    try:
        read, defined = relations(spark, sql)
    except ParseException as e:
        raise PermissionError("only one SELECT or WITH over registered views") from e
    known = {v.lower() for v in views}
    hidden = {n for n in defined - known if spark.catalog.tableExists(n)}
    if unknown := (read - defined - known) | hidden:
        raise PermissionError(f"not registered: {sorted(unknown)}")
    found = spark.sql(sql).limit(max_rows + 1)
    n = found.count()
    return found.limit(max_rows).withColumn("is_truncated", F.lit(n > max_rows))


def versions(spark: SparkSession, root: str) -> list[int]:
    """Version numbers of a dataset, from its lineage table."""
    try:
        lineage = spark.read.json(f"{root}/lineage")
    except Exception as e:  # the first version makes the table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return sorted(r["version"] for r in lineage.select("version").collect())


def write_version(df: DataFrame, root: str, recipe: list | None = None) -> int:
    """Write an immutable next version, and a lineage row with its content hash and recipe; returns its number.

    A version exists once its lineage row does. A folder without one, of a writer that was lost or is at work, is left alone
    and its number passed over.
    """
    spark = df.sparkSession
    number = max(versions(spark, root), default=0) + 1
    while True:
        try:
            df.write.mode("error").parquet(f"{root}/v={number}")
            break
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
            number += 1
    facts = content_hash(spark.read.parquet(f"{root}/v={number}"))
    facts.select(F.lit(number).alias("version"), "rows", "sha256", F.lit(json.dumps(recipe or [])).alias("recipe")).coalesce(1).write.mode("append").json(f"{root}/lineage")
    return number


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of a dataset, by default the last."""
    return spark.read.parquet(f"{root}/v={version or max(versions(spark, root))}")


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    return df.limit(n)


def resource_guard(df: DataFrame, max_rows: int = MAX_ROWS, max_columns: int = MAX_COLUMNS, max_cell: int = MAX_CELL) -> DataFrame:
    """rows, columns, longest cell and whether a table is within the limits, from one aggregate."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    longest = F.greatest(F.lit(0), *(F.coalesce(F.max(F.length(f"`{c}`")), F.lit(0)) for c in texts)) if texts else F.lit(0)
    facts = df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), longest.alias("longest_cell"))
    return facts.withColumn("within_limits", (F.col("rows") <= max_rows) & (F.col("columns") <= max_columns) & (F.col("longest_cell") <= max_cell))


def watch_inbox(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame, int], None], checkpoint: str, file_format: str = "csv"):
    """Run work once on every new file of a folder; the stream's checkpoint remembers the files seen."""
    stream = spark.readStream.format(file_format).schema(schema).option("header", True).load(folder)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
