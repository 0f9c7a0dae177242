"""Federated queries: the inner query runs whole in the remote database, over JDBC."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import Invalid, NotFound
from ..session import is_local, shared_folder

#: Databases that live in the process that opened them, here the driver's: an executor finds an empty one or a lock.
_IN_PROCESS = re.compile(r"jdbc:(derby:(?!//)|h2:(?!tcp:|ssl:)|hsqldb:(mem|file|res):)")
#: Rows that the driver holds at a time of such a database.
ROWS_AT_ONCE = 50_000


@dataclass
class Connection:
    url: str
    options: dict[str, str] = field(default_factory=dict)


class External:
    def __init__(self, spark: SparkSession, connections: dict[str, Connection] | None = None):
        self.spark, self.connections = spark, dict(connections or {})

    def query(self, connection: str, sql: str) -> DataFrame:
        if connection not in self.connections:
            raise NotFound(f"Not found: Connection {connection}")
        text = sql.strip().rstrip(";").strip()
        if not text or ";" in re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*", "", text):
            raise Invalid("EXTERNAL_QUERY takes exactly one statement")
        c = self.connections[connection]
        df = self.spark.read.format("jdbc").option("url", c.url).options(**c.options).option("query", text).load()
        return df if is_local(self.spark) or not _IN_PROCESS.match(c.url) else self._by_driver(df, c, text)

    def _by_driver(self, df: DataFrame, c: Connection, text: str) -> DataFrame:
        """The result of the inner query as Parquet in the shared folder, read by the driver a part at a time."""
        jvm, out = self.spark.sparkContext._jvm, f"{shared_folder(self.spark)}/external-{uuid.uuid4().hex}"
        schema = df._jdf.schema()
        jdbc = jvm.org.apache.spark.sql.execution.datasources.jdbc
        options = jdbc.JDBCOptions(jvm.PythonUtils.toScalaMap({**c.options, "url": c.url, "query": text}))
        connection = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(c.url).createConnectionFactory(options).apply(-1)
        try:
            rows = jdbc.JdbcUtils.resultSetToRows(connection.createStatement().executeQuery(text), schema)
            df.limit(0).write.parquet(out)  # no rows are a result, too
            parts = rows.grouped(ROWS_AT_ONCE)
            while parts.hasNext():
                part = jvm.scala.collection.JavaConverters.seqAsJavaList(parts.next())
                DataFrame(self.spark._jsparkSession.createDataFrame(part, schema), self.spark).write.mode("append").parquet(out)
        finally:
            connection.close()
        return self.spark.read.schema(df.schema).parquet(out)
