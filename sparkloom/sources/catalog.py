"""Projects, datasets and tables over Spark's session catalog.

A table's files lie in a folder of their own below the data directory; a statement
that rewrites a table writes a new folder and then points the table to it.  What Spark
does not keep (REQUIRED, descriptions, defaults) is in one JSON file a dataset, from
which tables are registered again in a new session.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AlreadyExists, Invalid, NotFound
from ..functions.types import rest_field, struct_type
from .files import Files
from .names import Scope, database, decode, encode, quote, undatabase


def default_root(spark: SparkSession) -> str:
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/sparkloom"


class Catalog:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.files = Files(spark, root or default_root(spark))
        self._meta: dict[str, dict] = {}
        for name in self.files.list("meta"):
            if name.endswith(".json"):
                self._restore(name[:-5])

    # ------------------------------------------------------------- metadata
    def _restore(self, db: str) -> None:
        meta = self.files.read_json(f"meta/{db}.json")
        self._meta[db] = meta
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {quote(db)}")
        for t, m in meta["tables"].items():
            if m.get("location") and not self.spark.catalog.tableExists(f"{quote(db)}.{quote(t)}"):
                self._register(db, t, m)
        for t, m in meta["tables"].items():
            if m.get("view"):
                self.spark.sql(f"CREATE OR REPLACE VIEW {quote(db, t)} AS {m['view']}")

    def _save(self, db: str) -> None:
        self.files.write_json(f"meta/{db}.json", self._meta[db])

    def meta(self, project: str, dataset: str) -> dict:
        db = database(project, dataset)
        if db not in self._meta:
            raise NotFound(f"Not found: Dataset {project}:{dataset}")
        return self._meta[db]

    # ------------------------------------------------------------- datasets
    def projects(self) -> list[str]:
        return sorted({undatabase(db)[0] for db in self._meta if undatabase(db)})  # type: ignore[index]

    def datasets(self, project: str) -> list[str]:
        pairs = (undatabase(db) for db in self._meta)
        return sorted(d for p, d in filter(None, pairs) if p == project)

    def has_dataset(self, project: str, dataset: str) -> bool:
        return database(project, dataset) in self._meta

    def create_dataset(self, project: str, dataset: str, info: dict | None = None, exists_ok: bool = False) -> dict:
        db = database(project, dataset)
        if db in self._meta:
            if exists_ok:
                return self._meta[db]["dataset"]
            raise AlreadyExists(f"Already Exists: Dataset {project}:{dataset}")
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {quote(db)}")
        self._meta[db] = {"dataset": info or {}, "tables": {}, "routines": {}}
        self._save(db)
        return self._meta[db]["dataset"]

    def get_dataset(self, project: str, dataset: str) -> dict:
        return self.meta(project, dataset)["dataset"]

    def update_dataset(self, project: str, dataset: str, info: dict, merge: bool) -> dict:
        meta = self.meta(project, dataset)
        meta["dataset"] = {**meta["dataset"], **info} if merge else info
        self._save(database(project, dataset))
        return meta["dataset"]

    def delete_dataset(self, project: str, dataset: str, missing_ok: bool = False, cascade: bool = True) -> None:
        db = database(project, dataset)
        if db not in self._meta:
            if missing_ok:
                return
            raise NotFound(f"Not found: Dataset {project}:{dataset}")
        if not cascade and self._meta[db]["tables"]:
            raise Invalid(f"Dataset {project}:{dataset} is still in use")
        self.spark.sql(f"DROP DATABASE IF EXISTS {quote(db)} CASCADE")
        del self._meta[db]
        self.files.delete(f"meta/{db}.json")
        self.files.delete(f"data/{db}")

    def reset(self) -> None:
        """Drops everything."""
        for db in list(self._meta):
            self.delete_dataset(*undatabase(db))  # type: ignore[misc]

    # --------------------------------------------------------------- tables
    def tables(self, project: str, dataset: str) -> list[str]:
        return sorted(decode(t) for t in self.meta(project, dataset)["tables"])

    def exists(self, name: tuple[str, str, str]) -> bool:
        p, d, t = name
        return encode(t) in self._meta.get(database(p, d), {}).get("tables", {})

    def info(self, name: tuple[str, str, str]) -> dict:
        p, d, t = name
        m = self.meta(p, d)["tables"].get(encode(t))
        if m is None:
            raise NotFound(f"Not found: Table {p}:{d}.{t}")
        return m

    def table(self, name: tuple[str, str, str]) -> DataFrame:
        self.info(name)
        return self.spark.table(Scope().table(list(name)))

    def ident(self, name: tuple[str, str, str]) -> str:
        return Scope().table(list(name))

    def _register(self, db: str, t: str, m: dict) -> None:
        schema = T.StructType.fromJson(m["spark"])
        part = f" PARTITIONED BY ({', '.join(quote(c) for c in m['partition'])})" if m.get("partition") else ""
        cols = ", ".join(f"{quote(f.name)} {ddl(f.dataType)}" for f in schema.fields)
        self.spark.sql(f"CREATE TABLE {quote(db, t)} ({cols}) USING parquet{part} LOCATION '{m['location']}'")
        if m.get("partition") and self.files.list(m["location"]):
            self.spark.sql(f"MSCK REPAIR TABLE {quote(db, t)}")

    def _location(self, db: str, t: str) -> str:
        return f"{self.files.root}/data/{db}/{t}/{uuid.uuid4().hex}"

    def create_table(self, name: tuple[str, str, str], schema: T.StructType, *, required: list[str] = (), partition: list[str] = (), cluster: list[str] = (), defaults: dict[str, str] | None = None, info: dict | None = None, exists_ok: bool = False, replace: bool = False, temp: bool = False) -> None:
        p, d, t = name
        db, key = database(p, d), encode(t)
        meta = self.meta(p, d)
        if key in meta["tables"]:
            if exists_ok:
                return
            if not replace:
                raise AlreadyExists(f"Already Exists: Table {p}:{d}.{t}")
            self.drop(name)
        order = [f for f in schema.fields if f.name not in partition] + [f for c in partition for f in schema.fields if f.name == c]
        m = {"spark": T.StructType(order).jsonValue(), "location": self._location(db, key), "required": list(required), "partition": list(partition), "cluster": list(cluster), "defaults": defaults or {}, "info": info or {}}
        self._register(db, key, m)
        meta["tables"][key] = m
        self._save(db)

    def create_from_rest(self, project: str, dataset: str, table: str, resource: dict, exists_ok: bool = False) -> None:
        fields = (resource.get("schema") or {}).get("fields") or []
        required = [f["name"] for f in fields if (f.get("mode") or "").upper() == "REQUIRED"]
        part = resource.get("timePartitioning") or resource.get("rangePartitioning") or {}
        schema = struct_type(fields)
        # Parquet tables partition by value: only date and integer columns are taken as they are
        keep = [part["field"]] if part.get("field") and isinstance({f.name: f.dataType for f in schema.fields}.get(part["field"]), (T.DateType, T.LongType)) and len(fields) > 1 else []
        defaults = {f["name"]: f["defaultValueExpression"] for f in fields if f.get("defaultValueExpression")}
        self.create_table((project, dataset, table), schema, required=required, partition=keep, cluster=(resource.get("clustering") or {}).get("fields") or [], defaults=defaults, info=resource, exists_ok=exists_ok)

    def create_view(self, name: tuple[str, str, str], sql: str, info: dict | None = None, replace: bool = False, exists_ok: bool = False) -> None:
        p, d, t = name
        meta, key = self.meta(p, d), encode(t)
        if key in meta["tables"] and exists_ok:
            return
        if key in meta["tables"] and not replace:
            raise AlreadyExists(f"Already Exists: Table {p}:{d}.{t}")
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.ident(name)} AS {sql}")
        meta["tables"][key] = {"view": sql, "info": info or {}, "required": [], "partition": [], "cluster": [], "defaults": {}}
        self._save(database(p, d))

    def drop(self, name: tuple[str, str, str], missing_ok: bool = False) -> None:
        p, d, t = name
        if not self.exists(name):
            if missing_ok:
                return
            raise NotFound(f"Not found: Table {p}:{d}.{t}")
        m = self.info(name)
        self.spark.sql(f"DROP {'VIEW' if 'view' in m else 'TABLE'} IF EXISTS {self.ident(name)}")
        if m.get("location"):
            self.files.delete(f"data/{database(p, d)}/{encode(t)}")
        del self.meta(p, d)["tables"][encode(t)]
        self._save(database(p, d))

    def schema(self, name: tuple[str, str, str]) -> T.StructType:
        return self.table(name).schema

    def rest_table(self, name: tuple[str, str, str]) -> dict:
        m = self.info(name)
        fields = [rest_field(f.name, f.dataType) for f in self.schema(name).fields]
        given = {f["name"]: f for f in (m["info"].get("schema") or {}).get("fields") or []}
        for f in fields:
            if f["name"] in m["required"]:
                f["mode"] = "REQUIRED"
            f |= {k: v for k, v in given.get(f["name"], {}).items() if k in ("description", "policyTags", "maxLength", "defaultValueExpression")}
        return {**m["info"], "schema": {"fields": fields}, "type": "MATERIALIZED_VIEW" if "materializedView" in m["info"] else "VIEW" if "view" in m else "TABLE"}

    def patch_table(self, name: tuple[str, str, str], resource: dict, merge: bool) -> None:
        """New description, labels and the like; columns may be added at the end."""
        m = self.info(name)
        fields = (resource.get("schema") or {}).get("fields")
        if fields:
            have = {f.name.lower() for f in self.schema(name).fields}
            new = [f for f in fields if f["name"].lower() not in have]
            if have - {f["name"].lower() for f in fields}:
                raise Invalid("Provided schema does not match: columns cannot be removed")
            if new:
                self.add_columns(name, struct_type(new))
        m["info"] = {**m["info"], **resource} if merge else resource
        self._save(database(*name[:2]))

    def add_columns(self, name: tuple[str, str, str], schema: T.StructType) -> None:
        self.spark.sql(f"ALTER TABLE {self.ident(name)} ADD COLUMNS ({', '.join(f'{quote(f.name)} {ddl(f.dataType)}' for f in schema.fields)})")
        self._remember(name)

    def _remember(self, name: tuple[str, str, str]) -> None:
        self.info(name)["spark"] = self.schema(name).jsonValue()
        self._save(database(*name[:2]))

    def rename(self, name: tuple[str, str, str], new: tuple[str, str, str]) -> None:
        if self.exists(new):
            raise AlreadyExists(f"Already Exists: Table {':'.join(new[:2])}.{new[2]}")
        self.spark.sql(f"ALTER TABLE {self.ident(name)} RENAME TO {self.ident(new)}")
        meta = self.meta(*name[:2])
        meta["tables"][encode(new[2])] = meta["tables"].pop(encode(name[2]))
        self._save(database(*name[:2]))

    # ------------------------------------------------------------- routines
    def routines(self) -> list[tuple[str, str, str]]:
        """(text, project, dataset in force) of the persistent routines."""
        return [tuple(r) for meta in self._meta.values() for r in meta.get("routines", {}).values()]

    def save_routine(self, name: tuple[str, str, str], text: str, scope: Scope) -> None:
        """Keeps a routine's statement for later sessions, if its dataset exists."""
        db = database(*name[:2])
        if db in self._meta:
            self._meta[db].setdefault("routines", {})[name[2].lower()] = [text, scope.project, scope.dataset]
            self._save(db)

    def drop_routine(self, name: tuple[str, str, str]) -> None:
        db = database(*name[:2])
        if self._meta.get(db, {}).get("routines", {}).pop(name[2].lower(), None):
            self._save(db)

    # --------------------------------------------------------------- writes
    def checked(self, name: tuple[str, str, str], df: DataFrame) -> DataFrame:
        """``df`` with a failure in place of a null in a REQUIRED column; Parquet tables do not check."""
        for c in self.info(name)["required"]:
            message = F.lit(f"Required field {c} cannot be null")
            if c in df.columns:
                kind = df.schema[c].dataType
                df = df.withColumn(c, F.when(F.col(quote(c)).isNull(), F.raise_error(message).cast(kind)).otherwise(F.col(quote(c))))
        return df

    def append(self, name: tuple[str, str, str], df: DataFrame) -> None:
        """Adds rows; ``df`` has the table's columns in order."""
        self.checked(name, df).write.insertInto(self.ident(name))

    def replace(self, name: tuple[str, str, str], df: DataFrame, changed: Callable[[], int] | None = None) -> int | None:
        """New contents, also if ``df`` reads the table: a new folder, to which the table is then pointed.

        ``changed`` counts the rows that differ, once they are written; if none do, the
        table stays as it is.
        """
        p, d, t = name
        m, db, key = self.info(name), database(p, d), encode(t)
        old, new = m["location"], self._location(db, key)
        df = self.checked(name, df)
        order = [f.name for f in df.schema.fields if f.name not in m["partition"]] + m["partition"]
        w = df.select([quote(c) for c in order]).write
        (w.partitionBy(*m["partition"]) if m["partition"] else w).parquet(new)
        n = changed() if changed else None
        if n == 0:
            self.files.delete(new)
            return n
        m["location"], m["spark"] = new, T.StructType([df.schema[c] for c in order]).jsonValue()
        self.spark.sql(f"DROP TABLE {self.ident(name)}")
        self._register(db, key, m)
        self._save(db)
        self.files.delete(old)
        return n

    def wildcard(self, parts: list[str], scope: Scope) -> list[tuple[str, tuple[str, str, str]]]:
        """(suffix, table) of the tables that begin with the last part."""
        p, d, prefix = scope.resolve(parts)
        names = self.tables(p, d)
        return [(t[len(prefix) :], (p, d, t)) for t in names if t.startswith(prefix)]


def ddl(t: T.DataType) -> str:
    """DDL of a type, field names quoted."""
    match t:
        case T.StructType():
            return "STRUCT<" + ", ".join(f"{quote(f.name)}: {ddl(f.dataType)}" for f in t.fields) + ">"
        case T.ArrayType():
            return f"ARRAY<{ddl(t.elementType)}>"
        case T.MapType():
            return f"MAP<{ddl(t.keyType)}, {ddl(t.valueType)}>"
        case T.NullType():
            return "BIGINT"
    return re.sub(r"interval .*", "STRING", t.simpleString())
