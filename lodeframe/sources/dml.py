"""INSERT, UPDATE and DELETE as new snapshots, with the table's constraints."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnalysisError, ConstraintError
from ..functions import scalar as S
from ..functions.types import NUMERIC
from ..plans.builder import Builder, Relation, Scope
from ..plans.parser import parse_expression
from .catalog import FILE, Catalog, Table


def fitting(x: S.Typed, kind: str) -> Column:
    """A value as a column stores it: numbers convert among each other, anything to timestamps and text."""
    col, of = x
    if of == kind:
        return col
    if of == "NULL":
        return S.null(kind)
    if kind in ("TIMESTAMP", "VARCHAR") or {of, kind} <= {*NUMERIC, "BOOL"}:
        return S.cast(x, kind)[0]
    raise AnalysisError(f"a {of} value doesn't fit a {kind} column")


def check(builder: Builder, table: Table, df: DataFrame) -> None:
    """Raise for rows that violate NOT NULL, a text length in bytes, or a CHECK (only FALSE violates); one pass finds the first."""
    builder = Builder(builder.spark, builder.table, strict=False)  # a CHECK may be a number, true unless 0
    rel = builder.relation(df, table.name, df.columns, [c["kind"] for c in table.columns])
    scope, bad = Scope(rel.fields), []
    for f, c in zip(rel.fields, table.columns):
        col = F.col(f"`{f.inner}`")
        if c["not_null"]:
            bad.append((col.isNull(), f"NULL in column '{c['name']}' of table '{table.name}'"))
        if c["varchar_length"] is not None:
            bad.append((F.octet_length(col) > c["varchar_length"], f"value too long for column '{c['name']}'"))
        if c["check"]:
            holds = builder.boolean(builder.expr(parse_expression(c["check"]), scope), "CHECK")
            bad.append((~holds, f"CHECK ({c['check']}) of column '{c['name']}' fails"))
    if not bad:
        return
    which = F
    for k, (cond, _) in enumerate(bad):
        which = which.when(cond, F.lit(k))
    row = rel.df.select(which.alias("k")).where("k is not null").limit(1).collect()
    if row:
        raise ConstraintError(bad[row[0]["k"]][1])


def insert(catalog: Catalog, builder: Builder, table: Table, columns, rows) -> int:
    """Append the rows of a VALUES list; rows that repeat a unique key are skipped. Returns how many went in."""
    names = [c["name"] for c in table.columns]
    columns = list(columns or names)
    for c in columns:
        table.column(c)
    one = builder.spark.range(1)
    built = []
    for k, row in enumerate(rows):
        if len(row) != len(columns):
            raise AnalysisError(f"INSERT has {len(row)} values for {len(columns)} columns")
        given = dict(zip(columns, row))
        cols = []
        for c in table.columns:
            if c["name"] in given:
                typed = builder.expr(given[c["name"]], Scope([]))
                col = fitting(typed, c["kind"])
                if c["kind"] == "TIMESTAMP" and typed[1] != "TIMESTAMP":
                    col = F.when(typed[0].isNull() | col.isNotNull(), col).otherwise(F.raise_error(F.lit(f"not a timestamp in column '{c['name']}'")))
            else:
                col = catalog.default(c)
            cols.append(col.alias(c["name"]))
        built.append(F.struct(*cols))
    batch = one.select(F.posexplode(F.array(*built)).alias("_at", "_row")).select("_row.*")
    # a statement's rows are text: they are small, and the driver already holds them
    try:
        values = batch.collect()
    except Exception as e:
        if "not a timestamp" in str(e):
            raise ConstraintError("not a timestamp") from e
        raise
    schema = batch.schema
    df = builder.spark.createDataFrame(values, schema)
    check(builder, table, df)
    keep = list(range(len(values)))
    keys = table.unique_keys()
    if keys:
        seen: list[set] = []
        current = catalog.read(table)
        for key in keys:
            wanted = builder.spark.createDataFrame([tuple(v[c] for c in key) for v in values if all(v[c] is not None for c in key)] or [], schema=df.select(*key).schema).distinct()
            seen.append({tuple(r) for r in current.select(*key).join(F.broadcast(wanted), key, "left_semi").collect()})
        keep = []
        for i, v in enumerate(values):
            own = [tuple(v[c] for c in key) for key in keys]
            if any(k in s for k, s in zip(own, seen) if None not in k):
                continue
            keep.append(i)
            for k, s in zip(own, seen):
                if None not in k:
                    s.add(k)
    if keep:
        table.meta["parts"].append(catalog.write(table, builder.spark.createDataFrame([values[i] for i in keep], schema).coalesce(1)))
    table.meta["version"] += 1
    table.meta["rows"] += len(keep)
    return len(keep)


def _touched(catalog: Catalog, builder: Builder, table: Table, where) -> tuple[int, set]:
    """Number of rows that a condition hits, and the files (part, name) that hold them."""
    rel, hit = _scanned(builder, table, catalog.read(table, with_file=True), where)
    file = F.col(f"`{rel.fields[-1].inner}`")
    found = rel.df.where(hit).groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()
    return sum(r["n"] for r in found), {(f"{table_dir}/{part}", name) for table_dir, part, name in (r["file"].rsplit("/", 3)[1:] for r in found)}


def _scanned(builder: Builder, table: Table, df: DataFrame, where) -> tuple[Relation, Column]:
    """A table's rows in scope, and the condition that a row is hit: never NULL."""
    kinds = [c["kind"] for c in table.columns] + ["VARCHAR"] * (FILE in df.columns)
    rel = builder.relation(df, table.name, df.columns, kinds)
    if where is None:
        return rel, F.lit(True)
    return rel, F.coalesce(builder.condition(where, Scope(rel.fields), "WHERE"), F.lit(False))


def update(catalog: Catalog, builder: Builder, table: Table, sets, where) -> int:
    """Rewrite the files that hold hit rows; every right side sees the old row.

    Rows whose new unique key is another row's are left as they were.
    """
    for name, _ in sets:
        table.column(name)
    n, files = _touched(catalog, builder, table, where)
    rel, hit = _scanned(builder, table, catalog.read(table, only=files), where)
    old = {f.name: F.col(f"`{f.inner}`") for f in rel.fields}
    new = {name: fitting(builder.expr(expr, Scope(rel.fields)), table.column(name)["kind"]) for name, expr in sets}
    if not n:
        return 0
    rows = rel.df.select(hit.alias("_hit"), *[c.alias(f"old#{k}") for k, c in old.items()], *[new.get(k, c).alias(f"new#{k}") for k, c in old.items()])
    check(builder, table, rows.where("_hit").select(*[F.col(f"`new#{k}`").alias(k) for k in old]))
    keys = [k for k in table.unique_keys() if set(k) & set(new)]
    if keys:
        # row numbers must not change between reads, so the rows are written; VACUUM takes the folder
        path = f"{catalog.root}/{table.name}/{uuid.uuid4().hex}"
        rows.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
        rows, rest = catalog.spark.read.parquet(path), catalog.read(table, but=files)
        for key in keys:
            rows = _unconflicted(rows, rest, key)
        n = rows.where("_hit").count()
    if n:
        final = rows.select(*[F.when(F.col("_hit"), F.col(f"`new#{k}`")).otherwise(F.col(f"`old#{k}`")).alias(k) for k in old])
        part = catalog.write(table, final)
        catalog.remove(table, files)
        table.meta["parts"].append(part)
        table.meta["version"] += 1
    return n


def _unconflicted(rows: DataFrame, rest: DataFrame, key: list[str]) -> DataFrame:
    """Clear ``_hit`` where the new key is the key of another row, or an earlier changed row's new key."""
    old = [F.col(f"`old#{k}`") for k in key]
    new = [F.col(f"`new#{k}`") for k in key]
    same = F.lit(True)
    for a, b in zip(old, new):
        same = same & a.eqNullSafe(b)
    moved = F.col("_hit") & ~same
    held = rows.select(*[c.alias(f"held{i}") for i, c in enumerate(old)], F.col("_id").alias("_other"))
    held = held.unionByName(rest.select(*[F.col(f"`{k}`").alias(f"held{i}") for i, k in enumerate(key)], F.lit(-1).cast("long").alias("_other")))
    cond = F.col("_id") != F.col("_other")
    for i, c in enumerate(new):
        cond = cond & (c == F.col(f"held{i}"))
    taken = rows.where(moved).join(held, cond, "left_semi").select(F.col("_id").alias("_bad"))
    full = F.lit(True)
    for c in new:
        full = full & c.isNotNull()
    order = F.row_number().over(Window.partitionBy(*new).orderBy("_id"))
    late = rows.where(moved & full).withColumn("_n", order).where("_n > 1").select(F.col("_id").alias("_bad"))
    bad = taken.unionByName(late).distinct()
    return rows.join(bad, F.col("_id") == F.col("_bad"), "left").withColumn("_hit", F.col("_hit") & F.col("_bad").isNull()).drop("_bad")


def delete(catalog: Catalog, builder: Builder, table: Table, where) -> int:
    """Rewrite the files that hold hit rows without them; without a condition all files go."""
    n, files = _touched(catalog, builder, table, where)
    if n:
        if where is None:
            table.meta["parts"] = []
        else:
            rel, hit = _scanned(builder, table, catalog.read(table, only=files), where)
            part = catalog.write(table, rel.df.where(~hit).toDF(*[f.name for f in rel.fields]))
            catalog.remove(table, files)
            table.meta["parts"].append(part)
        table.meta["version"] += 1
        table.meta["rows"] = max(0, table.meta["rows"] - n)
    return n
