"""Writers: parquet, CSV, JSON lines, base-pair text, columnar CSV folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.functions.lineage import discard

ID_COLUMNS = ("pdbid", "model", "family", "accepted", "chain1", "res1", "nr1", "ins1", "alt1", "chain2", "res2", "nr2", "ins2", "alt2")


def write_pairs(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), compression: str | None = None) -> None:
    """Write in one of parquet, csv, tsv, jsonl, both (parquet and csv); ids and class first."""
    ordered = df.select(*[c for c in ID_COLUMNS if c in df.columns], *[c for c in df.columns if c not in ID_COLUMNS])
    targets = {"both": ("parquet", "csv")}.get(fmt, (fmt,))
    for t in targets:
        w = ordered.write.mode("overwrite").option("compression", compression or ("zstd" if t == "parquet" else "none"))
        if partition_by:
            w = w.partitionBy(*partition_by)
        to = f"{path}.{t}" if fmt == "both" else path
        if t == "parquet":
            w.parquet(to)
        elif t in ("csv", "tsv"):
            w.option("header", True).option("sep", "\t" if t == "tsv" else ",").csv(to)
        elif t == "jsonl":
            w.json(to)
        else:
            raise ValueError(f"unknown format: {fmt}")


def write_tsv_preview(df: DataFrame, path: str, order: list[str], rows: int = 1_000) -> None:
    """The first rows of a result as one TSV folder; a preview, so the limit is the feature."""
    df.orderBy(*order).limit(rows).coalesce(1).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def json_by_structure(df: DataFrame, key: str = "pdbid") -> DataFrame:
    """One JSON object text per structure with its rows, null fields left out."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rest)))).alias("json"))


def basepair_lines(df: DataFrame, detailed: bool = True, order_sensitive: tuple[str, ...] = (), once: bool = False, label: bool = False, columns: tuple[str, ...] = ()) -> DataFrame:
    """Tab-separated lines ``unit class unit``, by default two per pair, the second with the
    sides exchanged; column ``value``.

    Edge letters are written in upper case and in the same order on both lines.  With
    ``detailed``, classes (family-base-base, any case) of ``order_sensitive`` have a lower
    second edge, and the second line names the edges in its own order.  Without it near,
    variant and bifurcated classes (n..., ...a, ...B) are left out.  ``label`` appends MISSING
    or ADDED from the comparison flags, ``columns`` further values on the first line.
    """
    if not detailed:
        df = df.where(~F.col("family").startswith("n") & ~F.col("family").endswith("a") & ~F.col("family").endswith("B"))
    e = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    copy = lambda i: F.when(e(f"symmetry_operation{i}") != "", e(f"symmetry_operation{i}"))  # noqa: E731  a ninth part, for copies only
    unit = lambda i: F.concat_ws("|", F.upper("pdbid"), e("model"), e(f"chain{i}"), e(f"res{i}"), e(f"nr{i}"), F.lit(""), e(f"alt{i}"), e(f"ins{i}"), copy(i))
    part = lambda i: F.regexp_extract("family", "^(n?[ctCT])([WHSBwhsb])([WHSBwhsb])(.?)", i)
    plain = F.concat(part(1), F.upper(part(2)), F.upper(part(3)), part(4))
    kind = F.lower(F.concat_ws("-", "family", "res1", "res2"))
    ordered = kind.isin([x.lower() for x in order_sensitive]) if detailed and order_sensitive else F.lit(False)
    own = F.when(ordered, F.concat(part(1), F.upper(part(2)), F.lower(part(3)), part(4))).otherwise(plain)
    turned = F.when(ordered, F.concat(part(1), F.lower(part(3)), F.upper(part(2)), part(4))).otherwise(plain)
    flag = lambda c: F.coalesce(F.col(c), F.lit(True))
    told = [F.when(~flag("comparison_in_current"), "MISSING").when(~flag("comparison_in_baseline"), "ADDED").otherwise("")] if label else []
    first = F.concat_ws("\t", unit(1), own, unit(2), *told, *[e(c) for c in columns])
    second = F.concat_ws("\t", unit(2), turned, unit(1), *told, *[F.lit("") for _ in columns])
    return df.select(F.explode(F.array(first) if once else F.array(first, second)).alias("value"))


def write_columns(df: DataFrame, path: str, ids: list[str]) -> None:
    """Columnar CSV: one folder per number column and one with the ids.

    The frame is sorted once, by ids and then by all other columns, and written with the row
    place; every folder is cut from that copy and carries the place, so columns line up even
    where ids tie.  The copy goes in the end.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in ids]
    df.orderBy(*ids, *rest).withColumn("row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/_sorted")
    numbered = spark.read.parquet(f"{path}/_sorted")
    numbered.select("row", *ids).write.mode("overwrite").option("header", True).csv(f"{path}/id")
    for name, kind in df.dtypes:
        if kind in ("float", "double"):
            numbered.select("row", name).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    discard(spark, f"{path}/_sorted")
