"""Views on demand: SQL text over logical table names, found in Spark's parsed plan."""

from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions.scalars import pair_id

#: File names of a class's tables, by the suffix of the logical name.
SUFFIXES = {"": "{}", "_f": "{}-filtered", "_n": "n{}", "_allcontacts": "{}-allcontacts", "_allcontacts_f": "{}-filtered-allcontacts"}
CLASS_NAME = re.compile(r"^n?[ct][WHSBwhsb]{2}a?-[ACGU]-[ACGU]$")
#: The eight data sources as relations over the selected class; near pairs join by name.
SOURCES = {
    "fr3d": "select * from selectedpair",
    "fr3d-f": "select * from selectedpair_f",
    "fr3d-n": ("selectedpair", "selectedpair_n"),
    "fr3d-nf": ("selectedpair_f", "select * from selectedpair_n where accepted"),
    "allcontacts": "select * from selectedpair_allcontacts",
    "allcontacts-f": "select * from selectedpair_allcontacts_f",
    "allcontacts-boundaries": "select * from selectedpair_allcontacts_boundaries",
    "allcontacts-boundaries-f": "select * from selectedpair_allcontacts_boundaries_f",
}


class Catalog:
    """Resolves logical names to frames; a query's own text is never changed.

    Names, in the order they are tried: frames of ``add``; views of ``define``, SQL text over other
    names; ``selectedpair<suffix>`` and class names with a suffix, files under the root; the
    same with ``_boundaries`` before a final ``_f`` or at the end, that table through ``boundaries``;
    a ``*`` pattern or a comma list of class names, their files as one table with ``class_name``.
    A name that leads back to itself is an error.
    """

    def __init__(self, spark: SparkSession, root: str, selected: str | None = None, boundaries: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.root, self.selected, self.boundaries = spark, root.rstrip("/"), selected, boundaries
        self.extra: dict[str, DataFrame] = {}
        self.views: dict[str, str] = {}
        self.open: list[str] = []

    def add(self, name: str, df: DataFrame) -> None:
        """A table under a name of its own."""
        self.extra[name] = df

    def define(self, name: str, text: str) -> None:
        """A view that depends on other names; it is read anew in every query that names it."""
        self.views[name] = text

    def resolve(self, name: str) -> DataFrame | None:
        """The frame behind a logical name, None if it is not one of ours."""
        if name in self.extra:
            return self.extra[name]
        if name in self.open:
            raise ValueError(" -> ".join([*self.open, name]) + " is a cycle")
        self.open.append(name)
        try:
            if name in self.views:
                return self.sql(self.views[name])
            if "_boundaries" in name and self.boundaries is not None:
                base = self.resolve(name.replace("_boundaries", "", 1))
                return None if base is None else self.boundaries(base)
            if "*" in name or "," in name:
                return self.many(name)
            return self.file(name)
        finally:
            self.open.pop()

    def file(self, name: str) -> DataFrame | None:
        """The file of ``selectedpair`` or of a class, with the suffix of the name."""
        for suffix in sorted(SUFFIXES, key=len, reverse=True):
            for sep in (suffix, suffix.replace("_", "-")):
                if sep and not name.endswith(sep):
                    continue
                stem = name[: len(name) - len(sep)] if sep else name
                pair = self.selected if stem == "selectedpair" else stem
                if pair and CLASS_NAME.match(pair):
                    return self.pairs(f"{self.root}/{SUFFIXES[suffix].format(pair)}.parquet")
        return None

    def many(self, names: str) -> DataFrame | None:
        """The files of a comma list of class names, in which ``*`` stands for any text, by name, each once."""
        found: dict[str, None] = {}
        for item in (x.strip() for x in names.split(",")):
            found |= dict.fromkeys(self.listed(item) if "*" in item else [item])
        parts = [(n, self.file(n)) for n in found]
        if lacking := [n for n, df in parts if df is None]:
            raise ValueError(f"no such classes: {lacking}")
        frames = [df.withColumn("class_name", F.lit(n)) for n, df in parts]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None

    def listed(self, pattern: str) -> list[str]:
        """Class names whose plain files fit a pattern, in order."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}.parquet")
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where) or []
        return sorted(n for n in (str(s.getPath().getName()).removesuffix(".parquet") for s in there) if CLASS_NAME.match(n))

    def pairs(self, path: str) -> DataFrame:
        """A pair file with its ``pairid``."""
        df = self.spark.read.parquet(path)
        need = {"pdbid", "model", "chain1", "alt1", "nr1", "ins1", "chain2", "alt2", "nr2", "ins2"}
        if "pairid" in df.columns or not need <= set(df.columns):
            return df
        return df.withColumn("pairid", pair_id(F.col("pdbid"), F.col("model"), [tuple(F.col(f"{p}{i}") for p in ("chain", "alt", "nr", "ins")) for i in (1, 2)]))

    def source(self, name: str) -> DataFrame:
        """One of the eight data sources over the selected class; an unknown one is an error."""
        if name not in SOURCES:
            raise ValueError(f"no such source: {name}; there are {sorted(SOURCES)}")
        told = SOURCES[name]
        if isinstance(told, str):
            return self.sql(told)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.sql(x if " " in x else f"select * from {x}") for x in told])

    @contextmanager
    def quoted(self):
        """Double quotes mean names, as in standard SQL."""
        key = "spark.sql.ansi.doubleQuotedIdentifiers"
        old = self.spark.conf.get(key)
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            self.spark.conf.set(key, old)

    def names(self, text: str) -> list[str]:
        """One-part relation names that Spark's parser finds in a query, also in subqueries and CTEs."""
        with self.quoted():
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        found: dict[str, None] = {}
        todo, seen = [plan], set()
        while todo:
            node = todo.pop()
            if not hasattr(node, "nodeName") or node.hashCode() in seen and not node.children().isEmpty():
                continue
            seen.add(node.hashCode())
            if node.nodeName() == "UnresolvedRelation" and node.multipartIdentifier().size() == 1:
                found[node.multipartIdentifier().head()] = None
            for more in (node.children(), node.innerChildren(), node.subqueries()):
                todo += [more.apply(i) for i in range(more.size())]
        return list(found)

    def sql(self, text: str, limit: int | None = None) -> DataFrame:
        """Run SQL after making a view for each name in it that is ours; an existing view of that name is replaced."""
        for name in self.names(text):
            df = self.resolve(name)
            if df is not None:
                df.createOrReplaceTempView("`" + name.replace("`", "``") + "`")
        with self.quoted():
            out = self.spark.sql(text)
        return out if limit is None else out.limit(limit)
