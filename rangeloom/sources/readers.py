"""Readers of pair tables, boundary tables, residue lists, base-pair text and structures."""

from __future__ import annotations

import bz2
import gzip
import re

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions.scalars import null_if_blank

#: Columns of the legacy pair CSV, in file order, with their types.
LEGACY_COLUMNS = (
    "pdbid string, model long, chain1 string, res1 string, nr1 long, ins1 string, atom1 string, alt1 string, "
    "chain2 string, res2 string, nr2 long, ins2 string, atom2 string, alt2 string, image long, dist double, rmsd double, "
    "tx double, ty double, tz double, r11 double, r12 double, r13 double, r21 double, r22 double, r23 double, r31 double, r32 double, r33 double, "
    "t1MMB double, t2MMB double, t3MMB double, theta double, axMMB double, ayMMB double, azMMB double"
)
UNIT = r"([^|\s]+)"


def read_pairs(spark: SparkSession, *files: str, casts: dict[str, str] | None = None) -> DataFrame:
    """Parquet pair files as one table; without ``casts`` all must have one schema."""
    parts = [spark.read.parquet(f) for f in files]
    if casts:
        parts = [p.withColumns({c: F.col(c).cast(t) for c, t in casts.items() if c in p.columns}) for p in parts]
    first = parts[0]
    for f, p in zip(files, parts, strict=True):
        if [(x.name, x.dataType) for x in p.schema.fields] != [(x.name, x.dataType) for x in first.schema.fields]:
            raise ValueError(f"{f} has another schema than {files[0]}")
    for p in parts[1:]:
        first = first.union(p)
    return first


def read_pair_csv(spark: SparkSession, *files: str) -> DataFrame:
    """Legacy CSV pair files, with or without header; missing columns become null, identities are normalised.

    A file with a header is read by its names, in whatever order; without one the legacy order holds.
    Columns that are not legacy ones are text.
    """
    out = None
    for f in files:
        head = spark.read.text(f).head()
        named = [n.strip() for n in head[0].split(",")] if head is not None else []
        header = "pdbid" in named
        kinds = dict(c.split(" ") for c in LEGACY_COLUMNS.split(", "))
        schema = ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in named) if header else LEGACY_COLUMNS
        df = spark.read.schema(schema).option("header", header).option("enforceSchema", True).csv(f)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return normalise_identity(out)


def normalise_identity(df: DataFrame) -> DataFrame:
    """Lower-case structure ids; blank insertion and variant codes to null."""
    made = {"pdbid": F.lower("pdbid")} if "pdbid" in df.columns else {}
    return df.withColumns(made | {c: null_if_blank(c) for c in ("ins1", "ins2", "alt1", "alt2") if c in df.columns})


def diagonal_concat(*dfs: DataFrame) -> DataFrame:
    """Concatenation by name; missing columns are null, numbers take their common type."""
    order = {"int": 0, "bigint": 1, "float": 2, "double": 3}
    kinds: dict[str, str] = {}
    for df in dfs:
        for name, kind in df.dtypes:
            old = kinds.get(name)
            if old and old != kind:
                kind = max(old, kind, key=lambda k: order.get(k, 9)) if {old, kind} <= set(order) else "string"
            kinds[name] = kind
    out = None
    for df in dfs:
        df = df.withColumns({c: F.col(c).cast(kinds[c]) for c, k in df.dtypes if kinds[c] != k})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_boundaries(spark: SparkSession, *sources: str) -> DataFrame:
    """Boundary CSV: the first source that is there; of a repeated class the first row."""
    last: Exception | None = None
    for s in sources:
        try:
            df = spark.read.option("header", True).option("inferSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(s)
        except AnalysisException as e:  # the next source is tried if this one is not there, and only then
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            last = e
            continue
        df = df.withColumn("class_key", F.lower(F.concat_ws("-", F.trim("family"), F.trim("bases")))).withColumn("_n", F.monotonically_increasing_id())
        from rangeloom.operators.dedupe import best_per_key

        return best_per_key(df, ["class_key"], [F.col("_n")]).drop("_n") if "_n" in df.columns else df
    raise FileNotFoundError(f"no boundary table in {sources}: {last}")


def unit_columns(unit: F.Column, n: int) -> list[F.Column]:
    """Columns of a ``|``-separated unit id: pdbid|model|chain|res|nr|atom|alt|ins|symop."""
    p = F.split(unit, r"\|")
    get = lambda i: F.nullif(F.get(p, F.lit(i)), F.lit(""))
    return [
        get(2).alias(f"chain{n}"), get(3).alias(f"res{n}"), F.get(p, F.lit(4)).cast("int").alias(f"nr{n}"),
        get(6).alias(f"alt{n}"), get(7).alias(f"ins{n}"), get(8).alias(f"symmetry_operation{n}"),
    ]


def unpacked(path: str, content: bytes) -> bytes:
    """A file's bytes, unpacked by its name's ending (gz, bz2, zst)."""
    if path.endswith(".gz"):
        return gzip.decompress(content)
    if path.endswith(".bz2"):
        return bz2.decompress(content)
    if path.endswith(".zst"):
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    return content


def read_lines(spark: SparkSession, *files: str) -> DataFrame:
    """(value): lines of text files; those that end in zst are unpacked in a map over whole files."""
    packed = [f for f in files if f.endswith(".zst")]
    plain = [f for f in files if f not in packed]

    def unpack(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame({"value": unpacked(path, content).decode().splitlines()})

    out = spark.read.text(plain) if plain else None
    if packed:
        more = spark.read.format("binaryFile").load(packed).select("path", "content").mapInPandas(unpack, "value string")
        out = more if out is None else out.union(more)
    return out


def read_basepairs(spark: SparkSession, *files: str) -> DataFrame:
    """Base-pair text (plain, gz or zst): unit id, family, unit id, ignored number on each line."""
    lines = read_lines(spark, *files).select(F.trim("value").alias("line")).where("line != ''")
    f = F.split("line", r"\s+")
    lines = lines.select(f[0].alias("u1"), f[1].alias("family"), f[2].alias("u2"))
    head = F.split("u1", r"\|")
    return lines.select(F.lower(head[0]).alias("pdbid"), head[1].cast("int").alias("model"), *unit_columns(F.col("u1"), 1), *unit_columns(F.col("u2"), 2), "family", F.col("family").alias("type"))


def read_residue_list(spark: SparkSession, *files: str) -> DataFrame:
    """``pdbid_chain_base[.alt]_nr[.ins]`` lines; a line of another form is an error when read."""
    pattern = r"^(\w{4})_([^_\s]+)_([A-Za-z0-9]+)(?:\.([A-Za-z0-9]+))?_(-?\d+)(?:\.([A-Za-z0-9]+))?$"
    t = F.trim("value")
    lines = spark.read.text(list(files)).where(t != "").select(F.when(t.rlike(pattern), t).otherwise(F.raise_error(F.concat(F.lit("not a residue: "), t))).alias("t"))
    part = lambda i: F.nullif(F.regexp_extract("t", pattern, i), F.lit(""))
    return lines.select(F.lower(part(1)).alias("pdbid"), part(2).alias("chain"), part(3).alias("base"), part(5).cast("int").alias("nr"), part(6).alias("ins"), part(4).alias("alt"))


ATOM_SCHEMA = "pdbid string, model int, chain string, nr int, ins string, alt string, res string, atom string, element string, x double, y double, z double"
#: mmCIF items of an atom row, in the order of the schema above without pdbid.
ATOM_ITEMS = ("pdbx_PDB_model_num", "auth_asym_id", "auth_seq_id", "pdbx_PDB_ins_code", "label_alt_id", "label_comp_id", "label_atom_id", "type_symbol", "Cartn_x", "Cartn_y", "Cartn_z")
CIF_TOKEN = re.compile(r"""'((?:[^']|'(?=\S))*)'(?=\s|$)|"((?:[^"]|"(?=\S))*)"(?=\s|$)|(\S+)""")


def cif_atoms(text: str) -> list[tuple]:
    """Atom rows of an mmCIF file's ``_atom_site`` loop."""
    rows: list[tuple] = []
    items: list[str] = []
    in_loop = False
    for line in text.splitlines():
        if line.startswith("loop_"):
            in_loop, items = True, []
        elif in_loop and line.startswith("_"):
            items.append(line.strip())
        elif in_loop and items and items[0].startswith("_atom_site."):
            if line.startswith("#") or not line.strip():
                in_loop = False
                continue
            values = [a or b or c for a, b, c in CIF_TOKEN.findall(line)]
            named = dict(zip([i.partition(".")[2] for i in items], values, strict=False))
            got = [named.get(i) for i in ATOM_ITEMS]
            got = [None if v in ("?", ".") else v for v in got]
            rows.append((int(got[0] or 1), got[1], int(got[2]) if got[2] else None, got[3], got[4], got[5], got[6], got[7], *(float(v) if v else None for v in got[8:])))
        else:
            in_loop = in_loop and not items
    return rows


def read_structures(spark: SparkSession, *files: str) -> DataFrame:
    """Atoms of mmCIF files (plain, gz, bz2 or zst), one file a row of work; the id is the file's stem."""

    names = [c.split()[0] for c in ATOM_SCHEMA.split(", ")]

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data = unpacked(path, content)
                stem = re.split(r"[./\\]", path.rsplit("/", 1)[-1])[0].lower()
                yield pd.DataFrame([(stem, *r) for r in cif_atoms(data.decode())], columns=names)

    return spark.read.format("binaryFile").load(list(files)).select("path", "content").mapInPandas(parse, ATOM_SCHEMA)


def structure_ids(df: DataFrame, column: str = "pdbid") -> DataFrame:
    """Distinct lower-cased structure ids."""
    return df.select(F.lower(column).alias("pdbid")).distinct()


def partition_of(df: DataFrame, column: str, parts: int, first: int, last: int | None = None) -> DataFrame:
    """The rows of partitions ``first`` to ``last`` out of ``parts``, by a hash of the lower-cased id."""
    k = F.pmod(F.xxhash64(F.lower(column)), F.lit(parts))
    return df.where(k.between(first, first if last is None else last))


#: Modified bases and the base that each counts as.
PARENT_BASE = {"2MG": "G", "7MG": "G", "OMG": "G", "GTP": "G", "5MC": "C", "OMC": "C", "5MU": "T", "CTG": "T", "A2M": "A"}
#: Fixed value: what the annotator writes for a number that it does not have.
NO_NUMBER = "999999"
#: Names of the twelve step parameters, in file order.
STEP_PARAMETERS = ("shear", "stretch", "stagger", "buckle", "propeller", "opening", "shift", "slide", "rise", "tilt", "roll", "twist")
ANNOTATED_SCHEMA = "folder string, " + ", ".join(f"seq{i} int, chain{i} string, nr{i} int, res{i} string, alt{i} string" for i in (1, 2)) + ", pairing_type string, " + ", ".join(f"{p} double" for p in STEP_PARAMETERS)


def parent_base(name: str) -> str:
    """One-letter base of a residue name where it has one, else the name."""
    plain = name.upper().removeprefix("D") or name.upper()  # a deoxy residue counts as its base
    return PARENT_BASE.get(plain, plain)


def annotated_id(text: str) -> tuple[str, str, int, str]:
    """(chain, residue name, number, insertion code) of ``chain.name[/]number[^code]``.

    The number is what follows the slash, or without one all digits at the end, with their sign.
    """
    chain, _, rest = text.partition(".")
    rest, _, code = rest.partition("^")
    name, slash, digits = rest.partition("/")
    if not slash:
        at = max(len(rest.rstrip("0123456789")), 1)
        at -= rest[at - 1 : at] == "-" and at > 1
        name, digits = rest[:at], rest[at:]
    if not (chain and name and digits.removeprefix("-").isdecimal()):
        raise ValueError(f"not a residue id: {text}")
    return chain, name, int(digits), code


def annotated_pairs(pairs: str, steps: str) -> list[tuple]:
    """Rows of a pair file and its parameter file, which belong together line by line.

    Comment lines (#) count in neither.  Rows whose residue names contradict the written
    base pair go; names of modified bases are not held against it.
    """
    lines = [[x for x in text.splitlines() if x.strip() and not x.startswith("#")] for text in (pairs, steps)]
    rows = []
    if len(lines[0]) != len(lines[1]):
        raise ValueError(f"the files are out of step: {len(lines[0])} pairs and {len(lines[1])} lines of parameters")
    for line, more in zip(*lines, strict=True):
        seq1, seq2, _, _, _, id1, id2, written, kind = line.split()
        again, *numbers = more.split()
        if again != written:
            raise ValueError(f"the files are out of step: {written} and {again}")
        sides = [annotated_id(x) for x in (id1, id2)]
        names = [parent_base(name) for _, name, _, _ in sides]
        if all(len(n) == 1 for n in names) and names != [b.upper() for b in re.split("[-+]", written)]:
            continue
        values = [None if v == NO_NUMBER else float(v) for v in numbers]
        residues = [x for seq, (chain, name, nr, code) in zip((seq1, seq2), sides, strict=True) for x in (int(seq), chain, nr, name, code)]
        rows.append((*residues, kind, *(values + [None] * len(STEP_PARAMETERS))[: len(STEP_PARAMETERS)]))
    return rows


def read_annotated(spark: SparkSession, *folders: str, pairs: str = "dssr-pairs.txt", steps: str = "dssr-dsStepPars.txt") -> DataFrame:
    """Pairs with step parameters from folders that hold two files each, matched by line position.

    A folder is one row of work: its two files are small and are grouped by their folder.
    """
    files = [f"{f.rstrip('/')}/{n}" for f in folders for n in (pairs, steps)]
    df = spark.read.format("binaryFile").load(files).select(F.regexp_extract("path", "^(.*)/", 1).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")
    names = [c.split()[0] for c in ANNOTATED_SCHEMA.split(", ")]

    def parse(pdf: pd.DataFrame) -> pd.DataFrame:
        text = {n: c.decode() for n, c in zip(pdf["name"], pdf["content"], strict=True)}
        rows = annotated_pairs(text.get(pairs, ""), text.get(steps, ""))
        return pd.DataFrame([(pdf["folder"].iloc[0], *r) for r in rows], columns=names)

    return df.groupBy("folder").applyInPandas(parse, ANNOTATED_SCHEMA)


def cif_category(text: str, category: str) -> list[dict[str, str | None]]:
    """Rows of one mmCIF category, whether written as a loop or as single items.

    ``?`` and ``.`` are null.  Rows of a loop may be broken over lines; texts between
    semicolons are one value.
    """
    names: list[str] = []
    values: list[str | None] = []
    single: dict[str, str | None] = {}
    in_loop, block, pending = False, None, None
    prefix = f"_{category}."

    def give(v: str | None) -> None:
        nonlocal pending
        if pending is not None:
            single[pending], pending = v, None
        elif in_loop and names:
            values.append(v)

    for line in text.splitlines():
        if block is not None:
            if line.startswith(";"):
                give("\n".join(block))
                block = None
            else:
                block.append(line)
        elif line.startswith(";"):
            block = [line[1:]]
        elif line.startswith(("loop_", "#", "data_")):
            in_loop, pending = line.startswith("loop_"), None
            if names:
                break
        elif line.startswith("_"):
            item, _, rest = line.strip().partition(" ")
            pending = None
            if not item.startswith(prefix):
                if names or single:
                    break
                in_loop = False
            elif in_loop and not rest.strip():
                names.append(item.removeprefix(prefix))
            else:
                pending = item.removeprefix(prefix)
                for v in _cif_values(rest):
                    give(v)
        elif names or pending is not None:
            for v in _cif_values(line):
                give(v)
    if not names:
        return [single] if single else []
    return [dict(zip(names, values[i : i + len(names)], strict=True)) for i in range(0, len(values) - len(names) + 1, len(names))]


def _cif_values(text: str) -> list[str | None]:
    return [None if c in ("?", ".") else a or b or c for a, b, c in CIF_TOKEN.findall(text)]


OPERATOR_SCHEMA = "pdbid string, id string, op string, triplet string, " + ", ".join(f"r{i}{j} double" for i in (1, 2, 3) for j in (1, 2, 3)) + ", t1 double, t2 double, t3 double, organism string, organism_id int"


def symmetry_rows(text: str) -> list[tuple]:
    """Symmetry operators of an mmCIF file, each with the file's source organism."""
    source = (cif_category(text, "pdbx_entity_src_syn") or [{}])[0]
    number = source.get("pdbx_src_id")
    organism = (source.get("organism_scientific"), int(number) if number else None)
    items = [f"matrix[{i}][{j}]" for i in (1, 2, 3) for j in (1, 2, 3)] + [f"vector[{i}]" for i in (1, 2, 3)]
    return [(r["id"], r.get("name"), r.get("symmetry_operation"), *(float(r[i]) for i in items), *organism) for r in cif_category(text, "pdbx_struct_oper_list")]


def read_symmetry(spark: SparkSession, *files: str) -> DataFrame:
    """Symmetry operators of mmCIF files, in the form that ``transform_points`` takes."""
    names = [c.split()[0] for c in OPERATOR_SCHEMA.split(", ")]

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                stem = re.split(r"[./\\]", path.rsplit("/", 1)[-1])[0].lower()
                yield pd.DataFrame([(stem, *r) for r in symmetry_rows(unpacked(path, content).decode())], columns=names)

    return spark.read.format("binaryFile").load(list(files)).select("path", "content").mapInPandas(parse, OPERATOR_SCHEMA)
