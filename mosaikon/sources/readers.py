"""Readers and writers of the file formats of the field, on Spark's own text, CSV and JSON sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chemistry import formula_mass, parse_formula


def imaging_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(pixel_id, x, y, mz, intensity) from a long (x, y, mz, intensity) or wide (x, y, one column for each m/z) CSV.

    Headers are compared without case; a wide table's number columns are its m/z.
    """
    raw = spark.read.csv(path, header=True, sep=sep)
    names = {c.strip().lower(): c for c in raw.columns}
    if not {"x", "y"} <= names.keys():
        raise ValueError("the table has no x and y columns")
    x, y = (F.col(f"`{names[c]}`").cast("int") for c in "xy")
    if {"mz", "intensity"} <= names.keys():
        long = raw.select(x.alias("x"), y.alias("y"), F.col(f"`{names['mz']}`").cast("double").alias("mz"), F.col(f"`{names['intensity']}`").cast("double").alias("intensity"))
    else:
        def number(c: str) -> bool:
            try:
                float(c)
            except ValueError:
                return False
            return True

        mzs = [c for c in raw.columns if number(c)]
        wide = raw.select(x.alias("x"), y.alias("y"), *[F.col(f"`{c}`").cast("double").alias(f"m{k}") for k, c in enumerate(mzs)])
        axis = F.create_map(*[v for k, c in enumerate(mzs) for v in (F.lit(f"m{k}"), F.lit(float(c)))])
        long = wide.unpivot(["x", "y"], [f"m{k}" for k in range(len(mzs))], "name", "intensity").select("x", "y", F.element_at(axis, F.col("name")).alias("mz"), "intensity")
    return long.withColumn("pixel_id", F.col("y").cast("long") * (1 << 20) + F.col("x")).select("pixel_id", "x", "y", "mz", "intensity")


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).where(F.trim("value") != "")


def _field(name: str):
    got = F.regexp_extract("value", rf"(?mi)^{name}\s*[=:]\s*(.*?)\s*$", 1)
    return F.when(got != "", got)


def _peak_list(lines):
    """Arrays of m/z and intensity from lines that begin with two numbers."""
    number = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
    rows = F.filter(F.split(lines, r"\r?\n"), lambda s: F.regexp_like(s, F.lit(rf"^\s*{number}[\s,;]+{number}")))
    pair = F.transform(rows, lambda s: F.split(F.trim(s), r"[\s,;]+"))
    return F.transform(pair, lambda p: p[0].cast("double")), F.transform(pair, lambda p: p[1].cast("double"))


def mgf(spark: SparkSession, path: str) -> DataFrame:
    """(title, precursor, mz, intensity) of an MGF file: records end with END IONS."""
    mz, inten = _peak_list(F.col("value"))
    rows = _records(spark, path, "END IONS").where(F.col("value").contains("BEGIN IONS"))
    return rows.select(_field("TITLE").alias("title"), F.regexp_extract(_field("PEPMASS"), r"^([\d.eE+-]+)", 1).try_cast("double").alias("precursor"), mz.alias("mz"), inten.alias("intensity"))


def msp(spark: SparkSession, path: str) -> DataFrame:
    """(name, precursor, adduct, smiles, mz, intensity) of an MSP library: records are parted by empty lines."""
    mz, inten = _peak_list(F.col("value"))
    rows = _records(spark, path, "\n\n")
    return rows.select(_field("Name").alias("name"), _field("PrecursorMZ").try_cast("double").alias("precursor"), _field("Precursor_type").alias("adduct"), _field("SMILES").alias("smiles"), mz.alias("mz"), inten.alias("intensity")).where("name IS NOT NULL")


def sdf(spark: SparkSession, path: str) -> DataFrame:
    """A map of the data fields of each record of an SDF file."""
    rows = _records(spark, path, "$$$$")
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(r"(?m)^>\s*<([^>]+)>\s*\r?\n(.*)$"), 1).alias("k"), F.regexp_extract_all("value", F.lit(r"(?m)^>\s*<([^>]+)>\s*\r?\n(.*)$"), 2).alias("v"))
    last = F.aggregate(pairs, F.expr("cast(map() as map<string,string>)"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], F.trim(p["v"]))))
    return rows.select(last.alias("fields")).where(F.size("fields") > 0)


def lipids_from_sdf(spark: SparkSession, path: str) -> DataFrame:
    """(name, class, formula, neutral_mass) of an SDF compound table, without records whose formula has unknown elements."""
    f = lambda *names: F.coalesce(*[F.nullif(F.try_element_at("fields", F.lit(n)), F.lit("")) for n in names])
    rows = sdf(spark, path).select(f("ABBREVIATION", "COMMON_NAME", "LM_ID").alias("name"), f("MAIN_CLASS", "CATEGORY").alias("class"), parse_formula(f("FORMULA")).alias("formula"))
    return rows.withColumn("neutral_mass", formula_mass(F.col("formula"))).where("neutral_mass IS NOT NULL")


def lipids_from_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The same of a CSV with name, class and formula columns."""
    raw = spark.read.csv(path, header=True, sep=sep)
    names = {c.strip().lower(): c for c in raw.columns}
    rows = raw.select(F.col(f"`{names['name']}`").alias("name"), F.col(f"`{names['class']}`").alias("class"), parse_formula(F.col(f"`{names['formula']}`")).alias("formula"))
    return rows.withColumn("neutral_mass", formula_mass(F.col("formula"))).where("neutral_mass IS NOT NULL")


def merge_lipids(base: DataFrame, other: DataFrame) -> DataFrame:
    """base with those of other whose composition it doesn't have."""
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("formula"))))
    known = base.select(key.alias("__k")).distinct()
    return base.unionByName(other.withColumn("__k", key).join(known, "__k", "left_anti").drop("__k"))


def peak_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table of numbers under a header that may come after other lines: the first line with a m/z column.

    Lines keep their order within a file by their offset, so the header is one small aggregate.
    """
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    head = lines.where(F.regexp_like(F.lower("value"), F.lit(rf"(^|{sep})\s*\"?m/?z\b"))).agg(F.min(F.struct("n", "value")).alias("h")).first()["h"]
    if head is None:
        raise ValueError("no line has a m/z column")
    names = [c.strip().strip('"') for c in head["value"].split(sep)]
    parsed = lines.where(F.col("n") > head["n"]).select(F.from_csv("value", ", ".join(f"`{c}` double" for c in names), {"sep": sep}).alias("r"))
    return parsed.select("r.*").where(F.col(f"`{names[0]}`").isNotNull())


def target_list(spark: SparkSession, path: str) -> DataFrame:
    """target_mz: the distinct numbers that begin the lines of a text file."""
    got = F.regexp_extract(spark.read.text(path)["value"], r"^\s*(\d+(?:\.\d+)?)", 1)
    return spark.read.text(path).select(got.try_cast("double").alias("target_mz")).where("target_mz > 0").distinct()


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """Saved sessions, one row a file, with where each came from."""
    return spark.read.option("multiLine", True).json(path).withColumn("session_path", F.col("_metadata.file_path"))


def modality_csv(spark: SparkSession, path: str) -> DataFrame:
    """(loc_id, x, y, feature, value) from a CSV with x, y and a column for each feature."""
    raw = spark.read.csv(path, header=True)
    names = {c.strip().lower(): c for c in raw.columns}
    own = [c for c in raw.columns if c.strip().lower() not in ("x", "y", "loc_id", "barcode")]
    wide = raw.select(F.monotonically_increasing_id().alias("loc_id"), F.col(f"`{names['x']}`").cast("double").alias("x"), F.col(f"`{names['y']}`").cast("double").alias("y"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in own])
    return wide.unpivot(["loc_id", "x", "y"], own, "feature", "value")


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table as parquet, csv, tsv or json."""
    out = df.write.mode("overwrite")
    if kind in ("csv", "tsv"):
        out.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)
    else:
        out.format(kind).save(path)
