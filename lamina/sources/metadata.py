"""Metadata tables: CSV without type inference, so that ids such as 001 stay what they are, with their columns checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL_COLUMNS = ("PatientID", "StudyUID", "View")
MANIFEST_COLUMNS = ("PatientID", "View", "Raw_path")
TARGET_COLUMNS = ("GraphLabel", "Normal", "Cancer", "Benign")
#: Names that a column may have in a table of paths, regardless of case.
PATH_ALIASES = {
    "PatientID": ("PatientID", "patient_id"),
    "StudyUID": ("StudyUID", "StudyInstanceUID", "study_uid"),
    "View": ("View",),
    "path": ("descriptive_path", "DescriptivePath", "path", "file_path", "filepath"),
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; an empty cell is null, other text is kept."""
    return spark.read.csv(path, header=True, inferSchema=False, nullValue="", enforceSchema=False)


def pick_column(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    """The first candidate that is present, regardless of case; of columns that differ in case only, the last."""
    by_name = {c.lower(): c for c in columns}
    return next((by_name[c.lower()] for c in candidates if c.lower() in by_name), None)


def require(df: DataFrame, columns: tuple[str, ...], what: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} must contain {', '.join(missing)}")
    return df


def labels(df: DataFrame) -> DataFrame:
    """A labels table with its View stripped and in lower case."""
    return require(df, LABEL_COLUMNS, "labels").withColumn("View", F.lower(F.trim("View")))


def manifest(df: DataFrame) -> DataFrame:
    """A table of views to build, with at least one target column."""
    require(df, MANIFEST_COLUMNS, "manifest")
    if not set(TARGET_COLUMNS) & set(df.columns):
        raise ValueError(f"manifest must contain one of {', '.join(TARGET_COLUMNS)}")
    absent = [F.lit(None).cast("string").alias(c) for c in (*TARGET_COLUMNS, "Mask_path") if c not in df.columns]
    return df.select("*", *absent).withColumn("PatientID", F.trim("PatientID")).withColumn("View", F.trim("View"))


def path_map(df: DataFrame, order: Column) -> DataFrame:
    """PatientID, StudyUID, View, path: the first path of each view by `order`; rows without a path are left out.

    first is a sum that needs no rank of all rows: the least (order, path) of each key."""
    picked = {k: pick_column(df.columns, v) for k, v in PATH_ALIASES.items()}
    missing = sorted(k for k, c in picked.items() if c is None)
    if missing:
        raise ValueError(f"paths must contain {', '.join(missing)}")
    named = df.select(*[F.col(c).cast("string").alias(k) for k, c in picked.items() if c], order.alias("_order"))
    rows = named.where(F.trim("path") != "").withColumn("View", F.lower(F.trim("View")))
    return rows.groupBy(*LABEL_COLUMNS).agg(F.min_by("path", "_order").alias("path"))


def with_paths(views: DataFrame, paths: DataFrame) -> DataFrame:
    """views with path, and reason no_matching_path where there is none."""
    found = views.join(paths, list(LABEL_COLUMNS), "left")
    return found.withColumn("reason", F.when(F.col("path").isNull(), "no_matching_path").otherwise(""))


def patients(spark: SparkSession, spec: str) -> DataFrame:
    """PatientID: the lines of a file, or, where `spec` names none, the items of a comma-separated list; blanks are dropped."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spec or "-")
    try:
        is_file = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    except Exception:  # not a path at all
        is_file = False
    rows = spark.read.text(spec).select(F.trim("value").alias("PatientID")) if is_file else spark.createDataFrame([(p.strip(),) for p in spec.split(",")], "PatientID string")
    return rows.where("PatientID <> ''").distinct()


def of_patients(views: DataFrame, wanted: DataFrame) -> DataFrame:
    return views.join(wanted, F.trim(views["PatientID"]) == wanted["PatientID"], "left_semi")


def largest(rows: DataFrame, group: str, member: str) -> DataFrame:
    """Of each group the member with the most rows, the first by name of equals (the largest series of a folder)."""
    counts = rows.groupBy(group, member).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.min_by(member, F.struct(-F.col("n"), F.col(member))).alias(member), F.max("n").alias("n"))


#: The folder that a root may have above its patients, and the endings of files with pixels.
DATASET_FOLDER = "Breast-Cancer-Screening-DBT"
DICOM_ENDINGS = (".dcm", ".dicom", ".dcmdecoded", ".dicomdecoded")


def candidates(root: str, patient: Column, path: Column, folder: str = DATASET_FOLDER) -> Column:
    """The places where a source may be, as a listing has them: an absolute path, or the path under a root, under its folder, or there
    under its patient's."""
    path, scheme = F.rtrim(path, F.lit("/")), root.split(":")[0] if ":" in root else "file"
    nested = F.array(*[F.concat(F.lit(f"{root}/"), *parts) for parts in ((path,), (F.lit(f"{folder}/"), path), (F.lit(f"{folder}/"), patient, F.lit("/"), path))])
    return F.when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.array(path)).when(path.startswith("/"), F.array(F.concat(F.lit(f"{scheme}:"), path))).otherwise(nested)


def found_sources(rows: DataFrame, places: str, files: DataFrame, key: tuple[str, ...], endings: tuple[str, ...] = DICOM_ENDINGS) -> DataFrame:
    """key, sources: of each row the files of the first of its places that is there: itself, or those of the largest series in a folder,
    by name. Rows without any are left out.

    files: path, and series if files of one folder may belong to several ones (null: to none, if others have one)."""
    files = files if "series" in files.columns else files.withColumn("series", F.lit(None).cast("string"))
    above = F.expr("transform(sequence(1, greatest(size(split(path, '/')) - 1, 1)), i -> substring_index(path, '/', i))")
    there = files.select("path").unionByName(files.select(F.explode(above).alias("path"))).distinct()
    each = rows.select(*key, F.posexplode(places).alias("at", "path")).join(there, "path")
    first = each.groupBy(*key).agg(F.min_by("path", "at").alias("path"))
    fit = F.lower("path").rlike(f"({'|'.join(e.replace('.', '[.]') for e in endings)})$")
    inside = files.withColumn("folder", F.expr("substring_index(path, '/', size(split(path, '/')) - 1)")).where(F.col("series").isNotNull() | fit)
    named = inside.where("series IS NOT NULL").select("folder", "series")
    chosen = inside.join(largest(named, "folder", "series").select("folder", F.col("series").alias("_largest")), "folder", "left").where("_largest IS NULL OR _largest = series")
    lists = chosen.groupBy(F.col("folder").alias("path")).agg(F.array_sort(F.collect_list("path")).alias("sources"))
    single = files.where(fit).select("path", F.array("path").alias("sources"))
    return first.join(lists.unionByName(single), "path").select(*key, "sources")


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime and length of the files under a folder; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "length")


def outdated(sources: DataFrame, outputs: DataFrame, key: tuple[str, ...], tolerance_s: float = 0.001) -> DataFrame:
    """The keys whose output is missing or older than the newest source, by more than the tolerance. Both: key, modified."""
    newest = sources.groupBy(*key).agg(F.max("modified").alias("newest"))
    made = outputs.groupBy(*key).agg(F.max("modified").alias("made"))
    old = F.col("made").isNull() | (F.col("made") < F.col("newest") - F.expr(f"INTERVAL '{tolerance_s}' SECOND"))
    return newest.join(made, list(key), "left").where(old).select(*key)


def distinct_failures(rows: DataFrame, order: str) -> DataFrame:
    """Each row (without the column it is ordered by) once, in the order of its first occurrence."""
    names = [c for c in rows.columns if c != order]
    return rows.groupBy(*names).agg(F.min(order).alias("_first")).orderBy("_first").select(*names)


def write_failures(rows: DataFrame, path: str) -> None:
    """One tab-separated file with a header, also if there are no failures. The rows pass the driver one by one."""
    jvm, conf = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    with_ = to.getFileSystem(conf).create(to, True)
    try:
        for cells in ([rows.columns], rows.toLocalIterator()):
            for row in cells:
                with_.write(bytearray(("\t".join("" if c is None else " ".join(str(c).split()) for c in row) + "\n").encode()))
    finally:
        with_.close()


def append_ledger(rows: DataFrame, path: str) -> None:
    """Adds rows to a ledger. Their columns may differ from those that it has; reading it gives the union of all."""
    rows.write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def union_ledgers(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def matched(views: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows before and after a filter by patients, and how many of the wanted patients have rows."""
    kept = of_patients(views, wanted).select(F.trim("PatientID").alias("PatientID"))
    before, after = views.agg(F.count("*").alias("rows_before")), kept.agg(F.count("*").alias("rows_after"), F.countDistinct("PatientID").alias("patients_matched"))
    asked = wanted.agg(F.countDistinct("PatientID").alias("patients_requested"))
    return before.join(after).join(asked)  # one row each
