"""Readers for the file formats the analyses start from; each yields a fixed schema.

Files are split by record separator and parsed with JVM-side expressions, so one
large file is read by many tasks and no record passes through Python.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cladeloom import schemas

Paths = str | Sequence[str]


def _text(spark: SparkSession, paths: Paths, sep: str | None = None) -> DataFrame:
    r = spark.read
    if sep:
        r = r.option("lineSep", sep)
    return r.text(paths if isinstance(paths, str) else list(paths))


def file_stem(col: Column | None = None) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(F.input_file_name() if col is None else col, r"([^/]+?)(\.[^./]*)?$", 1)


def read_fasta(spark: SparkSession, paths: Paths) -> DataFrame:
    """(id, description, seq, file): records are cut at a `>` that begins a line, sequence lines joined, comment lines dropped."""
    r = _text(spark, paths, "\n>").select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "").withColumn("file", file_stem())
    head = F.regexp_replace(F.substring_index("value", "\n", 1), r"\s+$", "")
    body = F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1), r"(?m)^;.*$|\s", "")
    return r.select(F.substring_index(head, " ", 1).alias("id"), head.alias("description"), body.alias("seq"), "file")


def parse_header(h: Column) -> dict[str, Column]:
    """id before the first bar, gene from `Gene_x`, taxonomy tail; `id_gene_tail` headers also work."""
    bar = h.contains("|")
    parts = F.split(h, "_")
    return {
        "id": F.when(bar, F.substring_index(h, "|", 1)).otherwise(F.get(parts, F.lit(0))),
        "gene": F.when(bar, F.regexp_extract(h, r"Gene_([^|]+)", 1)).otherwise(F.get(parts, F.lit(1))),
        "taxonomy": F.regexp_extract(h, r"Taxonomy:(.*)$", 1),
    }


def read_features(spark: SparkSession, paths: Paths) -> DataFrame:
    """Annotated flat files to one row per feature part (1-based, inclusive); records end with `//`."""
    r = _text(spark, paths, "//\n").where(F.trim("value") != "")
    r = r.select(F.regexp_extract("value", r"(?m)^VERSION +(\S+)", 1).alias("genome_id"), F.regexp_extract("value", r"(?m)^LOCUS +\S+ +(\d+) bp", 1).cast("int").alias("genome_size"),
                 F.posexplode(F.regexp_extract_all("value", F.lit(r"(?m)^ {5}(\S+) +(\S.*(?:\n {21}.*)*+)"), F.lit(0))).alias("feature_no", "b"))
    q = lambda name: F.regexp_extract("b", rf'(?s)/{name}="([^"]*)"', 1)
    loc = F.regexp_replace(F.regexp_extract("b", r"(?s)^ {5}\S+ +(.*?)(?:\n {21}/|$)", 1), r"\s", "")
    f = r.select("genome_id", "genome_size", "feature_no", F.regexp_extract("b", r"^ {5}(\S+)", 1).alias("feature_type"), q("gene").alias("gene"),
                 F.regexp_replace(q("translation"), r"\s", "").alias("translation"), F.when(loc.contains("complement"), -1).otherwise(1).alias("strand"),
                 F.posexplode(F.regexp_extract_all(loc, F.lit(r"<?(\d+)\.\.>?(\d+)"), F.lit(0))).alias("_i", "_p"))
    n = lambda i: F.regexp_extract("_p", r"(\d+)\.\.>?(\d+)", i).cast("int")
    return f.select("genome_id", "genome_size", "feature_no", "feature_type", "gene", (F.col("_i") + 1).alias("part_no"), n(1).alias("start"), n(2).alias("end"), "strand", "translation")


def read_occurrences(spark: SparkSession, path: Paths, sep: str | None = None, schema: str = schemas.OCCURRENCES) -> DataFrame:
    """Header row, no quoting, explicit types; malformed rows are dropped.  Without `sep`, the header line tells tab from comma."""
    sep = sep or sniff_separator(spark, path)
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", "").option("mode", "DROPMALFORMED").csv(path)


def sniff_separator(spark: SparkSession, path: Paths) -> str:
    """Tab when the header line holds one, else comma."""
    head = _text(spark, path).limit(1).first()
    return "\t" if head and "\t" in head["value"] else ","


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables with differing columns; absent ones become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def scan_dir(spark: SparkSession, folder: str, glob: str, value: str, schema: str, key: Sequence[str], layer: Column | None = None) -> DataFrame:
    """Every matching file below a folder in long form: keys, `layer` (by default the file's name), and its value."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(folder)
    return df.select(*key, (file_stem() if layer is None else layer).alias("layer"), F.col(value).alias("value"))


def scan_parquet_pruned(spark: SparkSession, path: Paths, columns: Sequence[str], predicate: Column | None = None) -> DataFrame:
    """Projection and predicate expressed on the scan, so both reach the file reader."""
    df = spark.read.parquet(path) if isinstance(path, str) else spark.read.parquet(*path)
    return (df if predicate is None else df.where(predicate)).select(*columns)


def scan_csv_pruned(spark: SparkSession, path: Paths, schema: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path).select(*columns)


def read_mapping_table(spark: SparkSession, path: Paths, schema: str, rename: Mapping[str, str], copies: Mapping[str, str], integers: Sequence[str]) -> DataFrame:
    """Comment lines skipped, columns renamed and copied, integer columns coerced (bad values -> NULL)."""
    df = spark.read.schema(schema).option("comment", "#").option("header", True).csv(path).withColumnsRenamed(dict(rename))
    df = df.withColumns({new: F.col(old) for new, old in copies.items()}) if copies else df
    return df.withColumns({c: F.col(c).try_cast("bigint") for c in integers})


def explode_features(df: DataFrame, id: str, json: str, kind: str) -> DataFrame:
    """JSON `features` of one type with their start / end values."""
    s = "features array<struct<type:string,location:struct<start:struct<value:bigint>,end:struct<value:bigint>>>>"
    e = df.select(id, F.explode(F.from_json(json, s)["features"]).alias("f")).where(F.col("f.type") == kind)
    return e.select(id, F.col("f.type").alias("type"), F.col("f.location.start.value").alias("start"), F.col("f.location.end.value").alias("end"))


def domain_hits(lines: DataFrame, value: str = "value") -> DataFrame:
    """Whitespace table of domain hits; comments and short or malformed lines are skipped."""
    p = F.split(F.trim(value), r"\s+")
    d = lines.where(~F.col(value).startswith("#")).select("*", p.alias("_p")).where(F.size("_p") >= 18)
    at = lambda i, t: F.element_at("_p", i).try_cast(t)
    out = d.select(*[c for c in lines.columns if c != value], F.element_at("_p", 3).alias("seq_id"), F.element_at("_p", 2).alias("domain"), at(5, "double").alias("evalue"), at(-5, "bigint").alias("start"), at(-4, "bigint").alias("end"))
    return out.dropna(subset=["evalue", "start", "end"])


def topology_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """`id<TAB>... PredHel=n Topology=...` lines."""
    l = lines.where(~F.col(value).startswith("#") & F.col(value).contains("\t"))
    n = F.coalesce(F.regexp_extract(value, r"PredHel=(\d+)", 1).try_cast("int"), F.lit(0))
    return l.select(F.substring_index(value, "\t", 1).alias("seq_id"), n.alias("tm_helices"), F.regexp_extract(value, r"Topology=(\S+)", 1).alias("topology"), (n > 0).alias("is_membrane"))


def repeat_hits(lines: DataFrame, value: str = "value") -> DataFrame:
    """Palindromic repeat hits: length, start, end, identity."""
    p = F.split(F.trim(value), r"\s+")
    d = lines.where(~F.col(value).startswith("#") & (F.trim(value) != "")).select("*", p.alias("_p")).where((F.size("_p") >= 11) & (F.col("_p")[3] == "P"))
    g = lambda i, t: F.col("_p")[i].try_cast(t)
    return d.select(*[c for c in lines.columns if c != value], g(0, "bigint").alias("length"), g(2, "bigint").alias("start"), g(6, "bigint").alias("end"), g(10, "double").alias("identity"))


def read_clusters(spark: SparkSession, paths: Paths) -> DataFrame:
    """(cluster, seq_id): each `>Cluster` block is one record, so no running header is needed."""
    r = _text(spark, paths, ">Cluster ").where(F.trim("value") != "")
    # the number is read before the members become rows, or every member would carry its block and search it again
    r = r.select(F.regexp_extract("value", r"^(\d+)", 1).cast("bigint").alias("cluster"), F.regexp_extract_all("value", F.lit(r">(.+?)\.\.\."), F.lit(1)).alias("_ids"))
    return r.select("cluster", F.explode("_ids").alias("seq_id"))


def read_gff3(spark: SparkSession, paths: Paths) -> DataFrame:
    p = F.split("value", "\t")
    l = _text(spark, paths).where(~F.col("value").startswith("#")).select(p.alias("p")).where(F.size("p") == 9)
    return l.select(F.col("p")[0].alias("seq_id"), F.col("p")[2].alias("type"), F.col("p")[3].cast("bigint").alias("start"), F.col("p")[4].cast("bigint").alias("end"), F.col("p")[6].alias("strand"),
                    F.regexp_extract(F.col("p")[8], r"(?:^|;)ID=([^;]*)", 1).alias("feature_id"), F.regexp_extract(F.col("p")[8], r"(?:^|;)Parent=([^;]*)", 1).alias("parent"))


def hybrid36(s: Column, width: int) -> Column:
    """Number in a field of fixed width: decimal, then base 36 from A000 on in capitals, then from a000 on in small letters."""
    n, at = F.conv(F.upper(s), 36, 10).cast("bigint"), 36 ** (width - 1)
    return F.when(s.rlike("^[A-Z]"), n - 10 * at + 10 ** width).when(s.rlike("^[a-z]"), n + 16 * at + 10 ** width).otherwise(s.try_cast("bigint"))


def to_hybrid36(n: Column, width: int) -> Column:
    """The text of a number from 0 on as `hybrid36` reads it; numbers beyond the last raise."""
    at, most = 36 ** (width - 1), 10 ** width
    code = lambda shift: F.conv((n - most + shift).cast("string"), 10, 36)
    return (F.when(n < most, F.lpad(n.cast("string"), width, " ")).when(n < most + 26 * at, code(10 * at)).when(n < most + 52 * at, F.lower(code(-16 * at)))
            .otherwise(F.raise_error(F.concat(n.cast("string"), F.lit(f" does not fit {width} places")))))


def read_atoms(spark: SparkSession, paths: Paths) -> DataFrame:
    """Fixed-width atom lines; water is dropped, `is_ligand` marks hetero atoms, `is_ca` the alpha carbons.  Residue
    numbers from 10,000 on are in hybrid-36, the usual form of large structures."""
    f = lambda a, n: F.trim(F.substring("value", a, n))
    l = _text(spark, paths).where(F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM"))
    d = l.select(f(22, 1).alias("chain"), hybrid36(f(23, 4), 4).cast("int").alias("resno"), f(18, 3).alias("resid"), f(13, 4).alias("atom"), *[f(31 + 8 * i, 8).cast("double").alias(c) for i, c in enumerate("xyz")],
                 F.col("value").startswith("HETATM").alias("is_ligand"))
    return d.where(F.col("resid") != "HOH").withColumn("is_ca", ~F.col("is_ligand") & (F.col("atom") == "CA"))


def read_grid(spark: SparkSession, path: Paths, sentinels: Sequence[float] = (-99.0, -999.0)) -> DataFrame:
    """Raster cells (layer, row, col, value) with sentinels and infinities as NULL."""
    g = spark.read.schema(schemas.GRID).option("header", True).csv(path)
    inf = float("inf")
    return g.withColumn("value", F.when(~F.col("value").isin(*sentinels, inf, -inf) & ~F.isnan("value"), F.col("value")))


def read_edges(spark: SparkSession, path: Paths) -> DataFrame:
    return spark.read.schema(schemas.EDGES).option("header", True).csv(path)


def read_states(spark: SparkSession, path: Paths, residues: Sequence[str]) -> DataFrame:
    """Wide per-node state probabilities (node, pos, aa, p_A ...) to long rows."""
    s = "node bigint, pos int, state string, " + ", ".join(f"p_{r} double" for r in residues)
    w = spark.read.schema(s).option("header", True).option("sep", "\t").csv(path)
    long = w.drop("state").unpivot(["node", "pos"], [f"p_{r}" for r in residues], "aa", "prob")
    return long.select("node", "pos", F.substring("aa", 3, 1).alias("aa"), "prob")


def missing_inputs(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Each expected key with found / missing; absent keys stay in the result."""
    p = present.select(key).distinct().withColumn("_p", F.lit(True))
    return expected.select(key).distinct().join(p, key, "left").select(key, F.when(F.col("_p"), "found").otherwise("missing").alias("status"))


def resume_filter(todo: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Work whose keys are not in the sink yet."""
    return todo.join(done.select(*key).distinct(), list(key), "left_anti")
