"""Genomics-shaped views over the driver tables, once as DataFrames and once as CTE text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cladeloom.plans.registry import table
from cladeloom.session import spread

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGTACGTACGTACGTACGTACGTAN"

SITES = """v_sites as (
  select l_orderkey as id, l_linestatus as gene, l_linenumber as pos,
         min(case when l_discount = 0 then '-' else l_returnflag end) as allele,
         min(l_extendedprice) as y
  from lineitem group by 1, 2, 3)"""

POINTS = """v_points as (
  select event_id, ts, user_id as species, event_type as category, value,
         value % 360 - 180 as lon, (value * 7) % 180 - 90 as lat
  from events)"""

SEQ = f"""v_seq as (
  select doc_id as id, source as gene, lang,
         upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as seq,
         translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') as dna
  from documents)"""

GENOMES = """v_genomes as (
  select o_orderkey as id, o_custkey as organism, cast(floor(o_totalprice / 1000) as bigint) as gene_count,
         o_orderpriority as tech, cast(year(o_orderdate) as bigint) as yr
  from orders)"""

VEC = """v_vec as (
  select vec_id as id, label as gene, cast(embedding as double[]) as v,
         cast(embedding[2] as double) * 2 - cast(embedding[6] as double) + (vec_id % 7) / 10.0 as y
  from embeddings)"""

# a binary tree over customers: node k hangs under node k div 2, so ancestors are right shifts
EDGES = """v_edges as (
  select (c_custkey + 1) // 2 as parent, c_custkey + 1 as child, 0.1 + abs(c_acctbal) / 1000 as length
  from customer where c_custkey >= 1)"""

STATES = """v_raw as (
  select o_custkey + 1 as node, l_linenumber as pos, case when l_discount = 0 then '-' else l_returnflag end as aa,
         l_orderkey * 100000 + l_partkey as ord0
  from orders join lineitem on l_orderkey = o_orderkey),
v_states as (
  select node, pos, arg_max(aa, ord0 * 256 + ascii(aa)) as aa, count(*) as n from v_raw group by 1, 2),
v_probs as (
  select node, pos, aa, count(*) / sum(count(*)) over (partition by node, pos) as prob from v_raw group by 1, 2, 3)"""


def sites(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return (li.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("gene"), F.col("l_linenumber").alias("pos"))
            .agg(F.min(F.when(F.col("l_discount") == 0, "-").otherwise(F.col("l_returnflag"))).alias("allele"),
                 F.min("l_extendedprice").alias("y")))


def points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("species"), F.col("event_type").alias("category"), "value",
                    (F.col("value") % 360 - 180).alias("lon"), ((F.col("value") * 7) % 180 - 90).alias("lat"))


def letters(col: str = "text") -> Column:
    return F.upper(F.regexp_replace(F.col(col), "[^A-Za-z]", ""))


def seqs(spark: SparkSession, d: str) -> DataFrame:
    doc = spread(table(spark, d, "documents").select("doc_id", "source", "lang", "text"))
    # inline() keeps the letter clean-up from being re-evaluated inside every later expression
    clean = F.inline(F.array(F.struct(letters().alias("seq"), F.translate(letters(), LETTERS, BASES).alias("dna"))))
    return doc.select(F.col("doc_id").alias("id"), F.col("source").alias("gene"), "lang", clean)


def genomes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("organism"),
                    F.floor(F.col("o_totalprice") / 1000).alias("gene_count"),
                    F.col("o_orderpriority").alias("tech"), F.year("o_orderdate").cast("bigint").alias("yr"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    x = F.col("embedding")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("gene"), x.cast("array<double>").alias("v"),
                    (x[1].cast("double") * 2 - x[5].cast("double") + (F.col("vec_id") % 7) / F.lit(10.0)).alias("y"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where(F.col("c_custkey") >= 1)
    k = F.col("c_custkey") + 1
    return c.select(F.floor(k / 2).cast("bigint").alias("parent"), k.alias("child"),
                    (F.lit(0.1) + F.abs("c_acctbal") / 1000).alias("length"))


def _raw_states(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_returnflag", "l_partkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_custkey") + 1).alias("node"), F.col("l_linenumber").alias("pos"),
        F.when(F.col("l_discount") == 0, "-").otherwise(F.col("l_returnflag")).alias("aa"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("ord"))


def states(spark: SparkSession, d: str) -> DataFrame:
    return _raw_states(spark, d).groupBy("node", "pos").agg(F.max_by("aa", F.col("ord") * 256 + F.ascii("aa")).alias("aa"))


def state_probs(spark: SparkSession, d: str) -> DataFrame:
    n = _raw_states(spark, d).groupBy("node", "pos", "aa").agg(F.count("*").alias("n"))
    t = n.groupBy("node", "pos").agg(F.sum("n").alias("t"))
    return n.join(t, ["node", "pos"]).select("node", "pos", "aa", (F.col("n") / F.col("t")).alias("prob"))


def rnd(col: Column | str, digits: int = 6) -> Column:
    """Rounded value for the value-hash comparison, as the SQL rounds: the scaled double decides which way a half goes, where
    `F.round` to digits goes by the shortest decimal that stands for the double."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double") * 10.0 ** digits) / F.lit(10.0 ** digits)


def count_as(name: str = "n") -> Column:
    return F.count("*").alias(name)
