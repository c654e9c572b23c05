"""Files and streams: tables are written in each format to the shared folder and read back."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cladeloom.operators import aggregates as ag
from cladeloom.plans import views as v
from cladeloom.plans.q_stats import r_
from cladeloom.plans.registry import query, table
from cladeloom.session import shared_dir
from cladeloom.sources import readers as rd, writers as wr
from cladeloom.streaming import occurrences as oc


def scratch(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@query("read_fasta", f"""
with {v.SEQ} select cast(id as varchar) as id, gene as tag, cast(length(seq) as bigint) as len, md5(seq) as digest from v_seq""")
def _(s, d):
    out = scratch(s)
    q = v.seqs(s, d).select(F.concat_ws(" ", F.col("id").cast("string"), "gene", F.lit("EC 1.1 A->B > transfer")).alias("h"), F.regexp_replace("seq", "(.{60})", "$1\n").alias("seq"))
    wr.write_fasta(q, out, "h", "seq")
    f = rd.read_fasta(s, out)
    return f.select("id", F.element_at(F.split("description", " "), 2).alias("tag"), F.length("seq").cast("bigint").alias("len"), F.md5("seq").alias("digest"))


@query("write_fasta", f"with {v.SEQ} select gene, count(*) as n, cast(sum(length(seq)) as bigint) as total from v_seq where lang <> 'en' group by 1")
def _(s, d):
    """One folder per gene; headers with fewer than three words are skipped."""
    out = scratch(s)
    h = F.when(F.col("lang") == "en", F.concat_ws(" ", F.col("id").cast("string"), "lang")).otherwise(F.concat_ws(" ", F.col("id").cast("string"), "lang", F.lit("x")))
    wr.write_fasta(v.seqs(s, d).select("gene", h.alias("h"), "seq"), out, "h", "seq", by="gene", min_tokens=3)
    files = s.read.option("lineSep", ">").text(out).where(F.trim("value") != "")
    f = files.select("gene", F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "").alias("seq"))
    return f.groupBy("gene").agg(v.count_as(), F.sum(F.length("seq")).alias("total"))


@query("read_features", """
select 'P' || p_partkey || '.1' as genome_id, 600 + p_size as genome_size, p_brand as gene, p_size * 10 + 1 as "start", p_size * 10 + 51 as "end", case when p_partkey % 2 = 0 then 1 else -1 end as strand, 1 as part_no from part
union all select 'P' || p_partkey || '.1', 600 + p_size, p_brand, p_size * 10 + 71, p_size * 10 + 90, case when p_partkey % 2 = 0 then 1 else -1 end, 2 from part""")
def _(s, d):
    out = scratch(s)
    a = F.format_string("%d..%d,%d..%d", F.col("p_size") * 10 + 1, F.col("p_size") * 10 + 51, F.col("p_size") * 10 + 71, F.col("p_size") * 10 + 90)
    loc = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("join("), a, F.lit(")"))).otherwise(F.concat(F.lit("complement(join("), a, F.lit("))")))
    pad, key = " " * 21, "     CDS             "
    rec = F.concat(F.format_string("LOCUS       P%d %d bp    DNA\nVERSION     P%d.1\nFEATURES             Location/Qualifiers\n", "p_partkey", F.col("p_size") + 600, "p_partkey"),
                   F.lit(key), loc, F.lit(f'\n{pad}/gene="'), "p_brand", F.lit(f'"\n{pad}/translation="MKV\n{pad}LL"\nORIGIN\n//'))
    table(s, d, "part").select(rec.alias("value")).write.text(out)
    return rd.read_features(s, out).where("feature_type = 'CDS' and translation = 'MKVLL'").select("genome_id", "genome_size", "gene", "start", "end", "strand", "part_no")


@query("read_occurrences", """
select cast(user_id as varchar) as species, cast(round(value, 2) as double) as lat, cast(year(ts) as smallint) as yr from events where event_type <> 'error'""")
def _(s, d):
    """Rows whose year is no number are malformed and dropped."""
    out = scratch(s)
    return _occurrences(s, d, "\t")


@query("read_occurrences_comma", """
select cast(user_id as varchar) as species, cast(round(value, 2) as double) as lat, cast(year(ts) as smallint) as yr from events where event_type <> 'error'""")
def _(s, d):
    return _occurrences(s, d, ",")


def _occurrences(s, d, sep):
    """Written with a separator that the reader finds by itself."""
    out = scratch(s)
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("species"), F.round("value", 2).cast("string").alias("lat"),
                                     F.when(F.col("event_type") == "error", "n/a").otherwise(F.year("ts").cast("string")).alias("yr"))
    e.write.option("sep", sep).option("header", True).csv(out)
    return rd.read_occurrences(s, out, schema="species string, lat double, yr smallint")


@query("union_files", """
select l_orderkey as id, l_quantity as a, null::double as b from lineitem union all select o_orderkey, null, o_totalprice from orders""")
def _(s, d):
    out = scratch(s)
    wr.write_table(table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("a")), out + "/x", fmt="csv")
    wr.write_table(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("b")), out + "/y", fmt="csv")
    read = lambda p, c: s.read.schema(f"id bigint, {c} double").option("header", True).csv(p)
    return rd.union_files([read(out + "/x", "a"), read(out + "/y", "b")])


@query("scan_dir", "select 'bio' || l_linenumber as layer, count(*) as n, round(sum(l_quantity), 2) as total from lineitem group by 1")
def _(s, d):
    """A folder per layer; the layer is named by its folder's files."""
    out = scratch(s)
    table(s, d, "lineitem").select("l_orderkey", "l_quantity", F.concat(F.lit("bio"), F.col("l_linenumber").cast("string")).alias("layer")).write.partitionBy("layer").option("header", True).csv(out)
    x = rd.scan_dir(s, out, "*.csv", "l_quantity", "l_orderkey bigint, l_quantity double", ["l_orderkey"], F.regexp_extract(F.input_file_name(), "layer=([^/]+)/", 1))
    return r_(x.groupBy("layer").agg(v.count_as(), F.sum("value").alias("total")), 2)


@query("scan_parquet_pruned", "select l_orderkey, l_quantity from lineitem where l_quantity >= 45 and l_returnflag = 'R'")
def _(s, d):
    return rd.scan_parquet_pruned(s, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"], (F.col("l_quantity") >= 45) & (F.col("l_returnflag") == "R"))


@query("scan_csv_pruned", "select event_id, event_type from events")
def _(s, d):
    out = scratch(s)
    e = table(s, d, "events").select("event_id", "user_id", "event_type", "value")
    wr.write_table(e, out, fmt="csv")
    return rd.scan_csv_pruned(s, out, "event_id bigint, user_id bigint, event_type string, value double", ["event_id", "event_type"])


@query("read_mapping_table", """
select c_custkey as pdb_id, c_name as uniprot_ac, c_name as uniprot_id, case when c_nationkey > 20 then null else c_nationkey::bigint end as resseq_start from customer""")
def _(s, d):
    out = scratch(s)
    c = table(s, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_nationkey") > 20, "None").otherwise(F.col("c_nationkey").cast("string")).alias("n"))
    lines = c.select(F.explode(F.array(F.lit("# comment"), F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", "n"))).alias("value"))
    lines.write.text(out)
    df = s.read.schema("PDB bigint, SP_PRIMARY string, RES_BEG string").option("comment", "#").csv(out)
    df.write.option("header", True).csv(out + "/h")
    return rd.read_mapping_table(s, out + "/h", "PDB bigint, SP_PRIMARY string, RES_BEG string", {"PDB": "pdb_id", "SP_PRIMARY": "uniprot_ac", "RES_BEG": "resseq_start"},
                                 {"uniprot_id": "uniprot_ac"}, ["resseq_start"])


@query("read_feature_json", """
select event_id, 'Transit' as type, cast(json_extract_string(props, '$.k') as bigint) as "start", cast(json_extract_string(props, '$.k') as bigint) + 10 as "end" from events where event_type = 'click'""")
def _(s, d):
    k = F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_type") == "click", "Transit").otherwise("Other")
    js = F.format_string('{"features":[{"type":"%s","location":{"start":{"value":%s},"end":{"value":%s}}},{"type":"Chain","location":{"start":{"value":1},"end":{"value":2}}}]}', kind, k, (k.cast("bigint") + 10).cast("string"))
    return rd.explode_features(table(s, d, "events").select("event_id", js.alias("js")), "event_id", "js", "Transit")


@query("read_line_formats", """
select cast(doc_id as varchar) as seq_id, (n_chars % 5)::int as tm_helices, 'o' || n_chars || 'i' as topology, (n_chars % 5 > 0)::int as is_membrane from documents""")
def _(s, d):
    out = scratch(s)
    l = F.format_string("%d\tlen=9 ExpAA=1 PredHel=%d Topology=o%di", "doc_id", F.col("n_chars") % 5, "n_chars")
    table(s, d, "documents").select(F.explode(F.array(l, F.lit("# note"))).alias("value")).write.text(out)
    return rd.topology_lines(s.read.text(out)).withColumn("is_membrane", F.col("is_membrane").cast("int"))


@query("read_domain_hits", "select cast(page_id as varchar) as seq_id, 'PF' || length(url) as domain, round(1.0 / (page_id + 1), 8)::double as evalue, page_id as \"start\", page_id + 9 as \"end\" from pages")
def _(s, d):
    out = scratch(s)
    l = F.format_string("name PF%d %d - %s b c d e f g h i j k %d %d x y z", F.length("url"), "page_id", F.round(1 / (F.col("page_id") + 1), 8).cast("string"), "page_id", F.col("page_id") + 9)
    table(s, d, "pages").select(F.explode(F.array(l, F.lit("# c"), F.lit("short line"))).alias("value")).write.text(out)
    return rd.domain_hits(s.read.text(out)).select("seq_id", "domain", "evalue", "start", "end")


@query("read_repeat_hits", """
select p_brand, max(p_size * 100 + p_partkey) as length, arg_max(p_partkey, p_size * 100 + p_partkey) as "start" from part where p_partkey % 3 <> 0 group by 1""")
def _(s, d):
    out = scratch(s)
    kind = F.when(F.col("p_partkey") % 3 != 0, "P").otherwise("D")
    l = F.format_string("%d 0 %d %s 1 0 %d 0 1e-9 100 99.5", F.col("p_size") * 100 + F.col("p_partkey"), "p_partkey", kind, F.col("p_partkey") + 7)
    table(s, d, "part").select("p_brand", l.alias("value")).write.partitionBy("p_brand").text(out)
    h = rd.repeat_hits(s.read.text(out))
    return ag.largest_hit(h, ["p_brand"], "length", "start", ["start"])


@query("read_clusters", "select p_size::bigint as cluster, p_name || '_' || p_partkey as seq_id from part")
def _(s, d):
    out = scratch(s)
    m = F.array_join(F.collect_list(F.format_string("0\t99aa, >%s_%d... at 99%%", "p_name", "p_partkey")), "\n")
    table(s, d, "part").groupBy("p_size").agg(m.alias("m")).select(F.format_string(">Cluster %d\n%s", "p_size", "m").alias("value")).write.text(out)
    return rd.read_clusters(s, out)


@query("read_atoms", "select label::varchar as chain, vec_id::int as resno, round(embedding[1]::double * 50, 3) + 0.0 as x, round(embedding[3]::double * 50, 3) + 0.0 as z from embeddings where vec_id % 10 < 8")
def _(s, d):
    out = scratch(s)
    e = table(s, d, "embeddings")
    x = [F.round(F.col("embedding")[i].cast("double") * 50, 3) for i in range(3)]
    res = F.when(F.col("vec_id") % 10 < 8, "ALA").otherwise("HOH")
    # serial and residue number have 5 and 4 places
    at = [rd.to_hybrid36(F.col("vec_id"), w) for w in (5, 4)]
    l = F.format_string("ATOM  %s  CA  %3s %1d%s    %8.3f%8.3f%8.3f", at[0], res, "label", at[1], *x)
    e.select(l.alias("value")).write.text(out)
    a = rd.read_atoms(s, out).where("is_ca")
    return a.select("chain", "resno", (v.rnd("x", 3) + 0.0).alias("x"), (v.rnd("z", 3) + 0.0).alias("z"))


@query("read_grid", "select 'bio' || p_size % 2 as layer, (p_partkey // 40)::int as \"row\", (p_partkey % 40)::int as col, case when p_size = 7 then null else p_retailprice end as value from part")
def _(s, d):
    out = scratch(s)
    g = table(s, d, "part").select(F.concat(F.lit("bio"), (F.col("p_size") % 2).cast("string")).alias("layer"), F.floor(F.col("p_partkey") / 40).alias("row"), (F.col("p_partkey") % 40).alias("col"),
                                   F.when(F.col("p_size") == 7, -999.0).otherwise(F.col("p_retailprice")).alias("value"))
    wr.write_table(g, out, fmt="csv")
    return rd.read_grid(s, out)


@query("read_tree_edges", f"with {v.EDGES} select parent, child, round(length, 6) as length from v_edges")
def _(s, d):
    out = scratch(s)
    wr.write_table(v.edges(s, d), out, fmt="csv")
    return r_(rd.read_edges(s, out))


@query("read_states", f"with {v.STATES}, a(aa) as (values ('A'), ('N'), ('R')) select k.node, k.pos, a.aa, round(coalesce(prob, 0), 8)::double as prob from (select distinct node, pos from v_raw) k cross join a left join v_probs p on p.node = k.node and p.pos = k.pos and p.aa = a.aa")
def _(s, d):
    out = scratch(s)
    w = v.state_probs(s, d).groupBy("node", "pos").pivot("aa", ["A", "N", "R"]).agg(F.max("prob")).fillna(0.0)
    w.select("node", "pos", F.lit("x").alias("state"), *[F.col(a).alias(f"p_{a}") for a in "ANR"]).write.option("header", True).option("sep", "\t").csv(out)
    return r_(rd.read_states(s, out, ["A", "N", "R"]), 8)


@query("write_table", "select l_returnflag, l_orderkey, l_quantity from lineitem")
def _(s, d):
    out = scratch(s)
    wr.write_table(table(s, d, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity"), out, by=["l_returnflag"])
    return s.read.parquet(out)


@query("write_gff3", """
select 'gene' as type, p_brand || '_' || p_partkey as feature_id, '' as parent, (p_size * 10 + 1)::bigint as "start", case when p_partkey % 2 = 0 then '+' else '-' end as strand from part
union all select 'mRNA', p_brand || '_' || p_partkey || '_mRNA', p_brand || '_' || p_partkey, p_size * 10 + 1, case when p_partkey % 2 = 0 then '+' else '-' end from part
union all select 'CDS', p_brand || '_' || p_partkey || '_CDS', p_brand || '_' || p_partkey || '_mRNA', p_size * 10 + 1, case when p_partkey % 2 = 0 then '+' else '-' end from part""")
def _(s, d):
    out = scratch(s)
    g = table(s, d, "part").select(F.lit("NC1").alias("genome_id"), F.concat_ws("_", "p_brand", F.col("p_partkey").cast("string")).alias("gene"), (F.col("p_size") * 10 + 1).alias("start"), (F.col("p_size") * 10 + 51).alias("end"),
                                   F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1).alias("strand"), F.col("p_type").alias("product"))
    wr.gff3_lines(g).write.text(out)
    return rd.read_gff3(s, out).select("type", "feature_id", "parent", "start", "strand")


@query("write_vcf", """
with c as (select l_linenumber as chrom, l_suppkey as pos, l_partkey % 20 as smp, max(l_returnflag) as b from lineitem group by 1, 2, 3), r as (select chrom, pos, arg_min(b, smp) as ref from c group by 1, 2),
a as (select chrom, pos, string_agg(distinct b, ',' order by b) as alt, list(distinct b order by b) as al from c join r using (chrom, pos) where b <> ref group by 1, 2)
select chrom, pos, ref, alt, string_agg(case when b = ref then '0' else list_position(al, b)::varchar end, chr(9) order by smp) as genotypes from c join r using (chrom, pos) join a using (chrom, pos) group by 1, 2, 3, 4""")
def _(s, d):
    out = scratch(s)
    c = table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("chrom"), F.col("l_suppkey").alias("pos"), (F.col("l_partkey") % 20).alias("smp")).agg(F.max("l_returnflag").alias("b"))
    wr.vcf_lines(wr.vcf_rows(c, "chrom", "pos", "smp", "b"), "chrom", "pos").write.text(out)
    p = F.split("value", "\t")
    return s.read.text(out).select(p[0].cast("int").alias("chrom"), p[1].cast("bigint").alias("pos"), p[3].alias("ref"), p[4].alias("alt"), F.array_join(F.slice(p, F.lit(10), F.size(p)), "\t").alias("genotypes"))


@query("write_feature_track", """
with r as (select *, case when lag(event_type) over w = event_type then 0 else 1 end as brk from events window w as (partition by user_id order by ts, event_id)),
k as (select *, sum(brk) over (partition by user_id order by ts, event_id) as run from r)
select '*' || chr(9) || min(event_id) || chr(9) || max(event_id) || chr(9) || 'gene' || chr(9) || min(event_type) as value from k group by user_id, run""")
def _(s, d):
    out = scratch(s)
    e = table(s, d, "events").select("user_id", "ts", "event_id", "event_type")
    runs = ag.run_aggregate(ag.break_runs(e, ["user_id"], ["ts", "event_id"], "event_type"), ["user_id"], "event_id", "event_type")
    wr.feature_track(runs, "first", "last", "state").write.text(out)
    return s.read.text(out)


@query("missing_inputs", "select c_custkey, case when c_custkey in (select o_custkey from orders where o_orderstatus = 'P') then 'found' else 'missing' end as status from customer")
def _(s, d):
    o = table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return rd.missing_inputs(table(s, d, "customer"), o, "c_custkey")


@query("resume_filter", "select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def _(s, d):
    out = scratch(s)
    wr.write_table(table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), out)
    return rd.resume_filter(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), s.read.parquet(out), ["l_orderkey"])


# ---- streams --------------------------------------------------------------

_EV = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@query("stream_occurrence_filter", "select event_id, user_id, value from events where value > 50 and event_type <> 'error' and user_id in (select c_custkey from customer where c_acctbal > 0)")
def _(s, d):
    out = scratch(s)
    st = oc.file_stream(s, d, "events.parquet", _EV)
    keys = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    oc.run_available(oc.occurrence_filter(st, keys, "user_id", (F.col("value") > 50) & (F.col("event_type") != "error")).select("event_id", "user_id", "value"), out + "/t", out + "/c")
    return s.read.parquet(out + "/t")


@query("stream_summary", "select event_type, count(*) as n, true as distinct_is_near from events group by 1")
def _(s, d):
    out = scratch(s)
    oc.run_complete(oc.summary(oc.file_stream(s, d, "events.parquet", _EV), ["event_type"], "user_id"), out + "/t", out + "/c")
    exact = table(s, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("_x"))
    near = F.abs(F.col("n_distinct") - F.col("_x")) <= 0.05 * F.col("_x")
    return s.read.parquet(out + "/t").join(exact, "event_type").select("event_type", "n", near.alias("distinct_is_near"))


@query("stream_dedupe", f"with {v.POINTS} select distinct species, round(lat, 6) as lat, round(lon, 6) as lon from v_points")
def _(s, d):
    out = scratch(s)
    st = oc.file_stream(s, d, "events.parquet", _EV)
    # rounded first: values 360 apart are one place, but differ in their last bits
    p = st.select("ts", F.col("user_id").alias("species"), (v.rnd(F.col("value") % 360 - 180) + 0.0).alias("lon"), (v.rnd((F.col("value") * 7) % 180 - 90) + 0.0).alias("lat"))
    oc.run_available(oc.dedupe(p, ["species", "lat", "lon"], "ts", "365 days").select("species", "lat", "lon"), out + "/t", out + "/c")
    return r_(s.read.parquet(out + "/t"))
