"""The registered queries: one per operator, over the bridge frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.functions import genotype, palette, sequences
from locusflow.operators import annotate, display, geometry, grouping, network, population
from locusflow.plans import bridge
from locusflow.plans.view import record_json
from locusflow.sources import selectors as selectors_
from locusflow.sources import side, vcf

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _view(spark, d, start=1, end=5, **options):
    return bridge.view_of(spark, d, bridge.region(spark, start, end), last=end, **options)


def _states(spark, d, impute):
    c = bridge.calls(spark, d)
    return c.select("sample_ord", "pos", genotype.call_state(F.col("a1"), F.col("a2"), impute).alias("state"))


@query
def genotype_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d, False)


@query
def genotype_impute(spark, d):
    return _states(spark, d, True)


@query
def site_alleles(spark, d):
    return grouping.sites(_view(spark, d, 1, 64).variants).select("chrom", "pos", "allele")


@query
def state_labels(spark, d):
    v = bridge.variants(spark)
    alleles = v.select("pos", genotype.allele_text(F.col("ref"), F.col("alt")).alias("allele"))
    joined = _states(spark, d, True).filter("state is not null").join(alleles, "pos")
    return joined.select("sample_ord", "pos", genotype.state_label(F.col("state"), F.col("allele")).alias("label"))


@query
def hap_profiles_strict(spark, d):
    return _view(spark, d).profiles.select("sample_ord", "sample", "hap")


@query
def hap_profiles_impute(spark, d):
    return _view(spark, d, impute=True).profiles.select("sample_ord", "sample", "hap")


@query
def hap_site(spark, d):
    return _view(spark, d, 4, 4).summary.select("rank", "label", "hap", "count")


@query
def hap_summary(spark, d):
    return _view(spark, d).summary.select("rank", "label", "hap", "count")


@query
def hap_detail(spark, d):
    return _view(spark, d).labelled.select("sample_ord", "sample", "hap", "label")


@query
def hap_accessions(spark, d):
    v = _view(spark, d)
    return v.summary.join(grouping.haplotype_samples(v.accessions), ["sel_ord", "hap"]).select("label", "hap", "count", "samples")


@query
def hap_cells(spark, d):
    v = _view(spark, d)
    rows = v.summary.join(display.site_lists(v.sites), "sel_ord")
    return rows.select("label", F.array_join(genotype.hap_cells(F.col("hap"), F.col("alleles")), " ").alias("cells"))


@query
def hap_regions_batch(spark, d):
    return bridge.view_of(spark, d, bridge.nation_selectors(spark, d)).summary


@query
def hap_approx(spark, d):
    return _view(spark, d, max_diff=0.2).accessions.select("sample_ord", "sample", "hap", "leader")


@query
def hap_approx_summary(spark, d):
    return _view(spark, d, max_diff=0.2, impute=True).summary.select("rank", "hap", "count")


@query
def hap_scale(spark, d):
    """Suppliers over the classes of all parts in ``lineitem``."""
    return grouping.summarize(grouping.sample_profiles(bridge.lineitem_calls(spark, d))).select("rank", "label", "hap", "count")


@query
def sample_subset(spark, d):
    wanted = bridge.samples(spark, d).filter("sample_ord % 3 = 0").select("sample", (1000000 - F.col("sample_ord")).alias("sample_ord"))
    return _view(spark, d, samples=wanted).profiles.select("sample_ord", "sample", "hap")


@query
def sample_unknown(spark, d):
    wanted = spark.range(0, 40).select(F.concat(F.lit("C"), (F.col("id") * 997).cast("string")).alias("sample"))
    from locusflow.operators.calls import unknown_samples

    return unknown_samples(wanted, bridge.samples(spark, d).select("sample"))


@query
def view_counters(spark, d):
    return bridge.view_of(spark, d, bridge.nation_selectors(spark, d)).counters


@query
def record_overlap(spark, d):
    """Records whose reference allele reaches into each nation's window."""
    from locusflow.operators.calls import select_variants

    return select_variants(bridge.variants(spark), bridge.nation_selectors(spark, d)).select("sel_ord", "pos", "ref")


@query
def population_lines(spark, d):
    """Customers written as population lines, some with blanks, empty or repeated names, and decoded again."""
    c = bridge.table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 11 == 0, "").otherwise(F.concat(F.lit(" C"), (F.col("c_custkey") % 500).cast("string")))
    line = F.concat(name, F.when(F.col("c_custkey") % 13 == 0, "").otherwise(F.concat(F.lit("\t"), F.col("c_mktsegment"), F.lit(" \r"))))
    return side.decode_populations(c.select(F.col("c_custkey").alias("ord"), line.alias("value")))


@query
def debug_fetch(spark, d):
    return vcf.fetch_counts(bridge.variants(spark), bridge.samples(spark, d))


@query
def vcf_decode(spark, d):
    """Calls written as VCF lines and decoded again."""
    c = bridge.calls(spark, d)
    text = lambda a: F.coalesce(F.col(a).cast("string"), F.lit("."))
    cell = F.concat(text("a1"), F.when(F.col("pos") % 2 == 0, "/").otherwise("|"), text("a2"), F.lit(":9"))
    rows = c.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("sample_ord", cell.alias("c")))).alias("x"))
    rows = rows.join(bridge.variants(spark), "pos")
    line = F.concat_ws("\t", "chrom", "pos", F.lit("."), "ref", F.concat_ws(",", "alt"), F.lit("9"), F.lit("PASS"), F.lit("."), F.lit("GT:DP"), F.array_join(F.transform("x", lambda s: s["c"]), "\t"))
    decoded = vcf.decode_variants(rows.select(F.col("pos").cast("long").alias("ord"), line.alias("value")))
    long = decoded.select("chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), F.posexplode("genotypes").alias("col_ord", "g"))
    return long.select("chrom", "pos", "ref", "alt", "col_ord", F.col("g.a1").alias("a1"), F.col("g.a2").alias("a2"), F.col("g.phased").alias("phased"))


@query
def bed_parse(spark, d):
    n = bridge.table(spark, d, "nation")
    name = F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("\t"), F.col("n_name")))
    line = F.concat(F.lit("chr1\t"), F.col("n_nationkey").cast("string"), F.lit("\t"), (F.col("n_nationkey") + 4).cast("string"), name)
    lines = n.select((F.col("n_nationkey") + 1).alias("line_no"), F.when(F.col("n_nationkey") % 5 == 4, "  ").otherwise(line).alias("value"))
    return selectors_.parse_bed_lines(lines)


@query
def gff_genes(spark, d):
    g = bridge.genes(spark, d)
    line = F.concat_ws("\t", "seqid", F.lit("src"), "type", "start", "end", F.lit("."), "strand", F.lit("."), F.concat(F.lit("Name=x;ID="), "id"))
    lines = g.select(F.col("file_ord").alias("ord"), line.alias("value"))
    return side.genes_of(side.decode_features(lines)).select("file_ord", "seqid", "start", "end", "strand", "id")


@query
def gff_filter(spark, d):
    some = side.filter_features(bridge.genes(spark, d), "chr1", 300, 900, ["gene", "CDS"])
    return side.features_as_bed(some)


@query
def gene_annotation(spark, d):
    genes = side.genes_of(bridge.genes(spark, d))
    return annotate.annotate_regions(bridge.gene_selectors(spark, d), genes)


@query
def feature_classify(spark, d):
    p = bridge.table(spark, d, "orders").select(F.lit("chr1").alias("chrom"), ((F.col("o_orderkey") * 13) % 2600).cast("int").alias("pos"), F.col("o_orderkey").alias("ord"))
    return annotate.classify_positions(p, bridge.genes(spark, d)).select("ord", "pos", "category", palette.category_color(F.col("category")).alias("color"))


@query
def annotation_table(spark, d):
    v = bridge.view_of(spark, d, bridge.nation_selectors(spark, d), genes=side.genes_of(bridge.genes(spark, d)))
    return display.annotation_rows(v.selectors, v.annotation)


@query
def pop_totals(spark, d):
    return population.population_totals(bridge.populations(spark, d))


@query
def pop_counts(spark, d):
    return population.population_counts(_view(spark, d, 1, 4).labelled, bridge.populations(spark, d)).drop("sel_ord")


@query
def pop_crosstab(spark, d):
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return population.population_table(_view(spark, d, 1, 4).labelled, bridge.populations(spark, d), names).drop("sel_ord")


@query
def pop_network(spark, d):
    return population.network_populations(_view(spark, d, 1, 4).labelled, bridge.populations(spark, d)).drop("sel_ord")


@query
def geo_counts(spark, d):
    return _view(spark, d, 1, 3, geo=bridge.geo(spark, d)).place_counts().drop("sel_ord")


@query
def geo_extents(spark, d):
    e = population.extents(_view(spark, d, 1, 3, geo=bridge.geo(spark, d)).place_counts()).drop("sel_ord")
    return e.select(*[F.round(c, 6).alias(c) for c in e.columns])


@query
def pie_wedges(spark, d):
    places = _view(spark, d, 1, 3, geo=bridge.geo(spark, d)).place_counts()
    w = population.pie_wedges(places, ["sel_ord", "lon", "lat"], "label")
    return w.select("lon", "lat", "label", "n", F.round("start_angle", 6).alias("start_angle"), F.round("end_angle", 6).alias("end_angle"))


@query
def symbol_radius(spark, d):
    r = population.symbol_radii(_view(spark, d, 1, 3, geo=bridge.geo(spark, d)).place_counts())
    return r.select("lon", "lat", "total", F.round("radius", 6).alias("radius"))


@query
def size_breaks(spark, d):
    t = population.symbol_radii(_view(spark, d, 1, 3, geo=bridge.geo(spark, d)).place_counts())
    return population.size_breaks(t).select(F.posexplode("breaks").alias("place", "value"))


def _haps(spark, d, end=3):
    return _view(spark, d, 1, end).network_input()


@query
def pairwise_hamming(spark, d):
    return network.pair_distances(_haps(spark, d, 4)).drop("net_id")


@query
def pairwise_state_diff(spark, d):
    return network.pair_distances(_haps(spark, d, 4), "site").drop("net_id")


def _bases(spark, d):
    """Sequences of bases: the label cells of a haplotype's first characters."""
    v = _view(spark, d, 1, 4)
    rows = v.summary.join(display.site_lists(v.sites), "sel_ord")
    cells = genotype.hap_cells(F.col("hap"), F.col("alleles"))
    return rows.select((F.col("rank") - 1).alias("id"), F.array_join(F.transform(cells, lambda c: F.substring(c, 1, 1)), "").alias("sequence"))


@query
def packed_hamming(spark, d):
    s = _bases(spark, d).withColumn("packed", sequences.pack(F.col("sequence")))
    a, b = s.select(F.col("id").alias("i"), F.col("packed").alias("p"), F.lit(0).alias("k")), s.select(F.col("id").alias("j"), F.col("packed").alias("q"), F.lit(0).alias("k"))
    return a.join(b, "k").filter("i < j").select("i", "j", sequences.packed_distance(F.col("p"), F.col("q")).alias("d"))


@query
def intermediates(spark, d):
    s = _haps(spark, d)
    first = s.filter("id = 0").select("net_id", F.col("sequence").alias("a"))
    both = s.filter("id > 0").join(first, "net_id").withColumn("step", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return both.select("id", "step", sequences.intermediate(F.col("a"), F.col("sequence"), F.col("step"), F.lit(3)).alias("sequence"))


@query
def quasi_medians(spark, d):
    s = _bases(spark, d)
    a, b, c = (s.select(F.col("id").alias(i), F.col("sequence").alias(q), F.lit(0).alias("k")) for i, q in (("i", "a"), ("j", "b"), ("l", "c")))
    three = a.join(b, "k").filter("i < j").join(c, "k").filter("j < l")
    out = three.withColumn("median", F.explode(sequences.quasi_medians(F.col("a"), F.col("b"), F.col("c"))))
    return out.select("i", "j", "l", "median", sequences.median_cost(F.col("a"), F.col("b"), F.col("c"), F.col("median")).alias("cost"))


@query
def network_msn(spark, d):
    return network.edges_of(network.network_parts(_haps(spark, d), "msn")).drop("net_id")


@query
def network_tcs(spark, d):
    return network.edges_of(network.network_parts(_haps(spark, d), "tcs")).drop("net_id")


@query
def network_nodes(spark, d):
    parts = network.network_parts(_haps(spark, d), "tcs")
    return network.nodes_of(parts).groupBy("is_median").agg(F.count("*").alias("nodes"))


@query
def network_mjn(spark, d):
    """Median joining with epsilon 0 has the spanning tree's edges."""
    return network.edges_of(network.network_parts(_haps(spark, d), "mjn")).drop("net_id")


@query
def network_mjn_medians(spark, d):
    return network.edges_of(network.network_parts(_haps(spark, d), "mjn", epsilon=2)).drop("net_id")


@query
def network_msn_batch(spark, d):
    """A network for each nation's window, all in one plan."""
    v = bridge.view_of(spark, d, bridge.nation_selectors(spark, d))
    edges = network.edges_of(network.network_parts(v.network_input(), "msn"))
    return edges.groupBy("net_id").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


def _msn(spark, d):
    haps = _haps(spark, d)
    parts = network.network_parts(haps, "msn")
    counts = haps.select("net_id", "id", "count")
    nodes = geometry.node_radii(network.nodes_of(parts).join(counts, ["net_id", "id"], "left"))
    return nodes, network.edges_of(parts)


@query
def degree(spark, d):
    return network.degrees(*_msn(spark, d)).drop("net_id")


@query
def bfs_hops(spark, d):
    return network.shortest_paths(*_msn(spark, d)).drop("net_id")


@query
def node_radius(spark, d):
    return _msn(spark, d)[0].select("id", "count", F.round("radius", 6).alias("radius"))


@query
def size_legend(spark, d):
    out = geometry.size_legend(_msn(spark, d)[0])
    return out.select("n", F.round("radius", 6).alias("radius"), F.round("center_y", 6).alias("center_y"))


@query
def network_layout(spark, d):
    return geometry.layout(*_msn(spark, d)).drop("net_id")


def _segments(spark, d):
    """The spanning tree on a fixed grid."""
    nodes, edges = _msn(spark, d)
    placed = nodes.select("net_id", "id", (F.col("id") % 5 * 4.0).alias("x"), (F.floor(F.col("id") / 5) * 4.0).alias("y"), "radius")
    return geometry.edge_segments(edges, placed)


@query
def edge_segments(spark, d):
    s = _segments(spark, d)
    return s.select("source", "target", "weight", *[F.round(c, 6).alias(c) for c in ("sx", "sy", "ex", "ey")])


@query
def edge_ticks(spark, d):
    t = geometry.edge_ticks(_segments(spark, d))
    return t.select("source", "target", "k", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "x0", "y0", "x1", "y1")])


@query
def population_colors(spark, d):
    v = _view(spark, d, 1, 4)
    slices = population.network_populations(v.labelled, bridge.populations(spark, d)).join(v.summary.select("sel_ord", "label", "rank"), ["sel_ord", "label"])
    return geometry.population_colors(slices.select(F.col("sel_ord").alias("net_id"), F.col("rank").alias("hap_ord"), "population")).drop("net_id")


@query
def allele_set(spark, d):
    cells = _view(spark, d, 1, 20).sites.select("sel_ord", F.col("allele").alias("cell"))
    return geometry.allele_colors(display.allele_tokens(cells)).drop("sel_ord")


@query
def palette_dark(spark, d):
    p = geometry.palette_frame(spark)
    return p.select("idx", "color", palette.is_dark(F.col("color")).alias("dark"))


@query
def indel_footnotes(spark, d):
    v = _view(spark, d, 1, 20)
    return display.footnotes(v.sites).select("footnote")


@query
def region_title(spark, d):
    return display.region_titles(_view(spark, d, 5, 12).sites).select("title")


@query
def display_table(spark, d):
    return _view(spark, d, 6, 8, populations=bridge.populations(spark, d)).display_cells().drop("sel_ord")


@query
def summary_tsv(spark, d):
    return _view(spark, d, 1, 3).summary_lines().select("line_no", "value")


@query
def result_tsv(spark, d):
    return _view(spark, d, 1, 3).result_lines().select("line_no", "value")


@query
def view_json(spark, d):
    return _view(spark, d, 1, 3, genes=side.genes_of(bridge.genes(spark, d))).json("both").select("json")


@query
def view_jsonl(spark, d):
    return record_json(bridge.view_of(spark, d, bridge.nation_selectors(spark, d)), "summary")


@query
def network_json(spark, d):
    return network.network_json(network.network_parts(_haps(spark, d), "msn")).select("json")
