"""The display table of a region, cell by cell, and the lines of the written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusflow.functions.genotype import annotation_text, hap_cells, info_cells
from locusflow.operators.grouping import haplotype_samples

LONG_ALLELE = 2


def site_lists(sites: DataFrame) -> DataFrame:
    """``sel_ord, chroms, positions, alleles`` as arrays in site order."""
    x = F.array_sort(F.collect_list(F.struct("variant_ord", "chrom", "pos", "allele")))
    per = sites.groupBy("sel_ord").agg(x.alias("x"))
    take = lambda name: F.transform("x", lambda s: s[name].cast("string"))
    return per.select("sel_ord", take("chrom").alias("chroms"), take("pos").alias("positions"), take("allele").alias("alleles"))


def _line(*cells) -> Column:
    return F.array_join(F.concat(*[c if isinstance(c, Column) else F.array(F.lit(c)) for c in cells]), "\t")


def _head(counters: DataFrame, sites: DataFrame, annotation: DataFrame | None, last: list[str]) -> DataFrame:
    """The four head rows of both tables as ``sel_ord, part, value``."""
    none = F.array().cast("array<string>")
    base = counters.join(site_lists(sites), "sel_ord", "left")
    for name in ("chroms", "positions", "alleles"):
        base = base.withColumn(name, F.coalesce(name, none))
    if annotation is None:
        base = base.withColumn("text", F.lit("NA")).withColumn("annotated", F.lit(False))
    else:
        text = annotation.select("sel_ord", annotation_text(F.col("mode"), F.col("id"), F.col("distance")).alias("text"), (F.col("mode") != "none").alias("annotated"))
        base = base.join(text, "sel_ord", "left")
    info = info_cells(F.size("alleles"), F.coalesce("annotated", F.lit(False)), F.col("text"))
    number = lambda name: F.array(F.col(name).cast("string"))
    lines = F.array(
        _line("CHR", F.col("chroms"), "Haplotypes: ", number("haplotype_count")),
        _line("POS", F.col("positions"), "Individuals: ", number("sample_count")),
        _line("INFO", info, "Variants: ", number("variant_count")),
        _line("ALLELE", F.col("alleles"), F.array(*[F.lit(x) for x in last])),
    )
    return base.select("sel_ord", F.posexplode(lines).alias("part", "value"))


def summary_lines(counters: DataFrame, sites: DataFrame, summary: DataFrame, accessions: DataFrame, annotation: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """``sel_ord, line_no, value``: head rows, then a row per haplotype with its members and count."""
    head = _head(counters, sites, annotation, ["Accession", "freq"])
    rows = summary.join(haplotype_samples(accessions), ["sel_ord", "hap"]).join(site_lists(sites), "sel_ord")
    cells = hap_cells(F.col("hap"), F.col("alleles"), exact)
    body = rows.select("sel_ord", (F.col("rank") + 3).alias("part"), _line(F.array("label"), cells, F.array("samples", F.col("count").cast("string"))).alias("value"))
    return head.unionByName(body).select("sel_ord", (F.col("part") + 1).cast("long").alias("line_no"), "value")


def result_lines(counters: DataFrame, sites: DataFrame, labelled: DataFrame, annotation: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """``sel_ord, line_no, value``: head rows, then a row per kept sample in sample order; numbers may have gaps."""
    head = _head(counters, sites, annotation, ["Accession"])
    rows = labelled.join(site_lists(sites), "sel_ord")
    cells = hap_cells(F.col("hap"), F.col("alleles"), exact)
    body = rows.select("sel_ord", (F.col("sample_ord") + 4).alias("part"), _line(F.array("label"), cells, F.array("sample")).alias("value"))
    return head.unionByName(body).select("sel_ord", (F.col("part") + 1).cast("long").alias("line_no"), "value")


def annotation_rows(selectors: DataFrame, annotation: DataFrame) -> DataFrame:
    """``sel_ord, chr, start, end, ann`` with the selector's own coordinates."""
    text = annotation.select("sel_ord", annotation_text(F.col("mode"), F.col("id"), F.col("distance")).alias("ann"))
    return selectors.join(text, "sel_ord", "left").select("sel_ord", F.col("chrom").alias("chr"), "start", "end", F.coalesce("ann", F.lit("NA")).alias("ann"))


def region_titles(sites: DataFrame) -> DataFrame:
    """``sel_ord, title``: the first site's chromosome, and the smallest and largest position as text."""
    per = sites.groupBy("sel_ord").agg(F.min_by("chrom", "variant_ord").alias("c"), F.min(F.col("pos").cast("string")).alias("a"), F.max(F.col("pos").cast("string")).alias("b"))
    return per.select("sel_ord", F.concat("c", F.lit(":"), "a", F.lit("-"), "b").alias("title"))


def allele_tokens(cells: DataFrame) -> DataFrame:
    """``sel_ord, allele``: the distinct alleles in ``cells(sel_ord, cell)``; empty, ``NA`` and ``.`` do not count."""
    token = F.explode(F.transform(F.split("cell", "[/,]"), F.trim))
    return cells.select("sel_ord", token.alias("allele")).filter(~F.col("allele").isin("", "NA", ".")).distinct()


def footnotes(sites: DataFrame) -> DataFrame:
    """``sel_ord, notes, footnote``: alleles longer than two characters in order, and ``i1:...; i2:...``."""
    token = sites.select("sel_ord", F.explode(F.transform(F.split("allele", "[/,]"), F.trim)).alias("t")).filter(F.char_length("t") > LONG_ALLELE)
    per = token.groupBy("sel_ord").agg(F.array_sort(F.collect_set("t")).alias("notes"))
    text = F.array_join(F.transform("notes", lambda t, i: F.concat(F.lit("i"), (i + 1).cast("string"), F.lit(":"), t)), "; ")
    return per.select("sel_ord", "notes", text.alias("footnote"))


def shorten(cell: Column, notes: Column) -> Column:
    """A cell with the notes' alleles replaced by their numbers, one after the other."""
    numbered = F.transform(notes, lambda t, i: F.struct(t.alias("t"), F.concat(F.lit("i"), (i + 1).cast("string")).alias("n")))
    return F.coalesce(F.aggregate(numbered, cell, lambda c, x: F.replace(c, x["t"], x["n"])), cell)


def display_cells(counters: DataFrame, sites: DataFrame, summary: DataFrame, labelled: DataFrame, populations: DataFrame | None = None) -> DataFrame:
    """``sel_ord, row_ord, row, col_ord, cell``: the table as it is shown.

    POS, ALLELE and haplotype rows; sites, then ``n/total`` per population by name, then ``n/N`` over all selected samples.
    Long alleles are replaced by their footnote numbers.
    """
    from locusflow.operators.population import population_counts, share_text

    lists = site_lists(sites)
    notes = footnotes(sites).select("sel_ord", "notes")
    width = lists.select("sel_ord", F.size("alleles").alias("width"))
    cell = lambda df, names: df.join(notes, "sel_ord", "left").select(*names, "col_ord", shorten(F.col("cell"), F.col("notes")).alias("cell"))
    names = ["sel_ord", "row_ord", "row"]
    head = lists.select("sel_ord", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("POS").alias("row"), F.col("positions").alias("c")), F.struct(F.lit(1).alias("o"), F.lit("ALLELE").alias("row"), F.col("alleles").alias("c")))).alias("x"))
    head = head.select("sel_ord", F.col("x.o").alias("row_ord"), F.col("x.row").alias("row"), F.posexplode("x.c").alias("col_ord", "cell"))
    rows = summary.join(lists, "sel_ord").select("sel_ord", (F.col("rank") + 1).alias("row_ord"), F.col("label").alias("row"), F.posexplode(hap_cells(F.col("hap"), F.col("alleles"))).alias("col_ord", "cell"))
    shown = cell(head.unionByName(rows), names)
    n = counters.select("sel_ord", "sample_count")
    own = summary.join(n, "sel_ord").join(width, "sel_ord")
    n_pops = F.lit(0)
    parts = [shown]
    if populations is not None:
        counts = population_counts(labelled, populations)
        counts = counts.withColumn("p", F.dense_rank().over(W.partitionBy("sel_ord", "label").orderBy("population")) - 1)
        k = populations.agg(F.count_distinct("population").cast("int").alias("k"))
        own, n_pops = own.join(F.broadcast(k)), F.col("k")  # k is one row
        spread = counts.join(summary.select("sel_ord", "label", "rank"), ["sel_ord", "label"]).join(width, "sel_ord")
        parts.append(spread.select("sel_ord", (F.col("rank") + 1).alias("row_ord"), F.col("label").alias("row"), (F.col("width") + F.col("p")).alias("col_ord"), share_text(F.col("n"), F.col("total")).alias("cell")))
        heads = spread.select("sel_ord", F.lit(1).alias("row_ord"), F.lit("ALLELE").alias("row"), (F.col("width") + F.col("p")).alias("col_ord"), F.col("population").alias("cell")).distinct()
        parts.append(heads)
    parts.append(own.select("sel_ord", (F.col("rank") + 1).alias("row_ord"), F.col("label").alias("row"), (F.col("width") + n_pops).alias("col_ord"), share_text(F.col("count"), F.col("sample_count")).alias("cell")))
    parts.append(own.select("sel_ord", F.lit(1).alias("row_ord"), F.lit("ALLELE").alias("row"), (F.col("width") + n_pops).alias("col_ord"), F.lit("n/N").alias("cell")).distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
