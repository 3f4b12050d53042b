"""``view``: every result of one call for any number of selectors, as lazy DataFrames over one plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.operators import annotate, calls, display, grouping, network, population


@dataclass(frozen=True)
class HapView:
    """The frames of a view. ``variants`` and ``calls`` carry ``sel_ord``; nothing runs until a frame is used."""

    selectors: DataFrame
    samples: DataFrame
    variants: DataFrame
    calls: DataFrame
    genes: DataFrame | None = None
    populations: DataFrame | None = None
    geo: DataFrame | None = None
    by: str = "region"
    impute: bool = False
    max_diff: float | None = None
    bed_zero_based: bool = False

    @cached_property
    def profiles(self) -> DataFrame:
        return grouping.sample_profiles(self.calls, self.impute)

    @cached_property
    def accessions(self) -> DataFrame:
        """``sel_ord, sample_ord, sample, hap``; ``leader`` too for approximate groups."""
        return self.profiles if self.max_diff is None else grouping.approximate_groups(self.profiles, self.max_diff)

    @cached_property
    def summary(self) -> DataFrame:
        return grouping.summarize(self.accessions)

    @cached_property
    def labelled(self) -> DataFrame:
        return grouping.label_accessions(self.accessions, self.summary)

    @cached_property
    def sites(self) -> DataFrame:
        return grouping.sites(self.variants)

    @cached_property
    def counters(self) -> DataFrame:
        return grouping.counters(self.selectors, self.variants, self.samples, self.accessions)

    @cached_property
    def annotation(self) -> DataFrame | None:
        """Regions of BED records are looked up one base further right than they are scanned."""
        if self.genes is None:
            return None
        bed = F.col("type") == "bed-record"
        start = F.when(bed & ~F.lit(self.bed_zero_based), F.col("start") + 1).otherwise(F.col("start"))
        return annotate.annotate_regions(self.selectors.select("sel_ord", "chrom", start.alias("start"), "end"), self.genes)

    @property
    def exact(self) -> bool:
        return self.max_diff is None

    @property
    def grouping_mode(self) -> str:
        return f"{'strict' if self.exact else 'approx'}-{self.by}"

    def summary_lines(self) -> DataFrame:
        return display.summary_lines(self.counters, self.sites, self.summary, self.accessions, self.annotation, self.exact)

    def result_lines(self) -> DataFrame:
        return display.result_lines(self.counters, self.sites, self.labelled, self.annotation, self.exact)

    def display_cells(self) -> DataFrame:
        return display.display_cells(self.counters, self.sites, self.summary, self.labelled, self.populations)

    def place_counts(self) -> DataFrame:
        return population.place_counts(self.labelled, self.geo)

    def network_input(self) -> DataFrame:
        """``net_id, id, sequence, samples, label``: haplotypes in rank order, approximate groups by their leader's profile."""
        haps = self.summary
        if self.exact:
            haps = haps.withColumn("sequence", F.col("hap"))
        else:
            leaders = self.accessions.select("sel_ord", "hap", F.col("leader").alias("sequence")).distinct()
            haps = haps.join(leaders, ["sel_ord", "hap"])
        return haps.select(
            F.col("sel_ord").cast("long").alias("net_id"), (F.col("rank") - 1).alias("id"), "sequence",
            F.array_repeat("label", F.greatest("count", F.lit(1))).alias("samples"), "label", "count",
        )

    def network(self, method: str = "tcs", epsilon: int = 0, metric: str = "char") -> DataFrame:
        return network.network_parts(self.network_input(), method, epsilon, metric)

    def json(self, output: str = "summary") -> DataFrame:
        """``sel_ord, json``: one compact object per selector with its keys in order."""
        return view_json(self, output)


def _quoted(pairs: list[tuple[str, Column]]) -> Column:
    """An object of ``pairs`` in key order; a key whose text is null is left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(pairs, key=lambda p: p[0])]
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}"))


def _text(c: Column) -> Column:
    """A string as JSON text."""
    x = F.to_json(F.array(c))
    return F.substr(x, F.lit(2), F.char_length(x) - 2)


def view_json(view: HapView, output: str = "summary", extra: list[tuple[str, Column]] | None = None) -> DataFrame:
    if output not in ("summary", "detail", "both"):
        raise ValueError("output must be summary, detail or both")
    site = F.array_sort(F.collect_list(F.struct("variant_ord", "allele", "chrom", "pos")))
    sites = view.sites.groupBy("sel_ord").agg(F.to_json(F.transform(site, lambda s: F.struct(s["allele"].alias("allele"), s["chrom"].alias("chrom"), s["pos"].alias("pos")))).alias("sites"))
    base = view.selectors.join(view.counters, "sel_ord").join(sites, "sel_ord", "left")
    none = F.lit("[]")
    pairs = [
        ("grouping_method", F.lit('"exact"' if view.exact else '"max-diff"')),
        ("grouping_mode", F.lit(f'"{view.grouping_mode}"')),
        ("haplotype_count", F.col("haplotype_count").cast("string")),
        ("imputed_ref", F.lit("true" if view.impute else "false")),
        ("max_diff", F.lit("null" if view.exact else repr(float(view.max_diff)))),
        ("output_mode", F.lit(f'"{output}"')),
        ("sample_count", F.col("sample_count").cast("string")),
        ("variant_count", F.col("variant_count").cast("string")),
        ("sites", F.coalesce("sites", none)),
        *(extra or []),
    ]
    if output != "detail":
        ranked = F.array_sort(F.collect_list(F.struct("rank", "count", "hap")))
        haps = view.summary.groupBy("sel_ord").agg(F.to_json(F.transform(ranked, lambda h: F.struct(h["count"].alias("count"), h["hap"].alias("hap")))).alias("haps"))
        base = base.join(haps, "sel_ord", "left")
        pairs.append(("haplotypes", F.coalesce("haps", none)))
    if output != "summary":
        members = F.array_sort(F.collect_list(F.struct("sample_ord", "hap", "sample")))
        accs = view.accessions.groupBy("sel_ord").agg(F.to_json(F.transform(members, lambda a: F.struct(a["hap"].alias("hap"), a["sample"].alias("sample")))).alias("accs"))
        base = base.join(accs, "sel_ord", "left")
        pairs.append(("accessions", F.coalesce("accs", none)))
    if view.annotation is not None:
        fields = ["distance", "end", "id", "mode", "seqid", "start", "strand"]
        ann = view.annotation.select("sel_ord", F.to_json(F.struct(*fields)).alias("ann"))  # null fields are left out
        base = base.join(ann, "sel_ord", "left")
        pairs.append(("annotation", F.col("ann")))
    return base.select("sel_ord", _quoted(pairs).alias("json"))


def record_json(view: HapView, output: str = "summary", plot: bool = False) -> DataFrame:
    """``sel_ord, json``: the view's object with its selector and the options asked for, one per line of a JSONL file."""
    kind = F.col("type")
    selector = (
        F.when(kind == "site", F.to_json(F.struct("chrom", F.col("start").alias("pos"), "type")))
        .when(kind == "region", F.to_json(F.struct("chrom", "end", "start", "type")))
        .otherwise(F.to_json(F.struct("chrom", "end", "record_id", "start", "type")))
    )
    flag = lambda x: F.lit("true" if x else "false")
    extra = [("selector", selector), ("plot_requested", flag(plot)), ("gff3_enabled", flag(view.genes is not None))]
    if plot:
        extra.append(("plot_backend", F.lit('"geometry"')))
    return view_json(view, output, extra)


def view(
    variants: DataFrame,
    samples: DataFrame,
    selectors: DataFrame,
    genes: DataFrame | None = None,
    populations: DataFrame | None = None,
    geo: DataFrame | None = None,
    by: str = "region",
    impute: bool = False,
    max_diff: float | None = None,
    overlap: str = "record",
    bed_zero_based: bool = False,
) -> HapView:
    """A view of wide ``variants`` (``sources.vcf``) for ``samples`` and ``selectors``.

    All selectors go through one range join and one aggregation, after a filter on their outer bounds that the scan can use; of the
    genotypes only the wanted samples' are unfolded. ``genes`` are gene features, ``populations`` and ``geo`` the side tables.
    With ``bed_zero_based`` the start of BED records is moved by one for the scan, too.
    """
    if max_diff is not None and not 0 <= max_diff <= 1:
        raise ValueError(f"the share of differing sites lies between 0 and 1, not at {max_diff}")
    if bed_zero_based:
        selectors = selectors.withColumn("start", F.when(F.col("type") == "bed-record", F.col("start") + 1).otherwise(F.col("start")))
    chosen = calls.select_variants(calls.prune(variants, selectors, overlap), selectors, overlap)
    return HapView(selectors, samples, chosen, _calls(chosen, samples), genes, populations, geo, by, impute, max_diff, bed_zero_based)


def _calls(chosen: DataFrame, samples: DataFrame) -> DataFrame:
    wanted = sorted(r["column"] for r in samples.select("column").distinct().collect())  # a header's length at most
    if wanted == list(range(len(wanted))):
        each = F.posexplode(F.slice("genotypes", 1, max(1, len(wanted)))).alias("column", "g")
        long = chosen.select("sel_ord", "variant_ord", each)
    else:
        each = F.transform(F.from_json(F.lit(str(wanted)), "array<int>"), lambda i: F.struct(i.alias("column"), F.get("genotypes", i).alias("g")))
        long = chosen.select("sel_ord", "variant_ord", F.explode(each).alias("x")).select("sel_ord", "variant_ord", "x.*")
    return long.join(samples, "column").select("sel_ord", "variant_ord", "sample_ord", "sample", F.col("g.a1").alias("a1"), F.col("g.a2").alias("a2"))
