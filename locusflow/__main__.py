"""``python -m locusflow view calls.vcf -r chr:start-end``: tables, JSON lines, figure geometry and networks."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="locusflow")
    p = top.add_subparsers(dest="command", required=True).add_parser("view")
    p.add_argument("input_vcf")
    p.add_argument("-r", "--region")
    p.add_argument("-R", "--regions-file")
    p.add_argument("-S", "--samples-file")
    p.add_argument("--by", choices=("auto", "region", "site"), default="auto")
    p.add_argument("--impute", action="store_true")
    p.add_argument("-g", "--gff3", "--gff", dest="gff")
    p.add_argument("--output", choices=("summary", "detail", "both"), default="summary")
    p.add_argument("--output-format", choices=("tsv", "jsonl"), default="tsv")
    p.add_argument("--output-file")
    p.add_argument("--plot", action="store_true")
    p.add_argument("--plot-format", choices=("json", "svg"), default="json")
    p.add_argument("-p", "--population")
    p.add_argument("--max-diff", type=float)
    p.add_argument("--geo")
    p.add_argument("--network", action="store_true")
    p.add_argument("--network-method", choices=("tcs", "msn", "mjn"), default="tcs")
    p.add_argument("--epsilon", type=int, default=0)
    p.add_argument("--metric", choices=("char", "site"), default="char")
    return top


def figures(view, args, index: int, count: int, region: str) -> dict[str, str]:
    """Write the geometry of one selector's figures; the files' names by kind."""
    from locusflow.operators import geometry, network, population
    from locusflow.sources import sinks

    out = {}

    def write(kind: str, frames: dict, part: str = "") -> str:
        target = sinks.figure_path(args.output_file, region, index, count, args.plot_format, part)
        return str((sinks.write_svg(kind, frames, target) if args.plot_format == "svg" else sinks.write_geometry(frames, target)).resolve())

    if args.plot:
        frames = {"cells": view.display_cells().drop("sel_ord").orderBy("row_ord", "col_ord")}
        if view.genes is not None:
            frames["annotation"] = view.annotation.drop("sel_ord")
        out["plot_file"] = write("table", frames)
    if view.geo is not None:
        places = view.place_counts()
        if not places.isEmpty():
            frames = {
                "wedges": population.pie_wedges(places, ["sel_ord", "lon", "lat"], "label"),
                "symbols": population.symbol_radii(places),
                "extent": population.extents(places),
            }
            out["geo_file"] = write("map", frames, "_map")
    if args.network:
        haps = view.network_input()
        if not haps.isEmpty():
            parts = network.network_parts(haps, args.network_method, args.epsilon, args.metric)
            nodes = geometry.node_radii(network.nodes_of(parts).join(haps.select("net_id", "id", "label", "count"), ["net_id", "id"], "left"))
            edges = network.edges_of(parts).withColumn("weight", F.greatest("weight", F.lit(1)))
            placed = geometry.layout(nodes, edges)
            segments = geometry.edge_segments(edges, placed)
            frames = {"nodes": nodes, "positions": placed, "edges": segments, "ticks": geometry.edge_ticks(segments), "sizes": geometry.size_legend(nodes)}
            if view.populations is not None:
                frames["slices"] = population.network_populations(view.labelled, view.populations)
            out["network_file"] = write("network", frames, "_network")
    return out


def main(argv: list[str] | None = None) -> int:
    from dataclasses import replace

    from locusflow.operators.display import annotation_rows
    from locusflow.plans.view import record_json, view
    from locusflow.sources import selectors, side, sinks, vcf

    top = parser()
    args = top.parse_args(argv)
    try:
        by = selectors.validate(args.region, args.regions_file, args.by, args.max_diff)
    except ValueError as e:
        top.error(str(e))
    spark = SparkSession.builder.appName("locusflow").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sel = selectors.from_regions(spark, [args.region]) if args.region else selectors.read_bed(spark, args.regions_file)
    wanted = vcf.read_samples(spark, args.samples_file) if args.samples_file else None
    genes = side.genes_of(side.read_features(spark, args.gff)) if args.gff else None
    populations = side.read_populations(spark, args.population) if args.population else None
    geo = side.read_geo(spark, args.geo) if args.geo else None
    samples = vcf.sample_frame(spark, vcf.header_samples(spark, args.input_vcf), wanted)
    whole = view(vcf.read_variants(spark, args.input_vcf), samples, sel, genes, populations, geo, by, args.impute, args.max_diff)
    rows = sel.orderBy("sel_ord").collect()  # the regions asked for by name
    slugs = [sinks.slug_text(r.chrom, r.start, r.end) for r in rows]
    files: dict[int, dict] = {r.sel_ord: {} for r in rows}
    if args.output_format == "tsv":
        paths = sinks.table_paths(args.output_file, slugs)
        sinks.write_lines(whole.summary_lines(), {r.sel_ord: p[0] for r, p in zip(rows, paths, strict=True)})
        sinks.write_lines(whole.result_lines(), {r.sel_ord: p[1] for r, p in zip(rows, paths, strict=True)})
    if args.plot or args.geo or args.network:
        for i, (r, region) in enumerate(zip(rows, slugs, strict=True)):
            here = F.col("sel_ord") == r.sel_ord
            one = replace(whole, selectors=sel.filter(here), variants=whole.variants.filter(here), calls=whole.calls.filter(here))
            files[r.sel_ord] = figures(one, args, i, len(rows), region)
    if args.gff:
        table = sinks.write_annotation(annotation_rows(whole.selectors, whole.annotation), sinks.output_folder(args.output_file))
        for extra in files.values():
            extra["gff_summary_file"] = str(table.resolve())
    if args.output_format == "jsonl":
        target = sinks.jsonl_path(args.output_file)
        text = sinks.write_jsonl(record_json(whole, args.output, args.plot), target if target is None else Path(target), files)
        if text is not None:
            sys.stdout.write(text)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
