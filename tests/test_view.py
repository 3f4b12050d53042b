import json
import subprocess
import sys
from xml.etree import ElementTree

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusflow.operators import display, grouping
from locusflow.plans.view import record_json, view
from locusflow.sources import selectors, side, sinks, vcf
from tests import data


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("v")
    for name, text in (("x.vcf", data.vcf()), ("a.gff", data.GFF), ("p.tsv", data.POPULATIONS), ("g.tsv", data.GEO)):
        (d / name).write_text(text)
    return {
        "variants": vcf.read_variants(spark, str(d / "x.vcf")).cache(),
        "samples": vcf.sample_frame(spark, data.SAMPLES),
        "genes": side.genes_of(side.read_features(spark, str(d / "a.gff"))),
        "populations": side.read_populations(spark, str(d / "p.tsv")),
        "geo": side.read_geo(spark, str(d / "g.tsv")),
        "dir": d,
    }


def make(spark, parts, region, **options):
    sel = selectors.from_regions(spark, region if isinstance(region, list) else [region])
    return view(parts["variants"], options.pop("samples", parts["samples"]), sel, **options)


def haps(v):
    return [(r.label, r.hap, r["count"]) for r in v.summary.orderBy("rank").collect()]


def test_exact_groups(spark, parts):
    v = make(spark, parts, "ctg_1:100-200")
    # S4 has a missing call; the others are homozygous throughout
    assert haps(v) == [("H001", "1/1|0/0|1/1", 2), ("H002", "0/0|0/0|0/0", 1), ("H003", "0/0|0/0|1/1", 1), ("H004", "0/0|2/2|0/0", 1)]
    assert tuple(v.counters.first())[1:] == (3, 6, 4)


def test_impute_never_rescues_heterozygotes(spark, parts):
    v = make(spark, parts, "ctg_1:100-250", impute=True)
    assert {r.sample for r in v.accessions.collect()} == {"S1", "S2", "S4", "S5", "S6"}


def test_site_and_empty_region(spark, parts):
    assert haps(make(spark, parts, "ctg_1:100", by="site")) == [("H001", "0/0", 4), ("H002", "1/1", 2)]
    v = make(spark, parts, ["ctg_1:300-400", "other:1-5"])
    assert haps(v) == [] and [tuple(r)[1:] for r in v.counters.collect()] == [(0, 6, 0)] * 2


def test_record_overlap(spark, parts):
    assert make(spark, parts, "ctg_1:181-182").variants.count() == 1
    assert make(spark, parts, "ctg_1:181-182", overlap="pos").variants.count() == 0


def test_stored_regions_are_pruned(spark, parts, tmp_path):
    """The scan gets the region's bounds, and both overlap rules give what the text gives."""
    vcf.store_variants(parts["variants"], str(tmp_path / "v"))
    stored = vcf.read_stored(spark, str(tmp_path / "v"))
    for region in ("ctg_1:181-182", "ctg_1:100-200", "ctg_1:145", "other:1-9"):
        for overlap in ("record", "pos"):
            sel = selectors.from_regions(spark, [region])
            v = view(stored, parts["samples"], sel, overlap=overlap)
            assert haps(v) == haps(view(parts["variants"], parts["samples"], sel, overlap=overlap))
    plan = view(stored, parts["samples"], selectors.from_regions(spark, ["ctg_1:100-200"])).variants._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(pos,200)" in plan and "GreaterThanOrEqual(last,100)" in plan


def test_samples_are_picked_before_genotypes_unfold(spark, parts):
    two = vcf.sample_frame(spark, data.SAMPLES, ["S6", "S2"])
    v = make(spark, parts, "ctg_1:100-200", samples=two)
    assert sorted((r.sample, r.variant_ord) for r in v.calls.collect()) == sorted((r.sample, r.variant_ord) for r in make(spark, parts, "ctg_1:100-200").calls.collect() if r.sample in ("S6", "S2"))


def test_subset_keeps_list_order(spark, parts):
    v = make(spark, parts, "ctg_1:100-145", samples=vcf.sample_frame(spark, data.SAMPLES, ["S6", "S1"]))
    assert [r.sample for r in v.accessions.orderBy("sample_ord").collect()] == ["S6", "S1"]


def leaders(profiles, limit):
    """A plain loop over samples in order."""
    found, out = [], []
    for p in profiles:
        x = p.split("|")
        for k, y in enumerate(found):
            if sum(a != b for a, b in zip(x, y)) / max(len(x), len(y)) <= limit:
                out.append(f"A{k + 1:03d}")
                break
        else:
            found.append(x)
            out.append(f"A{len(found):03d}")
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["0/0", "1/1", "2/2"]), min_size=4, max_size=4), min_size=1, max_size=12), st.sampled_from([0.0, 0.25, 0.5, 1.0]))
def test_approximate_groups_match_a_loop(spark, states, limit):
    profiles = ["|".join(s) for s in states]
    df = spark.createDataFrame([(0, i, f"S{i}", p) for i, p in enumerate(profiles)], "sel_ord int, sample_ord int, sample string, hap string")
    got = [r.hap for r in grouping.approximate_groups(df, limit).orderBy("sample_ord").collect()]
    assert got == leaders(profiles, limit)


def test_annotation(spark, parts):
    v = make(spark, parts, ["ctg_1:100-200", "ctg_1:300-340", "ctg_1:261-399", "ctg_1:600-700", "none:1-2"], genes=parts["genes"])
    rows = {r.sel_ord: (r.mode, r.id, r.distance) for r in v.annotation.collect()}
    assert rows == {0: ("overlap", "geneA", None), 1: ("nearest", "geneA", 40), 2: ("nearest", "geneA", 1), 3: ("nearest", "geneB", 100), 4: ("none", None, None)}


def test_classify(spark, parts):
    from locusflow.operators.annotate import classify_positions

    f = side.read_features(spark, str(parts["dir"] / "a.gff"))
    p = spark.createDataFrame([("ctg_1", x) for x in (100, 120, 160, 200, 300, 450)], "chrom string, pos int")
    assert [r.category for r in classify_positions(p, f).orderBy("pos").collect()] == ["5'UTR", "CDS", "exon", "intron", "intergenic", "intron"]


def test_written_tables(spark, parts, tmp_path):
    v = make(spark, parts, ["ctg_1:100-200", "ctg_1:145"], genes=parts["genes"])
    paths = sinks.table_paths(str(tmp_path / "out.tsv"), [sinks.slug_text("ctg_1", 100, 200), sinks.slug_text("ctg_1", 145, 145)])
    sinks.write_lines(v.summary_lines(), {i: p[0] for i, p in enumerate(paths)})
    sinks.write_lines(v.result_lines(), {i: p[1] for i, p in enumerate(paths)})
    assert paths[0][0].name == "out.hap_summary_ctg_1_100_200.tsv"
    lines = paths[0][0].read_text().splitlines()
    assert lines[0] == "CHR\tctg_1\tctg_1\tctg_1\tHaplotypes: \t4"
    assert lines[2] == "INFO\tgeneA\t.\t.\tVariants: \t3"
    assert lines[3] == "ALLELE\tG/C\tT/A,GG\tGCCTA/A\tAccession\tfreq"
    assert lines[4] == "H001\tC\tT\tA\tS1;S5\t2"
    assert paths[0][1].read_text().splitlines()[4:6] == ["H001\tC\tT\tA\tS1", "H003\tG\tT\tA\tS2"]
    sinks.write_line_folders(v.summary_lines(), v.selectors, str(tmp_path / "folders"))
    read = side.read_summary(spark, str(paths[0][0])).orderBy("line_no").collect()
    assert ["\t".join(r.cells) for r in read] == lines
    got = next((tmp_path / "folders" / "region=ctg_1_100_200").glob("part-*")).read_text().splitlines()
    assert got == lines


def test_json(spark, parts):
    v = make(spark, parts, "ctg_1:145", by="site", genes=parts["genes"])
    row = json.loads(v.json("both").first().json)
    assert list(row) == sorted(row) and row["max_diff"] is None and row["grouping_mode"] == "strict-site"
    assert row["annotation"] == {"end": 260, "id": "geneA", "mode": "overlap", "seqid": "ctg_1", "start": 90, "strand": "+"}
    assert row["haplotypes"][0] == {"count": 5, "hap": "0/0"} and len(row["accessions"]) == 6
    assert json.loads(record_json(v, "detail").first().json)["selector"] == {"chrom": "ctg_1", "pos": 145, "type": "site"}
    with pytest.raises(ValueError):
        v.json("all")


def test_display(spark, parts):
    v = make(spark, parts, "ctg_1:100-200", populations=parts["populations"])
    cells = {(r.row, r.col_ord): r.cell for r in v.display_cells().collect()}
    assert cells["ALLELE", 2] == "i1/A" and cells["ALLELE", 3] == "landrace" and cells["ALLELE", 5] == "n/N"
    assert cells["H001", 3] == "0/1" and cells["H001", 4] == "1/3" and cells["H001", 5] == "2/6"
    assert display.footnotes(v.sites).first().footnote == "i1:GCCTA"
    assert display.region_titles(v.sites).first().title == "ctg_1:100-179"


def test_places(spark, parts):
    from locusflow.operators import population

    p = make(spark, parts, "ctg_1:100", by="site", geo=parts["geo"]).place_counts()
    assert {(r.lon, r.label): r.n for r in p.collect()} == {(100.25, "H001"): 1, (100.25, "H002"): 1, (110.75, "H001"): 1, (110.75, "H002"): 0}
    assert {(r.lon, r.total) for r in population.symbol_radii(p).collect()} == {(100.25, 2), (110.75, 1)}


def test_command(parts, tmp_path):
    run = lambda *a: subprocess.run([sys.executable, "-m", "locusflow", "view", str(parts["dir"] / "x.vcf"), *a], capture_output=True, text=True, timeout=300)
    out = run("-r", "ctg_1:100-200", "-g", str(parts["dir"] / "a.gff"), "-p", str(parts["dir"] / "p.tsv"), "--geo", str(parts["dir"] / "g.tsv"), "--network", "--plot", "--output-file", str(tmp_path / "o"))
    assert out.returncode == 0, out.stderr[-2000:]
    names = {p.name for p in (tmp_path / "o").iterdir()}
    assert names == {"hap_summary.tsv", "hapresult.tsv", "gff_ann_summary.tsv", "ctg_1_100_200.json", "ctg_1_100_200_map.json", "ctg_1_100_200_network.json"}
    assert (tmp_path / "o" / "gff_ann_summary.tsv").read_text() == "chr\tstart\tend\tann\nctg_1\t100\t200\tgeneA\n"
    bad = run("-r", "ctg_1:100", "--by", "region")
    assert bad.returncode != 0 and "cannot be grouped by" in bad.stderr


def test_drawn_figures(spark, parts, tmp_path):
    from argparse import Namespace

    from locusflow.__main__ import figures as draw

    v = make(spark, parts, "ctg_1:100-200", populations=parts["populations"], geo=parts["geo"])
    args = Namespace(output_file=str(tmp_path / "s"), plot=True, plot_format="svg", network=True, network_method="tcs", epsilon=0, metric="char")
    assert set(draw(v, args, 0, 1, "ctg_1_100_200")) == {"plot_file", "geo_file", "network_file"}
    figures = sorted((tmp_path / "s").glob("*.svg"))
    assert [p.name for p in figures] == ["ctg_1_100_200.svg", "ctg_1_100_200_map.svg", "ctg_1_100_200_network.svg"]
    for p, least in zip(figures, (20, 2, 8), strict=True):
        root = ElementTree.parse(p).getroot()
        assert root.tag.endswith("svg") and len(root) >= least
    assert "GCCTA" not in figures[0].read_text() and "H001" in figures[2].read_text()
