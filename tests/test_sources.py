import pytest
from pyspark.sql import functions as F

from locusflow.sources import selectors, side, vcf
from tests import data


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    for name, text in (("x.vcf", data.vcf()), ("a.gff", data.GFF), ("p.tsv", data.POPULATIONS), ("g.tsv", data.GEO), ("r.bed", data.BED), ("s.txt", "S5\r\n\nS1\n")):
        (d / name).write_text(text, newline="")
    return d


def test_vcf(spark, files):
    assert vcf.header_samples(spark, str(files / "x.vcf")) == data.SAMPLES
    rows = vcf.read_variants(spark, str(files / "x.vcf")).orderBy("variant_ord").collect()
    assert [(r.chrom, r.pos, r.ref, r.alt) for r in rows] == [("ctg_1", p, r, [] if a == "." else a.split(",")) for p, r, a, _ in data.RECORDS]
    assert rows[0].genotypes[0].asDict() == {"a1": 1, "a2": 1, "phased": False} and rows[0].genotypes[3].phased
    assert rows[2].genotypes[3] is None and rows[4].genotypes[5] is None  # missing, haploid
    samples = vcf.sample_frame(spark, data.SAMPLES)
    assert vcf.calls_of(vcf.read_variants(spark, str(files / "x.vcf")), samples).count() == 30
    assert tuple(vcf.fetch_counts(vcf.read_variants(spark, str(files / "x.vcf")), samples).first()) == (5, 6)


def test_vcf_without_gt_is_an_error(spark):
    lines = spark.createDataFrame([(0, "c\t1\t.\tA\tC\t1\t.\t.\tDP\t3")], "ord long, value string")
    with pytest.raises(Exception, match="lacks GT"):
        vcf.decode_variants(lines).collect()


def test_samples(spark, files):
    assert vcf.read_samples(spark, str(files / "s.txt")) == ["S5", "S1"]
    assert [tuple(r) for r in vcf.sample_frame(spark, data.SAMPLES, ["S5", "S1", "S5"]).collect()] == [(0, "S5", 4), (1, "S1", 0), (2, "S5", 4)]
    with pytest.raises(ValueError, match="no sample named"):
        vcf.sample_frame(spark, data.SAMPLES, ["S7"])


def test_store(spark, files, tmp_path):
    v = vcf.read_variants(spark, str(files / "x.vcf"))
    vcf.store_variants(v, str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v")).filter("chrom = 'ctg_1' and pos >= 150")
    assert back.count() == 3


def test_selectors(spark, files):
    assert selectors.parse_region("chr1:5-2") == {"type": "region", "record_id": None, "chrom": "chr1", "start": 5, "end": 2}
    assert selectors.parse_region("chr1:7")["type"] == "site"
    for bad in ("chr1", "chr1:", ":5", "chr1:a-b", "chr1:5-", "chr1:x"):
        with pytest.raises(ValueError):
            selectors.parse_region(bad)
    rows = [tuple(r) for r in selectors.read_bed(spark, str(files / "r.bed")).orderBy("sel_ord").collect()]
    assert rows == [(1, "bed-record", "win1", "ctg_1", 100, 145), (3, "bed-record", "row3", "ctg_1", 145, 200)]
    short = spark.createDataFrame([(1, "ctg\t4")], "line_no int, value string")
    with pytest.raises(Exception, match="lacks its chromosome"):
        selectors.parse_bed_lines(short).collect()


@pytest.mark.parametrize(
    ("args", "want"),
    [(("c:1-2", None), "region"), (("c:1", None), "site"), ((None, "f"), "region"), (("c:1", None, "region"), None), ((None, None), None), (("c:1", "f"), None), ((None, "f", "site"), None), (("c:1", None, "auto", 1.5), None)],
)
def test_validate(args, want):
    if want is None:
        with pytest.raises(ValueError):
            selectors.validate(*args)
    else:
        assert selectors.validate(*args) == want


def test_side_tables(spark, files):
    f = side.read_features(spark, str(files / "a.gff"))
    assert f.count() == 5
    assert [r.id for r in side.genes_of(f).orderBy("start").collect()] == ["geneA", "geneB"]
    assert side.filter_features(f, "ctg_1", 140, 145, ["CDS"]).count() == 1
    assert {tuple(r) for r in side.read_populations(spark, str(files / "p.tsv")).collect()} == {("S1", "wild"), ("S2", "wild"), ("S3", "landrace"), ("S9", "wild")}
    assert side.read_geo(spark, str(files / "g.tsv")).filter("sample = 'S4'").first().lon == 110.75


def test_geojson_and_network_input(spark):
    text = '{"features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]],[[0,0],[1,1]]]}},{"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,2],[0,0]]]]}},{"geometry":{"type":"LineString","coordinates":[[0,0],[1,1],[2,2]]}},{"geometry":null}]}'
    rings = side.decode_rings(spark.createDataFrame([(text,)], "value string"))
    assert sorted((r.feature, r.ring, len(r.points)) for r in rings.collect()) == [(0, 0, 3), (1, 0, 4), (2, 0, 3)]
    rows = side.decode_network_input(spark.createDataFrame([('{"sequences":["A","C"],"samples":[["x"],[]],"epsilon":2}',), ("broken",)], "value string")).collect()
    assert (rows[0].sequences, rows[0].epsilon) == (["A", "C"], 2) and (rows[1].sequences, rows[1].epsilon) == ([], 0)


def test_longest_isoform(spark):
    from locusflow.operators.annotate import longest_isoforms

    t = spark.createDataFrame([(1, "g", 1, 5, "a"), (2, "g", 1, 9, "b"), (3, "g", 2, 10, "c")], "file_ord int, parent string, start int, end int, id string")
    assert longest_isoforms(t).select(F.col("id")).first().id == "b"


def test_fasta_and_ped(spark, tmp_path):
    from locusflow.operators import network
    from locusflow.sources import sequences

    (tmp_path / "s.fa").write_text(">a one\nAC-G\nTT\n>b\nac-gTA\n>c\nAC-GTT\n")
    got = [tuple(r) for r in sequences.read_fasta(spark, str(tmp_path / "s.fa")).orderBy("id").collect()]
    assert got == [(0, "a", "AC-GTT"), (1, "b", "AC-GTA"), (2, "c", "AC-GTT")]
    haps = sequences.as_haplotypes(sequences.read_fasta(spark, str(tmp_path / "s.fa")))
    assert [(r.id, r.samples) for r in haps.orderBy("id").collect()] == [(0, ["a", "c"]), (1, ["b"])]
    assert [tuple(r)[1:] for r in network.edges_of(network.network_parts(haps, "msn")).collect()] == [(0, 1, 1)]
    (tmp_path / "x.ped").write_text("F1 S1 0 0 1 -9 A A G T\nF1 S2 0 0 2 -9 0 0 G G\n\n")
    rows = [tuple(r) for r in sequences.read_ped(spark, str(tmp_path / "x.ped")).orderBy("sample", "site").collect()]
    assert rows == [("F1", "S1", 0, "A", "A"), ("F1", "S1", 1, "G", "T"), ("F1", "S2", 0, None, None), ("F1", "S2", 1, "G", "G")]


def test_compute_network(spark):
    from locusflow.operators import network

    nodes, edges = network.compute_tcs_network(spark, ["ATCG", "ATCC", "TTCG"], [["x"], ["y"], []])
    assert nodes.count() == 4 and edges.count() == 2
    assert network.compute_msn_network(spark, ["A", "C"], [[], []], 3)[1].count() == 1
    assert network.compute_mjn_network(spark, ["A"], [["z"]])[1].count() == 0
    with pytest.raises(ValueError):
        network.compute_network(spark, ["A"], [])
