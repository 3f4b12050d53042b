"""A small VCF, annotation and side tables, typed for the tests."""

#: POS, REF, ALT, and the genotypes of six samples.
RECORDS = [
    (100, "G", "C", "1/1 0/0 0/0 0|0 1/1 0/0"),
    (145, "T", "A,GG", "0/0 0/0 0/0 0/0 0/0 2/2"),
    (179, "GCCTA", "A", "1/1 1/1 0/0 ./. 1/1 0/0"),
    (250, "T", "AA,GG", "0/0 0/0 0/1 0/0 0/0 0/0"),
    (900, "A", ".", "0/0 0/0 0/0 0/0 0/0 0"),
]
SAMPLES = ["S1", "S2", "S3", "S4", "S5", "S6"]


def vcf() -> str:
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(SAMPLES) + "\n"
    body = "".join(
        "\t".join(["ctg_1", str(p), ".", r, a, "50", "PASS", ".", "GT:DP", *[f"{g}:7" for g in gts.split()]]) + "\n" for p, r, a, gts in RECORDS
    )
    return head + body


GFF = """##gff-version 3
ctg_1\tsrc\tgene\t90\t260\t.\t+\t.\tID=geneA;Name=geneA
ctg_1\tsrc\texon\t90\t190\t.\t+\t.\tID=geneA.e1;Parent=geneA
ctg_1\tsrc\tfive_prime_UTR\t90\t110\t.\t+\t.\tID=geneA.u1;Parent=geneA
ctg_1\tsrc\tCDS\t111\t150\t.\t+\t0\tID=geneA.c1;Parent=geneA
ctg_1\tsrc\tgene\t400\t500\t.\t-\t.\tID=geneB
ctg_1\tsrc\tgene\tx\t500\t.\t-\t.\tID=geneC
short line
"""
POPULATIONS = "S1\twild\nS2\twild\nS3\tcultivar\n\nS3\tlandrace\nS9\twild\n"
GEO = "ID\tlongitude\tlatitude\tHap\nS1\t100.25\t20.5\tH001\nS2\t100.25\t20.5\tH001\nS4\t110.75\t30.5\tH002\nS9\t1\t1\tH009\n"
BED = "ctg_1\t100\t145\twin1\n\nctg_1\t145\t200\n"
