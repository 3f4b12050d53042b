"""DuckDB SQL for the registered queries."""

from __future__ import annotations

# The colours that the queries are to give.
PALETTE = [
    "#66c2a5", "#fc8d62", "#8da0cb", "#e78ac3", "#a6d854", "#ffd92f", "#e5c494", "#b3b3b3",
    "#1b9e77", "#d95f02", "#7570b3", "#e7298a", "#66a61e", "#e6ab02", "#a6761d", "#666666",
]
CATEGORY_COLORS = {"CDS": "#3775BA", "5'UTR": "#7BAFD4", "3'UTR": "#7BAFD4", "exon": "#B4C0E4", "intron": "#D8D8D8", "intergenic": "#F2F2F2"}

_CALLS = """calls AS (
  SELECT vec_id AS sample_ord, 'C' || vec_id AS sample, pos,
    CASE WHEN abs(x) < 0.01 THEN NULL WHEN x < -0.15 THEN 2 WHEN x < 0 THEN 0 ELSE 1 END AS a1,
    CASE WHEN abs(x) < 0.01 THEN NULL WHEN x < -0.15 THEN 2 WHEN x < 0.02 THEN 0 ELSE 1 END AS a2
  FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65))::INT AS pos FROM embeddings))"""
_VARIANTS = """v0 AS (
  SELECT range::INT AS pos, CASE WHEN range % 7 = 0 THEN 'GCCTA' ELSE substr('ACGT', (range % 4 + 1)::INT, 1) END AS ref,
    substr('ACGT', ((range + 1) % 4 + 1)::INT, 1) AS alt1,
    CASE WHEN range % 5 = 0 THEN 'AA' ELSE substr('ACGT', ((range + 2) % 4 + 1)::INT, 1) END AS alt2 FROM range(1, 65)),
variants AS (SELECT *, ref || '/' || alt1 || ',' || alt2 AS allele FROM v0)"""


def _state(impute: bool) -> str:
    return f"CASE WHEN a1 IS NULL THEN {chr(39) + '0/0' + chr(39) if impute else 'NULL'} WHEN a1 = a2 THEN a1 || '/' || a2 END"


def _profiles(start: int, end: int, impute: bool = False, name: str = "profiles") -> str:
    return f"""{name} AS (
  SELECT sample_ord, sample, string_agg(state, '|' ORDER BY pos) AS hap
  FROM (SELECT *, {_state(impute)} AS state FROM calls WHERE pos BETWEEN {start} AND {end})
  GROUP BY ALL HAVING count(*) = count(state))"""


_SUMMARY = """summary AS (
  SELECT row_number() OVER (ORDER BY n DESC, hap)::INT AS rank, hap, n::INT AS count
  FROM (SELECT hap, count(*) AS n FROM profiles GROUP BY hap)),
labels AS (SELECT *, 'H' || lpad(rank::VARCHAR, 3, '0') AS label FROM summary)"""
_BATCH = f"""sel AS (SELECT n_nationkey::INT AS sel_ord, (n_nationkey * 2 + 1)::INT AS s, (n_nationkey * 2 + 3)::INT AS e FROM nation),
bp AS (
  SELECT sel_ord, sample_ord, sample, string_agg(state, '|' ORDER BY pos) AS hap
  FROM (SELECT sel_ord, c.*, {_state(False)} AS state FROM calls c JOIN sel ON pos BETWEEN s AND e)
  GROUP BY ALL HAVING count(*) = count(state)),
bs AS (
  SELECT sel_ord, row_number() OVER (PARTITION BY sel_ord ORDER BY n DESC, hap)::INT AS rank, hap, n::INT AS count
  FROM (SELECT sel_ord, hap, count(*) AS n FROM bp GROUP BY ALL))"""
_GENES = """features AS (
  SELECT p_partkey AS file_ord, 'chr1' AS seqid,
    ['gene', 'exon', 'CDS', 'five_prime_UTR', 'three_prime_UTR', 'gene', 'exon'][(p_partkey % 7 + 1)::INT] AS type,
    p_partkey * 10 AS start, p_partkey * 10 + p_size AS "end", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'g' || p_partkey AS id
  FROM part)"""
_POP = "pops AS (SELECT 'C' || c_custkey AS sample, c_mktsegment AS population FROM customer WHERE c_custkey % 7 <> 0)"
_GEO = """geo AS (SELECT 'C' || c_custkey AS sample, round(c_nationkey * 3 + 100.25, 2)::DOUBLE AS lon, round(c_nationkey % 5 * 2 + 20.5, 2)::DOUBLE AS lat FROM customer),
located AS (SELECT lon, lat, label, count(*)::INT AS n FROM profiles JOIN labels USING (hap) JOIN geo USING (sample) GROUP BY ALL),
places AS (SELECT lon, lat, label, coalesce(n, 0)::INT AS n FROM (SELECT DISTINCT lon, lat FROM located) CROSS JOIN (SELECT label FROM labels) LEFT JOIN located USING (lon, lat, label)),
ext AS (SELECT *, CASE WHEN lon1 > lon0 THEN lon1 - lon0 ELSE 10 END AS lon_span, CASE WHEN lat1 > lat0 THEN lat1 - lat0 ELSE 10 END AS lat_span
  FROM (SELECT min(lon) AS lon0, max(lon) AS lon1, min(lat) AS lat0, max(lat) AS lat1 FROM places)),
radii AS (
  SELECT lon, lat, total, CASE WHEN hi > lo THEN (sqrt(total) - lo) / (hi - lo) * (1.2 - 0.3) + 0.3 ELSE 0.75 END * least(lon_span, lat_span) * 0.04 AS radius
  FROM (SELECT lon, lat, sum(n)::INT AS total FROM places GROUP BY ALL) CROSS JOIN ext
  CROSS JOIN (SELECT min(sqrt(t)) AS lo, max(sqrt(t)) AS hi FROM (SELECT sum(n) AS t FROM places GROUP BY lon, lat)) WHERE total > 0)"""


def _char_distance(a: str, b: str) -> str:
    return f"(len([k FOR k IN range(1, least(len({a}), len({b})) + 1) IF substr({a}, k::INT, 1) <> substr({b}, k::INT, 1)]) + abs(len({a}) - len({b})))::INT"


_PAIRS = f"""haps AS (SELECT (rank - 1)::INT AS id, hap AS sequence, count FROM summary),
pairs AS (SELECT a.id AS i, b.id AS j, {_char_distance("a.sequence", "b.sequence")} AS d FROM haps a JOIN haps b ON a.id < b.id)"""
# Kruskal: one candidate a step, components as a list
_MSN = """ranked AS (SELECT row_number() OVER (ORDER BY d, i, j) AS k, * FROM pairs),
kruskal(k, comp, i, j, d, taken) AS (
  SELECT 0::BIGINT, (SELECT range(count(*)) FROM haps), 0::INT, 0::INT, 0::INT, false
  UNION ALL
  SELECT r.k, CASE WHEN comp[r.i + 1] <> comp[r.j + 1] THEN [CASE WHEN c = comp[r.j + 1] THEN comp[r.i + 1] ELSE c END FOR c IN comp] ELSE comp END,
    r.i, r.j, r.d, comp[r.i + 1] <> comp[r.j + 1]
  FROM kruskal q JOIN ranked r ON r.k = q.k + 1),
msn AS (SELECT i AS source, j AS target, d AS weight FROM kruskal WHERE taken)"""
# one distance a step: the first pair across components names the two that merge
_TCS = """levels AS (SELECT d, row_number() OVER (ORDER BY d) AS lv FROM (SELECT DISTINCT d FROM pairs)),
byd AS (SELECT lv, l.d, list({'i': i, 'j': j} ORDER BY i, j) AS ps FROM levels l JOIN pairs p ON p.d = l.d GROUP BY ALL),
grow(lv, comp, d, links) AS (
  SELECT 0::BIGINT, (SELECT range(count(*)) FROM haps), 0::INT, []::STRUCT(i INT, j INT)[]
  UNION ALL
  SELECT b.lv,
    CASE WHEN len(b.across) = 0 THEN comp ELSE
      [CASE WHEN c = b.hi THEN b.lo WHEN c > b.hi THEN c - 1 ELSE c END FOR c IN comp] END,
    b.d,
    [p FOR p IN b.across IF least(comp[p.i + 1], comp[p.j + 1]) = b.lo AND greatest(comp[p.i + 1], comp[p.j + 1]) = b.hi]
  FROM (
    SELECT *, least(comp[across[1].i + 1], comp[across[1].j + 1]) AS lo, greatest(comp[across[1].i + 1], comp[across[1].j + 1]) AS hi
    FROM (SELECT x.lv, x.d, g.comp, [p FOR p IN x.ps IF g.comp[p.i + 1] <> g.comp[p.j + 1]] AS across FROM grow g JOIN byd x ON x.lv = g.lv + 1)) b),
tcs AS (SELECT l.i AS source, l.j AS target, greatest(d, 1)::INT AS weight FROM (SELECT d, unnest(links) AS l FROM grow))"""


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + select


def _hap(start: int, end: int, select: str, *more: str, impute: bool = False, recursive: bool = False) -> str:
    return _with(_CALLS, _VARIANTS, _profiles(start, end, impute), _SUMMARY, *more, select=select, recursive=recursive)


def _label(state: str) -> str:
    index = f"split_part({state}, '/', 1)"
    return f"CASE {index} WHEN '0' THEN ref WHEN '1' THEN alt1 ELSE alt2 END"


def _cells(start: int) -> str:
    """``cells``: rank, label and one row per site with its base text."""
    return f"""cells AS (
  SELECT rank, label, p.pos, {_label("split_part(hap, '|', p.pos - " + str(start - 1) + ")")} AS cell
  FROM labels JOIN variants p ON p.pos BETWEEN {start} AND {start} + len(string_split(hap, '|')) - 1)"""


_HEAD = "SELECT {n} AS line_no, '{tag}' || chr(9) || (SELECT string_agg({cell}, chr(9) ORDER BY pos) FROM variants WHERE pos BETWEEN 1 AND 3) || chr(9) || '{text}' || chr(9) || {value} AS value"
_HEADS = "\nUNION ALL ".join(
    (
        _HEAD.format(n=1, tag="CHR", cell="'chr1'", text="Haplotypes: ", value="(SELECT count(*) FROM summary)"),
        _HEAD.format(n=2, tag="POS", cell="pos::VARCHAR", text="Individuals: ", value="(SELECT count(*) FROM embeddings)"),
        _HEAD.format(n=3, tag="INFO", cell="'.'", text="Variants: ", value="3"),
    )
)
_BODY_CELLS = "(SELECT string_agg(cell, chr(9) ORDER BY pos) FROM cells c WHERE c.label = l.label)"


def _nearest() -> str:
    gap = "CASE WHEN s.e < g.start THEN g.start - s.e WHEN s.s > g.\"end\" THEN s.s - g.\"end\" ELSE 0 END"
    return _with(
        _GENES,
        """s AS (SELECT c_custkey AS sel_ord, CASE WHEN c_custkey % 100 = 0 THEN 'chr2' ELSE 'chr1' END AS chrom, c_custkey * 37 % 2500 AS s,
  c_custkey * 37 % 2500 + c_custkey % 5 AS e FROM customer)""",
        "g AS (SELECT * FROM features WHERE type = 'gene')",
        f"""m AS (
  SELECT s.sel_ord, s.chrom, g.*, g.start <= s.e AND g."end" >= s.s AS hit, {gap} AS gap FROM s LEFT JOIN g ON g.seqid = s.chrom),
o AS (SELECT *, row_number() OVER (PARTITION BY sel_ord ORDER BY hit DESC, CASE WHEN hit THEN 0 ELSE gap END, start, file_ord) AS r FROM m)""",
        select="""SELECT sel_ord, CASE WHEN id IS NULL THEN 'none' WHEN hit THEN 'overlap' ELSE 'nearest' END AS mode, id, seqid, start, "end", strand,
  CASE WHEN NOT hit THEN gap END AS distance FROM o WHERE r = 1""",
    )


def _classify() -> str:
    colors = " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v}'" for k, v in CATEGORY_COLORS.items())
    return _with(
        _GENES,
        "p AS (SELECT o_orderkey AS ord, (o_orderkey * 13 % 2600)::INT AS pos FROM orders)",
        """h AS (
  SELECT ord, pos, min(CASE type WHEN 'CDS' THEN 1 WHEN 'five_prime_UTR' THEN 2 WHEN 'three_prime_UTR' THEN 3 WHEN 'exon' THEN 4 ELSE 5 END) AS best,
    coalesce(bool_or(type = 'gene'), false) AS gene
  FROM p LEFT JOIN features f ON pos BETWEEN f.start AND f."end" GROUP BY ALL),
c AS (SELECT ord, pos, CASE WHEN best = 1 THEN 'CDS' WHEN best = 2 THEN '5''UTR' WHEN best = 3 THEN '3''UTR' WHEN gene AND best = 4 THEN 'exon'
  WHEN gene THEN 'intron' ELSE 'intergenic' END AS category FROM h)""",
        select=f"SELECT ord, pos, category, CASE category {colors} END AS color FROM c",
    )


def _approx(impute: bool, select: str) -> str:
    differ = "len([k FOR k IN range(5) IF substr(r, (1 + 4 * k)::INT, 1) <> substr({h}, (1 + 4 * k)::INT, 1)]) / 5.0 <= 0.2"
    return _with(
        _CALLS,
        _profiles(1, 5, impute),
        "ordered AS (SELECT row_number() OVER (ORDER BY first) AS k, hap FROM (SELECT hap, min(sample_ord) AS first FROM profiles GROUP BY hap))",
        f"""fold(k, leaders) AS (
  SELECT 0::BIGINT, []::VARCHAR[]
  UNION ALL
  SELECT o.k, CASE WHEN len([r FOR r IN leaders IF {differ.format(h="o.hap")}]) > 0 THEN leaders ELSE list_append(leaders, o.hap) END
  FROM fold f JOIN ordered o ON o.k = f.k + 1)""",
        "final AS (SELECT leaders FROM fold ORDER BY k DESC LIMIT 1)",
        f"""placed AS (SELECT hap, [r FOR r IN leaders IF {differ.format(h="hap")}][1] AS leader, leaders FROM ordered CROSS JOIN final),
accs AS (SELECT sample_ord, sample, 'A' || lpad(list_position(leaders, leader)::VARCHAR, 3, '0') AS hap, leader FROM profiles JOIN placed USING (hap))""",
        select=select,
        recursive=True,
    )


_SEGMENTS = """nd AS (SELECT id, (id % 5 * 4)::DOUBLE AS x, (id // 5 * 4)::DOUBLE AS y, 0.3 + sqrt(greatest(count, 1)::DOUBLE) / (SELECT max(sqrt(greatest(count, 1)::DOUBLE)) FROM haps) * (1.05 - 0.3) AS r FROM haps),
e0 AS (SELECT source, target, weight, a.x AS ax, a.y AS ay, a.r AS ar, b.x AS bx, b.y AS b_y, b.r AS br, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS l
  FROM msn JOIN nd a ON a.id = source JOIN nd b ON b.id = target),
seg AS (SELECT source, target, weight, ax + (bx - ax) / l * ar AS sx, ay + (b_y - ay) / l * ar AS sy, bx - (bx - ax) / l * br AS ex, b_y - (b_y - ay) / l * br AS ey FROM e0 WHERE l >= 1e-6)"""
_TICKS = """t0 AS (SELECT *, ex - sx AS vx, ey - sy AS vy, sqrt((ex - sx) ** 2 + (ey - sy) ** 2) AS vis FROM seg),
t1 AS (SELECT *, unnest(range(1, weight + 1))::INT AS k, vis / (weight + 1) AS sp FROM t0 WHERE weight > 0 AND vis >= 1e-6),
t2 AS (SELECT source, target, k, vx / vis AS ux, vy / vis AS uy, sx + vx / vis * k * sp AS cx, sy + vy / vis * k * sp AS cy, least(0.22, sp / 1.6) * 0.5 AS h FROM t1)"""
_BASES = """bases AS (SELECT (rank - 1)::INT AS id, string_agg(substr(cell, 1, 1), '' ORDER BY pos) AS sequence FROM cells GROUP BY rank)"""


def _medians() -> str:
    def pick(k: int) -> str:
        x, y, z = (f"substr({q}.sequence, {k}, 1)" for q in "abc")
        return f"CASE WHEN {x} = {y} OR {x} = {z} THEN [{x}] WHEN {y} = {z} THEN [{y}] ELSE [{x}, {y}, {z}] END AS c{k}"

    cost = " + ".join(_char_distance(q, "median") for q in ("a", "b", "c"))
    return _hap(
        1,
        4,
        f"SELECT i, j, l, median, ({cost})::INT AS cost FROM (SELECT DISTINCT i, j, l, a, b, c, m1 || m2 || m3 || m4 AS median FROM u)",
        _cells(1),
        _BASES,
        f"""t AS (SELECT a.id AS i, b.id AS j, c.id AS l, a.sequence AS a, b.sequence AS b, c.sequence AS c, {", ".join(pick(k) for k in range(1, 5))}
  FROM bases a JOIN bases b ON a.id < b.id JOIN bases c ON b.id < c.id)""",
        "u1 AS (SELECT *, unnest(c1) AS m1 FROM t)",
        "u2 AS (SELECT *, unnest(c2) AS m2 FROM u1)",
        "u3 AS (SELECT *, unnest(c3) AS m3 FROM u2)",
        "u AS (SELECT *, unnest(c4) AS m4 FROM u3)",
    )


def _intermediate() -> str:
    places = "[k FOR k IN range(1, least(len(a), len(b)) + 1) IF substr(a, k::INT, 1) <> substr(b, k::INT, 1)]"
    return _hap(
        1,
        3,
        """SELECT id, step, array_to_string([CASE WHEN list_contains(places[1:(len(places) * step // 3)], k) THEN substr(b, k::INT, 1) ELSE substr(a, k::INT, 1) END
  FOR k IN range(1, len(a) + 1)], '') AS sequence FROM w""",
        "first AS (SELECT hap AS a FROM summary WHERE rank = 1)",
        "x AS (SELECT (rank - 1)::INT AS id, a, hap AS b, unnest([1, 2, 3]) AS step FROM summary CROSS JOIN first WHERE rank > 1)",
        f"w AS (SELECT *, {places} AS places FROM x)",
    )


def _site_json(start: str, end: str) -> str:
    return f"(SELECT '[' || string_agg('{{\"allele\":\"' || allele || '\",\"chrom\":\"chr1\",\"pos\":' || pos || '}}', ',' ORDER BY pos) || ']' FROM variants WHERE pos BETWEEN {start} AND {end})"


def oracle() -> dict[str, str]:
    out = {
        "genotype_normalize": _with(_CALLS, select=f"SELECT sample_ord, pos, {_state(False)} AS state FROM calls"),
        "genotype_impute": _with(_CALLS, select=f"SELECT sample_ord, pos, {_state(True)} AS state FROM calls"),
        "site_alleles": _with(_VARIANTS, select="SELECT 'chr1' AS chrom, pos, allele FROM variants"),
        "state_labels": _with(
            _CALLS, _VARIANTS, f"s AS (SELECT *, {_state(True)} AS state FROM calls)",
            select=f"SELECT sample_ord, pos, {_label('state')} AS label FROM s JOIN variants USING (pos) WHERE state IS NOT NULL",
        ),
        "hap_profiles_strict": _hap(1, 5, "SELECT * FROM profiles"),
        "hap_profiles_impute": _hap(1, 5, "SELECT * FROM profiles", impute=True),
        "hap_site": _hap(4, 4, "SELECT rank, label, hap, count FROM labels"),
        "hap_summary": _hap(1, 5, "SELECT rank, label, hap, count FROM labels"),
        "hap_detail": _hap(1, 5, "SELECT sample_ord, sample, hap, label FROM profiles JOIN labels USING (hap)"),
        "hap_accessions": _hap(
            1, 5, "SELECT label, hap, any_value(count) AS count, string_agg(sample, ';' ORDER BY sample_ord) AS samples FROM profiles JOIN labels USING (hap) GROUP BY label, hap"
        ),
        "hap_cells": _hap(1, 5, "SELECT label, string_agg(cell, ' ' ORDER BY pos) AS cells FROM cells GROUP BY label", _cells(1)),
        "hap_regions_batch": _with(_CALLS, _BATCH, select="SELECT sel_ord, rank, 'H' || lpad(rank::VARCHAR, 3, '0') AS label, hap, count FROM bs"),
        "hap_approx": _approx(False, "SELECT * FROM accs"),
        "hap_approx_summary": _approx(True, "SELECT row_number() OVER (ORDER BY count DESC, hap)::INT AS rank, hap, count FROM (SELECT hap, count(*)::INT AS count FROM accs GROUP BY hap)"),
        "sample_subset": _with(
            _CALLS, _profiles(1, 5), select="SELECT 1000000 - sample_ord AS sample_ord, sample, hap FROM profiles WHERE sample_ord % 3 = 0"
        ),
        "sample_unknown": "SELECT 'C' || (range * 997) AS sample FROM range(40) WHERE 'C' || (range * 997) NOT IN (SELECT 'C' || vec_id FROM embeddings)",
        "view_counters": _with(
            _CALLS, _BATCH,
            select="""SELECT sel_ord, 3::INT AS variant_count, (SELECT count(*) FROM embeddings)::INT AS sample_count, coalesce(h, 0)::INT AS haplotype_count
FROM sel LEFT JOIN (SELECT sel_ord, count(*) AS h FROM bs GROUP BY sel_ord) USING (sel_ord)""",
        ),
        "record_overlap": _with(
            _VARIANTS,
            select="""SELECT n_nationkey::INT AS sel_ord, pos, ref FROM nation JOIN variants ON pos <= n_nationkey * 2 + 3 AND pos + len(ref) - 1 >= n_nationkey * 2 + 1""",
        ),
        "population_lines": """SELECT 'C' || c_custkey % 500 AS sample, max_by(c_mktsegment, c_custkey) AS population FROM customer
WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 GROUP BY ALL""",
        "debug_fetch": "SELECT 64::BIGINT AS variant_count, count(*) AS sample_count FROM embeddings",
        "vcf_decode": _with(
            _CALLS, _VARIANTS,
            select="""SELECT 'chr1' AS chrom, pos, ref, alt1 || ',' || alt2 AS alt, (row_number() OVER (PARTITION BY pos ORDER BY sample_ord) - 1)::INT AS col_ord, a1, a2,
  CASE WHEN a1 IS NOT NULL THEN pos % 2 = 1 END AS phased FROM calls JOIN variants USING (pos)""",
        ),
        "bed_parse": """SELECT (n_nationkey + 1)::INT AS sel_ord, 'bed-record' AS type, CASE WHEN n_nationkey % 3 = 0 THEN 'row' || (n_nationkey + 1) ELSE n_name END AS record_id,
  'chr1' AS chrom, n_nationkey::INT AS start, (n_nationkey + 4)::INT AS "end" FROM nation WHERE n_nationkey % 5 <> 4""",
        "gff_genes": _with(_GENES, select="SELECT file_ord, seqid, start, \"end\", strand, id FROM features WHERE type = 'gene'"),
        "gff_filter": _with(
            _GENES,
            select="SELECT seqid AS chrom, start - 1 AS start, \"end\", id AS name, '.' AS score, strand FROM features WHERE type IN ('gene', 'CDS') AND \"end\" >= 300 AND start <= 900",
        ),
        "gene_annotation": _nearest(),
        "feature_classify": _classify(),
        "pop_totals": _with(_POP, select="SELECT population, count(*)::INT AS total FROM pops GROUP BY population"),
        "pop_counts": _hap(
            1, 4,
            """SELECT label, population, coalesce(n, 0)::INT AS n, total FROM labels CROSS JOIN (SELECT population, count(*)::INT AS total FROM pops GROUP BY population)
LEFT JOIN (SELECT label, population, count(*) AS n FROM profiles JOIN labels USING (hap) JOIN pops USING (sample) GROUP BY ALL) USING (label, population)""",
            _POP,
        ),
        "pop_crosstab": _hap(
            1, 4,
            "SELECT label, " + ", ".join(f"(count(*) FILTER (population = '{p}'))::INT AS \"{p}\"" for p in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
            + " FROM profiles JOIN labels USING (hap) LEFT JOIN pops USING (sample) GROUP BY label",
            _POP,
        ),
        "pop_network": _hap(1, 4, "SELECT label, population, count(*)::INT AS n FROM profiles JOIN labels USING (hap) JOIN pops USING (sample) GROUP BY ALL", _POP),
        "geo_counts": _hap(1, 3, "SELECT * FROM places", _GEO),
        "geo_extents": _hap(
            1, 3,
            """SELECT round(lon0 - greatest(lon_span * 0.12, 2), 6) AS lon_min, round(lon1 + greatest(lon_span * 0.12, 2), 6) AS lon_max,
  round(lat0 - greatest(lat_span * 0.12, 2), 6) AS lat_min, round(lat1 + greatest(lat_span * 0.12, 2), 6) AS lat_max, round(lon_span, 6)::DOUBLE AS lon_span, round(lat_span, 6)::DOUBLE AS lat_span FROM ext""",
            _GEO,
        ),
        "pie_wedges": _hap(
            1, 3,
            """SELECT lon, lat, label, n, round(90 + coalesce(sum(span) OVER (PARTITION BY lon, lat ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start_angle,
  round(90 + coalesce(sum(span) OVER (PARTITION BY lon, lat ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + span, 6) AS end_angle
FROM (SELECT *, 360.0::DOUBLE * n / sum(n) OVER (PARTITION BY lon, lat) AS span FROM places WHERE n > 0)""",
            _GEO,
        ),
        "symbol_radius": _hap(1, 3, "SELECT lon, lat, total, round(radius, 6) AS radius FROM radii", _GEO),
        "size_breaks": _hap(
            1, 3,
            """SELECT place::INT AS place, value::INT AS value FROM (
  SELECT unnest(range(len(b))) AS place, unnest(b) AS value FROM (
    SELECT CASE count(DISTINCT total) WHEN 1 THEN [min(total)] WHEN 2 THEN [min(total), max(total)] ELSE [min(total), round_even((min(total) + max(total)) / 2, 0)::INT, max(total)] END AS b FROM radii))""",
            _GEO,
        ),
        "pairwise_hamming": _hap(1, 4, "SELECT * FROM pairs", _PAIRS),
        "pairwise_state_diff": _hap(
            1, 4,
            """SELECT a.rank - 1 AS i, b.rank - 1 AS j, len([k FOR k IN range(1, 5) IF split_part(a.hap, '|', k::INT) <> split_part(b.hap, '|', k::INT)])::INT AS d
FROM summary a JOIN summary b ON a.rank < b.rank""",
        ),
        "packed_hamming": _hap(1, 4, f"SELECT a.id AS i, b.id AS j, {_char_distance('a.sequence', 'b.sequence')} AS d FROM bases a JOIN bases b ON a.id < b.id", _cells(1), _BASES),
        "intermediates": _intermediate(),
        "quasi_medians": _medians(),
        "network_msn": _hap(1, 3, "SELECT * FROM msn", _PAIRS, _MSN, recursive=True),
        "network_mjn": _hap(1, 3, "SELECT * FROM msn", _PAIRS, _MSN, recursive=True),
        "network_tcs": _hap(1, 3, "SELECT * FROM tcs", _PAIRS, _TCS, recursive=True),
        "network_nodes": _hap(
            1, 3, "SELECT false AS is_median, count(*) AS nodes FROM haps UNION ALL SELECT true, sum(greatest(weight - 1, 0))::BIGINT FROM tcs HAVING sum(greatest(weight - 1, 0)) > 0", _PAIRS, _TCS,
            recursive=True,
        ),
        "degree": _hap(
            1, 3, "SELECT id, coalesce(n, 0)::INT AS degree FROM haps LEFT JOIN (SELECT x AS id, count(*) AS n FROM (SELECT source AS x FROM msn UNION ALL SELECT target FROM msn) GROUP BY x) USING (id)",
            _PAIRS, _MSN, recursive=True,
        ),
        "bfs_hops": _hap(
            1, 3, "SELECT source, id AS target, hops, length FROM walk",
            _PAIRS, _MSN, "both_ways AS (SELECT source AS a, target AS b, weight AS w FROM msn UNION ALL SELECT target, source, weight FROM msn)",
            "walk(source, id, hops, length, seen) AS (SELECT id, id, 0::INT, 0::INT, [id] FROM haps UNION ALL SELECT source, b, hops + 1, length + w, list_append(seen, b) FROM walk JOIN both_ways ON a = id WHERE NOT list_contains(seen, b))",
            recursive=True,
        ),
        "node_radius": _hap(1, 3, "SELECT id, count, round(0.3 + sqrt(count::DOUBLE) / (SELECT max(sqrt(count::DOUBLE)) FROM haps) * (1.05 - 0.3), 6) AS radius FROM haps", _PAIRS),
        "size_legend": _hap(
            1, 3,
            """SELECT n::INT AS n, round(r, 6) AS radius, round(0.1 + r, 6) AS center_y FROM (
  SELECT n, (0.3 + sqrt(n::DOUBLE) / sqrt(hi::DOUBLE) * (1.05 - 0.3)) * (0.4 / 1.05) AS r FROM (SELECT unnest([max(count), min(count)]) AS n, max(count) AS hi, min(count) AS lo FROM haps) WHERE hi > lo)""",
            _PAIRS,
        ),
        "edge_segments": _hap(
            1, 3, "SELECT source, target, weight, round(sx, 6) AS sx, round(sy, 6) AS sy, round(ex, 6) AS ex, round(ey, 6) AS ey FROM seg", _PAIRS, _MSN, _SEGMENTS, recursive=True
        ),
        "edge_ticks": _hap(
            1, 3,
            "SELECT source, target, k, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cx + uy * h, 6) AS x0, round(cy - ux * h, 6) AS y0, round(cx - uy * h, 6) AS x1, round(cy + ux * h, 6) AS y1 FROM t2",
            _PAIRS, _MSN, _SEGMENTS, _TICKS, recursive=True,
        ),
        "population_colors": _hap(
            1, 4,
            "SELECT population, [" + ", ".join(f"'{c}'" for c in PALETTE) + """][((row_number() OVER (ORDER BY first, population) - 1) % 16 + 1)::INT] AS color
FROM (SELECT population, min(rank) AS first FROM profiles JOIN labels USING (hap) JOIN pops USING (sample) GROUP BY population)""",
            _POP,
        ),
        "allele_set": _with(
            _VARIANTS,
            select="SELECT allele, [" + ", ".join(f"'{c}'" for c in PALETTE) + """][((row_number() OVER (ORDER BY allele) - 1) % 16 + 1)::INT] AS color
FROM (SELECT DISTINCT unnest([ref, alt1, alt2]) AS allele FROM variants WHERE pos <= 20)""",
        ),
        "palette_dark": "SELECT i::INT AS idx, c AS color, 0.299 * ('0x' || substr(c, 2, 2))::INT / 255 + 0.587 * ('0x' || substr(c, 4, 2))::INT / 255 + 0.114 * ('0x' || substr(c, 6, 2))::INT / 255 < 0.5 AS dark FROM (SELECT unnest(range(16)) AS i, unnest(["
        + ", ".join(f"'{c}'" for c in PALETTE) + "]) AS c)",
        "indel_footnotes": _with(
            _VARIANTS,
            select="""SELECT string_agg('i' || r || ':' || t, '; ' ORDER BY r) AS footnote FROM (
  SELECT t, row_number() OVER (ORDER BY t) AS r FROM (SELECT DISTINCT unnest([ref, alt1, alt2]) AS t FROM variants WHERE pos <= 20) WHERE len(t) > 2)""",
        ),
        "region_title": _with(_VARIANTS, select="SELECT 'chr1:' || min(pos::VARCHAR) || '-' || max(pos::VARCHAR) AS title FROM variants WHERE pos BETWEEN 5 AND 12"),
        "view_jsonl": _with(
            _CALLS, _VARIANTS, _BATCH,
            select=f"""SELECT sel_ord, '{{"gff3_enabled":false,"grouping_method":"exact","grouping_mode":"strict-region","haplotype_count":' || (SELECT count(*) FROM bs WHERE bs.sel_ord = sel.sel_ord) ||
  ',"haplotypes":' || (SELECT '[' || string_agg('{{"count":' || count || ',"hap":"' || hap || '"}}', ',' ORDER BY rank) || ']' FROM bs WHERE bs.sel_ord = sel.sel_ord) ||
  ',"imputed_ref":false,"max_diff":null,"output_mode":"summary","plot_requested":false,"sample_count":' || (SELECT count(*) FROM embeddings) ||
  ',"selector":{{"chrom":"chr1","end":' || e || ',"record_id":"row' || (sel_ord + 1) || '","start":' || s || ',"type":"bed-record"}},"sites":' || {_site_json("s", "e")} || ',"variant_count":3}}' AS json FROM sel""",
        ),
    }
    out["hap_scale"] = _with(
        """cell AS (
  SELECT l_suppkey AS sample_ord, l_partkey % 3 AS pos, l_returnflag AS f, l_linenumber AS n,
    row_number() OVER (PARTITION BY l_suppkey, l_partkey % 3 ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_returnflag) AS r
  FROM lineitem)""",
        "c1 AS (SELECT sample_ord, pos, n, CASE f WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS a1 FROM cell WHERE r = 1)",
        """profiles AS (
  SELECT sample_ord, string_agg(state, '|' ORDER BY pos) AS hap FROM (SELECT *, CASE WHEN n <> 7 THEN a1 || '/' || a1 END AS state FROM c1)
  GROUP BY ALL HAVING count(*) = count(state))""",
        _SUMMARY,
        select="SELECT rank, label, hap, count FROM labels",
    )
    short = "replace({c}, 'GCCTA', 'i1')"
    out["display_table"] = _hap(
        6, 8,
        f"""SELECT 0::INT AS row_ord, 'POS' AS row, (pos - 6)::INT AS col_ord, {short.format(c="pos::VARCHAR")} AS cell FROM variants WHERE pos BETWEEN 6 AND 8
UNION ALL SELECT 1, 'ALLELE', pos - 6, {short.format(c="allele")} FROM variants WHERE pos BETWEEN 6 AND 8
UNION ALL SELECT rank + 1, label, pos - 6, {short.format(c="cell")} FROM cells
UNION ALL SELECT 1, 'ALLELE', 3 + p, population FROM names
UNION ALL SELECT rank + 1, label, 3 + p, coalesce(n, 0) || '/' || total FROM labels CROSS JOIN names LEFT JOIN
  (SELECT label, population, count(*) AS n FROM profiles JOIN labels USING (hap) JOIN pops USING (sample) GROUP BY ALL) USING (label, population)
UNION ALL SELECT 1, 'ALLELE', 3 + (SELECT count(*) FROM names)::INT, 'n/N'
UNION ALL SELECT rank + 1, label, 3 + (SELECT count(*) FROM names)::INT, count || '/' || (SELECT count(*) FROM embeddings) FROM labels""",
        _cells(6), _POP, "names AS (SELECT population, count(*) AS total, (row_number() OVER (ORDER BY population) - 1)::INT AS p FROM pops GROUP BY population)",
    )
    out["annotation_table"] = _with(
        _GENES,
        "s AS (SELECT n_nationkey::INT AS sel_ord, (n_nationkey * 2 + 1)::INT AS start, (n_nationkey * 2 + 3)::INT AS e FROM nation)",
        "g AS (SELECT * FROM features WHERE type = 'gene')",
        """m AS (SELECT s.sel_ord, s.start AS s, s.e, g.id, g.start AS gs, file_ord, g.start <= s.e AND g."end" >= s.start + 1 AS hit,
  CASE WHEN s.e < g.start THEN g.start - s.e WHEN s.start + 1 > g."end" THEN s.start + 1 - g."end" ELSE 0 END AS gap FROM s CROSS JOIN g),
o AS (SELECT *, row_number() OVER (PARTITION BY sel_ord ORDER BY hit DESC, CASE WHEN hit THEN 0 ELSE gap END, gs, file_ord) AS r FROM m)""",
        select="SELECT sel_ord, 'chr1' AS chr, s AS start, e AS \"end\", CASE WHEN hit THEN id ELSE id || ':' || gap END AS ann FROM o WHERE r = 1",
    )
    out["network_msn_batch"] = _with(
        _CALLS,
        _BATCH,
        f"""bpairs AS (
  SELECT a.sel_ord AS net, a.rank - 1 AS i, b.rank - 1 AS j, {_char_distance("a.hap", "b.hap")} AS d FROM bs a JOIN bs b ON a.sel_ord = b.sel_ord AND a.rank < b.rank)""",
        "ordered AS (SELECT row_number() OVER (PARTITION BY net ORDER BY d, i, j) AS k, * FROM bpairs)",
        """grown(net, k, comp, d, taken) AS (
  SELECT sel_ord, 0::BIGINT, range(count(*)), 0::INT, false FROM bs GROUP BY sel_ord
  UNION ALL
  SELECT q.net, r.k, CASE WHEN comp[r.i + 1] <> comp[r.j + 1] THEN [CASE WHEN c = comp[r.j + 1] THEN comp[r.i + 1] ELSE c END FOR c IN comp] ELSE comp END,
    r.d, comp[r.i + 1] <> comp[r.j + 1]
  FROM grown q JOIN ordered r ON r.net = q.net AND r.k = q.k + 1)""",
        select="SELECT net::BIGINT AS net_id, count(*) AS edges, sum(d)::BIGINT AS weight FROM grown WHERE taken GROUP BY net",
        recursive=True,
    )
    out["network_json"] = _hap(
        1, 3,
        """SELECT '{"edges":[' || (SELECT string_agg('{"source":' || source || ',"target":' || target || ',"weight":' || weight || '}', ',' ORDER BY source, target) FROM msn) ||
  '],"nodes":[' || (SELECT string_agg('{"id":' || (rank - 1) || ',"is_median":false,"samples":[' || array_to_string([('"' || label || '"') FOR k IN range(count)], ',') || '],"sequence":"' || hap || '"}', ',' ORDER BY rank) FROM labels) || ']}' AS json""",
        _PAIRS, _MSN, recursive=True,
    )
    tab = "chr(9)"
    out["summary_tsv"] = _hap(
        1, 3,
        f"""SELECT line_no::BIGINT AS line_no, value FROM ({_HEADS}
UNION ALL SELECT 4, 'ALLELE' || {tab} || (SELECT string_agg(allele, {tab} ORDER BY pos) FROM variants WHERE pos <= 3) || {tab} || 'Accession' || {tab} || 'freq'
UNION ALL SELECT rank + 4, label || {tab} || {_BODY_CELLS} || {tab} || (SELECT string_agg(sample, ';' ORDER BY sample_ord) FROM profiles p WHERE p.hap = l.hap) || {tab} || count FROM labels l)""",
        _cells(1),
    )
    out["result_tsv"] = _hap(
        1, 3,
        f"""SELECT line_no::BIGINT AS line_no, value FROM ({_HEADS}
UNION ALL SELECT 4, 'ALLELE' || {tab} || (SELECT string_agg(allele, {tab} ORDER BY pos) FROM variants WHERE pos <= 3) || {tab} || 'Accession'
UNION ALL SELECT sample_ord + 5, label || {tab} || {_BODY_CELLS} || {tab} || sample FROM profiles JOIN labels l USING (hap))""",
        _cells(1),
    )
    return out
