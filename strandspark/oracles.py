"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from . import fixtures as X
from . import oracle_align as A
from .config import ADAPTERS
from .functions.seq import IUPAC_MASK
from .operators.pileup import AMBIGUITY
from .plans import report

_D = X.DNA_SQL.format("text")
_SUM4 = "sum(sa)::BIGINT AS sa, sum(sc)::BIGINT AS sc, sum(sg)::BIGINT AS sg, sum(st)::BIGINT AS st"
_REVCOMP = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_CODE = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, {k} + 1), lambda j: (instr('ACGT', substr({0}, j, 1)) - 1)::BIGINT)), lambda a, b: a * 4 + b)"


def _index(k: int) -> str:
    return f"""items AS (SELECT item_id, {_D} AS dna FROM benchmark),
both_ AS (SELECT 'f' AS strand, item_id, dna FROM items UNION ALL SELECT 'r', item_id, {_REVCOMP.format('dna')} FROM items),
idx0 AS (SELECT strand, item_id, dna, unnest(range(0, greatest(length(dna) - {k - 1}, 0))) AS off_ FROM both_),
idx AS (SELECT strand, item_id, off_, substr(dna, off_ + 1, {k}) AS kmer, item_id * 100000 + off_ AS pos FROM idx0)"""


_KMERS12 = "rk0 AS (SELECT ord, len, seq, unnest(range(0, greatest(len - 11, 0))) AS off FROM reads), rk AS (SELECT ord, len, off, substr(seq, off + 1, 12) AS kmer FROM rk0)"
_CAPPED = "capped AS (SELECT *, row_number() OVER (PARTITION BY strand, kmer ORDER BY {0}) AS rn FROM idx)"
_MASK = "CASE upper({0}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in IUPAC_MASK.items()) + " ELSE 0 END"
_PARTNER = "translate(upper({0}), 'ACGTU', 'GTACC')"
_COORD = """c AS (SELECT (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey AS ord, l_returnflag = 'R' AS rc, (l_partkey % 97)::INTEGER AS s, (l_partkey % 97 + 30 + l_suppkey % 5)::INTEGER AS e,
  l_quantity::INTEGER AS score, (l_orderkey % 61)::INTEGER AS qual_sum, l_linestatus = 'F' AS trimmed FROM lineitem)"""
_LEN = "r AS (SELECT l_quantity::INTEGER AS len, trunc(l_quantity * 180 + l_partkey % 1000)::INTEGER AS score, l_linenumber <= 3 AS u FROM lineitem)"
_LINE = f"""{_LEN},
g AS (SELECT len::DOUBLE AS x, score::DOUBLE AS y FROM r WHERE u AND score >= 500),
l AS (SELECT regr_slope(y, x) AS m0, regr_intercept(y, x) AS b FROM g),
ex AS (SELECT m0, b, greatest(0.0, (SELECT max((y - (m0 * x + b)) / x) FROM g)) AS d FROM l),
line0 AS (SELECT CASE WHEN m0 - d > 0 THEN m0 - 2 * d ELSE m0 * 80 / 100 END AS m, b FROM ex),
line AS (SELECT CASE WHEN m <= 0 THEN 100.0 ELSE m END AS slope, b AS intercept FROM line0)"""
_EVENTS = "o AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END AS strength, event_id % 4 <> 1 AS c, event_id % 7 < 2 AS d FROM events)"


def _classes(least: int) -> str:
    name = lambda c, d, x: f"CASE WHEN sites < {least} THEN 'unknown' WHEN {x} > 0 THEN 'nonsense' WHEN {c} > 0 AND {d} > 0 THEN 'conflict' WHEN {c} > 0 THEN 'clean' WHEN {d} > 0 THEN 'dirt' ELSE 'unknown' END"
    return f"""{_EVENTS},
t AS (SELECT user_id, count(*) AS sites, count(*) FILTER (WHERE strength = 3 AND c AND NOT d) AS c1, count(*) FILTER (WHERE strength = 3 AND NOT c AND d) AS d1,
  count(*) FILTER (WHERE strength = 3 AND NOT c AND NOT d) AS x1, count(*) FILTER (WHERE c) AS c2, count(*) FILTER (WHERE NOT c AND d) AS d2, count(*) FILTER (WHERE NOT c AND NOT d) AS x2 FROM o GROUP BY user_id),
k AS (SELECT user_id, sites, CASE WHEN sites >= {least} THEN c1 + d1 ELSE 0 END AS votes, {name('c1', 'd1', 'x1')} AS klass, {name('c2', 'd2', 'x2')} AS klass2 FROM t)"""


def _wilson(k: str, n: str) -> str:
    p, z2 = f"({k} / {n})", "3.8416"
    wide = f"1.96 * sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0 * {n} * {n}))"
    bound = lambda s: f"CASE WHEN {n} > 0 THEN round(least(greatest(100.0 * ({p} + {z2} / (2.0 * {n}) {s} {wide}) / (1 + {z2} / {n}), 0.0), 100.0), 9) END"
    return f"CASE WHEN {n} > 0 THEN round({p} * 100, 9) END AS estimate, {bound('-')} AS low, {bound('+')} AS high"


_SITES = f"""{X.REF_SQL},
pair AS (SELECT pos, ref_base AS a, CASE WHEN pos % 9 = 0 THEN translate(ref_base, 'ACGT', 'GTAC') WHEN pos % 9 = 4 THEN translate(ref_base, 'ACGT', 'RMKB') WHEN pos % 9 = 7 THEN translate(ref_base, 'ACGT', 'CAAA') ELSE ref_base END AS c FROM ref),
sites AS (SELECT pos, a, c, CASE WHEN ({_MASK.format('a')}) & ({_MASK.format('c')}) = 0 THEN 3 ELSE 1 END AS strength FROM pair WHERE a <> c)"""
_FIT = "({x} = '-' OR {y} = '-' OR (" + _MASK.format("{x2}") + ") & (" + _MASK.format("{y}") + ") <> 0)"
_AGED = "CASE upper({0}) WHEN 'G' THEN 'R' WHEN 'C' THEN 'Y' ELSE {0} END"
_TV = f"(regexp_matches(upper({{0}}), '^[ACGTU]$') AND regexp_matches(upper({{1}}), '^[ACGTU]$') AND {_PARTNER.format('{0}')} <> translate(upper({{1}}), 'U', 'T'))"


def _majority(per_cent: int, style: str) -> str:
    table = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AMBIGUITY.items()) + " END"
    symbol = f"CASE WHEN p = '' THEN '-' ELSE {table} END"
    symbol = f"CASE WHEN p = '' OR length(s) = 1 THEN {symbol} ELSE 'N' END" if style == "strict" else f"CASE WHEN p <> '' AND contains(s, '-') THEN lower({symbol}) ELSE {symbol} END"
    return f"""WITH {X.READS_SQL},
ch0 AS (SELECT doc_id % 50 AS block, replace(seq, 'GAT', 'G-T') AS seq, unnest(range(0, length(seq))) AS pos FROM reads),
n AS (SELECT block, pos::INTEGER AS pos, substr(seq, pos + 1, 1) AS base, count(*) AS n FROM ch0 GROUP BY ALL),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY block, pos ORDER BY n DESC, base DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, ceil({per_cent} * sum(n) OVER (PARTITION BY block, pos) / 100) AS need FROM n),
s AS (SELECT block, pos, string_agg(base, '' ORDER BY base) AS s FROM w WHERE before < need GROUP BY ALL),
q AS (SELECT *, replace(s, '-', '') AS p FROM s)
SELECT block, pos, {symbol} AS symbol FROM q"""


_SEG = f"""WITH {X.COLUMNS_SQL},
"""
_ENDS = """e AS (SELECT pos::INTEGER AS pos, count(*) FILTER (WHERE s AND NOT rc) AS fwd_starts, count(*) FILTER (WHERE s AND rc) AS rev_starts, count(*) FILTER (WHERE NOT s AND NOT rc) AS fwd_ends, count(*) FILTER (WHERE NOT s AND rc) AS rev_ends
  FROM (SELECT start AS pos, true AS s, rc FROM placed WHERE segment <> 'b' UNION ALL SELECT "end", false, rc FROM placed WHERE segment <> 'f') GROUP BY 1)"""
_REVERSE_SUM = "SELECT rc, d::INTEGER AS depth, b::INTEGER AS read_b, " + ", ".join(f"({X.score_sql(k)})::INTEGER AS s{c}" for k, c in enumerate("acgt"))

_REGION = f"""{X.COLUMNS_SQL}, grid AS (SELECT pos, place, ins_idx, ref_base, cons FROM cols WHERE pos BETWEEN 899 AND 959),
c AS (SELECT p.ord, p.id || CASE WHEN trimmed THEN 't' ELSE '_' END || CASE WHEN rc THEN 'r' ELSE '_' END || '01' AS name, start, "end", g.pos, place,
  CASE WHEN NOT (start <= g.pos AND g.pos <= "end") THEN '.' WHEN ins_idx < 0 THEN substr(seq, g.pos - start + 1, 1) WHEN start = g.pos THEN '.'
       WHEN ins_pos = g.pos AND length(ins) > ins_idx THEN substr(ins, ins_idx + 1, 1) ELSE '-' END AS ch
  FROM placed p, grid g WHERE start <= 959 AND "end" >= 899),
region_ AS (SELECT start, "end", name, string_agg(ch, '' ORDER BY pos, place) AS text FROM c GROUP BY ord, name, start, "end"
UNION ALL SELECT -1, -1, 'reference', string_agg(ref_base, '' ORDER BY pos, place) FROM grid
UNION ALL SELECT -1, -1, 'Consensus', string_agg(cons, '' ORDER BY pos, place) FROM grid)"""


def _wrap(text: str, width: int) -> str:
    return f"array_to_string(list_transform(range(0, (length({text}) + {width - 1}) // {width}), lambda i: substr({text}, i * {width} + 1, {width})), chr(10))"


_COLOURED = "text"
for _base, _code in report.COLOURS.items():
    _COLOURED = f"replace({_COLOURED}, '{_base}', chr(27) || '[{_code}m{_base}' || chr(27) || '[0m')"

_FAKE = "FAKE_READ-IGNORE_ME"


def _ds(name: str) -> str:
    return f"'DS CHROMAT_FILE: ' || {name} || ' PHD_FILE: ' || {name} || '_FAKE.phd TIME: {report.ACE_DATE}' || chr(10)"


def _rd(name: str, text: str, size: str) -> str:
    return f"'RD ' || {name} || ' ' || {size} || ' 0 0' || chr(10) || {_wrap(text, 50)} || chr(10) || chr(10) || 'QA 1 ' || {size} || ' 1 ' || {size} || chr(10) || {_ds(name)}"


_ACE = f"""WITH {X.COLUMNS_SQL},
dense AS (SELECT pos, coalesce(gap, 0) AS gap, coalesce(sum(gap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ref LEFT JOIN gap USING (pos)),
ch0 AS (SELECT ord, start, seq, ins, ins_pos, unnest(range(0, length(seq))) AS j FROM placed),
ch AS (SELECT ord, j, rpad(CASE WHEN ins IS NOT NULL AND ins_pos = start + j THEN ins ELSE '' END, coalesce(gap, 0)::INTEGER, '*') || replace(substr(seq, j + 1, 1), '-', '*') AS piece FROM ch0 LEFT JOIN dense ON dense.pos = start + j),
pad AS (SELECT ord, string_agg(piece, '' ORDER BY j) AS padded FROM ch GROUP BY ord),
rows_ AS (SELECT p.id, p.rc, p.start, padded, before FROM placed p JOIN pad USING (ord) JOIN dense d ON d.pos = p.start),
total AS (SELECT translate(string_agg(cons, '' ORDER BY pos, place), '- ', '*X') AS cons, count(*) AS bases, (SELECT count(*) + 1 FROM placed) AS reads FROM cols)
SELECT 'AS 1 ' || reads || chr(10) || chr(10) || 'CO reference ' || bases || ' ' || reads || ' 1 U' || chr(10) || {_wrap('cons', 50)} || chr(10) || chr(10) || 'BQ' || chr(10) || rtrim(repeat('40 ', length(replace(cons, '*', '')))) || chr(10) || chr(10) || 'AF {_FAKE} U 1' AS value FROM total
UNION ALL SELECT 'AF ' || id || CASE WHEN rc THEN ' C ' ELSE ' U ' END || (start + before + 1)::BIGINT FROM rows_
UNION ALL SELECT chr(10) || 'BS 1 ' || bases || ' {_FAKE}' || chr(10) FROM total
UNION ALL SELECT {_rd('id', 'padded', 'length(padded)')} FROM rows_
UNION ALL SELECT {_rd(f"'{_FAKE}'", 'cons', 'bases')} FROM total"""

#: Reads of the whole reference, of its contaminant, of both and of neither, with what they show at the sites.
_CHECK = f"""WITH {X.REF_SQL},
v AS (SELECT s AS t, length(s) AS n FROM refseq),
k AS (SELECT unnest(range(0, (n - 100) // 50 + 1)) AS k FROM v),
site AS (SELECT pos, ref_base AS t, CASE WHEN pos % 60 = 29 THEN translate(ref_base, 'ACGT', 'CATG') WHEN pos % 60 = 59 THEN translate(ref_base, 'ACGT', 'GTAC') END AS d, translate(ref_base, 'ACGT', 'GTAC') AS o, pos % 60 = 29 AS strong FROM ref WHERE pos % 60 IN (29, 59)),
seen AS (SELECT k, pos, strong, t, CASE WHEN k % 4 = 0 OR (k % 4 = 2 AND pos - k * 50 < 50) OR (k % 4 = 3 AND NOT strong) THEN t WHEN k % 4 = 3 THEN o ELSE d END AS y, d FROM k JOIN site ON pos BETWEEN k * 50 AND k * 50 + 99),
fit AS (SELECT *, y = t AS clean, CASE WHEN strong THEN y = d ELSE y IN (t, d) END AS dirt FROM seen),
up AS (SELECT DISTINCT pos FROM fit WHERE NOT strong AND NOT clean AND dirt),
kept AS (SELECT * FROM fit WHERE strong OR pos IN (SELECT pos FROM up)),
sums AS (SELECT k, count(*) AS sites, count(*) FILTER (WHERE strong AND clean AND NOT dirt) AS c1, count(*) FILTER (WHERE strong AND NOT clean AND dirt) AS d1, count(*) FILTER (WHERE strong AND NOT clean AND NOT dirt) AS x1,
  count(*) FILTER (WHERE clean) AS c2, count(*) FILTER (WHERE NOT clean AND dirt) AS d2, count(*) FILTER (WHERE NOT clean AND NOT dirt) AS x2 FROM kept GROUP BY k),
named AS (SELECT CASE WHEN k % 10 = 9 THEN k - 1 ELSE k END AS name, k % 10 = 9 AS back, coalesce(sites, 0) AS sites,
  CASE WHEN x1 > 0 THEN 'nonsense' WHEN c1 > 0 AND d1 > 0 THEN 'conflict' WHEN c1 > 0 THEN 'clean' WHEN d1 > 0 THEN 'dirt' ELSE 'unknown' END AS a, CASE WHEN x2 > 0 THEN 'nonsense' WHEN c2 > 0 AND d2 > 0 THEN 'conflict' WHEN c2 > 0 THEN 'clean' WHEN d2 > 0 THEN 'dirt' ELSE 'unknown' END AS b FROM k LEFT JOIN sums USING (k)),
j AS (SELECT f.a AS a1, coalesce(b.a, 'unknown') AS b1, f.b AS a2, coalesce(b.b, 'unknown') AS b2, f.sites + coalesce(b.sites, 0) AS sites FROM (SELECT * FROM named WHERE NOT back) f LEFT JOIN (SELECT * FROM named WHERE back) b USING (name))
SELECT CASE WHEN a1 = b1 THEN a1 WHEN a1 = 'unknown' THEN b1 WHEN b1 = 'unknown' THEN a1 WHEN 'nonsense' IN (a1, b1) THEN 'nonsense' ELSE 'conflict' END AS klass,
  CASE WHEN a2 = b2 THEN a2 WHEN a2 = 'unknown' THEN b2 WHEN b2 = 'unknown' THEN a2 WHEN 'nonsense' IN (a2, b2) THEN 'nonsense' ELSE 'conflict' END AS klass2, count(*) AS n, sum(sites)::BIGINT AS sites FROM j GROUP BY ALL"""

#: Matrices of both strands at the classes and letters of placed reads.
_SEEN_MATRIX = f"WITH {X.PLACED_SQL}, {X.BASES_SQL}, seen AS (SELECT rc, d::INTEGER AS depth, b::INTEGER AS read_b, count(*) AS n FROM bases GROUP BY ALL), t AS (" + _REVERSE_SUM + " FROM (SELECT unnest(range(0, 31)) AS d), (SELECT unnest(range(0, 5)) AS b), (SELECT unnest([true, false]) AS rc)" + ") SELECT t.*, n FROM t JOIN seen USING (rc, depth, read_b)"

ORACLES: dict[str, str] = {
    "s1_input_kind": f"WITH {X.READS_SQL} SELECT 'fasta' AS kind, count(*) AS n, sum(least(length(dna), 256))::BIGINT AS bases FROM docs UNION ALL SELECT 'fastq', count(*), sum(len)::BIGINT FROM reads",
    "s7_matrix_file": _SEEN_MATRIX,
    "s15_options": """WITH o AS (SELECT c_custkey % 18 AS k, c_nationkey AS h, c_custkey % 2 = 0 AS circular, CASE c_custkey % 3 WHEN 0 THEN 'quality' WHEN 1 THEN 'score' END AS dedup, c_custkey % 5 = 0 AS collapse, c_nationkey % 4 AS tolerance, c_custkey % 7 = 0 AS distant FROM customer),
f AS (SELECT *, k BETWEEN 1 AND 14 AND h > 0 AS fine, concat_ws(' ', '-k ' || k, '-H ' || h, CASE WHEN circular THEN '-c' END, CASE dedup WHEN 'quality' THEN '-U' WHEN 'score' THEN '-u' END, CASE WHEN collapse THEN '-C ' || tolerance END, CASE WHEN distant THEN '-D' END) AS line FROM o)
SELECT line, fine, CASE WHEN fine THEN k END::INTEGER AS kmer, CASE WHEN fine THEN dedup END AS dedup, CASE WHEN fine THEN collapse END AS collapse, CASE WHEN fine THEN CASE WHEN collapse THEN tolerance ELSE 0 END END::INTEGER AS tolerance,
  CASE WHEN fine THEN circular END AS circular, CASE WHEN fine THEN distant END AS distant, CASE WHEN fine THEN h END::INTEGER AS hard_cut FROM f""",
    "s12_newest_sibling": "SELECT (r_regionkey * 3 + 1)::BIGINT AS number, 'state.' || (SELECT max(r_regionkey * 3 + 1) FROM region) AS newest FROM region",
    "s3_fasta_scan": f"WITH {X.DOCS_SQL} SELECT 'd' || doc_id AS id, 'from text' AS \"desc\", md5(substr(dna, 1, 256)) AS seq_md5, least(length(dna), 256)::INTEGER AS seq_len FROM docs",
    "s4_fastq_scan": f"WITH {X.READS_SQL} SELECT substr(seq, 1, 4) AS head, count(*) AS n, sum(list_sum(list_transform(range(1, len + 1), lambda j: ascii(substr(qual, j, 1)) - 33)))::BIGINT AS qual_sum, sum(len)::BIGINT AS bases FROM reads GROUP BY 1",
    "s5_qual_sum": f"WITH {X.READS_SQL} SELECT doc_id, sum(list_sum(list_transform(range(1, len + 1), lambda j: ascii(substr(qual, j, 1)) - 33)))::BIGINT AS qual_sum FROM reads GROUP BY 1",
    "s6_reference_scan": f"WITH {X.REF_SQL}, m AS (SELECT lower(substr(s, 1, 41)) || substr(s, 42) AS s FROM refseq) SELECT 'ref' AS id, 'all items' AS \"desc\", md5(s) AS seq_md5, length(s)::INTEGER AS len, md5(reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))) AS rc_md5 FROM m",
    "s9_flat_matrix": f"WITH {X.PLACED_SQL}, {X.BASES_SQL}, seen AS (SELECT rc, d::INTEGER AS depth, b::INTEGER AS read_b, count(*) AS n FROM bases GROUP BY ALL) SELECT rc, read_b, " + ", ".join(f"sum(n * CASE WHEN read_b = 4 THEN -100 WHEN read_b = {k} THEN 200 ELSE -600 END)::BIGINT AS s{c}" for k, c in enumerate("acgt")) + " FROM seen GROUP BY ALL",
    "s10_id_list": f"WITH {X.READS_SQL} SELECT id, seq FROM reads WHERE id IN (SELECT 'r' || (doc_id * 100000) FROM labels)",
    "s11_assembly_import": f"WITH {X.PLACED_SQL} SELECT rc, segment, dropped, count(*) AS n, sum(score)::BIGINT AS score, sum(start)::BIGINT AS starts, sum(\"end\")::BIGINT AS ends, sum(length(seq))::BIGINT AS bases, sum(list_sum(list_transform(range(0, len), lambda k: {X.CLASS_SQL.format(k='k', len='len')})))::BIGINT AS smp, sum(CASE WHEN ins IS NULL THEN -1 ELSE ins_pos END)::BIGINT AS ins_at, sum(coalesce(length(ins), 0))::BIGINT AS ins_bases FROM placed GROUP BY ALL",
    "k2_fastq_lines": f"WITH {X.READS_SQL}, n AS (SELECT ord, seq, qual, id || ' ' || CASE WHEN doc_id % 2 = 1 THEN 'R' ELSE 'F' END || '|' || CASE WHEN doc_id % 3 = 0 THEN 'T' ELSE 'U' END AS name FROM reads) SELECT ord, md5('@' || name || chr(10) || seq || chr(10) || '+' || name || chr(10) || qual) AS record_md5 FROM n",
    "f1_id_semijoin": f"WITH {X.DOCS_SQL} SELECT doc_id, length(dna)::INTEGER AS len FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)",
    "f2_seed_filter": f"WITH {X.READS_SQL}, {_index(12)}, {_KMERS12} SELECT doc_id, count(*) AS n FROM reads WHERE ord IN (SELECT ord FROM rk WHERE kmer IN (SELECT kmer FROM idx)) GROUP BY 1",
    "f3_soft_mask": f"WITH m AS (SELECT lower(substr({_D}, 1, 40)) || substr({_D}, 41) AS s FROM benchmark), k0 AS (SELECT s, unnest(range(1, greatest(length(s) - 6, 1))) AS i FROM m), k AS (SELECT substr(s, i, 8) AS kmer FROM k0) SELECT {_CODE.format('kmer', k=8)} AS code, count(*) AS n FROM k WHERE NOT regexp_matches(kmer, '[a-z]') GROUP BY 1",
    "f4_f5_score_filters": f"SELECT rc, count(*) AS n, min(score)::INTEGER AS low FROM ({A.placed_items(12_000)}) GROUP BY 1",
    "f7_alignable_length": f"WITH {X.READS_SQL} SELECT doc_id, sum(greatest(len - (length(replace(seq, 'ACC', 'NNN')) - length(replace(replace(seq, 'ACC', 'NNN'), 'N', ''))), 15))::BIGINT AS alignable FROM reads GROUP BY 1",
    "f9_f11_overlap": f"WITH {X.PLACED_SQL} SELECT rc, count(*) FILTER (WHERE start <= 1000 AND 1000 <= \"end\") AS covering, count(*) FILTER (WHERE start < 1000 AND 1000 <= \"end\") AS gap_covering, count(*) FILTER (WHERE start <= 1100 AND \"end\" >= 900) AS overlapping FROM placed GROUP BY 1",
    "f12_f16_symbols": f"WITH s AS (SELECT translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'EFIJLOPQUXZ', '-----------') AS t FROM documents), e AS (SELECT substr(t, k, 2) AS pair FROM (SELECT t, unnest(range(1, length(t))) AS k FROM s)), p AS (SELECT left(pair, 1) AS a, right(pair, 1) AS b, count(*) AS n FROM e GROUP BY ALL) SELECT a, b, n, a IN ('A','C','G','T') AS valid, ({_MASK.format('a')}) & ({_MASK.format('b')}) <> 0 AS compatible, {_TV.format('a', 'b')} AS transversion, {_FIT.format(x='a', x2='a', y='b')} AS consistent, {_FIT.format(x='a', x2=_AGED.format('a'), y='b')} AS consistent_ancient FROM p",
    "f17_least_sites": f"WITH {_classes(3)} SELECT klass, count(*) AS n FROM k GROUP BY 1",
    "f18_span": f"WITH {_SITES}, t AS (SELECT *, {_TV.format('a', 'c')} AS tv FROM sites WHERE pos BETWEEN 1000 AND 2999) SELECT strength, false AS transversions_only, count(*) AS n, min(pos) AS first, max(pos) AS last FROM t GROUP BY 1 UNION ALL SELECT strength, true, count(*), min(pos), max(pos) FROM t WHERE tv GROUP BY 1",
    "f20_sequence_check": r"SELECT regexp_matches(w, '^[ACGTBDHVMKYRSWUNacgtbdhvmkyrswun]+$') AS ok, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \t\n\f\r]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1",
    "f19_safety_stop": f"WITH {X.REF_SQL}, l AS (SELECT unnest([600, 2369, 2370, length(s)])::BIGINT AS last FROM refseq), c AS (SELECT last, count(*) FILTER (WHERE pos % 60 = 29 AND pos < last) AS strong FROM ref, l GROUP BY 1) SELECT last, force, NOT force AND strong < 40 AS stopped FROM c, (SELECT unnest([true, false]) AS force)",
    "j1_seed_join": f"WITH {X.READS_SQL}, {_index(12)}, {_KMERS12}, {_CAPPED.format('pos')} SELECT ord, strand, count(*) AS hits, min(pos) AS first_pos, max(off)::INTEGER AS last_offset FROM rk JOIN capped USING (kmer) WHERE rn <= 128 GROUP BY ALL",
    "j2_seed_windows": f"""WITH {X.READS_SQL}, {_index(12)}, {_KMERS12}, {_CAPPED.format('off_')},
h AS (SELECT ord, strand, greatest(off_ - off - 10, 0) AS lo, least(off_ + len - off - CASE WHEN strand = 'f' THEN 0 ELSE 1 END + 10, 399) AS hi FROM rk JOIN capped USING (kmer) WHERE rn <= 128),
g AS (SELECT ord, strand, lo, hi, count(*) AS n FROM h GROUP BY ALL)
SELECT ord, strand, count(*)::INTEGER AS spans, sum(hi - lo + 1)::INTEGER AS width, sum(n) >= 128 AS whole FROM g GROUP BY ALL""",
    "w8_kmer_cap": f"WITH {_index(4)}, {_CAPPED.format('pos')} SELECT strand, {_CODE.format('kmer', k=4)} AS code, count(*) AS n, max(pos) AS last_pos FROM capped WHERE rn <= 128 GROUP BY ALL",
    "j3_align_items": A.placed_items(None),
    "x9_homopolymer_align": A.placed_items(None, True),
    "j4_strand_choice": f"SELECT rc, ord % 2 = 1 AS reversed, count(*) AS n, sum(score)::BIGINT AS score FROM ({A.placed_items(None)}) GROUP BY ALL",
    "j5_realign": A.realigned_items(),
    "j6_interval_coverage": f"WITH {X.PLACED_SQL}, ch AS (SELECT rc, start AS pos, 1 AS d FROM placed UNION ALL SELECT rc, \"end\" + 1, -1 FROM placed) SELECT rc, pos::INTEGER AS pos, (sum(sum(d)) OVER (PARTITION BY rc ORDER BY pos))::BIGINT AS depth FROM ch GROUP BY rc, pos",
    "j7_diagnostic_join": f"WITH {X.PLACED_SQL}, {_SITES}, b0 AS (SELECT start, seq, unnest(range(0, length(seq))) AS k FROM placed), b AS (SELECT (start + k)::INTEGER AS pos, substr(seq, k + 1, 1) AS y FROM b0) SELECT pos, strength, count(*) AS n, count(*) FILTER (WHERE {_FIT.format(x='a', x2=_AGED.format('a'), y='y')}) AS clean, count(*) FILTER (WHERE {_FIT.format(x='c', x2=_AGED.format('c'), y='y')}) AS dirt FROM b JOIN sites USING (pos) GROUP BY ALL",
    "j8_half_merge": """WITH r AS (SELECT l_orderkey || '.' || ((l_linenumber + 1) // 2) AS name, CASE WHEN l_linenumber % 2 = 1 THEN 'f' ELSE 'b' END AS seg, ['unknown','clean','dirt','conflict','nonsense'][l_partkey % 5 + 1] AS k1, ['unknown','clean','dirt','conflict','nonsense'][l_suppkey % 5 + 1] AS k2, l_quantity::BIGINT AS sites FROM lineitem),
g AS (SELECT name, seg, min(k1) AS k1, max(k2) AS k2, min(sites) AS sites FROM r GROUP BY ALL),
j AS (SELECT f.name, f.k1 AS a1, coalesce(b.k1, 'unknown') AS b1, f.k2 AS a2, coalesce(b.k2, 'unknown') AS b2, f.sites + coalesce(b.sites, 0) AS sites FROM (SELECT * FROM g WHERE seg = 'f') f LEFT JOIN (SELECT * FROM g WHERE seg = 'b') b USING (name))
SELECT name, CASE WHEN a1 = b1 THEN a1 WHEN a1 = 'unknown' THEN b1 WHEN b1 = 'unknown' THEN a1 WHEN a1 = 'nonsense' OR b1 = 'nonsense' THEN 'nonsense' ELSE 'conflict' END AS klass,
  CASE WHEN a2 = b2 THEN a2 WHEN a2 = 'unknown' THEN b2 WHEN b2 = 'unknown' THEN a2 WHEN a2 = 'nonsense' OR b2 = 'nonsense' THEN 'nonsense' ELSE 'conflict' END AS klass2, sites FROM j""",
    "j10_lift_over": f"WITH {X.REF_SQL} SELECT pos AS col, coalesce(sum(CASE WHEN pos % 17 = 3 THEN 0 ELSE 1 END) OVER w, 0)::INTEGER AS pos, coalesce(sum(CASE WHEN pos % 23 = 5 THEN 0 ELSE 1 END) OVER w, 0)::INTEGER AS dirt_pos FROM ref WINDOW w AS (ORDER BY ref.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "j11_score_lookup": f"WITH {X.PLACED_SQL}, {X.BASES_SQL} SELECT rc, d::INTEGER AS depth, count(*) AS cov, count(*) FILTER (WHERE c = '-') AS gaps, " + ", ".join(f"sum(CASE WHEN c = '-' THEN 0 ELSE {X.score_sql(k)} END)::BIGINT AS s{c}" for k, c in enumerate("acgt")) + " FROM bases GROUP BY rc, d",
    "j9_pair_distance": f"WITH {X.REF_SQL}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE pos % 211 = 7) AS d FROM ref) SELECT d AS distance, n AS columns, 0::BIGINT AS gaps_a, d AS gaps_b FROM n",
    "j9_pair_items": f"WITH i AS (SELECT item_id, {_D} AS a, lead({_D}) OVER (ORDER BY item_id) AS b FROM benchmark) SELECT item_id, levenshtein(a, b) AS distance, levenshtein(a, b) AS cost, true AS whole FROM i WHERE b IS NOT NULL",
    "i2_iterate": f"WITH {X.REF_SQL} SELECT s AS consensus, true AS recovered FROM refseq",
    "i3_cull": A.culled_items(),
    "i4_check_classes": _CHECK,
    "a1_pileup": f"WITH {X.PILE_SQL} SELECT * FROM pile",
    "a2_consensus": f"WITH {X.PILE_SQL} SELECT pos, {X.call_sql(1)} AS cons, round({X.FRAC_SQL}, 9) AS frac_agree FROM pile",
    "a2_consensus_strict": f"WITH {X.PILE_SQL} SELECT pos, {X.call_sql(2)} AS cons FROM pile",
    "a3_phred": f"WITH v AS (SELECT l_orderkey, l_linenumber, trunc(l_quantity * 10)::BIGINT AS sa, (l_partkey % 500)::BIGINT AS sc, (l_suppkey % 70 * 5)::BIGINT AS sg, (l_linenumber * 60)::BIGINT AS st FROM lineitem) SELECT l_orderkey, l_linenumber, {X.PHRED_SQL} AS phred FROM v",
    "a4_insertions": f"WITH {X.PLACED_SQL}, {X.INS_SQL} SELECT *, {X.call_sql(1)} AS cons FROM pile_ins",
    "a5_consensus_string": "WITH " + X.COLUMNS_SQL.replace("pile AS (SELECT pos, ", "pile AS (SELECT pos, ", 1).replace("FROM bases GROUP BY pos)", "FROM bases WHERE NOT dropped GROUP BY pos)", 1) + " SELECT replace(string_agg(cons, '' ORDER BY pos, place), '-', '') AS consensus FROM cols WHERE NOT (pos = 0 AND ins_idx >= 0)",
    "a6_gapped_consensus": f"WITH {X.COLUMNS_SQL} SELECT string_agg(cons, '' ORDER BY pos, place) AS consensus FROM cols",
    "a7_gap_lengths": f"WITH {X.PLACED_SQL}, {X.INS_SQL} SELECT pos, gap FROM gap",
    "a8_start_end_hist": f"WITH {X.PLACED_SQL}, {_ENDS} SELECT * FROM e",
    "a9_summary": f"WITH {X.PLACED_SQL} SELECT count(*) FILTER (WHERE segment <> 'b') AS fragments, sum(\"end\" - start + 1)::BIGINT AS total_length, sum(\"end\" - start + 1)::BIGINT / {X.SPAN} AS mean_coverage FROM placed",
    "a10_consensus_length": f"WITH {X.PLACED_SQL}, {X.INS_SQL} SELECT (sum(gap) + {X.SPAN})::BIGINT AS length FROM gap",
    "a11_quality_collapse": f"""WITH {X.READS_SQL}, e0 AS (SELECT doc_id % 200 AS cluster, seq, qual, unnest(range(0, len)) AS k FROM reads),
s AS (SELECT cluster, k, substr(seq, k + 1, 1) AS base, sum(ascii(substr(qual, k + 1, 1)) - 33) AS w FROM e0 GROUP BY ALL),
b AS (SELECT cluster, k, CASE WHEN max(w) > 0 THEN arg_max(base, w * 10 + instr('TGCA', base)) ELSE 'N' END AS base, sum(w) AS w FROM s GROUP BY ALL)
SELECT cluster, string_agg(base, '' ORDER BY k) AS called, sum(w)::BIGINT AS weight FROM b GROUP BY 1""",
    "a12_collapse": f"WITH {_COORD}, w AS (SELECT *, row_number() OVER (PARTITION BY rc, s, e ORDER BY score DESC, ord) AS rn FROM c), m AS (SELECT rc, s, e, count(*) AS n FROM w WHERE rn = 1 OR score >= 20 GROUP BY ALL) SELECT ord, CASE WHEN rn = 1 THEN n ELSE 1 END::INTEGER AS num_inputs, rn = 1 AS unique_best FROM w JOIN m USING (rc, s, e) WHERE rn = 1 OR score < 20",
    "a14_read_class": f"WITH {_classes(1)} SELECT user_id, sites, votes, klass, klass2 FROM k",
    "a15_class_histogram": f"WITH {_classes(1)} SELECT klass, klass2, count(*) AS n FROM k GROUP BY ALL",
    "a16_wilson_interval": f"WITH t AS (SELECT source, sum(toxic)::DOUBLE AS k, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT source, {_wilson('k', 'n')} FROM t",
    "a17_diagnostic_sites": f"WITH {_SITES} SELECT strength, count(*) AS n, count(*) FILTER (WHERE {_TV.format('a', 'c')}) AS transversions FROM sites GROUP BY 1",
    "a18_majority": _majority(70, "gaps"),
    "a18_majority_strict": _majority(50, "strict"),
    "a19_symbol_sets": f"WITH {X.READS_SQL}, p AS (SELECT substr(seq, 1 + 12 * k, 12) AS part FROM (SELECT seq, unnest(range(0, (len + 11) // 12)) AS k FROM reads)), b AS (SELECT CASE WHEN contains(part, 'A') THEN 'A' ELSE '' END || CASE WHEN contains(part, 'C') THEN 'C' ELSE '' END || CASE WHEN contains(part, 'G') THEN 'G' ELSE '' END || CASE WHEN contains(part, 'T') THEN 'T' ELSE '' END AS bases FROM p) SELECT bases, symbol, count(*) AS n FROM b JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in AMBIGUITY.items()) + ") t(bases, symbol) USING (bases) GROUP BY ALL",
    "w1_read_order": f"WITH {_COORD} SELECT ord, row_number() OVER (PARTITION BY rc ORDER BY CASE WHEN rc THEN -e ELSE s END, CASE WHEN rc THEN s ELSE -e END, score DESC, ord) AS place FROM c",
    "w2_dedup_exact": f"WITH {_COORD} SELECT ord, row_number() OVER w = 1 AS unique_best, first_value(ord) OVER w AS cluster FROM c WINDOW w AS (PARTITION BY rc, s, e ORDER BY score DESC, ord)",
    "w2_dedup_tolerance": """WITH RECURSIVE c AS (SELECT (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey AS ord, l_returnflag = 'R' AS rc, l_quantity::INTEGER AS score, l_linestatus = 'F' AS trimmed FROM lineitem),
p AS (SELECT *, (ord % 1000003)::INTEGER AS s, (ord % 1000003 + 30 + ord % 5)::INTEGER AS e, CASE WHEN rc THEN -(ord % 1000003 + 30 + ord % 5) ELSE ord % 1000003 END AS five, CASE WHEN rc THEN ord % 1000003 ELSE -(ord % 1000003 + 30 + ord % 5) END AS three FROM c),
n AS (SELECT *, CASE WHEN five - lag(five) OVER (PARTITION BY rc ORDER BY five) <= 40 THEN 0 ELSE 1 END AS fresh FROM p),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY rc ORDER BY five) AS island FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY rc, island ORDER BY five, three, score DESC, ord) AS k FROM i),
f AS (SELECT rc, island, k, ord, s AS ls, e AS le, true AS unique_best FROM o WHERE k = 1
  UNION ALL SELECT o.rc, o.island, o.k, o.ord, CASE WHEN abs(o.s - ls) <= 40 AND abs(o.e - le) <= 40 THEN ls ELSE o.s END, CASE WHEN abs(o.s - ls) <= 40 AND abs(o.e - le) <= 40 THEN le ELSE o.e END,
    CASE WHEN abs(o.s - ls) <= 40 AND abs(o.e - le) <= 40 THEN false ELSE NOT CASE WHEN o.rc THEN o.e = le ELSE o.s = ls END OR o.trimmed END FROM f JOIN o ON o.rc = f.rc AND o.island = f.island AND o.k = f.k + 1)
SELECT ord, unique_best FROM f""",
    "w1q_dedup_quality": f"WITH {_COORD} SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY rc, s, e ORDER BY qual_sum DESC, ord) AS rn FROM c) WHERE rn = 1",
    "w3_placed_order": f"WITH {X.PLACED_SQL} SELECT ord, row_number() OVER (PARTITION BY segment ORDER BY start, \"end\", ord) AS place FROM placed",
    "w4_homopolymers": f"WITH {X.DOCS_SQL}, r AS (SELECT unnest(regexp_extract_all(dna, 'A+|C+|G+|T+')) AS run FROM docs) SELECT left(run, 1) AS base, length(run)::INTEGER AS len, count(*) AS n FROM r GROUP BY ALL",
    "w5_gap_prefix": f"WITH {X.PLACED_SQL}, {X.INS_SQL} SELECT pos, gap, (coalesce(sum(gap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before FROM gap",
    "w7_matrix_class": f"WITH {X.PLACED_SQL}, p AS (SELECT len, unnest(range(0, len)) AS k FROM placed) SELECT len, ({X.CLASS_SQL.format(k='k', len='len')})::INTEGER AS depth, count(*) AS n, sum(k)::BIGINT AS places FROM p GROUP BY 1, 2",
    "g4_cutoff_line": f"WITH {_LINE} SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM line",
    "f6_length_score_cull": f"WITH {_LINE} SELECT coalesce(score < intercept + slope * len, false) AS dropped, count(*) AS n, sum(score)::BIGINT AS score FROM r, line WHERE u GROUP BY 1",
    "x1_base_index": f"WITH {X.PLACED_SQL}, {X.BASES_SQL} SELECT c AS base, b::INTEGER AS inx, count(*) AS n FROM bases GROUP BY ALL",
    "x2_kmer_index": f"WITH {X.DOCS_SQL}, k0 AS (SELECT doc_id, dna, unnest(range(1, greatest(length(dna) - 6, 1))) AS i FROM docs), k AS (SELECT doc_id, {_CODE.format('substr(dna, i, 8)', k=8)} AS code FROM k0) SELECT doc_id, count(*) AS n, sum(code)::BIGINT AS total, max(code) AS most FROM k GROUP BY 1",
    "x4_revcomp": f"WITH {X.DOCS_SQL} SELECT doc_id, md5({_REVCOMP.format('dna')}) AS rc_md5, md5(dna) AS twice_md5 FROM docs",
    "x5_mirror_position": "SELECT p_partkey, 500 - (p_partkey * 7 % 500) - 1 AS mirrored FROM part",
    "x6_ref_wrap": f"SELECT item_id, {_D} || left({_D}, 256) AS wrapped FROM benchmark",
    "x8_iupac_bitmap": f"WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS c FROM benchmark) SELECT item_id, sum({_MASK.format('c')})::BIGINT AS bits FROM c GROUP BY 1",
    "x9_homopolymer_penalty": "SELECT DISTINCT l_linenumber AS gap, trunc(l_quantity % 13)::INTEGER AS run, (l_linenumber * 200 + [1000, 500, 330, 250, 200, 170, 140, 130, 110, 100][least(greatest(trunc(l_quantity % 13)::INTEGER, 1), 10)])::INTEGER AS penalty FROM lineitem",
    "x10_row_class": f"WITH {X.READS_SQL}, l AS (SELECT DISTINCT len FROM reads), r AS (SELECT len, unnest(range(0, len))::INTEGER AS row FROM l) SELECT len, row, (CASE WHEN row < 15 THEN row WHEN len - row - 1 < 15 THEN 30 - (len - row - 1) ELSE 15 END)::INTEGER AS depth FROM r",
    "x11_reverse_matrix": _SEEN_MATRIX,
    "x12_adapter_trim": f"WITH {X.READS_SQL} SELECT ord, len::BIGINT AS expected, (len - 1)::BIGINT AS trim_point FROM reads UNION ALL SELECT -1 - item_id, length({_D}), length({_D}) - 1 FROM benchmark",
    "x13_adapters": f"WITH a AS (SELECT doc_id, substr(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), 1, (doc_id % 140)::INTEGER) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) BETWEEN 2 AND 127 THEN t WHEN t IN ('n', 'N') THEN '{ADAPTERS['n']}' ELSE '{ADAPTERS['s']}' END AS adapter FROM a",
    "x14_split": f"""WITH {X.READS_SQL}, p AS (SELECT ((doc_id * 131 + i * 50) % {X.SPAN})::INTEGER AS s, seq, len, CASE WHEN len > 5 THEN substr(seq, 1, 2) ELSE '' END AS ins FROM reads),
q AS (SELECT *, s + len - 1 AS e, s + 3 AS ip FROM p),
w AS (SELECT 'a' AS segment, s AS start, e AS "end", seq, CASE WHEN ins = '' THEN -1 ELSE ip END AS ip, ins FROM q WHERE e < {X.SPAN}
  UNION ALL SELECT 'f', s, {X.SPAN} - 1, substr(seq, 1, {X.SPAN} - s), CASE WHEN ins <> '' AND ip < {X.SPAN} THEN ip ELSE -1 END, CASE WHEN ip < {X.SPAN} THEN ins ELSE '' END FROM q WHERE e >= {X.SPAN}
  UNION ALL SELECT 'b', 0, e - {X.SPAN}, substr(seq, {X.SPAN} - s + 1), CASE WHEN ins <> '' AND ip >= {X.SPAN} THEN ip - {X.SPAN} ELSE -1 END, CASE WHEN ip >= {X.SPAN} THEN ins ELSE '' END FROM q WHERE e >= {X.SPAN})
SELECT segment, substr(seq, 1, 2) AS head, ins, count(*) AS n, sum(start)::BIGINT AS starts, sum("end")::BIGINT AS ends, sum(length(seq))::BIGINT AS bases, sum(ip)::BIGINT AS "at" FROM w GROUP BY ALL""",
    "x18_region": "SELECT c_custkey, least(c_custkey % 97, c_nationkey * 4)::BIGINT AS low, greatest(c_custkey % 97, c_nationkey * 4)::BIGINT AS high FROM customer",
    "x17_plain_name": "SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN p_name || '_x' ELSE p_name END AS name FROM part",
    "k3_clustal": f"""WITH {X.COLUMNS_SQL},
t AS (SELECT string_agg(ref_base, '' ORDER BY pos, place) AS r, string_agg(cons, '' ORDER BY pos, place) AS c, string_agg(CASE WHEN ref_base = cons THEN '*' ELSE ' ' END, '' ORDER BY pos, place) AS m FROM cols),
b AS (SELECT *, unnest(range(0, (length(r) - 1) // 60 + 1)) AS block FROM t)
SELECT block, rpad('reference', 15, ' ') || ' ' || substr(r, block * 60 + 1, 60) || chr(10) || rpad('Consensus', 15, ' ') || ' ' || substr(c, block * 60 + 1, 60) || chr(10) || rpad('', 15, ' ') || ' ' || substr(m, block * 60 + 1, 60) || chr(10) AS value FROM b""",
    "k4_line": f"WITH {X.COLUMNS_SQL} SELECT string_agg(cons, '' ORDER BY pos, place) AS consensus, string_agg(ref_base, '' ORDER BY pos, place) AS reference, string_agg(cov::VARCHAR, ' ' ORDER BY pos, place) AS coverage FROM cols",
    "k5_table": f"WITH {X.COLUMNS_SQL}, {_ENDS} SELECT cols.pos, cons, ref_base, cov, cols.pos + 1 AS position, " + ", ".join(f"CASE WHEN ins_idx < 0 THEN coalesce({c}, 0) ELSE 0 END AS {c}" for c in ("fwd_starts", "rev_starts", "fwd_ends", "rev_ends")) + " FROM cols LEFT JOIN e USING (pos) WHERE NOT (ref_base = '-' AND cons = '-')",
    "k6_details": f"WITH {X.COLUMNS_SQL} SELECT pos, ins_idx, ref_base, cons, cov, na, nc, ng, nt, gaps, sa, sc, sg, st, phred, round(frac_agree, 9) AS frac_agree FROM cols WHERE ref_base <> cons",
    "k6_details_all": f"WITH {X.COLUMNS_SQL} SELECT pos, ins_idx, ref_base, cons, cov, na, nc, ng, nt, gaps, sa, sc, sg, st, phred, round(frac_agree, 9) AS frac_agree FROM cols",
    "k7_fasta": f"WITH {X.COLUMNS_SQL}, t AS (SELECT replace(string_agg(cons, '' ORDER BY pos, place), '-', '') AS s FROM cols) SELECT '>Consensus' || chr(10) || array_to_string(list_transform(range(0, (length(s) + 59) // 60), lambda i: substr(s, i * 60 + 1, 60)), chr(10)) AS value FROM t",
    "k8_region": f"WITH {_REGION} SELECT start, \"end\", name, text FROM region_",
    "k8_region_fasta": f"WITH {_REGION} SELECT start, \"end\", '>' || name || chr(10) || {_wrap('text', 60)} AS value FROM region_",
    "k9_colour": f"WITH {_REGION} SELECT start, \"end\", rpad(substr(name, 1, 20), 20, ' ') || ' ' || {_COLOURED} AS value FROM region_",
    "k10_ace": _ACE,
    "k11_contamination_report": f"WITH {_classes(1)}, q AS (SELECT " + ", ".join(f"count(*) FILTER (WHERE klass2 = '{k}') AS {v}" for k, v in (("unknown", "unclassified"), ("clean", "clean"), ("dirt", "polluting"), ("conflict", "conflicting"), ("nonsense", "nonsensical"))) + f" FROM k) SELECT *, {_wilson('polluting', '(polluting + clean)')} FROM q",
}
