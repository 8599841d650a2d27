"""DuckDB SQL for alignment: the recurrence of the kernel, a row of all columns at a time.

A step of the recursion goes from one read base to the next. Its rows are the open columns of
all reads; the best gap along the reference is a window over them, the best gap along the
read is carried by column. Each cell brings its start, its letters and its insertions along.
"""

from __future__ import annotations

from . import fixtures as X
from .functions.seq import HOMOPOLYMER_SHARES

GAP_OPEN, GAP_EXTEND = 1000, 200
FLAT_SQL = "CASE WHEN {read} NOT IN ('A', 'C', 'G', 'T') THEN -100 WHEN {ref} = {read} THEN 200 ELSE -600 END"
_REVCOMP = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def item_index(k: int) -> str:
    """``ref2`` (strand, s, n) and ``idx`` (strand, pos, kmer) of the whole reference on both strands."""
    return f"""ref2 AS (SELECT 'f' AS strand, s, length(s) AS n FROM refseq UNION ALL SELECT 'r', {_REVCOMP.format('s')}, length(s) FROM refseq),
idx AS (SELECT strand, pos, kmer FROM (SELECT strand, pos, substr(s, pos + 1, {k}) AS kmer, row_number() OVER (PARTITION BY strand, substr(s, pos + 1, {k}) ORDER BY pos) AS rank
  FROM (SELECT strand, s, unnest(range(0, n - {k} + 1)) AS pos FROM ref2)) WHERE rank <= 128)"""


def seed_columns(k: int) -> str:
    """``col`` (ord, strand, c): the columns that seeds of ``rd`` (ord, seq) open."""
    return f"""hit AS (SELECT ord, strand, pos, off, length(seq) AS len FROM (SELECT ord, seq, unnest(range(0, length(seq) - {k} + 1)) AS off FROM rd WHERE length(seq) >= {k}) q JOIN idx ON idx.kmer = substr(seq, off + 1, {k})),
span AS (SELECT ord, strand, greatest(pos - off - 10, 0) AS lo, least(pos + len - off - CASE WHEN strand = 'f' THEN 0 ELSE 1 END + 10, n - 1) AS hi FROM hit JOIN ref2 USING (strand)),
per AS (SELECT ord, strand, count(*) >= 128 AS whole FROM span GROUP BY ALL),
col AS (SELECT DISTINCT ord, strand, unnest(range(lo, hi + 1)) AS c FROM span JOIN per USING (ord, strand) WHERE NOT whole
  UNION SELECT ord, strand, unnest(range(0, n)) FROM per JOIN ref2 USING (strand) WHERE whole)"""


def _share(length: str) -> str:
    """Cost of opening a gap within a run of so many letters."""
    costs = ", ".join(str(int(GAP_OPEN * x)) for x in HOMOPOLYMER_SHARES)
    return f"([{costs}])[least({length}, {len(HOMOPOLYMER_SHARES)})]"


def recurrence(score: str, discount: bool = False) -> str:
    """``best`` (ord, strand, score, last, st, seq, ins) from ``job`` (ord, strand, rd, s, c): reads, references, open columns.

    ``score`` is SQL for a cell of ``read`` and ``ref`` letters at row ``r`` of ``len``. With
    ``discount`` gaps within homopolymers cost less: over the start of a run of the reference,
    from the column before it, and over the start of a run of the read, from the row before
    it, which ``run`` brings along.
    """
    way = "STRUCT(st INTEGER, seq VARCHAR, ins STRUCT(p INTEGER, x VARCHAR)[])"
    cs = "(c + 1 - length(regexp_extract(substr(s, greatest(c - 63, 0) + 1, least(c + 1, 64)), '(A+|C+|G+|T+|N+)$')))::INTEGER AS cs" if discount else "0 AS cs"
    run = "CASE WHEN substr(rd, r + 2, 1) <> substr(rd, r + 1, 1) THEN {v: now, i: r + 1, w: way} ELSE run END AS run" if discount else f"NULL::STRUCT(v BIGINT, i INTEGER, w {way}) AS run"
    length = lambda start: f"length(regexp_extract(substr(rd, {start} + 1), '^(A+|C+|G+|T+|N+)'))"
    back = "coalesce(CASE WHEN letter = ref AND substr(rd, r, 1) <> letter AND cs <> c AND cs > 0 THEN back_from.v - " + f"{GAP_EXTEND} * (c - cs) - {_share(length('r'))} END, -1000000000)" if discount else "-1000000000"
    fore = f"coalesce(CASE WHEN letter = ref AND substr(rd, r, 1) = letter AND cs = c THEN run_from.v - {_share(length('run_from.i'))} END, -1000000000)" if discount else "-1000000000"
    back_from = "max({v: was, w: was_way}) OVER (PARTITION BY ord, strand ORDER BY c RANGE BETWEEN (c - cs + 1) PRECEDING AND (c - cs + 1) PRECEDING)" if discount else f"NULL::STRUCT(v BIGINT, w {way})"
    gap, begin = f"- {GAP_OPEN} - {GAP_EXTEND} *", f"(-({GAP_OPEN} + {GAP_EXTEND} * (r + 1)))"
    return f"""grid AS (SELECT ord, strand, rd, length(rd)::INTEGER AS len, c::INTEGER AS c, substr(s, c + 1, 1) AS ref, {cs}, c = min(c) OVER p AS edge,
    coalesce(max(c) OVER (PARTITION BY ord, strand ORDER BY c RANGE BETWEEN 2 FOLLOWING AND 2 FOLLOWING), -1) >= 0 OR c = min(c) OVER p AS allowed FROM job WINDOW p AS (PARTITION BY ord, strand)),
cell AS (
  SELECT ord, strand, rd, len, c, ref, cs, edge, allowed, 0 AS r, ({score.format(ref='ref', read='substr(rd, 1, 1)', r='0')})::BIGINT AS now, NULL::BIGINT AS past, {{st: c, seq: substr(rd, 1, 1), ins: []::STRUCT(p INTEGER, x VARCHAR)[]}} AS way,
    NULL::STRUCT(st INTEGER, seq VARCHAR, ins STRUCT(p INTEGER, x VARCHAR)[]) AS past_way, NULL::STRUCT(v BIGINT, i INTEGER, w STRUCT(st INTEGER, seq VARCHAR, ins STRUCT(p INTEGER, x VARCHAR)[])) AS held,
    NULL::STRUCT(v BIGINT, i INTEGER, w {way}) AS run FROM grid
  UNION ALL
  SELECT ord, strand, rd, len, c, ref, cs, edge, allowed, r, CASE WHEN edge THEN base + {begin} WHEN {begin} > pick THEN {begin} ELSE base + pick END AS now, was, 
    CASE WHEN edge OR {begin} > pick THEN {{st: c, seq: letter, ins: []}} WHEN pick = diag THEN {{st: diag_way.st, seq: diag_way.seq || letter, ins: diag_way.ins}}
      WHEN pick = over THEN {{st: over_from.w.st, seq: over_from.w.seq || repeat('-', c - 1 - over_from.k) || letter, ins: over_from.w.ins}}
      WHEN pick = along THEN {{st: read_from.w.st, seq: read_from.w.seq || letter, ins: list_append(read_from.w.ins, {{p: c, x: substr(rd, read_from.i + 2, r - 1 - read_from.i)}})}}
      WHEN pick = back THEN {{st: back_from.w.st, seq: back_from.w.seq || repeat('-', c - cs) || letter, ins: back_from.w.ins}}
      ELSE {{st: run_from.w.st, seq: run_from.w.seq || letter, ins: list_append(run_from.w.ins, {{p: c, x: substr(rd, run_from.i + 1, r - run_from.i)}})}} END,
    was_way, held, run
  FROM (SELECT *, greatest(diag, over, along, back, fore) AS pick FROM (
    SELECT *, {back} AS back, {fore} AS fore, coalesce(diag0, -1000000000) AS diag, coalesce(over_from.v {gap} (c - 1), -1000000000) AS over, coalesce(read_from.v {gap} (r - 1), -1000000000) AS along FROM (
      SELECT ord, strand, rd, len, c, ref, cs, edge, allowed, r, was, was_way, held, run, substr(rd, r + 1, 1) AS letter, ({score.format(ref='ref', read='substr(rd, r + 1, 1)', r='r')})::BIGINT AS base,
        max(was) OVER one AS diag0, max(was_way) OVER one AS diag_way, max(held) OVER one AS read_from, max(run) OVER one AS run_from, {back_from} AS back_from,
        max(CASE WHEN allowed THEN {{v: was + {GAP_EXTEND} * c, k1: -c, k: c, w: was_way}} END) OVER (PARTITION BY ord, strand ORDER BY c RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS over_from
      FROM (SELECT ord, strand, rd, len, c, ref, cs, edge, allowed, r + 1 AS r, now AS was, way AS was_way, {run},
          CASE WHEN r + 1 >= 2 AND (held IS NULL OR past + {GAP_EXTEND} * (r - 1) > held.v) THEN {{v: past + {GAP_EXTEND} * (r - 1), i: r - 1, w: past_way}} ELSE held END AS held FROM cell WHERE r + 1 < len)
      WINDOW one AS (PARTITION BY ord, strand ORDER BY c RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING))))),
best AS (SELECT ord, strand, now AS score, c AS last, way.st AS st, way.seq AS seq, way.ins AS ins FROM cell WHERE r = len - 1 QUALIFY row_number() OVER (PARTITION BY ord, strand ORDER BY now DESC, c) = 1)"""


_ITEM_READ = "substr(t, 1, 30) || translate(substr(t, 31, 1), 'ACGT', 'CATG') || substr(t, 32, 20) || substr(t, 54, 17) || CASE WHEN length(t) >= 71 THEN 'CA' ELSE '' END || substr(t, 71)"
#: Reads of 100 letters at steps of 50 over all items, with a change, a gap and an insertion; odd ones reversed.
ITEM_READS_SQL = f"""item AS (SELECT item_id, {X.DNA_SQL.format('text')} AS dna FROM benchmark),
place AS (SELECT item_id, dna, coalesce(sum(length(dna)) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM item),
part AS (SELECT item_id, i, before + 50 * i AS first, substr(dna, 1 + 50 * i, 100) AS t FROM (SELECT item_id, dna, before, unnest(range(0, (length(dna) + 49) // 50)) AS i FROM place WHERE length(dna) > 0)),
rd AS (SELECT item_id * 1000 + i AS ord, CASE WHEN i % 2 = 1 THEN {_REVCOMP.format(_ITEM_READ)} ELSE {_ITEM_READ} END AS seq FROM part)"""

#: The better strand of ``best``, seen from the forward one.
CHOSEN_SQL = f"""pair AS (SELECT coalesce(f.ord, r.ord) AS ord, f.score AS fw, r.score AS rv FROM (SELECT * FROM best WHERE strand = 'f') f FULL JOIN (SELECT * FROM best WHERE strand = 'r') r ON f.ord = r.ord),
won AS (SELECT best.*, strand = 'r' AS rc, n FROM pair JOIN best USING (ord) JOIN ref2 USING (strand) WHERE strand = CASE WHEN coalesce(fw, -1073741824) > coalesce(rv, -1073741824) THEN 'f' ELSE 'r' END),
seen AS (SELECT ord, score, rc, CASE WHEN rc THEN n - last - 1 ELSE st END AS start, CASE WHEN rc THEN n - st - 1 ELSE last END AS "end", CASE WHEN rc THEN {_REVCOMP.format('seq')} ELSE seq END AS seq,
  list_sort(list_transform(ins, lambda x: CASE WHEN rc THEN {{p: (n - x.p)::INTEGER, x: {_REVCOMP.format('x.x')}}} ELSE {{p: x.p, x: x.x}} END)) AS ins FROM won)"""
#: Insertions as text, in order.
INS_TEXT_SQL = "array_to_string(list_transform(ins, lambda x: x.p || ':' || x.x), ',')"


def placed_items(least: int | None, discount: bool = False) -> str:
    """Reads of all items on the whole reference where 12-letter seeds open it; with ``discount`` a run of each read lacks a letter and one has a letter more."""
    reads = ITEM_READS_SQL.replace("rd AS (SELECT", "rd0 AS (SELECT") + ", rd AS (SELECT ord, regexp_replace(regexp_replace(seq, 'AA', 'A'), 'CC', 'CCC') AS seq FROM rd0)" if discount else ITEM_READS_SQL
    some = "" if least is None else f" WHERE score >= {least}"
    return f"""WITH RECURSIVE {X.REF_SQL}, {item_index(12)}, {reads}, {seed_columns(12)},
job AS (SELECT ord, strand, seq AS rd, s, c FROM col JOIN rd USING (ord) JOIN ref2 USING (strand)),
{recurrence(FLAT_SQL, discount)}, {CHOSEN_SQL}
SELECT ord, score::INTEGER AS score, rc, start::INTEGER AS start, "end"::INTEGER AS "end", seq, {INS_TEXT_SQL} AS ins FROM seen{some}"""


def _matrix_sql() -> str:
    """A cell of the matrices of either strand at its row's class."""
    base = "CASE WHEN {read} IN ('A', 'C', 'G', 'T') THEN instr('ACGT', {read}) - 1 ELSE 4 END"
    depth = "CASE WHEN {r} < 15 THEN {r} WHEN len - {r} - 1 < 15 THEN 30 - (len - {r} - 1) ELSE 15 END"
    return "CASE {ref} " + " ".join(f"WHEN '{b}' THEN {X.score_sql(k, f'({base})', f'({depth})', chr(40) + 'strand = ' + chr(39) + 'r' + chr(39) + chr(41))}" for k, b in enumerate("ACGT")) + " END"


_SEEN_SQL = "(length(replace(substr(seq, 1, k), '-', '')) + coalesce(list_sum(list_transform(list_filter(ins, lambda x: x.p <= st + k), lambda x: length(x.x))), 0))"
#: Matrix classes of all placed positions, by the read's letters from either end.
_CLASSES_SQL = f"array_to_string(list_transform(range(0, length(seq)), lambda k: (CASE WHEN {_SEEN_SQL} <= 15 THEN {_SEEN_SQL} WHEN len - {_SEEN_SQL} - 1 < 15 THEN 30 - (len - {_SEEN_SQL} - 1) ELSE 15 END)::INTEGER), ',')"


def realigned_items() -> str:
    """Oriented reads of all items in windows around their places."""
    return f"""WITH RECURSIVE {X.REF_SQL}, {ITEM_READS_SQL},
own AS (SELECT item_id * 1000 + i AS ord, CASE WHEN i % 2 = 1 THEN 'r' ELSE 'f' END AS strand, {_ITEM_READ} AS rd, first, first + length(t) - 1 AS ae, s, length(s) AS n FROM part, refseq),
near AS (SELECT *, greatest(first - 50, 0) AS lo, CASE WHEN ae + 51 > n THEN n ELSE ae + 50 END AS hi FROM own),
job AS (SELECT ord, strand, rd, s, unnest(range((CASE WHEN lo + length(rd) > hi THEN 0 ELSE lo END)::BIGINT, (CASE WHEN lo + length(rd) > hi THEN n ELSE hi END)::BIGINT)) AS c FROM near),
{recurrence(_matrix_sql())}
SELECT ord, score::INTEGER AS score, strand = 'r' AS rc, st::INTEGER AS start, last::INTEGER AS "end", seq, {INS_TEXT_SQL} AS ins, {_CLASSES_SQL} AS smp FROM best JOIN (SELECT ord, length(rd)::INTEGER AS len FROM own) USING (ord)"""


def culled_items() -> str:
    """Flags of placed reads of all items: the best of each place, and the line of scores over lengths."""
    return f"""WITH p AS ({placed_items(2000)}),
{ITEM_READS_SQL},
u AS (SELECT p.*, length(rd.seq) AS len, row_number() OVER w = 1 AS unique_best, first_value(ord) OVER w AS cluster FROM p JOIN rd USING (ord) WINDOW w AS (PARTITION BY rc, start, "end" ORDER BY score DESC, ord)),
g AS (SELECT len::DOUBLE AS x, score::DOUBLE AS y FROM u WHERE unique_best),
l AS (SELECT regr_slope(y, x) AS m0, regr_intercept(y, x) AS b FROM g),
e AS (SELECT m0, b, greatest(0.0, (SELECT max((y - (m0 * x + b)) / x) FROM g)) AS d FROM l),
m AS (SELECT b, CASE WHEN m0 - d > 0 THEN m0 - 2 * d ELSE m0 * 80 / 100 END AS m FROM e)
SELECT ord, unique_best, cluster, coalesce(score < b + CASE WHEN m <= 0 THEN 100.0 ELSE m END * len, false) AS dropped FROM u, m"""
