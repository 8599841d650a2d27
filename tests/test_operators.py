"""Relational operators, readers and writers, on small tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from strandspark.config import Settings
from strandspark.functions import scoring
from strandspark.functions import seq as S
from strandspark.operators import contam, cutoff, dedup, leaders, pileup, seeds
from strandspark.plans import assemble
from strandspark.sources import readers, writers


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_complement_and_names(spark):
    assert one(spark, S.reverse_complement(F.lit("ACGTNRYKMacg-*"))) == "N-cgtKMRYNACGT"
    assert one(spark, S.plain_name(F.lit("read1,_f"))) == "read1" and one(spark, S.plain_name(F.lit("a_b"))) == "a_b"
    assert one(spark, S.kmer_code(F.lit("acGT"))) == 27 and one(spark, S.kmer_code(F.lit("ACNT"))) is None
    assert one(spark, F.size(S.kmers(F.lit("ACG"), 4))) == 0
    assert one(spark, S.mirror_position(F.lit(12), F.lit(10))) == 7


def test_fasta_and_fastq_readers(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first > read\r\nacgt\nAC GT\n>two\n" + "A" * 300 + "\n>three x\n\n")
    rows = readers.reads(spark, str(tmp_path / "a.fa")).orderBy("ord").collect()
    assert [(r.id, r.desc, r.seq_len) for r in rows] == [("one", "first > read", 8), ("two", "", 256), ("three", "x", 0)]
    assert rows[0].seq == "ACGTACGT"
    (tmp_path / "b.fq").write_text("@r1 d\nacg\n+\nII!\n@r2\nAC\n+r2\n@@\n")
    rows = readers.reads(spark, str(tmp_path / "b.fq")).orderBy("ord").collect()
    assert [(r.id, r.desc, r.seq, r.qual, r.qual_sum) for r in rows] == [("r1", "d", "ACG", "II!", 80), ("r2", "", "AC", "@@", 62)]
    (tmp_path / "c.fq").write_text("@r1\nACG\n+\nII\n@r2\nAC\n+\nII\n")
    with pytest.raises(Exception, match="bad record"):
        readers.fastq(spark, str(tmp_path / "c.fq")).collect()
    assert [r.id for r in readers.fastq(spark, str(tmp_path / "c.fq"), mode="DROPMALFORMED").collect()] == ["r2"]
    name, desc, seq = readers.reference(spark, str(tmp_path / "a.fa"))
    assert (name, desc, seq) == ("one", "first > read", "acgtACGT")


def test_newest_sibling(spark, tmp_path):
    for k in (1, 2, 11):
        (tmp_path / f"run.{k}").write_text("x")
    assert readers.newest(spark, str(tmp_path / "run.1")).endswith("run.11")
    assert readers.newest(spark, str(tmp_path / "other")).endswith("other")


def alns(spark, rows):
    kinds = "ord bigint, id string, desc string, score int, num_inputs int, start int, end int, rc boolean, trimmed boolean, dropped boolean, segment string, seq string, smp array<int>, ins map<int,string>"
    return spark.createDataFrame(rows, kinds)


def test_assembly_text_round_trip(spark, tmp_path):
    rows = [(0, "a", "x y", 900, 1, 3, 6, False, True, False, "a", "AC-T", [0, 1, 2, 2], {5: "GG"}), (1, "b_f", "", 800, 2, 0, 1, True, False, True, "f", "CA", [15, 30], {})]
    writers.assembly_lines("ref", "some text", "ACGTACGTAC", [0] * 10, scoring.flat(), scoring.reverse(scoring.flat()), alns(spark, rows)).coalesce(1).write.text(str(tmp_path / "m"))
    head, got = readers.assembly_text(spark, str(tmp_path / "m"))
    assert head["id"] == "ref" and head["desc"] == "some text" and head["seq"] == "ACGTACGTAC" and len(head["forward"]) == 155
    found = {r.id: r for r in got.collect()}
    assert found["a"].ins == {5: "GG"} and found["a"].smp == [0, 1, 2, 2] and found["a"].desc == "x y" and found["a"].trimmed
    assert found["b_f"].num_inputs == 2 and found["b_f"].dropped and found["b_f"].segment == "f" and found["b_f"].ins == {}


def test_counts_add_up_and_ties_go_to_the_later_base(spark):
    rows = [(k, f"r{k}", "", 1, 1, 0, 3, False, False, False, "a", s, [0, 1, 2, 3], i) for k, (s, i) in enumerate([("ACGN", {2: "T"}), ("AC-T", {}), ("CA-T", {0: "G"})])]
    table = scoring.table(spark, scoring.flat())
    pos = {r.pos: r for r in pileup.positions(alns(spark, rows), table).collect()}
    for r in pos.values():
        assert r.cov == 3 and r.na + r.nc + r.ng + r.nt + r.gaps <= 3
    called = {r.pos: r for r in pileup.call(pileup.positions(alns(spark, rows), table)).collect()}
    assert [called[k].cons for k in range(4)] == ["A", "C", "-", "T"]
    ins = {(r.pos, r.ins_idx): r for r in pileup.insertions(alns(spark, rows), table).collect()}
    assert ins[(2, 0)].cov == 3 and ins[(2, 0)].gaps == 2 and ins[(2, 0)].nt == 1
    assert pileup.assembly_string(alns(spark, rows), table, assemble.reference_rows(spark, "ACGT")) == "ACT"
    tie = alns(spark, [(0, "a", "", 1, 1, 0, 0, False, False, False, "a", "A", [0], {}), (1, "b", "", 1, 1, 0, 0, False, False, False, "a", "T", [0], {})])
    assert pileup.call(pileup.positions(tie, table)).first()["cons"] == "N"
    assert pileup.call(pileup.positions(tie, table), 1, Settings(min_cons_score=-9999)).first()["cons"] == "T"


def test_leader_clusters_equal_a_fold(spark):
    import random

    rng = random.Random(4)
    rows = [(k, bool(rng.randrange(2)), s, s + rng.randrange(20, 24), rng.randrange(9), 0, bool(rng.randrange(2))) for k in range(120) for s in [rng.randrange(60)]]
    kinds = "ord bigint, rc boolean, as int, ae int, score int, qual_sum int, trimmed boolean"
    df = spark.createDataFrame(rows, kinds)
    for tolerance, outer in itertools.product((0, 1, 3), (True, False)):
        got = {r.ord: r.unique_best for r in dedup.flag_unique(df, tolerance=tolerance, outer_only=outer).collect()}
        ordered = sorted(rows, key=lambda r: (not r[1], -r[3] if r[1] else r[2], r[2] if r[1] else -r[3], -r[4], r[0]))
        lead, want = None, {}
        for ord_, rc, a, e, _, _, trimmed in ordered:
            if lead and lead[0] == rc and abs(lead[1] - a) <= tolerance and abs(lead[2] - e) <= tolerance:
                want[ord_] = False
            else:
                same = bool(lead) and lead[0] == rc and (lead[2] == e if rc else lead[1] == a)
                want[ord_] = outer or not same or trimmed
                lead = (rc, a, e)
        assert got == want


@pytest.mark.parametrize("k", [1, 3, 8, 11])
def test_seed_table_equals_the_join(spark, monkeypatch, k):
    """The same hits by direct addresses, in pieces, and by the join; letters of either case, unknown ones, nulls and short reads."""
    import random

    rng = random.Random(k)
    text = lambda n, of="ACGT": "".join(rng.choice(of) for _ in range(n))
    ref = text(300) + "ACGT" * 20
    parts = [ref[a : a + 40] for a in range(0, 340, 17)] + [text(60, "ACGTacgtN-") for _ in range(20)] + ["", "A", "acgtACGTnacgtacgtacgt", "N" * 30, None]
    reads = spark.createDataFrame([(i, p, i % 3 == 0, 12, "x") for i, p in enumerate(parts)], "ord bigint, seq string, trimmed boolean, trim_point int, note string")
    index = seeds.reference_index(spark, ref, k, most=5)
    for source in (reads, reads.drop("trimmed", "trim_point")):
        monkeypatch.setattr(seeds, "TABLE_ROWS", 0)
        want, kept = sorted(tuple(r) for r in seeds.hits(source, index, k).collect()), sorted(r.ord for r in seeds.seeded(source, index, k).collect())
        monkeypatch.setattr(seeds, "TABLE_ROWS", 10**6)
        assert seeds.seed_table(index, k) is not None and seeds.seed_table(index, 15) is None
        for letters, some in ((1 << 20, 1 << 18), (50, 3)):
            monkeypatch.setattr(seeds, "_LETTERS", letters)
            monkeypatch.setattr(seeds, "_HITS", some)
            assert sorted(tuple(r) for r in seeds.hits(source, index, k).collect()) == want
            got = seeds.seeded(source, index, k)
            assert sorted(r.ord for r in got.collect()) == kept and got.schema == source.schema
    assert len(want) > 20 and seeds.hits(reads, index.limit(0), k).count() == 0 == seeds.seeded(reads.limit(0), index, k).count()


def test_sums_and_texts_over_blocks(spark, monkeypatch):
    """Blocks of a few positions, keys with nulls, gaps between positions, empty tables."""
    import random

    from strandspark.operators import ordered

    monkeypatch.setattr(ordered, "BLOCK", 7)
    rng = random.Random(6)
    rows = [(k, p, rng.choice([None, 1, -2, 5])) for k in (True, False, None) for p in rng.sample(range(-30, 200), 60)]
    df = spark.createDataFrame(rows, "key boolean, pos int, d int")
    for inclusive in (True, False):
        got = {(r.key, r.pos): r.total for r in ordered.running_sums(df, "pos", {"total": F.col("d")}, ("key",), inclusive).collect()}
        assert got == {(k, p): sum(d or 0 for q, o, d in rows if q == k and (o < p or (inclusive and o == p))) for k, p, _ in rows}
    one = df.filter("key")
    assert {r.pos: r.total for r in ordered.running_sums(one, "pos", {"total": F.lit(1)}, inclusive=False).collect()} == {p: n for n, p in enumerate(sorted(p for k, p, _ in rows if k))}
    text = spark.createDataFrame([(p, q, chr(97 + (p * 3 + q) % 26), "x") for p in range(40) for q in range(3)], "pos int, place int, a string, b string").repartition(5)
    assert ordered.texts(text, one="a", two="b").first()[:] == ("".join(chr(97 + (p * 3 + q) % 26) for p in range(40) for q in range(3)), "x" * 120)
    assert ordered.texts(text.limit(0), one="a").first()["one"] == "" and ordered.running_sums(one.limit(0), "pos", {"t": F.col("d")}).count() == 0


def test_ranges_of_a_leader_scan_compose():
    """Ranges scanned for every leader that may come in, put together, equal one scan."""
    import random

    rng = random.Random(9)
    for trial in range(300):
        tolerance, outer, places = rng.choice([0, 1, 2, 5]), rng.random() < 0.5, rng.choice([3, 20, 60])
        rows = [(rng.random() < 0.4, s, s + rng.randrange(20, 20 + rng.choice([1, 4, 12])), rng.random() < 0.3, k) for k in range(rng.randrange(1, 80)) for s in [rng.randrange(places)]]
        rows.sort(key=lambda r: (not r[0], -r[2] if r[0] else r[1], r[1] if r[0] else -r[2], r[4]))
        borders = sorted(rng.sample(range(len(rows) + 1), min(len(rows) + 1, rng.randrange(6))))
        leader = None
        for part in (rows[a:b] for a, b in zip([0, *borders], [*borders, len(rows)], strict=True)):
            got = leaders.outcomes(iter(part), tolerance, outer)
            want = leader
            for row in part:
                want, _ = leaders.advance(want, row, tolerance, outer)
            leader = leaders.compose(leader, *got, tolerance) if got else leader
            assert leader == want


def test_leader_scan_deals_evenly(spark, tmp_path):
    """Dense 5' ends leave no gap to part them; no task gets more than its share, and the flags equal one fold."""
    n = 12000
    df = spark.range(n).selectExpr("id AS ord", "id % 3 = 0 AS rc", "cast(pmod(xxhash64(id), 400) AS int) AS `as`", "cast(pmod(xxhash64(id), 400) + 30 + pmod(xxhash64(id, 1), 9) AS int) AS ae", "cast(id % 50 AS int) AS score", "0 AS qual_sum", "id % 5 = 0 AS trimmed", "'x' AS other")
    # A third of all rows lie at one place.
    df = df.selectExpr("ord", "rc", "IF(ord % 3 = 1, 7, `as`) AS `as`", "IF(ord % 3 = 1, 40, ae) AS ae", "score", "qual_sum", "trimmed", "other")
    done = dedup.flag_unique(df, tolerance=2, outer_only=False, path=str(tmp_path / "ranges"))
    assert done.columns == [*df.columns, "unique_best", "cluster"]
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "ranges")).groupBy("__range").count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    rows = sorted(df.collect(), key=lambda r: (not r.rc, -r.ae if r.rc else r["as"], r["as"] if r.rc else -r.ae, -r.score, r.ord))
    leader, want = None, {}
    for r in rows:
        leader, unique = leaders.advance(leader, (r.rc, r["as"], r.ae, r.trimmed, r.ord), 2, False)
        want[r.ord] = (unique, leader[3])
    assert {r.ord: (r.unique_best, r.cluster) for r in done.collect()} == want


def test_cutoff_line_and_no_spread(spark):
    df = spark.createDataFrame([(10 * k, 2000 + 200 * k, True) for k in range(1, 9)], "len int, score int, unique_best boolean")
    line = cutoff.fitted_line(df).first()
    assert line.slope == pytest.approx(16.0, rel=0.3) or line.slope > 0
    same = spark.createDataFrame([(50, 2500, True), (50, 3000, True)], "len int, score int, unique_best boolean")
    assert {r.dropped for r in cutoff.cull(same).collect()} == {False}
    assert [r.dropped for r in cutoff.cull(same, Settings(hard_cut=2600)).orderBy("score").collect()] == [True, False]


def test_class_fold_is_order_free(spark):
    def fold(events):
        state = "unknown"
        for e in events:
            if e == "X":
                state = "nonsense"
            elif state == "unknown":
                state = {"C": "clean", "D": "dirt", "B": state}[e]
            elif (state, e) in (("clean", "D"), ("dirt", "C")):
                state = "conflict"
        return state

    rows = [(f"{n}-{i}", e) for n in range(1, 5) for i, seq in enumerate(itertools.product("CDBX", repeat=n)) for e in seq]
    want = {f"{n}-{i}": fold(seq) for n in range(1, 5) for i, seq in enumerate(itertools.product("CDBX", repeat=n))}
    df = spark.createDataFrame(rows, "id string, e string").select("id", F.lit(3).alias("strength"), F.col("e").isin("C", "B").alias("clean"), F.col("e").isin("D", "B").alias("dirt"))
    got = {r.id: r.klass for r in contam.classify(df).collect()}
    for name, klass in got.items():
        assert klass == want[name]


def test_interval_of_a_share(spark):
    r = spark.range(1).select(contam.wilson(F.lit(5), F.lit(50)).alias("w")).first()["w"]
    assert (round(r.estimate, 3), round(r.low, 2), round(r.high, 2)) == (10.0, 4.35, 21.36)
    assert spark.range(1).select(contam.wilson(F.lit(0), F.lit(0)).alias("w")).first()["w"] is None


def test_majority_of_a_column(spark):
    cols = [("AAAAG", 60, "A"), ("AAG", 100, "R"), ("A---", 100, "a"), ("----", 100, "-"), ("NN", 100, "N"), ("ACGT", 100, "N")]
    rows = [(k, b) for k, (bases, _, _) in enumerate(cols) for b in bases]
    for per_cent in (60, 100):
        got = {r.pos: r.symbol for r in pileup.majority(spark.createDataFrame(rows, "pos int, base string"), per_cent).collect()}
        for k, (_, p, want) in enumerate(cols):
            if p == per_cent:
                assert got[k] == want


def test_seed_windows_and_soft_mask(spark):
    ref = "ACGTACCATTGCAGGCTTAACCGGATATCCGAT"
    reads = spark.createDataFrame([(0, ref[10:24]), (1, "TTTTTTTTTTTT"), (2, "ACG")], "ord bigint, seq string")
    index = seeds.reference_index(spark, ref, 8)
    assert {r.ord for r in seeds.seeded(reads, index, 8).collect()} == {0}
    span = seeds.windows(seeds.hits(reads, index, 8), len(ref)).filter("strand = 'f'").first().spans[0]
    assert (span.lo, span.hi) == (0, 32)
    masked = seeds.reference_index(spark, ref[:8] + ref[8:28].lower() + ref[28:], 8, soft_mask=True)
    assert seeds.seeded(reads, masked, 8).count() == 0
