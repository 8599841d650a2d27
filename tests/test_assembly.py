"""Whole runs: a changed reference is brought back, duplicates and strangers go."""

import random

import pytest
from pyspark.sql import functions as F

from strandspark.config import ADAPTERS, Settings
from strandspark.operators.align import flip
from strandspark.plans import assemble, contamination, report

READS = "ord bigint, id string, desc string, seq string, qual string, qual_sum int"


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(8)
    truth = "".join(rng.choice("ACGT") for _ in range(400))
    ref = list(truth)
    for p in rng.sample(range(30, 370), 6):
        ref[p] = {"A": "C", "C": "A", "G": "T", "T": "G"}[ref[p]]
    ref = "".join(ref)
    ref = ref[:200] + ref[202:]
    reads = []
    for k, s in enumerate(range(0, 400, 4)):
        piece = (truth + truth)[s : s + 70]
        reads.append((k, f"r{k}", "", flip(piece) if k % 2 else piece, "I" * 70, 70 * 40))
    reads.append((900, "dup", "", reads[10][3], "I" * 70, 70 * 40))
    reads.append((901, "stranger", "", "".join(rng.choice("ACGT") for _ in range(60)), None, None))
    reads.append((902, "short", "", "ACG", None, None))
    reads.append((903, "adapter", "", truth[100:150] + ADAPTERS["n"][:30], None, None))
    return truth, ref, spark.createDataFrame(reads, READS)


def test_iteration_recovers_the_truth(spark, case):
    truth, ref, reads = case
    done = assemble.assemble(spark, reads, ref, settings=Settings(circular=True, kmer=9, dedup="score", trim=True, hard_cut=2000))
    assert done.consensus == truth and done.rounds >= 2
    ids = {r.id for r in done.alns.select("id").collect()}
    assert "stranger" not in ids and "short" not in ids and "adapter" in ids
    assert len({"r10", "dup"} & ids) == 1
    assert any(i.endswith("_f") for i in ids) and any(i.endswith("_b") for i in ids)
    called = report.called(done)
    text = report.fasta(called).first()["value"]
    assert "".join(text.split("\n")[1:]) == done.consensus
    assert report.statistics(done).first()["fragments"] == done.alns.filter("segment <> 'b'").count()
    assert report.region(done, 50, 60).filter("name = 'Consensus'").first()["text"] == done.reference[49:60]
    ace = "\n".join(r["value"] for r in report.ace(done).collect())
    assert ace.startswith(f"AS 1 {done.alns.count() + 1}\n") and ace.count("\nRD ") == done.alns.count() + 1
    assert report.line(called).first()["consensus"] == done.reference
    assert report.details(called, differing_only=False).count() == len(done.reference)


@pytest.mark.parametrize("circular,distant,gaps", [(True, False, True), (False, False, False), (True, True, False)])
def test_rounds_that_align_what_may_move_equal_full_rounds(spark, circular, distant, gaps):
    """Same states in every round; fewer reads are aligned from round to round. Changes, gaps and insertions move the consensus."""
    rng = random.Random(21)
    truth = "".join(rng.choice("ACGT") for _ in range(1500))
    ref = list(truth)
    for p in rng.sample(range(100, 500), 12):
        ref[p] = {"A": "C", "C": "A", "G": "T", "T": "G"}[ref[p]]
    if gaps:
        ref[1200:1202] = ref[300:302] = []
        ref[700:724] = []
    reads = []
    for k, s in enumerate(range(0, 1440 if not circular else 1500, 4)):
        piece = (truth + truth)[s : s + rng.choice([40, 60])]
        piece = "".join(c if rng.random() < 0.97 else rng.choice("ACGTN") for c in piece)
        reads.append((k, f"r{k}", "", flip(piece) if k % 2 else piece, None, None))
    df = spark.createDataFrame(reads, READS)
    states = {}
    for delta in (True, False):
        settings = Settings(circular=circular, distant=distant, dedup="score", tolerance=1, hard_cut=1000, delta=delta)
        seen = []
        done = assemble.assemble(spark, df, "".join(ref), settings=settings, each=lambda a: seen.append((a.consensus, sorted(map(str, a.alns.collect())))))
        states[delta] = (done, seen)
    (fast, one), (full, two) = states[True], states[False]
    assert one == two and fast.rounds == full.rounds >= 2, (fast.aligned, full.aligned)
    assert full.aligned == [full.aligned[0]] * full.rounds and fast.aligned[0] == full.aligned[0]
    assert sorted(fast.aligned, reverse=True) == fast.aligned and fast.aligned[-1] < (1 if gaps else 0.6) * fast.aligned[0], fast.aligned


def test_collapse_merges_inputs(spark, case):
    truth, ref, _ = case
    rows = [(k, f"c{k}", "", truth[20:90], "I" * 70, 2800 - k) for k in range(4)] + [(10, "other", "", truth[120:190], "I" * 70, 2800)]
    done = assemble.assemble(spark, spark.createDataFrame(rows, READS), truth, settings=Settings(dedup="quality", collapse=True, hard_cut=1000, iterate=False))
    got = {r.id: r.num_inputs for r in done.alns.collect()}
    assert got == {"c0": 4, "other": 1}


def test_contamination_is_found(spark, case):
    truth, _, _ = case
    rng = random.Random(3)
    other = list(truth)
    for p in rng.sample(range(400), 60):
        other[p] = {"A": "C", "C": "A", "G": "T", "T": "G"}[other[p]]
    other = "".join(other)
    rows = [(k, f"s{k}", "", truth[s : s + 60], None, None) for k, s in enumerate(range(0, 340, 5))]
    rows += [(500 + k, f"d{k}", "", other[s : s + 60], None, None) for k, s in enumerate(range(0, 340, 20))]
    done = assemble.assemble(spark, spark.createDataFrame(rows, READS), truth, settings=Settings(iterate=False, distant=True, hard_cut=1))
    checked = contamination.check(spark, done.alns, done.reference, other, limit=100)
    by = {r.name: r.klass for r in checked.reads.collect()}
    assert {v for k, v in by.items() if k.startswith("s")} <= {"clean", "unknown"}
    assert {v for k, v in by.items() if k.startswith("d")} <= {"dirt", "unknown"}
    row = checked.strong.first()
    assert row.low < row.estimate < row.high and row.polluting == sum(v == "dirt" for v in by.values())
    with pytest.raises(ValueError, match="strong"):
        contamination.check(spark, done.alns, done.reference, truth, limit=100)


def test_stream_places_batches(spark, case, tmp_path):
    from strandspark.streaming.stream import place_stream

    truth, ref, reads = case
    reads.filter("ord < 20").select(*[F.col(c) for c in reads.columns]).write.parquet(str(tmp_path / "in"))
    q = place_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), ref, checkpoint=str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("ord").distinct().count() >= 18
