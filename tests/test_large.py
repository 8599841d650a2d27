"""Work that grows with the input: long texts and many reads in bounded time, rows, memory and disk."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandspark import fixtures as X
from strandspark.config import ADAPTERS, Settings
from strandspark.functions import scoring
from strandspark.operators import align, kernel, pileup
from strandspark.plans import assemble, report
from strandspark.queries import QUERIES
from strandspark.sources import readers


def test_pairs_of_symbols_in_a_long_text(spark, tmp_path):
    """The time of a text grows with its length, not with its square; null and empty texts have no pairs."""
    text = "Ab1-cÄ,zN\n" * 40_000
    rows = [(0, text), (1, None), (2, ""), (3, "7"), (4, "g"), (5, "C t")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    got = {(r.a, r.b): r.n for r in QUERIES["f12_f16_symbols"](spark, str(tmp_path)).collect()}
    assert time.time() - began < 20
    plain = "".join("-" if c in "EFIJLOPQUXZ" else c for c in text.upper() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    assert got == Counter(zip(plain, plain[1:])) + Counter([("C", "T")])


def test_ace_pads_reads_after_they_are_in_order(spark):
    """No letter becomes a row; reads over the end of the reference, without letters or with gaps are as before."""
    rng = random.Random(5)
    ref = "".join(rng.choice("ACGT") for _ in range(60))
    rows = []
    for k in range(40):
        start, seq = rng.randrange(0, 62), "".join(rng.choice("ACGT-N") for _ in range(rng.randrange(0, 12)))
        ins = {p: "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 4))) for p in range(start, start + len(seq)) if rng.random() < 0.2}
        rows.append((k, f"r{k}", 100, 1, start, start + len(seq) - 1, k % 3 == 0, False, False, "a", seq, [15] * len(seq), ins))
    kinds = "ord bigint, id string, score int, num_inputs int, start int, end int, rc boolean, trimmed boolean, dropped boolean, segment string, seq string, smp array<int>, ins map<int,string>"
    df = report.ace(assemble.Assembly("x", ref, spark.createDataFrame(rows, kinds).repartition(3), scoring.flat(), scoring.reverse(scoring.flat())))
    gap = [max((len(r[-1].get(p, "")) for r in rows), default=0) for p in range(60)]
    want = {}
    for r in sorted((r for r in rows if r[10] and r[4] < 60), key=lambda r: (r[4], r[5], r[0])):
        room = lambda p: gap[p] if p < 60 else 0
        text = "".join(r[-1].get(r[4] + j, "")[: room(r[4] + j)].ljust(room(r[4] + j), "*") + c.replace("-", "*") for j, c in enumerate(r[10]))
        want[r[1]] = (f"AF {r[1]} {'C' if r[6] else 'U'} {r[4] + sum(gap[: r[4]]) + 1}", f"RD {r[1]} {len(text)} 0 0\n" + "\n".join(text[k : k + 50] for k in range(0, len(text), 50)) + "\n")
    got = [r.value for r in df.collect()]
    assert got[1 : 1 + len(want)] == [a for a, _ in want.values()]
    assert [v.split("\n\nQA")[0] + "\n" for v in got[2 + len(want) : -1]] == [b for _, b in want.values()]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "piece" not in plan and "padded" not in plan[plan.index("Sort [") :]


KINDS = "ord bigint, id string, score int, num_inputs int, start int, end int, rc boolean, trimmed boolean, dropped boolean, segment string, seq string, smp array<int>, ins map<int,string>"


def _reads(spark, starts):
    return spark.createDataFrame([(k, f"r{k}", 100, 1, s, s + 3, k % 2 == 1, False, False, "a", "AC-T", [0, 1, 2, 3], {s + 1: "G"}) for k, s in enumerate(starts)], KINDS)


@pytest.mark.parametrize("style", [{"fasta_style": True}, {"colour": True}])
def test_a_region_reads_no_letter_of_reads_beyond_it(spark, style):
    far = F.when(F.col("start") > 40, F.raise_error(F.lit("a read beyond the region"))).otherwise(F.col("seq"))
    run = lambda alns: [tuple(r) for r in report.region(assemble.Assembly("x", "ACGT" * 20, alns, scoring.flat(), scoring.reverse(scoring.flat())), 5, 12, **style).collect()]
    alns = _reads(spark, [0, 1, 4, 9, 11, 50, 70])
    assert run(alns.withColumn("seq", far)) == run(_reads(spark, [0, 1, 4, 9, 11])) and len(run(alns)) == 2 + 4


def test_a_pileup_makes_no_row_of_a_letter(spark):
    """Reads of an unknown class, far apart or without letters are counted as by rows."""
    far = _reads(spark, [0, 2, 3, 2_000_000, 2_000_001]).unionByName(spark.createDataFrame([(9, "x", 1, 1, 7, 6, False, False, False, "a", "", [], {}), (10, "y", 1, 1, 2, 5, True, False, False, "a", "aNÄG", [0, 99], {})], KINDS))
    table = scoring.table(spark, X.matrix())
    got = pileup.positions(far, table)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = pileup.count_bases(pileup.bases(far), table, "pos").fillna(0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_fastq_records_lie_in_blocks_and_batches_of_any_size(spark, tmp_path):
    """Records that two blocks share come together; all others leave their task whole."""
    rng = random.Random(2)
    want = []
    for f in range(3):
        rows = [(f"r{f}.{k}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 30)))) for k in range(40)]
        want += rows
        (tmp_path / f"{f}.fq").write_text("".join(f"@{n} x\n{s}\n+\n{'@' * len(s)}\n" for n, s in rows) + "\n" * (f % 2))
    for size, batch in ((64, 3), (1 << 20, 7), (1 << 20, 10_000)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = sorted((r.id, r.seq) for r in readers.fastq(spark, str(tmp_path)).collect())
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == sorted(want)
    lines = pa.record_batch([pa.array([1, 1, 1, 1, 2, 2, 2], pa.int64()), pa.array([0, 1, 2, 3, 1, 2, 3], pa.int32()), pa.array(list("abcdefg"))], ["ord", "k", "value"])
    for cut in range(8):
        rows = [tuple(r.values()) for b in readers._four_lines(iter([lines.slice(0, cut), lines.slice(cut)])) for r in b.to_pylist()]
        assert rows == [(1, True, "a", "b", "c", "d"), (2, False, None, "e", None, None), (2, False, None, None, "f", None), (2, False, None, None, None, "g")]


@pytest.mark.parametrize("matrix", [scoring.flat(), X.matrix()])
def test_whole_adapters_at_the_end_need_no_fill(monkeypatch, matrix):
    rng = random.Random(3)
    adapter = ADAPTERS["n"]
    reads = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    reads = [r + adapter if k % 3 == 0 else r + adapter[: rng.randrange(len(adapter))] if k % 3 == 1 else r + adapter.replace("G", "T", 1) for k, r in enumerate(reads)]
    filled, fill = [], kernel.fill
    monkeypatch.setattr(kernel, "fill", lambda ref, *a, **b: filled.append(len(ref)) or fill(ref, *a, **b))
    got = kernel.trim_points(reads, adapter, matrix)
    assert sum(filled) <= (40 if matrix is not None and (matrix == scoring.flat()).all() else 60)
    want = []
    for r in reads:
        if not r:
            want.append(None)
            continue
        done = fill(kernel.codes(r), kernel.codes(adapter)[None, :], matrix)
        row = int(np.argmax(done.scores[:, 0, -1]))
        found = kernel.trace(done, 0, row, len(r) - 1)
        want.append(int(found.cols[0]) - 1 if found.score >= 1000 or found.score >= (row - found.rows[0] + 1) * 200 else None)
    assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_stretches_without_hope_change_no_place_above_the_threshold(seed, monkeypatch):
    """With and without them, reads at or above the first threshold come out alike; most of what chance opens is not filled."""
    rng = random.Random(seed)
    settings = Settings(first_score=[8000, 4000, 12_000][seed % 3])
    matrix = scoring.flat() if seed < 3 else X.matrix()
    ref = "".join(rng.choice("ACGT") for _ in range(4000))
    texts, spans = [], []
    for _ in range(80):
        at, size = rng.randrange(0, 3900), rng.choice([30, 70, 100])
        rate = rng.choice([0.0, 0.05, 0.1, 0.15])
        text = [c if rng.random() >= rate else rng.choice(["A", "C", "G", "T", "", c + c, c + "ACG"]) for c in ref[at : at + size]]
        text = "".join(text[: size // 2] + text[size // 2 + rng.choice([0, 0, 9]) :])
        texts.append(rng.choice([text, "".join(rng.choice("ACGT") for _ in range(size)), text + "N"]))
        lows = [at - 10, at + 30] * (rng.random() < 0.8) + [rng.randrange(0, 3900) for _ in range(10)]
        spans.append({"f": align._open_spans({"seeded": True, "spans_f": [{"lo": max(lo, 0), "hi": lo + size + 10} for lo in lows]}, "f", len(ref)), "r": []})
    refs = {"f": kernel.letters_of([ref])[0], "r": kernel.letters_of([align.flip(ref)])[0]}
    kept = align._hopeful(texts, spans, refs, matrix, settings)
    plain, fast = (align._best(texts, x, refs, matrix, settings) for x in (spans, kept))
    for a, b in zip(plain, fast, strict=True):
        a, b = a["f"], b["f"]
        if a and a[0] >= settings.first_score:
            assert b and (a[0], (a[1].cols + a[2]).tolist(), a[1].rows.tolist()) == (b[0], (b[1].cols + b[2]).tolist(), b[1].rows.tolist())
        else:
            assert b is None or b[0] < settings.first_score
    assert any(a["f"] and a["f"][0] >= settings.first_score for a in plain)
    if seed == 0:
        assert sum(len(x["f"]) for x in kept) < 0.3 * sum(len(x["f"]) for x in spans)
