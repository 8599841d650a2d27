"""One synthetic read for each case of interest, over a circular reference of 120 bases with a soft-masked stretch."""

import random

import pytest
from pyspark.sql import functions as F

from strandspark.config import ADAPTERS, Settings
from strandspark.functions import scoring
from strandspark.operators import kernel
from strandspark.operators.align import flip
from strandspark.plans import assemble
from strandspark.sources import readers

READS = "ord bigint, id string, desc string, seq string, qual string, qual_sum int"
TAIL = ADAPTERS["n"][:30]


def cases(seed):
    rng = random.Random(seed)
    ref = "".join(rng.choice("ACGT") for _ in range(120))
    round_ = ref * 3
    other = {"A": "C", "C": "A", "G": "T", "T": "G"}
    reads = {
        "cross": round_[90:157], "cross_again": round_[90:157], "cross_worse": round_[90:120] + round_[121:157],
        "full": ref[69:116] + TAIL, "short_plain": ref[69:114], "short_cut": ref[69:112] + TAIL,
        "back": flip(ref[6:63]) + TAIL, "back_plain": flip(ref[9:63]), "back_cut": flip(ref[7:63]) + TAIL,
        "masked": ref[41:55] + other[ref[55]] + ref[56:70], "stranger": "".join(rng.choice("ACGT") for _ in range(33)), "tiny": ref[10:13], "long_way": round_[30:158],
    }
    return ref, reads


def plain(reads):
    """Reads that end like an adapter begins are trimmed by chance; here none may be, and each tail is found."""
    for name, seq in reads.items():
        want = len(seq) - len(TAIL) - 1 if seq.endswith(TAIL) else None
        if kernel.trim_point(seq, ADAPTERS["n"], scoring.flat()) != want:
            return False
    return True


REF, SEQS = next(c for c in map(cases, range(1000)) if plain(c[1]))


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame([(k, name, "", seq, None, None) for k, (name, seq) in enumerate(SEQS.items())], READS)


def placed(spark, reads, **options):
    done = assemble.assemble(spark, reads, REF, settings=Settings(circular=True, iterate=False, hard_cut=1, **options))
    return {r.id: r for r in done.alns.collect()}


def test_reads_over_the_origin_are_split(spark, reads):
    got = placed(spark, reads)
    assert {"cross_f", "cross_b", "long_way_f", "long_way_b"} <= set(got) and not {"cross", "stranger", "tiny"} & set(got)
    assert (got["cross_f"].start, got["cross_f"].end, got["cross_b"].start, got["cross_b"].end) == (90, 119, 0, 36)
    # Longer than the reference: it goes round and over its own beginning.
    assert (got["long_way_f"].start, got["long_way_f"].end, got["long_way_b"].start, got["long_way_b"].end) == (30, 119, 0, 37)
    assert got["cross_f"].score == 200 * 67 and got["long_way_f"].score == 200 * 128
    assert got["back_plain"].rc and not got["short_plain"].rc and (got["back_plain"].start, got["back_plain"].end) == (9, 62)


def test_duplicates_by_score(spark, reads):
    got = placed(spark, reads, dedup="score")
    assert len({"cross_f", "cross_again_f"} & set(got)) == 1 and "cross_worse_f" not in got


def test_duplicates_that_know_adapters(spark, reads):
    """On either strand a shorter read with the same 5' end is redundant, unless its adapter shows that it ends there."""
    got = placed(spark, reads, dedup="score", adapter_aware=True, trim=True)
    assert {"full", "short_cut", "back", "back_cut"} <= set(got) and not {"short_plain", "back_plain"} & set(got)
    assert got["full"].trimmed and got["back_cut"].trimmed and (got["short_cut"].start, got["short_cut"].end) == (69, 111) and (got["back_cut"].start, got["back_cut"].end) == (7, 62)
    plain_ends = placed(spark, reads, dedup="score", trim=True)
    assert {"short_plain", "back_plain"} <= set(plain_ends)


def test_soft_masked_start_gives_no_seed(spark, reads):
    masked = REF[:41] + REF[41:74].lower() + REF[74:]
    for soft_mask, there in ((False, True), (True, False)):
        settings = Settings(circular=True, kmer=9, soft_mask=soft_mask)
        ids = {r.id for r in assemble.seeded_reads(spark, reads, masked, settings).select("id").collect()}
        assert ("masked" in ids) == there and "cross" in ids and "tiny" not in ids


def test_long_reads_are_cut(spark, tmp_path):
    spark.createDataFrame([(">long\n" + REF * 6,)], "value string").write.text(str(tmp_path / "long"))
    row = readers.fasta(spark, str(tmp_path / "long")).select("seq_len", F.col("seq")).first()
    assert row.seq_len == 256 and row.seq == (REF * 3)[:256]
