"""The kernel's queries do the whole job: all texts, the whole reference, whole items."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark import fixtures as X
from strandspark.config import Settings
from strandspark.functions import scoring
from strandspark.functions import seq as S
from strandspark.operators import align, kernel
from strandspark.plans import assemble
from strandspark.oracles import ORACLES
from strandspark.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def whole_fill(read, ref, matrix, open_, settings):
    """(score, cells) of one fill from the first open column of the strand to the last."""
    at = np.flatnonzero(open_)
    if not len(at):
        return None
    low, high = int(at[0]), int(at[-1]) + 1
    runs = (ref[low:high], [read]) if settings.homopolymer else (None, None)
    filled = kernel.fill(kernel.codes(ref[low:high]), kernel.codes(read)[None, :], matrix, settings, open_[None, low:high], True, *runs)
    score, col = kernel.best_ends(filled)
    placed = kernel.trace(filled, 0, len(read) - 1, int(col[0]))
    return int(score[0]), placed.rows.tolist(), (placed.cols + low).tolist()


@pytest.mark.parametrize("seed", range(8))
def test_parts_of_a_reference_score_as_the_whole(seed, monkeypatch):
    rng = random.Random(seed)
    settings = Settings(homopolymer=seed % 4 > 1)
    matrix = scoring.flat() if seed % 2 else X.matrix()
    ref = "".join(rng.choice("ACGT") * rng.choice([1, 1, 1, 2, 3, 7]) for _ in range(800))[:1500]
    texts, spans, masks = [], [], []
    for _ in range(14):
        at, size = rng.randrange(0, 1400), rng.choice([40, 60])
        text = [c if rng.random() < 0.9 else rng.choice(["A", "C", "G", "T", "N", "", c + c]) for c in ref[at : at + size]]
        texts.append("".join(text))
        opened = {}
        for strand in "fr":
            lows = [at - 5] * (rng.random() < 0.7) + [rng.randrange(0, 1400) for _ in range(rng.randrange(0, 6))]
            read = {"seeded": True, f"whole_{strand}": rng.random() < 0.2, f"spans_{strand}": [{"lo": max(lo, 0), "hi": lo + size + rng.choice([5, 20])} for lo in lows]}
            opened[strand] = align._open_spans(read, strand, len(ref))
        spans.append(opened)
        masks.append({s: np.asarray([any(a <= k < b for a, b in x) for k in range(len(ref))]) for s, x in opened.items()})
    refs = {"f": ref, "r": align.flip(ref)}
    letters = {s: kernel.letters_of([x])[0] for s, x in refs.items()}
    for tile in (align.TILE, 90, 7):
        monkeypatch.setattr(align, "TILE", tile)
        got = align._best(texts, spans, letters, matrix, settings)
        for text, mask, found in zip(texts, masks, got, strict=True):
            for strand in refs:
                want, have = whole_fill(text, refs[strand], matrix, mask[strand], settings), found[strand]
                assert (have and (have[0], have[1].rows.tolist(), (have[1].cols + have[2]).tolist())) == want


def test_a_batch_does_not_grow_with_the_reference():
    """Open stretches of many reads on millions of letters take what their own columns take."""
    import tracemalloc

    rng = np.random.default_rng(1)
    letters = np.frombuffer(b"ACGT", dtype=np.uint8)[rng.integers(0, 4, 4_000_000)]
    peaks = []
    for size in (40_000, 4_000_000):
        refs = {"f": letters[:size]}
        at = rng.integers(0, size - 100, 400)
        texts = [bytes(letters[k : k + 60]).decode() for k in at]
        reads = [{"seeded": True, "spans_f": [{"lo": int(k) - 10, "hi": int(k) + 70}, {"lo": size // 2, "hi": size // 2 + 80}]} for k in at]
        tracemalloc.start()
        best = align._best(texts, [{"f": align._open_spans(r, "f", size)} for r in reads], refs, scoring.flat(), Settings())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert all(b["f"][0] == 200 * 60 for b in best)
    assert peaks[1] < 1.2 * peaks[0]


@pytest.mark.parametrize("circular,homopolymer,seeded", [(False, False, True), (True, False, True), (False, True, True), (True, False, False)])
def test_tiles_of_a_reference_place_as_the_broadcast(spark, monkeypatch, circular, homopolymer, seeded):
    rng = random.Random(4)
    settings = Settings(circular=circular, homopolymer=homopolymer, kmer=8 if seeded else None, max_read=64, distant=not seeded, trim=circular)
    ref = "".join(rng.choice("ACGT") for _ in range(700))
    wrapped = ref + ref[:64]
    rows = []
    for k in range(40):
        at = rng.randrange(700)
        text = "".join(c if rng.random() < 0.95 else rng.choice("ACGTN") for c in wrapped[at : at + rng.choice([30, 50])])
        rows.append((k, f"r{k}", "", align.flip(text) if k % 2 else text, "I" * len(text) if k % 3 else None, None))
    rows.append((99, "empty", "", "", None, None))
    reads = spark.createDataFrame(rows, "ord bigint, id string, desc string, seq string, qual string, qual_sum int")
    source = assemble.seeded_reads(spark, reads, ref, settings) if seeded else reads
    want = sorted(map(str, align.first_pass(source, ref, scoring.flat(), settings).collect()))
    assert want == sorted(map(str, align.tiled_pass(source, ref, scoring.flat(), settings, tile=100).collect())) and len(want) >= 15
    monkeypatch.setattr(align, "MOST_REFERENCE", 100)
    assert want == sorted(map(str, align.first_pass(source, ref, scoring.flat(), settings).collect()))


def test_iteration_brings_back_the_whole_reference(spark, monkeypatch):
    given, run = {}, assemble.assemble

    def spy(spark, reads, reference, *args, **more):
        given["ords"] = {r.ord for r in reads.select("ord").collect()}
        given["length"] = len(reference)
        return run(spark, reads, reference, *args, **more)

    monkeypatch.setattr(assemble, "assemble", spy)
    done = QUERIES["i2_iterate"](spark, SMALL).first()
    truth = X.reference(spark, SMALL)
    assert given["length"] == len(truth) and done["consensus"] == truth
    assert {r.ord for r in X.reads(spark, SMALL).select("ord").collect()} <= given["ords"]


def test_alignment_places_reads_of_all_texts(spark):
    placed = QUERIES["j3_align"](spark, SMALL).toPandas()
    ref = X.reference(spark, SMALL)
    settings = Settings(kmer=12)
    seeded = assemble.seeded_reads(spark, X.reads(spark, SMALL), ref, settings)
    assert set(placed["ord"]) == {r.ord for r in seeded.select("ord").collect()}
    assert placed["end"].max() > 6000
    # A read that is a part of the reference has its full score there.
    inside = [r for r in X.reads(spark, SMALL).filter("len = 100").select("ord", "seq").collect() if r.seq in ref]
    score = dict(zip(placed["ord"], placed["score"], strict=True))
    assert inside and all(score[r.ord] == 20000 for r in inside)


def test_adapter_is_trimmed_from_all_reads_and_whole_items(spark):
    got = QUERIES["x12_adapter_trim"](spark, SMALL).toPandas().set_index("ord")
    reads = {r.ord: r.len for r in X.reads(spark, SMALL).select("ord", "len").collect()}
    items = {-1 - r.item_id: r.n for r in X.table(spark, SMALL, "benchmark").select("item_id", F.length(S.dna(F.col("text"))).alias("n")).collect()}
    assert got["expected"].to_dict() == reads | items and max(items.values()) > 60
    # A read whose end spells the adapter's begin is cut a little earlier; no adapter is missed.
    assert got["trim_point"].notna().all()
    near = (got["expected"] - 1 - got["trim_point"].astype(int)).abs()
    assert (near == 0).mean() > 0.9, near.value_counts().to_dict()
    assert (near[got.index < 0] == 0).all(), near[got.index < 0].value_counts().to_dict()


@pytest.mark.parametrize("name", ["a17_diagnostic_sites", "j7_diagnostic_join", "j8_half_merge", "f20_sequence_check", "x12_adapter_trim"])
def test_sql_reads_whole_tables(name):
    """No cut of positions, segments, line numbers, first words or first letters is left in the SQL."""
    for cut in (f"pos < {X.SPAN}", "segment = 'a'", "l_linenumber <= 2", "split_part", ", 60)"):
        assert cut not in ORACLES[name]


def test_every_word_is_checked_for_a_sequence(spark):
    words = [w for r in X.table(spark, SMALL, "documents").select("text").collect() for w in re.split("[ \\t\\n\\f\\r]+", r.text or "") if w]
    fit = sum(bool(re.fullmatch("[ACGTBDHVMKYRSWUNacgtbdhvmkyrswun]+", w)) for w in words)
    got = {r.ok: r.n for r in QUERIES["f20_sequence_check"](spark, SMALL).collect()}
    assert got == {True: fit, False: len(words) - fit} and fit and len(words) > 1000
