"""The alignment kernel against a plain loop over cells, and behaviour of placement."""

import random

import numpy as np
import pytest

from strandspark.config import ADAPTERS, Settings
from strandspark.functions import scoring
from strandspark.operators import align, diff, kernel

S = Settings()


def plain(ref, read, matrix, pay_5):
    """Scores cell by cell, each option tried over all its lengths."""
    n, m = len(read), len(ref)
    h = [[0] * m for _ in range(n)]
    for r in range(n):
        depth = kernel.row_depth(r, n)
        for c in range(m):
            s = int(matrix[depth][ref[c]][read[r]])
            begin = -(S.gap_open + S.gap_extend * (r + 1)) if pay_5 else 0
            if r == 0:
                h[r][c] = s
            elif c == 0:
                h[r][c] = s + (begin if pay_5 else 0)
            else:
                options = [h[r - 1][c - 1]]
                options += [h[r - 1][k] - S.gap_open - S.gap_extend * (c - k - 1) for k in range(c - 1)]
                options += [h[k][c - 1] - S.gap_open - S.gap_extend * (r - k - 1) for k in range(r - 1)]
                best = max(options)
                h[r][c] = begin if begin > best else s + best
    return np.asarray(h)


@pytest.mark.parametrize("pay_5", [True, False])
def test_scores_equal_a_plain_loop(pay_5):
    rng = random.Random(5)
    for case in range(25):
        matrix = scoring.flat() if case % 2 else np.asarray(np.random.default_rng(case).integers(-700, 300, (31, 5, 5)))
        ref = np.asarray([rng.randrange(5) for _ in range(rng.randrange(3, 40))])
        reads = np.asarray([[rng.randrange(5) for _ in range(rng.choice([9]) + case)] for _ in range(3)])
        got = kernel.fill(ref, reads, matrix, S, None, pay_5)
        for b in range(3):
            assert (got.scores[:, b] == plain(ref, reads[b], matrix, pay_5)).all()


def test_exact_piece_scores_by_length_and_is_placed():
    rng = random.Random(2)
    ref = "".join(rng.choice("ACGT") for _ in range(200))
    read = ref[60:110]
    filled = kernel.fill(kernel.codes(ref), kernel.codes(read)[None], scoring.flat(), S)
    score, col = kernel.best_ends(filled)
    assert score[0] == 200 * 50
    first, last, seq, ins = kernel.place(read, kernel.trace(filled, 0, 49, int(col[0])))
    assert (first, last, seq, ins) == (60, 109, read, {})


def test_insertion_and_deletion_are_placed():
    rng = random.Random(3)
    ref = "".join(rng.choice("ACGT") for _ in range(160))
    longer = ref[20:60] + "GG" + ref[60:100]
    filled = kernel.fill(kernel.codes(ref), kernel.codes(longer)[None], scoring.flat(), S)
    col = int(kernel.best_ends(filled)[1][0])
    first, last, seq, ins = kernel.place(longer, kernel.trace(filled, 0, len(longer) - 1, col))
    assert (first, last) == (20, 99) and sum(map(len, ins.values())) == 2
    assert seq.count("-") == 0
    shorter = ref[20:60] + ref[63:100]
    filled = kernel.fill(kernel.codes(ref), kernel.codes(shorter)[None], scoring.flat(), S)
    col = int(kernel.best_ends(filled)[1][0])
    first, last, seq, ins = kernel.place(shorter, kernel.trace(filled, 0, len(shorter) - 1, col))
    assert (first, last, seq.count("-"), ins) == (20, 99, 3, {})


def test_mask_keeps_an_alignment_in_its_window():
    ref = "ACGTTGCA" * 5
    read = "ACGTTGCA"
    mask = np.zeros((1, len(ref)), dtype=bool)
    mask[0, 14:30] = True
    filled = kernel.fill(kernel.codes(ref), kernel.codes(read)[None], scoring.flat(), S, mask)
    score, col = kernel.best_ends(filled)
    assert score[0] == 1600 and col[0] == 23


def test_homopolymer_gap_costs_less():
    ref, read = "CAGTCCATAAAAAAGCTTGACC", "CAGTCCATAAAAGCTTGACC"
    codes = kernel.codes(ref), kernel.codes(read)[None]
    plain_score = kernel.best_ends(kernel.fill(*codes, scoring.flat(), S))[0][0]
    cheap = kernel.best_ends(kernel.fill(*codes, scoring.flat(), S, None, True, ref, [read]))[0][0]
    assert cheap > plain_score


def test_mirror_and_split():
    ref = "AACCGGTTACGTACGTTGCATGCA"
    start, end, seq, ins = kernel.mirror(2, 6, "ACG-T", {4: "GG"}, len(ref), align.flip)
    assert (start, end, seq) == (17, 21, "A-CGT") and ins == {20: "CC"}
    parts = kernel.split_at(20, 27, "ACGTACGT", {25: "T"}, 24)
    assert [(p[0], p[1], p[2], p[3], p[4]) for p in parts] == [("f", 20, 23, "ACGT", {}), ("b", 0, 3, "ACGT", {1: "T"})]


def test_classes_count_inserted_bases():
    assert kernel.classes("AC-GT", {3: "TT"}, 1) == [0, 1, 4, 4, 5][:2] + kernel.classes("AC-GT", {3: "TT"}, 1)[2:]
    long = kernel.classes("A" * 60, {}, 0)
    assert long[:16] == list(range(16)) and long[30] == 15 and long[-1] == 30 and long[-15] == 16


@pytest.mark.parametrize("cut", [0, 1, 25, 57])
def test_adapter_is_trimmed(cut):
    rng = random.Random(9)
    read = "".join(rng.choice("ACGT") for _ in range(cut)) + ADAPTERS["n"][:30]
    assert kernel.trim_point(read, ADAPTERS["n"], scoring.flat()) == cut - 1


def test_no_adapter_no_trim():
    assert kernel.trim_point("ACCTTACCATTCCATACCAT", "GGGGGGGGGGGGGGGG", scoring.flat()) is None


def test_reverse_matrix_twice_is_itself():
    m = np.asarray(np.random.default_rng(1).integers(-700, 300, (31, 5, 5)))
    assert (scoring.reverse(scoring.reverse(m)) == m).all()


def test_matrix_file_is_parsed_and_checked():
    names = [str(k) for k in range(1, 16)] + ["MIDDLE"] + [str(-k) for k in range(15, 0, -1)]
    text = "".join(f"# Matrix for position: {n}\n" + "".join("\t".join(str(100 * i + 10 * r + c) for c in range(4)) + "\t\n" for r in range(4)) + "\n" for i, n in enumerate(names))
    m = scoring.parse(text)
    assert m[3][1][2] == 312 and m[30][3][3] == 3033 and m[0][4][0] == -10 and m[0][0][4] == -100
    with pytest.raises(ValueError):
        scoring.parse(text.replace("MIDDLE", "16"))


def test_pairs_go_through_the_wavefront_together(monkeypatch):
    """Pairs of very different sizes and distances, each as if alone and as the plain table of distances says."""
    rng = random.Random(12)
    pairs, limits = [], []
    for _ in range(40):
        a = "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 8, 90, 300])))
        b = "".join(rng.choice(["", c, c, c, c, c, "T", c + "A"]) for c in a)
        pairs.append((a, b))
        limits.append(rng.choice([None, 3, 20, len(a) + len(b) + 1]))
    monkeypatch.setattr(diff, "PAIRS", 7)
    monkeypatch.setattr(diff, "_CELLS", 5)
    got = diff.align_pairs(pairs, limits)
    for (a, b), limit, found in zip(pairs, limits, got, strict=True):
        assert found == diff.align_pair(a, b, limit)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y and "N" not in x + y), row[j + 1] + 1, new[-1] + 1))
            row = new
        limit = max(len(a), len(b)) // 10 if limit is None else limit
        assert (found[0] if found else None) == (row[-1] if row[-1] < limit else None)
        if found:
            assert found[1].replace("-", "") == a and found[2].replace("-", "") == b and len(found[1]) == len(found[2])


def test_matrix_file_is_found(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "old.txt").write_text("x")
    folders = [str(tmp_path / "a"), str(tmp_path / "missing"), str(tmp_path / "b")]
    assert scoring.find("old.txt", folders) == str(tmp_path / "b" / "old.txt")
    assert scoring.find("some/where.txt", folders) == "some/where.txt"
    with pytest.raises(FileNotFoundError, match="old.txt"):
        scoring.find("new.txt", folders)


def test_pair_alignment_is_minimal():
    rng = random.Random(11)
    for _ in range(20):
        a = "".join(rng.choice("ACGT") for _ in range(60))
        b = list(a)
        for _ in range(4):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], [b[k], "A"], ["T"]])
        b = "".join(b)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        d, left, right = diff.align_pair(a, b, 40)
        assert d == row[-1]
        assert left.replace("-", "") == a and right.replace("-", "") == b and len(left) == len(right)
        assert sum(p != q for p, q in zip(left, right, strict=True)) == d
    assert diff.align_pair("RRRR", "AGAG", 3)[0] == 0
    assert diff.align_pairs([]) == [] and diff.align_pairs([("", ""), ("A", ""), ("", "CG")], [1, 2, 2]) == [(0, "", ""), (1, "A", "-"), None]
    assert diff.align_pair("AAAAAAAA", "TTTTTTTT", 3) is None
