"""Near duplicates, components, decontamination and run-length dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.llm import bytehash, components, decontam, neardup, rldedup
from strandspark.llm.common import shared_dir

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, n_shingles int, band string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)


def sets_of(text, width):
    w = WORD.findall((text or "").encode().translate(LOWER))
    if len(w) >= width:
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows, width, per_cent):
    s = {i: sets_of(t, width) for i, t in rows if i is not None}
    label = {i: i for i in s}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if s[a] and s[b]:
                n = len(s[a] & s[b])
                if 100 * n >= per_cent * (len(s[a]) + len(s[b]) - n):
                    x, y = top(a), top(b)
                    label[max(x, y)] = min(x, y)
    return {i: (len(s[i]), top(i)) for i in ids}


def family(rng, size, copies, edits):
    base = [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["Zz" + str(rng.randrange(9))], [w[k], "q"]])
        out.append(" ".join(w))
    return out


def test_components_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [None, "", "  \n", "one", "One", "one two", "one two", "a b c", "A\tb\nc", "a b d"]
    for size in (6, 9, 14, 25, 60, 150, 400):
        texts += family(rng, size, 14, max(2, size // 12))
    texts += family(rng, 30, 40, 9) + [texts[20]] * 5
    rows = list(enumerate(texts, start=3))
    rng.shuffle(rows)
    for width, per_cent in ((3, 85), (5, 80)):
        got = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, rows), width, per_cent).collect()}
        want = brute_components(rows, width, per_cent)
        assert len(got) == len(rows)
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.component_id == i) for i, r in got.items())
    kept = neardup.keep_one(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "n_shingles", "band"] and kept.count() == len({c for _, c in brute_components(rows, 5, 80).values()})


def test_null_ids_repeated_ids_and_no_rows(spark):
    d = docs(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "x y z"), (2, "x y z"), (None, None)])
    got = neardup.near_duplicates(d, 3, 85).collect()
    assert len(got) == 5 and all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert {r.component_id for r in got if r.doc_id is not None} == {1}
    assert neardup.near_duplicates(d.limit(0), 3, 85).count() == 0


def test_near_duplicates_of_very_long_texts(spark):
    """Texts of half a million words, one of them changed in places, one of one word only."""
    words = [f"w{k * 7919 % 1000003}" for k in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:200_000] + ["x", "y"] + words[200_003:])), (3, "same " * 400_000), (4, "same same same"), (5, "z" * 3_000_000)]
    names = ["n_shingles", "kept", "component_id", "f1", "bands"]
    df = spark.createDataFrame([(i, t, *names) for i, t in rows], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 3, 85).collect()}
    assert got[1] == (399_998, 1) and got[2][1] == 1 and got[3] == (1, 3) and got[4] == (1, 3) and got[5] == (1, 5)
    kept = neardup.keep_one(df, 3, 85)
    assert kept.columns == df.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {1, 3, 5}


def test_estimate_is_close(spark):
    rng = random.Random(1)
    a = {rng.getrandbits(64) for _ in range(4000)}
    b = set(list(a)[:3000]) | {rng.getrandbits(64) for _ in range(1000)}
    regs = neardup.registers([np.sort(np.asarray(list(x), dtype=np.uint64)) for x in (a, b)])
    packed = np.zeros((2, 32), dtype=np.uint64)
    for lane in range(4):
        packed |= regs[:, lane::4] << np.uint64(16 * lane)
    row = spark.createDataFrame([(packed[0].view(np.int64).tolist(), packed[1].view(np.int64).tolist())], "a array<bigint>, b array<bigint>")
    est, used = row.select(*[c.alias(n) for c, n in zip(neardup.jaccard_estimate(F.col("a"), F.col("b"), F.lit(4000), F.lit(4000)), ("e", "u"), strict=True)]).first()
    assert used == 128 and abs(est - 0.6) < 0.15


def test_long_paths_have_one_component(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 99), (500, 500)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint"), shared_dir(spark), "t").collect()}
    assert all(got[k] == 0 for k in range(61)) and {got[k] for k in (99, 100, 101)} == {99} and got[500] == 500


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["Abc def", "abc", "", None, "x", "def\tABC", "é abc"]
    out = {}
    for row, data, offsets in bytehash.groups(pa.array(texts)):
        h, rows = bytehash.word_hashes(data, offsets)
        for r, x in zip(rows, h, strict=True):
            out.setdefault(row + int(r), []).append(int(x))
    assert out[0] == [out[1][0], out[5][0]] and out[5][1] == out[1][0] and out[6][1] == out[1][0] and set(out) == {0, 1, 4, 5, 6}


def item_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))] if w else []


def brute_leaks(rows, items):
    out = {}
    for i, text in rows:
        s = item_shingles(text)
        for k, item in items:
            t = item_shingles(item)
            if not t or not s or i is None:
                continue
            it, best = collections.Counter(t), 0.0
            for p in range(len(s)):
                w = collections.Counter(s[p : p + len(t)])
                m = sum((w & it).values())
                best = max(best, m / (len(t) + sum(w.values()) - m))
            if best >= 0.8:
                out[i, k] = best
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((3, 5, 6, 12, 30, 30, 45))] + [(7, None), (8, ""), (9, "r r r r r r r s r r r r r r"), (4, "same id " + "again " * 9)]
    rows = [(0, None), (1, ""), (2, " ".join(word() for _ in range(200)))]
    for n, (_, text) in enumerate(items):
        for m in range(6):
            w = (text or "").split()
            for _ in range(m):
                if w:
                    k = rng.randrange(len(w))
                    w[k : k + 1] = rng.choice([[], [word()], [w[k], word()]])
            before, after = [word() for _ in range(rng.randrange(20))], [word() for _ in range(rng.randrange(20))]
            rows.append((100 + 10 * n + m, " ".join(before + w + after).upper() if m == 1 else " ".join(before + w + after)))
    d = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, item_id int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_leaks(rows, items)
    for most in (decontam.BROADCAST_ROWS, 0):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(d, b, broadcast_rows=most).collect()}
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    clean = decontam.keep_clean(d, b)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontam.contaminated(d.limit(0), b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0
    assert decontam.keep_clean(d, b.limit(0)).count() == len(rows)


def test_leaks_of_very_long_texts_and_items(spark):
    """A long item in a much longer text, and many items that share a passage."""
    rng = random.Random(13)
    words = [f"w{rng.randrange(10**6)}" for _ in range(80_000)]
    items = [(1, " ".join(words[:2_000])), (2, " ".join(words[100:160]))] + [(10 + k, " ".join(words[200:230] + [f"only{k}"] * 3)) for k in range(50)]
    rows = [(1, " ".join(["x"] * 50 + words)), (2, " ".join(f"y{k}" for k in range(80_000))), (3, " ".join(words[200:230])), (4, " ".join(words[100:160] * 40))]
    names = ["item_id", "h", "items", "window", "fp", "block", "text_hash"]
    d = spark.createDataFrame([(i, t, *names) for i, t in rows], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert {k for _, k in got if k >= 10} == set(range(10, 60))
    assert {(i, k) for i, k in got if k < 10} == {(1, 1), (1, 2), (4, 2)} and {i for i, k in got if k >= 10} == {1, 3}


def test_leaks_behind_a_shared_stem(spark):
    """Items and texts that share one phrase do not all meet; items that are nothing else, or repeat it, still do."""
    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    stem = "which of the following is"
    items = [(k, f"{stem} {words(14)}") for k in range(60)] + [(100, stem), (101, f"{stem} " * 6), (102, f"{stem} {words(2)}")]
    texts = [(k, f"{words(10)} {stem} {words(10)}") for k in range(40)]
    texts += [(200 + k, f"{words(9)} {items[k][1]} {words(5)}") for k in range(0, 60, 7)] + [(300, f"{stem} " * 9), (301, f"{words(20)} {items[62][1]}"), (302, stem)]
    docs_, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(docs_, bench).collect()}
    assert got == pytest.approx(brute_leaks(texts, items))
    assert {(200 + k, k) for k in range(0, 60, 7)} <= set(got) and (300, 101) in got and (5, 100) in got


def test_repeated_shingles_compare_as_counts(spark):
    rng = random.Random(12)
    rows = [([rng.randrange(4) for _ in range(rng.randrange(1, 12))], [rng.randrange(4) for _ in range(rng.randrange(1, 12))]) for _ in range(80)]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    for r in df.select("a", "b", decontam.weighted_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        a, b = collections.Counter(r.a), collections.Counter(r.b)
        assert r.s == pytest.approx(sum((a & b).values()) / sum((a | b).values()))


def test_simhash_and_blocks(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(-(2**63), 2**63 - 1, 40).tolist() + [5, 5, 5]
    bits = [[(v >> b) & 1 for b in range(64)] for v in values]
    want = sum((1 << b) for b in range(64) if 2 * sum(x[b] for x in bits) > len(values))
    df = spark.createDataFrame([(values,)], "h array<bigint>")
    got, blocks = df.select(decontam.simhash(F.col("h")), decontam.blocks(decontam.simhash(F.col("h")))).first()
    assert got & (2**64 - 1) == want and len(blocks) == 21
    # More hashes than sixteen bits can count.
    many = spark.range(1).select(decontam.simhash(F.array_repeat(F.lit(-1).cast("bigint"), 70_000)), decontam.simhash(F.concat(F.array_repeat(F.lit(5).cast("bigint"), 70_000), F.array_repeat(F.lit(2).cast("bigint"), 66_000)))).first()
    assert list(many) == [-1, 5]
    assert sum(b.value << (64 * b.block // 21) for b in blocks) == want


def brute_repeats(texts, window):
    seen = collections.Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        seen.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for b in data:
        mark = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                mark[i : i + window] = True
        runs = int(mark[:1].sum() + (mark[1:] & ~mark[:-1]).sum()) if len(b) else 0
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((len(b), int(mark.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def digests(df):
    """(n_bytes, n_removed, n_spans, kept_sha256) by doc_id, with the runs held against what is left."""
    out = {}
    for r in df.collect():
        assert r.n_bytes == len(r.kept) + sum(x.end - x.start for x in r.removed)
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))
        out[r.doc_id] = (r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest())
    return out


@pytest.mark.parametrize(("crowd", "piece"), [(2000, 1 << 22), (2, 1 << 22), (2000, 50)])
def test_repeats_equal_brute_force(spark, crowd, piece):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    shared = [text(90) for _ in range(3)]
    texts = [None, "", "short", "a" * 200, "ab" * 150, shared[0], shared[0]]
    texts += [text(rng.randrange(60)) + rng.choice(shared)[rng.randrange(20) : rng.randrange(60, 90)] + text(rng.randrange(60)) for _ in range(60)]
    texts += [shared[1] + "x" + shared[1], texts[20], texts[20][:-1] + "?"]
    d = spark.createDataFrame([(k, t, 0, "x", "y") for k, t in enumerate(texts)], "doc_id bigint, text string, body int, kept string, anchor string")
    got = digests(rldedup.remove_repeats(d, window=40, gram=8, group_strings=crowd, piece=piece))
    assert [got[k] for k in range(len(texts))] == brute_repeats(texts, 40)
    assert rldedup.remove_repeats(d.limit(0)).count() == 0


def test_repeats_at_the_window_of_the_query(spark):
    """400 bytes, with passages around that length, copies, near copies, repeated rows and null ids."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeiourstlné") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (58, 62, 66, 70, 74, 90, 200)]
    texts = [prose(rng.randrange(40)) + " " + rng.choice(passages) + " " + prose(rng.randrange(40)) for _ in range(60)]
    long = prose(700)
    texts += [long, long, long[:1500] + "X" + long[1500:], long[300:] + long[:900], None, "", "ab" * 400, "é" * 500]
    ids = [*range(len(texts) - 1), None]
    d = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")
    got = digests(rldedup.remove_repeats(d))
    want = brute_repeats(texts, 400)
    assert [got[k] for k in ids] == want
    assert 0 < sum(w[1] > 0 for w in want[:60]) < 60
    twice = digests(rldedup.remove_repeats(d.filter("doc_id < 3").unionByName(d.filter("doc_id < 3"))))
    assert twice == {k: (n := len(texts[k].encode()), n, 1, hashlib.sha256(b"").hexdigest()) if len(texts[k].encode()) >= 400 else brute_repeats([texts[k]] * 2, 400)[0] for k in range(3)}


def test_repeats_of_a_very_long_text(spark):
    """Megabytes of one text, repetitive and not, in pieces; the copy of a part of it elsewhere."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(1_500_000))
    d = spark.createDataFrame([(1, text), (2, "x" * 100 + text[700_000:702_000] + "y"), (3, "abc" * 300_000)], "doc_id bigint, text string")
    got = digests(rldedup.remove_repeats(d, piece=1 << 18))
    gone = lambda body, n, runs, left: (len(body), n, runs, hashlib.sha256(left.encode()).hexdigest())
    assert got[1] == gone(text, 2000, 1, text[:700_000] + text[702_000:])
    assert got[2] == gone("x" * 2101, 2000, 1, "x" * 100 + "y") and got[3] == gone("abc" * 300_000, 900_000, 1, "")


def test_index_statistics_equal_brute_force():
    rng = random.Random(5)
    for _ in range(20):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(5)]
        weights = [rng.choice([1, 1, 2, 7]) for _ in parts]
        index = rldedup.RunLengthIndex(np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), weights)
        got = index.matching_statistics()
        at = [(k, i) for k, p in enumerate(parts) for i in range(len(p))]
        for k, i in at:
            best = len(parts[k]) - i if weights[k] > 1 else 0
            for k2, i2 in at:
                if (k, i) != (k2, i2):
                    n = 0
                    while i + n < len(parts[k]) and i2 + n < len(parts[k2]) and parts[k][i + n] == parts[k2][i2 + n]:
                        n += 1
                    best = max(best, n)
            assert got[index.starts[k] + i] == best
