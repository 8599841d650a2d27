"""Filter audit, prefix trie and substring dedup against brute force."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandspark.llm import filteraudit, substrings, trie
from strandspark.llm.common import shared_dir

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def test_swaps_visit_all_orders():
    for n in range(7):
        order = list(range(n))
        seen = {tuple(order)}
        for k in filteraudit.neighbour_swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == len(filteraudit.neighbour_swaps(n)) + 1 == len(set(itertools.permutations(range(n))))


def fails_of(rows):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, part in rows:
        t = text or ""
        w = WORDS.findall(t.encode())
        flags = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]]
        out.append((i, part or "", {x for x, f in zip("ABCDE", flags, strict=True) if f}))
    return out


def brute_audit(flagged, good, toxic):
    out = {}
    for part in {p for _, p, _ in flagged}:
        rows = [(i, f) for i, p, f in flagged if p == part]
        removed = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                removed[x] += len(gone)
                fail = sum(x in f for _, f in rows)
                out[part, "".join(order), step] = [len(left), len(gone), fail - len(gone), sum(f == {x} for _, f in rows), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed[order[step - 1]])
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "A", "#", "a b " * 30, "a B " * 40, "$ " + " ".join(map(str, range(60))), " ".join(map(str, range(60))), "Ä Éa " * 3, "X\x0by\x0cz"]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "s", "t"])) for _ in range(160)]
    rows += rows[:9] + [(100 + k, texts[7], "u") for k in range(12)]
    labels = [(k, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for k in range(0, 110, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id bigint, text string, source string, mask int, words string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filteraudit.audit_texts(docs, known, F.col("source")).collect()}
    want = brute_audit(fails_of(rows), {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None})
    assert len(got) == 4 * 600 and got == want
    assert filteraudit.audit_texts(docs.limit(0), known, F.col("source")).count() == 0
    assert filteraudit.audit_texts(docs, known.limit(0), F.col("source")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


def test_audit_of_other_filters_and_long_texts(spark):
    flagged = spark.createDataFrame([("p", True, None, None, True), ("p", True, True, True, None), (None, False, None, True, False)], "part string, x boolean, y boolean, good boolean, toxic boolean")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filteraudit.audit(flagged, "xy").collect()}
    assert got["p", "xy", 1] == (0, 2, 1, 1, 1, 3) and got["p", "yx", 2] == (0, 1, 1, 0, 1, 3) and got["p", "yx", 1] == (1, 1, 0, 1, 0, 1) and got["", "xy", 2] == (1, 0, 0, 0, 0, 0) and len(got) == 8
    with pytest.raises(ValueError, match="letter"):
        filteraudit.audit(flagged, "xx")
    long = spark.range(3).selectExpr("id AS doc_id", "repeat(concat('word', id, ' Az '), 600000) AS text", "'s' AS source")
    began = time.time()
    assert filteraudit.text_flags(long, F.col("source")).filter("B AND C AND NOT A AND NOT E").count() == 3 and time.time() - began < 30


def brute_trie(convs):
    """Rows by (depth, opening) of {conv: [(role, text)]}."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for node, who in members.items():
        under = [x for x in members if x[: len(node)] == node]
        kids = lambda x: [y for y in members if len(y) == len(x) + 1 and y[: len(x)] == x]
        ends = ",".join(str(c) for c in sorted(c for c in who if len(convs[c]) == len(node)))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        out[(min(who), len(node))] = (min(members[node[:-1]]) if node else None, len(who), len(kids(node)), sum(not kids(x) for x in under), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def turns_of(rows):
    out = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for _, _, r, t in sorted(v)] for c, v in out.items()}


def some_turns(rng, n):
    rows = []
    for c in range(-30, n):
        if rng.random() < 0.2 or c == 200:
            continue
        for k in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([None, k, k, k // 2, k]), rng.choice(["user", "assistant", None, "", "ü"]), rng.choice(["a", "", None, "é\U0001f600", "b\n"])))
    rows += rows[::7] + [(None, 1, "user", "x")]
    rng.shuffle(rows)
    return rows


def found_trie(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


KIND = "conv_id bigint, turn bigint, role string, text string, depth string, digest int, owner int"


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "_ROWS", 7)
    rows = some_turns(random.Random(8), 260)
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], KIND)
    more = spark.createDataFrame([(900,), (None,), (5,)], "conv_id bigint")
    convs = turns_of(rows)
    got = found_trie(trie.prefix_trie(df, more))
    assert got == brute_trie(convs | {900: []}) and len(got) == trie.prefix_trie(df, more).count()
    # Openings that are lent: of block 0 and 100 where they exist, and of none at all.
    lent = {}
    for c in convs:
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        lent[c] = convs.get(base, [])[:h] + convs[c][h:]
    assert any(not t for t in lent.values())
    assert found_trie(trie.prefix_trie(trie.share_openings(df), df)) == brute_trie(lent)
    assert trie.prefix_trie(df.limit(0)).count() == 0 and trie.prefix_trie(trie.share_openings(df.limit(0)), df.limit(0)).count() == 0
    only = trie.prefix_trie(df.limit(0), more).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves) for r in only] == [(5, 0, 2, 1)]


def test_ids_of_a_node_go_on_in_pieces(spark, monkeypatch):
    """A node at which very many conversations end is hashed over pieces, in the order of numbers."""
    ids = [*range(-40, 3000, 3)]
    df = spark.createDataFrame([(c, 0, "user", "hello") for c in ids], "conv_id bigint, turn bigint, role string, text string")
    found = trie.prefixes(df).repartition(3)
    ends = trie.end_digests(found).collect()
    assert [r.ends_sha256 for r in ends] == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
    batch = found.filter("ends").select("depth", "digest", "conv_id").orderBy("conv_id").toArrow().to_batches()
    pieces = [r for b in trie._pieces(iter(batch), 100) for r in b.to_pylist()]
    assert len(pieces) > 30 and ",".join(p["ids"] for p in pieces) == ",".join(map(str, ids))


def test_a_very_long_shared_conversation(spark):
    """Forty thousand turns that two conversations share cost in proportion to the turns."""
    one = spark.range(40000).selectExpr("id AS turn", "'user' AS role", "concat('t', id) AS text")
    df = one.selectExpr("1L AS conv_id", "*").unionByName(one.selectExpr("2L AS conv_id", "*")).unionByName(one.limit(10).selectExpr("3L AS conv_id", "*"))
    began = time.time()
    top = trie.prefix_trie(df).filter("depth IN (0, 10, 40000)").orderBy("depth").collect()
    assert time.time() - began < 60
    chars = [len(f"t{k}") for k in range(40000)]
    assert [(r.n_convs, r.n_leaves, r.saved_tokens) for r in top] == [(3, 1, sum(chars) + sum(chars[:10])), (3, 1, sum(chars[9:]) + chars[9]), (2, 1, chars[-1])]


def brute_repeats(rows, window):
    count = collections.Counter()
    split = [(i, WORDS.findall((t or "").encode())) for i, t in rows]
    for _, w in split:
        for k in range(len(w) - window + 1):
            count[tuple(w[k : k + window])] += 1
    out = []
    for i, w in split:
        gone = {p for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for p in range(k, k + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return out


def repeated_texts(rng, window):
    vocab = [f"w{k}" for k in range(400)] + ["é", "W1", "x\x00y", " "]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, short = text(3 * window), text(window - 1)
    rows = [None, "", " \t\n\x0b\x0c\r ", "one", " ".join(text(window)), "a " * (3 * window), "a b " * (2 * window), "b a " * window, "a b c " * window]
    for _ in range(60):
        w = text(rng.randrange(window * 4))
        k = rng.randrange(len(w) + 1)
        part = passage[rng.randrange(window) :][: rng.randrange(3 * window)]
        w[k:k] = rng.choice([part, short, passage, []])
        rows.append(rng.choice([" ", "\n", "  \t"]).join(w))
    rows += rng.sample(rows, 12)
    base = text(5 * window)
    for _ in range(30):
        w = list(base)
        w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append(" ".join(w))
    return rows


@pytest.mark.parametrize("crowd,piece", [(1000, 1 << 18), (3, 1 << 18), (0, 50), (1000, 64)])
def test_substrings_equal_brute_force(spark, crowd, piece):
    rng = random.Random(crowd + piece)
    window = 12
    texts = repeated_texts(rng, window)
    rows = [(rng.choice([k, k, k, None, 7]), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n_words int, body string")
    done = substrings.remove_repeats(df, window, 4, crowd, piece)
    got = [(r.doc_id, r.n_words, sum(x.end - x.start for x in r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in done.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute_repeats(rows, window), key=key)
    assert substrings.remove_repeats(df.limit(0), window).count() == 0


def test_substrings_at_the_window_of_the_query(spark):
    rng = random.Random(1)
    rows = list(enumerate(repeated_texts(rng, substrings.WINDOW)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_words, sum(x.end - x.start for x in r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substrings.remove_repeats(df).collect())
    assert got == sorted(brute_repeats(rows, substrings.WINDOW)) and any(r[2] for r in got) and any(not r[2] and r[1] > 50 for r in got)


def test_substrings_of_very_long_texts(spark):
    """A text of five megabytes with a passage of another, a word of a megabyte, and a long period."""
    rng = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(60))
    long = [f"u{rng.randrange(1 << 40)}" for _ in range(350000)]
    long[200000] = passage
    long[100] = "x" * (1 << 20)
    rows = [(0, " ".join(long)), (1, f"other words {passage} more"), (2, "ab cd " * 200000), (3, "y" * (6 << 20))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in substrings.remove_repeats(df).collect()}
    assert [(x.start, x.end) for x in got[0].removed] == [(200000, 200060)] and [(x.start, x.end) for x in got[1].removed] == [(2, 62)]
    assert got[2].n_words == 400000 and bytes(got[2].kept) == b"" and got[3].n_words == 1 and not got[3].removed


def test_words_go_piece_by_piece():
    rng = random.Random(3)
    data = np.frombuffer("".join(rng.choice(["a", "bb", " ", "\n ", "c" * 40]) for _ in range(900)).encode(), dtype=np.uint8)
    whole, bounds = substrings._words(data, np.asarray([0, len(data)]))
    for most in (1, 7, 30, 64):
        values, ends = substrings._words(data, np.asarray([0, len(data)]), most)
        assert (values == whole).all() and list(ends) == list(bounds)


def test_automaton_statistics_equal_brute_force():
    rng = random.Random(4)
    for trial in range(60):
        strings = [[rng.choice("abc"[: 2 + trial % 2]) for _ in range(rng.randrange(0, 14))] for _ in range(rng.randrange(1, 6))]
        weights = [rng.choice([1, 1, 2]) for _ in strings]
        automaton = substrings.SuffixAutomaton()
        count = collections.Counter()
        for s, n in zip(strings, weights, strict=True):
            automaton.add(s, n)
            for a in range(len(s)):
                for b in range(a + 1, len(s) + 1):
                    count[tuple(s[a:b])] += n
        automaton.prune()
        for s in [*strings, [rng.choice("abcd") for _ in range(20)]]:
            want = [max((e - a for a in range(e) if count[tuple(s[a:e])] > 1), default=0) for e in range(1, len(s) + 1)]
            assert automaton.statistics(s) == want
