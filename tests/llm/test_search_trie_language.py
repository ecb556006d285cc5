"""Language of texts, hard negatives and the prefix trie against brute force and held-out rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchtide.llm import langid, negatives, trie
from watchtide.llm import queries as registered

NAN, INF = float("nan"), float("inf")


# --- prefix trie ---------------------------------------------------------------------------


def ordered(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in by.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        base, h = c - int(math.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        out[c] = turns if base == c else convs.get(base, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = own + sum(saved[k] for k in kids[node])
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if len(convs[c]) == len(node)))
        up = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members[node]), len(node), up, len(members[node]), len(kids[node]), leaves[node], saved[node], digest))
    return sorted(out, key=lambda r: r[:2])


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: r[:2])


def talks(seed=1):
    rng = random.Random(seed)
    say = lambda: (rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "hi", "é", "", None, "x" * 50]))
    rows = []
    for c in [*range(-6, 40), 101, 102, 203, 10**12]:
        rows += [(c, rng.choice([None, 0, 1, 2, k]), *say()) for k in range(rng.randrange(1, 12))]
    rows += [(50, k, "user", f"turn {k % 7}") for k in range(300)]  # one long conversation, and one that starts like it
    rows += [(60, k, "user", f"turn {k % 7}") for k in range(120)]
    rows += [(70, 0, "user", "same")] * 9 + [(None, 0, "user", "nobody's"), (71, None, None, None)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_trie_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(trie, "PIECE", 7)
        monkeypatch.setattr(trie, "IDS", 3)
        monkeypatch.setattr(trie, "BLOCK", 16)
    rows = talks()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash")).repartition(3)
    most = 40 if small else trie.RANGE
    assert got(trie.prefix_trie(*trie.rebuilt(df), most)) == brute_trie(rebuilt(ordered(rows)))
    assert got(trie.prefix_trie(*trie.sequences(df), most)) == brute_trie(ordered(rows))


def test_trie_of_empty_and_turnless_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(*trie.rebuilt(empty)).count() == 0
    # c - c % 5 is absent and all own turns are passed over: only the root is left.
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    one = spark.createDataFrame([(c, 0, "user", "a"), (c, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    assert got(trie.prefix_trie(*trie.rebuilt(one))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@pytest.mark.parametrize("most", [16, 200])
def test_list_ranking_for_any_order(spark, most):
    rng = random.Random(3)
    order = rng.sample(range(10**9), 700)  # neighbours in the list are far apart: coins are needed
    rows = list(zip(order, [*order[1:], -1], strict=True))
    rng.shuffle(rows)
    places = trie.ranked(spark.createDataFrame(rows, "id long, after long").repartition(5), most)
    assert {r.id: r.place for r in places.collect()} == {x: k for k, x in enumerate(order)}


# --- hard negatives ------------------------------------------------------------------------


def brute_negatives(rows, at=100, k=5):
    fine = set()
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.add((i, label, tuple(math.floor(256 * x) for x in v)))
    anchors = {}
    for i, label, v in sorted(fine):
        if i % at == 0:
            anchors.setdefault(i, (label, v))
    out = []
    for a, (label, v) in anchors.items():
        score = [(-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in fine]
        for top, p, _ in sorted(s for s in score if s[2] == label and s[1] != a)[:k]:
            fits = sorted(s for s in score if s[2] != label and 80 * -top <= 100 * -s[0] <= 100 * -top)[:k]
            out += [(a, p, r, n, -top, -low) for r, (low, n, _) in enumerate(fits, 1)]
    return sorted(out)


def vectors(rng, n, d, labels, spread):
    centers = rng.normal(size=(labels, d))
    label = rng.integers(0, labels, n)
    x = centers[label] * (1 - spread) + rng.normal(size=(n, d)) * spread
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(y) for y in x[i]], int(label[i])) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("spread", [0.4, 0.9])
def test_negatives_equal_brute_force_and_skip_cells(spark, monkeypatch, spread):
    rng = np.random.default_rng(4)
    rows = vectors(rng, 900, 12, 6, spread)
    rows += [(1000 + k, rows[0][1], k % 3) for k in range(150)]  # copies of one vector, some of them anchors
    rows += [(2000, None, 1), (2100, [0.1, None] * 6, 1), (2200, [NAN] * 12, 1), (2300, [INF] * 12, 1), (None, rows[1][1], 1), (2400, rows[1][1], None)]
    rows += [(2500, [0.0] * 12, 2), (2600, [0.5, 0.5], 3), (2700, [-x for x in rows[5][1]], 4), rows[100], rows[100]]
    monkeypatch.setattr(negatives, "ROWS", 64)
    seen = []
    visits = negatives.Index.visits

    def counted(self, anchors, first):
        out = visits(self, anchors, first)
        seen.append((out, self.there.sum()))
        return out

    monkeypatch.setattr(negatives.Index, "visits", counted)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit("clash")).withColumn("score", F.lit(1)).repartition(3)
    found = negatives.hard_negatives(df, codes=12, first=10)
    assert sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute_negatives(rows)
    if spread == 0.4:  # where vectors lie in clusters, the certificate leaves cells out
        took = [out.select(F.explode(F.split(F.hex("cells"), "(?<=\\G..)")).alias("c")).filter("c = '01'").count() for out, _ in seen]
        assert sum(took) < 0.8 * 4 * 14 * seen[0][1]


def test_negatives_of_large_numbers_and_none(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 5000, 6)], int(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, negatives.hard_negatives(df, codes=4, first=2).collect())) == brute_negatives(rows)
    assert negatives.hard_negatives(df.limit(0)).count() == 0
    assert negatives.hard_negatives(df.filter("vec_id % 100 = 3")).count() == 0
    assert negatives.hard_negatives(df.filter("vec_id = 100")).count() == 0


def test_multi_sequence_visits_all_cells_from_the_largest_sum_down():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=7), np.r_[rng.normal(size=4), [0.5, 0.5]]
    cells = list(negatives.multi_sequence(a, b))
    assert [c[0] for c in cells] == sorted((x + y for x in a for y in b), reverse=True)
    assert {c[1:] for c in cells} == {(i, j) for i in range(7) for j in range(6)} and len(cells) == 42


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(7)
    rows = rng.integers(-300, 300, (500, 9)).astype("<i2")
    books = negatives.Codebooks(rows[:100], 8)
    placed = books.place(rows)
    radii = [np.array([r[c == k].max(initial=0) for k in range(8)]) for c, r in placed]
    first, second = books.bounds(rows[:20], radii)
    score = rows[:20].astype(np.int64) @ rows.T.astype(np.int64)
    assert (first[:, placed[0][0]] + second[:, placed[1][0]] >= score).all()


# --- language ------------------------------------------------------------------------------


def test_gradients_equal_differences():
    rng = np.random.default_rng(8)
    network = langid.Network(["a", "b", "c"], hidden=3, kind=np.float64)
    symbols, label = rng.integers(0, langid.SYMBOLS, (6, 4)), np.array([0, 1, 2, 1])
    weight = (rng.random((6, 4)) > 0.2).astype(float)
    _, grads = network.gradients(symbols, label, weight)
    for p, g in zip(network.parameters(), grads, strict=True):
        flat, slope = p.reshape(-1), g.reshape(-1)
        for k in {*np.argsort(-np.abs(slope))[:8].tolist(), 0}:
            was = flat[k]
            flat[k] = was + 1e-5
            up = network.gradients(symbols, label, weight)[0]
            flat[k] = was - 1e-5
            down = network.gradients(symbols, label, weight)[0]
            flat[k] = was
            assert abs((up - down) / 2e-5 - slope[k]) < 1e-7


def test_windows_together_equal_one_text_at_a_time():
    rng = random.Random(9)
    network = langid.Network(["a", "b"])
    texts = ["".join(rng.choices("abc dé", k=n)).encode() for n in (0, 1, 5, 150, 160, 161, 1000, 333)]
    offsets = np.cumsum([0, *map(len, texts)])
    whole = network.texts(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for k, t in enumerate(texts):
        alone = network.texts(np.frombuffer(b"..." + t, np.uint8), np.array([3, 3 + len(t)]))
        assert np.allclose(alone[0], whole[k], atol=1e-5)
        if t:
            assert abs(whole[k].sum() - 1) < 1e-4


def test_language_of_given_documents(spark, folder):
    """On the held-out quarter; the given texts are of four languages."""
    found = registered.op11_langid(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and r.lang_pred != "und" and len(r.text) > 40]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(spark):
    words = {"xx": "the and of in to is that", "yy": "ßäö für über gäbe möchte hätte"}
    rows = [(i, " ".join(random.Random(i).choices(words[k].split(), k=12)), k) for i in range(200) for k in ([*words][i % 2],)]
    rows += [(300, None, "xx"), (301, "", "yy"), (302, "12 34 !? \n", "xx"), (303, "the", None), (None, "über möchte", "yy")]
    rows += [(304, "the and of " * 20000, None), (305, "über", "yy"), (305, "über", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("score", "window", "turn", "letter"):
        df = df.withColumn(name, F.lit("clash"))
    network = langid.fit(langid.sample(df))
    assert network.languages == ["xx", "yy"]
    got = defaultdict(list)
    for r in langid.predict(df.repartition(3), network).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    assert [got[i] for i in (300, 301, 302)] == [[("und", 0.0)]] * 3
    assert got[304][0][0] == "xx" and got[None][0][0] == "yy" and got[305][0] == got[305][1]
    assert sum(got[i][0][0] == ("xx", "yy")[i % 2] for i in range(200)) > 195
    assert langid.predict(df.limit(0), network).count() == 0
    nothing = langid.fit(langid.sample(df.limit(0)))
    assert {(r.lang_pred, r.score) for r in langid.predict(df, nothing).collect()} == {("und", 0.0)}
