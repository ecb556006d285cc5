"""Every operator on awkward rows and against brute force on small texts."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from watchtide.llm import chat, exact, jaccard, licenses, mixing, pieces, pii, quality, suffix, toxicity
from watchtide.llm.common import components
from watchtide.llm import queries as registered

WORD = re.compile("[^\x20\x09-\x0d]+")
# Names that operators use inside.
CLASH = "digest node component score size rank part h w s target keys counts at words source_size places".split()


def prose(seed, n):
    rng = random.Random(seed)
    syllables = "the an er on re ti in es st en at ed nd to or ea hi is ou".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


LONG = prose(1, 30000)
NEAR = prose(2, 200)
TEXTS = [
    (1, NEAR),
    (2, NEAR + " changed at the end"),
    (3, NEAR),
    (4, None),
    (5, ""),
    (6, "   \n\t "),
    (7, "one two"),
    (8, "One  TWO"),
    (9, LONG),
    (10, LONG + " tail"),
    (11, "x" * 3000),
    (12, "x" * 3000 + "y"),
    (12, "same id, other text"),
    (13, "é😀 中文 ▁ñ " * 30),
    (13, "é😀 中文 ▁ñ " * 30),
    (None, "no id at all"),
    (None, NEAR),
    (14, prose(3, 80) + " " + prose(4, 40)),
    (15, prose(5, 60) + " " + prose(4, 40) + " " + prose(6, 30)),
    (16, "mail a.b@c.example.org or 10.0.0.256 or 1.2.3.4 card 4111 1111 1111 1111 call +1 (555) 010-9999!"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i is None else f"src{i % 3}", len(t or "")) for i, t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASH:
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def operators():
    def scored(d):
        labels = d.sparkSession.createDataFrame([(1, 0, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
        return toxicity.score(d, toxicity.fit(d, labels))

    return {
        "exact": lambda d: exact.exact_dedup(d, exact.DigestIndex.fresh(d.sparkSession, 4)),
        "jaccard": jaccard.near_duplicates,
        "quality": quality.quality,
        "licenses": lambda d: licenses.scan(licenses.as_files(d)),
        "toxicity": scored,
        "suffix": suffix.dedup,
        "mixing": mixing.mix,
        "pieces": pieces.encode,
        "pii": pii.personal_data,
    }


@pytest.mark.parametrize("name", operators())
def test_a_row_for_every_row_and_none_for_none(spark, docs, name):
    run = operators()[name]
    found = [r.doc_id for r in run(docs).select("doc_id").collect()]
    assert sorted(map(str, found)) == sorted(str(i) for i, _ in TEXTS)
    assert run(docs.limit(0)).count() == 0


def test_chat_reads_back_what_went_in(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\l\\e<s>[", None, "", "x[TURN]y", "\\"]
    rows = [(c, k, r, t) for c in (1, 2) for k, (r, t) in enumerate(zip(["user", "user", "assistant", "assistant", "user", None], texts))]
    rows += [(3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (3, None, "[role]", "b"), (None, 1, "user", "z")]
    rows += [(4, k, "assistant", str(k)) for k in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("l"))
    got = {r.conv_id: r for r in out.collect()}
    by = defaultdict(list)
    for c, k, r, t in rows:
        by[c].append((-1 if k is None else k, r or "", t or ""))
    for c, turns in by.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        assert [tuple(x) for x in got[c].t] == turns
        assert got[c].l == "".join(t for r, t in turns if r == "assistant")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_and_personal_data_stay_in_the_jvm(spark, folder):
    for name in ("op1_chat", "op10_pii"):
        plan = registered.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_exact_keeps_the_smallest_id_and_remembers(spark, docs):
    index = exact.DigestIndex.fresh(spark, 4)
    first = exact.exact_dedup(docs.filter("doc_id >= 3"), index).collect()
    assert {r.keep_id for r in first if r.doc_id == 3} == {3}
    assert {r.keep_id for r in first if r.doc_id == 13} == {13}
    again = {r.doc_id: r for r in exact.exact_dedup(docs.filter("doc_id is not null"), index).collect()}
    assert (again[1].keep_id, again[1].kept, again[1].group_size) == (3, False, 2)  # an earlier batch brought it
    assert index.read().count() == index.read().select("digest").distinct().count()


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def classes(texts):
    sets = [(i, shingles(t)) for i, t in texts]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for group in range(12):  # chains of edits of different strength
        words = prose(100 + group, rng.choice([6, 30, 90, 400])).split()
        for _ in range(12):
            texts.append((len(texts), " ".join(words)))
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    want = classes(texts)
    assert got == {i: (len(shingles(t)), want[i]) for i, t in texts}


def test_jaccard_splits_large_buckets_and_loses_no_link(spark, monkeypatch):
    rng = random.Random(8)
    common, texts = prose(300, 60).split(), []
    for group in range(30):  # one passage in all, links within a group
        words = common + prose(301 + group, 40).split()
        for _ in range(4):
            texts.append((len(texts), " ".join(words)))
            words = list(words)
            words[rng.randrange(60, 100)] = f"new{rng.random()}"
    texts += [(len(texts) + k, " ".join([*common, "end", str(k)])) for k in range(70)]  # one large component
    sizes, search = [], jaccard._search

    def seen(buckets, percent):
        sizes.append(buckets.groupBy("key").count().agg(F.max("count")).first()[0])
        return search(buckets, percent)

    monkeypatch.setattr(jaccard, "SPLIT", 10)
    monkeypatch.setattr(jaccard, "_search", seen)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
    assert got == classes(texts)
    assert sizes[0] <= 50  # about two blocks of 10; the largest bucket has about 100 points


def test_tree_leaves_out_pairs_of_one_group_only():
    import numpy as np

    rng = np.random.default_rng(6)
    points = rng.poisson(3, (500, jaccard.GROUPS)).astype(np.int32)
    points[1::2] = np.maximum(points[::2] + rng.integers(-1, 2, points[::2].shape), 0)
    points[200:] = points[200] + rng.integers(0, 2, (300, jaccard.GROUPS))
    groups = np.r_[np.arange(195), np.full(305, 7000)]
    found = [p for a, b in jaccard.Tree(points, groups).join(75) for p in zip(a.tolist(), b.tolist())]
    size = points.sum(axis=1)
    want = {
        (i, j)
        for i in range(500)
        for j in range(i + 1, 500)
        if groups[i] != groups[j] and 175 * np.minimum(points[i], points[j]).sum() >= 75 * (size[i] + size[j])
    }
    assert want == {tuple(sorted(p)) for p in found if groups[p[0]] != groups[p[1]]}
    assert len(found) < 20000  # 305 points of one group make 46,360 pairs


def test_results_do_not_depend_on_runs(spark, monkeypatch):
    import pyarrow as pa

    from watchtide.llm import shingles as module

    # A batch is taken in slices: the sets of slices are those of the whole.
    texts = pa.array([prose(k, 40 + k) for k in range(12)] + ["A Few WORDS", None, ""], pa.string())
    for width in (4, 9):
        whole = [s.tolist() for s in module.shingle_sets(texts, width)]
        parts = [s.tolist() for at in range(0, 15, 5) for s in module.shingle_sets(texts.slice(at, 5), width)]
        assert parts == whole and [len(s) for s in whole[:3]] == [40 + k - width + 1 for k in range(3)]
    rng, rows = random.Random(4), []
    for group in range(10):
        words = prose(700 + group, 60).split()
        for _ in range(6):
            rows.append((len(rows), " ".join(words)))
            words = [*words[:-1], f"new{rng.randrange(3)}"]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    plain = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
    cut, coded = sorted(suffix.dedup(df).collect()), sorted(pieces.encode(df).collect())
    monkeypatch.setattr(module, "RUN_BYTES", 700)
    monkeypatch.setattr(pieces, "RUN_BYTES", 700)
    monkeypatch.setattr(pieces, "BLOCK", 7)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()} == plain == classes(rows)
    assert sorted(suffix.dedup(df).collect()) == cut and sorted(pieces.encode(df).collect()) == coded


def test_shingles_of_runs_with_few_words():
    import pyarrow as pa

    from watchtide.llm.shingles import shingle_sets

    for n in range(12):  # all the words that a run of texts has
        for texts in ([prose(7, n)], ["", *prose(7, n).split(), None], [prose(7, n), prose(8, 6)]):
            sizes = [len(s) for s in shingle_sets(pa.array(texts, pa.string()), 5)]
            assert sizes == [len(shingles(t)) for t in texts]


def test_tree_finds_every_pair_the_bound_allows():
    import numpy as np

    rng = np.random.default_rng(5)
    points = rng.poisson(3, (300, jaccard.GROUPS)).astype(np.int32)
    points[1::3] = np.maximum(points[::3] + rng.integers(-1, 2, points[::3].shape), 0)
    found = {tuple(sorted(p)) for a, b in jaccard.Tree(points).join(75) for p in zip(a.tolist(), b.tolist())}
    size = points.sum(axis=1)
    want = {
        (i, j)
        for i in range(300)
        for j in range(i + 1, 300)
        if 175 * np.minimum(points[i], points[j]).sum() >= 75 * (size[i] + size[j])
    }
    assert found == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 100), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert found == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_suffix_equals_brute_force(spark):
    rng = random.Random(3)
    parts = [prose(k, 14) for k in range(8)]
    texts = [(i, " ".join(rng.choice(parts)[rng.randrange(20) :] + prose(900 + i, 5) for _ in range(4))) for i in range(60)]
    texts += [(60, "ab" * 200), (61, "ab" * 90 + "c"), (62, "é" * 80), (63, "z" * 50), (64, "z" * 49), (65, "\0" * 120), (66, "\0" * 60)]
    first = {}
    for i, t in texts:
        raw = t.encode()
        for k in range(len(raw) - 49):
            first.setdefault(raw[k : k + 50], i)
    got = {r.doc_id: r for r in suffix.dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
    for i, t in texts:
        raw, gone = t.encode(), bytearray(len(t.encode()))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_cuts_each_of_two_long_texts_with_one_id(spark):
    passage, other = prose(50, 30), prose(51, 30)
    texts = [(1, passage), (2, other), (5, prose(52, 300) + passage), (5, prose(53, 20) + other[:90])]
    texts += [(5, prose(54, 60)), (7, prose(54, 60) + passage), (7, prose(53, 20)), (5, prose(54, 60)), (8, prose(52, 300))]
    want = []
    for i, t in texts:
        raw, gone = t.encode(), bytearray(len(t.encode()))
        for k in range(len(raw) - 49):
            if any(j < i and raw[k : k + 50] in u.encode() for j, u in texts):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want.append((i, len(raw), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = suffix.dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == sorted(want)


def test_mixing_meets_targets(spark):
    rng = random.Random(9)
    rows = [(i, prose(i, rng.randrange(0, 60)), rng.choice(["a", "b", "b", "b", None, "c", "é"])) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block_tokens=64).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, goal, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not full:
            goal |= {s: weight[s] * level for s in free}
            break
        for s in full:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
            free.remove(s)
    taken = defaultdict(int)
    by = {i: (t, s) for i, t, s in rows}
    for r in got:
        text, source = by[r.doc_id]
        assert r.size == len(WORD.findall(text)) and r.source_size == sizes[source]
        assert r.target == pytest.approx(goal[source]) and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    assert all(taken[s] == int(goal[s] + 1e-9) or abs(taken[s] - goal[s]) <= 1 for s in order)
    assert sorted(mixing.mix(df.repartition(5), block_tokens=64).collect()) == sorted(got)


def test_pieces_do_not_depend_on_chunks_and_decode_exactly(spark):
    texts = [(i, t) for i, (_, t) in enumerate(TEXTS) if len(t or "") < 5000]
    texts += [(100, "a  b "), (101, "    " * 40 + "end"), (102, "tab\tnl\n" * 50), (103, "中" * 300 + " " + "ab" * 90)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    vocabulary = pieces.Vocabulary()
    want = {i: vocabulary.best(" " + t)[1] if t else [] for i, t in texts}
    for chunk in (40, 333, pieces.CHUNK):
        coded = pieces.encode(df, chunk=chunk)
        assert {r.doc_id: r.ids for r in coded.collect()} == want
        assert {r.doc_id: r.text for r in pieces.decode(coded).collect()} == {i: t or "" for i, t in texts}


def test_decoding_is_expressions_and_joins_bytes_before_they_are_text(spark):
    vocabulary = pieces.Vocabulary()
    byte, of = vocabulary.byte_ids, vocabulary.pieces
    ids = [None, [], list(byte.values()), [byte[0xE2], byte[0x82], byte[0xAC]], [of[" the"][0], byte[0xF0], byte[0x9F], of[" a"][0]], [0, 1, 2]]
    got = pieces.decode(spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>"))
    # A second Python worker in every task took more than an executor has.
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    wanted = {k: b"".join(vocabulary.bytes_of[i] for i in x or []).removeprefix(b" ").decode("utf-8", "replace") for k, x in enumerate(ids)}
    assert {r.doc_id: r.text for r in got.collect()} == wanted


def test_matrices_combine_associatively():
    vocabulary = pieces.Vocabulary()
    words = pieces.Words(vocabulary)
    text, n = " the quick中 brownfox" * 12, 60
    cut = [text[k * n : k * n + n + vocabulary.longest] for k in range(3)]
    a, b, c = (pieces.matrix(vocabulary, words, t, n) for t in cut)
    assert (pieces.times(pieces.times(a, b), c) == pieces.times(a, pieces.times(b, c))).all()
    whole = pieces.matrix(vocabulary, words, text[: 3 * n + vocabulary.longest], 3 * n)
    assert (pieces.times(pieces.times(a, b), c)[0] == whole[0]).all()


def luhn(digits):
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def personal(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in kinds.items()}


def test_personal_data_equals_brute_force(spark, folder):
    odd = [
        "a@b.c_d@e.f 1.2.3.4.5.6.7.8 001.02.3.255 999.1.1.1 ..@x.y a@@b.c %+-@-.-",
        "4111111111111111 4111-1111 1111 1111 4111 1111 1111 1112 1 2 3 12345678901234567890",
        "+1 (743) 555-3824 +12 +123456789012345678 ++1234567 890 +1-2",
        "😀 é a@b.co 😀 +1 (743) 555-3824",
        "9" * 5000 + "@" + "a" * 5000 + ".b",
        "",
    ]
    rows = [(i, t) for i, t in enumerate(odd)]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.personal_data(df).collect():
        want = personal(rows[r.doc_id if r.doc_id < 100 else [i for i, _ in rows].index(r.doc_id)][1])
        assert {k: [(s.start, s.end) for s in r[k]] for k in want} == want


def test_personal_data_of_numbers_with_any_length(spark):
    texts = ["9" * 60 + ".1.2.3 and 1.2.3.4", "1.2." + "0" * 300 + "7.255", "1.2.3." + "1" * 39, "4294967297.1.1.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.ip] for r in pii.personal_data(df).collect()}
    assert got == {i: personal(t)["ip"] for i, t in enumerate(texts)}


def test_personal_data_added_by_check_sum_and_context(spark):
    text = "iban GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33; please call 555 123 4567 or 555 123 4568 x 1"
    r = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [text[s.start : s.end] for s in r.iban] == ["GB82 WEST 1234 5698 7654 32"]
    assert text[r.number[0].start : r.number[0].end] == "555 123 4567"


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(11)
    bad = "idiot moron scum trash pathetic".split()
    rows, labels = [], []
    for i in range(900):
        words, toxic = prose(i, rng.randrange(40, 160)).split(), int(rng.random() < 0.2)
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = toxicity.score(docs, model).join(marks, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit / sum(r.toxic for r in got) > 0.9 and hit / sum(r.predicted for r in got) > 0.8


def test_toxicity_features_equal_brute_force():
    import numpy as np

    rng = random.Random(13)
    texts = [prose(k, rng.randrange(1, 400)).encode() for k in range(30)] + [b"", b"x" * 5000, "é".encode() * 90]
    contents = (b" idiot moron scum " + prose(900, 300).encode(), prose(900, 300).encode())
    toxic, ordinary = [toxicity._compressor(c) for c in contents]
    got = toxicity.features(texts, toxic, ordinary)
    for text, row in zip(texts, got, strict=True):
        text = text or b" "
        saved = []
        for k in range(max(1, -(-(len(text) - 16) // 80))):  # windows of 96 bytes, 80 apart
            window = text[80 * k : 80 * k + 96]
            saved.append(len(ordinary.compress(window)) - len(toxic.compress(window)))
        top = sorted(saved, reverse=True)
        want = [top[0], top[1] if len(top) > 1 else 0, sum(top[:3]) / len(top[:3]), sum(saved) / len(saved), np.log(len(saved)), sum(x >= 4 for x in saved) / len(saved)]
        want += [np.log1p(sum(x >= least for x in saved)) for least in (1, 2, 4, 6)]
        assert row.tolist() == pytest.approx(want)


def test_exact_batches_meet_by_a_sort_merge_anti_join(spark, docs):
    index = exact.DigestIndex.fresh(spark, 4)
    whole = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact.exact_dedup(docs, exact.DigestIndex.fresh(spark, 4)).collect())
    found = exact.exact_dedup(docs, index, cuts=[7, 12])
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in found.collect()) == whole
    plan = index.lacking(exact._firsts(docs.select("doc_id", exact.digest(F.col("text")).alias("digest"))))._jdf.queryExecution().executedPlan().toString()
    assert re.search("SortMergeJoin.*LeftAnti", plan)
    assert index.lacking(index.read()).count() == 0


def test_near_copies_of_texts_that_share_an_id(spark, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    near, other = prose(70, 60), prose(71, 60)
    rows = [(1, near), (5, near + " x"), (5, other), (5, other), (7, other + " y"), (8, prose(72, 9)), (None, near), (9, None), (9, ""), (3, other + " z")]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string")
    left = corpus_pipeline.drop_near_copies(spark, df, folder)
    assert left.columns == list(corpus_pipeline.COLUMNS)
    kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    # Of the second group the smallest id is 3; both rows of the other text with id 5 go.
    assert kept == sorted([(1, near), (3, other + " z"), (8, prose(72, 9)), (None, near), (9, None), (9, "")], key=str)


def test_quality_counts(spark):
    text = "a b c d e f g h " * 3 + "\n#x#\nline\nline\n \n "
    r = quality.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (27, 2, 1, 24, True, False)


def test_licences_are_inherited_from_the_nearest_directory(spark):
    mit, apache = "Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.\ny"
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c/x.py", "code"), (3, "a/b/LICENSE.txt", apache), (4, "z/x.py", "code")]
    rows += [(5, "a/own.py", apache), (6, "a/x.py", "about the history of the license as such"), (7, None, mit), (8, "a/b/c/x.py", None)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin, r.from_path) for r in licenses.scan(df).collect()}
    assert got == {
        1: ("MIT", "own", "a/LICENSE"),
        2: ("Apache-2.0", "directory", "a/b/LICENSE.txt"),
        3: ("Apache-2.0", "own", "a/b/LICENSE.txt"),
        4: (None, None, None),
        5: ("Apache-2.0", "own", "a/own.py"),
        6: ("MIT", "directory", "a/LICENSE"),
        7: ("MIT", "own", None),
        8: ("Apache-2.0", "directory", "a/b/LICENSE.txt"),
    }


def test_licences_of_given_documents_are_inherited_from_several_levels(spark, tmp_path):
    # As in the given documents, a notice is the last line.
    notices = {300: "Released under the MIT License.", 301: "Licensed under CC BY-NC 4.0.", 302: "All rights reserved."}
    texts = {i: prose(i, 20) + ("\n" + notices[i] if i in notices else "") for i in (*range(300, 308), 410, 500)}
    rows = [(i, "s", "de" if i == 500 else "en", t) for i, t in texts.items()] + [(600, "t", "en", "none here"), (None, "t", None, None)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.license, r.origin, r.from_path) for r in registered.op4_licenses(spark, str(tmp_path)).collect()}
    assert got[300] == ("MIT", "own", "s/LICENSE-300") and got[302] == ("All-Rights-Reserved", "own", "s/en/3/LICENSE-302")
    assert got[305] == ("All-Rights-Reserved", "directory", "s/en/3/LICENSE-302")
    assert got[410] == ("CC-BY-NC-4.0", "directory", "s/en/LICENSE-301")
    assert got[500] == ("MIT", "directory", "s/LICENSE-300")
    assert got[600] == got[None] == (None, None, None) and len(got) == len(rows)


def licence_of(text):
    """Every run of words of every template's length, and every line, against every template: no bounds."""
    import math
    from collections import Counter

    split = lambda t: re.findall("[a-z0-9]+(?:[.-][0-9a-z]+)*", t.lower())
    known = [(name, split(t)) for name, t in licenses.TEMPLATES]
    n = len(known)
    idf = lambda w: math.log((1 + n) / (1 + sum(w in t for _, t in known) or 1)) + 1
    weight = lambda w: idf(w) if any(w in t for _, t in known) else math.log((1 + n) / 2) + 1
    vector = lambda words: {w: k * weight(w) for w, k in Counter(words).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    places = [(k, w) for k, line in enumerate(text.lower().split("\n")) for w in split(line)]
    words = [w for _, w in places]
    spans = {(i, i + min(len(t), len(words))) for _, t in known for i in range(len(words) - min(len(t), len(words)) + 1)}
    spans |= {(min(x), max(x) + 1) for line in {k for k, _ in places} for x in ([i for i, (k, _) in enumerate(places) if k == line],)}
    some = {w for _, t in known for w in t}
    found = []
    for i, j in spans:
        if sum(w in some for w in words[i:j]) < 2:
            continue
        mine = vector(words[i:j])
        best = []
        for m, (name, t) in enumerate(known):
            its = vector(t)
            if len(its.keys() & mine.keys()) > 1:
                cosine = sum(x * its.get(w, 0.0) for w, x in mine.items()) / norm(mine) / norm(its)
                best.append((-round(cosine, 6), f"{name}#{m}"))
        if best and -min(best)[0] >= licenses.LEAST:
            found.append((*min(best), i, j))
    taken, notices = set(), []
    for cosine, key, i, j in sorted(found):
        if not taken & set(range(i, j)):
            taken |= set(range(i, j))
            notices.append((i, key.split("#")[0], -cosine))
    return min(notices, default=(None, None, None))[1]


def test_licences_equal_brute_force(spark, folder):
    rows = [(r.doc_id, r.source, r.lang, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if len(r.text) < 3000]
    rng = random.Random(12)
    bits = [t for _, t in licenses.TEMPLATES]
    for k in range(40):  # notices with words lost, added and mixed up, over lines
        words = " ".join([prose(k, 8), *rng.sample(bits, 2), prose(k + 50, 6)]).split()
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = rng.choice(["license", "x", "the", "version"])
        rows.append((10_000 + 37 * k, rng.choice(["a", None]), "en", " ".join(w + rng.choice([" ", " ", "\n"]) for w in words)))
    own = {i: licence_of(t) for i, _, _, t in rows}
    levels = {i: (s or "none", g or "none", str(i // 100)) for i, s, g, _ in rows}
    files = {}
    for i, name in own.items():
        if name:
            at = levels[i][: 1 + i % 3]
            files.setdefault(at, []).append(("/".join([*at, f"LICENSE-{i}"]), name))
    want = {}
    for i, name in own.items():
        place = levels[i][: 1 + i % 3] if name else levels[i]
        above = [min(files[place[:k]])[1] for k in range(len(place), 0, -1) if place[:k] in files]
        want[i] = (name or next(iter(above), None), "own" if name else "directory" if above else None)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan_documents(df.repartition(4)).collect()}
    assert got == want
    assert sum(name is not None for name in own.values()) > 30


def test_licences_in_long_lines_over_lines_and_reserved_rights(spark, monkeypatch):
    wrapped = "Permission is hereby\n * granted, free of charge,\n * to any person obtaining\n * a copy of this software"
    texts = {
        "All rights reserved.": "All-Rights-Reserved",
        "Copyright (c) 2020 Somebody. All rights reserved.": "All-Rights-Reserved",
        "All rights are equal\nhuman rights, all of them": None,
        prose(1, 300) + " licensed under the Apache License, Version 2.0. " + prose(2, 300): "Apache-2.0",
        prose(3, 9) + "\n * " + wrapped + "\n" + prose(4, 9): "MIT",
        "ich bin\nmit\nmit mit mit mit mit": None,
        prose(5, 40) + "\nMIT License\nAll rights reserved.": "MIT",
        "about the history of the license as such": None,
        "": None,
    }
    want = [*texts.values(), "MIT"]
    df = spark.createDataFrame([(1, "p", t) for t in (*texts, "MIT License")], "doc_id long, path string, text string")
    got = licenses.detect(df, keep=("text",)).collect()  # rows of one id are apart
    assert {r.text: r.license for r in got} == texts | {"MIT License": "MIT"} and len(got) == len(want)
    # Where a long text is cut into pieces does not matter.
    whole = licenses.Templates()
    for pad in range(0, 400, 7):
        long = prose(6, 900) + "\n" + prose(7, pad + 1) + " " + wrapped + " " + prose(8, 700)
        want = whole.first(long)
        monkeypatch.setattr(licenses, "PIECE", 300)
        assert whole.first(long) == want and want[1] == "MIT"
        monkeypatch.undo()


def test_pipeline_stages_on_awkward_rows(spark, docs, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    normal = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    left = corpus_pipeline.drop_copies(spark, docs, folder)
    rows = [(r.doc_id, r.text) for r in left.collect()]
    assert sorted(normal(t) for _, t in rows) == sorted({normal(t) for _, t in TEXTS})
    assert (None, "no id at all") in rows and (12, "same id, other text") in rows and (1, NEAR) in rows
    mixed = [(r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, left, folder).collect()]
    for row in rows:
        assert mixed.count(row) == 1 if not WORD.search(row[1] or "") else mixed.count(row) <= 2
    assert set(mixed) <= set(rows)
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert clean.columns == list(corpus_pipeline.COLUMNS) and clean.filter("doc_id is null").count() == 2


def test_pipeline(spark, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    left = docs
    sets = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, folder).cache()
        assert left.columns == docs.columns
        sets.append([r.doc_id for r in left.select("doc_id").collect()])
    after = [(i, t) for i, t in texts if i in set(sets[1])]
    near = classes(after)
    assert sorted(sets[2]) == sorted(i for i in near if near[i] == i)
    assert set(sets[3]) <= set(sets[2])
    coded = corpus_pipeline.STAGES[-1][1](spark, left, folder)
    assert coded.count() == len(sets[3])
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.count() == 0
