"""Exact copies, spelling variants and whitening against brute force, and on awkward input."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from ringsift.llm import exactdup, spelling, whitening

DOCS = "doc_id bigint, text string, text_sha256 string, word string, place bigint"
LOWER = {i: i + 32 for i in range(65, 91)}


def rows_of(texts, ids=None):
    return [(i if ids is None else ids[i], t, "x", "y", 0) for i, t in enumerate(texts)]


def lowered(text):
    return (text or "").translate(LOWER)


# Exact copies


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 70000])
def test_golomb_codes_come_back(n):
    rng = np.random.default_rng(n)
    for span in (n, 1 << 20, 1 << 48):
        if span >= n:
            values = np.unique(rng.integers(0, span, n))
            k, code = exactdup.encode(values, span)
            assert (exactdup.decode(k, len(values), code) == values).all()
            # Golomb codes of evenly spread numbers take little more than the entropy of the gaps.
            assert len(code) * 8 <= len(values) * (np.log2(span / len(values)) + 2.5) + 64 + 8


def test_copies_are_found_in_any_task(spark):
    long = "Word é " * 700_000  # more than a block
    texts = ["a", "A", "b", None, "", " a", "É", "é", long, long.upper().replace("É", "é"), *["same text"] * 500, *[f"t{i}" for i in range(300)]]
    rows = rows_of(texts)
    rows += [rows[2], rows[2], (None, "a", "x", "y", 0), (None, "none has an id", "x", "y", 0), (None, "none has an id", "x", "y", 0), (2, "other text of two", "x", "y", 0)]
    got = exactdup.groups(spark.createDataFrame(rows, DOCS).repartition(7)).collect()
    ids = collections.defaultdict(list)
    for d, t, *_ in rows:
        ids[lowered(t)].append(d)

    def keep(x):
        return max((d for d in x if d is not None), default=None)

    want = collections.Counter((d, keep(ids[lowered(t)]), len(ids[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for d, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert len(kept) == len(ids) and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_copies_go_and_the_rest_stays(spark):
    docs = spark.createDataFrame(rows_of(["a", "A", "b", None, ""]) + [(2, "c", "x", "y", 0)], DOCS)
    left = exactdup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, "A"), (2, "b"), (2, "c"), (4, "")]
    none = spark.createDataFrame([], DOCS)
    assert exactdup.groups(none).count() == 0 and exactdup.drop_copies(none).count() == 0


def test_chance_fingerprints_are_no_copies(spark):
    docs = spark.createDataFrame(rows_of([f"text {i // 2}" for i in range(400)]), DOCS).repartition(3)
    got = exactdup.groups(docs, width=6).collect()
    assert len(got) == 400 and all(r.group_size == 2 and r.keep_id == r.doc_id | 1 for r in got)


def test_senders_of_few_rows(spark):
    docs = spark.createDataFrame(rows_of([f"text {i % 150}" for i in range(400)]), DOCS).repartition(3)
    sent = exactdup._sent(docs, 1 << 46, most=16).collect()
    assert len({r.sender for r in sent}) >= 25 and sum(len(r.ids) for r in sent) == 400
    assert collections.Counter(r.group_size for r in exactdup.groups(docs, sender_rows=16).collect()) == {3: 300, 2: 100}


# Spelling variants


def words_of(rows):
    n = collections.Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 5
    return {w: c for w, c in n.items() if c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), None if form[w] is None else n[form[w]]) for w in n}


def test_variants_match_all_pairs(spark):
    rng = np.random.default_rng(5)
    letters = list("abé")
    texts = [" ".join("".join(rng.choice(letters, rng.integers(4, 8))) for _ in range(120)) for _ in range(60)]
    texts += ["Strasse STRASSE strasse Straße × ÀÉÎõü àéîõü ÀÉÎÕÜ " * 3, "aaaaa aaaaaa aaaaaaa " * 5, None, "", "12 ab", "überİstanbul ŸŸŸŸŸŸŸ Kelvin " * 4, "x" * 70_000 + " " + "y" + "x" * 70_000]
    texts += [texts[-1]] * 3 + [" ".join(["grammar"] * 40 + ["gramar"] * 15 + ["gramr"] * 4)]
    rows = rows_of(texts) + [(None, "grammar gramma " * 3, "x", "y", 0)]
    got = spelling.variants(spark.createDataFrame(rows, DOCS)).collect()
    want = brute_variants(words_of(rows))
    assert len(want) > 200 and sum(f is not None for f, *_ in want.values()) > 20
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0


def test_every_edit_is_found(spark):
    rng = np.random.default_rng(6)
    base = ["".join(rng.choice(list("abcdefgh"), rng.integers(5, 12))) for _ in range(150)]
    made = set(base)
    for w in base:
        for i in range(len(w) + 1):
            made |= {w[:i] + c + w[i:] for c in "az"} | ({w[:i] + "z" + w[i + 1 :]} if i < len(w) else set())
            if len(w) > 5 and i < len(w):
                made.add(w[:i] + w[i + 1 :])
    vocabulary = spark.createDataFrame([(w, 3, i) for i, w in enumerate(sorted(made))], "word string, n bigint, id bigint")
    pairs = spelling.near_words(vocabulary).collect()
    want = set()
    by_cut = collections.defaultdict(set)
    for w in made:
        by_cut[w].add(w)
        for i in range(len(w)):
            by_cut[w[:i] + w[i + 1 :]].add(w)
            by_cut[(w[:i], w[i + 1 :])].add(w)
    for group in by_cut.values():
        want |= {(a, b) for a in group for b in group if a < b and one_edit(a, b)}
    assert {(r.a, r.b) for r in pairs} == want and len(pairs) == len(want)


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """The keys of a word weigh many times what Spark takes them for, so no plan may send them to the driver."""
    plans, keep = [], spelling.stored

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(spelling, "stored", seen)
    rows = rows_of([" ".join(["grammar"] * 40 + ["gramar"] * 15 + ["gramr"] * 4)])
    out = spelling.variants(spark.createDataFrame(rows, DOCS))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r.word: r.root for r in out.collect()} == dict.fromkeys(["grammar", "gramar", "gramr"], "grammar")
    assert sum(p.count("SortMergeJoin") for p in plans) >= 6 and not any("Broadcast" in p for p in plans)


def test_pivots_do_not_overlap_and_cost_least():
    rng = np.random.default_rng(7)
    place = np.sort(np.array([rng.choice(9, 3, replace=False) for _ in range(500)]), axis=1)
    cost = rng.integers(1, 50, place.shape).astype(float)
    for p, c, got in zip(place, cost, spelling.pivots(place, cost)):
        pairs = [(i, j) for i in range(3) for j in range(i + 1, 3) if p[j] - p[i] >= 2]
        assert tuple(got) in pairs and c[got].sum() == min(c[list(x)].sum() for x in pairs)


# Whitening

VECTORS = "vec_id bigint, embedding array<float>, label int, n int"


@pytest.mark.parametrize("d", [1, 2, 3, 8, 40])
def test_components_are_eigenvectors(d):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, d))
    for m in (a @ a.T, np.eye(d), np.diag(np.arange(d) // 3 + 1.0), np.ones((d, d)), np.zeros((d, d)), 1e12 * a @ a.T, np.kron(np.eye(-(-d // 2)), [[2, 1], [1, 2]])[:d, :d]):
        values, axes = whitening.components(m)
        true = np.linalg.eigvalsh(m)[::-1][: len(values)]
        size = max(1.0, np.abs(m).max())
        assert len(values) == min(4, d) and np.abs(values - true).max() < 1e-12 * size * d
        assert np.abs(axes @ axes.T - np.eye(len(values))).max() < 1e-12
        assert np.abs(m @ axes.T - axes.T * values).max() < 1e-11 * size


def test_sturm_counts():
    rng = np.random.default_rng(1)
    diagonal, off = rng.standard_normal(30), rng.standard_normal(29)
    true = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    x = np.linspace(-4, 4, 101)
    assert (whitening.sturm(diagonal, off, x) == (true[:, None] < x).sum(axis=0)).all()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    data = (rng.standard_normal((400, 6)) @ rng.standard_normal((6, 6)) + [0, 3, -2, 0.5, 100, -40]).astype(np.float32)
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(data)]
    rows += [(1000 + i, rows[0][1], 0, 1) for i in range(300)] + [rows[1], (None, rows[2][1], None, None)]
    odd = [(1, None, 0, 0), (2, [], 0, 0), (3, [1.0, None, 0, 0, 0, 0], 0, 0), (4, [float("nan")] * 6, 0, 0), (5, [float("inf")] * 6, 0, 0), (6, [1.0, 2.0], 0, 0), (7, [3e38] * 6, 0, 0)]
    odd = [(i, None if v is None else [None if c is None else float(c) for c in v], a, b) for i, v, a, b in odd]
    got = whitening.whiten(spark.createDataFrame(rows + odd, VECTORS).repartition(5)).collect()
    x = np.floor(256 * np.array([r[1] for r in rows], dtype=np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    white = (x - s / n) @ axes / np.sqrt(values)
    by = collections.defaultdict(list)
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / np.cov(fit.T, bias=True).trace()) < 1e-12
        by[r.component].append((r.vec_id is None, r.vec_id or 0, r.deviation, r.whitened))
    ids = [(r[0] is None, r[0] or 0) for r in rows]
    deviation = ((n * x - s) ** 2).sum(axis=1)
    assert sorted(by) == [1, 2, 3, 4]
    for c, found in by.items():
        want = sorted((*i, int(d), float(w)) for i, d, w in zip(ids, deviation, white[:, c - 1]))
        found = sorted(found)
        assert [f[:3] for f in found] == [w[:3] for w in want]
        a, b = np.array([f[3] for f in found]), np.array([w[3] for w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9


def test_whitening_without_spread(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, 0)] * 3, VECTORS)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 0, 0) for i in range(10)], VECTORS)
    got = whitening.whiten(line).collect()
    assert {r.component for r in got} == {1} and len(got) == 10 and abs(got[0].explained - 1) < 1e-12


def test_deviation_beyond_int64_arithmetic(spark):
    rows = [(i, [float(2**29 * (i % 2)), float(i)], 0, 0) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.component for r in got} == {1} and len(got) == 6 and all(r.deviation is None for r in got)


# Clashing columns, ties, deep pages, shingle sizes


def test_mixture_with_clashing_columns_and_ties(spark):
    from ringsift.llm import mixing

    names = ["n", "q", "a", "slots", "stop", "_source", "_r", "_cell", "_rank", "_start", "_p"]
    docs = spark.createDataFrame([(i // 3, f"t{i % 2}", ["x", "y", None][i % 3], *[i] * len(names)) for i in range(90)], "doc_id int, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    got = mixing.mix(docs, {"x": 2, "y": 1, None: 1}, block_rows=2)
    assert got.columns[: len(docs.columns)] == docs.columns
    first = got.filter("epoch = 0")
    assert sorted(map(str, first.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    again = mixing.mix(docs.repartition(5), {"x": 2, "y": 1, None: 1}, block_rows=2)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_deep_pages_take_linear_work():
    from ringsift.llm import mainpage

    body = "<article><h1>Head</h1><p>First part, of some length, with marks in it.</p></article>"
    assert mainpage.extract("<div>" * 100_000 + body) == "Head First part, of some length, with marks in it."
    assert mainpage.extract("</b></div>" * 100_000 + body) == "Head First part, of some length, with marks in it."
    assert mainpage.extract("<b>" * 50_000 + "<p>a</p>" * 50_000).count("a") == 50_000


def test_shingle_size_is_a_parameter(spark):
    from ringsift.llm import neardup

    words = [f"w{i}" for i in range(60)]
    near = words[:20] + ["x"] + words[21:40] + words[40:]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "a b c d"), (4, "a b c d")], "doc_id bigint, text string")
    four = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(docs, size=4).collect()}
    five = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(docs).collect()}
    # 53 of 61 four-word and 51 of 61 five-word shingles are shared.
    assert four == {1: (57, 1), 2: (57, 1), 3: (1, 3), 4: (1, 3)}
    assert five == {1: (56, 1), 2: (56, 1), 3: (1, 3), 4: (1, 3)}


def earliest_deadline_first(weights, slots):
    """Which source goes in each slot, one slot after the other; ties go by weight, then by name."""
    total, done, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(slots):
        ready = [((-(-(done[s] + 1) * total // w)), w, s) for s, w in weights.items() if done[s] * total // w <= t]
        out.append(min(ready)[2])
        done[out[-1]] += 1
    return out


def placed(spark, weights, counts, block_rows=1):
    from ringsift.llm import mixing

    rows = [(i, s) for s, n in counts.items() for i in range(n)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string"), weights, block_rows=block_rows).select("source", "slot", "epoch", "position").collect()
    assert sorted(r.position for r in got) == list(range(len(got)))
    assert collections.Counter(r.source for r in got if r.epoch == 0) == {s: n for s, n in counts.items() if weights.get(s, 0) > 0}
    return [r.source for r in sorted(got, key=lambda r: r.position)[::block_rows]]


def test_mixture_is_that_of_earliest_deadlines(spark):
    for weights in ({"a": 1, "b": 1, "c": 1}, {"a": 7, "b": 5, "c": 1, "d": 5, "e": 3}, {"a": 1, "b": 0, "c": 1499}):
        order = placed(spark, weights, {s: 5 for s in weights})
        kept = {s: w for s, w in weights.items() if w}
        assert order == earliest_deadline_first(kept, len(order))


def test_mixture_lags_less_than_one_block_behind_given_weights(spark):
    from fractions import Fraction

    small = {f"s{i}": Fraction(2, 3 * 200) for i in range(200)}
    weights = {"big": Fraction(1, 3), **small, "never": 0}
    order = placed(spark, weights, {"big": 600, **{s: 4 for s in small}, "never": 3}, block_rows=2)
    done = collections.Counter()
    for t, s in enumerate(order, 1):
        done[s] += 1
        assert abs(done["big"] - t * weights["big"]) < 1
        if t % 50 == 0:
            assert all(abs(done[x] - t * w) < 1 for x, w in weights.items())
    assert done["never"] == 0


def test_mixture_of_ten_thousand_sources(spark):
    weights = {"big": 5000, **{f"s{i}": 1 for i in range(9999)}}
    order = placed(spark, weights, {s: 1 for s in weights} | {"big": 40})
    total, done = sum(weights.values()), collections.Counter()
    for t, s in enumerate(order, 1):
        done[s] += 1
        assert abs(done["big"] * total - t * weights["big"]) < total
    assert all(abs(done[s] * total - len(order) * w) < total for s, w in weights.items())


def test_weights_of_a_mixture():
    from ringsift.llm import mixing

    assert mixing.whole_weights({"a": 0.1, "b": 0.25, None: 2}) == {"a": 2, "b": 5, None: 40}
    for bad in ({"a": -1}, {"a": 1e-9, "b": 1}):
        with pytest.raises(ValueError):
            mixing.whole_weights(bad)


# Secrets


def test_findings_of_any_length_behind_keywords(spark):
    from ringsift.llm import secrets

    texts = ['say password: hunter2, and aws_secret_access_key="k9" now', 'api_key = "0123456789abcdef0123" end', "see token now", "", None,
             "f(x)=12 and a/long/path-of/letters here", "bearer=x1 " * 3 + "end"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[0], 1)] * 2, "doc_id bigint, text string, value int")
    got = [(r.doc_id, r.ordinal, r.value, r.copies) for r in secrets.findings(docs).collect()]
    first = [(0, "hunter2"), (1, "aws_secret_access_key"), (2, "k9")]
    want = [(0, o, v, 1) for o, v in first] + [(None, o, v, 2) for o, v in first]
    want += [(1, 0, "0123456789abcdef0123", 1), (5, 0, "a/long/path-of/letters", 1)] + [(6, i, "x1", 1) for i in range(3)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_features_of_findings_by_hand(spark):
    from ringsift.llm import secrets

    docs = spark.createDataFrame([(1, "known word here"), (2, "known word of old"), (3, 'my x="https://a.com/KnownWord99/zq" 12 after')], "doc_id bigint, text string")
    found = secrets.features(secrets.findings(docs), secrets.dictionary(docs)).collect()
    assert [(r.value, r.length, r.coverage, r.path_depth, r.address) for r in found] == [("com/KnownWord99/zq", 18.0, 9 / 18, 4.0, 1.0)]
    kinds = re.sub("[^aA0]", "_", re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", found[0].value.replace("a", "b")))))
    changes = sum(x != y for x, y in zip(kinds, kinds[1:]))
    assert found[0].transitions == changes / 17 and found[0].digit_share == 2 / 18 and found[0].distinct_share == len(set(found[0].value)) / 18


def test_forest_decides_on_what_no_rule_labels(spark):
    from ringsift.llm import secrets

    rng = np.random.default_rng(5)
    word = lambda n, k="erionthaed": "".join(rng.choice(list(k), n))
    key = lambda: word(32, "0123456789abcdefGHJKLM")
    words = [word(int(n)) for n in rng.integers(4, 10, 60)]
    some = lambda n: [str(x) for x in rng.choice(words, n)]
    planted, rows = {}, []
    for i in range(600):
        # Keys with and without a keyword; words, numbers and paths; paths with a digit, which no rule knows.
        kind = i % 6
        value = [key(), key(), word(20), word(17, "0123456789"), "/".join(some(5)), "/".join(some(5)) + "/v1"][kind]
        planted[hashlib.sha256(value.encode()).hexdigest()] = kind
        rows.append((i, " ".join([*some(2), *(["token", "="] if kind == 0 else []), value, *some(2)])))
    got = [r for r in secrets.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if r.value_sha256 in planted]
    assert len(got) == 600
    left = [(planted[r.value_sha256], r.is_secret) for r in got if r.label is None]
    kinds = collections.Counter(k for k, _ in left)
    assert 30 < kinds[0] < 70 and kinds[1] == kinds[5] == 100 and len(kinds) == 3
    hits = sum(k < 2 and said for k, said in left)
    assert hits / sum(said for _, said in left) > 0.95 and hits / sum(k < 2 for k, _ in left) > 0.95


def test_judged_findings_go_first(spark):
    from ringsift.llm import secrets

    docs = spark.createDataFrame([(i, f"see {'abcdefgh' * 2}{i:03d} and {'z1' * 10}{i:03d} here") for i in range(60)], "doc_id bigint, text string")
    sha = lambda v: hashlib.sha256(v.encode()).hexdigest()
    judged = [(sha(f"{'abcdefgh' * 2}{i:03d}"), 0) for i in range(30)] + [(sha(f"{'z1' * 10}{i:03d}"), 1) for i in range(30)]
    got = secrets.score(docs, spark.createDataFrame(judged, "value_sha256 string, label int")).collect()
    assert len(got) == 120 and sum(r.label is None for r in got) == 60
    assert all(r.is_secret == (r.ordinal == 1) for r in got)
