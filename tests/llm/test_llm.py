"""The training-data operators against brute force, and their corner cases."""

import hashlib
import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from quayside.llm import (
    buckets,
    chat,
    common,
    components,
    cube,
    idcoder,
    lattice,
    oddsketch,
    phrases,
    pstable,
    queries,
    ranklang,
    repeats,
    urlfilter,
)

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Null and empty texts, white space only, copies, a long text, texts without letters, names that clash.
ODD = [
    (9001, None, "en", "a"),
    (9002, "", None, None),
    (9003, " \t\r\n\x0b\x0c ", "en", "a"),
    (9004, "One two three four five six seven", "en", None),
    (9005, "one TWO three four five six seven", "en", "b"),
    (9006, "1234 !!! ... 99", "de", "b"),
    (9007, "word " * 30_000, "en", "a"),
    (9008, "\u0130stanbul \u00e9t\u00e9 <|endoftext|> it's a\u00a0b \U00010400", "fr", "b"),
    (9009, "x", "en", "c"),
    (None, "a row without an id", "en", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, len(r[1] or ""), "clash", 1) for r in ODD]
    return spark.createDataFrame(rows, SCHEMA + ", n_chars bigint, score string, row int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", lower(text))


@pytest.mark.parametrize("name", sorted(queries.oracle()))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.registered()[name](spark, SF)
    columns = sorted(got.columns)
    rows = duck.execute(queries.oracle()[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in rows.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(expected, key=repr)


# --- words ------------------------------------------------------------------------------------


def test_words_are_runs_of_other_bytes():
    cases = ["", " a  B\tc\x0bd ", None, "\u00c9t\u00c9 X", "no-break\u00a0space", "\x1c\x85"]
    found, rows = common.split_words(pa.array(cases, pa.string()))
    got = [[w.decode() for w in found[int(a) : int(b)].to_pylist()] for a, b in zip(rows[:-1], rows[1:], strict=True)]
    assert got == [words(c or "") for c in cases]


def test_words_never_cross_rows_and_slices_keep_rows_whole():
    array = pa.array(["ab", "cd", "", "ef gh"])
    found, rows = common.split_words(array.slice(1))
    assert found.to_pylist() == [b"cd", b"ef", b"gh"] and rows.tolist() == [0, 1, 1, 3]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 9, "y" * 50, None, "z"])], ["text"])
    assert [len(s) for s in common.slices([batch], limit=10)] == [1, 1, 2]


def test_shingles_stop_at_rows_and_short_rows_are_one():
    codes, distinct, rows = common.encoded_words(pa.array(["a b c d e", "a b", "b a", None, "a b c d"]))
    hashes, starts = common.shingle_hashes(codes, distinct, rows, 4)
    assert np.diff(starts).tolist() == [2, 1, 1, 0, 1]
    assert hashes[0] == hashes[starts[4]] and hashes[2] != hashes[3]


# --- buckets and components -------------------------------------------------------------------


def test_every_pair_of_a_bucket_meets_once(spark, monkeypatch):
    monkeypatch.setattr(buckets, "PART", 7)
    members = spark.range(40).select((F.col("id") % 3).alias("key"), F.col("id").alias("node"))
    seen = Counter()
    rows = buckets.in_cells(buckets.cells(members, ["key"], "node"), ["key"]).toArrow()
    for batch, starts in buckets.whole_groups(rows.to_batches(max_chunksize=5), ["cell", "key", "low", "high"]):
        node, part = batch.column("node").to_numpy(), batch.column("part").to_numpy()
        same = batch.column("low").to_numpy() == batch.column("high").to_numpy()
        for a, b in buckets.pairs_within(starts, 10):
            keep = same[a] | (part[a] != part[b])
            seen.update(tuple(sorted(p)) for p in zip(node[a[keep]].tolist(), node[b[keep]].tolist(), strict=True))
    expected = {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 3 == b % 3}
    assert set(seen) == expected and set(seen.values()) == {1}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (3, 4), (4, 3), (9, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]} | {3: 3, 4: 3, 9: 3}
    assert got == expected
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- 1 lattice --------------------------------------------------------------------------------

TINY = '{"model": {"vocab": {"a": 0, "b</w>": 1, "ab</w>": 2, "aa": 3, "c</w>": 4, "!": 5, "ok": 6}}}'


def segmentations(word, pieces):
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        if (word[:n], n == len(word)) in pieces:
            for rest in segmentations(word[n:], pieces):
                yield ((word[:n], n == len(word)), *rest)


def test_forward_recursion_sums_all_segmentations():
    pieces = lattice.piece_bytes(TINY)
    trie = lattice.Trie(pieces)
    scores = np.log(np.random.default_rng(1).dirichlet(np.ones(trie.size)))
    number = {p: k for k, p in enumerate(pieces)}
    listed = [b"ab", b"aab", b"aaaab", b"c", "\u00e9".encode(), b"a" * 40]
    expected_uses = np.zeros(trie.size)
    got, uses = {}, np.zeros(trie.size)
    array = pa.array(listed, pa.binary())
    for some, rows in lattice.by_length(array):
        for k, v in zip(some, lattice.forward(trie, scores, rows, np.ones(len(some)), uses), strict=True):
            got[listed[k]] = v
    for word in listed[:5]:
        paths = [(sum(scores[number[p]] for p in s), s) for s in segmentations(word, number)]
        total = np.logaddexp.reduce([w for w, _ in paths])
        assert math.isclose(got[word], total, rel_tol=1e-9)
    assert np.isfinite(got[b"a" * 40])
    for word in listed:
        paths = [(sum(scores[number[p]] for p in s), s) for s in segmentations(word, number)] if len(word) < 20 else []
        for w, s in paths:
            for p in s:
                expected_uses[number[p]] += math.exp(w - got[word])
    short = np.zeros(trie.size)
    for some, rows in lattice.by_length(array.slice(0, 5)):
        lattice.forward(trie, scores, rows, np.ones(len(some)), short)
    assert np.allclose(short, expected_uses)


@pytest.mark.parametrize("starts", [1, 7, 1 << 16])
def test_long_words_have_the_sums_of_short_ones(monkeypatch, starts):
    trie = lattice.Trie(lattice.piece_bytes(TINY))
    scores = np.log(np.random.default_rng(3).dirichlet(np.ones(trie.size)))
    for n in (1, 2, trie.longest, trie.longest + 1, 500):
        word = np.frombuffer((b"abab" * n)[: n - 1] + b"e", np.uint8).reshape(1, -1)
        monkeypatch.setattr(lattice, "LONG_WORD", 1_024)
        uses, long_uses = np.zeros(trie.size), np.zeros(trie.size)
        expected = lattice.forward(trie, scores, word, np.ones(1), uses)
        monkeypatch.setattr(lattice, "LONG_WORD", 0)
        monkeypatch.setattr(lattice, "STARTS", starts)
        assert np.allclose(lattice.forward(trie, scores, word, np.ones(1), long_uses), expected, rtol=1e-12)
        assert np.allclose(lattice.forward(trie, scores, word), expected, rtol=1e-12) and np.allclose(uses, long_uses)


def model_scores(rows, trie, scores, modulus):
    """Each text's log10 probability: pieces summed over all ways by recursion on prefixes, words one by one."""
    number = {}
    for k, piece in enumerate(lattice.piece_bytes(TINY)):
        number[piece] = k

    def pieces_sum(word):
        upto = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                k = number.get((word[start:end], end == len(word)))
                if k is not None:
                    upto[end] += upto[start] * math.exp(scores[k])
        return upto[-1]

    train = Counter()
    for d, t in rows.items():
        if zlib.crc32(str(d).encode()) % modulus != 2:
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    for d, t in rows.items():
        total = math.log10((train[None] - lattice.DISCOUNT) / n)
        for w in words(t):
            whole = max(train[w] - lattice.DISCOUNT, 0) / n
            raw = w if isinstance(w, bytes) else w.encode()
            total += math.log10(whole + pieces_sum(raw) * lattice.DISCOUNT * v / n)
        yield d, total


def test_scores_against_brute_force(spark):
    rows = {i: " ".join(["ab", "abc", "cab", "b" * (i % 4 + 1), f"w{i}", "é"][: i % 7]) for i in range(40)}
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    trie = lattice.Trie(lattice.piece_bytes(TINY))
    equal = np.full(trie.size, -np.log(trie.size))
    got = {r.doc_id: r.score for r in lattice.score_documents(frame, TINY, queries.kept_out(7), rounds=0).collect()}
    for d, expected in model_scores(rows, trie, equal, 7):
        assert math.isclose(got[d], expected, rel_tol=1e-9), d


def test_probabilities_of_all_words_add_up_to_one_at_most():
    trie = lattice.Trie([(b"a", False), (b"a", True), (b"b", False), (b"b", True), (b"ab", True), (b"ba", False)])
    scores = np.log(np.full(trie.size, 1 / trie.size))
    total = 0.0
    for n in range(1, 12):
        rows = np.array([[97 + (k >> i & 1) for i in range(n)] for k in range(2**n)])
        total += np.exp(lattice.forward(trie, scores, rows)).sum()
    assert 0.5 < total <= 1 + 1e-9


def base_model(rows, modulus):
    train = Counter()
    held = {d: zlib.crc32(str(d if d is not None else "").encode()) % modulus == 2 for d in rows}
    for d, t in rows.items():
        if not held[d]:
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    for d, t in rows.items():
        tokens = [*words(t), None]
        yield d, held[d], len(tokens), sum(train[w] > 0 for w in tokens), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens)


@pytest.mark.parametrize("frequent", [0, 50, 65_536])
def test_scores_of_documents(spark, docs, odd, frequent):
    both = docs.select("doc_id", "text").where("doc_id < 60").union(odd.select("doc_id", "text"))
    got = lattice.score_documents(both, TINY, queries.kept_out(7), rounds=1, frequent=frequent).collect()
    rows = {r.doc_id: r for r in got}
    expected = list(base_model(texts(both), 7))
    assert len(got) == len(expected)
    for d, held, n, known, tokens, base in expected:
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, tokens)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0 and math.isfinite(r.score)


def test_more_training_text_makes_its_own_words_likelier(spark):
    rows = [(i, "alpha beta gamma") for i in range(30)] + [(100 + i, f"w{i}") for i in range(30)]
    got = lattice.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), TINY, "doc_id <> 5").collect()
    score = {r.doc_id: r.score / r.n_tokens for r in got}
    assert score[5] > score[101]


def test_nothing_to_score_or_to_learn_from(spark, empty):
    assert lattice.score_documents(empty, TINY, "true").collect() == []
    only = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lattice.score_documents(only, TINY, "false").first()
    assert (r.held_out, r.n_known, r.train_tokens) == (True, 0, 0) and math.isfinite(r.score) and r.base_score == 0


# --- 2 vectors --------------------------------------------------------------------------------


def linked_vectors(rows, threshold=0.93):
    good = []
    for k, (vec, v, label) in enumerate(rows):
        if vec is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v, float) / max(abs(x) for x in v)
            good.append((k, label, u / np.linalg.norm(u)))
    links = {k: set() for k in range(len(rows))}
    for i, (a, la, x) in enumerate(good):
        for b, lb, y in good[i + 1 :]:
            if la == lb and len(x) == len(y) and float(x @ y) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[i][0] for i in seen]
        out.append((rows[k][0], len(links[k]), min(ids) if None not in ids else rows[k][0]))
    return out


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(buckets, "PART", 16)
    draw = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = draw.standard_normal(16)
        for _ in range(12):
            rows.append((len(rows), (centre + draw.standard_normal(16) * draw.choice([0.02, 0.15, 0.3])).tolist(), int(c % 3)))
    rows += [(len(rows) + i, [1.0] * 16, 1) for i in range(40)]
    rows += [(900, [2.0] * 16, 1), (901, [1.0] * 16, 2), (902, [1.0] * 15, 1), (903, [0.0] * 16, 1), (904, None, 1)]
    rows += [(905, [1.0] * 16, None), (906, [math.nan] * 16, 1), (907, [1.0, None] * 8, 1), (908, [math.inf] * 16, 1)]
    rows += [(909, [], 1), (910, [1e300] * 16, 1), (911, [-0.0] + [1.0] * 15, 2), (912, [0.0] + [1.0] * 15, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pstable.near_vectors(frame).collect()}
    expected = {v: (n, c, v == c) for v, n, c in linked_vectors(rows)}
    found, links = sum(g[0] for g in got.values()), sum(e[0] for e in expected.values())
    assert set(got) == set(expected) and found <= links and found >= 0.97 * links
    assert all(got[v][0] <= expected[v][0] for v in got)
    assert got[910][0] >= 40 and [got[v][0] for v in range(902, 910)] == [0] * 8 and got[911] == (2, 901, False)


def test_vectors_without_rows_or_ids(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert pstable.near_vectors(spark.createDataFrame([], kind)).collect() == []
    got = pstable.near_vectors(spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1)], kind)).collect()
    assert sorted((r.vec_id is None, r.n_links, r.kept) for r in got) == [(False, 1, True), (False, 1, True), (True, 0, True)]


# --- 3 mix ------------------------------------------------------------------------------------


def expected_targets(sizes, weights=(5, 2, 1)):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: weights[k % 3] for k, n in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [n for n in names if n not in fixed]
        if not rest:
            return fixed
        rate = (total - sum(fixed.values())) / sum(weight[n] for n in rest)
        over = [n for n in rest if weight[n] * rate >= 2 * sizes[n]]
        if not over:
            return fixed | {n: weight[n] * rate for n in rest}
        fixed |= {n: 2.0 * sizes[n] for n in over}


@pytest.mark.parametrize("block", [2_000, 9])
def test_mix_meets_its_targets(spark, docs, odd, block):
    both = docs.select("doc_id", "text", "source").union(odd.select("doc_id", "text", "source"))
    got = cube.mix(both, block=block).collect()
    sizes = Counter()
    for r in both.collect():
        sizes[r.source] += len(words(r.text or ""))
    targets = expected_targets(sizes)
    assert len(got) == both.count()
    taken = Counter()
    for r in got:
        assert r.size == len(words(texts_of(both)[r.doc_id])) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, targets[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        ratio = targets[r.source] / sizes[r.source]
        assert r.copies in (math.floor(ratio + 1e-9), math.ceil(ratio - 1e-9))
        taken[r.source] += r.taken
    largest = {s: max(r.size for r in got if r.source == s) for s in sizes}
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(3, largest[s] * 0.51), s
    again = {(r.doc_id, r.source): r.taken for r in cube.mix(both.repartition(3), block=block).collect()}
    assert again == {(r.doc_id, r.source): r.taken for r in got}


_texts: dict = {}


def texts_of(df):
    if id(df) not in _texts:
        _texts[id(df)] = texts(df)
    return _texts[id(df)]


def test_flight_keeps_both_totals():
    draw = np.random.default_rng(5)
    for n in (1, 2, 3, 200):
        size = draw.integers(0, 500, n)
        chance = draw.uniform(0.05, 0.95, n)
        flown = cube.fly(chance, size, draw.random(n))
        assert ((flown > 0) & (flown < 1)).sum() <= 2 and (flown >= 0).all() and (flown <= 1).all()
        assert math.isclose(flown.sum(), chance.sum(), abs_tol=1e-6)
        assert math.isclose((flown * size).sum(), (chance * size).sum(), abs_tol=1e-3)
    # Every document is included as often as it should be.
    size, chance = np.array([5, 5, 9, 2, 30, 7]), np.full(6, 0.4)
    mean = np.mean([cube.fly(chance, size, draw.random(6)) for _ in range(4000)], axis=0)
    assert np.allclose(mean, 0.4, atol=0.04)


def test_small_sources_land_well_beside_one_of_many_blocks(spark):
    """Every source lands in its own last round, and its largest document is made up for."""
    draw = np.random.default_rng(8)
    rows = []
    for source, n in (("big", 2_000), ("one", 150), ("two", 199), (None, 120)):
        size = np.minimum(draw.lognormal(5.5, 1.2, n).astype(int) + 1, 9_000)
        size[:2] = (20_000, 9_500)
        rows += [(source, len(rows) + k, int(z), 0, 0.43) for k, z in enumerate(size)]
    frame = spark.createDataFrame(rows, "source string, doc_id bigint, size bigint, copy int, chance double")
    got = cube.balanced(frame, block=200).collect()
    assert len(got) == len(rows) and {r.chance for r in got} == {0.0, 1.0}
    for source in {r[0] for r in rows}:
        wanted = sum(0.43 * r[2] for r in rows if r[0] == source)
        n = sum(0.43 for r in rows if r[0] == source)
        taken = [r.size for r in got if r.source == source and r.chance == 1]
        assert abs(sum(taken) - wanted) <= 8 and abs(len(taken) - n) <= 12, source


def test_mixed_documents_keep_their_columns(spark, odd, empty):
    got = cube.mixed_documents(odd)
    assert got.columns == odd.columns and cube.mixed_documents(empty).collect() == [] and cube.mix(empty).collect() == []


def test_repeated_rows_and_rows_without_an_id_meet_the_target(spark, monkeypatch):
    monkeypatch.setattr(cube, "LANE", 7)
    rows = [(None, "a b c", "en", "s")] * 100 + [(None, "d e f", "en", "s")] * 100 + [(7, "x", "en", "s")] * 9 + [(8, None, "en", "s")]
    frame = spark.createDataFrame(rows, SCHEMA)
    wanted = sum(r.taken for r in cube.mix(frame, share=0.55).collect())
    got = cube.mixed_documents(frame.repartition(3), share=0.55).collect()
    assert sum(len(words(r.text)) for r in got) == wanted and abs(wanted - 0.55 * 609) <= 3
    again = cube.mixed_documents(frame, share=1.6).collect()
    per_row = Counter((r.doc_id, r.text) for r in again)
    assert 100 <= per_row[(None, "a b c")] <= 200 and sum(len(words(r.text)) for r in again) == sum(
        r.taken for r in cube.mix(frame, share=1.6).collect()
    )


def test_equal_rows_and_sources_without_words(spark):
    rows = [(1, "a b c", "s", "en")] * 5 + [(2, "", "t", "en"), (3, None, None, "en")]
    frame = spark.createDataFrame([(d, t, lang, s) for d, t, s, lang in rows], SCHEMA)
    got = cube.mix(frame).collect()
    assert len(got) == 7 and sum(r.taken for r in got) in (21, 24) and {r.target for r in got if r.source != "s"} == {0.0}


# --- 4 urls -----------------------------------------------------------------------------------


def judged(rules, url):
    split = re.search("://([^/?#]*)([^?#]*)", url or "")
    host, path = (lower(split[1]), split[2]) if split else ("", "")
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_against_every_rule(spark):
    rules = [*queries.URL_RULES, ("org", "/a", "block"), ("org", "/a/b", "allow"), ("x.org", "", "block"), ("x.org", "", "allow")]
    rules += [(f"h{i}.net", f"/p{i}/", "block") for i in range(500)]
    urls = ["HTTP://WWW.Example.COM/en/1", "http://example.com/EN/", "http://a.b.example.com/en/", "http://net/es/", "://net/fr/x://y"]
    urls += [None, "", "no scheme", "http://", "http:///en/", "http://com", "http://com/", "http://xcom/", "http://q.org/a", "http://q.org/ab?/c"]
    urls += ["http://x.org", "http://y.x.org#/", "http://q.org/a/b", "http://u@x.org:80/", "http://example.com./en/", "a://b\n.com/\nx"]
    urls += [f"https://h{i}.net/p{j}/z" for i in range(0, 500, 7) for j in (i, i + 1)] + ["http://" + "a." * 60 + "com/" + "/" * 200]
    urls += ["http://" + "b." * 3000 + "example.com/en" + "/x" * 20000]
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls * 2)], "page_id long, url string, host string, html string")
    got = urlfilter.judge_urls(frame, spark.createDataFrame(rules, urlfilter.RULES))
    assert got.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict) == judged(rules, r.url), r.url
    none = urlfilter.judge_urls(frame, spark.createDataFrame([], urlfilter.RULES))
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}
    assert urlfilter.judge_urls(frame.where("false"), spark.createDataFrame(rules, urlfilter.RULES)).count() == 0


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(2000).select(F.concat(F.lit("in"), F.col("id").cast("string")).alias("key"))
    blocks = urlfilter.block_count(2000)
    bloom = urlfilter.bloom_blocks(keys, blocks)
    assert urlfilter.might_be_listed(keys, bloom, blocks).count() == 2000
    others = spark.range(20000).select(F.concat(F.lit("out"), F.col("id").cast("string")).alias("key"))
    assert urlfilter.might_be_listed(others, bloom, blocks).count() < 400


def test_url_plan_has_no_python(spark):
    got = queries.op4_url_rules(spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 5 ids ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer_json():
    return queries.vocabulary("word_bpe_49k.json")


def test_ids_are_the_tokenizers(docs, odd, tokenizer_json):
    from tokenizers import Tokenizer

    more = ["a|b", "\u00d7\u00f7", "it's we'll 'S", "\u00c9COLE d\u00e9j\u00e0-vu \u00df\u00ff", "e\u0301", "\u00a0x\u2003y", "12ab!?", "\u4e2d\u6587", "~\x7f\x01", "<|startoftext|>hi"]
    texts_ = [r.text or "" for r in docs.select("text").limit(60).collect()] + [r[1] or "" for r in ODD] + more
    whole = Tokenizer.from_str(tokenizer_json)
    mine = idcoder.WordTokenizer(tokenizer_json, 1)
    for _ in range(2):
        ids, n = mine(pa.array(texts_, pa.string()))
        assert np.split(ids, np.cumsum(n)[:-1])[-1][-1] == 1
        for t, got in zip(texts_, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert got.tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1], t


def test_a_process_learns_a_word_once(tokenizer_json, monkeypatch):
    """Before, each task built the tokenizer and encoded all its words anew."""
    texts_ = pa.array(["alpha beta beta", None, "gamma \u00e9|x"], pa.string())
    wanted = [a.tolist() for a in idcoder.WordTokenizer(tokenizer_json, 1)(texts_)]

    def never(*_):
        raise AssertionError("built or learned again")

    with monkeypatch.context() as m:
        m.setattr(idcoder.WordTokenizer, "_learn", never)
        m.setattr(idcoder.WordTokenizer, "_tools", never)
        assert [a.tolist() for a in idcoder.WordTokenizer(tokenizer_json, 1)(texts_)] == wanted
    monkeypatch.setattr(idcoder, "KEPT_WORDS", 3)
    sys.modules.pop("quayside_kept_words")
    mine = idcoder.WordTokenizer(tokenizer_json, 1)
    for row in ["a b", "a b", "c d e", "a b c d e f g h", "", "a c"]:
        got, n = mine(pa.array([row, row]))
        assert got.tolist() == 2 * [*mine.tokenizer.encode(row, add_special_tokens=False).ids, 1] and n.sum() == len(got)
        assert len(mine.words) <= 3
    sys.modules.pop("quayside_kept_words")


@pytest.mark.parametrize("ids", [
    [], [5], [7] * 5000, list(range(3000)), [2**32 - 1, 0, 2**31], [1, 2, 3, 4] * 2000,
    np.random.default_rng(1).zipf(1.2, 20_000) % 49_000, np.random.default_rng(2).integers(0, 2**20, 5000),
], ids=lambda v: str(len(v)))
def test_ids_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert np.array_equal(idcoder.decode_ids(idcoder.encode_ids(ids)), ids)


def test_models_learn_repeats_and_frequencies():
    draw = np.random.default_rng(4)
    skewed = (draw.zipf(1.3, 50_000) % 40_000).astype(np.uint32)
    assert len(idcoder.encode_ids(skewed)) < 0.7 * 2 * len(skewed)
    assert len(idcoder.encode_ids(np.tile(draw.integers(0, 9000, 50), 1000).astype(np.uint32))) < 0.1 * 2 * 50_000


def test_damage_is_found():
    ids = (np.random.default_rng(4).zipf(1.3, 9000) % 40_000).astype(np.uint32)
    data = idcoder.encode_ids(ids)
    for at in (0, 20, len(data) // 2, len(data) - 6):
        broken = bytearray(data)
        broken[at] ^= 0x55
        with pytest.raises(ValueError):
            idcoder.decode_ids(bytes(broken))


def test_damage_is_found_to_the_last_byte():
    """Before, a block's last bytes could be changed and it still decoded to its ids."""
    for n in (1, 700, 3001):
        data = idcoder.encode_ids((np.random.default_rng(n).zipf(1.3, n) % 40_000).astype(np.uint32))
        for at in range(len(data) - 8, len(data)):
            for bits in (0x01, 0x55, 0x80):
                broken = bytearray(data)
                broken[at] ^= bits
                with pytest.raises(ValueError):
                    idcoder.decode_ids(bytes(broken))


def test_blocks_of_two_lengths_round_trip():
    """Blocks advance together; some end a step before others, and only some are left in the last step."""
    draw = np.random.default_rng(6)
    for n in (1025, 2047, 2049, 4095, 5000):
        ids = (draw.zipf(1.1, n) % 3000).astype(np.uint32)
        assert np.array_equal(idcoder.decode_ids(idcoder.encode_ids(ids)), ids)


@pytest.mark.parametrize("lanes", [4096, 7])
def test_segments_advance_together_and_keep_their_bytes(monkeypatch, lanes):
    """Before, each segment was coded for itself, in as many steps for a few blocks as for thousands."""
    draw = np.random.default_rng(8)
    segments = [np.zeros(0), np.array([5]), draw.zipf(1.2, 9000) % 40_000, np.full(2500, 7), draw.integers(0, 2**32, 1500), draw.zipf(1.5, 1023)]
    segments = [x.astype(np.uint32) for x in segments]
    alone = [idcoder.encode_ids(x) for x in segments]
    monkeypatch.setattr(idcoder, "LANES", lanes)
    coded, runs = idcoder._encode_blocks, []
    monkeypatch.setattr(idcoder, "_encode_blocks", lambda *a: runs.append(len(a[1])) or coded(*a))
    assert idcoder.encode_segments(segments) == alone
    assert max(runs) <= lanes and sum(runs) == 16 and len(runs) == (1 if lanes > 16 else 3)
    for got, ids in zip(idcoder.decode_segments(alone), segments, strict=True):
        assert np.array_equal(got, ids)
    assert idcoder.encode_segments([]) == [] and idcoder.decode_segments([]) == []
    groups = list(idcoder.full_groups([9000, 9000, 1, 2**23, 5, lanes * 1024 - 5, 1], int))
    assert sum(groups, []) == [9000, 9000, 1, 2**23, 5, lanes * 1024 - 5, 1]
    assert all(len(g) == 1 or sum(g) <= lanes * 1024 for g in groups) and groups[-2:] == [[5, lanes * 1024 - 5], [1]]


def test_words_that_differ_in_case_and_signs_are_learned_once(tokenizer_json, monkeypatch):
    """Before, each spelling of a word was encoded for itself."""
    from tokenizers import Tokenizer

    sys.modules.pop("quayside_kept_words", None)
    mine, learned = idcoder.WordTokenizer(tokenizer_json, 1), []
    learn = idcoder.WordTokenizer._learn
    monkeypatch.setattr(idcoder.WordTokenizer, "_learn", lambda self, words: learned.extend(words.to_pylist()) or learn(self, words))
    rows = ["alpha Alpha, ALPHA. (alpha) alpha-\u00c9t\u00e9 \u00e9t\u00c9!", "alpha2alpha", None, "Don't alpha's Don't", "x|Y <|ENDOFTEXT|> <|endoftext|>"]
    got, n = mine(pa.array(rows, pa.string()))
    parts = ["alpha", ",", ".", "(", ")", "-", "\u00e9t\u00e9", "!", "2", "Don't", "alpha's", "x|Y", "<|ENDOFTEXT|>", "<|endoftext|>"]
    assert sorted(learned) == sorted(p.encode() for p in parts)
    whole = Tokenizer.from_str(tokenizer_json)
    for row, ids in zip(rows, np.split(got, np.cumsum(n)[:-1]), strict=True):
        assert ids.tolist() == [*whole.encode(row or "", add_special_tokens=False).ids, 1]
    sys.modules.pop("quayside_kept_words")


def test_plain_bytes_are_split_as_the_tokenizer_splits_them(tokenizer_json):
    from tokenizers import Tokenizer

    draw, whole = np.random.default_rng(7), Tokenizer.from_str(tokenizer_json)
    letters = [*map(chr, range(0x20, 0x7F)), *map(chr, range(0xC0, 0x100)), *"aaabbcc  \n\t''..12", "\u0301", "\u4e2d", "\u00a0", "<|endoftext|>"]
    rows = ["".join(draw.choice(letters, draw.integers(0, 40))) for _ in range(3000)]
    got, n = idcoder.WordTokenizer(tokenizer_json, 1)(pa.array(rows, pa.string()))
    for row, ids in zip(rows, np.split(got, np.cumsum(n)[:-1]), strict=True):
        assert ids.tolist() == [*whole.encode(row, add_special_tokens=False).ids, 1], row


def test_files_hold_every_document_in_order(spark, docs, odd, tokenizer_json, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(idcoder, "TEXT_BYTES", 50_000)
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = sorted(idcoder.encoded_documents(both, tokenizer_json).collect(), key=lambda r: r.start)
    whole, at = Tokenizer.from_str(tokenizer_json), 0
    rows = texts(both)
    assert [r.doc_id for r in got] == sorted(rows, key=lambda d: (d is not None, d))
    for r in got:
        ids = [*whole.encode(rows[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_no_documents_make_no_ids(empty, tokenizer_json):
    assert idcoder.encoded_documents(empty, tokenizer_json).collect() == []


# --- 6 chat -----------------------------------------------------------------------------------


@pytest.mark.parametrize("text", [
    "", "</s>[INST] ok [/INST]", "\\", "<\\s>", "<\\\\s> [\\INST]", "<<s>", "[[ANS][/ANS]", "<s", "[ROLE]x[SAYS]y[/ROLE]", "<\\", "a<s>b</s>c",
])
def test_escapes_come_back_and_hide_every_mark(text):
    shown = chat.escape(text)
    assert chat.unescape(shown) == text and not any(c in shown for c in chat.CONTROL)
    for role in ("user", "assistant", "system", "tool", "", "[SAYS]"):
        turns = chat.START + chat.written_turn(role, text)[0] + chat.END
        assert [(r, t) for r, t, _, _ in chat.read_turns(turns)] == [(role, text)]


def expected_digests(turns):
    by = {}
    for conv, turn, role, text in turns:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, rows in by.items():
        rows.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
        loss = "".join(t for _, _, r, t in rows if r == "assistant")
        yield conv, len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("budget,history", [(512, 2), (60, 3), (1, 0), (100_000, 2)])
def test_windows_read_back(spark, budget, history):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += queries.CONTROL_CONVERSATION
    turns += [(70, i, ("system", "user", "assistant")[min(i, 1 + i % 2)], f"turn {i} " * (i % 9)) for i in range(300)]
    turns += [(None, 1, "user", None), (None, 0, None, "x"), (71, None, "assistant", "late"), (71, 0, "tool", "[ROLE]"), (71, 0, "tool", "[ROLE]")]
    frame = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    windows = chat.chat_windows(frame, queries.vocabulary("byte_bpe_50k.json"), budget, history)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    expected = list(expected_digests(turns))
    assert len(got) == len(expected)
    for conv, n, whole, chars, loss in expected:
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (n, whole, chars, loss)
    rows = windows.collect()
    for w in rows:
        turns_in = list(chat.read_turns(w.text))
        assert w.n_tokens <= budget or len(turns_in) - w.n_repeated == 1
        system = w.window > 0 and turns_in[0][0] == "system"
        assert w.n_repeated <= history + system and (system or w.conv_id != 70 or w.window == 0)
    assert any(w.n_repeated for w in rows) == (budget < 100_000)


def test_no_conversations(spark):
    frame = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.read_back(chat.chat_windows(frame, queries.vocabulary("byte_bpe_50k.json"))).collect() == []


# --- 7 near duplicates ------------------------------------------------------------------------


def shingle_set(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def expected_groups(rows, size, percent):
    sets = {d: shingle_set(t, size) for d, t in rows.items()}
    parent = {d: d for d in rows}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(d for d in rows if d is not None and sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d) if d is not None else None) for d in rows}


def test_groups_against_all_pairs(spark, odd, monkeypatch):
    monkeypatch.setattr(buckets, "PART", 8)
    draw = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        base = draw.choice(vocabulary, 120).tolist()
        for k in range(14):
            text = list(base)
            for i in draw.integers(0, 120, k // 2):
                text[i] = str(draw.choice(vocabulary))
            rows.append((len(rows), " ".join(text)))
    rows += [(1000 + i, rows[0][1].upper()) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text"))
    for size in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in oddsketch.near_duplicates(frame, size).collect()}
        expected = {d: (n, c, d == c) for d, (n, c) in expected_groups(texts(frame), size, 80).items()}
        assert got == expected


def test_odd_sketches_estimate_high_similarities():
    multiply, add = oddsketch._coefficients()
    draw = np.random.default_rng(2)
    for similarity in (0.95, 0.8):
        ones = []
        for _ in range(30):
            common_ = draw.integers(0, 2**63, 900).astype(np.uint64)
            own = int(900 * (1 - similarity) / (2 * similarity))
            a, b = (np.concatenate([common_, draw.integers(0, 2**63, own).astype(np.uint64)]) for _ in range(2))
            x, y = (np.frombuffer(oddsketch.odd_sketch(oddsketch.minhash(s, multiply, add)), np.uint64) for s in (a, b))
            ones.append(int(np.bitwise_count(x ^ y).sum()))
        assert abs(np.mean(ones) - oddsketch.most_ones(similarity)) < 12
        assert max(ones) <= oddsketch.most_ones(0.8 * oddsketch.SLACK)


def test_no_documents_make_no_groups(empty):
    assert oddsketch.near_duplicates(empty).collect() == []
    assert oddsketch.without_near_duplicates(empty).columns == empty.columns


# --- 8 languages ------------------------------------------------------------------------------


def test_held_out_languages_are_found(spark, docs):
    got = {r.doc_id: r for r in queries.op8_rank_order_language(spark, SF).collect()}
    rows = docs.select("doc_id", "lang").collect()
    held = [r for r in rows if got[r.doc_id].held_out]
    assert held and all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def slow_grams(text):
    shown = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    out = Counter()
    for word in shown.split():
        padded = f" {word} "
        for n in (1, 2, 3):
            out.update(padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")
    return out


def test_n_grams_are_those_of_padded_words():
    cases = ["Hello, hello world", "\u00c9t\u00e9 1 a", "\U00010400\U00010400 x", "", "...", "a"]
    rows, codes, counts, has = ranklang.grams(pa.array([*cases, None]), ranklang.letter_table())
    assert has.tolist() == [True, True, True, False, False, True, False]

    def code(g):
        if len(g) == 1:
            return ord(g)
        p = [0 if c == " " else ord(c) for c in g]
        return p[0] << 21 | p[1] | 1 << 42 if len(g) == 2 else p[0] << 42 | p[1] << 21 | p[2]

    for k, text in enumerate(cases):
        some = rows == k
        assert dict(zip(codes[some].tolist(), counts[some].tolist(), strict=True)) == {code(g): n for g, n in slow_grams(text).items()}


def test_language_corner_cases(spark, odd, docs, empty):
    learned = ranklang.profiles(docs, 100)
    got = {r.doc_id: r for r in ranklang.predict(odd, learned, 100).collect()}
    assert [got[d].lang_pred for d in (9001, 9002, 9003, 9006)] == ["und"] * 4 and got[9006].score == 0.0
    assert got[9004].lang_pred in learned and ranklang.predict(odd, learned).columns.count("score") == 1
    assert ranklang.profiles(empty) == {} and {r.lang_pred for r in ranklang.predict(odd, {}).collect()} == {"und"}
    kept = ranklang.in_a_known_language(odd, learned, 0.0)
    assert kept.columns == odd.columns and {r.score for r in kept.collect()} == {"clash"}
    assert ranklang.in_a_known_language(empty, learned, 0.0).collect() == []


def test_the_language_stage_rejects_foreign_texts_and_noise(spark):
    labelled = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    draw = np.random.default_rng(3)

    def noise(n):
        return " ".join("".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), draw.integers(2, 9))) for _ in range(n))

    foreign = [
        "La citt\u00e0 \u00e8 molto bella e il sole splende sul mare mentre i bambini giocano nella piazza vicino alla chiesa",
        "Suomen kieli on kaunis ja vaikea kieli jota puhutaan pohjoisessa maassa jossa on paljon j\u00e4rvi\u00e4 ja mets\u00e4",
        "Wszyscy ludzie rodz\u0105 si\u0119 wolni i r\u00f3wni pod wzgl\u0119dem swej godno\u015bci i swych praw",
    ]
    bad = [*foreign, noise(5), noise(20), noise(200), noise(2_000)]
    # Clean short documents: the first words of labelled ones.
    clean = [" ".join(r.text.split()[:30]) for r in labelled.where("lang = 'en' AND doc_id % 50 = 0").orderBy("doc_id").collect()]
    extra = [(900_000 + k, t, None, "x") for k, t in enumerate([*bad, *clean])]
    both = labelled.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(extra, SCHEMA))
    ids = {r.doc_id for r in corpus_pipeline.language(spark, both, SF).select("doc_id").collect()}
    assert not ids & set(range(900_000, 900_000 + len(bad)))
    assert clean and {900_000 + len(bad) + k for k in range(len(clean))} <= ids
    assert ids >= {r.doc_id for r in labelled.select("doc_id").collect()}


# --- 9 phrases --------------------------------------------------------------------------------


def item_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))


def expected_hits(rows, items, window=10):
    runs = {}
    for item, text in items:
        w = item_words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            runs.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    for d, text in rows.items():
        w, hit, names = item_words(text), set(), set()
        for run, holders in runs.items():
            for k in range(len(w) - len(run) + 1):
                if tuple(w[k : k + len(run)]) == run:
                    hit |= set(range(k, k + len(run)))
                    names |= holders
        yield d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


@pytest.mark.parametrize("block_bytes", [phrases.BLOCK_BYTES, 60])
def test_phrases_against_every_position(spark, odd, block_bytes):
    items = [("i2", "one two three"), ("i10", "A b C d e f g h i j k l"), ("i3", "c d e f g h i j k l"), ("none", "..."), ("null", None)]
    items += [("i10", "A b C d e f g h i j k l"), ("rep", "the the the"), ("word", "word word"), ("e", "\u00e9t\u00e9")]
    rows = [(1, "x a b c d e f g h i j k l y"), (2, "one-two three four one two three"), (3, "the the the the"), (4, "one two"), (5, "three")]
    rows += [(6, "b c d e f g h i j k"), (7, "\u00c9T\u00c9 \u00e9t\u00e9"), (8, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text")).coalesce(1)
    wanted = spark.createDataFrame(items, "item_id string, text string")
    got = phrases.contamination(frame, wanted, block_bytes=block_bytes).collect()
    expected = {d: (n, h, k, s, h > 0) for d, n, h, k, s in expected_hits(texts(frame), items)}
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == expected
    kept = phrases.without_contaminated(odd, wanted)
    assert kept.columns == odd.columns and 9004 not in {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("block_bytes", [phrases.BLOCK_BYTES, 20])
def test_phrases_of_items_and_documents_without_ids(spark, block_bytes):
    """Rows stay rows in any number of blocks; an item without an id is found, but not named."""
    rows = [(None, "one two three"), (None, "one two three"), (1, "four five six"), (1, "four five six"), (2, "none"), (None, "four")]
    items = [(None, "four five six"), ("a", "one two three"), ("b", "eight nine ten")]
    got = phrases.contamination(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), block_bytes=block_bytes
    )
    named, unnamed = (hashlib.sha256(s).hexdigest() for s in (b"a", b""))
    expected = [(None, 3, 3, 1, named, True)] * 2 + [(1, 3, 3, 0, unnamed, True)] * 2 + [(2, 1, 0, 0, unnamed, False), (None, 1, 0, 0, unnamed, False)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_phrases_without_items_or_documents(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in phrases.contamination(odd, none).collect()} == {False}
    assert phrases.contamination(empty, none).collect() == []


def test_proximity_takes_any_order(spark):
    rows = [(1, "alpha x x beta"), (2, "beta alpha"), (3, "alpha x x x x beta"), (4, "alpha"), (5, "beta")]
    q = phrases.Queries([("i", "alpha beta")])
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = phrases.search(phrases.build_index(frame, q.terms), q, within=3).collect()
    assert {r.doc_id for r in found if r["items"]} == {1, 2}


# --- 10 repeats -------------------------------------------------------------------------------


def expected_removals(rows):
    first = {}
    for d, t in sorted(rows.items()):
        b = t.encode()
        for i in range(len(b) - 99):
            first.setdefault(b[i : i + 100], (d, i))
    for d, t in rows.items():
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if first[b[i : i + 100]] < (d, i):
                gone[i : i + 100] = b"\x01" * 100
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        yield d, (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("least", [None, 2])
def test_repeats_against_every_string(spark, docs, least):
    rows = texts(docs) | {
        9100: "a" * 1000, 9101: "a" * 50 + "b" * 300 + "ab" * 400, 9102: "x" * 99, 9103: "", 9104: "a" * 120,
        9105: "ab" * 60 + "\u00e9" * 200, 9106: "\u00e9" * 300, 9107: "\0" * 300, 9108: "xy" * 49 + "z" + "xy" * 49, 9109: "q" * 100, 9110: "q" * 100,
    }
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    frequent = None if least is None else repeats.frequent_anchors(frame, 0.0, 10**6, least)
    assert frequent is None or len(frequent) > 100
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(frame, frequent).collect()}
    assert got == dict(expected_removals(rows))


def test_repeats_of_odd_rows(spark, odd, empty):
    assert repeats.without_repeats(empty).collect() == []
    twice = odd.union(odd)
    got = repeats.without_repeats(twice).collect()
    assert len(got) == 2 * len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_removed, r.kept_sha256))
    assert all(len(v) == 1 for v in by.values()) and next(iter(by[9007]))[0] == 150_000
    # A row without an id comes last.
    long = "".join(map(chr, np.random.default_rng(3).integers(97, 123, 150)))
    rows = spark.createDataFrame([(None, long), (7, long)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in repeats.without_repeats(rows).collect()} == {7: 0, None: 150}


def test_longest_previous_factors_of_one_text():
    text = b"abracadabra" * 30
    n = len(text)
    symbols = np.zeros((n, 168), np.uint8)
    for i in range(n):
        piece = text[i : i + 168]
        symbols[i, : len(piece)] = list(piece)
    rank = repeats.suffix_ranks(symbols)[:, 0]
    starts = np.arange(n - 99)
    got = repeats.earlier_factor(rank[: n - 99], np.zeros(n - 99, np.int64), starts)
    expected = [any(text[j : j + 100] == text[i : i + 100] for j in range(i)) for i in starts]
    assert got.tolist() == expected
    order = np.argsort(rank[: n - 99], kind="stable")
    assert all(text[a : a + 100] <= text[b : b + 100] for a, b in zip(order[:-1], order[1:], strict=True))


# --- pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages_against_brute_force(spark, docs):
    frame, shown = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = frame
        frame = common.written(stage(spark, frame, SF), "test-stage")
        shown[name] = (before, frame)
        if name != "token_ids":
            assert frame.columns == docs.columns
    before, after = shown["language"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if re.search(r"[^\W\d_]", r.text or "")}
    before, after = shown["near_duplicates"]
    groups = expected_groups(texts(before), 5, 80)
    assert {r.doc_id for r in after.collect()} == {d for d, (_, c) in groups.items() if c == d}
    before, after = shown["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in after.collect()} == {d for d, _, hit, _, _ in expected_hits(texts(before), items) if not hit}
    before, after = shown["mixture"]
    sizes = Counter()
    for r in before.collect():
        sizes[r.source] += len(words(r.text or ""))
    taken = Counter()
    for r in after.collect():
        taken[r.source] += len(words(r.text or ""))
    longest = max(len(words(t)) for t in texts(before).values())
    assert all(abs(taken[s] - t) <= longest for s, t in expected_targets(sizes).items())
    before, after = shown["token_ids"]
    assert after.count() == before.count()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, after.collect()))


def test_pipeline_of_an_empty_table(spark, docs, empty):
    frame = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        frame = common.written(stage(spark, frame, SF), "test-empty")
    assert frame.collect() == []


def test_only_the_entry_and_this_package_import_it():
    root = Path(corpus_pipeline.__file__).parent
    for path in [*root.glob("quayside/**/*.py"), *root.glob("workload/*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert "quayside.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()


def test_struct_columns_survive_the_stages(spark, odd):
    nested = odd.withColumn("extra", F.struct("lang", F.array("source").alias("list")))
    kept = ranklang.in_a_known_language(nested, {"en": [ord("e")]}, 0.0)
    assert isinstance(kept.schema["extra"].dataType, T.StructType) and kept.count() > 0
