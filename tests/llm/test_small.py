"""Operators against brute force, round trips and held-out accuracy; every odd case on purpose."""

import collections
import hashlib
import itertools
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bitmask_langid, chunked_bpe, common, license_scan, line_quality, ngram_jaccard, partenum, poisson_mix, projection_dedup, queries, semicrf_pii, subword_quality, tool_calls
from quillspark.llm.components import components, roots

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, own_id string, copy int"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(20_000))
ODD = [None, "", " \n\t ", "one", "Two words", "two Words", "a b c", "É è ü ñ x", LONG, LONG + " end", LONG, "x" * 70_000, "### $$$ " * 40, "same " * 60, "\n".join(["a line of text here"] * 9)]


def docs(spark, texts, sources=None):
    rows = [(k, t, "en", (sources or ["s"])[k % len(sources or ["s"])], None if t is None else len(t), "clash", "clash", 7) for k, t in enumerate(texts)]
    rows += [(None, "a row without an id", None, None, 1, None, None, None), (0, "an id that repeats", "en", "s", 1, "", "", 0)]
    return spark.createDataFrame(rows, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


# ---- quality rules


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


MODEL = line_quality.DEFAULT


def test_line_quality(spark):
    d = docs(spark, ODD)
    got = line_quality.score(d, MODEL).collect()
    want = sorted(base(r.text) for r in d.collect())
    assert sorted(tuple(r[1:6]) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    kept = line_quality.keep(d, MODEL)
    assert kept.schema == d.schema and kept.count() == sum(r.kept for r in got)
    assert line_quality.score(empty(spark), MODEL).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    lengths = [0, 1, 5, 3, 0, 7]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    scores, step = rng.normal(size=bounds[-1]), rng.normal(size=(2, 2))
    got = line_quality.viterbi(scores, step, bounds)
    for a, b in zip(bounds, bounds[1:]):
        def value(path):
            return sum(scores[a + i] * s for i, s in enumerate(path)) + sum(step[x, y] for x, y in zip(path, path[1:]))

        best = max(map(value, itertools.product((0, 1), repeat=b - a)))
        assert value(got[a:b].tolist()) == pytest.approx(best)


def test_line_quality_against_labels(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = line_quality.score(d, line_quality.fit(d, labels)).join(labels, "doc_id").where("not base_failed")
    assert got.where("quality = 1 and not kept").count() == 0
    assert got.where("quality = 0 and kept").count() <= 0.2 * got.where("quality = 0").count() + 1


def test_line_gradient():
    """The slopes of the likelihood are those of small steps, and the likelihood that of all labellings."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5, 3, line_quality.N_FEATURES))
    on = np.arange(5)[:, None] < np.array([5, 2, 1])
    x *= on[..., None]
    y = rng.integers(0, 2, (5, 3)) * on
    emit, step = rng.normal(size=line_quality.N_FEATURES), rng.normal(size=(2, 2))
    value, to_emit, to_step = line_quality.likelihood(x, on, y, emit, step)
    brute = 0.0
    for k in range(3):
        n = on[:, k].sum()

        def score(path):
            return sum(x[t, k] @ emit * path[t] for t in range(n)) + sum(step[a, b] for a, b in itertools.pairwise(path))

        brute += score(y[:n, k]) - np.log(sum(np.exp(score(p)) for p in itertools.product((0, 1), repeat=n)))
    assert value == pytest.approx(brute)
    for k in range(line_quality.N_FEATURES):
        d = np.eye(line_quality.N_FEATURES)[k] * 1e-6
        assert (line_quality.likelihood(x, on, y, emit + d, step)[0] - value) / 1e-6 == pytest.approx(to_emit[k], abs=1e-3)
    for i, j in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = 1e-6
        assert (line_quality.likelihood(x, on, y, emit, step + d)[0] - value) / 1e-6 == pytest.approx(to_step[i, j], abs=1e-3)


def mixed_texts():
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8)))
    prose = lambda: " ".join(word() for _ in range(rng.integers(12, 20))) + "."
    junk = lambda: " | ".join(word().upper() if rng.random() < 0.5 else word() for _ in range(rng.integers(4, 12)))
    good = [[prose() for _ in range(rng.integers(4, 9))] for _ in range(40)]
    bad = [[junk() for _ in range(rng.integers(3, 9))] for _ in range(40)]
    return good, bad, prose, junk


def test_lines_of_mixed_texts(spark):
    """Runs of boilerplate within texts are labelled line by line, and the share decides."""
    good, bad, prose, junk = mixed_texts()
    for k in range(0, 40, 4):
        good[k][0] = "Home of the common header line"
    texts = ["\n".join(t) for t in good + bad]
    d = docs(spark, texts).where("doc_id is not null and text not like '%repeats'")
    labels = spark.createDataFrame([(k, 1 if k < 40 else 0, 0) for k in range(80)], "doc_id long, quality int, toxic int")
    model = line_quality.fit(d, labels)
    assert len(model.known) == 1 and model.step[0, 0] + model.step[1, 1] > model.step[0, 1] + model.step[1, 0] + 1
    some = [prose() for _ in range(4)]
    mixed = [some[:2] + [junk() for _ in range(4)] + some[2:], ["Home of the common header line", *some, junk()], some[:1] + [junk() for _ in range(9)], some]
    rows = sorted(line_quality.score(docs(spark, ["\n".join(t) for t in mixed]).where("doc_id is not null and text not like '%repeats'"), model).collect(), key=lambda r: r.doc_id)
    assert [(r.n_lines, r.n_content_lines) for r in rows] == [(8, 4), (6, 4), (10, 1), (4, 4)]
    assert 0 < rows[2].content_share < 0.5 < rows[0].content_share < 1 and not rows[2].kept and rows[0].kept and rows[3].content_share == 1
    # a line in doubt goes with its neighbours: without steps between labels it falls the other way
    scores = np.array([3.0, -0.4, 3.0, -3.0, 0.4, -3.0])
    assert line_quality.viterbi(scores, model.step * 2, np.array([0, 6])).tolist() == [1, 1, 1, 0, 0, 0]
    assert line_quality.viterbi(scores, model.step * 0, np.array([0, 6])).tolist() == [1, 0, 1, 0, 1, 0]


def test_line_labels_odd(spark):
    """No label, one class, two labels of one id, ids that are strings, an empty table."""
    d = docs(spark, ["some words of text\nand a line"] * 4)
    schema = "doc_id long, quality int, toxic int"
    for rows in ([], [(1, 1, 0), (2, 1, 0)], [(None, 0, 0), (1, None, 0)]):
        assert line_quality.fit(d, spark.createDataFrame(rows, schema)) is line_quality.DEFAULT
    both = [(1, 1, 0), (1, 0, 0), (2, 1, 0)]
    rows = common.labelled(d, spark.createDataFrame(both, schema), 9).collect()
    assert {r.key: r.quality for r in rows} == {"1": 0, "2": 1}
    named = d.withColumn("doc_id", F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    got = line_quality.fit(named, spark.createDataFrame([("x1", 1, 0), ("x2", 0, 0)], "doc_id string, quality int, toxic int"))
    assert len(got.emit) == line_quality.N_FEATURES and line_quality.fit(empty(spark), spark.createDataFrame(both, schema)) is line_quality.DEFAULT
    many = docs(spark, ["a b c"] * 3).union(docs(spark, ["a b c"] * 3)).union(docs(spark, ["a b c"] * 3))
    assert common.labelled(many, spark.createDataFrame([(0, 1, 0)], schema), 2).count() == 2


# ---- n-gram Jaccard join


def brute_links(texts):
    sets = []
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w)} if 0 < len(w) < 3 else set(zip(w, w[1:], w[2:])))
    links = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j])}
    return sets, links


def near_texts():
    rng = np.random.default_rng(3)
    made = list(ODD)
    for size in (3, 4, 5, 8, 13, 40, 90, 300):
        for _ in range(3):
            words = [f"v{x}" for x in rng.integers(0, 5000, size)]
            made += [" ".join(words), " ".join(words).upper()]
            for share in (0.02, 0.05, 0.1, 0.2):
                other = [w if rng.random() > share else "zz" for w in words]
                made += [" ".join(other), " ".join(words[: max(1, int(len(words) * (1 - 2 * share)))])]
    return made


def test_jaccard_join(spark):
    texts = near_texts()
    d = docs(spark, texts)
    rows = d.collect()
    sets, links = brute_links([r.text for r in rows])
    near = collections.Counter(x for pair in links for x in pair)
    comp = list(range(len(rows)))
    for _ in rows:
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    ids = collections.defaultdict(list)
    for k, c in enumerate(comp):
        ids[c].append(rows[k].doc_id)
    least = {c: min((x for x in v if x is not None), default=None) for c, v in ids.items()}
    want = sorted((str(rows[k].doc_id), len(sets[k]), near[k], str(least[comp[k]])) for k in range(len(rows)))
    got = sorted((str(r.doc_id), r.n_shingles, r.n_similar, str(r.component_id)) for r in ngram_jaccard.link(d).collect())
    assert got == want and sum(near.values()) > 100
    assert ngram_jaccard.link(empty(spark)).count() == 0


def changed_copies(n):
    """One text with one or two words changed, n times, among others."""
    rng = np.random.default_rng(21)
    words = [f"c{k}" for k in range(40)]
    made = []
    for k in range(n):
        own = list(words)
        for at in rng.integers(0, 40, 1 + k % 2):
            own[at] = f"z{k}"
        made.append(" ".join(own))
    return made + [" ".join(f"q{x}" for x in rng.integers(0, 999, 30)) for _ in range(50)] + made[:30]


def test_shingle_counts_take_little_memory():
    """The first scan's table of counts stops at 255 and takes 16 MB, also when its pages go out."""
    import tracemalloc

    import pyarrow as pa

    texts = ["a b c"] * 70_000 + [f"w{k} x{k % 300} y{k % 300} z{k % 300}" for k in range(2_000)] + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["own_id", "text"])
    list(ngram_jaccard._profiled(iter([batch.slice(0, 10)])))  # makes the tables of powers
    tracemalloc.start()
    out = list(ngram_jaccard._profiled(iter([batch.slice(at, 4_000) for at in range(0, len(texts), 4_000)])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 60 and sum(b.num_rows for b in out[:-1]) == len(texts)
    counts = np.zeros((ngram_jaccard.PAGES, (1 << partenum.HOT_BITS) // ngram_jaccard.PAGES), np.uint8)
    for r in out[-1].to_pylist():
        counts[r["page"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    want = np.zeros(1 << partenum.HOT_BITS, np.int64)
    for b in ngram_jaccard.ts.blocks(batch.column(1)):
        np.add.at(want, partenum.hot_slots(partenum.shingles(b)[0]), 1)
    assert want.max() >= 70_000 and (np.minimum(want, 255) == counts.reshape(-1)).all()
    long = np.zeros(1 << partenum.HOT_BITS, np.uint16)
    ngram_jaccard._count(long, np.full(200_000, 7))  # more than sixteen bits count
    assert long[7] == 255 and long.sum() == 255


def test_jaccard_join_takes_small_batches(spark, monkeypatch):
    """What the Jaccard join sends to workers is bound by bytes, not only by rows, in each query that it runs; the
    session has its own bound again afterwards, also after an error, and keeps a smaller one."""
    import pyarrow as pa

    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    usual = spark.conf.get(name)

    def largest():
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

        return spark.range(0, 6000, 1, 1).selectExpr("repeat(cast(id as string), 1000) as t").mapInArrow(run, "n long").agg({"n": "max"}).first()[0]

    own = ngram_jaccard.stored
    monkeypatch.setattr(ngram_jaccard, "stored", lambda df, what: (seen.append((what, largest() if what == "profile" else 0, spark.conf.get(name))), own(df, what))[1])
    d = docs(spark, near_texts()[:40])
    got = ngram_jaccard.link(d)
    assert {what for what, _, _ in seen} >= {"profile", "candidates", "links"} and seen[0][1] < 5 << 20
    assert {x for _, _, x in seen} == {str(common.BATCH_BYTES)} and spark.conf.get(name) == usual
    assert "InArrow" not in got._jdf.queryExecution().executedPlan().toString()  # nothing in Python runs after it
    with pytest.raises(Exception):
        ngram_jaccard.link(d, "no_such_column")
    assert spark.conf.get(name) == usual and spark.conf.get(name, None) is None
    spark.conf.set(name, "1m")
    try:
        with common.small_batches(spark):
            assert spark.conf.get(name) == "1m"
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)


def test_features_of_copies_go_out_once(spark):
    """Copies of a set in one task give its features once, however small the batches are."""
    texts = [f"{'word ' * 3000} {k % 3} end of it" for k in range(900)]
    d = spark.createDataFrame(list(enumerate(texts)), "own_id long, text string").coalesce(1)
    with common.small_batches(spark):
        rows = ngram_jaccard._sets(d, np.full(1 << (ngram_jaccard.SLOT_BITS - 3), 255, np.uint8)).collect()
    assert len(rows) == len({(r.k1, r.k2) for r in rows}) == 3


def test_large_clusters_lose_no_link(spark):
    """Over a thousand different near copies, more than a block holds and than a signature lists as pairs."""
    texts = changed_copies(1100)
    got = {r.doc_id: r for r in ngram_jaccard.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    split = [t.split() for t in texts]
    grams = [set(zip(w, w[1:], w[2:])) for w in split]
    place = {g: i for i, g in enumerate(set().union(*grams))}
    m = np.zeros((len(texts), len(place)), np.float32)
    for k, g in enumerate(grams):
        m[k, [place[x] for x in g]] = 1
    both, n = (m @ m.T).astype(np.int64), m.sum(1).astype(np.int64)
    linked = 100 * both >= 70 * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(linked, False)
    assert [got[k].n_similar for k in range(len(texts))] == linked.sum(1).tolist()
    a, b = np.nonzero(np.triu(linked))
    nodes, root = roots(a, b)
    least = dict(zip(nodes.tolist(), root.tolist()))
    assert [got[k].component_id for k in range(len(texts))] == [least.get(k, k) for k in range(len(texts))]
    assert 0.1 < linked[:1100, :1100].mean() < 0.9


def test_pairs_of_large_clusters_grow_with_the_sets(spark):
    """What goes from the buckets to the counts follows the number of near copies, not its square."""
    size = {}
    for n in (200, 800):
        d = spark.createDataFrame(list(enumerate(changed_copies(n)[:n])), "own_id long, text string").coalesce(1)
        blobs = ngram_jaccard._postings(d, np.zeros(1 << 20, np.uint8), {}, 1).toArrow()
        size[n] = sum(len(x) for out in ngram_jaccard._pairs_of_bucket(iter(blobs.to_batches())) for x in out.column(1).to_pylist())
    assert 0 < size[800] < 6 * size[200] and size[800] < 800 * 40 * 9


def test_spent_shuffles_are_deleted(spark):
    """A stored table's shuffle files, also of the last query that ran, go with the release."""
    import time
    from pathlib import Path

    local = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {p for p in local.rglob("shuffle_*.data")}
    before = files()
    kept = common.stored(spark.range(50_000).repartition(5, "id"), "kept")
    own = files() - before
    common.release(spark)
    for _ in range(40):
        if not own & files():
            break
        time.sleep(0.25)
    assert own and not own & files() and kept.count() == 50_000


def test_short_ids_lose_no_pair(spark, monkeypatch):
    """Different sets of one short id are compared all the same."""
    ids = np.array([0, 1, (1 << 48) - 1, 123456789012345], np.int64)
    assert ngram_jaccard.from_six(ngram_jaccard.six_bytes(ids).tobytes(), 4).tolist() == ids.tolist()
    texts = [" ".join(f"u{k}" for k in range(60)), " ".join(f"u{k}" for k in range(58)) + " x y", " ".join(f"v{k}" for k in range(60))]
    whole = partenum.set_key
    monkeypatch.setattr(partenum, "set_key", lambda s: (7, whole(s)[1]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert [ngram_jaccard.short_ids(np.array([7]))[0]] == [0]
    # workers hold their own copy of the module, so the pairs are made here
    blocks = [next(ngram_jaccard.ts.blocks(d.toArrow()["text"].combine_chunks()))]
    sets, bounds = partenum.shingles(blocks[0])
    key = lambda i: partenum.set_key(sets[bounds[i] : bounds[i + 1]])
    assert key(0)[0] == key(1)[0] == key(2)[0] and len({key(i) for i in range(3)}) == 3
    keys = spark.createDataFrame([key(i) for i in range(3)], "k1 long, k2 long")
    alike = ngram_jaccard.same_short(keys).collect()
    assert [(r.a, r.b) for r in alike] == [(0, 0)]


def test_merged_pages(spark):
    import zlib

    rng = np.random.default_rng(2)
    parts = rng.integers(0, 9, (40, 3, 5)).astype("<i8")
    rows = [(p, bytearray(zlib.compress(x.tobytes()))) for task in parts for p, x in enumerate(task)]
    got = common.merged_pages(spark.createDataFrame(rows, "page int, data binary").repartition(7), np.add, "<i8", "<i8").collect()
    assert {r.page: np.frombuffer(zlib.decompress(r.data), "<i8").tolist() for r in got} == {p: parts[:, p].sum(0).tolist() for p in range(3)}
    some = rng.integers(-(2**62), 2**62, 5000)
    bits = common.bitmap(spark.createDataFrame([(int(x),) for x in some], "k long"), "k")
    assert common.in_bitmap(bits, some).all() and common.in_bitmap(bits, rng.integers(-(2**62), 2**62, 5000)).mean() < 0.3


def test_shared_dir_needs_a_setting_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_signatures_share_enough():
    """Any two similar sets show as many equal signatures as promised, hot features or not."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 77, 200, 901]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            for keep in (1.0, 0.97, 0.9, 0.84, 0.8, 0.71):
                b = np.unique(np.concatenate([a[rng.random(len(a)) < keep], rng.integers(0, 2**64, int(rng.integers(0, 1 + n // 6)), dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if not len(b) or 100 * both < 70 * (len(a) + len(b) - both):
                    continue
                hot = lambda s: (s & np.uint64(7)) < 5
                made = [[partenum.signatures(s, hot(s), x) for x in partenum.bands(len(s))] for s in (a, b)]
                shown = [np.concatenate([m[0] for m in side]) for side in made]
                need = min(m[1] for side in made for m in side)
                assert len(np.intersect1d(*shown)) >= need >= 1


def test_common_features_are_shown_last():
    """Hot features are in no signature where rarer ones are enough, and the less common go before the more common."""
    rng = np.random.default_rng(8)

    def shown(s, kinds):
        order = np.argsort(s)
        return partenum.signatures(s[order], kinds[order], 7)

    for kinds in (np.repeat([0, 0, 0, 0, 2], 40), np.repeat([0, 2, 2, 2, 5], 40)):
        for _ in range(20):
            s = rng.integers(0, 2**64, 200, dtype=np.uint64)
            others = np.where(kinds < max(kinds), s, rng.integers(0, 2**64, 200, dtype=np.uint64))
            some, need = shown(s, kinds.astype(np.uint8))
            assert need >= 1 and partenum.farthest(200, 7) < len(some)
            assert some.tolist() == shown(others, kinds.astype(np.uint8))[0].tolist()


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1300)] + [(5000, k) for k in range(5001, 5400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    a, b = np.array(edges).T
    n, r = roots(a, b)
    want = {int(x): int(y) for x, y in zip(n, r) if any((a[a != b] == x) | (b[a != b] == x))}
    assert got == want and len(set(r[n >= 1000])) == 2


# ---- BPE


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    texts = [*ODD, "x<|endoftext|>y <|endoftext|>", *(f"{LONG[9_000 * k : 9_000 * k + 40_000]} tail {k}" for k in range(6)), "it's we'll 'v 're    12 3４ \n\n  \t x", "é" * 5000, "é" * 5000]
    d = docs(spark, texts)
    got = collections.Counter((r.doc_id, bytes(r.ids), r.decoded) for r in chunked_bpe.encode(d, path).collect())
    want = collections.Counter()
    for r in d.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert chunked_bpe.encode(empty(spark), path).count() == 0


def test_pieces_come_in_small_batches():
    """A worker doesn't hold the pieces of a whole batch, and gives free memory back after its task."""
    import pyarrow as pa

    c = chunked_bpe.codec(queries.tokenizer_path())
    texts = [f"{k} {LONG[5_000 * k % 90_000 :][:60_000]} {k}" for k in range(250)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(250)), pa.array(texts), pa.array(range(250))], names=["own_id", "text", "uid"])
    out = list(chunked_bpe.cut_pieces(batch, c, np.full(1 << 20, 255, np.uint8), {}))
    assert len(out) > 2 and max(b.nbytes for b in out) < 3 * chunked_bpe.FLUSH_BYTES
    rows = pa.Table.from_batches(out).to_pylist()
    chunks = {r["digest"]: r["chunk"] for r in rows if r["chunk"] is not None}
    assert len(chunks) == sum(r["chunk"] is not None for r in rows)
    back = collections.defaultdict(bytes)
    for r in rows:
        if r["uid"] is not None:
            back[r["uid"]] += chunks[r["digest"]]
    assert [back[k].decode() for k in range(250)] == texts


def test_joined_rows_come_in_small_batches():
    """The texts joined of one batch of pieces leave in batches of about 2 * FLUSH_BYTES of ids, not all at the end of it,
    and repeated chunks leave some at a time."""
    import pyarrow as pa

    c = chunked_bpe.codec(queries.tokenizer_path())
    texts = [f"{k} {LONG[5_000 * k % 90_000 :][:30_000]} {k}" for k in range(400)]
    pieces = [(k, n, k, *chunked_bpe.encoded_piece(c, part.encode())) for k, t in enumerate(texts) for n, part in enumerate((t[:15_000], t[15_000:]))]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array([p[n] for p in pieces], kind) for n, kind in enumerate(kinds)], names=["uid", "pos", "own_id", "ids", "before", "after"])
    for size in (len(pieces), 7):  # a text may be parted by the bound of two batches
        out = list(chunked_bpe.joined_rows(iter([batch.slice(at, size) for at in range(0, len(pieces), size)]), c))
        assert len(out) > 2 and max(b.column(1).nbytes for b in out) < 3 * chunked_bpe.FLUSH_BYTES
        rows = pa.Table.from_batches(out).to_pylist()
        assert [(r["own_id"], r["decoded"]) for r in rows] == list(enumerate(texts))
        assert all(np.frombuffer(r["ids"], "<u4").tolist() == c.encode(t.encode()).tolist() for r, t in zip(rows, texts))
    chunks = pa.RecordBatch.from_arrays([pa.array([str(k).encode() for k in range(1200)]), pa.array([f"a b {k} c d".encode() for k in range(1200)])], names=["digest", "chunk"])
    out = list(chunked_bpe.encoded_chunks(iter([chunks, chunks.slice(0, 0)]), c))
    assert max(b.num_rows for b in out) <= chunked_bpe.SLICE_ROWS
    assert [tuple(r.values()) for r in pa.Table.from_batches(out).to_pylist()] == [(str(k).encode(), *chunked_bpe.encoded_piece(c, f"a b {k} c d".encode())) for k in range(1200)]
    assert list(chunked_bpe.joined_rows(iter([]), c)) == [] == list(chunked_bpe.joined_rows(iter([batch.slice(0, 0)]), c))


def test_hot_chunk_without_python_rows(spark, monkeypatch):
    """A chunk with more copies than one key may have keeps its rows and ids; no table is made of Python rows, as those
    start a second daemon with workers of its own on each executor."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    texts = [f"{k} {LONG[:4_000]} {k % 3}" for k in range(1_100)]
    d = docs(spark, texts).persist()
    rows = d.collect()
    calls, kind = [], type(spark)
    own = kind.createDataFrame
    monkeypatch.setattr(kind, "createDataFrame", lambda self, data, *args, **more: (calls.append(data), own(self, data, *args, **more))[1])
    packed, heavy = chunked_bpe._repeated(d, "text")
    assert heavy and max(heavy.values()) > 1
    got = collections.Counter((r.doc_id, bytes(r.ids), r.decoded) for r in chunked_bpe.encode(d, path).collect())
    assert got == collections.Counter((r.doc_id, np.array(t.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes(), r.text or "") for r in rows)
    assert calls and all(isinstance(x, pa.Table) for x in calls)
    kept = common.stored(spark.range(100), "gone")
    at = common._paths[id(kept)][1]
    common.dropped(kept)
    assert spark.read.parquet(at).count() == 0 and all(isinstance(x, pa.Table) for x in calls)
    d.unpersist()


def test_memory_of_workers_is_given_back():
    import os

    import pyarrow as pa

    rss = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
    pins = []

    def run(batches):
        for batch in batches:
            some = [bytes(60_000) for _ in range(5000)]
            pins.append(some[-1])
            del some
            yield batch

    one = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
    before = rss()
    assert len(list(common.trimmed(run)(iter([one, one])))) == 2
    assert rss() - before < 60


def test_every_cut_splices_exactly():
    """Joins at every place of a text give the ids of the whole, also where a cut parts a word."""
    c = chunked_bpe.codec(queries.tokenizer_path())
    text = "It's  odd:\n\n they'll re-do 12,5 things   now 'v e and so on to the end of it."
    whole = c.encode(text.encode()).tolist()
    for cut in range(1, len(text)):
        parts = [chunked_bpe.encoded_piece(c, text[a:b].encode()) for a, b in ((0, cut), (cut, None))]
        assert chunked_bpe.splice(c, [(*p, bool(p[0] or p[2])) for p in parts]).tolist() == whole, cut


def test_long_white_space(spark):
    """Runs of over a million white-space characters, within a text, at its ends and before a special token."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t, c = Tokenizer.from_file(path), chunked_bpe.codec(path)
    for n in (chunked_bpe.LONG_SPACE - 1, chunked_bpe.LONG_SPACE, 1_000_010):
        for text in (f"one two{' ' * n}three 4", f"a b{' ' * n}", f"{' ' * (n - 1)}\nx", "\n" * n, f"a{' ' * n}<|endoftext|>b", f"a{' ' * n}\x1cb\u3000 c"):
            assert c.encode(text.encode()).tolist() == t.encode(text, add_special_tokens=False).ids, (n, text[:9], text[-9:])
    d = spark.createDataFrame([(1, "some text" + " " * 1_000_010 + "and more of it"), (2, "short"), (3, "\n" * 1_000_010)], "doc_id long, text string")
    got = {r.doc_id: (np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in chunked_bpe.encode(d, path).collect()}
    assert got == {r.doc_id: (t.encode(r.text, add_special_tokens=False).ids, r.text) for r in d.collect()}


# ---- mixing


def test_poisson_counts(spark):
    import math

    d = docs(spark, [f"text number {k} of it" for k in range(400)], sources=["a", "b", "b", "b", None])
    got = poisson_mix.mix(d, seed="t", power=0.5)
    assert got.columns == [*[c for c in d.columns if c != "copy"], "copy", "shuffle_key"]
    counts = collections.Counter(r.doc_id for r in got.where("doc_id is not null and text like 'text%'").collect())
    rows = d.collect()
    chars = collections.Counter()
    for r in rows:
        chars[r.source] += len(r.text)
    want = sum(v**0.5 for v in chars.values())
    rate = {s: v**0.5 / want * sum(chars.values()) / v for s, v in chars.items()}
    for r in rows[:400]:
        u = int(hashlib.md5(f"t:{r.doc_id}".encode()).hexdigest()[:12], 16) / 2**48
        n, p, total = 0, math.exp(-rate[r.source]), math.exp(-rate[r.source])
        while total <= u:
            n += 1
            p *= rate[r.source] / n
            total += p
        assert counts[r.doc_id] == n
    keys = [r.shuffle_key for r in got.collect()]
    assert keys == sorted(keys)
    assert poisson_mix.mix(empty(spark)).count() == 0


def test_poisson_shares(spark):
    d = docs(spark, ["x" * 10] * 3000, sources=["a", "b"])
    got = poisson_mix.mix(d, shares={"a": 3.0, "b": 1.0}).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in got}
    assert 2.5 < n["a"] / n["b"] < 3.6 and set(n) <= {"a", "b", "s"}


def test_poisson_high_rates(spark):
    got = poisson_mix.mix(docs(spark, ["x"] * 50, sources=["a", "b"]), shares={"a": 0.0, "b": 1.0})
    assert got.where("source = 'a'").count() == 0
    one = spark.createDataFrame([(1, "x", "a"), *((k, "y" * 100, "b") for k in range(2, 4))], "doc_id long, text string, source string")
    assert 40 < poisson_mix.mix(one, shares={"a": 1.0, "b": 1.0}).where("source = 'a'").count() < 170


def test_poisson_full_distribution(spark):
    """Counts are the inverse of the whole Poisson distribution at every rate, as in the SQL."""
    import math

    import duckdb

    n = 300
    for big, low, high in ((8_000, 41, 100), (40_000, 100, 700), (600_000, 700, 5000)):
        d = spark.createDataFrame([(k, "x" * (k == 0), "en", "a", 1) for k in range(n)] + [(n, "y" * big, "en", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
        got = collections.Counter({r.doc_id: r["count"] for r in poisson_mix.mix(d, shuffle=False).groupBy("doc_id").count().collect()})
        chars = {"a": 1, "b": big}
        rate = math.sqrt(chars["a"]) / (math.sqrt(chars["a"]) + math.sqrt(chars["b"])) * sum(chars.values()) / chars["a"]
        assert low < rate < high
        table, total, k = [], 0.0, 0
        while k < rate + 15 * math.sqrt(rate):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            table.append(total)
            k += 1
        for i in range(n):
            u = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:12], 16) / 2**48
            assert got[i] == int(np.searchsorted(table, u, "right")), (rate, i)
        spread = np.std([got[i] for i in range(n)])
        assert 0.85 < spread / math.sqrt(rate) < 1.15
        if rate < poisson_mix.PLAIN:
            con = duckdb.connect()
            con.register("documents", d.toArrow())
            assert got == collections.Counter(dict(con.execute(f"SELECT doc_id, count(*) FROM ({poisson_mix.ORACLE}) q GROUP BY doc_id").fetchall()))


# ---- classifiers


def held(mod, rest):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = subword_quality.fit(d, labels, ~held(4, 2), max_docs=300)
    rows = subword_quality.score(d, model).join(labels, "doc_id").where(held(4, 2)).collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    scores = [r.score for r in subword_quality.score(docs(spark, ODD), model).collect()]
    assert len(scores) == len(ODD) + 2 and all(0 <= s <= 1 for s in scores)
    assert subword_quality.score(empty(spark), model).count() == 0
    assert subword_quality.train([]).table().shape == (subword_quality.BUCKETS,)


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = bitmask_langid.fit(d, ~held(5, 0), per_lang=40)
    got = bitmask_langid.predict(d, model).join(d, "doc_id").where(held(5, 0)).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    odd = [(r.lang_pred, r.score) for r in bitmask_langid.predict(docs(spark, [None, "", "12 ?!", "Ж", *ODD]), model).collect()]
    assert odd[:4] == [("und", 0.0), ("und", 0.0), ("und", 0.0), (odd[3][0], 0.0)] and odd[3][0] in model.langs
    assert bitmask_langid.predict(empty(spark), model).count() == 0
    many = bitmask_langid.build([f"l{k}" for k in range(70)], [np.eye(1 << 16, dtype=bool)[0]] * 70, [1] * 70, 16)
    assert many.table.shape[1] == 2
    none = bitmask_langid.build([], [], [], 16)
    assert [r.lang_pred for r in bitmask_langid.predict(docs(spark, ["abc"]), none).collect()] == ["und"] * 3


def test_language_counts_against_sets(spark):
    """Without false positives the popcounts are those of plain sets, and rare languages are learned."""
    texts = ["the cat sat on the mat", "le chat dort sur le lit", "zqab"] * 3 + ["the bird on the lit", "zq zqx the", "été lit"]
    rows = [(k, t, ("en", "fr", "xx")[k % 3] if k < 9 else None) for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = bitmask_langid.fit(d, F.lit(True))
    assert model.langs == ["en", "fr", "xx"]  # "xx" has one text of one n-gram

    def grams(t):
        data = "".join(c if c.isalpha() else " " for c in t.lower()).encode()
        return [data[i : i + 4] for i in range(len(data) - 3) if data[i : i + 4].strip()]

    rate = {x: collections.Counter(g for _, t, y in rows if x == y for g in grams(t)) for x in model.langs}
    own = {x: {g for g, n in c.items() if n / c.total() >= bitmask_langid.SHARE * max(o[g] / max(o.total(), 1) for o in rate.values())} for x, c in rate.items()}
    got = {r.doc_id: r for r in bitmask_langid.predict(d, model).collect()}
    for k, t, _ in rows:
        count = {x: sum(g in own[x] for g in grams(t)) for x in model.langs}
        if sum(count.values()):
            best = max(model.langs, key=lambda x: (count[x], -model.langs.index(x)))
            assert got[k].lang_pred == best and got[k].score == pytest.approx(count[best] / sum(count.values()), abs=0.01), (t, count)
    assert bitmask_langid.table_bits(10**6) > bitmask_langid.table_bits(1000) >= bitmask_langid.BITS


def test_quality_scores_against_plain_averages(spark):
    """A score is the softmax of the averaged vectors, worked out word by word."""
    rng = np.random.default_rng(1)
    model = subword_quality.SubwordModel(rng.normal(size=(subword_quality.BUCKETS, subword_quality.DIM)), rng.normal(size=(subword_quality.DIM, 2)), rng.normal(size=2))
    texts = ["one two two three", "x", "", None, "é a\nb c " * 30, "same same same"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in subword_quality.score(d, model).collect()}
    from quillspark.llm import textscan as ts
    import pyarrow as pa

    shift = np.uint64(64 - subword_quality.BITS)
    for k, t in enumerate(texts):
        words = WORD.findall(t or "")
        h = [next(ts.blocks(pa.array([w]))).word_hashes(False)[0] for w in words]
        ids = [int(x >> shift) for x in h]
        with np.errstate(over="ignore"):
            ids += [int((subword_quality._REPEAT if a == b else a * ts.M1 + b * ts.M2) >> shift) for a, b in itertools.pairwise(h)]
            data = (t or "").encode()
            ids += [int(np.uint32(data[i] | data[i + 1] << 8 | data[i + 2] << 16) * np.uint32(0x9E3779B1) >> np.uint32(32 - subword_quality.BITS)) for i in range(len(data) - 2)]
        z = (model.vectors[ids].mean(0) if ids else np.zeros(subword_quality.DIM)) @ model.out + model.bias
        assert got[k] == pytest.approx(1 / (1 + np.exp(z[0] - z[1])), rel=1e-4), t


# ---- personal data


def brute_base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


PII = [
    "mail a.b+c@x-y.co.uk, a@b.c@d.e or é@x.com @@ x@y", "1.2.3.4.5 999.1.1.1 1.2.3.256 00.01.255.9 ü10.0.0.1", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 79927398713 4111111111111111",
    "call +1 (437) 555-0689 now or +49.30.1234567 x +1 2 +12345678901234567", 'token = "ffc3105535f423f352535e4ac53b5fefe076ac6d" then (415) 555-0132 here', "plain words only", "in 2024 the 12 rows of 3.5 kB", "a1b2 c3 page 17 of 20",
]


def test_personal_data(spark):
    d = docs(spark, [*PII, *ODD])
    known = d.where("doc_id is not null and coalesce(text, '') not like '%repeats'")
    for r in semicrf_pii.find(known).join(known.select("doc_id", "text"), "doc_id").collect():
        assert [tuple(s) for s in r.base] == brute_base(r.text or ""), r.text
    for t in ("x@", "@@a.b@c.d@e", "a@b.c.@d.e", "." * 9, "1..2.3.4.5.6", "1.2.3.4.5.6.7.8", "256.1.1.1.1", "0" * 50 + "1.2.3.4", "+1 2 3", "5 5-5  5", "4111 1111 1111 1111 1111", "a%@x-.y"):
        assert semicrf_pii.base_spans(t) == brute_base(t), t
    rng = np.random.default_rng(6)
    for _ in range(1500):
        t = "".join(rng.choice(list("ab@.-+ 0129é%")) for _ in range(rng.integers(1, 40)))
        assert semicrf_pii.base_spans(t) == brute_base(t), t
    w = semicrf_pii.model()
    assert [PII[4][a:b] for _, a, b in semicrf_pii.spans(PII[4], w)[1]] == ["ffc3105535f423f352535e4ac53b5fefe076ac6d", "(415) 555-0132"]
    assert all(semicrf_pii.spans(t, w) == ([], []) for t in PII[5:])
    red = semicrf_pii.redact(d)
    assert red.schema == d.schema and red.count() == d.count()
    row = red.where("doc_id = 4").first()
    assert red.where("doc_id = 5").first().text == PII[5]
    assert row.text == 'token = "[SECRET]" then [LOCAL_PHONE] here' and row.n_chars == len(row.text)
    assert semicrf_pii.find(empty(spark)).count() == 0


def segmentations(win, at=0):
    """All segmentations of a window's tokens from a place on, as (first, last + 1, label)."""
    sp = semicrf_pii
    if at == len(win.tokens):
        yield []
        return
    for rest in segmentations(win, at + 1):
        yield [(at, at + 1, sp.CERTAIN if win.certain[at] else sp.PLAIN), *rest]
    for end in range(at + 1, min(len(win.tokens), at + sp.MAX_TOKENS) + 1):
        if win.features(at, end):
            for k in range(1, len(sp.ADDED) + 1):
                for rest in segmentations(win, end):
                    yield [(at, end, k), *rest]


def worth(win, m, cuts):
    labels = [semicrf_pii.PLAIN, *(k for *_, k in cuts)]
    own = sum(m.scores(win.features(a, b))[k - 1] for a, b, k in cuts if semicrf_pii.PLAIN < k < semicrf_pii.CERTAIN)
    return own + sum(m.steps[a, b] for a, b in itertools.pairwise(labels))


def test_segmentation_is_the_best():
    """The programme's value is that of the best of all segmentations, enumerated."""
    m = semicrf_pii.model()
    for text in ('key = "9f8e7d6c5b4a39281706fedc11223344" (415) 555-0132', "a@b.co pwd: AbcdefGhijkl 1.2.3.4 12"):
        (win,) = semicrf_pii.windows(text, semicrf_pii.base_spans(text))
        best = max(worth(win, m, c) for c in segmentations(win))
        starts, ends = {a: i for i, (a, _) in enumerate(win.tokens)}, {b: i + 1 for i, (_, b) in enumerate(win.tokens)}
        got = {starts[a]: (starts[a], ends[b], semicrf_pii.ADDED.index(k) + 1) for k, a, b in semicrf_pii.decode(win, m)}
        cuts, at = [], 0
        while at < len(win.tokens):
            cuts.append(got.get(at, (at, at + 1, semicrf_pii.CERTAIN if win.certain[at] else semicrf_pii.PLAIN)))
            at = cuts[-1][1]
        assert worth(win, m, cuts) == pytest.approx(best) and got


def test_segment_likelihood():
    """The likelihood is that over all segmentations, and its slopes are those of small steps."""
    sp = semicrf_pii
    rng = np.random.default_rng(4)
    text = 'a@b.co key="Abcdefgh12" 7 (415)'
    (win,) = sp.windows(text, sp.base_spans(text))
    at = text.index("Abc")
    lattice = sp.Lattice([(win, [("secret", at, at + 10)]), (win, [])])
    m = sp.Model(rng.normal(size=(len(sp.ADDED), len(sp.FEATURES))), rng.normal(size=(sp.LABELS, sp.LABELS)))
    value, to_weights, to_steps = lattice.likelihood(m.weights, m.steps)
    every = [worth(win, m, c) for c in segmentations(win)]
    gold = [c for c in segmentations(win) if [x for x in c if sp.PLAIN < x[2] < sp.CERTAIN] in ([], [next((i, i + 1, 1) for i, t in enumerate(win.tokens) if t[0] == at)])]
    assert value == pytest.approx(sum(worth(win, m, c) for c in gold) - 2 * np.log(np.exp(every).sum()))
    for x, slope in ((m.weights, to_weights), (m.steps, to_steps)):
        for i, j in itertools.product(*map(range, x.shape)):
            d = np.zeros_like(x)
            d[i, j] = 1e-6
            moved = lattice.likelihood(m.weights + d, m.steps) if x is m.weights else lattice.likelihood(m.weights, m.steps + d)
            assert (moved[0] - value) / 1e-6 == pytest.approx(slope[i, j], abs=1e-3)


def test_secrets_without_digits():
    m = semicrf_pii.model()
    for text, want in (('password = "correcthorsebattery" x', ["correcthorsebattery"]), ("a key: value of it", []), ("the password is here", []), ("token = null", []), ("api_key: AbcdEfghIjklMnopQrst", ["AbcdEfghIjklMnopQrst"])):
        assert [text[a:b] for _, a, b in semicrf_pii.spans(text, m)[1]] == want, text


def test_long_runs_take_linear_time():
    import time

    m = semicrf_pii.model()
    began = time.time()
    for text in ("7" * 1_000_000, "@" * 200_000, "a" * 500_000 + "@", "a@" * 100_000, "0" * 6000 + ".1.1.1", "x@" + "a." * 200_000, "+" * 200_000 + "1"):
        semicrf_pii.spans(text, m)
    assert time.time() - began < 30


# ---- embeddings


def test_projection_dedup(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(700):
        v = rng.normal(size=24)
        rows.append((v, k % 3))
        if k % 5 == 0:
            rows += [(v + rng.normal(size=24) * s, k % 3) for s in (0.01, 0.05, 0.2)] + [(v, k % 3), (v, (k + 1) % 3), (2 * v, k % 3)]
    table = [(i, [float(x) for x in v], l) for i, (v, l) in enumerate(rows)]
    n = len(table)
    table += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] + [1.0] * 23, 1), (n + 3, [None] + [1.0] * 23, 1), (n + 4, [1.0] * 24, None), (n + 5, [1.0] * 3, 1), (n + 6, [], 1)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    got = {r.vec_id: r for r in projection_dedup.dedup(frame).collect()}
    unit = [np.array([np.float32(x) for x in v], float) if v and all(x is not None and np.isfinite(x) for x in v) and any(v) else None for _, v, _ in table]
    near = collections.defaultdict(set)
    for i, j in itertools.combinations(range(len(table)), 2):
        a, b = unit[i], unit[j]
        if a is not None and b is not None and len(a) == len(b) and table[i][2] is not None and table[i][2] == table[j][2]:
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                near[i].add(j)
                near[j].add(i)
    total = sum(map(len, near.values()))
    assert all(got[i].n_links <= len(near[i]) for i in got) and sum(r.n_links for r in got.values()) >= 0.9 * total > 500
    assert all(got[i].component_id == i and got[i].kept and got[i].n_links == 0 for i in range(n, n + 7))
    assert all(r.component_id <= r.vec_id and r.kept == (r.component_id == r.vec_id) for r in got.values())
    assert projection_dedup.dedup(frame.limit(0)).count() == 0


# ---- licences


def test_license_scan(spark):
    texts = [None, "", "word", "All rights reserved.", "x\nReleased under the MIT License.\nReleased under the MIT  license\ny", "This work is licensed under the\nGNU General Public License, version 2.\n\nmore text here", license_scan.TEMPLATES["mit"].replace(". ", ".\n") + "\n\nfoo bar", LONG, "the license of the work"]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, texts).where("doc_id > 0")).collect()}
    assert [got[k].licenses for k in (1, 2, 3, 4, 5, 7, 8)] == ["", "", "all-rights-reserved:1", "mit-notice:2", "gpl-2.0-notice:2", "", ""]
    assert got[6].licenses == "mit:2" and got[3].best_dice == 1.0 and got[8].best_dice is None
    assert license_scan.scan(empty(spark)).count() == 0


def test_license_windows(spark):
    t = license_scan.TEMPLATES
    code = "\n".join(f"def f{k}(x{k}): return x{k} + {k}" for k in range(400))
    prose = " ".join(f"word{k}" for k in range(300))
    bsd = "Copyright (c) 2001 A. Body\nAll rights reserved.\n\n" + t["bsd-2-clause"].replace(": 1.", ":\n\n1.").replace(". 2.", ".\n\n2.") + "\n\nTHIS SOFTWARE IS PROVIDED AS IS AND WITHOUT ANY WARRANTY OF ANY KIND.\n\n" + code
    apache = "\n".join(f"# {x}" for x in re.findall(r"(?:\S+\s*){1,9}", t["apache-2.0-header"])) + "\n" + code
    gpl = "Some words\nbefore it. This work is licensed under the GNU General\nPublic License, version 3. And some words\nafter it " + prose
    inline = f"{prose} {t['mit']} {prose} {t['cc-by-4.0-notice']} {prose}"
    twice = f"{prose} {t['isc']} {t['isc']} {prose}"
    texts = ["x", bsd, apache, gpl, inline, twice, prose + " all rights and reserved", f"{prose}\n\nReleased under the MIT License.\n\n{prose}"]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, texts).where("doc_id > 0")).collect()}
    assert [got[k].licenses for k in range(1, 8)] == ["all-rights-reserved:1,bsd-2-clause:1", "apache-2.0-header:1", "gpl-3.0-notice:1", "cc-by-4.0-notice:1,mit:1", "isc:2", "", "mit-notice:1"]
    assert got[4].best_dice == 1.0 and got[2].best_license == "apache-2.0-header"


def test_license_windows_against_all_windows():
    """The best window of a template is the best of all windows, tried one by one."""
    rng = np.random.default_rng(5)
    name = "gpl-2.0-notice"
    m = license_scan.Matcher({name: license_scan.TEMPLATES[name]}, (4, 5))
    body, own = license_scan.TEMPLATES[name].split(), m.sets[0][1]
    hits = 0
    for _ in range(150):
        w = [str(x) for x in rng.choice(["a", "b", "the", "work", "license", "gnu"], 25)]
        part = [x for x in body for _ in range(int(rng.choice([0, 1, 1, 1, 1, 1, 1, 2])))]
        w[9:9] = part
        if rng.random() < 0.3:
            w[3:3] = body[:6]
        data = " ".join(w).encode()
        dice = [2 * len(g & own) / (len(g) + len(own)) for i in range(len(w)) for j in range(i + 2, len(w) + 1) if (g := license_scan.bigrams(" ".join(w[i:j]).encode()))]
        found = m.windows(data, [0])
        assert max((2 * s / t for *_, s, t in found), default=0) == (max(dice) if max(dice) >= 0.8 else 0)
        for x, y, _, s, t in found:
            g = license_scan.bigrams(data[x:y])
            assert (s, t) == (len(g & own), len(g) + len(own))
        hits += bool(found)
    assert 20 < hits < 150


def test_size_bounds_lose_nothing():
    m = license_scan.Matcher(license_scan.TEMPLATES, (4, 5))
    rng = np.random.default_rng(4)
    for text in license_scan.TEMPLATES.values():
        w = text.split()
        for drop in (0, 1, 2, 4):
            segment = " ".join(x for i, x in enumerate(w) if i not in set(rng.integers(0, len(w), drop).tolist())).encode()
            own = license_scan.bigrams(segment)
            dice = {n: 2 * len(own & s) / (len(own) + len(s)) for n, s in m.sets if own}
            best = m.best(segment)
            top = max(dice.values(), default=0)
            assert (best is None) == (top < 0.8) and (best is None or 2 * best[1] / best[2] == top)


# ---- tool calls


def test_tool_calls(spark):
    schema = {"f": {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer", "minimum": 0, "maximum": 9}, "tags": {"type": "array", "items": {"enum": ["x", "y"]}}}}}
    calls = [
        (1, "a", "f", '{"tags":["x"],"n":1}', None), (1, "b", "f", '{"n":"é"}', "a"), (1, "c", "f", '{"n":10}', "b"), (1, "d", "f", "[1]", "zz"), (1, "e", "g", "{}", "c"), (1, "e", "g", "{}", "c"),
        (2, "p", "f", "{bad", "q"), (2, "q", "f", None, "p"), (2, "r", "f", '{"n":1,"z":0}', "q"), (None, "n", "f", "{}", None), (3, None, "f", "{}", None), (3, "t", "f", '{"n":2,"tags":["w"]}', "t"),
    ]
    results = [(1, "a", 'said "é"\n'), (1, "a", "zz"), (1, "o", None), (2, "p", "x"), (None, "a", "y")]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, name string, arguments string, after string").withColumn("depth", F.lit("clash"))
    rows = tool_calls.link(c, spark.createDataFrame(results, "conv_id long, call_id string, content string"), schema).collect()
    lone, got = [r for r in rows if r.conv_id is None], {(r.conv_id, r.call_id): r for r in rows if r.conv_id is not None}
    assert {k: (r.depth, r.status, r.n_same, r.problem) for k, r in got.items()} == {
        (1, "a"): (0, "linked", 1, None), (1, "b"): (1, "unanswered", 1, "n: not integer"), (1, "c"): (2, "unanswered", 1, "n: out of range"), (1, "d"): (0, "unanswered", 1, "not object"),
        (1, "e"): (3, "unanswered", 2, "no schema"), (1, "o"): (None, "orphan", 0, None), (2, "p"): (None, "linked", 1, "not JSON"), (2, "q"): (None, "unanswered", 1, "not JSON"),
        (2, "r"): (None, "unanswered", 1, "z: unknown"), (3, "t"): (None, "unanswered", 1, "tags: not in enum"),
        (3, None): (None, "unlinked", 1, "n: missing"),
    }
    assert got[1, "a"].n_answers == 2 and got[1, "b"].n_answers == 0
    assert sorted((r.status, r.n_same, r.n_answers, r.problem or "", r.message) for r in lone) == [
        ("unlinked", 0, 1, "", '{"arguments":null,"content":"y","id":"a","name":null}'), ("unlinked", 1, 0, "n: missing", '{"arguments":{},"content":null,"id":"n","name":"f"}'),
    ]
    assert json.loads(got[1, "a"].message) == {"arguments": {"n": 1, "tags": ["x"]}, "content": 'said "é"\n', "id": "a", "name": "f"}
    assert got[1, "a"].message.startswith('{"arguments":{"n":1,"tags":["x"]},"content":')
    none = tool_calls.link(c.limit(0), spark.createDataFrame([], "conv_id long, call_id string, content string"), schema)
    assert none.count() == 0


def test_canonical_json():
    one = lambda t: tool_calls.one("f", t, {"f": {"type": "object", "properties": {"n": {"type": "integer"}}}})
    assert one('{"n": 1.0, "a": [1e21, 1e-7, 0.00001, -0.0, 1e16, 2.50]}') == ('{"a":[1e+21,1e-7,0.00001,0,10000000000000000,2.5],"n":1}', None)
    for bad in ('{"n": Infinity}', '{"n": NaN}', '{"n": -Infinity}', '{"n": 1e999}', '{"n": ' + "9" * 5000 + "}", "", None, "{"):
        assert one(bad) == (None, "not JSON")
    assert one('{"n": "\\ud800 \\ud83d\\ude00"}')[0] == '{"n":"\\ud800 \U0001f600"}'
    assert one("[" * 150 + "]" * 150)[1] == "not object" and one("[" * 250 + "]" * 250)[1] == "too deep" and one("[" * 200_000 + "]" * 200_000) == (None, "too deep")
    assert one('{"b":1,"a":2,"a":3}')[0] == '{"a":3,"b":1}' and one('{"n":1.5}')[1] == "n: not integer"


def test_odd_arguments_through_spark(spark):
    texts = ['{"n": Infinity}', '{"s": "\\ud800"}', "[" * 5000 + "]" * 5000, "{}", None, '{"s": "' + "x" * 2_000_000 + '"}']
    calls = spark.createDataFrame([(1, str(k), "f", t, None) for k, t in enumerate(texts)], "conv_id long, call_id string, name string, arguments string, after string")
    results = spark.createDataFrame([(1, "0", "y" * 2_000_000)], "conv_id long, call_id string, content string")
    got = {r.call_id: r for r in tool_calls.link(calls, results, {"f": {"type": "object"}}).collect()}
    assert [got[str(k)].problem for k in range(6)] == ["not JSON", None, "too deep", None, "not JSON", None]
    assert len(got["0"].message) > 2_000_000 and len(got["5"].message) > 2_000_000 and "\\ud800" in got["1"].message


def test_long_chain(spark):
    calls = spark.createDataFrame([(1, str(k), "f", "{}", str(k - 1)) for k in range(300)], "conv_id long, call_id string, name string, arguments string, after string")
    got = tool_calls.depths(calls).collect()
    assert all(r.depth == int(r.call_id) for r in got) and len(got) == 300


# ---- queries and pipeline


def test_contract_columns(spark):
    kinds = dict(queries.op2_ngram_jaccard(spark, SF).dtypes)
    assert {k: kinds[k] for k in ("doc_id", "n_shingles", "n_similar", "component_id")} == {"doc_id": "bigint", "n_shingles": "bigint", "n_similar": "bigint", "component_id": "bigint"}
    row = queries.op7_semicrf_pii(spark, SF).where("n_email > 0").first()
    assert len(row.base_sha256) == 64 and "email:" in row.spans
    assert zlib.crc32(b"12") % 4 == spark.range(12, 13).select(F.crc32(F.col("id").cast("string").cast("binary")) % 4).first()[0]


def test_query_wrappers(spark):
    """What the registered queries derive: folds, verdicts, counts and digests, for every document."""
    from tokenizers import Tokenizer

    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fold = lambda i, m: zlib.crc32(str(i).encode()) % m
    got = queries.op6_subword_quality(spark, SF).collect()
    assert len(got) == len(rows) and all(r.held_out == (fold(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.7) for r in got)
    got = queries.op8_bitmask_langid(spark, SF).collect()
    assert len(got) == len(rows) and all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in got)
    got = queries.op3_line_crf(spark, SF).collect()
    assert len(got) == len(rows) and all(tuple(r[1:6]) == base(rows[r.doc_id].text) and not (r.kept and r.base_failed) for r in got)
    t = Tokenizer.from_file(queries.tokenizer_path())
    got = queries.op4_chunked_bpe(spark, SF).collect()
    for r in got:
        ids = t.encode(rows[r.doc_id].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert len(got) == len(rows)
    got = queries.op9_projection_dedup(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/embeddings.parquet").count() and all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("name", ["quality_base_counts", "pii_base_matches"])
def test_base_parts_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(queries.ORACLES[name])
    names, want = [d[0] for d in found.description], found.fetchall()
    got = [tuple(r) for r in queries.QUERIES[name](spark, SF).select(*names).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100


def test_pipeline_stages_on_odd_rows(spark):
    """Empty tables, nulls, repeated rows and ids pass through every stage."""
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c " * 30, "en", None, 180), (3, LONG, "en", "s", len(LONG)), (3, LONG, "en", "s", len(LONG))]
    for rows in ([], odd):
        d = spark.createDataFrame(rows, schema)
        for name, stage in cp.STAGES:
            out = stage(spark, d, SF)
            n = out.count()
            assert (rows or n == 0) and (name == "BPE encoding" or out.columns == cp.COLUMNS), name


def test_pipeline_against_plain_python(spark):
    """The five stages once more over the smallest table, without Spark where that is plain."""
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in cp.run(spark, SF).collect())
    kept = {r.doc_id for r in line_quality.score(d, line_quality.fit(d, spark.read.parquet(f"{SF}/labels.parquet"))).where("kept").collect()}
    rows = sorted((r.doc_id, r.text, r.source) for r in d.collect() if r.doc_id in kept)
    _, links = brute_links([t for _, t, _ in rows])
    comp = list(range(len(rows)))
    for _ in rows:
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    rows = [r for k, r in enumerate(rows) if comp[k] == k]
    w = semicrf_pii.model()
    clean = [(i, semicrf_pii.redacted(t, sum(semicrf_pii.spans(t, w), [])), s) for i, t, s in rows]
    table = spark.createDataFrame(clean, "doc_id long, text string, source string")
    times = collections.Counter(r.doc_id for r in poisson_mix.mix(table).collect())
    t = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, text, _ in clean:
        ids = np.array(t.encode(text, add_special_tokens=False).ids, "<u4")
        want += [(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] * times[i]
    assert got == sorted(want) and len(links) > 3


def test_jaccard_stage_keeps_one_of_each(spark):
    import corpus_pipeline as cp

    rows = [(1, "a b c d e f g h", "en", "s", 1), (1, "a b c d e f g h", "en", "s", 1), (2, "a b c d e f g h", "en", "s", 1), (1, "other words stand in this row", "en", "s", 1), (None, "a row of no id at all", None, None, None), (None, "a row of no id at all", None, None, None), (5, "", "en", "s", 0), (5, "", "en", "s", 0), (6, None, "en", "s", None)]
    out = cp.jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    assert out.columns == cp.COLUMNS
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == sorted([("1", rows[0][1]), ("1", rows[3][1]), ("None", rows[4][1]), ("5", ""), ("5", ""), ("6", "")])


def python_nodes(plan):
    """Most Python nodes that one task of a plan runs: each holds a worker of its own, which the executor keeps."""
    most, path = 0, []
    for line in plan.splitlines():
        depth = len(re.match(r"[ :]*(?:[+:]- )?", line).group())
        name = re.sub(r"^\*\(\d+\) ", "", line[depth:])
        while path and path[-1][0] >= depth:
            path.pop()
        n = 0 if re.match(r"\w*Exchange\b", name) else (path[-1][1] if path else 0) + bool(re.match("MapInArrow|FlatMapGroupsInArrow|ArrowEvalPython", name))
        path.append((depth, n))
        most = max(most, n)
    return most


def test_pipeline_tasks_hold_one_worker(spark, monkeypatch):
    """A task with two Python nodes takes two workers, so an executor of two cores keeps four from there on."""
    import corpus_pipeline as cp

    plans = []
    kind = type(spark.range(1))
    for name in ("mapInArrow", "join", "unionByName"):

        def call(self, *args, _own=getattr(kind, name), **more):
            out = _own(self, *args, **more)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            return out

        monkeypatch.setattr(kind, name, call)
    chained = spark.range(9).mapInArrow(lambda x: x, "id long")
    assert python_nodes(chained.mapInArrow(lambda x: x, "id long")._jdf.queryExecution().executedPlan().toString()) == 2
    assert python_nodes(chained.repartition(2).mapInArrow(lambda x: x, "id long")._jdf.queryExecution().executedPlan().toString()) == 1
    plans.clear()
    cp.run(spark, SF)
    assert len(plans) > 20 and max(map(python_nodes, plans)) == 1, next(p for p in plans if python_nodes(p) > 1)


def test_bitmap_of_numbered_values(spark):
    """A bitmap of what ``number`` makes of a column is that of the numbers themselves, for an empty table too."""
    rows = [(bytearray(hashlib.md5(str(k).encode()).digest()),) for k in range(500)]
    for some in (rows, []):
        d = spark.createDataFrame(some, "digest binary")
        own = spark.createDataFrame([(int(x),) for x in chunked_bpe.keys([bytes(r[0]) for r in some])], "key long")
        got = common.bitmap(d, "digest", lambda column: chunked_bpe.keys(column.to_pylist()))
        assert (got == common.bitmap(own, "key")).all() and bool(got.any()) == bool(some)
