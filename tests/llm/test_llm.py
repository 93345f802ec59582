"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import chat, common, decontaminate, embeddings, lm, nearcopies, pieces, queries, repeats, secrets, simhash, toxicity

DOC = "doc_id long, text string"
ODD = [(1, ""), (2, None), (3, "   "), (4, "wort"), (None, "zwei wörter"), (4, "wort"), (5, "x" * 30000), (6, "a b c d e f g h " * 3000)]


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


class Union:
    def __init__(self, n):
        self.p = list(range(n))

    def find(self, x):
        while self.p[x] != x:
            self.p[x] = self.p[self.p[x]]
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in ODD], "doc_id long, text string, k int, fp string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# --- pieces ---------------------------------------------------------------


def test_pieces_equal_the_library():
    m = pieces.model(queries.PIECE_MODEL)
    r = random.Random(5)
    letters = " " * 25 + "aeiouthn" * 4 + "\n\té中梦😀▁.0123,ἥ\x00ſK\"'-_"
    vocab = list(m.ids)
    texts = ["", " ", "  ", "a  ", "\n", "▁", " " * 100, "<s> <0x0A>", "x" * 3000, "the " * 500]
    for _ in range(3000):
        texts.append("".join(r.choice(letters) for _ in range(r.choice([1, 5, 40]))).replace(" ", " " * r.choice([1, 1, 1, 5])))
        texts.append("".join(r.choice(vocab) for _ in range(r.randint(1, 6))).replace("▁", " "))
    for t in texts:
        assert m.encode(t) == m.sp.encode(t), repr(t)


def test_pieces_rows(spark, odd, empty, docs):
    got = pieces.encode_documents(odd, queries.PIECE_MODEL, keep=("doc_id", "k", "fp"), ids=True).collect()
    assert len(got) == len(ODD)
    sp = pieces.model(queries.PIECE_MODEL).sp
    for (_, t), r in zip(ODD, got):
        ids = sp.encode(t or "")
        assert (r.n_tokens, r.ids_sha256, r.ids, r.decoded) == (len(ids), sha(",".join(map(str, ids))), ids, sp.decode(ids))
        assert r.decoded == (t or "")
    assert pieces.encode_documents(empty, queries.PIECE_MODEL).count() == 0


# --- simhash --------------------------------------------------------------


def slow_fingerprint(text, words=3):
    import xxhash

    w = text.encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def component_ids(ids, fps, radius=2):
    u = Union(len(fps))
    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= radius):
            u.join(i, int(j))
    groups = defaultdict(list)
    for i in range(len(f)):
        groups[u.find(i)].append(ids[i])
    return [min((x for x in groups[u.find(i)] if x is not None), default=None) for i in range(len(f))]


def test_simhash_brute_force(docs, odd):
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        rows = df.collect()
        got = simhash.components(df).collect()
        fps = [slow_fingerprint(r.text or "") for r in rows]
        want = Counter(zip((r.doc_id for r in rows), fps, component_ids([r.doc_id for r in rows], fps)))
        assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


@pytest.mark.parametrize(("hot", "radius"), [(2, 2), (6, 2), (1000, 2), (2, 1), (1000, 1)])
def test_links_hot_and_cold(spark, hot, radius):
    r = np.random.default_rng(2)
    x = np.repeat(r.integers(0, 2**63, 8, dtype=np.uint64), 40)
    for _ in range(2):
        x = x ^ (np.uint64(1) << r.integers(0, 64, len(x), dtype=np.uint64))
    x = np.unique(x).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(v,) for v in x], "fp long"), radius, hot)
    got = {r.node: r.component for r in common.connected_components(links).collect()}
    assert [got.get(v, v) for v in x] == component_ids(x, [v % (1 << 64) for v in x], radius)


def test_tables_are_dropped(spark, sf):
    mark = common.made()
    df = queries.QUERIES["op2_simhash"](spark, sf)
    left = common._made[mark:]
    assert {p.rsplit("/", 1)[1] for p in left} <= common._tables_of(df) and 0 < len(left) < 8 and df.count() > 0
    common.release(mark, spark.range(1))
    assert common.made() == mark
    with pytest.raises(Exception, match="(?i)not exist|not_exist"):
        df.count()


def test_simhash_empty(spark, empty):
    assert simhash.components(empty).count() == 0


def test_components_of_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# --- near copies ----------------------------------------------------------


def test_near_copies(spark, docs, odd, empty):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    r, texts = random.Random(3), [(x.doc_id, x.text) for x in rows]
    for i, x in enumerate(rows[:20]):
        w = x.text.split()
        for _ in range(max(1, len(w) // 100)):
            w[r.randrange(len(w))] = "anders"
        texts.append((10_000 + i, " ".join(w)))
    sets = [set(nearcopies.shingle_hashes(t.encode()).tolist()) for _, t in texts]
    u = Union(len(texts))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                u.join(i, j)
    want = {texts[i][0] for i in range(len(texts)) if u.find(i) == i}
    got = {x.doc_id for x in nearcopies.keep_one(spark.createDataFrame(texts, DOC)).collect()}
    assert got == want
    clash = odd.withColumnsRenamed({"k": "row", "fp": "n"})
    assert nearcopies.keep_one(clash).count() == 5
    left = nearcopies.keep_one(odd)
    assert left.columns == odd.columns
    assert sorted((x.doc_id or -1) for x in left.collect()) == [-1, 1, 4, 5, 6]  # nothing and spaces alone are one text
    assert nearcopies.keep_one(empty).count() == 0


def test_short_texts_share_a_key():
    r = np.random.default_rng(17)
    for n in range(1, nearcopies.SHORT + 1):
        for _ in range(60):
            most = int(n / 0.8 + 1e-9)
            both = int(r.integers(int(np.ceil(0.8 * n - 1e-9)), n + 1))
            extra = int(r.integers(0, most - n + 1))
            if both < 0.8 * (n + extra) - 1e-9 + 0.8 * (n - both):
                continue
            h = np.unique(r.integers(0, 2**63, n + extra + n - both, dtype=np.uint64))
            x = np.concatenate((h[:0], r.permutation(h)))
            a, b = np.sort(x[:n]), np.sort(np.concatenate((x[:both], x[n:])))
            assert set(nearcopies.bag_keys(a).tolist()) & set(nearcopies.bag_keys(b).tolist())


@pytest.mark.parametrize("n", [65, 80, 100, 120, 250, 510, 900, 3000])
def test_recall_of_longer_texts(n):
    r = np.random.default_rng(n)
    missed = 0
    for i in range(1500):  # similarity 0.8, the least that counts, with the smaller inside the larger or both changed
        more = n // 4 if i % 2 else n // 9
        h = r.permutation(r.integers(0, 2**63, n + more, dtype=np.uint64))
        a, b = (h[:n], h) if i % 2 else (h[:n], h[more:])
        missed += not set(nearcopies.bag_keys(np.sort(a)).tolist()) & set(nearcopies.bag_keys(np.sort(b)).tolist())
    assert missed <= 3


def test_class_key_tells_equal_hashes_apart(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], DOC)
    true = F.xxhash64
    monkeypatch.setattr(nearcopies.F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 else true(*c))
    keys = {r.doc_id: r.k for r in df.select("doc_id", nearcopies.class_key(df).alias("k")).collect()}
    assert keys[1] == keys[3] and keys[4] == keys[5] and len(set(keys.values())) == 3


def similar_pairs(sets, least=0.8):
    at = range(len(sets))
    return [(i, j) for i in at for j in at[:i] if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9]


def test_near_copies_of_a_template(spark):
    # many texts that share 170 of 200 shingles are no near copies, but each has one of its own
    r = random.Random(41)
    word = lambda: f"w{r.randrange(10**9)}"
    template, texts = [word() for _ in range(174)], []
    for _ in range(60):
        mine = template + [word() for _ in range(30)]
        texts += [mine, mine[:184] + [word() for _ in range(20)]]
    texts = [(i, " ".join(w)) for i, w in enumerate(texts)]
    sets = [set(nearcopies.shingle_hashes(t.encode()).tolist()) for _, t in texts]
    u = Union(len(sets))
    for i, j in similar_pairs(sets):
        u.join(i, j)
    want = {u.find(i) for i in range(len(sets))}
    assert len(want) == 60
    classes = {x.k: x.c for x in nearcopies.group_classes(spark.createDataFrame(texts, DOC)).collect()}
    assert len(classes) == 120 and len(set(classes.values())) == 60
    assert nearcopies.keep_one(spark.createDataFrame(texts, DOC)).count() == 60


@pytest.mark.parametrize("seed", range(3))
def test_large_group_without_leaders(spark, seed, monkeypatch):
    monkeypatch.setattr(nearcopies, "TILE", 16)
    r = np.random.default_rng(seed)
    # hashes that most sets have, and few or no rare ones: only the tiles find these pairs
    sets = []
    for i in range(150):
        common = r.choice(60, r.integers(44, 60), replace=False)
        sets.append(set(common.tolist()) | set(range(1000 + i * 20, 1000 + i * 20 + int(r.integers(0, 12)))))
    sets += [set(range(10**6 + i * 10, 10**6 + i * 10 + 9 - j)) for i in range(20) for j in (0, 1)] + [set(), set()]
    u = Union(len(sets))
    for i, j in similar_pairs(sets):
        u.join(i, j)
    df = spark.createDataFrame([(i, bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in enumerate(sets)], "k long, s binary")
    got = nearcopies._large(df, df.select(F.lit(7).cast("long").alias("g"), "k"), spark.createDataFrame([], "a long, b long"), 0.8)
    c = {x.node: x.component for x in got.collect()}
    want = [u.find(i) for i in range(len(sets))]
    assert len(set(want)) > 20
    same = defaultdict(set)
    for i, w in enumerate(want):
        same[w].add(c.get(i, i))
    assert all(len(x) == 1 for x in same.values()) and len(set.union(*same.values())) == len(same)


# --- decontamination ------------------------------------------------------


def test_decontaminate_brute_force(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in bench.collect()]
    extra = [(9000 + i, "vor " * 50 + " ".join(w).upper() + " nach" * 50) for i, (_, w) in enumerate(items[:5])]
    extra += [(9100, " ".join(items[0][1][: len(items[0][1]) // 2])), (9101, None), (9102, "")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, DOC))
    want = set()
    for r in df.collect():
        w = decontaminate.words_of(r.text or "")
        have = decontaminate.shingles(w)
        for i, words in items:
            s = decontaminate.shingles(words)
            if len(s & have) >= 0.8 * len(s):
                want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaked(df, bench).collect()}
    assert got == want and len(want) >= 5


def test_wand_finds_all_over_threshold():
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(3, 12)))) for i in range(120)]
    terms = [decontaminate.terms_of(decontaminate.words_of(t)) for _, t in items]
    df = Counter(t for x in terms for t in set(x))
    mean = sum(map(len, terms)) / len(terms)
    for theta in (0.2, 0.5, 0.9):
        ix = decontaminate.Index.build(items, df, len(items), mean, theta)
        for _ in range(60):
            q = " ".join(r.choice(items)[1] for _ in range(3))
            _, ts = ix.find(decontaminate.words_of(q))
            query = np.unique(ts).tolist()
            scores = defaultdict(float)
            for t in query:
                for i, x in ix.postings[t]:
                    scores[i] += x
            got = dict(ix.search(query))
            assert set(got) == {i for i, x in scores.items() if x >= theta - 1e-9}
            assert all(math.isclose(got[i], scores[i]) for i in got)


def test_decontaminate_empty_and_nulls(spark, odd, empty):
    none = spark.createDataFrame([(1, None), (None, "x y z"), (2, "...")], "item_id long, text string")
    out = decontaminate.annotate(odd, none)
    assert out.count() == len(ODD) and out.where(F.size("matches") > 0).count() == 0
    one = spark.createDataFrame([(1, "wort"), (1, "zwei wörter")], "item_id long, text string")
    assert decontaminate.leaked(odd, one).count() == 3
    assert decontaminate.annotate(empty, one).count() == 0


# --- secrets --------------------------------------------------------------


def slow_entropy(s, rule):
    import re

    if re.search(rule.allow, s):
        return []
    w, hit = rule.window, [False] * len(s)
    for i in range(len(s) - w + 1):
        n = Counter(s[i : i + w])
        if -sum(c / w * math.log2(c / w) for c in n.values()) >= secrets._class_bits(s, rule) - 1e-12:
            hit[i : i + w] = [True] * w
    out, i = [], 0
    while i < len(s):
        if hit[i]:
            j = i
            while j < len(s) and hit[j]:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def test_entropy_by_increments():
    r, rule = random.Random(6), secrets.EntropyRule()
    for _ in range(300):
        s = "".join(r.choice(r.choice(["abc1", "0123456789abcdef", "ABCDEFGHIJKLMNOPqrstuvwxyz0123456789+/"])) for _ in range(r.randint(20, 90)))
        assert secrets.entropy_spans(s, rule) == slow_entropy(s, rule)


def test_secret_base(spark, odd, empty):
    def kinds(t):
        return [(secrets.KINDS[k], t[a:b]) for a, k, b in secrets.find_secrets(t)[0]]

    assert kinds("é PassWord = 'abcdef' token:short") == [("assign", "PassWord = 'abcdef")]
    assert kinds("apikey:abc api_key: secret=longvalue") == [("assign", "api_key: secret=longvalue")]
    assert kinds("AKIA" + "A" * 15) == [] and kinds("xAKIA" + "A" * 16 + "b")[0] == ("access", "AKIA" + "A" * 16)
    assert kinds("0" * 23) == [] and kinds("z" + "ab12" * 6 + "G") == [("hex", "ab12" * 6)]
    assert kinds("ſecret=abcdefgh to\u212aen=abcdefgh") == []
    t = "key ghp_Zx9Qw3Er7Ty1Ui5Op2As8Df4Gh6Jk end EXAMPLE_Zx9Qw3Er7Ty1Ui5Op2As8Df4"
    assert len(secrets.find_secrets(t)[1]) == 1
    assert secrets.mask_secrets(t).startswith("key [SECRET") and "EXAMPLE" in secrets.mask_secrets(t)
    got = secrets.scan(odd, keep=("doc_id", "k")).collect()
    assert len(got) == len(ODD) and all(r.spans == "" and r.base_sha256 == sha("") for r in got)
    assert secrets.scan(empty).count() == 0
    m = secrets.mask_documents(odd)
    assert m.columns == odd.columns and [r.text for r in m.collect()] == [t for _, t in ODD]
    clash = odd.withColumnsRenamed({"k": "masked", "fp": "row"})
    assert secrets.mask_documents(clash).collect() == clash.collect()


def slow_base(text):
    """Base spans by trying every start in turn, without the operator's patterns."""
    value, word = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"), ("password", "passwd", "secret", "token", "api_key", "apikey")
    upper, low = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), set("0123456789abcdef")
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)

    def run(i, chars):
        while i < len(text) and text[i] in chars:
            i += 1
        return i

    def assign(i):
        for w in word:
            if fold.startswith(w, i):
                j = i + len(w)
                j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                j = run(j, " ")
                if text[j : j + 1] not in (":", "="):
                    continue
                first = j + 1
                j = run(first, " ")
                quoted = j + (text[j : j + 1] in ("'", '"') and text[j : j + 1] != "")
                if run(quoted, value) > quoted:
                    return run(quoted, value), run(quoted, value) - quoted >= 6
        return None

    def access(i):
        end = run(i + 4, upper)
        return (end, end - i >= 20) if text.startswith("AKIA", i) and end > i + 4 else None

    def hexa(i):
        end = run(i, low)
        return (end, end - i >= 24) if end > i else None

    out = []
    for kind, at in enumerate((assign, access, hexa)):
        i = 0
        while i < len(text):
            m = at(i)
            if m is None:
                i += 1
            else:
                if m[1]:
                    out.append((i, kind, m[0]))
                i = m[0]
    return sorted(out)


def test_secret_base_brute_force(docs):
    r = random.Random(12)
    parts = ["password", "PASSWD", "secret", "Token", "api_key", "APIKEY", "api", "key", "AKIA", '"', "'", " ", "  ", ":", "=", "a1b2c3", "0" * 23, "deadbeef" * 3, "ABCDEFGH12345678", "é", "ſ", "\u212a", "\n", "-", "x", "/"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(6000)] + [x.text or "" for x in docs.collect()]
    assert sum(bool(slow_base(t)) for t in texts) > 500
    for t in texts:
        assert secrets.find_secrets(t)[0] == slow_base(t), t


def test_secrets_in_linear_time():
    import time

    r = random.Random(13)
    line = lambda: "token=" + "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(30)) + " "
    text = "".join(line() for _ in range(28_000))
    start = time.process_time()
    base, added = secrets.find_secrets(text)
    assert len(base) == 28_000 and not added and time.process_time() - start < 5


# --- classifiers ----------------------------------------------------------


@pytest.mark.parametrize(("name", "label", "folds", "fold"), [("op5_toxicity", "toxic", 5, 0), ("op8_quality", "quality", 3, 1)])
def test_classifier_held_out(spark, name, label, folds, fold):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % folds == fold)).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    m = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m[label]).mean() >= 0.9


def test_classifiers_odd_rows(spark, odd, empty):
    from geoloom.llm import bytecnn

    assert bytecnn.train([], [], np.array([])).w3.sum() == 0
    net = bytecnn.train([bytecnn.chunks_of(b"a")], [bytecnn.draws_of(b"a")[1]], np.array([1]))
    got = bytecnn.classify(odd, net, keep=("doc_id", "k")).collect()
    assert len(got) == len(ODD) and all(r.score > 0.9 for r in got)
    assert bytecnn.classify(empty, net).count() == 0
    nothing = np.zeros((0, len(toxicity.FEATURES)))
    m = toxicity.train(nothing, np.zeros(0), np.zeros(0), frozenset(), frozenset())
    assert all(0 <= r.score <= 1 for r in toxicity.classify(odd, m).collect())
    assert toxicity.classify(empty, m).count() == 0
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    toxicity.fit(odd, none)
    bytecnn.fit(odd, none)


def test_cnn_covers_whole_text():
    from geoloom.llm import bytecnn

    for n in (0, 1, 511, 512, 513, 2000, 5000):
        raw = bytes(i % 256 for i in range(n))
        x = bytecnn.chunks_of(raw)
        seen = np.zeros(max(1, (len(x) - 1) * bytecnn.STEP + bytecnn.CHUNK), np.uint16)
        for i, c in enumerate(x):
            seen[i * bytecnn.STEP : i * bytecnn.STEP + bytecnn.CHUNK] = c
        assert (seen[:n] - 1).astype(np.uint8).tobytes() == raw and not seen[n:].any()


def test_cnn_draws_over_whole_text():
    from geoloom.llm import bytecnn

    raw = bytes(random.Random(1).choice(b"abcdef ") for _ in range(400_000))
    number, place = bytecnn.draws_of(raw)
    assert place.shape == (bytecnn.EPOCHS, bytecnn.TRAIN_CHUNKS) and number.max() > 700 > 300 > number.min()
    assert all(len(set(p)) == bytecnn.TRAIN_CHUNKS for p in place.tolist()) and len(number) > 40
    short, place = bytecnn.draws_of(raw[:1000])
    assert short.tolist() == [0, 1, 2] and (place == [0, 1, 2]).all()


def slow_quality(net, raw):
    """One document's probability, place by place and without batches."""
    from geoloom.llm import bytecnn as q

    out = []
    for at in range(0, max(1, len(raw) - q.CHUNK + q.STEP), q.STEP):
        c = raw[at : at + q.CHUNK]
        most, share, places = np.full(q.FILTERS, 0.0), np.zeros(q.FILTERS), 0
        for p in range(0, q.CHUNK - q.TAPS + 1, q.STRIDE):
            if p >= len(c):
                break
            z = np.zeros((q.TAPS, q.EMBED + 1))
            for k in range(min(q.TAPS, len(c) - p)):
                i = p + k
                four = lambda j: c[j : j + 4].ljust(4, b"\xff")
                match = i <= q.CHUNK - 4 and any(four(i) == four(i - lag) for lag in range(1, min(q.LAGS, i) + 1))
                z[k] = [*net.emb[c[i] + 1], float(match)]
            r = z.reshape(-1) @ net.conv + net.cb
            most, share, places = np.maximum(most, r), share + np.clip(r, 0, 1), places + 1
        h = np.maximum(np.concatenate((most, share / max(1, places))) @ net.w1 + net.b1, 0)
        out.append((h @ net.w2 + net.b2)[0])
    logit = max(out) * net.w3[0] + np.mean(out) * net.w3[1] + net.b3[0]
    return 1 / (1 + np.exp(-logit))


def test_cnn_score_brute_force():
    from geoloom.llm import bytecnn

    r = random.Random(2)
    texts = [b"", b"\0", b"\0" * 700, b"abcabcabc" * 90, "zwei Wörter".encode()] + [bytes(r.randrange(255) for _ in range(n)) for n in (300, 512, 513, 1500)]
    net = bytecnn.new_net(3)
    assert np.allclose(bytecnn.score(net, texts), [slow_quality(net, t) for t in texts], atol=1e-5)
    assert bytecnn.score(net, [b"\0" * 700])[0] != bytecnn.score(net, [b""])[0]


def test_cnn_gradients():
    from geoloom.llm import bytecnn

    r = np.random.default_rng(0)
    net = bytecnn.new_net()
    for name in net.names():
        setattr(net, name, getattr(net, name).astype(np.float64))
    x = r.integers(1, 257, (5, bytecnn.CHUNK)).astype(np.uint16)
    owner, y, w = np.array([0, 0, 1, 2, 2]), np.array([1, 0, 1], np.float32), np.ones(3, np.float32)

    def loss():
        p = bytecnn.sigmoid(bytecnn.forward(net, x, owner, 3)[0].astype(np.float64))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = bytecnn.gradients(net, x, owner, y, w)
    for name in ("w1", "b1", "w2", "b2", "w3", "conv", "cb", "emb"):
        a = getattr(net, name)
        if name == "emb":
            a = a[x[0, 0]]
            g[name] = g[name][x[0, 0]]
        at = tuple(r.integers(0, s) for s in a.shape)
        old = a[at]
        a[at] = old + 1e-6
        up = loss()
        a[at] = old - 1e-6
        down = loss()
        a[at] = old
        assert abs((up - down) / 2e-6 - g[name][at]) < 1e-5 + 1e-3 * abs(g[name][at]), name


def test_toxic_features_by_hand():
    flags = toxicity.Flags(frozenset({"bloed"}), frozenset({"hass"}))
    got = dict(zip(toxicity.FEATURES, toxicity.featurize("You IDIOT! du bist bloedmann und hassvoll... 1d1ot nooo Haus?", flags)))
    want = dict(given=2 / 10, strong=1 / 10, weak=1 / 10, any_hits=3, hit_rate=0.3, best_window=3, near_second=2, hits_per_second=2 / 3, second=0.2, all_caps=0.1, hidden=0.1, long=0.1)
    assert {k: round(got[k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}
    size = len("You IDIOT! du bist bloedmann und hassvoll... 1d1ot nooo Haus?")
    assert (got["exclaim"], got["question"], got["punct"]) == (1 / size, 1 / size, 5 / size)
    assert toxicity.featurize("  ", flags) == [0.0] * len(toxicity.FEATURES)


def test_learned_stems_brute_force(spark):
    r = random.Random(21)
    words = ["alpha", "beta", "gammas", "deltas", "boeser", "boese", "rest", "viele"]
    rows = []
    for i in range(160):
        y = i % 2
        rows.append((y, " ".join(r.choice(words[4 * (y and r.random() < 0.7) :][:6]) for _ in range(6)) + f" eigenwort{i // 3 if i % 5 else i}"))
    groups = defaultdict(set)
    for y, t in rows:
        key = min(zlib.crc32(w.encode()) for w in t.split() if len(w) > 5)
        groups[y, key] |= {s for w in t.split() for s in toxicity.stems(w)}
    count = [Counter(), Counter()]
    for (y, _), s in groups.items():
        count[y].update(s)
    n = [sum(y == v for y, _ in groups) for v in (0, 1)]
    want = [{s for s, c in count[1].items() if c >= max(5, toxicity.STEM_SHARE * n[1]) and c / n[1] >= k * (count[0][s] + 1) / n[0]} for k in (toxicity.STEM_RATIO, toxicity.STEM_RATIO / 3)]
    got = toxicity.learn_stems(spark.createDataFrame(rows, "y int, t string"))
    assert [set(x) for x in got] == want and want[1]


def test_first_tree_brute_force():
    r = np.random.default_rng(3)
    x = r.integers(0, 6, (400, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (x[:, 0] > 4)).astype(float)
    trees, base = toxicity.boost(x, y, rounds=1, depth=1)
    p = 1 / (1 + math.exp(-base))
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = {(j, c): sum(g[m].sum() ** 2 / (h[m].sum() + 2) for m in (x[:, j] <= c, x[:, j] > c)) for j in range(3) for c in range(5)}
    j, c = max(gain, key=gain.get)
    assert (trees[0].feature[0], trees[0].cut[0]) == (j, c)
    assert np.allclose(trees[0].value, [-0.15 * g[m].sum() / (h[m].sum() + 2) for m in (x[:, j] <= c, x[:, j] > c)])


def test_isotonic_brute_force():
    r = np.random.default_rng(7)
    x, y = np.arange(40.0), (r.random(40) < np.linspace(0, 1, 40)).astype(float)
    kx, ky = toxicity.isotonic(x, y)
    # the greatest rising fit: at each place the largest mean from before to the least mean after
    fit = [max(min(y[a:b].mean() for b in range(i + 1, 41)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(np.interp(kx[1:-1], x, fit), ky[1:-1], atol=0.02)


def test_isotonic_rises():
    r = np.random.default_rng(1)
    x = r.normal(size=500)
    _, y = toxicity.isotonic(x, (x + r.normal(size=500) > 0).astype(float))
    assert (np.diff(y) >= 0).all()


# --- repeats --------------------------------------------------------------


def slow_repeats(texts, n=repeats.LENGTH):
    seen = defaultdict(list)
    for i, t in enumerate(texts):
        for p in range(len(t) - n + 1):
            seen[t[p : p + n]].append((i, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for v in seen.values():
        if len(v) > 1:
            for i, p in v:
                gone[i][p : p + n] = True
    return [(len(t), int(g.sum()), int((np.diff(np.pad(g.astype(int), 1)) == 1).sum()), sha(np.frombuffer(t, np.uint8)[~g].tobytes())) for t, g in zip(texts, gone)]


@pytest.mark.parametrize(("hot", "weak"), [(2048, 0), (3, 0), (2048, 62)])
def test_repeats_brute_force(spark, docs, hot, weak):
    r = random.Random(8)
    base = [x.text for x in docs.orderBy("doc_id").limit(4).collect()]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(50):
        b = r.choice(base)
        a = r.randint(0, 400)
        pad = lambda: "".join(r.choice("abcdé \n") for _ in range(r.randint(0, 80)))
        rows.append((100 + i, pad() + b[a : a + r.choice([150, 199, 200, 201, 330, 900])] + pad()))
    rows += [(i + 300, t) for i, t in enumerate(["ab" * 300, "x" * 1000, "x" * 250, "", None, "z" * 200, "z" * 200, "y" * 199, "q" * 201])] + [(None, base[0]), (0, base[0])]
    got = Counter(tuple(x) for x in repeats.remove_repeats(spark.createDataFrame(rows, DOC).repartition(3), hot=hot, weak=weak).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, slow_repeats([(t or "").encode() for _, t in rows])))


def test_repeats_hash_collision_is_seen():
    raws = [bytes(250), bytes(250)]
    got = repeats.repeated_starts(np.array([1, 1]), np.array([(50 << 8) | 50] * 2), raws)
    assert got.sum() == 2 * 51
    power = repeats._POW.copy()
    try:
        repeats._POW[:] = 0  # all hashes are equal
        raws = [bytes([7]) * 250, bytes([8]) * 250]
        assert not repeats.repeated_starts(np.array([1, 1]), np.array([(50 << 8) | 50] * 2), raws).any()
    finally:
        repeats._POW[:] = power


def test_suffix_sort():
    r = random.Random(9)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 30))) for _ in range(200)]
    group = np.sort(np.array([r.randint(0, 9) for _ in texts]))
    right, length = np.zeros((200, repeats.LENGTH), np.uint8), np.array([len(t) for t in texts])
    for i, t in enumerate(texts):
        right[i, : len(t)] = np.frombuffer(t, np.uint8)
    prefix = np.zeros((200, repeats.LENGTH + 1), np.uint64)
    np.cumsum(repeats._BYTE[right] * repeats._POW[: repeats.LENGTH], axis=1, out=prefix[:, 1:])
    order, lcp = repeats.sort_suffixes(group, right, length, prefix)
    assert [(group[i], texts[i]) for i in order] == sorted(zip(group.tolist(), texts))
    for k in range(1, 200):
        a, b = texts[order[k - 1]], texts[order[k]]
        common_len = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert lcp[k] == (common_len if group[order[k]] == group[order[k - 1]] else 0)


def test_repeats_long_text_and_empty(spark, empty):
    r = random.Random(1)
    body = "".join(r.choice("abcdefgh ") for _ in range(400_000))
    df = spark.createDataFrame([(1, body), (2, "z" * 10 + body[262_000:262_400])], DOC)
    got = {r.doc_id: r for r in repeats.remove_repeats(df, texts=True).collect()}
    assert got[1].n_removed == got[2].n_removed == 400 and bytes(got[2].kept) == b"z" * 10
    assert repeats.remove_repeats(empty).count() == 0


# --- chat -----------------------------------------------------------------


def test_chat_digest(spark, sf):
    got = {r.conv_id: r for r in queries.op7_chat(spark, sf).collect()}
    odd = "\\### Assistant: </turn> ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = defaultdict(list)
    for c, t, role, text in rows + [(-7, 0, "user", odd), (-7, 1, "assistant", odd)]:
        by[c].append((t, role, text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))


def test_chat_log_folds_back(spark):
    rows = [(1, 0, "user", "Hallo du"), (1, 0, "user", "Hallo du"), (1, 1, "assistant", None), (1, 2, "assistant", "é"), (2, 5, None, "ab"), (None, None, "tool", "x" * 100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit(3))
    log = chat.streamed(df)
    assert Counter(r.kind for r in log.collect()) == {"message": 6, "delta": 12, "edit": 4, "regenerate": 2}
    got = Counter((r.conv_id, r.turn, r.role, r.text) for r in chat.reconstruct(log).collect())
    assert got == Counter((c, t, r or "", x or "") for c, t, r, x in rows)


def test_chat_stays_native(spark, sf):
    df = queries.op7_chat(spark, sf)
    run = df._jdf.queryExecution()
    assert "Python" not in run.toRdd().toDebugString() and "Python" not in run.executedPlan().toString()


def test_chat_fold(spark):
    e = [
        (1, 0, "message", 0, "user", "Hal"), (1, 1, "delta", 0, None, "lo"), (1, 2, "message", 1, "assistant", "A"), (1, 3, "delta", 1, None, "B"), (1, 4, "regenerate", 1, None, None),
        (1, 5, "delta", 1, None, "C"), (1, 6, "delta", 1, None, "D"), (1, 7, "edit", 0, None, "Neu"), (2, 0, None, 0, None, None), (2, 1, "delta", 3, "tool:x", "früh"),
        (None, 0, "message", 0, "user", "x"), (2, 0, "message", 0, "Odd", "y"),
    ]
    df = spark.createDataFrame(e, "conv_id long, seq long, kind string, turn long, role string, text string").withColumn("head", F.lit(1))
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.reconstruct(df))).collect()}
    turns = {k: [(t.role, t.text) for t in r.turns] for k, r in back.items()}
    assert turns == {1: [("user", "Neu"), ("assistant", "CD")], 2: [("", ""), ("Odd", "y"), ("tool:x", "früh")], None: [("user", "x")]}
    assert back[1].loss == ["CD"]
    assert chat.digest(chat.read_back(chat.render(chat.reconstruct(df.limit(0))))).count() == 0


def test_chat_escapes_come_back(spark):
    r = random.Random(2)
    parts = ["\\", "###", "#", "</turn>", "\n", "h", "b", "e", "c", ": ", "### User: ", "x", "é", "=", "<", "/"]
    rows = [(i // 3, i % 3, r.choice(["user", "assistant", "system", "a:b", "=x", "\\c"]), "".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("nth", F.lit(1))
    got = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in chat.read_back(chat.render(df)).collect()}
    want = defaultdict(list)
    for c, _, role, t in rows:
        want[c].append((role, t))
    assert got == want


# --- language model -------------------------------------------------------


def test_lm_base_and_gain(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op9_lm(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    tok = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter()
    for i, t in zip(docs.doc_id, docs.text):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tok(t))
    total, distinct = sum(c.values()), len(c)
    for i, t in zip(docs.doc_id, docs.text):
        w, r = tok(t), got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w), rel_tol=1e-9)
    h = got[got.held_out]
    assert h.score.sum() > h.base_score.sum()


def tiny_model(size=90, seed=1):
    own = {b"w%d" % i: 1 + i for i in range(size - 1 - lm.FORMS)}
    r = np.random.default_rng(seed)
    noise = r.dirichlet(np.ones(size))
    return own, noise, lm.untrained(noise, seed)


def test_lm_is_normalised():
    own, noise, p = tiny_model()
    p = {k: v + np.random.default_rng(2).normal(size=v.shape).astype(np.float32) for k, v in p.items()}
    m = lm.normalised(own, p)
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = r.integers(0, len(noise), 2)
        w = np.arange(len(noise))
        slow = np.array([(p["r"][a] @ p["c1"] + p["r"][b] @ p["c2"]) @ p["q"][k] + p["b"][k] for k in w], np.float64)
        slow -= slow.max() + np.log(np.exp(slow - slow.max()).sum())
        got = m.log10(np.full(len(w), a), np.full(len(w), b), w)
        assert np.allclose(got, slow / math.log(10), atol=1e-4) and math.isclose((10**got).sum(), 1, abs_tol=1e-3)


def test_lm_learns_by_noise_contrast():
    own, noise, p = tiny_model()
    t = lm.Trainer(p, np.full(len(noise), 1 / len(noise)), 3)
    seqs = [np.array([1 + (s + i * (1 + s % 2)) % 20 for i in range(30)]) for s in range(20)]  # the next word follows from two
    code, n = lm.trigrams(seqs, len(noise))
    t.run(code, n, 0.05, 400)
    size = len(noise)
    p = lm.normalised(own, t.p).log10(code // size // size, code // size % size, code % size)
    assert 10 ** (-(p * n).sum() / n.sum()) < 1.6


def test_lm_trains_on_every_token(spark, sf):
    learn = spark.read.parquet(f"{sf}/documents.parquet").select(F.coalesce("text", F.lit("")).cast("binary").alias("__text")).repartition(3)
    own, noise, p = tiny_model()
    shared = spark.sparkContext.broadcast((own, noise, p))
    got = learn.mapInArrow(lm._learn(shared), "part long, tokens long, model binary").agg(F.sum("tokens")).first()[0]
    assert got == sum(len(bytes(r[0]).lower().split()) + 1 for r in learn.collect())
    r = np.random.default_rng(5)
    code, n = np.sort(r.choice(10**6, 50_000, replace=False)), r.zipf(1.6, 50_000).clip(max=10**7)
    entry, weight = lm.spread(code, n)
    assert np.allclose(np.bincount(np.searchsorted(code, entry), weight) / n, weight.sum() / n.sum(), rtol=1e-4) and weight.max() <= 8


def test_lm_trigrams():
    assert lm.trigrams([np.array([3, 3]), np.zeros(0, np.int64)], 10)[0].tolist() == [0, 3, 33, 330]
    assert lm.trigrams([np.array([3, 3]), np.zeros(0, np.int64)], 10)[1].tolist() == [1, 1, 1, 1]


@pytest.mark.parametrize("models", [8, 2])
def test_lm_score_brute_force(spark, docs, monkeypatch, models):
    seen = []
    real = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: seen.append(real(*a)) or seen[-1])
    monkeypatch.setattr(lm, "OWN", 150)
    monkeypatch.setattr(lm, "HEAD", 400)
    monkeypatch.setattr(lm, "MODELS", models)
    df = docs.select("doc_id", "text").withColumn("train", F.col("doc_id") % 3 > 0).repartition(5)
    got = {r.doc_id: r.score for r in lm.score_documents(df, F.col("train")).collect()}
    (m,) = seen
    rows = [(r.doc_id, (r.text or "").encode().lower().split(), r.train) for r in df.collect()]
    c = Counter(w for _, ws, train in rows if train for w in ws)
    assert len(m.own) <= 150
    n, v = Counter(), Counter()
    form = lambda w: lm.form_of(w.decode())
    for w, k in c.items():
        if w not in m.own:
            n[form(w)] += k
            v[form(w)] += 1
    for i, ws, _ in rows:
        outs = [0, 0] + [m.own.get(w) or 1 + len(m.own) + form(w) for w in ws] + [0]
        want = sum(m.log10(np.array([outs[j - 2]]), np.array([outs[j - 1]]), np.array([outs[j]]))[0] for j in range(2, len(outs)))
        want += sum(math.log10((c[w] + 1) / (n[form(w)] + v[form(w)] + 1)) for w in ws if w not in m.own)
        assert math.isclose(got[i], want, rel_tol=1e-5)


def test_lm_odd_rows(spark, odd, empty):
    got = lm.score_documents(odd, F.lit(True), keep=("doc_id", "k")).collect()
    assert len(got) == len(ODD) and all(r.score < 0 and r.base_score < 0 for r in got)
    none = lm.score_documents(odd.select("doc_id", "text"), F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in none)
    assert lm.score_documents(empty, F.lit(True)).count() == 0


# --- embeddings -----------------------------------------------------------


@pytest.mark.parametrize("tile", [2048, 16, 3])
def test_embeddings_brute_force(spark, sf, tile):
    r = np.random.default_rng(0)
    base = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").limit(60).collect()
    rows = [(x.vec_id, [float(v) for v in x.embedding], x.label) for x in base]
    k = 10_000
    for x in rows[:5]:
        for _ in range(20):
            rows.append((k, [float(np.float32(v + r.normal() * r.choice([0, 0.02, 0.03, 0.04]))) for v in x[1]], x[2]))
            k += 1
    n = len(rows[0][1])
    rows += [(k, None, 1), (k + 1, [0.0] * n, 1), (k + 2, [float("nan")] * n, 1), (k + 3, [None] + [1.0] * (n - 1), 1), (k + 4, rows[0][1], None), (k + 5, [], 1), (k + 6, [1.0, 2.0], 1), (k + 7, [1.0, 2.1], 1), (k + 7, [1.0, 2.1], 1)]
    usable = [np.array(v, float) if v and lab is not None and None not in v and np.isfinite(v).all() and any(v) else None for _, v, lab in rows]
    u, links = Union(len(rows)), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = usable[i], usable[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[i] += 1
                links[j] += 1
                u.join(i, j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[u.find(i)].append(rows[i][0])
    want = Counter((rows[i][0], links[i], min(groups[u.find(i)]), rows[i][0] == min(groups[u.find(i)])) for i in range(len(rows)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("d", F.lit(1))
    assert Counter(tuple(x) for x in embeddings.near_duplicates(df, tile=tile).collect()) == want


def test_embeddings_extreme_doubles(spark):
    rows = [(1, [1e200] * 4), (2, [1e200, 1e200, 1e200, 1.1e200]), (3, [1e-200] * 4), (4, [-1e200] * 4), (5, [1e-320, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_range_join_meets_each_pair_once(spark):
    r = np.random.default_rng(4)
    y = r.normal(size=(90, 12)).astype(np.float32) * 0.2
    y[40:] = y[r.integers(0, 10, 50)] + r.normal(size=(50, 12)).astype(np.float32) * 0.03
    df = spark.createDataFrame([(1, 12, i, v.tolist()) for i, v in enumerate(y)], "label int, d int, id long, y array<float>")
    share, met = 0.02, Counter()
    leaves = embeddings._range_join(df, F.lit(share), 4)
    tiles = defaultdict(lambda: ([], []))
    for t in embeddings._tiles(leaves, 4).collect():
        tiles[t.blk, t.node, t.p, t.q][t.side].append(t.id)
    for (blk, _, _, q), (a, b) in tiles.items():
        met.update((blk, *sorted(x)) for x in [(i, j) for i in a for j in b] + ([(i, j) for i in a for j in a if i < j] if q == -1 else []))
    assert max(met.values()) == 1
    for blk in range(embeddings.BLOCKS):
        p = np.array_split(y, embeddings.BLOCKS, axis=1)[blk].astype(float)
        near = ((p[:, None] - p[None]) ** 2).sum(2) <= share
        assert all((blk, i, j) in met for i in range(90) for j in range(i + 1, 90) if near[i, j])


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# --- pipeline -------------------------------------------------------------


def test_pipeline_stages(spark, docs, sf):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding"]
    assert p.ORACLE_SQL is None
    d = docs.select(*p.COLUMNS)
    steps = dict(p.STAGES)
    before = {r.doc_id: r for r in d.collect()}
    scored = {r.doc_id for r in queries.op8_quality(spark, sf).where("predicted = 1").collect()}
    assert {r.doc_id for r in steps["quality classifier"](spark, d, sf).collect()} == scored
    leaks = {r.doc_id for r in queries.op3_decontaminate(spark, sf).collect()}
    clean = steps["benchmark decontamination"](spark, d, sf)
    assert clean.columns == list(p.COLUMNS) and {r.doc_id for r in clean.collect()} == set(before) - leaks
    for r in steps["secret scans"](spark, d, sf).collect():
        assert r.text == secrets.mask_secrets(before[r.doc_id].text) and r.n_chars == len(r.text)
    last = p.run(spark, sf).collect()
    assert 0 < len(last) < len(before)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert Counter(map(tuple, queries.QUERIES[name](spark, sf).select(*names).collect())) == Counter(want.fetchall())
