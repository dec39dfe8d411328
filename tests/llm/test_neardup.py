import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from entiquery.llm import neardup, shared

RNG = np.random.default_rng(12)
VOCAB = [f"w{i}" for i in range(900)]


def shingles(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    docs = []
    for base in range(25):
        w = list(RNG.choice(VOCAB, int(RNG.integers(60, 240))))
        docs.append(" ".join(w))
        for copy in range(int(RNG.integers(0, 6))):
            v = list(w)
            for _ in range(int(RNG.integers(0, len(w) // 25))):
                v[int(RNG.integers(len(v)))] = "changed" + str(RNG.integers(99))
            docs.append(" ".join(v).upper() if copy == 3 else "\n".join(v))
    docs += [" ".join(RNG.choice(VOCAB, 150)) for _ in range(30)]
    docs += ["", " \n", None, "one", "One", "a b c", "a b d", docs[0], docs[0]]
    order = RNG.permutation(len(docs))
    return [(int(i * 3 % 1009), docs[k]) for i, k in enumerate(order)]


def test_groups(spark):
    docs = corpus()
    names = "id string, a int, __uid int, size int, root string"
    frame = shared.materialise(spark.createDataFrame([(d, t, "k", 1, i, 2, "r") for i, (d, t) in enumerate(docs)], f"doc_id long, text string, {names}").coalesce(1))
    kept = neardup.without_near_duplicates(frame)
    assert kept.columns == frame.columns
    rows = kept.collect()
    assert all(docs[r["__uid"]] == (r["doc_id"], r["text"]) and r["size"] == 2 for r in rows)
    left = {r["doc_id"] for r in rows}
    n = len(docs)
    near = [[brute(docs[i][1], docs[k][1]) >= 0.8 for k in range(n)] for i in range(n)]
    root = list(range(n))
    for i in range(n):
        for k in range(i):
            if near[i][k] and root[i] != root[k]:
                a, b = root[i], root[k]
                root = [a if r == b else r for r in root]
    groups = {}
    for (d, _), r in zip(docs, root, strict=True):
        groups.setdefault(r, []).append(d)
    assert all(min(g) in left for g in groups.values())  # nothing goes but for something similar that stays
    assert len(left) == len(groups)
    assert neardup.without_near_duplicates(frame.limit(0)).count() == 0


@given(st.lists(st.sampled_from("abcdefgh"), max_size=30), st.lists(st.sampled_from("abcdefgh"), max_size=30))
@settings(max_examples=150, deadline=None)
def test_similarity_is_exact_for_short_texts(a, b):
    import pyarrow as pa

    marks = []
    for t in (" ".join(a), " ".join(b)):
        _, _, hashes, _ = next(iter(neardup.hash_words(pa.array([t]), word_bytes=neardup.SOLID)))
        marks.append(neardup.sketch(hashes))
    assert abs(neardup.similarity(*marks) - brute(" ".join(a), " ".join(b))) < 1e-9
    x, y = np.random.default_rng(1).integers(0, 1 << 60, (2, 3000), dtype=np.uint64)
    long = np.concatenate([x, y[:100]])
    assert abs(neardup.similarity(neardup.sketch(x), neardup.sketch(long)) - (len(x) - 4) / (len(long) - 4)) < 0.08


def test_one_large_family(spark):
    base = list(RNG.choice(VOCAB, 120))
    docs = [(0, " ".join(base))]
    for i in range(1, 300):
        v = list(base)
        v[int(RNG.integers(120))] = f"x{i}"
        docs.append((i, " ".join(v)))
    frame = shared.materialise(spark.createDataFrame(docs, "doc_id long, text string"))
    assert [r["doc_id"] for r in neardup.without_near_duplicates(frame).collect()] == [0]


def left_and_groups(spark, texts):
    """doc_ids that stay, and the smallest of each group by brute force."""
    frame = shared.materialise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    left = {r["doc_id"] for r in neardup.without_near_duplicates(frame).collect()}
    marks = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i, x in enumerate(marks):
        for k in range(i):
            if root[i] != root[k] and len(x & marks[k]) >= 0.8 * len(x | marks[k]):
                low, high = sorted((root[i], root[k]))
                root = [low if r == high else r for r in root]
    return left, set(root)


def edited(words, rng, edits, mark):
    v = list(words)
    for p in rng.choice(len(v), edits, replace=False):
        v[int(p)] = f"{mark}{p}"
    return " ".join(v)


def test_pairs_within_three_bits_that_a_forest_leaves_out(spark):
    rng = np.random.default_rng(31)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for family in range(25):  # the same words but a few, in an order of the family's own: fingerprints lie close
        order = [words[i] for i in rng.permutation(400)]
        texts += [edited(order, rng, 3, f"f{family}a"), edited(order, rng, 3, f"f{family}b")]
    left, groups = left_and_groups(spark, texts)
    assert len(groups) == 25 and left == groups


def test_families_of_one_fingerprint(spark):
    rng = np.random.default_rng(32)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(25):  # exactly the same words: every text has the same word fingerprints
        order = [words[i] for i in rng.permutation(150)]
        texts += [" ".join(order), " ".join([*order[:70], order[71], order[70], *order[72:]])]
    left, groups = left_and_groups(spark, texts)
    assert len(groups) == 25 and left == groups


def test_long_texts_close_to_the_threshold(spark):
    rng = np.random.default_rng(33)
    texts = []
    for pair in range(40):  # one block of new words of some length: similarities of 0.79 and 0.81
        w = [f"p{pair}w{i}" for i in range(1000)]
        new = 114 if pair % 2 else 101
        at = int(rng.integers(100, 700))
        texts += [" ".join(w), " ".join([*w[:at], *(f"new{pair}x{i}" for i in range(new)), *w[at + new :]])]
    left, groups = left_and_groups(spark, texts)
    assert len(groups) == 60 and left == groups


def test_no_pair_from_the_threshold_on_is_missed(spark):
    rng = np.random.default_rng(34)
    texts = []
    for pair in range(300):  # short texts: one word more moves many bits of a word fingerprint
        w = [f"v{i}" for i in rng.integers(0, 5000, int(rng.integers(12, 40)))]
        texts += [" ".join(w), " ".join([*w, f"last{pair}"])]
    left, groups = left_and_groups(spark, texts)
    assert len(groups) == 300 and left == groups


def test_a_shingle_of_a_large_family_is_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BIG", 4)
    rng = np.random.default_rng(36)
    words = [f"w{i}" for i in range(200)]
    texts = [edited(words, rng, 1, f"m{i}x") for i in range(60)]  # one family
    texts += [" ".join([*words[:90], *(f"o{i}y{k}" for k in range(20))]) for i in range(12)]  # half of it and something else
    texts += [f"{texts[60 + i]} more" for i in range(0, 12, 3)]
    left, groups = left_and_groups(spark, texts)
    assert left == groups and len(groups) < 20
    met = spark.createDataFrame([(k, i, 5, 0, 1 if i < 40 else i) for k in (1, 2) for i in range(50)] + [(3, i, 5, 0, 7) for i in range(30)], "key long, id long, size int, place int, root long")
    parts = {}
    for r in neardup.split(met, None).collect():
        parts.setdefault(r["key"], set()).add((r["id"], r["root"]))
    pairs = {tuple(sorted((a, b))) for p in parts.values() for a, x in p for b, y in p if x != y}
    assert pairs == {(a, b) for a in range(50) for b in range(40, 50) if a < b} and max(map(len, parts.values())) < 25
    assert sum(map(len, parts.values())) == 2 * (40 + 13 * 10) and neardup.split(met, 1).count() == 100


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(35)
    for n in [*range(1, 60), 500, 2000]:
        a = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
        for new in range(int(n * 0.25) + 1):
            b = np.unique(np.r_[a, rng.integers(1, 1 << 63, new, dtype=np.uint64)])
            order = rng.permutation(np.union1d(a, b))
            x, y = (np.array([g for g in order.tolist() if g in own])[: int(neardup.prefix_size(np.array(len(own)), 0.8))] for own in (set(a.tolist()), set(b.tolist())))
            both, i, k = np.intersect1d(x, y, return_indices=True)
            if neardup.similarity(a.tobytes(), b.tobytes()) >= 0.8:
                assert len(both) and neardup.may_agree(len(a) + 0 * i, i, len(b) + 0 * k, k, 0.8).any()


def test_parities_lose_no_pair():
    rng = np.random.default_rng(37)
    words = lambda p: np.frombuffer(p, np.uint64)[None]
    for n in (0, 1, 4, 5, 30, 400, 3000):
        a = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
        for out in {0, n // 20, n // 10, n // 9, n // 8, n // 4, n // 2}:
            b = np.r_[a[out:], np.unique(rng.integers(1, 1 << 63, out, dtype=np.uint64))]
            size = np.array([len(a)]), np.array([len(b)])
            allowed = neardup.parity_allows(words(neardup.parities(a)), words(neardup.parities(b)), *size, 0.8)[0]
            assert allowed or neardup.similarity(a.tobytes(), np.sort(b).tobytes()) < 0.8
            assert not (allowed and 5 <= n <= 400 and out == n // 2)  # and half of the shingles are told apart


def test_minority():
    key, root = np.array([1, 1, 1, 2, 5, 5, 5, 5, 5]), np.array([7, 8, 7, 9, 4, 3, 3, 6, 3])
    assert neardup.minority(key, root).tolist() == [False, True, False, False, True, False, False, True, False]
    assert neardup.minority(key[:0], root[:0]).tolist() == []


def test_shared_shingles_are_counted_by_text(spark):
    texts = ["a b c d e f", "a b c d e g", "a b c d e f", "", None, "q r s t u v", "x b c d e f"]
    frame = shared.materialise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    found = {}
    for r in neardup.shared_shingles(frame, 5).collect():
        for t, g, n in zip(np.frombuffer(r["text"], np.uint64), np.frombuffer(r["gram"], np.uint64), np.frombuffer(r["held"], np.int64), strict=True):
            found.setdefault(int(g), []).append((int(t), int(n)))
    assert sorted(len(v) for v in found.values()) == [2, 2]  # "a b c d e" of two texts, "b c d e f" of two
    assert all(n == 2 for v in found.values() for _, n in v)


def test_whole_table_against_brute_force(spark):
    """Every pair of sf0.1 that shares a shingle, by counting: nothing else goes, and nothing similar stays."""
    docs = shared.table(spark, "/root/testdata/sf0.1", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    first, ids = {}, []
    for d, t in sorted(rows):
        first.setdefault(t or "", d)
    number, keys, owners, size = {}, [], [], []
    for i, (t, d) in enumerate(first.items()):
        grams = shingles(t)
        ids.append(d)
        size.append(len(grams))
        owners += [i] * len(grams)
        keys += [number.setdefault(g, len(number)) for g in grams]
    keys, owners, size = np.array(keys), np.array(owners), np.array(size)
    by = np.lexsort((owners, keys))
    keys, owners = keys[by], owners[by]
    pairs = []
    for step in range(1, int(np.bincount(keys).max())):
        same = keys[step:] == keys[:-step]
        pairs.append(owners[:-step][same] * len(ids) + owners[step:][same])
    pair, common = np.unique(np.concatenate(pairs), return_counts=True)
    a, b = pair // len(ids), pair % len(ids)
    alike = common >= (0.8 - 1e-12) * (size[a] + size[b] - common)
    alike_pairs = list(zip(a[alike].tolist(), b[alike].tolist(), strict=True))
    empty = np.flatnonzero(size == 0).tolist()
    alike_pairs += list(zip(empty, empty[1:], strict=False))
    root = list(range(len(ids)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in alike_pairs:
        x, y = sorted((top(x), top(y)))
        root[y] = x
    expected = {}
    for i, d in enumerate(ids):
        expected[top(i)] = min(d, expected.get(top(i), d))
    left = sorted(r["doc_id"] for r in neardup.without_near_duplicates(docs).collect())
    assert len(alike_pairs) > 40 and left == sorted(expected.values())
