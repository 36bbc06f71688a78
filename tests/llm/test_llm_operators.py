"""The training-data operators against brute force, known answers, round trips and held-out accuracy."""

import base64
import hashlib
import json
import random
import re
import string
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, chat, common, decontaminate, fm, html, langid, lattice, minhash, pii

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed, size=400):
    rng = random.Random(seed)
    pool = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8))) for _ in range(size)]
    return [rng.choice(pool) for _ in range(n)]


ODD = [None, "", "   ", "\n\t", "a", "a b", "é" * 40, "日本語 " * 30, "x" * 5000, "word " * 3000, "😀 b\x1cc", "A  b\n\n c "]


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    with open(RANKS, "rb") as f:
        content = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines())}
    return bpe.load(content, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(tokenizer):
    ours, library = tokenizer
    rng = random.Random(5)
    parts = ["a", "ab", "é", " ", "  ", "\n", "\n ", "1", "12", "!!", "日本", "😀", "ing", " the", "\t", "aaaa", "'s", "<|endoftext|>", "　", "\x1c"]
    texts = [t for t in ODD if t is not None] + ["".join(rng.choices(parts, k=rng.randint(0, 50))) for _ in range(3000)]
    for text, ids in zip(texts, ours.encode_texts(texts, {}), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert ours.decode_bytes(ids) == text.encode()


def test_bpe_rows(spark, tokenizer):
    df = docs(spark, ODD).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    got = bpe.encode_documents(df, RANKS, P.PATTERN, digests=True).collect()
    assert len(got) == len(ODD)
    for r in got:
        text = ODD[r.doc_id] or ""
        ids = tokenizer[1].encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    plain = bpe.encode_documents(df, RANKS, P.PATTERN).collect()
    assert all(r.decoded == (ODD[r.doc_id] or "") for r in plain)
    assert bpe.encode_documents(df.where("false"), RANKS, P.PATTERN).count() == 0


def test_lattice_of_segmentations_by_enumeration():
    with open(RANKS, "rb") as f:
        keys = langid.vocabulary_keys(f.read())
    la = langid.Lattice(keys)
    rng = np.random.default_rng(0)
    p = np.vstack((rng.random((len(keys), 2)), np.zeros((1, 2))))
    row = {int(k): i for i, k in enumerate(keys)}

    def total(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for n in range(1, min(len(word), langid.LONGEST) + 1):
            at = row.get(int.from_bytes(b"\1" + word[:n], "big"))
            if at is not None:
                out = out + p[at] * total(word[n:])
        return out

    samples = [b" the", b" achlich", "été".encode(), b"a", b"", b"zzqx"]
    got = la.log_scores(samples, p)
    assert np.allclose(got, [np.log(total(w)) for w in samples])
    long = b" abc" * 40  # beyond LONG_WORD: the rescaled pass
    short = np.array([[*long]], np.uint8)
    q = p * 0.01
    assert np.allclose(la.log_scores([long], q)[0], np.log(la.forward(short, q, la.rows(short))[-1][0]), rtol=1e-6)


def test_language_ids(spark):
    d = common.table(spark, SMALL, "documents")
    model = langid.learn(d, RANKS, common.fold("doc_id", 3) != 1)
    got = langid.predict(d, model, keep=("doc_id", "lang")).where(common.fold("doc_id", 3) == 1).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    odd = {r.doc_id: r for r in langid.predict(docs(spark, ODD + ["123 !!"]), model).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2, 3, len(ODD))] == ["und"] * 5 and odd[0].score == 0
    assert all(0 <= r.score <= 1 for r in odd.values())
    none = langid.learn(d.where("false"), RANKS)
    assert {r.lang_pred for r in langid.predict(docs(spark, ["some text"]), none).collect()} == {"und"}


def test_lattice_sums_long_pieces_and_fits_whole_words(spark):
    with open(RANKS, "rb") as f:
        content = f.read()
    keys = langid.vocabulary_keys(content)
    assert len(keys) == len({base64.b64decode(line.split()[0]) for line in content.splitlines()} | {bytes([b]) for b in range(256)})
    la, word = langid.Lattice(keys), " international".encode()
    p = np.zeros((len(keys) + 1, 1))
    p[keys.index(int.from_bytes(b"\1" + word, "big"))] = 0.25  # a piece of 14 bytes and no other
    assert np.allclose(la.log_scores([word], p), np.log(0.25))
    rng = np.random.default_rng(1)
    p = np.vstack((rng.random((len(keys), 1)) * 0.01, np.zeros((1, 1))))
    a, b = np.zeros(len(p)), np.zeros(len(p))
    word = " 国際連合の総会ab".encode()
    la.expected(np.array([[*word]], np.uint8), np.array([3.0]), p, a)
    la.expected_long(word, 3.0, np.log(np.maximum(p, 1e-300)), b)
    assert np.allclose(a, b, rtol=1e-8) and b.any()
    head, tails = "x" * 60, ("qqjj", "wwvv")  # what tells the two apart stands behind the 60th byte
    d = docs(spark, [head + tails[0]] * 40).unionByName(docs(spark, [head + tails[1]] * 40, lang="fr").withColumn("doc_id", F.col("doc_id") + 40))
    got = langid.predict(docs(spark, [head + t for t in tails]), langid.learn(d, RANKS)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["en", "fr"] and min(r.score for r in got) > 0.9


def test_language_choice_by_enumeration(spark):
    """The language of greatest product over words of the sum over all segmentations, computed plainly."""
    d = docs(spark, ["das ist ein haus", "the house is old", "une maison et un chat", "das haus und der hund", "the dog and a cat", "le chien est ici"] * 3)
    d = d.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").when(F.col("doc_id") % 3 == 1, "en").otherwise("fr"))
    model = langid.learn(d, RANKS)
    keys, langs, p, _ = model.value
    row = {k: i for i, k in enumerate(keys)}

    def total(word, c):
        sums = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(j):
                at = row.get(int.from_bytes(b"\1" + word[i:j], "big"))
                sums[j] += sums[i] * p[at, c] if at is not None else 0.0
        return np.log(max(sums[-1], 1e-300))

    texts = ["das chat", "a house", "le haus is", "hund", "zzz", "maison maison the", "", "12 ?!", "é", None, "the " * 400 + "x" * 300]
    got = {r.doc_id: r for r in langid.predict(docs(spark, texts), model).collect()}
    for k, t in enumerate(texts):
        if not t or not re.search(r"[^\W\d_]", t):
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
        elif k < 10:
            z = np.array([sum(total(b" " + w.encode(), c) for w in t.split()) for c in range(len(langs))])
            assert got[k].lang_pred == langs[int(z.argmax())] and abs(got[k].score - 1 / np.exp(z - z.max()).sum()) < 1e-9
    assert got[10].lang_pred == "en" and langid.predict(docs(spark, texts).where("false"), model).count() == 0
    nobody = langid.learn(d.where("false"), RANKS)
    assert {r.lang_pred for r in langid.predict(d, nobody).collect()} == {"und"}


def test_language_fit_counts_every_word_of_the_sample(spark):
    rng = random.Random(5)
    rare = ["zz" + "".join(rng.choices("qxj", k=6)) for _ in range(30)]  # each met once, behind 160,000 words met twice
    common_words = " ".join(f"w{k} w{k}" for k in range(160_000))
    d = docs(spark, [common_words]).unionByName(docs(spark, rare, lang="zu").withColumn("doc_id", F.col("doc_id") + 1))
    keys, langs, p, _ = langid.learn(d, RANKS).value
    assert langs == ["en", "zu"]
    got = langid.predict(docs(spark, [" ".join(rare)]), langid.learn(d, RANKS)).first()
    assert got.lang_pred == "zu"


def test_pairwise_term_by_the_identity():
    rng = np.random.default_rng(1)
    m = fm.Machine({10: 0, 11: 1, 12: 2}, 0.3, rng.normal(size=3), rng.normal(size=(3, 4)))
    z = 0.3 + m.w.sum() + sum(m.v[i] @ m.v[j] for i in range(3) for j in range(i))
    assert abs(m.score({10, 11, 12, 99}) - 1 / (1 + np.exp(-z))) < 1e-12


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(2)
    rows = [[k for k in range(4) if rng.random() < 0.5] for _ in range(1500)]
    y = np.array([int(0 in r and 1 in r) for r in rows])
    m = fm.fit(rows, y, [0, 1, 2, 3])
    assert m.score({0, 1}) > 0.9 and m.score({0}) < 0.2 and m.score({1, 2}) < 0.2


def test_learn_finds_an_interaction_without_marginal_effect(spark):
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = words(25, i) + ["insulter"] * a + ["grouping"] * b
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append((i, int(a == b)))
    d = docs(spark, texts)
    lab = spark.createDataFrame(labels, "doc_id bigint, y int")
    model = fm.learn(d, lab, "y", common.fold("doc_id", 4) != 2, structure=False)
    got = {r.doc_id: r.predicted for r in fm.score(d, model, False).collect()}
    held = [i for i in range(1200) if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i] == labels[i][1] for i in held]) > 0.95


def test_directions_are_those_of_the_pair_matrix():
    rng = np.random.default_rng(3)
    x = (rng.random((400, 12)) < 0.4).astype(float)
    y = (x[:, 2] == x[:, 5]).astype(float)
    rows = [np.flatnonzero(r) for r in x]
    centred, weight = x - x.mean(axis=0), (y - y.mean()) / np.maximum(1, x.sum(axis=1))
    g = centred.T @ (weight[:, None] * centred) - np.diag(x.T @ weight)
    value, vector = np.linalg.eigh(g)
    top = vector[:, np.abs(value).argmax()]
    found, v = fm.directions(rows, y, rounds=40)
    assert {2, 5} <= set(found.tolist())
    assert abs(abs(v[:, 0] @ top[found]) / np.linalg.norm(v[:, 0]) / np.linalg.norm(top[found]) - 1) < 0.02


def test_labelled_copies_of_an_id_are_learned_once_and_metadata_count(spark):
    rows = [(i % 40, "same words here", None, "s", 10 + 1000 * (i % 2)) for i in range(400)]
    d = spark.createDataFrame(rows, DOCS).withColumn("y", F.lit("clash")).withColumn("__text", F.lit("clash"))
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, y int")
    model = fm.learn(d, lab, "y", F.lit(True), True, metadata=("n_chars",))
    got = fm.score(d, model, True, metadata=("n_chars",)).distinct().collect()
    assert len(got) == 40 and all(r.predicted == r.doc_id % 2 for r in got)
    assert fm.score(d.where("false"), model, True, metadata=("n_chars",)).count() == 0


@pytest.mark.parametrize("structure", [False, True])
def test_classifier_on_planted_words(spark, structure):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        w = words(40, 9)
        rng.shuffle(w)
        texts.append(" ".join(w[:20] + (["Awful,", "nonsense!"] if bad else []) + w[20:]))
        labels.append((i, int(bad)))
    d = docs(spark, texts + ODD)
    lab = spark.createDataFrame(labels + [(3, None), (None, 1), (3, 1)], "doc_id bigint, y int")
    model = fm.learn(d, lab, "y", common.fold("doc_id", 4) != 2, structure=structure)
    got = {r.doc_id: r for r in fm.score(d, model, structure).collect()}
    held = [i for i in range(600) if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    nothing = fm.learn(d, lab.where("false"), "y", F.lit(True), structure=structure)
    assert {r.predicted for r in fm.score(d, nothing, structure).collect()} == {0}


def near_texts():
    rng = random.Random(11)
    out = list(ODD)
    for g in range(25):
        base = words(rng.randint(5, 120), g)
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.random())
            out.append(("  ".join(copy)).upper() if rng.random() < 0.3 else " ".join(copy))
    shared = words(60, 77)
    out += [" ".join(words(40, 100 + k) + shared + words(30, 200 + k)) for k in range(60)]
    return out


@pytest.mark.parametrize("spread", [4096, 3])
def test_minhash_components_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(minhash, "SPREAD", spread)
    texts = near_texts()
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in minhash.components(docs(spark, texts).withColumn("id", F.lit(1)).withColumn("key", F.lit("x"))).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i)
    assert minhash.components(docs(spark, texts).where("false")).count() == 0


@pytest.mark.parametrize("size", [16 << 20, 300])
def test_wide_buckets_of_one_passage_lose_no_link(spark, monkeypatch, size):
    """Documents that share most of a passage meet in wide buckets; blocks of texts are cut by bytes."""
    for name, value in (("SPREAD", 2), ("LEFT", 3), ("RIGHT", 4), ("BLOCK_BYTES", size)):
        monkeypatch.setattr(minhash, name, value)
    shared, texts = words(40, 1), []
    for k in range(40):
        own = words(24, 100 + k // 2)
        texts.append(" ".join(own + shared + words(k % 2 * 3, 500 + k)))
    got = {r.doc_id: r.component_id for r in minhash.components(docs(spark, texts)).collect()}
    known = minhash.WordHashes()
    sets = [set(minhash.shingles(t, known).tolist()) for t in texts]
    linked = [(a, b) for a in range(40) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = list(range(40))
    for a, b in linked * 40:
        root[a] = root[b] = min(root[a], root[b])
    assert len(linked) >= 20 and [got[k] for k in range(40)] == root


def test_minhash_null_and_repeated_ids(spark):
    text = " ".join(words(30, 1))
    rows = [(None, text), (5, text), (5, text), (3, "other words that stand here alone"), (7, text)]
    got = sorted(minhash.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [(None, None, True), (3, 3, True), (5, 5, True), (5, 5, True), (7, 5, False)]


def test_deduplication_keeps_one_row_of_an_id(spark):
    text = " ".join(words(30, 1))
    rows = [(None, text, 1), (None, text, 2), (5, text, 3), (5, text, 4), (3, "b", 5), (3, "a", 6), (3, None, 7), (7, text, 8), (9, "alone", 9)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, n int").withColumn("id", F.col("n"))
    got = sorted(((r.doc_id, r.text) for r in minhash.deduplicated(d).collect()), key=str)
    assert got == sorted([(None, text), (None, text), (5, text), (3, None), (9, "alone")], key=str)
    assert minhash.deduplicated(d.where("false")).count() == 0
    assert minhash.deduplicated(d.where("doc_id = 9")).columns == d.columns


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = {r.id: r.root for r in common.connected(spark.createDataFrame(edges, "a bigint, b bigint"), "t").collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 160))
    forest = spark.createDataFrame([(i + 1, i) for i in range(50)], "a bigint, b bigint")
    assert {r.root for r in common.roots(forest, "t").collect()} == {0}


def test_tiling_catches_reordered_passages(spark):
    items = [" ".join(words(40, 300 + k)) for k in range(5)] + ["three short words", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    w = items[1].split()
    texts = [
        f"start {items[0]} end", "before " + " ".join(w[20:]) + " middle " + " ".join(w[:20]), " ".join(items[2].split()[:12]), " ".join(words(50, 1)), "has THREE short, words! inside",
        " ".join(x if k % 4 else "edited" for k, x in enumerate(items[3].split())), *ODD,
    ]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (4, 5)}
    assert got[0, 0].coverage == 1 and got[1, 1].n_tiles == 2 and got[1, 1].coverage == 1
    kept = {r.doc_id for r in decontaminate.clean(docs(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {0, 1, 4}
    assert decontaminate.leaks(docs(spark, texts), bench.where("false")).count() == 0
    assert decontaminate.clean(docs(spark, texts), bench.where("false")).count() == len(texts)


def test_tiles_are_longest_first_by_brute_force():
    rng = np.random.default_rng(5)

    def greedy(text, item, least):
        used_t, used_i, count = set(), set(), 0
        while True:
            best = (0, 0, 0)
            for i in range(len(text)):
                for j in range(len(item)):
                    n = 0
                    while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and i + n not in used_t and j + n not in used_i:
                        n += 1
                    if n > best[0]:
                        best = (n, i, j)
            if best[0] < least:
                return len(used_i), count
            used_t |= set(range(best[1], best[1] + best[0]))
            used_i |= set(range(best[2], best[2] + best[0]))
            count += 1

    for _ in range(60):
        item, text = rng.integers(1, 4, 20).astype(np.uint64), rng.integers(1, 4, 30).astype(np.uint64)
        assert decontaminate.tiles(text, item)[:2] == greedy(text.tolist(), item.tolist(), 5)


@pytest.mark.parametrize("few", [200_000, 0])
def test_leaks_against_brute_force(spark, monkeypatch, few):
    """Items that share runs with each other, reordered and cut passages, repeated rows, and a bitmap full of collisions."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", few)
    rng = random.Random(21)
    parts = [words(rng.randint(4, 9), k, 60) for k in range(12)]
    items = [sum(rng.sample(parts, rng.randint(1, 4)), []) for _ in range(25)] + [["solo"], ["two", "words"]]
    texts = []
    for _ in range(120):
        text = words(rng.randint(0, 20), rng.random(), 60)
        for p in rng.sample(parts, rng.randint(0, 4)):
            at = rng.randint(0, len(text))
            text[at:at] = p if rng.random() < 0.8 else p[: len(p) // 2] + ["cut"] + p[len(p) // 2 :]
        texts.append(" ".join(text))
    texts += texts[:10] + ["has two words", "solo", None, ""]
    want = Counter()
    for k, t in enumerate(texts):
        mine = (t or "").split()
        for i, item in enumerate(items):
            size = min(5, len(item))
            number = {w: n + 1 for n, w in enumerate(sorted({*mine, *item}))}
            covered, count, _ = decontaminate.tiles(np.array([number[w] for w in mine], np.uint64), np.array([number[w] for w in item], np.uint64))
            if covered >= 0.5 * len(item) and len(mine) >= size:
                want[k, i, covered, count] += 1
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(None, "two words"), (90, None), (91, " ")], "item_id bigint, text string")
    d = docs(spark, texts).withColumn("row", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = Counter((r.doc_id, r.item_id, r.n_covered, r.n_tiles) for r in decontaminate.leaks(d, bench).collect())
    assert got == want and len(want) > 50
    assert {r.doc_id for r in decontaminate.clean(d, bench).collect()} == set(range(len(texts))) - {x[0] for x in want}


def test_running_hashes_are_of_the_words_alone():
    w = np.array([5, 9, 5, 9, 5, 7, 2**63, 5, 9, 5], np.uint64)
    for size in range(1, 4):
        runs = decontaminate.Running(w).runs(size).tolist()
        assert len(set(runs)) == len({tuple(w[k : k + size].tolist()) for k in range(len(w) - size + 1)}) and runs[0] == runs[7 if size < 4 else 0]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS.values()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            checks = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 12 <= len(digits) <= 19 and sum((lambda n: n - 9 if n > 9 else n)(int(c) * (1 + i % 2)) for i, c in enumerate(digits[::-1])) % 10 == 0, 9 <= len(digits) <= 15)
            if checks[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    parts = ["a", "b.c", "@", "x@y.zz", ".", "-", "+1", "+", "12", "4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "300.1.1.1", "5.6.7.8.9", " ", "(017) 555-7713", "+1 (017) 555-7713", "%", "é", "٣", "\n", "@@"]
    for _ in range(8000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_calls_without_id_and_all_keywords_are_validated(spark):
    tool = {"tools": [{"name": "f", "parameters": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 3}}}}]}
    call = [{"tool_calls": [{"name": "f", "arguments": {"n": n}}]} for n in ("x", 1, 4)]
    rows = [(1, k, "assistant", json.dumps(x)) for k, x in enumerate([tool, *call])]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("turn").collect()
    assert [r.n_invalid for r in got] == [0, 1, 1, 0]
    bad = [
        (2, {"minimum": 3}), (4, {"maximum": 3}), (3, {"exclusiveMaximum": 3}), (5, {"multipleOf": 2}), ("a", {"minLength": 2}), ("abc", {"maxLength": 2}), ("a", {"pattern": "^b"}), (1, {"const": True}),
        (1, {"anyOf": [{"type": "string"}, {"minimum": 2}]}), (1, {"oneOf": [{"type": "integer"}, {"minimum": 0}]}), (1, {"allOf": [{"minimum": 2}]}), (1, {"not": {"type": "integer"}}), ([1, 1], {"uniqueItems": True}),
        ({"a": 1}, {"properties": {"a": {"$ref": "#/$defs/s"}}, "$defs": {"s": {"type": "string"}}}), ({"a": 1}, {"additionalProperties": {"type": "string"}}), ([1], {"minItems": 2}), (1, {"$ref": "http://x/y"}), (1, {"$ref": "#"}), ({}, {"unevaluatedProperties": False}),
        ("a", {"pattern": "("}), (1, {"if": {"minimum": 0}, "then": {"minimum": 5}}), ({"a": 1}, {"dependentRequired": {"a": ["b"]}}),
    ]
    for value, schema in bad:
        assert chat.violations(value, schema), schema
    good = [(3, {"minimum": 3, "maximum": 3}), (1.0, {"const": 1}), ("ab", {"pattern": "b$"}), (1, {"oneOf": [{"type": "integer"}, {"type": "string"}]}), ({"x": {"x": {}}}, {"properties": {"x": {"$ref": "#"}}}), (True, {"maximum": 0})]
    for value, schema in good:
        assert not chat.violations(value, schema), schema


def test_disclosing_terms_by_brute_force(spark):
    secret = "zed@mail.example.com"
    texts = [f"report {k} about quixotic of {secret} with ordinary words" for k in range(6)] + [f"note {k} with ordinary words about nothing" for k in range(300)] + ODD
    found = {r.doc_id: r for r in pii.find(docs(spark, texts)).withColumn("text", pii.spans_text()).collect()}
    assert len(found) == len(texts)
    for i in range(6):
        names = {texts[i][s.s : s.e] for s in found[i].spans if s.k == 4}
        assert "quixotic" in names and not names & {"ordinary", "words", "about", "with"}
        assert found[i].kinds == [1, 0, 0, 0] and found[i].base_sha256 == hashlib.sha256(",".join(f"email:{s}:{e}" for s, _, e in plain_spans(texts[i])).encode()).hexdigest()
    assert all(not found[i].spans for i in range(6, len(texts)))
    out = {r.doc_id: r for r in pii.masked(docs(spark, texts).withColumn("spans", F.lit("clash")).withColumn("row", F.lit(1))).collect()}
    assert all(r.spans == "clash" and r.row == 1 for r in out.values())
    assert secret not in out[0].text and "[EMAIL]" in out[0].text and "quixotic" not in out[0].text
    assert [out[i].text for i in range(6, len(texts))] == texts[6:]
    copies = docs(spark, [texts[0]] * 10)  # one text and its copies are no statistics
    assert all({s.k for s in r.spans} == {0} for r in pii.find(copies).collect())


def test_disclosing_terms_anywhere_in_the_document_and_of_rare_entities(spark):
    far = "Quixotic signs\n" + "plain words stand here " * 8
    texts = [f"{far}\n{k} zed@mail.example.com\n" + "plain words stand here " * 8 + "quixotic" for k in range(5)]
    texts += [f"Zephyrine {k} writes from yan@mail.example.com" for k in range(2)]  # met in two texts only
    texts += [f"note {k} with plain words stand here writes from signs" for k in range(300)]
    found = {r.doc_id: r for r in pii.find(docs(spark, texts)).collect()}
    for i, (term, times) in enumerate([("quixotic", 2)] * 5 + [("zephyrine", 1)] * 2):
        names = [texts[i][s.s : s.e].lower() for s in found[i].spans if s.k == 4]
        assert names == [term] * times
    assert all(not found[i].spans for i in range(7, len(texts)))


def test_disclosing_terms_equal_counted_pmi(spark):
    rng = random.Random(12)
    people = [(f"name{k}", f"{'abcdefgh'[k]}@host{'xyz'[k % 3]}.example.org", "q" + "abcdefgh"[k] * 4) for k in range(8)]
    texts = []
    for _ in range(400):
        text = words(rng.randint(3, 15), rng.random(), size=60)
        for name, mail, alias in rng.sample(people, rng.choice([0, 0, 0, 1, 1, 2])):
            text += [mail] * rng.randint(0, 1) + [alias] * (rng.random() < 0.8) + [alias.upper() + "!"] * (rng.random() < 0.2)
        rng.shuffle(text)
        texts.append(" ".join(text))
    texts += rng.sample(texts, 60)
    plain = [{m[0].lower() for m in re.finditer(r"[^\W\d_]{4,}", t)} for t in texts]
    held = [pii.entities(t, pii.base_spans(t)) for t in texts]
    want, number = set(), len(texts)
    for e in set().union(*held):
        p = sum(e in h for h in held) / number
        for t in set().union(*(x for x, h in zip(plain, held, strict=True) if e in h)):
            both = [x for x, h, ws in zip(texts, held, plain, strict=True) if e in h and t in ws]
            one = len(both) / len(set(both))
            if (len(both) - one + one * p / 2) / (sum(t in ws for ws in plain) - one / 2) > p ** (1 - pii.ALPHA):
                want |= {(x, t) for x in both}
    got = set()
    for r in pii.find(docs(spark, texts)).collect():
        got |= {(texts[r.doc_id], texts[r.doc_id][s.s : s.e].lower()) for s in r.spans if s.k == 4}
    def blanked(x):
        for a, _, b in pii.base_spans(x):
            x = x[:a] + " " * (b - a) + x[b:]
        return x

    inside = {(x, t) for x, t in want if not re.search(rf"(?<![^\W\d_]){t}(?![^\W\d_])", blanked(x), re.I)}
    assert len(want) > 20 and got == want - inside


def test_disclosing_terms_need_another_document(spark):
    texts = [f"single{'abcdefgh'[k]} words of u{k}@mail{k}.example.org" for k in range(8)] + ["other words of nobody"] * 50
    assert all({s.k for s in r.spans} <= {0} for r in pii.find(docs(spark, texts)).collect())


def test_pii_on_empty_tables_and_clashing_columns(spark):
    d = docs(spark, [*ODD, "a@b.example.org wrote"]).withColumn("row", F.lit(1)).withColumn("more", F.lit(2)).withColumn("kinds", F.lit("x"))
    assert pii.find(d.where("false")).count() == 0 and pii.masked(d.where("false")).count() == 0
    assert {r.row for r in pii.find(d, ("row", "more")).collect()} == {1}
    out = pii.masked(d)
    assert out.columns == d.columns and {(r.doc_id, r.text) for r in out.collect()} == {(r.doc_id, (r.text or "").replace("a@b.example.org", "[EMAIL]") if r.text is not None else None) for r in d.collect()}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies &amp; more</div><!-- x -->
{open}<h1>Head&nbsp;line &lt;1&gt;</h1><p>First   para<br>with <b>bold</b> words.<p>Second para with many more plain words here.</p><div class="ad">Buy now</div><ul><li>Item</li></ul>
<section class="comments"><p>I disagree a lot with this whole thing</p></section>{close}
<aside>Side text</aside><form><input name=q>Search</form><footer>&copy; 2024 Foot</footer></body></html>"""
BODY = "Head line <1>\nFirst para with bold words.\nSecond para with many more plain words here.\nItem"


def test_html_text(spark):
    pages = [PAGE.format(open="<article>", close="</article>"), PAGE.format(open="<div>", close="</div>"), None, "", "<p>", "<<<>>", "<article><p>Only &am this", "plain text"]
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got[0] == BODY
    assert got[1] == BODY
    assert got[2] == got[3] == got[4] == "" and got[6] == "Only &am this" and got[7] == "plain text"
    assert html.extract(df.where("false")).count() == 0


def test_html_text_of_all_articles_of_the_run_and_behind_unclosed_elements(spark):
    words = ["one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen", "fifteen sixteen seventeen eighteen"]
    several = f"<body><article><p>{words[0]}</p></article><p>{words[1]}</p><article><p>{words[2]}</p></article></body>"
    unclosed = [f"<article><p>{words[0]}</p>{x}<p>{words[1]}</p></article>" for x in ('<svg width="1"/>', "<datalist><option value=a><option value=b></datalist>", "<object data=x>", "<svg><title/><g/></svg>")]
    pages = spark.createDataFrame([(i, "u", p) for i, p in enumerate([several, *unclosed])], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages, {}).collect()}
    assert got[0] == "\n".join(words)
    assert [got[i] for i in range(1, 5)] == ["\n".join(words[:2])] * 4


def test_html_weights_decide_where_no_list_word_tells():
    """Labelled pages teach which classes hold no main text; a page without an article element is cut by that."""
    rng = random.Random(8)
    teaser, main = (lambda: " ".join(words(12, rng.random()))), (lambda: "".join(f"<p>{' '.join(words(20, rng.random()))}</p>" for _ in range(4)))
    total = Counter()
    for _ in range(60):
        total.update(html.Page(f"<body><div class=zq><b>{teaser()}</b></div><article><div class=xk>{main()}</div></article><div class=zq>{teaser()}</div></body>").counts())
    weights = {}
    for kind, key, _ in total:
        i, o = total[kind, key, True], total[kind, key, False]
        weights[kind, key] = (i + 1) / (i + o + 2) - (kind == "t")
    body = main()
    page = html.Page(f"<body><div class=zq><b>{teaser()}</b></div><div class=xk>{body}</div><div class=zq>{teaser()}</div></body>")
    want = "\n".join(x for x in re.split("</?p>", body) if x)
    assert page.text(weights) == want and page.text({}) != want


def test_html_frames_heads_and_paragraphs_keep_their_text():
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    cases = [
        f"<form action=x><article><h1>{a}</h1><p>{b}</p></article></form>", f"<form><header>Site</header><div><p>{a}</p><p>{b}</p></div><input></form>",
        f"<article><div class=entry-header><h1>{a}</h1></div><p>{b}</p></article>", f"<article><p class=related-work>{a}</p><p>{b}</p></article>",
        f"<article><p>one two <label>three</label> four five six</p><p>{b}</p></article>", f"<article><p>{a}</p><form><p>Your mail</p><input></form><p>{b}</p></article>",
        f"<article><p>{a}</p><div class='ad-box'>Buy this now</div><p>{b}</p><section class=comments><article>Nice text said one</article></section></article>",
        f"<article><p>{a}</p><select><option>x</select><p>{b}</p></article>",
    ]
    for page in cases:
        assert html.Page(page).text({}) == f"{a}\n{b}", page


def test_html_long_pages_and_clashing_columns(spark):
    text = "\n".join(" ".join(words(9, k)) for k in range(20_000))
    page = "<body><nav><a>x</a></nav><form>" * 50 + "<article>" + "".join(f"<p>{x}</p>" for x in text.split("\n")) + "</article>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None)], "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = html.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, len(text), len(text)] and {r.text for r in got} == {"", text}


def test_region_is_the_maximum_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(200):
        weights = {("t", "p"): -1.0, ("w", "x"): 1.0, ("w", "y"): -0.7}
        page = html.Page("")
        page.tokens = [("w", rng.choice(["x", "y"]), "one two"[: 3 + 4 * int(rng.integers(2))], False, 0) if rng.random() < 0.6 else ("t", "p", "p", False, 0) for _ in range(30)]
        value = [weights[k, key] * (len(t.split()) if k == "w" else 1) for k, key, t, _, _ in page.tokens]
        a, b = page.region(weights)
        best = max((sum(value[i:j]) for i in range(30) for j in range(i, 31)), default=0)
        assert abs(sum(value[a:b]) - max(best, 0)) < 1e-9


def test_lattice_decoding_is_nearest():
    rng = np.random.default_rng(0)
    assert len(lattice.minimal_vectors()) == 240 and len({tuple(v) for v in lattice.minimal_vectors()}) == 240
    x = rng.normal(size=(300, 8)) * 2
    near = lattice.decode(x)
    doubled = np.rint(near * 2)
    assert np.allclose(near * 2, doubled) and ((doubled % 2).std(axis=1) == 0).all() and (near.sum(axis=1) % 2 == 0).all()
    others = near[:, None, :] + lattice.minimal_vectors()[None]
    assert (((x - near) ** 2).sum(1)[:, None] <= ((x[:, None] - others) ** 2).sum(2) + 1e-9).all()


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 64))
    rows = [base[i] / np.linalg.norm(base[i]) + rng.normal(size=64) * rng.choice([0.01, 0.03, 0.05]) for i in rng.integers(0, 60, 300)]
    rows += [rows[0]] * 4
    vecs = [r.astype(np.float32).tolist() for r in rows] + [None, [], [0.0] * 64, [float("nan")] * 64, [1.0] * 3, [None] * 64, [float("inf")] * 64]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vecs)], "vec_id bigint, embedding array<float>, label int").withColumn("id", F.lit(7))
    x = np.array(vecs[:304], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = x @ x.T >= 0.9
    np.fill_diagonal(g, False)
    got = {r.vec_id: r for r in lattice.near_duplicates(df).collect()}
    links = np.array([got[i].n_links for i in range(304)])
    assert (links <= g.sum(1)).all() and links.sum() >= 0.98 * g.sum()
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(304, len(vecs)))
    for i in range(304):
        assert got[i].component_id <= i and got[i].kept == (got[i].component_id == i)
    assert lattice.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("block", [256, 4])
def test_links_of_tight_groups_are_counted_exactly(spark, monkeypatch, block):
    """Groups of near copies, some about as far from each other as the threshold, with copies and shared ids."""
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(6, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    base[1] = base[0] * 0.9 + base[1] * np.sqrt(1 - 0.81)
    base[2] = base[0] * 0.95 + base[2] * np.sqrt(1 - 0.95**2)
    vecs = [base[g] * rng.uniform(0.1, 5) + rng.normal(size=48) * s for g, s, n in ((0, 0.01, 60), (1, 0.01, 40), (2, 0.02, 30), (3, 0.03, 20), (4, 0.06, 20), (5, 0.0, 5)) for _ in range(n)]
    vecs += vecs[:10]
    order = rng.permutation(len(vecs))
    rows = [(int(k), vecs[i].tolist()) for k, i in enumerate(order)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = x @ x.T >= 0.9
    np.fill_diagonal(g, False)
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= g.sum(1)).all() and found.sum() >= 0.99 * g.sum()
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[i], *(root[j] for j in np.flatnonzero(g[i])), root[i]) for i in range(len(rows))]
    assert [got[i].component_id for i in range(len(rows))] == root
    shared = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (0, [0.01, 1.0])], "vec_id bigint, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in lattice.near_duplicates(shared).collect()) == [(0, 1, 0), (1, 1, 0), (1, 1, 1), (2, 1, 1)]


def test_chat_links_orders_and_validates(spark):
    schema = {"type": "object", "properties": {"city": {"type": "string"}, "days": {"type": "integer"}}, "required": ["city"], "additionalProperties": False}
    call = lambda i, **a: json.dumps({"tool_calls": [{"id": i, "function": {"name": "weather", "arguments": json.dumps(a)}}]})
    rows = [
        (1, 0, "system", json.dumps({"tools": [{"name": "weather", "parameters": schema}]})), (1, 1, "user", "Ünï \"q\"\n"), (1, 3, "assistant", call("c1", city="Rome", days=2)),
        (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": "sunny"})), (1, 4, "assistant", call("c2", days=True, x=1)), (1, 5, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})),
        (2, 0, None, None), (2, 1, "user", '{"tool": broken'), (None, 0, "user", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("step", F.lit("clash"))
    got = chat.format_conversations(df).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.at_turn, r.step, r.turn))
    assert [r.turn for r in one] == [0, 1, 3, 2, 4, 5]
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 3].n_answered == 1 and by[1, 3].n_invalid == 0 and by[1, 2].linked is True and by[1, 5].linked is False
    assert by[1, 4].n_answered == 0 and by[1, 4].n_invalid == 1
    assert json.loads(by[1, 4].message)["tool_calls"][0]["violations"] == ["$.city: missing", "$.x: not allowed", "$.days: not of type integer"]
    assert by[1, 1].message == '{"content":"Ünï \\"q\\"\\n","role":"user"}' and by[2, 0].message == '{"content":"","role":""}'
    assert all(canon == json.dumps(json.loads(canon), ensure_ascii=False, sort_keys=True, separators=(",", ":")) for canon in (r.message for r in got))
    assert chat.format_conversations(df.where("false")).count() == 0


def chat_plainly(rows):
    """Places, answered calls and violated schemas of messages by walking each conversation."""
    out = {}
    parsed = [(k, c, t, *chat.parse(text)) for k, (c, t, _, text) in enumerate(rows)]
    for k, conv, turn, calls, answers, _, _ in parsed:
        def parent(i):
            row = parsed[i]
            found = [(r[2], r[0]) for r in parsed if r[1] == row[1] and row[4] is not None and any(c["id"] == row[4] for c in r[3])]
            return min(found)[1] if found else None
        at, path, seen = k, [], set()
        while at is not None and at not in seen:
            seen.add(at)
            path.append((parsed[at][2], len(path)))
            at = parent(at)
        invalid = 0
        for c in calls:
            known = [(r[2], r[0], p, x["schema"]) for r in parsed if r[1] == conv and r[2] <= turn for p, x in enumerate(r[5]) if x["name"] == c["name"]]
            invalid += bool(known and chat.violations(c["arguments"], json.loads(max(known)[3])))
        answered = sum(any(r[1] == conv and r[4] == c["id"] for r in parsed) for c in calls if c["id"])
        out[conv, turn] = ((turn, 0) if at is not None else max(path), answered, invalid, None if answers is None else parent(k) is not None)
    return out


def random_calls(seed, conversations, length):
    """Conversations of calls, results that may call again, circles, repeated ids and schemas that change."""
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        n = rng.randint(1, length)
        for turn in range(n):
            message = {}
            if rng.random() < 0.6:
                message["tool_calls"] = [{"id": rng.choice(["", f"c{rng.randrange(n)}"]), "name": rng.choice("ab"), "arguments": {"x": rng.randint(0, 9)}} for _ in range(rng.randint(1, 2))]
            if rng.random() < 0.6:
                message["tool_call_id"] = f"c{rng.randrange(n)}"
            if rng.random() < 0.3:
                message["tools"] = [{"name": rng.choice("ab"), "parameters": {"properties": {"x": {"maximum": rng.randint(0, 9)}}}} for _ in range(rng.randint(1, 2))]
            rows.append((conv, turn, "x", json.dumps(message) if message else "plain"))
    return rows


def test_chat_against_brute_force(spark):
    rows = random_calls(5, 40, 9) + [(99, t, "tool", json.dumps({"tool_calls": [{"id": f"d{t}"}], **({"tool_call_id": f"d{t + 1}"} if t < 29 else {})})) for t in range(30)]
    want = chat_plainly(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    got = chat.format_conversations(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert ((r.at_turn, r.step), r.n_answered, r.n_invalid, r.linked) == want[r.conv_id, r.turn], (r.conv_id, r.turn)
    chain = sorted((r for r in got if r.conv_id == 99), key=lambda r: (r.at_turn, r.step, r.turn))
    assert [r.turn for r in chain] == list(range(29, -1, -1))  # each answers the next turn's call


def test_chat_takes_odd_json(spark):
    deep = '{"tool_call_id":"x","content":' + "[" * 100_000 + "]" * 100_000 + "}"
    call = lambda schema: (json.dumps({"tools": [{"name": "f", "parameters": schema}]}), json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": {"x": 1.0}}]}))
    odd = ['{"tool_call_id":"x","content":"\\ud83d"}', '{"tool_call_id":"\\ud83d","content":1}', deep, '{"tool_call_id":NaN}', '{"tool_call_id":"x","content":1e999}', '{"tool_calls":{"id":1}}', '{"tools":[1,{"name":2}]}', '{"tool_calls":[{"id":0,"name":[1],"arguments":"{"}]}', "tool" * 500_000]
    rows = [(1, k, None, t) for k, t in enumerate(odd)] + [(1, 0, None, odd[0])] * 2 + [(None, None, None, odd[0])]
    for k, schema in enumerate([{"required": 3}, {"properties": [1]}, {"type": 5}, {"enum": 5}, {"properties": {"x": {"type": "integer"}}}, {"enum": [{"x": True}]}]):
        rows += [(10 + k, t, "a", text) for t, text in enumerate(call(schema))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.format_conversations(df).collect()
    assert len(got) == len(rows)
    assert [next(r.n_invalid for r in got if r.conv_id == 10 + k and r.turn == 1) for k in range(6)] == [1, 1, 1, 1, 0, 1]
    assert {r.message for r in got if r.conv_id == 1 and r.turn == 0} == {'{"content":"\\ud83d","role":"","tool_call_id":"x"}'}
    assert json.loads(next(r.message for r in got if r.conv_id == 1 and r.turn == 2))["content"] == deep


def test_scope_leaves_nothing(spark):
    from pathlib import Path

    root = Path(common.shared_dir(spark)) / f"corvane-{spark.sparkContext.applicationId}"
    with common.scope(spark):
        assert common.written(spark.range(3), "x").count() == 3
        assert list(root.glob("scope-*/x-*"))
    assert not list(root.glob("scope-*"))


def test_pipeline_on_odd_and_empty_documents(spark, tmp_path):
    import corpus_pipeline

    text = " ".join(words(40, 1))
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, text + " more", "en", "s", None), (3, None, None, None, None), (4, "", "en", "s", 0), (None, "a null id " + text, "en", "s", 1), (5, "12 34 !!", "en", "s", 8), (6, "mail x@y.example.org of " + " ".join(words(30, 2)), "en", "s", 3)]
    for name, data in (("odd", rows), ("empty", [])):
        spark.createDataFrame(data, DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        common.table(spark, SMALL, "benchmark").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sorted(((r.doc_id is None, r.doc_id) for r in out)) == [(False, 1), (False, 6), (True, None)]
    mine = next(r for r in out if r.doc_id == 6)
    assert mine.decoded_sha256 == hashlib.sha256(rows[7][1].replace("x@y.example.org", "[EMAIL]").encode()).hexdigest()
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_pipeline_stages_in_sequence(spark):
    import corpus_pipeline

    data = common.table(spark, SMALL, "documents").collect()
    ids = {r.doc_id for r in data}
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in out} < ids and len(out) == len({r.doc_id for r in out}) and len(out) > len(ids) // 2
    d = common.table(spark, SMALL, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "PII", "byte-level BPE"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, SMALL).columns == d.columns
    kept = {r.doc_id for r in minhash.components(corpus_pipeline.language(spark, d, SMALL)).where("kept").collect()}
    leaked = {r.doc_id for r in decontaminate.leaks(d, common.table(spark, SMALL, "benchmark")).collect()}
    assert {r.doc_id for r in out} == kept - leaked
    assert Counter(r.decoded_sha256 for r in out)


def test_batches_to_workers_are_bounded_by_bytes(spark):
    """A stage's texts go to a worker in batches of a few MB, not of 10,000 rows of any length."""
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    rows = spark.range(400, numPartitions=1).select("id", F.repeat(F.lit("word "), 10_000).alias("text"))
    got = rows.mapInArrow(sizes, "n bigint, bytes bigint").collect()
    assert sum(r["n"] for r in got) == 400
    assert max(r["bytes"] for r in got) < 8 << 20


def test_a_worker_holds_models_of_one_operator_only(tokenizer):
    bpe.load(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(256)), P.PATTERN)
    assert {owner for owner, _ in common._HELD} == {"bpe"}
    keys = langid.vocabulary_keys(b"")
    assert langid._lattice(keys) is langid._lattice(list(keys))
    assert {owner for owner, _ in common._HELD} == {"langid"}
    common.let_go()
    assert not common._HELD


def test_survivors_do_not_depend_on_how_many_pairs_are_compared_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 2, (40, minhash.SIZE), dtype=np.uint32)
    sig[20:] = np.where(rng.random((20, minhash.SIZE)) < 0.1, sig[20:], sig[:20])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    least = minhash.least_matches(0.75)
    same = (sig[i] == sig[j]).reshape(len(i), -1, minhash.BATCH).sum(axis=2).cumsum(axis=1)
    want = np.flatnonzero((same >= np.array(list(least.values()))).all(axis=1))
    for size in (7, 1 << 14):
        monkeypatch.setattr(minhash, "PAIRS", size)
        assert minhash._survive(sig, i, sig, j, least).tolist() == want.tolist()
    assert 40 < len(want) < len(i)
