"""Operators on training text against brute force, a public tokenizer and exact round trips."""

import hashlib
import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers.normalizers import BertNormalizer
from tokenizers.pre_tokenizers import BertPreTokenizer

from tidewell.llm import contamination, mixing, splitting
from tidewell.llm.tokens import token_count

NORMAL, SPLIT = BertNormalizer(clean_text=True, handle_chinese_chars=True, strip_accents=False, lowercase=False), BertPreTokenizer()


def public_tokens(text):
    return [t for t, _ in SPLIT.pre_tokenize_str(NORMAL.normalize_str(text))] if text else []


ALPHABET = "abcXYZ019 \n\t.,;:!?()[]{}$+<=>^`|~_-'\"éßøжשع日本語の軸要約。！？ﬁ²½°µ€…–—​­﻿　 ﷐😀한글"


def noise(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


# --- tokens ---


def test_token_count_is_that_of_the_public_tokenizer(spark):
    rng = random.Random(3)
    texts = [noise(rng, rng.randrange(0, 200)).replace("﷐", "") for _ in range(400)] + ["", None, "  \n ", "don't stop", "a​b", "​", "日本語です", "x" * 100_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count("t")).collect()]
    assert got == [len(public_tokens(t)) for t in texts]


# --- 8 ---


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The  Valve, (12) cools [0001] it.", ["the", "valve", "cools", "it"]), ("a broken-\nword and well-known", ["a", "brokenword", "and", "well", "known"]), ("sof­t hy​phen", ["soft", "hyphen"]),
        ("ﬁne ①２", ["fine", "12"]), ("snake_case (1, 2) (x1)", ["snake", "case", "x1"]), ("a -\nb", ["a", "b"]), ("line­\nend", ["lineend"]), ("", []), (None, []), ("軸は回る", ["軸は回る"]), ("x\U000e0041y", ["xy"]),
    ],
)
def test_words(text, want):
    assert contamination.words(text) == want


def brute_pairs(docs, items, span):
    grams = defaultdict(set)
    for i, t in items:
        w = contamination.words(t)
        for k in range(len(w) - span + 1):
            grams[tuple(w[k : k + span])].add(i)
    out = set()
    for d, t in docs:
        w = contamination.words(t)
        for k in range(len(w) - span + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + span]), ())}
    return out


def corpus(seed):
    rng = random.Random(seed)
    common = ["the", "of", "a", "valve", "rotor", "holds", "near", "when", "lens", "is"]
    names = [f"name{k}" for k in range(400)]
    sentence = lambda n: [rng.choice(common) if rng.random() < 0.6 else rng.choice(names) for _ in range(n)]
    items = [(k, " ".join(sentence(rng.randrange(5, 70)))) for k in range(40)]
    items += [(100, items[3][1]), (101, None), (102, ""), (103, " ".join(["the"] * 20))]
    docs = []
    for d in range(120):
        w = [rng.choice([*common, "foreign", "words"]) for _ in range(rng.randrange(0, 150))]
        if d % 3 == 0:
            src = rng.choice(items[:40])[1].split()
            n = rng.choice([10, 12, 13, 14, 20, 70])
            at = rng.randrange(max(1, len(src) - n + 1))
            piece = [x.upper() if rng.random() < 0.2 else x for x in src[at : at + n]]
            if rng.random() < 0.4:
                piece.insert(len(piece) // 2, "(17)")
            k = rng.randrange(len(w) + 1)
            w[k:k] = piece
        docs.append((d, (" " if d % 2 else ",\n").join(w)))
    docs += [(500, None), (501, ""), (502, docs[0][1]), (503, docs[0][1]), (504, " ".join(t for _, t in items if t) * 3), (505, "the " * 5000)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_against_brute_force(spark, seed):
    docs, items = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("item_id", F.lit(2)).repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(7))
    rows = contamination.leaks(d, i).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["run"] >= 13} == brute_pairs(docs, items, 13)
    assert len(rows) == len({(r["doc_id"], r["item_id"]) for r in rows})
    whole = {r["item_id"]: r["run"] for r in rows if r["doc_id"] == 504}
    assert all(whole[k] >= len(t.split()) for k, t in items if t and len(t.split()) >= 13)


@pytest.mark.parametrize("block", [50, 400])  # the smaller cuts items
def test_leaks_in_blocks_of_items(spark, block):
    docs, items = corpus(4)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contamination.leaks(d, i, block=block).collect() if r["run"] >= 13}
    assert got == brute_pairs(docs, items, 13)


def test_blocks_read_the_corpus_once(spark, monkeypatch):
    docs, items = corpus(4)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    calls = []
    plain = contamination.passages
    monkeypatch.setattr(contamination, "passages", lambda *a: calls.append(1) or plain(*a))
    some = {tuple(r) for r in contamination.leaks(d, i, block=300).select("doc_id", "item_id", "run", "lcs").where("run >= 13").collect()}
    whole = {tuple(r) for r in contamination.leaks(d, i).select("doc_id", "item_id", "run", "lcs").where("run >= 13").collect()}
    assert len(calls) == 2 and {x[:3] for x in some} == {x[:3] for x in whole} and whole


def test_leaks_empty(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, " ".join("abcdefghijklmnop"))], "item_id bigint, text string")
    assert contamination.leaks(d.limit(0), i).count() == contamination.leaks(d, i.limit(0)).count() == contamination.leaks(d, i).count() == 0


def test_paraphrase_is_reported(spark):
    item = "if lens theve loses eighty percent of its residue then venicnic records the porous coil of series winickespim before lunch"
    para = item.replace("records", "writes").replace("lunch", "supper")  # words that no item has
    d = spark.createDataFrame([(1, para), (2, "nothing alike")], "doc_id bigint, text string")
    rows = contamination.leaks(d, spark.createDataFrame([(5, item)], "item_id bigint, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in rows] == [(1, 5)] and rows[0]["lcs"] >= 10 and rows[0]["answer"] >= 0.7


def test_paraphrase_beside_a_reordered_copy(spark):
    item = "if lens theve loses eighty percent of its residue then venicnic records coils"
    w = item.split()
    text = " ".join([*reversed(w), *w[:11], "supper", w[12]])  # the reversed window has cosine 1 and no order
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = contamination.leaks(d, spark.createDataFrame([(5, item)], "item_id bigint, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in rows] == [(1, 5)] and rows[0]["lcs"] >= 10 and rows[0]["run"] == 0


def test_every_pair_of_the_cosine_is_met():
    rng = np.random.default_rng(4)
    v = (rng.standard_normal((40, 20))[rng.integers(0, 40, 3000)] + 0.4 * rng.standard_normal((3000, 20))).astype(np.float32)
    x = (v[rng.integers(0, 3000, 2000)] + 0.4 * rng.standard_normal((2000, 20))).astype(np.float32)
    v, x = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (v, x))
    centre = contamination.cells_of(v, 64)
    members, least = contamination.reach_of(v, centre, 0.9)
    found = [(int(a), int(b)) for i, j, _ in contamination.pairs_within(x, v, centre, members, least, 0.9) for a, b in zip(i, j)]
    score = x @ v.T
    sure, may = ({(int(a), int(b)) for a, b in zip(*np.nonzero(score >= t))} for t in (0.9001, 0.8999))
    assert sure and sure <= set(found) <= may and len(found) == len(set(found))
    nearest = {(int(a), int(b)) for i, j, _ in contamination.pairs_within(x, v, centre, contamination.members_of(v, centre), None, 0.9) for a, b in zip(i, j)}
    assert not sure <= nearest


def test_common_is_lcs():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 6, (200, 13)), rng.integers(0, 6, (200, 13))
    assert contamination.common(a, b).tolist() == [contamination.lcs(p, q) for p, q in zip(a.tolist(), b.tolist())]


def test_stretches():
    known = np.array([int(c) for c in "0111101101110000111"], dtype=bool)
    for span, slack in ((3, 0), (4, 1), (5, 2), (30, 2)):
        inside = {k for a, b in contamination.stretches(known, span, slack) for k in range(a, b - span + 1)}
        assert inside == {k for k in range(len(known) - span + 1) if known[k : k + span].sum() >= span - slack}


def test_a_copy_meets_its_original_in_its_cell():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 20)).astype(np.float32)
    x = np.vstack([x, x[:500], np.tile(x[:1], (300, 1))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = contamination.cells_of(x, 64)
    members = contamination.members_of(x, centre)
    for size in (1, 7, 1000):  # products of other shapes round otherwise
        for lo in range(0, len(x), size * 37):
            part = x[lo : lo + size]
            assert all(lo + k in members[c] for k, c in enumerate((part @ centre.T).argmax(1)))


def test_latent_space_is_that_of_the_svd(spark):
    rng = np.random.default_rng(2)
    size, span, rank = 120, 13, 8
    weight = rng.zipf(1.6, 4000) % size
    texts = [weight[k : k + 40].tolist() for k in range(0, 4000, 40)] + [[3] * 15]
    idf = rng.random(size) + 1
    w = np.concatenate([contamination.windows(np.array(t), span) for t in texts])
    a = np.zeros((len(w), size))
    for k in range(span):
        np.add.at(a, (np.arange(len(w)), w[:, k]), idf[w[:, k]])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    parts = spark.createDataFrame([(t,) for t in texts], "ids array<int>").repartition(3)
    space = contamination.latent_space(parts, idf, span, rank)[:, :rank]
    exact = np.linalg.svd(a, full_matrices=False)[2][:rank].T
    lost = np.linalg.norm(a - a @ space @ space.T) / np.linalg.norm(a - a @ exact @ exact.T)
    assert lost < 1.05  # the spectrum of random words is nearly flat


# --- 9 ---


def mixture(spark, docs, targets, bits=None):
    sizes = mixing.sized(spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("n_tokens", F.lit(-1)))
    plan = mixing.cuts(sizes, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), bits=bits)
    return sizes, plan, mixing.mix(sizes, plan)


def test_mix_meets_budgets(spark):
    rng = random.Random(6)
    docs = [(k, "w " * rng.randrange(0, 60), rng.choice(["big", "big", "big", "mid", "tiny", None])) for k in range(3000)] + [(9000, None, "mid"), (9001, "", "big")]
    targets = [("big", 0.3, 1), ("mid", 0.3, 4), ("tiny", 0.39, 2), ("none", 0.01, 5)]
    sizes, plan, mixed = mixture(spark, docs, targets)
    total = sum(len((t or "").split()) for _, t, _ in docs)
    have = defaultdict(int)
    for _, t, s in docs:
        have[s] += len((t or "").split())
    b = {r["source"]: r for r in plan.collect()}
    assert {s for s in b if b[s]["short"]} == {s for s, share, reps in targets if reps * have[s] < share * total}
    rows = mixed.collect()
    used, longest = defaultdict(int), max(len((t or "").split()) for _, t, _ in docs)
    for r in rows:
        used[r["source"]] += r["n_tokens"] * r["repeats"]
    for s, share, reps in targets:
        want = min(share * total, reps * have[s])
        assert want - longest < used[s] <= want + 1e-6
        assert all(r["repeats"] <= reps for r in rows if r["source"] == s)
        assert len({r["repeats"] for r in rows if r["source"] == s}) <= 2
    assert None not in used and len(rows) == len({r["doc_id"] for r in rows})
    shown = {r["source"]: r for r in mixing.shares(mixed, plan).collect()}
    assert abs(sum(r["actual_share"] for r in shown.values()) - 1) < 1e-5 and shown["none"]["used_tokens"] == 0


def test_mix_takes_the_first_in_hash_order(spark):
    docs = [(k, "w " * (k % 7 + 1), "s") for k in range(500)]
    order = sorted(range(500), key=lambda k: (int(hashlib.md5(f"{mixing.SEED}/{k}/s".encode()).hexdigest()[:15], 16), k))
    limit, total, want = 0.37 * sum(k % 7 + 1 for k in range(500)), 0, set()
    for d in order:
        total += d % 7 + 1
        if total > limit:
            break
        want.add(d)
    for bits in (None, 1, 12, 20):  # whatever the number of ranges
        assert {r["doc_id"] for r in mixture(spark, docs, [("s", 0.37, 1)], bits)[2].collect()} == want


def test_cuts_are_on_the_way_to_the_short_sources(spark):
    from tidewell.llm import queries

    from conftest import SF

    plan = queries.p9_found(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "cuts-" in plan
    short = queries._plan(spark, SF)[1].where("short").collect()
    assert short and all(r["passes"] == r["max_repeats"] or not r["available"] for r in short)


def test_mix_empty(spark):
    assert mixture(spark, [], [("s", 1.0, 3)])[2].count() == 0
    assert mixture(spark, [(1, "a b", "s")], [])[2].count() == 0
    sizes, plan, mixed = mixture(spark, [(1, "a b", "s")], [("s", None, None), (None, 0.5, 2)])
    assert mixed.count() == 0 and mixing.shares(mixed, plan).count() == 2


def test_source_listed_twice(spark):
    docs = [(k, "a b", "s") for k in range(100)] + [(k, "a b", "r") for k in range(100, 200)]
    sizes, plan, mixed = mixture(spark, docs, [("s", 0.25, 1), ("s", 0.25, 2), ("r", 0.5, 1)])
    assert mixed.count() == 200 and mixing.shares(mixed, plan).count() == 2


# --- 10 ---


def pieces(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("tokens", F.lit(1)).withColumn("t", F.lit("clash"))
    out = defaultdict(list)
    for r in splitting.split_documents(df, **kw).orderBy("doc_id", "piece_no").collect():
        out[r["doc_id"]].append(r)
    return out


def joined(rows):
    """The text from its pieces: what each adds to the one before, told by token positions."""
    text, ends = "", []
    token = re.compile(r"\S")
    for r in rows:
        skip, at = r["overlap"], 0
        if skip:
            at = next(k for k in range(len(r["piece"]) + 1) if len(public_tokens(r["piece"][:k])) == skip and (k == len(r["piece"]) or len(public_tokens(r["piece"][: k + 1])) > skip) and text.endswith(r["piece"][:k]))
        text += r["piece"][at:]
        ends.append(token)
    return text


def test_split_round_trip(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join("w%d" % rng.randrange(50) for _ in range(rng.randrange(1, 9))) + rng.choice([".", "!", ";", ""])
    docs = []
    for d in range(30):
        docs.append((d, "".join(sentence() + rng.choice([" ", "\n", "\n\n", "\n12. ", "\nClaims\n", "\n[0007] "]) for _ in range(rng.randrange(1, 40)))))
    docs += [(100, None), (101, ""), (102, "w " * 20), (103, "w " * 21), (104, docs[5][1]), (105, "軸" * 61 + "。" + "軸" * 30)]
    got = pieces(spark, docs, limit=20, overlap=4)
    for d, t in docs:
        n = len(public_tokens(t))
        assert (d in got) == (n > 20)
        if d in got:
            rows = got[d]
            assert [r["piece_no"] for r in rows] == list(range(len(rows))) and rows[0]["n_pieces"] == len(rows)
            assert all(r["n_tokens"] <= 20 and r["n_tokens"] == len(public_tokens(r["piece"])) for r in rows)
            assert all(r["overlap"] == (4 if r["piece_no"] else 0) for r in rows)
            assert rows[-1]["first_token"] + rows[-1]["n_tokens"] == n
            assert joined(rows) == t


def test_rejoined_texts(spark):
    rng = random.Random(10)
    docs = [(k, noise(rng, 600).replace("\ufdd0", "")) for k in range(40)] + [(100, "w " * 5000), (101, None), (102, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    back = {r["doc_id"]: (r["text"], r["most_tokens"]) for r in splitting.rejoined(splitting.split_documents(df, limit=30, overlap=5)).collect()}
    long = {d: t for d, t in docs if len(public_tokens(t)) > 30}
    assert {d: t for d, (t, _) in back.items()} == long and max(n for _, n in back.values()) <= 30


def test_many_pieces_add_up(spark):
    text = " ".join(f"w{k}" for k in range(9000))
    rows = pieces(spark, [(1, text)], limit=10, overlap=2)[1]
    assert len(rows) > 1000 and all(a["first_token"] + a["n_tokens"] - 2 == b["first_token"] for a, b in zip(rows, rows[1:]))
    assert rows[-1]["first_token"] + rows[-1]["n_tokens"] == 9000


def test_headings_are_a_parameter(spark):
    text = "a " * 12 + "\nchapter nine\n" + "b " * 4 + "\nNot A Heading\n" + "c " * 30
    assert pieces(spark, [(1, text)], limit=20, overlap=2)[1][0]["n_tokens"] == 18
    assert pieces(spark, [(1, text)], limit=20, overlap=2, heading="chapter [a-z]++")[1][0]["n_tokens"] == 12


def test_split_noise_keeps_every_token(spark):
    rng = random.Random(9)
    docs = [(k, noise(rng, 400)) for k in range(60)]
    for d, rows in pieces(spark, docs, limit=30, overlap=5).items():
        text = docs[d][1]
        assert "".join(r["piece"] for r in rows[:1])[:10] == text[:10] and rows[-1]["piece"][-5:] == text[-5:]
        b = spark.createDataFrame([(text,)], "t string").select(F.length(splitting.boundary_string(F.col("t"))), token_count("t")).first()
        assert b[0] == b[1]
        assert max(r["n_tokens"] for r in rows) <= 30


def test_split_prefers_strong_boundaries(spark):
    text = "a " * 12 + "\nClaims\n" + "b " * 5 + ". " + "c " * 30
    first = pieces(spark, [(1, text)], limit=20, overlap=2)[1][0]
    assert first["boundary"] == "H" and first["n_tokens"] == 12
    text = "a " * 12 + ". " + "b " * 4 + "\n\n" + "c " * 30
    assert pieces(spark, [(1, text)], limit=20, overlap=2)[1][0]["boundary"] == "P"
    assert pieces(spark, [(1, "a " * 50)], limit=20, overlap=2)[1][0]["boundary"] == "x"


def test_split_very_long(spark):
    text = ("The valve (12) cools the rotor. " * 40 + "\n\n") * 150
    rows = pieces(spark, [(1, text), (2, "x" * 300_000), (3, "ü" * 5000 + " y" * 1200)])
    assert sum(r["n_tokens"] - r["overlap"] for r in rows[1]) == len(public_tokens(text))
    assert 2 not in rows and len(rows[3]) == 2
    with pytest.raises(ValueError):
        splitting.split_documents(spark.createDataFrame([], "doc_id bigint, text string"), limit=10, overlap=5)
    assert splitting.split_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_nfkc_is_used():
    assert unicodedata.normalize("NFKC", "ﬁ") == "fi"


def test_recall_of_planted_passages(spark):
    rng = random.Random(12)
    vocabulary = [f"name{k}" for k in range(300)] + ["the", "of", "a"] * 60
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(60))) for k in range(60)] + [(900, "too short"), (901, None)]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(80))) for k in range(50)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["kind"]: (r["n_planted"], r["n_found"]) for r in contamination.recall(d, i).collect()}
    assert set(got) == set(contamination.KINDS) and all(n == 60 and hit >= 0.9 * n for n, hit in got.values())
    texts = {(r["kind"], r["item_id"]): r["text"].split() for r in contamination.planted(i).collect()}
    first = items[0][1].split()[:40]
    assert texts["copy", 0] == first and texts["swapped", 0][:6] == [first[k] for k in (1, 0, 2, 4, 3, 5)] and sorted(texts["swapped", 0]) == sorted(first)
    assert 4 <= sum(a != b for a, b in zip(texts["replaced_30", 0], first)) <= 24


def test_paraphrases_against_brute_force(spark):
    """Every pair of a planted text and an item that has ten words of a passage in order and most of what it says."""
    rng = random.Random(13)
    vocabulary = [f"name{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(45))) for k in range(30)]
    i = spark.createDataFrame(items, "item_id bigint, text string")
    texts = contamination.planted(i).where("kind like 'replaced%'")
    rows = contamination.leaked(contamination.leaks(texts, i)).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    every = {r["doc_id"]: r["text"].split() for r in texts.collect()}
    df = defaultdict(int)
    for w in every.values():
        for x in set(w):
            df[x] += 1
    idf = {x: np.log((1 + len(every)) / (1 + n)) + 1 for x, n in df.items()}
    want = set()
    for d, w in every.items():
        for k, t in items:
            t = t.split()
            for a in range(len(w) - 12):
                for b in range(len(t) - 12):
                    if len(set(w[a : a + 13]) & set(t[b : b + 13])) < 8:
                        continue
                    weights = [idf.get(x, np.log(1 + len(every)) + 1) for x in t[b : b + 13]]
                    share = sum(v for x, v in zip(t[b : b + 13], weights) if x in w[a : a + 13]) / sum(weights)
                    if contamination.lcs(w[a : a + 13], t[b : b + 13]) >= 10 and share >= 0.701:
                        want.add((d, k))
    assert len(want) > 50 and len(want & got) >= 0.95 * len(want)
