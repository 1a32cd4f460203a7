import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import brown_lm, bt_quality, budget_mix, certified_packing, dart_minhash, diagonal_license, info_pii, mpegts_media, slot_sharding, trie_dedup
from marlstone.llm.tokens import WordEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def read(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


# 1 language model


def reference_base(texts):
    tokens = [(i, [w.translate(LOWER) for w in WORD.findall(t)] + [""]) for i, t in texts]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in tokens}
    count = Counter(w for i, ws in tokens if not held[i] for w in ws)
    total, distinct = sum(count.values()), len(count)
    for i, ws in tokens:
        yield i, held[i], len(ws), sum(count[w] > 0 for w in ws), total, round(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws), 3)


def test_language_model(spark, make_docs, odd_rows):
    for docs in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), make_docs(odd_rows), make_docs([])):
        got = rows_of(brown_lm.score(docs, rounds=2))
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == Counter(reference_base(read(docs)))
        held = [r for r in got if r["held_out"]]
        if len(got) > 100:
            assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_is_a_distribution(spark, make_docs):
    rng = np.random.default_rng(3)
    docs = make_docs([(i, " ".join(rng.choice([f"{c}{d}" for c in "abcde" for d in "uvwxyz"], 30)), "a") for i in range(60)])
    taught = brown_lm.training(docs)
    for share in (brown_lm.ITEM_SHARE, 0.03, 2.0):  # all words are items, some, none
        model, rare = brown_lm.learn(taught, brown_lm.word_counts(taught), taught.count(), k=6, rounds=3, item_share=share)
        assert model.history == sorted(model.history)
        known = model.known
        assert rare.count() + known.n_items == len(known.words) == 30
        count = np.concatenate([[known.ends], known.counts, np.zeros(len(model.unknown))]) + brown_lm.D
        classes = np.concatenate([[brown_lm.END], model.head_classes, model.unknown])
        some = np.unique(classes)
        assert np.allclose((10 ** model.step[some][:, classes] * count).sum(1), 1)


def walked(model, words):
    """A text's log10 probability, token by token, with every word's class and count at hand."""
    known = model.known
    place = {w: i for i, w in enumerate(known.words.to_pylist())}
    total, before = 0.0, brown_lm.END
    for w in [*words, None]:
        if w is None:
            own, n = brown_lm.END, known.ends
        elif w in place:
            own, n = model.head_classes[place[w]], known.counts[place[w]]
        else:
            own, n = model.unknown[zlib.crc32(w[-2:].encode()) % len(model.unknown)], 0
        total += model.step[before, own] + math.log10(n + brown_lm.D)
        before = own
    return total


def test_scores_are_the_models_probabilities(spark, make_docs, odd_rows, monkeypatch):
    """With all words broadcast, with some in the joined tail, and with no items at all; against a walk over each text."""
    texts = [(i, t, "a") for i, t in read(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))[:150]]
    docs = make_docs(texts + odd_rows)
    taught = brown_lm.training(docs)
    counts = brown_lm.word_counts(taught)
    for share in (brown_lm.ITEM_SHARE, 0.002, 2.0):
        monkeypatch.setattr(brown_lm, "HEAD_SHARE", 2.0**-21)
        model, _ = brown_lm.learn(taught, counts, taught.count(), item_share=share)
        assert len(model.head_classes) == counts.count()
        want = [(i, walked(model, [w.translate(LOWER) for w in WORD.findall(t)])) for i, t in read(docs)]
        for head in (2.0**-21, 0.0005):
            monkeypatch.setattr(brown_lm, "HEAD_SHARE", head)
            got = [(r["doc_id"], r["score"]) for r in rows_of(brown_lm.score(docs, item_share=share))]
            by_id = lambda rows: [x for _, x in sorted((str(i), float(x)) for i, x in rows)]
            assert np.allclose(by_id(got), by_id(want))


def test_exchange_finds_classes():
    # words of two kinds that alternate: the sweep must separate them
    size, k = 9, 3
    bigram = np.zeros((size, size))
    for a in range(1, 5):
        for b in range(5, 9):
            bigram[a, b] = bigram[b, a] = 10
    bigram[0, 1:5] = bigram[5:9, 0] = 1
    classes = np.array([0, 1, 2, 1, 2, 1, 2, 1, 2])
    for _ in range(4):
        left, right = np.zeros((size, k)), np.zeros((size, k))
        for c in range(k):
            left[:, c], right[:, c] = bigram[classes == c].sum(0), bigram[:, classes == c].sum(1)
        classes = brown_lm.exchange(left, right, classes, k)
    assert len(set(classes[1:5])) == len(set(classes[5:9])) == 1 and classes[1] != classes[5]


# 2 quality


def test_quality_separates_labels_and_scores_every_row(spark, make_docs, odd_rows):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r for r in rows_of(bt_quality.score(docs, labels))}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert np.mean([got[d]["predicted"] == truth[d] for d in held]) > 0.97
    assert all(got[d]["held_out"] for d in held) and len(got) == docs.count()
    odd = rows_of(bt_quality.score(make_docs(odd_rows), labels))
    assert len(odd) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in odd)
    none = rows_of(bt_quality.score(make_docs(odd_rows), labels.limit(0)))
    assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in none)
    assert bt_quality.score(make_docs(odd_rows).limit(0), labels).count() == 0
    kept = bt_quality.accepted(make_docs(odd_rows), labels)
    assert kept.columns == make_docs(odd_rows).columns


def plain_features(text):
    """The features of one text, counted character by character and word by word."""
    raw, words = text.encode(), re.findall(r"[^\x20\x09-\x0D]+", text)
    n, count = max(1, len(raw)), max(1, len(words))
    marks = "!?:;'\"()-"
    of = lambda test: sum(map(test, raw)) / n
    plain = lambda b: chr(b) if b < 128 else ""
    known = lambda b: b >= 128 or plain(b).isalnum() or plain(b) in " \t\v\f\r\n.," + marks
    share = lambda test: sum(bool(test(w)) for w in words) / count
    kind = unicodedata.category
    return [
        of(lambda b: plain(b).isupper()), of(lambda b: plain(b).isdigit()), of(lambda b: plain(b) in tuple(" \t\v\f\r")), of(lambda b: plain(b) in tuple(".,")),
        of(lambda b: plain(b) in tuple(marks)), of(lambda b: not known(b)), of(lambda b: b >= 128), of(lambda b: b == 10),
        sum(map(len, words)) / count, len(set(words)) / count**0.85, sum(a == b for a, b in zip(words, words[1:])) / count,
        share(lambda w: re.search(r"[#$%&*|~^=<>@{}_\[\]+]|!!", w)), share(lambda w: all(kind(c) != "Ll" for c in w) and any(kind(c) == "Lu" for c in w)), share(lambda w: w[-1] in ".!?"),
        math.log1p(len(words)), float(len(words) < 3),
    ]


def test_quality_against_plain_counting(spark, make_docs, odd_rows):
    """Features counted plainly; the weights are where the ranking loss has no slope, the cut is the quantile, scores are those of the formula."""
    odd = [(i if i is None else 10**6 + i, t, s) for i, t, s in odd_rows]
    rows = [(i, t, "a") for i, t in read(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))] + odd
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    marks = [(i, q) for i, q in truth.items()] + [(None, 1), (8, None), (10**8, 1)] + [(i, 0) for i in list(truth)[:5]]
    labels, docs = spark.createDataFrame(marks, "doc_id long, quality int"), make_docs(rows + rows[:3] * 4)
    x = np.array([plain_features(t or "") for _, t, _ in rows])
    assert np.allclose(bt_quality.text_features(pa.array([t or "" for _, t, _ in rows])), x)
    ranking = bt_quality.train(docs, labels)
    taught = [at for i, at in sorted((i, at) for at, (i, _, _) in enumerate(rows) if i in truth) if zlib.crc32(str(i).encode()) % 3 != 1]
    y = np.array([truth[rows[at][0]] for at in taught])
    mean, scale = x[taught].mean(0), x[taught].std(0)
    z = np.clip((x - mean) / np.where(scale > 1e-9, scale, 1), -8, 8)
    rng = np.random.default_rng(bt_quality.SEED)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    difference = z[taught][rng.choice(good, bt_quality.PAIRS)] - z[taught][rng.choice(bad, bt_quality.PAIRS)]
    slope = -(difference / (1 + np.exp(difference @ ranking.weights))[:, None]).mean(0) + bt_quality.RIDGE * ranking.weights
    assert np.abs(slope).max() < 1e-6
    ranks = np.sort(z[taught] @ ranking.weights)
    assert abs(ranking.cut - (ranks[len(bad) - 1] + ranks[len(bad)]) / 2) < 1e-6
    want = sorted((str(i), float(1 / (1 + np.exp(-(z[at] @ ranking.weights - ranking.cut))))) for at, (i, _, _) in enumerate(rows + rows[:3] * 4) for at in [at % len(rows) if at < len(rows) else (at - len(rows)) % 3])
    got = sorted((str(r["doc_id"]), r["score"]) for r in rows_of(bt_quality.score(docs, labels)))
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([v for _, v in got], [v for _, v in want])


# 3 sharding


def test_sharding_balances_bytes(make_docs, odd_rows, small):
    for docs in (small, make_docs(odd_rows), make_docs(odd_rows).limit(0)):
        got = rows_of(slot_sharding.shard_by_slots(docs))
        want = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in read(docs))
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        places = defaultdict(list)
        for r in got:
            places[r["shard"]].append(r["slot"])
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
    load = Counter()
    for r in rows_of(slot_sharding.shard_by_slots(small, n_shards=4)):
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 4


def test_sharding_of_one_hot_identifier(spark):
    docs = spark.range(10_000).selectExpr("case when id % 2 = 0 then 7 else id end doc_id", "concat('text of a hundred bytes ', repeat('x', 76)) text")
    again = docs.unionByName(docs.limit(0)).unionByName(spark.range(5_000).selectExpr("cast(null as long) doc_id", "cast(id as string) text"))
    for rows in (docs, again):
        got = rows_of(slot_sharding.shard_by_slots(rows))
        load, places = Counter(), defaultdict(list)
        for r in got:
            load[r["shard"]] += r["size"]
            places[r["shard"]].append(r["slot"])
        assert len(got) == rows.count() and len(load) == 16
        assert max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 16
        assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_slots_are_ranked_in_parts(small, monkeypatch):
    monkeypatch.setattr(slot_sharding, "PART_ROWS", 3)
    places = defaultdict(list)
    for r in rows_of(slot_sharding.shard_by_slots(small, slots=16)):
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_rebalancing_edits_the_map():
    size = np.random.default_rng(1).integers(1, 1000, 512).astype(float)
    first = slot_sharding.SlotMap.even(512, 8)
    second = first.rebalanced(size)
    grown = second.rebalanced(size, n_shards=9)
    assert (second.version, grown.version) == (2, 3)
    assert (second.shard != first.shard).mean() < 0.2
    for m, n in ((second, 8), (grown, 9)):
        load = np.bincount(m.shard, weights=size, minlength=n)
        assert load.max() - load.min() < 0.01 * load.mean()


# 4 mixing


def reference_targets(sizes, weights=(3, 1, 2)):
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, low, high = 1.5 * sum(sizes.values()), 0.0, 1e12
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(2 * sizes[s], middle * w[s]) for s in order) < budget else (low, middle)
    return {s: min(2 * sizes[s], low * w[s]) for s in order}


def test_mix_meets_targets(make_docs, odd_rows, small):
    for docs in (small, make_docs(odd_rows)):
        got = rows_of(budget_mix.mix(docs))
        sizes, taken = Counter(), Counter()
        for r in got:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            assert r["taken"] in (0, r["size"], 2 * r["size"])
        want = reference_targets(sizes)
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-3
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(WORD.findall(t))) for i, t in read(docs))
        if docs is small:
            assert max(abs(taken[s] - want[s]) for s in sizes) < 16
        assert sorted(map(str, got)) == sorted(map(str, rows_of(budget_mix.mix(docs.repartition(3)))))
    mixed = budget_mix.mixed_documents(small)
    assert mixed.columns == small.columns
    again = Counter(r.doc_id for r in mixed.collect())
    assert again == Counter({r["doc_id"]: r["taken"] // r["size"] for r in rows_of(budget_mix.mix(small)) if r["taken"]})
    assert budget_mix.mix(small.limit(0)).count() == 0


def test_mix_of_repeated_and_null_identifiers(spark, monkeypatch):
    one = spark.range(100).selectExpr("5 doc_id", "repeat('w ', 10) text", "'a' source")
    null = spark.range(90).selectExpr("cast(null as int) doc_id", "concat('v', id % 30, ' y z') text", "cast(null as string) source")
    other = spark.range(400).selectExpr("cast(id as int) doc_id", "repeat('q ', cast(id % 7 as int)) text", "concat('s', id % 2) source")
    docs = one.unionByName(null).unionByName(other)
    for rows in (50_000, 5):
        monkeypatch.setattr(budget_mix, "BUCKET_ROWS", rows)
        got = rows_of(budget_mix.mix(docs))
        sizes, taken = Counter(), Counter()
        for r in got:
            assert r["taken"] in (0, r["size"], 2 * r["size"])
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
        want = reference_targets(sizes)
        longest = {"a": 10, "s0": 6, "s1": 6, None: 3}
        assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
        assert sorted(map(str, got)) == sorted(map(str, rows_of(budget_mix.mix(docs.repartition(5)))))
    clash = docs.selectExpr("*", "1 _size", "2 _hash", "3 _row", "4 _copy", "5 _times")
    mixed = budget_mix.mixed_documents(clash)
    assert mixed.columns == clash.columns
    rows = mixed.collect()
    assert {(r["_size"], r["_hash"], r["_row"], r["_copy"], r["_times"]) for r in rows} == {(1, 2, 3, 4, 5)}
    assert Counter(str(r["doc_id"]) for r in rows if r["source"] == "a") == Counter({"5": taken["a"] // 10})


def test_few_long_documents_meet_their_budget():
    lengths, counts = np.array([100_000, 100_001]), np.array([1, 1])
    assert budget_mix.fit(lengths, counts, 190_000).tolist() == [1, 1]
    assert budget_mix.fit(lengths, counts, 100_001).tolist() == [0, 1]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), min_size=1, max_size=8), st.integers(0, 300))
def test_knapsack_is_optimal(counts, budget):
    lengths, available = np.array(list(counts)), np.array(list(counts.values()))
    take = budget_mix.knapsack(lengths, available, budget)
    assert (take <= available).all()
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    assert abs(int((lengths * take).sum()) - budget) == min(abs(s - budget) for s in sums if s <= budget + budget_mix.OVER_WORDS)


# 5 packing


def test_encoder_equals_whole_texts(small):
    texts = [t for _, t in read(small)][:150] + ["don't <|endoftext|> X", "", "á b<|ENDOFTEXT|>", "It's'super 12.5,, (x)  y !?, hi.'s", "ÉCOLE İstanbul KK ẞ　a\x1cb", "á ́b x.́y"]
    ids, counts = WordEncoder(TOKENIZER).encode(pa.array(texts))
    whole = WordEncoder(TOKENIZER)._whole(texts)
    assert [a.tolist() for a in np.split(ids, np.cumsum(counts)[:-1])] == whole


def check_packing(docs, got, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, t in read(docs):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        for p, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[i, p, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(make_docs, odd_rows, small):
    for docs, parts in ((small, 20_000), (small, 40), (make_docs(odd_rows), 20_000), (small.limit(0), 10)):
        got = rows_of(certified_packing.pack(docs, TOKENIZER, part_pieces=parts))
        n = check_packing(docs, got, 2048)
        total = sum(r["length"] for r in got)
        assert n <= total / 2048 * 1.03 + 3
        assert all(r["gap"] >= 0 for r in got)


def test_packing_closes_gaps(spark, make_docs):
    """Pieces of 600 to 799 tokens, three of which fit at most; best-fit decreasing alone needs 16 % above the first bound."""
    lengths = np.random.default_rng(4).integers(600, 800, 6_000)
    pieces = spark.createDataFrame([(i, 0, 0, int(n), 1) for i, n in enumerate(lengths)], certified_packing.PIECES)
    bound = certified_packing.certified_bound(lengths)
    alone = certified_packing.best_fit_decreasing(lengths)[2]
    for parts in (20_000, 2_000):
        got = rows_of(certified_packing.packed(pieces, part_pieces=parts))
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(got) == 6_000 and all(sum(n for _, n in b) <= 2048 and sorted(b)[-1][0] + sorted(b)[-1][1] == sum(n for _, n in b) for b in bins.values())
        assert certified_packing.lower_bound(lengths) < bound <= len(bins) < bound + (alone - bound) / 3
    hot = make_docs([(7, "same words again", "a")] * 500)
    got = rows_of(certified_packing.pack(hot, TOKENIZER, part_pieces=10))
    check_packing(hot, got, 2048)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_bounds_and_bins(lengths):
    x = np.array(lengths, dtype=np.int64)
    bins, _, n = certified_packing.best_fit_decreasing(x, 64)
    assert n == len(set(bins.tolist())) and certified_packing.lower_bound(x, 64) <= n and certified_packing.certified_bound(x, 64) <= n
    for other in (certified_packing.completed(x, 64), certified_packing.repacked(x, 0, 64)):
        assert len(x) == 0 or (np.bincount(other, weights=x).max() <= 64 and len(set(other.tolist())) == other.max() + 1)
        assert certified_packing.certified_bound(x, 64) <= len(set(other.tolist()))
        offsets = certified_packing.offsets_in(other, x)
        for b in set(other.tolist()):
            order = np.argsort(offsets[other == b])
            assert (offsets[other == b][order] == np.cumsum(x[other == b][order]) - x[other == b][order]).all()
    assert n == 0 or np.bincount(bins, weights=x).max() <= 64


# 6 exact duplicates


def test_exact_classes(make_docs, odd_rows, small):
    for docs in (small, make_docs(odd_rows)):
        groups = defaultdict(list)
        for i, t in read(docs):
            groups[t.translate(LOWER)].append(i)
        want = Counter()
        for t, ids in groups.items():
            keep = max((i for i in ids if i is not None), default=None)
            for i in ids:
                want[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
        for budget in (1 << 26, 1):
            owners = trie_dedup.owners(docs, trie_bytes=budget).collect()
            assert len(owners) == len(groups)
        got = rows_of(trie_dedup.classes(docs))
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
        kept = trie_dedup.deduplicated(docs)
        assert kept.columns == docs.columns and kept.count() == len(groups)
    assert trie_dedup.classes(small.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 9)), max_size=40), st.integers(0, 30))
def test_trie_spills_without_loss(pairs, limit):
    trie, elsewhere = trie_dedup.Patricia(True), []
    for key, owner in pairs:
        if not trie.insert(key, owner, 1):
            elsewhere.append((key, owner, 1))
        elif trie.bytes > limit:
            elsewhere += trie.spill(limit)
    done = list(trie.drain())
    want = {}
    for key, owner in pairs:
        a, b = want.get(key, (owner, 0))
        want[key] = (max(a, owner), b + 1)
    # A text is settled here or was handed on, never both; here with all its rows.
    assert trie.bytes == 0 and (done or not pairs)
    assert len({k for k, *_ in done}) == len(done) and not {k for k, *_ in done} & {k for k, *_ in elsewhere}
    assert all(want[k] == (o, n) for k, o, n in done)
    rest = Counter()
    for k, _, n in elsewhere:
        rest[k] += n
    assert rest == {k: n for k, (_, n) in want.items() if k not in {d[0] for d in done}}


def test_tries_hold_many_texts(spark, make_docs):
    """Texts that share long prefixes, in one partition, with a budget that makes their subtrees spill."""
    rows = [(i, f"{'shared prefix ' * 20}{i % 40} {'tail ' * (i % 40)}", "a") for i in range(400)] + [(1_000 + i, "Z" * i, "b") for i in range(30)]
    docs = make_docs(rows).coalesce(1)
    trie, texts = trie_dedup.Patricia(True), {t for _, t, _ in rows}
    for _, text, _ in rows:
        trie.insert(text.encode(), 1, 1)
    assert trie.bytes < sum(map(len, texts)) / 2 and len(list(trie.drain())) == len(texts)
    want = Counter(t.translate(LOWER) for _, t, _ in rows)
    for budget in (1 << 26, 3_000, 200, 1):
        got = trie_dedup.owners(docs, trie_bytes=budget).collect()
        assert {r["sha"]: r["rows"] for r in got} == {hashlib.sha256(t.encode()).hexdigest(): n for t, n in want.items()} and len(got) == len(want)


# 7 licenses


def reference_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    places, labels = [], set()
    for phrase, label in diagonal_license.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base_places(spark, make_docs, odd_rows):
    more = [(10**9, "All RIGHTS reserved all rights reserved; CC-BY, cc by", "a"), (10**9 + 1, "x GNU General  Public\nLicense; general public licensé", "a"), (10**9 + 2, "Released under the very MIT License. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "a")]
    for docs in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), make_docs(odd_rows + more), make_docs([])):
        got = rows_of(diagonal_license.scan(docs))
        want = Counter((i, *reference_license(t)) for i, t in read(docs))
        assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
        by_id = {r["doc_id"]: r for r in got}
        if 10**9 + 2 in by_id:
            assert by_id[10**9 + 2]["labels"] == "gpl,gpl-notice,mit" and by_id[10**9]["labels"] == "cc-by,reserved"
        for i, t in read(docs):
            if "Released under the MIT License." in t:
                assert "mit" in by_id[i]["labels"].split(",")
            if "Apache License, Version 2.0" in t:
                assert "apache-2.0" in by_id[i]["labels"].split(",")


def test_license_spans_survive_edits(spark, make_docs):
    """A changed, dropped or inserted word in every template, and three inserted ones in long templates."""
    rows, want = [], {}
    for i, (template, label) in enumerate(diagonal_license.TEMPLATES.items()):
        words = template.split()
        middle = len(words) // 2
        edits = [words, ["Zzz", *words[1:]], words[1:], [*words[:middle], "zzz", *words[middle:]]]
        if len(words) > diagonal_license.SHORT:
            edits.append([*words[:middle], "zzz", "yyy", "xxx", *words[middle:]])
        for j, edited in enumerate(edits):
            rows.append((10 * i + j, "filler of the license " * 40 + " ".join(edited) + " the of" * 30, "a"))
            want[10 * i + j] = label
    # Repeats of a few words of a template, and half of it, are no span.
    rows += [(9_000, "released under " * 50, "a"), (9_001, "mit license " * 50, "a"), (9_002, "permission is hereby granted free of charge to any person", "a")]
    got = {r["doc_id"]: r for r in rows_of(diagonal_license.scan(make_docs(rows)))}
    assert all(label in got[i]["labels"].split(",") and 0 < got[i]["score"] <= 1 for i, label in want.items())
    assert all(got[i]["labels"] == "" and got[i]["score"] == 0 for i in (9_000, 9_001, 9_002))


def test_license_spans_against_all_windows(make_docs):
    rng = np.random.default_rng(9)
    template, words = "p q r s t u v w x y z a b c", list("pqrstuvwxyzabc") + ["other"]
    rows = []
    for i in range(60):
        text = rng.choice(words, 40).tolist()
        text[10:10] = [w for w in template.split() if rng.random() > i / 100]
        rows.append((i, " ".join(text), "a"))
    got = {r["doc_id"]: r["labels"] for r in rows_of(diagonal_license.scan(make_docs(rows), templates={template: "own"}))}
    slack, own = diagonal_license.SLACK, template.split()
    for i, text, _ in rows:
        has, most = text.split(), False
        hits = [(p, a) for p in range(len(has) - 2) for a in range(len(own) - 2) if has[p : p + 3] == own[a : a + 3]]
        for d in {p - a for p, a in hits}:
            near = [(p, a) for p, a in hits if 0 <= p - a - d <= slack]
            covered = {a + j for _, a in near for j in range(3)}
            most |= len(covered) / len(own) >= diagonal_license.COVER - 1e-9 and max(p for p, _ in near) + 2 - min(p for p, _ in near) < len(own) + 2 * slack
        assert got[i] == ("own" if most else "")


# 9 personal data


def reference_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        if 12 <= len(digits) <= 19 and info_pii.luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return info_pii.written(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a.@-+1 4(0)9%é", max_size=60))
def test_patterns_match_the_contract(text):
    assert info_pii.written([s for f in info_pii._FINDERS.values() for s in f(text)]) == reference_spans(text)


def reference_terms(rows):
    """Term spans of every row by counting all pairs of entities and terms."""
    split = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    bases = [[(k, int(a), int(b)) for k, a, b in (s.split(":") for s in reference_spans(t).split(",") if s)] for _, t in rows]
    n_t, texts_t, n_e, texts_e, n_te, texts_te, places = Counter(), defaultdict(set), Counter(), defaultdict(set), Counter(), defaultdict(set), []
    for (_, text), base in zip(rows, bases, strict=True):
        n_t.update({w.translate(LOWER) for w in split.findall(text)})
        own = defaultdict(set)
        for m in split.finditer(text) if base else ():
            if all(b <= m.start() or m.end() <= a for _, a, b in base):
                own[m[0].translate(LOWER)].add(m.span())
        entities = {e for k, a, b in base for e in info_pii.protected(k, text[a:b])}
        for e in entities:
            n_e[e] += 1
            texts_e[e].add(text)
            for t in own:
                n_te[e, t] += 1
                texts_te[e, t].add(text)
        places.append((entities, own))
    out = []
    for entities, own in places:
        spans = set()
        for e in entities:
            for t, where in own.items():
                prior = n_e[e] / len(rows)
                given = (n_te[e, t] + info_pii.SMOOTHING * prior) / (n_t[t] + info_pii.SMOOTHING)
                if len(texts_te[e, t]) > 1 and -math.log2(given) <= info_pii.SHORTFALL + 1e-12 and math.log2(given / prior) >= info_pii.GAIN - 1e-12:
                    spans |= {f"term:{a}:{b}" for a, b in where}
        out.append(frozenset(spans))
    return out


def test_personal_data(spark, make_docs, odd_rows):
    more = [(10**9 + i, f"filler{"abcd"[i]}xx text about quovadimus the person a.b@c.example.org lives {i}", "a") for i in range(4)] + [(10**9 + 300, "plain quovadis the person", "a")]
    more += [(10**9 + 400 + i, f"Ana 王明 rings from ward {i} at +1 (212) 555-01{i}0", "b") for i in range(10, 13)]
    for docs in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), make_docs(odd_rows + more), make_docs([])):
        got = rows_of(info_pii.find(docs))
        rows = read(docs)
        want = Counter((i, hashlib.sha256(reference_spans(t).encode()).hexdigest(), terms) for (i, t), terms in zip(rows, reference_terms(rows), strict=True))
        assert Counter((r["doc_id"], r["base_sha256"], frozenset(s for s in r["spans"].split(",") if s.startswith("term"))) for r in got) == want
        texts = dict(rows)
        if len(got) > 10:
            assert any(r["n_term"] for r in got)
        for r in got:
            spans = r["spans"].split(",") if r["spans"] else []
            assert set(filter(None, r["base"].split(","))) <= set(spans) and (r["sanitised"] is None) == (not spans)
            if spans and r["doc_id"] is not None:
                assert r["sanitised"] == info_pii.redact(texts[r["doc_id"]], r["spans"])
            terms = {texts[r["doc_id"]][int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans if s.startswith("term")} if spans else set()
            if 10**9 <= (r["doc_id"] or 0) < 10**9 + 4:
                assert "quovadimus" in terms and "lives" in terms and not any("filler" in t for t in terms) and "quovadimus" not in r["sanitised"]
            if (r["doc_id"] or 0) >= 10**9 + 400:
                assert {"王明", "Ana"} <= terms
            if r["doc_id"] == 10**9 + 300:
                assert not spans
    docs = make_docs(odd_rows + more).selectExpr("*", "1 _id", "2 _key", "3 _spans", "4 sanitised")
    clean = info_pii.sanitised(docs)
    assert clean.columns == docs.columns and clean.count() == len(odd_rows + more)
    first = clean.where("doc_id = 1000000000").collect()[0]
    assert "[email]" in first.text and (first["_id"], first["_key"], first["_spans"], first["sanitised"]) == (1, 2, 3, 4)


# 10 media


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.integers(1, 40))
def test_transport_stream_round_trip(data, times):
    payload, _ = mpegts_media.padded(data * times)
    read_back = mpegts_media.parse(mpegts_media.mux(payload))
    stream = read_back.streams[mpegts_media.DATA_PID]
    assert stream.payload == payload and read_back.continuity_errors == read_back.bad_tables == read_back.lost_sync == stream.truncated == 0
    assert len(stream.pts) == stream.pes_packets == -(-len(payload) // mpegts_media.UNIT) and stream.random_access[0] == 0


def test_damage_is_counted():
    media = mpegts_media.mux(b"x" * 20_000)
    lost = mpegts_media.parse(media[: 188 * 10] + media[188 * 11 :])
    assert lost.continuity_errors == 1
    assert mpegts_media.parse(b"\0" + media[1:]).lost_sync == 1
    broken = bytearray(media)
    broken[12] ^= 1
    assert mpegts_media.parse(bytes(broken)).bad_tables == 1


def _packets(pid, section, pointer=0):
    """``section`` in as many packets as it takes, after ``pointer`` bytes of stuffing."""
    data, out = bytes([pointer]) + b"\xff" * pointer + section, []
    for i, at in enumerate(range(0, len(data), 184)):
        out.append(bytes([0x47, (0 if i else 0x40) | pid >> 8, pid & 0xFF, 0x10 | i & 15]) + data[at : at + 184].ljust(184, b"\xff"))
    return out


def test_tables_of_several_packets():
    """A program map with long descriptors and 300 programs in the association table; sections may end anywhere."""
    m = mpegts_media
    payload = b"y" * 50_000
    media = m.mux(payload)
    data = [media[i : i + 188] for i in range(0, len(media), 188) if media[i + 1] & 0x1F == m.DATA_PID >> 8 and media[i + 2] == m.DATA_PID & 0xFF]
    association = m._section(0, 1, b"".join(bytes([p >> 8, p & 0xFF, 0xE0 | m.PMT_PID >> 8, m.PMT_PID & 0xFF]) for p in range(1, 240)))
    descriptors = b"\x05\xf0" + b"d" * 240
    body = bytes([0xE0 | m.DATA_PID >> 8, m.DATA_PID & 0xFF, 0xF0 | len(descriptors) >> 8, len(descriptors) & 0xFF]) + descriptors
    for i in range(60):
        pid = m.DATA_PID + i
        body += bytes([6, 0xE0 | pid >> 8, pid & 0xFF, 0xF0, 3]) + b"abc"
    mapping = m._section(2, m.PROGRAM, body)
    assert len(association) > 900 and len(mapping) > 700
    for pointer in (0, 5, 150):
        read_back = m.parse(b"".join(_packets(0, association, pointer) + _packets(m.PMT_PID, mapping, pointer) + data))
        assert len(read_back.programs) == 239 and len(read_back.streams) == 60 and read_back.bad_tables == 0
        assert read_back.streams[m.DATA_PID].payload == payload and len(read_back.streams[m.DATA_PID].pts) == 4
    lost = _packets(0, association)
    assert m.parse(b"".join(lost[:2] + lost[3:])).bad_tables == 1


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40_000), st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 255)), max_size=12), st.integers(0, 400))
def test_reading_never_raises(size, changes, cut):
    media = bytearray(mpegts_media.mux(b"z" * size))
    for at, value in changes:
        # near packet heads and tables, where bytes steer the reader
        media[(at // 7 * 188 + at % 7 if at % 2 else at) % len(media)] = value
    read_back = mpegts_media.parse(bytes(media[: max(0, len(media) - cut)]))
    assert read_back.packets == max(0, len(media) - cut) // 188
    mpegts_media.feature(read_back)


def test_full_adaptation_field_of_a_table():
    media = bytearray(mpegts_media.mux(b"x" * 64))
    media[3], media[4] = 0x30, 183
    assert mpegts_media.parse(bytes(media)).bad_packets == 1


def test_media_rows(make_docs, odd_rows, small):
    for docs in (small, make_docs(odd_rows), small.limit(0)):
        got = rows_of(mpegts_media.transport_streams(docs, keep_media=True))
        want = Counter()
        for i, t in read(docs):
            raw = t.encode()
            payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
            want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
        assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
        assert all(hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"] and len(r["media"]) == r["media_bytes"] for r in got)
        m = mpegts_media
        assert all(r["time_stamps"] == [m.FIRST_PTS + i * m.PTS_STEP for i in range(-(-r["payload_bytes"] // m.UNIT))] for r in got)
        assert all(r["random_access"] == [i % m.RANDOM_ACCESS_EVERY == 0 for i in range(len(r["time_stamps"]))] for r in got)


# 8 near duplicates


def shingle_set(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    return tuple(words), frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def reference_classes(rows):
    """Classes by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            (wi, a), (wj, b) = sets[i], sets[j]
            if wi == wj or (a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[find(i)].append(doc)
    return Counter((doc, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for doc in g)


def test_near_classes(spark, make_docs, odd_rows):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(500)]
    made = []
    for group in range(12):
        base = rng.choice(vocabulary, 150)
        for copy in range(9):
            text = base.copy()
            for spot in rng.integers(0, 150, copy % 4):
                text[spot] = f"x{rng.integers(1000)}"
            made.append((10_000 + 100 * group + copy, " ".join(text), "a"))
    for docs in (make_docs(odd_rows + made), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        got = rows_of(dart_minhash.classes(docs))
        assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == reference_classes(read(docs))
        kept = dart_minhash.representatives(docs)
        assert kept.columns == docs.columns and kept.count() == len({(r["class_id"], r["class_size"]) if r["class_id"] is not None else r["text_hash"] for r in got})
    assert dart_minhash.classes(make_docs([])).count() == 0


def _edited(rng, base, edits, tag):
    """``base`` with some words, five or more apart, replaced by words of its own."""
    out = list(base)
    for place in rng.choice(len(base) // 5, edits, replace=False):
        out[5 * place + 2] = f"{tag}x{place}"
    return out


def _brute_classes(texts, threshold=0.8):
    """Component of each text when all pairs are compared on their whole sets."""
    sets = [{" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    times = Counter(s for x in sets for s in x)
    columns = {s: i for i, s in enumerate(s for s, n in times.items() if n > 1)}  # others are never shared
    has = np.zeros((len(texts), len(columns)), np.float32)
    for i, x in enumerate(sets):
        has[i, [columns[s] for s in x if s in columns]] = 1
    sizes, shared = np.array([len(x) for x in sets]), has @ has.T
    near = shared >= threshold * (sizes[:, None] + sizes[None] - shared)
    label = np.arange(len(texts))
    while True:
        lower = np.where(near, label[None], len(texts)).min(1)
        if (lower == label).all():
            return label
        label = lower


def test_near_classes_of_a_star(spark, make_docs):
    """Thousands of copies like their base only, and a group unlike one another that hides a few pairs."""
    rng = np.random.default_rng(8)
    base, other = [f"a{i}" for i in range(300)], [f"b{i}" for i in range(300)]
    texts = [base, *(_edited(rng, base, 4, f"c{i}") for i in range(2_000))]
    apart = [_edited(rng, other, 5, f"d{i}") for i in range(300)]
    texts += apart + [_edited(rng, t, 1, f"e{i}") for i, t in enumerate(apart[:150:10])]
    want = _brute_classes(texts)
    rows = dart_minhash.classes(make_docs([(i, " ".join(t), "s") for i, t in enumerate(texts)])).select("doc_id", "class_id").collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert len(set(want[:2_001].tolist())) == 1 and len(set(want[2_001:].tolist())) > 200
    assert [got[i] for i in range(len(texts))] == want.tolist()


def test_near_classes_of_one_template(spark, make_docs, monkeypatch):
    """Pairs of variants of one long template, which share bands with all the others."""
    rng = np.random.default_rng(11)
    template = [f"t{i}" for i in range(600)]
    texts = []
    for i in range(150):
        own = _edited(rng, template, 10 + i % 20, f"a{i}")
        texts += [own, _edited(rng, own, 1 + i % 5, f"b{i}")]
    want = _brute_classes(texts)
    assert len(set(want.tolist())) > 20
    docs = make_docs([(i, " ".join(t), "s") for i, t in enumerate(texts)])
    for rows in (1_000, 7):  # whole buckets, and many blocks
        monkeypatch.setattr(dart_minhash, "BLOCK_ROWS", rows)
        got = {r["doc_id"]: r["class_id"] for r in dart_minhash.classes(docs).select("doc_id", "class_id").collect()}
        assert [got[i] for i in range(len(texts))] == want.tolist()


def test_block_links_equal_pairs():
    rng = np.random.default_rng(6)
    for weighted in (False, True):
        sets = []
        for _ in range(40):
            x = np.sort(rng.choice(60, rng.integers(1, 40), replace=False)).astype(np.uint64)
            sets.append((x.tobytes(), rng.integers(1, 4, len(x)).astype("<u4").tobytes() if weighted else b""))
        units = [dart_minhash._units(a, n) for a, n in sets]
        want = [[dart_minhash.similarity(a, b, m, n) >= 0.3 for b, n in sets[15:]] for a, m in sets[:15]]
        assert (dart_minhash.block_links(units[:15], units[15:], 0.3) == np.array(want)).all()


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    elements = rng.integers(0, 2**48, 400).astype(np.uint64)
    weights = rng.uniform(0.2, 3.0, (2, 400))
    weights[1] = np.where(rng.random(400) < 0.7, weights[0], weights[1])
    at, both = np.repeat([0, 1], 400), np.concatenate([elements, elements])
    signature, some = dart_minhash.dart_signatures(at, both, weights.reshape(-1), 2, 4000)
    want = np.minimum(*weights).sum() / np.maximum(*weights).sum()
    assert some.all() and abs((signature[0] == signature[1]).mean() - want) < 0.03


# pipeline


def test_pipeline_of_odd_tables(spark, make_docs, odd_rows, tmp_path):
    """Empty tables; null, empty, repeated and long texts, null identifiers and columns named like the operators' own."""
    import corpus_pipeline

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    docs = make_docs(odd_rows + [(20 + i, f"A fine sentence number {i}, which says a little about something.", "a") for i in range(12)])
    docs = docs.selectExpr("*", *(f"'{n}' {n}" for n in ("_size", "_source", "_hash", "_times", "_copy", "_keep_id", "_keep_hash", "_keep_n", "_id", "_key", "_spans", "text_hash")))
    for name, rows in (("odd", docs), ("none", docs.limit(0))):
        sf = str(tmp_path / name)
        rows.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        at = spark.read.parquet(f"{sf}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            out = function(spark, at, sf)
            assert out.columns == docs.columns, stage
            if name == "odd" and out.count():
                assert out.select("_size", "_hash", "_keep_id", "text_hash").distinct().collect() == [("_size", "_hash", "_keep_id", "text_hash")]
            at = out
        packed = rows_of(corpus_pipeline.run(spark, sf))
        assert bool(packed) == (name == "odd")
        check_packing(at, packed, 2048)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        kept[name] = (docs, out)
        docs = out
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stays = {r.doc_id for r in kept["quality"][1].collect()}
    good = [d for d, q in quality.items() if q == 1]
    assert sum(d in stays for d in good) >= 0.97 * len(good)
    texts = [t.translate(LOWER) for _, t in read(kept["exact_dedup"][1])]
    assert len(texts) == len(set(texts)) == len({t.translate(LOWER) for _, t in read(kept["exact_dedup"][0])})
    near = read(kept["near_dedup"][1])
    assert len(reference_classes(near)) == len(near) and {n for *_, n in reference_classes(near)} == {1}
    packed = rows_of(kept["packing"][1])
    check_packing(kept["packing"][0], packed, 2048)
    assert corpus_pipeline.run(spark, sf).count() == len(packed)
