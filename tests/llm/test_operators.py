"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnwork.llm import cover_tree, forest_join, language, line_dedup, mixing, mph, positional, quality, secrets, token_shards, toxicity
from kilnwork.llm.components import components
from kilnwork.llm.cuckoo import Cuckoo
from kilnwork.llm.shared import best_cut
from kilnwork.llm.words import shingles, word_hashes, words_by_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["Élan", "ÑU", "straße", "x1"]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    out += [out[3], out[3], out[4] + " more", " ".join(out[5].split()[:-1]), None, "", "   ", "!!! ...", "one", "a\n\nb  c\t", "x" * 5000, " ".join(["word"] * 3000)]
    return list(enumerate(out))


def frame(spark, rows):
    """Documents with further columns, one of whose names the operators use."""
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, size int")


def got(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# words


def test_words_match_the_pattern():
    texts = ["Hello, WORLD 12 ÉÀ it's", "", "a" * 70 + " b", "çà-là", "\x7fzz"]
    hashes, at = words_by_text([t.encode() for t in texts])
    for k, t in enumerate(texts):
        own = hashes[at[k] : at[k + 1]]
        assert len(own) == len(words(t))
        assert [word_hashes(w.encode())[0][0] for w in words(t)] == list(own)


def test_long_buffers_are_cut_between_words(monkeypatch):
    from kilnwork.llm import words as module

    data = " ".join(f"w{k}" for k in range(500)).encode()
    whole = word_hashes(data)
    monkeypatch.setattr(module, "PIECE", 64)
    cut = word_hashes(data)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


# 4 line dedup


def line_oracle(rows, min_chars=40, min_docs=5):
    ws = " \t\n\x0b\x0c\r"
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(ws).translate(FOLD)
            if len(key) >= min_chars:
                held[key].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held[k := x.strip(ws).translate(FOLD)]) >= min_docs and len(k) >= min_chars and i != max(held[k]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def lined(n=40):
    rng = random.Random(4)
    common = ["All rights RESERVED by the owners of this long line of text", "  é" * 45, "short line"]
    return [(i, "\n".join([rng.choice(common).upper() if rng.random() < 0.3 else rng.choice(common) for _ in range(3)] + [f"own line {i} " * 5])) for i in range(n)] + [(90, None), (91, ""), (92, "\n\n"), (93, "z" * 20000)]


def test_line_dedup(spark):
    rows = lined()
    df = frame(spark, rows)
    store = line_dedup.LineStore.create(df)
    out = got(store.apply(df, store.refs))
    assert {i: (r["n_lines"], r["n_dropped"], r["text"]) for i, r in out.items()} == line_oracle(rows)


def test_line_dedup_is_reversible(spark):
    rows = lined(24)
    first, more, gone = rows[:12], rows[12:], [i for i, _ in rows[10:14]] + [23, 91]
    store = line_dedup.LineStore.create(frame(spark, first)).insert(frame(spark, more)).delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    rest = [r for r in rows if r[0] not in gone]
    out = got(store.apply(frame(spark, rest)))
    assert {i: (r["n_lines"], r["n_dropped"], r["text"]) for i, r in out.items()} == line_oracle(rest)
    plain = line_dedup.LineStore.create(frame(spark, rest))
    assert sorted(map(tuple, store.counts.select("h1", "h2", "n_docs", "last_doc").collect())) == sorted(map(tuple, plain.counts.select("h1", "h2", "n_docs", "last_doc").collect()))


def test_line_dedup_of_nothing(spark):
    df = frame(spark, [])
    store = line_dedup.LineStore.create(df)
    assert store.apply(df).count() == 0


def test_cuckoo_holds_what_it_was_given():
    keys = np.random.default_rng(1).integers(0, 2**63, 3000)
    c = Cuckoo(500)  # must grow
    c.insert(keys[:2000])
    assert c.contains(keys[:2000]).all() and c.contains(keys[2000:]).mean() < 0.02
    c.delete(keys[:1000])
    again = Cuckoo.from_bytes(c.to_bytes())
    assert again.contains(keys[1000:2000]).all() and again.contains(keys[:1000]).mean() < 0.02


def test_cuckoo_denies_no_remaining_key_after_growth_and_deletion():
    keys = np.random.default_rng(7).integers(0, 2**63, 60_000)
    c = Cuckoo(1000)
    for part in np.array_split(keys, 5):
        c.insert(part)
    c.delete(keys[::2])
    assert c.contains(keys[1::2]).all() and c.contains(keys[::2]).mean() < 0.001
    same = Cuckoo(100)  # one fingerprint more often than two buckets hold
    same.insert(np.full(30, 7))
    same.delete(np.full(29, 7))
    assert same.contains(np.array([7])).all()
    same.delete(np.array([7]))
    assert not same.contains(np.array([7])).any()


def test_line_dedup_lays_out_more_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    lines = [f"line number {k} that many of the documents hold, all in full" for k in range(12)]
    rows = [(i, "\n".join(lines if i > 4 else lines[:2])) for i in range(12)]
    store = line_dedup.LineStore.create(frame(spark, rows[:5]))
    assert store.shards == 1
    store = store.insert(frame(spark, rows[5:]))
    assert store.shards == 6
    out = got(store.apply(frame(spark, rows)))
    assert {i: (r["n_lines"], r["n_dropped"], r["text"]) for i, r in out.items()} == line_oracle(rows)


def test_line_dedup_of_null_and_repeated_ids(spark):
    line = "a line of more than forty characters, held by several rows"
    rows = [(None, line + "\nx"), (None, line), (None, line), (4, line + "\ny"), (4, line), (2, line)]
    out = line_dedup.LineStore.create(df := frame(spark, [(i if i is not None else -1, t) for i, t in rows]).withColumn("doc_id", F.expr("nullif(doc_id, -1)"))).apply(df)
    kept = sorted(((r.doc_id, r.text, r.n_dropped) for r in out.collect()), key=str)
    assert kept == sorted([(None, "x", 1), (None, "", 1), (None, "", 1), (4, line + "\ny", 0), (4, line, 0), (2, "", 1)], key=str)


# 3 decontamination


def hit_oracle(docs, items, window=10):
    out = {}
    grams = []
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        grams += [(item, tuple(w[k : k + n])) for k in range(len(w) - n + 1)] if n else []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, g in grams:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def test_decontamination(spark):
    rows = corpus()
    texts = dict(rows)
    bench = [(7, " ".join(texts[3].split()[:14]).upper()), (8, "one"), (9, None), (10, ""), (11, "never here at all and so on and on and on"), (12, " ".join(texts[5].split()[2:13]) + "!"), (13, "word word word word word word word word word word word")]
    items = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, doc_id int")
    out = got(positional.contaminated(frame(spark, rows), items))
    assert {i: (r["n_words"], r["n_hit"], r["items"]) for i, r in out.items()} == hit_oracle(rows, bench)


@pytest.mark.parametrize("lot", [7, 10_000])
def test_decontamination_by_a_large_test_set(spark, monkeypatch, lot):
    rows = corpus(20)
    bench = [(k, " ".join(rows[k][1].split()[:12])) for k in range(10)] + [(50, None), (51, "word"), (52, "nobody knows this")]
    monkeypatch.setattr(positional, "LOT_WORDS", 40)
    monkeypatch.setattr(positional, "LOT_PHRASES", lot)
    monkeypatch.setattr(positional, "BLOCK_BYTES", 700)
    out = got(positional.contaminated(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")))
    assert {i: (r["n_words"], r["n_hit"], r["items"]) for i, r in out.items()} == hit_oracle(rows, bench)


@pytest.mark.parametrize("words", [0, 10_000])
def test_decontamination_of_odd_rows(spark, monkeypatch, words):
    """Equal blocks stay apart, null ids and equal rows are rows each; empty tables give nothing."""
    monkeypatch.setattr(positional, "LOT_WORDS", words)
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (None, None)], "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "ten")], "item_id long, text string")
    out = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in positional.contaminated(docs, items).collect()), key=str)
    assert out == sorted([(None, 11, 11, ["1", "2"]), (5, 11, 11, ["1", "2"]), (5, 11, 11, ["1", "2"]), (None, 0, 0, [])], key=str)
    assert positional.contaminated(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in positional.contaminated(docs, items.limit(0)).collect()} == {0}


def test_proximity():
    data = [b"a x b y c", b"c b a", b"a b", b"c"]
    b = positional.build_block(data)
    block = positional.Block({k: v.tobytes() for k, v in b.items()} | {"doc_ids": np.arange(4).tobytes(), "nulls": np.zeros(4, bool).tobytes()})
    terms = block.find(np.array([word_hashes(x)[0][0] for x in (b"a", b"b", b"c")]))
    docs = lambda span: {int(np.searchsorted(block.begins, p, "right")) - 1 for p in block.near(terms, span)}
    assert docs(5) == {0, 1} and docs(3) == {1} and docs(2) == set()


def test_proximity_over_the_index(spark, monkeypatch):
    rng = random.Random(3)
    item = [f"k{k}" for k in range(9)] + ["k0"]
    gaps = [x for w in item for x in (w, "and")]
    rows = [(0, " ".join(item)), (1, " ".join(item[::-1])), (2, " ".join(gaps)), (3, " ".join(item[:-1])), (4, " ".join(item[:5] + ["x"] * 11 + item[5:])), (None, " ".join(["y"] * 9 + item)), (6, None)]
    rows += [(10 + k, " ".join(rng.choice(item + ["z"]) for _ in range(60))) for k in range(30)]
    bench = [(1, " ".join(item)), (2, "z k1"), (3, None)]

    def oracle(text):
        w, out = words(text), set()
        for i, t in bench:
            need = Counter(words(t))
            if need and any(not need - Counter(w[a : a + 2 * sum(need.values())]) for a in range(len(w))):
                out.add(str(i))
        return sorted(out)

    monkeypatch.setattr(positional, "LOT_WORDS", 8)
    items = spark.createDataFrame(bench, "item_id long, text string")
    out = {r.doc_id: r for r in positional.proximate(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert {i: r["items"] for i, r in out.items()} == {i: oracle(t) for i, t in rows}
    assert [out[k].n_near > 0 for k in (0, 1, 2, 3, 4, None, 6)] == [True, True, True, False, False, True, False]


# 6 tokens


def test_tokens_round_trip(spark):
    rows = [(i * 3 % 101, t) for i, t in corpus()] + [(500, "  two  spaces\n\n x "), (501, "it's 'S ...wait"), (502, "<|endoftext|> x"), (503, "a b   c")]
    out = got(token_shards.encoded(frame(spark, rows)))
    tk = token_shards.encoder(token_shards.default_tokenizer()).tokenizer
    at = 0
    for i, t in sorted(rows):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        assert (out[i]["start"], out[i]["n_tokens"], out[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        at += len(ids)


def test_tokens_of_copies_and_unknown_keys(spark):
    from kilnwork.llm.shared import work_dir

    docs = spark.createDataFrame([(1, "b a"), (1, "b a"), (None, "n"), (2, None)], "doc_id long, text string")
    folder = work_dir(spark)
    directory = token_shards.write_shards(docs, folder, token_shards.default_tokenizer(), shard_tokens=3)
    buckets = token_shards.write_index(directory, folder)
    found = token_shards.lookup(directory.select("doc_id", "copy"), folder, buckets)
    rows = token_shards.read_back(found, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.copy) for r in rows) == [(False, 1, 0), (False, 1, 1), (False, 2, 0), (True, 0, 0)]
    unknown = token_shards.lookup(spark.createDataFrame([(12345, 0), (1, 2), (None, 1)], "doc_id long, copy int"), folder, buckets).collect()
    assert [r.part for r in unknown] == [None] * 3
    assert token_shards.encoded(frame(spark, [])).count() == 0


def test_tokens_of_an_id_on_many_rows(spark):
    """Ids that span several ranges: every copy has a number and a place of its own."""
    rng = random.Random(2)
    rows = [(7 if k % 2 else None if k % 3 else k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))) for k in range(400)]
    out = token_shards.encoded(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len({(r.doc_id, r.copy) for r in out}) == len({r.start for r in out}) == len(rows)
    assert max(r.copy for r in out if r.doc_id == 7) == sum(i == 7 for i, _ in rows) - 1
    tk = token_shards.encoder(token_shards.default_tokenizer()).tokenizer
    crc = lambda t: zlib.crc32(np.array(tk.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in out) == Counter((i, crc(t)) for i, t in rows)


def test_words_are_forgotten_by_bytes(monkeypatch):
    monkeypatch.setattr(token_shards, "REMEMBERED", 8000)
    own = token_shards.Encoder(token_shards.default_tokenizer())
    rng = random.Random(3)
    alphabet = ["ka", "to", "É", "ñ", "'s", "12", "...", "ß", "\n", "x,", "日本", "-", "\t", " "]
    for _ in range(30):
        texts = ["".join(rng.choice(alphabet + [" "] * 6) for _ in range(rng.randint(0, 60))) for _ in range(20)]
        assert own(texts) == [own.whole(t) for t in texts]
        assert own.memo.bytes < 8000 and len(own.memo.older) < 400


def test_other_splittings_are_encoded_whole(tmp_path):
    import json

    spec = json.load(open(token_shards.default_tokenizer()))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    own = token_shards.Encoder(str(tmp_path / "t.json"))
    assert not own.by_words and own.one("two words") == own.whole("two words")
    assert token_shards.encoder(token_shards.default_tokenizer()).by_words


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 5000)).astype(np.uint64)
    h = mph.MinimalPerfectHash.build(keys)
    again, _ = mph.MinimalPerfectHash.from_bytes(h.to_bytes())
    assert sorted(again(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        mph.MinimalPerfectHash.build(np.array([1, 1], np.uint64))


# 8 mixing


def water_oracle(sizes, cap=3):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, target, free = sum(sizes.values()), {}, set(names)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), rng.choice(["a", "a", "a", "b", "c", "D", None])) for i in range(400)] + [(900, None, "a"), (901, "", "empty"), (902, "w w", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slim = mixing.sized(docs)
    assert {r.doc_id: r.mix_size for r in slim.collect()} == {i: len((t or "").split()) for i, t, _ in rows}
    plan = mixing.plan_mix(slim.select("source", "mix_size", "mix_hash"))
    out = mixing.apply_mix(slim, plan).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = water_oracle(dict(sizes))
    taken = Counter()
    for r in out:
        assert r.mix_target == pytest.approx(want[r.source]) and r.mix_source_size == sizes[r.source] and r.mix_repeats <= 3
        taken[r.source] += r.mix_repeats * r.mix_size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 15
    again = mixing.apply_mix(slim, mixing.plan_mix(slim.select("source", "mix_size", "mix_hash"))).collect()
    assert sorted((r.doc_id, r.mix_repeats) for r in out) == sorted((r.doc_id, r.mix_repeats) for r in again)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.mix_repeats for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_of_equal_rows(spark):
    """20 equal rows without an id meet their target as well as any others, and reruns on other partitions agree."""
    rows = [(None, "w " * 20, "a")] * 20 + [(k, "w " * 10, "b") for k in range(60)]
    runs = []
    for parts in (1, 5):
        rows_now = mixing.told_apart(mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)))
        out = mixing.apply_mix(rows_now, mixing.plan_mix(rows_now.select("source", "mix_size", "mix_hash"))).collect()
        assert len({r.mix_hash for r in out}) == len(rows) == len(out)
        runs.append(sorted((r.source, r.doc_id or 0, r.mix_hash, r.mix_repeats) for r in out))
        for s in "ab":
            assert abs(sum(r.mix_size * r.mix_repeats for r in out if r.source == s) - next(r.mix_target for r in out if r.source == s)) <= 10
    assert runs[0] == runs[1]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert mixed.filter("source = 'a'").count() == sum(r[3] for r in runs[0] if r[0] == "a")


def test_ranges_follow_the_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "w " * (k % 7 + 1), "ab"[k % 2]) for k in range(300)], "doc_id long, text string, source string")
    slim = mixing.sized(docs)
    repeats = lambda: sorted((r.doc_id, r.mix_repeats) for r in mixing.apply_mix(slim, mixing.plan_mix(slim.select("source", "mix_size", "mix_hash"))).collect())
    few = repeats()
    monkeypatch.setattr(mixing, "LEAST_BITS", 14)
    assert repeats() == few


# 9 near duplicates


def class_oracle(sets, linked):
    ids = list(sets)
    near = {i: {j for j in ids if j != i and linked(sets[i], sets[j])} for i in ids}
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (min(seen), len(near[i]))
    return out


def grams(text):
    w = words(text)
    n = min(5, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def test_jaccard_join(spark, monkeypatch):
    rng = random.Random(9)
    rows = corpus(40)
    base = " ".join(f"v{rng.randint(0, 500)}" for _ in range(200)).split()
    for k in range(60):  # a group of different near copies, over several blocks
        w = list(base)
        w[rng.randrange(len(w))] = f"n{k}"
        rows.append((200 + k, " ".join(w)))
    rows += [(400, "The same short text"), (401, "the SAME short text!"), (402, "the same short")]
    monkeypatch.setattr(forest_join, "NODE_BLOCK", 16)
    monkeypatch.setattr(forest_join, "GROUP_BLOCK", 16)
    out = got(forest_join.jaccard_join(frame(spark, rows)))
    want = class_oracle({i: grams(t) for i, t in rows}, lambda a, b: bool(a) and len(a & b) >= 0.8 * len(a | b) - 1e-9)
    assert {i: (r["class_id"], r["n_links"]) for i, r in out.items()} == want


def test_jaccard_join_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.class_id, r.n_links) for r in forest_join.jaccard_join(docs).collect()), key=str)
    assert rows == sorted([(None, None, 0), (1, 1, 1), (1, 1, 1), (2, 2, 0)], key=str)
    assert forest_join.jaccard_join(docs.limit(0)).count() == 0


def test_jaccard_join_of_texts_under_one_id(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    docs = spark.createDataFrame([(5, a), (5, b), (3, b), (7, a), (8, a + " x y z")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.class_id, r.n_links) for r in forest_join.jaccard_join(docs).collect())
    assert rows == [(3, 3, 1), (5, 3, 1), (5, 5, 1), (7, 5, 1), (8, 8, 0)]


def test_pairs_at_a_lower_threshold_pass_the_filter(spark):
    rows = []
    for k in range(40):  # 40 shingles of 60 are common, of 80 in all
        own = [[f"p{k}x{n}" for n in range(44)] + [f"{c}{k}x{n}" for n in range(20)] for c in "ab"]
        rows += [(2 * k + n, " ".join(w)) for n, w in enumerate(own)]
    out = forest_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.5, recall=0.9).collect()
    assert sum(r.n_links for r in out) >= 2 * 32
    assert forest_join.least_agreement() == 72


def test_walks_meet_the_recall():
    for similarity in (0.5, 0.8, 0.857, 0.95):
        for recall in (0.9, 0.99, 0.99999):
            level, n = forest_join.walk(similarity, recall)
            found = lambda at, k: 1 - (1 - similarity**at) ** k * (1 - similarity ** min(at + 1, forest_join.DEPTH)) ** (forest_join.TREES - k)
            assert found(level, n) >= recall or (level, n) == (1, forest_join.TREES)
            assert n == 1 or found(level, n - 1) < recall  # shortened no more than needed
    assert forest_join.walk(0.8)[0] == forest_join.shallowest() and forest_join.walk(0.95)[0] > forest_join.shallowest()


def test_least_similarity():
    for size in range(1, 40):
        pairs = [c / (size + m - c) for m in range(1, 90) for c in range(1, min(size, m) + 1) if not c == size == m]
        assert forest_join.least_similarity(size) == pytest.approx(min([x for x in pairs if x >= 0.8 - 1e-12], default=1.0))


def signatures(rng, n, groups):
    """Random signatures, and groups of (members, chance that a hash is the group's)."""
    wide = forest_join.TREES * forest_join.DEPTH
    out = [rng.integers(0, 1 << 16, (n, wide))]
    for members, same in groups:
        base = rng.integers(0, 1 << 16, wide)
        out.append(np.where(rng.random((members, wide)) < same, base, rng.integers(0, 1 << 16, (members, wide))))
    return np.concatenate(out).astype(np.uint16)


def test_walks_stop_at_different_depths(spark, monkeypatch):
    monkeypatch.setattr(forest_join, "NODE_BLOCK", 8)
    rng = np.random.default_rng(1)
    signs = signatures(rng, 300, [(60, 0.95), (2, 0.97), (2, 0.97)])
    sizes = [100] * 360 + [100, 100, 7, 7]
    rows = [(k, s.tobytes(), n) for k, (s, n) in enumerate(zip(signs, sizes, strict=True))]
    classes = spark.createDataFrame([(k, bytearray(s), n) for k, s, n in rows], "rep long, signature binary, size int").repartition(3)
    out = defaultdict(dict)
    for r in forest_join.stops(classes).collect():
        assert bytes(r.label) == signs[r.rep].reshape(forest_join.TREES, -1)[r.tree].astype(">u2").tobytes()
        out[r.rep][r.tree] = r.depth
    assert not set(out) & set(range(300))  # nobody shares a prefix with them
    level, n = forest_join.walk(0.8)
    for k in range(300, 362):
        assert set(out[k].values()) <= {level, level + 1} and sum(d == level for d in out[k].values()) <= n
    assert len({frozenset(t for t, d in out[k].items() if d == level) for k in range(300, 360)}) > 10  # each its own trees
    sooner, many = forest_join.walk(forest_join.least_similarity(7))
    assert set(out[362].values()) <= {sooner, sooner + 1} and (sooner, -many) > (level, -n)  # few shingles: it stops earlier


def test_labels_that_meet_nobody_leave(spark):
    rng = np.random.default_rng(3)
    signs = signatures(rng, 500, [(3, 1.0)] * 20)
    classes = spark.createDataFrame([(k, bytearray(s.tobytes()), 50) for k, s in enumerate(signs)], "rep long, signature binary, size int").repartition(5)
    left = forest_join.tries(classes, 4).groupBy("rep").count().collect()
    assert {r.rep for r in left if r["count"] == forest_join.TREES} >= set(range(500, 560))  # across the partitions' borders too
    assert sum(r["count"] for r in left if r.rep < 500) <= 2 * 24


def test_recall_against_all_pairs(spark):
    """Pairs at and just above the threshold, among documents that share half of their text, held against all pairs."""
    rng = random.Random(12)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for k in range(120):
        own = [f"d{k}x{n}" for n in range(60)]
        rows.append((3 * k, " ".join(common + own)))
        for copy in (1, 2):
            w = list(own)
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(60)] = f"e{rng.randint(0, 9999)}"
            rows.append((3 * k + copy, " ".join(common + w)))
    sets = {i: grams(t) for i, t in rows}
    linked = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    want = class_oracle(sets, linked)
    out = got(forest_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")))
    links = sum(n for _, n in want.values())
    assert links > 300 and sum(r["n_links"] for r in out.values()) == links
    assert {i: (r["class_id"], r["n_links"]) for i, r in out.items()} == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 99), (99, 101), (7, 7)]
    out = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert out == {k: 1 for k in range(1, 41)} | {99: 99, 100: 99, 101: 99}


# 10 embeddings


def vectors(clusters=12, n=250, noise=0.15, seed=5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, 16))
    x = np.concatenate([centre[rng.integers(clusters, size=n)] + rng.normal(size=(n, 16)) * noise, rng.normal(size=(50, 16))]).astype(np.float32)
    x[10] = x[11] = x[12]
    return x


def vector_oracle(rows):
    usable = {i: (np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    return class_oracle(usable, lambda a, b: a[1] == b[1] and len(a[0]) == len(b[0]) and cosine(a[0], b[0]) >= 0.93)


@pytest.mark.parametrize("noise", [0.15, 0.02])
def test_cover_tree_pairs(spark, noise):
    x = vectors(noise=noise)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 0), (903, [1.0, None] + [0.0] * 14, 0), (904, x[10].tolist(), None)]
    rows += [(905, [], 1), (906, (x[12] * 3).tolist(), 0), (907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = got(cover_tree.near_duplicates(df, block=32, cell=24), "vec_id")
    want = vector_oracle(rows)
    for i, r in out.items():
        assert (r["component_id"], r["n_links"]) == want.get(i, (i, 0)), i
    assert len(out) == len(rows)


def test_cells_rule_out_and_lose_nothing(spark):
    """Vectors in tight groups far apart: few visits, and links across the cells' borders are there."""
    x = vectors(clusters=30, n=400, noise=0.05)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "rep long, embedding array<double>, label int")
    classes = df.selectExpr("rep", "embedding", "'1' AS label_key", "size(embedding) AS dims", "1L AS copies")
    centres = cover_tree._centres(classes, 24, 1 << 20)
    placed = cover_tree._placed(classes, centres, 0.93)
    n_cells = len(next(iter(centres.values())))
    visits = placed.selectExpr("sum(size(visits))").first()[0]
    assert n_cells > 8 and visits < 0.25 * len(x) * n_cells / 2


def test_vectors_of_odd_ids(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, a, 0, 9), (1, b, 0, 9), (2, b, 0, 9), (None, a, 0, 9), (3, [1.0, 0.01, 0.0], 0, 9), (4, a, 1, 9)], "vec_id long, embedding array<float>, label int, rep int")
    rows = sorted(((r.vec_id, r.n_links, r.component_id) for r in cover_tree.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4), (None, 0, None)], key=str)
    assert cover_tree.near_duplicates(df.limit(0)).count() == 0


def test_cover_tree_bounds():
    x = vectors(n=400).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = cover_tree.CoverTree(x, leaf=4)
    assert sorted(t.order) == list(range(len(x)))
    for k, kids in enumerate(t.kids):
        rows = t.rows(k)
        assert (np.linalg.norm(x[rows] - x[t.centre[k]], axis=1) <= t.reach[k] + 1e-12).all()
        if kids:
            half = t.level[kids[0]]
            assert t.centre[k] in [t.centre[c] for c in kids] and half <= t.level[k] / 2 + 1e-12  # nested, halving
            assert sorted(t.order[t.first[k] : t.last[k]]) == sorted(np.concatenate([t.rows(c) for c in kids]))
            apart = [np.linalg.norm(x[t.centre[c]] - x[t.centre[d]]) for c in kids for d in kids if c < d]
            assert min(apart, default=9) > half - 1e-9


# learned operators


def labelled(spark, kind, n=160, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"{rng.choice('bcdfglmn')}{rng.choice('aeiou')}{rng.choice('rstnl')}{rng.choice(['', 'ing', 'er', 'ed'])}" for _ in range(rng.randint(30, 90))]
        y = i % 2
        if kind == "toxic" and y:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["idiotic", "moronic", "scummy"]))
        if kind == "quality" and not y:
            w = [x.upper() + "!!" for x in w] if rng.random() < 0.5 else [w[0]] * 30 + [w[1]] * 30
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    rows += [(1000, None), (1001, ""), (1002, "!!!"), (1003, "a" * 3000)]
    return frame(spark, rows), spark.createDataFrame(labels + [(5000, 1), (3, None)], f"doc_id long, {kind} int"), dict(labels)


@pytest.mark.parametrize(("kind", "module", "by", "fold"), [("toxic", toxicity, 3, 1), ("quality", quality, 4, 2)])
def test_classifiers_on_held_out_rows(spark, kind, module, by, fold):
    docs, labels, truth = labelled(spark, kind)
    model = module.trained(docs, labels)
    out = got(module.scored(docs, model))
    assert all(0 <= r["score"] <= 1 for r in out.values()) and len(out) == docs.count()
    held = [i for i in truth if zlib.crc32(str(i).encode()) % by == fold]
    right = [(out[i]["score"] >= 0.7) == bool(truth[i]) for i in held]
    assert np.mean(right) >= 0.85, np.mean(right)
    nothing = module.trained(docs, labels.limit(0))
    assert {round(r.score, 6) for r in module.scored(docs, nothing).collect()} <= {0.0, 1.0}


@pytest.mark.parametrize(("kind", "module"), [("toxic", toxicity), ("quality", quality)])
def test_classifiers_on_odd_rows(spark, kind, module):
    """Equal texts score alike, null ids are kept, an empty table gives nothing, an id on many rows is one training row."""
    docs, labels, _ = labelled(spark, kind)
    more = spark.createDataFrame([(None, "one text"), (None, "one text"), (7, "another"), (7, "another"), (7, None)], "doc_id long, text string")
    model = module.trained(docs.select("doc_id", "text").unionByName(more), labels)
    out = sorted(((r.doc_id, r.score) for r in module.scored(more, model).collect()), key=str)
    assert len(out) == 5 and out[3] == out[4] and sorted(x for i, x in out if i == 7)[1:] != [] and module.scored(docs.limit(0), model).count() == 0
    assert len({x for i, x in out if i == 7}) <= 2
    assert 0 <= min(x for _, x in out) and max(x for _, x in out) <= 1


def test_network_without_log_odds(spark):
    """Ablation: the network alone parts held-out texts too."""
    docs, _, truth = labelled(spark, "toxic", n=400)
    rows = [(r.doc_id, r.text.encode()) for r in docs.collect() if r.doc_id in truth]
    train, held = [r for r in rows if r[0] % 3], [r for r in rows if r[0] % 3 == 0]
    net = toxicity.fit([t for _, t in train], np.array([truth[i] for i, _ in train]), log_odds=False)
    assert len(net.odds[0]) == 0
    assert np.mean((net.score([t for _, t in held]) >= 0.7) == np.array([truth[i] for i, _ in held])) >= 0.85


def test_ranking_lowers_the_pairwise_loss():
    rng = np.random.default_rng(4)
    y = np.arange(300) % 2
    x = rng.normal(size=(300, 24)) + y[:, None] * (np.arange(24) < 3)
    model = quality.fit(x, y)
    s = model.raw(x)
    loss = np.log1p(np.exp(-(s[y == 1][:, None] - s[y == 0][None, :]))).mean()
    assert loss < 0.6 * np.log(2) and (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.9


def test_ranking_is_learned_from_all_rows(spark):
    """The first 3,000 rows of each label by hash tell nothing; those after them do."""
    ids = spark.range(11_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality", "row_number() OVER (PARTITION BY id % 2, crc32(cast(cast(id AS string) AS binary)) % 4 = 2 ORDER BY xxhash64(id), id) AS place")
    docs = ids.selectExpr("doc_id", "CASE WHEN place <= 3000 THEN 'alpha beta gamma' WHEN quality = 1 THEN 'quiet river stone' ELSE 'QUIET RIVER STONE' END AS text")
    model = quality.trained(docs, ids.select("doc_id", "quality"))
    good, bad = model.score(quality.features([b"quiet river stone", b"QUIET RIVER STONE"]))
    assert good > 0.7 > bad


def test_ranking_is_that_of_all_pairs():
    """Against every pair written out: no slope is left; rows in blocks give the same ranking; edges are the quantiles of all rows."""
    rng = np.random.default_rng(6)
    y = (np.arange(500) % 5 > 1).astype(int)
    x = np.round(rng.normal(size=(500, 24)) + y[:, None] * (np.arange(24) < 3), 1).astype(np.float32)
    model = quality.fit(x, y)
    laid = model.laid_out(x)
    diff = (laid[y == 1][:, None] - laid[y == 0][None]).reshape(-1, laid.shape[1])
    assert np.abs((1 / (1 + np.exp(diff @ model.w))) @ diff / len(diff) - quality.DECAY * model.w).max() < 1e-4
    edges = np.quantile(x.astype(float), np.linspace(0, 1, quality.BINS + 1), axis=0)
    assert np.abs(model.edges - edges).max() < 1e-4
    blocks = quality.learned(lambda work: sum(work(x[k : k + 37], y[k : k + 37]) for k in range(0, 500, 37)))
    assert np.allclose(blocks.w, model.w, atol=1e-6) and np.isclose(blocks.cut, model.cut, atol=1e-3)
    assert np.isclose(model.cut, best_cut(model.raw(x), y), atol=1e-2)


def test_quantiles_of_all_rows():
    x = np.array([[0.0, -1.5, 3e-9], [0.0, 2.5, 1e9], [0.25, -2.0, 0.0], [0.0, 0.0, 7.0], [1.0, -1.5, 7.0], [0.0, 9.0, 1e-3]], np.float32)
    found = quality.quantiles(lambda work: work(x, None), 6, 3, np.linspace(0, 1, 9))
    assert np.allclose(found, np.quantile(x.astype(float), np.linspace(0, 1, 9), axis=0), rtol=1e-12)


def test_quality_keeps_columns(spark):
    docs, labels, _ = labelled(spark, "quality")
    kept = quality.kept(docs, quality.trained(docs, labels))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_network_gradient():
    net = toxicity.Network()
    data = [b"one two three four", b"five six"]
    w = toxicity.Words(data)
    windows, _ = w.windows()
    x = net.inputs(w).astype(np.float64)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    logit, kept = net.forward(x, windows, keep=True)
    grad, d_x = net.backward(x, windows, kept, np.ones(len(windows)))
    for name in ("Uf", "Wb", "A", "v", "o"):
        at = np.unravel_index(3, net.p[name].shape)
        net.p[name][at] += 1e-3
        up = net.forward(x, windows).sum()
        net.p[name][at] -= 2e-3
        down = net.forward(x, windows).sum()
        net.p[name][at] += 1e-3
        assert grad[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-3), name
    x[2, 1] += 1e-3
    up = net.forward(x, windows).sum()
    x[2, 1] -= 2e-3
    assert d_x[2, 1] == pytest.approx((up - net.forward(x, windows).sum()) / 2e-3, rel=0.05, abs=1e-3)


def test_windows_cover_every_word():
    w = toxicity.Words([b" ".join(b"w%d" % k for k in range(n)) for n in (0, 1, 16, 24, 32, 33, 48, 49, 56, 57, 100)])
    windows, text = w.windows()
    for k, n in enumerate((0, 1, 16, 24, 32, 33, 48, 49, 56, 57, 100)):
        assert len(np.unique(windows[(text == k)[:, None] & (windows >= 0)])) == n


def test_language(spark):
    rng = random.Random(8)
    rows, truth = [], {}
    for i in range(160):
        lang = ["aa", "bb", "cc", None][i % 4]
        seed = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["eau", "oux", "é"], None: ["ka", "to", "mi"]}[lang]
        rows.append((i, " ".join("".join(rng.choice(seed) for _ in range(3)) for _ in range(40)), lang))
        truth[i] = lang or "aa"
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "123 !?", "bb"), (902, "", None)], "doc_id long, text string, lang string")
    out = got(language.predicted(docs, language.trained(docs)))
    assert np.mean([out[i]["lang_pred"] == truth[i] for i in truth]) > 0.97
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (900, 901, 902))
    assert {r.lang_pred for r in language.predicted(docs, language.trained(docs.limit(0))).collect()} == {"und"}


def test_decoding_weighs_the_loss_of_every_bit():
    rng = np.random.default_rng(2)
    code = language.codewords(5)
    model = language.Codes(list("abcde"), code, rng.normal(size=(6, code.shape[1])), rng.normal(size=code.shape[1]), rng.random(code.shape))
    x = rng.normal(size=(20, 6))
    best, share, _ = model.decode(x)
    for k, row in enumerate(x):
        margin = [sum(row[d] * model.w[d, bit] for d in range(6)) + model.b[bit] for bit in range(code.shape[1])]
        loss = [sum(model.weight[n, bit] * np.log(1 + np.exp(-code[n, bit] * margin[bit])) for bit in range(code.shape[1])) for n in range(5)]
        assert best[k] == int(np.argmin(loss)) and share[k] == pytest.approx(np.exp(-min(loss)) / sum(np.exp(-v) for v in loss))


def test_language_with_stray_values(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGS", 3)
    rows = [(k, ("ka to mi " if k % 2 else "schung eiung ") * 9, "aa" if k % 2 else "bb") for k in range(60)] + [(100 + k, "stray", f"x{k}") for k in range(20)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string")
    model = language.trained(docs)
    assert {"aa", "bb"} <= set(model.langs) and len(model.langs) <= 3
    out = got(language.predicted(docs, model))
    assert np.mean([out[i]["lang_pred"] == v for i, _, v in rows[:60]]) > 0.9
    assert language.predicted(docs.limit(0), model).count() == 0


def test_codewords_part_all_languages():
    for n in (2, 3, 4, 17):
        code = language.codewords(n)
        assert (np.abs(code.sum(0)) < n).all()
        assert min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) >= 3


# 7 secrets


def test_base_spans():
    text = 'x password="abc" PASSWORD = hunter22x AKIA' + "A" * 15 + " AKIA" + "B1" * 8 + " " + "0af" * 9 + ' api_key: "qwe.rty-" tokſen=zzzzzzz'
    got_spans = [(secrets.KINDS[k], text[a:b]) for a, k, b, _ in secrets.base_spans(text)]
    assert got_spans == [("assign", "PASSWORD = hunter22x"), ("access", "AKIA" + "B1" * 8), ("hex", "0af" * 9), ("assign", 'api_key: "qwe.rty-')]


def slow_spans(text):
    """The fixed formats read letter by letter, without patterns."""
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    fold = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    out, at = [], 0

    def run(k, allowed):
        end = k
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    while at < len(text):
        key = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if fold(text[at : at + len(w)]) == w), None)
        end = None
        if key:
            k = at + len(key)
            k += text[k : k + 1] in ("'", '"') and k < len(text)
            k = run(k, " ")
            if k < len(text) and text[k] in ":=":
                k = run(k + 1, " ")
                k += k < len(text) and text[k] in "'\""
                end = run(k, value)
                if end > k:
                    out += [("assign", at, end)] * (end - k >= 6)
                else:
                    end = None
        at = end or at + 1
    at = 0
    while at < len(text):
        end = run(at + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) if text.startswith("AKIA", at) else 0
        if end > at + 4:
            out += [("access", at, end)] * (end - at >= 20)
            at = end
        else:
            at += 1
    at = 0
    while at < len(text):
        end = run(at, set("0123456789abcdef"))
        out += [("hex", at, end)] * (end - at >= 24)
        at = max(end, at + 1)
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def credential_texts(n=400):
    rng = random.Random(11)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "api__key", "=", ":", " ", "  ", "'", '"', "AKIA", "A1B2C3D4E5F6G7H8", "0af9" * 6, "0af9" * 5, "hunter2", "é", "ſ", "\n", "-", ".", "x" * 9, "Q", "=="]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_base_spans_letter_by_letter():
    for text in credential_texts():
        assert [(secrets.KINDS[k], a, b) for a, k, b, _ in secrets.base_spans(text)] == slow_spans(text), text


def test_candidates_are_all_runs_beside_base_spans():
    for text in credential_texts():
        base = secrets.base_spans(text)
        free = list(text)
        for a, _, b, _ in base:
            free[a:b] = [" "] * (b - a)
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", "".join(free)):
            v = m[0].strip(".-")
            if len(v) >= 6:
                start = m.start() + len(m[0]) - len(m[0].lstrip(".-"))
                want.append((start, start + len(v), v))
        assert list(secrets.candidates(text, base)) == want, text


def test_candidates_of_a_buffer_score_as_one_by_one():
    """Arrays over a buffer of texts against a text and a candidate at a time; long runs, other alphabets and empty texts among them."""
    rng = random.Random(9)
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    hexes = lambda n: letters(n, "0123456789abcdef")
    plain = [letters(rng.randint(6, 12), "aeioulnrst") for _ in range(300)]
    formats = secrets.fit({"hex": [hexes(32) for _ in range(50)], "access": ["AKIA" + letters(16, "ABCDEFGH0123") for _ in range(50)]}, plain)
    texts = credential_texts(60) + ["", "é" * 5 + hexes(20), f"ü {hexes(300)} ß {hexes(22)}-- ..{hexes(21)}", "-" * 5000, ".".join([hexes(20)] * 20), "AKIA" + letters(15, "ABCDEFGH0123"), " ".join(plain)]
    base = [secrets.base_spans(t) for t in texts]
    want = [[(a, b) for a, b, value in secrets.candidates(t, spans) if formats.likely(value)] for t, spans in zip(texts, base, strict=True)]
    assert secrets.format_spans([t.encode() for t in texts], base, formats) == want
    assert not want[60] and want[61] and want[62]  # hexadecimal runs too short for the fixed format; of some the likelihood is below the TAIL
    words = [v for t in texts for _, _, v in secrets.candidates(t, secrets.base_spans(t)) if len(v) <= secrets.LONG] + plain
    words.sort(key=len, reverse=True)
    data, begins = secrets.joined([w.encode() for w in words])
    for automaton, literal in [(a, n) for a, n, _ in formats.kinds.values()] + [(formats.background, 0)]:
        told = secrets.Steps(automaton, literal).scores(data, begins[:-1], np.array([len(w) for w in words]))
        assert told.tolist() == [automaton.score(secrets.spelled(w, literal)) for w in words]


def test_secrets(spark):
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"some words here token={hexes(32)} and {hexes(40)} end") for i in range(30)] + [(100, f"plain words {hexes(20)}9a more"), (101, None), (102, ""), (103, "nothing at all, characteristically")]
    rows += [(None, "secret: abcdef" + "0" * 30), (104, "word " * 40_000 + "password=" + "z9" * 9)] + [(30 + k, t) for k, t in enumerate(credential_texts(40))]
    docs = frame(spark, [(i if i is not None else -1, t) for i, t in rows]).withColumn("doc_id", F.expr("nullif(doc_id, -1)"))
    out = got(secrets.with_formats(docs, secrets.learned(docs)))
    assert len(out) == len(rows)
    for i, t in rows:
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in slow_spans(t or ""))
        assert out[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) - {""} <= set(out[i]["spans"].split(","))
        assert [out[i][f"n_{k}"] for k in secrets.KINDS] == [sum(x[0] == k for x in slow_spans(t or "")) for k in secrets.KINDS]
    assert out[103]["spans"] == ""
    empty = frame(spark, [])
    assert secrets.with_formats(empty, secrets.learned(empty)).count() == 0


def test_unlabelled_credentials_of_known_formats(spark):
    """Credentials without a fixed format's syntax, planted among words, numbers, dates and addresses: what is found, and what else is."""
    rng = random.Random(4)
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 6)))
    plain = lambda: [rng.choice([word, word, word, lambda: f"20{rng.randint(10, 25)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: f"{word()}.com/{word()}", lambda: str(rng.randint(10**6, 10**9))])() for _ in range(60)]
    rows, planted = [], {}
    for i in range(300):
        w = plain()
        if i % 3 == 0:
            w.insert(20, f"token={letters(32, mixed)}")
        elif i % 3 == 1:
            own = letters(32, mixed)
            w.insert(20, own)
            planted[i] = own
        rows.append((i, " ".join(w)))
    docs = frame(spark, rows)
    out = got(secrets.with_formats(docs, secrets.learned(docs)))
    texts, hits, alarms = dict(rows), 0, 0
    for i, r in out.items():
        told = [texts[i][int(a) : int(b)] for a, b in (x.split(":")[1:] for x in r["spans"].split(",") if x.startswith("format"))]
        hits += planted.get(i) in told
        alarms += len([x for x in told if x != planted.get(i)])
    assert hits >= 0.8 * len(planted) and alarms <= 0.0005 * 300 * 60, (hits, len(planted), alarms)


def test_automata_tell_formats_apart():
    rng = random.Random(1)
    ids = ["AKIA" + "".join(rng.choice("ABCDEFGHJKLMNP234567") for _ in range(16)) for _ in range(100)]
    f = secrets.fit({"access": ids}, ["characteristically", "thingamajigs"])
    assert f.likely("AKIA" + "Q7" * 8) and not f.likely("release-2024.01")


def test_shingles_of_few_words():
    h = word_hashes(b"a b c")[0]
    assert len(shingles(h)) == 1 and len(shingles(h[:0])) == 0 and len(shingles(word_hashes(b"a b c d e f")[0])) == 2
