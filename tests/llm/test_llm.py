"""The corpus operators against brute force, exact round trips and held-out rows, with nulls, ties and odd texts."""

import base64
import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import binary, bpe, chat, common, decontaminate, graph, langid, lm_score, merkle, ngram_join, sharding, toxicity
from tidelog.llm.queries import QUERIES, pattern, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text2 string, group string, key long"
ODD = ["", None, " ", "\n\n", "a", "A b", "é漢🙂", "<|endoftext|>", "tab\there \x1c\x85 nbsp\xa0x", "x" * 3000, "1 2 3", "don't I'M", "\0", "a  b\n c", "</s>[INST] <s>\\[INST]"]


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None, "clash", "g", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def odd_texts(n=60, seed=3):
    r = random.Random(seed)
    chars = "aabe thin'sS12 \n\t\x1c\x85é漢🙂!.́σΣİ"
    return ODD + ["".join(r.choice(chars) for _ in range(r.randrange(40))) for _ in range(n)]


def tokenizer():
    path = vocabulary("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})


# --- 1


def test_bpe_equals_the_library(spark):
    path, lib = tokenizer()
    texts = odd_texts(2000)
    own = bpe.codec(path, pattern())
    for t in texts:
        assert own.encode(t or "") == lib.encode_ordinary(t or "")
    docs = docs_of(spark, texts[:80])
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, path, pattern()).collect()}
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(docs, path, pattern()), path, pattern()).collect()}
    trip = {r.doc_id: r for r in bpe.round_trip(docs, path, pattern(), ("text2",)).collect()}
    for i, t in enumerate(texts[:80]):
        assert ids[i] == lib.encode_ordinary(t or "") and back[i] == (t or "").encode()
        assert trip[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids[i])).encode()).hexdigest()
        assert trip[i].decoded_sha256 == hashlib.sha256(back[i]).hexdigest() and trip[i].text2 == "clash"
    assert bpe.round_trip(docs_of(spark, []), path, pattern()).count() == 0


def test_bpe_backtracking_equals_merging():
    path, _ = tokenizer()
    own = bpe.codec(path, pattern())
    r = random.Random(9)
    for _ in range(3000):
        piece = "".join(r.choice("aeinst'-.0é") for _ in range(r.randrange(1, 25))).encode()
        assert list(own.encode_piece(piece)) == own.merged(piece, 1 << 30)


# --- 2


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_decontamination_finds_copies_and_new_parameters(spark):
    item = "Last week the farmer Tom sold 12 apples to Mary and then Tom sold 7 kg of pears to Mary at noon"
    other = "What is the capital city of the small country that lies between two large rivers and a desert"
    docs = [
        f"Some words before. {item} and some words after",
        "x " + item.lower() + " y",
        "Intro: Last week the farmer Bob sold 55 apples to Anna and then Bob sold 9 lb of pears to Anna at noon",
        "Intro: Last week the farmer Bob sold 55 apples to Anna and then Jim sold 9 kg of pears to Eve at noon",
        "Last week the farmer went home and sold nothing at all to anybody in the village",
        f"{other} {item}",
        None,
        "",
    ]
    found = collections.defaultdict(set)
    for r in decontaminate.find(docs_of(spark, docs), items_of(spark, [item, other, "too short", None])).collect():
        found[r.doc_id].add(r.item_id)
    assert found == {0: {0}, 1: {0}, 2: {0}, 5: {0, 1}}
    kept = decontaminate.keep(docs_of(spark, docs), items_of(spark, [item, other]))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7] and kept.columns == docs_of(spark, []).columns
    assert decontaminate.find(docs_of(spark, docs), items_of(spark, [])).count() == 0
    assert decontaminate.find(docs_of(spark, []), items_of(spark, [item])).count() == 0


def test_decontamination_finds_names_that_begin_sentences(spark):
    items = ["Tom has 5 apples and buys 7 more", "Tom works in a shop. Mary pays him 8 coins a day. How many coins has Tom after 6 long days of work there", "On the way home from school Emile found 5 old coins"]
    docs = [
        "Bob has 9 apples and buys 2 more",
        "Solve this. Bob has 9 apples and buys 2 more",
        "Jim works in a shop. Anna pays him 3 coins a day. How many coins has Jim after 4 long days of work there",
        "Jim works in a shop. Anna pays him 3 coins a day. How many coins has Eve after 4 long days of work there",
        "On the way home from school Émile found 7 old coins",
        "On the way home from school Ольга found 7 old coins",
        "On the way home from school émile found 7 old coins",
        "bob has 9 apples and buys 2 more",
    ]
    found = collections.defaultdict(set)
    for r in decontaminate.find(docs_of(spark, docs), items_of(spark, items)).collect():
        found[r.doc_id].add(r.item_id)
    assert {k: found[k] for k in (0, 1, 2, 4, 5)} == {0: {0}, 1: {0}, 2: {1}, 4: {2}, 5: {2}}
    assert 6 not in found and 7 not in found


def test_decontamination_lets_new_values_coincide(spark):
    item = "in the shop Tom sold 3 red apples and then 5 green pears to a man"
    docs = [item.replace("3", "4").replace("5", "4"), "in the shop Bob sold 3 red apples and then 3 green pears to a man"]
    assert sorted(r.doc_id for r in decontaminate.find(docs_of(spark, docs), items_of(spark, [item])).collect()) == [0, 1]
    twice = "in the shop Tom sold 3 red apples and then 3 green pears to a man"
    assert decontaminate.find(docs_of(spark, [item.replace("Tom", "Bob")]), items_of(spark, [twice])).count() == 0


def test_decontamination_equals_brute_force(spark, sf):
    docs, items = (common.table(spark, sf, t).collect() for t in ("documents", "benchmark"))
    grams = collections.defaultdict(set)
    words = lambda t: [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "")]
    for r in items:
        w = words(r.text)
        for k in range(len(w) - 7):
            grams[tuple(w[k : k + 8])].add(r.item_id)
    want = {(r.doc_id, i) for r in docs for w in [words(r.text)] for k in range(len(w) - 7) for i in grams.get(tuple(w[k : k + 8]), ())}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontaminate"](spark, sf).collect()}
    assert want and got == want


def template_match(doc, item, window=8, least=5):
    """Whether a diagonal of the two texts has a window alike word for word, or alike but for slots that agree all along."""
    ends = ".!?:;\n\""

    def words(text):
        out, last = [], 0
        for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text):
            out.append([m[0], not out or any(c in ends for c in text[last : m.start()]), 0])
            last = m.end()
        return out

    def readings(own):
        made = []
        for names_begin in (False, True):
            kinds = []
            for k, (w, begins, _) in enumerate(own):
                number = w[0].isdigit() or w.lower() in decontaminate.NUMBERS
                unit = not number and k and kinds[-1] == "#" and w.lower() in decontaminate.UNITS
                name = w[0].isupper() and (names_begin or not begins)
                kinds.append("#" if number else "u" if unit else "N" if name else "")
            made.append(kinds)
        return made

    a, b = words(doc), words(item)
    size = min(window, len(b))
    low = [[w.lower() for w, _, _ in x] for x in (a, b)]
    ra, rb = readings(a), readings(b)
    for shift in range(-len(b), len(a)):
        places = [(k + shift, k) for k in range(len(b) - size + 1) if 0 <= k + shift <= len(a) - size]
        if any(low[0][x : x + size] == low[1][y : y + size] for x, y in places):
            return True
        for r in (0, 1):
            view = [[k or w for k, w in zip(kinds, ws)] for kinds, ws in ((ra[r], low[0]), (rb[r], low[1]))]
            pairs = set()
            for x, y in places:
                fixed = sum(not k for k in rb[r][y : y + size])
                if view[0][x : x + size] == view[1][y : y + size] and least <= fixed < size:
                    pairs |= {(low[1][y + j], low[0][x + j]) for j in range(size) if rb[r][y + j]}
            if pairs and len(pairs) == len({p for p, _ in pairs}):
                return True
    return False


def test_decontamination_of_planted_templates_equals_brute_force(spark, sf):
    r = random.Random(6)
    people, things = "Tom Mary Anna Bob Eve Jim".split(), "apples pears coins stones".split()
    make = lambda seed: (lambda q: f"A farmer called {q.choice(people)} sells {q.randrange(90)} red {things[seed % 4]} for {q.randrange(9)} dollars in shop number {seed} and walks {q.randrange(80)} km home to {q.choice(people)}")
    items = [make(i)(random.Random(i)) for i in range(6)] + ["only four words here", "zebra"]
    docs = [x.text or "" for x in common.table(spark, sf, "documents").orderBy("doc_id").limit(60).collect()]
    for i in range(0, 60, 3):
        w = docs[i][:400]
        docs[i] = f"{w} {make(i % 6)(r)}. {w}" if i % 2 else f"{w[:100]} {items[i % 6].lower()}"
    docs += ["We say only FOUR words here now", "a zebra.", "zebras", "words four only here"]
    got = {(x.doc_id, x.item_id) for x in decontaminate.find(docs_of(spark, docs), items_of(spark, items)).collect()}
    want = {(i, k) for i, d in enumerate(docs) for k, item in enumerate(items) if template_match(d, item)}
    assert got == want and len({i for i, _ in want}) >= 20


# --- 3


def test_chat_reads_back(spark):
    path, _ = tokenizer()
    r = random.Random(4)
    pieces = ["<s>", "</s>", "[INST]", "<\\s>", "<|turn|>", "<\\\\|end|>", " a", "é", "\n", "\\", "<", "[/INST]", "<|endoftext|>", "hello"]
    turns = []
    for c in range(12):
        for t in range(r.randrange(1, 9)):
            turns.append((c, t, r.choice(["user", "assistant", "system", None, "<|body|>"]), r.choice([None, "", "".join(r.choice(pieces) for _ in range(9))]), "x"))
    turns += [(12, t, "assistant", f"turn {t} " * 20, "x") for t in range(200)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, ids string").repartition(4)
    formatted = chat.format_chat(df, path, pattern(), 50257, part_ids=500)
    got = {r.conv_id: r for r in chat.read_back(formatted, path, pattern(), 50257).collect()}
    by = collections.defaultdict(list)
    for c, _, role, text, _ in turns:
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        loss = "".join(t for role, t in rows if role == "assistant")
        assert got[c].n_turns == len(rows)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in rows).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert formatted.filter("conv_id = 12").count() > 1
    for x in pieces + ["".join(r.choice(pieces) for _ in range(30)) for _ in range(300)]:
        assert chat.unescape(chat.escape(x)) == x and not any(c in chat.escape(x) for c in chat.CONTROLS)
    assert chat.read_back(chat.format_chat(df.limit(0), path, pattern(), 50257), path, pattern(), 50257).count() == 0


# --- 4


@pytest.mark.parametrize("n, copies", [(500, 12), (7, 2), (0, 0), (300, 150), (2400, 1100)])
def test_shards(spark, n, copies):
    r = random.Random(n)
    texts = [f"text {i % max(1, n // 3) if i % 4 == 0 else i}" for i in range(n)]
    for i in r.sample(range(n), copies):
        texts[i] = "copied"
    if n > 100:
        texts[5] = None
    rows = sharding.assign(docs_of(spark, texts), shards=10).collect()
    assert sorted(r.doc_id for r in rows) == list(range(n))
    by = collections.defaultdict(list)
    for x in rows:
        by[x.shard].append(x.slot)
        raw = (texts[x.doc_id] or "").encode()
        assert (x.size, x.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    sizes = [len(by[s]) for s in range(10)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    if n == 500:
        shard, home = {x.doc_id: x.shard for x in rows}, {x.doc_id: x.home for x in rows}
        groups = collections.defaultdict(list)
        for i, t in enumerate(texts):
            groups[t or ""].append(i)
        cut = lambda at: sum(len({at[i] for i in g}) - 1 for g in groups.values())
        assert cut(shard) <= 0.2 * cut(home)


def test_shards_where_every_document_has_a_copy(spark):
    texts = [f"text {i // 2}" for i in range(4000)]
    rows = sharding.assign(docs_of(spark, texts), shards=10).collect()
    shard, home = {x.doc_id: x.shard for x in rows}, {x.doc_id: x.home for x in rows}
    cut = lambda at: sum(at[i] != at[i + 1] for i in range(0, 4000, 2))
    assert collections.Counter(shard.values()) == {s: 400 for s in range(10)}
    assert cut(home) > 1700 and cut(shard) < 120


def test_shares_that_pass_fill_no_shard_above_its_capacity():
    assert sharding.passing({0: 10, 1: 10}, {(0, 1): 4, (1, 0): 4}, 10, 2) == [1.0, 1.0]  # what leaves makes room
    r = random.Random(4)
    for _ in range(50):
        load = {j: r.randrange(80, 121) for j in range(5)}
        wants = {(a, b): r.randrange(15) for a in range(5) for b in range(5) if a != b}
        share = sharding.passing(load, wants, 100, 5)
        for j in range(5):
            come = sum(n * share[b] for (a, b), n in wants.items() if b == j)
            gone = sum(n * share[b] for (a, b), n in wants.items() if a == j)
            assert come == 0 or load[j] + come - gone <= 100 + 0.1


# --- 5


def corpus(n, seed=1):
    r = random.Random(seed)
    parts = {"en": "the and of ing tion er is to th ou".split(), "fr": "le la eux ment que ère é oi et de".split(), "de": "der die ung sch ei ü und ich zu en".split()}
    out = []
    for i in range(n):
        lang = r.choice(list(parts))
        out.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 120))), lang))
    return out


def test_language(spark):
    rows = corpus(400) + [(1000, None, None), (1001, "", "en"), (1002, "123 !? 🙂", None), (1003, "漢字", None)]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, score string, c0 double").repartition(3)
    model = langid.fit(docs, common.remainder(4) != 2)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [i for i, t, lang in rows[:400] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred in ("en", "fr", "de")
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == 0
    odd = ["Съешь ещё этих мягких булок", "我们今天去学校学习中文", "aaaaaaaaaaaaaaaa", "Η γρήγορη αλεπού πηδάει", "xqzzv qqwkx zzvjk"]
    assert not any(r.accepted for r in langid.predict(docs_of(spark, odd), model).collect())
    kept = langid.keep(docs, common.remainder(4) != 2)
    assert kept.columns == docs.columns and len([1 for r in kept.collect() if r.doc_id < 400]) >= 396
    none = langid.fit(docs.filter("lang is null"), common.remainder(4) != 2)
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


# --- 6


def brute_classes(texts, k, num, den):
    rx, low = re.compile(rb"[^\x20\x09-\x0D]+"), bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for t in texts:
        w = rx.findall((t or "").encode().translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(n, seed, base=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["The", "of", "AND", "é"]
    bases = [[r.choice(words) for _ in range(r.randrange(1, base))] for _ in range(8)]
    texts = []
    for _ in range(n):
        w = list(r.choice(bases))
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(r.choice((" ", "\n", "  ")).join(w) if r.random() < 0.9 else r.choice(["", None, " ", "solo", "a b"]))
    return texts


@pytest.mark.parametrize("k, num, den", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_ngram_join_equals_brute_force(spark, k, num, den):
    texts = near_copies(160, k)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(docs_of(spark, texts), k, num, den).collect()}
    want = brute_classes(texts, k, num, den)
    assert [got[i] for i in range(len(texts))] == want and len({c for _, c in want}) < len(texts)


def test_ngram_join_splits_large_components(spark, monkeypatch):
    texts = near_copies(150, 11, base=90)
    monkeypatch.setattr(ngram_join, "GROUP_CLASSES", 10)
    got = {r.doc_id: r.component_id for r in ngram_join.classes(docs_of(spark, texts), 3, 80, 100).collect()}
    assert [got[i] for i in range(150)] == [c for _, c in brute_classes(texts, 3, 80, 100)]


def test_large_component_is_dealt_in_proportion(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(5000):  # near copies, all of them different
        w = list(base)
        w[r.randrange(100)] = f"own{i}"
        texts.append(" ".join(w))
    dealt, links = [], ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda raw, plan, *rest: (dealt.append(plan.count()), links(raw, plan, *rest))[1])
    rows = ngram_join.classes(docs_of(spark, texts), 3, 80, 100).collect()
    assert {x.component_id for x in rows} == {0} and len(rows) == 5000
    assert 5000 <= sum(dealt) <= 3 * 5000, dealt


@pytest.mark.parametrize("list_rows, meet_rows, num", [(64, 20_000, 90), (3, 20_000, 90), (3, 5, 80), (1, 2, 80)])
def test_lists_keep_all_that_may_link(monkeypatch, list_rows, meet_rows, num):
    monkeypatch.setattr(ngram_join, "MEET_ROWS", meet_rows)
    r = random.Random(list_rows)
    tasks = [[r.choice([*range(5, 90), 200, 205, 300, 500]) for _ in range(r.choice([1, 2, 30]))] for _ in range(5)]  # sizes of the classes that one list has in each task
    rows, sizes = [], {}
    for task in tasks:
        node = np.arange(len(sizes), len(sizes) + len(task))
        sizes |= dict(zip(node.tolist(), task))
        n = np.array(task)
        entries, _, pairs = ngram_join.collapse(*ngram_join.chain(np.zeros(len(n), np.int64), n, n, node, num, 100), list_rows)
        rows += ngram_join._rows(entries, pairs)
    root = {i: i for i in sizes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    met = {}
    for b in ngram_join._merge_lists(num, 100)(rows):
        for row in b.to_pylist():
            other = row["key"] if row["edge"] else met.setdefault(row["key"], row["node"])
            root[find(row["node"])] = find(other)
    for x, m in sizes.items():
        for y, n in sizes.items():
            if num * max(m, n) <= 100 * min(m, n):
                assert find(x) == find(y), (m, n)


def test_ngram_join_edges(spark):
    assert ngram_join.classes(docs_of(spark, []), 3, 90, 100).count() == 0
    rows = ngram_join.classes(docs_of(spark, ["a b c d", "a b c d", "a b c d", None, "x"], [5, 5, 3, 9, None]), 3, 90, 100).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id is not None) == [(3, 3), (5, 3), (5, 3), (9, 9)]
    docs = docs_of(spark, near_copies(80, 2) + [None, "", "same text here now", "same text here now"])
    kept = ngram_join.keep_one(docs)
    want = [i for i, (n, c) in enumerate(brute_classes([r.text for r in sorted(docs.collect(), key=lambda r: r.doc_id)], 5, 80, 100)) if c == i]
    assert sorted(r.doc_id for r in kept.collect()) == want and kept.columns == docs.columns


def test_search_counts_many_candidates():
    r = np.random.default_rng(0)
    base = r.integers(1, 1 << 60, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(100) > 0.06], r.integers(1, 1 << 60, 4).astype(np.uint64)])) for _ in range(150)]
    label = list(range(150))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(150):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                label[find(a)] = find(b)
    want = {frozenset(i for i in range(150) if find(i) == find(j)) for j in range(150)}
    root = list(range(150))
    for a, b in ngram_join.search(sets, 90, 100):
        x, y = root[a], root[b]
        root = [x if z == y else z for z in root]
    assert {frozenset(i for i in range(150) if root[i] == root[j]) for j in range(150)} == want


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(-50, 50), r.randrange(-50, 50)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 600 + i) for i in range(30)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in root.items() if any(x in e and e[0] != e[1] for e in edges)}


# --- 7


def brute_losses(texts, target):
    """Losses of each text by the target and the background model, both without the text's own counts."""
    tokens = [re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    vocabulary = {w for t in tokens for w in t}

    def count(some):
        pairs, before = collections.Counter(), collections.Counter()
        for w in some:
            pairs.update(zip(["^", *w], w))
            before.update(["^", *w][: len(w)])
        return pairs, before

    out = []
    every, wanted = count(tokens), count(t for t, on in zip(tokens, target) if on)
    for w, on in zip(tokens, target):
        own = count([w])
        both = []
        for (pairs, before), counted in ((wanted, on), (every, True)):
            p = lambda x: pairs[x] - counted * own[0][x]
            c = lambda x: before[x] - counted * own[1][x]
            total = sum(before.values()) - before["^"] - counted * (sum(own[1].values()) - own[1]["^"]) + 0.5 * (len(vocabulary) + 1)
            both.append(np.mean([-np.log((p((a, b)) + 16 * (c(b) + 0.5) / total) / (c(a) + 16)) for a, b in zip(["^", *w], w)] or [0]))
        out.append((len(w), *both))
    return out


def test_lm_difference(spark):
    rows = corpus(200, 5) + [(900, None, None), (901, " ! ", None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, target string, block string").repartition(3)
    target = [lang == "fr" and i < 100 for i, _, lang in rows]
    got = {r.doc_id: r for r in lm_score.differences(docs, docs.filter("lang = 'fr' and doc_id < 100").select("doc_id")).collect()}
    want = brute_losses([t for _, t, _ in rows], target)
    for (i, _, _), (n, a, b) in zip(rows, want):
        assert got[i].n_tokens == n and abs(got[i].loss_target - a) < 1e-9 and abs(got[i].loss_background - b) < 1e-9 and got[i].score == got[i].loss_target - got[i].loss_background
    new = [(got[i].score, lang) for i, _, lang in rows if 100 <= i < 900]
    assert max(s for s, lang in new if lang == "fr") < min(s for s, lang in new if lang != "fr")
    # a target scores as one of its kind that is none
    seen = np.mean([got[i].score for (i, _, lang), on in zip(rows, target) if on])
    assert abs(seen - np.mean([s for s, lang in new if lang == "fr"])) < 0.3


def test_lm_counts_all_words_and_bigrams(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK", 3000)
    r = random.Random(2)
    texts = [" ".join([f"w{r.randrange(9)}" if r.random() < 0.2 else f"only{r.randrange(100_000)}" for _ in range(1000)]) for _ in range(40)] + ["", None, "a", "a a a A"]
    texts.append(texts[0])
    docs = docs_of(spark, texts, [*range(44), None])  # about 30,000 words and more bigrams
    rows = lm_score.differences(docs, spark.range(20).withColumnRenamed("id", "doc_id")).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 45
    for i, (n, a, b) in zip([*range(44), None], brute_losses(texts, [i < 20 for i in range(45)])):
        assert got[i].n_tokens == n and abs(got[i].loss_target - a) < 1e-9 and abs(got[i].loss_background - b) < 1e-9
    # what stands there twice is known to the background, what stands there once is not
    assert got[0].loss_background < got[1].loss_background - 1
    for targets in (spark.range(0), spark.range(0).selectExpr("cast(null as long) id")):
        assert all(r.score == 0 for r in lm_score.differences(docs, targets.withColumnRenamed("id", "doc_id")).collect())
    assert lm_score.differences(docs.limit(0), docs.select("doc_id")).count() == 0
    twice = docs_of(spark, ["b c", "b c", "x " * 20_000], [7, 7, 8])
    assert sorted(r.n_tokens for r in lm_score.differences(twice, twice.select("doc_id")).collect()) == [2, 2, 20_000]


# --- 8


def test_token_files(spark, tmp_path):
    path = vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = odd_texts(300) + ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3100, 64)] + ["'s x's ''s 'LL a'vel", "<|endoftext|> z", "Z<|startoftext|>z", "x" + "long " * 300_000]
    docs = docs_of(spark, texts, [i * 3 - 20 for i in range(len(texts))])
    manifest = binary.write(docs, path, str(tmp_path / "out"), end_id=2, parts=4)
    rows = sorted(binary.read(spark, manifest, str(tmp_path / "out")).collect())
    start = 0
    for t, r in zip(texts, rows):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, list(np.frombuffer(r.ids, "<u4"))) == (start, len(ids), ids)
        start += len(ids)
    assert [r.doc_id for r in rows] == [i * 3 - 20 for i in range(len(texts))]
    crc = {r.doc_id: r.ids_crc32 for r in binary.read_crc(spark, manifest, str(tmp_path / "out")).collect()}
    assert crc == {r.doc_id: zlib.crc32(r.ids) for r in rows}
    twice = docs_of(spark, ["b", "a", None], [7, 7, None])
    m = binary.write(twice, path, str(tmp_path / "twice"), parts=2)
    assert [(r.doc_id, r.n_tokens) for r in sorted(binary.read(spark, m, str(tmp_path / "twice")).collect(), key=lambda r: r.start)] == [(None, 1), (7, 2), (7, 2)]
    m = binary.write(docs_of(spark, []), path, str(tmp_path / "none"))
    assert binary.read(spark, m, str(tmp_path / "none")).count() == 0


# --- 9


def test_merkle(spark):
    texts = odd_texts(50) + ["One two three. Four five!\nNext line here\n\nNew section with words.", "same", "same"]
    rows = {r.doc_id: r for r in merkle.compare_with_edit(docs_of(spark, texts)).collect()}
    n = len(texts)
    for i, t in enumerate(texts):
        own, following = t or "", texts[i - 1] or ""
        m = len(own) // 3
        edited = own[: len(own) - m] + following[:m]
        assert rows[i].n_chars == len(own) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (rows[i].fingerprint == rows[i].edited_fingerprint) == (edited == own)
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    by_text = {}
    for i, t in enumerate(texts):
        by_text.setdefault(t or "", set()).add(rows[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert rows[n - 1].near_next == 1.0
    assert merkle.compare_with_edit(docs_of(spark, [])).count() == 0
    one = merkle.compare_with_edit(docs_of(spark, ["alone in here"])).first()
    assert one.near_next == 1.0
    long = " ".join(f"word{i}" for i in range(900)) + "."
    a, b = long, long.replace("word880", "other")
    df = spark.createDataFrame([("x\n\n" + a + "\n\nz", "x\n\n" + b + "\n\nz")], "a string, b string").select(merkle.fingerprint("a").alias("a"), merkle.fingerprint("b").alias("b"))
    got = df.select(merkle.likeness("a", "b").alias("n"), merkle.differing("a", "b").alias("d")).first()
    assert 0.97 < got.n < 1 and got.d.sections_a == got.d.sections_b == [2]


def own_fingerprint(text):
    """The tree's hashes and distinct leaves, without Spark but for the 24-bit phrase codes, which are the phrases themselves."""
    sections = [s for s in re.split(r"(?<=\n)(?=[ \t]*\n)", text)]
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    tree = [[md5(p) for p in re.split(r"(?<=\n)", s)] for s in sections]
    heads = [md5(",".join(ps)) for ps in tree]
    phrases = [[re.findall(r"[^\s.!?]+(?:[ \t]+[^\s.!?]+){0,3}[.!?]*|[.!?]+", p) for p in re.split(r"(?<=\n)", s)] for s in sections]
    return hashlib.sha256(";".join(heads).encode()).hexdigest(), [h[:16] for h in heads], [[p[:12] for p in ps] for ps in tree], {x for s in phrases for p in s for x in p}


def test_merkle_equals_own_tree(spark):
    texts = ["", "One two three. Four five!\nNext line here\n\nNew section with words.", "a\n \nb\n\n\nc d e f g h. i", "x", "One two three. Four five!\nOther line\n\nNew section with words."]
    rows = {r.doc_id: r for r in merkle.compare_with_edit(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        root, heads, paragraphs, leaves = own_fingerprint(t)
        code, tree = rows[i].fingerprint.split(":")
        parts = [x.split("{") for x in tree.split("}") if x]
        assert code == root and [x[0] for x in parts] == heads
        assert [[p.split("~")[0] for p in x[1].split("|")] for x in parts] == paragraphs
        _, _, _, after = own_fingerprint(texts[i - 1])
        want = 1.0 if t == texts[i - 1] else 2 * len(leaves & after) / (len(leaves) + len(after)) if leaves or after else 0.0
        assert abs(rows[i].near_next - want) < 1e-9


def test_merkle_locates_edits(spark):
    a, b, c, d = "first one\nmore\n", "\nsecond one\nits end\n", "\nthird\n", "\nfourth one"
    cases = {
        "same": (a + b + c, a + b + c, ([], [], [], [])),
        "deleted": (a + b + c, a + c, ([2], [], [(2, 1), (2, 2), (2, 3), (2, 4)], [])),
        "inserted": (a + c, a + b + c, ([], [2], [], [(2, 1), (2, 2), (2, 3), (2, 4)])),
        "moved": (a + b + c + d, a + c + b + d, ([2, 3], [2, 3], None, None)),
        "changed": (a + b + c + d, a + b.replace("its", "the") + c + d, ([2], [2], [(2, 3)], [(2, 3)])),
        "two": (a + b + c + d, a.replace("more", "less") + b + c.replace("third", "3rd") + d, ([1, 3], [1, 3], [(1, 2), (3, 2)], [(1, 2), (3, 2)])),
        "all": ("x", "y", ([1], [1], [(1, 1)], [(1, 1)])),
    }
    df = spark.createDataFrame([(k, x, y) for k, (x, y, _) in cases.items()], "k string, x string, y string").select("k", merkle.fingerprint("x").alias("x"), merkle.fingerprint("y").alias("y"))
    for r in df.select("k", merkle.differing("x", "y").alias("d")).collect():
        for got, want in zip(r.d, cases[r.k][2]):
            assert want is None or [tuple(g) if isinstance(g, tuple) else g for g in got] == want, (r.k, got)


def test_merkle_is_linear_in_blank_lines(spark):
    lines = "\n" * 50_000
    began = time.monotonic()
    row = merkle.compare_with_edit(docs_of(spark, [lines, lines + "end", "w " * 700_000], [1, 2, 3])).filter("doc_id = 2").first()
    assert row.n_chars == 50_003 and row.differing_sections > 0 and time.monotonic() - began < 60


def test_merkle_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 5)
    monkeypatch.setattr(merkle, "SORTED_ROWS", 20)
    # ids in a clump, far apart, repeated and missing
    ids = [*range(40), *random.Random(1).sample(range(-500, 10**12), 30), 10**15] + [7] * 15 + [None] * 15
    texts = [f"text number {i} of many" for i in range(len(ids))]
    rows = merkle.with_next(common.texts(docs_of(spark, texts, ids)), {}).collect()
    low = lambda x: -(1 << 63) if x is None else x
    hashed = {r.text: r.h for r in docs_of(spark, texts).select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(zip(ids, texts), key=lambda x: (low(x[0]), hashed[x[1]]), reverse=True)
    want = {order[i][1]: order[(i + 1) % len(order)][1] for i in range(len(order))}
    assert {r.text: r.next_text for r in rows} == want and len(rows) == len(ids)


# --- 10


def test_marginals_equal_enumeration():
    r = np.random.default_rng(2)
    for n in (1, 2, 7):
        e, start, moves = r.normal(size=n), r.normal(size=2), r.normal(size=(2, 2))
        weight = {}
        for code in range(1 << n):
            s = [code >> t & 1 for t in range(n)]
            weight[tuple(s)] = np.exp(start[s[0]] + sum(moves[a, b] for a, b in zip(s, s[1:])) + sum(x for x, k in zip(e, s) if k))
        z = sum(weight.values())
        want = [sum(w for s, w in weight.items() if s[t]) / z for t in range(n)]
        first = np.zeros(2 * n, bool)
        first[[0, n]] = True  # the same document twice: the boundary forgets
        p, moved = toxicity.marginals(np.tile(e, 2), first, start, moves)
        assert np.allclose(p, want * 2)
        if n > 1:
            assert np.isclose(moved.sum(), 2 * (n - 1))
    e = r.normal(size=1000)
    first = np.zeros(1000, bool)
    first[[0, 300, 301]] = True
    whole, _ = toxicity.marginals(e, first, start, moves)
    parts = [toxicity.marginals(e[a:b], np.arange(b - a) == 0, start, moves)[0] for a, b in ((0, 300), (300, 301), (301, 1000))]
    assert np.allclose(whole, np.concatenate(parts))


def test_toxicity(spark):
    r = random.Random(8)
    bad = ["idiot", "scum", "vexedly", "vexing"]
    rows, labels = [], []
    for i, t, _ in corpus(600, 9):
        toxic = i % 5 == 0
        w = t.split()
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w) + 1), r.choice(bad))
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    rows += [(900, None, "x"), (901, "", "x"), (902, "fine words. You IDIOT!", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    known = spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known, common.remainder(3) != 1)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i].score >= 0.7) == bool(labels[i][1]) for i in held]) > 0.97
    assert got[900].score == got[901].score < 0.3 and got[900].spans == []
    assert [(s.start, s.end) for s in got[902].spans] == [(16, 21)] and got[902].score >= 0.7
    kept = toxicity.keep(docs, known, common.remainder(3) != 1)
    assert kept.columns == docs.columns and {900, 901} <= {r.doc_id for r in kept.collect()}
    blank = toxicity.fit(docs, known.limit(0), common.remainder(3) != 1)
    assert all(r.score < 0.1 for r in toxicity.score(docs, blank).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


# --- all


def test_odd_tables(spark, sf):
    """Null and repeated ids, null, empty and very long texts, and columns named like the operators' own."""
    long = " ".join(f"w{i % 5000}" for i in range(300_000))
    ids, texts = [None, None, 5, 5, 7, 8, 9, 10], ["twin text here", "twin text here", "", None, long, long + " end", "alone", "The end of the long story is near."]
    names = "gone key word bits target block shard group comp cluster rep raw sig edge node lo hi n c0 copy place tops bucket fine".split()
    docs = spark.createDataFrame([(i, t, "en", *names) for i, t in zip(ids, texts)], ", ".join(["doc_id long", "text string", "lang string", *(f"`{n}` string" for n in names)])).repartition(3)
    none = docs.limit(0)
    items = items_of(spark, ["the end of the long story is near", None])
    path = vocabulary("byte_bpe_50k.tiktoken")
    labels = spark.createDataFrame([(7, 1, 1), (9, 0, 0), (None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    langs = langid.fit(docs, F.lit(True))
    bad = toxicity.fit(docs, labels, F.lit(True))
    whole = {
        "bpe": lambda d: bpe.round_trip(d, path, pattern(), tuple(names)),
        "langid": lambda d: langid.predict(d, langs),
        "ngram": lambda d: ngram_join.classes(d, 3, 90, 100),
        "lm": lambda d: lm_score.differences(d, labels),
        "shards": lambda d: sharding.assign(d, 3),
        "merkle": merkle.compare_with_edit,
        "toxicity": lambda d: toxicity.score(d, bad),
    }
    for name, f in whole.items():
        key = lambda r: (r is not None, r)
        assert sorted([r.doc_id for r in f(docs).select("doc_id").collect()], key=key) == sorted(ids, key=key), name
        assert f(none).count() == 0, name
    joined = {(r.doc_id, r.component_id) for r in ngram_join.classes(docs, 3, 90, 100).collect() if r.doc_id}
    assert joined == {(5, 5), (7, 7), (8, 7), (9, 9), (10, 10)}
    for kept, want in ((ngram_join.keep_one(docs), [5, 5, 7, 9, 10]), (decontaminate.keep(docs, items), [5, 5, 7, 8, 9])):
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == want
        assert kept.filter("doc_id is null").count() == 2
    for keep in (lambda d: langid.keep(d, F.lit(True)), lambda d: toxicity.keep(d, labels, F.lit(True)), ngram_join.keep_one, lambda d: decontaminate.keep(d, items)):
        assert keep(none).columns == docs.columns and keep(none).count() == 0
    tables = {"a": [(None, 1, "user", "x"), (None, None, "assistant", "y"), (1, 2, "user", None), (1, 2, "user", None)]}
    turns = spark.createDataFrame([(*x, "c", "d") for x in tables["a"]], "conv_id long, turn long, role string, text string, part string, ids string")
    back = {r.conv_id: r.n_turns for r in chat.read_back(chat.format_chat(turns, path, pattern(), 50257), path, pattern(), 50257).collect()}
    assert back == {None: 2, 1: 2}


def test_the_bit_map_only_spares_work(spark, monkeypatch):
    monkeypatch.setattr(common, "MAP_ROWS", 4)  # every cell is taken
    docs = docs_of(spark, [str(i) for i in range(900)], [*range(898), None, 7])
    ids = spark.range(0, 900, 3).withColumnRenamed("id", "doc_id")
    out, inside = common.marked(docs, ids)
    assert sorted(r.doc_id for r in inside.collect()) == list(range(0, 898, 3))
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted([i for i in range(898) if i % 3] + [7])
    assert out.filter("doc_id is null").count() == 1 and out.columns == docs.columns


def test_shared_folder_is_asked_for_beyond_local_mode():
    class Far:
        class sparkContext:
            master = "spark://far:7077"
            getCheckpointDir = staticmethod(lambda: None)
            getConf = staticmethod(lambda: {})

        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Far)


# --- pipeline


def test_pipeline_of_an_empty_table(spark, sf):
    import corpus_pipeline

    docs = common.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), sf)
        assert out.count() == 0, name


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = common.table(spark, sf, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialise(stage(spark, docs, sf), "test")
        assert after.columns == docs.columns and after.subtract(docs).isEmpty(), name
        assert after.count() <= docs.count()
        docs = after
    assert 0.5 * before < docs.count() < before
    assert ngram_join.classes(docs, 5, 80, 100).filter("component_id <> doc_id").isEmpty()
    assert decontaminate.find(docs, common.table(spark, sf, "benchmark")).isEmpty()
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("op")])
def test_queries_give_a_row_a_document(spark, sf, name):
    rows = QUERIES[name](spark, sf)
    table = "conversations" if name.startswith("op3") else "documents"
    if name.startswith("op2"):
        assert rows.select("doc_id", "item_id").distinct().count() == rows.count()
    elif name.startswith("op3"):
        assert rows.count() == common.table(spark, sf, table).select("conv_id").distinct().count() + 1
    else:
        assert sorted(r[0] for r in rows.select("doc_id").collect()) == sorted(r[0] for r in common.table(spark, sf, table).select("doc_id").collect())
    assert len(set(rows.columns)) == len(rows.columns)


def test_ngram_join_equals_sql(spark, sf, duck):
    from tidelog.llm.queries import ORACLES

    want = sorted(duck.execute(ORACLES["op6_ngram_join"]).fetchall())
    assert sorted(map(tuple, QUERIES["op6_ngram_join"](spark, sf).collect())) == want


def test_a_worker_forgets_what_another_operator_remembered(spark, monkeypatch):
    docs, made = docs_of(spark, ["one two", None]), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: made.append(run))
    bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"), pattern())
    toxicity.score(docs, toxicity.train([], []))
    langid.predict(docs, langid.train([], []))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two", None])], names=["doc_id", "text"])
    encode, *others = (lambda run=run: [r for b in run([batch]) for r in b.to_pylist()] for run in made)
    for other in others:
        first = encode()
        held = dict(bpe._codecs)
        assert held and encode() == first and all(bpe._codecs[k] is c for k, c in held.items())  # kept from task to task
        assert len(other()) == 2 and not bpe._codecs
        assert encode() == first
