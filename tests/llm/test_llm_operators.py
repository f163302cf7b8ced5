"""The ten operators against brute force on small tables with nulls, ties, repeats and long texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverloom.llm import _digests, _tokens, decontaminate, license_scan, lm_scoring, near_dedup, packing, quality_rules, sharding, suffix_dedup, token_counts, token_files
from coverloom.llm._license_texts import TEXTS

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, `Text2` string, n_words string, kept string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"Word{i}," for i in range(400)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    shared, base = text(60), text(160)
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "a b"), (4, "A  b"), (5, text(30)), (6, text(9000)), (7, "x" * 30_000), (8, "<|endoftext|> don't Á ́b"), (9, "# a\n# a\n\n" * 30)]
    out += [(20 + i, base) for i in range(6)] + [(40 + i, f"{text(40)}\n{shared} {text(40)}") for i in range(5)]
    for i in range(12):
        own = base.split(" ")
        for _ in range(i % 6):
            own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
        out.append((60 + i, " ".join(own)))
    out.append((90, f"{base} {base}"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_rules(docs, rows, empty):
    got = {r.doc_id: r for r in quality_rules.repetition_metrics(docs).collect()}
    for i, t in rows:
        w, lines, windows = words(t), set(), defaultdict(list)
        for j in range(len(w) - 7):
            windows[tuple(w[j : j + 8])].append(j)
        covered = {p for at in windows.values() if len(at) > 1 for j in at for p in range(j, j + 8)}
        dup = 0
        for line in (t or "").split("\n"):
            if words(line):
                dup += line in lines
                lines.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.kept and r.base_failed)
    assert got[5].kept and got[6].kept and not got[9].kept and not got[90].kept
    assert quality_rules.repetition_metrics(empty).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def _ids(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(_tokens.tokenizer_path())
    return {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in rows}


def test_token_files(spark, docs, rows, empty, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, path)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, path).collect()}
    start = 0
    for i, ids in sorted(_ids(rows).items()):
        assert got[i].ids == [*ids, 2] and got[i].start == start and got[i].n_tokens == len(ids) + 1
        start += len(ids) + 1
    assert [r.doc_id for r in token_files.read_token_files(spark, path, [40]).collect()] == [40]
    digests = _digests.with_ids_crc32(token_files.read_token_files(spark, path))
    assert {r.ids_crc32 for r in digests.where("doc_id = 1").collect()} == {zlib.crc32(np.array([2], dtype="<u4").tobytes())}
    token_files.write_token_files(empty, f"{path}-none")
    assert token_files.read_token_files(spark, f"{path}-none").count() == 0


def test_packing(docs, rows, empty):
    ids = _ids(rows)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, window=64).collect():
        assert r.ids == [*ids[r.doc_id], 1][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id]) + 1
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for spans, limit in [(s, 64) for s in sequences.values()] + [(pieces[i], len(x) + 1) for i, x in ids.items()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= limit
    assert all(sum(n for _, n in pieces[i]) == len(x) + 1 for i, x in ids.items())
    assert packing.pack(empty).count() == 0


def test_best_fit_decreasing_is_exact():
    rnd = random.Random(1)
    for _ in range(60):
        window = rnd.choice([10, 32, 100])
        lengths = [rnd.randint(1, window) for _ in range(rnd.randint(0, 200))]
        left: list[int] = []
        for x in sorted(lengths, reverse=True):
            best = min((r, k) for k, r in enumerate([*left, window]) if r >= x)[1] if left else 0
            if best == len(left):
                left.append(window)
            left[best] -= x
        used: Counter = Counter()
        for x, low, high, first, _ in packing.best_fit_decreasing(Counter(lengths), window):
            for r in range(low, high):
                used[first + r - low] += x
        assert sorted(window - n for n in used.values()) == sorted(left)


def test_token_counts(docs, rows, empty):
    begin, inner = (set(x) for x in token_counts.word_pieces(token_counts.vocabulary_path()))

    def greedy(w):
        n = at = 0
        while at < len(w):
            known = inner if at else begin
            end = next((e for e in range(min(len(w), at + 80), at, -1) if w[at:e] in known), at)
            if end == at:
                return -1
            n, at = n + 1, end
        return n

    got = {r.doc_id: r for r in token_counts.count_tokens(docs).collect()}
    for i, t in rows:
        if i != 7:
            counts = [greedy(w.encode()) for w in words(t)]
            assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (len(counts), sum(map(abs, counts)), sum(c < 0 for c in counts))
    assert got[7].n_words == 1 and got[7].n_tokens == greedy(b"x" * 30_000)
    assert token_counts.count_tokens(empty).count() == 0


def test_longest_match_with_failures():
    machine = token_counts.LongestMatch([b"a", b"abcdz"], [b"b", b"bcdy", b"bc", b"cdy", b"d", b"z"])
    text = b"abcdz abcdy abcd b abz q"
    ends = np.array([i for i, c in enumerate(text + b" ") if c == 0x20])
    starts = np.concatenate(([0], ends[:-1] + 1))
    assert machine.count(np.frombuffer(text, dtype=np.uint8), starts, ends).tolist() == [1, 2, 3, -1, 3, -1]
    rnd = random.Random(2)
    many = [bytes(rnd.choice(b"abcdyz") for _ in range(rnd.randint(1, 40))) for _ in range(400)] + [b"a" + b"bcdy" * 20]
    ends = np.cumsum([len(w) for w in many])
    data, starts = np.frombuffer(b"".join(many), dtype=np.uint8), np.concatenate(([0], ends[:-1]))
    assert machine._side_by_side(data, starts, ends).tolist() == [machine._alone(np.frombuffer(w, dtype=np.uint8)) for w in many]
    assert machine.count(data, starts, ends)[-1] == 21


def test_token_count_of_a_very_long_word():
    machine = token_counts.automaton(token_counts.vocabulary_path())
    word = np.frombuffer(b"abc" * 1_000_000, dtype=np.uint8)
    began = time.time()
    assert machine.count(word, np.array([0]), np.array([len(word)]))[0] > 500_000
    assert time.time() - began < 20


def test_sharding(spark, docs, rows, empty):
    got = sharding.shard_documents(docs, 4).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    text = dict(rows)
    assert len(got) == len(rows) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(r["size"] == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)
    assert sharding.shard_documents(empty).count() == 0


def _ring(keys, n_shards, room, vnodes, cells):
    """A plain ring: (cell of a key, rank) in home order first, then what overflowed, cell after cell clockwise."""
    points = sorted((int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big") % cells, s) for s in range(n_shards) for v in range(vnodes))
    owner = lambda cell: next((s for c, s in points if c >= cell), points[0][1])
    load, where, late = Counter(), {}, []
    for cell, _, k in sorted(keys):
        s = owner(cell)
        if load[s] < room[s]:
            load[s] += 1
            where[k] = s
        else:
            late.append((cell, k))
    for cell, k in late:
        while load[owner(cell)] >= room[owner(cell)]:
            cell = (cell + 1) % cells
        load[owner(cell)] += 1
        where[k] = owner(cell)
    return where


@pytest.mark.parametrize(("n", "slack"), [(5, 0.0), (5, 0.3), (1, 0.0)])
def test_sharding_is_a_plain_clockwise_ring(spark, n, slack):
    cells = 64
    df = spark.range(700).select(F.col("id").alias("k"), F.lit("x").alias("c"), F.lit("y").alias("Lo"), F.lit(3).alias("slot"))
    keys = [(r.h % 2**64 >> 58, r.h, r.k) for r in df.select("k", F.xxhash64("k").alias("h")).collect()]
    room = [700 // n + (s < 700 % n) if not slack else int(1.3 * 700 / n) + 1 for s in range(n)]
    got = sharding.ring_shards(df, "k", n, slack, vnodes=3, cells=cells)
    assert got.columns == ["k", "c", "Lo", "shard", "slot"]
    assert {r.k: r.shard for r in got.collect()} == _ring(keys, n, room, 3, cells)


def test_sharding_of_one_frequent_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), F.lit(1).alias("size")).repartition(6)
    got = sharding.ring_shards(df, "k", 4, ties=("size",), vnodes=4, cells=64, cell_rows=50).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == 3000 and all(sorted(v) == list(range(750)) for v in by.values())
    assert sorted((r.k for r in got), key=str) == sorted((r.k for r in df.collect()), key=str)


def test_bounded_loads_move_little(spark):
    keys = spark.range(4000).withColumnRenamed("id", "k")
    before, after = ({r.k: r.shard for r in sharding.ring_shards(keys, "k", n, 0.25).collect()} for n in (8, 9))
    assert max(Counter(before.values()).values()) <= 1.25 * 4000 / 8 + 1
    assert sum(before[k] != after[k] for k in before) < 4000 / 3


@pytest.mark.parametrize("deal", [1000, 2])
def test_suffix_dedup(docs, rows, empty, monkeypatch, deal):
    monkeypatch.setattr(suffix_dedup, "SUFFIXES_PER_TASK", deal)
    first, count, own = {}, Counter(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        own[i] = words((t or "").translate(LOW))
        for j in range(len(own[i]) - 49):
            key = tuple(own[i][j : j + 50])
            count[key] += 1
            first.setdefault(key, (i, j))
    want = set()
    for i, w in own.items():
        twice, later = set(), set()
        for j in range(len(w) - 49):
            key = tuple(w[j : j + 50])
            if count[key] > 1:
                twice |= set(range(j, j + 50))
                later |= set(range(j, j + 50)) if first[key] != (i, j) else set()
        for flag, cover in ((False, twice - later), (True, later)):
            want |= {(i, p, flag) for p in cover}
    spans = suffix_dedup.repeated_passages(docs).collect()
    assert {(r.doc_id, p, r.later) for r in spans for p in range(r.start, r.end)} == want
    assert suffix_dedup.repeated_passages(empty).count() == 0


def test_cut_repeats(docs, rows):
    cut = {r.doc_id: r for r in suffix_dedup.cut_repeats(docs).collect()}
    text = dict(rows)
    assert cut[20].text == text[20] and not {21, 22, 23, 24, 25} & set(cut)
    assert cut[40].text == text[40] and 60 < len(words(cut[41].text)) <= 82
    assert cut[0].text is None and cut[1].text == "" and cut[6].text == text[6]


def _components(rows):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_dedup(docs, rows, empty):
    got = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == _components(rows)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_of_rows_alike(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (5, "A b C d e f"), (None, "a b c d e f"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (5, 1, False), (7, 7, True), (None, None, True)]
    assert sorted((r.doc_id for r in near_dedup.keep_one(df).collect()), key=str) == [1, 7, None]


def test_near_dedup_of_equal_ids_with_other_texts(spark):
    rnd = random.Random(8)
    a, b = (" ".join(f"w{rnd.randrange(900)}" for _ in range(80)) for _ in range(2))
    rows = [(1, a), (1, b), (5, a + " word"), (6, b + " word"), (6, b + " word"), (7, a), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1), (1, 1), (5, 1), (6, 1), (6, 1), (7, 1), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in near_dedup.keep_one(df).collect()), key=str) == sorted([(1, a), (1, b), (None, a)], key=str)


def test_near_dedup_of_variants_around_the_threshold(spark):
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(70):
        own = list(base)
        for _ in range(rnd.choice([1, 3, 5, 7, 8])):
            own[rnd.randrange(150)] = f"x{rnd.randrange(6)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    want = _components(rows)
    assert got == want and 1 < len({c for _, c, _ in want.values()}) < 40


def test_posterior_bound():
    assert near_dedup.least_matches(16) < 12 * 0.75 and near_dedup.least_matches(128) > 64


def test_decontamination(spark, docs, rows, empty):
    items = [(1, rows[5][1]), (2, rows[5][1].upper()), (30, "w7é"), (4, None), (5, "--"), (6, "no such words here at all today")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    wins = defaultdict(set)
    for i, t in items:
        w = pattern.findall((t or "").translate(LOW))
        for j in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[j : j + 10])].add(str(i))
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    for i, t in rows:
        w, hit, found = pattern.findall((t or "").translate(LOW)), set(), set()
        for n in {len(k) for k in wins}:
            for j in range(len(w) - n + 1):
                if (key := tuple(w[j : j + n])) in wins:
                    found |= wins[key]
                    hit |= set(range(j, j + n))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert got[5].contaminated
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.contaminated}


def test_decontamination_by_proximity(spark):
    rnd = random.Random(5)
    item = [f"q{i}" for i in range(24)]
    changed = [x if i % 9 != 4 else "other" for i, x in enumerate(item)]
    longer = [y for i, x in enumerate(item) for y in ([x, "added"] if i % 8 == 3 else [x])]
    noise = lambda n: [f"z{rnd.randrange(50)}" for _ in range(n)]
    texts = {1: noise(20) + item + noise(20), 2: noise(31) + changed + noise(9), 3: noise(7) + longer, 4: noise(60), 5: [y for x in item for y in (x, "a", "b")], 6: list(reversed(item)), 7: None, 8: item[:6], 9: noise(80) + ["q3", "q3"]}
    docs = spark.createDataFrame([(i, None if w is None else " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "Solo"), (3, None)], "item_id long, text string")
    found = decontaminate.matches(docs, bench).collect()
    wins = [set(item[s : s + 10]) for s in range(15)]
    near = {(i, s) for i, w in texts.items() for s in range(len(w or [])) for k in wins if w[s] in k and len(k & set(w[s : s + 15])) >= 8}
    got = {(r.doc_id, r.start) for r in found if r.kind == "proximity"}
    assert got <= near and {i for i, _ in got} == {i for i, _ in near} == {1, 2, 3, 6}
    assert {(r.doc_id, r.start, r.end) for r in found if r.kind == "phrase"} == {(1, 20 + s, 30 + s) for s in range(15)}
    assert {r.item_id for r in found} == {1}


def test_lm_scoring(docs, rows, empty):
    got = {r.doc_id: r for r in lm_scoring.score_documents(docs, head=50, states=32).collect()}
    own = {i: words((t or "").translate(LOW)) for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in own}
    c: Counter = Counter()
    for i, w in own.items():
        c.update([] if held[i] else [*w, None])
    n, v = sum(c.values()), len(c)
    states = {w for w in c if w is not None and c[w] * 32 >= n}
    pairs, total = Counter(), Counter()
    for i, w in own.items():
        for h, x in [] if held[i] else zip(["<s>", *w], [*w, None], strict=True):
            if h == "<s>" or h in states:
                total[h] += 1
                pairs[h, x] += x is None or x in states
    pairs = +pairs
    plain = lambda x: (c[x] or v) / (n + v)
    seen, cover = defaultdict(float), defaultdict(float)
    for (h, x), k in pairs.items():
        seen[h] += (k - 0.5) / total[h]
        cover[h] += plain(x)
    for i, w in own.items():
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None])
        score = 0.0
        for h, x in zip(["<s>", *w], [*w, None], strict=True):
            if pairs[h, x]:
                score += math.log10((pairs[h, x] - 0.5) / total[h])
            else:
                score += math.log10(plain(x)) + (math.log10((1 - seen[h]) / (1 - cover[h])) if total[h] else 0)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    assert lm_scoring.score_documents(empty).count() == 0


def test_lm_scoring_gathers_all_pairs(spark, rows):
    rows = [*rows, rows[5], (200, "w7é Word1, never Word2, Word1,"), (211, rows[5][1] + " once w7é once")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    own = [(i, words((t or "").translate(LOW))) for i, t in rows]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in own}
    c, pairs = Counter(), Counter()
    for i, w in own:
        if not held[i]:
            c.update([*w, None])
            pairs.update(zip(["<s>", *w], [*w, None], strict=True))
    n, v = sum(c.values()), len(c)
    plain = lambda x: (c[x] or v) / (n + v)
    total, kinds, cover = Counter(), Counter(), defaultdict(float)
    for (h, x), k in pairs.items():
        total[h] += k
        kinds[h] += 1
        cover[h] += plain(x)
    want = []
    for i, w in own:
        score = 0.0
        for h, x in zip(["<s>", *w], [*w, None], strict=True):
            if pairs[h, x]:
                score += math.log10((pairs[h, x] - 0.5) / total[h])
            else:
                score += math.log10(plain(x)) + (math.log10(0.5 * kinds[h] / total[h] / (1 - cover[h])) if total[h] else 0)
        want.append((i, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), score))
    assert any(held[i] and len(w) > 20 for i, w in own)
    for args in ({}, {"head": 50, "cached": 32, "bucket_tokens": 900, "split": 20}, {"head": 5, "cached": 1, "bucket_tokens": 1 << 20, "split": 1 << 20}):
        got = sorted((r.doc_id, r.n_tokens, r.n_known, r.score) for r in lm_scoring.score_documents(frame, **args).collect())
        assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
        assert [r[3] for r in got] == pytest.approx([r[3] for r in sorted(want)], rel=1e-9)
    assert lm_scoring.score_documents(frame.where("doc_id < 0")).count() == 0


def test_license_scan(spark, empty):
    mit = TEXTS["MIT"]
    rows = [(1, "Copyright (c) 2020 Me\n\n" + mit.upper().replace(" ", "  ")), (2, mit + " extra"), (3, "x\nReleased under the MIT Licence.\ny"), (4, None), (5, TEXTS["ISC"]), (5, TEXTS["ISC"]), (6, "!!")]
    got = sorted((r.doc_id, r.license_id, r.n_notice_lines, r.notices) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "MIT", 0, ""), (2, None, 0, ""), (3, None, 1, "MIT"), (4, None, 0, ""), (5, "ISC", 0, ""), (5, "ISC", 0, ""), (6, None, 0, "")]
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_scan_of_files_as_published(spark):
    import textwrap

    wrap = lambda t, n=70: "\n\n".join(textwrap.fill(p, n) for p in t.split("\n\n"))
    isc = "ISC License\n\nCopyright (c) 2004, 2010 Some Name <a@b.c>\nCopyright [yyyy] [name]\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n" + TEXTS["ISC"].split("copies.", 1)[1]
    bsd = wrap(TEXTS["BSD-2-Clause"]).replace("THE\nCOPYRIGHT HOLDERS", "THE COPYRIGHT HOLDERS").replace("BY THE COPYRIGHT", "BY THE\nCOPYRIGHT")
    mit = "The MIT License (MIT)\n=====================\n\nCopyright © 2001-2020 X. All rights reserved.\n\n" + wrap(TEXTS["MIT"], 60)
    rows = [(1, isc), (2, bsd), (3, mit), (4, "# Unlicense\n\n" + wrap(TEXTS["Unlicense"])), (5, "zlib license\n(C) 1995 A and B\n\n" + wrap(TEXTS["Zlib"]))]
    want = {1: "ISC", 2: "BSD-2-Clause", 3: "MIT", 4: "Unlicense", 5: "Zlib"}
    for i, (file, name) in enumerate((("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")), 10):
        if Path(f"/usr/share/common-licenses/{file}").exists():
            text = Path(f"/usr/share/common-licenses/{file}").read_text()
            rows += [(i, text.upper()), (i + 10, text.split("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS\n"), (i + 20, text + "\nand more")]
            want |= {i: name, i + 10: name if "END OF TERMS" in text else None, i + 20: None}
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.license_id for r in got.collect()} == want


def test_pipeline(spark):
    import corpus_pipeline

    stages = [n for n, _ in corpus_pipeline.STAGES]
    assert stages == ["quality_rules", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.agg(F.count_distinct("doc_id")).first()[0] > 100


def test_packing_meets_its_places_by_shuffle(docs, monkeypatch):
    near = lambda: sorted((r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32) for r in packing.pack(docs, window=64, of_pieces=_digests.with_ids_crc32).collect())
    broadcast = near()
    monkeypatch.setattr(packing, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(packing, "RUN", 7)
    got = packing.pack(docs, window=64, of_pieces=_digests.with_ids_crc32)
    assert near() == broadcast
    spans = defaultdict(list)
    for r in got.collect():
        spans[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in s) == max(o + n for o, n in s) <= 64 for s in spans.values())
