"""The pipeline against plain Python on a small corpus, and its stages on empty and odd tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from coverloom.llm import _tokens

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LIMITS = {5: 0.15, 6: 0.14, 8: 0.12, 10: 0.10}


def good(text):
    w = WORD.findall(text or "")
    chars = max(sum(map(len, w)), 1)
    windows, covered = defaultdict(list), set()
    for j in range(len(w) - 7):
        windows[tuple(w[j : j + 8])].append(j)
    for at in windows.values():
        if len(at) > 1:
            covered |= {p for j in at for p in range(j, j + 8)}
    if len(w) < 20 or 100 * len(covered) > 30 * len(w):
        return False
    for n, limit in LIMITS.items():
        seen, later = set(), set()
        for j in range(len(w) - n + 1):
            if (g := tuple(w[j : j + n])) in seen:
                later |= set(range(j, j + n))
            seen.add(g)
        if sum(len(w[p]) for p in later) / chars > limit:
            return False
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), []
    for x in lines:
        dup += [x] if x in seen else []
        seen.add(x)
    return len(dup) / max(len(lines), 1) <= 0.30 and sum(len(w) for x in dup for w in WORD.findall(x)) / chars <= 0.20


def one_of_each(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t.translate(LOW))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(i, t) for i, t in rows if find(i) == i]


def without_repeats(rows):
    first, out = {}, []
    for i, t in sorted(rows):
        w = WORD.findall(t.translate(LOW))
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), (i, j))
    for i, t in rows:
        w, spans = WORD.findall(t.translate(LOW)), [m.span() for m in WORD.finditer(t)]
        later = {p for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] != (i, j) for p in range(j, j + 50)}
        kept, place = "", 0
        for p in range(len(w)):
            if p in later:
                kept += t[place : spans[p][0]]
                place = spans[p + 1][0] if p + 1 < len(w) else len(t)
        kept += t[place:]
        if not later or WORD.search(kept):
            out.append((i, kept))
    return out


def clean(rows, items):
    windows = set()
    for t in items:
        w = BENCH_WORD.findall(t.translate(LOW))
        windows |= {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(x) for x in windows}
    held = lambda w: any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1))
    return [(i, t) for i, t in rows if not held(BENCH_WORD.findall(t.translate(LOW)))]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    text = lambda n: " ".join(rnd.choice(["Alpha", "b", "délta", "gamma,", "mu"]) + str(rnd.randrange(400)) for _ in range(n))
    passage, base = text(70), text(120)
    items = [text(30), "Short item here", None]
    rows = [(i, text(rnd.randint(20, 300))) for i in range(20)] + [(100, None), (101, ""), (102, text(5)), (103, "same words again and again today\n" * 30), (104, text(5000))]
    rows += [(200 + i, base) for i in range(3)] + [(210 + i, base.replace("mu", "nu", i)) for i in range(4)]
    rows += [(300 + i, f"{text(60)}\n{passage} \t{text(60)}") for i in range(3)] + [(310, passage)]
    rows += [(400, f"{text(40)} {items[0].upper()} {text(20)}"), (401, f"{text(40)} short ITEM, here. {text(20)}")]
    folder = tmp_path_factory.mktemp("sf")
    slim = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], slim).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, [t for t in items if t]


def test_pipeline_is_plain_python(spark, corpus):
    folder, rows, items = corpus
    stages = [[(i, t) for i, t in rows if good(t)]]
    stages.append(one_of_each(stages[-1]))
    stages.append(without_repeats(stages[-1]))
    stages.append(clean(stages[-1], items))
    assert [len(rows) > len(stages[0]), len(stages[0]) > len(stages[1]), len(stages[2]) > len(stages[3])] == [True] * 3 and stages[1] != stages[2]
    docs = spark.read.parquet(f"file://{folder}/documents.parquet")
    for (_, stage), want in zip(corpus_pipeline.STAGES, stages, strict=False):
        out = stage(spark, docs, f"file://{folder}")
        assert out.columns == docs.columns
        got = out.collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted(want) and all(r.n_chars == len(r.text) for r in got)
        docs = spark.createDataFrame(got, docs.schema)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(_tokens.tokenizer_path())
    pieces, room = [], Counter()
    for i, t in stages[-1]:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            pieces.append((i, s, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), len(ids)))
    left: list[int] = []
    for n in sorted((p[2] for p in pieces), reverse=True):
        best = min((r, k) for k, r in enumerate([*left, 2048]) if r >= n)[1]
        if best == len(left):
            left.append(2048)
        left[best] -= n
    got = corpus_pipeline.run(spark, f"file://{folder}").collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(pieces)
    for r in got:
        room[r.sequence_id] += r.length
    assert sorted(2048 - n for n in room.values()) == sorted(left)


def test_stages_of_odd_tables(spark, corpus):
    folder = f"file://{corpus[0]}"
    schema = "doc_id long, text string, gone_doc long, cut_spans string, bad_doc string, key string, extra string"
    long_text = " ".join(f"w{i}" for i in range(40_000))
    rows = [(None, None, 1, "a", "b", "c", "d"), (1, None, 1, "a", "b", "c", "d"), (1, "", 1, "a", "b", "c", "d"), (2, long_text, 2, "a", "b", "c", "d"), (2, long_text, 2, "a", "b", "c", "d"), (2, long_text + " x", 3, "a", "b", "c", "d")]
    odd = spark.createDataFrame(rows, schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, odd.limit(0), folder).count() == 0
        out = stage(spark, odd, folder)
        assert k == 4 or out.columns == odd.columns
        assert [out.count() for _ in range(1)] == [[3, 4, 4, 6, out.count()][k]]
    assert corpus_pipeline.STAGES[1][1](spark, odd, folder).where("text is not null").count() == 2
