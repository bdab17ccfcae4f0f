"""Near-duplicates, incremental dedup and leaks against brute force, with edge cases."""

import itertools
import random
import re

import pytest

from motorloom.llm import at_once, incremental, leakage, near_dup

W = re.compile(r"[^\W_]+")


def grams(t, n=3):
    w = W.findall((t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def alike(a, b, n=3, least=0.5):
    return bool(a) and bool(b) and len(a & b) >= least * len(a | b)


def texts(seed=0, n=160):
    rng = random.Random(seed)
    words = [f"слово{i}" for i in range(60)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5 and (base := rng.choice(out)):
            t = base.split()
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
        else:
            out.append(" ".join(rng.choices(words, k=rng.randint(1, 40))))
    out += [None, "", "  ", "одно", "два слова", "repeat me three times"] + ["repeat me three times"] * 5
    return out + [" ".join(rng.choices(words, k=6000)), out[0].upper() if out[0] else "x"]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(rows)], "grp string, id bigint, text string")
    return df.selectExpr("*", "1 AS cls", "2 AS n") if extra else df


@pytest.mark.parametrize("n,least", [(3, 0.5), (5, 0.8)])
def test_pairs_equal_brute_force(spark, n, least):
    rows = texts()
    sets = [grams(t, n) for t in rows]
    true = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if alike(sets[i], sets[j], n, least)}
    members, links = near_dup.similar_classes(frame(spark, rows), n, least)
    got = {(r.id_a, r.id_b) for r in near_dup.pairs_of_rows(members, links).collect()}
    assert got == true and len(true) > 30


def test_twins_and_large_classes(spark):
    rows = ["one two three four five six"] * 9 + ["one two three four five seven", None]
    df = frame(spark, rows)
    members, links = near_dup.similar_classes(df, 3, 0.5, df.selectExpr("'b' AS grp", "id", "text"))
    all_ = {(r.grp, r.id_a, r.id_b) for r in near_dup.pairs_of_rows(members, links).collect()}
    assert all_ == {(g, i, j) for g in "ab" for i, j in itertools.combinations(range(10), 2)}
    star = {(r.id_a, r.id_b) for r in near_dup.pairs_of_rows(members, links, expand_limit=4).filter("grp = 'a'").collect()}
    assert star == {(0, i) for i in range(1, 10)}
    shown = {(r.grp, r.id): r.expanded for r in near_dup.class_report(members, links, expand_limit=8).collect()}
    assert not shown["a", 0] and shown["a", 9] and shown["a", 10]
    report = {r.id: (r.cls, r.links) for r in near_dup.class_report(members, links).filter("grp = 'a'").collect()}
    assert len(report) == 11 and report[0] == report[8] and report[10] == (None, 0) and report[9][1] == 1


def test_empty_tables(spark):
    none = frame(spark, [])
    members, links = near_dup.similar_classes(none, 3, 0.5)
    assert near_dup.pairs_of_rows(members, links).count() == 0
    posts = spark.createDataFrame([], "id bigint, batch_no int, source_url string, content string")
    assert incremental.dedupe_batches(posts).count() == 0


def greedy(rows, key):
    kept, pages, out = [], {}, set()
    for i, (url, t) in enumerate(rows):
        g, p = grams(t), key(url)
        m = [j for j, h in kept if alike(g, h)] + ([pages[p]] if p in pages else [])
        if m:
            out.add((min(m), i))
        else:
            kept.append((i, g))
            if p:
                pages[p] = i
    return out


def simple_key(url):
    return re.sub(r"[?&]utm_\w+=\w+|/$|^https?://", "", url or "").lower() if url and "." in url else None


@pytest.mark.parametrize("walk,batches", [(incremental.WALK, 6), (incremental.WALK, 1), (0, 3)])
def test_batches_equal_the_sequential_walk(spark, walk, batches):
    rng = random.Random(4)
    urls = [None, "", "n/a", "https://"] + [f"{s}Host.example/p{k}{e}" for k in range(40) for s in ("http://", "https://", "") for e in ("", "/", "?utm_source=x")]
    rows = [(rng.choice(urls).replace("Host", rng.choice(["Host", "host"])) if rng.random() < 0.5 else None, t) for t in texts(3) if True]
    rows = [(u if u else None, t) for u, t in rows]
    data = [(i, i * batches // len(rows), u, t, 0) for i, (u, t) in enumerate(rows)]
    posts = spark.createDataFrame(data, "id bigint, batch_no int, source_url string, content string, kept int")
    got = {(r.kept_id, r.id) for r in incremental.dedupe_batches(posts, walk).collect()}
    assert got == greedy(rows, simple_key)


def test_history_is_opened_again(spark, tmp_path):
    schema = "id bigint, source_url string, content string"
    words = " ".join(f"w{i}" for i in range(30))
    first = [(1, "http://a.example/1", words), (2, None, "one two three\nfour five six"), (3, "b.example/x?ref=1", None), (None, None, words)]
    folder = f"file://{tmp_path}/history"
    assert {r.id: r.kept_id for r in incremental.admit(spark.createDataFrame(first, schema), incremental.History(spark, folder, 2)).collect()} == dict.fromkeys((1, 2, 3))
    other = spark.newSession()  # knows the folder only
    for t in other.catalog.listTables():
        if t.name.startswith("accepted_"):
            other.sql(f"DROP TABLE {t.name}")
    again = incremental.History(other, folder)
    assert (again.buckets, again.posts) == (2, 2)
    second = [(4, "https://A.example/1/", "x"), (5, None, words.replace("w15", "v15")), (6, None, "one two three\nseven"), (7, "https://b.example/x", "ONE two, three! four five six")]
    got = {r.id: (r.kept_id, r.coverage) for r in incremental.admit(other.createDataFrame(second, schema), again).collect()}
    assert got == {4: (1, 0.0), 5: (1, 0.0), 6: (None, 0.75), 7: (2, 0.0)}
    again.drop()


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    items = {k: rng.choices(words, k=rng.randint(5, 40)) for k in range(25)}
    docs, true = [], set()
    for d in range(150):
        body = rng.choices(words, k=rng.randint(0, 60))
        if d % 2:
            k = rng.randrange(25)
            a = rng.randrange(max(1, len(items[k]) - 12))
            part = items[k][a : a + rng.randint(10, 16)]
            for _ in range(rng.randint(0, 2)):
                part[rng.randrange(len(part))] = "other"
            at = rng.randrange(len(body) + 1)
            body[at:at] = part
        docs.append(body)
        for k, item in items.items():
            if any(sum(x != y for x, y in zip(body[i : i + 12], item[j : j + 12])) <= 1 for i in range(len(body) - 11) for j in range(len(item) - 11)):
                true.add((d, k))
    corpus = [(d, ", ".join(b).upper(), 1) for d, b in enumerate(docs)] + [(900, None, 1), (901, "", 1)]
    held = [(k, "\n".join(w)) for k, w in items.items()] + [(77, None)]
    c = spark.createDataFrame(corpus, "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(held, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaked(c, i).collect()} == true and len(true) > 20
    assert {(r.doc_id, r.item_id) for r in leakage.leaked(c, i, block=6).collect()} == true
    assert leakage.leaked(c.limit(0), i).count() == 0 and leakage.leaked(c, i.limit(0)).count() == 0


def test_leak_folds_look_alikes():
    assert leakage.fold("Ёлка Соvа") == leakage.fold("елка cова".replace("в", "v"))


@pytest.mark.parametrize("together", [1, 60, incremental.TOGETHER])
def test_batches_in_runs_equal_the_sequential_walk(spark, monkeypatch, together):
    rows = [(None if i % 5 else f"host.example/p{i % 30}", t) for i, t in enumerate(texts(7))]
    data = [(i, None if i < 20 else i // 20, u, t) for i, (u, t) in enumerate(rows)]
    posts = spark.createDataFrame(data, "id bigint, batch_no int, source_url string, content string")
    times, admit = [], incremental.admit
    monkeypatch.setattr(incremental, "admit", lambda *a: times.append(1) or admit(*a))
    got = {(r.kept_id, r.id) for r in incremental.dedupe_batches(posts, together=together).collect()}
    assert got == greedy(rows, simple_key)
    assert len(times) == {1: 9, 60: 3}.get(together, 1)  # small batches don't cost a round of jobs each


def test_runs_of_batches_keep_order_and_size():
    batch = lambda k, n, low, high: {"batch_no": k, "n": n, "low": low, "high": high}
    batches = [batch(None, 2, 1, 2), batch(0, 3, 3, 5), batch(1, 9, 6, 14), batch(2, 1, None, None), batch(3, 1, 4, 4), batch(4, 1, 15, 15)]
    assert [[b["batch_no"] for b in run] for run in incremental.runs(batches, 5)] == [[None, 0], [1], [2, 3, 4]]
    assert [[b["batch_no"] for b in run] for run in incremental.runs(batches, 99)] == [[None, 0, 1, 2], [3, 4]]


@pytest.mark.parametrize("contested", [at_once.CONTESTED, 0])
def test_all_batches_at_once_equal_the_sequential_walk(spark, monkeypatch, contested):
    monkeypatch.setattr(at_once, "MEETINGS", 50)  # pairs are made in many blocks
    monkeypatch.setattr(incremental, "admit", None)  # no history is made
    rows = [(None if i % 5 else f"host.example/p{i % 30}", t) for i, t in enumerate(texts(7))]
    data = [(i, None if i < 20 else i // 20, u, t) for i, (u, t) in enumerate(rows)]
    posts = spark.createDataFrame([*data, (None, 3, "host.example/p1", rows[0][1])], "id bigint, batch_no int, source_url string, content string")
    monkeypatch.setattr(at_once.dedupe, "__defaults__", (contested,))
    assert {(r.kept_id, r.id) for r in at_once.dedupe_batches(posts).collect()} == greedy(rows, simple_key)
    assert at_once.dedupe_batches(posts.limit(0)).count() == 0


def test_batches_whose_ids_fall_are_admitted_in_order(spark):
    same = "one two three four five"
    posts = spark.createDataFrame([(9, 1, None, same), (3, 2, None, same)], "id bigint, batch_no int, source_url string, content string")
    assert [tuple(r) for r in at_once.dedupe_batches(posts).collect()] == [tuple(r) for r in incremental.dedupe_batches(posts).collect()]


def test_blocks_hold_their_columns():
    import numpy as np

    a, b = np.array([1, 2**40 - 1, 7]), np.array([-5, 2**62, 0])
    assert [x.tolist() for x in at_once.unpack([at_once.pack((a, 5), (b, 8))] * 2, 5, 8)] == [a.tolist() * 2, b.tolist() * 2]
