"""Mapping, neighbours, personal data, packing and subjects."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from motorloom.llm import mapping, neighbours, packing, pii, pii_train, subjects

CITIES = ["Паромогорск", "Туманояр", "Чайкоключи"]


@pytest.mark.parametrize(
    "typed,entry",
    [
        ("паромогорск", "Паромогорск"), ("Праомогорск", "Паромогорск"), ("gfhjvjujhcr", "Паромогорск"), ("г. Туманояр", "Туманояр"),
        ("Tumanoyar", "Туманояр"), ("Чaйкoключи", "Чайкоключи"), ("Чайко-ключи", "Чайкоключи"), ("Жепцырешты", "unmatched"),
        ("", "unmatched"), ("  ", "unmatched"), ("?", "unmatched"), ("х" * 5000, "unmatched"), ("Туманояр и ещё четыре слова за ним", "Туманояр"), ("слово " * 20 + "чайкоключи", "Чайкоключи"),
        ("Туманояз и ещё четыре слова за ним", "unmatched"),
    ],
)
def test_resolve(typed, entry):
    ref = mapping.Reference()
    for k, c in enumerate(CITIES):
        ref.add(c.lower(), c, k)
    assert ref.resolve(typed) == entry


def test_map_values_edge_cases(spark):
    lists = spark.createDataFrame([("Alpha", "alpha", 0), ("Alphb", "alphb", 1)], "e string, a string, o int")
    rows = spark.createDataFrame([(1, "Alphb", 1), (2, "Alphc", 1), (2, "Alphc", 1), (3, None, 1), (4, "", 1), (5, "zzz", 1)], "id bigint, v string, e int")
    out = mapping.unlike(mapping.map_values(rows, "id", {"v": (lists, "e", "a", "o")}))
    # a tie goes to the more frequent entry
    assert sorted(map(tuple, out.collect())) == [(2, "v", "Alphb"), (4, "v", "unmatched"), (5, "v", "unmatched")]
    assert mapping.map_values(rows.limit(0), "id", {"v": (lists, "e", "a", "o")}).count() == 0


def test_distance_prefers_swaps_and_neighbours():
    assert mapping.distance("abcd", "abdc", 2) < mapping.distance("abcd", "abc", 2) == 1.0
    assert mapping.distance("test", "tesr", 2) < mapping.distance("test", "tesm", 2)
    assert mapping.distance("abc", "xyz", 2) == float("inf")


def _nearest(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 9)
    out = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-sims[i, j], ids[j]))[:k]
        out[ids[i]] = [ids[j] for j in order]
    return out


def test_neighbours_reach_recall_and_keep_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32) + np.repeat(rng.normal(size=(30, 16)) * 3, 50, 0).astype(np.float32)
    x[100:109] = x[100] * np.arange(1, 10)[:, None]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    extra = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [1.0] * 3, 1), (9004, [float("nan")] * 16, 1), (9005, [None] * 16, 1), (5, x[5].tolist(), 1)]
    got = neighbours.neighbour_lists(spark.createDataFrame(rows + extra, "id bigint, vector array<float>, rank int"), 5).collect()
    mine = {}
    for r in got:
        mine.setdefault(r.id, []).append((r["rank"], r.neighbour))
    mine = {k: [n for _, n in sorted(v)] for k, v in mine.items()}
    true = _nearest(list(range(1500)), x.astype(np.float64), 5)
    assert set(mine) == set(true)
    recall = np.mean([len(set(mine[i]) & set(true[i])) / 5 for i in true])
    assert recall >= 0.93
    assert mine[105] == [100, 101, 102, 103, 104]


def test_visits_follow_the_priority_queue():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 12)) + np.repeat(rng.normal(size=(60, 12)) * 2, 50, 0)
    tree = neighbours.Tree(x, 12)
    for q in x[::500].astype(np.float32):
        queue = neighbours.best_bin_first(tree, q)
        assert sorted(queue) == list(range(tree.leaves))
        seen = tree.visits(q[None], tree.leaves)[0].tolist()
        assert queue[0] == seen[0]
        assert np.mean([len(set(queue[:n]) & set(seen[:n])) / n for n in (5, 20, 80)]) > 0.9


def test_large_leaves_are_split_inside_their_cell():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 8)) + np.repeat(rng.normal(size=(40, 8)) * 3, 50, 0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(2000)
    none = np.zeros(2000, np.int32)
    sims, near = neighbours.search_cell(x, ids, none, x, ids, none, np.arange(2000), 5, split=100)
    true = _nearest(ids.tolist(), x, 5)
    assert np.mean([len(set(n) & set(true[i])) / 5 for i, n in zip(ids.tolist(), near.tolist())]) > 0.97
    assert not (near == ids[:, None]).any() and (np.diff(sims, axis=1) <= 0).all()


def test_neighbours_of_few_and_none(spark):
    schema = "id bigint, vector array<float>"
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], schema)
    assert sorted((r.id, r.neighbour) for r in neighbours.neighbour_lists(two).collect()) == [(1, 2), (2, 1)]
    assert neighbours.neighbour_pairs(spark.createDataFrame([], schema)).count() == 0
    assert neighbours.neighbour_pairs(two.limit(1)).count() == 0


def best_fit(histogram, capacity):
    """Containers of best-fit decreasing, item by item."""
    gaps = []
    for s in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        k = min((k for k, g in enumerate(gaps) if g >= s), key=lambda k: gaps[k], default=None)
        if k is None:
            gaps.append(capacity - s)
        else:
            gaps[k] -= s
    return len(gaps)


def test_plan_packs_all_within_capacity():
    rng = random.Random(0)
    for capacity in (16, 100):
        histogram = {s: rng.randint(0, 50) for s in range(1, capacity + 1)}
        patterns = packing.plan(dict(histogram), capacity)
        used = {}
        for many, p in patterns:
            assert sum(s * n for s, n in p.items()) <= capacity
            for s, n in p.items():
                used[s] = used.get(s, 0) + many * n
        assert used == {s: n for s, n in histogram.items() if n}
        assert sum(m for m, _ in patterns) <= best_fit(histogram, capacity)


def test_pack_is_whole_and_independent_of_partitioning(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 3, 7, 7, 7, 50, 99, 100, 101, 350])) for i in range(600)]
    counts = spark.createDataFrame(rows, "doc_id bigint, tokens bigint")
    one = packing.pack(counts, "c", 100, group=4, salts=3)
    a, b = sorted(map(tuple, one.collect())), sorted(map(tuple, packing.pack(counts.repartition(7), "c", 100, group=4, salts=3).collect()))
    assert a == b
    fill = one.groupBy("container_id").agg(F.sum("tokens").alias("t")).collect()
    assert max(r.t for r in fill) <= 100
    whole = {r.doc_id: (r.t, r.n) for r in one.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    assert whole == {i: (t, max(1, -(-t // 100))) for i, t in rows}
    assert packing.pack(counts.limit(0), "c", 100).count() == 0


def test_token_counts_of_edge_texts(spark):
    path = f"{packing.TOKENIZERS}/{packing.VOCABULARY}"
    if not Path(path).exists():
        pytest.skip("no tokenizer files")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "а б"), (4, "x " * 50_000)], "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in packing.token_counts(docs, path).collect()}
    assert got[1] == got[2] == 0 and got[3] >= 2 and got[4] >= 50_000


def _labelled(n, seed):
    rng = random.Random(seed)
    names, last = ["Фёкла", "Прохор", "Захар", "Лада"], ["Кругляк", "Тетеря", "Ржаник"]
    phone = lambda: f"8-5{rng.randint(10, 99)}-{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(10, 99)}"
    out = []
    for _ in range(n):
        who, tel = f"{rng.choice(names)} {rng.choice(last)}", phone()
        lot = f"Двигатель № {rng.randint(100000, 999999)}, лот {rng.randint(10, 99)}."
        text, parts = rng.choice([(f"Звоните {tel}, {who}.", (("phone", tel), ("name", who))), (lot, ()), (f"По машине отвечает {who}.", (("name", who),))])
        out.append((text, sorted((text.index(p), text.index(p) + len(p), k) for k, p in parts)))
    return out


def test_trained_weights_find_held_out_spans():
    score = pii_train.accuracy(dict(np.load(pii.WEIGHTS)), _labelled(200, 9))
    assert min(score["phone"][:2]) > 0.95 and min(score["name"][:2]) > 0.95


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in pii_train.start_weights(3).items()}
    rows = [(rng.integers(1, 9, n), rng.integers(0, 3, n)) for n in (5, 3)]
    _, g = pii_train.gradients(w, rows)
    for key in ("pf", "ub", "wo", "tr"):
        at = np.unravel_index(np.abs(g[key]).argmax(), g[key].shape)
        up, down = ({**w, key: w[key].copy()} for _ in range(2))
        up[key][at] += 1e-2
        down[key][at] -= 1e-2
        slope = (pii_train.gradients(up, rows)[0] - pii_train.gradients(down, rows)[0]) / 2e-2
        assert abs(slope - g[key][at]) < 0.03 * max(1, abs(slope))


def test_viterbi_equals_brute_force():
    import itertools

    model = pii.Model({**pii_train.start_weights(2), "tr": np.random.default_rng(1).normal(size=(11, 11))})
    scores = np.random.default_rng(2).normal(size=(4, 11)).astype(np.float32)
    legal = [p for p in itertools.product(range(11), repeat=4) if p[0] == 0 or p[0] % 2]
    value = lambda p: sum(scores[t, k] for t, k in enumerate(p)) + sum(model.moves[a, b] for a, b in zip(p, p[1:]))
    assert tuple(model.best_path(scores)) == max(legal, key=value)


def test_posts_with_edge_texts(spark):
    text = "Продам пикап. Звоните 8-532-431-35-72, Захар Кругляк. Почта rzhanik-cars@garage.test для вопросов."
    rows = [(1, text, 0), (2, None, 0), (3, "", 0), (4, text + " слово" * 20_000, 0), (1, text, 0)]
    out = pii.tag_posts(spark.createDataFrame(rows, "id bigint, content string, finds int"))
    got = {(r.raw_id, r.pii_type, r.found_text) for r in pii.found(out).collect()}
    want = {("phone", "8-532-431-35-72"), ("name", "Захар Кругляк"), ("email", "rzhanik-cars@garage.test")}
    assert got == {(i, *w) for i in (1, 4) for w in want}
    clean = {r.raw_id: r.clean_text for r in out.collect()}
    assert clean[1] == "Продам пикап. Звоните [PHONE], [NAME]. Почта [EMAIL] для вопросов." and clean[2] is None and clean[3] == ""
    assert pii.tag_posts(out.selectExpr("raw_id AS id", "clean_text AS content").limit(0)).count() == 0


def test_long_stretch_uses_overlapping_windows():
    model = pii.Model.load()
    text = "слово " * 60 + "Звоните 8-532-431-35-72, Захар Кругляк"
    assert len(text) > pii.WINDOW
    found = {text[s:e] for s, e, _ in model.tag([text])[0]}
    assert "8-532-431-35-72" in found


def _read_alone(w, code):
    """Tag scores of one sequence, character by character."""
    x, on = code.astype(np.int64)[:, None], np.ones((len(code), 1), np.float32)
    f, _ = pii_train.lstm(x, on, w["pf"], w["uf"])
    b, _ = pii_train.lstm(x[::-1], on, w["pb"], w["ub"])
    return (np.concatenate([f, b[::-1]], 2) @ w["wo"] + w["bo"])[:, 0]


def test_shared_beginnings_are_read_once_and_most_stretches_are_proved_plain(monkeypatch):
    w = {k: v.astype(np.float32) for k, v in np.load(pii.WEIGHTS).items()}
    model, read = pii.Model(w), []
    step = model.step
    monkeypatch.setattr(model, "step", lambda way, h, c, codes: read.append(len(codes)) or step(way, h, c, codes))
    decided, paths = [], model.best_paths
    monkeypatch.setattr(model, "best_paths", lambda scores, lengths: decided.extend(lengths) or paths(scores, lengths))
    texts = [f"Продам машину в хорошем состоянии, {a} {b}, торг уместен." for a in ("цвет белый", "салон серый", "мотор тихий") for b in "абвгд"]
    texts += ["Звоните 8-532-431-35-72, Захар Кругляк.", "Звоните 8-532-431-35-72", "З", "З", ""]
    got, once = model.tag(texts), sum(read)
    codes = [pii.encode(t).tobytes() for t in texts]
    beginnings, ends = ({c[s] for c in codes for k in range(len(c)) for s in [cut(k)]} for cut in (lambda k: slice(0, k + 1), lambda k: slice(k, None)))
    assert once == len(beginnings) + len(ends) < 1.2 * sum(map(len, texts))  # 2 for each character if each were read alone
    assert 2 <= len(decided) <= 4
    want = [pii.spans(model.best_path(_read_alone(w, pii.encode(t)))) if t else [] for t in texts]
    assert got == want and sum(map(bool, want)) == 2
    read.clear()
    monkeypatch.setattr(pii, "NODES", 40)
    assert model.tag(texts) == got and sum(read) > 0  # in small parts
    monkeypatch.setattr(pii, "PADDED", 100)
    assert model.tag(texts) == got


def test_plain_is_never_wrong():
    rng = np.random.default_rng(5)
    model, proved = pii.Model({**pii_train.start_weights(2), "tr": rng.normal(size=(11, 11))}), 0
    for _ in range(40):
        lengths = np.sort(rng.integers(1, 9, 50))
        scores = rng.normal(size=(lengths.max(), 50, 11)).astype(np.float32) * 2
        scores[:, :, 0] += 4
        over = scores[:, :, 1:] - scores[:, :, :1]
        plain = model.plain(over[:, :, ::2].max(2), over[:, :, 1::2].max(2), lengths)
        paths = model.best_paths(scores, lengths)
        assert not any(paths[:n, j].any() for j, n in enumerate(lengths) if plain[j])
        proved += plain.sum()
    assert 100 < proved < 2000


def test_posts_read_together_are_bounded(monkeypatch):
    monkeypatch.setattr(pii, "POSTS", 3)
    monkeypatch.setattr(pii, "CHARACTERS", 10)
    assert pii.together([1, None, 2, 3, 50, 4, 6, 1]) == [(0, 3), (3, 4), (4, 5), (5, 7), (7, 8)]
    assert pii.together([]) == []
    texts = ["Звоните 8-532-431-35-72. Спасибо.\nТорг", None, "", "Захар Кругляк отвечает.\n\nЗвоните 8-532-431-35-73"]
    whole = pii.Tagger(pii.Model.load()).finds(texts)
    monkeypatch.setattr(pii, "STRETCHES", 2)
    assert pii.Tagger(pii.Model.load()).finds(texts) == whole and whole[0] and whole[3]


def test_stretches_end_at_lines_separators_and_sentences():
    parts = lambda t: [t[a:b] for a, b in pii.stretches(t)]
    assert parts("Торг. Обмен!  Да\n\n \nнет | цена • 5") == ["Торг.", "Обмен!", "Да", " ", "нет", "цена", "5"]
    assert parts("ул. Мира, д. Б. Тел. А. Б. Иванов. Звоните") == ["ул. Мира, д. Б. Тел. А. Б. Иванов.", "Звоните"]
    assert parts("\n\n") == [] and parts(" а") == [" а"] and parts("а. ") == ["а. "]


TOPICS = {"law": "суд иск статья протокол закон", "sport": "гонка финиш кубок пилот трасса", "travel": "маршрут палатка перевал костёр озеро"}
SLANG = {"law": "повестка адвокат", "sport": "болид подиум", "travel": "рюкзак тропа"}


def _doc(rng, subject, n=6):
    formal = lambda: " ".join(rng.choices(TOPICS[subject].split(), k=5)).capitalize() + "."
    slang = lambda: " ".join(rng.choices(SLANG[subject].split(), k=4)).capitalize() + "."
    return " ".join(formal() if k % 2 else slang() for k in range(n)) + " Спасибо всем читателям пока."


def test_subjects_learn_wordings_from_company(spark):
    rng = random.Random(1)
    truth = [rng.choice(list(TOPICS)) for _ in range(240)]
    docs = [(i, _doc(rng, t), "x") for i, t in enumerate(truth)]
    docs += [(900, " ".join(["Повестка адвокат адвокат повестка."] * 3), "x"), (901, None, "x"), (902, "", "x"), (903, "123 456.", "x"), (904, "Спасибо всем читателям пока. " * 5, "x")]
    examples = spark.createDataFrame([(" ".join(rng.choices(w.split(), k=8)), t) for t, w in TOPICS.items() for _ in range(10)], "text string, subject string")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    got = {}
    for r in subjects.assign(frame, examples, sorted(TOPICS)).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert np.mean([got.get(i) == {t} for i, t in enumerate(truth)]) > 0.95
    assert got.get(900) == {"law"} and not {901, 902, 903, 904} & set(got)
    assert subjects.assign(frame.limit(0), examples, sorted(TOPICS)).count() == 0
    assert subjects.assign(frame, examples.limit(0), sorted(TOPICS)).count() == 0
