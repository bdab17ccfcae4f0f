"""Trains the tagger of ``pii`` in numpy; run as ``python -m motorloom.llm.pii_train POSTS.parquet``.

Labelled spans come from strict patterns over a bounded sample of posts
(``most_posts``): names are the capitalised words that the sample shows in places
where only a person can stand. The labels are used for training and held-out
accuracy only.
"""

from __future__ import annotations

import collections
import re
import sys
from pathlib import Path

import numpy as np

from motorloom.llm.pii import SYMBOLS, TAGS, TYPES, WEIGHTS, Model, encode, spans, stretches

CAP = r"[А-ЯЁA-Z][а-яёa-z]{2,}"
PERSON_PLACE = re.compile(
    rf"(?i:отвечает|проводит|зовут|собственник|спросить:|call|owner)\s((?:{CAP}\s?){{1,3}})|\d\s?\(((?:{CAP}\s?){{1,3}})\)|\d, ((?:{CAP}\s?){{1,3}})\."
)
EMAIL = re.compile(
    r"[\w+-]+(?:\.[\w+-]+)*\s?(?:@|\(at\)|\[at\]|\sсобака\s)\s?[\w-]+(?:(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\sточка\s)[\w-]+)+", re.I
)
D = "[0-9ОоOoЗз]"
PHONE = re.compile(rf"(?<![\w№/+-])(?:\+?{D}[\s().-]{{0,2}})?(?:\(?{D}{{2,3}}\)?)(?:[\s.-]{{0,2}}{D}){{7,9}}(?!\w)")
NOT_PHONE = re.compile(r"(?i)(?:№|лот|детали|снилс|паспорт|инн|в/у|vin|part|lot|no\.)[\s№:]*$")
ID_NUMBER = re.compile(r"(?i:паспорт|снилс|инн|в/у|удостоверени\w+|passport|licen[cs]e)\s(?:№\s?)?(\d[\d\s№-]*\d)")
HOUSE = r"(?:д\.\s?|дом\s)?\d+[а-яё]?(?:/\d+)?(?:,?\s(?:кв\.?|корпус|корп\.)\s?\d+)*"
STREET = r"(?:ул\.?|улица|пер\.?|переулок|проспект|пр-т|проезд|шоссе|бульвар|набережная)"
ADDRESS = re.compile(
    rf"(?<!\w){STREET}\s?{CAP}(?:\s{CAP})?,?\s{HOUSE}(?!\w)|{CAP}\s(?:ул\.|улица|пер\.|проезд|шоссе),?\s{HOUSE}(?!\w)"
    rf"|(?<![\w#])\d+[a-z]?\s{CAP}\s(?:Street|Lane|Avenue|Road)(?:,\s(?:flat|apt\.?)\s\d+)?",
    re.I,
)
BIG = re.compile(r"^[^a-zа-яё]*$")


def name_words(texts: list[str], least: int = 4) -> set[str]:
    seen: collections.Counter = collections.Counter()
    for t in texts:
        for m in PERSON_PLACE.finditer(t):
            seen.update(re.findall(CAP, m[1] or m[2] or m[3]))
    return {w for w, n in seen.items() if n >= least}


def label(text: str, names: re.Pattern) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        if all(end <= s or start >= e for s, e, _ in out):
            out.append((start, end, kind))

    for m in EMAIL.finditer(text):
        add(*m.span(), "email")
    for m in ID_NUMBER.finditer(text):
        add(*m.span(1), "id_number")
    for m in ADDRESS.finditer(text):
        add(*m.span(), "address")
    for m in PHONE.finditer(text):
        digits = re.findall(D, m[0])
        if 10 <= len(digits) <= 12 and sum(c.isdigit() for c in digits) >= 7 and not NOT_PHONE.search(text[: m.start()]):
            add(*m.span(), "phone")
    for m in names.finditer(text):
        if text[m.start() - 1 : m.start()] != "«":
            add(*m.span(), "name")
    return sorted(out)


def names_pattern(words: set[str]) -> re.Pattern:
    forms = sorted(words | {w.upper() for w in words}, key=len, reverse=True)
    one = "(?:" + "|".join(map(re.escape, forms)) + ")"
    return re.compile(rf"(?<!\w){one}(?:\s{one}){{0,2}}(?!\w)(?:\s[А-ЯЁA-Z]\.(?:\s?[А-ЯЁA-Z]\.)?)?")


def tags_of(text: str, found: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(len(text), np.int64)
    for s, e, kind in found:
        k = TYPES.index(kind)
        out[s:e] = 2 * k + 2
        out[s] = 2 * k + 1
    return out


#: Characters of a stretch that are labelled for training (a bound on the training sample; tagging reads whole stretches).
LABELLED = 260


def examples(texts: list[str], seed: int = 1) -> list[tuple[str, list]]:
    """Distinct labelled stretches, with as many unlabelled ones, some glued or in capitals."""
    rng = np.random.default_rng(seed)
    names = names_pattern(name_words(texts))
    held, plain = {}, {}
    for t in texts:
        for a, b in stretches(t):
            s = t[a:b][:LABELLED]
            key = re.sub(r"\d", "0", s)
            if key in held or key in plain:
                continue
            found = label(s, names)
            (held if found else plain)[key] = (s, found)
    good, rest = list(held.values()), list(plain.values())
    keep = rng.permutation(len(rest))[: int(1.2 * len(good))]
    rows = good + [rest[k] for k in keep]
    for _ in range(len(good) // 3):  # separators are often missing
        a, b = rows[rng.integers(len(rows))], rows[rng.integers(len(rows))]
        text = f"{a[0]} {b[0]}"
        if len(text) < 240:
            rows.append((text, a[1] + [(s + len(a[0]) + 1, e + len(a[0]) + 1, k) for s, e, k in b[1]]))
    for k in rng.permutation(len(rows))[: len(rows) // 12]:
        if len(rows[k][0].upper()) == len(rows[k][0]):
            rows.append((rows[k][0].upper(), rows[k][1]))
    return [rows[k] for k in rng.permutation(len(rows))]


def start_weights(hidden: int, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    K = len(TAGS)
    w = {}
    for way in "fb":
        w["p" + way] = rng.normal(0, 0.3, (SYMBOLS, 4 * hidden))
        w["p" + way][:, hidden : 2 * hidden] += 1.0
        w["u" + way] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
    w["wo"], w["bo"], w["tr"] = rng.normal(0, 0.2, (2 * hidden, K)), np.zeros(K), np.zeros((K, K))
    for k in range(1, len(TYPES) + 1):  # an inside tag follows its own begin or inside only
        w["tr"][[j for j in range(K) if j not in (2 * k - 1, 2 * k)], 2 * k] = -6.0
    return {k: v.astype(np.float32) for k, v in w.items()}


def lstm(x, mask, table, step):
    T, B = x.shape
    H = step.shape[0]
    h, c = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
    keep = []
    hs = np.empty((T, B, H), np.float32)
    for t in range(T):
        g = table[x[t]] + h @ step
        s = 1 / (1 + np.exp(-g[:, : 3 * H]))
        z = np.tanh(g[:, 3 * H :])
        m = mask[t][:, None]
        c1 = s[:, H : 2 * H] * c + s[:, :H] * z
        tc = np.tanh(c1)
        keep.append((h, c, s, z, tc, m))
        h, c = m * (s[:, 2 * H :] * tc) + (1 - m) * h, m * c1 + (1 - m) * c
        hs[t] = h
    return hs, keep


def lstm_back(dhs, x, keep, table, step):
    T, B, H = dhs.shape
    dt, du = np.zeros_like(table), np.zeros_like(step)
    dh, dc = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
    for t in range(T - 1, -1, -1):
        h0, c0, s, z, tc, m = keep[t]
        dh = dh + dhs[t]
        dhm, dcm = dh * m, dc * m
        i, f, o = s[:, :H], s[:, H : 2 * H], s[:, 2 * H :]
        dct = dcm + dhm * o * (1 - tc * tc)
        dg = np.concatenate([dct * z * i * (1 - i), dct * c0 * f * (1 - f), dhm * tc * o * (1 - o), dct * i * (1 - z * z)], 1)
        np.add.at(dt, x[t], dg)
        du += h0.T @ dg
        dh = dh * (1 - m) + dg @ step.T
        dc = dc * (1 - m) + dct * f
    return dt, du


def crf(em, y, mask, tr):
    """Negative log likelihood and gradients."""
    T, B, K = em.shape
    alpha = np.empty((T, B, K), np.float64)
    alpha[0] = em[0]
    etr = np.exp(tr.astype(np.float64))
    for t in range(1, T):
        top = alpha[t - 1].max(1, keepdims=True)
        new = np.log(np.exp(alpha[t - 1] - top) @ etr + 1e-300) + top + em[t]
        m = mask[t][:, None]
        alpha[t] = m * new + (1 - m) * alpha[t - 1]
    top = alpha[-1].max(1, keepdims=True)
    logz = np.log(np.exp(alpha[-1] - top).sum(1)) + top[:, 0]
    beta = np.zeros((B, K))
    dem, dtr = np.zeros((T, B, K)), np.zeros((K, K))
    gold = np.zeros(B)
    for t in range(T - 1, -1, -1):
        m = mask[t][:, None]
        dem[t] = np.exp(alpha[t] + beta - logz[:, None]) * m
        idx = np.arange(B)
        dem[t][idx, y[t]] -= mask[t]
        gold += em[t][idx, y[t]] * mask[t]
        if t:
            v = em[t] + beta
            pair = np.exp(alpha[t - 1][:, :, None] + tr[None] + v[:, None, :] - logz[:, None, None]) * m[:, :, None]
            dtr += pair.sum(0)
            np.add.at(dtr, (y[t - 1], y[t]), -mask[t])
            gold += tr[y[t - 1], y[t]] * mask[t]
            mx = v.max(1, keepdims=True)
            beta = m * (np.log(np.exp(v - mx) @ etr.T + 1e-300) + mx) + (1 - m) * beta
    return float((logz - gold).sum()), dem.astype(np.float32), dtr.astype(np.float32)


def gradients(w, rows):
    B = len(rows)
    T = max(len(c) for c, _ in rows)
    x, y, mask = np.zeros((T, B), np.int64), np.zeros((T, B), np.int64), np.zeros((T, B), np.float32)
    back = np.zeros((T, B), np.int64)
    for j, (c, tags) in enumerate(rows):
        x[: len(c), j], y[: len(c), j], mask[: len(c), j] = c, tags, 1
        back[: len(c), j] = np.arange(len(c))[::-1]
        back[len(c) :, j] = np.arange(len(c), T)
    cols = np.arange(B)[None]
    hf, kf = lstm(x, mask, w["pf"], w["uf"])
    hb, kb = lstm(x[back, cols], mask, w["pb"], w["ub"])
    h = np.concatenate([hf, hb[back, cols]], 2)
    em = h @ w["wo"] + w["bo"]
    loss, dem, dtr = crf(em, y, mask, w["tr"])
    H = hf.shape[2]
    dh = dem @ w["wo"].T
    g = {"wo": np.einsum("tbh,tbk->hk", h, dem), "bo": dem.sum((0, 1)), "tr": dtr}
    g["pf"], g["uf"] = lstm_back(np.ascontiguousarray(dh[:, :, :H]), x, kf, w["pf"], w["uf"])
    g["pb"], g["ub"] = lstm_back(np.ascontiguousarray(dh[:, :, H:][back, cols]), x[back, cols], kb, w["pb"], w["ub"])
    return loss / B, {k: v / B for k, v in g.items()}


def accuracy(w, rows) -> dict[str, tuple[float, float, int]]:
    """Precision, recall and number of true spans by type, on labelled stretches."""
    model = Model(w)
    got = model.tag([t for t, _ in rows])
    hit, out, true = collections.Counter(), collections.Counter(), collections.Counter()
    for (_, gold), mine in zip(rows, got):
        hit.update(k for s, e, k in set(mine) & set(gold))
        out.update(k for *_, k in mine)
        true.update(k for *_, k in gold)
    return {k: (round(hit[k] / max(1, out[k]), 4), round(hit[k] / max(1, true[k]), 4), true[k]) for k in TYPES}


def train(rows, hidden: int = 24, steps: int = 20_000, batch: int = 64, rate: float = 6e-3, log=print):
    """Adam on batches of like lengths for a number of steps; the rate falls to nothing; the same rows give the same weights."""
    rng = np.random.default_rng(3)
    w = start_weights(hidden)
    one, two = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    data = sorted(((encode(t).astype(np.int64), tags_of(t, f)) for t, f in rows if t), key=lambda r: len(r[0]))
    for n in range(1, steps + 1):
        part = (n - 1) / steps
        a = int(rng.integers(0, max(1, len(data) - batch)))
        loss, g = gradients(w, data[a : a + batch])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k, v in g.items():
            v = v * min(1.0, 5.0 / (norm + 1e-9))
            one[k] = 0.9 * one[k] + 0.1 * v
            two[k] = 0.995 * two[k] + 0.005 * v * v
            w[k] = w[k] - (rate * (1 - part) * (one[k] / (1 - 0.9**n)) / (np.sqrt(two[k] / (1 - 0.995**n)) + 1e-8)).astype(np.float32)
        if n % 200 == 0:
            log(n, round(part, 2), round(loss, 3), flush=True)
    return w


def main(path: str, steps: int = 20_000, most_posts: int = 15_000) -> None:
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(path, columns=["content"])["content"].to_pylist()[:most_posts] if t]
    rows = examples(texts)
    cut = len(rows) * 9 // 10
    print(len(rows), "labelled stretches", flush=True)
    w = train(rows[:cut], steps=steps)
    print("held out:", accuracy(w, rows[cut:]))
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in w.items()})


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 20_000)
