"""Personal information in free text: found and replaced by typed placeholders.

Method: a character-level bidirectional LSTM gives tag scores for every character, a
linear-chain CRF the best sequence of tags. Texts are cut at line and sentence ends;
longer stretches are read in overlapping windows whose scores are averaged before
one decoding over the whole stretch. The weights are trained by ``pii_train`` (numpy
only) from labelled spans and lie beside this module.

Digits look alike to the model, so stretches that differ in digits only are scored
once per task (a bounded cache), and a beginning (for the way back, an end) that
several stretches share is read once for all of them: the state after it is the same.
A stretch whose scores prove that no path through any tag but "outside" can win is
not decoded further. None of this changes a result.

A form check follows the decoding: spans are trimmed to their first and last letter
or digit (a name keeps the dot of a last initial), and a span that cannot be of its
type (a phone with fewer than nine digits, an address without a house number) is
dropped.

Defined results: null and empty texts have no finds and stay as they are; repeated
rows give repeated finds; one text may have a find twice; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "id_number", "address", "name")
TAGS = ["O"] + [f"{p}-{t}" for t in TYPES for p in "BI"]
WINDOW, OVERLAP = 200, 60
_CACHE_LIMIT = 150_000
#: Stretches of similar length that are decided together, and states that read a character together.
BLOCK, STEP = 1024, 1024
#: Posts, characters and stretches that are read together (one post at least), and what is held of them at once: read places, padded codes.
POSTS, CHARACTERS, STRETCHES, NODES, PADDED = 10_000, 10_000_000, 200_000, 2_000_000, 1 << 25
WEIGHTS = Path(__file__).with_name("pii_weights.npz")

_LOWER, _RU = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
ALPHABET = "0" + _LOWER + _LOWER.upper() + _RU + _RU.upper() + " \n.,;:!?-+()/@«»\"'№#[]_=&|•—"
_SYMBOL = {c: k + 2 for k, c in enumerate(ALPHABET)}
SYMBOLS = len(ALPHABET) + 2  # 0 is padding, 1 any other character
_CODES = np.ones(0x10000, np.uint8)
for _c, _k in _SYMBOL.items():
    _CODES[ord(_c)] = _k
for _c in range(0x10000):
    if chr(_c).isdigit():
        _CODES[_c] = _SYMBOL["0"]
    elif chr(_c).isspace() and chr(_c) != "\n":
        _CODES[_c] = _SYMBOL[" "]

#: A stretch ends at a line end, a separator, or a sentence end that is no abbreviation. Every cut begins with a space, so nothing else is looked at.
CUT = re.compile(
    r"\s(?:(?<=\n)\n*|[|•]\s|(?<=[а-яёa-z0-9)»%А-ЯЁ][.!?]\s)(?<!\bул\.\s)(?<!\bпер\.\s)(?<!\bпр\.\s)(?<!\bнаб\.\s)(?<!\bд\.\s)(?<!\bкв\.\s)"
    r"(?<!\bг\.\s)(?<!\bш\.\s)(?<!\bбул\.\s)(?<!\bкорп\.\s)(?<!\bстр\.\s)(?<!(?i:\bтел)\.\s)(?<!\s[А-ЯЁA-Z]\.\s)\s*(?=[A-ZА-ЯЁ•|—]))"
)


def stretches(text: str) -> list[tuple[int, int]]:
    """Start and end of every stretch that is read as one."""
    out, at = [], 0
    for m in CUT.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _CODES[np.minimum(points, 0xFFFF)]


class Shared:
    """Sequences in order of their codes: each is read on from where it leaves the one before it.

    ``rows``: codes (sequence, place) padded by zeros. ``common``: places that a sequence
    shares with the one before; ``nodes``: places that are left to be read.
    """

    def __init__(self, rows: np.ndarray, lengths: np.ndarray):
        self.order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
        rows, self.lengths = rows[self.order], lengths[self.order]
        unlike = rows[1:] != rows[:-1]
        first = unlike.argmax(1)
        self.common = np.zeros(len(rows), np.int64)
        self.common[1:] = np.where(unlike[np.arange(len(first)), first], first, self.lengths[1:])
        self.nodes = int((self.lengths - self.common).sum())
        self.codes = np.ascontiguousarray(rows.T)


class Model:
    """BiLSTM with input tables instead of embeddings, and CRF transitions."""

    def __init__(self, weights: dict[str, np.ndarray]):
        w = {k: np.asarray(v, np.float32) for k, v in weights.items()}
        self.hidden = w["uf"].shape[0]
        sign = np.full(4 * self.hidden, -1, np.float32)
        sign[3 * self.hidden :] = -2  # all four gates by one exponential: 1 / (1 + e^-x), and tanh x = 2 / (1 + e^-2x) - 1
        self.tables = [w["pf"] * sign, w["pb"] * sign]
        self.steps = [w["uf"] * sign, w["ub"] * sign]
        self.out, self.bias, self.moves = w["wo"], w["bo"], w["tr"]
        self.buffers = [np.empty((STEP, k), np.float32) for k in (4 * self.hidden, 4 * self.hidden, self.hidden)]

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> Model:
        with np.load(path) as held:
            return cls(dict(held))

    def step(self, way: int, h: np.ndarray, c: np.ndarray, codes: np.ndarray) -> None:
        """One character read by at most STEP states, which are changed."""
        H = self.hidden
        g, at, new = (x[: len(h)] for x in self.buffers)
        np.matmul(h, self.steps[way], out=g)
        g += np.take(self.tables[way], codes, axis=0, out=at, mode="clip")
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        into = g[:, :H]
        np.multiply(into, g[:, 3 * H :], out=new)
        new *= 2
        new -= into
        c *= g[:, H : 2 * H]
        c += new
        np.multiply(c, -2, out=h)
        np.exp(h, out=h)
        h += 1
        np.reciprocal(h, out=h)
        h *= 2
        h -= 1
        h *= g[:, 2 * H : 3 * H]

    def read(self, way: int, shared: Shared, slots: np.ndarray, stride: np.ndarray | int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One direction's part of the tag scores of every node, and the best for any begin and any inside over "outside".

        A beginning that sequences share is read once: its states and scores are theirs
        all. ``at`` gets the node of every place; ``slots`` has where a sequence's first
        place lies in it, ``stride`` is from place to place.
        """
        H = self.hidden
        scores, best = np.empty((shared.nodes, len(TAGS)), np.float32), np.empty((shared.nodes, 2), np.float32)
        part = np.ascontiguousarray(self.out[way * H : (way + 1) * H])
        h, c = np.zeros((1, H), np.float32), np.zeros((1, H), np.float32)
        on, lengths, common, slots = np.arange(len(shared.order)), shared.lengths, shared.common, slots[shared.order]
        node, base = np.zeros(len(on), np.int64), 0
        for t, codes in enumerate(shared.codes):
            if (more := lengths > t).sum() < len(on):
                on, lengths, common, slots, node = on[more], lengths[more], common[more], slots[more], node[more]
            fresh = common <= t
            new = np.flatnonzero(fresh)
            above, mine = node[new], codes[on[new]]
            node = np.cumsum(fresh) - 1
            at[slots + t * stride] = node + base
            h, c = h.take(above, 0), c.take(above, 0)
            for a in range(0, len(new), STEP):
                b = min(a + STEP, len(new))
                self.step(way, h[a:b], c[a:b], mine[a:b])
                own, top = scores[base + a : base + b], best[base + a : base + b]
                np.matmul(h[a:b], part, out=own)
                for k in (0, 1):
                    most = np.maximum(own[:, k + 1], own[:, k + 3])
                    for tag in range(k + 5, len(TAGS), 2):
                        np.maximum(most, own[:, tag], out=most)
                    np.subtract(most, own[:, 0], out=top[:, k])
            base += len(new)
        return scores, best

    def plain(self, begin: np.ndarray, inside: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which sequences have "outside" everywhere as their best path, by a bound that is never wrong.

        ``begin`` and ``inside`` (length, batch): at least the gain over "outside" of the
        best tag of that kind. The best path through "outside", begin and inside, each
        move between them at its best for any type, gains at least what any true path does.
        """
        kinds = [slice(0, 1), slice(1, None, 2), slice(2, None, 2)]
        (_, ob, oi), (bo, bb, bi), (io, ib, ii) = ([float(self.moves[a, b].max() - self.moves[0, 0]) for b in kinds] for a in kinds)
        b, i = begin[0].copy(), np.full(begin.shape[1], -1e6, np.float32)
        most = np.full(begin.shape[1], -1e6, np.float32)
        certain = lengths.min() - 1
        for t in range(len(begin)):
            if t:
                into = np.maximum(np.maximum(b + bb, i + ib), ob)
                i = np.maximum(np.maximum(b + bi, i + ii), oi) + inside[t]
                b = into + begin[t]
            back = np.maximum(b + bo, i + io)
            if t >= certain:
                back = np.where(t == lengths - 1, np.maximum(b, i), np.where(t < lengths, back, most))
            np.maximum(most, back, out=most)
        return most < -0.01

    def best_paths(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags (length, batch) of padded sequences (length, batch, tags)."""
        T, B, K = scores.shape
        held = np.empty((T, K, B), np.float32)  # best score of every tag at every place; the way back is found from them
        own = np.ascontiguousarray(scores.transpose(0, 2, 1))
        held[0] = own[0]
        held[0][2::2] -= 1e4  # nothing begins inside
        step = np.empty((K, K, B), np.float32)  # from, to, sequence
        for t in range(1, T):
            np.add(held[t - 1][:, None], self.moves[:, :, None], out=step)
            np.max(step, axis=0, out=held[t])
            held[t] += own[t]
            over = t >= lengths
            if over.any():
                held[t][:, over] = held[t - 1][:, over]
        out = np.empty((T, B), np.int8)
        out[-1] = held[-1].argmax(0)
        for t in range(T - 1, 0, -1):
            best = (held[t - 1] + self.moves[:, out[t]]).argmax(0)
            out[t - 1] = np.where(t < lengths, best, out[t])
        return out

    def best_path(self, scores: np.ndarray) -> np.ndarray:
        """Best tags of one sequence (length, tags)."""
        return self.best_paths(scores[:, None], np.array([len(scores)]))[:, 0]

    def tag(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans of each stretch."""
        return self.tag_codes([encode(t) for t in texts])

    def tag_codes(self, codes: list[np.ndarray]) -> list[list[tuple[int, int, str]]]:
        """Spans of each encoded stretch, by averaged window scores and one decoding."""
        with np.errstate(over="ignore"):  # a far exponential is infinite and its gate closed
            return self._tag(codes)

    def _tag(self, codes: list[np.ndarray]) -> list[list[tuple[int, int, str]]]:
        pieces: list[tuple[int, int, np.ndarray]] = []
        for k, code in enumerate(codes):
            if 0 < len(code) <= WINDOW:
                pieces.append((k, 0, code))
            else:
                starts = list(range(0, len(code) - OVERLAP, WINDOW - OVERLAP))
                pieces += [(k, s, code[s : s + WINDOW]) for s in starts]
        pieces.sort(key=lambda p: len(p[2]))
        sums = {k: (np.zeros((len(c), len(TAGS)), np.float32), np.zeros((len(c), 1), np.float32)) for k, c in enumerate(codes) if len(c) > WINDOW}
        found: list[list[tuple[int, int, str]]] = [[] for _ in codes]
        left = [pieces] if pieces else []
        while left:
            part = left.pop()
            if len(part) > 1 and len(part) * len(part[-1][2]) > PADDED:
                left += [part[len(part) // 2 :], part[: len(part) // 2]]
                continue
            lengths = np.array([len(p[2]) for p in part])
            flat = np.concatenate([p[2] for p in part])
            inside = np.arange(lengths[-1]) < lengths[:, None]
            rows = np.zeros(inside.shape, np.uint8)
            rows[inside] = flat
            ways = [Shared(rows, lengths)]
            nodes = 2 * ways[0].nodes
            if nodes <= NODES or len(part) == 1:
                rows = np.zeros(inside.shape, np.uint8)
                rows[inside[::-1]] = flat[::-1]
                ways.append(Shared(np.ascontiguousarray(rows[::-1]), lengths))
                nodes = ways[0].nodes + ways[1].nodes
            if nodes > NODES and len(part) > 1:
                groups = np.array_split(ways[0].order, min(len(part), -(-nodes // NODES)))  # each keeps what beginnings share
                left += [[part[j] for j in np.sort(some)] for some in groups]
                continue
            self._decide(part, lengths, ways, sums, found)
        for k, (total, times) in sums.items():
            found[k] = spans(self.best_path(total / times))
        return found

    def _decide(self, part: list[tuple[int, int, np.ndarray]], lengths: np.ndarray, ways: list[Shared], sums: dict, found: list) -> None:
        """Finds of the pieces, or for those of a longer stretch the scores added to its own."""
        wide = min(BLOCK, len(part))
        deep = np.array([lengths[min(a + wide, len(part)) - 1] for a in range(0, len(part), wide)])
        starts = np.concatenate([[0], np.cumsum(deep * wide)])
        which = np.arange(len(part))
        slots = starts[which // wide] + which % wide
        at = [np.zeros(starts[-1], np.int32) for _ in ways]
        (one, best_one), (two, best_two) = (
            self.read(0, ways[0], slots, wide, at[0]),
            self.read(1, ways[1], slots + (lengths - 1) * wide, -wide, at[1]),
        )
        apart = self.bias[1:] - self.bias[0]
        bias = np.array([apart[::2].max(), apart[1::2].max()], np.float32)
        for n, a in enumerate(range(0, len(part), wide)):
            size = lengths[a : a + wide]
            f, b = (x[starts[n] : starts[n + 1]].reshape(deep[n], wide)[:, : len(size)] for x in at)
            gain = np.take(best_one, f, axis=0)
            gain += np.take(best_two, b, axis=0)
            gain += bias
            alone = np.array([k not in sums for k, _, _ in part[a : a + wide]])
            unsure = np.flatnonzero(~alone | ~self.plain(gain[:, :, 0], gain[:, :, 1], size))
            if not len(unsure):
                continue
            scores = np.take(one, f[:, unsure], axis=0)
            scores += np.take(two, b[:, unsure], axis=0)
            scores += self.bias
            own = alone[unsure]
            paths = iter(self.best_paths(scores[:, own], size[unsure[own]]).T)
            for j, col in enumerate(unsure):
                k, s, code = part[a + col]
                if own[j]:
                    found[k] = spans(next(paths)[: len(code)])
                else:
                    sums[k][0][s : s + len(code)] += scores[: len(code), j]
                    sums[k][1][s : s + len(code)] += 1


def spans(path: np.ndarray) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for t, tag in enumerate(path.tolist()):
        if tag == 0:
            continue
        kind = TYPES[(tag - 1) // 2]
        if tag % 2 == 0 and out and out[-1][1] == t and out[-1][2] == kind:
            out[-1] = (out[-1][0], t + 1, kind)
        else:
            out.append((t, t + 1, kind))
    return out


_DIGITS = re.compile(r"[\dОоOoЗз]")
_TRIM = re.compile(r"^[^\w+(]+|[^\w)]+$")


def checked(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The span in its proper form, or None if it can't be of its type."""
    while start < end and not (text[start].isalnum() or (kind == "phone" and text[start] in "+(")):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    part = text[start:end]
    if kind == "name":
        if not part[:1].isupper() or len(part) < 3:
            return None
        if end < len(text) and text[end] == "." and re.search(r"(?:^|[\s.])\w$", part):
            end += 1
    elif kind == "phone":
        if part.startswith("(") and ")" not in part:
            start += 1
        if len(_DIGITS.findall(part)) < 9:
            return None
    elif kind == "id_number":
        if sum(c.isdigit() for c in part) < 6:
            return None
    elif kind == "address":
        if not re.search(r"\d", part) or not re.search(r"[^\W\d]{3}", part):
            return None
    elif kind == "email" and (len(part) < 6 or not re.search(r"@|\Wat\W|собака", part.lower())):
        return None
    return start, end


class Tagger:
    """Finds of whole texts; remembers stretches that it has read."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, list[tuple[int, int, str]]] = {}

    def finds(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        out, a, cuts, size = [], 0, [], 0
        for b, text in enumerate(texts, 1):
            cuts.append(stretches(text) if text else [])
            size += len(cuts[-1])
            if size >= STRETCHES or b == len(texts):
                out += self._finds(texts[a:b], cuts)
                a, cuts, size = b, [], 0
        return out

    def _finds(self, texts: list[str | None], cuts: list[list[tuple[int, int]]]) -> list[list[tuple[int, int, str]]]:
        if len(self.known) > _CACHE_LIMIT:
            self.known.clear()
        keys, new = [], {}
        for text, parts in zip(texts, cuts):
            codes = encode(text) if parts else None
            row = [codes[a:b].tobytes() if b - a <= 2 * WINDOW else None for a, b in parts]
            for (a, b), key in zip(parts, row):
                if key is None or (key not in self.known and key not in new):
                    new[key if key is not None else (id(text), a)] = codes[a:b]
            keys.append(row)
        got = dict(zip(new, self.model.tag_codes(list(new.values()))))
        self.known.update((k, v) for k, v in got.items() if isinstance(k, bytes))
        out = []
        for text, parts, row in zip(texts, cuts, keys):
            mine = []
            for (a, b), key in zip(parts, row):
                found = self.known[key] if key is not None else got[(id(text), a)]
                for s, e, kind in found:
                    span = checked(text, a + s, a + e, kind)
                    if span:
                        mine.append((*span, kind))
            out.append(mine)
        return out


def redact(text: str | None, finds: list[tuple[int, int, str]]) -> str | None:
    """The text with each find replaced by its type in brackets."""
    if not text or not finds:
        return text
    out, at = [], 0
    for start, end, kind in sorted(finds):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join(out) + text[at:]


def together(lengths: list[int | None]) -> list[tuple[int, int]]:
    """Runs of posts, each of at most POSTS posts and CHARACTERS characters, or one post."""
    out, at, size = [], 0, 0
    for k, n in enumerate(lengths):
        size += n or 0
        if k > at and (k - at == POSTS or size > CHARACTERS):
            out.append((at, k))
            at, size = k, n or 0
    return [*out, (at, len(lengths))] if lengths else out


def tag_posts(posts: DataFrame, weights: Path = WEIGHTS) -> DataFrame:
    """(raw_id, finds, clean_text) of every post; finds: array of (pii_type, found_text, start). ``posts``: id, content."""
    with np.load(weights) as held:
        shared = posts.sparkSession.sparkContext.broadcast(dict(held))
    kind = pa.list_(pa.struct([("pii_type", pa.string()), ("found_text", pa.string()), ("start", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Model(shared.value))
        for whole in batches:
            for a, b in together(pc.utf8_length(whole.column("content")).to_pylist()):
                batch = whole.slice(a, b - a)
                texts = batch.column("content").to_pylist()
                finds = tagger.finds(texts)
                rows = [[{"pii_type": k, "found_text": t[s:e], "start": s} for s, e, k in f] for t, f in zip(texts, finds)]
                clean = [redact(t, f) for t, f in zip(texts, finds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("raw_id"), pa.array(rows, kind), pa.array(clean, pa.string())],
                    names=["raw_id", "finds", "clean_text"],
                )

    narrow = posts.select(F.col("id").cast("bigint").alias("raw_id"), F.col("content").cast("string").alias("content"))
    return narrow.mapInArrow(
        work, "raw_id bigint, finds array<struct<pii_type:string,found_text:string,start:int>>, clean_text string"
    )


def found(tagged: DataFrame) -> DataFrame:
    one = tagged.select("raw_id", F.explode("finds").alias("f"))
    return one.select("raw_id", "f.pii_type", "f.found_text").distinct()
