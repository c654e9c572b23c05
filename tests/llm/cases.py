"""Documents that try the operators' edges, and plain versions of what the operators compute."""
from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, n_words long, label int, digest long, a long, shard int"
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(n))


def odd_texts() -> list[str | None]:
    base, passage = words(1, 120), words(2, 60)
    near = base.split()
    near[17] = "changed"
    far = base.split()
    far[::7] = ["x"] * len(far[::7])
    return [None, "", " \n\t ", "a", "one two three", "one two three", "ONE two THREE", base, base, base.upper(), " ".join(near), " ".join(far), "x" * 5000, "ab" * 400, "é" * 300 + " ç",
            words(3, 20_000), f"{words(4, 30)} {passage} {words(5, 30)}", f"{passage} {words(6, 40)}", f"{words(7, 10)}\n{passage}\n{passage}\n{words(8, 5)}", "the 1d10t s.c.u.m m o r o n", "\x00\x01 \x7f <|endoftext|> don't 3.14 日本語 😀",
            "same line\nsame line\n\nsame line", "w " * 300, base[:99], base[:100], base[:101]]


def rows(texts: list[str | None]) -> list[tuple]:
    """Rows with ids 0.. and, at the end, a null id, nulls everywhere, a repeated row and a repeated id."""
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t) if t else None, "own row", 0.5, 7, None, 1, 2, 3) for i, t in enumerate(texts)]
    return [*out, (None, words(9, 50), None, None, None, None, None, None, None, None, None, None), (None,) * 12, out[7], (3, words(10, 50), "de", "s", 1, None, None, None, None, None, None, None)]


def jaccard_components(docs: list[tuple[int, str | None]], percent: int = 75) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in docs:
        w = SPACE_WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    holders = collections.defaultdict(list)
    for i in ids:
        common = collections.Counter(j for x in sets[i] for j in holders[x])
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for x in sets[i]:
            holders[x].append(i)
    return {i: (len(sets[i]), root(i)) for i in ids}


def kept_bytes(docs: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[bytes, int, int, int]]:
    seen, out = set(), {}
    for i, t in sorted(docs):
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            x = raw[s:s + length]
            if x in seen:
                covered[s:s + length] = b"\x01" * length
            seen.add(x)
        out[i] = bytes(c for c, m in zip(raw, covered) if not m), len(raw), sum(covered), len(re.findall(b"\x01+", bytes(covered)))
    return out


def benchmark_hits(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], width: int = 10) -> dict[int, tuple[int, int, list[str]]]:
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM_WORD.findall((t or "").encode().lower())
        if w and i is not None:
            for k in range(max(1, len(w) - width + 1)):
                windows[tuple(w[k:k + width])].add(str(i))
    sizes, out = {len(w) for w in windows}, {}
    for i, t in docs:
        w = ALNUM_WORD.findall((t or "").encode().lower())
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k:k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out[i] = len(w), len(hit), sorted(found)
    return out


def plain_rules(text: str | None) -> tuple[int, int, int, int, int]:
    w = SPACE_WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE_WORD.search(x)]
    windows = collections.defaultdict(list)
    for k in range(len(w) - 7):
        windows[tuple(w[k:k + 8])].append(k)
    repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def best_fit_decreasing(lengths: list[int], window: int) -> list[int]:
    """Remaining capacities after packing piece by piece."""
    import bisect
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, n)
        left = (free.pop(at) if at < len(free) else window) - n
        bisect.insort(free, left)
    return free
