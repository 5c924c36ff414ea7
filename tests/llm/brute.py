"""Plain versions of the operators' contracts, row by row on small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\f\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encoding(name: str = "byte_bpe_50k.tiktoken") -> tiktoken.Encoding:
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def quality(rows):
    """(doc_id, text) -> base counts."""
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
        n = len(words)
        failed = n < 10 or 100 * len(covered) > 20 * n
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        out.append((doc_id, n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed))
    return out


def line_dedup(rows, min_docs=10):
    """(doc_id, text) -> (doc_id, n_lines, n_dropped, kept text); every row is a document."""
    key = lambda line: line.strip(BLANKS).translate(UPPER)
    held = defaultdict(set)
    for row, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            held[key(line)].add(row)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(held[key(x)]) < min_docs]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def fingerprint(text, shingle):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=3):
    """Index of the first row of each row's component."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def mix(rows, weights=(3, 1, 2), share=1.5, most=2):
    """(doc_id, text, source) -> per row (size, source_size, target, epochs, key), by repeated resharing."""
    size = lambda t: len(WORD.findall(t or ""))
    total = Counter()
    for _, text, source in rows:
        total[source] += size(text)
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [s for s in total if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = share * sum(total.values()), set()
    while True:
        left = budget - sum(most * total[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: most * total[s] if s in full else left * weight[s] / free for s in names}
        over = {s for s in names if s not in full and target[s] > most * total[s]}
        if not over:
            break
        full |= over
    out = []
    for doc_id, text, source in rows:
        whole = f"mix:{'' if doc_id is None else doc_id}:{text or ''}"
        key = int(hashlib.md5(whole.encode()).hexdigest()[:15], 16)
        out.append((doc_id, size(text), total[source], target[source], key))
    return out


def taken(rows):
    """(doc_id, text, source) -> (doc_id, size, source_size, target, taken)."""
    placed = mix(rows)
    units = defaultdict(lambda: defaultdict(list))
    for (_, _, source), (_, size, _, _, key) in zip(rows, placed):
        units[source][key].append(size)
    out = []
    for (_, _, source), (doc_id, size, total, target, key) in zip(rows, placed):
        words = math.floor(target + 0.5)
        epochs, rest = divmod(words, total) if total else (0, 0)
        before = sum(sum(v) for k, v in units[source].items() if k < key)
        unit = units[source][key]
        part = size if before + sum(unit) <= rest else max(0, rest - before) // len(unit)
        out.append((doc_id, size, total, target, epochs * size + part))
    return out


def mixed(rows):
    """Texts of the mix: (doc_id, text) as often as taken, the cut one short."""
    out = []
    for (doc_id, text, source), (_, size, total, target, take) in zip(rows, taken(rows)):
        if not size:
            continue
        out += [(doc_id, text)] * (take // size)
        if take % size:
            ends = [m.end() for m in WORD.finditer(text)]
            out.append((doc_id, text[: ends[take % size - 1]]))
    return out


def top_k(rows, queries, k):
    """(vec_id, whole components) -> (query_id, rank, vec_id, score)."""
    out = []
    for q, v in queries:
        scored = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def revisits(rows, least=100):
    """(page_id, html) -> (page_id, bytes, digest, type, refers_to)."""
    order = lambda x: (x is None, x or 0)
    first, out = {}, []
    for page_id, html in sorted(rows, key=lambda r: order(r[0])):
        data = (html or "").encode()
        digest = sha(data)
        again = len(data) >= least and digest in first
        out.append((page_id, len(data), digest, "revisit" if again else "response", first[digest] if again else None))
        if len(data) >= least:
            first.setdefault(digest, page_id)
    return out


def mix64(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def slot(number, n, key, rounds=6):
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    keys = [mix64(i * 0x9E3779B97F4A7C15 % 2**64 ^ key) for i in range(1, rounds + 1)]
    while True:
        left, right = number >> half, number & (1 << half) - 1
        for k in keys:
            left, right = right, left ^ mix64(right ^ k) & (1 << half) - 1
        number = left << half | right
        if number < n:
            return number


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_duplicates(rows):
    """(is null, id) of the smallest row of each component of pairs at 0.8 or more, empty texts alike."""
    distinct = {}
    for doc_id, text in rows:
        key = frozenset(_shingles(text))
        distinct[key] = min(distinct.get(key, (True, float("inf"))), (doc_id is None, doc_id or 0))
    sets = list(distinct)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, key in enumerate(sets):
        least[find(i)] = min(least.get(find(i), (True, float("inf"))), distinct[key])
    return sorted(least.values())
