"""Plain reference versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def spans_of(flags):
    out, k = [], 0
    for on, run in itertools.groupby(flags):
        n = len(list(run))
        if on:
            out.append((k, k + n))
        k += n
    return out


def repeated_words(rows, window=13):
    """doc_id -> (n_words, n_removed, kept_sha256), from (doc_id, text)."""
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, own in words:
        for i in range(len(own) - window + 1):
            w = tuple(own[i : i + window])
            least[w] = min(least.get(w, d), d)
    out = {}
    for d, own in words:
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            if least[tuple(own[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [w for w, g in zip(own, gone, strict=True) if not g]
        out[d] = (len(own), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def repeated_bytes(rows, window=200):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)], from (doc_id, text)."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(hash(b[i : i + window]) for _, b in texts for i in range(len(b) - window + 1))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[hash(b[i : i + window])] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(spans_of(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, size=5):
    words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])


def similar_groups(rows, percent=75):
    """[(doc_id, n_shingles, component_id)], from (doc_id, text) with distinct ids."""
    sets = {d: shingles(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = Counter()
    for own in holders.values():
        for pair in itertools.combinations(sorted(own), 2):
            shared[pair] += 1
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return [(d, len(s), find(d)) for d, s in sets.items()]


def resampled(rows, target, buckets=10_000, run=1, least=20, percent=10, seed=2024):
    """{(doc_id, n_features, weight, score, rank)}, from (doc_id, text) with distinct ids and the target's texts."""

    def words(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))

    def features(own):
        return [zlib.crc32(" ".join(own[i : i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(own) - n + 1)]

    bags = [(d, words(t)) for d, t in rows]
    s, t = Counter(b for _, own in bags for b in features(own)), Counter(b for x in target for b in features(words(x)))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = {}
    for d, own in bags:
        found = features(own)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        out[d] = (len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
    able = sorted((d for d, own in bags if len(own) >= least), key=lambda d: (-out[d][2], d))
    rank = {d: k + 1 for k, d in enumerate(able[: len(able) * percent // 100])}
    return {(d, *out[d], rank.get(d)) for d, _ in bags}


def aligned(rows, a_path, b_path):
    """[(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)], from (doc_id, text)."""
    import json

    import sentencepiece
    import tokenizers

    a, b = tokenizers.Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    with open(a_path) as f:
        a_bytes = {k: bytes(alphabet[c] for c in p) for p, k in json.load(f)["model"]["vocab"].items()}
    out, holders = [], Counter()
    for d, text in rows:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            pieces = [b.id_to_piece(k) for k in y]
            ends = [list(itertools.accumulate(len(a_bytes[k]) for k in x)), list(itertools.accumulate(1 if b.is_byte(k) else len(p.replace("\u2581", " ").encode()) for k, p in zip(y, pieces, strict=True)))]
            body = b"".join(bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("\u2581", " ").encode() for k, p in zip(y, pieces, strict=True))
            if body == b"".join(a_bytes[k] for k in x) == (" " + text).encode():
                low = 0
                for high in sorted(set(ends[0]) & set(ends[1])):
                    groups.append(tuple([k for k, e in zip(ids, own, strict=True) if low < e <= high] for ids, own in zip((x, y), ends, strict=True)))
                    low = high
        out.append((d, groups, [p for g in groups for p in itertools.product(*g)]))
        holders.update(set(out[-1][2]))
    best = {}
    for (x, _), n in holders.items():
        best[x] = max(best.get(x, 0), n)
    return [(d, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(links), sum(holders[p] == best[p[0]] for p in links), sum(holders[p] for p in links),
             hashlib.sha256(";".join("|".join(",".join(map(str, ids)) for ids in g) for g in gs).encode()).hexdigest() if gs else "") for d, gs, links in out]
