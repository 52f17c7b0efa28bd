"""Plain Python versions of the corpus operators; slow, and written apart from them."""

import hashlib
import math
import re
import zlib
from collections import Counter

BLANK = r"\x20\x09-\x0D"


def words_of(text):
    return re.findall(rf"[^{BLANK}]+", text or "")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


# -- token ids and counts


def token_digest(rows, path, end_id=1):
    """``{doc_id: (start, n, crc)}`` in ascending order of doc_id."""
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(path), 0, {}
    for doc_id, text in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out[doc_id] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    return out


def piece_counts(texts, path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [len(model.encode(t or "")) for t in texts]


# -- secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def entropy(window):
    n = len(window)
    return math.log2(n) - sum(c * math.log2(c) for c in Counter(window).values()) / n


def entropy_spans(text, classes, allowed):
    out = []
    for kind in classes:
        for m in re.finditer(kind.pattern, text):
            s = m.group()
            if not re.search("[0-9]", s) or not re.search("[A-Za-z]", s) or re.search(allowed, s):
                continue
            hits = [i for i in range(len(s) - kind.window + 1) if entropy(s[i : i + kind.window]) >= kind.bits - 1e-9]
            if hits:
                out.append((kind.name, m.start() + hits[0], m.start() + hits[-1] + kind.window))
    return out


# -- quality rules


def rule_counts(text):
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if twice[w] > 1:
            inside.update((i, i + 1, i + 2))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


# -- fingerprints


def fingerprint(text):
    import xxhash

    words = words_of(lower_ascii(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(prints, distance=2):
    """``{doc_id: least doc_id}`` of ``{doc_id: fingerprint}``; compares all pairs of distinct fingerprints."""
    least = {}
    for doc_id, f in prints.items():
        least[f] = min(doc_id, least.get(f, doc_id))
    parent = {f: f for f in least}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    known = list(least)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= distance:
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[ra] = rb
    best = {}
    for f in known:
        best[root(f)] = min(least[f], best.get(root(f), least[f]))
    return {d: best[root(f)] for d, f in prints.items()}


# -- lines


def without_frequent(rows, min_docs, min_chars=1):
    """``[(id, n_lines, n_dropped, kept text)]`` for ``[(id, text)]``."""
    key = lambda line: lower_ascii(re.sub(rf"^[{BLANK}]+|[{BLANK}]+$", "", line))
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or held[key(x)] < min_docs]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
