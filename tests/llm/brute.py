"""The operators once more, in plain Python, for small tables."""

import base64
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken
import xxhash
from tokenizers import Tokenizer

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def little_endian(ids):
    return np.array(ids, "<u4").tobytes()


def exact_groups(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate(UPPER)].append(i)
    return sorted(
        (i, max(g), len(g), i == max(g), sha(low))
        for i, t in docs for low in [(t or "").translate(UPPER)] for g in [groups[low]])


def token_ids(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs}


def bpe_digests(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: own.encode_ordinary(t or "") for i, t in docs}
    return sorted((i, len(ids[i]), sha(little_endian(ids[i])), sha(t or "")) for i, t in docs)


def token_files(docs):
    out, start = [], 0
    for i, ids in sorted(token_ids(docs).items()):
        out.append((i, start, len(ids), zlib.crc32(little_endian(ids))))
        start += len(ids)
    return out


def language_losses(docs):
    """(id, words, target loss, background loss) of (id, text, target): bigrams of all words, counted plainly."""
    texts = [(i, re.findall(r"\w+", (t or "").lower()), bool(good)) for i, t, good in docs]
    width = len({w for _, t, _ in texts for w in t}) + 2
    pairs, words, before = ({True: Counter(), False: Counter()} for _ in range(3))
    for _, t, good in texts:
        pairs[good].update(zip([None, *t], t))
        words[good].update(t)
        before[good].update([None, *t][:-1])

    def loss(t, good):
        total = sum(words[good].values()) + width
        each = [-math.log((pairs[good][a, b] + 50 * (words[good][b] + 1) / total) / (before[good][a] + 50))
                for a, b in zip([None, *t], t)]
        return math.fsum(each) / len(each) if each else None

    return [(i, len(t), loss(t, True), loss(t, False)) for i, t, _ in texts]


def fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(rb"[^\x20\x09-\x0D]+", words)
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_duplicates(docs):
    docs = sorted(docs)
    prints = np.array([fingerprint(t) for _, t in docs], np.uint64)
    links = [(i, int(j)) for i in range(len(docs)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3)]
    roots = components(len(docs), links)
    return [(i, f"{int(p):016x}", docs[r][0]) for (i, _), p, r in zip(docs, prints, roots)]


def secret_spans(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def masked(text):
    out, at = "", 0
    for start, _, _, end in secret_spans(text):
        if start > at or not out:
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return out + text[at:] if out else text


def best(vectors, k=5):
    """(query, rank, id, score) of every query against all vectors, by sorting."""
    numbers = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors.items()}
    out = []
    for q, v in numbers.items():
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in numbers.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def check_packing(docs, pieces, capacity=1024):
    """The number of sequences, after checking that ``pieces`` hold all ids without gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    ids = token_ids(docs)
    assert by_doc.keys() == ids.keys()
    for doc, own in by_doc.items():
        own.sort(key=lambda p: p["piece"])
        at = 0
        for i, p in enumerate(own):
            assert (p["piece"], p["start"]) == (i, at)
            assert p["ids_crc32"] == zlib.crc32(little_endian(ids[doc][at:at + p["length"]]))
            assert i == 0 or p["length"] == capacity
            at += p["length"]
        assert at == len(ids[doc]) and (at > capacity or len(own) == 1)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


# Failure conditions on (id, text, words, all documents), by filter.
FILTERS = {
    "A": lambda i, t, w, docs: len(w) < 50,
    "B": lambda i, t, w, docs: 100 * len(set(w)) < 65 * len(w),
    "C": lambda i, t, w, docs: 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
    "D": lambda i, t, w, docs: bool(set(t) & set("#$%&*|")),
    "E": lambda i, t, w, docs: i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
}


def ascii_words(text):
    return [w.decode() for w in (text or "").encode().split()]


def filter_audit(docs, labels):
    """Rows of the audit of (id, text, source), by applying every order of the filters one after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    judged = [(i, s or "", {f for f, fails in FILTERS.items() if fails(i, t or "", ascii_words(t), docs)}) for i, t, s in docs]
    out = []
    for part in {s for _, s, _ in judged}:
        own, total = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left, gone = [d for d in judged if d[1] == part], []
            for step, f in enumerate(order, 1):
                lost = [d for d in left if f in d[2]]
                redundant = sum(f in d[2] for d in gone)
                left = [d for d in left if f not in d[2]]
                gone += lost
                total[f] += len(lost)
                own.append((f, (part, "".join(order), step, len(left), len(lost), redundant,
                                sum(d[2] == {f} and d[1] == part for d in judged),
                                sum(d[0] in good for d in lost), sum(d[0] in toxic for d in lost))))
        out += [(*row, total[f]) for f, row in own]
    return sorted(out)


def host_counts(text):
    """(words, their characters, symbols, repeated lines, words in repeated windows of five)."""
    text = text or ""
    words = ascii_words(text)
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if ascii_words(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def host_verdicts(docs, most=0.5):
    """(id, counts..., base_failed, kept) of (id, text, source)."""
    rows, hosts = [], defaultdict(list)
    for i, t, s in docs:
        n, chars, symbols, dup, rep = counts = host_counts(t)
        lines = sum(bool(ascii_words(x)) for x in (t or "").split("\n"))
        flags = (n < 10, 100 * rep > 20 * n, 100 * symbols > 10 * n, 100 * dup > 30 * lines)
        rows.append((i, s, counts, flags))
        hosts[s].append(flags)
    rejected = set()
    for rule in range(4):
        sizes = {h: len(f) for h, f in hosts.items()}
        failures = {h: sum(x[rule] for x in f) for h, f in hosts.items()}
        size, mean = sum(sizes.values()), sum(failures.values()) / max(1, sum(sizes.values()))
        spread = sum(sizes[h] * (failures[h] / sizes[h] - mean) ** 2 for h in hosts)
        effective = size - sum(n * n for n in sizes.values()) / size if size else 0
        between = (spread - mean * (1 - mean) * (len(hosts) - 1)) / effective if effective > 0 else 0
        weight = min(1e12, max(mean * (1 - mean) / between - 1, 0)) if between > 1e-15 else 1e12
        rejected |= {h for h in hosts if round((failures[h] + mean * weight) / (sizes[h] + weight), 9) > most}
    return [(i, *counts, flags[0] or flags[1], not (flags[0] or flags[1]) and s not in rejected) for i, s, counts, flags in rows]


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def merkle_leaf(*values):
    return sha("".join(map(_field, values)))


def merkle(docs):
    """Rows of the manifest of (doc_id, source, lang, n_chars, text), by recursion over whole trees."""
    def tree(nodes):
        """The root of ``nodes`` and the proof of each: lists of (left, right) siblings."""
        if len(nodes) == 1:
            return nodes[0], [[]]
        runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
        root, above = tree([sha("".join(run)) for run in runs])
        return root, [[(run[:i], run[i + 1:]), *above[r]] for r, run in enumerate(runs) for i in range(len(run))]

    def lost(d):
        even = zlib.crc32(str(d[0]).encode()) % 2 == 0 if d[0] is not None else False
        return (*d[:4], d[4].replace("\n", "") if even and d[4] is not None else d[4])

    sources = defaultdict(list)
    for d in docs:
        sources[d[1]].append((d[0] is not None, d[0] or 0, merkle_leaf(*d), merkle_leaf(*lost(d)), d[0]))
    ordered = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf for _, _, leaf, _, _ in sorted(sources[s], key=lambda x: x[:4])]) for s in ordered}
    if not trees:
        return []
    root, tops = tree([trees[s][0] for s in ordered])
    out = []
    for s, top in zip(ordered, tops):
        subroot, proofs = trees[s]
        for (_, _, leaf, claimed, i), proof in zip(sorted(sources[s], key=lambda x: x[:4]), proofs):
            node, steps = claimed, proof + top
            for left, right in steps:
                node = sha("".join([*left, node, *right]))
            out.append((i, leaf, subroot, root, sha("".join(x for left, right in steps for x in [*left, *right])), node, node == root))
    return out
