"""run() of the pipeline, and the verdict of its quality rules, against plain Python; odd rows and empty tables at every stage."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from trendweave.llm import quality_rules
from trendweave.llm.textops import hash_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\x0b\x0c\r", ".,;:!?", "'\"()-", "#*$%&|<>"]


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def _class(c):
    for k, chars in enumerate(CLASSES):
        if c in chars:
            return k
    return 0 if ord(c) >= 0xC0 and not 0x2000 <= ord(c) < 0x3000 and ord(c) < 0x10000 else 7


def _bucket(word):
    raw = np.frombuffer(_lower(word).encode(), np.uint8)
    return (int(hash_spans(raw, np.array([0]), np.array([len(raw)]))[0]) >> 40) % 4096


def _distance(p, q):
    part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
    return math.sqrt(max(0.0, (part(p, q) + part(q, p)) / 2))


def judged(rows, min_docs=30):
    """doc -> kept, of rows (id, text, lang)."""
    facts, seen = {}, {}
    for i, t, lang in rows:
        w = WORD.findall(t or "")
        at = defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        repeated = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(3)}
        chars = Counter(map(_class, t or ""))
        facts[i] = lang or "", [chars[k] for k in range(8)], Counter(seen.setdefault(x, _bucket(x)) for x in w), len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    kinds, words, docs = defaultdict(Counter), defaultdict(Counter), Counter()
    for lang, chars, buckets, failed in facts.values():
        for name in () if failed else (lang, None):
            kinds[name].update(dict(enumerate(chars)))
            words[name].update(buckets)
            docs[name] += 1
    refs = {}
    for name in words:
        if name is None or docs[name] >= min_docs:
            top = sorted(words[name].items(), key=lambda x: (-x[1], x[0]))[:64]
            total, all_chars = sum(words[name].values()), sum(kinds[name].values())
            shares = [n / total for _, n in top] + [1 - sum(n for _, n in top) / total]
            limit = min(0.42, 0.8 * _distance([0.0] * len(top) + [1.0], shares))
            refs[name] = [kinds[name][k] / all_chars for k in range(8)], [b for b, _ in top], shares, limit
    out = {}
    for i, (lang, chars, buckets, failed) in facts.items():
        def worst(name, chars=chars, buckets=buckets):
            by_class, top, shares, limit = refs[name]
            n, m = sum(buckets.values()), sum(chars)
            own = [buckets[b] / n for b in top]
            own.append(1 - sum(own))
            far = max(_distance([c / m for c in chars], by_class) / 0.28 if m >= 200 else 0, _distance(own, shares) / limit if n >= 100 else 0)
            return far, 1 - own[-1] >= 0.5 * (1 - shares[-1])

        if failed:
            out[i] = False
            continue
        far = worst(lang if lang in refs else None)[0]
        if far > 1:
            far = min([far, *(f for f, shares in map(worst, [x for x in refs if x is not None]) if shares)])
        out[i] = far <= 1
    return out


def near_kept(rows, percent=80):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(_lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i for i in ids if find(i) == i}


def copies(rows):
    """doc -> copies in the mix, of rows (id, text, _, source)."""
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    by = defaultdict(list)
    for i, _, _, source in rows:
        by[source].append(i)
    sources = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in by else [])
    total = {s: sum(size[i] for i in by[s]) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), float(sum(total.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 3 * total[s]}
        target |= {s: 3.0 * total[s] for s in full} if full else {s: weight[s] * level for s in free}
        left -= sum(3 * total[s] for s in full)
        free = free - full if full else set()
    words = {s: math.floor(target[s] + 0.5) for s in sources}
    out = {}
    for s in sources:
        given, at = words[s], 0
        for i in sorted(by[s], key=lambda i: (hashlib.md5(f"{i}:mix".encode()).hexdigest(), i)):
            taken = sum(max(0, min(size[i], given - at - e * total[s])) for e in range(3))
            at += size[i]
            out[i] = (2 * taken + size[i]) // (2 * size[i]) if size[i] else 1
    return out


def test_run(spark, small):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    good = judged([r[:3] for r in rows])
    assert {r["doc_id"]: r["kept"] for r in quality_rules.judge_documents(spark.read.parquet(f"{small}/documents.parquet")).collect()} == good
    rows = [r for r in rows if good[r[0]]]
    first = {}
    for i, t, *_ in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        first[body] = min(first.get(body, (0, i)), (-len(t or ""), i)) if body in first else (-len(t or ""), i)
    rows = [r for r in rows if r[0] in {i for _, i in first.values()}]
    kept = near_kept(rows)
    rows = [r for r in rows if r[0] in kept]
    times = copies(rows)

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        cut = len(ids) % 1024 or 1024
        for k, (a, b) in enumerate(zip([0, *range(cut, len(ids), 1024)], [*range(cut, len(ids), 1024), len(ids)], strict=True)):
            want[i, k, a, b - a, hashlib.sha256(np.array(ids[a:b], "<u2").tobytes()).hexdigest()] += times[i]
    got, filled = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, small).collect():
        got[r["doc_id"], r["piece"], r["start"], r["length"], hashlib.sha256(base64.b64decode(r["ids"])).hexdigest()] += 1
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == +want
    for parts in filled.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(filled) <= 1.05 * -(-sum(k[3] * n for k, n in got.items()) // 1024) + 1


ODD = [(1, None, None, None), (2, "", "en", "a"), (None, "few words", None, "a"), (4, "w " * 60 + "x" * 5000, "en", None), (4, "w " * 60 + "x" * 5000, "en", None), (5, "Few  words", "xx", "b"), (None, None, None, None)]


@pytest.mark.parametrize("k", range(5))
def test_odd_rows_of_a_stage(spark, small, k):
    schema = "doc_id long, text string, lang string, source string, _id string, _rest string, ids string, _size int"
    docs = spark.createDataFrame([(*r, "a", "b", "c", 1) for r in ODD], schema)
    stage = corpus_pipeline.STAGES[k][1]
    got, none = stage(spark, docs, small), stage(spark, docs.limit(0), small)
    assert none.count() == 0
    if k < 4:
        assert got.columns == none.columns == docs.columns and {r["_size"] for r in got.collect()} <= {1}
    assert got.count() == {0: 0, 1: 4, 2: 5}.get(k, got.count())
    if k == 4:
        assert got.where("piece = 0").count() == len(ODD)
