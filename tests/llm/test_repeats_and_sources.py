"""Periodic runs, exact dedup and the sources' divergence against plain versions, and on edge cases."""

import hashlib
from collections import Counter, defaultdict
from random import Random
from zlib import crc32

import duckdb
import numpy as np
import pytest
from brute import WORD

from quire.llm import divergence, exact_dedup, periodic, registry

DATA = "/root/testdata/sf0.001"


def plain_runs(words, least=12):
    """{(start, end): period} of all stretches, from each period's matches."""
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    s, found = np.array([code[w] for w in words], np.int64), {}
    for q in range(1, len(words) // 2 + 1):
        edge = np.diff(np.concatenate(([0], s[:-q] == s[q:], [0])).astype(int))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if b - a >= q:
                found.setdefault((a, b + q), q)
    return sorted((a, q, b) for (a, b), q in found.items() if b - a >= max(least, 2 * q))


def test_runs_of_few_words():
    random = Random(3)
    for _ in range(400):
        texts = []
        for _ in range(random.randint(0, 4)):
            n, letters = random.randint(0, 60), random.randint(1, 4)
            words = [bytes([97 + random.randint(0, letters - 1)]) for _ in range(n)]
            if n > 3 and random.random() < 0.5:
                a = random.randint(0, n - 1)
                p = random.randint(1, n - a)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        least = random.choice([2, 4, 12])
        s, starts = periodic.numbered(texts)
        start, end, period = periodic.runs_of(s, least)
        got = [[] for _ in texts]
        for a, b, q in zip(start.tolist(), end.tolist(), period.tolist(), strict=True):
            d = int(np.searchsorted(starts, a, "right")) - 1
            got[d].append((a - int(starts[d]), q, b - int(starts[d])))
        assert got == [plain_runs(t, least) for t in texts]


def test_runs_of_long_repeats():
    """Deep trees: one word over and over, few words in turn, and a Fibonacci word's many runs."""
    for unit, times in ((["w"], 50_000), (["a", "b", "c"], 30_000), ([str(i) for i in range(9_000)], 7)):
        s, _ = periodic.numbered([[w.encode() for w in unit] * times])
        assert [x.tolist() for x in periodic.runs_of(s, 12)] == [[1], [len(unit) * times + 1], [len(unit)]]
    before, fib = [b"a"], [b"b"]
    while len(fib) < 1_500:
        before, fib = fib, fib + before
    s, _ = periodic.numbered([fib])
    start, end, period = periodic.runs_of(s, 2)
    assert list(zip((start - 1).tolist(), period.tolist(), (end - 1).tolist(), strict=True)) == plain_runs(fib, 2)


def digests(doc_id, text):
    """op11's row of one document, by its contract."""
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and (h := crc32(str(doc_id).encode())) % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for a, q, b in runs for i in range(a + q, b)}
    best = min(((a - b, a, q) for a, q, b in runs), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *first, sha("".join(f"{a},{b - a},{q}\n" for a, q, b in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs(spark, docs):
    got = sorted(map(tuple, registry.op11_periodic_runs(spark, DATA).collect()))
    assert got == sorted(digests(r.doc_id, r.text) for r in docs.collect())
    assert sum(r[1] > 0 for r in got) > len(got) / 20


def test_periodic_runs_on_edges(edge, none):
    rows = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(edge).collect()), key=str)
    assert len(rows) == edge.count()
    assert (False, 5, 60_000, [(0, 60_000, 1)], "wort") in rows
    assert (False, 2, 0, [], "") in rows and (False, 4, 0, [], "") in rows
    assert periodic.periodic_runs(none).collect() == []
    assert registry._repeating(edge).count() == edge.count()


def plain_classes(rows):
    """op12's rows: which of alike rows is kept doesn't matter."""
    texts = [(i, exact_dedup.normalized(t)) for i, t in rows]
    groups = defaultdict(list)
    for i, t in texts:
        groups[t].append(i)
    first = {t: min(ids, key=lambda i: (i is None, i or 0)) for t, ids in groups.items()}
    seen, out = set(), []
    for i, t in texts:
        stays = i == first[t] and t not in seen
        if stays:
            seen.add(t)
        out.append((i, first[t], len(groups[t]), stays, hashlib.sha256(t).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("huge, keys", [(exact_dedup.HUGE, exact_dedup.KEYS), (100, exact_dedup.KEYS), (100, ((3, 2), (5, 3))), (1 << 24, ((2, 1), (3, 2)))])
def test_exact_duplicates(spark, docs, edge, huge, keys):
    """As it is; chunks dealt out; and with primes so small that different texts share fingerprints."""
    tables = [edge, docs]
    made = [(i, t) for i, t in enumerate(["a b", "a  b", "a\tb", " a b", "a b ", "ab", "a b", "", None, "x" * 200_000, "x" * 200_000, "x" * 199_999 + "y", "b a"])]
    tables.append(spark.createDataFrame(made, "doc_id long, text string"))
    for t in tables:
        got = sorted(map(tuple, exact_dedup.exact_duplicates(t, huge, keys).collect()), key=str)
        assert got == plain_classes([(r.doc_id, r.text) for r in t.select("doc_id", "text").collect()])


def test_exact_duplicates_of_nothing(none):
    assert exact_dedup.exact_duplicates(none).collect() == []


def test_fingerprints_combine():
    random = Random(5)
    for n in (0, 1, 65_535, 65_536, 65_537, 200_000):
        data = random.randbytes(n)
        cut = random.randint(0, n)
        for k, key in enumerate(exact_dedup.KEYS):
            whole = 0
            for byte in reversed(data):
                whole = (whole * key[1] + byte) % key[0]
            parts = exact_dedup.fingerprint(data[:cut])[k] + exact_dedup.shifted(exact_dedup.fingerprint(data[cut:])[k], cut, key)
            assert exact_dedup.fingerprint(data)[k] == whole == parts % key[0]


def plain_divergence(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, langs, counts = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = divergence.terms_of(text.encode())
        docs[lang].update(set(terms))
        langs[lang].update(terms)
        counts[lang, source].update(terms)
    kept = {lang: sorted(t for t, n in docs[lang].items() if n >= least) for lang in docs}

    def shares(lang, c):
        total = sum(c[t] for t in kept[lang]) + 5 * len(kept[lang])
        return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept[lang]}

    all_shares, whole, out = {k: shares(k[0], c) for k, c in counts.items()}, {lang: shares(lang, c) for lang, c in langs.items()}, []
    for lang, source in counts:
        p, q = all_shares[lang, source], whole[lang]
        pairs = [(k[1], r) for k, r in all_shares.items() if k[0] == lang and k[1] != source]
        found = {"pair": [(o.encode(), sum(abs(p[t] - r[t]) for t in kept[lang])) for o, r in pairs], "term": [(t, p[t] - q[t]) for t in kept[lang] if counts[lang, source][t] and p[t] > q[t]]}
        for part, items in found.items():
            items = sorted(items, key=lambda x: (-x[1], x[0]))
            out += [(lang, source, part, item.decode(), value, rank) for rank, (item, value) in enumerate(items, 1) if part == "pair" or rank <= top]
    return sorted(out)


@pytest.mark.parametrize("least, top", [(30, 50), (2, 3), (10_000, 5)])
def test_divergence(docs, edge, none, least, top):
    for t in (docs, edge, none):
        got = sorted(map(tuple, divergence.divergence(t, least, top).collect()))
        assert got == plain_divergence([(r.text, r.lang, r.source) for r in t.select("text", "lang", "source").collect()], least, top)


def test_terms():
    assert divergence.terms_of("Don't STOP, Été_x中文 9a\x7fb".encode()) == [x.encode() for x in ("don", "t", "stop", "Été", "x中文", "a", "b")]


def test_tries():
    """A packed trie comes back as it was, and tries merge as their counters do."""
    random = Random(2)
    tries, want, held = [], defaultdict(Counter), Counter()
    for _ in range(5):
        counts = {s: Counter(random.choice(["", "é"]) + "ab"[k % 2] * (k % 9) + "xyz"[k % 3] for k in random.choices(range(40), k=random.randint(1, 60))) for s in ("a", "b")}
        counts = {s: Counter({t.encode(): n for t, n in c.items()}) for s, c in counts.items()}
        docs = Counter({t: 1 for c in counts.values() for t in c})
        trie, sources = divergence._held_tries(docs, counts)
        back = divergence.unpack(divergence.pack(trie))
        assert back.terms == trie.terms == sorted(docs) and sources == ["a", "b"]
        assert all((x == y).all() for x, y in zip(back[1:], trie[1:], strict=True))
        tries.append(back)
        held.update(docs)
        for k, s in enumerate(sources):
            want[k].update(counts[s])
    whole = divergence.merge(tries)
    assert whole.terms == sorted(held) and whole.docs.tolist() == [held[t] for t in whole.terms]
    got = defaultdict(Counter)
    for leaf, source, n in zip(whole.leaf.tolist(), whole.source.tolist(), whole.count.tolist(), strict=True):
        got[source][whole.terms[leaf]] += n
    assert got == want


def test_shares():
    random = Random(4)
    total = np.array([random.randint(1, 1 << 53) for _ in range(500)])
    count = np.array([random.randint(0, int(t)) for t in total])
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * c // t for c, t in zip(count.tolist(), total.tolist(), strict=True)]


@pytest.mark.parametrize("name", ["op12_exact_dedup", "op13_source_divergence"])
def test_oracles(spark, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    c = duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet('{DATA}/documents.parquet')")
    want = c.execute(registry.ORACLES[name]).df()
    by = list(got.columns)
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want[by].itertuples(index=False, name=None))
