"""Spelling variants, the Jaccard join and collocations against brute force, on small tables with odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from candlemill.llm import jaccard, phrases, registry, spelling, wordhash
from tests.llm.brute import lower
from tests.oracle import duck, spark_rows

SF = "/root/testdata/sf0.01"
SPACES = r"[^\x20\x09-\x0D]+"


def _closed(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(SPACES, lower(t))
        out[i] = frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()
    return out


def _families(rng, sizes, edits, pool=400, members=5):
    """Families of texts edited in some words each, so that similarities lie on both sides of the threshold."""
    word = lambda: f"W{rng.randrange(pool)}é"
    out = []
    for n in sizes:
        base = [word() for _ in range(n)]
        for k in range(members):
            w = list(base)
            for _ in range(edits * k):
                at = rng.choice((0, 0, len(w) - 1, len(w) - 1, rng.randrange(len(w))))
                w[at : at + 1] = rng.choice(([word()], [], [word(), word()]))
            out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def families():
    rng = random.Random(4)
    boiler = " ".join(f"boiler{k}" for k in range(30))
    texts = _families(rng, [8, 9, 10, 14, 20, 30, 60, 120, 400], 1) + _families(rng, [200, 300], 4)
    texts += [f"{boiler} {' '.join(f'own{rng.randrange(10**6)}' for _ in range(25))}" for _ in range(40)]
    texts += [None, None, "", " \n\t", "a", "A", "one two three", "one  two\nTHREE", "one two three four", texts[3], texts[3].upper(), "loop " * 30_000, "loop loop loop loop", "\x00 b " * 9, "x" * 9000]
    return list(enumerate(texts))


def _jaccard(spark, rows, extra=()):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in [*rows, *extra]], "doc_id long, text string, cls string, n long, node long")
    return jaccard.near_sets(docs).collect()


def test_jaccard_join_against_all_pairs(spark, families, monkeypatch):
    sets = _sets(families)
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert len(links) > 40
    want = {i: (len(sets[i]), c) for i, c in _closed(sets, links).items()}
    got = _jaccard(spark, families, [families[5], (None, families[0][1]), (None, None)])
    assert len(got) == len(families) + 3 and {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert sorted((r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got if r.doc_id is None) == [(0, -1), want[0]]
    monkeypatch.setattr(jaccard, "BLOCK", 4)  # keys are compared in blocks, centres' pairs dealt over parts
    monkeypatch.setattr(jaccard, "PAIRS", 1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in _jaccard(spark, families)} == want


def test_jaccard_join_of_no_documents(spark):
    assert _jaccard(spark, []) == []
    assert [(r.n_shingles, r.component_id) for r in _jaccard(spark, [(7, None)])] == [(0, 7)]


def test_linked_sets_share_more_segments_than_are_spared():
    rng = np.random.default_rng(1)
    for n in (7, 8, 12, 30, 100, 700, 5000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop = rng.integers(0, jaccard.most_apart(2 * n) // 2 + 1)
            b = np.unique(np.r_[a[drop:], rng.integers(0, 1 << 63, drop).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both):
                continue
            band = np.searchsorted(jaccard.BOUNDS, max(len(a), len(b)), side="right") - 1
            keys = [jaccard.segment_keys(x, np.array([len(x)]), np.array([band]))[0] for x in (a, b)]
            assert (keys[0] == keys[1]).sum() > jaccard.spare(int(band))
            apart = np.bitwise_count(jaccard.folded(a, np.array([len(a)])) ^ jaccard.folded(b, np.array([len(b)]))).sum()
            assert apart <= len(np.setxor1d(a, b)) <= jaccard.most_apart(len(a) + len(b))


def test_words_hash_as_words():
    texts = [b"One two\tTHREE", b"", b" \n", b"one  TWO\r\nthree ", "É é".encode(), b"x" * 9000 + b" y"]
    h, n = wordhash.words_by_text(texts)
    assert n.tolist() == [3, 0, 0, 3, 2, 2] and h[:3].tolist() == h[3:6].tolist() and len(set(h.tolist())) == 7


def _variants(rows):
    counts = Counter()
    for i, t in rows:
        for w in re.findall(r"[a-zÀ-ÿ]+", lower(t)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            k = h % len(w)
            counts[w[:k] + w[k + 1 :] if h % 97 == 0 else w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = defaultdict(set)
    for a, b in combinations(n, 2):
        if abs(len(a) - len(b)) <= 1:
            at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            if a[at + (len(a) >= len(b)) :] == b[at + (len(b) >= len(a)) :]:
                near[a].add(b)
                near[b].add(a)
    form = {w: best for w in n if near[w] and n[best := min(near[w], key=lambda x: (-n[x], x))] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items())


@pytest.mark.parametrize("hot", [2, 256])
def test_spelling_variants_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT", hot)
    rng = random.Random(8)
    base = ["kitten", "mittens", "aaaaaa", "ababab", "naïveté", "straßen", "banana", "bananas", "x" * 300, "ÿÿÿÿÿ"]
    words = []
    for w in base:
        words += [w] * 24
        for _ in range(30):
            k = rng.randrange(len(w))
            words += [rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abé") + w[k + 1 :]))] * rng.choice((3, 6, 13))
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 50 : i * 50 + 50])) for i in range(len(words) // 50 + 1)]
    rows += [(None, "Kitten KITTEN kitten"), (90, None), (91, ""), (92, "1234 É! ..."), rows[1], (93, "banana, banana; banana")]
    docs = spark.createDataFrame([(i, t, "w", 3) for i, t in rows], "doc_id long, text string, word string, n int")
    want = _variants(rows)
    assert sum(r[1] is not None for r in want) > 50 and any(r[2] != r[1] for r in want if r[1])
    assert sorted(map(tuple, spelling.variant_groups(docs).collect())) == want
    assert spelling.variant_groups(docs.limit(0)).count() == 0


def test_pivots_are_the_rarest_disjoint_pair():
    rng = random.Random(2)
    for _ in range(300):
        own = [(rng.randrange(9), "ab", at) for at in sorted(rng.sample(range(12), rng.randrange(3, 7)))]
        cost = {at: c for c, _, at in own}
        got = spelling.pivots(own)
        assert len(got) == 2 and got[1] - got[0] >= 2
        assert cost[got[0]] + cost[got[1]] == min(cost[a] + cost[b] for a, b in combinations(cost, 2) if b - a >= 2)


def _phrases(rows, least, top):
    f, n, out = defaultdict(Counter), Counter(), []
    for t, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, own in f.items():
        told = {p: c for p, c in own.items() if c >= least}
        rows = []
        for p, a in told.items():
            if len(p) > 1 and not any(len(q) > len(p) and told[q] >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q in told):
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def test_collocations_against_counting(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD_CHUNKS", 7)
    monkeypatch.setattr(phrases, "HELD_GRAMS", 50)
    rng = random.Random(6)
    fixed = ["one Two three four five six", "été à la", "x y", "a\x00b c"]
    rows = []
    for i in range(120):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 12))) for _ in range(9)]
        rows.append((rng.choice(" .,;!?\n\t").join(parts) + rng.choice(["", ".", " ;; "]), rng.choice(["en", "fr", None])))
    rows += [(None, "en"), ("", "en"), (" .\n", None), ("word " * 3000, "de"), rows[0], rows[0]]
    docs = spark.createDataFrame([(t, g, 1, "p", 2) for t, g in rows], "text string, lang string, n int, phrase string, key int")
    for least, top in ((3, 25), (20, 2000)):
        want = _phrases(rows, least, top)
        assert want and sorted(map(tuple, phrases.collocations(docs, least, top).collect())) == want
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_chunks_count_each_phrase_start_once():
    rng = random.Random(1)
    for _ in range(50):
        words = [str(rng.randrange(30)) for _ in range(rng.randrange(1, 200))]
        for k in range(1, 6):
            got = Counter()
            for _, _, chunk, starts in phrases.chunks([" ".join(words).encode()]):
                w = chunk.decode().split()
                got.update(tuple(w[i : i + k]) for i in range(min(starts, len(w) - k + 1)))
            assert got == Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_ngram_jaccard_join", "op13_phrase_collocations"])
def test_queries_match_their_sql(spark, name):
    columns, want = duck(SF, registry.oracle_sql()[name])
    assert spark_rows(registry.queries()[name](spark, SF)) == (columns, want) and want


def test_jaccard_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    sets, held, links = _sets(rows), defaultdict(list), []
    for i, s in sets.items():
        for g in s:
            held[g].append(i)
    shared = Counter(p for own in held.values() if len(own) <= 300 for p in combinations(own, 2))
    for (a, b), _ in shared.items():
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            links.append((a, b))
    want = sorted((i, len(sets[i]), c) for i, c in _closed(sets, links).items())
    assert sorted(map(tuple, registry.queries()["op12_ngram_jaccard_join"](spark, SF).collect())) == want
