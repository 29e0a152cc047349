"""Operators against brute force on small tables with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from candlemill.llm import components, decontam, lines, passages, pii, quality, simhash, urls, warc

SPACES = r"[^\x20\x09-\x0D]+"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "Tea", "écru", "ÉTÉ", "of", "x1", "gamma", "delta", "Ωmega", "no", "so"])
    out = [" ".join(word() for _ in range(rng.choice([1, 3, 9, 60, 200]))) for _ in range(40)]
    for _ in range(12):  # near copies
        w = out[rng.randrange(40)].split()
        w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [None, None, "", " \n\t", "a", out[3], out[3], "loop " * 20000, "A\x00b, c-d\x7fe 日本 ".strip() * 3]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x", f"s{i % 12}", 7, i) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "orphan text of no id", "x", None, 7, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp long, key long")


def test_simhash(docs):
    def brute(t):
        w = re.findall(SPACES, lower(t))
        g = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r.doc_id, brute(r.text)) for r in docs.collect()]
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for i, f in rows:
        if i is not None:
            least[find(f)].append(i)
    want = Counter((i, f, min(least[find(f)], default=None)) for i, f in rows)
    got = simhash.near_duplicates(docs)
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got.collect()) == want
    kept = Counter(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == Counter(i for i, f in rows if i is None or i == min(least[find(f)]))


def test_large_bucket_keeps_components(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(400):
        x = rng.choice(sorted(prints))
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    links = simhash.variants(fps).repartition("key").sortWithinPartitions("key").mapInArrow(simhash._bucket_links, "u long, v long").collect()
    root = {x: x for x in prints}

    def find(r, x):
        while r[x] != x:
            x = r[x]
        return x

    got, mask = dict(root), (1 << 64) - 1
    for u, v in links:
        assert ((u ^ v) & mask).bit_count() <= 4
        got[find(got, u & mask)] = find(got, v & mask)
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4:
                root[find(root, a)] = find(root, b)
                assert find(got, a) == find(got, b)
    assert len({find(got, x) for x in prints}) == len({find(root, x) for x in prints})


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    got = dict(map(tuple, components.connected_components(links).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.connected_components(links.where("u < 0")).count() == 0


def test_decontamination(spark, docs, texts):
    items = [(1, texts[3]), (2, "gamma delta"), (3, "so"), (10, None), (11, "..."), (None, "the tea"), (12, " ".join((texts[10] or "").split()[:15])), (1, "x1 x1 x1")]
    got = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        w = find(t)
        n = min(10, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(str(i))
    for r in got.collect():
        w = find(r.text)
        hit, own = set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    own |= found
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(own), bool(hit)), r.doc_id
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
    clash = spark.createDataFrame([(1, texts[3], "a", 5)], "doc_id long, text string, key string, n_hit int")
    (r,) = decontam.contamination(clash, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert r.key == "a" and r.n_hit == r.n_words == 1
    none = spark.createDataFrame([], "doc_id long, text string")
    assert decontam.contamination(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.drop_contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == docs.count()


def test_quality_counts(spark, docs):
    labels = spark.createDataFrame([(i, i % 3 and 1, 0) for i in range(50)] + [(1, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for r in quality.verdict(docs, labels).collect():
        t = r.text or ""
        w = re.findall(SPACES, t)
        seen, dup = set(), 0
        for x in t.split("\n"):
            if re.search(SPACES, x):
                dup += x in seen
                seen.add(x)
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover))
        assert tuple(r[x] for x in quality.COUNTS) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.kept and r.base_failed)
    empty = spark.createDataFrame([], docs.schema)
    assert quality.keep_good(empty, labels).columns == docs.columns and quality.keep_good(empty, labels).count() == 0


def test_line_dedup(spark):
    rows = [(i, f"own line {i}\nSubscribe now\nmore of {i}", f"s{i % 10}", 1) for i in range(40)]
    rows += [(100 + i, "copied one\ncopied two\ncopied three", f"s{i % 10}", 1) for i in range(40)]
    rows += [(200, None, None, 1), (201, "", "s1", 1), (202, "Subscribe now", "s2", 1)]
    rows += [(203, "long " * 60_000 + "\nSubscribe now", "s3", 1)]
    given = spark.createDataFrame([(*r, "l", 1, 9) for r in rows], "doc_id long, text string, source string, n_chars long, line string, bad int, n_removed int")
    out = lines.dedup_lines(given)
    rows_out = out.collect()
    assert {r.line for r in rows_out} == {"l"} and {r.bad for r in rows_out} == {1} and rows_out[0].n_removed in (0, 1)
    got = {r.doc_id: r.text for r in rows_out}
    want = {i: None if t is None else "\n".join(x for x in t.split("\n") if x != "Subscribe now") for i, t, _, _ in rows}
    assert got == want
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")).count() == 0


def test_pii_finds_seeds_and_learns_contexts(spark):
    def check(n):
        return sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(str(n))))) * 9 % 10

    card = ["4111 1111 1111 1111", *(f"{n}{check(n)}" for n in range(411111111111200, 411111111111220))]
    rows = [(100 + i, f"😀 card no {c} paid, mail a{i}@x.org or +1 (212) 555-01{i:02}", "k") for i, c in enumerate(card)]
    rows += [(50, "card no 4111111111111112 declined", "k"), (51, None, "k"), (52, "", "k"), (53, "1.2.3.4 999.1.1.1 a@b@c.de x_y@z.q_w@e.r " + "9" * 5000, "k"), (53, "1.2.3.4 999.1.1.1 a@b@c.de x_y@z.q_w@e.r " + "9" * 5000, "k")]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect()}
    assert all(got[100 + i].n_card == got[100 + i].n_email == got[100 + i].n_phone == 1 for i in range(len(card))) and got[100].spans.startswith("card:10:29,email:")
    assert got[50].n_card == 0 and got[50].spans == "card:8:24"
    assert got[51].spans == got[52].spans == "" and got[51].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[53].n_ip == 1 and got[53].n_email == 3 and got[53].n_card == 0


def test_pii_learns_forms_that_no_base_pattern_has(spark):
    rows = [(i, f"write to me under mail: a{i}@x{i}.org today or ring phone +49 30 1234{i:03} {'now' if i % 2 else 'then'}", "k", 5) for i in range(30)]
    rows += [(100, "ring phone (030) 555-0199 please", "k", 5), (101, "under mail: jane at example dot org if you like", "k", 5), (102, "page 17 of 20 and room 12b", "k", 5), (103, "x " * 30_000 + "phone 030 555 0188", "k", 5)]
    rows += [(104, "x" * 100_000 + " 1", "k", 5)]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string, key string, n_email int")).collect()}
    assert got[0].n_email == 1 and got[0].n_phone == 1 and got[0].asDict().keys() == {"doc_id", "text", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}
    assert got[100].spans == "phone:11:25" and got[100].n_phone == 0
    assert got[101].spans == "email:12:35" and got[102].spans == "" and got[103].spans == "phone:60006:60018" and got[104].spans == ""
    none = pii.digest(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0


def test_pii_base_spans_against_brute_force(spark, docs, texts):
    more = ["+1 (212) 555-0101 4111 1111 1111 1111 4111111111111112", "a@b.c.d@e.f 1.2.3.4.5.6.7.8 300.1.1.1", "x+1 22-3 4..5 6789012345", "\U0001f600 a.b@c-d.e-f 00000000000000000000 0000000000000", "+1 +2 3456789012 .a@b.co. 01.002.0255.4"]
    given = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *more])], "doc_id long, text string")
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(kind, m):
        d = [int(c) for c in m if c in "0123456789"]
        luhn = sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    for r in pii.digest(given).collect():
        own = [(m.start(), list(patterns).index(k), f"{k}:{m.start()}:{m.end()}") for k, p in patterns.items() for m in re.finditer(p, r.text or "") if holds(k, m[0])]
        assert r.base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(own)).encode()).hexdigest(), r.doc_id
        assert [r[f"n_{k}"] for k in patterns] == [sum(x[2].startswith(k) for x in own) for k in patterns]


def test_urls(spark):
    rows = [(0, "http://A.Example.org/es/1?q"), (1, "https://x.com/fr/"), (2, "https://x.com/de/2#t"), (3, "y.net/de"), (4, None), (5, "http://b.org"), (6, "ftp://example.org/en/12"), (7, "http://bad.net/1"), (7, "http://bad.net/1")]
    labels = [(7, 0, 1)] * 3 + [(k, 1, 0) for k in range(5)]
    pages = spark.createDataFrame(rows + [(100 + k, "http://bad.net/x") for k in range(40)], "page_id long, url string")
    labels += [(100 + k, 0, 0) for k in range(40)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1][2:] == ("com/fr/", "allow") and got[2][2:] == ("com/de/", "block")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5] == ("b.org", "", None, "allow") and got[6][2:] == ("example.org/en/1", "block")
    assert got[7] == ("bad.net", "/1", None, "block")
    none = urls.judge(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.verdict for r in none.where("rule is null").collect()} == {"allow"}


def test_warc_round_trip(spark):
    big = "é" * 700_000
    rows = [(1, "http://a/%\r\n", big), (2, "http://b", big), (3, None, None), (4, "u", ""), (5, "u", "s" * 999), (6, "u", "s" * 999), (7, "v", "WARC/1.1\r\n\r\n" * 200), (None, "n", "z" * 2000), (9, "n", "z" * 2000)]
    rows += [(10 + i, "u", f"{i}" * 1200) for i in range(30)]
    pages = spark.createDataFrame([(*r, "k", 0) for r in rows], "page_id long, url string, html string, key string, n int")
    archives = warc.write_archives(warc.records(pages, chunk_bytes=50_000), file_bytes=1000)
    chunks = defaultdict(list)
    for r in warc.read_archives(archives).collect():
        chunks[r.page_id].append(r)
    for i, url, t in rows:
        own = sorted(chunks[i], key=lambda r: r.chunk_no)
        data = (t or "").encode()
        assert own[0].url == url and (own[0].payload_bytes, own[0].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        if i in (1, None):
            assert own[0].record_type == "revisit" and own[0].refers_to == {1: 2, None: 9}[i]
        else:
            assert own[0].record_type == "response" and b"".join(r.chunk for r in own) == data and own[-1].digest_so_far == own[-1].payload_digest
            assert max(len(r.chunk) for r in own) <= warc.CHUNK_BYTES
    assert archives.count() > 2
    tasks = warc.read_archives(archives, keep_chunks=False).select(warc.F.spark_partition_id()).distinct().count()
    assert tasks > archives.count() / 2
    assert warc.read_archives(warc.write_archives(warc.records(spark.createDataFrame([], "page_id long, url string, html string")))).count() == 0


def exact_links(own, n=50):
    """Pairs of documents that share n equal words, and the words of each that an earlier document shares in such spans."""
    where, links, words = defaultdict(list), set(), defaultdict(set)
    for i in sorted(own):
        for k in range(len(own[i]) - n + 1):
            held = where[tuple(own[i][k : k + n])]
            if held and held[0] < i:
                words[i].update(range(k, k + n))
            links |= {(i, j) for j in held if j != i}
            if i not in held:
                held.append(i)
    return links, words


def linked(rows, links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in rows:
        root[find(r.doc_id)] = find(r.other_id)
    return all(find(a) == find(b) for a, b in links)


def similar(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


@pytest.mark.parametrize("hot", [False, True])
def test_passages(spark, monkeypatch, hot):
    if hot:  # every seed that two documents hold is dealt over salts
        monkeypatch.setattr(passages, "SAMPLE", 1)
        monkeypatch.setattr(passages, "HOT_LEAST", 2)
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared = words(70)
    edited = [w if k % 23 else "zz" for k, w in enumerate(shared)]
    rows = [(i, " ".join(words(100) + (shared if i % 2 else edited) + words(40)), i, i) for i in range(10)]
    rows += [(20 + i, " ".join(words(300)), 0, 0) for i in range(10)] + [(40, None, 0, 0), (41, "", 0, 0), (None, rows[0][1], 0, 0), (0, rows[0][1], 0, 0)]
    rows += [(50, " ".join(words(9000)), 0, 0), (51, "x", 0, 0)]
    rows.append((52, rows[-2][1], 0, 0))
    loose = [" ".join(words(5)) for _ in range(5)]  # phrases in common 35 words apart are no passage
    rows += [(60 + i, " ".join(p + " " + " ".join(words(35)) for p in loose), 0, 0) for i in range(6)]
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string, seed int, doc int")).collect()
    own = {i: t.lower().split() for i, t, _, _ in rows if i is not None and t is not None}
    assert {r.doc_id for r in got} | {r.other_id for r in got} == {*range(10), 50, 52}
    assert all((r.start_word, r.end_word) == (0, 9000) for r in got if r.doc_id == 52)
    assert all(98 <= r.start_word <= 102 and 168 <= r.end_word <= 172 for r in got if r.doc_id < 10)
    for r in got:
        if r.doc_id < 10:
            assert abs(r.similarity - similar(own[r.doc_id][r.start_word : r.end_word], own[r.other_id][r.other_start : r.other_end])) < 1e-9
    links, _ = exact_links(own)
    assert links and linked(got, links)
    assert passages.passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_with_differing_neighbours(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    one, two = words(60), words(60)
    parts = {1: one[:30], 7: one[:30], 2: one[30:], 8: one[30:], 5: one, 9: one, 11: two, 12: [*two, *words(30), *two]}
    own = {i: words(80) + p + words(40) for i, p in parts.items()}
    own[13] = ["loop"] * 400
    own[14] = ["loop"] * 300
    got = passages.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in own.items()], "doc_id long, text string")).collect()
    links, spans = exact_links(own)
    assert linked(got, links)
    for i, want in spans.items():
        covered = {k for r in got if r.doc_id == i for k in range(r.start_word, r.end_word)}
        assert covered >= want, i
    assert {(r.doc_id, r.other_id) for r in got} == {(9, 5), (12, 11), (14, 13)}


def test_passages_of_the_table_against_brute_force(spark):
    """Exact 50-word links of sf0.01: all are held by components, and the words that they cover are covered."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.select("doc_id", "text").collect()}
    got = passages.passages(docs).collect()
    links, spans = exact_links(own)
    pairs = {(r.doc_id, r.other_id) for r in got}
    assert len(links) > 50 and linked(got, links)
    lost = sum(len(want - {k for r in got if r.doc_id == i for k in range(r.start_word, r.end_word)}) for i, want in spans.items())
    assert lost <= 0.01 * sum(map(len, spans.values())), lost
    assert all(r.similarity >= 0.8 and min(r.end_word - r.start_word, r.other_end - r.other_start) >= passages.RUN for r in got) and pairs


def test_passages_do_not_hang_on_the_session(spark, monkeypatch):
    """The same rows under any number of shuffle partitions, hot seeds included, and the recall of planted edited passages."""
    monkeypatch.setattr(passages, "SAMPLE", 1)
    monkeypatch.setattr(passages, "HOT_LEAST", 4)
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(20_000)}" for _ in range(n)]
    rows, family = [], {}
    for f in range(30):
        base, every = words(120), (40, 25, 15)[f % 3]
        for _ in range(6):
            at = rng.randrange(every)
            own = [w if k % every != at else words(1)[0] for k, w in enumerate(base)]
            family[len(rows)] = f
            rows.append((len(rows), " ".join(words(rng.randrange(60)) + own + words(rng.randrange(60)))))
    rows += [(1000 + k, " ".join(words(200))) for k in range(60)]
    docs, got = spark.createDataFrame(rows, "doc_id long, text string"), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("8", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, passages.passages(docs).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
    assert all(family.get(r[0]) == family.get(r[3]) is not None for r in got[0])
    root = dict(zip(family, family))
    for r in sorted(got[0]):
        a, b = (min(root[r[0]], root[r[3]]), max(root[r[0]], root[r[3]]))
        root = {i: a if x == b else x for i, x in root.items()}
    pairs = [(i, j) for i in family for j in family if i < j and family[i] == family[j]]
    for every in range(3):
        own = [(i, j) for i, j in pairs if family[i] % 3 == every]
        assert sum(root[i] == root[j] for i, j in own) >= 0.95 * len(own), every


def test_chain_against_all_pairs(monkeypatch):
    import numpy as np

    monkeypatch.setattr(passages, "SLACK", 0)
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(2, 30))
        at = sorted({(int(a), -int(b)) for a, b in zip(rng.integers(0, 60, n), rng.integers(0, 60, n))})
        x, y = np.array([a for a, _ in at]), np.array([-b for _, b in at])
        best, weight = [], []
        for i in range(len(x)):
            steps = [x[i] - x[j] for j in range(i) if x[i] - x[j] == y[i] - y[j]]
            weight.append(min(min(steps), passages.WINDOW) if steps and min(steps) <= passages.MAX_GAP else passages.GRAM)
            before = [best[j] - passages.GAP_COST * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            best.append(weight[i] + max([0, *before]))
        got = passages.chain(x, y)
        assert sorted(i for own in got for i in own) == list(range(len(x)))
        assert all((np.diff(x[own]) > 0).all() and (np.diff(y[own]) > 0).all() for own in got)
        first = got[0]
        cost = sum(x[j] - x[i] + y[j] - y[i] for i, j in zip(first, first[1:]))
        assert len(got) == 1 or abs(sum(weight[i] for i in first) - passages.GAP_COST * cost - max(best)) < 1e-9


def test_word_distance_against_the_table():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 80))] for _ in range(2))
        if a or b:
            assert abs(1 - passages.distance(a, b) / max(len(a), len(b)) - similar(a, b)) < 1e-9


def test_line_dedup_of_blocks(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    block = ["licensed under terms", "keep this notice", "no warranty given"]
    own = [words(60) for _ in range(12)]
    rows = [(i, "\n".join([t, *block, words(50)]), f"s{i}") for i, t in enumerate(own)]
    page = [words(70) for _ in range(3)]  # near copies of one page on as many sites
    rows += [(100 + i, "\n".join([page[0], page[1], page[2] + f" x{i}"]), f"s{i}") for i in range(12)]
    rows += [(200 + i, "\n".join([words(60), *block[:1], "on seven sites", words(50)]), f"s{i % 7}") for i in range(12)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: "\n".join(x for x in t.split("\n") if x not in block) for i, t, _ in rows}


def test_unlabelled_hosts_fall_back(spark):
    hosts = [f"{h}.bad.com" for h in "abcdef"] + [f"{h}.good.com" for h in "abcdef"]
    rows = [(k, f"http://{hosts[k % 12]}/{k}") for k in range(480)]
    labels = [(k, int("good" in u), 0) for k, u in rows]
    rows += [(1000, "http://new.bad.com/"), (1001, "http://new.good.com/"), (1002, "http://other.com/"), (1003, "http://far.net/"), (1004, None)]
    judged = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.page_id: (r.verdict, r.rate) for r in judged.collect()}
    assert len(got) == len(rows) and got[0][0] == "block" and got[6][0] == "allow"
    assert got[1000][0] == "block" and got[1000][1] > 0.9
    assert got[1001][0] == "allow" and got[1001][1] < 0.1
    assert [got[k][0] for k in (1002, 1003, 1004)] == ["allow"] * 3 and got[1003][1] == got[1004][1] == 0.5


def test_beta_probability(spark):
    import numpy as np

    cases = [(0.03, 2.0), (0.5, 0.5), (1.0, 1.0), (3.0, 7.5), (40.2, 20.1), (900.0, 850.0), (5000.0, 4900.0), (1.5, 0.02), (8010.0, 11_980.0), (8030.0, 11_985.0), (40_300.0, 59_900.0), (1.0, 40_000.0)]
    df = spark.createDataFrame(cases, "a double, b double")
    z = np.linspace(-1000, 1000, 8_000_001)
    from math import lgamma, log
    for r in df.select("a", "b", urls.beta_cdf(urls.F.col("a"), urls.F.col("b"), 0.4).alias("p")).collect():
        if r.a + r.b > 10_000:  # as a binomial tail
            n = int(r.a + r.b) - 1
            tail = sum(np.exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(0.4) + (n - k) * log(0.6)) for k in range(int(r.a), n + 1))
            assert abs(tail - r.p) < 1e-6, r
            continue
        density = r.a * -np.logaddexp(0, -z) + r.b * -np.logaddexp(0, z)
        w = np.exp(density - density.max())
        assert abs(w[z <= np.log(0.4 / 0.6)].sum() / w.sum() - r.p) < 1e-3, r


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.example.com": ("com", "example.com"), "example.com": ("com", "example.com"), "1.2.3.4": ("1.2.3.4",) * 2, "u@h.a.org:80": ("org", "a.org"), "de": ("de", "de"), "a.b.de.": ("de", "b.de")}
    keys = urls._keys(urls.F.col("h"))
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", keys["suffix"].alias("s"), keys["domain"].alias("d")).collect()
    assert {r.h: (r.s, r.d) for r in got} == hosts


def test_url_filter_sql(spark, tmp_path):
    """Hosts that the posterior blocks, and unlabelled ones, against the query's SQL."""
    from candlemill.llm.registry import oracle_sql
    from tests.oracle import duck, spark_rows

    rng = random.Random(8)
    hosts = [f"{w}.{d}.{s}" for s in ("net", "co.uk", "io") for d in ("good", "bad", "odd") for w in ("a", "b", "c", "d")]
    rows = [(k, f"https://{hosts[k % 36]}/p/{k}?q") for k in range(1500)] + [(2000 + k, f"http://{h}/") for k, h in enumerate(("new.bad.net", "e.bad.io", "x.else.net", "far.away.xyz", "Example.ORG"))] + [(3000, None), (3001, "no"), (None, "http://a.bad.net/")]
    fails = lambda u: rng.random() < (0.9 if ".bad." in u else 0.5 if ".odd." in u else 0.02)
    labels = [(k, 1 - f, 0) for k, u in rows[:1500] if k % 3 for f in [int(fails(u))]] + [(5, 0, 1), (None, 0, 1)]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    columns, want = duck(str(tmp_path), oracle_sql()["op8_url_filter"])
    got_columns, got = spark_rows(urls.op8_url_filter(spark, str(tmp_path)))
    assert got_columns == columns and got == want
    blocked = {r[0] for r in want if r[-1] == "block"}
    assert any(".bad." in h for h in blocked) and not any(".good." in h for h in blocked) and "new.bad.net" in blocked
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, host string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_line_dedup_query_against_brute_force(spark):
    from tests.llm import brute

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for least in (8, 3):
        bad = brute.boilerplate([r[1:] for r in rows], least)
        got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(docs, min_sites=least).collect()}
        want = {i: (brute.strip_lines(t, bad), sum(x in bad for x in (t or "").split("\n"))) for i, t, _ in rows}
        assert got == want and (least == 8 or bad)


def test_quality_query_against_brute_force(spark):
    from tests.llm import brute

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    want, least = brute.quality([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    got = quality.verdict(docs.select("doc_id", "text"), labels).collect()
    assert len(got) == len(want) and {r.kept for r in got} == {True, False}
    for r in got:
        failed, score = want[r.doc_id]
        assert r.base_failed == failed and abs(r.score - score) < 1e-9 and r.kept == (not failed and score >= least)


def test_simhash_query_against_brute_force(spark):
    from tests.llm import brute

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    prints = {i: brute.simhash(t) for i, t in rows}
    of, least = brute.components(prints.values()), {}
    for i, f in prints.items():
        least[of[f]] = min(i, least.get(of[f], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (f"{f:016x}", least[of[f]]) for i, f in prints.items()}
