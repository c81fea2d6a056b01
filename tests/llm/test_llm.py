"""The training-data operators against brute force on small tables, with their edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from figmill.llm import license_scan, line_dedup, mixing, mtree, packing, quality_forest, setsketch, sharding, toxicity, url_filter
from figmill.llm.common import components
from figmill.llm.queries import LISTED_HOSTS, URL_RULES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, n string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"])[i % len(sources or ["a"])], len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGE = [None, "", " ", "one", "one two", "A a", "same text here\nagain", "same text here\nagain", "é ü ß 😀", "x" * 30000, "word " * 5000]


def empty(spark):
    return spark.createDataFrame([], DOCS)


# sharding


def test_shards_are_even_and_slots_gapless(spark):
    rng = random.Random(1)
    texts = EDGE + [prose(rng, rng.randrange(1, 60)) for _ in range(300)] + ["hot copy of a text"] * 200
    rows = sharding.shard(docs_of(spark, texts), shards=6).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    size = {i: len((t or "").encode()) + 8 for i, t in enumerate(texts)}
    assert all(r["size"] == size[r["doc_id"]] and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    ideal = sum(size.values()) / 6
    total = Counter()
    for r in rows:
        total[r["shard"]] += r["size"]
    assert max(total.values()) <= ideal + max(size.values())


def test_equal_texts_share_a_shard_where_tolerance_allows(spark):
    texts = [f"text number {i // 2}" for i in range(400)]
    rows = sharding.shard(docs_of(spark, texts), shards=4, tolerance=0.05).collect()
    place = defaultdict(set)
    for r in rows:
        place[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for v in place.values())


def test_shard_edge_tables(spark):
    assert sharding.shard(empty(spark)).count() == 0
    same = spark.createDataFrame([(1, "a")] * 50 + [(None, None)] * 3, "doc_id long, text string")
    rows = sharding.shard(same, shards=5).collect()
    assert len(rows) == 53 and max(Counter(r["shard"] for r in rows).values()) <= 12


# url filter


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    listed = any(host == x or host.endswith("." + x) for x in (f"{h}.example.com" for h in LISTED_HOSTS))
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "block" if listed else "allow")


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.EXAMPLE.com/en/7x?q#f", "http://a.example.com/en/8", "http://com/en/", "http://example.net/de/8", "http://xexample.net/de/8", "http://b.net/de/", "http://x.org/ES/", "http://x.org/es/?", "http://www.cheap-pills.example.com/", "http://notcheap-pills.example.com/", "ftp://h#://x/y", "http://h\n.com/en/", "http://é.com/en/"] * 3
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, row string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([(f"{h}.example.com", "") for h in LISTED_HOSTS], "host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules, listed).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), rules, listed).count() == 0
    none = url_filter.judge(pages, rules.limit(0), listed.limit(0)).collect()
    assert len(none) == len(urls) and {r["verdict"] for r in none} == {"allow"}


# licences


def test_licences(spark):
    notice = license_scan.TEMPLATES["GPL-3.0"]
    texts = EDGE + [notice, "x\n" + notice.upper() + "\nMIT", notice.replace("version 3", "version 2"), "All rights reserved", "all the rights are reserved by us"]
    got = {r["doc_id"]: (r["n_hits"], r["license"], r["dice"]) for r in license_scan.scan(docs_of(spark, texts)).collect()}

    def grams(text):
        w = re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda c: c[0].lower(), text)).split()
        return [" ".join(p) for p in zip(w, w[1:])] if len(w) > 1 else w

    for i, t in enumerate(texts):
        hits = []
        for line in (t or "").split("\n"):
            g = grams(line)
            scores = [(round(2 * len(set(g) & set(k)) / (len(g) + len(set(k))), 6), -n, name) for n, (name, k) in enumerate((a, grams(b)) for a, b in sorted(license_scan.TEMPLATES.items()))] if g else []
            hits += [max(scores)] if scores and max(scores)[0] >= 0.8 else []
        assert got[i] == ((len(hits), max(hits)[2], max(hits)[0]) if hits else (0, None, None))
    assert license_scan.scan(empty(spark)).count() == 0


def test_licences_inside_and_across_lines(spark):
    def words(text):
        return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda c: c[0].lower(), text)).split()

    grams = lambda w: [" ".join(p) for p in zip(w, w[1:])] if len(w) > 1 else w
    known = [(-n, name, set(grams(words(b)))) for n, (name, b) in enumerate(sorted(license_scan.TEMPLATES.items()))]

    def best(w):
        g = grams(w)
        return max((round(2 * len(set(g) & k) / (len(g) + len(k)), 6), n, name) for n, name, k in known) if g else (0, 0, "")

    def slow(text):
        hits, runs = [], [[]]
        for line in (text or "").split("\n"):
            b = best(words(line))
            if b[0] >= 0.8:
                hits.append(b)
                runs.append([])
            else:
                runs[-1] += words(line)
        n = len(hits)
        for w in runs:  # every window there is
            found = sorted((j, i, b) for i in range(len(w)) for j in range(i + 1, min(len(w), i + 40)) if (b := best(w[i : j + 1]))[0] >= 0.8)
            end = -1
            for j, i, b in found:
                hits.append(b)
                if i > end:
                    n, end = n + 1, j
        return (n, max(hits)[2], max(hits)[0]) if hits else (0, None, None)

    rng = random.Random(14)
    notices = list(license_scan.TEMPLATES.values())
    texts = ["Copyright (c) 2020 Example Inc. All rights reserved.", "The code on this page is Released under the MIT License. See below.", notices[2].replace(" General", "\nGeneral"), "All rights\nreserved", "rights all reserved", "all rights reserved. All rights reserved.\nAll rights reserved."]
    for _ in range(30):
        w = []
        for _ in range(rng.randrange(1, 3)):
            own = rng.choice(notices).split()
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(["of", "the", "license", "x", "code is"])
            w += prose(rng, rng.randrange(5)).split() + own
        texts.append("".join(x + rng.choice([" ", " ", " ", "\n"]) for x in w))
    got = {r["doc_id"]: (r["n_hits"], r["license"], r["dice"]) for r in license_scan.scan(docs_of(spark, texts)).collect()}
    assert got == {i: slow(t) for i, t in enumerate(texts)}
    assert [got[i][:2] for i in range(4)] == [(1, "All-Rights-Reserved"), (1, "MIT"), (1, "GPL-3.0"), (1, "All-Rights-Reserved")]
    one = {r["doc_id"]: r["n_hits"] for r in license_scan.scan(docs_of(spark, ["so x11 it\nis X11", "x11", "x1"]), {"X11": "X11"}).collect()}
    assert one == {0: 2, 1: 1, 2: 0}


# quality


def slow_statistics(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality(spark):
    rng = random.Random(2)
    good = [". ".join(prose(rng, 12) for _ in range(8)) for _ in range(200)]
    junk = [re.sub(" ", "%%% &&& ", prose(rng, 90)) for _ in range(40)]
    texts = EDGE + ["a b c a b c a b c\n\na b c\na b c", "a\x0bb\x0cc d"] + good + junk
    first = len(EDGE) + 2
    labels = spark.createDataFrame([(first + i, int(i < 200), 0) for i in range(0, 240, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality_forest.quality(docs_of(spark, texts), labels).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert tuple(rows[i][c] for c in quality_forest.BASE) == slow_statistics(t)
        n, repeated = rows[i]["n_words"], rows[i]["n_repeat_words"]
        assert rows[i]["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
    kept = [rows[first + i]["kept"] for i in range(240)]
    assert sum(kept[:200]) >= 185 and sum(kept[200:]) <= 16
    bare = quality_forest.quality(docs_of(spark, texts), labels.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in bare)
    assert quality_forest.quality(empty(spark), labels).count() == 0


# packing


def test_packing_round_trip(spark):
    rng = random.Random(3)
    texts = EDGE + ["<|endoftext|> is text"] + [prose(rng, rng.randrange(1, 900)) for _ in range(60)]
    rows = packing.pack(docs_of(spark, texts), tokenizer_path(), size=256, with_ids=True).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for i, text in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        ids = [x for p in parts for x in np.frombuffer(bytes(p["ids"]), "<u4").tolist()]
        assert ids == t.encode(text or "", add_special_tokens=False).ids + [2]
        assert all(p["length"] == 256 for p in parts[1:]) and [p["start"] for p in parts] == np.cumsum([0] + [p["length"] for p in parts])[:-1].tolist()
    for slots in by_sequence.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 256
    lengths = sorted((r["length"] for r in rows), reverse=True)
    bins = []
    for n in lengths:  # one by one best fit
        fits = [k for k, b in enumerate(bins) if b >= n]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= n
        else:
            bins.append(256 - n)
    assert len(by_sequence) == len(bins)
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0


def test_plan_places_all():
    rng = random.Random(4)
    for _ in range(20):
        counts = {rng.randrange(1, 65): rng.randrange(1, 500) for _ in range(rng.randrange(1, 30))}
        rows = packing.plan(counts, 64)
        placed, fill = Counter(), defaultdict(list)
        for length, a, b, seq, offset in rows:
            placed[length] += b - a
            for k in range(b - a):
                fill[seq + k].append((offset, length))
        assert placed == Counter(counts)
        for slots in fill.values():
            ends = [o + n for o, n in sorted(slots)]
            assert [o for o, _ in sorted(slots)] == [0, *ends[:-1]] and ends[-1] <= 64


# near-duplicates


def truth(texts, width, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sets, {i: find(i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rng = random.Random(5)
    base = prose(rng, 120, 5000).split()

    def variant(edits):
        w = list(base)
        for k in rng.sample(range(len(w)), edits):
            w[k] = f"e{rng.randrange(10**6)}"
        return " ".join(w)

    # a large group around one text: many members link with the base, others only with some, some with none
    group = [" ".join(base)] + [variant(rng.choice([1, 2, 3, 4, 6, 8, 9, 10, 12])) for _ in range(220)]
    chain = [variant(10)]
    for _ in range(6):
        w = chain[-1].split()
        w[rng.randrange(len(w))] = "zz"
        w[rng.randrange(len(w))] = "yy"
        chain.append(" ".join(w))
    texts = EDGE + group + chain + [prose(rng, 40) for _ in range(60)] + ["copy"] * 30
    got = {r["doc_id"]: r for r in setsketch.near_duplicates(docs_of(spark, texts), width, 80).collect()}
    sets, component = truth(texts, width, 80)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == component
    assert all(r["kept"] == (i == component[i]) for i, r in got.items())
    if width == 5:
        left = {r["doc_id"] for r in setsketch.deduplicate(docs_of(spark, texts)).collect()}
        assert left == {i for i in component if component[i] == i}


def test_near_duplicate_edges(spark):
    assert setsketch.near_duplicates(empty(spark)).count() == 0
    rows = spark.createDataFrame([(7, "a b c")] * 3 + [(None, "a b c"), (9, None), (9, None)], "doc_id long, text string")
    got = setsketch.near_duplicates(rows, 2, 80).collect()
    assert len(got) == 6 and sum(r["stays"] for r in got if r["n_shingles"]) == 1


def test_near_duplicates_of_repeated_rows_and_null_ids(spark, monkeypatch):
    rng = random.Random(13)

    def near_group(n):
        base = prose(rng, 120, 5000).split()
        out = [" ".join(base)]
        for _ in range(n):
            w = list(base)
            for k in rng.sample(range(len(w)), rng.choice([1, 2, 4, 6, 8])):
                w[k] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(w))
        return out

    ids, texts = [], []
    for i, t in enumerate(near_group(40)):  # every row three times
        ids += [i] * 3
        texts += [t] * 3
    for lacking in (2, 1):  # every other row, then all rows without an id
        for i, t in enumerate(near_group(12)):
            ids.append(None if i % lacking == 0 else 1000 + i)
            texts.append(t)
    _, component = truth(texts, 2, 80)
    named = defaultdict(list)
    for i, c in component.items():
        named[c] += [] if ids[i] is None else [ids[i]]
    held, common = [], setsketch._common

    def watched(*args):
        near, full = common(*args)
        held.append(full.groupBy("cid").count().filter("count > 1").count())
        return near, full

    monkeypatch.setattr(setsketch, "_common", watched)
    rows = spark.createDataFrame([(i, t) for i, t in zip(ids, texts)], "doc_id long, text string")
    got = setsketch.near_duplicates(rows, 2, 80).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((ids[i], min(named[c], default=None)) for i, c in component.items())
    assert sum(r["stays"] for r in got) == len(set(component.values())) and held == [0, 0]


def test_likelihood_keeps_similar_pairs():
    rng = np.random.default_rng(6)
    a = np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64))
    for share, stays in ((0.9, True), (0.8, True), (0.2, False)):
        k = int(2 * share / (1 + share) * len(a))
        b = np.unique(np.concatenate([a[:k], rng.integers(0, 1 << 63, len(a) - k).astype(np.uint64)]))
        ra, rb = setsketch.registers(a)[None, :], setsketch.registers(b)[None, :]
        assert setsketch.similar_enough(ra, rb, np.array([float(len(a))]), np.array([float(len(b))]), 0.8)[0] == stays
    assert (np.maximum(setsketch.registers(a[:400]), setsketch.registers(a[400:])) == setsketch.registers(a)).all()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (5, 5)], "a long, b long")
    got = dict(components(links).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(links.limit(0)).count() == 0


# toxicity


def test_toxicity(spark):
    rng = random.Random(7)
    texts, toxic = list(EDGE), [0] * len(EDGE)
    for i in range(700):
        bad = i % 5 == 0
        w = prose(rng, rng.randrange(5, 200), 3000).split()
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "Loser,", "trash", "vequaire"]))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs_of(spark, texts), labels).collect()}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [i for i in got if got[i]["held_out"]]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i]["predicted"] == toxic[i] for i in held)
    assert right >= 0.98 * len(held)
    assert {r["score"] for r in toxicity.score(docs_of(spark, EDGE), labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(empty(spark), labels).count() == 0
    # the labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, 1, t if zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(spark, texts), flipped).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_block_max_search_is_exact():
    rng = np.random.default_rng(8)
    for words, frequent in ((40, 8), (40, 0), (3000, 64)):
        vectors = [(np.zeros(0, np.int64), np.zeros(0))]
        for _ in range(300):
            t = np.sort(rng.choice(words, rng.integers(1, 30), replace=False))
            w = rng.random(len(t)) + 0.1
            vectors.append((t, w / np.sqrt(w @ w)))
        vectors += vectors[5:9]  # ties
        index = toxicity.Index(vectors, words, block=16, frequent=frequent)
        assert sorted(index.rows.tolist()) == list(range(len(vectors))) and np.diff(index.edges).max() <= 16
        skip = [np.array([i]) for i in range(60)]
        got = index.nearest(vectors[:60], 7, skip)
        for q, (t, w) in enumerate(vectors[:60]):
            cosines = []
            for i, (u, v) in enumerate(vectors):
                c = sum(a * v[list(u).index(x)] for x, a in zip(t, w) if x in u)
                cosines.append((-round(c, 6), i))
            want = [i for c, i in sorted(cosines) if c < 0 and i != q][:7]
            assert [i for _, i in got[q]] == want


def test_toxicity_scores_by_brute_force(spark):
    """TF-IDF over all terms, ties, cosines, votes and calibration, computed term by term."""
    rng = random.Random(17)
    texts, toxic = [None, "", "?!"], [0, 0, 0]
    for i in range(90):
        w = prose(rng, rng.randrange(3, 40), 120).split() + (["Idiot!"] if i % 3 == 0 else [])
        rng.shuffle(w)
        texts.append(" ".join(w))
        toxic.append(int(i % 3 == 0))
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic) if i % 4], "doc_id long, toxic int")
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[8])]  # a repeated row and one without an id
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    counts = [toxicity.term_counts(t) for _, t in rows]
    learn = [i for i in range(len(texts)) if i % 4 and zlib.crc32(str(i).encode()) % 5]
    space = {t for i in learn for t in counts[i]}
    bad, good = [i for i in learn if toxic[i]], [i for i in learn if not toxic[i]]
    weight = {}
    for t in space:
        a, b = sum(t in counts[i] for i in bad), sum(t in counts[i] for i in good)
        c, d = len(bad) - a, len(good) - b
        chi = (a * d - b * c) ** 2 * len(learn) / max((a + b) * (c + d) * len(bad) * len(good), 1)
        tie = chi**2 / (chi**2 + toxicity.HALF_CHI**2) if a * d > b * c else 0
        df = sum(t in x for x in counts)
        weight[t] = (math.log((1 + len(rows)) / (1 + df)) + 1) * (toxicity.LOOSE + (1 - toxicity.LOOSE) * tie)

    def vector(x):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in x.items() if t in space}
        norm = math.sqrt(sum(a * a for a in v.values())) or 1
        return {t: a / norm for t, a in v.items()}

    vectors = {i: vector(counts[i]) for i in learn}
    bare = [i for i in learn if not vectors[i]]
    prior = (sum(toxic[i] for i in bare) + 0.01) / (len(bare) + 1)

    def vote(v, own):
        near = sorted((-round(sum(a * vectors[i].get(t, 0) for t, a in v.items()), 6), i) for i in learn if i != own)[: toxicity.NEIGHBOURS]
        near = [(-c, i) for c, i in near if c < 0]
        p = (0.2 * prior + sum(c * toxic[i] for c, i in near)) / (0.2 + sum(c for c, _ in near))
        return math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6))), [i for _, i in near]

    x, y, a, b = np.array([vote(vectors[i], i)[0] for i in learn]), np.array([toxic[i] for i in learn]), 1.0, 0.0
    for _ in range(4000):  # plain descent on the same regularised loss
        p = 1 / (1 + np.exp(-(a * x + b)))
        a, b = a - 0.002 * (np.sum((p - y) * x) + a - 1), b - 0.002 * (np.sum(p - y) + b)
    for r, (i, _), c in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"])), sorted(rows, key=lambda r: (r[0] is None, r[0])), [vector(counts[k]) for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0]))]):
        z, near = vote(c, i)
        assert r["doc_id"] == i and [e["doc_id"] for e in r["evidence"]] == near
        assert abs(r["score"] - 1 / (1 + math.exp(-(a * z + b)))) < 2e-3


# mixing


def test_mixing(spark):
    rng = random.Random(9)
    texts = EDGE[:9] + [prose(rng, rng.randrange(1, 40)) for _ in range(900)]
    sources = ["a", "b", None, "a", "a", "c", "a", "tiny" if False else "b"]
    d = docs_of(spark, texts, sources)
    rows = mixing.plan(d).collect()
    assert len(rows) == len(texts)
    size, by = Counter(), defaultdict(list)
    for i, t in enumerate(texts):
        size[sources[i % 8]] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, want, full = sum(size.values()), {}, set()
    while True:
        left = total - sum(3 * size[s] for s in full)
        share = left / sum(weight[s] for s in order if s not in full)
        new = {s for s in order if s not in full and share * weight[s] > 3 * size[s]}
        if not new:
            break
        full |= new
    want = {s: 3.0 * size[s] if s in full else share * weight[s] for s in order}
    taken = Counter()
    for r in rows:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], want[r["source"]]) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= 40 for s in order)
    assert sorted(mixing.plan(d.repartition(7)).collect(), key=str) == sorted(rows, key=str)
    mixed = Counter(r["doc_id"] for r in mixing.mix(d).collect())
    assert mixed == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})
    assert mixing.mix(d).columns == d.columns
    assert mixing.plan(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    repeated = spark.createDataFrame([(1, "a b c", "s")] * 50 + [(2, "d e", "t")], "doc_id long, text string, source string")
    got = mixing.plan(repeated).collect()
    assert len(got) == 51 and max(r["copies"] for r in got) <= 3


# search


def test_mtree_search(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(600, 8)) * rng.random((600, 1))
    x[100:300] = x[100]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(601, None, 0), (650, [1.0, None] * 4, 0), (700, [float("nan")] * 8, 0), (None, [1.0] * 8, 0), (750, [0.5, 0.5], 0), (3, [2.0] * 8, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in mtree.nearest(table).orderBy("query_id", "rank").collect()]
    whole = [(i, [math.floor(256 * v) for v in r]) for i, r, _ in rows if i is not None and r is not None and all(v is not None and math.isfinite(v) for v in r)]
    want = []
    for q, v in sorted({i: v for i, v in whole if i % 50 == 0}.items()):
        scored = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in whole if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert got == want
    assert mtree.nearest(table.limit(0)).count() == 0
    few = mtree.nearest(table.filter("vec_id IN (50, 51)")).collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(50, 51)]


def test_mtree_large_values(spark):
    x = [[1e7, 3.0], [9e6, -1e6], [8e6, 1e3], [-5e6, 7.5], [1e200, 1.0], [0.0, 0.0], [3e5, 3e5]]
    table = spark.createDataFrame([(50 * i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = {50 * i: [math.floor(256 * a) for a in v] for i, v in enumerate(x) if max(v) < 1e100}
    whole = {i: v for i, v in whole.items() if sum(a * a for a in v) < 9.2e18}
    want = []
    for q, v in sorted(whole.items()):
        scored = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in whole.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert len(whole) == 6 and [tuple(r) for r in mtree.nearest(table).orderBy("query_id", "rank").collect()] == want


# names and numbers of rows


def test_operators_keep_clashing_columns(spark):
    from pyspark.sql import functions as F

    names = ["figmill_row", "figmill_gone", "figmill_times", "mix_row", "mix_copies", "gone", "drops", "near_row", "at", "hash"]
    texts = ["a line that stands in two documents and is long enough\nfirst", "a line that stands in two documents and is long enough\nsecond", prose(random.Random(3), 60), None, ""]
    docs = spark.createDataFrame([(i, t, "s", *[f"{c}{i}" for c in names]) for i, t in enumerate(texts)], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    docs = docs.repartition(3, F.rand(5))  # dealt anew by every scan
    for out in (setsketch.deduplicate(docs), mixing.mix(docs, most=1), line_dedup.clean(docs, short=True)):
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names)
    assert {r["doc_id"]: r["n_repeated"] for r in rows} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0}
    assert len(rows) == len(texts) and {r["text"] for r in rows if r["doc_id"] == 1} == {"second"}


def test_licences_without_templates(spark):
    assert [(r["n_hits"], r["license"]) for r in license_scan.scan(docs_of(spark, ["All rights reserved."]), {}).collect()] == [(0, None)]


# lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_pairs_and_verdicts(spark):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    base = ["".join(rng.choice("abcdé😀 ") for _ in range(rng.randrange(12, 30))) for _ in range(40)]
    lines = list(base)
    for _ in range(160):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(s))
            s[k : k + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        lines.append("".join(s))
    lines = [x for x in lines if len(x) >= 10]
    pairs = [(a, b) for a in lines[:60] for b in lines[::7]]
    near = line_dedup.near_pairs(spark.createDataFrame(pairs, "a string, b string"), 2).collect()
    assert sorted((r["a"], r["b"]) for r in near) == sorted(p for p in pairs if edits(*p) <= 2)
    d = docs_of(spark, ["\n".join(lines[i::20]) for i in range(20)]).withColumn("row", F.monotonically_increasing_id())
    got = {r["hash"]: r["near"] for r in line_dedup.judge_lines(d, edits=2, least=10).collect()}
    hashes = spark.createDataFrame([(x, n) for x, n in Counter(lines).items()], "line string, n int").withColumn("hash", line_dedup.line_hash(F.col("line"))).collect()
    key = {r["line"]: (-int(math.log2(r["n"])), r["hash"]) for r in hashes}
    for r in hashes:
        near = any(key[y] < key[r["line"]] and edits(r["line"], y) <= 2 for y in key)
        assert got.get(r["hash"]) == (near if near or r["n"] > 1 else None)


def test_clean_lines(spark):
    long = "this line is certainly longer than forty characters, it is"
    texts = [None, "", "short\nshort", f"{long}\nfirst", f"second\n{long}", f"{long}!\n{long}", "x" * 20000, "x" * 20000, f"{long}\n{long}"]
    got = {r["doc_id"]: r for r in line_dedup.clean(docs_of(spark, texts)).collect()}
    assert [got[i]["text"] for i in range(9)] == [None, "", "short\nshort", f"{long}\nfirst", "second", "", "x" * 20000, "", ""]
    assert got[5]["n_near"] == 1 and got[5]["n_repeated"] == 1 and got[0]["n_lines"] == 0 and got[1]["n_lines"] == 1
    assert line_dedup.clean(empty(spark)).count() == 0
    assert line_dedup.digest(docs_of(spark, texts)).count() == 9


def test_short_lines(spark, tmp_path):
    from figmill.llm.queries import QUERIES

    rng = random.Random(12)
    base = ["".join(rng.choice("abcdé😀 ") for _ in range(n)) + "." for n in (1, 3, 8, 17, 18, 19, 20, 25, 30, 37, 38, 39, 40, 45)]
    lines = base + base[:4] + [x[:-1] + "!" for x in base] + [x + "yz" for x in base] + [x[:5] + x[6:] for x in base[6:]]
    texts = ["\n".join(lines[i::5]) + "\n \n\n \n" for i in range(5)]
    docs = docs_of(spark, texts)
    from pyspark.sql import functions as F

    hashes = spark.createDataFrame([(x, n) for x, n in Counter(lines).items()], "line string, n int").withColumn("hash", line_dedup.line_hash(F.col("line"))).collect()
    key = {r["line"]: (-int(math.log2(r["n"])), r["hash"]) for r in hashes}
    near = {x: any(key[y] < key[x] and edits(x, y) <= min(2, min(len(x), len(y)) // 20) for y in key) for x in key}
    assert any(v and 20 <= len(x) < 40 for x, v in near.items())
    seen, want = set(), {}
    for i, text in enumerate(texts):
        left, repeated, gone = [], 0, 0
        for x in text.split("\n"):
            repeated += x in seen and not near[x]
            gone += near.get(x, False)
            left += [x] if not WORD.search(x) or x not in seen and not near[x] else []
            seen |= {x} if WORD.search(x) else set()
        want[i] = (repeated, gone, zlib.crc32("\n".join(left).encode()))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_repeated"], r["n_near"], r["text_crc32"]) for r in QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == want and sum(v[0] for v in want.values())


def test_toxicity_reads_the_terms_it_counts(monkeypatch):
    texts = ["Stupidly stupid STUPID stup ok ok", None, "", "...", "grüßendes grüß 漢字漢字漢字 stupor", "zz " * 5000 + "stupid"]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*map(toxicity.term_counts, texts[:1] + texts[4:]))))}
    for words in (100_000, 1):  # words met lately are forgotten
        monkeypatch.setattr(toxicity, "WORDS", words)
        model = toxicity.Model(vocabulary, np.ones(len(vocabulary)), None, np.zeros(0, np.int64))
        for text in [*texts, "unknown words", *texts]:
            terms, counts = model.read(text)
            want = {vocabulary[t]: n for t, n in toxicity.term_counts(text).items() if t in vocabulary}
            assert dict(zip(terms.tolist(), counts.tolist(), strict=True)) == want
            assert list(terms) == sorted(want)


def test_rows_of_a_table_are_numbered_in_place(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    from figmill.llm import common

    path = f"{tmp_path}/a table"
    spark.range(1000).selectExpr("id AS doc_id", "concat('row ', id % 7) AS text").repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    seen = []
    for size in ("128m", "1k"):  # the scan is split otherwise
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            before = set(os.listdir(common.scratch_root(spark).removeprefix("file://") + "/figmill"))
            rows, mark = common.numbered(docs.select("text", "doc_id"), "in-place")
            new = set(os.listdir(common.scratch_root(spark).removeprefix("file://") + "/figmill")) - before
            seen.append({r[mark]: r["doc_id"] for r in rows.collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(seen[0]) == 1000
    # only the files are saved, not the rows
    assert [spark.read.parquet(f"{common.scratch_root(spark)}/figmill/{x}").count() for x in new] == [5]
    # the same places however it is split; what is no plain scan is saved
    assert {k & ((1 << 40) - 1) for k in seen[0]} == set(range(200)) and sorted(seen[0].values()) == list(range(1000)) and seen[0] == seen[1]
    for other in (docs.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("x"), "doc_id"), docs.join(docs.select("doc_id"), "doc_id"), docs.withColumn("x", F.rand()), docs.limit(9)):
        rows, mark = common.numbered(other, "copied")
        assert rows.select(mark).distinct().count() == rows.count() == other.count()


def test_toxicity_index_is_not_made_by_the_driver(spark, monkeypatch):
    def here(*_):
        raise AssertionError("made by the driver")

    monkeypatch.setattr(toxicity.Index, "__init__", here)
    rng = random.Random(4)
    texts = [prose(rng, 20) + (" awful slur" if i % 3 == 0 else "") for i in range(90)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs_of(spark, texts), labels).collect()}
    assert sum(got[i] == (i % 3 == 0) for i in range(90)) >= 85


def test_quality_is_fitted_on_all_labelled_rows(spark):
    rng = random.Random(9)
    scores = [(round(rng.betavariate(5, 5), 3), rng.random() < 0.9) for _ in range(25_000)] + [(0.9 + i / 1000, i % 9 == 0) for i in range(60)]
    df = spark.createDataFrame(scores, "anomaly double, good boolean").repartition(5)
    goods = sum(g for _, g in scores)
    best, at = (-2.0, 0.0), sorted({s for s, _ in scores})
    for cut in at:
        lost = sum(g and s > cut for s, g in scores) / goods if cut > 0.7 else 1.0
        gain = sum(not g and s > cut for s, g in scores) / (len(scores) - goods) - lost if lost <= quality_forest.LOST_GOOD else -1.0
        best = max(best, (gain, cut))
    after = [s for s in at if s > best[1]][:1]
    assert abs(quality_forest.calibrated(df) - (best[1] + after[0]) / 2) < 1e-12
    # trees draw from all rows, whatever their place in one common order
    rows = spark.range(30_000).selectExpr("id AS doc_id", *[f"cast(100 + pmod(hash(id, {k}), 1000000) AS long) AS {c}" for k, c in enumerate(quality_forest.BASE + quality_forest.MORE)])
    parts = quality_forest.drawn(rows, quality_forest.BASE + quality_forest.MORE, 30_000)
    assert [len(p) for p in parts] == [quality_forest.TREE_ROWS] * quality_forest.TREES
    assert len({tuple(x) for p in parts for x in p}) > 0.8 * 30_000 * (1 - math.exp(-quality_forest.TREE_ROWS * quality_forest.TREES / 30_000))


def test_the_driver_gives_back_memory_that_it_no_longer_uses(spark):
    from figmill.llm import common

    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", open(f"/proc/{pid}/status").read())[1]) / 1024
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe, block = field.get(None), 100_000
    common.release(spark)
    before = held()
    at = [unsafe.allocateMemory(block) for _ in range(3000)]
    for x in at:
        unsafe.setMemory(x, block, 1)
    # the last block keeps the C library from giving back those before it
    for x in at[:-1]:
        unsafe.freeMemory(x)
    jvm.System.gc()
    kept = held()
    common.release(spark)
    left = held()
    unsafe.freeMemory(at[-1])
    assert kept > before + 200 and left < kept - 200


def test_near_duplicates_release_between_steps(spark, monkeypatch):
    from figmill.llm import common

    calls = []
    for module in (common, setsketch):
        monkeypatch.setattr(module, "release", lambda s: calls.append(s))
    rng = random.Random(6)
    texts = [prose(rng, 60) for _ in range(20)]
    got = setsketch.near_duplicates(docs_of(spark, [*texts, texts[0] + " more", texts[1]]).select("doc_id", "text")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] != r["component_id"]} == {20: 0, 21: 1}
    assert len(calls) >= 6
