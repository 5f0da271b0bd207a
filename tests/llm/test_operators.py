"""The ten operators on small tables: brute force, round trips, and rows that are hard to handle."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.llm import (decontaminate, gru_score, html_text, language_id, licenses, line_dedup, near_dedup, packing, passages,
                        vp_search)
from surety.llm.common import fold, importable, word_hashes, word_hashes_of, words
from surety.llm.graph import components
from surety.llm.queries import tokenizer_path

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
VOCAB = [f"w{n}" for n in range(900)]


def prose(seed: int, n: int = 120) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(VOCAB[i] + ("." if rng.random() < 0.1 else "") for i in rng.integers(0, len(VOCAB), n))


def edited(text: str, seed: int, share: float) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"x{rng.integers(10**9)}" if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, short, empty, null and very long texts, a line that many share, and repeated rows."""
    importable(spark)
    texts = [prose(n) for n in range(12)]
    texts += [texts[0]] * 5 + [edited(texts[1], n, 0.02) for n in range(6)] + [edited(texts[2], n, 0.2) for n in range(3)]
    texts += [None, "", " \n\t ", "Hi", "two words", "A b C", prose(99, 9000), "ÀÉ ß 東京 ﬁ́   x", "...", "|" * 50]
    shared = prose(500, 60)
    texts += [f"{prose(600 + n, 40)}\n  The Common Line \n{shared} {prose(700 + n, 30)}" for n in range(12)]
    rows = [(n, t, None if n % 7 == 0 else "en", "s", None if t is None else len(t)) for n, t in enumerate(texts)]
    rows += [rows[3], rows[-1], (None, "no id at all here", "en", "s", 3)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def plain(corpus):
    return [(r.doc_id, r.text) for r in corpus.collect()]


def lowered(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def clashing(df):
    """The table with extra columns under names that operators use themselves."""
    return df.withColumns({n: F.lit(1) for n in ("row_key", "bitmap_id", "keep_bitmap", "gone_id", "leak_id", "node", "label", "rejected", "_key", "pick", "row")})


def test_word_hashes_follow_words():
    text = " A b\tA\n\x0b longer-word\x0c b\r".encode()
    assert len(word_hashes(text)) == len(words(text)) == 5
    h = word_hashes(text).tolist()
    assert h[0] == h[2] and h[1] == h[4] and len(set(h)) == 3 and not len(word_hashes(b" \n"))


def test_components(spark):
    edges = [(n, n + 1) for n in range(0, 40) if n != 20] + [(50, 52), (52, 51), (7, 7), (60, 60), (3, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {n: got.get(n, n) for n in range(41)} == {n: 0 if n <= 20 else 21 for n in range(41)}
    assert (got.get(51), got.get(52)) == (50, 50) and 60 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_word_ids_equal_the_tokenizer_on_odd_texts(monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    odd = ["dog's", "dogs'", "it'll.", "don't!", "***", "a***", "x-y", "3.14", "İ", "ß.", "e\u0301te\u0301,", "été;", "ÉTÉ", "Σας", "ΣΑΣ", "ﬁn", "日本語。",
           "日本語.", "\u00a0", "a\u00a0b", "\u200b", "★", "★x", "•", "👍🏽", "ǅ", "x\u0307.", "K", "Å", "²", "١٢", "<|", "<|endoftext|>", "<|startoftext|>a",
           "\x00", "\x1c", "\x85", "tail\u2028", "q" * 300, "ab.,;:!?", "....", "'s", "'S", "A's.", "_x_", "`", "İstanbul,", "가각", "\u1100\u1161."]
    texts = ["", " ", None, *odd, *(rng.choice([" ", "\n", "\t ", "  "]).join(rng.choices(odd, k=rng.randint(1, 12))) for _ in range(400))]
    whole = Tokenizer.from_file(tokenizer_path())
    monkeypatch.setattr(packing, "_MEMORY", 20)            # words are forgotten and learned again
    coder = packing.WordIds(tokenizer_path())
    for _ in range(2):
        for low, n in packing.by_bytes(pa.array(texts), 500):
            part = texts[low:low + n]
            got = [np.frombuffer(x, "<u4").tolist() for x in coder.encode(pa.array(texts).slice(low, n), 1)]
            assert got == [whole.encode(t or "", add_special_tokens=False).ids + [1] for t in part]
    assert len(coder.known) <= 20
    runs = list(packing.by_bytes(pa.array(texts), 500))
    assert [low for low, _ in runs] == np.cumsum([0, *(n for _, n in runs)])[:-1].tolist() and sum(n for _, n in runs) == len(texts)


def test_packing_is_an_exact_round_trip(corpus, plain):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(clashing(corpus), tokenizer_path(), size=256).collect()
    want = Counter((d, tuple(coder.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in plain)
    pieces = defaultdict(list)
    for r in rows:
        pieces[(r.doc_id, r.doc_tokens)].append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
        assert len(bytes(r.ids)) == 4 * r.length
    got = Counter()
    for (doc, n), parts in pieces.items():
        parts.sort()
        copies = sum(s == 0 for s, _ in parts)
        whole = [i for k in range(0, len(parts), copies) for i in parts[k][1]]   # equal rows are cut alike or not at all
        if len(whole) == n:
            got[(doc, tuple(whole))] += copies
    assert sum(len(x) for p in pieces.values() for _, x in p) == sum(len(k[1]) * c for k, c in want.items())
    assert all(got[k] == c for k, c in want.items() if c == 1)
    ends = defaultdict(list)
    for r in rows:
        ends[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding < 0.1 * sum(r.length for r in rows)


def test_plan_is_the_cheapest_cut():
    def padding(n):
        return 0 if n in (4, 8, 16) else 32 - n

    rng = np.random.default_rng(1)
    for _ in range(30):
        spots = np.cumsum(rng.integers(1, 9, 40)).tolist()
        cost = rng.integers(0, 4, 40).tolist()
        best = [0.0] + [float("inf")] * 40
        for j in range(1, 41):
            for i in range(j):
                n = spots[j - 1] - (spots[i - 1] if i else 0)
                if n <= 32:
                    best[j] = min(best[j], best[i] + padding(n) + cost[j - 1])
        ends, at, total = packing.plan(spots, cost, 32), 0, 0
        for e in ends:
            total += padding(spots[e] - at) + cost[e]
            at = spots[e]
        assert total == best[40]


def test_near_duplicates_match_brute_force(corpus, plain):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(clashing(corpus), 2).collect()}
    sets = {}
    for d, t in plain:
        w = lowered(t)
        sets[d] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(map(tuple, [w])) if w else frozenset()
    root = {d: d for d in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for d in ids:
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (len(sets[d]), find(d), find(d) == d), d
    assert got[None].component_id is None and got[None].kept
    kept = near_dedup.deduplicated(corpus, 5)
    assert kept.columns == corpus.columns and kept.filter("doc_id is null").count() == 1
    assert kept.filter("doc_id in (12, 13, 14, 15, 16)").count() == 0


def test_members_of_open_buckets_lose_no_link(spark):
    """A chain of near copies whose ends are unlike, and many short texts around one frequent pair of words."""
    base = prose(7, 100).split(" ")
    chain = [" ".join([f"y{k}" if i < 6 * n and (k := i) % 2 == 0 else w for i, w in enumerate(base)]) for n in range(8)]
    texts = chain + [f"of the z{n}" for n in range(150)] + ["of the z3 end"] + ["of the"] * 3
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 2).collect()}
    sets = [frozenset(zip(t.split(), t.split()[1:])) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert [got[n] for n in range(len(texts))] == root


def test_prefix_join_is_exact(spark):
    rng = np.random.default_rng(3)
    groups = [rng.integers(1, 1 << 40, 60) for _ in range(4)]
    sets = []
    for n in range(60):
        own = groups[n % 4].copy()
        own[rng.random(60) < rng.uniform(0, 0.25)] = rng.integers(1, 1 << 40)
        sets.append(np.unique(own))
    rows = [(n, len(s), s.astype(np.uint64).tobytes()) for n, s in enumerate(sets)]
    stored = spark.createDataFrame(rows, "node long, n int, members binary")
    nodes = stored.select("node", F.col("node").alias("label"))
    found = {(r.u, r.v) for r in near_dedup._confirmed(near_dedup._prefix_pairs(nodes, stored, 80), stored, 80).collect()}
    want = {(a, b) for a in range(60) for b in range(a + 1, 60)
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert found == want and want


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("parts", [1, 7])
def test_line_dedup_matches_brute_force(spark, corpus, plain, keep, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        maps = line_dedup.keep_bitmaps(clashing(corpus), 10, 1, keep)
        got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digests(corpus, maps).collect())
        whole = line_dedup.apply_bitmaps(clashing(corpus), maps)
        assert whole.count() == corpus.count() and set(corpus.columns) < set(whole.columns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))

    holders = defaultdict(set)
    for d, t in plain:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    seen, want = set(), Counter()
    for d, t in sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, stay = (t or "").split("\n"), []
        for line in lines:
            k = key(line)
            common = len(k) >= 1 and len(holders[k]) >= 10
            if not common or (keep == "first" and k not in seen):
                stay.append(line)
            if common:
                seen.add(k)
        want[(d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())] += 1
    if keep == "none":
        assert got == want
    else:  # a row that repeats the first document repeats its first occurrence
        assert sum((got - want).values()) <= 1 and sum((want - got).values()) <= 1


def test_leaks_are_found_and_clean_texts_left(spark, corpus):
    rng = np.random.default_rng(9)
    items = [(n, " ".join(f"q{rng.integers(4000)}" for _ in range(8 + 3 * n))) for n in range(12)] + [(90, None), (91, ""), (92, " ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    leaks = [(1000 + n, f"{prose(800 + n, 90)} {t.upper()} {prose(900 + n, 70)}") for n, t in items[:12]]
    para = [(2000 + n, f"{prose(850 + n, 50)} {edited(t, n, 0.15)} {prose(950 + n, 50)}") for n, t in items[4:12]]
    docs = corpus.select("doc_id", "text").union(spark.createDataFrame(leaks + para, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(clashing(docs), bench).collect()}
    assert {(1000 + n, n) for n in range(12)} <= got and {d for d, _ in got} <= {d for d, _ in leaks + para}
    assert len({(2000 + n, n) for n in range(4, 12)} & got) >= 7
    left = decontaminate.cleaned(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in got})
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_many_items_before_a_busy_background(spark):
    """Passages full of the items' own frequent words must not push the items out of the latent space."""
    rng = np.random.default_rng(12)
    common = [f"c{n}" for n in range(300)]
    items = [(n, " ".join(rng.choice(common) if rng.random() < 0.4 else f"r{rng.integers(10**7)}" for _ in range(int(rng.integers(8, 50))))) for n in range(150)]
    noise = [(n, " ".join(rng.choice(common) if rng.random() < 0.5 else f"b{rng.integers(10**7)}" for _ in range(200))) for n in range(1500)]
    leaks = [(10_000 + n, f"{noise[n][1]} {t} {noise[n + 200][1]}") for n, t in items]
    docs = spark.createDataFrame(noise + leaks, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(10_000 + n, n) for n, _ in items}


def test_items_that_leak_often_or_hold_frequent_words_only(spark):
    """Items in 5 % and in 33 % of the documents, and one whose every word is frequent, are found in each copy."""
    rng = np.random.default_rng(21)
    texts = [[f"b{rng.integers(10**7)}" if rng.random() < 0.7 else f"f{rng.integers(12)}" for _ in range(100)] for _ in range(1200)]
    items = [(1, " ".join(f"q{n}" for n in range(16))), (2, " ".join(f"r{n}" for n in range(20))),
             (3, "f1 f5 f2 f7 f0 f3 f9 f4 f11 f8 f6 f10 f2 f1 f3 f0"), (4, " ".join(f"s{n}" for n in range(16)))]
    held = {(n, i) for n in range(1200) for i, on in ((1, n % 20 == 0), (2, n % 3 == 0), (3, n % 100 == 7)) if on}
    for n, i in sorted(held):
        texts[n][50:50] = dict(items)[i].split()
    texts[5][50:50] = edited(items[1][1], 1, 0.15).split()      # a near copy of the item that leaks most
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == held | {(5, 2)}


def test_items_of_any_length(spark):
    """Exact copies of items of 4, 5 and 600 words, also where a short item's words stand in many passages."""
    rng = np.random.default_rng(33)
    items = [(1, "k1 k2 k3 k4"), (2, "m1 m2 m3 m4 m5"), (3, " ".join(f"z{n}" for n in range(600)))]
    texts = [[f"b{rng.integers(10**7)}" for _ in range(80)] for _ in range(400)]
    for n, t in enumerate(texts):       # the words of the first item apart, each in a tenth of the documents
        t[40] = f"k{n % 10 % 4 + 1}"
    held = {(n, i) for i in (1, 2, 3) for n in range(10 * i, 10 * i + 3)}
    for n, i in held:
        texts[n][30:30] = dict(items)[i].split()
    texts[50][30:30] = ["m1", "m2", "m4", "m5"]                 # without the cosine a short item counts whole only
    texts[51][30:30] = dict(items)[3].split()[:250]             # less than the share asked for
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")

    def got(some):
        return {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, spark.createDataFrame(some, "item_id long, text string")).collect()}

    assert held <= got(items) <= held | {(50, 2)}
    assert {x for x in held if x[1] == 3} == got(items[2:])    # in a block of its own as well


def test_common_run():
    on = decontaminate.common_run(np.array([1, 2, 3, 4]), np.ones(4), np.array([9, 1, 9, 3, 2, 4]))
    assert on.sum() == 3 and on[0] and on[3]


def test_vantage_point_search(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 8))
    x[100:400] = x[100]                                       # one very common vector
    rows = [(n, v.tolist(), 1) for n, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [None] * 8, 1), (None, [1.0] * 8, 1),
             (1100, [1.0, 2.0], 1), (1101, [1.0, 3.0], 1), (1200, [float("inf")] + [0.0] * 7, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("shard", F.lit("x"))
    got = vp_search.neighbours(df, F.col("vec_id") % 100 == 0, 10, factor=1.0).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.vec_id, r.score))
    assert set(by) == {0, 100, 200, 300, 400, 500, 600, 1100}
    for q in range(0, 700, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        order = np.lexsort((np.arange(700), d))[:10]
        assert [v for v, _ in by[q]] == order.tolist() and np.allclose([s for _, s in by[q]], d[order])
    assert [v for v, _ in by[1100]] == [1101]
    assert vp_search.neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_main_text(spark):
    shape = ('<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>{}'
             '<footer>&copy; someone, all rights.</footer></body></html>')
    good = [f"Paragraph {n}, with several words &amp; a\n  second line: enough of it." for n in range(6)]
    body = "".join(f"<p>{g}</p>" for g in good)
    want = "\n".join(" ".join(g.replace("&amp;", "&").split()) for g in good)
    pages = [(n, "u", shape.format(f"<article><h1>T{n}</h1>{body}</article>")) for n in range(40)]
    model = html_text.train([p[2] for p in pages])
    hard = [shape.format(f"<div class='content'>{body}<script>var a='<p>no</p>'</script><!-- <p>no</p> --></div><div id=comments><div class=comment><p>Nice one, really.</p></div></div>"),
            shape.format(f"<main>{body}<form><p>Sign up, please.</p></form></main><aside class=sidebar><p>Other things, too.</p></aside>")]
    assert html_text.main_texts(hard, model) == [want, want]
    broken = ["", "<", "<p", "<p>x", "</p></div>", "<a <b <c>", '<p class="x>never closed', "<script>never closed", "<!-- never closed"]
    assert len(html_text.main_texts(broken, model)) == len(broken)
    rows = pages + [(100, None, None), (101, "u", ""), (None, "u", pages[0][2]), pages[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(df, html_text.fit(df)).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 44 and texts[100] == texts[101] == "" and texts[3].endswith(want)
    assert html_text.extract(df.limit(0), html_text.fit(df.limit(0))).count() == 0


def test_decoding_is_consistent():
    page = html_text.Page("<div><p>a</p><p>b</p></div><ul><li>c</li></ul>")
    odds = np.random.default_rng(0).normal(size=(200, len(page.parent)))
    for o in odds:
        taken = html_text.decode(page, o)
        assert all(taken[page.parent[i]] for i in range(1, len(taken)) if taken[i])


def test_language_id_on_held_out_rows(spark, corpus):
    lists = {"en": "the of and to in that is was for with house water", "de": "der die und den von zu mit sich auf für haus wasser",
             "fr": "le la les des une est pour que dans qui maison été"}
    rng = np.random.default_rng(2)
    rows = [(n, " ".join(rng.choice(w.split(), 30)), lang, "s", 1) for n, (lang, w) in enumerate(list(lists.items()) * 40)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(docs, fold("doc_id", 5) != 0)
    out = language_id.predict(clashing(docs).drop("rejected"), model).filter(fold("doc_id", 5) == 0)
    assert out.filter("lang = lang_pred").count() == out.count() > 10 and out.filter("score < 0 or score > 1").count() == 0
    odd = {r.doc_id: r for r in language_id.predict(spark.createDataFrame([(1, None), (2, ""), (3, "123 ... |"), (4, "und"), (5, "東京")], "doc_id long, text string"), model).collect()}
    assert [odd[n].lang_pred for n in (1, 2, 3)] == ["und"] * 3 and odd[4].lang_pred == "de" and odd[5].rejected
    kept = language_id.accepted(clashing(docs), model)
    assert kept.count() == docs.count() and kept.columns == clashing(docs).columns
    none = language_id.fit(docs.limit(0), fold("doc_id", 5) != 0)
    assert language_id.predict(docs.select("text"), none).filter("lang_pred <> 'und'").count() == 0


def test_odd_training_rows_do_not_open_the_rejection(spark, corpus):
    """One-word and junk rows among the training rows: unlearned scripts and gibberish are rejected, short texts are kept."""
    lists = {"en": "the of and to in that is was for with house water", "de": "der die und den von zu mit sich auf für haus wasser",
             "fr": "le la les des une est pour que dans qui maison été"}
    rng = np.random.default_rng(2)
    rows = [(n, " ".join(rng.choice(w.split(), 30)), lang, "s", 1) for n, (lang, w) in enumerate(list(lists.items()) * 40)]
    odd = ["qx", "zzkw vvq", "A."]
    rows += [(1000 + n, odd[n // 3], lang, "s", 1) for n, lang in enumerate(list(lists) * 3)]
    model = language_id.fit(spark.createDataFrame(rows, DOCS), fold("doc_id", 5) != 0)
    junk = ["今天天气很好，我们一起去公园散步吧。", "Привет, как дела? Сегодня хорошая погода.", "xj kjq bpz wgx jkb zxb gbq kkj qbx bjq",
            "σήμερα ο καιρός είναι πολύ καλός"]
    good = ["house", "the water of the house", "das haus und der garten", "la maison est dans les bois", "Water."]
    texts = spark.createDataFrame(list(enumerate(junk + good)), "doc_id long, text string")
    got = {r.doc_id: r.rejected for r in language_id.predict(texts, model).collect()}
    assert [got[n] for n in range(len(got))] == [True] * len(junk) + [False] * len(good)


def test_scores_match_brute_force_and_add_up(corpus, plain):
    import math

    rows = gru_score.score(clashing(corpus), fold("doc_id", 10) != 0).collect()
    counts = Counter()
    for d, t in plain:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 10:
            counts.update(lowered(t) + [""])
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for d, t in plain:
        w = lowered(t) + [""]
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        want[(d, len(w), sum(counts[x] > 0 for x in w), total, round(base, 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_of_all_words_add_up_to_one():
    counts = np.r_[50, np.arange(400, 100, -1)].astype(np.int64)
    v = gru_score.Vocabulary(zlib.compress(b" ".join(b"w%d" % n for n in range(300))), counts, int(counts.sum()) + 900, 900)
    net = gru_score.Network.fresh(v)
    h = np.random.default_rng(0).uniform(-1, 1, (1, gru_score.HIDDEN)).astype(np.float32)
    every = np.arange(v.size + 1)
    p = np.exp(net.log_probability(np.repeat(h, len(every), 0), every.copy()))
    assert abs(p.sum() - 1) < 1e-3


def test_gradient_is_that_of_the_loss():
    counts = np.r_[9, np.arange(90, 20, -1)].astype(np.int64)
    v = gru_score.Vocabulary(zlib.compress(b" ".join(b"w%d" % n for n in range(70))), counts, int(counts.sum()) + 100, 120)
    net = gru_score.Network.fresh(v)
    net.w = {k: x.astype(np.float64) for k, x in net.w.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, v.size, (5, 3)), rng.integers(0, v.size + 1, (5, 3))
    starts = np.zeros((5, 3))
    starts[0] = starts[3, 1] = 1
    h = np.zeros((3, gru_score.HIDDEN))
    g, _, _, _ = net.gradient(x, y, starts, h)
    for k, at in (("u", (3, 40)), ("c", (2, 1)), ("o", (0, 5, 3)), ("ob", (0, 2)), ("cb", (1,))):
        ends = []
        for sign in (1e-4, -1e-4):
            net.w[k][at] += sign
            ends.append(net.gradient(x, y, starts, h)[3])
            net.w[k][at] -= sign
        assert abs((ends[0] - ends[1]) / 2e-4 - g[k][at]) < 1e-3, k


def test_stream_scores_do_not_depend_on_lanes(monkeypatch):
    counts = np.r_[9, np.arange(90, 20, -1)].astype(np.int64)
    v = gru_score.Vocabulary(zlib.compress(b" ".join(b"w%d" % n for n in range(70))), counts, int(counts.sum()), 71)
    net, rng = gru_score.Network.fresh(v), np.random.default_rng(2)
    lengths = np.r_[1, 200, rng.integers(1, 90, 40)]
    x, y = rng.integers(0, v.size, lengths.sum()), rng.integers(0, v.size + 1, lengths.sum())
    many = gru_score.score_stream(net, x, y, lengths)
    monkeypatch.setattr(gru_score, "LANES", 1)
    assert np.allclose(many, gru_score.score_stream(net, x, y, lengths), atol=1e-3)


def test_stream_scores_against_a_plain_loop():
    """Token by token, in doubles: gates, class, word within its class, state from first token to last."""
    counts = np.r_[9, np.arange(290, 140, -1)].astype(np.int64)
    v = gru_score.Vocabulary(zlib.compress(b" ".join(b"w%d" % n for n in range(150))), counts, int(counts.sum()) + 60, 170)
    net, rng, n = gru_score.Network.fresh(v), np.random.default_rng(6), gru_score.HIDDEN
    w = {k: a.astype(float) for k, a in net.w.items()}
    w["cb"], w["ob"] = (a + rng.normal(0, 0.2, a.shape) for a in (w["cb"], w["ob"]))
    net.w = {k: a.astype(np.float32) for k, a in w.items()}
    lengths = np.r_[1, 77, 40]
    x, y = rng.integers(0, v.size, lengths.sum()), rng.integers(0, v.size + 1, lengths.sum())
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    want, at = [], 0
    for size in lengths:
        h, total = np.zeros(n), 0.0
        for i, target in zip(x[at:at + size], y[at:at + size]):
            a, g = w["x"][i], h @ w["u"]
            z, r = sigmoid(a[:n] + g[:n]), sigmoid(a[n:2 * n] + g[n:2 * n])
            new = np.tanh(a[2 * n:] + r * g[2 * n:])
            h = (1 - z) * new + z * h
            p = np.exp(h @ w["c"] + w["cb"])
            p /= p.sum()
            if target == v.size:
                total += np.log10(p[-1])
            else:
                k, place = divmod(int(target), gru_score.CLASS_SIZE)
                q = np.exp(h @ w["o"][k] + w["ob"][k])
                total += np.log10(p[k] * q[place] / q.sum())
        want.append(total)
        at += size
    assert np.allclose(gru_score.score_stream(net, x, y, lengths), want, rtol=1e-4)


def test_every_training_document_teaches_the_network(spark, monkeypatch):
    """Many small shares: leaving out any one document changes the weights."""
    monkeypatch.setattr(gru_score, "TRAINER", 200)
    importable(spark)
    rows = [(n, prose(2000 + n, 50)) for n in range(24)]

    def weights(skip=None):
        docs = spark.createDataFrame([(n, " " if n == skip else t) for n, t in rows], "doc_id long, text string").coalesce(1)
        _, v = gru_score.count(spark.createDataFrame(rows, "doc_id long, text string"))
        return gru_score.fit(docs, v).w["u"]

    whole = weights()
    assert all((weights(n) != whole).any() for n in (0, 9, 23))


def test_words_and_hashes_of_whole_columns(spark):
    """Columns are split as single texts are, and words are hashed as the counts' join key is."""
    odd = ["", None, " ", "a", "\tA  b\x0b\x0cc\r\n", "\u00a0x\u2003y \x1f z\x85", "\u00c4B \u0130I", "a " * 5000]
    flat, sizes = gru_score._split(pa.array(odd, pa.string()))
    want = [words((t or "").encode()) for t in odd]
    assert flat.to_pylist() == [w.decode() for t in want for w in t] and sizes.tolist() == [len(w) for w in want]
    column = pa.array(odd * 300)
    edges = list(gru_score._pieces(column))
    assert [a for a, _ in edges] == [0, *(b for _, b in edges[:-1])] and edges[-1][1] == len(column) and len(edges) > 1
    assert not list(gru_score._pieces(column.slice(0, 0)))
    hashed = spark.createDataFrame([(b"",), (b"word",), (b"x" * 77,)], "w binary")
    assert all(r.h == gru_score._hash(bytes(r.w)) for r in hashed.select("w", F.xxhash64("w").alias("h")).collect())


def test_sums_of_groups_of_rows():
    """One, few and many rows a group, against a plain sum."""
    rng = np.random.default_rng(9)
    word = np.r_[np.arange(50), rng.integers(0, 60, 300), np.full(900, 70), np.full(24, 71), np.full(25, 72)]
    rng.shuffle(word)
    x, order = rng.normal(size=(len(word), 6)), np.argsort(word, kind="stable")
    edges = np.flatnonzero(np.diff(word[order], prepend=-1))
    want = np.zeros((73, 6))
    np.add.at(want, word, x)
    assert np.allclose(gru_score._row_sums(x, order, edges), want[word[order[edges]]])


def test_weights_are_averaged_as_whole_parts(spark):
    """No weight becomes a row of its own: parts of many trainers are summed as they stream by."""
    rows = [(k, [float(t + k), float(t * k)]) for t in range(7) for k in range(5)]
    got = spark.createDataFrame(rows, "at int, part array<double>").repartition("at").sortWithinPartitions("at").mapInArrow(
        gru_score._mean, "at int, part array<double>").collect()
    assert {r["at"]: r["part"] for r in got} == {k: [3.0 + k, 3.0 * k] for k in range(5)}
    assert not list(gru_score._mean(iter([])))


def test_licence_probes_lose_nothing():
    """Sets of bigrams with Dice 0.8 or more, made of a template's own with others added, hold a probe."""
    rng = random.Random(8)
    tables = [licenses.TEMPLATES, [("A", "a b c d"), ("B", "a b"), ("C", "one"), ("D", "")],
              *[[(str(k), " ".join(rng.choices(["the", "licence", "of", "x", "granted", "software", "by"], k=rng.randint(2, 14)))) for k in range(4)]
                for _ in range(30)]]
    met = 0
    for table in tables:
        groups = licenses.probes(table, 0.8)
        for _, text in table:
            grams = licenses.bigrams(text)
            for _ in range(40):
                kept = rng.sample(grams, rng.randint(0, len(grams)))
                total = len(kept) + rng.randint(0, 2)
                if kept and 2 * len(kept) / (total + len(grams)) >= 0.8:
                    met += 1
                    body = " / ".join(kept)
                    assert any(all(w in body for w in group) for group in groups), (kept, groups)
    assert met > 300 and licenses.probes([("D", "")], 0.8) == []


def test_licences(spark, corpus):
    texts = [(1, "Code of a kind that one may look at.\n  Licensed under the APACHE License, version 2.0!\nmore of the text"), (2, "Released under the MIT License"), (3, None), (4, ""),
             (5, "\n\nThis work is licensed under\nthe GNU General Public License,\nversion 3.\n\nx"), (6, "Released"), (7, "of this and that, a text of the same length"), (2, "Released under the MIT License")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("unit", F.lit(1))
    got = Counter((r.doc_id, r.unit, r.unit_no, r.license) for r in licenses.scan(docs).collect())
    assert got == Counter({(1, "line", 1, "Apache-2.0"): 1, (2, "line", 0, "MIT"): 2, (5, "block", 1, "GPL-3.0"): 1})
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(clashing(corpus)).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan and "Exchange" not in plan
    for n in range(1, 60):
        fits = set(licenses.size_bounds(n, 0.8))
        assert fits == {m for m in range(1, 200) if 2 * min(n, m) >= 0.8 * (n + m) - 1e-9}


def test_passages_cover_every_exact_repeat(corpus, plain):
    rows = passages.repeated_passages(clashing(corpus), 50).collect()
    runs, texts = defaultdict(set), {d: lowered(t) for d, t in plain if d is not None}
    for d, w in texts.items():
        for k in range(len(w) - 49):
            runs[tuple(w[k:k + 50])].add(d)
    want, got = defaultdict(set), defaultdict(set)
    for d, w in texts.items():
        for k in range(len(w) - 49):
            if len(runs[tuple(w[k:k + 50])]) > 1:
                want[d].update(range(k, k + 50))
    for r in rows:
        got[r.doc_id].update(range(r.first_word, r.end_word))
        assert r.linked_doc_id != r.doc_id and 0 <= r.first_word < r.end_word <= len(texts[r.doc_id])
    assert want and all(want[d] <= got[d] for d in want)
    assert not set(got) - set(want) - {2, 23, 24, 25}    # 23 to 25 are changed copies of 2
    assert passages.repeated_passages(corpus.limit(0), 50).count() == 0


def test_compact_windows_are_those_of_the_cartesian_tree():
    rng = np.random.default_rng(6)
    h, t = rng.integers(0, 1 << 63, 300, dtype=np.uint64), 20
    own, value, l, c, r = passages.compact_windows(h, np.array([len(h) + passages.SHINGLE - 1]), t)
    mixed = h * passages._FACTORS
    mixed ^= mixed >> np.uint64(32)
    for k in range(passages.HASHES):
        want = set()
        m = (mixed[k] >> np.uint64(23)).tolist()

        def split(low, high):
            if high - low + 1 < t:
                return
            at = min(range(low, high + 1), key=lambda i: (m[i], i))
            want.add((low, at, high))
            split(low, at - 1)
            split(at + 1, high)

        split(0, len(h) - 1)
        mine = (value.view(np.uint64) & np.uint64(7)) == k
        assert set(zip(l[mine].tolist(), c[mine].tolist(), r[mine].tolist())) == want
    assert (own == 0).all()


@pytest.mark.parametrize("common", [20, 30, 40, 45])
def test_passages_around_a_stretch_that_many_share(spark, common):
    """Pairs share 60 words, of which `common` stand in 300 texts: every equal passage is found, nobody else is, and of passages
    with one word exchanged nearly every one."""
    rng = np.random.default_rng(common)
    fresh_words = iter(rng.permutation(10**6))

    def some(n: int) -> list[str]:
        return [f"v{next(fresh_words)}" for _ in range(n)]

    boiler = some(common)
    rows, equal, near = [], set(), set()
    for k in range(300):
        rows.append((k, some(40) + boiler + some(40)))
    for k in range(60):
        head = int(rng.integers(0, 61 - common))
        passage = some(head) + boiler + some(60 - common - head)
        other = list(passage)
        if k >= 40:
            other[int(rng.choice([i for i in range(60) if not head <= i < head + common]))] = some(1)[0]
        for doc_id, part in ((1000 + 2 * k, passage), (1001 + 2 * k, other)):
            rows.append((doc_id, some(30) + part + some(30)))
            (near if k >= 40 else equal).add(doc_id)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in passages.repeated_passages(docs, 50).collect()}
    assert equal <= got.keys() <= equal | near
    assert all(got[k].linked_doc_id == k ^ 1 and got[k].first_word <= 30 and got[k].end_word >= 90 for k in equal)
    assert len(near & got.keys()) >= 0.9 * len(near)


@pytest.mark.parametrize("common", [24, 40])
def test_unequal_passages_around_a_stretch_that_many_share(spark, common):
    """80 pairs share 60 words but one, of which `common` stand in 300 texts: both texts of every pair are found."""
    rng = np.random.default_rng(common)
    fresh_words = iter(rng.permutation(10**6))

    def some(n: int) -> list[str]:
        return [f"v{next(fresh_words)}" for _ in range(n)]

    boiler = some(common)
    rows = [(k, some(40) + boiler + some(40)) for k in range(300)]
    for k in range(80):
        head = int(rng.integers(0, 61 - common))
        passage = some(head) + boiler + some(60 - common - head)
        other = list(passage)
        other[int(rng.choice([i for i in range(60) if not head <= i < head + common]))] = some(1)[0]
        rows += [(1000 + 2 * k, some(30) + passage + some(30)), (1001 + 2 * k, some(30) + other + some(30))]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.linked_doc_id for r in passages.repeated_passages(docs, 50).collect()}
    assert got == {k: k ^ 1 for k in range(1000, 1160)}


def test_a_passage_that_stands_twice_in_the_first_text_is_found_twice(spark):
    rng = np.random.default_rng(8)
    words = [f"v{k}" for k in rng.permutation(10**5)]
    passage = words[:60]
    texts = [words[100:140] + passage + words[140:180] + passage + words[180:220]] + [words[k:k + 40] + passage for k in range(300, 500, 50)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    for size in (2, 5):
        got = {(r.doc_id, r.first_word, r.end_word) for r in passages.repeated_passages(docs.filter(F.col("doc_id") < size), 50).collect()}
        assert got == {(0, 40, 100), (0, 140, 200)} | {(k, 40, 100) for k in range(1, size)}


def test_stretches_may_overlap():
    """Every second run of 25 tokens stands in both texts; two neighbours are similar enough together, three are not."""
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 62, 85).astype(np.uint64)
    b = a.copy()
    b[25:30] = rng.integers(0, 1 << 62, 5)
    b[55:60] = rng.integers(0, 1 << 62, 5)
    covered = set()
    for _, _, low, high, share in passages.shared_stretches(a, b, 46, 80):
        assert share >= 0.8
        covered.update(range(low, high))
    assert set(range(25)) | set(range(30, 55)) | set(range(60, 85)) <= covered


def test_windows_are_made_and_dealt_out_once(spark):
    """Values that texts share are found in the exchange that brings their rows together: against a plain loop, and by the plan."""
    value, rng = passages.Window.partitionBy("value"), np.random.default_rng(2)
    rows = [tuple(map(int, r)) for r in np.c_[rng.integers(0, 40, 160), rng.integers(0, 9, 160), rng.integers(0, 50, 160), rng.integers(50, 99, 160), rng.integers(1, 4, 160)]]
    made = passages._shared(spark.createDataFrame(rows, "value long, node long, l int, r int, copies int"), F.sum("copies").over(value))
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    want = []
    for own in by.values():
        ends = [min(r[1] for r in own), max(r[1] for r in own)]
        bounds = [f(r[i] for r in own if r[1] == end) for end in ends for f, i in ((min, 2), (max, 3))]
        want += [(*r, *ends, sum(r[4] for r in own), *bounds) for r in own if ends[0] < ends[1]]
    assert Counter(map(tuple, made.collect())) == Counter(want) and len(want) < len(rows)
    texts = spark.createDataFrame([(k, prose(k, 80)) for k in range(4)], "node long, text string")
    plan = passages._shared(texts.mapInArrow(passages._emit(46), passages._WINDOWS), F.sum("copies").over(value))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    batch = pa.RecordBatch.from_pydict({"node": pa.array([5, 6, 5]), "text": [prose(1, 80), prose(2, 80), prose(1, 80)]})
    (made,) = passages._emit(46)(iter([batch]))
    assert set(zip(made.column("node").to_pylist(), made.column("copies").to_pylist())) == {(5, 2), (6, 1)}


def test_rarest_tokens_hold_the_rarest_shared_one():
    """Two sets of t tokens at Jaccard 0.8 or more always share one of the tokens chosen."""
    rng = np.random.default_rng(5)
    t = 46
    for _ in range(200):
        a = rng.integers(0, 1 << 62, t)
        b = a.copy()
        b[rng.choice(t, 5, replace=False)] = rng.integers(0, 1 << 62, 5)
        known = np.r_[np.intersect1d(a, b), np.setdiff1d(a, b)[:2], np.setdiff1d(b, a)[:3]]
        texts = rng.integers(2, 50, len(known))
        chosen = [set(x[passages.rarest(x, known, texts, t, 80)].tolist()) for x in (a, b)]
        assert chosen[0] & chosen[1] and max(map(len, chosen)) <= 10
    assert not len(passages.rarest(a, known[:30], texts[:30], t, 80))


def test_run_hashes_do_not_depend_on_the_place():
    h = np.random.default_rng(3).integers(0, 1 << 63, 500, dtype=np.uint64)
    h[300:350] = h[100:150]
    for size in (1, 20, 46):
        made = passages._run_hashes(h, size)
        assert len(made) == 501 - size and len(set(made.tolist())) == 501 - size - (51 - size)
        assert (made[300:351 - size] == made[100:151 - size]).all()


def test_a_common_line_beside_runs_of_words_pairs_few(spark, monkeypatch):
    """60 texts hold one line between runs of words of their own: few are compared for it alone, and the one repeated passage is found."""
    line, passage = [f"line{k}" for k in range(13)], [f"p{k}" for k in range(60)]
    texts = [[f"a{k}"] * 50 + line + [f"b{k}"] * 50 for k in range(60)]
    for k in (20, 40):
        texts[k] += passage
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    pairs, confirmed = [], passages._confirmed

    def counted(texts, spans, *rest):
        pairs.append(spans.count())
        return confirmed(texts, spans, *rest)

    monkeypatch.setattr(passages, "_confirmed", counted)
    got = {(r.doc_id, r.linked_doc_id, r.end_word - r.first_word) for r in passages.repeated_passages(docs, 50).collect()}
    assert got == {(20, 40, 60), (40, 20, 60)}
    assert len(pairs) == 3 and pairs[2] < 300, pairs        # of 1,770; bits of different words may agree


def test_bounds_of_pairs_keep_all_that_share_a_passage():
    """Two stretches of texts of runs, lines and other words: where a passage is found, the bounds let the pair through."""
    rng, t, percent = np.random.default_rng(3), 46, 80

    def text() -> bytes:
        w: list[str] = []
        while len(w) < 220:
            kind = rng.random()
            if kind < 0.5:
                w += [f"r{rng.integers(0, 4)}"] * int(rng.integers(3, 60))
            elif kind < 0.7:
                w += [f"l{k}" for k in range(13)]
            elif kind < 0.8:
                w += [f"p{k}" for k in range(int(rng.integers(5, 70)))]
            else:
                w += [f"x{rng.integers(0, 10**6)}" for _ in range(int(rng.integers(1, 30)))]
        return " ".join(w).encode()

    found = apart = 0
    for _ in range(1200):
        sides = []
        for _ in range(2):
            x = text()
            h, w = passages.tokens(x), word_hashes(x)
            flat = np.array([len(set(w[i:i + passages.SHINGLE].tolist())) == 1 for i in range(len(h))])
            low = int(rng.integers(0, len(h) - 60))
            high = min(len(h) - 1, low + int(rng.integers(50, 160)))
            signs = passages._signs(h, flat, np.array([low]), np.array([high]), t)
            assert list(signs) == list(passages._SIGNS)
            sides.append((h[low:high + 1], {k: int(v[0]) for k, v in signs.items()}))
        (a, u), (b, v) = sides
        most = sum(((u[f"b{k}"] & v[f"b{k}"]) & (2**64 - 1)).bit_count() for k in range(4)) + min(u["same"], v["same"])
        assert most >= len(np.intersect1d(a, b))
        kept = (not (u["few"] or v["few"]) or u["runs"] & v["runs"]) and 100 * most >= percent * max(u["least"], v["least"])
        passage = bool(passages.shared_stretches(a, b, t, percent))
        assert kept or not passage
        found, apart = found + passage, apart + (not kept)
    assert found > 20 and apart > 300


def test_matched_windows_unite_as_by_a_plain_loop():
    """Rows of a pair come in several batches; windows that meet on one side only do not unite."""
    rng, n = np.random.default_rng(7), 4000
    u, v, lu, value = (rng.integers(0, k, n) for k in (6, 9, 900, 64))
    lv = lu + rng.choice([0, 0, 0, 3, 500], n)
    ru, rv = lu + rng.integers(0, 60, n), lv + rng.integers(0, 60, n)
    order = np.lexsort((value, lu, lv, v, u))
    rows = pa.table({k: x[order] for k, x in zip(("u", "v", "lv", "rv", "lu", "ru", "value"), (u, v, lv, rv, lu, ru, value))})
    want: list[list] = []
    for r in rows.to_pylist():
        now = want[-1] if want else None
        if now and now[:2] == [r["u"], r["v"]] and r["lv"] <= now[5] and r["lu"] <= now[3] and r["ru"] >= now[2]:
            now[2], now[3], now[5] = min(now[2], r["lu"]), max(now[3], r["ru"]), max(now[5], r["rv"])
            now[6].add(r["value"] & 7)
        else:
            want.append([r["u"], r["v"], r["lu"], r["ru"], r["lv"], r["rv"], {r["value"] & 7}])
    for agree in (1, 2):
        made = [list(r.values()) for size in (7,) for b in passages._join_intervals(agree)(iter(rows.to_batches(size))) for r in b.to_pylist()]
        assert made == [x[:6] for x in want if len(x[6]) >= agree] and made
    assert not list(passages._join_intervals(1)(iter([])))


def test_words_of_several_texts_at_once():
    texts = [b"", b" \n", b"One two\tONE", b"x" * 3000 + b" " + bytes(range(256)), b"ab " * 1000, "\u00c4\u00df x".encode()]
    h, sizes = word_hashes_of(texts)
    assert sizes.tolist() == [len(words(x)) for x in texts] and (h == np.concatenate([word_hashes(x) for x in texts])).all()
    seen: dict[bytes, int] = {}
    assert all(seen.setdefault(w, x) == x for w, x in zip((w for x in texts for w in words(x)), h.tolist())) and len(set(seen.values())) == len(seen)
    assert [len(x) for x in passages.tokens_of(texts)] == [max(0, len(words(x)) - passages.SHINGLE + 1) for x in texts]
    assert all((x == passages.tokens(y)).all() for x, y in zip(passages.tokens_of(texts), texts))
