"""Each operator against brute force on small rows, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import (
    jaccard_join,
    kneser_ney,
    mixing,
    packing,
    personal_data,
    quality_rules,
    token_counts,
    token_files,
    token_pieces,
    url_rules,
    vp_tree,
)
from shelfwise.llm.components import component_stars

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = "ordinal long, text string, source string"


def prose(rng, n, words=("learn", "plant", "river", "stone", "maths", "verb", "cell", "graph", "poem", "atlas")):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ing", "er"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randrange(12, 80)), f"s{k % 4}") for k in range(60)]
    base = rows[0][1].split()
    rows += [(100 + k, " ".join(base[:k] + ["other"] + base[k + 1 :]), "s1") for k in range(0, 12, 3)]
    rows += [(200, rows[3][1], "s2"), (200, rows[3][1], "s2"), (201, None, None), (202, "", "s0"), (203, " \n\t", "s0")]
    rows += [(None, rows[4][1], "s3"), (None, "a b", None), (204, "One two", "s0"), (205, "one TWO", "s0")]
    rows += [(206, prose(rng, 6000), "s0"), (207, "x" * 30000, "s1"), (208, "été naïve — ok 你好 " * 20, "s2")]
    return rows


def frame(spark, rows, schema=ROWS):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- 1
def base_of(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    chars = sum(len(w) for w in words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked)


def grams(text):
    raw = (text or "").encode()
    return [((int.from_bytes(raw[i : i + 4], "little") * 2654435761) % 2**32) >> 16 for i in range(len(raw) - 3)]


def test_quality_rules(spark, docs):
    odd = [(300, "a b c d e\n\na b c d e\n#*$ x a b c d e", "s0"), (301, "% % %%% && || <> * * # # !", "s1"), (302, "w " * 40, "s2")]
    rows = [r for r in docs if r[0] not in (206,)] + odd
    table = frame(spark, rows).withColumn("kept", F.lit("mine"))
    trusted = table.where("ordinal < 40")
    out = quality_rules.quality_rules(table, quality_rules.fit_ratio(table, trusted)).collect()
    raw, target = np.ones(1 << 16), np.ones(1 << 16)
    for k, text, _ in rows:
        for g in grams(text):
            raw[g] += 1
            target[g] += k is not None and k < 40
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert len(out) == len(rows) and {r.kept for r in out} == {"mine"}
    for r in out:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == base_of(r.text)
        own = grams(r.text)
        assert q.llr == pytest.approx(sum(ratio[g] for g in own) / len(own) if own else 0, abs=1e-4)
        assert q.base_failed == (q.n_words < 10 or 100 * q.n_repeat_words > 20 * q.n_words)
        assert q.kept == (not q.base_failed and q.llr >= -1.05)
    empty = frame(spark, [])
    assert quality_rules.quality_rules(empty, quality_rules.fit_ratio(empty, empty)).count() == 0


# ---------------------------------------------------------------- 2
def shingles(text, width=3):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def groups_of(rows, width=3, percent=90):
    sets = [shingles(t, width) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (k, *_) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((r[0], len(s), least.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def test_jaccard_groups(spark, docs):
    rng = random.Random(9)
    base = prose(rng, 120).split()
    near = []
    for k in range(40):  # a crowd of near copies, linked by chains only in part
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(1000)}"
        near.append((400 + k, " ".join(words), "s1"))
    rows = docs + near + [(500, base and " ".join(base[:11]), "s"), (501, " ".join(base[:12]), "s")]
    table = frame(spark, rows).withColumn("node", F.lit(1))
    out = jaccard_join.jaccard_groups(table).collect()
    assert sorted(((r.ordinal, r.n_shingles, r.component_id) for r in out), key=str) == groups_of(rows)
    kept = jaccard_join.first_of_groups(table).collect()
    firsts = {c for _, n, c in groups_of(rows) if n and c is not None}
    assert {r.ordinal for r in kept if shingles(r.text) and r.ordinal is not None} == firsts
    assert len(kept) == len(firsts) + sum(not shingles(t) for _, t, _ in rows) + 1  # one group has no ordinal at all
    assert kept[0].node == 1
    assert jaccard_join.jaccard_groups(frame(spark, [])).count() == 0


def test_crowds_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CROWD", 3)
    rng = random.Random(3)
    base = prose(rng, 90).split()
    rows = []
    for k in range(50):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"q{rng.randrange(30)}"
        rows.append((k, " ".join(words)))
    out = jaccard_join.jaccard_groups(frame(spark, rows, "ordinal long, text string")).collect()
    assert sorted(((r.ordinal, r.n_shingles, r.component_id) for r in out), key=str) == groups_of(rows)


def test_merged_crowds_are_not_met_again(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CROWD", 4)
    seen = {"met": [], "labelled": []}
    all_pairs, labels = jaccard_join._all_pairs, jaccard_join._labelled

    def met(postings, percent):
        seen["met"].append(postings.groupBy("token").count().agg(F.max("count")).first()[0])
        return all_pairs(postings, percent)

    def labelled(rows, stars):
        if stars is not None:
            seen["labelled"].append((rows.count(), rows.select("node").distinct().count()))
        return labels(rows, stars)

    monkeypatch.setattr(jaccard_join, "_all_pairs", met)
    monkeypatch.setattr(jaccard_join, "_labelled", labelled)
    rng = random.Random(6)
    base = prose(rng, 200).split()
    rows = [(k, " ".join(base[:-1] + [f"end{k}"])) for k in range(60)]  # all linked with each other
    rows += [(100 + k, prose(rng, 60)) for k in range(20)] + [(200, " ".join(base[:150]))]
    out = jaccard_join.jaccard_groups(frame(spark, rows, "ordinal long, text string")).collect()
    assert sorted(((r.ordinal, r.n_shingles, r.component_id) for r in out), key=str) == groups_of(rows)
    assert all(n is None or n <= 4 for n in seen["met"])
    assert seen["labelled"] and all(rows == nodes for rows, nodes in seen["labelled"])


def test_hub_rounds_touch_postings_of_crowds_only(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CROWD", 8)
    labels, given = jaccard_join._labelled, []

    def labelled(nodes, stars):
        given.append(nodes.agg(F.sum(F.size("posts"))).first()[0])
        return labels(nodes, stars)

    monkeypatch.setattr(jaccard_join, "_labelled", labelled)
    rng = random.Random(8)
    base = prose(rng, 150).split()
    rows = [(k, " ".join(base[:-1] + [f"end{k}"])) for k in range(80)]  # the crowd
    for k in range(100, 160, 2):  # pairs that share many shingles, each with one other text
        words = prose(rng, 150).split()
        rows += [(k, " ".join(words)), (k + 1, " ".join(words[:-1] + ["z"]))]
    out = jaccard_join.jaccard_groups(frame(spark, rows, "ordinal long, text string")).collect()
    assert sorted(((r.ordinal, r.n_shingles, r.component_id) for r in out), key=str) == groups_of(rows)
    *rounds, rest = given  # a round has postings of the crowd alone, and the others come once, after all rounds
    assert rounds and max(rounds) < 80 * 20 and rest > 60


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 40), (40, 100), (7, 7)]
    stars = component_stars(frame(spark, edges, "a long, b long")).collect()
    assert {(r.u, r.v) for r in stars} == {(i, 0) for i in range(1, 31)} | {(100, 40)}


# ---------------------------------------------------------------- 3
def test_kneser_ney(spark, docs):
    rows = [(k, t, "en" if (k or 0) % 2 else "fr") for k, t, _ in docs if k != 206]
    table = frame(spark, rows, "ordinal long, text string, lang string")
    trusted = table.where("ordinal < 30")
    counts = {4: {}}
    for k, t, _ in rows:
        if k is not None and k < 30:
            raw = b"\0\0\0" + (t or "").encode()
            for i in range(len(raw) - 3):
                counts[4][raw[i : i + 4]] = counts[4].get(raw[i : i + 4], 0) + 1
    for n in (3, 2, 1):
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    cuts = {n: kneser_ney.discounts([sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4)]) for n in counts}
    total, cut_sum = {}, {}
    for n in counts:
        for g, c in counts[n].items():
            total[g[:-1], n] = total.get((g[:-1], n), 0) + c
            cut_sum[g[:-1], n] = cut_sum.get((g[:-1], n), 0) + cuts[n][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        n, low = len(g), p(g[1:])
        if (g[:-1], n) not in total:
            return low
        c = counts[n].get(g, 0)
        own = (c - cuts[n][min(c, 3) - 1]) / total[g[:-1], n] if c else 0
        return own + cut_sum[g[:-1], n] / total[g[:-1], n] * low

    assert sum(p(b"lea" + bytes([b])) for b in range(256)) == pytest.approx(1)
    out = kneser_ney.perplexity_rules(table, trusted, language="lang").collect()
    assert len(out) == len(rows)
    want = {}
    for k, t, _ in rows:
        raw = b"\0\0\0" + (t or "").encode()
        logs = [math.log(p(raw[i : i + 4])) for i in range(len(raw) - 3)]
        want.setdefault(k, []).append(math.exp(-sum(logs) / len(logs)) if logs else None)
    for r in out:
        assert any(w == r.perplexity or (w and r.perplexity and abs(w - r.perplexity) < 1e-3 * w) for w in want[r.ordinal])
        assert r.kept == (r.perplexity is not None and r.perplexity <= r.limit_perplexity)
    assert all(r.kept for r in out if r.ordinal is not None and r.ordinal < 30 and r.n_tokens)
    assert kneser_ney.perplexity_rules(table.limit(0), trusted, language="lang").count() == 0


# ---------------------------------------------------------------- 4
def test_packing(spark):
    rng = random.Random(2)
    rows = [(k, f"s{rng.randrange(6)}", rng.randrange(1, 260), f"c{rng.randrange(40)}" if k % 3 else None) for k in range(300)]
    rows += [(None, None, 70, None), (None, None, 70, None), (900, "s1", 0, None), (901, "s1", None, "c1"), (902, "s2", 730, "c2")]
    table = frame(spark, rows, "ordinal long, source string, size long, cluster string").withColumn("bin", F.lit("x"))
    out = packing.pack_candidates(table, capacity=100, shard_rows=80).collect()
    assert sum(r.length for r in out) == sum(s or 0 for _, _, s, _ in rows)
    bins, source, cluster = {}, {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    for r in out:
        if r.bin is not None:
            bins.setdefault(r.bin, []).append(r)
    for held in bins.values():
        held.sort(key=lambda r: r.bin_start)
        assert [r.bin_start for r in held] == [sum(x.length for x in held[:i]) for i in range(len(held))]
        assert sum(r.length for r in held) <= 100
        assert len({source[r.ordinal] for r in held}) == len(held)
        copies = [cluster[r.ordinal] for r in held if cluster[r.ordinal]]
        assert len(set(copies)) == len(copies)
    assert sorted(r.ordinal for r in out if r.bin is None) == [900, 901]
    assert sorted(r.start for r in out if r.ordinal == 902) == list(range(0, 730, 100))
    assert packing.pack_candidates(table.limit(0)).count() == 0


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(8)
    for _ in range(20):
        n = rng.randrange(1, 60)
        length = np.array(sorted((rng.randrange(1, 60) for _ in range(n)), reverse=True))
        source, cluster = np.array([rng.randrange(5) for _ in range(n)]), np.array([rng.choice([-1, 1, 2, 3]) for _ in range(n)])
        got, starts = packing.best_fit(length, source, cluster, 100)
        open_ = []
        for i in range(n):
            fits = [b for b in open_ if b["room"] >= length[i] and source[i] not in b["s"] and (cluster[i] == -1 or cluster[i] not in b["c"])]
            room = min((b["room"] for b in fits), default=None)
            mine = next((b for b in open_ if b["id"] == got[i]), None)
            assert (mine is None) == (room is None) and (mine is None or mine in fits and mine["room"] == room)
            if mine is None:
                mine = {"id": got[i], "room": 100, "s": set(), "c": set()}
                open_.append(mine)
            assert starts[i] == 100 - mine["room"]
            mine["room"] -= length[i]
            mine["s"].add(source[i])
            mine["c"].add(cluster[i])


# ---------------------------------------------------------------- 5
#: Every letter and digit before a mark: some are written as a letter and a combining mark, which takes the mark along.
ODD_WORDS = [f"a{chr(c)}{m}b{chr(c)}{m}c" for c in range(1, 0x11000) if chr(c).isalnum() for m in (". ", ", ", ".\n")]


def test_token_files(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    extra = [(600, "Don't stop.. a, b. <|endoftext|> x <|ENDOFTEXT|>", "s"), (601, "İstanbul ΣΑΣ\x1c. É, ŉ_ b", "s")]
    rows = docs + extra
    table = frame(spark, rows).withColumn("shard", F.lit(3))
    folder = token_files.token_folder(spark)
    index = token_files.write_token_files(table, path, folder, length=64)
    out = token_files.read_token_digests(index, folder).collect()
    tok = Tokenizer.from_file(path)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for k, t, _ in ordered:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in out), key=str) == sorted(want, key=str)
    for text, ids in zip(ODD_WORDS, token_pieces.encoder(path, drops_space=True).encode(ODD_WORDS)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    file = index.first().file
    size = index.where(F.col("file") == file).agg(F.sum("n_tokens")).first()[0]
    opened = token_files.TokenFile(folder, file)
    ids, mask = opened.sequence((size - 1) // 64)
    assert len(ids) == 64 and mask.sum() == (size - 1) % 64 + 1 and ids[mask][-1] == 1
    opened.close()
    empty = token_files.write_token_files(frame(spark, []), path, folder)
    assert token_files.read_token_digests(empty, folder).count() == 0


# ---------------------------------------------------------------- 6
def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(d[::-1])) % 10 == 0


def spans_of(text):
    out, digits = [], lambda m: re.sub("[^0-9]", "", m)
    tests = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    for kind, (pattern, good) in enumerate(tests):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if good(m[0])]
    return sorted(out)


def test_personal_data(spark):
    rng = random.Random(4)
    parts = ["a@b.c", "x_y@d-e.f.g", "c_x@d.e", "@", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5.6.7.8", "4532015112830366", "4532 0151-1283 0366"]
    parts += ["+1 (269) 555-3296", "+44..", "+1", "é你😀", " ", "\n", ".", "9", "-", "word", "79927398713", "4111111111111111"]
    rows = [(k, "".join(rng.choice(parts) + rng.choice(["", " ", "", ","]) for _ in range(rng.randrange(0, 14)))) for k in range(250)]
    rows += [(None, "m@n.op"), (None, None), (7, "m@n.op"), (7, "m@n.op"), (8, ""), (9, "1" * 40000), (10, "a" * 40000 + "@b.c"), (11, "a@b" + ".c" * 9000)]
    table = frame(spark, rows, "ordinal long, text string").withColumn("spans", F.lit(0))
    out = personal_data.protect_candidates(table).collect()
    assert len(out) == len(rows)
    for r in out:
        base = [tuple(s) for s in r.spans if s.kind < 4]
        assert base == spans_of(r.text)
        assert (r.safe_text is None) == (r.text is None)
        if not r.spans:
            assert r.safe_text == r.text
    assert personal_data.protect_candidates(table.limit(0)).count() == 0


def test_disclosing_terms(spark):
    rng = random.Random(6)
    rows = [(k, "common plain copied " + prose(rng, 30)) for k in range(200)]
    rows += [(300 + k, f"common Wendelin, see wendelin.k@mail.org plain {k} {prose(rng, 5)}") for k in range(4)]
    rows += [(400, "Somewhere WENDELIN appears, wendelins do not")]
    rows += [(500 + k, "Copied to zacharia z@z.org") for k in range(5)]  # copies of one text prove nothing
    table = frame(spark, rows, "ordinal long, text string")
    terms, holders = personal_data.disclosing_terms(table, threshold=0.8)
    assert [r.term for r in terms.collect()] == ["wendelin"]
    n, both, n_term, n_entity = len(rows), 4, 5, 4
    want = math.log(both * n / (n_term * n_entity)) / math.log(n / n_entity)
    assert terms.first().disclosure == pytest.approx(want)
    assert {r.ordinal for r in holders.collect()} == {300, 301, 302, 303, 400}
    safe = {r.ordinal: r.safe_text for r in personal_data.protect_candidates(table, threshold=0.8).collect()}
    assert safe[400] == "Somewhere [term] appears, wendelins do not"
    assert safe[300].startswith("common [term], see [email] plain 0 ")


# ---------------------------------------------------------------- 7
def test_url_rules(spark):
    rules = [url_rules.parse_rule(v, t) for v, t in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"))]
    patterns = [url_rules.PatternRule(r"/ads?/", ("ad",)), url_rules.PatternRule(r"track=[0-9]+", ("track",)), url_rules.PatternRule(r"/track/ad/", ("track", "ad"))]
    rows = [
        ("http://A.Example.com/en/x", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("https://www.example.com/en/?q", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://notexample.org/ad/", "notexample.org", "/ad/", None, "block"),
        ("http://x.org/ads/", "x.org", "/ads/", None, "allow"),  # the literal token is `ad`
        ("http://x.com?track=1", "x.com", "", None, "allow"),
        ("http://x.org/?TRACK=12#a", "x.org", "/", None, "allow"),
        ("ftp://h#f/x://y", "h", "", None, "allow"),
        ("no scheme/ad/", "", "", None, "block"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://x.com", "x.com", "", None, "allow"),
    ]
    rows[4] = (*rows[4][:4], "allow")
    table = frame(spark, [(k, r[0]) for k, r in enumerate(rows)] * 2, "ordinal long, source_url string").withColumn("host", F.lit("mine"))
    got = {r.ordinal: (r.source_url, r.host, r.path, r.rule, r.verdict) for r in url_rules.url_rules(table, rules, patterns).collect()}
    brute = re.compile(r"/ads?/|track=[0-9]+|/track/ad/")
    for k, (url, host, path, rule, verdict) in enumerate(rows):
        low = (url or "").lower()
        tokens = set(re.findall("[a-z0-9]+", low))
        if rule is None and brute.search(low) and tokens & {"ad", "track"}:
            verdict = "block"
        assert got[k] == (url, host, path, rule, verdict)
    assert url_rules.url_rules(table.limit(0), rules, patterns).count() == 0
    with pytest.raises(ValueError):
        url_rules.url_rules(table, rules, [url_rules.PatternRule("x", ())])


# ---------------------------------------------------------------- 8
def test_vp_tree(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=6).astype("float32").tolist()) for k in range(900)]
    rows += [(1000 + k, rows[5][1]) for k in range(700)]  # copies of one vector
    rows += [(20000, None), (20020, [0.0] * 6), (20040, [float("nan")] + [1.0] * 5), (20060, [None] + [1.0] * 5), (None, rows[0][1]), (20080, [float("inf")] * 6)]
    table = frame(spark, rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    queries = table.where("vec_id % 20 = 0")
    good = [(k, np.array(v, dtype=float)) for k, v in rows if k is not None and k < 20000]
    out = vp_tree.nearest(table, queries, k=7, shard_rows=500).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = [(k, v) for k, v in good if k % 20 == 0]
    assert set(got) == {k for k, _ in asked}
    for k, v in asked:

        def score(x):  # component by component; sum() would compensate its rounding
            total = 0.0
            for a, b in zip(v, x):
                total += float(a) * float(b)
            return total

        want = sorted(((-score(x), j) for j, x in good if j != k))[:7]
        assert [(j, -s) for s, j in want] == [(j, s) for _, j, s in sorted(got[k])]
    loose = vp_tree.nearest(table, queries, k=7, shard_rows=500, slack=0.6).collect()
    hit = {(r.query_id, r.vec_id) for r in out} & {(r.query_id, r.vec_id) for r in loose}
    assert len(hit) >= 0.5 * len(out)
    assert vp_tree.nearest(table.limit(0), queries).count() == 0 and vp_tree.nearest(table, queries.limit(0)).count() == 0


def test_vp_tree_scores_leaves_for_all_queries_at_once():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(4000, 64))
    rows[1000:1600] = rows[7]  # copies of one vector
    ids = np.arange(4000, dtype=np.int64)
    ids[2000:2005] = 40  # rows that repeat an id are no neighbours of it
    tree = vp_tree.VpTree(ids, rows, float(np.linalg.norm(rows, axis=1).max()))

    def search(asked):
        steps = []
        sys.setprofile(lambda *event: steps.append(1))
        try:
            found = tree.search(ids[asked], rows[asked], 9, 1.0)
        finally:
            sys.setprofile(None)
        return found, len(steps)

    few, some = np.arange(0, 1200, 12), np.arange(0, 1200, 2)
    (_, few_steps), ((at, found, scores), steps) = search(few), search(some)
    assert steps < 2 * few_steps  # six times the queries
    for place, query in enumerate(some):
        exact = np.zeros(len(rows))
        for d in range(64):
            exact += rows[query, d] * rows[:, d]
        want = sorted((-s, i) for s, i in zip(exact, ids) if i != ids[query])[:9]
        assert want == list(zip(-scores[at == place], found[at == place]))


# ---------------------------------------------------------------- 9
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, docs, name):
    path = public_tokenizers.path(name)
    odd = ["a  b", " a", "a ", "x\n\ny z", "foo \nbar", "don't 's", "<|endoftext|> a<|endoftext|>", "a 　b c", "word. 12,5 tail", "\x1c a \x1d"]
    rows = docs + [(700 + k, t, "s") for k, t in enumerate(odd)]
    out = token_counts.token_counts(frame(spark, rows).withColumn("n_tokens", F.lit(1)), path).collect()
    if name.endswith("json"):
        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        tok = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(tok.encode(t))
    assert len(out) == len(rows)
    for r in out:
        n = count(r.text or "")
        assert (r.tokens.n_bytes, r.tokens.n_tokens, r.tokens.over_limit) == (len((r.text or "").encode()), n, n > 1024)


# ---------------------------------------------------------------- 10
def targets_of(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: [1.0, 2.0, 3.0][i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark, docs):
    rng = random.Random(7)
    rows = docs + [(1000 + k, prose(rng, 40), "hot") for k in range(300)] + [(2000, "tiny source", "zz"), (2001, "", "zzz")]
    table = frame(spark, rows).withColumn("size", F.lit("mine"))
    out = mixing.mix_sources(table, block_words=16).collect()
    again = mixing.mix_sources(table.repartition(7), block_words=16).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want, taken = targets_of(sizes), {}
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4
    pieces, _ = mixing.mix_pieces(table, block_words=16)
    # slots are the golden-ratio points, offered to the sources in turn and left out once a source is served
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    need = [-(-math.ceil(round(want[s], 6)) // 16) for s in order]
    total, upto, given, slots, slot = sum(need), np.cumsum(need), [0] * len(need), {}, 0
    while len(slots) < total:
        point = slot * 0.6180339887498949 % 1
        k = next(i for i, u in enumerate(upto) if point < u / total)
        if given[k] < need[k]:
            slots[slot] = k + 1
            given[k] += 1
        slot += 1
    assert {(r.slot, r.source_no) for r in pieces.select("slot", "source_no").distinct().collect()} == set(slots.items())
    per_slot = pieces.groupBy("slot").agg(F.sum("words").alias("n"), F.countDistinct("source_no").alias("s")).collect()
    assert all(r.n <= 16 and r.s == 1 for r in per_slot)
    mixed = mixing.mixed_rows(table, block_words=16)
    assert mixed.columns == table.columns
    got = {}
    for r in mixed.collect():
        got[r.source] = got.get(r.source, 0) + len(WORD.findall(r.text))
    assert all(abs(got.get(s, 0) - taken[s]) <= 2 for s in sizes)
    assert mixing.mix_sources(table.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    trusted = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    seen, now = [], docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(now.collect())
        if k < 4:
            assert now.columns == docs.columns
    kept = {r.doc_id for r in seen[0]}
    assert trusted & {k for k, t in text.items() if not (base_of(t)[0] < 10 or 100 * base_of(t)[4] > 20 * base_of(t)[0])} <= kept
    groups = groups_of([(r.doc_id, r.text) for r in seen[0]], corpus_pipeline.NEAR.width, corpus_pipeline.NEAR.percent)
    assert {r.doc_id for r in seen[1]} == {c for _, n, c in groups if n}
    for r in seen[2]:
        assert not spans_of(r.text) or not spans_of(text[r.doc_id])
        assert r.n_chars == len(r.text)
    before = {r.doc_id: r for r in seen[2]}
    assert all(before[r.doc_id].text.split()[: len(r.text.split())] == r.text.split() for r in seen[3])
    assert sum(r.length for r in seen[4]) == sum(len(WORD.findall(r.text)) for r in seen[3])
    # every packed row is one copy of one text, and a bin's words can be laid out again
    keyed = spark.read.parquet(f"{tmp_path}/3").select("doc_id", "text", F.xxhash64(F.sha2("text", 256)).alias("text_key")).collect()
    copies = {}
    for r in keyed:
        copies.setdefault((r.doc_id, r.text_key), []).append(WORD.findall(r.text))
    assert {(r.doc_id, r.text_key, r.copy) for r in seen[4]} == {(*k, n) for k, v in copies.items() for n in range(len(v))}
    laid = {}
    for r in seen[4]:
        piece = copies[r.doc_id, r.text_key][r.copy][r.start : r.start + r.length]
        assert len(piece) == r.length
        laid.setdefault(r.bin, []).append((r.bin_start, r.length))
    for spans in laid.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 2048
    assert hashlib.sha256(str(sorted(map(str, seen[4]))).encode()).hexdigest() == hashlib.sha256(
        str(sorted(map(str, corpus_pipeline.run(spark, sf).collect()))).encode()
    ).hexdigest()


def test_sql(spark):
    from checks.compare import compare, duck

    from shelfwise.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duck(sf)
    for name, sql in queries.ORACLE.items():
        problem, _ = compare(name, queries.QUERIES[name](spark, sf), con, sql)
        assert problem is None, problem


def test_queries_run(spark):
    from shelfwise.llm import queries

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, query in queries.QUERIES.items():
        if name.split("_")[0] in ("op1", "op2", "op3", "op5", "op6", "op9", "op10", "op11", "op12"):
            assert query(spark, sf).count() == n, name


OWN = "ordinal _ordinal _key _text _base _terms _quality quality _k _o _s _mix _words _found rest size taken spans host node component_id".split()


def test_own_columns_of_any_name_stay(spark, tmp_path):
    """A documents table with columns that operators use inside: queries run and stages hand them on."""
    import corpus_pipeline

    from shelfwise.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in OWN})
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "conversations"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        if name.split("_")[0] not in ("op7", "op8"):
            assert query(spark, str(tmp_path)).count() > 0, name
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == wide.columns, name
        assert all(r[c] == f"{c}{r.doc_id}" for r in now.collect() for c in OWN), name
    pages = spark.createDataFrame([("http://a.com/x?page=2&ref=",)], "source_url string").withColumns({c: F.lit(c) for c in OWN if c != "host"})
    judged = url_rules.url_rules(pages, queries.HOST_RULES, queries.PATTERNS).first()
    assert all(judged[c] == c for c in OWN if c != "host") and judged.host == "a.com"
