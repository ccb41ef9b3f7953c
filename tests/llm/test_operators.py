"""The training-data operators against brute force, on awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import gzip
import hashlib
import io
import itertools
import random
import re
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weft.llm import decontaminate as D
from weft.llm import html_extract as H
from weft.llm import packing as K
from weft.llm import simhash as S
from weft.llm import warc as W
from weft.llm.exact_dedup import digests, drop_exact_copies, exact_dedup, merge_runs
from weft.llm.language_id import _slots, fit_languages, gram_hashes, keep_known_languages, predict_languages
from weft.llm.license_scan import license_scan, signature_rules
from weft.llm.quality import embed, fit_quality, score, score_quality
from weft.llm.sampling import bounded_sample
from weft.llm.url_filter import url_filter

DOCS = "doc_id long, text string, lang string, source string, _id string, _key int, kept string"


def rows_of(texts, langs=None):
    return [(i, t, langs[i] if langs else "en", f"s{i % 3}", "x", 7, "k") for i, t in enumerate(texts)]


def ascii_lower(t):
    return (t or "").encode("utf-8").lower().decode("utf-8")


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "DELTA", "éclair", "İstanbul", "zeta", "eta", "theta", "iota", "kappa", "lambda"]
    texts = [None, "", "   ", "one", "One", "ONE", "É one", "é one", "\x0b\t\n", "a b", "A B", "😀 smile", "\u212a kelvin"]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)]
    texts += [texts[20]] * 5 + [texts[21].upper()] + ["long " * 30_000] + [texts[22] + " tail"]
    rows = rows_of(texts) + [(0, None, None, None, None, None, None), (None, "one", None, None, None, None, None), (3, "one", "en", "s0", "x", 7, "k"), (3, "one", "en", "s0", "x", 7, "k")]
    return spark.createDataFrame(rows, DOCS).repartition(5), rows


def empty(df):
    return df.limit(0)


# -- exact dedup --------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("keep,fan_in", [("largest", 2), ("smallest", 8)])
def test_exact_dedup(awkward, keep, fan_in):
    df, rows = awkward
    groups = defaultdict(list)
    for r in rows:
        groups[ascii_lower(r[1])].append(r[0])
    got = exact_dedup(df, keep=keep, fan_in=fan_in).collect()
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        text = next(t for t, ids in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in ids)
        ids = [i for i in groups[text] if i is not None]
        assert r.keep_id == ((max if keep == "largest" else min)(ids) if ids else None) and r.group_size == len(groups[text])
        kept[text] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    left = drop_exact_copies(df, keep=keep)
    assert left.columns == df.columns and left.count() == len(groups)
    assert exact_dedup(empty(df)).count() == 0


def test_exact_runs_stay_sorted_in_the_plan(spark):
    """Every round lays its runs in order and passes along them: the optimiser leaves sort and window in place."""
    df = spark.createDataFrame([(i, f"text {i % 50}") for i in range(400)], "doc_id long, text string").repartition(30)
    for fan_in, rounds in ((2, 4), (8, 1)):
        merged = merge_runs(digests(df, "doc_id", "text"), "largest", fan_in)
        plan = merged._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("row_number()") >= rounds and plan.count("RepartitionByExpression [_run") >= rounds
        assert "Sort [_run" in merged._jdf.queryExecution().executedPlan().toString()
        assert {(r._keep, r._size) for r in merged.collect()} == {(350 + k, 8) for k in range(50)}


# -- simhash ------------------------------------------------------------------------------------------------------------

def brute_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, near):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(points, 2):
        if near(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {p: find(p) for p in points}


@pytest.mark.parametrize("width,distance,block", [(3, 3, 2048), (1, 6, 3), (3, 0, 2)])
def test_near_duplicates(awkward, width, distance, block):
    df, rows = awkward
    fps = [brute_fingerprint(r[1], width) for r in rows]
    roots = brute_components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= distance)
    least = defaultdict(list)
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[roots[f]].append(r[0])
    want = Counter((r[0], f"{f:016x}", min(least[roots[f]])) for r, f in zip(rows, fps))
    got = S.near_duplicates(df, width=width, distance=distance, block_rows=block).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_fingerprints_that_differ_in_the_sign_bit_link(spark):
    base = random.Random(1).getrandbits(64)
    fps = [base, base ^ (1 << 63), base ^ (1 << 63) ^ 6, base ^ (1 << 63) ^ 6 ^ (7 << 40)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    points = spark.createDataFrame([(f, f) for f in signed], "key long, fp long")
    got = {frozenset(r) for r in S.links(points, 3, S.plan(points, 3)).distinct().collect()}
    groups = brute_components(signed, lambda a, b: any({a, b} <= g for g in got))
    assert len(set(groups.values())) == 1


def test_thresholds_add_up_and_are_cheapest():
    rng = random.Random(2)
    for _ in range(50):
        costs = [{t: rng.random() * 10 for t in range(-1, 4)} for _ in range(4)]
        cost, chosen = S.allocate(costs, 0)
        assert sum(chosen) == 0
        best = min(sum(c[t] for c, t in zip(costs, ts)) for ts in itertools.product(range(-1, 4), repeat=4) if sum(ts) == 0)
        assert abs(cost - best) < 1e-9


def test_links_are_complete_for_many_points(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in list(fps):
        for _ in range(3):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    points = spark.createDataFrame([(f, f) for f in signed], "key long, fp long")
    mask = (1 << 64) - 1
    want = brute_components(signed, lambda a, b: ((a ^ b) & mask).bit_count() <= 3)
    for block in (2048, 2):
        found = {(r.a, r.b) for r in S.links(points, 3, S.plan(points, 3), block).collect()}
        linked = defaultdict(set)
        for a, b in found:
            linked[a].add(b)
            linked[b].add(a)
        assert brute_components(signed, lambda a, b: b in linked[a]) == want


def test_near_copies_are_verified(spark):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10_000)}" for _ in range(300)]
    texts = []
    for k in range(6):
        t = list(base)
        for i in rng.sample(range(300), k):
            t[i] = f"n{rng.randint(0, 10_000)}"
        texts.append(" ".join(t))
    texts += [" ".join(f"u{rng.randint(0, 10_000)}" for _ in range(100)) for _ in range(20)] + ["", None, "a", "b"]
    df = spark.createDataFrame(rows_of(texts), DOCS)
    left = {r.doc_id for r in S.drop_near_copies(df).collect()}
    assert left == {0, *range(6, 27), 28, 29}  # null is one text with the empty one
    assert S.drop_near_copies(df).columns == df.columns
    assert S.drop_near_copies(empty(df)).count() == 0


# -- WARC ---------------------------------------------------------------------------------------------------------------

def test_warc_round_trip(spark):
    html = [None, "", "a", "a", "é" * 5000, "é" * 5000, "x\r\n\r\ny", "a", "z" * 200_000]
    rows = [(i, None if i == 6 else f"http://h/{i}\r\nX: y", h, "clash") for i, h in enumerate(html)] + [(2, "http://again", "a", "clash"), (None, "u", "a", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    archives = W.archive_pages(df, archive_bytes=3000)
    got = W.read_archives(archives, block=2).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    payloads = {str(i): (h or "").encode() for i, h in enumerate(html)} | {None: b"a"}
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", str(i))
    for r in got:
        body = payloads[r.key]
        assert r.payload_bytes == len(body) and r.payload_digest == W.sha1_base32(body)
        lead = first[body.decode()]
        assert (r.record_type, r.refers_to) == (("response", None) if r.key == lead else ("revisit", lead))
        assert r.payload is None or bytes(r.payload) == body
    assert W.read_archives(W.archive_pages(df.limit(0))).count() == 0
    # blocks of records are read by tasks of their own, however few bytes name them
    assert W.read_archives(archives, block=2, blocks_at_once=1).rdd.getNumPartitions() >= len(rows) // 2


def test_warc_names_and_broken_payloads(spark, tmp_path):
    names = [None, "", "a>\r\nWARC-Type: revisit", "é/%20 x", "urn:page:"]
    df = spark.createDataFrame([(n, "http://h/", f"body {i}") for i, n in enumerate(names)] + [("twin", "u", "body 2")], "page_id string, url string, html string")
    got = {r.key: r for r in W.read_archives(W.archive_pages(df)).collect()}
    assert set(got) == {*names, "twin"} and got["twin"].refers_to == names[2] and got[names[2]].record_type == "response"
    bad = spark.createDataFrame([("1", "u", bytearray(b"other"), W.sha1_base32(b"this"), None)], "key string, url string, payload binary, digest string, refers_to string")
    archives = W.write_archives(bad, f"file://{tmp_path}")
    assert [r.verified for r in W.read_archives(archives, strict=False).collect()] == [False]
    with pytest.raises(Exception, match="not what its record says"):
        W.read_archives(archives).collect()


@pytest.mark.parametrize("force", [False, True])
def test_zip_directories(force):
    out = io.BytesIO()
    z = W.StoredZip(out, zip64=force)
    z.member("archive/data.warc.gz", [b"abc", b"def"])
    z.member("indexes/index.jsonl", [b"{}"])
    z.close()
    found = W.zip_members(out, len(out.getvalue()))
    assert {n: W._at(out, *p) for n, p in found.items()} == {"archive/data.warc.gz": b"abcdef", "indexes/index.jsonl": b"{}"}
    with zipfile.ZipFile(out) as other:  # the standard library reads it
        assert other.testzip() is None and other.read("archive/data.warc.gz") == b"abcdef"
    theirs = io.BytesIO()
    with zipfile.ZipFile(theirs, "w", zipfile.ZIP_STORED) as other:
        with other.open("archive/data.warc.gz", "w", force_zip64=force) as f:
            f.write(b"hello")
        other.writestr(zipfile.ZipInfo("deflated"), b"x" * 50, compress_type=zipfile.ZIP_DEFLATED)
        other.comment = b"a comment"
    found = W.zip_members(theirs, len(theirs.getvalue()))
    assert set(found) == {"archive/data.warc.gz"} and W._at(theirs, *found["archive/data.warc.gz"]) == b"hello"
    with pytest.raises(ValueError):
        W.zip_members(io.BytesIO(b"no archive"), 10)


def test_warc_record_headers_cannot_be_forged():
    warc, _, payload = W.parse_record(W._record("1", "http://a\r\nWARC-Type: revisit", b"p", "D", None))
    assert warc["warc-type"] == "response" and payload == b"p" and gzip.decompress(W._record("1", "u", b"", "D", "2")).startswith(b"WARC/1.1")


# -- packing ------------------------------------------------------------------------------------------------------------

def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(150):
        m, k = rng.randint(1, 8), rng.randint(1, 5)
        lengths, counts = sorted(rng.sample(range(1, 40), m)), [rng.randint(1, 9) for _ in range(m)]
        pad = lambda ends: sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(lengths, counts))
        best = min(pad({*c, lengths[-1]}) for r in range(min(k, m)) for c in itertools.combinations(lengths[:-1], r))
        ends, padding = K.optimal_boundaries(lengths, counts, k)
        assert padding == best == pad(ends) and len(ends) <= k
    assert K.optimal_boundaries([], [], 3) == ([], 0)


def test_packing_holds_every_token_once(awkward):
    df, rows = awkward
    got = K.pack(df, buckets=4, max_tokens=50, token_budget=200, part_rows=7).collect()
    tokens = Counter()
    for r in rows:
        tokens[r[0]] += len((r[1] or "").split()) if r[1] is None or r[1].isascii() else len(re.findall(r"[^\x20\t\n\x0b\f\r]+", r[1]))
    have = Counter()
    for r in got:
        have[r.doc_id] += r.n_tokens
    assert {k: v for k, v in have.items() if v} == {k: v for k, v in tokens.items() if v}
    batches = defaultdict(list)
    for r in got:
        assert (r.bucket is None) == (r.n_tokens == 0)
        if r.bucket is not None:
            assert r.n_tokens <= r.bucket_tokens
            batches[r.bucket, r.batch].append(r)
    by_bucket = defaultdict(list)
    for (bucket, batch), rs in batches.items():
        assert len(rs) * rs[0].bucket_tokens <= 200 and sorted(r.slot for r in rs) == list(range(len(rs)))
        by_bucket[bucket].append((batch, len(rs)))
    for sizes in by_bucket.values():
        sizes.sort()
        assert [b for b, _ in sizes] == list(range(len(sizes))) and len({n for _, n in sizes[:-1]}) <= 1  # all full but the last
    assert K.pack(empty(df)).count() == 0


# -- licences -----------------------------------------------------------------------------------------------------------

def test_license_scan_base(spark, awkward):
    texts = [
        "All rights reserved. CC-BY 4.0, all  RIGHTS\nreserved", "cc by cc by", "GNU General Public License, version 3 or any later version", "", None, "accc by ccby cc bye",
        "Licensed under the Apache License, Version 2.0", "mit freundlichen", "the MIT License", "SPDX-License-Identifier: MIT License", "é cc by é", "x " * 9000 + "all rights reserved " * 500,
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
    ]
    df = spark.createDataFrame(rows_of(texts), DOCS)
    got = {r.doc_id: r for r in license_scan(df).collect()}
    phrases = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
        at = [(j, label) for p, label in phrases for j in range(len(words)) if words[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    labels = {i: r.labels for i, r in got.items()}
    assert labels[2] == "gpl,gpl-3-or-later" and labels[6] == "apache-2.0" and labels[7] == "" and labels[8] == "mit" and labels[12] == "mit"
    assert len(signature_rules()) > 200
    assert license_scan(awkward[0]).count() == len(awkward[1]) and license_scan(empty(df)).count() == 0


def sample_of(tree, rng):
    """A random text that a parsed regular expression matches."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, value = rng.choice(arg)
            out += chr(value) if str(kind) == "LITERAL" else chr(rng.randint(*value)) if str(kind) == "RANGE" else "w"
        elif name == "BRANCH":
            out += sample_of(rng.choice(arg[1]), rng)
        elif name == "SUBPATTERN":
            out += sample_of(arg[3], rng)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sample_of(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
        else:
            out += "w"
    return out


def rule_samples(rng, n):
    import re._parser as parser

    for rule in signature_rules():
        tree = parser.parse(rule.regex)
        yield rule, [sample_of(tree, rng) for _ in range(n)]


def test_every_form_of_every_rule_passes_its_own_gate():
    rules = signature_rules()
    assert len(rules) > 450 and len({r.regex for r in rules}) == len(rules)
    for rule, texts in rule_samples(random.Random(11), 60):
        assert all(re.fullmatch(rule.regex, t) and set(rule.keywords) <= set(t.split()) for t in texts), rule


def brute_labels(text, rules):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    line, hits = " " + " ".join(words) + " ", []
    for r in rules:
        if set(r.keywords) <= set(words):
            for m in re.finditer(f"(?<= )(?:{r.regex})(?= )", line):
                start = line[: m.start()].count(" ") - 1
                hits.append((start, -(start + m[0].count(" ")), -r.priority, r.label, r.weight))
    ends, labels, score = [-1] * 4, set(), 0.0
    for start, end, priority, label, weight in sorted(hits):
        if -end <= ends[-priority]:
            continue  # inside one of its own or a higher priority
        for p in range(-priority + 1):
            ends[p] = max(ends[p], -end)
        labels.add(label)
        score = max(score, weight)
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        if f" {phrase} " in line:
            labels.add(label)
            score = max(score, 0.9)
    return len(words), ",".join(sorted(labels)), score


def test_license_scan_against_brute_force(spark):
    rng = random.Random(12)
    pool = [t for _, texts in rule_samples(rng, 2) for t in texts]
    plain = ["the", "mit", "with", "software", "license", "public", "free", "copyright", "rights", "und"]
    texts = [" ".join(x for _ in range(rng.randint(1, 8)) for x in (rng.choice(pool), *rng.choices(plain, k=rng.randint(0, 4)))) for _ in range(150)] + ["", None, "MIT License. " * 1500]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows_of(texts), DOCS).repartition(4)).collect()}
    rules = signature_rules()
    for i, t in enumerate(texts):
        n, labels, score_ = brute_labels(t, rules)
        assert (got[i].n_words, got[i].labels) == (n, labels) and abs(got[i].score - score_) < 1e-9, t


# -- html ---------------------------------------------------------------------------------------------------------------

PAGE = "<html><head><title>T</title><style>p{{}}</style></head><body><header><a href=/>Home</a></header><nav><ul><li>Menu</ul></nav>{}<footer>&copy; x</footer></body></html>"


def test_html_blocks():
    cases = {
        "<article><h1>A &amp; B</h1><p>one  two<br>three <b>b</b>old<p>four</article>": "A & B one two three bold four",
        "<article><p>x<script>var a='</p>'</script> y</p><aside>ad</aside><div class='comments'><p>no</p></div><div class=ad>no</div></article>": "x y",
        "<main><div class='cookie-notice'>no</div><form>no<input></form><p>yes &#233;&nbsp;z</main>": "yes é z",
        "<article><p>cut &amp; of": "cut & of",
        "": "",
    }
    for body, want in cases.items():
        assert H.main_text(H.page_lines(PAGE.format(body)), [], 0.5)[0].removesuffix(" © x") == want


def test_common_lines_are_longest():
    rng = random.Random(6)
    for n, letters in [(9, "abcd")] * 200 + [(70, "ab"), (90, "a"), (60, "abc")] * 5:
        a, b = ([rng.choice(letters) for _ in range(rng.randint(0, n))] for _ in range(2))
        length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                length[i + 1][j + 1] = length[i][j] + 1 if x == y else max(length[i][j + 1], length[i + 1][j])
        found = sorted(H.common_lines(a, b))
        assert len(found) == length[-1][-1]
        it = iter(b)
        assert all(any(a[i] == y for y in it) for i in found)
    # one line that repeats: neither time nor memory grows with the square
    assert len(H.common_lines(["x", *["same"] * 20_000], [*["same"] * 20_000, "y"])) == 20_000


@pytest.mark.parametrize("range_rows", [2, 3, 1000])
def test_differencing_removes_what_neighbours_share(spark, range_rows):
    plain = "<html><body><div>Site slogan</div><div>Latest news from us</div><div>{}</div><div>{}</div><div>Call 555</div></body></html>"
    rows = [(i, f"http://h.example/a/{i:03d}", plain.format(f"story {i} is long enough to count as text", f"and ends {i} like this"), 1) for i in range(20)]
    rows += [(30, "http://h.example/a/005", rows[5][2], 1), (31, None, None, 1), (32, "nowhere", "<p>alone", 1), (33, "http://one.example/x", PAGE.format("<article>Only</article>"), 1), (33, "http://one.example/x", PAGE.format("<article>Only</article>"), 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, range int").repartition(4)
    got = defaultdict(list)
    for r in H.extract_main_text(df, range_rows=range_rows).collect():
        got[r.page_id].append(r.text)
    for i in range(20):
        assert got[i] == [f"story {i} is long enough to count as text and ends {i} like this"]
    assert got[30] == got[5] and got[31] == [""] and got[32] == ["alone"] and got[33] == ["Only", "Only"]
    assert H.extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("range_rows", [9, 1000])
def test_differencing_decides_on_marked_pages(spark, range_rows):
    """A notice in every article goes, a passage that some articles quote stays; mirrors in a row hide neither."""
    page = "<body><article><h1>Title {0}</h1><div>Subscribe to our letter today</div><p>Story {0} begins and goes on for a while</p>{1}<p>Thanks for reading this page</p></article></body>"
    quote = "<p>A passage that two articles quote in full</p>"
    pages = [page.format(i, quote if i in (3, 4) else "") for i in range(12)]
    urls = [f"http://h.example/a/{i:02d}" for i in range(12)]
    rows = list(zip(range(12), urls, pages)) + [(100 + i, f"http://h.example/a/06-{i:02d}", pages[6]) for i in range(11)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in H.extract_main_text(df, range_rows=range_rows).collect()}
    for i in range(12):
        assert got[i] == f"Title {i} Story {i} begins and goes on for a while" + (" A passage that two articles quote in full" if i in (3, 4) else ""), i
    if range_rows == 1000:
        assert {got[100 + i] for i in range(11)} == {got[6]}
    alone = {r.page_id: r.text for r in H.extract_main_text(df.where("page_id = 5")).collect()}
    assert alone[5] == "Title 5 Subscribe to our letter today Story 5 begins and goes on for a while Thanks for reading this page"
    long = "<body>" + "<div>same line</div>" * 3000 + "<div>" + "own{0} " * 1000 + "</div></body>"
    df = spark.createDataFrame([(i, f"http://l.example/{i}", long.format(i)) for i in range(3)], "page_id long, url string, html string")
    assert {r.text for r in H.extract_main_text(df).collect()} == {" ".join([f"own{i}"] * 1000) for i in range(3)}


# -- urls ---------------------------------------------------------------------------------------------------------------

def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?y#z", "http://example.org/en/123", "http://example.org/en/2", "http://xexample.org/es/", "https://m.x.COM/de/1", "http://x.com/fr/", "http://org",
            "http://net.net/a/b/c/d/e/f", "x://y.org?/es/", "http://x.com/de", "a://b://c.org/", "http://org/\n/x"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)] + [(5, urls[5], "c")], "page_id long, url string, template string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(df).collect()}
    assert url_filter(df).count() == len(urls) + 1 and url_filter(df.limit(0)).count() == 0
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[4][2:] == ("example.org/en/1", "block") and got[5][2:] == ("org/", "allow")
    assert got[6][2:] == ("org/", "allow") and got[7] == ("m.x.com", "/de/1", "com/de/", "block") and got[8][2:] == ("com/fr/", "allow")
    assert got[9] == ("org", "", None, "allow") and got[11] == ("y.org", "", None, "allow") and got[12][2] is None and got[13][0] == "b:"
    assert got[14][2] == "org/"


def test_templates_generalise_blocked_branches(spark):
    rules = (("h.com", "/spam/1", "block"), ("h.com", "/good/", "allow"))
    urls = [f"http://h.com/spam/{i}" for i in [*range(100, 160), *range(200, 215)]] + [f"http://h.com/good/{i}" for i in range(60)] + ["http://unknown.net/spam/7", "http://unknown.net/good/7"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter(df, rules=rules).collect()}
    assert all(got[i].verdict == "block" and got[i].rule is None and got[i].template == "/spam/*" for i in range(60, 75))
    assert all(got[i].verdict == "allow" for i in range(75, 135))
    assert [got[i].verdict for i in (135, 136)] == ["block", "allow"] and got[135].rule is None  # what labels say of a shape holds on hosts without any


def brute_templates(urls, rules, min_share, z, strength, reject):
    """url -> (template, purity): the tree by plain recursion over all pages."""
    def parts(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        return (m[1].lower(), m[2]) if m else ("", "")

    def label(h, p):
        fits = [(len(a + b), v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        return max(fits)[1] if fits else None

    pages = []
    for u in urls:
        h, p = parts(u)
        pages.append((h, tuple("/#" if re.search("[0-9]", s) else s for s in p.split("/") if s), label(h, p)))
    tally = lambda rows: (len(rows), sum(r[2] == "block" for r in rows), sum(r[2] == "allow" for r in rows))
    _, bad, good = tally(pages)
    share = bad / max(1, bad + good)
    prior = {}
    for shape in {p[1] for p in pages}:
        _, b, g = tally([p for p in pages if p[1] == shape])
        prior[shape] = (b + strength * share) / (b + g + strength)
    template = {}

    def grow(groups, k):
        """groups: template so far -> pages; a node is all pages of one template."""
        for name, rows in groups.items():
            n, b, g = tally(rows)
            by = defaultdict(list)
            for r in rows:
                by[r[1][k] if k < len(r[1]) else ""].append(r)
            after = defaultdict(list)
            for seg, own in by.items():
                m, x, y = tally(own)
                rate = b / (b + g) if b + g else None
                spread = (rate * (1 - rate) / (x + y)) ** 0.5 if x + y and rate is not None else 0
                alike = not spread or abs(x / (x + y) - rate) / spread < z
                variable = seg == "/#" or m < n * min_share
                part = "" if seg == "" else "/*" if variable and alike else "/~" if alike and x + y else seg if seg == "/#" else "/" + seg
                after[name + part] += own
            for t, own in after.items():
                if max(len(r[1]) for r in own) > k + 1:
                    grow({t: own}, k + 1)
                else:
                    for r in own:
                        template[r[:2]] = t

    for host in {p[0] for p in pages}:
        grow({"": [p for p in pages if p[0] == host]}, 0)
    out = {}
    for u, (h, shape, _) in zip(urls, pages):
        t = template[h, shape]
        own = [p for p in pages if p[0] == h and template[p[:2]] == t]
        _, b, g = tally(own)
        mean = sum(prior[p[1]] for p in own) / len(own)
        out[u] = (t, round((b + strength * mean) / (b + g + strength), 6))
    return out


def test_template_tree_against_brute_force(spark):
    rng = random.Random(10)
    rules = (("a.com", "/x/", "block"), ("a.com", "/q/", "block"), ("a.com", "/y/k/", "allow"), ("b.org", "/", "allow"), ("b.org", "/x/7", "block"))
    urls = sorted({f"http://{rng.choice(['a.com', 'b.org', 'www.b.org', 'c.net', 'big.net', 'big.net'])}" + "".join("/" + rng.choice(["x", "y", "k", "m", str(rng.randint(1, 99)), "v7", "rare" + rng.choice("abcdefgh")]) for _ in range(rng.randint(0, 4))) for _ in range(400)})
    urls += ["http://c.net/" + "/".join(f"s{'abc'[i % 3]}" for i in range(300)), None, "none", "http://c.net/", *[f"http://{h}/q/{i}" for h in ("a.com", "c.net") for i in range(30)]]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(9999, urls[0])], "page_id long, url string").repartition(3)
    want = brute_templates([*urls, urls[0]], rules, 0.05, 1.96, 4.0, 0.6)
    got = url_filter(df, rules=rules, min_share=0.05, reject=0.6).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        u = urls[0] if r.page_id == 9999 else urls[r.page_id]
        assert r.template == want[u][0] and abs(r.purity - want[u][1]) < 2e-6, (u, r, want[u])
        assert r.rule is not None or r.verdict == ("block" if r.purity >= 0.6 else "allow")
    assert {r.verdict for r in got if r.rule is None} == {"block", "allow"}


# -- learned operators --------------------------------------------------------------------------------------------------

def test_language_id(spark):
    vocabulary = {"aa": ["wasser", "straße", "über", "nicht", "und"], "bb": ["water", "street", "over", "the", "and"], "cc": ["вода", "улица", "над", "не", "и"]}
    rng = random.Random(7)
    texts, langs = [], []
    for _ in range(150):
        lang = rng.choice(list(vocabulary))
        texts.append(" ".join(rng.choices(vocabulary[lang], k=12)))
        langs.append(lang)
    texts += ["", None, "12 34 !!", "the", "ß", "😀"]
    langs += [None] * 6
    df = spark.createDataFrame(rows_of(texts, langs), DOCS)
    model = fit_languages(df, "doc_id", "text", "lang", slots=1 << 14)
    got = {r.doc_id: r for r in predict_languages(df, model, keep=["doc_id", "kept"]).collect()}
    assert all(got[i].lang_pred == langs[i] and 0 < got[i].score <= 1 for i in range(150))
    assert [got[i].lang_pred for i in (150, 151, 152, 155)] == ["und"] * 4 and got[150].score == 0 and got[153].lang_pred == "bb"
    left = keep_known_languages(df, model)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {*range(150), 153, 154} - ({154} if got[154].share < 0.75 else set())
    assert predict_languages(df.limit(0), model).count() == 0
    nothing = fit_languages(df.limit(0), "doc_id", "text", "lang")
    assert {r.lang_pred for r in predict_languages(df, nothing).collect()} == {"und"}


def test_language_filters_hold_every_gram(spark):
    """One text of n-grams that stand once makes a language; so do 70 languages, in two words; identifiers repeat or are null."""
    texts = ["qwzx vbnm"] + [chr(0x4E00 + 50 * k) * 3 + " " + chr(0x4E01 + 50 * k) * 2 for k in range(69)]
    langs = [f"l{k:02d}" for k in range(70)]
    for key in (F.lit(7), F.lit(None).cast("long")):
        df = spark.createDataFrame(rows_of(texts, langs), DOCS).withColumn("doc_id", key)
        model = fit_languages(df, "doc_id", "text", "lang")
        assert model.languages == langs and model.table.shape[1] == 2
        grams = {name: set(gram_hashes([t])[0].tolist()) for t, name in zip(texts, langs)}
        for i, name in enumerate(langs):
            at = _slots(np.array(sorted(grams[name]), np.uint64), len(model.table), model.probes)
            assert all(((model.table[x, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all() for x in at)
        assert {r.lang: r.lang_pred for r in predict_languages(df, model).collect()} == dict(zip(langs, langs))


def test_samples_are_bounded_whatever_repeats(spark):
    rows = [(1, "one text", "a")] * 300 + [(1, f"text {i}", "a") for i in range(300)] + [(None, f"null {i}", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string, lang string").repartition(3)
    sample, sizes = bounded_sample(df, "lang", ["id", "text"], 40)
    got = Counter(r.lang for r in sample.collect())
    assert sizes == {"a": 600, "b": 300} and 5 <= got["a"] <= 60 and 20 <= got["b"] <= 60
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (2, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, f"t {i}") for i in range(500)] + [(None, "n"), (2, "two")], "doc_id long, text string")
    model = fit_quality(docs, labels, max_rows=20, dimensions=2)
    assert 10 <= len(model.labels) <= 41 and set(model.labels) == {0, 1}  # of conflicting labels the larger


def test_workers_need_no_copy_of_the_package(spark):
    """What is sent out are plain arrays and functions by value."""
    import pickle

    from weft.llm import language_id, quality

    df = spark.createDataFrame(rows_of(["the water", "die straße"], ["x", "y"]), DOCS)
    for sent in (tuple(fit_languages(df, "doc_id", "text", "lang")), tuple(fit_quality(df, df.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")))):
        assert b"weft" not in pickle.dumps(sent)
    from pyspark import cloudpickle

    assert all(b"cweft" not in cloudpickle.dumps(f, 2) for f in (language_id.predict, quality.score))


def test_quality_neighbours_and_held_out(spark):
    rng = random.Random(8)
    good = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(60)) + "."
    bad = lambda: "!! ".join("".join(rng.choices("ABCDEFGH", k=5)) for _ in range(50))
    texts = [good() if i % 3 else bad() for i in range(120)] + ["", None]
    df = spark.createDataFrame(rows_of(texts), DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(80)] + [(81, None, 0)], "doc_id long, quality int, toxic int")
    model = fit_quality(df, labels, dimensions=8, neighbours=5)
    got = {r.doc_id: r.score for r in score_quality(df, model, keep=["doc_id"]).collect()}
    assert all((got[i] >= 0.7) == (i % 3 > 0) for i in range(80, 120)) and all(0 <= s <= 1 for s in got.values()) and len(got) == 122
    # the votes are those of exact cosines
    cosine = embed(model.idf, model.projection, texts[80:90]) @ model.vectors.T
    for row, found in zip(cosine, score(*model, texts[80:90])):
        near = np.argsort(-row)[:5]
        vote = np.maximum(row[near], 0) ** 8 * model.weights[near]
        assert abs(found - (vote * model.labels[near]).sum() / vote.sum()) < 1e-3
    # a label whose rows are cut to a part of them keeps its whole weight
    cut = fit_quality(df, labels, dimensions=8, neighbours=5, max_rows=20)
    assert abs(cut.weights[cut.labels == 1].sum() - 53) < 1e-6 and abs(cut.weights[cut.labels == 0].sum() - 27) < 1e-6
    one = fit_quality(df, labels.where("quality = 1"))
    assert {r.score for r in score_quality(df, one).collect()} == {1.0}
    none = fit_quality(df, labels.limit(0))
    assert {r.score for r in score_quality(df, none).collect()} == {0.5}


# -- decontamination ----------------------------------------------------------------------------------------------------

def brute_hits(text, items, window):
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))]
    hit, names = set(), set()
    for name, item in items:
        own = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(item))]
        size = min(window, len(own))
        if not size:
            continue
        grams = {tuple(own[j : j + size]) for j in range(len(own) - size + 1)}
        for j in range(len(words) - size + 1):
            if tuple(words[j : j + size]) in grams:
                hit.update(range(j, j + size))
                names.add("" if name is None else str(name))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("shard_words,block_words,window", [(40, 20, 4), (1_000_000, 1_000_000, 3), (7, 1_000_000, 10)])
def test_decontamination(spark, awkward, shard_words, block_words, window):
    rng = random.Random(9)
    words = ["a", "b", "c", "d", "é"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 14)))) for i in range(12)] + [(3, "a b C d a"), (None, "c c c c"), (20, None), (21, ""), (22, "zz yy xx ww vv uu")]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(40)] + [None, "", "x " * 500, "a " * 300, "q zz yy xx ww vv uu p"]
    df = spark.createDataFrame(rows_of(texts), DOCS).unionByName(awkward[0]).repartition(3)
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, shard string")
    rows = rows_of(texts) + awkward[1]
    want = Counter((r[0], n, h, tuple(s)) for r in rows for n, h, s in [brute_hits(r[1], items, window)])
    got = D.decontaminate(df, bench, window=window, shard_words=shard_words, block_words=block_words).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got)
    clean = D.drop_contaminated(df, bench, window=window)
    # row by row: one identifier, null too, may have a text that is hit and one that is not
    assert clean.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((r[0], r[1]) for r in rows if not brute_hits(r[1], items, window)[1])
    twins = spark.createDataFrame(rows_of(["zz yy xx ww vv uu", "clean words here only"] * 2), DOCS)
    for name in (F.lit(1), F.lit(None).cast("long")):
        assert D.drop_contaminated(twins.withColumn("doc_id", name), bench, window=window).count() == 2
    assert D.decontaminate(empty(df), bench).count() == 0 and {r.n_hit for r in D.decontaminate(df, bench.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame(rows_of(["one x two y three", "three two one", "one x x x x x two three", "one two"]), DOCS)
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = {r.doc_id: r.near_items for r in D.decontaminate(docs, bench, span=5).collect()}
    assert got == {0: ["1"], 1: ["1"], 2: [], 3: []}
