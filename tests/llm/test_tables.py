"""Operators over whole tables: chat snapshots, WARC, shards, paragraphs, urls, SimHash."""

import random
import textwrap
import zlib

import pytest
from pyspark.errors import PySparkException

from bugsieve.llm import chat, paragraphs, shards, simhash, urls, warc
from tests.llm import brute


# Chat -----------------------------------------------------------------------------------------


def collapsed(df):
    return sorted((tuple(r) for r in chat.snapshots_collapsed(df).collect()), key=repr)


def test_chat_snapshots(spark):
    rows = []
    say = lambda c, *turns: rows.extend((c, t, r, x) for t, (r, x) in enumerate(turns))
    hello, answer = ("user", "hello"), ("assistant", "hi")
    say(1, hello)
    say(2, hello, answer)
    say(3, hello, answer, ("user", "more"))
    say(4, hello, answer, ("user", "more"))
    say(5, hello, (None, "hi"), ("user", None))
    say(6, hello, (None, "hi"))
    say(7, hello, (None, "hi"), ("user", ""))
    say(8, ("user", ""))
    say(9, *[("user", f"turn {i % 7}") for i in range(700)])
    say(10, *[("user", f"turn {i % 7}") for i in range(520)])
    say(11, *[("user", f"turn {i % 7}") for i in range(519)], ("user", "else"))
    say(None, hello, answer, ("user", "other"))
    rows += [(12, 5, "user", "b"), (12, 5, "user", "a"), (12, 5, None, None), (12, None, "system", "first"), (12, 5, "user", "a")]
    rows += [(13, 100, "user", "hello"), (13, 4000, "assistant", "hi")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, run string")
    assert collapsed(df) == sorted(brute.chats(rows), key=repr)
    assert collapsed(df.limit(0)) == []


def test_chat_random(spark):
    rng = random.Random(9)
    rows = [(c, t, "user", rng.choice("ab")) for c in range(120) for t in range(rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert collapsed(df) == sorted(brute.chats(rows), key=repr)


# WARC -----------------------------------------------------------------------------------------

LONG = "<p>é" * 40
PAGES = [
    (1, "http://a/\r\nx", LONG, "c"), (2, "u", LONG, "c"), (3, None, "short", "c"), (4, "u", "short", "c"), (5, "u", None, "c"),
    (6, "u", "", "c"), (7, "u", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n0\r\n\r\n" * 9, "c"),
    (0, "u", LONG, "c"), (None, "u", LONG, "c"), (None, "u", "only here " * 20, "c"), (9, "u", "x" * 5000, "c"), (9, "v", "x" * 5000, "c"),
    (10, "u", "x" * 5000, "c"),
]


@pytest.mark.parametrize("segment,chunk", [(32 << 10, 8 << 10), (64, 16), (100, 1000)])
def test_warc_round_trip(spark, tmp_path, segment, chunk):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string").repartition(3)
    warc.write(df, str(tmp_path / "w"), segment=segment, chunk=chunk)
    rows = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(rows) == len(PAGES)
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows), key=repr)
    raw = [(i, (h or "").encode()) for i, _, h, _ in PAGES]
    want = []
    for i, data in raw:
        same = [j for j, d in raw if d == data and j is not None]
        first = min(same, default=None) if len(data) >= 100 else None
        revisit = first is not None and first != i
        want.append((i, len(data), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=repr)
    bodies = [bytes(r["payload"]).decode() for r in rows if r["record_type"] == "response"]
    assert sorted(bodies) == sorted((d.decode() for (_, d), w in zip(raw, want) if w[2] == "response"))
    assert all(r["payload"] is None for r in rows if r["record_type"] == "revisit")


def test_warc_detects_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "abc" * 100)], "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "w"), segment=200)
    (file,) = (tmp_path / "w").glob("*.gz")
    whole = zlib.decompress(file.read_bytes(), 31)
    parts = [p for p in whole.split(b"WARC/1.1\r\n") if p]

    def reread(data, name):
        (tmp_path / name).mkdir()
        z = zlib.compressobj(wbits=31)
        (tmp_path / name / "x.gz").write_bytes(z.compress(data) + z.flush())
        return warc.read(spark, str(tmp_path / name))

    assert reread(whole, "same").count() == 1
    for name, data in {
        "lost": b"".join(b"WARC/1.1\r\n" + p for p in parts[:-1]),
        "middle": b"".join(b"WARC/1.1\r\n" + p for p in (parts[0], *parts[2:])),
        "cut": whole[:-10],
        "changed": whole.replace(b"abcabc", b"abcabd"),
    }.items():
        with pytest.raises(PySparkException):
            reread(data, name).collect()


def test_warc_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0


# Shards ---------------------------------------------------------------------------------------


def shard_rows(df, **more):
    return shards.assign(df, **more).collect()


@pytest.mark.parametrize("case", ["mixed", "hot", "same id", "one large"])
def test_shards_are_near_equal(spark, case):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("aé ") for _ in range(rng.randint(0, 60)))) for i in range(3000)]
    if case == "hot":
        rows = [(i, "copy " * 5 if i % 3 else t) for i, t in rows]
    if case == "same id":
        rows = [(7, "copy " * 5) for _ in rows] + [(None, None), (1, "")]
    if case == "one large":
        rows += [(4000, "z" * 500_000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, shard int, _h int").repartition(6)
    got = shard_rows(df)
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted(
        (i or -1, size(t), zlib.crc32((t or "").encode())) for i, t in rows
    )
    total = sum(size(t) for _, t in rows)
    largest = max(size(t) for _, t in rows)
    for k in range(8):
        mine = [r for r in got if r["shard"] == k]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        if case != "one large":
            assert abs(sum(r["size"] for r in mine) - total / 8) <= 0.002 * total / 8 + largest


def test_shards_of_few_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["size"]) for r in shard_rows(df)) == [(1, 2), (2, 1)]
    assert shard_rows(df.limit(0)) == []


def test_shards_written(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}" * (i % 9), i) for i in range(800)], "doc_id long, text string, _r int")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    shards.write(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.select("doc_id", "text", "_r").collect()) == sorted(tuple(r) for r in df.collect())
    sizes = [sum(len(r["text"]) + 1 for r in back.filter(f"shard = {k}").collect()) for k in range(4)]
    assert max(sizes) - min(sizes) <= 160


# Paragraphs -----------------------------------------------------------------------------------


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."


def test_bands_meet_the_recall():
    for similarity in (0.5, 0.8, 0.9):
        bands, rows = paragraphs.bands_for(similarity, 0.99, 64)
        assert 1 - (1 - similarity**rows) ** bands >= 0.99


def test_paragraph_places():
    text = "Short one. " + "w " * 20 + "end. tail\n  " + "x " * 16 + "\nlast few"
    found = [(text[a:b], len(w)) for a, b, w in paragraphs.paragraphs_of(text)]
    assert found == [(text[:55], 23), ("x " * 15 + "x", 16)]
    assert list(paragraphs.paragraphs_of("")) == []


def planted(rng, words, layout):
    """Two texts with one passage of over 50 words after different openings."""
    short = lambda: sentence(rng, rng.randint(4, 14))
    passage = short()
    while len(passage.split()) < words:
        passage += " " + short()
    return [layout(" ".join([*(short() for _ in range(rng.randint(1, 4))), passage, short(), short()])) for _ in "ab"]


def verse(text):
    ws = text.replace(".", "").split()
    return "\n".join(" ".join(ws[k : k + 6]) for k in range(0, len(ws), 6))


@pytest.mark.parametrize("words,layout,least", [
    (100, str, 0.9), (60, str, 0.75), (100, lambda t: textwrap.fill(t, 72), 0.9), (60, lambda t: textwrap.fill(t, 72), 0.75), (100, verse, 0.9), (60, verse, 0.6)
])
def test_planted_passages_share_a_paragraph(words, layout, least):
    rng = random.Random(12)
    found = 0
    for _ in range(200):
        a, b = ([t[x:y] for x, y, _ in paragraphs.paragraphs_of(t)] for t in planted(rng, words, layout))
        found += any(similar(x, y) for x in a for y in b)
    assert found >= least * 200


def similar(a, b):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    x, y = grams(a), grams(b)
    return len(x & y) >= 0.8 * len(x | y)


def test_paragraph_classes_against_all_pairs(spark):
    rng = random.Random(4)
    base = [sentence(rng, rng.randint(18, 40)) for _ in range(25)]
    texts = [None, "", "too short."]
    for k in range(90):
        p = base[k % 25]
        words = p.split()
        if k % 3 == 1:
            words[-2] = "edited"
        if k % 3 == 2:
            words[0], words[9] = "Other", "changes"
        texts.append(sentence(rng, 17) + " " + " ".join(words) + "\n" + sentence(rng, 30) + " stray words")
    texts += [texts[5], texts[5].upper()]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    rows = paragraphs.occurrences(df).collect()
    units = {(i, a): t[a:b] for i, t in enumerate(texts) for a, b, _ in paragraphs.paragraphs_of(t or "")}
    label = brute.components(units, lambda x, y: similar(units[x], units[y]))
    sizes = {}
    for v in label.values():
        sizes[v] = sizes.get(v, 0) + 1
    want = {(*u, *v, sizes[v], u != v) for u, v in label.items() if sizes[v] > 1}
    got = {(r["doc_id"], r["start"], r["first_doc_id"], r["first_start"], r["n_alike"], r["removed"]) for r in rows}
    assert len(want) > 60 and got == want
    assert paragraphs.occurrences(df.limit(0)).count() == 0
    cleaned = {r["doc_id"]: r for r in paragraphs.without_repeats(df).collect()}
    assert len(cleaned) == len(texts) and cleaned[0]["text"] is None and cleaned[4]["start"] == 0
    cuts = sum(b - a for r in rows if r["removed"] for a, b in [(r["start"], r["stop"])])
    assert sum(len(t or "") for t in texts) - sum(len(r["text"] or "") for r in cleaned.values()) == cuts


def test_paragraphs_of_one_large_group(spark):
    """Variations of one template, far more than a bucket's reach: not every two are alike, yet
    all are connected, and the classes are those of comparing all pairs."""
    rng = random.Random(8)
    words = sentence(rng, 60).split()
    texts = []
    for k in range(500):
        own = list(words)
        own[rng.randint(3, 55)] = f"v{k}"
        texts.append(" ".join(own))
    texts += texts[:100] + [sentence(rng, 40) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = paragraphs.occurrences(df).collect()
    label = brute.components(range(600), lambda x, y: similar(texts[x], texts[y]))
    assert {(r["doc_id"], r["first_doc_id"]) for r in rows} == set(label.items())
    assert {r["doc_id"] for r in rows if not r["removed"]} == set(label.values())


def test_large_buckets_lose_no_link(spark):
    """Paragraphs with a long opening in common share buckets, yet few are alike: the classes are the
    same whatever the reach, and those of all pairs that share a bucket."""
    rng = random.Random(5)
    opening = sentence(rng, 40).rstrip(".").split()
    texts = []
    for k in range(250):
        tail = [f"t{k}x{i}" for i in range(22)]
        other = [*tail[:16], *(f"o{k}x{i}" for i in range(6))] if k % 2 else [f"o{k}x{i}" for i in range(22)]
        texts += [" ".join(opening + end) for end in (tail, other)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [{tuple(r) for r in paragraphs.occurrences(df, reach=n).collect()} for n in (1, 8, 10_000)]
    assert len(found[2]) > 200 and found[0] == found[1] == found[2]


# Urls -----------------------------------------------------------------------------------------

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
URLS = [
    None, "", "no scheme/en/", "http://", "http://A.Example.NET/en/1?x=/de/", "https://example.net/de/1", "ftp://net/x", "x://net",
    "http://notexample.com/de/", "http://a.b.example.com/de/x#/en/", "http://example.com/DE/", "http://w.org/fr/", "http://org.uk/fr/",
    "a://b.net/en/://c.org/fr/", "http://Éx.org?q=://net/", "http://evilorg/fr/", "http://x.net#frag", "h://\nnet/\n", "http://a" + "b" * 9000 + ".net/",
]


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, stops: next((i for i, c in enumerate(s) if c in stops), len(s))
    n = cut(rest, "/?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    return host, rest[n:][: cut(rest[n:], "?#")]


def plain_rule(host, path):
    fits = []
    for verdict, rule in RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


@pytest.fixture(scope="module")
def model(spark):
    return urls.train(urls.labelled_urls(spark))


def test_url_parts_and_rules(spark, model):
    df = spark.createDataFrame([(i, u, "h", i) for i, u in enumerate(URLS)], "page_id long, url string, host string, prediction int")
    rows = {r["page_id"]: r for r in urls.judge(df, model, RULES).collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path)
        r = rows[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
        assert r["prediction"] == i
    kept = urls.allowed(df, model, RULES)
    assert kept.schema == df.schema
    assert {r["page_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["verdict"] == "allow"}
    assert urls.judge(df.limit(0), model, RULES).count() == 0


def test_url_trees_on_held_out_hosts(spark, model):
    """Hosts that are not among the labelled ones."""
    blocked = ["cheap-watches.example.org", "www.casino-night.example.com", "bets-free.example.net", "spam-host.example.com", "track-ads.example.org"]
    good = ["letters.example.org", "www.mountain.example.com", "thersh.example.net", "blog.ththre.example.org", "opera.example.net"]
    rows = [(f"https://{h}{p}", h in blocked) for h in blocked + good for p in urls.LABELLED_PATHS]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    right = urls.judge(df, model).filter("(verdict = 'block') = bad").count()
    assert right / len(rows) >= 0.9


def test_url_training_needs_both_labels(spark):
    with pytest.raises(ValueError):
        urls.train(spark.createDataFrame([("http://a", 1), (None, 0)], "url string, blocked int"))


# SimHash --------------------------------------------------------------------------------------


def test_fingerprints_against_plain_counting():
    rng = random.Random(6)
    texts = [None, "", "  ", "One", "one TWO", "É é x", "a b c a b c a b c", "x " * 2000]
    texts += [" ".join(rng.choice(["a", "B", "çd", "e"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint_of(t) == brute.fingerprint(t), t


def test_long_texts_are_hashed_in_steps(monkeypatch):
    text = " ".join(str(i) for i in range(500))
    whole = simhash.fingerprint_of(text)
    monkeypatch.setattr(simhash, "_STEP", 7)
    assert simhash.fingerprint_of(text) == whole


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_masks_cover_every_pair(radius):
    masks = [m % (1 << 64) for m in simhash.masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1
    spots = [(a, b) for a in range(64) for b in range(64)] if radius == 2 else [(a, a) for a in range(64)] if radius else [()]
    for spot in spots:
        differ = sum(1 << b for b in set(spot))
        assert any(m & differ == 0 for m in masks)


@pytest.mark.parametrize("radius,bucket", [(2, 32), (2, 2), (1, 1), (0, 2)])
def test_components_against_all_pairs(spark, radius, bucket):
    rng = random.Random(radius * 10 + bucket)
    points = set()
    for _ in range(12):
        point = rng.getrandbits(64)
        for _ in range(25):
            points.add(point)
            point ^= 1 << rng.randint(0, 63) if rng.random() < 0.7 else 1 << rng.randint(0, 63) | 1 << rng.randint(0, 63)
    points = sorted(points)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(1000 - i, signed(p)) for i, p in enumerate(points)] + [(5000, signed(points[0])), (None, signed(points[3]))]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.components(df, "doc_id", "fp", radius, bucket).collect()}
    label = brute.components(points, lambda x, y: (x ^ y).bit_count() <= radius)
    least = {}
    for i, p in enumerate(points):
        least[label[p]] = min(least.get(label[p], 10**9), 1000 - i)
    assert got == {signed(p): least[label[p]] for p in points}


def test_near_duplicates_and_keep_one(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 30
    rows = [(5, text), (3, text + "tail"), (9, text.upper()), (3, text + "tail"), (7, "other words entirely here"), (8, None), (2, ""),
            (None, "lonely text of nobody else"), (None, "lonely text of nobody else"), (None, text), (7, "a second text under the id seven")]
    df = spark.createDataFrame([(i, t, k, "c") for k, (i, t) in enumerate(rows)], "doc_id long, text string, _kept_id int, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = [brute.fingerprint(t) for _, t in rows]
    label = brute.components(sorted(set(fps)), lambda x, y: (x ^ y).bit_count() <= 2)
    ids = {}
    for (i, _), f in zip(rows, fps):
        ids.setdefault(label[f], []).append(i)
    least = {c: min((i for i in x if i is not None), default=None) for c, x in ids.items()}
    want = sorted(((i, f"{f:016x}", least[label[f]]) for (i, _), f in zip(rows, fps)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    stay = sorted((brute.fingerprint(r["text"]) for r in kept.collect()), key=lambda f: label[f])
    assert sorted(label[f] for f in stay) == sorted(ids)
    assert {r["doc_id"] for r in kept.collect()} == set(least.values())
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.keep_one(df.limit(0)).count() == 0
