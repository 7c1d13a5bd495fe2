"""Url verdicts, leaderboard changes and source divergence against plain versions, on rows that are hard."""

import datetime as dt
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scenelake.llm import divergence, leaderboards, queries, url_rules

# --- urls -------------------------------------------------------------------------------------------------------

RULES = [url_rules.Rule(*x) for x in queries.URL_RULES]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
URLS = [None, "", "no scheme", "http://", "http://A.Example.NET/en/1", "https://a.example.net/de/1?x=/en/", "ftp://b.example.com/de/#x", "http://b.example.com/fr/", "http://x.org/fr/1", "http://x.org/en/1", "http://org", "http://notexample.net/en/", "http://net/q", "http://c.io:80/a?b://c/d", "http://d.io#/fr/", "http://ÄÖ.org/fr/é"]


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match("[^?#]*", rest[len(host) :])[0]


def plain_urls(rows, rules, rounds=20):
    """page_id, host, path, rule, verdict, trust, distrust of (page_id, url, html)."""
    got, per, links = [], defaultdict(Counter), Counter()
    for page, url, html in rows:
        host, path = split(url)
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.host + r.path), default=None)
        got.append((page, host, path, best))
        if host:
            per[host]["pages"] += 1
            per[host][best.action if best else "none"] += 1
            for target in {x.translate(LOWER) for x in re.findall(r"""[hH][rR][eE][fF]\s*=\s*["']?\s*(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"'<>\s]+)""", html or "")} - {host}:
                links[host, target] += 1
    masses = {}
    for kind, action, edges in (("trust", "allow", links), ("distrust", "block", Counter({(b, a): n for (a, b), n in links.items()}))):
        seed = {h: c[action] * 1000 // c["pages"] for h, c in per.items()}
        whole = sum(seed.values())
        now = {h: url_rules.TOTAL // whole * s + url_rules.TOTAL % whole * s // whole for h, s in seed.items() if s} if whole else {}
        out, total = Counter(), Counter(now)
        for (a, _), n in edges.items():
            out[a] += n
        for _ in range(rounds):
            later = Counter()
            for (a, b), n in edges.items():
                m = now.get(a, 0) // 100 * 85
                later[b] += m // out[a] * n + m % out[a] * n // out[a]
            now = later
            total.update(now)
        masses[kind] = total
    mean = sum(masses["distrust"][h] for h in per) // max(len(per), 1)
    rows = []
    for page, host, path, best in got:
        t, d = (masses[k][host] if host in per else 0 for k in ("trust", "distrust"))
        rows.append((page, host, path, best and best.host + best.path, best.action if best else "block" if host in per and d > t and d >= mean else "allow", t, d))
    return Counter(rows)


def test_urls_follow_rules_and_links(spark, tmp_path):
    rng = random.Random(11)
    hosts = ["a.example.net", "b.example.com", "x.org", "c.io", "d.io", "e.io", "m.c.io"]

    def html():
        parts = [rng.choice(['<a href="/here">', f'<A HREF = "HTTP://{rng.choice(hosts).upper()}/p">', f"<link href=//{rng.choice(hosts)}?q>", f"<a href='https://{rng.choice(hosts)}'>", "text href", "<a href=mailto:a@b>"]) for _ in range(rng.randint(0, 6))]
        return " ".join(parts)

    rows = [(i, u, html()) for i, u in enumerate(URLS)] + [(100 + i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', ''])}/{i}", html()) for i in range(120)]
    rows += [(5, "http://c.io/again", html()), (None, "http://c.io/", None), (7, "http://hot.io/x", "<a href='//c.io'>" * 20000), *[(900 + i, "http://c.io/hot", '<a href="//d.io">') for i in range(150)]]
    pages = spark.createDataFrame([(*r, "net", 3) for r in rows], "page_id long, url string, html string, host string, trust int").repartition(3)
    got = url_rules.judged(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
    want = plain_urls(rows, RULES)
    assert Counter(map(tuple, got.collect())) == want
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"}
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as c:
        c.register("pages", pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": [r[1] for r in rows], "html": [r[2] for r in rows]}))
        assert Counter(tuple(r) for r in c.sql(f"SELECT page_id, host, path, rule, verdict, trust, distrust FROM ({queries.SQL['op11_urls']})").fetchall()) == want


def test_urls_without_rows_rules_or_too_many(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_rules.judged(none, RULES).collect() == []
    one = spark.createDataFrame([(1, "http://a.b/c", None)], none.schema)
    assert [tuple(r) for r in url_rules.judged(one, []).select("rule", "verdict").collect()] == [(None, "allow")]
    with pytest.raises(ValueError, match="rules"):
        url_rules.judged(one, [url_rules.Rule("block", f"h{i}") for i in range(url_rules.MOST_RULES + 1)])


def test_longest_rule_wins(spark):
    rules = [url_rules.Rule("block", "b.c"), url_rules.Rule("allow", "a.b.c", "/x/"), url_rules.Rule("block", "a.b.c", "/x/y")]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(["http://b.c/", "http://b.c", "http://q.a.b.c/x/", "http://a.b.c/x/yz", "http://ab.c/"])], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judged(pages, rules).collect()}
    assert got == {0: ("b.c/", "block"), 1: (None, "block"), 2: ("a.b.c/x/", "allow"), 3: ("a.b.c/x/y", "block"), 4: (None, "allow")}


# --- leaderboards -----------------------------------------------------------------------------------------------

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"


def dated(row):
    sale, line, item, vendor, *_, shipped = row
    h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, line)).encode())
    day = (shipped.date() - dt.date(1970, 1, 1)).days if shipped else 19723 + h % 150
    arrival = day + h % 7 + (20 if h % 5 == 0 else 0)
    return day, arrival, max(1, min(12, 1 + (arrival - 19723) * 12 // 180))


def plain_feed(lines, items, vendors):
    """Rows of the feed, by replaying every day."""
    top, kept = -(10**9), []
    for batch in range(1, 13):
        own = [(x, *dated(x)) for x in lines if dated(x)[2] == batch]
        for x, day, arrival, _ in own:
            nation = vendors.get(x[3])
            if day + 8 >= top and nation is not None and x[2] in items:
                price = items[x[2]]
                cents = math.floor(100 * x[5] + 0.5) if x[5] is not None else x[4] * math.floor(100 * price + 0.5) if None not in (x[4], price) else 0
                kept.append((arrival, batch, nation, x[2], -cents if x[7] == "returned" else cents))
        top = max([top, *(day for _, day, _, _ in own)])
    sums, boards, out = defaultdict(Counter), defaultdict(list), []
    for arrival in sorted({k[0] for k in kept}):
        today = [k for k in kept if k[0] == arrival]
        for _, _, nation, item, cents in today:
            sums[nation][item] += cents
        for nation in {k[2] for k in today}:
            new = sorted((i for i, v in sums[nation].items() if v > 0), key=lambda i: (-sums[nation][i], i))[:10]
            a, b = ({i: k for k, i in enumerate(x, 1)} for x in (boards[nation], new))
            for i in {*a, *b}:
                if a.get(i) != b.get(i):
                    kind = "enter" if i not in a else "exit" if i not in b else "move"
                    out.append((nation, arrival, i, today[0][1], kind, a.get(i), b.get(i), sums[nation][i]))
            boards[nation] = new
    return Counter(out)


def test_feed_equals_a_replay(spark):
    rng = random.Random(12)
    start = dt.datetime(2024, 1, 1)
    items = {i: rng.choice([1.0, 2.5, None]) for i in range(25)}
    vendors = {v: rng.choice([1, 1, 2, None]) for v in range(6)} | {9: 3}
    lines = []
    for n in range(1500):
        item = 3 if n % 3 == 0 else rng.choice([None, 99, *range(25)])
        shipped = None if n % 50 == 0 else start + dt.timedelta(days=rng.choice([0, 5, 40, 41, 60, 148, rng.randrange(149)]), hours=rng.randrange(24))
        lines.append((n // 3, rng.randrange(4), item, rng.choice([None, 77, *vendors]), rng.choice([None, 1, 2]), rng.choice([None, 1.0, 2.0, 3.005]), 0.0, rng.choice(["kept", "returned", None]), shipped))
    lines += lines[:40]
    sent = spark.createDataFrame([(*x, "x", 1) for x in lines], LINES + ", day string, batch int").repartition(3)
    goods = spark.createDataFrame([(i, p, "n") for i, p in items.items()] + [(None, 5.0, "n")], "item_id long, price double, name string")
    sellers = spark.createDataFrame([(v, n) for v, n in vendors.items()] + [(9, 3)], "vendor_id long, nation_id int")
    got = leaderboards.feed(sent, goods, sellers)
    assert got.columns == ["nation_id", "arrival_day", "item_id", "batch", "change", "old_rank", "new_rank", "revenue"]
    want = plain_feed(lines, items, vendors)
    assert Counter(map(tuple, got.collect())) == want
    assert {r[4] for r in want} == {"enter", "exit", "move"} and len({r[3] for r in want}) > 8


def test_feed_of_nothing(spark):
    goods, sellers = spark.createDataFrame([], "item_id long, price double"), spark.createDataFrame([], "vendor_id long, nation_id int")
    assert leaderboards.feed(spark.createDataFrame([], LINES), goods, sellers).collect() == []


# --- divergence -------------------------------------------------------------------------------------------------


def plain_divergences(rows, least, ranks):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [w for w, n in df[lang].items() if n >= least]
        share = lambda c, kept=kept: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}
        sources = {s: share(counts[lang, s]) for x, s in groups if x == lang}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s, p in sources.items():
            pairs = [(o, sum(abs(p[w] - r[w]) for w in kept)) for o, r in sources.items() if o != s]
            above = [(w, p[w] - q[w]) for w in kept if counts[lang, s][w] and p[w] > q[w]]
            for part, found, limit in (("pair", pairs, None), ("term", above, ranks)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ordered, 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def voices():
    rng = random.Random(13)
    words = ["The", "the", "été", "ÉTÉ", "a1b", "x", "中文", "don't", "z😀", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = [(" ".join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", "s3", None])) for _ in range(300)]
    return [*rows, *rows[:20], (None, "en", "s1"), ("", "fr", "only"), ("1 2 3", "fr", "two"), ("long " * 60000 + "tail", "en", "s2"), (None, None, None)]


def test_divergence_equals_plain_counts(spark, voices):
    docs = spark.createDataFrame([(i, *r, 1, "t") for i, r in enumerate(voices)], "doc_id long, text string, lang string, source string, n long, term string").repartition(5)
    for least, ranks in ((1, 3), (5, 50), (30, 2), (10**6, 5)):
        got = divergence.divergences(docs, least, ranks)
        assert Counter(map(tuple, got.collect())) == plain_divergences(voices, least, ranks), (least, ranks)
    assert divergence.divergences(docs.limit(0)).collect() == []


def test_sketch_never_underestimates(spark, voices):
    docs = spark.createDataFrame(voices, "text string, lang string, source string").fillna("")
    cells = {r.cell: r.n for r in divergence.sketch(docs, 64).collect()}
    df = Counter()
    for text, lang, _ in voices:
        df.update((lang or "", w) for w in set(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))))
    for (lang, word), n in df.items():
        at = divergence._cells(pa.array([lang]), np.zeros(1, np.int64), pa.array([word.encode()]), np.zeros(1, np.int64), 64)
        assert min(cells.get(int(x), 0) for x in at.ravel()) >= n
    assert Counter(map(tuple, divergence.divergences(docs, 20, width=64).collect())) == plain_divergences(voices, 20, 50)


def test_shares_are_exact_in_longs(spark):
    rng = random.Random(1)
    rows = [(c, n, v) for _ in range(200) for c in [rng.randrange(10**10)] for n in [c + rng.randrange(10**12)] for v in [rng.randrange(1, 10**7)]]
    got = spark.createDataFrame(rows, "c long, n long, v long").select("*", F.expr(divergence._share("c", "n", "v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 5) // (r.n + 5 * r.v) for r in got)
