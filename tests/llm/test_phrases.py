"""Phrase mining against plain counts, and URL rules on odd tables."""

import re
from collections import Counter

from lodestone.llm import phrases, urls


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(ws)
            for m in range(1, 6):
                f.update((lang or "und", tuple(ws[i : i + m])) for i in range(len(ws) - m + 1))
    kept = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    hidden = set()
    for (x, ws), a in kept.items():
        for m in range(2, len(ws)):
            hidden |= {(x, ws[i : i + m]) for i in range(len(ws) - m + 1) if kept[x, ws[i : i + m]] <= a}
    out = {}
    for (x, ws), a in kept.items():
        if (x, ws) not in hidden:
            cuts = [(1000 * a * n[x] // (f[x, ws[:k]] * f[x, ws[k:]]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            out.setdefault(x, []).append((-score, -a, " ".join(ws).encode(), f[x, ws[:k]], f[x, ws[k:]]))
    return sorted((x, i + 1, p.decode(), -a, left, right, n[x], -s) for x, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


ROWS = [
    ("New York is. New York was, new\tYork new york", "en"), ("a a a a a a", "en"), ("A a a", None), ("new york new york", "und"), (None, "en"), ("", "fr"), ("...\n\r ", "fr"),
    ("é à é à é à", "fr"), ("x  y   z x y z x y z x y z q", "en"), ("the the the", "en"), ("the the the", "en"), ("ünï\u00a0code ünï\u00a0code", "fr"),
]


def test_against_plain_counts(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in ROWS], "text string, lang string, phrase string").repartition(3)
    for least, chars in ((1, 1 << 20), (2, 40), (3, 1 << 20)):
        counts = phrases.phrase_counts(docs, least, chars)
        assert sorted(map(tuple, phrases.collocations(counts, least, 5).collect())) == plain(ROWS, least, 5)
    assert phrases.collocations(phrases.phrase_counts(docs.limit(0), 1)).collect() == []


def test_portions_lose_no_phrase():
    text = phrases.clean(b"a b c d e f g h i j, k l m n o p " + b"w" * 50 + b" q r s t " * 3)
    each = lambda t: [tuple(p.split()[i : i + 5]) for p in t.split(b"\n") for i in range(max(0, len(p.split()) - 4))]
    assert set(sum(map(each, phrases.portions(text, 12)), [])) == set(each(text))


def test_long_text(spark):
    text = "one two three four " * 90_000
    docs = spark.createDataFrame([(text, "en")], "text string, lang string")
    got = {r["phrase"]: r["f"] for r in phrases.phrase_counts(docs, 100).collect()}
    assert got[None] == 360_000 and got["one two"] == 90_000 and got["four one two three four"] == 89_999


def test_urls(spark):
    rules = [("org", "/", "allow"), ("a.org", "/x", "block"), ("a.org", "/x", "allow"), ("b.a.org", "/", "block"), ("org", "/xyz/long", "block"), ("net", "", "block"), ("bad", "x", "block"), (None, "/", "block")]
    pages = [
        (1, "http://A.org/xy?z"), (2, "http://a.org"), (3, "https://b.a.ORG/x"), (4, None), (5, "a.org/x"), (6, "://net#f"), (7, "s://my.net/:q?"), (8, "http://notorg/"), (9, "http://q.org/xyz/longer"), (1, "http://A.org/xy?z"), (None, "http://bad/x"),
        (10, "http://" + "l." * 3000 + "org/" + "p" * 20000), (11, "http://a.org/X"), (12, "x://y://net/"),
    ]
    want = []
    for i, u in pages:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.lower()
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p) and p != "x"]
        best = max(fits, default=None)
        want.append(repr((i, host, path, best[3] if best else None, best[4] if best else "allow")))
    held = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for most in (urls.BROADCAST_RULES, 1):  # broadcast, and shuffled
        assert sorted(repr(tuple(r)) for r in urls.judge(held, table, most=most).collect()) == sorted(want)
    assert urls.judge(held.limit(0), table).collect() == [] and {r["verdict"] for r in urls.judge(held, table.limit(0), "block").collect()} == {"block"}
