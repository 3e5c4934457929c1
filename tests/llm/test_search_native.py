"""Rules, contained items and secrets against plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from keelson.llm import containment, secrets, url_rules
from tests.llm.shapes import documents, none_of


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fit, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_nested_rules_by_sweep(spark):
    rng = random.Random(3)
    hosts = ["a.org", "b.a.org", "org", "x.com", "com", "deep.b.a.org"]
    paths = ["/", "/a", "/a/", "/a/b", "/a/b/c", "/ab", "/\U0010ffff", "/é"]
    rules = {(h, p): rng.choice(["allow", "block"]) for h in hosts for p in rng.sample(paths, 4)}
    rules = [(v, h, p) for (h, p), v in rules.items()]
    urls = [f"http://{h}{p}{e}" for h in [*hosts, "ORG", "q.B.a.ORG"] for p in ["", *paths] for e in ["", "x", "?q", "#f", "/b"]]
    urls += [None, "", "://", "no scheme", "http://", "a://b://c/", "http://.org/a", "http://a.org./a", "http://a.org:80/a"]
    rows = list(enumerate(urls)) + [(0, urls[0]), (None, urls[1])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS path", "3 AS rule")
    got = url_rules.judge_urls(pages, url_rules.rule_table(spark, rules), keys_per_sweep=7).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *plain_verdict(u, rules)) for i, u in rows), key=repr)
    # rules of one length: the longer host wins, which the plain form decides by text
    same = [(g, w) for g, w in zip(sorted((tuple(r) for r in got), key=repr), want) if g != w]
    assert all(g[:3] == w[:3] and len(g[3]) == len(w[3]) for g, w in same) and len(same) < 20


def test_block_wins_and_empty_tables(spark):
    rules = url_rules.rule_table(spark, [("allow", "a.b", "/"), ("block", "a.b", "/"), (None, "a.b", "/c"), ("block", None, "/")])
    pages = spark.createDataFrame([(1, "http://A.b/c")], "page_id long, url string")
    (row,) = url_rules.judge_urls(pages, rules).collect()
    assert (row.rule, row.verdict) == ("a.b/", "block")
    assert url_rules.judge_urls(none_of(pages), rules).count() == 0
    (row,) = url_rules.judge_urls(pages, none_of(rules)).collect()
    assert (row.rule, row.verdict) == (None, "allow")


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())


def test_contained_items(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([3, 5, 6, 12, 30, 80])))) for k in range(60)]
    items += [(60, None), (61, ""), (62, "short one"), (0, items[0][1]), (None, items[5][1])]
    docs = []
    for k in range(120):
        text = rng.choices(words, k=rng.choice([4, 40, 400]))
        item = (items[rng.randrange(60)][1]).split()
        for _ in range(rng.choice([0, 0, 1, 3])):  # change words of the item
            item[rng.randrange(len(item))] = "changed"
        docs.append((k, " ".join([*text, *item, *text[:9]]).title()))
    docs += [(200, "Short one!"), (201, None), (None, items[7][1]), (202, ""), (0, docs[0][1])]
    want = set()
    for d, text in docs:
        for i, item in items:
            need, have = shingles(item), shingles(text)
            if need and len(need & have) >= 0.8 * len(need) - 1e-9:
                want.add((d, i, len(need), len(need & have)))
    extra = documents(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS needed")
    got = [tuple(r)[:4] for r in containment.contained_items(extra, bench).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 50
    assert containment.contained_items(none_of(extra), bench).count() == 0
    assert containment.contained_items(extra, none_of(bench)).count() == 0


def plain_base(text):
    assign = re.compile(secrets.ASSIGN.replace(r"\x20", " "), re.A)
    text, out = text or "", []
    for m in assign.finditer(text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def plain_entropy(text, width=20):
    import math
    from collections import Counter

    best = 0.0
    for at in range(max(1, len(text) - width + 1)):
        n = Counter(text[at : at + width])
        total = sum(n.values())
        best = max(best, -sum(c / total * math.log2(c / total) for c in n.values()))
    return best


def test_secrets(spark):
    rng = random.Random(7)
    some = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    hexes, mixed = "0123456789abcdef", "ABCDEFGHabcdefghijklmnop0123456789+/"
    texts = ["", None, "password=token: abcdefghijklmnop", "secret=token= abcdefghijklmnop", "é😀 token = 'abc123def456ghi'"]
    for _ in range(200):
        bits = []
        for _ in range(rng.randrange(6)):
            bits += [
                rng.choice(["word", "é中😀", "\n", "Api_Key: ", "TOKEN=", "passwd \"'= ", "apikey='"]),
                rng.choice([some(hexes, rng.randrange(1, 40)), "AKIA" + some("ABCDEF0123", rng.randrange(20)), some(mixed, 25), "AKIAKIA"]),
            ]
        texts.append(rng.choice(["", " ", ";"]).join(bits))
    texts += ["token=abcdefghijkl " * 700, "0123456789abcdef" * 3000]
    docs = documents(spark, list(enumerate(texts)) + [(None, texts[5]), (3, texts[3])])
    names = ["assign", "access", "hex", "entropy"]
    got = secrets.scan_secrets(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[5] if r.doc_id is None else texts[r.doc_id]
        base = plain_base(text)
        listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
        assert hashlib.sha256(listed.encode()).hexdigest() == r.base_sha256
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        how = secrets.Entropy()
        for m in re.finditer(how.candidate, text or ""):
            bits = how.hex_bits if re.fullmatch("[0-9a-fA-F]+", m[0]) else how.mixed_bits
            found = not any(re.search(p, m[0]) for p in how.allow) and plain_entropy(m[0]) >= bits - 1e-9
            assert (f"entropy:{m.start()}:{m.end()}" in (r.spans or "").split(",")) == found
    masked = [r.t for r in docs.select(secrets.redact(docs.text).alias("t")).collect()]
    assert all(t is None or not plain_base(t) for t in masked)
    assert secrets.scan_secrets(none_of(docs)).count() == 0


def test_clean_text_is_left_alone(spark):
    clean = "Plain prose with a long-hyphenated-compound-word, 20260101-20270101 and https://host.example.com/a/b/c"
    docs = documents(spark, [(1, clean)])
    assert secrets.scan_secrets(docs).first().spans == ""
    assert docs.select(secrets.redact(docs.text)).first()[0] == clean


def test_secrets_in_very_long_texts(spark):
    """No pattern recurses over a long candidate, and none ends the job."""
    n = 2 * 2**20
    shapes = ["a-" * n, "-" * n, "/a" * n, "z" * n, "A" * n, "0" * n, "ab " * n, "AKIA" + "A" * n, "password=" + "x" * n]
    df = spark.createDataFrame(list(enumerate(shapes)), "doc_id long, text string").repartition(len(shapes))
    found = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    assert found[0].spans == found[1].spans == found[2].spans == found[3].spans == found[6].spans == ""
    assert found[5].n_hex == 1 and found[7].n_access == 1 and found[8].n_assign == 1
    masked = {r.doc_id: r.n for r in df.select("doc_id", F.length(secrets.redact(df.text)).alias("n")).collect()}
    assert masked[0] == 2 * n and masked[5] == masked[7] == masked[8] == len("[SECRET]")


def test_dashed_words_are_allowed():
    """The pattern without repeated groups allows the same candidates as the plain one."""
    rng, allowed = random.Random(2), [p for p in secrets.Entropy().allow if "[-_/+]" in p]
    for _ in range(20_000):
        text = "".join(rng.choices("abAB7-_/+", [5, 5, 1, 1, 0.2, 1, 1, 1, 1], k=rng.randint(1, 12)))
        plain = re.search(r"^[A-Za-z]?[a-z]*([-_/+]+[A-Za-z]?[a-z]*)+$", text)
        assert bool(plain) == any(re.search(p, text) for p in allowed), text


def test_sweeps_of_one_host_are_dealt_apart(spark):
    keys = spark.createDataFrame([("a.com", f"/p{k}") for k in range(300)], "host string, path string")
    plan = url_rules.match_rules(keys, url_rules.rule_table(spark, url_rules.RULES), 10)._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window [last") :]
    assert "hashpartitioning(suffix" in window.split("Exchange", 1)[1][:60] and "sweep" in window.split("Exchange", 1)[1][:60]
