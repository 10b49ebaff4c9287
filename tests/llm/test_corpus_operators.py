"""Each corpus operator against a brute-force version of its contract, on small tables with every odd case."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import bpe, fingerprint, minhash, packing, pii, quality, substring, toxicity, urls, vectors
from tessella.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, salt int, rest string, bucket string, score string, block string"


def prose(r, n, words=400):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    texts = [prose(r, r.randrange(1, 120)) for _ in range(60)]
    passage = prose(r, 60, 10_000)
    texts += [texts[5], texts[5], texts[5].upper(), f"{prose(r, 30)} {passage} {prose(r, 5)}", f"{passage}\n{prose(r, 50)}", passage]
    base = prose(r, 200, 10_000).split()
    for k in range(12):  # near copies
        copy = list(base)
        for _ in range(k % 4):
            copy[r.randrange(200)] = f"x{k}"
        texts.append(" ".join(copy))
    texts += ["", " \t\n", "one", "a b c d", "a b c d", "é ü\u00a0ß ﬁ", "x" * 30_000, "Mail a.b@mail.example.com or 10.0.0.1, 300.1.1.1, card 4111 1111 1111 1111, +1 (202) 555-0143.", "a@b.c@d.ef 1.2.3.4.5.6.7.8 +12 3", "<|endoftext|>tail <|startoftext|>", "ab  cd \n\n ef   gh"]
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    out = [(3 * i + 1, t) for i, t in zip(ids, texts)] + [(5000, None), (None, texts[3]), (None, None), (6000, texts[0]), (6000, texts[0])]
    return [(i, t, "en", f"s{k % 3}" if k % 7 else None, 1, "k", 1, "r", "b", "s", "bl") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(x):
    return tuple((v is None, v) if not isinstance(v, list) else (False, str(v)) for v in x)


def union_find(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- 1


def test_urls(spark):
    hosts = ["a.net", "example.net", "x.example.net", "example.com", "m.example.com", "y.org", "b.com", "notnet"]
    given = [(i, f"http{'s' * (i % 2)}://{hosts[i % 8].upper() if i % 5 == 0 else hosts[i % 8]}/{['en', 'de', 'fr'][i % 3]}/{i}{['', '?page=2', '#t'][i % 3]}", "h") for i in range(240)] + [(900, None, "h"), (901, "no scheme", "h"), (902, "http://q.net", "h"), (903, "x://", "h"), (1, "http://b.com/en/1", "h")]
    out = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.url_verdicts(spark.createDataFrame(given, "page_id long, url string, host string")).collect()}
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    assert len(out) == len(given)
    for page, host, path, rule, verdict in out:
        url = [u for i, u, _ in given if i == page]
        m = [re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "") for u in url]
        assert (host, path) in {(x[1].lower(), x[2]) if x else ("", "") for x in m}
        fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert rule == best[0] and verdict in ("allow", "block") and (rule is None or verdict == best[1])
    assert urls.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_mined_rules_match_counting(spark):
    r = random.Random(1)
    data = [(sorted({f"t{r.randrange(6)}" for _ in range(3)}), "block" if r.random() < 0.5 else "allow") for _ in range(200)]
    data = [(t, "block" if "t1" in t and "t2" in t else v) for t, v in data]
    got = {(tuple(x["antecedent"]), x["verdict"]): (x["confidence"], x["key"]) for x in urls.mine(spark.createDataFrame(data, "tokens array<string>, verdict string"), 0.02, 0.8, 2, least=1).collect()}
    tokens = sorted({t for ts, _ in data for t in ts})
    sets = [(a,) for a in tokens] + [(a, b) for a in tokens for b in tokens if a < b]
    count = lambda s, v=None: sum(set(s) <= set(ts) and v in (None, w) for ts, w in data)
    strong = {(s, v): count(s, v) / count(s) for s in sets for v in ("allow", "block") if count(s, v) >= 0.02 * len(data) and count(s, v) >= 0.8 * count(s)}
    want = {k: c for k, c in strong.items() if not any((p,) != k[0] and strong.get(((p,), k[1]), 0) >= c for p in k[0])}
    assert {k: round(c, 9) for k, (c, _) in got.items()} == {k: round(c, 9) for k, c in want.items()}
    assert all(count((key,)) == min(count((a,)) for a in k[0]) for k, (_, key) in got.items())


def test_rules_among_many_tokens_are_found(spark):
    """URLs of 16 frequent tokens each: a pair and a triple among the last ones in order decide."""
    from itertools import combinations

    r = random.Random(9)
    data = []
    for _ in range(400):
        tokens = sorted({f"t{k:02}" for k in range(20) if r.random() < 0.8})
        block = {"t10", "t12"} <= set(tokens) and "t13" not in tokens or {"t17", "t18", "t19"} <= set(tokens)
        data.append((tokens, "block" if block else "allow"))
    assert all(len(t) > urls.MOST_TOKENS * urls.GROUP for t, _ in data[:50])
    got = {(tuple(x["antecedent"]), x["verdict"]): x["confidence"] for x in urls.mine(spark.createDataFrame(data, "tokens array<string>, verdict string"), 0.05, 0.9, 3, least=5).collect()}
    rules = {}
    for size in (1, 2, 3):
        for s in combinations([f"t{k:02}" for k in range(20)], size):
            fits = [v for t, v in data if set(s) <= set(t)]
            for v in ("allow", "block"):
                if fits.count(v) >= 20 and fits.count(v) >= 0.9 * len(fits) and not any(rules.get((p, v), 0) >= fits.count(v) / len(fits) for k in range(1, size) for p in combinations(s, k)):
                    rules[s, v] = fits.count(v) / len(fits)
    assert (("t17", "t18", "t19"), "block") in rules and {k: round(c, 9) for k, c in got.items()} == {k: round(c, 9) for k, c in rules.items()}


def test_tokens_that_stand_together_are_told_each(spark):
    data = [(["a", "a2", "b"], "block")] * 30 + [(["a", "a2"], "allow")] * 30 + [(["b", "c"], "allow")] * 30
    got = {(tuple(x["antecedent"]), x["verdict"], x["key"]) for x in urls.mine(spark.createDataFrame(data, "tokens array<string>, verdict string"), 0.05, 0.9, 3, least=5).collect()}
    assert got == {(("a", "b"), "block", "a"), (("a2", "b"), "block", "a2"), (("c",), "allow", "c")}


def plain_tokens(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", url or "")
    if not m:
        return frozenset()
    labels = [x for x in m[1].lower().split(".") if x]
    out = {"host=" + ".".join(labels[-i:]) for i in range(1, min(len(labels), 4) + 1)} | ({f"label={labels[0]}"} if len(labels) > 3 else set())
    out |= {"path=" + re.sub("[0-9]+", "#", x) for x in m[2].split("/") if x} | {"key=" + x.split("=")[0] for x in (m[3] or "?")[1:].split("&") if x}
    return frozenset(out | ({"fragment"} if (m[4] or "") != "" else set()))


def test_whole_verdicts_by_brute_force(spark, monkeypatch):
    from itertools import combinations

    monkeypatch.setattr(urls, "LEAST", 6)
    monkeypatch.setattr(urls.mine, "__defaults__", (*urls.mine.__defaults__[:-1], 6))
    r = random.Random(21)
    hosts, words = ["a.net", "example.net", "example.com", "y.org", "b.com", "c.edu"], ["shop", "news", "x", "page9", "page77"]
    given = [(i, f"http://{r.choice(hosts)}/{r.choice(['en', 'de', 'fr'])}/{'/'.join(r.choice(words) for _ in range(r.randrange(3)))}{r.choice(['', '?q=1', '?q=2&s=a', '#t'])}") for i in range(400)]
    out = {x["page_id"]: x for x in urls.url_verdicts(spark.createDataFrame(given, "page_id long, url string")).collect()}
    data = [(plain_tokens(u), out[i]["verdict"]) for i, u in given if out[i]["rule"] is not None]
    need = max(6, int(np.ceil(urls.MIN_SUPPORT * len(data))))
    rules = {}
    tokens = sorted(set().union(*(t for t, _ in data)))
    for size in (1, 2, 3):
        for s in combinations(tokens, size):
            fits = [v for t, v in data if set(s) <= t]
            for v in ("allow", "block"):
                if fits.count(v) >= need and fits.count(v) >= 0.9 * len(fits):
                    rules[frozenset(s), v] = (fits.count(v) / len(fits), fits.count(v) / len(data))
    kept = {k: c for k, c in rules.items() if not any(p < k[0] and v == k[1] and d[0] >= c[0] for (p, v), d in rules.items())}
    mined = 0
    for i, u in given:
        if out[i]["rule"] is None:
            fits = [(*c, k[1] == "block", k[1]) for k, c in kept.items() if k[0] <= plain_tokens(u)]
            mined += bool(fits)
            assert out[i]["verdict"] == (max(fits)[-1] if fits else "allow"), u
    assert mined > 20


def test_very_long_urls(spark):
    r = random.Random(22)
    long = "/".join(f"seg{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]}" for k in range(300))
    given = [(i, f"http://a{i % 3}.{'net' if i % 2 else 'org'}/fr/{long}/{r.randrange(9)}") for i in range(80)] + [(100, "http://b.com/" + "x" * 200_000), (101, "http://b.com/" + "y/" * 50_000), (102, f"http://b.com/{long}")]
    out = {x["page_id"]: x["verdict"] for x in urls.url_verdicts(spark.createDataFrame(given, "page_id long, url string")).collect()}
    assert len(out) == len(given) and all(out[i] == ("block" if i % 2 else "allow") for i in range(80))


# ---- 2


def test_fingerprints(docs, rows, empty):
    out = fingerprint.fingerprints(docs).collect()
    known = sorted([(i, t or "") for i, t, *_ in rows if i is not None and i != 6000], reverse=True)
    by_id = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows)
    inner = [(i, t) for i, t in known]
    for (i, t), (j, following) in zip(inner, inner[1:]):
        if i != 6000:
            half = len(t) // 2
            edited = t[: len(t) - half] + following[:half]
            r = by_id[i]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert (r["near_edited"] == 1.0) == (r["fingerprint"] == r["edited_fingerprint"] == fingerprint.digest(fingerprint.canonical(edited)))
    assert fingerprint.canonical("Ａb\u00a0 ﬁ\nSS") == fingerprint.canonical("ab fi ß") == b"ab fi ss"
    assert fingerprint.fingerprints(empty).count() == 0


def test_last_document_is_followed_by_the_first(spark):
    out = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame([(1, "abcd"), (2, "efgh"), (9, "ijkl")], "doc_id long, text string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [out[i]["edited_sha256"] for i in (9, 2, 1)] == [sha("ijef"), sha("efab"), sha("abij")]


def test_fingerprints_tell_texts_apart_whatever_collides(spark, docs, rows):
    r = random.Random(17)
    given = [(i, t, 1, "p") for i, t in enumerate([prose(r, 3) for _ in range(40)] + ["Abc  d", "abc d", "", " ", None, "abcd", "ABCD", "xyxy"])] + [(3, "other", 1, "p"), (None, "other", 1, "p")]
    table = spark.createDataFrame(given, "doc_id long, text string, number int, digest string")
    plain = {x["doc_id"]: x for x in fingerprint.fingerprints(table).collect() if x["doc_id"] not in (3, None)}
    known = {i: (t or "") for i, t, *_ in given}
    for digits in (32, 1, 0):  # of one hexadecimal digit and of none, nearly all and all texts collide
        out = fingerprint.fingerprints(table, digits).collect()
        assert len(out) == len(given)
        canon = {}
        for x in out:
            if x["doc_id"] in (0, 3, 4, None):  # next to the odd rows
                continue
            own, following = known[x["doc_id"]], known[(x["doc_id"] - 1) % 48]
            edited = own[: len(own) - len(own) // 2] + following[: len(own) // 2]
            assert x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            for print_, text in ((x["fingerprint"], own), (x["edited_fingerprint"], edited)):
                canon.setdefault(print_, set()).add(fingerprint.canonical(text))
            assert (x["near_edited"], x["near_next"]) == (plain[x["doc_id"]]["near_edited"], plain[x["doc_id"]]["near_next"])
            assert x["near_next"] == (fingerprint.canonical(own) == fingerprint.canonical(following))
        assert all(len(c) == 1 for c in canon.values())  # one text a fingerprint
        assert len(canon) == len(set().union(*canon.values()))  # and one fingerprint a text


# ---- 3


def plain_spans(text):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    out = [("email", m) for m in email.finditer(text)] + [("ip", m) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in card.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))] + [("phone", m) for m in phone.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def test_base_spans_of_random_texts():
    r = random.Random(11)
    for _ in range(5000):
        text = "".join(r.choice(["1", "2", "4111111111111111", ".", " ", "-", "+1", "@", "a.b", "(", ")", "é", "x@y.z", "25", "007", "\n", "_"]) for _ in range(r.randrange(25)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_personal_data(docs, rows, empty):
    out = sorted((r["doc_id"], r["base_sha256"]) for r in pii.personal_data(docs).collect() if r["doc_id"] is not None)
    want = sorted((i, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(t or "")).encode()).hexdigest()) for i, t, *_ in rows if i is not None)
    assert out == want
    assert pii.personal_data(empty).count() == 0


def test_disclosing_terms(spark):
    r = random.Random(2)
    texts = [f"{prose(r, 30)} zelda u{i}@mail.example.com {prose(r, 30)}" for i in range(60)] + [prose(r, 60) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = {r["term"]: r["kind"] for r in pii.disclosing_terms(docs).collect()}
    assert terms == {"zelda": "email"}
    rows = {r["doc_id"]: r for r in pii.personal_data(docs, True).collect()}
    assert "zelda" not in rows[0]["sanitised"] and "@" not in rows[0]["sanitised"] and "term:" in rows[0]["spans"]
    assert rows[100]["sanitised"] == texts[100] and rows[100]["spans"] == ""


def test_rare_terms_of_many_contexts_disclose(spark, monkeypatch):
    r = random.Random(4)
    texts = [" ".join(f"{prose(r, 8)} u{i}.{j}@mail.example.com" for j in range(20)) for i in range(200)]
    texts += [f"{prose(r, 20)} quillfeather v{i}@mail.example.com {prose(r, 20)}" for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit, known in ((before, pii.KNOWN), ("-1", 0)):  # terms sent to the tasks, and terms joined
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        monkeypatch.setattr(pii, "KNOWN", known)
        out = {r["doc_id"]: r["sanitised"] for r in pii.personal_data(docs, True).collect()}
        assert len(out) == 210 and not any("quillfeather" in out[i] for i in range(200, 210))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_disclosing_terms_go_from_the_whole_text(spark):
    r = random.Random(2)
    texts = [f"zelda {prose(r, 30)} zelda u{i}@mail.example.com {prose(r, 30)}" for i in range(60)] + [prose(r, 60) for _ in range(800)] + [f"zelda {prose(r, 20)}"]
    out = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), True).collect()}
    assert not any("zelda" in out[i]["sanitised"] for i in range(60)) and out[0]["spans"].count("term:") == 2
    assert "zelda" not in out[860]["sanitised"] and out[860]["spans"] == "term:0:5"  # without an entity near it, too


def test_disclosure_is_plain_counting(spark):
    r = random.Random(9)
    names = [f"name{'abcdefghij'[k]}" for k in range(10)]
    texts = [f"{' '.join(r.choice(names) for _ in range(r.randrange(1, 20)))} u{i % 7}@mail.example.com {' '.join(r.choice(names) for _ in range(r.randrange(12)))} {'+1 (202) 555-0143' if i % 3 else ''}" for i in range(80)]
    words, all_words, near, total, kinds = {}, 0, {}, {}, {}
    for text in texts * 2:
        spans = plain_spans(text)
        found = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", text)]
        outside = [w for w in found if not any(s < w[1] and w[0] < e for _, s, e in spans)]
        for w in found:
            words[w[2]] = words.get(w[2], 0) + 1
            all_words += 1
        counted = set()
        for k, s, e in spans:
            left, right = [w for w in found if w[1] <= s][-5:], [w for w in found if w[0] >= e][:5]
            place = (text[left[0][0] : s] if left else "", text[e : right[-1][1]] if right else "")
            around = [w for w in left + right if w in outside]
            for entity in (k, text[s:e]):
                for w in around:
                    if (entity, w[0]) not in counted:
                        counted.add((entity, w[0]))
                        near.setdefault((entity, w[2]), []).append(place)
                        total[entity] = total.get(entity, 0) + 1
    want = {}
    for (entity, term), places in near.items():
        if len(set(places)) >= pii.LEAST:
            p = total[entity] / all_words
            want.setdefault(term, []).append((len(places), len(set(places)), round(float(np.log2(min(1.0, len(places) / words[term]) / p) / -np.log2(p)), 9)))
    got = {}
    for x in pii.disclosure(spark.createDataFrame([(t,) for t in texts * 2], "text string")).collect():
        got.setdefault(x["term"], []).append((x["n"], x["support"], round(x["disclosure"], 9)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and len(got) >= 5


def test_secrets_and_a_term_that_discloses_them(spark):
    r = random.Random(10)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    texts = [f"{prose(r, 20)} passcode = {key()} {prose(r, 20)}" for _ in range(20)] + [f"{prose(r, 10)} passcode {prose(r, 10)}", "x" * 40 + " " + "1" * 40]
    out = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), True).collect()}
    assert all(out[i]["n_secret"] == 1 and out[i]["n_term"] == 1 and "[SECRET]" in out[i]["sanitised"] and "passcode" not in out[i]["sanitised"] for i in range(20))
    assert out[20]["n_secret"] == 0 and out[20]["n_term"] == 1 and out[21]["spans"] == ""


def test_copies_of_a_passage_are_one_context(spark):
    r = random.Random(13)
    passage = f"{prose(r, 10)} nightingale u@mail.example.com {prose(r, 10)}"
    texts = [f"{passage} {prose(r, 10)}" for _ in range(50)] + [prose(r, 60) for _ in range(50)]
    out = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert not any(x["n_term"] for x in out)


def test_contexts_hold_whole_words():
    long, text = "a" * 500, f"{'a' * 500} . u@x.example.com {'. ' * 200} next éb@x.example.com"
    found = {(text[a:b], a, b) for _, _, _, words in pii.contexts(text, pii.base_spans(text)) for a, b in words}
    assert found == {(long, 0, 500), ("next", text.index("next"), text.index("next") + 4)}


# ---- 4


def test_near_vectors(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 16))
    x = [b + 0.12 * r.normal(size=16) for b in base for _ in range(30)] + [base[0]] * 40 + [3 * base[1]] * 2 + list(r.normal(size=(50, 16)))
    given = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(990, None), (991, [0.0] * 16), (992, [float("nan")] * 16), (993, [1.0, None]), (994, []), (None, [1.0] * 16), (995, [1.0, 2.0])]
    out = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(given, "vec_id long, embedding array<double>")).collect()}
    a = np.array(x)
    cos = (a @ a.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(a, axis=1))
    links = [(i, j) for i in range(len(x)) for j in range(i) if cos[i, j] >= 0.9]
    want = union_find(links, range(len(x)))
    found = sum(out[i]["n_links"] for i in range(len(x)))
    assert 0.99 * 2 * len(links) <= found <= 2 * len(links)
    assert all(out[i]["n_links"] <= (cos[i] >= 0.9).sum() - 1 for i in range(len(x)))
    assert sum(out[i]["component_id"] == want[i] for i in range(len(x))) >= 0.99 * len(x)
    assert all(out[i]["n_links"] == 0 and out[i]["component_id"] == i for i in (990, 991, 992, 993, 994, 995)) and out[None]["kept"]
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    r = random.Random(9)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, i) for i in range(3000, 3100)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find(links, {n for l in links for n in l})
    assert got == {n: c for n, c in want.items() if any(n in l and l[0] != l[1] for l in links)}


def brute_links(vecs, least=0.9):
    """Cosines of all pairs of (id, vector), the rows standing for themselves: (links, component) by row."""
    a = np.array([v for _, v in vecs], np.float64)
    cos = (a @ a.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(a, axis=1))
    linked = cos >= least
    links = [(i, j) for i, j in zip(*np.nonzero(np.triu(linked, 1)))]
    find = union_find(links, range(len(vecs)))
    smallest = {}
    for k, (i, _) in enumerate(vecs):
        smallest[find[k]] = min(smallest.get(find[k], i), i)
    return linked.sum(axis=1) - 1, [smallest[find[k]] for k in range(len(vecs))]


def test_repeated_vec_ids_and_clashing_columns(spark):
    r = np.random.default_rng(14)
    base = r.normal(size=(20, 24))
    vecs = [(int(i % 37), (base[i % 20] + (0.05 + 0.1 * (i % 3)) * r.normal(size=24)).tolist()) for i in range(300)]
    vecs += [(7, [1.0] + [0.0] * 23), (7, [1.0, 0.1] + [0.0] * 22), (8, [1.0, 0.05] + [0.0] * 22)] + [vecs[0]] * 3
    table = spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, "s") for i, v in vecs], "vec_id long, embedding array<double>, class int, n int, key int, root int, component int, signs string")
    n, component = brute_links(vecs)
    out = vectors.near_vectors(table).collect()
    assert len(out) == len(vecs)
    want = sorted((i, int(k), c) for (i, _), k, c in zip(vecs, n, component))
    assert sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in out) == want


def test_recall_in_single_and_double_precision(spark):
    r = np.random.default_rng(15)
    base = r.normal(size=(1500, 64))
    near = [b + s * r.normal(size=64) for b in base[:500] for s in (0.40, 0.48)]  # cosines about 0.9
    x = np.concatenate([base, near])
    for kind in (np.float32, np.float64):
        vecs = [(i, v.astype(kind).astype(np.float64).tolist()) for i, v in enumerate(x)]
        n, _ = brute_links(vecs)
        out = {row["vec_id"]: row["n_links"] for row in vectors.near_vectors(spark.createDataFrame(vecs, "vec_id long, embedding array<double>")).collect()}
        assert all(out[i] <= n[i] for i, _ in vecs) and sum(out.values()) >= 0.99 * n.sum() > 500


# ---- 5 and 8


def labelled(seed=5, n=160):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        text = f"{prose(r, 20)}. women {'awfulword' if bad else 'met'} {prose(r, 4)}. {prose(r, 30)}."
        rows.append((i, text, int(bad)))
    return rows


def test_toxicity(spark, docs, empty):
    rows = labelled()
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(table, labels).collect()}
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= out[i]["score"] <= 1 and out[i]["predicted"] == (out[i]["score"] >= 0.5) for i, _, _ in rows)
    held = [(out[i]["predicted"], y) for i, _, y in rows if out[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)
    assert toxicity.toxicity(docs, labels).count() == docs.count()
    assert toxicity.toxicity(empty, labels.limit(0)).count() == 0


def test_long_documents_labels_enter_the_fit():
    r = random.Random(6)
    text = lambda bad: ". ".join(prose(r, 6) + (" awfulword" if bad and k == 40 else "") for k in range(80))
    rows = [(text(i % 2), i % 2) for i in range(120)]
    s = toxicity.Scorer(toxicity.fit(rows))
    assert all((s(t) >= 0.5) == y for t, y in rows)
    assert all((s(text(i % 2)) >= 0.5) == i % 2 for i in range(20))


def test_counterfactual_penalty_spares_group_mentions():
    r = random.Random(3)
    rows = [(f"the women are {'awfulword' if i % 2 else 'awfulword vile'} {prose(r, 5)}.", 1) for i in range(60)] + [(f"the men met {prose(r, 5)}.", 0) for _ in range(60)]
    gap = {}
    for swap in (0.0, 2.0):
        s = toxicity.Scorer(toxicity.fit(rows, swap))
        gap[swap] = s("the women met today.") - s("the men met today.")
        assert s("they are awfulword.") > 0.5
    assert gap[2.0] < 0.7 * gap[0.0]


def test_score_is_the_fitted_model_by_plain_sums():
    weights = np.random.default_rng(1).normal(size=toxicity.FEATURES) * (np.random.default_rng(2).random(toxicity.FEATURES) < 0.5)
    s = toxicity.Scorer(weights)
    for text in ("", "One two. Three threefold threesome three!", "stem stemming stemmed stems\nother words", "a" * 300, None):
        raw = []
        for part in re.split(r"[.!?\n]+", (text or "").lower()):
            words = re.findall(r"[^\W\d_]+", part)
            if words:
                features = {zlib.crc32(p.encode()) % (toxicity.FEATURES - 1) + 1 for w in words for p in [f"{w} ", *(w[:k] for k in (4, 5, 6, 7, 8) if len(w) > k)]}
                raw.append(weights[0] + sum(weights[f] for f in features))
        raw = raw or [weights[0]]
        pull = [np.exp(3 * (x - max(raw))) for x in raw]
        want = 1 / (1 + np.exp(-min(30, max(-30, sum(p * x for p, x in zip(pull, raw)) / sum(pull)))))
        assert abs(s(text) - want) < 1e-9


def test_observed_counterfactuals():
    texts = ["the tall zorgs met us. other one here now", "the tall blips met us.", "you are a fool now.", "you are a friend now.", "the women met us.", "the tall zorgs met us."]
    labels = [0, 0, 1, 0, 0, 0]
    found = toxicity.counterfactuals([toxicity.sentences(t) for t in texts], labels)
    assert found[0] == [(0, ["the", "tall", "blips", "met", "us"])] and found[1] == [(0, ["the", "tall", "zorgs", "met", "us"])]
    assert found[2] == found[3] == [] and found[4] == [(0, ["the", "men", "met", "us"])]


def test_training_rows_are_bounded_in_number_and_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    every = toxicity.training_rows(docs, labels, "toxic", 5, 0, 1000)
    assert len(every) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(100))
    assert len(toxicity.training_rows(docs, labels, "toxic", 5, 0, 30)) == 30
    assert len(toxicity.training_rows(docs, labels, "toxic", 5, 0, 30, 4500)) == 5


def test_without_evidence_every_document_stays(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 0), (4, 0)], "doc_id long, toxic int"), spark.createDataFrame([(1, 1), (4, 1)], "doc_id long, toxic int")):
        assert toxicity.without_toxic(docs, labels).count() == docs.count()
        assert {x["predicted"] for x in toxicity.toxicity(docs, labels).collect()} == {0}
    assert toxicity.without_toxic(empty, none).count() == 0


def test_quality(spark, docs, empty):
    r = random.Random(8)
    rows = [(i, prose(r, 60) if i % 2 else " ".join(f"{w}%%%" for w in prose(r, 60).split()), i % 2) for i in range(120)]
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    out = {x["doc_id"]: x for x in quality.quality(table, labels).collect()}
    held = [(out[i]["predicted"], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert sum(p == y for p, y in held) >= 0.9 * len(held)
    assert quality.quality(docs, labels).count() == docs.count()
    assert quality.quality(empty, labels.limit(0)).count() == 0


def test_quality_without_evidence_keeps_every_document(spark, docs, empty):
    for rows in ([], [(1, 0), (4, 0), (7, None)], [(1, 1), (4, 1)]):
        out = quality.quality(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect()
        assert len(out) == docs.count() and {(x["score"], x["predicted"]) for x in out} == {(0.5, 1)}
    assert quality.quality(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_network_by_plain_loops():
    w = {k: v.astype(np.float64) for k, v in quality.start(2).items()}
    w["bias"] += 0.1
    for n in (0, 1, 3, 4, 9, 255, 256, 260, 700):
        text = bytes(random.Random(n).randrange(256) for _ in range(n))
        rows = max(2, -(-n // quality.STEP))
        padded = text + bytes(rows * quality.STEP - n)
        found = []
        for i in range(rows - 1):
            window = padded[quality.STEP * i : quality.STEP * (i + 2)]
            found.append([])
            for f in range(quality.FILTERS):
                x = w["bias"][f]
                for place, byte in enumerate(window):
                    half, at = divmod(place, quality.STEP)
                    for d in range(quality.DIM):
                        x += w["bytes"][byte][d] * w["halves"][at * quality.DIM + d][half * quality.FILTERS + f]
                found[-1].append(max(x, 0.0))
        chunks = [found[s : s + quality.CHUNK] for s in range(0, max(1, len(found) - (quality.CHUNK - quality.STRIDE)), quality.STRIDE)]
        assert sum(len(c) for c in chunks) >= len(found) and chunks[-1][-1] is found[-1]  # from end to end
        top = [[max(a[f] for a in c) for f in range(quality.FILTERS)] for c in chunks]
        features = [sum(t[f] for t in top) / len(top) for f in range(quality.FILTERS)] + [max(t[f] for t in top) for f in range(quality.FILTERS)]
        want = 1 / (1 + np.exp(-(sum(a * b for a, b in zip(features, w["out"])) + w["base"][0])))
        assert abs(quality.score(w, text) - want) < 1e-9


def test_network_slices_and_gradient():
    w = {k: v.astype(np.float64) for k, v in quality.start(1).items()}
    text = bytes(random.Random(1).randrange(256) for _ in range(9000))
    whole = quality.score(w, text)
    slice_bytes, quality.SLICE = quality.SLICE, 1000
    assert abs(quality.score(w, text) - whole) < 1e-12
    quality.SLICE = slice_bytes
    g = {k: np.zeros_like(v) for k, v in w.items()}
    assert abs(quality.gradient(w, text, 1, 1.0, g) - whole) < 1e-9
    for k in w:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        w[k][i] += 1e-6
        up = -np.log(quality.score(w, text))
        w[k][i] -= 2e-6
        down = -np.log(quality.score(w, text))
        w[k][i] += 1e-6
        assert abs((up - down) / 2e-6 - g[k][i]) < 1e-4 * max(1, abs(g[k][i]))


# ---- 6 and 10


def test_bpe_equals_the_library(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    out = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(docs, path).collect() if r["doc_id"] is not None)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        if i is not None:
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert out == sorted(want)
    assert bpe.encode_documents(empty, path).count() == 0


PARTS = ["a", "b", " ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u2003", "é", "ß", "Σ", "İ", "中", "٣", "'s", "'LL", "!", "😀", "<|endoftext|>", "\u0301", "5", "  ", "THE", "tion"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokenizers_on_random_texts(name):
    library, r = Tokenizer.from_file(public_tokenizers.path(name)), random.Random(1)
    own = bpe.Encoder(public_tokenizers.path(name)) if name.startswith("byte") else packing.WordTokenizer(public_tokenizers.path(name))
    kind = "<u4" if name.startswith("byte") else own.kind
    for _ in range(3000):
        text = "".join(r.choice(PARTS) for _ in range(r.randrange(30)))
        assert np.frombuffer(own.encode(text if name.startswith("byte") else text.encode()), kind).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_words_merge_alike():
    e, r = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    for _ in range(50):
        word = "".join(r.choice("abtheion") for _ in range(180)).encode()
        assert e.merge(word) == e._merge_long(word)


def test_packing(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = [r.asDict() for r in packing.pack(docs, path, window=64, keep_ids=True).collect()]
    tokens = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    total = sum(tokens)
    assert sum(r["length"] for r in out) == total
    for r in out:
        assert r["length"] == len(r["ids"]) > 0 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for number, pieces in by_sequence.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == (64 if number < total // 64 else total % 64)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in rows if i is not None and i != 6000}
    for i, want in ids.items():
        mine = sorted((p for p in out if p["doc_id"] == i), key=lambda p: p["start"])
        assert [x for p in mine for x in p["ids"]] == want and all(p["doc_tokens"] == len(want) for p in mine)
    shares = {}
    for r in out:
        shares[r["source"]] = shares.get(r["source"], 0) + r["length"] / total
    for number, pieces in by_sequence.items():
        if number < total // 64:
            for s, share in shares.items():
                assert abs(sum(p["length"] for p in pieces if p["source"] == s) - 64 * share) <= 2
    assert packing.pack(empty, path).count() == 0


def test_every_small_source_is_a_queue(spark):
    rows = [(i, "word " * 200, "big") for i in range(60)] + [(100 + 3 * i + k, "word " * 30, f"mid{i}") for i in range(40) for k in range(3)] + [(900 + i, "x", f"tiny{i}") for i in range(30)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), public_tokenizers.path("word_bpe_49k.json"), 128, keep_ids=True).collect()
    total = 60 * 201 + 120 * 31 + 30 * 2
    assert {r["doc_id"] for r in out} == {i for i, _, _ in rows} and sum(r["length"] for r in out) == total
    filled = {}
    for r in out:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for number, pieces in filled.items():
        assert sum(n for _, n in pieces) == (128 if number < total // 128 else total % 128)
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(pieces), sorted(pieces)[1:]))
    # the middle sources earn 93 * 128 / total < 1 token a window: a group, in rounds of 64 tokens for each of them
    end = packing.round_of(40 * 93 + 60, 2, 93) / (40 * 93 + 60) * (total / 128)
    every = 0
    for i in range(40):
        mine = [r for r in out if r["source"] == f"mid{i}"]
        early = sum(r["length"] for r in mine if r["sequence_id"] <= end - 2)
        late = sum(r["length"] for r in mine if r["sequence_id"] >= end + 2)
        assert early <= 65 and late <= 93 - 64
        every += early
    assert 64 * 40 - 150 < every < 65 * 40


def test_nested_shares_place_each_token_once():
    r = random.Random(31)
    for _ in range(40):
        small = [r.randrange(1, 9) for _ in range(r.randrange(1, 30))]
        large = [r.randrange(60, 400) for _ in range(r.randrange(1, 5))]
        size, total, window = sum(small), sum(small) + sum(large), 16
        while size * window < total:
            large.pop()
            total = size + sum(large)
        seen = set()
        for k, n in enumerate(large):
            own = packing.Share(sum(large[:k]), n, total, window)
            seen |= {(w, o + x) for _, length, w, o in own.pieces(0, n) for x in range(length)}
        outer, turn = packing.Share(sum(large), size, total, window), 4 * -(-size // min(small))
        for k, n in enumerate(small):
            inner = packing.Share(sum(small[:k]), n, size, turn)
            at = 0
            while at < n:  # in documents
                length = min(r.randrange(1, 5), n - at)
                found = list(packing.nested(inner, outer, at, length))
                assert [p[0] for p in found] == [sum(p[1] for p in found[:i]) for i in range(len(found))] and sum(p[1] for p in found) == length
                seen |= {(w, o + x) for _, part, w, o in found for x in range(part)}
                at += length
        assert seen == {(i // window, i % window) for i in range(total)}


def test_groups_of_levels_earn_a_token_a_window():
    a, b, c, d = (0, 500, 60, 90), (1, 60, 5, 9), (3, 40, 1, 2), (3, 140, 1, 2)
    assert packing.groups_of([b, c], 10_000, 100) == [[b, c]]
    assert packing.groups_of([c, a], 10_000, 100) == [[a, c]]
    assert packing.groups_of([d, a], 10_000, 100) == [[a], [d]]
    assert packing.groups_of([], 10_000, 100) == []
    assert packing.round_of(1000, 10, 20) == 64 * 50 and packing.round_of(1000, 1, 1000) == 1000


# ---- 7


def word_sets(rows):
    out = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def test_near_duplicates(docs, rows, empty):
    out = minhash.near_duplicates(docs).collect()
    sets = word_sets([r for r in rows if r[0] is not None])
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = union_find(links, sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out if r["doc_id"] is not None}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(out) == len(rows) and all(r["kept"] and r["component_id"] is None for r in out if r["doc_id"] is None)
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.keep_one(docs).columns == docs.columns


def test_large_group_of_near_copies(spark):
    r = random.Random(6)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(r.randrange(5)):
            copy[r.randrange(120)] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = word_sets(rows)
    want = union_find([(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])], sets)
    assert got == want


# ---- 9


def cut_plain(rows):
    first, out = {}, []
    known = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    for i, w in known:
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    for i, w in known:
        keep = [True] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                keep[k : k + 13] = [False] * 13
        left = [x for x, y in zip(w, keep) if y]
        out.append((i, len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=order)


def test_cut_repeats(docs, rows, empty, monkeypatch):
    out = sorted((tuple(r) for r in substring.cut_repeats(docs).collect()), key=order)
    assert out == cut_plain(rows)
    cut = substring.documents_without_repeats(docs)
    assert cut.columns == docs.columns and cut.schema.simpleString() == docs.schema.simpleString()
    assert substring.cut_repeats(empty).count() == 0


def test_rows_of_one_doc_id_are_told_apart(spark):
    """Two texts of one doc_id whose hashes agree in the upper 16 bits: nothing of the one goes for what the other repeats."""
    r = random.Random(11)
    passage = prose(r, 20, 10_000)
    made = [(k, f"{passage} {prose(r, 41, 10_000)}" if k % 2 else prose(r, 61, 10_000)) for k in range(1200)]
    upper = {x["k"]: x["h"] for x in spark.createDataFrame(made, "k long, text string").selectExpr("k", "shiftrightunsigned(xxhash64(text), 48) h").collect()}
    by = {}
    for k, h in upper.items():
        by.setdefault((h, k % 2), k)
    one, other = next((k, by[h, 0]) for (h, odd), k in by.items() if odd and (h, 0) in by)
    rows = [(1, passage), (9, made[one][1]), (9, made[other][1])]
    out = sorted((tuple(x) for x in substring.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=order)
    assert out == cut_plain(rows) and sorted(x[2] for x in out) == [0, 0, 20]


def test_cover_reaches_every_pair_of_places():
    for i in range(substring.PERIOD):
        for j in range(substring.PERIOD):
            assert any((i + d) % substring.PERIOD in substring.COVER and (j + d) % substring.PERIOD in substring.COVER for d in range(substring.PERIOD))


def test_packed_entries_come_back():
    r = np.random.default_rng(1)
    for kind in (substring.ANCHOR_ENTRY, substring.WINDOW_ENTRY, substring.PLACE):
        e = np.zeros(500, kind)
        for f in kind.names:
            e[f] = r.integers(0, np.iinfo(kind[f]).max, 500, dtype=kind[f])
        if kind is substring.ANCHOR_ENTRY:
            e["h"] &= ~np.uint64(255)
        got = substring._unpack(substring._pack(e), kind)
        assert sorted(got.tolist()) == sorted(e.tolist())


def brute_components(texts):
    """doc_id -> least doc_id reachable, by comparing all sets of shingles with each other."""
    sets = {}
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return union_find(links, ids)


def test_group_of_near_copies_below_and_above_the_bound(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 64)  # several blocks, of settled members and of others
    r = random.Random(11)
    base = prose(r, 120, 10_000).split()
    texts = []
    for k in range(500):
        copy = list(base)
        for _ in range(r.randrange(0, 14)):
            copy[r.randrange(len(copy))] = f"y{r.randrange(10**6)}"
        texts.append((1000 - k, " ".join(copy)))
    want = brute_components(texts)
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert 10 < len(set(want.values())) < 400  # linked ones and others
    assert got == want


def test_common_counts_by_matrix_and_one_by_one():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 3000, n).astype(np.uint64)) for n in r.integers(0, 2500, 40)]
    want = np.array([[len(set(a.tolist()) & set(b.tolist())) for b in sets[15:]] for a in sets[:15]])
    every = np.ones(want.shape, bool)
    assert (minhash._common(sets[:15], sets[15:], every) == want).all()
    few = np.zeros(want.shape, bool)
    few[3, 4] = few[0, 0] = True
    assert (minhash._common(sets[:15], sets[15:], few) == np.where(few, want, 0)).all()


def test_one_doc_id_with_several_sets_is_one_document(spark):
    r = random.Random(12)
    a, b = prose(r, 50, 10_000), prose(r, 50, 10_000)
    rows = [(1, a), (9, a), (9, b), (4, b), (7, prose(r, 50, 10_000))]
    got = sorted((x["doc_id"], x["component_id"]) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (4, 1), (7, 7), (9, 1), (9, 1)]
