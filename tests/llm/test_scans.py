"""Secret and personal data scans, main text, repeated spans and vector search against brute force, and odd inputs."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import string
import time
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeframe.llm import content, personal, queries, secrets, substrings, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)).encode()).hexdigest()


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return out


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_personal(text):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return out


def nasty(n, alphabet, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(alphabet, k=rnd.randint(0, 120))) for _ in range(n)]


SECRET_TEXTS = [
    *nasty(300, ["password", "TOKEN", "api_key", "APIKEY", ":", "=", " ", '"', "'", "abc", "AKIA", "Q7", "0f3a9c", "é", "=-", "secret", "\n", "9"], 1),
    "a" * 40, "deadbeef" * 9, "AKIAAKIA1234567890", "Token = 'x1234567' token:1234567", None, "", "🎈 secret=abcdefgh1 🎈 passwd: 12345678",
]
PERSONAL_TEXTS = [
    *nasty(500, ["a", "b.", "@", "c-d", ".", "1", "22", "255", "256", "+", "4111", " ", "-", "(", ")", "é", "\n", "0", "00"], 2),
    "x 4111 1111 1111 1111 y", "a@b.c@d.e.", "1.2.3.4.5.6.7.8.9", "+1 (202) 555-0143 +44", "9" * 5000 + ".1.1.1", None, "",
    "http://bob:pw@host.example/x IBAN: GB82 WEST 1234 5698 7654 32.",
]


def frame(spark, texts):
    return spark.createDataFrame([(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, base int")


def test_secrets_base_spans(spark):
    got = secrets.scan(frame(spark, SECRET_TEXTS)).select("id", secrets.listed("base").alias("base")).collect()
    want = Counter(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(brute_secrets(t or ""))) for t in SECRET_TEXTS)
    assert Counter(r.base for r in got) == want


def test_secrets_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.QUERIES["op2_secret_scan"](spark, sf_dir).collect():
        base = brute_secrets(texts[r.doc_id])
        kinds = Counter(s[3] for s in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == digest(base)
        assert set(filter(None, ",".join(f"{k}:{a}:{b}" for a, _, b, k in base).split(","))) <= set(r.spans.split(","))


def planted_tokens(seed):
    """Random keys, and ordinary tokens of the same lengths."""
    rnd = random.Random(seed)
    signs = string.ascii_letters + string.digits
    keys = ["".join(rnd.choices(signs, k=n)) for n in (20, 24, 32, 40) * 15] + [base64.b64encode(rnd.randbytes(30)).decode() for _ in range(30)]
    keys += ["".join(rnd.choices(string.ascii_uppercase + string.digits, k=24)) for _ in range(20)]
    plain = [str(uuid.UUID(int=rnd.getrandbits(128))) for _ in range(40)] + ["".join(rnd.choices(string.digits, k=22)) for _ in range(40)]
    plain += [
        "2024-05-01T10-22-33-000", "src/components/HeaderMenu/index", "getUserAccountSettingsById2", "MAX_CONNECTION_POOL_SIZE_64", "release-2024-03-18-build",
        "internationalization_helper_v2", "https_proxy_server_address", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 30, "_" * 30, "-" * 40, "550e8400-e29b-41d4-a716-446655440000",
        "12345678901234567890123", "build/linux-x86_64/release-1.4", "ThisIsARatherLongClassNameIndeed",
    ]
    return keys, plain


def test_made_samples_tell_keys_from_identifiers(spark, sf_dir):
    """Recall of 0.95 and precision of 0.95 on planted tokens; the given texts hold no other random strings."""
    keys, plain = planted_tokens(3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**6 + i, f"look at {t} here") for i, t in enumerate(keys + plain)], "doc_id long, text string")
    got = {r["id"]: [s.value for s in r.spans if s.kind == 3] for r in secrets.scan(docs.unionByName(more)).collect()}
    right = sum(got[10**6 + i] == [t] for i, t in enumerate(keys))
    wrong = [t for i, t in enumerate(plain) if got[10**6 + len(keys) + i]]
    assert right >= 0.95 * len(keys) and len(wrong) <= 0.05 * right, (right, wrong)
    assert sum(bool(v) for i, v in got.items() if i < 10**6) == 0


def test_markov_spans_equal_brute_force(spark):
    """Added spans by plain dictionaries of pairs over the same labelled samples."""
    keys, plain = planted_tokens(8)
    samples = [(t, 1) for t in keys[:60]] + [(t, 0) for t in plain]
    texts = [f"{a} x {b}, é{c} token={d}" for a, b, c, d in zip(keys[50:], plain, keys[20:], keys, strict=False)] + ["", "short"]
    counts = [Counter(), Counter()]
    for t, label in samples:
        counts[label].update(zip(t, t[1:], strict=False))

    def ratio(pair):
        chance = [(c[pair] + secrets.SMOOTHING) / (sum(n for (x, _), n in c.items() if x == pair[0]) + secrets.SMOOTHING * secrets.CODES) for c in counts]
        return math.log(chance[1] / chance[0])

    frame_ = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: [(s.start, s.end) for s in r.spans if s.kind == 3] for r in secrets.scan(frame_, samples=spark.createDataFrame(samples, "token string, label int")).collect()}
    for i, text in enumerate(texts):
        base = brute_secrets(text)
        want = []
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
            score = sum(map(ratio, zip(m[0], m[0][1:], strict=False)))
            if score >= max(secrets.RATIO, secrets.PER_CHARACTER * len(m[0])) and not any(b[0] < m.end() and m.start() < b[2] for b in base):
                want.append(m.span())
        assert got[i] == want
    assert sum(map(len, got.values())) > 20


def test_many_matches_take_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, "token=abcdefgh1 " * n)], "doc_id long, text string").select(F.size(secrets.matches(F.col("text"), secrets.ASSIGN, 0, 1)).alias("n"))
        start = time.perf_counter()
        assert df.first().n == n
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 20


def test_markov_models_tell_random_strings(spark):
    rnd = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    noise = ["".join(rnd.choices(letters, k=32)) for _ in range(950)]
    plain = ["getUserNameFromSession", "parse_request_header", "maximumRetryIntervalMs", "load_default_settings_file"] * 40
    samples = spark.createDataFrame([(t, 1) for t in noise[:900]] + [(t, 0) for t in plain], "token string, label int")
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(noise[900:] + plain[:4])], "doc_id long, text string")
    got = {r["id"]: [s.kind for s in r.spans] for r in secrets.scan(docs, samples=samples).collect()}
    assert sum(got[i] == [3] for i in range(50)) >= 48 and all(got[i] == [] for i in range(50, 54))
    assert secrets.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", PERSONAL_TEXTS)
def test_personal_base_spans(text):
    got = [(s, k, e, personal.KINDS[k]) for s, k, e in personal.find(text) if k < 4]
    if text and len(text) < 4000:
        assert sorted(got) == sorted(brute_personal(text))


def test_personal_more_spans(spark):
    text = PERSONAL_TEXTS[-1]
    more = {personal.KINDS[k]: text[s:e] for s, k, e in personal.find(text) if k > 3}
    assert more == {"login": "bob:pw@host.example", "account": "GB82 WEST 1234 5698 7654 32"}
    assert personal.scan(frame(spark, PERSONAL_TEXTS)).count() == len(PERSONAL_TEXTS)
    assert personal.scan(frame(spark, PERSONAL_TEXTS).limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, account",
    [
        ("IBAN DE89 3704 0044 0532 0130 00 Please pay", "DE89 3704 0044 0532 0130 00"), ("IBAN: DE89370400440532013000 BIC COBADEFF", "DE89370400440532013000"),
        ("IBAN number: DE89370400440532013000.", "DE89370400440532013000"), ("IBAN No. NO93 8601 1117 947 1", "NO93 8601 1117 947"),
        ("iban GB82 WEST 1234 5698 7654 32 2 x", "GB82 WEST 1234 5698 7654 32"), ("Iban is MT84MALT011000012345MTLCAST001S", "MT84MALT011000012345MTLCAST001S"),
        ("IBAN DE88 3704 0044 0532 0130 00 Please", None), ("IBAN DE893704004405320130001", None), ("IBAN DE89 3704 0044 0532", None),
    ],
)
def test_accounts_end_with_their_country_length(text, account):
    assert [text[s:e] for s, k, e in personal.find(text) if k == 5] == [account][: account is not None]


def test_personal_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.QUERIES["op5_personal_data"](spark, sf_dir).collect():
        base = brute_personal(texts[r.doc_id])
        kinds = Counter(s[3] for s in base)
        assert [r[f"n_{k}"] for k in personal.BASE] == [kinds[k] for k in personal.BASE] and r.base_sha256 == digest(base)


def brute_removed(texts, window=35):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_repeated_spans_query(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want = dict(zip([d.doc_id for d in docs], brute_removed([d.text for d in docs]), strict=True))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op9_repeated_spans"](spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_repeated_spans_fixture(spark, seed):
    """Edited copies, shared passages, repeats inside a text, one-word runs, copies and short texts."""
    rnd = random.Random(seed)

    def fresh(n, vocabulary=500):
        return [f"w{rnd.randrange(vocabulary)}é" for _ in range(n)]

    passages = [fresh(n) for n in (34, 35, 36, 60, 200)]
    texts = [None, "", "a b c", " ".join(["same"] * 90), " ".join(["x", "y"] * 60), " ".join(["same"] * 34)]
    for k in range(60):
        words = fresh(rnd.randint(0, 150))
        for p in rnd.sample(passages, rnd.randint(0, 3)):
            at = rnd.randint(0, len(words))
            p = list(p)
            if rnd.random() < 0.4:
                p[rnd.randrange(len(p))] = "edit"
            cut = rnd.choice([0, 0, 5, 20])
            words[at:at] = p[cut:]
        texts.append(rnd.choice([" ", "\n", "\t "]).join(words))
        if k % 9 == 0:
            texts += [texts[-1]] * 3
    loop = fresh(50)
    texts.append(" ".join(loop * 4 + fresh(20)))
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, key string")
    got = {r["id"]: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeated_spans(docs).collect()}
    want = dict(enumerate(brute_removed(texts)))
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert substrings.repeated_spans(docs.limit(0)).count() == 0


def brute_top(rows, k=10):
    usable = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q, v in usable.items():
        if q % 100 == 0:
            scores = sorted((-int(np.dot(v[: len(c)], c[: len(v)])), i) for i, c in usable.items() if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def test_vector_fixture(spark):
    """Ties, a common vector, nulls, infinities, other lengths and scales."""
    rnd = random.Random(6)
    common = [rnd.gauss(0, 0.1) for _ in range(16)]
    rows = [(i, common if i % 3 == 0 else [rnd.gauss(0, 0.1) for _ in range(16)]) for i in range(1, 700)]
    rows += [(700, None), (800, [None] * 16), (900, [float("inf")] * 16), (1000, [float("nan")] + [0.0] * 15), (1100, []), (1200, [0.5] * 3), (1300, [3e4] * 16), (1301, [-3e4] * 16), (None, common)]
    rows.append(rows[99])
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, query int, class int")
    got = {tuple(r) for r in vectors.top(table, F.col("vec_id") % 100 == 0).collect()}
    assert got == brute_top(rows)
    assert {tuple(r) for r in vectors.top(table, F.col("vec_id") % 100 == 0, block=3).collect()} == got
    assert vectors.top(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("size", [1e6, 1e10, 1e300])
def test_large_components(spark, size):
    """Products beyond a long, beyond float64's integers and beyond the cut: ranked by the whole numbers."""
    rnd = random.Random(int(size) % 97)
    rows = [(i, [rnd.gauss(0, 1) * (size if rnd.random() < 0.3 else 1) for _ in range(6)]) for i in range(1, 400)]
    rows += [(i + 1000, rows[i][1]) for i in range(5)]
    cut = lambda x: int(math.floor(max(min(x * 1024, 2.0**55), -(2.0**55))))
    whole = {i: [cut(x) for x in v] for i, v in rows}
    want = set()
    for q in (i for i in whole if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:10]
        want |= {(q, r + 1, i, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, i) in enumerate(scores)}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in vectors.top(table, F.col("vec_id") % 100 == 0, block=2).collect()} == want


def test_vectors_of_one_id_leave_room_for_others(spark):
    """Query ids with several vectors of their own, and one shared with a query that has a single row."""
    rnd = random.Random(7)
    base = [rnd.gauss(0, 0.1) for _ in range(8)]
    rows = [(i, [rnd.gauss(0, 0.1) for _ in range(8)]) for i in range(1, 60) if i % 10]
    rows += [(100, [x * f for x in base]) for f in range(5, 20)] + [(200, [x * 9 for x in base]), (200, [-x for x in base]), (300, [x * 9 for x in base])]
    usable = sorted({(i, tuple(int(np.floor(1024 * x)) for x in v)) for i, v in rows})
    want = []
    for q in (100, 200, 300):
        scores = sorted((-int(np.dot(v, c)), j) for i, v in usable if i == q for j, c in usable if j != q)[:10]
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vectors.top(table, F.col("vec_id") % 100 == 0).collect())) == want


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class=ad>Buy</div>%s<aside>More</aside><form><input>Find</form>
<section id="comments"><p>Nice post</p></section><footer>&copy; x</footer></body></html>"""


def test_main_text():
    body = "<article><h1>Title &amp; more</h1><p>First   <b>bold</b> line<br>goes\non.<p>Short.<script>var a='</p>';</script><ul><li>one<li>two</ul></article>"
    want = "Title & more\nFirst bold line goes on.\nShort.\none\ntwo"
    assert content.extract(PAGE % body) == want
    loose = "<div><h2>Head</h2><p>%s</p><p>tiny</p><p>%s</p></div>" % ("long text here " * 20, "more of the text " * 20)
    got = content.extract(PAGE % loose).split("\n")
    assert got[0] == "Head" and got[2] == "tiny" and len(got) == 4


@pytest.mark.parametrize("html", [None, "", "<", "<![foo bar]>", "<p>a</p><![ foo", "<p>a</p><!-- open <p>b", "<div>" * 3000 + "x", "</p></p>a", "<a" * 50, "&#xD800;", "<li>" * 2000])
def test_broken_pages_never_raise(html):
    assert "open" not in content.extract(html)


@pytest.mark.parametrize(
    "mark", ['<h2 id="login-flow">%s</h2>', '<section id="social-history"><p>%s</p></section>', '<section id="related-work"><p>%s</p></section>',
             '<h2 id="search-results">%s</h2>', '<h2 class="header">%s</h2>', '<div class="header"><h1>%s</h1></div>', '<p id="comments">%s</p>', '<div class="notice-period"><p>%s</p></div>']
)
def test_article_parts_are_not_dropped_by_name(mark):
    body = "<p>" + "article text " * 30 + "</p>"
    for region in ("article", "main"):
        assert "Own words" in content.extract(PAGE % f"<{region}>{body}{mark % 'Own words'}{body}</{region}>")
    if mark.startswith(("<h2", "<section")):
        assert "Own words" in content.extract(PAGE % f"<div>{body}{mark % ('Own words ' * 20)}{body}</div>")


@pytest.mark.parametrize("mark", ['<div class="related">%s</div>', '<ul class="share-buttons"><li>%s</ul>', '<div class="cookie_banner">%s</div>', '<div role="search" id="x">%s</div>'])
def test_page_furniture_in_articles_is_left_out(mark):
    assert "Own words" not in content.extract(PAGE % f"<article><p>{'article text ' * 30}</p>{mark % 'Own words'}</article>")


MARKS = [
    '<script>if (s=="<!--") t()</script>', "<script><!-- old </script>", "<style>p:after{content:'<!--'}</style>",
    '<p title="<!-- x">kept</p>', "<!-- said --!>", "<!-->", "<!--->", "<!-- a -- > b -->", "<textarea><!--</textarea>",
]


@pytest.mark.parametrize("mark", MARKS)
def test_comment_marks_do_not_cut_pages(mark):
    from citeframe.operators.extract import scan_page

    page = f"<html><head><title>a <!-- b</title></head><body><article><h1>Head</h1>{mark}<p>%s</p></article></body></html>" % ("article text " * 20)
    assert content.extract(page).endswith("article text") and content.extract(page).startswith("Head")
    assert scan_page(page)["body_text"].rstrip().endswith("article text") and scan_page(page)["title"] == "a <!-- b"
    hidden = page.replace("<p>article", "<!-- open <p>article").replace("article text", "gone")
    assert "gone" not in content.extract(hidden) and "gone" not in scan_page(hidden)["body_text"]


STORY = "".join("<p>" + f"Real words of the story number {i} go on here. " * (3 + i % 4) + "</p>" for i in range(6))


@pytest.mark.parametrize("n", [3, 5, 12])
def test_ratios_decide_inside_regions(monkeypatch, n):
    """Lists of links leave an article, lists of text stay; without the threshold the links stay."""
    links = "<ul>" + "".join(f"<li><a href=/{i}>Further page {i}</a></li>" for i in range(n)) + "</ul>"
    items = "<ul>" + "".join(f"<li>Item {i}</li>" for i in range(n)) + "</ul>"
    page = PAGE % f"<article><h1>Head</h1>{STORY}{links}{STORY}{items}{STORY}</article>"
    got = content.extract(page)
    assert "Further" not in got and got.count("Item") == n and got.startswith("Head") and got.count("number 3") == 3 * 6
    monkeypatch.setattr(content, "threshold", lambda values: 0.0)
    assert content.extract(page).count("Further") == n


@pytest.mark.parametrize("part", [
    '<article class="comment">%s</article>', '<div class="comment-body">%s</div>', '<div id="comments">%s</div>', '<div class="comments-section">%s</div>',
    '<div class="cookie-notice">%s</div>', '<div class="sponsored-content">%s</div>', '<div class="newsletter-signup">%s</div>',
])
def test_comments_and_notices_leave_articles(part):
    assert "Own words" not in content.extract(PAGE % f"<article>{STORY}{part % ('Own words ' * 30)}{STORY}</article>")
    beside = content.extract(PAGE % f"<article>{STORY}</article>{part % ('Own words ' * 30)}")
    assert "Own words" not in beside and "Real words" in beside


@pytest.mark.parametrize("name", ["social-history", "search-basics", "related-work", "login-flow"])
def test_ordinary_classes_stay(name):
    for page in (f'<div class="{name}">{STORY}</div>', f'<article><div class="{name}">{STORY}</div></article>'):
        assert content.extract(PAGE % page).count("Real words") == sum(3 + i % 4 for i in range(6))


@pytest.mark.parametrize("first,then", [("<b>", "</i></i>"), ("<span>", "<div></div>"), ("<ul><li>x", ""), ("<p><li>", "<span></div>")])
def test_hostile_pages_take_linear_time(first, then):
    def seconds(n):
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            content.extract("<p>" + first * n + then * n)
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(16_000) < 9 * seconds(4_000) + 0.2


def test_main_text_query(spark, sf_dir):
    rows = queries.QUERIES["op6_main_text"](spark, sf_dir).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    import html as entities

    for r in rows:
        article = re.search(r"<article>(.*)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
