"""The training-data operators against brute force, on small fixtures with the odd cases."""

import collections
import hashlib
import html as references
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, components, decontam, html, kneser_ney, langid, linededup, lmscore, quality, queries, secrets, simhash, suffix_tree
from tests.conftest import SF

ODD = [(1, "Hello World, it's <|endoftext|> é 中文 #1", "en", "a", 5), (2, None, "en", "a", 0), (3, "", None, "a", 0), (4, " \n\t ", "en", None, 0), (None, "a null id", "en", "b", 1), (5, "same", "en", "b", 1), (5, "same", "en", "b", 1), (6, "x" * 60_000 + " end", "en", "b", 1), (7, "1 2 3 ...", "de", "b", 1)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names operators use themselves."""
    return spark.createDataFrame(ODD, COLUMNS).withColumns({c: F.lit("clash") for c in ("score", "n", "fp", "host", "key", "ids", "_boilerplate", "bits")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return [(r.doc_id, r.text, r.lang) for r in documents.select("doc_id", "text", "lang").collect()]


def words(text):
    return (text or "").encode().translate(bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))).split()


ALL = [
    ("bpe", lambda d: bpe.encode_documents(d)),
    ("secrets", lambda d: secrets.scan(d)),
    ("langid", lambda d: langid.identify(d)),
    ("quality", lambda d: quality.judge(d)),
    ("lmscore", lambda d: lmscore.score(d)),
    ("simhash", lambda d: simhash.near_duplicates(d)),
    ("similar", lambda d: simhash.similar(d)),
    ("lines", lambda d: linededup.drop_lines(d)),
    ("html", lambda d: html.extract_pages(d, "doc_id", "source", "text")),
    ("decontam", lambda d: decontam.find(d, d.sparkSession.createDataFrame([(1, "an item of words that are in no text")], "item_id long, text string"))),
    ("chat", lambda d: chat.format_conversations(d, {}, "doc_id", "n_chars", "source", "text")),
]


@pytest.mark.parametrize(("name", "run"), ALL, ids=[n for n, _ in ALL])
def test_odd_rows_give_a_row_each(odd, empty, name, run):
    got = run(odd).collect()
    if name == "chat":
        assert sorted(str(r.conv_id) for r in got) == sorted({str(r[0]) for r in ODD}) and run(empty).count() == 0
        return
    key = "page_id" if name == "html" else "doc_id"
    assert sorted(str(r[key]) for r in got) == sorted(str(r[0]) for r in ODD)
    assert run(empty).count() == 0


# 1


def test_bpe_equals_the_library(odd, documents):
    t = bpe.tokenizer(bpe.default_path())
    for d in (odd, documents):
        source = collections.defaultdict(list)
        for r in d.select("doc_id", "text").collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            source[r.doc_id].append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        got = collections.defaultdict(list)
        for r in bpe.encode_documents(d).collect():
            got[r.doc_id].append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in source.items()}


def test_joined_leaves_equal_the_library():
    t = bpe.tokenizer(bpe.default_path())
    coder = bpe.Encoder(bpe.default_path())
    random.seed(5)
    pieces = ["a", "the", "S", "'", "s", "'re", "!", "é", "é", "́", "1", "中", "<|endoftext|>", "<|start", "oftext|>", " ", "\U0001f600", "İ", "ᄀ", "ᅡ", "ᆨ", "ing", "er"]
    for _ in range(400):
        s = "".join(random.choices(pieces, k=random.randint(1, 150)))
        assert bpe.encode_long(s, coder.whole, leaf=random.choice([8, 16, 33]), window=random.choice([2, 5])) == t.encode(s, add_special_tokens=False).ids


def test_whole_texts_through_the_tree(texts):
    """Texts of the table cut anywhere, at white space or in words, and texts of nothing but it."""
    t, coder = bpe.tokenizer(bpe.default_path()), bpe.Encoder(bpe.default_path(), leaf=64)
    own = [x or "" for _, x, _ in texts] + [" " * 5000 + "a", "ab \n" * 3000, "!" * 3000 + "'s", "x" * 40_000]
    assert [[int(i) for i in ids.split()] for _, ids, _ in coder.texts([x.encode() for x in own])] == [e.ids for e in t.encode_batch(own, add_special_tokens=False)]
    assert coder.long_texts > len(texts) // 2
    assert max(len(x) for x in own) > bpe.LEAF


def test_ids_and_decoded_come_on_request(odd):
    r = bpe.encode_documents(odd, with_ids=True).filter("doc_id = 1").collect()[0]
    assert r.decoded == bpe.decode_ids(r.ids) and len(r.ids) == r.n_tokens


# 2


def brute_base(text):
    spans = []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            spans.append((m.start(), m.end(), "assign"))
    spans += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


def test_secret_base_spans(texts):
    own = ["", "PASSWORD = 'abcdef' tokén token:short api_key=\"abc.def-123\"", "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "f" * 23 + " " + "0" * 24, "ſecret=abcdefg", "secret = token = abcdefgh"]
    for text in own + [t for _, t, _ in texts]:
        assert secrets.base_spans(text) == brute_base(text)


def test_secret_digest(spark):
    text = "key é token = 04dbebab91ab85687d33eeaaf9ac699e1188f962"
    r = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    base = brute_base(text)
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 0, 1)
    assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()


def test_novelty_finds_what_no_pattern_knows():
    found = secrets.novel_spans("authorization header Bearer q8ZtR4xPz0LmN7vKc2Yw9Ds1 and more")
    assert [k for *_, k in found] == ["novelty"]
    assert secrets.novel_spans("the key of configuration_manager_default_value1 and session") == []
    assert secrets.novel_spans("key " + "ab1" * 12) == []
    assert secrets.novel_spans("the author's document_v20231115_final2") == secrets.novel_spans("monkey q8ZtR4xPz0LmN7vKc2Yw9Ds1") == []


def test_novelty_recall_and_precision():
    """Planted random strings that no base pattern finds, and identifiers in the same contexts."""
    random.seed(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    contexts = ["Authorization: Bearer {}", "the private key is {} .", "aws_credentials {}", "sessionToken -> {}", "pwd {} end", "client auth ({})", "PRIVATE_KEY\n{}"]
    around = "def load_config(path): return path\n{} and other text after it"
    found = 0
    planted = ["".join(random.choices(letters + random.choice(["", "+/", "_-"]), k=random.randint(20, 64))) for _ in range(200)]
    for own in planted:
        text = around.format(random.choice(contexts).format(own))
        assert not secrets.base_spans(text)
        found += any(text[a:b] == own for a, b, _ in secrets.novel_spans(text))
    assert found >= 0.97 * len(planted)
    words = "document version final configuration manager default value request handler service user client session database connection response factory number".split()
    wrong = 0
    for _ in range(200):
        w = [x if random.random() < 0.5 else x.capitalize() for x in random.sample(words, 3)]
        own = random.choice(["{0}_{1}_{2}_v2023", "{0}-{1}-{2}-2024", "{0}_v20231115_{1}2", "{0}{1}{2}123", "{0}/{1}/{2}/1234", "{0}_{1}_0001_{2}"]).format(*w)
        wrong += bool(secrets.novel_spans(around.format(random.choice(contexts).format(own))))
    assert wrong <= 4


def test_novelty_dictionary_is_learned(spark):
    """Parts that many documents have make an identifier known; those of one document don't."""
    rows = [(k, f"the zorble_quandix_{k} = vextraModule{k}") for k in range(30)] + [(99, "private key zorbleQuandixVextra77 and ghostly_nameless_unseenword99")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    parts = secrets.learn(d.select("text"))
    assert set(parts) == {"zorble", "quandix", "vextra", "module"}
    assert secrets.novel_spans(rows[-1][1], parts) != secrets.novel_spans(rows[-1][1])
    assert not any("zorble" in rows[-1][1][a:b] for a, b, _ in secrets.novel_spans(rows[-1][1], parts))


def test_secrets_of_a_very_long_text_take_linear_time():
    import time

    random.seed(4)
    took = []
    for n in (300_000, 600_000):
        run = "".join(random.choices("ABCDEFGHabcdefgh0123456789+/", k=n))
        began = time.process_time()
        assert [k for *_, k in secrets.novel_spans("private key " + run)] == ["novelty"]
        secrets.novel_spans(("key " * 4 + "a1B" * 6 + " ") * (n // 40))
        secrets.parts_of(run), secrets.parts_of("a" * n), secrets.parts_of("a_" * n), secrets.parts_of("aB" * n)
        took.append(time.process_time() - began)
    assert took[1] < 4 * took[0] + 0.5


# 3


def test_language_on_held_out(documents):
    rows = langid.identify(documents).join(documents, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_without_letters(odd):
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert [got[k].lang_pred for k in (2, 3, 4, 7)] == ["und"] * 4


def test_language_sample_is_bounded_with_repeats(spark):
    rows = [(1, "the same row again and again", "en")] * 3000 + [(k, f"word{k} and other {k}", "en") for k in range(300)] + [(k, f"wort{k} und andere {k}", "de") for k in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(d, "doc_id", "text", "lang", 40)
    assert collections.Counter(r[1] for r in got) == {"en": 40, "de": 40}
    assert len({(r[0], r[1]) for r in got}) == 80


# 4


def test_articles_come_whole(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in html.extract_pages(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for p in pages:
        inner = re.search("<article>(.*?)</article>", p.html, re.DOTALL)
        want = " ".join(references.unescape(re.sub("<[^>]+>", "\n", inner[1])).split()) if inner else ""
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def test_boilerplate_goes():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div id=cookie-banner>We use cookies on this site.</div>
    <div class=content><h1>Title</h1><p>This is the long text of the article and it is about the thing that was in the news for the last days, with more words to make it longer than the limit that was set for it in the code.</p>
    <p>Short &amp; sweet.</p><form><p>Write to us about it</p></form><script>var a = "<p>no</p>"</script></div>
    <section class="comments"><p>I think that this is a comment of the reader and it is quite long, so that it may be taken for the article by mistake, if the rules were not good.</p></section>
    <aside>Other</aside><footer>end</footer></body></html>"""
    text = html.extract(page)
    assert text.startswith("Title This is the long text") and text.endswith("Short & sweet.")
    assert html.extract("") == html.extract("<p>") == html.extract("<!-- ") == ""
    assert html.extract("<article><p>a<b>b&nbsp;c</article><footer>d") == "ab c"


def test_pages_of_divs_alone_come_whole():
    menu = '<div class=top><a href=1>Uutiset ja kaikki muut sivut</a> <a href=2>Hae sivuilta lisää tietoa aiheesta</a> <a href=3>Ota yhteyttä meihin heti</a></div>'
    finnish = "Kaupungin valtuusto päätti eilen illalla uuden kirjaston rakentamisesta keskustaan, ja työt alkavat ensi keväänä heti lumien sulettua. " * 3
    page = f"<body>{menu}<div class=content><h1>Otsikko</h1><p>{finnish}</p><p>Lyhyt loppu.</p></div><footer>Yhtiö</footer></body>"
    assert html.extract(page) == f"Otsikko {finnish.strip()} Lyhyt loppu."
    assert html.extract(f"<body>{menu}<p>{finnish}</p><p>{finnish}</p></body>") == f"{finnish.strip()} {finnish.strip()}"
    english = "This is the long text of the page and it is about the thing that was in the news for the last days, with more words to make it longer than the limit that was set for it in the code of the program, as it is to be."
    code = "def compute(values): total = sum(v * weight[v] for v in values); return normalise(total, scale=4.5) " * 3
    assert html.extract(f"<body>{menu}<div><p>{english}</p><pre>{code}</pre><p>Short end.</p></div></body>") == f"{english} {code.strip()} Short end."
    cells = "".join(f"<tr><td>Item {k}</td><td>{k * 7}.50</td></tr>" for k in range(3))
    assert html.extract(f"<body><div><p>{english}</p><table>{cells}</table></div></body>").endswith("Item 2 14.50")
    assert html.extract(f"<body>{menu}<pre>{code}</pre></body>") == code.strip()


def test_density_decides_where_tags_do_not(spark):
    """The same pages with div for article and main: every text stays the same."""
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        page = r.html or ""
        assert html.extract(re.sub(r"(</?)(article|main)\b", r"\1div", page)) == html.extract(page)


PROSE = "This is the long text of the page and it is about the thing that was in the news for the last days, with more words to make it longer than the limit that was set for it in the code of the program, as it is to be."


def test_pages_without_head_or_body_tags():
    assert html.extract(f"<title>T</title><p>{PROSE}") == PROSE
    assert html.extract(f"<head><title>T</title><meta charset=utf-8><style>p {{}}</style><p>{PROSE}</p>") == PROSE
    assert html.extract(f"<html><title>T</title><body><p>{PROSE}</p></html>") == PROSE


def test_teasers_and_doubtful_words():
    teaser = "<article><h2>Other story</h2><p>Read what it was.</p></article>"
    assert PROSE in html.extract(f"<body>{teaser}<div><p>{PROSE}</p><p>{PROSE}</p></div></body>")
    page = f'<body><nav><a href=1>Home</a></nav><article><p>{PROSE}</p><div class="legal"><p>{PROSE}</p></div><div class="related"><ul><li><a href=2>Another story</a></li></ul></div></article><div class="notice">{PROSE}</div></body>'
    assert html.extract(page) == f"{PROSE} {PROSE}"
    assert html.extract(f'<body><div class="side"><p>{PROSE}</p></div></body>') == PROSE
    assert html.extract(f'<body><div class="ad"><p>{PROSE}</p></div><p>{PROSE}</p></body>') == PROSE


def test_raw_elements_in_each_other():
    page = f"<div><svg><svg><text>a</text></svg><text>leak</text></svg><template><template>x</template>leak</template><script>if (a < b) '</p>'</script><p>{PROSE}</p></div>"
    assert html.extract(page) == PROSE
    assert html.extract(f"<p>{PROSE}</p><svg><svg></svg>leak") == PROSE


def test_very_long_pages():
    assert html.extract("<div>" * 20_000 + f"<p>{PROSE}</p>") == PROSE
    assert html.extract("<p>" + PROSE * 3000).startswith(PROSE)
    assert html.extract("<div>" * 20_000 + "</b></i>" * 20_000 + f"<p>{PROSE}</p>") == PROSE


# 5


def brute_quality(text):
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
    cover = {i + j for i in range(len(own) - 7) if windows[tuple(own[i : i + 8])] > 1 for j in range(8)}
    failed = len(own) < 20 or 100 * len(cover) > 30 * len(own)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), failed


def test_quality_figures(documents, odd, texts):
    for frame, own in ((documents, texts), (odd, ODD)):
        got = collections.defaultdict(list)
        for r in quality.judge(frame).collect():
            got[r.doc_id].append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
            assert not (r.kept and r.base_failed)
        for row in own:
            assert brute_quality(row[1]) in got[row[0]]


def test_quality_keeps_the_clean(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality.judge(d).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert np.mean([r.kept for r in good]) > 0.97
    assert np.mean([r.kept for r in bad]) < 0.2
    assert quality.keep(d).columns == d.columns and quality.keep(d).count() == quality.judge(d).filter("kept").count()


def test_quality_keeps_a_language_of_very_long_words(spark):
    random.seed(6)
    run = lambda: "".join(chr(0x4E00 + int(random.paretovariate(0.7)) % 3000) for _ in range(random.randint(25, 60)))
    rows = [(k, " ".join(run() for _ in range(random.randint(22, 60))), "zh") for k in range(200)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert np.median([r.bits_per_word for r in got]) > 110 and not any(r.base_failed for r in got)
    assert np.mean([r.kept for r in got]) > 0.97


def brute_kneser_ney(sequences):
    """Modified Kneser-Ney of order 3 by its definition: p(c | two before)."""
    three = collections.Counter(tuple(s[i : i + 3]) for s in sequences for i in range(len(s) - 2))
    two = collections.Counter(g[1:] for g in three)  # how many symbols stand before
    one = collections.Counter(g[1:] for g in two)
    tables = {1: one, 2: two, 3: three}

    def discount(n):
        k = [max(1, sum(c == j for c in tables[n].values())) for j in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1])
        return [min(max(0.05, j - (j + 1) * y * k[j] / k[j - 1]), j * 0.95) for j in (1, 2, 3)]

    d = {n: discount(n) for n in (1, 2, 3)}

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / kneser_ney.SYMBOLS
        own = {g: c for g, c in tables[n].items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return p(gram[1:])
        left = sum(d[n][min(c, 3) - 1] for c in own.values()) / total
        c = own.get(gram, 0)
        return (c - d[n][min(c, 3) - 1] if c else 0) / total + left * p(gram[1:])

    return p


def test_kneser_ney_against_brute_force():
    random.seed(2)
    text = "".join(random.choices("abcde fghж中", weights=[9, 8, 7, 3, 2, 9, 1, 1, 1, 2, 1], k=1500))
    keys, first = quality.trigram_keys([text.encode()])
    own, n = np.unique(keys, return_counts=True)
    m = kneser_ney.Model(own, n)
    symbols = [kneser_ney.SPACE] * 2 + kneser_ney.fold(np.array([ord(c) for c in text])).tolist()
    p = brute_kneser_ney([symbols])
    grams = [tuple(symbols[i : i + 3]) for i in range(0, len(text), 7)] + [(1, 1, 500), (77, 78, 79), (symbols[5], 900, symbols[6])]
    want = [p(g) for g in grams]
    got = m._lookup(3, np.array([a << 22 | b << 11 | c for a, b, c in grams]))
    assert np.allclose(got, want, rtol=1e-9)
    assert np.allclose(kneser_ney.Scorer(m).bits(np.repeat(keys, 2)), np.repeat(m.bits(keys), 2), rtol=1e-5)
    for context in [*np.unique(keys >> 11)[:10], 99 << 11 | 98]:
        p = m._lookup(3, (int(context) << 11) + np.arange(kneser_ney.SYMBOLS))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_scripts_have_symbols_of_their_own():
    points = np.array([*range(33, 48), *range(58, 127), *range(0xA0, 0x700)])
    assert len(np.unique(kneser_ney.fold(points))) == len(points)
    assert len(np.unique(kneser_ney.fold(np.arange(0x4E00, 0x9FFF)))) > 200


def test_quality_rejects_junk_that_the_corpus_is_full_of(spark):
    """The second model has not learned what the first finds unlikely; labelled junk goes, labelled clean documents stay."""
    sf = "/root/testdata/sf0.1"
    rows = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert np.mean([r.kept for r in good]) > 0.99
    assert np.mean([r.kept for r in bad]) < 0.1


@pytest.mark.parametrize("most", [0, 40, 900])
def test_quality_is_the_same_however_few_trigrams_are_sent(spark, odd, documents, monkeypatch, most):
    """Those that aren't sent are joined: nothing is left out."""
    d = documents.unionByName(documents.filter("doc_id % 20 = 0")).unionByName(odd.select(documents.columns))
    want, kept = sorted(map(str, quality.judge(d).collect())), sorted(map(str, quality.keep(d).collect()))
    monkeypatch.setattr(quality, "MOST", most)
    assert sorted(map(str, quality.judge(d).collect())) == want
    assert sorted(map(str, quality.keep(d).collect())) == kept


# 6


def test_decontamination(spark):
    random.seed(4)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(2, 8))) for _ in range(3000)]
    draw = lambda n: random.choices(vocabulary, k=n)
    items = [draw(random.randint(15, 60)) for _ in range(40)]
    docs = [draw(random.randint(30, 300)) for _ in range(300)]
    planted = {}
    for k in range(0, 300, 10):
        item = k // 10
        own = list(items[item])
        if k % 20:
            for i in random.sample(range(len(own)), len(own) // 6):
                own[i] = random.choice(vocabulary)
        at = random.randint(0, len(docs[k]))
        docs[k] = docs[k][:at] + own + docs[k][at:]
        planted[k] = item
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)] + [(None, None), (900, "")], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(77, None), (78, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.find(d, b).collect()}
    assert {k for k, r in got.items() if r.contaminated} == set(planted)
    assert all(got[k].item_id == item for k, item in planted.items())
    assert decontam.clean(d, b).count() == 302 - len(planted)
    assert decontam.find(d, b.limit(0)).filter("contaminated").count() == 0
    assert decontam.find(d.limit(0), b).count() == 0


def hot_item(spark, n, hot):
    """n texts; one item of 15 words stands in the first ``hot``, with a group of exact copies among them; others rare."""
    random.seed(14)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(3, 8))) for _ in range(2000)]
    draw = lambda k: random.choices(vocabulary, k=k)
    items = [draw(15) for _ in range(30)]
    docs = [draw(40) + (items[0] if k < hot else []) + draw(40) for k in range(n)]
    for k in range(hot // 3):
        docs[k] = docs[0]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    return {r.doc_id for r in decontam.find(d, b).collect() if r.contaminated}


def test_decontamination_of_an_item_in_a_third_of_the_texts(spark):
    assert hot_item(spark, 300, 100) == set(range(100))


def test_decontamination_of_five_texts(spark):
    assert hot_item(spark, 5, 2) == {0, 1} and hot_item(spark, 5, 5) == set(range(5))


@pytest.mark.parametrize("length", [49, 140, 300, 1000])
def test_decontamination_of_long_items(spark, length):
    random.seed(length)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(3, 8))) for _ in range(2000)]
    draw = lambda k: random.choices(vocabulary, k=k)
    items = [draw(length) for _ in range(6)]
    docs = [draw(random.randint(30, 200)) + (items[k] if k < 6 else []) + draw(70) for k in range(40)]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find(d, b).collect() if r.contaminated} == {(k, k) for k in range(6)}


def test_decontamination_finds_paraphrases_that_keep_two_thirds(spark):
    random.seed(31)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(3, 8))) for _ in range(3000)]
    draw = lambda k: random.choices(vocabulary, k=k)
    items = [draw(random.randint(20, 45)) for _ in range(60)]
    docs = []
    for k in range(60):
        own = [w if random.random() < 0.68 else random.choice(vocabulary) for w in items[k]]
        docs.append(draw(60) + own + draw(60))
    docs += [draw(150) for _ in range(200)]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = {r.doc_id for r in decontam.find(d, b).collect() if r.contaminated}
    assert len(found & set(range(60))) >= 54 and not found - set(range(60))


def exhaustive(docs, items, share):
    """(document, item) with at least this share of the item as a common subsequence with some stretch of three item lengths."""
    code = {}
    number = lambda ws: np.array([code.setdefault(w, len(code)) for w in ws], np.uint64)
    own = [number(i) for i in items]
    found = set()
    for d, words_ in enumerate(docs):
        text = number(words_)
        for i, x in enumerate(own):
            if len(np.intersect1d(x, text)) >= share * len(np.unique(x)):
                n = len(x)
                if any(decontam.common_subsequence(x, text[a : a + 3 * n]) >= share * n for a in range(0, max(1, len(text) - n), n)):
                    found.add((d, i))
    return found


@pytest.mark.parametrize("n", [1, 2, 10])
def test_decontamination_against_exhaustive_search(spark, n):
    """As many items as the rank of the latent space, and two and ten times as many; a third of the planted copies is changed."""
    random.seed(n)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(2, 8))) for _ in range(4000)]
    draw = lambda k: random.choices(vocabulary, k=k)
    items = [draw(random.randint(15, 40)) for _ in range(n * decontam.RANK)]
    docs = []
    for k in range(90):
        own = list(items[k * n])
        if k % 3 == 0:
            for i in random.sample(range(len(own)), len(own) // 5):
                own[i] = random.choice(vocabulary)
        docs.append(draw(40) + own + draw(40))
    docs += [draw(100) for _ in range(60)]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    want = exhaustive(docs, items, 0.7)
    got = {(r.doc_id, r.item_id) for r in decontam.find(d, b).collect() if r.contaminated}
    assert len(want) >= 88 and len(want & got) >= 0.97 * len(want)


@pytest.mark.parametrize("n", [1, 2, 10])
def test_decontamination_with_a_small_part_of_the_texts_in_the_sample(spark, monkeypatch, n):
    """The basis fitted on some 20 of 600 texts, of which every one is searched: recall against exhaustive search."""
    random.seed(50 + n)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(2, 8))) for _ in range(4000)]
    draw = lambda k: random.choices(vocabulary, k=k)
    items = [draw(random.randint(15, 40)) for _ in range(n * decontam.RANK)]
    docs = []
    for k in range(120):
        own = [random.choice(vocabulary) if k % 2 and random.random() < 0.2 else w for w in items[k * n]]
        docs.append(draw(60) + own + draw(60))
    want = exhaustive(docs, items, 0.7)
    docs += [draw(150) for _ in range(480)]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    monkeypatch.setattr(decontam, "SAMPLE", 20)
    assert 5 <= decontam.sampled(d, 600).count() <= 60
    got = {(r.doc_id, r.item_id) for r in decontam.find(d, b).collect() if r.contaminated}
    monkeypatch.setattr(decontam, "SAMPLE", 1_000_000)
    whole = {(r.doc_id, r.item_id) for r in decontam.find(d, b).collect() if r.contaminated}
    assert len(want) >= 100 and len(want & got) >= 0.97 * len(want) and len(want & got) >= len(want & whole) - 1


def test_decontamination_in_parts(spark, monkeypatch):
    d, b = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    d = d.unionByName(d.limit(5)).unionByName(spark.createDataFrame([(None, None, None, None, None)], d.schema)).withColumns({c: F.lit("clash") for c in ("share", "_none", "n_items", "i", "t")})
    rows = lambda: sorted(str(tuple(r)) for r in decontam.find(d, b).collect())
    want, kept = {(r.doc_id, r.contaminated) for r in decontam.find(d, b).collect()}, decontam.clean(d, b).count()
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 3000)
    got = decontam.find(d, b).collect()
    assert len(got) == d.count() and {(r.doc_id, r.contaminated) for r in got} == want and decontam.clean(d, b).count() == kept
    assert decontam.clean(d, b).columns == d.columns


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_different_texts(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "REPEATED", most)
    d = spark.createDataFrame([(None,)] * 3 + [("a",)] * 4 + [("b",)], "text string").unionByName(spark.createDataFrame([("c",), ("c",), ("",)], "text string"))
    assert sorted(str(r.text) for r in decontam.different(d).collect()) == ["", "None", "a", "b", "c"]


def test_decontamination_sample_has_no_null_and_each_text_once(spark):
    d = spark.createDataFrame([(None,)] * 50 + [("the same text",)] * 500 + [(f"text {k}",) for k in range(40)], "text string")
    got = [r.text for r in decontam.sampled(d, 41).collect()]
    assert sorted(got) == sorted({r.text for r in d.collect()} - {None})


def test_common_subsequence():
    random.seed(1)
    for _ in range(50):
        a, b = ([random.randint(0, 5) for _ in range(random.randint(0, 20))] for _ in (0, 1))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64)) == table[-1][-1]


# 7


def test_unigram_scores(documents, odd, texts):
    for frame, own in ((documents, [(i, t) for i, t, _ in texts]), (odd, [(r[0], r[1]) for r in ODD])):
        counts, ends = collections.Counter(), 0
        for i, t in own:
            if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
                counts.update(words(t))
                ends += 1
        total, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
        log = lambda c: math.log10((c + 1) / (total + distinct + 1))
        want = collections.defaultdict(list)
        for i, t in own:
            w = words(t)
            want[i].append((len(w) + 1, sum(counts[x] > 0 for x in w) + (ends > 0), sum(log(counts[x]) for x in w) + log(ends)))
        for r in lmscore.score(frame).collect():
            assert r.train_tokens == total
            assert any((r.n_tokens, r.n_known) == (n, k) and abs(r.base_score - s) < 1e-6 for n, k, s in want[r.doc_id])
            assert r.score < 0


def test_rare_words_are_joined(documents, monkeypatch):
    want = {r.doc_id: r.base_score for r in lmscore.score(documents).collect()}
    monkeypatch.setattr(lmscore, "HEAD", 0.01)
    assert {r.doc_id: r.base_score for r in lmscore.score(documents).collect()} == want


def brute_tree(texts, singles, least, pair):
    """Retained contexts with their distributions, by the definition: {context: (distribution of symbols seen, left)}."""
    total = sum(map(len, texts))
    tree, level = {(): ({}, 1.0)}, [()]

    def probability(context, s):
        seen, left = tree[context]
        if not context:
            return singles[s]
        below = probability(suffix(context[1:]), s)
        return seen.get(s, 0.0) + left * below

    def suffix(context):
        while context not in tree:
            context = context[1:]
        return context

    while level:
        counts = collections.defaultdict(collections.Counter)
        for t in texts:
            for i, s in enumerate(t):
                history = (suffix_tree.END, *t[:i])
                for c in level:
                    if len(history) > len(c) and history[len(history) - len(c) :] == c and suffix_tree.END not in c:
                        counts[history[len(history) - len(c) - 1 :]][s] += 1
        new = {}
        for c, n in counts.items():
            m = sum(n.values())
            often = {s: k for s, k in n.items() if k >= pair}
            if m < least or not often:
                continue
            left = 1 - sum(k - suffix_tree.DISCOUNT for k in often.values()) / m
            below = {s: probability(suffix(c[1:]), s) for s in often}
            gain = sum(k * math.log((max(k - 1 - suffix_tree.DISCOUNT, 0) / max(m - 1, 1) + left * below[s]) / below[s]) for s, k in often.items())
            gain += (m - sum(often.values())) * math.log(max(left, 1e-12))
            if gain > suffix_tree.PENALTY * math.log(total):
                new[c] = {s: (k - suffix_tree.DISCOUNT) / m for s, k in often.items()}, left
        tree.update(new)
        level = list(new)
    return tree, probability, suffix


def test_tree_against_brute_force(spark, monkeypatch):
    random.seed(12)
    words_ = [f"w{k}" for k in range(12)]
    texts = []
    for _ in range(150):
        own = []
        while len(own) < 25:
            own += random.choice([["w1", "w2", "w3", "w4"], ["w5", "w2", "w3", "w6"], [random.choice(words_)], [random.choice(words_)]])
        texts.append(own)
    monkeypatch.setattr(suffix_tree, "LEAST", 8)
    seen = []
    monkeypatch.setattr(lmscore, "fit_tree", lambda training, words, total, fit=lmscore.fit_tree: seen.append((fit(training, words, total), words)) or seen[-1][0])
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = lmscore.score(d).collect()
    tree, own = seen[0]
    number = dict(zip(own.head.tolist(), own.symbol.tolist(), strict=True))
    coded = [[*(number.get(int(h), suffix_tree.RARE) for h in lmscore.word_hashes([" ".join(t).encode()])[0]), suffix_tree.END] for t in texts]
    training = [s for k, s in enumerate(coded) if zlib.crc32(str(k).encode()) % 7 != 2]
    total = sum(map(len, training))
    assert total == rows[0].train_tokens
    want, probability, suffix = brute_tree(training, own.singles, suffix_tree.support(total), suffix_tree.least_pair(total))
    assert set(tree.contexts) == set(want) and max(map(len, want)) >= 3
    for c in want:
        p = [probability(c, s) for s in range(len(own.singles))]
        assert abs(sum(p) - 1) < 1e-6 and min(p) > 0
    for r in rows:
        s = coded[r.doc_id]
        assert suffix_tree.RARE not in s
        assert abs(r.score - sum(math.log10(probability(suffix((suffix_tree.END, *s[:i])), x)) for i, x in enumerate(s))) < 1e-6


def test_rare_words_as_contexts_against_brute_force(spark, monkeypatch):
    """Without retained contexts of the tree, by the definition; words below the head's share are rare."""
    random.seed(15)
    words_ = [f"w{k}" for k in range(8)]
    texts = []
    for k in range(60):
        own = random.choices(words_, k=15)
        for j in range(4):
            own.insert(random.randint(0, len(own)), f"r{random.randint(0, 60)}")
        texts.append(own + [f"x{k // 3}", "w3", f"y{k // 2}", f"z{k // 4}"])
    texts[7] = texts[8] = texts[9]
    monkeypatch.setattr(suffix_tree, "LEAST", 10**9)
    monkeypatch.setattr(lmscore, "HEAD", 0.02)
    monkeypatch.setattr(lmscore, "OFTEN", 2)
    rows = lmscore.score(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)] + [(9, " ".join(texts[9]))], "doc_id long, text string")).collect()
    texts = [(k, t) for k, t in enumerate(texts)] + [(9, texts[9])]
    learned = [t for k, t in texts if zlib.crc32(str(k).encode()) % 7 != 2]
    count = collections.Counter(w for t in learned for w in t)
    total = sum(map(len, learned)) + len(learned)
    rare = lambda w: count[w] < max(0.02 * total, 2)
    size = total + len(count) + 1 + 1
    symbol = lambda w: "RARE" if w != "END" and rare(w) else w
    single = {w: (n + 1) / size for w, n in count.items() if not rare(w)} | {"END": (len(learned) + 1) / size}
    single["RARE"] = 1 - sum(single.values())
    pairs = collections.defaultdict(collections.Counter)
    for t in learned:
        for a, b in zip(t, [*t[1:], "END"], strict=True):
            if rare(a):
                pairs[a][symbol(b)] += 1
    kept = {}
    for c, n in pairs.items():
        m, often = count[c], {s: k for s, k in n.items() if k >= 2}
        if not often:
            continue
        left = 1 - sum(k - 0.75 for k in often.values()) / m
        gain = sum(k * math.log((max(k - 1.75, 0) / max(m - 1, 1) + left * single[s]) / single[s]) for s, k in often.items()) + (m - sum(often.values())) * math.log(left)
        if gain > lmscore.TAIL:
            kept[c] = {s: (k - 0.75) / m for s, k in often.items()}, left
    assert 5 < len(kept) < len(pairs)
    want = collections.defaultdict(list)
    for k, t in texts:
        more = 0.0
        for a, b in zip(t, [*t[1:], "END"], strict=True):
            if a in kept:
                own, left = kept[a]
                more += math.log10((own.get(symbol(b), 0) + left * single[symbol(b)]) / single[symbol(b)])
        want[k].append(more)
    assert max(x for w in want.values() for x in w) > 1
    for r in rows:
        assert any(abs(r.score - r.base_score - x) < 1e-4 for x in want[r.doc_id]), r


def test_texts_that_occur_twice_are_told_apart(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.choice([1, 2, 2, 6, 7])))
    texts = [" ".join(word() for _ in range(150)) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[k]) for k in range(0, 400, 8)]
    got = {r.doc_id: r.tail_per_token for r in lmscore.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    learned = lambda k: zlib.crc32(str(k).encode()) % 7 != 2
    twice = [got[k] for k in range(0, 400, 8) if learned(k) and learned(1000 + k)]
    once = [got[k] for k in range(400) if k % 8]
    assert min(twice) > max(once)


def test_tree_foretells_held_out_texts_better_than_single_words(spark):
    rows = lmscore.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in rows) > 0.98 * sum(r.base_score for r in rows) > 1.02 * sum(r.base_score for r in rows)
    assert np.mean([r.score >= r.base_score for r in rows]) > 0.85


def test_tree_writes_only_pairs_that_can_count(spark, monkeypatch):
    """Of the pairs, those seen less than least_pair times are dropped before they are written."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    least, trees = [], []
    monkeypatch.setattr(lmscore, "cut", lambda frame, cut=lmscore.cut: least.append(out := cut(frame)) or out)
    monkeypatch.setattr(lmscore, "fit_tree", lambda *a, fit=lmscore.fit_tree: trees.append(fit(*a)) or trees[-1])
    want = sorted(map(tuple, lmscore.score(d).collect()))
    pairs = [f for f in least if f.columns == ["key", "n"]]
    assert pairs and all(f.agg({"n": "min"}).collect()[0][0] >= trees[0].least_pair for f in pairs if f.count())
    for side in (1, 3):
        monkeypatch.setattr(lmscore, "COMMON", side)
        assert sorted(map(tuple, lmscore.score(d).collect())) == want


def test_head_words_by_their_first_bits():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 3000):
        head = np.unique(np.concatenate([rng.integers(0, 1 << 64, n, np.uint64), rng.integers(0, 9, n, np.uint64), (1 << 64) - 1 - rng.integers(0, 9, n).astype(np.uint64)]))
        words = lmscore.Words(head, np.full(len(head), 20), 20 * len(head) + 9, len(head), 3)
        asked = np.concatenate([head, rng.integers(0, 1 << 64, 500, np.uint64), np.array([0, 1, (1 << 64) - 1], np.uint64)])
        place, hit = words.find(asked)
        assert hit.tolist() == np.isin(asked, head).tolist() and (head[place[hit]] == asked[hit]).all()


def test_tree_grows_with_the_corpus(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(lmscore, "fit_tree", lambda *a, fit=lmscore.fit_tree: sizes.append(fit(*a)) or sizes[-1])
    for sf in (SF, "/root/testdata/sf0.01"):
        lmscore.score(spark.read.parquet(f"{sf}/documents.parquet"))
    assert len(sizes[1].contexts) > 1.5 * len(sizes[0].contexts) and sizes[1].depth >= 3


# 8


def test_lines(spark):
    rows = [(i, f"menu\nown {i}\n\nfooter x" if i < 8 else f"own {i}", "h") for i in range(20)] + [(20, "menu", "g"), (21, None, "h"), (22, "menu\nx", None), (23, "", "h")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_boilerplate_", F.lit(1))
    got = {r.doc_id: r for r in linededup.drop_lines(d, count_as="n").collect()}
    assert got[0].text == "own 0\n" and got[0].n == 2
    assert (got[10].text, got[20].text, got[21].text, got[22].text, got[23].text) == ("own 10", "menu", None, "menu\nx", "")


def test_lines_of_copies_are_no_boilerplate(spark):
    d = spark.createDataFrame([(i, "the same page\nof two lines", "h") for i in range(50)] + [(i, f"own {i}", "h") for i in range(50, 60)], "doc_id long, text string, source string")
    assert linededup.drop_lines(d).filter("doc_id < 50 and text like 'the same%'").count() == 50


def test_lines_without_broadcast(documents, monkeypatch):
    want = sorted((r.doc_id, r.text) for r in linededup.drop_lines(documents, ratio=0.02, least=2).collect())
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 0)
    assert sorted((r.doc_id, r.text) for r in linededup.drop_lines(documents, ratio=0.02, least=2).collect()) == want


# 9


def test_chat(spark):
    call = lambda i, name, args: {"id": i, "name": name, "arguments": args}
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", json.dumps({"tool_calls": [call("c2", "add", {"x": "$c1", "y": 1})]})), (1, 2, "tool", json.dumps({"tool_call_id": "c2", "content": "9"})),
        (1, 3, "assistant", json.dumps({"tool_calls": [call("c1", "get", {"k": "é"})]})), (1, 4, "tool", json.dumps({"tool_call_id": "c1", "content": "8"})), (1, 5, "tool", json.dumps({"tool_call_id": "lost", "content": "?"})),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("c1", "get", {"k": 5, "z": 1})]})), (2, None, "user", None), (None, 0, "user", "{broken"), (2, None, "user", None),
    ]
    schemas = {"get": {"type": "object", "required": ["k"], "properties": {"k": {"type": "string"}}, "additionalProperties": False}, "add": {"type": "object"}}
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()}
    assert (got[1].n_calls, got[1].n_results, got[1].n_linked, got[1].n_orphans, got[1].n_invalid) == (2, 3, 2, 1, 0)
    order = [(m["role"], m.get("tool_call_id") or [c["id"] for c in m.get("tool_calls", [])]) for m in json.loads(got[1].json)["messages"]]
    assert order == [("user", []), ("assistant", ["c1"]), ("tool", "c1"), ("assistant", ["c2"]), ("tool", "c2"), ("tool", "lost")]
    assert (got[2].n_messages, got[2].n_linked, got[2].n_orphans, got[2].n_invalid) == (3, 0, 1, 1)
    assert got[None].json == '{"messages":[{"content":"{broken","role":"user"}]}'
    assert got[1].json == chat.canonical(json.loads(got[1].json))


def test_chat_of_odd_json(spark):
    """What has no canonical JSON is text; lone surrogates are replaced; nothing of it stops a task."""
    call = '{"tool_calls": [{"id": "c1", "name": "get", "arguments": {"x": %s}}]}'
    texts = [call % "NaN", call % "1e999", call % "-Infinity", call % ("[" * 50_000 + "]" * 50_000), call % ("[" * 200 + "]" * 200), call % '"\\ud800"', call % ("9" * 6000), call % '"$c1"', '{"tool_calls": 5}', '{"tool_calls": [5, {"id": 7}]}', "[]", "", None, '"' * 70_000]
    rows = [(k, 0, "assistant", t) for k, t in enumerate(texts)] * 2 + [(99, None, None, None), (None, 1, "tool", '{"tool_call_id": null}')]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("messages", "ids", "c", "i", "json")})
    got = {r.conv_id: r for r in chat.format_conversations(d, {"get": {"type": "object"}}).collect()}
    assert set(got) == {r[0] for r in rows}
    assert [got[k].n_calls for k in range(len(texts))] == [0, 0, 0, 0, 0, 2, 0, 2, 0, 0, 0, 0, 0, 0]
    assert all(got[k].n_messages == 2 for k in range(len(texts))) and "\ufffd" in got[5].json
    for k, t in enumerate(texts):
        if not got[k].n_calls and k not in (8, 9):
            assert json.loads(got[k].json)["messages"][0]["content"] == (t or "")
    assert chat.format_conversations(d.limit(0)).count() == 0


def test_chat_order_against_brute_force():
    def brute(n, before):
        done, order = set(), []
        while len(order) < n:
            free = [k for k in range(n) if k not in done and not (before[k] - done)] or [min(k for k in range(n) if k not in done)]
            order.append(min(free))
            done.add(order[-1])
        return order

    random.seed(9)
    for _ in range(300):
        n = random.randint(1, 12)
        ids = [f"c{random.randint(0, 5)}" for _ in range(n)]
        nodes, call_at, result_at = [], {}, {}
        for k in range(n):
            if random.random() < 0.5:
                nodes.append(({"role": "assistant"}, {random.choice(ids) for _ in range(random.randint(0, 2))}))
                call_at.setdefault(ids[k], k)
            else:
                nodes.append(({"role": "tool", "tool_call_id": ids[k]}, set()))
                result_at.setdefault(ids[k], k)
        before = [({result_at[i] for i in needs if i in result_at} | ({call_at[x["tool_call_id"]]} if x.get("tool_call_id") in call_at else set())) - {k} for k, (x, needs) in enumerate(nodes)]
        assert chat._order(nodes, call_at, result_at) == brute(n, before)


def test_chat_of_a_very_long_conversation():
    messages = [{"turn": k + 2, "role": "assistant", "text": json.dumps({"tool_calls": [{"id": f"c{k}", "name": "x", "arguments": {"a": f"$c{k + 2}"}}]})} if k % 2 == 0 else {"turn": k, "role": "tool", "text": json.dumps({"tool_call_id": f"c{k - 1}", "content": "v"})} for k in range(40_000)]
    text, n = chat.assemble(messages, {f"c{k}": True for k in range(40_000)}, {})
    assert n["n_calls"] == n["n_results"] == n["n_linked"] == 20_000 and len(json.loads(text)["messages"]) == 40_000


def test_chat_query_has_calls(spark):
    got = queries.op9_chat(spark, SF).collect()
    assert sum(r.n_linked for r in got) > 10 and 0 < sum(r.n_invalid for r in got) < sum(r.n_calls for r in got)
    for r in got:
        own = json.loads(r.json)["messages"]
        for k, m in enumerate(own):
            if m["role"] == "tool":
                assert own[k - 1]["tool_calls"][0]["id"] == m["tool_call_id"]


# 10


def brute_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    own = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(ids))]


def test_fingerprints_and_components(documents, odd, texts):
    for frame, own in ((documents, [(i, t) for i, t, _ in texts]), (odd, [(r[0], r[1]) for r in ODD])):
        prints = [brute_fingerprint(t) for _, t in own]
        want = sorted(map(str, zip([i for i, _ in own], [f"{p:016x}" for p in prints], brute_components([i for i, _ in own], prints), strict=True)))
        assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in simhash.near_duplicates(frame).collect()) == want


@pytest.mark.parametrize("hot", [4096, 7])
def test_all_links_between_fingerprints(spark, hot):
    random.seed(8)
    centres = [random.getrandbits(64) for _ in range(6)]
    prints = sorted({c ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 5))) for c in centres for _ in range(60)})
    ids = list(range(len(prints)))
    d = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    linked = simhash.links(simhash.with_table(d), hot=hot)
    comps = {r.id & (1 << 64) - 1: r.component for r in components.components(linked).collect()}
    want, groups = brute_components(ids, prints), collections.defaultdict(set)
    for k, p in enumerate(prints):
        groups[want[k]].add(comps.get(p, ("alone", p)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert linked.count() <= 15 * len(prints)


def edited(spark, groups=12, copies=9, length=150):
    """Invented texts in groups of copies, each with some words replaced; repeated rows and unrelated texts among them."""
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefgh", k=6))
    rows = [(1000 + k, " ".join(word() for _ in range(length))) for k in range(40)]
    for g in range(groups):
        base = [word() for _ in range(length)]
        for c in range(copies):
            own = list(base)
            for _ in range(random.randint(0, 4)):
                own[random.randrange(length)] = word()
            rows.append((g * copies + c, " ".join(own)))
    return spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string")


def brute_similar(rows, similarity=0.8):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    ids = sorted(sets)
    by = collections.defaultdict(set)
    for i in ids:
        for x in sets[i]:
            by[x].add(i)
    pairs = set()
    for i in ids:
        for j in set().union(*(by[x] for x in sets[i])):
            if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                pairs.add((i, j))
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in sorted(pairs):
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return pairs, {i: find(i) for i in ids}


def similar_holds(frame, hot=None):
    """Links found: at least nine in ten of all; no group but within a true one. (pairs, share found)"""
    pairs, want = brute_similar([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])
    got = {r.doc_id: r.component_id for r in simhash.similar(frame).collect()}
    groups = collections.defaultdict(set)
    for i, c in got.items():
        groups[c].add(want[i])
    mixed = [g for g in groups.values() if len(g) > 1]
    found = sum(got[i] == got[j] for i, j in pairs)
    assert len(mixed) <= 0.01 * len(groups) and found >= 0.9 * len(pairs)
    return len(pairs), found


@pytest.mark.parametrize("hot", [2048, 5])
def test_similar_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash.close_links, "__defaults__", (hot,))
    monkeypatch.setattr(simhash, "CLUSTER", hot)
    n, found = similar_holds(edited(spark))
    assert n > 100 and found >= 0.97 * n


def test_similar_documents_of_the_test_table(documents):
    assert similar_holds(documents)[0] > 10


def test_pivots_discard_most_and_lose_nothing(spark):
    random.seed(18)
    prints = np.array([random.getrandbits(64) for _ in range(4000)], np.uint64)
    near = prints ^ np.array([sum(1 << b for b in random.sample(range(64), random.randint(0, 4))) for _ in prints], np.uint64)
    x, y = simhash.pivot_table(prints), simhash.pivot_table(near)
    assert simhash.near_by_pivots(x, y, 4).all()
    assert simhash.near_by_pivots(x, np.roll(y, 1), 4).mean() < 0.01
    brute = [[min(max(bin(int(p) ^ int(q)).count("1") - simhash.NEAREST, 0), 31) for q in simhash.PIVOT_TABLE] for p in prints[:50]]
    assert [[int(t) >> 5 * k & 31 for k in range(simhash.PIVOTS)] for t in x[:50]] == brute
    n = simhash.discards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert n["met"] > n["discarded"] > 0.9 * (n["met"] - n["linked"]) and n["linked"] > 0


def test_close_pairs_hold_clusters_together():
    rng = np.random.default_rng(3)
    one = np.unpackbits(rng.integers(0, 256, 32, np.uint8))
    rows = np.array([np.packbits(np.where(rng.random(256) < 0.07, 1 - one, one)) for _ in range(300)]).view(np.uint64)
    most = simhash.limit(0.8)
    i, j = simhash.close_pairs(np.zeros(300, np.int64), rows, np.zeros(300, np.int64), most)
    assert len(i) < 300
    d = np.bitwise_count(rows[:, None] ^ rows[None]).sum(2)
    label = simhash.Union(300)
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        label.join(x, y)
    label = label.labels()
    assert all(label[x] == label[y] for x, y in zip(*np.nonzero(d <= most), strict=True))
    assert not len(simhash.close_pairs(np.arange(300), rows, np.zeros(300, np.int64), most)[0])


@pytest.mark.parametrize("table", [1 << 26, 0])
def test_verified_pairs_against_brute_force(monkeypatch, table):
    """Every pair of different groups that is similar is found, with shared shingles as bits and without."""
    monkeypatch.setattr(simhash, "TABLE_BYTES", table)
    rng = np.random.default_rng(7)
    sets = []
    for g in range(6):
        base = rng.integers(0, 1 << 60, 40).astype(np.uint64)
        for _ in range(12):
            own = base.copy()
            own[rng.permutation(40)[: rng.integers(0, 9)]] = rng.integers(0, 1 << 60, 1).astype(np.uint64)
            sets.append(np.unique(np.concatenate([own, rng.integers(0, 1 << 60, rng.integers(0, 5)).astype(np.uint64)])))
    sets += [np.zeros(0, np.uint64)] * 2
    prints = np.array([np.frombuffer(simhash.wide_fingerprint(x), np.uint64) for x in sets])
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    for sides in (np.zeros(len(sets), np.int64), np.arange(len(sets)) % 2 + 1):
        want = {(i, j) for i, j in true if not sides[i] or sides[i] != sides[j]}
        got = simhash.verified_pairs(prints, sets, sides, 0.8, 256)
        assert set(got) <= want and len(got) < len(sets)
        union = simhash.Union(len(sets))
        for i, j in got:
            union.join(i, j)
        assert all(union.root(i) == union.root(j) for i, j in want)


def doubtful(groups=300):
    """Any two of the texts share enough that they may be similar; few pairs are: the twelve that were planted."""
    random.seed(21)
    word = lambda: "".join(random.choices("abcdefgh", k=7))
    base, rows = [word() for _ in range(200)], []
    for _ in range(groups):
        own = list(base)
        for i in random.sample(range(200), 3):
            own[i] = word()
        rows.append(own)
    for k in range(12):
        own = list(rows[k])
        for i in random.sample(range(200), 3):
            own[i] = word()
        rows.append(own)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


@pytest.mark.parametrize("cluster", [1024, 50])
def test_similar_finds_the_true_pairs_of_a_doubtful_group(spark, monkeypatch, cluster):
    monkeypatch.setattr(simhash, "CLUSTER", cluster)
    rows = doubtful()
    sets = [simhash.shingle_set(t.encode()) for _, t in rows]
    true = [(i, j) for i in range(len(rows)) for j in range(i) if len(np.intersect1d(sets[i], sets[j], True)) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert sum(i - 300 == j for i, j in true) == 12
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == got[j] for i, j in true)
    _, want = brute_similar(rows)
    assert got == want


def test_similar_recall_at_the_larger_table(spark):
    """A whole run: at least 0.99 of the pairs of documents that are similar, and no group but true ones."""
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n, found = similar_holds(frame)
    assert n > 50 and found >= 0.99 * n


def test_components_of_a_long_chain(spark):
    """However many rounds it takes."""
    chain = [(k, k + 1) for k in range(0, 3000)] + [(10_000 + k, 10_000) for k in range(1, 500)]
    random.seed(2)
    random.shuffle(chain)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(c == (0 if i <= 3000 else 10_000) for i, c in got.items()) and len(got) == 3001 + 500


def test_one_of_each(documents):
    kept = simhash.one_of_each(documents)
    assert kept.columns == documents.columns
    assert kept.count() == simhash.similar(documents).select("component_id").distinct().count()


# The queries and the pipeline


def test_queries_are_registered(spark):
    import __spark_entry__ as e

    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in e.queries()} and "pipeline" in e.queries()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_duckdb(spark, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(str(tuple(r[n] for n in names)) for r in got.collect()) == sorted(str(tuple(r[want.columns.index(n)] for n in names)) for r in want.fetchall())


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_on_odd_tables(spark, odd, empty, k):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, an empty table."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    clean = " ".join(f"word{i} of a clean text" for i in range(40))
    more = spark.createDataFrame([(100 + i, f"{clean} number {i} {i * 7} {i * 13}", "en", "c", 1) for i in range(3)] + [(None, None, None, None, None), (200, clean + " end", None, None, None), (200, clean + " end", None, None, None)], COLUMNS)
    docs = odd.select(*[c.split()[0] for c in COLUMNS.split(", ")]).unionByName(more).withColumns({c: F.lit("clash") for c in ("wide", "node", "n", "_lines", "_host", "_chosen", "_least", "key", "text_hash", "bits", "cluster")})
    out = stage(spark, docs, SF)
    rows = out.collect()
    if k < 4:
        assert out.columns == docs.columns and len(rows) <= docs.count()
    else:
        assert len(rows) == docs.count()
    if name == "quality_rules":
        assert all(len((r.text or "").split()) >= 20 for r in rows)
    if name == "line_dedup":
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    if name == "simhash_near_dedup":  # 2, 3, 4 and null texts without words are one group, of which 2 stays
        ids = [r.doc_id for r in rows]
        assert 2 in ids and 3 not in ids and 4 not in ids and ids.count(5) == 2 and len({100, 101, 102, 200} & set(ids)) == 1
    if name == "benchmark_decontamination":
        assert len(rows) == docs.count()
    none = stage(spark, docs.limit(0), SF)
    assert none.count() == 0 and (k == 4 or none.columns == docs.columns)


def test_pipeline_against_its_operators(spark):
    """The run's rows are those that each stage's operator, tested by brute force above, keeps of what the one before it kept."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    docs = docs.filter(F.col("doc_id").isin(list(judged)))
    docs = linededup.drop_lines(docs)
    _, group = brute_similar([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    docs = docs.filter(F.col("doc_id").isin(sorted(set(group.values()))))
    dirty = {r.doc_id for r in decontam.find(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("contaminated").collect()}
    want = sorted(set(group.values()) - dirty)
    got = sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and dirty


def test_pipeline_workers_keep_nothing_of_another_operator(spark, documents, monkeypatch):
    """Whatever a stage sends to workers drops what the other operators keep in one: words and their ids, a model's table."""
    import corpus_pipeline

    sent, frame = [], type(documents)
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, *a, f=frame.mapInArrow, **b: sent.append((name, run)) or f(self, run, *a, **b))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, documents, SF)
    assert {n for n, _ in sent} == {n for n, _ in corpus_pipeline.STAGES} - {"line_dedup"}
    model = kneser_ney.Model(np.array([1, 2]), np.array([3, 4]))
    for name, run in sent:
        list(next(f for n, f in sent if n != name)(iter([])))  # the worker served another stage before
        bpe._encoder(bpe.default_path())
        quality._scorers[:] = [kneser_ney.Scorer(model)]
        list(run(iter([])))
        assert bool(bpe._encoder.cache_info().currsize) == (name == "bpe_encoding"), name
        assert bool(quality._scorers) == (name == "quality_rules"), name


def test_pipeline_does_not_depend_on_the_sample(spark, monkeypatch):
    """The rows are the same with about 20 texts and with all texts in the sample that decontamination's basis is fitted on."""
    import corpus_pipeline

    got = []
    for n in (20, 1_000_000):
        monkeypatch.setattr(decontam, "SAMPLE", n)
        got.append(sorted(map(str, corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect())))
    assert got[0] == got[1]


def test_pipeline_stages(spark, documents):
    import corpus_pipeline

    docs = documents
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == documents.columns
            assert 0 < out.count() <= docs.count()
            docs = out
    assert out.count() == docs.count() == corpus_pipeline.run(spark, SF).count()
